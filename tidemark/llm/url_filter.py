"""URL filters: pattern rules found by their rarest literal token.

Two layers. Host and path rules decide first: the longest rule that fits a url wins. Where none
fits, pattern rules decide. A pattern rule is a url with wildcards: `*` matches anything, `^` a
separator or the end, a leading `|` the start, a trailing `|` the end, a leading `||` the start of
the host or of one of its labels. Every rule is filed under that of its literal tokens which the
fewest urls hold; a url's tokens fetch the rules filed under them, and only those run their regular
expression. Rules without a literal token are tried on every url.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table

#: (host, path, verdict); the rules of the contract.
HOST_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: (pattern, verdict); of several that match, allow beats block.
PATTERN_RULES = [
    ("||spam-farm.", "block"),
    ("||adult-x.", "block"),
    ("||casino-win.", "block"),
    ("||malware.", "block"),
    ("/ads/", "block"),
    ("/track^", "block"),
    ("?utm_source=feed|", "block"),
    ("^page=2&ref=x|", "block"),
    ("||blog.*/en/2^", "allow"),
]
TOKEN = "[a-z0-9]+"
#: Filed rules that may be broadcast; larger rule tables are joined by shuffle.
BROADCAST_RULES = 50_000


def pattern_regex(pattern: str) -> str:
    """The regular expression (for lower-cased urls) of a pattern rule."""
    p, out = pattern.lower(), ""
    if p.startswith("||"):
        out, p = r"^[a-z][a-z0-9+.-]*://([^/?#]*[.])?", p[2:]
    elif p.startswith("|"):
        out, p = "^", p[1:]
    end = "$" if p.endswith("|") else ""
    for c in p[: len(p) - len(end)]:
        out += ".*" if c == "*" else r"([^a-z0-9_.%-]|$)" if c == "^" else re.sub(r"([^a-z0-9/:=&_-])", r"\\\1", c)
    return out + end


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that every matching url holds whole: runs of letters and digits with a literal non-token character, `^` or an anchor on both sides."""
    p = pattern.lower()
    return sorted({m[0] for m in re.finditer(TOKEN, p) if (m.start() > 0 and p[m.start() - 1] != "*") and (m.end() < len(p) and p[m.end()] != "*")})


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as the contract cuts them; both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    rows = [(i, p, v, pattern_regex(p), literal_tokens(p)) for i, (p, v) in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id long, pattern string, action string, regex string, tokens array<string>")


def file_rules(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """rules with key: the rarest of their literal tokens over tokens(token), one row per url and token; ties go to the longer, then the smaller; '' without a literal token.

    Only counts of tokens that a rule holds are joined, so no count leaves the cluster.
    """
    wanted = rules.select("rule_id", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    rated = wanted.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = rated.groupBy("rule_id").agg(F.min(F.struct("n", (-F.length("token")).alias("short"), "token")).alias("best"))
    return rules.join(best, "rule_id", "left").withColumn("key", F.coalesce("best.token", F.lit(""))).drop("best", "tokens")


def match_patterns(urls: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(id, pattern, action) of the rule that decides each url some rule matches; allow beats block, then the smaller rule_id. Null urls match nothing."""
    lower = urls.select(F.col(id_column), F.lower(F.col(url_column)).alias("u")).filter("u is not null")
    words = F.array_distinct(F.regexp_extract_all("u", F.lit(f"({TOKEN})"), 1))
    tokens = lower.select(id_column, "u", F.explode(F.array_append(words, F.lit(""))).alias("token"))
    filed = materialize(file_rules(rules, tokens.select("token")), "url-rules").withColumnRenamed("key", "token")
    small = filed.count() <= BROADCAST_RULES
    hits = tokens.join(F.broadcast(filed) if small else filed, "token").filter(F.expr("u rlike regex"))
    return hits.groupBy(id_column).agg(F.min(F.struct("action", "rule_id", "pattern")).alias("m")).select(id_column, F.col("m.pattern").alias("pattern"), F.col("m.action").alias("action"))


def host_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest host and path rule that fits; null if none. Equal lengths: the smaller rule text."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(-len(h + p)).alias("len"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_min(F.filter(F.array(*fits), lambda x: x.isNotNull()))


def judge_urls(pages: DataFrame, host_rules: list[tuple[str, str, str]] = HOST_RULES, pattern_rules: list[tuple[str, str]] = PATTERN_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of each page row: the host rule's verdict, else the deciding pattern rule's, else allow.

    Repeated rows are judged alike; pages that share a page_id but not a url are judged by url. Null
    urls are allowed with empty host and path.
    """
    host, path = url_parts(F.col("url"))
    base = pages.select("page_id", "url").withColumns({"host": host, "path": path}).withColumn("r", host_rule(F.col("host"), F.col("path"), host_rules))
    distinct = base.filter("r is null and url is not null").select(F.col("url").alias("u0")).distinct()
    found = match_patterns(distinct.withColumn("key0", F.col("u0")), rule_table(pages.sparkSession, pattern_rules), "key0", "u0").withColumnRenamed("key0", "url")
    out = base.join(found, "url", "left")
    action = F.when(F.col("r").isNull(), F.col("action"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", action, F.lit("allow")).alias("verdict"), F.when(F.col("r").isNull(), F.col("pattern")).alias("pattern"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op6_sql() -> str:
    """The same verdicts in SQL, every pattern tried on every url."""
    host_of = "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    by_length = sorted(HOST_RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    case = lambda pick: "CASE " + " ".join(f"WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{pick(r)}'" for r in by_length) + " END"
    order = sorted(enumerate(PATTERN_RULES), key=lambda x: (x[1][1], x[0]))
    tries = lambda pick: "CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{pattern_regex(p)}') THEN '{pick(p, v)}'" for _, (p, v) in order) + " END"
    return f"""WITH a AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, {host_of} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {case(lambda r: r[0] + r[1])} AS rule, {case(lambda r: r[2])} AS v, {tries(lambda p, v: p)} AS p, {tries(lambda p, v: v)} AS pv FROM b)
SELECT page_id, host, path, rule, coalesce(v, pv, 'allow') AS verdict, CASE WHEN rule IS NULL THEN p END AS pattern FROM c"""
