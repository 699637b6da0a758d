"""News operators: as-of classes, urls, dedup clusters, sector links, gates, metrics, query plans."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.titles import leaders

EVIDENCE, BACKGROUND, EXCLUDED = "EVIDENCE", "BACKGROUND", "EXCLUDED"
#: Statuses a source can report; a pivot lists them all.
STATUSES = ["SUCCESS", "EMPTY", "PARTIAL", "STALE", "UNAVAILABLE", "FAILED"]
#: Attribution levels, weakest first.
LEVELS = ["NO_RELIABLE_EXPLANATION", "MARKET_ASSOCIATION", "POSSIBLE_CATALYST", "EXPLICIT_DRIVER"]


def use_at(published_us: Column, observed_us: Column, cutoff_us: Column) -> Column:
    """Late observation excludes; then no publication time is background; then late publication excludes. Equality with the cutoff is in time."""
    return (
        F.when(observed_us > cutoff_us, EXCLUDED).when(published_us.isNull(), BACKGROUND).when(published_us > cutoff_us, EXCLUDED).otherwise(EVIDENCE)
    )


def normalized_title(title: Column) -> Column:
    """Lower-cased letters, digits and underscores of every script."""
    return F.lower(F.regexp_replace(title, r"[^\p{L}\p{N}_]", ""))


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, fragment dropped."""
    head = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    rest = F.substring(url, F.length(head) + 1, F.length(url))
    return F.concat(F.lower(head), F.regexp_replace(rest, "#.*$", ""))


def allowed_url(url: Column, hosts: list[str]) -> Column:
    """https, a host of the list, no port but 443, no user."""
    authority = F.regexp_extract(url, r"^https://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, ":443$", ""))
    return F.coalesce(host.isin(hosts) & ~authority.contains("@"), F.lit(False))


def safe_url(url: Column) -> Column:
    """The url if it is http or https with a host, else null."""
    return F.when(url.rlike(r"(?i)^https?://[^/?#\s]+"), url)


def content_kind(summary: Column, source: Column, flash_source: str) -> Column:
    has = F.length(F.trim(F.coalesce(summary, F.lit("")))) > 0
    return F.when(has & (source == flash_source), "FLASH").when(has, "SUMMARY").otherwise("LINK_ONLY")


def event_ids(clusters: DataFrame, content_hash: str, size: str) -> DataFrame:
    """clusters with event_id: made of the content hashes of all members, here size times the same one. Hashed piece by piece, so a large cluster needs no long string."""

    @F.pandas_udf("string")
    def named(h: pd.Series, n: pd.Series) -> pd.Series:
        def one(value: str, times: int) -> str:
            digest, piece = hashlib.sha256(value.encode()), f"|{value}".encode()
            block = piece * min(times - 1, 1000)
            for _ in range((times - 1) // 1000):
                digest.update(block)
            digest.update(piece * ((times - 1) % 1000))
            return "event-" + digest.hexdigest()[:24]

        return pd.Series([one(v, int(t)) for v, t in zip(h, n, strict=True)], dtype=object)

    return clusters.withColumn("event_id", named(F.col(content_hash), F.col(size)))


def exact_clusters(docs: DataFrame) -> DataFrame:
    """Clusters of equal content, one row each: content_hash, event_id, size, and title and time of the first by publication (null last), then id."""
    order = F.struct(F.col("published_us").isNull().alias("late"), "published_us", "doc_id", "title")
    g = docs.groupBy("content_hash").agg(F.min(order).alias("m"), F.count("*").alias("size"))
    return event_ids(g, "content_hash", "size").select("content_hash", "event_id", F.col("m.title").alias("title"), F.col("m.published_us").alias("first_us"), F.col("m.doc_id").alias("first_id"), "size")


def cluster_members(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Every document with its cluster: a row a member, so no cluster is gathered; leads marks the first one."""
    return docs.select("doc_id", "published_us", "content_hash").join(clusters, "content_hash").withColumn("leads", F.col("doc_id") == F.col("first_id"))


def similar_title_clusters(docs: DataFrame, block: list[str], ratio: float = 0.8) -> DataFrame:
    """(doc_id, leader) by greedy clustering in doc_id order among documents of equal block columns (of
    all documents where block is empty): a document joins the first cluster whose first document has the
    same hash or a title of at least ratio similarity.

    Documents of equal hash and title share their fate, so each such pair is decided once.
    """
    part = F.to_json(F.struct(*block)) if block else F.lit("")
    shaped = docs.select(part.alias("part"), "doc_id", "content_hash", F.coalesce(normalized_title(F.col("title")), F.lit("")).alias("norm"))
    key = ["part", "content_hash", "norm"]
    led = leaders(shaped.groupBy(*key).agg(F.min("doc_id").alias("first")), ratio)
    return shaped.join(led.drop("first"), key).select("doc_id", "leader")


#: Terms of a block that every text is searched for in one row.
TERMS = 1000


def sector_links(events: DataFrame, entities: DataFrame) -> DataFrame:
    """The strongest link of each event and sector: event_id, sector_id, confidence 3 to 1, reason.

    events(event_id, text); entities(sector_id, term, confidence, ordinal, reason) is the entity
    dictionary, a small dimension. A term links wherever the text contains it, inside longer words and
    unspaced runs too; case does not count. Texts meet the distinct terms in blocks of about TERMS, so the
    cost is a pass over the text per block and only found terms leave it. Null and empty terms link with nothing; null texts
    have no links. Ties keep the entity with the smaller ordinal.
    """
    lower = events.select("event_id", F.lower("text").alias("text")).filter("text is not null")
    known = entities.withColumn("term", F.lower("term")).filter("term <> ''")
    per_term = known.groupBy("term", "sector_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "ordinal", "reason")).alias("b"))
    distinct = known.select("term").distinct()
    blocks = max(1, -(-distinct.count() // TERMS))
    packed = distinct.groupBy(F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block")).agg(F.collect_list("term").alias("terms"))
    met = lower.join(F.broadcast(packed) if blocks <= 100 else packed)
    found = met.select("event_id", F.explode(F.filter("terms", lambda t: F.col("text").contains(t))).alias("term"))
    best = found.join(per_term, "term").groupBy("event_id", "sector_id").agg(F.min("b").alias("b"))
    return best.select("event_id", "sector_id", (-F.col("b.c")).alias("confidence"), F.col("b.reason").alias("reason"))


def tri_partition(docs: DataFrame, event: str) -> DataFrame:
    """Per event of docs(event, use): EXCLUDED if any document is, else EVIDENCE if any is, else BACKGROUND."""
    out = docs.groupBy(event).agg(F.bool_or(F.col("use") == EXCLUDED).alias("x"), F.bool_or(F.col("use") == EVIDENCE).alias("e"))
    return out.select(event, F.when(F.col("x"), EXCLUDED).when(F.col("e"), EVIDENCE).otherwise(BACKGROUND).alias("use"))


def attribution_gate(docs: DataFrame, keys: list[str], facts: DataFrame) -> DataFrame:
    """The strongest attribution each subject may claim, and why it is no stronger.

    docs(keys, published_us, source_grade, citation_url, eligible); facts(keys, move_us,
    breadth_ratio, broad_market). The level starts at the top and rules in a fixed order only lower it.
    """
    dated = F.col("eligible") & F.col("published_us").isNotNull()
    joined = facts.join(docs, keys, "left")
    agg = joined.groupBy(*keys, "breadth_ratio", "broad_market").agg(
        F.coalesce(F.bool_or("eligible"), F.lit(False)).alias("any"),
        F.coalesce(F.bool_or(F.col("eligible").isNotNull() & F.col("published_us").isNull()), F.lit(False)).alias("undated"),
        F.coalesce(F.bool_or(dated & (F.col("source_grade") == "DISCOVERY_ONLY") & F.col("citation_url").isNull()), F.lit(False)).alias("thin"),
        F.coalesce(F.bool_or(dated & (F.col("published_us") > F.col("move_us"))), F.lit(False)).alias("after"),
        F.coalesce(F.bool_or(dated & (F.col("source_grade") == "PRIMARY")), F.lit(False)).alias("primary"),
    )
    rules = [
        (~F.col("any"), 0, "NO_ELIGIBLE_EVENT"),
        (F.col("undated"), 1, "MISSING_PUBLICATION_TIME"),
        (F.col("thin"), 1, "DISCOVERY_ONLY_WITHOUT_CITATION"),
        (F.col("after"), 1, "EVENT_AFTER_MARKET_MOVE"),
        (F.coalesce(F.col("breadth_ratio") < 0.5, F.lit(False)), 2, "INSUFFICIENT_SECTOR_BREADTH"),
        (F.col("broad_market"), 2, "BROAD_MARKET_ALTERNATIVE"),
    ]
    level = F.least(F.lit(3), *[F.when(c, n) for c, n, _ in rules])
    last = (level == 3) & ~F.col("primary")
    reasons = F.array_compact(F.array(*[F.when(c, r) for c, _, r in rules], F.when(last, "NO_PRIMARY_SOURCE")))
    name = F.element_at(F.array(*map(F.lit, LEVELS)), F.when(last, 2).otherwise(level) + 1)
    return agg.select(*keys, name.alias("max_level"), reasons.alias("reasons"))


def folded_status(statuses: Column) -> Column:
    """One status of a set: none UNAVAILABLE, one itself, SUCCESS and EMPTY together SUCCESS, else PARTIAL."""
    good = F.size(F.array_except(statuses, F.array(F.lit("SUCCESS"), F.lit("EMPTY")))) == 0
    return F.when(F.size(statuses) == 0, "UNAVAILABLE").when(F.size(statuses) == 1, statuses[0]).when(good, "SUCCESS").otherwise("PARTIAL")


def source_metrics(calls: DataFrame) -> DataFrame:
    """Per source of calls(source_id, started_us, completed_us, attempts, documents, duration_ms, status, error)."""
    errors = F.collect_set("error")
    out = calls.groupBy("source_id").agg(
        F.min("started_us").alias("started_us"),
        F.max("completed_us").alias("completed_us"),
        F.sum("attempts").alias("calls"),
        F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"),
        F.sum("documents").alias("documents"),
        F.sum("duration_ms").alias("duration_ms"),
        F.collect_set("status").alias("s"),
        errors.alias("e"),
    )
    error = F.when(F.size("e") == 1, F.col("e")[0]).when(F.size("e") > 1, "MULTIPLE_SOURCE_ERRORS")
    return out.withColumn("status", folded_status(F.array_sort("s"))).withColumn("error", error).drop("s", "e")


def acquisition_pivot(calls: DataFrame) -> DataFrame:
    """Per source: calls, a count of every status (zeros included), documents, distinct errors sorted."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES]
    return calls.groupBy("source_id").agg(F.count("*").alias("calls"), *counts, F.sum("documents").alias("documents"), F.array_join(F.array_sort(F.collect_set("error")), ",").alias("errors"))


def quality_gate(uses: DataFrame, sources: DataFrame, core: list[str]) -> DataFrame:
    """One row: counts of each use, and BLOCKED (a document excluded, or all core sources down), DEGRADED (a source down) or NORMAL."""
    counted = uses.agg(*[F.count_if(F.col("use") == u).alias(u.lower()) for u in (EVIDENCE, BACKGROUND, EXCLUDED)])
    down = F.col("status").isin("FAILED", "UNAVAILABLE")
    state = sources.agg(F.count_if(down & F.col("source_id").isin(core)).alias("core_down"), F.count_if(down).alias("down"))
    both = counted.join(state)
    code = F.when(F.col("excluded") > 0, "CUTOFF_VIOLATION").when(F.col("core_down") >= len(core), "CORE_SOURCES_UNAVAILABLE")
    status = F.when(code.isNotNull(), "BLOCKED").when(F.col("down") > 0, "DEGRADED").otherwise("NORMAL")
    return both.select("evidence", "background", "excluded", status.alias("status"), code.alias("code"))


def budgeted(queries: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The best limit distinct values per keys: of equal normalised values the first by priority, then by value."""
    norm = F.lower(F.trim("value"))
    first = Window.partitionBy(*keys, norm).orderBy(F.desc("priority"), "value")
    once = queries.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    w = Window.partitionBy(*keys).orderBy(F.desc("priority"), "value")
    return once.withColumn("ordinal", F.row_number().over(w)).filter(F.col("ordinal") <= limit)


def rewrite_locators(docs: DataFrame, locator: str, order: str) -> DataFrame:
    """docs with canonical_id: the first id (by order) that has the same non-null locator; rows without one keep their own."""
    heads = docs.filter(F.col(locator).isNotNull()).groupBy(locator).agg(F.min(order).alias("_head"))
    return docs.join(heads, locator, "left").withColumn("canonical_id", F.coalesce("_head", order)).drop("_head")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in: a new row replaces the old ones of its key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with those rows of new whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))
