"""Record operators: mappers, sources and their fallback, stores with versions, evidence and review rules."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.news import canonical_url

#: Stage names by run status; other statuses are TERMINATED, stage 5.
STAGES = {"P": ("COLLECTING", 1), "O": ("WRITING", 3), "F": ("DONE", 4)}
NULLS = ["", "nan", "none", "-"]


def first_present(df: DataFrame, aliases: list[str]) -> Column:
    """The first non-blank value among the alias columns that df has; blank, nan and none count as missing."""
    have = [c for c in aliases if c in df.columns]
    clean = [F.when(~F.lower(F.trim(F.col(c).cast("string"))).isin(NULLS), F.trim(F.col(c).cast("string"))) for c in have]
    return F.coalesce(*clean) if clean else F.lit(None).cast("string")


def number(text: Column, kind: str = "decimal(18,4)") -> Column:
    """A number with an optional percent sign and thousands commas; null if it is none."""
    return F.regexp_replace(text, "[%,]", "").try_cast(kind)


def map_sectors(rows: DataFrame, aliases: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """Vendor rows as sector rows: id falls back to the name, a missing change counts as 0."""
    out = rows.select(*keep, *[first_present(rows, a).alias(f) for f, a in aliases.items()])
    return out.withColumns({"sector_id": F.coalesce("sector_id", "name"), "pct_change": F.coalesce(number(F.col("pct_change")), F.lit(0).cast("decimal(18,4)"))})


def with_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """primary if it has a row, else secondary; sources are never merged."""
    return secondary if primary.isEmpty() else primary


def total_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: whether both sides have the same keys, each once: counts of missing and repeated keys."""
    a = left.groupBy(key).agg(F.count("*").alias("n"))
    b = right.groupBy(key).agg(F.count("*").alias("m"))
    j = a.join(b, key, "full_outer")
    return j.agg(
        F.count_if(F.col("n").isNull()).alias("missing_left"),
        F.count_if(F.col("m").isNull()).alias("missing_right"),
        F.count_if((F.col("n") > 1) | (F.col("m") > 1)).alias("repeated"),
    ).withColumn("ok", F.expr("missing_left + missing_right + repeated = 0"))


def stage(status: Column) -> Column:
    """struct(stage, index) of a status."""
    out = F.struct(F.lit("TERMINATED").alias("stage"), F.lit(5).alias("index"))
    for s, (name, index) in STAGES.items():
        out = F.when(status == s, F.struct(F.lit(name).alias("stage"), F.lit(index).alias("index"))).otherwise(out)
    return out


def next_versions(stored: DataFrame, new: DataFrame, keys: list[str], version: str, order: str) -> DataFrame:
    """new with versions running on from the highest stored one of its keys (from 1 without one)."""
    top = stored.groupBy(*keys).agg(F.max(version).alias("_top"))
    w = Window.partitionBy(*keys).orderBy(order)
    return new.join(top, keys, "left").withColumn(version, F.coalesce("_top", F.lit(0)) + F.row_number().over(w)).drop("_top")


def compare_and_set(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows(key, status) after changes(key, expected, new_status), and whether each applied: only where the stored status is the expected one. Null where no change was asked."""
    j = rows.join(changes, key, "left")
    hit = F.col("status") == F.col("expected")
    return j.select(key, F.when(hit, F.col("new_status")).otherwise(F.col("status")).alias("status"), hit.alias("applied"))


def replace_bridge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old bridge rows with those of the keys in new replaced by new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def ordered_children(parents: DataFrame, bridge: DataFrame, children: DataFrame, parent: str, child: str, order: list[Column], fields: list[str]) -> DataFrame:
    """A row for each bridge child that exists, with its place (from 1) among those of its parent and its fields; a parent without any has one row with place 0. No parent's children are gathered."""
    placed = bridge.join(children, child).withColumn("place", F.row_number().over(Window.partitionBy(parent).orderBy(*order)))
    return parents.join(placed.select(parent, child, "place", *fields), parent, "left").withColumn("place", F.coalesce("place", F.lit(0)))


def validate_selection(selection: DataFrame, candidates: DataFrame, run: str, key: str, least: int = 3, most: int = 12) -> DataFrame:
    """Per run: ok, why not, and MANUAL or DEFAULT: a selection has least..most distinct candidates, all offered; DEFAULT when it is exactly the best ones as offered."""
    offered = candidates.select(run, key, "rank")
    j = selection.join(offered, [run, key], "left")
    agg = j.groupBy(run).agg(F.count("*").alias("n"), F.countDistinct(key).alias("d"), F.count_if(F.col("rank").isNull()).alias("unknown"), F.max("rank").alias("last"))
    why = F.when(F.col("unknown") > 0, "UNKNOWN_CANDIDATE").when(F.col("n") != F.col("d"), "REPEATED").when(~F.col("n").between(least, most), "COUNT")
    return agg.select(run, "n", why.isNull().alias("ok"), F.coalesce(why, F.lit("")).alias("why"), F.when(why.isNull(), F.when(F.col("last") == F.col("n"), "DEFAULT").otherwise("MANUAL")).otherwise("").alias("mode"))


def claim_number_issues(claims: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Claims whose numbers are not all among the cited facts: (key, claim_id, wrong)."""
    from tidemark.functions.text import numbers

    known = facts.groupBy(key).agg(F.collect_set(F.col("value").cast("decimal(38,10)")).alias("known"))
    j = claims.join(known, key, "left").withColumn("wrong", F.array_except(numbers(F.col("text")), F.coalesce("known", F.array().cast("array<decimal(38,10)>"))))
    return j.filter(F.size("wrong") > 0).select(key, "claim_id", F.array_join(F.transform("wrong", lambda x: x.cast("double").cast("string")), ",").alias("wrong"))


def draft_issues(sections: DataFrame) -> DataFrame:
    """Issues of drafts, sections(draft_id, ordinal, sector_id, heading, body, subject): repeated sector, subject missing from the heading or from the first sentence, workflow markers left in the text."""
    n = F.count("*").over(Window.partitionBy("draft_id", "sector_id"))
    first = F.regexp_extract("body", r"^([^.。！？!?]*)", 1)
    tests = [
        (F.col("n") > 1, "DUPLICATE_SECTOR"),
        (~F.contains(F.lower("heading"), F.lower("subject")), "SUBJECT_NOT_IN_HEADING"),
        (~F.contains(F.lower(first), F.lower("subject")), "SUBJECT_NOT_IN_FIRST_SENTENCE"),
        (F.col("body").rlike(r"(?i)\b(todo|tbd|\[\[|draft only)\b"), "WORKFLOW_MARKER"),
    ]
    issues = F.array_compact(F.array(*[F.when(t, name) for t, name in tests]))
    return sections.withColumn("n", n).select("draft_id", "ordinal", F.explode(issues).alias("issue"))


def evidence_issues(claims: DataFrame, accepted: DataFrame) -> DataFrame:
    """Blocking issues of claims that cite internal evidence (claim_id, evidence_id) against accepted(evidence_id, active, conflict, verified)."""
    j = claims.join(accepted, "evidence_id", "left")
    agg = j.groupBy("claim_id").agg(
        F.bool_or(~F.coalesce("active", F.lit(False))).alias("inactive"),
        F.bool_or(F.coalesce("conflict", F.lit(False))).alias("conflict"),
        F.every(~F.coalesce("verified", F.lit(False))).alias("unverified"),
    )
    issues = F.array_compact(F.array(F.when(F.col("inactive"), "INACTIVE_SOURCE"), F.when(F.col("conflict"), "UNRESOLVED_CONFLICT"), F.when(F.col("unverified"), "ONLY_UNVERIFIED")))
    return agg.select("claim_id", F.explode(issues).alias("issue"))


def weakest_origin(parts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Per key the most suspect origin (the later in order), the least confidence, and whether any part needs verification. parts(key, origin, confidence, requires_verification)."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("origin"))
    return parts.groupBy(key).agg(F.max_by("origin", rank).alias("origin"), F.min("confidence").alias("confidence"), F.bool_or("requires_verification").alias("requires_verification"))


def metric_totals(samples: DataFrame) -> DataFrame:
    """Sum, count and mean per metric name and label set, samples(name, labels: map, value)."""
    labels = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))
    return samples.groupBy("name", labels.alias("labels")).agg(F.sum("value").alias("total"), F.count("*").alias("n")).withColumn("mean", F.col("total") / F.col("n"))


def labels_match(labels: Column, asked: dict[str, str]) -> Column:
    """Whether a label map holds all the labels asked for."""
    out = F.lit(True)
    for k, v in asked.items():
        out = out & F.coalesce(F.element_at(labels, k) == v, F.lit(False))
    return out


def apply_patches(sections: DataFrame, patches: DataFrame) -> DataFrame:
    """sections(section_id, body) with the patch of the highest number whose expected hash is that of the stored body; other patches are refused."""
    good = sections.join(patches, "section_id").filter(F.sha2("body", 256) == F.col("expected_hash"))
    best = good.groupBy("section_id").agg(F.max_by("new_body", "patch_no").alias("new_body"))
    return sections.join(best, "section_id", "left").select("section_id", F.coalesce("new_body", "body").alias("body"), F.col("new_body").isNotNull().alias("patched"))


def purge(documents: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, audit rows of those purged): deleted rows go once their date has come."""
    due = F.col("deleted") & (F.col("purge_after") <= F.lit(now).cast("timestamp_ntz"))
    gone = F.coalesce(due, F.lit(False))
    return documents.filter(~gone), documents.filter(gone).select("document_id", F.lit("PURGED").alias("event"))


def idempotent_uploads(stored: DataFrame, uploads: DataFrame) -> DataFrame:
    """uploads(upload_key, content_hash) with outcome: EXISTING for a stored key with the same hash, CONFLICT with another, NEW else."""
    j = uploads.join(stored.select("upload_key", F.col("content_hash").alias("_h")), "upload_key", "left")
    return j.withColumn("outcome", F.when(F.col("_h").isNull(), "NEW").when(F.col("_h") == F.col("content_hash"), "EXISTING").otherwise("CONFLICT")).drop("_h")


def cache_key(*parts: Column) -> Column:
    """A digest of the parts of a retrieval: equal keys mean equal answers."""
    return F.concat(F.lit("rk_"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32))


#: The parts of a key, in its sorted order.
KEY_PARTS = ["conflict_policy_version", "corpus_generation", "embedding_model_version", "filters", "nli_model_version", "query_fingerprint", "reranker_model_version"]


def corpus_generation(entries: DataFrame, column: str) -> DataFrame:
    """One row: generation, a digest of the set of entries (texts), equal whatever their order.

    The eight words of each entry's sha256 are summed and the sums hashed, so tasks combine their part before
    anything moves and no list of entries exists. Null entries count as empty; an empty table has a generation too.
    """
    digest = F.sha2(F.coalesce(column, F.lit("")), 256)
    sums = [F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")).alias(f"w{i}") for i in range(8)]
    text = F.concat_ws("-", *[F.coalesce(F.col(f"w{i}"), F.lit(0)).cast("string") for i in range(8)])
    return entries.agg(*sums).select(F.concat(F.lit("corpus_"), F.substring(F.sha2(text, 256), 1, 24)).alias("generation"))


def policy_version(**settings: float) -> str:
    """The version of the settings that conflict decisions read."""
    return "cp_" + sha256("|".join(f"{k}={v}" for k, v in settings.items()).encode()).hexdigest()[:12]


def seven_part_key(**parts: Column) -> tuple[Column, Column]:
    """(key, missing): a digest of the canonical JSON of all seven parts, and the first model version that is null or empty.

    Where one is missing there is no key: leaving it out would mix answers of two models.
    """
    if sorted(parts) != KEY_PARTS:
        raise ValueError(f"a key takes {', '.join(KEY_PARTS)}")
    empty = F.coalesce(*[F.when(F.coalesce(parts[p], F.lit("")) == "", p) for p in ("embedding_model_version", "reranker_model_version", "nli_model_version")])
    text = F.to_json(F.struct(*[parts[p].alias(p) for p in KEY_PARTS]), {"ignoreNullFields": "false"})
    return F.when(empty.isNull(), F.concat(F.lit("rk_"), F.substring(F.sha2(text, 256), 1, 32))), empty


def expand_query(text: Column, synonyms: Column, most: int = 3) -> Column:
    """A query with up to most synonyms of each of its words appended, once each; synonyms: map of word to array."""
    words = F.split(F.lower(text), r"\s+")
    more = F.flatten(F.transform(words, lambda w: F.slice(F.coalesce(F.element_at(synonyms, w), F.array().cast("array<string>")), 1, most)))
    return F.concat_ws(" ", text, F.array_join(F.array_except(F.array_distinct(more), words), " "))


def join_wrapped(lines: Column) -> Column:
    """Lines of a paragraph as one text: no space between two CJK characters, else one."""
    from tidemark.functions.text import CJK

    def step(a: Column, b: Column) -> Column:
        tight = F.regexp_like(F.right(a, F.lit(1)), F.lit(CJK)) & F.regexp_like(F.left(b, F.lit(1)), F.lit(CJK))
        return F.when(a == "", b).when(tight, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))

    return F.aggregate(F.filter(lines, lambda x: x != ""), F.lit(""), step)


FEED_SCHEMA = "guid string, title string, link string, pubDate string, description string, malformed string"


def rss_items(spark: SparkSession, path: str, row_tag: str = "item", stream: bool = False) -> DataFrame:
    """Items of RSS files, as a table or a stream, schema fixed; an item that is no XML has its text in malformed and nulls elsewhere.

    Files are cut at the item's end tag and each item is parsed by itself, so a broken one loses none behind it
    (the XML reader gives up the rest of its split) and large files are split over tasks.
    """
    reader = spark.readStream if stream else spark.read
    cut = reader.format("text").option("lineSep", f"</{row_tag}>").load(path)
    opened = cut.select(F.regexp_extract("value", rf"(?s)<{row_tag}(?:\s[^>]*)?>(.*)$", 1).alias("inner"), F.col("value").rlike(rf"(?s)<{row_tag}[\s>]").alias("is_item")).filter("is_item")
    item = F.from_xml(F.concat(F.lit("<item>"), F.col("inner"), F.lit("</item>")), FEED_SCHEMA, {"columnNameOfCorruptRecord": "malformed", "mode": "PERMISSIVE"})
    return opened.select(item.alias("item")).select("item.*")


def feed_items(items: DataFrame) -> DataFrame:
    """Items (rss_items) as item_id, title, link (canonical), published_us, content_hash and problem.

    item_id is the guid, else the link, else the content hash. Problems, first match: MALFORMED (no XML), NO_LINK,
    BAD_DATE (a date that cannot be read or states no zone); null for a good item. No date at all is none.
    Rows with a problem are kept, so callers count them.
    """
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    title, link, date = F.coalesce(F.trim("title"), F.lit("")), blank(F.col("link")), blank(F.col("pubDate"))
    digest = F.sha2(F.concat(title, F.lit("\n"), F.coalesce(link, F.lit(""))), 256)
    plain = F.regexp_replace(F.regexp_replace(date, r"^[A-Za-z]{3},\s*", ""), r"\s*(GMT|UTC|Z)$", " +0000")
    moment = F.when(plain.rlike(r"[+-]\d{4}$"), F.unix_micros(F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z"))))
    problem = F.when(F.col("malformed").isNotNull(), "MALFORMED").when(link.isNull(), "NO_LINK").when(date.isNotNull() & moment.isNull(), "BAD_DATE")
    return items.select(F.coalesce(blank(F.col("guid")), link, digest).alias("item_id"), title.alias("title"), canonical_url(link).alias("link"), moment.alias("published_us"), digest.alias("content_hash"), problem.alias("problem"))
