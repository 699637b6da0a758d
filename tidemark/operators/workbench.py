"""Workbench rules: search and sort, news records by query, comparison guards, cards, lifecycles, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import coverage

#: Which status may follow which; anything else is rejected.
TRANSITIONS = {"PENDING": ["RUNNING", "CANCELLED"], "RUNNING": ["SUCCEEDED", "FAILED", "RETRY_WAITING", "CANCELLED"], "RETRY_WAITING": ["RUNNING", "CANCELLED"]}
#: Words that turn a statement around (fixed values).
NEGATIONS = ["not", "no", "nicht", "kein", "ne", "pas"]
NEGATIONS_CJK = ["不", "未", "无", "没有"]
VISION_LEAST = 0.6


def contains_needle(needle: str, *columns: str) -> Column:
    """Whether any of the columns holds needle, case aside; a blank needle holds everywhere, a null column nothing."""
    want = needle.strip().lower()
    if not want:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(want), F.lit(False))
    return hit


def missing_last(value: str, descending: bool, *ties: str) -> list[Column]:
    """An order by value in either direction with missing values last in both, ties ascending."""
    return [F.desc_nulls_last(value) if descending else F.asc_nulls_last(value), *[F.asc(t) for t in ties]]


def news_records(links: DataFrame, queries: DataFrame, documents: DataFrame, source: str | None = None, status: str | None = None) -> DataFrame:
    """Documents found by queries, with the number of their queries, and source and status of the first to arrive.

    links(query_id, document_id, arrival), queries(query_id, source, status), documents(document_id,
    published_at, collected_at). A document stays if any of its queries has the source, and any the
    status, asked for. at is the time to sort by: published, else collected.
    """
    known = links.join(queries, "query_id")
    wanted = F.lit(True)
    if source is not None:
        wanted = wanted & F.bool_or(F.col("source") == source)
    if status is not None:
        wanted = wanted & F.bool_or(F.col("status") == status)
    first = F.min_by(F.struct("source", "status"), F.struct("arrival", "query_id"))
    found = known.groupBy("document_id").agg(F.count("*").alias("queries"), first.alias("first"), wanted.alias("wanted")).filter("wanted")
    out = found.join(documents, "document_id")
    return out.select("document_id", "queries", F.col("first.source").alias("primary_source"), F.col("first.status").alias("primary_status"), F.coalesce("published_at", "collected_at").alias("at"))


def pair_guard(pairs: DataFrame) -> DataFrame:
    """pairs of runs (base_id, compare_id, and base_ and compare_ provider, mode, status) with guard: why they cannot be compared, the first reason that holds, or OK. Null statuses mean that the run is not there."""
    ended = lambda s: s.isin("READY", "DEGRADED", "FAILED", "CANCELLED")
    c = F.col
    apart = ~c("base_provider").eqNullSafe(c("compare_provider")) | ~c("base_mode").eqNullSafe(c("compare_mode"))
    guard = (
        F.when(c("base_id") == c("compare_id"), "SAME_RUN")
        .when(c("base_status").isNull() | c("compare_status").isNull(), "NOT_FOUND")
        .when(~ended(c("base_status")) | ~ended(c("compare_status")), "NOT_FINISHED")
        .when(apart, "DIFFERENT_SOURCE")
        .otherwise("OK")
    )
    return pairs.withColumn("guard", guard)


def run_warnings(pairs: DataFrame) -> DataFrame:
    """pairs with warnings (array of codes, in a fixed order): partial runs, missing cutoffs, other windows or limits, reversed time. Columns base_ and compare_ status, cutoff, window, limit."""
    c = F.col
    rules = [
        ("RUN_PARTIAL", (c("base_status") != "READY") | (c("compare_status") != "READY")),
        ("CUTOFF_MISSING", c("base_cutoff").isNull() | c("compare_cutoff").isNull()),
        ("NEWS_WINDOW_DIFF", ~c("base_window").eqNullSafe(c("compare_window"))),
        ("CANDIDATE_LIMIT_DIFF", ~c("base_limit").eqNullSafe(c("compare_limit"))),
        ("REVERSED_TIME", c("compare_cutoff") < c("base_cutoff")),
    ]
    codes = F.array(*[F.when(F.coalesce(when, F.lit(False)), code) for code, when in rules])
    return pairs.withColumn("warnings", F.filter(codes, lambda x: x.isNotNull()))


def kind_status(base: DataFrame, compare: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per kind of kinds(kind): UNAVAILABLE without a snapshot on a side, INCOMPATIBLE where provider or classification differ or are blank, else COMPARABLE; and warnings.

    base and compare: (kind, provider_id, classification_version, source_version, n_fields).
    """
    names = ["provider_id", "classification_version", "source_version", "n_fields"]
    side = lambda df, p: df.select("kind", *[F.col(n).alias(f"{p}_{n}") for n in names], F.lit(True).alias(f"{p}_there"))
    j = kinds.select("kind").distinct().join(side(base, "b"), "kind", "left").join(side(compare, "c"), "kind", "left")
    c = F.col
    missing = c("b_there").isNull() | c("c_there").isNull()
    same = lambda n: (F.trim(c(f"b_{n}")) != "") & (c(f"b_{n}") == c(f"c_{n}"))
    fits = F.coalesce(same("provider_id") & same("classification_version"), F.lit(False))
    status = F.when(missing, "UNAVAILABLE").when(~fits, "INCOMPATIBLE").otherwise("COMPARABLE")
    good = ~missing & fits
    codes = F.array(
        F.when(missing, "SNAPSHOT_MISSING"),
        F.when(~missing & ~fits, "CLASSIFICATION_MISMATCH"),
        F.when(good & ~c("b_source_version").eqNullSafe(c("c_source_version")), "SOURCE_VERSION_DIFF"),
        F.when(good & (F.coalesce("b_n_fields", F.lit(0)) == 0), "FIELD_SCHEMA_UNKNOWN:BASE"),
        F.when(good & (F.coalesce("c_n_fields", F.lit(0)) == 0), "FIELD_SCHEMA_UNKNOWN:COMPARE"),
    )
    return j.select("kind", status.alias("status"), F.filter(codes, lambda x: x.isNotNull()).alias("warnings"))


def membership_counts(base: DataFrame, compare: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row: candidates (kind, sector_id) of comparable kinds on both sides, on one, and kinds that cannot be compared."""
    good = statuses.filter("status = 'COMPARABLE'").select("kind")
    side = lambda df, name: df.select("kind", "sector_id").distinct().join(good, "kind", "left_semi").withColumn(name, F.lit(True))
    j = side(base, "b").join(side(compare, "c"), ["kind", "sector_id"], "full_outer")
    counts = j.agg(F.count_if(F.col("b") & F.col("c")).alias("both"), F.count_if(F.col("c").isNull()).alias("only_base"), F.count_if(F.col("b").isNull()).alias("only_compare"))
    rest = statuses.agg(F.count_if(F.col("status") != "COMPARABLE").alias("unavailable_kinds"))
    return counts.crossJoin(rest)  # one row each


def evidence_links(base: DataFrame, compare: DataFrame, keys: DataFrame) -> DataFrame:
    """Links (kind, sector_id, event_id, relation) of two runs side by side, for the candidate keys (kind, sector_id) only."""
    by = ["kind", "sector_id", "event_id"]
    side = lambda df, name: df.join(keys.select("kind", "sector_id").distinct(), ["kind", "sector_id"], "left_semi").select(*by, F.col("relation").alias(name))
    j = side(base, "base_relation").join(side(compare, "compare_relation"), by, "full_outer")
    b, c = F.col("base_relation").isNotNull(), F.col("compare_relation").isNotNull()
    return j.withColumn("membership", F.when(b & c, "BOTH").when(b, "ONLY_BASE").otherwise("ONLY_COMPARE"))


def inverted(members: DataFrame, key: str, member: str) -> DataFrame:
    """(member, keys): members(key, member) the other way round, each key once, in order. For dimensions, where a member has few keys."""
    return members.select(key, member).distinct().groupBy(member).agg(F.array_sort(F.collect_list(key)).alias("keys"))


def pinned(candidates: DataFrame, batch: DataFrame, keys: list[str], detail: str) -> DataFrame:
    """candidates with the one row of batch of the same keys: pinned (OK, MISSING or AMBIGUOUS) and detail (null unless OK)."""
    per = batch.groupBy(*keys).agg(F.count("*").alias("n"), F.min(detail).alias(detail))
    j = candidates.join(per, keys, "left")
    state = F.when(F.col("n").isNull(), "MISSING").when(F.col("n") > 1, "AMBIGUOUS").otherwise("OK")
    return j.withColumn("pinned", state).withColumn(detail, F.when(F.col("pinned") == "OK", F.col(detail))).drop("n")


def card_issues(cards: DataFrame) -> DataFrame:
    """cards (evidence, eligible, background, allowed_background, level, max_level) with issues: what a card claims beyond what it may."""
    extra = lambda a, b: F.size(F.array_except(F.coalesce(a, F.array().cast("array<long>")), F.coalesce(b, F.array().cast("array<long>")))) > 0
    codes = F.array(
        F.when(extra(F.col("evidence"), F.col("eligible")), "EVIDENCE_NOT_ELIGIBLE"),
        F.when(extra(F.col("background"), F.col("allowed_background")), "BACKGROUND_NOT_ALLOWED"),
        F.when(F.col("level") > F.col("max_level"), "LEVEL_TOO_HIGH"),
    )
    return cards.withColumn("issues", F.filter(codes, lambda x: x.isNotNull()))


def ungoverned_sections(sections: DataFrame, draft_sources: DataFrame) -> DataFrame:
    """Sections (draft_id, section_id) without a source, or with one that the draft does not list: why. sections(draft_id, section_id, source_id; null: none)."""
    listed = draft_sources.select("draft_id", "source_id").distinct().withColumn("ok", F.lit(True))
    j = sections.join(listed, ["draft_id", "source_id"], "left")
    per = j.groupBy("draft_id", "section_id").agg(F.count("source_id").alias("n"), F.count_if(F.col("source_id").isNotNull() & F.col("ok").isNull()).alias("unknown"))
    return per.filter("n = 0 or unknown > 0").select("draft_id", "section_id", F.when(F.col("n") == 0, "NO_SOURCE").otherwise("UNKNOWN_SOURCE").alias("issue"))


def text_relation(left: Column, right: Column, overlap: Column) -> Column:
    """struct(relation, confidence) of two statements: a negation on one side only contradicts, enough overlap entails, else it is uncertain."""

    def negated(t: Column) -> Column:
        hit = F.arrays_overlap(F.split(F.lower(t), r"[^\p{L}]+"), F.array(*map(F.lit, NEGATIONS)))
        for word in NEGATIONS_CJK:
            hit = hit | t.contains(word)
        return hit

    kind = F.when(negated(left) != negated(right), "CONTRADICTION").when(overlap >= 0.5, "ENTAILMENT").otherwise("UNCERTAIN")
    sure = F.when(kind == "CONTRADICTION", F.least(F.lit(0.99), 1 - overlap / 2)).when(kind == "ENTAILMENT", F.least(F.lit(0.99), 0.5 + overlap / 2)).otherwise(overlap / 2)
    return F.struct(kind.alias("relation"), sure.alias("confidence"))


def text_verdicts(statements: DataFrame, group: list[str]) -> DataFrame:
    """text_l, text_r, relation, confidence: each ordered pair of different texts of a group once, however many statements say them or groups hold them.

    Bigrams are compared for these pairs only, so the cost follows the texts, not the pairs of statements. Null texts have no verdict;
    a text beside itself is included, as two versions may say the same.
    """
    texts = statements.filter("text is not null").select(*group, "text").distinct()
    side = lambda s: texts.select(*group, F.col("text").alias(f"text_{s}"))
    pairs = side("l").join(side("r"), group).select("text_l", "text_r").distinct()
    verdict = text_relation(F.col("text_l"), F.col("text_r"), F.col("overlap"))
    judged = pairs.withColumn("overlap", coverage(F.col("text_l"), F.col("text_r"))).withColumn("verdict", verdict)
    return judged.select("text_l", "text_r", "verdict.relation", "verdict.confidence")


def vision_usable(confidence: Column, values: Column, series: Column) -> Column:
    """Whether a figure read by a vision model may be used: sure enough, every value holds a digit, and values come with a series."""
    digits = F.forall(values, lambda v: F.coalesce(v.rlike("[0-9]"), F.lit(False)))
    return F.coalesce((confidence >= VISION_LEAST) & digits & ((F.size(values) == 0) | (F.size(series) > 0)), F.lit(False))


def replace_once(text: Column, pattern: str, into: str) -> Column:
    """text with the first match of pattern replaced."""
    return F.regexp_replace(text, rf"(?s)\A(.*?)(?:{pattern})", "$1" + into)


def day_bounds(at: Column) -> tuple[Column, Column]:
    """Epoch seconds of the first and last second of a time's day (UTC)."""
    start = F.unix_seconds(F.date_trunc("day", at.cast("timestamp")))
    return start, start + 86399


def paragraph_spans(text: Column) -> Column:
    """Paragraphs between blank lines as array of struct(ordinal, start, end): half-open character ranges without the white space around them."""
    lines = F.split(text, "\n")
    item = "struct<start:int,end:int>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("open"), F.array().cast(f"array<{item}>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, r"^\s+", "")
        start = acc["at"] + F.length(line) - F.length(bare)
        end = start + F.length(F.regexp_replace(bare, r"\s+$", ""))
        blank = bare == ""
        last = F.try_element_at(acc["out"], F.lit(-1))
        longer = F.array_append(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.struct(last["start"].alias("start"), end.alias("end")))
        out = F.when(blank, acc["out"]).when(acc["open"], longer).otherwise(F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"))))
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), (~blank).alias("open"), out.alias("out"))

    return F.transform(F.aggregate(lines, zero, step)["out"], lambda x, i: F.struct((i + 1).alias("ordinal"), x["start"].alias("start"), x["end"].alias("end")))


def stage_records(stored: DataFrame, incoming: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """incoming with outcome: STAGED (new), UNCHANGED (stored with the same content) or CONFLICT (with other content), so staging again is harmless."""
    j = incoming.join(stored.select(*keys, F.col(digest).alias("held")).distinct(), keys, "left")
    outcome = F.when(F.col("held").isNull(), "STAGED").when(F.col("held") == F.col(digest), "UNCHANGED").otherwise("CONFLICT")
    return j.withColumn("outcome", outcome).drop("held")


def published(staged: DataFrame, generation: str, expected: DataFrame) -> DataFrame:
    """Per generation of staged(generation, outcome): records that would be visible, and state: REJECTED with any conflict, INCOMPLETE where expected(generation, records) says otherwise, else PUBLISHED."""
    per = staged.groupBy(generation).agg(F.count_if(F.col("outcome") != "CONFLICT").alias("visible"), F.count_if(F.col("outcome") == "CONFLICT").alias("conflicts"))
    j = per.join(expected, generation, "left")
    state = F.when(F.col("conflicts") > 0, "REJECTED").when(~F.col("visible").eqNullSafe(F.col("records")), "INCOMPLETE").otherwise("PUBLISHED")
    return j.select(generation, "visible", "conflicts", state.alias("state"))


def expected_append(versions: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """requests(key, request_id, expected) with outcome: of a key's requests that expect its highest stored version the first is APPENDED with the next version, later ones and wrong expectations are STALE. versions(key, version)."""
    top = versions.groupBy(key).agg(F.max("version").alias("top"))
    j = requests.join(top, key, "left").withColumn("top", F.coalesce("top", F.lit(0)))
    hit = F.col("expected") == F.col("top")
    first = F.row_number().over(Window.partitionBy(key, hit).orderBy("request_id")) == 1
    good = F.coalesce(hit & first, F.lit(False))
    return j.withColumns({"outcome": F.when(good, "APPENDED").otherwise("STALE"), "version": F.when(good, F.col("top") + 1)}).drop("top")


def transitioned(tasks: DataFrame) -> DataFrame:
    """tasks(status, wanted) with allowed, and status moved where it is; ended and unknown statuses move nowhere."""
    may = F.lit(False)
    for old, new in TRANSITIONS.items():
        may = may | ((F.col("status") == old) & F.col("wanted").isin(new))
    may = F.coalesce(may, F.lit(False))
    return tasks.withColumns({"allowed": may, "status": F.when(may, F.col("wanted")).otherwise(F.col("status"))})


def failure_class(kind: Column, retriable: Column) -> Column:
    """PERMANENT for parse errors, by its flag for a provider's, RETRYABLE for anything else."""
    return F.when(kind == "PARSE", "PERMANENT").when((kind == "PROVIDER") & ~F.coalesce(retriable, F.lit(False)), "PERMANENT").otherwise("RETRYABLE")
