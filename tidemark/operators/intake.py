"""Intake operators: constituents, scan outcomes, disclosures, stored locators, assets, query plans by level, evidence packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.claims import comparable_groups
from tidemark.operators.documents import folded_entity

#: Priorities of a plan's queries: everything, names, other names, ids, codes of members.
GLOBAL, NAME, ALIAS, IDENTIFIER, CODE = 100, 90, 80, 70, 60


def _filled(names: list[str]) -> Column:
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in names])


def constituents(rows: DataFrame, keep: list[str], codes: list[str], names: list[str]) -> DataFrame:
    """Members of sectors: code and name are the first filled of their columns; a row without either goes."""
    return rows.select(*keep, _filled(codes).alias("code"), _filled(names).alias("name")).dropna(subset=["code", "name"])


def scan_outcomes(rows: DataFrame, scan: str) -> DataFrame:
    """Per scan of rows(scan, failed, use): documents kept (EXCLUDED ones are dropped), rows that failed to map, and status.

    FAILED without documents but with errors, EMPTY without either, PARTIAL with both, else SUCCESS.
    """
    kept = ~F.col("failed") & (F.col("use") != "EXCLUDED")
    counts = rows.groupBy(scan).agg(F.count_if(kept).alias("documents"), F.count_if("failed").alias("errors"))
    none, some = F.col("documents") == 0, F.col("errors") > 0
    return counts.withColumn("status", F.when(none & some, "FAILED").when(none, "EMPTY").when(some, "PARTIAL").otherwise("SUCCESS"))


def disclosures(docs: DataFrame, codes: DataFrame, start: str, cutoff: str, zone: str = "Asia/Shanghai") -> DataFrame:
    """docs(code, at in UTC without zone) of the codes asked, from the local day of start through that of cutoff (both in UTC)."""
    day = lambda t: F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), t))
    bounds = [day(F.lit(t).cast("timestamp_ntz")) for t in (start, cutoff)]
    return docs.filter(day(F.col("at")).between(*bounds)).join(codes.select("code"), "code", "left_semi")


def stored_locators(new: DataFrame, stored: DataFrame, locator: str, key: str) -> DataFrame:
    """new with canonical_id: the id stored under its locator, else the first new one's; rows without a locator keep their own."""
    held = stored.groupBy(locator).agg(F.min(key).alias("_held"))
    first = new.groupBy(locator).agg(F.min(key).alias("_first"))
    heads = first.join(held, locator, "left").filter(F.col(locator).isNotNull()).select(locator, F.coalesce("_held", "_first").alias("_head"))
    return new.join(heads, locator, "left").withColumn("canonical_id", F.coalesce("_head", key)).drop("_head")


def rewritten_bridge(bridge: DataFrame, canonical: DataFrame) -> DataFrame:
    """bridge(event_id, document_id) with each id that canonical(document_id, canonical_id) knows replaced, pairs once each."""
    j = bridge.join(canonical, "document_id", "left")
    return j.select("event_id", F.coalesce("canonical_id", "document_id").alias("document_id")).distinct()


def asset_verdicts(assets: DataFrame, content: str, most: int) -> DataFrame:
    """assets (declared_sha256, declared_size; null: not declared) with verdict of the bytes in content: TOO_LARGE, HASH, SIZE or OK, in this order."""
    size = F.octet_length(content)
    wrong_hash = F.col("declared_sha256") != F.sha2(F.col(content).cast("binary"), 256)
    verdict = F.when(size > most, "TOO_LARGE").when(wrong_hash, "HASH").when(F.col("declared_size") != size, "SIZE").otherwise("OK")
    return assets.withColumn("verdict", verdict)


def leveled_queries(candidates: DataFrame, aliases: DataFrame, members: DataFrame, cutoff: str, keywords: int = 24, codes: int = 12) -> DataFrame:
    """The query plan of each run of candidates(run_id, sector_id, name, rank).

    One query for everything; then names, aliases(sector_id, alias) and ids that differ from their name
    as keywords, and members(sector_id, code) as disclosures, by priority, value, rank and sector. Equal
    values (keywords: trimmed, case aside) count once, blank ones not at all; each kind has its budget.
    """
    c = candidates
    row = lambda df, kind, source, value, priority: df.select("run_id", F.lit(kind).alias("query_type"), F.lit(source).alias("source_id"), value.alias("value"), "sector_id", F.lit(priority).alias("priority"), "rank")
    wanted = (
        row(c, "KEYWORD", "eastmoney", F.col("name"), NAME)
        .union(row(c.join(aliases, "sector_id"), "KEYWORD", "eastmoney", F.col("alias"), ALIAS))
        .union(row(c.filter("name <> sector_id"), "KEYWORD", "eastmoney", F.col("sector_id"), IDENTIFIER))
        .union(row(c.join(members, "sector_id"), "DISCLOSURE", "cninfo", F.col("code"), CODE))
    )
    norm = F.lower(F.trim("value"))
    same = F.when(F.col("query_type") == "KEYWORD", norm).otherwise(F.col("value"))
    order = F.struct((-F.col("priority")).alias("p"), "value", "rank", "sector_id")
    keyed = wanted.withColumn("same", same).filter((F.col("query_type") != "KEYWORD") | (norm != ""))
    once = keyed.groupBy("run_id", "query_type", "source_id", "same").agg(F.min(order).alias("m"))
    w = Window.partitionBy("run_id", "query_type").orderBy("m")
    best = once.withColumn("ordinal", F.row_number().over(w)).filter(F.col("ordinal") <= F.when(F.col("query_type") == "KEYWORD", keywords).otherwise(codes))
    listed = best.select("run_id", "query_type", "source_id", "m.value", "m.sector_id", (-F.col("m.p")).alias("priority"), "ordinal")
    whole = c.select("run_id").distinct().select("run_id", F.lit("GLOBAL").alias("query_type"), F.lit("cls").alias("source_id"), F.lit("全部").alias("value"), F.lit(None).cast("string").alias("sector_id"), F.lit(GLOBAL).alias("priority"), F.lit(1).alias("ordinal"))
    raw = F.concat_ws("|", "query_type", "source_id", norm, F.lit(cutoff))
    return whole.union(listed).withColumn("query_id", F.substring(F.sha2(raw, 256), 1, 24))


def evidence_packs(candidates: DataFrame, snapshot: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """candidates with the facts of their snapshot (pct_change, breadth_ratio, turnover_rate), the number of linked events and max_level: MARKET_ASSOCIATION with any event, else NO_RELIABLE_EXPLANATION. links(sector_id, event_id)."""
    per = links.groupBy("sector_id").agg(F.countDistinct("event_id").alias("events"))
    j = candidates.join(snapshot, keys).join(per, "sector_id", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    facts = F.array(*[F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit("None"))) for f in ("pct_change", "breadth_ratio", "turnover_rate")])
    return j.withColumns({"facts": facts, "max_level": F.when(F.col("events") > 0, "MARKET_ASSOCIATION").otherwise("NO_RELIABLE_EXPLANATION")})


def alias_groups(claims: DataFrame, aliases: DataFrame, least: int = 2) -> DataFrame:
    """claims(claim_id, subject, predicate, start, end) in comparable groups of least or more.

    Subjects and predicates are folded (white space, width and case aside) and subjects resolved by
    aliases(alias, canonical). Adds subject_key, predicate_key, component (within its keys), size and
    first_claim, the smallest claim_id of the keys, by which groups are ordered.
    """
    folded = folded_entity(folded_entity(claims, "subject", "subject_"), "predicate", "predicate_key")
    known = folded_entity(folded_entity(aliases, "alias", "subject_"), "canonical", "_canonical").groupBy("subject_").agg(F.max("_canonical").alias("_canonical"))
    keyed = folded.join(known, "subject_", "left").withColumn("subject_key", F.coalesce("_canonical", "subject_")).drop("_canonical", "subject_")
    keys = ["subject_key", "predicate_key"]
    grouped = comparable_groups(keyed, keys)
    both = grouped.groupBy(*keys, "component").agg(F.count("*").alias("size"), F.min("claim_id").alias("_low"))
    per = both.withColumn("first_claim", F.min("_low").over(Window.partitionBy(*keys))).filter(F.col("size") >= least).drop("_low")
    return grouped.join(per, [*keys, "component"])


def table_text(title: Column, unit: Column, columns: Column, rows: Column, notes: Column) -> Column:
    """A table as lines: title, unit, a sentence a row and notes; missing ones are left out. Null without rows.

    A row's first cell is its label (four digits: a year); blank cells are left out.
    """

    def sentence(row: Column) -> Column:
        label = F.trim(row[0])
        label = F.when(label.rlike(r"^\d{4}$"), F.concat(label, F.lit(" 年"))).otherwise(label)
        rest = F.slice(F.arrays_zip(columns.alias("c"), row.alias("v")), F.lit(2), F.least(F.size(columns), F.size(row)))
        cells = F.transform(F.filter(rest, lambda x: F.trim(x["v"]) != ""), lambda x: F.concat_ws(" ", x["c"], F.trim(x["v"])))
        return F.when(F.size(cells) == 0, F.concat(label, F.lit("。"))).otherwise(F.concat(label, F.lit("："), F.array_join(cells, "，"), F.lit("。")))

    line = lambda prefix, value: F.array(F.when(value != "", F.concat(F.lit(prefix), value)))
    lines = F.array_compact(F.concat(line("表格：", title), line("单位：", unit), F.transform(rows, sentence), line("注释：", notes)))
    return F.when(F.size(rows) > 0, F.array_join(lines, "\n"))
