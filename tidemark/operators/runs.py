"""Operators on runs: comparison, merged histories, daily trends, reviews, ledgers, versions, paging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.steps import written


def compare(base: DataFrame, other: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full outer comparison by keys: membership, and per field base_f, compare_f, delta_f (compare - base; null if either is missing) and why_f.

    A missing delta says why: the sector is absent on a side, its snapshot never declared the field
    (where a side has an array column `available`), or its value is missing; in this order.
    """
    declared = lambda df, side: [F.col("available").alias(side)] if "available" in df.columns else []
    b = base.select(*keys, *[F.col(f).alias(f"base_{f}") for f in fields], *declared(base, "_bd"), F.lit(True).alias("_b"))
    o = other.select(*keys, *[F.col(f).alias(f"compare_{f}") for f in fields], *declared(other, "_od"), F.lit(True).alias("_o"))
    j = b.join(o, keys, "full_outer")
    has_b, has_o = F.col("_b").isNotNull(), F.col("_o").isNotNull()
    out = j.withColumn("membership", F.when(has_b & has_o, "BOTH").when(has_b, "ONLY_BASE").otherwise("ONLY_COMPARE"))
    for f in fields:
        delta = F.col(f"compare_{f}") - F.col(f"base_{f}")
        silent = F.lit(False)
        for side in ("_bd", "_od"):
            if side in j.columns:
                silent = silent | ~F.coalesce(F.array_contains(side, f), F.lit(False))
        why = F.when(~has_b | ~has_o, "SECTOR_MISSING").when(delta.isNull() & silent, "FIELD_UNDECLARED").when(delta.isNull(), "VALUE_MISSING")
        out = out.withColumns({f"delta_{f}": delta, f"why_{f}": F.coalesce(why, F.lit(""))})
    return out.drop("_b", "_o", "_bd", "_od")


def merged_history(primary: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """primary and those legacy rows whose key it lacks; columns that one side lacks are null."""
    return primary.unionByName(legacy.join(primary.select(key), key, "left_anti"), allowMissingColumns=True)


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the highest version per keys."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def prioritised(df: DataFrame, key: str, priority: str) -> DataFrame:
    """One row per key: that of the highest priority (later sources overwrite earlier ones)."""
    return latest(df, [key], priority)


def paged(df: DataFrame, order: list[Column], size: int, page: int) -> DataFrame:
    """A page (from 1) of df in order, with the total number of rows; the page number is held within what there is.

    Rows are dealt by range of the order and counted a partition; only the partitions that hold the
    page are numbered, each on its own, so the last page costs no more than the first.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "page")
    counts = [(r["_p"], r["count"]) for r in dealt.groupBy("_p").count().orderBy("_p").collect()]
    total = sum(n for _, n in counts)
    page = max(1, min(page, max(1, -(-total // size))))
    first, at, here = (page - 1) * size, 0, []
    for p, n in counts:
        if at < first + size and at + n > first:
            here.append((p, at))
        at += n
    before = F.coalesce(*[F.when(F.col("_p") == p, n) for p, n in here], F.lit(0))
    numbered = dealt.filter(F.col("_p").isin([p for p, _ in here])).withColumn("position", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + before)
    return numbered.filter((F.col("position") > first) & (F.col("position") <= first + size)).drop("_p").withColumn("total", F.lit(total))


def review_metrics(audit: DataFrame, key: str) -> DataFrame:
    """Per run of audit(key, at_us, event, cost): counts per event, cost (0 if none), and seconds from the first event to the first approval or revocation (not below 0)."""
    end = F.min(F.when(F.col("event").isin("APPROVED", "REVOKED"), F.col("at_us")))
    counts = [F.count_if(F.col("event") == e).alias(n) for e, n in (("APPROVED", "approvals"), ("REVOKED", "revocations"), ("PATCHED", "patches"), ("CHECKED", "checks"))]
    out = audit.groupBy(key).agg(*counts, F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"), F.min("at_us").alias("_first"), end.alias("_end"))
    return out.withColumn("seconds", F.greatest(F.lit(0), F.floor((F.col("_end") - F.col("_first")) / 1000000))).drop("_first", "_end")


def ledger_totals(calls: DataFrame, key: str) -> DataFrame:
    """Per run of calls(key, kind, tokens, reserved, actual, state): calls by kind, known tokens, charged amount and whether some amount is unknown.

    A settled call charges its actual amount, or what it reserved when that is unknown; an open one
    what it reserved; a released one nothing.
    """
    charged = F.when(F.col("state") == "SETTLED", F.coalesce("actual", "reserved")).when(F.col("state") == "OPEN", F.col("reserved")).otherwise(0)
    return calls.groupBy(key).agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("kind") == "MODEL").alias("model_calls"),
        F.count_if(F.col("kind") == "TOOL").alias("tool_calls"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.sum(charged).alias("charged"),
        F.bool_or((F.col("state") == "SETTLED") & F.col("actual").isNull()).alias("has_unknown_cost"),
    )


def admitted(requests: DataFrame, key: str, limit: int) -> DataFrame:
    """requests(key, ordinal, amount) with admitted and used: in order, a request is admitted when it still fits under limit; refused ones use nothing, a null amount is null and uses nothing.

    Each decision needs the one before, so a key's requests pass in order through one task; only the
    amount used is kept, not the requests.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = object(), 0
        for batch in batches:
            admits, sums = [], []
            for k, amount in zip(batch[0].to_pylist(), batch[2].to_pylist(), strict=True):
                if k != last:
                    last, used = k, 0
                fits = None if amount is None else used + amount <= limit
                used += amount if fits else 0
                admits.append(fits)
                sums.append(used)
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(admits, pa.bool_()), pa.array(sums, pa.int64())], [key, "ordinal", "admitted", "used"])

    rows = requests.select(key, F.col("ordinal").cast("long").alias("ordinal"), F.col("amount").cast("long").alias("amount"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.repartition(key).sortWithinPartitions(key, "ordinal").mapInArrow(walk, f"`{key}` {kind}, ordinal long, admitted boolean, used long")


def reconcile(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """key and state MISSING (expected, not present) or UNEXPECTED (present, not expected)."""
    missing = expected.select(key).distinct().join(present.select(key), key, "left_anti").withColumn("state", F.lit("MISSING"))
    extra = present.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("state", F.lit("UNEXPECTED"))
    return missing.union(extra)


def activate(versions: DataFrame, document: str, version: str) -> DataFrame:
    """versions with their new status: the highest ready version of a document is ACTIVE, other active ones SUPERSEDED."""
    ready = F.col("status").isin("READY", "ACTIVE")
    newest = F.max(F.when(ready, F.col(version))).over(Window.partitionBy(document))
    return versions.withColumn("status", F.when(ready & (F.col(version) == newest), "ACTIVE").when(F.col("status") == "ACTIVE", "SUPERSEDED").otherwise(F.col("status")))


def leased(jobs: DataFrame, now_us: int, worker: str, lease_us: int) -> DataFrame:
    """jobs with a claim by worker: free, expired and own leases are taken; a running job whose lease expired waits for a retry."""
    expired = F.col("lease_until_us") <= now_us
    free = F.col("lease_owner").isNull() | expired | (F.col("lease_owner") == worker)
    claim = free & F.col("status").isin("PENDING", "RETRY_WAITING", "RUNNING")
    status = F.when(F.coalesce((F.col("status") == "RUNNING") & expired, F.lit(False)), "RETRY_WAITING").otherwise(F.col("status"))
    owner = F.when(F.coalesce(claim, F.lit(False)), worker).otherwise(F.col("lease_owner"))
    until = F.when(F.coalesce(claim, F.lit(False)), F.lit(now_us + lease_us)).otherwise(F.col("lease_until_us"))
    return jobs.withColumns({"status": status, "lease_owner": owner, "lease_until_us": until})


def replay_tail(events: DataFrame, key: str, order: list[str], limit: int, terminal: str) -> DataFrame:
    """The last limit events of each key up to its first terminal event."""
    w = Window.partitionBy(key).orderBy(*order)
    ended = F.sum(F.col(terminal).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    live = events.withColumn("_e", F.coalesce(ended, F.lit(0))).filter("_e = 0").drop("_e")
    back = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return live.withColumn("from_end", F.row_number().over(back)).filter(F.col("from_end") <= limit)
