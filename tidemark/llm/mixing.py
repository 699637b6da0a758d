"""Mixing sources to target weights by pivotal dependent rounding, DataFrame functions only.

Every document gets the expected number of copies target / source size; its whole part is taken and
its fraction is rounded dependently. Two fractional documents of a source meet and one of them gives
words to the other until one is integral: the words expected of the pair stay the same, so a source's total stays
at its target to within one document. Documents of a source are dealt into groups of at most about
GROUP by hash; each group leaves at most one fractional document, and those form the next level of
the reduction tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialize, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
LIMIT = 2.0
#: Expected documents of a group of the reduction tree.
GROUP = 64
SEED = 8


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """sizes with position: the rank from 0 of source in code-point order, null last. Rows are ranged over partitions; only a count per partition is gathered."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = materialize(sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "mix-ranges")
    counts = dealt.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).select("part", "start")
    local = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("local", local).join(F.broadcast(offsets), "part").withColumn("position", F.col("start") + F.col("local")).drop("part", "start", "local")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, n, target) of each source of sized(source, size).

    Targets share share x all words by weight; those above limit x their source's size stop there
    and the excess is shared again by weight until none is above. Each pass gathers one row of sums.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    level = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    sources = materialize(ranked_sources(sizes).withColumn("weight", level), "mix-sources")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.col("source_size") * F.lit(float(limit))
    unit, full = 0.0, -1
    while True:
        capped = F.col("weight") * unit > cap
        r = sources.agg(F.sum(F.when(capped, cap)).alias("capped"), F.sum(F.when(~capped, F.col("weight"))).alias("weight"), F.count_if(capped).alias("n")).first()
        if r["n"] == full or not r["weight"]:
            break
        full, unit = r["n"], (total - (r["capped"] or 0.0)) / r["weight"]
    return sources.withColumn("target", F.least(F.col("weight") * unit, cap)).select("source", "source_size", "n", "target")


def _unit(seed: int, *what: Column) -> Column:
    return F.xxhash64(*what, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)


def _fold(items: Column) -> Column:
    """Pivotal rounding along an array of struct(key, size, p) with 0 < p < 1 and size > 0: struct(left: the fractional one or null, done: array of struct(key, up))."""
    done_type = "array<struct<key:long,up:int>>"
    left_type = "struct<key:bigint,size:bigint,p:double>"
    start = F.struct(F.lit(None).cast(left_type).alias("left"), F.array().cast(done_type).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["left"]
        # words that can move from a to x, and from x to a
        give = F.least(a["p"] * a["size"], (1 - x["p"]) * x["size"])
        take = F.least((1 - a["p"]) * a["size"], x["p"] * x["size"])
        gives = _unit(SEED, a["key"], x["key"]) < take / (give + take)
        moved = F.when(gives, give).otherwise(-take)
        pa, px = a["p"] - moved / a["size"], x["p"] + moved / x["size"]
        # which of the two became integral, decided without rounding error
        a_done = F.when(gives, a["p"] * a["size"] <= (1 - x["p"]) * x["size"]).otherwise((1 - a["p"]) * a["size"] <= x["p"] * x["size"])
        a_up = F.when(gives, 0).otherwise(1)
        out = F.when(a_done, F.struct(a["key"].alias("key"), a_up.alias("up"))).otherwise(F.struct(x["key"].alias("key"), (1 - a_up).alias("up")))
        rest = F.when(a_done, F.struct(x["key"].alias("key"), x["size"].alias("size"), px.alias("p"))).otherwise(F.struct(a["key"].alias("key"), a["size"].alias("size"), pa.alias("p")))
        both_done = F.when(a_done, (px <= 1e-12) | (px >= 1 - 1e-12)).otherwise((pa <= 1e-12) | (pa >= 1 - 1e-12))
        second = F.struct(rest["key"].alias("key"), (rest["p"] > 0.5).cast("int").alias("up"))
        met = F.when(both_done, F.struct(F.lit(None).cast(left_type).alias("left"), F.concat(acc["done"], F.array(out, second)).cast(done_type).alias("done")))
        met = met.otherwise(F.struct(rest.cast(left_type).alias("left"), F.concat(acc["done"], F.array(out)).cast(done_type).alias("done")))
        return F.when(a.isNull(), F.struct(x.cast(left_type).alias("left"), acc["done"].alias("done"))).otherwise(met)

    return F.aggregate(items, start, step)


def pivotal_round(units: DataFrame, largest: int, group: int = GROUP) -> DataFrame:
    """(key, up 0 or 1) of units(source, key, size, p): fractions rounded so that each source keeps its expected words to within one unit. largest: units of the largest source, which sets the depth of the tree."""
    level, decided, deep = units, [], 0
    while True:
        groups = max(1, -(-largest // group))
        dealt = level.withColumn("g", F.pmod(F.xxhash64("key", F.lit(SEED + 1 + deep)), F.ceil(F.col("n") / group)))
        items = F.array_sort(F.collect_list(F.struct("key", "size", "p")))
        folded = dealt.groupBy("source", "g").agg(F.max("n").alias("n"), items.alias("items")).select("source", "n", _fold(F.col("items")).alias("f"))
        folded = materialize(folded.select("source", "n", "f.left", "f.done"), f"mix-level{deep}")
        decided.append(folded.select(F.explode("done").alias("d")).select("d.key", "d.up"))
        rest = folded.filter("left is not null").select("source", F.ceil(F.col("n") / group).alias("n"), F.col("left.key").alias("key"), F.col("left.size").alias("size"), F.col("left.p").alias("p"))
        if groups == 1:
            decided.append(rest.select("key", (_unit(SEED, F.col("key"), F.lit(0)) < F.col("p")).cast("int").alias("up")))
            break
        level, largest, deep = rest, groups, deep + 1
    out = decided[0]
    for more in decided[1:]:
        out = out.union(more)
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row.

    Rows alike in doc_id, source and size are one unit and are taken equally often; a unit rounds
    with the sum of their sizes. A null text has size 0 and is never taken; a null source is a
    source, the last; no rows give no rows.
    """
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    unit = materialize(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("alike")).withColumn("all", F.col("size") * F.col("alike")), "mix-units")
    targets = materialize(source_targets(unit.select("source", F.col("all").alias("size")), weights, share, limit), "mix-targets")
    planned = unit.join(targets, unit["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.xxhash64("doc_id", "source", "size")
    planned = planned.withColumns({"key": key, "base": F.floor(rate), "p": rate - F.floor(rate)})
    open_ = planned.filter("all > 0 and p > 0").select("source", "key", F.col("all").alias("size"), "p", "n")
    largest = targets.agg(F.max("n")).first()[0] or 0
    ups = pivotal_round(open_, largest).groupBy("key").agg(F.max("up").alias("up"))
    done = planned.join(ups, "key", "left").withColumn("copies", F.when(F.col("all") > 0, F.col("base") + F.coalesce("up", F.lit(0))).otherwise(0).cast("long"))
    return done.select("doc_id", "source", "size", "source_size", "target", "copies", F.explode(F.sequence(F.lit(1).cast("long"), "alike"))).drop("col").withColumn("taken", F.col("size") * F.col("copies"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
