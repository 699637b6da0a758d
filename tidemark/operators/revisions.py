"""Optimistic saves by many writers: which of them hold, without walking a key in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.steps import written


def chained(saves: DataFrame, key: str, place: str, expected: str = "expected", width: int = 65_536) -> DataFrame:
    """saves with accepted and revision (that it made; null where it was refused).

    A save with expected null makes revision 0 of a key that has none; one that expects r makes r + 1 if
    the key is at r then, and is refused otherwise. place, a long, orders the saves of a key. So the
    save that follows an accepted one is the next in the key that expects what it made, whatever the others
    do: every save points at that one, and those on the path from a key's first revision hold. The path is
    marked by pointer doubling, in log2(its length) rounds of two joins. Pointers come from windows over one
    revision of one key within width places, then over such blocks, so a key with very many saves is
    split and none is gathered in a row. A save that arrives again (same key and place, same expectation) counts
    once and is one row; two expectations at one key and place are taken in their order. Saves without key or place are refused.
    """
    made = F.coalesce(F.col(expected) + 1, F.lit(0)).cast("long")
    known = saves.select(F.col(key).alias("key"), F.col(place).cast("long").alias("place"), made.alias("made")).filter("key is not null and place is not null").distinct()
    block = F.floor(F.col("place") / width).alias("block")
    offers = known.select("key", F.col("made").alias("level"), block, "place", F.lit(True).alias("offer"), F.lit(None).cast("long").alias("asks"))
    asks = known.select("key", (F.col("made") + 1).alias("level"), block, "place", F.lit(False).alias("offer"), F.col("made").alias("asks"))
    rows = offers.unionByName(asks)
    # from the end, as such a window keeps one running value; at one place the offer counts as behind the ask
    here = Window.partitionBy("key", "level", "block").orderBy(F.desc("place"), F.desc("offer")).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("next", F.min(F.when(F.col("offer"), F.col("place"))).over(here)).filter("not offer")
    firsts = offers.groupBy("key", "level", "block").agg(F.min("place").alias("first"))
    later = Window.partitionBy("key", "level").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    # blocks that hold an ask or an offer, each with the first offer of any block behind it
    beyond = near.select("key", "level", "block").distinct().join(firsts, ["key", "level", "block"], "full").withColumn("far", F.min("first").over(later)).drop("first")
    jumps = near.join(beyond, ["key", "level", "block"]).select("key", F.col("asks").alias("made"), "place", F.coalesce("next", "far").alias("to")).filter("to is not null")
    jump = written(jumps.select("key", "place", "made", "to", (F.col("made") + 1).alias("to_made")), "revisions-jumps")
    roots = known.filter("made = 0").groupBy("key").agg(F.min("place").alias("place")).select("key", "place", F.lit(0).cast("long").alias("made"))
    marks, fresh = written(roots, "revisions-marks"), True
    while fresh:
        reached = marks.join(jump, ["key", "place", "made"]).select("key", F.col("to").alias("place"), F.col("to_made").alias("made"))
        more = written(marks.unionByName(reached).distinct(), "revisions-marks")
        fresh = more.count() > marks.count()
        marks = more
        if fresh:
            then = jump.select("key", F.col("place").alias("to"), F.col("made").alias("to_made"), F.col("to").alias("to_"), F.col("to_made").alias("to_made_"))
            jump = written(jump.join(then, ["key", "to", "to_made"]).select("key", "place", "made", F.col("to_").alias("to"), F.col("to_made_").alias("to_made")), "revisions-jumps")
    kept = marks.select(F.col("key").alias("key_"), F.col("place").alias("place_"), F.col("made").alias("revision"))
    once = saves.dropDuplicates([key, place, expected])
    joined = once.join(kept, (once[key] == F.col("key_")) & (once[place] == F.col("place_")) & (made == F.col("revision")), "left")
    return joined.select(*[once[c] for c in saves.columns], F.col("revision").isNotNull().alias("accepted"), "revision")
