"""Connected components by repeated contraction, as DataFrame joins.

Each round points every vertex at its smallest neighbour, follows the pointer once more, and
replaces each link by the link between the vertices pointed at. Links inside a component turn into
loops and go, so the link table shrinks geometrically; chains need logarithmically many rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: How a step is written: (table, name) -> the table read again.
Keep = Callable[[DataFrame, str], DataFrame]


def connected_components(links: DataFrame, keep: Keep = materialize) -> DataFrame:
    """links(a, b) -> (id, component): the smallest id reachable, for every id in a link.

    Loops, repeated links and either direction are allowed; null ends are dropped; no links give no
    rows. keep writes the steps. Every step is a partial aggregate or a join of two written tables, which adaptive
    execution can split where one vertex holds most of the links.
    """
    pairs = links.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = keep(pairs, "cc-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        low = keep(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("p")), "cc-low")
        up = low.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jump = keep(low.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("root")), "cc-jump")
        if labels is None:
            labels = jump.select(F.col("v").alias("id"), F.col("root").alias("component"))
        else:
            step = jump.select(F.col("v").alias("component"), "root")
            labels = keep(labels.join(step, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "cc-labels")
        moved = edges.join(jump.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a").select("ra", "b")
        moved = moved.join(jump.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b").filter("ra <> rb")
        edges = keep(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
