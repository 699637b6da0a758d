"""Claim operators: comparable groups by overlapping validity, pairs, and the conflict rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.documents import folded_entity
from tidemark.functions.time import disjoint, matches

LEAST_CONFIDENCE = 0.7


def comparable_groups(claims: DataFrame, keys: list[str]) -> DataFrame:
    """claims with component: connected overlap of closed validity intervals (start, end) within keys.

    Intervals sorted by start form a new component where one begins after the latest end before it,
    so one window replaces the pairwise comparison. A claim without an interval overlaps all: its
    whole bucket is one component.
    """
    bucket = Window.partitionBy(*keys)
    order = bucket.orderBy(F.asc_nulls_first("start"), "claim_id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(F.col("start") > reach, 1).otherwise(0)
    unknown = F.bool_or(F.col("start").isNull() | F.col("end").isNull()).over(bucket)
    marked = claims.withColumns({"_gap": F.when(unknown, 0).otherwise(gap)})
    return marked.withColumn("component", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_gap")


def claim_pairs(claims: DataFrame, group: list[str]) -> DataFrame:
    """Pairs of claims of a group in id order, columns suffixed _l and _r; pairs of one version with one stance are left out."""
    side = lambda s: claims.select(*group, *[F.col(c).alias(f"{c}_{s}") for c in claims.columns if c not in group])
    pairs = side("l").join(side("r"), group).filter("claim_id_l < claim_id_r")
    same = F.col("version_id_l").eqNullSafe(F.col("version_id_r")) & F.col("stance_l").eqNullSafe(F.col("stance_r"))
    return pairs.filter(~same)


def claim_classes(claims: DataFrame, attributes: list[str]) -> DataFrame:
    """Claims that agree in all attributes as one row: claim_id (the smallest of the class) and n.

    Decisions follow from attributes alone, so a pair of classes stands for all pairs of their claims, and
    work grows with the classes of a group, not with the square of its claims. Nulls agree with nulls.
    """
    return claims.groupBy(*attributes).agg(F.min("claim_id").alias("claim_id"), F.count("*").alias("n"))


def class_members(claims: DataFrame, classes: DataFrame, attributes: list[str]) -> DataFrame:
    """claims with class_id, the claim_id of their class: what expands a pair of classes when asked for."""
    named = classes.select(*[F.col(a).alias(f"{a}_") for a in attributes], F.col("claim_id").alias("class_id"))
    on = [F.col(a).eqNullSafe(F.col(f"{a}_")) for a in attributes]
    return claims.join(named, on).drop(*[f"{a}_" for a in attributes])


def rule_verdict(overlap: Column, negation_differs: Column) -> tuple[Column, Column]:
    """(relation, confidence) by rule: a negation mismatch contradicts, much overlap entails, else uncertain."""
    relation = F.when(negation_differs, "CONTRADICTION").when(overlap >= 0.5, "ENTAILMENT").otherwise("UNCERTAIN")
    confidence = F.when(negation_differs, F.least(F.lit(0.99), 1 - overlap / 2)).when(overlap >= 0.5, F.least(F.lit(0.99), 0.5 + overlap / 2)).otherwise(overlap / 2)
    return relation, confidence


def resolve(pairs: DataFrame, window: tuple[Column, Column] | None = None, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """pairs with status, rule and winner (l, r or null).

    Disjoint validity is no conflict; no verdict is a failed check; low confidence is unresolved;
    entailment and neutrality are no conflict; a contradiction goes down the rule ladder.
    """
    c = F.col
    active = lambda s: F.coalesce(c(f"status_{s}") == "ACTIVE", F.lit(False))
    side = lambda left: F.when(left, "l").otherwise("r")
    same_doc = c("document_id_l") == c("document_id_r")
    ladder = [
        (active("l") != active("r"), side(active("l")), "STATUS"),
        (same_doc & (c("version_l") != c("version_r")), side(c("version_l") > c("version_r")), "EXPLICIT_VERSION"),
    ]
    if window is not None:
        meets = {s: matches(c(f"start_{s}"), c(f"end_{s}"), *window) for s in "lr"}
        ladder.append((meets["l"] != meets["r"], side(meets["l"]), "EFFECTIVE_TIME"))
    ladder += [
        (c("weight_l") != c("weight_r"), side(c("weight_l") > c("weight_r")), "SOURCE_WEIGHT"),
        (c("grade_l") != c("grade_r"), side(c("grade_l") > c("grade_r")), "EVIDENCE_QUALITY"),
        (same_doc & (c("relevance_l") != c("relevance_r")), side(c("relevance_l") > c("relevance_r")), "RELEVANCE"),
    ]
    winner, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for when, who, name in reversed(ladder):
        hit = F.coalesce(when, F.lit(False))
        winner, rule = F.when(hit, who).otherwise(winner), F.when(hit, name).otherwise(rule)
    apart = disjoint(c("start_l"), c("end_l"), c("start_r"), c("end_r"))
    unsure = (c("confidence") < least) | (c("relation") == "UNCERTAIN")
    fight = ~apart & c("relation").isNotNull() & ~unsure & (c("relation") == "CONTRADICTION")
    status = (
        F.when(apart, "NOT_CONFLICT").when(c("relation").isNull(), "CHECK_FAILED").when(unsure, "UNRESOLVED").when(c("relation") != "CONTRADICTION", "NOT_CONFLICT").when(winner.isNull(), "UNRESOLVED").otherwise("RESOLVED")
    )
    return pairs.withColumns({"decision": status, "rule": F.when(apart, "EFFECTIVE_TIME").when(fight, rule), "winner": F.when(fight, winner)})


def grounded(claims: DataFrame, chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """Claims that cite a chunk given, with a span inside its text that holds every part (white space, case and width aside), and enough confidence; the first of a claim_id stays. claims(claim_id, ordinal, chunk_id, start, end, parts, confidence). Null and blank parts hold anywhere."""
    j = claims.join(chunks.select("chunk_id", "text"), "chunk_id")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))
    parts = F.filter("parts", lambda p: F.trim(p) != "")
    # parts are folded as one string: no folding makes or takes a null character
    near = j.filter(inside & (F.col("confidence") >= least)).withColumns({"span_": F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")), "parts_": F.array_join(parts, "\0")})
    near = folded_entity(folded_entity(near, "span_", "span_"), "parts_", "parts_")
    good = near.filter(F.forall(F.split("parts_", "\0"), lambda p: F.col("span_").contains(p)))
    w = Window.partitionBy("claim_id").orderBy("ordinal")
    return good.withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_", "span_", "parts_", "text")
