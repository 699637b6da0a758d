"""Claim queries: orders as claims about customers, validity from their dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import claims as C
from tidemark.sources.tables import read

KEYS = ["subject", "predicate"]


def _claims(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    start = F.when(k % 50 != 0, F.to_date("o_orderdate"))
    return o.select(
        k.alias("claim_id"),
        F.col("o_custkey").alias("subject"),
        F.col("o_orderpriority").alias("predicate"),
        F.col("o_orderstatus").alias("stance"),
        start.alias("start"),
        F.date_add(start, (k % 400).cast("int")).alias("end"),
        (k % 5).alias("document_id"),
        (k % 3).alias("version"),
        (k % 5 * 10 + k % 3).alias("version_id"),
        F.when(k % 4 != 0, "ACTIVE").otherwise("SUPERSEDED").alias("status"),
        (k % 2).cast("int").alias("weight"),
        (k % 7 % 2).cast("int").alias("grade"),
        F.when(k % 6 != 0, F.col("o_totalprice")).alias("relevance"),
    )


CLAIMS_SQL = """claims AS (SELECT o_orderkey AS claim_id, o_custkey AS subject, o_orderpriority AS predicate, o_orderstatus AS stance, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS s,
CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INT) END AS e, o_orderkey % 5 AS document_id, o_orderkey % 3 AS version, o_orderkey % 5 * 10 + o_orderkey % 3 AS version_id,
CASE WHEN o_orderkey % 4 <> 0 THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status, o_orderkey % 2 AS weight, o_orderkey % 7 % 2 AS grade, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS relevance FROM orders)"""
_GROUPS = f"""WITH {CLAIMS_SQL}, g1 AS (SELECT *, max(e) OVER (PARTITION BY subject, predicate ORDER BY s NULLS FIRST, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, bool_or(s IS NULL) OVER (PARTITION BY subject, predicate) AS unk FROM claims),
g AS (SELECT *, CAST(sum(CASE WHEN NOT unk AND s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY subject, predicate ORDER BY s NULLS FIRST, claim_id ROWS UNBOUNDED PRECEDING) AS INT) AS component FROM g1)"""


def claim_groups(spark, sf_dir):
    return C.comparable_groups(_claims(spark, sf_dir), KEYS).select("claim_id", "subject", "predicate", "component")


GROUPS_SQL = f"{_GROUPS} SELECT claim_id, subject, predicate, component FROM g"


def _pairs(spark, sf_dir):
    grouped = C.comparable_groups(_claims(spark, sf_dir), KEYS)
    return C.claim_pairs(grouped, [*KEYS, "component"])


def conflicts(spark, sf_dir):
    """Decisions of all claim pairs; the verdict comes from a rule on the two prices and stances, missing for every ninth pair."""
    p = _pairs(spark, sf_dir)
    total = F.col("claim_id_l") + F.col("claim_id_r")
    overlap = (total % 100).cast("double") / 100
    relation, confidence = C.rule_verdict(overlap, F.col("stance_l") != F.col("stance_r"))
    p = p.withColumns({"relation": F.when(total % 9 != 0, relation), "confidence": confidence})
    window = (F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date"))
    return C.resolve(p, window).select("claim_id_l", "claim_id_r", "decision", F.coalesce("rule", F.lit("")).alias("rule"), F.coalesce("winner", F.lit("")).alias("winner"))


_D = lambda x: f"CAST({x} AS DOUBLE)"
CONFLICTS_SQL = f"""{_GROUPS}, p AS (SELECT l.claim_id AS lid, r.claim_id AS rid, (l.claim_id + r.claim_id) AS t, l AS l, r AS r FROM g l JOIN g r ON l.subject = r.subject AND l.predicate = r.predicate AND l.component = r.component AND l.claim_id < r.claim_id
WHERE NOT (l.version_id = r.version_id AND l.stance = r.stance)),
v AS (SELECT *, {_D("t % 100")} / 100 AS o, l.stance <> r.stance AS neg FROM p),
c AS (SELECT *, CASE WHEN t % 9 <> 0 THEN CASE WHEN neg THEN 'CONTRADICTION' WHEN o >= {_D("0.5")} THEN 'ENTAILMENT' ELSE 'UNCERTAIN' END END AS relation, CASE WHEN neg THEN least({_D("0.99")}, 1 - o / 2) WHEN o >= {_D("0.5")} THEN least({_D("0.99")}, {_D("0.5")} + o / 2) ELSE o / 2 END AS conf,
coalesce(l.e < r.s OR r.e < l.s, false) AS apart, coalesce(l.s <= DATE '1998-12-31' AND DATE '1998-01-01' <= l.e, false) AS ml, coalesce(r.s <= DATE '1998-12-31' AND DATE '1998-01-01' <= r.e, false) AS mr FROM v),
d AS (SELECT *, CASE WHEN (l.status = 'ACTIVE') <> (r.status = 'ACTIVE') THEN CASE WHEN l.status = 'ACTIVE' THEN 'l' ELSE 'r' END || ':STATUS'
WHEN l.document_id = r.document_id AND l.version <> r.version THEN CASE WHEN l.version > r.version THEN 'l' ELSE 'r' END || ':EXPLICIT_VERSION'
WHEN ml <> mr THEN CASE WHEN ml THEN 'l' ELSE 'r' END || ':EFFECTIVE_TIME'
WHEN l.weight <> r.weight THEN CASE WHEN l.weight > r.weight THEN 'l' ELSE 'r' END || ':SOURCE_WEIGHT'
WHEN l.grade <> r.grade THEN CASE WHEN l.grade > r.grade THEN 'l' ELSE 'r' END || ':EVIDENCE_QUALITY'
WHEN l.document_id = r.document_id AND l.relevance <> r.relevance THEN CASE WHEN l.relevance > r.relevance THEN 'l' ELSE 'r' END || ':RELEVANCE' END AS won,
NOT apart AND relation IS NOT NULL AND relation = 'CONTRADICTION' AND conf >= {_D("0.7")} AS fight FROM c)
SELECT lid AS claim_id_l, rid AS claim_id_r, CASE WHEN apart THEN 'NOT_CONFLICT' WHEN relation IS NULL THEN 'CHECK_FAILED' WHEN conf < {_D("0.7")} OR relation = 'UNCERTAIN' THEN 'UNRESOLVED' WHEN relation <> 'CONTRADICTION' THEN 'NOT_CONFLICT' WHEN won IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS decision,
coalesce(CASE WHEN apart THEN 'EFFECTIVE_TIME' WHEN fight THEN split_part(won, ':', 2) END, '') AS rule, coalesce(CASE WHEN fight THEN split_part(won, ':', 1) END, '') AS winner FROM d"""


def conflict_counts(spark, sf_dir):
    return conflicts(spark, sf_dir).groupBy("decision", "rule").agg(F.count("*").alias("n"))


def grounded_claims(spark, sf_dir):
    """Claims that quote two words of their document; those whose span misses the second word go."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    words = F.split("text", r"\s+")
    c = d.select(
        (F.col("chunk_id") % 700).alias("claim_id"),
        F.col("chunk_id").alias("ordinal"),
        "chunk_id",
        F.lit(0).alias("start"),
        (F.length(words[0]) + F.when(F.col("chunk_id") % 3 == 0, 0).otherwise(F.length(F.coalesce(F.get(words, F.lit(1)), F.lit(""))) + 1)).alias("end"),
        F.array(words[0], F.coalesce(F.get(words, F.lit(1)), F.lit(""))).alias("parts"),
        ((F.col("chunk_id") % 10).cast("double") / 10).alias("confidence"),
    )
    return C.grounded(c, d).select("claim_id", "ordinal", "chunk_id", "start", "end", "confidence")


QUERIES = {
    "claims_groups": (claim_groups, GROUPS_SQL),
    "claims_conflicts": (conflicts, CONFLICTS_SQL),
    "claims_conflict_counts": (conflict_counts, f"WITH x AS ({CONFLICTS_SQL}) SELECT decision, rule, count(*) AS n FROM x GROUP BY 1, 2"),
    "claims_grounded": (grounded_claims, None),
}
