"""Market queries over the derived sector universes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import market as M
from tidemark.sources.tables import UNIVERSE_SQL, read, sector_universe

UNIVERSE = ["run_id", "kind"]


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sector_universe(spark, sf_dir).withColumn("breadth_ratio", M.breadth_ratio(F.col("advancers"), F.col("decliners")))


def _hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors in the news: brands of parts larger than 48, and nations of customers in the red below -950."""
    brands = read(spark, sf_dir, "part").filter("p_size > 48 and p_retailprice > 1000").select(F.col("p_brand").alias("sector_id"))
    red = read(spark, sf_dir, "customer").filter("c_acctbal < -950").select("c_nationkey")
    nations = read(spark, sf_dir, "nation").join(red, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select(F.col("n_name").alias("sector_id"))
    return brands.union(nations).distinct()


HOT_SQL = """hot AS (SELECT p_brand AS sector_id FROM part WHERE p_size > 48 AND p_retailprice > 1000
UNION SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -950))"""
_BREADTH = "CASE WHEN advancers + decliners = 0 THEN 0.5 ELSE CAST(advancers AS DOUBLE) / CAST(advancers + decliners AS DOUBLE) END"
_B = f"WITH {UNIVERSE_SQL}, u AS (SELECT *, {_BREADTH} AS breadth_ratio FROM universe)"


def sector_snapshot(spark, sf_dir):
    return _universe(spark, sf_dir)


SNAPSHOT_SQL = f"{_B} SELECT * FROM u"


def _scored_sql() -> str:
    v = {"pct_change": "abs(pct_change)", "turnover_rate": "coalesce(turnover_rate, 0.0)", "breadth": "abs(breadth_ratio - 0.5)"}
    scale = M.MARKET_SHARE / sum(M.WEIGHTS.values())
    lo = ", ".join(f"{x} AS v_{d}, min({x}) OVER w AS lo_{d}, max({x}) OVER w AS hi_{d}" for d, x in v.items())
    parts = " + ".join(f"CASE WHEN hi_{d} - lo_{d} = 0 THEN 0.5 ELSE (v_{d} - lo_{d}) / (hi_{d} - lo_{d}) END * {M.WEIGHTS[d]!r} * CAST({scale!r} AS DOUBLE)" for d in v)
    parts = parts.replace("* 0.45", "* CAST(0.45 AS DOUBLE)").replace("* 0.25", "* CAST(0.25 AS DOUBLE)").replace("* 0.2 ", "* CAST(0.2 AS DOUBLE) ")
    reasons = "list_filter([CASE WHEN h THEN 'news' END, CASE WHEN abs(pct_change) >= 3 THEN 'movement' END, CASE WHEN coalesce(turnover_rate, 0) >= 5 THEN 'turnover' END], lambda x: x IS NOT NULL)"
    return f"""{_B}, {HOT_SQL}, s AS (SELECT u.*, {lo}, sector_id IN (SELECT sector_id FROM hot) AS h FROM u WINDOW w AS (PARTITION BY run_id, kind)),
scored AS (SELECT run_id, kind, sector_id, pct_change, least(CAST(0.0 AS DOUBLE) + {parts}, CAST(0.9 AS DOUBLE)) + CASE WHEN h THEN CAST(0.1 AS DOUBLE) ELSE 0.0 END AS score, array_to_string({reasons}, ',') AS reasons FROM s)"""


def _scored(spark, sf_dir) -> DataFrame:
    scored = M.composite_scores(_universe(spark, sf_dir), _hot(spark, sf_dir), UNIVERSE)
    return scored.select("run_id", "kind", "sector_id", "pct_change", "score", F.array_join("reasons", ",").alias("reasons"))


def composite_score(spark, sf_dir):
    return _scored(spark, sf_dir)


COMPOSITE_SQL = f"{_scored_sql()} SELECT * FROM scored"


def candidate_rank(spark, sf_dir):
    """The twelve best sectors of each run, over both universes."""
    return M.ranked(_scored(spark, sf_dir), [F.desc(F.round("score", 9)), F.asc("sector_id")], ["run_id"], 12)


CANDIDATE_SQL = f"{_scored_sql()} SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY round(score, 9) DESC, sector_id) AS INT) AS rank FROM scored QUALIFY rank <= 12"


def radar_rank(spark, sf_dir):
    u = _universe(spark, sf_dir).withColumn("radar", M.radar_score())
    return M.ranked(u, [F.desc(F.round("radar", 9)), F.asc("sector_id")], UNIVERSE, 20).select("run_id", "kind", "sector_id", "radar", "rank")


RADAR_SQL = f"{_B} SELECT run_id, kind, sector_id, abs(pct_change) + abs(breadth_ratio - 0.5) + abs(coalesce(leader_pct_change, 0.0)) / 10 + coalesce(turnover_rate, 0.0) / 10 AS radar, CAST(row_number() OVER (PARTITION BY run_id, kind ORDER BY round(radar, 9) DESC, sector_id) AS INT) AS rank FROM u QUALIFY rank <= 20"


def field_availability(spark, sf_dir):
    u = _universe(spark, sf_dir)
    fields = M.available_fields(u, UNIVERSE, ["pct_change", "turnover_rate", "advancers"])
    shown = u.join(fields, UNIVERSE).withColumn("shown", M.masked(F.col("turnover_rate"), "turnover_rate", F.col("available")))
    return shown.select("run_id", "kind", "sector_id", "shown", F.array_join("available", ",").alias("available"))


FIELDS_SQL = f"""{_B}, f AS (SELECT run_id, kind, array_to_string(list_filter([CASE WHEN bool_or(pct_change IS NOT NULL) THEN 'pct_change' END, CASE WHEN bool_or(turnover_rate IS NOT NULL) THEN 'turnover_rate' END, CASE WHEN bool_or(advancers IS NOT NULL) THEN 'advancers' END], lambda x: x IS NOT NULL), ',') AS available FROM u GROUP BY 1, 2)
SELECT run_id, kind, sector_id, CASE WHEN list_contains(string_split(available, ','), 'turnover_rate') THEN turnover_rate END AS shown, available FROM u JOIN f USING (run_id, kind)"""

def universe_gate(spark, sf_dir):
    return M.universe_gate(_universe(spark, sf_dir), UNIVERSE)


GATE_SQL = f"{_B} SELECT run_id, kind, count(*) AS n, CASE WHEN count(*) < CASE kind WHEN 'INDUSTRY' THEN 50 ELSE 100 END THEN 'BLOCKED' ELSE 'NORMAL' END AS status, CASE WHEN count(*) < CASE kind WHEN 'INDUSTRY' THEN 50 ELSE 100 END THEN 'INSUFFICIENT_COVERAGE' END AS reason FROM u GROUP BY 1, 2"


def cutoff_lock(spark, sf_dir):
    return M.lock_cutoff(_universe(spark, sf_dir), ["run_id"], 86400)


LOCK_SQL = f"{_B} SELECT run_id, max(observed_at) AS cutoff, CAST((epoch_us(max(observed_at)) - epoch_us(min(observed_at))) / 1000000 AS BIGINT) AS skew_s, (epoch_us(max(observed_at)) - epoch_us(min(observed_at))) / 1000000 <= 86400 AS ok FROM u GROUP BY 1"


def terminal_status(spark, sf_dir):
    out = M.terminal_status(M.universe_gate(_universe(spark, sf_dir), UNIVERSE), ["run_id"])
    return out.select("run_id", F.array_join("codes", ",").alias("codes"), "status")


TERMINAL_SQL = f"""WITH g AS ({GATE_SQL}) SELECT run_id, coalesce(string_agg(DISTINCT CASE WHEN status = 'BLOCKED' THEN kind || '_' || reason END, ',' ORDER BY CASE WHEN status = 'BLOCKED' THEN kind || '_' || reason END), '') AS codes,
CASE WHEN bool_or(status = 'BLOCKED') THEN 'BLOCKED' WHEN bool_or(reason IS NOT NULL) THEN 'DEGRADED' ELSE 'READY' END AS status FROM g GROUP BY 1"""


def sector_name_restore(spark, sf_dir):
    """Blank names are filled from the other run where exactly one sector has the key."""
    u = _universe(spark, sf_dir).select("run_id", "kind", "sector_id", F.when(F.col("advancers") % 3 != 0, F.col("sector_id")).alias("name"))
    known = u.filter("run_id = 'base' and name is not null").groupBy("kind", "sector_id").agg(F.count("*").alias("n"), F.min("name").alias("known"))
    joined = u.filter("run_id = 'compare'").join(known.filter("n = 1").drop("n"), ["kind", "sector_id"], "left")
    return joined.select("kind", "sector_id", F.coalesce("name", "known").alias("name"))


RESTORE_SQL = f"""{_B}, x AS (SELECT run_id, kind, sector_id, CASE WHEN advancers % 3 <> 0 THEN sector_id END AS name FROM u),
k AS (SELECT kind, sector_id, min(name) AS known FROM x WHERE run_id = 'base' AND name IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1)
SELECT x.kind, x.sector_id, coalesce(name, known) AS name FROM x LEFT JOIN k USING (kind, sector_id) WHERE run_id = 'compare'"""


QUERIES = {
    "market_sector_snapshot": (sector_snapshot, SNAPSHOT_SQL),
    "market_composite_score": (composite_score, COMPOSITE_SQL),
    "market_candidate_rank": (candidate_rank, CANDIDATE_SQL),
    "market_radar_rank": (radar_rank, RADAR_SQL),
    "market_field_availability": (field_availability, FIELDS_SQL),
    "market_universe_gate": (universe_gate, GATE_SQL),
    "market_cutoff_lock": (cutoff_lock, LOCK_SQL),
    "market_terminal_status": (terminal_status, TERMINAL_SQL),
    "market_name_restore": (sector_name_restore, RESTORE_SQL),
}
