"""Market operators: breadth, composite scores, ranks, radar, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of market facts in a score, dimension weights, news bonus, reason thresholds.
MARKET_SHARE = 0.90
WEIGHTS = {"pct_change": 0.45, "turnover_rate": 0.25, "breadth": 0.20}
NEWS_BONUS = 0.10
MOVEMENT, TURNOVER = 3.0, 5.0


def breadth_ratio(advancers: Column, decliners: Column) -> Column:
    """advancers / (advancers + decliners); 0.5 where both are 0."""
    total = (advancers + decliners).cast("double")
    return F.when(total == 0, 0.5).otherwise(advancers.cast("double") / total)


#: What a names-only provider has where its snapshot declares nothing (fixed values).
NAMES_ONLY = ("id", "name")


def available_fields(rows: DataFrame, keys: list[str], fields: list[str], names_only: Column | None = None) -> DataFrame:
    """keys and available: the optional fields that some row of the snapshot has, in the order given. names_only: whether a row comes from a provider whose snapshots have NAMES_ONLY where nothing is declared; others then have none."""
    seen = [F.when(F.bool_or(F.col(f).isNotNull()), F.lit(f)) for f in fields]
    found = F.array_compact(F.array(*seen))
    if names_only is not None:
        bare = F.array(*map(F.lit, NAMES_ONLY))
        return rows.groupBy(*keys).agg(found.alias("found"), F.coalesce(F.bool_and(names_only), F.lit(False)).alias("bare")).select(*keys, F.when((F.size("found") == 0) & F.col("bare"), bare).otherwise(F.col("found")).alias("available"))
    return rows.groupBy(*keys).agg(found.alias("available"))


def masked(value: Column, field: str, available: Column) -> Column:
    """A value only where its snapshot declares the field; a snapshot that declares none shows nothing."""
    return F.when(F.array_contains(available, field), value)


def composite_scores(universe: DataFrame, hot: DataFrame, keys: list[str], dimensions: tuple[str, ...] = ("pct_change", "turnover_rate", "breadth")) -> DataFrame:
    """universe with score and reasons.

    Each dimension is scaled to 0..1 within its universe (keys; all equal: 0.5), weighted, and the
    weights of the dimensions present are rescaled to MARKET_SHARE, which caps the sum. Sectors of
    hot(sector_id) get NEWS_BONUS on top. One window per universe, no self-join.
    """
    raw = {"pct_change": F.abs("pct_change"), "turnover_rate": F.coalesce("turnover_rate", F.lit(0.0)), "breadth": F.abs(F.col("breadth_ratio") - 0.5)}
    w = Window.partitionBy(*keys)
    df = universe.withColumns({f"_{d}": raw[d] for d in dimensions})
    df = df.withColumns({f"_lo_{d}": F.min(f"_{d}").over(w) for d in dimensions} | {f"_hi_{d}": F.max(f"_{d}").over(w) for d in dimensions})
    scale = MARKET_SHARE / sum(WEIGHTS[d] for d in dimensions)
    total = F.lit(0.0)
    for d in dimensions:
        span = F.col(f"_hi_{d}") - F.col(f"_lo_{d}")
        total = total + F.when(span == 0, 0.5).otherwise((F.col(f"_{d}") - F.col(f"_lo_{d}")) / span) * WEIGHTS[d] * scale
    df = df.join(hot.select("sector_id").distinct().withColumn("_hot", F.lit(True)), "sector_id", "left")
    news = F.coalesce("_hot", F.lit(False))
    score = F.least(total, F.lit(MARKET_SHARE)) + F.when(news, NEWS_BONUS).otherwise(0.0)
    reasons = F.array_compact(
        F.array(
            F.when(news, "news"),
            F.when(F.abs("pct_change") >= MOVEMENT, "movement"),
            F.when((F.coalesce("turnover_rate", F.lit(0.0)) >= TURNOVER) & F.lit("turnover_rate" in dimensions), "turnover"),
        )
    )
    helpers = ["_hot", *(f"{p}{d}" for d in dimensions for p in ("_", "_lo_", "_hi_"))]
    return df.withColumns({"score": score, "reasons": reasons}).drop(*helpers)


def ranked(df: DataFrame, order: list[Column], by: list[str] | None = None, limit: int | None = None, into: str = "rank") -> DataFrame:
    """df with its position (from 1) in order, within by; with limit only the first ones.

    Without by and with limit, the rows are cut to the top first (a partial sort in every task), so
    the single ranking task gets at most limit rows.
    """
    if not by and limit is not None:
        df = df.orderBy(*order).limit(limit)
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    out = df.withColumn(into, F.row_number().over(w))
    return out if limit is None else out.filter(F.col(into) <= limit)


def radar_score() -> Column:
    """|pct| + |breadth - 0.5| + |leader's pct| / 10 + turnover / 10, the diagnostic order; a missing leader or turnover counts 0."""
    return F.abs("pct_change") + F.abs(F.col("breadth_ratio") - 0.5) + F.abs(F.coalesce("leader_pct_change", F.lit(0.0))) / 10 + F.coalesce("turnover_rate", F.lit(0.0)) / 10


#: Fewest sectors of a usable universe by kind (fixed values).
LEAST_SECTORS = {"INDUSTRY": 50, "CONCEPT": 100}


def universe_gate(universe: DataFrame, keys: list[str], least: dict[str, int] = LEAST_SECTORS) -> DataFrame:
    """Per universe: n, status NORMAL or BLOCKED and the reason when it has fewer rows than its kind needs."""
    need = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in least.items()], F.lit(0))
    out = universe.groupBy(*keys).agg(F.count("*").alias("n"))
    blocked = F.col("n") < need
    return out.withColumns({"status": F.when(blocked, "BLOCKED").otherwise("NORMAL"), "reason": F.when(blocked, "INSUFFICIENT_COVERAGE")})


def lock_cutoff(universe: DataFrame, keys: list[str], most_skew_s: int) -> DataFrame:
    """Per run: the cutoff (latest observation), the skew in seconds, and whether it is within the limit."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp"))
    out = universe.groupBy(*keys).agg(F.max("observed_at").alias("cutoff"), F.min("observed_at").alias("first"))
    skew = (seconds(F.col("cutoff")) - seconds(F.col("first"))) / 1000000
    return out.withColumn("skew_s", skew.cast("long")).withColumn("ok", F.col("skew_s") <= most_skew_s).drop("first")


def terminal_status(quality: DataFrame, keys: list[str]) -> DataFrame:
    """READY, DEGRADED or BLOCKED per run from rows of (kind, status, reason): any BLOCKED blocks; any other reason degrades. codes: KIND_REASON of blocked kinds, sorted."""
    out = quality.groupBy(*keys).agg(
        F.bool_or(F.col("status") == "BLOCKED").alias("_b"),
        F.bool_or(F.col("reason").isNotNull()).alias("_d"),
        F.array_sort(F.collect_set(F.when(F.col("status") == "BLOCKED", F.concat_ws("_", "kind", "reason")))).alias("codes"),
    )
    return out.withColumn("status", F.when(F.col("_b"), "BLOCKED").when(F.col("_d"), "DEGRADED").otherwise("READY")).drop("_b", "_d")
