"""Domain frames derived from the relational tables: sector universes, news, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Two runs: orders before and from this date.
SPLIT = "1998-05-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key where the files give fewer partitions than there are cores (a table in one row group); as they are otherwise."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores, key) if rows.rdd.getNumPartitions() < cores else rows


def _measures(rows: DataFrame, kind: str) -> DataFrame:
    cents = F.round(F.col("l_discount") * 100).cast("long")
    n = F.count("*")
    out = rows.groupBy("run_id", "sector_id").agg(
        (F.sum(cents).cast("double") / n.cast("double") - 5.0).alias("drift"),
        F.when(n % 5 != 0, F.sum(F.col("l_quantity").cast("long")).cast("double") / n.cast("double") / 5.0).alias("turnover_rate"),
        F.count_if(cents > 5).alias("advancers"),
        F.count_if(cents < 5).alias("decliners"),
        F.max("o_orderdate").alias("observed_at"),
        F.when(n % 7 != 0, F.max(F.col("l_quantity").cast("long")).cast("double") - F.min(F.col("l_quantity").cast("long")).cast("double") - 25.0).alias("leader_pct_change"),
    )
    return out.select("run_id", F.lit(kind).alias("kind"), "sector_id", (F.col("drift") * 60.0).alias("pct_change"), "turnover_rate", "advancers", "decliners", "observed_at", "leader_pct_change")


def sector_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector snapshots of two runs: INDUSTRY by part brand, CONCEPT by supplier nation."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_discount", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp_ntz"), "base").otherwise("compare").alias("run_id"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("sector_id"))
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("sector_id"))
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "sector_id")
    industry = _measures(rows.join(part, F.col("l_partkey") == F.col("p_partkey")), "INDUSTRY")
    concept = _measures(rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")), "CONCEPT")
    return industry.unionByName(concept)


def _sql_measures(kind: str, key: str, join: str) -> str:
    return f"""SELECT run_id, '{kind}' AS kind, {key} AS sector_id, (CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) - 5.0) * 60.0 AS pct_change,
CASE WHEN count(*) % 5 <> 0 THEN CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) / 5.0 END AS turnover_rate,
count(*) FILTER (round(l_discount * 100) > 5) AS advancers, count(*) FILTER (round(l_discount * 100) < 5) AS decliners, max(o_orderdate) AS observed_at,
CASE WHEN count(*) % 7 <> 0 THEN CAST(max(CAST(l_quantity AS BIGINT)) AS DOUBLE) - CAST(min(CAST(l_quantity AS BIGINT)) AS DOUBLE) - 25.0 END AS leader_pct_change
FROM rows {join} GROUP BY run_id, {key}"""


UNIVERSE_SQL = f"""rows AS (SELECT l.*, o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '{SPLIT}' THEN 'base' ELSE 'compare' END AS run_id FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
universe AS ({_sql_measures("INDUSTRY", "p_brand", "JOIN part ON l_partkey = p_partkey")} UNION ALL {_sql_measures("CONCEPT", "n_name", "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")})"""


def news_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News documents: text from documents, times and grade from the event with the same id.

    A document without its event has no times and counts as discovery only. Every fifth has no
    publication time; it was observed up to 99 hours after its event.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    events = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    seconds = F.coalesce(k, F.lit(0)) * 3600
    joined = docs.join(events, F.col("doc_id") == F.col("event_id"), "left")
    published = F.when(F.col("doc_id") % 5 != 0, F.unix_micros(F.col("ts").cast("timestamp")))
    observed = F.unix_micros(F.col("ts").cast("timestamp")) + seconds.cast("long") * 1000000
    return joined.select(
        "doc_id",
        F.substring("text", 1, 60).alias("title"),
        "text",
        "lang",
        "source",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"),
        published.alias("published_us"),
        observed.alias("observed_us"),
        F.when(F.col("event_type") == "purchase", "PRIMARY").when(F.col("event_type").isin("click", "view"), "REPUTABLE_MEDIA").otherwise("DISCOVERY_ONLY").alias("source_grade"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("https://news.example.com/"), F.col("doc_id"))).alias("citation_url"),
        (F.col("doc_id") % 97).alias("story"),
    )


NEWS_SQL = """news AS (SELECT doc_id, substr(text, 1, 60) AS title, text, lang, source, sha256(coalesce(text, '')) AS content_hash,
CASE WHEN doc_id % 5 <> 0 THEN epoch_us(ts) END AS published_us, epoch_us(ts) + coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) * 3600000000 AS observed_us,
CASE WHEN event_type = 'purchase' THEN 'PRIMARY' WHEN event_type IN ('click', 'view') THEN 'REPUTABLE_MEDIA' ELSE 'DISCOVERY_ONLY' END AS source_grade,
CASE WHEN doc_id % 3 <> 0 THEN 'https://news.example.com/' || doc_id END AS citation_url, doc_id % 97 AS story
FROM documents LEFT JOIN events ON doc_id = event_id)"""

#: The locked cutoff of the news queries: 2024-01-03 00:00:00 UTC.
CUTOFF_US = 1704240000000000
