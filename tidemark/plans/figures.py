"""Queries of the texts of charts, images and formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import figures as G
from tidemark.sources.tables import read

_OUT = lambda key, block: [key, f"{block}.origin", F.sha2(F.coalesce(f"{block}.text", F.lit("")), 256).alias("text"), F.col(f"{block}.text").isNotNull().alias("indexed"), f"{block}.unverified", f"{block}.reason"]


def chart_texts(spark, sf_dir):
    """A chart a supplier: its ship modes as legend, a model's reading of its quantities by return flag, as sure as lines are cheap. Suppliers in debt have no caption, those of nations divisible by four no reading."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n"), F.count_if(F.col("l_discount") >= 0.04).alias("cheap"))
    quantity = F.transform(F.sort_array(F.collect_list(F.struct("l_returnflag", "q"))), lambda x: F.when(x["q"] % 11 == 0, x["l_returnflag"]).otherwise(F.concat(x["l_returnflag"], F.lit(" "), x["q"].cast("string"))))
    read_off = lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(quantity.alias("values"), (F.sum("cheap").cast("double") / F.sum("n").cast("double")).alias("confidence"), F.sum("n").alias("n"), F.sort_array(F.collect_set("l_returnflag")).alias("flags"))
    s = read(spark, sf_dir, "supplier").join(read_off, "s_suppkey", "left")
    nation = F.col("s_nationkey")
    series = F.when(nation % 7 != 0, F.col("flags")).otherwise(F.array().cast("array<string>"))
    vision = F.when((nation % 4 != 0) & F.col("n").isNotNull(), F.struct(F.concat(F.col("n").cast("string"), F.lit(" lines")).alias("description"), "confidence", "values", series.alias("series")))
    axes = F.when(nation % 3 == 0, F.array(F.struct(F.lit("flag").alias("label"), F.lit("").alias("unit")), F.struct(F.lit("quantity").alias("label"), F.lit("pieces").alias("unit"))))
    caption = F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("  "), F.col("s_name"), F.lit(" ")))
    block = G.chart(F.lit("NATIVE"), caption, F.when(nation % 2 == 0, F.col("flags")), axes, F.when(nation % 5 == 0, F.lit("pieces")), F.when(nation % 6 == 1, F.lit("by flag")), F.lit(" "), vision)
    return s.select("s_suppkey", block.alias("b")).select(*_OUT("s_suppkey", "b"))


_DOUBT = "CASE WHEN coalesce(c >= 0.6, false) IS FALSE THEN 'UNSURE' WHEN len(list_filter(vals, lambda x: NOT regexp_matches(x, '[0-9]'))) > 0 THEN 'NO_NUMBER' WHEN len(vals) > 0 AND NOT named THEN 'NO_SERIES' ELSE '' END"
_SEEN = f"concat_ws(chr(10), '{G.DERIVED}' || said, CASE WHEN why = '' AND len(vals) > 0 THEN '{G.VALUES}' || array_to_string(vals, '{G.VALUES_BY}') END)"
CHART_SQL = f"""WITH l AS (SELECT l_suppkey, l_returnflag AS f, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, count(*) AS n, count(*) FILTER (l_discount >= 0.04) AS cheap FROM lineitem GROUP BY 1, 2),
r AS (SELECT l_suppkey AS s_suppkey, list(CASE WHEN q % 11 = 0 THEN f ELSE f || ' ' || q END ORDER BY f) AS vals, CAST(sum(cheap) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS c, CAST(sum(n) AS BIGINT) AS n, list(f ORDER BY f) AS flags FROM l GROUP BY 1),
d AS (SELECT *, s_nationkey % 7 <> 0 AS named, s_nationkey % 4 <> 0 AND n IS NOT NULL AS vision, n || ' lines' AS said, nullif(concat_ws(chr(10), CASE WHEN s_acctbal >= 0 THEN trim(s_name) END, CASE WHEN s_nationkey % 2 = 0 AND len(flags) > 0 THEN '{G.LEGEND}' || array_to_string(flags, '{G.NAMES_BY}') END,
CASE WHEN s_nationkey % 3 = 0 THEN '{G.AXIS}flag' || chr(10) || '{G.AXIS}quantity（pieces）' END, CASE WHEN s_nationkey % 5 = 0 THEN '{G.UNIT}pieces' END, CASE WHEN s_nationkey % 6 = 1 THEN '{G.FOOTNOTE}by flag' END), '') AS own FROM supplier LEFT JOIN r USING (s_suppkey)),
w AS (SELECT *, CASE WHEN NOT vision THEN '' ELSE {_DOUBT} END AS why FROM d),
t AS (SELECT *, CASE WHEN vision THEN concat_ws(chr(10), own, {_SEEN}) ELSE own END AS txt FROM w)
SELECT s_suppkey, CASE WHEN vision THEN '{G.VISION}' ELSE 'NATIVE' END AS origin, sha256(coalesce(txt, '')) AS text, txt IS NOT NULL AS indexed, why <> '' AS unverified, CASE WHEN NOT vision AND own IS NULL THEN 'NO_SOURCE' ELSE why END AS reason FROM t"""


def image_texts(spark, sf_dir):
    """Parts as images: the name as caption of two in three, else a reading of brand and type; those of size 50 and above are decorative."""
    p, size = read(spark, sf_dir, "part"), F.col("p_size")
    values = F.when(size % 4 == 0, F.split("p_type", " ")).when(size % 4 == 1, F.array().cast("array<string>")).otherwise(F.array("p_brand"))
    series = F.when(size % 5 != 0, F.split("p_name", " "))
    vision = F.when(size % 9 != 0, F.struct(F.col("p_type").alias("description"), (size / 30).alias("confidence"), values.alias("values"), series.alias("series")))
    block = G.image(F.lit("NATIVE"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).otherwise(F.lit(" ")), size >= 50, vision)
    return p.select("p_partkey", block.alias("b")).filter("b is not null").select(*_OUT("p_partkey", "b"))


IMAGE_SQL = f"""WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN nullif(trim(p_name), '') END AS own, p_type AS said, p_size / 30.0::DOUBLE AS c, CASE p_size % 4 WHEN 0 THEN string_split(p_type, ' ') WHEN 1 THEN [] ELSE [p_brand] END AS vals, p_size % 5 <> 0 AS named, p_size % 9 <> 0 AS vision FROM part WHERE p_size < 50),
w AS (SELECT *, own IS NULL AND vision AS used, CASE WHEN own IS NOT NULL OR NOT vision THEN '' ELSE {_DOUBT} END AS why FROM d),
t AS (SELECT *, CASE WHEN used THEN {_SEEN} ELSE own END AS txt FROM w)
SELECT p_partkey, CASE WHEN used THEN '{G.VISION}' ELSE 'NATIVE' END AS origin, sha256(coalesce(txt, '')) AS text, txt IS NOT NULL AS indexed, why <> '' AS unverified, CASE WHEN txt IS NULL THEN 'NO_SOURCE' ELSE why END AS reason FROM t"""


def formula_texts(spark, sf_dir):
    """The total of each order as a formula over its lines, with a variable a line; orders in state P were not recognised."""
    line = F.struct(F.col("l_linenumber").alias("no"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    o = read(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    symbol = lambda x: F.concat(F.lit("x"), x["no"].cast("string"))
    expression = F.when(F.col("o_orderstatus") != "P", F.array_join(F.transform("lines", symbol), " + "))
    variables = F.transform("lines", lambda x: F.struct(symbol(x).alias("symbol"), F.concat(x["cents"].cast("string"), F.lit(" cents")).alias("meaning")))
    name = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("total "), F.col("o_orderkey").cast("string")))
    block = G.formula(F.lit("NATIVE"), name, expression, variables, F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")))
    return o.select("o_orderkey", block.alias("b")).select(*_OUT("o_orderkey", "b"))


FORMULA_SQL = f"""WITH l AS (SELECT l_orderkey AS o_orderkey, list('x' || l_linenumber ORDER BY l_linenumber, c) AS s, list('x' || l_linenumber || '{G.MEANS}' || c || ' cents' ORDER BY l_linenumber, c) AS v FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem) GROUP BY 1),
d AS (SELECT o.o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN array_to_string(s, ' + ') END AS e, v, CASE WHEN o.o_orderkey % 5 <> 0 THEN '{G.FORMULA}total ' || o.o_orderkey END AS name, CASE WHEN o.o_orderkey % 2 = 0 THEN nullif(o_orderpriority, '') END AS context FROM orders o LEFT JOIN l USING (o_orderkey)),
t AS (SELECT *, CASE WHEN e IS NOT NULL THEN concat_ws(chr(10), name, e, CASE WHEN len(v) > 0 THEN '{G.VARIABLES}' || array_to_string(v, '{G.VALUES_BY}') END, context) END AS txt FROM d)
SELECT o_orderkey, 'NATIVE' AS origin, sha256(coalesce(txt, '')) AS text, txt IS NOT NULL AS indexed, false AS unverified, CASE WHEN e IS NULL THEN 'NOT_RECOGNISED' ELSE '' END AS reason FROM t"""


QUERIES = {"docs_chart_texts": (chart_texts, CHART_SQL), "docs_image_texts": (image_texts, IMAGE_SQL), "docs_formula_texts": (formula_texts, FORMULA_SQL)}
