"""Queries of page layout and task trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import layout as L
from tidemark.operators import trees as T
from tidemark.sources.tables import read, spread


def page_layout(spark, sf_dir):
    """Blocks of every page with their section path, from spans of its markup."""
    made = L.blocks(L.markup_spans(spread(read(spark, sf_dir, "pages"), "page_id")), "page_id")
    return made.select("page_id", "block", "kind", F.coalesce("level", F.lit(0)).alias("level"), F.sha2("path", 256).alias("path"), F.sha2("text", 256).alias("text"), F.col("y0"), F.col("y1"))


_IN = lambda names: ", ".join(f"'{n}'" for n in names)
_SIZE = " ".join(f"WHEN '{t}' THEN {p}" for t, p in L.SIZES.items())
LAYOUT_SQL = rf"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<[^>]*>|[^<]+')) AS part, generate_subscripts(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<[^>]*>|[^<]+'), 1) AS no FROM pages),
m AS (SELECT *, nullif(lower(regexp_extract(part, '^<([A-Za-z][A-Za-z0-9]*)', 1)), '') AS opened FROM t),
g AS (SELECT *, CASE WHEN opened NOT IN ({_IN(L.VOID)}) THEN opened END AS tag FROM m),
w AS (SELECT *, last_value(tag IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY no) AS within, sum(CASE WHEN tag IN ({_IN(L.BLOCK)}) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY no) AS breaks FROM g),
v AS (SELECT page_id, no, trim(part) AS text, CASE within {_SIZE} ELSE {L.BODY} END::DOUBLE AS size, breaks FROM w WHERE NOT starts_with(part, '<') AND trim(part) <> '' AND coalesce(within, '') NOT IN ({_IN(L.HIDDEN)})),
y AS (SELECT *, coalesce(sum(size + {L.LEADING}) OVER (PARTITION BY page_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + breaks * {L.SPACE} AS y0 FROM v),
b AS (SELECT page_id, size AS body FROM (SELECT page_id, size, sum(length(text)) AS chars FROM y GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY chars DESC, size) = 1),
l AS (SELECT y.*, y0 + size AS y1, CASE WHEN size / body >= 1.6 THEN 1 WHEN size / body >= 1.3 THEN 2 WHEN size / body >= 1.15 THEN 3 END AS level, row_number() OVER (PARTITION BY page_id ORDER BY round(CAST(y0 + size / 2 AS DOUBLE), 1), no) AS at_no FROM y JOIN b USING (page_id)),
n AS (SELECT *, CASE WHEN at_no = 1 OR level IS NOT NULL OR lag(level) OVER o IS NOT NULL OR y0 - lag(y1) OVER o > 1.5 * greatest(lag(size) OVER o, size) THEN 1 ELSE 0 END AS turn FROM l WINDOW o AS (PARTITION BY page_id ORDER BY at_no)),
k AS (SELECT *, sum(turn) OVER (PARTITION BY page_id ORDER BY at_no) AS block FROM n),
x AS (SELECT page_id, block, string_agg(text, ' ' ORDER BY at_no) AS text, min(level) AS level, min(y0) AS y0, max(y1) AS y1 FROM k GROUP BY 1, 2),
h AS (SELECT *, last_value(CASE WHEN level = 1 THEN {{'b': block, 't': text}} END IGNORE NULLS) OVER o AS h1, last_value(CASE WHEN level = 2 THEN {{'b': block, 't': text}} END IGNORE NULLS) OVER o AS h2, last_value(CASE WHEN level = 3 THEN {{'b': block, 't': text}} END IGNORE NULLS) OVER o AS h3 FROM x WINDOW o AS (PARTITION BY page_id ORDER BY block))
SELECT page_id, CAST(block AS INT) AS block, CASE WHEN level IS NULL THEN 'paragraph' ELSE 'heading' END AS kind, coalesce(level, 0) AS level,
sha256(concat_ws(' > ', h1.t, CASE WHEN h2.b > coalesce(h1.b, 0) THEN h2.t END, CASE WHEN h3.b > greatest(coalesce(h1.b, 0), coalesce(h2.b, 0)) THEN h3.t END)) AS path, sha256(text) AS text, y0, y1 FROM h"""


def task_rollup(spark, sf_dir):
    """Orders as a tree of tasks (the parent is half the number; two of five hundred name each other), with tasks, calls and cents of each subtree."""
    k = F.col("o_orderkey")
    parent = F.when(k % 500 == 251, k + 1).when(k % 500 == 252, k - 1).when(k > 0, F.floor(k / 2))
    calls = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("calls"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    tasks = read(spark, sf_dir, "orders").select(k.alias("id"), parent.alias("parent"), F.lit(1).cast("long").alias("tasks")).join(calls, "id", "left")
    out = T.rolled_up(tasks, ["tasks", "calls", "cents"])
    return out.select(F.col("id").alias("task_id"), *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("depth", "tasks", "calls", "cents")], "cyclic")


ROLLUP_SQL = """WITH RECURSIVE o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 500 = 251 THEN o_orderkey + 1 WHEN o_orderkey % 500 = 252 THEN o_orderkey - 1 WHEN o_orderkey > 0 THEN o_orderkey // 2 END AS p FROM orders),
t AS (SELECT o.id, q.id AS parent FROM o LEFT JOIN o q ON q.id = o.p),
c AS (SELECT l_orderkey AS id, count(*) AS calls, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1),
a(id, anc) AS (SELECT id, id FROM t UNION SELECT a.id, t.parent FROM a JOIN t ON t.id = a.anc WHERE t.parent IS NOT NULL),
rooted AS (SELECT a.id FROM a JOIN t ON t.id = a.anc WHERE t.parent IS NULL),
s AS (SELECT anc AS id, count(*) AS tasks, CAST(coalesce(sum(calls), 0) AS BIGINT) AS calls, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents FROM a LEFT JOIN c ON c.id = a.id WHERE a.id IN (SELECT id FROM rooted) GROUP BY 1),
d AS (SELECT id, count(*) - 1 AS depth FROM a GROUP BY 1)
SELECT t.id AS task_id, CASE WHEN r.id IS NULL THEN -1 ELSE d.depth END AS depth, CASE WHEN r.id IS NULL THEN -1 ELSE s.tasks END AS tasks, CASE WHEN r.id IS NULL THEN -1 ELSE s.calls END AS calls, CASE WHEN r.id IS NULL THEN -1 ELSE s.cents END AS cents, r.id IS NULL AS cyclic
FROM t LEFT JOIN rooted r ON r.id = t.id LEFT JOIN s ON s.id = t.id LEFT JOIN d ON d.id = t.id"""


QUERIES = {"docs_page_layout": (page_layout, LAYOUT_SQL), "records_task_rollup": (task_rollup, ROLLUP_SQL)}
