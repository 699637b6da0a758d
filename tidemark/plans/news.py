"""News queries: documents, events and the entity dictionary of sectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import news as N
from tidemark.sources.tables import CUTOFF_US, NEWS_SQL, news_documents, read

_USE = f"CASE WHEN observed_us > {CUTOFF_US} THEN 'EXCLUDED' WHEN published_us IS NULL THEN 'BACKGROUND' WHEN published_us > {CUTOFF_US} THEN 'EXCLUDED' ELSE 'EVIDENCE' END"
_N = f"WITH {NEWS_SQL}, used AS (SELECT *, {_USE} AS use FROM news)"


def _used(spark, sf_dir):
    return news_documents(spark, sf_dir).withColumn("use", N.use_at(F.col("published_us"), F.col("observed_us"), F.lit(CUTOFF_US)))


def as_of_class(spark, sf_dir):
    return _used(spark, sf_dir).select("doc_id", F.coalesce("published_us", F.lit(-1)).alias("published_us"), "observed_us", "use")


AS_OF_SQL = f"{_N} SELECT doc_id, coalesce(published_us, -1) AS published_us, observed_us, use FROM used"


def use_counts(spark, sf_dir):
    return _used(spark, sf_dir).groupBy("source").agg(*[F.count_if(F.col("use") == u).alias(u.lower()) for u in (N.EVIDENCE, N.BACKGROUND, N.EXCLUDED)])


COUNTS_SQL = f"{_N} SELECT source, count(*) FILTER (use = 'EVIDENCE') AS evidence, count(*) FILTER (use = 'BACKGROUND') AS background, count(*) FILTER (use = 'EXCLUDED') AS excluded FROM used GROUP BY 1"


def normalized_titles(spark, sf_dir):
    return news_documents(spark, sf_dir).select("doc_id", N.normalized_title(F.col("title")).alias("norm"))


TITLES_SQL = rf"WITH {NEWS_SQL} SELECT doc_id, lower(regexp_replace(title, '[^\p{{L}}\p{{N}}_]', '', 'g')) AS norm FROM news"


def exact_events(spark, sf_dir):
    """Every document with the event of its exact copies."""
    d = news_documents(spark, sf_dir)
    out = N.cluster_members(d, N.exact_clusters(d))
    return out.select("doc_id", "event_id", "title", F.coalesce("first_us", F.lit(-1)).alias("first_us"), "size", "leads")


_FIRST = "ORDER BY published_us IS NULL, published_us, doc_id"
EVENTS_SQL = f"""WITH {NEWS_SQL}, g AS (SELECT content_hash, count(*) AS size, string_agg(content_hash, '|') AS hashes, first(title {_FIRST}) AS title, first(published_us {_FIRST}) AS first_us, first(doc_id {_FIRST}) AS first_id FROM news GROUP BY 1)
SELECT doc_id, 'event-' || substr(sha256(hashes), 1, 24) AS event_id, g.title, coalesce(first_us, -1) AS first_us, size, doc_id = first_id AS leads FROM news JOIN g USING (content_hash)"""


def similar_titles(spark, sf_dir):
    """Greedy clusters of similar titles over all documents."""
    return N.similar_title_clusters(news_documents(spark, sf_dir).filter("doc_id is not null"), [])


def _entities(spark, sf_dir):
    """Part types and name words as terms of brands: the dictionary of sector entities."""
    part = read(spark, sf_dir, "part")
    types = part.select(F.col("p_brand").alias("sector_id"), F.col("p_type").alias("term"), F.lit(2).alias("confidence"), F.lit(1).alias("ordinal"))
    words = part.select(F.col("p_brand").alias("sector_id"), F.explode(F.split("p_name", " ")).alias("term"), F.lit(1).alias("confidence"), F.lit(2).alias("ordinal"))
    extra = part.select(F.col("p_brand").alias("sector_id"), F.substring_index("p_brand", "#", -1).alias("n"))
    short = extra.select("sector_id", F.element_at(F.array(*map(F.lit, ["the", "der", "est", "que", "of the"])), (F.col("n").cast("int") % 5 + 1)).alias("term"), F.lit(3).alias("confidence"), F.lit(0).alias("ordinal"))
    out = types.union(words).union(short).distinct()
    return out.withColumn("reason", F.concat_ws(":", F.element_at(F.array(F.lit("code"), F.lit("name"), F.lit("term")), F.col("ordinal") + 1), "term"))


ENTITIES_SQL = """ent AS (SELECT DISTINCT * FROM (SELECT p_brand AS sector_id, p_type AS term, 2 AS confidence, 1 AS ordinal FROM part
UNION ALL SELECT p_brand, unnest(string_split(p_name, ' ')), 1, 2 FROM part
UNION ALL SELECT p_brand, (['the', 'der', 'est', 'que', 'of the'])[CAST(split_part(p_brand, '#', 2) AS INT) % 5 + 1], 3, 0 FROM part)),
entities AS (SELECT *, (['code', 'name', 'term'])[ordinal + 1] || ':' || term AS reason FROM ent)"""


def sector_links(spark, sf_dir):
    docs = news_documents(spark, sf_dir).select(F.col("doc_id").alias("event_id"), "text")
    return N.sector_links(docs, _entities(spark, sf_dir))


LINKS_SQL = f"""WITH {NEWS_SQL}, {ENTITIES_SQL}, low AS (SELECT doc_id, lower(text) AS text FROM news),
hits AS (SELECT doc_id AS event_id, sector_id, confidence, ordinal, reason FROM low JOIN entities ON contains(text, lower(term)))
SELECT event_id, sector_id, confidence, reason FROM hits QUALIFY row_number() OVER (PARTITION BY event_id, sector_id ORDER BY confidence DESC, ordinal, reason) = 1"""


def news_per_sector(spark, sf_dir):
    links = sector_links(spark, sf_dir)
    return links.groupBy("sector_id").agg(F.countDistinct("event_id").alias("events"), F.max("confidence").alias("best"))


PER_SECTOR_SQL = f"WITH links AS ({LINKS_SQL}) SELECT sector_id, count(DISTINCT event_id) AS events, max(confidence) AS best FROM links GROUP BY 1"


def event_partition(spark, sf_dir):
    return N.tri_partition(_used(spark, sf_dir), "story")


PARTITION_SQL = f"{_N} SELECT story, CASE WHEN bool_or(use = 'EXCLUDED') THEN 'EXCLUDED' WHEN bool_or(use = 'EVIDENCE') THEN 'EVIDENCE' ELSE 'BACKGROUND' END AS use FROM used GROUP BY 1"


def attribution(spark, sf_dir):
    used = _used(spark, sf_dir).withColumn("eligible", F.col("use") == N.EVIDENCE)
    facts = used.groupBy("story").agg(
        (F.min("published_us") + 1000000000).alias("move_us"),
        ((F.col("story") % 10) / 10).cast("double").alias("breadth_ratio"),
        (F.col("story") % 7 == 0).alias("broad_market"),
    )
    docs = used.filter(F.col("use") != N.EXCLUDED).select("story", "published_us", "source_grade", "citation_url", "eligible")
    gate = N.attribution_gate(docs, ["story"], facts)
    return gate.select("story", "max_level", F.array_join("reasons", ",").alias("reasons"))


ATTRIBUTION_SQL = f"""{_N}, facts AS (SELECT story, min(published_us) + 1000000000 AS move_us, story % 10 / 10 AS breadth, story % 7 = 0 AS broad FROM used GROUP BY story),
d AS (SELECT *, use = 'EVIDENCE' AS eligible FROM used WHERE use <> 'EXCLUDED'),
a AS (SELECT f.story, breadth, broad, coalesce(bool_or(eligible), false) AS any_, coalesce(bool_or(eligible IS NOT NULL AND published_us IS NULL), false) AS undated,
coalesce(bool_or(eligible AND published_us IS NOT NULL AND source_grade = 'DISCOVERY_ONLY' AND citation_url IS NULL), false) AS thin,
coalesce(bool_or(eligible AND published_us IS NOT NULL AND published_us > move_us), false) AS after_, coalesce(bool_or(eligible AND published_us IS NOT NULL AND source_grade = 'PRIMARY'), false) AS prim
FROM facts f LEFT JOIN d ON d.story = f.story GROUP BY ALL),
l AS (SELECT *, least(3, CASE WHEN NOT any_ THEN 0 ELSE 3 END, CASE WHEN undated OR thin OR after_ THEN 1 ELSE 3 END, CASE WHEN breadth < 0.5 OR broad THEN 2 ELSE 3 END) AS lv FROM a)
SELECT story, (['NO_RELIABLE_EXPLANATION', 'MARKET_ASSOCIATION', 'POSSIBLE_CATALYST', 'EXPLICIT_DRIVER'])[CASE WHEN lv = 3 AND NOT prim THEN 2 ELSE lv END + 1] AS max_level,
array_to_string(list_filter([CASE WHEN NOT any_ THEN 'NO_ELIGIBLE_EVENT' END, CASE WHEN undated THEN 'MISSING_PUBLICATION_TIME' END, CASE WHEN thin THEN 'DISCOVERY_ONLY_WITHOUT_CITATION' END, CASE WHEN after_ THEN 'EVENT_AFTER_MARKET_MOVE' END,
CASE WHEN breadth < 0.5 THEN 'INSUFFICIENT_SECTOR_BREADTH' END, CASE WHEN broad THEN 'BROAD_MARKET_ALTERNATIVE' END, CASE WHEN lv = 3 AND NOT prim THEN 'NO_PRIMARY_SOURCE' END], lambda x: x IS NOT NULL), ',') AS reasons FROM l"""


def _calls(spark, sf_dir):
    """Source calls: one per event; the source is the user's shard, attempts and documents come from the props."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "EMPTY").when((F.col("event_type") == "view") & (F.col("user_id") % 4 == 0), "PARTIAL").otherwise("SUCCESS")
    return e.select(
        F.concat(F.lit("src"), F.col("user_id") % 12).alias("source_id"),
        us.alias("started_us"),
        (us + k * 1000).alias("completed_us"),
        (k % 3 + 1).alias("attempts"),
        (k % 11).alias("documents"),
        k.alias("duration_ms"),
        status.alias("status"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("E"), k % 3)).alias("error"),
    )


CALLS_SQL = """calls AS (SELECT 'src' || (user_id % 12) AS source_id, epoch_us(ts) AS started_us, epoch_us(ts) + k * 1000 AS completed_us, k % 3 + 1 AS attempts, k % 11 AS documents, k AS duration_ms,
CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'signup' THEN 'EMPTY' WHEN event_type = 'view' AND user_id % 4 = 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status,
CASE WHEN event_type = 'error' THEN 'E' || (k % 3) END AS error FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def source_metrics(spark, sf_dir):
    return N.source_metrics(_calls(spark, sf_dir))


METRICS_SQL = f"""WITH {CALLS_SQL}, m AS (SELECT source_id, min(started_us) AS started_us, max(completed_us) AS completed_us, CAST(sum(attempts) AS BIGINT) AS calls, CAST(sum(greatest(attempts - 1, 0)) AS BIGINT) AS retries, CAST(sum(documents) AS BIGINT) AS documents, CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
count(DISTINCT status) AS ns, min(status) AS s1, bool_and(status IN ('SUCCESS', 'EMPTY')) AS good, count(DISTINCT error) AS ne, min(error) AS e1 FROM calls GROUP BY 1)
SELECT source_id, started_us, completed_us, calls, retries, documents, duration_ms, CASE WHEN ns = 1 THEN s1 WHEN good THEN 'SUCCESS' ELSE 'PARTIAL' END AS status, CASE WHEN ne = 1 THEN e1 WHEN ne > 1 THEN 'MULTIPLE_SOURCE_ERRORS' END AS error FROM m"""


def acquisition(spark, sf_dir):
    return N.acquisition_pivot(_calls(spark, sf_dir))


_STATUS_SQL = ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in N.STATUSES)
ACQUISITION_SQL = f"WITH {CALLS_SQL} SELECT source_id, count(*) AS calls, {_STATUS_SQL}, CAST(sum(documents) AS BIGINT) AS documents, coalesce(string_agg(DISTINCT error, ',' ORDER BY error), '') AS errors FROM calls GROUP BY 1"


def quality_gate(spark, sf_dir):
    per_source = source_metrics(spark, sf_dir).select("source_id", "status")
    return N.quality_gate(_used(spark, sf_dir), per_source, ["src0", "src1"])


QUALITY_SQL = f"""{_N}, {CALLS_SQL}, m AS (SELECT source_id, CASE WHEN count(DISTINCT status) = 1 THEN min(status) WHEN bool_and(status IN ('SUCCESS', 'EMPTY')) THEN 'SUCCESS' ELSE 'PARTIAL' END AS status FROM calls GROUP BY 1),
c AS (SELECT count(*) FILTER (use = 'EVIDENCE') AS evidence, count(*) FILTER (use = 'BACKGROUND') AS background, count(*) FILTER (use = 'EXCLUDED') AS excluded FROM used),
d AS (SELECT count(*) FILTER (status IN ('FAILED', 'UNAVAILABLE') AND source_id IN ('src0', 'src1')) AS cd, count(*) FILTER (status IN ('FAILED', 'UNAVAILABLE')) AS dn FROM m)
SELECT evidence, background, excluded, CASE WHEN excluded > 0 OR cd >= 2 THEN 'BLOCKED' WHEN dn > 0 THEN 'DEGRADED' ELSE 'NORMAL' END AS status, CASE WHEN excluded > 0 THEN 'CUTOFF_VIOLATION' WHEN cd >= 2 THEN 'CORE_SOURCES_UNAVAILABLE' END AS code FROM c, d"""


def rates(spark, sf_dir):
    """Deduplication rate and links per event."""
    events = N.exact_clusters(news_documents(spark, sf_dir)).agg(F.count("*").alias("events"), F.sum("size").alias("docs"))
    links = sector_links(spark, sf_dir).agg(F.count("*").alias("links"))
    e, d, n = (F.col(c).cast("double") for c in ("events", "docs", "links"))
    return events.join(links).select("events", "docs", "links", F.when(d > 0, 1.0 - e / d).otherwise(0.0).alias("dedup_rate"), F.when(e > 0, n / e).otherwise(0.0).alias("mapping_rate"))


RATES_SQL = f"""WITH l AS ({LINKS_SQL}), e AS ({EVENTS_SQL}), s AS (SELECT count(*) AS events, CAST(sum(size) AS BIGINT) AS docs FROM e WHERE leads), k AS (SELECT count(*) AS links FROM l)
SELECT events, docs, links, 1.0 - CAST(events AS DOUBLE) / CAST(docs AS DOUBLE) AS dedup_rate, CAST(links AS DOUBLE) / CAST(events AS DOUBLE) AS mapping_rate FROM s, k"""


def query_plan(spark, sf_dir):
    """Budgeted sub-queries of each market segment: customer nations as names, phone codes as codes."""
    c = read(spark, sf_dir, "customer")
    names = c.select("c_mktsegment", F.lit("KEYWORD").alias("query_type"), F.concat(F.lit(" Nation "), F.col("c_nationkey")).alias("value"), F.lit(90).alias("priority"))
    alias = c.select("c_mktsegment", F.lit("KEYWORD").alias("query_type"), F.concat(F.lit("nation "), F.col("c_nationkey")).alias("value"), F.lit(80).alias("priority"))
    codes = c.select("c_mktsegment", F.lit("DISCLOSURE").alias("query_type"), F.lpad((F.col("c_custkey") % 40).cast("string"), 6, "0").alias("value"), F.lit(60).alias("priority"))
    keyword = N.budgeted(names.union(alias).distinct(), ["c_mktsegment", "query_type"], 24)
    code = N.budgeted(codes.distinct(), ["c_mktsegment", "query_type"], 12)
    plan = keyword.union(code)
    return plan.select("c_mktsegment", "query_type", "value", "priority", "ordinal", F.substring(F.sha2(F.concat_ws("|", "c_mktsegment", "query_type", "value"), 256), 1, 24).alias("query_id"))


PLAN_SQL = """WITH q AS (SELECT DISTINCT c_mktsegment, 'KEYWORD' AS query_type, ' Nation ' || c_nationkey AS value, 90 AS priority FROM customer UNION SELECT c_mktsegment, 'KEYWORD', 'nation ' || c_nationkey, 80 FROM customer
UNION SELECT c_mktsegment, 'DISCLOSURE', lpad(CAST(c_custkey % 40 AS VARCHAR), 6, '0'), 60 FROM customer),
o AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY c_mktsegment, query_type, lower(trim(value)) ORDER BY priority DESC, value) = 1),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_mktsegment, query_type ORDER BY priority DESC, value) AS INT) AS ordinal FROM o)
SELECT *, substr(sha256(c_mktsegment || '|' || query_type || '|' || value), 1, 24) AS query_id FROM r WHERE ordinal <= CASE query_type WHEN 'KEYWORD' THEN 24 ELSE 12 END"""


def urls(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", N.canonical_url(url).alias("canonical"), N.allowed_url(url, ["blog.ththan.example.net", "ththnt.example.com"]).alias("allowed"), N.safe_url(url).alias("safe"))


URLS_SQL = r"""SELECT page_id, lower(regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)) || regexp_replace(substr(url, length(regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)) + 1), '#.*$', '') AS canonical,
coalesce(lower(regexp_replace(regexp_extract(url, '^https://([^/?#]*)', 1), ':443$', '')) IN ('blog.ththan.example.net', 'ththnt.example.com') AND NOT contains(regexp_extract(url, '^https://([^/?#]*)', 1), '@'), false) AS allowed,
CASE WHEN regexp_matches(url, '(?i)^https?://[^/?#\s]+') THEN url END AS safe FROM pages"""


def locator_rewrite(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace(N.canonical_url(F.col("url")), r"\?.*$", "").alias("locator"))
    return N.rewrite_locators(pages, "locator", "page_id").select("page_id", "locator", "canonical_id")


REWRITE_SQL = r"""WITH p AS (SELECT page_id, regexp_replace(canonical, '\?.*$', '') AS locator FROM (""" + URLS_SQL + """))
SELECT page_id, locator, min(page_id) OVER (PARTITION BY locator) AS canonical_id FROM p"""


def content_kinds(spark, sf_dir):
    d = news_documents(spark, sf_dir)
    summary = F.when(F.col("doc_id") % 4 != 0, F.col("title"))
    return d.groupBy(N.content_kind(summary, F.col("source"), "src0").alias("content_kind"), "source_grade").agg(F.count("*").alias("n"))


KINDS_SQL = f"""WITH {NEWS_SQL} SELECT CASE WHEN doc_id % 4 <> 0 AND length(trim(coalesce(title, ''))) > 0 THEN CASE WHEN source = 'src0' THEN 'FLASH' ELSE 'SUMMARY' END ELSE 'LINK_ONLY' END AS content_kind, source_grade, count(*) AS n FROM news GROUP BY 1, 2"""


def recent_research(spark, sf_dir):
    """F8: per source the first ten documents in arrival order that are not excluded and no older than seven days before the cutoff."""
    from tidemark.operators.market import ranked

    week = F.col("published_us").isNull() | (F.col("published_us") >= CUTOFF_US - 7 * 86400000000)
    return ranked(_used(spark, sf_dir).filter((F.col("use") != N.EXCLUDED) & week), [F.asc("doc_id")], ["source"], 10, "ordinal").select("source", "doc_id", "use", "ordinal")


RECENT_SQL = f"{_N} SELECT source, doc_id, use, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS ordinal FROM used WHERE use <> 'EXCLUDED' AND (published_us IS NULL OR published_us >= {CUTOFF_US - 7 * 86400000000}) QUALIFY ordinal <= 10"


def upserted(spark, sf_dir):
    """Failed orders replace their rows with status X, then parts of new keys are inserted where absent."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = o.filter("o_orderkey % 10 = 3").withColumn("o_orderstatus", F.lit("X"))
    more = o.filter("o_orderkey % 10 = 4").select((F.col("o_orderkey") * 2).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"))
    return N.insert_ignore(N.upsert(o, new, ["o_orderkey"]), more, ["o_orderkey"])


UPSERT_SQL = """WITH u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders)
SELECT * FROM u UNION ALL SELECT o_orderkey * 2, 'N' FROM orders WHERE o_orderkey % 10 = 4 AND o_orderkey * 2 NOT IN (SELECT o_orderkey FROM u)"""


QUERIES = {
    "news_as_of_class": (as_of_class, AS_OF_SQL),
    "news_use_counts": (use_counts, COUNTS_SQL),
    "news_normalized_titles": (normalized_titles, TITLES_SQL),
    "news_exact_events": (exact_events, EVENTS_SQL),
    "news_similar_titles": (similar_titles, None),
    "news_sector_links": (sector_links, LINKS_SQL),
    "news_per_sector": (news_per_sector, PER_SECTOR_SQL),
    "news_event_partition": (event_partition, PARTITION_SQL),
    "news_attribution_gate": (attribution, ATTRIBUTION_SQL),
    "news_source_metrics": (source_metrics, METRICS_SQL),
    "news_acquisition_pivot": (acquisition, ACQUISITION_SQL),
    "news_quality_gate": (quality_gate, QUALITY_SQL),
    "news_rates": (rates, RATES_SQL),
    "news_query_plan": (query_plan, PLAN_SQL),
    "news_urls": (urls, URLS_SQL),
    "news_locator_rewrite": (locator_rewrite, REWRITE_SQL),
    "news_content_kinds": (content_kinds, KINDS_SQL),
    "news_recent_research": (recent_research, RECENT_SQL),
    "store_upsert": (upserted, UPSERT_SQL),
}
