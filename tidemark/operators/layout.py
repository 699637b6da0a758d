"""Layout of pages from spans: reading order, blocks by gap, headings by size, section paths; all windows over a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.records import join_wrapped

#: Gap between lines of one block in font sizes, and size ratios of headings of level 1, 2 and 3.
GAP, RATIOS = 1.5, (1.6, 1.3, 1.15)
#: Text of these elements is not shown; those that open no element of their own; those that begin a block.
HIDDEN, VOID, BLOCK = ["script", "style", "title"], ["br", "meta", "img", "hr"], ["p", "div", "h1", "h2", "h3", "li", "article", "footer", "nav", "ul", "table", "tr"]
#: Font sizes by element; any other is of body size.
SIZES, BODY = {"h1": 20.0, "h2": 16.0, "h3": 14.0, "b": 12.5, "a": 10.0, "li": 10.0, "footer": 10.0, "div": 10.0}, 12.0
LEADING, SPACE = 4.0, 24.0


def markup_spans(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Spans (key, no, text, size, x0, y0, y1) of a page's visible text: the element last opened gives the size, order and block elements the place. Comments are dropped; a null page has none."""
    clean = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    parts = pages.select(key, F.posexplode(F.regexp_extract_all(clean, F.lit(r"<[^>]*>|[^<]+"), F.lit(0))).alias("no", "part"))
    opened = F.lower(F.regexp_extract("part", r"^<([A-Za-z][A-Za-z0-9]*)", 1))
    marked = parts.withColumn("tag", F.when((opened != "") & ~opened.isin(VOID), opened))
    w = Window.partitionBy(key).orderBy("no")
    within = F.last("tag", ignorenulls=True).over(w)
    size = F.lit(BODY)
    for tag, points in SIZES.items():
        size = F.when(F.col("within") == tag, points).otherwise(size)
    shown = marked.withColumns({"within": within, "breaks": F.sum(F.coalesce(F.col("tag").isin(BLOCK), F.lit(False)).cast("int")).over(w)})
    shown = shown.filter(~F.col("part").startswith("<") & (F.trim("part") != "") & ~F.coalesce(F.col("within").isin(HIDDEN), F.lit(False))).withColumn("size", size)
    above = F.coalesce(F.sum(F.col("size") + LEADING).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.col("breaks") * SPACE
    return shown.select(key, "no", F.trim("part").alias("text"), "size", F.lit(0.0).alias("x0"), above.alias("y0"), (above + F.col("size")).alias("y1"))


def heading_level(size: Column, body: Column) -> Column:
    """1, 2 or 3 by how much larger than the body a span is; null for body text, and where there is no body size."""
    ratio = size / body
    return F.when(body <= 0, None).when(ratio >= RATIOS[0], 1).when(ratio >= RATIOS[1], 2).when(ratio >= RATIOS[2], 3)


def blocks(spans: DataFrame, key: str) -> DataFrame:
    """(key, block, kind, level, path, text, y0, y1) of spans(key, no, text, size, x0, y0, y1).

    Spans are read by vertical centre (to one place), then x0, then no; blank ones are left out. A heading
    is a block of its own and ends the one before; a body block ends where the gap to the next line
    exceeds GAP times the larger font size of the two. The body size is the one most characters have, of
    equal ones the smaller. path: the headings a block stands under, a heading of level n ending those of n
    and below. A page's spans are one window partition; pages are many.
    """
    seen = spans.filter(F.trim("text") != "")
    weight = seen.groupBy(key, "size").agg(F.sum(F.length(F.trim("text"))).alias("chars"))
    body = weight.groupBy(key).agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("body"))
    order = [F.round((F.col("y0") + F.col("y1")) / 2, 1), "x0", "no"]
    w = Window.partitionBy(key).orderBy(*order)
    lines = seen.join(body, key).withColumn("level", heading_level(F.col("size"), F.col("body"))).withColumn("at", F.row_number().over(w))
    o = Window.partitionBy(key).orderBy("at")
    gap = F.col("y0") - F.lag("y1").over(o) > GAP * F.greatest(F.lag("size").over(o), F.col("size"))
    turn = F.col("level").isNotNull() | F.coalesce(F.lag("level").over(o).isNotNull(), F.lit(False)) | F.coalesce(gap, F.lit(False)) | (F.col("at") == 1)
    numbered = lines.withColumn("turn", turn).withColumn("block", F.sum(F.col("turn").cast("int")).over(o))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    made = numbered.groupBy(key, "block").agg(join_wrapped(texts).alias("text"), F.min("level").alias("level"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    b = Window.partitionBy(key).orderBy("block")
    head = lambda n: F.last(F.when(F.col("level") == n, F.struct("block", "text")), ignorenulls=True).over(b)
    named = made.withColumns({f"h{n}": head(n) for n in (1, 2, 3)})
    place = lambda n: F.coalesce(F.col(f"h{n}.block"), F.lit(0))
    steps = [F.col("h1.text"), F.when(place(2) > place(1), F.col("h2.text")), F.when(place(3) > F.greatest(place(1), place(2)), F.col("h3.text"))]
    kind = F.when(F.col("level").isNull(), "paragraph").otherwise("heading")
    return named.select(key, F.col("block").cast("int").alias("block"), kind.alias("kind"), F.col("level").cast("int").alias("level"), F.concat_ws(" > ", *steps).alias("path"), "text", "y0", "y1")
