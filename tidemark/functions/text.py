"""Text functions as columns: token counts, bigrams, coverage, sentences, tokens, hashes, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters counted one by one: CJK ideographs, kana, hangul.
CJK = r"[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]"


def approx_tokens(text: Column) -> Column:
    """CJK characters, plus runs of other non-space characters."""
    return F.regexp_count(text, F.lit(CJK)) + F.regexp_count(F.regexp_replace(text, CJK, " "), F.lit(r"\S+"))


def folded(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(folded(text), 256)


def bigrams(text: Column) -> Column:
    """The set of two-character runs without white space, in order of first appearance; one character is its own."""
    chars = F.filter(F.split(F.regexp_replace(text, r"\s+", ""), ""), lambda c: c != "")

    def runs(cs: Column) -> Column:  # bound once, so the text is split once
        pairs = F.transform(F.slice(cs, F.lit(1), F.size(cs) - 1), lambda c, i: F.concat(c, F.element_at(cs, i + 2)))
        return F.when(F.size(cs) < 2, cs).otherwise(F.array_distinct(pairs))

    return F.transform(F.array(chars), runs)[0]


def coverage(a: Column, b: Column) -> Column:
    """Share of the shorter text's bigrams that the longer one has; 0 for an empty one."""
    x, y = bigrams(F.when(F.length(a) <= F.length(b), a).otherwise(b)), bigrams(F.when(F.length(a) <= F.length(b), b).otherwise(a))
    return F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)).cast("double") / F.size(x).cast("double"))


def overlap_score(query: Column, document: Column) -> Column:
    """Share of the query's bigrams in the document."""
    q = bigrams(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, bigrams(document))).cast("double") / F.size(q).cast("double"))


def sentences(text: Column) -> Column:
    """Trimmed, non-blank sentences: cut behind 。！？!?； and ; and at newlines; a full stop does not end one."""
    parts = F.transform(F.split(text, "(?<=[。！？!?；;])|\n"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def search_tokens(text: Column) -> Column:
    """Tokens for lexical search: lower-cased runs; a run with CJK gives its bigrams."""
    runs = F.array_remove(F.split(F.lower(text), r"\s+"), "")
    mixed = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(CJK), bigrams(r)).otherwise(F.array(r))))
    return F.when(text.rlike(CJK), mixed).otherwise(runs)  # a text without CJK is only split


def numbers(text: Column) -> Column:
    """All signed decimal numbers, as exact decimals."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([-+]?\d+(?:\.\d+)?)"), 1), lambda x: x.cast("decimal(38,10)"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 when either is zero, null when lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))


def canonical_json(*columns: str) -> Column:
    """One JSON object with sorted keys; nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def fingerprint(rows: Column) -> Column:
    """A digest of a set of rows: their sorted canonical forms."""
    return F.sha2(F.array_join(F.array_sort(rows), "\n"), 256)
