"""Fill-in-middle transformation with a piece table.

A document is a list of descriptors (buffer, start, size) over two immutable buffers: its UTF-8 text and
the sentinels. Cutting splits a descriptor, an arrangement permutes the descriptors with those of the
sentinels between them, and the inverse permutation restores the text. Digests are fed descriptor by
descriptor, so an output need not be built to be hashed; the output column is there for those who want it.

A unit is white space with the word behind it, or white space at the end. Cuts and form are drawn from
the digest of seed and doc_id, so they depend on neither partitions nor reruns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_table

TEXT, MARKS = 0, 1
#: The sentinel buffer, and where each sentinel is in it.
SENTINELS = b"<P><S><M>"
PREFIX, SUFFIX, MIDDLE = (MARKS, 0, 3), (MARKS, 3, 3), (MARKS, 6, 3)
#: Of the three text pieces in document order (prefix, middle, suffix), which one follows which sentinel.
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}

Piece = tuple[int, int, int]


@dataclass(frozen=True)
class Settings:
    """seed: of the draws. rate: how many of 100 documents are rearranged; spm: how many of 100 of these put the suffix first."""

    seed: int = 42
    rate: int = 50
    spm: int = 80


@dataclass
class PieceTable:
    """Descriptors over the text buffer and the sentinel buffer."""

    text: bytes
    pieces: list[Piece]

    @classmethod
    def of(cls, text: bytes) -> PieceTable:
        return cls(text, [(TEXT, 0, len(text))])

    def cut(self, *offsets: int) -> PieceTable:
        """Split at offsets of what the table stands for; a cut at an edge gives an empty piece."""
        todo, pieces, begun = sorted(offsets, reverse=True), [], 0
        for buffer, start, size in self.pieces:
            used = 0
            while todo and todo[-1] - begun <= size:
                at = todo.pop() - begun
                pieces.append((buffer, start + used, at - used))
                used = at
            pieces.append((buffer, start + used, size - used))
            begun += size
        return PieceTable(self.text, pieces)

    def arrange(self, form: str) -> PieceTable:
        """The three pieces in the order of a form, each behind its sentinel."""
        return PieceTable(self.text, [piece for mark, k in ORDERS[form] for piece in (mark, self.pieces[k])])

    def restore(self, form: str) -> PieceTable:
        """The inverse of arrange: text pieces in document order, without sentinels."""
        back = sorted((k, self.pieces[2 * at + 1]) for at, (_, k) in enumerate(ORDERS[form]))
        return PieceTable(self.text, [piece for _, piece in back])

    def views(self) -> Iterator[memoryview]:
        buffers = (memoryview(self.text), memoryview(SENTINELS))
        for buffer, start, size in self.pieces:
            yield buffers[buffer][start : start + size]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.views():
            digest.update(view)
        return digest.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.views())


def unit_ends(raw: bytes) -> np.ndarray:
    """Where the units of a text end, in bytes: behind each word that white space follows, and at the end."""
    if not raw:
        return np.zeros(0, np.int64)
    a = np.frombuffer(raw, np.uint8)
    space = (a == 32) | ((a >= 9) & (a <= 13))
    return np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(a))


def code_points(raw: memoryview | bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)) if len(raw) else 0


def transform(raw: bytes, draws: tuple[int, int, int, int], s: Settings) -> tuple[int, str, PieceTable, int | None, int | None]:
    """(units, form, arranged table, code points of prefix and of middle) of one text."""
    ends = unit_ends(raw)
    n = len(ends)
    if not raw or any(SENTINELS[at : at + size] in raw for _, at, size in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= s.rate:
        return n, "plain", PieceTable.of(raw), None, None
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    table = PieceTable.of(raw).cut(*(int(ends[k - 1]) if k else 0 for k in (first, second)))
    prefix, middle, _ = table.views()
    form = "spm" if draws[3] % 100 < s.spm else "psm"
    return n, form, table.arrange(form), code_points(prefix), code_points(middle)


def parse(output: bytes, form: str) -> PieceTable:
    """The table of an output: its sentinels, found in the order of the form, are descriptors of the sentinel buffer again.

    The parts hold no sentinel and no sentinel overlaps another, so the first match of each is the right one.
    """
    if form == "plain":
        return PieceTable.of(output)
    marks = [mark for mark, _ in ORDERS[form]]
    at, found = 0, []
    for _, start, size in marks:
        at = output.index(SENTINELS[start : start + size], at)
        found.append(at)
        at += size
    if found[0]:
        raise ValueError("an output begins with a sentinel")
    edges = [*found, len(output)]
    return PieceTable(output, [p for mark, a, b in zip(marks, edges, edges[1:], strict=False) for p in (mark, (TEXT, a + mark[2], b - a - mark[2]))])


def rebuilt(output: bytes, form: str) -> PieceTable:
    """The document as descriptors over its output."""
    return parse(output, form) if form == "plain" else parse(output, form).restore(form)


def draws(doc_id: Column, s: Settings) -> Column:
    """The first four numbers of 32 bits in the sha256 of seed and doc_id; a null doc_id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


SCHEMA = "n long, form string, prefix_chars long, middle_chars long, pieces array<struct<buffer: int, start: long, size: long>>, output string, output_sha256 string"


def fill_in_middle(docs: DataFrame, s: Settings = Settings(), output: bool = True) -> DataFrame:
    """doc_id, n units, form, prefix_chars, middle_chars, pieces (the arranged table), output and output_sha256 of docs(doc_id, text).

    Null and empty texts have no unit and stay plain, as do texts that hold a sentinel. A text of white
    space is one unit. Rows with the same doc_id are drawn alike, repeated rows give repeated rows; a
    null doc_id counts as an empty one. A text of any length is cut whole: beside its bytes a task
    holds one output. An empty table gives no rows; other columns are ignored. With output=False that
    column is null and nothing is built.
    """
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"), draws(F.col("doc_id"), s).alias("draws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("size", pa.int64())]))
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text, drawn in zip(batch.column("text"), batch.column("draws").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                n, form, table, prefix, middle = transform(raw, tuple(drawn), s)
                made = table.bytes() if output else None
                pieces = [{"buffer": b, "start": a, "size": z} for b, a, z in table.pieces]
                for col, value in zip(cols, (n, form, prefix, middle, pieces, made, table.sha256()), strict=True):
                    col.append(value)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), kinds, pa.binary(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            arrays[5] = arrays[5].cast(pa.string())
            names = ["n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])

    return plain.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def restore(outputs: DataFrame, text: bool = True) -> DataFrame:
    """outputs(form, output, ...) with restored_sha256 and restored (null unless text), rebuilt from output and form alone.

    A null output is an empty one; an output whose sentinels are missing is an error.
    """
    kept = [f for f in outputs.schema if f.name not in ("restored", "restored_sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = [rebuilt(o.as_buffer().to_pybytes() if o.is_valid else b"", f) for o, f in zip(batch.column("output"), batch.column("form").to_pylist(), strict=True)]
            restored = pa.array([t.bytes() if text else None for t in tables], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), restored, pa.array([t.sha256() for t in tables], pa.string())], [*(f.name for f in kept), "restored", "restored_sha256"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["restored string", "restored_sha256 string"])
    return outputs.select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, schema)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(text_table(spark, sf_dir)).drop("pieces"), text=False)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op13_sql() -> str:
    return r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  sha256('42:' || CAST(doc_id AS VARCHAR)) AS d FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""
