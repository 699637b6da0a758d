"""SentencePiece encoding and decoding over a shared-prefix Viterbi pass.

Texts are cut into marked words (a run of the space mark and the characters up to the next mark);
no piece holds a mark behind another character, so words encode independently. The distinct words
of an Arrow batch are sorted, which lays them out as a trie walked depth-first: a word keeps the
forward scores and states of the prefix that it shares with the word before it and adds only its own
tail. The best path is read back from the end.

The recurrence is best[at] = max over pieces ending at `at` of best[before] + score. For unigram
models every piece may follow any other. For BPE models scores are merge ranks, and merging leaves
only certain pieces side by side, so a piece may extend a prefix only if merging its text behind
that prefix's last piece gives exactly these two. One piece at most passes that test, so the
first that does is the maximum, and the path is what merging gives.

Words that a worker has met before are looked up instead; that memory is bounded.
"""

from __future__ import annotations

import gc
import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import text_table

MODEL = os.environ.get("TIDEMARK_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"


class Vocabulary:
    """Pieces with scores and the special ids of a model; small (its own size, whatever the corpus) and sent to the tasks."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int], unknown: int, kind: str, dummy_prefix: bool = True):
        self.ids = {p: i for p, i, _ in pieces}
        self.scores = {p: s for p, _, s in pieces}
        self.byte_ids, self.unknown, self.kind, self.dummy_prefix = byte_ids, unknown, kind, dummy_prefix
        self.name = hashlib.sha256(repr((pieces, byte_ids, unknown, kind, dummy_prefix)).encode()).hexdigest()

    @classmethod
    def load(cls, path: str = MODEL, kind: str = "bpe") -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        plain = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        return cls(plain, [i for i in every if sp.is_byte(i)], sp.unk_id(), kind)

    def bytes_of(self) -> dict[int, bytes]:
        out = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()}
        return out | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}


class Automaton:
    """Which pieces end at a character, found in one step a character: the trie of all pieces with links to the longest proper suffix that is also in it; steps over links are kept once taken."""

    def __init__(self, pieces: list[str]):
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, ...]] = [()]  # numbers of the pieces that end here, longest first
        self.link = [0]
        for number, piece in enumerate(pieces):
            at = 0
            for c in piece:
                to = self.step[at].get(c)
                if to is None:
                    to = self.step[at][c] = len(self.step)
                    self.step.append({})
                    self.ends.append(())
                    self.link.append(0)
                at = to
            if len(piece) > 1:
                self.ends[at] = (number,)
        level = list(self.step[0].values())
        while level:
            below = []
            for at in level:
                for c, to in list(self.step[at].items()):
                    self.link[to] = self.next(self.link[at], c)
                    self.ends[to] += self.ends[self.link[to]]
                    below.append(to)
            level = below

    def next(self, at: int, c: str) -> int:
        came = at
        while True:
            to = self.step[at].get(c)
            if to is not None:
                break
            if not at:
                to = 0
                break
            at = self.link[at]
        if came != at and came:
            self.step[came][c] = to
        return to


class Encoder:
    """Encodes words; the forward scores of a prefix shared with the word before are kept, so sorted words cost only their own tails. Pair checks and words met are kept up to a bound."""

    PAIRS = 400_000
    WORDS = 600_000

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.pieces = list(v.ids)
        self.number = {p: i for i, p in enumerate(self.pieces)}
        self.size = [len(p) for p in self.pieces]
        self.ident = [v.ids[p] for p in self.pieces]
        self.score = [v.scores[p] for p in self.pieces]
        self.floor = min(self.score, default=0.0) - 10.0
        self.automaton = Automaton(self.pieces)
        # by automaton state: (number, size, score) of the pieces that end there, longest first
        self.ending = [tuple((p, self.size[p], self.score[p]) for p in at) for at in self.automaton.ends]
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.computed = 0
        self.forget()

    def forget(self) -> None:
        """No word is known: words has those met, and by their numbers reach has where a word's ids end in pool, path the score of its path."""
        self.words = pa.array([], pa.binary())
        self.pool, self.reach, self.path = array("i"), array("q", [0]), array("d")

    def numbers(self, distinct: pa.Array) -> np.ndarray:
        """The numbers of distinct words (spaces for marks); new ones are sorted, in byte order, which is code-point order, and encoded."""
        if len(self.words) > self.WORDS:
            self.forget()
        new = distinct.filter(pc.is_null(pc.index_in(distinct, value_set=self.words))).to_pylist()
        new.sort()
        for ids, score in self.encode([w.decode("utf-8", "replace").replace(" ", MARK) for w in new]):
            self.pool.extend(ids)
            self.reach.append(len(self.pool))
            self.path.append(score)
        self.words = pa.concat_arrays([self.words, pa.array(new, pa.binary())])
        return pc.index_in(distinct, value_set=self.words).to_numpy(zero_copy_only=False)

    def merged(self, text: str) -> list[str]:
        """Pieces by merging, highest score first, leftmost first among equals."""
        parts, scores = list(text), self.v.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces gives exactly these two; -1 merges with nothing."""
        got = self.whole.get(right)
        if got is None:
            got = self.whole[right] = self.merged(self.pieces[right]) == [self.pieces[right]]
        if left < 0 or not got:
            return got
        a, b = self.pieces[left], self.pieces[right]
        return self.merged(a + b) == [a, b]

    def encode(self, words: list[str]) -> Iterator[tuple[list[int], float]]:
        """(ids, score of their path) of each of the marked words, which should be sorted: the trie is walked depth-first, and a word adds only what it does not share with the one before."""
        pairs, steps, ending, number, score, floor = self.pairs, self.automaton.step, self.ending, self.number, self.score, self.floor
        unigram, wide, size, ident = self.v.kind == "unigram", len(self.size), self.size, self.ident
        state, last, best = [0], [-1], [0.0]  # after each prefix: the automaton, the number of the last piece (-1: none), the best score
        for word, shared in zip(words, shared_prefixes(words), strict=True):
            del state[shared + 1 :], last[shared + 1 :], best[shared + 1 :]
            if len(pairs) > self.PAIRS:
                pairs.clear()
            at_state, at = state[shared], shared
            for c in word[shared:] if shared else word:
                at += 1
                try:
                    at_state = steps[at_state][c]
                except KeyError:
                    at_state = self.automaton.next(at_state, c)
                chosen, top = -1, 0.0
                for p, n, gain in ending[at_state]:
                    if unigram:
                        s = best[at - n] + gain
                        if chosen < 0 or s > top:
                            top, chosen = s, p
                        continue
                    pair = last[at - n] * wide + p
                    try:
                        good = pairs[pair]
                    except KeyError:
                        good = pairs[pair] = self.stands(last[at - n], p)
                    if good:
                        top, chosen = best[at - n] + gain, p
                        break
                if unigram or chosen < 0:  # the character by itself
                    alone = number.get(c, -1)
                    s = best[at - 1] + (score[alone] if alone >= 0 else floor)
                    if chosen < 0 or s >= top:
                        top, chosen = s, alone
                state.append(at_state)
                best.append(top)
                last.append(chosen)
            self.computed += at - shared
            out = []
            while at:
                p = last[at]
                if p >= 0:
                    out.append(ident[p])
                    at -= size[p]
                    continue
                if self.v.byte_ids:
                    out += [self.v.byte_ids[b] for b in reversed(word[at - 1].encode("utf-8", "surrogatepass"))]
                else:
                    out.append(self.v.unknown)
                at -= 1
            out.reverse()
            yield out, best[-1]


def shared_prefixes(words: list[str]) -> list[int]:
    """How many characters each word shares with the one before it."""
    if not words:
        return []
    length = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum(length) - length
    both = np.minimum(length[1:], length[:-1])
    out, open_, at = np.zeros(len(words), np.int64), np.flatnonzero(both > 0), 0
    while len(open_):
        open_ = open_[text[start[open_ + 1] + at] == text[start[open_] + at]]
        at += 1
        out[open_ + 1] = at
        open_ = open_[both[open_] > at]
    return out.tolist()


def marked_words(texts: pa.Array, dummy_prefix: bool = True) -> tuple[pa.Array, np.ndarray]:
    """(all words of the texts in a row, words before each text and in all): space marks (as spaces), then characters up to the next mark; joined they give the marked text. None for a null or empty text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        texts = pc.replace_substring(texts, MARK, " ")
    if dummy_prefix:
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    raw = texts.buffers()[2] if len(texts) else None
    size = int(ends[-1])
    space = np.frombuffer(raw, np.uint8, size) == 32 if size else np.zeros(0, bool)
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[ends[:-1][np.diff(ends) > 0]] = True
    at = np.flatnonzero(starts).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, np.int32(size)).astype(np.int32)), raw or pa.py_buffer(b"")])
    return words, np.searchsorted(at, ends)


_ENCODERS: dict[str, Encoder] = {}


def worker_encoder(vocabulary: Vocabulary) -> Encoder:
    """This Python worker's encoder of a vocabulary; one is kept until release_encoders."""
    if vocabulary.name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.name] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.name]


def release_encoders() -> None:
    """Gives back what encoders hold, as workers live on and serve other stages."""
    _ENCODERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def encode_batch(column: pa.Array, encoder: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts in a row, where each text's ids begin and the last end, score of each text's path)."""
    words, bounds = marked_words(column, encoder.v.dummy_prefix)
    coded = words.dictionary_encode()
    number = encoder.numbers(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    pool, reach, path = np.array(encoder.pool, np.int32), np.array(encoder.reach, np.int64), np.array(encoder.path, np.float64)
    start, each = reach[number], (reach[1:] - reach[:-1])[number]
    first = np.concatenate(([0], np.cumsum(each)))
    ids = pool[np.arange(first[-1]) + np.repeat(start - first[:-1], each)]
    sums = np.concatenate(([0.0], np.cumsum(path[number])))
    return ids, first[bounds], np.diff(sums[bounds])


def decode_batch(ids: np.ndarray, bounds: np.ndarray, pieces: pa.Array, dummy_prefix: bool = True) -> pa.Array:
    """The texts that ids stand for, without the space put in front: the pieces' bytes, one behind the other, are the texts'. Bytes that are no UTF-8 become replacement characters."""
    taken = pieces.take(pa.array(ids, pa.int32()))
    ends = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1) if len(taken) else np.zeros(1, np.int32)
    raw = (taken.buffers()[2] if len(taken) else None) or pa.py_buffer(b"")
    texts = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends[bounds])), raw])
    if dummy_prefix:
        texts = pc.if_else(pc.starts_with(texts, b" "), pc.binary_replace_slice(texts, 0, 1, b""), texts)
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def byte_table(v: Vocabulary) -> pa.Array:
    """The bytes of every id; none for control ids."""
    known = v.bytes_of()
    out = [b""] * (max([v.unknown, *known]) + 1)
    out[v.unknown] = " ⁇ ".encode()
    for i, b in known.items():
        out[i] = b
    return pa.array(out, pa.binary())


#: Bytes of the texts that share a trie.
BATCH_BYTES = 3_000_000


def text_runs(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in runs of about most bytes of text: small batches are joined, large ones cut; a longer text is a run of its own."""
    held, total = [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        run_of = np.cumsum(size) // most
        starts = np.flatnonzero(np.diff(run_of, prepend=-1))
        for at, end in zip(starts, [*starts[1:], len(size)], strict=True):
            if held and total + int(size[at:end].sum()) > most:
                yield joined()
                held, total = [], 0
            held.append(batch.slice(at, end - at))
            total += int(size[at:end].sum())
    if held:
        yield joined()


def _list(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", decoded: str | None = None) -> DataFrame:
    """docs with piece_ids (array of int), the whole text's ids, and path_score, the sum of their scores; columns of these names are replaced. None and 0 for a null or empty text; repeated rows are encoded alike.

    decoded: a column for the text that the ids stand for, decoded from them in the same pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    out = docs.drop("piece_ids", "path_score", *([decoded] if decoded else []))
    more = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("path_score", T.DoubleType())]
    more += [T.StructField(decoded, T.StringType())] if decoded else []
    schema = T.StructType([*out.schema.fields, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = worker_encoder(shared.value), byte_table(shared.value) if decoded else None
        for part in text_runs(batches, text, BATCH_BYTES):
            ids, bounds, score = encode_batch(part.column(part.schema.get_field_index(text)), encoder)
            made = [_list(ids, bounds), pa.array(score, pa.float64())]
            if decoded:
                made.append(decode_batch(ids, bounds, pieces, shared.value.dummy_prefix))
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *(f.name for f in more)])
        del encoder
        release_encoders()

    return out.mapInArrow(run, schema)


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """docs with the text that ids stand for (a column of that name is replaced); bytes that are no UTF-8 become replacement characters, a null array an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    out = docs.drop(into)
    schema = T.StructType([*out.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, dummy = byte_table(shared.value), shared.value.dummy_prefix
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            values = pc.list_flatten(column).to_numpy(zero_copy_only=False)
            texts = decode_batch(values, np.concatenate(([0], np.cumsum(length))), pieces, dummy)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, into])

    return out.mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, path_score, piece_ids, decoded_sha256 (of the text decoded from the ids) and exact: whether that is the text itself."""
    docs = text_table(spark, sf_dir).select("doc_id", "text")
    back = encode(docs, Vocabulary.load(), decoded="decoded")
    exact = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))
    return back.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "path_score", "piece_ids", F.sha2("decoded", 256).alias("decoded_sha256"), exact.alias("exact"))
