"""Quality classifier: supervised subword embeddings.

Words, the character n-grams inside them, and the patterns in which words repeat are hashed to rows
of a learned embedding table, a document is the average of its rows, and a softmax layer reads the
average; both are trained together by stochastic gradient descent in numpy on a bounded labelled
sample. The average is linear, so scoring needs one number per hashed row (its embedding times the
output layer) and one pass over the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, table, text_table, uniform
from tidemark.llm.textnum import U, mix, pieces, word_hashes

THRESHOLD = 0.3
#: A word's repetition: how many words back, up to this many, the same word last stood (0: it did not).
BACK = 4

@dataclass(frozen=True)
class Settings:
    """bits: rows of the embedding table. orders: lengths of character n-grams. sample: expected training documents (the sample bound, whatever the number of labels)."""

    bits: int = 15
    dims: int = 12
    orders: tuple[int, ...] = (3, 4)
    sample: int = 3000
    epochs: int = 6
    rate: float = 1.0
    seed: int = 1


@dataclass
class Model:
    embedding: np.ndarray  # rows x dims
    output: np.ndarray  # dims x 2
    bias: np.ndarray

    def margins(self) -> tuple[np.ndarray, float]:
        """The logit of label 1 less that of label 0: per row, and of a document without rows."""
        return self.embedding @ (self.output[:, 1] - self.output[:, 0]), float(self.bias[1] - self.bias[0])


def repetitions(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each word's repetition, the repetitions of a word and the two before it as one number)."""
    back = np.zeros(len(words), np.int64)
    for k in range(BACK, 0, -1):
        back[k:][words[k:] == words[:-k]] = k
    pattern = back.copy()
    for k in (1, 2):
        pattern = pattern * (BACK + 1)
        pattern[k:] += back[: max(0, len(back) - k)]
    return back, pattern


def feature_rows(text: str, bits: int, orders: tuple[int, ...]) -> Iterator[np.ndarray]:
    """The hashed rows of all words, their repetitions, and in-word character n-grams (word edges marked by a space) of the whole text, piece by piece. Case and punctuation count.

    Pieces end between words and repetitions look back over them, so where a text is cut changes
    nothing; only a word of more characters than a piece has counts as several.
    """
    before = np.empty(0, U)
    for piece in pieces(text):
        c = np.frombuffer((" " + " ".join(piece.split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        space = c == 32
        if space.all():
            continue
        words = word_hashes(c, space)
        yield (words >> U(64 - bits)).astype(np.int64)
        seen = np.concatenate((before, words))
        for kind, value in enumerate(repetitions(seen)):
            yield (mix(value[len(before) :].astype(U) * U(2) + U(kind)) >> U(64 - bits)).astype(np.int64)
        before = seen[-(BACK + 2) :]
        v, spaces = c.astype(U), np.concatenate(([0], np.cumsum(space)))
        for n in orders:
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, U)
            for k in range(n):
                h = h * U(0x100000001B3) + v[k : len(c) - n + 1 + k]
            inner = spaces[n - 1 : len(c)] - spaces[1 : len(c) - n + 2]  # spaces strictly inside the n-gram
            yield (mix(h[inner == 0]) >> U(64 - bits)).astype(np.int64)


def _counts(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(1 << s.bits, np.int64)
    for rows in feature_rows(text, s.bits, s.orders):
        total += np.bincount(rows, minlength=1 << s.bits)
    index = np.flatnonzero(total)
    return index, total[index]


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> Model:
    """Embeddings and output layer by stochastic gradient descent; examples: rows, their counts, label. No examples: every score is 0.5."""
    random = np.random.default_rng(s.seed)
    model = Model(random.uniform(-1 / s.dims, 1 / s.dims, (1 << s.bits, s.dims)), np.zeros((s.dims, 2)), np.zeros(2))
    steps, done = max(1, s.epochs * len(examples)), 0
    for _ in range(s.epochs):
        for j in random.permutation(len(examples)):
            index, count, y = examples[j]
            rate = s.rate * (1 - done / steps)
            done += 1
            share = count / max(1, count.sum())
            hidden = share @ model.embedding[index]
            z = hidden @ model.output + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1.0
            back = model.output @ p
            model.output -= rate * np.outer(hidden, p)
            model.bias -= 0.1 * rate * p
            model.embedding[index] -= (rate * len(index) ** 0.5) * share[:, None] * back
    return model


def train(labelled: DataFrame, s: Settings = Settings()) -> Model:
    """A model from labelled(doc_id, text, label 0 or 1); rows with a null or other label are left out, a null text is an empty one.

    The sample is drawn by a hash of doc_id at a rate that expects s.sample rows, so classes keep
    their shares and the driver gets at most about s.sample sparse vectors of 2**bits entries.
    """
    known = labelled.filter("label in (0, 1)").select("doc_id", "text", "label")
    n = known.count()
    sample = known.filter(uniform("doc_id", s.seed) < min(1.0, s.sample / max(1, n)))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [_counts(t or "", s) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "idx": [i.astype("<u2" if s.bits <= 16 else "<u4").tobytes() for i, _ in got], "cnt": [c.astype("<f4").tobytes() for _, c in got]})

    rows = sorted(sample.mapInPandas(features, "doc_id long, label int, idx binary, cnt binary").collect(), key=lambda r: (r["doc_id"], r["label"]))
    kind = "<u2" if s.bits <= 16 else "<u4"
    return fit([(np.frombuffer(r["idx"], kind).astype(np.int64), np.frombuffer(r["cnt"], "<f4").astype(float), r["label"]) for r in rows], s)


def score(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """docs with score (probability of label 1) and predicted (score >= THRESHOLD) added; columns of these names are replaced. Null and empty texts get the score of no features."""
    margins, bias = model.margins()
    shared = docs.sparkSession.sparkContext.broadcast((margins, bias))
    bits, orders = s.bits, s.orders

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        by_row, alone = shared.value
        out = []
        for text in texts:
            total, n = 0.0, 0
            for rows in feature_rows(text or "", bits, orders):
                total += float(by_row[rows].sum())
                n += len(rows)
            out.append(1.0 / (1.0 + np.exp(-np.clip(alone + total / max(1, n), -700, 700))))
        return pd.Series(out, dtype=float)

    return docs.withColumn("score", probability("text")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that have a quality label and are not in the held-out fold; of several labels of a document the least counts."""
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    return docs.select("doc_id", "text").filter(fold("doc_id", 5) != 0).join(marks, "doc_id")


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir)
    model = train(labelled(docs, table(spark, sf_dir, "labels")))
    return score(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
