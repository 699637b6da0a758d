"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training: follow-the-regularised-leader (proximal, per coordinate) with elastic-net penalties on a
bounded sample, then one temperature fitted on rows the weights never saw. Document frequencies are
counted over all training rows. Scoring: one pass over Arrow batches with the weights broadcast
(2**bits x classes numbers, fixed whatever the corpus).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, text_table, uniform
from tidemark.llm.textnum import U, pieces

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """bits: hashed n-gram space. per_class: expected training rows of a language, fewer where all languages together would pass sample (the sample bound). l1, l2, alpha, beta: FTRL-proximal. calibration: share of the sample kept for the temperature."""

    bits: int = 15
    orders: tuple[int, ...] = (1, 2, 3)
    per_class: int = 1200
    sample: int = 300_000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3
    calibration: float = 0.25
    seed: int = 9


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # features x classes
    bias: np.ndarray
    idf: np.ndarray
    temperature: float


def folded(text: str) -> Iterator[str]:
    """The text lower-cased, between spaces, white space runs as one space, piece by piece; the pieces joined are the same wherever the text is cut."""
    space = True
    for piece in pieces(text):
        words = piece.lower().split()
        if words:
            yield (" " if space or piece[0].isspace() else "") + " ".join(words)
        space = piece[-1].isspace() if words else True
    yield " "


def _gram_counts(text: str, bits: int, orders: tuple[int, ...]) -> np.ndarray:
    """Counts of hashed character n-grams of the whole text."""
    counts = np.zeros(1 << bits, np.int64)
    most, before = max(orders), np.empty(0, U)
    for piece in folded(text):
        c = np.concatenate((before, np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)))
        h = np.zeros(len(c), U)
        for n in range(1, most + 1):
            if n > len(c):
                break
            h = h[: len(c) - n + 1] * U(0x100000001B3) + c[n - 1 :] + U(n)
            if n in orders:  # those that end in this piece
                new = h[max(0, len(before) - n + 1) :]
                counts += np.bincount(((new * U(0x9E3779B97F4A7C15)) >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
        before = c[len(c) - min(len(c), most - 1) :]
    return counts


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index = np.flatnonzero(counts)
    value = (1.0 + np.log(counts[index])) * idf[index]
    norm = float(np.sqrt(value @ value))
    return index, value / norm if norm else value


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


#: Tasks whose counts meet in one group of the first of two levels of sums.
MEET = 256


def document_frequencies(texts: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """(documents with each hashed n-gram, documents), over every text; null texts count as empty.

    Each task sums its own rows to 2**bits numbers, in blocks. Blocks are summed in two levels, by
    groups of about MEET tasks and then over the groups, so no group holds the counts of all tasks.
    """
    bits, orders, block = s.bits, s.orders, 1 << max(0, s.bits - 4)
    groups = max(1, -(-texts.rdd.getNumPartitions() // MEET))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                df += _gram_counts(text or "", bits, orders) > 0
                n += 1
        if n:
            yield pd.DataFrame({"block": range((1 << bits) // block), "part": TaskContext.get().partitionId() % groups, "n": n, "df": list(df.reshape(-1, block))})

    def total(group: pd.DataFrame) -> pd.DataFrame:
        first = group[["block", "part"]].iloc[:1].reset_index(drop=True)
        return first.assign(n=group["n"].sum(), df=[np.sum(np.stack(group["df"].to_numpy()), axis=0)])

    schema = "block int, part int, n long, df array<long>"
    sums = texts.select("text").mapInPandas(partial, schema).groupBy("block", "part").applyInPandas(total, schema)
    rows = sums.groupBy("block").applyInPandas(total, schema).orderBy("block").collect()
    return np.concatenate([r["df"] for r in rows]) if rows else np.zeros(1 << bits, np.int64), rows[0]["n"] if rows else 0


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal with L1 and L2, one example at a time."""
    d = 1 << s.bits
    z, n = np.zeros((d + 1, k)), np.zeros((d + 1, k))

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    order = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for j in order.permutation(len(rows)):
            index, value, y = rows[j]
            i, x = np.append(index, d), np.append(value, 1.0)
            w = weights(i)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(d + 1))
    return w[:d], w[d]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature in [0.05, 20] with the least log loss, by golden-section search on its logarithm; 1 without rows."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean())

    a, b, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(labelled: DataFrame, s: Settings = Settings()) -> Model:
    """A model from labelled(doc_id, text, lang); rows with null lang or text are left out.

    Every language found is learned. The sample is drawn by hash at a rate per language that expects
    s.per_class rows of it, so the driver gets about s.sample sparse vectors at most; the weights are
    2**bits numbers a language. Without any labelled row the model has no class and predicts UNKNOWN.
    """
    known = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    classes = sorted(counts)
    df, n_docs = document_frequencies(known, s)
    idf = np.log((1.0 + n_docs) / (1.0 + df)) + 1.0
    if not classes:
        return Model([], np.zeros((1 << s.bits, 0)), np.zeros(0), idf, 1.0)
    each = min(s.per_class, s.sample / len(classes))
    rates = labelled.sparkSession.createDataFrame([(c, min(1.0, each / counts[c])) for c in classes], "lang string, rate double")
    sample = known.join(F.broadcast(rates), "lang").filter(uniform("doc_id", s.seed) < F.col("rate")).select("doc_id", "text", "lang")
    bits, orders = s.bits, s.orders

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                c = _gram_counts(text, bits, orders)
                i = np.flatnonzero(c)
                out.append((i.astype("<u4").tobytes(), np.minimum(c[i], 2**31 - 1).astype("<u4").tobytes()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "idx": [x for x, _ in out], "cnt": [x for _, x in out]})

    got = sorted(sample.mapInPandas(features, "doc_id long, lang string, idx binary, cnt binary").collect(), key=lambda r: (r["doc_id"], r["lang"]))
    kept, held = [], []
    place = {c: i for i, c in enumerate(classes)}
    for at, r in enumerate(got):
        i = np.frombuffer(r["idx"], "<u4").astype(np.int64)
        v = (1.0 + np.log(np.frombuffer(r["cnt"], "<u4"))) * idf[i]
        norm = np.sqrt(v @ v)
        (held if at % max(2, round(1 / s.calibration)) == 0 and len(got) > 20 else kept).append((i, v / norm if norm else v, place[r["lang"]]))
    weights, bias = _ftrl(kept, len(classes), s)
    logits = np.array([x @ weights[i] + bias for i, x, _ in held]).reshape(len(held), len(classes))
    return Model(classes, weights, bias, idf, _temperature(logits, np.array([y for *_, y in held], int)))


def identify(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced).

    A null text, or one without a letter, gets UNKNOWN with score 0. Ties go to the first class in
    code-point order. Scores are calibrated probabilities of the class given.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.classes, model.weights.astype(np.float64), model.bias, model.idf, model.temperature))
    bits, orders = s.bits, s.orders

    def predict(text: str | None, m: tuple) -> tuple[str, float]:
        classes, weights, bias, idf, temperature = m
        if text is None or not classes or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        i, x = _vector(_gram_counts(text, bits, orders), idf)
        p = _softmax((x @ weights[i] + bias) / temperature)
        best = int(p.argmax())
        return classes[best], float(p[best])

    @F.pandas_udf("lang_pred string, score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([predict(t, m) for t in texts], columns=["lang_pred", "score"])

    got = max([*docs.columns, "id"], key=len) + "_"  # a name that docs does not have
    marked = docs.withColumn(got, scored(F.col("text")))
    return marked.withColumns({"lang_pred": marked[got]["lang_pred"], "score": marked[got]["score"]}).drop(got)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir)
    held = fold("doc_id", 4) == 2
    model = train(docs.filter(~held))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
