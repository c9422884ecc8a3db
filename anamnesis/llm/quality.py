"""Operator 7, a quality classifier on random-indexing word vectors.

Every word and every word shape (its pattern of capitals, small letters, digits and
signs, and whether it repeats the word before) has a sparse random index vector. Its
word vector is the sum of the index vectors found beside it anywhere in the corpus,
counted over all documents in whole numbers, so that no layout of the table changes them. A document is the mean of its words' vectors beside the
mean of its shapes' vectors. A network of two layers in numpy turns that into a
logit, and a temperature fitted on labelled rows apart makes it a probability.

The vocabulary is hashed to a fixed number of rows, so the vectors have one size at
any scale. The network learns from at most ``sample`` labelled documents.

Defined results: null, empty and blank texts have a zero vector, which gets a score
like any other; repeated rows are scored each on its own; a null id is never learned
from; labels that are null or unknown are ignored; with fewer than two classes of
labels every score is 0.5; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import materialise

WORDS, SHAPES, DIM, NONZERO, BLOCKS = 1 << 13, 1 << 11, 32, 2, 64
ROWS = WORDS + 2 * SHAPES  # words, shapes, and shapes of repeated words
RUNS = re.compile(r"(.)\1+")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each row, the dimensions of its index vector that aren't zero, and their signs."""
    rng = np.random.default_rng(77)
    return rng.integers(DIM, size=(ROWS, NONZERO)), rng.choice([-1.0, 1.0], size=(ROWS, NONZERO))


def shape(word: str) -> str:
    """Capitals, small letters and digits as A, a and 9, signs as they are; runs count once."""
    return RUNS.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word))


class Reader:
    """Rows of a text's words and shapes, with a bounded memo of words."""

    def __init__(self, limit: int = 300_000):
        self.limit, self.memo = limit, {}

    def rows(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        words = (text or "").split()
        out = []
        for w in words:
            k = memo.get(w)
            if k is None:
                k = memo[w] = zlib.crc32(w.strip(".,;:!?*#%&$").lower().encode("utf-8", "replace")) % WORDS << 16 | zlib.crc32(shape(w).encode("utf-8", "replace")) % SHAPES
            out.append(k)
        code = np.array(out, np.int64)
        word, form = code >> 16, code & 0xFFFF
        again = np.concatenate([[False], code[1:] == code[:-1]]) if len(code) else np.zeros(0, bool)
        return word, WORDS + form + SHAPES * again


def accumulate(total: np.ndarray, word: np.ndarray, form: np.ndarray, first: np.ndarray, at: np.ndarray, sign: np.ndarray) -> None:
    """Add to each item the index vectors of both items beside it on either side, and of its own word's shape.

    ``first`` marks the first word of each document, which has none before it.
    """
    if not len(word):
        return
    b = np.flatnonzero(~first)
    a = b - 1
    items, beside = [word, form], [form, form]
    for x, y in ((b, a), (a, b)):
        items += [word[x], word[x], form[x], form[x]]
        beside += [word[y], form[y], word[y], form[y]]
    items, beside = np.concatenate(items), np.concatenate(beside)
    for k in range(NONZERO):
        total += np.bincount(items * DIM + at[beside, k], sign[beside, k], ROWS * DIM).astype(np.int64)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit word vectors of all rows, gathered over the whole corpus; ROWS x DIM numbers at any scale."""
    size = ROWS // BLOCKS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, (at, sign), total = Reader(), index_vectors(), np.zeros(ROWS * DIM, np.int64)
        for batch in batches:
            words, forms, firsts, held = [], [], [], 0
            texts = batch.column(0).to_pylist()
            for i, text in enumerate(texts):
                w, f = reader.rows(text)
                words.append(w)
                forms.append(f)
                firsts.append(np.arange(len(w)) == 0)
                held += len(w)
                if held > 200_000 or i == len(texts) - 1:
                    accumulate(total, np.concatenate(words), np.concatenate(forms), np.concatenate(firsts), at, sign)
                    words, forms, firsts, held = [], [], [], 0
        if total.any():
            raw = total.reshape(BLOCKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([r.tobytes() for r in raw], pa.binary())], ["block", "raw"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[b] = sums.get(b, 0) + np.frombuffer(raw, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "raw"])

    parts = docs.select(text_col).mapInArrow(gather, "block int, raw binary")
    out = np.zeros((BLOCKS, size * DIM))
    for r in parts.repartition(16, "block").mapInArrow(add, "block int, raw binary").collect():
        out[r.block] = np.frombuffer(r.raw, np.int64)
    out = out.reshape(ROWS, DIM)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(rows: tuple[np.ndarray, np.ndarray], vectors: np.ndarray) -> np.ndarray:
    word, form = rows
    if not len(word):
        return np.zeros(2 * DIM, np.float32)
    return np.concatenate([np.bincount(x, minlength=ROWS)[y] @ vectors[y] / len(x) for x in (word, form) for y in (np.unique(x),)])


def gradients(w: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean logistic loss of the two layers ``w`` (weights, offsets, weights, offset)."""
    h = np.tanh(x @ w[0] + w[1])
    g = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y) / len(y)
    back = np.outer(g, w[2]) * (1 - h * h)
    return [x.T @ back, back.sum(0), h.T @ g, g.sum(keepdims=True)]


class Network:
    """Two layers with tanh between them, standardised inputs and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 5):
        rng = np.random.default_rng(seed)
        apart = rng.random(len(x)) < 0.2
        if len(np.unique(y[~apart])) < 2 or not apart.any():
            apart[:] = False
        self.mean, self.scale = x[~apart].mean(0), x[~apart].std(0) + 1e-3
        self.temperature = 1.0
        self.w = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
        moment, square, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        xs, ys = (x[~apart] - self.mean) / self.scale, y[~apart].astype(float)
        for _ in range(epochs):
            order = rng.permutation(len(xs))
            for i in range(0, len(xs), 256):
                a, b = xs[order[i : i + 256]], ys[order[i : i + 256]]
                t += 1
                for k, d in enumerate(gradients(self.w, a, b)):
                    d = d + 1e-4 * self.w[k]
                    moment[k] = 0.9 * moment[k] + 0.1 * d
                    square[k] = 0.999 * square[k] + 0.001 * d * d
                    self.w[k] = self.w[k] - 0.003 * (moment[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
        if apart.any():
            z, yt = self.logits(x[apart]), y[apart]
            losses = {t: np.logaddexp(0, np.where(yt == 1, -z, z) / t).mean() for t in np.geomspace(0.25, 8, 41)}
            self.temperature = float(min(losses, key=losses.get))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def pool_documents(docs: DataFrame, vectors: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, x array<float>): pooled document vectors."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        reader = Reader()
        for batch in batches:
            x = [pooled(reader.rows(t), shared.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32()))], [id_col, "x"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, x array<float>")


def fit(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> tuple[np.ndarray, Network | None]:
    """Word vectors over all documents, and a network from labelled ones for which the column ``learn(id)`` is true."""
    vectors = word_vectors(docs, text_col)
    given = labels.where(F.col(label_col).isin(0, 1) & learn(F.col(id_col))).groupBy(id_col).agg(F.max(label_col).alias("y"))
    given = given.join(docs.select(id_col).distinct(), id_col, "left_semi")
    chosen = materialise(given.orderBy(F.xxhash64(id_col), id_col).limit(sample), "labels")
    taught = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # ``sample`` ids at most
    rows = pool_documents(taught.select(id_col, text_col), vectors, id_col, text_col).dropDuplicates([id_col]).join(chosen, id_col).orderBy(id_col).select("x", "y").toPandas()
    if rows.y.nunique() < 2:
        return vectors, None
    return vectors, Network(np.stack(rows.x).astype(float), rows.y.to_numpy(np.int64))


def score(docs: DataFrame, model: tuple[np.ndarray, Network | None], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of good quality."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of one size at any scale

    def run(batches):
        reader, (vectors, network) = Reader(), shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if network is None or not texts:
                p = np.full(len(texts), 0.5)
            else:
                p = network.probabilities(np.stack([pooled(reader.rows(t), vectors) for t in texts]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def scorer(spark, model: tuple[np.ndarray, Network | None]):
    """A column function: the score of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader, (vectors, network) = Reader(), shared.value
        for texts in batches:
            if network is None or not len(texts):
                yield pd.Series(np.full(len(texts), 0.5))
            else:
                yield pd.Series(network.probabilities(np.stack([pooled(reader.rows(t), vectors) for t in texts])))

    return run
