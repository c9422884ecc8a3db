"""Operator 10, document fingerprints by order MinHash.

For each of ``slots`` hash functions, the ``depth`` least k-mers of a text are
selected, where a k-mer's repeats are told apart by their occurrence numbers. The
selected k-mers are put back into text order and hashed together to one slot of the
fingerprint. Moving or replacing text changes which k-mers are selected and their
order, so the share of equal slots falls with the edit distance.

Defined results: a null text counts as empty; all texts shorter than a k-mer count
as one k-mer; equal texts have equal fingerprints; ids may be of any type that can be ordered; repeated ids are ordered by the
text's hash; nulls come last in descending order; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import materialise

K, DEPTH, SLOTS, BLOCK = 8, 2, 64, 8192
_RNG = np.random.default_rng(10)
FACTORS = _RNG.integers(1 << 62, size=SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the public splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(text: str) -> np.ndarray:
    """A 64-bit hash of each k-mer of code points, in text order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < K:
        c = np.concatenate([c, np.full(K - len(c), 0x110000 + len(c), np.uint64)])
    n = len(c) - K + 1
    h = np.zeros(n, np.uint64)
    for i in range(K):
        h *= BASE
        h += c[i : i + n]
    return mix(h)


def numbered(h: np.ndarray) -> np.ndarray:
    """Each k-mer's hash together with its occurrence number."""
    n = len(h)
    mask = np.uint64((1 << max(1, (n - 1).bit_length())) - 1)
    packed = np.sort(h & ~mask | np.arange(n, dtype=np.uint64))
    same = np.concatenate([[False], (packed[1:] & ~mask) == (packed[:-1] & ~mask)])
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(same, 0, at))
    occurrence = np.zeros(n, np.uint64)
    occurrence[(packed & mask).astype(np.int64)] = at - first
    return mix(h + occurrence * BASE)


def signature(text: str | None) -> np.ndarray:
    """The fingerprint's slots, 16 bits each."""
    h = kmers(text or "")
    u = numbered(h)
    least, place = [], []
    for a in range(0, len(u), BLOCK):
        grid = FACTORS[:, None] * u[a : a + BLOCK]
        for _ in range(min(DEPTH, grid.shape[1])):
            i = grid.argmin(1)[:, None]
            least.append(np.take_along_axis(grid, i, 1))
            place.append(i + a)
            np.put_along_axis(grid, i, np.uint64(0xFFFFFFFFFFFFFFFF), 1)
    least, place = np.hstack(least), np.hstack(place)
    if least.shape[1] > DEPTH:
        place = np.take_along_axis(place, np.argsort(least, axis=1, kind="stable")[:, :DEPTH], 1)
    place = np.sort(place, axis=1)
    out = np.arange(1, SLOTS + 1, dtype=np.uint64)
    for j in range(place.shape[1]):
        out = mix(out * BASE + h[place[:, j]])
    return (out >> np.uint64(48)).astype(np.uint16)


def written(slots: np.ndarray) -> str:
    return slots.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal slots."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the following text's start."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(text: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
    other = edited(text, following)
    sig = own if other == text else signature(other)
    return len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), written(own), written(sig), likeness(own, sig), likeness(own, its)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint): of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([written(signature(t)) for t in batch.column(1).to_pylist()], pa.string())], [id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint against that of its edited form and of the next document by descending id.

    Documents are range-partitioned by id once. Within a partition each meets its follower in the sorted stream; the
    first and the last document of each partition are kept with their texts, and the last ones are finished afterwards.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [id_col, *(c.split()[0] for c in COLUMNS.split(", ")), "part", "role", "text", "raw"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string(), pa.binary()]
    # ties go by the text's hash; equal rows may follow each other in any order, so a hot one is spread over partitions
    chosen = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row"))
    order = [F.desc(id_col), F.xxhash64("text"), F.col("_row")]
    dealt = chosen.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_row")

    def table_of(key: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [key, *types])], names[: len(rows[0])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        blank = (None,) * 6
        for batch in batches:
            rows, key = [], batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = signature(text)
                if before is None:
                    rows.append((i, *blank, part, "head", text, own.tobytes()))
                else:
                    j, t, s = before
                    rows.append((j, *_row(t, s, text, own), part, None, None, None))
                before = i, text, own
            if rows:
                yield table_of(key, rows)
        if before is not None:
            i, text, own = before
            yield table_of(key, [(i, *blank, part, "tail", text, own.tobytes())])

    schema = f"`{id_col}` {kind}, {COLUMNS}, part int, role string, text string, raw binary"
    found = materialise(dealt.mapInArrow(run, schema), "fingerprints")
    heads = found.where("role = 'head'")
    order = Window.orderBy("part")  # a number per partition of the step above
    first = F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follower = heads.select("part").select("part", F.coalesce(F.lead("part").over(order), first).alias("after"))
    texts = heads.select(F.col("part").alias("after"), F.col("text").alias("text2"), F.col("raw").alias("raw2"))
    open_rows = found.where("role = 'tail'").join(follower, "part").join(texts, "after").select(id_col, "text", "raw", "text2", "raw2")

    def finish(batches):
        for batch in batches:
            rows = []
            for i, t, s, other, its in zip(*(batch.column(k).to_pylist() for k in range(5))):
                rows.append((i, *_row(t, np.frombuffer(s, np.uint16), other, np.frombuffer(its, np.uint16))))
            if rows:
                yield table_of(batch.schema.field(0).type, rows)

    last = open_rows.mapInArrow(finish, f"`{id_col}` {kind}, {COLUMNS}")
    return found.where("role is null").select(names[:7]).union(last)
