"""Operator 1, mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' ids, which go out ``quantum`` at a time. A queue
earns credit in proportion to its weight, and the next quantum always comes from the queue
with the largest unpaid credit, so every window holds each source's share to within a quantum
and what a window can't pay is carried into the next. By default the weights are the
corpus's own token shares, under which all queues run dry together; other weights hold
until a queue is empty, whose share the rest then split. A larger quantum cuts documents
less often and holds the mixture less evenly within a window, but as well over windows.

The schedule has a closed form. Quantum j of queue s is due at virtual time
(j + 1/2) / weight(s), and quanta go out in the order of (due time, queue). Hence the
number of ids that go out before a quantum follows from the queues' totals alone, with one
division for each queue. Weights are whole numbers (scaled, and rounded to about nine digits of
the largest), so that order is exact: all tasks agree on it to the last id. A
partition needs no more than where its documents start in their queues: partial sums of
a small table of totals by (block, queue). So partitions cut their documents
independently and yet carry deficits on exactly as one long loop would; no text or id is shuffled.

The work is quanta times queues, in numpy. Every task gets a total and a weight for each queue, so the queues
should number thousands rather than millions: a source per host, not per page.

Windows hold exactly ``window`` ids. What is left at the end goes into sequences
whose lengths are falling powers of two, so nothing is padded at all.

Defined results: a null text counts as empty and gives the end id alone; rows with
a null source form one queue; repeated rows are packed each on its own; an empty
table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import materialise
from .wordpiece import ChunkTable, portions, vocabulary

#: Rows of the table of totals by (block, queue) up to which it is broadcast; it is joined by shuffling beyond.
BROADCAST_ROWS = 200_000

#: Quanta that are placed at once.
PORTION = 500_000


class Schedule:
    """Where each quantum of each queue goes."""

    def __init__(self, totals: list[int], weights: list[float] | None = None, window: int = 2048, quantum: int = 1):
        self.totals = np.array(totals, np.int64)
        given = self.totals.astype(float) if weights is None else np.array(weights, float)
        if len(given) != len(self.totals) or not (given[self.totals > 0] > 0).all() or not np.isfinite(given).all():
            raise ValueError("each queue that has ids needs a positive weight")
        if quantum < 1 or window < 1:
            raise ValueError("a quantum and a window have at least one id")
        self.window, self.quantum, self.total = window, quantum, int(self.totals.sum())
        self.quanta = -(-self.totals // quantum)
        # whole weights such that (2j + 1) * weight stays below 2 ** 62 for every quantum j
        bits = min(30, 61 - int(2 * self.quanta.max(initial=0) + 1).bit_length())
        self.weights = np.maximum(np.rint(given / max(given.max(initial=0.0), 1e-300) * (1 << bits)), 1).astype(np.int64)
        full, rest = divmod(self.total, window)
        powers = [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1]
        self.full, self.tail = full, full * window + np.cumsum([0, *powers])
        self.sequences = full + len(powers)

    def ends(self, w: np.ndarray) -> np.ndarray:
        """Ids before sequence w, over all queues."""
        return np.where(w <= self.full, w * self.window, self.tail[np.clip(w - self.full, 0, len(self.tail) - 1)])

    def sequence(self, at: np.ndarray) -> np.ndarray:
        """The sequence of the ids at these places of the order of all ids."""
        return np.where(at < self.full * self.window, at // self.window, self.full + np.searchsorted(self.tail, at, "right") - 1)

    def places(self, queue: np.ndarray, number: np.ndarray) -> np.ndarray:
        """How many ids, of all queues, go out before each of these quanta."""
        out = np.empty(len(queue), np.int64)
        portion = max(1, 1_000_000 // len(self.totals))
        order = np.argsort(queue, kind="stable")
        bounds = np.flatnonzero(np.diff(queue[order], prepend=-1)).tolist() + [len(order)]
        for a, b in zip(bounds, bounds[1:]):
            s = int(queue[order[a]])
            later = (np.arange(len(self.totals)) >= s).astype(np.int64)  # of quanta that are due together, the lower queue's goes first
            for x in range(a, b, portion):
                rows = order[x : min(b, x + portion)]
                # quantum k of queue t is due earlier if (2k + 1) * weight(s) < (2 * number + 1) * weight(t)
                due = (2 * number[rows, None] + 1) * self.weights - later
                due //= self.weights[s]
                due += 1
                due //= 2
                np.minimum(due, self.quanta, out=due)
                due *= self.quantum
                out[rows] = np.minimum(due, self.totals, out=due).sum(1)
        return out

    def cut(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, from, count, sequence, offset) of the pieces of each row, a stretch of a queue with at least one id; a row's pieces are in order."""
        q = self.quantum
        row, number = _spread(start // q, (start + length - 1) // q)
        begin = np.maximum(number * q, start[row])
        count = np.minimum((number + 1) * q, (start + length)[row]) - begin
        at = self.places(queue[row], number) + begin - number * q
        part, sequence = _spread(self.sequence(at), self.sequence(at + count - 1))  # borders of sequences cut once more
        edges = self.ends(sequence)
        low, high = np.maximum(at[part], edges), np.minimum((at + count)[part], self.ends(sequence + 1))
        row, begin, offset, count = row[part], (begin - at)[part] + low - start[row[part]], low - edges, high - low
        # what goes on where the piece before it ended belongs to that piece
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (sequence[1:] != sequence[:-1]) | (offset[1:] != offset[:-1] + count[:-1])
        first = np.flatnonzero(fresh)
        return row[first], begin[first], np.add.reduceat(count, first), sequence[first], offset[first]


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) for every value from ``first`` to ``last`` of each index."""
    n = last - first + 1
    index = np.repeat(np.arange(len(n)), n)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n) + first[index]


@cache
def _table(vocab_path: str) -> ChunkTable:
    return ChunkTable(vocabulary(vocab_path).merge)


def tokenise(docs: DataFrame, vocab_path: str, id_col: str, text_col: str, source_col: str, end_id: int) -> DataFrame:
    """Each document's ids as bytes (unsigned 16-bit, little-endian), its block and where it starts in the block's part of its queue."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, done, table = TaskContext.get().partitionId(), {}, _table(vocab_path)
        for batch in batches:
            keys, texts, sources = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in portions(texts):
                flat, n = table.encode(texts[a:b])
                ids = np.insert(flat, np.cumsum(n), end_id).astype("<u2")
                n = n + 1
                ends, starts = np.cumsum(n), []
                for s, k in zip(sources[a:b], n.tolist()):
                    starts.append(done.get(s, 0))
                    done[s] = starts[-1] + k
                raw = [ids[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), pa.array(sources[a:b], pa.string()), pa.array([block] * (b - a), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())],
                    [id_col, "queue", "block", "start_in_block", "n", "ids"],
                )

    chosen = docs.select(id_col, text_col, F.col(source_col).cast("string").alias("queue"))
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, queue string, block int, start_in_block long, n long, ids binary")


def pack(
    docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    window: int = 2048, end_id: int = 1, weights: dict[str | None, float] | None = None, quantum: int = 1,
) -> DataFrame:
    """Pieces of documents, placed in sequences: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, ids).

    ``ids`` holds the piece's ids as unsigned 16-bit little-endian bytes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    tokens = materialise(tokenise(docs, vocab_path, id_col, text_col, source_col, end_id), "tokens")
    sums = materialise(tokens.groupBy("queue", "block").agg(F.sum("n").alias("n")), "queue-sums")
    totals = sorted(((r.queue, r.n) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()), key=lambda x: (x[0] is not None, x[0]))
    names = [q for q, _ in totals]
    schedule = Schedule([n for _, n in totals], None if weights is None else [weights[q] for q in names], window, quantum)
    before = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("queue", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if sums.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    b = base.select(F.col("queue").alias("_queue"), F.col("block").alias("_block"), "base")
    placed = tokens.join(b, (F.col("block") == F.col("_block")) & F.col("queue").eqNullSafe(F.col("_queue")))
    number = {q: i for i, q in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, queues, at, n, raw = (batch.column(i) for i in range(5))
            queue = np.array([number[q] for q in queues.to_pylist()], np.int64)
            n, at = n.to_numpy(), at.to_numpy()
            share = np.cumsum(n // quantum + 1) // PORTION  # so many quanta at a time
            bounds = np.flatnonzero(np.diff(share, prepend=-1)).tolist() + [len(n)]
            for low, high in zip(bounds, bounds[1:]):
                r, x, k, w, o = schedule.cut(queue[low:high], at[low:high], n[low:high])
                texts = raw.slice(low, high - low).to_pylist()
                ids = [texts[i][2 * a : 2 * (a + c)] for i, a, c in zip(r.tolist(), x.tolist(), k.tolist())]
                crc = [zlib.crc32(np.frombuffer(i, "<u2").astype("<u4").tobytes()) for i in ids]
                chosen = pa.array(r + low)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(chosen), pa.array(x), pa.array(k), pa.array(crc, pa.int64()), pa.array(n[r + low]), pa.array(w), pa.array(o), queues.take(chosen), pa.array(ids, pa.binary())],
                    [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "ids"],
                )

    chosen = placed.select(id_col, "queue", (F.col("base") + F.col("start_in_block")).alias("at"), "n", "ids")
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string, ids binary")


def sequences(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """(sequence_id, length, padded_length, ids): each sequence's ids in order; a sequence has ``window`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.col("parts"), F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    length = F.col("length")
    exact = F.bit_count(length) == 1
    return (
        pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
        .select("sequence_id", "length", F.when(exact, length).otherwise(F.lit(window)).alias("padded_length"), joined.alias("ids"))
    )
