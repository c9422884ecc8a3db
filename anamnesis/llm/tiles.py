"""Tiled comparison: every row of a cell meets every row of that cell and of its neighbours, in tiles of bounded size.

Rows lie in cells (p, q), of which there are few. A cell is dealt by hash over chunks of
about ``tile`` rows. A task's unit is one home chunk against at most ``GROUP`` guest chunks
of one cell, so neither a hot cell nor a long stream of guests makes a task large. A home
chunk is held, guests stream past it, and a tile hands on only links that join
something new.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Guest chunks that one unit of work takes in.
GROUP = 16
KEY = ["p", "q", "chunk", "step", "part"]

#: Given two blocks of rows, yields index arrays of the pairs to be linked.
Find = Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


class Tile:
    """A held home tile: compares itself and its guests and returns only links that join something new. A row's last number is its name."""

    def __init__(self, held: np.ndarray, find: Find, itself: bool = True):
        self.held, self.find, self.root = held, find, np.arange(len(held))
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in find(held, held) if itself else ():
            self._join(i, j)

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, first = np.unique(np.maximum(a, b), return_index=True)
            # each of these roots hangs on a smaller one, so no ring can form
            up = np.arange(len(self.root))
            up[high] = np.minimum(a, b)[first]
            while (up != up[up]).any():
                up = up[up]
            self.root = up[self.root]
            self.new.append((self.held[i[first], -1], self.held[j[first], -1]))

    def meet(self, guests: np.ndarray) -> None:
        partner = np.full(len(guests), -1)
        for h, g in self.find(self.held, guests):
            fresh, first = np.unique(g[partner[g] < 0], return_index=True)
            partner[fresh] = h[partner[g] < 0][first]
            self.new.append((self.held[partner[fresh], -1], guests[fresh, -1]))
            self._join(partner[g], h)

    def take(self) -> tuple[np.ndarray, np.ndarray] | None:
        """The links found since the last call."""
        new, self.new = [x for x in self.new if len(x[0])], []
        return tuple(np.concatenate(x) for x in zip(*new)) if new else None


def tile_links(batches: Iterator[pa.RecordBatch], find: Find) -> Iterator[pa.RecordBatch]:
    """Links among rows (*KEY, guest, numbers...) sorted by all but the numbers: a home tile, then its guests, and so on."""
    key, home, tile, itself = None, [], None, False

    def told(found) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    def closed() -> Tile | None:
        return tile or (Tile(np.concatenate(home), find, itself) if home else None)

    for batch in batches:
        p, q, c, step, part, guest = (batch.column(i).to_numpy() for i in range(6))
        numbers = np.stack([batch.column(i).to_numpy() for i in range(6, batch.num_columns)], axis=1)
        cut = np.flatnonzero(np.any([np.diff(x) != 0 for x in (p, q, c, step, part, guest)], axis=0)) + 1
        for i, j in zip([0, *cut], [*cut, len(p)]):
            if i == j:
                continue
            if (now := (p[i], q[i], c[i], step[i], part[i])) != key:
                if (last := closed()) is not None:
                    yield from told(last.take())
                # a home chunk is compared with itself in one of its units only
                key, home, tile, itself = now, [], None, step[i] == 0 and part[i] == c[i] // GROUP
            if not guest[i]:
                home.append(numbers[i:j].copy())
            elif home:
                tile = closed()
                tile.meet(numbers[i:j])
                yield from told(tile.take())
    if (last := closed()) is not None:
        yield from told(last.take())


def links(rows: DataFrame, numbers: list[str], steps: list[tuple[int, int]], find: Find, tile: int) -> DataFrame:
    """(a, b): links that connect whatever is connected by pairs that ``find`` names.

    ``rows`` has p, q and the columns ``numbers`` (long), of which the last names a row without repeats. ``steps`` leads from
    a cell to those that its rows must meet, without the cell itself and without the opposite of any step. There must be few cells.
    """
    spark = rows.sparkSession
    # a number per cell; callers make cells of value ranges, so they don't grow with the rows
    chunks = {(r.p, r.q): -(-r["count"] // tile) for r in rows.groupBy("p", "q").count().collect()}
    if not chunks:
        return spark.createDataFrame([], "a long, b long")
    parts = lambda n: -(-n // GROUP)
    plan = []
    for (p, q), n in chunks.items():
        hosts = [(s + 1, parts(chunks[p + d, q + e])) for s, (d, e) in enumerate(steps) if (p + d, q + e) in chunks]
        visits = [(s + 1, p - d, q - e, chunks[p - d, q - e]) for s, (d, e) in enumerate(steps) if (p - d, q - e) in chunks]
        plan.append((p, q, n, hosts, visits))
    shape = "p int, q int, chunks int, hosts array<struct<step:int, parts:int>>, visits array<struct<step:int, hp:int, hq:int, chunks:int>>"
    chunked = rows.join(F.broadcast(spark.createDataFrame(plan, shape)), ["p", "q"]).withColumn("chunk", F.pmod(F.xxhash64(numbers[-1]), "chunks").cast("int"))
    own = F.floor(F.col("chunk") / GROUP).cast("int")
    last = F.floor((F.col("chunks") - 1) / GROUP).cast("int")

    def row(p: str, q: str, chunk: str, step, part, guest: int) -> list:
        return [F.col(p).alias("p"), F.col(q).alias("q"), F.col(chunk).alias("chunk"), step.alias("step"), part.alias("part"), F.lit(guest).alias("guest"), *numbers]

    zero = F.lit(0)
    home = chunked.select("*", F.explode(F.sequence(own, last)).alias("k")).select(*row("p", "q", "chunk", zero, F.col("k"), 0))
    host = chunked.select("*", F.explode("hosts").alias("h")).select("*", F.explode(F.sequence(zero, F.col("h.parts") - 1)).alias("k")).select(*row("p", "q", "chunk", F.col("h.step"), F.col("k"), 0))
    same = chunked.where("chunk > 0").select("*", F.explode(F.sequence(zero, F.col("chunk") - 1)).alias("k")).select(*row("p", "q", "k", zero, own, 1))
    visit = chunked.select("*", own.alias("own"), F.explode("visits").alias("v"), F.col("v.hp"), F.col("v.hq")).select("*", F.explode(F.sequence(zero, F.col("v.chunks") - 1)).alias("k")).select(*row("hp", "hq", "k", F.col("v.step"), F.col("own"), 1))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = home.union(host).union(same).union(visit).repartition(n, *KEY).sortWithinPartitions(*KEY, "guest")
    return dealt.mapInArrow(lambda batches: tile_links(batches, find), "a long, b long")
