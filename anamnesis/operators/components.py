"""Connected components of links between ids, in a number of rounds that grows with the logarithm of the longest path.

Each round first joins what a task can join on its own, then moves links to the least neighbours: greater neighbours
of a node are linked to the least one around it (large star), then lesser ones (small star). Links become stars around the least id of
their component. Every round is written, so a lost executor costs no more than its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Links that a task joins on its own at a time.
AT_ONCE = 1_000_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) over these links alone."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)  # roots move too, so long paths fold
        np.minimum.at(new, root[y], low)
        while not (new == new[new]).all():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _join_in_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> pa.RecordBatch:
        node, root = joined(*(np.concatenate(c) for c in zip(*held)))
        moved = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(root[moved])], ["a", "b"])

    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy() for i in (0, 1)))
        if sum(len(x) for x, _ in held) >= AT_ONCE:
            yield stars()
            held.clear()
    if held:
        yield stars()


def components(links: DataFrame) -> DataFrame:
    """(id, component): ``links`` is (a, b) of 64-bit ids; nodes without links aren't named, nor links of a node to itself."""
    edges = kept(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").mapInArrow(_join_in_tasks, "a long, b long"), "stars")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # now every link goes from a greater node to a lesser one
        down = kept(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "large")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = kept(small, "stars")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first())
        if state == before and state[0] == state[2]:
            break
        before = state
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
