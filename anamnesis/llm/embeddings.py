"""Operator 8, near-duplicate vectors by sorted projection passes.

Each pass hashes every vector by the signs of its own random projections, sorts the
vectors by the concatenated signs within a label and compares each with the ``WINDOW``
followers, and more where blocks allow, in double precision. Near vectors share long
prefixes of signs in some pass. The verified pairs of all passes are united into
components; then all pairs within a component are compared in tiles, so that the numbers of
links are whole however large a group of near copies is. Equal vectors are one node with
a multiplicity.

A label of up to ``WINDOW`` vectors is compared completely. A label of n takes as many passes as leave a pair
at the threshold unmet with probability ``MISS``, if its vectors lie evenly: such a pair shares a sign with probability
1 - arccos(least) / pi, and has to share about log2(n / WINDOW) of them. Vectors that lie unevenly, and windows that end with
a partition, are seen to by rounds: passes are repeated with new projections until a round joins nothing new. ``exact`` compares all pairs of
each label in tiles instead, at a quadratic cost, and so shows what the passes miss.

Components are kept in the precision of the column and compared in double precision.

Defined results: a vector that is null, zero or has null or non-finite components, or
whose label is null, links with nothing (0 links, itself as component); vectors of
different dimensions never link; repeated rows are vectors of their own, also if they share an id; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alike import sized
from .components import Unions, connected_components
from .durable import materialise

BITS, WINDOW, TILE, MISS = 62, 512, 4096, 1e-4


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors; a scaling by powers of two keeps squares from overflowing."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def passes_for(n: int, least: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes for a label of ``n`` vectors."""
    if n <= window:
        return 1
    met = (1 - math.acos(least) / math.pi) ** math.log2(n / window)
    return math.ceil(math.log(miss) / math.log1p(-met))


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, str]:
    """(id, label, v), with components as bytes, null where the vector links with nothing; and the components' type."""
    kind, label = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    of = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v, has in zip(batch.column(1), batch.column(2).is_valid().to_pylist()):
                v = v.values if v.is_valid else None
                x = None if v is None or v.null_count or not has else v.to_numpy(zero_copy_only=False).astype(of)
                out.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], [id_col, "label", "v"])

    chosen = vectors.select(id_col, vector_col, F.col(label_col).alias("label"))
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, label {label}, v binary"), of


def pass_keys(batches: Iterator[pa.RecordBatch], kind: str, bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    """A row (pass, grp, key, node, v) for each pass of each row (grp, passes, node, v)."""
    planes: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        raw, passes = np.array(batch.column(3).to_pylist(), object), batch.column(1).to_numpy()
        sizes = np.array([len(r) for r in raw], np.int64)
        for size in np.unique(sizes):
            of_size = np.flatnonzero(sizes == size)
            x = unit(raw[of_size].tolist(), kind)
            for k in range(passes[of_size].max()):
                if (size, k) not in planes:
                    planes[size, k] = np.random.default_rng([7, seed, k, int(size)]).standard_normal((x.shape[1], bits))
                takes = passes[of_size] > k
                key = (x[takes] @ planes[size, k] > 0) @ (1 << np.arange(bits, dtype=np.int64)[::-1])
                at = pa.array(of_size[takes])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), k, np.int32)), batch.column(0).take(at), pa.array(key.astype(np.int64)), batch.column(2).take(at), batch.column(3).take(at)],
                    ["pass", "grp", "key", "node", "v"],
                )


def window_links(batches: Iterator[pa.RecordBatch], kind: str, least: float, window: int) -> Iterator[pa.RecordBatch]:
    """Verified links among rows (pass, grp, key, node, v) sorted by the first three, as far as they join something new.

    Blocks of ``window`` rows are compared with themselves and with the next block.
    """
    held: tuple[list, list, list] = [], [], []

    def compare(last: bool) -> Iterator[pa.RecordBatch]:
        groups, nodes, raw = held
        while len(nodes) >= 2 * window or (last and nodes):
            g, n, r = groups[: 2 * window], nodes[: 2 * window], raw[: 2 * window]
            code = {x: i for i, x in enumerate(dict.fromkeys(g))}
            of, unions = np.array([code[x] for x in g]), Unions(len(n))
            new = []
            for c in range(len(code)):
                rows = np.flatnonzero(of == c)
                own = rows[rows < window]
                if not len(own) or len(rows) < 2:
                    continue
                x = unit([r[i] for i in rows], kind)
                i, j = np.nonzero(x[: len(own)] @ x.T >= least)
                new += [(n[rows[a]], n[rows[b]]) for a, b in zip(i.tolist(), j.tolist()) if a < b and unions.join(int(rows[a]), int(rows[b]))]
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*new)], ["a", "b"])
            for x in held:
                del x[:window]

    for batch in batches:
        held[0].extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        held[1].extend(batch.column(3).to_pylist())
        held[2].extend(batch.column(4).to_pylist())
        yield from compare(False)
    yield from compare(True)


def tile_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, list]]:
    """(whether a chunk meets itself, rows (chunk, node, copies, v)) of each unit among rows (grp, i, j, chunk, node, copies, v) sorted by all up to chunk."""
    key, rows = None, []
    whole = lambda: rows and (key[1] == key[2] or rows[0][0] != rows[-1][0])
    for batch in batches:
        for c, i, j, *row in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if (c, i, j) != key:
                if whole():
                    yield key[1] == key[2], rows
                key, rows = (c, i, j), []
            rows.append(row)
    if whole():
        yield key[1] == key[2], rows


def _linked(itself: bool, rows: list, kind: str, least: float, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, rows, whether linked) of a unit, block by block; pairs of a chunk with itself come twice, but none with itself."""
    first = len(rows) if itself else sum(r[0] == rows[0][0] for r in rows)
    x = unit([r[3] for r in rows], kind)
    j = np.arange(0 if itself else first, len(rows))
    for a in range(0, first, step):
        i = np.arange(a, min(a + step, first))
        linked = x[i] @ x[j].T >= least
        if itself:
            linked[np.arange(len(i)), i] = False
        yield i, j, linked


def tile_counts(batches: Iterator[pa.RecordBatch], kind: str, least: float) -> Iterator[pa.RecordBatch]:
    """(node, n): partial numbers of links."""
    for itself, rows in tile_units(batches):
        copies, n = np.array([r[2] for r in rows]), np.zeros(len(rows), np.int64)
        for i, j, linked in _linked(itself, rows, kind, least):
            n[i] += linked @ copies[j]
            if not itself:
                n[j] += copies[i] @ linked
        yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array(n)], ["node", "n"])


def tile_links(batches: Iterator[pa.RecordBatch], kind: str, least: float) -> Iterator[pa.RecordBatch]:
    """(a, b): links that join something new within their unit."""
    for itself, rows in tile_units(batches):
        unions, new = Unions(len(rows)), []
        for i, j, linked in _linked(itself, rows, kind, least):
            new += [(rows[i[a]][1], rows[j[b]][1]) for a, b in zip(*(x.tolist() for x in np.nonzero(linked))) if unions.join(int(i[a]), int(j[b]))]
        if new:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*new)], ["a", "b"])


def tiled(rows: DataFrame, tile: int) -> DataFrame:
    """Rows (grp, node, copies, v) as units of at most two chunks of about ``tile`` rows; every pair of a group's chunks is one unit."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = materialise(rows.groupBy("grp").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks")), "group-sizes")
    inside = rows.join(sized(sizes), "grp").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k")
    units = inside.select("grp", "chunk", "node", "copies", "v", other).select("grp", F.least("chunk", "k").alias("i"), F.greatest("chunk", "k").alias("j"), "chunk", "node", "copies", "v")
    return units.repartition(n, "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "chunk")


def components_of(nodes: DataFrame, kind: str, least: float, bits: int, window: int, miss: float, tile: int, exact: bool) -> DataFrame:
    """(node, component) of (grp, node, copies, v): those that have a link."""
    spark = nodes.sparkSession
    in_tiles = lambda rows: tiled(rows, tile).mapInArrow(lambda b: tile_links(b, kind, least), "a long, b long")
    if exact:
        return materialise(connected_components(in_tiles(nodes)), "vector-components")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = materialise(nodes.groupBy("grp").agg(F.count("*").alias("size")).where("size > 1"), "label-sizes")
    small = nodes.join(sized(sizes.where(F.col("size") <= window).select("grp")), "grp", "left_semi")
    found, before, seed = materialise(in_tiles(small), "vector-links"), None, 0
    most = sizes.agg(F.max("size")).first()[0] or 0
    # passes by the size of the label, rounded up to that of a power of two times the window
    doublings = F.greatest(F.lit(0), F.ceil(F.log2(F.col("size") / window))).cast("int")
    table = F.array(*(F.lit(passes_for(window << k, least, window, miss)) for k in range(max(1, most).bit_length() + 1)))
    large = sizes.where(F.col("size") > window).select("grp", F.element_at(table, doublings + 1).alias("passes"))
    while True:
        comps = materialise(connected_components(found), "vector-components")
        joined = comps.count() - comps.select("component").distinct().count()
        if joined == before or most <= window:
            return comps
        keyed = nodes.join(sized(large), "grp").select("grp", "passes", "node", "v").mapInArrow(lambda b, s=seed: pass_keys(b, kind, bits, s), "pass int, grp long, key long, node long, v binary")
        dealt = keyed.repartitionByRange(n, "pass", "grp", "key", "node").sortWithinPartitions("pass", "grp", "key", "node")
        new = dealt.mapInArrow(lambda b: window_links(b, kind, least, window), "a long, b long")
        found = materialise(new.union(comps.select(F.col("node").alias("a"), F.col("component").alias("b"))), "vector-links")
        before, seed = joined if seed else None, seed + 1


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93,
    bits: int = BITS, window: int = WINDOW, miss: float = MISS, tile: int = TILE, exact: bool = False,
) -> DataFrame:
    """(id, n_links, component_id, kept): links at a cosine of ``least`` or more between vectors of one label."""
    rows, kind = usable(vectors, id_col, vector_col, label_col)
    # vectors meet within a label and a dimension
    rows = materialise(rows.withColumn("grp", F.xxhash64("label", F.length("v"))).withColumn("node", F.xxhash64("label", "v")), "vectors")
    valid = rows.where("v is not null")
    nodes = materialise(valid.groupBy("node").agg(F.min("grp").alias("grp"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min(id_col).alias("least")), "vector-nodes")
    comps = components_of(nodes.select("grp", "node", "copies", "v"), kind, least, bits, window, miss, tile, exact)
    inside = comps.join(nodes.select("node", "copies", "v"), "node").select(F.col("component").alias("grp"), "node", "copies", "v")
    counts = tiled(inside, tile).mapInArrow(lambda b: tile_counts(b, kind, least), "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    of = nodes.select("node", "copies", "least").join(comps, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("component", "node"))
    told = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    told = materialise(told.select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "vector-groups")
    linked = valid.select(id_col, "node").join(told, "node").select(id_col, "n_links", F.coalesce("component_id", id_col).alias("component_id"))
    rest = rows.where("v is null").select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return linked.union(rest).select(id_col, "n_links", "component_id", (F.col(id_col) == F.col("component_id")).alias("kept"))
