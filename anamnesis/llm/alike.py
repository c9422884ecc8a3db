"""Operator 9 on word shingles: near copies of texts by wide SimHash in tiles, each checked exactly.

A text is the set of its ``width``-word shingles. Its SimHash has 64 bits for each of ``WORDS``
hash functions, so that the distance of two fingerprints tells the angle between their sets:
sets of Jaccard similarity s have a cosine of 2s / (1 + s) at least, hence differ in a share
of arccos(2s / (1 + s)) / pi of the bits; the radius lies 3.3 standard deviations above
that, for the whole fingerprint as for its first 64 bits. Tiles compare fingerprints of all sets whose sizes allow the similarity. Population counts
rule nothing out at such a radius (they would in ``simhash`` with its radius of 3); sizes do.

What fingerprints connect is a candidate group. Its sets are then compared exactly with each other, in tiles of
bounded size, and only pairs of the similarity itself are linked. So nothing is linked
wrongly, and a pair is missed only if its fingerprints are further apart than the radius (about one in
a thousand right at the threshold) and no others connect it.

Equal sets are one node, so groups of copies cost nothing. Shingles are told apart by 64-bit hashes.

Defined results: words are those of ``simhash``; texts under ``width`` words are one shingle of all words; null, empty
and blank texts are copies of each other; repeated rows are copies too, with or without an id, and one stays; of a group the row
with the least id stays (null ids last, then by the text's hash); an empty table stays empty; further columns are kept as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .components import connected_components
from .durable import materialise
from .orderhash import BASE, mix

WORDS = 4
PRINT = [f"f{k}" for k in range(WORDS)]
SALTS = np.arange(1, WORDS + 1, dtype=np.uint64) * BASE
#: Shingles of a tile of sets, and rows up to which a list of keys is broadcast.
TILE_SHINGLES, BROADCAST_ROWS = 300_000, 1_000_000


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(w) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = mix(h * BASE + w[i : i + n])
    return np.unique(h)


def name(grams: np.ndarray) -> int:
    """A set's name."""
    return xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63)


def wide_print(grams: np.ndarray) -> np.ndarray:
    """A set's SimHash: a bit is set if it is in over half of the hashes."""
    counts = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(grams), 255):  # so many bits add up to a byte at most
        bits = np.unpackbits(mix(grams[i : i + 255, None] + SALTS).view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, 0, np.uint8)
    return np.packbits(2 * counts > len(grams), bitorder="little").view(np.uint64)


def radius_of(least: float, bits: int = 64 * WORDS, sigmas: float = 3.3) -> int:
    """Differing bits, of ``bits``, up to which fingerprints are candidates for a Jaccard similarity of ``least``."""
    p = math.acos(2 * least / (1 + least)) / math.pi
    return math.floor(bits * p + sigmas * math.sqrt(bits * p * (1 - p)))


def near_prints(home: np.ndarray, guest: np.ndarray, least: float, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, guest) within the radius whose sizes allow the similarity; one order of each if both are the same.

    Rows are (fingerprint words, size, name). The first word has a radius of its own, which leaves one pair in a thousand to the others.
    """
    ho, go = np.argsort(home[:, WORDS], kind="stable"), np.argsort(guest[:, WORDS], kind="stable")
    hs, gs = home[ho, WORDS], guest[go, WORDS]
    h, g = (np.ascontiguousarray(x[o, :WORDS].T).view(np.uint64) for x, o in ((home, ho), (guest, go)))
    first, whole = radius_of(least, 64), radius_of(least)
    xor, bits, fits = np.empty(block, np.uint64), np.empty(block, np.uint8), np.empty(block, bool)
    i = 0
    while i < len(gs):
        low = i if home is guest else np.searchsorted(hs, math.floor(least * gs[i] - 1e-6), "left")
        high = np.searchsorted(hs, math.ceil(gs[i] / least + 1e-6), "right")
        if low >= high:
            i += 1
            continue
        end = min(i + max(1, block // (high - low)), len(gs))
        high = np.searchsorted(hs, math.ceil(gs[end - 1] / least + 1e-6), "right")
        step = block // (end - i)
        for a in range(low, high, step):
            part = h[:, a : min(a + step, high)]
            shape = end - i, part.shape[1]
            x, c, f = (buffer[: shape[0] * shape[1]].reshape(shape) for buffer in (xor, bits, fits))
            np.less_equal(np.bitwise_count(np.bitwise_xor(g[0, i:end, None], part[0], out=x), out=c), first, out=f)
            at_g, at_h = np.divmod(np.flatnonzero(f.ravel()), shape[1])
            if len(at_g):
                apart = np.bitwise_count(g[:, i + at_g] ^ part[:, at_h]).sum(0, dtype=np.int64)
                good = apart <= whole
                yield ho[a + at_h[good]], go[i + at_g[good]]
        i = end


def alike_links(names: list[int], sets: list[np.ndarray], first: int, least: float) -> list[tuple[int, int]]:
    """Links that connect what is connected by alike pairs among the first ``first`` sets (if those are all), or else between these and the rest."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.concatenate([[0], np.cumsum(sizes)])
    root, seen, out = np.arange(n), np.zeros(flat.max() + 1, bool), []
    parts_in = round(least * 1_000_000)
    for k in range(first):
        a = first if first < n else k + 1
        if a == n or (root == root[0]).all():
            break
        if (root[a:] == root[k]).all():
            continue
        seen[flat[start[k] : start[k + 1]]] = True
        both = np.add.reduceat(seen[flat[start[a] :]], start[a:-1] - start[a], dtype=np.int64)
        seen[flat[start[k] : start[k + 1]]] = False
        for j in a + np.flatnonzero(both * 1_000_000 >= parts_in * (sizes[k] + sizes[a:] - both)):
            if root[j] != root[k]:
                root[root == max(root[j], root[k])] = min(root[j], root[k])
                out.append((names[k], names[j]))
    return out


def checked(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of rows (component, i, j, chunk, node, grams) sorted by all but the last; a unit is the chunks i and j of a component."""
    key, rows, found = None, [], []

    def close() -> None:
        if key is None or (key[1] != key[2] and len({c for c, *_ in rows}) < 2):
            return
        first = sum(c == rows[0][0] for c, *_ in rows)
        found.extend(alike_links([x for _, x, _ in rows], [np.frombuffer(s, np.uint64) for *_, s in rows], first, least))

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])

    for batch in batches:
        for c, i, j, chunk, node, grams in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if (c, i, j) != key:
                close()
                key, rows = (c, i, j), []
            rows.append((chunk, node, grams))
        if found:
            yield told()
            found.clear()
    close()
    if found:
        yield told()


def sized(df: DataFrame) -> DataFrame:
    """A table of keys, marked for a broadcast if it has few rows and for a merge join if not."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def row_keys(id_col: str, text_col: str) -> list:
    """128 bits that rows share if, and only if, both their ids and their texts are equal (but for collisions of hashes)."""
    return [F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit(1), text_col, id_col).alias("k2")]


def _groups(docs: DataFrame, id_col: str, text_col: str, width: int, least: float, tile: int) -> DataFrame:
    """(id, k1, k2, group): every row with the name of its group."""
    spark = docs.sparkSession
    kind, n = docs.schema[id_col].dataType.simpleString(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col(id_col), *row_keys(id_col, text_col), F.col(text_col).alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(3).to_pylist()]
            prints = np.array([wide_print(s) for s in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            columns = [pa.array([name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(prints[:, k]) for k in range(WORDS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], [id_col, "k1", "k2", "node", "size", *PRINT])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "grams"])

    marked = materialise(keyed.mapInArrow(mark, f"`{id_col}` {kind}, k1 long, k2 long, node long, size long, " + ", ".join(f"{c} long" for c in PRINT)), "marked")
    nodes = materialise(marked.groupBy("node").agg(F.min("size").alias("size"), F.min(F.struct("k1", "k2")).alias("row"), *(F.min(c).alias(c) for c in PRINT)), "nodes")
    # sizes of a similarity of ``least`` lie in one cell or in neighbouring ones
    cell = F.floor(F.log("size") / math.log(1 / least) + F.lit(1e-9)).cast("int").alias("p")
    near = tiles.links(nodes.select(cell, F.lit(0).alias("q"), *PRINT, "size", "node"), [*PRINT, "size", "node"], [(1, 0)], lambda a, b: near_prints(a, b, least), tile)
    maybe = materialise(connected_components(near), "candidates")
    chunks = maybe.join(nodes.select("node", "size"), "node").groupBy("component").agg(F.ceil(F.sum("size") / TILE_SHINGLES).cast("int").alias("chunks"))
    of = materialise(maybe.join(chunks, "component").join(nodes.select("node", "row"), "node").select("node", "component", "chunks", "row.k1", "row.k2"), "candidate-rows")
    texts = keyed.join(sized(of.select("k1", "k2")), ["k1", "k2"], "left_semi").select("text")
    sets = materialise(texts.mapInArrow(grams, "node long, grams binary").dropDuplicates(["node"]), "sets")
    inside = sets.join(of.select("node", "component", "chunks"), "node").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k")
    units = inside.select("component", "chunk", "node", "grams", other).select("component", F.least("chunk", "k").alias("i"), F.greatest("chunk", "k").alias("j"), "chunk", "node", "grams")
    dealt = units.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j", "chunk", "node")
    groups = materialise(connected_components(dealt.mapInArrow(lambda b: checked(b, least), "a long, b long")), "groups")
    return marked.select(id_col, "k1", "k2", "node").join(groups, "node", "left").select(id_col, "k1", "k2", F.coalesce("component", "node").alias("group"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, tile: int = 8192) -> DataFrame:
    """(id, component_id): a row per document with the least id of its group (null if its group has no ids)."""
    rows = materialise(_groups(docs, id_col, text_col, width, least, tile), "grouped")
    return rows.join(rows.groupBy("group").agg(F.min(id_col).alias("component_id")), "group").select(id_col, "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, tile: int = 8192) -> DataFrame:
    """``docs`` with one row of each group. Only keys of rows are shuffled or broadcast, unless very many rows go."""
    rows = materialise(_groups(docs, id_col, text_col, width, least, tile), "grouped")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "k1", "k2")).alias("s"), F.count("*").alias("n"))
    first = materialise(first.select("group", "s.k1", "s.k2", "n"), "firsts")
    of = rows.select("group", "k1", "k2").distinct()
    gone = materialise(of.join(first.where("n > 1").hint("merge"), ["group", "k1", "k2"], "left_anti").join(first.where("n > 1").select("group").hint("merge"), "group", "left_semi").select("k1", "k2"), "gone")
    again = materialise(rows.groupBy("k1", "k2").count().where("count > 1").join(first.select("k1", "k2").hint("merge"), ["k1", "k2"], "left_semi").select("k1", "k2"), "again")
    k1, k2 = row_keys(id_col, text_col)
    keyed = docs.withColumn("_near_copies_1", k1).withColumn("_near_copies_2", k2)
    as_keys = lambda df: sized(df.toDF("_near_copies_1", "_near_copies_2"))
    stays = keyed.join(as_keys(gone), ["_near_copies_1", "_near_copies_2"], "left_anti")
    if again.limit(1).count():
        once = stays.join(as_keys(again), ["_near_copies_1", "_near_copies_2"], "left_semi").dropDuplicates(["_near_copies_1", "_near_copies_2"])
        stays = stays.join(as_keys(again), ["_near_copies_1", "_near_copies_2"], "left_anti").unionByName(once)
    return stays.select(docs.columns)
