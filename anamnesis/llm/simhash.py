"""Operator 9, SimHash near-duplicates by tiled exact comparison.

Every pair of fingerprints within the radius is found. Fingerprints are grouped
into tiles by the population counts of their two halves. Two fingerprints that
differ in r bits have counts that differ by r at most in sum, so a tile meets only
the tiles whose counts are that near; within a tile, the counts of quarters rule out
more blocks. What is left is compared with numpy's exclusive-or and bit counts.
Tiles have a bounded size, see ``tiles``.

Equal fingerprints are one node, so large groups of copies cost nothing, and a tile
hands on only links that join something new; components come from those.

Defined results: null, empty and blank texts have no words and get fingerprint
zero, which links like any other; repeated rows are rows of their own; an empty table
gives an empty result; a row with a null id never names a component (the component
of such rows alone is null); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .components import connected_components
from .durable import materialise

SEED = 42


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles: a bit is set if it is in over half of the hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the fingerprint's 64 bits as a signed number."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def near(home: np.ndarray, guest: np.ndarray, radius: int, block: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, guest) within the radius, a block at a time. Blocks join groups of near population counts of the four quarters."""

    def groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        quarters = np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)
        order = np.lexsort(quarters.T)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(quarters[order], axis=0) != 0).any(1)]))
        return order, np.append(first, len(x)), quarters[order][first]

    if not len(home) or not len(guest):
        return
    (ho, hb, hq), (go, gb, gq) = groups(home), groups(guest)
    hs, gs = home[ho], guest[go]
    for g in range(len(gq)):
        fits = np.flatnonzero(np.abs(hq - gq[g]).sum(1) <= radius)
        if not len(fits):
            continue
        at = np.concatenate([np.arange(hb[f], hb[f + 1]) for f in fits])
        part = hs[at]
        step = max(1, block // len(part))
        for i in range(gb[g], gb[g + 1], step):
            found_g, found_h = np.nonzero(np.bitwise_count(gs[i : min(i + step, gb[g + 1]), None] ^ part) <= radius)
            if len(found_g):
                yield ho[at[found_h]], go[i + found_g]


def links(distinct: DataFrame, radius: int = 3, tile: int = 1 << 17) -> DataFrame:
    """(a, b): links that connect whatever is connected by pairs of fingerprints within the radius.

    ``distinct`` has a column fp without repeats or nulls. A cell is ``radius + 1`` population counts wide in either half, so
    a fingerprint meets the cells beside its own alone; quarters rule out more within a tile.
    """
    wide = radius + 1
    halves = (F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))))
    rows = distinct.select("fp", *((h / wide).cast("int").alias(c) for h, c in zip(halves, "pq")))

    def find(home: np.ndarray, guest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return near(home[:, 0].view(np.uint64), guest[:, 0].view(np.uint64), radius)

    return tiles.links(rows, ["fp"], [(1, -1), (1, 0), (1, 1), (0, 1)], find, tile)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """(id, fp, component_id): documents whose fingerprints are connected by steps of at most ``radius`` bits."""
    marked = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    comps = connected_components(links(nodes.select("fp"), radius))
    of = nodes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(of.join(least, "root").select("fp", "component_id"), "components")
    return marked.join(named, "fp").select(id_col, "fp", "component_id")
