"""Operator 6, sharding by a k-d tree over document metadata.

A cell that still has to give several shards is cut along its widest metadata
dimension (size, source, language, each scaled to [0, 1)) at the weighted median, or at
the fraction that splits its shards evenly, until every leaf is one shard of the
target bytes. The law that holds is ``bytes``: shards have nearly equal bytes.

Points of the tree are distinct texts with the bytes of all their copies, so equal
texts share a shard. A text whose copies outweigh a shard can't do that under
this law; its copies are dealt over more points by id. Texts that weigh much of a shard
are put at the low end of every order, where they can't disturb a cut.

Medians are found by rounds of histograms over an exact 62-bit order (heavy or not,
scaled value, hash of the text), so ties never unbalance a cut. Only histograms of at
most 4096 bins a cell, and the tree itself, reach the driver. Slots within a shard
are numbered in blocks, so no task sorts a whole shard.

Defined results: a null text has 0 bytes and so size 8, and the CRC of nothing;
repeated rows get slots of their own; null sources and languages are values like
others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import materialise

VALUE_BITS, HASH_BITS, ROUND_BITS = 23, 38, 12
BROADCAST_ROWS = 200_000


def _scaled(hash_of: str):
    return F.shiftrightunsigned(F.xxhash64(hash_of), 64 - VALUE_BITS)


def _order(dimension: str):
    """The place of a point along a dimension: heavy points first, then by value, then by hash."""
    return F.when(F.col("heavy"), F.lit(0)).otherwise(F.lit(1 << (VALUE_BITS + HASH_BITS))) + F.shiftleft(F.col(dimension), HASH_BITS) + F.shiftrightunsigned("key", 64 - HASH_BITS)


DIMENSIONS = ("by_size", "by_source", "by_lang")


def build_tree(points: DataFrame, shards: int) -> DataFrame:
    """Cut cells until each is one shard; returns the points with their cells.

    ``points`` has key, weight, heavy and a column for each dimension; cell 1 is the root and cell c has the
    children 2c and 2c + 1.
    """
    spark, cells = points.sparkSession, {1: shards}
    placed = points.select("key", "weight", "heavy", *DIMENSIONS).withColumn("cell", F.lit(1).cast("long"))
    while any(n > 1 for n in cells.values()):
        open_cells = {c: n for c, n in cells.items() if n > 1}
        inside = placed.where(F.col("cell").isin([*open_cells]))
        spans = inside.groupBy("cell").agg(F.sum("weight").alias("weight"), *(F.max(d).alias(d) for d in DIMENSIONS), *(F.min(d).alias(f"low_{d}") for d in DIMENSIONS))
        found = {r.cell: r for r in spans.collect()}
        search = {}
        for c, n in open_cells.items():
            r = found.get(c)
            widest = max(DIMENSIONS, key=lambda d: r[d] - r[f"low_{d}"]) if r else DIMENSIONS[0]
            weight = r.weight if r else 0
            search[c] = {"cell": c, "dimension": widest, "goal": weight * (n // 2) / n, "share": weight / n, "prefix": 0, "below": 0, "done": not r}
        bits = left = VALUE_BITS + HASH_BITS + 1
        while any(not s["done"] for s in search.values()) and left > 0:
            step = min(ROUND_BITS, left)
            rows = [(c, s["dimension"], s["prefix"]) for c, s in search.items() if not s["done"]]
            small = F.broadcast(spark.createDataFrame(rows, "cell long, dimension string, prefix long"))  # at most a row per shard
            at = F.coalesce(*(F.when(F.col("dimension") == d, _order(d)) for d in DIMENSIONS))
            binned = inside.join(small, "cell").select("cell", "weight", "prefix", at.alias("at")).where(F.expr(f"shiftright(at, {left})") == F.col("prefix"))
            histogram: dict[int, dict[int, int]] = {}
            for r in binned.groupBy("cell", F.expr(f"shiftright(at, {left - step})").alias("bin")).agg(F.sum("weight").alias("w")).collect():
                histogram.setdefault(r.cell, {})[r.bin] = r.w
            left -= step
            for c, s in search.items():
                if s["done"]:
                    continue
                total, last = s["below"], None
                for b in sorted(histogram[c]):
                    w = histogram[c][b]
                    last = b
                    if total + w >= s["goal"]:
                        break
                    total += w
                s |= {"prefix": last, "below": total}
                if left == 0 or w <= s["share"] / 4096:
                    nearer = total + w - s["goal"] <= s["goal"] - total
                    s |= {"done": True, "cut": ((last + 1) << left) - 1 if nearer else (last << left) - 1}
        new = [{"cell": c, "dimension": s["dimension"], "cut": s.get("cut", 1 << bits)} for c, s in search.items()]
        placed = materialise(_descend(placed, new), "points")
        for c, n in open_cells.items():
            del cells[c]
            cells[2 * c], cells[2 * c + 1] = n // 2, n - n // 2
    return placed


def _descend(placed: DataFrame, cuts: list[dict]) -> DataFrame:
    """Move points of cut cells to a child."""
    rows = [(x["cell"], x["dimension"], x["cut"]) for x in cuts]
    small = F.broadcast(placed.sparkSession.createDataFrame(rows, "cell long, dimension string, cut long"))  # at most a row per shard
    at = F.coalesce(*(F.when(F.col("dimension") == d, _order(d)) for d in DIMENSIONS))
    moved = F.when(F.col("cut").isNull(), F.col("cell")).otherwise(2 * F.col("cell") + (at > F.col("cut")).cast("long"))
    return placed.join(small, "cell", "left").select("key", "weight", "heavy", *DIMENSIONS, moved.alias("cell"))


def shard(
    docs: DataFrame, shards: int | None = 24, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang", block_rows: int = 20_000,
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row; give the number of shards or their target bytes."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    light = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"))
    light = materialise(light, "rows")
    total, rows = light.agg(F.sum("size"), F.count("*")).first()
    shards = shards or max(1, -(-(total or 0) // target_bytes))
    leaf = (total or 0) / shards
    texts = light.groupBy("key").agg(F.sum("size").alias("weight"), F.max("size").alias("size"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    texts = materialise(texts, "texts")
    # fewer than one text per shard can weigh more than a shard
    dealt = [(r.key, int(r.weight / leaf * 64) + 1) for r in texts.where(F.col("weight") > leaf).collect()]
    salts = F.broadcast(light.sparkSession.createDataFrame(dealt, "key long, salts int"))
    salted = light.join(salts, "key", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), "salts")).cast("int")).drop("salts")
    big = salted.join(salts.select("key"), "key", "left_semi").groupBy("key", "salt").agg(F.sum("size").alias("weight"), F.max("size").alias("size"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    points = texts.join(salts.select("key"), "key", "left_anti").select("key", F.lit(0).alias("salt"), "weight", "size", "source", "lang").unionByName(big)
    points = points.select(
        F.xxhash64("key", "salt").alias("key"), F.col("key").alias("text_key"), "salt", "weight", (F.col("weight") * 32 > leaf).alias("heavy"),
        F.floor(F.log2(F.col("size")) / 64 * (1 << VALUE_BITS)).cast("long").alias("by_size"), _scaled("source").alias("by_source"), _scaled("lang").alias("by_lang"))
    points = materialise(points, "points")
    tree = build_tree(points, shards)
    leaves: list[int] = []

    def leaf_cells(cell: int, n: int) -> None:
        if n == 1:
            leaves.append(cell)
        else:
            leaf_cells(2 * cell, n // 2)
            leaf_cells(2 * cell + 1, n - n // 2)

    leaf_cells(1, shards)
    named = F.broadcast(light.sparkSession.createDataFrame([(c, i) for i, c in enumerate(leaves)], "cell long, shard int"))
    homes = materialise(tree.join(named, "cell").select("key", "shard").join(points.select("key", "text_key", "salt"), "key").select(F.col("text_key").alias("key"), "salt", "shard"), "homes")
    blocks = max(16, rows // (shards * block_rows) + 1)
    at = salted.join(homes, ["key", "salt"]).select("id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(blocks)).cast("int").alias("block"))
    at = materialise(at, "sharded")
    sums = at.groupBy("shard", "block").count()
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    if shards * blocks <= BROADCAST_ROWS:
        base = F.broadcast(base)
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "text_crc32", "size")) - 1
    return at.withColumn("place", place).join(base, ["shard", "block"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
