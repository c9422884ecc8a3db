"""Ingest of exchanges as a stream: duplicates touch what is stored, the rest is appended.

Rows count in the order of their ids: a row that is inserted can absorb later ones of its own batch. A batch is
resolved as a set, see ``resolve``. No agent's rows are gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import both_mentioned_days
from ..operators import retrieval
from ..operators.clusters import Clusters
from ..operators.components import components
from ..schema import SAVE_EVENTS
from ..sources.scratch import kept

#: Earlier rows like a row up to which all are named, and links of a component up to which one task settles it.
MOST_ALIKE, MOST_LINKS = 16, 1_000_000


def as_queries(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("query_id"), F.coalesce("agent_id", F.lit("")).alias("agent_id"), F.col("user_emb").alias("query_emb"))


def earlier_like(rows: DataFrame, others: DataFrame, k: int, threshold: float) -> DataFrame:
    """(query_id, id, similarity): per row and block of others, the k most alike that have lower ids."""
    others = others.withColumn("created_at", F.lit(0.0))
    return retrieval.best_pairs(as_queries(rows), others, ["user_emb"], k, max(threshold, 1e-12), decay_days=None, earlier=True).select("query_id", "id", "similarity")


def settle(links: DataFrame) -> DataFrame:
    """(id): the rows that don't go in, of ``links`` (query_id, id), which name all earlier rows that are like a row.

    A row goes in if none of those went in. Rows that links connect are settled together by a plain loop over ids and links, in the task
    that holds them; only of a component of over ``MOST_LINKS`` links the rows are settled by rounds.
    """
    links = kept(links.select("query_id", "id"), "links")
    of = components(links.select(F.col("query_id").alias("a"), F.col("id").alias("b")))
    sized = links.join(of.select(F.col("id").alias("query_id"), "component"), "query_id")
    sizes = kept(sized.groupBy("component").agg(F.count("*").alias("links")), "sizes")
    sized = kept(sized.join(sizes, "component"), "sized")

    def loop(batches):
        held, now = {}, None

        def absorbed():
            out, inside = [], {}
            for q in sorted(held):  # an earlier row without links of its own goes in
                inside[q] = not any(inside.get(i, True) for i in held[q])
                if not inside[q]:
                    out.append(q)
            return pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["id"])

        for batch in batches:
            for component, q, i in zip(*(c.to_pylist() for c in batch.columns)):
                if component != now:
                    if held:
                        yield absorbed()
                    held, now = {}, component
                held.setdefault(q, []).append(i)
        if held:
            yield absorbed()

    small = sized.where(F.col("links") <= MOST_LINKS).select("component", "query_id", "id")
    found = small.repartition("component").sortWithinPartitions("component").mapInArrow(loop, "id long")
    large = sized.where(F.col("links") > MOST_LINKS).select("query_id", "id")
    return found if sizes.where(F.col("links") > MOST_LINKS).isEmpty() else found.union(_settle_by_rounds(large))


def _settle_by_rounds(links: DataFrame) -> DataFrame:
    """As ``settle``, over links alone: rows without an open earlier one go in, and later rows like those are out."""
    going, out = kept(links, "open"), None
    while not going.isEmpty():
        waits = going.select(F.col("query_id").alias("id")).distinct()
        new = going.select("id").distinct().join(waits, "id", "left_anti")
        gone = kept(going.join(new, "id", "left_semi").select(F.col("query_id").alias("id")).distinct(), "settled")
        out = gone if out is None else out.union(gone)
        closed = gone.select(F.col("id").alias("query_id"))
        going = kept(going.join(closed, "query_id", "left_anti").join(gone, "id", "left_anti"), "open")
    return out if out is not None else links.select("id").limit(0)


def resolve(stored: DataFrame | Callable[[DataFrame], DataFrame], incoming: DataFrame, threshold: float = 0.92) -> tuple[DataFrame, DataFrame]:
    """(inserted rows of ``incoming``, touches (id, by, at)): ``at`` is the time of the row that touched a memory.

    A row goes in if no stored memory and no earlier row that goes in is alike; else it touches the one most alike. What is stored is given as rows, or as a function that
    finds the stored memory most alike to (query_id, agent_id, query_emb).

    The rows that no stored memory is like are compared with each other once. If no row has more than ``MOST_ALIKE`` earlier ones, these are all the links there
    are, and ``settle`` decides. In a denser batch the rows without any earlier one go in first and take those like them out of the
    batch, so that groups of near copies never become all their pairs; the rest is compared again. Of the rest, only the best pair of each row and block
    leaves a task. Rows of an agent with equal vectors are one row until touches are told.
    """
    incoming = kept(incoming, "incoming")
    found = stored(as_queries(incoming)) if callable(stored) else retrieval.find_duplicates(as_queries(incoming), stored, threshold)
    known = kept(found.select("query_id", "id", "similarity"), "known")
    light = incoming.select("id", "agent_id", "user_emb").join(known.select(F.col("query_id").alias("id")), "id", "left_anti")
    # of equal vectors that are like themselves only the first can go in, those too near the threshold to tell are compared; null vectors are like nothing
    norm = F.sqrt(F.aggregate("user_emb", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    alone = F.when(F.isnan(norm) | (norm < threshold + 1e-6), F.col("id"))
    going = light.where("user_emb IS NOT NULL").groupBy("agent_id", "user_emb", alone.alias("alone")).agg(F.min("id").alias("id")).select("id", "agent_id", "user_emb")
    inserted = light.where("user_emb IS NULL").select("id")
    going = kept(going, "open")
    while not going.isEmpty():
        links = kept(earlier_like(going, going, MOST_ALIKE + 1, threshold), "alike")
        most = links.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
        if most <= MOST_ALIKE:
            out = settle(links) if most else going.select("id").limit(0)
            inserted = inserted.union(kept(going.join(out, "id", "left_anti").select("id"), "inserted"))
            break
        new = kept(going.join(links.select(F.col("query_id").alias("id")).distinct(), "id", "left_anti"), "inserted")
        settled = earlier_like(going, new, 1, threshold).select(F.col("query_id").alias("id")).distinct().union(new.select("id"))
        inserted = inserted.union(new.select("id"))
        going = kept(going.join(kept(settled, "settled"), "id", "left_anti"), "open")
    inserted = kept(inserted, "all-inserted")
    rows = incoming.join(inserted, "id", "left_semi")
    rest = incoming.join(inserted, "id", "left_anti")
    near = earlier_like(rest, rows.select("id", "agent_id", "user_emb"), 1, threshold).unionByName(known)
    best = near.groupBy("query_id").agg(F.max_by("id", F.struct("similarity", -F.col("id"))).alias("id"))
    return rows, best.join(incoming.select(F.col("id").alias("query_id"), F.col("created_at").alias("at")), "query_id").select("id", F.col("query_id").alias("by"), "at")


def read_store(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/memories")


def start(spark: SparkSession, source: str, target: str, checkpoint: str, threshold: float = 0.92, files: int = 16):
    """A query that reads new files of exchanges, at most ``files`` a batch, into ``target``/memories and ``target``/touches.

    Each batch writes folders of its own number, so a batch that runs again replaces what it wrote. User vectors are also kept by cluster, and a batch reads only
    the clusters within its reach.
    """
    columns = [f.name for f in SAVE_EVENTS.fields]

    def write(batch: DataFrame, number: int) -> None:
        near = Clusters(f"{target}/clusters")
        rows, touches = resolve(lambda q: near.alike(q, threshold, before=number), batch, threshold)
        rows = kept(rows, "new")
        near.append(rows.select("id", "agent_id", F.col("user_emb").alias("vector")), number)
        days = both_mentioned_days(F.col("user_text"), F.col("assist_text"), F.col("created_at"))
        rows.select(*columns, F.lit(1).alias("access_count"), days.alias("mentioned_days")).write.mode("overwrite").parquet(f"{target}/memories/batch={number}")
        touches.write.mode("overwrite").parquet(f"{target}/touches/batch={number}")

    events = spark.readStream.schema(SAVE_EVENTS).option("maxFilesPerTrigger", files).parquet(source)
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
