"""The save path as one stream: exchanges become memories, touches, sentences, facts and evictions.

Every table is a folder with a folder per batch, so a batch that runs again after a failure replaces what it wrote. What is stored now
follows from them: ``live`` puts touches into the memories and leaves out what was evicted or has expired. With a time to live, a second stream (``expire``) sets a timer
for every memory and writes what has expired, by the latest time of all exchanges; what expired absorbs no duplicates any more. A batch is embedded by
whoever writes the files; duplicates are found as in ``ingest``, eviction is decided once per batch, and facts of all exchanges
of a batch are extracted, those of duplicates for the memory that they touched.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fact_prompt
from ..functions.temporal import both_mentioned_days
from ..operators import store
from ..schema import SAVE_EVENTS
from ..sources.scratch import exists, kept
from .ingest import resolve
from .state import expiries

MEMORY_COLUMNS = [f.name for f in SAVE_EVENTS.fields]
SCHEMAS = {
    "memories": "id long, agent_id string, created_at double, user_text string, assist_text string, user_emb array<float>, assist_emb array<float>, access_count int, updated_at double, mentioned_days array<bigint>",
    "touches": "id long, by long, at double", "evicted": "id long", "expired": "id long", "late": "id long",
    "sentences": "memory_id long, side string, idx int, start_byte int, end_byte int, embedding array<float>",
    "facts": "id long, agent_id string, subject string, attribute string, value string, source_memory_id long, created_at double",
}


@dataclass
class Saver:
    """Where the tables are, and what is done with a batch. ``embed`` and ``extract`` are column functions; without them there are no sentences or facts."""

    target: str
    threshold: float = 0.92
    per_agent: int = 1000
    per_global: int = 1000
    ttl_days: float = 0
    embed: Any = None
    extract: Any = None

    def read(self, spark: SparkSession, name: str, before: int | None = None) -> DataFrame:
        """A table as written by the batches before a number, or by all."""
        rows = spark.read.schema(f"{SCHEMAS[name]}, batch int").option("ignoreMissingFiles", True)
        if before == 0 or not exists(spark, f"{self.target}/{name}"):
            return spark.createDataFrame([], SCHEMAS[name])
        found = rows.parquet(f"{self.target}/{name}")
        return (found if before is None else found.where(F.col("batch") < before)).drop("batch")

    def live(self, spark: SparkSession, before: int | None = None, ttl_days: float = 0, now: float = 0) -> DataFrame:
        """The memories that are stored, with the touches that they had."""
        m = self.read(spark, "memories", before).join(self.read(spark, "evicted", before), "id", "left_anti")
        if self.ttl_days > 0:
            m = m.join(self.read(spark, "expired").select("id").distinct(), "id", "left_anti")
        if ttl_days > 0:
            m = m.where(F.col("created_at") >= now - ttl_days * 86400)
        return store.touch(m, self.read(spark, "touches", before).select("id", "at"))

    def sentences(self, spark: SparkSession) -> DataFrame:
        """Sentences of live memories."""
        return self.read(spark, "sentences").join(self.live(spark).select(F.col("id").alias("memory_id")), "memory_id", "left_semi")

    def facts(self, spark: SparkSession) -> DataFrame:
        """Versions of facts, in the order of the exchanges that gave them."""
        return store.supersede(self.read(spark, "facts"))

    def save(self, batch: DataFrame, number: int) -> None:
        """Write what a batch of exchanges does to the tables."""
        spark = batch.sparkSession
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{self.target}/{name}/batch={number}")
        stored = kept(self.live(spark, number), "live")
        rows, touches = resolve(stored, batch, self.threshold)
        days = both_mentioned_days(F.col("user_text"), F.col("assist_text"), F.col("created_at"))
        new = rows.select(*MEMORY_COLUMNS, F.lit(1).alias("access_count"), F.col("created_at").alias("updated_at"), days.alias("mentioned_days"))
        new, touches = kept(new, "new"), kept(touches, "touches")
        put(new, "memories")
        put(touches, "touches")
        if self.ttl_days > 0:  # what comes after its time goes at once; timers have the rest
            latest = self.clock(spark, number).unionByName(batch.select(F.max("created_at").alias("at"))).agg(F.max("at").alias("latest"))
            put(new.crossJoin(F.broadcast(latest)).where(F.col("created_at") < F.col("latest") - self.ttl_days * 86400).select("id"), "late")  # one row
        after = store.touch(stored.unionByName(new), touches.select("id", "at"))
        stays = store.evict(after.select("id", "agent_id", "updated_at", "access_count"), self.per_agent, self.per_global)
        put(after.select("id").join(stays.select("id"), "id", "left_anti"), "evicted")
        if self.embed is not None:
            put(store.sentences(new, self.embed).select([c.split()[0] for c in SCHEMAS["sentences"].split(", ")]), "sentences")
        if self.extract is not None:
            owner = touches.select(F.col("by").alias("id"), F.col("id").alias("owner"))
            told = batch.join(owner, "id", "left").withColumn("found", self.extract(fact_prompt(F.col("user_text"), F.col("assist_text"))))
            each = told.select("id", "agent_id", "created_at", F.coalesce("owner", "id").alias("source_memory_id"), F.posexplode("found").alias("place", "f"))
            put(each.select((F.col("id") * 100 + F.col("place")).alias("id"), "agent_id", "f.subject", "f.attribute", "f.value", "source_memory_id", "created_at"), "facts")

    def clock(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """(at): the times of all exchanges of the batches before a number, kept or not."""
        return self.read(spark, "memories", before).select(F.col("created_at").alias("at")).unionByName(self.read(spark, "touches", before).select("at"))

    def expire(self, spark: SparkSession, checkpoint: str):
        """A query that writes the memories whose time is over to ``expired``, as far as batches have been saved. Rows of a batch that runs again count once."""
        stream = lambda name: spark.readStream.schema(f"{SCHEMAS[name]}, batch int").parquet(f"{self.target}/{name}")
        times = stream("memories").select("id", F.col("created_at").alias("at")).unionByName(stream("touches").select(F.lit(None).cast("long").alias("id"), "at"))
        gone = expiries(times, self.ttl_days)

        def put(rows: DataFrame, number: int) -> None:
            late = self.read(rows.sparkSession, "late")
            rows.select("id").unionByName(late).distinct().write.mode("overwrite").parquet(f"{self.target}/expired/batch={number}")

        return gone.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def start(self, spark: SparkSession, source: str, checkpoint: str, files: int = 16):
        """A query that reads new files of exchanges, at most ``files`` a batch: a rate limit that drops nothing."""
        events = spark.readStream.schema(SAVE_EVENTS).option("maxFilesPerTrigger", files).parquet(source)
        return events.writeStream.foreachBatch(self.save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
