"""Replies kept by the digest of what was asked: a model answers each text once, whatever runs ask for it again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import cache_misses
from .scratch import exists, kept


@dataclass
class Memo:
    """A folder of (key, reply) by run and portion. A run asks in ``portions``, each written as a whole, so what was answered before a failure isn't asked again."""

    root: str
    portions: int = 4
    reply: str = "string"

    def read(self, spark: SparkSession) -> DataFrame:
        """(key, reply, run, portion)."""
        schema = f"key string, reply {self.reply}, run int, portion int"
        if not exists(spark, f"{self.root}/replies"):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{self.root}/replies").parquet(f"{self.root}/replies")

    def ask(self, texts: DataFrame, model: Callable[[str], Column], run: int) -> DataFrame:
        """(key, text, reply) of the distinct texts of ``texts`` (text); ``model`` is a column function, called only for texts without a reply. Null texts aren't asked.

        A run that is repeated goes on where it failed, and replaces portions that it finds incomplete.
        """
        spark = texts.sparkSession
        asked = kept(texts.select("text").where("text IS NOT NULL").distinct(), "asked")
        missing = kept(cache_misses(asked, self.read(spark)).withColumn("portion", F.pmod(F.xxhash64("key"), F.lit(self.portions)).cast("int")), "missing")
        for portion in [r.portion for r in missing.select("portion").distinct().orderBy("portion").collect()]:
            path = f"{self.root}/replies/run={run}/portion={portion}"
            old = spark.read.schema(f"key string, reply {self.reply}").parquet(path) if exists(spark, path) else None
            new = missing.where(F.col("portion") == portion).select("key", model("text").alias("reply"))
            # a text that the same run asks for later joins what its portion has
            whole = new if old is None else new.unionByName(kept(old, "answered"))
            whole.write.mode("overwrite").parquet(path)
        return asked.withColumn("key", F.sha2("text", 256)).join(self.read(spark).select("key", "reply"), "key").select("key", "text", "reply")

    def merge(self, spark: SparkSession, root: str) -> Memo:
        """The same replies as one run of a new folder."""
        self.read(spark).select("key", "reply").write.mode("overwrite").parquet(f"{root}/replies/run=0/portion=0")
        return Memo(root, self.portions, self.reply)
