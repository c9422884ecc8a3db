"""A kept inverted index: postings by term and block of ids, changed batch by batch, searched exactly for the best k.

A folder holds
- ``postings``: (bucket, term, agent_id, block, id, tf, length), a row for each term of a memory; a block is a range of ``span`` ids;
- ``heads``: (bucket, term, agent_id, block, n, most, shortest), a row for each term and block of a batch: how many memories have the
  term, the largest tf and the smallest length. Heads are partial sums: the memories with a term are the sum of its heads. The heads of the
  empty term, which no text has, count memories, and their words in ``most``;
- ``removed``: (id), the memories that a batch takes out. Its heads are negative.

Agents are '' for memories of all.

Everything is written as batch=<number>, so that a batch that runs again replaces what it wrote, and touches no other batch's
files. A removal counts for postings of earlier batches only, so a memory can be put in anew. What was removed stays in
the files, and loosens bounds, until ``rebuild``.

A search reads the heads and postings of its terms alone (the bucket is a folder), deals the postings by memory once and keeps
them so on disk. Queries come in lots, each small enough to broadcast, and a task sums up the scores of its memories for a lot: no pair of
query and memory is shuffled but those that can be among the best. The k-th best score in some chunks of memories is what pairs of further chunks have to
reach, and each step takes ``FURTHER`` times as many chunks, so that about ``FURTHER`` times ``k`` pairs of a query go on. Disk grows with postings and
results, time with queries times memories. Nothing passes through the driver but a few numbers and the lots that are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import exists, kept, release, scratch

#: BM25's parameters, and the weight of a term that over half of the documents have.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6

POSTINGS = "bucket int, term string, agent_id string, block long, id long, tf int, length int, batch int"
HEADS = "bucket int, term string, agent_id string, block long, n long, most long, shortest long, batch int, sign int"
REMOVED = "id long, batch int"
FOUND = "query_id long, id long, score double, rank int"
#: More than rounding can add to a score.
SLACK = 1e-8
#: The memories of a chunk, the terms of the queries of a lot, by how much each step of a search has more chunks than those before, and the share of light terms.
CHUNK, LOT, FURTHER, LIGHT = 256, 400_000, 16, 0.3


def impact(tf: Column, length: Column, average: Column) -> Column:
    """What a term adds per unit of its weight; it grows with tf and shrinks with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


@dataclass
class Index:
    """An index in a folder. ``terms`` cuts (user_text, assist_text) into words. ``span`` ids should hold some hundred memories, and a bucket's postings some hundred MB."""

    root: str
    terms: Column
    buckets: int = 4
    span: int = 200_000

    def bucket(self, term: Column | str = "term") -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int").alias("bucket")

    def read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        if not exists(spark, f"{self.root}/{name}"):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{self.root}/{name}").option("ignoreMissingFiles", True).parquet(f"{self.root}/{name}")

    @staticmethod
    def _parts(spark: SparkSession) -> int:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that small batches are spread too

    def words(self, memories: DataFrame) -> DataFrame:
        """(id, agent_id, block, term, length), a row for each word; a memory without words has one of the empty term and length 0."""
        own = memories.select("id", F.coalesce("agent_id", F.lit("")).alias("agent_id"), F.floor(F.col("id") / self.span).alias("block"), self.terms.alias("words"))
        return own.select("id", "agent_id", "block", F.size("words").alias("length"), F.explode_outer("words").alias("term")).fillna("", "term")

    def add(self, memories: DataFrame, number: int) -> None:
        """Put memories in as a batch. Memories are (id, agent_id, user_text, assist_text); ids must not be in the index."""
        keys = ["term", "agent_id", "block", "id", "length"]
        # the rows of a memory lie in one task, so most of this count is done before it shuffles
        found = self.words(memories).groupBy(*keys).agg(F.count("*").cast("int").alias("tf")).withColumn("bucket", self.bucket())
        path = f"{self.root}/postings/batch={number}"
        sorted_ = found.repartition(self._parts(found.sparkSession), "bucket", "term").sortWithinPartitions("bucket", "term", "agent_id", "block", "id")
        sorted_.select("bucket", "term", "agent_id", "block", "id", "tf", "length").write.mode("overwrite").partitionBy("bucket").parquet(path)
        self._write_heads(found.sparkSession.read.schema(POSTINGS.rsplit(",", 1)[0]).option("basePath", path).parquet(path), number, 1)

    def _write_heads(self, postings: DataFrame, number: int, sign: int) -> None:
        real = postings.where("term <> ''").groupBy("bucket", "term", "agent_id", "block").agg(
            (F.count("*") * sign).alias("n"), F.max("tf").cast("long").alias("most"), F.min("length").cast("long").alias("shortest"))
        if sign < 0:
            real = real.withColumn("most", F.lit(0).cast("long"))
        # each memory once: by its words, of which every posting knows its share
        whole = postings.groupBy("agent_id", "block").agg(F.count_distinct("id").alias("n"), F.sum(F.when(F.col("term") != "", F.col("tf"))).alias("most"))
        term = whole.select(F.lit("").alias("term"), "agent_id", "block", (F.col("n") * sign).alias("n"), (F.coalesce("most", F.lit(0)) * sign).alias("most"), F.lit(0).cast("long").alias("shortest"))
        term = term.select(self.bucket(), "*")
        real.unionByName(term).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/heads/batch={number}/sign={sign}")

    def remove(self, memories: DataFrame, number: int) -> None:
        """Take memories out, as a batch; they are given with the texts that they were put in with."""
        keys = ["term", "agent_id", "block", "id", "length"]
        gone = kept(self.words(memories).groupBy(*keys).agg(F.count("*").cast("int").alias("tf")).withColumn("bucket", self.bucket()), "removed")
        gone.select("id").distinct().write.mode("overwrite").parquet(f"{self.root}/removed/batch={number}")
        self._write_heads(gone, number, -1)

    def removed(self, spark: SparkSession) -> DataFrame:
        """(id, until): ids with the last batch that removed them."""
        return self.read(spark, "removed", REMOVED).groupBy("id").agg(F.max("batch").alias("until"))

    def live(self, postings: DataFrame) -> DataFrame:
        """Postings that no later batch removed."""
        gone = self.removed(postings.sparkSession)
        return postings.join(gone, (postings["id"] == gone["id"]) & (postings["batch"] < gone["until"]), "left_anti")

    def rebuild(self, spark: SparkSession, root: str) -> Index:
        """The same index without removed memories, as one batch of a new folder."""
        new = Index(root, self.terms, self.buckets, self.span)
        path = f"{root}/postings/batch=0"
        rows = self.live(self.read(spark, "postings", POSTINGS)).drop("batch")
        rows.repartition(self._parts(spark), "bucket", "term").sortWithinPartitions("bucket", "term", "agent_id", "block", "id").write.mode("overwrite").partitionBy("bucket").parquet(path)
        new._write_heads(spark.read.schema(POSTINGS.rsplit(",", 1)[0]).option("basePath", path).parquet(path), 0, 1)
        return new

    def size(self, spark: SparkSession) -> tuple[int, float]:
        """The number of memories, and their words on average."""
        whole = self.read(spark, "heads", HEADS).where((F.col("term") == "") & (F.col("bucket") == self.bucket(F.lit(""))))
        n, words = whole.agg(F.sum("n"), F.sum("most")).first()
        return n or 0, float(words or 0) / (n or 1)

    def weights(self, asked: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """(query_id, asking, bucket, term, weight), and the heads of these terms by block. ``asked`` is (query_id, agent_id, terms)."""
        heads = self.read(asked.sparkSession, "heads", HEADS)
        times = asked.select("query_id", F.col("agent_id").alias("asking"), F.explode("terms").alias("term")).groupBy("query_id", "asking", "term").agg(F.count("*").alias("times"))
        times = kept(times.withColumn("bucket", self.bucket()), "asked")
        own = heads.join(times.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").groupBy("bucket", "term", "agent_id", "block").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("shortest").alias("shortest"))
        own = kept(own, "own")
        idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        df = own.groupBy("bucket", "term").agg(F.sum("n").alias("df")).where("df > 0")
        weights = times.join(df, ["bucket", "term"]).withColumn("weight", F.col("times") * F.when(idf > 0, idf).otherwise(LEAST_IDF))
        return weights.select("query_id", "asking", "bucket", "term", "weight"), own

    def bounds(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, bucket, term, agent_id, block, weight) and (query_id, agent_id, block, bound) of what each query may see. ``asked`` is (query_id, agent_id, terms)."""
        spark = asked.sparkSession
        n, average = self.size(spark)
        average = F.lit(average)
        weights, own = self.weights(asked, n)
        most = F.col("weight") * impact(F.col("most"), F.col("shortest"), average)
        met = weights.join(own.where("n > 0"), ["bucket", "term"]).where("agent_id = '' OR agent_id = asking")
        met = met.select("query_id", "bucket", "term", "agent_id", "block", "weight", most.alias("most"), average.alias("average"))
        met = kept(met.repartition(self._parts(spark), "query_id"), "met")
        return met, met.groupBy("query_id", "agent_id", "block").agg(F.sum("most").alias("bound"))

    def present(self, spark: SparkSession) -> DataFrame:
        """The postings of memories that weren't removed."""
        postings = self.read(spark, "postings", POSTINGS)
        return self.live(postings) if exists(spark, f"{self.root}/removed") else postings

    def scores(self, met: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score) of the memories of some (query_id, agent_id, block), or of all."""
        postings = self.present(met.sparkSession)
        wanted = met if blocks is None else met.join(blocks, ["query_id", "agent_id", "block"], "left_semi")
        parts = postings.join(wanted, ["bucket", "term", "agent_id", "block"])
        return parts.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * impact(F.col("tf"), F.col("length"), F.col("average"))), 9).alias("score"))

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank): the best k memories of each query that its agent may see, ties to the lower id."""
        spark = asked.sparkSession
        n, average = self.size(spark)
        weights, own = self.weights(asked, n)
        # a number for each term of an agent, with the most that it adds to a score
        most = F.max(impact(F.col("most"), F.col("shortest"), F.lit(average))).alias("most")
        codes = kept(own.groupBy("bucket", "term", "agent_id").agg(most).withColumn("code", F.monotonically_increasing_id()), "codes")
        seen = weights.withColumn("agent_id", F.explode(F.array_distinct(F.array(F.lit(""), "asking")))).join(codes, ["bucket", "term", "agent_id"])
        # a memory is seen with one agent, so a term adds the most of either
        most = F.max(F.col("weight") * F.col("most")).over(Window.partitionBy("query_id", "term")).alias("most")
        seen = kept(seen.select("query_id", "term", "code", "weight", most, F.row_number().over(Window.partitionBy("query_id", "term").orderBy("code")).alias("nth")), "seen")
        chunks, lots = max(1, -(-n // CHUNK)), max(1, -(-seen.count() // LOT))
        dealt = self.present(spark).join(codes, ["bucket", "term", "agent_id"]).select(
            F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk"), "code", "id", impact(F.col("tf"), F.col("length"), F.lit(average)).alias("impact"))
        dealt = dealt.repartition(chunks, "id").persist(StorageLevel.DISK_ONLY)
        dealt.count()  # once it is kept, Spark knows how it is dealt and shuffles no pairs
        release(spark)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        paths = []
        for lot in range(lots):
            terms, found, low = seen.where(F.pmod(F.xxhash64("query_id"), F.lit(lots)) == lot), None, 0
            while low < chunks:
                high = min(chunks, max(1, low * FURTHER))
                scored = self._scored(dealt.where((F.col("chunk") >= low) & (F.col("chunk") < high)), terms, found, k).where("score > 0")
                path, low = scratch(spark, "found"), high
                scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).write.option("compression", "zstd").parquet(path)
                found = spark.read.schema(FOUND).parquet(path)
            paths.append(path)
            scored = None
            release(spark)  # so that the disk holds the shuffles of a lot and not of all
        dealt.unpersist()
        return spark.read.schema(FOUND).parquet(*paths)

    @staticmethod
    def _scored(dealt: DataFrame, terms: DataFrame, found: DataFrame | None, k: int) -> DataFrame:
        """(query_id, id, score) of pairs in some chunks, and what was found before; of those in the chunks, all that reach the k-th found.

        Terms that add little, together under ``LIGHT`` of that score, are added only to pairs that can still reach it.
        """
        pair, adds = ["query_id", "id"], F.sum(F.col("weight") * F.col("impact"))
        if found is None:
            return dealt.join(F.broadcast(terms.select("query_id", "code", "weight")), "code").groupBy(*pair).agg(F.round(adds, 9).alias("score"))
        reached = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
        below = Window.partitionBy("query_id").orderBy("most", "term", "nth")
        terms = terms.join(F.broadcast(reached), "query_id", "left").withColumn("upto", F.sum(F.when(F.col("nth") == 1, F.col("most")).otherwise(0.0)).over(below))
        terms = terms.withColumn("light", F.coalesce(F.col("upto") < LIGHT * F.col("reached"), F.lit(False)))
        rest = F.max(F.when(F.col("light"), F.col("upto")).otherwise(0.0)).over(Window.partitionBy("query_id"))
        terms = kept(terms.select("query_id", "code", "weight", "light", (F.col("reached") - rest - SLACK).alias("need")), "terms")
        heavy = terms.where("NOT light").select("query_id", "code", "weight", "need")
        light = terms.where("light").groupBy("query_id").agg(F.collect_list(F.struct("code", "weight")).alias("lights"))
        part = dealt.join(F.broadcast(heavy), "code").groupBy(*pair).agg(adds.alias("part"), F.first("need").alias("need")).where("need IS NULL OR part >= need")
        words = dealt.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("code", "impact"))).alias("words"))
        more = part.join(words.hint("shuffle_hash"), "id").join(F.broadcast(light), "query_id", "left")
        total = F.aggregate(F.coalesce("lights", F.array()), F.col("part"), lambda t, x: t + x["weight"] * F.coalesce(F.try_element_at("words", x["code"]), F.lit(0.0)))
        scored = more.select(*pair, F.round(total, 9).alias("score"))
        scored = scored.join(F.broadcast(reached), "query_id", "left").where("reached IS NULL OR score >= reached").drop("reached")
        return scored.unionByName(found.drop("rank"))

    def ruled_out(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, blocks, scored): how many blocks have a term of each query, and how many heads can't rule out once the most promising are scored."""
        met, bounds = self.bounds(asked)
        bounds = kept(bounds.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block", "agent_id"))), "bounds")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        reached = self.scores(met, bounds.where(F.col("place") <= k)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
        need = (F.col("place") <= k) | F.col("reached").isNull() | (F.col("bound") >= F.col("reached") - SLACK)
        return bounds.join(reached, "query_id", "left").groupBy("query_id").agg(F.count("*").alias("blocks"), F.count_if(need).alias("scored"))
