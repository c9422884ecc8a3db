"""Vectors kept by cluster, and searches that leave out the clusters that can't matter.

A store has a fixed set of pivots. Every vector lies in the cluster of its nearest pivot, a folder of its own, and each cluster has the
least and greatest angle to its pivot. By the triangle inequality for angles, no vector of a cluster is nearer to a query than the query's angle
to the pivot less the greatest (or the least less the query's angle). So a search with a threshold reads only clusters that some query can reach, and
multiplies each query only with those that it can reach itself; a search for the best k first takes each query's nearest cluster, and what it finds there is the threshold for
the others. Results are those of a search without clusters, for which stored vectors are unit vectors as they are. How much is left out depends on how the vectors lie: ``skipped`` tells.

Batches are folders, so a batch that runs again replaces what it wrote; pivots are chosen once, from the first batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import matrix, unit_rows
from ..sources.scratch import exists
from . import retrieval

#: Pivots at most, vectors that each of them is chosen from, and what rounding may add to a cosine.
MOST_PIVOTS, SAMPLE, SLACK = 1024, 8, 1e-7

ROWS = "id long, agent_id string, vector array<double>, batch int, cluster int"
RADII = "cluster int, n long, near double, far double, long double, batch int"


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """At most n of some unit vectors, each the one furthest from those before it."""
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


@dataclass
class Clusters:
    """A store of vectors in a folder, with ``pivots`` pivots or the square root of the first batch's size."""

    root: str
    pivots: int | None = None

    def _pivots(self, spark: SparkSession) -> np.ndarray:
        rows = spark.read.schema("place int, vector array<double>").parquet(f"{self.root}/pivots").orderBy("place").collect()  # at most MOST_PIVOTS
        return np.array([r.vector for r in rows]).reshape(len(rows), -1)

    def append(self, rows: DataFrame, number: int) -> None:
        """Put (id, agent_id, vector) in as a batch; rows whose vector is null, zero or of another length are like nothing and are left out."""
        spark = rows.sparkSession
        rows = rows.select("id", "agent_id", F.col("vector").cast("array<double>").alias("vector"))
        real = rows.where(F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
        if not exists(spark, f"{self.root}/pivots"):
            n = self.pivots or min(MOST_PIVOTS, max(1, int(np.sqrt(real.count()))))
            first = real.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * n).select("vector").collect()
            if not first:
                return
            length = len(first[0].vector)
            unit = spread(unit_rows(np.array([r.vector for r in first if len(r.vector) == length])), n)
            spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "place int, vector array<double>").coalesce(1).write.parquet(f"{self.root}/pivots")
        shared = spark.sparkContext.broadcast(self._pivots(spark))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots = shared.value
            for batch in batches:
                x, good = matrix(batch.column(2), pivots.shape[1])
                batch, angle = batch.filter(pa.array(good)), angles(unit_rows(x[good]), pivots)
                own = angle.argmin(1) if len(angle) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(angle[np.arange(len(own)), own]), pa.array(np.linalg.norm(x[good], axis=1))], ["id", "agent_id", "vector", "cluster", "angle", "norm"])

        placed = real.mapInArrow(place, "id long, agent_id string, vector array<double>, cluster int, angle double, norm double")
        path = f"{self.root}/rows/batch={number}"
        placed.repartition("cluster").write.mode("overwrite").partitionBy("cluster").parquet(path)
        if not exists(spark, path):
            return
        kept = spark.read.schema("angle double, norm double, cluster int").option("basePath", path).parquet(path)
        kept.groupBy("cluster").agg(F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"), F.max("norm").alias("long")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/radii/batch={number}")

    def _rows(self, spark: SparkSession, before: int | None) -> DataFrame:
        if not exists(spark, f"{self.root}/rows"):
            return spark.createDataFrame([], ROWS)
        rows = spark.read.schema(ROWS).option("basePath", f"{self.root}/rows").option("ignoreMissingFiles", True).parquet(f"{self.root}/rows")
        return rows if before is None else rows.where(F.col("batch") < before)

    def _radii(self, spark: SparkSession, before: int | None) -> np.ndarray:
        """(n, near, far, long) by cluster: how many, their least and greatest angle, their greatest length."""
        out = np.tile([0.0, np.inf, -np.inf, 1.0], (len(self._pivots(spark)), 1))
        if exists(spark, f"{self.root}/radii"):
            rows = spark.read.schema(RADII).option("basePath", f"{self.root}/radii").parquet(f"{self.root}/radii")
            rows = rows if before is None else rows.where(F.col("batch") < before)
            for r in rows.groupBy("cluster").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far"), F.max("long").alias("long")).collect():
                out[r.cluster] = r.n, r.near, r.far, r.long
        return out

    def _reach(self, spark: SparkSession, before: int | None):
        """A function from unit vectors to the greatest product that each cluster can have with them; -2 for empty ones. Products under zero don't matter to any search."""
        pivots, radii = self._pivots(spark), self._radii(spark, before)

        def most(x: np.ndarray) -> np.ndarray:
            angle = angles(x, pivots)
            apart = np.maximum(0.0, np.maximum(angle - radii[:, 2], radii[:, 1] - angle))
            return np.where(radii[:, 0] > 0, np.cos(np.minimum(apart, np.pi)) * radii[:, 3] + SLACK, -2.0)

        return most, radii[:, 0]

    def _search(self, queries: DataFrame, k: int, before: int | None, most, chosen=None) -> DataFrame:
        """(query_id, id, similarity): per block, the best k of each query whose ``least`` is reached. ``chosen`` (bounds, leasts -> mask) says which clusters a query asks."""
        spark = queries.sparkSession
        chosen = chosen or (lambda bounds, least: bounds >= least[:, None])

        def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = retrieval.Queries(batch.column(0).to_pylist(), [""] * batch.num_rows, batch.column(1).to_pylist())
                if q.dim:
                    mask = chosen(most(q.vectors), batch.column(2).to_numpy(zero_copy_only=False)) & (np.abs(q.vectors).sum(1) > 0)[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(mask.any(0)), pa.int32())], ["cluster"])

        wanted = [r.cluster for r in queries.select("query_id", "query_emb", "least").mapInArrow(needed, "cluster int").distinct().collect()]  # at most MOST_PIVOTS
        rows = self._rows(spark, before).where(F.col("cluster").isin(wanted) if wanted else F.lit(False))

        def task(q: retrieval.Queries, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if "mask" not in q.extra:
                real = np.abs(q.vectors).sum(1) > 0
                q.extra["mask"] = chosen(most(q.vectors), np.array(q.extra["least"], float)) & real[:, None] if q.dim else np.zeros((len(q.ids), 1), bool)
            ids, cluster = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            x, good = matrix(batch.column(3), q.dim)
            found = []
            for agent, mine in retrieval.by_agent(batch.column(1).to_pylist(), ids).items():
                seeing = q.of.get(agent, np.zeros(0, int)) if agent else np.arange(len(q.ids))
                mine = mine[good[mine]]
                for c in np.unique(cluster[mine]):
                    asked, part = seeing[q.extra["mask"][seeing, c]], mine[cluster[mine] == c]
                    for at in range(0, len(asked), step := max(1, retrieval.CELLS // max(1, len(part)))):
                        some = asked[at : at + step]
                        similar = np.round(q.vectors[some] @ x[part].T, 9)
                        hit = similar >= np.array(q.extra["least"], float)[some][:, None]
                        for r in np.flatnonzero(hit.any(1)):
                            own = np.flatnonzero(hit[r])
                            own = own[np.argsort(-similar[r, own], kind="stable")[:k]]  # in the order of ids
                            found.append((np.full(len(own), q.ids[some[r]]), ids[part[own]], similar[r, own]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "id", "similarity"])

        held = rows.select("id", "agent_id", F.lit(0.0).alias("created_at"), "vector", "cluster")
        return retrieval.meet(queries, held, ["vector"], task, "query_id long, id long, similarity double", asked=("least",), held=("cluster",))

    def nearest(self, queries: DataFrame, k: int, least: float, before: int | None = None) -> DataFrame:
        """(query_id, rk, id, similarity): the best k of those with at least the cosine ``least``, which is above zero, ties to the lower id. ``queries`` has query_id, agent_id and query_emb."""
        spark, least = queries.sparkSession, max(least, 1e-12)
        if not exists(spark, f"{self.root}/pivots"):
            return spark.createDataFrame([], "query_id long, rk int, id long, similarity double")
        most, _ = self._reach(spark, before)
        ranked = lambda pairs: retrieval.ranked(pairs.withColumn("score", F.col("similarity")), k).drop("score")
        queries = queries.select("query_id", "agent_id", "query_emb", F.lit(float(least)).alias("least"))
        first = lambda bounds, least: (bounds == bounds.max(1, keepdims=True)) & (bounds >= least[:, None])
        near = ranked(self._search(queries, k, before, most, first))
        reached = near.where(F.col("rk") == k).select("query_id", F.greatest("similarity", F.lit(float(least))).alias("reached"))
        queries = queries.join(reached, "query_id", "left").withColumn("least", F.coalesce("reached", "least")).drop("reached")
        return ranked(self._search(queries, k, before, most))

    def alike(self, queries: DataFrame, threshold: float, before: int | None = None) -> DataFrame:
        """(query_id, id, similarity): as ``retrieval.find_duplicates``, over the clusters within reach."""
        if not exists(queries.sparkSession, f"{self.root}/pivots"):
            return queries.sparkSession.createDataFrame([], "query_id long, id long, similarity double")
        most, _ = self._reach(queries.sparkSession, before)
        asked = queries.select("query_id", "agent_id", "query_emb", F.lit(float(max(threshold, 1e-12))).alias("least"))
        return retrieval.ranked(self._search(asked, 1, before, most).withColumn("score", F.col("similarity")), 1).select("query_id", "id", "similarity")

    def skipped(self, queries: DataFrame, threshold: float, before: int | None = None) -> DataFrame:
        """One row (pairs, scored): pairs of queries and stored vectors, and those in clusters within reach of the threshold, whatever the agents."""
        most, n = self._reach(queries.sparkSession, before)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = retrieval.Queries(batch.column(0).to_pylist(), [""] * batch.num_rows, batch.column(1).to_pylist())
                scored = ((most(q.vectors) >= threshold) * n).sum() if q.dim else 0
                yield pa.RecordBatch.from_arrays([pa.array([int(n.sum()) * batch.num_rows]), pa.array([int(scored)])], ["pairs", "scored"])

        return queries.select("query_id", "query_emb").mapInArrow(count, "pairs long, scored long").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))
