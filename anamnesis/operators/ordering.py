"""Running sums over groups of any size.

A window sorts each of its groups in one task. That is the better plan while groups are small, which is checked; beyond
``MOST_ROWS`` rows are range-partitioned by group and order instead, and each partition adds the sums of the partitions before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Rows of a group up to which one task sorts it.
MOST_ROWS = 1_000_000


def running_sums(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], most: int | None = None) -> DataFrame:
    """``rows`` with the running sums of ``sums`` in the order within their groups, each row included. The order must leave no ties."""
    most = MOST_ROWS if most is None else most
    largest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= most:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *(F.sum(c).over(w).alias(n) for n, c in sums.items()))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select("*", *(c.alias(f"_of_{name}") for name, c in sums.items()))
    # written, so that the partitions that are summed are those that are read
    placed = kept(placed.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    totals = placed.groupBy(*by, "_part").agg(*(F.sum(f"_of_{name}").alias(f"_in_{name}") for name in sums))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of a group
    starts = totals.select(*by, "_part", *(F.coalesce(F.sum(f"_in_{name}").over(before), F.lit(0)).alias(f"_from_{name}") for name in sums))
    same = [placed[c].eqNullSafe(starts[c]) for c in (*by, "_part")]
    joined = placed.join(starts, same).drop(*(starts[c] for c in (*by, "_part")))
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.select("*", *((F.col(f"_from_{name}") + F.sum(f"_of_{name}").over(within)).alias(name) for name in sums))
    return out.select(*rows.columns, *sums)
