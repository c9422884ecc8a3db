"""Shared scratch tables: how the operators of this package cut lineage.

Every intermediate that must not be recomputed is written as Parquet below the
folder that ``spark.checkpoint.dir`` names, which driver and executors share, and
read again. A lost executor then costs only the tasks that it was running.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import kept, shared_root, ship, write_bytes  # noqa: F401


def shared_dir(spark: SparkSession) -> str:
    """The folder of this package below the shared one."""
    return f"{shared_root(spark)}/anamnesis"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the result no longer depends on its inputs."""
    return kept(df, f"anamnesis/{name}")


def publish(spark: SparkSession, name: str, payload: bytes) -> str:
    """Put a small file (at most 64 MB) into the shared folder and hand it to every executor.

    Returns the name for ``SparkFiles.get``; executors fetch their own copy, so it can be memory-mapped there.
    """
    if len(payload) > 64 << 20:
        raise ValueError(f"{name}: {len(payload)} bytes is too much to hand to every executor")
    name = f"{uuid.uuid4().hex}-{name}"
    path = f"{shared_dir(spark)}/{name}"
    write_bytes(spark, path, payload)
    spark.sparkContext.addFile(path)
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
