"""A folder for intermediate tables that driver and executors share."""

from __future__ import annotations

import gc
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session may do without one: a temporary folder is set for it, once."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='anamnesis-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there is scratch: it may be removed whenever no job runs."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df, name: str):
    """Write a table and read it back, so that what follows doesn't compute it again."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files that nothing refers to any more; it finds those only when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, wherever Spark can read."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_bytes(spark: SparkSession, path: str, payload: bytes) -> None:
    """One small file, wherever Spark can write."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(payload))
    out.close()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so that tasks can import it."""
    context = spark.sparkContext
    if not getattr(context, "_anamnesis_shipped", False):
        package, data = Path(__file__).resolve().parents[1], io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        path = f"{scratch(spark, 'anamnesis')}.zip"
        write_bytes(spark, path, data.getvalue())
        context.addPyFile(path)
        context._anamnesis_shipped = True
    return spark
