"""Cutting the lineage of iterative plans in a folder that all executors share, and sending this package to them."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tessera_sent", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        path = Path(tempfile.mkdtemp(prefix="tessera-package-")) / "tessera.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        context.addPyFile(str(path))
    context._tessera_sent = True


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    ship(spark)
    path = f"{scratch_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._tessera_path = path
    return table


def cut_watched(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``cut``, with aggregates of the rows that are taken while they are written (no second pass over them)."""
    seen = Observation()
    table = cut(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name)
    return table, seen.get


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that ``cut`` gave, when a loop has written the next one; other frames are left."""
    if place := getattr(df, "_tessera_path", None):
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of frames that Python no longer holds."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
