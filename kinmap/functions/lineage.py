"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder if all runs in one process, else the warehouse's."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        alone = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        path = "file://" + tempfile.mkdtemp(prefix="kinmap-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/kinmap-scratch"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of any store that Hadoop knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def tidy(spark: SparkSession) -> None:
    """Ask for what nothing refers to any more, so that shuffle files of finished steps go before the next step writes its own."""
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: filters and columns are pushed into that scan, and a lost executor
    takes nothing with it. The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinmap-cut-{uuid.uuid4().hex[:16]}"
    df.write.parquet(path)

    def clear() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass

    atexit.register(clear)
    return spark.read.schema(df.schema).parquet(path)
