"""Incremental scoring and event-time windows with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinmap.operators import pairs, release


def score_batch(existing: DataFrame, new: DataFrame, id: str, vector: str) -> DataFrame:
    """Pairs that a batch adds; rows whose id is there already are left out, so a replayed batch adds nothing."""
    fresh = release.insert_ignore(existing, new, [id])
    return pairs.delta_pairs(fresh, existing, id, vector)


def stream_vectors(spark: SparkSession, source: str, state: str, sink: str, checkpoint: str, id: str = "vec_id", vector: str = "embedding", files_per_batch: int = 1) -> StreamingQuery:
    """Read new vectors from Parquet files, score them against all earlier ones, and append pairs and vectors.

    A batch writes under its own number, replacing what a failed attempt left, so a restart from the checkpoint neither
    loses nor repeats a pair.
    """
    schema = spark.read.parquet(source).schema

    def write(batch: DataFrame, number: int) -> None:
        held = batch.sparkSession
        seen = held.read.schema(schema).option("recursiveFileLookup", True).parquet(state)
        earlier = seen.withColumn("_file", F.input_file_name()).filter(~F.col("_file").contains(f"/batch-{number:06d}/")).drop("_file")
        fresh = release.insert_ignore(earlier, batch, [id])
        score_batch(earlier, batch, id, vector).write.mode("overwrite").parquet(f"{sink}/batch-{number:06d}")
        fresh.write.mode("overwrite").parquet(f"{state}/batch-{number:06d}")

    spark.createDataFrame([], schema).write.mode("append").parquet(f"{state}/start")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_versions(pointer: DataFrame, registered: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Pointer after a batch: the newest registered version wins, so a late or replayed one never becomes current."""
    return release.latest(pointer.unionByName(registered), keys, [F.desc(order)])


def windowed(events: DataFrame, time: str, length: str, slide: str | None, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums by event-time window; on a stream, events later than `late` are dropped."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, length, slide) if slide else F.window(time, length)
    grouped = rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Sessions of each key, which end when nothing follows for the gap."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = rows.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def replay(spark: SparkSession, source: str, transform: Callable[[DataFrame], DataFrame], name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a transform over a folder as a stream to its end, and give back what its sink holds."""
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
