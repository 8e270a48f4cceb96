"""What the operators of this subpackage share: the shared folder, written tables and Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words in the contracts of this subpackage.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where that is unset, a temporary folder if driver and executors are one process, and else one in the warehouse.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            path = "file://" + tempfile.mkdtemp(prefix="kinmap-")
        else:
            path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/kinmap-scratch"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path through Hadoop's file systems, so any store works."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written to the shared folder. They cut lineage and outlive a lost executor.

    drop() removes one as soon as nothing reads it; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kinmap-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        atexit.register(self._clear)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kinmap_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        delete_path(self.spark, df._kinmap_path)

    def _clear(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


def width(spark: SparkSession) -> int:
    """Partitions of an explicit exchange: the session's own setting, which grows with the cluster and the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished steps now rather than at its next collection."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def small(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about so many bytes of one column, so that Python objects of few rows live at once."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes.tolist()):
            size += n
            if size >= most:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


class Memo(dict):
    """A bounded memory of compute(key): when it has `most` entries it becomes the old generation of a new one.

    Keys of more than `longest` characters are computed each time, so that texts without spaces fill no memory.
    """

    most = 100_000
    longest = 64

    def __init__(self) -> None:
        self.old: dict = {}

    def compute(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


ROW = "_kinmap_row"


def packed(docs: DataFrame, *more: str) -> DataFrame:
    """All columns of docs in the one struct ROW, with columns `more` beside it, so that no other name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), *more)


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(ROW).getField(c).alias(c) for c in columns])


def numbered(docs: DataFrame, nulls_first: bool = True) -> tuple[DataFrame, bool]:
    """docs with _doc_no, a number of each document in the order of doc_id: doc_id itself where that is unique and set.

    Else documents are the different pairs of doc_id and text, those of one id in the order of a hash of the text, and
    null ids stand at one end; the number ascends in that order. Wholly repeated rows share their number. The second value
    says whether the number is doc_id itself.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    total, there, distinct = ids.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if total == distinct == there:
        return docs.withColumn("_doc_no", F.col("doc_id").cast("long")), True
    named = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    order = F.asc_nulls_first("_id") if nulls_first else F.asc_nulls_last("_id")
    # sorted by ranges, so ids that ascend from partition to partition and within are in order; written, so they stay
    ordered = named.select("_id", "_key").distinct().orderBy(order, "_key").withColumn("_doc_no", F.monotonically_increasing_id())
    numbers = Scratch(docs.sparkSession, "numbers").save(ordered.select(F.col("_id").alias("_other"), F.col("_key").alias("_other_key"), "_doc_no"), "numbers", "zstd")
    return named.join(numbers, F.expr("_id <=> _other and _key = _other_key")).drop("_id", "_key", "_other", "_other_key"), False


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffers(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or text column without nulls, and where each value begins and ends."""
    texts = column(batch, name)
    wide = pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
