"""Complete and incremental families of pairs over vectors, by blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmap.functions.lineage import cut

#: Rows of a tile, for which a task holds all values at a time; of a block at most, where its vectors are short; bytes of
#: a block's vectors beyond which it isn't made larger than a tile; blocks up to which there are more rather than larger.
TILE, BLOCK, BLOCK_BYTES, FEW = 512, 4_096, 8_000_000, 12
_BLOCK_SCHEMA = "block int, ids binary, data binary, dim int"


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    vectors = table.column("v").combine_chunks()
    data = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f8")
    ids = table.column("id").to_numpy().astype("<i8")
    dim = len(data) // max(1, len(ids))
    order = np.argsort(ids, kind="stable")
    ids, data = ids[order], data.reshape(len(ids), -1)[order]
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "ids": [ids.tobytes()], "data": [data.tobytes()], "dim": pa.array([dim], pa.int32())})


def dealt(id: str, count: int) -> Column:
    """The block of an id."""
    return F.pmod(F.xxhash64(id), F.lit(count)).cast("int")


def blocks(rows: DataFrame, id: str, vector: str, count: int | None = None) -> DataFrame:
    """Vectors of one length, TILE to BLOCK or so to a packed row, by ascending ids.

    A block is sent once for each block it meets, so blocks grow with the table as long as a task can hold two.
    """
    if not count:
        total, dim = rows.agg(F.count("*"), F.max(F.size(vector))).first()
        most = min(BLOCK, max(TILE, BLOCK_BYTES // (8 * max(1, dim or 0))))
        count = max(1, -(-total // most), min(FEW, -(-total // TILE)))
    n = count
    own = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("block", dealt("id", n))
    return own.groupBy("block").applyInArrow(_pack, _BLOCK_SCHEMA)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gram matrix of rows brought to unit length, kept within [-1, 1]; a zero row has similarity 0."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    return np.clip(unit(x) @ unit(y).T, -1.0, 1.0)


def _score(metric: Callable[[np.ndarray, np.ndarray], np.ndarray], triangle: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                ids = [np.frombuffer(r[f"ids{s}"], "<i8") for s in "xy"]
                vectors = [np.frombuffer(r[f"data{s}"], "<f8").reshape(-1, max(1, r[f"dim{s}"])) for s in "xy"]
                for i, j in product(*[range(0, len(x), TILE) for x in ids]):
                    own, other = ids[0][i : i + TILE], ids[1][j : j + TILE]
                    values = metric(vectors[0][i : i + TILE], vectors[1][j : j + TILE])
                    left, right = np.repeat(own, len(other)), np.tile(other, len(own))
                    keep = (left < right) if triangle and r["blockx"] == r["blocky"] else left != right
                    left, right, value = left[keep], right[keep], values.ravel()[keep]
                    if triangle:
                        left, right = np.minimum(left, right), np.maximum(left, right)
                    yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(value)], ["a", "b", "value"])

    return run


def met(x: DataFrame, y: DataFrame, triangle: bool, count: int | None = None) -> DataFrame:
    """Pairs of blocks as rows: block numbers are paired first, and the blocks joined to those numbers by key.

    How the joins run is decided by the sizes; the pairs are dealt over `count` partitions, or the session's.
    """
    spark = x.sparkSession
    numbers = [df.select("block") for df in (x, y)]
    if triangle:
        wanted = numbers[0].select(F.col("block").alias("i")).join(numbers[1].select(F.col("block").alias("j")), F.expr("i <= j"))
    else:
        most = numbers[1].agg(F.max("block")).first()[0]
        every = F.explode(F.sequence(F.lit(0), F.lit(most or 0))).alias("j")  # without rows on the right, j meets nothing
        wanted = numbers[0].select(F.col("block").alias("i"), every)
    side = lambda df, s, on: df.select(F.col("block").alias(on), *[F.col(c).alias(c + s) for c in df.columns])
    met = wanted.join(side(x, "x", "i"), "i").join(side(y, "y", "j"), "j")
    return met.drop("i", "j").repartition(count or int(spark.conf.get("spark.sql.shuffle.partitions")), "blockx", "blocky")


_PAIR = "a long, b long, value double"


def all_pairs(rows: DataFrame, id: str, vector: str, metric=cosine) -> DataFrame:
    """(a, b, value) for every a < b: each pair of blocks is one small matrix product."""
    packed = cut(blocks(rows, id, vector))
    return met(packed, packed, True).mapInArrow(_score(metric, True), _PAIR)


def units(values: np.ndarray, digits: int) -> np.ndarray:
    """Values in units of 10 ** -digits, halves away from zero by their shortest decimal form, as round() in SQL has it."""
    scaled = np.abs(values) * 10.0**digits
    out = np.floor(scaled + 0.5)
    near = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)  # where the product's own rounding might decide
    out[near] = [int(abs(Decimal(repr(float(v)))).scaleb(digits).to_integral_value(ROUND_HALF_UP)) for v in values[near]]
    return (out * np.sign(values)).astype("<i8")


#: Different values that a task holds before it hands their counts on.
_COUNTS = 1_000_000


def counted(rows: DataFrame, id: str, vector: str, digits: int, metric=cosine) -> DataFrame:
    """(units, n): how many pairs of the complete family have each rounded value, in units of 10 ** -digits; null: NaN.

    Pairs are counted where they are made, and neither written nor sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, nan = np.zeros(0, "<i8"), np.zeros(0, "<i8"), 0
        out = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["units", "n"])
        for batch in _score(metric, True)(batches):
            values = batch.column("value").to_numpy()
            there = values[~np.isnan(values)]
            nan += len(values) - len(there)
            own, often = np.unique(units(there, digits), return_counts=True)
            both, where = np.unique(np.concatenate([keys, own]), return_inverse=True)
            keys, counts = both, np.bincount(where, np.concatenate([counts, often]), len(both)).astype("<i8")
            if len(keys) > _COUNTS:
                yield out(keys, counts)
                keys, counts = keys[:0], counts[:0]
        yield out(keys, counts)
        if nan:
            yield out([None], [nan])

    packed = cut(blocks(rows, id, vector))
    return met(packed, packed, True).mapInArrow(run, "units long, n long").groupBy("units").agg(F.sum("n").alias("n"))


def cross_pairs(left: DataFrame, right: DataFrame, id: str, vector: str, metric=cosine) -> DataFrame:
    """(a, b, value) of every row of left (a) with every row of right (b)."""
    return met(cut(blocks(left, id, vector)), cut(blocks(right, id, vector)), False).mapInArrow(_score(metric, False), _PAIR)


def delta_pairs(new: DataFrame, old: DataFrame, id: str, vector: str, metric=cosine) -> DataFrame:
    """Pairs that new rows add, a < b: with every old row, and among themselves; never old with old."""
    fresh, there = cut(blocks(new, id, vector)), cut(blocks(old, id, vector))
    among = met(fresh, fresh, True).mapInArrow(_score(metric, True), _PAIR)
    across = met(fresh, there, False).mapInArrow(_score(metric, False), _PAIR)
    return among.unionByName(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")


def embedded(rows: DataFrame, id: str, text: str, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(id, vector) of rows by any function from a batch of texts to as many vectors; a null text is the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = embed([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], ["id", "vector"])

    return rows.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, vector array<double>")
