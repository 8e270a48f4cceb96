"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks of `block_rows`. Sources get shares of a stream of slots, one block a slot. In
the ideal fluid stream a source receives in proportion to its weight until it has nothing left, when the others share
its part. Block j of a source may run from the slot in which its fluid service begins (release) and must run before
the slot by which that service has ended (deadline). Earliest deadline first over released blocks meets all deadlines,
because the windows inside any stretch of slots never need more than that stretch, so no source is ever one whole
block or more ahead of or behind its ideal share. No row is dropped or repeated: each source's order of service is
what is decided.

Weights are whole numbers, so the stream comes in rounds: in a round each source with weight w that has w blocks left
is served exactly w, and no window crosses from one round into the next. Rounds in which the same sources are served
the same are scheduled alike, so one schedule of a round stands for all rounds of its stretch; a source's end begins a
new stretch. There are at most 2 * sources + 1 stretches, each scheduled by one task of at most RESOLUTION + sources
slots, whatever the number of rows; a block's slot follows from its stretch's schedule by arithmetic.

A row's place in its source comes from the rank of its hash, counted in two steps (bucket, then within it), so that a
source with a third of all rows is ranked by many tasks. The hash is of the whole row: rows that tie in it are equal
in all columns, so which of them comes first makes no difference, and a step run again gives the same rows.

Cases: rows with a null source are a source of their own. Null or repeated ids are rows like others. An empty table
gives an empty result. Sources without a given weight get the smallest weight that was given. All columns pass through,
but a column of docs that is named like one of those added gives way to it.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmap.llm.common import ROW, column, packed, unpacked

#: Rows that share a bucket, about.
BUCKET_ROWS = 2_000
#: Slots of a round, about: weights are whole numbers with this sum.
RESOLUTION = 8_192
#: Rows of a table that is broadcast; beyond, it is joined by key, each key in SALTS parts.
MOST_BROADCAST = 1_000_000
SALTS = 32
ADDED = ("mix_block", "mix_slot", "mix_position")


def windows(blocks: list[int], weights: list[int]) -> list[list[tuple[int, int]]]:
    """(release, deadline) of each block of each source, for integer weights.

    The fluid stream has served min(n, w * v) blocks of each source at virtual time v, and the slot it has come to is
    the sum of these; all in whole numbers.
    """
    order = sorted(range(len(blocks)), key=lambda s: Fraction(blocks[s], weights[s]))
    ends = [(blocks[s], weights[s]) for s in order]
    done = [0, *accumulate(n for n, _ in ends)]
    total = sum(w for _, w in ends)
    active = [total, *(total - x for x in accumulate(w for _, w in ends))]
    finish = [n / w for n, w in ends]

    def slot(j: int, w: int) -> tuple[int, int]:
        """Numerator and denominator of the slot at virtual time j / w."""
        k = bisect_right(finish, j / w)
        while k and ends[k - 1][0] * w > j * ends[k - 1][1]:  # exact, where the division rounds
            k -= 1
        while k < len(ends) and ends[k][0] * w <= j * ends[k][1]:
            k += 1
        return done[k] * w + j * active[k], w

    out = []
    for n, w in zip(blocks, weights, strict=True):
        at = [slot(j, w) for j in range(n + 1)]
        out.append([(a // d, -(-b // d)) for (a, d), (b, _) in zip(at, at[1:], strict=False)])
    return out


def schedule(blocks: list[int], weights: list[int]) -> list[tuple[int, int]]:
    """(source, block) of each slot in order, by earliest deadline first over released blocks."""
    jobs = sorted((r, d, s, j) for s, own in enumerate(windows(blocks, weights)) for j, (r, d) in enumerate(own))
    ready: list[tuple[int, int, int]] = []
    out, at = [], 0
    for t in range(len(jobs)):
        while at < len(jobs) and jobs[at][0] <= t:
            heapq.heappush(ready, (jobs[at][1], jobs[at][2], jobs[at][3]))
            at += 1
        deadline, s, j = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline passed")
        out.append((s, j))
    return out


def stretches(blocks: list[int], weights: list[int]) -> list[tuple[int, int, int, int]]:
    """(first round, rounds, slots of a round, first slot) of each stretch of rounds that are served alike."""
    cuts = sorted({0} | {c for n, w in zip(blocks, weights, strict=True) for c in (n // w, -(-n // w))})
    out, slot = [], 0
    for a, b in zip(cuts, cuts[1:], strict=False):
        size = sum(min(w, max(0, n - a * w)) for n, w in zip(blocks, weights, strict=True))
        out.append((a, b - a, size, slot))
        slot += size * (b - a)
    return out


def _rounds(blocks: list[int], weights: list[int]):
    """One round of each stretch: (stretch, source, block within the round, slot within the round)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, first in zip(column(batch, "stretch").to_pylist(), column(batch, "first").to_pylist(), strict=True):
                there = [(s, m, w) for s, (n, w) in enumerate(zip(blocks, weights, strict=True)) if (m := min(w, max(0, n - first * w)))]
                order = np.asarray(schedule([m for _, m, _ in there], [w for _, _, w in there]), np.int64).reshape(-1, 2)
                source = np.asarray([s for s, _, _ in there], np.int64)[order[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), k, np.int32)), pa.array(source.astype(np.int32)), pa.array(order[:, 1]), pa.array(np.arange(len(order)))], ["_stretch", "_source", "_in_round", "_slot"])

    return run


def whole_weights(sizes: dict[str, int], weights: dict[str | None, float] | None) -> list[int]:
    """A whole number for each source in the order of its name, with a sum of about RESOLUTION."""
    if weights is None:
        share = [sizes[k] ** 0.5 for k in sorted(sizes)]
    else:
        named = {"n" if k is None else f"s{k}": w for k, w in weights.items() if w > 0}
        share = [named.get(k, min(named.values(), default=1.0)) for k in sorted(sizes)]
    return [max(1, round(RESOLUTION * x / sum(share))) for x in share]


def _hash_of(docs: DataFrame, seed: int) -> Column:
    """A hash of the whole row; a column with maps goes in as text."""

    def plain(f: T.StructField) -> Column:
        return F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`")

    return F.xxhash64(*[plain(f) for f in docs.schema], F.lit(seed))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = 64, seed: int = 17) -> DataFrame:
    """docs with mix_block (within its source), mix_slot, and mix_position, by which rows sort into the mixed order.

    mix_position is mix_slot * block_rows and the row's place in its block; a source's last block may leave a gap.
    weights: by source; without them a source's weight is the square root of its rows, which lifts small sources.
    What reaches the driver is a row a source.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c.lower() not in ADDED]
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    sizes = {r["k"]: r["n"] for r in docs.groupBy(key.alias("k")).agg(F.count("*").alias("n")).collect()}
    names, whole = sorted(sizes), whole_weights(sizes, weights)
    blocks = [-(-sizes[k] // block_rows) for k in names]
    parts = stretches(blocks, whole)
    starts = F.from_json(F.lit(str([a for a, *_ in parts])), "array<bigint>")
    rounds = spark.createDataFrame([(k, p[0]) for k, p in enumerate(parts)], "stretch int, first long").repartitionById(max(1, len(parts)), "stretch")
    rounds = rounds.mapInArrow(_rounds(blocks, whole), "_stretch int, _source int, _in_round long, _slot long")
    lengths = spark.createDataFrame([(k, *p[::2], p[3]) for k, p in enumerate(parts)], "_stretch int, _first long, _size long, _start long")
    table = rounds.join(F.broadcast(lengths) if len(parts) <= MOST_BROADCAST else lengths, "_stretch")
    sources = spark.createDataFrame([(k, i, w, -(-sizes[k] // BUCKET_ROWS)) for i, (k, w) in enumerate(zip(names, whole, strict=True))], "_key string, _source int, _weight long, _buckets long")

    dealt = packed(docs, key.alias("_key"), _hash_of(docs, seed).alias("_draw")).join(F.broadcast(sources) if len(names) <= MOST_BROADCAST else sources, "_key").drop("_key")
    dealt = dealt.withColumn("_bucket", F.pmod("_draw", "_buckets"))
    by_bucket = dealt.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select("_source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_draw"))
    placed = dealt.withColumn("_rank", rank).join(offsets, ["_source", "_bucket"]).withColumn("_at", F.col("_before") + F.col("_rank") - 1)
    placed = placed.withColumn("mix_block", F.expr(f"_at div {block_rows}L")).withColumn("_round", F.expr("mix_block div _weight")).withColumn("_in_round", F.col("mix_block") % F.col("_weight"))
    placed = placed.withColumn("_stretch", F.size(F.filter(starts, lambda a: a <= F.col("_round"))) - 1)
    by = ["_stretch", "_source", "_in_round"]
    if sum(p[2] for p in parts) <= MOST_BROADCAST:
        out = placed.join(F.broadcast(table), by)
    else:
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = placed.withColumn("_salt", F.pmod("_draw", F.lit(SALTS)).cast("int")).join(salted, [*by, "_salt"])
    out = out.withColumn("mix_slot", F.expr("_start + (_round - _first) * _size + _slot"))
    return out.select(*[F.col(ROW).getField(c).alias(c) for c in columns], "mix_block", "mix_slot", (F.col("mix_slot") * block_rows + F.col("_at") % block_rows).alias("mix_position"))


def in_mixed_order(docs: DataFrame, partitions: int, **options) -> DataFrame:
    """The rows of docs, its own columns only, stored in mixed order: ranges of positions, sorted within."""
    mixed = mix(packed(docs, "source"), **options)
    return unpacked(mixed.repartitionByRange(partitions, "mix_position").sortWithinPartitions("mix_position"), docs.columns)
