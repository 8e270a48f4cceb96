"""Calibrated complete families that are made anew where they are read, so that no pair is written.

A score has six digits and a p-value nine. So what calibration needs of the whole family is small: how often each score
occurs, sums of scores at each node, and the places where the q-value steps up. These are counted where pairs are made:
the scores in one scan; the p-values in two, of which the first counts narrow cells, and the second sends those of the
cells only where q can step. Each reader makes the pairs once more with all their columns.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.functions.lineage import cut, tidy
from kinmap.operators import pairs

#: Different scores, in units of 1e-6; a p-value or q-value of 1, in units of 1e-9; bits of a score and of a step.
SCORES, ONE, BITS = 2_000_001, 1_000_000_000, 21
#: Scores of one counted stretch; p-values that a task holds (the more, the closer they lie), and that a range holds on average; ranges of a large family at least.
STRETCH, HELD, RANGE, RANGES = 1 << 16, 1 << 25, 1 << 23, 128
#: Cells of a deviation, and of all within 7 deviations.
CELL = 4_096
CELLS = 14 * CELL + 1
#: Rows of a block at most: more than elsewhere, as tiles are what a task holds.
WIDE = 8_192
#: Different q-values that are sent to every task at most.
STEPS = 1 << BITS
#: Tasks for each partition of the session, as pairs of blocks differ in size; where it has few partitions, up to so many.
SPREAD, MOST_SPREAD = 4, 64
COLUMNS = ("a", "b", "cosine", "score", "p", "q", "percentile")


class Unfit(ValueError):
    """A family that isn't told by these numbers: scores that aren't numbers, or too many different q-values."""


def encoded(values: np.ndarray) -> bytes:
    """Whole numbers, none below 0, by single bytes: 255 adds up to the next one; four bytes each where that is shorter."""
    over, rest = np.divmod(values, 255)
    more = int(over.sum())
    if more > 3 * len(values):
        wide = values.max() >= 1 << 31
        return (b"\2" if wide else b"\1") + values.astype("<i8" if wide else "<i4").tobytes()
    out = np.full(len(values) + more, 255, np.uint8)
    out[np.arange(len(values)) + np.cumsum(over)] = rest
    return b"\0" + out.tobytes()


def decoded(data: bytes) -> np.ndarray:
    if data[0]:
        return np.frombuffer(data, "<i4" if data[0] == 1 else "<i8", offset=1).astype("<i8")
    raw = np.frombuffer(data, np.uint8, offset=1)
    total = np.cumsum(raw, dtype="<i8")[raw < 255]
    return np.diff(total, prepend=0)


@cache
def _normal_table() -> list[np.ndarray]:
    z = np.arange(-7 * 1024, 7 * 1024 + 1) / 1024.0
    value = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])
    slope = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return [value, slope, -z / 2 * slope, (z * z - 1) / 6 * slope, (3 * z - z**3) / 24 * slope]


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """To double precision within 7 deviations, by a series around the next of 14,337 points; beyond them as at 7."""
    z = np.clip(z, -7.0, 7.0)
    at = np.rint(z * 1024)
    h = z - at / 1024
    k = (at + 7 * 1024).astype("<i4")
    table = _normal_table()
    out = table[4].take(k)
    for part in table[3::-1]:
        out *= h
        out += part.take(k)
    return out


@dataclass
class _Tile:
    """Pairs of a stretch of block x with a stretch of block y: positions, scores in units, and which of them are meant."""

    x: slice
    y: slice
    score: np.ndarray
    keep: np.ndarray | None


def _stored(r: dict) -> np.ndarray:
    """Vectors of a block, which has four bytes a number where that loses nothing."""
    wide = len(r["data"]) == len(r["ids"]) * max(1, r["dim"])  # an id has eight
    return np.frombuffer(r["data"], "<f8" if wide else "<f4").reshape(-1, max(1, r["dim"]))


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for data in batch.column("data"):
            own = np.frombuffer(data.as_py(), "<f8")
            with np.errstate(over="ignore"):
                short = own.astype("<f4")
            out.append(short.tobytes() if (short == own).all() else own.tobytes())
        yield batch.set_column(batch.schema.get_field_index("data"), "data", pa.array(out, pa.binary()))


def _parsed(r: dict) -> dict:
    data = _stored(r).astype("<f8")
    out = {"block": r["block"], "ids": np.frombuffer(r["ids"], "<i8"), "data": data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-300)}
    return out | {c: np.frombuffer(r[c], "<f8") for c in ("mu", "sigma") if c in r}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Pairs of blocks, from rows by (i, j, block): the two blocks of a pair follow each other, one alone meets itself."""
    meet = lambda x, y: {c + s: v for s, r in (("x", x), ("y", y)) for c, v in r.items()}
    held = None
    for batch in batches:
        for n in range(batch.num_rows):
            r = batch.slice(n, 1).to_pylist()[0]
            own = _parsed(r)
            if "side" in r:
                if r["side"]:
                    held = own
                elif held:
                    yield meet(held, own)
                    held = None
            elif r["i"] == r["j"]:
                yield meet(own, own)
            elif r["block"] == r["i"]:
                held = own
            elif held and held["block"] == r["i"]:  # else the pair's first block isn't there
                yield meet(held, own)


def _tiles(r: dict, only: tuple[int, ...] = ()) -> Iterator[_Tile]:
    """Tiles of two blocks, row by row; where `only` names the ids of x, y may hold the same vectors."""
    for i in range(0, len(r["idsx"]), pairs.TILE):
        for j in range(0, len(r["idsy"]), pairs.TILE):
            x, y = slice(i, i + pairs.TILE), slice(j, j + pairs.TILE)
            values = np.clip(r["datax"][x] @ r["datay"][y].T, -1.0, 1.0)
            scaled = values * 1e6
            cosine = np.rint(scaled)
            scaled -= cosine
            np.abs(scaled, out=scaled)
            if scaled.size and not scaled.max() <= 0.5 - 1e-6:
                near = scaled > 0.5 - 1e-6
                cosine[near] = pairs.units(values[near], 6)
            a, b = r["idsx"][x][:, None], r["idsy"][y][None, :]
            keep = None
            if only:
                keep = (a != b) & ~(np.isin(b, only) & (b < a))
            elif r["blockx"] == r["blocky"]:
                keep = a < b
            yield _Tile(x, y, np.subtract(1e6, cosine, out=cosine), keep)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks the number, sum and sum of squares of scores at each node; of all, how often a score occurs."""
    often = np.zeros(SCORES + 1, "<i8")  # the last: not a number
    out = lambda kind, key, data: pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([key], pa.int32()), pa.array([data], pa.binary())], ["kind", "key", "data"])
    for r in _blocks(batches):
        sums = {s: np.zeros((3, len(r[f"ids{s}"])), "<i8") for s in "xy"}
        held, n = [], 0
        for t in _tiles(r):
            lost = np.isnan(t.score)
            if lost.any():
                often[SCORES] += 1
                t.score[lost] = 0
            kept = t.score if t.keep is None else np.where(t.keep, t.score, 0)
            for s, at, axis in (("x", t.x, 1), ("y", t.y, 0)):
                sums[s][0, at] += t.score.shape[axis] if t.keep is None else t.keep.sum(axis)
                sums[s][1, at] += kept.sum(axis).astype("<i8")
                sums[s][2, at] += np.einsum("ij,ij->" + "ij"[1 - axis], kept, kept).astype("<i8")
            held.append((t.score.ravel() if t.keep is None else t.score[t.keep]).astype("<i4"))
            n += len(held[-1])
            if n > SCORES:
                often[:SCORES] += np.bincount(np.concatenate(held), minlength=SCORES)
                held, n = [], 0
        if held:
            often[:SCORES] += np.bincount(np.concatenate(held), minlength=SCORES)
        for s in "xy":
            yield out(1, r[f"block{s}"], sums[s].tobytes())
    for k in range(0, len(often), STRETCH):
        if often[k : k + STRETCH].any():
            yield out(0, k // STRETCH, zlib.compress(often[k : k + STRETCH].tobytes(), 1))


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = key[0].as_py()
    total = None
    for batch in batches:
        for data in batch.column("data"):
            own = np.frombuffer(data.as_py() if kind else zlib.decompress(data.as_py()), "<i8")
            total = own.copy() if total is None else np.add(total, own, out=total)
    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["kind", "key", "data"])


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean and population deviation at each node, from whole numbers."""
    for batch in batches:
        mu, sigma = [], []
        for data in batch.column("data"):
            n, one, two = (x.astype(object) for x in np.frombuffer(data.as_py(), "<i8").reshape(3, -1))
            many = np.maximum(n, 1)
            mu.append((one / many / 1_000_000).astype("<f8").tobytes())
            sigma.append(np.maximum(np.sqrt(((many * two - one * one) / (many * many)).astype("<f8")) / 1e6, 1e-12).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(mu, pa.binary()), pa.array(sigma, pa.binary())], ["block", "mu", "sigma"])


def _z(r: dict, t: _Tile) -> np.ndarray:
    """The larger of a score's deviations at the ends' profiles."""
    score = t.score / 1e6
    z = score - r["mux"][t.x][:, None]
    z /= r["sigmax"][t.x][:, None]
    score -= r["muy"][t.y][None, :]
    score /= r["sigmay"][t.y][None, :]
    return np.maximum(z, score, out=z)


def _units(z: np.ndarray) -> np.ndarray:
    return np.floor(normal_cdf(z) * ONE + 0.5).astype("<i4")


def _p_units(r: dict, t: _Tile) -> np.ndarray:
    """p of a tile, in units: the larger of the two lower tails at the ends' profiles."""
    return _units(_z(r, t))


def _cell(z: np.ndarray) -> np.ndarray:
    out = z + 7.0
    out *= CELL
    return np.clip(out, 0, CELLS - 1, out=out).astype("<i4")


class Cells:
    """How many pairs are in each cell, and of which of them the p-values must be known one by one.

    A p-value steps q only if its p * n / rank is below 1 and below that of all larger ones. The cells' bounds and counts
    bound both, so most cells are seen not to hold such a p-value. Those that may are `wanted`; `sent` are these and the
    ones that share a p-value with them, so that the ranks within wanted cells are exact.
    """

    def __init__(self, counts: np.ndarray):
        edge = np.floor(normal_cdf(np.arange(CELLS + 1) / CELL - 7.0) * ONE + 0.5).astype("<i8")
        # one unit more to both sides than rounding needs; the last cell holds all that is above
        low, high = np.maximum(edge[:-1] - 1, 0), np.minimum(edge[1:] + 1, ONE)
        high[-1] = ONE
        upto = np.cumsum(counts)
        self.n = n = int(upto[-1])
        rank = upto[np.searchsorted(low, high, "right") - 1]  # the largest that a p-value of the cell can have
        least = low / 1e9 * n / np.maximum(rank, 1)
        most = np.where(upto > 0, high / 1e9 * n / np.maximum(upto, 1), np.inf)
        after = np.minimum(np.minimum.accumulate(most[::-1])[::-1], 1.0)
        wanted = (counts > 0) & ~(least * (1 - 1e-9) > after)
        first, last = low[wanted], high[wanted]
        # a cell meets a wanted one if, of those that begin before its end, the last ends after its beginning
        k = np.searchsorted(first, high, "right") - 1
        self.sent = (k >= 0) & (last[np.maximum(k, 0)] >= low) if len(first) else np.zeros(CELLS, bool)
        self.first, self.last = first, last
        self.many = int(counts[self.sent].sum())
        other = ~self.sent & (counts > 0)
        self._end, self._below = high[other], np.append(0, np.cumsum(counts[other]))

    def below(self, p: np.ndarray) -> np.ndarray:
        """How many pairs that aren't sent lie below p-values of wanted cells."""
        return self._below[np.searchsorted(self._end, p, "right")]

    def within(self, p: np.ndarray) -> np.ndarray:
        """Whether p-values lie in wanted cells."""
        k = np.searchsorted(self.first, p, "right") - 1
        return (k >= 0) & (self.last[np.maximum(k, 0)] >= p)


def _meant(r: dict, t: _Tile, family: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> np.ndarray | None:
    if not family:
        return t.keep
    a, b = r["idsx"][t.x][:, None], r["idsy"][t.y][None, :]
    own = family(np.minimum(a, b), np.maximum(a, b))
    return own if t.keep is None else t.keep & own


def _celled(family: Callable[[np.ndarray, np.ndarray], np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.zeros(CELLS, "<i8")
        for r in _blocks(batches):
            for t in _tiles(r):
                keep, cell = _meant(r, t, family), _cell(_z(r, t))
                often += np.bincount(cell.ravel() if keep is None else cell[keep], minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([zlib.compress(often.tobytes(), 1)], pa.binary())], ["kind", "key", "data"])

    return run


def _short(data: bytes) -> bytes:
    """Frequent bytes by fewer bits."""
    squeeze = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
    return squeeze.compress(data) + squeeze.flush()


def _packed_counts(values: np.ndarray, often: np.ndarray, start: int) -> tuple[bytes, bytes]:
    return _short(encoded(np.diff(values, prepend=start))), _short(encoded(often - 1))


def _unpacked(data: bytes) -> np.ndarray:
    return decoded(zlib.decompress(data))


def _dealt(width: int, sent: np.ndarray, family: Callable[[np.ndarray, np.ndarray], np.ndarray] | None):
    """p-values of a task in the cells to be sent, counted and dealt to ranges of `width` units."""

    def flush(values: np.ndarray) -> Iterator[pa.RecordBatch]:
        values.sort()
        edges = np.searchsorted(values, np.minimum(np.arange(0, ONE + width + 1, width), ONE + 1).astype("<i4"))
        for k in np.flatnonzero(np.diff(edges)):
            part = values[edges[k] : edges[k + 1]]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            data = _packed_counts(part[first].astype("<i8"), np.diff(first, append=len(part)), int(k) * width)
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), *[pa.array([x], pa.binary()) for x in data]], ["range", "gaps", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.empty(HELD, "<i4"), 0
        for r in _blocks(batches):
            for t in _tiles(r):
                z, keep = _z(r, t), _meant(r, t, family)
                chosen = sent.take(_cell(z))
                p = _units(z[chosen if keep is None else chosen & keep])
                if n + len(p) > HELD:
                    yield from flush(held[:n])
                    n = 0
                held[n : n + len(p)] = p
                n += len(p)
        if n:
            yield from flush(held[:n])

    return run


def _merged(width: int):
    """The counted p-values of one range."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = key[0].as_py()
        start = k * width
        small = width <= RANGE
        total = np.zeros(width if small else 0, "<i8")
        values, often = np.zeros(0, "<i8"), np.zeros(0, "<i8")
        for batch in batches:
            for gaps, more in zip(batch.column("gaps"), batch.column("often")):
                own, count = np.cumsum(_unpacked(gaps.as_py())), _unpacked(more.as_py()) + 1
                if small:
                    total[own] += count  # different values, each once
                else:
                    values, where = np.unique(np.concatenate([values, own]), return_inverse=True)
                    often = np.bincount(where, np.concatenate([often, count]), len(values)).astype("<i8")
        if small:
            values = np.flatnonzero(total)
            often = total[values]
        data = _packed_counts(values, often, 0)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([int(often.sum())], pa.int64()), *[pa.array([x], pa.binary()) for x in data]], ["range", "n", "gaps", "often"])

    return run


def _raw(width: int, before: dict[int, int], cells: Cells, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each range its p-values that may step q, and p * n / rank."""
    for batch in batches:
        for k, gaps, often in zip(*[batch.column(c).to_pylist() for c in ("range", "gaps", "often")]):
            values = np.cumsum(_unpacked(gaps)) + k * width
            rank = np.cumsum(_unpacked(often) + 1) + before[k]
            inside = cells.within(values)
            values = values[inside]
            rank = rank[inside] + cells.below(values)
            if len(values):
                yield k, values, values / 1e9 * cells.n / rank


@dataclass
class Steps:
    """q as a function of p: the last p-value of each q-value, both in units, ascending."""

    p: np.ndarray
    q: np.ndarray

    def __post_init__(self) -> None:
        self.start = np.searchsorted(self.p, np.arange((ONE >> 10) + 3) << 10).astype("<i4")

    def at(self, p: np.ndarray) -> np.ndarray:
        bucket = p >> 10
        out, end = self.start.take(bucket), self.start.take(bucket + 1)
        inside = np.flatnonzero(out != end)
        out[inside] = np.searchsorted(self.p, p[inside])
        return out


class Family:
    """The complete family of cosines of vectors, each pair with its score, p, q and the score's percentile."""

    def __init__(self, rows: DataFrame, id: str, vector: str):
        self.spark = rows.sparkSession
        many = rows.count()
        count = max(1, -(-many // WIDE)) if many > WIDE * pairs.FEW else None
        blocks = pairs.blocks(rows, id, vector, count)
        self.packed = cut(blocks.mapInArrow(_narrow, blocks.schema))
        if not self.packed.head(1):
            raise Unfit("a family without members")
        sums = self._made(_summed, "kind int, key int, data binary", self.packed)
        sums = cut(sums.groupBy("kind", "key").applyInArrow(_added, "kind int, key int, data binary"))
        tidy(self.spark)
        often = np.zeros(SCORES + 1, "<i8")
        for r in sums.filter("kind = 0").collect():  # of a fixed size
            own = np.frombuffer(r["data"], "<i8")
            often[r["key"] * STRETCH : r["key"] * STRETCH + len(own)] = own
        if often[SCORES]:
            raise Unfit("scores that aren't numbers")
        self.n = int(often.sum())
        self.percentile = pairs.units(np.cumsum(often[SCORES - 1 :: -1])[::-1] / max(1, self.n), 9).astype("<i4")
        profile = sums.filter("kind = 1").mapInArrow(_profiles, "block int, mu binary, sigma binary")
        self.packed = cut(self.packed.join(profile, "block"))
        self._steps: dict[str, Steps] = {}

    def _tasks(self) -> int:
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(n, min(SPREAD * n, MOST_SPREAD))

    def _made(self, run, schema: str, x: DataFrame, y: DataFrame | None = None) -> DataFrame:
        """A block goes once to each pair of blocks that it is in, and the pairs of a task follow each other."""
        last = F.lit(self.packed.agg(F.max("block")).first()[0])
        every = F.explode(F.sequence(F.lit(0), last)).alias("_other")
        if y is None:
            met = x.select("*", every).withColumns({"i": F.least("block", "_other"), "j": F.greatest("block", "_other")}).drop("_other")
            return met.repartition(self._tasks(), "i", "j").sortWithinPartitions("i", "j", "block").mapInArrow(run, schema)
        # the few rows of x meet all of y
        left = x.select("*", every, F.lit(True).alias("side")).withColumns({"i": F.col("block"), "j": F.col("_other")})
        right = y.crossJoin(F.broadcast(x.select(F.col("block").alias("i")))).withColumns({"_other": F.col("i"), "side": F.lit(False), "j": F.col("block")})
        met = left.unionByName(right).drop("_other")
        return met.repartition(self._tasks(), "i", "j").sortWithinPartitions("i", "j", F.desc("side")).mapInArrow(run, schema)

    def steps(self, name: str = "", family: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Steps:
        """Benjamini-Hochberg over all pairs, or over those whose ids (a, b; of any shapes that meet) are of the family."""
        if name in self._steps:
            return self._steps[name]
        counts = self._made(_celled(family), "kind int, key int, data binary", self.packed)
        counts = counts.groupBy("kind", "key").applyInArrow(_added, "kind int, key int, data binary").first()["data"]
        cells = Cells(np.frombuffer(counts, "<i8"))
        tidy(self.spark)
        ranges = 1 if cells.many < 1_000_000 else max(RANGES, cells.many // RANGE)
        width = -(-(ONE + 1) // ranges)
        dealt = self._made(_dealt(width, cells.sent, family), "range int, gaps binary, often binary", self.packed)
        counted = cut(dealt.repartition(self._tasks(), "range").groupBy("range").applyInArrow(_merged(width), "range int, n long, gaps binary, often binary"))
        tidy(self.spark)
        before, n = {}, 0
        for r in counted.select("range", "n").orderBy("range").collect():
            before[r["range"]], n = n, n + r["n"]

        def least(batches):
            for k, _, raw in _raw(width, before, cells, batches):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([raw.min()])], ["range", "least"])

        after, lowest = {}, math.inf
        for r in counted.mapInArrow(least, "range int, least double").orderBy(F.desc("range")).collect():
            after[r["range"]], lowest = lowest, min(lowest, r["least"])

        def found(batches):
            for k, values, raw in _raw(width, before, cells, batches):
                q = np.minimum(np.minimum(np.minimum.accumulate(raw[::-1])[::-1], after[k]), 1.0)
                changes = np.append(np.flatnonzero(np.diff(q)), len(q) - 1)
                q = pairs.units(q[changes], 9)
                last = np.append(np.flatnonzero(np.diff(q)), len(q) - 1)
                data = [values[changes[last]].astype("<i4").tobytes(), q[last].astype("<i4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(last)], pa.int64()), *[pa.array([x], pa.binary()) for x in data]], ["range", "n", "p", "q"])

        steps = cut(counted.mapInArrow(found, "range int, n long, p binary, q binary"))
        if (steps.agg(F.sum("n")).first()[0] or 0) + 1 > STEPS:
            raise Unfit("too many different q-values")
        rows = steps.orderBy("range").collect()
        p, q = (np.concatenate([np.frombuffer(r[c], "<i4") for r in rows] or [np.zeros(0, "<i4")]) for c in ("p", "q"))
        p, q = np.append(p, ONE).astype("<i4"), np.append(q, ONE).astype("<i4")  # above the last step
        last = np.append(np.flatnonzero(np.diff(q)), len(q) - 1)
        self._steps[name] = Steps(p[last], q[last])
        return self._steps[name]

    def below(self, percentile: float) -> float:
        """A score above those whose percentile is the given one or more, and below all others."""
        return (np.count_nonzero(self.percentile / 1e9 >= percentile) - 0.5) / 1e6

    def _columns(self, columns: tuple[str, ...], more: dict[str, Steps]) -> tuple[str, Callable]:
        """Schema, and a function from ids, scores and p-values in units to the columns."""
        percentile = self.percentile
        steps = {"q": self.steps()} if "q" in columns else {}
        steps |= more
        names = [*columns, *[k for k in more if k not in columns]]

        def out(a, b, score, p):
            score = score.astype("<i4")
            make = {
                "a": lambda: np.minimum(a, b), "b": lambda: np.maximum(a, b), "cosine": lambda: (1_000_000 - score) / 1e6, "score": lambda: score / 1e6,
                "p": lambda: p / 1e9, "percentile": lambda: percentile.take(score) / 1e9,
            }
            look = lambda s: s.q.take(s.at(p), mode="clip") / 1e9
            return pa.RecordBatch.from_arrays([pa.array(look(steps[c]) if c in steps else make[c]()) for c in names], names)

        return ", ".join(f"{c} {'long' if c in 'ab' else 'double'}" for c in names), out

    def pairs(self, columns: tuple[str, ...] = COLUMNS, below: float | None = None, members: DataFrame | None = None, at: tuple[int, ...] = (), more: dict[str, Steps] | None = None) -> DataFrame:
        """Columns of all pairs; of those with a smaller score; of those between members (id), or at the nodes that are named.

        `more` adds q-values of other families by their names: of every pair, also of pairs outside them.
        """
        schema, out = self._columns(columns, more or {})
        wanted = "p" in columns or "q" in columns or bool(more)

        def run(batches):
            for r in _blocks(batches):
                for t in _tiles(r, at):
                    a, b, keep = r["idsx"][t.x], r["idsy"][t.y], t.keep
                    if below is not None:
                        low = t.score / 1e6 < below
                        keep = low if keep is None else keep & low
                    p = _p_units(r, t) if wanted and (keep is None or keep.any()) else None
                    if keep is None:
                        yield out(np.repeat(a, len(b)), np.tile(b, len(a)), t.score.ravel(), p if p is None else p.ravel())
                    elif keep.any():
                        i, j = np.nonzero(keep)
                        yield out(a[i], b[j], t.score[i, j], p if p is None else p[i, j])

        if at:
            return self._made(run, schema, _some(self.packed, at), self.packed)
        return self._made(run, schema, self.packed if members is None else _between(self.packed, members))

    def first(self, k: int, columns: tuple[str, ...], whole: bool = False, by_percentile: bool = False) -> DataFrame:
        """Pairs that hold the first k pairs of every node (`whole`: of the family) by q, score and ids; by percentile before, where asked.

        Of the pairs of two blocks, only the first k of a node, or of all, are handed on; those of a node are then merged.
        """
        schema, out = self._columns(columns, {})
        steps = self.steps()
        high = np.cumsum(np.diff(self.percentile, prepend=self.percentile[0]) != 0) if by_percentile else None
        never = np.iinfo("<i8").max

        def key(score: np.ndarray, p: np.ndarray) -> np.ndarray:
            score = score.astype("<i8")
            value = steps.at(p.ravel()).reshape(p.shape).astype("<i8") << BITS | score
            return value if high is None else value | high.take(score) << 2 * BITS

        def best(n: int) -> _Best:
            """Before its key a pair's `early` tells whether it can be among the first: the place of its percentile, or p."""
            if by_percentile:
                return _Best(n, k, key, lambda v: v >> 2 * BITS, lambda v: v)
            last = lambda step: steps.p.take(step, mode="clip").astype("<i8")  # noqa: E731  of the p-values with one q
            reach = lambda v: np.where(v > ONE, v, last(steps.at(np.minimum(v, ONE).astype("<i4"))))
            return _Best(n, k, key, lambda v: last(v >> BITS), reach)

        def of_all(batches):
            for r in _blocks(batches):
                for t in _tiles(r):
                    p = _p_units(r, t)
                    value = key(t.score, p)
                    if t.keep is not None:
                        value[~t.keep] = never
                    edge = np.partition(value.ravel(), k - 1)[k - 1] if value.size > k else never - 1
                    i, j = np.nonzero((value <= edge) & (value != never))
                    yield out(r["idsx"][t.x][i], r["idsy"][t.y][j], t.score[i, j], p[i, j])

        if whole:
            return self._made(of_all, schema, self.packed)

        def of_nodes(batches):
            for r in _blocks(batches):
                held = {s: best(len(r[f"ids{s}"])) for s in "xy"}
                for t in _tiles(r):
                    p = None if by_percentile else _p_units(r, t)
                    early = high.take(t.score.astype("<i4")) if by_percentile else p.astype("<i8")
                    if t.keep is not None:
                        early = np.where(t.keep, early, never)
                    for s, at, other, axis in (("x", t.x, t.y, 1), ("y", t.y, t.x, 0)):
                        i, j = np.nonzero(held[s].near(at, early, axis))
                        score = t.score[i, j]
                        own = _units(_z_at(r, t, i, j)) if p is None else p[i, j]
                        mine, far = (i, j) if axis else (j, i)
                        held[s].add(mine + at.start, r["idsy" if axis else "idsx"][other][far], score, own)
                for s in "xy":
                    yield held[s].packed(r[f"block{s}"], r[f"ids{s}"])

        def merged(key_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = held = None
            for batch in batches:
                for row in range(batch.num_rows):
                    r = batch.slice(row, 1).to_pylist()[0]
                    if held is None:
                        ids = np.frombuffer(r["ids"], "<i8")
                        held = best(len(ids))
                    score, p = (np.frombuffer(r[c], "<i4") for c in ("score", "p"))
                    other = np.frombuffer(r["other"], "<i4" if len(r["other"]) == len(r["p"]) else "<i8").astype("<i8")
                    held.add(np.repeat(np.arange(len(ids)), np.frombuffer(r["often"], "<i4")), other, score, p)
            node, other, score, p = held.done()
            yield out(ids[node], other, score, p)

        made = self._made(of_nodes, "block int, ids binary, often binary, other binary, score binary, p binary", self.packed)
        return made.groupBy("block").applyInArrow(merged, schema).distinct()  # a pair may be of the first at both ends


def _z_at(r: dict, t: _Tile, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """_z of some pairs of a tile."""
    score = t.score[i, j] / 1e6
    z = ((score - r[m][at][k]) / r[d][at][k] for m, d, at, k in (("mux", "sigmax", t.x, i), ("muy", "sigmay", t.y, j)))
    return np.maximum(*z)


class _Best:
    """The first k pairs of each node of a block by a key and the other's id, as far as pairs were added."""

    HELD = 1 << 21

    def __init__(self, n: int, k: int, key: Callable, early: Callable, reach: Callable):
        self.n, self.k, self.key, self.early, self.reach = n, k, key, early, reach
        self.edge = np.full(n, np.iinfo("<i8").max - 1)
        self.parts, self.held = [], 0

    def near(self, at: slice, early: np.ndarray, axis: int) -> np.ndarray:
        """Which pairs of a tile may be among the first; nodes are its rows (axis 1) or columns."""
        edge = self.edge[at]
        if early.shape[axis] > self.k and (edge == np.iinfo("<i8").max - 1).any():
            edge = np.minimum(edge, self.reach(np.partition(early, self.k - 1, axis).take(self.k - 1, axis)))
        return early <= (edge[:, None] if axis else edge[None, :])

    def add(self, node: np.ndarray, other: np.ndarray, score: np.ndarray, p: np.ndarray) -> None:
        score = score.astype("<i4")
        self.parts.append((node.astype("<i4"), other, score, p, self.key(score, p)))
        self.held += len(node)
        if self.held > self.HELD:
            self.done()

    def done(self) -> tuple[np.ndarray, ...]:
        """Node, the other's id, score and p of the first pairs of each node, in order."""
        none = [np.zeros(0, t) for t in ("<i4", "<i8", "<i4", "<i4", "<i8")]
        whole = [np.concatenate(x) for x in zip(none, *self.parts)]
        order = np.lexsort((whole[1], whole[4], whole[0]))
        node = whole[0][order]
        start = np.searchsorted(node, np.arange(self.n))
        rank = np.arange(len(node)) - start[node]
        last = order[rank == self.k - 1]
        self.edge[whole[0][last]] = self.early(whole[4][last])
        whole = [x[order[rank < self.k]] for x in whole]
        self.parts, self.held = [tuple(whole)], len(whole[0])
        return tuple(whole[:4])

    def packed(self, block: int, ids: np.ndarray) -> pa.RecordBatch:
        node, other, score, p = self.done()
        short = not len(other) or (other.min() >= -(1 << 31) and other.max() < 1 << 31)
        data = [ids, np.bincount(node, minlength=self.n).astype("<i4"), other.astype("<i4" if short else "<i8"), score, p]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in data]], ["block", "ids", "often", "other", "score", "p"])


def _taken(wanted: Callable[[np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                keep = wanted(ids)
                if keep.any():
                    parts = {"ids": ids[keep], "data": _stored(r)[keep]}
                    parts |= {c: np.frombuffer(r[c], "<f8")[keep] for c in ("mu", "sigma")}
                    yield pa.RecordBatch.from_pylist([r | {c: v.tobytes() for c, v in parts.items()}], schema=batch.schema)

    return run


def _some(packed: DataFrame, ids: tuple[int, ...]) -> DataFrame:
    return packed.mapInArrow(_taken(lambda own: np.isin(own, ids)), packed.schema)


def _between(packed: DataFrame, members: DataFrame) -> DataFrame:
    """Blocks with those rows only whose id is a member's; members are cut into the same blocks."""
    count = packed.agg(F.max("block") + 1).first()[0]
    own = members.select(F.col("id").cast("long").alias("id")).distinct().withColumn("block", pairs.dealt("id", count)).groupBy("block").agg(F.collect_list("id").alias("_members"))
    both = packed.join(own, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                one = batch.slice(n, 1)
                chosen = np.array(one.column("_members")[0].as_py(), "<i8")
                yield from _taken(lambda ids, chosen=chosen: np.isin(ids, chosen))([one.drop_columns(["_members"])])

    return both.mapInArrow(run, packed.schema)
