"""Low-rank covariance signatures of datasets, their distance, null banks and feature explanations (numpy by task)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmap.functions import stats
from kinmap.functions.lineage import cut

SCHEMA = "dataset long, loadings array<array<double>>, weights array<double>, features int, samples int, share double"


def seed_of(dataset) -> int:
    return int.from_bytes(hashlib.sha1(str(dataset).encode()).digest()[:8], "big")


def standardise(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Columns to mean 0 and deviation 1; where the variance is at most 1e-7 one small noise vector is added first."""
    x = np.array(x, dtype=float)
    with np.errstate(invalid="ignore", divide="ignore"):
        variance = np.nanvar(x, axis=0, ddof=1) if len(x) > 1 else np.zeros(x.shape[1])
        flat = ~(variance > 1e-7)
        if flat.any():
            x[:, flat] += rng.uniform(0.0, 1e-7, size=(len(x), 1))
        centred = x - np.nanmean(x, axis=0)
        sd = np.nanstd(centred, axis=0, ddof=1) if len(x) > 1 else np.ones(x.shape[1])
    return np.nan_to_num(centred / np.where((sd > 0) & np.isfinite(sd), sd, 1.0), nan=0.0, posinf=0.0, neginf=0.0)


def _count(values: np.ndarray, n: int, share: float, least: int, most: int | None) -> int:
    """How many axes hold the share, of descending eigenvalues that sum to n or less."""
    rank = max(1, int((values > values[0] * 1e-12).sum()) if values[0] > 0 else 1)
    c = int(np.searchsorted(np.cumsum(values), share * n - 1e-9) + 1)
    return max(least, min(c, rank, most or rank))


def _weights(values: np.ndarray, n: int, share: float) -> np.ndarray:
    total = values.sum()
    return (values / total if total > 0 and np.isfinite(total) else np.full(len(values), 1.0 / len(values))) * share * n


def fit_correlation(r: np.ndarray, share: float = 0.5, least: int = 1, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """fit() from the correlations of the features alone, whatever the number of samples."""
    values, vectors = np.linalg.eigh(r)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    c = _count(values, len(r), share, least, most)
    return vectors[:, :c], _weights(values[:c], len(r), share)


def fit(x: np.ndarray, share: float = 0.5, seed: int = 0, least: int = 1, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(orthonormal loadings, weights that sum to share * features): the fewest axes that hold that share of variance.

    The axes come from the samples' Gram matrix or from the features' covariance, whichever is the smaller.
    """
    z = standardise(x, np.random.default_rng(seed))
    m, n = z.shape
    if n < m:
        return fit_correlation(z.T @ z / (m - 1), share, least, most)
    values, vectors = np.linalg.eigh(z @ z.T)
    values, vectors = np.maximum(values[::-1], 0.0) / max(1, m - 1), vectors[:, ::-1]
    c = _count(values, n, share, least, most)
    axes, _ = np.linalg.qr(z.T @ vectors[:, :c])
    return axes, _weights(values[:c], n, share)


def distance(p: np.ndarray, lp: np.ndarray, q: np.ndarray, lq: np.ndarray, share: float) -> float:
    """Symmetric low-rank distance; 0 for equal signatures."""
    n = len(p)
    s = (p.T @ q) ** 2
    return max(0.0, (2 * share * n - float(lp @ s.sum(axis=1) + s.sum(axis=0) @ lq)) / (2 * (1 - share)))


_PARTIAL = "n long, dim int, mean binary, m2 binary"


def merged(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, centred second moments) of parts that have the same each."""
    n, mean, m2 = parts[0]
    for k, other, more in parts[1:]:
        step = other - mean
        m2 = m2 + more + np.outer(step, step) * (n * k / (n + k))
        n, mean = n + k, mean + step * (k / (n + k))
    return n, mean, m2


def _moments(x: np.ndarray, count: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """The same of rows, each as often as its count says."""
    n = len(x) if count is None else int(count.sum())
    mean = x.mean(axis=0) if count is None else count @ x / n
    x = x - mean
    return n, mean, x.T @ (x if count is None else x * count[:, None])


def _packed_moments(n: int, mean: np.ndarray, m2: np.ndarray) -> dict:
    return {"n": [n], "dim": [len(mean)], "mean": [mean.astype("<f8").tobytes()], "m2": [m2[np.triu_indices(len(mean))].astype("<f8").tobytes()]}


def _correlation(group: pd.DataFrame) -> tuple[int, np.ndarray | None]:
    """(rows, correlations) from the partial moments of a group; None where a feature is flat or not finite."""
    def read(r) -> tuple[int, np.ndarray, np.ndarray]:
        half = np.zeros((r.dim, r.dim))
        half[np.triu_indices(r.dim)] = np.frombuffer(r.m2, "<f8")
        return int(r.n), np.frombuffer(r.mean, "<f8"), half + np.triu(half, 1).T

    if group["dim"].nunique() > 1:
        raise ValueError("vectors of different lengths")
    n, _, m2 = merged([read(r) for r in group.sort_values(["n", "mean"]).itertuples()])
    sd = np.sqrt(np.diag(m2) / max(1, n - 1))
    if not (np.isfinite(m2).all() and (sd * sd > 1e-7).all()):
        return n, None
    return n, m2 / max(1, n - 1) / np.outer(sd, sd)


#: Datasets whose moments a task holds before it hands them on.
_HELD = 64


def _partial_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for d, parts in held.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int64())} | {k: pa.array(v, t) for (k, v), t in zip(_packed_moments(*merged(parts)).items(), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)})
        held.clear()

    for batch in batches:
        names, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        lengths = np.diff(vectors.offsets.to_numpy())
        if len(lengths) and (lengths != lengths[0]).any():
            raise ValueError("vectors of different lengths")
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1)
        for d in np.unique(names):
            if d not in held and len(held) >= _HELD:
                yield from out()
            held[d] = [merged([*held.get(d, []), _moments(x[names == d])])]
    yield from out()


def signatures(rows: DataFrame, dataset: str, vector: str, share: float = 0.5) -> DataFrame:
    """One row a dataset. rows: a sample each, with an array in frozen feature order.

    A dataset with more samples than features is fitted from moments, summed where its rows are. One with fewer, with a
    flat feature or with values that aren't finite is fitted whole in one task.
    """
    rows = rows.select(F.col(dataset).cast("long").alias("d"), F.col(vector).cast("array<double>").alias("v"))

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        x = np.asarray(sorted(map(tuple, group["v"])))
        p, lam = fit(x, share, seed_of(group["d"].iloc[0]))
        return pd.DataFrame({"dataset": [int(group["d"].iloc[0])], "loadings": [[c.tolist() for c in p.T]], "weights": [lam.tolist()], "features": [x.shape[1]], "samples": [len(x)], "share": [share]})

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        n, r = _correlation(group)
        if r is None:
            return pd.DataFrame({"dataset": [], "loadings": [], "weights": [], "features": [], "samples": [], "share": []}, dtype=object)
        p, lam = fit_correlation(r, share)
        return pd.DataFrame({"dataset": [int(group["d"].iloc[0])], "loadings": [[c.tolist() for c in p.T]], "weights": [lam.tolist()], "features": [len(r)], "samples": [n], "share": [share]})

    tall = rows.filter("d is not null and v is not null").groupBy("d").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).filter("n > dim and dim > 0").select("d")
    partial = rows.join(tall, "d", "left_semi").filter("v is not null").mapInArrow(_partial_moments, f"d long, {_PARTIAL}")
    done = cut(partial.groupBy("d").applyInPandas(summed, SCHEMA))
    rest = rows.join(done.select("dataset"), rows["d"].eqNullSafe(F.col("dataset")), "left_anti")
    return done.unionByName(rest.groupBy("d").applyInPandas(whole, SCHEMA))


def packed(sig: DataFrame, per_block: int = 32) -> DataFrame:
    """Signatures, `per_block` or so to a row: (block, blocks, data) with axes, weights and names as packed numbers."""
    blocks = max(1, -(-sig.count() // per_block))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        if group["features"].nunique() > 1 or group["share"].max() - group["share"].min() > 1e-12:
            raise ValueError("signatures of different features or shares")
        group = group.sort_values("dataset")
        axes = np.concatenate([np.asarray([list(c) for c in x]) for x in group["loadings"]])
        numbers = {"ids": group["dataset"].to_numpy("<i8"), "counts": np.asarray([len(x) for x in group["weights"]], "<i8"), "weights": np.concatenate([np.asarray(x) for x in group["weights"]])}
        return pd.DataFrame({"block": [group["block"].iloc[0]], "features": [axes.shape[1]], "share": [group["share"].iloc[0]], "axes": [axes.astype("<f8").tobytes()]} | {k: [v.tobytes()] for k, v in numbers.items()})

    dealt = sig.withColumn("block", F.pmod(F.xxhash64("dataset"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(one, "block int, features int, share double, axes binary, ids binary, counts binary, weights binary")


def _block_scores(x: dict, y: dict, triangle: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, score) of all signatures of one block with all of another: one product of matrices."""
    if x["features"] != y["features"] or abs(x["share"] - y["share"]) > 1e-12:
        raise ValueError("signatures of different features or shares")
    read = lambda r: (np.frombuffer(r["axes"], "<f8").reshape(-1, r["features"]), np.frombuffer(r["weights"], "<f8"), np.frombuffer(r["ids"], "<i8"), np.cumsum(np.concatenate([[0], np.frombuffer(r["counts"], "<i8")]))[:-1])
    (p, lp, a, at), (q, lq, b, bt) = read(x), read(y)
    s = (p @ q.T) ** 2
    terms = np.add.reduceat(np.add.reduceat(s * np.add.outer(lp, lq), at, axis=0), bt, axis=1)
    n, share = x["features"], x["share"]
    score = np.maximum(0.0, (2 * share * n - terms) / (2 * (1 - share)))
    left, right = np.repeat(a, len(b)), np.tile(b, len(a))
    keep = (left < right) if triangle and x["block"] == y["block"] else np.ones(len(left), bool)
    left, right, score = left[keep], right[keep], score.ravel()[keep]
    return (np.minimum(left, right), np.maximum(left, right), score) if triangle else (left, right, score)


def scores(left: DataFrame, right: DataFrame, triangle: bool = True) -> DataFrame:
    """(a, b, score) of signatures; with triangle a < b of one table, else every pair of two tables.

    Signatures are packed into blocks. A pair of blocks is a row of numbers, which the blocks are joined to, so each
    block is sent once for every block it meets and a task makes one product of matrices at a time.
    """
    spark = left.sparkSession
    x = cut(packed(left))
    y = x if triangle else cut(packed(right))
    sides = [df.select("block") for df in (x, y)]
    if triangle:
        wanted = sides[0].select(F.col("block").alias("i")).join(sides[1].select(F.col("block").alias("j")), F.expr("i <= j"))
    else:
        most = sides[1].agg(F.max("block")).first()[0]
        wanted = sides[0].select(F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(0 if most is None else most))).alias("j"))
    side = lambda df, s, on: df.select(F.col("block").alias(on), F.struct(*df.columns).alias(s))
    pairs = wanted.join(side(x, "x", "i"), "i").join(side(y, "y", "j"), "j").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in _block_scores(r["x"], r["y"], triangle)], ["a", "b", "score"])

    return pairs.select("x", "y").mapInArrow(run, "a long, b long, score double")


def invariants(sig: DataFrame) -> DataFrame:
    """dataset and whether weights sum to share * features and loadings are orthonormal and finite, in SQL functions."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    gram = F.transform("loadings", lambda x, i: F.transform("loadings", lambda y, j: F.abs(dot(x, y) - (i == j).cast("double"))))
    worst = F.array_max(F.transform(gram, lambda r: F.array_max(r)))
    total = F.aggregate("weights", F.lit(0.0), lambda s, v: s + v)
    return sig.select("dataset", "features", "samples", F.size("weights").alias("axes"), (F.abs(total - F.col("share") * F.col("features")) < 1e-8).alias("weights_sum"), (worst < 1e-5).alias("orthonormal"))


def size_grid(low: int, high: int) -> list[int]:
    """Sizes that bracket [low, high]: fixed anchors, then steps of 1.4 beyond 400."""
    # Anchors of the calibration grid.
    anchors = [5, 8, 12, 16, 20, 25, 30, 40, 50, 75, 100, 150, 200, 300, 400]
    while anchors[-1] < high:
        anchors.append(int(round(anchors[-1] * 1.4)))
    first = max([a for a in anchors if a <= low], default=max(2, low))
    last = min(a for a in anchors if a >= high)
    return sorted({first, *(a for a in anchors if first <= a <= last)})


def covering(grid: Column, size: Column) -> Column:
    """The ascending grid itself; an error where size lies outside it, since no profile holds there."""
    inside = size.between(F.get(grid, F.lit(0)), F.element_at(grid, -1))
    return F.when(inside, grid).otherwise(F.raise_error(F.concat(F.lit("sample count outside the size grid: "), size.cast("string"))))


#: Parts of a pool whose moments are taken apart at least, and draws' places that a part has at most, about.
_RANGES, _PLACES = 16, 4_000_000
_BANK = "size int, draw int, loadings array<array<double>>, weights array<double>, features int"


def null_bank(pool: DataFrame, vector: str, sizes: list[int], draws: int = 100, share: float = 0.5, seed: int = 7) -> DataFrame:
    """(size, draw, loadings, weights, features): signatures of `draws` samples, with replacement, of each size from the pool.

    pool: any number of rows, a vector each; rows are numbered in the order of a hash of the vector, and place i of a
    draw takes the row whose number a hash of (seed, size, draw, i) gives, so a bank is the same wherever it is made.
    Draws of more rows than there are features are fitted from moments: parts of the pool sum up what each draw has of
    them, so rows aren't sent once a draw. Smaller ones, and those with a flat feature or values that aren't finite,
    are fitted whole, a draw to a task.
    """
    spark = pool.sparkSession
    keyed = pool.select(F.col(vector).cast("array<double>").alias("v")).withColumn("h", F.xxhash64("v"))
    numbered = cut(stats.ranked(keyed.withColumn("h", F.col("h").cast("double")), "h", ["v"], "number"))
    n, dim = numbered.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        raise ValueError("the pool is empty")
    sizes, dim = sorted({int(x) for x in sizes}), dim or 0

    def places(of: list[int]) -> DataFrame:
        wanted = spark.createDataFrame([(x,) for x in of], "size int").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "size", "draw")
        wanted = wanted.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
        return wanted.withColumn("number", F.pmod(F.xxhash64("size", "draw", "place", F.lit(seed)), F.lit(n)) + 1)

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        x = np.stack(group["v"].to_numpy())
        p, lam = fit(x, share, seed)
        return pd.DataFrame({"size": [group["size"].iloc[0]], "draw": [group["draw"].iloc[0]], "loadings": [[c.tolist() for c in p.T]], "weights": [lam.tolist()], "features": [x.shape[1]]})

    def from_rows(wanted: DataFrame) -> DataFrame:
        return wanted.join(numbered.select("number", "v"), "number").groupBy("size", "draw").applyInPandas(whole, _BANK)

    tall = [x for x in sizes if x > dim > 0]
    if not tall:
        return from_rows(places(sizes))
    ranges = max(_RANGES, -(-draws * sum(tall) // _PLACES))
    part = lambda number: F.floor((F.col(number) - 1) * ranges / n).cast("int").alias("part")

    def count(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(wanted):
            return pd.DataFrame({"size": [], "draw": [], "n": [], "dim": [], "mean": [], "m2": []}, dtype=object)
        rows = rows.sort_values("number")
        x, at = np.stack(rows["v"].to_numpy()).astype(float), rows["number"].to_numpy()
        wanted = wanted.sort_values(["size", "draw"])
        size, draw, number = (wanted[c].to_numpy() for c in ("size", "draw", "number"))
        starts = np.flatnonzero(np.r_[True, (np.diff(size) != 0) | (np.diff(draw) != 0)])
        out = []
        for start, stop in zip(starts, np.r_[starts[1:], len(size)], strict=True):
            own, often = np.unique(np.searchsorted(at, number[start:stop]), return_counts=True)
            out.append(pd.DataFrame({"size": [size[start]], "draw": [draw[start]]} | _packed_moments(*_moments(x[own], often.astype(float)))))
        return pd.concat(out)

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        _, r = _correlation(group)
        if r is None:
            return pd.DataFrame({"size": [], "draw": [], "loadings": [], "weights": [], "features": []}, dtype=object)
        p, lam = fit_correlation(r, share)
        return pd.DataFrame({"size": [group["size"].iloc[0]], "draw": [group["draw"].iloc[0]], "loadings": [[c.tolist() for c in p.T]], "weights": [lam.tolist()], "features": [len(r)]})

    left, right = numbered.select("number", "v", part("number")), places(tall).select("size", "draw", "number", part("number"))
    parts = left.groupBy("part").cogroup(right.groupBy("part")).applyInPandas(count, f"size int, draw int, {_PARTIAL}")
    done = cut(parts.groupBy("size", "draw").applyInPandas(summed, _BANK))
    if done.count() < len(tall) * draws:
        return done.unionByName(from_rows(places(sizes).join(done.select("size", "draw"), ["size", "draw"], "left_anti")))
    short = [x for x in sizes if x not in tall]
    return done.unionByName(from_rows(places(short))) if short else done


def packed_bank(bank: DataFrame, per_block: int = 16) -> DataFrame:
    """(size, block, features, data, weights, starts): `per_block` null signatures with their axes side by side."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("draw")
        axes = np.concatenate([np.asarray([list(c) for c in x]) for x in group["loadings"]])
        starts = np.cumsum([0, *[len(x) for x in group["weights"]]])[:-1]
        return pd.DataFrame({
            "size": [group["size"].iloc[0]], "block": [group["block"].iloc[0]], "features": [axes.shape[1]], "data": [axes.astype("<f8").tobytes()],
            "weights": [np.concatenate([np.asarray(x) for x in group["weights"]]).astype("<f8").tobytes()], "starts": [starts.astype("<i8").tobytes()], "draws": [group["draw"].to_numpy().astype("<i4").tobytes()],
        })

    dealt = bank.withColumn("block", F.floor(F.col("draw") / per_block).cast("int"))
    return dealt.groupBy("size", "block").applyInPandas(one, "size int, block int, features int, data binary, weights binary, starts binary, draws binary")


def batched_distances(p: np.ndarray, lp: np.ndarray, axes: np.ndarray, weights: np.ndarray, starts: np.ndarray, share: float) -> np.ndarray:
    """distance() of one signature to each of a block, by one product of matrices and sums over stretches."""
    s = (p.T @ axes.T) ** 2
    terms = lp @ s + s.sum(axis=0) * weights
    return np.maximum(0.0, (2 * share * len(p) - np.add.reduceat(terms, starts)) / (2 * (1 - share)))


def null_distances(sig: DataFrame, packed: DataFrame, per_chunk: int = 64) -> DataFrame:
    """(dataset, size, draw, distance) of every signature to every one of a packed bank.

    A task has one block of the bank and a chunk of about `per_chunk` signatures, whatever the number of either.
    """
    chunks = max(1, -(-sig.count() // per_chunk))
    left = sig.withColumn("chunk", F.pmod(F.xxhash64("dataset"), F.lit(chunks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    right = packed.withColumn("chunk", every)
    keys = packed.select(F.col("size").alias("its_size"), F.col("block").alias("its_block"), every.alias("its_chunk"))
    left = left.join(keys, F.col("chunk") == F.col("its_chunk")).drop("chunk")

    def one(signatures_: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in block.itertuples():
            axes, weights, starts, draws = np.frombuffer(b.data, "<f8").reshape(-1, b.features), np.frombuffer(b.weights, "<f8"), np.frombuffer(b.starts, "<i8"), np.frombuffer(b.draws, "<i4")
            for r in signatures_.itertuples():
                if r.features != b.features:
                    raise ValueError("signature and bank of different features")
                d = batched_distances(np.asarray([list(c) for c in r.loadings]).T, np.asarray(r.weights), axes, weights, starts, r.share)
                out.append(pd.DataFrame({"dataset": r.dataset, "size": b.size, "draw": draws, "distance": d}))
        return pd.concat(out) if out else pd.DataFrame({"dataset": [], "size": [], "draw": [], "distance": []})

    return left.groupBy("its_size", "its_block", "its_chunk").cogroup(right.groupBy("size", "block", "chunk")).applyInPandas(one, "dataset long, size int, draw int, distance double")


def null_profiles(sig: DataFrame, pool: DataFrame, vector: str, grid: list[int], draws: int = 100, seed: int = 7, share: float = 0.5) -> DataFrame:
    """(dataset, size, mu, sigma): mean and deviation of each signature's distances to null signatures of each size."""
    packed = cut(packed_bank(null_bank(pool, vector, grid, draws, share, seed)))
    far = null_distances(sig, packed)
    return far.groupBy("dataset", "size").agg(F.avg("distance").alias("mu"), F.stddev_pop("distance").alias("sigma"))


def calibrate_pairs(pairs: DataFrame, profiles: DataFrame, sizes: DataFrame, exact: bool) -> DataFrame:
    """pairs (a, b, score) with p: the larger lower tail of the score in the two ends' profiles, each at the other's size.

    profiles: dataset, size, mu, sigma, as any loader gives them; sizes: dataset, samples. exact wants a profile at the
    very size; else values between sizes are interpolated, and a size beyond the profiles' is an error.
    """
    tail = lambda mu, sigma: (F.col("score") - mu) / F.greatest(sigma, F.lit(1e-12))
    n = lambda s: sizes.select(F.col("dataset").alias(s), F.col("samples").alias("n" + s))
    rows = pairs.join(n("a"), "a").join(n("b"), "b")
    for s, other in (("a", "nb"), ("b", "na")):
        if exact:
            own = profiles.select(F.col("dataset").alias(s), F.col("size").alias(other), F.col("mu").alias("mu" + s), F.col("sigma").alias("sigma" + s))
            rows = rows.join(own, [s, other], "left")
            rows = rows.withColumn("z" + s, F.coalesce(tail(F.col("mu" + s), F.col("sigma" + s)), F.raise_error(F.concat(F.lit("no profile at size "), F.col(other).cast("string"))).cast("double")))
        else:
            own = profiles.groupBy(F.col("dataset").alias(s)).agg(F.array_sort(F.collect_list(F.struct("size", "mu", "sigma"))).alias("g" + s))
            rows = rows.join(own, s)
            grid = F.transform("g" + s, lambda x: x["size"].cast("double"))
            at = lambda what, s=s, grid=grid, other=other: stats.interpolate(F.col(other).cast("double"), covering(grid, F.col(other)), F.transform("g" + s, lambda x: x[what]))
            rows = rows.withColumn("z" + s, tail(at("mu"), at("sigma")))
    return rows.select(*pairs.columns, stats.normal_cdf(F.greatest("za", "zb")).alias("p"))


class Structure:
    """What two signatures share on a set of features S: sum over axes i, j of (lp_i + lq_j) * (P_S' Q_S)_ij ^ 2.

    Over all features it is what distance() subtracts. With the loadings A = P sqrt(lp) and B = Q sqrt(lq) it is
    |A_S' Q_S|^2 + |P_S' B_S|^2. Several pairs of signatures add up, so one set can be sought for all of them.
    """

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.pairs = [(p, q, np.add.outer(lp, lq)) for p, lp, q, lq in pairs]
        self.features = len(pairs[0][0])
        #: Of each feature alone.
        self.alone = sum(np.einsum("ri,ij,rj->r", p * p, c, q * q) for p, q, c in self.pairs)

    def _cross(self, chosen: np.ndarray) -> list[np.ndarray]:
        return [p[chosen].T @ q[chosen] for p, q, _ in self.pairs]

    def value(self, chosen) -> float:
        chosen = np.asarray(chosen, dtype=np.int64)
        return float(sum((c * m * m).sum() for (_, _, c), m in zip(self.pairs, self._cross(chosen), strict=True)))

    def _lines(self, cross: list[np.ndarray]) -> np.ndarray:
        return sum(np.einsum("ri,ij,rj->r", p, c * m, q, optimize=True) for (p, q, c), m in zip(self.pairs, cross, strict=True))

    def lines(self, chosen) -> np.ndarray:
        """What each feature adds to the bilinear form whose other set is `chosen`."""
        return self._lines(self._cross(np.asarray(chosen, dtype=np.int64)))

    def swap(self, chosen: np.ndarray, sign: float) -> np.ndarray | None:
        """chosen after the best exchange of one feature, or None where no exchange gains."""
        cross, now, best = self._cross(chosen), self.value(chosen), None
        for place, r in enumerate(chosen.tolist()):
            left = [m - np.outer(p[r], q[r]) for (p, q, _), m in zip(self.pairs, cross, strict=True)]
            base = sum((c * m * m).sum() for (_, _, c), m in zip(self.pairs, left, strict=True))
            values = sign * (base + 2 * self._lines(left) + self.alone)
            values[chosen] = -np.inf
            s = int(values.argmax())
            if values[s] > (sign * now if best is None else best[0]) + 1e-12 * max(1.0, abs(now)):
                best = (float(values[s]), place, s)
        return None if best is None else np.sort(np.concatenate([np.delete(chosen, best[1]), [best[2]]]))


def best_set(shared: Structure, k: int, largest: bool = True, starts: int = 3, rounds: int = 50, seed: int = 1729) -> tuple[list[int], float]:
    """k features that share most (or least), those that say most first, and their value.

    Two sets take turns: each is the top k by the bilinear form with the other held, which for the best set never
    falls; from the features that are strongest alone and from random sets. The best set seen from each start is then
    improved by exchanges of one feature while any gains, so that it is at least a local optimum.
    """
    k, sign = min(k, shared.features), 1.0 if largest else -1.0
    top = lambda x: np.sort(np.argsort(-sign * x, kind="stable")[:k])
    rng = np.random.default_rng(seed)
    worth = lambda chosen: sign * shared.value(chosen)
    ends = []
    for start in [top(shared.alone), *[np.sort(rng.choice(shared.features, k, replace=False)) for _ in range(starts)]]:
        one = other = seen = start
        for _ in range(rounds):
            before = one, other
            other = top(shared.lines(one))
            one = top(shared.lines(other))
            seen = max(seen, one, key=worth)
            if (one == before[0]).all() and (other == before[1]).all():
                break
        for _ in range(rounds):
            if k == shared.features or (better := shared.swap(seen, sign)) is None:
                break
            seen = better
        ends.append(seen)
    chosen = max(ends, key=worth)
    order = np.argsort(-sign * shared.lines(chosen)[chosen], kind="stable")
    return chosen[order].tolist(), shared.value(chosen)


def best_features(p: np.ndarray, lp: np.ndarray, q: np.ndarray, lq: np.ndarray, k: int, largest: bool = True, starts: int = 3, rounds: int = 50, seed: int = 1729) -> tuple[list[int], float]:
    """best_set() of one pair of signatures."""
    return best_set(Structure([(p, lp, q, lq)]), k, largest, starts, rounds, seed)


# Sizes at which a trajectory is taken (besides k itself), and random sets of each size.
SIZES = (1, 5, 10, 20, 50)
RANDOM_SETS = 20

_TRAJECTORY = "array<struct<k:int,best_objective:double,worst_objective:double,random_objective:double>>"


def _parts(sig: DataFrame, s: str) -> DataFrame:
    return sig.select(F.col("dataset").alias(s), F.col("loadings").alias("p" + s), F.col("weights").alias("l" + s))


def _structure(rows: list) -> Structure:
    matrix = lambda x: np.asarray([list(c) for c in x]).T
    return Structure([(matrix(r.pa), np.asarray(r.la), matrix(r.pb), np.asarray(r.lb)) for r in rows])


def explain(pairs: DataFrame, sig: DataFrame, k: int = 20, seed: int = 1729) -> DataFrame:
    """Of each pair (a, b): the best and worst k features, their values, and a trajectory over SIZES and k.

    A trajectory's entry has the best, the worst and the mean of RANDOM_SETS random sets of that size. One pair at a time
    is in a task's hands.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.select("a", "b").join(_parts(sig, "a"), "a").join(_parts(sig, "b"), "b").repartition(tasks, "a", "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                shared, path, made = _structure([r]), [], {}
                rng = np.random.default_rng([seed, int(r.a) & 0xFFFFFFFF, int(r.b) & 0xFFFFFFFF])
                own = min(k, shared.features)
                for size in sorted({x for x in SIZES if x < own} | {own}):
                    made = {largest: best_set(shared, size, largest, seed=seed) for largest in (True, False)}
                    chance = [shared.value(rng.choice(shared.features, size, replace=False)) for _ in range(RANDOM_SETS)]
                    path.append({"k": size, "best_objective": made[True][1], "worst_objective": made[False][1], "random_objective": float(np.mean(chance))})
                yield pd.DataFrame({"a": [r.a], "b": [r.b], "best": [made[True][0]], "worst": [made[False][0]], "objective": [made[True][1]], "least": [made[False][1]], "trajectory": [path]})

    return rows.mapInPandas(run, f"a long, b long, best array<int>, worst array<int>, objective double, least double, trajectory {_TRAJECTORY}")


def values(sets: DataFrame, sig: DataFrame) -> DataFrame:
    """(a, b, objective) of given sets (a, b, chosen)."""
    rows = sets.select("a", "b", "chosen").join(_parts(sig, "a"), "a").join(_parts(sig, "b"), "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(r.a, r.b, _structure([r]).value(r.chosen)) for r in frame.itertuples()], columns=["a", "b", "objective"])

    return rows.mapInPandas(run, "a long, b long, objective double")


def explain_sets(pairs: DataFrame, sig: DataFrame, by: str, k: int = 20, seed: int = 1729) -> DataFrame:
    """One set of features for all pairs of each group `by`: (by, pairs, best, worst, objective, least).

    pairs: by, a, b. A group's signatures are in one task, so a group is a set of pairs to be told apart from the rest,
    not a whole corpus.
    """
    rows = pairs.select(F.col(by).alias("by"), "a", "b").join(_parts(sig, "a"), "a").join(_parts(sig, "b"), "b")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        own = list(group.sort_values(["a", "b"]).itertuples())
        shared = _structure(own)
        best, value = best_set(shared, k, seed=seed)
        worst, least = best_set(shared, k, largest=False, seed=seed)
        return pd.DataFrame({by: [own[0].by], "pairs": [len(own)], "best": [best], "worst": [worst], "objective": [value], "least": [least]})

    kind = pairs.select(by).schema[0].dataType.simpleString()
    return rows.groupBy("by").applyInPandas(one, f"`{by}` {kind}, pairs int, best array<int>, worst array<int>, objective double, least double")


def scaled_loadings(sig: DataFrame) -> DataFrame:
    """sig with `scaled`: each axis of loadings times the root of its weight."""
    return sig.withColumn("scaled", F.zip_with("loadings", "weights", lambda axis, w: F.transform(axis, lambda x: x * F.sqrt(w))))


def objective_of(sets: DataFrame, sig: DataFrame) -> DataFrame:
    """(a, b, objective) of given sets in SQL functions, by another way than Structure: sets has a, b and chosen (array).

    |A_S' Q_S|^2 + |P_S' B_S|^2 from the scaled loadings A and B.
    """
    side = lambda s: scaled_loadings(sig).select(F.col("dataset").alias(s), F.col("loadings").alias("p" + s), F.col("scaled").alias("s" + s))
    rows = sets.select("a", "b", "chosen").join(side("a"), "a").join(side("b"), "b")
    on = lambda axis: F.transform("chosen", lambda i: F.get(axis, i))
    dot = lambda x, y: F.aggregate(F.zip_with(on(x), on(y), lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)
    squares = lambda left, right: F.aggregate(F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: dot(x, y)))), F.lit(0.0), lambda t, v: t + v * v)
    return rows.select("a", "b", (squares("sa", "pb") + squares("pa", "sb")).alias("objective"))
