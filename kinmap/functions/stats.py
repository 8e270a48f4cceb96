"""Statistics as column arithmetic, and multiple-testing over whole families without a one-task window."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmap.functions.lineage import cut

# Coefficients of W. J. Cody, "Rational Chebyshev approximations for the error function",
# Mathematics of Computation 23 (1969), for |x| <= 0.46875, |x| <= 4 and beyond.
_SMALL_P = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
_SMALL_Q = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
_MIDDLE_P = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
_MIDDLE_Q = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
_LARGE_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
_LARGE_Q = (2.56852019228982242e00, 1.87295284992346047e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
_ROOT_PI = 0.5641895835477562869


def _horner(x: Column, coefficients, first: float) -> Column:
    """Polynomial in x as one fold: written out, the three of them outgrow a generated method."""
    return F.aggregate(F.array(*[F.lit(c) for c in coefficients]), F.lit(first), lambda total, c: total * x + c)


def erf(x: Column) -> Column:
    """Error function to double precision."""
    y, sign = F.abs(x), F.signum(x)
    s = y * y
    small = x * _horner(s, _SMALL_P[:4], _SMALL_P[4]) / _horner(s, _SMALL_Q, 1.0)
    middle = F.exp(-s) * _horner(y, _MIDDLE_P[:8], _MIDDLE_P[8]) / _horner(y, _MIDDLE_Q, 1.0)
    t = 1 / s
    tail = t * _horner(t, _LARGE_P[:5], _LARGE_P[5]) / _horner(t, _LARGE_Q, 1.0)
    large = F.exp(-s) * (_ROOT_PI - tail) / y
    return F.when(y <= 0.46875, small).when(y <= 4, sign * (1 - middle)).when(y < 27, sign * (1 - large)).otherwise(sign)


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / F.lit(2.0**0.5)))


def benjamini_hochberg(pairs: DataFrame, p: str, q: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds q: min over p' >= p of p' * n / rank(p'), at most 1; null where p is null.

    Rows are counted by distinct p first. Distinct values are ranked within bins of the logarithm of p, and bins among
    each other, so no task sees the whole family; ties share the rank of their last.
    """
    keys = list(by)
    counted = pairs.filter(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    counted = cut(counted.withColumn("_bin", F.when(F.col("_p") <= 0, -1_000_000).otherwise(-F.floor(-F.log("_p") * 32)).cast("long")))
    bins = counted.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_n"))
    up = Window.partitionBy(*keys).orderBy("_bin")
    bins = bins.withColumn("_before", F.sum("_n").over(up) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_p")
    match = [*keys, "_bin"]

    def beside(rows: DataFrame, more: DataFrame, names: list[str]) -> DataFrame:
        """rows with columns of more that has one row for each group and bin; a null key is a key."""
        other = more.select(*[F.col(k).alias(f"_m{n}") for n, k in enumerate(match)], *names)
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_m{n}")) for n, k in enumerate(match)])
        return rows.join(other, same).drop(*[f"_m{n}" for n in range(len(match))])

    ranked = beside(counted, bins, ["_before", "_all"]).withColumn("_rank", F.col("_before") + F.sum("_c").over(inside))
    ranked = cut(ranked.withColumn("_raw", F.col("_p") * F.col("_all") / F.col("_rank")))  # read twice below
    least = ranked.groupBy(*match).agg(F.min("_raw").alias("_least"))
    down = Window.partitionBy(*keys).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    least = least.withColumn("_after", F.min("_least").over(down)).select(*match, "_after")
    inside_down = Window.partitionBy(*keys, "_bin").orderBy(F.desc("_p"))
    done = beside(ranked, least, ["_after"]).withColumn(q, F.least(F.lit(1.0), F.min("_raw").over(inside_down), F.col("_after")))
    done = done.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_p", q)
    condition = [pairs[p] == F.col("_p"), *[pairs[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    return pairs.join(done, reduce(lambda a, b: a & b, condition), "left").select(*pairs.columns, q)


def binned(rows: DataFrame, value: str, bins: int = 1_024) -> DataFrame:
    """Rows that have the value, with _bin: cut at approximate quantiles, so that bins hold about as many rows each.

    The cuts, at most `bins` numbers, reach the driver. Equal values are in one bin; bins ascend with the value.
    """
    there = rows.filter(F.col(value).isNotNull()).withColumn("_value", F.col(value).cast("double"))
    cuts = sorted(set(there.approxQuantile("_value", [k / bins for k in range(1, bins)], 1 / (4 * bins))))
    if not cuts:
        return there.withColumn("_bin", F.lit(0.0)).drop("_value")
    split = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_value", outputCol="_bin", handleInvalid="keep")
    return split.transform(there).drop("_value")


def cumulative_share(rows: DataFrame, value: str, out: str, descending: bool = False, bins: int = 1_024) -> DataFrame:
    """Adds the share of rows whose value is no larger (no smaller, if descending): CUME_DIST without a global window."""
    way = F.desc if descending else F.asc
    counted = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    counted = cut(binned(counted, "_v", bins))
    totals = counted.groupBy("_bin").agg(F.sum("_c").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy(way("_bin"))) - F.col("_n"))
    n = counted.agg(F.sum("_c")).first()[0] or 1
    ranked = counted.join(totals, "_bin").withColumn(out, (F.col("_before") + F.sum("_c").over(Window.partitionBy("_bin").orderBy(way("_v")))) / n)
    return rows.join(ranked.select("_v", out), rows[value] == F.col("_v"), "left").select(*rows.columns, out)


def ranked(rows: DataFrame, value: str, ties: list[str], out: str, bins: int = 1_024) -> DataFrame:
    """Rows that have the value, with their place, from 1, by value and then ties: ranked within bins, and bins among each other."""
    spread = binned(rows, value, bins)
    sizes = spread.groupBy("_bin").agg(F.count("*").alias("_n"))
    before = sizes.select("_bin", (F.sum("_n").over(Window.orderBy("_bin")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_bin").orderBy(value, *ties))
    return spread.withColumn("_place", place).join(before, "_bin").withColumn(out, F.col("_before") + F.col("_place")).select(*rows.columns, out)


def upper_median_of_counts(rows: DataFrame, value: str, count: str, width: int = 1_024) -> DataFrame:
    """One row with the element floor(n / 2), from 0, of whole numbers, each as often as its count says; null where there is none.

    Sums of stretches of `width` numbers are ordered first, then the numbers of one stretch.
    """
    rows = cut(rows.select(F.col(value).alias("_v"), F.col(count).alias("_c"), F.floor(F.col(value) / width).alias("_bin")))
    wanted = F.floor(F.sum("_n").over(Window.partitionBy()) / 2)
    bins = rows.groupBy("_bin").agg(F.sum("_c").alias("_n"))
    bins = bins.select("_bin", "_n", wanted.alias("_at"), (F.sum("_n").over(Window.orderBy("_bin")) - F.col("_n")).alias("_before"))
    one = bins.filter((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_n")))
    up = F.col("_before") + F.sum("_c").over(Window.partitionBy("_bin").orderBy("_v"))
    return rows.join(F.broadcast(one), "_bin").withColumn("_up", up).filter(F.col("_up") > F.col("_at")).agg(F.min("_v").alias(value))


def upper_median(values: Column) -> Column:
    """Element floor(n / 2) of the ascending values; infinity where there is none."""
    kept = F.array_sort(F.array_compact(values))
    return F.coalesce(F.get(kept, F.floor(F.size(kept) / 2).cast("int")), F.lit(float("inf")))


def interpolate(x: Column, grid: Column, values: Column) -> Column:
    """Piecewise-linear value at x over an ascending grid, the end values beyond it."""
    k = F.aggregate(grid, F.lit(0), lambda n, g: n + (g <= x).cast("int"))
    x0, x1, y0, y1 = F.get(grid, k - 1), F.get(grid, k), F.get(values, k - 1), F.get(values, k)
    return F.when(k == 0, F.get(values, F.lit(0))).when(k >= F.size(grid), F.element_at(values, -1)).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def hypergeometric_tail(k: Column, population: Column, marked: Column, drawn: Column, log_factorial: Column) -> Column:
    """P(X >= k) when `drawn` of `population` are drawn and `marked` are marked; log_factorial: array, ln(i!) at i."""

    def choose(n: Column, r: Column) -> Column:
        return F.get(log_factorial, n) - F.get(log_factorial, r) - F.get(log_factorial, n - r)

    low = F.greatest(k, drawn + marked - population, F.lit(0))
    high = F.least(marked, drawn)
    terms = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(terms, F.lit(0.0), lambda s, i: s + F.exp(choose(marked, i) + choose(population - marked, drawn - i) - choose(population, drawn)))
    return F.least(F.lit(1.0), total)
