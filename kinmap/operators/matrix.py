"""Expression matrices in long form: alignment to a frozen feature list, quality, imputation and standardising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def align(matrix: DataFrame, features: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """(dataset, sample, feature, value) of every frozen feature and every sample there is; null where it is missing.

    features: feature, and is joined in its own order elsewhere. Of repeated cells that have a value the smallest row
    number stays and, of one row number, the first by the columns `ties`.
    """
    there = matrix.filter(F.col("value").isNotNull() & F.col("row").isNotNull())
    cells = there.groupBy("dataset", "sample", "feature").agg(F.min_by("value", F.struct("row", *ties)).alias("value"))
    grid = matrix.select("dataset", "sample").distinct().crossJoin(features.select("feature"))
    return grid.join(cells, ["dataset", "sample", "feature"], "left")


def alignment_counts(matrix: DataFrame, features: DataFrame) -> DataFrame:
    """Of each dataset: features present, missing, and dropped as extra."""
    held = matrix.select("dataset", "feature").distinct()
    total = features.count()
    known = held.join(features.withColumn("_k", F.lit(1)), "feature", "left")
    counted = known.groupBy("dataset").agg(F.count("_k").alias("present"), F.count_if(F.col("_k").isNull()).alias("extra"))
    return counted.withColumn("missing", F.lit(total).cast("long") - F.col("present")).select("dataset", "present", "missing", "extra")


def quality(matrix: DataFrame, most_missing: float = 0.01, least_samples: int = 2, flat: float = 1e-12) -> DataFrame:
    """dataset, samples, cells, nonfinite and status: ok, or why it is set aside."""
    ok = finite(F.col("value"))
    good = F.when(ok, F.col("value"))
    by_feature = matrix.groupBy("dataset", "feature").agg(F.count("*").alias("n"), F.count(good).alias("k"), F.var_samp(good).alias("v"))
    samples = matrix.groupBy("dataset").agg(F.countDistinct("sample").alias("samples"))
    folded = by_feature.groupBy("dataset").agg(F.sum("n").alias("cells"), (F.sum("n") - F.sum("k")).alias("nonfinite"), F.max(F.coalesce("v", F.lit(0.0))).alias("largest"))
    status = F.when(F.col("samples") < least_samples, "too few samples").when(F.col("nonfinite") > most_missing * F.col("cells"), "too many missing").when(F.col("largest") <= flat, "no variance").otherwise("ok")
    return folded.join(samples, "dataset").select("dataset", "samples", "cells", "nonfinite", status.alias("status"))


def impute(matrix: DataFrame) -> DataFrame:
    """Missing cells become their feature's mean in the dataset; 0 where it has none."""
    good = F.when(finite(F.col("value")), F.col("value"))
    mean = F.avg(good).over(Window.partitionBy("dataset", "feature"))
    return matrix.withColumn("value", F.coalesce(good, mean, F.lit(0.0)))


def finite_everywhere(matrix: DataFrame, datasets: int) -> DataFrame:
    """Features that every dataset has and that are finite in all of its cells."""
    held = matrix.groupBy("feature").agg(F.countDistinct("dataset").alias("d"), F.bool_and(finite(F.col("value"))).alias("ok"))
    return held.filter(F.col("ok") & (F.col("d") == datasets)).select("feature")


def standardise(matrix: DataFrame) -> DataFrame:
    """Zero mean and unit sample deviation by dataset and feature; a deviation of zero counts as one."""
    w = Window.partitionBy("dataset", "feature")
    sd = F.stddev_samp("value").over(w)
    return matrix.withColumn("value", (F.col("value") - F.avg("value").over(w)) / F.when(F.coalesce(sd, F.lit(0.0)) > 0, sd).otherwise(1.0))
