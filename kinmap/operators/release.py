"""Releases as data: insert-ignore, newest-wins state, pointers, diffs and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of new whose key isn't there yet, the first of each key."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or [F.col(k) for k in keys])))
    fresh = new.withColumn("_first", first).filter("_first = 1").drop("_first")
    return fresh.join(existing.select(*keys), keys, "left_anti").select(*new.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column], reset: tuple[str, ...] = ()) -> DataFrame:
    """Newest row of each key; columns in reset become null where a row was replaced."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), *order)
    whole = Window.partitionBy(*keys)
    kept = both.withColumn("_place", F.row_number().over(w)).withColumn("_all", F.count("*").over(whole)).filter("_place = 1")
    replaced = (F.col("_new") == 1) & (F.col("_all") > 1)
    return kept.withColumns({c: F.when(~replaced, F.col(c)) for c in reset}).select(*existing.columns) if reset else kept.select(*existing.columns)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def snapshot_diff(before: DataFrame, after: DataFrame, id: str, content: list[str], grouping: list[str]) -> DataFrame:
    """id and change: added, removed, updated (content differs), community (only grouping differs) or same."""
    x = before.select(F.col(id).alias("_x"), *[F.col(c).alias("_x_" + c) for c in content + grouping])
    y = after.select(F.col(id).alias("_y"), *[F.col(c).alias("_y_" + c) for c in content + grouping])
    differs = lambda cs: reduce(lambda a, b: a | b, [~F.col("_x_" + c).eqNullSafe(F.col("_y_" + c)) for c in cs])
    change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(differs(content), "updated").when(differs(grouping), "community").otherwise("same")
    return x.join(y, F.col("_x") == F.col("_y"), "full").select(F.coalesce("_x", "_y").alias(id), change.alias("change"))


def checks(named: dict[str, DataFrame]) -> DataFrame:
    """A row for each check: how many rows break it."""
    rows = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("passed")) for name, df in named.items()]
    return reduce(DataFrame.unionByName, rows)


def add_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both with the columns of new; those that old lacks are null."""
    return new.unionByName(old, allowMissingColumns=True).select(*new.columns)


def update_from(rows: DataFrame, updates: DataFrame, keys: list[str], column: str) -> DataFrame:
    """rows with `column` from updates (keys, column) where there is one."""
    given = updates.select(*keys, F.col(column).alias("_new"))
    return rows.join(given, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*rows.columns)


def mismatches(registered: DataFrame, found: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys whose registered row and found row differ in any of the columns, or that were registered and aren't found."""
    other = found.select(*keys, F.struct(*columns).alias("_found"))
    return registered.select(*keys, F.struct(*columns).alias("_own")).join(other, keys, "left").filter(~F.col("_own").eqNullSafe(F.col("_found"))).select(*keys)


def merged_analysis(pairs: DataFrame, results: DataFrame, key: str, value: str) -> DataFrame:
    """pairs (a, b) with the value of results named a_b, else of those named b_a."""
    rows = pairs.select("a", "b", F.concat_ws("_", "a", "b").alias("_ab"), F.concat_ws("_", "b", "a").alias("_ba"))
    for name, out in (("_ab", "_x"), ("_ba", "_y")):
        rows = rows.join(results.select(F.col(key).alias(name), F.col(value).alias(out)), name, "left")
    return rows.select("a", "b", F.coalesce("_x", "_y").alias(value))


def routed(rows: DataFrame, good: Column) -> DataFrame:
    """rows with route: accept where the check holds, else, or where it can't be told, quarantine."""
    return rows.withColumn("route", F.when(F.coalesce(good, F.lit(False)), "accept").otherwise("quarantine"))
