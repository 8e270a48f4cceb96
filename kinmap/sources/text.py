"""Readers of delimited matrices, line records and nested metadata, as frames of text columns."""

from __future__ import annotations

import glob

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def separator(path: str) -> str:
    """Comma for .csv with or without .gz, a tab for all else."""
    return "," if path.lower().removesuffix(".gz").endswith(".csv") else "\t"


def expand(patterns: list[str]) -> list[str]:
    """Paths that match, each once and sorted; a pattern without a match stays, to fail where it is read."""
    out: list[str] = []
    for pattern in patterns:
        out += sorted(glob.glob(pattern)) or [pattern]
    return list(dict.fromkeys(out))


def read_matrix(spark: SparkSession, path: str, features_by_samples: bool = True) -> DataFrame:
    """(dataset, sample, feature, value) of a delimited file whose first column names its rows.

    Every cell is read as text and tried as a number; what isn't one is NaN.
    """
    from kinmap.functions import ids

    wide = spark.read.option("header", True).option("sep", separator(path)).csv(path)
    first, *rest = wide.columns
    cells = wide.select(F.col(first).alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("cell")) for c in rest])).alias("x"))
    names = ("feature", "sample") if features_by_samples else ("sample", "feature")
    return cells.select(ids.dataset_from_file(F.lit(path)).alias("dataset"), F.col("row").alias(names[0]), F.col("x.column").alias(names[1]), number(F.col("x.cell")).alias("value")).select("dataset", "sample", "feature", "value")


def number(cell: Column) -> Column:
    return F.coalesce(cell.try_cast("double"), F.lit(float("nan")))


def read_table(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """base.parquet where it is there, else base.tsv.gz."""
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(base + ".parquet")
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.read.schema(schema).parquet(base + ".parquet")
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(base + ".tsv.gz")


def first_symbol(text: Column) -> Column:
    """What stands before ///; null where blank."""
    return F.nullif(F.trim(F.get(F.split(text, "///"), F.lit(0))), F.lit(""))


def probe_genes(rows: DataFrame, probe: str, gene: str, order: str) -> DataFrame:
    """(probe, gene): the last row of each probe wins."""
    return rows.withColumn("_g", first_symbol(F.col(gene))).filter("_g is not null").groupBy(F.col(probe).alias("probe")).agg(F.max_by("_g", order).alias("gene"))


def probe_multimap(rows: DataFrame, probe: str, gene: str, order: str) -> DataFrame:
    """(probe, genes): each probe's different genes by first appearance."""
    first = rows.groupBy(F.col(probe).alias("probe"), F.col(gene).alias("g")).agg(F.min(order).alias("o"))
    return first.groupBy("probe").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "g"))), lambda x: x["g"]).alias("genes"))


def key_value(line: Column) -> tuple[Column, Column]:
    """The two sides of `!Key = value`, trimmed; null where a line isn't of that form."""
    found = F.regexp_extract(line, r"^\s*!?([^=]*?)\s*=\s*(.*?)\s*$", 1)
    return F.nullif(found, F.lit("")), F.when(found != "", F.regexp_extract(line, r"^\s*!?([^=]*?)\s*=\s*(.*?)\s*$", 2))


def record_number(starts: Column, file: str, order: list[str]) -> Column:
    """Number of the record that a line is in, from 1; 0 before the first start."""
    return F.sum(starts.cast("int")).over(Window.partitionBy(file).orderBy(*order))


def fields_of(rows: DataFrame, keys: list[str], field: str, value: str) -> DataFrame:
    """Sorted different non-blank values of each field, as one text."""
    kept = rows.filter(F.coalesce(F.trim(value), F.lit("")) != "")
    return kept.groupBy(*keys, field).agg(F.array_join(F.array_sort(F.collect_set(F.trim(value))), "; ").alias("values"))


def diagnostics(lines: DataFrame, column: str, markers: dict[str, str]) -> DataFrame:
    """Lines that hold a marker (kind: regular expression, in lower case), with the first kind that fits."""
    kind = None
    for name, pattern in markers.items():
        kind = (F.when if kind is None else kind.when)(F.lower(column).rlike(pattern), name)
    return lines.withColumn("kind", kind).filter("kind is not null")


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first element of a plain tag, trimmed; empty where there is none."""
    return F.trim(F.regexp_extract(html, f"<{tag}>([^<]*)</{tag}>", 1))
