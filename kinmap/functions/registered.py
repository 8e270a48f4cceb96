"""The engine's column functions by name in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, type and body of each: plain SQL, so the optimiser sees through them.
SCALAR = {
    "kinmap_term": ("text string", "string", "regexp_replace(lower(text), '[^a-z0-9]', '')"),
    "kinmap_slug": ("text string", "string", "substring(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-'), '^-+|-+$', ''), 1, 64)"),
    "kinmap_similarity": ("distance double", "double", "1 / (1 + distance)"),
    "kinmap_dot": ("x array<double>, y array<double>", "double", "aggregate(zip_with(x, y, (a, b) -> a * b), 0D, (s, v) -> s + v)"),
    "kinmap_axis_term": ("x array<double>, y array<double>, wx double, wy double", "double", "(wx + wy) * power(aggregate(zip_with(x, y, (a, b) -> a * b), 0D, (s, v) -> s + v), 2)"),
}
#: Table functions.
TABLE = {
    "kinmap_size_grid": ("low int, high int", "size int", "select size from (values 5, 8, 12, 16, 20, 25, 30, 40, 50, 75, 100, 150, 200, 300, 400) as t(size) where size between low and high"),
}


def register(spark: SparkSession) -> list[str]:
    """Make all of them known to the session; returns their names."""
    for name, (parameters, kind, body) in SCALAR.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    for name, (parameters, columns, body) in TABLE.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns table({columns}) return {body}")
    return [*SCALAR, *TABLE]
