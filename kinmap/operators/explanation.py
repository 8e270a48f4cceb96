"""Explanations of pairs as artifacts that know what they depend on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmap.functions.lineage import cut
from kinmap.operators import signature


def fingerprint(loadings: Column, weights: Column) -> Column:
    """Of a signature's numbers."""
    return F.sha2(F.to_json(F.struct(loadings.alias("loadings"), weights.alias("weights"))), 256)


def dependencies(pairs: DataFrame, sig: DataFrame, k: int, seed: int) -> DataFrame:
    """pairs (a, b) with `dependency`: a hash of both signatures, the settings and the method's version."""
    marks = sig.select("dataset", fingerprint(F.col("loadings"), F.col("weights")).alias("mark"))
    side = lambda s: marks.select(F.col("dataset").alias(s), F.col("mark").alias("mark_" + s))
    settings = F.lit(f"explanation-v1|k={k}|seed={seed}|sizes={signature.SIZES}|random={signature.RANDOM_SETS}")
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return rows.select("a", "b", F.sha2(F.concat_ws("|", settings, "mark_a", "mark_b"), 256).alias("dependency"))


def replay(pairs: DataFrame, sig: DataFrame, stored: DataFrame | None, k: int = 20, seed: int = 1729) -> DataFrame:
    """(a, b, dependency, payload, made): stored artifacts whose dependency still holds, and new ones for the rest.

    stored: what an earlier call gave, or None. made tells which were computed now. payload is the explanation as JSON.
    """
    wanted = cut(dependencies(pairs, sig, k, seed))
    if stored is None:
        kept, missing = None, wanted
    else:
        held = stored.select("a", "b", "dependency", "payload")
        kept = wanted.join(held, ["a", "b", "dependency"]).withColumn("made", F.lit(False))
        missing = wanted.join(held, ["a", "b", "dependency"], "left_anti")
    made = signature.explain(missing, sig, k, seed).withColumn("payload", F.to_json(F.struct("best", "worst", "objective", "least", "trajectory")))
    new = missing.join(made.select("a", "b", "payload"), ["a", "b"]).withColumn("made", F.lit(True))
    return cut(new if kept is None else kept.unionByName(new))
