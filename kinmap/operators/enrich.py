"""Over-representation of a gene set in pathways."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.functions import stats


#: Genes of a universe; a table of one number a gene is broadcast.
MOST_GENES = 5_000_000


def enrichment(members: DataFrame, universe: DataFrame, requested: DataFrame, least: int, most: int, least_overlap: int = 1) -> DataFrame:
    """pathway, size, overlap, expected, fold, p and q.

    members: (pathway, gene); universe and requested: gene. Sizes count genes of the universe; q is over all pathways of
    eligible size, and only then small overlaps go.
    """
    genes = universe.select("gene").distinct()
    held = members.select("pathway", "gene").distinct().join(genes, "gene", "left_semi")
    tested = requested.select("gene").distinct().join(genes, "gene", "left_semi")
    n, drawn = genes.count(), tested.count()
    if n > MOST_GENES:
        raise ValueError(f"a universe of more than {MOST_GENES} genes")
    logs, total = [0.0], 0.0
    for i in range(1, n + 1):
        total += math.log(i)
        logs.append(total)
    counted = held.join(tested.withColumn("hit", F.lit(1)), "gene", "left").groupBy("pathway").agg(F.count("*").cast("int").alias("size"), F.count("hit").cast("int").alias("overlap"))
    eligible = counted.filter(F.col("size").between(least, most))
    table = members.sparkSession.createDataFrame([(logs,)], "logs array<double>")  # one number a gene
    rows = eligible.crossJoin(F.broadcast(table))
    p = F.when(F.lit(drawn) == 0, 1.0).otherwise(stats.hypergeometric_tail(F.col("overlap"), F.lit(n), F.col("size"), F.lit(drawn), F.col("logs")))
    expected = F.col("size") * F.lit(float(drawn)) / F.lit(float(max(n, 1)))
    rows = rows.select("pathway", "size", "overlap", F.round(expected, 9).alias("expected"), F.round(F.when(expected > 0, F.col("overlap") / expected).otherwise(0.0), 9).alias("fold"), F.round(p, 9).alias("p"))
    ranked = stats.benjamini_hochberg(rows, "p", "q")
    return ranked.filter(F.col("overlap") >= least_overlap).withColumn("q", F.round("q", 9))


def gene_pathways(members: DataFrame, genes: DataFrame) -> DataFrame:
    """(pathway, gene) of a set of genes, each once."""
    return members.select("pathway", "gene").join(genes.select("gene"), "gene", "left_semi").select("pathway", "gene").distinct()
