"""Browser-side pieces: discovery filters as typed queries, summaries, and compact evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def discovery_ast(q_max: float | None = None, percentile: float | None = None, independent: bool | None = None, relation: str = "any", tissue: str = "", text_at_most: float | None = None) -> dict:
    """The filters of a discovery panel as one query; none of them holds for all."""
    parts: list[dict] = []
    if q_max is not None:
        parts.append({"edge.q_value": {"lte": q_max}})
    if percentile is not None:
        parts.append({"edge.score_percentile": {"gte": percentile}})
    if independent is not None:
        parts.append({"edge.independent": {"eq": independent}})
    if relation in ("same_tissue", "same_tissue_other_disease"):
        parts.append({"node.tissue": {"same": True}})
    if relation in ("other_disease", "same_tissue_other_disease"):
        parts.append({"node.disease": {"different": True}})
    if relation == "same_disease":
        parts.append({"node.disease": {"same": True}})
    if tissue.strip():
        parts.append({"node.tissue_system": {"contains": tissue.strip()}})
    if text_at_most is not None:
        parts.append({"edge.text_percentile": {"lte": text_at_most}})
    return {"all": True} if not parts else parts[0] if len(parts) == 1 else {"and": parts}


def loaded_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose endpoints are there and whose score is finite, probabilities brought into [0, 1]."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))
    there = edges.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    fine = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    return there.filter(fine).withColumns({c: clamp(c) for c in ("p", "q")})


def computed_text(score: Column, provenance: Column) -> Column:
    """A text score only where it was computed and is finite."""
    return F.when((provenance == "computed") & score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")), score)


def hue(text: Column) -> Column:
    """Colour of a name: FNV-1a over its characters, as a signed 32-bit number, in degrees."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))) * 16777619).bitwiseAND(F.lit(4294967295)))
    return F.abs(F.when(h >= 2147483648, h - 4294967296).otherwise(h)) % 360


def shown_probability(p: Column) -> Column:
    small = F.regexp_replace(F.format_string("%.2e", p), r"e([+-])0?(\d+)$", "e$1$2")
    return F.when(p == 0, "0").when(p < 0.001, small).otherwise(F.format_string("%.3f", p))


def compact_evidence(candidates: Column, features: Column, pathways: Column, reviewed: Column) -> Column:
    """At most three candidates (none where unreviewed), five features and two pathways."""
    return F.struct(F.when(reviewed, F.slice(candidates, 1, 3)).alias("candidates"), F.slice(features, 1, 5).alias("features"), F.slice(pathways, 1, 2).alias("pathways"))


# Shapes of the nodes.
SHAPES = ("circle", "square", "diamond", "triangle", "hexagon", "cross")


def shape_of(index: Column) -> Column:
    """A shape for each whole number, in turn."""
    return F.element_at(F.array(*[F.lit(s) for s in SHAPES]), (F.pmod(index, F.lit(len(SHAPES))) + 1).cast("int"))


def projected_features(rows: DataFrame, id: str, order: list[str], name: Column, ambiguous: Column) -> DataFrame:
    """(id, features): the first word of each feature's name in order, with a star where it is ambiguous."""
    shown = F.concat(F.substring_index(name, " ", 1), F.when(ambiguous, "*").otherwise(""))
    held = rows.groupBy(F.col(id).alias("id")).agg(F.array_sort(F.collect_list(F.struct(*order, shown.alias("_shown")))).alias("_all"))
    return held.select("id", F.array_join(F.col("_all").getField("_shown"), ",").alias("features"))


def prompt_text(rows: DataFrame, id: str, item: str, strength: str, head: str) -> DataFrame:
    """(id, prompt): `head` with the id, and its items, the strongest first and each once."""
    best = rows.groupBy(F.col(id).alias("id"), F.col(item).alias("_item")).agg(F.max(strength).alias("_s"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_s")).alias("_s"), "_item")))
    return best.groupBy("id").agg(ordered.alias("_all")).select("id", F.format_string(head + " %d: %s", "id", F.array_join(F.col("_all").getField("_item"), ", ")).alias("prompt"))
