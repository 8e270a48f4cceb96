"""Graph selection over calibrated pairs: ranks at nodes, unions of strongest neighbours, roll-ups, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def endpoints(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each edge once for either endpoint, with node and other."""
    sides = F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("other")), F.struct(F.col(b).alias("node"), F.col(a).alias("other")))
    return edges.withColumn("_side", F.explode(sides)).select("*", "_side.node", "_side.other").drop("_side")


def union_top_k(edges: DataFrame, k: int, order: list[Column], a: str = "a", b: str = "b") -> DataFrame:
    """Edges that are among the first k of either endpoint."""
    ranked = endpoints(edges, a, b).withColumn("_rank", F.row_number().over(Window.partitionBy("node").orderBy(*order)))
    return ranked.filter(F.col("_rank") <= k).select(*edges.columns).distinct()


def local_rank(edges: DataFrame, order: list[Column], a: str = "a", b: str = "b") -> DataFrame:
    """Adds local_rank: the better of an edge's ranks at its endpoints."""
    ranked = endpoints(edges, a, b).withColumn("_rank", F.row_number().over(Window.partitionBy("node").orderBy(*order)))
    return ranked.groupBy(*edges.columns).agg(F.min("_rank").alias("local_rank"))


def independent_family(edges: DataFrame, q: str = "q") -> Column:
    """The query rule: bound overlap evidence that isn't excluded, or a place in the independent family."""
    return (F.col("overlap_class").isNotNull() & ~F.coalesce("excluded", F.lit(False))) | F.coalesce("in_independent", F.lit(False))


def visible(q_max: float, independent_only: bool, q: str = "q", excluded: str = "excluded") -> Column:
    """The graph rule, weaker than the query rule: a pair without evidence counts as independent."""
    keep = F.col(q) <= q_max
    return keep & ~F.coalesce(F.col(excluded), F.lit(False)) if independent_only else keep


def communities(nodes: DataFrame, community: str, x: str, y: str, size: str) -> DataFrame:
    name = F.coalesce(F.col(community), F.lit("unassigned")).alias("community")
    return nodes.groupBy(name).agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.sum(size).alias("samples"))


def community_links(edges: DataFrame, nodes: DataFrame, id: str, community: str) -> DataFrame:
    """Unordered pairs of communities: edges between, least q, mean score."""
    side = lambda s: nodes.select(F.col(id).alias(s), F.coalesce(F.col(community), F.lit("unassigned")).alias("c" + s))
    joined = edges.join(side("a"), "a").join(side("b"), "b")
    keys = [F.least("ca", "cb").alias("left"), F.greatest("ca", "cb").alias("right")]
    return joined.groupBy(*keys).agg(F.count("*").alias("n"), F.min("q").alias("least_q"), F.avg("score").alias("mean_score"))


def neighbourhood(edges: DataFrame, node: int, q_max: float, limit: int) -> DataFrame:
    """The strongest edges at a node, by q, score and id."""
    mine = edges.filter(((F.col("a") == node) | (F.col("b") == node)) & (F.col("q") <= q_max))
    return mine.orderBy("q", "score", "a", "b").limit(limit)


def edge_strength(mode: str, percentile: str, q: str, text: str) -> Column:
    """In [0, 1]: of the score, of the text, or the smaller of both."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    molecular = clamp(F.coalesce(F.col(percentile), 1 - F.col(q)))
    texts = clamp(F.coalesce(F.col(text), F.lit(0.0)))
    return {"molecular": molecular, "text": texts, "agreement": F.least(molecular, texts)}[mode]


def backbone(edges: DataFrame, zoom: float, mode: str, selected: list[int], order_id: list[Column]) -> DataFrame:
    """Strongest 2, 5 or 12 at each node by zoom, all from 2.1 on, and what touches a selected node."""
    if zoom >= 2.1:
        return edges
    k = 2 if zoom < 0.9 else 5 if zoom < 1.4 else 12
    strong = edges.withColumn("_strength", edge_strength(mode, "percentile", "q", "text_percentile"))
    kept = union_top_k(strong, k, [F.desc("_strength"), *order_id]).drop("_strength")
    touched = edges.filter(F.col("a").isin(selected) | F.col("b").isin(selected))
    return kept.union(touched).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both endpoints among the nodes (column id)."""
    return edges.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi")


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    touched = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    return nodes.join(touched, "id", "left_semi")


def relabel_communities(nodes: DataFrame, id: str, group: str) -> DataFrame:
    """community-0001 and so on, by each group's smallest member."""
    first = nodes.groupBy(group).agg(F.min(id).alias("_first"))
    named = first.withColumn("community", F.concat(F.lit("community-"), F.lpad(F.dense_rank().over(Window.orderBy("_first")).cast("string"), 4, "0")))
    return nodes.join(named.drop("_first"), group)


def layout_normalise(nodes: DataFrame, x: str, y: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Coordinates brought to [low, high]; 0.5 where all are one."""
    ends = nodes.agg(*[f(c).alias(f"_{f.__name__}_{c}") for c in (x, y) for f in (F.min, F.max)])

    def place(c: str) -> Column:
        least, most = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        return F.when(most > least, low + (high - low) * (F.col(c) - least) / (most - least)).otherwise(0.5)

    return nodes.crossJoin(F.broadcast(ends)).withColumns({f"n{c}": place(c) for c in (x, y)}).drop(*ends.columns)


def separation(nodes: DataFrame, id: str, x: str, y: str, target: float) -> DataFrame:
    """Least distance, and pairs closer than 0.8 of the target, by a join of neighbouring grid cells."""
    cell = lambda c: F.floor(F.col(c) / target).cast("long")
    base = nodes.select(F.col(id).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), cell(x).alias("cx"), cell(y).alias("cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = base.withColumn("s", F.explode(steps)).select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    near = base.join(spread, ["cx", "cy"]).filter("id < other").withColumn("d", F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")))
    return near.filter(F.col("d") < target).agg(F.count("*").alias("near_pairs"), F.min("d").alias("least_distance"), F.count_if(F.col("d") < 0.8 * target).alias("severe_pairs"))


def member_edges(wanted: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges of the wanted pairs (a, b) whose ends are both members (id), and `all_there`: whether none of them was left out."""
    kept = induced(wanted, members).join(edges, ["a", "b"])
    got, asked = kept.agg(F.count("*").alias("_got")), wanted.agg(F.count("*").alias("_asked"))
    return kept.crossJoin(F.broadcast(got)).crossJoin(F.broadcast(asked)).withColumn("all_there", F.col("_got") == F.col("_asked")).drop("_got", "_asked")
