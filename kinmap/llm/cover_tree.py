"""Exact top-k search by inner product with dual cover trees.

Vectors are turned into whole numbers, floor(scale * x), so scores are exact. Each vector goes to the nearest of a
fixed number of pivots, sampled by hash, and the vectors of a pivot are cut by hash into blocks, so a block's vectors
lie together and a vector that many rows share still makes no large block. A block is built into a cover tree: a
node's points lie within its covering radius of its centre, its children's centres are more than half that radius
apart and cover its points within that half, and the node's own centre is the first of them; children of few points
may share leaves about the node's own centre. Queries, which are every row of a stated set, are cut into blocks and
trees of their own.

Trees are gone down in pairs of nodes, one of queries (centre q, radius r) and one of data (centre c, radius R). Their
points can score at most q.c + r|c| + R|q| + rR; where that is below the worst k-th score of the query node's points
the pair is dropped with all below both. Else the node of the larger radius is replaced by its children, until two
leaves meet, which are scored exactly, best bounds first. The same bound holds for the roots, before a block is sent:
each block of queries first meets the data blocks that promise most, and only those that could still better its worst
k-th score are sent to it after that.

Work grows with queries times data where bounds prune nothing, as an exact search over unstructured vectors must, but
nothing larger than two blocks is ever in one task, and a task sends on k rows a query.

Cases: rows whose vector is null or holds a null or non-finite component, or whose id is null, take no part. Vectors
shorter than the longest are filled up with zeros. Rows that repeat an id are rows of their own: each is a candidate of
the others, and each that is a query is answered; ties go to the smaller id. With fewer than k candidates all are
returned. Scores are exact up to 63 bits; beyond, a score is the largest or smallest long, and of such only ids tell the
order. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmap.llm.common import Scratch, column, width

BLOCK_ROWS = 4_096
#: Data blocks that one task takes a block of queries through.
TOGETHER = 8
LEAF = 32
#: Pivots that vectors are dealt to; points of a query tree's smallest child that isn't pooled, and of a pooled leaf.
PIVOTS = 256
POOLED = 8
POOL = 256
EXACT = 1 << 53
#: Score of nothing; a score from this size on is held at the end of its range.
NOTHING = -(2**63 - 1)
FAR = 2.0**63 - 2.0**40


class Tree:
    """points (whole numbers) in leaf order, their ids and rows, and nodes in breadth-first order."""

    FIELDS = ("points", "ids", "rows", "centre", "radius", "child", "children", "first", "count")

    def __init__(self, **fields: np.ndarray) -> None:
        self.__dict__.update(fields)
        self.wide = self.points.astype(np.float64)
        self.norm = np.sqrt((self.wide[self.centre] ** 2).sum(axis=1))

    def pack(self) -> dict[str, bytes]:
        return {k: getattr(self, k).tobytes() for k in self.FIELDS}


KINDS = {"points": "<i8", "ids": "<i8", "rows": "<i8", "centre": "<i4", "radius": "<f8", "child": "<i4", "children": "<i4", "first": "<i4", "count": "<i4"}
_PACKED = "block int, dim int, " + ", ".join(f"{k} binary" for k in Tree.FIELDS)


def unpack(row: dict) -> Tree:
    fields = {k: np.frombuffer(row[k], KINDS[k]) for k in Tree.FIELDS}
    fields["points"] = fields["points"].reshape(-1, row["dim"])
    return Tree(**fields)


def build(points: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF, pooled: int = 0) -> Tree:
    """Cover tree of the points; radii are the largest distances that occur, a little rounded up.

    Children of fewer than `pooled` points go together into leaves of at most POOL about their parent's centre.
    """
    wide = points.astype(np.float64)

    def distances(own: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(((wide[own] - wide[to]) ** 2).sum(axis=1))

    every = np.arange(len(points))
    start = int(((wide - wide.mean(axis=0)) ** 2).sum(axis=1).argmin())
    queue = [(every, start, float(distances(every, start).max()), False)]
    nodes: list[tuple[int, float, int, int, int, int]] = []
    order: list[np.ndarray] = []
    placed = at = 0
    while at < len(queue):
        own, centre, radius, whole = queue[at]
        at += 1
        if whole or len(own) <= leaf or radius == 0.0:
            nodes.append((centre, radius, 0, 0, placed, len(own)))
            order.append(own)
            placed += len(own)
            continue
        near, nearest = distances(own, centre), np.zeros(len(own), np.int32)
        centres = [centre]
        while (far := int(near.argmax())) >= 0 and near[far] > radius / 2:
            d = distances(own, int(own[far]))
            closer = d < near
            near[closer], nearest[closer] = d[closer], len(centres)
            centres.append(int(own[far]))
        grouped = np.argsort(nearest, kind="stable")
        cuts = np.searchsorted(nearest[grouped], np.arange(len(centres) + 1))
        parts = [grouped[cuts[k] : cuts[k + 1]] for k in range(len(centres))]
        kids = [(own[x], c, float(near[x].max()), False) for x, c in zip(parts, centres, strict=True) if len(x) >= pooled]
        loose = np.concatenate([own[x] for x in parts if len(x) < pooled] or [own[:0]])
        for k in range(0, len(loose), POOL):
            some = loose[k : k + POOL]
            kids.append((some, centre, float(distances(some, centre).max()), True))
        nodes.append((centre, radius, len(queue), len(kids), 0, 0))
        queue += kids
    leaf_order = np.concatenate(order)
    place = np.empty(len(points), np.int32)
    place[leaf_order] = np.arange(len(points))
    centre, radius, child, children, first, count = (np.asarray(x) for x in zip(*nodes, strict=True))
    return Tree(points=points[leaf_order], ids=ids[leaf_order], rows=rows[leaf_order], centre=place[centre].astype("<i4"), radius=radius * (1 + 1e-12) + 1e-9 * (radius > 0), child=child.astype("<i4"), children=children.astype("<i4"), first=first.astype("<i4"), count=count.astype("<i4"))


class Best:
    """The k best (score, id) of each query of a tree so far."""

    def __init__(self, queries: Tree, k: int) -> None:
        n = len(queries.ids)
        self.queries, self.k = queries, k
        self.score = np.full((n, k), NOTHING, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, own: np.ndarray | slice = slice(None)) -> float:
        return float(self.score[own, self.k - 1].min())

    def floors(self) -> np.ndarray:
        """Worst k-th score below each node of the query tree."""
        tree, out = self.queries, np.full(len(self.queries.centre), np.inf)
        kth = self.score[:, self.k - 1].astype(np.float64)
        for node in range(len(out) - 1, -1, -1):  # children come after their parents
            a, n = (tree.child[node], tree.children[node]) if tree.children[node] else (tree.first[node], tree.count[node])
            out[node] = (out if tree.children[node] else kth)[a : a + n].min()
        return out

    def offer(self, own: np.ndarray, data: Tree, at: np.ndarray) -> None:
        """Score queries `own` against points `at` of a data tree and keep the best."""
        q = self.queries
        largest = np.abs(q.wide).max(initial=0) * np.abs(data.wide).max(initial=0) * max(1, q.points.shape[1])
        if largest < EXACT:
            scores = (q.wide[own] @ data.wide[at].T).astype(np.int64)
        else:
            scores = q.points[own] @ data.points[at].T  # modulo 2^64, so right where the score has 63 bits
            if largest >= 2.0**62:
                near = q.wide[own] @ data.wide[at].T
                scores[near >= FAR] = 2**63 - 1
                scores[near <= -FAR] = NOTHING + 1
        scores[q.rows[own][:, None] == data.rows[at][None, :]] = NOTHING  # a row is no candidate of its own
        least = self.score[own, self.k - 1]
        if len(at) > self.k:
            least = np.maximum(least, np.partition(scores, len(at) - self.k, axis=1)[:, len(at) - self.k])
        row, col = np.nonzero((scores >= least[:, None]) & (scores > NOTHING))
        if not len(row):
            return
        row = np.concatenate([row, np.repeat(np.arange(len(own)), self.k)])
        value = np.concatenate([scores[row[: len(col)], col], self.score[own].ravel()])
        ids = np.concatenate([data.ids[at][col], self.id[own].ravel()])
        order = np.lexsort((ids, -value, row))
        row, value, ids = row[order], value[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        keep = rank < self.k
        self.score[own[row[keep]], rank[keep]] = value[keep]
        self.id[own[row[keep]], rank[keep]] = ids[keep]


def _loosened(bound: np.ndarray) -> np.ndarray:
    """A bound with what rounding may have taken from it."""
    return bound + 1e-9 * np.abs(bound) + 1e-6


def most(queries: Tree, qs: np.ndarray, data: Tree, ds: np.ndarray) -> np.ndarray:
    """What points below each node of qs can score at most with points below the node of ds beside it."""
    out = np.empty(len(qs))
    for a in range(0, len(qs), 1 << 15):
        x, y = qs[a : a + (1 << 15)], ds[a : a + (1 << 15)]
        dot = np.einsum("ij,ij->i", queries.wide[queries.centre[x]], data.wide[data.centre[y]])
        out[a : a + (1 << 15)] = dot + queries.radius[x] * data.norm[y] + data.radius[y] * (queries.norm[x] + queries.radius[x])
    return _loosened(out)


def _below(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of sizes[0] numbers, then those of first[1], and so on."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def meeting_leaves(best: Best, data: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query leaf, data leaf, bound) of the leaves that are left when both trees are gone down together."""
    queries, floor = best.queries, best.floors()
    qs, ds, done = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(qs):
        bound = most(queries, qs, data, ds)
        able = bound >= floor[qs]
        qs, ds, bound = qs[able], ds[able], bound[able]
        inner_q, inner_d = queries.children[qs] > 0, data.children[ds] > 0
        leaves = ~inner_q & ~inner_d
        done.append((qs[leaves], ds[leaves], bound[leaves]))
        split_q = inner_q & (~inner_d | (queries.radius[qs] >= data.radius[ds]))
        split_d = ~leaves & ~split_q
        by_q, by_d = queries.children[qs[split_q]].astype(np.int64), data.children[ds[split_d]].astype(np.int64)
        qs, ds = (
            np.concatenate([_below(queries.child[qs[split_q]].astype(np.int64), by_q), np.repeat(qs[split_d], by_d)]),
            np.concatenate([np.repeat(ds[split_q], by_q), _below(data.child[ds[split_d]].astype(np.int64), by_d)]),
        )
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def search_block(best: Best, data: Tree, chunk: int = 1_024) -> int:
    """Take the query tree and a data tree down together; returns how many scores were made."""
    tree, made = best.queries, 0
    qs, ds, bounds = meeting_leaves(best, data)
    order = np.lexsort((-bounds, qs))
    qs, ds, bounds = qs[order], ds[order], bounds[order]
    cuts = np.flatnonzero(np.concatenate([[True], qs[1:] != qs[:-1], [True]])) if len(qs) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        leaf = qs[a]
        own = np.arange(tree.first[leaf], tree.first[leaf] + tree.count[leaf])
        ends = np.cumsum(data.count[ds[a:b]])
        at = a
        while at < b and bounds[at] >= best.worst(own):
            to = a + max(at - a + 1, int(np.searchsorted(ends, (ends[at - a - 1] if at > a else 0) + chunk, side="right")))
            points = _below(data.first[ds[at:to]].astype(np.int64), data.count[ds[at:to]].astype(np.int64))
            best.offer(own, data, points)
            made += len(own) * len(points)
            at = to
    return made


def _build_blocks(dim: int, pooled: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        vectors = table.column("v").combine_chunks()
        sizes = np.diff(vectors.offsets.to_numpy())
        points = np.zeros((len(vectors), dim), "<i8")
        points[np.arange(dim)[None, :] < sizes[:, None]] = vectors.flatten().to_numpy()
        tree = build(points, table.column("vec_id").to_numpy(), table.column("row").to_numpy(), pooled=pooled)
        return pa.Table.from_pylist([{"block": key[0].as_py(), "dim": dim} | tree.pack()], schema=_ARROW)

    return run


_ARROW = pa.schema([("block", pa.int32()), ("dim", pa.int32()), *[(k, pa.binary()) for k in Tree.FIELDS]])


def _cells(pivots: np.ndarray, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the number of the nearest pivot to rows with a vector v."""
    half = (pivots**2).sum(axis=1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2_048):
                batch = whole.slice(a, 2_048)
                vectors = pa.concat_arrays([column(batch, "v")])
                sizes = np.diff(vectors.offsets.to_numpy())
                points = np.zeros((len(vectors), dim))
                points[np.arange(dim)[None, :] < sizes[:, None]] = vectors.flatten().to_numpy()
                cell = (points @ pivots.T - half).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    return run


def _by_pair(k: int, give: Callable[[Best], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a partition are sorted by pair: each pair's query tree (kind 0), then its data trees."""
        rows = (b.slice(i, 1) for b in batches for i in range(b.num_rows))
        for _, own in groupby(rows, key=lambda r: column(r, "pair")[0].as_py()):
            best = None
            for one in own:
                row = one.to_pylist()[0]
                tree = unpack(row)
                if row["kind"] == 0:
                    best, asked = Best(tree, k), row["block"]
                else:
                    search_block(best, tree)
            yield give(best, asked)

    return run


def _found(best: Best, asked: int) -> pa.RecordBatch:
    there = best.score > NOTHING
    q, _ = np.nonzero(there)
    return pa.RecordBatch.from_arrays([pa.array(best.queries.rows[q]), pa.array(best.queries.ids[q]), pa.array(best.id[there]), pa.array(best.score[there])], ["row", "query_id", "vec_id", "score"])


def _floor(best: Best, asked: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([asked], pa.int32()), pa.array([best.worst()])], ["asked", "floor"])


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: its number, its root's centre, that one's length, and the root's radius."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            tree = unpack(row)
            centre = pa.array([tree.wide[tree.centre[0]].tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int32()), centre, pa.array([float(tree.norm[0])]), pa.array([float(tree.radius[0])])], ["block", "centre", "norm", "radius"])


_ROOT = "block int, centre array<double>, norm double, radius double"


def root_bounds(asked: DataFrame, data: DataFrame) -> DataFrame:
    """(asked, block, bound) of every block of queries and every block of data: numbers only."""
    q = asked.select(F.col("block").alias("asked"), F.col("centre").alias("cq"), F.col("norm").alias("nq"), F.col("radius").alias("rq"))
    d = data.select("block", F.col("centre").alias("cd"), F.col("norm").alias("nd"), F.col("radius").alias("rd"))
    dot = F.aggregate(F.zip_with("cq", "cd", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    bound = dot + F.col("rq") * F.col("nd") + F.col("rd") * (F.col("nq") + F.col("rq"))
    return q.join(d, F.lit(True)).select("asked", "block", (bound + F.abs(bound) * 1e-9 + 1e-6).alias("bound"))


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best other rows of every row that is_query holds for.

    The pivots reach the driver, at most PIVOTS vectors.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "cover")
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fit, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), whole.alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.save(rows, "vectors", "zstd")
    total, asking, dim = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v"))).first()
    if not total or not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, dim)
    sample = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(min(PIVOTS, -(-total // block_rows))).collect()
    pivots = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        pivots[i, : len(r["v"])] = r["v"]
    dealt = scratch.save(rows.mapInArrow(_cells(pivots, dim), T.StructType([*rows.schema, T.StructField("cell", T.IntegerType())])), "dealt", "zstd")

    def blocks(own: DataFrame, name: str, pooled: int) -> DataFrame:
        """Trees of about block_rows vectors; a cell of few vectors shares a block with the next ones."""
        sizes = {r["cell"]: r["n"] for r in own.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most PIVOTS
        first, parts, at, room = {}, {}, 0, 0
        for cell in sorted(sizes):
            parts[cell] = -(-sizes[cell] // block_rows)
            if parts[cell] == 1 and sizes[cell] <= room:
                first[cell], room = at - 1, room - sizes[cell]
                continue
            first[cell], at = at, at + parts[cell]
            room = block_rows - sizes[cell] if parts[cell] == 1 else 0
        table = spark.createDataFrame([(c, first[c], parts[c]) for c in sizes], "cell int, first int, parts int")
        numbered = own.join(F.broadcast(table), "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int"))
        return scratch.save(numbered.groupBy("block").applyInArrow(_build_blocks(dim, pooled), _PACKED), name, "zstd")

    data, asked = blocks(dealt, "data", 0), blocks(dealt.filter("asks"), "queries", POOLED)
    bounds = scratch.save(root_bounds(asked.mapInArrow(_roots, _ROOT), data.mapInArrow(_roots, _ROOT)), "bounds")

    def meet(pairs: DataFrame, give, schema: str) -> DataFrame:
        """pairs: asked, block, part. Each (asked, part) is one task's: the query block, then its data blocks."""
        groups = pairs.select("asked", "part").distinct().withColumn("pair", F.xxhash64("asked", "part"))
        asks = asked.withColumn("asked", F.col("block")).join(groups, "asked").withColumn("kind", F.lit(0)).withColumn("bound", F.lit(0.0))
        has = data.join(pairs.withColumn("pair", F.xxhash64("asked", "part")).withColumnRenamed("block", "met"), F.col("block") == F.col("met")).drop("met").withColumn("kind", F.lit(1))
        both = asks.unionByName(has).drop("asked", "part")
        return both.repartition(width(spark), "pair").sortWithinPartitions("pair", "kind", F.desc("bound"), "block").mapInArrow(_by_pair(k, give), schema)

    promise = bounds.withColumn("place", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("bound"), "block")))
    first = promise.filter(F.col("place") <= TOGETHER).withColumn("part", F.lit(0))
    floors = scratch.save(meet(first.select("asked", "block", "bound", "part"), _floor, "asked int, floor double"), "floors")
    left = promise.join(floors, "asked").filter(F.col("bound") >= F.col("floor")).withColumn("part", F.expr(f"(place - 1) div {TOGETHER}").cast("int"))
    found = meet(scratch.save(left.select("asked", "block", "bound", "part"), "left"), _found, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
