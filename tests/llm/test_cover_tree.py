import math

import duckdb
import numpy as np
import pytest

from kinmap.llm import cover_tree, queries


def brute(rows, k, asks):
    fit = [(i, v, n) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = max((len(v) for _, v, _ in fit), default=0)
    whole = [(i, [math.floor(64 * x) for x in v] + [0] * (dim - len(v)), n) for i, v, n in fit]
    out = []
    for i, q, n in whole:
        if asks(i):
            best = sorted((-sum(a * b for a, b in zip(q, d)), j) for j, d, m in whole if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def members(tree, node):
    if not tree.children[node]:
        return np.arange(tree.first[node], tree.first[node] + tree.count[node])
    return np.concatenate([members(tree, k) for k in range(tree.child[node], tree.child[node] + tree.children[node])])


@pytest.mark.parametrize("kind", ["random", "clusters", "equal", "line"])
def test_tree_covers_and_separates(kind):
    rng = np.random.default_rng(2)
    points = {"random": rng.integers(-50, 50, (300, 8)), "clusters": rng.integers(-900, 900, (6, 8))[rng.integers(0, 6, 300)] + rng.integers(-3, 4, (300, 8)), "equal": np.ones((300, 8), int), "line": np.arange(300)[:, None] * np.ones((1, 8), int)}[kind].astype("<i8")
    tree = cover_tree.build(points, np.arange(300), np.arange(300))
    assert sorted(tree.ids) == list(range(300)) and (tree.points == points[tree.ids]).all()
    for node in range(len(tree.radius)):
        own = members(tree, node)
        d = np.linalg.norm(tree.wide[own] - tree.wide[tree.centre[node]], axis=1)
        assert d.max() <= tree.radius[node]
        kids = np.arange(tree.child[node], tree.child[node] + tree.children[node])
        if len(kids):
            c = tree.wide[tree.centre[kids]]
            apart = np.linalg.norm(c[:, None] - c[None], axis=2)[np.triu_indices(len(kids), 1)]
            assert (apart > tree.radius[node] / 2 * 0.999).all() and tree.centre[kids[0]] == tree.centre[node]
    tree = cover_tree.build(points, np.arange(300), np.arange(300), pooled=4)
    assert sorted(members(tree, 0)) == list(range(300)) and tree.count.max() <= max(cover_tree.POOL, 300 * (kind == "equal"))
    for node in range(len(tree.radius)):
        assert np.linalg.norm(tree.wide[members(tree, node)] - tree.wide[tree.centre[node]], axis=1).max() <= tree.radius[node]


def test_search_prunes_clusters_and_is_exact():
    rng = np.random.default_rng(3)
    points = (rng.normal(size=(20, 16))[rng.integers(0, 20, 2_000)] * 500 + rng.normal(size=(2_000, 16)) * 5).astype("<i8")
    tree = cover_tree.build(points, np.arange(2_000), np.arange(2_000))
    few = cover_tree.build(points[:400], np.arange(400), np.arange(400), pooled=8)
    best = cover_tree.Best(few, 5)
    made = cover_tree.search_block(best, tree, chunk=64)
    assert made < 400 * 2_000 / 4
    # once k-th scores are known, pairs fall at inner nodes, long before leaves meet
    assert len(cover_tree.meeting_leaves(best, tree)[0]) < (few.children == 0).sum() * (tree.children == 0).sum() / 4
    scores = points[:400] @ points.T
    for row, i in enumerate(few.ids):
        want = sorted((-s, j) for j, s in enumerate(scores[i]) if j != i)[:5]
        assert [(-s, j) for s, j in zip(best.score[row], best.id[row])] == want


@pytest.mark.parametrize("block", [16, 4_096])
def test_search_matches_brute_force_with_odd_rows(spark, block):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(150)]
    rows += [(20, [1.0] * 6), (20, [1.0] * 6), (3, [1.0] * 6), (None, [1.0] * 6), (40, None), (41, [1.0, None]), (60, [float("nan")] * 6), (61, [float("inf")]), (80, [2.0]), (100, []), (120, [1e9, -1e9])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, row int, block string, kind int")
    from pyspark.sql import functions as F

    got = sorted(tuple(r) for r in cover_tree.search(df, F.col("vec_id") % 20 == 0, 7, block_rows=block).collect())
    assert got == brute(rows, 7, lambda i: i % 20 == 0)
    assert cover_tree.search(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
    few = cover_tree.search(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_dropped_pairs_cannot_better_a_score():
    rng = np.random.default_rng(8)
    points = (rng.normal(size=(8, 5))[rng.integers(0, 8, 300)] * 90 + rng.normal(size=(300, 5)) * 9).astype("<i8")
    data, asked = cover_tree.build(points, np.arange(300), np.arange(300), leaf=4), cover_tree.build(points[:60], np.arange(60), np.arange(60), leaf=4, pooled=2)
    every = [(q, d) for q in range(len(asked.radius)) for d in range(len(data.radius))]
    bound = cover_tree.most(asked, np.array([q for q, _ in every]), data, np.array([d for _, d in every]))
    for (q, d), b in list(zip(every, bound))[::7]:
        assert (asked.points[members(asked, q)] @ data.points[members(data, d)].T).max() <= b
    best = cover_tree.Best(asked, 3)
    best.score[:] = (asked.points @ points.T).max() // 2
    qs, ds, _ = cover_tree.meeting_leaves(best, data)
    kept = set(zip(qs.tolist(), ds.tolist()))
    for q in np.flatnonzero(asked.children == 0):
        for d in np.flatnonzero(data.children == 0):
            if (asked.points[members(asked, q)] @ data.points[members(data, d)].T).max() >= best.score[0, 0]:
                assert (q, d) in kept


def test_large_scores_are_exact_and_then_held(spark):
    from pyspark.sql import functions as F

    rows = [(0, [2.0**24, 1.0]), (1, [2.0**25, 1.0]), (2, [2.0**25, 3.0]), (3, [2.0**25, 2.0]), (4, [1e30, 0.0]), (5, [-1e30, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in cover_tree.search(df, F.col("vec_id") == 0, 9).orderBy("rank").collect()]
    one = 2**30 * 2**31
    assert got == [(4, 2**63 - 1), (2, one + 3 * 64 * 64), (3, one + 2 * 64 * 64), (1, one + 64 * 64), (5, cover_tree.NOTHING + 1)]


def test_search_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = sorted(con.sql(queries.oracle_sql()["op5_cover_tree"]).fetchall())
    assert sorted(tuple(r) for r in queries.op5_cover_tree(spark, sf).select("query_id", "rank", "vec_id", "score").collect()) == want
