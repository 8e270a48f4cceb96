import itertools
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmap.functions import facets, ids, stats
from kinmap.functions.lineage import cut
from kinmap.operators import annotate, graph, layout, matrix, overlap, pairs, query, release, signature
from kinmap.plans import kernel_queries, more_queries, table_queries
from kinmap.sources import sinks, text
from kinmap.streaming import delta


# --- statistics -----------------------------------------------------------------------------------------------------


def test_erf(spark):
    xs = [float(x) for x in np.concatenate([np.linspace(-7, 7, 400), [0.0, 0.46875, -0.46875, 4.0, 4.0001, 30.0, -30.0]])]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(stats.erf(F.col("x"))).collect()]
    assert max(abs(g - math.erf(x)) for g, x in zip(got, xs)) < 2e-15


def bh(p):
    n, out, least = len(p), [0.0] * len(p), 1.0
    for rank, i in sorted(enumerate(sorted(range(n), key=lambda i: p[i]), 1), reverse=True):
        least = min(least, p[i] * n / rank)
        out[i] = least
    return out


def test_benjamini_hochberg(spark):
    rng = random.Random(1)
    for p in ([0.01, 0.04, 0.03], [0.0, 0.0, 1.0, 0.5], [rng.random() ** 3 for _ in range(300)] + [0.2] * 40, [1e-12, 1e-300, 0.9]):
        df = stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", "q")
        assert np.allclose([r["q"] for r in df.orderBy("i").collect()], bh(p), rtol=1e-12, atol=0)
    df = spark.createDataFrame([("x", 0.01), ("x", 0.02), ("y", 0.02), ("y", None), (None, 0.5)], "k string, p double")
    got = {(r["k"], r["p"]): r["q"] for r in stats.benjamini_hochberg(df, "p", "q", by=("k",)).collect()}
    assert got == {("x", 0.01): 0.02, ("x", 0.02): 0.02, ("y", 0.02): 0.02, ("y", None): None, (None, 0.5): 0.5}


def test_cumulative_share(spark):
    values = [3.0, 1.0, 1.0, 2.0, 5.0, 5.0, 5.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    for descending in (False, True):
        got = {r["i"]: r["s"] for r in stats.cumulative_share(df, "v", "s", descending, bins=3).collect()}
        want = {i: sum((w >= v) if descending else (w <= v) for w in values) / len(values) for i, v in enumerate(values)}
        assert got == pytest.approx(want)
    assert stats.cumulative_share(df.filter("false"), "v", "s").count() == 0


def test_upper_median_and_interpolation(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0, 4.0],), ([],), ([2.0],)], "v array<double>")
    assert [r[0] for r in df.select(stats.upper_median(F.col("v"))).collect()] == [3.0, math.inf, 2.0]
    grid, values = [5.0, 20.0, 100.0], [1.0, 2.0, 0.0]
    xs = [0.0, 5.0, 7.0, 20.0, 60.0, 100.0, 200.0]
    df = spark.createDataFrame([(x, grid, values) for x in xs], "x double, g array<double>, y array<double>")
    assert [r[0] for r in df.select(stats.interpolate(F.col("x"), F.col("g"), F.col("y"))).collect()] == pytest.approx(np.interp(xs, grid, values).tolist())


def test_hypergeometric_tail(spark):
    logs = [math.lgamma(i + 1) for i in range(31)]
    cases = [(k, 30, m, d) for k, m, d in itertools.product((0, 1, 3, 9), (2, 10, 30), (0, 5, 12))]
    df = spark.createDataFrame([(*c, logs) for c in cases], "k int, n int, m int, d int, l array<double>")
    got = [r[0] for r in df.select(stats.hypergeometric_tail(F.col("k"), F.col("n"), F.col("m"), F.col("d"), F.col("l"))).collect()]
    want = [sum(math.comb(m, i) * math.comb(n - m, d - i) for i in range(k, min(m, d) + 1) if d - i <= n - m) / math.comb(n, d) for k, n, m, d in cases]
    assert got == pytest.approx(want, abs=1e-9)


# --- identity, facets, export ---------------------------------------------------------------------------------------


def test_ids(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(ids.stable_id("p", F.lit("a"), F.lit(None))) != value(ids.stable_id("p", F.lit("a")))
    assert value(ids.accession_bucket(F.lit("GSE1234"))) == "GSE1nnn" and value(ids.accession_bucket(F.lit("GSE12"))) == "GSEnnn"
    assert value(ids.dataset_from_file(F.lit("/x/gse77_RAW.tar"))) == "GSE77" and value(ids.dataset_from_file(F.lit("a/my_RAW.tsv"))) == "MY"
    assert [value(ids.csv_cell(F.lit(x))) for x in ("=a", " +1", "a\"b", "\tx", "x", None)] == ["\"'=a\"", "\"' +1\"", '"a""b"', "\"'\tx\"", '"x"', '""']
    with pytest.raises(Exception):
        value(ids.ordered_pair(F.lit("a"), F.lit("a"))[0])


def test_facets(spark):
    tissue = {"bone marrow": "Blood & immune", "Liver / lung": "Mixed anatomical systems", "cell line; unknown": "Cell culture / in vitro", "tumour biopsy": "Mixed / unspecified", "fin": "Other anatomy", "": "Mixed / unspecified"}
    disease = {"breast cancer": "Neoplastic", "healthy; asthma": "Respiratory", "healthy": "Reference / no disease", "lupus; flu virus": "Mixed disease families", "odd": "Other / unclassified", "not reviewed": "Unreviewed", "": "Unreviewed"}
    for table, f in ((tissue, facets.tissue_system), (disease, facets.disease_family)):
        df = spark.createDataFrame([(k,) for k in table], "x string")
        assert {r["x"]: r["f"] for r in df.select("x", f(F.col("x")).alias("f")).collect()} == table


@given(st.dictionaries(st.text(max_size=5), st.one_of(st.integers(), st.text(max_size=5), st.floats(allow_nan=False, allow_infinity=False)), max_size=5))
@settings(max_examples=50, deadline=None)
def test_canonical_json_is_stable(value):
    try:
        out = sinks.canonical_json(value)
    except ValueError:
        return
    assert sinks.canonical_json(json.loads(out)) == out
    assert sinks.canonical_json(dict(reversed(value.items()))) == out


def test_canonical_json_refuses():
    for bad in ({"a": float("nan")}, {"a": "x\0"}, {"e\u0301": 1, "\u00e9": 2}):
        with pytest.raises(ValueError):
            sinks.canonical_json(bad)
    assert sinks.canonical_json({"b": -0.0, "a": [1, "é"]}) == '{"a":[1,"é"],"b":0.0}'


def test_bundles(tmp_path):
    address = sinks.commit_bundle(tmp_path, {"kind": "x"}, {"a/b.txt": b"1", "c": b"2"})
    assert sinks.commit_bundle(tmp_path, {"kind": "x"}, {"c": b"2", "a/b.txt": b"1"}) == address
    assert sinks.check_bundle(tmp_path, address) == []
    folder = tmp_path / "objects" / "sha256" / address[:2] / address
    (folder / "c").write_bytes(b"3")
    (folder / "extra").write_bytes(b"")
    assert sinks.check_bundle(tmp_path, address) == ["c differs", "extra isn't named"]
    for name in ("/x", "../x", "a//b", "c:\\x", ""):
        with pytest.raises(ValueError):
            sinks.commit_bundle(tmp_path, {}, {name: b""})


def test_write_table_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.write_table(spark.range(3), path)
    sinks.write_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir() if "staging" in p.name] == []


# --- sources --------------------------------------------------------------------------------------------------------


def test_matrix_files(spark, tmp_path):
    (tmp_path / "gse9_x.csv").write_text("id,s1,s2\nf1,1,x\nf2,,2.5\n")
    (tmp_path / "other.tsv").write_text("id\tf1\tf2\ns1\t1\t\ns2\tx\t2.5\n")
    a = text.read_matrix(spark, str(tmp_path / "gse9_x.csv"))
    b = text.read_matrix(spark, str(tmp_path / "other.tsv"), features_by_samples=False)
    key = lambda df: sorted((r["sample"], r["feature"], repr(r["value"])) for r in df.collect())
    assert key(a) == key(b) == [("s1", "f1", "1.0"), ("s1", "f2", "nan"), ("s2", "f1", "nan"), ("s2", "f2", "2.5")]
    assert {r["dataset"] for r in a.collect()} == {"GSE9"} and {r["dataset"] for r in b.collect()} == {"OTHER"}
    assert text.separator("A.CSV.GZ") == "," and text.separator("a.txt") == "\t"
    assert text.expand([str(tmp_path / "*.csv"), "nothing*"]) == [str(tmp_path / "gse9_x.csv"), "nothing*"]


# --- graph and query ------------------------------------------------------------------------------------------------


def test_union_top_k_ignores_row_order(spark):
    rng = random.Random(2)
    rows = [(a, b, round(rng.random(), 3)) for a, b in itertools.combinations(range(12), 2)]
    order = [F.desc("w"), F.asc("a"), F.asc("b")]
    want = set()
    for node in range(12):
        mine = sorted((r for r in rows if node in r[:2]), key=lambda r: (-r[2], r[0], r[1]))
        want |= {r[:2] for r in mine[:2]}
    for _ in range(2):
        rng.shuffle(rows)
        out = graph.union_top_k(spark.createDataFrame(rows, "a int, b int, w double"), 2, order)
        assert {(r["a"], r["b"]) for r in out.collect()} == want


def test_query_contract(spark):
    nest = {"edge.q_value": {"lte": 1}}
    for _ in range(13):
        nest = {"not": nest}
    bad = [
        {}, {"a": 1, "b": 2}, {"and": []}, {"and": [{"edge.q_value": {"lte": 1}}] * 33}, nest, {"edge.q_value": {"lte": 2}}, {"edge.q_value": {"lte": True}}, {"edge.score": {"lte": float("nan")}},
        {"edge.q_value": {"like": 1}}, {"edge.independent": {"eq": 1}}, {"edge.overlap_classification": {"eq": "some"}}, {"node.sample_count": {"gte": -1}}, {"node.platform": {"same": 1}}, {"x'; drop": {"eq": 1}},
        {"node.tissue": {"eq": " "}}, {"or": [{"and": [{"edge.q_value": {"lte": 1}}] * 32}] * 3}, {"node.platform": {"eq": "x" * 21_000}},
    ]
    for ast in bad:
        with pytest.raises(query.QueryError):
            query.compile_query(ast)
    for key in query.UNAVAILABLE:
        with pytest.raises(query.UnsupportedQuery):
            query.compile_query({key: {"eq": 1}})
    with pytest.raises(query.UnsupportedQuery):
        query.compile_query({"node.tissue": {"same": True}})
    out = query.compile_query({"and": [{"edge.text_percentile": {"gt": 0.5}}, {"edge.independent": {"eq": True}}, {"all": True}]})
    assert out.leaves == 2 and out.uses_text and out.uses_independence
    assert query.compile_query({"edge.other": {"gt": 0.5}}, aliases={"edge.other": "edge.text_percentile"}).uses_text


def test_query_treats_input_as_values(spark):
    df = spark.createDataFrame([(1, 2, 0.1, 0.2, "P1", "P2")], "a int, b int, q double, score double, platform_a string, platform_b string")
    out = query.execute(df, query.compile_query({"node.platform": {"eq": "P1' OR '1'='1"}}))
    assert out.count() == 0
    assert query.execute(df, query.compile_query({"node.platform": {"eq": " P2 "}})).count() == 1
    for limit, offset in ((0, 0), (5_001, 0), (1, 100_001)):
        with pytest.raises(query.QueryError):
            query.execute(df, query.compile_query({"all": True}), limit, offset)


def test_separation_matches_all_pairs(spark):
    rng = np.random.default_rng(3)
    at = rng.random((60, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "id int, x double, y double")
    d = np.array([np.hypot(*(at[i] - at[j])) for i, j in itertools.combinations(range(60), 2)])
    out = graph.separation(df, "id", "x", "y", 0.1).first()
    assert (out["near_pairs"], out["severe_pairs"]) == (int((d < 0.1).sum()), int((d < 0.08).sum()))
    moved = layout.separate(df, 0.05).toPandas()
    p = moved[["x", "y"]].to_numpy()
    assert min(np.hypot(*(p[i] - p[j])) for i, j in itertools.combinations(range(60), 2)) >= 0.8 * 0.05


def test_communities_of_planted_blocks(spark):
    edges = [(a, b, 1.0) for block in (range(0, 8), range(8, 16)) for a, b in itertools.combinations(block, 2)] + [(0, 8, 0.1)]
    nodes = spark.createDataFrame([(i,) for i in range(17)], "id long")
    e = spark.createDataFrame(edges, "a long, b long, weight double")
    out = {r["id"]: r["community"] for r in layout.label_communities(nodes, e).collect()}
    assert len({out[i] for i in range(8)}) == len({out[i] for i in range(8, 16)}) == 1 and len(set(out.values())) == 3
    named = spark.createDataFrame(list(out.items()), "id long, community string")
    assert layout.modularity(named, e).first()["modularity"] > 0.45


# --- overlap, matrices, signatures ----------------------------------------------------------------------------------


def test_overlap_classes(spark):
    left = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "x"), (3, "y"), (3, "z"), (4, "a"), (4, "a"), (4, "b")]
    df = spark.createDataFrame(left, "d int, s string")
    sizes = df.groupBy(F.col("d").alias("id")).agg(F.count("*").alias("size"))
    out = {(r["a"], r["b"]): (r["shared"], r["class"]) for r in overlap.with_metrics(overlap.overlap_counts(df, "d", "s"), sizes).collect()}
    assert out == {(1, 2): (2, "exact"), (1, 3): (1, "major"), (1, 4): (2, "major"), (2, 3): (1, "major"), (2, 4): (2, "major"), (3, 4): (1, "minor")}


@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=20))
@settings(max_examples=200, deadline=None)
def test_matching_is_maximum(edges):
    edges = list(set(edges))

    def most(left, used):
        if not left:
            return 0
        x, *rest = left
        return max([most(rest, used), *(1 + most(rest, used | {y}) for a, y in edges if a == x and y not in used)])

    assert overlap._match(edges) == most(sorted({a for a, _ in edges}), frozenset())


def test_matched_samples_counts_each_once(spark):
    rows = [(1, 0, "g1", "h1"), (1, 1, "g2", "h1"), (2, 0, "g1", "h1"), (2, 1, None, "h1"), (3, 0, "g9", None)]
    df = spark.createDataFrame(rows, "dataset int, sample int, accession string, hash string")
    assert [(r["a"], r["b"], r["shared"]) for r in overlap.matched_samples(df, df).collect()] == [(1, 2, 2)]


def test_signature_invariants_and_distance():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 60)), rng.normal(size=(30, 60))
    (p, lp), (q, lq) = signature.fit(x), signature.fit(y)
    assert np.allclose(p.T @ p, np.eye(p.shape[1]), atol=1e-9) and np.isclose(lp.sum(), 0.5 * 60)
    z = signature.standardise(x, np.random.default_rng(0))
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    lam = s**2 / 39
    c = int(np.searchsorted(np.cumsum(lam), 30) + 1)
    assert p.shape[1] == c and np.allclose(np.abs(np.sum(p * vt[:c].T, axis=0)), 1, atol=1e-8)
    assert np.isclose(signature.distance(p, lp, q, lq, 0.5), signature.distance(q, lq, p, lp, 0.5)) and signature.distance(p, lp, p, lp, 0.5) < 1e-9
    assert signature.distance(p, lp, q, lq, 0.5) > 0
    flat = np.ones((5, 4))
    axes, lam = signature.fit(flat)
    assert np.isfinite(axes).all() and np.isclose(lam.sum(), 2.0)
    assert signature.size_grid(44, 59) == [40, 50, 75] and signature.size_grid(5, 500)[-1] == 560


def shared_on(p, lp, q, lq, chosen):
    """The objective, term by term."""
    return sum((lp[i] + lq[j]) * sum(p[r, i] * q[r, j] for r in chosen) ** 2 for i in range(len(lp)) for j in range(len(lq)))


@pytest.mark.parametrize("seed", range(4))
def test_best_features_are_the_best_subset(seed):
    rng = np.random.default_rng(seed)
    (p, lp), (q, lq) = signature.fit(rng.normal(size=(9, 14))), signature.fit(rng.normal(size=(9, 14)))
    whole = shared_on(p, lp, q, lq, range(14))
    assert np.isclose(signature.distance(p, lp, q, lq, 0.5), 14 - whole)
    for k in (1, 3, 4):
        every = {c: shared_on(p, lp, q, lq, c) for c in itertools.combinations(range(14), k)}
        best, value = signature.best_features(p, lp, q, lq, k, starts=8)
        worst, low = signature.best_features(p, lp, q, lq, k, largest=False, starts=8)
        assert np.isclose(value, every[tuple(sorted(best))]) and np.isclose(low, every[tuple(sorted(worst))])
        assert np.isclose(value, max(every.values())) and np.isclose(low, min(every.values()))
    assert sorted(signature.best_features(p, lp, q, lq, 99)[0]) == list(range(14))


def test_one_set_for_several_pairs_is_the_best_subset():
    rng = np.random.default_rng(11)
    sig = [signature.fit(rng.normal(size=(8, 12))) for _ in range(4)]
    pairs = [(*sig[0], *sig[1]), (*sig[0], *sig[2]), (*sig[1], *sig[3])]
    best, value = signature.best_set(signature.Structure(pairs), 3, starts=8)
    every = {c: sum(shared_on(*x, c) for x in pairs) for c in itertools.combinations(range(12), 3)}
    assert np.isclose(value, max(every.values())) and np.isclose(every[tuple(sorted(best))], value)


def small_signatures(spark, sizes=(9, 12, 15)):
    rng = np.random.default_rng(2)
    rows = [(d, i, [float(x) for x in rng.normal(size=6)]) for d, n in enumerate(sizes) for i in range(n)]
    table = spark.createDataFrame(rows, "d long, i int, v array<double>")
    return table, signature.signatures(table, "d", "v")


def matrices(sig):
    return {r["dataset"]: (np.asarray(r["loadings"]).T, np.asarray(r["weights"]), r["samples"]) for r in sig.collect()}


def test_block_scores_match_the_loop(spark, monkeypatch):
    _, sig = small_signatures(spark, (9, 12, 15, 7, 8))
    own = matrices(sig)
    for triangle in (True, False):
        got = {(r["a"], r["b"]): r["score"] for r in signature.scores(sig, sig, triangle).collect()}
        pairs = [(a, b) for a in own for b in own if a < b or not triangle]
        assert got.keys() == set(pairs)
        assert all(np.isclose(got[a, b], signature.distance(*own[a][:2], *own[b][:2], 0.5), atol=1e-9) for a, b in pairs)


def test_null_bank_and_profiles_match_the_loop(spark):
    table, sig = small_signatures(spark)
    bank = cut(signature.null_bank(table, "v", [5, 9], draws=6))
    held = {(r["size"], r["draw"]): (np.asarray(r["loadings"]).T, np.asarray(r["weights"])) for r in bank.collect()}
    assert held.keys() == {(n, b) for n in (5, 9) for b in range(6)}
    again = {(r["size"], r["draw"]): r["weights"] for r in signature.null_bank(table.repartition(5), "v", [9, 5], draws=6).collect()}
    assert all(np.allclose(again[k], held[k][1]) for k in held)
    far = signature.null_distances(sig, signature.packed_bank(bank, per_block=4), per_chunk=2)
    own = matrices(sig)
    got = {(r["dataset"], r["size"], r["draw"]): r["distance"] for r in far.collect()}
    assert got.keys() == {(d, *k) for d in own for k in held}
    assert all(np.isclose(v, signature.distance(*own[d][:2], *held[n, b], 0.5), atol=1e-9) for (d, n, b), v in got.items())
    profiles = {(r["dataset"], r["size"]): (r["mu"], r["sigma"]) for r in signature.null_profiles(sig, table, "v", [5, 9], draws=6).collect()}
    for (d, n), (mu, sigma) in profiles.items():
        v = [got[d, n, b] for b in range(6)]
        assert np.isclose(mu, np.mean(v)) and np.isclose(sigma, np.std(v))


def test_pairs_calibrate_at_the_other_size(spark):
    pairs = spark.createDataFrame([(1, 2, 3.0)], "a long, b long, score double")
    sizes = spark.createDataFrame([(1, 10), (2, 20)], "dataset long, samples int")
    profiles = spark.createDataFrame([(1, 10, 9.0, 1.0), (1, 20, 4.0, 2.0), (1, 30, 4.0, 2.0), (2, 5, 2.0, 1.0), (2, 10, 5.0, 4.0), (2, 15, 1.0, 1.0)], "dataset long, size int, mu double, sigma double")
    want = 0.5 * math.erfc(0.5 / math.sqrt(2))  # both z are -0.5
    for exact in (True, False):
        assert np.isclose(signature.calibrate_pairs(pairs, profiles, sizes, exact).first()["p"], want)
    with pytest.raises(Exception, match="no profile at size"):
        signature.calibrate_pairs(pairs, profiles.filter("size <> 20"), sizes, True).collect()
    with pytest.raises(Exception, match="outside the size grid"):
        signature.calibrate_pairs(pairs, profiles.filter("size < 20"), sizes, False).collect()


def test_explanations_replay_by_dependency(spark):
    from kinmap.operators import explanation

    _, sig = small_signatures(spark)
    sig = cut(sig)
    pairs = signature.scores(sig, sig).select("a", "b")
    first = explanation.replay(pairs, sig, None, k=2)
    assert first.filter("made").count() == 3
    other = sig.filter("dataset <> 2").unionByName(sig.filter("dataset = 2").withColumn("weights", F.transform("weights", lambda x: x * 2)))
    again = {(r["a"], r["b"]): r["made"] for r in explanation.replay(pairs, other, first, k=2).collect()}
    assert again == {(0, 1): False, (0, 2): True, (1, 2): True}
    assert explanation.replay(pairs, sig, first, k=3).filter("made").count() == 3


def test_matrix_quality(spark):
    nan = float("nan")
    rows = [("ok", s, f, float(s * f)) for s in range(3) for f in range(3)] + [("few", 0, 0, 1.0)] + [("flat", s, 0, 2.0) for s in range(3)] + [("holes", s, 0, nan if s else 1.0) for s in range(3)]
    df = spark.createDataFrame(rows, "dataset string, sample int, feature int, value double")
    assert {r["dataset"]: r["status"] for r in matrix.quality(df).collect()} == {"ok": "ok", "few": "too few samples", "flat": "no variance", "holes": "too many missing"}
    assert {r["value"] for r in matrix.impute(df.filter("dataset = 'holes'")).collect()} == {1.0}
    z = [r["value"] for r in matrix.standardise(df.filter("dataset = 'ok' and feature = 1")).collect()]
    assert np.isclose(np.mean(z), 0) and np.isclose(np.std(z, ddof=1), 1)


def test_all_pairs_and_delta(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 7)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 5))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j): unit[i] @ unit[j] for i, j in itertools.combinations(range(40), 2)}
    got = {(r["a"], r["b"]): r["value"] for r in pairs.all_pairs(df, "id", "v").collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    new = {(r["a"], r["b"]) for r in pairs.delta_pairs(df.filter("id >= 30"), df.filter("id < 30"), "id", "v").collect()}
    assert new == {k for k in want if k[1] >= 30}


# --- evidence and releases ------------------------------------------------------------------------------------------


def test_grounding(spark):
    df = spark.createDataFrame([("abc Abc abc", 9, "abc"), ("abc Abc abc", 8, "abc"), ("xx ABC", 0, "abc"), ("xx", 0, "abc"), ("", 0, "a")], "s string, at int, q string")
    assert [r[0] for r in df.select(annotate.ground(F.col("s"), F.col("at"), F.col("q"))).collect()] == [8, 8, 3, None, None]


def nearest_by_brute_force(text, at, wanted):
    for t, w in ((text, wanted), (text.lower(), wanted.lower())):
        if places := [(abs(i - at), i) for i in range(len(t)) if t.startswith(w, i)]:
            return min(places)[1]
    return None


def test_grounding_matches_brute_force_and_covers_every_document(spark, sf):
    rng = random.Random(5)
    rows = [("".join(rng.choices("aAb", k=rng.randint(0, 12))), rng.randint(0, 14), "".join(rng.choices("aAb", k=rng.randint(1, 3)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "s string, at int, q string")
    assert [r[0] for r in df.select(annotate.ground(F.col("s"), F.col("at"), F.col("q"))).collect()] == [nearest_by_brute_force(*r) for r in rows]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r["start"] for r in more_queries.Q["n04_span_grounding"](spark, sf).collect()}
    assert got == {k: nearest_by_brute_force(t, 15, t[19:27].lower()) if t[19:27] else 15 if t is not None else None for k, t in docs.items()}


def test_null_profiles_bracket_the_sample_counts(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, [float(x) for x in rng.normal(size=4)]) for i in range(180)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    sizes = {r["size"] for r in kernel_queries.m11_null_profiles(spark, str(tmp_path)).collect()}
    assert min(sizes) <= 90 <= max(sizes)
    df = spark.createDataFrame([([20.0, 60.0], 90), ([75.0, 100.0], 90)], "g array<double>, n int")
    assert df.filter("g[0] = 75").select(signature.covering(F.col("g"), F.col("n"))).first()[0] == [75.0, 100.0]
    with pytest.raises(Exception, match="outside the size grid"):
        df.select(signature.covering(F.col("g"), F.col("n"))).collect()


def test_metric_and_matching_take_every_row(spark, sf, tmp_path):
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert more_queries.x01_pluggable_metric(spark, sf).count() == n * (n - 1) // 2
    rows = [(1, 5, 30, 1), (1, 5, 40, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in table_queries.j10_sample_matching(spark, str(tmp_path)).select("a", "b", "shared").collect()] == [(30, 40, 1)]


def test_state_changes(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, v string, d double")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k int, v string")
    assert sorted(tuple(r) for r in release.insert_ignore(old, new, ["k"], [F.asc("v")]).collect()) == [(3, "d")]
    assert sorted(map(str, (tuple(r) for r in release.upsert(old, new.filter("v <> 'e'"), ["k"], [F.asc("v")], reset=("d",)).collect()))) == ["(1, 'a', 1.0)", "(2, 'c', None)", "(3, 'd', None)"]


# --- streaming ------------------------------------------------------------------------------------------------------


def test_stream_scores_each_pair_once(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(12)]
    source, state, sink, mark = (str(tmp_path / n) for n in ("in", "state", "out", "mark"))
    schema = "vec_id long, embedding array<double>"
    for part in (rows[:5], rows[5:9]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    delta.stream_vectors(spark, source, state, sink, mark).awaitTermination()
    spark.createDataFrame([*rows[9:], rows[0]], schema).coalesce(1).write.mode("append").parquet(source)
    delta.stream_vectors(spark, source, state, sink, mark).awaitTermination()
    got = sorted((r["a"], r["b"]) for r in spark.read.option("recursiveFileLookup", True).parquet(sink).collect())
    assert got == sorted(itertools.combinations(range(12), 2))


def test_windows_agree_between_batch_and_stream(spark, tmp_path, sf):
    source = str(tmp_path / "events")
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(source)
    make = lambda df: delta.windowed(df, "ts", "1 day", None, "60 days", ["event_type"], "value")
    out = delta.replay(spark, source, make, "windows", str(tmp_path / "mark"))
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert key(out) == key(make(events))


def test_ranked_equals_one_window(spark):
    rng = random.Random(8)
    rows = [(rng.choice([0.0, 0.25, rng.random()]), i) for i in range(500)]
    out = {r["i"]: r["n"] for r in stats.ranked(spark.createDataFrame(rows, "v double, i int"), "v", ["i"], "n", bins=7).collect()}
    assert out == {i: n for n, (_, i) in enumerate(sorted(rows), 1)}
    assert stats.ranked(spark.createDataFrame([], "v double"), "v", [], "n").count() == 0


def test_alignment_keeps_the_cell_stored_first(spark, tmp_path, sf):
    import duckdb

    rows = spark.createDataFrame([(7, 2, 3, 1, q) for q in (1.0, 2.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    path = tmp_path / "lineitem.parquet"
    path.mkdir()
    # the second file is the larger, so it is read first
    more = spark.range(20_000).selectExpr("id + 100 as l_orderkey", "2l as l_partkey", "3l as l_suppkey", "1 as l_linenumber", "rand(1) as l_quantity")
    for name, part in (("a", rows.filter("l_quantity = 2")), ("b", rows.filter("l_quantity = 1").union(more))):
        part.toPandas().to_parquet(path / f"{name}.parquet", index=False)
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create view lineitem as select * from '{path}/*.parquet'")
    want = con.execute("select value from (" + table_queries.S["f21_alignment"] + ") where sample = 7 and feature = 2").fetchall()
    got = table_queries.Q["f21_alignment"](spark, str(tmp_path)).filter("sample = 7 and feature = 2").collect()
    assert [r["value"] for r in got] == [v for (v,) in want] == [2.0]


def test_alignment_passes_over_cells_without_a_value(spark):
    cells = spark.createDataFrame([(1, 1, 5, 1, None), (1, 1, 5, 2, 4.0)], "dataset int, sample int, feature long, row int, value double")
    out = matrix.align(cells, spark.createDataFrame([(5,), (6,)], "feature long")).collect()
    assert {r["feature"]: r["value"] for r in out} == {5: 4.0, 6: None}


def test_signatures_of_many_samples_by_moments(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = {d: rng.normal(size=(n, 6)) @ rng.normal(size=(6, 6)) + 1000 * rng.normal(size=6) for d, n in ((1, 300), (2, 40), (3, 4))}
    x[4] = np.concatenate([x[1][:50], np.full((50, 1), 3.0)], axis=1)[:, 1:]  # a flat feature
    x[5] = x[1][:60].copy()
    x[5][3, 2] = np.nan
    rows = spark.createDataFrame([(d, r.tolist()) for d, m in x.items() for r in m], "d int, v array<double>").repartition(5)
    got = {r["dataset"]: r for r in signature.signatures(rows, "d", "v").collect()}
    assert sorted(got) == sorted(x)
    for d, m in x.items():
        axes, weights = signature.fit(np.asarray(sorted(map(tuple, m))), 0.5, signature.seed_of(d))
        assert got[d]["samples"] == len(m) and np.allclose(got[d]["weights"], weights, atol=1e-6)
        assert d == 4 or np.allclose(np.abs(np.asarray(got[d]["loadings"]) @ axes), np.eye(len(weights)), atol=1e-6)
    sizes, solve = [], np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda m: sizes.append(len(m)) or solve(m))
    signature.fit(x[1])
    assert sizes == [6]


def test_null_bank_of_large_draws_equals_their_rows(spark):
    from pyspark.sql import Window

    rng = np.random.default_rng(12)
    pool = (rng.normal(size=(90, 5)) + [0, 1, 100, 1e4, 0]).tolist()
    table = spark.createDataFrame([(v,) for v in pool], "v array<double>")
    bank = {(r["size"], r["draw"]): r for r in signature.null_bank(table, "v", [3, 40, 130], draws=4).collect()}
    assert len(bank) == 12
    hashed = table.withColumn("h", F.xxhash64("v").cast("double")).withColumn("n", F.row_number().over(Window.orderBy("h", "v")))
    own = {r["n"]: r["v"] for r in hashed.collect()}
    places = spark.range(130).select(F.explode(F.array(*[F.lit(x) for x in (3, 40, 130)])).alias("size"), F.col("id").cast("int").alias("place")).filter("place < size")
    places = places.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("n", F.pmod(F.xxhash64("size", "draw", "place", F.lit(7)), F.lit(90)) + 1)
    drawn = {}
    for r in places.orderBy("place").collect():
        drawn.setdefault((r["size"], r["draw"]), []).append(own[r["n"]])
    for key, rows in drawn.items():
        axes, weights = signature.fit(np.asarray(rows), 0.5, 7)
        assert np.allclose(bank[key]["weights"], weights) and np.allclose(np.abs(np.asarray(bank[key]["loadings"]) @ axes), np.eye(len(weights)), atol=1e-6)


def test_pairs_are_dealt_by_few_blocks_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=4).tolist() for i in range(60)}
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<double>")
    monkeypatch.setattr(pairs, "TILE", 3)
    monkeypatch.setattr(pairs, "BLOCK", 20)
    monkeypatch.setattr(pairs, "FEW", 2)
    assert pairs.blocks(df, "id", "v").count() <= 3  # not one for each tile
    got = {(r["a"], r["b"]): r["value"] for r in pairs.all_pairs(df, "id", "v").collect()}
    assert sorted(got) == sorted(itertools.combinations(range(60), 2))
    counts = {r["units"]: r["n"] for r in pairs.counted(df, "id", "v", 2).collect()}
    rounded = spark.createDataFrame([(v,) for v in got.values()], "v double").groupBy(F.round(F.round("v", 2) * 100).cast("long").alias("u")).count()
    assert counts == {r["u"]: r["count"] for r in rounded.collect()}


@given(st.lists(st.one_of(st.floats(-2, 2), st.integers(-2_000_000, 2_000_000).map(lambda k: (k + 0.5) / 1e6)), min_size=1, max_size=30))
@settings(max_examples=200, deadline=None)
def test_units_are_sql_rounding(values):
    from decimal import ROUND_HALF_UP, Decimal

    want = [int(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP).scaleb(6)) for v in values]
    assert pairs.units(np.asarray(values), 6).tolist() == want


def test_upper_median_writes_no_pairs(spark, sf, monkeypatch):
    from kinmap.plans import frames, graph_queries

    def never(*_):
        raise AssertionError("the median of scores needs no calibrated release")

    for where in (frames, graph_queries):
        monkeypatch.setattr(where, "calibrated", never)
    got = graph_queries.Q["a16_upper_median"](spark, sf).collect()
    scores = sorted(r["score"] for r in frames.text_pairs(spark, sf).select("score").collect())
    assert [r["upper_median"] for r in got] == [scores[len(scores) // 2]]


def test_upper_median_of_counts(spark):
    rng = random.Random(3)
    counts = {rng.randrange(-3000, 3000): rng.randrange(1, 9) for _ in range(200)}
    every = sorted(v for v, n in counts.items() for _ in range(n))
    df = spark.createDataFrame(list(counts.items()), "v long, n long")
    assert [r["v"] for r in stats.upper_median_of_counts(df, "v", "n", width=50).collect()] == [every[len(every) // 2]]
    assert [r["v"] for r in stats.upper_median_of_counts(df.filter("false"), "v", "n").collect()] == [None]
