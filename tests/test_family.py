"""Families whose pairs are made anew, against the written table and against their SQL."""

import math

import numpy as np
import pytest
from test_twins import duck, rows  # noqa: F401  a fixture

from kinmap.operators import family
from kinmap.plans import catalog, frames

CHANGED = "a15_selection_summary w09_independent_bh t02_union_topk g08_graph_payload g09_overview_links g10_neighbourhood_nodes g11_dataset_detail j01_endpoint_enrichment j02_optional_evidence k06_edge_tsv f03_independence f05_platform_same f06_same_tissue w02_bh_qvalues w04_score_percentile".split()


@pytest.fixture
def anew(monkeypatch):
    monkeypatch.setattr(frames, "WRITTEN", 0)


@pytest.mark.parametrize("name", CHANGED)
def test_query_on_pairs_made_anew_equals_its_sql(spark, duck, sf, anew, name):  # noqa: F811
    assert frames.release(spark, sf).table is None
    assert rows(catalog.queries()[name](spark, sf).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", [n for n in CHANGED if n[0] in "agjk"])
def test_query_on_the_written_release_equals_its_sql(spark, duck, sf, name):  # noqa: F811
    assert frames.release(spark, sf).table is not None
    assert rows(catalog.queries()[name](spark, sf).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_normal_tail_to_double_precision():
    z = np.concatenate([np.random.default_rng(1).normal(size=20_000) * 2, [-9, -7, 0, 7, 9]])
    exact = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])
    assert np.abs(family.normal_cdf(z) - exact).max() < 2e-12 and np.abs(family.normal_cdf(z[:20_000]) - exact[:20_000])[np.abs(z[:20_000]) < 7].max() < 4e-16


def test_numbers_by_bytes():
    for values in ([], [0, 254, 255, 510, 7], [3_000_000_000, 1], [2_000_000, 5], [0] * 9):
        values = np.array(values, "<i8")
        assert family.decoded(family.encoded(values)).tolist() == values.tolist()


def _folder(spark, path, vectors):
    data = [(i, 0, [float(x) for x in v]) for i, v in enumerate(vectors)]
    spark.createDataFrame(data, "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def _pairs(rows):
    return {(r["a"], r["b"]): tuple(r[c] for c in family.COLUMNS[2:]) for r in rows.collect()}


@pytest.mark.parametrize("kind", ["near copies", "one vector", "two vectors"])
def test_family_equals_the_written_table(spark, tmp_path, anew, monkeypatch, kind):
    monkeypatch.setattr(frames.pair_ops, "TILE", 16)
    rng = np.random.default_rng(5)
    near = np.repeat(rng.normal(size=(9, 8)), 8, axis=0) + rng.normal(size=(72, 8)) * np.repeat([0, 0.1, 0.4], 24)[:, None]
    path = _folder(spark, tmp_path, {"near copies": near, "one vector": [near[0]] * 40, "two vectors": near[:2]}[kind])
    held = frames.release(spark, path)
    assert held.table is None
    assert _pairs(held.family.pairs()) == _pairs(frames._calibrated_table(spark, path))


def test_ties_at_the_edge_go_by_id(spark, tmp_path, anew):
    path = _folder(spark, tmp_path, [[1.0, 2.0]] * 40)
    out = frames.foremost(spark, path, 3, ("a", "b", "q", "score")).select("a", "b")
    got = {i: sorted(r["a"] + r["b"] - i for r in out.collect() if i in (r["a"], r["b"]))[:3] for i in range(40)}
    assert got == {i: [j for j in range(40) if j != i][:3] for i in range(40)}


def test_what_a_family_cannot_tell_is_written(spark, tmp_path, anew, monkeypatch):
    path = _folder(spark, tmp_path, np.append(np.random.default_rng(2).normal(size=(30, 4)), [[math.nan] * 4], axis=0))
    held = frames.release(spark, path)
    assert held.family is None and held.table.count() == 31 * 15
    monkeypatch.setattr(family, "STEPS", 1)
    path = _folder(spark, tmp_path / "more", np.repeat(np.random.default_rng(2).normal(size=(9, 4)), 4, axis=0))
    held = frames.release(spark, path)
    assert held.family is None and held.table.count() == 36 * 35 // 2
