"""Queries against their SQL on the smallest tables, as the driver compares them."""

import duckdb
import pandas as pd
import pytest

from kinmap.plans import catalog, graph_queries, kernel_queries, more_queries, state_queries, table_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
GRAPH = ["j13_all_pairs_cosine", "w02_bh_qvalues", "w04_score_percentile", "w09_independent_bh", "t02_union_topk", "f06_same_tissue", "f06_different_disease", "f01_and_or_not", "j18_snapshot_diff", "c11_facets", "r01_delta_scoring", "t03_zoom_backbone"]
LIGHT = [n for n in more_queries.S if n not in ("s32_published_loader", "s34_release_import", "f10_query_page", "j16_member_edges", "w03_bh_by_family", "a15_selection_summary", "f17_discovery_query", "g11_dataset_detail")]
NAMES = [*table_queries.S, *kernel_queries.S, *LIGHT, *[n for n in state_queries.S if n not in ("k06_edge_tsv", "d08_text_release")], *GRAPH]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (not hasattr(value, "__len__") and pd.isna(value)):
        return None
    kind = type(value).__name__
    return float(value) if "float" in kind else bool(value) if "bool" in kind else int(value) if "int" in kind else str(value)


def rows(frame: pd.DataFrame):
    names = sorted(frame.columns)
    return names, sorted((tuple(map(plain, r)) for r in frame[names].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, sf, name):
    got = rows(catalog.queries()[name](spark, sf).toPandas())
    assert got == rows(duck.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", [n for n in kernel_queries.Q if n not in kernel_queries.S and n not in ("g01_communities", "m10_null_bank", "m11_null_profiles")])
def test_kernel_query_runs(spark, sf, name):
    assert kernel_queries.Q[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_score_kernel_equals_its_sql_form(spark, sf):
    a = {(r["a"], r["b"]): r["score"] for r in kernel_queries.m07_signature_scores(spark, sf).collect()}
    b = {(r["a"], r["b"]): r["score"] for r in kernel_queries.m04_score_by_sql(spark, sf).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-5 for k in a)


def test_flagship_is_ordered(spark, sf):
    out = [(r["q"], r["score"], r["a"], r["b"]) for r in graph_queries.flagship(spark, sf).collect()]
    assert out == sorted(out)
