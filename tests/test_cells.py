"""What calibration sends of a family, and the first pairs of nodes, against whole sorts."""

import numpy as np
import pytest

from kinmap.operators import family, pairs
from kinmap.operators.family import Family


def _deviations(kind):
    rng = np.random.default_rng(3)
    return {
        "larger of two": (rng.normal(size=2_000_000) + np.abs(rng.normal(size=2_000_000)) * 0.05) / 1.0012,
        "with signal": np.concatenate([rng.normal(size=200_000) * 0.9, rng.normal(size=3_000) - 4]),
        "wide": rng.normal(size=200_000) * 1.2,
        "ends": np.concatenate([np.full(500, -9.0), rng.normal(size=200_000) + 0.1, np.full(50, 9.0)]),
        "one value": np.full(1_000, 0.3),
    }[kind]


@pytest.mark.parametrize("kind", ["larger of two", "with signal", "wide", "ends", "one value"])
def test_cells_hold_every_step_of_q(kind):
    z = _deviations(kind)
    p, cells = family._units(z), family.Cells(np.bincount(family._cell(z), minlength=family.CELLS))
    values, often = np.unique(p, return_counts=True)
    q = np.minimum(np.minimum.accumulate((values / 1e9 * len(p) / np.cumsum(often))[::-1])[::-1], 1)
    sent, often = np.unique(p[cells.sent[family._cell(z)]], return_counts=True)
    inside = cells.within(sent)
    rank, sent = np.cumsum(often)[inside] + cells.below(sent[inside]), sent[inside]
    raw = np.append(sent / 1e9 * cells.n / rank, 1.0)
    assert (np.minimum.accumulate(raw[::-1])[::-1][np.searchsorted(sent, values)] == q).all()
    assert kind != "larger of two" or cells.many < 0.05 * len(p)


def _rows(spark, vectors):
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(data, "id long, v array<double>").repartition(4)


@pytest.mark.parametrize("by_percentile", [True, False])
def test_first_pairs_of_nodes(spark, monkeypatch, by_percentile):
    monkeypatch.setattr(pairs, "FEW", 5)
    monkeypatch.setattr(pairs, "TILE", 40)  # several blocks
    rng = np.random.default_rng(5)
    vectors = np.concatenate([np.repeat(rng.normal(size=(6, 8)), 8, axis=0), rng.normal(size=(150, 8))])
    held = Family(_rows(spark, vectors), "id", "v")
    columns = ("a", "b", "q", "score", "percentile")
    order = lambda r: (-r[4] if by_percentile else 0, r[2], r[3], r[0], r[1])
    whole = sorted((tuple(r) for r in held.pairs(columns).collect()), key=order)
    got = [tuple(r) for r in held.first(3, columns, by_percentile=by_percentile).collect()]
    assert len(got) == len(set(got)) <= 3 * len(vectors)
    of = lambda rows, x: [r for r in sorted(rows, key=order) if x in r[:2]][:3]
    assert all(of(got, x) == of(whole, x) for x in range(len(vectors)))
