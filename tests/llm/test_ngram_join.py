import random
import re

import numpy as np
import pyarrow as pa
import pytest

from kinmap.llm import ngram_join, queries
from kinmap.llm.common import Scratch
from kinmap.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = WORD.findall(low)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    by = {}
    for i, s in enumerate(sets):
        for m in s:
            by.setdefault(m, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for m in s for j in by[m] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * len(s | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None and (least.get(r) is None or doc < least[r]):
            least[r] = doc
        least.setdefault(r, None)
    return sorted(((str(doc), len(s), least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, 3, "x") for d, t in rows], "doc_id long, text string, doc_no int, component int, node int, hub string")


def result(df):
    return sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeÉé", k=rng.randint(1, 5))) for _ in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = prose(40)
    texts = []
    for _ in range(25):
        base = prose(rng.randint(30, 200))
        texts.append(base)
        for _ in range(rng.randint(0, 6)):  # chains of edits, some on either side of the threshold
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(base)
    texts += [prose(30) + passage + prose(30) for _ in range(30)] + [passage + prose(k) for k in range(12)] + [prose(3), prose(4), ["a"], ["a"], ["A", "b"], ["a", "b"]]
    texts = [rng.choice([" ", "\n", "\t "]).join(t) for t in texts] + ["", None, " \n", "\x0b\x0c"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = corpus(seed)
    assert result(ngram_join.join(frame(spark, rows).repartition(5))) == brute(rows)


def test_long_prefixes_and_shares_lose_nothing(spark, monkeypatch):
    rows = corpus(3)
    for partners in (0.0, 5.0):
        monkeypatch.setattr(ngram_join, "PARTNERS", partners)
        assert result(ngram_join.join(frame(spark, rows))) == brute(rows)


def test_long_lists_in_parts_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST_PART", 3)
    rows = corpus(4)
    assert result(ngram_join.join(frame(spark, rows))) == brute(rows)


def test_pairs_of_a_list_in_parts_are_those_of_the_whole_list():
    rng = np.random.default_rng(5)
    n = 40
    apart, part = np.sort(rng.integers(0, 9, n)), rng.integers(0, 4, n)
    ones = np.ones(n, np.int64)

    def pairs(i, j):
        own = (part == i) | (part == j)
        arrays = [7 * ones, i * ones, j * ones, apart, np.arange(n), ones, ones, ones, 0 * ones, part]
        batch = pa.RecordBatch.from_arrays([pa.array(a[own]) for a in arrays], "list i j apart class ask n_members held at part".split())
        out = [b.to_pydict() for b in ngram_join._cross(iter([batch.slice(0, 3), batch.slice(3)]))]
        return [(a, b) for o in out for a, b in zip(o["a"], o["b"])]

    got = [p for i in range(4) for j in range(i, 4) for p in pairs(i, j)]
    assert sorted(got) == [(a, b) for a in range(n) for b in range(a + 1, n) if apart[a] != apart[b]]


def test_hub_with_many_near_copies(spark):
    rng = random.Random(9)
    base = [str(rng.random()) for _ in range(60)]
    rows = [(i, " ".join([*base[:55], *(str(i + 0.5) for _ in range(3))])) for i in range(1_000, 1_300)] + [(5, " ".join(base[:50]) + " tail")]
    out = result(ngram_join.join(frame(spark, rows)))
    assert {c for _, _, c in out} == {5} and out == brute(rows)


@pytest.mark.parametrize("big,block", [(4, 3), (4, 500), (64, 512)])
def test_units_of_near_copies_around_the_threshold(spark, monkeypatch, big, block):
    monkeypatch.setattr(ngram_join, "BIG", big)
    monkeypatch.setattr(ngram_join, "UNIT_BLOCK", block)
    rng = random.Random(block)
    rows = []
    for g in range(3):
        base = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        for i in range(40):
            text = list(base)
            for _ in range(rng.randint(0, 7)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**9)}"
            rows.append((g * 100 + i, " ".join(text)))
    assert result(ngram_join.join(frame(spark, rows).repartition(3))) == brute(rows)


def test_odd_rows(spark):
    t = "one two three four five six seven"
    rows = [(None, t), (3, t), (3, t), (3, "other words in this text here"), (None, "x"), (4, None), (4, None), (2, "one two three four five six seven".upper()), (9, "É x"), (8, "é x")]
    got = result(ngram_join.join(frame(spark, rows)))
    assert got == brute(rows)
    assert ngram_join.join(frame(spark, [])).count() == 0
    kept = sorted(str(r["doc_id"]) for r in ngram_join.representatives(frame(spark, rows)).collect())
    assert kept == ["2", "3", "4", "8", "9", "None"]
    assert ngram_join.representatives(frame(spark, rows)).columns == frame(spark, rows).columns


def test_prefix_principle():
    rng = np.random.default_rng(1)
    level = (rng.random(1 << ngram_join.SKETCH_BITS) < 0.2).astype(np.uint8) * 3
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 6)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
            (p, k), (q, m) = ngram_join.prefix(a, level), ngram_join.prefix(b, level)
            assert len(np.intersect1d(p, q)) >= min(k, m) > max(ngram_join.spare(len(a)), ngram_join.spare(len(b)))
            free = max(ngram_join.spare(len(a)), ngram_join.spare(len(b)))
            assert len(np.intersect1d(p, q)) - free >= ngram_join.in_common(np.array([len(a)]), np.array([len(b)]), k, m)[0] >= 1


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert out == {i: 0 for i in range(51)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(queries.op6_ngram_join(spark, sf)) == brute(docs)
