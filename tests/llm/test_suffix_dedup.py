import hashlib
import random

import numpy as np
import pytest

from kinmap.llm import queries, suffix_dedup


def brute(rows, length):
    """rows: (doc_id, bytes) in order."""
    seen, out = set(), []
    for doc, text in rows:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((doc, len(text), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(text, gone) if not g)).hexdigest()))
    return out


def test_anchors_cover_every_window_once_and_agree_on_equal_windows():
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in (0, 3, 20, 21, 400, 64)] + [b"a" * 200, b"ab" * 90]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    doc, place, lo, hi, h = suffix_dedup.anchors(data, offsets, 20, 7)
    got = {}
    for d, p, a, b in zip(doc, place, lo, hi):
        for i in range(a, b + 1):
            assert (d, i) not in got and i <= p <= i + 13
            got[d, i] = p - i
    assert len(got) == sum(max(0, len(t) - 19) for t in texts)
    by_text = {}
    for (d, i), offset in got.items():
        assert by_text.setdefault(data[i : i + 20].tobytes(), offset) == offset


def test_anchors_do_not_depend_on_segments(monkeypatch):
    rng = np.random.default_rng(6)
    data = rng.integers(97, 101, 5_000).astype(np.uint8)
    offsets = np.asarray([0, 900, 950, 4_000, 5_000])
    whole = suffix_dedup.anchors(data, offsets, 20, 7)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    assert all((a == b).all() for a, b in zip(whole, suffix_dedup.anchors(data, offsets, 20, 7)))


@pytest.mark.parametrize("runs", [1, 2, 3, 7, 16])
def test_loser_tree_merges_with_exact_prefix_lengths(runs):
    rng = random.Random(runs)
    words = [sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 40))) for _ in range(runs)]
    shares = [[suffix_dedup.common(a, b) for a, b in zip([b"", *w], w)] for w in words]
    source, lcp = suffix_dedup.merge_runs(list(zip(words, shares)))
    at, merged = [0] * (2 * runs), []
    for s in source:
        merged.append(words[s][at[s]])
        at[s] += 1
    assert merged == sorted(x for w in words for x in w)
    assert lcp == [suffix_dedup.common(a, b) for a, b in zip([b"", *merged], merged)]


def test_front_coding_round_trip():
    words = sorted([b"", b"a", b"ab\0", b"ab", b"abc", b"b" * 300])
    assert suffix_dedup.front_decode(*suffix_dedup.front_code(words)) == words


def rows_of(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, doc_no int, begin int, found string")


def result(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(df).collect())


@pytest.mark.parametrize("block", [1 << 24, 600])
def test_dedup_matches_brute_force_on_planted_cases(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(block)
    word = lambda: "".join(rng.choices("abcdeé\0", k=rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), prose(15)
    texts = [prose(rng.randint(0, 120)) for _ in range(30)]
    texts += [prose(20) + passage + prose(20) for _ in range(12)] + [passage] * 5 + [passage[:99], passage[:100], passage[3:140]]
    texts += ["".join(rng.choice([line, prose(9)]) for _ in range(8)) for _ in range(10)]
    texts += [texts[0] + texts[1], texts[0][:200] + "X" + texts[0][200:], "a" * 1_000, "ab" * 400, "b" + "a" * 130, "", texts[40] + texts[40]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = list(zip(order, texts))
    out = suffix_dedup.dedup(rows_of(spark, rows).repartition(4))
    assert result(out) == sorted(brute(sorted((d, t.encode()) for d, t in rows), 100))


def test_dedup_odd_rows(spark):
    long = " ".join(str(i * i) for i in range(200))
    rows = [(1, None), (2, ""), (None, long), (3, long), (5, long), (5, long), (5, "short"), (4, "x" + long)]
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digests(suffix_dedup.dedup(rows_of(spark, rows))).collect()}
    n = len(long)
    assert got == {(1, 0, 0), (2, 0, 0), (None, n, 0), (3, n, n), (5, n, n), (5, 5, 0), (4, n + 1, n)}
    assert suffix_dedup.dedup(rows_of(spark, rows)).count() == len(rows)
    assert suffix_dedup.dedup(rows_of(spark, [])).count() == 0


def test_dedup_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute(sorted((r["doc_id"], r["text"].encode()) for r in docs), 100)
    got = sorted(tuple(r) for r in queries.op10_suffix_dedup(spark, sf).collect())
    assert got == sorted(want) and sum(r[2] for r in want) > 0


def test_ranges_hold_one_sorted_array_one_after_another(spark):
    """The partitions' suffixes, in the order of the splitters, are sorted as a whole, and equal seeds are together."""
    from pyspark.sql import functions as F

    rng = random.Random(12)
    passages = ["".join(rng.choices("abcdef ", k=160)) for _ in range(40)]
    rows = [(i, "".join(rng.choices("abcdef ", k=50)) + passages[i % 40] + "".join(rng.choices("abcdef ", k=50))) for i in range(200)]
    texts = spark.createDataFrame(rows, "doc_no long, text string").withColumn("text", F.col("text").cast("binary"))
    n, length, seed = 6, 100, 36
    asked = texts.mapInArrow(suffix_dedup._ask(n, length, seed), suffix_dedup._BLOCK).repartitionById(n, "part")
    again = asked.mapInArrow(suffix_dedup._answer, suffix_dedup._ANSWER).groupBy("doc_no").agg(F.collect_set("rank").alias("ranks"), F.collect_set(F.when(F.col("run"), F.col("rank"))).alias("runs")).cache()
    cuts = suffix_dedup.splitters(texts, again, n, length, seed)
    assert cuts == sorted(set(cuts)) and 2 <= len(cuts) <= n - 1
    runs = texts.repartition(3).join(again, "doc_no").mapInArrow(suffix_dedup._send(cuts, length, seed), suffix_dedup._BLOCK).filter("kind = 0").collect()
    spread = {}
    for r in runs:
        shared, sizes, _, _, _, _, rests, _ = suffix_dedup._unpack(bytes(r["payload"]), "<u2", "<u2", "<u2", "<u2", "<i8", "<i8", "u1", "u1")
        own = suffix_dedup.front_decode(shared, sizes, rests.tobytes())
        assert own == sorted(own)
        spread.setdefault(r["part"], []).extend(own)
    assert len(spread) == len(cuts) + 1
    whole = [w for p in sorted(spread) for w in sorted(spread[p])]
    assert [w[:seed] for w in whole] == sorted(w[:seed] for w in whole)
    of_seed = {}
    for p, words in spread.items():
        for w in words:
            assert of_seed.setdefault(w[:seed], p) == p
