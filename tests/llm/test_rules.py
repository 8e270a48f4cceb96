import glob
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from kinmap.llm import importance_resampling, mcd_outliers, pfair_mixing, queries, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    words = WORD.findall(text or "")
    seen, lines, dup = Counter(zip(words, words[1:], words[2:])), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    covered = {k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_outlier_base_columns_match_brute_force(spark, sf):
    odd = [(1, None), (2, ""), (2, " \n\t"), (3, "a b c a b c a b c"), (4, "a\n a\na\n\na"), (5, "ä<b> #\x0b|\x0cx"), (None, "one two"), (6, "x " * 3000), (7, "\u00a0 a")]
    rows = spark.createDataFrame([(d, t, "en", None, 1, "z") for d, t in odd], "doc_id long, text string, lang string, source string, words int, g string")
    got = sorted((str(r["doc_id"]), *(r[c] for c in BASE)) for r in mcd_outliers.judge(rows).collect())
    assert got == sorted((str(d), *brute_base(t)) for d, t in odd)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_mcd_outliers(spark, sf).collect():
        assert tuple(r[c] for c in BASE) == brute_base(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    assert mcd_outliers.judge(rows.filter("false")).count() == 0


def test_outliers_reject_junk_and_keep_clean(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    out = [(labels[r["doc_id"]], r["kept"], r["base_failed"]) for r in queries.op1_mcd_outliers(spark, d).collect() if r["doc_id"] in labels]
    assert np.mean([k for q, k, b in out if q == 1 and not b]) > 0.99
    assert np.mean([k for q, k, b in out if q == 0]) < 0.1


@pytest.mark.parametrize("copies", [True, False])
def test_outliers_reject_a_third_of_junk(spark, copies):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(2_000)]

    def prose(n, symbols=0, repeats=0):
        w = list(rng.choice(words, n))
        for i in rng.choice(n, symbols, replace=False):
            w[i] += "#"
        return " ".join(w) + "\none and the same line again" * repeats

    junk = [prose(300, 60, 8) for _ in range(200)]
    rows = [(i, prose(int(rng.lognormal(5.5, 0.4)) + 60)) for i in range(400)] + [(1_000 + i, junk[0] if copies else t) for i, t in enumerate(junk)]
    out = mcd_outliers.judge(spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")).collect()
    assert not any(r["base_failed"] for r in out)
    assert np.mean([r["kept"] for r in out if r["doc_id"] >= 1_000]) < 0.01
    assert np.mean([r["kept"] for r in out if r["doc_id"] < 1_000]) > 0.95


def plain_distances(x):
    """Squared distances by the same estimate in numpy."""
    m = mcd_outliers
    floor = np.square(m.FLOOR)
    lower = lambda v, p: np.sort(v, axis=0)[int(np.ceil(p * len(v))) - 1]
    centre = lower(x, 0.5)
    spread = np.maximum(1.4826 * lower(np.abs(x - centre), 0.5), m.FLOOR)
    inverse, before = np.diag(1 / spread**2), np.inf
    far = lambda c, p: np.einsum("ij,jk,ik->i", x - c, p, x - c)

    def moments(own, consistency):
        cov = np.cov(own.T, ddof=0) / consistency + np.diag(floor)
        return own.mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1] / 2

    while True:
        d = far(centre, inverse)
        centre, inverse, det = moments(x[d <= lower(d, m.H)], m.CONSISTENCY)
        if not det < before - m.STILL:
            break
        before = det
    centre, inverse, _ = moments(x[far(centre, inverse) <= m.NEAR], m.NEAR_CONSISTENCY)
    return far(centre, inverse)


@pytest.mark.parametrize("broadcast", [True, False])
def test_outlier_verdicts_match_a_plain_version(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(mcd_outliers, "MOST_BROADCAST", 0)
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    docs = docs.unionByName(docs.limit(1).withColumn("lang", docs["lang"]).selectExpr("-1L as doc_id", "text", "cast(null as string) as lang", "source", "n_chars"))
    out = mcd_outliers.judge(docs, least=12).collect()
    by, usable = defaultdict(list), Counter((r["lang"], r["source"]) for r in out if not r["base_failed"])
    for r in out:
        if not r["base_failed"]:
            own = (r["lang"], r["source"])
            by[own if usable[own] >= 12 else None].append(r)
    assert len(by) > 2
    for rows in by.values():
        x = np.asarray([[np.log(r["n_words"]), np.log(max(r["word_chars"], 1) / r["n_words"]), np.log1p(4 * r["n_symbols"] / r["n_words"]), np.log1p(r["n_dup_lines"]), np.arcsin(np.sqrt(r["n_repeat_words"] / r["n_words"]))] for r in rows])
        want = plain_distances(x)
        assert np.allclose([r["distance"] for r in rows], want, rtol=1e-6)
        assert [r["kept"] for r in rows] == (want <= mcd_outliers.CUT).tolist()


def test_precision_inverts_the_covariance(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5))
    rows = spark.createDataFrame([("a", *map(float, v)) for v in x], "g string, x0 double, x1 double, x2 double, x3 double, x4 double")
    sums = rows.selectExpr("g", *[f"x{i}" for i in range(5)], *[f"0.0D as c{i}" for i in range(5)])
    from pyspark.sql import functions as F

    out = mcd_outliers._invert(sums.groupBy("g").agg(*[F.first(f"c{i}").alias(f"c{i}") for i in range(5)], *mcd_outliers._moments(F.lit(True), "a", "c")), "a").first()
    cov = np.cov(x.T, ddof=0) / mcd_outliers.CONSISTENCY + np.diag(np.square(mcd_outliers.FLOOR))
    want = np.linalg.inv(cov)
    assert np.allclose([out[f"ap{i}{j}"] for i, j in mcd_outliers.PAIRS], [want[i, j] for i, j in mcd_outliers.PAIRS])
    assert np.isclose(2 * out["adet"], np.linalg.slogdet(cov)[1])


@pytest.mark.parametrize("blocks,weights", [([3, 5, 2], [1, 1, 1]), ([40, 7, 1, 90], [5, 3, 2, 1]), ([1], [9]), ([200, 200, 3], [1, 100, 10]), ([0, 4], [1, 1])])
def test_pfair_deviation_is_less_than_one_block(blocks, weights):
    out = pfair_mixing.schedule(blocks, weights)
    assert Counter(out) == Counter((s, j) for s, n in enumerate(blocks) for j in range(n))
    assert all([j for s, j in out if s == k] == list(range(n)) for k, n in enumerate(blocks))
    done, fluid = [0] * len(blocks), [Fraction(0)] * len(blocks)
    for s, _ in out:
        left = Fraction(1)
        while left:  # the fluid stream over one slot
            open_ = [k for k in range(len(blocks)) if fluid[k] < blocks[k]]
            total = sum(weights[k] for k in open_)
            step = min([left] + [(blocks[k] - fluid[k]) * total / weights[k] for k in open_])
            for k in open_:
                fluid[k] += step * weights[k] / total
            left -= step
        done[s] += 1
        assert all(abs(a - f) < 1 for a, f in zip(done, fluid))


def fluid_lags(out, blocks, weights):
    """Largest distance of each source's served blocks from the ideal stream."""
    done, fluid, worst = [0] * len(blocks), [Fraction(0)] * len(blocks), Fraction(0)
    for s in out:
        left = Fraction(1)
        while left:
            open_ = [k for k in range(len(blocks)) if fluid[k] < blocks[k]]
            total = sum(weights[k] for k in open_)
            step = min([left] + [(blocks[k] - fluid[k]) * total / weights[k] for k in open_])
            for k in open_:
                fluid[k] += step * weights[k] / total
            left -= step
        done[s] += 1
        worst = max([worst] + [abs(a - f) for a, f in zip(done, fluid)])
    return worst


@pytest.mark.parametrize("broadcast", [True, False])
def test_mixing_over_many_rounds_stays_within_a_block(spark, monkeypatch, broadcast):
    monkeypatch.setattr(pfair_mixing, "RESOLUTION", 12)
    if not broadcast:
        monkeypatch.setattr(pfair_mixing, "MOST_BROADCAST", 0)
    sizes = {"a": 150, "b": 61, "c": 7, "d": 40}
    docs = spark.createDataFrame([(i, k) for k, n in sizes.items() for i in range(n)], "doc_id long, source string")
    weights = {"a": 6.0, "b": 3.0, "c": 2.0, "d": 1.0}
    out = pfair_mixing.mix(docs, weights, block_rows=1).collect()
    assert sorted(r["mix_slot"] for r in out) == list(range(sum(sizes.values())))
    order = ["abcd".index(r["source"]) for r in sorted(out, key=lambda r: r["mix_slot"])]
    assert fluid_lags(order, list(sizes.values()), [6, 3, 2, 1]) < 1
    for k in sizes:
        own = sorted((r["mix_slot"], r["mix_block"]) for r in out if r["source"] == k)
        assert [b for _, b in own] == list(range(sizes[k]))


def test_mixing_has_one_block_size_and_many_sources(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 700 as string) as source")
    out = pfair_mixing.mix(docs, block_rows=8)
    assert out.groupBy("source", "mix_block").count().agg({"count": "max"}).first()[0] == 8
    assert out.select("mix_position").distinct().count() == 20_000


def test_mixing_keeps_every_row(spark, sf):
    rows = [(i, "big") for i in range(500)] + [(i, "small") for i in range(40)] + [(7, None)] * 3 + [(None, "big"), (3, "big")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, k int, n int")
    out = pfair_mixing.mix(docs, {"big": 3.0, "small": 1.0}, block_rows=8).collect()
    assert Counter((r["doc_id"], r["source"]) for r in out) == Counter(rows)
    assert len({r["mix_position"] for r in out}) == len(rows)
    size = defaultdict(Counter)
    for r in sorted(out, key=lambda r: r["mix_position"]):
        size[r["mix_slot"]][(r["source"], r["mix_block"])] += 1
    assert all(len(x) == 1 and max(x.values()) <= 8 for x in size.values()) and list(size) == sorted(size)
    assert pfair_mixing.mix(docs.filter("false")).count() == 0
    clash = pfair_mixing.mix(docs.withColumnRenamed("k", "mix_slot").withColumnRenamed("n", "_stretch"), {"big": 3.0, "small": 1.0}, block_rows=8)
    assert clash.columns == ["doc_id", "source", "_stretch", *pfair_mixing.ADDED]
    assert Counter((r["doc_id"], r["mix_position"]) for r in clash.collect()) == Counter((r["doc_id"], r["mix_position"]) for r in out)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert queries.op8_pfair_mixing(spark, sf).select("mix_position").distinct().count() == n
    stored = pfair_mixing.in_mixed_order(docs, 3)
    assert stored.columns == docs.columns and stored.count() == len(rows)


def duck(sql, **tables):
    con = duckdb.connect()
    for k, v in tables.items():
        con.register(k, v) if not isinstance(v, str) else con.execute(f"create view {k} as select * from read_parquet({glob.glob(v)})")
    return con.sql(sql)


def test_url_rules_match_sql(spark):
    d = "/root/testdata/sf0.01"
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x", "http://example.org/en/12?x=1", "http://x.com/de/#", "http://x.com/DE/", "http://casino-win.x.net/p", "http://poker.x.net/gambling-help/", "http://x.net/free-download/a.exe", "http://x.net/free-download/a.exe?x", "http://notexample.org/es/", "http://ads.x.net/banner/1", "http://u:p@x.net:80/xxx", "a://b://casino", "http://org", "http://x.com/fr/\nporn", "http://x.net/replica-old/watches"]
    import pandas as pd

    pages = pd.DataFrame({"page_id": [*range(len(urls)), None], "url": [*urls, "http://x.com/de/"], "host": "clash", "rule": "clash"}).astype({"page_id": "Int64"})
    for source in (pages, pd.read_parquet(f"{d}/pages.parquet")):
        df = spark.createDataFrame([(None if pd.isna(a) else int(a), b, "x", "y") for a, b in zip(source["page_id"], source["url"])], "page_id long, url string, host string, rule string")
        got = sorted(map(repr, ((r["page_id"], r["host"], r["path"], r["rule"], r["pattern"], r["verdict"]) for r in url_rules.judge(df).collect())))
        want = duck(queries.oracle_sql()["op9_url_rules"], pages=source).fetchall()
        assert got == sorted(map(repr, want))
    assert url_rules.judge(df.filter("false")).count() == 0


def test_url_patterns_without_tokens_run_everywhere(spark):
    df = spark.createDataFrame([(1, "http://x.net/aXXb"), (2, "http://x.net/c")], "page_id long, url string")
    out = {r["page_id"]: r["verdict"] for r in url_rules.judge(df, (), ("axx*b", "@@^zz^")).collect()}
    assert out == {1: "block", 2: "allow"} and url_rules.tokens_of("axx*b") == []
    assert url_rules.tokens_of("||ads.*^banner^") == ["ads", "banner"] and url_rules.tokens_of("^a*b^c") == []


def test_url_rules_from_a_file(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("! a comment\n\naxx*b\n  @@^zz^ \naxx*b\n")
    rules = url_rules.read_rules(spark, f"file://{tmp_path}/rules.txt")
    assert sorted(rules) == ["@@^zz^", "axx*b"]
    df = spark.createDataFrame([(1, "http://x.net/aXXb"), (2, "http://x.net/c")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_rules.judge(df, (), rules).collect()} == {1: "block", 2: "allow"}


def test_resampling_is_exact_top_k_and_prefers_the_target(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op4_importance_resampling(spark, d).collect()
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    share = np.mean([q == 1 for q, _ in labels.values()])
    keys = sorted((r["gumbel_key"] for r in out), reverse=True)
    k = round(share * len(out))
    assert [r["kept"] for r in sorted(out, key=lambda r: -r["gumbel_key"])] == [x >= keys[k - 1] for x in keys]
    assert np.mean([r["kept"] for r in out if labels.get(r["doc_id"], (9,))[0] == 0]) < 0.4
    assert np.mean([r["kept"] for r in out if labels.get(r["doc_id"]) == (1, 0)]) > 0.95


def test_resampling_keys_match_a_plain_version(spark):
    import struct

    import xxhash

    rows = [(1, "good words here Here", 1), (2, "bad things there", 1), (None, "good words", 1), (4, None, 1), (5, " ", 1), (6, "good good bad", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, target int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    buckets, prime, mask = 64, 0x9E3779B97F4A7C15, (1 << 64) - 1

    def buckets_of(text):
        h = [xxhash.xxh3_64_intdigest(w) for w in (text or "").lower().split()]
        ones = [(x * prime & mask) >> 32 for x in h]
        return [x % buckets for x in ones + [(((a * prime & mask) + b & mask) * prime & mask) >> 32 for a, b in zip(h, h[1:])]]

    raw = np.bincount([b for _, t, _ in rows for b in buckets_of(t)], minlength=buckets)
    good = np.bincount(buckets_of(rows[0][1]), minlength=buckets)
    raw_p = (raw + 1) / (raw.sum() + buckets)
    ratio = np.log((good + 4 * buckets * raw_p) / (good.sum() + 4 * buckets)) - np.log(raw_p)
    got = {(r["doc_id"], r["log_ratio"]): r["gumbel_key"] for r in importance_resampling.resample(docs, labels, buckets=buckets).collect()}
    want = {}
    for doc, text, _ in rows:
        h = 42
        for part in ([struct.pack("<q", doc)] if doc is not None else []) + ([text.encode()] if text is not None else []) + [struct.pack("<i", 1)]:
            h = xxhash.xxh64_intdigest(part, seed=h)
        u = (h % (1 << 52) + 0.5) / (1 << 52)
        total = round(sum(ratio[b] for b in buckets_of(text)), 9)
        want[doc, total] = total - np.log(-np.log(u))
    assert sorted(map(repr, sorted(got, key=repr))) == sorted(map(repr, sorted(want, key=repr))) or np.allclose(sorted(x for _, x in got), sorted(x for _, x in want), atol=1e-8)
    assert np.allclose(sorted(got.values()), sorted(want.values()))


@pytest.mark.parametrize("text", [None, "", " \n\t "])
def test_slices_of_blank_texts(spark, text):
    """Partitions of nothing but null, empty or blank texts, through every operator on texts."""
    docs = spark.createDataFrame([(i, text, "en", "s") for i in range(16)], "doc_id long, text string, lang string, source string").repartition(4)
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    import public_tokenizers as P

    from kinmap.llm import binary_records, byte_bpe, language_id, ngram_join, suffix_dedup

    assert importance_resampling.resample(docs, labels).count() == 16
    assert mcd_outliers.judge(docs).filter("kept").count() == 0
    assert binary_records.write_and_read(docs, P.path("word_bpe_49k.json"), 2).count() == 16
    assert {r["lang_pred"] for r in language_id.learn_and_predict(docs, P.path("piece_bpe_32k.model")).collect()} <= {"und"}
    assert {r["n_shingles"] for r in ngram_join.join(docs).collect()} == {0}
    assert byte_bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 16
    assert pfair_mixing.mix(docs).count() == 16
    assert {r["n_removed"] for r in suffix_dedup.digests(suffix_dedup.dedup(docs)).collect()} == {0}


def test_very_long_texts(spark):
    """A text of 10 MB and a run of 200,000 letters without a space, through every operator on texts."""
    import public_tokenizers as P

    from kinmap.llm import binary_records, byte_bpe, language_id, ngram_join, suffix_dedup

    rng = np.random.default_rng(6)
    words = np.asarray(["".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(5_000)])
    long = " ".join(words[rng.integers(0, 5_000, 1_600_000)])
    run = "".join(words[rng.integers(0, 5_000, 40_000)])
    assert len(long) > 10_000_000 and len(run) > 200_000
    texts = {1: long, 2: long + " more", 3: run, 4: "a short text in a table of long ones"}
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in texts.items()], "doc_id long, text string, lang string, source string").repartition(4, "doc_id")
    base = {r["doc_id"]: (r["n_words"], r["word_chars"]) for r in mcd_outliers.base_statistics(docs).collect()}
    assert base == {k: (len(t.split()), len(t) - t.count(" ")) for k, t in texts.items()}
    ids = {r["doc_id"]: bytes(r["ids"]) for r in byte_bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    code = byte_bpe.coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert all(code.decode(ids[k]) == t.encode() for k, t in texts.items())
    records = {r["doc_id"]: r["n_tokens"] for r in binary_records.write_and_read(docs, P.path("word_bpe_49k.json"), 2).select("doc_id", "n_tokens").collect()}
    assert records[2] > records[1] > 1_500_000
    assert {r["lang_pred"] for r in language_id.learn_and_predict(docs, P.path("piece_bpe_32k.model")).collect()} <= {"en", "und"}
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    kept = {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in suffix_dedup.digests(suffix_dedup.dedup(docs)).collect()}
    assert kept == {1: len(long), 2: 5, 3: len(run), 4: len(texts[4])}
    assert importance_resampling.resample(docs.select("doc_id", "text"), spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")).count() == 4


def test_resampling_threshold_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    values = [*rng.normal(size=300).tolist(), *[0.25] * 50, 1e6, -1e6]
    keys = spark.createDataFrame([(v,) for v in values], "gumbel_key double")
    for k in (1, 2, 50, 100, 177, 351):
        assert importance_resampling.threshold(keys, k, bins=4, few=10) == sorted(values, reverse=True)[k - 1]
    docs = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 1), (None, "a b", 1), (3, "a b", 1)], "doc_id long, text string, target int")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, None), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert importance_resampling.resample(docs, labels).count() == 5
    assert importance_resampling.resample(docs, labels.filter("false")).filter("kept").count() == 5
    assert importance_resampling.resample(docs.filter("false"), labels).count() == 0
