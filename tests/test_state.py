import io
import itertools
import json
import tarfile
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmap import cli
from kinmap.functions import ids, registered, stats
from kinmap.operators import annotate, community, jobs, pairs, publish, signature
from kinmap.plans import frames
from kinmap.sources import archives, sinks, store

# --- archives -------------------------------------------------------------------------------------------------------


def tar(*members, mode="w"):
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode=mode) as out:
        for name, body in members:
            m = tarfile.TarInfo(name)
            if body is None:
                m.type = tarfile.DIRTYPE
            elif isinstance(body, bytes):
                m.size = len(body)
            else:
                m.type, m.linkname = body.encode(), "x"
            out.addfile(m, io.BytesIO(body) if isinstance(body, bytes) else None)
    return held.getvalue()


BAD = [
    [("../x", b"a")], [("/x", b"a")], [("a/../b", b"a")], [("C:x", b"a")], [("a\\b", b"a")], [("con.txt", b"a")], [("a ", b"a")], [("x.", b"a")],
    [("l", "2")], [("l", "1")], [("p", "6")], [("a/B", b"1"), ("A/b", b"2")],
]


def test_archives_are_judged_before_they_are_unpacked(spark, tmp_path):
    good = tar(("d", None), ("d/one.CEL", b"12345"), ("two.cel.gz", b"1"), ("three.txt", b""), mode="w:gz")
    assert archives.inspect(io.BytesIO(good)) == {"members": 4, "files": 3, "cel_files": 2, "bytes": 6, "largest": 5}
    for members in BAD:
        with pytest.raises(archives.Unsafe):
            archives.inspect(io.BytesIO(tar(*members)))
    for limits in (archives.Limits(members=3), archives.Limits(member_bytes=4), archives.Limits(all_bytes=5)):
        with pytest.raises(archives.Unsafe):
            archives.inspect(io.BytesIO(good), limits)
    for broken in (b"no archive", good[:40]):
        with pytest.raises(archives.Unsafe):
            archives.inspect(io.BytesIO(broken))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.tar.gz").write_bytes(good)
    (tmp_path / "in" / "bad.tar").write_bytes(tar(*BAD[0]))
    got = {r["path"].rsplit("/", 1)[1]: (r["safe"], r["files"]) for r in archives.reports(spark, f"file://{tmp_path}/in").collect()}
    assert got == {"good.tar.gz": (True, 3), "bad.tar": (False, None)}
    archives.extract(str(tmp_path / "in" / "good.tar.gz"), tmp_path / "out")
    assert (tmp_path / "out" / "d" / "one.CEL").read_bytes() == b"12345"
    with pytest.raises(FileExistsError):
        archives.extract(str(tmp_path / "in" / "good.tar.gz"), tmp_path / "out")
    with pytest.raises(archives.Unsafe):
        archives.extract(str(tmp_path / "in" / "bad.tar"), tmp_path / "other")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in", "out"]


def test_zip_index(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as out:
        out.writestr("x/gse12.csv", "﻿id,GSM1,gsm2_b,other\n1,2,3\n")
        out.writestr("readme.md", "-")
    got = archives.zip_members(spark, f"file://{tmp_path}/*.zip")
    (row,) = got.collect()
    assert (row["accession"], row["sample_ids"]) == ("GSE12", ["GSM1", "GSM2", None])
    assert archives.indexed(got, got).count() == 0 and archives.indexed(got, got.withColumn("crc32", F.lit("0"))).count() == 1


# --- jobs -----------------------------------------------------------------------------------------------------------

START = datetime(2024, 1, 1)


def job_table(spark, *rows):
    return spark.createDataFrame([("k", *r, START) for r in rows], "kind string, job long, status string, attempts int, most_attempts int, worker string, lease_until timestamp, retry_at timestamp, created timestamp")


def after(seconds):
    return F.lit(START + timedelta(seconds=seconds)).cast("timestamp")


def test_a_job_goes_from_queue_to_end(spark):
    table = job_table(spark, (1, "queued", 0, 2, None, None, None), (2, "queued", 0, 2, None, None, None))
    table = jobs.claim(table, "w", after(0), 1, lease_seconds=60)
    got = {r["job"]: r for r in table.collect()}
    assert (got[1]["status"], got[1]["attempts"], got[1]["worker"], got[1]["lease_until"]) == ("running", 1, "w", START + timedelta(seconds=60)) and got[2]["status"] == "queued"
    late = {r["job"]: r["lease_until"] for r in jobs.heartbeat(table, "w", after(59), 60).collect()}
    assert late[1] == START + timedelta(seconds=119)
    assert {r["job"]: r["lease_until"] for r in jobs.heartbeat(table, "w", after(61), 60).collect()}[1] == START + timedelta(seconds=60)
    results = spark.createDataFrame([(1, "retryable"), (2, "done")], "job long, outcome string")
    done = {r["job"]: r for r in jobs.finish(table, results, "w", after(30)).collect()}
    assert done[1]["status"] == "retry" and done[1]["worker"] is None and done[1]["retry_at"] > START + timedelta(seconds=59)
    assert done[2]["status"] == "queued"
    assert {r["job"]: r["status"] for r in jobs.finish(table, results, "other", after(30)).collect()}[1] == "running"
    again = jobs.claim(jobs.reap(table, after(61)), "v", after(62), 5)
    assert {(r["job"], r["worker"], r["attempts"]) for r in again.collect()} == {(1, "v", 2), (2, "v", 1)}
    assert {r["job"]: r["status"] for r in jobs.reap(again, after(10_000)).collect()} == {1: "dead", 2: "retry"}
    with pytest.raises(ValueError):
        jobs.claim(table, "w", after(0), 1, lease_seconds=1)


def test_handlers():
    handlers, seen = jobs.Handlers(), []

    @handlers.add("good")
    def good(job):
        seen.append(job["job"])

    @handlers.add("bad")
    def bad(job):
        raise jobs.Permanent if job["job"] else OSError

    assert [handlers.run({"kind": k, "job": n}) for k, n in (("good", 1), ("bad", 1), ("bad", 0), ("none", 1))] == ["done", "permanent", "retryable", "permanent"] and seen == [1]
    with pytest.raises(ValueError):
        handlers.add("good")(good)


def test_a_cursor_goes_on_after_a_crash(spark, tmp_path):
    rows, at = spark.range(0, 70, 2).withColumnRenamed("id", "k"), f"file://{tmp_path}/cursor.json"
    done = []

    def work(crash_at):
        after = store.read_json(spark, at)["last"] if store.exists(spark, at) else None
        for page, last in jobs.pages(rows, "k", after, 10):
            if last == crash_at:
                raise RuntimeError
            done.extend(r["k"] for r in page.collect())
            store.write_json(spark, at, {"last": last})

    with pytest.raises(RuntimeError):
        work(38)
    assert len(done) == 10
    work(None)
    assert sorted(done) == list(range(0, 70, 2))


# --- releases and stores --------------------------------------------------------------------------------------------


def test_calibration_is_finalised_once_and_whole(spark, tmp_path):
    held = publish.Calibrations(spark, f"file://{tmp_path}/c")
    name = held.open("s", "exact", 3, pool="x")
    assert held.open("s", "exact", 3, pool="x") == name != held.open("s", "exact", 3, pool="y")
    rows = spark.createDataFrame([(1, 2, 0.5, 0.01), (1, 3, 0.6, 0.04), (2, 3, 0.7, 0.03)], "a long, b long, score double, p double")
    held.add(name, "one", rows.filter("a = 1"))
    with pytest.raises(ValueError, match="family"):
        held.finalize(name)
    held.add(name, "two", rows.filter("a = 2"))
    held.add(name, "two", rows.filter("a = 2"))
    assert {(r["a"], r["b"]): round(r["q"], 9) for r in held.finalize(name).collect()} == {(1, 2): 0.03, (1, 3): 0.04, (2, 3): 0.04}
    with pytest.raises(ValueError, match="no more"):
        held.add(name, "three", rows)
    with pytest.raises(ValueError):
        held.open("s", "loose", 3)
    bad = held.open("s", "exact", 1, pool="z")
    held.add(bad, "one", rows.limit(1).withColumn("p", F.lit(1.5)))
    with pytest.raises(ValueError, match="numbers"):
        held.finalize(bad)
    held.fail(bad, "p")
    assert held.manifest(bad)["state"] == "failed" and [e["state"] for e in held.events()] == ["calibrated", "failed"]


def test_text_release_is_bound_to_its_records(spark, tmp_path):
    held = publish.TextReleases(spark, f"file://{tmp_path}/t")
    records = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, text string")
    name = held.open("m", records, "id", "text")
    assert name == held.open("m", records.repartition(2), "id", "text") != held.open("m", records.filter("id < 3"), "id", "text")
    family = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.2), (2, 3, 0.2)], "a long, b long, cosine double")
    with pytest.raises(ValueError):
        held.finalize(name, family.limit(2))
    assert sorted(round(r["percentile"], 6) for r in held.finalize(name, family).collect()) == [0.333333, 1.0, 1.0]


def test_profiles_and_signatures_are_bound(spark, tmp_path):
    profiles = spark.createDataFrame([(1, 5, 1.0, 0.1), (1, 9, 2.0, 0.2), (2, 5, 3.0, 0.3)], "dataset long, size int, mu double, sigma double")
    sinks.write_profiles(profiles, f"file://{tmp_path}/p", pool="x")
    assert sorted(tuple(r) for r in sinks.read_profiles(spark, f"file://{tmp_path}/p", pool="x").collect()) == sorted(tuple(r) for r in profiles.collect())
    with pytest.raises(Exception, match="another pool"):
        sinks.read_profiles(spark, f"file://{tmp_path}/p", pool="y").collect()
    with pytest.raises(Exception):
        sinks.read_signatures(spark, f"file://{tmp_path}/none", "f").count()
    made = sinks.npz_bytes({"b": np.arange(3), "a": np.eye(2)})
    assert made == sinks.npz_bytes({"a": np.eye(2), "b": np.arange(3)}) and np.load(io.BytesIO(made))["b"].tolist() == [0, 1, 2]


def test_dependencies_have_one_fingerprint():
    one = sinks.Dependencies("a.b-1", {"x": "0" * 64, "y": "1" * 64}, {"f/g": "2" * 64}, {"k": 1})
    assert one.fingerprint() == sinks.Dependencies("a.b-1", {"y": "1" * 64, "x": "0" * 64}, {"f/g": "2" * 64}, {"k": 1}).fingerprint() != sinks.Dependencies("a.b-1", {}).fingerprint()
    for bad in (("a..b", {}), ("a/b", {}), ("a", {"x": "zz"}), ("a", {}, {"../f": "2" * 64})):
        with pytest.raises(ValueError):
            sinks.Dependencies(*bad)


def test_report_leaves_out_what_is_done(tmp_path):
    calls = []
    for _ in range(2):
        report = sinks.Report(tmp_path / "r.json")
        for unit in "ab":
            assert report.run(unit, lambda unit=unit: calls.append(unit) or unit) in (unit, None)
    assert calls == ["a", "b"]


def test_release_is_built_again_where_its_folder_changed(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/embeddings.parquet")
    source.filter("vec_id < 12").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert frames.calibrated(spark, str(tmp_path)).count() == 66
    source.filter("vec_id < 9").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    assert frames.calibrated(spark, str(tmp_path)).count() == 36


# --- columns --------------------------------------------------------------------------------------------------------


def test_ranks_hold_with_outliers_and_ties(spark):
    rng = np.random.default_rng(3)
    values = [*np.round(rng.normal(size=500), 2).tolist(), 1e300, -1e300, *[0.0] * 200]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i long, v double")
    bins = {r["_bin"]: r["count"] for r in stats.binned(df, "v", 64).groupBy("_bin").count().collect()}
    assert len(bins) > 20 and max(bins.values()) < 300
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    assert {r["i"]: r["n"] for r in stats.ranked(df, "v", ["i"], "n").collect()} == {i: k + 1 for k, i in enumerate(order)}
    share = {r["i"]: r["s"] for r in stats.cumulative_share(df, "v", "s").collect()}
    assert share.pop(-1) is None and all(np.isclose(share[i], np.mean(np.asarray(values) <= values[i])) for i in share)


def test_names_and_paths(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(ids.export_slug(F.lit("Über  ﬁne – Ätlas!"))) == "uber-fine-atlas" and one(ids.export_slug(F.lit("…"))) in ("export", "")
    assert one(ids.description(F.lit(" a "), F.lit(" "), F.lit(None).cast("string"), F.lit("b"))) == "a b"
    good = {"a/b": "a/b", "a\\b": "a/b"}
    for path in ("a/b", "a\\b", "/a", "a/", "..", "a//b", "nul.txt/x", "a:b", "x.", "", "a" * 300, "a\nb"):
        assert one(ids.portable_path(F.lit(path))) == good.get(path)


def test_registered_functions(spark):
    assert "kinmap_term" in registered.register(spark)
    assert spark.sql("select kinmap_term('Ab-C 1'), kinmap_slug(' Ab  C '), kinmap_dot(array(1D, 2D), array(3D, 4D)), kinmap_axis_term(array(1D), array(3D), 1D, 2D)").first() == ("abc1", "ab-c", 11.0, 27.0)
    assert [r[0] for r in spark.sql("select * from kinmap_size_grid(10, 30)").collect()] == [12, 16, 20, 25, 30]


def test_quotes_are_found_wherever_they_stand(spark):
    texts = ["one two three four five six seven", "xone two three four fivex", "", "two three", "a  b\tc d e f g", None, "zwei drei vier fünf sechs sieben"]
    quotes = ["one two three four five", "two three", "ne two three four fi", "a  b\tc d e", "nothing of this is there at all", "", None, "drei vier fünf sechs si"]
    s = spark.createDataFrame(list(enumerate(texts)), "doc long, src string")
    q = spark.createDataFrame(list(enumerate(quotes)), "item long, quote string")
    got = {(r["doc"], r["item"]) for r in annotate.quoted(s, "doc", "src", q, "item", "quote").collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, x in enumerate(quotes) if t is not None and x and x in t}


def test_cross_and_embedded_vectors(spark):
    out = pairs.embedded(spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string"), "id", "t", lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert {r["id"]: r["vector"] for r in out.collect()} == {1: [2.0, 1.0], 2: [0.0, 1.0]}
    rows = [(i, [float(i % 3), 1.0, float(i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r["a"], r["b"]) for r in pairs.cross_pairs(df.filter("id < 7"), df.filter("id >= 7"), "id", "v").collect()}
    assert got == {(a, b) for a in range(7) for b in range(7, 30)}
    assert pairs.cross_pairs(df.filter("id < 7"), df.filter("false"), "id", "v").count() == 0


# --- communities ----------------------------------------------------------------------------------------------------


def blocks(sizes, seed=0):
    rng, edges, first = np.random.default_rng(seed), [], 0
    for n in sizes:
        edges += [(first + a, first + b, 1.0) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6]
        first += n
    return [*edges, *[(int(x), int(y), 0.2) for x, y in rng.integers(0, first, (first, 2)) if x < y]], first


def test_partition_finds_planted_blocks_and_never_loses_modularity():
    edges, n = blocks([12, 15, 9])
    a, b, w = (np.asarray(x) for x in zip(*edges))
    label = community.partition(n, a, b, w, 1.0, 1)
    truth = np.repeat([0, 1, 2], [12, 15, 9])
    assert community.agreement(label, truth) > 0.95
    assert community.modularity(label, a, b, w) >= community.modularity(truth, a, b, w) - 1e-9
    degree = np.bincount(a, weights=w, minlength=n) + np.bincount(b, weights=w, minlength=n)
    full = np.zeros((n, n))
    np.add.at(full, (a, b), w)
    full += full.T
    same = truth[:, None] == truth[None]
    assert np.isclose(community.modularity(truth, a, b, w), ((full - np.outer(degree, degree) / degree.sum()) * same).sum() / degree.sum())
    assert community.agreement(truth, truth) == 1 and community.agreement(truth, np.arange(n)) < 1


def test_snapshot_of_a_drawn_graph(spark):
    edges, n = blocks([10, 10, 8], seed=4)
    nodes = spark.range(n + 1)
    out = community.snapshot(nodes, spark.createDataFrame(edges, "a long, b long, weight double"), runs=4).orderBy("id").collect()
    assert [r["id"] for r in out] == list(range(n + 1)) and len({r["modularity"] for r in out}) == 1
    assert len({r["community"] for r in out[:10]}) == 1 and out[n]["community"] not in {r["community"] for r in out[:n]}
    assert 0.8 < out[0]["stability"] <= 1 and all(0 <= r[c] <= 1 for r in out for c in "xy")
    near = lambda own: np.mean([np.hypot(out[i]["x"] - out[j]["x"], out[i]["y"] - out[j]["y"]) for i, j in own])
    assert near(itertools.combinations(range(10), 2)) < near((i, j) for i in range(10) for j in range(10, 28))
    again = community.snapshot(nodes, spark.createDataFrame(edges, "a long, b long, weight double"), runs=4).orderBy("id").collect()
    assert again == out


# --- command line ---------------------------------------------------------------------------------------------------


def test_a_release_from_the_command_line(spark, sf, tmp_path, capsys):
    at = lambda name: f"file://{tmp_path}/{name}"
    assert cli.main(["ingest", f"{sf}/embeddings.parquet", at("store"), "--features", "f"]) == 0
    assert cli.main(["build-pool", at("store"), f"{sf}/embeddings.parquet", at("profiles"), "--features", "f", "--pool", "x", "--draws", "3"]) == 0
    capsys.readouterr()
    assert cli.main(["assemble", at("store"), at("profiles"), at("root"), "--features", "f", "--pool", "x"]) == 0
    name = json.loads(capsys.readouterr().out.splitlines()[-1])["calibration"]
    assert cli.main(["publish", at("root"), name]) == 0 and cli.main(["audit", at("root"), name]) == 0
    capsys.readouterr()
    assert cli.main(["status", at("root")]) == 0
    assert json.loads(capsys.readouterr().out)["current"] == name
    assert cli.main(["export", at("root"), name, at("out"), "--q-max", "1"]) == 0
    assert spark.read.option("sep", "\t").option("header", True).csv(at("out")).count() == 45
    n = spark.read.parquet(at("store")).count()
    assert n * (n - 1) // 2 == 45 and signature.SIZES[0] == 1
    assert cli.main(["health"]) == 0
