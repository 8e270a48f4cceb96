import pytest

from kinmap.operators import discovery, publish
from kinmap.operators.query import compile_query


def test_release_life(spark, tmp_path):
    r = publish.Releases(spark, f"file://{tmp_path}/releases")
    pairs = spark.createDataFrame([(1, 2, 0.5)], "a long, b long, score double")
    for name in ("r1", "r2"):
        r.stage(name, {"pairs": publish.migrated(pairs, "pairs")}, pool="x")
        r.move(name, "calibrated")
    r.stage("r1", {}, pool="x")
    with pytest.raises(ValueError):
        r.stage("r1", {}, pool="y")
    errors = r.validate("r1", {"loop": pairs.filter("a = b"), "order": pairs.filter("a > 0")})
    assert errors == ["order"]
    with pytest.raises(ValueError):
        r.publish("r1", errors)
    r.publish("r1", [])
    r.publish("r2", [])
    assert r.current() == "r2" and r.manifest("r1")["state"] == "superseded"
    assert r.rollback() == "r1" and r.current() == "r1" and r.manifest("r2")["state"] == "superseded"
    with pytest.raises(ValueError):
        r.move("r1", "staging")
    assert r.table("r1", "pairs").columns == ["a", "b", "score", "algorithm"]
    with pytest.raises(ValueError):
        publish.migrated(pairs, "pairs", version=2)


def test_discovery_queries_compile(spark):
    assert discovery.discovery_ast() == {"all": True}
    ast = discovery.discovery_ast(q_max=0.05, independent=True, text_at_most=0.5)
    out = compile_query(ast)
    assert out.leaves == 3 and out.uses_text and out.uses_independence


def test_command_line(spark, sf, capsys, tmp_path):
    from kinmap import cli

    assert cli.main(["list"]) == 0 and "t02_union_topk" in capsys.readouterr().out
    assert cli.main(["run", "a07_status_counts", sf, "--rows", "5"]) == 0 and "status" in capsys.readouterr().out
    assert cli.main(["run", "a07_status_counts", sf, "--out", f"file://{tmp_path}/o"]) == 0
    assert cli.main(["explain", "a07_status_counts", sf]) == 0
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing", sf])
