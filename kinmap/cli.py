"""The engine from the command line: queries by name, the steps of a calibrated release, and the state of what is stored."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

_COMMANDS: dict[str, tuple[Callable, list[tuple[str, dict]]]] = {}


def command(*arguments: tuple[str, dict] | str):
    """Register a function as a command with these arguments."""

    def keep(f: Callable) -> Callable:
        _COMMANDS[f.__name__.replace("_", "-")] = (f, [(a, {}) if isinstance(a, str) else a for a in arguments])
        return f

    return keep


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate()


def _show(value) -> None:
    print(json.dumps(value, sort_keys=True, ensure_ascii=False))


# --- queries --------------------------------------------------------------------------------------------------------


@command()
def list_(given) -> None:
    """Names of the registered queries."""
    from kinmap.plans import catalog

    print(*sorted(catalog.queries()), sep="\n")


def _query(name: str) -> Callable:
    from kinmap.plans import catalog

    queries = catalog.queries()
    if name not in queries:
        raise SystemExit(f"no query {name}")
    return queries[name]


@command("query", "folder", ("--out", {}), ("--rows", {"type": int, "default": 20}))
def run(given) -> None:
    """Run a query over a folder of tables; show it or write it as Parquet."""
    df = _query(given.query)(_spark(), given.folder)
    df.write.parquet(given.out) if given.out else df.show(given.rows, truncate=False)


@command("query", "folder")
def explain(given) -> None:
    """The plan of a query."""
    _query(given.query)(_spark(), given.folder).explain("formatted")


# --- steps of a release ---------------------------------------------------------------------------------------------


@command("table", "store", ("--dataset", {"default": "label"}), ("--vector", {"default": "embedding"}), ("--features", {"required": True}))
def ingest(given) -> None:
    """Fit a signature for each dataset of a table and store them under the hash of the feature list."""
    from kinmap.operators import signature
    from kinmap.sources import sinks

    sinks.write_signatures(signature.signatures(_spark().read.parquet(given.table), given.dataset, given.vector), given.store, given.features)


@command("store", "table", "out", ("--features", {"required": True}), ("--vector", {"default": "embedding"}), ("--pool", {"required": True}), ("--draws", {"type": int, "default": 100}))
def build_pool(given) -> None:
    """Null profiles of stored signatures, drawn from a pool table, bound to its hash."""
    from kinmap.operators import signature
    from kinmap.sources import sinks

    spark = _spark()
    sig = sinks.read_signatures(spark, given.store, given.features)
    low, high = sig.selectExpr("min(samples)", "max(samples)").first()
    profiles = signature.null_profiles(sig, spark.read.parquet(given.table), given.vector, signature.size_grid(low, high), given.draws)
    sinks.write_profiles(profiles, given.out, pool=given.pool, features=given.features)


@command("store", "profiles", "root", ("--features", {"required": True}), ("--pool", {"required": True}), ("--stratum", {"default": "all"}))
def assemble(given) -> None:
    """Score all pairs, calibrate them by stored profiles, and finalise them as a calibration."""
    from kinmap.functions.lineage import cut
    from kinmap.operators import publish, signature
    from kinmap.sources import sinks

    spark = _spark()
    sig = sinks.read_signatures(spark, given.store, given.features)
    profiles = sinks.read_profiles(spark, given.profiles, pool=given.pool, features=given.features)
    rows = cut(signature.calibrate_pairs(signature.scores(sig, sig), profiles, sig.select("dataset", "samples"), exact=False))
    held = publish.Calibrations(spark, given.root)
    name = held.open(given.stratum, "frozen", rows.count(), pool=given.pool, features=given.features)
    if held.manifest(name)["state"] == "staging":
        held.add(name, "all", rows)
        held.finalize(name)
    _show({"calibration": name, "state": held.manifest(name)["state"]})


@command("root", "release")
def publish(given) -> None:
    """Make a calibration the current one."""
    from kinmap.operators.publish import Calibrations

    held = Calibrations(_spark(), given.root)
    held.publish(given.release, [])
    _show({"current": held.current()})


@command("root")
def rollback(given) -> None:
    """Go back to what was current before."""
    from kinmap.operators.publish import Calibrations

    _show({"current": Calibrations(_spark(), given.root).rollback()})


@command("root")
def status(given) -> None:
    """Releases of a folder with their states, what is current, and how many events there were."""
    from kinmap.operators.publish import Calibrations
    from kinmap.sources import store

    held = Calibrations(_spark(), given.root)
    names = [n for n in store.children(held.spark, held.root) if store.exists(held.spark, f"{held.root}/{n}/manifest.json")]
    _show({"releases": {n: held.manifest(n)["state"] for n in names}, "current": held.current(), "events": len(held.events())})


@command("root", "release", "out", ("--q-max", {"type": float, "default": 0.05}))
def export(given) -> None:
    """Edges of a release up to a q, as tab-separated text."""
    from kinmap.operators.publish import Calibrations
    from kinmap.sources import sinks

    sinks.write_tsv(Calibrations(_spark(), given.root).table(given.release, "edges").filter(f"q <= {given.q_max}").select("a", "b", "score", "p", "q"), given.out)


@command("root", "release")
def audit(given) -> None:
    """Checks of a release's edges; the command fails where one does."""
    from pyspark.sql import functions as F

    from kinmap.operators.publish import Calibrations

    held = Calibrations(_spark(), given.root)
    rows = held.table(given.release, "edges")
    errors = held.validate(given.release, {"order": rows.filter("a >= b"), "repeated": rows.groupBy("a", "b").count().filter("count > 1"), "q below p": rows.filter(F.col("q") < F.col("p") - 1e-12), "range": rows.filter("q < 0 or q > 1 or p < 0 or p > 1")})
    _show({"release": given.release, "errors": errors})
    if errors:
        raise SystemExit(1)


# --- archives and jobs ----------------------------------------------------------------------------------------------


@command("path")
def inspect(given) -> None:
    """Which tar files of a folder or pattern may be unpacked, and why not."""
    from kinmap.sources import archives

    for r in archives.reports(_spark(), given.path).collect():
        _show(r.asDict())


@command("path")
def index(given) -> None:
    """Members of ZIP files that are named by an accession."""
    from kinmap.sources import archives

    for r in archives.zip_members(_spark(), given.path).collect():
        _show(r.asDict())


@command("table")
def jobs(given) -> None:
    """Jobs of a table by status."""
    _show({r["status"]: r["count"] for r in _spark().read.parquet(given.table).groupBy("status").count().collect()})


@command("table", "out")
def reap(given) -> None:
    """A table of jobs with those whose lease is over put back, or dead."""
    from pyspark.sql import functions as F

    from kinmap.operators import jobs as job_ops

    job_ops.reap(_spark().read.parquet(given.table), F.current_timestamp()).write.parquet(given.out)


@command()
def health(given) -> None:
    """That a session starts and counts."""
    spark = _spark()
    _show({"spark": spark.version, "rows": spark.range(10).count()})


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kinmap", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (f, arguments) in _COMMANDS.items():
        one = commands.add_parser(name.rstrip("-"), help=f.__doc__)
        for argument, options in arguments:
            one.add_argument(argument, **options)
        one.set_defaults(do=f)
    given = parser.parse_args(args)
    given.do(given)
    return 0


if __name__ == "__main__":
    sys.exit(main())
