"""Immutable releases in folders, calibrations that are staged and finalised, and the pointer that names what is current."""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmap.functions import stats
from kinmap.operators.matrix import finite
from kinmap.operators.release import checks
from kinmap.sources import store
from kinmap.sources.sinks import canonical_json

STATES = {"staging": ("calibrated", "failed"), "calibrated": ("published", "failed"), "published": ("superseded",), "superseded": ("published",), "failed": ()}
#: Columns of the engine's tables; a table may lack the later ones, which are then null.
SCHEMAS = {
    "pairs": T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("algorithm", T.StringType())]),
    "edges": T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("p", T.DoubleType()), T.StructField("q", T.DoubleType()), T.StructField("percentile", T.DoubleType())]),
    "nodes": T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("community", T.StringType())]),
}
VERSION = 1


def migrated(df: DataFrame, name: str, version: int = VERSION) -> DataFrame:
    """df with all columns of the table's schema; a newer version is refused."""
    if version > VERSION:
        raise ValueError(f"schema version {version} is newer than {VERSION}")
    empty = df.sparkSession.createDataFrame([], SCHEMAS[name])
    return empty.unionByName(df, allowMissingColumns=True).select(*[f.name for f in SCHEMAS[name]])


class Releases:
    """A folder of releases in any store: tables as Parquet, a manifest each, an event log, a pointer."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self, release: str) -> dict:
        return store.read_json(self.spark, f"{self.root}/{release}/manifest.json")

    def _log(self, **event) -> None:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json"
        store.write_json(self.spark, f"{self.root}/events/{name}", event | {"at": int(time.time())})

    def events(self) -> list[dict]:
        folder = f"{self.root}/events"
        return [store.read_json(self.spark, f"{folder}/{n}") for n in store.children(self.spark, folder) if n.endswith(".json")]

    def stage(self, release: str, tables: dict[str, DataFrame], **binding) -> None:
        """Tables are written first and the manifest last, so a release without one was never staged."""
        folder = f"{self.root}/{release}"
        if store.exists(self.spark, f"{folder}/manifest.json"):
            if self.manifest(release)["binding"] != binding:
                raise ValueError(f"{release} is there with another binding")
            return
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        self._set(release, {"state": "staging", "binding": binding, "tables": sorted(tables)})

    def _set(self, release: str, manifest: dict) -> None:
        store.write_json(self.spark, f"{self.root}/{release}/manifest.json", manifest)

    def move(self, release: str, state: str, **more) -> None:
        manifest = self.manifest(release)
        if state not in STATES[manifest["state"]]:
            raise ValueError(f"{release} can't go from {manifest['state']} to {state}")
        self._set(release, manifest | {"state": state} | more)
        self._log(release=release, state=state)

    def validate(self, release: str, named: dict[str, DataFrame]) -> list[str]:
        """Names of the checks that some row breaks."""
        return sorted(r["check"] for r in checks(named).filter("not passed").collect())

    def current(self) -> str | None:
        pointer = f"{self.root}/current.json"
        return store.read_json(self.spark, pointer)["release"] if store.exists(self.spark, pointer) else None

    def publish(self, release: str, errors: list[str]) -> None:
        """Make a calibrated, or an earlier published, release the current one; the pointer changes at once or not."""
        if errors:
            raise ValueError("; ".join(errors))
        before = self.current()
        self.move(release, "published")
        store.write_json(self.spark, f"{self.root}/current.json", {"release": release, "before": before})
        if before and before != release:
            self.move(before, "superseded")

    def rollback(self) -> str:
        before = store.read_json(self.spark, f"{self.root}/current.json")["before"]
        if not before:
            raise ValueError("nothing to go back to")
        self.publish(before, [])
        return before

    def table(self, release: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{release}/{name}")


class Calibrations(Releases):
    """Families of pairs that gather p-values in batches and are finalised once, with q over the whole family."""

    MODES = ("exact", "frozen")

    def open(self, stratum: str, mode: str, pairs: int, **binding) -> str:
        """Id of the calibration with this binding, staged now or earlier; pairs: how many the family has."""
        if mode not in self.MODES or pairs < 1:
            raise ValueError(f"mode is one of {self.MODES}, and a family has a pair at least")
        full = binding | {"stratum": stratum, "mode": mode, "pairs": pairs}
        name = "cal_" + hashlib.sha256(canonical_json(full).encode()).hexdigest()[:24]
        self.stage(name, {}, **full)
        return name

    def add(self, name: str, batch: str, rows: DataFrame) -> None:
        """p-values (a, b, score, p) of a batch; a batch written again takes the place of what an earlier try left."""
        if self.manifest(name)["state"] != "staging":
            raise ValueError(f"{name} takes no more pairs")
        rows.select("a", "b", "score", "p").write.mode("overwrite").parquet(f"{self.root}/{name}/batches/{batch}")

    def finalize(self, name: str) -> DataFrame:
        """The family with q, once it is whole: each pair once, all numbers finite, p within 0 and 1."""
        wanted = self.manifest(name)["binding"]["pairs"]
        rows = self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.root}/{name}/batches")
        bad = ~(finite(F.col("score")) & finite(F.col("p")) & F.col("p").between(0, 1))
        count = rows.agg(F.count("*").alias("n")).filter(F.col("n") != wanted)
        errors = self.validate(name, {"family": count, "numbers": rows.filter(bad), "repeated": rows.groupBy("a", "b").count().filter("count > 1"), "order": rows.filter("a >= b")})
        if errors:
            raise ValueError(f"{name} isn't whole: {', '.join(errors)}")
        stats.benjamini_hochberg(rows, "p", "q").write.mode("overwrite").parquet(f"{self.root}/{name}/edges")
        self.move(name, "calibrated", tables=["edges"])
        return self.table(name, "edges")

    def fail(self, name: str, reason: str) -> None:
        self.move(name, "failed", reason=reason)


class TextReleases(Releases):
    """Families of text similarities, each finalised once against one list of records."""

    def open(self, model: str, records: DataFrame, id: str, text: str, **binding) -> str:
        """Id of the release of this model over these records: a hash of what each record says binds it."""
        marks = records.select(F.sha2(F.concat_ws("\u001f", F.col(id).cast("string"), F.coalesce(text, F.lit(""))), 256).alias("h"))
        number = F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")
        n, total = marks.agg(F.count("*"), F.sum(number)).first()
        full = binding | {"model": model, "records": n, "corpus": str(total)}
        name = "text_" + hashlib.sha256(canonical_json(full).encode()).hexdigest()[:24]
        self.stage(name, {}, **full)
        return name

    def finalize(self, name: str, pairs: DataFrame) -> DataFrame:
        """pairs (a, b, cosine) of the whole family, stored with their percentile."""
        n = self.manifest(name)["binding"]["records"]
        count = pairs.agg(F.count("*").alias("n")).filter(F.col("n") != n * (n - 1) // 2)
        errors = self.validate(name, {"family": count, "numbers": pairs.filter(~finite(F.col("cosine")))})
        if errors:
            raise ValueError(f"{name} isn't whole: {', '.join(errors)}")
        stats.cumulative_share(pairs, "cosine", "percentile").write.mode("overwrite").parquet(f"{self.root}/{name}/pairs")
        self.move(name, "calibrated", tables=["pairs"])
        return self.table(name, "pairs")
