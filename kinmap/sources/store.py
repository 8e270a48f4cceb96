"""Small files (manifests, pointers, reports) in any store that Hadoop knows, whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from kinmap.sources.sinks import canonical_json


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    fs, target = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def read(spark: SparkSession, path: str) -> bytes:
    fs, target = _at(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def write(spark: SparkSession, path: str, data: bytes) -> None:
    """Under a name of its own first; then it takes the place of what is there."""
    fs, target = _at(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.part")
    stream = fs.create(part, True)
    try:
        stream.write(data)
    finally:
        stream.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} couldn't be renamed")


def read_json(spark: SparkSession, path: str):
    return json.loads(read(spark, path))


def write_json(spark: SparkSession, path: str, value) -> None:
    write(spark, path, canonical_json(value).encode())
