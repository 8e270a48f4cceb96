"""Archives: what is in them, whether they may be unpacked, unpacking, and the index of a ZIP file's members.

A file is a row of `binaryFile`. Reports are made where the file is read; what an archive declares is checked before
any payload is.
"""

from __future__ import annotations

import csv
import hashlib
import io
import os
import re
import shutil
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Limits:
    """What an archive may hold at most: members, bytes of one, bytes of all."""

    members: int = 100_000
    member_bytes: int = 20 << 30
    all_bytes: int = 500 << 30


class Unsafe(ValueError):
    """An archive that a person has to look at."""


# Names that some systems keep for devices.
DEVICES = {"CON", "PRN", "AUX", "NUL"} | {f"{kind}{n}" for kind in ("COM", "LPT") for n in range(1, 10)}


def why_unsafe(name: str) -> str | None:
    """What keeps a member's name from being a plain relative path on any system, or None."""
    if not name or "\0" in name or "\\" in name:
        return "empty, or a NUL or back slash in the name"
    if name.startswith("/") or re.match("[A-Za-z]:", name):
        return "an absolute name"
    for part in name.rstrip("/").split("/"):
        if part in ("", ".", ".."):
            return "an empty, own or upper folder in the name"
        if ":" in part or part[-1] in " .":
            return "a part that some systems can't hold"
        if part.partition(".")[0].upper() in DEVICES:
            return "the name of a device"
    return None


def inspect(data: io.BufferedIOBase | str, limits: Limits = Limits()) -> dict[str, int]:
    """Counts of a tar file, compressed or not; Unsafe where anything in it must not be unpacked."""
    out = {"members": 0, "files": 0, "cel_files": 0, "bytes": 0, "largest": 0}
    names: set[str] = set()
    try:
        with tarfile.open(data, "r:*") if isinstance(data, str) else tarfile.open(fileobj=data, mode="r:*") as archive:
            for m in archive:
                out["members"] += 1
                if out["members"] > limits.members:
                    raise Unsafe(f"more than {limits.members} members")
                if reason := why_unsafe(m.name):
                    raise Unsafe(f"{m.name!r}: {reason}")
                same = m.name.rstrip("/").casefold()
                if same in names:
                    raise Unsafe(f"{m.name!r} is there twice, but for its case")
                names.add(same)
                if m.isdir():
                    continue
                if not m.isfile():
                    raise Unsafe(f"{m.name!r} is no plain file or folder")
                out["bytes"] += m.size
                if not 0 <= m.size <= limits.member_bytes or out["bytes"] > limits.all_bytes:
                    raise Unsafe(f"{m.name!r} makes it too large")
                out["files"] += 1
                out["largest"] = max(out["largest"], m.size)
                out["cel_files"] += same.endswith((".cel", ".cel.gz"))
    except (tarfile.TarError, OSError, EOFError) as e:
        raise Unsafe(f"can't be read: {e}") from e
    return out


_REPORT = "path string, safe boolean, reason string, members long, files long, cel_files long, bytes long, largest long"


def reports(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """A row for each tar file of a folder or pattern: whether it is safe, why not, and its counts where it is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append({"path": name, "safe": True, "reason": None} | inspect(io.BytesIO(content), limits))
                except Unsafe as e:
                    rows.append({"path": name, "safe": False, "reason": str(e)})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _REPORT.split(", ")]).astype({c: "Int64" for c in ("members", "files", "cel_files", "bytes", "largest")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _REPORT)


def extract(archive: str, folder: Path, limits: Limits = Limits()) -> dict[str, int]:
    """Unpack a tar file that inspect() passes: into a hidden folder, which takes its name when all is there."""
    counts = inspect(archive, limits)
    if folder.exists():
        raise FileExistsError(folder)
    staged = folder.with_name(f".{folder.name}.{uuid.uuid4().hex[:8]}")
    try:
        with tarfile.open(archive, "r:*") as source:
            for m in source:
                target = staged / m.name
                if m.isdir():
                    target.mkdir(parents=True, exist_ok=True)
                    continue
                target.parent.mkdir(parents=True, exist_ok=True)
                with source.extractfile(m) as given, target.open("xb") as out:
                    shutil.copyfileobj(given, out, 1 << 20)
                if target.stat().st_size != m.size:
                    raise Unsafe(f"{m.name!r} is shorter than it says")
        staged.mkdir(exist_ok=True)
        os.replace(staged, folder)
    except BaseException:
        shutil.rmtree(staged, ignore_errors=True)
        raise
    return counts


_MEMBER = "path string, accession string, member string, size long, crc32 string, sha256 string, sample_ids array<string>"


def zip_members(spark: SparkSession, path: str, accession: str = r"GSE\d+") -> DataFrame:
    """A row for each member of the ZIP files that is named by an accession: size, checksums and the samples of its header.

    sample_ids: of each column of the first line after the first, its leading sample number, or null. Two members of one
    accession in a file are an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                seen: set[str] = set()
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for m in archive.infolist():
                        stem = Path(m.filename).stem.upper()
                        if m.is_dir() or not re.fullmatch(accession, stem):
                            continue
                        if stem in seen:
                            raise ValueError(f"{stem} is in {name} twice")
                        seen.add(stem)
                        digest = hashlib.sha256()
                        with archive.open(m) as given:
                            while part := given.read(1 << 20):
                                digest.update(part)
                        with archive.open(m) as given:
                            header = next(csv.reader(io.TextIOWrapper(given, "utf-8-sig", newline="")), [])
                        found = [re.match(r"(GSM\d+)(?:\b|_)", x.strip(), re.I) for x in header[1:]]
                        yield pd.DataFrame({"path": [name], "accession": [stem], "member": [m.filename], "size": [m.file_size], "crc32": [f"{m.CRC:08x}"], "sha256": [digest.hexdigest()], "sample_ids": [[x[1].upper() if x else None for x in found]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _MEMBER)


def indexed(members: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Members not in the cache yet, by path, member, size and checksum: what a run that goes on has still to do."""
    keys = ["path", "member", "size", "crc32"]
    return members if cache is None else members.join(cache.select(*keys).distinct(), keys, "left_anti")
