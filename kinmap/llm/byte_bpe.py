"""Byte-level BPE by overlapping chunks.

A text longer than `chunk_chars` is cut into chunks that overlap. Each chunk is pre-tokenised and encoded on its
own, in parallel; its first pre-tokens may be wrong, since a chunk can begin inside one. A scan of the pattern has
no memory: from any true pre-token boundary on it goes the same way whatever came before. So the chunks are stitched
at the first position in an overlap where both have a boundary, and each piece is taken from the chunk that has it
whole. Where an overlap holds no common boundary (one letter run that is longer), the two chunks are scanned again
as one text. Short texts are one chunk and never leave their task. Decoding concatenates the raw bytes of the ids.

Cases: a null text is encoded as the empty text (no ids, no bytes). Empty tables give empty results. Repeated rows
and tied ids are encoded row by row; the input's other columns don't matter and aren't read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmap.llm.common import Memo, Scratch, column, small, width


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class PieceIds(Memo):
    """Pre-token to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        import tiktoken

        super().__init__()
        ranks = load_ranks(ranks_path)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.scan = regex.compile(pattern)

    def compute(self, piece: str) -> bytes:
        return np.asarray(self.core.encode_single_piece(piece.encode()), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.scan.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> PieceIds:
    """One for each worker process, kept between its tasks."""
    return PieceIds(ranks_path, pattern)


def _whole(ranks_path: str, pattern: str, decoded: bool, keep: tuple[str, ...]):
    """Encode rows (columns keep, and text) that are one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks_path, pattern)
        for batch in small(batches):
            ids = [code.encode(x) for x in column(batch, "text").to_pylist()]
            out = [*[column(batch, k) for k in keep], pa.array(ids, pa.binary())]
            if decoded:
                out.append(pa.array([code.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, [*keep, "ids", "decoded"][: len(out)])

    return run


def _chunks(ranks_path: str, pattern: str):
    """Of each chunk: where its pre-tokens end (characters in the whole text) and how many ids each has, and the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks_path, pattern)
        for batch in batches:
            for row in batch.to_pylist():
                pieces = code.scan.findall(row["text"])
                ends = np.cumsum([len(p) for p in pieces], dtype="<i8") + row["start"]
                ids = [code[p] for p in pieces]
                counts = np.asarray([len(x) // 4 for x in ids], dtype="<i4")
                row |= {"ends": ends.tobytes(), "counts": counts.tobytes(), "ids": b"".join(ids)}
                yield pa.RecordBatch.from_pylist([row], schema=_CHUNK_ARROW)

    return run


_CHUNK_ARROW = pa.schema(
    [("row_key", pa.int64()), ("chunk", pa.int32()), ("start", pa.int64()), ("text", pa.string())]
    + [("ends", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())]
)
_CHUNK = "row_key long, chunk int, start long, text string, ends binary, counts binary, ids binary"


def stitch(parts: list[dict], code: PieceIds) -> bytes:
    """Ids of the whole text from its chunks in order; parts have start, text, ends, counts and ids."""
    out: list[bytes] = []
    have, first = parts[0], 0  # pieces of `have` before `first` are written already
    for following in parts[1:]:
        ends, counts = np.frombuffer(have["ends"], "<i8"), np.frombuffer(have["counts"], "<i4")
        own = np.frombuffer(following["ends"], "<i8")
        limit = have["start"] + len(have["text"])
        common = np.intersect1d(ends[first:][ends[first:] < limit], own[own < following["start"] + len(following["text"])])
        if ends.size and (common := common[common >= following["start"]]).size:
            at = int(common[0])
            upto = int(np.searchsorted(ends, at)) + 1
            offset = np.concatenate([[0], np.cumsum(counts)])
            out.append(have["ids"][4 * offset[first] : 4 * offset[upto]])
            have, first = following, int(np.searchsorted(own, at)) + 1
            continue
        # no boundary in common: scan both as one text, from the last piece that is surely right
        begin = int(ends[first - 1]) if first else have["start"]
        text = have["text"][begin - have["start"] :] + following["text"][limit - following["start"] :]
        pieces = code.scan.findall(text)
        ids = [code[p] for p in pieces]
        have = {"start": begin, "text": text, "ids": b"".join(ids)}
        have |= {"ends": (np.cumsum([len(p) for p in pieces], dtype="<i8") + begin).tobytes(), "counts": np.asarray([len(x) // 4 for x in ids], "<i4").tobytes()}
        first = 0
    offset = np.concatenate([[0], np.cumsum(np.frombuffer(have["counts"], "<i4"))])
    out.append(have["ids"][4 * offset[first] :])
    return b"".join(out)


def _join_up(ranks_path: str, pattern: str, decoded: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        code = coder(ranks_path, pattern)
        rows = rows.sort_values("chunk")
        ids = stitch(rows.to_dict("records"), code)
        out = {"row_key": [rows["row_key"].iloc[0]], "ids": [ids]}
        return pd.DataFrame(out | ({"decoded": [code.decode(ids)]} if decoded else {}))

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = 65_536, overlap_chars: int = 1_024, with_decoded: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` of docs and ids (little-endian unsigned 32-bit integers, packed) of each row's whole text.

    with_decoded adds the bytes that the ids decode to. Each match of the pattern is encoded separately.
    """
    spark = docs.sparkSession
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    if "doc_id" in keep:
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    more = "ids binary" + ", decoded binary" * with_decoded
    schema = T.StructType([*rows.select(*keep).schema, *T._parse_datatype_string(more)])
    short = rows.filter(F.length("text") <= chunk_chars).mapInArrow(_whole(ranks_path, pattern, with_decoded, keep), schema)
    chunk = F.explode(F.sequence(F.lit(0), F.ceil((F.length("text") - overlap_chars) / F.lit(float(chunk_chars))).cast("int") - 1)).alias("chunk")
    place = F.struct(*[F.col(k) for k in keep]).alias("_place")
    # written once, so that the number of a row is the same for its chunks and for its other columns
    long = Scratch(spark, "long-texts").save(rows.filter(F.length("text") > chunk_chars).select(F.monotonically_increasing_id().alias("row_key"), place, "text"), "rows", "zstd")
    made = (
        long.select("row_key", "text", chunk)
        .select("row_key", "chunk", (F.col("chunk").cast("long") * chunk_chars).alias("start"), F.expr(f"substring(text, chunk * {chunk_chars} + 1, {chunk_chars + overlap_chars})").alias("text"))
        .repartition(width(spark), "row_key", "chunk")
        .mapInArrow(_chunks(ranks_path, pattern), _CHUNK)
        .groupBy("row_key")
        .applyInPandas(_join_up(ranks_path, pattern, with_decoded), "row_key long, " + more)
    )
    whole = made.join(long.select("row_key", "_place"), "row_key")
    return short.unionByName(whole.select(*[F.col("_place").getField(k).alias(k) for k in keep], "ids", *["decoded"] * with_decoded))


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes of its packed ids, concatenated in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks_path, pattern)
        for batch in batches:
            out = [None if x is None else code.decode(x) for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, T.StructType([encoded.schema["doc_id"], T.StructField("decoded", T.BinaryType())]))


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns of an encode(..., with_decoded=True) result."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
