"""Token ids as length-delimited binary records.

A shard file is a run of records: length of the payload (u64), masked checksum of those eight bytes (u32), payload,
masked checksum of the payload (u32), all little-endian. The payload is doc_id (i64), a flag that is 1 where doc_id
is null (u8), the width of an id in bytes (u8), and the ids. A checksum c of zlib's CRC-32 is masked as
rotate_right(c, 15) + 0xa282ead8 modulo 2^32, so that a checksum stored in data isn't taken for one of data.
Beside each shard lies an index with doc_id (i64), offset of the record (u64), number of ids (u64) and of all ids before
it in the shard (u64), for reads in any order. Shards hold ascending ranges of doc_id and are sorted within, so their names in order give all ids in order.

Cases: a null text is written as the empty text, so only the end id. A null doc_id comes first. Rows with one doc_id
keep the order of their texts. An empty table writes no shard and reads back empty. Other columns aren't read.
A text of any length is one record, which a task holds once as text and once as ids.
Every task writes under a name of its own and renames when done, so a task that is run again leaves the same file.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.common import Memo, Scratch, column, small, width

INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n_ids", "<u8"), ("before", "<u8")])
#: Records that one read task takes from a shard at most.
READ_RECORDS = 256


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview, at: int) -> tuple[bytes, int]:
    """Payload of the record at an offset, and the offset after it; ValueError where a checksum differs."""
    head = bytes(data[at : at + 8])
    size, crc = struct.unpack("<Q", head)[0], struct.unpack("<I", data[at + 8 : at + 12])[0]
    if masked(head) != crc:
        raise ValueError(f"length checksum differs at offset {at}")
    payload = bytes(data[at + 12 : at + 12 + size])
    if len(payload) != size or masked(payload) != struct.unpack("<I", data[at + 12 + size : at + 16 + size])[0]:
        raise ValueError(f"payload checksum differs at offset {at}")
    return payload, at + 16 + size


def _byte_level() -> dict[int, int]:
    """Bytes to the characters that stand for them in byte-level vocabularies: printable ones for themselves, the others counted from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(others)}


def _kind(c: str) -> int:
    if c in " \t\n\v\f\r\x85\xa0":
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)


SPACE, LETTER, NUMBER, OTHER = range(4)
LATIN = [chr(i) for i in range(256)]
#: For bytes.translate() of Latin-1 text: what the vocabulary's pattern takes each character for, and its lower case.
KINDS, LOWER = bytes(map(_kind, LATIN)), "".join(LATIN).lower().encode("latin-1")


class WordIds(Memo):
    """Pieces of text to their ids, packed: pieces of Latin-1 text are bytes, stretches of other text are str.

    The vocabulary's normaliser works on characters and drops white space. A Latin-1 text is in composed form and its
    lower case is one character for one, so it is lowered and cut into pre-tokens by tables, many texts at a time:
    runs of letters, single numbers, runs of anything else. A lone apostrophe stays with the letters after it, as the two
    may be a contraction. Each different piece of the texts is looked up once. Letters alone are one pre-token, which
    goes straight to the vocabulary's merges; any other piece goes through the library as it stands.

    A text with other characters or the start of a special token is taken by its space-separated stretches, which no
    pre-token crosses; a stretch of Latin letters followed by ASCII punctuation is those two pieces.
    """

    most = 200_000
    #: Bytes of text that are cut into pieces at a time.
    block = 4_000_000
    LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.split = re.compile(f"([{self.LETTERS}]+)([!-/:-@\\[-`{{-~]*)").fullmatch
        self.characters = _byte_level()

    def compute(self, piece: bytes | str) -> bytes:
        if isinstance(piece, str):
            if m := self.split(piece):
                return self[m[1].lower().encode("latin-1")] + (self[m[2].encode()] if m[2] else b"")
            text = piece
        elif (text := piece.decode("latin-1")).isalpha() and len(text) < 1_000:
            shown = text if piece.isascii() else text.encode().decode("latin-1").translate(self.characters)
            return np.asarray([t.id for t in self.merges(shown)], dtype=self.dtype).tobytes()
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        at, parts, size = [], [], 0
        for k, text in enumerate(texts):
            try:
                latin = None if "<|" in text else text.encode("latin-1")
            except UnicodeEncodeError:
                latin = None
            if latin is None:
                out[k] = list(map(self.__getitem__, text.split(" ")))
                continue
            for part in self._stretches(latin):
                at.append(k)
                parts.append(part)
                size += len(part)
                if size >= self.block:
                    self._add(out, at, parts)
                    at, parts, size = [], [], 0
        self._add(out, at, parts)
        return [b"".join(x) for x in out]

    def _stretches(self, text: bytes) -> Iterator[bytes]:
        """A text that is longer than a block in parts, cut at spaces."""
        at = 0
        while len(text) - at > self.block and (cut := text.find(b" ", at + self.block)) >= 0:
            yield text[at:cut]
            at = cut + 1
        yield text[at:]

    def _add(self, out: list[list[bytes]], at: list[int], parts: list[bytes]) -> None:
        for k, ids in zip(at, self._encode_latin(parts), strict=True):
            out[k].append(ids)

    def _encode_latin(self, texts: list[bytes]) -> Iterator[bytes]:
        data = b"\n".join(texts)
        kind, low = (np.frombuffer(data.translate(table), np.uint8) for table in (KINDS, LOWER))
        begins = kind != SPACE
        inside = begins.copy()
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        begins[1:][begins[:-1] & (low[:-1] == ord("'")) & (kind[1:] == LETTER)] = False
        # the pieces, without the space between them
        offsets = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])]).dictionary_encode()
        found = list(map(self.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False).tolist()))
        numbers = pieces.indices.to_numpy()

        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        first, long = (np.cumsum(sizes) - sizes)[numbers], sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(long)])
        ids = np.frombuffer(b"".join(found), self.dtype)[np.repeat(first - ends[:-1], long) + np.arange(ends[-1])]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = ends[np.searchsorted(np.flatnonzero(begins), starts)].tolist()
        return (ids[a:b].tobytes() for a, b in pairwise(cuts))


@lru_cache(maxsize=2)
def words(path: str) -> WordIds:
    """One for each worker process, kept between its tasks."""
    return WordIds(path)


@lru_cache(maxsize=16)
def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's address, on the executor; any store that Arrow knows."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _write(folder: str, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, (store, root) = words(vocabulary), _store(folder)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        end = np.asarray([end_id], dtype=code.dtype).tobytes()
        size = len(end)
        index, at, total, out = [], 0, 0, None
        store.create_dir(root, recursive=True)
        name = f"{root}/shard-{shard:06d}"
        for batch in small(batches, most=code.block):
            ids_of, texts = column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()
            out = out or store.open_output_stream(f"{name}.{attempt}.tmp")
            for doc, packed in zip(ids_of, code.encode([t or "" for t in texts]), strict=True):
                ids = packed + end
                record = frame(struct.pack("<qBB", doc or 0, doc is None, size) + ids)
                out.write(record)
                index.append((doc or 0, at, len(ids) // size, total))
                at, total = at + len(record), total + len(ids) // size
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{name}.{attempt}.idx.tmp") as idx:
            idx.write(np.array(index, dtype=INDEX).tobytes())
        store.move(f"{name}.{attempt}.idx.tmp", f"{name}.idx")
        store.move(f"{name}.{attempt}.tmp", f"{name}.rec")
        yield pa.RecordBatch.from_pylist([{"shard": shard, "n_docs": len(index), "n_ids": total}])

    return run


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int, shards: int | None = None) -> list[dict]:
    """Encode and write all rows in ascending doc_id order; returns a dict for each shard, in order.

    What comes to the driver is a row a shard.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(shards or width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    done = dealt.mapInArrow(_write(folder, vocabulary, end_id), "shard long, n_docs long, n_ids long").collect()
    return [r.asDict() for r in sorted(done, key=lambda r: r["shard"])]


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for part in batch.to_pylist():
                name = f"{root}/shard-{part['shard']:06d}"
                with store.open_input_file(f"{name}.idx") as f:
                    f.seek(part["first"] * INDEX.itemsize)  # only its own entries, and the one after them
                    index = np.frombuffer(f.read((READ_RECORDS + 1) * INDEX.itemsize), dtype=INDEX)
                start = part["base"] + int(index["before"][0])
                with store.open_input_file(f"{name}.rec") as f:
                    begin = int(index["offset"][0])
                    stop = int(index["offset"][READ_RECORDS]) if len(index) > READ_RECORDS else f.size()
                    f.seek(begin)
                    data = memoryview(f.read(stop - begin))
                at, out = 0, {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
                while at < len(data):
                    payload, at = unframe(data, at)
                    doc, null, size = struct.unpack("<qBB", payload[:10])
                    ids = np.frombuffer(payload, dtype=f"<u{size}", offset=10)
                    for k, v in (("doc_id", None if null else doc), ("start", start), ("n_tokens", len(ids)), ("ids", ids.astype("<u4").tobytes())):
                        out[k].append(v)
                    start += len(ids)

                kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
                yield from small([pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], list(kinds))], "ids", 2_000_000)

    return run


def read_records(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """doc_id, start (ids of all records before), n_tokens and ids (packed little-endian u32) from the files.

    Reads go by the index, in runs of READ_RECORDS records, each with its checksums verified.
    """
    base = [0, *accumulate(s["n_ids"] for s in shards)]
    files = spark.createDataFrame([(s["shard"], s["n_docs"], b) for s, b in zip(shards, base, strict=False)], "shard long, n_docs long, base long")
    todo = files.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(READ_RECORDS).cast("long"))).alias("first"), "base")
    reads = sum(-(-s["n_docs"] // READ_RECORDS) for s in shards)
    todo = todo.repartition(max(1, min(reads, width(spark))), "shard", "first")
    return todo.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids binary")


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Round trip through files in the shared folder."""
    spark = docs.sparkSession
    folder = Scratch(spark, "records").path("shards")
    return read_records(spark, folder, write_records(docs, folder, vocabulary, end_id))


def digests(records: DataFrame) -> DataFrame:
    """The contract's columns of a read_records() result."""
    return records.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
