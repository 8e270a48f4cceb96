"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Every byte covered by a string of LENGTH bytes that also starts earlier (in an earlier document, or earlier in the
same one) is removed. Strings never cross documents and are judged on the input.

Sorting all suffixes of a corpus moves many times its size, so the array is sparse. In each window of LENGTH bytes the
SEED-byte string with the smallest hash (the leftmost of equals) is the window's anchor. Equal windows have their
anchor at the same offset, so sorting the suffixes at anchors brings all equal windows together; about one position
in thirty is an anchor. A suffix is needed only as far as it can matter, to the end of the last window of its
anchor; with it goes the text before it, backward, to the start of the anchor's first window.

1. Anchors whose seed occurs once in the corpus have no equal window. Tasks exchange 32 bits of each seed's hash,
   within a partition chosen by other bits, and hear which of theirs occur again (a few too many, never too few).
   A seed that repeats within one block of texts is sent once from there.
2. Seeds drawn from the others cut the order of suffixes into ranges of about one size, one a partition, so that the
   partitions one after another hold one sorted array. The suffixes are sorted in each task and sent, by range, as
   front-coded runs: of each, the length of the prefix it shares with the one before, and the rest. Suffixes that agree
   wholly with an earlier one of the same run are judged on the spot and not sent, so a passage in a third of all
   documents sends one suffix a run. All suffixes of one seed are in one range, so different contexts of one passage
   are one task's: as many as runs have different ones.
3. Each partition combines its runs with a loser tree that carries common-prefix lengths: it compares two heads by
   their lengths first and looks at characters only beyond the prefix that both are known to share. The merged order
   comes with its prefix lengths; with those of the backward texts they give whole numbers that are equal exactly when
   two windows are. The earliest window of each class stays, the others' bytes go.

Cases: a null text is empty. A text shorter than LENGTH stays as it is. A null doc_id comes before all others. Rows with
one doc_id and different texts are different documents, ordered by a hash of the text; wholly repeated rows are one
document, given back as often as it came. An empty table gives an empty result. Texts that lose bytes inside a
character keep its other bytes (kept is binary). Other columns aren't read. A text of any length is read whole, in
segments of SEGMENT bytes that overlap by a window.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmap.llm.common import Scratch, column, free_shuffles, numbered, small, text_buffers, width

LENGTH = 100
SEED = 36
#: Anchors drawn for each range of the sort, about.
SAMPLED = 32
#: Bytes of text whose anchors, or suffixes, make one exchanged block.
BLOCK = 16 << 20
SEGMENT = 1 << 19
_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers for bytes, and powers of an odd base and of its inverse modulo 2^64."""
    table = np.random.default_rng(20240229).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = SEGMENT + LENGTH
    base, inverse = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return table, np.cumprod(up), np.cumprod(down)


def _windows(data: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor of each window of a short array, and the hash of the seed at each place."""
    table, up, down = _powers()
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(table[data] * up[:n], out=sums[1:])
    h = (sums[seed:] - sums[:-seed]) * down[: n - seed + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(_ODD)
    h ^= h >> np.uint64(29)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    size, want = 1, length - seed + 1
    while size * 2 <= want:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if rest := want - size:
        low = np.minimum(low[:-rest], low[rest:])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64), h


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(document, place, first window, last window, hash) of every anchor; places count from the start of data.

    Document k is data[offsets[k]:offsets[k + 1]].
    """
    parts = []
    lengths = np.diff(offsets)
    for start in range(0, len(data) - length + 1, SEGMENT):
        place, h = _windows(data[start : start + SEGMENT + length - 1], length, seed)
        first, last = np.searchsorted(offsets, [start, start + len(place) - 1], side="right") - 1
        doc = np.repeat(np.arange(first, last + 1), np.minimum(offsets[first + 1 : last + 2], start + len(place)) - np.maximum(offsets[first : last + 1], start))
        at = np.arange(start, start + len(place))
        own = at + length <= offsets[doc + 1]
        doc, at, place = doc[own], at[own], place[own]
        if not len(at):
            continue
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
        begin = np.flatnonzero(new)
        end = np.concatenate([begin[1:], [len(at)]]) - 1
        parts.append((doc[begin], place[begin] + start, at[begin], at[end], h[place[begin]]))
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    doc, place, lo, hi, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))  # one cut by a segment
    assert (lengths >= 0).all()
    return doc[new], place[new], lo[new], np.maximum.reduceat(hi, new), h[new]


def _buffers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document numbers, and the texts' bytes with their offsets."""
    return column(batch, "doc_no").to_numpy(), *text_buffers(batch)


def _blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[list[pa.RecordBatch]]:
    """Slices of batches, gathered to about so many bytes of text."""
    held, size = [], 0
    for batch in small(batches, most=2 << 20):
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h * np.uint64(_ODD)) >> np.uint64(40)) % np.uint64(parts)


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.asarray([len(a) for a in arrays], "<u8").tobytes(), *[a.tobytes() for a in arrays]])


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, "<u8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


_BLOCK = "part int, kind int, payload binary"
_ANSWER = "doc_no long, rank int, run boolean"
_SPANS = T.ArrayType(T.StructType().add("begin", "long").add("end", "long"))


def _block(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    parts, kinds, payloads = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(payloads, pa.binary())], ["part", "kind", "payload"])


def _ask(parts: int, length: int, seed: int):
    """Blocks of seeds' hashes for each partition (kind 0), and anchors known to repeat already (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches):
            found = []
            for batch in held:
                numbers, data, offsets = _buffers(batch)
                doc, _, _, _, h = anchors(data, offsets, length, seed)
                first = np.searchsorted(doc, doc, side="left")  # an anchor's number is its rank in its document
                found.append((numbers[doc], (np.arange(len(doc)) - first).astype("<u4"), h))
            number, rank, h = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            again = np.zeros(len(h), bool)
            again[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            witness = np.zeros(len(h), bool)
            witness[order] = np.concatenate([[True], ~same])
            out = []
            if again.any():
                out.append((int(h[0] % np.uint64(parts)), 1, _pack(number[again].astype("<i8"), rank[again])))
            ask = np.flatnonzero(witness)
            part = _part_of(h[ask], parts)
            ask = ask[np.argsort(part, kind="stable")]
            cuts = np.searchsorted(np.sort(part), np.arange(parts + 1))
            short = (h & np.uint64(0xFFFFFFFF)).astype("<u4")
            for p in range(parts):
                own = ask[cuts[p] : cuts[p + 1]]
                if len(own):
                    own = np.sort(own)
                    docs, counts = _runs_of(number[own])
                    out.append((p, 0, _pack(docs.astype("<i8"), counts.astype("<u4"), short[own], rank[own], again[own].astype("u1"))))
            yield _block(out)

    return run


def _runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of runs of equal neighbours."""
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[begin], np.diff(np.concatenate([begin, [len(values)]]))


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_no, rank, run) of the anchors whose seed occurs again; run marks one of those of a block, so that a seed has
    as many marks as the runs that its suffixes go into."""
    asked = []

    def rows(number: np.ndarray, rank: np.ndarray, run: bool) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(number), 500_000):
            own = slice(a, a + 500_000)
            yield pa.RecordBatch.from_arrays([pa.array(number[own]), pa.array(rank[own].astype(np.int32)), pa.array(np.full(len(number[own]), run))], ["doc_no", "rank", "run"])

    for batch in batches:
        for kind, payload in zip(column(batch, "kind").to_pylist(), column(batch, "payload").to_pylist(), strict=True):
            if kind == 1:
                yield from rows(*_unpack(payload, "<i8", "<u4"), False)
            else:
                docs, counts, short, rank, known = _unpack(payload, "<i8", "<u4", "<u4", "<u4", "u1")
                asked.append((np.repeat(docs, counts), short, rank, known))
    if not asked:
        return
    number, short, rank, known = (np.concatenate(x) for x in zip(*asked, strict=True))
    order = np.argsort(short, kind="stable")
    same = short[order][1:] == short[order][:-1]
    hit = order[np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (known[order] != 0)]
    yield from rows(number[hit], rank[hit], True)


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix, from the part of it that is known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


def front_code(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(shared prefix lengths, lengths of the rests, the rests) of a list, each against the one before."""
    before, shared, rests = b"", [], []
    for w in words:
        k = common(before, w)
        shared.append(k)
        rests.append(w[k:])
        before = w
    return np.asarray(shared, "<u2"), np.asarray([len(r) for r in rests], "<u2"), b"".join(rests)


def front_decode(shared: np.ndarray, sizes: np.ndarray, rests: bytes) -> list[bytes]:
    before, at, out = b"", 0, []
    for k, n in zip(shared.tolist(), sizes.tolist(), strict=True):
        before = before[:k] + rests[at : at + n]
        at += n
        out.append(before)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs, each given with its prefix lengths; returns (run of each output, prefix lengths).

    A loser tree. Each head carries the length of the prefix it shares with the last output. Of two heads the one that
    shares more comes first, and only heads that share equally much are compared, from that length on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    words = [r[0] for r in runs] + [[]] * (k - len(runs))
    shares = [r[1] for r in runs] + [[]] * (k - len(runs))
    heads = [w[0] if w else None for w in words]
    lcp = [0] * k
    at = [0] * k
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's length becomes its prefix in common with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        i, j = lcp[a], lcp[b]
        if i > j:
            return a, b
        if j > i:
            return b, a
        h = common(x, y, i)
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            lcp[b] = h
            return a, b
        lcp[a] = h
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    champion = build(1)
    source, out = [], []
    while heads[champion] is not None:
        source.append(champion)
        out.append(lcp[champion])
        at[champion] += 1
        n = at[champion]
        if n < len(words[champion]):
            heads[champion], lcp[champion] = words[champion][n], shares[champion][n]
        else:
            heads[champion] = None
        node = (champion + k) >> 1
        while node:
            other = loser[node]
            x, y = heads[champion], heads[other]
            if y is not None:
                if x is None:
                    loser[node], champion = champion, other
                else:
                    i, j = lcp[champion], lcp[other]
                    if j > i:
                        loser[node], champion = champion, other
                    elif i == j:
                        champion, loser[node] = play(champion, other)
            node >>= 1
    return source, out


def _seeds(length: int, seed: int):
    """The seeds at the anchors named by `ranks`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches):
            for batch in held:
                _, data, offsets = _buffers(batch)
                doc, place, *_ = anchors(data, offsets, length, seed)
                first = np.searchsorted(doc, np.arange(batch.num_rows), side="left")
                pick = np.concatenate([first[k] + np.asarray(w, np.int64) for k, w in enumerate(column(batch, "ranks").to_pylist())])
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[p : p + seed] for p in place[pick].tolist()], pa.binary())], ["seed"])

    return run


def splitters(texts: DataFrame, again: DataFrame, parts: int, length: int, seed: int) -> list[bytes]:
    """At most parts - 1 seeds in order, which cut the suffixes to be sorted into ranges of about one size.

    They come from a sample, by hash, of SAMPLED of the marked anchors (a seed and run each) a range; names of that many
    are broadcast, so that no text is exchanged for it, and their seeds reach the driver.
    """
    total = again.agg(F.sum(F.size("runs"))).first()[0] or 0
    below = int((1 << 40) * min(1.0, SAMPLED * parts / max(total, 1)))
    drawn = again.select("doc_no", F.filter("runs", lambda r: F.pmod(F.xxhash64("doc_no", r), F.lit(1 << 40)) < below).alias("ranks")).filter(F.size("ranks") > 0)
    sample = sorted(bytes(r["seed"]) for r in texts.join(F.broadcast(drawn), "doc_no").mapInArrow(_seeds(length, seed), "seed binary").collect())
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []


def _send(cuts_at: list[bytes], length: int, seed: int):
    """Sorted front-coded runs of suffixes for each range of seeds (kind 0), and spans judged on the spot (kind 1)."""
    parts = len(cuts_at) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches):
            seen: dict[tuple[bytes, bytes], int] = {}
            rows: list[tuple[int, bytes, bytes, int, int]] = []  # partition, suffix, text before it backward, document, place
            spans: list[tuple[int, int, int]] = []
            for batch in held:
                numbers, data, offsets = _buffers(batch)
                wanted = column(batch, "ranks").to_pylist()
                doc, place, lo, hi, _ = anchors(data, offsets, length, seed)
                first = np.searchsorted(doc, np.arange(len(numbers)), side="left")
                pick = np.sort(np.concatenate([first[k] + np.asarray(w, np.int64) for k, w in enumerate(wanted)] or [np.zeros(0, np.int64)]))
                raw = data.tobytes()
                base = offsets[:-1]
                for d, p, a, b in zip(doc[pick].tolist(), place[pick].tolist(), lo[pick].tolist(), hi[pick].tolist(), strict=True):
                    number, start = int(numbers[d]), int(base[d])
                    q = bisect_right(cuts_at, raw[p : p + seed])
                    suffix, back = raw[p : b + length], raw[a:p][::-1]
                    k = seen.get((suffix, back))
                    if k is None:
                        seen[suffix, back] = len(rows)
                        rows.append((q, suffix, back, number, p - start))
                        continue
                    _, _, _, other, there = rows[k]
                    if (number, p - start) < (other, there):  # the earlier one stands for both
                        rows[k] = (q, suffix, back, number, p - start)
                        number, p = other, there
                    else:
                        p -= start
                    spans.append((number, p - len(back), p + len(suffix)))
            out = []
            if spans:
                spans.sort()
                joined = []
                for number, a, b in spans:
                    if joined and joined[-1][0] == number and a <= joined[-1][2]:
                        joined[-1][2] = max(b, joined[-1][2])
                    else:
                        joined.append([number, a, b])
                out.append((spans[0][0] % parts, 1, _pack(*np.asarray(joined, "<i8").T)))
            rows.sort()
            cuts = np.searchsorted(np.asarray([r[0] for r in rows], np.int64), np.arange(parts + 1))
            for q in range(parts):
                own = rows[cuts[q] : cuts[q + 1]]
                if own:
                    shared, sizes, rests = front_code([r[1] for r in own])
                    shared_back, sizes_back, rests_back = front_code([r[2] for r in own])
                    packed = _pack(shared, sizes, shared_back, sizes_back, np.asarray([r[3] for r in own], "<i8"), np.asarray([r[4] for r in own], "<i8"), np.frombuffer(rests, "u1"), np.frombuffer(rests_back, "u1"))
                    out.append((q, 0, packed))
            if out:
                yield _block(out)

    return run


def _backward_classes(group: np.ndarray, backs: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the backward texts within groups, and the prefix length each shares with the one before in it."""
    n, words = len(backs), -(-most // 8)
    sizes = np.fromiter(map(len, backs), np.int64, n)
    grid = np.frombuffer(b"".join([b.ljust(8 * words, b"\0") for b in backs]), np.uint8).reshape(n, 8 * words)
    keys = grid.view(">u8").astype(np.uint64)
    order = np.lexsort((sizes, *[keys[:, k] for k in range(words - 1, -1, -1)], group))
    sorted_grid = grid[order]
    differ = sorted_grid[1:] != sorted_grid[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), 8 * words)
    shared = np.minimum(shared, np.minimum(sizes[order][1:], sizes[order][:-1]))
    shared[group[order][1:] != group[order][:-1]] = -1
    return order, np.concatenate([[-1], shared])


def judge_group(suffix_lcp: np.ndarray, sizes: np.ndarray, backs: list[bytes], number: np.ndarray, place: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of every window that an earlier equal one exists for; suffixes come in merged order.

    sizes: lengths of the suffixes; place: of each anchor in its document.
    """
    group = np.cumsum(suffix_lcp < seed)
    same = np.concatenate([group[1:] == group[:-1], [False]])
    keep = np.flatnonzero(same | np.concatenate([[False], same[:-1]]))
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    suffix_lcp, sizes, group, number, place = (x[keep] for x in (suffix_lcp, sizes, group, number, place))
    backs = [backs[k] for k in keep.tolist()]
    most, least = np.fromiter(map(len, backs), np.int64, len(backs)), length - sizes
    order, shared = _backward_classes(group, backs, length - seed)
    age = np.empty(len(keep), np.int64)
    age[np.lexsort((place, number))] = np.arange(len(keep))
    out_number, out_start = [], []
    left = np.empty(len(keep), np.int64)
    for back in range(length - seed + 1):
        at = np.flatnonzero((least <= back) & (back <= most))
        if len(at) < 2:
            continue
        right = np.cumsum(suffix_lcp < length - back)
        left[order] = np.cumsum(shared < back) if back else np.cumsum(shared < 0)
        ranked = at[np.lexsort((age[at], left[at], right[at]))]
        again = np.concatenate([[False], (right[ranked][1:] == right[ranked][:-1]) & (left[ranked][1:] == left[ranked][:-1])])
        hit = ranked[again]
        out_number.append(number[hit])
        out_start.append(place[hit] - back)
    if not out_number:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_number), np.concatenate(out_start)


def spans_of(number: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs covered by windows of a document: (document, begin, end)."""
    order = np.lexsort((start, number))
    number, start = number[order], start[order]
    begin = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (start[1:] > start[:-1] + length)]))
    last = np.concatenate([begin[1:], [len(start)]]) - 1
    return number[begin], start[begin], start[last] + length


def _combine(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, runs, packed = ["doc_no", "begin", "end"], [], []
        for batch in batches:
            for kind, payload in zip(column(batch, "kind").to_pylist(), column(batch, "payload").to_pylist(), strict=True):
                if kind == 1:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _unpack(payload, "<i8", "<i8", "<i8")], names)
                else:
                    packed.append(_unpack(payload, "<u2", "<u2", "<u2", "<u2", "<i8", "<i8", "u1", "u1"))
        if not packed:
            return
        for shared, sizes, _, _, _, _, rests, _ in packed:
            runs.append((front_decode(shared, sizes, rests.tobytes()), shared.tolist()))
        source, lcp = merge_runs(runs)
        source = np.asarray(source)
        order = np.empty(len(source), np.int64)  # output to row of the runs one after another
        by_run = np.argsort(source, kind="stable")
        order[by_run] = np.arange(len(source))
        flat_sizes = np.concatenate([x[0].astype(np.int64) + x[1] for x in packed])
        flat_backs = [b for x in packed for b in front_decode(x[2], x[3], x[7].tobytes())]
        number, place = np.concatenate([x[4] for x in packed]), np.concatenate([x[5] for x in packed])
        del runs, packed
        hit = judge_group(np.asarray(lcp), flat_sizes[order], [flat_backs[k] for k in order.tolist()], number[order], place[order], length, seed)
        if len(hit[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in spans_of(*hit, length)], names)

    return run


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(keep: tuple[str, ...], as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in small(batches):
            kept, spans = [], []
            for text, found in zip(column(batch, "text").to_pylist(), column(batch, "_found").to_pylist(), strict=True):
                own = union([(x["begin"], x["end"]) for x in found or ()])
                edges = [0, *[e for span in own for e in span], len(text)]
                left = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]) if own else text
                kept.append(left.decode(errors="ignore") if as_text else left)
                spans.append([{"begin": a, "end": b} for a, b in own])
            yield pa.RecordBatch.from_arrays([column(batch, k) for k in keep] + [pc.binary_length(column(batch, "text")).cast(pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(spans, shape)], [*keep, "n_bytes", "kept", "spans"])

    return run


def dedup(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, seed: int = SEED, as_text: bool = False) -> DataFrame:
    """Columns `keep` of docs, n_bytes, kept (the bytes that stay) and spans (what went: begin and end, in bytes).

    With as_text, kept is text without the bytes of characters that were cut through.
    """
    spark, n = docs.sparkSession, width(docs.sparkSession)
    scratch = Scratch(spark, "suffixes")
    rows, _ = numbered(docs.select(*dict.fromkeys((*keep, "doc_id", "text"))))
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")).cast("binary"))
    texts = rows.select(F.col("_doc_no").alias("doc_no"), "text")
    asked = texts.filter(F.length("text") >= length).mapInArrow(_ask(n, length, seed), _BLOCK).repartitionById(n, "part")
    again = asked.mapInArrow(_answer, _ANSWER).groupBy("doc_no").agg(F.collect_set("rank").alias("ranks"), F.collect_set(F.when(F.col("run"), F.col("rank"))).alias("runs"))
    again = scratch.save(again, "again", "zstd")
    free_shuffles(spark)
    cuts_at = splitters(texts, again, n, length, seed)
    runs = texts.join(again.hint("shuffle_hash"), "doc_no").mapInArrow(_send(cuts_at, length, seed), _BLOCK).repartitionById(len(cuts_at) + 1, "part")
    found = runs.mapInArrow(_combine(length, seed), "doc_no long, begin long, end long")
    by_doc = found.groupBy(F.col("doc_no").alias("_doc_no")).agg(F.collect_list(F.struct("begin", "end")).alias("_found"))
    by_doc = scratch.save(by_doc, "spans", "zstd")
    scratch.drop(again)
    free_shuffles(spark)
    schema = rows.select(*keep).schema.add("n_bytes", "long").add("kept", "string" if as_text else "binary").add("spans", _SPANS)
    return rows.join(by_doc.hint("shuffle_hash"), "_doc_no", "left").mapInArrow(_cut(keep, as_text), schema)


def digests(out: DataFrame) -> DataFrame:
    """The contract's columns of a dedup() result."""
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
