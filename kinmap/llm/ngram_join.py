"""N-gram Jaccard join by adaptive multi-match prefixes, and its connected components.

A document's set is its different runs of WORDS words. Two sets with similarity t or more that have n and m members
share at least t * max(n, m) of them, so in any one order of all members their first n - ceil(t * n) + l and
m - ceil(t * m) + l share at least l, for every l: a longer prefix costs more entries in the index and asks for more
members in common. Each document picks its own l, by the cost of its entries and of the candidates that they are
expected to bring, from a share of its size upward; a pair must share the smaller of the two l's. The order puts rare
members first, by counts over all documents in a sketch of fixed size, so that a passage in very many documents is in
nobody's prefix.

The index is exchanged as packed blocks by member. With the lists' true lengths known, each document gives up its
entries in the longest of them, as many as its partners' asking leaves over. Documents with equal sets are one class
from there on: a block, and then each entry list, holds a class once; a class is known by a 128-bit hash of its set.
Candidates are made in steps that lose none. First every list pairs its classes with one of them, a hub; a few such
pairs of each class that share enough are compared, member by member, on the whole texts, and the links give
components. Classes that such pairs connect, or pairs that share a part of that, similar or not, are a unit. A unit of
many near copies has too many pairs to write down: it is cut into blocks, and each two blocks that can join two
components are compared in one task, by a product of matrices, which gives only what joins. Last, every list, a long
one by pairs of its parts, pairs all other classes that are in different components still, each pair with all its lists
counted; what shares enough and wasn't compared yet is compared.

Members are 64-bit hashes of word runs.

Cases: a null or empty text, or one of white space, has no members and links with nothing; its component is its own id.
Fewer than WORDS words are one member, the whole sequence. Repeated rows are one class. Rows with one id and different
texts are different documents that share their id. A null id is nobody's smallest id unless all of a component are
null; then it is the component's id. An empty table gives an empty result. Other columns aren't read. A text of any
length is read whole: its words are hashed in segments, its set is one task's at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmap.llm.common import Scratch, column, free_shuffles, numbered, packed, small, text_buffers, unpacked, width
from kinmap.llm.components import components
from kinmap.llm.suffix_dedup import _blocks, _pack, _runs_of, _unpack

WORDS = 5
#: Similarity as a share of 100.
SHARE = 75
#: Counters of the sketch, as a power of two.
SKETCH_BITS = 22
#: Partners of a rare member in different texts, about; entries that a compared member is worth.
PARTNERS = 0.05
COMPARE = 0.5
#: Members in common that every set asks for, as a share of 100 of its own.
LEAST_ASKED = 8
#: First pairs of a class; classes of a unit that is compared by blocks, and of such a block.
FEW = 4
NEAR = 0.25
BIG = 64
UNIT_BLOCK = 512
#: Classes of a part of a long list.
LIST_PART = 4_096
#: Bytes of text hashed at once.
SEGMENT = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte, the same for A-Z and a-z, and which bytes part words."""
    random = np.random.default_rng(20240301).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    random[65:91] = random[97:123]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return random, space


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, up to n; kept for the next call."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64))):
            up = np.full(max(n + 1, SEGMENT + 1), base, np.uint64)
            up[0] = 1
            _POWERS[k] = np.cumprod(up)
    return _POWERS


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts (bytes, lower case for A-Z), and where each text's begin.

    A word's hash is that of its bytes as a polynomial, from sums over the text; texts are taken in segments that end
    at white space.
    """
    random, space = _tables()
    apart = space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~apart
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = apart[:-1], apart[1:]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    first = np.searchsorted(starts, offsets)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, begin + SEGMENT, side="right")))
        size = int(ends[to - 1] - begin)
        up, down = _powers(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(random[data[begin : begin + size]] * up[:size], out=sums[1:])
        a, b = starts[at:to] - begin, ends[at:to] - begin
        out[at:to] = (sums[b] - sums[a]) * down[a]
        at = to
    out ^= out >> np.uint64(32)
    out *= _ODD
    out ^= out >> np.uint64(29)
    return out, first


def members(batch: pa.RecordBatch, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of words of a batch's texts, repeats included, and where each text's begin."""
    data, offsets = text_buffers(batch)
    flat, first = word_hashes(data, offsets)
    counts = np.diff(first)
    padded = np.concatenate([flat, np.zeros(words, np.uint64)])
    h = np.zeros(len(flat), np.uint64)
    place = np.arange(len(flat))
    end = np.repeat(first[1:], counts)
    short = bool((counts < words).any())
    for j in range(words):
        following = padded[j : j + len(flat)]
        if short:
            following = np.where(place + j < end, following, np.uint64(0))
        h = (h + following) * _ODD
        h ^= h >> np.uint64(31)
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    kept = place - np.repeat(first[:-1], counts) < np.repeat(sizes, counts)
    return h[kept], np.concatenate([[0], np.cumsum(sizes)])


def sets(batch: pa.RecordBatch, words: int = WORDS) -> list[np.ndarray]:
    h, first = members(batch, words)
    return [np.unique(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    any_rows = False
    for batch in small(batches):
        any_rows = True
        h, _ = members(batch)
        out += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(out)).astype(np.uint32)
    if any_rows:
        parts = np.minimum(out, 65_535).astype("<u2").reshape(64, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])


def _sum_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(column(batch, "part").to_pylist(), column(batch, "counts").to_pylist(), strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(counts, "<u2").astype(np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())], ["part", "counts"])


def levels(texts: DataFrame) -> np.ndarray:
    """Of each counter, how much more than by chance it holds, as a rounded logarithm; 0 for ordinary ones.

    texts: binary. The counters, a fixed number, reach the driver.
    """
    summed = texts.mapInArrow(_sketch, "part int, counts binary").repartitionById(64, "part").mapInArrow(_sum_sketch, "part int, counts binary")
    counts = np.zeros((64, (1 << SKETCH_BITS) // 64), np.int64)
    for r in summed.collect():
        counts[r["part"]] = np.frombuffer(r["counts"], "<i8")
    noise = counts.mean()
    over = np.maximum(0.0, counts.ravel() - noise - 4 * np.sqrt(noise + 1))
    return np.minimum(np.floor(np.log2(1 + over)), 31).astype(np.uint8)


def needed(n: int, share: int = SHARE) -> int:
    """Members that a set of n must share with any other to be similar: ceil(n * share / 100)."""
    return -(-n * share // 100)


def asked(n: int) -> int:
    """Members in common that a set of n asks for at the least."""
    return max(1, n * LEAST_ASKED // 100)


def spare(n: int, share: int = SHARE) -> int:
    """Members of a prefix that no partner's asking depends on: partners have needed(n) members or more."""
    return asked(needed(n, share)) - 1


def in_common(nx, ny, ask_x, ask_y, share: int = SHARE, least=np.minimum, most=np.maximum):
    """Entries that two similar sets have in common at least, after either gave up what it can spare.

    Of alpha members in common, all but needed(n) - ask lie in a prefix; the first of them in order lie in both. Works on
    arrays, and on columns with least and most of columns.
    """
    alpha = -(-(nx + ny) * share // (100 + share))
    need = lambda n: -(-n * share // 100)
    free = lambda n: most(need(n) * LEAST_ASKED // 100, 1) - 1
    inside = least(alpha - need(nx) + ask_x, alpha - need(ny) + ask_y)
    return most(inside - most(free(nx), free(ny)), 1)


def prefix(members: np.ndarray, level: np.ndarray, share: int = SHARE) -> tuple[np.ndarray, int]:
    """The prefix of a set and the number of members it asks for."""
    n = len(members)
    own = level[members >> np.uint64(64 - SKETCH_BITS)]
    order = np.argsort((own.astype(np.uint64) << np.uint64(58)) | (members * _ODD >> np.uint64(6)), kind="stable")
    base = n - needed(n, share)
    partners = np.cumsum(np.where(own[order] > 0, np.exp2(own[order].astype(float)), PARTNERS))
    choices = [asked(n)]
    while choices[-1] * 2 <= n // 3:
        choices.append(choices[-1] * 2)
    cost = [base + k + COMPARE * n * partners[base + k - 1] / k for k in choices]
    k = choices[int(np.argmin(cost))]
    return members[order[: base + k]], k


_BLOCK = "part int, kind int, payload binary"
_ROWS = "kind int, x long, y long, z long, w long, v long"


def _index(parts: int, shared, share: int):
    """Blocks of index entries for each partition (kind 0); and each document's class (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for held in _blocks(batches):
            docs: list[tuple[int, int, int, int]] = []
            classes: dict[tuple[int, int], int] = {}
            tokens, sizes, asks, members_of = [], [], [], []
            for batch in held:
                numbers = column(batch, "doc_no").to_pylist()
                for number, own in zip(numbers, sets(batch), strict=True):
                    c1, c2 = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), "<i8").tolist()
                    docs.append((number, c1, c2, len(own)))
                    if len(own) and (c1, c2) not in classes:
                        classes[c1, c2] = len(classes)
                        first, k = prefix(own, level, share)
                        tokens.append(first)
                        sizes.append(len(first))
                        asks.append(k)
                        members_of.append(len(own))
            out = [(docs[0][1] % parts, 2, _pack(*np.asarray(docs, "<i8").T))]
            if tokens:
                token, who = np.concatenate(tokens), np.repeat(np.arange(len(sizes)), sizes)
                names, asks, counted = np.asarray(list(classes), "<i8"), np.asarray(asks, "<u4"), np.asarray(members_of, "<u4")
                part = (token * _ODD >> np.uint64(40)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                for p in range(parts):
                    own = order[cuts[p] : cuts[p + 1]]
                    if len(own):
                        here, counts = _runs_of(who[own])
                        out.append((p, 0, _pack(names[here, 0], names[here, 1], counts.astype("<u4"), asks[here], counted[here], token[own])))
            parts_, kinds, payloads = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(parts_, pa.int32()), pa.array(kinds, pa.int32()), pa.array(payloads, pa.binary())], ["part", "kind", "payload"])

    return run


def _rows(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    arrays = [np.asarray(c, "<i8") for c in columns]
    arrays += [np.zeros(len(arrays[0]), "<i8")] * (5 - len(arrays))
    for a in range(0, len(arrays[0]), 500_000):
        own = [c[a : a + 500_000] for c in arrays]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[0]), kind, np.int32)), *map(pa.array, own)], ["kind", "x", "y", "z", "w", "v"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entry lists of two classes or more as rows (0: list, both halves of a class, classes in the list, what the class
    asks and its members), and documents (2: doc_no, both halves of its class, members). A list is named by its member."""
    names, others, counts, asks, sizes, tokens = [], [], [], [], [], []
    for batch in batches:
        for kind, payload in zip(column(batch, "kind").to_pylist(), column(batch, "payload").to_pylist(), strict=True):
            if kind == 2:
                yield from _rows(2, *_unpack(payload, "<i8", "<i8", "<i8", "<i8"))
                continue
            for held, got in zip((names, others, counts, asks, sizes, tokens), _unpack(payload, "<i8", "<i8", "<u4", "<u4", "<u4", "<u8"), strict=True):
                held.append(got)
    if not names:
        return
    names, others = np.concatenate(names), np.concatenate(others)
    order = np.lexsort((others, names))
    new = np.concatenate([[True], (names[order][1:] != names[order][:-1]) | (others[order][1:] != others[order][:-1])])
    own = np.empty(len(names), np.int64)
    own[order] = np.cumsum(new) - 1
    first = order[new]
    names, others = names[first], others[first]
    ask = (np.concatenate(asks).astype(np.int64) << 32 | np.concatenate(sizes))[first]
    token, who = np.concatenate(tokens), np.repeat(own.astype(np.int32), np.concatenate(counts))
    del counts, asks, sizes, tokens, own
    order = np.lexsort((who, token))
    token, who = token[order], who[order]
    once = np.concatenate([[True], (token[1:] != token[:-1]) | (who[1:] != who[:-1])])
    token, who = token[once], who[once]
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.concatenate([begin, [len(token)]]))
    size = np.repeat(size, size)
    kept = size > 1
    who = who[kept]
    yield from _rows(0, token[kept].view("<i8"), names[who], others[who], size[kept], ask[who])


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes of each list that are apart (rows sorted by list and by what sets them apart), with counts.

    A long list comes as pairs of its parts i and j: where these differ, pairs within one part are left to others. A
    list may go on from one batch to the next; pairs are made some hundred thousand at a time.
    """
    names = ["a", "b", "n", "need"]
    held: list[np.ndarray] = []

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        comp, cls, ask, n_of, held_, place, part = rows[3:]
        lists = np.cumsum(np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)]))
        halves = rows[1] != rows[2]
        end = np.searchsorted(lists, lists, side="right")
        new = np.concatenate([[True], (lists[1:] != lists[:-1]) | (comp[1:] != comp[:-1])])
        begin = np.flatnonzero(new)
        block_end = np.concatenate([begin[1:], [len(lists)]])[np.cumsum(new) - 1]
        partners = end - block_end  # those after it that are in other components
        total = np.cumsum(partners)
        at = 0
        while at < len(lists):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 400_000, side="right")))
            left = np.repeat(np.arange(at, to), partners[at:to])
            if len(left):
                right = np.arange(len(left)) - np.repeat(np.cumsum(partners[at:to]) - partners[at:to], partners[at:to]) + block_end[left]
                x, y = np.minimum(cls[left], cls[right]), np.maximum(cls[left], cls[right])
                fit = (100 * np.minimum(n_of[left], n_of[right]) >= SHARE * np.maximum(n_of[left], n_of[right])) & ~(halves[left] & (part[left] == part[right]))
                left, right, x, y = left[fit], right[fit], x[fit], y[fit]
                if not len(left):
                    at = to
                    continue
                least = in_common(n_of[left], n_of[right], ask[left], ask[right])
                # before this list two classes can share as many as the lesser place, after it as the lesser rest
                most = np.minimum(place[left], place[right]) + 1 + np.minimum(held_[left] - place[left], held_[right] - place[right]) - 1
                able = most >= least
                left, right, x, y, least = left[able], right[able], x[able], y[able], least[able]
                if not len(left):
                    at = to
                    continue
                order = np.lexsort((y, x))
                x, y, least = x[order], y[order], least[order]
                first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
                n = np.diff(np.concatenate([first, [len(x)]]))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x[first], y[first], n, least[first])], names)
            at = to

    for batch in batches:
        rows = np.stack([column(batch, k).to_numpy() for k in ("list", "i", "j", "apart", "class", "ask", "n_members", "held", "at", "part")])
        held.append(rows)
        before = (rows[:3] != rows[:3, -1:]).any(axis=0) if rows.shape[1] else np.zeros(0, bool)
        cut = int(np.flatnonzero(before)[-1]) + 1 if before.any() else 0
        if cut:  # all lists but the last are whole
            whole = np.concatenate([*held[:-1], rows[:, :cut]], axis=1)
            held = [rows[:, cut:]]
            yield from pairs(whole)
    if held and (rest := np.concatenate(held, axis=1)).shape[1]:
        yield from pairs(rest)


def _compare(share: int):
    """Rows sorted by hub, bucket and role: the hub's text, then those to compare it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, key = None, None
        for batch in small(batches):
            out = {"a": [], "b": []}
            numbers = [column(batch, k).to_pylist() for k in ("hub", "bucket", "role", "node")]
            for h, bucket, role, node, own in zip(*numbers, sets(batch), strict=True):
                if role == 0:
                    hub, key = own, (h, bucket)
                    continue
                if key != (h, bucket):
                    raise ValueError("a hub's text is missing")
                least = min(len(hub), len(own))
                if 100 * least < share * max(len(hub), len(own)):
                    continue
                both = len(np.intersect1d(hub, own, assume_unique=True))
                if 100 * both >= share * (len(hub) + len(own) - both):
                    out["a"].append(h)
                    out["b"].append(node)
            yield pa.RecordBatch.from_arrays([pa.array(out["a"], pa.int64()), pa.array(out["b"], pa.int64())], ["a", "b"])

    return run


def _column_in_common() -> Column:
    """in_common() of an entry (n_members, ask) and its list's hub."""

    class Whole:
        """A column with Python's whole division."""

        def __init__(self, c) -> None:
            self.c = c

        def __add__(self, o):
            return Whole(self.c + (o.c if isinstance(o, Whole) else o))

        def __sub__(self, o):
            return Whole(self.c - (o.c if isinstance(o, Whole) else o))

        def __mul__(self, k):
            return Whole(self.c * k)

        def __floordiv__(self, k):
            return Whole(F.floor(self.c / F.lit(k)))

        def __neg__(self):
            return Whole(-self.c)

    as_column = lambda x: x.c if isinstance(x, Whole) else F.lit(x)
    both = lambda f: lambda x, y: Whole(f(as_column(x), as_column(y)))
    sides = [Whole(F.col(c)) for c in ("n_members", "hub.n_members", "ask", "hub.ask")]
    return in_common(*sides, least=both(F.least), most=both(F.greatest)).c


def _shorten(lists: DataFrame, share: int) -> DataFrame:
    """Without the entries that each class can spare, those in its longest lists.

    Two similar sets have members in common in their prefixes. Lists have one order, by length, so what either spares of
    those are the last in it; what both keep is counted by in_common(), and is at least one. A class that has no more
    entries than it can spare has no partner. Adds how many a class keeps and the place of each in that order.
    """
    by = Window.partitionBy("c1", "c2")  # as the rows are dealt already
    place = F.row_number().over(by.orderBy(F.desc("size"), F.desc("list")))
    free = F.greatest(F.floor(F.ceil(F.col("n_members") * share / 100) * LEAST_ASKED / 100), F.lit(1)) - 1
    rows = lists.withColumn("_place", place).withColumn("_all", F.count("*").over(by)).filter(F.col("_place") > free)
    return rows.select("list", "class", "ask", "n_members", (F.col("_all") - free).cast("long").alias("held"), (F.col("_all") - F.col("_place")).cast("long").alias("at"))


def _stars(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's hub with the other classes in it, the FEW of each class that it shares most lists with.

    Hubs are chosen alike in all lists. A pair is only counted in the lists that its hub is the hub of: it is strong where
    that is what similar sets share, and is given from NEAR of that on.
    """
    hub = F.min_by(F.struct("class", "ask", "n_members", "held"), F.struct(F.xxhash64("class"), "class"))
    hubs = lists.groupBy("list").agg(hub.alias("hub"))
    met = lists.join(hubs, "list").filter(F.col("class") != F.col("hub.class")).withColumn("need", _column_in_common())
    pairs = met.groupBy(F.col("hub.class").alias("a"), F.col("class").alias("b")).agg(F.count("*").alias("n"), F.min("need").alias("need"))
    order = Window.partitionBy("b").orderBy(F.desc("n"), F.xxhash64("a"), "a")
    near = pairs.filter(F.col("n") >= F.col("need") * NEAR).withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= FEW)
    return near.select("a", "b", (F.col("n") >= F.col("need")).alias("strong"))


def _unite(share: int):
    """Rows sorted by unit, two blocks of it, and block: the links between components that the blocks' texts make.

    All pairs of the two blocks are compared by a product of their membership matrices, over members that both have.
    """

    def links(rows: list[tuple[int, int, int, np.ndarray]]) -> list[tuple[int, int]]:
        """rows: block, component, node, set."""
        first = rows[0][0]
        left = [r for r in rows if r[0] == first]
        right = [r for r in rows if r[0] != first] or left
        sides = [np.concatenate([r[3] for r in side]) for side in (left, right)]
        both = np.intersect1d(*sides)
        counts = np.zeros((len(left), len(right)), np.float32)
        for a in range(0, len(both), 4_096):
            part = both[a : a + 4_096]
            grids = []
            for side in (left, right):
                grid = np.zeros((len(side), len(part)), np.float32)
                for k, r in enumerate(side):
                    at = np.searchsorted(part, r[3])
                    at[at == len(part)] = 0
                    grid[k, at[part[at] == r[3]]] = 1
                grids.append(grid)
            counts += grids[0] @ grids[1].T
        sizes = [np.asarray([len(r[3]) for r in side], np.int64) for side in (left, right)]
        counts = counts.astype(np.int64)
        whole = sizes[0][:, None] + sizes[1][None, :] - counts
        group = [np.asarray([r[1] for r in side]) for side in (left, right)]
        x, y = np.nonzero((100 * counts >= share * whole) & (group[0][:, None] != group[1][None, :]))
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        out = []
        for i, k in zip(x.tolist(), y.tolist(), strict=True):
            p, q = find(left[i][1]), find(right[k][1])
            if p != q:
                root[p] = q
                out.append((left[i][2], right[k][2]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def give() -> Iterator[pa.RecordBatch]:
            if held and (out := links(held)):
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in small(batches):
            columns = [column(batch, k).to_pylist() for k in ("unit", "i", "j", "block", "component", "node")]
            for unit, i, j, block, comp, node, own in zip(*columns, sets(batch), strict=True):
                if key != (unit, i, j):
                    yield from give()
                    held, key = [], (unit, i, j)
                held.append((block, comp, node, own))
        yield from give()

    return run


def _block_pairs(members_: DataFrame) -> DataFrame:
    """node, unit, component, block, i, j: each node in all pairs (i, j) of its unit's blocks that its own is part of.

    A component of UNIT_BLOCK / 2 classes or more has blocks of its own, all others of the unit share blocks. Two blocks
    of one component have nothing to join and are no pair, so a unit that is one large component and a few classes more
    costs what it holds, not its square.
    """
    sized = members_.groupBy("unit", "component").agg(F.count("*").alias("n"))
    big = F.col("n") >= UNIT_BLOCK // 2
    sized = sized.withColumn("big", big).withColumn("group", F.when(big, F.col("component")).otherwise(F.lit(0).cast("long")))
    several = sized.groupBy("unit").agg(F.count("*").alias("comps")).filter("comps > 1").select("unit")
    groups = sized.join(several, "unit").groupBy("unit", "big", "group").agg(F.ceil(F.sum("n") / UNIT_BLOCK).alias("blocks"))
    numbers = groups.select("unit", "big", "group", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("index"))
    numbers = numbers.withColumn("block", F.row_number().over(Window.partitionBy("unit").orderBy("big", "group", "index")))
    left = numbers.select("unit", F.col("block").alias("i"), F.col("big").alias("big_i"), F.col("group").alias("group_i"))
    right = numbers.select("unit", F.col("block").alias("j"), F.col("big").alias("big_j"), F.col("group").alias("group_j"))
    pairs = left.join(right, "unit").filter("i <= j and not (big_i and big_j and group_i = group_j)").select("unit", "i", "j")
    of_block = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    named = members_.join(sized.select("unit", "component", "big", "group"), ["unit", "component"]).join(groups, ["unit", "big", "group"])
    named = named.withColumn("index", F.pmod(F.xxhash64("node"), F.col("blocks"))).join(numbers.drop("blocks"), ["unit", "big", "group", "index"])
    return named.select("node", "unit", "component", "block").join(of_block, ["unit", "block"])


def _within_units(texts: DataFrame, members_: DataFrame, share: int, scratch: Scratch) -> DataFrame:
    """Links between components of a unit, for units of more than BIG classes; members_: node, unit, component."""
    spark = texts.sparkSession
    wanted = _block_pairs(members_)
    sent = texts.withColumnRenamed("doc_no", "node").join(wanted.hint("shuffle_hash"), "node")
    sent = sent.repartition(width(spark), "unit", "i", "j").sortWithinPartitions("unit", "i", "j", "block")
    out = scratch.save(sent.select("unit", "i", "j", "block", "component", "node", "text").mapInArrow(_unite(share), "a long, b long"), "unit-links")
    free_shuffles(spark)
    return out


def _verify(texts: DataFrame, pairs: DataFrame, share: int, scratch: Scratch, name: str, together: int = 32) -> DataFrame:
    """The pairs (a, b) of doc_no whose whole texts are similar. A hub's text goes with up to about `together` others."""
    spark = texts.sparkSession
    counted = pairs.groupBy("a").agg(F.ceil(F.count("*") / together).alias("buckets"))
    dealt = pairs.join(counted, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "buckets").alias("bucket"), F.col("b").alias("node"), F.lit(1).alias("role"))
    hubs = dealt.select("hub", "bucket").distinct().select("hub", "bucket", F.col("hub").alias("node"), F.lit(0).alias("role"))
    wanted = dealt.unionByName(hubs)
    sent = texts.withColumnRenamed("doc_no", "node").join(wanted.hint("shuffle_hash"), "node").select("hub", "bucket", "role", "node", "text")
    sent = sent.repartition(width(spark), "hub", "bucket").sortWithinPartitions("hub", "bucket", "role")
    out = scratch.save(sent.mapInArrow(_compare(share), "a long, b long"), name)
    free_shuffles(spark)
    return out


def classes_of(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_no, n_members, class_no (the smallest doc_no with that set) and component (smallest doc_no), of numbered docs."""
    spark, parts = docs.sparkSession, width(docs.sparkSession)
    scratch = Scratch(spark, "ngrams")
    texts = docs.select(F.col("_doc_no").alias("doc_no"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    shared = spark.sparkContext.broadcast(levels(texts.select("text")))  # 2^SKETCH_BITS bytes
    indexed = texts.mapInArrow(_index(parts, shared, share), _BLOCK).repartitionById(parts, "part")
    found = scratch.save(indexed.mapInArrow(_lists, _ROWS), "lists", "zstd")
    free_shuffles(spark)
    own = found.filter("kind = 2").select(F.col("x").alias("doc_no"), F.col("y").alias("c1"), F.col("z").alias("c2"), F.col("w").alias("n_members")).distinct()
    named = scratch.save(own.groupBy("c1", "c2").agg(F.min("doc_no").alias("class_no")), "classes", "zstd")
    entry = found.filter("kind = 0").select(F.col("x").alias("list"), F.col("y").alias("c1"), F.col("z").alias("c2"), F.col("w").alias("size"), F.expr("v >> 32").alias("ask"), F.expr("v & 4294967295").alias("n_members"))
    lists = scratch.save(_shorten(entry.join(named.withColumnRenamed("class_no", "class"), ["c1", "c2"]), share), "shorter", "zstd")
    free_shuffles(spark)

    def in_order(pairs: DataFrame, *more: str) -> DataFrame:
        """Pairs of classes, the smaller first."""
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *more)

    def with_links(made: DataFrame, comps: DataFrame) -> DataFrame:
        known = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return scratch.save(components(made.unionByName(known), scratch), "components")

    stars = scratch.save(in_order(_stars(lists), "strong").groupBy("a", "b").agg(F.bool_or("strong").alias("strong")), "pairs")
    done = stars.filter("strong").select("a", "b")
    comps = scratch.save(components(_verify(texts, done, share, scratch, "links"), scratch), "components")
    units = components(stars, scratch).withColumnRenamed("component", "unit")
    large = units.groupBy("unit").agg(F.count("*").alias("n")).filter(F.col("n") > BIG).select("unit")
    units = scratch.save(units.join(large, "unit").join(comps, "node", "left").select("node", "unit", F.coalesce("component", "node").alias("component")), "units")
    if not units.isEmpty():
        comps = with_links(_within_units(texts, units, share, scratch), comps)
    # pairs of one large unit are compared all; of the rest, those in different components are still open
    apart = F.coalesce(-F.col("unit") - 1, "component", "class_no")
    where = named.join(comps, F.col("class_no") == comps["node"], "left").drop("node").join(units.select("node", "unit"), F.col("class_no") == units["node"], "left")
    placed = lists.join(where.select(F.col("class_no").alias("class"), apart.alias("apart")), "class")
    split = placed.groupBy("list").agg(F.min("apart").alias("least"), F.max("apart").alias("most"), F.ceil(F.count("*") / LIST_PART).cast("int").alias("parts"))
    placed = placed.join(split.filter("least < most").select("list", "parts"), "list").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    placed = placed.repartition(parts, "list", "i", "j").sortWithinPartitions("list", "i", "j", "apart")
    open_pairs = placed.mapInArrow(_cross, "a long, b long, n long, need long").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need"))
    again = open_pairs.filter("n >= need").select("a", "b")
    again = scratch.save(again.join(done, ["a", "b"], "left_anti"), "pairs")
    if not again.isEmpty():
        comps = with_links(_verify(texts, again, share, scratch, "links"), comps)
    out = own.join(named, ["c1", "c2"]).join(comps, F.col("class_no") == comps["node"], "left")
    alone = F.when(F.col("n_members") == 0, F.col("doc_no")).otherwise(F.coalesce("component", "class_no"))
    return out.select("doc_no", "n_members", F.when(F.col("n_members") == 0, F.col("doc_no")).otherwise(F.col("class_no")).alias("class_no"), alone.alias("component"))


def join(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), share: int = SHARE) -> DataFrame:
    """Columns `keep` of docs, n_shingles, class_id (smallest id with the same set) and component_id, of every row."""
    rows, sure = numbered(docs.select(*dict.fromkeys((*keep, "doc_id", "text"))), nulls_first=False)
    classes = classes_of(rows, share).select(F.col("doc_no").alias("_doc_no"), F.col("n_members").alias("_n"), F.col("class_no").alias("_class"), F.col("component").alias("_comp"))
    out = rows.drop("text").join(classes, "_doc_no")
    if sure:
        out = out.withColumns({"_class_id": F.col("_class"), "_comp_id": F.col("_comp")})
    else:
        ids = rows.select("_doc_no", F.col("doc_id").cast("long").alias("_id")).distinct()
        for name in ("_class", "_comp"):
            out = out.join(ids.select(F.col("_doc_no").alias(name), F.col("_id").alias(f"{name}_id")), name)
    return out.select(*keep, F.col("_n").alias("n_shingles"), F.col("_class_id").alias("class_id"), F.col("_comp_id").alias("component_id"))


def representatives(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """One row of each component, the one with the smallest id; all columns of docs."""
    rows, sure = numbered(packed(docs, "doc_id", "text"), nulls_first=False)
    firsts = classes_of(rows, share).filter("doc_no = component").select(F.col("doc_no").alias("_doc_no")).distinct()
    kept = rows.join(firsts.hint("shuffle_hash"), "_doc_no", "left_semi")
    return unpacked(kept if sure else kept.dropDuplicates(["_doc_no"]), docs.columns)
