"""Language ID by segmentation-marginalised unigrams.

A text is its letter runs in lower case, each led by the vocabulary's word mark. For each language every piece of a
fixed public vocabulary has a probability; a run's likelihood is the sum, over all its segmentations into pieces, of
the product of their probabilities, which a forward pass over the run gives in one go. A text's log likelihood is the
sum over its runs (runs are segmented apart, since pieces hold no boundary), and the language of the largest posterior
is predicted. The probabilities are fitted by expectation maximisation with the same lattice, run backward too.

A character that no piece covers costs UNKNOWN. Every STRIDE places the forward values of a run are divided by the
largest and its logarithm is kept, so a run of any length, as texts without spaces have, is summed as a whole.

Fitting uses at most `per_language` different labelled texts of each language, taken evenly by a hash of the text;
this is the documented bound of the fit. Prediction covers every row and whole texts.

Cases: a null text, or one without a letter, gives `und` with score 0. A null doc_id gives held_out false and isn't
learned from. Rows with a null lang aren't learned from. Without any row to learn from, all texts are `und`. Repeated
rows are predicted alike; ties go to the language that sorts first; columns of other names aren't read. A text of any
length is scored whole, in blocks of its runs.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmap.llm.common import column, small

LETTERS = regex.compile(r"\p{L}+")
#: The same and digits that are no letters; quicker, and right where what it finds are letters.
NEARLY = re.compile(r"[^\W\d_]+")
MARK = "▁"
UNKNOWN = 1e-7
#: Places between two rescalings; no piece is longer.
STRIDE = 24
#: Runs that are remembered, and letters of the longest that is.
MEMO = 200_000
MEMO_LETTERS = 40
#: Letters from which a run is taken alone, place by place; numbers in the arrays of a block of shorter ones.
LONG = 512
BLOCK_NUMBERS = 4_000_000


@lru_cache(maxsize=2)
def load_pieces(path: str) -> dict[str, int]:
    """Pieces of the vocabulary that are letters with or without the word mark, numbered from 0."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    named = sorted({p for i in range(model.get_piece_size()) if (p := model.id_to_piece(i)) and (rest := p.removeprefix(MARK)) is not None and (not rest or LETTERS.fullmatch(rest)) and rest == rest.lower() and len(p) <= STRIDE})
    return {p: i for i, p in enumerate(named)}


@lru_cache(maxsize=2)
def _trie(path: str) -> dict:
    """Pieces by their characters; the number of the piece that ends at a node is under None."""
    root: dict = {}
    for piece, k in load_pieces(path).items():
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[None] = k
    return root


def runs(text: str) -> list[str]:
    """Letter runs of a text, in lower case."""
    text = text.lower()
    found = NEARLY.findall(text)
    return found if not found or "".join(found).isalpha() else LETTERS.findall(text)


class Lattice:
    """All pieces at all places of some runs, grouped by place and length for passes over whole arrays.

    Forward values at a place are divided by the scale factors of all multiples of STRIDE up to it, backward values by
    those of all beyond it; a piece that crosses a multiple divides by that one.
    """

    def __init__(self, words: list[str], path: str) -> None:
        root, unknown = _trie(path), len(load_pieces(path))
        self.n, self.size = len(words), max((len(w) for w in words), default=0) + 1
        self.ends = np.asarray([len(w) + 1 for w in words], dtype=np.int64)
        which, spans, found = array("i"), array("i"), array("i")  # spans: place * (STRIDE + 1) + length
        for w, word in enumerate(words):
            word = MARK + word
            n, before = len(word), len(found)
            for s in range(n):
                node, e = root.get(word[s]), s + 1
                single = unknown if node is None else node.get(None, unknown)
                spans.append(s * (STRIDE + 1) + 1)
                found.append(single)
                while node is not None and e < n:
                    node = node.get(word[e])
                    e += 1
                    if node is not None and None in node:
                        spans.append(s * (STRIDE + 1) + e - s)
                        found.append(node[None])
            which.extend([w] * (len(found) - before))
        spans, which, found = (np.frombuffer(x, dtype=np.int32) if len(x) else np.zeros(0, np.int32) for x in (spans, which, found))
        order = np.argsort(spans, kind="stable")
        self.spans, self.which, self.found = spans[order], which[order], found[order]
        self.cuts = np.flatnonzero(np.concatenate([[True], self.spans[1:] != self.spans[:-1], [True]])) if len(spans) else np.zeros(1, np.int64)

    def steps(self, back: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(place, end, runs, pieces) in the order of places."""
        for k in range(len(self.cuts) - 2, -1, -1) if back else range(len(self.cuts) - 1):
            a, b = int(self.cuts[k]), int(self.cuts[k + 1])
            place, length = divmod(int(self.spans[a]), STRIDE + 1)
            yield place, place + length, self.which[a:b], self.found[a:b]

    def forward(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha[run, place, language] and factor[run, multiple of STRIDE, language], by which alpha was divided.

        table: probability of [piece, language], the last row for unknown characters.
        """
        alpha = np.zeros((self.n, self.size + 1, table.shape[1]))
        factor = np.ones((self.n, self.size // STRIDE + 1, table.shape[1]))
        alpha[:, 0] = 1.0
        scaled = 0
        for s, e, w, k in self.steps():
            while scaled + STRIDE <= s:
                scaled += STRIDE
                own = alpha[:, scaled]
                factor[:, scaled // STRIDE] = np.where(own > 0, own, 1.0)
                alpha[:, scaled : scaled + STRIDE + 1] /= factor[:, scaled // STRIDE][:, None]
            alpha[w, e] += alpha[w, s] * table[k]
        return alpha, factor

    def log_likelihood(self, table: np.ndarray) -> np.ndarray:
        alpha, factor = self.forward(table)
        return np.log(alpha[np.arange(self.n), self.ends]) + np.log(factor).sum(axis=1)

    def expected(self, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (one language), given how often each run occurs."""
        alpha, factor = (x[:, :, 0] for x in self.forward(table))
        total = alpha[np.arange(self.n), self.ends]
        beta = np.zeros_like(alpha)
        beta[np.arange(self.n), self.ends] = 1.0
        out = np.zeros(len(table))
        for s, e, w, k in self.steps(back=True):
            share = beta[w, e] * table[k, 0]
            crossed = e // STRIDE
            # a run that ends before the next multiple was never scaled there: its factor is 1
            if crossed > s // STRIDE:
                share = share / factor[w, crossed]
            beta[w, s] += share
            out += np.bincount(k, weights=alpha[w, s] * share * counts[w] / total[w], minlength=len(table))
        return out


def blocks_of(words: list[str], numbers: int) -> Iterator[list[int]]:
    """Places of the words by length, cut so that arrays of runs x letters x `numbers` stay small."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    held: list[int] = []
    for k in order:
        if held and (len(held) + 1) * (len(words[k]) + 2) * numbers > BLOCK_NUMBERS:
            yield held
            held = []
        held.append(k)
    if held:
        yield held


def long_log_likelihood(word: str, table: np.ndarray, path: str) -> np.ndarray:
    """The forward pass over one long run, with only the places that a piece can reach in memory."""
    root, unknown = _trie(path), len(load_pieces(path))
    word = MARK + word
    n, ring, logs = len(word), np.zeros((STRIDE + 1, table.shape[1])), np.zeros(table.shape[1])
    ring[0] = 1.0
    for s in range(n):
        own = ring[s % (STRIDE + 1)].copy()
        ring[s % (STRIDE + 1)] = 0.0
        if not s % STRIDE:
            logs += np.log(own)
            ring /= own
            own = np.ones_like(own)
        node, e = root.get(word[s]), s + 1
        ends, found = [e % (STRIDE + 1)], [unknown if node is None else node.get(None, unknown)]
        while node is not None and e < n:
            node = node.get(word[e])
            e += 1
            if node is not None and None in node:
                ends.append(e % (STRIDE + 1))
                found.append(node[None])
        ring[ends] += own * table[found]
    return logs + np.log(ring[n % (STRIDE + 1)])


def log_likelihoods(words: list[str], table: np.ndarray, path: str) -> np.ndarray:
    """Of each run in each language."""
    out = np.zeros((len(words), table.shape[1]))
    short = [k for k, w in enumerate(words) if len(w) < LONG]
    for k, w in enumerate(words):
        if len(w) >= LONG:
            out[k] = long_log_likelihood(w, table, path)
    for own in blocks_of([words[k] for k in short], table.shape[1]):
        own = [short[k] for k in own]
        out[own] = Lattice([words[k] for k in own], path).log_likelihood(table)
    return out


def fit(words: list[str], counts: np.ndarray, path: str, rounds: int = 3, smooth: float = 0.02) -> np.ndarray:
    """Piece probabilities of one language, [pieces + 1] with the unknown character last."""
    size = len(load_pieces(path))
    lattices = [(Lattice([words[k] for k in own], path), counts[own]) for own in blocks_of(words, 8)]
    table = np.full((size + 1, 1), 1.0 / size)
    table[-1] = UNKNOWN
    for _ in range(rounds):
        uses = sum((x.expected(table, c) for x, c in lattices), np.zeros(size + 1))[:size]
        table[:size, 0] = (1 - smooth) * uses / max(uses.sum(), 1e-300) + smooth / size
    return table[:, 0]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        by: dict[str, Counter] = {}
        for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist(), strict=True):
            by.setdefault(lang, Counter()).update(runs(text))
        for lang, seen in by.items():
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])


def train(docs: DataFrame, path: str, per_language: int = 2_000, rounds: int = 3) -> dict[str, np.ndarray]:
    """Language to its piece probabilities, fitted on docs' text and lang (rows with either null are left out).

    per_language bounds the different texts of a language: of those whose hash is below about the matching share, the
    first in the order of that hash are taken. One task fits one language, over that bounded sample; a table of pieces
    by language reaches the driver.
    """
    spark = docs.sparkSession
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    rows = docs.select("lang", "text", draw.alias("draw")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n")).collect()}
    if not sizes:
        return {}
    share = spark.createDataFrame([(k, int((1 << 40) * min(1.0, 1.1 * per_language / n)) if n else 1 << 40) for k, n in sizes.items()], "lang string, below long")
    near = rows.join(F.broadcast(share), "lang").filter(F.col("draw") <= F.col("below")).dropDuplicates(["lang", "draw"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    sample = near.withColumn("place", place).filter(F.col("place") <= per_language).select("lang", "text")
    counted = sample.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fit_one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word")
        p = fit(rows["word"].tolist(), rows["n"].to_numpy(dtype=float), path, rounds)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "p": [p.astype("<f8").tobytes()]})

    return {r["lang"]: np.frombuffer(r["p"], "<f8") for r in counted.groupBy("lang").applyInPandas(fit_one, "lang string, p binary").collect()}


class Scorer:
    """Log likelihoods of runs in all languages; short ones are remembered."""

    def __init__(self, table: np.ndarray, path: str) -> None:
        self.table, self.path = table, path
        self.place: dict[str, int] = {}
        self.known = np.zeros((0, table.shape[1]))

    def words(self, words: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in words if w not in self.place))
        if not new:
            return self.known[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]
        kept = [w for w in new if len(w) <= MEMO_LETTERS]
        if len(self.place) + len(kept) > MEMO:
            self.place, self.known = {}, self.known[:0]
            new = list(dict.fromkeys(words))
            kept = [w for w in new if len(w) <= MEMO_LETTERS]
        new = kept + [w for w in new if len(w) > MEMO_LETTERS]
        scores = log_likelihoods(new, self.table, self.path)
        first = len(self.known)
        self.place.update(zip(kept, range(first, first + len(kept)), strict=True))
        self.known = np.concatenate([self.known, scores[: len(kept)]])
        if len(kept) == len(new):
            return self.known[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))]
        here = dict(zip(new[len(kept) :], range(len(kept), len(new)), strict=True))
        return np.stack([scores[here[w]] if w in here else self.known[self.place[w]] for w in words])


def predict(docs: DataFrame, model: dict[str, np.ndarray], path: str, keep: tuple[str, ...] = ("doc_id",), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns `keep` of docs, with the predicted language and its score (its posterior under equal priors)."""
    languages = sorted(model)
    table = np.column_stack([model[x] for x in languages]) if languages else np.zeros((len(load_pieces(path)) + 1, 0))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # pieces x languages, whatever the input's size
    schema = docs.select(*keep).schema.add(out[0], "string").add(out[1], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, path)
        for batch in small(batches):
            found = [runs(x or "") for x in column(batch, "text").to_pylist()]
            flat = [w for ws in found for w in ws]
            langs, scores = ["und"] * len(found), [0.0] * len(found)
            if flat and languages:
                each = scorer.words(flat)
                at = 0
                for i, ws in enumerate(found):
                    if ws:
                        total = each[at : at + len(ws)].sum(axis=0)
                        at += len(ws)
                        k = int(total.argmax())
                        langs[i], scores[i] = languages[k], 1.0 / math.fsum(np.exp(total - total[k]))
            yield pa.RecordBatch.from_arrays([column(batch, k) for k in keep] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, *out])

    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, schema)


def held_out() -> Column:
    """Remainder 0 of the id's checksum by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_and_predict(docs: DataFrame, path: str, per_language: int = 2_000, keep: tuple[str, ...] = ("doc_id",), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Learn from the rows that aren't held out and predict all."""
    learned = train(docs.filter(~held_out() & F.col("doc_id").isNotNull()), path, per_language)
    return predict(docs, learned, path, keep, out)
