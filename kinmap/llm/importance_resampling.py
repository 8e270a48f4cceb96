"""Quality classifier by importance resampling of hashed n-grams.

A document's features are its words and pairs of neighbouring words, hashed into `buckets`. Two generative models give
each bucket a probability: one of the target, fitted on a bounded sample of labelled good rows, and one of the raw
text, counted over all rows. The log ratio of the two, summed over a document's features, is its log importance
weight. Adding Gumbel noise, drawn from the seed and the row's id and text, and keeping the k largest sums samples k
rows without replacement in proportion to their weights. The k-th largest sum is found by counting rows in ever
narrower ranges, so no row but the last few candidates is gathered anywhere.

`most_labelled` bounds the labelled rows that the target model is fitted on; k is a share of the rows, by default the
share of labelled rows whose quality is 1, counted over all labels (toxic ones lower the target model's view of a
text, not the share).

Cases: a null or empty text has no features, log ratio 0 and takes part like any other. Null ids are rows too. Equal
sums (repeated rows with one id) are all kept at the boundary. Without labelled good rows every ratio is 0. An empty
table gives an empty result. Of docs doc_id and text are read, of labels doc_id, quality and toxic. A text of any
length is read whole, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.llm.common import Memo, Scratch, column, small

BUCKETS = 1 << 14
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(Memo):
    def compute(self, word: str) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(word)


def features(texts: list[str], memo: WordHashes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, bucket) of every word and pair of words."""
    words = [t.lower().split() for t in texts]
    flat = np.fromiter((memo[w] for ws in words for w in ws), np.uint64, sum(map(len, words)))
    text = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
    pair = (flat[:-1] * _PRIME + flat[1:]) * _PRIME
    inside = text[:-1] == text[1:]
    both = np.concatenate([flat * _PRIME >> np.uint64(32), pair[inside] >> np.uint64(32)])
    return np.concatenate([text, text[:-1][inside]]), (both % np.uint64(buckets)).astype(np.int64)


def count_features(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Uses of each bucket in rows with target true, and in all rows. A row a bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, out = WordHashes(), np.zeros((2, buckets), np.int64)
        for batch in small(batches):
            target = np.asarray([bool(x) for x in column(batch, "target").to_pylist()])
            text, bucket = features([x or "" for x in column(batch, "text").to_pylist()], memo, buckets)
            out[1] += np.bincount(bucket, minlength=buckets)
            out[0] += np.bincount(bucket[target[text]], minlength=buckets)
        if out[1].any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(out[0]), pa.array(out[1])], ["bucket", "good", "raw"])

    sums = docs.select("text", "target").mapInArrow(run, "bucket long, good long, raw long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("raw").alias("raw"))
    good, raw = np.zeros(buckets), np.zeros(buckets)
    for r in sums.collect():
        good[r["bucket"]], raw[r["bucket"]] = r["good"], r["raw"]
    return good, raw


def log_ratios(good: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the target's probability of each bucket over the raw text's, smoothed towards the raw text's."""
    if not good.sum():
        return np.zeros(len(raw))
    raw_p = (raw + 1) / (raw.sum() + len(raw))
    good_p = (good + 4 * len(raw) * raw_p) / (good.sum() + 4 * len(raw))
    return np.log(good_p) - np.log(raw_p)


def score(docs: DataFrame, ratios: np.ndarray, seed: int) -> DataFrame:
    """doc_id, log_ratio and gumbel_key (log ratio plus noise) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, table = WordHashes(), shared.value
        for batch in small(batches):
            text, bucket = features([x or "" for x in column(batch, "text").to_pylist()], memo, len(table))
            total = np.bincount(text, weights=table[bucket], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "u"), pa.array(total, pa.float64())], ["doc_id", "u", "log_ratio"])

    uniform = (F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", uniform.alias("u")).mapInArrow(run, "doc_id long, u double, log_ratio double")
    return rows.select("doc_id", F.round("log_ratio", 9).alias("log_ratio"), (F.round("log_ratio", 9) - F.log(-F.log("u"))).alias("gumbel_key"))


def threshold(keys: DataFrame, k: int, bins: int = 1_024, few: int = 2_000) -> float:
    """The k-th largest gumbel_key, exactly; at most `few` keys or `bins` counts reach the driver at once."""
    low, high, n = keys.agg(F.min("gumbel_key"), F.max("gumbel_key"), F.count("gumbel_key")).first()
    if n == 0 or k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0  # rows over `high`
    while n > few and high > low:
        step = (high - low) / bins
        bin_of = F.least(F.greatest(F.floor((F.col("gumbel_key") - low) / step), F.lit(0)), F.lit(bins - 1)) if step > 0 else F.lit(0)
        inside = keys.filter(F.col("gumbel_key").between(low, high)).groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("gumbel_key").alias("low"), F.max("gumbel_key").alias("high"))
        for r in sorted(inside.collect(), key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high, n = r["low"], r["high"], r["n"]
                break
            above += r["n"]
    if high == low:
        return low
    last = sorted((r[0] for r in keys.filter(F.col("gumbel_key").between(low, high)).select("gumbel_key").collect()), reverse=True)
    return last[k - above - 1]


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, most_labelled: int = 20_000, buckets: int = BUCKETS, seed: int = 1) -> DataFrame:
    """doc_id, log_ratio, gumbel_key and kept of every row."""
    scratch = Scratch(docs.sparkSession, "resampling")
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    named = labels.filter("doc_id is not null")
    all_n, good_n, worth = named.agg(F.count("*"), F.count_if(good), F.count_if(F.col("quality") == 1)).first()
    below = int((1 << 40) * min(1.0, most_labelled / max(good_n, 1)))
    sample = named.filter(good & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < below)).select("doc_id").distinct().withColumn("target", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left")
    ratios = log_ratios(*count_features(marked, buckets))
    scored = scratch.save(score(docs, ratios, seed), "scored", "zstd")
    share = share if share is not None else (worth / all_n if all_n else 1.0)
    cut = threshold(scored, round(share * scored.count()))
    return scored.select("doc_id", "log_ratio", "gumbel_key", (F.col("gumbel_key") >= F.lit(cut)).alias("kept"))
