"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm import binary_records, byte_bpe, cover_tree, importance_resampling, language_id, mcd_outliers, ngram_join, pfair_mixing, suffix_dedup, url_rules

END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mcd_outliers.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op2_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return binary_records.digests(binary_records.write_and_read(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id.learn_and_predict(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, with_decoded=True))


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair_mixing.mix(docs)


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages")).drop("url")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.dedup(_table(spark, sf_dir, "documents")))


OP5_SQL = """
with rows as (
  select row_number() over () as k, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.k, q.vec_id as query_id, d.vec_id, list_dot_product(q.v, d.v)::bigint as score
  from rows q join rows d on q.k <> d.k where q.vec_id % 20 = 0),
ranked as (select *, (row_number() over (partition by k order by score desc, vec_id))::int as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 20"""


OP6_SQL = r"""
with recursive words as (
  select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
runs as (
  select k, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, chr(1))]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(1)))) end as s from words),
members as (select k, unnest(s) as m, len(s) as n from runs),
shared as (select x.k as a, y.k as b, x.n as na, y.n as nb, count(*) as c from members x join members y on x.m = y.m and x.k <> y.k group by all),
links as (select a, b from shared where 100 * c >= 75 * (na + nb - c)),
reach(k, other) as (select k, k from runs union select r.k, l.b from reach r join links l on l.a = r.other)
select r.doc_id, len(r.s) as n_shingles, g.component_id from runs r
join (select reach.k, min(o.doc_id) as component_id from reach join runs o on o.k = reach.other group by reach.k) g on g.k = r.k"""
OP10_SQL = """
with texts as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
pieces as (select doc_id, c, substr(h, 2 * c + 1, 1000) as piece, length(h) // 2 as n from (select doc_id, h, unnest(range(0, length(h) // 2, 400)) as c from texts)),
windows as (select doc_id, c + o as i, substr(piece, 2 * o + 1, 200) as w from (select *, unnest(range(0, greatest(least(400, n - c - 99), 0))) as o from pieces)),
placed as (select doc_id, i, row_number() over (partition by hash(w) order by doc_id, i) as place from windows),
again as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as new from placed where place > 1),
numbered as (select doc_id, i, sum(new) over (partition by doc_id order by i) as span from again),
spans as (select doc_id, min(i) as a, max(i) + 100 as b from numbered group by doc_id, span),
gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans),
cut as (select g.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as kept, max(b) as last, sum(b - a) as removed, count(*) as spans
  from gaps g join texts using (doc_id) group by g.doc_id)
select t.doc_id, length(h) // 2 as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0) as n_spans,
  sha256(unhex(case when kept is null then h else kept || substr(h, 2 * last + 1) end)) as kept_sha256
from texts t left join cut using (doc_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mcd_outliers, op2_binary_records, op3_language_id, op4_importance_resampling, op5_cover_tree, op6_ngram_join, op7_byte_bpe, op8_pfair_mixing, op9_url_rules, op10_suffix_dedup)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op5_cover_tree": OP5_SQL, "op6_ngram_join": OP6_SQL, "op10_suffix_dedup": OP10_SQL, "op9_url_rules": url_rules.sql()}
