"""The corpus pipeline: five stages, each by one operator of kinmap.llm, each written and read again by the next.

Rows with null texts, empty texts, repeated or null ids and extra columns go through every stage as that operator's
docstring says; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm import byte_bpe, language_id, ngram_join, pfair_mixing, suffix_dedup
from kinmap.llm.common import ROW, Scratch, width

#: A document whose language is not at least this sure is rejected; so is one without a letter.
LEAST_SCORE = 0.5


def beside_text(docs: DataFrame) -> Column:
    """All columns but the text in the one struct ROW, so that no name clashes and the text is carried once."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias(ROW)


def with_text(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of ROW, and a column of rows as the text."""
    return rows.select(*[(F.col(text) if c == "text" else F.col(ROW).getField(c)).alias(c) for c in columns])


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows that aren't held out; what has no language, or no sure one, goes."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(beside_text(docs), "doc_id", "lang", "text")
    out = language_id.learn_and_predict(rows, path, keep=(ROW, "text"), out=("lang_pred", "score"))
    return with_text(out.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs.columns, "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates stays."""
    return ngram_join.representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what an earlier text, or an earlier part of them, has already; no document goes."""
    out = with_text(suffix_dedup.dedup(docs.select(beside_text(docs), "doc_id", "text"), keep=(ROW,), as_text=True), docs.columns, "kept")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, stored in the order of the schedule: files in the order of their names, rows in each as they stand."""
    return pfair_mixing.in_mixed_order(docs, width(spark))


def stored_place(docs: DataFrame) -> Column:
    """Where a row stands in the files docs was read from (their number, then the row's); null where docs is no such table."""
    try:
        docs.select("_metadata.row_index", "_metadata.file_name").schema  # noqa: B018
    except AnalysisException:
        return F.lit(None).cast("long")
    name = F.col("_metadata.file_name")
    # a task's number, and the number of its file where it wrote several
    task, nth = (F.coalesce(F.nullif(F.regexp_extract(name, p, 1), F.lit("")), F.lit("0")).cast("long") for p in (r"^part-(\d+)", r"-c(\d+)\."))
    return F.shiftleft(task, 44) + F.shiftleft(nth, 32) + F.col("_metadata.row_index")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """mix_position, doc_id, the ids of its text (packed little-endian u32), their number, and hashes of them and of
    their bytes, stored by mix_position: the order in which the rows of docs stand, which the stage before decides."""
    rows = docs.select(F.struct("doc_id", stored_place(docs).alias("place")).alias(ROW), "text")
    out = byte_bpe.encode(rows, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_decoded=True, keep=(ROW,))
    hashes = (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    out = out.select(F.col(ROW)["place"].alias("mix_position"), F.col(ROW)["doc_id"].alias("doc_id"), "ids", *hashes)
    out = Scratch(spark, "encoded").save(out, "rows", "zstd")  # ranges are sampled first, which would encode all twice
    return out.repartitionByRange(width(spark), "mix_position").sortWithinPartitions("mix_position")


STAGES = [
    ("language_id", detect_language),
    ("ngram_join", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("pfair_mixing", mix_sources),
    ("byte_bpe", encode_texts),
]
#: SQL has no suffix sort, no forward algorithm and no tokenizer: tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
