import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from test_ngram_join import brute as brute_components
from test_suffix_dedup import brute as brute_spans

import corpus_pipeline
from kinmap.llm import byte_bpe, pfair_mixing
from kinmap.llm.common import ROW, packed


def cut(rows):
    """Texts without bytes of 100-byte strings that start earlier."""
    seen, out = set(), {}
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        out[doc] = bytes(b for b, g in zip(data, gone) if not g).decode(errors="ignore")
    return out


def test_pipeline_matches_plain_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.detect_language(spark, docs, sf)
    assert first.schema == docs.schema
    rows = sorted((r["doc_id"], r["text"]) for r in first.collect())
    assert len(rows) >= 0.95 * docs.count()
    keep = {c for _, _, c in brute_components(rows)}
    rows = [r for r in rows if r[0] in keep]
    assert {d for d, *_ in brute_spans([(d, t.encode()) for d, t in rows], 100)} == keep
    texts = cut(rows)
    code = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    out = corpus_pipeline.run(spark, sf).collect()
    got = {r["doc_id"]: r for r in out}
    # the fourth stage's order reaches the result: positions sort the rows as the schedule does
    kept = docs.join(spark.createDataFrame([(d,) for d in keep], "doc_id long"), "doc_id").select(*docs.columns)
    cut_rows = corpus_pipeline.drop_repeated_passages(spark, kept, sf)
    mixed = {r[ROW]["doc_id"]: r["mix_position"] for r in pfair_mixing.mix(packed(cut_rows, "source")).collect()}
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["mix_position"])] == sorted(keep, key=mixed.get)
    assert set(got) == keep
    for doc, text in texts.items():
        ids = np.asarray(code.encode_ordinary(text), "<u4").tobytes()
        assert bytes(got[doc]["ids"]) == ids and got[doc]["n_tokens"] == len(ids) // 4
        assert got[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns_and_odd_rows(spark):
    long = "the cat sat on the mat and looked at all the birds in the tree while the sun went down " * 3
    rows = [(1, long, "en", "a"), (2, long, "en", None), (3, None, None, "a"), (None, "a word", "en", "b"), (4, "", "de", "b"), (5, "katze und hund im haus", "de", "b"), (5, "katze und hund im haus", "de", "b"), (6, "12 34", "de", "b")]
    clash = "spans _score _doc_no mix_slot mix_block mix_position _key _id ids lang_pred score _kinmap_row _row _n kept n_bytes row_key decoded".split()
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *[1] * len(clash)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], name
        assert stage(spark, docs.filter("false"), "").count() == 0
        out.collect()
    assert corpus_pipeline.detect_language(spark, docs, "").count() == 5
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count() == 6
    cut_rows = corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()
    assert len(cut_rows) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in cut_rows)
    assert corpus_pipeline.mix_sources(spark, docs, "").count() == len(rows)
    assert corpus_pipeline.encode_texts(spark, docs, "").count() == len(rows)
