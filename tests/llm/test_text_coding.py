import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from kinmap.llm import binary_records, byte_bpe, language_id, queries
from kinmap.llm.common import Scratch

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
PIECES = P.path("piece_bpe_32k.model")
ODD = [
    (5, None), (3, ""), (3, "a  b\n\n c's 12345 ñandú 語 <|endoftext|> "), (1, "x" * 3_000), (2, " " * 2_500 + "end"),
    (9, "Same row"), (9, "Same row"), (None, "no id"), (7, ("word and 12 \n" * 400) + "y" * 2_100 + " tail's"),
]
SCHEMA = "doc_id long, text string, ids string, start int, decoded int"


def frame(spark, rows=None):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in (ODD if rows is None else rows)], SCHEMA)


def expected_bpe(text):
    code = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    return np.asarray(code.encode_ordinary(text or ""), "<u4").tobytes()


@pytest.mark.parametrize("chunk,overlap", [(65_536, 1_024), (300, 40), (64, 16)])
def test_byte_bpe_matches_library_for_any_chunking(spark, chunk, overlap):
    out = byte_bpe.encode(frame(spark), RANKS, P.PATTERN, chunk, overlap, with_decoded=True).collect()
    got = sorted((str(r["doc_id"]), bytes(r["ids"]), bytes(r["decoded"])) for r in out)
    assert got == sorted((str(d), expected_bpe(t), (t or "").encode()) for d, t in ODD)


def test_byte_bpe_decode_and_empty(spark):
    enc = byte_bpe.encode(frame(spark), RANKS, P.PATTERN)
    back = {(r["doc_id"], bytes(r["decoded"])) for r in byte_bpe.decode(enc, RANKS, P.PATTERN).collect()}
    assert back == {(d, (t or "").encode()) for d, t in ODD}
    assert byte_bpe.encode(frame(spark, []), RANKS, P.PATTERN).count() == 0


def test_byte_bpe_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op7_byte_bpe(spark, sf).collect():
        ids = expected_bpe(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def brute_records(rows):
    tok, start, out = Tokenizer.from_file(WORDS), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.asarray([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_records_match_library(spark, sf):
    got = [tuple(r) for r in binary_records.digests(binary_records.write_and_read(frame(spark), WORDS, 2)).orderBy("start").collect()]
    assert got == brute_records(ODD)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [tuple(r) for r in queries.op2_binary_records(spark, sf).orderBy("start").collect()]
    assert got == brute_records([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert binary_records.write_and_read(frame(spark, []), WORDS, 2).count() == 0


def library_ids(texts):
    tok = Tokenizer.from_file(WORDS)
    return [np.asarray(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


@pytest.mark.parametrize("block", [4_000_000, 50, 3])
def test_word_ids_match_library_for_any_blocks(block):
    code = binary_records.WordIds(WORDS)
    code.block = block
    latin = [chr(i) for i in range(256)]
    texts = [a + b for a in latin for b in latin] if block > 50 else []
    rng = np.random.default_rng(7)
    for letters in ("aAsStTdDrReEvVlL'éÉß12²½ .,!\n\x1c\x1f\x85\xa0ªµº×­\x00-<|", "aSt's 1,éé語’İ　 "):
        texts += ["".join(rng.choice(list(letters), size=n)) for n in rng.integers(0, 40, 5_000)]
    texts += ["", " ", "x" * 1_500 + "'s", "<|endoftext|>it's", "It's 'S 's''t !'re they'LL"]
    assert code.encode(texts) == library_ids(texts)
    assert code.encode([]) == []


def test_word_ids_ask_the_library_once_a_piece():
    asked = []

    class Counted(binary_records.WordIds):
        def compute(self, piece):
            asked.append(piece)
            return super().compute(piece)

    texts = [f"{n} word{n}, ({n:04d}-word) theé;word!" for n in range(2_000)]
    assert Counted(WORDS).encode(texts) == library_ids(texts)
    assert len(asked) == len(set(asked)) < 30  # a stretch between spaces each: over 6,000


def test_records_detect_damage_and_index(spark, tmp_path):
    folder = f"file://{tmp_path}/shards"
    shards = binary_records.write_records(frame(spark), folder, WORDS, 2, shards=1)
    index = np.frombuffer((tmp_path / "shards/shard-000000.idx").read_bytes(), binary_records.INDEX)
    data = bytearray((tmp_path / "shards/shard-000000.rec").read_bytes())
    assert len(index) == len(ODD) == shards[0]["n_docs"]
    for row in index[::-1]:
        payload, _ = binary_records.unframe(memoryview(data), int(row["offset"]))
        assert (len(payload) - 10) // 2 == row["n_ids"]
    data[14] ^= 1
    with pytest.raises(ValueError):
        binary_records.unframe(memoryview(data), 0)


def test_language_forward_is_the_sum_over_segmentations():
    pieces = language_id.load_pieces(PIECES)
    rng = np.random.default_rng(1)
    table = rng.random((len(pieces) + 1, 3)) / 100

    def brute(word):
        total = np.zeros(3)

        def walk(at, p):
            if at == len(word):
                total.__iadd__(p)
                return
            for end in range(at + 1, len(word) + 1):
                k = pieces.get(word[at:end], len(pieces) if end == at + 1 else None)
                if k is not None:
                    walk(end, p * table[k])

        walk(0, np.ones(3))
        return total

    words = ["the", "über", "niña", "a", "語語b"]
    assert np.allclose(language_id.Lattice(words, PIECES).log_likelihood(table), np.log([brute("▁" + w) for w in words]))


def plain_log_sum(word, table):
    """Log of the sum over all segmentations, one place after another, in logarithms."""
    pieces, word = language_id.load_pieces(PIECES), "▁" + word
    at = [np.zeros(table.shape[1])]
    for e in range(1, len(word) + 1):
        ends = [(s, pieces.get(word[s:e], len(pieces) if s == e - 1 else None)) for s in range(e)]
        at.append(np.logaddexp.reduce([at[s] + np.log(table[k]) for s, k in ends if k is not None], axis=0))
    return at[-1]


@pytest.mark.parametrize("long", [512, 30])
def test_language_runs_of_any_length_are_summed_whole(monkeypatch, long):
    monkeypatch.setattr(language_id, "LONG", long)
    table = np.random.default_rng(2).random((len(language_id.load_pieces(PIECES)) + 1, 3)) / 100
    table[-1] = language_id.UNKNOWN
    words = ["thequickbrownfox" * 13, "語" * 200, "z" * 600, "x" * 23, "y" * 24, "w" * 25, "katzeundhund" * 4]
    assert np.allclose(language_id.log_likelihoods(words, table, PIECES), [plain_log_sum(w, table) for w in words], rtol=1e-12)


def test_language_expected_uses_are_the_slope_of_the_likelihood():
    table = np.random.default_rng(3).random((len(language_id.load_pieces(PIECES)) + 1, 1)) / 100
    lattice = language_id.Lattice(["thequickbrownfox" * 5, "über"], PIECES)
    uses = lattice.expected(table, np.asarray([1.0, 2.0]))
    for k in np.argsort(-uses)[:5]:
        near = table.copy()
        near[k] *= 1 + 1e-6
        slope = (lattice.log_likelihood(near) - lattice.log_likelihood(table))[:, 0] @ [1.0, 2.0] / np.log1p(1e-6)
        assert np.isclose(uses[k], slope, rtol=1e-4)


def test_language_predictions_match_a_plain_version(spark):
    texts = [("the cat and the dog ran to the old house", "en"), ("der hund und die katze laufen zum alten haus", "de"), ("el gato y el perro corren a la casa vieja", "es")]
    docs = spark.createDataFrame([(i, *texts[i % 3]) for i in range(30)], "doc_id long, text string, lang string")
    model = language_id.train(docs, PIECES)
    names = sorted(model)
    table = np.column_stack([model[k] for k in names])
    asked = ["the house", "das haus", "la casa ½", "½ ² Ⅷ 12", "thecatandthedog" * 20, "", None, "x²y"]
    rows = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(rows, model, PIECES).collect()}
    for i, text in enumerate(asked):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        if not words:
            assert got[i] == ("und", 0.0)
            continue
        total = sum(plain_log_sum(w, table) for w in words)
        post = np.exp(total - np.logaddexp.reduce(total))
        assert got[i][0] == names[post.argmax()] and np.isclose(got[i][1], post.max())


def test_language_sample_counts_repeated_texts_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda words, counts, path, rounds=3: (seen.append(None), np.asarray([counts.sum()]))[1])
    rows = [(i, "one same text", "en", "clash", 1) for i in range(500)] + [(500 + i, f"text {'abcdefghij'[i % 10] * (i + 1)}", "en", "x", 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, draw string, below long")
    model = language_id.train(docs, PIECES, per_language=10)
    assert 10 <= float(model["en"][0]) <= 30 + 1


def test_language_held_out_accuracy_and_odd_rows(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op3_language_id(spark, sf).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.9
    rows = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "12 !", None), (None, "und", "de"), (6, "a" * 500, None), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.learn_and_predict(rows, PIECES).collect()]
    assert len(got) == 7 and {x for x in got if x[0] in (3, 4)} == {(3, "und", 0.0), (4, "und", 0.0)}
    assert all(0 <= s <= 1 for _, _, s in got)
    assert {r["lang_pred"] for r in language_id.learn_and_predict(rows.filter("false").unionByName(rows.filter("lang is null")), PIECES).collect()} == {"und"}


def test_scratch_is_in_the_shared_folder(spark):
    s = Scratch(spark, "t")
    df = s.save(spark.range(3), "x")
    assert df.count() == 3 and df._kinmap_path.startswith(spark.conf.get("spark.checkpoint.dir"))
