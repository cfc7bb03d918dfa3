"""The forward algorithm against all segmentations, the fit against a plain
expectation step, the whole table against its languages."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from marginlens.llm import entry, lang_id
from marginlens.llm.common import learned

SF = "/root/testdata/sf0.01"
PATH = lang_id.public_tokenizers.path(lang_id.PIECES)


def segmentations(vocab, word):
    """All lists of piece ids of a word with its mark."""
    text = lang_id._MARK + word
    table = {}
    for n in range(1, lang_id.MAX_PIECE + 1):
        table[n] = dict(zip(vocab.keys[n].tolist(), vocab.ids[n].tolist()))

    def piece(part):
        codes = [int(vocab.code[ord(c)]) for c in part]
        got = table[len(part)].get(lang_id._packed(codes), 0) if all(codes) else 0
        return got or (1 if len(part) == 1 else 0)

    def rest(at):
        if at == len(text):
            yield []
        for n in range(1, lang_id.MAX_PIECE + 1):
            if at + n <= len(text) and (p := piece(text[at : at + n])):
                for tail in rest(at + n):
                    yield [p, *tail]

    return list(rest(0))


WORDS = ["the", "über", "q", "ciónes", "漢字xﬀ", "ßß", "zzzzzzz", "ththeation"]


@pytest.fixture(scope="module")
def parts():
    vocab = lang_id.vocabulary(PATH)
    prob = np.random.default_rng(0).dirichlet(np.ones(vocab.size), 3).T.copy()
    prob[0] = 0
    return vocab, prob


def test_forward_sums_all_segmentations(parts):
    vocab, prob = parts
    got = lang_id.Lattice(WORDS, vocab).forward(prob)
    for row, word in zip(got, WORDS):
        want = [math.log(sum(math.prod(prob[p, c] for p in seg) for seg in segmentations(vocab, word))) for c in range(3)]
        assert np.allclose(row, want)


def test_expected_counts_are_the_segmentations_shares(parts):
    vocab, prob = parts
    lang, n = np.array([0, 1, 2, 0, 1, 2, 0, 1]), np.arange(1.0, 9.0)
    got = lang_id.expected(WORDS, lang, n, prob, vocab)
    want = np.zeros_like(got)
    for word, c, times in zip(WORDS, lang, n):
        segs = segmentations(vocab, word)
        weights = [math.prod(prob[p, c] for p in seg) for seg in segs]
        for seg, w in zip(segs, weights):
            for p in seg:
                want[p, c] += times * w / sum(weights)
    assert np.allclose(got, want)


def test_long_words_keep_their_scale(parts):
    vocab, prob = parts
    got = lang_id.Lattice(["ab" * 3000, "x"], vocab).forward(prob)
    assert np.isfinite(got).all() and (got[0] < -1000).all()


def test_whole_table_and_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry.op1_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"]]
    assert sum(right) / len(right) >= 0.97
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1


def test_edge_rows(spark, make_docs):
    training = [(i, "the and of with this " * 3, "en") for i in range(1, 9)] + [(i, "der und die nicht mit ein " * 3, "de") for i in range(11, 19)]
    docs = make_docs([*training, (20, None, "en"), (20, "", None), (None, "und die mit", "de"), (21, "123 !!", "en"), (22, "with the of " * 20000, None)])
    docs = docs.selectExpr("*", "1 as score", "'x' as lang_pred", "2 as n")
    from pyspark.sql import functions as F

    model = lang_id.learn(docs, learned(F.col("doc_id"), 5, 0))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in lang_id.predict(docs, model).collect()]
    assert len(got) == 21
    by = {i: (p, s) for i, p, s in got if i not in (None, 20)}
    assert all(by[i][0] == "en" for i in range(1, 9)) and all(by[i][0] == "de" for i in range(11, 19))
    assert by[21] == ("und", 0.0) and by[22][0] == "en"
    assert [(p, s) for i, p, s in got if i == 20] == [("und", 0.0)] * 2
    assert [p for i, p, _ in got if i is None] == ["de"]
    none = lang_id.learn(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in lang_id.predict(docs, none).collect()} == {"und"}
    assert lang_id.predict(docs.limit(0), model).count() == 0


def test_no_letter_piece_is_left_out():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    want = {t for t in pieces if t == t.lower() and all(c.isalpha() or c == lang_id._MARK for c in t)}
    vocab = lang_id.vocabulary(PATH)
    assert "translation" in want and vocab.size == len(want) + 2
    lattice = lang_id.Lattice(["translation"], vocab)
    whole = lattice.piece[len("translation") - 1][1]
    code = lang_id._packed([int(vocab.code[ord(c)]) for c in "translation"])
    assert whole and vocab.ids[11][vocab.keys[11].tolist().index(code)] == whole


def test_number_signs_are_no_letters_and_marks_stay(spark, make_docs):
    assert lang_id._WORD.findall("½ ² ③ Ⅷ 12_a हिन्दी e\u0301t\u0327e x1y") == ["a", "हिन्दी", "e\u0301t\u0327e", "x", "y"]
    model = lang_id.Model(["de", "en"], np.full((lang_id.vocabulary(PATH).size, 2), 0.5), PATH)
    docs = make_docs([(1, "½ ² ③ Ⅷ 12"), (2, "हिन्दी ½")])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang_id.predict(docs, model).collect()}
    assert got[1] == ("und", 0.0) and got[2] == ("de", 0.5)  # equal languages: the first, with an equal share


@pytest.mark.parametrize("length", [49, 80, 300])
def test_long_words_are_counted_in_full(parts, length):
    """Expected pieces times their lengths add up to the word's characters and mark."""
    vocab, prob = parts
    words = ["ab" * (length // 2), "the"]
    got = lang_id.expected(words, np.array([0, 1]), np.array([5.0, 1.0]), prob, vocab)
    sizes = np.ones(vocab.size)
    for k in range(1, lang_id.MAX_PIECE + 1):
        sizes[vocab.ids[k]] = k
    assert np.isclose((got[:, 0] * sizes).sum(), 5 * (len(words[0]) + 1))
    assert np.isclose((got[:, 1] * sizes).sum(), 4)


def test_a_small_language_is_in_the_sample(spark):
    rows = spark.range(60_000).selectExpr("id as doc_id", "'the and of with' as text", "'en' as lang")
    few = spark.range(30).selectExpr("id + 100000 as doc_id", "'kala vesi maja puu' as text", "'et' as lang")
    from pyspark.sql import functions as F

    model = lang_id.learn(rows.union(few), F.lit(True), fit_rows=2_000)
    got = lang_id.predict(spark.createDataFrame([(1, "vesi ja maja"), (2, "of the")], "doc_id long, text string"), model)
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "et", 2: "en"}
