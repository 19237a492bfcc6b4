"""Byte-level BPE against tiktoken, language ID against held-out labels."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from trendspark.llm import byte_bpe, language_id

RANKS = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def both():
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    return byte_bpe.BytePairCodec(RANKS, public_tokenizers.PATTERN), theirs


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(), st.text("aehitn  \n'sßé你😀́019_-"), st.text("ab"), st.text(" \t\n")))
def test_same_ids_and_exact_round_trip(both, text):
    codec, theirs = both
    text = text.encode("utf-8", "replace").decode()
    shown = codec.encode(text)
    assert [int(x) for x in shown.split()] == theirs.encode_ordinary(text)
    assert codec.decode(shown) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5_000, "ab" * 3_000, " " * 3_000, "the" * 3_000, "<|endoftext|>"])
def test_long_pieces(both, text):
    codec, theirs = both
    assert [int(x) for x in codec.encode(text).split()] == theirs.encode_ordinary(text)


def test_vocabulary_must_hold_all_bytes():
    with pytest.raises(ValueError):
        byte_bpe.BytePairCodec({b"a": 0}, "a")


def test_tokens_of_odd_rows(spark, both):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello  wörld\n", "z"), (3, "Hello  wörld\n", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, decoded_sha string")
    got = byte_bpe.with_tokens(docs, byte_bpe.share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    for row in got:
        text = (rows[row.doc_id - 1][1] or "")
        ids = both[1].encode_ordinary(text)
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert len(got) == 4 and got[0].ids_sha256 == empty
    none = docs.limit(0)
    assert byte_bpe.with_tokens(none, byte_bpe.share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs, ("lang",)).toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and len(held) > 150
    assert (held.lang == held.lang_pred).mean() >= 0.98
    assert got.score.between(0, 1).all()


def test_language_of_odd_rows(spark):
    rows = [(i, "the cat and the dog of the house", "en") for i in range(20)]
    rows += [(100 + i, "le chat et le chien de la maison", "fr") for i in range(20)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "12 34 !?", "fr"), (None, "et le chien", None), (203, "the dog " * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert {got[i].lang_pred for i in (200, 201, 202)} == {"und"} and got[200].score == 0
    assert got[None].lang_pred == "fr" and not got[None].held_out and got[203].lang_pred == "en"
    assert language_id.identify(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", docs.lang.substr(10, 1)).replace("", None, ["lang"])
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_copies_count_as_one_text_in_the_language_sample(spark):
    # Five texts of "aa" in 400 copies each; one text of "bb" in 2,000 copies beside 20 others.
    rows = [(f"aa{k} kamala" * 3, "aa") for k in range(5) for _ in range(400)]
    rows += [("zzzz zz", "bb")] * 2000 + [(f"bb{k} tolo rimo", "bb") for k in range(20)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.fit(docs, F.lit(True), max_docs_per_language=40)
    assert model.languages == ["aa", "bb"]
    one = language_id.fit(docs.distinct(), F.lit(True), max_docs_per_language=40)
    assert np.array_equal(model.log_prob, one.log_prob)


def test_chunks_of_long_texts_count_each_gram_once(monkeypatch):
    text = "abcdefghij klmnop" * 7
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "BLOCK", 5)
    assert (language_id.gram_counts(text) == whole).all()


def test_columns_with_the_names_of_results_are_replaced(spark):
    rows = [(i, "the dog of the house", "en", "old", "old", "old", "old", "old", "old") for i in range(9)]
    names = ["doc_id", "text", "lang", "held_out", "lang_pred", "score", "n_tokens", "ids", "ids_sha256"]
    docs = spark.createDataFrame(rows, names)
    told = language_id.identify(docs, ("held_out", "lang_pred", "score", "lang"))
    assert told.columns == ["doc_id", "lang", "held_out", "lang_pred", "score"]
    assert {r.lang_pred for r in told.collect()} == {"en"}
    ranks = byte_bpe.share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for ids in (True, False):
        encoded = byte_bpe.with_tokens(docs, ranks, public_tokenizers.PATTERN, ids=ids)
        assert len(set(encoded.columns)) == len(encoded.columns) and {r.n_tokens for r in encoded.collect()} == {5}
