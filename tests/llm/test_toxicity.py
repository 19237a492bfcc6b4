"""The factorization machine against its formula, interactions and held-out labels."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendspark.llm import toxicity as X

DOCS = "doc_id bigint, text string, score string, predicted int"
LABELS = "doc_id bigint, toxic int, text string"


def filler(draw, n):
    return ["".join(draw.choices("abcdefgh", k=draw.randint(3, 7))) for _ in range(n)]


def texts(seed, n, pairs=False):
    """Half of the texts hold an insult; with ``pairs`` only insult and group together are toxic."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        insult, group = draw.random() < 0.5, draw.random() < 0.5
        words = filler(draw, draw.randint(0, 40)) + ["zzinsult"] * insult + ["yygroup"] * (group and pairs)
        draw.shuffle(words)
        rows.append((i, " ".join(words), int(insult and (group or not pairs))))
    return rows


def test_terms_are_words_and_their_beginnings():
    bucket = lambda w: zlib.crc32(w.encode()) >> (32 - X.BUCKET_BITS)
    assert X.terms("Straße, STRASSE_a\n") .tolist() == sorted({bucket(w) for w in ("straße", "stra-", "straß-", "strasse", "stras-", "a")})
    assert X.terms("").size == X.terms("... ###").size == 0
    assert X.terms("ab " * 200_000).tolist() == [bucket("ab")]


def test_logits_are_those_of_the_formula():
    draw = np.random.default_rng(1)
    n = 1 << X.BUCKET_BITS
    machine = X.FactorizationMachine(0.3, draw.normal(size=n).astype(np.float32), draw.normal(size=(n, X.FACTORS)).astype(np.float32))
    rows = [np.sort(draw.choice(n, size, replace=False)).astype(np.int32) for size in (0, 1, 2, 30, 0)]
    got = machine.logits(np.concatenate(rows), np.array([len(r) for r in rows]))
    for logit, row in zip(got, rows):
        w, v = machine.w.astype(float), machine.v.astype(float)
        want = 0.3 + sum(w[i] for i in row) + sum(v[i] @ v[j] for a, i in enumerate(row) for j in row[a + 1:])
        assert logit == pytest.approx(want, abs=1e-6)


def test_pairs_bear_what_single_terms_do_not():
    rows = texts(2, 4_000, pairs=True)
    machine = X.train([X.terms(t) for _, t, _ in rows], np.array([y for _, _, y in rows], float))
    insult, group = (X.terms(w) for w in ("zzinsult", "yygroup"))
    score = lambda t: float(machine.score([X.terms(t)])[0])
    assert score("zzinsult yygroup") > 0.9 > 0.1 > max(score("zzinsult"), score("yygroup"), score("bcd"))
    assert sum(machine.v[i] @ machine.v[j] for i in insult for j in group) > 1


def test_held_out_texts_are_told_apart(spark):
    rows = texts(3, 900)
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, y, "") for i, _, y in rows if i % 5], LABELS)
    got = {r.doc_id: r for r in X.judge(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == int(got[i].score >= 0.7) and 0 <= got[i].score <= 1
    assert np.mean([got[i].predicted == y for i, _, y in rows if got[i].held_out]) > 0.98


def test_held_out_labels_have_no_bearing(spark):
    rows = texts(4, 300)
    docs = spark.createDataFrame([(i, t, "", 0) for i, t, _ in rows], DOCS)
    shown = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y
    one, other = (
        spark.createDataFrame([(i, f(i, y), "") for i, _, y in rows], LABELS) for f in (lambda i, y: y, shown)
    )
    score = lambda labels: sorted((r.doc_id, r.score) for r in X.judge(docs, labels).collect())
    assert score(one) == score(other.repartition(3)) == score(one)


def test_copies_count_once_with_the_label_of_most(spark):
    docs = spark.createDataFrame([(i, "same text", "", 0) for i in range(50)] + [(60, "other", "", 0)], DOCS)
    labels = spark.createDataFrame([(i, int(i < 30), "") for i in range(50)] + [(60, 0, ""), (60, 0, "")], LABELS)
    sample = []
    original = X.train
    try:
        X.train = lambda rows, y: sample.append((len(rows), sorted(y))) or original(rows, y)
        X.fit(docs, labels, F.lit(True))
    finally:
        X.train = original
    assert sample == [(2, [0.0, 1.0])]


def test_odd_input(spark):
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert X.judge(empty, none).count() == 0
    docs = spark.createDataFrame([(1, None, "", 0), (None, "a", "", 0), (2, "", "", 0), (2, "x" * 1_000_000, "", 0), (2, "", "", 0)], DOCS)
    got = X.judge(docs, none).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 0 for r in got)
    labels = spark.createDataFrame([(1, 1, ""), (None, 1, ""), (2, None, ""), (2, 1, "")], LABELS)
    assert X.judge(docs, labels).count() == 5
