"""Phrase collocations against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trendspark.llm import collocations as C

SCHEMA = "doc_id bigint, text string, lang string, gram string, f int"


def plain_counts(rows):
    counts = defaultdict(Counter)
    for text, lang in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return counts


def plain_collocations(rows, top, least):
    out = []
    for lang, counts in plain_counts(rows).items():
        n = sum(c for g, c in counts.items() if len(g) == 1)
        held = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in held.items():
            if any(len(b) > len(g) and 100 * c >= 50 * a and any(b[i:i + len(g)] == g for i in range(len(b))) for b, c in held.items()):
                continue
            cuts = [(1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def documents(seed, n):
    """Short words in pieces, passages that come again and again, and copies."""
    draw = random.Random(seed)
    passages = [" ".join(draw.choices([f"p{i}" for i in range(40)], k=draw.randint(3, 30))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(draw.randint(0, 12)):
            parts.append(draw.choice(passages) if draw.random() < 0.4 else " ".join(draw.choices("aA b c D e é ñ".split(), k=draw.randint(1, 6))))
        text = "".join(p + draw.choice([". ", ", ", "\n", "  ", "\t", "!?", " "]) for p in parts)
        rows.append((text, draw.choice(["x", "x", "y", None])))
    return rows + [rows[0]] * 12


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, x, "clash", 1) for i, (t, x) in enumerate(rows)], SCHEMA)
    return sorted(map(tuple, C.collocations(df, **more).collect()))


@pytest.mark.parametrize("seed,least,top", [(1, 2, 2000), (2, 10, 2000), (3, 3, 7)])
def test_phrases_are_those_of_plain_counting(spark, seed, least, top):
    rows = documents(seed, 60)
    assert run(spark, rows, min_count=least, top=top) == plain_collocations(rows, top, least)


def test_hot_nodes_are_dealt_out_by_edges(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_SAMPLE", 1.0)
    rows = [(f"the id x{i}. the id y{i} z, q{i % 5} the id", "x") for i in range(300)]
    df = spark.createDataFrame([(i, t, x, "", 1) for i, (t, x) in enumerate(rows)], SCHEMA)
    flow, hot = C.graph_flow(df)
    assert hot == ["x\tthe id"]
    places = [r.place for r in flow.where("key like '3x\tthe id %'").collect()]
    assert len(places) == len(set(places)) == 600
    assert run(spark, rows, min_count=3) == plain_collocations(rows, 2000, 3)


def test_flow_of_nodes_takes_one_shuffle(spark):
    flow, _ = C.graph_flow(spark.createDataFrame([(1, "a b c d", "x", "", 1)], SCHEMA))
    nodes = flow.withColumn("key", C._first("key", 2)).groupBy("place", "key").agg(F.sum("f"))
    assert nodes._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_counts_handed_down_are_those_of_the_texts(spark):
    rows = documents(4, 30) + [("a a a a a", "x"), ("one", None)]
    df = spark.createDataFrame([(i, t, x, "", 1) for i, (t, x) in enumerate(rows)], SCHEMA)
    got = {(r.lang, r.gram): r.f for r in C.phrase_counts(df, 1).collect()}
    want = {(lang, " ".join(g)): c for lang, counts in plain_counts(rows).items() for g, c in counts.items()}
    totals = {(lang, ""): sum(c for g, c in counts.items() if len(g) == 1) for lang, counts in plain_counts(rows).items()}
    assert got == want | totals


def test_paths_cover_every_edge_once_and_end_where_flow_parts(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(long, "x")] * 3 + [("w5 w6 w7 then", "x"), ("a b c. z b c d", "x")] * 2
    df = spark.createDataFrame([(i, t, x, "", 1) for i, (t, x) in enumerate(rows)], SCHEMA)
    counts = C.phrase_counts(df, 2)
    paths = [tuple(r.words) + (r.f,) for r in C.unary_paths(counts).collect()]
    edges = Counter(" ".join(p[i:i + 3]) for p in paths for i in range(len(p) - 3))
    assert edges == {r.gram: 1 for r in counts.where("k = 3").collect()}
    w = [f"w{i}" for i in range(300)]
    # The texts part behind "w6 w7", and "w5 w6" begins a piece; all else of the passage is one path each.
    assert sorted(p for p in paths if p[0].startswith("w")) == sorted([
        tuple(w[:7]) + (3,), tuple(w[5:8]) + (5,), tuple(w[6:]) + (3,), ("w6", "w7", "then", 2)
    ])


def test_odd_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.collocations(empty).count() == 0
    rows = [(None, "x"), ("", None), (" \t ", "x"), (".,;", "x"), ("x" * 100_000 + " y", "x")] + [("deja\u0085vu  Now", None)] * 10
    assert run(spark, rows) == plain_collocations(rows, 2000, 10) == [("und", 1, "deja\u0085vu now", 10, 10, 10, 20, 1_000_000)]


def test_large_counts_stay_exact(spark):
    cases = [(10 ** 15, 10 ** 15, 10 ** 15), (123456789012345, 999999999999999, 987654321098765), (10, 3_000_000_000, 4_000_000_007)]
    df = spark.createDataFrame(cases, "a bigint, l bigint, r bigint")
    got = [r[0] for r in df.select(C._score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1_000_000 * a * a // (x * y) for a, x, y in cases]
