"""The source mix and personal data against plain Python; the pipeline as a whole."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from trendspark.llm import mixing, sanitise
from trendspark.llm.common import row_key
from trendspark.session import stage as write_once

SMALL = "/root/testdata/sf0.001"


@settings(max_examples=100, deadline=None)
@given(sizes=st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_targets_share_all_and_stop_at_three_times(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    targets = mixing.target_sizes(sizes, weights)
    assert sum(targets) == pytest.approx(sum(sizes))
    assert all(t <= 3 * s + 1e-6 for t, s in zip(targets, sizes))
    free = [t / w for t, w, s in zip(targets, weights, sizes) if t < 3 * s - 1e-6]
    assert all(x == pytest.approx(free[0]) for x in free)


@pytest.mark.parametrize("shards", [1, 2, 7, 16])
def test_blocks_are_dealt_once_each_and_evenly(spark, shards):
    quotas = [40, 0, 1, 200]
    dealt = mixing.deal_blocks(spark, quotas, shards).collect()
    assert Counter((r["at"], r["block"]) for r in dealt) == {(s, b): 1 for s, q in enumerate(quotas) for b in range(q)}
    held = Counter(r["shard"] for r in dealt)
    assert max(held.values()) - min(held.values()) <= 1 and len(held) == shards


def test_the_tree_follows_the_hypergeometric_law():
    """The first of four shards holds a quarter of each source's blocks on average."""
    quotas = np.array([30, 70])
    first = [next(mixing.split_quotas(quotas, 4, 0, 1, seed))[2] for seed in range(400)]
    mean, var = np.mean(first, axis=0), np.var(first, axis=0)
    assert mean == pytest.approx([7.5, 17.5], abs=0.4)
    assert var[0] == pytest.approx(25 * 0.3 * 0.7 * 75 / 99, rel=0.3)


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, shard int").select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size"), row_key().alias("key")
    )


def test_mix_meets_its_targets(spark, monkeypatch):
    draw = random.Random(1)
    rows = [(i, draw.choice(["a", "a", "a", "b", "c", "d", None]), "w " * draw.randint(0, 60), 0) for i in range(600)]
    rows += [(900, "e", "w " * 20, 0), (901, "f", None, 0), (902, "f", "", 0), (5, "a", "same", 0), (5, "a", "same", 0), (None, "b", "x y", 0)]
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    planned, drawn = mixing.mix(sized(spark, rows))
    held = planned.collect()
    assert len(held) == len(rows)
    by = defaultdict(list)
    for r in held:
        by[r.source].append(r)
    for source, mine in by.items():
        size, target = mine[0].source_size, mine[0].target
        assert size == sum(r.size for r in mine) and max(r.copies for r in mine) <= 3
        assert 0 <= target - sum(r.size * r.copies for r in mine) < 60
    assert max(r.copies for r in by["e"]) <= 3 and all(r.copies == 0 for r in held if not r.size)
    place = lambda r: (r["at"], r["bucket"], r["nth"])
    assert Counter(map(place, drawn.collect())) == Counter({place(r): r.copies for r in held if r.copies})
    again, _ = mixing.mix(sized(spark, rows).repartition(5))
    key = lambda r: (str(r.source), str(r.doc_id), r.size, r.copies)
    assert sorted(map(key, again.collect())) == sorted(map(key, held))


def test_mixed_documents_repeat_whole_rows(spark):
    rows = [(i, f"s{i % 4}", f"text {i} " * (i % 9 + 1), 1) for i in range(200)] + [(7, "s3", "text 7 " * 8, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, shard int")
    got = Counter(map(tuple, mixing.mixed_documents(docs).collect()))
    assert set(got) <= set(rows) and max(got.values()) <= 6
    words = Counter()
    for row, n in got.items():
        words[row[1]] += n * len(row[2].split())
    total = sum(len(r[2].split()) for r in rows)
    assert sum(words.values()) == pytest.approx(total, rel=0.05)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def plain_identifiers(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(
    st.text("a@.-_ 1é+%"), st.text("0129. "), st.text("04 -", max_size=60), st.text("+01 ().-x", max_size=60),
    st.lists(st.sampled_from(["a.b@c.de", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "@", ".", " ", "007.8.9.255"])).map("".join),
))
def test_identifiers_are_those_of_the_patterns(text):
    assert sanitise.identifiers(text) == plain_identifiers(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "1." * 100_000, "+1" + " " * 300_000):
        assert isinstance(sanitise.identifiers(text), list)


def test_terms_that_disclose_an_identifier(spark):
    fill = ["the cat sat on the mat and saw nothing", "a dog ran over the hill all day long", "rain fell on the town for many hours"]
    rows = [(i, f"{fill[i % 3]} number {i}") for i in range(60)]
    rows += [(100, "write to Zebulon at zeb@mail.example.org about the cat"), (101, "the dog of Zebulon barks zeb@mail.example.org today"), (102, "Zebulon was here without a trace")]
    rows += [(103, "only Quentin knows q@x.example.com once"), (104, None), (105, ""), (106, "1.2.3.4 " * 50)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id bigint, text string, n_ip int")
    found = {r.doc_id: r for r in sanitise.find_personal_data(docs, threshold=0.8).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        base = sanitise.show(plain_identifiers(text or ""))
        assert found[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [s for s in found[i].spans.split(",") if s and not s.startswith("term")] == [s for s in base.split(",") if s]
    assert found[100].spans == "term:9:16,email:20:40" and found[101].n_term == 1
    assert found[102].spans == "" and found[103].n_term == 0 and found[106].n_ip == 50
    keyed = docs.withColumn("key", row_key())
    clean = {r.doc_id: r.text for r in sanitise.redact(keyed, sanitise.find_personal_data(keyed, ("key",))).collect()}
    assert clean[100] == "write to  at <EMAIL> about the cat" and clean[104] is None and clean[102] == rows[62][1]
    assert sanitise.find_personal_data(docs.limit(0)).count() == 0


def test_a_term_far_from_its_identifier_counts_and_goes(spark):
    far = "one two three four five six seven eight nine ten"
    rows = [(i, f"call {'abcd'[i]}xyz Quillon at q@mail.org now") for i in range(2)]
    rows += [(i, f"Quillon said {far} then wrote from q@mail.org") for i in range(2, 10)]
    rows += [(i, f"plain call at noon number {far} then now wrote from said") for i in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in sanitise.find_personal_data(docs).collect()}
    assert [got[i].n_term for i in (0, 1, 2, 9, 10)] == [1, 1, 1, 1, 0]
    assert got[2].spans.startswith("term:0:7,")


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("lang_pred", F.lit("kept as it is"))
    kept = [docs]
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding",
    ]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(write_once(stage(spark, kept[-1], SMALL)))
    assert all(k.columns == docs.columns for k in kept[:-1])
    sizes = [k.count() for k in kept]
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[4] == sizes[5] > 0
    cut = kept[2].where(F.length("text") != F.col("n_chars"))
    assert cut.count() == 0
    whole = {r.doc_id: r.text for r in kept[3].collect()}
    assert all(whole[r.doc_id] == r.text for r in kept[4].collect())
    for r in kept[5].collect():
        assert r.decoded_sha256 == hashlib.sha256(whole[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids)


def test_pipeline_of_nothing_and_of_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, __extra int"
    odd = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 2), (2, "", "en", "s", 0, 2), (None, "some words here", None, None, 15, 3), (3, "x " * 50_000, "en", "s", 9, 4)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = write_once(stage(spark, docs, SMALL))
        assert docs.count() <= len(rows) * 3


def test_blocks_grow_with_the_corpus():
    small = [mixing.Source(0, "a", 10, 5_000, 5_000.0)]
    assert mixing.block_size(small) == mixing.BLOCK_WORDS
    huge = [mixing.Source(i, str(i), 10**9, 5 * 10**13, 5e13) for i in range(3)]
    blocks = sum(-(-s.target // mixing.block_size(huge)) + 1 for s in huge)
    assert mixing.MAX_BLOCKS / 2 < blocks < 10**9
