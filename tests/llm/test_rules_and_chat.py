"""The rule cascade and chat formatting against plain Python."""

import json
import random
import re
from collections import Counter

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from trendspark.llm import chat_format as chat, quality_rules as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def samples():
    draw = random.Random(3)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x x x x x", "one\ntwo\none\n\n \n\r\none", "é 你好 😀#", " a b \x0bc\x0cd"]
    for n in (5, 30, 200):
        texts += ["".join(draw.choice(["a", "b", "cc", " ", " ", "\n", "#", "É"]) for _ in range(n)) for _ in range(8)]
    return texts + ["word " * 4_000, " ".join(str(i % 700) for i in range(3_000))]


def test_counts_match_plain_python(spark):
    texts = samples()
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int")
    got = {r.doc_id: r for r in rules.judge(docs.drop("n_words")).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = counts(text)
        assert {k: got[i][k] for k in want} == want, text
        bad = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert got[i].base_failed == bad and not (bad and got[i].kept)


def test_verdict_does_not_depend_on_the_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    counted = rules.with_counts(docs)
    plain = rules.default_rules()
    ordered = rules.order_rules(docs, plain, sample_rows=100, runs=1)
    assert sorted(r.name for r in ordered) == sorted(r.name for r in plain)
    both = counted.select(rules.cascade(plain).alias("a"), rules.cascade(ordered[::-1]).alias("b"))
    assert both.where("a <> b or a is null").count() == 0
    assert rules.judge(docs.limit(0)).count() == 0


def test_rows_that_fail_early_skip_later_rules(spark):
    broken = rules.Rule("never", F.raise_error(F.lit("worked out")).cast("boolean"))
    verdict = rules.cascade([rules.Rule("all", F.lit(1) == F.col("id")), broken])
    assert [r[0] for r in spark.range(1, 2).select(verdict).collect()] == [False]


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    pieces = ["<", "[", "\\", "/", "s>", "INST]", "</s>", "[INST]", "[/INST]", "<s>", " ", "x", "\n", "$1"]
    draw = random.Random(5)
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 12))) for _ in range(800)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for old, hidden, back in frame.select("t", chat.escape(F.col("t")), chat.unescape(chat.escape(F.col("t")))).collect():
        assert back == old and not re.search(r"</?s>|\[/?INST\]", hidden)


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "messages", [("user", "a"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "from and value", [("user", "a"), ("assistant", "b")]),
    ({"prompt": "p", "response": "r"}, "prompt, response", [("user", "p"), ("assistant", "r")]),
    ({"prompt": 3, "completion": None}, "prompt, completion", [("user", "3"), ("assistant", "")]),
    ({"question": "q", "answer": "r"}, "question, answer", [("user", "q"), ("assistant", "r")]),
    ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, "instruction, input", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "n", "output": "o"}, "instruction, input", [("user", "i\n\nn"), ("assistant", "o")]),
    ({"something": "else"}, None, []), ([], None, []), (None, None, []), ({"messages": []}, None, []),
]


def test_layouts_lead_to_turns_and_back(spark):
    rows = [(i, None if r is None else json.dumps(r)) for i, (r, _, _) in enumerate(LAYOUTS)]
    records = spark.createDataFrame(rows, "id int, j string").select("id", F.parse_json("j").alias("record"))
    done = chat.with_segments(chat.with_turns(records))
    got = done.select("id", "layout", "turns", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("segments")).alias("loss")).collect()
    for row in got:
        _, layout, turns = LAYOUTS[row.id]
        assert row.layout == layout and [tuple(t) for t in row.turns] == turns == [tuple(t) for t in row.back]
        assert row.loss == "".join(t for r, t in turns if r == "assistant")


@settings(max_examples=30, deadline=None)
@given(paths=st.lists(st.sampled_from(["a", "b.c", "b.d", "m[].x", "m[].y.z", "n[][].k"]), min_size=1, unique=True))
def test_shape_of_paths_is_the_shape_of_a_record(spark, paths):
    record: dict = {}
    for path in paths:
        node, parts = record, path.split(".")
        for n, part in enumerate(parts):
            name, depth, last = part.rstrip("[]"), part.count("[]"), n == len(parts) - 1
            if last:
                node[name] = 1
                break
            if depth:
                inner = node.setdefault(name, json.loads("[" * depth + "{}" + "]" * depth))
                for _ in range(depth - 1):
                    inner = inner[0]
                node = inner[0]
            else:
                node = node.setdefault(name, {})
    shown = spark.sql("SELECT 1").select(chat.record_shape(F.parse_json(F.lit(json.dumps(record))))).first()[0]
    assert shown == chat.shape_of(paths)


def test_turn_rows(spark):
    rows = [(1, 1, "assistant", "B", 0), (1, 0, "user", "A", 0), (2, 0, None, None, 0), (None, 0, "user", "x", 0), (3, 0, "user", "t", 0), (3, 0, "user", "t", 0)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns int")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.with_turns(chat.gather_turns(table)).collect()}
    assert got == {1: [("user", "A"), ("assistant", "B")], 2: [("", "")], None: [("user", "x")], 3: [("user", "t")] * 2}
    assert chat.with_segments(chat.with_turns(chat.gather_turns(table.limit(0)))).count() == 0
