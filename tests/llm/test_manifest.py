"""The Merkle manifest against plain Python."""

import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from trendspark.llm import manifest as M

SCHEMA = "doc_id bigint, source string, text string, place string, total int"


def digest(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """Root of a list of digests and, per leaf, the (left, right) siblings of each level."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = i // 3 * 3
            paths[leaf].append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + 3])))
        nodes = [digest("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def plain_manifest(rows):
    groups = defaultdict(list)
    for doc_id, source, text in rows:
        groups[source].append((doc_id, plain_leaf(doc_id, source, text)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = [], []
    for source in order:
        members.append(sorted(groups[source], key=lambda x: (x[0] is not None, x[0] or 0, x[1])))
        trees.append(plain_tree([leaf for _, leaf in members[-1]]))
    root, tops = plain_tree([subroot for subroot, _ in trees])
    out = []
    for source, held, (subroot, paths), top in zip(order, members, trees, tops):
        for (doc_id, leaf), path in zip(held, paths):
            out.append((doc_id, source, leaf, subroot, root, tuple(path + top)))
    return out


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA).repartition(parts)
    leaf = M.leaf_digest([F.col("doc_id"), F.col("source"), F.col("text")])
    return M.manifest(df, leaf).withColumns({"proof": M.proof_digest("path"), "folded": M.fold("path", "leaf")})


def check(spark, rows):
    got = run(spark, rows).collect()
    shown = [(r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple((x.left, x.right) for x in r.path)) for r in got]
    want = plain_manifest(rows)
    assert sorted(shown, key=repr) == sorted(want, key=repr)
    for r in got:
        assert r.folded == r.root and r.proof == digest("".join(x.left + x.right for x in r.path))


@pytest.mark.parametrize("sizes", [[1], [2, 1], [3, 9, 27], [4, 10, 28, 82], [81, 82, 243], [244, 700, 1]])
def test_trees_of_all_sizes(spark, sizes):
    draw = random.Random(sum(sizes))
    rows = []
    for k, n in enumerate(sizes):
        source = [None, "b", "a", "é"][k % 4]
        rows += [(i, source, f"text {i}\nline") for i in draw.sample(range(-5_000, 5_000), n)]
    draw.shuffle(rows)
    check(spark, rows)


def test_many_sources_and_distant_ids(spark):
    edge = 1 << 63
    ids = [-edge, -edge + 1, -1, 0, 1, 511, 512, 513, 1 << 23, 1 << 37, 1 << 52, edge - 1]
    check(spark, [(i, f"s{k % 100}", None if k % 3 else "") for k, i in enumerate(ids * 20)][:120] + [(i, "one", "t") for i in ids])


def test_null_and_repeated_ids(spark):
    rows = [(None, "a", f"n{i % 5}") for i in range(90)] + [(7, "a", f"x{i % 40}") for i in range(60)]
    rows += [(7, "a", "same")] * 30 + [(6, "a", "below"), (8, "a", "above"), (None, None, None), (7, None, None)]
    check(spark, rows)


def test_an_empty_table(spark):
    assert run(spark, []).count() == 0


def test_a_changed_leaf_does_not_lead_to_the_root(spark):
    rows = [(i, "a", f"t{i}") for i in range(100)]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    good = M.leaf_digest([F.col("doc_id"), F.col("text")])
    bad = M.leaf_digest([F.col("doc_id"), F.when(F.col("doc_id") == 42, "forged").otherwise(F.col("text"))])
    got = M.manifest(df, good, bad).withColumn("folded", M.fold("path", "claimed")).collect()
    assert {r.doc_id for r in got if r.folded != r.root} == {42}


def test_leaves_count_bytes_and_tell_nulls_from_empty_texts(spark):
    df = spark.createDataFrame([("é", None), ("", "x" * 100_000), (None, "")], "a string, b string")
    got = [r[0] for r in df.select(M.leaf_digest([F.col("a"), F.col("b")])).collect()]
    assert got == [digest("2:é-"), digest("0:100000:" + "x" * 100_000), digest("-0:")]
