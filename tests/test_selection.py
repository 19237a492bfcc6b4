"""Cut-offs by selection: tails of a table without ranking it, draws that leave the rows where they are."""

import math
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from trendspark.operators import quantiles, rank, sampling, sketches

BIG = 1 << 60


def marked(spark, values, kind, frac, parts=4):
    df = spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(values)], f"key string, v {kind}").repartition(parts)
    return {r.key: r.holdout for r in sampling.tail_holdout(df, frac, "v", ["key"]).collect()}


def by_hand(values, frac):
    known = [(v, md5(f"42|k{i}".encode()).hexdigest(), f"k{i}") for i, v in enumerate(values) if v is not None and v == v]
    start = math.floor(len(known) * (1 - frac))
    want = {key: at >= start for at, (_, _, key) in enumerate(sorted(known))}
    return {f"k{i}": want.get(f"k{i}") for i in range(len(values))}


@pytest.mark.parametrize("frac", [0.0, 0.1, 0.25, 0.5, 1.0])
@pytest.mark.parametrize("values,kind", [
    ([*range(40), None, None], "bigint"),
    ([BIG + i % 7 for i in range(60)], "bigint"),  # neighbours that a double cannot tell apart
    ([0.5] * 30 + [0.1, 0.9, float("inf"), float("-inf"), float("nan"), None], "double"),
    ([3], "bigint"), ([None, None], "double"), ([-0.0, 0.0, 1.0], "double"),
])
def test_tail_is_that_of_the_sorted_rows(spark, values, kind, frac):
    assert marked(spark, values, kind, frac) == by_hand(values, frac)


def test_tail_of_crowded_values(spark, monkeypatch):
    monkeypatch.setattr(sketches, "K", 8)
    monkeypatch.setattr(quantiles, "CROWDED", 10)
    values = [i % 50 for i in range(1_000)] + [25] * 500 + [i / 7 for i in range(500)]
    values = [float(v) for v in values]
    assert marked(spark, values, "double", 0.37, 9) == by_hand(values, 0.37)


def test_rows_are_marked_where_they_are(spark):
    df = spark.range(5_000).withColumn("v", F.col("id") % 10).withColumn("wide", F.repeat(F.lit("x"), 50))
    plan = sampling.tail_holdout(df, 0.1, "v", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan
    assert sampling.tail_holdout(df, 0.1, "v", ["id"]).where("holdout").count() == 500


def test_selected_values(spark):
    df = spark.createDataFrame([(v,) for v in [5, 1, 5, 3, None, 5, 9]], "v bigint")
    pick = lambda at: quantiles.value_at(df, rank.rank_value(df, "v"), lambda n: at)
    ordered = [1, 3, 5, 5, 5, 9]
    for at, v in enumerate(ordered):
        assert pick(at) == quantiles.Selected(6, v, ordered.index(v), ordered.count(v))
    assert pick(99).value == 9 and pick(-1).value == 1
    assert quantiles.value_at(df.limit(0), F.col("v"), lambda n: 0) is None


def test_draws_follow_the_weights_and_only_hashes_are_dealt_out(spark):
    weights = [0.0, 1.0, 2.0, 5.0, None, 12.0]
    df = spark.createDataFrame([(i, w, "wide" * 20) for i, w in enumerate(weights)], "id bigint, w double, wide string")
    drawn = sampling.weighted_resample(df, "w", 4_000, ["id"], 7)
    assert drawn.columns == ["draw", "id", "w", "wide"]
    got = Counter(r.id for r in drawn.collect())
    assert sum(got.values()) == 4_000 and not got[0] and not got[4]
    for i in (1, 2, 3, 5):
        expected = 4_000 * weights[i] / 20
        assert abs(got[i] - expected) < 4.5 * math.sqrt(expected)
    # The wide column is in the join at the end and in no window.
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert all("wide" not in line for line in plan.splitlines() if "Window" in line)


@pytest.mark.parametrize("clip,cell_rows", [(None, 40), ("linear", 25), ("soft", 10 ** 6)])
def test_blends_are_ranked_exactly_in_cells(spark, monkeypatch, clip, cell_rows):
    import numpy as np
    import pandas as pd

    from trendspark.operators import blend

    monkeypatch.setattr(blend, "CELL_ROWS", cell_rows)
    draw = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": draw.random(600).round(2), "b": draw.random(600), "y": draw.random(600).round(1)})
    pdf["b"] = pdf["b"] * 0.3 + pdf["y"] * 0.7
    pdf.loc[::50, "a"] = np.nan
    pdf.loc[200:350, ["a", "b"]] = [0.99, 0.99]  # a hot value
    found = blend.grid_search_blend(spark.createDataFrame(pdf).repartition(6), "a", "b", "y", clip=clip, margin=0.3)
    known = pdf.dropna()
    for r in found.collect():
        p = r.w_a * known["a"] + r.w_b * known["b"]
        if clip == "linear":
            p = ((p - 0.3) / 0.4).clip(0, 1)
        elif clip == "soft":
            p = 0.5 + 0.5 * np.tanh((p - 0.5) / 0.3)
        assert r.spearman == pytest.approx(p.rank().corr(known["y"].rank()), abs=1e-9)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 0  # no row is copied
    assert [r.spearman for r in blend.grid_search_blend(spark.createDataFrame(pdf.head(0), "a double, b double, y double"), "a", "b", "y").collect()] == [None] * 21
