import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from trendspark.operators import quantiles
from trendspark.operators.evaluate import (
    cardinality_check, metrics_by, mse, pairwise_rank_loss, preference_pairs, reversed_pairs, spearman, with_batches,
)
from trendspark.operators.rank import Rank, add_rank, add_ranks, pct_rank, position


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")


def test_average_ties(spark):
    df = pct_rank(frame(spark, [0.1, 0.5, 0.5, 0.9, 0.3, None]), "v", "p").orderBy("id")
    assert [r.p for r in df.collect()] == [0.2, 0.7, 0.7, 1.0, 0.4, None]


@pytest.mark.parametrize("ties", ["average", "min", "ordinal"])
def test_ranks_match_pandas_with_a_hot_value(spark, ties):
    rng = np.random.default_rng(1)
    values = np.where(rng.random(3000) < 0.4, 7.0, rng.normal(7, 3, 3000))
    values[::50] = np.nan
    df = frame(spark, [None if np.isnan(v) else float(v) for v in values]).repartition(5)
    got = add_rank(df, "v", "r", ties, tie_key=["id"]).toPandas().sort_values("id")
    if ties == "ordinal":
        order = sorted(
            (v, hashlib.md5(f"42|{i}".encode()).hexdigest(), i) for i, v in enumerate(values) if not np.isnan(v)
        )
        want = pd.Series({i: k + 1.0 for k, (_, _, i) in enumerate(order)}).reindex(range(len(values)))
    else:
        want = pd.Series(values).rank(method=ties)
    np.testing.assert_array_equal(got.r.astype(float), want.astype(float))
    assert set(got.r_n) == {int((~np.isnan(values)).sum())} or got.r_n.nunique(dropna=True) == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3).map(float)), min_size=1, max_size=40))
def test_rank_property(spark, values):
    got = add_ranks(frame(spark, values), [Rank("v", "a"), Rank("v", "m", "min")]).toPandas().sort_values("id")
    series = pd.Series(values, dtype=float)
    np.testing.assert_array_equal(got.a.astype(float), series.rank())
    np.testing.assert_array_equal(got.m.astype(float), series.rank(method="min"))


def test_rank_by_group_and_columns_named_like_helpers(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"_p": rng.integers(0, 9, 500).astype(float), "_b": rng.choice(["x", "y", None], 500), "_n": range(500)})
    df = spark.createDataFrame(pdf)
    got = add_rank(df, "_p", "r", by=["_b"]).toPandas().sort_values("_n")
    want = pdf._p.groupby(pdf._b.fillna("none")).rank()
    np.testing.assert_array_equal(got.r, want)
    same = add_rank(df, "_p", "r", by=["_b"], known_groups=3).toPandas().sort_values("_n")
    np.testing.assert_array_equal(same.r, want)


def test_empty_and_all_null(spark):
    assert add_rank(frame(spark, [None, None]).where("id > 5"), "v", "r").count() == 0
    assert [r.r for r in add_rank(frame(spark, [None, None]), "v", "r").collect()] == [None, None]


def test_position_is_a_permutation(spark):
    df = position(frame(spark, [float(i % 3) for i in range(100)]), "v", "pos", ["id"])
    assert sorted(r.pos for r in df.collect()) == list(range(100))


@pytest.mark.parametrize("crowded", [2_000_000, 5])
def test_quantiles_match_pandas(spark, monkeypatch, crowded):
    monkeypatch.setattr(quantiles, "CROWDED", crowded)
    rng = np.random.default_rng(3)
    n = 20_001
    pdf = pd.DataFrame({
        "a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float),
        "c": np.where(rng.random(n) < 0.5, 1.0, rng.random(n)), "d": np.nan,
    })
    pdf.loc[::10, "a"] = np.nan
    probs = (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = quantiles.exact_quantiles(spark.createDataFrame(pdf).repartition(4), list("abcd"), probs)
    for c in "abc":
        np.testing.assert_allclose(got[c], pdf[c].quantile(probs), rtol=1e-12)
    assert got["d"] == [None] * 6


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 1.0, 4.0], [2.0] * 7, [float(i * i) for i in range(11)]])
def test_quantiles_of_few_values(spark, values):
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = quantiles.exact_quantiles(frame(spark, [*values, None]), ["v"], probs)["v"]
    np.testing.assert_allclose(got, pd.Series(values).quantile(probs), rtol=1e-12)


def test_quantiles_that_are_infinite(spark):
    inf = float("inf")
    assert quantiles.exact_quantiles(frame(spark, [1.0, inf, inf]), ["v"], (0.0, 0.75, 1.0))["v"] == [1.0, inf, inf]


def test_whole_numbers_are_ranked_without_rounding(spark):
    big = 2**53
    df = spark.createDataFrame([(i, big + i) for i in range(4)] + [(4, None)], "id int, v bigint")
    assert [r.r for r in add_rank(df, "v", "r").orderBy("id").collect()] == [1.0, 2.0, 3.0, 4.0, None]


def test_metrics(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": ["a"] * 60 + ["b"] * 30 + ["c"] * 5, "y": rng.integers(0, 10, 95).astype(float)})
    pdf["p"] = pdf.y + rng.normal(0, 2, 95).round(1)
    df = spark.createDataFrame(pdf)
    assert mse(df, "y", "p").first().mse == pytest.approx(((pdf.y - pdf.p) ** 2).mean())
    rho = spearman(df, "y", "p").first()
    assert (rho.n, rho.spearman) == (95, pytest.approx(pdf.y.rank().corr(pdf.p.rank())))
    rows = {r.g: r for r in metrics_by(df, "y", "p", "g").collect()}
    assert set(rows) == {"a", "b"}
    for g, part in pdf.groupby("g"):
        if g in rows:
            assert rows[g].n == len(part)
            assert rows[g].mse == pytest.approx(((part.y - part.p) ** 2).mean())
            assert rows[g].spearman == pytest.approx(part.y.rank().corr(part.p.rank()))


def test_spearman_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "y double, p double")
    assert spearman(df, "y", "p").first().spearman is None


def test_cardinality(spark):
    df = spark.createDataFrame([(i % 2, i % 5, i) for i in range(30)], "a int, b int, c int")
    assert [(r.model, r.n_unique, r.verdict) for r in cardinality_check(df, list("abc")).collect()] == [
        ("a", 2, "binary"), ("b", 5, "few"), ("c", 30, "ok")]


def loss_by_hand(y, p, kind):
    total, pairs = 0.0, 0
    for i in range(len(y)):
        for j in range(len(y)):
            if y[i] > y[j]:
                gap, margin = p[i] - p[j], max(2 * (y[i] - y[j]), 0.1)
                loss = max(0.0, margin - gap) if kind == "hinge" else 1 / (1 + np.exp(gap))
                total += loss * min(1 + np.exp(-10 * (gap - 0.5 * margin) / margin), 5.0)
                pairs += 1
    return total / pairs if pairs else float(np.mean((np.array(y) - np.array(p)) ** 2))


@pytest.mark.parametrize("kind", ["hinge", "soft"])
def test_pairwise_loss(spark, kind):
    rng = np.random.default_rng(5)
    y, p = rng.random(70).round(1), rng.random(70)
    y[32:64] = 0.5
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    df = spark.createDataFrame(rows, "id int, y double, p double")
    got = {r.batch: r for r in pairwise_rank_loss(df, "y", "p", "id", ["id"], kind=kind).collect()}
    assert {b: r.n for b, r in got.items()} == {0: 32, 1: 32, 2: 6}
    for b in range(3):
        part = slice(32 * b, 32 * b + 32)
        assert got[b].loss == pytest.approx(loss_by_hand(y[part], p[part], kind))
    assert got[1].n_pairs == 0
    single = pairwise_rank_loss(df.limit(1), "y", "p", "id", ["id"]).first()
    assert single.loss == pytest.approx((y[0] - p[0]) ** 2)


def test_preference_pairs_and_reversal(spark):
    df = spark.createDataFrame([(i, s, f"t{i}") for i, s in enumerate([0.1, 0.9, 0.5, 0.5, 0.3])], "id int, s double, t string")
    pairs = preference_pairs(df, "s", "t", "id", ["id"]).orderBy("pair").collect()
    assert [(r.chosen, r.rejected) for r in pairs] == [("t1", "t2"), ("t3", "t4")]
    assert with_batches(df, "id", ["id"], 2).groupBy("batch").count().count() == 3
    text = spark.createDataFrame([("q", "añ😀b")], "prompt string, response string")
    assert reversed_pairs(text).first().rejected == "b😀ña"


def test_infinite_values_have_a_place(spark):
    df = frame(spark, [float("inf")] * 300 + [float("-inf")] * 300 + [float(i) for i in range(50)])
    name = [c for c, t in df.dtypes if t == "double"][0]
    got = add_rank(df, name, "r", "average").toPandas()
    want = got[name].rank(method="average")
    assert (got["r"] == want).all()
