"""Percentiles on a stored scale against plain counting."""

import random
from bisect import bisect_left, bisect_right

from trendspark.operators.distribution import percentile_on, store_distribution


def test_percentiles_on_a_stored_scale(spark, tmp_path):
    draw = random.Random(3)
    old = [draw.choice([0.0, 0.5, draw.random() * 10]) for _ in range(3_000)] + [-1.0]
    store_distribution(spark.createDataFrame([(v,) for v in [*old, None, float("nan")]], "v double"), "v", str(tmp_path / "scale"))
    asked = [-5.0, -1.0, 0.0, 0.25, 0.5, 9.0, 99.0, None, float("nan"), *draw.sample(old, 300), *[draw.random() * 10 for _ in range(300)]]
    rows = spark.createDataFrame(list(enumerate(asked)), "id int, v double")
    got = {r.id: r.p for r in percentile_on(rows, "v", "p", str(tmp_path / "scale")).collect()}
    line = sorted(old)
    assert len(got) == len(asked)
    for i, v in enumerate(asked):
        if v is None or v != v:
            assert got[i] is None
            continue
        less, upto = bisect_left(line, v), bisect_right(line, v)
        assert abs(got[i] - min(1.0, (less + (upto - less + 1) / 2) / len(line))) < 1e-12


def test_nothing_stored(spark, tmp_path):
    empty = spark.createDataFrame([], "v double")
    store_distribution(empty, "v", str(tmp_path / "scale"))
    rows = spark.createDataFrame([(1.0,)], "v double")
    assert percentile_on(rows, "v", "p", str(tmp_path / "scale")).first().p is None
