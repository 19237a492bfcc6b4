"""Levelled sketches, and exact quantiles that do not hang on them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trendspark.operators import quantiles, rank, sketches


def test_counts_and_quantiles_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sketches, "FAN", 3)
    rows = spark.range(0, 40_000, 1, 23).select(
        F.col("id").alias("whole"), (F.col("id") / 8).alias("part"), F.when(F.col("id") % 4 == 0, F.col("id")).alias("gaps"),
        F.lit(None).cast("double").alias("none"),
    )
    found = sketches.Sketches(rows, {"whole": "bigint", "part": "double", "gaps": "bigint", "none": "double"})
    assert found.counts == {"whole": 40_000, "part": 40_000, "gaps": 10_000, "none": 0}
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = found.quantiles(dict.fromkeys(rows.columns, shares))
    assert set(got) == {"whole", "part", "gaps"}
    for name, values in got.items():
        scaled = np.array(values) * (8 if name == "part" else 1)
        assert np.abs(scaled - np.array(shares) * 39_999).max() <= sketches.ERROR * 2 * 40_000
    assert got["whole"][0] == 0 and got["whole"][-1] == 39_999


def test_no_merge_reads_more_than_its_share(spark):
    plan = sketches.levelled(spark.range(10).toDF("v"), {"v": "bigint"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == sketches.LEVELS
    # Of 10,000 tasks each key of a level gathers FAN sketches at most.
    for level in range(sketches.LEVELS):
        keys = {t // sketches.FAN ** (level + 1) for t in range(10_000)}
        assert max(len({t // sketches.FAN ** level for t in range(10_000) if t // sketches.FAN ** (level + 1) == k}) for k in list(keys)[:3]) <= sketches.FAN


@pytest.mark.parametrize("crowded", [5, 1_000])
def test_a_poor_sketch_costs_scans_and_no_exactness(spark, monkeypatch, crowded):
    monkeypatch.setattr(sketches, "K", 8)
    monkeypatch.setattr(quantiles, "CROWDED", crowded)
    draw = np.random.default_rng(3)
    values = np.concatenate([draw.normal(size=3_000), np.full(2_000, 0.25), draw.pareto(1.0, 1_000) * 1e6])
    probs = (0.0, 0.01, 0.25, 0.5, 0.77, 0.999, 1.0)
    got = quantiles.exact_quantiles(spark.createDataFrame(pd.DataFrame({"v": values})).repartition(5), ["v"], probs)["v"]
    assert got == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


def test_cuts_are_one_literal(spark):
    df = spark.range(1_000).withColumn("v", F.col("id").cast("double"))
    plan = rank.add_rank(df, "v", "r")._jdf.queryExecution().optimizedPlan().toString()
    assert "array(0" not in plan and "split(" not in plan


def test_folded_arrays_keep_their_numbers(spark):
    numbers = [0.1, -0.0, 1e308, 5e-324, float("inf"), float("-inf"), 1 / 3]
    assert spark.range(1).select(sketches.folded(numbers, "double")).first()[0] == numbers
    whole = [-(1 << 63), 0, (1 << 63) - 1]
    assert spark.range(1).select(sketches.folded(whole, "bigint")).first()[0] == whole
    assert spark.range(1).select(sketches.folded([], "double")).first()[0] == []
