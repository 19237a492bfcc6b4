"""A stored distribution that places later values on the scale of earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .rank import _place, rank_cuts
from .sketches import folded


def _cell(cuts: list[float], value: str) -> Column:
    return _place(folded(cuts, "double"), F.col(value), len(cuts)) if cuts else F.lit(0)


def store_distribution(df: DataFrame, col: str, path: str) -> None:
    """Write the different values of a number column below ``path``, each with its count and the count of smaller ones.

    Null and NaN are left out. The values are cut into cells at approximate quantiles, so the running counts need no window over
    all of them; the list of cells is as long as the shuffle is wide.
    """
    spark = df.sparkSession
    number = F.col(col).cast("double").alias("value")
    counts = stage(df.select(number).where("value IS NOT NULL AND NOT isnan(value)").groupBy("value").agg(F.count("*").alias("n")), "values")
    cuts = [float(x) for x in rank_cuts(counts, ["value"])["value"]]
    placed = counts.withColumn("cell", _cell(cuts, "value"))
    held = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    offsets = [0]
    for cell in range(len(cuts) + 1):
        offsets.append(offsets[-1] + held.get(cell, 0))
    earlier = Window.partitionBy("cell").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    below = F.get(folded(offsets, "bigint"), F.col("cell")) + F.coalesce(F.sum("n").over(earlier), F.lit(0))
    placed.withColumn("below", below).write.parquet(f"{path}/values")
    spark.createDataFrame([(cuts, offsets)], "cuts array<double>, offsets array<bigint>").write.parquet(f"{path}/cells")


def percentile_on(df: DataFrame, col: str, out: str, path: str) -> DataFrame:
    """Add ``out``: the share of the stored values up to each value of ``col``, by average rank.

    A stored value gets its own percentile, any other the place between its neighbours, at most 1; null and NaN, and all values
    where nothing is stored, get none. Only the different new values meet the stored ones, cell by cell.
    """
    spark = df.sparkSession
    head = spark.read.parquet(f"{path}/cells").first()
    cuts, offsets = list(head["cuts"]), list(head["offsets"])
    rows = df.withColumn("__value", F.col(col).cast("double"))
    asked = rows.select(F.col("__value").alias("value")).where("value IS NOT NULL AND NOT isnan(value)").distinct()
    asked = asked.select("value", F.lit(None).cast("bigint").alias("n"), _cell(cuts, "value").alias("cell"), F.lit(None).cast("bigint").alias("below"), F.lit(True).alias("new"))
    both = spark.read.parquet(f"{path}/values").select("value", "n", "cell", "below", F.lit(False).alias("new")).unionByName(asked)
    one = both.groupBy("cell", "value").agg(F.max("n").alias("n"), F.max("below").alias("below"), F.max("new").alias("new"))
    upto = Window.partitionBy("cell").orderBy("value")
    reached = F.coalesce(F.last(F.col("below") + F.col("n"), ignorenulls=True).over(upto), F.get(folded(offsets, "bigint"), F.col("cell")))
    same = F.coalesce("n", F.lit(0))
    share = (reached - same + (same + 1) / 2) / F.lit(float(offsets[-1]) or None)
    known = one.withColumn(out, F.when(share > 1, 1.0).otherwise(share)).where("new").select(F.col("value").alias("__value"), out)
    return rows.drop(out).join(known, "__value", "left").drop("__value")
