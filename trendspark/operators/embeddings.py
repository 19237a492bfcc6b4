"""Embedding cache joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import text_key
from .dedup import dedup_keep_last


def _digest(key: Column) -> Column:
    """Stands for a text key in joins, which then neither shuffle nor sort by whole texts."""
    return F.sha2(key, 256)


def missing_keys(df: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Distinct text keys that the cache does not hold. The cache has (text_key, embedding)."""
    keys = df.where(F.col(text).isNotNull()).select(text_key(F.col(text)).alias("text_key"))
    wanted = keys.withColumn("_digest", _digest(F.col("text_key"))).dropDuplicates(["_digest"])
    held = cache.select(_digest(F.col("text_key")).alias("_digest"))
    return wanted.join(held, "_digest", "left_anti").select("text_key")


def attach_embeddings(df: DataFrame, cache: DataFrame, dim: int, text: str = "text") -> DataFrame:
    """Add the cached ``embedding`` of each row's text, zeros where there is none."""
    keyed = df.withColumn("_digest", _digest(text_key(F.col(text))))
    known = cache.select(_digest(F.col("text_key")).alias("_cd"), "embedding")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    joined = keyed.join(known, F.col("_digest") == F.col("_cd"), "left")
    return joined.select(*df.columns, F.coalesce("embedding", zeros).alias("embedding"))


def upsert_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with the new vectors, which replace older ones of the same key."""
    both = cache.select("text_key", "embedding", F.lit(0).alias("_age")).unionByName(
        new.select("text_key", "embedding", F.lit(1).alias("_age"))
    )
    return dedup_keep_last(both, ["text_key"], "_age").drop("_age")


def vector_mean(vector: Column) -> Column:
    """Mean of the entries of an array."""
    total = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return total / F.size(vector)


def vector_std(vector: Column) -> Column:
    """Population standard deviation of the entries of an array, from running means, so no digits cancel."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1.0
        gap = x.cast("double") - acc["mean"]
        mean = acc["mean"] + gap / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["squares"] + gap * (x.cast("double") - mean)).alias("squares"))

    return F.aggregate(vector, start, step, lambda acc: F.sqrt(F.try_divide(acc["squares"], acc["n"])))


def vector_stats(df: DataFrame, vector: str) -> DataFrame:
    """Add mean and deviation of each vector."""
    return df.withColumns(
        {f"{vector}_mean": vector_mean(F.col(vector)), f"{vector}_std": vector_std(F.col(vector))}
    )


def scale_vectors(df: DataFrame, vector: str, dim: int, out: str) -> DataFrame:
    """Bring each entry to mean 0 and population deviation 1 over all rows; constant entries become 0."""
    entries = [F.get(F.col(vector), F.lit(i)).cast("double") for i in range(dim)]
    stats = df.agg(
        F.array(*[F.avg(e) for e in entries]).alias("mean"),
        F.array(*[F.stddev_pop(e) for e in entries]).alias("std"),
    ).select(F.struct("mean", "std").alias("s")).scalar()
    scaled = F.transform(
        F.col(vector),
        lambda x, i: F.when(
            F.get(F.col("_s.std"), i) > 0,
            (x.cast("double") - F.get(F.col("_s.mean"), i)) / F.get(F.col("_s.std"), i),
        ).otherwise(F.lit(0.0)),
    )
    return df.withColumn("_s", stats).withColumn(out, scaled).drop("_s")
