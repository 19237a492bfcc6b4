"""From scored snapshots to training sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import PROMPT, detect_language, response_text, short_description
from ..operators.dedup import Referred, dedup_text
from ..operators.sampling import bin_noise, rebalance, stratified_cap, train_test_split
from ..schema import BALANCE_EDGES, DECILE_EDGES
from ..session import stage


def build_sft(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Prompt and response of each row, with its title, short description and score if it has one."""
    score = ["viral_score"] if "viral_score" in df.columns else []
    return df.select(
        *extra,
        F.lit(PROMPT).alias("prompt"),
        response_text(F.col("title"), F.col("description")).alias("response"),
        *score,
        F.coalesce("title", F.lit("")).alias("title"),
        short_description(F.col("description")).alias("description"),
    )


def sft_text(prompt: str = "prompt", response: str = "response") -> Column:
    """Prompt and response in one text."""
    return F.concat(F.col(prompt), F.col(response))


def prepare_sft(
    df: DataFrame, key: str, test: float = 0.1, seed: int | str = 42, descriptions: Referred | None = None
) -> DataFrame:
    """Rows with texts, without repeated texts, as examples labelled train or test.

    ``descriptions`` are referred to by the rows if these have no column of that name. The rows that stay are written
    once; the split reads them several times.
    """
    body = descriptions.digest if descriptions else "description"
    rows = descriptions.with_digest(df) if descriptions else df
    with_texts = rows.where(F.col("title").isNotNull() & F.col(body).isNotNull())
    score = ["viral_score"] if "viral_score" in df.columns else []
    unique = stage(dedup_text(with_texts, ["title", body], key).select(key, "title", body, *score), "unique")
    split = train_test_split(unique, test, [key], seed)
    whole = build_sft(descriptions.with_text(split, "description") if descriptions else split, [key, "split"])
    return whole.select(*[c for c in whole.columns if c != "split"], "split")


def prepare_regression(
    df: DataFrame, key: str, per_bucket: int = 8000, test: float = 0.1, seed: int | str = 42
) -> DataFrame:
    """Up to ``per_bucket`` rows per score bucket, without repeated texts, labelled train or test."""
    with_texts = df.where(F.col("title").isNotNull() & F.col("description").isNotNull())
    capped = stratified_cap(with_texts, "viral_score", BALANCE_EDGES, per_bucket, [key], seed, "left")
    unique = dedup_text(capped.select(key, "title", "description", "viral_score"), ["title", "description"], key)
    return train_test_split(unique, test, [key], seed)


def prepare_stratified(
    df: DataFrame, key: str, per_bin: int = 5000, test: float = 0.1, seed: int | str = 42
) -> DataFrame:
    """Up to ``per_bin`` rows per tenth of the score, labelled train or test."""
    capped = stratified_cap(df, "viral_score", DECILE_EDGES, per_bin, [key], seed, "right")
    return train_test_split(capped.select(key, "videoId", "title", "description", "viral_score"), test, [key], seed)


def fix_bias(df: DataFrame, key: Sequence[str], split_col: str = "split", seed: int | str = 42) -> DataFrame:
    """Re-balance the training rows and add bin noise to the scores of both splits."""
    train = rebalance(df.where(F.col(split_col) == "train"), "viral_score", key, seed)
    test = df.where(F.col(split_col) == "test")
    return bin_noise(train.unionByName(test), "viral_score", key, seed)


def regression_examples(df: DataFrame, target: str, with_language: bool = False) -> DataFrame:
    """Text and label of each row, the text never null, and its language if asked."""
    text = F.coalesce(F.col(target).cast("string"), F.lit(""))
    out = df.select(text.alias("text"), F.col("viral_score").cast("double").alias("labels"))
    return out.withColumn("language", detect_language(F.col("text"))) if with_language else out
