"""The scoring and cleaning pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import uniform
from ..functions.scoring import (
    age_hours, early, engagement, log_rate, rank_score, rate, recency, weighted_sum, with_noise_term,
)
from ..operators.dedup import dedup_keep_last
from ..operators.distribution import percentile_on, store_distribution
from ..operators.filters import filter_regions
from ..operators.normalize import coerce_counts, coerce_timestamps
from ..operators.profile import completeness
from ..operators.rank import pct_rank
from ..operators.scale import Stats, robust_sigmoid, robust_stats
from ..schema import KEEP_REGIONS, SNAPSHOT_KEYS, FeatureConfig, feature_config
from ..session import stage

RATES = {"viewsPerHr": "viewCount", "likesPerHr": "likeCount", "commentsPerHr": "commentCount"}


def rates(df: DataFrame, now: str | Column) -> DataFrame:
    """Add the age and the three rates per hour, the rates lifted to 0 and their logarithms."""
    clock = F.lit(now) if isinstance(now, str) else now
    aged = df.withColumn("_age", age_hours(F.col("publishedAt"), F.col("trendingDate"), clock))
    raw = aged.withColumns({out: rate(F.col(count), F.col("_age")) for out, count in RATES.items()})
    lifted = {out: F.when(F.col(out) < 0, F.lit(0.0)).otherwise(F.col(out)) for out in RATES}
    return raw.withColumns(lifted).withColumns({f"{out}_log": log_rate(F.col(out)) for out in RATES})


def metrics(df: DataFrame, now: str | Column, stats: Stats | None = None) -> DataFrame:
    """Add the seven normalised metrics. ``stats`` freezes the scale of the rates.

    The rows with their rates are written once: finding the quartiles and the ranks reads them
    several times, mostly a few number columns of them.
    """
    rated = stage(rates(df, now), "rates")
    scaled = robust_sigmoid(rated, {f"{out}_log": f"{out}_n" for out in RATES}, stats)
    return scaled.withColumns(
        {
            "rankScore_n": rank_score(F.col("rank")),
            "recency_n": recency(F.col("_age")),
            "engagementRatio_n": engagement(F.col("likeCount"), F.col("viewCount")),
            "earlyViral_n": early(F.col("viewsPerHr_n"), F.col("likesPerHr_n")),
        }
    ).drop("_age")


def score(
    df: DataFrame,
    now: str | Column,
    key: Sequence[str],
    cfg: FeatureConfig | None = None,
    seed: int | str = 42,
    stats: Stats | None = None,
    distribution: str | None = None,
) -> DataFrame:
    """Add all derived columns up to ``viral_score``.

    ``now``, a UTC time, stands in for a missing trending date. ``key`` identifies a row and drives its noise.
    Scores are percentiles of the given rows: to score appended rows on the scale of earlier ones
    pass what ``freeze_scale`` returned and stored for those as ``stats`` and ``distribution``.
    """
    recipe = cfg or feature_config()
    measured = metrics(df, now, stats).withColumn("_raw", weighted_sum(recipe.weights))
    ranked = percentile_on(measured, "_raw", "_pct", distribution) if distribution else pct_rank(measured, "_raw", "_pct")
    base = F.pow(F.col("_pct"), F.lit(recipe.power))
    scored = ranked.withColumn("viral_score", with_noise_term(base, uniform(key, seed), recipe.noise))
    return scored.withColumn("feature_version", F.lit(recipe.version)).drop("_raw", "_pct")


def freeze_scale(df: DataFrame, now: str | Column, path: str, cfg: FeatureConfig | None = None) -> Stats:
    """Store the distribution of the weighted sums of ``df`` at ``path`` and return the scale of its rates.

    With both, ``score`` gives appended rows the scores they would have among these rows, which keep theirs.
    """
    recipe = cfg or feature_config()
    stats = robust_stats(stage(rates(df, now).select(*[f"{out}_log" for out in RATES]), "logs"), [f"{out}_log" for out in RATES])
    store_distribution(metrics(df, now, stats).select(weighted_sum(recipe.weights).alias("raw")), "raw", path)
    return stats


def clean(
    df: DataFrame,
    order_col: str | Sequence[str],
    keep_regions: Sequence[str] = KEEP_REGIONS,
    keep_missing_rank: bool = False,
) -> DataFrame:
    """Coerce, drop foreign regions and keep the last of repeated snapshots.

    A missing count is 0. That includes the rank, which then scores as the best one, unless
    ``keep_missing_rank`` leaves it missing, to score as place 50.
    """
    counts = ["viewCount", "likeCount", "commentCount"] + ([] if keep_missing_rank else ["rank"])
    dated = coerce_timestamps(filter_regions(df, keep_regions))
    return coerce_counts(dedup_keep_last(dated, SNAPSHOT_KEYS, order_col), counts)


def clean_and_score(
    df: DataFrame,
    now: str | Column,
    order_col: str | Sequence[str],
    key: Sequence[str],
    keep_regions: Sequence[str] = KEEP_REGIONS,
    cfg: FeatureConfig | None = None,
    seed: int | str = 42,
    keep_missing_rank: bool = False,
) -> DataFrame:
    """The whole cleaning step: ``clean``, then ``score``."""
    return score(clean(df, order_col, keep_regions, keep_missing_rank), now, key, cfg, seed)


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """The completeness of the rows before and after cleaning, one row per ``phase``."""
    parts = [completeness(df).select(F.lit(phase).alias("phase"), "*") for phase, df in (("before", before), ("after", after))]
    return parts[0].unionByName(parts[1])
