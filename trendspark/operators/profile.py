"""Profiles of a table. Each report is one aggregation, however many numbers it holds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import strip
from .evaluate import safe_corr
from .filters import recent
from .quantiles import as_number, exact_quantiles


def _missing_text(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == "")


def completeness(df: DataFrame) -> DataFrame:
    """One row: rows, rows without title, description or date, and distinct videos."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(_missing_text("title")).alias("missing_title"),
        F.count_if(_missing_text("description")).alias("missing_description"),
        F.count_if(F.col("publishedAt").isNull()).alias("missing_published"),
        F.countDistinct("videoId").alias("unique_videos"),
    )


def date_coverage(df: DataFrame, by: str = "source") -> DataFrame:
    """Per group: rows, rows with and without a date, and the share with a date in percent."""
    dated = F.count("publishedAt")
    return df.groupBy(by).agg(
        F.count("*").alias("total"),
        dated.alias("with_date"),
        (F.count("*") - dated).alias("without_date"),
        F.round(F.lit(100.0) * dated / F.count("*"), 2).alias("date_percentage"),
    )


def source_stats(df: DataFrame, k: int = 20, by: str = "data_source") -> DataFrame:
    """The ``k`` largest groups with their dated rows and date range; ties by name."""
    grouped = df.groupBy(by).agg(
        F.count("*").alias("count"),
        F.count("publishedAt").alias("with_date"),
        F.min("publishedAt").alias("earliest_date"),
        F.max("publishedAt").alias("latest_date"),
    )
    return grouped.orderBy(F.desc("count"), F.asc_nulls_first(by)).limit(k)


def threshold_name(prefix: str, value: float) -> str:
    return f"{prefix}_{value:g}_plus".replace(".", "_")


def threshold_counts(
    df: DataFrame, col: str, thresholds: Sequence[float], by: Sequence[str] = (), prefix: str = "ge"
) -> DataFrame:
    """Rows and rows at or above each threshold, overall or per group, in one pass."""
    aggs = [F.count("*").alias("total")]
    aggs += [F.count_if(F.col(col) >= t).alias(threshold_name(prefix, t)) for t in thresholds]
    return (df.groupBy(*by) if by else df).agg(*aggs)


def threshold_sweep(df: DataFrame, col: str, thresholds: Sequence[float]) -> DataFrame:
    """One row per threshold: rows at or above it."""
    wide = df.agg(*[F.count_if(F.col(col) >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    rows = F.array(
        *[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n")) for i, t in enumerate(thresholds)]
    )
    return wide.select(F.inline(rows))


def recency_counts(df: DataFrame, as_of: str, years: Sequence[int] = (1, 3, 5), col: str = "publishedAt") -> DataFrame:
    """One row: rows of the last 1, 3 and 5 years, with and without a date."""
    aggs = [F.count_if(recent(col, y, as_of, keep_null=False)).alias(f"last_{y}yr") for y in years]
    return df.agg(
        *aggs, F.count(col).alias("with_date"), F.count_if(F.col(col).isNull()).alias("without_date")
    )


def predicate_counts(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows meet each named predicate."""
    return df.agg(*[F.count_if(cond).alias(name) for name, cond in predicates.items()])


def bin_index(value: Column, edges: Sequence[float], closed: str = "left") -> Column:
    """Index of the bin of ``value``, null outside all bins.

    ``closed``: "left" is [lo, hi), "right" is (lo, hi], "numpy" is [lo, hi) with the last bin
    closed on both sides.
    """
    out = F.lit(None).cast("int")
    last = len(edges) - 2
    for i in reversed(range(last + 1)):
        lo, hi = F.lit(float(edges[i])), F.lit(float(edges[i + 1]))
        if closed == "right":
            inside = (value > lo) & (value <= hi)
        elif closed == "left" or i < last:
            inside = (value >= lo) & (value < hi)
        else:
            inside = (value >= lo) & (value <= hi)
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def histogram(
    df: DataFrame, cols: str | Sequence[str], edges: Sequence[float], closed: str = "left"
) -> DataFrame:
    """One row per bin: its edges and, per column, rows and share of all rows in percent.

    Empty bins are listed with 0.
    """
    names = [cols] if isinstance(cols, str) else list(cols)
    bins = range(len(edges) - 1)
    indexed = df.select(*[bin_index(F.col(c), edges, closed).alias(f"i{k}") for k, c in enumerate(names)])
    wide = indexed.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(f"i{k}") == b).alias(f"c{k}_{b}") for k in range(len(names)) for b in bins],
    )
    rows = []
    for b in bins:
        fields = [
            F.lit(b).alias("bin"),
            F.lit(float(edges[b])).alias("lo"),
            F.lit(float(edges[b + 1])).alias("hi"),
        ]
        for k, c in enumerate(names):
            tag = "" if isinstance(cols, str) else f"{c}_"
            fields.append(F.col(f"c{k}_{b}").alias(f"{tag}count"))
            fields.append((F.lit(100.0) * F.col(f"c{k}_{b}") / F.col("total")).alias(f"{tag}pct"))
        rows.append(F.struct(*fields))
    return wide.select(F.inline(F.array(*rows)))


def describe_metrics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: mean, sample deviation, extremes, quartiles, share of nulls and zeros."""
    aggs = [F.count("*").alias("total")]
    for i, c in enumerate(cols):
        v = as_number(c)
        aggs += [
            F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
            F.count_if(v.isNull()).alias(f"nulls{i}"),
            F.count_if(v == 0).alias(f"zeros{i}"),
        ]
    quartiles = exact_quantiles(df, cols, (0.25, 0.5, 0.75))
    wide = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(c).alias("metric"),
            F.col(f"mean{i}").alias("mean"),
            F.col(f"std{i}").alias("std"),
            F.col(f"min{i}").alias("min"),
            F.lit(quartiles[c][0]).cast("double").alias("p25"),
            F.lit(quartiles[c][1]).cast("double").alias("p50"),
            F.lit(quartiles[c][2]).cast("double").alias("p75"),
            F.col(f"max{i}").alias("max"),
            (F.lit(100.0) * F.col(f"nulls{i}") / F.col("total")).alias("null_pct"),
            (F.lit(100.0) * F.col(f"zeros{i}") / F.col("total")).alias("zero_pct"),
        )
        for i, c in enumerate(cols)
    ]
    return wide.select(F.inline(F.array(*rows)))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, over the rows where both are known."""
    pairs = list(combinations(range(len(cols)), 2))
    v = [as_number(c) for c in cols]
    own = [F.when(F.stddev_pop(x) > 0, F.lit(1.0)).alias(f"r{i}_{i}") for i, x in enumerate(v)]
    wide = df.agg(*[safe_corr(v[i], v[j]).alias(f"r{i}_{j}") for i, j in pairs], *own)
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            r = F.col(f"r{min(i, j)}_{max(i, j)}")
            rows.append(F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), r.alias("corr")))
    return wide.select(F.inline(F.array(*rows)))


def summary(df: DataFrame, col: str, approximate: bool = False) -> DataFrame:
    """One row: count, min, max, mean, median and distinct values of ``col``."""
    v = as_number(col)
    distinct = F.approx_count_distinct(v) if approximate else F.countDistinct(v)
    median = exact_quantiles(df, [col], (0.5,))[col][0]
    return df.agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        distinct.alias("n_unique"),
    ).withColumn("median", F.lit(median).cast("double"))


def value_distribution(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values with their share of all rows in percent; ties by value."""
    grouped = df.groupBy(col).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("t")).scalar()
    top = grouped.orderBy(F.desc("n"), F.asc_nulls_first(col)).limit(k)
    return top.withColumn("pct", F.lit(100.0) * F.col("n") / total)


def label_bias(df: DataFrame, col: str, digits: int = 4, limit: float = 0.30, k: int = 10) -> DataFrame:
    """The ``k`` most frequent rounded labels, and whether the most frequent exceeds ``limit``."""
    rounded = df.where(F.col(col).isNotNull()).select(F.round(F.col(col), digits).alias("label"))
    top = value_distribution(rounded, "label", k)
    highest = F.max("pct").over(Window.partitionBy(F.lit(0)))
    return top.withColumn("biased", highest > F.lit(100.0 * limit))


def range_check(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: values below 0 and above 1, and whether there are none."""
    wide = df.agg(
        *[F.count_if(F.col(c) < 0).alias(f"b{i}") for i, c in enumerate(cols)],
        *[F.count_if(F.col(c) > 1).alias(f"a{i}") for i, c in enumerate(cols)],
    )
    rows = [
        F.struct(
            F.lit(c).alias("metric"),
            F.col(f"b{i}").alias("below"),
            F.col(f"a{i}").alias("above"),
            ((F.col(f"b{i}") == 0) & (F.col(f"a{i}") == 0)).alias("ok"),
        )
        for i, c in enumerate(cols)
    ]
    return wide.select(F.inline(F.array(*rows)))


def dataset_checks(df: DataFrame, split_col: str = "split") -> DataFrame:
    """One row per check of a training set: its value, its limit and whether it holds."""
    train = df.where(F.col(split_col) == "train")

    def blank(name: str) -> Column:
        return F.col(name).isNull() | (strip(F.col(name)) == "")

    in_train = F.col(split_col) == "train"
    numbers = df.agg(
        F.count_if(in_train).alias("n"),
        F.count_if(in_train & blank("prompt")).alias("empty_prompt"),
        F.count_if(in_train & blank("response")).alias("empty_response"),
        F.count_if(in_train & (F.length("response") < 10)).alias("short"),
        F.count_if(F.col(split_col) == "test").alias("n_test"),
    )
    # Grouping by the hash first keeps long texts out of the comparison of keys.
    most = (
        train.groupBy(F.xxhash64("response").alias("_kh"), "response")
        .agg(F.count("*").alias("c"))
        .agg(F.coalesce(F.max("c"), F.lit(0)).alias("m"))
        .scalar()
    )
    w = numbers.withColumn("most", most)

    def row(name: str, value: Column, limit: Column, ok: Column) -> Column:
        return F.struct(
            F.lit(name).alias("check"), value.cast("double").alias("value"),
            limit.cast("double").alias("limit"), ok.alias("ok"),
        )

    n = F.col("n")
    rows = F.array(
        row("train_rows", n, F.lit(1000), n >= 1000),
        row("empty_prompts", F.col("empty_prompt"), F.lit(0), F.col("empty_prompt") == 0),
        row("empty_responses", F.col("empty_response"), F.lit(0), F.col("empty_response") == 0),
        row("top_response", F.col("most"), n * 0.1, F.col("most") <= n * 0.1),
        row("short_responses", F.col("short"), n * 0.2, F.col("short") <= n * 0.2),
        row("test_rows", F.col("n_test"), F.lit(1), F.col("n_test") >= 1),
    )
    return w.select(F.inline(rows))


def peek(df: DataFrame, n: int = 3, order_by: str | None = None) -> DataFrame:
    """The first ``n`` rows in the order of a column, or else those Spark comes by, long texts cut for display."""
    from ..functions.text import truncate_text

    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    first = df.limit(n) if order_by is None else df.orderBy(order_by).limit(n)
    return first.withColumns({c: truncate_text(F.col(c), 100, 97) for c in texts})


def describe_table(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, rows of the table and rows with a value."""
    fields = df.schema.fields
    wide = df.agg(F.count("*").alias("n"), *[F.count(F.col(f.name)).alias(f"k{i}") for i, f in enumerate(fields)])
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("n").alias("n_rows"),
            F.col(f"k{i}").alias("n_known"),
        )
        for i, f in enumerate(fields)
    ]
    return wide.select(F.inline(F.array(*rows)))
