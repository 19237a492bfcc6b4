"""The registered queries and, beside each, its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trendspark.functions import clipping, text as texts
from trendspark.functions.hashing import uniform
from trendspark.operators import blend, dedup, embeddings, evaluate, filters, normalize, profile, rank, sampling, scale
from trendspark.plans import meta, score as plan, training
from trendspark.plans.build import build_warehouse
from trendspark.plans.components import Components, truncated_svd
from trendspark.schema import BALANCE_EDGES, BIAS_EDGES, DECILE_EDGES, REPORT_EDGES, FEATURE_CONFIGS, feature_config

from trendspark.session import new_folder
from trendspark.sources.ragged_csv import (
    file_load_report, load_totals, read_ragged_csv, with_path_category, with_provenance,
)
from trendspark.sources.trending_json import parse_trending_json
from trendspark.sources.warehouse import (
    append_aligned, evolve_schema, export_sample, load_summary, load_training_rows, read_table, write_predictions,
    write_splits,
)
from trendspark.streaming.ingest import coverage_stream, file_stream, ingest_stream, run_to_table, snapshot_stream
from trendspark.streaming.settle import BATCH, compact, ingest_changes, ingest_keep_last, latest

from . import oracle_parts as sql
from .tables import AS_OF, KEEP, descriptions, examples, map_snapshots, now, predictions, read, scored, snapshots, with_texts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The names of the metrics, and further down the thresholds of the reports.
METRICS = (
    "viewsPerHr_n", "likesPerHr_n", "commentsPerHr_n", "rankScore_n", "recency_n", "engagementRatio_n", "earlyViral_n",
)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` digits, so that both engines print the same number."""
    cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


def r6(*names: str) -> str:
    """SQL select list with the names rounded likewise."""
    return ", ".join(f'round("{n}", 6) + 0.0::DOUBLE AS "{n}"' for n in names)


# ---- Scoring -------------------------------------------------------------------------------------

FEED_ROWS = 50_000  # of a landed file of a feed
RATE_NAMES = ("viewsPerHr", "likesPerHr", "commentsPerHr", "viewsPerHr_log", "likesPerHr_log", "commentsPerHr_log")


@query("viral_score", f"WITH {sql.SCORED} SELECT snapshot_key, {r6(*METRICS, 'viral_score')} FROM scored")
def _(spark, sf):
    # From the raw tables to the score, with nothing prepared beforehand.
    done = plan.clean_and_score(map_snapshots(spark, sf), now(), "snapshot_key", ["snapshot_key"], KEEP)
    return rounded(done.select("snapshot_key", *METRICS, "viral_score"))


@query(
    "viral_score_missing_rank_last",
    f"""WITH {sql.SNAPSHOTS}, {sql.DEDUPED}, {sql.score_parts('deduped', '"rank"')}
        SELECT snapshot_key, {r6('rankScore_n', 'viral_score')} FROM scored""",
)
def _(spark, sf):
    done = plan.clean_and_score(
        snapshots(spark, sf), now(), "snapshot_key", ["snapshot_key"], KEEP, keep_missing_rank=True
    )
    return rounded(done.select("snapshot_key", "rankScore_n", "viral_score"))


_OLD_SCALE = sql.score_parts("deduped", 'coalesce("rank", 0)').replace("FROM logged\n)", "FROM logged WHERE source <> 'src_R'\n)")


@query(
    "appended_scores",
    f"""WITH {sql.SNAPSHOTS}, {sql.DEDUPED}, {_OLD_SCALE}, old AS (
        SELECT raw_score AS v, count(*) AS n, sum(count(*)) OVER (ORDER BY raw_score) AS upto FROM raw WHERE source <> 'src_R' GROUP BY raw_score),
    fresh AS (SELECT * FROM raw WHERE source = 'src_R'),
    placed AS (
        SELECT f.*, coalesce(o.upto, 0) AS upto, CASE WHEN o.v = f.raw_score THEN o.n ELSE 0 END AS same
        FROM fresh f ASOF LEFT JOIN old o ON f.raw_score >= o.v),
    shared AS (SELECT *, pow(least(1.0::DOUBLE, (upto - same + (same + 1) / 2.0::DOUBLE) / (SELECT sum(n) FROM old)), 1.5::DOUBLE) AS base FROM placed),
    final AS (SELECT * REPLACE (base + {sql.unit('snapshot_key', '42')} * 0.05::DOUBLE * (1 - base) AS base) FROM shared)
    SELECT snapshot_key, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, base)), 6) + 0.0::DOUBLE AS viral_score FROM final""",
)
def _(spark, sf):
    # The rows of one source are appended and scored on the stored scale of the others.
    cleaned = plan.clean(snapshots(spark, sf), "snapshot_key", KEEP)
    path = new_folder(spark, "scale")
    stats = plan.freeze_scale(cleaned.where("source <> 'src_R'"), now(), path)
    fresh = plan.score(cleaned.where("source = 'src_R'"), now(), ["snapshot_key"], stats=stats, distribution=path)
    return rounded(fresh.select("snapshot_key", "viral_score"))


@query("rates_per_hour", f"WITH {sql.SCORED} SELECT snapshot_key, {r6(*RATE_NAMES)} FROM logged")
def _(spark, sf):
    cleaned = plan.clean(snapshots(spark, sf), "snapshot_key", KEEP)
    return rounded(plan.rates(cleaned, now()).select("snapshot_key", *RATE_NAMES))


# ---- Projection, filters, duplicates -------------------------------------------------------------


def _raw_feed(df: DataFrame) -> DataFrame:
    """The snapshots under the column names and text types of a raw daily feed."""
    return df.select(
        F.col("snapshot_key"),
        F.col("videoId").alias("video_id"),
        "title",
        F.date_format("publishedAt", "yyyy-MM-dd HH:mm:ss").alias("publish_time"),
        F.date_format("trendingDate", "yyyy-MM-dd").alias("snapshot_date"),
        F.col("region").alias("country"),
        F.when(F.col("viewCount") % 7 == 0, F.format_number("viewCount", 0))
        .otherwise(F.col("viewCount").cast("string")).alias("view_count"),
        F.concat(F.col("likeCount").cast("string"), F.lit(".75")).alias("likes"),
        F.col("commentCount").cast("string").alias("comment_count"),
        F.col("rank").cast("string").alias("daily_rank"),
    )


@query(
    "canonical_snapshots",
    f"""WITH {sql.SNAPSHOTS}
    SELECT "videoId", title, CAST(NULL AS VARCHAR) AS description,
           strftime("publishedAt", '%Y-%m-%d') AS published, strftime("trendingDate", '%Y-%m-%d') AS trending, region,
           CASE WHEN "viewCount" % 7 = 0 AND "viewCount" >= 1000 THEN NULL ELSE "viewCount" END AS "viewCount",
           "likeCount", "commentCount", "rank" FROM snapshots""",
)
def _(spark, sf):
    raw = _raw_feed(snapshots(spark, sf)).drop("snapshot_key")
    df = normalize.conform(normalize.canonicalize(raw))
    return df.select(
        "videoId", "title", "description", F.date_format("publishedAt", "yyyy-MM-dd").alias("published"),
        F.date_format("trendingDate", "yyyy-MM-dd").alias("trending"), "region", "viewCount", "likeCount",
        "commentCount", "rank",
    )


@query(
    "canonical_without_extra_names",
    f"""WITH {sql.SNAPSHOTS} SELECT "videoId", CAST(NULL AS BIGINT) AS "likeCount", "commentCount" FROM snapshots""",
)
def _(spark, sf):
    raw = _raw_feed(snapshots(spark, sf)).drop("snapshot_key")
    return normalize.conform(normalize.canonicalize(raw, extra_aliases=None)).select(
        "videoId", "likeCount", "commentCount"
    )


@query(
    "coerced_counts",
    f"""WITH {sql.SNAPSHOTS} SELECT snapshot_key,
        CASE WHEN "viewCount" % 7 = 0 AND "viewCount" >= 1000 THEN 0 ELSE "viewCount" END AS view_count,
        "likeCount" AS likes, "commentCount" AS comment_count, coalesce("rank", 0) AS daily_rank FROM snapshots""",
)
def _(spark, sf):
    names = ["view_count", "likes", "comment_count", "daily_rank"]
    return normalize.coerce_counts(_raw_feed(snapshots(spark, sf)), names).select("snapshot_key", *names)


@query(
    "coerced_timestamps",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000000 END AS seconds,
              epoch_us(date_trunc('day', ts)) // 1000000 AS day_seconds FROM events""",
)
def _(spark, sf):
    raw = read(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_id") % 3 == 1, F.lit("3 days ago")).alias("ts"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )
    df = normalize.coerce_timestamps(raw, ["ts", "day"])
    return df.select(
        "event_id", F.unix_seconds("ts").alias("seconds"), F.unix_seconds("day").alias("day_seconds")
    )


@query(
    "union_of_sources",
    """SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_acctbal AS balance, CAST(NULL AS INTEGER) AS size
         FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier
       UNION ALL SELECT 'part', p_partkey, p_name, NULL, p_size FROM part""",
)
def _(spark, sf):
    customers = read(spark, sf, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"),
    )
    suppliers = read(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"),
        F.col("s_suppkey").alias("id"),
    )
    parts = read(spark, sf, "part").select(
        F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.col("p_size").alias("size"),
    )
    return normalize.union_sources(customers, suppliers, parts)


@query("short_texts", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END AS shown, "
       "CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS brief FROM documents")
def _(spark, sf):
    df = read(spark, sf, "documents")
    return df.select(
        "doc_id", texts.truncate_text(F.col("text"), 100, 97).alias("shown"),
        texts.truncate_text(F.col("text"), 50).alias("brief"),
    )


@query(
    "kept_regions",
    f"""WITH {sql.SNAPSHOTS} SELECT region, count(*) AS n FROM snapshots
        WHERE region IS NULL OR region IN ({sql.KEEP_LIST}) GROUP BY region""",
)
def _(spark, sf):
    return filters.filter_regions(snapshots(spark, sf), KEEP).groupBy("region").agg(F.count("*").alias("n"))


@query(
    "quality_rows",
    f"""WITH {sql.SNAPSHOTS},{sql.TEXTS} SELECT snapshot_key, "viewCount" FROM texts
        WHERE title IS NOT NULL AND description IS NOT NULL AND "publishedAt" IS NOT NULL AND "viewCount" >= 50000""",
)
def _(spark, sf):
    return filters.filter_quality(snapshots(spark, sf, texts=True), 50000).select("snapshot_key", "viewCount")


@query(
    "high_scores",
    f"""WITH {sql.SCORED} SELECT snapshot_key, title, {r6('viral_score')} FROM scored JOIN documents ON doc_ref = doc_id
        WHERE viral_score >= 0.8 AND title IS NOT NULL AND text IS NOT NULL""",
)
def _(spark, sf):
    df = filters.filter_score(with_texts(spark, sf, scored(spark, sf)), 0.8)
    return rounded(df.select("snapshot_key", "title", "viral_score"))


@query(
    "recent_rows",
    f"""WITH {sql.SNAPSHOTS} SELECT source, count(*) AS n FROM snapshots
        WHERE "trendingDate" >= TIMESTAMP '1996-12-01' OR "trendingDate" IS NULL GROUP BY source""",
)
def _(spark, sf):
    df = filters.filter_recent(snapshots(spark, sf), 5, AS_OF, "trendingDate")
    return df.groupBy("source").agg(F.count("*").alias("n"))


@query("deduplicated_snapshots", f"""WITH {sql.SNAPSHOTS},{sql.DEDUPED} SELECT snapshot_key, "videoId", region FROM deduped""")
def _(spark, sf):
    kept = filters.filter_regions(snapshots(spark, sf), KEEP)
    return dedup.dedup_keep_last(kept, ["videoId", "trendingDate", "region"], "snapshot_key").select(
        "snapshot_key", "videoId", "region"
    )


@query(
    "deduplicated_texts",
    f"""WITH {sql.SNAPSHOTS},{sql.TEXTS} SELECT min(snapshot_key) AS snapshot_key, title, md5(description) AS description
        FROM texts GROUP BY title, description""",
)
def _(spark, sf):
    # Compared by digest: a text is joined to the rows kept, not to every row that refers to it.
    texts_of = descriptions(spark, sf)
    df = dedup.dedup_text(texts_of.with_digest(snapshots(spark, sf)), ["title", texts_of.digest], "snapshot_key")
    return texts_of.with_text(df, "description").select("snapshot_key", "title", F.md5("description").alias("description"))


@query(
    "duplicate_documents",
    """SELECT count(*) AS n_rows, count(DISTINCT text || lang) AS n_distinct,
              count(*) - count(DISTINCT text || lang) AS n_duplicates FROM documents""",
)
def _(spark, sf):
    return dedup.duplicate_count(read(spark, sf, "documents"), ["text", "lang"])


# ---- Profiles ------------------------------------------------------------------------------------


@query(
    "completeness",
    f"""WITH {sql.SNAPSHOTS},{sql.TEXTS} SELECT count(*) AS n_rows,
        count(*) FILTER (title IS NULL OR title = '') AS missing_title,
        count(*) FILTER (description IS NULL OR description = '') AS missing_description,
        count(*) FILTER ("publishedAt" IS NULL) AS missing_published,
        count(DISTINCT "videoId") AS unique_videos FROM texts""",
)
def _(spark, sf):
    return profile.completeness(snapshots(spark, sf, texts=True))


@query(
    "date_coverage",
    f"""WITH {sql.SNAPSHOTS} SELECT source, count(*) AS total, count("trendingDate") AS with_date,
        count(*) - count("trendingDate") AS without_date,
        round(100.0::DOUBLE * count("trendingDate") / count(*), 2) AS date_percentage FROM snapshots GROUP BY source""",
)
def _(spark, sf):
    df = snapshots(spark, sf).withColumn("publishedAt", F.col("trendingDate"))
    return profile.date_coverage(df, "source")


@query(
    "largest_sources",
    f"""WITH {sql.SNAPSHOTS} SELECT data_source, count(*) AS "count", count("publishedAt") AS with_date,
        epoch_us(min("publishedAt")) // 1000000 AS earliest, epoch_us(max("publishedAt")) // 1000000 AS latest
        FROM snapshots GROUP BY data_source ORDER BY 2 DESC, 1 LIMIT 20""",
)
def _(spark, sf):
    df = profile.source_stats(snapshots(spark, sf))
    return df.select(
        "data_source", "count", "with_date", F.unix_seconds("earliest_date").alias("earliest"),
        F.unix_seconds("latest_date").alias("latest"),
    )


def _count_sql(prefix: str, thresholds, col: str = "viral_score") -> str:
    return ", ".join(f"count(*) FILTER ({col} >= {t}) AS {profile.threshold_name(prefix, t)}" for t in thresholds)


# Fixed values.
SOURCE_THRESHOLDS = (0.40, 0.20, 0.10, 0.05)
TABLE_THRESHOLDS = (0.20, 0.205, 0.21, 0.215, 0.22)
SWEEP = (0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)


@query(
    "score_thresholds_by_source",
    f"WITH {sql.SCORED} SELECT source, count(*) AS total, {_count_sql('vs', SOURCE_THRESHOLDS)} FROM scored GROUP BY source",
)
def _(spark, sf):
    return profile.threshold_counts(scored(spark, sf), "viral_score", SOURCE_THRESHOLDS, ["source"], "vs")


@query(
    "score_thresholds",
    f"WITH {sql.SCORED} SELECT count(*) AS total, {_count_sql('vs', TABLE_THRESHOLDS)} FROM scored",
)
def _(spark, sf):
    return profile.threshold_counts(scored(spark, sf), "viral_score", TABLE_THRESHOLDS, prefix="vs")


@query(
    "threshold_sweep",
    f"WITH {sql.SCORED} SELECT t::DOUBLE AS threshold, count(*) FILTER (viral_score >= t::DOUBLE) AS n "
    f"FROM scored, unnest([{', '.join(map(str, SWEEP))}]) AS u(t) WHERE title IS NOT NULL GROUP BY t",
)
def _(spark, sf):
    return profile.threshold_sweep(scored(spark, sf).where("title is not null"), "viral_score", SWEEP)


@query(
    "recency_counts",
    f"""WITH {sql.SNAPSHOTS} SELECT count(*) FILTER ("trendingDate" >= TIMESTAMP '2000-12-01') AS last_1yr,
        count(*) FILTER ("trendingDate" >= TIMESTAMP '1998-12-01') AS last_3yr,
        count(*) FILTER ("trendingDate" >= TIMESTAMP '1996-12-01') AS last_5yr,
        count("trendingDate") AS with_date, count(*) - count("trendingDate") AS without_date FROM snapshots""",
)
def _(spark, sf):
    return profile.recency_counts(snapshots(spark, sf), AS_OF, col="trendingDate")


@query(
    "cleaning_report",
    f"WITH {sql.SCORED} " + " UNION ALL ".join(
        f"""SELECT '{phase}' AS phase, count(*) AS n_rows, count(*) FILTER (title IS NULL OR title = '') AS missing_title,
            count(*) FILTER (d.text IS NULL OR d.text = '') AS missing_description,
            count(*) FILTER ("publishedAt" IS NULL) AS missing_published, count(DISTINCT "videoId") AS unique_videos
            FROM {table} LEFT JOIN documents d ON doc_ref = d.doc_id"""
        for phase, table in (("before", "snapshots"), ("after", "scored"))
    ),
)
def _(spark, sf):
    return plan.cleaning_report(snapshots(spark, sf, texts=True), with_texts(spark, sf, scored(spark, sf)))


@query(
    "combined_filters",
    f"""WITH {sql.SCORED} SELECT
        count(*) FILTER (viral_score >= 0.10 AND title IS NOT NULL AND d.text IS NOT NULL
                         AND ("trendingDate" >= TIMESTAMP '1996-12-01' OR "trendingDate" IS NULL)) AS current_filter,
        count(*) FILTER (viral_score >= 0.05 AND title IS NOT NULL AND d.text IS NOT NULL) AS relaxed_filter
        FROM scored LEFT JOIN documents d ON doc_ref = d.doc_id""",
)
def _(spark, sf):
    titled = F.col("title").isNotNull() & F.col("description").isNotNull()
    return profile.predicate_counts(
        with_texts(spark, sf, scored(spark, sf)),
        {
            "current_filter": (F.col("viral_score") >= 0.10) & titled & filters.recent("trendingDate", 5, AS_OF),
            "relaxed_filter": (F.col("viral_score") >= 0.05) & titled,
        },
    )


def _bin_sql(edges, closed: str, col: str, tag: str = "") -> str:
    """CASE expression for the bin number."""
    parts = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        a, b = f"{a}::DOUBLE", f"{b}::DOUBLE"
        if closed == "right":
            cond = f"{col} > {a} AND {col} <= {b}"
        elif closed == "left" or i < len(edges) - 2:
            cond = f"{col} >= {a} AND {col} < {b}"
        else:
            cond = f"{col} >= {a} AND {col} <= {b}"
        parts.append(f"WHEN {cond} THEN {i}")
    return f"CASE {' '.join(parts)} END"


def _histogram_sql(with_: str, table: str, col: str, edges, closed: str) -> str:
    bounds = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return f"""WITH {with_}, binned AS (SELECT {_bin_sql(edges, closed, col)} AS bin FROM {table}),
      bounds(bin, lo, hi) AS (VALUES {bounds})
      SELECT b.bin, b.lo, b.hi, count(x.bin) AS "count",
             round(100.0::DOUBLE * count(x.bin) / (SELECT count(*) FROM {table}), 6) AS pct
      FROM bounds b LEFT JOIN binned x ON b.bin = x.bin GROUP BY b.bin, b.lo, b.hi"""


@query("histogram_left_closed", _histogram_sql(sql.SCORED, "scored", "viral_score", BIAS_EDGES, "left"))
def _(spark, sf):
    return rounded(profile.histogram(scored(spark, sf), "viral_score", BIAS_EDGES, "left"))


@query("histogram_right_closed", _histogram_sql(sql.SCORED, "scored", "viral_score", REPORT_EDGES, "right"))
def _(spark, sf):
    return rounded(profile.histogram(scored(spark, sf), "viral_score", REPORT_EDGES, "right"))


@query("histogram_last_bin_closed", _histogram_sql(sql.PREDICTIONS, "predictions", "p3", DECILE_EDGES, "numpy"))
def _(spark, sf):
    return rounded(profile.histogram(predictions(spark, sf), "p3", DECILE_EDGES, "numpy"))


def _describe_sql(cols) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, round(avg("{c}"), 6) AS mean, round(stddev_samp("{c}"), 6) AS std,
        round(min("{c}"), 6) AS min, round(quantile_cont("{c}", 0.25), 6) AS p25,
        round(quantile_cont("{c}", 0.5), 6) AS p50, round(quantile_cont("{c}", 0.75), 6) AS p75,
        round(max("{c}"), 6) AS max, round(100.0::DOUBLE * count(*) FILTER ("{c}" IS NULL) / count(*), 6) AS null_pct,
        round(100.0::DOUBLE * count(*) FILTER ("{c}" = 0) / count(*), 6) AS zero_pct FROM scored"""
        for c in cols
    )


@query("metric_statistics", f"WITH {sql.SCORED} {_describe_sql(METRICS)}")
def _(spark, sf):
    return rounded(profile.describe_metrics(scored(spark, sf), METRICS))


@query(
    "metric_correlations",
    f"WITH {sql.SCORED} "
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS metric_a, '{b}' AS metric_b, round(corr("{a}", "{b}"), 6) AS corr FROM scored"""
        for a in METRICS for b in METRICS
    ),
)
def _(spark, sf):
    return rounded(profile.correlation_matrix(scored(spark, sf), METRICS))


@query(
    "score_summary",
    f"""WITH {sql.SCORED} SELECT count(v) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean,
        count(DISTINCT v) AS n_unique, round(quantile_cont(v, 0.5), 6) AS median
        FROM (SELECT round(viral_score, 6) AS v FROM scored)""",
)
def _(spark, sf):
    df = scored(spark, sf).select(F.round("viral_score", 6).alias("v"))
    return rounded(profile.summary(df, "v"))


@query(
    "language_distribution",
    """SELECT lang, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 6) AS pct
       FROM documents GROUP BY lang ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(spark, sf):
    return rounded(profile.value_distribution(read(spark, sf, "documents"), "lang"))


@query(
    "label_bias",
    """WITH top AS (
         SELECT round(l_discount, 4) AS label, count(*) AS n,
                100.0::DOUBLE * count(*) / (SELECT count(*) FROM lineitem) AS pct
         FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
       SELECT label, n, round(pct, 6) AS pct, max(pct) OVER () > 30.0 AS biased FROM top""",
)
def _(spark, sf):
    return rounded(profile.label_bias(read(spark, sf, "lineitem"), "l_discount"))


@query(
    "range_check",
    f"WITH {sql.SCORED} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, count(*) FILTER ("{c}" < 0) AS below, count(*) FILTER ("{c}" > 1) AS above,
            count(*) FILTER ("{c}" < 0 OR "{c}" > 1) = 0 AS ok FROM scored"""
        for c in ("viral_score", "recency_n", "viewsPerHr_log")
    ),
)
def _(spark, sf):
    return profile.range_check(scored(spark, sf), ["viral_score", "recency_n", "viewsPerHr_log"])


@query(
    "dataset_checks",
    f"""WITH {sql.EXAMPLES}, s AS (SELECT
          count(*) FILTER (split = 'train') AS n,
          count(*) FILTER (split = 'train' AND trim(prompt) = '') AS ep,
          count(*) FILTER (split = 'train' AND trim(response) = '') AS er,
          count(*) FILTER (split = 'train' AND length(response) < 10) AS short,
          count(*) FILTER (split = 'test') AS nt,
          (SELECT max(c) FROM (SELECT count(*) AS c FROM examples WHERE split = 'train' GROUP BY response)) AS top
          FROM examples)
        SELECT 'train_rows' AS "check", n::DOUBLE AS value, 1000::DOUBLE AS "limit", n >= 1000 AS ok FROM s
        UNION ALL SELECT 'empty_prompts', ep, 0, ep = 0 FROM s
        UNION ALL SELECT 'empty_responses', er, 0, er = 0 FROM s
        UNION ALL SELECT 'top_response', top, round(n * 0.1::DOUBLE, 6), top <= n * 0.1 FROM s
        UNION ALL SELECT 'short_responses', short, round(n * 0.2::DOUBLE, 6), short <= n * 0.2 FROM s
        UNION ALL SELECT 'test_rows', nt, 1, nt >= 1 FROM s""",
)
def _(spark, sf):
    return rounded(profile.dataset_checks(examples(spark, sf)))


@query(
    "peek_rows",
    f"""WITH {sql.SNAPSHOTS} SELECT snapshot_key, "videoId", title, doc_ref, region, "viewCount", "likeCount", "commentCount",
        "rank", source, data_source FROM snapshots ORDER BY snapshot_key LIMIT 3""",
)
def _(spark, sf):
    return profile.peek(snapshots(spark, sf), 3, "snapshot_key").drop("publishedAt", "trendingDate")


SNAPSHOT_TYPES = {
    "snapshot_key": "string", "videoId": "string", "title": "string", "doc_ref": "bigint", "publishedAt": "timestamp",
    "trendingDate": "timestamp", "region": "string", "viewCount": "bigint", "likeCount": "bigint",
    "commentCount": "bigint", "rank": "bigint", "source": "string", "data_source": "string",
}


@query(
    "described_columns",
    f"WITH {sql.SNAPSHOTS} "
    + " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, count(*) AS n_rows, count("{c}") AS n_known
            FROM snapshots"""
        for i, (c, t) in enumerate(SNAPSHOT_TYPES.items())
    ),
)
def _(spark, sf):
    return profile.describe_table(snapshots(spark, sf))


@query("feature_version", f"WITH {sql.SNAPSHOTS},{sql.DEDUPED} SELECT '1.0.0' AS feature_version, count(*) AS n FROM deduped")
def _(spark, sf):
    done = scored(spark, sf)
    assert feature_config().version in FEATURE_CONFIGS
    return done.groupBy("feature_version").agg(F.count("*").alias("n"))


# ---- Texts ---------------------------------------------------------------------------------------

UPPER_RE2 = texts.UPPER_CLASS
DIGIT_RE2 = "[" + texts.LOW_DIGIT_CLASS[1:-1] + texts.HIGH_DIGIT_CLASS[1:-1] + "]"


def _count_re(pattern: str, col: str = "text") -> str:
    return f"len(regexp_extract_all({col}, '{pattern}'))"


@query(
    "text_features",
    f"""SELECT doc_id, length(text) AS length, {_count_re('[?]')} AS question_marks,
        {_count_re('!')} AS exclamation_marks,
        round({_count_re(UPPER_RE2)}::DOUBLE / greatest(length(text), 1), 6) AS uppercase_ratio,
        round({_count_re(DIGIT_RE2)}::DOUBLE / greatest(length(text), 1), 6) AS digit_ratio,
        """
    + ", ".join(f"regexp_matches(text, '{p}')::INTEGER AS {n}" for n, p in texts.SCRIPT_CLASSES.items())
    + " FROM documents",
)
def _(spark, sf):
    df = read(spark, sf, "documents")
    return rounded(df.select("doc_id", *[c.alias(n) for n, c in texts.text_features(F.col("text")).items()]))


def _language_sql(col: str) -> str:
    words = f"regexp_split_to_array(lower({col}), '[^\\p{{L}}]+')"
    parts = []
    for place, (code, known) in enumerate(texts.STOP_WORDS.items()):
        listed = ", ".join(f"'{w}'" for w in known)
        parts.append(f"{{'hits': len(list_filter(w, lambda x: x IN ({listed}))), 'place': {-place}, 'code': '{code}'}}")
    scripts = " ".join(f"WHEN regexp_matches({col}, '{p}') THEN '{code}'" for code, p in texts.SCRIPT_LANGUAGES)
    best = f"list_max([{', '.join(parts)}]).code"
    return f"CASE WHEN length(trim({col}, chr(9) || chr(10) || chr(13) || ' ')) < 5 THEN 'en' {scripts} ELSE {best} END", words


_LANG_CASE, _LANG_WORDS = _language_sql("text")


@query(
    "detected_language",
    f"SELECT doc_id, lang, {_LANG_CASE} AS detected FROM (SELECT *, {_LANG_WORDS} AS w FROM documents)",
)
def _(spark, sf):
    return read(spark, sf, "documents").select(
        "doc_id", "lang", texts.detect_language(F.col("text")).alias("detected")
    )


@query(
    "language_groups",
    """SELECT grp AS language_group, count(*) AS n, min(shown) AS first_text FROM (
         SELECT CASE WHEN lang IN ('en', 'es', 'fr', 'pt', 'it', 'de', 'nl') THEN 'latin' ELSE 'other' END AS grp,
                CASE WHEN lang IN ('en', 'es', 'fr', 'pt', 'it', 'de', 'nl') THEN '[latin] ' ELSE '[other] ' END
                  || md5(text) AS shown FROM documents) GROUP BY grp""",
)
def _(spark, sf):
    df = read(spark, sf, "documents").select(
        texts.language_group(F.col("lang")).alias("language_group"),
        texts.prefix_group(F.md5("text"), F.col("lang")).alias("shown"),
    )
    return df.groupBy("language_group").agg(F.count("*").alias("n"), F.min("shown").alias("first_text"))


_PROMPT_SQL = "'" + texts.PROMPT.replace("'", "''") + "'"


@query(
    "training_examples",
    f"""WITH {sql.SNAPSHOTS},{sql.TEXTS}, built AS (
          SELECT snapshot_key, coalesce(title, '') AS title,
                 substr(trim(coalesce(description, ''), chr(9) || chr(10) || chr(13) || ' '), 1, 300) AS short FROM texts)
        SELECT snapshot_key, md5({_PROMPT_SQL}) AS prompt, md5(short) AS description, title,
               md5(title || CASE WHEN short <> '' THEN chr(10) || 'Description: ' || short ELSE '' END) AS response,
               md5({_PROMPT_SQL} || title || CASE WHEN short <> '' THEN chr(10) || 'Description: ' || short ELSE '' END)
                 AS sft_text FROM built""",
)
def _(spark, sf):
    df = training.build_sft(snapshots(spark, sf, texts=True), extra=["snapshot_key"])
    return df.select(
        "snapshot_key", F.md5("prompt").alias("prompt"), F.md5("description").alias("description"), "title",
        F.md5("response").alias("response"), F.md5(training.sft_text()).alias("sft_text"),
    )


@query("text_keys", "SELECT doc_id, md5(trim(replace(text, chr(10), ' '), chr(9) || chr(13) || ' ')) AS text_key FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(texts.text_key(F.col("text"))).alias("text_key"))


# ---- Sampling and splitting ----------------------------------------------------------------------


@query("sampled_rows", f"WITH {sql.SNAPSHOTS} SELECT snapshot_key FROM snapshots ORDER BY md5('42|' || snapshot_key) LIMIT 1000")
def _(spark, sf):
    return sampling.sample_n(snapshots(spark, sf), 1000, ["snapshot_key"]).select("snapshot_key")


def _cap_sql(edges, closed: str, n: int) -> str:
    return f"""WITH {sql.SCORED}, binned AS (
        SELECT snapshot_key, {_bin_sql(edges, closed, 'viral_score')} AS bin FROM scored)
      SELECT snapshot_key FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('42|' || snapshot_key)) AS rn
        FROM binned WHERE bin IS NOT NULL) WHERE rn <= {n}"""


@query("stratified_by_tenths", _cap_sql(DECILE_EDGES, "right", 2500))
def _(spark, sf):
    return sampling.stratified_cap(
        scored(spark, sf), "viral_score", DECILE_EDGES, 2500, ["snapshot_key"], closed="right"
    ).select("snapshot_key")


@query("stratified_by_buckets", _cap_sql(BALANCE_EDGES, "left", 8000))
def _(spark, sf):
    return sampling.stratified_cap(
        scored(spark, sf), "viral_score", BALANCE_EDGES, 8000, ["snapshot_key"], closed="left"
    ).select("snapshot_key")


@query(
    "rebalanced",
    f"""WITH {sql.SCORED}, binned AS (SELECT snapshot_key, {_bin_sql(BALANCE_EDGES, 'left', 'viral_score')} AS bin FROM scored),
      sized AS (SELECT *, count(*) OVER (PARTITION BY bin) AS c, count(*) OVER () AS n,
                row_number() OVER (PARTITION BY bin ORDER BY md5('42|' || snapshot_key)) AS rn FROM binned)
      SELECT snapshot_key, bin FROM sized WHERE bin IS NOT NULL AND rn <= least(c,
        CASE WHEN c > n * 0.15::DOUBLE THEN floor(n * 0.15::DOUBLE) ELSE greatest(least(c, 8000), 2000) END)""",
)
def _(spark, sf):
    kept = sampling.rebalance(scored(spark, sf), "viral_score", ["snapshot_key"])
    return kept.select("snapshot_key", profile.bin_index(F.col("viral_score"), BALANCE_EDGES, "left").alias("bin"))


def _noise_sql(ctes: str = sql.SCORED, table: str = "scored") -> str:
    ua, ub, uc = (sql.unit("snapshot_key", f"42{x}") for x in "abc")
    widths = "[" + ", ".join(f"{b}::DOUBLE - {a}::DOUBLE" for a, b in zip(BALANCE_EDGES, BALANCE_EDGES[1:])) + "]"
    return f"""WITH {ctes}, a AS (
        SELECT snapshot_key, v, bin, {widths}[bin + 1] * (0.15::DOUBLE + {ua} * 0.15::DOUBLE) AS scale FROM (
          SELECT snapshot_key, viral_score AS v, {_bin_sql(BALANCE_EDGES, 'left', 'viral_score')} AS bin FROM {table})),
      m AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, v + CASE WHEN v > 0.199::DOUBLE AND v < 0.201::DOUBLE
              THEN -{ub} * scale ELSE ({ub} - 0.5::DOUBLE) * scale * 2.0::DOUBLE END)) AS moved FROM a)
      SELECT snapshot_key, round(CASE WHEN bin IS NULL THEN v
        WHEN abs(moved - round(moved, 4)) < 0.0001 THEN moved + {uc} * 0.0001::DOUBLE ELSE moved END, 6) AS viral_score FROM m"""


@query("noisy_scores", _noise_sql())
def _(spark, sf):
    return rounded(
        sampling.bin_noise(scored(spark, sf), "viral_score", ["snapshot_key"]).select("snapshot_key", "viral_score")
    )


_REPAIRED = f"""{sql.SCORED}, labelled AS (
        SELECT snapshot_key, viral_score, {_bin_sql(BALANCE_EDGES, 'left', 'viral_score')} AS b,
          row_number() OVER (ORDER BY md5('42|' || snapshot_key)) <= ceil(count(*) OVER () * 0.1::DOUBLE) AS test FROM scored),
      crowded AS (SELECT *, count(*) OVER (PARTITION BY test, b) AS c, count(*) OVER (PARTITION BY test) AS n,
          row_number() OVER (PARTITION BY test, b ORDER BY md5('42|' || snapshot_key)) AS rn FROM labelled),
      thinned AS (SELECT snapshot_key, viral_score FROM crowded WHERE test OR (b IS NOT NULL AND rn <= least(c,
          CASE WHEN c > n * 0.15::DOUBLE THEN floor(n * 0.15::DOUBLE) ELSE greatest(least(c, 8000), 2000) END)))"""


@query("repaired_bias", _noise_sql(_REPAIRED, "thinned"))
def _(spark, sf):
    labelled = sampling.train_test_split(scored(spark, sf).select("snapshot_key", "viral_score"), 0.1, ["snapshot_key"])
    return rounded(training.fix_bias(labelled, ["snapshot_key"]).select("snapshot_key", "viral_score"))


@query(
    "prepared_stratified_set",
    f"""WITH {sql.SCORED}, binned AS (
        SELECT snapshot_key, viral_score, {_bin_sql(DECILE_EDGES, 'right', 'viral_score')} AS bin FROM scored),
      numbered AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('42|' || snapshot_key)) AS rn
        FROM binned WHERE bin IS NOT NULL),
      capped AS (SELECT * FROM numbered WHERE rn <= 2500)
      SELECT snapshot_key, round(viral_score, 6) AS viral_score, CASE WHEN row_number() OVER (ORDER BY md5('42|' || snapshot_key))
        <= ceil(count(*) OVER () * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM capped""",
)
def _(spark, sf):
    prepared = training.prepare_stratified(with_texts(spark, sf, scored(spark, sf)), "snapshot_key", 2500)
    return rounded(prepared.select("snapshot_key", "viral_score", "split"))


@query(
    "exact_split",
    f"""WITH {sql.SNAPSHOTS} SELECT snapshot_key, CASE WHEN row_number() OVER (ORDER BY md5('42|' || snapshot_key))
        <= ceil(count(*) OVER () * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM snapshots""",
)
def _(spark, sf):
    return sampling.train_test_split(snapshots(spark, sf), 0.1, ["snapshot_key"]).select("snapshot_key", "split")


@query(
    "split_by_video",
    f"""WITH {sql.SNAPSHOTS} SELECT "videoId", CASE WHEN {sql.unit('"videoId"', '42')} < 0.1 THEN 'test' ELSE 'train' END
        AS split, count(*) AS n FROM snapshots GROUP BY 1, 2""",
)
def _(spark, sf):
    df = sampling.train_test_split(snapshots(spark, sf), 0.1, ["videoId"], exact=False)
    return df.groupBy("videoId", "split").agg(F.count("*").alias("n"))


@query(
    "tail_holdout",
    f"""WITH {sql.SNAPSHOTS} SELECT snapshot_key FROM (SELECT snapshot_key, count(*) OVER () AS n,
          {sql.ordinal_rank('"viewCount"', 'snapshot_key')} - 1 AS pos FROM snapshots)
        WHERE pos >= floor(n * (1 - 0.1::DOUBLE))""",
)
def _(spark, sf):
    return sampling.tail_holdout(snapshots(spark, sf), 0.1, "viewCount", ["snapshot_key"]).where("holdout").select(
        "snapshot_key"
    )


@query(
    "inverse_frequency_weights",
    """SELECT doc_id, round(1.0::DOUBLE / (count(*) OVER (PARTITION BY lang) + 1), 9) AS weight FROM documents""",
)
def _(spark, sf):
    return rounded(sampling.inverse_freq_weight(read(spark, sf, "documents"), "lang").select("doc_id", "weight"), 9)


# Rows of (key, weight, ...) own stretches of a line by the hash of their key; as many points are drawn as there are rows.
_RESAMPLED = """
      usable AS (SELECT *, md5('42|' || key) AS h FROM weighted WHERE weight > 0),
      scale AS (SELECT max(weight) AS most, pow(2::DOUBLE, 58 - ceil(log2(count(*)))) AS unit FROM usable),
      total AS (SELECT sum(greatest(1, CAST(floor(weight / most * unit) AS BIGINT))) AS total FROM usable, scale),
      units AS (SELECT usable.*, greatest(1, CAST(floor(weight / most * unit / total::DOUBLE * pow(2::DOUBLE, 58)) AS BIGINT)) AS w
                FROM usable, scale, total),
      line AS (SELECT *, sum(w) OVER (ORDER BY h) - w AS lo, sum(w) OVER (ORDER BY h) AS hi FROM units),
      draws AS (SELECT md5('42n|' || key) AS draw FROM weighted),
      spots AS (SELECT draw, CAST(CAST(('0x' || substr(md5('42draw|' || draw), 1, 15)) AS BIGINT)::HUGEINT
                  * (SELECT max(hi) FROM line) // 1152921504606846976::HUGEINT AS BIGINT) AS spot FROM draws),
      drawn AS (SELECT * FROM spots JOIN line ON spot >= lo AND spot < hi)"""


@query(
    "weighted_resample",
    f"""WITH weighted AS (SELECT doc_id AS key, lang,
          1.0::DOUBLE / (count(*) OVER (PARTITION BY lang) + 1) AS weight FROM documents), {_RESAMPLED}
      SELECT draw, key AS doc_id, lang FROM drawn""",
)
def _(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "lang")
    weighted = sampling.inverse_freq_weight(docs, "lang")
    return sampling.weighted_resample(weighted, "weight", None, ["doc_id"]).select("draw", "doc_id", "lang")


@query(
    "weighted_resample_by_views",
    f"""WITH {sql.SNAPSHOTS}, weighted AS (SELECT snapshot_key AS key, "viewCount"::DOUBLE AS weight FROM snapshots), {_RESAMPLED}
      SELECT draw, key AS snapshot_key, weight::BIGINT AS views FROM drawn""",
)
def _(spark, sf):
    df = snapshots(spark, sf).select("snapshot_key", "viewCount")
    drawn = sampling.weighted_resample(df, "viewCount", None, ["snapshot_key"])
    return drawn.select("draw", "snapshot_key", F.col("viewCount").alias("views"))


# ---- Ranks, blends, evaluation -------------------------------------------------------------------


@query(
    "percentiles",
    f"""WITH {sql.SNAPSHOTS} SELECT snapshot_key,
        round(({sql.ordinal_rank('"commentCount"', 'snapshot_key')} - 1)::DOUBLE / (count(*) OVER () - 1), 9) AS ordinal,
        round({sql.average_rank('"commentCount"')} / count(*) OVER () * 100, 9) AS average,
        round(percent_rank() OVER (ORDER BY "commentCount"), 9) AS minimum FROM snapshots""",
)
def _(spark, sf):
    df = snapshots(spark, sf).select("snapshot_key", "commentCount")
    kinds = {"ordinal": "ordinal", "average": "average", "minimum": "min"}
    df = rank.pct_ranks(df, [rank.Rank("commentCount", out, t) for out, t in kinds.items()], tie_key=["snapshot_key"])
    df = df.withColumn("average", F.col("average") * 100)
    return rounded(df.select("snapshot_key", "ordinal", "average", "minimum"), 9)


@query(
    "percentiles_by_region",
    f"""WITH {sql.SNAPSHOTS} SELECT snapshot_key, region,
        round({sql.average_rank('"viewCount"', 'region')} / count(*) OVER (PARTITION BY region), 9) AS pct FROM snapshots""",
)
def _(spark, sf):
    df = snapshots(spark, sf).select("snapshot_key", "region", "viewCount")
    return rounded(rank.pct_rank(df, "viewCount", "pct", by=["region"]).select("snapshot_key", "region", "pct"), 9)


@query(
    "weighted_blend",
    f"""WITH {sql.PREDICTIONS} SELECT id, round(p1 * (3.0::DOUBLE / 6) + p2 * (2.0::DOUBLE / 6) + p3 * (1.0::DOUBLE / 6), 9)
        + 0.0::DOUBLE AS blend FROM predictions""",
)
def _(spark, sf):
    return rounded(blend.blend(predictions(spark, sf), ["p1", "p2", "p3"], [3, 2, 1]).select("id", "blend"), 9)


@query(
    "ranked_blend",
    f"""WITH {sql.PREDICTIONS}, r AS (SELECT id,
          ({sql.ordinal_rank('p1', 'id')} - 1)::DOUBLE / (count(*) OVER () - 1) AS r1,
          ({sql.ordinal_rank('p2', 'id')} - 1)::DOUBLE / (count(*) OVER () - 1) AS r2 FROM predictions)
        SELECT id, round(0.5::DOUBLE + 0.5::DOUBLE * tanh((0.4::DOUBLE * r1 + 0.6::DOUBLE * r2 - 0.5::DOUBLE) / 0.2::DOUBLE), 6)
               AS blend FROM r""",
)
def _(spark, sf):
    df = blend.blend(predictions(spark, sf), ["p1", "p2"], [0.4, 0.6], rank=True, tie_key=["id"], clip="soft")
    return rounded(df.select("id", "blend"))


@query(
    "clipped_predictions",
    f"""WITH {sql.PREDICTIONS} SELECT id, round(0.5::DOUBLE + 0.5::DOUBLE * tanh((p1 - 0.5::DOUBLE) / 0.2::DOUBLE), 6) AS soft,
        round(0.5::DOUBLE + 0.5::DOUBLE * tanh((p1 - 0.5::DOUBLE) / 0.4::DOUBLE), 6) AS soft_wide,
        round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (p1 - 0.05::DOUBLE) / 0.9::DOUBLE)), 6) AS linear FROM predictions""",
)
def _(spark, sf):
    p = F.col("p1")
    return rounded(
        predictions(spark, sf).select(
            "id", clipping.soft_clip(p).alias("soft"), clipping.soft_clip(p, 0.4).alias("soft_wide"),
            clipping.linear_clip(p).alias("linear"),
        )
    )


@query(
    "spread_scores",
    f"""WITH {sql.PREDICTIONS} SELECT id, round(1 / (1 + exp(-5.0::DOUBLE * ((p1 - min(p1) OVER ())
        / (max(p1) OVER () - min(p1) OVER ()) - 0.5::DOUBLE))), 6) AS spread FROM predictions""",
)
def _(spark, sf):
    return rounded(scale.sigmoid_spread(predictions(spark, sf), "p1", "spread").select("id", "spread"))


@query(
    "standardized_labels",
    f"""WITH {sql.PREDICTIONS}, s AS (SELECT avg(y) AS m, stddev_pop(y) AS d FROM predictions WHERE fold <> 0)
        SELECT id, round((y - m) / d, 6) + 0.0::DOUBLE AS z, round((y - m) / d * d + m, 6) + 0.0::DOUBLE AS back
        FROM predictions, s""",
)
def _(spark, sf):
    df = predictions(spark, sf)
    fitted = scale.fit_standardizer(df.where("fold <> 0"), "y")
    done = scale.unstandardize(scale.standardize(df, "y", fitted, "z"), "z", fitted, "back")
    return rounded(done.select("id", "z", "back"))


@query("mean_squared_error", f"WITH {sql.PREDICTIONS} SELECT fold, round(avg(pow(y - p1, 2)), 6) AS mse FROM predictions GROUP BY fold")
def _(spark, sf):
    return rounded(evaluate.mse(predictions(spark, sf), "y", "p1", ["fold"]))


@query(
    "spearman",
    f"""WITH {sql.PREDICTIONS}, r AS (SELECT {sql.average_rank('y')} AS ry, {sql.average_rank('p3')} AS rp FROM predictions)
        SELECT count(*) AS n, round(corr(ry, rp), 6) AS spearman FROM r""",
)
def _(spark, sf):
    return rounded(evaluate.spearman(predictions(spark, sf), "y", "p3"))


def _metrics_by_sql(by: str) -> str:
    return f"""r AS (SELECT {by} AS g, y, p1, {sql.average_rank('y', by)} AS ry, {sql.average_rank('p1', by)} AS rp FROM predictions)
        SELECT g AS "{by}", count(*) AS n, round(avg(pow(y - p1, 2)), 6) AS mse, round(corr(ry, rp), 6) AS spearman
        FROM r GROUP BY g HAVING count(*) >= 10"""


@query("metrics_by_language", f"WITH {sql.PREDICTIONS}, {_metrics_by_sql('lang')}")
def _(spark, sf):
    return rounded(evaluate.metrics_by(predictions(spark, sf), "y", "p1", "lang"))


@query(
    "metrics_by_language_group",
    f"""WITH {sql.PREDICTIONS.replace('predictions AS', 'ungrouped AS', 1)},
        predictions AS (SELECT *, CASE {" ".join(
            f"WHEN lang IN ({', '.join(repr(c) for c in codes)}) THEN '{name}'" for name, codes in texts.LANGUAGE_GROUPS.items()
        )} ELSE 'other' END AS language_group FROM ungrouped), {_metrics_by_sql('language_group')}""",
)
def _(spark, sf):
    df = predictions(spark, sf).withColumn("language_group", texts.language_group(F.col("lang")))
    return rounded(evaluate.metrics_by(df, "y", "p1", "language_group", known_groups=len(texts.LANGUAGE_GROUPS) + 1))


GRID = [(1.0 - i / 20, i / 20) for i in range(21)]


# 66 weight vectors of three models: even, each alone, each pair, then keyed exponentials scaled to 1.
SIMPLEX = """grid AS (
      SELECT grid_id, w[1] AS w_p1, w[2] AS w_p2, w[3] AS w_p3 FROM (
        SELECT 0 AS grid_id, [1.0::DOUBLE / 3, 1.0::DOUBLE / 3, 1.0::DOUBLE / 3] AS w
        UNION ALL SELECT * FROM (VALUES (1, [1.0::DOUBLE, 0.0, 0.0]), (2, [0.0::DOUBLE, 1.0, 0.0]), (3, [0.0::DOUBLE, 0.0, 1.0]),
            (4, [0.5::DOUBLE, 0.5, 0.0]), (5, [0.5::DOUBLE, 0.0, 0.5]), (6, [0.0::DOUBLE, 0.5, 0.5]))
        UNION ALL SELECT 7 + i, [e[1] / (e[1] + e[2] + e[3]), e[2] / (e[1] + e[2] + e[3]), e[3] / (e[1] + e[2] + e[3])] FROM (
            SELECT i, list_transform(range(3), lambda j:
                -ln((CAST('0x' || substr(md5('42|' || i || '|' || j), 1, 8) AS BIGINT) + 1) / 4294967297.0::DOUBLE)) AS e
            FROM range(59) t(i))))"""


def _search_sql(cols, weights, table: str = "held") -> str:
    names = ", ".join(f"w_{c}" for c in cols)
    mix = " + ".join(f"w_{c} * {c}" for c in cols)
    grid = weights
    if not isinstance(weights, str):
        values = ", ".join(f"({i}, {', '.join(f'{w!r}::DOUBLE' for w in ws)})" for i, ws in enumerate(weights))
        grid = f"grid(grid_id, {names}) AS (VALUES {values})"
    return f"""{grid},
      b AS (SELECT grid_id, {names}, y, {mix} AS p FROM {table}, grid),
      r AS (SELECT grid_id, {names}, {sql.average_rank('y', 'grid_id')} AS ry, {sql.average_rank('p', 'grid_id')} AS rp FROM b),
      found AS (SELECT grid_id, {', '.join(f'any_value(w_{c}) AS w_{c}' for c in cols)}, corr(ry, rp) AS spearman
                FROM r GROUP BY grid_id)"""


@query(
    "blend_grid",
    f"""WITH {sql.PREDICTIONS}, held AS (SELECT * FROM predictions), {_search_sql(['p1', 'p2'], GRID)}
        SELECT grid_id, {r6('w_p1', 'w_p2')}, round(spearman, 6) AS spearman FROM found""",
)
def _(spark, sf):
    held = predictions(spark, sf)
    return rounded(blend.grid_search_blend(held, "p1", "p2", "y"))


@query(
    "best_blend",
    f"""WITH {sql.PREDICTIONS}, held AS (SELECT * FROM predictions), {_search_sql(['p2', 'p3'], GRID)}
        SELECT grid_id, {r6('w_p2', 'w_p3')}, round(spearman, 6) AS spearman FROM found ORDER BY spearman DESC, grid_id LIMIT 1""",
)
def _(spark, sf):
    held = predictions(spark, sf)
    return rounded(blend.best_blend(blend.grid_search_blend(held, "p2", "p3", "y", clip="soft", margin=0.4)))


@query(
    "simplex_search",
    f"""WITH {sql.PREDICTIONS}, held AS (SELECT * FROM predictions),
        {_search_sql(['p1', 'p2', 'p3'], SIMPLEX)}
        SELECT grid_id, {r6('w_p1', 'w_p2', 'w_p3')}, round(spearman, 6) AS spearman FROM found""",
)
def _(spark, sf):
    held = predictions(spark, sf)
    return rounded(blend.simplex_search(held, ["p1", "p2", "p3"], "y"))


def _percentiles_sql(cols) -> str:
    ranks = ", ".join(f"({sql.ordinal_rank(c, 'id')} - 1)::DOUBLE / (count(*) OVER () - 1) AS {c}" for c in cols)
    return f"held AS (SELECT id, y, {ranks} FROM predictions)"


@query(
    "ranked_blend_grid",
    f"""WITH {sql.PREDICTIONS}, {_percentiles_sql(['p1', 'p2'])}, {_search_sql(['p1', 'p2'], GRID)}
        SELECT grid_id, {r6('w_p1', 'w_p2')}, round(spearman, 6) AS spearman FROM found""",
)
def _(spark, sf):
    held = predictions(spark, sf)
    found = blend.grid_search_blend(held, "p1", "p2", "y", rank=True, tie_key=["id"])
    return rounded(found)


@query(
    "ranked_simplex_search",
    f"""WITH {sql.PREDICTIONS}, {_percentiles_sql(['p1', 'p2', 'p3'])},
        {_search_sql(['p1', 'p2', 'p3'], SIMPLEX)}
        SELECT grid_id, {r6('w_p1', 'w_p2', 'w_p3')}, round(spearman, 6) AS spearman FROM found""",
)
def _(spark, sf):
    held = predictions(spark, sf)
    found = blend.simplex_search(held, ["p1", "p2", "p3"], "y", rank=True, tie_key=["id"])
    return rounded(found)


@query(
    "fixed_inversion",
    f"""WITH {sql.PREDICTIONS}, i AS (SELECT id, y, p2, 1 - p1 AS q FROM predictions),
        s AS (SELECT corr(ry, rq) AS a, corr(ry, rp) AS b FROM (SELECT {sql.average_rank('y')} AS ry,
              {sql.average_rank('q')} AS rq, {sql.average_rank('p2')} AS rp FROM i))
        SELECT id, round(CASE WHEN a < 0 THEN 1 - q ELSE q END, 6) + 0.0::DOUBLE AS turned,
               round(CASE WHEN b < 0 THEN 1 - p2 ELSE p2 END, 6) + 0.0::DOUBLE AS kept FROM i, s""",
)
def _(spark, sf):
    df = predictions(spark, sf).select("id", "y", "p2", (F.lit(1.0) - F.col("p1")).alias("q"))
    df = blend.fix_inversion(blend.fix_inversion(df, "y", "q", "turned"), "y", "p2", "kept")
    return rounded(df.select("id", "turned", "kept"))


@query(
    "distinct_predictions",
    f"""WITH {sql.PREDICTIONS}, u AS (
          SELECT 'p1' AS model, count(DISTINCT p1) AS n_unique FROM predictions
          UNION ALL SELECT 'few', count(DISTINCT round(p1 * 5)) FROM predictions
          UNION ALL SELECT 'binary', count(DISTINCT p1 > 0.5) FROM predictions)
        SELECT *, CASE WHEN n_unique <= 2 THEN 'binary' WHEN n_unique < 10 THEN 'few' ELSE 'ok' END AS verdict FROM u""",
)
def _(spark, sf):
    df = predictions(spark, sf).select(
        "p1", F.round(F.col("p1") * 5).alias("few"), (F.col("p1") > 0.5).alias("binary")
    )
    return evaluate.cardinality_check(df, ["p1", "few", "binary"])


_FINAL_SQL = f"""r AS (SELECT id, y, ({sql.ordinal_rank('p1', 'id')} - 1)::DOUBLE / (count(*) OVER () - 1) AS p1,
          ({sql.ordinal_rank('p2', 'id')} - 1)::DOUBLE / (count(*) OVER () - 1) AS p2 FROM predictions),
        f AS (SELECT *, 0.5::DOUBLE + 0.5::DOUBLE * tanh((0.4::DOUBLE * p1 + 0.6::DOUBLE * p2 - 0.5::DOUBLE) / 0.2::DOUBLE)
              AS final FROM r)"""


@query("final_blend", f"WITH {sql.PREDICTIONS}, {_FINAL_SQL} SELECT id, {r6('p1', 'p2', 'final')} FROM f")
def _(spark, sf):
    df = blend.final_blend(predictions(spark, sf), "p1", "p2", ["id"])
    return rounded(df.select("id", "p1", "p2", "final"))


@query(
    "final_blend_report",
    f"WITH {sql.PREDICTIONS}, {_FINAL_SQL}, k AS (SELECT *, {sql.average_rank('y')} AS ry, "
    + ", ".join(f"{sql.average_rank(c)} AS r_{c}" for c in ("p1", "p2", "final"))
    + " FROM f) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS model, round(avg(pow(y - {c}, 2)), 6) AS mse, round(corr(ry, r_{c}), 5) AS spearman FROM k"
        for c in ("p1", "p2", "final")
    ),
)
def _(spark, sf):
    df = blend.final_blend(predictions(spark, sf), "p1", "p2", ["id"])
    return rounded(blend.blend_report(df, "y", ["p1", "p2", "final"])).withColumn("spearman", F.round("spearman", 5))


@query(
    "progress_to_goal",
    f"""WITH {sql.PREDICTIONS}, r AS (SELECT fold, {sql.average_rank('y', 'fold')} AS ry,
          {sql.average_rank('p3', 'fold')} AS rp FROM predictions),
        m AS (SELECT fold AS model, corr(ry, rp) AS s FROM r GROUP BY fold)
        SELECT model, round(s, 6) AS spearman, round(s - 0.7161::DOUBLE, 6) AS improvement,
               round((s - 0.7161::DOUBLE) / 0.7161::DOUBLE * 100, 6) AS improvement_pct,
               round((s - 0.7161::DOUBLE) / 0.0839::DOUBLE * 100, 6) AS progress_pct, s >= 0.8 AS reached FROM m""",
)
def _(spark, sf):
    found = evaluate.spearman(predictions(spark, sf), "y", "p3", ["fold"], known_groups=5)
    return rounded(blend.progress_table(found.withColumnRenamed("fold", "model")))


def _pair_sql(loss: str) -> str:
    return f"""WITH {sql.PREDICTIONS}, b AS (SELECT *, ({sql.ordinal_rank('y', 'id')} - 1) // 32 AS batch FROM predictions),
      pairs AS (SELECT i.batch, i.p2 - j.p2 AS gap, greatest((i.y - j.y) * 2.0::DOUBLE, 0.1::DOUBLE) AS margin
                FROM b i JOIN b j ON i.batch = j.batch AND i.y > j.y),
      losses AS (SELECT batch, count(*) AS n_pairs, avg({loss}
                   * least(1 + exp(-10.0::DOUBLE * (gap - 0.5::DOUBLE * margin) / margin), 5.0::DOUBLE)) AS loss
                 FROM pairs GROUP BY batch),
      plain AS (SELECT batch, count(*) AS n, avg(pow(y - p2, 2)) AS mse FROM b GROUP BY batch)
      SELECT CAST(batch AS BIGINT) AS batch, n, coalesce(n_pairs, 0) AS n_pairs, round(coalesce(loss, mse), 6) AS loss
      FROM plain LEFT JOIN losses USING (batch)"""


@query("pairwise_hinge_loss", _pair_sql("greatest(margin - gap, 0.0::DOUBLE)"))
def _(spark, sf):
    return rounded(evaluate.pairwise_rank_loss(predictions(spark, sf), "y", "p2", "y", ["id"]))


@query("pairwise_soft_loss", _pair_sql("(1 / (1 + exp(gap)))"))
def _(spark, sf):
    return rounded(evaluate.pairwise_rank_loss(predictions(spark, sf), "y", "p2", "y", ["id"], kind="soft"))


@query(
    "preference_pairs",
    f"""WITH {sql.EXAMPLES}, b AS (SELECT *, (pos - 1) // 32 AS batch FROM (
          SELECT *, row_number() OVER (ORDER BY length(response), md5('42|' || ex_id)) AS pos FROM examples)),
        n AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY score DESC, pos) - 1 AS rn FROM b)
        SELECT CAST(batch AS BIGINT) AS batch, CAST(rn // 2 AS BIGINT) AS pair,
               max(CASE WHEN rn % 2 = 0 THEN md5(prompt || response) END) AS chosen,
               max(CASE WHEN rn % 2 = 1 THEN md5(prompt || response) END) AS rejected
        FROM n GROUP BY 1, 2 HAVING count(*) = 2""",
)
def _(spark, sf):
    df = examples(spark, sf).select(
        "ex_id", "score", F.length("response").alias("size"), F.concat("prompt", "response").alias("text")
    )
    pairs = evaluate.preference_pairs(df, "score", "text", "size", ["ex_id"])
    return pairs.select("batch", "pair", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


@query(
    "reversed_pairs",
    f"""WITH {sql.EXAMPLES} SELECT md5(prompt) AS prompt, md5(response) AS chosen, md5(reverse(response)) AS rejected
        FROM examples WHERE split = 'train'""",
)
def _(spark, sf):
    df = evaluate.reversed_pairs(examples(spark, sf).where("split = 'train'"))
    return df.select(*[F.md5(c).alias(c) for c in df.columns])


@query(
    "rank_report",
    f"""WITH {sql.PREDICTIONS}, c AS (SELECT id, p1, 0.5::DOUBLE + 0.5::DOUBLE * tanh((p1 - 0.5::DOUBLE) / 0.2::DOUBLE) AS s
          FROM predictions)
        SELECT id AS text, round(p1, 6) + 0.0::DOUBLE AS raw_score, round(s, 6) AS score,
               round({sql.average_rank('s')} / count(*) OVER () * 100, 6) AS percentile,
               round(1 / (1 + exp(-5.0::DOUBLE * ((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) - 0.5::DOUBLE))), 6)
                 AS spread_score FROM c""",
)
def _(spark, sf):
    return rounded(blend.rank_report(predictions(spark, sf), "p1", "id", k=5.0))


# ---- Sources and sinks ---------------------------------------------------------------------------


def _csv_folder(df: DataFrame, label: str, partition: str | None = None) -> str:
    """Write ``df`` as CSV with headers below the shared folder and return the path."""
    path = new_folder(df.sparkSession, label)
    writer = df.write.option("header", "true").option("escape", '"')
    (writer.partitionBy(partition) if partition else writer).csv(path)
    return path


def _packed_folder(df: DataFrame, label: str) -> str:
    """Like ``_csv_folder``, in gzip files, which are not read in splits, of a length that one task reads several of."""
    path = new_folder(df.sparkSession, label)
    writer = df.write.option("header", "true").option("escape", '"').option("compression", "gzip")
    writer.option("maxRecordsPerFile", FEED_ROWS).csv(path)
    return path


@query(
    "ragged_csv_documents",
    "SELECT doc_id, md5(text) AS text, lang, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM documents",
)
def _(spark, sf):
    # Two headers, texts with line breaks, commas and quotes.
    docs = read(spark, sf, "documents").withColumn("doc_id", F.col("doc_id").cast("string"))
    wide = _csv_folder(docs.where("doc_id % 2 = 0").select("doc_id", "lang", "text", "source"), "csv")
    slim = _csv_folder(docs.where("doc_id % 2 = 1").select("text", "doc_id", "lang"), "csv")
    back = read_ragged_csv(spark, [wide, slim])
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text"), "lang", "source")


@query("csv_load_totals", "SELECT 5 AS n_files, 5 AS loaded, 0 AS empty, 0 AS error, count(*) AS rows FROM events")
def _(spark, sf):
    events = read(spark, sf, "events").select("event_id", "event_type", F.col("value").cast("string").alias("value"))
    path = _csv_folder(events.repartition("event_type"), "csv", "event_type")
    report = file_load_report(spark, path, read_ragged_csv(spark, path))
    # Spark may split a partition folder over several files, so folders are what is counted.
    folders = report.groupBy(F.regexp_extract("file", "event_type=([a-z]+)", 1)).agg(
        F.max("status").alias("status"), F.sum("rows").alias("rows")
    )
    return load_totals(folders.withColumn("bytes", F.lit(1)))


@query(
    "csv_provenance",
    """SELECT 'feed' AS source, 'feed_event_type=' || event_type AS folder,
              CASE WHEN event_type = 'click' THEN 'click' WHEN event_type = 'error' THEN 'error' END AS category,
              count(*) AS n FROM events GROUP BY event_type""",
)
def _(spark, sf):
    events = read(spark, sf, "events").select("event_id", "event_type", "value")
    path = _csv_folder(events, "csv", "event_type")
    df = with_path_category(with_provenance(read_ragged_csv(spark, path), "feed", path), ("click", "error"))
    folder = F.regexp_extract("data_source", "^([^/]*)/", 1)
    return df.groupBy("source", folder.alias("folder"), "category").agg(F.count("*").alias("n"))


def _raw_lines(rows: DataFrame, header: str, line, label: str, encoding: str = "UTF-8") -> str:
    """Lines as they are, below a header that no writer checks: one file per event type at least."""
    path = new_folder(rows.sparkSession, label)
    lines = rows.select(line.alias(header), "event_type").repartition("event_type")
    writer = lines.write.option("header", "true").option("sep", "\x01").option("quote", "").option("encoding", encoding)
    writer.option("ignoreTrailingWhiteSpace", "false").partitionBy("event_type").csv(path)
    return path


@query(
    "ragged_rows",
    """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 4 <> 1 THEN 'n' || user_id END AS name, CASE WHEN event_id % 4 = 0 THEN 'a, "b"' END AS note
       FROM events WHERE event_id % 4 <> 2""",
)
def _(spark, sf):
    # Whole rows with quoted commas and doubled quotes, rows that are too short, too long, and with a trailing comma.
    part = F.col("event_id") % 4
    start = F.concat(F.col("event_id"), F.when(part != 1, F.concat(F.lit(",n"), "user_id")).otherwise(""))
    end = F.when(part == 0, ',"a, ""b"""').when(part == 1, "").when(part == 2, ",x,surplus").otherwise(",,")
    path = _raw_lines(read(spark, sf, "events"), "id,name,note", F.concat(start, end), "ragged")
    return read_ragged_csv(spark, path, keep_file=False).select("id", "name", "note")


@query(
    "latin1_feed",
    """SELECT CAST(event_id AS VARCHAR) AS id, event_type || ' à côté, ' || user_id || ' grüßt' AS note FROM events WHERE event_type <> 'error'
       UNION ALL SELECT CAST(event_id AS VARCHAR), 'żółw ' || user_id FROM events WHERE event_type = 'error'""",
)
def _(spark, sf):
    # Files of two encodings in one feed, told apart by their bytes.
    events, failed = read(spark, sf, "events"), F.col("event_type") == "error"
    note = F.concat(F.lit('"'), F.col("event_type"), F.lit(" à côté, "), F.col("user_id"), F.lit(' grüßt"'))
    old = _raw_lines(events.where(~failed), "id,note", F.concat("event_id", F.lit(","), note), "latin1", "ISO-8859-1")
    new = _raw_lines(events.where(failed), "id,note", F.concat("event_id", F.lit(",żółw "), "user_id"), "utf8")
    return read_ragged_csv(spark, [old, new], keep_file=False).select("id", "note")


@query(
    "unquoted_feed",
    r"""SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id = min(event_id) OVER (PARTITION BY event_type) THEN '"5 ' ELSE 'in ' END
       || 'a, b\c ' || user_id AS note FROM events""",
)
def _(spark, sf):
    # One quote that never closes in each file, so quoting is off and a backslash takes the meaning from what follows.
    events = read(spark, sf, "events")
    first = events.groupBy("event_type").agg(F.min("event_id").alias("first"))
    marked = events.join(F.broadcast(first), "event_type")
    size = F.when(F.col("event_id") == F.col("first"), F.lit('"5 ')).otherwise("in ")
    line = F.concat(F.col("event_id"), F.lit(","), size, F.lit("a\\, b\\\\c "), F.col("user_id"))
    return read_ragged_csv(spark, _raw_lines(marked, "id,note", line, "unquoted"), keep_file=False).select("id", "note")


@query("csv_rows_capped_per_file", "SELECT event_type, least(count(*), 500) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    events = read(spark, sf, "events").select("event_id", "event_type", "value").repartition(1, "event_type")
    path = _csv_folder(events, "csv", "event_type")
    df = read_ragged_csv(spark, path, max_rows_per_file=500)
    return df.groupBy(F.regexp_extract("_file", "event_type=([a-z]+)", 1).alias("event_type")).agg(
        F.count("*").alias("n")
    )


@query(
    "trending_responses",
    """SELECT 'v' || event_id AS "videoId", event_type AS title, epoch_us(date_trunc('second', ts)) // 1000000 AS published,
              'US' AS region, CAST(floor(value) AS BIGINT) AS "viewCount",
              CASE WHEN event_id % 2 = 0 THEN user_id ELSE 0 END AS "likeCount", 0 AS "commentCount",
              CAST(NULL AS BIGINT) AS "rank", 'api_US_2024-02-01' AS data_source FROM events""",
)
def _(spark, sf):
    statistics = F.concat(
        F.lit('{"viewCount":"'), F.floor("value").cast("string"), F.lit('"'),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"likeCount":"'), F.col("user_id").cast("string"), F.lit('"')))
        .otherwise(""), F.lit("}"),
    )
    item = F.concat(
        F.lit('{"id":"v'), F.col("event_id").cast("string"), F.lit('","snippet":{"title":"'), "event_type",
        F.lit('","description":"","publishedAt":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit('"},"statistics":'), statistics, F.lit("}"),
    )
    # Fifty items to a response, as the service pages them.
    pages = (
        read(spark, sf, "events")
        .select(F.floor(F.col("event_id") / 50).alias("page"), item.alias("item"))
        .groupBy("page")
        .agg(F.concat(F.lit('{"items":['), F.concat_ws(",", F.collect_list("item")), F.lit("]}")).alias("body"))
    )
    df = parse_trending_json(pages, "body", F.lit("US"), F.lit("2024-02-01"))
    return df.select(
        "videoId", "title", F.unix_seconds("publishedAt").alias("published"), "region", "viewCount", "likeCount",
        "commentCount", "rank", "data_source",
    )


@query(
    "appended_table",
    """SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS data_source FROM customer
       UNION ALL SELECT s_suppkey, s_name, 'suppliers' FROM supplier""",
)
def _(spark, sf):
    # The second frame has its columns in another order, one the table lacks, and one that widens it.
    path = new_folder(spark, "table")
    first = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    second = read(spark, sf, "supplier").select(
        F.lit("suppliers").alias("data_source"), F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"),
    )
    append_aligned(first, path)
    append_aligned(second, path)
    return read_table(spark, path)


_BUILT = f"""{sql.SNAPSHOTS}, fed AS (
  SELECT * REPLACE (
      concat(coalesce("videoId", ''), '|', coalesce(CAST("trendingDate" AS VARCHAR), ''), '|', coalesce(region, '')) AS snapshot_key,
      CASE WHEN source <> 'src_R' AND "viewCount" % 7 = 0 AND "viewCount" >= 1000 THEN NULL ELSE "viewCount" END AS "viewCount",
      CASE WHEN source <> 'src_R' THEN "rank" END AS "rank",
      CASE source WHEN 'src_A' THEN 'daily' WHEN 'src_N' THEN 'many' ELSE 'api' END AS source)
  FROM snapshots WHERE region IS NULL OR region IN ({sql.KEEP_LIST})
), cleaned AS (
  SELECT * REPLACE (coalesce("viewCount", 0) AS "viewCount", coalesce("rank", 0) AS "rank") FROM fed
  QUALIFY row_number() OVER (PARTITION BY snapshot_key ORDER BY "viewCount" DESC NULLS LAST, "likeCount" DESC NULLS LAST,
    "commentCount" DESC NULLS LAST, "rank" DESC NULLS LAST, "publishedAt" DESC NULLS LAST, title DESC NULLS LAST, source DESC) = 1
), {sql.score_parts('cleaned', '"rank"')}"""


def _landed(spark: SparkSession, sf: str) -> tuple[dict[str, str], DataFrame]:
    """Two folders of raw CSV feeds, and the rest of the snapshots as parsed responses of a service."""
    rows = snapshots(spark, sf)
    roots = {
        tag: _packed_folder(_raw_feed(rows.where(F.col("source") == name)).drop("snapshot_key"), tag)
        for tag, name in (("daily", "src_A"), ("many", "src_N"))
    }
    item = F.struct(
        F.col("videoId").alias("id"),
        F.struct("title", F.date_format("publishedAt", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt")).alias("snippet"),
        F.struct(*[F.col(c).cast("string").alias(c) for c in ("viewCount", "likeCount", "commentCount")]).alias("statistics"),
    )
    # A page of answers holds what falls into one of 64 parts of a region's day.
    page = F.pmod(F.xxhash64("snapshot_key"), F.lit(64)).alias("page")
    answers = rows.where("source = 'src_R'").groupBy("region", "trendingDate", page).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("body"))
    return roots, parse_trending_json(answers, "body", F.col("region"), F.col("trendingDate"))


@query(
    "built_warehouse",
    f"""WITH {_BUILT} SELECT "videoId", strftime("trendingDate", '%Y-%m-%d') AS trending, region, source, title, "viewCount", "likeCount",
        "rank", '1.0.0' AS feature_version, {r6(*METRICS, 'viral_score')} FROM scored""",
)
def _(spark, sf):
    # From raw files and responses to the scored table, in one step.
    roots, answers = _landed(spark, sf)
    path = new_folder(spark, "warehouse")
    build_warehouse(spark, roots, path, now(), [answers], keep_regions=KEEP)
    return rounded(read_table(spark, path).select(
        "videoId", F.date_format("trendingDate", "yyyy-MM-dd").alias("trending"), "region", "source", "title", "viewCount",
        "likeCount", "rank", "feature_version", *METRICS, "viral_score",
    ))


@query(
    "built_warehouse_report",
    f"""WITH {_BUILT} SELECT source, count(*) AS n_rows, count("publishedAt") AS "with_publishedAt", count("trendingDate") AS "with_trendingDate"
        FROM cleaned GROUP BY source""",
)
def _(spark, sf):
    roots, answers = _landed(spark, sf)
    return build_warehouse(spark, roots, new_folder(spark, "warehouse"), now(), [answers], keep_regions=KEEP)


@query(
    "evolved_schema",
    "SELECT o_orderkey, o_orderstatus, CAST(NULL AS VARCHAR) AS data_source FROM orders",
)
def _(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return evolve_schema(df, T.StructType([T.StructField("data_source", T.StringType())]))


@query(
    "training_rows",
    f"""WITH {sql.SNAPSHOTS},{sql.TEXTS}, good AS (SELECT * FROM texts WHERE title IS NOT NULL AND description IS NOT NULL
          AND "publishedAt" IS NOT NULL AND "viewCount" >= 20000)
        SELECT snapshot_key, "videoId", title, md5(description) AS description, "viewCount", "likeCount", "rank", region
        FROM good ORDER BY md5('42|' || snapshot_key) LIMIT 5000""",
)
def _(spark, sf):
    df = load_training_rows(snapshots(spark, sf, texts=True), 20000, 5000, ["snapshot_key"])
    return df.select(
        "snapshot_key", "videoId", "title", F.md5("description").alias("description"), "viewCount", "likeCount",
        "rank", "region",
    )


@query(
    "training_row_ranges",
    f"""WITH {sql.SNAPSHOTS} SELECT count(*) AS n_rows, epoch_us(min("publishedAt")) // 1000000 AS first_date,
        epoch_us(max("publishedAt")) // 1000000 AS last_date, min("viewCount") AS min_views, max("viewCount") AS max_views
        FROM snapshots""",
)
def _(spark, sf):
    df = load_summary(snapshots(spark, sf))
    return df.withColumns({c: F.unix_seconds(c) for c in ("first_date", "last_date")})


@query(
    "written_splits",
    f"""WITH {sql.SCORED}, s AS (SELECT snapshot_key, viral_score, row_number() OVER (ORDER BY md5('42|' || snapshot_key))
          <= ceil(count(*) OVER () * 0.1::DOUBLE) AS t FROM scored)
        SELECT CASE WHEN t THEN 'test' ELSE 'train' END AS split, count(*) AS n, round(sum(viral_score), 3) AS total
        FROM s GROUP BY 1""",
)
def _(spark, sf):
    path = new_folder(spark, "splits")
    labelled = sampling.train_test_split(scored(spark, sf), 0.1, ["snapshot_key"])
    write_splits(labelled.select("snapshot_key", "viral_score", "split"), path)
    return spark.read.parquet(path).groupBy("split").agg(
        F.count("*").alias("n"), F.round(F.sum("viral_score"), 3).alias("total")
    )


@query(
    "exported_sample",
    f"""WITH {sql.SCORED} SELECT "videoId", title, "viewCount", "likeCount", "commentCount" FROM scored
        ORDER BY md5('42|' || snapshot_key) LIMIT 1000""",
)
def _(spark, sf):
    path = new_folder(spark, "sample")
    export_sample(scored(spark, sf), path, 1000, ["snapshot_key"])
    back = read_ragged_csv(spark, path)
    counts = {c: F.col(c).cast("bigint") for c in ("viewCount", "likeCount", "commentCount")}
    return back.withColumns(counts).select("videoId", "title", *counts)


@query(
    "written_predictions",
    f"WITH {sql.PREDICTIONS}, {_FINAL_SQL} SELECT id, {r6('p1', 'p2', 'final')}, 3 AS n_models FROM f",
)
def _(spark, sf):
    path = new_folder(spark, "results")
    df = blend.final_blend(predictions(spark, sf), "p1", "p2", ["id"])
    models = ["p1", "p2", "final"]
    weights = spark.createDataFrame([("p1", 0.4), ("p2", 0.6)], "model string, weight double")
    write_predictions(df.select("id", "y", *models), blend.blend_report(df, "y", models), weights, path)
    n = spark.read.parquet(f"{path}/metrics").agg(F.count("*").cast("int").alias("n")).scalar()
    return rounded(spark.read.parquet(f"{path}/predictions").select("id", *models)).withColumn("n_models", n)


# ---- Whole preparation runs ----------------------------------------------------------------------


@query(
    "prepared_examples",
    f"""WITH {sql.SNAPSHOTS},{sql.TEXTS}, u AS (SELECT min(snapshot_key) AS k, title, description FROM texts
          WHERE title IS NOT NULL AND description IS NOT NULL GROUP BY title, description)
        SELECT k AS snapshot_key, title, CASE WHEN row_number() OVER (ORDER BY md5('42|' || k))
          <= ceil(count(*) OVER () * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM u""",
)
def _(spark, sf):
    done = training.prepare_sft(snapshots(spark, sf), "snapshot_key", descriptions=descriptions(spark, sf))
    return done.select("snapshot_key", "title", "split")


@query(
    "prepared_regression_set",
    f"""WITH {sql.SCORED}, b AS (SELECT snapshot_key, title, text AS description,
          {_bin_sql(BALANCE_EDGES, 'left', 'viral_score')} AS bin
          FROM scored JOIN documents ON doc_ref = doc_id WHERE title IS NOT NULL),
        c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY md5('42|' || snapshot_key)) AS rn
              FROM b WHERE bin IS NOT NULL) WHERE rn <= 3000),
        u AS (SELECT min(snapshot_key) AS k FROM c GROUP BY title, description)
        SELECT k AS snapshot_key, CASE WHEN row_number() OVER (ORDER BY md5('42|' || k))
          <= ceil(count(*) OVER () * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM u""",
)
def _(spark, sf):
    df = with_texts(spark, sf, scored(spark, sf))
    return training.prepare_regression(df, "snapshot_key", per_bucket=3000).select("snapshot_key", "split")


@query(
    "regression_examples",
    f"""WITH {sql.SCORED}, e AS (SELECT coalesce(title, '') AS text, viral_score FROM scored),
        l AS (SELECT text, viral_score, regexp_split_to_array(lower(text), '[^\\p{{L}}]+') AS w FROM e)
        SELECT text, round(viral_score, 6) AS labels, {_LANG_CASE} AS language FROM l""",
)
def _(spark, sf):
    return rounded(training.regression_examples(scored(spark, sf), "title", with_language=True))


# ---- Embeddings and the meta-model ---------------------------------------------------------------


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of seven documents in ten, under the key of their text."""
    vectors = read(spark, sf, "embeddings").select("vec_id", "embedding")
    docs = read(spark, sf, "documents").select("doc_id", texts.text_key(F.col("text")).alias("text_key"))
    joined = docs.join(vectors, F.col("doc_id") == F.col("vec_id")).where(uniform("doc_id", "cache") < 0.7)
    return dedup.dedup_text(joined, ["text_key"], "doc_id").select("text_key", "embedding")


_KEY_SQL = "trim(replace(text, chr(10), ' '), chr(9) || chr(13) || ' ')"
_CACHE_SQL = f"""docs AS (SELECT doc_id, {_KEY_SQL} AS text_key FROM documents),
      cache AS (SELECT text_key, arg_min(embedding, doc_id) AS embedding FROM docs JOIN embeddings ON doc_id = vec_id
                WHERE {sql.unit('doc_id', 'cache')} < 0.7 GROUP BY text_key)"""


@query("missing_embeddings", f"WITH {_CACHE_SQL} SELECT DISTINCT md5(text_key) AS text_key FROM docs WHERE text_key NOT IN (SELECT text_key FROM cache)")
def _(spark, sf):
    missing = embeddings.missing_keys(read(spark, sf, "documents"), _cache(spark, sf))
    return missing.select(F.md5("text_key").alias("text_key"))


@query(
    "attached_embeddings",
    f"""WITH {_CACHE_SQL} SELECT doc_id, 64 AS size,
        round(CASE WHEN embedding IS NULL THEN 0.0 ELSE list_avg(embedding::DOUBLE[]) END, 6) + 0.0::DOUBLE AS mean,
        round(CASE WHEN embedding IS NULL THEN 0.0 ELSE list_stddev_pop(embedding::DOUBLE[]) END, 6) + 0.0::DOUBLE AS std
        FROM docs LEFT JOIN cache USING (text_key)""",
)
def _(spark, sf):
    df = embeddings.attach_embeddings(read(spark, sf, "documents"), _cache(spark, sf), 64)
    stats = embeddings.vector_stats(df, "embedding")
    return rounded(
        stats.select(
            "doc_id", F.size("embedding").alias("size"), F.col("embedding_mean").alias("mean"),
            F.col("embedding_std").alias("std"),
        )
    )


@query(
    "upserted_cache",
    f"""WITH {_CACHE_SQL}, fresh AS (SELECT text_key, arg_min(embedding, doc_id) AS embedding
          FROM docs JOIN embeddings ON doc_id + 1 = vec_id GROUP BY text_key),
        merged AS (SELECT text_key, embedding FROM fresh
                   UNION ALL SELECT text_key, embedding FROM cache WHERE text_key NOT IN (SELECT text_key FROM fresh))
        SELECT md5(text_key) AS text_key, md5(array_to_string(
          list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000000) AS BIGINT)), ',')) AS vector FROM merged""",
)
def _(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", texts.text_key(F.col("text")).alias("text_key"))
    vectors = read(spark, sf, "embeddings").select("vec_id", "embedding")
    fresh = docs.join(vectors, F.col("doc_id") + 1 == F.col("vec_id"))
    fresh = dedup.dedup_text(fresh, ["text_key"], "doc_id").select("text_key", "embedding")
    merged = embeddings.upsert_cache(_cache(spark, sf), fresh)
    entries = F.transform("embedding", lambda x: F.round(x.cast("double") * 1_000_000).cast("bigint").cast("string"))
    return merged.select(F.md5("text_key").alias("text_key"), F.md5(F.array_join(entries, ",")).alias("vector"))


@query(
    "scaled_embeddings",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
       z AS (SELECT vec_id, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i) AS z FROM e)
       SELECT vec_id, round(sum(z), 5) + 0.0::DOUBLE AS total, round(max(z), 5) AS highest FROM z GROUP BY vec_id""",
)
def _(spark, sf):
    df = embeddings.scale_vectors(read(spark, sf, "embeddings"), "embedding", 64, "z")
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + x)
    return rounded(df.select("vec_id", total.alias("total"), F.array_max("z").alias("highest")), 5)


def _vector_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the vectors with two noisy predictions and a fold."""
    y = F.col("label") / F.lit(9.0)
    return read(spark, sf, "embeddings").select(
        "vec_id", "embedding", y.alias("y"),
        (y + uniform("vec_id", "p1") * 0.4 - 0.2).alias("p1"),
        (y + uniform("vec_id", "p2") * 0.8 - 0.4).alias("p2"),
        F.floor(uniform("vec_id", "fold") * 5).cast("int").alias("fold"),
    )


_FEATURES = ["p1", "p2", *(f"e{i}" for i in range(64))]


@query(
    "feature_f_scores",
    f"""WITH v AS (SELECT label / 9.0::DOUBLE AS y, label / 9.0::DOUBLE + {sql.unit('vec_id', 'p1')} * 0.4 - 0.2 AS p1,
          label / 9.0::DOUBLE + {sql.unit('vec_id', 'p2')} * 0.8 - 0.4 AS p2, embedding AS e FROM embeddings),
        r AS (SELECT count(*) AS n, corr(p1, y) AS p1, corr(p2, y) AS p2, """
    + ", ".join(f"corr(e[{i + 1}]::DOUBLE, y) AS e{i}" for i in range(64))
    + " FROM v) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round({c} * {c} / (1 - {c} * {c}) * (n - 2), 6) AS f_score FROM r" for c in _FEATURES
    ),
)
def _(spark, sf):
    df = _vector_examples(spark, sf)
    df = df.withColumns({f"e{i}": F.get("embedding", F.lit(i)).cast("double") for i in range(64)})
    return rounded(meta.f_scores(df, _FEATURES, "y"))


_RIDGE_SQL = f"""WITH v AS (SELECT vec_id, label / 9.0::DOUBLE AS y, label / 9.0::DOUBLE + {sql.unit('vec_id', 'p1')} * 0.4 - 0.2 AS p1,
          label / 9.0::DOUBLE + {sql.unit('vec_id', 'p2')} * 0.8 - 0.4 AS p2 FROM embeddings),
        s AS (SELECT avg(y) AS my, stddev_pop(y) AS sy, avg(p1) AS m1, avg(p2) AS m2, count(*) * var_pop(p1) + 10 AS a,
          count(*) * covar_pop(p1, p2) AS b, count(*) * var_pop(p2) + 10 AS c,
          count(*) * covar_pop(p1, y) / stddev_pop(y) AS d, count(*) * covar_pop(p2, y) / stddev_pop(y) AS e FROM v)
        SELECT vec_id, round(0.5::DOUBLE + 0.5::DOUBLE * tanh((((c * d - b * e) * (p1 - m1) + (a * e - b * d) * (p2 - m2))
          / (a * c - b * b) * sy + my - 0.5::DOUBLE) / 0.2::DOUBLE), 6) AS prediction FROM v, s"""


@query("ridge_predictions", _RIDGE_SQL)
def _(spark, sf):
    df = _vector_examples(spark, sf)
    fitted = meta.fit_meta_model(df, "y", ["p1", "p2"], "fold", models={"Ridge": meta.Ridge()})
    path = new_folder(spark, "ridge")
    fitted.save(path)
    return rounded(meta.MetaModel.load(path, ["p1", "p2"]).predict(df).select("vec_id", "prediction"))


@query(
    "principal_component_norms",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
       z AS (SELECT vec_id, (x - avg(x) OVER (PARTITION BY i)) / stddev_samp(x) OVER (PARTITION BY i) AS z FROM e)
       SELECT vec_id, round(sum(z * z), 4) AS square_norm FROM z GROUP BY vec_id""",
)
def _(spark, sf):
    # All components together turn a scaled vector without changing its length.
    df, _ = meta.meta_inputs(read(spark, sf, "embeddings"), [], "embedding")
    steps = meta.feature_stages([], 64, df.count(), components=64)[:2]
    turned = Pipeline(stages=steps).fit(df).transform(df).withColumn("_pca", vector_to_array("_pca"))
    square = F.aggregate("_pca", F.lit(0.0), lambda acc, x: acc + x * x)
    return rounded(turned.select("vec_id", square.alias("square_norm")), 4)


@query(
    "truncated_svd_energy",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings),
       per AS (SELECT vec_id, sum(x * x) AS square FROM e GROUP BY vec_id)
       SELECT vec_id, round(square, 4) AS square_norm, round((SELECT sum(square) FROM per), 2) AS energy FROM per""",
)
def _(spark, sf):
    # With as many directions as the vectors are long, the singular values hold all their energy and the directions all lengths.
    df, _ = meta.meta_inputs(read(spark, sf, "embeddings"), [], "embedding")
    found = truncated_svd(df, "embedding", 64)
    turned = Components(64, "_emb", "_svd", "svd").fit(df).transform(df).withColumn("_svd", vector_to_array("_svd"))
    square = F.aggregate("_svd", F.lit(0.0), lambda acc, x: acc + x * x)
    shown = rounded(turned.select("vec_id", square.alias("square_norm")), 4)
    return shown.withColumn("energy", F.lit(round(float((found.values ** 2).sum()), 2)))


@query("meta_model_scores")
def _(spark, sf):
    df = _vector_examples(spark, sf)
    fitted = meta.fit_meta_model(df, "y", ["p1", "p2"], "fold", "embedding", 64)
    rows = [(name, mean, std, name == fitted.chosen) for name, (mean, std) in fitted.scores.items()]
    return spark.createDataFrame(rows, "model string, spearman double, deviation double, chosen boolean")


@query("meta_model_predictions")
def _(spark, sf):
    df = _vector_examples(spark, sf)
    fitted = meta.fit_meta_model(df, "y", ["p1", "p2"], "fold", "embedding", 64, models={"Ridge": meta.Ridge()})
    path = new_folder(spark, "meta")
    fitted.save(path)
    again = meta.MetaModel.load(path, ["p1", "p2"], "embedding")
    return again.predict(df).select("vec_id", "y", "prediction")


# ---- Streams -------------------------------------------------------------------------------------


@query(
    "ingested_events",
    "SELECT DISTINCT user_id, event_type, CAST(date_trunc('day', ts) AS DATE) AS day FROM events WHERE event_type <> 'error'",
)
def _(spark, sf):
    schema = read(spark, sf, "events").schema
    rows = file_stream(spark, sf, schema, pattern="events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.to_date("ts").alias("day")
    )
    sink = new_folder(spark, "sink")
    ingest_stream(
        rows, sink, new_folder(spark, "progress"), ["user_id", "event_type", "day"], "ts", "31 days",
        keep=lambda df: df.where("event_type <> 'error'"),
    )
    return spark.read.parquet(sink).select("user_id", "event_type", "day")


@query(
    "ingested_in_two_runs",
    "SELECT DISTINCT user_id, event_type, CAST(date_trunc('day', ts) AS DATE) AS day FROM events WHERE event_type <> 'error'",
)
def _(spark, sf):
    events = read(spark, sf, "events")
    landing, sink, progress = (new_folder(spark, label) for label in ("landing", "sink", "progress"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    early = events.where(F.col("ts") < F.lit(first + (last - first) / 2))
    # The second run meets the early rows again, late and in other files.
    for landed in (early, events):
        landed.withColumn("_day", F.to_date("ts")).repartition("_day").drop("_day").write.mode("append").parquet(landing)
        rows = file_stream(spark, landing, events.schema, files_per_trigger=2).select(
            F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.to_date("ts").alias("day")
        )
        delay = f"{(last - first).days + 1} days"
        ingest_stream(
            rows, sink, progress, ["user_id", "event_type", "day"], "ts", delay,
            keep=lambda df: df.where("event_type <> 'error'"),
        )
    return spark.read.parquet(sink).select("user_id", "event_type", "day")


@query(
    "streamed_coverage",
    """SELECT epoch_us(date_trunc('day', ts)) // 1000000 AS day, event_type, count(*) AS total, count(value) AS with_value,
        count(*) FILTER (value >= 5) AS ge_5, count(*) FILTER (value >= 50) AS ge_50 FROM events
        WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) GROUP BY 1, 2""",
)
def _(spark, sf):
    schema = read(spark, sf, "events").schema
    rows = file_stream(spark, sf, schema, pattern="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    sink = new_folder(spark, "sink")
    run_to_table(
        coverage_stream(rows, "ts", "event_type", "value", (5, 50), delay="0 seconds"), sink,
        new_folder(spark, "progress"),
    )
    df = spark.read.parquet(sink)
    return df.select(F.unix_seconds("window_start").alias("day"), "event_type", "total", "with_value", "ge_5", "ge_50")


# Raw names of the landed snapshots, each an alias of a canonical column; dates and counts as text.
LANDED = {
    "videoId": "video_id", "title": "title", "publishedAt": "publish_time", "trendingDate": "snapshot_date", "region": "country",
    "viewCount": "view_count", "likeCount": "like_count", "commentCount": "commentCount", "rank": "daily_rank",
    "source": "source", "data_source": "data_source",
}
SNAPSHOT_ORDER = ("publishedAt", "viewCount", "likeCount", "commentCount", "rank", "source", "data_source", "title")
SNAPSHOT_SHOWN = ("videoId", "region", "viewCount", "likeCount", "commentCount", "rank", "source", "title")


@query(
    "compacted_ingest",
    f"""WITH {sql.SNAPSHOTS}
        SELECT {", ".join(f'"{c}"' for c in SNAPSHOT_SHOWN)}, epoch_us("trendingDate") AS trending FROM (
            SELECT *, row_number() OVER (PARTITION BY "videoId", "trendingDate", region
                ORDER BY {", ".join(f'"{c}" DESC NULLS LAST' for c in SNAPSHOT_ORDER)}) AS rn
            FROM snapshots WHERE "viewCount" >= 100) WHERE rn = 1""",
)
def _(spark, sf):
    base = snapshots(spark, sf)
    raw = base.select(*[F.col(c).cast("string").alias(name) for c, name in LANDED.items()], F.col("snapshot_key"))
    landing, table, progress = (new_folder(spark, label) for label in ("landing", "table", "progress"))
    keys = ["videoId", "trendingDate", "region"]
    half = uniform("snapshot_key", "landed") < 0.5
    # Two landings, each in several micro-batches; the second brings a part of the first again, later than what it holds.
    for landed in (raw.where(half), raw.where(~half | (uniform("snapshot_key", "again") < 0.3))):
        # Row groups of 16 MB: a micro-batch of three files is then read by more than three tasks.
        landed.drop("snapshot_key").write.mode("append").option("parquet.block.size", 16 << 20).parquet(landing)
        stream = snapshot_stream(file_stream(spark, landing, raw.drop("snapshot_key").schema, files_per_trigger=3))
        ingest_keep_last(stream, table, progress, keys, SNAPSHOT_ORDER, keep=lambda df: df.where("viewCount >= 100"))
        compact(spark, table, keys, SNAPSHOT_ORDER, F.date_format("trendingDate", "yyyy-MM"))
    rows = latest(spark, table, keys, SNAPSHOT_ORDER)
    return rows.select(*SNAPSHOT_SHOWN, F.unix_micros("trendingDate").alias("trending"))


@query(
    "streamed_coverage_with_late_rows",
    """SELECT epoch_us(date_trunc('day', ts)) // 1000000 AS day, event_type, count(*) AS total, count(value) AS with_value,
        count(*) FILTER (value >= 5) AS ge_5, count(*) FILTER (value >= 50) AS ge_50 FROM events GROUP BY 1, 2""",
)
def _(spark, sf):
    events = read(spark, sf, "events").withColumns({"day": F.to_date("ts"), "slow": uniform("event_id", "slow") < 0.1})
    first, last = events.agg(F.min("day"), F.max("day")).first()
    third = (last - first).days // 3 + 1
    held = F.floor(F.date_diff("day", F.lit(first)) / third) + F.when(F.col("slow"), 1).otherwise(0)
    landing, table, progress = (new_folder(spark, label) for label in ("landing", "table", "progress"))
    schema = read(spark, sf, "events").schema
    # A file a day, in three landings; a tenth of the rows comes one landing late, which the watermark still allows. The last
    # landing repeats the first days, by then too late to count.
    too_late = events.where(F.col("day") < F.date_add(F.lit(last), -(2 * third + 3)))
    for landed in (*[events.where(held == k) for k in range(3)], events.where(held >= 3), too_late):
        landed.repartition("day").drop("day", "slow").write.mode("append").parquet(landing)
        rows = file_stream(spark, landing, schema, files_per_trigger=4).withColumn("ts", F.col("ts").cast("timestamp"))
        ingest_changes(coverage_stream(rows, "ts", "event_type", "value", (5, 50), delay=f"{2 * third + 1} days"), table, progress)
    done = latest(spark, table, ["window_start", "event_type"], [BATCH])
    return done.select(F.unix_seconds("window_start").alias("day"), "event_type", "total", "with_value", "ge_5", "ge_50")
