"""A part of the registered queries against their SQL on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry
from workload.check import TABLES, rows_of

from conftest import SMALL

NAMES = (
    "viral_score", "canonical_snapshots", "deduplicated_texts", "largest_sources", "metric_statistics",
    "histogram_last_bin_closed", "training_examples", "rebalanced", "weighted_resample", "blend_grid",
    "pairwise_soft_loss", "trending_responses", "upserted_cache", "streamed_coverage",
)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_entry_has_rows_and_every_oracle_a_query(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_row_rank_never_gathers_the_rows_in_one_task(spark):
    """Only the table of bucket counts may pass through a single partition."""
    from trendspark.operators.rank import add_rank

    df = spark.range(1000).selectExpr("id", "cast(id % 7 as double) as v")
    plan = add_rank(df, "v", "r")._jdf.queryExecution().executedPlan().toString()
    rows_side, _, counts_side = plan.partition("BroadcastExchange")
    assert "SinglePartition" not in rows_side and "SinglePartition" in counts_side
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
