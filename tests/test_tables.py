"""The step that builds the snapshots: what travels, and that no row is lost."""

import datetime as dt
import re

from workload import tables


def _write(spark, folder):
    day = dt.datetime(1996, 3, 5)
    rows = {
        "lineitem": ([(k % 7, k % 5, k, k % 3, 1.0 + k, 10.0 * k, 0.5, "R", "O", day) for k in range(40)],
                     "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        # Order 6 is missing, order 5 comes twice, customer 3 is unknown.
        "orders": ([(k, k % 4, day) for k in (0, 1, 2, 3, 4, 5, 5)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp"),
        "customer": ([(k, k) for k in range(3)], "c_custkey bigint, c_nationkey bigint"),
        "nation": ([(k, f"NATION_{k}") for k in range(3)], "n_nationkey bigint, n_name string"),
        "part": ([(k, f"part {k}") for k in range(4)], "p_partkey bigint, p_name string"),
        "documents": ([(k, "t") for k in range(3)], "doc_id bigint, text string"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/{name}.parquet")


def test_lines_are_shuffled_once_a_large_join_and_not_again_before_they_are_written(spark, tmp_path, monkeypatch):
    _write(spark, tmp_path)
    staged = []
    monkeypatch.setattr(tables, "stage", lambda df, label: staged.append(df) or df)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = tables.snapshots(spark, str(tmp_path))
        plan = staged[0]._jdf.queryExecution().executedPlan().toString()
        keys = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
        # Lines travel for their order and their part; the customer is found by the orders.
        assert sorted(keys) == ["c_custkey", "c_nationkey", "l_orderkey", "l_partkey", "n_nationkey", "o_custkey", "o_orderkey", "p_partkey"]
        assert plan.index("hashpartitioning(l_orderkey") < plan.index("hashpartitioning(o_custkey")
        left = [k for k in range(40) if k % 7 < 6 and k % 7 % 4 < 3 and k % 5 < 4]
        assert df.count() == sum(2 if k % 7 == 5 else 1 for k in left)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
