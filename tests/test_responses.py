"""Responses of many rows: joined and grouped in parts of bounded size, with the results that Spark's own choice gives."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstream.plans import registry
from quillstream.sources import tables

DIR = "/root/testdata/sf0.001"
READERS = ["attempt_scores", "attempts_for_note", "question_types", "quiz_attempts", "quiz_attempts_given", "response_correctness", "responses_build", "weak_topics"]


def rows(df):
    return Counter(map(str, df.collect()))


def put(df, path, name):
    df.write.parquet(f"{path}/{name}.parquet")


def test_no_table_that_grows_is_broadcast(spark, tmp_path):
    n, day = 4_400_000, F.lit("2020-01-01").cast("timestamp")
    at = F.col("id")
    put(spark.range(n).select((at % 1_000_000).alias("l_orderkey"), (at % 100_000).alias("l_partkey"), (at % 7).cast("int").alias("l_linenumber"), at.alias("l_suppkey"), F.lit("N").alias("l_returnflag"), F.lit(1.0).alias("l_extendedprice"), day.alias("l_shipdate")), tmp_path, "lineitem")
    put(spark.range(1_000_000).select(at.alias("o_orderkey"), at.alias("o_custkey"), day.alias("o_orderdate")), tmp_path, "orders")
    put(spark.range(100_000).select(at.alias("p_partkey"), F.lit("b").alias("p_brand"), (at % 10).cast("string").alias("p_type"), F.lit("q").alias("p_name"), (at % 50).cast("int").alias("p_size")), tmp_path, "part")
    found = registry.QUERIES["question_types"](spark, str(tmp_path))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    total, least, most = found.agg(F.sum("n"), F.min("n"), F.max("n")).first()
    assert (total, least, most) == (n, 4, 5)
    sizes = [r["count"] for r in tables.responses(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and max(sizes) < 1.2 * 400_000


@pytest.mark.parametrize("name", READERS)
def test_many_rows_have_the_results_of_few(spark, monkeypatch, name):
    few = rows(registry.QUERIES[name](spark, DIR))
    monkeypatch.setattr(tables, "FEW_ROWS", 0)
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    assert rows(registry.QUERIES[name](spark, DIR)) == few


def test_odd_keys(spark, tmp_path, monkeypatch):
    day = F.lit("2020-01-01").cast("timestamp")
    items = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, 3), (2, 1), (None, 1), (1, None), (9, 1), (1, 9)], "l_orderkey long, l_partkey long")
    put(items.select("*", F.lit(1).alias("l_linenumber"), F.lit(1).alias("l_suppkey"), F.lit("N").alias("l_returnflag"), F.lit(1.0).alias("l_extendedprice"), day.alias("l_shipdate")), tmp_path, "lineitem")
    put(spark.createDataFrame([(1, 1), (2, 1), (2, 2), (None, 3)], "o_orderkey long, o_custkey long").withColumn("o_orderdate", day), tmp_path, "orders")
    put(spark.createDataFrame([(1, "a"), (2, ""), (3, None), (None, "c")], "p_partkey long, p_type string").select("*", F.lit("b").alias("p_brand"), F.lit("q").alias("p_name"), F.lit(1).alias("p_size")), tmp_path, "part")
    want = {(1, "a", 2), (1, "general", 2), (2, "a", 2)}
    for few in (tables.FEW_ROWS, 0):
        monkeypatch.setattr(tables, "FEW_ROWS", few)
        assert {tuple(r) for r in registry.QUERIES["question_types"](spark, str(tmp_path)).collect()} == want
