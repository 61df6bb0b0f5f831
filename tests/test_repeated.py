"""Rows that a join makes many of."""

from collections import Counter

from pyspark.sql import functions as F

from metaloom.operators import containment
from metaloom.plans import catalog


def test_rows_come_as_often_as_told(spark, monkeypatch):
    monkeypatch.setattr(containment, "COPIES", 10)
    times = {1: 1, 2: 0, 3: None, 4: 10, 5: 11, 6: 95}
    rows = spark.createDataFrame([(k, f"p{k}", n) for k, n in times.items()], "id long, pattern string, n long")
    found = containment.repeated(rows, "n")
    assert found.columns == ["id", "pattern"]
    assert Counter(r.id for r in found.collect()) == {k: n for k, n in times.items() if n}
    assert containment.repeated(rows.where("id = 3"), "n").collect() == []


def test_copies_of_one_row_are_dealt_to_many_tasks(spark):
    rows = spark.range(1).selectExpr("id", "'p' as pattern", "100000L as n")
    tasks = [r["count"] for r in containment.repeated(rows, "n").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 100_000 and max(tasks) <= 30_000


def test_equal_names_are_multiplied_by_many_tasks(spark, tmp_path):
    """300 parts of one name make 90,000 rows, which were the work of one task."""
    spark.range(1, 301).selectExpr("id as p_partkey", "'one name' as p_name").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 11).selectExpr("id as o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    found = catalog.QUERIES["h5_large_dictionary"](spark, str(tmp_path))
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    labels = sum(f"l{j}" in f"l{i}" for i in range(1, 301) for j in range(1, 11))
    assert sum(tasks) == 300 * 300 + labels
    assert len(tasks) > 1 and max(tasks) < sum(tasks) / 2
