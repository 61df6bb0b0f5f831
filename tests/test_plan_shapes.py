"""Physical plans: no cross joins, filters and columns reach the scan."""

import pytest

from metaloom import session
from metaloom.plans import catalog
from metaloom.sources import sinks

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n[0] in "ghijklv"])
def test_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_profile_reads_only_mapped_columns(spark):
    text = plan(spark, "g4_profile_lineitem")
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in text


def test_prefilled_profile_reads_one_column(spark):
    assert "ReadSchema: struct<l_quantity:double>" in plan(spark, "l7_profile_prefilled")


@pytest.mark.parametrize("name", ["o3_budget_today", "e9_day_predicate"])
def test_day_range_is_pushed_down(spark, name):
    assert "GreaterThanOrEqual(ts" in plan(spark, name)


@pytest.mark.parametrize("name", ["i1_sample20_per_dataset", "i3_first_lines", "i4_best_row"])
def test_group_limits_run_before_the_shuffle(spark, name):
    assert plan(spark, name).count("WindowGroupLimit") >= 2


def test_global_sample_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(spark, "i1_sample20")


@pytest.mark.parametrize("name", ["m1_m4_triples", "a7_unwrap", "k4_email_rule", "n3_metadata_answers"])
def test_row_local_operators_hash_nothing(spark, name):
    text = plan(spark, name)
    assert text.count("Exchange hashpartitioning") <= (1 if name == "m1_m4_triples" else 0)


def test_written_runs_meet_without_a_shuffle_of_their_fields(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, "h14_written_runs")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one shuffle of half aggregated records, none below it
    assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text


@pytest.mark.parametrize("name", ["a7_deep", "a7_repeated_header", "l4_object_then_subfield", "n4_open_answers"])
def test_heavy_rows_are_shared_out(spark, name):
    """A file of one row group is one task: its rows go to all cores before they are worked on."""
    assert "Exchange RoundRobinPartitioning" in plan(spark, name)


def test_shares_are_bounded_in_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "SHARE_ROWS", 100)
    spark.range(5_000).write.parquet(str(tmp_path / "t"))
    assert session.spread(spark.read.parquet(str(tmp_path / "t"))).rdd.getNumPartitions() == 50


def test_defaults_are_written_out_behind_the_join(spark):
    """A dataset meets its prefilled fields as one row, not as one for each default."""
    text = plan(spark, "l2_static_defaults")
    assert text.index("Generate inline(concat(") < text.index("Join")


def test_buckets_grow_with_a_run(spark, monkeypatch):
    monkeypatch.setattr(sinks, "BUCKET_ROWS", 100)
    assert [sinks.buckets_for(spark.range(n), 8) for n in (10, 1_001)] == [8, 11]


def test_a_share_is_a_few_seconds_of_work(spark, tmp_path):
    spark.range(1_000_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    assert session.spread(spark.read.parquet(str(tmp_path / "t"))).rdd.getNumPartitions() >= 20
