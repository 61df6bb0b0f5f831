"""Samples, prefixes, first and best rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SAMPLE_SIZE = 20
MAX_CHARS = 30_000


def sample_hash(keys: list[str], seed: str) -> Column:
    """A repeatable pseudo-random order: digest of key and seed."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(seed)))


def uniform_sample(
    df: DataFrame, keys: list[str], by: list[str] = (), k: int = SAMPLE_SIZE, seed: str = "0"
) -> DataFrame:
    """``k`` records per dataset, uniformly: those with the smallest seeded digest.

    The per-group limit runs before the exchange as well, so each task ships at
    most ``k`` rows per dataset whatever the size of the dataset.
    """
    hashed = df.withColumn("_h", sample_hash(keys, seed))
    if not by:
        return hashed.orderBy("_h", *keys).limit(k).drop("_h")
    w = Window.partitionBy(*by).orderBy("_h", *keys)
    return hashed.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_h", "_n")


def char_budget(
    sample: DataFrame, by: list[str], order: list, text: Column, budget: int = MAX_CHARS
) -> DataFrame:
    """Rows in order until the running length would pass the budget.

    Meant for a bounded sample per dataset. Lengths are never negative, so the
    running sum tells the same cut as stopping at the first overflow.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sample.withColumn("_used", F.sum(F.length(text)).over(w))
        .where(F.col("_used") <= budget)
        .drop("_used")
    )


def first_rows(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def best_row(df: DataFrame, by: list[str], score: Column, ties: list) -> DataFrame:
    """The row of the highest score per group, first in tie order among equals."""
    return first_rows(df, by, [score.desc(), *ties], 1)


def first_distinct(df: DataFrame, by: list[str], value: str, order: str, n: int) -> DataFrame:
    """First ``n`` distinct values per group by first appearance, with their rank."""
    firsts = df.groupBy(*by, value).agg(F.min(order).alias("_first"))
    w = Window.partitionBy(*by).orderBy("_first", value)
    return firsts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("_first")


def latest_value(df: DataFrame, by: list[str], value: Column, at: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(value, at).alias("value"))


def first_non_empty(df: DataFrame, by: list[str], value: str, order: Column) -> DataFrame:
    """The first value that holds text; a plain aggregation, partial in every task."""
    filled = F.when(F.col(value).isNotNull() & (F.col(value) != ""), order)
    return df.groupBy(*by).agg(F.min_by(F.col(value), filled).alias("value"))


def order_slices(df: DataFrame, order: str, slices: int) -> list:
    """Cut points of ``order`` that split the rows into about equal slices."""
    shares = [i / slices for i in range(1, slices)]
    points = df.agg(F.percentile_approx(F.col(order), shares, 1000).alias("p")).first()["p"]
    return sorted(set(points or []))


def number_rows(df: DataFrame, by: list[str], order: str, slices: int = 64, name: str = "n") -> DataFrame:
    """Row number within each group that no single task has to compute alone.

    Rows are numbered inside (group, slice of the order column); the counts of the
    earlier slices, at most ``slices`` rows per group, give the offset. A group
    that holds a third of the table is spread over all slices. ``order`` must be
    unique within a group and orderable as a number.
    """
    points = order_slices(df, order, slices)
    cut = F.array(*[F.lit(p) for p in points]) if points else F.array().cast("array<bigint>")
    sliced = df.withColumn("_s", F.size(F.filter(cut, lambda p: p < F.col(order))))
    local = sliced.withColumn("_local", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(order)))
    counts = sliced.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_s", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    return (
        local.join(offsets, [*by, "_s"])
        .withColumn(name, F.col("_local") + F.col("_o"))
        .drop("_s", "_local", "_o")
    )


def suffix_duplicates(df: DataFrame, record: list[str], tag: str, order: str) -> DataFrame:
    """Second and later occurrences of a tag in a record get ``_1``, ``_2``, …

    The occurrences of a tag in one record are a short list, so a window numbers them.
    """
    n = df.withColumn("_k", F.row_number().over(Window.partitionBy(*record, tag).orderBy(order)))
    named = F.when(F.col("_k") == 1, F.col(tag)).otherwise(
        F.concat(F.col(tag), F.lit("_"), (F.col("_k") - 1).cast("string"))
    )
    return n.withColumn("name", named).drop("_k")
