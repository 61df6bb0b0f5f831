"""Unions, differences and ordered de-duplication of keys, lists and fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def key_union(frames: list[DataFrame], column: str) -> DataFrame:
    """Distinct keys of several one-column tables."""
    return reduce(lambda a, b: a.union(b), [f.toDF(column) for f in frames]).distinct()


def missing_keys(expected: DataFrame, present: DataFrame, column: str) -> DataFrame:
    """Expected rows whose key is not present."""
    return expected.join(present.select(column), column, "left_anti")


def first_seen(df: DataFrame, by: list[str], order: Column, name: str = "first") -> DataFrame:
    """Distinct values with the place of their first appearance."""
    return df.groupBy(*by).agg(F.min(order).alias(name))


def ordered_union(frames: list[DataFrame], column: str) -> DataFrame:
    """Values of several lists, each once, with the number of the first list that has it."""
    tagged = [f.toDF(column).withColumn("_o", F.lit(i + 1)) for i, f in enumerate(frames)]
    return first_seen(reduce(lambda a, b: a.unionByName(b), tagged), [column], F.col("_o"))


def distinct_items(items: Column) -> Column:
    """Items of a list in order of first appearance."""
    return F.array_distinct(items)


def without_items(items: Column, dropped: list[str]) -> Column:
    return F.array_except(items, F.array(*[F.lit(d) for d in dropped]))


def sorted_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows in order of their columns."""
    return df.select(*columns).distinct().orderBy(*columns)


def page_uris(urls: DataFrame, column: str) -> DataFrame:
    """Distinct addresses without query and fragment, in order."""
    return urls.select(F.regexp_extract(column, r"^[^?#]*", 0).alias("uri")).distinct().orderBy("uri")
