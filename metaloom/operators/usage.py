"""Metering of model calls: cost, estimates, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Budgets and prices.
SESSION_LIMIT = 10_000
DAY_LIMIT = 100_000
INPUT_PRICE_PER_MILLION = 0.35
OUTPUT_PRICE_PER_MILLION = 0.62
CHARS_PER_TOKEN = 4


def call_cost(prompt: Column, completion: Column) -> Column:
    return prompt / 1_000_000 * INPUT_PRICE_PER_MILLION + completion / 1_000_000 * OUTPUT_PRICE_PER_MILLION


def estimated_tokens(tokens: Column, text: Column) -> Column:
    """Reported tokens, else one per four characters."""
    return F.coalesce(tokens, F.floor(F.length(text) / CHARS_PER_TOKEN).cast("bigint"))


def budget(calls: DataFrame, session_limit: int = SESSION_LIMIT, day_limit: int = DAY_LIMIT) -> DataFrame:
    """Token sums per (session, day) and per day with their limits, in one pass.

    ``calls(session_id, ts, total_tokens)``. A first aggregation per session and day
    runs partially in every task; the day totals add up its few rows, so a day or
    session that owns most calls is no hot key.
    """
    day = F.date_trunc("day", "ts").cast("date")
    per_session = calls.groupBy("session_id", day.alias("day")).agg(
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens")
    )
    both = per_session.groupingSets([["session_id", "day"], ["day"]], "session_id", "day").agg(
        F.sum("tokens").alias("tokens"), F.grouping("session_id").alias("_all")
    )
    limit = F.when(F.col("_all") == 1, day_limit).otherwise(session_limit)
    return both.select(
        F.when(F.col("_all") == 1, "day").otherwise("session").alias("level"),
        "session_id", "day", "tokens", (F.col("tokens") >= limit).alias("exceeded"),
    )


def calls_of_day(calls: DataFrame, day: str) -> DataFrame:
    """Calls of one day; the range on the raw time column reaches the scan."""
    start = F.to_date(F.lit(day))
    kind = dict(calls.dtypes)["ts"]
    return calls.where((F.col("ts") >= start.cast(kind)) & (F.col("ts") < F.date_add(start, 1).cast(kind)))


def budget_today(calls: DataFrame, day: str, **limits) -> DataFrame:
    return budget(calls_of_day(calls, day), **limits)


def active_sessions(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count_distinct("session_id").alias("active_sessions"))
