"""Structured Streaming operators.

The state of every operator is bounded per dataset: aggregates, a sample of fixed
size, or the current value of each field. All queries take a checkpoint folder, so
a lost executor or driver resumes where the last batch ended. State is the engine's own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.sampling import SAMPLE_SIZE, sample_hash
from ..operators.usage import DAY_LIMIT, SESSION_LIMIT


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Zone-less times become session-zone times; a watermark accepts no others."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def running_profile(stream: DataFrame, by: list[str], individual: str, number: str, at: str) -> DataFrame:
    """Record count, approximate individuals, extremes and coverage per dataset."""
    return stream.groupBy(*by).agg(
        F.count(F.lit(1)).alias("number_of_records"),
        F.approx_count_distinct(individual).alias("number_of_unique_individuals"),
        F.min(number).alias("min_typical_age"),
        F.max(number).alias("max_typical_age"),
        F.date_format(F.min(at), "yyyy-MM-dd").alias("coverage_start"),
        F.date_format(F.max(at), "yyyy-MM-dd").alias("coverage_end"),
    )


def exact_profile(stream: DataFrame, by: list[str], individual: str, number: str, at: str) -> DataFrame:
    """:func:`running_profile` with the exact number of individuals.

    The engine's state holds every (dataset, individual) once, so it is spread by both and no
    dataset is a hot key; the first row of an individual counts it. Nulls are no individuals.
    """
    rows = stream.select(*by, F.lit(1).alias("_n"), F.lit(0).alias("_new"), F.col(number).alias("_x"), F.col(at).alias("_at"))
    first = stream.where(F.col(individual).isNotNull()).select(*by, individual).dropDuplicates([*by, individual])
    nothing = [F.lit(None).cast(stream.schema[c].dataType).alias(n) for c, n in ((number, "_x"), (at, "_at"))]
    both = rows.unionByName(first.select(*by, F.lit(0).alias("_n"), F.lit(1).alias("_new"), *nothing))
    return both.groupBy(*by).agg(
        F.sum("_n").alias("number_of_records"), F.sum("_new").alias("number_of_unique_individuals"),
        F.min("_x").alias("min_typical_age"), F.max("_x").alias("max_typical_age"),
        F.date_format(F.min("_at"), "yyyy-MM-dd").alias("coverage_start"), F.date_format(F.max("_at"), "yyyy-MM-dd").alias("coverage_end"),
    )


def daily_budget(
    stream: DataFrame, session: str, at: str, tokens: Column, session_limit: int = SESSION_LIMIT, delay: str = "1 day"
) -> DataFrame:
    """Tokens per session and day; rows later than the watermark are ignored."""
    timed = event_time(stream, at).withWatermark(at, delay)
    return timed.groupBy(F.window(at, "1 day"), F.col(session).alias("session_id")).agg(
        F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens")
    ).select(
        F.to_date("window.start").alias("day"), "session_id", "tokens", (F.col("tokens") >= session_limit).alias("exceeded")
    )


def over_day_limit(budgets: DataFrame, day_limit: int = DAY_LIMIT) -> DataFrame:
    """Day totals of finished session budgets."""
    return budgets.groupBy("day").agg(F.sum("tokens").alias("tokens")).withColumn("exceeded", F.col("tokens") >= day_limit)


#: Parts a group's rows are dealt to, so that a dataset that fills the stream is no hot key.
SAMPLE_SALTS = 16


def running_sample(stream: DataFrame, by: list[str], keys: list[str], k: int = SAMPLE_SIZE, seed: str = "0") -> DataFrame:
    """Updates of the sample of all rows seen so far, kept in the engine's state store.

    The state of a (dataset, salt) is its ``k`` rows of smallest digest; an update
    gives them all. :func:`sample_of` makes the sample of them.
    """
    held = f"struct<{', '.join(f'`{c}`:{stream.schema[c].dataType.simpleString()}' for c in keys)}>"
    rows = stream.select(*by, sample_hash(keys, seed).alias("_h"), F.to_json(F.struct(*keys)).alias("_row"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(SAMPLE_SALTS)).cast("int"))

    def update(key, batches, state):
        best = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            best = sorted(set(best) | set(zip(batch["_h"], batch["_row"])))[:k]
        state.update(([h for h, _ in best], [r for _, r in best]))
        yield pd.DataFrame([(*key, h, r) for h, r in best], columns=[*by, "_salt", "_h", "_row"])

    shape = T.StructType([*[stream.schema[c] for c in by], T.StructField("_salt", T.IntegerType())])
    shape = shape.add("_h", T.StringType()).add("_row", T.StringType())
    state = T.StructType().add("h", T.ArrayType(T.StringType())).add("row", T.ArrayType(T.StringType()))
    found = rows.groupBy(*by, "_salt").applyInPandasWithState(update, shape, state, "update", GroupStateTimeout.NoTimeout)
    return found.withColumn("_key", F.from_json("_row", held)).select(*by, "_salt", "_h", *[F.col("_key")[c].alias(c) for c in keys])


def sample_of(updates: DataFrame, by: list[str], keys: list[str], k: int = SAMPLE_SIZE) -> DataFrame:
    """The sample from the last update of each (dataset, salt)."""
    rows = newest(updates, [*by, "_salt"])
    w = Window.partitionBy(*by).orderBy("_h", *keys)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select(*by, *keys)


def running_fields(stream: DataFrame) -> DataFrame:
    """Updates of the last effective value of each (dataset, field, subfield).

    A plain running aggregation: folding its rows gives the same record as folding
    the whole log, and the cost of a batch follows the batch.
    """
    effective = F.col("subfield").isNotNull() | F.col("value").isNotNull()
    rank = F.struct(effective.alias("e"), F.col("seq"))
    return stream.groupBy("dataset_id", "field", "subfield").agg(
        F.max_by("value", rank).alias("value"), F.max_by("seq", rank).alias("seq")
    )


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of an update log with a ``batch`` column, the rows of each key's last batch."""
    last = F.max("batch").over(Window.partitionBy(*keys))
    return updates.withColumn("_last", last).where("batch = _last").drop("_last", "batch")


def append_updates(path: str):
    """``foreachBatch`` function: each batch has its own folder, so a repeated one replaces itself."""

    def run(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return run


def drain(query_writer, checkpoint: str):
    """Run a stream over everything available now and wait for it."""
    query = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
