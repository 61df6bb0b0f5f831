"""Streams over the event table, run over all rows available and read back."""

from pyspark.sql import functions as F

from ..operators.assemble import fold_changes
from ..session import shared_dir
from ..streaming import profile as SP, upserts as UP
from .registry import ORACLE, query


def event_stream(t):
    schema = t.events.schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/event*.parquet")


def finished(t, stream, mode, name):
    """Run to the end and return the rows of the last result table."""
    root = shared_dir(t.spark, name)
    out = f"{root}/out"

    def save(batch, n):
        batch.write.mode("overwrite").parquet(out)

    SP.drain(stream.writeStream.outputMode(mode).foreachBatch(save), f"{root}/checkpoint")
    return t.spark.read.parquet(out)


@query("p1_stream_profile", """
    select event_type as dataset, count(*) as number_of_records, true as individuals_within_error, min(value) as min_typical_age, max(value) as max_typical_age,
           strftime(min(ts), '%Y-%m-%d') as coverage_start, strftime(max(ts), '%Y-%m-%d') as coverage_end from events group by 1""")
def p1(t):
    """The running profile; its distinct count is a sketch and held against the exact one."""
    stream = event_stream(t).withColumnRenamed("event_type", "dataset")
    out = finished(t, SP.running_profile(stream, ["dataset"], "user_id", "value", "ts"), "complete", "p1")
    exact = t.events.groupBy(F.col("event_type").alias("dataset")).agg(F.count_distinct("user_id").alias("exact"))
    found = F.col("number_of_unique_individuals")
    # three times the sketch's relative standard deviation
    within = F.abs(found - F.col("exact")) <= 0.15 * F.col("exact")
    return out.join(exact, "dataset").withColumn("individuals_within_error", within).drop("number_of_unique_individuals", "exact")


@query("p1_exact_profile", """
    select event_type as dataset, count(*) as number_of_records, count(distinct user_id) as number_of_unique_individuals, min(value) as min_typical_age,
           max(value) as max_typical_age, strftime(min(ts), '%Y-%m-%d') as coverage_start, strftime(max(ts), '%Y-%m-%d') as coverage_end from events group by 1""")
def p1_exact(t):
    stream = event_stream(t).withColumnRenamed("event_type", "dataset")
    return finished(t, SP.exact_profile(stream, ["dataset"], "user_id", "value", "ts"), "complete", "p1-exact")


@query("p2_stream_sample", """
    select event_type, event_id from (select *, row_number() over (partition by event_type order by md5(concat_ws('|', event_id, '0')), event_id) as n from events)
    where n <= 20""")
def p2(t):
    root = shared_dir(t.spark, "p2")
    stream = event_stream(t).select("event_type", "event_id")
    updates = SP.running_sample(stream, ["event_type"], ["event_id"])
    SP.drain(updates.writeStream.outputMode("update").foreachBatch(SP.append_updates(f"{root}/log")), f"{root}/checkpoint")
    return SP.sample_of(t.spark.read.parquet(f"{root}/log"), ["event_type"], ["event_id"])


@query("p3_stream_budget", """
    select cast(ts as date) as day, user_id as session_id, coalesce(sum(case when event_type <> 'error' then event_id % 100 end), 0)::bigint as tokens,
           coalesce(sum(case when event_type <> 'error' then event_id % 100 end), 0) >= 300 as exceeded from events group by 1, 2""")
def p3(t):
    tokens = F.when(F.col("event_type") != "error", F.col("event_id") % 100)
    return finished(t, SP.daily_budget(event_stream(t), "user_id", "ts", tokens, 300), "complete", "p3")


@query("p3_late_rows", """
    with e as (select *, cast(ts as date) as day from events), m as (select max(day) as last from e where event_id % 5 <> 0)
    select day, user_id as session_id, sum(event_id % 100)::bigint as tokens, sum(event_id % 100) >= 300 as exceeded
    from e, m where event_id % 5 <> 0 and day <= last - 2 group by 1, 2""")
def p3_late(t):
    """Append mode over four files: the third one is late as a whole and counts for nothing.

    A day is final once the watermark, one day behind the latest row, has passed its end.
    Rows are late by the watermark of the batch before, hence a row between.
    """
    root = shared_dir(t.spark, "p3")
    rows = t.events.select("event_id", "user_id", "ts")
    last = F.lit(rows.where("event_id % 5 <> 0").agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    late = rows.where("event_id % 5 = 0").where(F.col("ts") < F.date_sub(F.to_date(last), 2))
    flush = rows.limit(1).select("event_id", "user_id", last.alias("ts"))
    for part in (rows.where("event_id % 5 <> 0"), flush, late, flush):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    budget = SP.daily_budget(stream, "user_id", "ts", F.col("event_id") % 100, 300, "1 day")
    write = budget.writeStream.outputMode("append").foreachBatch(SP.append_updates(f"{root}/out"))
    SP.drain(write, f"{root}/checkpoint")
    return t.spark.read.parquet(f"{root}/out").drop("batch")


def change_log(rows):
    e = F.col("event_id")
    return rows.select(
        F.col("user_id").alias("dataset_id"), e.alias("seq"), F.concat(F.lit("f_"), "event_type").alias("field"),
        F.when(e % 5 != 0, F.when(e % 2 == 0, "a").otherwise("b")).alias("subfield"),
        F.when(e % 7 != 0, e.cast("string")).alias("value"),
    )


def p4(t):
    root = shared_dir(t.spark, "p4")
    log = change_log(event_stream(t))
    updates = SP.running_fields(log)
    SP.drain(updates.writeStream.outputMode("update").foreachBatch(SP.append_updates(f"{root}/log")), f"{root}/checkpoint")
    return fold_changes(SP.newest(t.spark.read.parquet(f"{root}/log"), ["dataset_id", "field", "subfield"]))


query("p4_stream_upsert", ORACLE["l4_upsert_fold"])(p4)


def p4_compacted(t):
    """The same table kept in generations: eight batches, compacted at every third."""
    root, keys = shared_dir(t.spark, "p4"), ["dataset_id", "field", "subfield"]
    t.events.repartitionByRange(8, "event_id").write.parquet(f"{root}/in")
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    updates = SP.running_fields(change_log(stream))
    SP.drain(updates.writeStream.outputMode("update").foreachBatch(UP.keep_upserts(f"{root}/table", keys, 3)), f"{root}/checkpoint")
    return fold_changes(UP.upserted(t.spark, f"{root}/table", keys, updates.schema))


query("p4_compacted_upsert", ORACLE["l4_upsert_fold"])(p4_compacted)
