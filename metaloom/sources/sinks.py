"""Sinks: record documents, reports, vector tables, logs, triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import report_label
from ..operators.assemble import json_has_content
from ..operators.shape import json_string
from ..operators.triples import ntriples


def record_json(values: DataFrame) -> DataFrame:
    """``(dataset_id, value)``: one JSON document per record, keys sorted.

    A record has a fixed set of about sixty fields, so it fits into one row.
    """
    member = F.concat(json_string(F.col("field")), F.lit(":"), F.coalesce("value", F.lit("null")))
    grouped = values.groupBy("dataset_id").agg(F.array_sort(F.collect_list(member)).alias("m"))
    return grouped.select("dataset_id", F.concat(F.lit("{"), F.concat_ws(",", "m"), F.lit("}")).alias("value"))


#: Rows that a bucket of a run should hold.
BUCKET_ROWS = 500_000


def buckets_for(values: DataFrame, least: int = 64) -> int:
    """Buckets for runs of this size, so that the task of a bucket does not grow with the run."""
    return max(least, -(-values.count() // BUCKET_ROWS))


def write_run(values: DataFrame, table: str, path: str, buckets: int = 64) -> DataFrame:
    """``(dataset_id, field, value)`` as a table bucketed by dataset and field.

    Tables of one number of buckets join and group by these columns without a shuffle. A
    bucket should fit a task: ``buckets_for`` tells how many that takes. Rows without a dataset or a field are left out.
    """
    rows = values.where("dataset_id is not null and field is not null").select("dataset_id", "field", "value")
    keys = ["dataset_id", "field"]
    # one file per bucket: the writer's tasks are the buckets
    rows.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return values.sparkSession.table(table)


def write_records(values: DataFrame, path: str) -> None:
    """One JSON line per record, files spread by dataset."""
    record_json(values).select("value").write.mode("overwrite").text(path)


def value_text(v: Column) -> Column:
    """Report text of a JSON value: texts of a list joined, empty list ``none``,
    fractions with two decimals, other values plain."""
    items = F.try_variant_get(v, "$", "array<variant>")
    texts = F.transform(items, lambda i: F.try_variant_get(i, "$", "string"))
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(items.isNotNull() & (F.size(items) == 0), "none")
        .when(items.isNotNull(), F.concat_ws("; ", texts))
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.format_string("%.2f", number))
        .when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string")))
        .otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    )


def report_lines(values: DataFrame) -> DataFrame:
    """``(dataset_id, field, line)``; the parts of an object are indented below it."""
    v = F.try_parse_json("value")
    inner = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    parts = F.transform(
        inner, lambda e: F.concat(F.lit("    "), report_label(e["key"]), F.lit(": "), value_text(e["value"]))
    )
    head = F.concat(F.lit("  "), report_label(F.col("field")), F.lit(":"))
    single = F.concat(head, F.lit(" "), value_text(v))
    return values.select(
        "dataset_id", "field", F.when(inner.isNotNull(), F.concat_ws("\n", F.array(head), parts)).otherwise(single).alias("line")
    )


def write_report(values: DataFrame, path: str) -> None:
    lines = report_lines(values)
    keyed = F.concat(F.col("dataset_id").cast("string"), F.lit("\t"), F.col("line"))
    lines.repartitionByRange("dataset_id", "field").sortWithinPartitions("dataset_id", "field").select(
        keyed.alias("value")
    ).write.mode("overwrite").text(path)


def write_vector_table(index: DataFrame, path: str) -> None:
    """Vector rows below one folder per feature; other features stay untouched."""
    (
        index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("feature").parquet(path)
    )


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """Vocabulary entries sorted by code."""
    vocab.repartitionByRange("feature", "code").sortWithinPartitions("feature", "code").write.mode("overwrite").json(path)


USAGE_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("provider", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
    T.StructField("estimated_cost_usd", T.DoubleType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("extra_json", T.StringType()),
])


def append_usage(calls: DataFrame, path: str) -> None:
    """Append usage rows, foldered by day so that a day's budget reads one folder."""
    have = set(calls.columns)
    full = calls.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in USAGE_SCHEMA.fields
    ])
    full.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def finalize_rows(records: DataFrame, ts: Column) -> DataFrame:
    """Usage rows that record the finalising of records ``(dataset_id, value)``."""
    return records.select(
        ts.alias("ts"), F.col("dataset_id").cast("string").alias("session_id"),
        F.lit("/finalize").alias("endpoint"), F.col("value").alias("extra_json"),
    )


def write_triples(triples: DataFrame, path: str) -> None:
    ntriples(triples).write.mode("overwrite").text(path)


def errors_summary(outputs: DataFrame) -> DataFrame:
    """``(number, errors)``: error list of the latest output of each numbered dataset.

    ``outputs(folder, modified, errors)``; folders are called ``dataset_<number>``,
    errors are JSON, a single text counts as a list of one.
    """
    number = F.regexp_extract("folder", r"^dataset_(\d+)", 1).try_cast("bigint")
    listed = F.when(F.col("errors").startswith("["), F.col("errors")).when(
        json_has_content(F.col("errors")), F.concat(F.lit("["), "errors", F.lit("]"))
    ).otherwise("[]")
    return (
        outputs.withColumns({"number": number, "errors": listed}).where("number is not null")
        .groupBy("number").agg(F.max_by("errors", F.struct("modified", "folder")).alias("errors"))
    )


def write_json_rows(rows: DataFrame, path: str) -> None:
    """Findings, summaries and other row tables as JSON lines."""
    rows.write.mode("overwrite").json(path)
