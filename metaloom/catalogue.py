"""Catalogue records of datasets, from their files to the final document.

The steps of a record run in a fixed order: model answers, static fields, mappings,
statistics, vocabulary matches. Everything but the statistics is a small table keyed
by ``dataset_id``; the data of a dataset is read once, for its statistics, and only
the columns that the mappings name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import assemble as A
from .operators.profile import STAT_FIELDS, has_value, profile
from .sources import files as FS
from .sources import delimited, json_docs, xml_docs  # noqa: F401  (register readers)

FIELDS = "dataset_id string, field string, value string"


def no_fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FIELDS)


def named_in(structure) -> set[str]:
    """All texts of a structure: the columns it maps are among them."""
    if isinstance(structure, str):
        return {structure}
    inner = structure.values() if isinstance(structure, dict) else structure if isinstance(structure, (list, tuple)) else ()
    return set().union(*map(named_in, inner))


def records_frame(df: DataFrame, names: set[str] | None = None) -> DataFrame:
    """Readers of open formats give a ``fields`` map; its keys become columns, those among ``names`` if given.

    The key set comes from one aggregation over the distinct keys of the records; with
    names it is no larger than they are, however many keys the data have.
    """
    if "fields" not in df.columns:
        return df
    if "error" in df.columns:
        df = df.where("error is null")
    present = F.map_keys("fields")
    if names is not None:
        present = F.array_intersect(present, F.lit(sorted(names)).cast("array<string>"))
    keys = [r[0] for r in df.select(F.explode(present)).distinct().orderBy("col").collect()]
    return df.select(*[F.try_element_at("fields", F.lit(k)).alias(k) for k in keys])


def statistics(
    spark: SparkSession, dataset_id: str, path: str, structure: dict, prefilled: dict | None = None, **options
) -> DataFrame:
    """Statistics of one dataset as record fields; with all of them given nothing is read."""
    given = {k: v for k, v in (prefilled or {}).items() if has_value(v)}
    complete = all(f in (prefilled or {}) for f in STAT_FIELDS) or all(f in given for f in STAT_FIELDS)
    df = spark.range(0) if complete else records_frame(FS.read_any(spark, path), named_in(structure))
    stats = profile(df, structure, given, **options)
    if complete:  # nothing was counted, so only what was given is known
        stats = stats.withColumn("number_of_records", F.lit(given.get("number_of_records")).cast("bigint"))
    return A.statistics_fields(stats.withColumn("dataset_id", F.lit(dataset_id)))


def assemble(
    datasets: DataFrame,
    stats: DataFrame,
    run_time: str,
    answers: DataFrame | None = None,
    vocabulary: DataFrame | None = None,
    facts: DataFrame | None = None,
    overrides: DataFrame | None = None,
    include_internal: bool = False,
) -> DataFrame:
    """Final ``(dataset_id, field, value)`` rows of all datasets.

    ``answers``, ``vocabulary`` and ``overrides`` are long tables of JSON values,
    ``facts`` one row of file facts per dataset. ``stats`` is used once, so its scans
    run once; ``datasets`` is used often and should be a plain list of ids.
    """
    spark = datasets.sparkSession
    given = A.normalize_arrays(overrides if overrides is not None else no_fields(spark))
    answered = answers if answers is not None else no_fields(spark)
    static = A.static_fields(datasets, given, run_time).unionByName(A.version_fields(datasets, given))
    if facts is not None:
        static = static.unionByName(A.file_fields(facts))
    static = static.unionByName(A.derived_names(answered, given))
    steps = [
        (answered, "llm_metadata"), (static, "static"), (stats, "dataframe_statistics"),
        (vocabulary if vocabulary is not None else no_fields(spark), "vocabulary"),
    ]
    outputs = None
    for rows, step in steps:
        part = rows.select("dataset_id", F.lit(step).alias("step"), "field", "value")
        outputs = part if outputs is None else outputs.unionByName(part)
    merged = A.normalize_arrays(A.merge_steps(outputs, include_internal))
    return A.apply_overrides(merged, given)
