"""Catalogue records: merge of extraction steps, overrides, upserts, finalising, diff.

A record is kept in long form ``(dataset_id, field, value)``, ``value`` being JSON
text (NULL for JSON null), so every rule is one join or one aggregation over all
datasets at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import (
    ARRAY_FIELDS, SEMICOLON_FIELDS, is_non_public, language_list, language_text_list, next_version,
    next_version_history, text_to_array,
)
from ..functions.text import is_whole, whole_text
from .shape import json_string

# Order of the extraction steps; later steps win.
STEP_ORDER = ["llm_metadata", "static", "structure_tmpt", "dataframe_statistics", "vocabulary"]
ERROR_FIELDS = ["errors", "_vocabulary_errors"]

# Fields that a prefilled record never overrides.
MANAGED_FIELDS = ["version", "has_version"]

# Defaults of the static step, as JSON.
STATIC_DEFAULTS = {
    "theme": '["http://publications.europa.eu/resource/authority/data-theme/HEAL"]',
    "legal_basis": '{"description":"RGPD","source":"https://www.boe.es/doue/2016/119/L00001-00088.pdf"}',
    "applicable_legislation": (
        '[{"uri":"http://data.europa.eu/eli/reg/2016/679/oj","label":"GDPR"},'
        '{"uri":"http://data.europa.eu/eli/reg/2025/327/oj","label":"Reglamento EHDS"}]'
    ),
}
DEFAULT_LEGISLATION = '[{"uri":"http://data.europa.eu/eli/reg/2016/679/oj","label":"GDPR"}]'

# Fields that move into the distribution object.
DISTRIBUTION_FIELDS = [
    "access_url", "download_url", "name", "description",
    "format", "mimetype", "compress_format", "package_format",
    "size", "hash", "hash_algorithm", "rights", "availability",
    "status", "license", "retention_period",
]

# Fields that leave the form of a non-public record.
NON_PUBLIC_HIDDEN = ["identifier", "access_url"]


def json_has_content(j: Column) -> Column:
    """JSON text with content: not null, no blank string, no empty list or object."""
    return F.coalesce(~j.rlike(r'^\s*(?:null|"(?:\s|\\[tnrf])*"|\[\s*\]|\{\s*\})?\s*$'), F.lit(False))


def json_is_filled(j: Column) -> Column:
    """The laxer test: a string of blanks counts as filled."""
    return F.coalesce(~j.rlike(r'^\s*(?:null|""|\[\s*\]|\{\s*\})?\s*$'), F.lit(False))


def step_rank(step: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STEP_ORDER]), step)


def merge_steps(outputs: DataFrame, include_internal: bool = False) -> DataFrame:
    """``(dataset_id, step, field, value)`` to one value per field; the last step wins.

    Error lists are left to :func:`accumulated_errors`. Internal ``*_tmpt`` fields
    are dropped before the aggregation unless asked for.
    """
    kept = outputs.where(~F.col("field").isin(ERROR_FIELDS))
    if not include_internal:
        kept = drop_internal(kept)
    return kept.groupBy("dataset_id", "field").agg(F.max_by("value", step_rank(F.col("step"))).alias("value"))


def drop_internal(values: DataFrame) -> DataFrame:
    return values.where(~F.col("field").endswith("_tmpt"))


def accumulated_errors(errors: DataFrame) -> DataFrame:
    """``(dataset_id, step_rank, pos, error)`` numbered 1, 2, … per dataset in step order.

    Rows instead of one array, numbered within each step; the counts of the earlier
    steps, a handful per dataset, are the offsets.
    """
    keys = ["dataset_id", "step_rank"]
    local = errors.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    counts = errors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("dataset_id").orderBy("step_rank").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    return local.join(offsets, keys).select("dataset_id", (F.col("_local") + F.col("_o")).alias("n"), "error")


def apply_overrides(values: DataFrame, overrides: DataFrame) -> DataFrame:
    """Prefilled values win when they have content and fill in missing keys."""
    given = overrides.where(~F.col("field").isin(MANAGED_FIELDS)).select(
        "dataset_id", "field", F.col("value").alias("_given"), F.lit(True).alias("_has_given")
    )
    base = values.withColumn("_has_base", F.lit(True))
    joined = base.join(given, ["dataset_id", "field"], "full")
    take = F.col("_has_given") & (F.col("_has_base").isNull() | json_has_content(F.col("_given")))
    return joined.select(
        "dataset_id", "field", F.when(take, F.col("_given")).otherwise(F.col("value")).alias("value")
    )


def static_fields(datasets: DataFrame, overrides: DataFrame, run_time: str) -> DataFrame:
    """Static defaults per dataset unless the prefilled record has content for them.

    The run time is a parameter, so a repeated run gives the same record.
    """
    stamp = f'"{run_time}"'
    defaults = {"issued": stamp, "modified": stamp, **STATIC_DEFAULTS}
    given = overrides.where(F.col("dataset_id").isNotNull() & F.col("field").isin(list(defaults)) & json_has_content(F.col("value")))
    # one row per dataset meets another: the defaults are written out behind the join
    given = given.groupBy("dataset_id").agg(F.collect_list(F.struct("field", "value")).alias("_given"))

    def rows(field: str, value: str) -> Column:
        own = F.filter("_given", lambda g: g["field"] == field)
        return F.when(F.size(own) > 0, own).otherwise(F.array(F.struct(F.lit(field).alias("field"), F.lit(value).alias("value"))))

    return datasets.select("dataset_id").join(given, "dataset_id", "left").select(
        "dataset_id", F.inline(F.concat(*[rows(f, v) for f, v in defaults.items()]))
    )


def version_fields(datasets: DataFrame, overrides: DataFrame) -> DataFrame:
    """Next version and extended history of each dataset from its prefilled record."""
    given = overrides.where(F.col("field").isin(MANAGED_FIELDS)).groupBy("dataset_id").agg(
        F.max(F.when(F.col("field") == "version", F.col("value"))).alias("v"),
        F.max(F.when(F.col("field") == "has_version", F.col("value"))).alias("h"),
    )
    joined = datasets.select("dataset_id").join(given, "dataset_id", "left")
    text = F.try_variant_get(F.try_parse_json("v"), "$", "string")
    listed = F.from_json("h", "array<string>")
    history = F.when(F.col("h").isNull() | listed.isNotNull(), F.to_json(next_version_history(listed))).otherwise(F.col("h"))
    rows = F.array(
        F.struct(F.lit("version").alias("field"), json_string(next_version(text)).alias("value")),
        F.struct(F.lit("has_version").alias("field"), history.alias("value")),
    )
    return joined.select("dataset_id", F.inline(rows))


def file_fields(facts: DataFrame) -> DataFrame:
    """``(dataset_id, mimetype, format, size, hash, hash_algorithm)`` rows as fields."""
    rows = F.array(*[
        F.struct(F.lit(f).alias("field"), (F.col(f).cast("string") if f == "size" else json_string(F.col(f))).alias("value"))
        for f in ("mimetype", "format", "size", "hash", "hash_algorithm")
    ])
    return facts.select("dataset_id", F.inline(rows)).where("value is not null")


def statistics_fields(stats: DataFrame) -> DataFrame:
    """Statistics rows ``(dataset_id, …)`` as record fields; unresolved ones are null."""
    span = F.struct(F.col("coverage_start").alias("start"), F.col("coverage_end").alias("end"))
    values = {
        "number_of_records": F.col("number_of_records").cast("string"),
        "number_of_unique_individuals": F.col("number_of_unique_individuals").cast("string"),
        "min_typical_age": number_json(F.col("min_typical_age")),
        "max_typical_age": number_json(F.col("max_typical_age")),
        "temporal_coverage": F.when(F.col("coverage_start").isNotNull(), F.to_json(span)),
    }
    rows = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in values.items()])
    return stats.select("dataset_id", F.inline(rows))


def number_json(x: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.when(is_whole(x), whole_text(x)).otherwise(x.cast("string"))


def normalize_arrays(values: DataFrame) -> DataFrame:
    """Fields that must be lists become lists; languages become authority uris.

    A text splits at ``;`` for keywords and is wrapped otherwise; anything else
    that is no list becomes the empty list.
    """
    v = F.try_parse_json("value")
    items = F.try_variant_get(v, "$", "array<variant>")
    text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    words = F.filter(F.transform(items, lambda i: F.try_variant_get(i, "$", "string")), lambda w: w.isNotNull())
    empty = F.lit("[]")
    language = F.coalesce(F.to_json(language_list(words)), F.to_json(language_text_list(text)), F.col("value"))
    keyword = F.when(items.isNotNull(), F.col("value")).otherwise(F.coalesce(F.to_json(text_to_array("keyword", text)), empty))
    other = F.when(items.isNotNull(), F.col("value")).otherwise(F.coalesce(F.to_json(text_to_array("purpose", text)), empty))
    field = F.col("field")
    plain = [f for f in ARRAY_FIELDS if f != "language" and f not in SEMICOLON_FIELDS]
    fixed = (
        F.when(field == "language", language).when(field.isin(SEMICOLON_FIELDS), keyword)
        .when(field.isin(plain), other).otherwise(F.col("value"))
    )
    return values.withColumn("value", fixed)


def derived_names(values: DataFrame, overrides: DataFrame) -> DataFrame:
    """``description`` from notes and ``name`` from title: a prefilled source wins over
    the model's, a prefilled target needs nothing."""
    target = F.when(F.col("field") == "notes", "description").otherwise("name")
    sources = ["notes", "title"]

    def candidates(rows: DataFrame, rank: int) -> DataFrame:
        return rows.where(F.col("field").isin(sources) & json_has_content(F.col("value"))).select(
            "dataset_id", target.alias("field"), "value", F.lit(rank).alias("_rank")
        )

    done = overrides.where(F.col("field").isin("description", "name") & json_has_content(F.col("value")))
    return (
        candidates(overrides, 1).unionByName(candidates(values, 2))
        .groupBy("dataset_id", "field").agg(F.min_by("value", "_rank").alias("value"))
        .join(done.select("dataset_id", "field"), ["dataset_id", "field"], "left_anti")
    )


# ── session state ────────────────────────────────────────────────────────────

def fold_changes(changes: DataFrame) -> DataFrame:
    """State of each field after a log of partial records.

    ``changes(dataset_id, seq, field, subfield, value)``: a row without subfield sets
    the whole field, a NULL value only creates the key; rows with a subfield merge
    into the object that stands, the members of a whole object being its subfields.
    The log is first reduced to one row per (field, subfield), so the second step
    sees a handful of rows per field.
    """
    members = F.map_entries(F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>"))
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    opened = F.transform(members, lambda e: F.struct(e["key"].alias("subfield"), text(e["value"]).alias("value")))
    own = F.array(F.struct("subfield", "value"))
    changes = changes.select(
        "dataset_id", "seq", "field",
        F.inline(F.when(F.col("subfield").isNull() & members.isNotNull(), F.concat(own, opened)).otherwise(own)),
    )
    effective = F.col("subfield").isNotNull() | F.col("value").isNotNull()
    last = F.when(effective, F.col("seq"))
    reduced = changes.groupBy("dataset_id", "field", "subfield").agg(
        F.max_by("value", last).alias("value"), F.max(last).alias("seq")
    )
    packed = reduced.groupBy("dataset_id", "field").agg(
        F.collect_list(F.struct("subfield", "value", "seq")).alias("parts"),
        F.coalesce(F.max(F.when(F.col("subfield").isNull(), F.col("seq"))), F.lit(-1)).alias("whole_seq"),
    )
    newer = F.exists("parts", lambda e: e["subfield"].isNotNull() & (e["seq"] > F.col("whole_seq")))
    alive = F.filter("parts", lambda e: e["subfield"].isNotNull() & (e["seq"] >= F.col("whole_seq")))
    whole = F.filter("parts", lambda e: e["subfield"].isNull())
    chosen = F.when(newer, alive).otherwise(whole)
    return packed.select("dataset_id", "field", F.inline(chosen)).drop("seq")


def conditional_fields(values: DataFrame, fixed_uri: str) -> DataFrame:
    """Non-public records get a fixed identifier and access url."""
    closed = values.where((F.col("field") == "access_rights") & is_non_public(F.col("value"))).select("dataset_id")
    forced = closed.select(
        "dataset_id", F.explode(F.array(*[F.lit(f) for f in NON_PUBLIC_HIDDEN])).alias("field"),
        F.lit(f'"{fixed_uri}"').alias("_forced"),
    )
    return values.join(forced, ["dataset_id", "field"], "full").select(
        "dataset_id", "field", F.coalesce("_forced", "value").alias("value")
    )


def finalize(values: DataFrame) -> DataFrame:
    """Nest the distribution fields of records that have an access url.

    Other fields pass through untouched. One aggregation per dataset gathers the about
    sixty fields of a record, so the input is read once.
    """
    law = "applicable_legislation"
    moved = F.col("field").isin(DISTRIBUTION_FIELDS)
    filled = json_is_filled(F.col("value"))
    others = ~moved & ~F.col("field").isin(law, "distribution")
    grouped = values.groupBy("dataset_id").agg(
        F.collect_list(F.when(others, F.struct("field", "value"))).alias("rest"),
        F.array_sort(F.collect_list(F.when(moved & filled, F.struct("field", "value")))).alias("parts"),
        F.coalesce(F.max(F.when((F.col("field") == law) & filled, F.col("value"))), F.lit(DEFAULT_LEGISLATION)).alias("law"),
        F.max(F.when(F.col("field") == "distribution", F.struct("value"))).alias("held"),
    )
    members = F.transform("parts", lambda e: F.concat(json_string(e["field"]), F.lit(":"), e["value"]))
    with_law = F.concat(members, F.array(F.concat(F.lit(f'"{law}":'), F.col("law"))))
    nested = F.concat(F.lit("[{"), F.concat_ws(",", with_law), F.lit("}]"))
    has_url = F.exists("parts", lambda e: e["field"] == "access_url")

    def row(field: str, value: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), value.alias("value"))

    distribution = F.when(has_url, row("distribution", nested)).when(
        F.col("held").isNotNull(), row("distribution", F.col("held.value"))
    )
    rows = F.filter(F.array(row(law, F.col("law")), distribution), lambda r: r.isNotNull())
    return grouped.select("dataset_id", F.inline(F.concat("rest", rows)))


def distribution_part(values: DataFrame) -> DataFrame:
    """The fields of a record that belong to its distribution."""
    return values.where(F.col("field").isin(DISTRIBUTION_FIELDS))


def contract(values: DataFrame, datasets: DataFrame, fields: list[str]) -> DataFrame:
    """Exactly the asked fields per dataset, NULL where absent."""
    wanted = datasets.select(
        "dataset_id", F.posexplode(F.array(*[F.lit(f) for f in fields])).alias("ord", "field")
    )
    only = values.where(F.col("field").isin(fields))
    return wanted.join(only, ["dataset_id", "field"], "left").select("dataset_id", "ord", "field", "value")


def active_fields(datasets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Form fields per record and block; identifier and access url leave a closed
    record, the legislation has its own step.

    ``datasets(dataset_id, access_rights)``; the blocks are packed into one array
    that each record row opens, so no join is needed.
    """
    rows = blocks.where(F.col("field") != "applicable_legislation")
    packed = rows.agg(F.array_sort(F.collect_list(F.struct("block_id", "ord", "field"))).alias("b")).scalar()
    opened = datasets.select("dataset_id", is_non_public(F.col("access_rights")).alias("closed"), F.inline(packed))
    return opened.where(~(F.col("closed") & F.col("field").isin(NON_PUBLIC_HIDDEN))).drop("closed")


# ── comparison ───────────────────────────────────────────────────────────────

def record_diff(first: DataFrame, second: DataFrame, bucketed: bool = False) -> DataFrame:
    """Differences between two runs: ``(dataset_id, field, problem, before, after)``.

    Versions must have grown by one and the history by the new version; all other
    fields must be equal. Both runs meet in one aggregation per record, which holds
    its about sixty fields; a repeated field counts once. Runs that the sinks wrote as
    ``bucketed`` tables meet bucket by bucket, without a shuffle of their fields.
    """
    fields = bucket_pairs(first, second) if bucketed else field_pairs(first, second)
    before, after = F.col("a.value"), F.col("b.value")
    problem = (
        F.when(F.col("a").isNull(), "missing in first")
        .when(F.col("b").isNull(), "missing in second")
        .when(~before.eqNullSafe(after), "differs")
    )
    managed = F.col("field").isin(MANAGED_FIELDS)
    found = F.struct("field", problem.alias("problem"), before.alias("before"), after.alias("after"))
    records = fields.groupBy("dataset_id").agg(
        F.collect_list(F.when(~managed & problem.isNotNull(), found)).alias("changed"),
        *[F.max(F.when(F.col("field") == f, v)).alias(n) for f, v, n in (
            ("version", before, "v1"), ("version", after, "v2"), ("has_version", before, "h1"), ("has_version", after, "h2"),
        )],
    )
    rows = F.filter(F.concat("changed", version_problems()), lambda r: r["problem"].isNotNull())
    return records.select("dataset_id", F.inline(rows))


def field_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(dataset_id, field, a, b)``: the value of a field in either run, NULL where the run lacks it."""
    both = first.select("dataset_id", "field", "value", F.lit(1).alias("_run")).unionByName(
        second.select("dataset_id", "field", "value", F.lit(2).alias("_run"))
    )
    side = lambda run: F.max(F.when(F.col("_run") == run, F.struct(F.coalesce("value", F.lit("")), "value")))
    return both.groupBy("dataset_id", "field").agg(side(1).alias("a"), side(2).alias("b"))


def bucket_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """:func:`field_pairs` of two tables bucketed by dataset and field; both are never null there."""

    def one(run: DataFrame, name: str) -> DataFrame:
        return run.groupBy("dataset_id", "field").agg(F.max(F.struct(F.coalesce("value", F.lit("")), "value")).alias(name))

    return one(first, "a").join(one(second, "b"), ["dataset_id", "field"], "full")


def version_problems() -> Column:
    """Findings on the columns v1, v2 (version) and h1, h2 (history) of two runs."""

    def number(v: str) -> Column:
        return F.trim(F.col(v), F.lit('" ')).try_cast("double")

    version = (
        F.when(F.col("v1").isNull() | F.col("v2").isNull(), "missing version")
        .when(number("v1").isNotNull() & number("v2").isNotNull() & (number("v2") != number("v1") + 1), "not incremented")
        .when((number("v1").isNull() | number("v2").isNull()) & (F.col("v1") != F.col("v2")), "version changed")
    )
    old, new = (F.from_json(F.col(h), "array<string>") for h in ("h1", "h2"))
    expected = F.concat(old, F.array(F.trim(F.col("v2"), F.lit('"'))))
    history = (
        F.when(F.col("h1").isNull() | F.col("h2").isNull(), "missing history")
        .when(old.isNotNull() & new.isNotNull() & (expected != new), "history not extended")
        .when((old.isNull() | new.isNull()) & (F.col("h1") != F.col("h2")), "history changed")
    )
    rows = F.array(
        F.struct(F.lit("version").alias("field"), version.alias("problem"), F.col("v1").alias("before"), F.col("v2").alias("after")),
        F.struct(F.lit("has_version").alias("field"), history.alias("problem"), F.col("h1").alias("before"), F.col("h2").alias("after")),
    )
    return rows
