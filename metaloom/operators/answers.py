"""Model answers held as a table: text repair, typed fields, mappings, codes.

No model is called here. The answers arrive as rows of text; everything below is
an expression on that text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import flag, split_list, top_n
from ..functions.text import strip, strip_marks
from .assemble import json_has_content
from .shape import json_string

# Fields of a metadata answer; those that are lists.
METADATA_FIELDS = [
    "purpose", "language", "title", "notes", "keyword", "population_coverage",
    "purpose_en_tmpt", "title_en_tmpt", "notes_en_tmpt", "keyword_en_tmpt", "spatial_tmpt",
]
METADATA_LISTS = ["purpose", "purpose_en_tmpt", "language", "keyword", "keyword_en_tmpt", "population_coverage"]

VALUE_FIELDS = ["number_of_unique_individuals", "min_typical_age", "max_typical_age"]
DATE_FIELDS = ["temporal_coverage"]
DATE_PARTS = ["year", "month", "day"]

STEP = "struct<op:string,params:string>"
MAPPING = f"struct<columns:array<string>,transform:array<{STEP}>>"
PART = f"struct<column:string,transform:array<{STEP}>>"


# ── text ─────────────────────────────────────────────────────────────────────

def strip_fences(c: Column) -> Column:
    """Content of the first Markdown fence when the text starts with one."""
    x = strip(c)
    inner = F.split_part(x, F.lit("```"), F.lit(2))
    body = strip(F.regexp_replace(inner, r"^json", ""))
    return F.when(x.startswith("```"), body).otherwise(x)


def repair_escapes(c: Column) -> Column:
    """Double every backslash that starts no JSON escape; valid escapes are consumed whole."""
    return F.regexp_replace(c, r'(\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})|(\\)', "$1$2$2")


def clean_answer(c: Column) -> Column:
    return repair_escapes(strip_fences(c))


def json_in_text(c: Column) -> Column:
    """The text as JSON, else its outermost ``{…}`` block, else the empty object."""
    block = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.nullif(block, F.lit(""))), F.parse_json(F.lit("{}")))


# ── metadata answers ─────────────────────────────────────────────────────────

def _as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _text(v: Column) -> Column:
    """Text of a scalar or nested JSON value as the record shows it."""
    kind = F.schema_of_variant(v)
    return (
        F.when(kind == "VOID", F.lit(None).cast("string"))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(v))
        .otherwise(F.try_variant_get(v, "$", "string"))
    )


def _truthy(v: Column) -> Column:
    return F.coalesce(~F.to_json(v).isin("null", '""', "0", "false", "[]", "{}"), F.lit(False))


EMPTY_TEXTS = "array<string>"

# Texts of the error rows.
NO_ANSWER = "Could not parse LLM response"
UNKNOWN_CODE = "LLM returned unknown code"
UNKNOWN_CODES = "LLM returned unknown codes"
VOCABULARY_MISSING = "vocab JSON not found"
ANSWER_BROKEN = "LLM call failed — answer is no JSON list"
TABLE_MISSING = "no vector table — run build_vector_db.py"


def list_field(v: Column) -> Column:
    """List coercion of an answer field; a plain text splits at ``;``."""
    empty = F.array().cast(EMPTY_TEXTS)
    items = F.transform(F.filter(_as_array(v), _truthy), lambda i: strip(_text(i)))
    text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.coalesce(items, split_list(text), empty)


def error_list(v: Column) -> Column:
    items = F.transform(_as_array(v), _text)
    return F.coalesce(items, F.when(v.isNotNull(), F.array(_text(v))), F.array().cast(EMPTY_TEXTS))


def metadata_answers(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """The eleven typed fields and the error list of each answer row."""
    doc = F.try_parse_json(clean_answer(F.col(raw)))
    fields = F.try_variant_get(doc, "$", "map<string,variant>")
    parsed = answers.withColumn("_f", fields)
    cols = []
    for f in METADATA_FIELDS:
        v = F.try_element_at("_f", F.lit(f))
        cols.append((list_field(v) if f in METADATA_LISTS else strip(F.coalesce(_text(v), F.lit("")))).alias(f))
    broken = F.array(F.lit(NO_ANSWER))
    errors = F.when(F.col("_f").isNull(), broken).otherwise(error_list(F.try_element_at("_f", F.lit("errors"))))
    keep = [c for c in answers.columns if c != raw]
    return parsed.select(*keep, *cols, errors.alias("errors"))


def open_answers(answers: DataFrame, prefilled: DataFrame, fields: list[str] = METADATA_FIELDS) -> DataFrame:
    """Datasets that still need an answer: not all fields present, not all filled.

    ``prefilled(dataset_id, field, value)``.
    """
    known = prefilled.where(F.col("field").isin(fields)).groupBy("dataset_id").agg(
        F.count_distinct("field").alias("n")
    )
    done = known.where(F.col("n") == len(fields)).select("dataset_id")
    return answers.join(done, "dataset_id", "left_anti")


# ── mapping answers ──────────────────────────────────────────────────────────

def _map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def step_list(v: Column) -> Column:
    """Cleaning steps of a list or a single object; items without ``op`` are left out."""
    items = F.coalesce(_as_array(v), F.when(_map(v).isNotNull(), F.array(v)))
    kept = F.filter(items, lambda i: F.coalesce(F.map_contains_key(_map(i), "op"), F.lit(False)))

    def step(i: Column) -> Column:
        m = _map(i)
        return F.struct(
            F.try_variant_get(F.try_element_at(m, F.lit("op")), "$", "string").alias("op"),
            F.to_json(F.try_element_at(m, F.lit("params"))).alias("params"),
        )

    return F.coalesce(F.transform(kept, step), F.array().cast(f"array<{STEP}>"))


def column_list(v: Column) -> Column:
    items = F.transform(_as_array(v), _text)
    single = F.when(_truthy(v), F.array(_text(v)))
    return F.coalesce(items, single, F.array().cast(EMPTY_TEXTS))


def value_mappings(v: Column) -> Column:
    """Mappings of a value field from a list, an object or bare column names."""

    def from_item(i: Column) -> Column:
        m = _map(i)
        of_object = F.struct(
            column_list(F.try_element_at(m, F.lit("columns"))).alias("columns"),
            step_list(F.try_element_at(m, F.lit("transform"))).alias("transform"),
        )
        name = F.when(F.schema_of_variant(i) == "STRING", F.try_variant_get(i, "$", "string"))
        of_name = F.struct(F.array(name).alias("columns"), F.array().cast(f"array<{STEP}>").alias("transform"))
        return F.when(m.isNotNull(), of_object).when(name.isNotNull(), of_name)

    items = F.coalesce(_as_array(v), F.when(F.coalesce(F.size(_map(v)) > 0, F.lit(False)), F.array(v)))
    mapped = F.filter(F.transform(items, from_item), lambda m: m.isNotNull())
    return F.coalesce(mapped.cast(f"array<{MAPPING}>"), F.array().cast(f"array<{MAPPING}>"))


def date_part(v: Column) -> Column:
    """One date part: a column name or an object under ``column`` or ``columns``."""
    m = _map(v)
    own = F.coalesce(F.try_element_at(m, F.lit("column")), F.try_element_at(m, F.lit("columns")))
    first = F.coalesce(F.try_element_at(_as_array(own), F.lit(1)), F.when(_as_array(own).isNull(), own))
    name = F.coalesce(
        F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")),
        F.when(_truthy(first), _text(first)),
    )
    steps = step_list(F.try_element_at(m, F.lit("transform")))
    return F.when(name.isNotNull() & (name != ""), F.struct(name.alias("column"), steps.alias("transform"))).cast(PART)


def date_mappings(v: Column) -> Column:
    """Year, month and day parts of each date mapping; mappings without any are dropped."""
    items = F.coalesce(_as_array(v), F.when(_map(v).isNotNull(), F.array(v)))
    objects = F.filter(F.transform(items, _map), lambda m: m.isNotNull())
    shaped = F.transform(
        objects, lambda m: F.struct(*[date_part(F.try_element_at(m, F.lit(p))).alias(p) for p in DATE_PARTS])
    )
    kept = F.filter(shaped, lambda s: F.coalesce(*[s[p]["column"] for p in DATE_PARTS]).isNotNull())
    typed = "array<struct<" + ",".join(f"{p}:{PART}" for p in DATE_PARTS) + ">>"
    return F.coalesce(kept.cast(typed), F.array().cast(typed))


def structure_answers(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Normalised mappings and errors of each structure answer."""
    parsed = answers.withColumn("_f", _map(F.try_parse_json(clean_answer(F.col(raw)))))

    def at(name: str) -> Column:
        return F.try_element_at("_f", F.lit(name))

    broken = F.array(F.lit(NO_ANSWER))
    keep = [c for c in answers.columns if c != raw]
    return parsed.select(
        *keep,
        *[value_mappings(at(f)).alias(f) for f in VALUE_FIELDS],
        *[date_mappings(at(f)).alias(f) for f in DATE_FIELDS],
        F.when(F.col("_f").isNull(), broken).otherwise(error_list(at("errors"))).alias("errors"),
    )


# ── vocabulary answers ───────────────────────────────────────────────────────

def answer_codes(c: Column) -> Column:
    """Codes of an answer: a JSON array, a single code, nothing for ``NONE``."""
    x = strip_marks(c)
    items = F.filter(_as_array(F.try_parse_json(x)), lambda v: F.schema_of_variant(v) == "STRING")
    listed = F.coalesce(F.transform(items, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast(EMPTY_TEXTS))
    single = F.when((x != "") & (x != "NONE"), F.array(x)).otherwise(F.array().cast(EMPTY_TEXTS))
    return F.when(x.startswith("["), listed).otherwise(single)


def registry_rows(raw: DataFrame) -> DataFrame:
    """Vocabulary registry with trimmed names and cells, one row per vocabulary."""
    named = raw.select(*[strip(F.col(f"`{c}`").cast("string")).alias(c.strip()) for c in raw.columns if c.strip()])
    return named.where(F.length("Feature") > 0).select(
        F.col("Name").alias("name"),
        F.rtrim(F.col("URL"), F.lit("/")).alias("base_url"),
        F.col("Feature").alias("feature"),
        route(F.col("Feature"), F.col("Metadata-Processed-By")).alias("route"),
        top_n(F.col("top-n")).alias("top_n"),
        flag(F.col("multiple_output")).alias("multiple"),
    )


def route(feature: Column, mode: Column) -> Column:
    """Which matcher serves a vocabulary; spatial coverage has its own."""
    return (
        F.when(feature == "", F.lit(None).cast("string"))
        .when(feature == "spatial", "spatial")
        .when(F.upper(strip(mode)) == "RAG", "similarity")
        .otherwise("codes")
    )


def default_value(feature: Column, multiple: Column) -> Column:
    """JSON default of a feature without any match."""
    return F.when(multiple, "[]").when(feature == "dcat_type", '""').otherwise("null")


def match_codes(answers: DataFrame, registry: DataFrame, vocab: DataFrame) -> DataFrame:
    """Uris, unknown codes and problem of ``answers(dataset_id, feature, raw)``.

    A single-valued feature takes a known code or reports the text it got; a list
    keeps the known codes in answer order. The coding system is an object and
    also sets the code values. Codes meet their vocabulary by a join, so its size
    does not matter; ``problem`` tells a missing vocabulary or a broken list.
    """
    raw = strip_marks(F.col("raw"))
    listed = raw.startswith("[")
    nothing = F.array().cast(EMPTY_TEXTS)
    usable = F.when(F.col("multiple"), F.when(listed, answer_codes(F.col("raw"))).otherwise(nothing)).otherwise(
        F.when(raw.isin("", "NONE"), nothing).otherwise(F.array(raw))
    )
    broken = F.col("multiple") & listed & _as_array(F.try_parse_json(raw)).isNull()
    met = answers.join(registry.where("base_url <> ''"), "feature").select(
        "dataset_id", "feature", "multiple", "base_url", F.coalesce(usable, nothing).alias("codes"), F.coalesce(broken, F.lit(False)).alias("broken")
    )
    named = vocab.select("feature", F.lit(True).alias("has_vocabulary")).distinct()
    known = vocab.select("feature", F.col("code").alias("code"), F.lit(True).alias("known")).distinct()
    rows = met.join(named, "feature", "left").select("*", F.posexplode_outer("codes").alias("pos", "given"))
    rows = rows.withColumn("code", strip(F.col("given"))).join(known, ["feature", "code"], "left")
    # an answer names a handful of codes, so its row is put together again
    part = F.struct("pos", "given", F.col("known").isNotNull().alias("known"))
    shaped = rows.groupBy("dataset_id", "feature", "multiple", "base_url", "broken", "has_vocabulary").agg(
        F.array_sort(F.collect_list(F.when(F.length("code") > 0, part))).alias("parts")
    )
    has = F.col("has_vocabulary").isNotNull()
    matched = F.when(has, F.transform(F.filter("parts", lambda p: p["known"]), lambda p: p["given"])).otherwise(nothing)
    unknown = F.when(has, F.transform(F.filter("parts", lambda p: ~p["known"]), lambda p: p["given"])).otherwise(nothing)
    problem = F.when(~has, VOCABULARY_MISSING).when(F.col("broken"), ANSWER_BROKEN)
    shaped = shaped.select("dataset_id", "feature", "multiple", "base_url", matched.alias("matched"), unknown.alias("unknown"), problem.alias("problem"))
    uris = F.transform("matched", lambda c: F.concat(F.col("base_url"), F.lit("/"), c))
    single = F.when(
        (F.col("feature") == "coding_system") & (F.size("matched") > 0),
        F.concat(F.lit('{"uri":'), json_string(uris[0]), F.lit(',"label":'), json_string(F.col("matched")[0]), F.lit("}")),
    ).when(F.size("matched") > 0, json_string(uris[0])).otherwise(default_value(F.col("feature"), F.lit(False)))
    return shaped.select(
        "dataset_id", "feature", F.when(F.col("multiple"), F.to_json(uris)).otherwise(single).alias("value"), "unknown",
        F.when(F.col("feature") == "coding_system", F.col("matched")).otherwise(nothing).alias("code_values"), "problem",
    )


def code_errors(matches: DataFrame) -> DataFrame:
    """One error row per answer that named unknown codes, was broken or had no vocabulary."""
    quoted = F.transform("unknown", lambda c: F.concat(F.lit("'"), c, F.lit("'")))
    many = F.concat(F.lit(UNKNOWN_CODES + " ["), F.concat_ws(", ", quoted), F.lit("]"))
    one = F.concat(F.lit(UNKNOWN_CODE + " "), quoted[0])
    named = F.when(F.size("unknown") > 0, F.when(F.col("value").startswith("["), many).otherwise(one))
    said = F.coalesce("problem", named)
    return matches.where(said.isNotNull()).select("dataset_id", F.concat(F.col("feature"), F.lit(": "), said).alias("error"))


def missing_tables(queries: DataFrame, index: DataFrame) -> DataFrame:
    """One error row per query of a feature that has no vector table: ``queries(dataset_id, feature)``."""
    gone = queries.join(index.select("feature").distinct(), "feature", "left_anti")
    return gone.select("dataset_id", F.concat(F.col("feature"), F.lit(": " + TABLE_MISSING)).alias("error"))


def prefilled_feature(value: Column, feature: Column, multiple: Column) -> Column:
    """A prefilled vocabulary value in the declared cardinality, as JSON."""
    v = F.try_parse_json(value)
    items = _as_array(v)
    as_list = F.when(items.isNotNull(), value).otherwise(F.concat(F.lit("["), value, F.lit("]")))
    as_one = F.when(items.isNotNull(), F.to_json(F.try_element_at(items, F.lit(1)))).otherwise(value)
    given = json_has_content(value)
    return F.when(~given, default_value(feature, multiple)).when(multiple, as_list).otherwise(as_one)


def derived_code_values(coding_system: Column, code_values: Column) -> Column:
    """Code values beside a prefilled coding system: own list, else its label or last segment."""
    own = F.try_parse_json(code_values)
    v = F.try_parse_json(coding_system)
    label = F.coalesce(
        F.try_variant_get(F.try_element_at(_map(v), F.lit("label")), "$", "string"),
        F.when(F.schema_of_variant(v) == "STRING", F.element_at(F.split(F.try_variant_get(v, "$", "string"), "/"), -1)),
    )
    listed = F.when(_as_array(own).isNotNull(), code_values).when(
        json_has_content(code_values), F.concat(F.lit("["), code_values, F.lit("]"))
    )
    from_label = F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit("["), json_string(label), F.lit("]")))
    return F.coalesce(listed, from_label, F.lit("[]"))


def vocabulary_summary(entries: Column) -> Column:
    """Entry fields without their uri, as JSON."""
    return F.to_json(F.map_filter(entries, lambda k, v: k != "uri"))
