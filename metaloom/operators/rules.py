"""Rule tables, validation of records and what is missing from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import bind
from .assemble import json_is_filled
from .lookup import help_entry

# Value shapes that the checks accept.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
SLUG = r"^[a-z0-9\-]+$"
SUB_URL = r"^https?://[^\s/]+\.[^\s/]+"
PHONE = r"^[\d\s\+\-\(\)]+$"
PHONE_DIGITS = 9
IDENTIFIER = r'^[^\s"<>]+$'

# Message texts.
REQUIRED_TEXT = "es obligatorio."
LIST_TEXT = "debe ser una lista."
EMAIL_TEXT = "debe ser un email válido."
URL_TEXT = "debe ser una URL válida."
SLUG_TEXT = "debe ser un slug válido."
OBJECT_TEXT = "debe tener completados todos los campos."
PHONE_TEXT = "debe ser un teléfono válido."
IDENTIFIER_TEXT = "debe ser un DOI válido (ej: 10.1234/dataset-salud)."

# Optional fields that a non-public record must fill in.
NON_PUBLIC_REQUIRED = ["dcat_type", "contact", "provenance", "keyword"]

SUBFIELD = "struct<name:string,type:string,required:boolean,label:string>"
RULES_SCHEMA = (
    "field string, required boolean, type string, choices array<string>, min_items int, max_items int, "
    f"subfields array<{SUBFIELD}>"
)


# ── rules from a schema listing ──────────────────────────────────────────────

def derive_rules(schema: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Validation rules from schema rows (``field_name, required, preset, …``).

    Absent attributes may be missing columns. Later attributes win: preset, form
    snippet, display snippet, subfields. ``aliases`` gives record keys to schema
    names that differ from them; ``access_url`` is always known as a url.
    """
    have = set(schema.columns)

    def get(name: str, dtype: str) -> Column:
        return F.col(name).cast(dtype) if name in have else F.lit(None).cast(dtype)

    base = F.when(get("preset", "string") == "dataset_slug", "slug").when(
        get("preset", "string") == "tag_string_autocomplete", "list"
    ).otherwise("text")
    formed = F.when(get("form_snippet", "string") == "markdown.html", "markdown").otherwise(base)
    shown = (
        F.when(get("display_snippet", "string") == "email.html", "email")
        .when(get("display_snippet", "string") == "link.html", "url").otherwise(formed)
    )
    if "repeating_subfields" in have:
        subs = F.transform(
            "repeating_subfields",
            lambda s: F.struct(
                s["field_name"].alias("name"),
                F.when(s["display_snippet"] == "email.html", "email")
                .when(s["display_snippet"] == "link.html", "url")
                .when(s["field_name"] == "telephone", "telephone").otherwise("text").alias("type"),
                F.coalesce(s["required"], F.lit(False)).alias("required"),
                s["field_name"].alias("label"),
            ),
        )
    else:
        subs = F.lit(None).cast(f"array<{SUBFIELD}>")
    once = subs.isNotNull() & F.coalesce(get("repeating_once", "boolean"), F.lit(False))
    choices = F.transform("choices", lambda c: c["value"]) if "choices" in have else F.lit(None).cast("array<string>")
    rules = schema.select(
        F.col("field_name").alias("field"),
        F.coalesce(get("required", "boolean"), F.lit(False)).alias("required"),
        F.when(subs.isNotNull(), "list_object").otherwise(shown).alias("type"),
        choices.alias("choices"),
        F.when(once, 1).otherwise(get("min_items", "int")).alias("min_items"),
        F.when(once, 1).otherwise(get("max_items", "int")).alias("max_items"),
        subs.alias("subfields"),
    )
    for schema_name, key in (aliases or {}).items():
        rules = rules.unionByName(rules.where(F.col("field") == schema_name).withColumn("field", F.lit(key)))
    url = schema.sparkSession.range(1).select(
        F.lit("access_url").alias("field"), F.lit(False).alias("required"), F.lit("url").alias("type")
    )
    return rules.unionByName(url, allowMissingColumns=True)


def field_listing(schema: DataFrame) -> DataFrame:
    """Name, label, required, preset, help text and validators of each schema field."""
    have = set(schema.columns)
    cols = [("field_name", "name"), ("label", "label"), ("preset", "preset"), ("help_text", "help_text"), ("validators", "validators")]
    picked = [F.col(a).alias(b) if a in have else F.lit(None).cast("string").alias(b) for a, b in cols]
    required = F.coalesce(F.col("required").cast("boolean"), F.lit(False)) if "required" in have else F.lit(False)
    return schema.select(*picked, required.alias("required"))


# ── validation ───────────────────────────────────────────────────────────────

def message(tag: Column, field: Column, text: str) -> Column:
    return F.concat_ws(" ", tag, field, F.lit(text))


def problem(when: Column, check: str, text: Column, subfield: Column | None = None, marks: bool = False) -> Column:
    """One possible finding: a struct where the test fails, NULL otherwise.

    ``marks`` tells that the message names its field in brackets, which makes a
    required field count as missing.
    """
    sub = F.lit(None).cast("string") if subfield is None else subfield
    return F.when(
        when, F.struct(F.lit(check).alias("check"), sub.alias("subfield"), text.alias("message"), F.lit(marks).alias("marks"))
    )


def text_of(v: Column) -> Column:
    """Text of a JSON string, NULL for other kinds."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def object_problems(value: Column, field: Column, tag: Column) -> Column:
    """Findings inside an object or a list of objects."""
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))
    is_list = F.try_variant_get(value, "$", "array<variant>").isNotNull()
    is_object = F.try_variant_get(value, "$", "map<string,variant>").isNotNull()
    sub_specs = F.coalesce(F.col("subfields"), F.array().cast(f"array<{SUBFIELD}>"))

    def per_sub(fields: Column):
        def check(s: Column) -> Column:
            head = F.concat(
                F.when(s["required"], F.lit("[OBLIG] [")).otherwise(F.lit("[OPT] [")), field, F.lit("] "),
                F.coalesce(s["label"], s["name"]), F.lit(" "),
            )

            def finding(x: Column) -> Column:
                short = F.length(F.regexp_replace(x, "[^0-9]", "")) < PHONE_DIGITS
                tests = [
                    ("email", ~x.rlike(EMAIL), EMAIL_TEXT),
                    ("url", ~x.rlike(SUB_URL), URL_TEXT),
                    ("telephone", ~x.rlike(PHONE) | short, PHONE_TEXT),
                ]
                return F.coalesce(*[
                    problem((x != "") & (s["type"] == kind) & bad, kind, F.concat(head, F.lit(text)), s["name"], True)
                    for kind, bad, text in tests
                ])

            return bind(text_of(F.try_element_at(fields, s["name"])), finding)

        return check

    def per_item(item: Column, i: Column) -> Column:
        where = F.concat(field, F.lit("["), i.cast("string"), F.lit("]"))
        bad = F.array(problem(F.lit(True), "object", message(tag, where, OBJECT_TEXT)))
        return bind(
            F.try_variant_get(item, "$", "map<string,variant>"),
            lambda fields: F.when(fields.isNull(), bad).otherwise(F.transform(sub_specs, per_sub(fields))),
        )

    shape = problem(~(is_list | is_object), "object", message(tag, field, OBJECT_TEXT))
    return F.when(shape.isNotNull(), F.array(shape)).otherwise(F.flatten(F.transform(items, per_item)))


def with_rules(values: DataFrame, rules: DataFrame) -> DataFrame:
    """The values that have a rule, with its columns."""
    return values.join(rules, "field")


def validate(values: DataFrame, rules: DataFrame, required_fields: list[str] = ()) -> DataFrame:
    """Findings ``(dataset_id, field, subfield, check, message, marks)`` of all records.

    ``values(dataset_id, field, value)`` holds JSON text. The rule table is a small
    dictionary; all checks of a value run in its row.
    """
    ruled = with_rules(values, rules).withColumn("v", F.try_parse_json("value"))
    field, kind = F.col("field"), F.col("type")
    tag = F.when(field.isin(list(required_fields)), F.lit("[OBLIG]")).otherwise(F.lit("[OPT]"))
    filled = json_is_filled(F.col("value"))
    x = text_of(F.col("v"))
    given = filled & F.coalesce(x != "", F.lit(False))
    is_list = F.try_variant_get("v", "$", "array<variant>").isNotNull()
    missing = problem(F.col("required") & ~filled, "required", message(tag, field, REQUIRED_TEXT))
    not_null = F.col("value").isNotNull() & (F.col("value") != "null")
    simple = F.array(
        problem((kind == "list") & not_null & ~is_list, "list", message(tag, field, LIST_TEXT)),
        problem((kind == "email") & given & ~x.rlike(EMAIL), "email", message(tag, field, EMAIL_TEXT)),
        problem((kind == "url") & given & ~x.rlike("^https?://"), "url", message(tag, field, URL_TEXT)),
        problem((kind == "slug") & given & ~x.rlike(SLUG), "slug", message(tag, field, SLUG_TEXT)),
    )
    nested = F.when((kind == "list_object") & filled, object_problems(F.col("v"), field, tag))
    found = F.when(missing.isNotNull(), F.array(missing)).otherwise(
        F.concat(simple, F.coalesce(nested, F.slice(simple, 1, 0)))
    )
    return ruled.select(
        "dataset_id", "field", F.inline(F.filter(found, lambda e: e.isNotNull()))
    ).select("dataset_id", "field", "subfield", "check", "message", "marks")


def validate_identifiers(values: DataFrame, label: str = "identifier", required: bool = True) -> DataFrame:
    """Identifiers of open records must be free of blanks, quotes and angle brackets."""
    def pick(name: str) -> Column:
        return F.max(F.when(F.col("field") == name, text_of(F.try_parse_json("value"))))

    wide = values.where(F.col("field").isin("identifier", "access_rights")).groupBy("dataset_id").agg(
        pick("identifier").alias("id"), pick("access_rights").alias("ar")
    )
    closed = F.coalesce(F.element_at(F.split("ar", "/"), -1) == "NON_PUBLIC", F.lit(False))
    bad = wide.where((F.col("id") != "") & ~closed & ~F.col("id").rlike(IDENTIFIER))
    tag = "[OBLIG]" if required else "[OPT]"
    return bad.select(
        "dataset_id", F.lit("identifier").alias("field"), F.lit(None).cast("string").alias("subfield"),
        F.lit("identifier").alias("check"), F.lit(f"{tag} [identifier] {label} {IDENTIFIER_TEXT}").alias("message"),
        F.lit(True).alias("marks"),
    )


def wanted_fields(datasets: DataFrame, fields: DataFrame) -> DataFrame:
    """Each dataset with each field of a bounded list, opened from one packed array."""
    packed = fields.agg(F.array_sort(F.collect_list(F.struct("ord", "field"))).alias("f")).scalar()
    return datasets.select("dataset_id", F.inline(packed))


def missing_required(datasets: DataFrame, values: DataFrame, findings: DataFrame, required: DataFrame) -> DataFrame:
    """Required fields that are empty or whose findings name them.

    A dotted name looks into its object: ``hdab.email`` is the email of ``hdab``.
    """
    wanted = wanted_fields(datasets, required).withColumns({
        "parent": F.split("field", r"\.", 2)[0], "child": F.try_element_at(F.split("field", r"\.", 2), F.lit(2)),
    })
    held = values.select("dataset_id", F.col("field").alias("parent"), "value")
    joined = wanted.join(held, ["dataset_id", "parent"], "left")
    inner = F.to_json(F.try_element_at(F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>"), F.col("child")))
    value = F.when(F.col("child").isNotNull(), inner).otherwise(F.col("value"))
    flagged = findings.where("marks").select("dataset_id", "field", F.lit(True).alias("bad")).distinct()
    return (
        joined.select("dataset_id", "ord", "field", json_is_filled(value).alias("filled"))
        .join(flagged, ["dataset_id", "field"], "left")
        .where(~F.col("filled") | F.col("bad").isNotNull())
        .select("dataset_id", "field")
    )


def validity(datasets: DataFrame, values: DataFrame, findings: DataFrame, missing: DataFrame, fields: DataFrame) -> DataFrame:
    """Verdict and completeness counters per record; ``fields(ord, field, required)``.

    All inputs are reduced to counters and added up in one aggregation.
    """
    names = ["filled_required", "filled_optional", "errors", "missing"]

    def counted(rows: DataFrame, **given: Column) -> DataFrame:
        return rows.select("dataset_id", *[given.get(n, F.lit(0)).cast("bigint").alias(n) for n in names])

    filled = values.where(json_is_filled(F.col("value"))).join(fields.select("field", "required"), "field")
    parts = (
        counted(datasets)
        .unionByName(counted(
            filled, filled_required=F.col("required").cast("int"), filled_optional=(~F.col("required")).cast("int")
        ))
        .unionByName(counted(findings, errors=F.lit(1)))
        .unionByName(counted(missing, missing=F.lit(1)))
    )
    sums = parts.groupBy("dataset_id").agg(*[F.sum(n).alias(n) for n in names])
    totals = fields.agg(F.count_if("required").alias("r"), F.count_if(~F.col("required")).alias("o"))
    return sums.select(
        "dataset_id",
        ((F.col("errors") == 0) & (F.col("missing") == 0)).alias("valid"),
        *names,
        totals.select("r").scalar().alias("total_required"),
        totals.select("o").scalar().alias("total_optional"),
    )


def block_missing(datasets: DataFrame, values: DataFrame, block: DataFrame, rules: DataFrame) -> DataFrame:
    """Missing fields of a block; an object reports its first missing required part
    as ``field.part``."""
    wanted = wanted_fields(datasets, block.where(F.col("field") != "applicable_legislation"))
    joined = wanted.join(values, ["dataset_id", "field"], "left").join(
        rules.select("field", "type", "subfields"), "field", "left"
    )
    parts = F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")
    open_parts = F.filter(
        F.coalesce(F.col("subfields"), F.array().cast(f"array<{SUBFIELD}>")),
        lambda s: s["required"] & ~json_is_filled(F.to_json(F.try_element_at(parts, s["name"]))),
    )
    first = F.try_element_at(open_parts, F.lit(1))["name"]
    inner = F.when((F.col("type") == "list_object") & parts.isNotNull(), F.concat("field", F.lit("."), first))
    gap = F.coalesce(inner, F.when(~json_is_filled(F.col("value")), F.col("field")))
    return joined.select("dataset_id", "ord", gap.alias("missing")).where("missing is not null")


def missing_help(missing: DataFrame, guide: DataFrame, closed: DataFrame) -> DataFrame:
    """Label and obligation of each missing field.

    ``guide(ord, name, label, required)``, ``closed(dataset_id)`` lists non-public
    records, for which four optional fields become required.
    """
    rows = missing.where(F.col("field") != "applicable_legislation")
    named = help_entry(rows, guide.select("ord", "name", F.struct("label", "required").alias("label")).select(
        "ord", "name", F.to_json("label").alias("label")
    ))
    entry = F.from_json("label", "struct<label:string,required:boolean>")
    flagged = named.join(closed.select("dataset_id", F.lit(True).alias("closed")), "dataset_id", "left")
    must = F.coalesce(entry["required"], F.lit(False)) | (
        entry["label"].isNotNull() & F.col("closed").isNotNull() & F.col("field").isin(NON_PUBLIC_REQUIRED)
    )
    return flagged.select(
        "dataset_id", "field", F.coalesce(entry["label"], F.col("field")).alias("label"), must.alias("required")
    )


def group_missing(missing: DataFrame) -> DataFrame:
    """Dotted missing fields gathered under their parent; plain ones stand first.

    The members of a parent are the parts of one object, a bounded list.
    """
    parts = F.split("field", r"\.", 2)
    return (
        missing.select("dataset_id", parts[0].alias("parent"), F.try_element_at(parts, F.lit(2)).alias("part"))
        .groupBy("dataset_id", "parent")
        .agg(F.array_sort(F.collect_set("part")).alias("parts"))
        .withColumn("simple_first", F.when(F.size("parts") == 0, 0).otherwise(1))
    )


def kind_of(value: Column) -> Column:
    """Type of a JSON value without the types of its members."""
    return F.regexp_extract(F.schema_of_variant(F.try_parse_json(value)), r"^[A-Z]+", 0)


def output_regressions(outputs: DataFrame, expected: DataFrame, non_empty: list[str]) -> DataFrame:
    """Records against a sample record: missing fields, other types, empty values.

    ``expected(ord, field, value)`` is the sample record in long form.
    """
    wanted = wanted_fields(outputs.select("dataset_id").distinct(), expected.select("ord", "field")).join(
        expected.select("field", kind_of(F.col("value")).alias("kind")), "field"
    )
    held = outputs.select("dataset_id", "field", "value", F.lit(True).alias("present"))
    joined = wanted.join(held, ["dataset_id", "field"], "left")
    verdict = (
        F.when(F.col("present").isNull(), "missing")
        .when(F.col("field").isin(non_empty) & ~json_is_filled(F.col("value")), "empty")
        .when(kind_of(F.col("value")) != F.col("kind"), "wrong type")
    )
    return joined.select("dataset_id", "field", verdict.alias("verdict")).where("verdict is not null")


# ── schema texts for forms ───────────────────────────────────────────────────

# Access rights offered in the form; label prefixes of opening hours.
ACCESS_CHOICES = ["PUBLIC", "RESTRICTED", "NON_PUBLIC"]
SPECIAL_HOURS = "Horario especial – "
USUAL_HOURS = "Horario habitual – "


def choices_in(choices: Column, lang: str = "es") -> Column:
    """``array<struct<value,label map>>`` to value and label in one language."""

    def one(c: Column) -> Column:
        label = F.coalesce(F.try_element_at(c["label"], F.lit(lang)), F.try_element_at(c["label"], F.lit("es")), c["value"])
        return F.struct(c["value"].alias("value"), label.alias("label"))

    return F.transform(choices, one)


def access_choices(choices: Column) -> Column:
    """Only the access rights that the form offers, by last segment."""
    return F.filter(choices, lambda c: F.element_at(F.split(c["value"], "/"), -1).isin(ACCESS_CHOICES))


def subfield_listing(subfields: Column) -> Column:
    """Name, label and obligation of each part; opening hours get a prefix."""

    def one(s: Column) -> Column:
        name = s["field_name"]
        label = F.coalesce(s["label"], name)
        shown = (
            F.when(name.startswith("special_opening_hours"), F.concat(F.lit(SPECIAL_HOURS), label))
            .when(name.startswith("opening_hours"), F.concat(F.lit(USUAL_HOURS), label))
            .otherwise(label)
        )
        return F.struct(name.alias("field_name"), shown.alias("label"), F.coalesce(s["required"], F.lit(False)).alias("required"))

    return F.transform(subfields, one)


def block_listing(blocks: DataFrame) -> DataFrame:
    """Each form block with its fields in order; a block is a short fixed list."""
    return blocks.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("ord", "field"))).alias("f")).select(
        "name", F.transform("f", lambda e: e["field"]).alias("fields")
    )
