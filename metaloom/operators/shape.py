"""Nested records to flat ones and back, and the inventory of column paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dsl import quoted
from ..functions.text import bind, cell_text, last_wins, space_json_text, strip

#: The nesting that the JSON parser takes, for values whose type does not tell theirs.
PARSER_DEPTH = 1000
VARIANT_MAP = "map<string,variant>"


# ── typed records ────────────────────────────────────────────────────────────

def leaf_columns(df: DataFrame) -> list[tuple[str, Column, T.DataType]]:
    """(dotted path, column, type) of every non-struct field, structs opened."""
    out: list[tuple[str, Column, T.DataType]] = []

    def walk(col: Column, dtype: T.DataType, path: str) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(col[f.name], f.dataType, f"{path}.{f.name}")
        else:
            out.append((path, col, dtype))

    for f in df.schema.fields:
        walk(F.col(quoted(f.name)), f.dataType, f.name)
    return out


def flatten_records(df: DataFrame) -> DataFrame:
    """All-string columns named by dotted paths; lists as JSON text, nulls stay null."""
    return df.select(*[cell_text(c, t).alias(p) for p, c, t in leaf_columns(df)])


def field_pairs(df: DataFrame, exclude: list[str] = ()) -> Column:
    """(key, value) pairs of a record, null cells left out."""
    pairs = [
        F.struct(F.lit(p).alias("key"), cell_text(c, t).alias("value"))
        for p, c, t in leaf_columns(df) if p not in exclude
    ]
    return F.filter(F.array(*pairs), lambda e: e["value"].isNotNull())


def field_map(df: DataFrame, exclude: list[str] = ()) -> Column:
    """One map per record, null cells left out."""
    return F.map_from_entries(field_pairs(df, exclude))


def long_fields(df: DataFrame, key: str, dataset: str = "dataset_id") -> DataFrame:
    """(dataset_id, field, value) rows of the non-null cells, without a shuffle."""
    rows = df.select(F.col(key).alias(dataset), F.inline(field_pairs(df, exclude=[key])))
    return rows.withColumnRenamed("key", "field")


# ── open JSON records ────────────────────────────────────────────────────────

def variant_text(v: Column) -> Column:
    """Text of a JSON leaf: lists as spaced JSON, booleans capitalised, null dropped later."""
    kind = F.schema_of_variant(v)
    return (
        F.when(kind == "VOID", F.lit(None).cast("string"))
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), space_json_text(F.to_json(v)))
        .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string")))
        .when(kind == "DOUBLE", cell_text(F.try_variant_get(v, "$", "double"), T.DoubleType()))
        .otherwise(F.try_variant_get(v, "$", "string"))
    )


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", VARIANT_MAP).isNotNull()


def variant_entries(v: Column) -> Column:
    return F.map_entries(F.try_variant_get(v, "$", VARIANT_MAP))


def cell(key: Column, v: Column, more: Column, steps: Column | None = None, raw: Column | None = None) -> Column:
    """One entry on the way down: still a value to open, or already text.

    With the raw text of the record at hand, a list of objects takes its text from
    there, because a variant sorts the keys of its objects.
    """
    text = variant_text(v)
    if raw is not None:
        kind = F.schema_of_variant(v)
        ordered = kind.startswith("ARRAY") & (kind.contains("OBJECT") | kind.contains("VARIANT"))
        text = F.when(ordered, F.coalesce(space_json_text(raw_text(raw, steps)), text)).otherwise(text)
    at = F.array().cast("array<string>") if steps is None else steps
    return bind(more, lambda open_: F.struct(
        key.alias("key"), F.when(open_, v).alias("value"), F.when(~open_, text).alias("text"), at.alias("steps")
    ))


def raw_text(raw: Column, steps: Column) -> Column:
    """Text of a member of a JSON object along its keys, NULL where there is none."""
    return F.aggregate(steps, raw, lambda t, k: F.try_element_at(F.from_json(t, "map<string,string>"), k))


def nesting(v: Column) -> Column:
    """Levels of a JSON value at most: its type names every object and list in it.

    The type of a list of unlike items does not; the brackets of its text bound them.
    """
    kind = F.schema_of_variant(v)
    brackets = F.length(F.regexp_replace(F.to_json(v), r"[^\[{]+", "")) + 1
    return F.when(kind.contains("VARIANT"), F.least(brackets, F.lit(PARSER_DEPTH))).otherwise(F.size(F.split(kind, "(?:OBJECT|ARRAY)<")))


def object_nesting(v: Column) -> Column:
    """Levels of objects outside of lists at most; only items of lists can have a type that tells nothing."""
    return F.size(F.split(F.schema_of_variant(v), "OBJECT<"))


def open_cells(cells: Column, children, depth: Column) -> Column:
    """Open nested values level by level inside the row until none is left.

    A fold over the levels, so the plan has one step whatever the depth; ``depth`` only
    has to be enough.
    """

    def level(acc: Column, _: Column) -> Column:
        opened = F.flatten(F.transform(acc, lambda c: F.when(c["value"].isNull(), F.array(c)).otherwise(children(c))))
        return F.when(F.exists(acc, lambda c: c["value"].isNotNull()), opened).otherwise(acc)

    folded = F.aggregate(F.sequence(F.lit(1), depth), cells, level)
    return F.transform(folded, lambda c: F.struct(c["key"].alias("key"), c["text"].alias("value"), c["steps"].alias("steps")))


def object_cells(entries: Column, above: Column | None = None, raw: Column | None = None) -> Column:
    """Cells of (key, value) entries, keys extended by the dotted key of the cell above."""

    def one(e: Column) -> Column:
        key = e["key"] if above is None else F.concat(above["key"], F.lit("."), e["key"])
        steps = None
        if raw is not None:
            steps = F.array(e["key"]) if above is None else F.concat(above["steps"], F.array(e["key"]))
        return cell(key, e["value"], is_object(e["value"]), steps, raw)

    return F.transform(entries, one)


def flatten_entries(entries: Column, depth: Column, raw: Column | None = None) -> Column:
    """(dotted key, text) pairs of nested entries, null cells left out."""
    flat = open_cells(object_cells(entries, raw=raw), lambda c: object_cells(variant_entries(c["value"]), c, raw), depth)
    return F.filter(flat, lambda e: e["value"].isNotNull())


def as_map(flat: Column) -> Column:
    return last_wins(F.transform(flat, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def flatten_object(v: Column, raw: Column | None = None) -> Column:
    """JSON object to ``map<path, text>`` without null cells.

    ``raw`` is the text of the object, if there is one: it tells the written order,
    in which the last of clashing paths counts and objects in lists keep their keys.
    """
    if raw is None:
        return as_map(flatten_entries(variant_entries(v), object_nesting(v)))

    def in_order(flat: Column) -> Column:
        keys = F.json_object_keys(raw)
        placed = F.transform(flat, lambda e, i: F.struct(F.array_position(keys, e["steps"][0]).alias("p"), i.alias("i"), e.alias("e")))
        clash = F.size(F.array_distinct(F.transform(flat, lambda e: e["key"]))) < F.size(flat)
        return F.when(clash & keys.isNotNull(), F.transform(F.array_sort(placed), lambda x: x["e"])).otherwise(flat)

    return as_map(bind(flatten_entries(variant_entries(v), object_nesting(v), raw), in_order))


def path_samples(v: Column) -> Column:
    """(path, sample) pairs of a record for the schema inventory.

    A list of objects is represented by its first one under ``path[]``, a list of
    scalars by its first item; blanks are left out.
    """

    def one(prefix: Column | None, suffix: str):
        def named(e: Column) -> Column:
            key = e["key"] if prefix is None else F.concat(prefix, F.lit(suffix), e["key"])
            nested = is_object(e["value"]) | F.try_variant_get(e["value"], "$", "array<variant>").isNotNull()
            return cell(key, e["value"], nested)

        return named

    def children(c: Column) -> Column:
        items = F.try_variant_get(c["value"], "$", "array<variant>")
        first = F.try_element_at(items, F.lit(1))
        scalar = F.filter(F.array(first), lambda i: i.isNotNull())
        return F.coalesce(
            F.transform(variant_entries(c["value"]), one(c["key"], ".")),
            F.transform(variant_entries(first), one(c["key"], "[].")),
            F.transform(scalar, lambda i: cell(c["key"], i, F.lit(False))),
        )

    flat = open_cells(F.transform(variant_entries(v), one(None, "")), children, nesting(v))
    texts = F.transform(flat, lambda e: F.struct(e["key"].alias("path"), strip(e["value"]).alias("sample")))
    return F.filter(texts, lambda e: F.coalesce(F.length(e["sample"]), F.lit(0)) > 0)


# ── inventory ────────────────────────────────────────────────────────────────

def typed_path_samples(df: DataFrame, keep: list[str]) -> DataFrame:
    """(keep.., path, sample) of a typed table, blank cells left out.

    A list is represented by its first item, a list of structs by the fields of its
    first one under ``path[]``.
    """
    pairs = []

    def walk(col: Column, dtype: T.DataType, path: str) -> None:
        if isinstance(dtype, T.ArrayType):
            first, inner = F.try_element_at(col, F.lit(1)), dtype.elementType
            walk(first, inner, f"{path}[]" if isinstance(inner, T.StructType) else path)
        elif isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(col[f.name], f.dataType, f"{path}.{f.name}")
        else:
            pairs.append(F.struct(F.lit(path).alias("path"), strip(cell_text(col, dtype)).alias("sample")))

    for path, col, dtype in leaf_columns(df):
        if path not in keep:
            walk(col, dtype, path)
    rows = df.select(*keep, F.inline(F.array(*pairs)))
    return rows.where(F.length("sample") > 0)


def inventory(samples: DataFrame, by: list[str], order: str, n: int = 3) -> DataFrame:
    """Path with its first ``n`` distinct sample texts in order of first appearance.

    Grouping by (path, sample) spreads a path that every record has; only ``n``
    rows per path leave each task afterwards.
    """
    from .sampling import first_distinct

    firsts = first_distinct(samples, [*by, "path"], "sample", order, n)
    return firsts.groupBy(*by, "path").agg(
        F.array_sort(F.collect_list(F.struct("rank", "sample"))).alias("ranked"),
    ).select(*by, "path", F.transform("ranked", lambda r: r["sample"]).alias("samples"))


def inventory_counts(sample: DataFrame, inventory_rows: DataFrame) -> DataFrame:
    """Number of columns and of sampled records, the two figures beside the inventory."""
    records = sample.agg(F.count(F.lit(1)).alias("records"))
    return inventory_rows.agg(F.count(F.lit(1)).alias("columns")).withColumn("records", records.scalar())


# ── nesting ──────────────────────────────────────────────────────────────────

def split_dotted(df: DataFrame, key: str = "key") -> DataFrame:
    """``parent.child`` keys to (field, subfield); plain keys have no subfield."""
    parts = F.split(F.col(key), r"\.", 2)
    return df.withColumns({"field": parts[0], "subfield": F.try_element_at(parts, F.lit(2))}).drop(key)


def nested_json(fields: Column) -> Column:
    """JSON object text of a flat map whose dotted keys become nested objects.

    An entry set under a parent that is already plain is left out, as in a merge
    that only descends into objects.
    """
    keys = F.map_keys(fields)
    parents = F.array_distinct(F.transform(keys, lambda k: F.split(k, r"\.", 2)[0]))

    def one(parent: Column) -> Column:
        own = fields[parent]
        prefix = F.concat(parent, F.lit("."))
        inner = F.map_filter(fields, lambda k, v: k.startswith(prefix))
        nested = F.to_json(F.transform_keys(inner, lambda k, v: F.substring(k, F.length(prefix) + 1, F.length(k))))
        value = F.when(own.isNotNull(), json_string(own)).otherwise(nested)
        return F.concat(json_string(parent), F.lit(":"), value)

    return F.concat(F.lit("{"), F.concat_ws(",", F.transform(parents, one)), F.lit("}"))


def json_string(c: Column) -> Column:
    """A JSON string literal of the text."""
    wrapped = F.to_json(F.array(c))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)
