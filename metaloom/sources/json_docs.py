"""JSON documents and line-delimited JSON to flat records.

A document whose records are nested somewhere inside is searched within its own
row: a fold over the levels scores every list and object, the best one is opened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import bind
from ..session import written
from ..operators.shape import VARIANT_MAP, as_map, flatten_entries, flatten_object, nesting, variant_text
from .files import file_heads, list_files, reader
from .json_stream import RANGE_BYTES, read_documents, read_items

SNIFF_CHARS = 1024


def lenient(df: DataFrame) -> DataFrame:
    """The rows, in a session whose parser keeps the last of repeated keys."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return df


def without_bom(c: Column) -> Column:
    return F.regexp_replace(c, "^﻿", "")


def json_layout(text: Column) -> Column:
    """``array``, ``lines`` or ``object`` from the beginning of a document."""
    start = F.regexp_extract(without_bom(text), r"^[ \t\r\n]*(.)", 1)
    head = F.substring(without_bom(text), 1, SNIFF_CHARS)
    return (
        F.when(start == "[", "array")
        .when((start == "{") & ~head.contains("\n{"), "object")
        .otherwise("lines")
    )


def as_items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", VARIANT_MAP)


def item_record(item: Column, raw: Column | None = None) -> Column:
    """Flat fields of a list item; a scalar becomes ``{"value": text}``."""
    plain = F.create_map(F.lit("value"), F.coalesce(variant_text(item), F.lit("None")))
    return F.coalesce(flatten_object(item, raw), plain)


def array_records(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fields)`` of root arrays in cells, every item kept."""
    raw = without_bom(F.col(text))
    items = lenient(docs).select(key, F.try_parse_json(raw).alias("doc"), raw.alias("raw"))
    members = F.arrays_zip(as_items(F.col("doc")).alias("item"), raw_items(F.col("doc"), F.col("raw")).alias("raw"))
    return items.select(key, F.inline(members)).select(key, item_record(F.col("item"), F.col("raw")).alias("fields"))


def raw_items(doc: Column, raw: Column) -> Column:
    """Texts of the items of a list, where their written order can matter; else nulls."""
    needed = F.schema_of_variant(doc).rlike(r"ARRAY<OBJECT<.*ARRAY<OBJECT<") | F.schema_of_variant(doc).rlike(r"ARRAY<VARIANT>")
    nothing = F.transform(as_items(doc), lambda i: F.lit(None).cast("string"))
    return F.when(needed, F.from_json(raw, "array<string>")).otherwise(nothing)


def line_records(lines: DataFrame, key: str | None = None, text: str = "value") -> DataFrame:
    """Objects of line-delimited JSON; blank, broken and non-object lines are skipped."""
    keep = [key] if key else []
    raw = without_bom(F.col(text))
    parsed = lenient(lines).select(*keep, F.try_parse_json(raw).alias("v"), raw.alias("raw"))
    return parsed.where(as_fields(F.col("v")).isNotNull()).select(*keep, flatten_object(F.col("v"), F.col("raw")).alias("fields"))


# ── search for the record set ────────────────────────────────────────────────

CANDIDATE_NODE = "struct<key:string,pos:int,value:variant,raw:string>"


def ordered_children(v: Column, raw: Column) -> Column:
    """Children of a node in document order.

    A variant sorts object keys; the raw text of the node keeps the written order.
    """
    def read(n: Column) -> Column:
        # The raw text is parsed as what the node is; the other reading would only fail.
        named = n["fields"].isNotNull()
        return F.struct(
            n["fields"].alias("fields"), n["items"].alias("items"),
            F.when(named, F.json_object_keys(raw)).alias("keys"),
            F.when(named, F.from_json(raw, "map<string,string>")).alias("raw_fields"),
            F.when(~named, F.from_json(raw, "array<string>")).alias("raw_items"),
        )

    def children(p: Column) -> Column:
        of_object = F.transform(
            p["keys"],
            lambda k, i: F.struct(
                k.alias("key"), i.cast("int").alias("pos"), F.try_element_at(p["fields"], k).alias("value"),
                F.try_element_at(p["raw_fields"], k).alias("raw"),
            ),
        )
        of_list = F.transform(
            p["items"],
            lambda x, i: F.struct(
                F.lit(None).cast("string").alias("key"), i.cast("int").alias("pos"), x.alias("value"),
                F.try_element_at(p["raw_items"], i.cast("int") + 1).alias("raw"),
            ),
        )
        return F.when(p["fields"].isNotNull(), of_object).otherwise(of_list).cast(f"array<{CANDIDATE_NODE}>")

    node = F.struct(as_fields(v).alias("fields"), as_items(v).alias("items"))
    return bind(bind(node, read), children)


def is_container(v: Column) -> Column:
    return as_fields(v).isNotNull() | as_items(v).isNotNull()


def may_hold_records(v: Column) -> Column:
    """False where neither a node nor anything below it can be a record set, told by its type.

    A list among them has lists or objects for items; a keyed collection is an object with two
    objects in it. Names of keys that look like types only cost a search in vain.
    """
    return bind(
        F.schema_of_variant(v),
        lambda kind: kind.rlike("ARRAY<(?:OBJECT|ARRAY|VARIANT)") | (kind.contains(",") & (F.size(F.split(kind, "OBJECT<")) > 3)),
    )


def candidate(v: Column, skip_numeric: bool) -> Column:
    """Kind and score of a node, NULL when it is no record set."""

    def sized(members: Column, sizes: Column) -> Column:
        """Number of members times their mean size."""
        total = F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
        return F.size(members) * (total / F.size(members))

    def scored(kind: str, score: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), score.cast("double").alias("score"))

    def judge(n: Column) -> Column:
        all_maps = F.forall(n["maps"], lambda m: m.isNotNull())
        all_rows = F.forall(n["rows"], lambda r: r.isNotNull())
        key_sets = F.transform(n["maps"], lambda m: F.array_sort(F.map_keys(m)))
        many = F.size(n["maps"])
        if skip_numeric:
            all_rows = all_rows & ~n["numeric"]
        return (
            F.when(
                n["is_object"] & (many >= 2) & all_maps & (F.size(F.array_distinct(key_sets)) == 1),
                scored("keyed", many * F.size(n["maps"][0])),
            )
            .when(n["is_object"] | (many == 0), F.lit(None).cast("struct<kind:string,score:double>"))
            .when(all_maps, scored("objects", sized(n["maps"], F.transform(n["maps"], lambda m: F.size(m)))))
            .when(all_rows, scored("lists", sized(n["rows"], F.transform(n["rows"], lambda r: F.size(r)))))
        )

    def opened(node: Column) -> Column:
        parts = [
            node["fields"].isNotNull().alias("is_object"),
            F.transform(node["members"], as_fields).alias("maps"),
            F.transform(node["members"], as_items).alias("rows"),
        ]
        if skip_numeric:
            number_list = r"^ARRAY<(BIGINT|DOUBLE|DECIMAL\(.*\))>$"
            parts.append(
                F.forall(node["members"], lambda m: F.schema_of_variant(m).rlike(number_list)).alias("numeric")
            )
        return bind(F.struct(*parts), judge)

    fields = as_fields(v)
    return bind(
        F.struct(fields.alias("fields"), F.coalesce(as_items(v), F.map_values(fields)).alias("members")), opened
    )


PATH = "array<struct<key:string,pos:int>>"
FOUND = f"array<struct<path:{PATH},place:string,kind:string,score:double>>"
FRONTIER = f"array<struct<v:variant,raw:string,path:{PATH}>>"


def search(v: Column, raw: Column, depth: int | None = None, skip_numeric: bool = False) -> Column:
    """Every record set of a document (down to ``depth``, if given), found inside its row.

    A fold over the levels carries the containers of one level and the record sets
    met so far, so a document is walked once and nothing is shuffled. Containers whose type rules
    out a record set are not opened. ``place`` is the position path in fixed width: its
    text order is document order.
    """

    def opened(children: Column) -> Column:
        # the type of an only child is as long as its parent's: it is opened rather than typed
        return F.when(F.size(children) == 1, F.filter(children, lambda c: is_container(c["value"]))).otherwise(
            F.filter(children, lambda c: may_hold_records(c["value"]))
        )

    def below(n: Column) -> Column:
        return F.transform(
            bind(ordered_children(n["v"], n["raw"]), opened),
            lambda c: F.struct(
                c["value"].alias("v"), c["raw"].alias("raw"),
                F.concat(n["path"], F.array(F.struct(c["key"].alias("key"), c["pos"].alias("pos")))).alias("path"),
            ),
        )

    def judged(n: Column) -> Column:
        place = F.array_join(F.transform(n["path"], lambda s: F.lpad(s["pos"].cast("string"), 10, "0")), ".")
        return bind(
            candidate(n["v"], skip_numeric),
            lambda c: F.when(
                c.isNotNull(),
                F.struct(n["path"].alias("path"), place.alias("place"), c["kind"].alias("kind"), c["score"].alias("score")),
            ),
        )

    def level(acc: Column, _: Column) -> Column:
        hits = F.filter(F.transform(acc["frontier"], judged), lambda h: h.isNotNull())
        deeper = F.struct(
            F.flatten(F.transform(acc["frontier"], below)).cast(FRONTIER).alias("frontier"),
            F.concat(acc["found"], hits.cast(FOUND)).alias("found"),
        )
        return F.when(F.size(acc["frontier"]) > 0, deeper).otherwise(acc)

    root = F.struct(v.alias("v"), raw.alias("raw"), F.array().cast(PATH).alias("path"))
    start = F.struct(
        F.when(may_hold_records(v), F.array(root)).otherwise(F.array()).cast(FRONTIER).alias("frontier"),
        F.array().cast(FOUND).alias("found"),
    )
    levels = F.lit(depth) if depth is not None else nesting(v)
    return F.aggregate(F.sequence(F.lit(0), levels), start, level)["found"]


def parsed(docs: DataFrame, key: str, text: str) -> DataFrame:
    clean = without_bom(F.col(text))
    return lenient(docs).select(key, F.try_parse_json(clean).alias("v"), clean.alias("raw"))


def candidates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int | None = None, skip_numeric: bool = False
) -> DataFrame:
    """``(key, path, place, kind, score)`` of every record set of each document."""
    rows = parsed(docs, key, text)
    return rows.select(key, F.inline(search(F.col("v"), F.col("raw"), depth, skip_numeric)))


def best_candidate(found: Column) -> Column:
    """Highest score, first in document order among equals."""
    ranked = F.transform(
        found, lambda c: F.struct((-c["score"]).alias("s"), c["place"].alias("place"), c["kind"].alias("kind"), c["path"].alias("path"))
    )
    return F.array_min(ranked)


def child_at(node: Column, s: Column) -> Column:
    """Child of a node at one step."""
    return F.when(
        s["key"].isNotNull(), F.try_element_at(as_fields(node), s["key"])
    ).otherwise(F.try_element_at(as_items(node), s["pos"] + 1))


def node_at(v: Column, path: Column) -> Column:
    """Node of a document at a path of steps."""
    return F.aggregate(path, v, child_at)


def raw_at(raw: Column, path: Column) -> Column:
    """Raw text of a node; keeps the written order of keys."""

    def down(text: Column, s: Column) -> Column:
        return F.when(
            s["key"].isNotNull(), F.try_element_at(F.from_json(text, "map<string,string>"), s["key"])
        ).otherwise(F.try_element_at(F.from_json(text, "array<string>"), s["pos"] + 1))

    return F.aggregate(path, raw, down)


def header_names(parent: Column, parent_raw: Column, own_key: Column, width: Column) -> Column:
    """Names for the cells of list rows: the first sibling list of the same length
    whose items are texts or objects with an id, name, key or label."""

    def name(item: Column) -> Column:
        m = as_fields(item)
        text = F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string"))
        given = [F.nullif(F.try_variant_get(F.try_element_at(m, F.lit(k)), "$", "string"), F.lit("")) for k in ("id", "name", "key", "label")]
        return F.coalesce(text, *given)

    def first_fit(fields: Column) -> Column:
        siblings = F.filter(F.json_object_keys(parent_raw), lambda k: k != own_key)
        names = F.transform(siblings, lambda k: F.transform(as_items(F.try_element_at(fields, k)), name))
        fits = F.filter(
            names, lambda n: n.isNotNull() & (F.size(n) == width) & F.forall(n, lambda one: one.isNotNull())
        )
        return F.try_element_at(fits, F.lit(1))

    return bind(as_fields(parent), first_fit)


def list_rows(node: Column, headers: Column) -> Column:
    """Rows of a list of lists as objects; cells beyond the header are numbered."""
    depth = nesting(node)

    def row(r: Column) -> Column:
        cells = as_items(r)
        named = F.transform(
            cells,
            lambda c, i: F.struct(
                F.coalesce(F.try_element_at(headers, i.cast("int") + 1), F.concat(F.lit("column_"), i.cast("string"))).alias("key"),
                c.alias("value"),
            ),
        )
        return as_map(flatten_entries(named, depth))

    return F.transform(as_items(node), row)


def keyed_rows(node: Column) -> Column:
    """Members of a keyed collection with their key in ``_key``."""

    def row(e: Column) -> Column:
        return F.map_concat(F.create_map(F.lit("_key"), e["key"]), F.map_filter(flatten_object(e["value"]), lambda k, v: k != "_key"))

    return F.transform(F.map_entries(as_fields(node)), row)


def unwrap(
    docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int | None = None, skip_numeric: bool = False
) -> DataFrame:
    """``(key, fields)`` records of wrapped documents, in one pass without a shuffle.

    Documents without a record set are one record themselves.
    """
    rows = parsed(docs, key, text).where(as_fields(F.col("v")).isNotNull())
    chosen = rows.withColumn("best", best_candidate(search(F.col("v"), F.col("raw"), depth, skip_numeric)))
    path = F.coalesce(F.col("best.path"), F.array().cast(PATH))
    # one walk to the parent, one step from there; every later expression reads the columns
    above = chosen.select(
        key, F.col("best.kind").alias("kind"), path.alias("_path"), F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))).alias("up"),
        F.try_element_at(path, F.lit(-1)).alias("step"), "v", "raw",
    ).withColumn("parent", node_at(F.col("v"), F.col("up")))
    found = above.withColumn("node", F.when(F.col("step").isNull(), F.col("parent")).otherwise(child_at(F.col("parent"), F.col("step"))))
    located = found.select(
        key, "kind", F.col("step")["key"].alias("own"), "node", "parent", "raw",
        F.when(F.col("kind") == "lists", raw_at(F.col("raw"), F.col("up"))).alias("parent_raw"),
        F.when(F.col("kind") == "objects", raw_items(F.col("node"), raw_at(F.col("raw"), F.col("_path")))).alias("raws"),
    )
    node = F.col("node")
    width = F.size(as_items(as_items(node)[0]))
    headers = header_names(F.col("parent"), F.col("parent_raw"), F.col("own"), width)
    records = (
        F.when(F.col("kind") == "objects", F.transform(F.arrays_zip(as_items(node).alias("x"), F.col("raws").alias("raw")), lambda m: flatten_object(m["x"], m["raw"])))
        .when(F.col("kind") == "keyed", keyed_rows(node))
        .when(F.col("kind") == "lists", bind(headers, lambda names: list_rows(node, names)))
        .otherwise(F.array(flatten_object(node, F.col("raw"))))
    )
    return located.select(key, F.explode(records).alias("fields"))


def document_records(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Records of a table of JSON texts of any layout."""
    laid = docs.withColumn("_layout", json_layout(F.col(text)))
    lines = laid.where("_layout = 'lines'").select(key, F.explode(F.split(F.col(text), r"\r?\n")).alias("value"))
    return (
        array_records(laid.where("_layout = 'array'"), key, text)
        .unionByName(line_records(lines, key))
        .unionByName(unwrap(laid.where("_layout = 'object'").select(key, text), key, text))
    )


@reader("json")
def read_json(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, **options) -> DataFrame:
    """``(path, position, fields, error)`` records of one JSON dataset, a file or a folder.

    Every file is read by its own layout. Line-delimited files are split over tasks
    and skip lines that hold no object; arrays are split into ranges of ``range_bytes``
    at the commas of their root, so neither their size nor a broken item costs the others.
    What cannot be read is a row with an error and without fields.
    """
    files = list_files(spark, path)
    layouts = file_heads(files).select("path", json_layout(F.make_valid_utf8(F.col("head").cast("string"))).alias("layout"))
    layouts = written(layouts, "layouts")
    kinds = {r["layout"] for r in layouts.select("layout").distinct().collect()}
    nothing = F.lit(None)
    parts = []
    if "lines" in kinds:
        place = path if kinds == {"lines"} else [r["path"] for r in layouts.where("layout = 'lines'").select("path").collect()]
        lines = spark.read.text(place).select(F.col("_metadata.file_path").alias("path"), "value")
        parts.append(line_records(lines, "path").select("path", nothing.cast("bigint").alias("position"), "fields", nothing.cast("string").alias("error")))
    if "array" in kinds:
        items = lenient(read_items(files.join(layouts.where("layout = 'array'"), "path"), range_bytes)).withColumn("doc", F.try_parse_json("item"))
        error = F.coalesce("error", F.when(F.col("doc").isNull(), "the item is no JSON"))
        fields = F.when(F.col("doc").isNotNull(), item_record(F.col("doc"), F.col("item")))
        parts.append(items.select("path", "position", fields.alias("fields"), error.alias("error")))
    if "object" in kinds:
        docs = read_documents(layouts.where("layout = 'object'")).withColumnRenamed("item", "text")
        broken = F.coalesce("error", F.when(F.try_parse_json(without_bom(F.col("text"))).isNull(), "the document is no JSON"))
        docs = lenient(docs).withColumn("error", broken)
        good = unwrap(docs.where("error is null").select("path", "text"), "path", **options)
        parts.append(good.select("path", nothing.cast("bigint").alias("position"), "fields", nothing.cast("string").alias("error")))
        parts.append(docs.where("error is not null").select("path", "position", nothing.cast("map<string,string>").alias("fields"), "error"))
    if not parts:
        return spark.createDataFrame([], "path string, position bigint, fields map<string,string>, error string")
    return reduce(lambda a, b: a.unionByName(b), parts)


def import_payload(text: Column) -> Column:
    """Record of a saved session: below ``metadata``, below ``data`` or the root itself."""
    doc = F.try_parse_json(without_bom(text))
    fields = as_fields(doc)

    def inner(name: str) -> Column:
        v = F.try_element_at(fields, F.lit(name))
        return F.when(as_fields(v).isNotNull(), v)

    return F.coalesce(inner("metadata"), inner("data"), doc)


def payload_fields(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, field, value)`` rows of saved records, value as JSON, empties left out."""
    entries = F.map_entries(as_fields(import_payload(F.col(text))))
    rows = docs.select(key, F.inline(entries)).select(key, F.col("key").alias("field"), F.to_json("value").alias("value"))
    return rows.where(~F.col("value").isin("null", '""', "[]"))


def override_fields(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Prefilled values of inline JSON; text that is no object gives nothing."""
    entries = F.map_entries(as_fields(F.try_parse_json(F.col(text))))
    return docs.select(key, F.inline(entries)).select(key, F.col("key").alias("field"), F.to_json("value").alias("value"))
