"""XML datasets: record tag detection and flat string records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.dsl import quoted
from ..functions.text import bind
from ..session import written
from .files import list_files, open_stream, over_paths, reader

CHILDREN_SEEN = 5
OWN_TEXT = "_text"
# Mark of attributes while they are read; no element name can hold it.
ATTRIBUTE = "@"


def record_tags(files: DataFrame) -> DataFrame:
    """``(path, tag)``: the most frequent direct child of the root, first among equals.

    Decided once five children were seen, so only the beginning of a file is read, in
    pieces that are forgotten; paths are spread over the tasks. A file that declares
    entities is not read on.
    """

    def tag_of(path: str) -> str | None:
        from xml.parsers import expat

        counts: dict[str, int] = {}
        depth = 0

        class Enough(Exception):
            pass

        def start(name, _):
            nonlocal depth
            depth += 1
            if depth == 2:
                name = name.rpartition(":")[2]
                counts[name] = counts.get(name, 0) + 1
                if sum(counts.values()) >= CHILDREN_SEEN:
                    raise Enough

        def end(_):
            nonlocal depth
            depth -= 1

        def entity(*_):
            counts.clear()
            raise Enough

        parser = expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler, parser.EntityDeclHandler = start, end, entity
        with open_stream(path) as stream:
            try:
                while data := stream.read(65536):
                    parser.Parse(data, False)
            except (Enough, expat.ExpatError):
                pass
        return max(counts, key=counts.get) if counts else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "tag": [tag_of(p) for p in batch["path"]]})

    return over_paths(files).mapInPandas(read, "path string, tag string")


def tag_counts(docs: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, tag, n, first) of the opening tags in markup cells."""
    tags = docs.select(
        key, F.posexplode(F.regexp_extract_all(F.col(markup), F.lit(r"<([A-Za-z][A-Za-z0-9:_-]*)"), F.lit(1))).alias("pos", "tag")
    )
    return tags.withColumn("tag", F.regexp_replace("tag", "^.*:", "")).groupBy(key, "tag").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")
    )


def entries(col: Column, dtype: T.DataType, key: Column) -> Column:
    """(key, value) pairs of one element.

    Attributes and children sit under their name, a leaf that has only text under
    its own tag; the second and later elements of a tag get ``_1``, ``_2``, ….
    """
    pair = "array<struct<key:string,value:string>>"
    if isinstance(dtype, T.ArrayType):
        def each(x: Column, i: Column) -> Column:
            name = F.when(i == 0, key).otherwise(F.concat(key, F.lit("_"), i.cast("string")))
            return entries(x, dtype.elementType, name)

        return F.coalesce(F.flatten(F.transform(col, each)), F.array().cast(pair))
    if isinstance(dtype, T.StructType):
        others = [f for f in dtype.fields if f.name != OWN_TEXT]
        parts = [entries(col[f.name], f.dataType, F.concat(key, F.lit("." + f.name.removeprefix(ATTRIBUTE)))) for f in others]
        if OWN_TEXT in dtype.names:
            alone = F.forall(F.array(*[col[f.name].isNull() for f in others]), lambda b: b) if others else F.lit(True)
            name = F.when(alone, key).otherwise(F.concat(key, F.lit("." + OWN_TEXT)))
            parts.append(entries(col[OWN_TEXT], T.StringType(), name))
        return F.when(col.isNotNull(), F.concat(*parts)).otherwise(F.array().cast(pair))
    one = F.array(F.struct(key.alias("key"), F.trim(col.cast("string")).alias("value")))
    return F.when(col.isNotNull(), one).otherwise(F.array().cast(pair)).cast(pair)


def free_names(pairs: Column) -> Column:
    """The pairs with the next free ``_1``, ``_2``, … after names that are taken."""

    def named(done: Column, p: Column) -> Column:
        taken = F.transform(done, lambda d: d["key"])
        tries = F.transform(F.sequence(F.lit(1), F.size(done) + 1), lambda i: F.concat(p["key"], F.lit("_"), i.cast("string")))
        free = F.when(F.array_contains(taken, p["key"]), F.filter(tries, lambda t: ~F.array_contains(taken, t))[0]).otherwise(p["key"])
        return F.concat(done, F.array(F.struct(free.alias("key"), p["value"].alias("value"))))

    def build(p: Column) -> Column:
        plain = F.size(F.array_distinct(F.transform(p, lambda e: e["key"]))) == F.size(p)
        empty = F.array().cast("array<struct<key:string,value:string>>")
        return F.when(plain, p).otherwise(F.aggregate(p, empty, named))

    return bind(pairs, build)


def flatten_rows(rows: DataFrame) -> DataFrame:
    """One ``fields`` map per XML record; records without any cell are dropped."""
    parts = [entries(F.col(quoted(f.name)), f.dataType, F.lit(f.name.removeprefix(ATTRIBUTE))) for f in rows.schema.fields]
    return rows.select(F.map_from_entries(free_names(F.concat(*parts))).alias("fields")).where(F.size("fields") > 0)


@reader("xml")
def read_xml(spark: SparkSession, path: str, tag: str | None = None, **options) -> DataFrame:
    """``fields`` records of the elements with the record tag, namespaces ignored.

    Every file of a folder has its own tag; files that share one are one scan.
    Attributes are read under a mark, so they may bear the name of a child.
    """
    groups: list[tuple[str, str | list[str]]] = [(tag, path)] if tag else []
    if tag is None:
        tags = written(record_tags(list_files(spark, path)).where("tag is not null"), "tags")
        names = [r["tag"] for r in tags.select("tag").distinct().orderBy("tag").collect()]
        groups = [(n, path if len(names) == 1 else [r["path"] for r in tags.where(F.col("tag") == n).select("path").collect()]) for n in names]
    out = None
    for name, place in groups:
        rows = (
            spark.read.format("xml")
            .options(rowTag=name, ignoreNamespace=True, attributePrefix=ATTRIBUTE, valueTag=OWN_TEXT, inferSchema=False)
            .load(place)
        )
        if rows.columns:
            part = flatten_rows(rows)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "fields map<string,string>")
