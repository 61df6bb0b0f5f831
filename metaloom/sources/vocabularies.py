"""Vocabulary files, gazetteers, concept listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import strip

CONCEPT = "http://www.w3.org/2004/02/skos/core#Concept"

# Label predicates of a concept page, in reading order.
LABEL_TAGS = ["prefLabel", "definition", "description"]

NESTED = "map<string,map<string,string>>"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The ``;``-separated vocabulary registry with trimmed names and cells."""
    raw = spark.read.options(header=True, sep=";", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    return raw.select(*[strip(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns if c.strip()])


def text_list(v: Column) -> Column:
    """One text or a list of texts as a list."""
    items = F.try_variant_get(v, "$", "array<string>")
    return F.coalesce(items, F.when(v.isNotNull(), F.array(F.try_variant_get(v, "$", "string"))), F.array().cast("array<string>"))


def vocabulary_rows(docs: DataFrame, feature: str = "feature", text: str = "text") -> DataFrame:
    """``code -> entry`` documents to (feature, code, uri, labels, definitions, descriptions)."""
    codes = F.map_entries(F.try_variant_get(F.try_parse_json(F.col(text)), "$", "map<string,variant>"))
    rows = docs.select(F.col(feature).alias("feature"), F.inline(codes)).withColumn(
        "m", F.try_variant_get("value", "$", "map<string,variant>")
    )

    def at(name: str) -> Column:
        return F.try_element_at("m", F.lit(name))

    return rows.select(
        "feature", F.col("key").alias("code"), F.try_variant_get(at("uri"), "$", "string").alias("uri"),
        text_list(at("prefLabel")).alias("pref_label"), text_list(at("definition")).alias("definition"),
        text_list(at("description")).alias("description"),
    )


def gazetteer_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """``level -> name -> uri`` documents to (level, name, uri); a misspelt level name is mended."""
    levels = docs.select(F.explode(F.from_json(F.col(text), NESTED)).alias("level", "names"))
    rows = levels.select("level", F.explode("names").alias("name", "uri"))
    return rows.withColumn("level", F.when(F.col("level") == "contients", "continents").otherwise(F.col("level")))


def skos_concepts(descriptions: DataFrame) -> DataFrame:
    """Concepts of RDF descriptions ``(about, types, labels)``.

    ``labels`` is ``array<struct<tag,lang,text>>``. A concept has a ``#`` in its uri,
    the concept type and an English preferred label; the definition is optional.
    """

    def english(tag: str) -> Column:
        hit = F.filter("labels", lambda x: (x["tag"] == tag) & (x["lang"] == "en") & (F.length(x["text"]) > 0))
        return strip(F.try_element_at(hit, F.lit(1))["text"])

    rows = descriptions.where(F.col("about").contains("#") & F.array_contains("types", CONCEPT)).select(
        F.element_at(F.split("about", "#"), -1).alias("code"), F.col("about").alias("uri"),
        english("prefLabel").alias("pref_label"), english("definition").alias("definition"),
    )
    return rows.where(F.length("pref_label") > 0)


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """``(about, types, labels)`` of the ``Description`` elements of RDF/XML files."""
    literal = "array<struct<_text:string,lang:string>>"
    resource = "array<struct<resource:string>>"
    raw = (
        spark.read.format("xml")
        .schema(f"about string, type {resource}, prefLabel {literal}, definition {literal}, description {literal}")
        .options(rowTag="Description", ignoreNamespace=True, attributePrefix="", valueTag="_text")
        .load(path)
    )
    labels = F.flatten(F.array(*[_labels(tag, literal) for tag in LABEL_TAGS]))
    types = F.transform(F.coalesce(F.col("type"), F.array().cast(resource)), lambda x: x["resource"])
    return raw.select("about", types.alias("types"), labels.alias("labels"))


def _labels(tag: str, literal: str) -> Column:
    return F.transform(
        F.coalesce(F.col(tag), F.array().cast(literal)),
        lambda x: F.struct(F.lit(tag).alias("tag"), x["lang"].alias("lang"), x["_text"].alias("text")),
    )


def concept_uris(about: DataFrame, base: str) -> DataFrame:
    """Distinct uris directly below a base."""
    prefix = base.rstrip("/") + "/"
    tail = F.substring(F.col("about"), len(prefix) + 1, 1 << 30)
    return about.where(F.col("about").startswith(prefix) & ~tail.contains("/")).select("about").distinct()


def english_fields(descriptions: DataFrame) -> DataFrame:
    """English texts per predicate; a text counts for the first predicate that has it."""

    def texts(tag: str) -> Column:
        hit = F.filter("labels", lambda x: (x["tag"] == tag) & (x["lang"] == "en") & (F.length(strip(x["text"])) > 0))
        return F.transform(hit, lambda x: strip(x["text"]))

    seen = F.array().cast("array<string>")
    cols = []
    for tag in LABEL_TAGS:
        own = texts(tag)
        cols.append(F.filter(own, _not_in(seen)).alias(tag))
        seen = F.concat(seen, own)
    return descriptions.select("about", *cols)


def _not_in(seen: Column):
    return lambda v: ~F.array_contains(seen, v)
