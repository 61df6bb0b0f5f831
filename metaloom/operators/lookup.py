"""Joins against vocabularies, gazetteers and label dictionaries.

Equi joins carry no hint: the optimizer broadcasts a dictionary below its size
threshold and falls back to a shuffle join with skew handling above it.
Containment and prefix matches work on blocks of the dictionary: a block is a
bounded array next to the text and the test runs inside the row. Containment in a
dictionary of very many blocks goes over an index of grams. No pair is emitted
that does not match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import bind
from ..session import written
from .containment import contained

BLOCK_ROWS = 2_000
BROADCAST_BLOCKS = 16
SALTS = 64


def known_codes(codes: DataFrame, vocab: DataFrame) -> DataFrame:
    """(…, feature, code) rows whose code exists, with uri and label."""
    return codes.join(vocab, ["feature", "code"])


def unknown_codes(codes: DataFrame, vocab: DataFrame) -> DataFrame:
    return codes.where(F.col("code") != "").join(vocab, ["feature", "code"], "left_anti")


def code_uri(base: Column, code: Column) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), code)


def place_uris(names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    return names.join(gazetteer, ["level", "name"])


def label_uris(labels: DataFrame, dims: DataFrame) -> DataFrame:
    """Case-folded label to uri within one dictionary kind."""
    folded = dims.select("kind", F.lower("label").alias("_l"), "uri")
    return (
        labels.withColumn("_l", F.lower("label")).join(folded, ["kind", "_l"]).drop("_l")
    )


def display_label(values: DataFrame, dims: DataFrame, segment: str) -> DataFrame:
    """Label of a uri segment, the segment itself split at camel case otherwise."""
    from ..functions.scalars import spaced_camel

    names = dims.select(F.col("code").alias(segment), F.col("label").alias("_label"))
    return (
        values.join(names, segment, "left")
        .withColumn("display", F.coalesce("_label", spaced_camel(F.col(segment))))
        .drop("_label")
    )


# ── dictionary blocks ────────────────────────────────────────────────────────

def block_count(dims: DataFrame) -> int:
    """Number of blocks; one small count decides it."""
    return max(1, -(-dims.count() // BLOCK_ROWS))


def with_blocks(texts: DataFrame, dims: DataFrame, columns: list[str], blocks: int, shape=None) -> DataFrame:
    """Each text next to each block of the dictionary as an ``entries`` array, or as
    what ``shape(entries)`` makes of it once per block.

    A usual dictionary is one block, delivered by an uncorrelated scalar subquery
    without any join. Up to BROADCAST_BLOCKS blocks (the count proves the size) are
    broadcast to an equi join. More are shuffled, salted so that no block becomes
    one task.
    """
    entries = F.collect_list(F.struct(*columns)).alias("entries")
    made = (shape(F.col("entries")) if shape else F.col("entries")).alias("entries")
    if blocks == 1:
        return texts.withColumn("entries", dims.agg(entries).select(made).scalar())
    key = F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int").alias("block")
    packed = dims.groupBy(key).agg(entries).select("block", made)
    spread = texts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if blocks <= BROADCAST_BLOCKS:
        return spread.join(F.broadcast(packed), "block").drop("block")
    salted = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    row = F.pmod(F.xxhash64(*texts.columns), F.lit(SALTS)).cast("int")
    return spread.withColumn("salt", row).join(salted, ["block", "salt"]).drop("block", "salt")


def words_of(label: Column, first: int | None = None) -> Column:
    words = F.filter(F.split(label, r"\s+"), lambda w: w != "")
    return F.slice(words, 1, first) if first else words


def indexed_labels(entries: Column) -> Column:
    """Distinct words of a block and its labels with the places of their words."""

    def labels(words: Column) -> Column:
        return F.transform(
            entries,
            lambda e: F.struct(
                e["ord"].alias("ord"), e["label"].alias("label"), e["uri"].alias("uri"),
                F.transform(e["words"], lambda w: (F.array_position(words, w) - 1).cast("int")).alias("places"),
            ),
        )

    distinct = F.array_distinct(F.flatten(F.transform(entries, lambda e: e["words"])))
    return bind(distinct, lambda words: F.struct(words.alias("words"), labels(words).alias("labels")))


def label_entry(e: Column) -> Column:
    return F.struct(e["ord"].alias("ord"), e["label"].alias("label"), e["uri"].alias("uri"))


def relevant_labels(
    texts: DataFrame, dims: DataFrame, key: str, text: str, mode: str = "any_word",
    first_words: int | None = None, fallback: DataFrame | None = None,
) -> DataFrame:
    """``(key, ord, label, uri)`` of the labels that a text mentions.

    ``any_word`` keeps a label when one of its words occurs anywhere in the text,
    ``whole`` when the complete label does: containment, not token equality. Each
    distinct word of a dictionary block is looked for once per text. Texts without
    any label get the rows of ``fallback``, a handful packed by a scalar subquery.
    """
    words = words_of(F.col("label"), first_words) if mode == "any_word" else F.array("label")
    entries = dims.select("ord", "label", "uri", words.alias("words"))
    lowered = texts.select(key, F.lower(text).alias("_t"))
    blocks = block_count(dims)
    if blocks > BROADCAST_BLOCKS:
        return indexed_hits(lowered, entries, key, fallback)
    met = with_blocks(lowered, entries, ["ord", "label", "uri", "words"], blocks, indexed_labels)
    # Which words occur, then which labels own one of them: places, not texts, are compared.
    occurs = bind(F.col("_t"), lambda body: F.transform("entries.words", lambda w: body.contains(w)))
    found = bind(
        occurs, lambda seen: F.filter("entries.labels", lambda e: F.exists(e["places"], lambda i: F.get(seen, i)))
    )
    # One row per block of a text; with one block the list is final already.
    lists = met.select(key, F.transform(found, label_entry).alias("hits"))
    if blocks > 1:
        lists = lists.groupBy(key).agg(F.flatten(F.collect_list("hits")).alias("hits"))
    hits = F.col("hits")
    if fallback is not None:
        packed = fallback.agg(F.array_sort(F.collect_list(F.struct("ord", "label", "uri"))).alias("p")).scalar()
        hits = F.when(F.size(hits) == 0, packed).otherwise(hits)
    # An outer generator: the inner one would have its size test pushed below this
    # projection and the matching done twice.
    return lists.select(key, F.inline_outer(hits)).where("ord is not null")


def indexed_hits(lowered: DataFrame, entries: DataFrame, key: str, fallback: DataFrame | None) -> DataFrame:
    """:func:`relevant_labels` over a gram index, for dictionaries of any size; keys are distinct."""
    names = entries.select("ord", "label", "uri", F.explode("words").alias("pattern")).distinct()
    pairs = contained(lowered.select(F.col(key).alias("id"), F.col("_t").alias("body")), names.select("pattern"))
    hits = pairs.join(names, "pattern").select(F.col("id").alias(key), "ord", "label", "uri").distinct()
    if fallback is None:
        return hits
    hits = written(hits, "hits")
    packed = fallback.agg(F.array_sort(F.collect_list(F.struct("ord", "label", "uri"))).alias("p")).scalar()
    rest = lowered.select(key).join(hits.select(key).distinct(), key, "left_anti")
    return hits.unionByName(rest.select(key, F.inline(packed)))


def first_entries(dims: DataFrame, n: int = 5) -> DataFrame:
    """The first rows of a dictionary in its own order."""
    return dims.orderBy("ord").limit(n)


def expand_hints(texts: DataFrame, hints: DataFrame, text: str) -> DataFrame:
    """Hints whose word occurs in the text: all of them and the first by order."""
    blocks = block_count(hints)
    if blocks > BROADCAST_BLOCKS:
        return indexed_hints(texts, hints, text)
    met = with_blocks(texts, hints.select("ord", "word", "hint"), ["ord", "word", "hint"], blocks)
    hits = bind(F.lower(F.col(text)), lambda body: F.filter("entries", lambda e: body.contains(e["word"])))
    keys = texts.columns
    per = met.withColumn("_h", F.array_sort(hits)).drop("entries").where((F.size("_h") > 0) | F.lit(blocks > 1))
    if blocks > 1:
        per = per.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("_h"))).alias("_h"))
    return per.where(F.size("_h") > 0).select(
        *keys,
        F.transform("_h", lambda e: e["hint"]).alias("hints"),
        F.try_element_at("_h", F.lit(1))["hint"].alias("first_hint"),
    )


def indexed_hints(texts: DataFrame, hints: DataFrame, text: str) -> DataFrame:
    """:func:`expand_hints` over a gram index; equal texts are looked at once, under their digest."""
    lowered = F.lower(F.col(text))
    keyed = texts.where(F.col(text).isNotNull()).withColumn("_id", F.sha2(lowered, 256))
    bodies = keyed.select(F.col("_id").alias("id"), lowered.alias("body")).dropDuplicates(["id"])
    pairs = contained(bodies, hints.select(F.col("word").alias("pattern"))).withColumnsRenamed({"id": "_id", "pattern": "word"})
    per = pairs.join(hints.select("ord", "word", "hint"), "word").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("ord", "word", "hint"))).alias("_h"))
    return keyed.join(per, "_id").select(
        *texts.columns, F.transform("_h", lambda e: e["hint"]).alias("hints"), F.try_element_at("_h", F.lit(1))["hint"].alias("first_hint")
    )


def help_entry(fields: DataFrame, guide: DataFrame, field: str = "field") -> DataFrame:
    """Guide entry of a field: exact name, else the first entry where either name
    is a prefix of the other, else nothing.

    ``guide(ord, name, label)``. Only fields without an exact entry take the
    prefix test, over distinct names.
    """
    names = fields.select(F.col(field).alias("_f")).distinct()
    exact = names.join(guide.select(F.col("name").alias("_f"), "label"), "_f", "left")
    rest = exact.where(F.col("label").isNull()).select("_f")
    met = with_blocks(rest, guide, ["ord", "name", "label"], block_count(guide))
    near = met.select(
        "_f",
        F.array_min(
            F.filter("entries", lambda e: F.col("_f").startswith(e["name"]) | e["name"].startswith(F.col("_f")))
        ).alias("e"),
    ).groupBy("_f").agg(F.min("e").alias("e"))
    resolved = exact.where(F.col("label").isNotNull()).unionByName(
        near.select("_f", F.col("e.label").alias("label"))
    )
    return fields.join(resolved.withColumnRenamed("_f", field), field, "left").withColumn(
        "label", F.coalesce("label", F.col(field))
    )
