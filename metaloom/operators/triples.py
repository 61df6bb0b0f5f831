"""Records as RDF triples and back, and their N-Triples text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

DCAT = "http://www.w3.org/ns/dcat#"
DCT = "http://purl.org/dc/terms/"
HEALTH = "https://healthdcat-ap.eu/ns#"
VCARD = "http://www.w3.org/2006/vcard/ns#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD_DATE = "http://www.w3.org/2001/XMLSchema#date"
FOAF_NAME = "http://xmlns.com/foaf/0.1/name"

# Record field -> (predicate, language of its literals).
SCALARS = {
    "title": (DCT + "title", "es"),
    "notes": (DCT + "description", "es"),
    "identifier": (DCT + "identifier", None),
    "provenance": (DCT + "provenance", "es"),
    "version": (DCAT + "version", None),
    "version_notes": (DCAT + "versionNotes", "es"),
    "legal_basis": (DCT + "license", None),
    "retention_period": (HEALTH + "retentionPeriod", "es"),
    "publisher_note": (HEALTH + "publisherNote", "es"),
    "temporal_resolution": (DCAT + "temporalResolution", None),
    "spatial_resolution_in_meters": (DCAT + "spatialResolutionInMeters", None),
    "number_of_records": (HEALTH + "numberOfRecords", None),
    "number_of_unique_individuals": (HEALTH + "numberOfUniqueIndividuals", None),
    "min_typical_age": (HEALTH + "minTypicalAge", None),
    "max_typical_age": (HEALTH + "maxTypicalAge", None),
    "issued": (DCT + "issued", None),
    "modified": (DCT + "modified", None),
    "url": (DCAT + "landingPage", None),
    "documentation": (DCAT + "qualifiedRelation", None),
    "frequency": (DCT + "accrualPeriodicity", None),
    "dcat_type": (DCT + "type", None),
    "access_rights": (DCT + "rights", None),
}
URI_LISTS = {
    "theme": DCAT + "theme",
    "health_category": HEALTH + "healthCategory",
    "health_theme": HEALTH + "healthTheme",
    "personal_data": HEALTH + "personalData",
    "language": DCT + "language",
    "spatial": DCT + "spatial",
    "conforms_to": DCT + "conformsTo",
    "related_resource": DCT + "relation",
    "is_referenced_by": DCT + "isReferencedBy",
    "has_version": DCT + "hasVersion",
    "was_generated_by": HEALTH + "wasGeneratedBy",
}
LITERAL_LISTS = {
    "keyword": (DCAT + "keyword", "es"),
    "purpose": (HEALTH + "purpose", "es"),
    "population_coverage": (HEALTH + "populationCoverage", "es"),
    "coding_system": (HEALTH + "codingSystem", None),
    "code_values": (HEALTH + "codeValues", None),
    "alternate_identifier": (DCT + "identifier", None),
}

# Predicates read back into fields; those of the writer that are absent
# here or not in LIST_FIELDS are scalars or dropped.
IMPORT_ONLY = {
    DCT + "publisher": "publisher",
    DCT + "creator": "creator",
    DCT + "temporal": "temporal_coverage",
    DCAT + "contactPoint": "contact",
    HEALTH + "hdab": "hdab",
    HEALTH + "qualifiedAttribution": "qualified_attribution",
}
NOT_IMPORTED = ["version_notes", "documentation", "alternate_identifier"]
LIST_FIELDS = [
    "language", "theme", "health_category", "health_theme", "personal_data", "keyword",
    "spatial", "conforms_to", "related_resource", "is_referenced_by", "has_version",
    "purpose", "population_coverage", "coding_system", "code_values", "was_generated_by",
]

TRIPLE = "struct<s:string,p:string,o:string,o_kind:string,lang:string,datatype:string>"
CATALOGUE_BASE = "https://catalogue.example.org/dataset/"


def dataset_uri(df: DataFrame, key: str, base: str = CATALOGUE_BASE) -> Column:
    """Identifier, else url, else a generated uri."""
    named = [F.nullif(F.col(c), F.lit("")) for c in ("identifier", "url") if c in df.columns]
    return F.coalesce(*named, F.concat(F.lit(base), F.url_encode(F.col(key).cast("string"))))


def triple(s: Column, p: str | Column, o: Column, kind: str | Column, lang=None, datatype=None) -> Column:
    text = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return F.struct(
        s.alias("s"), text(p).alias("p"), o.alias("o"), text(kind).alias("o_kind"),
        text(lang).alias("lang"), text(datatype).alias("datatype"),
    )


def value_triple(s: Column, p: str, value: Column, lang: str | None) -> Column:
    """A uri node for http texts, else a literal; language tags stay off uris."""
    is_uri = value.startswith("http")
    return triple(
        s, p, value, F.when(is_uri, "uri").otherwise("literal"),
        F.when(~is_uri, F.lit(lang).cast("string")),
    )


def blank(s: Column, *parts) -> Column:
    """Blank node id that depends only on its place, so a re-run writes the same text."""
    return F.concat(F.lit("_:b"), F.md5(F.concat_ws("|", s, *[p if isinstance(p, Column) else F.lit(p) for p in parts])))


def _as_list(df: DataFrame, field: str) -> Column:
    dtype = df.schema[field].dataType
    if isinstance(dtype, T.ArrayType):
        return F.col(field).cast("array<string>")
    return F.array(F.col(field).cast("string"))


def _non_empty(values: Column) -> Column:
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))


def _struct_field(df: DataFrame, field: str, sub: str) -> Column:
    names = df.schema[field].dataType.names if isinstance(df.schema[field].dataType, T.StructType) else []
    return F.nullif(F.col(field)[sub].cast("string"), F.lit("")) if sub in names else F.lit(None).cast("string")


def _only(condition: Column, *triples: Column) -> Column:
    return F.when(condition, F.array(*triples)).otherwise(F.array().cast(f"array<{TRIPLE}>"))


def _uri_item(s: Column, p: str):
    return lambda v: value_triple(s, p, v, None)


def _literal_item(s: Column, p: str, lang: str | None):
    return lambda v: triple(s, p, v, "literal", lang)


def record_triples(df: DataFrame, key: str, base: str = CATALOGUE_BASE) -> DataFrame:
    """Triples of wide records, one row per record in, no shuffle.

    Any subset of the known fields may be present as columns: texts, numbers,
    arrays, structs. Repeated triples of a record collapse, as in a graph.
    """
    s = dataset_uri(df, key, base)
    groups = [F.array(triple(s, RDF_TYPE, F.lit(DCAT + "Dataset"), "uri"))]
    for field, (p, lang) in SCALARS.items():
        if field in df.columns:
            value = F.nullif(F.col(field).cast("string"), F.lit(""))
            groups.append(_only(value.isNotNull(), value_triple(s, p, value, lang)))
    for field, p in URI_LISTS.items():
        if field in df.columns:
            groups.append(F.transform(_non_empty(_as_list(df, field)), _uri_item(s, p)))
    for field, (p, lang) in LITERAL_LISTS.items():
        if field in df.columns:
            groups.append(F.transform(_non_empty(_as_list(df, field)), _literal_item(s, p, lang)))
    groups += nested_triples(df, s)
    flat = F.array_distinct(F.flatten(F.array(*[g.cast(f"array<{TRIPLE}>") for g in groups])))
    return df.select(F.inline(flat))


def nested_triples(df: DataFrame, s: Column) -> list[Column]:
    """Period, contact, publisher, creator, legislation and distribution nodes."""
    out = []
    if "temporal_coverage" in df.columns:
        node = blank(s, "period")
        start, end = (_struct_field(df, "temporal_coverage", k) for k in ("start", "end"))
        present = F.col("temporal_coverage").isNotNull()
        out.append(_only(present, triple(s, DCT + "temporal", node, "blank")))
        out.append(_only(present & start.isNotNull(), triple(node, DCAT + "startDate", start, "literal", None, XSD_DATE)))
        out.append(_only(present & end.isNotNull(), triple(node, DCAT + "endDate", end, "literal", None, XSD_DATE)))
    if "contact" in df.columns:
        node = blank(s, "contact")
        email, url = _struct_field(df, "contact", "email"), _struct_field(df, "contact", "url")
        present = F.col("contact").isNotNull()
        out.append(_only(present, triple(s, DCAT + "contactPoint", node, "blank"), triple(node, RDF_TYPE, F.lit(VCARD + "Kind"), "uri")))
        out.append(_only(present & email.isNotNull(), triple(node, VCARD + "hasEmail", F.concat(F.lit("mailto:"), email), "uri")))
        out.append(_only(present & url.isNotNull(), triple(node, VCARD + "hasURL", url, "uri")))
    for field, p in (("publisher", DCT + "publisher"), ("creator", DCT + "creator")):
        if field in df.columns:
            node = blank(s, field)
            name, kind, email = (_struct_field(df, field, k) for k in ("name", "type", "email"))
            named = name.isNotNull()
            out.append(_only(named, triple(s, p, node, "blank"), triple(node, FOAF_NAME, name, "literal")))
            out.append(_only(named & F.coalesce(kind.startswith("http"), F.lit(False)), triple(node, DCT + "type", kind, "uri")))
            out.append(_only(named & email.isNotNull(), triple(node, VCARD + "hasEmail", F.concat(F.lit("mailto:"), email), "uri")))
    if "applicable_legislation" in df.columns:
        element = df.schema["applicable_legislation"].dataType.elementType
        if isinstance(element, T.StructType):
            uris = F.transform("applicable_legislation", lambda e: e["uri"])
            kept = _non_empty(uris)
        else:
            kept = F.filter(_non_empty(F.col("applicable_legislation")), lambda u: u.startswith("http"))
        out.append(F.transform(kept, lambda u: triple(s, DCT + "isPartOf", u, "uri")))
    if "distribution" in df.columns:
        urls = _non_empty(F.transform("distribution", lambda d: d["access_url"]))

        def dist(u: Column, i: Column) -> Column:
            node = blank(s, "distribution", i.cast("string"))
            return F.array(
                triple(s, DCAT + "distribution", node, "blank"),
                triple(node, RDF_TYPE, F.lit(DCAT + "Distribution"), "uri"),
                triple(node, DCAT + "accessURL", u, "uri"),
            )

        out.append(F.flatten(F.transform(urls, dist)))
    return out


def predicate_fields() -> dict[str, str]:
    """Predicate to record field for reading triples back."""
    known = {p: f for f, (p, _) in {**LITERAL_LISTS, **SCALARS}.items() if f not in NOT_IMPORTED}
    known.update({p: f for f, p in URI_LISTS.items()})
    return {**known, **IMPORT_ONLY}


def triples_to_fields(triples: DataFrame, order: str | None = None) -> DataFrame:
    """(s, field, value) of the known predicates: list fields keep their distinct
    values as rows, scalar fields the first non-empty one.

    ``order`` names the column that says what comes first; without it the smallest
    value is taken, which does not depend on partitioning.
    """
    table = F.create_map(*[F.lit(x) for pair in predicate_fields().items() for x in pair])
    known = triples.withColumn("field", F.try_element_at(table, F.col("p"))).where("field is not null")
    is_list = F.col("field").isin(LIST_FIELDS)
    rank = F.col(order) if order else F.col("o")
    grouped = known.groupBy("s", "field").agg(
        F.collect_set(F.when(is_list, F.col("o"))).alias("many"),
        F.min_by("o", F.when(~is_list & (F.col("o") != ""), rank)).alias("one"),
    )
    # a list field holds what one record says, so it fits into a row
    return grouped.select("s", "field", F.explode(F.when(is_list, F.col("many")).otherwise(F.array("one"))).alias("value"))


# ── N-Triples text ───────────────────────────────────────────────────────────

def escape_literal(c: Column) -> Column:
    for plain, coded in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


# Escapes of one character.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_PIECES = r"(?s)(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"


def unescape_literal(c: Column) -> Column:
    """Text of an escaped literal; texts without a backslash are left as they are.

    Runs of ``\\u`` escapes are decoded together, as two of them can be one character.
    """
    plain = F.create_map(*[F.lit(x) for k, v in ESCAPES.items() for x in ("\\" + k, v)])

    def one(piece: Column) -> Column:
        short = F.decode(F.unhex(F.replace(piece, F.lit("\\u"), F.lit(""))), "UTF-16BE")
        long_ = F.decode(F.unhex(F.substring(piece, 3, 8)), "UTF-32")
        return (
            F.when(piece.rlike(r"^\\u[0-9A-Fa-f]{4}"), short).when(piece.rlike(r"^\\U[0-9A-Fa-f]{8}$"), long_)
            .when(piece.startswith("\\"), F.coalesce(F.try_element_at(plain, piece), piece)).otherwise(piece)
        )

    pieces = F.regexp_extract_all(c, F.lit(_PIECES), F.lit(0))
    return F.when(c.contains("\\"), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def _node(c: Column) -> Column:
    return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def ntriples(triples: DataFrame) -> DataFrame:
    """One N-Triples line per triple, also valid Turtle."""
    tail = F.coalesce(
        F.concat(F.lit("@"), F.col("lang")), F.concat(F.lit("^^<"), F.col("datatype"), F.lit(">")), F.lit("")
    )
    literal = F.concat(F.lit('"'), escape_literal(F.col("o")), F.lit('"'), tail)
    obj = F.when(F.col("o_kind") == "literal", literal).otherwise(_node(F.col("o")))
    return triples.select(F.concat_ws(" ", _node(F.col("s")), F.concat(F.lit("<"), "p", F.lit(">")), obj, F.lit(".")).alias("value"))


_LINE = (
    r"^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+"
    r'(?:<([^>]*)>|(_:\S+)|"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'
)


# Groups of a matching line, the literal last because it may hold any character.
_SPREAD = "\u0002" + "\u0001".join(f"${i}" for i in (1, 2, 3, 4, 5, 7, 8, 6))


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Triples of N-Triples lines; comments and blank lines are left out, and broken
    ones, which :func:`broken_lines` returns.

    One regular expression pass per line spreads its groups, a split picks them up.
    """
    spread = F.regexp_replace(F.col(column), _LINE, _SPREAD)
    groups = lines.select(F.when(spread.startswith("\u0002"), F.split(F.substring(spread, 2, 1 << 30), "\u0001", 8)).alias("g"))
    g = lambda i: F.nullif(F.col("g")[i], F.lit(""))
    uri, node = g(3), g(4)
    literal = uri.isNull() & node.isNull()
    return groups.where("g is not null").select(
        F.coalesce(g(0), g(1)).alias("s"),
        g(2).alias("p"),
        F.when(literal, unescape_literal(F.col("g")[7])).otherwise(F.coalesce(uri, node)).alias("o"),
        F.when(literal, "literal").when(node.isNotNull(), "blank").otherwise("uri").alias("o_kind"),
        g(5).alias("lang"),
        g(6).alias("datatype"),
    )


def broken_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that are neither a triple nor a comment nor blank, with an error."""
    c = F.col(column)
    bad = ~c.rlike(r"^\s*(?:#.*)?$") & ~c.rlike(_LINE)
    return lines.where(bad).withColumn("error", F.lit("no N-Triples statement"))
