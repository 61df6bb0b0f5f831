"""Scalars of catalogue records: uris, codes, languages, versions, lists, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

# Authority bases used to turn short codes into uris.
LANGUAGE_BASE = "http://publications.europa.eu/resource/authority/language/"
COUNTRY_BASE = "http://publications.europa.eu/resource/authority/country/"
FREQUENCY_BASE = "http://publications.europa.eu/resource/authority/frequency/"
ROLE_BASE = "https://standards.iso.org/iso/19115/resources/Codelists/gml/CI_RoleCode.xml#"

# Record fields that are always lists; keyword fields split at ";".
ARRAY_FIELDS = [
    "purpose", "purpose_en_tmpt", "language", "keyword", "keyword_en_tmpt",
    "population_coverage", "health_category", "personal_data", "health_theme",
    "code_values", "was_generated_by", "spatial", "alternate_identifier", "is_referenced_by",
]
SEMICOLON_FIELDS = ["keyword", "keyword_en_tmpt"]

# Media types of the supported file formats.
MIME_TYPES = {
    "csv": "text/csv",
    "json": "application/json",
    "xml": "application/xml",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "parquet": "application/vnd.apache.parquet",
    "txt": "text/plain",
    "html": "text/html",
    "pdf": "application/pdf",
}

LETTERS3 = r"^\p{L}{3}$"


def language_uri(c: Column) -> Column:
    """Three-letter code to authority uri, any other text only trimmed."""
    code = F.upper(strip(c))
    return F.when(code.rlike(LETTERS3), F.concat(F.lit(LANGUAGE_BASE), code)).otherwise(strip(c))


def language_list(c: Column) -> Column:
    """Array of language texts to array of uris, blanks removed."""
    return F.transform(F.filter(c, lambda v: F.length(strip(v)) > 0), language_uri)


def language_text_list(c: Column) -> Column:
    """A single language text to a list; a uri stays as it is."""
    one = F.when(c.startswith("http"), strip(c)).otherwise(language_uri(c))
    return F.when(F.length(strip(c)) > 0, F.array(one))


def split_list(c: Column, sep: str = ";") -> Column:
    """``a; b ;; c`` to ``[a, b, c]``."""
    items = F.transform(F.split(c, sep), strip)
    return F.filter(items, lambda v: F.length(v) > 0)


def text_to_array(field: str, c: Column) -> Column:
    """Array coercion of one text field; blank or missing becomes the empty list."""
    full = split_list(c) if field in SEMICOLON_FIELDS else F.array(strip(c))
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(F.length(strip(c)), F.lit(0)) > 0, full).otherwise(empty)


def country_uri(c: Column) -> Column:
    """Uri of a three-letter country code, NULL for anything else."""
    return F.when(c.rlike(LETTERS3), F.concat(F.lit(COUNTRY_BASE), F.upper(c)))


def last_segment(c: Column) -> Column:
    """Text after the last ``/`` or ``#``."""
    return F.element_at(F.split(c, "[/#]"), -1)


def expand_uri(c: Column, base: str) -> Column:
    """Short code to full uri unless it is one already; blanks are dropped by the caller."""
    return F.when(c.startswith("http"), c).otherwise(F.concat(F.lit(base), c))


def expand_uri_list(c: Column, base: str) -> Column:
    kept = F.filter(c, lambda v: v.isNotNull() & (v != ""))
    return F.transform(kept, lambda v: expand_uri(v, base))


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", x)


def content_hash(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def next_version(c: Column) -> Column:
    """Missing or blank starts at 1.0; a number grows by one; other text stays."""
    number = strip(c).try_cast("double")
    blank = F.coalesce(F.length(strip(c)), F.lit(0)) == 0
    return F.when(blank, F.lit("1.0")).when(number.isNotNull(), one_decimal(number + 1)).otherwise(c)


def next_version_history(c: Column) -> Column:
    """Sorted versions plus the next one; unchanged when any entry is not a number."""
    numbers = F.array_sort(F.transform(c, lambda v: strip(v).try_cast("double")))
    grown = F.concat(
        F.transform(numbers, one_decimal), F.array(one_decimal(F.try_element_at(numbers, F.lit(-1)) + 1))
    )
    all_numeric = F.forall(c, lambda v: strip(v).try_cast("double").isNotNull())
    return (
        F.when(c.isNull() | (F.size(c) == 0), F.array(F.lit("1.0")))
        .when(all_numeric, grown)
        .otherwise(c)
    )


def file_extension(path: Column) -> Column:
    """Lower-case suffix of the last path segment without its dot, NULL when absent."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"[^.].*\.([^.]+)$", 1))
    return F.when(ext != "", ext)


def mime_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.try_element_at(table, F.coalesce(file_extension(path), F.lit("")))


def entry_text(values: list[Column]) -> Column:
    """Search text of a vocabulary entry from its list columns, blanks removed."""
    flat = F.flatten(F.array(*[F.coalesce(v, F.array().cast("array<string>")) for v in values]))
    trimmed = F.transform(F.filter(flat, lambda v: v.isNotNull()), strip)
    return F.concat_ws(" ", F.filter(trimmed, lambda v: v != ""))


def query_text(purpose: Column, title: Column, notes: Column, keywords: Column) -> Column:
    """One search text from the describing fields; lists come first flattened."""
    return entry_text([purpose, F.array(title), F.array(notes), keywords])


def top_n(c: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(strip(c).try_cast("int"), F.lit(1)))


def flag(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit("false")))) == "true"


def contacts(c: Column) -> Column:
    """``name|email|role, name|email`` to an array of structs."""

    def contact(text: Column) -> Column:
        parts = F.transform(F.split(text, r"\|"), strip)
        return F.struct(
            F.try_element_at(parts, F.lit(1)).alias("name"),
            F.try_element_at(parts, F.lit(2)).alias("email"),
            F.try_element_at(parts, F.lit(3)).alias("role"),
        )

    return F.transform(split_list(c, ","), contact)


def spaced_camel(c: Column) -> Column:
    """``dataSet`` to ``data Set`` for labels without a dictionary entry."""
    return F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")


def is_non_public(access_rights: Column) -> Column:
    """Loose test: the word occurs anywhere, in any case."""
    return F.coalesce(F.upper(access_rights).contains("NON_PUBLIC"), F.lit(False))


def ends_non_public(access_rights: Column) -> Column:
    """Strict test: it is the last segment of the uri."""
    return F.coalesce(F.element_at(F.split(access_rights, "/"), -1) == "NON_PUBLIC", F.lit(False))


def report_label(field: Column) -> Column:
    """``number_of_records`` to ``Number of records``."""
    words = F.replace(field, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, 2, 2**31 - 1)))
