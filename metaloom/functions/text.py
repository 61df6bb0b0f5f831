"""Text and number rendering shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Cell texts that mean "no value" (compared in lower case).
MISSING_TOKENS = ["", "<na>", "nan", "none", "nat", "null"]

# Every character that str.strip() removes, \x1f being the last control separator.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

FLOATING = (T.DoubleType, T.FloatType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def last_wins(pairs: Column) -> Column:
    """Map of (key, value) pairs; of equal keys the last one counts.

    A repeated key would end the job, so maps of data-given keys are built here.
    The quadratic look ahead runs only in rows that repeat a key.
    """

    def build(p: Column) -> Column:
        later = lambda e, i: F.exists(F.slice(p, i + 2, F.size(p)), lambda q: q["key"] == e["key"])
        plain = F.size(F.array_distinct(F.transform(p, lambda e: e["key"]))) == F.size(p)
        return F.when(plain, F.map_from_entries(p)).otherwise(F.map_from_entries(F.filter(p, lambda e, i: ~later(e, i))))

    return bind(pairs, build)


def strip(c: Column) -> Column:
    """Remove all leading and trailing whitespace, not only spaces."""
    return F.trim(c, F.lit(WHITESPACE))


def strip_marks(c: Column) -> Column:
    """Whitespace, then back-ticks, then whitespace: an inline-code answer becomes its text."""
    return strip(F.trim(strip(c), F.lit("`")))


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c)).isin(MISSING_TOKENS)


def whole_text(x: Column) -> Column:
    """Digits of a whole double; beyond the decimal range the double's own text."""
    return F.when(F.abs(x) < 1e18, x.cast("bigint").cast("string")).otherwise(
        F.coalesce(x.try_cast("decimal(38,0)").cast("string"), x.cast("string"))
    )


def float_text(x: Column) -> Column:
    """A fractional double without engine-style exponents between 1e-4 and 1e16."""
    plain = F.rtrim(x.cast("string").try_cast("decimal(38,18)").cast("string"), F.lit("0"))
    mantissa = F.regexp_replace(F.split_part(x.cast("string"), F.lit("E-"), F.lit(1)), r"\.0$", "")
    tiny = F.concat(mantissa, F.lit("e-"), F.lpad(F.split_part(x.cast("string"), F.lit("E-"), F.lit(2)), 2, "0"))
    size = F.abs(x)
    return (
        F.when((size >= 1e-3) & (size < 1e7), x.cast("string"))
        .when((size < 1e-4) & (size > 0), tiny)
        .otherwise(F.coalesce(plain, x.cast("string")))
    )


def is_whole(x: Column) -> Column:
    return (x == F.floor(x)) & (F.abs(x) < float("inf"))


def number_text(x: Column) -> Column:
    """``3.0`` as ``3``, ``3.5`` as ``3.5``; NaN is no value."""
    d = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    return F.when(is_whole(d), whole_text(d)).otherwise(float_text(d))


def timestamp_text(c: Column) -> Column:
    micros = F.date_format(c, "SSSSSS")
    return F.concat(
        F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
        F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""),
    )


def cell_text(c: Column, dtype: T.DataType) -> Column:
    """Text of a typed cell as the record readers print it."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, FLOATING):
        d = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        usual = (F.abs(d) >= 1e-3) & (F.abs(d) < 1e7)  # most cells: the engine's own text
        return F.when(usual, d.cast("string")).when(is_whole(d), F.concat(whole_text(d), F.lit(".0"))).otherwise(float_text(d))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(c)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return spaced_json(c)
    return c.cast("string")


def spaced_json(c: Column) -> Column:
    """JSON text of a nested value with a blank after ``,`` and ``:`` outside string literals.

    The first alternative of the pattern walks over whole string literals, so
    punctuation inside them stays as it is.
    """
    return space_json_text(F.to_json(c, {"ignoreNullFields": "false"}))


def space_json_text(j: Column) -> Column:
    literal = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'
    marked = F.regexp_replace(j, literal + "|([,:])", "$1$2\u0001")
    return F.replace(F.regexp_replace(marked, literal + r"\x01", "$1"), F.lit("\u0001"), F.lit(" "))


def has_content(c: Column, dtype: T.DataType) -> Column:
    """Non-null; text not blank; list or map not empty; anything else counts."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.length(strip(c)) > 0, F.lit(False))
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def is_filled(c: Column, dtype: T.DataType) -> Column:
    """The laxer test of the completeness counters: blanks count as filled."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    return has_content(c, dtype)


def truncate(c: Column, chars: int) -> Column:
    return F.substring(c, 1, chars)
