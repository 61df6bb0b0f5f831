"""Cleaning steps compiled to one Column expression.

A mapping ``{"columns": [...], "transform": [{"op", "params"}, ...]}`` turns into
a composition of built-in expressions, so a chain costs no extra pass and stays
inside code generation. A mapping that cannot work (unknown column, unknown
step, bad parameter) compiles to ``None``: it is unresolved, as a failing chain is.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import dates
from .text import FLOATING, INTEGRAL, bind, cell_text, is_missing, number_text, strip


class Unresolved(Exception):
    """Raised at compile time; the mapping is skipped."""


@dataclass
class Cell:
    """A column under construction together with its type.

    ``number`` and ``stamp`` are the numeric or time column a text was printed from,
    ``instant`` is the timestamp a date part was taken from, ``trace`` what names
    that timestamp. They let later steps skip a round trip through text.
    """

    col: Column
    dtype: T.DataType
    digits_only: bool = False
    number: Column | None = None
    stamp: Column | None = None
    instant: Column | None = None
    trace: str = ""
    part: str = ""

    @property
    def text(self) -> Column:
        return cell_text(self.col, self.dtype)

    @property
    def numeric(self) -> bool:
        return isinstance(self.dtype, FLOATING + INTEGRAL + (T.DecimalType,))


TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
STEPS: dict[str, Callable[[Cell, dict, DataFrame], Cell]] = {}

# Entries of a substitution table in one bucket of its literal.
BUCKET_ENTRIES = 8


def step(name: str):
    """Register a cleaning step: ``(cell, params, df) -> cell``."""

    def add(fn):
        STEPS[name] = fn
        return fn

    return add


def _string(col: Column, digits_only: bool = False) -> Cell:
    return Cell(col, T.StringType(), digits_only)


def java_pattern(pattern: str) -> str | None:
    """Regex for the JVM, ``None`` where the pattern is broken.

    Named groups and end anchors are spelled differently; constructs the JVM
    has no word for are rejected.
    """
    try:
        re.compile(pattern)
    except re.error:
        return None
    out = re.sub(r"\(\?P<([A-Za-z][A-Za-z0-9]*)>", r"(?<\1>", pattern)
    out = re.sub(r"\(\?P=([A-Za-z][A-Za-z0-9]*)\)", r"\\k<\1>", out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
    if "(?P" in out or re.search(r"\(\?\(", out):
        raise Unresolved(f"pattern not supported: {pattern}")
    return out


def java_replacement(text: str) -> str:
    """``\\1`` and ``\\g<1>`` become ``$1``; a literal dollar sign is escaped."""
    out = text.replace("$", "\\$")
    out = re.sub(r"\\g<(\w+)>", lambda m: "$" + m.group(1) if m.group(1).isdigit() else "${" + m.group(1) + "}", out)
    return re.sub(r"\\(\d)", r"$\1", out)


@step("to_string")
def _to_string(cell: Cell, params: dict, df: DataFrame) -> Cell:
    if isinstance(cell.dtype, T.BooleanType):
        return _string(cell.col.cast("int").cast("string"))
    if cell.numeric:
        return Cell(number_text(cell.col), T.StringType(), number=to_number(cell.col, cell.dtype))
    if isinstance(cell.dtype, TIMES):
        return Cell(cell.text, T.StringType(), stamp=cell.col)
    x = strip(cell.text)
    whole = F.when(x.endswith(".0"), x.try_cast("double"))
    tidy = F.when(whole.isNotNull(), number_text(whole)).otherwise(x)
    return _string(F.when(~is_missing(x), tidy), cell.digits_only)


@step("strip")
def _strip(cell: Cell, params: dict, df: DataFrame) -> Cell:
    return _string(strip(cell.text), cell.digits_only)


@step("split")
def _split(cell: Cell, params: dict, df: DataFrame) -> Cell:
    index = params.get("index", 0)
    pattern = java_pattern(params.get("sep", ""))
    if pattern is None or not isinstance(index, int):
        return _string(F.when(cell.col.isNotNull(), F.lit("")))
    at = index + 1 if index >= 0 else index
    if pattern == "":
        parts = F.concat(F.array(F.lit("")), F.split(cell.text, ""), F.array(F.lit("")))
    else:
        parts = F.split(cell.text, pattern, -1)
    picked = F.coalesce(F.try_element_at(parts, F.lit(at)), F.lit(""))
    return _string(F.when(cell.col.isNotNull(), picked))


@step("regex_extract")
def _regex_extract(cell: Cell, params: dict, df: DataFrame) -> Cell:
    pattern = java_pattern(params.get("pattern", ""))
    group = params.get("group", 0)
    if pattern is None or not isinstance(group, int) or group > re.compile(params.get("pattern", "")).groups or group < 0:
        return _string(F.lit(None).cast("string"))
    x = cell.text
    # regexp_extract cannot tell "no match" from an empty group.
    return _string(F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group)))


NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$|^(?i:[+-]?inf(?:inity)?)$"


def to_number(c: Column, dtype: T.DataType) -> Column:
    """Double or NULL; the guard keeps out type suffixes such as ``10d`` and ``1.5f``."""
    if isinstance(dtype, FLOATING + INTEGRAL + (T.DecimalType, T.BooleanType)):
        d = c.cast("int").cast("double") if isinstance(dtype, T.BooleanType) else c.cast("double")
        return F.nanvl(d, F.lit(None).cast("double"))
    x = strip(cell_text(c, dtype))
    return F.when(x.rlike(NUMBER), x.try_cast("double"))


@step("to_numeric")
def _to_numeric(cell: Cell, params: dict, df: DataFrame) -> Cell:
    if cell.number is not None:
        return Cell(cell.number, T.DoubleType())
    return Cell(to_number(cell.col, cell.dtype), T.DoubleType())


@step("to_datetime_part")
def _to_datetime_part(cell: Cell, params: dict, df: DataFrame) -> Cell:
    part = params.get("part", "year")
    if part not in ("year", "month", "day"):
        return replace(cell)
    if isinstance(cell.dtype, TIMES):
        instant = cell.col
    elif cell.stamp is not None:
        instant = cell.stamp
    elif cell.numeric:  # a bare number is nanoseconds since the epoch
        instant = F.timestamp_micros(F.floor(cell.col / 1000).cast("bigint"))
    else:
        instant = dates.parse_mixed(cell.text, bool(params.get("dayfirst", False)))
    return Cell(
        dates.datetime_part(instant, part), T.StringType(), digits_only=True, instant=instant, part=part,
        trace=json.dumps([cell.trace, bool(params.get("dayfirst", False))]),
    )


@step("replace")
def _replace(cell: Cell, params: dict, df: DataFrame) -> Cell:
    old, new = str(params.get("old", "")), str(params.get("new", ""))
    if params.get("regex", False):
        pattern = java_pattern(old)
        if pattern is None:
            raise Unresolved(f"bad pattern: {old}")
        return _string(F.regexp_replace(cell.text, pattern, java_replacement(new)))
    if old == "":  # an empty needle matches between all characters
        spread = F.concat(F.lit(new), F.regexp_replace(cell.text, "(?s)(.)", "$1" + java_replacement(new)))
        return _string(spread)
    return _string(F.replace(cell.text, F.lit(old), F.lit(new)))


@step("map")
def _map(cell: Cell, params: dict, df: DataFrame) -> Cell:
    mapping = params.get("mapping", {})
    if not mapping:
        return cell
    x = cell.text
    table = {str(k): None if t is None else str(t) for k, t in mapping.items()}
    return _string(substituted(x, table))


def substituted(x: Column, table: dict[str, str | None]) -> Column:
    """The text, or what the table has for it.

    The table is one JSON literal, parsed once when the plan is made: a list of small
    maps by checksum of the key, so a look-up does not walk the whole table.
    """
    width = max(1, len(table) // BUCKET_ENTRIES)
    buckets: list[dict] = [{} for _ in range(width)]
    for k, t in table.items():
        buckets[zlib.crc32(k.encode("utf-8")) % width][k] = t
    parsed = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")

    def look_up(text: Column) -> Column:
        key = F.coalesce(text, F.lit(""))
        own = F.get(parsed, F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(width)).cast("int"))
        return bind(own, lambda m: F.when(text.isNotNull() & F.map_contains_key(m, key), F.try_element_at(m, key)).otherwise(text))

    return bind(x, look_up)


@step("json_extract")
def _json_extract(cell: Cell, params: dict, df: DataFrame) -> Cell:
    key = params.get("key")
    if key is None:
        return _string(F.lit(None).cast("string"))
    doc = F.try_parse_json(strip(cell.text))
    as_map = "map<string,variant>"
    fields = F.try_variant_get(doc, "$", as_map)
    items = F.try_variant_get(doc, "$", "array<variant>")
    filter_key, filter_val = params.get("filter_key"), params.get("filter_val")

    def text_of(v: Column) -> Column:
        return F.try_variant_get(v, "$", "string")

    if filter_key and filter_val:
        maps = F.transform(items, lambda v: F.try_variant_get(v, "$", as_map))
        hits = F.filter(maps, lambda m: F.coalesce(text_of(F.try_element_at(m, F.lit(filter_key))) == str(filter_val), F.lit(False)))
        chosen = F.try_element_at(hits, F.lit(1))
    else:
        chosen = F.try_variant_get(F.try_element_at(items, F.lit(1)), "$", as_map)
    picked = F.coalesce(F.try_element_at(fields, F.lit(key)), F.try_element_at(chosen, F.lit(key)))
    return _string(text_of(picked))


@step("format_point")
def _format_point(cell: Cell, params: dict, df: DataFrame) -> Cell:
    names = (params.get("lat_col"), params.get("lon_col"))
    if any(n not in df.columns for n in names):
        return cell
    lat, lon = (to_number(F.col(quoted(n)), df.schema[n].dataType) for n in names)
    point = F.concat(
        F.lit("POINT("), cell_text(lat, T.DoubleType()), F.lit(" "), cell_text(lon, T.DoubleType()), F.lit(")")
    )
    return _string(F.coalesce(point, F.lit("")))


@step("join_columns")
def _join_columns(cell: Cell, params: dict, df: DataFrame) -> Cell:
    names = [c for c in params.get("columns", []) if c in df.columns]
    if not names:
        return cell
    texts = [F.coalesce(cell_text(F.col(quoted(n)), df.schema[n].dataType), F.lit("nan")) for n in names]
    return _string(F.concat_ws(params.get("sep", ", "), *texts))


@step("constant")
def _constant(cell: Cell, params: dict, df: DataFrame) -> Cell:
    value = params.get("value")
    col = F.lit(value)
    if value is None:
        return _string(col.cast("string"))
    dtype = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}.get(type(value), T.StringType())
    return Cell(col.cast(dtype), dtype)


def quoted(name: str) -> str:
    """Column reference for a name that may hold dots."""
    return "`" + name.replace("`", "``") + "`"


def start_cell(df: DataFrame, mapping: dict) -> Cell | None:
    columns = mapping.get("columns") or []
    if isinstance(columns, str):
        columns = [columns]
    if not columns and mapping.get("column"):
        columns = [mapping["column"]]
    if not columns or columns[0] not in df.columns:
        return None
    return Cell(F.col(quoted(columns[0])), df.schema[columns[0]].dataType, trace=columns[0])


def compile_mapping(df: DataFrame, mapping: dict) -> Cell | None:
    """The cleaned column of a mapping, ``None`` when it cannot be resolved."""
    cell = start_cell(df, mapping)
    if cell is None:
        return None
    for item in mapping.get("transform") or []:
        if not isinstance(item, dict):
            continue
        op = STEPS.get(item.get("op"))
        if op is None:
            return None
        try:
            trace = json.dumps([cell.trace, item], sort_keys=True, default=str)
            cell = op(cell, item.get("params") or {}, df)
            cell.trace = cell.trace if cell.instant is not None else trace
        except (Unresolved, TypeError, ValueError, AttributeError):
            return None
    return cell
