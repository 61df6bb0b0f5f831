"""Whole rows carried through Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame, keep: list[str] | None = None):
    """The columns as one struct, so that results can have any name."""
    return F.struct(*[F.col(quoted(c)) for c in (df.columns if keep is None else keep)])


def _of_rows(batches: Iterator[pa.RecordBatch], work: Callable, at: int) -> Iterator[pa.RecordBatch]:
    """``work`` over batches of rows whose field ``at`` is the text."""

    def pairs():
        for batch in batches:
            rows = batch.column(0)
            yield pa.RecordBatch.from_arrays([rows, rows.field(at)], ["row", "text"])

    return work(pairs())


def carried(docs: DataFrame, work: Callable, fields: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``work`` over batches of (row, text); it returns the rows with the given fields after them.

    ``keep`` names the columns that ``row`` carries, all by default. A text that is among
    them goes to the worker once.
    """
    names = docs.columns if keep is None else keep
    if text in names and docs.schema[text].dataType == StringType():
        rows = docs.select(whole_row(docs, keep).alias("row"))
        return rows.mapInArrow(partial(_of_rows, work=work, at=names.index(text)), carried_type(docs, fields, keep))
    plain = docs.select(whole_row(docs, keep).alias("row"), F.col(quoted(text)).cast("string").alias("text"))
    return plain.mapInArrow(work, carried_type(docs, fields, keep))


def carried_type(docs: DataFrame, fields: str, keep: list[str] | None = None) -> StructType:
    row = docs.select(whole_row(docs, keep).alias("row")).schema
    return StructType(row.fields + StructType.fromDDL(fields).fields)
