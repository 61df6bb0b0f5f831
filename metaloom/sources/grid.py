"""Spreadsheet grids: header promotion on ``(sheet, row_no, cells)`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import last_wins, strip

PREVIEW_ROWS = 10

# Cell texts dropped from records.
EMPTY_CELLS = ["nan", "NaN", "None"]


def filled_cells(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: F.coalesce(F.length(strip(c)), F.lit(0)) > 0))


def sheet_headers(grid: DataFrame) -> DataFrame:
    """``(sheet, header_no, names)``: of the first ten rows the fullest, first among equals.

    ``row_no`` counts from 0, so the preview is a filter and not a sort.
    """
    preview = grid.where(F.col("row_no") < PREVIEW_ROWS)
    best = preview.groupBy("sheet").agg(
        F.min_by(F.struct("row_no", "cells"), F.struct(-filled_cells(F.col("cells")), F.col("row_no"))).alias("h")
    )
    names = F.transform(
        "h.cells",
        lambda c, i: F.when(F.coalesce(F.length(strip(c)), F.lit(0)) > 0, strip(c)).otherwise(
            F.concat(F.lit("col_"), i.cast("string"))
        ),
    )
    return best.select("sheet", F.col("h.row_no").alias("header_no"), names.alias("names"))


def grid_records(grid: DataFrame) -> DataFrame:
    """``(sheet, row_no, fields)`` of the rows below the header; empty rows are dropped.

    A name that occurs twice keeps its last cell.
    """
    rows = grid.join(sheet_headers(grid), "sheet").where(F.col("row_no") > F.col("header_no"))
    width = F.least(F.size("names"), F.size("cells"))
    pairs = F.zip_with(
        F.slice("names", 1, width), F.slice("cells", 1, width),
        lambda n, c: F.struct(n.alias("key"), strip(c).alias("value")),
    )
    kept = F.filter(pairs, lambda p: (F.coalesce(F.length(p["value"]), F.lit(0)) > 0) & ~p["value"].isin(EMPTY_CELLS))
    return rows.select("sheet", "row_no", last_wins(kept).alias("fields")).where(F.size("fields") > 0)
