"""Delimited text: encoding and delimiter sniffing, string records."""

from __future__ import annotations

import csv
import io
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.dsl import quoted
from ..functions.text import last_wins, strip
from ..session import written
from .files import CHUNK_BYTES, HEAD_BYTES, HEAD_LINES, file_heads, list_files, open_at, reader

#: Bytes of a file that one look at its body covers.
RANGE_BYTES = 32 << 20
#: Bytes of a file with line breaks in cells that one task reads.
RECORD_BYTES = 16 << 20

# Delimiter candidates in order of preference.
DELIMITERS = [";", ",", "\t", "|"]

# Cell texts read as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def encoding_of(head: Column) -> Column:
    """UTF-8 when the head decodes, else Latin-1.

    A full head may end inside a character, so up to three trailing bytes are
    forgiven there.
    """
    size = F.length(head)
    whole = F.is_valid_utf8(head)
    cut = [F.is_valid_utf8(F.substring(head, F.lit(1), size - k)) for k in (1, 2, 3)]
    forgiving = (size >= HEAD_BYTES) & (cut[0] | cut[1] | cut[2])
    return F.when(whole | forgiving, "UTF-8").otherwise("ISO-8859-1")


def decoded(data: Column, encoding: Column) -> Column:
    """Text of bytes, bad sequences replaced."""
    return F.when(encoding == "UTF-8", F.make_valid_utf8(data.cast("string"))).otherwise(
        F.decode(data, "ISO-8859-1")
    )


def first_lines(text: Column, n: int = HEAD_LINES) -> Column:
    """The first ``n`` lines, stripped, blank ones left out."""
    lines = F.transform(F.slice(F.split(text, r"\r\n|\r|\n", n + 1), 1, n), strip)
    return F.filter(lines, lambda v: F.length(v) > 0)


def occurrences(line: Column, mark: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))


def delimiter_score(lines: Column, mark: str) -> Column:
    """Total count; a hundred times the count per line when all lines agree."""
    counts = F.transform(lines, lambda v: occurrences(v, mark))
    total = F.aggregate(counts, F.lit(0), lambda a, c: a + c)
    agree = (F.array_min(counts) > 0) & (F.array_min(counts) == F.array_max(counts))
    return F.when(F.size(lines) == 0, 0).when(agree, counts[0] * 100).otherwise(total)


def best_delimiter(lines: Column) -> Column:
    """Highest score, first candidate among equals, comma when nothing occurs."""
    scores = [delimiter_score(lines, d) for d in DELIMITERS]
    top = F.greatest(*scores)
    choice = F.when(top == 0, ",")
    for mark, score in zip(DELIMITERS, scores):
        choice = choice.when(score == top, mark)
    return choice


def sniff(files: DataFrame) -> DataFrame:
    """``(path, encoding, delimiter, header)`` from the heads of the files."""
    heads = file_heads(files).withColumn("encoding", encoding_of(F.col("head")))
    text = F.regexp_replace(decoded(F.col("lines"), F.col("encoding")), "^﻿", "")
    return heads.select(
        "path", "encoding", best_delimiter(first_lines(text)).alias("delimiter"),
        # Blank lines above the header go; a leading tab is an empty first name and stays.
        F.regexp_extract(text, r"^(?:[ \t]*[\r\n]+)*([^\r\n]*)", 1).alias("header"),
    )


def header_names(line: str, delimiter: str) -> list[str]:
    """Column names of a header line; blanks are numbered, repeats get a suffix."""
    cells = next(csv.reader(io.StringIO(line), delimiter=delimiter), [])
    names: list[str] = []
    for i, cell in enumerate(cells):
        name = cell if cell else f"Unnamed: {i}"
        k, base = 0, name
        while name in names:
            k += 1
            name = f"{base}.{k}"
        names.append(name)
    return names


def named_dialects(dialects: DataFrame) -> DataFrame:
    """The dialects with the column names of their header lines."""
    names = header_names

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(names=[names(h, d) for h, d in zip(batch["header"], batch["delimiter"])])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dialects.schema.fields)
    return dialects.mapInPandas(add, fields + ", names array<string>")


# ── what the body of a file holds ────────────────────────────────────────────

class Body:
    """What the bytes of a range hold, followed chunk by chunk, so that a range of any size costs the memory of a chunk.

    ``odd`` counts quotes (mod 2), ``outer`` and ``inner`` tell of line breaks outside and inside of
    quotes counted from the range start, ``opens`` whether a quote opens a cell, ``cells`` the most cells of
    a line without quotes that begins in the range.
    """

    def __init__(self, before: bytes, mark: bytes):
        self.mark, self.previous = mark[0], (before or b"\n")[0]
        self.odd, self.outer, self.inner, self.opens, self.cells = 0, False, False, False, 1
        #: The line under way: does it begin in the range, its delimiters and quotes so far.
        self.own, self.marks, self.quotes = before in (b"", b"\n"), 0, 0

    def read(self, data: bytes) -> None:
        raw = np.frombuffer(data, np.uint8)
        quote = raw == 34
        breaks, quotes, marks = np.flatnonzero(raw == 10), np.flatnonzero(quote), np.flatnonzero(raw == self.mark)
        if len(quotes):
            ahead = np.where(quotes > 0, raw[quotes - 1], self.previous)
            self.opens |= bool(np.isin(ahead, (10, 13, self.mark)).any())
        if len(breaks):
            inside = (np.cumsum(quote, dtype=np.uint8)[breaks] + self.odd) & 1
            self.inner, self.outer = self.inner or bool(inside.any()), self.outer or not inside.all()
            so_far = [np.searchsorted(found, breaks) for found in (marks, quotes)]
            m, q = (np.diff(n, prepend=0) for n in so_far)
            m[0], q[0] = m[0] + self.marks, q[0] + self.quotes
            plain = q == 0
            plain[0] &= self.own
            self.cells = max(self.cells, int(m[plain].max(initial=0)) + 1)
            self.own, self.marks, self.quotes = True, len(marks) - int(so_far[0][-1]), len(quotes) - int(so_far[1][-1])
        else:
            self.marks, self.quotes = self.marks + len(marks), self.quotes + len(quotes)
        self.odd, self.previous = (self.odd + len(quotes)) & 1, raw[-1]

    def finish(self, file) -> None:
        """Follow the last line behind the range to its end."""
        while self.own and self.previous != 10 and (more := file.read(65536)):
            line, broken, _ = more.partition(b"\n")
            self.marks, self.quotes = self.marks + line.count(self.mark), self.quotes + line.count(34)
            if broken:
                break
        if self.own and not self.quotes:
            self.cells = max(self.cells, self.marks + 1)


def body_state(files: DataFrame, dialects: DataFrame) -> DataFrame:
    """``(path, spanning, cells)``: whether a quoted cell holds a line break, and the most
    cells of a line.

    Files are looked at in ranges, so a large one is no single task; the quote parity
    of the ranges before one tells where its breaks stand. A file whose quotes never
    open a cell or do not balance (inch marks) is read line by line.
    """
    ranges = files.join(dialects.select("path", "delimiter"), "path").select(
        "path", "delimiter", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(RANGE_BYTES).cast("bigint"))).alias("start")
    )
    body, size = Body, RANGE_BYTES

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, delimiter, start in zip(batch["path"], batch["delimiter"], batch["start"]):
                with open_at(path) as file:
                    file.seek(max(0, start - 1))
                    here, left = body(file.read(1) if start else b"", delimiter.encode()), size
                    while left > 0 and (data := file.read(min(CHUNK_BYTES, left))):
                        here.read(data)
                        left -= len(data)
                    here.finish(file)
                rows.append((path, start, here.odd, here.outer, here.inner, here.opens, here.cells))
            yield pd.DataFrame(rows, columns=["path", "start", "odd", "outer", "inner", "opens", "cells"])

    found = ranges.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism), "path", "start").mapInPandas(
        read, "path string, start long, odd long, outer boolean, inner boolean, opens boolean, cells long"
    )
    ahead = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    parity = F.coalesce(F.sum("odd").over(ahead), F.lit(0)) % 2
    spans = F.when(parity == 0, F.col("inner")).otherwise(F.col("outer"))
    return found.withColumn("spans", spans).groupBy("path").agg(
        (F.bool_or("spans") & F.bool_or("opens") & (F.sum("odd") % 2 == 0)).alias("spanning"), F.max("cells").alias("cells")
    )


def null_tokens(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.col(quoted(c)).isin(NA_TOKENS), F.col(quoted(c))).alias(c) for c in df.columns])


@reader("csv")
def read_csv(
    spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None, record_bytes: int = RECORD_BYTES
) -> DataFrame:
    """All-string records of one delimited dataset, a file or a folder.

    Every file is read in its own dialect; files that share dialect and header are
    one scan, and columns meet by name. Cells beyond the header get numbered columns
    like nameless ones. Files whose cells hold line breaks are split between records, ``record_bytes`` or more to a task.
    """
    files = list_files(spark, path)
    dialects = sniff(files)
    if encoding or delimiter:
        given = {"encoding": encoding, "delimiter": delimiter}
        dialects = dialects.withColumns({k: F.lit(v) for k, v in given.items() if v})
    dialects = written(dialects, "dialects")
    known = written(dialects.join(body_state(files, dialects), "path").join(files.select("path", "length"), "path"), "bodies")
    groups = known.groupBy("encoding", "delimiter", "header", "spanning").agg(
        F.min("path").alias("first"), F.max("cells").alias("cells"), F.count(F.lit(1)).alias("files")
    ).orderBy("first").collect()
    out = None
    for g in groups:
        names = header_names(g["header"], g["delimiter"])
        if not names:
            continue
        names += [f"Unnamed: {i}" for i in range(len(names), g["cells"] or 0)]
        mine = known
        for c in ("encoding", "delimiter", "header", "spanning"):
            mine = mine.where(F.col(c).eqNullSafe(F.lit(g[c])))
        if g["spanning"]:
            cells = streamed_cells(mine.select("path", "encoding", "delimiter", "length"), record_bytes).select("cells")
            part = null_tokens(cells.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]))
        else:
            place = path if len(groups) == 1 else [r["path"] for r in mine.select("path").collect()]
            schema = ", ".join(quoted(n) + " string" for n in names)
            part = null_tokens(
                spark.read.schema(schema)
                .options(header=True, sep=g["delimiter"], encoding=g["encoding"], quote='"', escape='"',
                         enforceSchema=True, mode="PERMISSIVE", recursiveFileLookup=True)
                .csv(place)
            )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "value string")


def read_many(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``(path, fields)`` records of many delimited files with different headers.

    One text scan per encoding; each line meets the dialect of its file, a row of a
    small table. Of the lines that equal the header of their file, all but one are
    records. Files whose cells hold line breaks are read record by record, in ranges.
    """
    dialects = sniff(files)
    dialects = written(named_dialects(dialects), "dialects")
    known = written(dialects.join(body_state(files, dialects), "path").join(files.select("path", "length"), "path"), "bodies")
    spanning = F.coalesce(F.col("spanning"), F.lit(False))
    cells = None
    for encoding in ("UTF-8", "ISO-8859-1"):
        mine = known.where(~spanning & (F.col("encoding") == encoding))
        paths = [r["path"] for r in mine.select("path").toLocalIterator()]
        if not paths:
            continue
        lines = spark.read.option("encoding", encoding).text(paths).select(
            F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("line")
        )
        met = lines.where(F.length(strip(F.col("line"))) > 0).join(mine.select("path", "delimiter", "header", "names"), "path")
        again = met.where("line = header").groupBy("path", "delimiter", "header", "names").agg((F.count(F.lit(1)) - 1).cast("int").alias("n"))
        again = again.where("n > 0").select("path", "delimiter", "names", F.explode(F.array_repeat("header", F.col("n"))).alias("line"))
        rows = met.where("line <> header").select("path", "delimiter", "names", "line").unionByName(again)
        part = rows.select("path", "names", split_quoted(F.col("line"), F.col("delimiter")).alias("cells"))
        cells = part if cells is None else cells.unionByName(part)
    whole = streamed_cells(known.where(spanning)).join(known.select("path", "names"), "path").select("path", "names", "cells")
    cells = whole if cells is None else cells.unionByName(whole)
    name = lambda i: F.coalesce(F.get("names", i), F.concat(F.lit("Unnamed: "), i.cast("string")))
    pairs = F.transform("cells", lambda c, i: F.struct(name(i).alias("key"), c.alias("value")))
    kept = F.filter(pairs, lambda p: ~F.coalesce(p["value"], F.lit("")).isin(NA_TOKENS))
    return cells.select("path", last_wins(kept).alias("fields"))


# ── files whose cells hold line breaks ───────────────────────────────────────

#: Where a reader stands: outside of quotes, in a quoted cell, or there in the middle
#: of a pair of quotes.
OUTSIDE, QUOTED, PAIRED = 0, 1, 2
BOM = b"\xef\xbb\xbf"


class Quotes:
    """Follows the quoted cells of a file from quote to quote.

    A quote opens a cell only where a cell begins; inside, a pair of quotes is one
    character. ``data[at:end]`` is looked at; the byte before and the one behind
    it, if there are any, belong to ``data`` too.
    """

    def __init__(self, delimiter: str):
        opening = rb'(?<![^\r\n' + re.escape(delimiter.encode()) + rb'])"'
        self.opening, self.opening_or_break = re.compile(opening), re.compile(rb"\n|" + opening)

    def follow(self, data: bytes, at: int, end: int, state: int, breaks: bool) -> tuple[int, int]:
        """The first line break outside of quotes, -1 without one (or unless ``breaks``), and the state at the end."""
        at, inside = at + (state == PAIRED), state != OUTSIDE
        while True:
            if inside:
                at = data.find(b'"', at, end)
                if at < 0:
                    return -1, QUOTED
                if data[at + 1 : at + 2] == b'"':
                    at += 2
                    if at > end:
                        return -1, PAIRED
                    continue
                at += 1
            found = (self.opening_or_break if breaks else self.opening).search(data, at, end)
            if not found:
                return -1, OUTSIDE
            if data[found.start()] == 10:
                return found.start(), OUTSIDE
            at, inside = found.end(), True

    def chunks(self, file, place: int, end: int):
        """``(offset, data, at, end)`` of the bytes from a place on, for :meth:`follow`."""
        while place < end:
            low = max(place - 1, 0)
            file.seek(low)
            data = file.read(min(CHUNK_BYTES, end - place) + (place - low) + 1)
            if low == 0 and data.startswith(BOM):  # the file begins behind its mark
                low, data, place = 3, data[3:], max(place, 3)
            stop = min(len(data), min(CHUNK_BYTES, end - place) + (place - low))
            yield low, data, place - low, stop
            place = low + stop

    def state_after(self, file, start: int, end: int, state: int) -> int:
        for _, data, at, stop in self.chunks(file, start, end):
            state = self.follow(data, at, stop, state, False)[1]
        return state

    def record_start(self, file, place: int, state: int, size: int) -> int:
        """Where the first record at or behind a place begins; the size where there is none."""
        if place == 0 or place >= size:
            return min(place, size)
        file.seek(place - 1)
        if state == OUTSIDE and file.read(1) == b"\n":
            return place
        for low, data, at, stop in self.chunks(file, place, size):
            found, state = self.follow(data, at, stop, state, True)
            if found >= 0:
                return low + found + 1
        return size


def record_ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    """``(path, encoding, delimiter, start, stop, length, state, stop_state)``: ranges of files and the
    states they begin and end in.

    Every range is followed from each state it may begin in; one fold over the few
    numbers of a file's ranges tells which it is.
    """
    step = F.lit(range_bytes).cast("long")
    ranges = files.select("path", "encoding", "delimiter", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start"))
    ranges = ranges.withColumn("stop", F.least(F.col("start") + step, F.col("length")))
    quotes = Quotes

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = []
            for path, mark, start, stop, length in zip(batch["path"], batch["delimiter"], batch["start"], batch["stop"], batch["length"]):
                if length <= range_bytes:  # alone: nothing depends on where it ends
                    ends.append([OUTSIDE] * 3)
                    continue
                with open_at(path) as file:
                    follow = quotes(mark)
                    ends.append([follow.state_after(file, start, stop, s) for s in (OUTSIDE, QUOTED, PAIRED)])
            yield batch.assign(ends=ends)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, state, states = rows.sort_values("start"), OUTSIDE, [OUTSIDE]
        for ends in rows["ends"]:
            state = int(ends[state])
            states.append(state)
        return rows.drop(columns="ends").assign(state=states[:-1], stop_state=states[1:])

    width = max(1, files.sparkSession.sparkContext.defaultParallelism)
    shape = "path string, encoding string, delimiter string, length long, start long, stop long"
    seen = ranges.repartition(width, "path", "start").mapInPandas(look, shape + ", ends array<int>")
    return seen.groupBy("path").applyInPandas(fold, shape + ", state int, stop_state int")


def streamed_cells(files: DataFrame, range_bytes: int = RECORD_BYTES) -> DataFrame:
    """``(path, cells)`` of the records below the header of ``files(path, encoding, delimiter, length)``.

    Large files are many tasks: a record belongs to the range it begins in.
    """
    quotes = Quotes

    def rows(path, encoding, delimiter, start, stop, length, state, stop_state):
        with open_at(path) as file:
            follow = quotes(delimiter)
            begin = follow.record_start(file, start, state, length)
            end = follow.record_start(file, stop, stop_state, length)
            if begin >= end:
                return
            file.seek(begin)
            data = file.read(end - begin)
        text = data.decode("utf-8-sig" if encoding == "UTF-8" and begin == 0 else encoding, "replace")
        csv.field_size_limit(1 << 31)
        records = (r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if len(r) > 1 or any(c.strip() for c in r))
        if start == 0:
            next(records, None)
        yield from records

    columns = ["path", "encoding", "delimiter", "start", "stop", "length", "state", "stop_state"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one in batch[columns].itertuples(index=False):
                found = rows(*one)
                while some := list(itertools.islice(found, 2_000)):
                    yield pd.DataFrame({"path": one.path, "cells": some})

    width = max(1, files.sparkSession.sparkContext.defaultParallelism)
    ranges = record_ranges(files, range_bytes)
    return ranges.repartition(width, "path", "start").mapInPandas(read, "path string, cells array<string>")


def split_quoted(line: Column, delimiter: Column) -> Column:
    """Cells of a line whose delimiter is a column; quoted cells may hold it."""
    mark = "\u0001"
    guarded = F.transform(
        F.split(line, '"'), lambda s, i: F.when(i % 2 == 0, F.replace(s, delimiter, F.lit(mark))).otherwise(s)
    )
    # A doubled quote inside a cell leaves an empty even piece between two odd ones.
    joined = F.array_join(guarded, '"')
    cells = F.split(joined, mark, -1)

    def unquote(c: Column) -> Column:
        inner = F.regexp_extract(c, '(?s)^"(.*)"$', 1)
        return F.when(c.rlike('(?s)^".*"$'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(c)

    return F.transform(cells, unquote)
