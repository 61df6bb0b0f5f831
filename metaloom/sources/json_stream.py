"""Items of JSON arrays and whole JSON documents, read as streams of any length."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import CHUNK_BYTES, open_at, open_stream, over_paths

ITEM = "path string, position long, item string, error string"
#: Characters of items in one batch, and the largest document the JSON parser of the JVM takes.
BATCH_CHARS = 4 << 20
LARGEST_DOCUMENT = 120 << 20
#: Bytes of an array that one look and one task cover, and depths whose commas a look counts.
RANGE_BYTES = 16 << 20
LEVELS = 4
BOM = b"\xef\xbb\xbf"
NEVER = 1 << 40
LOOKED = ["path", "start", "root", *[f"{s}_{c}" for s in ("out", "in") for c in ("inside", "delta", "least", "closed", "commas")]]


class Marks:
    """The bytes of JSON that count for its structure, chunk by chunk from a known state.

    ``inside`` tells whether the next byte belongs to a string, ``depth`` how many lists and
    objects are open. A raw line break is no part of any string, so it ends one.
    """

    def __init__(self, inside: bool = False, depth: int = 0, escaped: bool = False):
        self.inside, self.depth, self.escaped = int(inside), depth, escaped

    def read(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of brackets and commas outside of strings, the kind, and the depth before and after each."""
        raw = np.frombuffer(data, np.uint8)
        at = np.flatnonzero(_KIND[raw])
        kind = _KIND[raw[at]]
        if self.escaped or b"\\" in data:
            stands = raw != 92
            last = np.maximum.accumulate(np.where(stands, np.arange(len(raw)), -1))
            run = at - 1 - np.where(at > 0, last[at - 1], -1)
            odd = (run + (self.escaped & (run == at))) & 1
            at, kind = at[(kind != _QUOTE) | (odd == 0)], kind[(kind != _QUOTE) | (odd == 0)]
            tail = len(raw) - 1 - int(last[-1])
            self.escaped = bool((tail + (self.escaped and tail == len(raw))) & 1)
        if not len(at):
            return (np.zeros(0, np.int64),) * 4
        quotes = np.cumsum(kind == _QUOTE)
        new_line = kind == _BREAK
        since = np.maximum.accumulate(np.where(new_line, quotes, 0))
        inside = (quotes - since + np.where(np.maximum.accumulate(new_line), 0, self.inside)) & 1
        self.inside = int(inside[-1])
        kept = (inside == 0) & (kind >= _OPEN)
        at, kind = at[kept], kind[kept]
        step = (kind == _OPEN).astype(np.int64) - (kind == _CLOSE)
        after = self.depth + np.cumsum(step)
        if len(after):
            self.depth = int(after[-1])
        return at, kind, after - step, after


_QUOTE, _BREAK, _OPEN, _CLOSE, _COMMA = 1, 2, 3, 4, 5
_KIND = np.zeros(256, np.int8)
for _bytes, _kind in ((b'"', _QUOTE), (b"\n", _BREAK), (b"[{", _OPEN), (b"]}", _CLOSE), (b",", _COMMA)):
    _KIND[list(_bytes)] = _kind
_BLANK = b" \t\r\n"
def judged(position: int, data: bytes | None, closed: bool, only: bool) -> Iterator[tuple[int, str | None, str | None]]:
    """Rows of the text between two marks of the root; ``closed`` by a mark, ``only`` when it is all of the array."""
    if data is None:
        yield position, None, f"item above {LARGEST_DOCUMENT} bytes"
        return
    text = data.strip(_BLANK).decode("utf-8", "replace")
    if not text and not closed:
        yield position, None, "the array is not closed"
        return
    if not text and only:
        return
    try:  # numbers stay text: only the form of an item matters here
        end = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=str).raw_decode(text)[1]
    except (ValueError, RecursionError) as broken:
        yield position, None, f"broken item: {getattr(broken, 'msg', 'too deep')}"
        return
    yield position, text[:end], None
    if text[end:].strip(_BLANK.decode()):
        yield position, None, "no comma after an item"
    elif not closed:
        yield position + 1, None, "the array is not closed"


def owned_items(
    stream, start: int, end: int | None, inside: bool, depth: int, position: int, escaped: bool = False, chunk: int = CHUNK_BYTES
) -> Iterator[tuple[int, str | None, str | None]]:
    """``(position, item text, error)`` of the items that begin in the bytes ``start`` to ``end``.

    ``stream`` stands at ``start``; the last item is read to its end. Between two commas of the
    root stands one item, whatever is wrong with it, so a broken one costs itself only.
    """
    marks, place = Marks(inside, depth, escaped), start
    held: list[bytes] | None = None
    size, only, before = 0, False, b""
    if start == 0 and depth == 0:
        while len(before.removeprefix(BOM).strip(_BLANK)) == 0 and (more := stream.read(chunk)):
            before += more
        body = before.removeprefix(BOM)
        if not body.lstrip(_BLANK).startswith(b"["):
            yield 0, None, "no array"
            return
        place += len(before) - len(body)
        before = body
    while data := before or stream.read(chunk):
        before, used = b"", 0
        at, kind, low, high = marks.read(data)
        first = (kind == _OPEN) & (low == 0)
        for i in np.flatnonzero(first | ((kind == _COMMA) & (high == 1)) | ((kind == _CLOSE) & (high == 0))):
            here = int(at[i])
            if held is not None:
                if size + here - used > LARGEST_DOCUMENT:
                    size = -1
                whole = None if size < 0 else b"".join(held) + data[used:here]
                yield from judged(position, whole, True, only and kind[i] == _CLOSE)
                position += 1
            held = None
            if kind[i] == _CLOSE or (end is not None and place + here >= end):
                return
            held, size, used, only = [], 0, here + 1, bool(first[i])
        if held is not None and size >= 0:
            held.append(data[used:])
            size += len(data) - used
            if size > LARGEST_DOCUMENT:
                held, size = [], -1
        place += len(data)
        if held is None and end is not None and place >= end:
            return
    if held is not None:
        yield from judged(position, None if size < 0 else b"".join(held), False, only)


def array_items(stream, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, str | None, str | None]]:
    """``(position, item text, error)`` of a root array; a broken item is a row with an error."""
    yield from owned_items(stream, 0, None, False, 0, 0, chunk=chunk)


def whole_document(stream) -> tuple[str | None, str | None]:
    """Text of a document, or why it has none."""
    data = stream.read(LARGEST_DOCUMENT + 1)
    if len(data) > LARGEST_DOCUMENT:
        return None, f"document above {LARGEST_DOCUMENT} bytes"
    return data.decode("utf-8-sig", "replace"), None


def _batched(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    waiting, size = [], 0
    for row in rows:
        waiting.append(row)
        size += len(row[2] or "")
        if size >= BATCH_CHARS or len(waiting) >= 10_000:
            yield pd.DataFrame(waiting, columns=["path", "position", "item", "error"], dtype=object)
            waiting, size = [], 0
    if waiting:
        yield pd.DataFrame(waiting, columns=["path", "position", "item", "error"], dtype=object)


def range_summary(stream, start: int, size: int, escaped: bool) -> list[tuple[bool, int, int, int, list[int]]]:
    """What the bytes of a range do to the state of a reader that comes from outside or inside of a string.

    For both: whether it leaves inside, by how much the depth changes, the least depth
    on the way, the least that a closing bracket leaves, and the commas at the least
    depth and the ``LEVELS - 1`` above it.
    """
    both = [[Marks(inside, 0, escaped), NEVER, {}, NEVER] for inside in (False, True)]
    left = size
    while left > 0 and (data := stream.read(min(CHUNK_BYTES, left))):
        left -= len(data)
        for one in both:
            _, kind, _, high = one[0].read(data)
            if not len(kind):
                continue
            least = int(high.min())
            one[1] = min(one[1], least)
            one[3] = min(one[3], int(high[kind == _CLOSE].min(initial=NEVER)))
            level, n = np.unique(high[(kind == _COMMA) & (high < one[1] + LEVELS)], return_counts=True)
            for d, c in zip(level.tolist(), n.tolist()):
                one[2][d] = one[2].get(d, 0) + c
    found = []
    for marks, least, commas, closed in both:
        least = marks.depth if least == NEVER else least
        found.append((bool(marks.inside), marks.depth, least, closed, [commas.get(least + i, 0) for i in range(LEVELS)]))
    return found


def ends_escaped(file, place: int) -> bool:
    """Whether an odd run of backslashes stands right before a place of the file."""
    run = 0
    while place > 0:
        some = min(place, 4096)
        file.seek(place - some)
        data = file.read(some)
        kept = len(data.rstrip(b"\\"))
        run += len(data) - kept
        if kept:
            break
        place -= some
    return bool(run & 1)


def starts_array(file) -> bool:
    file.seek(0)
    head = b""
    while len(head.removeprefix(BOM).strip(_BLANK)) == 0 and (more := file.read(65536)):
        head += more
    return head.removeprefix(BOM).lstrip(_BLANK).startswith(b"[")


def array_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, start, stop, inside, depth, position)``: the ranges of array files and the state each begins in.

    Every range is looked at by itself, for both states it may begin in. What comes
    before it then follows from sums over the ranges of its file: a range with a line break
    forgets the string it began in, the others turn the state by their quotes. Files of one range
    need no look. Ranges behind the end of an array, and all of a file without one, are left out.
    """
    step = F.lit(range_bytes).cast("long")
    size = F.greatest(F.col("length"), F.lit(1))
    single = files.where(F.col("length") <= step).select(
        "path", F.lit(0).cast("long").alias("start"), size.alias("stop"), F.lit(False).alias("inside"),
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("position"),
    )
    many = files.where(F.col("length") > step).select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, start in zip(batch["path"], batch["start"]):
                with open_at(path) as file:
                    root = starts_array(file) if start == 0 else True
                    escaped = ends_escaped(file, start)
                    file.seek(start)
                    out, in_ = range_summary(file, start, range_bytes, escaped)
                rows.append((path, start, root, *out, *in_))
            yield pd.DataFrame(rows, columns=LOOKED)

    width = max(1, files.sparkSession.sparkContext.defaultParallelism)
    kinds = {"inside": "boolean", "commas": "array<long>"}
    shape = "path string, start long, root boolean, " + ", ".join(f"{c} {kinds.get(c.split('_')[1], 'long')}" for c in LOOKED[3:])
    seen = many.repartition(width, "path", "start").mapInPandas(look, shape)
    order = Window.partitionBy("path").orderBy("start")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("out_inside") == F.col("in_inside")  # a line break on the way
    # turns since the last range that fixes the state, which counts by what it leaves
    turned = F.when(fixed, F.lit(0)).otherwise(F.col("out_inside").cast("int"))
    seen = seen.withColumns({"_turns": F.coalesce(F.sum(turned).over(ahead), F.lit(0)), "_left": F.when(fixed, F.col("out_inside").cast("int"))})
    last = F.last(F.when(fixed, F.struct(F.col("_turns").alias("turns"), F.col("_left").alias("left"))), ignorenulls=True).over(ahead)
    seen = seen.withColumn("_at", last)
    inside = (F.col("_turns") - F.coalesce(F.col("_at.turns"), F.lit(0)) + F.coalesce(F.col("_at.left"), F.lit(0))) % 2 == 1
    seen = seen.withColumn("inside", inside)
    for name in ("delta", "least", "closed", "commas"):
        seen = seen.withColumn(name, F.when(F.col("inside"), F.col(f"in_{name}")).otherwise(F.col(f"out_{name}")))
    seen = seen.withColumn("depth", F.coalesce(F.sum("delta").over(ahead), F.lit(0)))
    here = F.try_element_at("commas", (2 - F.col("least") - F.col("depth")).cast("int"))
    commas = F.when((F.col("least") + F.col("depth")).between(2 - LEVELS, 1), here).otherwise(0)
    seen = seen.withColumns({"_commas": commas, "_low": F.coalesce(F.min(F.col("closed") + F.col("depth")).over(ahead), F.lit(1)), "_root": F.first("root").over(order)})
    begun = F.when(F.col("depth") > 0, 1).otherwise(0)
    seen = seen.withColumn("position", F.coalesce(F.sum("_commas").over(ahead), F.lit(0)) + begun)
    live = seen.where((F.col("start") == 0) | (F.col("_root") & (F.col("_low") > 0)))
    ranges = live.select("path", "start", (F.col("start") + step).alias("stop"), "inside", "depth", "position")
    return single.unionByName(ranges)


def read_items(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, position, item, error)`` of files ``(path, length)`` that hold one array each.

    A large array is read in ranges by many tasks; an item belongs to the range it begins in.
    """

    def rows(ranges):
        for path, start, stop, inside, depth, position in ranges:
            with open_at(path) as file:
                escaped = ends_escaped(file, start)
                file.seek(start)
                yield from ((path, *found) for found in owned_items(file, start, stop, inside, depth, position, escaped))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _batched(rows(batch.itertuples(index=False)))

    width = max(1, files.sparkSession.sparkContext.defaultParallelism)
    return array_ranges(files, range_bytes).repartition(width, "path", "start").mapInPandas(read, ITEM)


def read_documents(files: DataFrame) -> DataFrame:
    """``(path, position, item, error)`` of files that hold one document each."""

    def rows(paths):
        for path in paths:
            with open_stream(path) as stream:
                yield (path, 0, *whole_document(stream))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _batched(rows(batch["path"]))

    return over_paths(files).mapInPandas(read, ITEM)
