"""Byte-pair encoding of content-defined chunks: each chunk once, joins repaired until they agree.

A rolling hash over the last ``WINDOW`` bytes cuts a text wherever its leading bits are zero, so
equal passages fall into equal chunks wherever they stand. A worker encodes a chunk once and
keeps its ids by its bytes, in bounded memory.

At a join the words around the cut are encoded again, across it and on either side by
themselves. The join is repaired if the ids across agree with the chunks' own ids over a whole
word on both sides; then they replace the ids of the words that the cut may have torn.
Where they do not agree, or a chunk has too few words, its cut is given up, the longer chunk is
encoded, and the joins are looked at again until all agree. A text without blanks ends as one chunk.
"""

from __future__ import annotations

import sys
import types
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .packing import _lists as id_lists
from .tables import carried
from .texts import Block, blocks, byte_class, byte_hashes, mix, powers
from .tokens import default_path, shared_encoder

WINDOW = 24
#: A cut needs this many zero bits: chunks of about 2^BITS bytes, of LEAST at least.
BITS = 10
LEAST = 256
#: Bytes of chunks that a worker process keeps.
HELD = 24 << 20
_BLANK = byte_class((0x20, 0x20), (0x09, 0x0A), (0x0D, 0x0D))


class Chunks:
    """Ids of the chunks that this worker process has met."""

    def __init__(self, path: str):
        self.encoder = shared_encoder(path)
        self.ids: dict[bytes, np.ndarray] = {}
        self.held = 0

    def of(self, spans: list[bytes]) -> list[np.ndarray]:
        """The ids of every chunk; those not met before are encoded together, each once."""
        new = [s for s in dict.fromkeys(spans) if s not in self.ids]
        fresh = dict(zip(new, encoded(self.encoder, new)))
        out = [fresh[s] if s in fresh else self.ids[s] for s in spans]
        for s, ids in fresh.items():
            if len(s) > HELD // 64:
                continue
            if self.held + len(s) > HELD:
                self.ids.clear()
                self.held = 0
            self.ids[s] = ids.copy()
            self.held += len(s)
        return out


def shared_chunks(path: str) -> Chunks:
    held = sys.modules.setdefault("_task_chunks", types.ModuleType("_task_chunks")).__dict__
    if path not in held:
        held[path] = Chunks(path)
    return held[path]


def encoded(encoder, spans: list[bytes]) -> list[np.ndarray]:
    """The ids of every span by itself."""
    if not spans:
        return []
    at = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int64)
    return encoder.encode(Block(0, at, np.frombuffer(b"".join(spans), np.uint8)))


def cut_places(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, bits: int = BITS) -> np.ndarray:
    """Ends of the chunks of every row in order: places that the bytes before them choose, and row ends."""
    n = len(data)
    marks = np.zeros(0, np.int64)
    if n > WINDOW:
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte_hashes[data] * up[:n], out=sums[1:])
        rolled = mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: n + 1 - WINDOW])
        marks = np.flatnonzero(rolled >> np.uint64(64 - bits) == 0) + WINDOW
        marks = marks[marks < n]
        marks = marks[(data[marks] & 0xC0) != 0x80]  # never inside a character
    places, candidates = [], marks.tolist()
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if end == start:
            continue
        i = bisect_left(candidates, start + least)
        while i < len(candidates) and candidates[i] < end:
            places.append(candidates[i])
            i = bisect_left(candidates, candidates[i] + least, i)
        places.append(end)
    return np.array(places, np.int64)


def block_ids(block: Block, chunks: Chunks, least: int = LEAST, bits: int = BITS) -> list[np.ndarray]:
    """The ids of every row of the block."""
    data, offsets = block.data, block.offsets
    ends = cut_places(data, offsets, least, bits)
    raw = data.tobytes()
    blank = _BLANK[data]
    word_starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    word_ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    row_ends = offsets[1:][np.diff(offsets) > 0]
    while True:
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        joins = np.flatnonzero(~np.isin(ends, row_ends))  # join i lies between chunks i and i + 1
        repair, bad = _repairs(raw, chunks, starts, ends, joins, word_starts, word_ends)
        if not len(bad):
            break
        ends = np.delete(ends, bad)
    ids = chunks.of([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
    pieces: list[np.ndarray] = []
    stop = np.searchsorted(ends, offsets[1:], "right")
    out, i = [], 0
    for r in range(block.rows):
        pieces = []
        while i < stop[r]:
            left, right = repair.get(i - 1), repair.get(i)
            own = ids[i]
            pieces.append(own[(left[2] if left else 0) : len(own) - (right[0] if right else 0)])
            if right:
                pieces.append(right[1])
            i += 1
        out.append(np.concatenate(pieces) if pieces else np.zeros(0, np.uint32))
    return out


def _repairs(raw: bytes, chunks: Chunks, starts, ends, joins, word_starts, word_ends) -> tuple[dict, np.ndarray]:
    """By join: ids that its left chunk loses, the ids across, ids that its right chunk loses; and joins that fail."""
    cut = ends[joins]
    before = np.searchsorted(word_starts, cut) - 2
    after = np.searchsorted(word_ends, cut)
    room = (before >= 0) & (after + 1 < len(word_ends))
    low = np.where(room, word_starts[np.maximum(before, 0)] if len(word_starts) else 0, -1)
    high = np.where(room, word_ends[np.minimum(after + 1, len(word_ends) - 1)] if len(word_ends) else 0, -1)
    room &= (low >= starts[joins]) & (high <= ends[np.minimum(joins + 1, len(ends) - 1)])
    # the words of one join must not reach into those of the join before it
    room[1:] &= ~((joins[1:] == joins[:-1] + 1) & room[:-1] & (high[:-1] > low[1:]))
    bad, repair = [int(j) for j in joins[~room]], {}
    some = np.flatnonzero(room)
    if len(some):
        lows, cuts, highs = low[some].tolist(), cut[some].tolist(), high[some].tolist()
        seconds = word_starts[before[some] + 1].tolist()
        firsts = word_ends[after[some]].tolist()
        spans = [s for a, m, b, c, d in zip(lows, cuts, highs, seconds, firsts) for s in (raw[a:m], raw[m:b], raw[a:b], raw[a:c], raw[d:b])]
        ids = encoded(chunks.encoder, spans)
        held = joins[some]
        own = chunks.of([raw[a:b] for j in held.tolist() for a, b in ((starts[j], ends[j]), (starts[j + 1], ends[j + 1]))])
        for i, j in enumerate(held.tolist()):
            left, right, across, lead, tail = ids[5 * i : 5 * i + 5]
            a, b = own[2 * i], own[2 * i + 1]
            agrees = (
                _ends_with(a, left) and _starts_with(b, right)
                and _starts_with(left, lead) and _starts_with(across, lead) and _ends_with(right, tail) and _ends_with(across, tail)
            )
            if agrees:
                repair[j] = (len(left), across, len(right))
            else:
                bad.append(j)
    return repair, np.array(sorted(bad), np.int64)


def _starts_with(ids: np.ndarray, head: np.ndarray) -> bool:
    return np.array_equal(ids[: len(head)], head)


def _ends_with(ids: np.ndarray, tail: np.ndarray) -> bool:
    return len(tail) <= len(ids) and np.array_equal(ids[len(ids) - len(tail) :], tail)


def _encode(batches: Iterator[pa.RecordBatch], path: str, least: int, bits: int, decoded: bool) -> Iterator[pa.RecordBatch]:
    chunks = shared_chunks(path)
    names = ["row", "ids", "decoded"] if decoded else ["row", "ids"]
    for batch in batches:
        for block in blocks(batch.column(1)):
            ids = block_ids(block, chunks, least, bits)
            columns = [batch.column(0).slice(block.first, block.rows), id_lists([x.view(np.int32) for x in ids])]
            if decoded:
                library = chunks.encoder.tokenizer
                columns.append(pa.array([library.decode(x.tolist(), skip_special_tokens=False) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokenizer = shared_encoder(path).tokenizer
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            texts = [tokenizer.decode(ids or [], skip_special_tokens=False) for ids in some.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string())], ["row", "ids", "decoded"])


def encode(
    docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None, least: int = LEAST, bits: int = BITS,
    decoded: bool = False,
) -> DataFrame:
    """(row, ids): the columns ``keep`` (all by default) of every row and the ids of its whole text.

    With ``decoded`` the text that :func:`decode` makes of the ids follows, in the same pass.

    The ids are those of the tokenizers library without special tokens added. A null or empty text has
    none. Rows stay as they are, repeated ones too; columns may have any name. An empty table gives no rows.
    """
    return carried(docs, partial(_encode, path=path or default_path(), least=least, bits=bits, decoded=decoded), "ids array<int>" + ", decoded string" * decoded, text, keep)


def decode(found: DataFrame, path: str | None = None) -> DataFrame:
    """(row, ids, decoded): what the library makes of the ids, special tokens included; null ids give an empty text."""
    pairs = found.select("row", "ids")
    return pairs.mapInArrow(partial(_decode, path=path or default_path()), StructType([*pairs.schema.fields]).add("decoded", "string"))
