"""Line dedup with a log-template tree.

A line's tokens lead down a tree of fixed depth: token count, then the leading tokens. In a
leaf, lines that agree in all constant places are one template. A place is variable if it holds a
field: a token with a digit (number, date, id), an address or a path. Half of the places, and
two at least, have to be constant: a line of more fields is a template of its own text, so
number tables are no one template, nor are lines that only begin alike. A template that recurs across unlike documents is boilerplate and its lines go.
Unlike are documents whose other lines have less than half of their three-word runs in
common, so any number of copies and near copies counts once.
"""

from __future__ import annotations

import itertools
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import carried_type, whole_row
from .texts import Block, blocks, byte_class, chain, counts_of, mix, span_hash, words

DEPTH = 4
MIN_TOKENS = 3
BINS = 64
#: Contexts that agree in this share of their bins are those of copies.
ALIKE = 0.5
#: Bytes that make a token a field: digits, @ and /.
_FIELD = byte_class((0x30, 0x39), (0x40, 0x40), (0x2F, 0x2F))
#: Parts that the contexts of a template are dealt to, by what they hold.
SALTS = 64


def line_templates(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """For every line with tokens: row, line number, tokens (0 where it can be no template), template; then the
    three-word runs and their lines."""
    starts, ends, row = words(block)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    token = plain = span_hash(block.data, starts, ends)
    fields = np.concatenate([[0], np.cumsum(_FIELD[block.data])])
    field = fields[ends] > fields[starts]
    token = np.where(field, np.uint64(1), token)
    breaks = np.concatenate([[0], np.cumsum(block.data == 10)])
    line = breaks[starts] - breaks[block.offsets[row]]
    opens = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])]))
    size = np.diff(np.append(opens, len(row)))
    place = np.arange(len(row)) - np.repeat(opens, size)
    # the leading tokens in their order, then the rest: a path down the tree and its leaf
    level = np.minimum(place, DEPTH).astype(np.uint64)
    constant = size - np.add.reduceat(field.astype(np.int64), opens)
    token = np.where(np.repeat(constant >= np.maximum(2, (size + 1) // 2), size), token, plain)
    part = mix(mix(token + level) + mix(place.astype(np.uint64) * np.uint64(2) + np.uint64(3)))
    key = mix(np.add.reduceat(part, opens) + mix(size.astype(np.uint64)))
    owner = np.repeat(np.arange(len(opens)), size)
    run = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else np.zeros(0, np.int64)
    runs = chain([plain[run], plain[run + 1], plain[run + 2]]) if len(run) else np.zeros(0, np.uint64)
    return row[opens], line[opens], np.where(size >= MIN_TOKENS, size, 0), key, (runs, owner[run])


def contexts(runs: np.ndarray, owner: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Per owner (a template in a document, ``row`` ascending) a sketch of the runs that the others of its document own.

    Runs are dealt by hash into ``BINS`` bins; of the least run in each a byte is kept, 0
    where there is none. The share of bins in which two sketches agree estimates the
    Jaccard similarity of the runs.
    """
    out = np.zeros((len(row), BINS), np.uint8)
    if not len(runs):
        return out
    runs = mix(runs)
    cell = row[owner] * BINS + (runs >> np.uint64(58)).astype(np.int64)
    order = np.lexsort((runs, cell))
    runs, cell, owner = runs[order], cell[order], owner[order]
    byte = (mix(runs) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    best = np.zeros((int(row[-1]) + 1, BINS), np.uint8)
    best.ravel()[cell[first]] = byte[first]
    out[:] = best[row]
    # an owner of the least run takes the least of the others instead
    foremost = np.repeat(owner[first], np.diff(np.append(first, len(cell))))
    other = np.flatnonzero(owner != foremost)
    out[owner[first], cell[first] % BINS] = 0
    if len(other):
        second = other[np.concatenate([[True], cell[other][1:] != cell[other][:-1]])]
        out[foremost[second], cell[second] % BINS] = byte[second]
    return out


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values))


def _known(batches):
    """(at, templates): the templates of each document, once each."""
    for batch in batches:
        for block in blocks(batch.column(1)):
            row, _, size, key, _ = line_templates(block)
            row, key = row[size > 0], key[size > 0]
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])[: len(row)]
            n = counts_of(row[new], block.rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), _lists(key[new].view(np.int64), n)], ["at", "templates"])


def _emit(batches, min_docs, long_tokens, long_docs):
    """(template, need, context): each template of a document with its context there."""
    for batch in batches:
        for block in blocks(batch.column(0)):
            row, _, size, key, (runs, owner) = line_templates(block)
            if not len(row):
                continue
            order = np.lexsort((key, row))  # lines of one template have one context in a document
            r, k = row[order], key[order]
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(new) - 1
            first = order[new]
            sketch = contexts(runs, number[owner], row[first])
            enough = size[first] > 0
            need = np.where(size[first] >= long_tokens, min(min_docs, long_docs), min_docs)
            yield _entries(key[first][enough].view(np.int64), need[enough].astype(np.int32), sketch[enough])


def _entries(template: np.ndarray, need: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    at = np.arange(len(sketch) + 1, dtype=np.int32) * BINS
    context = pa.Array.from_buffers(pa.binary(), len(sketch), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(sketch))])
    return pa.RecordBatch.from_arrays([pa.array(template), pa.array(need), context], ["template", "need", "context"])


def unlike(sketch: np.ndarray, need: int) -> list[int]:
    """Rows of up to ``need`` sketches of which no two are alike; fewer only if every other is like one of them."""
    out, rest = [], np.arange(len(sketch))
    while len(rest) and len(out) < need:
        lead = sketch[rest[0]]
        out.append(int(rest[0]))
        some = (sketch[rest] != 0) | (lead != 0)
        same = (sketch[rest] == lead) & some
        rest = rest[same.sum(1) < ALIKE * some.sum(1)]
    return out


def _unlike(batches, only_full):
    """Entries sorted by template (and salt) to the unlike ones of each, or the templates that have as many as they need."""
    held = None
    for batch in itertools.chain(_columns(batches), [None]):
        if batch is None:
            if held is None:
                return
            template, need, sketch, salt = held
            cut = len(template)
        else:
            template, need, sketch, salt = batch if held is None else (np.concatenate(x) for x in zip(held, batch))
            cut = 0
        opens = np.flatnonzero(np.concatenate([[True], (template[1:] != template[:-1]) | (salt[1:] != salt[:-1])]))
        ends = np.append(opens[1:], len(template))
        size = ends - opens
        keep = np.zeros(len(template), bool)
        keep[opens] = True
        full = need[opens] <= 1
        for g in np.flatnonzero(size > 1):
            found = unlike(sketch[opens[g] : ends[g]], int(need[opens[g]]))
            keep[opens[g] + np.array(found)] = True
            full[g] = len(found) >= need[opens[g]]
        last = len(template) if cut else int(opens[-1])  # the last template may go on in the next batch
        done = keep.copy()
        done[last:] = False
        if only_full:
            yield pa.RecordBatch.from_arrays([pa.array(template[opens[full & (opens < last)]])], ["template"])
        else:
            yield _entries(template[done], need[done], sketch[done])
        keep[:last] = False
        held = (template[keep], need[keep], sketch[keep], salt[keep])


def _columns(batches):
    for batch in batches:
        if batch.num_rows:
            column = batch.column(2).cast(pa.large_binary())
            at = np.frombuffer(column.buffers()[1], np.int64)[column.offset]
            sketch = np.frombuffer(column.buffers()[2], np.uint8)[at : at + BINS * len(column)].reshape(-1, BINS)
            yield batch.column(0).to_numpy(), batch.column(1).to_numpy(), sketch, batch.column(3).to_numpy()


def _drop(batches):
    for batch in batches:
        recurring = batch.column(2)
        for block in blocks(batch.column(1)):
            row, line, size, key, _ = line_templates(block)
            bounds = np.searchsorted(row, np.arange(block.rows + 1))
            texts, lines, dropped = [], [], []
            for r in range(block.rows):
                text = block.raw(r)
                n = text.count(b"\n") + 1
                known = recurring[block.first + r].as_py()
                gone = 0
                if known:
                    s = slice(bounds[r], bounds[r + 1])
                    hit = np.isin(key[s].view(np.int64), known) & (size[s] > 0)
                    if hit.any():
                        away = set(line[s][hit].tolist())
                        text = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in away)
                        gone = len(away)
                texts.append(text.decode("utf-8", "replace"))
                lines.append(n if len(block.raw(r)) else 0)
                dropped.append(gone)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(block.first, block.rows), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()),
                pa.array(texts, pa.string()),
            ], ["row", "n_lines", "n_dropped", "left_over"])


def drop_recurring_lines(
    spark: SparkSession, docs: DataFrame, min_docs: int = 10, keep: list[str] | None = None, long_tokens: int = 20, long_docs: int = 3,
) -> DataFrame:
    """``docs`` (doc_id, text, ...) to (row, n_lines, n_dropped, left_over); ``row`` holds the columns ``keep`` (all).

    A template recurs when its lines stand in ``min_docs`` unlike contexts, however many
    copies there are of each; one of ``long_tokens`` tokens or more when they stand in
    ``long_docs``. Lines under three tokens are never dropped. A text of nothing else
    becomes empty. Null texts give an empty text and no
    lines; rows that repeat a doc_id count as documents of their own; other columns are
    carried, whatever their names; an empty table gives no rows.

    Contexts are dealt to parts by what they hold and compared in their own order, first
    in each part, then what the parts leave: the result does not depend on the partitions.
    """
    at = F.xxhash64("doc_id")
    text = F.col("text").cast("string").alias("text")
    shape = "template long, need int, context binary"
    entries = docs.select(text).mapInArrow(partial(_emit, min_docs=min_docs, long_tokens=long_tokens, long_docs=long_docs), shape)
    # a common line keeps a few rows of each part, and no task sees all of its contexts
    entries = entries.withColumn("salt", F.pmod(F.xxhash64("context"), F.lit(SALTS)).cast("int"))
    entries = entries.repartition("template", "salt").sortWithinPartitions("template", "salt", "context").mapInArrow(partial(_unlike, only_full=False), shape)
    entries = entries.withColumn("salt", F.lit(0)).repartition("template").sortWithinPartitions("template", "context")
    recurring = entries.mapInArrow(partial(_unlike, only_full=True), "template long")
    found = docs.select(at.alias("at"), text).mapInArrow(_known, "at long, templates array<long>")
    lines = found.select("at", F.explode("templates").alias("template"))
    known = lines.join(recurring, "template").groupBy("at").agg(F.collect_set("template").alias("recurring"))
    rows = docs.select(at.alias("at"), whole_row(docs, keep).alias("row"), text)
    joined = rows.join(known, "at", "left").select("row", "text", "recurring")
    return joined.mapInArrow(_drop, carried_type(docs, "n_lines long, n_dropped long, left_over string", keep))
