"""Benchmark decontamination: training words streamed through a suffix automaton of the test items.

Items are cut into groups of a bounded number of words; each group has its own automaton,
which a task builds from the group's rows. A document meets every group, its text passes
a bigram filter first: a match of the shortest window lies inside a run of word pairs
that all occur in items, so only such runs are streamed word by word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .automaton import SuffixAutomaton
from .tables import carried, carried_type, whole_row
from .texts import ALNUM, Block, blocks, chain, counts_of, span_hash, words

#: Words: everything but the ASCII characters outside 0-9 and a-z, after A-Z are lower-cased.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {i: i + 32 for i in range(65, 91)}
#: Words of items in one automaton, of which a task holds one at a time: about 1.1 KB a word.
GROUP_WORDS = 200_000

HITS = "n_words long, n_hit long, items array<string>, longest long, spans array<struct<start:long,end:long>>, left_over string"
GROUP_HITS = "at long, hit array<long>, items array<string>, longest long, spans array<struct<start:long,end:long>>"
NAMES = ["n_words", "n_hit", "items", "longest", "spans", "left_over"]


def normalised(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_UPPER))


class Scanner:
    """Finds the occurrences of one group of items in blocks of documents."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        sequences = [(name, normalised(text)) for name, text in items]
        self.machine = SuffixAutomaton(sequences, window)
        vocabulary = sorted({w for _, s in sequences for w in s})
        single = self._hash(vocabulary)
        self.single = np.sort(single)
        code = dict(zip(vocabulary, single))
        pairs = {(code[a], code[b]) for _, s in sequences for a, b in zip(s, s[1:])}
        left = np.array([a for a, _ in pairs], np.uint64)
        right = np.array([b for _, b in pairs], np.uint64)
        self.pairs = np.sort(chain([left, right]))

    @staticmethod
    def _hash(vocabulary: list[str]) -> np.ndarray:
        raw = [w.encode() for w in vocabulary]
        ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        return span_hash(data, np.concatenate([[0], ends])[:-1].astype(np.int64), ends)

    @staticmethod
    def _among(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(sorted_):
            return np.zeros(len(values), bool)
        return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values

    def scan(self, block: Block):
        """Per document: words, and {row: (hit word numbers, items, longest match, byte spans)}."""
        starts, ends, row = words(block, ALNUM)
        n = counts_of(row, block.rows)
        least = self.machine.least
        found: dict[int, list] = {}
        if not len(starts) or not len(self.single):
            return n, found
        known = span_hash(block.data, starts, ends)
        if least > 1:
            linked = self._among(self.pairs, chain([known[:-1], known[1:]])) & (row[1:] == row[:-1])
            edges = np.flatnonzero(np.diff(np.concatenate([[0], linked.astype(np.int8), [0]])))
            runs = [(a, b + 1) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least - 1]
        else:
            among = self._among(self.single, known)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], among.astype(np.int8), [0]])))
            cuts = [(a, b) for a, b in zip(edges[::2], edges[1::2])]
            runs = []
            for a, b in cuts:
                inner = np.flatnonzero(row[a + 1 : b] != row[a : b - 1]) + a + 1
                bounds = [a, *inner, b]
                runs += list(zip(bounds, bounds[1:]))
        for a, b in runs:
            texts = [block.data[starts[i] : ends[i]].tobytes().lower().decode("utf-8", "replace") for i in range(a, b)]
            for at, length, hits in self.machine.stream(texts):
                entry = found.setdefault(int(row[a]), [set(), set(), 0, []])
                size = max(s for s, _ in hits)
                entry[0].update(range(a + at - size + 1, a + at + 1))
                for _, names in hits:
                    entry[1] |= names
                entry[2] = max(entry[2], length)
                entry[3].append((int(starts[a + at - size + 1]), int(ends[a + at])))
        return n, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans joined."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans; a blank stands for each removed span between other text."""
    parts, at = [], 0
    for s, e in spans:
        parts.append(raw[at:s])
        at = e
    parts.append(raw[at:])
    return b" ".join(p.strip(b" ") for p in parts if p.strip(b" "))


def _judged(block: Block, total: np.ndarray, found: dict[int, list], length_limit: int, coverage: float) -> list[pa.Array]:
    """The columns of ``HITS`` from each row's [hit words, items, longest match, spans]."""
    n_hit, items, longest_, spans_, texts = [], [], [], [], []
    for r in range(block.rows):
        hit, names, longest, spans = found.get(r, (set(), set(), 0, []))
        at = int(block.offsets[r])
        cut = merged([(s - at, e - at) for s, e in spans])
        n_hit.append(len(hit))
        items.append(sorted(names))
        longest_.append(longest)
        spans_.append([{"start": s, "end": e} for s, e in cut])
        if hit and (longest >= length_limit or len(hit) >= coverage * total[r]):
            gone = len(hit) >= coverage * total[r]
            texts.append("" if gone else without(block.raw(r), cut).decode("utf-8", "replace"))
        else:
            texts.append(block.text(r))
    return [
        pa.array(total), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(longest_, pa.int64()),
        pa.array(spans_, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(texts, pa.string()),
    ]


def _scan(batches, items, window, length_limit, coverage):
    scanner = Scanner(items, window)
    for batch in batches:
        for block in blocks(batch.column(1)):
            found = _judged(block, *scanner.scan(block), length_limit, coverage)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), *found], ["row", *NAMES])


def _scan_group(batches, items, window):
    """(at, hit, items, longest, spans) of the rows in which items of one group occur; hits are word numbers of the row."""
    scanner = Scanner(items, window)
    for batch in batches:
        for block in blocks(batch.column(1)):
            n, found = scanner.scan(block)
            first = np.cumsum(n) - n
            rows = sorted(found)
            ats = batch.column(0).slice(block.first, block.rows).to_numpy()[rows] if rows else np.zeros(0, np.int64)
            spans = [[{"start": s - int(block.offsets[r]), "end": e - int(block.offsets[r])} for s, e in merged(found[r][3])] for r in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array(ats, pa.int64()), pa.array([sorted(int(w - first[r]) for w in found[r][0]) for r in rows], pa.list_(pa.int64())),
                pa.array([sorted(found[r][1]) for r in rows], pa.list_(pa.string())), pa.array([found[r][2] for r in rows], pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ], ["at", "hit", "items", "longest", "spans"])


def _merge(batches, length_limit, coverage):
    for batch in batches:
        hits = batch.column(2)
        for block in blocks(batch.column(1)):
            total = counts_of(words(block, ALNUM)[2], block.rows)
            found = {}
            for r in range(block.rows):
                for h in hits[block.first + r].as_py() or ():
                    entry = found.setdefault(r, [set(), set(), 0, []])
                    entry[0].update(h["hit"])
                    entry[1].update(h["items"])
                    entry[2] = max(entry[2], h["longest"])
                    entry[3] += [(s["start"] + int(block.offsets[r]), s["end"] + int(block.offsets[r])) for s in h["spans"]]
            columns = _judged(block, total, found, length_limit, coverage)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), *columns], ["row", *NAMES])


def _plain(items: DataFrame) -> DataFrame:
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.where("item_id is not null and text is not null").distinct()


def _size(items: DataFrame) -> int:
    return _plain(items).agg(F.sum(F.length("text"))).first()[0] or 0


def item_groups(items: DataFrame, limit: int = GROUP_WORDS) -> list[list[tuple[str, str]]]:
    """The items as one group of at most ``limit`` words; more is refused, see ``split_items``."""
    size = _size(items)
    if size > 6 * limit:
        raise ValueError(f"{size} characters of items: split the table and scan it in parts")
    return [sorted((r["item_id"], r["text"]) for r in _plain(items).collect())]


def split_items(items: DataFrame, limit: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The items with a ``bucket`` by hash, written, and ranges of buckets of at most ``limit`` words (one item may be more)."""
    n = 16 * -(-_size(items) // (6 * limit))
    rows = written(_plain(items).withColumn("hash", F.xxhash64("item_id", "text")), "items")
    while True:
        dealt = rows.withColumn("bucket", F.pmod("hash", F.lit(n)))
        sizes = sorted(dealt.groupBy("bucket").agg(F.sum(F.length("text")), F.countDistinct("hash")).collect())
        if all(chars <= 6 * limit or items_ == 1 for _, chars, items_ in sizes):
            break
        n *= 2
    ranges: list[list[int]] = []
    room = -1
    for bucket, chars, _ in sizes:
        if chars > room:
            ranges.append([bucket, bucket])
            room = 6 * limit
        ranges[-1][1] = bucket
        room -= chars
    return dealt, [(a, b) for a, b in ranges]


def scan_items(
    spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = 10, length_limit: int = 10, coverage: float = 0.5,
    keep: list[str] | None = None, limit: int = GROUP_WORDS,
) -> DataFrame:
    """``docs`` (text, ...) against ``items`` (item_id, text): (row, n_words, n_hit, items, longest, spans, left_over).

    ``row`` holds the document's columns ``keep`` (all). ``n_hit`` words lie inside an occurrence of
    ``window`` consecutive item words (of a whole item that has fewer); ``items`` lists the
    items with occurring windows, ``spans`` the byte ranges, ``longest`` the longest match.
    ``left_over`` is the text that remains: spans go when a match reaches ``length_limit``,
    and the whole text when ``coverage`` of its words are hit. Null texts have no words;
    null items and item ids are no items; a repeated item counts once; empty tables give
    no rows or no hits; other columns of either table are carried or ignored. Items of more
    than ``limit`` words are scanned group by group and their hits merged.
    """
    if _size(items) <= 6 * limit:
        work = partial(_scan, items=item_groups(items, limit)[0], window=window, length_limit=length_limit, coverage=coverage)
        return carried(docs, work, HITS, keep=keep)
    numbered = docs.select(F.monotonically_increasing_id().alias("at"), whole_row(docs, keep).alias("row"), F.col("text").cast("string").alias("text"))
    numbered = written(numbered, "numbered")
    dealt, ranges = split_items(items, limit)
    found = []
    for first, last in ranges:  # one group at a time in the driver and in each task
        group = sorted((r["item_id"], r["text"]) for r in dealt.where(F.col("bucket").between(first, last)).collect())
        hits = numbered.select("at", "text").mapInArrow(partial(_scan_group, items=group, window=window), GROUP_HITS)
        found.append(written(hits, "hits"))
    hits = reduce(DataFrame.union, found).groupBy("at").agg(F.collect_list(F.struct("hit", "items", "longest", "spans")).alias("hits"))
    joined = numbered.join(hits, "at", "left").select("row", "text", "hits")
    return joined.mapInArrow(partial(_merge, length_limit=length_limit, coverage=coverage), carried_type(docs, HITS, keep))
