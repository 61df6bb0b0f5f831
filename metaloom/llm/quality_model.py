"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), in time linear
in the distinct words. Inputs are the text alone: hashed words (by case), statistics of its
characters, words and lines, each also as a bin, and the bin of its length.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import carried
from .texts import BLOCK, Block, blocks, byte_class, counts_of, span_hash, words

BITS = 15
WORDS = 1 << BITS
BINS = 12
FACTORS = 8
#: Statistics: name and the scale that maps usual values to 0..1.
STATS = [
    ("symbols", 8.0), ("upper", 2.0), ("digits", 8.0), ("marks", 4.0), ("other_bytes", 4.0), ("blanks", 3.0),
    ("word_length", 0.08), ("again", 4.0), ("distinct", 1.0), ("shouted", 2.0), ("with_symbol", 1.5), ("bare_symbol", 3.0),
    ("line_words", 0.02), ("log_words", 0.1),
]
SIZE = WORDS + len(STATS) * (BINS + 1)
_SYMBOL = byte_class((0x23, 0x26), (0x2A, 0x2A), (0x7C, 0x7C), (0x3C, 0x3C), (0x3E, 0x3E))
_UPPER, _LOWER = byte_class((0x41, 0x5A)), byte_class((0x61, 0x7A))
_DIGIT, _HIGH = byte_class((0x30, 0x39)), byte_class((0x80, 0xFF))
_MARK = byte_class((0x21, 0x22), (0x27, 0x29), (0x2B, 0x2F), (0x3A, 0x3B), (0x3F, 0x3F))
_BLANK = byte_class((0x09, 0x0D), (0x20, 0x20))


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the block, sorted by row."""
    rows = block.rows
    starts, ends, row = words(block)
    sums = {}
    for name, table in (("symbols", _SYMBOL), ("upper", _UPPER), ("lower", _LOWER), ("digits", _DIGIT), ("marks", _MARK), ("other_bytes", _HIGH), ("blanks", _BLANK)):
        sums[name] = np.concatenate([[0], np.cumsum(table[block.data])])
    size = np.maximum(np.diff(block.offsets), 1)
    n = np.maximum(counts_of(row, rows), 1)
    hashed = span_hash(block.data, starts, ends, fold=False)
    key, count = np.unique((row.astype(np.int64) << BITS) | (hashed >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    owner = key >> BITS
    value = np.log1p(count).astype(np.float32)
    norm = np.sqrt(np.bincount(owner, value.astype(np.float64) ** 2, rows)) + 1e-9
    value /= norm[owner].astype(np.float32)
    within = {k: s[ends] - s[starts] for k, s in sums.items() if k in ("symbols", "upper", "lower")}
    stats = {k: (s[block.offsets[1:]] - s[block.offsets[:-1]]) / size for k, s in sums.items() if k != "lower"}
    stats["word_length"] = np.bincount(row, ends - starts, rows) / n
    again = np.zeros(rows)
    if len(row) > 1:
        same = (hashed[1:] == hashed[:-1]) & (row[1:] == row[:-1])
        again = np.bincount(row[1:], same, rows)
    stats["again"] = again / n
    stats["distinct"] = counts_of(owner, rows) / n
    stats["shouted"] = np.bincount(row, (within["upper"] > 1) & (within["lower"] == 0), rows) / n
    stats["with_symbol"] = np.bincount(row, within["symbols"] > 0, rows) / n
    stats["bare_symbol"] = np.bincount(row, within["symbols"] == ends - starts, rows) / n
    breaks = np.concatenate([[0], np.cumsum(block.data == 10)])
    stats["line_words"] = n / (breaks[block.offsets[1:]] - breaks[block.offsets[:-1]] + 1)
    stats["log_words"] = np.log1p(n)
    parts = [(owner, key & (WORDS - 1), value)]
    every = np.arange(rows)
    for j, (name, scale) in enumerate(STATS):
        x = np.clip(stats[name] * scale, 0, 1)
        base = WORDS + j * (BINS + 1)
        parts.append((every, np.full(rows, base), x.astype(np.float32)))
        parts.append((every, base + 1 + np.minimum((x * BINS).astype(np.int64), BINS - 1), np.full(rows, 0.5, np.float32)))
    owner, feature, value = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(owner, kind="stable")
    return owner[order], feature[order], value[order]


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, begins: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """One logit per segment of (feature, value)."""
        x = value[:, None]
        v = self.factors[feature] * x
        total = np.add.reduceat(v, begins)
        square = np.add.reduceat(v * v, begins)
        return self.bias + np.add.reduceat(self.linear[feature] * value, begins) + 0.5 * (total * total - square).sum(1)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, batch: int = 64, rate: float = 0.05, decay: float = 1e-5) -> Machine:
    """Adagrad on the logistic loss, classes weighed equally; rows are (features, values, label)."""
    rng = np.random.default_rng(5)
    n1 = sum(y for _, _, y in rows)
    n0 = len(rows) - n1
    machine = Machine(float(np.log((n1 + 1) / (n0 + 1))), np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32))
    if not n0 or not n1:
        machine.factors[:] = 0
        return machine
    machine.bias = 0.0
    weight = {0: len(rows) / (2 * n0), 1: len(rows) / (2 * n1)}
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-3, np.float32), np.full((SIZE, FACTORS), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = [rows[i] for i in order[at : at + batch]]
            size = np.array([len(f) for f, _, _ in some])
            feature, value = np.concatenate([f for f, _, _ in some]), np.concatenate([x for _, x, _ in some])
            y = np.array([y for _, _, y in some], np.float32)
            begins = np.concatenate([[0], np.cumsum(size)[:-1]])
            v = machine.factors[feature] * value[:, None]
            total = np.add.reduceat(v, begins)
            logit = machine.logits(begins, feature, value)
            slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * np.array([weight[int(t)] for t in y]) / len(some)
            each = np.repeat(slope, size).astype(np.float32)
            touched, where = np.unique(feature, return_inverse=True)
            gw = np.bincount(where, each * value).astype(np.float32) + decay * machine.linear[touched]
            inner = each[:, None] * value[:, None] * (np.repeat(total, size, axis=0) - v)
            gv = np.stack([np.bincount(where, inner[:, f]) for f in range(FACTORS)], 1).astype(np.float32) + decay * machine.factors[touched]
            seen_w[touched] += gw * gw
            seen_v[touched] += gv * gv
            seen_b += float(slope.sum()) ** 2
            machine.linear[touched] -= rate * gw / np.sqrt(seen_w[touched])
            machine.factors[touched] -= rate * gv / np.sqrt(seen_v[touched])
            machine.bias -= rate * float(slope.sum()) / seen_b**0.5
    return machine


def _extract(batches):
    for batch in batches:
        for block in blocks(batch.column(1), BLOCK // 4):
            owner, feature, value = features(block)
            at = np.searchsorted(owner, np.arange(block.rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(block.first, block.rows), pa.ListArray.from_arrays(pa.array(at), pa.array(feature.astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(at), pa.array(value)),
            ], ["row", "feature", "value"])


def _score(batches, machine: Machine):
    for batch in batches:
        for block in blocks(batch.column(1), BLOCK // 4):
            owner, feature, value = features(block)
            logit = machine.logits(np.searchsorted(owner, np.arange(block.rows)), feature, value)
            score = 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(score)], ["row", "score"])


def held_out(column):
    """Rows whose labels are never learnt: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Machine:
    """Fit on at most ``sample`` labelled documents that are not held out, the first by a hash of their id.

    Labels other than 0 and 1 and null ids are passed over; of repeated labels the
    smaller counts. Without labels of both classes the score is constant.
    """
    wanted = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .where("label in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = carried(known, _extract, "feature array<int>, value array<float>", keep=["doc_id", "label"])
    found = rows.select("row.doc_id", "row.label", "feature", "value").orderBy("doc_id").toArrow().combine_chunks()
    lists = [found[c].combine_chunks() if found[c].num_chunks else None for c in ("feature", "value")]
    if lists[0] is None:
        return fit([])
    at = lists[0].offsets.to_numpy()
    feature, value = (x.values.to_numpy() for x in lists)
    label = found["label"].to_pylist()
    return fit([(feature[s:e].astype(np.int64), value[s:e], y) for s, e, y in zip(at, at[1:], label)])


def score(docs: DataFrame, machine: Machine, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (text, ...) to (row, score): every whole text between 0 and 1; null and empty texts have a score too.

    Other columns are carried in ``row``, whatever their names; equal texts have equal
    scores; an empty table gives no rows.
    """
    return carried(docs, partial(_score, machine=machine), "score double", keep=keep)
