"""Secrets: pattern matches, and runs that a character Markov model of random strings explains better.

Two first-order models over ASCII characters, one of random strings and one of ordinary
identifiers, are trained from labelled samples. A run of identifier characters is a
secret when its log-likelihood ratio per character reaches a threshold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import carried
from .texts import Block, blocks, byte_class, words

#: Fixed patterns; on UTF-8 bytes they find what they find on text, as they name ASCII only.
ASSIGN = re.compile(rb"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")
KINDS = ["assign", "access", "hex", "random"]
LEAST = {"assign": 6, "access": 20, "hex": 24}
_HEX = byte_class((0x30, 0x39), (0x61, 0x66))
#: Characters of identifiers and keys, and the length from which a run is judged.
RUN = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x2B, 0x2B), (0x5F, 0x5F), (0x3D, 0x3D), (0x2D, 0x2D))
RUN_LEAST = 16
THRESHOLD = 0.9
ALPHABETS = ["0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+_-"]
SPANS = "spans array<struct<kind:string,start:long,end:long>>"


def random_samples(n: int = 2000) -> list[str]:
    """Labelled random strings: ``n`` of each alphabet, 16 to 48 characters, from a fixed seed."""
    rng = np.random.default_rng(9)
    return ["".join(rng.choice(list(a), rng.integers(16, 49))) for a in ALPHABETS for _ in range(n)]


@dataclass
class Ratio:
    """log p_random(b | a) - log p_ordinary(b | a) for ASCII codes a, b."""

    table: np.ndarray

    @classmethod
    def of(cls, random: np.ndarray, ordinary: np.ndarray) -> Ratio:
        """From transition counts, smoothed by one half and by each model's own character shares."""
        logs = []
        for counts in (random, ordinary):
            share = (counts.sum(0) + 0.5) / (counts.sum() + 64)
            logs.append(np.log((counts + 20 * share) / (counts.sum(1, keepdims=True) + 20)))
        table = logs[0] - logs[1]
        full = np.zeros((256, 256))
        full[:128, :128] = table
        return cls(full)


def transitions(runs: list[bytes]) -> np.ndarray:
    """128 x 128 transition counts of ASCII runs."""
    data = np.frombuffer(b"\xff".join(runs), np.uint8).astype(np.int64)
    a, b = data[:-1], data[1:]
    fine = (a < 128) & (b < 128)
    return np.bincount(a[fine] * 128 + b[fine], minlength=128 * 128).reshape(128, 128).astype(float)


def base_spans(block: Block) -> list[list[tuple[int, int, int]]]:
    """Per row the (byte start, byte end, kind number) of the fixed patterns."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(block.rows)]
    starts, ends, row = words(block, _HEX)
    for i in np.flatnonzero(ends - starts >= LEAST["hex"]):
        at = int(block.offsets[row[i]])
        out[row[i]].append((int(starts[i]) - at, int(ends[i]) - at, 2))
    for r in range(block.rows):
        raw = block.raw(r)
        low = raw.lower()
        if any(h in low for h in ASSIGN_HINTS):
            out[r] += [(*m.span(), 0) for m in ASSIGN.finditer(raw) if len(m[1]) >= LEAST["assign"]]
        if b"AKIA" in raw:
            out[r] += [(*m.span(), 1) for m in ACCESS.finditer(raw) if len(m[0]) >= LEAST["access"]]
    return out


def _scan(batches, ratio: Ratio, threshold: float):
    for batch in batches:
        for block in blocks(batch.column(1)):
            found = base_spans(block)
            starts, ends, row = words(block, RUN)
            long_ = ends - starts >= RUN_LEAST
            starts, ends, row = starts[long_], ends[long_], row[long_]
            if len(starts):
                steps = np.concatenate([[0], np.cumsum(ratio.table[block.data[:-1], block.data[1:]])])
                mean = (steps[ends - 1] - steps[starts]) / (ends - 1 - starts)
                for i in np.flatnonzero(mean >= threshold):
                    at = int(block.offsets[row[i]])
                    s, e = int(starts[i]) - at, int(ends[i]) - at
                    if all(e <= a or s >= b for a, b, _ in found[row[i]]):
                        found[row[i]].append((s, e, 3))
            spans = []
            for r, hits in enumerate(found):
                if hits:
                    lead = (block.data[block.offsets[r] : block.offsets[r + 1]] & 0xC0) != 0x80
                    place = np.concatenate([[0], np.cumsum(lead)])
                    hits = sorted((int(place[s]), k, int(place[e])) for s, e, k in hits)
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in hits])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(spans, kind)], ["row", "spans"])


def _learn(batches):
    """Transition counts of ordinary runs (label 0) and of the strings the patterns find (label 1)."""
    total = np.zeros((2, 128, 128))
    for batch in batches:
        for block in blocks(batch.column(1)):
            base = base_spans(block)
            inside = np.zeros(len(block.data) + 1, np.int32)
            for r, hits in enumerate(base):
                at = int(block.offsets[r])
                for s, e, _ in hits:
                    inside[at + s] += 1
                    inside[at + e] -= 1
            secret = np.cumsum(inside) > 0
            starts, ends, _ = words(block, RUN)
            for label, runs in ((0, ~secret[starts]), (1, secret[ends - 1] & (ends - starts >= 8))):
                total[label] += transitions([block.data[s:e].tobytes() for s, e in zip(starts[runs], ends[runs])] or [b""])
    at = np.flatnonzero(total.ravel())
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at].astype(np.int64))], ["at", "n"])


def train(spark: SparkSession, docs: DataFrame) -> Ratio:
    """Models from all documents and seeded random strings.

    What the patterns match is labelled secret, the other runs ordinary. A task gives its
    counts of transitions, so what is gathered does not grow with the documents.
    """
    counted = docs.select(F.lit(None).cast("long").alias("none"), F.col("text").cast("string").alias("text")).mapInArrow(_learn, "at long, n long")
    total = np.zeros(2 * 128 * 128)
    for row in counted.groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[row["at"]] = row["n"]
    ordinary, secret = total.reshape(2, 128, 128)
    seeded = transitions([s.encode() for s in random_samples()])
    return Ratio.of(seeded + secret, ordinary)


def secrets(docs: DataFrame, ratio: Ratio, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (text, ...) to (row, spans): kind, start and end in code points, by start, then kind.

    Pattern spans may overlap each other; a model span is a whole run of 16 or more
    identifier characters that touches none of them. Null and empty texts have no spans;
    other columns are carried in ``row``; an empty table gives no rows.
    """
    return carried(docs, partial(_scan, ratio=ratio, threshold=threshold), SPANS, keep=keep)
