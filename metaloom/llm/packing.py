"""Mixture-controlled packing: deficit round-robin over source queues.

Documents are tokenised where they are read; what moves afterwards is a row of a few
numbers per document, never its ids. Rows are dealt by hash into parts of about
``PART`` tokens. A part serves its source queues in turn; each window adds a quantum in
proportion to the target shares, a source sends its deficit and no more (up to the next
place for a cut), the rest of its document waits at the head of the queue, and deficits go
on to the next window. What a part inherits from the parts before it follows from sums:
share times all tokens served so far, less those of the source, within one quantum.

A document may be cut at every ``STEP`` tokens. The checksum of the ids up to each such
place is kept, so the checksum of a piece is two of them and a shift.
"""

from __future__ import annotations

import math
import zlib
from collections import deque
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .texts import BLOCK, blocks
from .tokens import default_path, shared_encoder

STEP = 32
PART = 4_000_000
END = 2
COUNTED = "doc_id long, source string, n long, sums array<int>"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def _tokenise(batches, path, keep):
    encoder = shared_encoder(path)
    for batch in batches:
        for block in blocks(batch.column(1), BLOCK // 4):
            n, sums, all_ids = [], [], []
            for ids in encoder.encode(block):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                n.append(len(ids))
                raw, crc, row = memoryview(ids.tobytes()), 0, []
                for at in range(0, 4 * len(ids), 4 * STEP):
                    crc = zlib.crc32(raw[at : at + 4 * STEP], crc)
                    row.append(crc)
                sums.append(np.array(row, np.uint32).view(np.int32))
                if keep:
                    all_ids.append(ids.view(np.int32))
            columns = [
                batch.column(0).slice(block.first, block.rows), batch.column(2).slice(block.first, block.rows),
                pa.array(n, pa.int64()), _lists(sums),
            ]
            if keep:
                columns.append(_lists(all_ids))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "n", "sums"] + ["ids"] * keep)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows)))


def tokenised(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, source, n, sums[, ids]): tokens of each whole text with the end mark, running checksums."""
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
    )
    return plain.mapInArrow(partial(_tokenise, path=path or default_path(), keep=keep_ids), COUNTED + (", ids array<int>" if keep_ids else ""))


def _shift_tables() -> list[np.ndarray]:
    """For 1, 2, 4, ... tokens: what appending so many zero bytes does to a checksum, byte by byte of it."""
    def times(columns, x):
        out = 0
        for i in range(32):
            if x >> i & 1:
                out ^= columns[i]
        return out

    bit = [0xEDB88320] + [1 << i for i in range(31)]
    for _ in range(5):  # one bit, then doubled five times: 32 bits, one token
        bit = [times(bit, c) for c in bit]
    tables = []
    for _ in range(14):
        tables.append(np.array([[times(bit, v << 8 * b) for v in range(256)] for b in range(4)], np.uint32))
        bit = [times(bit, c) for c in bit]
    return tables


_TABLES: list[np.ndarray] = []


def piece_sums(before: np.ndarray, after: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Checksum of the ids between two places, from the running checksums there."""
    if not _TABLES:
        _TABLES.extend(_shift_tables())
    x = before.astype(np.uint32)
    for bit, table in enumerate(_TABLES):
        moved = table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]
        x = np.where(tokens >> bit & 1, moved, x)
    return (x ^ after.astype(np.uint32)).astype(np.int64)


def _serve(part: pd.DataFrame, size: int) -> pd.DataFrame:
    """Deficit round-robin over the queues of one part."""
    part = part.sort_values(["source", "turn"], kind="stable").reset_index(drop=True)
    queues: dict[str, deque] = {}
    share, deficit = {}, {}
    for i, (source, weight, ahead, served) in enumerate(zip(part["source"], part["share"], part["all_before"], part["own_before"])):
        if source not in queues:
            queues[source] = deque()
            share[source] = weight
            deficit[source] = min(max(weight * ahead - served, -size * weight), size * weight)
        queues[source].append(i)
    n = part["n"].to_numpy()
    names = sorted(queues, key=lambda s: (-deficit[s], s))
    done = dict.fromkeys(names, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    window, offset, turn, idle = 0, 0, 0, 0

    def top_up(room):
        """Credit in proportion to the shares, ``room`` in all."""
        weight = sum(share[s] for s in names)
        quantum = room - sum(deficit[s] for s in names)
        for s in names:
            deficit[s] += quantum * (share[s] / weight if weight else 1 / len(names))

    near = max(STEP, size // 32)
    top_up(size)
    while names:
        s = names[turn % len(names)]
        if deficit[s] <= 0:
            turn, idle = turn + 1, idle + 1
            if idle >= len(names):
                top_up(size - offset)
                idle = 0
            continue
        idle = 0
        room = size - offset
        if room < near:  # the end of a document that leaves least behind the last cut, if one fits
            over = {x: room - int(n[queues[x][0]]) + done[x] for x in names}
            s = min(names, key=lambda x: (over[x] % STEP if over[x] >= 0 else room % STEP, x != s, -deficit[x], x))
        i = queues[s][0]
        left = int(n[i]) - done[s]
        want = left if left <= room < near else min(left, max(math.ceil(deficit[s] / STEP), 1) * STEP)
        take = want if want <= room else room // STEP * STEP
        if take:
            rows.append((i, done[s], take, window, offset))
            deficit[s] -= take
            done[s] += take
            offset += take
        if take == left:
            queues[s].popleft()
            done[s] = 0
            if not queues[s]:
                turn = names.index(s)
                names.remove(s)
        if names and (not take or offset == size):
            window, offset = window + 1, 0
            top_up(size)
    i, start, length, window_, offset_ = (np.array(x, np.int64) for x in zip(*rows))
    sums = part["sums"].to_numpy()

    def running(places):
        return np.array([sums[k][-(-p // STEP) - 1] if p else 0 for k, p in zip(i, places)], np.int32).view(np.uint32)

    before, after = running(start), running(start + length)
    return pd.DataFrame({
        "doc_id": part["doc_id"].to_numpy()[i], "start": start, "length": length, "ids_crc32": piece_sums(before, after, length),
        "doc_tokens": n[i], "sequence_id": (int(part["part"].iloc[0]) << 32) + window_, "offset": offset_,
        "source": part["source"].to_numpy()[i], "no_id": part["no_id"].to_numpy()[i],
    })


def pack(
    spark: SparkSession, docs: DataFrame, size: int = 4096, targets: dict[str, float] | None = None,
    path: str | None = None, part_tokens: int = PART,
) -> DataFrame:
    """``docs`` (doc_id, text, source) to pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source).

    Every id of every document lies in one piece, a sequence holds at most ``size`` ids
    without gaps. ``targets`` weighs the sources (those not named get nothing extra until
    the others run dry); by default the shares of the corpus itself. Null and empty texts
    are one end mark; a null source is a queue of its own (''); repeated rows are packed
    each; a null doc_id is packed and stays null; an empty table gives no rows.
    """
    counted = written(tokenised(docs, path), "counted")
    total = counted.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // part_tokens))
    dealt = counted.withColumn("turn", F.xxhash64("doc_id", "n", "source", F.element_at("sums", -1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("turn"), F.lit(parts)))
    own = dealt.groupBy("part", "source").agg(F.sum("n").alias("own"))
    shares = own.groupBy("source").agg(F.sum("own").alias("whole"))
    if targets is not None:
        weight = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
        shares = shares.withColumn("share", F.coalesce(weight[F.col("source")], F.lit(0.0)) / sum(targets.values()))
    else:
        shares = shares.withColumn("share", F.col("whole") / F.lit(float(max(total, 1))))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = own.groupBy("part").agg(F.sum("own").alias("of_part"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    state = (
        own.withColumn("own_before", F.coalesce(F.sum("own").over(earlier), F.lit(0)))
        .join(shares.select("source", "share"), "source")
        .join(whole.select("part", F.coalesce(F.sum("of_part").over(ahead), F.lit(0)).alias("all_before")), "part")
    )
    rows = dealt.join(state.select("part", "source", "share", "own_before", "all_before"), ["part", "source"])
    # pandas has no null integers: the flag keeps ids exact
    rows = rows.withColumns({"no_id": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})
    pieces = rows.groupBy("part").applyInPandas(lambda part: _serve(part, size), PIECE + ", no_id boolean")
    return pieces.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
