"""Repeated byte runs across documents: suffixes range-partitioned by sampled splitters, sorted, compared.

A byte goes when a 50-byte window over it also starts in a document with a smaller id.
Sorting the suffix of every byte would move the corpus fifty times over, so three exact
reductions come first:

1. Each window is looked after by its anchor, the 16-byte gram of least hash inside it:
   equal windows have equal anchors, and one byte in about 18 is an anchor.
2. Anchors travel as short tags; only those that occur in two documents go on. A false
   match of tags costs work, never a result.
3. Exact copies of a document with a smaller id go whole, without their suffixes.

The suffixes that remain (50 bytes from the anchor on, with the 34 bytes before it) go to
the range of their leading bytes between sampled splitters. A bucket sorts them by
multikey refinement over 8-byte words, takes the common prefixes of neighbours, and finds
for every offset of the anchor in the window which windows a smaller id has too. Suffixes
with equal leading words share a bucket, so no match crosses a boundary but those of
leading words that alone outgrow a bucket: their windows are compared by a shuffle.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .benchmark import merged
from ..session import written
from .texts import Block, blocks, byte_hashes, mix, powers, span_hash

WINDOW = 50
GRAM = 16
LEFT = WINDOW - GRAM
#: Anchors of one tag bucket and suffixes of one range bucket.
TAGS_PER_BUCKET = 2_000_000
SUFFIXES_PER_BUCKET = 100_000
SAMPLE = 2_000
_MANY = 65_535


def anchors(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, row and gram hash of every anchor: the leftmost least gram of some whole window."""
    n = len(block.data)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if n < WINDOW:
        return none
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_hashes[block.data] * up[:-1], out=sums[1:])
    least = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    gram = least
    where = np.arange(len(least), dtype=np.int32 if n < 2**31 else np.int64)
    width = 1
    while width < LEFT + 1:
        step = min(width, LEFT + 1 - width)
        right = least[step:] < least[:-step]
        where = np.where(right, where[step:], where[:-step])
        least = np.where(right, least[step:], least[:-step])
        width += step
    row_of = np.repeat(np.arange(block.rows), np.diff(block.offsets))
    whole = row_of[: n - WINDOW + 1] == row_of[WINDOW - 1 :]
    position = np.unique(where[whole])
    return position.astype(np.int64), row_of[position], gram[position]


def _tagged(gram: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit tag of gram hashes."""
    return ((gram >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (gram & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _emit_tags(batches, buckets: int):
    """Per bucket the tags of a run of documents, each once per document, with the documents' numbers.

    A tag that two documents of the run share is settled here: it goes on once, marked,
    and its documents are told by rows of their own.
    """
    for batch in batches:
        rids = batch.column(0).to_numpy(zero_copy_only=False)
        keys, owners = [], []
        for block in blocks(batch.column(1)):
            _, row, gram = anchors(block)
            if len(row):
                bucket, tag = _tagged(gram, buckets)
                owners.append(row + block.first)
                keys.append((bucket << 32) | tag)
        if not keys:
            continue
        key, owner = np.concatenate(keys), np.concatenate(owners)
        for at in range(0, len(rids), _MANY - 1):
            mine = (owner >= at) & (owner < at + _MANY - 1)
            yield from _tag_rows(key[mine], owner[mine] - at, rids[at : at + _MANY - 1], buckets)


def _tag_rows(key, owner, rids, buckets):
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])[: len(key)]
    key, owner = key[new], owner[new]
    same = np.concatenate([[False], key[1:] == key[:-1]])[: len(key)]
    shared = same | np.append(same[1:], False)
    out = []
    single = ~shared
    key1, owner1 = np.concatenate([key[single], key[shared & ~same]]), np.concatenate([owner[single], np.full((shared & ~same).sum(), _MANY)])
    bucket = key1 >> 32
    order = np.lexsort((owner1, bucket))
    key1, owner1, bucket = key1[order], owner1[order], bucket[order]
    bounds = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        s = slice(bounds[b], bounds[b + 1])
        # only the documents that stand in this bucket, so that rows do not grow with the buckets
        present, place = np.unique(owner1[s], return_inverse=True)
        named = present[present != _MANY]
        place = np.where(place < len(named), place, _MANY)
        out.append((b, rids[named].astype("<i8").tobytes(), place.astype("<u2").tobytes(), key1[s].astype("<u4").tobytes()))
    order = np.argsort(owner[shared], kind="stable")
    told, told_owner = key[shared][order], owner[shared][order]
    rows, first = np.unique(told_owner, return_index=True)
    for r, s, e in zip(rows, first, np.append(first[1:], len(told))):
        out.append((buckets + int(rids[r] % buckets), rids[r : r + 1].astype("<i8").tobytes(), b"", told[s:e].astype("<i8").tobytes()))
    if out:
        yield pa.RecordBatch.from_arrays([
            pa.array([o[0] for o in out], pa.int64()), *[pa.array([o[i] for o in out], pa.binary()) for i in (1, 2, 3)]
        ], ["bucket", "rids", "owners", "tags"])


def _shared_tags(table: pa.Table, buckets: int) -> pa.Table:
    """Which documents hold a tag of the bucket that another document holds too."""
    bucket = table["bucket"][0].as_py()
    rids, found = [], []
    if bucket >= buckets:
        for rid, tags in zip(table["rids"].to_pylist(), table["tags"].to_pylist()):
            rids.append(int(np.frombuffer(rid, "<i8")[0]))
            found.append(np.frombuffer(tags, "<i8"))
    else:
        tag, rid, many = [], [], []
        for r, o, t in zip(table["rids"].to_pylist(), table["owners"].to_pylist(), table["tags"].to_pylist()):
            owner = np.frombuffer(o, "<u2")
            marked = owner == _MANY
            names = np.append(np.frombuffer(r, "<i8"), 0)
            tag.append(np.frombuffer(t, "<u4"))
            many.append(marked)
            rid.append(names[np.where(marked, -1, owner.astype(np.int64))])
        tag, rid, many = (np.concatenate(x) for x in (tag, rid, many))
        order = np.argsort(tag, kind="stable")
        tag, rid, many = tag[order], rid[order], many[order]
        same = np.concatenate([[False], tag[1:] == tag[:-1]])
        hit = (same | np.append(same[1:], False)) & ~many
        tag, rid = tag[hit], rid[hit]
        order = np.argsort(rid, kind="stable")
        tag, rid = tag[order].astype(np.int64) | (bucket << 32), rid[order]
        names, first = np.unique(rid, return_index=True)
        rids = names.tolist()
        found = [tag[s:e] for s, e in zip(first, np.append(first[1:], len(tag)))]
    return pa.table({"rid": pa.array(rids, pa.int64()), "n": pa.array([len(f) for f in found], pa.int64()), "tags": pa.array([f.astype("<i8").tobytes() for f in found], pa.binary())})


def _candidates(block: Block, wanted: list[list[bytes]], buckets: int):
    """Position, row and leading word of the anchors whose tags are wanted, row by row."""
    position, row, gram = anchors(block)
    if not len(position):
        return position, row, np.zeros(0, np.uint64)
    bucket, tag = _tagged(gram, buckets)
    key = (bucket << 32) | tag
    bounds = np.searchsorted(row, np.arange(block.rows + 1))
    hit = np.zeros(len(row), bool)
    for r in range(block.rows):
        s = slice(bounds[r], bounds[r + 1])
        if bounds[r + 1] > bounds[r]:
            hit[s] = np.isin(key[s], np.frombuffer(b"".join(wanted[r]), "<i8"))
    position, row = position[hit], row[hit]
    lead = np.zeros(len(position), np.uint64)
    for i in range(8):
        lead = (lead << np.uint64(8)) | block.data[position + i].astype(np.uint64)
    return position, row, lead


def _contexts(block: Block, position: np.ndarray, row: np.ndarray):
    """The bytes around anchors plus 1 (0 beyond the document; UTF-8 has no 255) and how many there are on either side."""
    low, high = block.offsets[row], block.offsets[row + 1]
    place = position[:, None] + np.arange(-LEFT, WINDOW)
    inside = (place >= low[:, None]) & (place < high[:, None])
    around = np.where(inside, block.data[np.clip(place, 0, len(block.data) - 1)] + np.uint8(1), 0).astype(np.uint8)
    return around, np.minimum(position - low, LEFT).astype(np.uint8), np.minimum(high - position, WINDOW).astype(np.uint8)


def _leads(batches, buckets: int):
    for batch in batches:
        for block in blocks(batch.column(1)):
            wanted = batch.column(2).slice(block.first, block.rows).to_pylist()
            lead = np.unique(_candidates(block, wanted, buckets)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lead[0].view(np.int64)), pa.array(lead[1].astype(np.int64))], ["lead", "n"])


def _emit_suffixes(batches, buckets: int, splitters: np.ndarray, hot: np.ndarray):
    """Suffixes of wanted anchors by range bucket: one row per bucket and block."""
    for batch in batches:
        rids = batch.column(0).to_numpy(zero_copy_only=False)
        ids = batch.column(3).to_numpy(zero_copy_only=False)
        for block in blocks(batch.column(1)):
            wanted = batch.column(2).slice(block.first, block.rows).to_pylist()
            position, row, lead = _candidates(block, wanted, buckets)
            cold = ~np.isin(lead, hot)
            position, row, lead = position[cold], row[cold], lead[cold]
            if not len(position):
                continue
            target = np.searchsorted(splitters, lead)
            order = np.argsort(target, kind="stable")
            position, row, target = position[order], row[order], target[order]
            around, left, right = _contexts(block, position, row)
            names, first = np.unique(target, return_index=True)
            cut = list(zip(first, np.append(first[1:], len(target))))
            columns = [
                rids[block.first + row].astype("<i8"), ids[block.first + row].astype("<i8"), (position - block.offsets[row]).astype("<i8"), left, right, around,
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.astype(np.int64)), *[pa.array([c[s:e].tobytes() for s, e in cut], pa.binary()) for c in columns]],
                ["target", "rid", "doc", "at", "before", "after", "around"],
            )


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian words: sorted by the first, ties refined by the next, and so on."""
    order = np.argsort(words[:, 0], kind="stable")
    tied = np.flatnonzero(words[order[1:], 0] == words[order[:-1], 0])
    group = np.concatenate([[0], np.cumsum(words[order[1:], 0] != words[order[:-1], 0])])
    for k in range(1, words.shape[1]):
        if not len(tied):
            break
        some = np.unique(np.concatenate([tied, tied + 1]))
        rows = order[some]
        finer = np.lexsort((words[rows, k], group[some]))
        order[some] = rows[finer]
        new = (group[1:] != group[:-1]) | (words[order[1:], k] != words[order[:-1], k])
        group = np.concatenate([[0], np.cumsum(new)])
        tied = np.flatnonzero(~new)
    return order


def _window_hits(doc, before, after, around):
    """(suffix, offset) pairs of windows that a smaller document has too."""
    m = len(doc)
    right = np.zeros((m, 56), np.uint8)
    right[:, :WINDOW] = around[:, LEFT:]
    order = multikey_order(right.view(">u8").astype(np.uint64))
    doc, before, after, around = doc[order], before[order].astype(np.int64), after[order].astype(np.int64), around[order]
    differ = around[1:, LEFT:] != around[:-1, LEFT:]
    common = np.where(differ.any(1), differ.argmax(1), WINDOW)
    common = np.concatenate([[0], np.minimum(common, np.minimum(after[1:], after[:-1])), [0]])
    reach = np.maximum(common[:-1], common[1:])
    left = np.zeros((LEFT + 1, m), np.uint64)
    for o in range(1, LEFT + 1):
        left[o] = mix(left[o - 1] + byte_hashes[around[:, LEFT - o]] + np.uint64(o))
    hits_at, hits_o = [], []
    for o in range(LEFT + 1):
        need = WINDOW - o
        some = np.flatnonzero((before >= o) & (after >= need) & (reach >= need))
        if len(some) < 2:
            continue
        segment = np.cumsum(common[:-1] < need)[some]
        by = np.lexsort((left[o][some], segment))
        s, h, d = segment[by], left[o][some][by], doc[some][by]
        opens = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (h[1:] != h[:-1])]))
        least = np.repeat(np.minimum.reduceat(d, opens), np.diff(np.append(opens, len(d))))
        hit = some[by[least < d]]
        hits_at.append(order[hit])
        hits_o.append(np.full(len(hit), o))
    if not hits_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hits_at), np.concatenate(hits_o)


def _spans(rid: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    """Spans by document, overlapping ones joined."""
    order = np.lexsort((start, doc, rid))
    rid, doc, start, end = rid[order], doc[order], start[order], end[order]
    first = np.flatnonzero(np.append(True, (rid[1:] != rid[:-1]) | (doc[1:] != doc[:-1]))[: len(rid)])
    rows = [merged(list(zip(start[s:e].tolist(), end[s:e].tolist()))) for s, e in zip(first, np.append(first[1:], len(rid)))]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"rid": pa.array(rid[first], pa.int64()), "doc_id": pa.array(doc[first], pa.int64()), "spans": pa.array([[{"start": s, "end": e} for s, e in r] for r in rows], kind)})


def _compare(table: pa.Table) -> pa.Table:
    """Spans that one range bucket finds."""
    read = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
    rid, doc, at, before, after = (read(c, t) for c, t in (("rid", "<i8"), ("doc", "<i8"), ("at", "<i8"), ("before", np.uint8), ("after", np.uint8)))
    around = read("around", np.uint8).reshape(-1, LEFT + WINDOW)
    # suffixes that agree in all their bytes: those above the smallest document are settled at once
    whole = np.zeros(len(rid), np.uint64)
    for column in around.T:
        whole = mix(whole + byte_hashes[column])
    whole = mix(whole + before.astype(np.uint64) * np.uint64(64) + after.astype(np.uint64))
    order = np.argsort(whole, kind="stable")
    opens = np.flatnonzero(np.concatenate([[True], whole[order][1:] != whole[order][:-1]]))
    least = np.empty(len(rid), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], opens), np.diff(np.append(opens, len(rid))))
    settled = doc > least
    full = settled & (before.astype(int) + after >= WINDOW)
    starts, ends, rids, docs = [at[full] - before[full]], [at[full] + after[full]], [rid[full]], [doc[full]]
    rest = np.flatnonzero(~settled)
    if len(rest):
        hit, offset = _window_hits(doc[rest], before[rest], after[rest], around[rest])
        hit = rest[hit]
        starts.append(at[hit] - offset)
        ends.append(at[hit] - offset + WINDOW)
        rids.append(rid[hit])
        docs.append(doc[hit])
    return _spans(np.concatenate(rids), np.concatenate(docs), np.concatenate(starts), np.concatenate(ends))


def _emit_windows(batches, buckets: int, hot: np.ndarray):
    """Every window of the anchors whose leading word is hot: (rid, doc, window hash, start)."""
    for batch in batches:
        rids, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
        for block in blocks(batch.column(1)):
            wanted = batch.column(2).slice(block.first, block.rows).to_pylist()
            position, row, lead = _candidates(block, wanted, buckets)
            some = np.isin(lead, hot)
            position, row = position[some], row[some]
            start = (position[:, None] - np.arange(LEFT + 1)).ravel()
            row = np.repeat(row, LEFT + 1)
            fine = (start >= block.offsets[row]) & (start + WINDOW <= block.offsets[row + 1])
            start, row = start[fine], row[fine]
            window = span_hash(block.data, start, start + WINDOW, fold=False)
            yield pa.RecordBatch.from_arrays([
                pa.array(rids[block.first + row].astype(np.int64)), pa.array(ids[block.first + row].astype(np.int64)),
                pa.array(window.view(np.int64)), pa.array(start - block.offsets[row]),
            ], ["rid", "doc", "window", "start"])


def _cut(batches):
    """(rid, removed, spans, digest of what is left) from texts and their span lists."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        lists = batch.column(2)
        for block in blocks(batch.column(1)):
            removed, spans, digest = [], [], []
            for r in range(block.rows):
                cut = merged([(s["start"], s["end"]) for part in lists[block.first + r].as_py() for s in part])
                raw, at, left = block.raw(r), 0, hashlib.sha256()
                for s, e in cut:
                    left.update(raw[at:s])
                    at = e
                left.update(raw[at:])
                removed.append(sum(e - s for s, e in cut))
                spans.append([{"start": s, "end": e} for s, e in cut])
                digest.append(left.hexdigest())
            yield pa.RecordBatch.from_arrays([
                *[batch.column(i).slice(block.first, block.rows) for i in (0, 3)], pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(digest),
            ], ["rid", "doc_id", "removed", "spans", "left_digest"])


def repeated_runs(
    spark: SparkSession, docs: DataFrame, tags_per_bucket: int = TAGS_PER_BUCKET, suffixes_per_bucket: int = SUFFIXES_PER_BUCKET, sample: int = SAMPLE,
) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, n_bytes, n_removed, spans, kept_sha256), a row per row.

    ``spans`` are the maximal removed byte ranges of the text as given. A null text is
    empty. Rows of one doc_id are not smaller than each other, so they keep what only
    they share. A row without doc_id keeps its text and takes nothing from others. Extra
    columns are ignored; an empty table gives no rows. ``sample`` documents, or one for every eight
    ranges if that is more, give the splitters, which decide only where suffixes are compared.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    facts = written(rows.select(
        "rid", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text", F.lit(1)).alias("whole"),
        F.sha2("text", 256).alias("digest"),
    ), "facts")
    first = facts.where("doc_id is not null").groupBy("whole", "digest").agg(F.min("doc_id").alias("first"))
    facts = written(facts.join(first, ["whole", "digest"], "left").withColumn(
        "copy", F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= WINDOW), F.lit(False))
    ).drop("first", "whole"), "classes")
    size = facts.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(12, -(-size // (18 * tags_per_bucket)))
    usable = rows.where("doc_id is not null")
    tags = usable.select("rid", "text").mapInArrow(partial(_emit_tags, buckets=buckets), "bucket long, rids binary, owners binary, tags binary")
    shared = tags.groupBy("bucket").applyInArrow(lambda table: _shared_tags(table, buckets), "rid long, n long, tags binary")
    # copies are settled; what is left is one row per document and bucket
    own = facts.where("not copy").select("rid").distinct()
    wanted = shared.join(own, "rid", "left_semi").groupBy("rid").agg(F.sum("n").alias("n"), F.collect_list("tags").alias("tags"))
    wanted = written(wanted, "wanted")
    count = wanted.agg(F.sum("n")).first()[0] or 0
    targets = max(1, -(-count // suffixes_per_bucket))
    some = wanted.orderBy(F.xxhash64("rid"), "rid").limit(max(sample, targets // 8)).select("rid", "tags")
    leads = usable.join(F.broadcast(some), "rid").select("rid", "text", "tags").mapInArrow(partial(_leads, buckets=buckets), "lead long, n long")
    splitters, hot = _splitters(leads.groupBy("lead").agg(F.sum("n").alias("n")), targets)
    joined = usable.join(wanted.drop("n"), "rid").select("rid", "text", "tags", "doc_id")
    suffixes = joined.mapInArrow(
        partial(_emit_suffixes, buckets=buckets, splitters=splitters, hot=hot),
        "target long, rid binary, doc binary, at binary, before binary, after binary, around binary",
    )
    kind = "rid long, doc_id long, spans array<struct<start:long,end:long>>"
    spans = suffixes.groupBy("target").applyInArrow(_compare, kind)
    if len(hot):
        windows = joined.mapInArrow(partial(_emit_windows, buckets=buckets, hot=hot), "rid long, doc long, window long, start long")
        # a written table, so that a window of very many documents can be split in the join
        least = windows.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
        least = written(least.select("window", "least"), "least")
        beaten = windows.join(least, "window").where("doc > least")
        spans = spans.unionByName(beaten.groupBy("rid", F.col("doc").alias("doc_id")).agg(
            F.collect_set(F.struct("start", (F.col("start") + WINDOW).alias("end"))).alias("spans")
        ))
    # rows are told apart by id and hash together: one hash alone repeats in very large tables
    row = ["rid", "doc_id"]
    spans = written(spans.groupBy(*row).agg(F.collect_list("spans").alias("lists")), "spans")
    cut = usable.join(spans, row).select("rid", "text", "lists", "doc_id")
    cut = cut.mapInArrow(_cut, "rid long, doc_id long, removed long, spans array<struct<start:long,end:long>>, left_digest string")
    out = facts.join(cut.dropDuplicates(row), row, "left")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return out.select(
        "doc_id", "n_bytes", F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), all_of_it).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))).alias("spans"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left_digest", "digest")).alias("kept_sha256"),
    )


def _splitters(leads: DataFrame, targets: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``targets - 1`` leading words that cut the sample evenly, and those that fill more than a range alone."""
    if targets < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    found = leads.toArrow()
    lead = found["lead"].to_numpy().astype(np.int64).view(np.uint64)
    if not len(lead):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    order = np.argsort(lead)
    lead, n = lead[order], found["n"].to_numpy()[order]
    upto = np.cumsum(n)
    cuts = lead[np.searchsorted(upto, upto[-1] * np.arange(1, targets) / targets)]
    names, times = np.unique(cuts, return_counts=True)
    return names, names[times > 1]
