"""Repeated runs against a table of every 50-byte string."""

import hashlib
import random

import numpy as np
import pytest
from llm_fixtures import awkward, awkward_docs, empty_docs, prose

from metaloom.llm import suffixes as s


def brute(rows):
    """(doc_id, text) rows to (doc_id, bytes, removed, spans, digest)."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    out = []
    for d, t in rows:
        b, gone = (t or "").encode(), set()
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone |= set(range(i, i + 50))
        spans = sum(1 for i in gone if i - 1 not in gone)
        out.append((d, len(b), len(gone), spans, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in df.collect()), key=str)


def planted():
    rng = random.Random(11)
    line = "This very common line of text stands in a third of all the documents here."
    passage = prose(rng, 70)
    texts = []
    for i in range(120):
        parts = [prose(rng, rng.randrange(5, 80), 10**6)]
        if i % 3 == 0:
            parts.insert(rng.randrange(2), line)
        if i % 7 == 0:
            parts.append(passage[rng.randrange(0, 200) :])
        if i % 11 == 0:
            parts.append("ab" * rng.randrange(20, 60))
        texts.append(rng.choice([" ", "\n"]).join(parts))
    texts += [texts[5]] * 4 + [texts[9] + " more", "x" * 49, "x" * 49, "x" * 50, "x" * 51, "é" * 40, "a" + "é" * 40, "\x00" * 80, "\x00" * 60 + "b" * 60, ""]
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("tags,suffixes", [(s.TAGS_PER_BUCKET, s.SUFFIXES_PER_BUCKET), (200, 60), (50, 4)])
def test_planted_passages(spark, tags, suffixes):
    """With one bucket, with several, and with leading words that outgrow a bucket."""
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(s.repeated_runs(spark, docs, tags_per_bucket=tags, suffixes_per_bucket=suffixes)) == brute(rows)


def test_awkward_and_empty(spark):
    rows = [(r[0], r[1]) for r in awkward() if len(r[1] or "") < 10_000]
    docs = awkward_docs(spark).where("text is null or length(text) < 10000")
    assert found(s.repeated_runs(spark, docs)) == brute(rows)
    assert s.repeated_runs(spark, empty_docs(spark)).collect() == []


def test_long_texts(spark):
    rng = random.Random(2)
    text = prose(rng, 20_000, 10**6)
    rows = [(1, text), (2, prose(rng, 500, 10**6) + text[30_000:90_000] + prose(rng, 500, 10**6)), (3, "y" * 100_000), (4, "y" * 3000)]
    assert found(s.repeated_runs(spark, spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_multikey_order():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    order = s.multikey_order(words)
    assert [tuple(w) for w in words[order]] == sorted(tuple(w) for w in words)


def test_equal_windows_have_equal_anchors():
    import pyarrow as pa

    from metaloom.llm.texts import blocks

    rng = random.Random(1)
    shared = prose(rng, 30)
    texts = [prose(rng, 20) + shared + prose(rng, 20) for _ in range(2)]
    block = next(blocks(pa.array(texts)))
    position, row, _ = s.anchors(block)
    at = [texts[r].encode().index(shared.encode()) + int(block.offsets[r]) for r in (0, 1)]
    size = len(shared.encode())
    inner = [{int(p) - a for p, r_ in zip(position, row) if r_ == r and a + s.LEFT <= p <= a + size - s.WINDOW} for r, a in enumerate(at)]
    assert inner[0] and inner[0] == inner[1]


def test_tag_rows_do_not_grow_with_the_buckets():
    """The bytes of a run's rows are the same per anchor, however many buckets there are."""
    rng = np.random.default_rng(5)
    key, owner = rng.integers(0, 2**62, 40_000), rng.integers(0, 2000, 40_000)
    rids = rng.integers(0, 2**62, 2000)
    sizes = []
    for buckets in (12, 1000):
        mine = ((key >> 32) % buckets << 32) | (key & 0xFFFFFFFF)
        sizes.append(sum(b.nbytes for b in s._tag_rows(mine, owner, rids, buckets)))
    assert sizes[1] < 3 * sizes[0]


def test_rows_with_one_hash_keep_apart(spark, monkeypatch):
    """Two documents whose row hashes are equal do not get each other's cuts."""
    from pyspark.sql import functions as F

    rows = planted()
    real = F.xxhash64
    monkeypatch.setattr(s.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(40)) if c[0] == "doc_id" else real(*c))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(s.repeated_runs(spark, docs)) == brute(rows)
