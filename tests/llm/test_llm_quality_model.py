"""The factorisation machine: its identity, held-out accuracy and awkward rows."""

import itertools
import zlib

import numpy as np
from llm_fixtures import awkward, awkward_docs, empty_docs
from pyspark.sql import functions as F

from metaloom.llm import quality_model as q
from metaloom.llm import queries

SF = "/root/testdata/sf0.01"


def test_sum_of_squares_identity():
    """The linear-time form equals the sum over all pairs."""
    rng = np.random.default_rng(1)
    m = q.Machine(0.3, rng.normal(size=q.SIZE).astype(np.float32), rng.normal(size=(q.SIZE, q.FACTORS)).astype(np.float32))
    rows = [rng.choice(q.SIZE, n, replace=False) for n in (1, 2, 9)]
    values = [rng.normal(size=len(r)).astype(np.float32) for r in rows]
    fast = m.logits(np.array([0, 1, 3]), np.concatenate(rows), np.concatenate(values))
    for f, x, got in zip(rows, values, fast):
        pairs = sum(float(m.factors[f[i]] @ m.factors[f[j]]) * x[i] * x[j] for i, j in itertools.combinations(range(len(f)), 2))
        assert abs(got - (m.bias + float(m.linear[f] @ x) + pairs)) < 1e-3


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = queries.QUERIES["op8_quality_model"](spark, SF).collect()
    assert len(found) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    judged = [(r.predicted, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    assert len(judged) > 80 and np.mean([a == b for a, b in judged]) > 0.97
    assert np.mean([a for a, b in judged if b == 1]) > 0.97


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    spoilt = labels.withColumn("quality", F.when(q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (q.train(spark, docs, x) for x in (labels, spoilt))
    assert a.bias == b.bias and (a.linear == b.linear).all() and (a.factors == b.factors).all()


def test_sample_is_a_bound(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    few, all_ = q.train(spark, docs, labels, sample=20), q.train(spark, docs, labels)
    assert (few.linear != 0).sum() < (all_.linear != 0).sum()


def test_awkward_and_empty(spark):
    docs = awkward_docs(spark)
    labels = spark.createDataFrame([(0, 0), (5, 1), (5, 0), (5, None), (None, 1), (8, 1), (10, 1), (16, 0), (2, 7), (999, 1)], "doc_id long, quality int")
    machine = q.train(spark, docs, labels)
    found = q.score(docs, machine).select("row.*", F.col("score").alias("real")).collect()
    assert len(found) == len(awkward()) and all(0 <= r.real <= 1 for r in found) and {r.score for r in found} == {"score"}
    by_text = {}
    for r in found:
        assert by_text.setdefault(r.text, r.real) == r.real
    assert q.score(empty_docs(spark), machine).collect() == []
    nothing = q.train(spark, empty_docs(spark), labels)
    assert {r.score for r in q.score(docs, nothing).collect()} == {0.5}
    one_class = q.train(spark, docs, labels.where("quality = 1"))
    assert len({round(r.score, 6) for r in q.score(docs, one_class).collect()}) == 1
