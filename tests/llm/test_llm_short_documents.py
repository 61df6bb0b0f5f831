"""Boilerplate goes from documents that are mostly boilerplate, in op7 and in the pipeline."""

import random

import corpus_pipeline
from llm_fixtures import prose

from metaloom.llm import queries


def test_short_documents_lose_their_boilerplate(spark, tmp_path):
    rng = random.Random(11)
    passage = prose(rng, 60, 10**6)
    bodies = [prose(rng, 40, 10**6) for _ in range(12)]
    rows = [(i, f"{b}\n{passage}", "en", "s", 0) for i, b in enumerate(bodies)] + [(12, passage, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    expected = {**dict(enumerate(bodies)), 12: ""}
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()} == expected
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op7_line_templates"](spark, str(tmp_path))
    assert {r.doc_id: r.text for r in found.collect()} == expected
