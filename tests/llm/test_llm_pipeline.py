"""The corpus pipeline: every stage on awkward rows, and the whole against brute force."""

import zlib

import corpus_pipeline
import numpy as np
from llm_fixtures import awkward, awkward_docs, empty_docs
from pyspark.sql import functions as F
from test_llm_benchmark import brute as windows
from test_llm_near import brute as near_brute
from test_llm_templates import brute as line_brute

from metaloom.llm import quality_model, tokens

SF = "/root/testdata/sf0.001"


def test_stages_take_awkward_rows(spark):
    docs = awkward_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        assert 0 < out.count() <= len(awkward()), name
        assert stage(spark, empty_docs(spark), SF).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, SF).where("start = 0").count() == len(awkward())
    assert last(spark, empty_docs(spark), SF).count() == 0


def test_whole_pipeline(spark):
    """Stage by stage with plain Python on the small tables, down to the packed ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    machine = quality_model.train(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = quality_model.score(docs, machine).where("score >= 0.5").select("row.doc_id", "row.text").orderBy("doc_id").collect()
    texts = line_brute([r.text for r in good], 10)
    rows = [(r.doc_id, t) for r, t in zip(good, texts)]
    kept = near_brute(rows, 5)
    rows = [(d, t) for d, t in rows if kept[d, t][1] == d]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d, t in rows if windows(t, items, 10)[1]}
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    clean = {d: t for d, t in rows if d not in hit}
    assert set(clean) <= set(pieces.doc_id) <= {d for d, _ in rows}
    assert hit, "the tables hold leaks"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_path())
    for d, g in pieces.groupby("doc_id"):
        assert g.length.sum() == g.doc_tokens.iloc[0]
        if d in clean:
            ids = np.array(library.encode(clean[d], add_special_tokens=False).ids + [2], "<u4")
            assert g.doc_tokens.iloc[0] == len(ids)
            for p in g.itertuples():
                assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())


def test_pipeline_removes_leaks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = corpus_pipeline.decontamination(spark, docs, SF)
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert all(windows(r.text, items, 10)[1] == 0 for r in left.collect())
    assert left.where(F.col("n_chars") != F.length("text")).count() == 0
