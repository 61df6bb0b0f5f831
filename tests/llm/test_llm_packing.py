"""Packing: an exact round trip with the library's own ids."""

import zlib

import numpy as np
import pandas as pd
import pytest
from llm_fixtures import awkward, awkward_docs, empty_docs

from metaloom.llm import packing, tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [packing.END], "<u4")


def check(library, pieces: pd.DataFrame, texts: dict, size):
    for (doc, _), g in pieces.groupby(["doc_id", "doc_tokens"]):
        ids = ids_of(library, texts[doc])
        at = 0
        for p in g.sort_values("start").itertuples():
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        ends = (g.offset + g.length).tolist()
        assert g.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= size and (g.length > 0).all()


@pytest.mark.parametrize("size,part", [(4096, packing.PART), (64, 5000), (32, 200)])
def test_round_trip(spark, library, size, part):
    rows = [(i, r[1], r[3]) for i, r in enumerate(awkward()) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(spark, docs, size=size, part_tokens=part).toPandas()
    assert set(pieces.doc_id) == {r[0] for r in rows}
    check(library, pieces, {r[0]: r[1] for r in rows}, size)


def test_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = packing.pack(spark, docs).toPandas()
    check(library, pieces, dict(docs.select("doc_id", "text").collect()), 4096)
    padding = 1 - pieces.length.sum() / (4096 * pieces.sequence_id.nunique())
    assert padding < 0.02


def mixture(spark, targets, weights):
    rows = [(i, "cat dog bird tree " * (10 + i % 7), s) for s, n in weights.items() for i in range(n)]
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return packing.pack(spark, docs, size=512, targets=targets).toPandas()


def test_windows_follow_the_corpus(spark):
    pieces = mixture(spark, None, {"a": 600, "b": 200, "c": 200})
    whole = pieces.groupby("source").length.sum() / pieces.length.sum()
    order = pieces.sort_values(["sequence_id", "offset"])
    served = order.groupby("sequence_id").length.sum().cumsum()
    for source, share in whole.items():
        of = order[order.source == source].groupby("sequence_id").length.sum().reindex(served.index, fill_value=0).cumsum()
        assert ((of - share * served).abs() <= 2 * 512).all()


def test_targets_hold_until_a_source_runs_dry(spark):
    pieces = mixture(spark, {"a": 1, "b": 1}, {"a": 700, "b": 300})
    first = pieces[pieces.sequence_id < pieces.sequence_id.max() * 0.4].groupby("source").length.sum()
    assert abs(first["a"] / first.sum() - 0.5) < 0.05 and len(set(pieces.doc_id)) == 1000


def test_deficits_pass_on_to_the_next_part():
    """What the parts before over-served is served later."""
    sums = np.zeros(4, np.int32)
    part = pd.DataFrame([{"doc_id": i, "source": "ab"[i % 2], "n": 128, "sums": sums, "turn": i, "part": 1, "no_id": False, "share": 0.5, "own_before": [600, 400][i % 2], "all_before": 1000} for i in range(20)])
    first = packing._serve(part, 256).sort_values(["sequence_id", "offset"])
    assert first.source.iloc[0] == "b" and first.length.sum() == 20 * 128


def test_piece_sums():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 49_408, 5000).astype("<u4")
    places = np.sort(rng.integers(0, 5000, (50, 2)), axis=1)
    places[:, 1] = np.minimum(places[:, 1], places[:, 0] + 4096)
    sums = lambda at: np.array([zlib.crc32(ids[:p].tobytes()) for p in at], np.uint32)
    found = packing.piece_sums(sums(places[:, 0]), sums(places[:, 1]), places[:, 1] - places[:, 0])
    assert found.tolist() == [zlib.crc32(ids[a:b].tobytes()) for a, b in places]


def test_ids_can_be_kept(spark, library):
    found = packing.tokenised(awkward_docs(spark), keep_ids=True).select("doc_id", "ids").collect()
    texts = {r[0]: r[1] for r in awkward()}
    assert all(r.ids == ids_of(library, texts[r.doc_id]).tolist() for r in found if r.doc_id is not None)


def test_awkward_and_empty(spark):
    pieces = packing.pack(spark, awkward_docs(spark)).toPandas()
    assert pieces[pieces.start == 0].shape[0] == len(awkward()) and pieces.doc_id.isna().sum() >= 2
    assert packing.pack(spark, empty_docs(spark)).collect() == []
