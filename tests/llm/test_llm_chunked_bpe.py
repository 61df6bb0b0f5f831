"""Chunked encoding against the library on whole texts, and what the chunks are for."""

import random

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import awkward, awkward_docs, empty_docs
from tokenizers import Tokenizer

from metaloom.llm import chunked_bpe
from metaloom.llm.texts import blocks
from metaloom.llm.tokens import default_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def expected(library, texts):
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def torn_texts():
    """Texts whose cuts fall into words, numbers, marks, contractions, special tokens and blankless runs."""
    rng = random.Random(8)
    pieces = ["word", "it's", "they're", "<|endoftext|>", "12345", "été", "́", "日本語のテキスト", "😀😀", "...!?", "ÄÖÜ", "ﬁn", "Σίσυφος", " ", "\x0b", "a" * 90, "--"]
    texts = [rng.choice(["", " ", "\n"]).join(rng.choice(pieces) for _ in range(rng.randrange(1, 900))) for _ in range(40)]
    texts += ["".join(rng.choice("abc '<|>é\n\t") for _ in range(5000)) for _ in range(10)]
    return texts + ["x" * 50_000, " " * 9000, "ab " * 9000, "é" * 7000, None, ""]


@pytest.mark.parametrize("least,bits", [(chunked_bpe.LEAST, chunked_bpe.BITS), (24, 4), (30, 6), (1, 1)])
def test_ids_are_those_of_whole_texts(library, least, bits):
    texts = torn_texts() + [r[1] for r in awkward()]
    chunks = chunked_bpe.Chunks(default_path())
    found = [ids.tolist() for block in blocks(pa.array(texts)) for ids in chunked_bpe.block_ids(block, chunks, least, bits)]
    assert found == expected(library, texts)


def test_random_texts_with_very_many_cuts(library):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab'sre <|endotx>123é́ \n日😀", k=rng.randrange(1, 400))) for _ in range(600)]
    chunks = chunked_bpe.Chunks(default_path())
    found = [ids.tolist() for block in blocks(pa.array(texts)) for ids in chunked_bpe.block_ids(block, chunks, 6, 3)]
    assert found == expected(library, texts)


def test_shared_passages_are_encoded_once():
    rng = random.Random(6)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000))
    chunks = chunked_bpe.Chunks(default_path())
    encoded = []
    of = chunked_bpe.encoded
    def counted(encoder, spans):
        encoded.extend(s for s in spans if len(s) >= chunked_bpe.LEAST)
        return of(encoder, spans)
    chunked_bpe.encoded = counted
    try:
        for i in range(20):
            text = f"{'head ' * i}{i} {passage} {'tail ' * i}"
            for block in blocks(pa.array([text])):
                chunked_bpe.block_ids(block, chunks)
    finally:
        chunked_bpe.encoded = of
    assert sum(map(len, encoded)) < 3 * len(passage)
    assert len(encoded) == len(set(encoded))


def test_cuts_follow_content():
    rng = np.random.default_rng(4)
    body = rng.integers(97, 123, 40_000).astype(np.uint8)
    shifted = np.concatenate([np.full(777, 65, np.uint8), body])
    cuts = [chunked_bpe.cut_places(x, np.array([0, len(x)])) for x in (body, shifted)]
    common = set(cuts[0].tolist()) & set((cuts[1] - 777).tolist())
    assert len(common) >= len(cuts[0]) - 3 and len(cuts[0]) > 10


def test_memory_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(chunked_bpe, "HELD", 20_000)
    rng = random.Random(1)
    chunks = chunked_bpe.Chunks(default_path())
    for i in range(30):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(1500))
        for block in blocks(pa.array([text])):
            chunked_bpe.block_ids(block, chunks, 24, 6)
        assert chunks.held <= 20_000 and sum(map(len, chunks.ids)) == chunks.held


def test_awkward_rows(spark, library):
    docs = awkward_docs(spark)
    found = chunked_bpe.decode(chunked_bpe.encode(docs)).collect()
    assert len(found) == docs.count()
    for r in found:
        ids = library.encode(r["row"]["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert set(found[0]["row"].asDict()) == set(docs.columns)
    assert sorted(map(str, chunked_bpe.encode(docs, decoded=True).collect())) == sorted(map(str, found))


def test_empty_table(spark):
    assert chunked_bpe.decode(chunked_bpe.encode(empty_docs(spark))).count() == 0


def test_query_equals_the_library(spark, library):
    import hashlib

    from metaloom.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    found = queries.QUERIES["op12_bpe_codec"](spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
