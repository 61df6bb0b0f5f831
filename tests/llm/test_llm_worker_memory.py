"""What operators leave in executors: words of the tokenizer, texts sent twice, further Python workers."""

import re

import numpy as np
from pyspark.sql import functions as F

from metaloom.llm import near, tables, tokens
from metaloom.llm.texts import Block


def block_of(texts):
    raw = [t.encode() for t in texts]
    return Block(0, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8))


def letters(n):
    return "".join("abcdefghij"[int(d)] for d in str(n))


def test_words_that_a_worker_keeps_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 100)
    encoder = tokens.Encoder(tokens.default_path())
    one = " ".join(letters(n) for n in range(60))
    many = " ".join(letters(n) for n in range(20, 300))  # some are known, the rest are more than the worker keeps
    for text in (one, many, one, many):
        ids = encoder.encode(block_of([text]))[0]
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    encoder.encode(block_of([one]))
    assert len(encoder.known) == 60


def test_look_up_takes_few_bytes():
    encoder = tokens.Encoder(tokens.default_path())
    assert encoder.place_hash.nbytes + encoder.place_slot.nbytes <= 4 << 20
    encoder.encode(block_of([" ".join(letters(n) for n in range(20_000))]))
    assert len(encoder.known) == 20_000 and encoder.known.nbytes + encoder.slot.nbytes == 16 * 20_000


def test_carried_text_is_sent_once(spark):
    def lengths(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.utf8_length(batch.column(1)).cast(pa.int64())], ["row", "n"])

    docs = spark.createDataFrame([(1, "äbc", 7), (2, None, 8), (3, "", 9)], "doc_id long, `te.xt` string, other int")
    found = tables.carried(docs, lengths, "n long", "te.xt")
    child = found._jdf.queryExecution().analyzed().children().head()
    assert re.findall(r"AS (\w+)", child.simpleString(100)) == ["row"]
    assert sorted((r.row.doc_id, r.row["te.xt"], r.row.other, r.n) for r in found.collect()) == [(1, "äbc", 7, 3), (2, None, 8, None), (3, "", 9, 0)]
    # a text that is not carried, or no string, goes beside the rows
    for other in (tables.carried(docs, lengths, "n long", "te.xt", keep=["doc_id"]), tables.carried(docs.withColumn("te.xt", F.lit(123)), lengths, "n long", "te.xt")):
        assert [r.n for r in other.orderBy("row.doc_id").collect()] in ([3, None, 0], [3, 3, 3])


def test_first_labels_need_no_python(spark, monkeypatch):
    """A local list makes an RDD, for which every executor starts a second Python daemon."""
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "some other words here")], "doc_id long, text string")

    def refused(*_, **__):
        raise AssertionError("rows from the driver")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    found = near.near_duplicates(spark, docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.component_id) for r in found] == [(1, 1), (2, 1), (3, 3)]
