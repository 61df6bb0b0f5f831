"""Secrets against the patterns on decoded text; the models on labelled strings."""

import random
import re

import numpy as np
import pytest
from llm_fixtures import awkward, awkward_docs, empty_docs, prose

from metaloom.llm import secret_scan as s

KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = re.compile(rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s.KINDS[k], a, e) for a, k, e in sorted(found)]


@pytest.fixture(scope="module")
def ratio(spark):
    return s.train(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def spans(docs, ratio):
    return {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in s.secrets(docs, ratio).select("row.doc_id", "spans").collect()}


def test_base_patterns(spark, ratio):
    rng = random.Random(1)
    bits = ["password", "PassWD", "api_key", "APIKEY", "secret", "token", ":", "=", " ", '"', "'", "abc", "x1/+.=-_", "é", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", "\n", "😀", "K", "ſecret"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    texts += ["secret=token=abcdef", "secret: token: abcdefgh", "password:  'abcdef'", "password=abcde", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "f" * 23, "f" * 24, "xAKIAAKIA" + "B" * 30]
    found = spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ratio)
    for i, text in enumerate(texts):
        assert [x for x in found[i] if x[0] != "random"] == brute(text), text


def test_models_tell_random_from_ordinary(spark, ratio):
    rng = np.random.default_rng(3)
    random_ = ["".join(rng.choice(list(a), 32)) for a in s.ALPHABETS for _ in range(100)]
    ordinary = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(3000)
    words = [w for r in docs.collect() for w in re.findall(r"[A-Za-z0-9+_=-]{16,}", r.text or "")]
    words = [w for w in words if not re.search(r"\d", w)]
    ordinary.shuffle(words)
    words = words[:2000]
    texts = [f"see {x} there" for x in random_ + words]
    found = spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ratio)
    hit = [bool(found[i]) for i in range(len(texts))]
    assert np.mean(hit[: len(random_)]) > 0.95
    assert np.mean(hit[len(random_) :]) < 0.005


def test_model_spans_are_whole_runs_outside_the_patterns(spark, ratio):
    text = "é key Zq8vX2mLp0RtY7bNw3Ks done, password=Zq8vX2mLp0RtY7bNw3Ks"
    found = spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), ratio)[1]
    assert found == [("random", 6, 26), ("assign", 33, len(text))]
    assert text[6:26] == "Zq8vX2mLp0RtY7bNw3Ks"


def test_long_text(spark, ratio):
    text = prose(random.Random(1), 60_000) + " password=hunter22 " + "f" * 40
    found = spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), ratio)[1]
    assert [x for x in found if x[0] != "random"] == brute(text)


def test_awkward_and_empty(spark, ratio):
    found = s.secrets(awkward_docs(spark), ratio).select("row.*", "spans").collect()
    assert len(found) == len(awkward())
    assert s.secrets(empty_docs(spark), ratio).collect() == []
    none = s.train(spark, empty_docs(spark))
    assert s.secrets(awkward_docs(spark), none).count() == len(awkward())
