"""Decontamination against plain window search."""

import random
import re

import pytest
from llm_fixtures import awkward, awkward_docs, empty_docs
from pyspark.sql import functions as F

from metaloom.llm import benchmark
from metaloom.llm.automaton import SuffixAutomaton

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    w, hit, names = plain(text), set(), set()
    for name, item in items:
        i = plain(item)
        size = min(window, len(i))
        wanted = {tuple(i[k : k + size]) for k in range(len(i) - size + 1)} if i else set()
        for k in range(len(w) - size + 1):
            if i and tuple(w[k : k + size]) in wanted:
                hit |= set(range(k, k + size))
                names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("seed", range(30))
def test_automaton_finds_every_window(seed):
    rng = random.Random(seed)
    window = rng.randrange(1, 6)
    items = [(str(i), [rng.choice("abc") for _ in range(rng.randrange(0, 14))]) for i in range(rng.randrange(1, 6))]
    machine = SuffixAutomaton(items, window)
    text = [rng.choice("abcd") for _ in range(60)]
    found = {}
    for at, length, hits in machine.stream(text):
        assert length >= max(size for size, _ in hits)
        for size, names in hits:
            for n in names:
                found.setdefault((at, size), set()).add(n)
    expected = {}
    for name, item in items:
        size = min(window, len(item))
        for at in range(size - 1, len(text)) if size else ():
            run = text[at - size + 1 : at + 1]
            if any(item[k : k + size] == run for k in range(len(item) - size + 1)):
                expected.setdefault((at, size), set()).add(name)
    assert found == expected


def test_longest_match_is_tracked():
    machine = SuffixAutomaton([("x", list("abcdefgh"))], 3)
    assert [(at, n) for at, n, _ in machine.stream(list("zbcdefz"))] == [(3, 3), (4, 4), (5, 5)]


@pytest.mark.parametrize("window", [1, 3, 10])
def test_random_texts(spark, window):
    rng = random.Random(window)
    vocabulary = ["Aa", "b", "cé", "d1", "E-e", "f", "ü", "G"]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, make(rng.randrange(0, 25))) for i in range(12)] + [(3, None), (None, "b b b"), (5, "f")]
    texts = [make(rng.randrange(0, 80)) for _ in range(80)]
    texts += [t + " " + (items[i % 12][1] or "") + " " + t for i, t in enumerate(texts[:30])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = benchmark.scan_items(spark, docs, spark.createDataFrame(items, "item_id long, text string"), window=window)
    known = [(i, t) for i, t in items if i is not None and t is not None]
    for r in found.select("row.doc_id", "n_words", "n_hit", "items").collect():
        assert (r.n_words, r.n_hit, r["items"]) == brute(texts[r.doc_id], known, window)


def test_spans_and_what_is_left(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    texts = [f"before words that stay here in front {item} and these stay behind it as well now", item, f"x {item}", "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in benchmark.scan_items(spark, docs, spark.createDataFrame([(1, item)], "item_id long, text string")).select("row.doc_id", "longest", "spans", "left_over").collect()}
    assert found[0].left_over == "before words that stay here in front and these stay behind it as well now" and found[0].longest == 11
    assert [texts[0][s.start : s.end] for s in found[0].spans] == [item]
    assert found[1].left_over == "" and found[2].left_over == "" and found[3].left_over == "nothing here"
    again = benchmark.scan_items(spark, docs, spark.createDataFrame([(1, item)], "item_id long, text string"), length_limit=12, coverage=2.0)
    assert [r.left_over for r in again.orderBy("row.doc_id").collect()] == texts


def test_awkward_rows(spark):
    rows = awkward()
    items = spark.createDataFrame([(1, rows[5][1], "x"), (1, rows[5][1], "x"), (2, "", "x"), (3, "one", "x")], "item_id long, text string, left_over string")
    found = benchmark.scan_items(spark, awkward_docs(spark), items).select(F.col("row.doc_id"), F.col("row.score"), "n_words", "n_hit", "items").collect()
    assert len(found) == len(rows) and {r.score for r in found} == {"score"}
    known = [("1", rows[5][1]), ("3", "one")]
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in found:
        if r.doc_id is not None:
            assert (r.n_words, r.n_hit, r["items"]) == brute(texts[r.doc_id], known, 10)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert benchmark.scan_items(spark, empty_docs(spark), none).collect() == []
    assert {r.n_hit for r in benchmark.scan_items(spark, awkward_docs(spark), none).collect()} == {0}


def test_a_table_beyond_one_automaton_is_refused(spark):
    with pytest.raises(ValueError, match="split"):
        benchmark.item_groups(spark.createDataFrame([(1, "a" * 100)], "item_id long, text string"), limit=10)
