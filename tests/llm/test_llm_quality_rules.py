"""Quality rules against a plain count and plain quantiles."""

import math
import random
import re

from llm_fixtures import awkward, awkward_docs, empty_docs, prose, words
from pyspark.sql import functions as F

from metaloom.llm import quality_rules as q


def counts(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 3000 else {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def check_counts(spark, texts):
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in q.quality_rules(spark, docs).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == counts(texts[r.doc_id]), texts[r.doc_id][:80]
        assert r.base_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0])
        assert not (r.base_failed and r.kept)


def test_counts(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcde") for _ in range(n)) for n in range(0, 60, 3)]
    texts += ["\n".join(rng.choice(["one line", " ", "two", "| # <x>"]) for _ in range(9)) for _ in range(10)]
    texts += [prose(rng, 40) + " " + prose(rng, 9) * 3 for _ in range(10)]
    check_counts(spark, texts)
    check_counts(spark, [r[1] for r in awkward()])


def test_sketch_quantiles_are_within_their_error(spark):
    rng = random.Random(5)
    values = [int(rng.lognormvariate(8, 2)) for _ in range(3000)] + [0] * 10
    rules = [r for r, _, _ in q.RULES]
    stats = spark.createDataFrame([("g", "h", *([v] * len(rules))) for v in values], "lang string, source string, " + ", ".join(f"{r} long" for r in rules))
    sketch = q.sketches(stats, ["lang", "source"])
    halves = [q.sketches(stats.where(F.pmod(F.hash(rules[0]), F.lit(2)) == i), ["lang", "source"]) for i in (0, 1)]
    same = q.merge(halves[0].unionByName(halves[1]), ["lang", "source"])
    assert sorted(sketch.collect()) == sorted(same.select(*sketch.columns).collect()), "sketches merge"
    found = q.quartiles(sketch, ["lang"], {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    for column, share in (("a", 0.1), ("b", 0.5), ("c", 0.99)):
        exact = sorted(values)[math.ceil(share * len(values)) - 1]
        assert exact * (1 - 1 / 64) <= found[column] <= exact


def test_thresholds_follow_the_group(spark):
    """What is usual in one source is an outlier in another; small groups borrow their language's fences."""
    rng = random.Random(4)
    tagged = lambda n: prose(rng, 40, 10**6) + "".join(f" #{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, tagged(rng.randrange(18, 24)), "en", "code") for i in range(220)]
    rows += [(1000 + i, prose(rng, 40, 10**6), "en", "news") for i in range(1500)]
    rows += [(5000, tagged(20), "en", "news"), (5001, tagged(20), "en", "code")]
    rows += [(6000, prose(rng, 40, 10**6), "en", "tiny"), (6001, tagged(60), "en", "tiny")]
    found = {r.doc_id: r.kept for r in q.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not found[5000] and found[5001] and found[6000] and not found[6001]
    assert all(found[i] for i in range(220)) and all(found[1000 + i] for i in range(1500))


def test_native_plan(spark):
    plan = q.quality_rules(spark, awkward_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_awkward_and_empty(spark):
    found = q.quality_rules(spark, awkward_docs(spark)).collect()
    assert len(found) == len(awkward()) and all(r.kept is not None for r in found)
    assert q.quality_rules(spark, empty_docs(spark)).collect() == []
