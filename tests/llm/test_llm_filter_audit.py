"""The audit against applying the filters in every order, one document at a time."""

import random
import re
import tempfile
from collections import defaultdict
from itertools import permutations

import pytest
from llm_fixtures import awkward, awkward_docs, empty_docs, words

from metaloom.llm import filter_audit

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    parts = defaultdict(list)
    for doc_id, text, lang in rows:
        t = text or ""
        w = words(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and least[t] < doc_id,
        }
        own = [x for x in labels if doc_id is not None and x[0] == doc_id]
        parts[lang or ""].append(({f for f in fails if fails[f]}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part, docs in parts.items():
        taken = defaultdict(int)
        for order in permutations("ABCDE"):
            left = list(docs)
            for i, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                redundant = sum(1 for d in docs if f in d[0]) - len(gone)
                out[part, "".join(order), i + 1] = [len(left), len(gone), redundant, sum(1 for d in docs if d[0] == {f}), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                taken[f] += len(gone)
        for (p, order, step), values in out.items():
            if p == part:
                values.append(taken[order[step - 1]])
    return out


def result(spark, path, labels, **kw):
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.filter_audit(spark, path, frame, **kw).collect()
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in found}


def table(df, files):
    path = tempfile.mkdtemp(prefix="audit-") + "/documents.parquet"
    df.repartition(files).write.parquet(path)
    return path


def some_rows(rng, n):
    texts = [" ".join(rng.choice(["Up", "low", "a#b", "x", f"w{rng.randrange(300)}"]) for _ in range(rng.choice([3, 150, 250, 400]))) for _ in range(12)]
    texts += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(210)) for _ in range(8)]
    return [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in rng.sample(range(10 * n), n)]


def test_small_ids_arrive_late(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "LEAST_BATCH", 1)
    monkeypatch.setattr(filter_audit, "TEXTS_PER_BUCKET", 30)
    rng = random.Random(4)
    rows = sorted(some_rows(rng, 120), reverse=True)
    rows += [(5000, "twice", "en"), (5000, "twice", "en"), (5000, "twice", "de"), (4000, "twice", "de")]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for r in rows if rng.random() < 0.7] + [(None, 1, 1), (rows[0][0], 1, 0)]
    path = tempfile.mkdtemp(prefix="audit-") + "/documents.parquet"
    for i in range(6):  # descending ids: every file holds smaller ones than all before it
        spark.createDataFrame(rows[20 * i : 20 * i + 20] + (rows[120:] if i == 3 else []), "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(path)
    assert result(spark, path, labels, batches=6) == brute(rows, labels)


@pytest.mark.parametrize("batches", [1, 3])
def test_batches_do_not_matter(spark, monkeypatch, batches):
    monkeypatch.setattr(filter_audit, "LEAST_BATCH", 1)
    rng = random.Random(9)
    rows = some_rows(rng, 60)
    labels = [(r[0], 1, 0) for r in rows[::2]]
    path = table(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5)
    assert result(spark, path, labels, batches=batches) == brute(rows, labels)


def test_awkward_rows(spark):
    labels = [(5, 1, 1), (6, 1, 0), (101, 0, 1), (101, 0, 1)]
    path = table(awkward_docs(spark), 4)
    assert result(spark, path, labels) == brute([(r[0], r[1], r[2]) for r in awkward()], labels)


def test_empty_table(spark):
    assert result(spark, table(empty_docs(spark), 1), []) == {}


def test_single_file(spark):
    import glob

    rows = some_rows(random.Random(1), 10)
    path = glob.glob(table(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 1) + "/*.parquet")[0]
    assert result(spark, path, []) == brute(rows, [])
