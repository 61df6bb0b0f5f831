"""Boilerplate among copies, long passages in few documents."""

import random

from llm_fixtures import prose

from metaloom.llm import templates


def left(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id: r.left_over for r in templates.drop_recurring_lines(spark, docs, **how).select("row.doc_id", "left_over").collect()}


def body(rng, lines=4):
    return "\n".join(prose(rng, 40, 10**6) for _ in range(lines))


def test_copies_do_not_hide_boilerplate(spark):
    rng = random.Random(8)
    line = "Follow us on every network for more stories"
    texts = [f"{body(rng)}\n{line}" for _ in range(20)]
    copied = body(rng)
    texts += [f"{copied}\n{line}"] * 80
    found = left(spark, texts)
    assert all(line not in t for t in found.values())
    assert all(found[i] == copied for i in range(20, 100)), "the text of the copies stays"


def test_a_long_passage_in_three_unlike_documents_goes(spark):
    rng = random.Random(9)
    passage, short = prose(rng, 60, 10**6), "seen in three documents only here"
    bodies = [body(rng) for _ in range(3)]
    found = left(spark, [f"{b}\n{passage}\n{short}" for b in bodies])
    assert [found[i] for i in range(3)] == [f"{b}\n{short}" for b in bodies]


def test_near_copies_keep_their_lines(spark):
    rng = random.Random(10)
    base = [prose(rng, 40, 10**6) for _ in range(8)]
    texts = []
    for _ in range(200):
        lines = list(base)
        for i in rng.sample(range(8), 2):
            w = lines[i].split(" ")
            w[rng.randrange(40)] = f"edit{rng.randrange(10**6)}"
            lines[i] = " ".join(w)
        texts.append("\n".join(lines))
    assert left(spark, texts) == dict(enumerate(texts))
