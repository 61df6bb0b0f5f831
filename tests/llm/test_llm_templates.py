"""Line templates against a plain reading of the rule."""

import random
import re

from llm_fixtures import LOWER, WORD, awkward, awkward_docs, empty_docs, prose

from metaloom.llm import templates


def template(line):
    """The tokens with fields blanked, as they are if most are fields; None for a line that is too short."""
    plain = WORD.findall(line.translate(LOWER))
    tokens = ["*" if re.search("[0-9@/]", t) else t for t in plain]
    constant = len(tokens) - tokens.count("*")
    return tuple(tokens if constant >= max(2, (len(tokens) + 1) // 2) else plain) if len(plain) >= templates.MIN_TOKENS else None


def brute(texts, min_docs, long_docs=3):
    """Kept text per document; documents are unlike if their words differ, so texts must share none but planted lines."""
    where = {}
    for d, text in enumerate(texts):
        for line in (text or "").split("\n"):
            if template(line):
                where.setdefault(template(line), set()).add(d)
    context = {d: tuple(WORD.findall((t or "").translate(LOWER))) for d, t in enumerate(texts)}
    recurring = set()
    for key, docs in where.items():
        different = len({context[d] for d in docs})
        if different >= (min(min_docs, long_docs) if len(key) >= 20 else min_docs):
            recurring.add(key)
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        out.append("\n".join(x for x in lines if template(x) not in recurring))
    return out


def planted():
    rng = random.Random(6)
    texts = []
    for i in range(60):
        lines = ["\n".join(prose(rng, 40, 10**6) for _ in range(4))]
        if i % 3 == 0:
            lines.insert(0, f"Posted on day {rng.randrange(99)} by user{i} with {rng.randrange(9)} replies")
        if i % 4 == 0:
            lines.append("Follow us on every network for more stories")
        if i % 20 == 0:
            lines.append("seen in three documents only here")
        texts.append("\n".join(lines))
    copied = "\n".join(prose(rng, 40, 10**6) for _ in range(5))
    texts += [copied] * 30 + ["Follow us on every network for more stories\nshort text", "", None, "a b", "\n\n"]
    return texts


def test_planted_lines_go_and_copies_stay(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in templates.drop_recurring_lines(spark, docs).select("row.doc_id", "n_lines", "n_dropped", "left_over").collect()}
    expected = brute(texts, 10)
    assert [found[i].left_over for i in range(len(texts))] == expected
    assert "Posted" not in "".join(expected) and "Follow us" not in "".join(expected[:60])
    assert all(found[i].n_dropped == 0 for i in range(60, 90)), "copies keep their lines"
    assert sum("seen in three" in found[i].left_over for i in range(60)) == 3
    assert found[90].left_over == "short text", "a text that is mostly boilerplate loses it too"
    assert [found[i].n_lines for i in (91, 92, 93)] == [0, 0, 1]


def test_thresholds_are_parameters(spark):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = templates.drop_recurring_lines(spark, docs, min_docs=3).select("row.doc_id", "left_over").collect()
    assert [x for _, x in sorted((r.doc_id, r.left_over) for r in found)] == brute(texts, 3)


def test_lines_that_occur_once_stay(spark):
    """Rows of numbers, and lines that begin alike but end in words of their own."""
    rng = random.Random(12)
    texts = []
    for i in range(30):
        own = " ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(4))
        lines = [prose(rng, 40, 10**6), " ".join(str(rng.randrange(10**6)) for _ in range(6)), f"The result of this work {own}", f"{i} {2 * i} apples {i}"]
        texts.append("\n".join(lines))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = templates.drop_recurring_lines(spark, docs, min_docs=4).select("row.doc_id", "left_over").collect()
    assert {r.doc_id: r.left_over for r in found} == dict(enumerate(texts))


def test_partitions_do_not_matter(spark):
    """Contexts that are alike in a chain: whichever come first, the same lines go."""
    rng = random.Random(13)
    words_ = [f"c{i}" for i in range(400)]
    lines = [f"shared line number {chr(97 + i)} of the set" for i in range(8)]
    texts = [" ".join(words_[4 * i : 4 * i + 40]) + "\n" + "\n".join(rng.sample(lines, 5)) for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [
        sorted((r.doc_id, r.left_over) for r in templates.drop_recurring_lines(spark, docs.repartition(n), min_docs=4).select("row.doc_id", "left_over").collect())
        for n in (1, 3, 12)
    ]
    assert found[0] == found[1] == found[2]


def test_awkward_and_empty(spark):
    found = templates.drop_recurring_lines(spark, awkward_docs(spark)).select("row.*", "n_lines", "n_dropped", "left_over").collect()
    assert len(found) == len(awkward()) and {r.kept for r in found} == {"kept"}
    texts = sorted((r[1] or "") for r in awkward())
    assert sorted(r.left_over for r in found) == texts
    assert templates.drop_recurring_lines(spark, empty_docs(spark)).collect() == []
