"""A benchmark larger than one automaton gives the same rows."""

import random

import pytest
from llm_fixtures import awkward_docs, prose

from metaloom.llm import benchmark


def test_groups_give_what_one_automaton_gives(spark):
    rng = random.Random(12)
    items = [(i, prose(rng, rng.randrange(3, 40), 60)) for i in range(40)] + [(50, None), (None, "b"), (51, prose(rng, 900, 60))]
    texts = [prose(rng, 80, 60) + " " + items[i % 40][1] + "\n" + items[(i * 7 + 1) % 40][1] + " Ünd" for i in range(60)] + [None, "", items[3][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    table = spark.createDataFrame(items, "item_id long, text string")
    with pytest.raises(ValueError):
        benchmark.item_groups(table, 100)
    _, ranges = benchmark.split_items(table, 100)
    assert len(ranges) > 2
    whole = benchmark.scan_items(spark, docs, table).orderBy("row.doc_id").collect()
    assert benchmark.scan_items(spark, docs, table, limit=100).orderBy("row.doc_id").collect() == whole
    assert sum(r.n_hit > 0 for r in whole) >= 50
    assert benchmark.scan_items(spark, awkward_docs(spark), table, limit=100).count() == awkward_docs(spark).count()
