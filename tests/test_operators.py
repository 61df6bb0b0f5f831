"""Operators against brute force and hand-computed answers, hot keys included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metaloom import catalogue as C
from metaloom.operators import answers as N, assemble as A, lookup as L, nearest as K, rules as R, sampling as M, spatial as G, triples as T


def vectors(spark, n, dim, seed, cols):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)).astype("float32")
    data[n // 2:: 3] = data[0]  # a third of the second half are copies
    pdf = pd.DataFrame({cols[0]: range(n), cols[1]: data.tolist()})
    return spark.createDataFrame(pdf), data.astype("float64")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("blocked", [False, True])
def test_nearest_is_exact(spark, monkeypatch, blocked, metric):
    if blocked:
        monkeypatch.setattr(K, "BROADCAST_VECTORS", 10)
        monkeypatch.setattr(K, "BLOCK_VECTORS", 25)
        monkeypatch.setattr(K, "QUERY_CHUNK", 12)
    q, qm = vectors(spark, 40, 6, 1, ("id", "vector"))
    v, vm = vectors(spark, 110, 6, 2, ("n", "vector"))
    vocab = v.select(F.format_string("c%03d", "n").alias("code"), F.lit("u").alias("uri"), "vector")
    got = {}
    for r in K.nearest(q, vocab, "id", 4, metric=metric).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["code"], r["distance"])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    a, b = (unit(qm), unit(vm)) if metric == "cosine" else (qm, vm)
    for i in range(len(a)):
        d = ((b - a[i]) ** 2).sum(axis=1) / (2 if metric == "cosine" else 1)
        order = sorted(range(len(b)), key=lambda j: (round(d[j], 12), j))[:4]
        assert [got[i][k + 1][0] for k in range(4)] == [f"c{j:03d}" for j in order]
        assert np.allclose([got[i][k + 1][1] for k in range(4)], d[order])


def test_nearest_by_feature_and_cut(spark):
    q = spark.createDataFrame([(1, "f", [0.0, 0.0]), (2, "g", [0.0, 0.0]), (3, "none", [1.0, 1.0])], "id int, feature string, vector array<float>")
    vocab = spark.createDataFrame(
        [("f", "a", "ua", [0.316, 0.0]), ("f", "b", "ub", [0.331, 0.0]), ("f", "c", "uc", [0.949, 0.0]), ("g", "z", None, [1.0, 0.0])],
        "feature string, code string, uri string, vector array<float>",
    )
    out = K.similarity_match(q, vocab, "id", 3, True, by=["feature"])
    assert {r["id"]: r["uris"] for r in out.collect()} == {1: ["ua", "ub"]}


def test_numbering_with_a_hot_key(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 != 1, 0).otherwise(F.col("id") % 50).alias("k"), (F.col("id") * 7 % 2003).alias("o")
    )
    got = M.number_rows(df, ["k"], "o", slices=8).toPandas().sort_values(["k", "o"])
    want = got.groupby("k")["o"].rank(method="first").astype(int)
    assert (got["n"] == want).all()


def test_numbering_of_nothing(spark):
    assert M.number_rows(spark.range(0).select(F.lit(1).alias("k"), "id"), ["k"], "id").count() == 0


def test_sample_size_and_budget(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("d"), F.lit("x" * 10).alias("t"))
    sample = M.uniform_sample(df, ["id"], ["d"], 20)
    assert {r["d"]: r["count"] for r in sample.groupBy("d").count().collect()} == {0: 20, 1: 20}
    assert M.char_budget(sample, ["d"], ["id"], F.col("t"), 55).count() == 10
    assert M.uniform_sample(df, ["id"], k=20, seed="a").collect() == M.uniform_sample(df.repartition(5), ["id"], k=20, seed="a").collect()


@pytest.mark.parametrize("rows_per_block,broadcast", [(2000, 16), (7, 16), (3, 1)])
def test_relevant_labels_over_blocks(spark, monkeypatch, rows_per_block, broadcast):
    monkeypatch.setattr(L, "BLOCK_ROWS", rows_per_block)
    monkeypatch.setattr(L, "BROADCAST_BLOCKS", broadcast)
    words = [f"w{i:02d} v{i:02d}" for i in range(20)]
    labels = spark.createDataFrame([(i, w, f"u{i}") for i, w in enumerate(words)], "ord int, label string, uri string")
    texts = spark.createDataFrame([(i, f"A W{i % 23:02d} and v{i % 7:02d}x") for i in range(60)] + [(99, "nothing")], "id int, text string")
    got = L.relevant_labels(texts, labels, "id", "text", fallback=L.first_entries(labels, 2))
    want = set()
    for i in range(60):
        text = f"a w{i % 23:02d} and v{i % 7:02d}x"
        hits = {(i, j) for j, w in enumerate(words) if any(p in text for p in w.split())}
        want |= hits or {(i, 0), (i, 1)}
    want |= {(99, 0), (99, 1)}
    assert {(r["id"], r["ord"]) for r in got.collect()} == want


def test_help_entry(spark):
    guide = spark.createDataFrame([(1, "title", "T"), (2, "contact", "C"), (3, "contact.email", "E")], "ord int, name string, label string")
    fields = spark.createDataFrame([("title",), ("contact.email",), ("contact.url",), ("zz",), ("tit",)], "field string")
    got = {r["field"]: r["label"] for r in L.help_entry(fields, guide).collect()}
    assert got == {"title": "T", "contact.email": "E", "contact.url": "C", "zz": "zz", "tit": "T"}


def test_geographic_cascade(spark):
    sizes = spark.createDataFrame([("provinces", 20), ("autonomies", 10), ("countries", 50), ("continents", 6)], "level string, size long")
    hits = spark.createDataFrame(
        [(1, "provinces", 1, "p1"), (1, "provinces", 0, "p0"), (1, "continents", 2, "c"), (1, "continents", 3, "c"),
         (2, "provinces", 1, "p1"), (2, "provinces", 2, "p2"), (2, "provinces", 3, "p3"), (2, "autonomies", 4, "a"),
         (3, "autonomies", 1, "a"), (3, "autonomies", 2, "b")],
        "d int, level string, ord int, uri string",
    )
    datasets = spark.createDataFrame([(1,), (2,), (3,), (4,)], "d int")
    got = {r["d"]: r["uris"] for r in G.coverage_uris(hits, sizes, datasets, "d").collect()}
    assert got == {1: ["p0", "p1", "c"], 2: ["a"], 3: [G.DEFAULT_PLACE], 4: [G.DEFAULT_PLACE]}


def test_fold_of_partial_records(spark):
    log = [
        (1, "title", None, None), (2, "title", None, '"a"'), (3, "title", None, None),
        (4, "hdab", "email", '"x"'), (5, "hdab", "page", '"p"'), (6, "hdab", "email", None),
        (7, "empty", None, None), (8, "contact", "n", '"old"'), (9, "contact", None, '"plain"'),
    ]
    df = spark.createDataFrame([(0, *r) for r in log], "dataset_id int, seq long, field string, subfield string, value string")
    got = {(r["field"], r["subfield"]): r["value"] for r in A.fold_changes(df).collect()}
    assert got == {("title", None): '"a"', ("hdab", "email"): None, ("hdab", "page"): '"p"', ("empty", None): None, ("contact", None): '"plain"'}


def test_second_run_differs_only_in_versions(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("id,age,day\na,30,2020-01-05\nb,41,2021-02-03\na,7,2019-12-31\n")
    structure = {
        "number_of_unique_individuals": [{"columns": ["id"], "transform": []}],
        "min_typical_age": [{"columns": ["age"], "transform": []}], "max_typical_age": [{"columns": ["age"], "transform": []}],
        "temporal_coverage": [{p: {"column": "day", "transform": [{"op": "to_datetime_part", "params": {"part": p}}]} for p in ("year", "month", "day")}],
    }
    datasets = spark.createDataFrame([("d",)], "dataset_id string")
    stats = C.statistics(spark, "d", str(path), structure)
    first = C.assemble(datasets, stats, "2024-01-01T00:00:00.000Z")
    values = {r["field"]: r["value"] for r in first.collect()}
    assert values["number_of_unique_individuals"] == "2" and values["min_typical_age"] == "7"
    assert values["temporal_coverage"] == '{"start":"2019-12-31","end":"2021-02-03"}'
    second = C.assemble(datasets, stats, "2025-05-05T00:00:00.000Z", overrides=first)
    assert A.record_diff(first, second).collect() == []
    assert {r["field"]: r["value"] for r in second.collect()}["version"] == '"2.0"'


def test_escapes_and_fences(spark):
    raw = ['```json\n{"a": "x\\d \\\\ \\u00e9 \\u12"}\n```', '{"a": 1}', "```\nson of\n```"]
    df = spark.createDataFrame([(r,) for r in raw], "t string")
    got = [r[0] for r in df.select(N.clean_answer(F.col("t"))).collect()]
    assert got == ['{"a": "x\\\\d \\\\ \\u00e9 \\\\u12"}', '{"a": 1}', "son of"]


def test_required_with_dotted_names(spark):
    datasets = spark.createDataFrame([(1,), (2,)], "dataset_id int")
    values = spark.createDataFrame([(1, "hdab", '{"email":"a@b.c"}'), (2, "hdab", '{"email":""}')], "dataset_id int, field string, value string")
    findings = R.validate(values, spark.createDataFrame([], R.RULES_SCHEMA))
    required = spark.createDataFrame([(1, "hdab.email"), (2, "hdab")], "ord int, field string")
    got = {(r["dataset_id"], r["field"]) for r in R.missing_required(datasets, values, findings, required).collect()}
    assert got == {(2, "hdab.email")}


def test_literals_survive_the_triple_text(spark):
    texts = ['a "quoted" \\ back', "line\nbreak\ttab \\n", 'ends \\', '# " .', "\u0001 x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, title string")
    triples = T.record_triples(df, "k").where(F.col("o_kind") == "literal")
    back = T.parse_ntriples(T.ntriples(triples))
    assert sorted(r["o"] for r in back.collect()) == sorted(texts)
    odd = spark.createDataFrame([("# note",), ("",), ("<a> <b> .",), ('<a> <b> "c"@en . # end "x"',)], "value string")
    assert [(r["o"], r["lang"]) for r in T.parse_ntriples(odd).collect()] == [("c", "en")]
