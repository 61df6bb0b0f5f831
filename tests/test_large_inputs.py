"""Readers and searches for what is too large for one task, against plain versions on small inputs."""

import csv
import io
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaloom.operators import lookup as L, nearest as N, pivots as V
from metaloom.operators.containment import contained, words_holding, words_met
from metaloom.sources import delimited as D, files as FS, json_docs as J, json_stream as JS


def some_items(rng, n, breaks=True):
    words = ["a", "x\\", 'q"', "\\\\\"", "]}", "{[,", "é😀", "line\nbreak", "", "y" * 40]
    leaf = lambda: rng.choice([None, True, -1.5e30, 12345678901234567890, rng.choice(words), rng.choice(words)])

    def value(depth):
        kind = rng.random()
        if depth > 3 or kind < 0.4:
            return leaf()
        if kind < 0.7:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice(words): value(depth + 1) for _ in range(rng.randrange(4))}

    return [value(0) for _ in range(n)]


def items_of(spark, path, width):
    rows = JS.read_items(FS.list_files(spark, path), width).collect()
    return sorted(((r["position"], r["item"], r["error"]) for r in rows), key=lambda r: (r[0], r[1] is None))


@pytest.mark.parametrize("width", [1, 5, 33, 1000])
def test_split_arrays(spark, tmp_path, width):
    """Items of an array whose ranges end anywhere: in strings, escapes, brackets, characters."""
    rng = random.Random(width)
    for k in range(2):
        some = some_items(rng, 30)
        text = " " * k + "[" + " , ".join(json.dumps(i, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1])) for i in some) + "]\n"
        path = tmp_path / f"{k}.json"
        path.write_bytes(b"\xef\xbb\xbf" * k + text.encode())
        found = items_of(spark, str(path), width)
        assert [p for p, _, _ in found] == list(range(len(some))) and all(e is None for _, _, e in found)
        assert [json.loads(t, strict=False) for _, t, _ in found] == some


@pytest.mark.parametrize("width", [3, 17, 1 << 20])
@pytest.mark.parametrize("text,good,bad", [
    ('[{"a":1},{"a":oops},{"a":2}]', [0, 2], [1]),
    ('[{"a":1},\n{"a":"open},\n{"a":2},\n{"a":3}]', [0], [1]),
    ('[1,,2]', [0, 2], [1]), ("[]", [], []), ("[ ]", [], []), ('{"a":[1,2]}', [], [0]), ("[1,2", [0, 1], [2]), ("[1],[2]", [0], []), ("", [], [0]),
])
def test_broken_arrays(spark, tmp_path, width, text, good, bad):
    path = tmp_path / "a.json"
    path.write_text(text)
    if not text:  # files without a byte are not listed by the engine
        found = list(JS.array_items(io.BytesIO(b""), 4))
    else:
        found = items_of(spark, str(path), width)
    assert [p for p, _, e in found if e is None] == good
    assert [p for p, _, e in found if e is not None] == bad


def test_items_above_the_limit_are_errors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(JS, "LARGEST_DOCUMENT", 500)
    text = json.dumps([{"a": 1}, {"a": "x" * 2000}, {"a": 2}])
    for chunk in (7, 600, 1 << 20):
        found = list(JS.array_items(io.BytesIO(text.encode()), chunk))
        assert [(p, e is None) for p, _, e in found] == [(0, True), (1, False), (2, True)]


def test_ranges_cover_an_array_with_many_tasks(spark, tmp_path):
    item = json.dumps({"a": "x" * 50_000, "b": [1, {"c": "]"}]})
    path = tmp_path / "a.json"
    path.write_text("[" + ",\n".join([item] * 400) + "]")
    ranges = JS.array_ranges(FS.list_files(spark, str(path)), 1 << 20)
    assert ranges.count() == -(-path.stat().st_size // (1 << 20))
    got = J.read_json(spark, str(path), range_bytes=1 << 20)
    assert got.agg(F.count("fields"), F.count("error"), F.count_distinct("position"), F.max("position")).first() == (400, 0, 400, 399)


@pytest.mark.parametrize("width", [1, 9, 64])
def test_split_records(spark, tmp_path, width):
    """Records of a file whose ranges end in quoted cells, pairs of quotes, line ends and characters."""
    rng = random.Random(width)
    cells = ["1", "", "x y", 'a "quoted" cell', "line\nbreak", "\r\n", '""', ",", "é😀", '5" pipe', "z" * 30, "\n"]
    expected = []
    files = []
    for k, encoding in enumerate(["utf-8-sig", "utf-8", "iso-8859-1"]):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]))
        some = [["h1", "h2", "h3"]] + [[rng.choice(cells) for _ in range(3)] for _ in range(25)]
        for row in some:
            writer.writerow(row)
        text = out.getvalue() + '6" bare,7" too,8\n'
        path = tmp_path / f"{k}.csv"
        path.write_bytes(text.encode(encoding, "replace"))
        files.append((f"file:{path}", "UTF-8" if k < 2 else "ISO-8859-1", ",", path.stat().st_size))
        body = path.read_bytes().decode("utf-8-sig" if k < 2 else "iso-8859-1")
        rows = list(csv.reader(io.StringIO(body, newline="")))[1:]
        expected += [(f"file:{path}", r) for r in rows if len(r) > 1]
    table = spark.createDataFrame(files, "path string, encoding string, delimiter string, length long")
    found = D.streamed_cells(table, width).collect()
    assert sorted((r["path"], list(r["cells"])) for r in found) == sorted(expected)


def patterns_and_texts(rng):
    words = ["the", "heart", "art", "a", "disease", "unit", "Ünit", "x" * 300, "co-op", "ar", "日本", "本", "😀😀", ".", "diseases"]
    texts = [rng.choice(["", " ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    texts += [None, "", "   ", "heart  disease", "the heart disease unit", "z" * 50_000 + "heart"]
    patterns = words + ["heart disease", "heart  disease", "art dis", "the heart disease un", "nowhere", "t d", " heart", "unit ", "", " ", "  ", "\n", None, "heart nowhere", "zzzzheart"]
    return [(i, t) for i, t in enumerate(texts)], patterns


def test_gram_index_equals_plain_containment(spark):
    texts, patterns = patterns_and_texts(random.Random(1))
    found = contained(spark.createDataFrame(texts, "id long, body string"), spark.createDataFrame([(p,) for p in patterns + patterns[:3]], "pattern string"))
    got = sorted(map(tuple, found.collect()))
    assert got == sorted((i, p) for i, t in texts for p in set(patterns) if t is not None and p is not None and p in t)


def test_gram_index_of_nothing(spark):
    texts, none = spark.createDataFrame([(1, "a b")], "id long, body string"), spark.createDataFrame([], "pattern string")
    assert contained(texts, none).count() == 0
    assert contained(texts.where("id > 1"), spark.createDataFrame([("a",)], "pattern string")).count() == 0


@pytest.mark.parametrize("mode", ["any_word", "whole"])
def test_large_dictionary_finds_what_blocks_find(spark, monkeypatch, mode):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["alpha", "beta", "al"]
    dims = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(1, 4))), f"u{i}") for i in range(120)] + [(500, "", "e")], "ord long, label string, uri string")
    texts = spark.createDataFrame([(i, " ".join(rng.choices(words, k=8)).upper()) for i in range(40)] + [(99, "nothing"), (98, None)], "k long, text string")
    few = dims.where("ord < 3")
    plain = sorted(map(tuple, L.relevant_labels(texts, dims, "k", "text", mode, fallback=few).collect()))
    monkeypatch.setattr(L, "BLOCK_ROWS", 2)
    indexed = sorted(map(tuple, L.relevant_labels(texts, dims, "k", "text", mode, fallback=few).collect()))
    assert indexed == plain and len(plain) > 40


def test_large_hint_table_finds_what_blocks_find(spark, monkeypatch):
    rng = random.Random(4)
    hints = spark.createDataFrame([(i, f"w{rng.randrange(50)}", f"h{i}") for i in range(90)], "ord long, word string, hint string")
    texts = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(80)}" for _ in range(5))) for i in range(30)] + [(7, None), (8, "w1 w2"), (8, "w1 w2")], "k long, text string")
    plain = sorted(map(str, L.expand_hints(texts, hints, "text").collect()))
    monkeypatch.setattr(L, "BLOCK_ROWS", 2)
    assert sorted(map(str, L.expand_hints(texts, hints, "text").collect())) == plain


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("by", [[], ["feature"]])
def test_pivot_cells_find_what_blocks_find(spark, metric, by):
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(30, 12)) * 6
    rows = [(f"f{i % 3}" if i % 40 else "rare", f"c{i:04d}", f"u{i}", (middles[rng.integers(30)] + rng.normal(size=12)).tolist()) for i in range(1500)]
    rows += [("f1", "tie1", "t", [0.0] * 12), ("f1", "tie2", "t", [0.0] * 12), ("lone", "only", "t", [1.0] * 12)]
    vocab = spark.createDataFrame(rows, "feature string, code string, uri string, vector array<double>")
    asked = [(i, ["f0", "f1", "f2", "rare", "lone", "none"][i % 6], (middles[rng.integers(30)] + rng.normal(size=12)).tolist()) for i in range(90)]
    asked += [(900, "f1", [0.0] * 12), (901, "f1", [1e6] * 12)]
    queries = spark.createDataFrame(asked, "k long, feature string, vector array<double>")
    flat = lambda df: sorted(map(tuple, df.select("k", *by, F.inline("best")).withColumn("distance", F.round("distance", 9)).collect()))
    expected = flat(N.scan_blocks(queries, vocab, "k", 4, by, metric, 1500))
    found, visits = V.pivot_nearest(queries, vocab, "k", 4, by, metric, 1500, cell=20)
    assert flat(found) == expected
    near = visits.where("k < 900").agg(F.sum("visited"), F.sum("cells")).first()
    assert near[0] < 0.5 * near[1]
    if by:  # a query knows the cells of its own feature only
        assert visits.where("feature = 'lone'").agg(F.max("visited")).first()[0] == 1


def test_a_range_of_a_file_costs_the_memory_of_a_chunk():
    """Four megabytes in chunks: the same findings as in one piece, in a tenth of the memory."""
    import tracemalloc

    data = b'1,"a\n""x"", b",2\n' * 240_000 + b"1,2,3,4\nin\"ch,,,,,,\n"
    whole = D.Body(b"", b",")
    whole.read(data)
    tracemalloc.start()
    parts = D.Body(b"", b",")
    for i in range(0, len(data), 1 << 16):
        parts.read(data[i : i + (1 << 16)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = [(b.odd, b.outer, b.inner, b.opens, b.cells) for b in (whole, parts)]
    assert found[0] == found[1] == (1, True, True, True, 4) and peak < 4 << 20


def test_short_patterns_meet_no_word_in_vain(spark):
    """Keys of one form: few grams of four characters tell them apart, so nearly all words would be confirmed."""
    words = [f"l{i}" for i in range(100, 3000, 7)] + ["é" * 20 + f"tail{i}" for i in range(5)]
    parts = [f"l{i}" for i in range(1, 3000, 5)] + ["é" * 18 + "tail3", "é" * 21, "ail"]
    vocabulary = spark.createDataFrame([(w,) for w in words], "token string")
    asked = spark.createDataFrame([(p,) for p in parts], "part string")
    expected = {(p, w) for p in parts for w in words if p in w}
    assert {tuple(r) for r in words_holding(vocabulary, asked).collect()} == expected
    short = words_met(vocabulary, asked.where("length(part) <= 16"))
    assert short.count() == sum(len(p) <= 16 for p, _ in expected)


def test_the_array_of_a_table_is_written_row_by_row(spark, monkeypatch):
    """No task holds the whole file as one text, which the JVM bounds at 2 GB."""
    from pyspark.sql import DataFrameReader

    from metaloom.plans import catalog

    texts, plain = [], DataFrameReader.text
    monkeypatch.setattr(DataFrameReader, "text", lambda self, *a, **kw: texts.append(kw.get("wholetext", False)) or plain(self, *a, **kw))
    assert catalog.QUERIES["a5_split_array"](spark, "/root/testdata/sf0.001").count() > 0 and True not in texts


def test_no_file_of_arrays_grows_with_the_table(spark, monkeypatch):
    """A task writes one file, so the events are many arrays; their items keep their places in the table."""
    from metaloom.plans import catalog, edges

    monkeypatch.setattr(edges, "ARRAY_ROWS", 300, raising=False)
    places, plain = [], J.read_json
    monkeypatch.setattr(J, "read_json", lambda spark, path, **kw: places.append(path) or plain(spark, path, **kw))
    rows = catalog.QUERIES["a5_split_array"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    files = FS.list_files(spark, places[0]).where("length > 0")
    assert n > 300 and files.count() == -(-n // 300)
    assert rows.where("position = cast(id as bigint)").count() == rows.count() == n
