"""Files that are broken, large, mixed or clash, and functions without a query of their own."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from metaloom import catalogue as C
from metaloom.functions.text import last_wins
from metaloom.operators import profile as P, shape as S, triples as X
from metaloom.operators.nearest import nearest
from metaloom.sources import delimited as D, files as FS, json_docs as J, json_stream as JS, xml_docs as XM


def save(tmp_path, name, data):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))
    return str(path)


def rows(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=str)


# ── delimited ────────────────────────────────────────────────────────────────

@pytest.mark.parametrize("width", [7, 64, 1 << 20])
def test_quotes_and_widths_over_ranges(spark, tmp_path, monkeypatch, width):
    """Line breaks in cells and long lines are found wherever the ranges are cut."""
    monkeypatch.setattr(D, "RANGE_BYTES", width)
    save(tmp_path, "plain.csv", "a,b\n1,2\n3,4,5\n6\n")
    save(tmp_path, "span.csv", 'a,b\n1,"x\ny"\n2,"q"\n')
    save(tmp_path, "inch.csv", 'a,b\n1,5" pipe\n2,x\n')
    save(tmp_path, "open.csv", 'a,b\n1,"x\n2,y\n')
    save(tmp_path, "quoted.csv", 'a,b\n"1","2, and"\n')
    save(tmp_path, "empty.csv", "")
    files = FS.list_files(spark, str(tmp_path))
    found = {r["path"].rsplit("/", 1)[-1]: (r["spanning"], r["cells"]) for r in D.body_state(files, D.sniff(files)).collect()}
    assert {n: s for n, (s, _) in found.items() if s} == {"span.csv": True}
    assert found["plain.csv"][1] == 3


def test_only_files_with_spanning_cells_are_read_whole(spark, tmp_path):
    save(tmp_path, "a.csv", 'id,note\n1,"x\ny"\n')
    save(tmp_path, "b.csv", 'id,note\n2,5" pipe\n3,plain\n')
    assert rows(D.read_csv(spark, str(tmp_path))) == [
        {"id": "1", "note": "x\ny"}, {"id": "2", "note": '5" pipe'}, {"id": "3", "note": "plain"},
    ]


def test_blank_lines_above_the_header(spark, tmp_path):
    path = save(tmp_path, "a.csv", "\n  \n\tname\n0\tAnn\n")
    assert D.sniff(FS.list_files(spark, path)).first()["header"] == "\tname"


def test_read_many_repeated_header_names(spark, tmp_path):
    save(tmp_path, "a.csv", "x;x\n1;2;3\n")
    got = D.read_many(spark, FS.list_files(spark, str(tmp_path))).first()["fields"]
    assert got == {"x": "1", "x.1": "2", "Unnamed: 2": "3"}


# ── JSON ─────────────────────────────────────────────────────────────────────

@pytest.mark.parametrize("chunk", [1, 3, 17, 1 << 20])
def test_items_of_any_chunking(chunk):
    rng = random.Random(chunk)
    items = [{"a": 1, "b": [1, {"c": "x]}"}]}, 12345, -1.5e3, "é\\\"😀", None, [[]], {}, True, "y" * 50]
    for _ in range(20):
        some = rng.choices(items, k=rng.randrange(0, 6))
        text = " [ " + " ,\n".join(json.dumps(i, ensure_ascii=rng.random() < 0.5) for i in some) + " ] \n"
        found = list(JS.array_items(io.BytesIO(text.encode()), chunk))
        assert [json.loads(t) for _, t, _ in found] == some and all(e is None for _, _, e in found)


@pytest.mark.parametrize("text,good,error", [
    ('[{"a":1},{"a":2},', 2, "not closed"), ('[{"a":1},{"a":', 1, "broken"), ("[1 2]", 1, "comma"), ('{"a":1}', 0, "no array"),
    ("", 0, "no array"), ("[", 0, "not closed"), ('[{"a":1}', 1, "not closed"), ("[1,]", 1, "broken"), ("[]", 0, None),
])
def test_broken_arrays_keep_what_is_before(text, good, error):
    found = list(JS.array_items(io.BytesIO(text.encode()), 4))
    assert sum(e is None for _, _, e in found) == good
    assert (error is None and not [e for _, _, e in found if e]) or error in found[-1][2]


def test_large_array(spark, tmp_path):
    """An array of 200 MB: more than the parser takes as one document."""
    item = json.dumps({"a": "x" * 999_980})
    with open(tmp_path / "a.json", "w") as out:
        out.write("[" + ",".join(item for _ in range(200)) + "]")
    got = J.read_json(spark, str(tmp_path / "a.json"))
    assert got.agg(F.count("fields"), F.count("error"), F.max(F.length(F.col("fields")["a"]))).first() == (200, 0, 999_980)


def test_documents_that_cannot_be_read_are_rows(spark, tmp_path):
    save(tmp_path, "a.json", '{"rows": [{"x": 1}')
    save(tmp_path, "b.json", '[{"x": 1}, NaN]')
    got = J.read_json(spark, str(tmp_path)).select("position", F.col("fields")["x"].alias("x"), F.col("error").isNotNull().alias("bad"))
    assert rows(got) == rows(spark.createDataFrame([(0, None, True), (0, "1", False), (1, None, True)], "position bigint, x string, bad boolean"))
    assert C.records_frame(J.read_json(spark, str(tmp_path))).count() == 1


def test_deep_values(spark):
    text = '{"a":' * 60 + "1" + "}" * 60
    df = spark.createDataFrame([(text,)], "value string")
    assert J.line_records(df).first()["fields"] == {".".join(["a"] * 60): "1"}


def test_last_wins(spark):
    df = spark.createDataFrame([([("a", 1), ("b", 2), ("a", 3)],), ([],), (None,)], "p array<struct<key:string,value:int>>")
    assert [r[0] for r in df.select(last_wins(F.col("p"))).collect()] == [{"a": 3, "b": 2}, {}, None]


def test_list_of_objects_keeps_its_key_order(spark):
    df = spark.createDataFrame([('{"l":[{"b":1,"a":2.50}],"o":{"m":[{"z":1,"y":[{"d":1,"c":2}]}]}}',)], "value string")
    assert J.line_records(df).first()["fields"] == {"l": '[{"b": 1, "a": 2.50}]', "o.m": '[{"z": 1, "y": [{"d": 1, "c": 2}]}]'} or \
        J.line_records(df).first()["fields"]["o.m"] == '[{"z": 1, "y": [{"d": 1, "c": 2}]}]'


# ── XML, files ───────────────────────────────────────────────────────────────

def test_xml_folder_with_two_tags(spark, tmp_path):
    save(tmp_path, "a.xml", "<r><i><x>1</x></i><i><x>2</x></i></r>")
    save(tmp_path, "b.xml", "<r><k y='3'/><k y='4'/></r>")
    got = sorted((dict(r["fields"]) for r in XM.read_xml(spark, str(tmp_path)).collect()), key=str)
    assert got == [{"x": "1"}, {"x": "2"}, {"y": "3"}, {"y": "4"}]


def test_entity_declarations_are_refused(spark, tmp_path):
    path = save(tmp_path, "a.xml", '<!DOCTYPE r [<!ENTITY a "aaaa"><!ENTITY b "&a;&a;">]><r><i>&b;</i></r>')
    assert XM.record_tags(spark.createDataFrame([(path,)], "path string")).first()["tag"] is None


def test_file_hash_in_chunks(spark, tmp_path):
    import hashlib

    data = bytes(range(256)) * 20_000
    save(tmp_path, "a.bin", data)
    save(tmp_path, "b.csv", b"x")
    got = {r["path"].rsplit("/", 1)[-1]: (r["size"], r["hash"]) for r in FS.file_facts(spark, str(tmp_path)).collect()}
    assert got == {"a.bin": (len(data), hashlib.sha256(data).hexdigest()), "b.csv": (1, hashlib.sha256(b"x").hexdigest())}


# ── statistics, vectors, literals ────────────────────────────────────────────

def test_blank_statistics_publish_nothing(spark):
    given = dict.fromkeys(P.STAT_FIELDS, " ")
    got = C.statistics(spark, "d", "/nowhere.parquet", {}, given)
    assert {r["value"] for r in got.collect()} == {None}


def test_dates_in_free_text(spark):
    df = spark.createDataFrame([(f"{d}th of March 2021",) for d in range(4, 20)], "d string")
    assert P.date_columns(df, ["d"]).first()["is_date"]


def test_missing_vectors_have_no_neighbours(spark, monkeypatch):
    from metaloom.operators import nearest as K

    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "id int, vector array<double>")
    v = spark.createDataFrame([("a", "u", [0.0, 1.0]), ("b", "u", None)], "code string, uri string, vector array<double>")
    for limit in (10, 0):
        monkeypatch.setattr(K, "BROADCAST_VECTORS", limit)
        assert [(r["id"], r["code"]) for r in nearest(q, v, "id", 2).collect()] == [(1, "a")]


def test_typed_inventory(spark):
    df = spark.createDataFrame([(1, [(1, ["p", "q"])], [[5]])], "k int, items array<struct<a:int,b:array<string>>>, n array<array<int>>")
    assert {(r["path"], r["sample"]) for r in S.typed_path_samples(df, ["k"]).collect()} == {("items[].a", "1"), ("items[].b", "p"), ("n", "5")}


def test_literals_round_trip(spark):
    texts = ['plain', 'a "q" \\ b', "t\tn\nr\r", "\\n is no break", "é😀", "\\\\", "'"]
    df = spark.createDataFrame([(t,) for t in texts], "o string")
    assert [r[0] for r in df.select(X.unescape_literal(X.escape_literal(F.col("o")))).collect()] == texts


def test_records_of_very_many_keys_give_mapped_columns_only(spark):
    """A driver that asks for two columns learns of no others."""
    rows = [({f"k{i}_{j}": "v" for j in range(20)} | {"x": str(i)},) for i in range(50)]
    df = spark.createDataFrame(rows, "fields map<string,string>")
    structure = {"min_typical_age": [{"columns": ["x"], "transform": [{"op": "to_numeric"}]}], "temporal_coverage": [{"year": {"column": "k3_7"}}], "z": []}
    assert C.records_frame(df, C.named_in(structure)).columns == ["k3_7", "x"]
    assert C.records_frame(df, set()).columns == [] and C.records_frame(df, {"x"}).count() == 50
