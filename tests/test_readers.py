"""Readers on small files and cells."""

import json

import pytest
from pyspark.sql import functions as F

from metaloom.sources import delimited as D, files as FS, grid, json_docs as J, vocabularies as V, xml_docs as X


def save(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode("utf-8"))
    return str(path)


def rows(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=str)


def ordered(records):
    return sorted(records, key=lambda r: sorted(r.items()))


def fields(df):
    return ordered(dict(r["fields"]) for r in df.select("fields").collect())


# ── delimited ────────────────────────────────────────────────────────────────

@pytest.mark.parametrize("mark", [",", ";", "\t", "|"])
def test_csv_delimiters(spark, tmp_path, mark):
    path = save(tmp_path, "a.csv", f"name{mark}age\nAnn{mark}30\nBob{mark}\n")
    assert rows(FS.read_any(spark, path)) == [{"name": "Ann", "age": "30"}, {"name": "Bob", "age": None}]


def test_csv_latin1(spark, tmp_path):
    path = save(tmp_path, "a.csv", "a\u00f1o;x\nMu\u00f1oz;1\n".encode("latin-1"))
    assert rows(D.read_csv(spark, path)) == [{"a\u00f1o": "Mu\u00f1oz", "x": "1"}]


def test_csv_bom_quotes_and_lines(spark, tmp_path):
    path = save(tmp_path, "a.csv", b"\xef\xbb\xbfid,note\n1,\"two\nlines, \"\"quoted\"\"\"\n2,NA\n")
    assert rows(D.read_csv(spark, path)) == [{"id": "1", "note": 'two\nlines, "quoted"'}, {"id": "2", "note": None}]


def test_csv_header_names():
    assert D.header_names("a,,a,b", ",") == ["a", "Unnamed: 1", "a.1", "b"]


def test_sniff_of_empty_file(spark, tmp_path):
    path = save(tmp_path, "a.csv", "")
    found = D.sniff(spark.createDataFrame([(path,)], "path string")).first()
    assert (found["encoding"], found["delimiter"]) == ("UTF-8", ",")


def test_delimiter_prefers_equal_counts(spark):
    df = spark.createDataFrame([("a;b,c\nd;e,f,g\nh;i,j,k,l",), ("x",), ("a,b\n\n  \nc,d",)], "t string")
    got = [r[0] for r in df.select(D.best_delimiter(D.first_lines(F.col("t")))).collect()]
    assert got == [";", ",", ","]


def test_encoding_forgives_a_cut_character(spark):
    data = ("a" * 9_999 + "\u00e9").encode("utf-8")
    df = spark.createDataFrame([(bytearray(data[:10_000]),), (bytearray(b"\xff\xfe"),)], "b binary")
    assert [r[0] for r in df.select(D.encoding_of(F.col("b"))).collect()] == ["UTF-8", "ISO-8859-1"]


def test_read_many(spark, tmp_path):
    save(tmp_path, "a.csv", 'id|v\n1|"x|y"\n2|NA\n')
    save(tmp_path, "b.csv", "k;w\n7;8\n")
    got = fields(D.read_many(spark, FS.list_files(spark, str(tmp_path))))
    assert got == [{"id": "1", "v": "x|y"}, {"id": "2"}, {"k": "7", "w": "8"}]


def test_unknown_format():
    with pytest.raises(ValueError):
        FS.format_of("/x/data.docx")


# ── JSON ─────────────────────────────────────────────────────────────────────

def unwrap(spark, obj, **kw):
    df = spark.createDataFrame([(1, json.dumps(obj))], "doc_id int, text string")
    return fields(J.unwrap(df, **kw))


JSON_FILES = {
    "array": ('[{"a": 1}, {"a": 2}]', [{"a": "1"}, {"a": "2"}]),
    "mixed": ('[{"a": 1}, 5, "t"]', [{"a": "1"}, {"value": "5"}, {"value": "t"}]),
    "lines": ('{"a": 1}\n\n{"a": \n[2]\n{"a": 3}\n', [{"a": "1"}, {"a": "3"}]),
    "wrapped": ('{"meta": {"n": 1}, "data": [{"a": 1}, {"a": {"b": null, "c": [1, "x"]}}]}', [{"a": "1"}, {"a.c": '[1, "x"]'}]),
    "bom": ('\ufeff[{"a": true}]', [{"a": "True"}]),
    "nested": ('[{"o": {"i": {"v": 1.5}}}]', [{"o.i.v": "1.5"}]),
}


@pytest.mark.parametrize("name", list(JSON_FILES))
def test_json_files(spark, tmp_path, name):
    text, expected = JSON_FILES[name]
    assert fields(FS.read_any(spark, save(tmp_path, "a.json", text))) == ordered(expected)


def test_unwrap_keyed(spark):
    assert unwrap(spark, {"i": 1, "m": {"b": {"v": 1, "w": 2}, "a": {"v": 3, "w": 4}}}) == [
        {"_key": "a", "v": "3", "w": "4"}, {"_key": "b", "v": "1", "w": "2"},
    ]


def test_unwrap_columns_and_rows(spark):
    doc = {"short": ["q"], "fields": [{"id": "k"}, {"name": "n"}], "records": [[1, "x"], [2, None, "more"]]}
    assert unwrap(spark, doc) == [{"k": "2", "column_2": "more"}, {"k": "1", "n": "x"}]


def test_unwrap_without_header(spark):
    assert unwrap(spark, {"rows": [[1, 2], [3, 4]], "n": 1}) == [
        {"column_0": "1", "column_1": "2"}, {"column_0": "3", "column_1": "4"},
    ]


def test_containers_that_cannot_hold_records_are_not_opened(spark):
    """Told by the type: scalar lists, flat objects, chains; unlike lists and keyed objects are opened."""
    texts = ['[1,2]', '{"a":1,"b":"x"}', '{"a":{"b":{"c":1}}}', '{"a,b":{"c":1}}', '[]', '3',
             '[{"a":1}]', '[[1]]', '[1,[2]]', '{"a":{"x":1},"b":{"x":2}}', '{"n":{"a":{"x":1},"b":{}}}', '{"l":[{"a":1}],"m":2}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.select(J.may_hold_records(F.parse_json("t")), "i").orderBy("i").collect()]
    assert got == [False] * 6 + [True] * 6


def test_unwrap_first_of_equal_scores_in_written_order(spark):
    assert unwrap(spark, {"z": [{"a": 1}], "b": [{"c": 2}]}) == [{"a": "1"}]


def test_unwrap_geometry_trap(spark):
    ring = [[float(i), 0.5] for i in range(20)]
    doc = {"features": [{"attributes": {"id": 1}, "geometry": {"rings": [ring]}}]}
    assert len(unwrap(spark, doc)) == 20
    assert len(unwrap(spark, doc, skip_numeric=True)) == 1


def test_unwrap_depth(spark):
    doc = {"a": {"b": {"c": {"d": {"e": {"f": {"g": [{"x": 1, "y": 2}]}}}}}}, "l": [{"q": 1}]}
    assert unwrap(spark, doc) == [{"x": "1", "y": "2"}]
    assert unwrap(spark, doc, depth=3) == [{"q": "1"}]


def test_unwrap_single(spark):
    assert unwrap(spark, {"a": {"b": 1}, "c": [], "d": None}) == [{"a.b": "1", "c": "[]"}]


# ── XML ──────────────────────────────────────────────────────────────────────

XML = """<?xml version="1.0"?>
<root xmlns="http://n.org/x" xmlns:q="http://q.org"><head/>
 <item id="007"><name lang="en">Ann</name><tag>a</tag><tag>b</tag><addr><city>X</city></addr><q:z>1.50</q:z></item>
 <item id="8">own<name>Bob</name><tag>c</tag></item>
 <q:item/>
</root>"""


def test_xml(spark, tmp_path):
    path = save(tmp_path, "a.xml", XML)
    assert X.record_tags(spark.createDataFrame([(path,)], "path string")).first()["tag"] == "item"
    assert fields(FS.read_any(spark, path)) == ordered([
        {"id": "007", "name._text": "Ann", "name.lang": "en", "tag": "a", "tag_1": "b", "addr.city": "X", "z": "1.50"},
        {"id": "8", "_text": "own", "name": "Bob", "tag": "c"},
    ])


RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:skos="http://www.w3.org/2004/02/skos/core#">
<rdf:Description rdf:about="http://v/pd#Age"><rdf:type rdf:resource="http://www.w3.org/2004/02/skos/core#Concept"/>
<skos:prefLabel xml:lang="en">Age</skos:prefLabel><skos:prefLabel xml:lang="es">Edad</skos:prefLabel><skos:definition xml:lang="en">How old</skos:definition></rdf:Description>
<rdf:Description rdf:about="http://v/pd#NoLabel"><rdf:type rdf:resource="http://www.w3.org/2004/02/skos/core#Concept"/></rdf:Description>
<rdf:Description rdf:about="http://v/plain"><skos:prefLabel xml:lang="en">Plain</skos:prefLabel></rdf:Description>
</rdf:RDF>"""


def test_skos_file(spark, tmp_path):
    path = save(tmp_path, "v.rdf", RDF)
    got = rows(V.skos_concepts(V.read_descriptions(spark, path)))
    assert got == [{"code": "Age", "uri": "http://v/pd#Age", "pref_label": "Age", "definition": "How old"}]


# ── grids, parquet, listings ─────────────────────────────────────────────────

def test_grid_header_promotion(spark):
    data = [
        ("s", 0, ["", None, None]), ("s", 1, ["name", "", "age"]), ("s", 2, ["Ann", None, " 30 "]),
        ("s", 3, [None, None, None]), ("s", 12, ["Bob", "x", "nan"]), ("t", 0, ["a", "a"]), ("t", 1, ["1", "2"]),
    ]
    df = spark.createDataFrame(data, "sheet string, row_no int, cells array<string>")
    got = {(r["sheet"], r["row_no"]): r["fields"] for r in grid.grid_records(df).collect()}
    assert got == {
        ("s", 2): {"name": "Ann", "age": "30"}, ("s", 12): {"name": "Bob", "col_1": "x"}, ("t", 1): {"a": "2"},
    }


def test_discover(spark, tmp_path):
    for name in ("one/a.csv", "one/.hidden.csv", "two/deep/b.JSON", "two/c.txt", "three/p.parquet/part-0.parquet"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = {(r["dataset_id"], r["file"], r["format"]) for r in FS.discover(FS.list_files(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert got == {("one", "one/a.csv", "csv"), ("two", "two/deep/b.JSON", "json"), ("three", "three/p.parquet", "parquet")}
