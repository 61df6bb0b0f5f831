"""Cleaning steps: input and expected output pairs."""

import math

import pytest

from metaloom.functions.dsl import compile_mapping, java_pattern


def run(spark, values, steps, dtype="string", **others):
    names = ["x", *others]
    rows = list(zip(values, *others.values()))
    types = ["x " + dtype] + [f"{n} {t}" for n, t in zip(others, ["string"] * len(others))]
    df = spark.createDataFrame(rows, ", ".join(types))
    cell = compile_mapping(df, {"columns": [names[0]], "transform": steps})
    return None if cell is None else [r[0] for r in df.select(cell.col).collect()]


def op(name, **params):
    return {"op": name, "params": params}


CASES = [
    ("double", [1.0, 3.5, 12345678.25, 1e-05, 1e16, None, math.nan], [op("to_string")], ["1", "3.5", "12345678.25", "1e-05", "10000000000000000", None, None]),
    ("string", ["5.0", "bad.0", " nan ", "none", "", "null", "<NA>", " a "], [op("to_string")], ["5", "bad.0", None, None, None, None, None, "a"]),
    ("boolean", [True, False], [op("to_string")], ["1", "0"]),
    ("string", ["  hello  ", "\tworld\n", "\u00a0x\u2003", None], [op("strip")], ["hello", "world", "x", None]),
    ("string", ["a-b-c", None], [op("split", sep="-", index=1)], ["b", None]),
    ("string", ["a-b-c"], [op("split", sep="-", index=-1)], ["c"]),
    ("string", ["a-b-c"], [op("split", sep="-", index=10)], [""]),
    ("string", ["a-b-c"], [op("split", sep="[", index=0)], [""]),
    ("string", ["a-", "ab"], [op("split", sep="-", index=1)], ["", ""]),
    ("string", ["ab"], [op("split", sep="", index=1)], ["a"]),
    ("string", ["May, June", "April/May"], [op("split", sep="[,/;-]", index=0), op("strip")], ["May", "April"]),
    ("string", ["abc123def", "none here", None], [op("regex_extract", pattern=r"\d+")], ["123", None, None]),
    ("string", ["abc123def"], [op("regex_extract", pattern=r"(\d)(\d)", group=2)], ["2"]),
    ("string", ["abc123def"], [op("regex_extract", pattern=r"\d+", group=99)], [None]),
    ("string", ["abc"], [op("regex_extract", pattern="[")], [None]),
    ("string", ["10", "3.14", "bad", " 7 ", "10d", "1.5f", "1e3", "-.5", ""], [op("to_numeric")], [10.0, 3.14, None, 7.0, None, None, 1000.0, -0.5, None]),
    ("string", ["2023-05-15", "2023-05-07", "invalid"], [op("to_datetime_part", part="day")], ["15", "7", None]),
    ("string", ["2023-05-15"], [op("to_datetime_part", part="year")], ["2023"]),
    ("string", ["2023-05-15"], [op("to_datetime_part", part="hour")], ["2023-05-15"]),
    ("string", ["01/02/2020", "13/02/2020"], [op("to_datetime_part", part="month")], ["1", "2"]),
    ("string", ["01/02/2020", "02/13/2020"], [op("to_datetime_part", part="month", dayfirst=True)], ["2", "2"]),
    ("string", ["hello world"], [op("replace", old="world", new="there")], ["hello there"]),
    ("string", ["abc123def456"], [op("replace", old=r"\d+", new="X", regex=True)], ["abcXdefX"]),
    ("string", ["a.b"], [op("replace", old=r"(\w)\.(\w)", new=r"\2$\g<1>", regex=True)], ["b$a"]),
    ("string", ["ab"], [op("replace", old="", new="-")], ["-a-b-"]),
    ("string", ["1.234,56"], [op("replace", old=".", new=""), op("replace", old=",", new="."), op("to_numeric")], [1234.56]),
    ("string", ["A", "B", "C", None], [op("map", mapping={"A": "Alpha", "B": "Beta"})], ["Alpha", "Beta", "C", None]),
    ("string", ['{"v": "x"}', '[{"v": 1}, {"v": 2}]', "[5]", "bad", "", None], [op("json_extract", key="v")], ["x", "1", None, None, None, None]),
    ("string", ['[{"l": "en", "v": "a"}, {"l": "es", "v": "b"}]'], [op("json_extract", key="v", filter_key="l", filter_val="es")], ["b"]),
    ("string", ["a", "b"], [op("constant", value="fixed")], ["fixed", "fixed"]),
    ("string", [" 1.0 "], [op("to_string"), "no step", op("strip")], ["1"]),
]


@pytest.mark.parametrize("dtype,values,steps,expected", CASES)
def test_step(spark, dtype, values, steps, expected):
    assert run(spark, values, steps, dtype) == expected


def test_points_and_joins(spark):
    assert run(spark, ["s", "s"], [op("format_point", lat_col="lat", lon_col="lon")], lat=["40.4", None], lon=["-3.7", "1"]) == ["POINT(40.4 -3.7)", ""]
    assert run(spark, ["s"], [op("format_point", lat_col="lat", lon_col="nope")], lat=["1"]) == ["s"]
    assert run(spark, ["foo"], [op("join_columns", columns=["x", "b", "nope"])], b=["bar"]) == ["foo, bar"]
    assert run(spark, ["foo"], [op("join_columns", columns=["x", "b"], sep=" - ")], b=["bar"]) == ["foo - bar"]
    assert run(spark, ["foo"], [op("join_columns", columns=["nope"])]) == ["foo"]


@pytest.mark.parametrize("mapping", [
    {"columns": []}, {"columns": ["nope"]}, {"columns": ["x"], "transform": [{"op": "explode_it"}]},
    {"columns": ["x"], "transform": [op("replace", old="[", new="", regex=True)]},
])
def test_unresolved(spark, mapping):
    df = spark.createDataFrame([("a",)], "x string")
    assert compile_mapping(df, mapping) is None


def test_column_key_is_accepted(spark):
    df = spark.createDataFrame([("a",)], "`x.y` string")
    cell = compile_mapping(df, {"column": "x.y", "transform": [op("strip")]})
    assert df.select(cell.col).first()[0] == "a"


def test_pattern_translation():
    assert java_pattern(r"(?P<year>\d{4})\Z") == r"(?<year>\d{4})\z"
    assert java_pattern("[") is None
