"""Cleaning steps, predicates and scalars."""

from pyspark.sql import functions as F, types as T

from ..functions import scalars as S, text as X
from ..functions.dsl import compile_mapping
from .profiling import steps
from ..session import spread
from .registry import query


def cleaned(df, column, *ops):
    cell = compile_mapping(df, {"columns": [column], "transform": steps(*ops)})
    return None if cell is None else cell.col


@query("d0_mapping_chain", """
    select o_orderkey, trim(split_part(o_orderpriority, '-', 2)) as label,
           null::varchar as unresolved from orders""")
def d0(t):
    df = t.orders
    chain = compile_mapping(df, {"columns": ["o_orderpriority"], "transform": [
        "not a step", {"op": "split", "params": {"sep": "-", "index": 1}}, {"op": "strip"}]})
    broken = compile_mapping(df, {"columns": ["o_orderpriority"], "transform": steps("strip", "no_such_step")})
    missing = compile_mapping(df, {"columns": ["nowhere"], "transform": steps("strip")})
    assert broken is None and missing is None
    return df.select("o_orderkey", chain.col.alias("label"), F.lit(None).cast("string").alias("unresolved"))


@query("d1_to_string", """
    select l_orderkey, l_linenumber, l_partkey, cast(l_quantity::bigint as varchar) as quantity,
           case when l_discount = 0 then '0' else l_discount::varchar end as discount,
           l_partkey::varchar as part
    from lineitem""")
def d1(t):
    df = t.lineitem
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        cleaned(df, "l_quantity", "to_string").alias("quantity"),
        cleaned(df, "l_discount", "to_string").alias("discount"),
        cleaned(df, "l_partkey", "to_string").alias("part"),
    )


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8203 - 3) || chr(8232) || chr(12288)"


@query("d2_strip", f"""
    select doc_id, md5(trim(text, {WS})) as body, length(trim(text, {WS})) as chars from documents""")
def d2(t):
    body = cleaned(t.documents, "text", "strip")
    return t.documents.select("doc_id", F.md5(body).alias("body"), F.length(body).cast("bigint").alias("chars"))


@query("d3_split", """
    select o_orderkey, split_part(o_orderpriority, '-', 1) as first_part,
           string_split(o_orderpriority, '-')[-1] as last_part, '' as no_part, '' as bad_pattern
    from orders""")
def d3(t):
    df = t.orders
    return df.select(
        "o_orderkey",
        cleaned(df, "o_orderpriority", ("split", {"sep": "-", "index": 0})).alias("first_part"),
        cleaned(df, "o_orderpriority", ("split", {"sep": "-", "index": -1})).alias("last_part"),
        cleaned(df, "o_orderpriority", ("split", {"sep": "-", "index": 10})).alias("no_part"),
        cleaned(df, "o_orderpriority", ("split", {"sep": "[", "index": 0})).alias("bad_pattern"),
    )


@query("d4_regex_extract", r"""
    select p_partkey, regexp_extract(p_brand, '\d+') as digits, regexp_extract(p_name, '^(\w+) (\w+)$', 2) as noun,
           case when regexp_matches(p_name, 'bolt') then 'bolt' end as bolt, null::varchar as bad_group
    from part""")
def d4(t):
    df = t.part
    return df.select(
        "p_partkey",
        cleaned(df, "p_brand", ("regex_extract", {"pattern": r"\d+"})).alias("digits"),
        cleaned(df, "p_name", ("regex_extract", {"pattern": r"^(?P<adj>\w+) (?P<noun>\w+)\Z", "group": 2})).alias("noun"),
        cleaned(df, "p_name", ("regex_extract", {"pattern": "bolt"})).alias("bolt"),
        cleaned(df, "p_name", ("regex_extract", {"pattern": "bolt", "group": 9})).alias("bad_group"),
    )


@query("d5_to_numeric", """
    select event_id, try_cast(props::json->>'k' as double) as k, null::double as kind from events""")
def d5(t):
    df = t.events
    return df.select(
        "event_id",
        cleaned(df, "props", ("json_extract", {"key": "k"}), "to_numeric").alias("k"),
        cleaned(df, "event_type", "to_numeric").alias("kind"),
    )


@query("d6_datetime_part", """
    select o_orderkey, year(o_orderdate)::varchar as y, month(o_orderdate)::varchar as m, day(o_orderdate)::varchar as d,
           case when day(o_orderdate) <= 12 then day(o_orderdate) else month(o_orderdate) end::varchar as month_first,
           month(o_orderdate)::varchar as day_first
    from orders""")
def d6(t):
    df = spread(t.orders).withColumn("slashed", F.date_format("o_orderdate", "dd/MM/yyyy"))
    return df.select(
        "o_orderkey",
        cleaned(df, "o_orderdate", ("to_datetime_part", {"part": "year"})).alias("y"),
        cleaned(df, "o_orderdate", ("to_datetime_part", {"part": "month"})).alias("m"),
        cleaned(df, "o_orderdate", "to_string", ("to_datetime_part", {"part": "day"})).alias("d"),
        cleaned(df, "slashed", ("to_datetime_part", {"part": "month"})).alias("month_first"),
        cleaned(df, "slashed", ("to_datetime_part", {"part": "month", "dayfirst": True})).alias("day_first"),
    )


@query("d7_replace", r"""
    select p_partkey, replace(p_name, ' ', '_') as snake, regexp_replace(p_brand, '[0-9]+', 'X', 'g') as brand,
           regexp_replace(p_name, '(\w+) (\w+)', '\2 \1', 'g') as swapped
    from part""")
def d7(t):
    df = t.part
    return df.select(
        "p_partkey",
        cleaned(df, "p_name", ("replace", {"old": " ", "new": "_"})).alias("snake"),
        cleaned(df, "p_brand", ("replace", {"old": "[0-9]+", "new": "X", "regex": True})).alias("brand"),
        cleaned(df, "p_name", ("replace", {"old": r"(\w+) (\w+)", "new": r"\2 \1", "regex": True})).alias("swapped"),
    )


@query("d8_map", """
    select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'done' else o_orderstatus end as status
    from orders""")
def d8(t):
    return t.orders.select(
        "o_orderkey",
        cleaned(t.orders, "o_orderstatus", ("map", {"mapping": {"O": "open", "F": "done"}})).alias("status"),
    )


@query("d9_json_extract", """
    select event_id, props::json->>'k' as from_object, props::json->>'k' as from_list,
           event_type as from_filter, null::varchar as from_text
    from events""")
def d9(t):
    df = t.events.withColumns({
        "listed": F.concat(F.lit("[ "), F.col("props"), F.lit(', {"k": -1}]')),
        "tagged": F.concat(F.lit('[7, {"t": "a", "v": "no"}, {"t": 2, "v": "'), F.col("event_type"), F.lit('"}]')),
    })
    return df.select(
        "event_id",
        cleaned(df, "props", ("json_extract", {"key": "k"})).alias("from_object"),
        cleaned(df, "listed", ("json_extract", {"key": "k"})).alias("from_list"),
        cleaned(df, "tagged", ("json_extract", {"key": "v", "filter_key": "t", "filter_val": "2"})).alias("from_filter"),
        cleaned(df, "event_type", ("json_extract", {"key": "k"})).alias("from_text"),
    )


@query("d10_format_point", """
    select s_suppkey, 'POINT(' || s_acctbal::varchar || ' ' || s_nationkey::varchar || '.0)' as point,
           '' as no_point, s_name as absent
    from supplier""")
def d10(t):
    df = t.supplier
    return df.select(
        "s_suppkey",
        cleaned(df, "s_name", ("format_point", {"lat_col": "s_acctbal", "lon_col": "s_nationkey"})).alias("point"),
        cleaned(df, "s_name", ("format_point", {"lat_col": "s_name", "lon_col": "s_acctbal"})).alias("no_point"),
        cleaned(df, "s_name", ("format_point", {"lat_col": "nowhere", "lon_col": "s_acctbal"})).alias("absent"),
    )


@query("d11_join_columns", """
    select c_custkey, c_name || ', ' || c_nationkey::varchar as joined, c_name || ' - ' || c_custkey::varchar as dashed,
           c_name as untouched from customer""")
def d11(t):
    df = t.customer
    return df.select(
        "c_custkey",
        cleaned(df, "c_name", ("join_columns", {"columns": ["c_name", "nope", "c_nationkey"]})).alias("joined"),
        cleaned(df, "c_name", ("join_columns", {"columns": ["c_name", "c_custkey"], "sep": " - "})).alias("dashed"),
        cleaned(df, "c_name", ("join_columns", {"columns": ["nope"]})).alias("untouched"),
    )


@query("d12_constant", "select c_custkey, 'World' as area from customer")
def d12(t):
    return t.customer.select("c_custkey", cleaned(t.customer, "c_name", ("constant", {"value": "World"})).alias("area"))


@query("c1_has_content", f"""
    select doc_id, length(trim(text, {WS})) > 0 as has_text, lang is not null and trim(lang) <> '' as has_lang,
           text <> '' as filled_text, len(string_split(text, chr(10))) > 0 as has_lines
    from documents""")
def c1(t):
    string = T.StringType()
    return t.documents.select(
        "doc_id",
        X.has_content(F.col("text"), string).alias("has_text"),
        X.has_content(F.col("lang"), string).alias("has_lang"),
        X.is_filled(F.col("text"), string).alias("filled_text"),
        X.has_content(F.split("text", "\n"), T.ArrayType(string)).alias("has_lines"),
    )


@query("c6_non_public", """
    with a as (select o_orderkey, case o_orderstatus
        when 'O' then 'http://x.org/access-right/NON_PUBLIC' when 'F' then 'http://x.org/non_public/PUBLIC'
        else 'http://x.org/access-right/RESTRICTED' end as ar from orders)
    select o_orderkey, contains(upper(ar), 'NON_PUBLIC') as loose, split_part(ar, '/', -1) = 'NON_PUBLIC' as strict from a""")
def c6(t):
    ar = (
        F.when(F.col("o_orderstatus") == "O", "http://x.org/access-right/NON_PUBLIC")
        .when(F.col("o_orderstatus") == "F", "http://x.org/non_public/PUBLIC")
        .otherwise("http://x.org/access-right/RESTRICTED")
    )
    return t.orders.select(
        "o_orderkey", S.is_non_public(ar).alias("loose"), S.ends_non_public(ar).alias("strict")
    )


@query("c7_country_uri", """
    select s_suppkey, case when s_nationkey < 10
        then 'http://publications.europa.eu/resource/authority/country/AB' || chr(65 + s_nationkey::int) end as uri
    from supplier""")
def c7(t):
    code = F.when(F.col("s_nationkey") < 10, F.concat(F.lit("ab"), F.char((F.col("s_nationkey") + 97).cast("int")))).otherwise(
        F.col("n_name")
    )
    df = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return df.select("s_suppkey", S.country_uri(code).alias("uri"))


@query("f1_language_uri", """
    select doc_id, 'http://publications.europa.eu/resource/authority/language/' ||
           case lang when 'en' then 'ENG' when 'de' then 'DEU' when 'fr' then 'FRA' else 'SPA' end as language,
           lang as short_code
    from documents""")
def f1(t):
    lang = F.col("lang")
    iso3 = F.when(lang == "en", " eng").when(lang == "de", "deu").when(lang == "fr", "fra ").otherwise("spa")
    return t.documents.select("doc_id", S.language_uri(iso3).alias("language"), S.language_uri(lang).alias("short_code"))


@query("f2_language_list", """
    select doc_id, lang || '|http://publications.europa.eu/resource/authority/language/ENG' as languages from documents""")
def f2(t):
    raw = F.array(F.col("lang"), F.lit("  "), F.lit("eng"))
    return t.documents.select("doc_id", F.concat_ws("|", S.language_list(raw)).alias("languages"))


@query("f3_array_coercion", """
    select p_partkey, replace(p_name, ' ', '|') as keyword, p_name as purpose, 0 as empty_size from part""")
def f3(t):
    raw = F.concat(F.lit(" ;"), F.replace(F.col("p_name"), F.lit(" "), F.lit(" ;; ")), F.lit("; "))
    return t.part.select(
        "p_partkey",
        F.concat_ws("|", S.text_to_array("keyword", raw)).alias("keyword"),
        F.concat_ws("|", S.text_to_array("purpose", F.concat(F.col("p_name"), F.lit(" ")))).alias("purpose"),
        F.size(S.text_to_array("spatial", F.lit("  "))).alias("empty_size"),
    )


@query("f4_next_version", """
    select o_orderkey, printf('%.1f', (o_orderkey % 50)::double + 1) as numeric_version, o_orderpriority as text_version,
           '1.0' as first_version from orders""")
def f4(t):
    return t.orders.select(
        "o_orderkey",
        S.next_version((F.col("o_orderkey") % 50).cast("string")).alias("numeric_version"),
        S.next_version(F.col("o_orderpriority")).alias("text_version"),
        S.next_version(F.lit(" ")).alias("first_version"),
    )


@query("f5_version_history", """
    select o_orderkey, printf('%.1f', least(a, b)) || '|' || printf('%.1f', greatest(a, b)) || '|' ||
           printf('%.1f', greatest(a, b) + 1) as history, o_orderpriority || '|1.0' as kept, '1.0' as fresh
    from (select o_orderkey, o_orderpriority, (o_orderkey % 7)::double as a, (o_custkey % 11)::double as b from orders)""")
def f5(t):
    a = F.format_string("%d", F.col("o_orderkey") % 7)
    b = F.format_string("%d.0", F.col("o_custkey") % 11)
    return t.orders.select(
        "o_orderkey",
        F.concat_ws("|", S.next_version_history(F.array(a, b))).alias("history"),
        F.concat_ws("|", S.next_version_history(F.array(F.col("o_orderpriority"), F.lit("1.0")))).alias("kept"),
        F.concat_ws("|", S.next_version_history(F.array().cast("array<string>"))).alias("fresh"),
    )


@query("f6_mime_type", """
    select part.p_partkey, case p_size % 4 when 0 then 'text/csv' when 1 then 'application/json'
        when 2 then null else 'application/vnd.apache.parquet' end as mimetype,
        case p_size % 4 when 0 then 'csv' when 1 then 'json' when 2 then null else 'parquet' end as format
    from part""")
def f6(t):
    ext = F.element_at(F.array(F.lit(".CSV"), F.lit(".tar.json"), F.lit(""), F.lit(".parquet")), (F.col("p_size") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/lake.v2/"), F.col("p_type"), F.lit("/"), F.col("p_brand"), ext)
    return t.part.select("p_partkey", S.mime_type(path).alias("mimetype"), S.file_extension(path).alias("format"))


@query("f9_content_hash", "select doc_id, sha256(text) as hash from documents")
def f9(t):
    return t.documents.select("doc_id", S.content_hash(F.col("text")).alias("hash"))


@query("f10_last_segment", """
    select page_id, regexp_extract(url, '([^/#]*)$', 1) as segment from pages""")
def f10(t):
    return t.pages.select("page_id", S.last_segment(F.col("url")).alias("segment"))


@query("f11_expand_uri", """
    select s_suppkey, case when s_nationkey % 2 = 0 then 'http://base.org/n/' || n_name else 'http://other.org/' || n_name end as uri,
           'http://base.org/n/' || n_name || '|http://z.org/1' as uris
    from supplier join nation on s_nationkey = n_nationkey""")
def f11(t):
    df = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.col("n_name")
    one = F.when(F.col("s_nationkey") % 2 == 0, name).otherwise(F.concat(F.lit("http://other.org/"), name))
    base = "http://base.org/n/"
    many = F.array(name, F.lit(""), F.lit(None).cast("string"), F.lit("http://z.org/1"))
    return df.select(
        "s_suppkey", S.expand_uri(one, base).alias("uri"), F.concat_ws("|", S.expand_uri_list(many, base)).alias("uris")
    )


@query("f12_entry_text", """
    select p_partkey, p_name || ' ' || p_brand || ' ' || p_type as search_text from part""")
def f12(t):
    values = [F.array(F.col("p_name"), F.lit(" ")), F.array(F.concat(F.lit(" "), "p_brand"), F.lit(None).cast("string")), F.array("p_type")]
    return t.part.select("p_partkey", S.entry_text(values).alias("search_text"))


@query("f13_query_text", """
    select p_partkey, p_type || ' ' || p_name || ' ' || replace(p_name, ' ', ' ') as query_text from part""")
def f13(t):
    return t.part.select(
        "p_partkey",
        S.query_text(
            F.array("p_type"), F.concat(F.lit(" "), "p_name"), F.lit(None).cast("string"), F.split("p_name", " ")
        ).alias("query_text"),
    )


@query("f15_strip_marks", f"""
    select conv_id, turn, md5(trim(trim(text, {WS}), '`')) as body from conversations""")
def f15(t):
    fenced = F.concat(F.lit(" ``"), F.col("text"), F.lit("`\n"))
    return t.conversations.select("conv_id", "turn", F.md5(X.strip_marks(fenced)).alias("body"))


@query("f16_flags", """
    select p_partkey, greatest(1, p_size - 10)::int as top_n, 1 as bad_top_n, p_size % 2 = 0 as multiple from part""")
def f16(t):
    size = F.col("p_size")
    return t.part.select(
        "p_partkey",
        S.top_n(F.concat(F.lit(" "), (size - 10).cast("string"))).alias("top_n"),
        S.top_n(F.col("p_brand")).alias("bad_top_n"),
        S.flag(F.when(size % 2 == 0, " TRUE ").when(size % 3 == 0, "yes")).alias("multiple"),
    )


@query("f18_contacts", """
    select p_partkey, 2 as contacts, string_split(p_name, ' ')[1] as first_name, p_brand as first_email,
           p_type as first_role, string_split(p_name, ' ')[2] as second_name, null::varchar as second_email
    from part""")
def f18(t):
    words = F.split("p_name", " ")
    text = F.concat(words[0], F.lit(" | "), "p_brand", F.lit("|"), "p_type", F.lit(" ,, "), words[1])
    c = S.contacts(text)
    return t.part.select(
        "p_partkey", F.size(c).alias("contacts"), c[0]["name"].alias("first_name"), c[0]["email"].alias("first_email"),
        c[0]["role"].alias("first_role"), c[1]["name"].alias("second_name"), c[1]["email"].alias("second_email"),
    )


@query("f20_truncate", "select doc_id, md5(substring(text, 1, 200)) as head, least(n_chars, 2000)::bigint as chars from documents")
def f20(t):
    return t.documents.select(
        "doc_id",
        F.md5(X.truncate(F.col("text"), 200)).alias("head"),
        F.length(X.truncate(F.col("text"), 2000)).cast("bigint").alias("chars"),
    )
