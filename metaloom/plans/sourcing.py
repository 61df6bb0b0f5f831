"""Readers and sinks, on files and cells that Spark derives from the tables."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import nearest, profile as P, rules as R, shape, triples as X
from ..operators.answers import registry_rows, vocabulary_summary
from ..operators.assemble import finalize
from ..session import shared_dir, spread
from ..sources import delimited as D, files as FS, grid, json_docs as J, sinks, vocabularies as V, xml_docs as XM
from .cleaning import WS
from .profiling import LINEITEM, steps
from .records import customer_record, order_fields
from .registry import query


# ── files and delimited text ─────────────────────────────────────────────────

@query("a1_format_dispatch", """
    select p_partkey, case p_size % 4 when 0 then 'csv' when 1 then 'grid' when 2 then null else 'parquet' end as format from part""")
def a1(t):
    ext = F.element_at(F.array(F.lit("CSV"), F.lit("xlsx"), F.lit("doc"), F.lit("parquet")), (F.col("p_size") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", FS.format_column(F.concat(F.lit("/lake/"), "p_type", F.lit("/a.b."), ext)).alias("format"))


@query("a2_encoding_sniff", """
    select doc_id, case when doc_id % 2 = 1 then 'ISO-8859-1' else 'UTF-8' end as encoding from documents""")
def a2(t):
    body = F.encode("text", "UTF-8")
    data = F.when(F.col("doc_id") % 2 == 1, F.concat(F.unhex(F.lit("E9")), body)).otherwise(body)
    return t.documents.select("doc_id", D.encoding_of(F.substring(data, 1, FS.HEAD_BYTES)).alias("encoding"))


@query("a3_delimiter_sniff", rf"""
    with l as (select doc_id, list_filter(list_transform(list_slice(string_split_regex(text, '\r\n|\r|\n'), 1, 5), lambda v: trim(v, {WS})), lambda v: v <> '') as lines from documents),
    c as (select doc_id, lines, [list_transform(lines, lambda v: length(v) - length(replace(v, d, ''))) for d in [';', ',', chr(9), '|']] as cs from l),
    s as (select doc_id, [case when len(lines) = 0 then 0 when list_min(x) > 0 and list_min(x) = list_max(x) then x[1] * 100 else list_sum(x) end for x in cs] as sc from c)
    select doc_id, sc[1]::bigint as semicolon, sc[2]::bigint as comma, sc[3]::bigint as tab, sc[4]::bigint as bar,
           case when list_max(sc) = 0 then ',' when sc[1] = list_max(sc) then ';' when sc[2] = list_max(sc) then ','
                when sc[3] = list_max(sc) then chr(9) else '|' end as delimiter from s""")
def a3(t):
    lines = spread(t.documents).select("doc_id", D.first_lines(F.col("text")).alias("lines"))
    names = ["semicolon", "comma", "tab", "bar"]
    return lines.select(
        "doc_id",
        *[D.delimiter_score(F.col("lines"), d).cast("bigint").alias(n) for n, d in zip(names, D.DELIMITERS)],
        D.best_delimiter(F.col("lines")).alias("delimiter"),
    )


@query("a4_read_csv", """
    select c_custkey::varchar as id, case when c_custkey % 5 = 0 then null else c_name end as name,
           case when c_custkey % 7 = 0 then 'say "hi"; ' || c_mktsegment else c_mktsegment end as note,
           c_acctbal::varchar as balance from customer""")
def a4(t):
    """Customers written with ``;`` and quoting, sniffed and read back as text."""
    k = F.col("c_custkey")
    path = shared_dir(t.spark, "csv")
    t.customer.select(
        k.alias("id"), F.when(k % 5 == 0, "N/A").otherwise(F.col("c_name")).alias("name"),
        F.when(k % 7 == 0, F.concat(F.lit('say "hi"; '), "c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("note"),
        F.col("c_acctbal").alias("balance"),
    ).write.options(header=True, sep=";", escape='"').csv(path)
    return D.read_csv(t.spark, path)


@query("a4_read_many_csv", """
    select 'c' || c_custkey::varchar as id, 'name' as field, c_name as value from customer where c_custkey % 3 <> 0
    union all select 'c' || c_custkey::varchar, 'a,b', c_mktsegment || ',x' from customer
    union all select 's' || s_suppkey::varchar, 'label', s_name from supplier""")
def a4_many(t):
    """Two delimited datasets with different headers and delimiters in one scan."""
    root = shared_dir(t.spark, "lake")
    k = F.col("c_custkey")
    t.customer.select(
        F.concat(F.lit("c"), k).alias("id"), F.when(k % 3 != 0, F.col("c_name")).otherwise("NULL").alias("name"),
        F.concat("c_mktsegment", F.lit(",x")).alias("a,b"),
    ).write.options(header=True, sep="|").csv(f"{root}/one")
    t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("label")).write.options(
        header=True, sep="\t"
    ).csv(f"{root}/two")
    rows = D.read_many(t.spark, FS.list_files(t.spark, root))
    return rows.select(F.col("fields")["id"].alias("id"), F.explode_outer("fields").alias("field", "value")).where("field <> 'id'")


@query("a13_profile_of_csv", """
    select count(*) as number_of_records, count(distinct l_partkey) as number_of_unique_individuals,
           min(l_quantity) as min_typical_age, max(l_quantity) as max_typical_age,
           strftime(min(l_shipdate), '%Y-%m-%d') as coverage_start, strftime(max(l_shipdate), '%Y-%m-%d') as coverage_end
    from lineitem""")
def a13(t):
    """The profile of the line items after a round trip through text."""
    path = shared_dir(t.spark, "lines")
    t.lineitem.select("l_partkey", "l_quantity", F.date_format("l_shipdate", "dd/MM/yyyy").alias("l_shipdate")).write.options(
        header=True, sep="|"
    ).csv(path)
    parts = {
        p: {"column": "l_shipdate", "transform": steps(("to_datetime_part", {"part": p, "dayfirst": True}))}
        for p in ("year", "month", "day")
    }
    return P.profile(D.read_csv(t.spark, path), {**LINEITEM, "temporal_coverage": [parts]})


@query("a12_parquet_fields", """
    select 'l_orderkey' as field, count(*) as n from lineitem union all select 'l_partkey', count(*) from lineitem
    union all select 'l_suppkey', count(*) from lineitem union all select 'l_quantity', count(*) from lineitem
    union all select 'l_extendedprice', count(*) from lineitem union all select 'l_discount', count(*) from lineitem
    union all select 'l_tax', count(*) from lineitem union all select 'l_returnflag', count(*) from lineitem
    union all select 'l_linestatus', count(*) from lineitem union all select 'l_shipdate', count(*) from lineitem""")
def a12(t):
    rows = FS.read_any(t.spark, t.path("lineitem"))
    return shape.long_fields(rows, "l_linenumber").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query("a23_discover", """
    select 'one' as dataset_id, 'csv' as format, true as has_rows union all select 'two', 'parquet', true""")
def a23(t):
    """A lake of a csv folder, a parquet directory and files that do not count."""
    root = shared_dir(t.spark, "found")
    t.customer.write.option("header", True).csv(f"{root}/one/raw")
    t.supplier.write.parquet(f"{root}/two/data.parquet")
    t.supplier.select("s_name").write.text(f"{root}/three/.hidden.csv")
    found = FS.discover(FS.list_files(t.spark, root), root)
    return found.groupBy("dataset_id", "format").agg((F.sum("bytes") > 0).alias("has_rows"))


@query("f8_file_facts", """
    select 'text/csv' as mimetype, 'csv' as format, sum(length(s_name) + 1)::bigint as size,
           sha256(string_agg(s_name || chr(10), '' order by s_suppkey)) as hash, 'SHA-256' as hash_algorithm
    from supplier group by s_nationkey""")
def f8(t):
    """One file of supplier names per nation, then the facts of each file."""
    path = shared_dir(t.spark, "facts")
    rows = t.supplier.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    rows.select("s_nationkey", "s_name").write.partitionBy("s_nationkey").csv(path)
    return FS.file_facts(t.spark, path).drop("path")


# ── JSON ─────────────────────────────────────────────────────────────────────

@query("a5_json_array", """
    select event_id as doc_id, 'k' as field, props::json->>'k' as value from events
    union all select event_id, 'value', event_type from events
    union all select event_id, 'a.b', '["x", 1]' from events""")
def a5(t):
    text = F.concat(F.lit("﻿ ["), "props", F.lit(',"'), "event_type", F.lit('",{"a":{"b":["x",1],"c":null}}]'))
    rows = J.array_records(spread(t.events).select(F.col("event_id").alias("doc_id"), text.alias("text")))
    return rows.select("doc_id", F.explode_outer("fields").alias("field", "value")).where("field is not null")


@query("a6_ndjson_file", """
    select event_id::varchar as id, props::json->>'k' as k from events where event_id % 10 <> 5""")
def a6(t):
    path = shared_dir(t.spark, "ndjson")
    good = F.concat(F.lit('{"id":'), "event_id", F.lit(',"p":'), "props", F.lit("}"))
    line = F.when(F.col("event_id") % 10 != 5, good).when(F.col("event_id") % 20 == 5, "[1]").otherwise('{"broken": ')
    t.events.select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(path)
    rows = J.read_json(t.spark, path)
    return rows.select(F.col("fields")["id"].alias("id"), F.col("fields")["p.k"].alias("k"))


def wrapped(t):
    """One JSON document per customer in four layouts."""
    k, name = F.col("c_custkey"), F.col("c_name")
    objects = F.concat(
        F.lit('{"zeta":[{"u":1}],"meta":{"n":"x"},"result":{"rows":[{"id":'), k, F.lit(',"name":"'), name,
        F.lit('"},{"id":0,"addr":{"city":"C"}},{}]}}'),
    )
    keyed = F.concat(F.lit('{"info":"i","by":{"b2":{"v":'), k, F.lit(',"w":1},"a1":{"v":2,"w":"'), "c_mktsegment", F.lit('"}}}'))
    lists = F.concat(
        F.lit('{"fields":[{"id":"key"},{"name":"label"}],"other":["p"],"records":[['), k, F.lit(',"'), name, F.lit('"],[7,null,"extra"]]}'),
    )
    single = F.concat(F.lit('{"id":'), k, F.lit(',"in":{"name":"'), name, F.lit('"},"tags":["t"]}'))
    text = F.when(k % 4 == 0, objects).when(k % 4 == 1, keyed).when(k % 4 == 2, lists).otherwise(single)
    return spread(t.customer).select(k.alias("doc_id"), text.alias("text"))


@query("a7_candidates", """
    with c as (select c_custkey as doc_id, c_custkey % 4 as m from customer)
    select doc_id, '0' as place, 'objects' as kind, 1.0::double as score from c where m = 0
    union all select doc_id, '2.0', 'objects', 4.0 from c where m = 0
    union all select doc_id, '1', 'keyed', 4.0 from c where m = 1
    union all select doc_id, '0', 'objects', 2.0 from c where m = 2
    union all select doc_id, '2', 'lists', 5.0 from c where m = 2""")
def a7_candidates(t):
    found = J.candidates(wrapped(t))
    place = F.array_join(F.transform("path", lambda p: p["pos"].cast("string")), ".")
    return found.select("doc_id", place.alias("place"), "kind", "score")


@query("a7_unwrap", """
    with c as (select c_custkey as doc_id, c_custkey % 4 as m, * from customer)
    select doc_id, c_custkey::varchar as a, c_name as b, null as c from c where m = 0
    union all select doc_id, '0', null, 'C' from c where m = 0
    union all select doc_id, null, null, null from c where m = 0
    union all select doc_id, 'b2', c_custkey::varchar, '1' from c where m = 1
    union all select doc_id, 'a1', '2', c_mktsegment from c where m = 1
    union all select doc_id, c_custkey::varchar, c_name, null from c where m = 2
    union all select doc_id, '7', null, 'extra' from c where m = 2
    union all select doc_id, c_custkey::varchar, c_name, '["t"]' from c where m = 3""")
def a7_unwrap(t):
    f = F.col("fields")
    rows = J.unwrap(wrapped(t))

    def one(*names):
        return F.coalesce(*[F.try_element_at(f, F.lit(n)) for n in names])

    return rows.select(
        "doc_id", one("_key", "key", "id").alias("a"), one("v", "label", "name", "in.name").alias("b"),
        one("w", "column_2", "addr.city", "tags").alias("c"),
    )


@query("a6_document_layouts", """
    select event_id as doc_id, count(*) as records from events, (values (1), (2)) v(x) where event_id % 3 <> 2 group by 1
    union all select event_id, 1 from events where event_id % 3 = 2""")
def a6_layouts(t):
    m = F.col("event_id") % 3
    text = (
        F.when(m == 0, F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]")))
        .when(m == 1, F.concat("props", F.lit("\n"), "props", F.lit("\nnot json\n")))
        .otherwise(F.concat(F.lit('{"rows":['), "props", F.lit("]}")))
    )
    rows = J.document_records(spread(t.events).select(F.col("event_id").alias("doc_id"), text.alias("text")))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("records"))


@query("a14_override_json", """
    select p_partkey as dataset_id, 'title' as field, '"' || p_name || '"' as value from part where p_size % 2 = 0
    union all select p_partkey, 'size', p_size::varchar from part where p_size % 2 = 0""")
def a14(t):
    good = F.concat(F.lit('{"title":"'), "p_name", F.lit('","size":'), "p_size", F.lit("}"))
    docs = t.part.select(F.col("p_partkey").alias("dataset_id"), F.when(F.col("p_size") % 2 == 0, good).otherwise("{oops").alias("text"))
    return J.override_fields(docs, "dataset_id", "text")


@query("a22_import_payload", """
    select p_partkey as dataset_id, 'title' as field, '"' || p_name || '"' as value from part""")
def a22(t):
    record = F.concat(F.lit('{"title":"'), "p_name", F.lit('","empty":"","none":null,"list":[]}'))
    m = F.col("p_size") % 3
    text = F.when(m == 0, F.concat(F.lit('{"metadata":'), record, F.lit(',"x":1}'))).when(
        m == 1, F.concat(F.lit('{"metadata":3,"data":'), record, F.lit("}"))
    ).otherwise(record)
    return J.payload_fields(t.part.select(F.col("p_partkey").alias("dataset_id"), text.alias("text")), "dataset_id", "text")


# ── XML, grids ───────────────────────────────────────────────────────────────

@query("a9_tag_argmax", r"""
    with x as (select page_id, unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9:_-]*)', 1)) as tag,
                      generate_subscripts(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9:_-]*)', 1), 1) as pos from pages),
    g as (select page_id, tag, count(*) as n, min(pos) as first from x group by 1, 2),
    r as (select *, row_number() over (partition by page_id order by n desc, first) as k from g)
    select page_id, tag, n from r where k = 1""")
def a9(t):
    from ..operators.sampling import best_row

    counts = XM.tag_counts(t.pages, "page_id", "html")
    return best_row(counts, ["page_id"], F.col("n"), ["first"]).select("page_id", "tag", "n")


@query("a10_xml_file", """
    select c_custkey::varchar as id, c_name as name, c_mktsegment as "place.kind", n_name as "place.nation",
           'a' as tag, c_nationkey::varchar as tag_1 from customer join nation on n_nationkey = c_nationkey""")
def a10(t):
    path = shared_dir(t.spark, "xml")
    t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"),
        F.struct(F.col("c_mktsegment").alias("_kind"), F.col("n_name").alias("nation")).alias("place"),
        F.array(F.lit("a"), F.col("c_nationkey").cast("string")).alias("tag"),
    ).write.format("xml").options(rootTag="all", rowTag="entry").save(path)
    f = F.col("fields")
    rows = XM.read_xml(t.spark, path)
    return rows.select(*[f[n].alias(n) for n in ("id", "name", "place.kind", "place.nation", "tag", "tag_1")])


@query("a11_grid_records", """
    select p_brand as sheet, p_partkey + 2 as row_no, p_name as name, p_type as kind, p_size::varchar as size,
           case when p_partkey >= 8 then 'extra' end as col_3 from part where p_size % 5 <> 0
    union all select p_brand, p_partkey + 2, p_name, null, null, null from part where p_size % 5 = 0""")
def a11(t):
    k = F.col("p_partkey")
    null = F.lit(None).cast("string")
    full = F.array(F.concat(F.lit(" "), "p_name"), F.col("p_type"), F.col("p_size").cast("string"), F.when(k >= 8, "extra"))
    short = F.array(F.col("p_name"), F.lit("NaN"), F.lit("  "))
    data = t.part.select(
        F.col("p_brand").alias("sheet"), (k + 2).alias("row_no"), F.when(F.col("p_size") % 5 == 0, short).otherwise(full).alias("cells")
    )
    sheets = t.part.select(F.col("p_brand").alias("sheet")).distinct()
    tops = sheets.select("sheet", F.inline(F.array(
        F.struct(F.lit(0).cast("bigint").alias("row_no"), F.array(F.lit("Title"), null).alias("cells")),
        F.struct(F.lit(1).cast("bigint").alias("row_no"), F.array(F.lit(" name "), F.lit("kind"), F.lit("size"), F.lit(" ")).alias("cells")),
    )))
    rows = grid.grid_records(tops.unionByName(data))
    return rows.select("sheet", "row_no", *[F.try_element_at("fields", F.lit(n)).alias(n) for n in ("name", "kind", "size", "col_3")])


# ── vocabularies and schemas ─────────────────────────────────────────────────

def part_docs(t):
    """Vocabulary documents of ten parts each."""
    entry = F.concat(
        F.lit('"'), "p_partkey", F.lit('":{"uri":"http://n/'), F.col("p_partkey"), F.lit('","prefLabel":["'), "p_name",
        F.lit('","'), F.col("p_brand"), F.lit('"],"definition":"def '), "p_type", F.lit('"}'),
    )
    return t.part.groupBy(F.floor(F.col("p_partkey") / 10).alias("feature")).agg(
        F.concat(F.lit("{"), F.concat_ws(",", F.collect_list(entry)), F.lit("}")).alias("text")
    )


@query("a16_vocabulary_rows", """
    select p_partkey // 10 as feature, p_partkey::varchar as code, 'http://n/' || p_partkey::varchar as uri,
           p_name || '|' || p_brand as pref_label, 'def ' || p_type as definition, '' as description from part""")
def a16(t):
    rows = V.vocabulary_rows(part_docs(t))
    return rows.select("feature", "code", "uri", *[F.concat_ws("|", c).alias(c) for c in ("pref_label", "definition", "description")])


@query("a17_gazetteer_rows", """
    select case when p_partkey // 10 % 3 = 0 then 'continents' else 'l' || (p_partkey // 10)::varchar end as level,
           p_partkey::varchar as name, 'u' || p_name as uri from part""")
def a17(t):
    pair = F.concat(F.lit('"'), "p_partkey", F.lit('":"u'), F.col("p_name"), F.lit('"'))
    chunk = F.floor(F.col("p_partkey") / 10)
    docs = t.part.groupBy(chunk.alias("chunk")).agg(F.concat_ws(",", F.collect_list(pair)).alias("names"))
    level = F.when(F.col("chunk") % 3 == 0, "contients").otherwise(F.concat(F.lit("l"), "chunk"))
    return V.gazetteer_rows(docs.select(F.concat(F.lit('{"'), level, F.lit('":{'), "names", F.lit("}}")).alias("text")))


@query("a15_registry_file", """
    select p_name as name, 'http://v/' || p_partkey::varchar as base_url, 'f' || p_partkey::varchar as feature,
           case when p_partkey % 2 = 0 then 'similarity' else 'codes' end as route,
           greatest(1, p_size)::int as top_n, p_partkey % 3 = 0 as multiple from part where p_partkey % 5 <> 1""")
def a15(t):
    """The parts as a ``;``-separated registry whose names and cells carry blanks."""
    path = shared_dir(t.spark, "registry")
    k = F.col("p_partkey")
    t.part.select(
        F.concat(F.lit(" "), "p_name").alias("Name"), F.concat(F.lit(" http://v/"), k, F.lit("/ ")).alias(" URL"),
        F.when(k % 5 == 1, " ").otherwise(F.concat(F.lit(" f"), k)).alias(" Feature"),
        F.when(k % 2 == 0, "Rag").otherwise(" LLM").alias(" Metadata-Processed-By"), F.col("p_size").alias("top-n"),
        F.when(k % 3 == 0, " true").otherwise("false").alias(" multiple_output"),
    ).write.options(header=True, sep=";", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return registry_rows(V.read_registry(t.spark, path))


def descriptions(t):
    k = F.col("p_partkey")
    label = "struct<tag:string,lang:string,text:string>"

    def tag(name, lang, text):
        return F.struct(F.lit(name).alias("tag"), F.lit(lang).alias("lang"), text.alias("text")).cast(label)

    labels = F.array(
        tag("prefLabel", "es", F.lit("no")), tag("prefLabel", "en", F.concat(F.lit(" "), "p_name")),
        tag("definition", "en", F.when(k % 2 == 0, F.col("p_name")).otherwise(F.col("p_type"))), tag("description", "en", F.col("p_type")),
    )
    about = F.concat(F.lit("http://v.org/"), F.when(k % 3 == 0, "pd/").otherwise("pd#"), k)
    types = F.when(k % 5 == 0, F.array(F.lit("http://other"))).otherwise(F.array(F.lit("x"), F.lit(V.CONCEPT)))
    return t.part.select(about.alias("about"), types.alias("types"), labels.alias("labels"))


@query("a18_skos_concepts", """
    select p_partkey::varchar as code, 'http://v.org/pd#' || p_partkey::varchar as uri, p_name as pref_label,
           case when p_partkey % 2 = 0 then p_name else p_type end as definition
    from part where p_partkey % 3 <> 0 and p_partkey % 5 <> 0""")
def a18(t):
    return V.skos_concepts(descriptions(t))


@query("a19_concept_pages", """
    select 'http://v.org/pd/' || p_partkey::varchar as about, p_name as "prefLabel",
           case when p_partkey % 2 = 0 then '' else p_type end as definition, case when p_partkey % 2 = 0 then p_type else '' end as description
    from part where p_partkey % 3 = 0""")
def a19(t):
    rows = descriptions(t)
    uris = V.concept_uris(rows, "http://v.org/pd/")
    fields = V.english_fields(rows).join(uris, "about", "left_semi")
    return fields.select("about", *[F.concat_ws("|", c).alias(c) for c in V.LABEL_TAGS])


def schema_rows(t):
    """Customers as schema fields whose attributes cover every rule of the derivation."""
    k = F.col("c_custkey")
    subs = F.array(
        F.struct(F.lit("mail").alias("field_name"), F.lit("email.html").alias("display_snippet"), F.lit(True).alias("required")),
        F.struct(F.lit("telephone").alias("field_name"), F.lit(None).cast("string").alias("display_snippet"), F.lit(None).cast("boolean").alias("required")),
    )
    return t.customer.select(
        F.col("c_name").alias("field_name"), F.concat(F.lit("L "), "c_name").alias("label"),
        F.when(k % 3 == 0, True).alias("required"),
        F.when(k % 6 == 1, "dataset_slug").when(k % 6 == 2, "tag_string_autocomplete").when(k % 6 == 3, "title").alias("preset"),
        F.when(k % 6 == 4, "markdown.html").alias("form_snippet"),
        F.when(k % 10 == 5, "email.html").when(k % 10 == 6, "link.html").alias("display_snippet"),
        F.when(k % 7 == 0, subs).alias("repeating_subfields"), F.when(k % 14 == 0, True).alias("repeating_once"),
        F.when(k % 4 == 0, F.array(F.struct(F.col("c_mktsegment").alias("value"), F.lit("x").alias("label")))).alias("choices"),
    )


@query("k1_derive_rules", """
    select c_name as field, c_custkey % 3 = 0 as required,
           case when c_custkey % 7 = 0 then 'list_object' when c_custkey % 10 = 5 then 'email' when c_custkey % 10 = 6 then 'url'
                when c_custkey % 6 = 4 then 'markdown' when c_custkey % 6 = 1 then 'slug' when c_custkey % 6 = 2 then 'list' else 'text' end as type,
           case when c_custkey % 4 = 0 then c_mktsegment else '' end as choices,
           case when c_custkey % 14 = 0 then 1 end as max_items,
           case when c_custkey % 7 = 0 then 'mail:email:true|telephone:telephone:false' else '' end as subfields
    from customer
    union all select 'access_url', false, 'url', '', null, ''
    union all select 'alias', false, 'slug', '', null, ''""")
def k1(t):
    rules = R.derive_rules(schema_rows(t), {"Customer#000000001": "alias"})
    parts = F.transform("subfields", lambda s: F.concat_ws(":", s["name"], s["type"], s["required"].cast("string")))
    return rules.select("field", "required", "type", F.concat_ws("|", "choices").alias("choices"), "max_items", F.concat_ws("|", parts).alias("subfields"))


@query("a21_schema_listing", """
    select c_name as name, 'L ' || c_name as label, case c_custkey % 6 when 1 then 'dataset_slug' when 2 then 'tag_string_autocomplete' when 3 then 'title' end as preset,
           null::varchar as help_text, null::varchar as validators, c_custkey % 3 = 0 as required from customer""")
def a21(t):
    return R.field_listing(schema_rows(t))


@query("a22b_blocks", """
    select p_partkey // 10 as name, string_agg(p_name, '|' order by p_partkey) as fields from part group by 1""")
def a22b(t):
    blocks = t.part.select(
        F.floor(F.col("p_partkey") / 10).alias("name"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("field")
    )
    return R.block_listing(blocks).select("name", F.concat_ws("|", "fields").alias("fields"))


@query("c5_choices", """
    select p_partkey, 'http://a/NON_PUBLIC=cerrado|http://a/PUBLIC=' || p_name as choices from part""")
def c5(t):
    def choice(value, es, en):
        return F.struct(F.lit(value).alias("value"), F.create_map(F.lit("es"), es, F.lit("en"), en).alias("label"))

    raw = F.array(
        choice("http://a/NON_PUBLIC", F.lit("cerrado"), F.lit("closed")), choice("http://a/SECRET", F.lit("s"), F.lit("s")),
        choice("http://a/PUBLIC", F.col("p_name"), F.lit("open")),
    )
    kept = R.access_choices(R.choices_in(raw, "es"))
    return t.part.select("p_partkey", F.concat_ws("|", F.transform(kept, lambda c: F.concat_ws("=", c["value"], c["label"]))).alias("choices"))


@query("c11_subfields", """
    select p_partkey, 'email:' || p_name || '|special_opening_hours_x:Horario especial – ' || p_type || '|opening_hours_x:Horario habitual – ' || p_type as subfields from part""")
def c11(t):
    def sub(name, label):
        return F.struct(F.lit(name).alias("field_name"), label.alias("label"), F.lit(None).cast("boolean").alias("required"))

    raw = F.array(sub("email", F.col("p_name")), sub("special_opening_hours_x", F.col("p_type")), sub("opening_hours_x", F.col("p_type")))
    return t.part.select("p_partkey", F.concat_ws("|", F.transform(R.subfield_listing(raw), lambda s: F.concat_ws(":", s["field_name"], s["label"]))).alias("subfields"))


@query("f14_vocabulary_summary", """
    select p_partkey, '{"label":"' || p_name || '","definition":"' || p_type || '"}' as summary from part""")
def f14(t):
    entry = F.create_map(F.lit("uri"), "p_brand", F.lit("label"), "p_name", F.lit("definition"), "p_type")
    return t.part.select("p_partkey", vocabulary_summary(entry).alias("summary"))


@query("f19_display_segment", r"""
    select p_partkey, regexp_replace(p_type || 'Of' || replace(p_name, ' ', 'X'), '([a-z])([A-Z])', '\1 \2', 'g') as display from part""")
def f19(t):
    uri = F.concat(F.lit("http://x/y#"), "p_type", F.lit("Of"), F.replace(F.col("p_name"), F.lit(" "), F.lit("X")))
    return t.part.select("p_partkey", S.spaced_camel(S.last_segment(uri)).alias("display"))


# ── sinks ────────────────────────────────────────────────────────────────────

@query("r1_record_json", """
    select o_orderkey as dataset_id, '{"notes":null,"size":' || o_custkey::varchar || ',"title":"' || o_orderpriority || '"}' as value from orders""")
def r1(t):
    title = shape.json_string(F.col("o_orderpriority"))
    values = order_fields(t, ("title", title), ("size", F.col("o_custkey").cast("string")), ("notes", F.lit(None).cast("string")))
    return sinks.record_json(values)


@query("r2_report_lines", """
    select o_orderkey as dataset_id, 'title_es' as field, '  Title es: ' || o_orderpriority as line from orders
    union all select o_orderkey, 'theme', '  Theme: a; ' || o_orderstatus from orders
    union all select o_orderkey, 'none', '  None: none' from orders
    union all select o_orderkey, 'share', '  Share: 2.50' from orders
    union all select o_orderkey, 'legal_basis', '  Legal basis:' || chr(10) || '    Source: s' from orders""")
def r2(t):
    values = order_fields(
        t, ("title_es", shape.json_string(F.col("o_orderpriority"))), ("theme", F.to_json(F.array(F.lit("a"), F.col("o_orderstatus")))),
        ("none", F.lit("[]")), ("share", F.lit("2.5")), ("legal_basis", F.lit('{"source":"s"}')),
    )
    return sinks.report_lines(values)


@query("r3_vector_table", """
    select p_brand as feature, count(*) as entries, 384 as dimensions from part group by 1""")
def r3(t):
    path = shared_dir(t.spark, "vectors")
    entries = t.part.select(
        F.col("p_brand").alias("feature"), F.col("p_partkey").cast("string").alias("code"), F.lit("u").alias("uri"),
        F.concat_ws(" ", "p_name", "p_type").alias("text"),
    )
    sinks.write_vector_table(nearest.vector_table(entries).repartition("feature"), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("feature").agg(F.count(F.lit(1)).alias("entries"), F.max(F.size("vector")).alias("dimensions"))


@query("r4_vocabulary_file", """
    select p_partkey // 10 as feature, p_partkey::varchar as code from part""")
def r4(t):
    path = shared_dir(t.spark, "vocab")
    sinks.write_vocabulary(V.vocabulary_rows(part_docs(t)), path)
    return t.spark.read.schema("feature bigint, code string").json(path)


@query("r5_usage_append", """
    select cast(ts as date) as day, count(*) as calls, sum(event_id)::bigint as tokens from events group by 1""")
def r5(t):
    path = shared_dir(t.spark, "usage")
    calls = t.events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("total_tokens")
    )
    sinks.append_usage(calls.where("total_tokens % 2 = 0").repartition("ts"), path)
    sinks.append_usage(calls.where("total_tokens % 2 = 1").repartition("ts"), path)
    return t.spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("tokens"))


@query("r5_finalize_rows", """
    select o_orderkey::varchar as session_id, '/finalize' as endpoint, '{"title":"' || o_orderstatus || '"}' as extra_json,
           strftime(o_orderdate, '%Y-%m-%d') as day from orders""")
def r5_finalize(t):
    records = sinks.record_json(order_fields(t, ("title", shape.json_string(F.col("o_orderstatus")))))
    dated = records.join(t.orders.select(F.col("o_orderkey").alias("dataset_id"), "o_orderdate"), "dataset_id")
    rows = sinks.finalize_rows(dated, F.col("o_orderdate"))
    return rows.select("session_id", "endpoint", "extra_json", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("r6_triple_file", """
    select 'http://c/' || c_custkey::varchar as s, 'http://purl.org/dc/terms/title' as p, c_name as o, 'literal' as o_kind, 'es' as lang from customer
    union all select 'http://c/' || c_custkey::varchar, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://www.w3.org/ns/dcat#Dataset', 'uri', null from customer
    union all select 'http://c/' || c_custkey::varchar, 'http://purl.org/dc/terms/identifier', 'http://c/' || c_custkey::varchar, 'uri', null from customer""")
def r6(t):
    path = shared_dir(t.spark, "triples")
    df = t.customer.select("c_custkey", F.concat(F.lit("http://c/"), "c_custkey").alias("identifier"), F.col("c_name").alias("title"))
    sinks.write_triples(X.record_triples(df, "c_custkey"), path)
    return X.parse_ntriples(t.spark.read.text(path)).select("s", "p", "o", "o_kind", "lang")


@query("r7_errors_summary", """
    select user_id as number, arg_max(case when event_type = 'error' then '["' || event_id::varchar || '"]' when event_type = 'view' then '["e1","e2"]' else '[]' end, event_id) as errors
    from events group by 1""")
def r7(t):
    errors = F.when(F.col("event_type") == "error", F.concat(F.lit('"'), "event_id", F.lit('"'))).when(
        F.col("event_type") == "view", '["e1","e2"]'
    ).otherwise('""')
    outputs = t.events.select(
        F.format_string("dataset_%04d", F.col("user_id")).alias("folder"), F.col("event_id").alias("modified"), errors.alias("errors")
    )
    return sinks.errors_summary(outputs)


@query("r8_regression_report", """
    select c_custkey as dataset_id, 'title' as field, 'empty' as verdict from customer where c_custkey % 3 = 0
    union all select c_custkey, 'tags', 'wrong type' from customer where c_custkey % 10 = 0""")
def r8(t):
    path = shared_dir(t.spark, "report")
    expected = t.spark.createDataFrame([(1, "title", '"T"'), (2, "tags", '["a"]')], "ord int, field string, value string")
    sinks.write_json_rows(R.output_regressions(customer_record(t), expected, ["title"]), path)
    return t.spark.read.schema("dataset_id bigint, field string, verdict string").json(path)


@query("r9_final_record", """
    select o_orderkey as dataset_id, '{"applicable_legislation":["law"],"distribution":[{"access_url":"http://a/' || o_custkey::varchar ||
           '","applicable_legislation":["law"]}],"title":"t"}' as value from orders""")
def r9(t):
    url = F.concat(F.lit('"http://a/'), "o_custkey", F.lit('"'))
    return sinks.record_json(finalize(order_fields(t, ("title", F.lit('"t"')), ("access_url", url), ("applicable_legislation", F.lit('["law"]')))))
