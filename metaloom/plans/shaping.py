"""Record shaping, sampling, ranking and set queries."""

from pyspark.sql import Window, functions as F

from ..operators import sampling as M, sets, shape
from ..session import spread
from .registry import query

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("b1_flatten_json", """
    select event_id, event_type as "meta.type", props::json->>'k' as "meta.deep.k",
           '["x", {"k": ' || (props::json->>'k') || '}]' as tags from events""")
def b1(t):
    doc = F.try_parse_json(F.concat(
        F.lit('{"meta":{"type":"'), "event_type", F.lit('","none":null,"deep":'), "props",
        F.lit('},"tags":["x",'), "props", F.lit("]}"),
    ))
    m = spread(t.events).select("event_id", shape.flatten_object(doc).alias("m"))
    return m.select("event_id", *[F.col("m")[k].alias(k) for k in ("meta.type", "meta.deep.k", "tags")])


@query("b1_flatten_struct", """
    select s_suppkey::varchar as s_suppkey, n_name as "place.nation.name", r_name as "place.region" from supplier
    join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def b1_struct(t):
    df = (
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.struct(F.struct(F.col("n_name").alias("name")).alias("nation"), F.col("r_name").alias("region")).alias("place"))
    )
    return shape.flatten_records(df)


@query("b2_list_text", """
    select page_id, '["' || page_id::varchar || '", "a: b,c"]' as cell from pages""")
def b2(t):
    df = t.pages.select("page_id", F.array(F.col("page_id").cast("string"), F.lit("a: b,c")).alias("cell"))
    return shape.flatten_records(df).withColumn("page_id", F.col("page_id").cast("bigint"))


@query("b3_scalar_text", """
    select o_orderkey::varchar as o_orderkey, o_custkey::varchar as o_custkey, o_orderstatus,
           o_totalprice::varchar as o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, o_orderpriority
    from orders""")
def b3(t):
    return shape.flatten_records(t.orders)


@query("b5_drop_empty_cells", """
    select o_orderkey as dataset_id, unnest(['o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate']) as field,
           unnest([o_custkey::varchar, o_orderstatus, o_totalprice::varchar, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')]) as value
    from orders
    union all select o_orderkey, 'o_orderpriority', o_orderpriority from orders where o_orderpriority <> '5-LOW'""")
def b5(t):
    df = t.orders.withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return shape.long_fields(df, "o_orderkey")


@query("b6_path_samples", """
    select event_id, unnest(['type', 'rows[].k', 'first']) as path,
           unnest([event_type, props::json->>'k', 'a']) as sample from events""")
def b6(t):
    doc = F.try_parse_json(F.concat(
        F.lit('{"type":" '), "event_type", F.lit(' ","blank":"  ","none":[],"rows":['), "props",
        F.lit(',{"z":1}],"first":["a","b"]}'),
    ))
    return spread(t.events).select("event_id", F.inline(shape.path_samples(doc)))


INVENTORY_SQL = """
    with l as (
      select {by} c_custkey as ord, unnest(['c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) as path,
             unnest([c_name, c_nationkey::varchar, c_acctbal::varchar, c_mktsegment]) as sample from customer),
    f as (select {cols} path, sample, min(ord) as first from l group by all),
    r as (select *, row_number() over (partition by {cols} path order by first) as rn from f)
    select {cols} path, string_agg(sample, '|' order by rn) as samples from r where rn <= 3 group by all"""


@query("b7_inventory", INVENTORY_SQL.format(by="", cols=""))
def b7(t):
    rows = shape.typed_path_samples(t.customer, ["c_custkey"])
    return shape.inventory(rows, [], "c_custkey").select("path", F.concat_ws("|", "samples").alias("samples"))


@query("b7_inventory_many", INVENTORY_SQL.format(by="c_mktsegment as dataset,", cols="dataset,"))
def b7_many(t):
    df = t.customer.withColumn("dataset", F.col("c_mktsegment"))
    rows = shape.typed_path_samples(df, ["c_custkey", "dataset"])
    return shape.inventory(rows, ["dataset"], "c_custkey").select(
        "dataset", "path", F.concat_ws("|", "samples").alias("samples")
    )


@query("b7_inventory_counts", """
    with s as (select * from customer order by md5(concat_ws('|', c_custkey, '0')), c_custkey limit 20),
    c as (select unnest([c_custkey::varchar, c_name, c_nationkey::varchar, c_acctbal::varchar, c_mktsegment]) as v,
                 unnest(['k', 'n', 'a', 'b', 'm']) as path from s)
    select count(distinct path) as columns, (select count(*) from s) as records from c where trim(v) <> ''""")
def b7_counts(t):
    sample = M.uniform_sample(t.customer, ["c_custkey"])
    rows = shape.typed_path_samples(sample, []).withColumn("o", F.lit(0))
    return shape.inventory_counts(sample, shape.inventory(rows, [], "o"))


@query("b8_nest_dotted_keys", """
    select o_orderkey, '{"status":"' || o_orderstatus || '","who":{"cust":"' || o_custkey::varchar || '","prio":"' || o_orderpriority || '"}}' as doc
    from orders""")
def b8(t):
    m = F.create_map(
        F.lit("status"), "o_orderstatus", F.lit("who.cust"), F.col("o_custkey").cast("string"),
        F.lit("who.prio"), "o_orderpriority",
    )
    return t.orders.select("o_orderkey", shape.nested_json(m).alias("doc"))


@query("b8_split_dotted", """
    select o_orderkey, 'hdab' as field, 'email' as subfield, o_orderstatus as value from orders
    union all select o_orderkey, 'title', null, o_orderpriority from orders""")
def b8_split(t):
    rows = t.orders.select(
        "o_orderkey", F.explode(F.create_map(F.lit("hdab.email"), "o_orderstatus", F.lit("title"), "o_orderpriority")).alias("key", "value")
    )
    return shape.split_dotted(rows)


@query("i1_sample20", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem
    order by md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, 'seed')),
             l_orderkey, l_linenumber, l_partkey, l_suppkey limit 20""")
def i1(t):
    keys = LINE_KEYS[:4]
    return M.uniform_sample(t.lineitem.select(*keys), keys, seed="seed")


@query("i1_sample20_per_dataset", """
    select doc_id, source from (
      select doc_id, source, row_number() over (partition by source order by md5(concat_ws('|', doc_id, '0')), doc_id) as n
      from documents) where n <= 20""")
def i1_many(t):
    return M.uniform_sample(t.documents.select("doc_id", "source"), ["doc_id"], ["source"])


@query("i2_char_budget", """
    with s as (select doc_id, source, text, row_number() over (partition by source order by md5(concat_ws('|', doc_id, '0')), doc_id) as n
               from documents),
    b as (select doc_id, source, sum(length(text)) over (partition by source order by doc_id rows unbounded preceding) as used
          from s where n <= 20)
    select doc_id, source from b where used <= 30000""")
def i2(t):
    sample = M.uniform_sample(t.documents.select("doc_id", "source", "text"), ["doc_id"], ["source"])
    return M.char_budget(sample, ["source"], ["doc_id"], F.col("text")).select("doc_id", "source")


@query("i3_first_lines", """
    select * from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n from lineitem)
    where n <= 2""")
def i3(t):
    order = LINE_KEYS[1:]
    first = M.first_rows(t.lineitem.select(*LINE_KEYS), ["l_orderkey"], order, 2)
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    return first.withColumn("n", F.row_number().over(w).cast("bigint"))


@query("i4_best_row", """
    select p_brand, p_partkey, p_retailprice from (
      select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as n from part) where n = 1""")
def i4(t):
    return M.best_row(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], F.col("p_retailprice"), ["p_partkey"])


@query("i7_first_distinct", """
    with f as (select event_type, user_id, min(event_id) as first from events group by 1, 2)
    select event_type, user_id, rank from (
      select *, row_number() over (partition by event_type order by first) as rank from f) where rank <= 3""")
def i7(t):
    return M.first_distinct(t.events, ["event_type"], "user_id", "event_id", 3).withColumn("rank", F.col("rank").cast("bigint"))


@query("i8_ordered_dedupe", """
    select l_orderkey, l_returnflag, min(l_linenumber * 10000000 + l_partkey) as first from lineitem group by 1, 2""")
def i8(t):
    at = F.col("l_linenumber") * 10000000 + F.col("l_partkey")
    return sets.first_seen(t.lineitem, ["l_orderkey", "l_returnflag"], at)


@query("i8_array_dedupe", """
    select p_partkey, case when p_type = p_brand then p_type else p_type || '|' || p_brand end as uris from part""")
def i8_array(t):
    return t.part.select("p_partkey", F.concat_ws("|", sets.distinct_items(F.array("p_type", "p_brand", "p_type", "p_brand"))).alias("uris"))


@query("i9_first_non_empty", """
    select user_id, event_type, arg_min(v, event_id) as value from (
      select *, case when value < 20 then '' else props end as v from events) where v <> '' group by 1, 2
    union all
    select user_id, event_type, null from events group by 1, 2 having max(value) < 20""")
def i9(t):
    df = t.events.withColumn("v", F.when(F.col("value") < 20, "").otherwise(F.col("props")))
    return M.first_non_empty(df, ["user_id", "event_type"], "v", F.col("event_id"))


@query("i10_duplicate_suffix", """
    select event_id, user_id, case when k = 1 then event_type else event_type || '_' || (k - 1)::varchar end as name
    from (select *, row_number() over (partition by user_id, event_type order by event_id) as k from events)""")
def i10(t):
    df = t.events.select("event_id", "user_id", "event_type")
    return M.suffix_duplicates(df, ["user_id"], "event_type", "event_id").select("event_id", "user_id", "name")


@query("i11_latest_output", """
    select user_id, arg_max(props, event_id) as value from events group by 1""")
def i11(t):
    return M.latest_value(t.events, ["user_id"], F.col("props"), F.col("event_id"))


@query("i12_sorted_codes", "select distinct p_name, p_brand from part order by p_name, p_brand")
def i12(t):
    return sets.sorted_codes(t.part, ["p_name", "p_brand"])


@query("i13_first_entries", "select p_partkey as ord, p_name as label from part order by p_partkey limit 5")
def i13(t):
    from ..operators.lookup import first_entries

    return first_entries(t.part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("label")))


@query("j1_key_union", """
    select c_nationkey as k from customer union select s_nationkey from supplier""")
def j1(t):
    return sets.key_union([t.customer.select("c_nationkey"), t.supplier.select("s_nationkey")], "k")


@query("j2_expected_minus_present", """
    select c_custkey as k from customer except select o_custkey from orders where o_orderpriority = '1-URGENT'""")
def j2(t):
    keys = t.customer.select(F.col("c_custkey").alias("k"))
    return sets.missing_keys(keys, t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), "k")


@query("j3_distinct_uris", """
    select distinct split_part(split_part(url, '?', 1), '#', 1) as uri from pages""")
def j3(t):
    return sets.page_uris(t.pages, "url")


@query("j4_ordered_union", """
    select l_shipmode, min(o) as first from (
      select l_returnflag as l_shipmode, 1 as o from lineitem union all select l_linestatus, 2 from lineitem) group by 1""")
def j4(t):
    return sets.ordered_union([t.lineitem.select("l_returnflag"), t.lineitem.select("l_linestatus")], "l_shipmode")


@query("j6_field_difference", """
    select o_orderkey, case when o_orderstatus in ('a', 'b') then 'a|b' else 'a|b|' || o_orderstatus end as rest from orders""")
def j6(t):
    have = F.array(F.lit("a"), F.lit("language"), F.lit("b"), "o_orderstatus")
    return t.orders.select("o_orderkey", F.concat_ws("|", sets.without_items(have, ["language"])).alias("rest"))
