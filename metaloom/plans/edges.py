"""Awkward inputs: dirty files, clashing names, long tables, deep documents, written sinks."""

from pyspark.sql import functions as F

from ..functions.dsl import compile_mapping
from ..operators import answers as N, assemble as A, nearest, pivots, profile as P, shape, triples as X
from ..operators.containment import contained, repeated
from ..operators.lake import merged_profile, profile_lake, refresh_partials
from ..session import shared_dir, spread
from ..sources import delimited as D, files as FS, json_docs as J, sinks, xml_docs as XM
from .matching import centroids, vectors, CENTROIDS
from .profiling import LINEITEM, steps
from .records import order_fields
from .registry import query


# ── readers ──────────────────────────────────────────────────────────────────

@query("a4_read_folder", """
    select c_custkey::varchar as id, c_name as name, case when c_custkey % 2 = 0 then c_mktsegment end as segment from customer""")
def a4_folder(t):
    """A folder of two files: other delimiter, other column order, one column less."""
    path = shared_dir(t.spark, "folder")
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    rows.where("id % 2 = 0").coalesce(1).write.options(header=True, sep=",").csv(path)
    rows.where("id % 2 = 1").select("name", "id").coalesce(1).write.mode("append").options(header=True, sep=";").csv(path)
    return D.read_csv(t.spark, path).select("id", "name", "segment")


@query("a4_tsv_index", """
    select (s_suppkey - 1)::varchar as "Unnamed: 0", s_name as name, s_acctbal::varchar as balance from supplier""")
def a4_tsv(t):
    """A table exported with its index: the first header cell is empty."""
    path = shared_dir(t.spark, "tsv")
    lines = t.supplier.select(F.concat_ws("\t", F.col("s_suppkey") - 1, "s_name", "s_acctbal").alias("value"), "s_suppkey")
    head = t.spark.createDataFrame([("\tname\tbalance", 0)], "value string, s_suppkey bigint")
    head.unionByName(lines).coalesce(1).sortWithinPartitions("s_suppkey").select("value").write.text(path)
    return D.read_csv(t.spark, path)


@query("a4_ragged", """
    select s_suppkey::varchar as id, s_name as name, case when s_suppkey % 3 = 0 then 'more' end as "Unnamed: 2",
           case when s_suppkey % 6 = 0 then 'still' end as "Unnamed: 3" from supplier""")
def a4_ragged(t):
    """Rows with more cells than the header keep them."""
    path = shared_dir(t.spark, "ragged")
    k = F.col("s_suppkey")
    line = F.concat_ws(",", k, "s_name", F.when(k % 3 == 0, "more"), F.when(k % 6 == 0, "still"))
    head = t.spark.createDataFrame([("id,name", 0)], "value string, o bigint")
    head.unionByName(t.supplier.select(line.alias("value"), k.alias("o"))).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return D.read_csv(t.spark, path)


@query("a4_many_spanning", """
    select s_suppkey::varchar as id, 'x' || chr(10) || s_name as note from supplier where s_suppkey % 2 = 0
    union all select s_suppkey::varchar, s_name from supplier where s_suppkey % 2 = 1
    union all select 'id', 'note' from supplier where s_suppkey = 1""")
def a4_many_spanning(t):
    """Of two files one has cells with line breaks, the other a record that equals its header."""
    root = shared_dir(t.spark, "spanning")
    k = F.col("s_suppkey")
    rows = t.supplier.select(k.cast("string").alias("id"), F.when(k % 2 == 0, F.concat(F.lit("x\n"), "s_name")).otherwise(F.col("s_name")).alias("note"), k)
    rows.where("s_suppkey % 2 = 0").drop("s_suppkey").coalesce(1).write.options(header=True, escape='"').csv(f"{root}/a")
    twin = t.supplier.where("s_suppkey = 1").select(F.lit("id").alias("id"), F.lit("note").alias("note"))
    rows.where("s_suppkey % 2 = 1").drop("s_suppkey").unionByName(twin).coalesce(1).write.option("header", True).csv(f"{root}/b")
    found = D.read_many(t.spark, FS.list_files(t.spark, root))
    return found.select(F.col("fields")["id"].alias("id"), F.col("fields")["note"].alias("note"))


def lines_file(t, rows, order, value):
    path = shared_dir(t.spark, "json")
    rows.select(order.alias("o"), value.alias("value")).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return path


@query("a5_truncated", """
    select s_suppkey as position, s_name as name, null::varchar as error from supplier
    union all select count(*), null, 'broken item: Expecting value' from supplier""")
def a5_truncated(t):
    """An array that was cut after a comma: the items before it and an error row."""
    k = F.col("s_suppkey")
    value = F.concat(F.when(k == 0, "[").otherwise(""), F.lit('{"name":"'), "s_name", F.lit('"},'))
    whole = lines_file(t, t.supplier, k, value)
    cut = shared_dir(t.spark, "cut")
    t.spark.read.text(whole, wholetext=True).select(F.concat(F.rtrim(F.col("value"), F.lit("\n")), F.lit(" x")).alias("value")).write.text(cut)
    rows = J.read_json(t.spark, cut)
    return rows.select("position", F.col("fields")["name"].alias("name"), "error")


@query("a6_repeated_key", "select event_id::varchar as id, event_type as kind from events")
def a6_repeated(t):
    """Of a repeated key the last value counts."""
    line = F.concat(F.lit('{"id":1,"kind":"old","id":'), "event_id", F.lit(',"kind":"'), "event_type", F.lit('"}'))
    path = shared_dir(t.spark, "repeated")
    t.events.select(line.alias("value")).write.text(path)
    rows = J.read_json(t.spark, path)
    return rows.select(F.col("fields")["id"].alias("id"), F.col("fields")["kind"].alias("kind"))


@query("a6_mixed_folder", """
    select s_suppkey::varchar as id, s_name as name from supplier where s_suppkey % 3 < 2
    union all select s_suppkey::varchar, s_name from supplier where s_suppkey % 3 = 2""")
def a6_mixed(t):
    """A folder with an array file, a line file and a wrapped file."""
    root = shared_dir(t.spark, "mixed")
    k = F.col("s_suppkey")
    item = F.concat(F.lit('{"id":'), k, F.lit(',"name":"'), "s_name", F.lit('"}'))
    t.supplier.where(k % 3 == 0).select(item.alias("value")).coalesce(1).write.text(f"{root}/l")
    for n, (open_, close) in ((1, ("[", "]")), (2, ('{"meta":{"a":1},"rows":[', "]}"))):
        joined = F.concat(F.lit(open_), F.concat_ws(",", F.collect_list(item)), F.lit(close))
        t.supplier.where(k % 3 == n).agg(joined.alias("value")).write.text(f"{root}/{n}")
    for n in ("l", "1", "2"):  # one folder holds all three
        t.spark.read.text(f"{root}/{n}", wholetext=True).write.mode("append").text(f"{root}/all")
    rows = J.read_json(t.spark, f"{root}/all")
    return rows.select(F.col("fields")["id"].alias("id"), F.col("fields")["name"].alias("name"))


@query("a7_deep", """
    select c_custkey as doc_id, c_custkey::varchar as id, c_name as leaf from customer union all select c_custkey, '0', 'x' from customer""")
def a7_deep(t):
    """A record set twelve levels down whose records are nested forty levels deep."""
    down = "".join(f'"k{i}":{{' for i in range(12))
    deep = "".join(f'{{"d":' for _ in range(40))
    one = F.concat(F.lit('{"id":'), "c_custkey", F.lit(',"n":' + deep + '"'), "c_name", F.lit('"' + "}" * 41))
    two = F.lit('{"id":0,"n":' + deep + '"x"' + "}" * 41)
    text = F.concat(F.lit("{" + down + '"rows":['), one, F.lit(","), two, F.lit("]" + "}" * 13))
    rows = J.unwrap(spread(t.customer).select(F.col("c_custkey").alias("doc_id"), text.alias("text")))
    leaf = "n" + ".d" * 40
    return rows.select("doc_id", F.col("fields")["id"].alias("id"), F.col("fields")[leaf].alias("leaf"))


@query("a7_repeated_header", """
    select c_custkey as doc_id, c_name as a, '2' as b from customer union all select c_custkey, 'y', '4' from customer""")
def a7_repeated_header(t):
    """A list of lists under a header that names two columns alike: the last one counts."""
    text = F.concat(F.lit('{"head":["a","b","a"],"rows":[["x",2,"'), "c_name", F.lit('"],[1,4,"y"]]}'))
    rows = J.unwrap(spread(t.customer).select(F.col("c_custkey").alias("doc_id"), text.alias("text")))
    return rows.select("doc_id", F.col("fields")["a"].alias("a"), F.col("fields")["b"].alias("b"))


@query("b1_path_clash", """
    select event_id as doc_id, event_type as "a.b", '{"z": 1, "c": 2}' as l from events where event_id % 2 = 0
    union all select event_id, 'first', '{"z": 1, "c": 2}' from events where event_id % 2 = 1""")
def b1_clash(t):
    """A dotted key and a nested one with the same path: the one written last counts;
    objects inside lists keep the order of their keys."""
    nested, dotted = F.concat(F.lit('"a":{"b":"'), "event_type", F.lit('"}')), F.lit('"a.b":"first"')
    even = F.col("event_id") % 2 == 0
    first, last = F.when(even, dotted).otherwise(nested), F.when(even, nested).otherwise(dotted)
    text = F.concat(F.lit("{"), first, F.lit(","), last, F.lit(',"l":[{"z":1,"c":2}]}'))
    rows = J.line_records(t.events.select(F.col("event_id").alias("doc_id"), text.alias("value")), "doc_id")
    listed = F.regexp_extract(F.col("fields")["l"], r"^\[(.*)\]$", 1)
    return rows.select("doc_id", F.col("fields")["a.b"].alias("a.b"), listed.alias("l"))


@query("b6_typed_lists", """
    select 'k' as path, o_orderkey::varchar as sample from orders
    union all select 'items[].status', o_orderstatus from orders union all select 'items[].by.cust', o_custkey::varchar from orders
    union all select 'tags', o_orderpriority from orders""")
def b6_typed(t):
    """Lists of structs are inventoried by the fields of their first member."""
    item = F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("cust")).alias("by"))
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.array(item, item).alias("items"), F.array("o_orderpriority").alias("tags"))
    return shape.typed_path_samples(rows, [])


@query("a9_record_tags", "select 'entry' as tag, count(distinct n_regionkey) as files from nation")
def a9_tags(t):
    """The record tag of one file per region, from the beginning of each."""
    path = shared_dir(t.spark, "tags")
    t.nation.repartition("n_regionkey").write.partitionBy("n_regionkey").format("xml").options(rootTag="all", rowTag="entry").save(path)
    tags = XM.record_tags(FS.list_files(t.spark, path))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("files"))


@query("a10_name_clash", """
    select s_suppkey::varchar as id, s_name as id_1, 'a' as tag, 'b' as tag_1, 'c' as tag_1_1 from supplier""")
def a10_clash(t):
    """An attribute with the name of a child, and a child with the name of a numbered one."""
    path = shared_dir(t.spark, "clash")
    record = F.concat(F.lit('<e id="'), "s_suppkey", F.lit('"><id>'), "s_name", F.lit("</id><tag>a</tag><tag>b</tag><tag_1>c</tag_1></e>"))
    t.supplier.agg(F.concat(F.lit("<all>"), F.concat_ws("", F.collect_list(record)), F.lit("</all>")).alias("value")).write.text(path)
    rows = XM.read_xml(t.spark, path)
    return rows.select(*[F.col("fields")[n].alias(n) for n in ("id", "id_1", "tag", "tag_1", "tag_1_1")])


# ── tables and keys of any size ──────────────────────────────────────────────

@query("d8_map_large", """
    select l_orderkey, l_linenumber, l_partkey, case when l_partkey % 2 = 0 then 'part ' || l_partkey::varchar else l_partkey::varchar end as name
    from lineitem where l_partkey < 5000 union all select l_orderkey, l_linenumber, l_partkey, l_partkey::varchar from lineitem where l_partkey >= 5000""")
def d8_large(t):
    """A substitution table of 2,500 entries."""
    mapping = {str(i): f"part {i}" for i in range(0, 5000, 2)}
    cell = compile_mapping(t.lineitem, {"columns": ["l_partkey"], "transform": steps("to_string", ("map", {"mapping": mapping}))})
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", cell.col.alias("name"))


@query("m6_long_keys", """
    select event_id, 'https://catalogue.example.org/dataset/' || (1000000000000 + event_id)::varchar as uri from events""")
def m6_long(t):
    """Keys that share their first eight characters name different records."""
    df = t.events.select("event_id", (F.col("event_id") + 1_000_000_000_000).alias("key"))
    return df.select("event_id", X.dataset_uri(df, "key").alias("uri"))


@query("h7_knn_blocks", CENTROIDS + """
    select vec_id, rank, 'c' || label::varchar as code, round(dist, 6) as distance from k where rank <= 3 and vec_id % 7 <> 0""")
def h7_blocks(t):
    """The block plan, with queries and entries that have no vector."""
    q = vectors(t).withColumn("vector", F.when(F.col("vec_id") % 7 != 0, F.col("vector")))
    none = t.spark.createDataFrame([("none", "u", None)], "code string, uri string, vector array<double>")
    vocab = centroids(t).unionByName(none).where(F.col("vector").isNotNull())
    rows = vocab.count()
    hits = nearest.scan_blocks(q.where(F.col("vector").isNotNull()), vocab, "vec_id", 3, [], "l2", rows * 4096)
    hits = hits.select("vec_id", F.inline_outer("best")).where("code is not null")
    return hits.select("vec_id", F.col("rank").cast("bigint").alias("rank"), "code", F.round("distance", 6).alias("distance"))


@query("g4_custom_statistic", """
    select count(*) as number_of_records, count(distinct l_partkey) as number_of_unique_individuals, min(l_quantity) as min_typical_age,
           max(l_quantity) as max_typical_age, strftime(min(l_shipdate), '%Y-%m-%d') as coverage_start,
           strftime(max(l_shipdate), '%Y-%m-%d') as coverage_end, avg(l_tax) as mean_tax from lineitem""")
def g4_custom(t):
    """A statistic of one's own joins the scan of the others."""
    if "mean_tax" not in P.STATISTICS:
        @P.statistic("mean_tax")
        def mean_tax(df, plan, spec, given, options):
            return [plan.add(F.avg(spec)).alias("mean_tax")]

    return P.profile(t.lineitem, {**LINEITEM, "mean_tax": "l_tax"})


@query("g5_profile_lake", """
    select 'd=' || (l_partkey % 200)::varchar as dataset_id, count(*) as number_of_records, count(distinct l_partkey) as number_of_unique_individuals,
           min(l_quantity) as min_typical_age, max(l_quantity) as max_typical_age, strftime(min(l_shipdate), '%Y-%m-%d') as coverage_start,
           strftime(max(l_shipdate), '%Y-%m-%d') as coverage_end from lineitem group by 1
    union all select 'e=' || s_nationkey::varchar, count(*), count(distinct s_suppkey), null, null, null, null from supplier group by 1""")
def g5_lake(t):
    """Two hundred datasets of one schema and some of another: two scans."""
    root = shared_dir(t.spark, "lake")
    rows = t.lineitem.withColumn("d", F.col("l_partkey") % 200)
    rows.repartition("d").write.partitionBy("d").parquet(root)
    t.supplier.withColumn("e", F.col("s_nationkey")).repartition("e").write.mode("append").partitionBy("e").parquet(root)
    people = {"number_of_unique_individuals": [{"columns": ["s_suppkey"]}]}
    return profile_lake(t.spark, root, lambda columns: LINEITEM if "l_partkey" in columns else people)


# ── records ──────────────────────────────────────────────────────────────────

@query("l4_object_then_subfield", """
    select c_custkey as dataset_id, 'hdab' as field, 'phone' as subfield, '1' as value from customer
    union all select c_custkey, 'hdab', 'email', c_name from customer
    union all select c_custkey, 'title', null, '"t"' from customer
    union all select c_custkey, 'publisher', null, '{"name":"p"}' from customer""")
def l4_object(t):
    """A whole object and later one subfield: the other members stay."""
    none = F.lit(None).cast("string")
    row = lambda seq, field, sub, value: F.struct(F.lit(seq).cast("bigint").alias("seq"), F.lit(field).alias("field"), sub.alias("subfield"), value.alias("value"))
    rows = F.array(
        row(1, "hdab", none, F.lit('{"phone":"1","email":"old"}')), row(2, "hdab", F.lit("email"), F.col("c_name")),
        row(1, "publisher", F.lit("gone"), F.lit("x")), row(2, "publisher", none, F.lit('{"name":"p"}')), row(1, "title", none, F.lit('"t"')),
    )
    return A.fold_changes(spread(t.customer).select(F.col("c_custkey").alias("dataset_id"), F.inline(rows)))


@query("n7_strings_only", "select c_custkey, 'A|' || c_name as codes from customer")
def n7_strings(t):
    """Numbers in a list of codes are none."""
    raw = F.concat(F.lit('["A", 5, null, "'), "c_name", F.lit('"]'))
    return t.customer.select("c_custkey", F.concat_ws("|", N.answer_codes(raw)).alias("codes"))


# Every escape of a literal, the code points spelt by their numbers.
ESCAPED = r"|u00e9|b|f|'|%s|uD83D|uDE00|t||n|U000000E9".replace("|", "\\") % '"'


@query("m7_escapes", r"""
    select p_partkey, p_name || 'é' || chr(8) || chr(12) || '''"' || chr(128512) || chr(9) || '\n' || 'é' as o, null::varchar as error from part
    union all select p_partkey, null, 'no N-Triples statement' from part""")
def m7_escapes(t):
    """All escapes of a literal; broken lines are rows of their own."""
    literal = F.concat(F.lit('<http://s/'), "p_partkey", F.lit('> <http://p> "'), "p_name", F.lit(ESCAPED + '" .'))
    broken = F.concat(F.lit("<http://s/"), "p_partkey", F.lit("> <http://p> oops ."))
    lines = t.part.select(F.explode(F.array(literal, broken, F.lit("# remark"), F.lit(""))).alias("value"))
    good = X.parse_ntriples(lines).select(F.regexp_extract("s", r"(\d+)$", 1).cast("bigint").alias("p_partkey"), "o", F.lit(None).cast("string").alias("error"))
    bad = X.broken_lines(lines).select(F.regexp_extract("value", r"/s/(\d+)>", 1).cast("bigint").alias("p_partkey"), F.lit(None).cast("string").alias("o"), "error")
    return good.unionByName(bad)


@query("v3_answer_errors", """
    select c_custkey as dataset_id, 'theme: vocab JSON not found' as error from customer
    union all select c_custkey, 'region: LLM call failed — answer is no JSON list' from customer where c_custkey % 2 = 0
    union all select c_custkey, 'place' || (c_custkey % 2)::varchar || ': no vector table — run build_vector_db.py' from customer""")
def v3_answer_errors(t):
    """A vocabulary that is missing, a list that is broken, a feature without vectors."""
    key = F.col("c_custkey")
    answers = t.customer.select(key.alias("dataset_id"), F.inline(F.array(
        F.struct(F.lit("theme").alias("feature"), F.lit('["A"]').alias("raw")),
        F.struct(F.lit("region").alias("feature"), F.when(key % 2 == 0, '["AS').otherwise('["ASIA"]').alias("raw")),
    )))
    registry = t.spark.createDataFrame([("theme", "http://t", True), ("region", "http://r", True)], "feature string, base_url string, multiple boolean")
    vocab = t.region.select(F.lit("region").alias("feature"), F.col("r_name").alias("code")).unionByName(
        t.nation.select(F.lit("nation").alias("feature"), F.col("n_name").alias("code"))
    )
    index = t.region.select(F.col("r_name").alias("feature"))
    asked = t.customer.select(key.alias("dataset_id"), F.concat(F.lit("place"), key % 2).alias("feature"))
    return N.code_errors(N.match_codes(answers, registry, vocab)).unionByName(N.missing_tables(asked, index))


# ── written and read back ────────────────────────────────────────────────────

@query("r1_records_written", """
    select '{"size":' || o_custkey::varchar || ',"title":"' || o_orderpriority || '"}' as value from orders""")
def r1_written(t):
    path = shared_dir(t.spark, "records")
    sinks.write_records(order_fields(t, ("title", shape.json_string(F.col("o_orderpriority"))), ("size", F.col("o_custkey").cast("string"))), path)
    return t.spark.read.text(path)


@query("r2_report_written", """
    select o_orderkey::varchar || chr(9) || '  Title es: ' || o_orderpriority as value from orders""")
def r2_written(t):
    path = shared_dir(t.spark, "report")
    sinks.write_report(order_fields(t, ("title_es", shape.json_string(F.col("o_orderpriority")))), path)
    return t.spark.read.text(path)


@query("r3_vector_values", """
    with w as (select p_partkey, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) as w from part),
    h as (select p_partkey, count(*) as words from w where w <> '' group by 1)
    select p_partkey::varchar as code, 384 as dimensions, true as unit, words from h""")
def r3_values(t):
    """Vectors read back from their table: unit length, and as many words as cells add up to."""
    path = shared_dir(t.spark, "vectors")
    entries = spread(t.part).select(
        F.col("p_brand").alias("feature"), F.col("p_partkey").cast("string").alias("code"), F.lit("u").alias("uri"),
        F.concat_ws(" ", "p_name", "p_type").alias("text"),
    )
    sinks.write_vector_table(nearest.vector_table(entries), path)
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    # every cell is a whole number over the norm, so the smallest one tells the norm
    words = F.size(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).cast("bigint")
    return t.spark.read.parquet(path).select(
        "code", F.size("vector").alias("dimensions"), (F.abs(square - 1) < 1e-5).alias("unit"), words.alias("words")
    )


@query("r7_errors_written", """
    select event_id as number, '["' || event_type || '"]' as errors from events""")
def r7_written(t):
    path = shared_dir(t.spark, "errors")
    outputs = t.events.select(
        F.concat(F.lit("dataset_"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("folder"), F.col("ts").alias("modified"),
        F.concat(F.lit('"'), "event_type", F.lit('"')).alias("errors"),
    )
    sinks.write_json_rows(sinks.errors_summary(outputs), path)
    return t.spark.read.schema("number bigint, errors string").json(path)


@query("r9_final_written", """
    select '{"applicable_legislation":["law"],"distribution":[{"access_url":"http://a/' || o_custkey::varchar ||
           '","applicable_legislation":["law"]}],"title":"t"}' as value from orders""")
def r9_written(t):
    path = shared_dir(t.spark, "final")
    url = F.concat(F.lit('"http://a/'), "o_custkey", F.lit('"'))
    sinks.write_records(A.finalize(order_fields(t, ("title", F.lit('"t"')), ("access_url", url), ("applicable_legislation", F.lit('["law"]')))), path)
    return t.spark.read.text(path)


@query("g5_growing_lake", """
    select 'd=' || (l_partkey % 7)::varchar as dataset_id, count(*)::bigint as number_of_records, true as individuals_within_error,
           min(l_quantity)::double as min_typical_age, max(l_quantity)::double as max_typical_age, strftime(min(l_shipdate), '%Y-%m-%d') as coverage_start,
           strftime(max(l_shipdate), '%Y-%m-%d') as coverage_end, 0::bigint as files_read_again from lineitem group by 1""")
def g5_growing(t):
    """A lake of seven datasets that grows in two steps: the second run reads the new files only."""
    root = shared_dir(t.spark, "lake")
    rows = t.lineitem.withColumn("d", F.col("l_partkey") % 7)
    seen = []
    for part in (F.col("l_orderkey") % 3 == 0, F.col("l_orderkey") % 3 != 0):
        rows.where(part).repartition("d").write.mode("append").partitionBy("d").parquet(f"{root}/data")
        seen.append(refresh_partials(t.spark, f"{root}/data", f"{root}/store", "l_partkey", "l_quantity", "l_shipdate"))
    again = seen[0].join(seen[1], ["path", "modified"]).count()
    exact = rows.groupBy(F.concat(F.lit("d="), "d").alias("dataset_id")).agg(F.count_distinct("l_partkey").alias("exact"))
    found = F.col("number_of_unique_individuals")
    out = merged_profile(t.spark, f"{root}/data", f"{root}/store").join(exact, "dataset_id")
    within = F.abs(found - F.col("exact")) <= 0.025 * F.col("exact")
    return out.withColumns({"individuals_within_error": within, "files_read_again": F.lit(again)}).drop("number_of_unique_individuals", "exact")


@query("a4_split_spanning", """
    select event_id::varchar as id, 'a' || chr(10) || '"' || event_type || '", b' as note, user_id::varchar as tail from events""")
def a4_split_spanning(t):
    """One file whose cells hold line breaks, delimiters and quotes, read in ranges of 64 KB."""
    path = shared_dir(t.spark, "spanning")
    note = F.concat(F.lit('a\n"'), "event_type", F.lit('", b'))
    rows = t.events.select(F.col("event_id").cast("string").alias("id"), note.alias("note"), F.col("user_id").cast("string").alias("tail"))
    rows.coalesce(1).write.options(header=True, escape='"').csv(path)
    return D.read_csv(t.spark, path, record_bytes=1 << 16)


@query("a5_broken_middle", """
    select s_suppkey as position, case when s_suppkey % 5 <> 2 then s_name end as name, s_suppkey % 5 = 2 as broken from supplier""")
def a5_broken_middle(t):
    """An array with items that are no JSON: each costs itself only."""
    k = F.col("s_suppkey")
    name = F.when(k % 5 == 2, F.lit("oops")).otherwise(F.concat(F.lit('"'), "s_name", F.lit('"')))
    close = F.when(k == F.lit(t.supplier.agg(F.max("s_suppkey")).scalar()), "]").otherwise(",")
    value = F.concat(F.when(k == 0, "[").otherwise(""), F.lit('{"name":'), name, F.lit("}"), close)
    rows = J.read_json(t.spark, lines_file(t, t.supplier, k, value))
    return rows.select("position", F.col("fields")["name"].alias("name"), F.col("error").isNotNull().alias("broken"))


#: Events in one array file of ``a5_split_array``.
ARRAY_ROWS = 250_000


@query("a5_split_array", """
    select event_id as position, event_id::varchar as id, '{["' || event_type || '\\",' as kind, props::json->>'k' as k from events""")
def a5_split_array(t):
    """Arrays in ranges of 64 KB: brackets, quotes and commas in strings mark no end.

    A file is written by one task, so every ``ARRAY_ROWS`` events are an array of their own.
    """
    path, part = shared_dir(t.spark, "arrays"), F.expr(f"event_id div {ARRAY_ROWS}")
    text = F.to_json(F.struct(F.concat(F.lit('{["'), "event_type", F.lit('\\",')).alias("kind")))
    start = F.when(F.col("event_id") % ARRAY_ROWS == 0, "[").otherwise(",")
    value = F.concat(start, F.lit('{"id":'), "event_id", F.lit(',"p":'), "props", F.lit(',"q":'), text, F.lit("}"))
    items = t.events.select(part.alias("part"), F.col("event_id").alias("o"), value.alias("value"))
    ends = items.groupBy("part").agg((F.max("o") + 1).alias("o"), F.lit("]").alias("value"))
    files = items.unionByName(ends).repartition(ends.count(), "part").sortWithinPartitions("part", "o")
    files.select("part", "value").write.partitionBy("part").text(path)
    rows = J.read_json(t.spark, path, range_bytes=1 << 16)
    first = F.regexp_extract("path", r"/part=(\d+)/[^/]*$", 1).cast("bigint") * ARRAY_ROWS
    at = lambda name: F.col("fields")[name]
    return rows.select((first + F.col("position")).alias("position"), at("id").alias("id"), at("q.kind").alias("kind"), at("p.k").alias("k"))


@query("h7_knn_pivots", CENTROIDS + """
    select vec_id, rank, 'c' || label::varchar as code, round(dist, 6) as distance from k where rank <= 3""")
def h7_pivots(t):
    """The search by cells around pivots, with cells of two entries."""
    vocab, q = centroids(t), vectors(t)
    hits = pivots.pivot_nearest(q, vocab, "vec_id", 3, [], "l2", vocab.count(), cell=2)[0]
    hits = hits.select("vec_id", F.inline("best"))
    return hits.select("vec_id", F.col("rank").cast("bigint").alias("rank"), "code", F.round("distance", 6).alias("distance"))


@query("h5_large_dictionary", """
    with l as (select 'l' || o_orderkey::varchar as label from orders union all select p_name from part),
    t as (select p_partkey, p_name || ' l' || p_partkey::varchar as body from part)
    select p_partkey, label from t, l where contains(body, label)""")
def h5_large(t):
    """Labels of a dictionary as large as the orders, over the index of grams."""
    labels = t.orders.select(F.concat(F.lit("l"), "o_orderkey").alias("pattern")).unionByName(t.part.select(F.col("p_name").alias("pattern")))
    texts = t.part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" l"), "p_partkey").alias("body"))
    many = t.part.groupBy(F.col("p_name").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    found = contained(texts, labels).join(many, "pattern", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    return repeated(found, "n").select(F.col("id").alias("p_partkey"), F.col("pattern").alias("label"))
