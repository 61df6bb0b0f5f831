"""Vocabulary joins, containment matches, nearest neighbours, geographic coverage."""

from pyspark.sql import functions as F

from ..operators import lookup as L, nearest as N, spatial
from ..session import spread
from .registry import query


def nation_vocab(t):
    return t.nation.select(
        F.lit("nation").alias("feature"), F.col("n_name").alias("code"),
        L.code_uri(F.lit("http://v.org/nation/"), F.col("n_name")).alias("uri"),
    )


def customer_codes(t):
    """Codes of the customers; each seventh nation key points outside the vocabulary."""
    code = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("X"), F.col("c_nationkey"))).otherwise(
        F.concat(F.lit("NATION_"), F.col("c_nationkey"))
    )
    return t.customer.select(F.col("c_custkey").alias("dataset_id"), F.lit("nation").alias("feature"), code.alias("code"))


@query("h1_code_uri", """
    select c_custkey as dataset_id, 'nation' as feature, n_name as code, 'http://v.org/nation/' || n_name as uri
    from customer join nation on n_nationkey = c_nationkey where c_custkey % 7 <> 0""")
def h1(t):
    return L.known_codes(customer_codes(t), nation_vocab(t))


@query("h2_unknown_codes", """
    select c_custkey as dataset_id, 'nation' as feature, 'X' || c_nationkey::varchar as code from customer where c_custkey % 7 = 0""")
def h2(t):
    return L.unknown_codes(customer_codes(t), nation_vocab(t))


def gazetteer(t):
    n = t.nation.select(F.lit("provinces").alias("level"), F.col("n_name").alias("name"), F.concat(F.lit("http://p/"), "n_name").alias("uri"))
    r = t.region.select(F.lit("continents").alias("level"), F.col("r_name").alias("name"), F.concat(F.lit("http://c/"), "r_name").alias("uri"))
    return n.unionByName(r)


@query("h3_places", """
    select s_suppkey, 'provinces' as level, n_name as name, 'http://p/' || n_name as uri
    from supplier join nation on n_nationkey = s_nationkey
    union all
    select s_suppkey, 'continents', r_name, 'http://c/' || r_name
    from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey""")
def h3(t):
    places = (
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.inline(F.array(
            F.struct(F.lit("provinces").alias("level"), F.col("n_name").alias("name")),
            F.struct(F.lit("continents").alias("level"), F.col("r_name").alias("name")),
            F.struct(F.lit("continents").alias("level"), F.col("n_name").alias("name")),
        )))
    )
    return L.place_uris(places, gazetteer(t))


@query("h4_label_uri", """
    select s_suppkey, 'nation' as kind, lower(n_name) as label, 'http://d/' || n_nationkey::varchar as uri
    from supplier join nation on n_nationkey = s_nationkey""")
def h4(t):
    dims = t.nation.select(F.lit("nation").alias("kind"), F.col("n_name").alias("label"), F.concat(F.lit("http://d/"), F.col("n_nationkey")).alias("uri")).unionByName(
        t.region.select(F.lit("region").alias("kind"), F.col("r_name").alias("label"), F.concat(F.lit("http://r/"), F.col("r_regionkey")).alias("uri"))
    )
    labels = t.supplier.select("s_suppkey", F.lit("nation").alias("kind"), F.concat(F.lit("nation_"), F.col("s_nationkey")).alias("label"))
    return L.label_uris(labels, dims)


def part_labels(t):
    return t.part.groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("ord")).withColumn(
        "uri", F.concat(F.lit("http://l/"), F.col("ord"))
    )


LABELS = "l as (select p_name as label, min(p_partkey) as ord from part group by 1)"


@query("h5_relevant_any_word", f"""
    with {LABELS},
    h as (select doc_id, ord, label from documents, l where len(list_filter(string_split(label, ' '), lambda w: contains(lower(text), w))) > 0),
    f as (select ord, label from l order by ord limit 5)
    select doc_id, ord, label, 'http://l/' || ord::varchar as uri from h
    union all select doc_id, ord, label, 'http://l/' || ord::varchar from f,
        (select doc_id from documents where doc_id not in (select doc_id from h))""")
def h5(t):
    labels, texts = part_labels(t), spread(t.documents.select("doc_id", "text"))
    return L.relevant_labels(texts, labels, "doc_id", "text", fallback=L.first_entries(labels))


@query("h5_relevant_whole_label", """
    with l as (select distinct p_type as label from part)
    select p_partkey, label from part, l where contains(lower(p_type || ' ' || p_name), lower(label))""")
def h5_whole(t):
    labels = t.part.select(F.lower("p_type").alias("label")).distinct().withColumns({"ord": F.lit(0), "uri": F.col("label")})
    texts = t.part.select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("text"))
    return L.relevant_labels(texts, labels, "p_partkey", "text", "whole").select("p_partkey", F.upper("label").alias("label"))


@query("h6_hint_expansion", """
    with h as (select split_part(p_name, ' ', 2) as word, min(p_partkey) as ord from part group by 1
               union all select split_part(p_name, ' ', 1), min(p_partkey) + 100000 from part group by 1),
    m as (select p_partkey, ord, word from part, h where contains(lower(p_name), word))
    select p_partkey, string_agg('es-' || word, '|' order by ord) as hints, 'es-' || arg_min(word, ord) as first_hint
    from m group by 1""")
def h6(t):
    words = F.split("p_name", " ")
    second = t.part.groupBy(words[1].alias("word")).agg(F.min("p_partkey").alias("ord"))
    first = t.part.groupBy(words[0].alias("word")).agg((F.min("p_partkey") + 100000).alias("ord"))
    hints = second.unionByName(first).withColumn("hint", F.concat(F.lit("es-"), "word"))
    out = L.expand_hints(t.part.select("p_partkey", "p_name"), hints, "p_name")
    return out.select("p_partkey", F.concat_ws("|", "hints").alias("hints"), "first_hint")


@query("h11_help_entry", """
    with g as (select n_nationkey as ord, n_name as name, 'help ' || n_name as label from nation where n_nationkey <> 3),
    f as (select s_suppkey, case when s_suppkey % 3 = 0 then 'NATION_' || s_nationkey::varchar || '.x'
                                 when s_suppkey % 3 = 1 then 'NATION_' || s_nationkey::varchar else 'zz' || s_suppkey::varchar end as field
          from supplier),
    n as (select f.field, arg_min(g.label, g.ord) as label from (select distinct field from f) f, g
          where (starts_with(f.field, g.name) or starts_with(g.name, f.field)) group by 1)
    select s_suppkey, f.field, coalesce(e.label, n.label, f.field) as label
    from f left join g e on e.name = f.field left join n on n.field = f.field""")
def h11(t):
    guide = t.nation.where(F.col("n_nationkey") != 3).select(
        F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), F.concat(F.lit("help "), "n_name").alias("label")
    )
    nation = F.concat(F.lit("NATION_"), F.col("s_nationkey"))
    field = (
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(nation, F.lit(".x")))
        .when(F.col("s_suppkey") % 3 == 1, nation).otherwise(F.concat(F.lit("zz"), F.col("s_suppkey")))
    )
    return L.help_entry(t.supplier.select("s_suppkey", field.alias("field")), guide)


@query("h12_display_label", """
    select p_partkey, 'R' || (p_size % 5)::varchar as segment, 'Label ' || r_name as display
    from part join region on r_regionkey = p_size % 5 where p_size % 2 = 1
    union all select p_partkey, 'tyPe' || p_type, 'ty Pe ' || p_type from part where p_size % 2 = 0""")
def h12(t):
    dims = t.region.select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("code"), F.concat(F.lit("Label "), "r_name").alias("label"))
    segment = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("tyPe"), "p_type")).otherwise(F.concat(F.lit("R"), F.col("p_size") % 5))
    return L.display_label(t.part.select("p_partkey", segment.alias("segment")), dims, "segment")


def centroids(t):
    """One vector per label: the mean of its members, the labels being the vocabulary."""
    cells = t.embeddings.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select(
        F.concat(F.lit("c"), F.col("label")).alias("code"),
        F.concat(F.lit("http://e/"), F.col("label")).alias("uri"),
        F.transform("v", lambda c: c["x"]).alias("vector"),
    )


CENTROIDS = """
    with cells as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings),
    means as (select label, pos, avg(x) as x from cells group by 1, 2),
    q as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings),
    d as (select vec_id, label, sum((q.x - means.x) * (q.x - means.x)) as dist from q join means using (pos) group by 1, 2),
    k as (select *, row_number() over (partition by vec_id order by dist, label) as rank from d)
"""


def vectors(t):
    return t.embeddings.select("vec_id", F.col("embedding").alias("vector"))


@query("h7_knn", CENTROIDS + """
    select vec_id, rank, 'c' || label::varchar as code, round(dist, 6) as distance from k where rank <= 3""")
def h7(t):
    hits = N.nearest(vectors(t), centroids(t), "vec_id", 3)
    return hits.select("vec_id", F.col("rank").cast("bigint").alias("rank"), "code", F.round("distance", 6).alias("distance"))


@query("i6_relative_cut", CENTROIDS + """
    select vec_id, 'c' || label::varchar as code from (select *, min(dist) over (partition by vec_id) as best from k where rank <= 5)
    where dist <= best * 1.02""")
def i6(t):
    hits = N.nearest(vectors(t), centroids(t), "vec_id", 5)
    return N.relative_cut(hits, ["vec_id"], 1.02).select("vec_id", "code")


@query("v5_similarity_match", CENTROIDS + """
    select vec_id, string_agg('http://e/' || label::varchar, '|' order by rank) as uris
    from (select *, min(dist) over (partition by vec_id) as best from k where rank <= 3)
    where dist <= best * 1.2 and label <> 4 group by 1""")
def v5(t):
    vocab = centroids(t).withColumn("uri", F.when(F.col("code") != "c4", F.col("uri")))
    out = N.similarity_match(vectors(t), vocab, "vec_id", 3, True)
    return out.select("vec_id", F.concat_ws("|", "uris").alias("uris"))


@query("v8_index_totals", """
    select count(distinct p_brand) as features, count(*) as entries from part""")
def v8(t):
    entries = t.part.select(
        F.col("p_brand").alias("feature"), F.col("p_partkey").cast("string").alias("code"), F.lit("u").alias("uri"),
        F.concat_ws(" ", "p_name", "p_type").alias("text"),
    )
    return N.index_totals(N.vector_table(entries))


@query("g11_index_totals", "select count(distinct label) as features, count(*) as entries from embeddings")
def g11(t):
    return N.index_totals(t.embeddings.select(F.col("label").alias("feature")))


@query("v6_geo_cascade", """
    with h as (select l_orderkey as dataset_id, 'http://p/' || n_name as p, 'http://c/' || r_name as c,
                      l_linenumber * 1000000 + l_suppkey as ord
               from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey
               join region on r_regionkey = n_regionkey),
    pc as (select dataset_id, p as uri, count(*) as n, min(ord) as first from h group by 1, 2),
    pk as (select dataset_id, 1 as lvl, uri, first from pc
           where dataset_id in (select dataset_id from pc group by 1 having sum(n) / 25.0 <= 0.10)),
    cc as (select dataset_id, 4 as lvl, c as uri, min(ord) as first from h group by 1, 3),
    u as (select dataset_id, string_agg(uri, '|' order by lvl, first, uri) as uris
          from (select * from pk union all select * from cc) group by 1)
    select o_orderkey as dataset_id,
           coalesce(uris, 'http://publications.europa.eu/resource/authority/country/ESP') as uris
    from orders left join u on dataset_id = o_orderkey""")
def v6(t):
    # Places of a supplier are looked up once per supplier, not once per line.
    supplier_places = L.place_uris(
        t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.inline(F.array(
            F.struct(F.lit("provinces").alias("level"), F.col("n_name").alias("name")),
            F.struct(F.lit("continents").alias("level"), F.col("r_name").alias("name")),
        ))),
        gazetteer(t),
    ).select("s_suppkey", "level", "uri")
    named = t.lineitem.join(
        supplier_places, F.col("l_suppkey") == F.col("s_suppkey")
    ).select(
        F.col("l_orderkey").alias("dataset_id"), "level", "uri",
        (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("ord"),
    )
    places = gazetteer(t)
    out = spatial.coverage_uris(
        named, spatial.level_sizes(places),
        t.orders.select(F.col("o_orderkey").alias("dataset_id")), "dataset_id",
    )
    return out.select("dataset_id", F.concat_ws("|", "uris").alias("uris"))
