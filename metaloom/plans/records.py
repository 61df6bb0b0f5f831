"""Record assembly, validation, triples, answers and usage."""

from pyspark.sql import functions as F

from ..operators import answers as N, assemble as A, profile as P, rules as R, triples as X, usage as U
from ..operators.shape import json_string
from ..session import shared_dir, spread, written
from ..sources import sinks
from .registry import ORACLE, query


def js(name):
    """JSON string of a column."""
    return json_string(F.col(name).cast("string"))


def order_fields(t, *pairs, df=None):
    rows = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in pairs])
    return (t.orders if df is None else df).select(F.col("o_orderkey").alias("dataset_id"), F.inline(rows))


# ── merge, override, defaults ────────────────────────────────────────────────

@query("h8_merge_steps", """
    select o_orderkey as dataset_id, unnest(['title', 'notes', 'spatial']) as field,
           unnest([case when o_orderstatus = 'O' then '"v"' else '"m"' end, '"' || o_orderpriority || '"', '"s"']) as value
    from orders""")
def h8(t):
    model = order_fields(t, ("title", F.lit('"m"')), ("notes", js("o_orderpriority")), ("title_en_tmpt", F.lit('"x"')), ("errors", F.lit("[1]")))
    static = order_fields(t, ("spatial", F.lit('"s"')))
    vocab = order_fields(t, ("title", F.lit('"v"')), df=t.orders.where("o_orderstatus = 'O'"))
    steps = (
        vocab.withColumn("step", F.lit("vocabulary"))
        .unionByName(model.withColumn("step", F.lit("llm_metadata")))
        .unionByName(static.withColumn("step", F.lit("static")))
    )
    return A.merge_steps(steps)


@query("l1_accumulated_errors", """
    select user_id as dataset_id, row_number() over (partition by user_id order by step, event_id) as n, props as error
    from (select *, case event_type when 'error' then 1 when 'view' then 2 else 5 end as step from events)""")
def l1(t):
    step = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 2).otherwise(5)
    return A.accumulated_errors(t.events.select(
        F.col("user_id").alias("dataset_id"), step.alias("step_rank"), F.col("event_id").alias("pos"), F.col("props").alias("error")
    ))


@query("h9_override", """
    select o_orderkey as dataset_id, 'title' as field, case when o_custkey % 2 = 0 then '"given"' else '"t"' end as value from orders
    union all select o_orderkey, 'notes', '"' || o_orderstatus || '"' from orders
    union all select o_orderkey, 'version', '"1.0"' from orders
    union all select o_orderkey, 'extra', '[]' from orders where o_custkey % 3 = 0""")
def h9(t):
    base = order_fields(t, ("title", F.lit('"t"')), ("notes", js("o_orderstatus")), ("version", F.lit('"1.0"')))
    given = order_fields(
        t, ("title", F.when(F.col("o_custkey") % 2 == 0, '"given"').otherwise('"  "')), ("notes", F.lit("[ ]")),
        ("version", F.lit('"9.0"')), ("has_version", F.lit("[]")),
    ).unionByName(order_fields(t, ("extra", F.lit("[]")), df=t.orders.where("o_custkey % 3 = 0")))
    return A.apply_overrides(base, given)


@query("l2_static_defaults", """
    select o_orderkey as dataset_id, field, case when field = 'theme' and o_custkey % 2 = 0 then '["T"]' else value end as value
    from orders, (values ('issued', '"2024-05-06T07:08:09.010Z"'), ('modified', '"2024-05-06T07:08:09.010Z"'),
      ('theme', '["http://publications.europa.eu/resource/authority/data-theme/HEAL"]'),
      ('legal_basis', '{"description":"RGPD","source":"https://www.boe.es/doue/2016/119/L00001-00088.pdf"}'),
      ('applicable_legislation', '[{"uri":"http://data.europa.eu/eli/reg/2016/679/oj","label":"GDPR"},{"uri":"http://data.europa.eu/eli/reg/2025/327/oj","label":"Reglamento EHDS"}]')
    ) d(field, value)""")
def l2(t):
    given = order_fields(t, ("theme", F.when(F.col("o_custkey") % 2 == 0, '["T"]').otherwise("[]")))
    return A.static_fields(t.orders.select(F.col("o_orderkey").alias("dataset_id")), given, "2024-05-06T07:08:09.010Z")


@query("l3_derived_names", """
    select p_partkey as dataset_id, 'description' as field, case when p_size % 2 = 0 then '"given"' else '"' || p_type || '"' end as value from part
    union all select p_partkey, 'name', '"' || p_name || '"' from part where p_size % 3 <> 0""")
def l3(t):
    key = F.col("p_partkey").alias("dataset_id")
    size = F.col("p_size")

    def rows(*pairs):
        return t.part.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in pairs])))

    model = rows(("notes", js("p_type")), ("title", js("p_name")), ("keyword", F.lit("[]")))
    given = rows(
        ("notes", F.when(size % 2 == 0, '"given"').otherwise('""')), ("name", F.when(size % 3 == 0, '"n"').otherwise('" "')),
    )
    return A.derived_names(model, given)


@query("l4_upsert_fold", """
    with log as (select user_id as dataset_id, event_id as seq, 'f_' || event_type as field,
        case when event_id % 5 = 0 then null when event_id % 2 = 0 then 'a' else 'b' end as subfield,
        case when event_id % 7 = 0 then null else event_id::varchar end as value from events),
    w as (select dataset_id, field, max(case when subfield is null and value is not null then seq end) as ws from log group by 1, 2),
    p as (select l.dataset_id, l.field, l.subfield, arg_max_null(l.value, l.seq) as value, max(l.seq) as seq
          from log l where subfield is not null group by 1, 2, 3),
    alive as (select p.* from p join w using (dataset_id, field) where p.seq > coalesce(w.ws, -1))
    select dataset_id, field, subfield, value from alive
    union all
    select w.dataset_id, w.field, null, l.value from w left join log l on l.dataset_id = w.dataset_id and l.field = w.field and l.seq = w.ws
    where (w.dataset_id, w.field) not in (select (dataset_id, field) from alive)""")
def l4(t):
    e = F.col("event_id")
    log = t.events.select(
        F.col("user_id").alias("dataset_id"), e.alias("seq"), F.concat(F.lit("f_"), "event_type").alias("field"),
        F.when(e % 5 != 0, F.when(e % 2 == 0, "a").otherwise("b")).alias("subfield"),
        F.when(e % 7 != 0, e.cast("string")).alias("value"),
    )
    return A.fold_changes(log)


@query("l5_conditional_fields", """
    select o_orderkey as dataset_id, 'access_rights' as field, case when o_orderstatus = 'P' then '"http://x/NON_PUBLIC"' else '"http://x/PUBLIC"' end as value from orders
    union all select o_orderkey, 'identifier', case when o_orderstatus = 'P' then '"http://closed"' else '"id"' end from orders
    union all select o_orderkey, 'access_url', '"http://closed"' from orders where o_orderstatus = 'P'""")
def l5(t):
    rights = F.when(F.col("o_orderstatus") == "P", '"http://x/NON_PUBLIC"').otherwise('"http://x/PUBLIC"')
    return A.conditional_fields(order_fields(t, ("access_rights", rights), ("identifier", F.lit('"id"'))), "http://closed")


@query("l6_finalize", """
    select o_orderkey as dataset_id, 'title' as field, '"t"' as value from orders
    union all select o_orderkey, 'applicable_legislation',
        case when o_orderstatus = 'F' then '["law"]' else '[{"uri":"http://data.europa.eu/eli/reg/2016/679/oj","label":"GDPR"}]' end from orders
    union all select o_orderkey, 'distribution', '[{"access_url":"http://a","size":' || o_custkey::varchar || ',"applicable_legislation":'
        || case when o_orderstatus = 'F' then '["law"]' else '[{"uri":"http://data.europa.eu/eli/reg/2016/679/oj","label":"GDPR"}]' end || '}]'
        from orders where o_custkey % 2 = 0""")
def l6(t):
    values = order_fields(
        t, ("title", F.lit('"t"')), ("access_url", F.when(F.col("o_custkey") % 2 == 0, '"http://a"').otherwise('""')),
        ("size", F.col("o_custkey").cast("string")), ("format", F.lit("null")),
    ).unionByName(order_fields(t, ("applicable_legislation", F.lit('["law"]')), df=t.orders.where("o_orderstatus = 'F'")))
    return A.finalize(values)


@query("l8_contract", """
    select o_orderkey as dataset_id, 0 as ord, 'title' as field, o_orderstatus as value from orders
    union all select o_orderkey, 1, 'notes', null from orders""")
def l8(t):
    values = order_fields(t, ("title", F.col("o_orderstatus")), ("other", F.lit("x")))
    return A.contract(values, t.orders.select(F.col("o_orderkey").alias("dataset_id")), ["title", "notes"])


@query("c2_drop_internal", """
    select o_orderkey as dataset_id, 'title' as field, o_orderstatus as value from orders""")
def c2(t):
    return A.drop_internal(order_fields(t, ("title", F.col("o_orderstatus")), ("title_en_tmpt", F.col("o_orderpriority"))))


@query("c9_distribution_split", """
    select o_orderkey as dataset_id, 'size' as field, o_orderstatus as value from orders""")
def c9(t):
    values = order_fields(t, ("size", F.col("o_orderstatus")), ("title", F.lit("t")))
    return A.distribution_part(values)


@query("k16_active_fields", """
    select o_orderkey as dataset_id, 0 as block_id, b.ord, b.field from orders,
        (values (1, 'title'), (2, 'identifier'), (3, 'access_url')) b(ord, field)
    where o_orderstatus <> 'P' or b.field = 'title'""")
def k16(t):
    blocks = t.spark.createDataFrame(
        [(0, 1, "title"), (0, 2, "identifier"), (0, 3, "access_url"), (0, 4, "applicable_legislation")], "block_id int, ord int, field string"
    )
    rights = F.when(F.col("o_orderstatus") == "P", "http://x/non_public")
    return A.active_fields(t.orders.select(F.col("o_orderkey").alias("dataset_id"), rights.alias("access_rights")), blocks)


@query("h14_record_diff", """
    with a as (select o_orderkey as dataset_id, 'status' as field, o_orderstatus as value from orders
               union all select o_orderkey, 'price', o_totalprice::varchar from orders where o_custkey % 4 <> 0),
    b as (select o_orderkey as dataset_id, 'status' as field, case when o_custkey % 5 = 0 then 'X' else o_orderstatus end as value from orders
          union all select o_orderkey, 'price', o_totalprice::varchar from orders where o_custkey % 3 <> 0)
    select dataset_id, field, case when b.value is null then 'missing in second' when a.value is null then 'missing in first' else 'differs' end as problem,
           a.value as before, b.value as after
    from a full join b using (dataset_id, field) where a.value is distinct from b.value
    union all
    select o_orderkey, 'version', 'not incremented', '"' || (o_custkey % 9)::varchar || '.0"', '"' || (o_custkey % 9 + 2)::varchar || '.0"'
    from orders where o_custkey % 6 = 0
    union all
    select o_orderkey, 'has_version', 'history not extended', '["' || (o_custkey % 9)::varchar || '.0"]',
           '["' || (o_custkey % 9)::varchar || '.0","' || (o_custkey % 9 + 1)::varchar || '.0"]'
    from orders where o_custkey % 6 = 0""")
def h14(t):
    return A.record_diff(*two_runs(t))


@query("h14_written_runs", ORACLE["h14_record_diff"])
def h14_written(t):
    """The same two runs, written as bucketed tables first."""
    tables, runs = [], two_runs(t)
    buckets = sinks.buckets_for(runs[0], 8)
    for run in runs:
        path = shared_dir(t.spark, "run")
        tables.append(sinks.write_run(run, path.rsplit("/", 1)[1].replace("-", "_"), path, buckets))
    return A.record_diff(*tables, bucketed=True)


def two_runs(t):
    c = F.col("o_custkey")
    v = c % 9

    def quoted(x):
        return F.concat(F.lit('"'), x.cast("string"), F.lit('.0"'))

    def listed(*xs):
        return F.concat(F.lit("["), F.concat_ws(",", *[quoted(x) for x in xs]), F.lit("]"))

    first = order_fields(t, ("status", F.col("o_orderstatus")), ("version", quoted(v)), ("has_version", listed(v))).unionByName(
        order_fields(t, ("price", F.col("o_totalprice").cast("string")), df=t.orders.where("o_custkey % 4 <> 0"))
    )
    grown = F.when(c % 6 == 0, v + 2).otherwise(v + 1)
    second = order_fields(
        t, ("status", F.when(c % 5 == 0, "X").otherwise(F.col("o_orderstatus"))), ("version", quoted(grown)), ("has_version", listed(v, v + 1))
    ).unionByName(order_fields(t, ("price", F.col("o_totalprice").cast("string")), df=t.orders.where("o_custkey % 3 <> 0")))
    return first, second


# ── completeness and validation ──────────────────────────────────────────────

@query("g7_completeness", """
    select source as dataset_id, count_if(quality is not null) as filled_required, count(*) as total_required,
           count_if(toxic = 1) as filled_optional, count(*) as total_optional
    from documents left join labels using (doc_id) group by 1""")
def g7(t):
    wide = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    values = wide.select(F.col("source").alias("dataset_id"), F.inline(F.array(
        F.struct(F.lit("quality").alias("field"), F.col("quality").isNotNull().alias("filled")),
        F.struct(F.lit("toxic").alias("field"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("filled")),
    )))
    required = t.spark.createDataFrame([("quality", True), ("toxic", False)], "field string, required boolean")
    return P.completeness(values, required, ["dataset_id"])


@query("g8_block_summary", """
    select lang as dataset_id, 'text' as block, count_if(n_chars > 1000) + count(*) as filled, 2 * count(*) as total,
           count_if(n_chars > 1000) = count(*) as complete from documents group by 1
    union all select lang, 'origin', count(*), count(*), true from documents group by 1""")
def g8(t):
    blocks = t.spark.createDataFrame([("text", "body"), ("text", "lang"), ("origin", "source")], "block string, field string")
    values = t.documents.select(F.col("lang").alias("dataset_id"), F.inline(F.array(
        F.struct(F.lit("body").alias("field"), (F.col("n_chars") > 1000).alias("filled")),
        F.struct(F.lit("lang").alias("field"), (F.col("lang") != "").alias("filled")),
        F.struct(F.lit("source").alias("field"), F.col("source").isNotNull().alias("filled")),
    )))
    return P.block_summary(values, blocks, ["dataset_id"])


RULES = [
    ("title", True, "text", None), ("name", False, "slug", None), ("tags", False, "list", None),
    ("mail", False, "email", None), ("site", False, "url", None),
    ("hdab", True, "list_object", [("email", "email", True, "Correo"), ("page", "url", False, "Página"), ("phone", "telephone", True, "Teléfono")]),
]


def rule_table(t):
    rows = [(f, req, typ, None, None, None, subs) for f, req, typ, subs in RULES]
    return t.spark.createDataFrame(rows, R.RULES_SCHEMA)


def customer_record(t):
    """Customers as records whose fields break the rules in known ways."""
    k = F.col("c_custkey")
    hdab = F.concat(
        F.lit('{"email":"'), F.when(k % 4 == 0, "bad@mail").otherwise("a@b.es"), F.lit('","page":"'),
        F.when(k % 5 == 0, "ftp://x.es").otherwise("https://x.es/p"), F.lit('","phone":"'),
        F.when(k % 6 == 0, "123 456").otherwise("+34 (600) 123-456"), F.lit('"}'),
    )
    rows = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (
        ("title", F.when(k % 3 == 0, '""').otherwise(js("c_name"))),
        ("name", F.when(k % 2 == 0, js("c_name")).otherwise(F.lower(F.regexp_replace(js("c_name"), "#", "-")))),
        ("tags", F.when(k % 10 == 0, '"x"').otherwise('["x"]')),
        ("mail", F.concat(F.lit('"'), "c_mktsegment", F.when(k % 7 == 0, "").otherwise("@m.org"), F.lit('"'))),
        ("site", F.when(k % 8 == 0, '"www.x.org"').otherwise('"http://x.org"')),
        ("hdab", F.when(k % 9 == 0, '"text"').otherwise(hdab)),
        ("free", F.lit("1")),
    )])
    return t.customer.select(k.alias("dataset_id"), F.inline(rows))


VALIDATION = """
    with c as (select c_custkey as k from customer),
    f as (
      select k, 'title' as field, null as subfield, 'required' as "check", '[OBLIG] title es obligatorio.' as message, false as marks from c where k % 3 = 0
      union all select k, 'name', null, 'slug', '[OPT] name debe ser un slug válido.', false from c where k % 2 = 0
      union all select k, 'tags', null, 'list', '[OPT] tags debe ser una lista.', false from c where k % 10 = 0
      union all select k, 'mail', null, 'email', '[OPT] mail debe ser un email válido.', false from c where k % 7 = 0
      union all select k, 'site', null, 'url', '[OPT] site debe ser una URL válida.', false from c where k % 8 = 0
      union all select k, 'hdab', null, 'object', '[OBLIG] hdab debe tener completados todos los campos.', false from c where k % 9 = 0
      union all select k, 'hdab', 'email', 'email', '[OBLIG] [hdab] Correo debe ser un email válido.', true from c where k % 4 = 0 and k % 9 <> 0
      union all select k, 'hdab', 'page', 'url', '[OPT] [hdab] Página debe ser una URL válida.', true from c where k % 5 = 0 and k % 9 <> 0
      union all select k, 'hdab', 'phone', 'telephone', '[OBLIG] [hdab] Teléfono debe ser un teléfono válido.', true from c where k % 6 = 0 and k % 9 <> 0)
"""


@query("k2_k8_validate", VALIDATION + "select k as dataset_id, * exclude (k) from f")
def k_validate(t):
    return R.validate(customer_record(t), rule_table(t), ["title", "hdab"])


@query("k4_email_rule", r"""
    select doc_id as dataset_id, word as value from (
      select doc_id, unnest(string_split_regex(text, '\s+')) as word from documents)
    where contains(word, '@') and regexp_full_match(word, '[^@\s]+@[^@\s]+\.[^@\s]+')""")
def k4(t):
    words = spread(t.documents).select(F.col("doc_id").alias("dataset_id"), F.explode(F.split("text", r"(?U)\s+")).alias("value"))
    return words.where(F.col("value").contains("@") & F.col("value").rlike(R.EMAIL))


@query("k9_identifier_rule", """
    select page_id as dataset_id, 'identifier' as field, null::varchar as subfield, 'identifier' as "check",
           '[OBLIG] [identifier] identifier debe ser un DOI válido (ej: 10.1234/dataset-salud).' as message, true as marks
    from pages where page_id % 3 = 0 and page_id % 2 = 1""")
def k9(t):
    k = F.col("page_id")
    url = F.when(k % 3 == 0, F.concat(F.lit('"<'), "url", F.lit('>"'))).otherwise(F.concat(F.lit('"'), "url", F.lit('"')))
    rights = F.when(k % 2 == 0, '"http://x/NON_PUBLIC"').otherwise('"http://x/PUBLIC"')
    rows = F.array(F.struct(F.lit("identifier").alias("field"), url.alias("value")), F.struct(F.lit("access_rights").alias("field"), rights.alias("value")))
    return R.validate_identifiers(t.pages.select(k.alias("dataset_id"), F.inline(rows)))


def field_rows(t):
    return t.spark.createDataFrame(
        [(1, "title", True), (2, "hdab", True), (3, "name", False), (4, "absent", False), (5, "hdab.page", True), (6, "license", True)],
        "ord int, field string, required boolean",
    )


MISSING = """
    m as (select k, 'title' as field from c where k % 3 = 0
          union all select k, 'hdab' from c where (k % 4 = 0 or k % 5 = 0 or k % 6 = 0) and k % 9 <> 0
          union all select k, 'hdab.page' from c where k % 9 = 0
          union all select k, 'license' from c)
"""


@query("k10_missing_required", VALIDATION + "," + MISSING + "select k as dataset_id, field from m")
def k10(t):
    values = customer_record(t)
    findings = R.validate(values, rule_table(t), ["title", "hdab"])
    required = field_rows(t).where("required").select("ord", "field")
    return R.missing_required(values.select("dataset_id").distinct(), values, findings, required)


@query("k11_validity", VALIDATION + "," + MISSING + """
    select c.k as dataset_id, false as valid, (select count(*) from f where f.k = c.k) as errors,
           (select count(*) from m where m.k = c.k) as missing,
           2 - (c.k % 3 = 0)::bigint as filled_required, 4 as total_required, 1 as filled_optional, 2 as total_optional
    from c""")
def k11(t):
    values = customer_record(t)
    datasets = t.customer.select(F.col("c_custkey").alias("dataset_id"))
    findings = written(R.validate(values, rule_table(t), ["title", "hdab"]), "findings")
    fields = field_rows(t)
    missing = R.missing_required(datasets, values, findings, fields.where("required").select("ord", "field"))
    return R.validity(datasets, values, findings, missing, fields)


@query("k12_block_missing", """
    select c_custkey as dataset_id, 1 as ord, 'title' as missing from customer where c_custkey % 3 = 0
    union all select c_custkey, 3, 'license' from customer""")
def k12(t):
    block = t.spark.createDataFrame([(1, "title"), (2, "hdab"), (3, "license"), (4, "applicable_legislation")], "ord int, field string")
    return R.block_missing(t.customer.select(F.col("c_custkey").alias("dataset_id")), customer_record(t), block, rule_table(t))


@query("k13_missing_help", """
    select c_custkey as dataset_id, 'keyword' as field, 'Palabras' as label, c_custkey % 2 = 0 as required from customer
    union all select c_custkey, 'title_en', 'Título', true from customer
    union all select c_custkey, 'zz' || c_mktsegment, 'zz' || c_mktsegment, false from customer""")
def k13(t):
    key = F.col("c_custkey").alias("dataset_id")
    missing = t.customer.select(key, F.explode(F.array(
        F.lit("keyword"), F.lit("title_en"), F.concat(F.lit("zz"), "c_mktsegment"), F.lit("applicable_legislation")
    )).alias("field"))
    guide = t.spark.createDataFrame(
        [(1, "title", "Título", True), (2, "keyword", "Palabras", False)], "ord int, name string, label string, required boolean"
    )
    return R.missing_help(missing, guide, t.customer.where("c_custkey % 2 = 0").select(key))


@query("k14_output_regressions", """
    select c_custkey as dataset_id, 'title' as field, 'empty' as verdict from customer where c_custkey % 3 = 0
    union all select c_custkey, 'tags', 'wrong type' from customer where c_custkey % 10 = 0
    union all select c_custkey, 'license', 'missing' from customer
    union all select c_custkey, 'hdab', 'wrong type' from customer where c_custkey % 9 = 0""")
def k14(t):
    expected = t.spark.createDataFrame(
        [(1, "title", '"T"'), (2, "tags", '["a"]'), (3, "license", "{}"), (4, "hdab", '{"email":"x"}')], "ord int, field string, value string"
    )
    return R.output_regressions(customer_record(t), expected, ["title"])


@query("k15_group_missing", """
    select c_custkey as dataset_id, 'hdab' as parent, 'email|page' as parts, 1 as simple_first from customer
    union all select c_custkey, 'title', '', 0 from customer""")
def k15(t):
    rows = t.customer.select(F.col("c_custkey").alias("dataset_id"), F.explode(F.array(F.lit("hdab.page"), F.lit("title"), F.lit("hdab.email"))).alias("field"))
    return R.group_missing(rows).withColumn("parts", F.concat_ws("|", "parts"))


# ── triples ──────────────────────────────────────────────────────────────────

def customer_dataset(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey",
        F.concat(F.lit("http://id/"), F.col("c_custkey")).alias("identifier"),
        F.col("c_name").alias("title"),
        F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")).alias("notes"),
        (F.col("c_custkey") % 5).alias("number_of_records"),
        F.array(F.col("n_name"), F.concat(F.lit("http://s/"), "n_name"), F.col("n_name")).alias("spatial"),
        F.split("c_name", "#").alias("keyword"),
        F.struct(F.lit("2020-01-01").alias("start"), F.lit(None).cast("string").alias("end")).alias("temporal_coverage"),
        F.struct(F.col("n_name").alias("name"), F.lit("x@y.z").alias("email")).alias("publisher"),
        F.array(F.struct(F.concat(F.lit("http://a/"), F.col("c_custkey")).alias("access_url"))).alias("distribution"),
    )


TRIPLES = """
    c as (select 'http://id/' || c_custkey::varchar as s, * from customer join nation on n_nationkey = c_nationkey),
    n as (select *, '_:b' || md5(s || '|period') as period, '_:b' || md5(s || '|publisher') as org, '_:b' || md5(s || '|distribution|0') as dist from c),
    tr as (
      select s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' as p, 'http://www.w3.org/ns/dcat#Dataset' as o, 'uri' as o_kind, null as lang, null as datatype from n
      union all select s, 'http://purl.org/dc/terms/identifier', s, 'uri', null, null from n
      union all select s, 'http://purl.org/dc/terms/title', c_name, 'literal', 'es', null from n
      union all select s, 'http://purl.org/dc/terms/description', c_mktsegment, 'literal', 'es', null from n where c_custkey % 2 = 1
      union all select s, 'https://healthdcat-ap.eu/ns#numberOfRecords', (c_custkey % 5)::varchar, 'literal', null, null from n
      union all select s, 'http://purl.org/dc/terms/spatial', n_name, 'literal', null, null from n
      union all select s, 'http://purl.org/dc/terms/spatial', 'http://s/' || n_name, 'uri', null, null from n
      union all select s, 'http://www.w3.org/ns/dcat#keyword', unnest(string_split(c_name, '#')), 'literal', 'es', null from n
      union all select s, 'http://purl.org/dc/terms/temporal', period, 'blank', null, null from n
      union all select period, 'http://www.w3.org/ns/dcat#startDate', '2020-01-01', 'literal', null, 'http://www.w3.org/2001/XMLSchema#date' from n
      union all select s, 'http://purl.org/dc/terms/publisher', org, 'blank', null, null from n
      union all select org, 'http://xmlns.com/foaf/0.1/name', n_name, 'literal', null, null from n
      union all select org, 'http://www.w3.org/2006/vcard/ns#hasEmail', 'mailto:x@y.z', 'uri', null, null from n
      union all select s, 'http://www.w3.org/ns/dcat#distribution', dist, 'blank', null, null from n
      union all select dist, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://www.w3.org/ns/dcat#Distribution', 'uri', null, null from n
      union all select dist, 'http://www.w3.org/ns/dcat#accessURL', 'http://a/' || c_custkey::varchar, 'uri', null, null from n)
"""


@query("m1_m4_triples", "with" + TRIPLES + "select * from tr")
def m1(t):
    return X.record_triples(customer_dataset(t), "c_custkey")


@query("m5_triples_to_fields", "with" + TRIPLES + """,
    pm as (select * from (values ('http://purl.org/dc/terms/identifier', 'identifier'), ('http://purl.org/dc/terms/title', 'title'),
      ('http://purl.org/dc/terms/description', 'notes'), ('https://healthdcat-ap.eu/ns#numberOfRecords', 'number_of_records'),
      ('http://purl.org/dc/terms/spatial', 'spatial'), ('http://www.w3.org/ns/dcat#keyword', 'keyword'),
      ('http://purl.org/dc/terms/temporal', 'temporal_coverage'), ('http://purl.org/dc/terms/publisher', 'publisher')) v(p, field))
    select s, field, o as value from tr join pm using (p)""")
def m5(t):
    return X.triples_to_fields(X.record_triples(customer_dataset(t), "c_custkey"))


@query("m6_dataset_uri", """
    select page_id, case when page_id % 3 = 0 then 'http://i/' || page_id::varchar when page_id % 3 = 1 then url
        else 'https://catalogue.example.org/dataset/' || page_id::varchar end as uri from pages""")
def m6(t):
    k = F.col("page_id")
    df = t.pages.select(
        "page_id", F.when(k % 3 == 0, F.concat(F.lit("http://i/"), k)).alias("identifier"),
        F.when(k % 3 == 2, "").otherwise(F.col("url")).alias("url"),
    )
    return df.select("page_id", X.dataset_uri(df, "page_id").alias("uri"))


@query("m7_ntriples_text", "with" + TRIPLES + r"""
    select case when starts_with(s, '_:') then s else '<' || s || '>' end || ' <' || p || '> ' ||
           case o_kind when 'blank' then o when 'uri' then '<' || o || '>' else '"' || o || '"' ||
             case when lang is not null then '@' || lang when datatype is not null then '^^<' || datatype || '>' else '' end end || ' .' as value
    from tr""")
def m7(t):
    return X.ntriples(X.record_triples(customer_dataset(t), "c_custkey"))


@query("m7_ntriples_round_trip", """
    select doc_id, 'http://d/' || doc_id::varchar as s, md5(text) as digest, 'literal' as o_kind, lang from documents""")
def m7_back(t):
    s = F.concat(F.lit("http://d/"), F.col("doc_id"))
    rows = spread(t.documents).select(F.inline(F.array(X.triple(s, X.DCT + "description", F.col("text"), "literal", F.col("lang")))))
    back = X.parse_ntriples(X.ntriples(rows))
    return back.select(
        F.regexp_extract("s", r"(\d+)$", 1).cast("bigint").alias("doc_id"), "s", F.md5("o").alias("digest"), "o_kind", "lang"
    )


# ── answers ──────────────────────────────────────────────────────────────────

@query("n1_strip_fences", r"""
    select conv_id, turn, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) as body from conversations""")
def n1(t):
    fence = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" ```json\n"), "text", F.lit("\n``` trailing"))).otherwise(
        F.concat(F.lit("```\n"), "text", F.lit("```"))
    )
    return t.conversations.select("conv_id", "turn", F.md5(N.strip_fences(fence)).alias("body"))


@query("n2_repair_escapes", r"""
    select event_id, props::json->>'k' as k, 'C:\path\new "q" ' || event_type as name from events""")
def n2(t):
    raw = F.concat(
        F.lit('{"name":"C:\\path\\\\new \\"q\\" '), "event_type", F.lit('",'), F.substring("props", F.lit(2), F.length("props"))
    )
    doc = F.try_parse_json(N.repair_escapes(raw))
    return t.events.select(
        "event_id", F.try_variant_get(doc, "$.k", "string").alias("k"), F.try_variant_get(doc, "$.name", "string").alias("name")
    )


@query("n3_metadata_answers", """
    select p_partkey as dataset_id, p_name as title, p_type as notes, replace(p_name, ' ', '|') as keyword,
           p_brand as purpose, '' as language, case when p_size % 4 = 0 then 'Could not parse LLM response' else 'none' end as errors
    from part where p_size % 4 <> 0
    union all select p_partkey, '', '', '', '', '', 'Could not parse LLM response' from part where p_size % 4 = 0""")
def n3(t):
    good = F.concat(
        F.lit('```json\n{"title":" '), "p_name", F.lit('","notes":"'), "p_type", F.lit('","keyword":"'),
        F.replace(F.col("p_name"), F.lit(" "), F.lit(" ; ")), F.lit('","purpose":["'), "p_brand",
        F.lit('","",null],"language":7,"errors":"none"}\n```'),
    )
    raw = F.when(F.col("p_size") % 4 == 0, "sorry").otherwise(good)
    out = N.metadata_answers(t.part.select(F.col("p_partkey").alias("dataset_id"), raw.alias("raw")))
    return out.select(
        "dataset_id", "title", "notes", *[F.concat_ws("|", c).alias(c) for c in ("keyword", "purpose", "language", "errors")]
    )


@query("n4_open_answers", """
    select p_partkey as dataset_id, p_name as raw from part where p_size % 3 <> 0""")
def n4(t):
    key = F.col("p_partkey").alias("dataset_id")
    fields = F.array(*[F.lit(f) for f in N.METADATA_FIELDS])
    all_but_one = F.when(F.col("p_size") % 3 == 0, fields).otherwise(F.slice(fields, 2, 20))
    given = spread(t.part).select(key, F.explode(all_but_one).alias("field")).withColumn("value", F.lit('"x"'))
    return N.open_answers(t.part.select(key, F.col("p_name").alias("raw")), given)


@query("n5_value_mappings", """
    select c_custkey as dataset_id, case c_custkey % 4 when 0 then 'c_name:split+strip' when 1 then 'c_acctbal:'
        when 2 then 'a,b:strip' else '' end as mappings from customer""")
def n5(t):
    k = F.col("c_custkey") % 4
    raw = (
        F.when(k == 0, '[{"columns":["c_name"],"transform":[{"op":"split","params":{"sep":"#"}},{"x":1},{"op":"strip"}]},5]')
        .when(k == 1, '["c_acctbal"]').when(k == 2, '{"columns":["a","b"],"transform":{"op":"strip"}}').otherwise("null")
    )
    m = N.value_mappings(F.try_parse_json(raw))
    text = F.transform(m, lambda e: F.concat(
        F.concat_ws(",", e["columns"]), F.lit(":"), F.concat_ws("+", F.transform(e["transform"], lambda s: s["op"]))
    ))
    return t.customer.select(F.col("c_custkey").alias("dataset_id"), F.concat_ws(";", text).alias("mappings"))


@query("n6_date_mappings", """
    select c_custkey as dataset_id, case c_custkey % 4 when 0 then 'y/m.strip/-' when 1 then 'd/-/-;-/-/x' when 2 then 'first/-/-' else '' end as mappings
    from customer""")
def n6(t):
    k = F.col("c_custkey") % 4
    raw = (
        F.when(k == 0, '{"year":"y","month":{"column":"m","transform":[{"op":"strip"}]},"day":null}')
        .when(k == 1, '[{"year":{"column":"d"}},{"year":null},"skip",{"day":"x"}]')
        .when(k == 2, '[{"year":{"columns":["first","second"]}}]').otherwise("[]")
    )

    def part(p):
        ops = F.concat_ws("+", F.transform(p["transform"], lambda s: s["op"]))
        return F.coalesce(F.concat(p["column"], F.when(ops != "", F.concat(F.lit("."), ops)).otherwise("")), F.lit("-"))

    m = N.date_mappings(F.try_parse_json(raw))
    text = F.transform(m, lambda e: F.concat_ws("/", part(e["year"]), part(e["month"]), part(e["day"])))
    return t.customer.select(F.col("c_custkey").alias("dataset_id"), F.concat_ws(";", text).alias("mappings"))


@query("n7_answer_codes", """
    select c_custkey, case c_custkey % 3 when 0 then 'NATION_' || c_nationkey::varchar when 1 then 'A|B' else '' end as codes from customer""")
def n7(t):
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("`NATION_"), "c_nationkey", F.lit("`"))).when(k == 1, '["A", "B"]').otherwise(" NONE ")
    return t.customer.select("c_custkey", F.concat_ws("|", N.answer_codes(raw)).alias("codes"))


@query("n8_json_in_text", """
    select event_id, case when event_id % 3 = 2 then null else props::json->>'k' end as k from events""")
def n8(t):
    m = F.col("event_id") % 3
    raw = F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit("Sure:\n"), "props", F.lit("\nDone."))).otherwise("no {json")
    return t.events.select("event_id", F.try_variant_get(N.json_in_text(raw), "$.k", "string").alias("k"))


def registry(t):
    raw = t.spark.createDataFrame(
        [
            ("Nation", " http://v.org/n/ ", " coding_system", "LLM", "1", "false"),
            ("Regions", "http://v.org/r", "health_theme", "llm ", "3", " TRUE"),
            ("Kind", "http://v.org/k", "dcat_type", "LLM", "x", None),
            ("Personal", "http://v.org/p", "personal_data", "rag", "3", "true"),
            ("Spatial", "Multiple", "spatial", "LLM", "5", "true"),
        ],
        "`Name` string, ` URL` string, ` Feature` string, ` Metadata-Processed-By` string, `top-n` string, ` multiple_output` string",
    )
    return N.registry_rows(raw)


@query("v1_registry_defaults", """
    select c_custkey as dataset_id, feature, route, top_n, value from customer,
      (values ('coding_system', 'codes', 1, 'null'), ('health_theme', 'codes', 3, '[]'), ('dcat_type', 'codes', 1, '""'),
              ('personal_data', 'similarity', 3, '[]'), ('spatial', 'spatial', 5, '[]')) r(feature, route, top_n, value)""")
def v1(t):
    rows = registry(t).select("feature", "route", "top_n", N.default_value(F.col("feature"), F.col("multiple")).alias("value"))
    packed = rows.agg(F.collect_list(F.struct("feature", "route", "top_n", "value")).alias("r")).scalar()
    return t.customer.select(F.col("c_custkey").alias("dataset_id"), F.inline(packed))


@query("v2_prefilled_feature", """
    select c_custkey as dataset_id, case c_custkey % 3 when 0 then '["a"]' when 1 then '["x","y"]' else '[]' end as listed,
           case c_custkey % 3 when 0 then '"a"' when 1 then '"x"' else 'null' end as single,
           case c_custkey % 3 when 0 then '["a"]' when 1 then '["own"]' else '[]' end as code_values
    from customer""")
def v2(t):
    k = F.col("c_custkey") % 3
    value = F.when(k == 0, '"a"').when(k == 1, '["x","y"]').otherwise('" "')
    label = F.when(k == 0, F.lit('"http://v.org/n/a"')).when(k == 1, '{"uri":"u","label":"z"}')
    own = F.when(k == 1, '["own"]')
    feature = F.lit("coding_system")
    return t.customer.select(
        F.col("c_custkey").alias("dataset_id"),
        N.prefilled_feature(value, feature, F.lit(True)).alias("listed"),
        N.prefilled_feature(value, feature, F.lit(False)).alias("single"),
        N.derived_code_values(label, own).alias("code_values"),
    )


def code_answers(t):
    k = F.col("c_custkey") % 4
    nation = F.concat(F.lit("NATION_"), F.col("c_nationkey"))
    single = F.when(k == 0, F.concat(F.lit("`"), nation, F.lit("`"))).when(k == 1, "NONE").when(k == 2, "Q9").otherwise(F.concat(nation, F.lit("\n")))
    many = F.when(k == 0, '["ASIA", "LUNA", "EUROPE"]').when(k == 1, "[]").when(k == 2, "ASIA").otherwise('["AFRICA"]')
    return t.customer.select(F.col("c_custkey").alias("dataset_id"), F.inline(F.array(
        F.struct(F.lit("coding_system").alias("feature"), single.alias("raw")),
        F.struct(F.lit("health_theme").alias("feature"), many.alias("raw")),
    )))


def code_vocab(t):
    return t.nation.select(F.lit("coding_system").alias("feature"), F.col("n_name").alias("code")).unionByName(
        t.region.select(F.lit("health_theme").alias("feature"), F.col("r_name").alias("code"))
    )


@query("v3_match_codes", """
    select c_custkey as dataset_id, 'coding_system' as feature,
           case when c_custkey % 4 in (0, 3) then '{"uri":"http://v.org/n/NATION_' || c_nationkey::varchar || '","label":"NATION_' || c_nationkey::varchar || '"}'
                else 'null' end as value,
           case when c_custkey % 4 = 2 then 'Q9' else '' end as unknown,
           case when c_custkey % 4 in (0, 3) then 'NATION_' || c_nationkey::varchar else '' end as code_values
    from customer
    union all
    select c_custkey, 'health_theme', case c_custkey % 4 when 0 then '["http://v.org/r/ASIA","http://v.org/r/EUROPE"]'
           when 3 then '["http://v.org/r/AFRICA"]' else '[]' end, case when c_custkey % 4 = 0 then 'LUNA' else '' end, ''
    from customer""")
def v3(t):
    out = N.match_codes(code_answers(t), registry(t), code_vocab(t))
    return out.select("dataset_id", "feature", "value", F.concat_ws("|", "unknown").alias("unknown"), F.concat_ws("|", "code_values").alias("code_values"))


@query("v3_code_errors", """
    select c_custkey as dataset_id, 'coding_system: LLM returned unknown code ''Q9''' as error from customer where c_custkey % 4 = 2
    union all select c_custkey, 'health_theme: LLM returned unknown codes [''LUNA'']' from customer where c_custkey % 4 = 0""")
def v3_errors(t):
    return N.code_errors(N.match_codes(code_answers(t), registry(t), code_vocab(t)))


# ── usage ────────────────────────────────────────────────────────────────────

def calls(t):
    return t.events.select(F.col("user_id").alias("session_id"), "ts", F.when(F.col("event_type") != "error", F.col("event_id") % 100).alias("total_tokens"))


@query("o1_call_cost", """
    select event_id, round(user_id / 1e6 * 0.35 + event_id / 1e6 * 0.62, 9) as cost from events""")
def o1(t):
    return t.events.select("event_id", F.round(U.call_cost(F.col("user_id"), F.col("event_id")), 9).alias("cost"))


@query("o2_estimated_tokens", """
    select conv_id, turn, case when turn % 2 = 0 then turn else length(text) // 4 end as tokens from conversations""")
def o2(t):
    return t.conversations.select(
        "conv_id", "turn", U.estimated_tokens(F.when(F.col("turn") % 2 == 0, F.col("turn")), F.col("text")).alias("tokens")
    )


BUDGET = """
    with c as (select user_id as session_id, cast(ts as date) as day, case when event_type <> 'error' then event_id % 100 end as tokens from events)
    select case when grouping(session_id) = 1 then 'day' else 'session' end as level, session_id, day,
           coalesce(sum(tokens), 0)::bigint as tokens,
           coalesce(sum(tokens), 0) >= case when grouping(session_id) = 1 then 16000 else 300 end as exceeded
    from c {where} group by grouping sets ((session_id, day), (day))"""


@query("g9_budget_sets", BUDGET.format(where=""))
def g9(t):
    return U.budget(calls(t), 300, 16000)


@query("o3_budget_today", BUDGET.format(where="where day = date '2024-01-10'"))
def o3(t):
    return U.budget_today(calls(t), "2024-01-10", session_limit=300, day_limit=16000)


@query("g10_active_sessions", "select count(distinct user_id) as active_sessions from events")
def g10(t):
    return U.active_sessions(calls(t))


# ── whole records ────────────────────────────────────────────────────────────

@query("l0_whole_record", """
    with s as (select 'orders' as dataset_id, count(*) as n, count(distinct o_custkey) as u, min(o_totalprice) as lo, max(o_totalprice) as hi,
               strftime(min(o_orderdate), '%Y-%m-%d') as a, strftime(max(o_orderdate), '%Y-%m-%d') as b from orders
               union all select 'lineitem', count(*), count(distinct l_partkey), min(l_quantity), max(l_quantity),
               strftime(min(l_shipdate), '%Y-%m-%d'), strftime(max(l_shipdate), '%Y-%m-%d') from lineitem),
    f as (
      select dataset_id, 'number_of_records' as field, n::varchar as value from s
      union all select dataset_id, 'number_of_unique_individuals', u::varchar from s
      union all select dataset_id, 'min_typical_age', case when lo = floor(lo) then lo::bigint::varchar else lo::varchar end from s
      union all select dataset_id, 'max_typical_age', case when hi = floor(hi) then hi::bigint::varchar else hi::varchar end from s
      union all select dataset_id, 'temporal_coverage', '{"start":"' || a || '","end":"' || b || '"}' from s
      union all select dataset_id, 'issued', '"2024-01-02T03:04:05.006Z"' from s
      union all select dataset_id, 'modified', '"2024-01-02T03:04:05.006Z"' from s
      union all select dataset_id, 'theme', '["http://publications.europa.eu/resource/authority/data-theme/HEAL"]' from s
      union all select dataset_id, 'legal_basis', '{"description":"RGPD","source":"https://www.boe.es/doue/2016/119/L00001-00088.pdf"}' from s
      union all select dataset_id, 'applicable_legislation', '[{"uri":"http://data.europa.eu/eli/reg/2016/679/oj","label":"GDPR"},{"uri":"http://data.europa.eu/eli/reg/2025/327/oj","label":"Reglamento EHDS"}]' from s
      union all select dataset_id, 'version', case dataset_id when 'orders' then '"3.0"' else '"1.0"' end from s
      union all select dataset_id, 'has_version', case dataset_id when 'orders' then '["1.0","2.0","3.0"]' else '["1.0"]' end from s
      union all select dataset_id, 'title', '"T ' || dataset_id || '"' from s
      union all select dataset_id, 'name', '"T ' || dataset_id || '"' from s
      union all select dataset_id, 'language', '["http://publications.europa.eu/resource/authority/language/SPA"]' from s
      union all select dataset_id, 'keyword', case dataset_id when 'orders' then '["x","y"]' else '["k"]' end from s)
    select * from f""")
def l0(t):
    """Records of two datasets: statistics, defaults, answers and overrides merged."""
    from .. import catalogue as C
    from .profiling import LINEITEM, ORDERS

    stats = None
    for name, structure in (("orders", ORDERS), ("lineitem", LINEITEM)):
        part = C.statistics(t.spark, name, t.path(name), structure)
        stats = part if stats is None else stats.unionByName(part)
    # Named here, not taken from the statistics: those are scans and must run once.
    datasets = t.spark.createDataFrame([("orders",), ("lineitem",)], "dataset_id string")

    def fields(rows, **values):
        pairs = [F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in values.items()]
        return rows.select("dataset_id", F.inline(F.array(*pairs)))

    answers = fields(
        datasets, title=F.concat(F.lit('"T '), "dataset_id", F.lit('"')), title_en_tmpt=F.lit('"E"'),
        language=F.lit('["spa"," "]'), keyword=F.lit('["k"]'),
    )
    overrides = fields(
        datasets.where("dataset_id = 'orders'"), keyword=F.lit('"x; y"'), version=F.lit('"2"'),
        has_version=F.lit('["2.0","1.0"]'), name=F.lit('""'),
    )
    return C.assemble(datasets, stats, "2024-01-02T03:04:05.006Z", answers=answers, overrides=overrides)


@query("l1_normalize_arrays", """
    select o_orderkey as dataset_id, 'keyword' as field, case o_custkey % 3 when 0 then '["a","b"]' when 1 then '["a"]' else '[]' end as value from orders
    union all select o_orderkey, 'purpose', case o_custkey % 3 when 0 then '["a; b"]' when 1 then '["a"]' else '[]' end from orders
    union all select o_orderkey, 'title', case o_custkey % 3 when 0 then '"a; b"' when 1 then '["a"]' else 'null' end from orders""")
def l1_arrays(t):
    m = F.col("o_custkey") % 3
    v = F.when(m == 0, '"a; b"').when(m == 1, '["a"]').otherwise("null")
    return A.normalize_arrays(order_fields(t, ("keyword", v), ("purpose", v), ("title", v)))


@query("h13_rule_join", """
    select c_custkey as dataset_id, f.field, f.type, f.required from customer,
      (values ('title', 'text', true), ('name', 'slug', false), ('tags', 'list', false), ('mail', 'email', false), ('site', 'url', false),
              ('hdab', 'list_object', true)) f(field, type, required)""")
def h13(t):
    rules = rule_table(t).select("field", "type", "required")
    return R.with_rules(customer_record(t), rules).select("dataset_id", "field", "type", "required")


@query("e8_iso_millis", """
    select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((microsecond(ts) % 1000000 // 1000)::varchar, 3, '0') || 'Z' as stamp from events""")
def e8(t):
    from ..functions.dates import iso_millis

    return t.events.select("event_id", iso_millis(F.col("ts")).alias("stamp"))
