"""The registered queries of the training-data operators; each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    benchmark, centroids, chunked_bpe, filter_audit, licenses, near, packing, page_text, quality_model, quality_rules, secret_scan,
    suffixes, templates,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op3_near_duplicates")
def op3(spark, sf_dir):
    """Near-duplicate classes of the documents on 4-word shingles at 0.8."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near.near_duplicates(spark, docs, k=4, percent=80)


@query("op5_decontaminate", r"""
    with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') as w from documents),
    b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') as w from benchmark),
    bw as (select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as win
           from (select item_id, w, least(10, len(w)) as size, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)),
    sizes as (select distinct size from bw),
    dw as (select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as win
           from (select doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) as i from d, sizes where len(w) >= size)),
    hit as (select distinct dw.doc_id, dw.i, dw.size, bw.item_id from dw join bw using (win, size)),
    pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + size - 1)) as p from hit) group by doc_id),
    items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from hit) group by doc_id)
    select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
           sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join pos using (doc_id) left join items using (doc_id)""")
def op5(spark, sf_dir):
    """Documents with the words and items of the benchmark windows that occur in them."""
    found = benchmark.scan_items(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op6_pack")
def op6(spark, sf_dir):
    """All documents packed into sequences of 4096 ids in the source mixture of the corpus."""
    return packing.pack(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query("op7_line_templates")
def op7(spark, sf_dir):
    """Documents without the lines of recurring templates, whatever their share."""
    found = templates.drop_recurring_lines(spark, table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "n_lines", "n_dropped", F.col("left_over").alias("text"))


@query("op8_quality_model")
def op8(spark, sf_dir):
    """Quality of every document by a factorisation machine learnt from the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality_model.train(spark, docs, table(spark, sf_dir, "labels"))
    scored = quality_model.score(docs, machine, keep=["doc_id"])
    return scored.select(
        "row.doc_id", quality_model.held_out(F.col("row.doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query("op1_quality_rules", r"""
    with t as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    win as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as k from (select doc_id, w, unnest(generate_series(1, len(w) - 4)) as i from t)),
    twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, k) as c from win) where c > 1),
    rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(generate_series(i, i + 4)) as p from twice) group by doc_id),
    line as (select doc_id, count(*) - count(distinct l) as dup, count(*) as n
             from (select doc_id, unnest(string_split(text, chr(10))) as l from t) where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
    base as (select t.doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(line.dup, 0)::bigint as n_dup_lines,
             coalesce(line.n, 0)::bigint as n_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
             (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')))::bigint as n_upper
             from t left join line using (doc_id) left join rep using (doc_id)),
    metric as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
               case when word_chars > 0 then n_symbols * 1000000 // word_chars else 0 end as symbol_ppm,
               case when n_words > 0 then n_repeat_words * 1000000 // n_words else 0 end as repeat_ppm,
               case when word_chars > 0 then n_upper * 1000000 // word_chars else 0 end as upper_ppm,
               case when n_lines > 0 then n_dup_lines * 1000000 // n_lines else 0 end as dup_line_ppm,
               case when n_words > 0 then word_chars * 1000 // n_words else 0 end as word_milli from base),
    long_ as (select doc_id, lang, source, unnest([{'r': 'symbol_ppm', 'v': symbol_ppm}, {'r': 'repeat_ppm', 'v': repeat_ppm}, {'r': 'upper_ppm', 'v': upper_ppm},
              {'r': 'dup_line_ppm', 'v': dup_line_ppm}, {'r': 'word_milli', 'v': word_milli}]) as m, base_failed from metric),
    b as (select lang, source, m.r as r, m.v - m.v % (1::bigint << greatest(length(bin(m.v)) - 7, 0)) as b from long_ where not base_failed),
    q1 as (select lang, source, r, count(*) as n, quantile_disc(b, 0.25) as lo, quantile_disc(b, 0.75) as hi from b group by all),
    q2 as (select lang, r, count(*) as n, quantile_disc(b, 0.25) as lo, quantile_disc(b, 0.75) as hi from b group by all),
    q3 as (select r, quantile_disc(b, 0.25) as lo, quantile_disc(b, 0.75) as hi from b group by all),
    q as (select q1.lang, q1.source, q1.r, case when q1.n >= 200 then q1.lo when q2.n >= 200 then q2.lo else q3.lo end as lo,
          case when q1.n >= 200 then q1.hi when q2.n >= 200 then q2.hi else q3.hi end as hi
          from q1 join q2 on q1.lang is not distinct from q2.lang and q1.r = q2.r join q3 on q1.r = q3.r),
    f as (select *, hi + 4 * (hi - lo) + case r when 'symbol_ppm' then 30000 when 'repeat_ppm' then 150000 when 'dup_line_ppm' then 300000 when 'word_milli' then 1500 else 100000 end as top,
          case r when 'word_milli' then lo - 4 * (hi - lo) - 1500 else -1 end as bottom from q),
    judged as (select doc_id, bool_and(coalesce(m.v between bottom and top, false)) as inside
               from long_ left join f on long_.lang is not distinct from f.lang and long_.source is not distinct from f.source and m.r = f.r group by doc_id)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and inside as kept
    from metric join judged using (doc_id)""")
def op1(spark, sf_dir):
    """Quality statistics of every document and the verdict of the adaptive rules."""
    found = quality_rules.quality_rules(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op2_license_scan", f"""
    with t as (select doc_id, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || (doc_id // 1024) || '/' || (doc_id // 64 % 16) as home,
                      coalesce(source, '') || '/' || coalesce(lang, '') || '/' || (doc_id // 1024) as above, coalesce(text, '') as text from documents),
    f as (select doc_id, text, case when doc_id % 1024 = 1 then above else home end as dir, doc_id % 64 = 0 or doc_id % 1024 = 1 as is_license from t),
    seg as (select doc_id, l as segment from (select doc_id, unnest(string_split(text, chr(10))) as l from f) where regexp_matches(lower(l), '{licenses.MARKERS}')),
    segs as (select segment, count(*) as n from seg group by segment),
    tpl as (select * from (values {", ".join(f"('{k}', '{v}')" for k, v in licenses.TEMPLATES)}) as v(license, notice)),
    sw as (select segment, n, unnest(regexp_extract_all(lower(segment), '{licenses.TERM}')) as term from segs),
    tw as (select license, notice, unnest(regexp_extract_all(lower(notice), '{licenses.TERM}')) as term from tpl),
    stf as (select segment, any_value(n) as n, term, count(*) as tf from sw group by segment, term),
    ttf as (select license, notice, term, count(*) as tf from tw group by all),
    df as (select term, sum(n) as df from (select term, n from stf union all select term, 1 from ttf) group by term),
    total as (select (select coalesce(sum(n), 0) from segs) + (select count(*) from tpl) as n),
    idf as (select term, ln((total.n + 1.0) / (df + 1.0)) + 1 as idf from df, total),
    sv as (select segment, term, (1 + ln(tf)) * idf as w from stf join idf using (term)),
    tv as (select license, notice, term, (1 + ln(tf)) * idf as w from ttf join idf using (term)),
    sn as (select segment, sqrt(sum(w * w)) as norm from sv group by segment),
    tn as (select license, notice, sqrt(sum(w * w)) as norm from tv group by all),
    cosine as (select segment, license, notice, round(sum(sv.w * tv.w) / any_value(sn.norm) / any_value(tn.norm), 6) as c
               from sv join tv using (term) join sn using (segment) join tn using (license, notice) group by segment, license, notice),
    best as (select segment, license, c from (select *, row_number() over (partition by segment order by c desc, license) as r from cosine where c >= {licenses.LEAST}) where r = 1),
    own as (select doc_id, max(c) as own_cosine, string_agg(license, ' AND ' order by license) as own_license
            from (select doc_id, license, max(c) as c from seg join best using (segment) group by doc_id, license) group by doc_id),
    dirs as (select dir, string_agg(own_license, ' AND ' order by own_license) as license from (select distinct dir, own_license from f join own using (doc_id) where is_license) group by dir),
    up as (select doc_id, dir || '/' as p, unnest(generate_series(0, length(dir) - 1)) as i from f),
    anc as (select doc_id, substr(p, 1, i + 1) as a, substr(p, i + 2, 1) as nxt, i from up),
    near as (select doc_id, dirs.dir as from_dir, dirs.license as inherited, row_number() over (partition by doc_id order by i desc) as r from anc join dirs on anc.a = dirs.dir where nxt = '/')
    select f.doc_id, own_license, own_cosine, near.inherited as inherited_license, near.from_dir, coalesce(own_license, near.inherited) as license
    from f left join own using (doc_id) left join near on near.doc_id = f.doc_id and near.r = 1""")
def op2(spark, sf_dir):
    """Licence of every document: its own notices, else that of the nearest directory above.

    The tables have no paths, so a layout is derived from the documents' own columns:
    source/lang/block of 1024 ids/block of 64 ids. The first document of a block of 64
    stands for the licence file of its folder, the second of 1024 for that of the folder above.
    """
    docs = table(spark, sf_dir, "documents")
    home = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.expr("doc_id div 1024"))
    name = F.when((F.col("doc_id") % 64 == 0) | (F.col("doc_id") % 1024 == 1), F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    folder = F.when(F.col("doc_id") % 1024 == 1, home).otherwise(F.concat_ws("/", home, F.expr("doc_id div 64 % 16")))
    found = licenses.license_scan(spark, docs.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text"), key="doc_id")
    return found.select("doc_id", "own_license", "own_cosine", "inherited_license", "from_dir", "license")


@query("op4_secret_scan")
def op4(spark, sf_dir):
    """Secrets in every document: pattern spans and the spans of the Markov models."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.secrets(docs, secret_scan.train(spark, docs), keep=["doc_id"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("row.doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op9_repeated_runs")
def op9(spark, sf_dir):
    """Documents without the bytes of 50-byte strings that a smaller document has too."""
    found = suffixes.repeated_runs(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op10_page_text")
def op10(spark, sf_dir):
    """Main text of every page."""
    found = page_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", F.col("main").alias("text"), F.length("main").cast("long").alias("n_chars"))


def _cluster_sql() -> str:
    """The rounds of op11 in SQL: one assignment and one move after the other."""
    parts = ["""
    with kept as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
                  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
    e as (select vec_id, unnest(v) as x, unnest(range(64)) as i from kept),
    start as (select (row_number() over (order by sha256('1:' || vec_id::varchar)) - 1)::int as c, vec_id from kept qualify c < 16),
    c0 as (select c, i, x from start join e using (vec_id))"""]
    for n in range(4):
        parts.append(f"""
    a{n} as (select vec_id, c as cluster, d from (select vec_id, c, sum((e.x - c{n}.x) * (e.x - c{n}.x))::bigint as d from e join c{n} using (i) group by vec_id, c)
             qualify row_number() over (partition by vec_id order by d, c) = 1)""")
        if n < 3:
            parts.append(f"""
    m{n} as (select cluster as c, i, sum(x)::bigint as s, count(*) as n from a{n} join e using (vec_id) group by cluster, i),
    c{n + 1} as (select c, i, case when n is null then x else (s - (s % n + n) % n) // n end as x from c{n} left join m{n} using (c, i))""")
    return ",".join(parts) + """,
    t as (select cluster, sum(d)::bigint as cluster_inertia from a3 group by cluster),
    h as (select c as cluster, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from c3 group by c)
    select vec_id, cluster::int as cluster, d as distance, cluster_inertia, (select sum(d)::bigint from a3) as inertia, centroid_sha256
    from a3 join t using (cluster) join h using (cluster)"""


@query("op11_centroid_clusters", _cluster_sql())
def op11(spark, sf_dir):
    """The nearest of 16 centroids for every embedding after three rounds."""
    found = centroids.centroid_clusters(spark, table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query("op12_bpe_codec")
def op12(spark, sf_dir):
    """Ids of every whole text and the text that they decode to, as digests."""
    found = chunked_bpe.encode(table(spark, sf_dir, "documents"), keep=["doc_id"], decoded=True)
    return found.select(
        "row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op13_filter_audit", r"""
    with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    l as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id),
    f as (select part, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic,
                 [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
                  regexp_matches(text, '[#$%&*|]'), doc_id > min(doc_id) over (partition by text)] as fails
          from d left join l using (doc_id)),
    letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
    orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
               where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps as (select filter_order, s::int as step, filter_order[s] as letter, instr('ABCDE', filter_order[s]) as k,
                     [instr('ABCDE', filter_order[j]) for j in range(1, s)] as before from orders, range(1, 6) r(s)),
    c as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by part, fails),
    x as (select part, filter_order, step, letter, n, good, toxic, fails[k] as hit, len(list_filter(before, lambda b: fails[b])) > 0 as gone,
                 fails[k] and len(list_filter(fails, lambda y: y)) = 1 as alone from c, steps),
    g as (select part, filter_order, step, letter, coalesce(sum(n) filter (not hit and not gone), 0)::bigint as kept, coalesce(sum(n) filter (hit and not gone), 0)::bigint as removed,
                 coalesce(sum(n) filter (hit and gone), 0)::bigint as redundant, coalesce(sum(n) filter (alone), 0)::bigint as unique_fails,
                 coalesce(sum(good) filter (hit and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (hit and not gone), 0)::bigint as toxic_lost
          from x group by part, filter_order, step, letter)
    select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) over (partition by part, letter))::bigint as shapley from g""")
def op13(spark, sf_dir):
    """What each of five filters removes at every step of all their orders, per language."""
    return filter_audit.filter_audit(spark, f"{sf_dir.rstrip('/')}/documents.parquet", table(spark, sf_dir, "labels"))
