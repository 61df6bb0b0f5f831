"""Statistics, dates and coverage."""

from pyspark.sql import functions as F

from ..functions import dates
from ..functions.dsl import compile_mapping
from ..operators import profile as P
from ..operators.usage import calls_of_day
from ..session import spread
from .registry import query


def steps(*ops):
    return [{"op": o} if isinstance(o, str) else {"op": o[0], "params": o[1]} for o in ops]


def date_parts(column):
    return {p: {"column": column, "transform": steps(("to_datetime_part", {"part": p}))} for p in ("year", "month", "day")}


LINEITEM = {
    "number_of_unique_individuals": [{"columns": ["l_partkey"], "transform": []}],
    "min_typical_age": [{"columns": ["l_quantity"], "transform": steps("to_string", "to_numeric")}],
    "max_typical_age": [{"columns": ["l_quantity"], "transform": steps("to_string", "to_numeric")}],
    "temporal_coverage": [date_parts("l_shipdate")],
}
ORDERS = {
    "number_of_unique_individuals": [
        {"columns": ["no_such_column"], "transform": []},
        {"columns": ["o_custkey"], "transform": steps("to_string")},
    ],
    "min_typical_age": [
        {"columns": ["o_orderstatus"], "transform": steps("to_numeric")},
        {"columns": ["o_totalprice"], "transform": []},
    ],
    "max_typical_age": [{"columns": ["o_totalprice"], "transform": []}],
    "temporal_coverage": [date_parts("o_orderdate")],
}


@query("g4_profile_lineitem", """
    select count(*) as number_of_records, count(distinct l_partkey) as number_of_unique_individuals,
           min(l_quantity) as min_typical_age, max(l_quantity) as max_typical_age,
           strftime(min(l_shipdate), '%Y-%m-%d') as coverage_start,
           strftime(max(l_shipdate), '%Y-%m-%d') as coverage_end
    from lineitem""")
def g4(t):
    return P.profile(t.lineitem, LINEITEM)


@query("g5_profile_many", """
    select 'lineitem' as dataset, count(*) as number_of_records,
           count(distinct l_partkey) as number_of_unique_individuals,
           min(l_quantity) as min_typical_age, max(l_quantity) as max_typical_age,
           strftime(min(l_shipdate), '%Y-%m-%d') as coverage_start,
           strftime(max(l_shipdate), '%Y-%m-%d') as coverage_end
    from lineitem
    union all
    select 'orders', count(*), count(distinct o_custkey), min(o_totalprice), max(o_totalprice),
           strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d')
    from orders""")
def g5(t):
    return P.profile_many({"lineitem": (t.lineitem, LINEITEM), "orders": (t.orders, ORDERS)})


@query("g5_profile_by_dataset", """
    select l_returnflag as dataset_a, l_linestatus as dataset_b, count(*) as number_of_records,
           count(distinct l_partkey) as number_of_unique_individuals,
           min(l_quantity) as min_typical_age, max(l_quantity) as max_typical_age,
           strftime(min(l_shipdate), '%Y-%m-%d') as coverage_start,
           strftime(max(l_shipdate), '%Y-%m-%d') as coverage_end
    from lineitem group by all""")
def g5_by(t):
    df = t.lineitem.withColumnsRenamed({"l_returnflag": "dataset_a", "l_linestatus": "dataset_b"})
    return P.profile_by(df, ["dataset_a", "dataset_b"], LINEITEM)


@query("g1_record_count", """
    select event_type as dataset, count(*) as number_of_records from events group by 1""")
def g1(t):
    return (
        P.profile_by(t.events.withColumnRenamed("event_type", "dataset"), ["dataset"], {})
        .select("dataset", "number_of_records")
    )


@query("g2_distinct_individuals", """
    select o_orderpriority as dataset, count(distinct o_custkey) as number_of_unique_individuals
    from orders group by 1""")
def g2(t):
    df = t.orders.withColumnRenamed("o_orderpriority", "dataset")
    return P.profile_by(df, ["dataset"], ORDERS).select("dataset", "number_of_unique_individuals")


@query("g3_numeric_extremes", """
    select c_mktsegment as dataset, min(c_acctbal) as min_typical_age, max(c_acctbal) as max_typical_age
    from customer group by 1""")
def g3(t):
    structure = {
        f"{how}_typical_age": [
            {"columns": ["c_name"], "transform": steps("to_numeric")},
            {"columns": ["c_acctbal"], "transform": []},
        ]
        for how in ("min", "max")
    }
    df = t.customer.withColumnRenamed("c_mktsegment", "dataset")
    return P.profile_by(df, ["dataset"], structure).select("dataset", "min_typical_age", "max_typical_age")


@query("l7_profile_prefilled", """
    select 7 as number_of_records, 3 as number_of_unique_individuals,
           min(l_quantity) as min_typical_age, 120.0::double as max_typical_age,
           '1990-01-01' as coverage_start, '1991-01-01' as coverage_end
    from lineitem""")
def l7(t):
    given = {
        "number_of_records": 7,
        "number_of_unique_individuals": 3,
        "min_typical_age": " ",
        "max_typical_age": 120,
        "temporal_coverage": {"start": "1990-01-01", "end": "1991-01-01"},
    }
    return P.profile(t.lineitem, LINEITEM, given)


@query("f17_int_or_float", """
    select l_orderkey, l_linenumber, l_partkey,
           cast(cast(l_quantity as bigint) as varchar) as quantity_text,
           case when l_extendedprice = floor(l_extendedprice) then cast(cast(l_extendedprice as bigint) as varchar)
                else cast(cast(l_extendedprice as decimal(18,2)) as double)::varchar end as price_text
    from lineitem""")
def f17(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        P.number_or_whole(F.col("l_quantity")).alias("quantity_text"),
        P.number_or_whole(F.col("l_extendedprice")).alias("price_text"),
    )


@query("e1_parse_date_formats", """
    with s as (select unnest(['iso', 'day_first', 'compact', 'named', 'short_name', 'mail', 'month_only', 'month_first']) as style)
    select o_orderkey, style, strftime(case
        when style = 'month_only' then date_trunc('month', o_orderdate)
        when style = 'month_first' and day(o_orderdate) <= 12
            then make_date(year(o_orderdate)::int, day(o_orderdate)::int, month(o_orderdate)::int)::timestamp
        else o_orderdate::timestamp end, '%Y-%m-%d') as parsed
    from orders, s""")
def e1(t):
    d = F.col("o_orderdate")
    texts = {
        "iso": F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "day_first": F.date_format(d, "dd/MM/yyyy"),
        "compact": F.date_format(d, "yyyyMMdd"),
        "named": F.date_format(d, "MMMM d, yyyy"),
        "short_name": F.upper(F.date_format(d, "yyyy-MMM-d")),
        "mail": F.concat(F.date_format(d, "E, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")),
        "month_only": F.date_format(d, "MM/yyyy"),
        "month_first": F.date_format(d, "MM/dd/yyyy"),
    }
    cells = F.array(*[F.struct(F.lit(n).alias("style"), x.alias("text")) for n, x in texts.items()])
    return (
        spread(t.orders).select("o_orderkey", F.inline(cells))
        .select("o_orderkey", "style", F.date_format(dates.parse_explicit(F.col("text")), "yyyy-MM-dd").alias("parsed"))
    )


@query("e1_parse_date_fuzzy", """
    select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as parsed from orders""")
def e1_fuzzy(t):
    text = F.concat(F.lit("  "), F.date_format("o_orderdate", "EEEE d 'of' MMMM yyyy, HH:mm"))
    plain = F.date_format("o_orderdate", "dd.MM.yyyy")
    mixed = F.when(F.col("o_orderkey") % 4 == 0, F.replace(text, F.lit(" of "), F.lit(" "))).otherwise(plain)
    return t.orders.select(
        "o_orderkey", F.date_format(dates.parse_date(mixed), "yyyy-MM-dd HH:mm:ss").alias("parsed")
    )


@query("e2_strip_timezone", """
    select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as wall_time from events""")
def e2(t):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return t.events.select(
        "event_id", F.date_format(dates.parse_explicit(text), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("wall_time")
    )


@query("c4_not_a_date", """
    with j as (select event_id, props::json->>'k' as k, event_type, strftime(ts, '%Y-%m-%d') as day from events)
    select event_id, true as k_rejected,
           length(event_type) < 6 as type_rejected, false as day_rejected
    from j""")
def c4(t):
    k = F.get_json_object("props", "$.k")
    return t.events.select(
        "event_id",
        dates.not_a_date(k).alias("k_rejected"),
        dates.not_a_date(F.col("event_type")).alias("type_rejected"),
        dates.not_a_date(F.date_format("ts", "yyyy-MM-dd")).alias("day_rejected"),
    )


@query("e3_date_columns", """
    select 'o_orderdate' as "column", count(o_orderdate) as seen, count(o_orderdate) as hits, true as is_date from orders
    union all select 'o_orderpriority', count(*), 0, false from orders
    union all select 'o_totalprice', count(*), 0, false from orders
    union all select 'o_orderkey', count(*), 0, false from orders""")
def e3(t):
    return P.date_columns(spread(t.orders), ["o_orderdate", "o_orderpriority", "o_totalprice", "o_orderkey"])


@query("e6_join_date_parts", """
    select o_orderkey, strftime(o_orderdate, '%Y-') || month(o_orderdate)::varchar || '-' || day(o_orderdate)::varchar as full_date,
           case when o_orderstatus = 'P' then null else year(o_orderdate)::varchar || '-01-01' end as year_only,
           case when o_orderstatus = 'O' then year(o_orderdate)::varchar || '-01-' || day(o_orderdate)::varchar
                else year(o_orderdate)::varchar || '-' || month(o_orderdate)::varchar || '-' || day(o_orderdate)::varchar
           end as month_gap
    from orders""")
def e6(t):
    parts = {p: compile_mapping(t.orders, date_parts("o_orderdate")[p]).col for p in ("year", "month", "day")}
    y, m, d = parts["year"], parts["month"], parts["day"]
    status = F.col("o_orderstatus")
    return t.orders.select(
        "o_orderkey",
        dates.join_parts(y, m, d).alias("full_date"),
        dates.join_parts(F.when(status == "P", F.lit(" NaN ")).otherwise(y), None, None).alias("year_only"),
        dates.join_parts(y, F.when(status == "O", F.lit("None")).otherwise(m), d).alias("month_gap"),
    )


@query("e7_coverage_two_mappings", """
    select o_orderpriority as dataset,
           strftime(least(min(o_orderdate), min(make_date(1990 + o_custkey::int % 40, 1, 1))), '%Y-%m-%d') as coverage_start,
           strftime(greatest(max(o_orderdate), max(make_date(1990 + o_custkey::int % 40, 1, 1))), '%Y-%m-%d') as coverage_end
    from orders group by 1""")
def e7(t):
    df = t.orders.select(
        F.col("o_orderpriority").alias("dataset"), "o_orderdate", (F.col("o_custkey") % 40 + 1990).alias("season")
    )
    season = {"year": {"column": "season", "transform": steps("to_string")}, "month": None, "day": None}
    structure = {"temporal_coverage": [date_parts("o_orderdate"), season, {"month": {"column": "season"}}]}
    return P.profile_by(df, ["dataset"], structure, fuzzy=False).select("dataset", "coverage_start", "coverage_end")


@query("e9_day_predicate", """
    select user_id, count(*) as calls, sum(length(props))::bigint as tokens
    from events where cast(ts as date) = date '2024-01-15' group by 1""")
def e9(t):
    return (
        calls_of_day(t.events, "2024-01-15")
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.length("props")).alias("tokens"))
    )
