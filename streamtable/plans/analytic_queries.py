"""Analytic windows, grouping sets and scalar functions: Spark's own, in the forms that this library's users need."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from streamtable.plans.registry import query


@query("""select o_orderkey, row_number() over w as rn, rank() over v as rk, dense_rank() over v as dr, percent_rank() over v as pr, cume_dist() over v as cd, ntile(4) over w as nt from orders
    window w as (partition by o_custkey order by o_totalprice, o_orderkey), v as (partition by o_custkey order by o_orderstatus)""")
def rank_functions(t, spark):
    w, v = W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"), W.partitionBy("o_custkey").orderBy("o_orderstatus")
    return t("orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"), F.percent_rank().over(v).alias("pr"), F.cume_dist().over(v).alias("cd"), F.ntile(4).over(w).alias("nt"))


@query("""select o_orderkey, lag(o_orderkey) over w as before, lead(o_orderkey, 2, -1) over w as after, first_value(o_orderkey) over w as first, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_totalprice, o_orderkey rows between unbounded preceding and unbounded following) as second
    from orders window w as (partition by o_custkey order by o_totalprice, o_orderkey)""")
def lag_lead(t, spark):
    w = W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return t("orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey", 2, -1).over(w).alias("after"), F.first_value("o_orderkey").over(w).alias("first"), F.nth_value("o_orderkey", 2).over(whole).alias("second"))


@query("select event_id, sum(event_id) over (partition by user_id order by ts, event_id rows between 2 preceding and current row)::bigint as s from events")
def frame_rows(t, spark):
    return t("events").select("event_id", F.sum("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)).alias("s"))


@query("select event_id, count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as n from events")
def frame_range(t, spark):
    return t("events").select("event_id", F.expr("count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row)").alias("n"))


_SETS = "select l_returnflag, l_linestatus, grouping(l_returnflag)::int as g, count(*) as n from lineitem group by "


def _grouped(df):
    return df.agg(F.grouping("l_returnflag").cast("int").alias("g"), F.count("*").alias("n"))


@query(_SETS + "rollup (l_returnflag, l_linestatus)")
def rollup(t, spark):
    return _grouped(t("lineitem").rollup("l_returnflag", "l_linestatus"))


@query(_SETS + "cube (l_returnflag, l_linestatus)")
def cube(t, spark):
    return _grouped(t("lineitem").cube("l_returnflag", "l_linestatus"))


@query(_SETS + "grouping sets ((l_returnflag), (l_linestatus), ())")
def grouping_sets(t, spark):
    return _grouped(t("lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus"))


@query("""select event_type, count(distinct user_id) as users, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as sd, round(var_pop(value), 4) as var, round(median(value), 4) as med,
    max_by(event_id, struct_pack(a := value, b := event_id)) as top, min_by(event_id, struct_pack(a := value, b := event_id)) as low, round(corr(value, user_id), 4) as c, round(quantile_cont(value, 0.9), 4) as p90 from events group by 1""")
def statistics(t, spark):
    by = F.struct("value", "event_id")
    r = lambda c: F.round(c, 4)
    return t("events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("sd"), r(F.var_pop("value")).alias("var"), r(F.median("value")).alias("med"), F.max_by("event_id", by).alias("top"), F.min_by("event_id", by).alias("low"), r(F.corr("value", "user_id")).alias("c"), r(F.percentile("value", 0.9)).alias("p90"))


@query("select event_type, nullif(count(*) filter (user_id % 3 = 0), 0) as \"0\", nullif(count(*) filter (user_id % 3 = 1), 0) as \"1\", nullif(count(*) filter (user_id % 3 = 2), 0) as \"2\" from events group by 1")
def pivot(t, spark):
    return t("events").withColumn("m", F.col("user_id") % 3).groupBy("event_type").pivot("m", [0, 1, 2]).agg(F.count(F.lit(1)))


@query("""select c_custkey, upper(c_name) as u, lower(c_name) as l, length(c_name) as n, substring(c_name, 3, 4) as s, trim(concat(' ', c_name, ' ')) as t, reverse(c_name) as r, replace(c_name, '0', 'o') as p, lpad(c_name, 30, '*') as lp, concat_ws('-', c_name, c_mktsegment) as cw,
    left(c_name, 3) as lf, repeat(left(c_name, 2), 2) as rp, ascii(c_name) as a, md5(c_name) as m, sha256(c_name) as h, split_part(c_name, '#', 1) as sp, regexp_replace(c_name, '[0-9]+', 'N', 'g') as rr, regexp_extract(c_name, '([0-9]+)', 1) as rx, instr(c_name, '#') as i, starts_with(c_name, 'Cust') as sw from customer""")
def scalar_string(t, spark):
    return t("customer").selectExpr("c_custkey", "upper(c_name) as u", "lower(c_name) as l", "cast(length(c_name) as bigint) as n", "substring(c_name, 3, 4) as s", "trim(concat(' ', c_name, ' ')) as t", "reverse(c_name) as r", "replace(c_name, '0', 'o') as p", "lpad(c_name, 30, '*') as lp", "concat_ws('-', c_name, c_mktsegment) as cw", "left(c_name, 3) as lf", "repeat(left(c_name, 2), 2) as rp", "ascii(c_name) as a", "md5(c_name) as m", "sha2(c_name, 256) as h", "split_part(c_name, '#', 1) as sp", "regexp_replace(c_name, '[0-9]+', 'N') as rr", "regexp_extract(c_name, '([0-9]+)', 1) as rx", "cast(instr(c_name, '#') as bigint) as i", "startswith(c_name, 'Cust') as sw")


@query("""select event_id, year(ts) as y, quarter(ts) as q, month(ts) as mo, day(ts) as d, hour(ts) as h, minute(ts) as mi, dayofyear(ts) as dy, weekofyear(ts) as wk, date_trunc('month', ts)::date::varchar as dm, date_diff('day', date '2024-01-01', ts::date) as dd, last_day(ts)::varchar as ld, ts + interval 90 minutes as later, epoch_us(ts) as us from events""")
def scalar_date(t, spark):
    return t("events").selectExpr("event_id", *(f"cast({e} as bigint) as {n}" for e, n in (("year(ts)", "y"), ("quarter(ts)", "q"), ("month(ts)", "mo"), ("day(ts)", "d"), ("hour(ts)", "h"), ("minute(ts)", "mi"), ("dayofyear(ts)", "dy"), ("weekofyear(ts)", "wk"))), "cast(cast(date_trunc('month', ts) as date) as string) as dm", "cast(datediff(cast(ts as date), date'2024-01-01') as bigint) as dd", "cast(last_day(ts) as string) as ld", "ts + interval 90 minutes as later", "unix_micros(cast(ts as timestamp)) as us")


@query("""select event_id, abs(50 - value) as a, round(sqrt(value + 1), 6) as s, round(ln(value + 1), 6) as l, round(exp(value / 100), 6) as e, round(power(value, 2), 6) as p, greatest(value, 10.0) as g, least(value, 10.0) as m, round(value, 1) as r, event_id % 7 as md, event_id // 7 as dv, value / 4 as q, ceil(value)::bigint as c, floor(value)::bigint as f, sign(value - 50)::int as sg from events""")
def scalar_math(t, spark):
    return t("events").selectExpr("event_id", "abs(50 - value) as a", "round(sqrt(value + 1), 6) as s", "round(ln(value + 1), 6) as l", "round(exp(value / 100), 6) as e", "round(power(value, 2), 6) as p", "greatest(value, 10.0d) as g", "least(value, 10.0d) as m", "round(value, 1) as r", "event_id % 7 as md", "event_id div 7 as dv", "value / 4 as q", "ceil(value) as c", "floor(value) as f", "cast(sign(value - 50) as int) as sg")


@query("select event_id, json_extract_string(props, '$.k') as s, (props->>'k')::int as k, json_object('id', event_id)::varchar as j from events")
def scalar_json(t, spark):
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("s"), F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"))).alias("j"))


@query("""with a as (select o_custkey, list_sort(list(o_orderkey)) as v from orders group by 1) select o_custkey, len(v)::int as n, list_sum(v)::bigint as s, list_max(v) as m, list_filter(v, lambda x: x % 2 = 0) as even, list_transform(v, lambda x: x + 1) as plus, v[1] as first, list_contains(v, 1) as has from a""")
def scalar_array(t, spark):
    a = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("v"))
    return a.select("o_custkey", F.size("v").alias("n"), F.aggregate("v", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("s"), F.array_max("v").alias("m"), F.filter("v", lambda x: x % 2 == 0).alias("even"), F.transform("v", lambda x: x + 1).alias("plus"), F.element_at("v", 1).alias("first"), F.array_contains("v", 1).alias("has"))


@query("select c_custkey, map([c_mktsegment, 'x'], [c_nationkey, 0])[c_mktsegment] as v, cardinality(map([c_mktsegment, 'x'], [c_nationkey, 0]))::int as n from customer")
def scalar_map(t, spark):
    m = F.map_from_arrays(F.array("c_mktsegment", F.lit("x")), F.array("c_nationkey", F.lit(0)))
    return t("customer").select("c_custkey", m[F.col("c_mktsegment")].alias("v"), F.size(m).alias("n"))


@query("select event_id, coalesce(nullif(event_type, 'error'), 'none') as t, case when value > 50 then 'hi' when value > 10 then 'mid' else 'lo' end as c, if(value is null, 0, 1) as i from events")
def scalar_conditional(t, spark):
    return t("events").selectExpr("event_id", "coalesce(nullif(event_type, 'error'), 'none') as t", "case when value > 50 then 'hi' when value > 10 then 'mid' else 'lo' end as c", "if(value is null, 0, 1) as i")


@query("""with m as (select event_type, avg(value) as a from events group by 1)
    select event_type, round(avg(pow(value - a, 3)) / pow(avg(pow(value - a, 2)), 1.5), 4) as skew, round(avg(pow(value - a, 4)) / pow(avg(pow(value - a, 2)), 2) - 3, 4) as kurt from events join m using (event_type) group by 1""")
def higher_moments(t, spark):
    return t("events").where("event_type is not null").groupBy("event_type").agg(F.round(F.skewness("value"), 4).alias("skew"), F.round(F.kurtosis("value"), 4).alias("kurt"))
