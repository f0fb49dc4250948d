"""Side inputs, co-grouping and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamtable.operators import joins
from streamtable.plans.registry import query

CUSTOMER, ORDERS = "customer", "orders"


@query("select o_orderkey, o_totalprice - (select avg(o_totalprice) from orders) > 0 as above from orders")
def side_input_singleton(t, spark):
    mean = t(ORDERS).agg(F.avg("o_totalprice").alias("mean"))
    return joins.singleton_side_input(t(ORDERS), mean).select("o_orderkey", (F.col("o_totalprice") > F.col("mean")).alias("above"))


@query("select r_regionkey, (select list_sort(list(n_name)) from nation) as names from region")
def side_input_iterable(t, spark):
    return joins.iterable_side_input(t("region").select("r_regionkey"), t("nation"), "n_name", "names")


@query("select c_custkey, coalesce(m.keys, []) as keys from customer left join (select o_custkey, list_sort(list(o_orderkey)) as keys from orders group by 1) m on c_custkey = o_custkey")
def side_input_multimap(t, spark):
    return joins.multimap_side_input(t(CUSTOMER).select("c_custkey"), t(ORDERS).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderkey", "keys")


@query("""select event_id, m.most from events left join (select date_trunc('day', ts) as d, max(value) as most from events group by 1) m on date_trunc('day', events.ts) = m.d""")
def side_input_windowed(t, spark):
    e = t("events")
    return joins.windowed_side_input(e, e.select(F.col("ts").alias("t2"), F.col("value").alias("v2")), F.date_trunc("day", "ts"), F.date_trunc("day", "t2"), F.max("v2"), "most").select("event_id", "most")


def _co_group(how, sql_join, key):
    @query(f"""with a as (select c_nationkey as k, list_sort(list(c_custkey)) as customers from customer where c_acctbal > 5000 group by 1),
        b as (select s_nationkey as k, list_sort(list(s_suppkey)) as suppliers from supplier group by 1)
        select {key} as k, coalesce(customers, []) as customers, coalesce(suppliers, []) as suppliers from a {sql_join} join b on a.k = b.k""", f"cogbk_{how}")
    def run(t, spark):
        a = t(CUSTOMER).where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"), "c_custkey")
        b = t("supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
        return joins.co_group_by_key({"customers": (a, "c_custkey"), "suppliers": (b, "s_suppkey")}, "k", how)


for _h, _j, _k in (("inner", "inner", "a.k"), ("left", "left", "a.k"), ("right", "right", "b.k"), ("full", "full", "coalesce(a.k, b.k)")):
    _co_group(_h, _j, _k)


def _join(how, sql, strategy=None, name=None):
    @query(sql, name or f"join_{how}")
    def run(t, spark):
        c, o = t(CUSTOMER).select("c_custkey", "c_name"), t(ORDERS).select("o_orderkey", "o_custkey", "o_totalprice")
        on = c["c_custkey"] == o["o_custkey"]
        if how in ("semi", "anti"):
            return joins.equi_join(c, o, on, f"left_{how}").select("c_custkey", "c_name")
        if how == "full":
            on = on & (o["o_totalprice"] > 100000)
        return joins.equi_join(c, o, on, how, strategy).select("c_custkey", "c_name", "o_orderkey")


_SELECT = "select c_custkey, c_name, o_orderkey from customer"
_join("inner", f"{_SELECT} join orders on c_custkey = o_custkey")
_join("left", f"{_SELECT} left join orders on c_custkey = o_custkey")
_join("right", f"{_SELECT} right join orders on c_custkey = o_custkey")
_join("full", f"{_SELECT} full join orders on c_custkey = o_custkey and o_totalprice > 100000")
_join("semi", "select c_custkey, c_name from customer semi join orders on c_custkey = o_custkey")
_join("anti", "select c_custkey, c_name from customer anti join orders on c_custkey = o_custkey")
for _s in ("broadcast", "merge", "shuffle_hash"):
    _join("inner", f"{_SELECT} join orders on c_custkey = o_custkey", _s, f"join_strategy_{_s}")


@query("select r_name, n_name from region cross join nation")
def join_cross(t, spark):
    return t("region").select("r_name").crossJoin(t("nation").select("n_name"))


@query("select a.s_suppkey as low, b.s_suppkey as high from supplier a join supplier b on a.s_acctbal < b.s_acctbal and a.s_nationkey = b.s_nationkey")
def join_theta(t, spark):
    a, b = t("supplier").alias("a"), t("supplier").alias("b")
    return a.join(b, F.expr("a.s_acctbal < b.s_acctbal and a.s_nationkey = b.s_nationkey")).select(F.col("a.s_suppkey").alias("low"), F.col("b.s_suppkey").alias("high"))


@query("select c_custkey, s_suppkey from customer join supplier on c_acctbal between s_acctbal - 20 and s_acctbal + 20")
def join_range(t, spark):
    s = t("supplier").select("s_suppkey", (F.col("s_acctbal") - 20).alias("low"), (F.col("s_acctbal") + 20).alias("high"))
    return joins.range_join(t(CUSTOMER).select("c_custkey", "c_acctbal"), s, "c_acctbal", "low", "high", 100.0).select("c_custkey", "s_suppkey")


@query("""select a.event_id, b.event_id as click_id from (select * from events where event_type = 'purchase') a
    asof left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'click' group by 1, 2) b on a.user_id = b.user_id and a.ts >= b.ts""")
def join_asof(t, spark):
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return joins.as_of_join(e.where("event_type = 'purchase'"), clicks, "user_id", "ts", "click_id", "click_id").select("event_id", "click_id")


@query("""select a.event_id, b.event_id as click_id from events a join events b on a.user_id = b.user_id and b.ts between a.ts and a.ts + interval 2 hours
    where a.event_type = 'purchase' and b.event_type = 'click'""")
def join_interval(t, spark):
    e = t("events")
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    b = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("ts2"), F.col("event_id").alias("click_id"))
    return joins.interval_join(a, b, "user_id", "ts", "ts2", "2 hours").select("event_id", "click_id")
