"""Sources, element-wise transforms, grouping, combining and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamtable.operators import core, grouping
from streamtable.plans.registry import query


@query("select word, count(*) as n from (select unnest(string_split(text, ' ')) as word from documents) where word <> '' group by word")
def wordcount(t, spark):
    words = core.flat_map(t("documents"), F.split("text", " "), "word")
    return grouping.count_per_element(core.filter_by(words, "word <> ''"), "word")


@query("select '' as value, 0 as n")
def impulse(t, spark):
    return core.impulse(spark).select(F.col("value").cast("string").alias("value"), F.length("value").alias("n"))


@query("select * from (values (1, 'one'), (2, 'two'), (3, null)) v(id, name)")
def create(t, spark):
    return core.create(spark, [(1, "one"), (2, "two"), (3, None)], "id int, name string")


@query("select c_custkey, concat(c_name, ': ', cast(c_nationkey as varchar)) as line from customer")
def map_elements(t, spark):
    return core.map_elements(t("customer"), "c_custkey", F.concat("c_name", F.lit(": "), F.col("c_nationkey").cast("string")).alias("line"))


@query("select p_partkey, unnest(string_split(p_type, ' ')) as word from part")
def flat_map(t, spark):
    return core.flat_map(t("part"), F.split("p_type", " "), "word", "p_partkey")


@query("select event_id, user_id, value from events where event_type = 'purchase' and value > 50")
def filter_by(t, spark):
    return core.filter_by(t("events"), "event_type = 'purchase' and value > 50").select("event_id", "user_id", "value")


@query("select event_id, upper(event_type) as output from events union all select event_id, 'paid' from events where event_type = 'purchase'")
def par_do(t, spark):
    """One output of each event, and another of purchases."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def do(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.utf8_upper(b.column(1))], names=["event_id", "output"])
            paid = b.filter(pc.equal(b.column(1), "purchase")).column(0)
            yield pa.RecordBatch.from_arrays([paid, pa.array(["paid"] * len(paid), pa.string())], names=["event_id", "output"])

    return core.par_do(t("events").select("event_id", "event_type"), do, "event_id bigint, output string")


@query("select case when value >= 50 then 'large' else 'small' end as output, count(*) as n, sum(event_id)::bigint as ids from events where value is not null group by 1")
def multi_output_par_do(t, spark):
    out = core.tagged_outputs(t("events").where("value is not null"), F.when(F.col("value") >= 50, "large").otherwise("small"), ["large", "small"])
    parts = [df.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).where("n > 0").select(F.lit(tag).alias("output"), "n", "ids") for tag, df in out.items()]
    return core.flatten(*parts)


@query("select user_id % 4 as part, count(*) as n from events group by 1")
def partition_fn(t, spark):
    parts = core.partition_by(t("events"), F.pmod("user_id", F.lit(4)).cast("int"), 4)
    return core.flatten(*(p.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(k).cast("bigint").alias("part"), "n") for k, p in enumerate(parts)))


@query("select o_orderkey as key, cast(o_custkey as varchar) as value from orders")
def to_string(t, spark):
    return core.to_string(t("orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")))


@query("select n_regionkey as key, n_name as value from nation")
def with_keys(t, spark):
    return core.with_keys(t("nation").select("n_name", "n_regionkey"), F.col("n_regionkey")).select("key", F.col("value.n_name").alias("value"))


@query("select s, count(*) as n from (select o_orderstatus as s from orders union all select l_linestatus from lineitem) group by s")
def flatten(t, spark):
    return grouping.count_per_element(core.flatten(t("orders").select(F.col("o_orderstatus").alias("s")), t("lineitem").select(F.col("l_linestatus").alias("s"))), "s")


@query("select o_custkey as key, list_sort(list(o_orderkey)) as value from orders group by 1")
def group_by_key(t, spark):
    return grouping.group_by_key(t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value")), "key", sort=True)


@query("select event_type as key, len(list(nullif(user_id % 3, 0)))::int as n, count(nullif(user_id % 3, 0)) as present from events group by 1")
def gbk_null_values(t, spark):
    kv = t("events").select(F.col("event_type").alias("key"), F.nullif(F.col("user_id") % 3, F.lit(0)).alias("value"))
    return grouping.group_by_key(kv, "key").select("key", F.size("value").alias("n"), F.size(F.filter("value", lambda x: x.isNotNull())).cast("bigint").alias("present"))


@query("select o_custkey as key, o_orderkey as value from orders")
def group_then_ungroup(t, spark):
    return grouping.ungroup(grouping.group_by_key(t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value")), "key"), "key")


@query("select event_type, count(*) as n from events group by 1")
def count_per_element(t, spark):
    return grouping.count_per_element(t("events").select("event_type"))


def _combine(combiner, sql):
    @query(f"select l_returnflag, l_linestatus, {sql} as v from lineitem group by 1, 2", f"combine_per_key_{combiner}")
    def run(t, spark):
        out = grouping.combine_per_key(t("lineitem"), ["l_returnflag", "l_linestatus"], combiner, "l_quantity", "v")
        return out.withColumn("v", F.round("v", 4)) if combiner in ("sum", "mean") else out


for _c, _s in {"count": "count(*)", "sum": "round(sum(l_quantity), 4)", "min": "min(l_quantity)", "max": "max(l_quantity)", "mean": "round(avg(l_quantity), 4)", "distinct": "count(distinct l_quantity)"}.items():
    _combine(_c, _s)


@query("select event_type, bool_or(value > 99) as some, bool_and(value > 0.01) as every from events group by 1")
def combine_per_key_logical(t, spark):
    return t("events").groupBy("event_type").agg(grouping.COMBINERS["any"](F.col("value") > 99).alias("some"), grouping.COMBINERS["all"](F.col("value") > 0.01).alias("every"))


@query("select round(sum(o_totalprice), 2) as total from orders")
def combine_globally(t, spark):
    return grouping.combine_globally(t("orders"), "sum", "o_totalprice", "total").select(F.round("total", 2).alias("total"))


@query("select coalesce(sum(o_totalprice), 0.0) as total from orders where o_orderkey < 0")
def combine_globally_empty(t, spark):
    return grouping.combine_globally(t("orders").where("o_orderkey < 0"), "sum", "o_totalprice", "total", default=0.0)


@query("select o_custkey as key, count(*) as n, sum(o_orderkey)::bigint as total, max(o_orderkey) as most from orders group by 1")
def combine_grouped_values(t, spark):
    g = grouping.group_by_key(t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value")), "key")
    g = g.select("key", F.col("value").alias("n"), F.col("value").alias("total"), F.col("value").alias("most"))
    return grouping.combine_grouped_values(grouping.combine_grouped_values(grouping.combine_grouped_values(g, "count", "n", "n"), "sum", "total", "total"), "max", "most", "most").select("key", "n", "total", "most")


@query("select o_custkey, o_orderkey, rank::int as rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 2")
def top_per_key(t, spark):
    return grouping.top_per_key(t("orders"), ["o_custkey"], 2, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "rank")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def latest_per_key(t, spark):
    return grouping.latest_per_key(t("events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("select event_type, least(count(*), 10) as n, least(count(*), 10) as own, true as other from events group by 1")
def sample_per_key(t, spark):
    """How many elements of each key are drawn, how many of these are the key's own, and whether another seed draws others."""
    e = t("events").select("event_type", "event_id")
    a, b = (grouping.sample_per_key(e, ["event_type"], 10, "event_id", seed=s) for s in (0, 1))
    own = a.join(e, ["event_type", "event_id"]).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("own"))
    both = a.join(b, ["event_type", "event_id"]).groupBy("event_type").agg(F.count("*").alias("both"))
    return own.join(both, "event_type", "left").select("event_type", "n", "own", (F.coalesce("both", F.lit(0)) < 10).alias("other"))


@query("select event_type, true as close from events group by 1")
def approx_unique(t, spark):
    """Whether the estimate is within a tenth of the number."""
    about = grouping.combine_per_key(t("events"), ["event_type"], "approx_distinct", "user_id", "n")
    sure = t("events").groupBy(F.col("event_type").alias("e")).agg(F.count_distinct("user_id").alias("m"))
    return about.join(sure, F.col("event_type").eqNullSafe(F.col("e"))).select("event_type", (F.abs(F.col("n") - F.col("m")) <= F.col("m") / 10).alias("close"))


@query("select event_type, true as close from events group by 1")
def approx_quantiles(t, spark):
    """Whether each estimate's rank is within a hundredth of what was asked for."""
    points = [0.25, 0.5, 0.75]
    about = grouping.approximate_quantiles(t("events"), ["event_type"], "value", points)
    met = t("events").join(about.withColumnRenamed("event_type", "e"), F.col("event_type").eqNullSafe(F.col("e")))
    below = [(F.count_if(F.col("value") < F.col("quantiles")[k]) / F.count("value"), F.count_if(F.col("value") <= F.col("quantiles")[k]) / F.count("value"), p) for k, p in enumerate(points)]
    close = [(low - 0.01 <= p) & (high + 0.01 >= p) for low, high, p in below]
    return met.groupBy("event_type").agg((close[0] & close[1] & close[2]).alias("close"))


@query("select distinct user_id, event_type from events")
def distinct(t, spark):
    return grouping.distinct(t("events"), "user_id", "event_type")


@query("select o_custkey, (row_number() over (partition by o_custkey order by o_orderkey) - 1) // 3 as batch, o_orderkey from orders")
def group_into_batches(t, spark):
    out = grouping.group_into_batches(t("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 3, "o_orderkey")
    return out.select("o_custkey", "batch", F.explode("elements.o_orderkey").alias("o_orderkey"))


@query("""with recursive o as (select o_custkey, o_orderkey, length(o_orderkey::varchar) as w, row_number() over (partition by o_custkey order by o_orderkey) as r from orders),
    g as (select o_custkey, o_orderkey, r, w as total, 0::bigint as batch from o where r = 1 union all
    select o.o_custkey, o.o_orderkey, o.r, case when g.total + o.w > 12 then o.w else g.total + o.w end, case when g.total + o.w > 12 then g.batch + 1 else g.batch end from g join o on o.o_custkey = g.o_custkey and o.r = g.r + 1)
    select o_custkey, batch, o_orderkey from g""")
def group_into_batches_by_bytes(t, spark):
    out = grouping.group_into_batches_by_bytes(t("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 12, F.octet_length(F.col("o_orderkey").cast("string")), "o_orderkey")
    return out.select("o_custkey", "batch", F.explode("elements.o_orderkey").alias("o_orderkey"))


@query("select event_type, count(*) as n from events group by 1")
def group_into_batches_sharded(t, spark):
    sharded = grouping.sharded_key(t("events").select("event_type", "event_id"), 4, "event_id")
    batches = grouping.group_into_batches(sharded, ["event_type", "shard"], 100, "event_id")
    return batches.groupBy("event_type").agg(F.sum(F.size("elements")).alias("n"))


class MeanAndSpread(grouping.CombineFn):
    """Count, mean and spread of numbers, from accumulators that can be merged in any order."""

    def create(self):
        return (0, None, None, 0)

    def add(self, a, v):
        return a if v is None else (a[0] + 1, v if a[1] is None else min(a[1], v), v if a[2] is None else max(a[2], v), a[3] + v)

    def merge(self, a, b):
        if not a[0] or not b[0]:
            return a if a[0] else b
        return (a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), a[3] + b[3])

    def extract(self, a):
        return None if not a[0] else (a[2] - a[1]) * a[0] + a[3]


@query("select o_custkey as key, (max(o_orderkey) - min(o_orderkey)) * count(*) + sum(o_orderkey)::bigint as value from orders group by 1")
def custom_combine_fn(t, spark):
    return grouping.combine_with(t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value")), "key", "value", MeanAndSpread(), "bigint")


@query("select n_regionkey as k from nation union select c_nationkey from customer")
def union_distinct(t, spark):
    return core.flatten(t("nation").select(F.col("n_regionkey").alias("k")), t("customer").select(F.col("c_nationkey").alias("k"))).distinct()


@query("select o_custkey as k from orders where o_totalprice > 100000 intersect select c_custkey from customer where c_acctbal > 0")
def intersect(t, spark):
    return t("orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("k")).intersect(t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("select l_suppkey as k from lineitem intersect all select s_suppkey from supplier")
def intersect_all(t, spark):
    return t("lineitem").select(F.col("l_suppkey").alias("k")).intersectAll(t("supplier").select(F.col("s_suppkey").alias("k")))


@query("select c_custkey as k from customer except select o_custkey from orders")
def except_distinct(t, spark):
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").select(F.col("o_custkey").alias("k")))


@query("select o_custkey as k from orders except all select c_custkey from customer")
def except_all(t, spark):
    return t("orders").select(F.col("o_custkey").alias("k")).exceptAll(t("customer").select(F.col("c_custkey").alias("k")))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_k(t, spark):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("select c_custkey, c_name from customer order by c_custkey limit 10 offset 5")
def limit_ordered(t, spark):
    return t("customer").select("c_custkey", "c_name").orderBy("c_custkey").offset(5).limit(10)


@query("select s_suppkey, s_acctbal, row_number() over (order by s_acctbal desc, s_suppkey)::int as place from supplier")
def sort_globally(t, spark):
    # a range-partitioned sort gives each row its place without bringing all rows to one task
    rows = t("supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    before = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    from pyspark.sql import Window as W

    starts = before.withColumn("_s", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.join(F.broadcast(starts), part == F.col("_p")).select("s_suppkey", "s_acctbal", (F.col("_s") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int").alias("place"))


@query("select l_orderkey, l_linenumber from lineitem")
def reshuffle(t, spark):
    return core.reshuffle(t("lineitem").select("l_orderkey", "l_linenumber"), 8)


@query("select l_suppkey, count(*) as n from lineitem group by 1")
def redistribute_by_key(t, spark):
    return core.redistribute_by_key(t("lineitem").select("l_suppkey"), 8, "l_suppkey").groupBy("l_suppkey").agg(F.count("*").alias("n"))
