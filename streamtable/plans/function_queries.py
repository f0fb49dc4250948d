"""User code of every kind, expansion by name, sorted input and destinations by row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from streamtable.operators import core
from streamtable.plans.expansion import expand
from streamtable.plans.registry import query
from streamtable.sources import managed
from streamtable.sources.scratch import scratch
from streamtable.streaming import replay


@query("select c_custkey, upper(c_mktsegment) || '!' as loud from customer")
def udf_arrow(t, spark):
    @F.arrow_udf("string")
    def loud(v: pa.Array) -> pa.Array:
        return pc.binary_join_element_wise(pc.utf8_upper(v), "!", "")

    return t("customer").select("c_custkey", loud("c_mktsegment").alias("loud"))


@query("select c_custkey, c_acctbal * 2 as twice from customer")
def udf_pandas(t, spark):
    @F.pandas_udf("double")
    def twice(v: pd.Series) -> pd.Series:
        return v * 2

    return t("customer").select("c_custkey", twice("c_acctbal").alias("twice"))


@query("select l_returnflag, max(l_quantity) - min(l_quantity) as spread from lineitem group by 1")
def udaf_pandas(t, spark):
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return t("lineitem").groupBy("l_returnflag").agg(spread("l_quantity").alias("spread"))


@query("select p_partkey, i - 1 as place, ws[i] as word from (select p_partkey, string_split(p_type, ' ') as ws, unnest(range(1, len(string_split(p_type, ' ')) + 1)) as i from part)")
def udtf(t, spark):
    @F.udtf(returnType="place bigint, word string")
    class Words:
        def eval(self, text: str):
            yield from enumerate(text.split(" "))

    spark.udtf.register("streamtable_words", Words)
    t("part").createOrReplaceTempView("streamtable_part")
    return spark.sql("select p_partkey, place, word from streamtable_part, lateral streamtable_words(p_type)")


@query("select n_regionkey, n_nationkey from nation where n_nationkey > 5 union all select n_regionkey, n_nationkey from nation where n_nationkey < 3")
def expand_by_name(t, spark):
    nations = t("nation").select("n_regionkey", "n_nationkey")
    parts = [expand("streamtable:filter:v1", {"predicate": p}, nations) for p in ("n_nationkey > 5", "n_nationkey < 3")]
    return expand("streamtable:flatten:v1", {}, *parts)


@query("select user_id, event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)), 0) as gap from events")
def time_sorted_input(t, spark):
    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, before = None, 0
        for b in batches:
            out = []
            for u, now in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                out.append(now - before if u == user else 0)
                user, before = u, now
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], names=["user_id", "event_id", "gap"])

    rows = t("events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return core.time_sorted(rows, gaps, "user_id bigint, event_id bigint, gap bigint", ["user_id"], "us", "event_id")


@query("select event_id, user_id from events where event_type = 'click'")
def write_dynamic_destinations(t, spark):
    folder = scratch(spark, "topics")
    managed.write_by_destination(t("events").select("event_id", "user_id", "event_type"), "event_type", folder)
    return managed.read_destination(spark, "click", folder).select("event_id", "user_id")


@query("select event_id, epoch_us(ts) // 1000 as ms from events")
def stream_message_ids(t, spark):
    messages = t("events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "ts")
    stream = replay.staged(messages.unionByName(messages), "ts", flush=False).drop("ts").withColumn("sent", F.col("ms"))
    return replay.run(managed.timestamped(stream, "sent", "1 hour", "event_id")).select("event_id", "ms")
