"""The same transforms on streams: staged input, run until it ends, as a bounded result."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamtable.operators import windows
from streamtable.operators.windows import FixedWindows, Sessions, SlidingWindows
from streamtable.plans.registry import query
from streamtable.plans.window_queries import _SESSIONS
from streamtable.streaming import replay
from streamtable.streaming.stateful import CountInBag, LastAndCounts, Quiet, fire_panes, shared
from streamtable.streaming.triggers import ACCUMULATING, DISCARDING, RETRACTING, AfterEndOfWindow, ElementCount, Repeat, Strategy


def count_all():
    return F.count("*").alias("n")


def _events(t, **options):
    return replay.staged(t("events").select("event_id", "user_id", "event_type", "ts", "value"), "ts", **options)


def _plain(df):
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else F.col(c) for c, k in df.dtypes))


@query("select *, window_start + interval 1 hour as window_end from (select time_bucket(interval 1 hour, ts, timestamp '1970-01-01') as window_start, count(*) as n from events group by 1)")
def stream_fixed(t, spark):
    return _plain(replay.run(windows.group_windowed(_events(t).withWatermark("ts", "0 seconds"), FixedWindows("1 hour"), "ts", [], count_all())))


@query("""select w as window_start, w + interval 2 hours as window_end, count(*) as n from
    (select ts, time_bucket(interval 1 hour, ts, timestamp '1970-01-01') - to_hours(k) as w from events, range(2) r(k)) group by 1, 2""")
def stream_sliding(t, spark):
    return _plain(replay.run(windows.group_windowed(_events(t).withWatermark("ts", "0 seconds"), SlidingWindows("2 hours", "1 hour"), "ts", [], count_all())))


@query(_SESSIONS.format(op="<="))
def stream_session(t, spark):
    return _plain(replay.run(windows.group_windowed(_events(t).withWatermark("ts", "0 seconds"), Sessions("30 minutes"), "ts", ["user_id"], count_all())))


@query("select distinct event_id, event_type from events")
def stream_dedup(t, spark):
    twice = t("events").unionByName(t("events")).select("event_id", "event_type", "ts")
    return replay.run(replay.staged(twice, "ts", flush=False).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type"))


@query("select user_id, count(*) as n, count(distinct event_type)::bigint as kinds, count(*) as pairs, sum(event_id)::bigint as total from events group by 1")
def stream_state_bag(t, spark):
    replay.use_state_store(spark)
    stream = _events(t, flush=False).select("user_id", "event_id", "event_type")
    out = replay.run(stream.groupBy("user_id").transformWithStateInPandas(CountInBag(), "user_id bigint, n bigint, kinds bigint, pairs bigint, total bigint", "Update", "None"), "update")
    return out.groupBy("user_id").agg(F.max_by(F.struct("n", "kinds", "pairs", "total"), "n").alias("m")).select("user_id", "m.*")


@query("""with e as (select user_id, event_id, epoch_us(ts) // 1000 as ts from events), marked as (select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + 1800000 then 0 else 1 end as fresh from e),
    numbered as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from marked)
    select user_id, min(ts) as start_ms, max(ts) + 1800000 as end_ms, count(*) as n from numbered group by user_id, s""")
def stream_timer(t, spark):
    replay.use_state_store(spark)
    stream = _events(t).withWatermark("ts", "0 seconds").select("user_id", F.unix_millis("ts").alias("millis"), "ts").where(F.col("ts") < F.lit(replay.FAR).cast("timestamp"))
    return replay.run(shared(stream, ["user_id"]).groupBy("share_").transformWithStateInPandas(Quiet(1_800_000), "user_id bigint, start_ms bigint, end_ms bigint, n bigint", "Append", "EventTime"))


@query("""select a.event_id, b.event_id as click_id from events a join events b on a.user_id = b.user_id and b.ts between a.ts and a.ts + interval 2 hours
    where a.event_type = 'purchase' and b.event_type = 'click'""")
def stream_join_interval(t, spark):
    e = t("events").select("event_id", "user_id", "ts", "event_type")
    a = replay.staged(e.where("event_type = 'purchase'"), "ts").withWatermark("ts", "0 seconds").alias("a")
    b = replay.staged(e.where("event_type = 'click'"), "ts").withWatermark("ts", "0 seconds").alias("b")
    return replay.run(a.join(b, F.expr("a.user_id = b.user_id and b.ts >= a.ts and b.ts <= a.ts + interval 2 hours")).select(F.col("a.event_id").alias("event_id"), F.col("b.event_id").alias("click_id")))


def _counted(t, accumulation):
    stream = _events(t, flush=False).withColumn("one", F.lit(1).cast("bigint"))
    return replay.run(fire_panes(stream, ["user_id"], "one", "ts", "bigint", Strategy(Repeat(ElementCount(20)), accumulation)))


@query("select user_id, count(*) // 20 as panes, 20 as least, 20 as most from events group by 1 having count(*) >= 20")
def trigger_element_count(t, spark):
    return _counted(t, DISCARDING).groupBy("user_id").agg(F.count("*").alias("panes"), F.min("value").cast("int").alias("least"), F.max("value").cast("int").alias("most"))


@query("select user_id, count(*) // 20 as panes, (count(*) // 20) * 20 as latest from events group by 1 having count(*) >= 20")
def panes_accumulating(t, spark):
    return _counted(t, ACCUMULATING).groupBy("user_id").agg(F.count("*").alias("panes"), F.max("value").alias("latest"))


@query("select user_id, 2 * (count(*) // 20) - 1 as rows, ((count(*) // 20) * 20)::bigint as net from events group by 1 having count(*) >= 20")
def panes_retracting(t, spark):
    net = F.sum(F.when(F.col("retraction"), -F.col("value")).otherwise(F.col("value")))
    return _counted(t, RETRACTING).groupBy("user_id").agg(F.count("*").alias("rows"), net.alias("net"))


@query("select event_type, epoch_ms(time_bucket(interval 1 day, ts, timestamp '1970-01-01') + interval 1 day) as window_end, count(*) as n from events group by 1, 2")
def trigger_end_of_window(t, spark):
    stream = _events(t).withColumn("one", F.lit(1).cast("bigint"))
    out = replay.run(fire_panes(stream, ["event_type"], "one", "ts", "bigint", Strategy(AfterEndOfWindow(early=ElementCount(10), late=ElementCount(1)), DISCARDING), size="1 day"))
    return out.where("event_type is not null").groupBy("event_type", "window_end").agg(F.sum("value").alias("n")).where("n > 0")


@query("select user_id, p.i as pane_index, p.i = 0 as is_first, false as is_last, 'early' as timing, -1 as on_time_index, 20 as value from (select user_id, count(*) // 20 as k from events group by 1) join range(100000) p(i) on p.i < k")
def pane_info(t, spark):
    """What each pane tells of itself."""
    out = _counted(t, DISCARDING)
    return out.select("user_id", F.col("pane_index").cast("bigint").alias("pane_index"), "is_first", "is_last", "timing", "on_time_index", F.col("value").cast("int").alias("value"))


@query("select user_id, count(*) as n, max_by(event_type, struct_pack(a := ts, b := event_id)) as last from events group by 1")
def stream_value_and_map_state(t, spark):
    replay.use_state_store(spark)
    stream = _events(t, flush=False).select("user_id", "event_type", "event_id", "ts")
    out = replay.run(stream.groupBy("user_id").transformWithStateInPandas(LastAndCounts(), "user_id bigint, n bigint, last string, kinds string", "Append", "none"))
    kinds = F.transform(F.split("kinds", ","), lambda x: F.split(x, "=")[1].cast("bigint"))
    final = out.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("last", "n").alias("last"), F.max_by(F.aggregate(kinds, F.lit(0).cast("bigint"), lambda a, v: a + v), "n").alias("in_map"))
    return final.where("n = in_map").select("user_id", "n", "last")


@query("select 'a' as k, 3 as n union all select 'b', 1")
def test_stream(t, spark):
    events = replay.TestStream(spark, "k string, ts timestamp", "ts")
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    stream = events.add(("a", at(1)), ("b", at(2))).advance_watermark("2024-01-01 00:02:30").add(("a", at(4)), ("a", at(5))).advance_watermark("2024-01-01 01:00:00").add(("a", at(6))).advance_to_infinity().stream()
    timed = stream.withWatermark("ts", "0 seconds")
    out = replay.run(timed.groupBy(F.window("ts", "1 hour"), "k").agg(F.count("*").alias("n")))
    return out.where("k is not null").select("k", F.col("n").cast("int").alias("n"))
