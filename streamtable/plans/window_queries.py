"""Event-time windows over bounded collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from streamtable.operators import windows
from streamtable.operators.windows import CalendarWindows, FixedWindows, GlobalWindow, Sessions, SlidingWindows
from streamtable.plans.registry import query


def count_all():
    return F.count("*").alias("n")


@query("select event_type, count(*) as n from events group by 1")
def window_global(t, spark):
    return windows.group_windowed(t("events"), GlobalWindow(), "ts", ["event_type"], count_all())


@query("select *, window_start + interval 1 hour as window_end from (select event_type, time_bucket(interval 1 hour, ts, timestamp '1970-01-01') as window_start, count(*) as n from events group by 1, 2)")
def window_fixed(t, spark):
    return windows.group_windowed(t("events"), FixedWindows("1 hour"), "ts", ["event_type"], count_all())


@query("select *, window_start + interval 1 hour as window_end from (select time_bucket(interval 1 hour, ts, timestamp '1970-01-01 00:15:00') as window_start, count(*) as n from events group by 1)")
def window_fixed_offset(t, spark):
    return windows.group_windowed(t("events"), FixedWindows("1 hour", "15 minutes"), "ts", [], count_all())


@query("""select w as window_start, w + interval 3 hours as window_end, count(*) as n from
    (select ts, time_bucket(interval 2 hours, ts, timestamp '1970-01-01') - to_hours(2 * k) as w from events, range(2) r(k)) where w + interval 3 hours > ts group by 1, 2""")
def window_sliding(t, spark):
    return windows.group_windowed(t("events"), SlidingWindows("3 hours", "2 hours"), "ts", [], count_all())


_SESSIONS = """with marked as (select *, case when ts {op} lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minutes then 0 else 1 end as fresh from events),
    numbered as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from marked)
    select user_id, min(ts) as window_start, max(ts) + interval 30 minutes as window_end, count(*) as n from numbered group by user_id, s"""


@query(_SESSIONS.format(op="<="))
def window_session(t, spark):
    return windows.group_windowed(t("events"), Sessions("30 minutes"), "ts", ["user_id"], count_all())


@query(_SESSIONS.format(op="<"))
def window_session_strict(t, spark):
    return windows.group_windowed(t("events"), Sessions("30 minutes", strict=True), "ts", ["user_id"], count_all())


@query("select *, window_start + interval 1 month as window_end from (select date_trunc('month', ts)::timestamp as window_start, count(*) as n from events group by 1)")
def window_calendar(t, spark):
    out = windows.group_windowed(t("events"), CalendarWindows("month"), "ts", [], count_all())
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n")


@query("""select window_start, window_start + to_hours(h) as window_end, n from (select time_bucket(interval 1 day, ts, timestamp '1970-01-01') as window_start, case when k = 0 then 12 else 24 end as h, count(*) as n
    from events, range(2) r(k) where k = 1 or hour(ts) < 12 group by 1, 2)""")
def window_custom(t, spark):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    whole = F.struct(day.alias("start"), (day + F.expr("interval 1 day")).alias("end"))
    morning = F.struct(day.alias("start"), (day + F.expr("interval 12 hours")).alias("end"))
    out = windows.custom_windows(t("events"), F.when(F.hour("ts") < 12, F.array(whole, morning)).otherwise(F.array(whole)))
    return out.groupBy("window").agg(count_all()).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n")


@query("select *, window_start + interval 1 day as window_end from (select event_type, time_bucket(interval 1 day, ts, timestamp '1970-01-01') as window_start, list_sort(list(event_id)) as ids from events group by 1, 2)")
def window_gbk(t, spark):
    return windows.group_windowed(t("events"), FixedWindows("1 day"), "ts", ["event_type"], F.array_sort(F.collect_list("event_id")).alias("ids"))


@query("""with s as (select user_id, ts as a, ts + interval 40 minutes as b, event_id from events where event_type = 'click'),
    m as (select *, case when a < max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from s),
    g as (select *, sum(fresh) over (partition by user_id order by a, b rows unbounded preceding) as k from m)
    select user_id, min(a) as a, max(b) as b from g group by user_id, k""")
def window_merge(t, spark):
    own = t("events").where("event_type = 'click'").select("user_id", F.col("ts").alias("a"), (F.col("ts") + F.expr("interval 40 minutes")).alias("b"))
    return windows.merge_windows(own, ["user_id"], "a", "b")


def _output_time(how, sql):
    @query(f"select event_type, time_bucket(interval 1 day, ts, timestamp '1970-01-01') as d, {sql} as out_ts from events group by 1, 2", f"output_time_{how}")
    def run(t, spark):
        e = t("events").withColumn("w", F.window("ts", "1 day")).withColumn("end", F.col("w.end"))
        out = e.groupBy("event_type", "w").agg(windows.output_time("end", how, F.col("ts")).alias("out_ts"))
        return out.select("event_type", F.col("w.start").alias("d"), "out_ts")


_output_time("end_of_window", "d + interval 1 day - interval 1 millisecond")
_output_time("latest", "max(ts)")
_output_time("earliest", "min(ts)")
