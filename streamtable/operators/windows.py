"""Event-time windows on bounded and unbounded collections alike. A window is a struct of start and (exclusive) end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class GlobalWindow:
    """No window column: everything is in one window."""

    merges = False

    def column(self, ts: str) -> Column | None:
        return None


@dataclass(frozen=True)
class FixedWindows:
    size: str
    offset: str | None = None
    merges = False

    def column(self, ts: str) -> Column:
        return F.window(ts, self.size, startTime=self.offset) if self.offset else F.window(ts, self.size)


@dataclass(frozen=True)
class SlidingWindows:
    """Every element is in each window that covers it; the size need not be a multiple of the period."""

    size: str
    period: str
    offset: str | None = None
    merges = False

    def column(self, ts: str) -> Column:
        return F.window(ts, self.size, self.period, self.offset) if self.offset else F.window(ts, self.size, self.period)


@dataclass(frozen=True)
class Sessions:
    """Windows of a key that grow while the next element is within the gap. Spark's own sessions also join elements exactly a gap apart; strict ones don't."""

    gap: str
    strict: bool = False
    merges = True

    def column(self, ts: str) -> Column:
        return F.session_window(ts, self.gap)


@dataclass(frozen=True)
class CalendarWindows:
    """Days, weeks, months, quarters or years of the session's time zone."""

    unit: str
    merges = False

    def column(self, ts: str) -> Column:
        start = F.date_trunc(self.unit, ts)
        return F.struct(start.alias("start"), (start + F.expr(f"interval {'3 month' if self.unit == 'quarter' else '1 ' + self.unit}")).alias("end"))


WindowFn = GlobalWindow | FixedWindows | SlidingWindows | Sessions | CalendarWindows


def window_into(df: DataFrame, fn: WindowFn, ts: str, name: str = "window") -> DataFrame:
    """df with a window column; an element of several windows becomes several. Sessions need a key: see group_windowed."""
    if fn.merges:
        raise ValueError("merging windows are assigned where keys are grouped: use group_windowed or strict_sessions")
    column = fn.column(ts)
    return df if column is None else df.withColumn(name, column)


def custom_windows(df: DataFrame, windows: Column, name: str = "window") -> DataFrame:
    """Windows from any expression that gives an array of struct<start, end>, each of which takes the element."""
    return df.withColumn(name, F.explode(windows))


def group_windowed(df: DataFrame, fn: WindowFn, ts: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates per key and window: window_start and window_end, unless the window is global."""
    if isinstance(fn, Sessions) and fn.strict:
        return strict_sessions(df, fn.gap, ts, keys).groupBy(*keys, "window_start", "window_end").agg(*aggregates)
    column = fn.column(ts)
    if column is None:
        return df.groupBy(*keys).agg(*aggregates)
    grouped = df.groupBy(*keys, column.alias("window")).agg(*aggregates)
    return grouped.select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in grouped.columns if c not in (*keys, "window")])


def strict_sessions(df: DataFrame, gap: str, ts: str, keys: list[str]) -> DataFrame:
    """df with window_start and window_end of half-open sessions: an element a whole gap after the last one starts a new one."""
    by = W.partitionBy(*keys).orderBy(ts)
    new = F.coalesce((F.col(ts) >= F.lag(ts).over(by) + F.expr(f"interval {gap}")).cast("int"), F.lit(1))
    marked = df.withColumn("_new", new).withColumn("_session", F.sum("_new").over(by.rangeBetween(W.unboundedPreceding, W.currentRow)))
    own = W.partitionBy(*keys, "_session")
    return marked.withColumn("window_start", F.min(ts).over(own)).withColumn("window_end", F.max(ts).over(own) + F.expr(f"interval {gap}")).drop("_new", "_session")


def merge_windows(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, start and end of the unions of overlapping windows of a key."""
    by = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.coalesce((F.col(start) >= reach).cast("int"), F.lit(1))).withColumn("_group", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy(*keys, "_group").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_group")


def output_time(window_end: str | Column, how: str = "end_of_window", ts: Column | None = None) -> Column:
    """An aggregate expression for the timestamp of a pane: a millisecond before the window's end, or the latest or earliest element."""
    if how == "end_of_window":
        return (F.max(window_end) if isinstance(window_end, str) else window_end) - F.expr("interval 1 millisecond")
    return F.max(ts) if how == "latest" else F.min(ts)
