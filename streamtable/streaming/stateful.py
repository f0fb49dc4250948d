"""Keyed state and timers: processors for Spark's transformWithState."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from streamtable.streaming.replay import FAR, use_state_store
from streamtable.streaming.triggers import Combiner, Moment, Strategy, close, new_state, step


KINDS = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType()}


def one(name: str, kind: str) -> T.StructType:
    """A state's schema of one field. Executors have no session to parse types with."""
    inner = kind.removeprefix("array<").removesuffix(">")
    return T.StructType([T.StructField(name, T.ArrayType(KINDS[inner]) if inner != kind else KINDS[kind])])


class BagState:
    """Values in the order in which they came."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, kind: str):
        self.state = handle.getListState(name, one("v", kind))

    def add(self, v) -> None:
        self.state.appendValue((v,))

    def read(self) -> list:
        return [r[0] for r in self.state.get()]

    def clear(self) -> None:
        self.state.clear()


class ReadModifyWriteState:
    def __init__(self, handle: StatefulProcessorHandle, name: str, kind: str):
        self.state = handle.getValueState(name, one("v", kind))

    def read(self, default=None):
        return self.state.get()[0] if self.state.exists() else default

    def write(self, v) -> None:
        self.state.update((v,))

    def clear(self) -> None:
        self.state.clear()


class CombiningState(ReadModifyWriteState):
    """A value that additions are folded into."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, kind: str, fold, start):
        super().__init__(handle, name, kind)
        self.fold, self.start = fold, start

    def add(self, v) -> None:
        self.write(self.fold(self.read(self.start), v))


class MapState:
    def __init__(self, handle: StatefulProcessorHandle, name: str, key: str, value: str):
        self.state = handle.getMapState(name, one("k", key), one("v", value))

    def get(self, k, default=None):
        return self.state.getValue((k,))[0] if self.state.containsKey((k,)) else default

    def put(self, k, v) -> None:
        self.state.updateValue((k,), (v,))

    def remove(self, k) -> None:
        self.state.removeKey((k,))

    def keys(self) -> list:
        return sorted(k[0] for k in self.state.keys())

    def items(self) -> list[tuple]:
        return sorted((k[0], v[0]) for k, v in self.state.iterator())


class SetState(MapState):
    def __init__(self, handle: StatefulProcessorHandle, name: str, kind: str):
        super().__init__(handle, name, kind, "boolean")

    def add(self, k) -> None:
        self.put(k, True)

    def __contains__(self, k) -> bool:
        return self.get(k) is not None


class MultimapState:
    """Several values under a key, in the order in which they came."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, key: str, value: str):
        self.map = MapState(handle, name, key, f"array<{value}>")

    def put(self, k, v) -> None:
        self.map.put(k, [*(self.map.get(k) or []), v])

    def get(self, k) -> list:
        return list(self.map.get(k) or [])

    def keys(self) -> list:
        return self.map.keys()

    def remove(self, k) -> None:
        self.map.remove(k)


class OrderedListState:
    """Values by their time, read and cleared by ranges [start, end)."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, kind: str):
        self.map = MultimapState(handle, name, "bigint", kind)

    def add(self, millis: int, v) -> None:
        self.map.put(millis, v)

    def read(self, start: int = -(1 << 63), end: int = (1 << 63) - 1) -> list[tuple]:
        return [(t, v) for t in self.map.keys() if start <= t < end for v in self.map.get(t)]

    def clear(self, start: int = -(1 << 63), end: int = (1 << 63) - 1) -> None:
        for t in self.map.keys():
            if start <= t < end:
                self.map.remove(t)


GLOBAL = -(1 << 63)  # the end of the global window in grouping keys: rows whose key has a null come to pandas as NaN, each a group of its own
SHARES = 256  # of the keys; a stream that is to go on from its checkpoint must keep it
PLAIN = (T.IntegralType, T.FractionalType, T.StringType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


def shared(rows: DataFrame, keys: list[str], shares: int = SHARES) -> DataFrame:
    """rows with a column share_ of their keys, and for each key one that tells nulls, null0_ and so on. (Names that begin with _ get lost on the way to pandas.)

    A call of a stateful processor and each of its state's reads and writes cost some milliseconds, so these are for a share of the keys instead
    of each. pandas turns whole numbers among nulls into inexact ones, so keys that are such are 0 where they are null.
    """
    for k, key in enumerate(keys):
        kind = rows.schema[key].dataType
        if not isinstance(kind, PLAIN):
            raise TypeError(f"the key {key} has a type that isn't plain: {kind.simpleString()}")
        rows = rows.withColumn(f"null{k}_", F.col(key).isNull())
        if isinstance(kind, T.IntegralType):
            rows = rows.withColumn(key, F.coalesce(key, F.lit(0).cast(kind)))
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            rows = rows.withColumn(key, F.col(key) + F.lit(0.0).cast(kind))  # -0.0 is 0.0
    return rows.withColumn("share_", F.pmod(F.xxhash64(*keys), F.lit(shares)).cast("int"))


def by_key(pdf: pd.DataFrame, keys: list[str], order: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Each key among rows that are shared() and, in the given order, its rows. Of a key, nulls are None and NaN is "NaN"."""
    code = np.zeros(len(pdf), np.int64)
    for k, key in enumerate(keys):
        column, null = pdf[key], pdf[f"null{k}_"].to_numpy(bool)
        own = np.where(null, -1, pd.factorize(column, use_na_sentinel=False)[0]) + 1
        code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    at = np.lexsort((*(pdf[c].to_numpy() for c in reversed(order)), code))
    cut = np.flatnonzero(np.diff(code[at], prepend=-1, append=-1))
    first = pdf.iloc[at[cut[:-1]]]
    columns = [[None if no else "NaN" if v != v else v for v, no in zip(first[key].tolist(), first[f"null{k}_"].tolist(), strict=True)] for k, key in enumerate(keys)]
    return zip(zip(*columns, strict=True), (at[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)), strict=True)


class Panes(StatefulProcessor):
    """Fires the panes of the keys of a share in a window under a strategy. The key is the share and the window's end in milliseconds, GLOBAL for the global window."""

    def __init__(self, strategy: Strategy, combiner: Combiner, value: str, keys: list[str], kinds: list[T.DataType], lateness: int, whole: bool):
        self.strategy, self.combiner, self.value, self.keys, self.kinds, self.lateness, self.whole = strategy, combiner, value, keys, kinds, lateness, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("panes", one("v", "binary"))

    def _rows(self, key: tuple, panes: list[tuple[tuple, dict]]) -> Iterator[pd.DataFrame]:
        if panes:
            names = {}
            for k, (name, kind) in enumerate(zip(self.keys, self.kinds, strict=True)):
                values = [of[k] for of, _ in panes]
                if isinstance(kind, (T.FloatType, T.DoubleType)):
                    values = [float("nan") if v == "NaN" else v for v in values]
                names[name] = pd.Series(values, dtype=None if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else object)
            yield pd.DataFrame({**names, "window_end": pd.Series([None if key[-1] == GLOBAL else int(key[-1])] * len(panes), dtype=object), **{name: [p[name] for _, p in panes] for name in panes[0][1]}})

    def _moment(self, key: tuple, timers) -> Moment:
        return Moment(key[-1] != GLOBAL and timers.getCurrentWatermarkInMs() >= key[-1], timers.getCurrentProcessingTimeInMs())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        states = pickle.loads(held[0]) if held is not None else {}
        at, panes = self._moment(key, timerValues), []
        pdf = pd.concat(list(rows), ignore_index=True)
        values = [None if no else int(v) if self.whole else None if v is None or v != v else v for v, no in zip(pdf[self.value].tolist(), pdf["none_"].tolist(), strict=True)]
        for of, own in by_key(pdf, self.keys, ["event_order"]):
            if of not in states:
                states[of] = new_state(self.strategy)
            panes += [(of, p) for p in step(self.strategy, states[of], self.combiner, [values[k] for k in own.tolist()], at)]
        if held is None and key[-1] != GLOBAL:
            for t in {int(key[-1]), int(key[-1]) + self.lateness}:
                if t > timerValues.getCurrentWatermarkInMs():
                    self.handle.registerTimer(t)
        self.state.update((pickle.dumps(states),))
        yield from self._rows(key, panes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        if held is None:
            return
        states, at, panes = pickle.loads(held[0]), self._moment(key, timerValues), []
        over = timerValues.getCurrentWatermarkInMs() >= int(key[-1]) + self.lateness
        for of, s in states.items():
            panes += [(of, p) for p in step(self.strategy, s, self.combiner, [], at) + (close(self.strategy, s, self.combiner) if over else [])]
        if over:
            self.state.clear()
        else:
            self.state.update((pickle.dumps(states),))
        yield from self._rows(key, panes)


def fire_panes(stream: DataFrame, keys: list[str], value: str, ts: str, kind: str, strategy: Strategy, size: str | None = None, combiner: Combiner | None = None, delay: str = "0 seconds", lateness_ms: int = 0) -> DataFrame:
    """keys, window_end (milliseconds, null if global), value and the pane's fields, for each pane of fixed windows (size) or the global one.

    The watermark trails the latest event by delay; elements later than that by no more than lateness_ms still count. Null elements are
    elements: they count for triggers, and the combiner is given them (the default one adds nothing for them).
    """
    use_state_store(stream.sparkSession)
    timed = stream.withWatermark(ts, delay)
    end = F.unix_millis(F.window(ts, size)["end"]) if size else F.lit(GLOBAL).cast("bigint")
    rows = timed.select(*keys, end.alias("window_end"), F.col(value).alias("element"), F.unix_micros(ts).alias("event_order"), F.col(ts).alias("event_time"))
    # rows that only advance the watermark go; naming the event time keeps this above the watermark
    rows = rows.where(F.col("event_time") < F.lit(FAR).cast("timestamp"))
    if "_mark" in stream.columns:
        rows = timed.where(~F.col("_mark") & F.col(ts).isNotNull() & (F.col(ts) < F.lit(FAR).cast("timestamp"))).select(*keys, end.alias("window_end"), F.col(value).alias("element"), F.unix_micros(ts).alias("event_order"), F.col(ts).alias("event_time"))
    kinds, whole = [rows.schema[k].dataType for k in keys], isinstance(rows.schema["element"].dataType, T.IntegralType)
    schema = StructType([*(T.StructField(k, t) for k, t in zip(keys, kinds, strict=True)), *StructType.fromDDL(f"window_end bigint, value {kind}, retraction boolean, is_first boolean, is_last boolean, timing string, pane_index int, on_time_index int").fields])
    rows = shared(rows.withColumn("none_", F.col("element").isNull()), keys)
    if whole:
        rows = rows.withColumn("element", F.coalesce("element", F.lit(0).cast(rows.schema["element"].dataType)))
    return rows.groupBy("share_", "window_end").transformWithStateInPandas(Panes(strategy, combiner or Combiner(), "element", keys, kinds, lateness_ms, whole), schema, "Append", "EventTime")


class CountInBag(StatefulProcessor):
    """Per key: how many elements, kinds and pairs its bag, set and multimap hold after each batch."""

    def init(self, handle):
        self.bag, self.kinds, self.by_kind = BagState(handle, "bag", "bigint"), SetState(handle, "kinds", "string"), MultimapState(handle, "by_kind", "string", "bigint")
        self.total = CombiningState(handle, "total", "bigint", lambda a, v: a + v, 0)

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            for i, k in zip(pdf["event_id"].tolist(), pdf["event_type"].tolist(), strict=True):
                self.bag.add(i)
                self.kinds.add(k)
                self.by_kind.put(k, i)
                self.total.add(i)
        yield pd.DataFrame({"user_id": [key[0]], "n": [len(self.bag.read())], "kinds": [len(self.kinds.keys())], "pairs": [sum(len(self.by_kind.get(k)) for k in self.by_kind.keys())], "total": [self.total.read()]})


class LastAndCounts(StatefulProcessor):
    """Per key: how many elements there were, the latest kind, and how often each kind came."""

    def init(self, handle):
        self.last, self.n, self.by_kind = ReadModifyWriteState(handle, "last", "string"), ReadModifyWriteState(handle, "n", "bigint"), MapState(handle, "by_kind", "string", "bigint")

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            for kind in pdf.sort_values(["ts", "event_id"])["event_type"].tolist():
                self.last.write(kind)
                self.n.write(self.n.read(0) + 1)
                self.by_kind.put(kind, self.by_kind.get(kind, 0) + 1)
        yield pd.DataFrame({"user_id": [key[0]], "n": [self.n.read(0)], "last": [self.last.read()], "kinds": [",".join(f"{k}={v}" for k, v in self.by_kind.items())]})


class Quiet(StatefulProcessor):
    """Sessions by timer: the times of the keys of a share are kept, in order, until a key has been quiet for a gap. One timer stands for the session that ends first."""

    KEPT = ["null0_", "user_id", "millis"]

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle):
        self.handle, self.state = handle, handle.getValueState("held", one("v", "binary"))

    def _held(self) -> list[np.ndarray]:
        held = self.state.get()
        return pickle.loads(held[0]) if held is not None else []

    def _sessions(self, kept: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first row of each session, where the last one ends, and when each session ends."""
        null, user, millis = kept
        new = np.ones(len(user), bool)
        new[1:] = (null[1:] != null[:-1]) | (user[1:] != user[:-1]) | (millis[1:] >= millis[:-1] + self.gap)
        cut = np.append(np.flatnonzero(new), len(user))
        return cut[:-1], cut[1:], millis[cut[1:] - 1] + self.gap

    def _keep(self, kept: list[np.ndarray]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(kept[0]):
            self.handle.registerTimer(int(self._sessions(kept)[2].min()))
            self.state.update((pickle.dumps(kept),))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        fresh = [pdf[c].to_numpy(t) for c, t in zip(self.KEPT, (bool, np.int64, np.int64), strict=True)]
        held = self._held()
        kept = [np.concatenate(x) for x in zip(held, fresh, strict=True)] if held else fresh
        order = np.lexsort(kept[::-1])
        self._keep([x[order] for x in kept])
        yield pd.DataFrame([], columns=["user_id", "start_ms", "end_ms", "n"]).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        kept = self._held()
        if not kept:
            return
        first, after, end = self._sessions(kept)
        over = end <= timerValues.getCurrentWatermarkInMs()
        self._keep([x[~np.repeat(over, after - first)] for x in kept])
        if over.any():
            users = [None if no else u for no, u in zip(kept[0][first[over]].tolist(), kept[1][first[over]].tolist(), strict=True)]
            yield pd.DataFrame({"user_id": pd.Series(users, dtype=object), "start_ms": kept[2][first[over]], "end_ms": end[over], "n": (after - first)[over]})
