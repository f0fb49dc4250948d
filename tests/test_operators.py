import datetime
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamtable.functions import types as ty
from streamtable.operators import core, grouping, joins, windows
from streamtable.plans.expansion import discover, expand
from streamtable.plans.metrics import Metrics
from streamtable.plans.pipeline import Job, Pipeline, State
from streamtable.sources import managed
from streamtable.sources.ranges import OffsetRange
from streamtable.sources.tables import Tables, record_shape

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors can't import tests
WISDOM = "the wise know the way and the wise speak of the way "


def at(minute, second=0):
    return datetime.datetime(2024, 1, 1, 0, minute, second)


def test_impulse_is_one_empty_byte_string(spark):
    assert [bytes(r.value) for r in core.impulse(spark).collect()] == [b""]


def test_create_refuses_what_does_not_fit_and_allows_nothing(spark):
    assert core.create(spark, [], "value string").count() == 0
    with pytest.raises(PySparkException):
        core.create(spark, [("a",), (1,)], T.StructType([T.StructField("value", T.LongType())])).collect()


def test_word_count(spark):
    text = core.create(spark, [(WISDOM * 3,)], "line string")
    words = core.filter_by(core.flat_map(text, F.split("line", " "), "word"), "word <> ''")
    got = dict(grouping.count_per_element(words, "word").collect())
    want = {}
    for w in (WISDOM * 3).split():
        want[w] = want.get(w, 0) + 1
    assert got == want


def test_group_by_key_keeps_nulls(spark):
    kv = spark.createDataFrame([("word", None)] * 3 + [("other", None), (None, 1)], "key string, value int")
    got = {r.key: r.value for r in grouping.group_by_key(kv, "key").collect()}
    assert got == {"word": [None] * 3, "other": [None], None: [1]}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers() .filter(lambda x: abs(x) < 2**62) | st.none()), max_size=20))
def test_grouping_then_ungrouping_is_nothing(spark, rows):
    df = spark.createDataFrame(rows, "key int, value bigint")
    again = grouping.ungroup(grouping.group_by_key(df, "key"), "key").collect()
    key = lambda r: (r[0], r[1] is None, r[1] or 0)
    assert sorted(map(tuple, again), key=key) == sorted(rows, key=key)


class Longest(grouping.CombineFn):
    def create(self):
        return ""

    def add(self, a, v):
        return max(a, v or "", key=lambda x: (len(x), x))

    def merge(self, a, b):
        return self.add(a, b)


def test_combine_fn_merges_across_tasks_and_flushes(spark):
    rows = [(k % 5, "x" * (k % 7) + str(k)) for k in range(200)] + [(None, "none"), (9, None)]
    df = spark.createDataFrame(rows, "key int, value string").repartition(6)
    want = {}
    for k, v in rows:
        want[k] = Longest().add(want.get(k, ""), v)
    for most in (100_000, 2):
        assert dict(grouping.combine_with(df, "key", "value", Longest(), "string", most=most).collect()) == want


def test_flatten_keeps_repeats_and_refuses_other_types(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    assert core.flatten(a, a.select("b", "a")).count() == 2
    with pytest.raises(TypeError):
        core.flatten(a, spark.createDataFrame([(1, 2)], "a int, b int"))


def test_partition_by_refuses_indices_outside(spark):
    parts = core.partition_by(spark.range(10), (F.col("id") % 3).cast("int"), 3)
    assert [p.count() for p in parts] == [4, 3, 3]
    with pytest.raises(Exception, match="partition index"):
        core.partition_by(spark.range(3), F.lit(7), 3)[0].collect()


def test_batches(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    got = sorted((r.k, r.batch, [e.id for e in r.elements]) for r in grouping.group_into_batches(df, ["k"], 2, "id").collect())
    assert got == [(0, 0, [0, 2]), (0, 1, [4, 6]), (0, 2, [8]), (1, 0, [1, 3]), (1, 1, [5, 7]), (1, 2, [9])]


def test_singleton_side_inputs(spark):
    main, none = spark.range(2), spark.createDataFrame([], "x int")
    assert [r.x for r in joins.singleton_side_input(main, none).collect()] == [None, None]
    with pytest.raises(Exception, match="more than one"):
        joins.singleton_side_input(main, spark.createDataFrame([(1,), (2,)], "x int")).collect()


def test_as_of_join_ties_and_gaps(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5), (None, 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 10), ("a", 5, 20), ("a", 5, 30), ("a", 9, 40)], "k string, t int, v int")
    got = {(r.k, r.t): r.v for r in joins.as_of_join(left, right, "k", "t", "v", "v").collect()}
    assert got == {("a", 1): None, ("a", 5): 30, ("b", 5): None, (None, 5): None}


def test_range_join_at_the_edges(spark):
    points = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (25.0,)], "p double")
    spans = spark.createDataFrame([(1, 0.0, 10.0), (2, -5.0, 30.0)], "s int, a double, b double")
    got = sorted((r.p, r.s) for r in joins.range_join(points, spans, "p", "a", "b", 10.0).collect())
    assert got == [(0.0, 1), (0.0, 2), (9.99, 1), (9.99, 2), (10.0, 1), (10.0, 2), (25.0, 2)]


def test_sessions_at_the_gap(spark):
    df = spark.createDataFrame([("u", at(0)), ("u", at(10)), ("u", at(21))], "k string, ts timestamp")
    for strict, want in ((False, [2, 1]), (True, [1, 1, 1])):
        out = windows.group_windowed(df, windows.Sessions("10 minutes", strict), "ts", ["k"], F.count("*").alias("n"))
        assert [r.n for r in out.orderBy("window_start").collect()] == want


def test_windows_of_an_element(spark):
    df = spark.range(500).select(F.timestamp_millis(F.col("id") * 77_000).alias("ts"))
    assert windows.window_into(df, windows.FixedWindows("1 hour"), "ts").count() == 500
    assert windows.window_into(df, windows.SlidingWindows("3 hours", "1 hour"), "ts").count() == 1500
    assert windows.window_into(df, windows.GlobalWindow(), "ts").columns == ["ts"]
    with pytest.raises(ValueError):
        windows.window_into(df, windows.Sessions("1 hour"), "ts")


def test_tables_keep_schemas_apart(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    kv = spark.createDataFrame([("a", [1, 2]), ("b", [])], "key string, value array<int>")
    tables.write("one", kv)
    tables.write("two", spark.createDataFrame([], "value string"))
    assert sorted(map(tuple, tables.scan("one").collect())) == [("a", [1, 2]), ("b", [])] and tables.scan("two").count() == 0
    with pytest.raises(KeyError, match="schema not found"):
        tables.scan("three")
    with pytest.raises(TypeError):
        tables.write("one", spark.range(1))
    assert [record_shape(d.schema) for d in (kv, kv.select("value"), spark.range(1), kv.select("key", F.size("value").alias("value")), kv.select("key", F.lit(1).alias("n")))] == ["gbk", "iterable", "primitive", "kv", "row"]


def test_managed_configuration_is_checked(spark):
    with pytest.raises(ValueError, match="unknown system"):
        managed.read(spark, "nothing", {})
    with pytest.raises(ValueError, match="needs"):
        managed.read(spark, "postgres", {"url": "jdbc:x"})


def test_offset_ranges_split_without_loss():
    whole = OffsetRange(3, 100)
    for n in (1, 3, 7, 500):
        assert [i for p in whole.split(n) for i in range(p.start, p.stop)] == list(range(3, 100))
    assert whole.truncate(10) == OffsetRange(3, 10)


def test_pipelines(spark):
    p = Pipeline("p")
    p.step("make", "beam:transform:create:v1", lambda: spark.range(10))
    p.step("split", "beam:transform:pardo:v1", lambda df: core.tagged_outputs(df, F.when(F.col("id") < 3, "low").otherwise("high"), ["low", "high"]), "make")
    p.step("both", "beam:transform:flatten:v1", core.flatten, "split:low", "split:high")
    seen = {}
    job = Job(p, {"split:low": lambda df: seen.update(low=df.count()), "both": lambda df: seen.update(both=df.count())}).run()
    assert seen == {"low": 3, "both": 10} and job.state is State.DONE and [s for _, s in job.history][-1] is State.DONE
    assert '"split" -> "both" [label="low"];' in p.dot() and p.consumers("make") == ["split"]
    with pytest.raises(ValueError):
        p.step("both", "beam:transform:flatten:v1", core.flatten)
    with pytest.raises(ValueError, match="unknown transforms"):
        Job(Pipeline("q").step("x", "beam:transform:nothing:v1", lambda: None), {})
    with pytest.raises(ValueError, match="requirements"):
        Job(Pipeline("q", requirements=("beam:requirement:other:v1",)), {})
    failing = Job(Pipeline("q").step("x", "beam:transform:create:v1", lambda: 1 / 0), {"x": lambda df: None})
    with pytest.raises(ZeroDivisionError):
        failing.run()
    assert failing.state is State.FAILED and failing.messages


def test_metrics(spark):
    m = Metrics("m", n=Metrics.counter(), big=Metrics.counter(F.col("id") > 6), d=Metrics.distribution("id"), g=Metrics.gauge("id", "id"), e=Metrics.extremes("id", 2), h=Metrics.histogram("id", [3, 7]), t=Metrics.total("id"))
    assert m.observe(spark.range(10)).count() == 10
    got = m.get()
    assert (got["n"], got["big"], got["d"], got["g"], got["t"]) == (10, 3, {"count": 10, "sum": 45, "min": 0, "max": 9}, 9, 45)
    assert got["e"] == {"top": [9, 8], "bottom": [0, 1]} and got["h"] == {"0": 3, "1": 4, "2": 3}


def test_types_there_and_back(spark):
    row = ty.FieldType("row", parts=(("a", ty.FieldType("int64")), ("b", ty.FieldType("array", True, (ty.FieldType("string", True),))), ("c", ty.FieldType("map", parts=(ty.FieldType("string"), ty.FieldType("double", True)))), ("d", ty.decimal(20, 4)), ("e", ty.FieldType("row", True, (("x", ty.FieldType("bytes")),)))))
    s = ty.schema(row)
    assert s.simpleString() == "struct<a:bigint,b:array<string>,c:map<string,double>,d:decimal(20,4),e:struct<x:binary>>"
    assert s["d"].metadata["logical"] == "decimal" and ty.schema(ty.from_spark(s)) .simpleString() == s.simpleString()
    with pytest.raises(ValueError):
        ty.to_spark(ty.FieldType("logical", urn="nothing"))
    df = spark.createDataFrame([("abc",), (None,)], "v string")
    assert df.select(ty.fits(F.col("v"), "var_char", 3)).count() == 2
    with pytest.raises(Exception, match="doesn't fit"):
        df.select(ty.fits(F.col("v"), "fixed_char", 2)).collect()


def test_expansion_checks_its_configuration(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    got = sorted((r.k, r.v) for r in expand("streamtable:top:v1", {"keys": ["k"], "order": "v", "n": 1}, df).collect())
    assert got == [("a", 2), ("b", 3)] and discover()["streamtable:combine:v1"] == {"keys": "list", "combiner": "str", "value": "str?", "name": "str?"}
    for urn, config, error in (("nothing", {}, ValueError), ("streamtable:top:v1", {"keys": ["k"]}, ValueError), ("streamtable:filter:v1", {"predicate": 1}, TypeError), ("streamtable:flatten:v1", {"x": 1}, ValueError)):
        with pytest.raises(error):
            expand(urn, config, df)


def test_co_groups_keep_null_keys(spark):
    a = spark.createDataFrame([(None, 1), (1, 2), (None, 3)], "k int, x int")
    b = spark.createDataFrame([(None, 4), (2, 5)], "k int, y int")
    got = sorted(((r.k, r.xs, r.ys) for r in joins.co_group_by_key({"xs": (a, "x"), "ys": (b, "y")}, "k").collect()), key=str)
    assert got == [(1, [2], []), (2, [], [5]), (None, [1, 3], [4])]


def test_range_join_of_long_and_short_ranges(spark):
    points = spark.createDataFrame([(float(i),) for i in range(-50, 200, 3)], "at double")
    spans = [(0.0, 0.0), (-1000.0, 1000.0), (5.0, 4.0), (1.5, 7.0), (10.0, 10.5), (None, 3.0), (100.0, 163.0)]
    df = spark.createDataFrame(spans, "low double, high double")
    got = sorted((r.at, r.low, r.high) for r in joins.range_join(points, df, "at", "low", "high", 2.0).collect())
    assert got == sorted((float(i), a, b) for i in range(-50, 200, 3) for a, b in spans if a is not None and a <= i <= b)
    assert joins.range_join(points, df.limit(0), "at", "low", "high", 2.0).collect() == []


def test_panes_take_null_elements(spark):
    import datetime

    from streamtable.streaming import replay
    from streamtable.streaming.stateful import fire_panes
    from streamtable.streaming.triggers import DISCARDING, ElementCount, Repeat, Strategy

    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame([("a", at(1), 5), ("a", at(2), None), ("a", at(3), None), ("a", at(4), 7)], "k string, ts timestamp, v bigint")
    out = replay.run(fire_panes(replay.staged(df, "ts", 1), ["k"], "v", "ts", "bigint", Strategy(Repeat(ElementCount(2)), DISCARDING))).orderBy("pane_index").collect()
    assert [(r.k, r.pane_index, r.value) for r in out] == [("a", 0, 5), ("a", 1, 7)]


def test_a_join_broadcasts_only_a_side_that_measures_little(spark, monkeypatch):
    few, many = spark.range(10).select("id", F.lit("few").alias("a")), spark.range(1000).select(F.col("id").alias("k"), F.lit("many").alias("b"))
    plan = lambda how="inner": joins.equi_join(few, many, few["id"] == many["k"], how, "broadcast")._jdf.queryExecution().optimizedPlan().toString()
    assert "leftHint=(strategy=broadcast)" in plan() and "rightHint" not in plan()  # the smaller side, also where the larger one stands right
    assert "rightHint=(strategy=broadcast)" in plan("left") and "leftHint=(strategy=broadcast)" in plan("right")
    assert "Hint" not in plan("full")
    monkeypatch.setattr(joins, "BROADCAST_BYTES", joins.rows_bytes(few) - 1)
    assert "Hint" not in plan() and "Hint" not in plan("left")
    assert joins.equi_join(few, many, few["id"] == many["k"], "inner", "broadcast").count() == 10


def test_panes_keep_state_for_shares_of_the_keys(spark):
    from streamtable.streaming import replay
    from streamtable.streaming.stateful import SHARES, fire_panes
    from streamtable.streaming.triggers import DISCARDING, ElementCount, Repeat, Strategy

    big = (1 << 53) + 1
    keys = [(None, None), (big, None), (big, "x"), (None, "x"), (0, ""), (-1, "y"), *((k, "z") for k in range(300))]
    df = spark.createDataFrame([(a, b, v, at(m)) for a, b in keys for m, v in enumerate([big, None, 1])], "a bigint, b string, v bigint, ts timestamp")
    panes = fire_panes(replay.staged(df, "ts", 1, flush=False), ["a", "b"], "v", "ts", "bigint", Strategy(Repeat(ElementCount(3)), DISCARDING))
    rows = []
    query = panes.writeStream.foreachBatch(lambda out, _: rows.extend(out.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(((r.a, r.b) for r in rows), key=repr) == sorted(keys, key=repr)
    assert {(r.window_end, r.value, r.pane_index) for r in rows} == {(None, big + 1, 0)}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= SHARES


def test_sessions_by_timer_of_users_without_id_and_below_zero(spark, tmp_path):
    from streamtable.plans.catalogue import QUERIES

    df = spark.createDataFrame([(k, at(m), u, "view", 1.0) for k, (u, m) in enumerate([(None, 0), (None, 29), (None, 59), (-5, 1), (-5, 2), (7, 0), (7, 30)])], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = [(r.user_id, (r.end_ms - r.start_ms) // 60_000, r.n) for r in QUERIES["stream_timer"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted([(None, 59, 2), (None, 30, 1), (-5, 31, 2), (7, 30, 1), (7, 30, 1)], key=repr)
