"""Tables, files, splittable sources, jobs and metrics."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from streamtable.functions.codecs import Pane, PaneCoder, Windowed, decode_column, encode_column, resolve
from streamtable.operators import core, grouping
from streamtable.plans.pipeline import Job, Pipeline
from streamtable.plans.registry import query
from streamtable.sources import managed
from streamtable.sources.ranges import OffsetSource
from streamtable.sources.scratch import scratch
from streamtable.sources.tables import Tables


@query("select n_nationkey, n_name from nation union all select n_nationkey, n_name from nation where n_regionkey = 1")
def collection_write_scan(t, spark):
    tables = Tables(spark)
    nations = t("nation").select("n_nationkey", "n_name")
    tables.write("nations", nations)
    tables.write("nations", t("nation").where("n_regionkey = 1").select("n_nationkey", "n_name"))
    return tables.scan("nations")


@query("select n_regionkey, count(*) as n from nation group by 1")
def materialized_view(t, spark):
    tables = Tables(spark)
    tables.write("nations_by_region", grouping.count_per_element(t("nation").select("n_regionkey"), "n_regionkey"))
    tables.view("nations_by_region")
    return spark.sql("select * from nations_by_region")


@query("select strftime(time_bucket(interval 7 days, ts, timestamp '1970-01-01'), '%Y-%m-%dT%H-%M-%S') as window_start, event_type, count(*) as n from events group by 1, 2")
def write_files_windowed(t, spark):
    path = scratch(spark, "files")
    managed.write_files(t("events"), path, window=F.window("ts", "7 days"), shards=4)
    return managed.read(spark, "parquet", {"path": path}).groupBy(F.date_format("window_start", "yyyy-MM-dd'T'HH-mm-ss").alias("window_start") if dict(managed.read(spark, "parquet", {"path": path}).dtypes)["window_start"] != "string" else "window_start", "event_type").agg(F.count("*").alias("n"))


def _managed(form):
    @query("select c_custkey, c_name from customer", f"managed_{form}")
    def run(t, spark):
        path = scratch(spark, form)
        rows = t("customer").select("c_custkey", "c_name")
        managed.write(rows, form, {"path": path})
        return managed.read(spark, form, {"path": path, "schema": "c_custkey bigint, c_name string"})


for _f in ("parquet", "csv", "json", "orc"):
    _managed(_f)


@query("select n_name as value from nation")
def managed_text(t, spark):
    path = scratch(spark, "text")
    managed.write(t("nation").select("n_name"), "text", {"path": path})
    return managed.read(spark, "text", {"path": path})


@query("select i as id, 'element ' || i as value from range(1000) r(i)")
def splittable_source(t, spark):
    spark.dataSource.register(OffsetSource)
    return spark.read.format("offsets").options(stop=1000, splits=8).load()


@query("select i as id, 'element ' || i as value from range(250) r(i)")
def splittable_source_stream(t, spark):
    spark.dataSource.register(OffsetSource)
    path, place = scratch(spark, "out"), scratch(spark, "checkpoint")
    q = spark.readStream.format("offsets").options(stop=250, step=100).load().writeStream.format("parquet").option("checkpointLocation", place).start(path)
    ends = time.monotonic() + 600
    while not (q.lastProgress and reached(q.lastProgress) >= 250):  # a drain: stop once the range is read
        if q.exception() or time.monotonic() > ends:
            q.stop()
            raise RuntimeError(f"the range wasn't read: {q.exception() or 'no progress'}")
        time.sleep(0.25)
    q.stop()
    return spark.read.schema("id bigint, value string").parquet(path)


def reached(progress) -> int:
    """The position in a progress report, whose offsets are text."""
    return max(map(int, re.findall(r"\d+", str(progress["sources"][0]["endOffset"]))), default=0)


@query("select l_orderkey, l_quantity from lineitem where l_quantity > 49 and l_shipdate >= timestamp '1998-01-01'")
def scan_pushdown(t, spark):
    return t("lineitem").where("l_quantity > 49 and l_shipdate >= timestamp_ntz'1998-01-01'").select("l_orderkey", "l_quantity")


@query("select o_orderstatus as status, count(*) as n from orders group by 1")
def job_pipeline(t, spark):
    p = Pipeline("orders by status")
    p.step("read", "beam:transform:read:v1", lambda: t("orders"))
    p.step("status", "beam:transform:pardo:v1", lambda df: df.select(F.col("o_orderstatus").alias("status")), "read")
    p.step("count", "beam:transform:combine_per_key:v1", lambda df: grouping.count_per_element(df, "status"), "status")
    path = scratch(spark, "job")
    Job(p, {"count": lambda df: df.write.parquet(path)}).run()
    return spark.read.parquet(path)


@query("select * from (values (0, 'stopped'), (1, 'starting'), (2, 'running'), (3, 'done'), (4, 'stopped'), (5, 'starting'), (6, 'running'), (7, 'failed'), (8, 'stopped'), (9, 'cancelled')) v(i, state)")
def job_states(t, spark):
    """The histories of a job that ends, of one whose step fails, and of one that is cancelled before it runs."""

    def job(step):
        p = Pipeline("states")
        p.step("read", "beam:transform:read:v1", lambda: t("region"))
        p.step("use", "beam:transform:pardo:v1", step, "read")
        return Job(p, {"use": lambda df: df.write.format("noop").mode("overwrite").save()})

    fine, bad, gone = job(lambda df: df), job(lambda df: df.select(F.raise_error(F.lit("no")).alias("x"))), job(lambda df: df)
    fine.run()
    try:
        bad.run()
    except Exception:  # what the state then tells
        pass
    gone.cancel()
    return core.create(spark, list(enumerate(s.value for j in (fine, bad, gone) for _, s in j.history)), "i int, state string")


@query("select count(*) as elements, sum(case when value > 50 then 1 else 0 end)::bigint as large, round(min(value), 4) as least, round(max(value), 4) as most from events")
def job_metrics(t, spark):
    from streamtable.plans.metrics import Metrics

    m = Metrics("events", elements=Metrics.counter(), large=Metrics.counter(F.col("value") > 50), value=Metrics.distribution("value"))
    m.observe(t("events")).write.format("noop").mode("overwrite").save()
    got = m.get()
    return core.create(spark, [(got["elements"], got["large"], round(got["value"]["min"], 4), round(got["value"]["max"], 4))], "elements bigint, large bigint, least double, most double")


@query("""select c_custkey as key, case when c_custkey < 128 then printf('%02X', c_custkey) when c_custkey < 16384 then printf('%02X%02X', c_custkey % 128 + 128, c_custkey // 128)
    else printf('%02X%02X%02X', c_custkey % 128 + 128, c_custkey // 128 % 128 + 128, c_custkey // 16384) end as key_hex, printf('%02X', octet_length(encode(c_name))) || hex(encode(c_name)) as name_hex from customer""")
def codec_bytes(t, spark):
    return t("customer").select(F.col("c_custkey").alias("key"), F.hex(encode_column("varint", "c_custkey")).alias("key_hex"), F.hex(encode_column("string_utf8", "c_name")).alias("name_hex"))


@query("select c_custkey as key, upper(hex(encode(c_name))) as name_hex from customer")
def codec_round_trip(t, spark):
    coded = t("customer").select(encode_column("varint", "c_custkey").alias("k"), encode_column("string_utf8", "c_name").alias("v"))
    return coded.select(decode_column("varint", "k", "bigint").alias("key"), F.hex(decode_column("string_utf8", "v", "string")).alias("name_hex"))


_KV = ("kv", "string_utf8", "varint")
# Encodings that are part of the wire format.
_ENCODED = [
    ("bool", True, "01"),
    ("bool", False, "00"),
    ("varint", -1, "FFFFFFFFFFFFFFFFFF01"),
    ("bytes", bytes([1, 2, 3]), "03010203"),
    ("double", 0.5, "3FE0000000000000"),
    ("kv", ("abc", 10), "036162630A"),
    ("iterable", [1, 10, 200, 1000], "00000004010AC801E807"),
    ("nullable", None, "00"),
    ("nullable", 200, "01C801"),
    ("length_prefix", 200, "02C801"),
    ("interval_window", (0, 1000), "80000000000003E8E807"),
    ("pane", Pane(), "0F"),
    ("windowed_value", Windowed(2, 0), "8000000000000000000000010F02"),
    ("sharded_key", (b"shard", "key"), "057368617264036B6579"),
]
_SPECS = {"kv": _KV, "iterable": ("iterable", "varint"), "nullable": ("nullable", "varint"), "length_prefix": ("length_prefix", "varint"), "windowed_value": ("windowed_value", "varint", "global_window"), "sharded_key": ("sharded_key", "string_utf8")}


@query("select * from (values " + ", ".join(f"({i}, '{name}', '{data}', true)" for i, (name, _, data) in enumerate(_ENCODED)) + ") v(i, codec, encoded, same)")
def codec_vectors(t, spark):
    """Each codec's bytes for a value, and whether they give the value back."""
    rows = []
    for i, (name, value, _) in enumerate(_ENCODED):
        coder = PaneCoder() if name == "pane" else resolve(_SPECS.get(name, name))
        data = coder.encode(value)
        rows.append((i, name, data.hex().upper(), coder.decode(data) == value))
    return core.create(spark, rows, "i int, codec string, encoded string, same boolean")
