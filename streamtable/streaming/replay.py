"""Bounded collections as streams: staged as files, a few a micro-batch, and run until all is read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from streamtable.sources.scratch import scratch

FAR = "2099-01-01"  # event time of the row that moves the watermark past all windows
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def staged(df: DataFrame, ts: str, batches: int = 3, flush: bool = True) -> DataFrame:
    """A stream of the rows of df in the order of ts, in so many micro-batches. Times without a zone become those of the session's zone.

    flush adds a batch with one row far in the future, so that all windows end, as they do for bounded input; its own never fires.
    """
    spark = df.sparkSession
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    path = scratch(spark, "stream")
    cuts = df.select(F.percentile_approx(F.unix_micros(ts), [k / batches for k in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    place = sum((F.coalesce((F.unix_micros(ts) > c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
    for k in range(len(cuts) + 1):  # one after the other: files are read in the order of their times
        df.where(place == k).coalesce(1).write.parquet(f"{path}/{k:06d}")
    if flush:
        row = spark.range(1).select(*(F.lit(FAR).cast("timestamp").alias(c) if c == ts else F.lit(None).cast(t).alias(c) for c, t in df.dtypes))
        row.coalesce(1).write.parquet(f"{path}/flush")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def run(stream: DataFrame, mode: str = "append", batch_ids: bool = False) -> DataFrame:
    """All that a stream gives until its input ends, as a bounded DataFrame; each batch is written once under its id."""
    spark = stream.sparkSession
    out = scratch(spark, "out")

    def write(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/{batch_id}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = StructType(stream.schema.fields).add("batch_id", IntegerType())
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df = spark.createDataFrame([], schema)
    else:
        df = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)
    return df if batch_ids else df.drop("batch_id")


def to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """A stream kept as a table of the session's catalogue, up to now."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(stream.sparkSession, "checkpoint")).trigger(availableNow=True).toTable(name)
    query.awaitTermination()
    return stream.sparkSession.table(name)


@dataclass
class Add:
    rows: list[tuple]


@dataclass
class AdvanceWatermark:
    to: str


@dataclass
class AdvanceProcessingTime:
    """Kept for the order of events: each event is its own micro-batch, so processing time passes with it."""

    millis: int


class TestStream:
    """Replays events, one micro-batch each: elements, and watermarks as rows that carry only their time."""

    __test__ = False

    def __init__(self, spark: SparkSession, schema: str, ts: str):
        self.spark, self.schema, self.ts, self.events = spark, StructType.fromDDL(schema), ts, []

    def add(self, *rows: tuple) -> TestStream:
        self.events.append(Add(list(rows)))
        return self

    def advance_watermark(self, to: str) -> TestStream:
        self.events += [AdvanceWatermark(to)] * 2  # Spark drops what is late by the watermark of the batch before
        return self

    def advance_to_infinity(self) -> TestStream:
        return self.advance_watermark(FAR)

    def stream(self) -> DataFrame:
        """The stream; rows that only advance the watermark have _mark set, and are to be dropped after withWatermark."""
        path = scratch(self.spark, "teststream")
        marked = StructType(self.schema.fields).add("_mark", BooleanType())
        for k, event in enumerate(e for e in self.events if not isinstance(e, AdvanceProcessingTime)):
            if isinstance(event, Add):
                df = self.spark.createDataFrame([(*r, False) for r in event.rows], marked)
            else:
                df = self.spark.range(1).select(*(F.lit(event.to).cast("timestamp").alias(f.name) if f.name == self.ts else F.lit(True).alias("_mark") if f.name == "_mark" else F.lit(None).cast(f.dataType).alias(f.name) for f in marked))
            df.coalesce(1).write.parquet(f"{path}/{k:06d}")
        return self.spark.readStream.schema(marked).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)

