"""Reads and writes by the name of a system, with one configuration form for all: format names map onto Spark's data sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name of a managed system: (Spark format, options that must be given). Systems beyond files need their connector on Spark's class path.
SYSTEMS: dict[str, tuple[str, tuple[str, ...]]] = {
    **{f: (f, ("path",)) for f in ("parquet", "csv", "json", "orc", "text")},
    "avro": ("avro", ("path",)),
    "iceberg": ("iceberg", ("table",)),
    "iceberg_cdc": ("iceberg", ("table", "start-snapshot-id")),
    "kafka": ("kafka", ("kafka.bootstrap.servers",)),
    "bigquery": ("bigquery", ("table",)),
    "postgres": ("jdbc", ("url", "dbtable")),
    "mysql": ("jdbc", ("url", "dbtable")),
    "sqlserver": ("jdbc", ("url", "dbtable")),
    "pubsub": ("pubsub", ("topic",)),
}


def checked(system: str, config: dict) -> tuple[str, dict]:
    if system not in SYSTEMS:
        raise ValueError(f"unknown system {system}; known: {', '.join(SYSTEMS)}")
    form, needed = SYSTEMS[system]
    if missing := [k for k in needed if k not in config and not (system == "pubsub" and "subscription" in config)]:
        raise ValueError(f"{system} needs {', '.join(missing)}")
    return form, {k: str(v) for k, v in config.items() if k not in ("path", "table", "schema")}


def read(spark: SparkSession, system: str, config: dict, streaming: bool = False) -> DataFrame:
    form, options = checked(system, config)
    reader = (spark.readStream if streaming else spark.read).format(form).options(**options)
    if "schema" in config:
        reader = reader.schema(config["schema"])
    where = config.get("path") or config.get("table")
    return reader.load(where) if where else reader.load()


def write(df: DataFrame, system: str, config: dict, mode: str = "append") -> None:
    form, options = checked(system, config)
    writer = df.write.format(form).options(**options).mode(mode)
    where = config.get("path") or config.get("table")
    writer.save(where) if where else writer.save()


def write_files(df: DataFrame, path: str, form: str = "parquet", window: Column | None = None, shards: int | None = None, shard_by: list[str] | None = None, mode: str = "error") -> None:
    """Files, in a folder for each window if one is given. shards: how many files each task set writes; None lets Spark choose (AQE)."""
    if window is not None:
        df = df.withColumn("window_start", F.date_format(window["start"], "yyyy-MM-dd'T'HH-mm-ss"))
    if shards:
        df = df.repartition(shards, *(shard_by or (["window_start"] if window is not None else [])))
    writer = df.write.format(form).mode(mode)
    (writer.partitionBy("window_start") if window is not None else writer).save(path)


def timestamped(df: DataFrame, attribute: str, delay: str, id_attribute: str | None = None) -> DataFrame:
    """A message stream with event time from an attribute (milliseconds or a timestamp) and, by an id attribute, each message once within the delay."""
    if dict(df.dtypes)[attribute] in ("bigint", "int"):
        df = df.withColumn(attribute, F.timestamp_millis(attribute))
    df = df.withWatermark(attribute, delay)
    return df.dropDuplicatesWithinWatermark([id_attribute]) if id_attribute else df


def write_by_destination(df: DataFrame, destination: str, folder: str, form: str = "parquet", mode: str = "append") -> None:
    """Each row goes to the folder of its own destination, in one pass over df. For a stream, to be called for each micro-batch."""
    df.withColumn("_to", F.col(destination)).write.format(form).mode(mode).partitionBy("_to").save(folder)


def read_destination(spark: SparkSession, name: str, folder: str, form: str = "parquet") -> DataFrame:
    return spark.read.format(form).load(folder).where(F.col("_to") == name).drop("_to")
