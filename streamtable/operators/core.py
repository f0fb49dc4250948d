"""Sources in memory and element-wise transforms. Collections are DataFrames; elements without fields are a column value."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def impulse(spark: SparkSession) -> DataFrame:
    """One element: an empty byte string."""
    return spark.range(1).select(F.lit(b"").alias("value"))


def create(spark: SparkSession, rows: Iterable, schema: str | StructType) -> DataFrame:
    """Literal elements. The schema is declared, so an empty collection is legal and rows that don't fit are refused."""
    return spark.createDataFrame(list(rows), schema)


def map_elements(df: DataFrame, *columns: Column) -> DataFrame:
    """One element for each."""
    return df.select(*columns)


def flat_map(df: DataFrame, array: Column, name: str = "value", *keep: str) -> DataFrame:
    """An element for each item of an array expression."""
    return df.select(*keep, F.explode(array).alias(name))


def filter_by(df: DataFrame, predicate: Column | str) -> DataFrame:
    return df.where(predicate)


def par_do(df: DataFrame, do: Callable[[Iterator], Iterator], schema: str | StructType) -> DataFrame:
    """Opaque code over Arrow record batches of a bundle, for what column expressions can't say."""
    return df.mapInArrow(do, schema)


def tagged_outputs(df: DataFrame, tag: Column, tags: Iterable[str], share: bool = False) -> dict[str, DataFrame]:
    """Several outputs of one transform, by tag. share keeps the tagged elements for outputs that are computed one after the other."""
    marked = df.withColumn("_tag", tag)
    marked = marked.persist() if share else marked
    return {t: marked.where(F.col("_tag") == t).drop("_tag") for t in tags}


def partition_by(df: DataFrame, index: Column, n: int) -> list[DataFrame]:
    """n outputs; an element goes to that of its index. One of none or another index is an error."""
    checked = F.when(index.between(0, n - 1), index).otherwise(F.raise_error(F.lit(f"a partition index must be from 0 to {n - 1}")).cast("int"))
    marked = df.withColumn("_part", checked)
    return [marked.where(F.col("_part") == k).drop("_part") for k in range(n)]


def with_keys(df: DataFrame, key: Column) -> DataFrame:
    """(key, value): value is the element, a struct of its fields unless it is one column."""
    value = F.col(df.columns[0]) if len(df.columns) == 1 else F.struct(*df.columns)
    return df.select(key.alias("key"), value.alias("value"))


def to_string(df: DataFrame, column: str = "value", key: str = "key") -> DataFrame:
    """(key, value): the element as text, beside its key. Structs, arrays and maps become JSON."""
    kind = df.schema[column].dataType
    text = F.to_json(column) if kind.typeName() in ("struct", "array", "map") else F.col(column).cast("string")
    return df.select(key, text.alias(column))


def flatten(*dfs: DataFrame) -> DataFrame:
    """The bag union of collections of one type; fields are matched by name, and repeated elements stay."""
    first = dfs[0]
    for other in dfs[1:]:
        if {f.name: f.dataType for f in first.schema} != {f.name: f.dataType for f in other.schema}:
            raise TypeError(f"collections of different types can't be flattened: {first.schema.simpleString()} and {other.schema.simpleString()}")
    return reduce(DataFrame.unionByName, dfs)


def reshuffle(df: DataFrame, n: int) -> DataFrame:
    """The same elements, dealt anew: a barrier between what is before and after."""
    return df.repartition(n)


def redistribute_by_key(df: DataFrame, n: int, *keys: str) -> DataFrame:
    return df.repartition(n, *keys)


def time_sorted(df: DataFrame, do: Callable[[Iterator], Iterator], schema: str | StructType, keys: list[str], *order: str) -> DataFrame:
    """Opaque code that sees all elements of a key one after the other, in an order; keys follow each other within a bundle."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(do, schema)
