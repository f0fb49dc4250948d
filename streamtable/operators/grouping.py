"""Grouping and combining. Known combiners are Spark aggregates, which combine before the shuffle; none first gathers a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType, StructField, StructType


def group_by_key(df: DataFrame, *keys: str, value: str = "value", sort: bool = False) -> DataFrame:
    """keys and value: the array of the key's values. Nulls are kept, as keys and as values; the order is open unless sorted."""
    values = F.transform(F.collect_list(F.struct(F.col(value).alias("v"))), lambda x: x["v"])
    return df.groupBy(*keys).agg((F.array_sort(values) if sort else values).alias(value))


def ungroup(df: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    return df.select(*keys, F.explode(value).alias(value))


# Combiners by name: (value column) -> aggregate.
COMBINERS: dict[str, Callable[[Column], Column]] = {
    "count": lambda v: F.count(F.lit(1)),
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "any": F.bool_or,
    "all": F.bool_and,
    "distinct": F.count_distinct,
    "approx_distinct": F.approx_count_distinct,
}


def combine_per_key(df: DataFrame, keys: list[str], combiner: str, value: str = "value", name: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(COMBINERS[combiner](F.col(value)).alias(name))


def combine_globally(df: DataFrame, combiner: str, value: str = "value", name: str = "value", default: Any = None) -> DataFrame:
    """One row. default stands for the result over no elements."""
    out = COMBINERS[combiner](F.col(value))
    return df.agg((out if default is None else F.coalesce(out, F.lit(default))).alias(name))


def combine_grouped_values(df: DataFrame, combiner: str, value: str = "value", name: str = "value") -> DataFrame:
    """Folds arrays that are already grouped."""
    fold = {"count": lambda v: F.size(v).cast("bigint"), "sum": lambda v: F.aggregate(v, F.lit(0).cast(df.schema[value].dataType.elementType), lambda a, x: a + F.coalesce(x, F.lit(0))), "min": F.array_min, "max": F.array_max}[combiner]
    return df.select(*[c for c in df.columns if c != value], fold(F.col(value)).alias(name))


def count_per_element(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias(name))


def top_per_key(df: DataFrame, keys: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first n elements of each key in an order, with their rank. Spark prunes each task to n a key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def latest_per_key(df: DataFrame, keys: list[str], ts: str, *tie: str) -> DataFrame:
    """The element with the largest timestamp of each key; ties go to the largest values of tie."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(ts, *tie, *[c for c in rest if c != ts and c not in tie])
    return df.groupBy(*keys).agg(F.max(by).alias("_m")).select(*keys, *(F.col(f"_m.{c}").alias(c) for c in rest))


def sample_per_key(df: DataFrame, keys: list[str], n: int, *identity: str, seed: int = 0) -> DataFrame:
    """n elements of each key, the same ones on each run: those whose identity has the least hashes."""
    return top_per_key(df, keys, n, F.xxhash64(F.lit(seed), *identity), *map(F.col, identity), rank="_r").drop("_r")


def approximate_quantiles(df: DataFrame, keys: list[str], value: str, points: list[float], accuracy: int = 10_000, name: str = "quantiles") -> DataFrame:
    return df.groupBy(*keys).agg(F.percentile_approx(value, points, accuracy).alias(name))


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct() if columns else df.distinct()


def group_into_batches(df: DataFrame, keys: list[str], size: int, *order: str, batch: str = "batch") -> DataFrame:
    """keys, batch (from 0) and elements: arrays of up to size elements of a key, in an order.

    Hot keys: give a shard in keys (sharded_key), since the numbering of a key is one task's work.
    """
    rest = [c for c in df.columns if c not in keys]
    number = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(batch, F.floor((number - 1) / size).cast("bigint")).groupBy(*keys, batch).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in rest if c not in order]))).alias("elements"))


def group_into_batches_by_bytes(df: DataFrame, keys: list[str], most: int, weight: Column, *order: str, batch: str = "batch") -> DataFrame:
    """keys, batch (from 0) and elements: a key's elements in an order, as many in a batch as together weigh no more than most, one at least.

    Where a batch ends depends on the ones before, so a key's rows pass one task in order, without being held; hot keys as in group_into_batches.
    """
    rest = [c for c in df.columns if c not in keys]
    schema = StructType([*df.schema.fields, StructField("_w", LongType()), StructField(batch, LongType())])

    def number(batches):
        now, total, n = None, 0, 0
        for b in batches:
            out = []
            for key, w in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), b.column("_w").to_pylist(), strict=True):
                if key != now:
                    now, total, n = key, w, 0
                elif total + w > most:
                    total, n = w, n + 1
                else:
                    total += w
                out.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[f.name for f in schema])

    told = df.withColumn("_w", F.coalesce(weight, F.lit(0)).cast("bigint")).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(number, schema)
    return told.groupBy(*keys, batch).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in rest if c not in order]))).alias("elements"))


def sharded_key(df: DataFrame, shards: int, *identity: str, name: str = "shard") -> DataFrame:
    """df with a shard number from the hash of what identifies an element, to be part of a hot key."""
    return df.withColumn(name, F.pmod(F.xxhash64(*identity), F.lit(shards)).cast("int"))


class CombineFn:
    """A combiner in Python: create, add, merge and extract. Accumulators must be picklable."""

    def create(self) -> Any:
        raise NotImplementedError

    def add(self, accumulator: Any, value: Any) -> Any:
        raise NotImplementedError

    def merge(self, one: Any, other: Any) -> Any:
        raise NotImplementedError

    def extract(self, accumulator: Any) -> Any:
        return accumulator


def combine_with(df: DataFrame, key: str, value: str, fn: CombineFn, result: str, name: str = "value", most: int = 100_000) -> DataFrame:
    """A Python combiner over (key, value), in two phases: accumulators per task, then merged per key. A task holds up to most keys at once.

    result is the SQL type of what extract gives. Only accumulators are shuffled, one for each key and flush of a task.
    """
    import pickle

    kind = df.schema[key].dataType

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush():
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), held_type), pa.array([pickle.dumps(a) for a in held.values()], pa.binary())], names=[key, "acc"])

        held_type = None
        for batch in batches:
            held_type = batch.column(0).type
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = fn.add(held[k] if k in held else fn.create(), v)
            if len(held) >= most:
                yield from flush()
                held = {}
        yield from flush()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, acc, some = None, None, False
        for batch in batches:
            keys, out = [], []
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if some and k == now:
                    acc = fn.merge(acc, pickle.loads(blob))
                    continue
                if some:
                    keys.append(now)
                    out.append(fn.extract(acc))
                now, acc, some = k, pickle.loads(blob), True
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(out)], names=[key, name])
            last = batch
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([now], last.column(0).type), pa.array([fn.extract(acc)])], names=[key, name])

    half = df.select(key, value).mapInArrow(partial, StructType().add(key, kind).add("acc", "binary"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = half.repartition(n, key).sortWithinPartitions(key)
    return whole.mapInArrow(final, f"`{key}` {kind.simpleString()}, `{name}` {result}")
