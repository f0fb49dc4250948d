"""Side inputs, co-grouping and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

SIDE_BYTES = 64 << 20  # of an iterable side input, as measured; larger ones are refused
BROADCAST_BYTES = 32 << 20  # of a side that a join broadcasts, as measured; the driver builds it and holds it some times over
BROADCAST_SIDES = {"inner": ("right", "left"), "cross": ("right", "left"), "right": ("left",), "rightouter": ("left",), "right_outer": ("left",), "full": (), "outer": (), "fullouter": (), "full_outer": ()}  # others: the right one


def measured_bytes(df: DataFrame, column: str) -> int:
    """The size of a column's values as text, from a run over df: estimates are wrong above explodes and for compressed files."""
    return int(df.agg(F.sum(F.coalesce(F.octet_length(F.col(column).cast("string")), F.lit(0)) + 8)).first()[0] or 0)


def rows_bytes(df: DataFrame) -> int:
    """The size of the rows of df, from a run over it: 8 bytes for each row and value, and what texts and nested values have as text."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    return int(df.agg(F.sum(sum(wide, F.lit(8 + 8 * len(df.columns)).cast("bigint")))).first()[0] or 0)


def singleton_side_input(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a one-row collection. No row gives nulls; several are an error, found when the plan runs."""
    columns = one.columns
    single = one.agg(*(F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a singleton side input has more than one element")).cast(one.schema[c].dataType)).otherwise(F.max(F.struct(F.col(c).alias("x")))["x"]).alias(c) for c in columns))
    return df.crossJoin(F.broadcast(single))


def iterable_side_input(df: DataFrame, many: DataFrame, column: str, name: str) -> DataFrame:
    """df with the whole of a column of a small collection as a sorted array in each row. A collection beyond SIDE_BYTES is refused: join it."""
    if measured_bytes(many, column) > SIDE_BYTES:
        raise ValueError("this collection is too large for an iterable side input; use a join")
    return df.crossJoin(F.broadcast(many.agg(F.array_sort(F.collect_list(column)).alias(name))))


def multimap_side_input(df: DataFrame, many: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df with the array of values of its key, sorted, empty if there are none."""
    grouped = many.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))
    joined = df.join(grouped, key, "left")  # adaptive execution broadcasts what turns out to be small
    return joined.withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))


def windowed_side_input(df: DataFrame, many: DataFrame, window: Column, side_window: Column, value: Column, name: str) -> DataFrame:
    """df with an aggregate of the side collection over the window that the main one's is mapped to."""
    by = many.groupBy(side_window.alias("_w")).agg(value.alias(name))
    return df.withColumn("_m", window).join(by, F.col("_m") == F.col("_w"), "left").drop("_m", "_w")


def co_group_by_key(sides: dict[str, tuple[DataFrame, str]], key: str, how: str = "full") -> DataFrame:
    """key and, for each side, the sorted array of its values. sides: name -> (collection with key, value column).

    how: full keeps every key; inner those in all sides; left and right those of the first and of the last one. Null is a key like others.
    """
    grouped = [df.groupBy(F.col(key).alias(f"_key{i}")).agg(F.array_sort(F.collect_list(v)).alias(n)) for i, (n, (df, v)) in enumerate(sides.items())]
    out = grouped[0].withColumnRenamed("_key0", key)
    for i, g in enumerate(grouped[1:], 1):
        out = out.join(g, F.col(key).eqNullSafe(F.col(f"_key{i}")), how).withColumn(key, F.coalesce(key, f"_key{i}"))
    return out.select(key, *(F.coalesce(n, F.array().cast(out.schema[n].dataType)).alias(n) for n in sides))


def equi_join(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner", strategy: str | None = None) -> DataFrame:
    """strategy: broadcast, merge, shuffle_hash or shuffle_replicate_nl, else what Spark finds best.

    broadcast takes the smaller of the sides that this kind of join can broadcast, if it measures BROADCAST_BYTES at most; else the join is
    what Spark finds best. All columns count, so leave out first what the result doesn't need.
    """
    if strategy == "broadcast":
        size, side = min(((rows_bytes(right if s == "right" else left), s) for s in BROADCAST_SIDES.get(how.lower(), ("right",))), key=lambda x: x[0], default=(None, None))
        if side is None or size > BROADCAST_BYTES:
            return left.join(right, on, how)
        return left.join(F.broadcast(right), on, how) if side == "right" else F.broadcast(left).join(right, on, how)
    return left.join(right.hint(strategy) if strategy else right, on, how)


def range_join(left: DataFrame, right: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= at <= high, at in left and the range in right, by an equi-join on bins.

    A range goes to bins of a width that is at least its length (width, or that times a power of four), so to two of them at most,
    and a point to its bin at each width that some range has. Ranges that end before they begin, or with a null, are in no pair.
    """
    length = F.greatest((F.col(high) - F.col(low)).cast("double") / width, F.lit(1.0))
    spans = right.where(F.col(low) <= F.col(high)).withColumn("_level", F.ceil(F.log2(length) / 2 - 1e-9).cast("int"))
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())  # no more than there are powers of four
    bin_of = lambda c: F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(4.0), F.col("_level"))))
    spans = spans.withColumn("_bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    points = left.withColumn("_level", F.explode(F.array(*(F.lit(k) for k in levels)).cast("array<int>"))).withColumn("_bin", bin_of(at))
    return points.join(spans, ["_level", "_bin"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_bin", "_level")


def as_of_join(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, name: str, tie: str | None = None) -> DataFrame:
    """left with the latest value of right at or before its own time under its key; null if there is none. One shuffle by key, no pairs.

    Right rows of equal time: the largest of tie (else of value) wins.
    """
    a = left.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(1).alias("_s"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[tie or value].dataType).alias("_o"), F.struct(*left.columns).alias("_row"))
    b = right.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(0).alias("_s"), F.col(value).alias("_v"), F.col(tie or value).alias("_o"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    before = W.partitionBy("_k").orderBy("_t", "_s", F.col("_o").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return a.unionByName(b).withColumn("_v", F.last("_v", ignorenulls=True).over(before)).where("_s = 1").select("_row.*", F.col("_v").alias(name))


def interval_join(left: DataFrame, right: DataFrame, key: str, ts: str, right_ts: str, after: str) -> DataFrame:
    """Pairs of a key with right_ts from ts up to ts plus an interval."""
    return left.join(right, key).where(F.col(right_ts).between(F.col(ts), F.col(ts) + F.expr(f"interval {after}")))
