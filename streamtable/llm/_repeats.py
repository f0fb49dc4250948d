"""Two Bloom filters, for hashes seen once and hashes seen twice, built by hash range.

Tasks send each distinct hash of theirs once (8 bytes) to the range that owns it; there are as many ranges as the measured size
of the texts asks for, so that a range's hashes fit a task. The range's task adds what it sees to a filter "once", and what that
filter already holds to a filter "twice". Only the latter leaves the task. While all ranges together keep to max_bits, they are
broadcast. Beyond that, hashes go to the filter of their range, and what passes comes back to its row; a range with very many
questions is asked in several tasks. Either way the filters let one in thousands pass wrongly, at every size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamtable.llm import _words
from streamtable.llm._store import deal, held, stored, tidy

BITS = 1 << 28  # 32 MB: what is broadcast at most
RANGE = 1 << 27  # bytes of text for which there is a range, at most
LITTLE = 1 << 24  # as much is not shared by two
ASKED = 1 << 20  # questions that a task answers for a range
PER = 24  # bits of a filter for each hash, of which one in 8,000 passes wrongly
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], dtype=np.uint64)
BLOCKS = pa.schema([("shard", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
BLOCKS_DDL = "shard int, once binary, more binary"


def places(h: np.ndarray, log2: int) -> list[np.ndarray]:
    return [(h * m) >> np.uint64(64 - log2) for m in MULTIPLIERS]


class Bloom:
    def __init__(self, log2: int, words: np.ndarray | None = None):
        self.log2, self.words = log2, np.zeros(1 << (log2 - 3), np.uint8) if words is None else words

    def add(self, h: np.ndarray) -> None:
        for p in places(h, self.log2):
            np.bitwise_or.at(self.words, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        return found(self.words, h, np.uint64(64 - self.log2), np.int64(0))


def found(words: np.ndarray, h: np.ndarray, shift: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Whether all places of each hash are set. A place is read only of those whose places so far are; shift and base: one for all or one for each."""
    at, out = np.arange(len(h)), np.zeros(len(h), bool)
    for m in MULTIPLIERS:
        p = (h * m) >> shift
        yes = np.flatnonzero(words[(p >> np.uint64(3)).astype(np.int64) + base] >> (p & np.uint64(7)).astype(np.uint8) & 1)
        at, h = at[yes], h[yes]
        shift, base = (x[yes] if x.ndim else x for x in (shift, base))
    out[at] = True
    return out


def log2_for(n: int, per: int) -> int:
    return max(10, int(max(1, n * per - 1)).bit_length())


class Blocks:
    """Gathers a task's hashes, each as often as it counts, and gives them by range."""

    def __init__(self, shards: int, limit: int = 1 << 20):
        self.shards, self.limit, self.kept, self.n = shards, limit, [], 0

    def add(self, h: np.ndarray):
        self.kept.append(h)
        self.n += len(h)
        return self.flush() if self.n >= self.limit else []

    def flush(self) -> list[pa.RecordBatch]:
        if not self.n:
            return []
        h, count = np.unique(np.concatenate(self.kept), return_counts=True)
        self.kept, self.n = [], 0
        shard = shard_of(h, self.shards)  # rises with h
        cut = np.searchsorted(shard, np.arange(self.shards + 1))
        rows = [(i, h[a:b], count[a:b] > 1) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        return [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1][~r[2]].tobytes() for r in rows], pa.binary()), pa.array([r[1][r[2]].tobytes() for r in rows], pa.binary())], schema=BLOCKS)]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


class Repeats:
    """The filters "twice" of all ranges, to be broadcast."""

    def __init__(self, shards: int, parts: dict[int, tuple[int, bytes]]):
        self.shards, self.parts = shards, parts
        # one after the other behind a byte of nothing, which ranges without a filter read
        self.words = np.frombuffer(b"\0" + b"".join(b for _, b in parts.values()), np.uint8)
        self.shift, self.base = np.full(shards, 63, np.uint64), np.zeros(shards, np.int64)
        ends = np.cumsum([1, *(len(b) for _, b in parts.values())])
        for (k, (log2, _)), end in zip(parts.items(), ends.tolist(), strict=False):
            self.shift[k], self.base[k] = 64 - log2, end

    @property
    def state(self) -> tuple[int, dict[int, tuple[int, bytes]]]:
        """Plain values for a broadcast, from which executors make it anew."""
        return self.shards, self.parts

    def has(self, h: np.ndarray) -> np.ndarray:
        k = shard_of(h, self.shards)
        return found(self.words, h, self.shift[k], self.base[k])


class Maybe:
    """Tells hashes that the range's filter has let pass."""

    def __init__(self, column: pa.Array):
        self.h = np.unique(np.frombuffer(b"".join(x for x in column.to_pylist() if x), np.uint64))

    def has(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.h, h)
        return at < len(self.h) if not len(self.h) else self.h[np.minimum(at, len(self.h) - 1)] == h


class Test:
    """Gives, for the column "maybe" of a batch, what tells the hashes of its rows that may be repeated."""

    def __init__(self, shared=None):
        self.shared, self.own = shared, None

    def __call__(self, column: pa.Array):
        if self.shared is None:
            return Maybe(column)
        if self.own is None:
            self.own = Repeats(*self.shared.value)
        return self.own

    def __reduce__(self):
        return Test, (self.shared,)


def suspected(rows: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], max_bits: int = BITS) -> tuple[DataFrame, Test]:
    """rows, whose last column is text, with a column "maybe" for the test that comes with them.

    hashes: gives, for bytes and offsets of some texts, hashes, each as often as it counts, and where those of each text begin. The first column
    of rows is their id.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, min(deal(spark), math.ceil(size / LITTLE)), math.ceil(size / RANGE))

    def told(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            for row, data, offs in _words.pieces(batch.column(batch.num_columns - 1)):
                yield batch, row, *hashes(data, offs)

    def send(batches):
        out = Blocks(shards)
        for _, _, h, _ in told(batches):
            if len(h):
                yield from out.add(h)
        yield from out.flush()

    def build(batches):
        now, kept = None, []

        def filtered():
            once, twice = Bloom(log2_for(sum(len(a) + len(b) for a, b in kept) // 8, PER)), []
            for a, b in kept:
                h, sure = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                twice += [sure, h[once.has(h)]]
                once.add(h)
                once.add(sure)
            found = np.unique(np.concatenate(twice))
            if len(found):
                bloom = Bloom(log2_for(len(found), PER))
                bloom.add(found)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "log2": pa.array([bloom.log2], pa.int32()), "words": pa.array([bloom.words.tobytes()], pa.binary())})

        for batch in batches:
            for shard, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    if kept:
                        yield from filtered()
                    now, kept = shard, []
                kept.append((once, more))
        if kept:
            yield from filtered()

    sent = rows.select("text").mapInArrow(tidy(send), BLOCKS_DDL).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    filters = held(sent.mapInArrow(tidy(build), "shard int, log2 int, words binary"))
    if 8 * (filters.agg(F.sum(F.octet_length("words"))).first()[0] or 0) <= max_bits:
        parts = {r["shard"]: (r["log2"], bytes(r["words"])) for r in filters.collect()}
        return rows.withColumn("maybe", F.lit(None).cast("binary")), Test(spark.sparkContext.broadcast((shards, parts)))

    key = rows.columns[0]
    tag = F.xxhash64("text")

    def ask(batches):
        for batch, row, h, begin in told(batches):
            out = []
            for k, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
                if a == b:
                    continue
                own = np.unique(h[a:b])
                where = shard_of(own, shards)
                cut = np.flatnonzero(np.diff(where, prepend=-1))
                out += [(row + k, int(where[x]), own[x:y].tobytes()) for x, y in zip(cut, np.append(cut[1:], len(own)), strict=True)]
            if out:
                at = pa.array([x[0] for x in out], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in out], pa.int32()), batch.column(0).take(at), batch.column(1).take(at), pa.array([x[2] for x in out], pa.binary())], names=["shard", "id", "tag", "h"])

    kind = rows.schema[key].dataType.simpleString()
    asks = stored(rows.select(F.col(key).alias("id"), tag.alias("tag"), F.col("text")).mapInArrow(tidy(ask), f"shard int, id {kind}, tag bigint, h binary"))
    many = F.broadcast(stored(asks.groupBy("shard").count().where(F.col("count") > ASKED).select("shard", F.ceil(F.col("count") / ASKED).cast("int").alias("k"))))
    times = F.coalesce("k", F.lit(1))
    come = asks.join(many, "shard", "left").select("shard", F.pmod("tag", times).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "tag", "h")
    have = filters.join(many, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), times - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("id"), F.col("log2").cast("bigint").alias("tag"), F.col("words").alias("h"))

    def answer(batches):
        now, bloom = None, None
        for batch in batches:
            out = []
            for k, (shard, salt, kind, tag, h) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5)), strict=True)):
                if not kind:
                    now, bloom = (shard, salt), Bloom(tag, np.frombuffer(h, np.uint8))
                elif now == (shard, salt):
                    h = np.frombuffer(h, np.uint64)
                    if len(h := h[bloom.has(h)]):
                        out.append((k, h.tobytes()))
            if out:
                at = pa.array([k for k, _ in out], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(3).take(at), batch.column(4).take(at), pa.array([h for _, h in out], pa.binary())], names=["id", "tag", "h"])

    met = have.unionByName(come).repartition(max(shards, deal(spark)), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    back = met.mapInArrow(tidy(answer), f"id {kind}, tag bigint, h binary").groupBy(F.col("id").alias("_id"), F.col("tag").alias("_tag")).agg(F.collect_list("h").alias("_hs"))
    joined = rows.withColumn("_own", tag).join(back, F.col(key).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_tag")), "left")
    parts = F.transform("_hs", lambda h: F.hex(h))
    return joined.select(*rows.columns, F.unhex(F.array_join(parts, "")).alias("maybe")), Test()
