"""Approximate nearest neighbours by stable projections and kd-trees, with a chi-square stopping test.

Vectors are scaled to length one, so that the largest cosine is the least distance, and projected on a few Gaussian directions:
over these, the squared projected distance by the squared distance follows a chi-square law. The top of one kd-tree, fitted on a
bounded sample, deals every vector to a cell; the cell's task grows the rest of the tree. A query first goes to the cell that
it lies in, and then, with what it has found, to those other cells that the stopping test doesn't rule out. In a cell it takes
its candidates in the order of projected distance, leaf by leaf, and verifies them on the vectors; it stops once a candidate nearer
than the ones it has would, with the wanted probability, have been seen by now.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from streamtable.llm._store import deal, stored

DIMENSIONS = 8
SURE = 0.97
LEAF = 64
SHARD_ROWS = 25_000  # vectors of a cell; a larger one is dealt to several tasks by hash
CELLS = 4_096  # of the top of the tree, at most: what is broadcast
SAMPLE = 65_536  # projected vectors, about, on which the top is fitted
VISITS = 25_000  # of queries to a cell, for which one copy of its vectors is made


def chi_square(x: np.ndarray, k: int) -> np.ndarray:
    """The chi-square distribution function for an even number of degrees of freedom."""
    half, term, total = np.asarray(x, float) / 2, 1.0, 0.0
    for i in range(k // 2):
        total = total + term
        term = term * half / (i + 1)
    return 1 - np.exp(-half) * total


def projection(dim: int, k: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, k))


class KdTree:
    """Boxes of projected points: split at the median of the widest side until a leaf is small."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.nodes = points, []
        self.order = np.arange(len(points))
        stack = [(0, len(points), None, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            own = points[self.order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            me = len(self.nodes)
            self.nodes.append([low, high, a, b, None, None])
            if parent is not None:
                self.nodes[parent][4 + side] = me
            if b - a > leaf and (high > low).any():
                axis = int(np.argmax(high - low))
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
                stack += [(a, a + mid, me, 0), (a + mid, b, me, 1)]

    def leaves(self):
        """Low and high corners of the leaves' boxes, and where their points begin and end in order."""
        leaves = [x for x in self.nodes if x[4] is None]
        return tuple(np.array([x[k] for x in leaves]) for k in range(4))


def quantile(sure: float, k: int) -> float:
    """Where chi_square() is sure."""
    low, high = 0.0, 1.0
    while chi_square(np.array(high), k) < sure:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid), k) < sure else (low, mid)
    return high


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by powers of two, which changes no digit, so that squares don't overflow; and vectors of length one."""
    scaled = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return scaled, scaled / lengths(scaled)[:, None]


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


class Top:
    """The top of the tree: planes that cut space into cells, the same for all tasks."""

    def __init__(self, points: np.ndarray, cells: int):
        self.nodes: list[tuple] = []  # (axis, cut, left, right), or (cell,)
        self.cells = 0
        self.dims = points.shape[1]
        self._grow(points, cells)
        self.low, self.high = np.full((self.cells, self.dims), -np.inf), np.full((self.cells, self.dims), np.inf)
        self._bound(0, np.full(self.dims, -np.inf), np.full(self.dims, np.inf))

    def _grow(self, points: np.ndarray, cells: int) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(self.dims)
        axis = int(np.argmax(spread))
        if cells < 2 or spread[axis] <= 0:
            self.nodes[me] = (self.cells,)
            self.cells += 1
            return me
        value = np.sort(points[:, axis])
        cut = float(value[len(value) * (cells // 2) // cells])
        if cut == value[0]:
            cut = float(value[value > cut][0])
        left = points[:, axis] < cut
        self.nodes[me] = (axis, cut, self._grow(points[left], cells // 2), self._grow(points[~left], cells - cells // 2))
        return me

    def _bound(self, node: int, low: np.ndarray, high: np.ndarray) -> None:
        if len(self.nodes[node]) == 1:
            c = self.nodes[node][0]
            self.low[c], self.high[c] = low, high
            return
        axis, cut, left, right = self.nodes[node]
        below, above = high.copy(), low.copy()
        below[axis] = above[axis] = cut
        self._bound(left, low, below)
        self._bound(right, above, high)

    def cell(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if len(self.nodes[node]) == 1:
                out[rows] = self.nodes[node][0]
            elif len(rows):
                axis, cut, left, right = self.nodes[node]
                yes = points[rows, axis] < cut
                stack += [(left, rows[yes]), (right, rows[~yes])]
        return out

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """The squared distance of a point from each cell."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(axis=1)


class Cell:
    """Vectors of one length, with the lower part of the tree."""

    def __init__(self, ids: list[int], vectors: list[np.ndarray], dims: int):
        self.ids = np.array(ids)
        self.vectors, unit = units(np.array(vectors))
        self.norm = lengths(self.vectors)
        self.tree = KdTree(unit @ projection(unit.shape[1], dims))
        self.leaves = self.tree.leaves()

    def search(self, query: np.ndarray, point: np.ndarray, k: int, most: float, reach: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of about the k nearest to a query: projected neighbours in rising order, verified until the test holds.

        reach: the squared distance of the k-th nearest so far. Leaves are opened by the distance of their boxes, more of them each time;
        points nearer than any unopened box are next in order and are verified batch by batch. most: the test's quantile, by which
        the squared projected distance may exceed reach. Scores are those of the vectors themselves.
        """
        low, high, begin, end = self.leaves
        gap = np.maximum(np.maximum(low - point, point - high), 0)
        bound = np.einsum("ij,ij->i", gap, gap)
        by = np.argsort(bound, kind="stable")
        long = math.sqrt((query * query).sum())
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        wait_d, wait_row = np.zeros(0), np.zeros(0, np.int64)
        opened, far = 0, 0.0
        while (opened < len(by) and bound[by[opened]] <= max(most * reach, 1e-9)) or len(wait_d):
            step = by[opened : opened + max(8, opened)]
            opened += len(step)
            if len(step):
                fresh = np.concatenate([self.tree.order[a:b] for a, b in zip(begin[step].tolist(), end[step].tolist(), strict=True)])
                delta = self.tree.points[fresh] - point
                wait_d, wait_row = np.concatenate([wait_d, np.einsum("ij,ij->i", delta, delta)]), np.concatenate([wait_row, fresh])
                order = np.argsort(wait_d, kind="stable")
                wait_d, wait_row = wait_d[order], wait_row[order]
            ready = len(wait_d) if opened >= len(by) else int(np.searchsorted(wait_d, bound[by[opened]], "right"))
            at, size = 0, 64
            while at < ready:
                far = wait_d[at]
                if far > max(most * reach, 1e-9):
                    return ids, scores
                batch = wait_row[at : min(at + size, ready)]
                at, size = at + len(batch), 2 * size
                score = (self.vectors[batch] * query).sum(axis=1) / (self.norm[batch] * long)
                ids, scores = np.concatenate([ids, self.ids[batch]]), np.concatenate([scores, score])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    reach = min(reach, max(2 - 2 * float(scores[-1]), 0.0))
            wait_d, wait_row = wait_d[ready:], wait_row[ready:]
        return ids, scores


def rows_of(column: pa.Array) -> list[np.ndarray]:
    values, offs = np.asarray(column.values), np.asarray(column.offsets)
    return [values[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]


def projected(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    size = np.array([len(v) for v in vectors])
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        out[at] = units(np.array([vectors[k] for k in at]))[1] @ projection(d, dims)
    return out


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, dims: int = DIMENSIONS, sure: float = SURE, shard_rows: int = SHARD_ROWS, visits: int = VISITS) -> DataFrame:
    """(query_id, rank, vec_id, score) of about the k nearest of each query: rows whose id is divisible by every, among all other rows.

    Nearness is the largest cosine, in double precision on the original vectors; ties go to the smaller id. Null, zero and non-finite
    vectors, those with null components and rows with a null id take no part. Vectors of other lengths than the query's are no candidates.
    Of several vectors of one id, the smallest counts. Fewer than k candidates: all. Empty table: empty result. dims must be even.

    Every row is indexed, and moved once in each of the two rounds. Equal vectors are searched for once, whatever their number, and of equal vectors the k + 1 with the
    smallest ids are indexed, as no others can be in any result.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    good = good.groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    good = stored(good)
    most = quantile(sure, dims)
    alike = W.partitionBy("h", "g").orderBy("id")
    few = stored(good.withColumn("r", F.row_number().over(alike)).where(F.col("r") <= k + 1).drop("r"))
    asks = stored(good.where(F.col("id") % every == 0).withColumn("r", F.row_number().over(alike)).where("r = 1").select("h", "g", "v"))
    n = few.count()

    def points(batches):
        for batch in batches:
            if batch.num_rows:
                p = projected(rows_of(batch.column(0)), dims)
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), dims).cast(pa.list_(pa.float64()))], names=["p"])

    chosen = few.where(F.pmod(F.xxhash64(F.lit(2), "h"), F.lit(max(1, n // SAMPLE))) == 0).select("v").mapInArrow(points, "p array<double>")
    chosen = np.array(sorted(r["p"] for r in chosen.toLocalIterator())).reshape(-1, dims)
    top = Top(chosen, max(1, min(CELLS, math.ceil(n / shard_rows))))
    shared = spark.sparkContext.broadcast(top)

    def home(batches):
        for batch in batches:
            if batch.num_rows:
                cell = shared.value.cell(projected(rows_of(batch.column(2)), dims))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["h", "g", "v", "cell"])

    dealt = stored(few.select("id", "g", "v").mapInArrow(home, "h bigint, g bigint, v array<double>, cell int").select(F.col("h").alias("id"), "v", "cell"))
    parts = F.broadcast(dealt.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("parts")))  # no more rows than CELLS

    def visit(to: DataFrame) -> DataFrame:
        """(h, g, id, score) that the queries of (cell, h, g, v, reach) find in their cells."""
        to = stored(to)
        sets = F.broadcast(to.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(visits)).cast("int").alias("sets")))
        rows = dealt.join(sets, "cell").join(parts, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("sets") - 1)).alias("set"), F.lit(0).alias("kind"), "id", F.lit(0).cast("bigint").alias("g"), "v", F.lit(0.0).alias("reach"))
        come = to.join(sets, "cell").join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.col("h"), F.col("sets")).cast("int").alias("set"), F.lit(1).alias("kind"), F.col("h").alias("id"), "g", "v", "reach")
        both = rows.unionByName(come).repartition(deal(spark), "cell", "part", "set").sortWithinPartitions("cell", "part", "set", "kind", "id")

        def run(batches):
            now, held, cells = None, {}, {}
            for batch in batches:
                out = []
                keys = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
                for key, kind, i, g, x, reach in zip(keys, *(batch.column(c).to_pylist() for c in (3, 4, 5)), rows_of(batch.column(6)), batch.column(7).to_pylist(), strict=True):
                    if key != now:
                        now, held, cells = key, {}, {}
                    if not kind:
                        ids, vs = held.setdefault(len(x), ([], []))
                        ids.append(i)
                        vs.append(x.copy())
                        continue
                    if (d := len(x)) not in cells:
                        cells[d] = Cell(*held.pop(d), dims) if d in held else None
                    if cells[d] is not None:
                        scaled, unit = units(x[None])
                        ids, scores = cells[d].search(scaled[0], unit[0] @ projection(d, dims), k + 1, most, reach)
                        out += [(i, g, a, b) for a, b in zip(ids.tolist(), scores.tolist(), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["h", "g", "id", "score"])

        return both.mapInArrow(run, "h bigint, g bigint, id bigint, score double")

    nearest_first = W.partitionBy("h", "g").orderBy(F.desc("score"), "id")
    first = visit(asks.mapInArrow(home, "h bigint, g bigint, v array<double>, cell int").withColumn("reach", F.lit(math.inf)))
    first = stored(first.withColumn("r", F.row_number().over(nearest_first)).where(F.col("r") <= k + 1).drop("r"))
    known = first.groupBy("h", "g").agg(F.min("score").alias("s"), F.count("*").alias("n"))

    def others(batches):
        t = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own, to, who = projected(rows_of(batch.column(2)), dims), [], []
            for j, (p, c, reach) in enumerate(zip(own, t.cell(own).tolist(), batch.column(3).to_pylist(), strict=True)):
                found = np.flatnonzero(t.gaps(p) <= max(most * reach, 1e-9))
                found = found[found != c]
                to.append(found)
                who += [j] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to).astype(np.int32)), *(c.take(pa.array(who, pa.int64())) for c in batch.columns)], names=["cell", "h", "g", "v", "reach"])

    if top.cells > 1:
        open_ = asks.join(known, ["h", "g"], "left").select("h", "g", "v", F.when(F.col("n") > k, F.greatest(2 - 2 * F.col("s"), F.lit(0.0))).otherwise(F.lit(math.inf)).alias("reach"))
        first = first.unionByName(visit(open_.mapInArrow(others, "cell int, h bigint, g bigint, v array<double>, reach double")))
        first = first.withColumn("r", F.row_number().over(nearest_first)).where(F.col("r") <= k + 1).drop("r")
    ask = good.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "h", "g")
    found = ask.join(first.select("h", "g", F.col("id").alias("vec_id"), "score"), ["h", "g"]).where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
