"""Toxicity by a classifier chain: linear models in a row, each fed with the probabilities of the ones before.

The chain follows the order of categories. In training, the probabilities that later models see are out of fold, so that they learn how
reliable the earlier models are on new documents; copies and near copies of a document are in one fold, or they would tell each
other's labels. Features are the presence of hashed word forms and of their beginnings, kept only if enough labelled documents have
them. The models are fitted on a bounded sample of labelled rows, a fold a Spark task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from streamtable.llm._store import small_batches, stored, tidy

BITS = 18
SAMPLE = 6_000  # labelled documents that a category's classes are fitted on, at most; half of them positive if there are as many
TOTAL = 16_000_000  # features of these documents, at most; 4 bytes each in the broadcast sample
ALIKE = 0.7  # Jaccard similarity of features from which documents share a fold
WORD = regex.compile(r"[\p{L}\p{M}]+")
FOLDS = 5


def features(text: str | None) -> np.ndarray:
    """Hashed features of a whole text: its distinct lower-cased words, and the first four and five letters of each longer word."""
    words = set(WORD.findall((text or "").lower()))
    words |= {w[:k] + "*" for w in words for k in (4, 5) if len(w) > k}
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(w) & ((1 << BITS) - 1) for w in words), np.int64, len(words)).astype(np.int32)) if words else np.zeros(0, np.int32)


class Rows:
    """Sparse rows of ones."""

    def __init__(self, rows: list[np.ndarray]):
        self.n, self.index = len(rows), np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.index], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, weights=g[self.row], minlength=size)


def fit(x: Rows, more: np.ndarray, y: np.ndarray, size: int, rounds: int = 150, l1: float = 2e-4) -> np.ndarray:
    """Weights of a logistic model with an L1 penalty: size for features, then those of the columns of more, then the bias. Proximal gradient with momentum; each feature's step follows its frequency, up to a bound."""
    n, k = x.n, more.shape[1]
    w = np.zeros(size + k + 1)
    if not n:
        return w
    count = np.bincount(x.index, minlength=size)
    scale = np.concatenate([1 / np.sqrt(np.maximum(count / n, 20 / n)), np.full(k + 1, 1.0)])
    ahead, before, step = w.copy(), w.copy(), None
    z = np.random.default_rng(7).normal(size=len(w))
    for _ in range(12):  # the largest curvature of the scaled problem
        v = z * scale
        u = x.dot(v[:size]) + more @ v[size:-1] + v[-1]
        z = np.concatenate([x.back(u, size), more.T @ u, [u.sum()]]) * scale / n
        top = np.linalg.norm(z)
        z /= max(top, 1e-12)
    step = 4 / max(top, 1e-9)
    for i in range(rounds):
        p = 1 / (1 + np.exp(-(x.dot(ahead[:size]) + more @ ahead[size:-1] + ahead[-1])))
        g = (p - y) / n
        grad = np.concatenate([x.back(g, size), more.T @ g, [g.sum()]])
        new = ahead - step * scale**2 * grad
        cut = step * scale**2 * l1
        cut[size:] = 0
        new = np.sign(new) * np.maximum(np.abs(new) - cut, 0)
        ahead = new + i / (i + 3) * (new - before)
        before = new
    return before


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def copies(rows: list[np.ndarray], alike: float = ALIKE) -> np.ndarray:
    """The group of each row: rows that are alike, or linked by such ones, share it. Min-hashes in bands find the candidates."""
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    r = np.random.default_rng(17)
    up, plus = (r.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    first: dict[tuple[int, bytes], list[int]] = {}
    for i, row in enumerate(rows):
        if not len(row):
            first.setdefault((-1, b""), [i])
            parent[i] = root(first[-1, b""][0])
            continue
        least = np.full(64, np.uint64(0xFFFFFFFFFFFFFFFF))
        for a in range(0, len(row), 1024):
            h = row[a : a + 1024].astype(np.uint64)[:, None] * up + plus
            least = np.minimum(least, ((h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)).min(axis=0))
        for band in range(16):
            leads = first.setdefault((band, least[4 * band : 4 * band + 4].tobytes()), [])
            for j in leads:
                if root(i) == root(j):
                    break
                common = len(np.intersect1d(row, rows[j], assume_unique=True))
                if common >= alike * (len(row) + len(rows[j]) - common):
                    parent[root(i)] = root(j)
                    break
            else:
                leads.append(i)
    return np.array([root(i) for i in range(len(rows))], np.int64)


def folds(rows: list[np.ndarray]) -> np.ndarray:
    """The fold of each row: groups of copies are dealt to the fold that has the fewest rows, the largest group first."""
    group, fold, size = copies(rows), np.zeros(len(rows), np.int64), [0] * FOLDS
    ids, count = np.unique(group, return_counts=True)
    to = {}
    for g, n in sorted(zip(ids.tolist(), count.tolist(), strict=True), key=lambda x: (-x[1], x[0])):
        to[g] = int(np.argmin(size))
        size[to[g]] += n
    for i, g in enumerate(group.tolist()):
        fold[i] = to[g]
    return fold


def fit_without(job: int, rows: list[np.ndarray], fold: np.ndarray, seen: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Weights fitted on all rows but those of a fold."""
    inside = np.flatnonzero(fold != job)
    return fit(Rows([rows[i] for i in inside]), logit(seen[inside]), y[inside], size)


def fits_here(*given) -> list[np.ndarray]:
    return [fit_without(job, *given) for job in range(FOLDS + 1)]


def fits_on(spark) -> Callable:
    """fits_here, each fit a task."""

    def fits(rows, fold, seen, y, size):
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        shared = spark.sparkContext.broadcast((np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32).tobytes(), offsets.tobytes(), fold.tobytes(), seen.tobytes(), y.tobytes(), seen.shape))

        def run(batches):
            flat, at, fold, seen, y, shape = shared.value
            flat, at, fold, y = np.frombuffer(flat, np.int32), np.frombuffer(at, np.int64), np.frombuffer(fold, np.int64), np.frombuffer(y)
            rows, seen = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], np.frombuffer(seen).reshape(shape)
            for batch in batches:
                jobs = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(jobs, pa.int64()), pa.array([fit_without(j, rows, fold, seen, y, size).tobytes() for j in jobs], pa.binary())], names=["job", "w"])

        got = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(tidy(run), "job bigint, w binary").collect()
        shared.destroy()
        return [np.frombuffer(bytes(r["w"])) for r in sorted(got, key=lambda r: r["job"])]

    return fits


class Chain:
    """Fitted models by category, in order. shifts: by what the odds' logarithms of each category in the corpus are above those in the sample."""

    def __init__(self, categories: list[str], weights: list[np.ndarray], thresholds: list[float], shifts: list[float] | None = None):
        self.categories, self.weights, self.thresholds, self.shifts = categories, weights, thresholds, shifts or [0.0] * len(categories)

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        """As in the sample that the chain was fitted on."""
        x, size = Rows(rows), 1 << BITS
        out = np.zeros((x.n, 0))
        for w in self.weights:
            p = 1 / (1 + np.exp(-(x.dot(w[:size]) + logit(out) @ w[size:-1] + w[-1])))
            out = np.column_stack([out, p])
        return out


def moved(p, shift: float):
    """Probabilities whose odds have changed by a factor."""
    factor = np.exp(shift)
    return p * factor / (1 - p + p * factor)


def train(rows: list[np.ndarray], labels: dict[str, np.ndarray], least: int = 5, fits: Callable = fits_here) -> Chain:
    """The chain over labels in their order. Features in fewer than least rows are left out."""
    count = np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]), minlength=1 << BITS)
    fold = folds(rows)
    used = np.flatnonzero(count >= least)
    size, place = len(used), np.full(1 << BITS, -1)
    place[used] = np.arange(size)
    rows = [place[r] for r in rows]
    rows = [r[r >= 0] for r in rows]
    seen = np.zeros((len(rows), 0))
    weights, thresholds = [], []
    for y in labels.values():
        y = y.astype(float)
        out = np.zeros(len(rows))
        *parts, w = fits(rows, fold, seen, y, size)
        for f, part in enumerate(parts):
            outside = np.flatnonzero(fold == f)
            o = Rows([rows[i] for i in outside])
            out[outside] = 1 / (1 + np.exp(-(o.dot(part[:size]) + logit(seen[outside]) @ part[size:-1] + part[-1])))
        whole = np.zeros((1 << BITS) + len(w) - size)
        whole[used], whole[1 << BITS :] = w[:size], w[size:]
        weights.append(whole)
        # the out-of-fold threshold with the fewest errors, in the middle of where it may stand
        order = np.argsort(out)
        p, t = out[order], y[order]
        missed, wrong = np.concatenate([[0], np.cumsum(t)]), np.concatenate([[0], np.cumsum(1 - t)])
        errors = missed + wrong[-1] - wrong
        edge = np.concatenate([[0.0], (p[:-1] + p[1:]) / 2, [1.0]]) if len(p) else np.array([0.5])
        thresholds.append(float(np.clip(np.median(edge[errors == errors.min()]), 0.05, 0.95)))
        seen = np.column_stack([seen, out])
    return Chain(list(labels), weights, thresholds)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, total: int = TOTAL) -> Chain:
    """Fits the chain on at most sample labelled documents, chosen by a hash of their ids, half of them positive in the last category if possible.

    labels: one row for each labelled document, with id_col; categories: name -> 0/1 column of labels. The features of a document are
    made where it is; only these, for the bounded sample, go to the driver, and of the sample no more documents than have total
    features. The last category's probabilities are corrected for the half-and-half choice by its share in labels; those of the others
    need no correction where the last category follows from the text. Labels with nulls, without a document or for a null id don't
    count. Of several labels or texts of one id, the least counts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = list(categories)
    last = names[-1]
    marked = labels.select(F.col(id_col).alias("id"), *(c.cast("int").alias(k) for k, c in categories.items())).dropna()
    marked = marked.groupBy("id").agg(F.min(F.struct(*names)).alias("m")).select("id", "m.*")
    share = {bool(r[0]): r[1] for r in marked.groupBy(F.col(last) == 1).count().collect()}
    half = [marked.where(F.col(last) == v).orderBy(F.xxhash64("id"), "id").limit(sample // 2) for v in (1, 0)]
    chosen = half[0].unionByName(half[1])

    def gather(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([features(t).tobytes() for t in batch.column(0).to_pylist()], pa.binary()), *batch.columns[2:]], names=["id", "x", *names])

    met = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "id", *names)
    schema = StructType([StructField("id", labels.schema[id_col].dataType), *StructType.fromDDL("x binary, " + ", ".join(f"{k} int" for k in names)).fields])
    one = met.mapInArrow(tidy(gather), schema).groupBy("id").agg(F.min(F.struct("x", *names)).alias("m")).select("m.*")  # no more rows than chosen
    rows, held = [], 0
    for r in stored(one).toLocalIterator():
        rows.append((xxhash.xxh3_64_intdigest(bytes(r["x"])), bytes(r["x"]), *(r[k] for k in names)))
        held += len(rows[-1][1]) // 4
        if held > 2 * total:
            rows, held = within(rows, total)
    rows, _ = within(rows, total)
    chain = train([np.frombuffer(r[1], np.int32) for r in rows], {k: np.array([r[2 + i] for r in rows], np.int64) for i, k in enumerate(names)}, fits=fits_on(spark))
    yes = sum(r[-1] == 1 for r in rows)
    no = len(rows) - yes
    if yes and no:
        chain.shifts[-1] = float(np.log(share[True] / share[False]) - np.log(yes / no))
    return chain


def within(rows: list[tuple], total: int) -> tuple[list[tuple], int]:
    """The first rows, by their hash, that together have no more than total features, and how many they have."""
    rows, at, held = sorted(rows), 0, 0
    while at < len(rows) and held + len(rows[at][1]) // 4 <= total:
        held += len(rows[at][1]) // 4
        at += 1
    return rows[:at], held


def score(docs: DataFrame, chain: Chain, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs with p_<category> (double: its probability in the corpus) of each category and is_<category> (boolean: above its fitted threshold).

    keep: columns of docs to return, all unless given; such columns of docs give way. Null and empty texts have no features and
    get what the biases say. Each row is scored alone: ties, repeated rows and very long texts are nothing special. Empty table: empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    fresh = [*(f"p_{c}" for c in chain.categories), *(f"is_{c}" for c in chain.categories)]
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in [f.lower() for f in fresh]]
    shared = spark.sparkContext.broadcast((chain.categories, [w.astype(np.float32).tobytes() for w in chain.weights], chain.thresholds, chain.shifts))

    def run(batches):
        categories, weights, thresholds, shifts = shared.value
        own = Chain(categories, [np.frombuffer(w, np.float32).astype(float) for w in weights], thresholds)
        for batch in batches:
            p = own.probabilities([features(t) for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(moved(p[:, k], shifts[k])) for k in range(len(categories))), *(pa.array(p[:, k] >= thresholds[k]) for k in range(len(categories)))], names=[*(f"c{k}" for k in range(len(names))), *fresh])

    given = docs.select(F.col(text_col).alias("t"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    schema = StructType([*(StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(names)), *StructType.fromDDL(", ".join([*(f"p_{c} double" for c in chain.categories), *(f"is_{c} boolean" for c in chain.categories)])).fields])
    return given.mapInArrow(tidy(run), schema).toDF(*names, *fresh)
