"""Language-model scores by masked pseudo-likelihood.

A window network sees the words on both sides of each word and predicts it: first its class, from the classes of the nearest
words and from the mean vectors of a wider stretch on either side; within a class, a word has its share of the class in the
corpus. The score of a document is the sum of the log-probabilities of all of its words, each given its neighbours.

Words are counted over the whole corpus; the most frequent are the vocabulary, the others share a bucket by hash and, in it, are
equally likely. Vectors of words are leading directions of their co-occurrence with all others (two power iterations over all
positions, in whole numbers, so that sums don't depend on their order). Classes are words with like vectors. The network is trained in
numpy on every position: the corpus is dealt to blocks by content, each block improves a common start, and the blocks' parameters
are averaged. Nothing of this depends on how the documents are partitioned.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from streamtable.llm import _words
from streamtable.llm._store import small_batches, stored

VOCABULARY = 1 << 15  # words with an id of their own
RESTS = 1 << 10  # ids of the others, by hash
IDS = VOCABULARY + RESTS
CLASSES = 128  # the last one is for what is in no document
EDGE = CLASSES  # the class of what lies outside the document
SIDE = 2  # words on either side that the network sees one by one
WIDE = 16  # and as a mean vector
START_DIMS, DIMS = 16, 8  # of vectors
UNIT = 1 << 10  # vectors are multiples of a part in so many
WIDTH, HIDDEN = 8, 32
BLOCK = 2_000_000  # words of a block
BLOCKS = 1 << 16  # at most; blocks of larger corpora have more words
WARM = 500_000  # positions, at least if there are as many, that make the common start
HELD = 50_000  # positions, at least, that are shuffled together and then trained on
STEP = 1 << 16  # positions worked on at once
PARTS = 64  # of a vector that is summed over tasks, each part by itself
SLOTS = 18  # bits of a place in the vocabulary's table
CELLS = np.arange((CLASSES + 1) * WIDTH).reshape(-1, WIDTH)  # of the classes' parameters


class Words:
    """Ids of words by their hash. A word that finds both its places in the table taken by more frequent ones is none of the vocabulary."""

    def __init__(self, hashes: np.ndarray):
        """hashes: of the vocabulary, the most frequent first."""
        self.table = np.full((2, 1 << SLOTS), VOCABULARY, np.int32)
        kept = []
        for h in hashes.tolist():
            for k, slot in enumerate(self.slots(h)):
                if self.table[k, slot] == VOCABULARY:
                    self.table[k, slot] = len(kept)
                    kept.append(h)
                    break
        self.hashes = np.zeros(VOCABULARY + 1, np.uint64)
        self.hashes[: len(kept)] = np.array(kept, np.uint64)
        self.size = len(kept)

    @staticmethod
    def slots(h):
        return h >> (64 - SLOTS), h >> (64 - 2 * SLOTS) & ((1 << SLOTS) - 1)

    def ids(self, h: np.ndarray) -> np.ndarray:
        out = (VOCABULARY + (h & np.uint64(RESTS - 1)).astype(np.int32)).astype(np.int32)
        mask = np.uint64((1 << SLOTS) - 1)
        for k, slot in enumerate((h >> np.uint64(64 - SLOTS), h >> np.uint64(64 - 2 * SLOTS) & mask)):
            at = self.table[k, slot.astype(np.int64)]
            yes = (self.hashes[at] == h) & (at < VOCABULARY)
            out[yes] = at[yes]
        return out


class Model(NamedTuple):
    words: Words
    vectors: np.ndarray  # of each id
    classes: np.ndarray  # of each id
    within: np.ndarray  # log-probability of a word of each id, given its class
    params: list[np.ndarray]


def read(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document and, last, their number). A-Z lower-cased."""
    w = _words.words(data, offs, _words.LOWER)
    return w.hash, w.first


def bounds(first: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the documents of the positions from a to b begin and end."""
    doc = np.searchsorted(first, np.arange(a, b), "right") - 1
    return first[doc], first[doc + 1]


def sides(vectors: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, a: int, b: int):
    """Sums of vectors over up to WIDE words on the left and on the right of the positions from a to b, and how many these are."""
    s, t = max(a - WIDE, 0), min(b + WIDE, len(ids))
    run = np.zeros((t - s + 1, vectors.shape[1]), np.int32 if vectors.dtype == np.int32 else np.float64)
    np.cumsum(vectors[ids[s:t]], axis=0, out=run[1:])  # whole numbers may run over, which their differences don't feel
    i = np.arange(a, b)
    lo, hi = np.maximum(i - WIDE, low), np.minimum(i + 1 + WIDE, high)
    return run[i - s] - run[lo - s], run[hi - s] - run[i + 1 - s], i - lo, hi - i - 1


def inputs(vectors: np.ndarray, classes: np.ndarray, ids: np.ndarray, first: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """What the network sees of the positions from a to b: classes of the nearest words, and mean vectors of both sides."""
    low, high = bounds(first, a, b)
    left, right, n, m = sides(vectors, ids, low, high, a, b)
    wide = np.concatenate([left / np.maximum(n, 1)[:, None], right / np.maximum(m, 1)[:, None]], axis=1).astype(np.float32)
    i = np.arange(a, b)
    near = np.full((b - a, 2 * SIDE), EDGE, np.int64)
    for k, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        inside = (i + step >= low) & (i + step < high)
        near[inside, k] = classes[ids[i[inside] + step]]
    return near, wide


def start() -> list[np.ndarray]:
    r = np.random.default_rng(3)
    shapes = [(0.3, (CLASSES + 1, WIDTH)), (0.2, (2 * SIDE * WIDTH + 2 * DIMS, HIDDEN)), (0, HIDDEN), (0.1, (HIDDEN, CLASSES)), (0, CLASSES)]
    return [r.normal(0, scale, shape).astype(np.float32) for scale, shape in shapes]


def forward(p: list[np.ndarray], near: np.ndarray, wide: np.ndarray):
    e = np.concatenate([p[0].take(near, axis=0).reshape(len(near), -1), wide], axis=1)
    h = np.tanh(e @ p[1] + p[2])
    z = h @ p[3]
    z += p[4]
    if np.abs(p[3]).sum(axis=0).max() + np.abs(p[4]).max() > 80:  # else no exponential runs over, as no h is beyond 1
        z -= z.max(axis=1, keepdims=True)
    return e, h, z


def log_probability(p: list[np.ndarray], near: np.ndarray, wide: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log P(class y | what the network sees)."""
    _, _, z = forward(p, near, wide)
    own = z[np.arange(len(y)), y]
    return own - np.log(np.exp(z, out=z).sum(axis=1))  # a sum whose order the number of rows doesn't change


def learn(p: list[np.ndarray], squares: list[np.ndarray], near: np.ndarray, wide: np.ndarray, y: np.ndarray, rate: float = 0.05) -> None:
    """One step of adaptive gradient descent on a batch, in place."""
    n = len(y)
    e, h, d = forward(p, near, wide)
    np.exp(d, out=d)
    d *= 1 / (d.sum(axis=1, keepdims=True) * np.float32(n))
    d[np.arange(n), y] -= np.float32(1 / n)
    back = (d @ p[3].T) * (1 - h * h)
    own = back @ p[1][: near.shape[1] * WIDTH].T
    cell = CELLS.take(near, axis=0).ravel()
    g0 = np.bincount(cell, weights=own.ravel(), minlength=p[0].size).reshape(p[0].shape).astype(np.float32)
    for q, s, g in zip(p, squares, (g0, e.T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0)), strict=True):
        s += g * g
        q -= rate * g / (np.sqrt(s) + 1e-6)


class Learner:
    """Trains on documents as they come, HELD positions or more at once."""

    def __init__(self, vectors: np.ndarray, classes: np.ndarray, params: list[np.ndarray]):
        self.vectors, self.classes, self.p = vectors, classes, [q.copy() for q in params]
        self.squares, self.held, self.n, self.seen = [np.full_like(q, 1e-4) for q in self.p], [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= HELD:
            self.flush()

    def flush(self) -> None:
        if self.n:
            ids, first = np.concatenate(self.held), np.concatenate([[0], np.cumsum([len(x) for x in self.held])])
            for a in range(0, len(ids), STEP):
                b = min(a + STEP, len(ids))
                near, wide = inputs(self.vectors, self.classes, ids, first, a, b)
                y = self.classes[ids[a:b]].astype(np.int64)
                order = np.random.default_rng(len(y)).permutation(len(y))
                for k in range(0, len(y), 1024):
                    at = order[k : k + 1024]
                    learn(self.p, self.squares, near[at], wide[at], y[at])
            self.seen += self.n
            self.held, self.n = [], 0


def packed(p: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([q.ravel() for q in p])


def unpacked(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for q in start():
        out.append(flat[at : at + q.size].reshape(q.shape).astype(np.float32).copy())
        at += q.size
    return out


def summed(df: DataFrame, fn, size: int) -> np.ndarray:
    """The sum of the vectors of so many numbers that fn yields in all tasks. Added up on the executors, part by part, in an order of their own."""
    cut = np.linspace(0, size, PARTS + 1).astype(int)

    def give(batches):
        for v in fn(batches):
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "v": pa.array([v[a:b].astype(np.float64).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    def total(batches):
        now, own = None, None
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "v": pa.array([own.tobytes()], pa.binary())})
                    now, own = part, np.zeros(len(blob) // 8)
                own += np.frombuffer(blob)
        if now is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "v": pa.array([own.tobytes()], pa.binary())})

    ddl, out = "part int, v binary", np.zeros(size)
    rows = df.mapInArrow(give, ddl).repartitionById(PARTS, F.col("part")).sortWithinPartitions("part", "v").mapInArrow(total, ddl)
    for r in rows.toLocalIterator():
        out[cut[r["part"]] : cut[r["part"] + 1]] = np.frombuffer(bytes(r["v"]))
    return out


def turned(sums: np.ndarray, seen: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ids, without what all have in common, of equal variance in all directions, the strongest direction first; and the strengths."""
    z = (sums - sums.sum(axis=0) / max(seen.sum(), 1) * seen[:, None]) / (seen + 6 * WIDE)[:, None]
    cov = (z * (count / max(count.sum(), 1))[:, None]).T @ z
    value, side = np.linalg.eigh(cov)
    value = np.maximum(value[::-1], 0)
    top = max(value[0], 1e-12)
    return z @ side[:, ::-1] / np.sqrt(value + 1e-9 * top + 1e-12), np.sqrt(value / top)


def classed(vectors: np.ndarray, count: np.ndarray, classes: int) -> np.ndarray:
    """So many classes of ids with like vectors: cut along the widest direction where that explains most, larger parts oftener."""
    out, n = np.zeros(len(count), np.int16), 0
    stack = [(np.arange(len(count)), classes)]
    while stack:
        rows, k = stack.pop()
        if k < 2 or len(rows) < 2:
            out[rows] = n
            n += 1
            continue
        z, c = vectors[rows], count[rows]
        d = z - np.average(z, axis=0, weights=c)
        along = d @ np.linalg.eigh((d * c[:, None]).T @ d)[1][:, -1]
        order = np.argsort(along, kind="stable")
        mass, moment = np.cumsum(c[order]), np.cumsum(c[order] * along[order])
        all_ = mass[-1]
        gain = moment[:-1] ** 2 / mass[:-1] + (moment[-1] - moment[:-1]) ** 2 / np.maximum(all_ - mass[:-1], 1e-9)
        fair = (mass[:-1] >= all_ / 10) & (mass[:-1] <= all_ * 9 / 10)
        cut = int(np.argmax(np.where(fair, gain, -1))) + 1 if fair.any() else int(np.argmin(np.abs(mass[:-1] - all_ / 2))) + 1
        left = min(max(round(k * mass[cut - 1] / all_), 1), k - 1)
        if k <= len(rows):
            left = min(max(left, k - (len(rows) - cut)), cut)
        stack += [(rows[order[cut:]], k - left), (rows[order[:cut]], left)]
    return out


def frequent(counted: DataFrame) -> DataFrame:
    """About the VOCABULARY most frequent words of (h, n), found without sorting: eighths of powers of two of n from the top, the last one by hash."""
    level = F.floor(F.log2("n") * 8)
    left, last = VOCABULARY, -1
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):
        if r["count"] >= left:
            last, part = r["level"], max(left - 4 * math.sqrt(left), 0) / r["count"]
            return counted.where((level > last) | (level == last) & (F.col("h").bitwiseAND((1 << 30) - 1) < int(part * (1 << 30))))
        left -= r["count"]
    return counted


def quantized(vectors: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(vectors, -1000, 1000) * UNIT).astype(np.int32)


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The vocabulary, vectors, classes and trained parameters. Null and blank texts count for nothing; a corpus without words leaves all as it starts."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(text_col).alias("text"))

    def count(batches):
        held, n = [], 0

        def flush():
            if n:
                h, c = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "n": pa.array(c)})

        for batch in batches:
            for _, data, offs in _words.pieces(batch.column(0)):
                held.append(read(data, offs)[0])
                n += len(held[-1])
                if n > 1 << 21:
                    yield from flush()
                    held, n = [], 0
        yield from flush()

    counted = stored(texts.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")))
    most = sorted((-r["n"], r["h"]) for r in frequent(counted).toLocalIterator())[:VOCABULARY]
    words = Words(np.array([h for _, h in most], np.int64).view(np.uint64))
    known = {h: -n for n, h in most}
    # what is left of each bucket without the vocabulary: positions and different words
    number, positions, distinct = np.zeros(IDS), np.zeros(RESTS), np.zeros(RESTS)
    for r in counted.groupBy(F.col("h").bitwiseAND(RESTS - 1).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        positions[r["b"]], distinct[r["b"]] = r["n"], r["k"]
    for i, h in enumerate(words.hashes[: words.size].view(np.int64).tolist()):
        number[i] = known[h]
        positions[h & (RESTS - 1)] -= number[i]
        distinct[h & (RESTS - 1)] -= 1
    number[VOCABULARY:] = positions
    table = spark.sparkContext.broadcast(words)
    blocks = max(1, min(BLOCKS, math.ceil(number.sum() / BLOCK)))

    def encode(batches):
        for batch in batches:
            for _, data, offs in _words.pieces(batch.column(0)):
                h, first = read(data, offs)
                ids = table.value.ids(h)
                blobs = [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True) if b > a]
                tags = [xxhash.xxh3_64_intdigest(x) for x in blobs]
                yield pa.RecordBatch.from_pydict({"block": pa.array([t % blocks for t in tags], pa.int32()), "tag": pa.array(np.array(tags, np.uint64).view(np.int64)), "ids": pa.array(blobs, pa.binary())})

    encoded = stored(texts.mapInArrow(encode, "block int, tag bigint, ids binary"))
    r = np.random.default_rng(1)
    vectors = r.normal(size=(IDS, START_DIMS)) * np.minimum(np.sqrt(max(number.sum(), 1) / np.maximum(number, 1)), 300)[:, None]
    for turn in range(2):
        known_vectors = spark.sparkContext.broadcast(quantized(vectors))

        def meet(batches, known_vectors=known_vectors):
            vs = known_vectors.value
            out = np.zeros((IDS, vs.shape[1] + 1))
            held, n = [], 0

            def add():
                if n:
                    ids, first = np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])])
                    for a in range(0, n, STEP):
                        b = min(a + STEP, n)
                        left, right, k, m = sides(vs, ids, *bounds(first, a, b), a, b)
                        own, both = ids[a:b], left + right
                        for d in range(vs.shape[1]):
                            out[:, d] += np.bincount(own, weights=both[:, d], minlength=IDS)
                        out[:, -1] += np.bincount(own, weights=k + m, minlength=IDS)

            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    held.append(np.frombuffer(blob, np.int32))
                    n += len(held[-1])
                    if n >= STEP:
                        add()
                        held, n = [], 0
            add()
            if out.any():
                yield out.ravel()

        sums = summed(encoded.select("ids"), meet, IDS * (vectors.shape[1] + 1)).reshape(IDS, -1)
        vectors, strength = turned(sums[:, :-1] / UNIT, sums[:, -1], number)
        vectors, strength = vectors[:, :DIMS], strength[:DIMS]
        known_vectors.destroy()
    seen = np.flatnonzero(number)
    classes = np.full(IDS, CLASSES - 1, np.int16)
    if len(seen):
        classes[seen] = classed(vectors[seen] * strength, number[seen], CLASSES - 1)
    mass = np.bincount(classes, weights=number, minlength=CLASSES)
    share = np.where(number > 0, number, 0.5) / np.maximum(np.bincount(classes, weights=np.where(number > 0, number, 0.5), minlength=CLASSES), 0.5)[classes]
    within = np.log(share)
    within[VOCABULARY:] -= np.log(np.maximum(distinct, 1))
    params = start()
    params[4] = np.log((mass + 0.5) / (mass + 0.5).sum()).astype(np.float32)
    vectors = vectors.astype(np.float32)

    def improved(params: list[np.ndarray], most: int | None = None):
        shared = spark.sparkContext.broadcast((vectors, classes, packed(params)))

        def run(batches):
            own, now, size = None, None, 0

            def done():
                own.flush()
                return np.append(packed(own.p).astype(np.float64), 1.0) * own.seen

            for batch in batches:
                for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if block != now:
                        if own is not None:
                            yield done()
                        vs, cs, flat = shared.value
                        own, now, size = Learner(vs, cs, unpacked(flat)), block, 0
                    if most is None or size < most:
                        own.add(np.frombuffer(blob, np.int32))
                        size += len(blob) // 4
            if own is not None:
                yield done()

        some = encoded.where("block = 0") if most else encoded
        dealt = some.repartitionById(1 if most else blocks, F.col("block")).sortWithinPartitions("block", "tag", "ids").select("block", "ids")
        total = summed(dealt, run, packed(params).size + 1)
        return unpacked((total[:-1] / total[-1]).astype(np.float32)) if total[-1] else params

    params = improved(params, WARM) if blocks > 1 else params
    return Model(words, vectors, classes, within, improved(params))


def score(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] | None = None, model: Model | None = None) -> DataFrame:
    """docs with n_tokens, log_likelihood (the sum over all words) and mean_log_likelihood (null without words).

    keep: columns of docs to return, all unless given; columns of the new names give way. model: of fit(), else fitted on docs. Null, empty
    and blank texts: 0 tokens, sum 0.0. Words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased. Rows are scored alone; a repeated row counts
    in the corpus as often as it is there. The same documents have the same scores however they are partitioned. Empty table: empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or fit(docs, text_col))
    fresh = ["n_tokens", "log_likelihood", "mean_log_likelihood"]
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in [f.lower() for f in fresh]]

    def run(batches):
        m = shared.value
        for batch in batches:
            n, total = [], []
            for _, data, offs in _words.pieces(batch.column(0), 1 << 20):  # as before: shapes of products move the last digits
                h, first = read(data, offs)
                ids = m.words.ids(h)
                value = m.within[ids]
                for a in range(0, len(ids), 4096):
                    b = min(a + 4096, len(ids))
                    value[a:b] += log_probability(m.params, *inputs(m.vectors, m.classes, ids, first, a, b), m.classes[ids[a:b]])
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                total.append(np.bincount(doc, weights=value, minlength=len(first) - 1))
                n.append(np.diff(first))
            n, total = (np.concatenate([*z, np.zeros(0)]) for z in (n, total))
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n.astype(np.int64)), pa.array(total), mean], names=[*(f"c{k}" for k in range(len(names))), *fresh])

    given = docs.select(F.col(text_col).alias("t"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    schema = StructType([*(StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(names)), *StructType.fromDDL("n_tokens bigint, log_likelihood double, mean_log_likelihood double").fields])
    return given.mapInArrow(run, schema).toDF(*names, *fresh)
