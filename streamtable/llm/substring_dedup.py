"""Removal of repeated passages of whole words, located by Aho-Corasick automata.

Windows of consecutive words meet under the hash of their least k-gram (see _spans); Bloom filters keep all but repeated hashes at
home. A segment is a run of such windows; equal segments are one, with the smallest document id. A shard takes the segments of its
hashes: equal windows of several documents confirm a recurring passage and its first document, the passages of a hash are compiled
into automata, and all its segments stream through these to locate every occurrence. A hash with more bytes of segments than a shard
takes is divided by the place of its k-gram in the window, on which equal windows agree: into shards again, finer and finer, until
what many documents have in common is equal segments, and a segment, at last, is one window. No pattern goes to two shards.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from streamtable.llm import _spans, _words
from streamtable.llm._repeats import BITS, suspected
from streamtable.llm._store import deal, held, small_batches

GRAM = 16  # words
HOT = 1 << 22  # bytes of one hash's segments that a shard takes
STEPS = (16, 4, 1)  # places of the k-gram that are taken as one, where a hash has more
LETTERS = 1_000_000  # words of an automaton, each a code point
PHRASES = 20_000  # phrases of an automaton


def segments(data: np.ndarray, offs: np.ndarray, window: int):
    w = _words.words(data, offs)
    return w, _spans.runs(segment_grams(w, window), window - min(GRAM, window) + 1, w.first, window)


def grams_of(text: bytes, window: int) -> np.ndarray:
    return segment_grams(_words.words(np.frombuffer(text, np.uint8), np.array([0, len(text)])), window)


def segment_grams(w: _words.Words, window: int) -> np.ndarray:
    return _spans.grams(_words.mixed(w.hash + np.uint64(7)), min(GRAM, window))


def window_hashes(ws: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    h = np.array([xxhash.xxh3_64_intdigest(x) for x in ws], np.uint64)
    at = np.arange(len(ws) - window + 1)
    out = []
    for salt in (1, 2):
        prefix, down = _words.sums(_words.mixed(h * np.uint64(2 * salt + 1) + np.uint64(salt)))
        out.append(_words.spans(prefix, at, at + window, down).view(np.int64))
    return out[0], out[1]


def confirmed(rows: list[tuple[bytes, int, int]], window: int) -> list[tuple[list[bytes], list[int], list[int]]]:
    """Of segments (text, smallest and largest document), those that show recurring windows first: their words, the windows' places and first documents."""
    texts = [r[0].split(b" ") for r in rows]
    hashes = [window_hashes(x, window) for x in texts]
    one, two = (np.concatenate([h[k] for h in hashes]) for k in (0, 1))
    count = [len(h[0]) for h in hashes]
    seg = np.repeat(np.arange(len(rows)), count)
    at = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    least, most = (np.array([r[k] for r in rows], np.int64)[seg] for k in (1, 2))
    order = np.lexsort((seg, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    first = np.flatnonzero(new)
    low, high = np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first)
    sure = low < high
    where, low = order[first[sure]], low[sure]
    back = np.argsort(where)
    where, low = where[back], low[back]
    cut = np.searchsorted(seg[where], np.arange(len(rows) + 1)).tolist()
    return [(texts[k], at[where[a:b]].tolist(), low[a:b].tolist()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]


def merged(found: list[tuple[int, int]], window: int) -> tuple[list[int], list[int], list[int]]:
    """Occurrences (first word, first document) as runs: first word, end, first document."""
    lo, hi, first = [], [], []
    for i, f in found:
        if hi and first[-1] == f and i + window == hi[-1] + 1:
            hi[-1] += 1
        else:
            lo.append(i)
            hi.append(i + window)
            first.append(f)
    return lo, hi, first


PLACES = "seg binary, lo array<bigint>, hi array<bigint>, first array<bigint>"


def places_batch(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), *[pa.list_(pa.int64())] * 3), strict=True)], names=["seg", "lo", "hi", "first"])


class Automata:
    """Finds phrases of a fixed number of words, each with the first document that has it."""

    def __init__(self, window: int):
        self.window, self.done, self.letters, self.open, self.n = window, [], {}, None, 0

    def add(self, ws: list[bytes], at: list[int], firsts: list[int]) -> None:
        if self.open is None or self.n > PHRASES or len(self.letters) > LETTERS:
            self.close()
            self.open, self.letters, self.n = ahocorasick.Automaton(ahocorasick.STORE_ANY), {}, 0
        for w in ws:
            if w not in self.letters:
                i = len(self.letters) + 1
                self.letters[w] = chr(i if i < 0xD800 else i + 0x800)
        text = "".join([self.letters[w] for w in ws])
        for i, first in zip(at, firsts, strict=True):
            self.open.add_word(text[i : i + self.window], first)
        self.n += len(at)

    def close(self) -> None:
        if self.open is not None and self.n:
            self.open.make_automaton()
            self.done.append((self.open, self.letters))
        self.open = None

    def find(self, ws: list[bytes]) -> list[tuple[int, int]]:
        """(first word, first document) of each phrase in ws."""
        out = []
        for automaton, letters in self.done:
            text = "".join([letters.get(w, "\0") for w in ws])
            out += [(end - self.window + 1, first) for end, first in automaton.iter(text)]
        return sorted(out)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, max_filter_bits: int = BITS) -> DataFrame:
    """docs without the words covered by a window of so many words that also starts in a document with a smaller id.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. Returns the columns of docs, text_col holding the kept words joined by one space, then
    n_words (before) and n_removed, which take the place of columns of those names. Windows are judged on the input. Null and
    empty texts: no words, kept as "". Rows with a null id neither lose words nor make others lose any. Rows of one id never
    remove words of each other. Empty table: empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = _spans.tagged(docs, id_col, text_col).where("id is not null")

    def hashes(data, offs):
        """Of each different key of a text."""
        _, (doc, _, _, key) = segments(data, offs, window)
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        return key[new], np.searchsorted(doc[new], np.arange(len(offs)))

    rows, test = suspected(slim, hashes, max_filter_bits)

    def suspects(batches):
        segs: dict[bytes, list] = {}
        n = 0

        def flush():
            if segs:
                rows = list(segs.items())
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array([r[0] for _, r in rows], pa.int64()), "seg": pa.array([k for k, _ in rows], pa.binary()), "words": pa.array([r[1] for _, r in rows], pa.binary()),
                    "least": pa.array([min(r[2]) for _, r in rows], pa.int64()), "most": pa.array([max(r[2]) for _, r in rows], pa.int64()),
                    "ids": pa.array([r[2] for _, r in rows], pa.list_(pa.int64())), "tags": pa.array([r[3] for _, r in rows], pa.list_(pa.int64())), "starts": pa.array([r[4] for _, r in rows], pa.list_(pa.int64()))})

        for batch in batches:
            twice = test(batch.column(3))
            ids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for row, data, offs in _words.pieces(batch.column(2)):
                w, (doc, a, b, key) = segments(data, offs, window)
                yes = np.flatnonzero(twice.has(key))
                raw = data.tobytes() if len(yes) else b""
                for d, x, y, k in zip(doc[yes].tolist(), a[yes].tolist(), (b[yes] + window - 1).tolist(), key[yes].view(np.int64).tolist(), strict=True):
                    text = b" ".join(raw[w.start[x] : w.end[y]].split())
                    seg = xxhash.xxh3_128_digest(text)
                    r = segs.get(seg)
                    if r is None:
                        r = segs[seg] = [k, text, [], [], []]
                    r[2].append(int(ids[row + d]))
                    r[3].append(int(tags[row + d]))
                    r[4].append(x - int(w.first[d]))
                    n += 1
            if n >= 20_000:
                yield from flush()
                segs, n = {}, 0
        yield from flush()

    found = held(rows.mapInArrow(suspects, "key bigint, seg binary, words binary, least bigint, most bigint, ids array<bigint>, tags array<bigint>, starts array<bigint>"))
    def shard(batches):
        now, group = None, {}

        def done():
            rows = list(group.values())
            if not rows or len({r[1] for r in rows} | {r[2] for r in rows}) < 2:
                return
            passages = confirmed(rows, window)
            if not passages:
                return
            automata = Automata(window)
            for p in passages:
                automata.add(*p)
            automata.close()
            out = [(seg, *merged(automata.find(r[0].split(b" ")), window)) for seg, r in group.items()]
            out = [x for x in out if x[1]]
            if out:
                yield places_batch(out)

        for batch in batches:
            for key, seg, text, least, most in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if key != now:
                    yield from done()
                    now, group = key, {}
                held = group.get(seg)
                group[seg] = (text, min(least, held[1]), max(most, held[2])) if held else (text, least, most)
        yield from done()

    def divide(step: int):
        def run(batches):
            segs: dict[bytes, list] = {}
            n = 0

            def flush():
                if segs:
                    rows = list(segs.items())
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array([r[0] for _, r in rows], pa.int64()), "seg": pa.array([k for k, _ in rows], pa.binary()), "words": pa.array([r[1] for _, r in rows], pa.binary()), "least": pa.array([r[2] for _, r in rows], pa.int64()),
                        "most": pa.array([r[3] for _, r in rows], pa.int64()), "roots": pa.array([r[4] for _, r in rows], pa.list_(pa.binary())), "offs": pa.array([r[5] for _, r in rows], pa.list_(pa.int64()))})

            for batch in batches:
                for key, root, text, least, most in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    ws = text.split(b" ")
                    for x, y, place in _spans.by_place(grams_of(text, window), len(ws) - window + 1, step):
                        part = b" ".join(ws[x : y + window])
                        r = segs.setdefault(xxhash.xxh3_128_digest(part), [xxhash.xxh3_64_intdigest(b"%d %d" % (key, place)) - (1 << 63), part, least, most, [], []])
                        r[2], r[3] = min(r[2], least), max(r[3], most)
                        r[4].append(root)
                        r[5].append(x)
                        n += 1
                    if n >= 20_000:
                        yield from flush()
                        segs, n = {}, 0
            yield from flush()

        return run

    def places_of(rows: DataFrame, steps: tuple[int, ...]) -> DataFrame:
        """PLACES of recurring windows in the segments of rows (key, seg, words, least, most), of which several may be equal."""
        hot = held(rows.groupBy("key").agg(F.sum(F.octet_length("words")).alias("size")).where(F.col("size") > HOT).select("key"))
        usual = rows if hot.isEmpty() else rows.join(hot, "key", "left_anti")
        near = usual.repartition(deal(spark), "key").sortWithinPartitions("key").mapInArrow(shard, PLACES)
        if usual is rows:
            return near
        several = rows.join(hot, "key", "left_semi").groupBy("seg").agg(F.first("key").alias("key"), F.first("words").alias("words"), F.min("least").alias("least"), F.max("most").alias("most")).select("key", "seg", "words", "least", "most")
        parts = held(several.mapInArrow(divide(steps[0]), "key bigint, seg binary, words binary, least bigint, most bigint, roots array<binary>, offs array<bigint>"))
        if steps[0] == 1:  # a window each
            whole = parts.groupBy("seg").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most")
            inner = whole.select("seg", F.array(F.lit(0).cast("bigint")).alias("lo"), F.array(F.lit(window).cast("bigint")).alias("hi"), F.array("least").alias("first"))
        else:
            inner = places_of(parts.select("key", "seg", "words", "least", "most"), steps[1:])
        back = parts.select("seg", F.explode(F.arrays_zip("roots", "offs")).alias("o")).join(inner, "seg")
        return near.unionByName(back.select(F.col("o.roots").alias("seg"), F.transform("lo", lambda x: x + F.col("o.offs")).alias("lo"), F.transform("hi", lambda x: x + F.col("o.offs")).alias("hi"), "first"))

    places = places_of(found.select("key", "seg", "words", "least", "most"), STEPS)
    where = found.select("seg", F.explode(F.arrays_zip("ids", "tags", "starts")).alias("o")).join(places, "seg").select(F.col("o.ids").alias("id"), F.col("o.tags").alias("tag"), F.col("o.starts").alias("start"), F.explode(F.arrays_zip("lo", "hi", "first")).alias("p"))
    gone = where.where("p.first < id").select("id", "tag", (F.col("start") + F.col("p.lo")).alias("lo"), (F.col("start") + F.col("p.hi")).alias("hi"))
    keep = [k for k, c in enumerate(docs.columns) if c.lower() not in ("n_words", "n_removed")]
    place = docs.columns.index(text_col)

    def cut(batches):
        for batch in batches:
            columns = batch.column(0).flatten()
            texts, total, removed = [], [], []
            for text, spans in zip(columns[place].to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = (text or "").encode("utf-8").split()
                total.append(len(ws))
                if spans:
                    out = _spans.covered([(s["lo"], s["hi"]) for s in spans], len(ws))
                    removed.append(int(out.sum()))
                    ws = [w for w, o in zip(ws, out.tolist(), strict=True) if not o]
                else:
                    removed.append(0)
                texts.append(b" ".join(ws).decode("utf-8"))
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*(columns[k] for k in keep), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*(f"c{k}" for k in keep), "n_words", "n_removed"])

    schema = StructType([*(StructField(f"c{k}", StringType() if k == place else docs.schema[k].dataType) for k in keep), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    return _spans.meet(docs, id_col, text_col, gone).mapInArrow(cut, schema).toDF(*(docs.columns[k] for k in keep), "n_words", "n_removed")
