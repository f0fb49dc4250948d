"""Runs of windows that share their least k-gram, and spans of documents that are to go."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamtable.llm import _words


def runs(grams: np.ndarray, width: int, begin: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, last window, key) of runs of windows whose least k-gram hash is the same.

    grams: the hash of the k-gram from each unit on; a window spans window units and so width grams; begin: the first unit of each
    document and, last, the end. Equal windows have equal keys wherever they stand, so they meet under their key.
    """
    count = np.maximum(np.diff(begin) - window + 1, 0)
    if not count.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    least = _words.sliding_min(grams, width)
    doc = np.repeat(np.arange(len(count)), count)
    at = begin[:-1][doc] + np.arange(len(doc)) - np.concatenate([[0], np.cumsum(count)])[doc]
    m = least[at]
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(m)]]) - 1
    return doc[first], at[first], at[last], _words.mixed(m[first])


def by_place(g: np.ndarray, windows: int, step: int) -> list[tuple[int, int, int]]:
    """(first window, last window, place) of the runs of a segment's windows in which its least k-gram g stands at about the same place.

    Places are counted from the window's beginning to the first such k-gram, so many (step) of them as one, and equal windows agree in them.
    With a step of one, every window is a run of its own, in periodic text too.
    """
    at = np.flatnonzero(g == g.min())
    first = np.arange(windows)
    place = (at[np.searchsorted(at, first)] - first) // step
    new = first if step == 1 else np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return list(zip(new.tolist(), np.append(new[1:] - 1, windows - 1).tolist(), place[new].tolist(), strict=True))


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values; the last ones, cut short, are never part of a whole window."""
    prefix, down = _words.sums(values)
    at = np.arange(max(0, len(values) - k + 1))
    return _words.spans(prefix, at, at + k, down)


def covered(spans: list, n: int) -> np.ndarray:
    """Which of n units the spans [lo, hi) cover."""
    mark = np.zeros(n + 1, np.int32)
    for lo, hi in spans:
        mark[lo] += 1
        mark[hi] -= 1
    return np.cumsum(mark[:n]) > 0


def tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, text): the tag tells rows of one id with different texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def meet(docs: DataFrame, id_col: str, text_col: str, spans: DataFrame) -> DataFrame:
    """(row: struct of docs' columns c0, c1 ..., spans: array<struct<lo, hi>>) of each row of docs, from spans (id, tag, lo, hi)."""
    gone = spans.groupBy("id", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row"), F.col(id_col).cast("bigint").alias("own"), F.xxhash64(text).alias("own_tag"))
    return whole.join(gone, (whole["own"] == gone["id"]) & (whole["own_tag"] == gone["tag"]), "left").select("row", "spans")
