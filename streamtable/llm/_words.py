"""Words of whole Arrow columns of text, found and hashed with numpy on the UTF-8 bytes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PIECE = 1 << 18  # bytes of text worked on at once, unless one document has more; arrays of eight bytes for each keep to a processor's cache
BASE = np.uint64(0x5851F42D4C957F2D)
_back = pow(int(BASE), -1, 1 << 64)
_rng = np.random.default_rng(20240)
VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = VALUES.copy()
LOWER[65:91] = VALUES[97:123]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        for k, b in (("up", BASE), ("down", np.uint64(_back))):
            x = np.full(max(n, PIECE + 1), b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), the same wherever they stand. prefix: sums of value times power, from a leading 0."""
    return mixed((prefix[end] - prefix[start]) * down[start])


def sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out, down


def pieces(column: pa.Array, most: int = PIECE):
    """(first row, bytes, offsets from 0) of runs of rows. Nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


class Words(NamedTuple):
    start: np.ndarray  # bytes
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each document and, last, their number


def words(data: np.ndarray, offs: np.ndarray, values: np.ndarray = VALUES) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of each document."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64))
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = ~solid[:-1] | cut[1:-1]
    after[:-1] = ~solid[1:] | cut[1:-1]
    start, end = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    prefix, down = sums(values[data])
    return Words(start, end, spans(prefix, start, end, down), np.searchsorted(start, offs))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    full = np.full(-(-len(x) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[: len(x)] = x
    grid = full.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])
