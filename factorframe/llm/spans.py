"""Words of whole Arrow text batches as NumPy arrays: places and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream64(seed: int, n: int) -> np.ndarray:
    """n pseudo-random values from a seed, the same everywhere."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUE = stream64(1, 256)
BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run values[start:end] of uint64 by differences of one prefix sum."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        raw = (sums[end] - sums[start]) * down[start]
        return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Words:
    data: np.ndarray  # bytes, A-Z in lower case
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # words of document d are first[d]:first[d + 1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of the texts; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> Words:
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    inside = ~SPACE[data]
    full = offsets[1:] > offsets[:-1]
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    before[offsets[:-1][full]] = False
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    after[offsets[1:][full] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, doc, start, end, run_hashes(BYTE_VALUE[data], start, end), first)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Pieces of a batch with about limit bytes of text each; a longer text is a piece of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the maximal runs of true bytes; a run never crosses the border of two texts."""
    full = offsets[1:] > offsets[:-1]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = offsets[:-1][full]
    opens[heads] = inside[heads]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    tails = offsets[1:][full] - 1
    closes[tails] = inside[tails]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return start, end, text


def strings(data: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeStringArray:
    """The runs as an Arrow column; the runs must be all of inside, which starts and ends at whole characters."""
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data[inside]))
