"""A byte n-gram model of words in an Elias-Fano trie.

A word is the bytes between two boundary marks. Level k holds the k-grams in order; its sequence parent * 256 + last byte is
monotone and kept in Elias-Fano form, the first child of each parent is a second monotone sequence, and the smoothed log10
probability and back-off weight of each k-gram are one byte each (a linear code per level). A query walks down from every
byte at once: the successor of a context is searched only between the context's pointers.

Smoothing is interpolated Witten-Bell down to a uniform distribution over 256 bytes, so every byte string has a probability.
"""

from __future__ import annotations

import io
import os
import tempfile

import numpy as np

MARK = 32  # white space never occurs in a word


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary; `starts` counts the elements below each high part."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int, n: int):
        self.low, self.high, self.bits, self.n = low, high, bits, n
        ones = np.flatnonzero(np.unpackbits(high, bitorder="little"))[:n]
        # the i-th one stands at value >> bits plus i
        buckets = ones - np.arange(n)
        self.starts = np.searchsorted(buckets, np.arange((int(buckets[-1]) if n else 0) + 2)).astype(np.uint32)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[np.ndarray, np.ndarray, int]:
        n = len(values)
        bits = max(0, int(np.log2(max(1, universe / max(1, n)))))
        parts = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
        low = np.packbits(parts.reshape(-1), bitorder="little")
        unary = np.zeros((int(values[-1]) >> bits) + n + 1 if n else 1, np.uint8)
        unary[(values >> bits) + np.arange(n)] = 1
        return low, np.packbits(unary, bitorder="little"), bits

    def lows(self, at: np.ndarray) -> np.ndarray:
        """Low bits of the elements at these places."""
        out = np.zeros(len(at), np.int64)
        bit = at * self.bits
        for j in range(self.bits):
            b = bit + j
            out |= ((self.low[b >> 3] >> (b & 7)) & 1).astype(np.int64) << j
        return out

    def find(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each value within [begin, end), or -1."""
        high = values >> self.bits
        top = len(self.starts) - 2
        inside = high <= top
        high = np.minimum(high, top)
        lo = np.maximum(self.starts[high].astype(np.int64), begin)
        hi = np.minimum(self.starts[high + 1].astype(np.int64), end)
        hi = np.where(inside, hi, lo)
        want = values & ((1 << self.bits) - 1)
        out = np.full(len(values), -1, np.int64)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):  # a bucket holds one or two elements on average
            mid = (lo[open_] + hi[open_]) >> 1
            got = self.lows(mid)
            w = want[open_]
            out[open_[got == w]] = mid[got == w]
            lo[open_] = np.where(got < w, mid + 1, lo[open_])
            hi[open_] = np.where(got < w, hi[open_], mid)
            open_ = open_[(lo[open_] < hi[open_]) & (got != w)]
        return out


def coded(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """One byte per value on a line from the least to the largest."""
    low, high = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    step = (high - low) / 255 or 1.0
    return np.round((x - low) / step).astype(np.uint8), low, step


def ngrams(data: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-grams (k up to order) of marked words with summed weights; a key is the bytes from the top and k below."""
    size = end - start + 2
    ends = np.cumsum(size)
    text = np.full(int(ends[-1]) if len(ends) else 0, MARK, np.uint64)
    inner = np.repeat(start - (ends - size) - 1, size) + np.arange(len(text))
    is_byte = np.ones(len(text), bool)
    is_byte[ends - size] = is_byte[ends - 1] = False
    text[is_byte] = data[inner[is_byte]]
    word_end, w = np.repeat(ends, size), np.repeat(weight, size)
    keys, sums = [], []
    key = np.zeros(len(text), np.uint64)
    at = np.arange(len(text))
    for k in range(1, order + 1):
        fits = at + k <= word_end[at]
        at = at[fits]
        key = key[fits] | text[at + k - 1] << np.uint64(64 - 8 * k)
        # a lone opening mark is a context, not an event
        event = at != (word_end - np.repeat(size, size))[at] if k == 1 else np.ones(len(at), bool)
        found, back = np.unique(key[event] | np.uint64(k), return_inverse=True)
        keys.append(found)
        sums.append(np.bincount(back.reshape(-1), weights=w[at[event]], minlength=len(found)).astype(np.int64))
    return np.concatenate(keys), np.concatenate(sums)


def windows(data: np.ndarray, start: np.ndarray, end: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and closing mark of the words, the longest k-gram that ends there, and its word."""
    size = end - start + 2
    ends = np.cumsum(size)
    text = np.full(int(ends[-1]) if len(ends) else 0, MARK, np.uint64)
    is_byte = np.ones(len(text), bool)
    is_byte[ends - size] = is_byte[ends - 1] = False
    text[is_byte] = data[(np.repeat(start - (ends - size) - 1, size) + np.arange(len(text)))[is_byte]]
    first, word = np.repeat(ends - size, size), np.repeat(np.arange(len(start)), size)
    at = np.arange(len(text))
    at, first, word = at[at > first], first[at > first], word[at > first]
    k = np.minimum(at - first + 1, order)
    key = np.zeros(len(at), np.uint64)
    for j in range(order):
        here = np.flatnonzero(j < k)
        key[here] |= text[at[here] - k[here] + 1 + j] << np.uint64(56 - 8 * j)
    return key | k.astype(np.uint64), word


def smoothed(gram: np.ndarray, count: np.ndarray, k: int, shorter: np.ndarray | None, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k-grams in order and their probabilities; lower holds those of the grams `shorter`, or of all (k-1)-grams by value."""
    by = np.argsort(gram)
    g, c = gram[by], count[by].astype(float)
    _, parent = np.unique(g >> np.uint64(72 - 8 * k), return_inverse=True)
    parent = parent.reshape(-1)
    total, kinds = np.bincount(parent, c), np.bincount(parent).astype(float)
    suffix = g << np.uint64(8)
    below = lower[(suffix >> np.uint64(72 - 8 * k)).astype(int)] if shorter is None else lower[np.searchsorted(shorter, suffix)]
    return g, (c + kinds[parent] * below) / (total[parent] + kinds[parent])


def short_tables(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of all bytes, and of all pairs of bytes by 256 * first + second (1 where the pair is not counted)."""
    length = keys & np.uint64(7)
    c = np.zeros(256)
    c[(keys[length == 1] >> np.uint64(56)).astype(int)] = counts[length == 1]
    total, kinds = c.sum(), float((c > 0).sum())
    one = (c + kinds / 256) / (total + kinds) if total else np.full(256, 1 / 256)
    g, p = smoothed(keys[length == 2] & ~np.uint64(255), counts[length == 2], 2, None, one)
    two = np.ones(1 << 16)
    two[(g >> np.uint64(48)).astype(int)] = p
    return one, two


def build(keys: np.ndarray, counts: np.ndarray, order: int) -> bytes:
    """The trie of all k-grams, as the bytes of an .npz file."""
    length = (keys & np.uint64(7)).astype(int)
    gram = keys & ~np.uint64(255)
    out, upper = {"order": np.array(order)}, None
    for k in range(1, order + 1):
        mine = length == k
        by = np.argsort(gram[mine], kind="stable")
        g, c = gram[mine][by], counts[mine][by].astype(float)
        if k == 1:  # every byte, so that any text has a path
            full = np.zeros(256)
            full[(g >> np.uint64(56)).astype(int)] = c
            g, c = np.arange(256, dtype=np.uint64) << np.uint64(56), full
            total, kinds = c.sum(), float((c > 0).sum())
            p = (c + kinds / 256) / (total + kinds) if total else np.full(256, 1 / 256)
            parent = np.zeros(256, np.int64)
        else:
            prefix = g & (np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(64 - 8 * (k - 1)))
            parent = np.searchsorted(upper["g"], prefix)
            n = len(upper["g"])
            total, kinds = np.bincount(parent, c, n), np.bincount(parent, minlength=n).astype(float)
            upper["bow"] = np.where(kinds > 0, kinds / np.maximum(total + kinds, 1), 1.0)
            lower = upper["p"][np.searchsorted(upper["g"], g << np.uint64(8))]
            p = (c + kinds[parent] * lower) / (total[parent] + kinds[parent])
            children = np.searchsorted(parent, np.arange(n + 1))
            save_level(out, k - 1, upper, children)
        upper = {"g": g, "p": p, "bow": np.ones(len(g)), "parent": parent}
    save_level(out, order, upper, np.zeros(len(upper["g"]) + 1, np.int64))
    target = io.BytesIO()
    np.savez(target, **out)
    return target.getvalue()


def save_level(out: dict, k: int, level: dict, children: np.ndarray) -> None:
    values = level["parent"] * 256 + ((level["g"] >> np.uint64(64 - 8 * k)) & np.uint64(255)).astype(np.int64)
    for name, x, universe in (("seq", values, int(values[-1]) + 1 if len(values) else 1), ("ptr", children, int(children[-1]) + 1)):
        low, high, bits = EliasFano.encode(x, universe)
        out |= {f"{name}{k}_low": low, f"{name}{k}_high": high, f"{name}{k}_head": np.array([bits, len(x)])}
    for name in ("p", "bow"):
        code, low, step = coded(np.log10(level[name]))
        out |= {f"{name}{k}_code": code, f"{name}{k}_line": np.array([low, step])}


class WordModel:
    """The trie, its arrays mapped from one unlinked file."""

    def __init__(self, blob: bytes):
        with np.load(io.BytesIO(blob)) as parts:
            arrays = {n: parts[n] for n in parts.files}
        big = [n for n, x in arrays.items() if x.dtype == np.uint8]
        handle, path = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as f:
            for n in big:
                f.write(arrays[n].tobytes())
        mapped = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
        os.unlink(path)  # the mapping keeps the data, and nothing stays behind
        at = 0
        for n in big:
            arrays[n], at = mapped[at: at + len(arrays[n])], at + len(arrays[n])
        self.order = int(arrays["order"])
        ef = lambda n: EliasFano(arrays[f"{n}_low"], arrays[f"{n}_high"], *map(int, arrays[f"{n}_head"]))
        self.seq = [None] + [ef(f"seq{k}") for k in range(1, self.order + 1)]
        self.code = {n: [None] + [(arrays[f"{n}{k}_code"], *arrays[f"{n}{k}_line"]) for k in range(1, self.order + 1)] for n in ("p", "bow")}
        self.ptr = [None]
        for k in range(1, self.order + 1):
            e = ef(f"ptr{k}")
            ones = np.flatnonzero(np.unpackbits(e.high, bitorder="little"))[: e.n] - np.arange(e.n)
            self.ptr.append((ones << e.bits | e.lows(np.arange(e.n))).astype(np.uint32))

    def value(self, kind: str, k: int, node: np.ndarray) -> np.ndarray:
        code, low, step = self.code[kind][k]
        return code[node] * step + low

    def score(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """log10 probability of each word data[start:end], closing mark included."""
        size = end - start + 2
        ends = np.cumsum(size)
        n = int(ends[-1]) if len(ends) else 0
        text = np.full(n, MARK, np.int64)
        is_byte = np.ones(n, bool)
        is_byte[ends - size] = is_byte[ends - 1] = False
        text[is_byte] = data[(np.repeat(start - (ends - size) - 1, size) + np.arange(n))[is_byte]]
        word = np.repeat(np.arange(len(start)), size)
        stop = np.repeat(ends, size)
        # the event at a byte: longest known gram ending there, times the back-off of longer known contexts
        result = np.zeros(n)
        node = text.copy()  # level 1 has every byte, in order
        at = np.arange(n)
        result[:] = self.value("p", 1, node)
        for k in range(2, self.order + 1):
            fits = at + k <= stop[at]
            at, node = at[fits], node[fits]
            event = at + k - 1
            begin, until = self.ptr[k - 1][node].astype(np.int64), self.ptr[k - 1][node + 1].astype(np.int64)
            child = self.seq[k].find(node * 256 + text[event], begin, until)
            known = child >= 0
            # a context without successors has back-off weight 1
            result[event[~known]] += self.value("bow", k - 1, node[~known])
            result[event[known]] = self.value("p", k, child[known])
            at, node = at[known], child[known]
        result[ends - size] = 0
        return np.bincount(word, result, len(start))
