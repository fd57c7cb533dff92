"""Packing by concatenate and cut.

Pass one tokenises every text and writes, per Spark partition, the documents with their offset inside the partition. The
partition totals (one row per task) are prefix-summed, which gives each document its global offset; pass two cuts at fixed
windows and records each piece with its sequence and offset. All sequences but the last are full.

Tokenising splits a text into the same pre-tokens as the tokenizer's own pattern, vectorised over the batch, and runs the
tokenizer once per distinct pre-token of a worker. Texts with an apostrophe (contractions) or characters beyond the basic
plane go through the tokenizer as a whole.

Defined cases: null text is empty and gives the end id alone; repeated rows are separate documents; an empty table gives no
rows; a text of any length is cut into as many pieces as needed; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorframe.llm import spans
from factorframe.llm.shared import stage, text_or_empty

WINDOW = 2048
END = 1
CACHE_TOKENS = 800_000  # about 30 MB in a worker
CUT_ROWS = 1000
LETTER, NUMBER, BLANK, OTHER = range(4)
BEYOND = re.compile("[\U00010000-\U0010ffff]")
_workers: dict[str, "PieceTokenizer"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def character_classes() -> np.ndarray:
    """Class of each character of the basic plane: letter, number, white space or other."""
    kinds = np.full(1 << 16, OTHER, np.uint8)
    for c in range(1 << 16):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kinds[c] = LETTER
        elif major == "N":
            kinds[c] = NUMBER
    # fixed values: the characters with the White_Space property
    kinds[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    return kinds


class PieceTokenizer:
    """Token ids of many texts, by one call of the tokenizer per distinct pre-token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism; threads only cost memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings inside a text are ordinary text
        self.kinds = character_classes()
        self.values = spans.stream64(3, 1 << 16)
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.ends = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        kinds = ["empty" if not t else "plain" if "'" not in t and not BEYOND.search(t) else "whole" for t in texts]
        done = {"empty": repeat(np.zeros(0, np.int32)),
                "plain": iter(self._plain([t for t, k in zip(texts, kinds) if k == "plain"])),
                "whole": iter(self.whole([t for t, k in zip(texts, kinds) if k == "whole"]))}
        return [next(done[k]) for k in kinds]

    def starts(self, chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pre-tokens start: runs of one class, each with one space before it; of longer blanks the last is its own."""
        kind = self.kinds[chars]
        n = len(kind)
        begins = np.zeros(n + 1, bool)
        begins[0] = True
        begins[ends[:-1]] = True
        change = begins.copy()
        change[1:n] |= kind[1:] != kind[:-1]
        last = np.zeros(n, bool)
        last[ends[1:] - 1] = True
        # a blank followed by something: the end of its run
        blank_end = (kind == BLANK) & ~last
        blank_end[:-1] &= kind[1:] != BLANK
        at = np.flatnonzero(blank_end)
        begins_at = change[:n].copy()
        begins_at[at] = True
        joined = at[chars[at] == 32] + 1
        begins_at[joined] = False
        return np.flatnonzero(begins_at)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        start = self.starts(chars, ends)
        stop = np.append(start[1:], len(chars))
        keys = spans.run_hashes(self.values[chars], start, stop)
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        found = (at < len(self.keys)) & (self.keys[np.minimum(at, max(len(self.keys) - 1, 0))] == distinct) if len(self.keys) else np.zeros(len(distinct), bool)
        if not found.all():
            if len(self.keys) + (~found).sum() > CACHE_TOKENS:
                self.clear()
                found[:] = False
            new = where[~found]
            encoded = self.tokenizer.encode_batch_fast([joined[a:b] for a, b in zip(start[new].tolist(), stop[new].tolist())], add_special_tokens=False)
            lists = [x.ids for x in encoded]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            slot = np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(lists))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))])
            place = np.searchsorted(self.keys, distinct[~found])
            self.keys, self.slots = np.insert(self.keys, place, distinct[~found]), np.insert(self.slots, place, slot)
            at = np.searchsorted(self.keys, distinct)
        slot = self.slots[at][back.reshape(-1)]
        size = self.ends[slot + 1] - self.ends[slot]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.ends[slot] - before[:-1], size) + np.arange(before[-1])]
        return np.split(ids, before[np.searchsorted(start, ends[1:-1])])


def worker_tokenizer(path: str) -> PieceTokenizer:
    if path not in _workers:
        _workers[path] = PieceTokenizer(path)
    return _workers[path]


def tokenised(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, ids (little-endian unsigned 16 or 32 bits), wide, part, place (ids of the partition before this document), tokens."""
    def run(batches):
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        tokenizer = worker_tokenizer(path)
        for batch in batches:
            for piece in spans.slices(batch):
                ids = [np.append(x, end) for x in tokenizer.encode(piece.column("text").to_pylist())]
                sizes = np.array([len(x) for x in ids], np.int64)
                places = place + np.cumsum(sizes) - sizes
                place += int(sizes.sum())
                blobs = [x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"), pa.array(blobs, pa.binary()), pa.array(np.full(len(ids), part)), pa.array(places), pa.array(sizes),
                ], names=["doc_id", "ids", "part", "place", "tokens"])
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, ids binary, part long, place long, tokens long")


def cut(placed: DataFrame, window: int) -> DataFrame:
    """placed (doc_id, ids, tokens, at) -> pieces at fixed windows, with their ids."""
    def run(batches):
        for batch in (b.slice(a, CUT_ROWS) for b in batches for a in range(0, b.num_rows, CUT_ROWS)):
            out = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for doc, blob, tokens, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "tokens", "at"))):
                ids = np.frombuffer(blob, "<u2" if len(blob) == 2 * tokens else "<u4").astype("<u4")
                begin = 0
                while begin < tokens:
                    sequence, offset = divmod(at + begin, window)
                    length = min(tokens - begin, window - offset)
                    raw = ids[begin: begin + length].tobytes()
                    for name, value in zip(out, (doc, begin, length, zlib.crc32(raw), tokens, sequence, offset, raw)):
                        out[name].append(value)
                    begin += length
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))
    return placed.select("doc_id", "ids", "tokens", "at").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, end: int = END) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32 bits)."""
    rows = stage(tokenised(docs, path or default_tokenizer(), end))
    # one row per task of the first pass
    totals = rows.groupBy("part").agg(F.sum("tokens").alias("all"))
    bases = totals.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    return cut(rows.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("place")), window)
