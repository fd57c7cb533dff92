"""Benchmark decontamination by suffix arrays over the training texts.

1. Each task cuts its documents into shards of about SHARD_BYTES of text. The words of a shard become numbers, and the positions of the
   shard are sorted by the words that follow them, up to the longest item's length: the shard's suffix array, by doubling, where
   only positions that still tie are sorted again.
2. Every suffix of every item is searched in every shard by binary search, one word deeper at a time, so its interval shrinks
   to the positions of its longest verbatim match. The interval at a window's length holds all places of that window.
3. Places are marked as covered words; a document lies in one shard, so its counts need no shuffle.

The items go to the tasks in chunks of about CHUNK_BYTES of text, a chunk at a time; a benchmark of several chunks is searched in as
many passes, whose matches are joined by row.

Defined cases: null text, or text without words, has no words and is never hit; null or repeated item ids: null reads as the empty id, rows
of one id are one item, found if any of them is; items without words are never found; repeated documents are counted each; very long
texts are a shard of their own; an empty benchmark leaves all documents clean; an empty table gives no rows; other columns are ignored by
the report and pass through `clean` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorframe.llm import spans
from factorframe.llm.shared import stage

WINDOW = 10
SHARD_BYTES = 2 << 20
CHUNK_BYTES = 8 << 20
_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def worded(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts in order, and the number of the text of each."""
    data, offsets = spans.text_bytes(texts)
    data = spans.LOWER[data]
    inside = _INSIDE[data]
    start, end, text = spans.runs(inside, offsets)
    return spans.strings(data, inside, start, end), text


def room(text: np.ndarray) -> np.ndarray:
    """Words from each position to the end of its text, itself included."""
    n = len(text)
    last = np.searchsorted(text, text, side="right") if n else np.zeros(0, np.int64)
    return last - np.arange(n)


@dataclass
class Items:
    """One chunk of the benchmark: its words, and for each position the item and the length of the window that begins there."""

    words: pa.Array
    item: np.ndarray
    left: np.ndarray
    window: np.ndarray  # 0 where none begins
    place: np.ndarray  # of the word in its item
    ids: list[str]

    @staticmethod
    def of(rows: list[tuple[str, str]], window: int = WINDOW) -> Items:
        words, text = worded(pa.array([t for _, t in rows], pa.string()))
        left = room(text)
        begins = np.ones(len(text), bool)
        begins[1:] = text[1:] != text[:-1]
        size = np.where(left >= window, window, np.where(begins, left, 0))
        ids = sorted({i for i, _ in rows})
        number = {x: n for n, x in enumerate(ids)}
        item = np.array([number[i] for i, _ in rows], np.int64)[text]
        return Items(words, item, left, size, np.arange(len(text)) - np.searchsorted(text, text), ids)

    def most(self) -> int:
        return int(self.left.max()) if len(self.left) else 0


@dataclass
class Shard:
    codes: np.ndarray  # number of each word
    vocabulary: pa.Array
    text: np.ndarray
    left: np.ndarray
    order: np.ndarray  # positions, sorted by the words that follow

    @staticmethod
    def of(texts: pa.Array, depth: int) -> Shard:
        words, text = worded(texts)
        coded = words.dictionary_encode()
        codes, left = coded.indices.to_numpy().astype(np.int64), room(text)
        return Shard(codes, coded.dictionary, text, left, suffix_array(codes, left, depth))

    def edge(self, low: np.ndarray, high: np.ndarray, word: np.ndarray, d: int, right: bool) -> np.ndarray:
        """Within [low, high), the first place whose d-th word is not below word (right: is above it)."""
        low, high = low.copy(), high.copy()
        last = len(self.codes) - 1
        while (undecided := low < high).any():
            middle = (low + high) >> 1
            at = self.order[np.minimum(middle, last)]
            value = np.where(self.left[at] > d, self.codes[np.minimum(at + d, last)], -1)
            below = undecided & ((value <= word) if right else (value < word))
            low, high = np.where(below, middle + 1, low), np.where(undecided & ~below, middle, high)
        return low

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per item position: the interval of its window's places (empty if none), its longest match, and a place of that."""
        m = len(items.item)
        known = pc.index_in(items.words, value_set=self.vocabulary).fill_null(-1).to_numpy().astype(np.int64)
        low, high = np.zeros(m, np.int64), np.full(m, len(self.codes))
        begin, end, longest, place = (np.zeros(m, np.int64) for _ in range(4))
        open_, d = np.arange(m), 0
        while len(open_):
            open_ = open_[items.left[open_] > d]
            word = known[open_ + d]
            open_, word = open_[word >= 0], word[word >= 0]
            a = self.edge(low[open_], high[open_], word, d, False)
            b = self.edge(a, high[open_], word, d, True)
            open_, a, b = open_[a < b], a[a < b], b[a < b]
            low[open_], high[open_] = a, b
            d += 1
            longest[open_], place[open_] = d, self.order[a]
            whole = open_[items.window[open_] == d]
            begin[whole], end[whole] = low[whole], high[whole]
        return begin, end, longest, place


def suffix_array(codes: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next `depth` words at least; the end of a text sorts before any word."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    new = np.ones(n, bool)
    new[1:] = codes[order[1:]] != codes[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else 0
    h = 1
    while h < depth and not new.all():
        alone = new.copy()
        alone[:-1] &= new[1:]
        at = np.flatnonzero(~alone)
        who = order[at]
        after = np.where(left[who] > h, rank[np.minimum(who + h, n - 1)] + 1, 0)
        key = rank[who] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        order[at], key = who[by], key[by]
        differs = np.ones(len(at), bool)
        differs[1:] = key[1:] != key[:-1]
        new[at] = differs
        rank[order[at]] = np.maximum.accumulate(np.where(differs, at, 0))
        h *= 2
    return order


def expanded(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges begin..end, and the range of each."""
    n = end - begin
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[which], which


def marked(shard: Shard, items: Items, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words lie inside a window's place, and (text, item) pairs as text * items + item."""
    begin, end, _, _ = shard.search(items)
    there = np.flatnonzero(end > begin)
    cover = np.zeros(len(shard.codes) + 1, np.int64)
    # a window that several items hold has one interval
    intervals = np.unique(np.stack([begin[there], end[there], items.window[there]], axis=1), axis=0)
    places, which = expanded(intervals[:, 0], intervals[:, 1])
    at = shard.order[places]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + intervals[which, 2], -1)
    places, which = expanded(begin[there], end[there])
    pairs = np.unique(shard.text[shard.order[places]] * len(items.ids) + items.item[there][which]) if len(places) else np.zeros(0, np.int64)
    return np.cumsum(cover[:-1]) > 0, pairs


def chunks_of(benchmark: DataFrame, chunk_bytes: int, window: int):
    """The benchmark as bounded Items, one after the other; at least one."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // chunk_bytes))
    if n > 1:
        rows = stage(rows.withColumn("chunk", F.pmod(F.xxhash64("item", "text"), F.lit(n))))
    for c in range(n):
        yield n, Items.of([(r[0], r[1]) for r in (rows if n == 1 else rows.where(F.col("chunk") == c)).select("item", "text").collect()], window)


REPORT = "doc_id long, digest binary, n_words long, hits array<int>, items array<string>"


def matched(docs: DataFrame, items: Items, digests: bool) -> DataFrame:
    """doc_id, digest (of the text, if asked for), n_words, hits (begin and end of covered runs of words), items found."""
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most about CHUNK_BYTES of text

    def run(batches):
        test = shared.value
        depth = test.most()
        for batch in batches:
            for part in spans.slices(batch, limit=SHARD_BYTES):
                shard = Shard.of(part.column("text"), depth)
                m = part.num_rows
                cover, pairs = marked(shard, test, m)
                step = np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))
                first = np.searchsorted(shard.text, np.arange(m + 1))
                # runs end at the border of their text
                inner = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(cover))]
                cuts = np.unique(inner[cover[inner] & cover[inner - 1]])
                begins, ends = np.sort(np.concatenate([np.flatnonzero(step == 1), cuts])), np.sort(np.concatenate([np.flatnonzero(step == -1), cuts]))
                owner = shard.text[begins]
                flat = (np.stack([begins, ends], axis=1) - first[owner][:, None]).ravel()
                hit_ends = 2 * np.searchsorted(owner, np.arange(m + 1))
                item_ends = np.searchsorted(pairs, np.arange(m + 1) * len(test.ids))
                ids = pa.array(test.ids, pa.string()).take(pa.array(pairs % max(1, len(test.ids))))
                texts = part.column("text").to_pylist() if digests else []
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"),
                    pa.array([hashlib.sha256((t or "").encode()).digest() for t in texts], pa.binary()) if digests else pa.nulls(m, pa.binary()),
                    pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(hit_ends, pa.int32()), pa.array(flat, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(item_ends, pa.int32()), ids)], names=["doc_id", "digest", "n_words", "hits", "items"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, REPORT)


# words covered by [begin, end, begin, end, ...]: runs sorted, each counted from where the ones before end
_COVERED = """aggregate(array_sort(transform(sequence(0, size(hits) div 2 - 1), i -> struct(hits[2 * i] AS b, hits[2 * i + 1] AS e))),
  struct(0 AS n, 0 AS upto), (s, x) -> struct(s.n + greatest(0, x.e - greatest(x.b, s.upto)) AS n, greatest(s.upto, x.e) AS upto), s -> s.n)"""


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    passes = [(n, matched(docs, items, n > 1)) for n, items in chunks_of(benchmark, chunk_bytes, window)]
    if len(passes) == 1:
        found = passes[0][1]
    else:
        # rows of equal id and text have equal matches: one group, given back as often as it came
        n = passes[0][0]
        every = stage(passes[0][1])
        for _, more in passes[1:]:
            every = every.unionByName(stage(more))
        found = every.groupBy("doc_id", "digest", "n_words").agg(
            F.flatten(F.collect_set("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
            (F.count("*") / n).cast("int").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    n_hit = F.when(F.size("hits") > 0, F.expr(_COVERED)).otherwise(0).cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of docs that hold no window of any item, all columns."""
    schema = docs.schema
    for _, items in chunks_of(benchmark, chunk_bytes, window):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            test = shared.value
            for batch in batches:
                for part in spans.slices(batch, limit=SHARD_BYTES):
                    shard = Shard.of(part.column("text"), test.most())
                    _, pairs = marked(shard, test, part.num_rows)
                    good = np.ones(part.num_rows, bool)
                    good[pairs // max(1, len(test.ids))] = False
                    yield part.filter(pa.array(good))
        docs = docs.mapInArrow(run, schema)
    return docs


def longest_matches(docs: DataFrame, benchmark: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """item_id (as text), length, item_word, doc_id, doc_word: the longest verbatim match of each item, and one place of it.

    The place is the one the sorted positions of a shard show first; between shards and between matches of equal length, ties go to the
    smallest doc_id (null first), then the first word in item and document. Items none of whose words occur give no row. A task keeps one row per item.
    """
    best = None
    for _, items in chunks_of(benchmark, chunk_bytes, WINDOW):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            test, top = shared.value, {}
            low = -(1 << 63)
            for batch in batches:
                for part in spans.slices(batch, limit=SHARD_BYTES):
                    shard = Shard.of(part.column("text"), test.most())
                    ids = part.column("doc_id").to_pylist()
                    first = np.searchsorted(shard.text, np.arange(part.num_rows + 1))
                    _, _, longest, place = shard.search(test)
                    for j in np.flatnonzero(longest):
                        t = shard.text[place[j]]
                        d = ids[t]
                        row = (-int(longest[j]), low if d is None else d, int(test.place[j]), int(place[j] - first[t]), d)
                        i = int(test.item[j])
                        if i not in top or row[:4] < top[i][:4]:
                            top[i] = row
            rows = [(test.ids[i], -r[0], r[2], r[4], r[3]) for i, r in top.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                zip(*rows) if rows else ((),) * 5, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                names=["item_id", "length", "item_word", "doc_id", "doc_word"])
        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            run, "item_id string, length long, item_word long, doc_id long, doc_word long")
        best = found if best is None else best.unionByName(found)
    order = F.struct(-F.col("length"), F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")), "item_word", "doc_word")
    return best.groupBy("item_id").agg(F.min_by(F.struct("length", "item_word", "doc_id", "doc_word"), order).alias("m")).select("item_id", "m.*")


SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes WHERE len(w) >= k)),
found AS (SELECT g.r, g.i, g.k, x.item FROM grams g JOIN windows x ON x.k = g.k AND x.gram = g.gram),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit h ON h.r = w.r LEFT JOIN named m ON m.r = w.r
"""
