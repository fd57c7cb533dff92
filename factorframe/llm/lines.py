"""Substring dedup by hashing lines, the sentences inside them and content-defined pieces.

A unit is a line, a sentence of a line (up to . ! or ? before white space), or a piece of a line between two cuts that its words
choose: a cut stands before a word whose hash with the next word is the least of REACH words on each side, so that equal passages are
cut alike wherever their sentences begin. Units are runs of whole words, at least MIN_WORDS of them, pieces more than REACH. A unit's
digest is two 64-bit hashes of its words (A-Z in lower case), from different hashes of the words themselves, so white space does not count.
Whole batches of text are cut and hashed as arrays, without a loop over words. Digests are grouped over the whole corpus with a partial
aggregate that keeps the earliest occurrence, by (doc_id, place), so a line that stands in every document costs one row per
task. Only digests seen twice join back to their occurrences; all but the earliest are removed, with their offsets in the
original text kept. Sentences and pieces catch repeated passages whose ends fall inside lines; what lies between an end of a passage
and its nearest cut stays.

Defined cases: null or empty text has no units and stays as it is; units repeated in one document keep their first place; of equal units
at equal places of rows that share a doc_id, all stay; cuts return to the row they come from, by doc_id (null equals null) and a hash of the
text, so rows that share a doc_id, or have none, lose only their own repeats; very long texts are a batch of their own; an empty table
gives no rows; other columns are ignored by the report and pass through `without_repeats` untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorframe.llm import spans
from factorframe.llm.shared import release, stage

MIN_WORDS = 5
REACH = 7
_SECOND_BYTE = spans.stream64(17, 256)
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def marks(words: np.ndarray) -> np.ndarray:
    """One number per pair of neighbouring word hashes, that the cuts go by."""
    with np.errstate(over="ignore"):
        return spans.mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ spans.mix64(words[1:]))


def cuts(mark: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Words that a piece begins with: those whose mark is below the REACH before it and not above the REACH after it, all in its line."""
    n = len(mark)
    if n < 2 * REACH + 1:
        return np.zeros(0, np.int64)
    x = mark[REACH: n - REACH]
    least = line[: n - 2 * REACH] == line[2 * REACH + 1: n + 1]  # the last of these marks ends with the word after it
    for d in range(1, REACH + 1):
        least &= (x < mark[REACH - d: n - REACH - d]) & (x <= mark[REACH + d: n - REACH + d])
    return np.flatnonzero(least) + REACH


def units(texts: pa.Array, min_words: int = MIN_WORDS) -> tuple[np.ndarray, ...]:
    """text, begin, end (code points), words, and two hashes of each unit."""
    w = spans.words(texts)
    _, offsets = spans.text_bytes(texts)
    if not len(w.hash):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    feeds = np.flatnonzero(w.data == 10)
    line = np.searchsorted(feeds, w.start)
    new_line = np.ones(len(line), bool)
    new_line[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
    line = np.cumsum(new_line)
    new_sentence = new_line.copy()
    new_sentence[1:] |= _STOP[w.data[w.end[:-1] - 1]]

    def segments(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = np.flatnonzero(opens)
        return a, np.append(a[1:], len(opens))

    c = cuts(marks(w.hash), line)
    between = line[c[1:]] == line[c[:-1]]
    found = [segments(new_line), segments(new_sentence), (c[:-1][between], c[1:][between])]
    kind = np.repeat(np.arange(3), [len(a) for a, _ in found])
    first, last = (np.concatenate(x) for x in zip(*found))
    keep = last - first >= min_words
    first, last, kind = first[keep], last[keep], kind[keep]
    # equal runs of words count once, as the widest kind
    _, once = np.unique(first * np.int64(len(line) + 1) + last, return_index=True)
    first, last, kind = first[once], last[once], kind[once]
    begin, end, text = w.start[first], w.end[last - 1], w.doc[first]
    whole = kind == 0  # a line is removed from feed to feed
    if len(feeds):
        before = np.searchsorted(feeds, begin)
        left = np.where(before > 0, feeds[np.maximum(before - 1, 0)] + 1, 0)
        after = np.searchsorted(feeds, end)
        right = np.where(after < len(feeds), feeds[np.minimum(after, len(feeds) - 1)], len(w.data))
    else:
        left, right = np.zeros(len(begin), np.int64), np.full(len(begin), len(w.data))
    begin = np.where(whole, np.maximum(left, offsets[text]), begin)
    end = np.where(whole, np.minimum(right, offsets[text + 1]), end)
    points = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((w.data & 0xC0) != 0x80, out=points[1:])
    base = points[offsets[text]]
    second = spans.run_hashes(_SECOND_BYTE[w.data], w.start, w.end)
    return (text, points[begin] - base, points[end] - base, last - first,
            spans.run_hashes(w.hash, first, last).view(np.int64), spans.run_hashes(second, first, last).view(np.int64))


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, row_hash (of the text), begin, end, words, high and low half of the digest."""
    def run(batches):
        for batch in batches:
            for part in spans.slices(batch):
                text, begin, end, words, high, low = units(part.column("text"), min_words)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(text)), part.column("row_hash").take(pa.array(text)), pa.array(begin, pa.int32()),
                    pa.array(end, pa.int32()), pa.array(words, pa.int32()), pa.array(high), pa.array(low),
                ], names=["doc_id", "row_hash", "begin", "end", "words", "high", "low"])
    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_hash"), "text")
    return slim.mapInArrow(run, "doc_id long, row_hash long, begin int, end int, words int, high long, low long")


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed unit: doc_id, row_hash, begin, end, words, keep_doc_id, keep_begin."""
    seen = stage(occurrences(docs, min_words))
    low = F.lit(-(1 << 63)).cast("long")
    first = seen.groupBy("high", "low").agg(
        F.min(F.struct(F.coalesce("doc_id", low).alias("rank"), F.col("begin"), F.col("doc_id"))).alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = stage(first.select("high", "low", "first.rank", F.col("first.begin").alias("keep_begin"), F.col("first.doc_id").alias("keep_doc_id")))
    # repeated digests grow with the corpus, so both sides are dealt by digest at every size
    again = seen.join(shared, ["high", "low"]).where(
        ~((F.coalesce("doc_id", low) == F.col("rank")) & (F.col("begin") == F.col("keep_begin"))))
    return again.select("doc_id", "row_hash", "begin", "end", "words", "keep_doc_id", "keep_begin")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed unit: doc_id, begin, end, words, keep_doc_id, keep_begin."""
    return repeated(docs, min_words).drop("row_hash")


def cut_out(text: str, spans_: list[tuple[int, int]]) -> str:
    """text without the spans; a line that loses everything goes with its line feed."""
    out, at = [], 0
    for a, b in sorted(spans_):
        if b <= at:
            continue
        out.append(text[at: max(a, at)])
        at = b
        if (a == 0 or text[a - 1] == "\n") and text[b: b + 1] == "\n":
            at = b + 1
    out.append(text[at:])
    return "".join(out)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with every repeated unit cut out of text; documents of which nothing is left go. Columns unchanged.

    The spans of a text are at most its own units, so they fit wherever the text does.
    """
    found = repeated(docs, min_words)
    removed = stage(found.groupBy(F.col("doc_id").alias("id"), "row_hash").agg(F.collect_set(F.struct("begin", "end")).alias("cuts")))
    release(found)
    schema = docs.schema
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("at"), F.xxhash64("text").alias("hash"))
    joined = packed.join(removed, F.col("at").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("row_hash")), "left").select("row", "cuts")

    def run(batches):
        for batch in batches:
            rows = pa.RecordBatch.from_struct_array(batch.column("row"))
            at = rows.schema.get_field_index("text")
            spans_ = batch.column("cuts").to_pylist()
            texts = [t if not c else cut_out(t, [(x["begin"], x["end"]) for x in c]) for t, c in zip(rows.column(at).to_pylist(), spans_)]
            rows = rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))
            yield rows.filter(pa.array([not c or bool(t.strip()) for t, c in zip(texts, spans_)], pa.bool_()))
    # rows without cuts pass through as they are
    return joined.mapInArrow(run, schema)
