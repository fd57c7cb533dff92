"""Spelling variants: words at edit distance one, by pairs of trie nodes.

1. One pass over the texts counts words; a task sends its distinct words with counts.
2. The words, sorted by ranges, are walked once in order: neighbours share the trie nodes of their common prefix, and every further
   letter opens a new node with the next number. So node numbers need no lookup. Only where a range begins may its first nodes belong to the
   range before; these are renumbered from one row per range. The reversed words, walked alike, number the suffixes.
3. A word with a letter skipped at place i is the integer pair (node of the prefix before i, node of the suffix after i); a word with a gap
   at place i, where another has a letter more, is the pair of the prefix and the suffix that meet there. Equal pairs are exact
   neighbours: skip with skip differ by one letter replaced, skip with gap by one inserted or deleted. A letter skipped in a run of the
   same letter is paired with gaps only at the run's first place, so that every neighbour is met exactly once.
4. All words of one pair differ in one place, so a pair holds at most one word per letter of the alphabet, and one gap.
5. A word's form is its most frequent neighbour if that is at least twice as frequent; counts at least double along a chain of forms,
   so chains are short and jumping to the form of the form ends after few rounds.

Defined cases: null text has no words; a null doc_id reads as the empty text in the hash; repeated rows count each; very long texts and words
are whole; ties of count go to the smallest word; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorframe.llm import spans
from factorframe.llm.shared import release, stage

LETTERS, TIMES, RATIO = 5, 3, 2
ONE_IN = 97  # runs of this share of hashes lose a letter
FLUSH_BYTES = 32 << 20
SLICE_BYTES = 2 << 20
LONG = 64  # bytes; longer runs are hashed one by one

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_step = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _step = np.where(_step & 1, np.uint32(0xEDB88320) ^ (_step >> 1), _step >> 1).astype(np.uint32)


def shifted(crcs: np.ndarray, lengths: int) -> np.ndarray:
    """crcs[i] moved over 0..lengths following bytes: crc32(a + b) is shifted(crc32(a))[len(b)] ^ crc32(b)."""
    out = np.empty((len(crcs), lengths + 1), np.uint32)
    out[:, 0] = crcs
    for n in range(1, lengths + 1):
        before = out[:, n - 1]
        out[:, n] = _step[before & np.uint32(255)] ^ (before >> np.uint32(8))
    return out


def counted_words(texts: pa.Array, ids: list, letters: int = LETTERS) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of `letters` code points and more, and their counts; a run whose hash ONE_IN divides loses one letter."""
    data, offsets = spans.text_bytes(texts)
    lowered = spans.LOWER[data]
    # U+00C0 to U+00FF are the two-byte characters that begin with C3
    inside = _LETTER[data] | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3
    start, end, text = spans.runs(inside, offsets)
    size = (np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80]), dtype=np.int64))
    points = size[end] - size[start]
    coded = spans.strings(lowered, inside, start, end).filter(pa.array(points >= letters)).dictionary_encode()
    keep = points >= letters
    text, points, wide = text[keep], points[keep], (end - start)[keep]
    codes, words = coded.indices.to_numpy(), coded.dictionary
    raw = [w.encode() for w in words.to_pylist()]
    own = np.array([crc32(w) for w in raw], np.uint32)
    heads = [f"{'' if i is None else i}:".encode() for i in ids]
    moved = shifted(np.array([crc32(h) for h in heads], np.uint32), LONG)
    h = moved[text, np.minimum(wide, LONG)] ^ own[codes] if len(codes) else np.zeros(0, np.uint32)
    for i in np.flatnonzero(wide > LONG):
        h[i] = crc32(heads[text[i]] + raw[codes[i]])
    hit = h % np.uint32(ONE_IN) == 0
    changed = {}
    for i in np.flatnonzero(hit):
        if points[i] > letters:
            w, k = raw[codes[i]].decode(), int(h[i]) % int(points[i])
            w = w[:k] + w[k + 1:]
            changed[w] = changed.get(w, 0) + 1
    n = np.bincount(codes[~hit], minlength=len(words))
    return (pa.concat_arrays([words, pa.array(list(changed), pa.large_string())]),
            np.concatenate([n, np.fromiter(changed.values(), np.int64, len(changed))]))


def word_counts(docs: DataFrame, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """word, n."""
    def summed(held):
        table = pa.table({"word": pa.concat_arrays([w for w, _ in held]), "n": np.concatenate([n for _, n in held])})
        table = table.filter(pc.field("n") > 0).group_by("word").aggregate([("n", "sum")])
        for batch in table.select(["word", "n_sum"]).to_batches(100_000):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1)], names=["word", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in spans.slices(batch, limit=SLICE_BYTES):
                words, n = counted_words(part.column("text"), part.column("doc_id").to_pylist(), letters)
                held.append((words, n))
                size += words.nbytes + n.nbytes
                if size > FLUSH_BYTES:
                    yield from summed(held)
                    held, size = [], 0
        if held:
            yield from summed(held)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= times)


PART_BITS = 40


class Renumbered:
    """The first nodes of each range of words that belong to earlier ranges: a list by range, its i-th entry for the i-th node made."""

    def __init__(self):
        self.lists: dict[int, list[int]] = {}

    def add(self, part: int, nodes: list[int]) -> None:
        self.lists[part] = nodes

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.zeros(max(self.lists, default=0) + 1, np.int64)
        for part, nodes in self.lists.items():
            size[part] = len(nodes)
        flat = [x for part in sorted(self.lists) for x in self.lists[part]]
        return size, np.cumsum(size) - size, np.array([*flat, 0], np.int64)


def settled(nodes: np.ndarray, packed: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Node numbers with those of Renumbered replaced."""
    size, first, flat = packed
    part, local = nodes >> PART_BITS, nodes & ((1 << PART_BITS) - 1)
    shared = local < size[part]
    return np.where(shared, flat[np.where(shared, first[part] + local, 0)], nodes)


def numbered(words: DataFrame, carry: list[str], spelled: str, backward: bool) -> tuple[DataFrame, tuple]:
    """carry..., spelled, place, nodes for the words in the order of `spelled`; and the nodes to renumber.

    nodes[i] is the trie node of the first i letters (backward: of what follows the first i letters of the word itself); the root is 0.
    A node's number is its range's and, in the low bits, a count within it; place numbers the words alike.
    """
    def run(batches):
        base, made, at, before, nodes = TaskContext.get().partitionId() << PART_BITS, 0, 0, "", [0]
        for batch in batches:
            lists = []
            for w in batch.column(spelled).to_pylist():
                k, most = 0, min(len(w), len(before))
                while k < most and w[k] == before[k]:
                    k += 1
                new = len(w) - k
                nodes = nodes[: k + 1] + list(range(base + made + 1, base + made + new + 1))
                made += new
                before = w
                lists.append(nodes[::-1] if backward else nodes)
            place = np.arange(at, at + batch.num_rows) + base
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(lists, pa.list_(pa.int64()))],
                                             names=[*batch.schema.names, "place", "nodes"])

    rows = words.repartitionByRange(spelled).sortWithinPartitions(spelled).select(*carry, spelled)
    out = stage(rows.mapInArrow(run, f"{', '.join(f'{c} long' for c in carry)}, {spelled} string, place long, nodes array<long>"))
    # one row per range
    edges = out.groupBy(F.shiftright("place", PART_BITS).alias("part")).agg(
        F.min(spelled).alias("first"), F.max(F.struct("place", spelled, "nodes")).alias("last")).orderBy("part").collect()
    known, word, spine = Renumbered(), "", [0]
    for e in edges:
        k = 0
        while k < min(len(word), len(e["first"])) and word[k] == e["first"][k]:
            k += 1
        known.add(e["part"], spine[: k + 1])
        word, nodes = e["last"][spelled], e["last"]["nodes"]
        spine = settled(np.array(nodes[::-1] if backward else nodes), known.packed()).tolist()
    return out, known.packed()


def pairs(placed: DataFrame, ahead: tuple, behind: tuple) -> DataFrame:
    """p, s, id, n, kind: 0 a gap, 1 a skipped letter at the first place of its run, 2 a skipped letter elsewhere."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix, suffix = batch.column("prefix"), batch.column("suffix")
            sizes = np.diff(prefix.offsets.to_numpy())
            p, s = settled(prefix.flatten().to_numpy(), ahead), settled(suffix.flatten().to_numpy(), behind)
            which = np.repeat(np.arange(batch.num_rows), sizes)
            ends = np.cumsum(sizes)
            last, first = np.zeros(len(p), bool), np.zeros(len(p), bool)
            last[ends - 1] = first[ends - sizes] = True
            letters = np.frombuffer("".join(batch.column("word").to_pylist()).encode("utf-32-le"), np.uint32)
            owner = which[~last]
            repeated = np.zeros(len(letters), np.int8)
            repeated[1:] = (letters[1:] == letters[:-1]) & (owner[1:] == owner[:-1])
            row = np.concatenate([which, owner])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([p, p[~last]])), pa.array(np.concatenate([s, s[~first]])),
                batch.column("id").take(pa.array(row)), batch.column("n").take(pa.array(row)),
                pa.array(np.concatenate([np.zeros(len(p), np.int8), 1 + repeated]))], names=["p", "s", "id", "n", "kind"])
    return placed.mapInArrow(run, "p long, s long, id long, n long, kind byte")


def neighbours(met: DataFrame) -> DataFrame:
    """id, n_near, best (struct of n and minus the id): each word with the number of its near words and the best of them."""
    group = Window.partitionBy("p", "s")
    alive = met.withColumn("size", F.count(F.lit(1)).over(group)).where("size > 1")
    members = alive.groupBy("p", "s").agg(F.collect_list(F.struct("kind", "n", F.col("id").alias("id"))).alias("m"))  # a letter each
    near = """transform(m, u -> struct(u.id AS id, transform(filter(m, v -> v.id <> u.id AND
      ((u.kind > 0 AND v.kind > 0) OR (u.kind = 0 AND v.kind = 1) OR (u.kind = 1 AND v.kind = 0))), v -> struct(v.n AS n, -v.id AS id)) AS o))"""
    each = members.select(F.inline(F.expr(near))).where(F.size("o") > 0)
    return each.groupBy("id").agg(F.sum(F.size("o")).cast("long").alias("n_near"), F.max(F.array_max("o")).alias("best"))


def variants(docs: DataFrame, letters: int = LETTERS, times: int = TIMES, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    counts = stage(word_counts(docs, letters, times))
    forward, ahead = numbered(counts, ["n"], "word", False)
    backward, behind = numbered(forward.select(F.col("place").alias("id"), F.reverse("word").alias("drow")), ["id"], "drow", True)
    placed = forward.select(F.col("place").alias("id"), "word", "n", F.col("nodes").alias("prefix")).join(
        backward.select("id", F.col("nodes").alias("suffix")), "id")
    near = stage(neighbours(pairs(placed, ahead, behind)))
    words = forward.select(F.col("place").alias("id"), "word", "n")
    known = stage(words.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.id")).alias("to")))
    release(counts, backward, near)
    jumps = known.where("to IS NOT NULL").select("id", "to")
    while True:  # the way doubles each round and counts double each step, so at most six rounds
        further = stage(jumps.join(jumps.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left").select(
            "id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        jumps = further.select("id", "to")
        if not further.where("moved").limit(1).count():
            break
    spelled = known.select("id", "word", "n")
    forms = spelled.select(F.col("id").alias("to"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    roots = jumps.join(spelled.select(F.col("id").alias("to"), F.col("word").alias("root")), "to").select("id", "root")
    return known.join(forms, "to", "left").join(roots, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# The hash is the table-driven crc32 of 0xEDB88320; near words meet in a string with one letter left out or open.
SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x::BIGINT, 1, 1, 1, 1, 1, 1, 1, 1],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
bytes AS (SELECT w, n, hex(encode(d || ':' || w)) AS x FROM runs WHERE length(w) >= 5),
hashed AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, steps),
words AS (
  SELECT w, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM hashed)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
skips AS (SELECT w, n, i, left(w, i) AS p, substr(w, i + 2) AS s FROM (SELECT w, n, unnest(range(length(w))) AS i FROM words)),
near AS (
  SELECT a.w AS u, b.w AS v, b.n AS n FROM skips a JOIN skips b ON a.p = b.p AND a.s = b.s AND a.w <> b.w
  UNION SELECT a.w, b.w, b.n FROM skips a JOIN words b ON a.p || a.s = b.w
  UNION SELECT b.w, a.w, a.n FROM skips a JOIN words b ON a.p || a.s = b.w),
best AS (SELECT u, count(*) AS n_near, first(v ORDER BY n DESC, v) AS v, max(n) AS m FROM near GROUP BY u),
forms AS (
  SELECT w.w AS word, CASE WHEN b.m >= 2 * w.n THEN b.v END AS form, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
    CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n FROM words w LEFT JOIN best b ON b.u = w.w),
chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word
"""
