"""Collocations by sorted count streams: phrases of two and three words scored by how far they exceed their parts.

1. One pass over the texts cuts each task's documents into blocks of some MB per language. A block is staged as its distinct words
   with their counts and its texts as numbers of those words, so later steps read no text.
2. Words are counted per language. Only words with `least` occurrences can stand in a candidate; they are numbered where they are
   counted, and all orders below go by these numbers.
3. Blocks get the numbers of their words back and send their distinct phrases of such words with counts; a sum gives each phrase's
   count. Phrases below `least` are no candidates and no parts of one, since a part is at least as frequent as the whole.
4. Words, pairs and triples are laid out as one stream twice, in prefix order (first word first, a part just before its
   extensions) and in suffix order (last word first). One walk over each, in lockstep over the three lengths, gives every phrase
   the counts of its first parts (prefix order) or last parts (suffix order) and every pair its most frequent extension. The streams
   are cut by ranges whatever the words are, so a word or pair with very many extensions spans several tasks: rows before the
   first part of their task take its count from the end of the task before, one row per task.

Defined cases: null text has no words; null lang is `und`, together with rows that say so; repeated rows count each; a row's doc_id is
not used; very long texts are a block of their own; ties of score go by count, then by the phrase's bytes; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorframe.llm import spans
from factorframe.llm.shared import stage

LEAST, HALF, TOP = 10, 50, 2000
BLOCK_BYTES = 5 << 20
SALTS = 64
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_INSIDE = ~_BREAK
_INSIDE[[0x20, 0x09]] = False


def worded(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts in order, and whether a word continues the piece of the word before."""
    data, offsets = spans.text_bytes(texts)
    data = spans.LOWER[data]
    inside = _INSIDE[data]
    start, end, text = spans.runs(inside, offsets)
    breaks = np.cumsum(_BREAK[data], dtype=np.int64)
    goes_on = np.zeros(len(start), bool)
    goes_on[1:] = (text[1:] == text[:-1]) & (breaks[start[1:]] == breaks[end[:-1] - 1])
    return spans.strings(data, inside, start, end), goes_on


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, lang, words (distinct), counts, tokens (int32: twice the word's number, plus 1 where it continues a piece)."""
    def closed(number: int, held: dict):
        for lang, parts in held.items():
            coded = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
            index, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.string())
            tokens = index.astype(np.int32) * 2 + np.concatenate([g for _, g in parts])
            ends = pa.array([0, len(words)], pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.ListArray.from_arrays(ends, words),
                pa.ListArray.from_arrays(ends, pa.array(np.bincount(index, minlength=len(words)), pa.int64())),
                pa.array([tokens.astype("<i4").tobytes()], pa.binary())], names=["block", "lang", "words", "counts", "tokens"])
            number += 1

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for part in spans.slices(batch):
                langs = part.column("lang")
                for lang in langs.unique().to_pylist():
                    texts = part.filter(pc.equal(langs, lang)).column("text")
                    words, goes_on = worded(texts)
                    if len(words):
                        held.setdefault(lang, []).append((words, goes_on))
                        size += texts.nbytes
                if size >= block_bytes:
                    yield from closed(number, held)
                    number, held, size = number + len(held), {}, 0
        yield from closed(number, held)

    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return slim.mapInArrow(run, "block long, lang string, words array<string>, counts array<long>, tokens binary")


def numbered_words(cut: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, lang, word, f) of the words with least occurrences; (block, known: places of such words in the block, and their ids).

    The words of all blocks are dealt once, by (lang, word). There each word gets its count, and the number of its first row as its id.
    """
    each = cut.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select(
        "lang", F.col("w.words").alias("word"), "block", "place", F.col("w.counts").alias("n"))
    same = Window.partitionBy("lang", "word")
    # number of a row in its task, then of the task: small numbers, which pack well in later shuffles
    tasks, row = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.monotonically_increasing_id()
    number = row.bitwiseAND(F.lit((1 << 33) - 1)) * max(tasks, 4096) + F.shiftright(row, 33) + 1
    met = each.repartition(tasks, "lang", "word").withColumn("at", number).select(
        "lang", "word", "block", "place", "at", F.min("at").over(same).alias("id"), F.sum("n").over(same).alias("f")).where(F.col("f") >= least)
    spelled = F.when(F.col("at") == F.col("id"), F.struct("lang", "word", "f"))
    placed = stage(met.select("block", "place", "id", spelled.alias("w")))
    return (placed.where("w IS NOT NULL").select("id", "w.*"),
            placed.groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("known")))


def counted(index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the value number of each element, and counts."""
    return np.unique(index, return_inverse=True, return_counts=True)


def phrases(cut: DataFrame, known: DataFrame) -> DataFrame:
    """x, y, z, n: phrases of known words within a block; z is 0 for two words."""
    def run(batches):
        for batch in batches:
            for tokens, pairs in zip(batch.column("tokens").to_pylist(), batch.column("known")):
                tokens = np.frombuffer(tokens, "<i4")
                place, number = (pairs.values.field(i).to_numpy() for i in (0, 1))
                # words that are not known have local number 0
                order = np.argsort(place)
                local = np.zeros(int(tokens.max() >> 1) + 1, np.int64)
                local[place[order]] = np.arange(1, len(place) + 1)
                ids = np.concatenate([[0], number[order]])
                w = local[tokens >> 1]
                two = np.flatnonzero((tokens[1:] & 1 == 1) & (w[1:] > 0) & (w[:-1] > 0))  # places of first words
                pair, which, n = counted(w[two] * len(ids) + w[two + 1])
                x, y = ids[pair // len(ids)], ids[pair % len(ids)]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.zeros(len(x), np.int64)), pa.array(n)], names=["x", "y", "z", "n"])
                go = np.flatnonzero(two[1:] == two[:-1] + 1)
                triple, _, n = counted(which[go] * len(ids) + w[two[go] + 2])
                head = triple // len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x[head]), pa.array(y[head]), pa.array(ids[triple % len(ids)]), pa.array(n)], names=["x", "y", "z", "n"])
    return cut.select("block", "tokens").join(known, "block").select("tokens", "known").mapInArrow(run, "x long, y long, z long, n long")


def last_before(marked: np.ndarray, values: np.ndarray, carried: int) -> np.ndarray:
    """For each row the value of the last marked row up to it, or what was carried in."""
    place = np.maximum.accumulate(np.where(marked, np.arange(len(values)), -1))
    return np.where(place >= 0, values[place], carried)


LAYOUT = "part int, side int, k1 long, k2 long, k3 long, f long, first long, second long, extension long, last1 long, last2 long"
_NAMES = [c.split()[0] for c in LAYOUT.split(", ")]


def _rows(n: int, **columns) -> pa.RecordBatch:
    kinds = [pa.int32() if c in ("part", "side") else pa.int64() for c in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(_NAMES, kinds)], names=_NAMES)


def lockstep(batches):
    """One task of a sorted stream (side, k1, k2, k3, f): words, pairs and triples walked together.

    first, second: counts of (k1) and (k1, k2), 0 where they stand in an earlier task. extension: on extra rows without f, the
    largest count among the triples of a pair in this batch. The last row holds the counts that the next task may need, 0 for none.
    """
    part, one, two = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        side, k1, k2, k3, f = (batch.column(c).to_numpy() for c in ("side", "k1", "k2", "k3", "f"))
        word = k2 == 0
        first, second = last_before(word, f, one), last_before(k3 == 0, f, two)
        one, two = int(first[-1]), int(second[-1])
        rest = ~word
        n = int(rest.sum())
        yield _rows(n, part=np.full(n, part), side=side[rest], k1=k1[rest], k2=k2[rest], k3=k3[rest], f=f[rest],
                    first=first[rest], second=np.where(k3 > 0, second, 0)[rest])
        triple = np.flatnonzero(k3 > 0)
        if len(triple):
            new = np.ones(len(triple), bool)
            new[1:] = (k1[triple[1:]] != k1[triple[:-1]]) | (k2[triple[1:]] != k2[triple[:-1]]) | (side[triple[1:]] != side[triple[:-1]])
            head = triple[new]
            n = len(head)
            yield _rows(n, part=np.full(n, part), side=side[head], k1=k1[head], k2=k2[head], k3=np.zeros(n, np.int64),
                        extension=np.maximum.reduceat(f[triple], np.flatnonzero(new)))
    yield _rows(1, part=[part], last1=[one], last2=[two])


def parts_of(grams: DataFrame, words: DataFrame) -> DataFrame:
    """x, y, z, a, lx, lxy, rz, ryz, extension: each phrase with the counts of its parts and a pair's largest extension.

    rz is the count of the last word, ryz of the last two.
    """
    none = F.lit(0).cast("long")
    every = grams.unionByName(words.select(F.col("id").alias("x"), none.alias("y"), none.alias("z"), "f"))
    two, three = F.col("y") > 0, F.col("z") > 0
    forward = every.select(F.lit(0).alias("side"), F.col("x").alias("k1"), F.col("y").alias("k2"), F.col("z").alias("k3"), "f")
    backward = every.select(
        F.lit(1).alias("side"), F.when(three, F.col("z")).when(two, F.col("y")).otherwise(F.col("x")).alias("k1"),
        F.when(three, F.col("y")).when(two, F.col("x")).otherwise(none).alias("k2"), F.when(three, F.col("x")).otherwise(none).alias("k3"), "f")
    key = ["side", "k1", "k2", "k3"]
    walked = stage(forward.unionByName(backward).repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(lockstep, LAYOUT))
    open_, one, two_ = [], 0, 0  # a row per task: the counts that stand before it
    for part, last1, last2 in walked.where("last1 IS NOT NULL").select("part", "last1", "last2").orderBy("part").collect():
        open_.append((part, one, two_))
        one, two_ = last1 or one, last2 or two_
    before = walked.sparkSession.createDataFrame(open_, "part int, one long, two long")
    rows = walked.where("last1 IS NULL").join(F.broadcast(before), "part").withColumns({
        "first": F.when(F.col("first") == 0, F.col("one")).otherwise(F.col("first")),
        "second": F.when((F.col("second") == 0) & (F.col("k3") > 0), F.col("two")).otherwise(F.col("second"))})
    ahead, triple = F.col("side") == 0, F.col("k3") > 0
    return rows.groupBy(
        F.when(ahead, F.col("k1")).when(triple, F.col("k3")).otherwise(F.col("k2")).alias("x"),
        F.when(ahead | triple, F.col("k2")).otherwise(F.col("k1")).alias("y"),
        F.when(ahead, F.col("k3")).when(triple, F.col("k1")).otherwise(F.col("k3")).alias("z"),
    ).agg(F.max("f").alias("a"), F.max(F.when(ahead, F.col("first"))).alias("lx"), F.max(F.when(ahead, F.col("second"))).alias("lxy"),
          F.max(F.when(~ahead, F.col("first"))).alias("rz"), F.max(F.when(~ahead, F.col("second"))).alias("ryz"), F.max("extension").alias("extension"))


def scored(parts: DataFrame, half: int = HALF) -> DataFrame:
    """x, y, z, a, l, r, score of the candidates that no longer candidate takes in; the arithmetic has 38 digits."""
    def cut(left: str, right: str) -> str:
        wide = "CAST({} AS DECIMAL(38, 0))".format
        score = f"CAST(1000000 AS DECIMAL(38, 0)) * {wide('a')} * {wide('a')} div ({wide(left)} * {wide(right)})"
        return f"struct({score} AS score, {left} AS l, {right} AS r)"

    alone = F.coalesce(100 * F.col("extension") < half * F.col("a"), F.lit(True))
    cuts = parts.where(alone | (F.col("z") > 0)).selectExpr(
        "x", "y", "z", "a", f"CASE WHEN z = 0 THEN {cut('lx', 'rz')} ELSE {cut('lx', 'ryz')} END AS c1", f"CASE WHEN z > 0 THEN {cut('lxy', 'rz')} END AS c2")
    least = F.when(F.col("c2.score") < F.col("c1.score"), F.col("c2")).otherwise(F.col("c1"))
    return cuts.select("x", "y", "z", "a", least.alias("c")).select("x", "y", "z", "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, least: int = LEAST, half: int = HALF, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    cut = stage(blocks(docs))
    totals = cut.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("n"))
    words, known = numbered_words(cut, least)
    grams = stage(phrases(cut, known).groupBy("x", "y", "z").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    spelled = words.select("id", "word")
    found = scored(parts_of(grams, words), half).join(words.select(F.col("id").alias("x"), "lang", F.col("word").alias("w1")), "x")
    # no phrase beyond the first `top` of its salted part, ties included, can be among the first of its language
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("x", "y", "z"), F.lit(SALTS))).orderBy(F.desc("score"), F.desc("a"))
    near = stage(found.withColumn("place", F.rank().over(salted)).where(F.col("place") <= top).drop("place"))
    named = near.join(spelled.select(F.col("id").alias("y"), F.col("word").alias("w2")), "y").join(
        spelled.select(F.col("id").alias("z"), F.col("word").alias("w3")), "z", "left").withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0),
one AS (SELECT lang, w[i] AS x, count(*) AS f FROM placed GROUP BY ALL),
two AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM placed WHERE i + 1 <= len(w) GROUP BY ALL),
three AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM placed WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
ahead AS (SELECT lang, x, y, max(f) AS e FROM three GROUP BY ALL),
behind AS (SELECT lang, y AS x, z AS y, max(f) AS e FROM three GROUP BY ALL),
pairs AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, p.f AS l1, q.f AS r1, NULL::BIGINT AS l2, NULL::BIGINT AS r2
  FROM two t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN one q ON q.lang = t.lang AND q.x = t.y
    LEFT JOIN ahead h ON h.lang = t.lang AND h.x = t.x AND h.y = t.y LEFT JOIN behind b ON b.lang = t.lang AND b.x = t.x AND b.y = t.y
  WHERE t.f >= 10 AND 100 * greatest(coalesce(h.e, 0), coalesce(b.e, 0)) < 50 * t.f),
triples AS (
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, p.f AS l1, yz.f AS r1, xy.f AS l2, q.f AS r2
  FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two yz ON yz.lang = t.lang AND yz.x = t.y AND yz.y = t.z
    JOIN two xy ON xy.lang = t.lang AND xy.x = t.x AND xy.y = t.y JOIN one q ON q.lang = t.lang AND q.x = t.z),
cuts AS (
  SELECT *, 1000000::HUGEINT * a * a // (l1::HUGEINT * r1) AS s1, 1000000::HUGEINT * a * a // (l2::HUGEINT * r2) AS s2
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM triples)),
best AS (
  SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END AS l, CASE WHEN s2 < s1 THEN r2 ELSE r1 END AS r,
    (CASE WHEN s2 < s1 THEN s2 ELSE s1 END)::BIGINT AS score FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score
FROM ranked r JOIN (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang) n ON n.lang = r.lang WHERE r.rank <= 2000
"""
