"""Language-model scores of whole documents.

1. One pass over the texts cuts each partition into blocks of some MB. A block sends its distinct words with their training counts to
   the shards of words and keeps its texts as word numbers, from which it sends its distinct pairs of neighbouring words (64-bit
   keys) with theirs to the shards of pairs. So a word or pair that stands in every document costs one row entry per block, whatever its share.
2. Each shard counts its words over all training documents and gives the byte n-grams of its distinct words; a partial aggregate
   sums them. Each word counts once there, since the n-grams stand in for words whose own counts are small. Every n-gram is kept:
   those of three bytes and more are dealt by the last two bytes of their context, which all shorter contexts of the same event
   share, so each range is smoothed on its own, and a shard is joined to the windows that its words have. Only the n-grams of one
   and two bytes (65 792 at most) are held everywhere.
3. Each shard of pairs counts its pairs over all training documents. Blocks get back the counts of their words and pairs and the
   spelling scores of their words, and score their documents event by event.

The model: P(w | v) = (c(v, w) + CONTEXT_MASS P(w)) / (c(v) + CONTEXT_MASS), counts over all training events; an event is a word or the
end, and the context of a first word is the boundary (a hierarchical Dirichlet model, so all pairs count, and probabilities of
a context sum to one). P(w): a token is the end with probability (training documents + 0.5) / (training tokens + 1), else a
word. A training word has its discounted relative frequency plus its share, by the byte n-gram model, of what the discount frees; the
share of all other spellings is the probability of the class of unknown words, which base_score also has.

Defined cases: null or empty text has the end token alone; repeated rows are separate documents; without training documents
every word is unknown, which is certain; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorframe.llm import spans, trie
from factorframe.llm.shared import id_crc, release, stage

ORDER = 6
BLOCK_BYTES = 6 << 20
BLOCK_DOCS = 50_000
WORD_DOCS, PAIR_DOCS = 65_536, 8192  # documents a shard
WORDS_AT_ONCE = 40_000
RANGE_GRAMS = 1 << 18
CONTEXT_MASS = 200.0  # weight of the single-word model, in counts
TOTAL, KINDS, ONCE, TWICE = 0, 1 << 8, 2 << 8, 3 << 8  # keys of the sums that travel with the n-grams

SENT = ("block long, shard int, words binary, counts binary, keys binary, stream binary, ids array<long>, "
        "held array<boolean>, tokens array<long>")


def packed(raw: bytes) -> bytes:
    """Compressed, behind its length; pages of a shuffle only get a fast code without entropy coding."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def unpacked(raw: bytes) -> bytes:
    return pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def planes(x: np.ndarray, size: int = 4) -> bytes:
    """Numbers of size bytes by byte plane, which packs well."""
    return packed(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes())


def unplanes(raw: bytes, size: int = 4) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(unpacked(raw), np.uint8).reshape(size, -1).T).view(f"<u{size}").reshape(-1)
    return x.astype(np.int64 if size == 4 else np.uint64)


def rising(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers by their steps."""
    return planes(np.diff(x, prepend=np.uint64(0)), 8)


def unrising(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, 8), dtype=np.uint64)


def by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by shard then key, the place of each key in it, and where each shard begins."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((keys, shard))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return order, place, np.searchsorted(shard[order], np.arange(shards + 1))


def events_of(stream: np.ndarray, tokens: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """All events of the documents and their contexts as word numbers; the boundary is number `kinds`."""
    event = np.full(int(tokens.sum()), kinds, np.int64)
    word = np.ones(len(event), bool)
    word[np.cumsum(tokens) - 1] = False
    event[word] = stream
    return event, np.concatenate([np.array([kinds], np.int64), event[:-1]])


def pairs_of(event: np.ndarray, context: np.ndarray, keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the distinct pairs by shard, the pair of each event, and where each shard begins."""
    code = context * (len(keys) + 1) + event
    code, back = np.unique(code, return_inverse=True)
    of = np.append(keys, np.uint64(0xD1B54A32D192ED03))
    with np.errstate(over="ignore"):
        pair = spans.mix64(spans.mix64(of[code // len(of)] + np.uint64(0x9E3779B97F4A7C15)) + of[code % len(of)])
    order, place, edges = by_shard(pair, shards)
    return pair[order], place[back.reshape(-1)], edges


def joined(w: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Words one after the other, a space behind each."""
    size = end - start + 1
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    out[keep] = w[(np.repeat(start - (ends - size), size) + np.arange(len(out)))[keep]]
    return packed(out.tobytes())


def parted(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    end = np.flatnonzero(data == 32)
    return data, np.concatenate([[0], end[:-1] + 1]) if len(end) else end, end


def scattered(docs: DataFrame, shards: int) -> DataFrame:
    def block_rows(block: int, batch: pa.RecordBatch):
        data, start, end, keys, doc, at, seen = [], [], [], [], [], 0, 0
        for piece in spans.slices(batch):
            w = spans.words(piece.column("text"))
            data.append(w.data)
            start.append((w.start + at).astype(np.int32 if at < 1 << 30 else np.int64))
            end.append((w.end + at).astype(start[-1].dtype))
            keys.append(w.hash)
            doc.append((w.doc + seen).astype(np.int32))
            at, seen = at + len(w.data), seen + piece.num_rows
        data, start, end, keys, doc = map(np.concatenate, (data, start, end, keys, doc))
        held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        back = back.reshape(-1)
        del keys
        counts = np.bincount(back, weights=~held[doc], minlength=len(distinct))
        tokens = np.bincount(doc, minlength=seen) + 1
        del doc
        order, _, cuts = by_shard(distinct, shards)
        often = np.argsort(-np.bincount(back, minlength=len(distinct)), kind="stable")
        rank = np.empty(len(often), np.int64)
        rank[often] = np.arange(len(often))
        rows = [(block, -1, None, None, planes(distinct[often], 8), planes(rank[back]), batch.column("doc_id").to_pylist(), held.tolist(),
                 tokens.tolist())]
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[s]: cuts[s + 1]]
            rows.append((block, s, joined(data, start[first[mine]], end[first[mine]]), planes(counts[mine]), *(None,) * 5))
        kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
        names = [x.split()[0] for x in SENT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        from pyspark import TaskContext

        part, n, waiting, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            table = pa.Table.from_batches(waiting).combine_chunks().to_batches()
            return block_rows((part << 32) + n, table[0])
        for batch in batches:
            for piece in spans.slices(batch):
                waiting.append(piece)
                size += piece.column("text").nbytes
                if size >= BLOCK_BYTES or sum(p.num_rows for p in waiting) >= BLOCK_DOCS:
                    yield flush()
                    n, waiting, size = n + 1, [], 0
        if waiting:
            yield flush()
    held = (id_crc() % 5 == 1).alias("held")
    return docs.select(F.col("doc_id").cast("long"), "text", held).mapInArrow(run, SENT)


def words_of(table: pa.Table):
    """All words of the rows, their hashes' distinct words, and the training count of each distinct word."""
    data, start, end = parted(b"".join(map(unpacked, table.column("words").to_pylist())))
    counts = np.concatenate([unplanes(x) for x in table.column("counts").to_pylist()])
    keys = np.empty(len(start), np.uint64)
    for a in range(0, len(start), 1 << 17):
        s, e = start[a: a + (1 << 17)], end[a: a + (1 << 17)]
        keys[a: a + (1 << 17)] = spans.run_hashes(spans.BYTE_VALUE[data[s[0]: e[-1]]], s - s[0], e - s[0])
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    back = back.reshape(-1)
    return data, start[first], end[first], back, np.bincount(back, weights=counts, minlength=len(first)).astype(np.int64)


def gram_counts(sent: DataFrame, order: int) -> DataFrame:
    """shard, gram, n over the training words of each shard; TOTAL, KINDS, ONCE and TWICE hold their number and how many are distinct, seen once, twice."""
    def run(table: pa.Table) -> pa.Table:
        data, start, end, _, count = words_of(table)
        known = count > 0
        start, end = start[known], end[known]
        some = [trie.ngrams(data, start[a: a + WORDS_AT_ONCE], end[a: a + WORDS_AT_ONCE], np.ones(len(start[a: a + WORDS_AT_ONCE])), order)
                for a in range(0, len(start), WORDS_AT_ONCE)]
        keys, back = np.unique(np.concatenate([k for k, _ in some] or [np.zeros(0, np.uint64)]), return_inverse=True)
        sums = np.bincount(back.reshape(-1), weights=np.concatenate([n for _, n in some] or [np.zeros(0)]), minlength=len(keys)).astype(np.int64)
        keys = np.concatenate([keys, np.array([TOTAL, KINDS, ONCE, TWICE], np.uint64)])
        extra = [count.sum(), known.sum(), (count == 1).sum(), (count == 2).sum()]
        shard = np.full(len(keys), table.column("shard")[0].as_py(), np.int32)
        return pa.table({"shard": shard, "gram": keys.view(np.int64), "n": np.concatenate([sums, extra])})
    return (sent.where("words IS NOT NULL").select("shard", "words", "counts").groupBy("shard")
            .applyInArrow(run, "shard int, gram long, n long"))


def window_scores(grams: DataFrame, pairs: np.ndarray, order: int, parts: int) -> DataFrame:
    """gram, value: the log10 probability of the last byte of every n-gram of three bytes and more that is a whole window."""
    def run(table: pa.Table) -> pa.Table:
        keys, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
        upper, out = (None, pairs), []
        for k in range(3, order + 1):
            mine = (keys & np.uint64(7)) == k
            g, p = trie.smoothed(keys[mine] & ~np.uint64(255), n[mine], k, *upper)
            whole = np.ones(len(g), bool) if k == order else g >> np.uint64(56) == trie.MARK
            out.append(((g | np.uint64(k))[whole], np.log10(p[whole])))
            upper = g, p
        return pa.table({"gram": np.concatenate([g for g, _ in out]).view(np.int64), "value": np.concatenate([p for _, p in out])})
    context = F.expr("shiftrightunsigned(gram, cast(72 - 8 * (gram & 7) as int)) & 65535")
    return (grams.where("(gram & 7) > 2").withColumn("range", F.pmod(F.hash(context), F.lit(parts)))
            .groupBy("range").applyInArrow(run, "gram long, value double"))


def spellings(data: np.ndarray, start: np.ndarray, end: np.ndarray, order: int, tables, grams: np.ndarray, values: np.ndarray) -> np.ndarray:
    """log10 probability of each word, closing mark included; grams are sorted and hold all windows of the words."""
    keys, word = trie.windows(data, start, end, order)
    length = (keys & np.uint64(7)).astype(int)
    result = np.zeros(len(keys))
    for k in (1, 2):
        result[length == k] = np.log10(tables[k - 1][(keys[length == k] >> np.uint64(64 - 8 * k)).astype(int)])
    long = length > 2
    result[long] = values[np.searchsorted(grams, keys[long])]
    return np.bincount(word, result, len(start))


def word_values(sent: DataFrame, windows: DataFrame, tables, order: int, total: int, kinds: int, discount: float) -> DataFrame:
    """Per block and shard the training counts of its words and their log10 probabilities among words (0 where unknown).

    A row without block holds the spelling mass of the shard's training words.
    """
    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        data, start, end, back, count = words_of(table)
        grams, values = known.column("gram").to_numpy().view(np.uint64), known.column("value").to_numpy()
        by = np.argsort(grams)
        grams, values = grams[by], values[by]
        spelled, mine = np.zeros(len(start)), np.flatnonzero(count > 0)
        for a in range(0, len(mine), WORDS_AT_ONCE):
            some = mine[a: a + WORDS_AT_ONCE]
            spelled[some] = spellings(data, start[some], end[some], order, tables, grams, values)
        score = np.zeros(len(start))
        if total:  # what the discount takes from the counts is shared by spelling; in logarithms, as long words underflow
            share = np.maximum(spelled + np.log10(discount * kinds / total), -300.0)
            score = np.where(count > 0, np.log10(np.maximum(count - discount, 0) / total + 10.0 ** share), 0.0)
        shard, at = table.column("shard")[0].as_py(), 0
        out = [(None, shard, None, None, float((10.0 ** spelled[count > 0]).sum()))]
        for block, counts in zip(table.column("block").to_pylist(), table.column("counts").to_pylist()):
            word = back[at: at + len(unplanes(counts))]
            at += len(word)
            out.append((block, shard, planes(count[word], 8), planes(score[word].astype("<f4").view("<u4")), 0.0))
        return table_of(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.float64()), ("block", "shard", "word_counts", "scores", "mass"))
    rows = sent.where("words IS NOT NULL").select("shard", "block", "words", "counts")
    return rows.groupBy("shard").cogroup(windows.groupBy("shard")).applyInArrow(
        run, "block long, shard int, word_counts binary, scores binary, mass double")


def table_of(rows: list[tuple], kinds, names) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def sent_pairs(sent: DataFrame, shards: int, pair_shards: int) -> DataFrame:
    """Per block and shard the keys and training counts of its distinct word pairs, from the texts as word numbers."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys, tokens = unplanes(r["keys"], 8), np.array(r["tokens"], np.int64)
                order, place, _ = by_shard(keys, shards)
                pair, which, edges = pairs_of(*events_of(place[unplanes(r["stream"])], tokens, len(keys)), keys[order], pair_shards)
                counts = np.bincount(which, weights=np.repeat(~np.array(r["held"], bool), tokens), minlength=len(pair))
                out = [(r["block"], s, rising(pair[edges[s]: edges[s + 1]]), planes(counts[edges[s]: edges[s + 1]]))
                       for s in np.flatnonzero(np.diff(edges)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                                                 names=["block", "shard", "pairs", "counts"])
    return sent.where("shard < 0").select("block", "keys", "stream", "held", "tokens").mapInArrow(
        run, "block long, shard int, pairs binary, counts binary")


def pair_values(pairs: DataFrame) -> DataFrame:
    """Per block and shard the counts of its word pairs over all training documents."""
    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unrising(x) for x in table.column("pairs").to_pylist()])
        found, back = np.unique(keys, return_inverse=True)
        back = back.reshape(-1)
        count = np.bincount(back, np.concatenate([unplanes(x) for x in table.column("counts").to_pylist()]), len(found)).astype(np.int64)
        out, at = [], 0
        for block, counts in zip(table.column("block").to_pylist(), table.column("counts").to_pylist()):
            pair = back[at: at + len(unplanes(counts))]
            at += len(pair)
            out.append((block, table.column("shard")[0].as_py(), planes(count[pair], 8)))
        return table_of(out, (pa.int64(), pa.int32(), pa.binary()), ("block", "shard", "pair_counts"))
    return pairs.groupBy("shard").applyInArrow(run, "block long, shard int, pair_counts binary")


def document_scores(sent: DataFrame, words: DataFrame, pairs: DataFrame, shards: int, pair_shards: int, unknown: float, stop: float, train_docs: int) -> DataFrame:
    """doc_id, held_out, n_tokens, known words, the sum of log10(count + 0.5) over words, and the score."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["shard", "keys", "stream", "ids", "held", "tokens", "word_counts", "scores", "pair_counts"]).to_pylist(),
                      key=lambda r: r["shard"])
        head = rows[0]
        keys, tokens = unplanes(head["keys"], 8), np.array(head["tokens"], np.int64)
        order, place, _ = by_shard(keys, shards)
        ones = np.concatenate([unplanes(r["word_counts"], 8) for r in rows if r["word_counts"] is not None] or [np.zeros(0)]).astype(float)
        single = np.concatenate([unplanes(r["scores"]).astype("<u4").view("<f4") for r in rows if r["scores"] is not None] or [np.zeros(0)]).astype(float)
        twos = np.concatenate([unplanes(r["pair_counts"], 8) for r in rows if r["pair_counts"] is not None]).astype(float)
        go_on = np.log10(1 - stop) if stop < 1 else 0.0
        single = np.append(np.where(ones > 0, single, np.log10(unknown)) + go_on, np.log10(stop))
        event, context = events_of(place[unplanes(head["stream"])], tokens, len(keys))
        _, which, _ = pairs_of(event, context, keys[order], pair_shards)
        value = np.log10((twos[which] + CONTEXT_MASS * 10.0 ** single[event]) / (np.append(ones, train_docs)[context] + CONTEXT_MASS))
        doc, n = np.repeat(np.arange(len(tokens)), tokens), len(tokens)
        return pa.table({"doc_id": pa.array(head["ids"], pa.int64()), "held_out": pa.array(head["held"]), "n_tokens": pa.array(tokens),
                         "known": np.bincount(doc, np.append(ones > 0, False)[event], n).astype(np.int64),
                         "base": np.bincount(doc, np.append(np.log10(ones + 0.5), 0.0)[event], n), "score": np.bincount(doc, value, n)})
    heads = sent.where("shard < 0").select("block", "shard", "keys", "stream", "ids", "held", "tokens")
    return (heads.unionByName(words, allowMissingColumns=True).unionByName(pairs, allowMissingColumns=True).groupBy("block")
            .applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, base double, score double"))


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.count()
    shards, pair_shards = max(8, -(-rows // WORD_DOCS)), max(8, -(-rows // PAIR_DOCS))
    sent = stage(scattered(docs, shards))
    spelled_in = stage(gram_counts(sent, order))
    grams = stage(spelled_in.groupBy("gram").agg(F.sum("n").alias("n")))
    marks = F.col("gram").isin(TOTAL, KINDS, ONCE, TWICE)
    total, kinds, once, twice = map({r["gram"]: r["n"] for r in grams.where(marks).collect()}.get, (TOTAL, KINDS, ONCE, TWICE), (0,) * 4)
    short = grams.where(~marks & F.expr("(gram & 7) < 3")).toArrow()
    tables = trie.short_tables(short.column("gram").to_numpy().view(np.uint64), short.column("n").to_numpy())
    scored = window_scores(grams.where(~marks), tables[1], order, max(8, -(-grams.count() // RANGE_GRAMS)))
    windows = spelled_in.where(~marks).select("shard", "gram").join(scored, "gram")
    train_docs = sent.where("shard < 0").agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    n, v = total + train_docs, kinds + (train_docs > 0)
    discount = (once + 0.5) / (once + 2 * twice + 1)  # the usual estimate from counts of counts, kept inside (0, 1)
    stop = (train_docs + 0.5) / (n + 1)
    words = stage(word_values(sent, windows, tables, order, total, kinds, discount))
    release(spelled_in, grams)
    spelled = words.where("block IS NULL").agg(F.sum("mass")).first()[0] or 0.0
    # the class of unknown words: all spellings that no training word uses
    unknown = discount * kinds / total * max(1 - spelled, 1e-9) if total else 1.0
    return document_scores(sent, words.where("block IS NOT NULL").drop("mass"), pair_values(sent_pairs(sent, shards, pair_shards)), shards, pair_shards, unknown, stop, train_docs).select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + int(train_docs > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(train_docs + 0.5)) - F.col("n_tokens") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"), "score")
