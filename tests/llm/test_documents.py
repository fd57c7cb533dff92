"""Operators on documents against brute force, with nulls, empties, ties, repeated rows and clashing columns."""

import collections
import os
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_fixtures import LOWER, WORD, corpus, documents, prose, words  # noqa: E402

from factorframe.llm import language, lines, mixing, packing, quality, scoring, sharding, similarity, spans  # noqa: E402


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def test_empty_tables(empty):
    for build in (mixing.mix_report, mixing.mix, quality.quality_report, lines.repeats, lines.without_repeats, sharding.shard,
                  similarity.components, similarity.drop_near_copies, language.language_report, language.keep_known, scoring.score, packing.pack):
        assert build(empty).count() == 0, build.__name__


def test_mix(docs, rows):
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    again = mixing.mix_report(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += len(words(text))
    # fill under caps, round by round
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= 2 * sizes[s]}
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    by_id = {r[0]: r for r in rows}
    taken = collections.Counter()
    for g in got:
        source = by_id[g.doc_id][3]
        assert g.size == len(words(by_id[g.doc_id][1]))
        assert g.source_size == sizes[source] and abs(g.target - target[source]) < 1e-6 * max(1, target[source])
        assert g.taken <= 2 * g.size and (g.size == 0 or g.taken % g.size == 0)
        taken[source] += g.taken
    largest = max(g.size for g in got)
    assert all(abs(taken[s] - target[s]) <= largest for s in sizes)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.select("text").collect()) == sum(taken.values())


def test_quality_counts(docs, rows):
    got = quality.quality_report(docs).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for d, text, _, _ in rows:
        text = text or ""
        w = [x for x in __import__("llm_fixtures").WORD.findall(text)]
        seen, dup = set(), 0
        for line in text.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        grams = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed] += 1
    assert want == collections.Counter((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) for g in got)
    assert not any(g.kept and g.base_failed for g in got)


def test_quality_separates(spark):
    good = [(i, "\n".join(f"{prose((i, j).__hash__(), 30, 5000)}." for j in range(4)), "aa", "s") for i in range(60)]
    bad = [(100 + i, " ".join(f"{w}***" for w in prose(i, 90, 5000).split()), "aa", "s") for i in range(12)]
    kept = {r.doc_id: r.kept for r in quality.quality_report(documents(spark, good + bad)).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(12))


def units_by_hand(text, least=5, reach=7):
    """(begin, end, words as a tuple) of lines, sentences and pieces, one word after the other."""
    out = []
    for line in re.finditer(r"[^\n]+", text):
        at = [(line.start() + m.start(), line.start() + m.end()) for m in WORD.finditer(line[0])]
        w = [text[a:b].translate(LOWER) for a, b in at]
        runs = [(0, len(w), line.start(), line.end())]
        begin = 0
        for i, x in enumerate(w):
            if x[-1] in ".!?" or i + 1 == len(w):
                runs.append((begin, i + 1, at[begin][0], at[i][1]))
                begin = i + 1
        hashes = spans.words(pa.array([" ".join(w)])).hash
        mark = lines.marks(hashes).tolist() if len(w) > 1 else []
        cuts = [i for i in range(reach, len(mark) - reach)
                if all(mark[i] < mark[i - d] and mark[i] <= mark[i + d] for d in range(1, reach + 1))]
        runs += [(i, j, at[i][0], at[j - 1][1]) for i, j in zip(cuts, cuts[1:])]
        seen = set()
        for i, j, a, b in runs:
            if j - i >= least and (i, j) not in seen:
                seen.add((i, j))
                out.append((a, b, tuple(w[i:j])))
    return out


def test_lines(docs, rows):
    got = collections.Counter((r.doc_id, r.begin, r.end, r.words, r.keep_doc_id, r.keep_begin) for r in lines.repeats(docs).collect())
    first, every, low = {}, [], -(1 << 63)
    for d, text, _, _ in rows:
        for a, b, w in units_by_hand(text or ""):
            every.append((d, a, b, w))
            rank = (low if d is None else d, a)
            first[w] = min(first.get(w, (rank, d)), (rank, d), key=lambda x: x[0])
    want = collections.Counter((d, a, b, len(w), first[w][1], first[w][0][1]) for d, a, b, w in every if (low if d is None else d, a) != first[w][0])
    assert got == want and want
    left = lines.without_repeats(docs)
    assert left.columns == docs.columns
    again = lines.repeats(left.where("doc_id <> 1008"))
    assert again.count() == 0


def test_repeats_go_back_to_their_own_rows(spark):
    """Rows that share an id, or have none, lose only what they repeat themselves."""
    shared = prose(80, 12, 9000)
    clean = "completely other clean text whose words nobody else has at all in this table"
    table = [(1, shared, "a", "s"), (2, f"intro words here\n{shared}\nand an end", "a", "s"), (2, clean, "a", "s"),
             (None, f"{prose(81, 9, 9000)}\n{shared}", "a", "s"), (None, clean + " too", "a", "s"), (None, f"{prose(82, 9, 9000)}\n{shared}", "b", None)]
    got = collections.Counter((r.doc_id, r.text) for r in lines.without_repeats(documents(spark, table)).collect())
    # a missing id ranks first, so of the rows without one both keep the passage: it begins at equal places
    assert got[2, clean] == 1 and got[None, clean + " too"] == 1
    assert got[2, "intro words here\nand an end"] == 1 and not any(d == 1 for d, _ in got)
    assert sum(shared in t for _, t in got) == 2


def test_own_names(spark):
    """Columns named like the inner ones of any operator pass through."""
    names = sorted({"row", "hash", "at", "id", "cuts", "told", "chosen", "found", "word", "n", "x", "u", "v", "label", "place", "copies", "first", "rank",
                    "keep_doc_id", "row_hash", "high", "low", "words", "lang_pred", "cuts_", "id_", "told_", "nth", "taken", "target", "sk", "epochs", "leaf", "rep"})
    rows = [(i, f"{prose(i % 7, 30)}.\n{prose(1, 15)}", "ab"[i % 2], "s") for i in range(12)]
    table = spark.createDataFrame([(*r, *("x" for _ in names)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in names))
    for build in (lines.without_repeats, language.keep_known, mixing.mix, similarity.drop_near_copies):
        out = build(table)
        assert out.columns == table.columns and all(r[c] == "x" for r in out.collect() for c in names), build
    for build in (lines.repeats, language.language_report, mixing.mix_report, quality.quality_report, sharding.shard, similarity.components, scoring.score, packing.pack):
        assert build(table).count() > 0, build


def test_passage_inside_lines(spark):
    passage = " ".join(f"{prose(k, 12, 9000)}." for k in range(5))
    table = documents(spark, [(1, f"{prose(50, 30)} {passage} {prose(51, 30)}", "a", "s"), (2, f"{prose(52, 30)}. {passage} {prose(53, 30)}", "a", "s"),
                              (3, prose(54, 60), "a", "s")])
    found = lines.repeats(table).collect()
    assert {r.doc_id for r in found} == {2} and {r.keep_doc_id for r in found} == {1}
    assert sum(r.words for r in found) >= 48


def test_passage_without_sentences(spark):
    """A passage that begins and ends inside sentences, without a sentence of its own."""
    passage = prose(70, 200, 9000)
    table = documents(spark, [(1, f"{prose(71, 33, 9000)} {passage} {prose(72, 21, 9000)}.", "a", "s"),
                              (2, f"{prose(73, 18, 9000)}. {prose(74, 9, 9000)} {passage} {prose(75, 40, 9000)}", "a", "s")])
    found = lines.repeats(table).collect()
    assert {(r.doc_id, r.keep_doc_id) for r in found} == {(2, 1)}
    text = {r.doc_id: r.text for r in lines.without_repeats(table).collect()}
    assert len(words(text[2])) < 67 + 70 and text[1].count(passage) == 1
    assert all(w in words(text[2]) for w in words(f"{prose(74, 9, 9000)} {prose(75, 40, 9000)}"))


def test_shard(docs, rows):
    got = sharding.shard(docs, shards=6).collect()
    assert len(got) == len(rows)
    want = collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    assert want == collections.Counter((g.doc_id, g["size"], g.text_crc32) for g in got)
    text_of = {d: t or "" for d, t, _, _ in rows}
    home = collections.defaultdict(set)
    load, slots = collections.Counter(), collections.defaultdict(list)
    for g in got:
        home[text_of[g.doc_id]].add(g.shard)
        load[g.shard] += g["size"]
        slots[g.shard].append(g.slot)
    assert all(len(s) == 1 for s in home.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = collections.Counter()
    for d, t, _, _ in rows:
        groups[t or ""] += len((t or "").encode()) + 8
    rest = [x for s, x in load.items() if s not in home[max(groups, key=groups.get)]]
    assert max(rest) - min(rest) < 0.2 * np.mean(rest)


def test_best_fit_matches_plain_search():
    r = np.random.default_rng(1)
    sizes = sorted(r.integers(1, 90, 400).tolist(), reverse=True)
    room = [1000.0] * 20
    plain = []
    for s in sizes:
        fits = [i for i in range(20) if room[i] >= s]
        i = min(fits, key=lambda i: (room[i], i)) if fits else max(range(20), key=lambda i: (room[i], i))
        room[i] -= s
        plain.append(i)
    assert sharding.best_fit_decreasing(sizes, [1000.0] * 20) == plain


def brute_components(rows, k, percent):
    sets = {}
    for d, text, _, _ in rows:
        w = words(text)
        sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids = sorted(d for d in sets if d is not None and sets[d])
    low = {d: d for d in sets}

    def root(d):
        while low[d] != d:
            d = low[d]
        return d
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("limit", [similarity.LIMIT, 60])
def test_similar(docs, rows, limit):
    want = brute_components(rows, 3, 85)
    got = similarity.components(docs, limit=limit).collect()
    assert len(got) == len(rows)
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == want
    assert all(g.kept == (g.doc_id is not None and g.doc_id == g.component_id) for g in got)


def test_near_copy_chain(spark):
    """Links that only neighbours of a chain have, within a block above the limit."""
    text = prose(5, 300, 9000).split()
    chain = [(i, " ".join([f"z{j}" if j < 3 * i else w for j, w in enumerate(text)]), "a", "s") for i in range(40)]
    want = brute_components(chain, 3, 85)
    for limit in (similarity.LIMIT, 2500):
        got = similarity.components(documents(spark, chain), limit=limit).collect()
        assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == want


def test_drop_near_copies(docs, rows):
    want = brute_components(rows, 5, 80)
    left = similarity.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {d for d, (_, c) in want.items() if d is None or c == d}


def test_language(spark):
    def text(letters, seed, n=40):
        r = np.random.default_rng(seed)
        return " ".join("".join(r.choice(list(letters), 6)) for _ in range(n))
    kinds = {"aa": "aeioubcd", "ab": "aeioubcf", "xa": "xyzwqklm", "xb": "xyzwqkvn"}
    rows = [(i, text(kinds[k], i), k, "s") for i in range(240) for k in [list(kinds)[i % 4]]]
    rows += [(900, None, "aa", "s"), (901, "123 !!", "aa", "s"), (902, "", None, None), (903, text("aeioubcd", 7, 4000), None, None)]
    table = documents(spark, rows)
    got = {r.doc_id: r for r in language.language_report(table).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(240) if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240))
    assert np.mean([got[i].lang_pred == list(kinds)[i % 4] for i in held]) > 0.9
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred == "aa"
    assert all(0 <= g.score <= 1 for g in got.values())
    kept = language.keep_known(table)
    assert kept.columns == table.columns and kept.count() >= 235
    alone = documents(spark, [(i, text("abc", i), "zz", "s") for i in range(8)])
    assert {(r.lang_pred, r.score) for r in language.language_report(alone).collect()} == {("zz", 1.0)}


def test_score(docs, rows):
    count, total = collections.Counter(), 0
    for d, text, _, _ in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1:
            count.update([*words(text), None])
            total += len(words(text)) + 1
    got = scoring.score(docs).collect()
    assert len(got) == len(rows)
    texts = {d: t for d, t, _, _ in rows}
    for g in got:
        tokens = [*words(texts[g.doc_id]), None]
        base = sum(np.log10((count[t] + 0.5) / (total + 0.5 * (len(count) + 1))) for t in tokens)
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(tokens), sum(count[t] > 0 for t in tokens), total)
        assert abs(g.base_score - base) < 1e-6 * max(1, -base) and g.score < 0
    held = [g for g in got if g.held_out]
    assert sum(g.score for g in held) > 1.05 * sum(g.base_score for g in held)


def test_spelling_keeps_every_gram(spark, docs):
    """Word scores from ranges are those of one trie over all n-grams, with no bound on their number and none broadcast."""
    from factorframe.llm import trie

    assert not hasattr(scoring, "MODEL_GRAMS")
    r = np.random.default_rng(3)
    spelled = sorted({bytes(r.integers(97, 110, r.integers(1, 12)).astype(np.uint8)) for _ in range(900)})
    data = np.frombuffer(b" ".join(spelled) + b" ", np.uint8)
    end = np.flatnonzero(data == 32)
    start = np.concatenate([[0], end[:-1] + 1])
    keys, n = trie.ngrams(data, start, end, np.ones(len(start)), 6)
    grams = spark.createDataFrame([(int(k), int(c)) for k, c in zip(keys.view(np.int64), n)], "gram long, n long")
    tables = trie.short_tables(keys[(keys & np.uint64(7)) < 3], n[(keys & np.uint64(7)) < 3])
    got = scoring.window_scores(grams, tables[1], 6, 5).toPandas().sort_values("gram")
    whole = got["gram"].to_numpy().view(np.uint64)
    by = np.argsort(whole)
    mine = scoring.spellings(data, start, end, 6, tables, whole[by], got["value"].to_numpy()[by])
    # brute force, interpolated from the uniform distribution up
    count = collections.Counter()
    for w in spelled:
        text = b" " + w + b" "
        count.update(text[i:i + k] for k in range(1, 7) for i in range(len(text) - k + 1) if (i, k) != (0, 1))
    after = collections.defaultdict(list)
    for g, c in count.items():
        after[g[:-1]].append(c)

    def chance(g):
        if not g:
            return 1 / 256
        seen = after[g[:-1]]
        return (count[g] + len(seen) * chance(g[1:])) / (sum(seen) + len(seen))
    want = [sum(np.log10(chance((b" " + w + b" ")[max(0, i - 5): i + 1])) for i in range(1, len(w) + 2)) for w in spelled]
    assert np.abs(mine - want).max() < 1e-9
    # a trie holds the same values, rounded to a byte
    assert np.abs(trie.WordModel(trie.build(keys, n, 6)).score(data, start, end) - want).max() < 0.5


def test_score_reads_preceding_words(docs, rows, spark):
    """Every document's score from counts of words and of pairs of neighbours, by brute force, spelling by single bytes."""
    train = [["", *words(t), ""] for d, t, _, _ in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1]
    one = collections.Counter(w for t in train for w in t[1:])
    two = collections.Counter(p for t in train for p in zip(t, t[1:]))
    vocabulary, tokens = [w for w in one if w], sum(one[w] for w in one if w)
    letters = collections.Counter(b for w in vocabulary for b in w.encode() + b" ")
    bottom = sum(letters.values()) + len(letters)
    spelled = {w: np.prod([(letters[b] + len(letters) / 256) / bottom for b in w.encode() + b" "]) for w in vocabulary}
    once, twice = (sum(one[w] == k for w in vocabulary) for k in (1, 2))
    discount = (once + 0.5) / (once + 2 * twice + 1)
    free, stop = discount * len(vocabulary) / tokens, (len(train) + 0.5) / (tokens + len(train) + 1)

    def alone(w):
        if not w:
            return stop
        return (1 - stop) * (max(one[w] - discount, 0) / tokens + free * spelled[w] if one[w] else free * (1 - sum(spelled.values())))

    def log_score(text):
        t, mass = ["", *words(text), ""], scoring.CONTEXT_MASS
        return sum(np.log10((two[v, w] + mass * alone(w)) / (one[v] + mass)) for v, w in zip(t, t[1:]))
    want = sorted((d if d is not None else -1, round(log_score(t), 3)) for d, t, _, _ in rows)
    got = sorted((g.doc_id if g.doc_id is not None else -1, round(g.score, 3)) for g in scoring.score(docs, order=1).collect())
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 0.002 + 1e-6 * abs(b[1]) for a, b in zip(got, want)) and len(got) == len(want)
    # the probabilities after any word sum to one
    for v in ["", *vocabulary[:5]]:
        known = sum((two[v, w] + scoring.CONTEXT_MASS * alone(w)) / (one[v] + scoring.CONTEXT_MASS) for w in one)
        assert abs(known + scoring.CONTEXT_MASS * alone("never seen") / (one[v] + scoring.CONTEXT_MASS) - 1) < 1e-9
    # the same words in another order, both held out
    texts = ["to be or not to be that is the question"] * 30
    held = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    table = [(i, t, "a", "s") for i, t in enumerate(texts)] + [(held[0], texts[0], "a", "s"), (held[1], " ".join(texts[0].split()[::-1]), "a", "s")]
    score = {g.doc_id: g.score for g in scoring.score(documents(spark, table)).collect()}
    assert score[held[0]] > score[held[1]] + 0.5


@pytest.mark.parametrize("window", [2048, 50])
def test_pack(docs, rows, window):
    got = packing.pack(docs, window=window).collect()
    tokenizer = packing.PieceTokenizer(packing.default_tokenizer())
    texts = collections.defaultdict(list)
    for d, t, _, _ in rows:
        texts[d].append([*tokenizer.tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for g in got:
        assert g.doc_tokens == len(texts[g.doc_id][0])
        ids = texts[g.doc_id][0][g.start: g.start + g.length]
        raw = np.array(ids, "<u4").tobytes()
        assert len(ids) == g.length and g.ids_crc32 == zlib.crc32(raw) and bytes(g.ids) == raw
        pieces[g.doc_id] += range(g.start, g.start + g.length)
        sequences[g.sequence_id].append((g.offset, g.length))
    for d, lists in texts.items():
        assert sorted(pieces[d]) == sorted([*range(len(lists[0]))] * len(lists))
    last = max(sequences)
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or s == last and at < window


def test_tokenizer_pieces():
    import random

    p = packing.PieceTokenizer(packing.default_tokenizer())
    r = random.Random(4)
    alphabet = ["a", "b", " ", "\n", "\t", "1", "!", "é", "  ", " ", "　", "'s", "'", "\r", "漢", "😀", "<|endoftext|>"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 14))) for _ in range(3000)]
    for a, b in zip(p.encode(texts), p.whole(texts)):
        assert np.array_equal(a, b)
