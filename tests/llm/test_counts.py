"""Collocations, decontamination and spelling variants against brute force."""

import collections
import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_fixtures import LOWER, corpus, documents, prose  # noqa: E402

from factorframe.llm import collocations, decontaminate, spelling  # noqa: E402


def typed(seed=4, n=150):
    """Rows whose words come from few syllables, so that phrases repeat and words have near ones."""
    r = random.Random(seed)
    stems = ["color", "colour", "colur", "aabbc", "abbc", "centre", "center", "meter", "metre", "motor", "élève", "éleve", "bookk", "book", "boookk"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(1, 60)):
            w = r.choice(stems) if r.random() < 0.7 else f"w{r.randrange(30)}"
            if r.random() < 0.08:
                k = r.randrange(len(w))
                w = w[:k] + r.choice("abcé") + w[k + r.randrange(2):]
            parts.append(w.upper() if r.random() < 0.1 else w)
            if r.random() < 0.15:
                parts.append(r.choice([".", ", ", "\n", "\t", ":", "\x0b"]))
        rows.append((i, " ".join(parts), r.choice(["aa", "bb", None]), "s"))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus() + [(2000 + d, *rest) for d, *rest in typed()] + [(5000, "y" * 70000 + " " + "yes " * 300, "aa", "s"), (5000, "dup dup", None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows)


@pytest.fixture
def many_tasks(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def phrases_by_hand(rows, least, half, top):
    f = collections.defaultdict(collections.Counter)
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(w[i:i + k] for i in range(len(w) - k + 1))
    out = set()
    for lang, count in f.items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        candidates = {p: c for p, c in count.items() if len(p) > 1 and c >= least}
        taken = {}
        for p, c in candidates.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    taken[q] = max(taken.get(q, 0), c)
        kept = []
        for p, a in candidates.items():
            if len(p) == 2 and 100 * taken.get(p, 0) >= half * a:
                continue
            score, _, l, r = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top]):
            out.add((lang, i + 1, p.decode(), -a, l, r, n, -s))
    return out


@pytest.mark.parametrize("least, half, top", [(10, 50, 2000), (2, 80, 7)])
def test_phrases(docs, rows, many_tasks, least, half, top):
    want = phrases_by_hand(rows, least, half, top)
    got = collocations.collocations(docs, least, half, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(want) and set(got) == want and want


def test_phrase_counts_past_64_bits(spark):
    parts = spark.createDataFrame([(1, 2, 0, 9123456789012, 9223456789012, None, 9993456789012, None, None)],
                                  "x long, y long, z long, a long, lx long, lxy long, rz long, ryz long, extension long")
    assert collocations.scored(parts).first()["score"] == 1000000 * 9123456789012**2 // (9223456789012 * 9993456789012)


def test_lockstep_needs_counts_of_earlier_tasks(spark, many_tasks):
    """One word opens most phrases, so its range spans many tasks."""
    text = " . ".join(f"of w{i} x{j}" for i in range(40) for j in range(10))
    rows = [(k, text, "aa", "s") for k in range(12)]
    got = {tuple(r) for r in collocations.collocations(documents(spark, rows)).collect()}
    assert got == phrases_by_hand(rows, 10, 50, 2000) and len(got) > 400


TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks_by_hand(rows, items, window=10):
    grams = collections.defaultdict(set)
    for item, text in items:
        w = TOKEN.findall((text or "").translate(LOWER))
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            grams[tuple(w[i:i + k])].add("" if item is None else str(item))
    lengths = {len(g) for g in grams}
    out = collections.Counter()
    for d, text, _, _ in rows:
        w = TOKEN.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in grams:
                    hit |= set(range(i, i + k))
                    found |= grams[tuple(w[i:i + k])]
        out[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.fixture(scope="module")
def bench_rows(rows):
    by_id = {r[0]: r[1] for r in rows}
    cut = by_id[7].split(" ")
    return [(1, by_id[7]), (2, " ".join(cut[3:15]) + " unseen words here"), (3, prose(99, 30, 9000)), (4, "One, TWO"), (5, ""), (6, None), (None, by_id[9]),
            (7, by_id[7]), (7, by_id[11]), (8, "repeat row here"), (9, "élève"), (10, " ".join(["yes"] * 14)), (11, prose(9, 6000).upper())]


@pytest.fixture(scope="module")
def benchmark(spark, bench_rows):
    return spark.createDataFrame([(*r, "x", 1) for r in bench_rows], "item_id long, text string, doc_id string, chunk int")


def test_leaks(docs, rows, benchmark, bench_rows):
    want = leaks_by_hand(rows, bench_rows)
    assert sum(n for k, n in want.items() if k[-1]) > 5
    for chunk_bytes in (decontaminate.CHUNK_BYTES, 20000):
        got = decontaminate.contamination(docs, benchmark, chunk_bytes=chunk_bytes)
        assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        assert collections.Counter(map(tuple, got.collect())) == want
        left = decontaminate.clean(docs, benchmark, chunk_bytes=chunk_bytes)
        assert left.columns == docs.columns
        assert collections.Counter(r.doc_id for r in left.collect()) == collections.Counter(k[0] for k, n in want.items() if not k[-1] for _ in range(n))


def test_leaks_without_items(docs, rows, spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert collections.Counter(map(tuple, decontaminate.contamination(docs, nothing).collect())) == leaks_by_hand(rows, [])
    assert decontaminate.longest_matches(docs, nothing).count() == 0


def test_longest_matches(docs, rows, benchmark, bench_rows):
    texts = collections.defaultdict(list)
    for d, text, _, _ in rows:
        texts[d].append(TOKEN.findall((text or "").translate(LOWER)))
    items = collections.defaultdict(list)
    for i, text in bench_rows:
        items["" if i is None else str(i)].append(TOKEN.findall((text or "").translate(LOWER)))
    spaced = [" " + " ".join(w) + " " for ws in texts.values() for w in ws]
    got = {r.item_id: r for r in decontaminate.longest_matches(docs, benchmark).collect()}
    for i, lists in items.items():
        best = 0
        for w in lists:
            for a in range(len(w)):
                while a + best < len(w) and any(" " + " ".join(w[a:a + best + 1]) + " " in t for t in spaced):
                    best += 1
        assert (got[i].length if i in got else 0) == best
        if best:
            g = got[i]
            assert any(w[g.item_word:g.item_word + best] == t[g.doc_word:g.doc_word + best] for w in lists for t in texts[g.doc_id])


def test_suffix_array():
    r = np.random.default_rng(3)
    for n, v in ((0, 2), (1, 1), (50, 2), (300, 4)):
        codes = r.integers(0, v, n)
        text = np.sort(r.integers(0, 4, n))
        left = decontaminate.room(text)
        order = decontaminate.suffix_array(codes, left, 1000)
        suffixes = [codes[i:i + left[i]].tolist() for i in order]
        assert suffixes == sorted(suffixes) and sorted(order) == list(range(n))


def spelling_by_hand(rows, letters=5, times=3, ratio=2):
    n = collections.Counter()
    for d, text, _, _ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= letters:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= times}

    def near(u, v):
        if abs(len(u) - len(v)) > 1 or u == v:
            return False
        if len(u) == len(v):
            return sum(a != b for a, b in zip(u, v)) == 1
        u, v = sorted((u, v), key=len)
        return any(v[:i] + v[i + 1:] == u for i in range(len(v)))

    close = {u: [v for v in n if near(u, v)] for u in n}
    form = {}
    for u, c in n.items():
        best = min(close[u], key=lambda v: (-n[v], v), default=None)
        form[u] = best if best is not None and n[best] >= ratio * c else None
    out = set()
    for u in n:
        root = u
        while form[root] is not None:
            root = form[root]
        out.add((u, form[u], root, n[u], len(close[u]), n[form[u]] if form[u] else None))
    return out


def misspelt(seed=6, words=60, n=400):
    """Words of falling frequency, some with one or two slips."""
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeé") for _ in range(r.randrange(5, 9))) for _ in range(words)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(20):
            w = stems[int(words * r.random() ** 3)]
            for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
                k = r.randrange(len(w))
                w = w[:k] + r.choice(["", "a", "b", w[k] + "c", w[k] * 2]) + w[k + 1:]
            parts.append(w)
        rows.append((9000 + i, " ".join(parts), "aa", "s"))
    return rows


def test_spelling(spark, rows, many_tasks):
    rows = rows + misspelt()
    want = spelling_by_hand(rows)
    got = spelling.variants(documents(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(want) and set(got) == want
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] not in (None, w[2]) for w in want)


def test_lost_letters(spark):
    """Long runs, runs of two-byte letters and null ids lose the letter that their hash names."""
    r = random.Random(2)
    rows = [(r.choice([None, 5, -7, 12345678901]), " ".join("".join(r.choice("abÀÿZ×") for _ in range(k)) for _ in range(6)), "aa", "s")
            for k in (5, 6, 7, 63, 64, 65, 200) for _ in range(40)]
    got = {(g.word, g.n) for g in spelling.word_counts(documents(spark, rows), 5, 1).collect()}
    assert got == {(w[0], w[3]) for w in spelling_by_hand(rows, 5, 1)}


def test_empty(spark):
    empty = documents(spark, [])
    assert collocations.collocations(empty).count() == 0 and spelling.variants(empty).count() == 0
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.clean(empty, bench).count() == 0
    blank = documents(spark, [(1, None, None, None), (2, "", "aa", "s"), (3, "... ", "aa", "s")])
    assert collocations.collocations(blank).count() == 0 and spelling.variants(blank).count() == 0
