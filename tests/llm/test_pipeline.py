"""The pipeline's rows against a chain of plain steps, one document after the other."""

import collections
import hashlib
import math
import os
import re
import sys

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_fixtures import corpus, documents, words  # noqa: E402
from test_documents import brute_components, units_by_hand  # noqa: E402

from factorframe.llm import language, packing  # noqa: E402

LOWEST = -(1 << 63)


def known_by_hand(rows, model):
    out = []
    for r in rows:
        if re.search(r"[^\W\d_]", r[1] or ""):
            names, scores = model.predict(language.features(pa.array([r[1]])))
            if names[0] != "und" and scores[0] >= 0.2:
                out.append(r)
    return out


def distinct_by_hand(rows):
    low = brute_components(rows, 5, 80)
    return [r for r in rows if r[0] is None or low[r[0]][1] == r[0] or low[r[0]][0] == 0]


def cut_by_hand(rows):
    first, units = {}, []
    for i, (d, text, _, _) in enumerate(rows):
        rank = LOWEST if d is None else d
        for a, b, w in units_by_hand(text or ""):
            units.append((i, rank, a, b, w))
            first[w] = min(first.get(w, (rank, a)), (rank, a))
    gone = collections.defaultdict(set)
    for i, rank, a, b, w in units:
        if (rank, a) != first[w]:
            gone[i] |= set(range(a, b))
    out = []
    for i, (d, text, lang, source) in enumerate(rows):
        if gone[i]:
            left = []
            for m in re.finditer(r"[^\n]*(?:\n|$)", text):
                kept = "".join(c for k, c in enumerate(m[0], m.start()) if k not in gone[i])
                whole = m[0].rstrip("\n")
                if not (whole and set(range(m.start(), m.start() + len(whole))) <= gone[i]):  # a line that loses all goes with its feed
                    left.append(kept)
            text = "".join(left)
            if not text.strip():
                continue
        out.append((d, text, lang, source))
    return out


def mixed_by_hand(rows):
    size = collections.Counter()
    for _, text, _, source in rows:
        size[source] += len(words(text))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} if full else {s: unit * weight[s] for s in open_}
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    out = []
    for s in order:
        epochs = math.floor(target[s] / size[s]) if size[s] else 0
        budget = target[s] - epochs * size[s]
        keyed = collections.defaultdict(list)
        for r in rows:
            if r[3] == s:
                text = r[1] or ""
                u = (int(hashlib.md5(("mix" + ("" if r[0] is None else str(r[0]))).encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
                chars, noise = len(re.sub(r"[\x20\x09-\x0D]", "", text)), sum(c in "#*$%&|<>!" for c in text)
                good = max(0.05, 1 - 4 * noise / chars) if chars else 1.0
                keyed[-math.log(u) / good, LOWEST if r[0] is None else r[0]].append(r)
        ahead, cut = 0, None
        for key in sorted(keyed):
            n = sum(len(words(r[1])) for r in keyed[key])
            if 2 * ahead + n <= 2 * budget:
                cut = key
            ahead += n
        for key, group in keyed.items():
            copies = epochs + (cut is not None and key <= cut)
            out += [r for r in group if words(r[1]) for _ in range(copies)]
    return out


def test_run(spark, tmp_path):
    import corpus_pipeline as cp

    rows = corpus(seed=5)
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = mixed_by_hand(cut_by_hand(distinct_by_hand(known_by_hand(rows, language.fit(docs)))))
    tokenizer = packing.PieceTokenizer(packing.default_tokenizer()).tokenizer
    want = collections.Counter()
    for d, text, _, _ in left:
        want.update((d, at, x) for at, x in enumerate([*tokenizer.encode(text, add_special_tokens=False).ids, 1]))
    got, sequences = collections.Counter(), collections.defaultdict(list)
    for p in cp.run(spark, str(tmp_path)).collect():
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length
        got.update((p.doc_id, p.start + i, x) for i, x in enumerate(ids))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert got == want and want
    for s, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or s == max(sequences)
