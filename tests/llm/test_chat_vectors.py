"""Chat templates, embeddings, the trie, components and the pipeline."""

import collections
import hashlib
import math
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_fixtures import corpus, documents  # noqa: E402

from factorframe.llm import chat, shared, trie, vectors  # noqa: E402
from factorframe.llm.template import Template, TemplateError  # noqa: E402


def render(source, filters=None, **context):
    return "".join(Template(source, filters).render(**context).parts)


def test_template_language():
    assert render("a{{ 'b' ~ 1 }}{{ x.y }}", x={"y": "c"}) == "ab1c"
    assert render("{% for i in xs %}{% if loop.first %}[{% elif not loop.last %},{% else %};{% endif %}{{ i }}{% endfor %}", xs=[1, 2, 3]) == "[1,2;3"
    assert render("{% set a = x ~ '!' %}{{ a | up }}", {"up": str.upper}, x="h") == "H!"
    assert render("{{ (x == 1 or false) and 'q' in 'aqb' }}{{ missing }}", x=1) == "True"
    folded = Template("{% if 1 == 2 %}no{% else %}{{ 'y' ~ 'es' }}{% endif %}!").tree
    assert folded == [("text", "yes!")]
    assert render("{{ x.__class__ }}{{ x.upper }}", x="s") == ""
    for bad in ("{% for x %}", "{{ f(1) }}", "{% if x %}", "{{ x | nofilter }}", "{% import os %}", "{{ 'a }}", "{% endfor %}", "{{ }}"):
        with pytest.raises(TemplateError):
            Template(bad)


def test_escape_round_trip():
    for text in ("<|im_end|>", "<\\|x", "<\\\\|<|", "<", "|", "a<", "", "<<||>"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text + "\n" + text)) == text + "\n" + text


def test_chat(spark):
    rows = [(1, 1, "assistant", "b <|im_end|>\n<|im_start|>assistant\nx"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, 0, "sys\ntem", "<\\|"),
            (3, 0, "assistant", "t"), (3, 0, "assistant", "t"), (3, 0, None, "s"), (None, 0, "user", "n"), (4, 0, "user", "é" * 50_000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {g.conv_id: g for g in chat.chat_report(table).collect()}
    groups = collections.defaultdict(list)
    for c, t, r, x in [*rows, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]:
        groups[c].append((t, r or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_report(table.limit(0)).count() == 1


def near_brute(ids, xs, threshold=0.9):
    unit = [np.array(x) / np.linalg.norm(x) if x and None not in x and np.isfinite(x).all() and np.any(x) else None for x in xs]
    n = len(ids)
    link = [[a != b and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold
             for b in range(n)] for a in range(n)]
    out = {}
    for a in range(n):
        seen, stack = {a}, [a]
        while stack:
            k = stack.pop()
            new = {b for b in range(n) if link[k][b]} - seen
            seen |= new
            stack += new
        out[ids[a]] = (sum(link[a]), min(ids[b] for b in seen))
    return out


@pytest.mark.parametrize("chunk, near", [(vectors.CHUNK, 99), (7, 99), (3, None)])
def test_vectors(spark, chunk, near):
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 8))
    xs = [x.tolist() for x in base] + [(base[i % 9] + r.normal(size=8) * 0.12).tolist() for i in range(60)] + [base[0].tolist()] * 12
    xs += [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0], (base[1] * 1e150).tolist()]
    ids = list(range(len(xs)))
    table = spark.createDataFrame([(i, x, 0, "x") for i, x in zip(ids, xs)], "vec_id long, embedding array<double>, label int, cell string")
    got = {g.vec_id: g for g in vectors.near_vectors(table, near=near, chunk=chunk).collect()}
    assert {i: (g.n_links, g.component_id) for i, g in got.items()} == near_brute(ids, xs)
    assert all(g.kept == (g.vec_id == g.component_id) for g in got.values())
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_vector_recall(spark):
    """The registered parameters find nearly all links between vectors that spread over many cells."""
    r = np.random.default_rng(3)
    base = r.normal(size=(1500, 16))
    xs = np.concatenate([base, base[:700] + r.normal(size=(700, 16)) * 0.33])
    unit = xs / np.linalg.norm(xs, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum() - len(xs)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)], "vec_id long, embedding array<double>")
    found = vectors.near_vectors(table).agg({"n_links": "sum"}).first()[0]
    assert 0.97 * want <= found <= want


@pytest.mark.parametrize("cells, nested", [(200, False), (1024, False), (1024, True)])
def test_recall_does_not_fall_with_cells(cells, nested, monkeypatch):
    """Pairs at cosine 0.9 in uniform directions of 64 dimensions: one visits the home of the other."""
    r = np.random.default_rng(4)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    if nested:
        monkeypatch.setattr(vectors, "FLAT_CELLS", 64)
    centres = vectors.nested_kmeans(unit(r.normal(size=(8 * cells, 64))), cells)
    assert 0.9 * cells <= len(centres) <= 1.1 * cells
    x = unit(r.normal(size=(1500, 64)))
    off = r.normal(size=x.shape)
    off = unit(off - (off * x).sum(axis=1, keepdims=True) * x)
    y = 0.9 * x + math.sqrt(1 - 0.81) * off
    near = vectors.visits(len(centres))
    by_x, by_y = (np.argsort(-(v @ centres.T), axis=1)[:, :near] for v in (x, y))
    met = (by_y == by_x[:, :1]).any(axis=1) | (by_x == by_y[:, :1]).any(axis=1)
    assert met.mean() >= 0.97


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 4), (1000, 50), (3000, 10**9)):
        values = np.sort(r.integers(0, top, n))
        low, high, bits = trie.EliasFano.encode(values, int(values[-1]) + 1)
        e = trie.EliasFano(low, high, bits, n)
        distinct = np.unique(values)
        ask = np.concatenate([distinct, r.integers(0, top + 5, 50)])
        at = e.find(ask, np.zeros(len(ask), int), np.full(len(ask), n))
        assert all(values[a] == v if a >= 0 else v not in set(values.tolist()) for a, v in zip(at, ask))


def test_trie_probabilities():
    """Smoothed probabilities of all continuations of a context add up to one, but for the byte codes."""
    ws = [b"the", b"then", b"of", b"there", b"xyz", "éa".encode()]
    data = np.frombuffer(b"".join(ws), np.uint8)
    end = np.cumsum([len(w) for w in ws])
    keys, counts = trie.ngrams(data, end - [len(w) for w in ws], end, np.array([10, 3, 5, 2, 1, 1]), 4)
    model = trie.WordModel(trie.build(keys, counts, 4))
    ask = [b"", *[bytes([b]) for b in range(33, 256)]]  # bytes below are white space or never follow
    probe = [b"th" + a for a in ask]
    flat = np.frombuffer(b"".join(probe), np.uint8)
    end = np.cumsum([len(p) for p in probe])
    got = model.score(flat, end - [len(p) for p in probe], end)
    assert got[ask.index(b"e")] > got[ask.index(b"q")] and np.isfinite(got).all()


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (7, 7), (None, 3), (200, 90), (90, 101)]
    got = {r.id: r.label for r in shared.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 90 for i in (90, 100, 101, 200)}}
    assert shared.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = documents(spark, corpus()).select("doc_id", "text", "lang", "source", "n_chars")
    for name, step in cp.STAGES[:-1]:
        left = shared.stage(step(spark, docs, ""))
        assert left.columns == docs.columns, name
        docs = left
    ids = {r.doc_id for r in docs.collect()}
    assert 1000 not in ids and 1006 not in ids and len(ids) > 50
    packed = cp.STAGES[-1][1](spark, docs, "")
    assert packed.agg({"length": "sum"}).first()[0] == packed.where("start = 0").agg({"doc_tokens": "sum"}).first()[0]


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
