"""Language identification in two steps: the family first, then one-versus-one linear support vector machines inside it.

Features are hashed byte bigrams and trigrams of the whole text (A-Z in lower case), as square roots of counts on the unit
sphere. Languages are joined into families by average linkage of their mean vectors, about the square root of their number.
Families are told apart one versus the rest, languages of a family one versus one by votes; all machines have a squared hinge
loss. They are fitted on at most PER_LANGUAGE labelled documents per language, those of smallest id hash.

Defined cases: null text or text without a letter is `und` with score 0; so is everything where nothing was learned; a single
learned language takes all other texts with score 1; very long texts are a slice of their own; ties between languages go to the first in
order; repeated rows are judged alike; an empty table gives no rows; other
columns pass through `keep_known` untouched, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorframe.llm import spans
from factorframe.llm.shared import id_crc
from factorframe.llm.similarity import small_side

WIDTH = 2048
PER_LANGUAGE = 500
SALTS = 64
LETTER = r"\p{L}"
STEPS, PENALTY = 200, 1e-4


def features(texts: pa.Array) -> np.ndarray:
    data, offsets = spans.text_bytes(texts)
    data = spans.LOWER[data].astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    out = np.zeros(len(texts) * WIDTH)
    with np.errstate(over="ignore"):
        for k, salt in ((2, 0x9E3779B97F4A7C15), (3, 0xC2B2AE3D27D4EB4F)):
            n = len(data) - k + 1
            if n <= 0:
                continue
            code = data[:n].copy()
            for j in range(1, k):
                code = code << np.uint64(8) | data[j: j + n]
            slot = ((code + np.uint64(1)) * np.uint64(salt)) >> np.uint64(64 - 11)
            whole = doc[:n] == doc[k - 1:]
            out += np.bincount(doc[:n][whole] * WIDTH + slot[whole].astype(np.int64), minlength=len(out))
    out = np.sqrt(out.reshape(len(texts), WIDTH))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine with squared hinge loss, by accelerated gradient steps; classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    full = np.hstack([x, np.ones((len(x), 1))])
    w = last = np.zeros(full.shape[1])
    rate = 1 / (2 * (full * full).sum(axis=1).max() + PENALTY)
    for t in range(STEPS):
        ahead = w + t / (t + 3) * (w - last)
        slack = np.maximum(0, 1 - y * (full @ ahead))
        last, w = w, ahead - rate * (PENALTY * ahead - 2 * full.T @ (weight * slack * y))
    return w[:-1], float(w[-1])


@dataclass
class Languages:
    families: list[list[str]]
    family_w: np.ndarray  # a column per family
    family_b: np.ndarray
    duels: dict  # (family, a, b) -> weights, offset; positive for a

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = x @ self.family_w + self.family_b
        family = margins.argmax(axis=1)
        sure = 1 / (1 + np.exp(-4 * margins.max(axis=1))) if len(self.families) > 1 else np.ones(len(x))
        names, score = np.empty(len(x), object), np.zeros(len(x))
        for f, members in enumerate(self.families):
            at = np.flatnonzero(family == f)
            if not len(at):
                continue
            votes = np.zeros((len(at), len(members)))
            belief = np.zeros((len(at), len(members)))
            for a in range(len(members)):
                for b in range(a + 1, len(members)):
                    w, c = self.duels[f, a, b]
                    p = 1 / (1 + np.exp(-4 * (x[at] @ w + c)))
                    votes[:, a] += p >= 0.5
                    votes[:, b] += p < 0.5
                    belief[:, a] += p
                    belief[:, b] += 1 - p
            best = (votes + belief / (len(members) + 1)).argmax(axis=1)
            names[at] = np.array(members, object)[best]
            inner = belief[np.arange(len(at)), best] / (len(members) - 1) if len(members) > 1 else 1.0
            score[at] = sure[at] * inner
        return names.tolist(), score


def grown_families(names: list[str], means: np.ndarray, count: int) -> list[list[str]]:
    groups = [[i] for i in range(len(names))]
    alike = means @ means.T
    while len(groups) > count:
        a, b = max(((a, b) for a in range(len(groups)) for b in range(a + 1, len(groups))),
                   key=lambda p: alike[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] += groups.pop(b)
    return [sorted(names[i] for i in g) for g in groups]


def train(x: np.ndarray, y: list[str]) -> Languages:
    names = sorted(set(y))
    label = np.array(y, object)
    means = np.stack([x[label == n].mean(axis=0) for n in names])
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    families = grown_families(names, means, math.ceil(math.sqrt(len(names))))
    home = np.array([next(f for f, m in enumerate(families) if n in m) for n in y])
    if len(families) > 1:
        sides = [svm(x, np.where(home == f, 1.0, -1.0)) for f in range(len(families))]
    else:
        sides = [(np.zeros(x.shape[1]), 0.0)]
    duels = {}
    for f, members in enumerate(families):
        for a in range(len(members)):
            for b in range(a + 1, len(members)):
                pick = (label == members[a]) | (label == members[b])
                duels[f, a, b] = svm(x[pick], np.where(label[pick] == members[a], 1.0, -1.0))
    return Languages(families, np.stack([w for w, _ in sides], axis=1), np.array([b for _, b in sides]), duels)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Languages | None:
    """Learn from labelled documents with a letter whose id hash is not held out (crc32 modulo 4 is not 2)."""
    # in two levels, so that the last window sees at most SALTS * per_language rows of a language, however many tasks there are
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*by_hash)
    slim = docs.select("doc_id", "lang", "text")
    labelled = slim.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER) & (id_crc() % 4 != 2))
    first = labelled.select("lang", "doc_id").withColumn("n", F.row_number().over(salted)).where(F.col("n") <= per_language)
    picked = first.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*by_hash))).where(F.col("n") <= per_language)
    chosen = picked.select(F.col("doc_id").alias("chosen")).distinct()

    def run(batches):
        for batch in batches:
            for part in spans.slices(batch):
                x = features(part.column("text")).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])
    rows = (labelled.join(small_side(chosen), F.col("doc_id") == F.col("chosen"), "left_semi").select("lang", "text")
            .mapInArrow(run, "lang string, x binary").toArrow())
    if rows.num_rows == 0:
        return None
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)
    y = rows.column("lang").to_pylist()
    order = sorted(range(len(y)), key=lambda i: (y[i], x[i].tobytes()))  # the same whatever the order of arrival
    return train(x[order], [y[i] for i in order])


def identified(docs: DataFrame, model: Languages | None) -> DataFrame:
    """row (all columns of docs as a struct), lang_pred and score. Only the texts go to Python."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def told(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for part in spans.slices(pa.RecordBatch.from_arrays([texts], names=["text"])):
            missing = part.column("text").is_null().to_numpy(zero_copy_only=False)
            some, score = ["und"] * len(missing), np.zeros(len(missing))
            if model.value is not None:
                some, score = model.value.predict(features(part.column("text")))
                score[missing] = 0
            names += ["und" if m else n for m, n in zip(missing, some)]
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores or [np.zeros(0)]))], names=["lang_pred", "score"])

    lettered = F.when(F.col("text").rlike(LETTER), F.col("text"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, told(lettered).alias("told")).select("row", "told.lang_pred", "told.score")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return identified(docs.select("doc_id", "text"), fit(docs)).select("row.doc_id", "lang_pred", "score").select(
        "doc_id", (id_crc() % 4 == 2).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """The rows of docs in a language told with at least that score, columns unchanged.

    Where no row has a label to learn from, no language can be told, and every row with a letter stays.
    """
    model = fit(docs)
    told = identified(docs, model)
    good = F.col("row.text").rlike(LETTER) if model is None else (F.col("lang_pred") != "und") & (F.col("score") >= least)
    return told.where(good).select(*[F.col("row")[c].alias(c) for c in docs.columns])
