"""Small tables with the awkward rows every operator must stand, and brute-force counterparts."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
# extra columns whose names the operators use inside
EXTRA = ["size", "key", "digest", "block", "rep", "cell", "shard", "score", "lang_pred", "n_words", "begin", "row_", "votes", "held", "bucket"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def documents(spark, rows):
    """rows of (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, len(r[1] or ""), *("x" for _ in EXTRA)) for r in rows], SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=120):
    """Random texts, exact and near copies, shared lines, nulls, empties, ties, repeated rows, one long text."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [prose(r.random(), r.randrange(5, 40)) for _ in range(r.randrange(1, 6))]
        rows.append([i, "\n".join(lines) + ".", r.choice(["aa", "bb"]), r.choice(["s1", "s2", "S3", None])])
    for i in range(n, n + 40):
        base = rows[r.randrange(n)][1]
        copy = base.split(" ")
        if r.random() < 0.6 and len(copy) > 20:
            copy[r.randrange(len(copy))] = "changed"
        rows.append([i, " ".join(copy), "aa", "s1"])
    rows += [[1000, None, None, None], [1001, "", "aa", "s1"], [1002, " \n\t ", "aa", "s2"], [1003, "one", "bb", "s2"], [1004, "One two", "bb", "s2"],
             [1005, "one two", "bb", None], [1006, "... !!! 123", "aa", "s1"], [1007, prose(9, 6000), "bb", "s1"], [None, prose(3, 30), "aa", "s1"],
             [1008, "repeat row here", "aa", "s1"], [1008, "repeat row here", "aa", "s1"], [-5, rows[3][1], "aa", "s2"]]
    return [tuple(x) for x in rows]
