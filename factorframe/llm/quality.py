"""Quality rules by weak supervision: rules vote or abstain, EM estimates their accuracies, the posterior decides.

Each rule votes good, bad or abstains on counts of the text. The votes of a document are one of at most 3^rules patterns, so
EM needs only the pattern counts over all documents: one partial aggregate, then iterations over that bounded table inside a
single row of higher-order functions. The posterior per pattern joins back to the documents. DataFrame functions only.

Model: class y with prior p; a rule with accuracy a votes y with probability a when it votes, independently. Accuracies stay
within [0.55, 0.99], so that rules never turn around, under a Beta(9, 1) prior; abstaining says nothing. A document without any vote has posterior p.

Defined cases: null or empty text has no words and fails the base rules; texts of any length are judged whole; ties do not matter; repeated rows are judged alike; an empty table gives
no rows; other columns are ignored by the report and pass through `keep_good`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorframe.llm.shared import SPACES, WORD, stage, text_or_empty

ROUNDS = 25
PRIOR, START = 0.8, 0.9
SYMBOLS = "#*$%&|<>"

# name -> (good vote, bad vote) as SQL over the counts, used by Spark and the SQL twin alike; neither: abstain
# Rules for defects vote bad or abstain: a text free of one defect need not be good. Only prose votes good.
NEVER = "FALSE"
RULES = {
    "prose": ("n_symbols * 200 <= word_chars AND n_marks * 10 <= n_words AND n_caps * 10 <= word_chars AND n_dup_lines = 0 "
              "AND n_repeat_words * 10 <= n_words AND word_chars BETWEEN 3 * n_words AND 10 * n_words", NEVER),
    "symbols_by_word": (NEVER, "n_symbols * 5 >= n_words"),
    "symbols_by_char": (NEVER, "n_symbols * 25 >= word_chars"),
    "marks": (NEVER, "n_marks * 3 >= n_words AND n_marks >= 10"),
    "shouting": (NEVER, "n_caps * 3 >= word_chars"),
    "line_copies": (NEVER, "n_dup_lines * 3 >= n_lines AND n_dup_lines >= 2"),
    "repeats": (NEVER, "n_repeat_words * 10 >= 4 * n_words"),
    "word_length": (NEVER, "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
}


def counted(docs: DataFrame) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_caps, n_marks."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    base = docs.select(
        "doc_id", F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_caps"),
        (F.length(text) - F.length(F.translate(text, "!|", ""))).cast("long").alias("n_marks"),
        lines.alias("lines"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    # a window of three words is its hash; sorting (hash, place) puts equal windows side by side
    windows = base.select(
        "doc_id", "word_chars", "n_symbols", "n_caps", "n_marks", F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, F.expr(
            "transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))")).alias("hashes"))
    marked = windows.withColumn("ordered", F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.expr("array_sort(transform(hashes, (h, i) -> struct(h, i)))")))
    starts = marked.drop("hashes").withColumn("starts", F.expr(
        "array_sort(transform(filter(ordered, (x, k) -> (k > 0 AND ordered[k - 1].h = x.h) "
        "OR (k + 1 < size(ordered) AND ordered[k + 1].h = x.h)), x -> x.i))"))
    covered = F.expr("aggregate(starts, struct(0L AS n, -3 AS last), "
                     "(a, s) -> struct(a.n + least(3, s - a.last) AS n, s AS last), a -> a.n)")
    return starts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                         F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_caps", "n_marks")


def votes() -> list[Column]:
    """1 good, -1 bad, 0 abstain, per rule."""
    return [F.expr(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END") for good, bad in RULES.values()]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def posteriors(voted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """voted with a column votes -> (votes, posterior) per pattern, at most 3^rules rows."""
    patterns = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("t"))
    rules = range(len(RULES))

    def good(p, v):
        """Posterior of good for the votes v under the parameters p."""
        odds = [F.when(v[j] == 0, F.lit(0.0)).otherwise(v[j] * F.log(p["acc"][j] / (1 - p["acc"][j]))) for j in rules]
        return 1 / (1 + F.exp(-(F.log(p["prior"] / (1 - p["prior"])) + reduce(lambda a, b: a + b, odds))))

    def bounded(x, low, high):
        return F.least(F.greatest(x, F.lit(low)), F.lit(high))

    def gathered(p):
        """Expected counts under p in one pass over the patterns: n, good mass, then agreeing and voting mass per rule."""
        def add(a, x):
            v, n, q = x["votes"], x["n"], a["q"]
            agree = [a["agree"][j] + n * F.when(v[j] == 1, q).when(v[j] == -1, 1 - q).otherwise(0.0) for j in rules]
            cast = [a["cast"][j] + n * F.abs(v[j]) for j in rules]
            return F.struct((a["n"] + n).alias("n"), (a["good"] + n * q).alias("good"), q.alias("q"),
                            F.array(*agree).alias("agree"), F.array(*cast).alias("cast"))
        zeros = F.array(*[F.lit(0.0) for _ in rules])
        zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("good"), F.lit(0.0).alias("q"), zeros.alias("agree"), zeros.alias("cast"))
        # the posterior is set first, so that the sums read it as a value
        return F.aggregate("t", zero, lambda a, x: F.transform(F.array(a.withField("q", good(p, x["votes"]))), lambda y: add(y, x))[0])

    def step(p, _):
        def renewed(g):
            acc = [bounded((g["agree"][j] + 9) / (g["cast"][j] + 10), 0.55, 0.99) for j in rules]
            prior = bounded(g["good"] / F.greatest(g["n"], F.lit(1.0)), 0.05, 0.95)
            return F.struct(prior.alias("prior"), F.array(*acc).alias("acc"))
        return F.transform(F.array(gathered(p)), renewed)[0]

    start = F.struct(F.lit(PRIOR).alias("prior"), F.array(*[F.lit(START) for _ in rules]).alias("acc"))
    fitted = one.select("t", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("p"))
    return stage(fitted.select("p", F.explode("t").alias("x")).select(
        F.col("x.votes").alias("votes"), good(F.col("p"), F.col("x.votes")).alias("posterior")))


def judged(docs: DataFrame) -> DataFrame:
    """Counts, votes, posterior, base_failed and kept per document."""
    voted = stage(counted(docs).withColumn("votes", F.array(*votes())))
    # the pattern table is bounded by 3^rules rows, whatever the corpus
    return (voted.join(F.broadcast(posteriors(voted)), "votes")
            .withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)))


def quality_report(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                               "kept", F.round("posterior", 6).alias("posterior"))


def _em_sql() -> str:
    rules = list(range(1, len(RULES) + 1))
    parts, last = [], "p0"
    parts.append(f"p0 AS MATERIALIZED (SELECT {PRIOR}::DOUBLE AS prior, " + ", ".join(f"{START}::DOUBLE AS a{j}" for j in rules) + ")")
    odds = " + ".join(f"v{j} * ln(a{j} / (1 - a{j}))" for j in rules)
    q = f"1 / (1 + exp(-(ln(prior / (1 - prior)) + {odds})))"
    for k in range(1, ROUNDS + 1):
        accuracy = ", ".join(
            f"least(greatest((sum(n * CASE v{j} WHEN 1 THEN q WHEN -1 THEN 1 - q ELSE 0 END) + 9) / (sum(n * abs(v{j})) + 10), 0.55), 0.99) AS a{j}"
            for j in rules)
        parts.append(f"p{k} AS MATERIALIZED (SELECT least(greatest(sum(n * q) / sum(n), 0.05), 0.95) AS prior, {accuracy} "
                     f"FROM (SELECT t.*, {q} AS q FROM t, {last}))")
        last = f"p{k}"
    cases = ", ".join(f"CASE WHEN {g} THEN 1 WHEN {b} THEN -1 ELSE 0 END AS v{j}" for j, (g, b) in zip(rules, RULES.values()))
    names = ", ".join(f"v{j}" for j in rules)
    return f""", voted AS MATERIALIZED (SELECT *, {cases} FROM counts),
t AS MATERIALIZED (SELECT {names}, count(*)::DOUBLE AS n FROM voted GROUP BY ALL), {', '.join(parts)},
result AS (SELECT *, {q} AS posterior, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM voted, {last})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND posterior >= 0.5 AS kept, round(posterior, 6) AS posterior FROM result"""


SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS c
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM base)),
covered AS (SELECT r, count(DISTINCT j) AS c FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE c > 1) GROUP BY r),
counts AS MATERIALIZED (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.c, 0)::BIGINT AS n_repeat_words,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_caps,
    (length(text) - length(regexp_replace(text, '[!|]', '', 'g')))::BIGINT AS n_marks
  FROM base LEFT JOIN covered USING (r))""" + _em_sql()
