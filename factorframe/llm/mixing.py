"""Mixing sources to target weights by weighted random order (Efraimidis-Spirakis).

Every document draws the key -ln(u) / weight, where u is a hash of its id and weight its quality, so good documents tend to
come first. Within a source, whole epochs are taken first; what is left of the source's word budget goes to the first
documents by key, found by prefix sums. DataFrame functions only.

Prefix sums never sort a source in one task: words are summed per (source, key bucket) with a partial aggregate, the sums
are accumulated per source over its at most some 30 000 buckets, and only the one bucket where the budget ends is sorted.
The outcome is one cut (key, id) per source, so the decision for a document needs no join by document.

Defined cases: null text has no words and weight 1; a null source is a source, ranked last; documents of equal key and id
(repeated rows) are taken or left together; a document without words is never taken; texts of any length are counted whole; an empty table gives no rows; other
columns pass through `mix` untouched, except that its own output names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorframe.llm.shared import SPACES, WORD, stage, text_or_empty

CYCLE = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
NOISE = "#*$%&|<>!"
FINE = 1000  # key buckets per unit of ln(key)


def quality() -> Column:
    """1 for clean prose, down to 0.05 as noise characters take over the words."""
    text = text_or_empty()
    chars = F.length(F.translate(text, SPACES, ""))
    noise = F.length(text) - F.length(F.translate(text, NOISE, ""))
    return F.when(chars > 0, F.greatest(F.lit(0.05), 1 - 4 * noise / chars)).otherwise(1.0)


def drawn(docs: DataFrame, seed: str = "mix", weight: Column | None = None) -> DataFrame:
    """docs with size, sk (source that joins nulls), key and bucket."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return docs.withColumns({
        "size": F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long"),
        "sk": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
        "key": -F.log(u) / (quality() if weight is None else weight),
    }).withColumn("bucket", F.floor(FINE * F.log("key")).cast("int"))


def source_targets(slim: DataFrame, cycle=CYCLE, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: weight by rank, then water-filling under the caps.

    With sources sorted by cap / weight, level is what a unit of weight gets once the sources before are held at their caps;
    the right level is the largest one that the source at which it is computed can still take. The windows here see sources.
    """
    sources = slim.groupBy("sk").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    capped = ranked.select("*", F.element_at(weights, (F.col("rank") % len(cycle) + 1).cast("int")).alias("w"),
                           (cap * F.col("source_size")).alias("most"))
    everything, upto = Window.partitionBy(), Window.orderBy(F.col("most") / F.col("w"), "rank")
    level = ((share * F.sum("source_size").over(everything) - F.sum("most").over(upto) + F.col("most"))
             / (F.sum("w").over(everything) - F.sum("w").over(upto) + F.col("w")))
    leveled = capped.withColumn("level", level)
    reach = F.max(F.when(F.col("level") <= F.col("most") / F.col("w"), F.col("level"))).over(everything)
    target = F.when(reach.isNull(), F.col("most")).otherwise(F.least("most", reach * F.col("w")))
    return leveled.select("sk", "source_size", target.cast("double").alias("target"))


def mix_plan(slim: DataFrame, **options) -> DataFrame:
    """Per source: sk, source_size, target, epochs and the cut (cut_key, cut_id) of the fractional epoch; null for none."""
    goals = source_targets(slim, **options).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = stage(goals.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")))
    sums = slim.groupBy("sk", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("sk").orderBy("bucket")) - F.col("words")
    last = (sums.withColumn("before", before).join(goals.select("sk", "budget"), "sk").where("before < budget")
            .groupBy("sk").agg(F.max(F.struct("bucket", "before", "budget")).alias("x")).select("sk", "x.*"))
    tied = (slim.join(last, ["sk", "bucket"]).groupBy("sk", "key", F.col("doc_id").alias("id"))
            .agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("budget").alias("budget")))
    order = Window.partitionBy("sk").orderBy("key", F.col("id").asc_nulls_first())
    ahead = F.col("before") + F.sum("words").over(order) - F.col("words")
    # a document that crosses the budget is taken if that ends nearer to it
    taken = tied.withColumn("ahead", ahead).where(2 * F.col("ahead") + F.col("words") <= 2 * F.col("budget"))
    within = taken.groupBy("sk").agg(F.max(F.struct("key", "id")).alias("cut"))
    edge = last.select("sk", F.col("bucket").alias("cut_bucket"))
    return stage(goals.join(edge, "sk", "left").join(within, "sk", "left").select(
        "sk", "source_size", "target", "epochs", F.col("cut.key").alias("cut_key"), F.col("cut.id").alias("cut_id"), "cut_bucket"))


def decided(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs of `drawn` with source_size, target, copies (times the mix takes the document) and taken words."""
    low = F.lit(-(1 << 63)).cast("long")
    first = F.col("key") < F.col("cut_key")
    tie = (F.col("key") == F.col("cut_key")) & (F.coalesce("doc_id", low) <= F.coalesce("cut_id", low))
    # nothing of the last bucket taken: the cut is its lower edge
    picked = F.when(F.col("cut_key").isNotNull(), first | tie).otherwise(F.coalesce(F.col("bucket") < F.col("cut_bucket"), F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("epochs") + picked.cast("long")).otherwise(0)
    return docs.join(plan, "sk").withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mix_report(docs: DataFrame) -> DataFrame:
    """The mix as numbers: doc_id, size, source_size, target, taken."""
    slim = stage(drawn(docs).select("doc_id", "source", "size", "sk", "key", "bucket"))
    return decided(slim, mix_plan(slim)).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of docs as often as the plan takes it, columns unchanged."""
    plan = mix_plan(stage(drawn(docs).select("doc_id", "source", "size", "sk", "key", "bucket")))
    every = docs.columns
    inner = docs.select(F.struct(*[F.col(c) for c in every]).alias("row_"), "doc_id", "text", "source")
    many = decided(drawn(inner), plan).where("copies > 0").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return many.select(*[F.col("row_")[c].alias(c) for c in every])


# Words, keys and prefix sums in one window per source; the caps are filled in as many rounds as there are sources at most.
SQL = r"""
WITH drawn AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5) / 281474976710656.0) /
      CASE WHEN length(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0
        THEN greatest(0.05, 1 - 4.0 * (length(text) - length(translate(text, '#*$%&|<>!', '')))
          / length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))) ELSE 1.0 END AS key
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM drawn GROUP BY source),
ranked AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM sources),
leveled AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER below, 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER below, 0)) AS level
  FROM ranked WINDOW below AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, least(most, coalesce(max(CASE WHEN level <= most / w THEN level END) OVER () * w, most)) AS target
  FROM leveled),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM goals),
ordered AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS ahead
  FROM drawn d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
  CAST(size * (epochs + CASE WHEN 2 * ahead + size <= 2 * budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered
"""
