"""Mixing sources to target weights by temperature.

The token shares ``p`` of the sources are raised to an exponent and normalised, ``w = p^a / sum p^a``.
Entropy falls and the repetition of small sources falls as ``a`` grows from 0 to 1, so both wishes are
met by bisection: the greatest ``a`` whose mixture has the wanted share of the greatest possible entropy,
unless some source would then be repeated more often than ``max_repeats`` allows; in that case the least
``a`` that keeps to the limit. (Where even ``a = 1`` repeats too often, because the budget is too large
for the corpus, ``a`` is 1.)

The weights are realised within a token budget. Each source gets ``floor(budget * w)`` tokens: whole
passes over the source, then a part of one more pass. A pass runs over hash blocks of about
``block_tokens`` tokens in an order drawn from the seed, and over the documents of a block in a drawn
order; the part takes documents as long as the sum stays within what is left. Only one row per block is
summed along a source, and only the one block of each source where the budget ends is ordered by
document, so a source that holds a third of the corpus spreads over all its blocks.

A document costs its words plus one for the end mark, so no document is free. Source totals stay in
Spark; each bisection job adds them up for fifteen exponents at once (four halvings), and only those
sums reach the driver.

Defined cases: a null source is the source named ``''``; null and empty texts cost one token; repeated
rows are drawn one by one, adjacent in the drawn order; sources of equal size get equal weights; a
corpus of one source keeps weight 1 for it; an empty table gives an empty result; other columns are
kept by ``resample`` and not read by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenum.llm.common import documents, fresh, settle, with_rows

NAME = "op5_temperature_mix"
ORACLE = None  # the exponent is the fixed point of a search
ENTROPY_SHARE = 0.995
MAX_REPEATS = 4.0
BLOCK_TOKENS = 1 << 20
SEED = 17
HALVINGS, ROUNDS = 4, 10


def token_cost(text) -> F.Column:
    """Words of the text (runs without ASCII white space) and one end mark."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    return (words + 1).cast("long")


def costs(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Written table ``(row, doc_id, source, tokens)``: all that mixing needs to know of a document.

    ``row`` names the column that numbers the rows; without it they get numbers that hold for this table.
    """
    if row is None:
        row, docs = "row", with_rows(docs.select("doc_id", "source", "text"), "row")
    return settle(docs.select(
        F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), token_cost(F.col("text").cast("string")).alias("tokens")))


def _search(sums, low: float, high: float, keep_low) -> float:
    """Bisection of an exponent; ``sums`` measures a list of exponents in one job."""
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / 2 ** HALVINGS for i in range(1, 2 ** HALVINGS)]
        marks = [keep_low(m) for m in sums(points)]
        at = [low, *points, high]
        left, right = 0, len(at) - 1
        while right - left > 1:
            middle = (left + right) // 2
            left, right = (middle, right) if marks[middle - 1] else (left, middle)
        low, high = at[left], at[right]
    return low


def exponent(totals: DataFrame, budget: float, entropy_share: float, max_repeats: float) -> float:
    """Exponent for ``totals(source, tokens)``, rounded to nine digits so that sums in another order agree."""
    n, total, least = totals.agg(F.count(F.lit(1)), F.sum("tokens"), F.min("tokens")).first()
    if n < 2:
        return 1.0
    log_p = F.log(F.col("tokens") / F.lit(float(total)))

    def measure(points):
        parts = []
        for i, a in enumerate(points):
            parts += [F.sum(F.exp(log_p * a)).alias(f"z{i}"), F.sum(F.exp(log_p * a) * log_p * a).alias(f"h{i}")]
        row = totals.agg(*parts).first()
        # entropy and the repetition of the smallest source, which is repeated most for a <= 1
        return [(math.log(row[f"z{i}"]) - row[f"h{i}"] / row[f"z{i}"],
                 budget / least * math.exp(a * math.log(least / total)) / row[f"z{i}"]) for i, a in enumerate(points)]

    by_entropy = _search(measure, 0.0, 1.0, lambda m: m[0] >= entropy_share * math.log(n))
    if measure([1.0])[0][0] >= entropy_share * math.log(n):
        by_entropy = 1.0
    if measure([by_entropy])[0][1] <= max_repeats:
        return round(by_entropy, 9)
    if measure([1.0])[0][1] > max_repeats:
        return 1.0
    return min(1.0, round(_search(measure, by_entropy, 1.0, lambda m: m[1] > max_repeats) + 5e-10, 9))


def weights(rows: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """Written table ``(source, total, weight, target)`` of ``rows(source, tokens)``; the budget defaults to all tokens."""
    totals = settle(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    a = exponent(totals, float(budget), entropy_share, max_repeats)
    raw = totals.withColumn("raw", F.pow(F.col("tokens") / F.lit(float(max(1, total))), F.lit(a)))
    z = raw.agg(F.sum("raw")).first()[0] or 1.0
    weight = F.round(F.col("raw") / F.lit(z), 12)
    return settle(raw.select("source", F.col("tokens").alias("total"), weight.alias("weight"), F.floor(weight * F.lit(float(budget))).cast("long").alias("target")))


def draw(rows: DataFrame, plan: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """``(row, doc_id, source, tokens, weight, target, copies)`` for ``costs`` rows and a ``weights`` plan."""
    blocks = F.ceil(F.col("total") / F.lit(float(block_tokens)))
    placed = rows.join(plan, "source").select(
        "*", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), blocks).alias("block"),
        F.floor(F.col("target") / F.col("total")).alias("whole"), F.pmod(F.col("target"), F.col("total")).alias("rest"))
    sums = placed.groupBy("source", "block").agg(F.sum("tokens").alias("held"), F.first("rest").alias("rest"))
    along = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "source", "block"), "block").rowsBetween(Window.unboundedPreceding, 0)
    fate = settle(sums.withColumn("upto", F.sum("held").over(along)).select(
        "source", "block", F.when(F.col("upto") <= F.col("rest"), "in").when(F.col("upto") - F.col("held") >= F.col("rest"), "out").otherwise("cut").alias("fate"),
        (F.col("rest") - F.col("upto") + F.col("held")).alias("room")))
    placed = placed.join(fate, ["source", "block"])
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    out = ["row", "doc_id", "source", "tokens", "weight", "target"]
    cut = placed.where("fate = 'cut'").withColumn("upto", F.sum("tokens").over(inside)).select(
        *out, (F.col("whole") + (F.col("upto") <= F.col("room")).cast("long")).alias("copies"))
    even = placed.where("fate <> 'cut'").select(*out, (F.col("whole") + (F.col("fate") == "in").cast("long")).alias("copies"))
    return even.unionByName(cut)


def mix(docs: DataFrame, budget: int | None = None, row: str | None = None, **options) -> DataFrame:
    """How often each row of ``docs`` is drawn."""
    rows = costs(docs, row)
    return draw(rows, weights(rows, budget, **options))


def resample(docs: DataFrame, budget: int | None = None, **options) -> DataFrame:
    """``docs``, with its columns, every row as often as the mixture draws it."""
    row, n = fresh(docs, "row_no"), fresh(docs, "copies_no")
    rows = with_rows(docs, row)
    times = mix(rows, budget, row, **options).where("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(n))
    joined = rows.join(times, row)
    return joined.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("row")
