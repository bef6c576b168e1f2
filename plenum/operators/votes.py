"""Consensus voting: one document, one vote; coverage and agreement kept apart.

Every aggregate here has a map-side partial (count/min/percentile), so neither a hot document nor
a hot pointer is ever gathered into one task: rows shrink to distinct values, then buckets, then
one row per (document, pointer), then one row per pointer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions import values as V

# Status cut-offs, severity per status, the "too few speakers" limit.
COVERAGE_MOST = 0.75
COVERAGE_SOME = 0.40
AGREE_MOST = 0.90
AGREE_HALF = 0.50
WEAK_BELOW = 3
SEVERITY = {
    "normative": "error",
    "optional_consistent": "error-if-present",
    "contested": "warn",
    "variable": "info",
    "undecided": "off",
    "informational": "off",
}


def ballots(df: DataFrame, doc: Column, specs: list[tuple[str, str, Column]],
            corpus: Column | None = None, seq: Column | None = None) -> DataFrame:
    """wide rows to ``(corpus, doc, pointer, tag, num, str, rule)``; nulls have no opinion.

    ``specs`` is ``(pointer, tag, column)``; ``s``/``b``/``t`` tags fill ``str``, the rest ``num``.
    One generator over the scan: no shuffle, only the named columns are read. ``seq`` adds the place of a value in its document.
    """
    entries = []
    for pointer, tag, col in specs:
        textual = tag in ("s", "b", "t", "r")
        entries.append(F.struct(
            F.lit(pointer).alias("pointer"),
            F.lit(tag).alias("tag"),
            (F.lit(None) if textual else col).cast("double").alias("num"),
            (col if textual else F.lit(None)).cast("string").alias("str"),
            F.lit(None).cast("string").alias("rule"),
        ))
    corpus = F.lit("all") if corpus is None else corpus
    placed = [] if seq is None else [seq.alias("seq")]
    return (
        df.select(corpus.cast("string").alias("corpus"), doc.cast("string").alias("doc"), *placed,
                  F.inline(F.array(*entries)))
        .where("num is not null or str is not null")
    )


def bucketed(obs: DataFrame) -> DataFrame:
    """G1: add the vote bucket."""
    return obs.withColumn("bkey", V.bkey(*[F.col(c) for c in ("pointer", "tag", "num", "str", "rule")]))


# The list holds the distinct raw values of ONE bucket, whose width bounds it; the pick is the first
# value whose cumulative weight reaches half the total: a value somebody chose, never an average.
_LOW_MEDIAN = """aggregate(vals,
  named_struct('seen', 0L, 'num', cast(null as double), 'str', cast(null as string)),
  (a, x) -> if(a.seen * 2 >= n, a, named_struct('seen', a.seen + x.w, 'num', x.num, 'str', x.str)))"""


def bucket_counts(obs: DataFrame, by: list[str]) -> DataFrame:
    """Buckets per ``by`` with their size ``n`` and low-median member ``(num, str)``.

    Raw values are counted first (map-side), so bucket keys are built once per distinct value.
    """
    distinct = obs.groupBy(*by, "tag", "num", "str", "rule").agg(F.expr("count(1) as w"))
    return (
        bucketed(distinct)
        .groupBy(*by, "bkey", "tag")
        .agg(F.expr("sum(w) as n"), F.expr("collect_list(struct(num, str, rule, w)) as vals"))
        .withColumn("v", F.expr(
            "if(size(vals) = 1, named_struct('seen', n, 'num', vals[0].num, 'str', vals[0].str), "
            + _LOW_MEDIAN.replace("aggregate(vals", "aggregate(array_sort(vals)", 1) + ")"))
        .selectExpr(*by, "bkey", "tag", "n", "v.num as num", "v.str as str", "vals[0].rule as rule")
    )


def _modal(counts: DataFrame, by: list[str], total: str, top: str) -> DataFrame:
    """Largest bucket per ``by``; ties go to the smallest key. min over a struct, never a window."""
    return (
        counts.groupBy(*by)
        .agg(F.expr(f"sum(n) as {total}"), F.expr("min(struct(-n as neg, bkey, tag, num, str, rule)) as m"))
        .selectExpr(*by, "m.bkey", "m.tag", "m.num", "m.str", "m.rule", total, f"-m.neg as {top}")
    )


def document_votes(obs: DataFrame) -> DataFrame:
    """Each document's own verdict per pointer, with its internal agreement."""
    by = ["corpus", "doc", "pointer"]
    return _modal(bucket_counts(obs, by), by, "observations", "modal_observations").withColumn(
        "internal_agreement", F.col("modal_observations") / F.col("observations"))


def document_buckets(df: DataFrame, doc: Column, specs: list[tuple[str, str, Column]]) -> DataFrame:
    """G2 where only the bucket of each verdict is asked for: ``(doc, pointer, bkey, tag)``, as ``document_votes`` finds it.

    Most values of a document differ, so counting ballots where they are read saves nothing and holds (or spills) nearly
    all of them. Rows are therefore brought together by document while they are still narrow, and become ballots after
    that; a document with very many rows is dealt over several tasks, whose counts are added up.
    """
    narrow = df.select(doc.cast("string").alias("doc"), *[col.alias(f"_v{i}") for i, (_, _, col) in enumerate(specs)])
    near = narrow.withColumn("_h", F.xxhash64("doc")).hint("rebalance", "_h").drop("_h")
    obs = ballots(near, F.col("doc"), [(pointer, tag, F.col(f"_v{i}")) for i, (pointer, tag, _) in enumerate(specs)])
    counts = bucketed(obs).groupBy("doc", "pointer", "bkey", "tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("doc", "pointer").agg(F.min(F.struct((-F.col("n")).alias("neg"), "bkey", "tag")).alias("m")).select(
        "doc", "pointer", "m.bkey", "m.tag")


def single_values(obs: DataFrame) -> DataFrame:
    """F8: one value per document and pointer: the first, in sequence, of the modal bucket. ``obs`` has ``seq``."""
    by = ["corpus", "doc", "pointer"]
    first = bucketed(obs).groupBy(*by, "bkey").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "num", "str")).alias("v"))
    return first.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("bkey"), F.col("v"))).alias("m")).select(
        *by, F.col("m.bkey").alias("bkey"), F.col("m.v.num").alias("num"), F.col("m.v.str").alias("str"))


def corpus_sizes(docs: DataFrame) -> DataFrame:
    """Documents per corpus, from the document list (silent documents count)."""
    return docs.select("corpus", "doc").distinct().groupBy("corpus").agg(
        F.count(F.lit(1)).alias("n_docs"))


def status_of(coverage: Column, agreement: Column) -> Column:
    """G5."""
    return (
        F.when((coverage >= COVERAGE_MOST) & (agreement >= AGREE_MOST), "normative")
        .when((coverage >= COVERAGE_MOST) & (agreement >= AGREE_HALF), "contested")
        .when(coverage >= COVERAGE_MOST, "undecided")
        .when((coverage >= COVERAGE_SOME) & (agreement >= AGREE_MOST), "optional_consistent")
        .when(coverage >= COVERAGE_SOME, "variable")
        .otherwise("informational")
    )


def severity_of(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, level in SEVERITY.items():
        out = F.when(status == name, level).otherwise(out)
    return out


def support(doc_votes: DataFrame) -> DataFrame:
    """Documents behind each bucket of each pointer, with the representative value."""
    one = doc_votes.select("corpus", "pointer", "tag", "num", "str", "rule")
    return bucket_counts(one, ["corpus", "pointer"])


def votes(doc_votes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Modal bucket over documents, coverage, agreement, status, severity."""
    return _judged(_modal(support(doc_votes), ["corpus", "pointer"], "observed_in", "modal_count"), sizes)


def bucket_votes(doc_buckets: DataFrame, sizes: DataFrame) -> DataFrame:
    """G3-G5 from the buckets of the documents' verdicts alone: as ``votes``, without the representative values."""
    counts = doc_buckets.groupBy("corpus", "pointer", "bkey", "tag").agg(F.count(F.lit(1)).alias("n"))
    modal = counts.groupBy("corpus", "pointer").agg(
        F.sum("n").alias("observed_in"), F.min(F.struct((-F.col("n")).alias("neg"), "bkey", "tag")).alias("m")).select(
        "corpus", "pointer", "m.bkey", "m.tag", "observed_in", (-F.col("m.neg")).alias("modal_count"))
    return _judged(modal, sizes)


def _judged(modal: DataFrame, sizes: DataFrame) -> DataFrame:
    status = status_of(F.col("coverage"), F.col("agreement"))
    return (
        modal.join(sizes, "corpus")
        .withColumn("coverage", F.col("observed_in") / F.col("n_docs"))
        .withColumn("agreement", F.col("modal_count") / F.col("observed_in"))
        .withColumn("status", status)
        .withColumn("severity", severity_of(F.col("status")))
        .withColumn("in_donor", F.col("status") != "informational")
        .withColumn("needs_review", F.col("status").isin("undecided", "contested"))
        .withColumn("weak", F.col("observed_in") < WEAK_BELOW)
    )


def vote_all(obs: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Every pointer of every corpus in one job."""
    docs = obs if docs is None else docs
    return votes(document_votes(obs), corpus_sizes(docs))


def alternatives(doc_votes: DataFrame, voted: DataFrame) -> DataFrame:
    """The losing buckets of each pointer with their support ``n``; readers order by (-n, bkey)."""
    counts = support(doc_votes)
    modal = voted.select("corpus", "pointer", F.col("bkey").alias("modal_bkey"))
    return (
        counts.join(modal, ["corpus", "pointer"]).where("bkey <> modal_bkey")
        .select("corpus", "pointer", "bkey", "n", V.shown(F.col("num"), F.col("str")).alias("value"))
    )


def stances(doc_votes: DataFrame, voted: DataFrame) -> DataFrame:
    """Who agreed and who dissented, one row per (pointer, document)."""
    modal = voted.select("corpus", "pointer", F.col("bkey").alias("modal_bkey"))
    return doc_votes.join(modal, ["corpus", "pointer"]).select(
        "corpus", "pointer", "doc",
        F.when(F.col("bkey") == F.col("modal_bkey"), "agreeing").otherwise("dissenting").alias("stance"))


def silent(doc_votes: DataFrame, docs: DataFrame, pointers_per_chunk: int = 10_000) -> DataFrame:
    """Documents with no opinion on a pointer others spoke about.

    The pointer list of a corpus is cut into arrays of bounded length; a document meets each array
    by an equi-join on (corpus, chunk) and drops what it said by a left-anti join.
    """
    pointers = doc_votes.select("corpus", "pointer").distinct()
    hashed = F.pmod(F.xxhash64("pointer"), F.col("n_chunks"))
    per = pointers.groupBy("corpus").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(pointers_per_chunk)).cast("bigint").alias("n_chunks"))
    lists = (
        pointers.join(per, "corpus").withColumn("chunk", hashed)
        .groupBy("corpus", "chunk").agg(F.collect_list("pointer").alias("pointers"))
    )
    spread = (
        docs.select("corpus", "doc").distinct().join(per, "corpus")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_chunks") - 1)))
        .drop("n_chunks")
    )
    every = spread.join(lists, ["corpus", "chunk"]).select(
        "corpus", "doc", F.explode("pointers").alias("pointer"))
    return every.join(doc_votes, ["corpus", "doc", "pointer"], "left_anti")


def percent(c: Column) -> Column:
    """``0.916`` to ``92%``: whole percent, ties to even."""
    return F.concat(F.rint(c * 100).cast("bigint").cast("string"), F.lit("%"))


def explain(voted: DataFrame) -> DataFrame:
    """The one-line account of each vote."""
    weak = F.when(F.col("weak"), " (weak: fewer than 3 observations)").otherwise("")
    line = F.concat(
        F.col("pointer"), F.lit(" = "), V.shown(F.col("num"), F.col("str")),
        F.lit("  ["), F.col("status"), F.lit("; "), percent(F.col("coverage")), F.lit(" coverage, "),
        percent(F.col("agreement")), F.lit(" agreement; "), F.col("modal_count").cast("string"),
        F.lit("/"), F.col("observed_in").cast("string"), F.lit(" of "),
        F.col("n_docs").cast("string"), F.lit(" documents]"), weak)
    return voted.select("corpus", "pointer", line.alias("line"))


def disagreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pointers both vote sets know, with different modal buckets."""
    return (
        a.select("pointer", F.col("bkey").alias("bkey_a"))
        .join(b.select("pointer", F.col("bkey").alias("bkey_b")), "pointer")
        .where("bkey_a <> bkey_b")
    )
