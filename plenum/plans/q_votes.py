"""Ballots and consensus votes over ordinary tables (one supplier, user or nation = one document)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import values as V
from plenum.operators import votes as O
from plenum.plans import sqlparts as S
from plenum.plans.registry import query, table

# (pointer, tag, expression): the expression is valid in Spark SQL and DuckDB alike
LINEITEM = [
    ("/lineitem/returnflag", "s", "l_returnflag"),
    ("/lineitem/linestatus", "s", "l_linestatus"),
    ("/lineitem/discount", "n", "l_discount"),
    ("/lineitem/quantity", "sz", "l_quantity"),
    ("/lineitem/price/width", "len", "floor(l_extendedprice / 10)"),
]
ORDERS = [
    ("/orders/status", "s", "o_orderstatus"),
    ("/orders/priority", "s", "o_orderpriority"),
    ("/orders/total/width", "len", "floor(o_totalprice / 100)"),
]
DOCS = [
    ("/document/lang", "s", "lang"),
    ("/document/page/height", "len", "n_chars"),
    ("/document/long", "b", "CASE WHEN n_chars > 2000 THEN 'true' ELSE 'false' END"),
]


def spark_specs(specs):
    return [(p, t, F.expr(e)) for p, t, e in specs]


def lineitem_ballots(spark, sf):
    return O.ballots(table(spark, sf, "lineitem"), F.col("l_suppkey"), spark_specs(LINEITEM))


def supplier_docs(spark, sf):
    """The document list is the supplier table, so a supplier that ships nothing is still counted."""
    return table(spark, sf, "supplier").select(F.lit("all").alias("corpus"),
                                               F.col("s_suppkey").cast("string").alias("doc"))


def lineitem_votes(spark, sf):
    obs = lineitem_ballots(spark, sf)
    return O.vote_all(obs, supplier_docs(spark, sf))


OBS = f"obs AS ({S.ballots('lineitem', 'l_suppkey', LINEITEM)})"
DOC_LIST = "SELECT 'all' AS corpus, CAST(s_suppkey AS VARCHAR) AS doc FROM supplier"
DV_SQL = f"WITH {OBS},{S.doc_votes()}"
VOTES_SQL = f"WITH {OBS},{S.votes(DOC_LIST)}"


@query("f1_ballots", f"""WITH {OBS}
SELECT pointer, tag, count(*) AS n, count(DISTINCT doc) AS docs, round(sum(num), 2) AS total,
       min(str) AS lo, max(str) AS hi FROM obs GROUP BY ALL""")
def f1(spark, sf):
    return lineitem_ballots(spark, sf).groupBy("pointer", "tag").agg(
        F.count("*").alias("n"), F.countDistinct("doc").alias("docs"),
        F.round(F.sum("num"), 2).alias("total"), F.min("str").alias("lo"), F.max("str").alias("hi"))


@query("g1_buckets", f"""WITH {OBS}, bk AS (SELECT *, {S.BKEY} AS bkey FROM obs)
SELECT pointer, bkey, count(*) AS n FROM bk GROUP BY ALL""")
def g1(spark, sf):
    return O.bucketed(lineitem_ballots(spark, sf)).groupBy("pointer", "bkey").agg(F.count("*").alias("n"))


@query("g2_document_votes", DV_SQL + """
SELECT doc, pointer, bkey, round(num, 6) AS num, str, observations, modal_observations,
       round(internal_agreement, 6) AS internal_agreement FROM dv""")
def g2(spark, sf):
    return O.document_votes(lineitem_ballots(spark, sf)).select(
        "doc", "pointer", "bkey", F.round("num", 6).alias("num"), "str", "observations",
        "modal_observations", F.round("internal_agreement", 6).alias("internal_agreement"))


_SEQ_BALLOTS = S.ballots("lineitem", "l_suppkey", LINEITEM).replace("SELECT 'all' AS corpus", "SELECT l_orderkey * 10 + l_linenumber AS seq, 'all' AS corpus")


@query("f8_single_value", f"""WITH o AS ({_SEQ_BALLOTS}), k AS (SELECT *, {S.BKEY} AS bkey FROM o),
c AS (SELECT doc, pointer, bkey, count(*) AS n FROM k GROUP BY ALL),
m AS (SELECT doc, pointer, bkey FROM c QUALIFY row_number() OVER (PARTITION BY doc, pointer ORDER BY n DESC, bkey) = 1)
SELECT doc, pointer, coalesce(str, {S.num_text('num')}) AS value FROM k SEMI JOIN m USING (doc, pointer, bkey)
QUALIFY row_number() OVER (PARTITION BY doc, pointer ORDER BY seq) = 1""")
def f8(spark, sf):
    obs = O.ballots(table(spark, sf, "lineitem"), F.col("l_suppkey"), spark_specs(LINEITEM), seq=F.expr("l_orderkey * 10 + l_linenumber"))
    return O.single_values(obs).select("doc", "pointer", V.shown(F.col("num"), F.col("str")).alias("value"))


VOTE_COLS = ["pointer", "bkey", "observed_in", "modal_count", "n_docs", "status", "severity",
             "in_donor", "needs_review", "weak"]


def vote_view(v):
    return v.select(*VOTE_COLS, V.shown(F.col("num"), F.col("str")).alias("value"),
                    F.round("coverage", 6).alias("coverage"), F.round("agreement", 6).alias("agreement"))


VOTE_VIEW_SQL = f"""SELECT {', '.join(VOTE_COLS)}, coalesce(str, {S.num_text('num')}) AS value,
 round(coverage, 6) AS coverage, round(agreement, 6) AS agreement FROM votes"""


@query("g3_corpus_votes", VOTES_SQL + VOTE_VIEW_SQL)
def g3(spark, sf):
    return vote_view(lineitem_votes(spark, sf))


@query("g4_coverage_agreement", VOTES_SQL + """
SELECT pointer, n_docs, observed_in, round(coverage, 6) AS coverage, round(agreement, 6) AS agreement, weak
FROM votes""")
def g4(spark, sf):
    return lineitem_votes(spark, sf).select(
        "pointer", "n_docs", "observed_in", F.round("coverage", 6).alias("coverage"),
        F.round("agreement", 6).alias("agreement"), "weak")


# one corpus per nation of the supplier: every status occurs
NATION_OBS = "obs AS (" + S.ballots(
    "lineitem JOIN supplier ON l_suppkey = s_suppkey", "l_suppkey", LINEITEM,
    "CAST(s_nationkey AS VARCHAR)") + ")"
NATION_DOCS = "SELECT CAST(s_nationkey AS VARCHAR) AS corpus, CAST(s_suppkey AS VARCHAR) AS doc FROM supplier"


def nation_ballots(spark, sf):
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    rows = table(spark, sf, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return O.ballots(rows, F.col("l_suppkey"), spark_specs(LINEITEM), F.col("s_nationkey"))


def nation_buckets(spark, sf):
    """The bucket of each supplier's verdict per pointer; the nation joins the verdicts, not the line items."""
    of = nation_docs(spark, sf).where("doc is not null").distinct()
    return O.document_buckets(table(spark, sf, "lineitem"), F.col("l_suppkey"), spark_specs(LINEITEM)).join(of, "doc")


def nation_docs(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("corpus"),
                                               F.col("s_suppkey").cast("string").alias("doc"))


@query("g5_status_severity", f"""WITH {NATION_OBS},{S.votes(NATION_DOCS)}
SELECT status, severity, in_donor, needs_review, count(*) AS n FROM votes GROUP BY ALL""")
def g5(spark, sf):
    v = O.vote_all(nation_ballots(spark, sf), nation_docs(spark, sf))
    return v.groupBy("status", "severity", "in_donor", "needs_review").agg(F.count("*").alias("n"))


@query("g6_alternatives", VOTES_SQL + f"""
SELECT sup.pointer, sup.bkey, sup.n, coalesce(sup.str, {S.num_text('sup.num')}) AS value
FROM sup JOIN votes USING (corpus, pointer) WHERE sup.bkey <> votes.bkey""")
def g6(spark, sf):
    dv = O.document_votes(lineitem_ballots(spark, sf))
    v = O.votes(dv, O.corpus_sizes(supplier_docs(spark, sf)))
    return O.alternatives(dv, v).select("pointer", "bkey", "n", "value")


@query("g6_stances", VOTES_SQL + """
SELECT dv.pointer, dv.doc, CASE WHEN dv.bkey = votes.bkey THEN 'agreeing' ELSE 'dissenting' END AS stance
FROM dv JOIN votes USING (corpus, pointer)""")
def g6_stances(spark, sf):
    dv = O.document_votes(lineitem_ballots(spark, sf))
    v = O.votes(dv, O.corpus_sizes(supplier_docs(spark, sf)))
    return O.stances(dv, v).select("pointer", "doc", "stance")


# customers as documents; a customer without an order of some status is silent on its pointer
STATUS_SPECS = [(f"/orders/{s}/priority", "s", f"CASE WHEN o_orderstatus = '{s}' THEN o_orderpriority END")
                for s in ("F", "O", "P")]


@query("g6_silent", f"""WITH obs AS ({S.ballots('orders', 'o_custkey', STATUS_SPECS)}),
p AS (SELECT DISTINCT pointer FROM obs)
SELECT CAST(c_custkey AS VARCHAR) AS doc, pointer FROM customer CROSS JOIN p
WHERE NOT EXISTS (SELECT 1 FROM obs WHERE obs.doc = CAST(c_custkey AS VARCHAR) AND obs.pointer = p.pointer)""")
def g6_silent(spark, sf):
    obs = O.ballots(table(spark, sf, "orders"), F.col("o_custkey"), spark_specs(STATUS_SPECS))
    docs = table(spark, sf, "customer").select(F.lit("all").alias("corpus"),
                                               F.col("c_custkey").cast("string").alias("doc"))
    return O.silent(O.document_votes(obs), docs).select("doc", "pointer")


@query("g7_explain", VOTES_SQL + f"""
SELECT pointer, pointer || ' = ' || coalesce(str, {S.num_text('num')}) || '  [' || status || '; '
 || CAST(CAST(round_even(coverage * 100, 0) AS BIGINT) AS VARCHAR) || '% coverage, '
 || CAST(CAST(round_even(agreement * 100, 0) AS BIGINT) AS VARCHAR) || '% agreement; '
 || CAST(modal_count AS VARCHAR) || '/' || CAST(observed_in AS VARCHAR) || ' of ' || CAST(n_docs AS VARCHAR)
 || ' documents]' || CASE WHEN weak THEN ' (weak: fewer than 3 observations)' ELSE '' END AS line FROM votes""")
def g7(spark, sf):
    return O.explain(lineitem_votes(spark, sf)).select("pointer", "line")


def year_votes(spark, sf, early: bool):
    rows = table(spark, sf, "orders").where(F.year("o_orderdate") < 1998 if early else F.year("o_orderdate") >= 1998)
    return O.vote_all(O.ballots(rows, F.col("o_custkey"), spark_specs(ORDERS)))


def _year_sql(cond: str) -> str:
    obs = S.ballots(f"(SELECT * FROM orders WHERE year(o_orderdate) {cond})", "o_custkey", ORDERS)
    return f"(WITH obs AS ({obs}),{S.votes('SELECT corpus, doc FROM obs')} SELECT pointer, bkey FROM votes)"


@query("g8_drift", f"""SELECT a.pointer, a.bkey AS bkey_a, b.bkey AS bkey_b
FROM {_year_sql('< 1998')} a JOIN {_year_sql('>= 1998')} b USING (pointer) WHERE a.bkey <> b.bkey""")
def g8(spark, sf):
    return O.disagreement(year_votes(spark, sf, True), year_votes(spark, sf, False))


SOURCE_OBS = f"obs AS ({S.ballots('documents', 'doc_id', DOCS, 'source')})"


def source_ballots(spark, sf):
    return O.ballots(table(spark, sf, "documents"), F.col("doc_id"), spark_specs(DOCS), F.col("source"))


@query("g9_votes_by_corpus", f"""WITH {SOURCE_OBS},{S.votes('SELECT source AS corpus, doc_id AS doc FROM documents')}
{VOTE_VIEW_SQL.replace('SELECT ', 'SELECT corpus, ', 1)}""")
def g9(spark, sf):
    v = O.vote_all(source_ballots(spark, sf))
    return v.select("corpus", *VOTE_COLS, V.shown(F.col("num"), F.col("str")).alias("value"),
                    F.round("coverage", 6).alias("coverage"), F.round("agreement", 6).alias("agreement"))
