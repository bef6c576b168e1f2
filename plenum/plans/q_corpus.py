"""Corpus judgement: nations as documents described by their customers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import values as V
from plenum.operators import corpus as C
from plenum.operators import votes as O
from plenum.plans import sqlparts as S
from plenum.plans.q_votes import (NATION_DOCS, NATION_OBS, nation_buckets, nation_docs, spark_specs,
                                  VOTES_SQL, lineitem_ballots, supplier_docs)
from plenum.plans.registry import query, table
from plenum.skew import settle

CUSTOMER = [
    ("/customer/segment", "s", "c_mktsegment"),
    ("/customer/balance", "s", "CASE WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END"),
]
SUPPLIER = [("/supplier/balance", "s", "CASE WHEN s_acctbal < 5000 THEN 'low' ELSE 'high' END")]
ORDER = [("/order/priority", "s", "o_orderpriority"), ("/order/status", "s", "o_orderstatus")]

PROFILE_OBS = "obs AS (" + "\nUNION ALL ".join([
    S.ballots("customer", "c_nationkey", CUSTOMER), S.ballots("supplier", "s_nationkey", SUPPLIER),
    S.ballots("orders JOIN customer ON o_custkey = c_custkey", "c_nationkey", ORDER)]) + ")"


def nation_profiles(spark, sf):
    cust = table(spark, sf, "customer")
    orders = table(spark, sf, "orders").join(
        cust.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        O.ballots(cust, F.col("c_nationkey"), spark_specs(CUSTOMER))
        .unionByName(O.ballots(table(spark, sf, "supplier"), F.col("s_nationkey"), spark_specs(SUPPLIER)))
        .unionByName(O.ballots(orders, F.col("c_nationkey"), spark_specs(ORDER)))
    )


AGREE_SQL = """, agr AS (
 SELECT d.corpus, d.doc, coalesce(avg(CASE WHEN dv.bkey = votes.bkey THEN 1.0 WHEN dv.bkey IS NOT NULL THEN 0.0 END), 1.0) AS agreement
 FROM (SELECT DISTINCT corpus, doc FROM ({docs})) d LEFT JOIN dv USING (corpus, doc)
 LEFT JOIN votes ON votes.corpus = dv.corpus AND votes.pointer = dv.pointer GROUP BY ALL)"""
H_SQL = f"WITH {NATION_OBS},{S.votes(NATION_DOCS)}" + AGREE_SQL.format(docs=NATION_DOCS)


def judged(spark, sf):
    docs = nation_docs(spark, sf)
    dv = settle(nation_buckets(spark, sf))  # read by the votes and by every document's agreement
    v = O.bucket_votes(dv, O.corpus_sizes(docs))
    return docs, dv, v, C.agreement_by_document(dv, v, docs)


@query("h1_agreement_by_document", H_SQL + " SELECT corpus, doc, round(agreement, 6) AS agreement FROM agr")
def h1(spark, sf):
    return judged(spark, sf)[3].select("corpus", "doc", F.round("agreement", 6).alias("agreement"))


@query("h2_outliers", H_SQL + " SELECT corpus, doc, round(agreement, 6) AS agreement FROM agr WHERE agreement < 0.6")
def h2(spark, sf):
    return C.outliers(judged(spark, sf)[3]).select("corpus", "doc", F.round("agreement", 6).alias("agreement"))


SPLIT_CTES = """
prof AS (SELECT corpus, doc, string_agg(pointer || '=' || bkey, '|' ORDER BY pointer) AS p FROM dv GROUP BY ALL),
vec AS (SELECT corpus, min(doc) AS vector, count(*) AS members FROM prof GROUP BY corpus, p),
met AS (SELECT x.corpus, x.doc AS a, y.doc AS b, avg(CASE WHEN x.bkey <> y.bkey THEN 1.0 ELSE 0.0 END) AS distance
  FROM dv x JOIN dv y USING (corpus, pointer) JOIN vec va ON va.corpus = x.corpus AND va.vector = x.doc JOIN vec vb ON vb.corpus = x.corpus AND vb.vector = y.doc WHERE x.doc < y.doc GROUP BY ALL),
dist AS (SELECT a.corpus, a.vector AS a, b.vector AS b, coalesce(distance, 1.0) AS distance
  FROM vec a JOIN vec b ON a.corpus = b.corpus AND a.vector < b.vector LEFT JOIN met ON met.corpus = a.corpus AND met.a = a.vector AND met.b = b.vector),
full_d AS (SELECT corpus, a, b, distance FROM dist UNION ALL SELECT corpus, b, a, distance FROM dist
  UNION ALL SELECT corpus, vector, vector, 0.0 FROM vec),
cost AS (SELECT m.corpus, m.a, m.b, round(sum(least(da.distance, db.distance) * vec.members), 9) AS cost
  FROM dist m JOIN full_d da ON da.corpus = m.corpus AND da.b = m.a JOIN full_d db ON db.corpus = m.corpus AND db.b = m.b AND db.a = da.a
  JOIN vec ON vec.corpus = m.corpus AND vec.vector = da.a GROUP BY ALL),
best AS (SELECT corpus, a AS medoid_a, b AS medoid_b FROM cost QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY cost, a, b) = 1),
side AS (SELECT best.corpus, vec.vector, vec.members, da.distance <= db.distance AS in_a FROM best
  JOIN full_d da ON da.corpus = best.corpus AND da.b = medoid_a JOIN full_d db ON db.corpus = best.corpus AND db.b = medoid_b AND db.a = da.a JOIN vec ON vec.corpus = best.corpus AND vec.vector = da.a),
pr AS (SELECT d.corpus, x.in_a = y.in_a AS same, d.distance, x.members * y.members AS w
  FROM dist d JOIN side x ON x.corpus = d.corpus AND x.vector = d.a JOIN side y ON y.corpus = d.corpus AND y.vector = d.b
  UNION ALL SELECT corpus, true, 0.0, members * (members - 1) / 2 FROM side WHERE members > 1),
stat AS (SELECT corpus, coalesce(sum(CASE WHEN same THEN distance * w END) / sum(CASE WHEN same THEN w END), 0.0) AS mw,
  coalesce(sum(CASE WHEN NOT same THEN distance * w END) / sum(CASE WHEN NOT same THEN w END), 0.0) AS mb FROM pr GROUP BY corpus),
two AS (SELECT corpus, medoid_a, medoid_b, CAST(size_a AS BIGINT) AS size_a, CAST(size_b AS BIGINT) AS size_b,
  CASE WHEN mw > 0 THEN mb / mw WHEN mb > 0 THEN 'inf'::DOUBLE ELSE 0.0 END AS strength
  FROM best JOIN stat USING (corpus) JOIN (SELECT corpus, sum(CASE WHEN in_a THEN members ELSE 0 END) AS size_a, sum(CASE WHEN in_a THEN 0 ELSE members END) AS size_b FROM side GROUP BY corpus) USING (corpus)),
splits AS (SELECT *, size_a >= 2 AND size_b >= 2 AND size_a + size_b >= 4 AND strength >= 1.5 AS is_split FROM two)
"""
DIST_SQL = f"WITH {PROFILE_OBS},{S.doc_votes()}," + SPLIT_CTES


@query("h3_distance_matrix", DIST_SQL + "SELECT a, b, round(distance, 6) AS distance FROM dist")
def h3(spark, sf):
    vectors = C.vote_vectors(O.document_votes(nation_profiles(spark, sf)))
    return C.distances(vectors).select("a", "b", F.round("distance", 6).alias("distance"))


@query("h4_split", f"WITH {NATION_OBS},{S.doc_votes()},{SPLIT_CTES} SELECT corpus, medoid_a, medoid_b, size_a, size_b, CASE WHEN strength < 1e300 THEN round(strength, 6) END AS strength, is_split FROM splits")
def h4(spark, sf):
    """One search per nation, over the vote vectors of its suppliers."""
    vectors = C.vote_vectors(nation_buckets(spark, sf))
    return C.best_medoids(vectors).select("corpus", "medoid_a", "medoid_b", "size_a", "size_b", F.when(F.col("strength") < 1e300, F.round("strength", 6)).alias("strength"), "is_split")


@query("h4_split_nations", DIST_SQL + "SELECT medoid_a, medoid_b, size_a, size_b, CASE WHEN strength < 1e300 THEN round(strength, 6) END AS strength, is_split FROM splits")
def h4_nations(spark, sf):
    vectors = C.vote_vectors(O.document_votes(nation_profiles(spark, sf)))
    return C.best_medoids(vectors).select("medoid_a", "medoid_b", "size_a", "size_b", F.when(F.col("strength") < 1e300, F.round("strength", 6)).alias("strength"), "is_split")


@query("h5_warnings", H_SQL + "," + SPLIT_CTES + """
SELECT corpus, 'small' AS kind, '' AS subject, 'with ' || n_docs || ' document(s) agreement moves in steps of '
  || CAST(CAST(round_even(100.0 / n_docs, 0) AS BIGINT) AS VARCHAR) || '%' AS message FROM sz WHERE n_docs < 3
UNION ALL SELECT corpus, 'outlier', doc, doc || ' shares '
  || CAST(CAST(round_even(agreement * 100, 0) AS BIGINT) AS VARCHAR) || '% of the common votes' FROM agr WHERE agreement < 0.6
UNION ALL SELECT corpus, 'split', medoid_a || ' / ' || medoid_b, 'two groups of ' || size_a || ' and ' || size_b || ' documents' FROM splits WHERE is_split
UNION ALL SELECT corpus, 'undecided', '', count(*) || ' pointer(s) without a majority'
  FROM votes WHERE status = 'undecided' GROUP BY corpus""")
def h5(spark, sf):
    docs, dv, v, agreement = judged(spark, sf)
    return C.warnings(O.corpus_sizes(docs), agreement, v, C.split(C.vote_vectors(dv)))


@query("h6_views", VOTES_SQL + f"""
SELECT 'donor' AS view, pointer, coalesce(str, {S.num_text('num')}) AS value FROM votes WHERE in_donor
UNION ALL SELECT 'review', pointer, coalesce(str, {S.num_text('num')}) FROM votes WHERE needs_review
UNION ALL SELECT 'enforceable', pointer, coalesce(str, {S.num_text('num')}) FROM votes WHERE severity <> 'off'
UNION ALL SELECT 'contested', pointer, coalesce(str, {S.num_text('num')}) FROM votes WHERE status = 'contested'""")
def h6(spark, sf):
    v = O.vote_all(lineitem_ballots(spark, sf), supplier_docs(spark, sf))
    value = V.shown(F.col("num"), F.col("str")).alias("value")
    view = lambda name, df: df.select(F.lit(name).alias("view"), "pointer", value)
    return (view("donor", C.donor_values(v)).unionByName(view("review", C.needs_review(v)))
            .unionByName(view("enforceable", C.enforceable(v)))
            .unionByName(view("contested", C.by_status(v, "contested"))))
