"""Reformatting: style maps, list merges, stripping of runs and paragraphs, edits, grafting."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import apply as A
from plenum.plans.q_hierarchy import _OS, _SIG, order_signatures, order_styles
from plenum.plans.registry import query, table


def donor_styles(spark, sf):
    """The exemplar defines one style per priority of customer 0..4's orders."""
    return table(spark, sf, "orders").where("o_custkey < 5").selectExpr(
        "'donor' as doc", "concat('D', o_orderkey) as style_id", "'paragraph' as type", "lower(if(o_orderpriority = '5-LOW', 'unused', o_orderpriority)) as name_key", "o_orderkey as pos", "array(concat(lower(o_orderstatus), '')) as aliases")


_MAP = f"""{_OS}, dn AS (SELECT 'D' || o_orderkey AS id, lower(CASE WHEN o_orderpriority = '5-LOW' THEN 'unused' ELSE o_orderpriority END) AS name, 0 AS p, o_orderkey AS pos FROM orders WHERE o_custkey < 5 UNION ALL SELECT 'D' || o_orderkey, lower(o_orderstatus), 1, o_orderkey FROM orders WHERE o_custkey < 5),
di AS (SELECT name, first(id ORDER BY p, pos) AS target FROM dn GROUP BY name), sk AS (SELECT doc, id, type, name_key AS k, 0 AS p FROM os UNION ALL SELECT doc, id, type, aliases[1], 1 FROM os UNION ALL SELECT doc, id, type, aliases[2], 2 FROM os),
mp AS (SELECT doc, sk.id, any_value(type) AS type, first(target ORDER BY p) FILTER (WHERE target IS NOT NULL AND type = 'paragraph') AS target FROM sk LEFT JOIN di ON di.name = sk.k GROUP BY doc, sk.id)"""


@query("q1_style_map", f"WITH {_MAP} SELECT CAST(doc AS VARCHAR) AS doc, CAST(id AS VARCHAR) AS style_id, target FROM mp")
def q1(spark, sf):
    return A.style_map(order_styles(spark, sf), donor_styles(spark, sf))


@query("q2_remap_references", f"WITH {_MAP} SELECT CAST(id AS VARCHAR) AS style_id, CASE WHEN target IS NOT NULL THEN target WHEN type = 'character' THEN NULL ELSE CAST(id AS VARCHAR) END AS new_id, count(*) AS n FROM mp JOIN lineitem ON l_orderkey = id GROUP BY ALL")
def q2(spark, sf):
    s = order_styles(spark, sf)
    refs = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("style_id")).join(s.select("doc", "style_id", F.when(F.col("type") == "character", "rStyle").otherwise("pStyle").alias("kind")), "style_id")
    return A.remap_references(refs, A.style_map(s, donor_styles(spark, sf))).groupBy("style_id", "new_id").agg(F.count("*").alias("n"))


@query("q3_merge_lists", f"""WITH {_SIG}, dn AS (SELECT l_orderkey AS num_id, l_orderkey + 100000 AS abstract_id, signature FROM si WHERE l_orderkey < 200), kn AS (SELECT signature, min(num_id) AS num_id, min(abstract_id) AS abstract_id FROM dn GROUP BY 1), tp AS (SELECT max(num_id) AS tn, max(abstract_id) AS ta FROM dn),
j AS (SELECT o_custkey AS doc, si.l_orderkey AS num_id, kn.num_id AS dnum, kn.abstract_id AS dabs, o_orderstatus <> 'F' AS numbered, tn, ta FROM si JOIN orders ON o_orderkey = si.l_orderkey LEFT JOIN kn USING (signature) CROSS JOIN tp),
k AS (SELECT *, dnum IS NOT NULL AND NOT numbered AS reused, dnum IS NULL AS fresh FROM j)
SELECT CAST(doc AS VARCHAR) AS doc, num_id, CAST(CASE WHEN reused THEN dnum ELSE tn + sum(CASE WHEN reused THEN 0 ELSE 1 END) OVER w END AS BIGINT) AS new_num, CAST(CASE WHEN fresh THEN ta + sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER w ELSE dabs END AS BIGINT) AS new_abstract,
 CASE WHEN reused THEN 'reused' WHEN fresh THEN 'imported' ELSE 'restarted' END AS outcome FROM k WINDOW w AS (PARTITION BY doc ORDER BY num_id ROWS UNBOUNDED PRECEDING)""")
def q3(spark, sf):
    sig = order_signatures(spark, sf)
    o = table(spark, sf, "orders").selectExpr("o_orderkey as l_orderkey", "cast(o_custkey as string) as doc", "o_orderstatus <> 'F' as numbered")
    source = sig.join(o, "l_orderkey").select("doc", F.col("l_orderkey").alias("num_id"), "signature", "numbered")
    donor = sig.where("l_orderkey < 200").select(F.col("l_orderkey").alias("num_id"), (F.col("l_orderkey") + 100000).alias("abstract_id"), "signature")
    return A.merge_lists(source, donor)


def runs(spark, sf):
    """Lines of an order as runs of one paragraph."""
    return table(spark, sf, "lineitem").selectExpr(
        "cast(l_orderkey as string) as doc", "0 as idx", "l_linenumber * 1000000 + l_partkey as run_no", "array_compact(array('sz', if(l_returnflag = 'R', 'b', null), if(l_linestatus = 'O', 'i', null), if(l_linenumber % 2 = 0, 'vertAlign', null))) as props")


_RUN = """rn AS (SELECT l_orderkey, l_linenumber * 1000000 + l_partkey AS run_no, l_returnflag = 'R' AS b, l_linestatus = 'O' AS i, l_linenumber % 2 = 0 AS v FROM lineitem), sc AS (SELECT l_orderkey, avg(b::INT) AS ab, avg(i::INT) AS ai, avg(v::INT) AS av FROM rn GROUP BY 1)"""


@query("q4_span_scope", f"WITH {_RUN} SELECT CAST(l_orderkey AS VARCHAR) AS doc, p AS prop, CASE WHEN a = 1 THEN 'all' ELSE 'some' END AS scope FROM (SELECT l_orderkey, 'b' AS p, ab AS a FROM sc UNION ALL SELECT l_orderkey, 'i', ai FROM sc UNION ALL SELECT l_orderkey, 'vertAlign', av FROM sc UNION ALL SELECT l_orderkey, 'sz', 1 FROM sc) WHERE a > 0")
def q4(spark, sf):
    return A.span_scope(runs(spark, sf)).select("doc", "prop", "scope")


@query("q4_strip_runs", f"WITH {_RUN} SELECT CAST(l_orderkey AS VARCHAR) AS doc, run_no, concat_ws(',', CASE WHEN b AND ab < 1 THEN 'b' END, CASE WHEN i AND ai < 1 THEN 'i' END, CASE WHEN v THEN 'vertAlign' END) AS kept FROM rn JOIN sc USING (l_orderkey)")
def q4_strip(spark, sf):
    return A.strip_runs(runs(spark, sf)).select("doc", "run_no", F.array_join("kept", ",").alias("kept"))


@query("q5_strip_paragraphs", """SELECT o_orderkey AS idx, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'numPr' END, 'sectPr', CASE WHEN o_orderkey % 3 = 0 THEN 'tabs' END) AS kept FROM orders""")
def q5(spark, sf):
    b = table(spark, sf, "orders").selectExpr("o_orderkey as idx", "if(o_orderkey % 3 = 0, 'a\\tb', 'ab') as text", "map('sectPr', '1', 'tabs', '2', 'numPr', '3', 'spacing', '4') as ppr", "o_orderkey % 5 = 0 as numbered")
    return A.strip_paragraphs(b).select("idx", F.array_join(F.array_sort(F.map_keys("kept")), ",").alias("kept"))


@query("q6_apply_edits", """SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'heading 1' ELSE o_orderpriority END AS style_name, o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AS applied, CASE WHEN o_orderkey % 6 = 0 THEN 'read as heading1 (50% sure)' END AS comment FROM orders""")
def q6(spark, sf):
    o = table(spark, sf, "orders").selectExpr("cast(o_custkey as string) as doc", "o_orderkey as idx", "o_orderpriority as style_name")
    e = o.where("idx % 2 = 0").selectExpr("doc", "idx", "'heading 1' as new_style", "idx % 3 = 0 as needs_review", "'heading1' as role", "0.5D as confidence")
    return A.apply_edits(o, e).select("idx", "style_name", "applied", "comment")


# every customer is a target package; nation 0's page structure is the exemplar's relationship graph
@query("q7_graft", """SELECT CAST(c_custkey AS VARCHAR) AS doc, part, origin FROM customer, (VALUES ('document.xml', 'target'), ('styles.xml', 'exemplar'), ('theme.xml', 'exemplar'), ('header1.xml', 'exemplar'), ('logo.png', 'exemplar'), ('chart.xml', 'exemplar')) t(part, origin)
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'own.png', 'target' FROM customer WHERE c_custkey % 2 = 0""")
def q7(spark, sf):
    c = table(spark, sf, "customer")
    target = c.selectExpr("cast(c_custkey as string) as doc", "c_custkey", "inline(array(struct('document.xml' as part, 'document' as role), struct('styles.xml' as part, 'styles' as role), struct('header9.xml' as part, 'header' as role), struct('own.png' as part, 'media' as role)))").where("part <> 'own.png' or c_custkey % 2 = 0").drop("c_custkey")
    one = table(spark, sf, "region").limit(1)
    donor = one.selectExpr("inline(array(struct('styles.xml' as part, 'styles' as role), struct('theme.xml' as part, 'theme' as role), struct('header1.xml' as part, 'header' as role), struct('logo.png' as part, 'media' as role), struct('chart.xml' as part, 'chart' as role), struct('body.png' as part, 'media' as role)))")
    rels = one.selectExpr("'donor' as doc", "inline(array(struct('header1.xml' as source_part, 'logo.png' as target, false as external), struct('logo.png' as source_part, 'chart.xml' as target, false as external), struct('chart.xml' as source_part, 'header1.xml' as target, false as external)))")
    return A.graft(target, donor, rels).select("doc", "part", "origin")
