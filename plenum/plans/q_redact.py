"""Redaction, invariants and the profile's life over documents, orders and derived package tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import keys as K
from plenum.functions import values as V
from plenum.operators import profile as PR
from plenum.operators import redact as RD
from plenum.operators import verify as VE
from plenum.operators import votes as O
from plenum.plans import sqlparts as S
from plenum.plans.q_text import LINES_SQL, collapse_sql, lines, match_sql
from plenum.plans.q_votes import (DV_SQL, LINEITEM, VOTES_SQL, lineitem_ballots, lineitem_votes, spark_specs, supplier_docs)
from plenum.plans.registry import query, table
from plenum.skew import settle


def source_lines(spark, sf):
    b = lines(spark, sf).withColumn("corpus", F.col("source")).withColumn("key", K.match_key(F.col("text")))
    return b.withColumns({"ctx_kind": F.lit("body"), "parent": F.lit("body"), "is_break": F.col("idx") % 7 == 6, "in_cell": F.lit(False)})


def sizes(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("corpus")).agg(F.count("*").alias("n_docs"))


# the skeleton's verdict stands in as "lines whose length is a multiple of three are vouched for"
_CLEAR = f"""{LINES_SQL}, sz AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
cl AS (SELECT source AS corpus, doc, idx, text, n_docs >= 3 AND length(text) % 3 <> 0 AND {collapse_sql('text')} <> '' AS cleared FROM tb JOIN sz USING (source))"""


def cleared(spark, sf):
    b = source_lines(spark, sf)
    return RD.clear_body(b, b.where("length(text) % 3 = 0").select("corpus", "doc", "idx"), sizes(spark, sf))


@query("n1_clear_body", f"WITH {_CLEAR} SELECT doc, CAST(idx AS INT) AS idx, cleared, CASE WHEN cleared THEN '' ELSE text END AS text FROM cl")
def n1(spark, sf):
    return cleared(spark, sf).select("doc", "idx", "cleared", "text")


@query("n2_collapse", f"WITH {_CLEAR} SELECT doc, CAST(idx AS INT) AS idx, cleared AND coalesce(lag(cleared) OVER (PARTITION BY doc ORDER BY idx), false) AND idx % 7 <> 6 AS dropped FROM cl")
def n2(spark, sf):
    return RD.collapse_cleared(cleared(spark, sf)).select("doc", "idx", "dropped")


# page texts agree within a language when whole lines repeat
@query("n3_line_agreement", f"""WITH {LINES_SQL}, k AS (SELECT lang AS corpus, doc, idx, {match_sql('text')} AS key FROM tb), kk AS (SELECT * FROM k),
sz AS (SELECT lang AS corpus, count(*) AS n FROM documents GROUP BY lang), sup AS (SELECT corpus, key, count(DISTINCT doc) AS d FROM kk WHERE key <> '' GROUP BY ALL)
SELECT doc, CAST(idx AS INT) AS idx, key = '' OR n < 2 OR coalesce(d - 1 >= greatest(1, floor((n - 1) * 0.1)), false) AS kept FROM kk JOIN sz USING (corpus) LEFT JOIN sup USING (corpus, key)""")
def n3(spark, sf):
    b = lines(spark, sf).withColumn("corpus", F.col("lang")).withColumn("key", K.match_key(F.col("text")))
    n = table(spark, sf, "documents").groupBy(F.col("lang").alias("corpus")).agg(F.count("*").alias("n_docs"))
    # the keys are read twice: to count support and to filter
    return RD.filter_lines(settle(b.select("corpus", "doc", "idx", "key")), n, 0.1).select("doc", "idx", "kept")


_PIECES = """inline(array(struct(0 as seq, 'begin' as piece, cast(null as string) as text), struct(1 as seq, 'instr' as piece, 'SEQ Fig' as text), struct(2 as seq, 'begin' as piece, null as text),
 struct(3 as seq, 'separate' as piece, null as text), struct(4 as seq, 'text' as piece, 'inner' as text), struct(5 as seq, 'end' as piece, null as text), struct(6 as seq, 'separate' as piece, null as text),
 struct(7 as seq, 'text' as piece, o_orderpriority as text), struct(8 as seq, 'end' as piece, null as text), struct(9 as seq, 'text' as piece, o_orderstatus as text)))"""


@query("n4_clear_field_results", """SELECT CAST(o_orderkey AS VARCHAR) AS doc, s AS seq, CASE s WHEN 1 THEN 'SEQ Fig' WHEN 4 THEN 'inner' WHEN 7 THEN '' WHEN 9 THEN o_orderstatus END AS text, s = 7 AS cleared, s = 0 AS dirty FROM orders, range(0, 10) t(s)""")
def n4(spark, sf):
    p = table(spark, sf, "orders").selectExpr("cast(o_orderkey as string) as doc", "0 as idx", _PIECES)
    return RD.clear_field_results(p).select("doc", "seq", "text", "cleared", "dirty")


_PROPS = [("core", "creator", "c_name"), ("core", "revision", "'1'"), ("custom", "Segment", "c_mktsegment"), ("extended", "Words", "CAST(c_custkey AS {STR})"), ("extended", "Company", "CASE WHEN c_nationkey = 0 THEN 'AB' ELSE c_mktsegment END")]


def props(spark, sf):
    e = ", ".join(f"struct('{s}' as source, '{n}' as name, {x.format(STR='STRING')} as value)" for s, n, x in _PROPS)
    return table(spark, sf, "customer").selectExpr("cast(c_custkey as string) as doc", f"inline(array({e}))")


_PROP_SQL = "pp AS (" + " UNION ALL ".join(f"SELECT CAST(c_custkey AS VARCHAR) AS doc, '{s}' AS source, '{n}' AS name, {x.format(STR='VARCHAR')} AS value FROM customer" for s, n, x in _PROPS) + ")"


@query("n5_properties", f"""WITH {_PROP_SQL} SELECT doc, name, CASE WHEN name = 'Words' THEN 'dropped' WHEN name = 'revision' THEN 'kept' ELSE 'cleared' END AS action, CASE WHEN name = 'revision' THEN '1' ELSE '' END AS value FROM pp""")
def n5(spark, sf):
    return RD.scrub_properties(props(spark, sf)).select("doc", "name", "action", "value")


@query("n5_identities", f"WITH {_PROP_SQL} SELECT DISTINCT doc, trim(value) AS identity FROM pp WHERE name IN ('creator','Company') AND length(trim(value)) > 2")
def n5_ids(spark, sf):
    return RD.identities(props(spark, sf))


_PART = "CASE page_id % 8 WHEN 0 THEN 'word/document.xml' WHEN 1 THEN 'customXml/item1.xml' WHEN 2 THEN 'word/glossary/document.xml' WHEN 3 THEN 'word/glossary/_rels/document.xml.rels' WHEN 4 THEN 'word/vbaProject.bin' WHEN 5 THEN 'docProps/thumbnail.jpeg' WHEN 6 THEN 'docMetadata/LabelInfo.xml' ELSE 'word/media/image1.png' END"


def pkg_parts(spark, sf):
    return table(spark, sf, "pages").selectExpr("cast(page_id as string) as doc", f"{_PART} as part", "if(page_id % 8 = 5, 'thumbnail', cast(null as string)) as reltype")


@query("n6_payload_parts", "SELECT CAST(page_id AS VARCHAR) AS doc, page_id % 8 IN (1, 2, 4, 5) AS dropped FROM pages")
def n6(spark, sf):
    return RD.drop_payload(pkg_parts(spark, sf)).select("doc", "dropped")


@query("n7_unreferenced_notes", """WITH n AS (SELECT CAST(o_custkey AS VARCHAR) AS doc, k AS kind, o_orderkey - 2 AS note_id, CASE o_orderstatus WHEN 'P' THEN 'separator' WHEN 'F' THEN 'normal' END AS note_type, o_orderkey FROM orders, (VALUES ('footnote'), ('endnote')) t(k)),
u AS (SELECT DISTINCT l_orderkey, CASE WHEN l_linenumber % 2 = 1 THEN 'footnote' ELSE 'endnote' END AS kind FROM lineitem)
SELECT doc, kind, note_id FROM n WHERE note_type IS DISTINCT FROM 'separator' AND note_id > 0 AND NOT EXISTS (SELECT 1 FROM u WHERE u.l_orderkey = n.o_orderkey AND u.kind = n.kind)""")
def n7(spark, sf):
    o = table(spark, sf, "orders")
    notes = o.selectExpr("cast(o_custkey as string) as doc", "explode(array('footnote', 'endnote')) as kind", "o_orderkey - 2 as note_id", "case o_orderstatus when 'P' then 'separator' when 'F' then 'normal' end as note_type")
    used = table(spark, sf, "lineitem").selectExpr("l_orderkey - 2 as note_id", "if(l_linenumber % 2 = 1, 'footnote', 'endnote') as kind").distinct()
    refs = used.join(o.selectExpr("cast(o_custkey as string) as doc", "o_orderkey - 2 as note_id"), "note_id")
    return RD.unreferenced_notes(notes, refs).select("doc", "kind", "note_id")


# a customer is a package, its orders are relationships to media, line items are the uses
def rels(spark, sf):
    o = table(spark, sf, "orders")
    r = o.selectExpr("cast(o_custkey as string) as doc", "'word/document.xml' as source_part", "cast(o_orderkey as string) as rid", "if(o_orderstatus = 'F', 'image', if(o_orderstatus = 'O', 'styles', 'hyperlink')) as reltype",
                     "concat('word/media/image', o_orderkey % 50, '.png') as target", "o_orderstatus = 'P' as external")
    used = table(spark, sf, "lineitem").selectExpr("cast(l_orderkey as string) as rid").distinct().join(r.select("doc", "source_part", "rid"), "rid")
    return r, used


_REL_SQL = """rl AS (SELECT CAST(o_custkey AS VARCHAR) AS doc, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'image' WHEN 'O' THEN 'styles' ELSE 'hyperlink' END AS reltype, 'word/media/image' || (o_orderkey % 50) || '.png' AS target, o_orderstatus = 'P' AS external,
 o_orderstatus <> 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS dropped FROM orders)"""


@query("n8_prune_relationships", f"WITH {_REL_SQL} SELECT doc, CAST(o_orderkey AS VARCHAR) AS rid, dropped FROM rl")
def n8(spark, sf):
    return RD.prune_rels(*rels(spark, sf)).select("doc", "rid", "dropped")


@query("n8_orphan_media", f"WITH {_REL_SQL} SELECT DISTINCT doc, target AS part FROM rl a WHERE NOT EXISTS (SELECT 1 FROM rl b WHERE b.doc = a.doc AND b.target = a.target AND NOT b.dropped AND NOT b.external)")
def n8_media(spark, sf):
    r, used = rels(spark, sf)
    parts = r.select("doc", F.col("target").alias("part")).distinct()
    return RD.orphan_media(parts, RD.prune_rels(r, used).where("not dropped"))


# the lines of the benchmark passages are what must not survive
_NAMES = "SELECT DISTINCT identity FROM (SELECT unnest(string_split(text, chr(10))) AS identity FROM benchmark) WHERE length(identity) > 2"


@query("n9_identity_survivors", f"SELECT CAST(doc_id AS VARCHAR) AS doc, lang AS part, identity FROM documents JOIN ({_NAMES}) ON contains(text, identity)")
def n9(spark, sf):
    names = table(spark, sf, "benchmark").select(F.explode(F.split("text", "\n")).alias("identity")).where("length(identity) > 2").distinct()
    texts = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.col("lang").alias("part"), "text")
    return RD.identity_survivors(texts, names)


_ATTR = "CASE event_type WHEN 'view' THEN 'rsidR' WHEN 'click' THEN 'val' END"
_ELEM = "CASE event_type WHEN 'error' THEN 'proofErr' WHEN 'signup' THEN 'lock' WHEN 'purchase' THEN 'commentReference' ELSE 'p' END"


@query("n10_scrub", "SELECT CAST(user_id AS VARCHAR) AS doc, CASE event_type WHEN 'view' THEN 'editing-session ids' WHEN 'error' THEN 'spell-check markers' WHEN 'signup' THEN 'content-control locks' ELSE 'comment anchors' END AS kind, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY ALL")
def n10(spark, sf):
    a = table(spark, sf, "events").selectExpr("cast(user_id as string) as doc", f"{_ELEM} as element", f"{_ATTR} as attr")
    return RD.scrub_counts(RD.scrub(a))


@query("n11_report", f"""WITH {_CLEAR}, c AS (SELECT doc, 'lines' AS what, count(CASE WHEN NOT cleared THEN 1 END) AS n FROM cl GROUP BY doc UNION ALL SELECT doc, 'paragraphs', count(CASE WHEN cleared THEN 1 END) FROM cl GROUP BY doc)
SELECT doc, CAST(sum(n) AS BIGINT) AS total, CASE WHEN sum(n) = 0 THEN 'the exemplar carried no content of its own' ELSE 'removed ' || string_agg(n || ' ' || what, ', ' ORDER BY what) FILTER (WHERE n > 0) END AS summary FROM c GROUP BY doc""")
def n11(spark, sf):
    c = cleared(spark, sf).groupBy("doc").agg(F.count(F.when(~F.col("cleared"), 1)).alias("a"), F.count(F.when(F.col("cleared"), 1)).alias("b"))
    return RD.redaction_report(c.selectExpr("doc", "stack(2, 'lines', a, 'paragraphs', b) as (what, n)"))


@query("n11_kept_notes", "SELECT CAST(page_id AS VARCHAR) AS doc, 'docMetadata/LabelInfo.xml' AS part, 'a sensitivity label' AS what FROM pages WHERE page_id % 8 = 6")
def n11_kept(spark, sf):
    return RD.kept_notes(pkg_parts(spark, sf))


def before_after(spark, sf):
    b = lines(spark, sf).select("doc", "idx", "text", F.lit(False).alias("chrome"), F.lit(False).alias("in_del"))
    # documents 0 mod 10 lose their first line, 1 mod 10 gain one, 2 mod 10 are reversed
    d = F.col("doc").cast("int") % 10
    a = b.where(~((d == 0) & (F.col("idx") == 0))).withColumn("idx", F.when(d == 2, -F.col("idx")).otherwise(F.col("idx")))
    extra = b.where((d == 1) & (F.col("idx") == 0)).withColumn("text", F.lit("An invented line.")).withColumn("idx", F.lit(-1))
    return VE.snapshot(b), VE.snapshot(a.unionByName(extra))


_BA_SQL = f"""{LINES_SQL}, bf AS (SELECT doc, idx AS seq, {match_sql('text')} AS key FROM tb WHERE {match_sql('text')} <> ''),
af AS (SELECT doc, CASE WHEN CAST(doc AS INT) % 10 = 2 THEN -seq ELSE seq END AS seq, key FROM bf WHERE NOT (CAST(doc AS INT) % 10 = 0 AND seq = 0) UNION ALL SELECT doc, -1, 'An invented line.' FROM tb WHERE CAST(doc AS INT) % 10 = 1 AND idx = 0),
lo AS (SELECT doc, count(*) AS n FROM bf WHERE NOT EXISTS (SELECT 1 FROM af WHERE af.doc = bf.doc AND af.key = bf.key) GROUP BY doc), ga AS (SELECT doc, count(*) AS n FROM af WHERE NOT EXISTS (SELECT 1 FROM bf WHERE af.doc = bf.doc AND af.key = bf.key) GROUP BY doc),
ob AS (SELECT doc, count(*) AS n, string_agg(key, chr(0) ORDER BY seq) AS s FROM bf GROUP BY doc), oa AS (SELECT doc, string_agg(key, chr(0) ORDER BY seq) AS s FROM af GROUP BY doc)"""


@query("r1_snapshot", f"WITH {LINES_SQL} SELECT doc, CAST(idx AS INT) AS seq, {match_sql('text')} AS key FROM tb WHERE {match_sql('text')} <> ''")
def r1(spark, sf):
    return before_after(spark, sf)[0].select("doc", "seq", "key")


@query("r2_text_faults", f"WITH {_BA_SQL} SELECT doc, 'lost' AS fault, n FROM lo UNION ALL SELECT doc, 'invented', n FROM ga UNION ALL SELECT ob.doc, 'reordered', n FROM ob JOIN oa USING (doc) WHERE ob.s <> oa.s AND ob.doc NOT IN (SELECT doc FROM lo UNION SELECT doc FROM ga)")
def r2(spark, sf):
    return VE.text_faults(*before_after(spark, sf))


@query("r2_count_faults", """WITH b AS (SELECT user_id, event_type AS name, count(*) AS was FROM events GROUP BY ALL), a AS (SELECT user_id, event_type AS name, count(*) AS now FROM events WHERE value < 50 OR event_type <> 'view' GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS doc, name, was, coalesce(now, 0) AS now, 'lost' AS fault FROM b LEFT JOIN a USING (user_id, name) WHERE coalesce(now, 0) < was""")
def r2_counts(spark, sf):
    e = table(spark, sf, "events").selectExpr("cast(user_id as string) as doc", "event_type as name", "value")
    return VE.count_faults(VE.counts(e), VE.counts(e.where("value < 50 or name <> 'view'")))


@query("r3_integrity", """SELECT 'order without customer' AS fault, CAST(o_custkey AS VARCHAR) AS subject FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)
UNION ALL SELECT 'line without part', CAST(l_partkey AS VARCHAR) FROM (SELECT DISTINCT l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)
UNION ALL SELECT 'order without lines', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def r3(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    cust = table(spark, sf, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("k"))
    part = table(spark, sf, "part").where("p_size > 2").select(F.col("p_partkey").alias("k"))
    return (VE.dangling(o.select(F.col("o_custkey").alias("k")), cust, ["k"], "order without customer")
            .unionByName(VE.dangling(li.select(F.col("l_partkey").alias("k")), part, ["k"], "line without part"))
            .unionByName(VE.dangling(o.select(F.col("o_orderkey").alias("k")), li.select(F.col("l_orderkey").alias("k")), ["k"], "order without lines")))


@query("r3_unpaired_marks", """SELECT 'opened, not closed' AS fault, user_id || '/p/' || m AS subject FROM (SELECT DISTINCT user_id, event_id % 40 AS m FROM events WHERE event_type = 'view' EXCEPT SELECT user_id, event_id % 40 FROM events WHERE event_type = 'click')
UNION ALL SELECT 'closed, not opened', user_id || '/p/' || m FROM (SELECT DISTINCT user_id, event_id % 40 AS m FROM events WHERE event_type = 'click' EXCEPT SELECT user_id, event_id % 40 FROM events WHERE event_type = 'view')""")
def r3_marks(spark, sf):
    e = table(spark, sf, "events").selectExpr("user_id as doc", "'p' as part", "event_id % 40 as mark", "event_type")
    return VE.unpaired(e.where("event_type = 'view'"), e.where("event_type = 'click'"))


@query("r3_final_section", """SELECT CAST(l_orderkey AS VARCHAR) AS doc, CASE WHEN n = 0 THEN 'section end missing' WHEN n > 1 THEN 'section end repeated' ELSE 'section end not last' END AS fault FROM (SELECT l_orderkey, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n, max(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS a, max(l_linenumber) AS m FROM lineitem GROUP BY 1) WHERE n <> 1 OR a <> m""")
def r3_final(spark, sf):
    return VE.final_section(table(spark, sf, "lineitem").selectExpr("cast(l_orderkey as string) as doc", "l_linenumber as pos", "if(l_returnflag = 'R', 'sectPr', 'p') as tag"))


@query("r5_rendering_diff", """WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, o_orderpriority FROM orders), x AS (SELECT *, o_orderkey % 31 = 0 AS diverges FROM o), c AS (SELECT o_custkey, min(pos) AS cut FROM x WHERE diverges GROUP BY 1)
SELECT CAST(x.o_custkey AS VARCHAR) AS doc, CAST(o_orderkey AS BIGINT) AS pos, 'size' AS prop FROM x LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS cut FROM x WHERE diverges GROUP BY 1) c ON c.o_custkey = x.o_custkey WHERE (cut IS NULL OR o_orderkey < cut) AND o_orderkey % 4 = 0
UNION ALL SELECT CAST(x.o_custkey AS VARCHAR), CAST(o_orderkey AS BIGINT), 'font' FROM x LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS cut FROM x WHERE diverges GROUP BY 1) c ON c.o_custkey = x.o_custkey WHERE (cut IS NULL OR o_orderkey < cut) AND o_orderkey % 6 = 0""")
def r5(spark, sf):
    o = table(spark, sf, "orders").selectExpr("cast(o_custkey as string) as doc", "o_orderkey as pos", "o_orderpriority as key", "11.0D as size", "o_orderstatus as font", "o_orderkey")
    theirs = o.selectExpr("doc", "pos", "if(o_orderkey % 31 = 0, 'other', key) as key", "size + if(o_orderkey % 4 = 0, 0.5D, 0.05D) as size", "if(o_orderkey % 6 = 0, 'Z', font) as font")
    return VE.rendering_diff(o, theirs, ["size"], ["font"]).select("doc", "pos", "prop")


PINS = [("/lineitem/returnflag", "X"), ("/lineitem/linestatus", None), ("/no/such", "1")]


def pins(spark, sf):
    v = lineitem_votes(spark, sf)
    same = v.where("pointer = '/lineitem/linestatus'").select("pointer", V.shown(F.col("num"), F.col("str")).alias("pin_value"))
    return v, same.unionByName(v.limit(1).selectExpr("inline(array(struct('/lineitem/returnflag' as pointer, 'X' as pin_value), struct('/no/such' as pointer, '1' as pin_value)))"))


_VAL = f"coalesce(str, {S.num_text('num')})"


@query("s1_pins", VOTES_SQL + f"""SELECT pointer, CASE WHEN pointer = '/lineitem/returnflag' THEN 'X' ELSE {_VAL} END AS value, CASE pointer WHEN '/lineitem/returnflag' THEN 'overriding' WHEN '/lineitem/linestatus' THEN 'redundant' ELSE 'learned' END AS status, {_VAL} AS learned FROM votes WHERE in_donor
UNION ALL SELECT '/no/such', '1', 'unknown', NULL""")
def s1(spark, sf):
    v, p = pins(spark, sf)
    return PR.apply_pins(v, p).select("pointer", "value", "status", "learned")


# the exemplar is supplier 1: what it says itself against the corpus
@query("s2_sync", VOTES_SQL + f"""SELECT v.pointer, coalesce(v.str, {S.num_text('v.num')}) AS learned, coalesce(d.str, {S.num_text('d.num')}) AS pin_value FROM votes v JOIN dv d USING (corpus, pointer) WHERE d.doc = '1' AND v.bkey <> d.bkey AND v.in_donor""")
def s2(spark, sf):
    dv = O.document_votes(lineitem_ballots(spark, sf))
    rules = PR.rules_table(O.votes(dv, O.corpus_sizes(supplier_docs(spark, sf))))
    return PR.sync(rules, dv.where("doc = '1'").select("pointer", "bkey", V.shown(F.col("num"), F.col("str")).alias("value")))


@query("s3_placeholder_sync", """WITH k AS (SELECT DISTINCT p_brand AS name, 'text' AS type FROM part WHERE p_size < 30 AND p_brand <> 'Brand#1'), f AS (SELECT DISTINCT p_brand AS name, 'number' AS type FROM part WHERE p_brand <> 'Brand#2')
SELECT name, CASE WHEN k.type IS NULL THEN 'added' WHEN f.type IS NULL THEN 'removed' ELSE 'kept' END AS change, coalesce(f.type, k.type) AS type FROM k FULL JOIN f USING (name)""")
def s3(spark, sf):
    p = table(spark, sf, "part")
    known = p.where("p_size < 30 and p_brand <> 'Brand#1'").selectExpr("p_brand as name", "'text' as type", "cast(null as string) as template").distinct()
    found = p.where("p_brand <> 'Brand#2'").selectExpr("p_brand as name", "'number' as type", "cast(null as string) as template").distinct()
    return PR.sync_placeholders(known, found).select("name", "change", "type")


@query("s4_rules_table", VOTES_SQL + f"""SELECT pointer, CASE WHEN pointer = '/lineitem/returnflag' THEN 'X' ELSE {_VAL} END AS value, status, CASE WHEN pointer = '/lineitem/quantity' THEN 'info' ELSE severity END AS severity,
 round(coverage, 4) AS coverage, round(agreement, 4) AS agreement, pointer IN ('/lineitem/returnflag', '/lineitem/linestatus') AS pinned, weak FROM votes WHERE in_donor AND pointer <> '/lineitem/discount'""")
def s4(spark, sf):
    v, p = pins(spark, sf)
    one = v.limit(1)
    r = PR.rules_table(v, p, one.selectExpr("'/lineitem/discount' as pointer"), one.selectExpr("'/lineitem/quantity' as pointer", "'info' as severity"))
    return r.select("pointer", "value", "status", "severity", "coverage", "agreement", "pinned", "weak")


@query("s4_unstable_values", VOTES_SQL + "SELECT pointer FROM votes WHERE pointer LIKE '%/width' AND in_donor AND num <> floor(num)")
def s4_unstable(spark, sf):
    return PR.unstable_values(PR.rules_table(lineitem_votes(spark, sf))).select("pointer")


@query("s5_evidence", VOTES_SQL + "SELECT pointer, doc, CASE WHEN dv.bkey = votes.bkey THEN 'agreeing' ELSE 'dissenting' END AS stance, round(internal_agreement, 4) AS internal_agreement FROM dv JOIN votes USING (corpus, pointer)")
def s5(spark, sf):
    dv = O.document_votes(lineitem_ballots(spark, sf))
    return PR.evidence(dv, O.votes(dv, O.corpus_sizes(supplier_docs(spark, sf)))).select("pointer", "doc", "stance", "internal_agreement")


@query("a19_profile_show", VOTES_SQL + f"SELECT pointer, {_VAL} AS value, status, severity FROM votes WHERE in_donor AND severity <> 'off' ORDER BY pointer LIMIT 30")
def a19(spark, sf):
    return PR.show(PR.rules_table(lineitem_votes(spark, sf))).select("pointer", "value", "status", "severity")
