"""Lint of pages and documents against rules learned from the pages themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import keys as K
from plenum.functions import values as V
from plenum.operators import lint as LI
from plenum.operators import votes as O
from plenum.operators import profile as PR
from plenum.plans import sqlparts as S
from plenum.plans.q_corpus import H_SQL
from plenum.plans.q_roles import SCORE_SQL, classified
from plenum.plans.q_text import LINES_SQL, collapse_sql, exact_sql, heading_sql, lines, match_sql
from plenum.plans.q_votes import (DOC_LIST, DV_SQL, LINEITEM, VOTES_SQL, lineitem_ballots, lineitem_votes, supplier_docs)
from plenum.plans.registry import query, table
from plenum.skew import settle

_FLAGS = {"track_changes": "doc_id % 50 = 0", "protected": "doc_id % 70 = 0", "write_protected": "doc_id % 90 = 0", "alt_chunk": "lang = 'xx'", "revisions": "doc_id % 25 = 0"}


def flags(spark, sf):
    return table(spark, sf, "documents").selectExpr("cast(doc_id as string) as doc", *[f"{e} as {n}" for n, e in _FLAGS.items()])


@query("p1_refusals", """SELECT CAST(doc_id AS VARCHAR) AS doc, 'change tracking is on' AS actual FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'editing is restricted' FROM documents WHERE doc_id % 70 = 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'writing needs a password' FROM documents WHERE doc_id % 90 = 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'unresolved revisions remain' FROM documents WHERE doc_id % 25 = 0 AND doc_id % 50 <> 0""")
def p1(spark, sf):
    return LI.refusals(flags(spark, sf)).select("doc", "actual")


def rules(spark, sf):
    return PR.rules_table(lineitem_votes(spark, sf))


@query("p2_effective_severity", VOTES_SQL + "SELECT pointer, CASE pointer WHEN '/lineitem/discount' THEN 'off' WHEN '/lineitem/quantity' THEN 'info' ELSE severity END AS severity FROM votes WHERE in_donor")
def p2(spark, sf):
    one = table(spark, sf, "supplier").limit(1)
    r = LI.effective_severity(rules(spark, sf), one.selectExpr("'/lineitem/discount' as pointer"), one.selectExpr("'/lineitem/quantity' as pointer", "'info' as severity"))
    return r.select("pointer", "severity")


_PAGE = {"/lineitem/quantity": "page.size", "/lineitem/returnflag": "page.orientation", "/lineitem/discount": "page.margins"}


@query("p3_single_valued", VOTES_SQL + f"SELECT dv.doc, c.code, v.severity, pointer AS rule_id, coalesce(v.str, {S.num_text('v.num')}) AS expected, coalesce(dv.str, {S.num_text('dv.num')}) AS actual FROM dv JOIN votes v USING (corpus, pointer) JOIN (VALUES {', '.join(f"('{p}', '{c}')" for p, c in _PAGE.items())}) c(p, code) ON c.p = pointer WHERE v.in_donor AND v.severity <> 'off' AND dv.bkey <> v.bkey")
def p3(spark, sf):
    dv = settle(O.document_votes(lineitem_ballots(spark, sf)))
    r = PR.rules_table(O.votes(dv, O.corpus_sizes(supplier_docs(spark, sf))))
    actual = dv.select("doc", "pointer", "bkey", V.shown(F.col("num"), F.col("str")).alias("value"))
    return LI.single_valued(r, actual, _PAGE).select("doc", "code", "severity", "rule_id", "expected", "actual")


# the profile's styles are those of the pages; roles without one fall back to a recorded name
_RECORDED = [("title", "Title"), ("heading1", "House  Heading"), ("list_number", "List Number"), ("caption", "Caption")]


def roles_to_styles(spark, sf, c):
    used = c.select(F.col("style_name").alias("style")).distinct()
    rec = table(spark, sf, "region").limit(1).selectExpr("inline(array(" + ", ".join(f"struct('{r}' as role, '{s}' as style)" for r, s in _RECORDED) + "))")
    return LI.role_styles(used, rec)


_ROLE = """CASE WHEN style = 'title' THEN 'title' WHEN regexp_full_match(style, 'heading \\d') THEN 'heading' || style[9] WHEN regexp_full_match(style, 'list bullet ?\\d?') THEN 'list_bullet' WHEN style = 'normal' THEN 'body' END"""
P_SQL = f"""{SCORE_SQL}, us AS (SELECT DISTINCT style_name AS style FROM cl),
rs AS (SELECT role, min(style) AS want FROM (SELECT {_ROLE} AS role, style FROM us) WHERE role IS NOT NULL GROUP BY role),
rm AS (SELECT * FROM rs UNION ALL SELECT * FROM (VALUES {', '.join(f"('{r}', '{' '.join(s.lower().split())}')" for r, s in _RECORDED)}) t(role, want) WHERE role NOT IN (SELECT role FROM rs)),
wr AS (SELECT cl.*, want FROM cl JOIN rm USING (role) WHERE role NOT IN ('empty', 'placeholder') AND style_name IS DISTINCT FROM want),
rg AS (SELECT cl.*, want FROM cl JOIN rm USING (role) WHERE role NOT IN ('empty', 'placeholder') AND style_name = want)"""


@query("p4_role_styles", f"WITH {P_SQL} SELECT role, want AS want_style FROM rm")
def p4(spark, sf):
    return roles_to_styles(spark, sf, settle(classified(spark, sf)))


@query("p5_wrong_styles", f"WITH {P_SQL} SELECT doc, idx, role, style_name, want AS want_style FROM wr")
def p5(spark, sf):
    c = settle(classified(spark, sf))
    return LI.wrong_styles(c, roles_to_styles(spark, sf, c)).select("doc", "idx", "role", "style_name", "want_style")


PROPS = {"size": ("/run/size", "sz"), "bold": ("/run/bold", "b"), "alignment": ("/para/alignment", "s"), "indent_left": ("/para/indent_left", "len")}
_DEV_PARTS = [("size", "/run/size", "'sz:' || size", "CAST(CAST(size AS DECIMAL(38,6)) AS VARCHAR)"), ("bold", "/run/bold", "'b:' || CAST(bold AS VARCHAR)", "CAST(bold AS VARCHAR)"),
              ("alignment", "/para/alignment", "'s:' || alignment", "alignment"), ("indent_left", "/para/indent_left", "'len:' || CAST(round_even(indent_left / 14.4, 0) AS BIGINT)", "CAST(CAST(indent_left AS DECIMAL(38,6)) AS VARCHAR)")]
# rules: the majority value of each (style, property) over the styled pages
DEV_SQL = f"""{P_SQL}, lg AS ({' UNION ALL '.join(f"SELECT doc, idx, role, '{p}' AS prop, '/styles/paragraph/' || style_name || '{leaf}' AS pointer, {b} AS bkey, {v} AS actual FROM rg" for p, leaf, b, v in _DEV_PARTS)}),
ru AS (SELECT pointer, bkey AS want, actual AS expected, CASE WHEN pointer LIKE '%alignment' THEN 'optional_consistent' ELSE 'normative' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY pointer ORDER BY n DESC, bkey) AS rn FROM (SELECT pointer, bkey, actual, count(*) AS n FROM lg WHERE bkey IS NOT NULL GROUP BY ALL)) WHERE rn = 1),
dev AS (SELECT lg.*, expected FROM lg JOIN ru USING (pointer) WHERE bkey IS DISTINCT FROM want AND NOT (bkey IS NULL AND status = 'optional_consistent'))"""


def style_rules(c, roles):
    """Majority value per (style, property) of rightly styled blocks: a one-document-one-row stand-in for learn."""
    live = c.where("role not in ('empty', 'placeholder')").join(roles, "role").where("style_name = want_style")
    spec = [(leaf, tag, F.col(col)) for col, (leaf, tag) in PROPS.items()]
    wide = None
    for leaf, tag, col in spec:
        textual = tag in ("s", "b")
        part = live.select(F.concat(F.lit("/styles/paragraph/"), "style_name", F.lit(leaf)).alias("pointer"), F.lit(tag).alias("tag"),
                           (F.lit(None) if textual else col).cast("double").alias("num"), (col if textual else F.lit(None)).cast("string").alias("str"), F.lit(None).cast("string").alias("rule"))
        wide = part if wide is None else wide.unionByName(part)
    counts = O.bucketed(wide.where("num is not null or str is not null")).groupBy("pointer", "bkey").agg(F.count("*").alias("n"), F.min("num").alias("num"), F.min("str").alias("str"))
    top = counts.groupBy("pointer").agg(F.min(F.struct((-F.col("n")).alias("neg"), "bkey", "num", "str")).alias("m"))
    return top.select("pointer", F.col("m.bkey").alias("bkey"), V.shown(F.col("m.num"), F.col("m.str")).alias("value"), F.lit("error").alias("severity"),
                      F.when(F.endswith("pointer", F.lit("alignment")), "optional_consistent").otherwise("normative").alias("status"))


def deviations(spark, sf):
    c = settle(classified(spark, sf))
    roles = settle(roles_to_styles(spark, sf, c))
    return c, roles, LI.property_deviations(c, roles, style_rules(c, roles), PROPS)


@query("p6_property_deviations", f"WITH {DEV_SQL} SELECT doc, idx, prop, expected, actual FROM dev")
def p6(spark, sf):
    return deviations(spark, sf)[2].select("doc", "idx", "prop", "expected", "actual")


_AGG = f"""WITH {DEV_SQL}, fnd AS (SELECT doc, 'style.wrong' AS code, CASE WHEN first(needs_review ORDER BY idx) THEN 'warn' ELSE 'error' END AS severity, '/styles/paragraph/' || want AS rule_id, want AS expected, style_name AS actual, count(*) AS n, min(idx) AS idx FROM wr GROUP BY doc, role, style_name, want
UNION ALL SELECT doc, 'style.' || prop, 'error', pointer, expected, first(actual ORDER BY idx), count(*), min(idx) FROM dev GROUP BY doc, role, prop, pointer, expected, bkey)"""


def findings(spark, sf):
    c, roles, d = deviations(spark, sf)
    return LI.aggregate_deviations(LI.wrong_styles(c, roles), d)


@query("p7_aggregated_findings", _AGG + " SELECT doc, code, severity, rule_id, expected, actual, n, idx FROM fnd")
def p7(spark, sf):
    return findings(spark, sf)


@query("p8_list_checks", """WITH li AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc, l_linenumber AS idx, l_linenumber % 3 AS level, CASE l_returnflag WHEN 'A' THEN '•' ELSE '-' END AS marker, l_linenumber * 360 AS ind FROM lineitem)
SELECT doc, 'list.marker' AS code, '/lists/bullet/level' || level || '/marker' AS rule_id, min(idx) AS idx FROM li WHERE marker <> '•' GROUP BY doc, level
UNION ALL SELECT doc, 'list.indent_left', '/lists/bullet/level' || level || '/indent_left', min(idx) FROM li WHERE level < 2 AND round_even(ind / 14.4, 0) <> 25 * (level + 1) GROUP BY doc, level""")
def p8(spark, sf):
    items = table(spark, sf, "lineitem").selectExpr("cast(l_orderkey as string) as doc", "l_linenumber as idx", "'bullet' as kind", "l_linenumber % 3 as level", "if(l_returnflag = 'A', '•', '-') as marker",
                                                    "l_linenumber * 360 as indent_left", "cast(null as int) as indent_hanging")
    one = table(spark, sf, "region").limit(1)
    r = one.selectExpr("inline(array(" + ", ".join([f"struct('/lists/bullet/level{k}/marker' as pointer, 'error' as severity, 's:•' as bkey, '•' as value)" for k in range(3)] + [
        f"struct('/lists/bullet/level{k}/indent_left' as pointer, 'warn' as severity, 'len:{25 * (k + 1)}' as bkey, '{360 * (k + 1)}' as value)" for k in range(2)]) + "))")
    return LI.list_checks(items, r).select("doc", "code", "rule_id", "idx")


@query("p9_header_checks", """SELECT CAST(o_custkey AS VARCHAR) AS doc, 'hdrftr.text' AS code, '/hdrftr/header/default/text' AS rule_id, p AS actual FROM (SELECT o_custkey, min(o_orderpriority) AS p FROM orders GROUP BY 1) WHERE p <> '1-URGENT'
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'hdrftr.missing', '/hdrftr/header/default/text', NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'hdrftr.missing', '/hdrftr/footer/default/text', NULL FROM customer""")
def p9(spark, sf):
    docs = table(spark, sf, "customer").selectExpr("cast(c_custkey as string) as doc")
    slots = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("doc")).agg(F.min("o_orderpriority").alias("text")).withColumn("pointer", F.lit("/hdrftr/header/default/text"))
    r = table(spark, sf, "region").limit(1).selectExpr("inline(array(struct('/hdrftr/header/default/text' as pointer, 'error' as severity, '1‐URGENT' as value), struct('/hdrftr/footer/default/text' as pointer, 'warn' as severity, 'Page' as value)))")
    return LI.header_checks(docs, slots, r).select("doc", "code", "rule_id", "actual")


# account lines of customers; three fields known by the wording around them
def account_lines(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "cast(c_custkey as string) as doc", "inline(array(struct(0 as idx, concat('Account No. ', c_name) as text, cast(null as string) as sdt_tag), struct(1 as idx, if(c_custkey % 5 = 0, 'Segment  desk', concat('Segment ', c_mktsegment, ' desk')) as text, cast(null as string) as sdt_tag),"
        " struct(2 as idx, if(c_custkey % 3 = 0, '', c_mktsegment) as text, if(c_custkey % 2 = 0, 'plenum.owner', cast(null as string)) as sdt_tag)))").withColumn("is_placeholder", F.lit(False))


def frames(spark, sf):
    return table(spark, sf, "region").limit(1).selectExpr("inline(array(struct('account' as name, 'Account No.' as prefix, '' as suffix), struct('segment' as name, 'Segment' as prefix, 'desk' as suffix)))")


_PV = """SELECT CAST(c_custkey AS VARCHAR) AS doc, 'account' AS name, 0 AS idx, c_name AS value FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'segment', 1, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'owner', 2, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END FROM customer WHERE c_custkey % 2 = 0"""


@query("p10_placeholder_values", _PV)
def p10(spark, sf):
    return LI.placeholder_values(account_lines(spark, sf), frames(spark, sf))


@query("p11_placeholder_checks", f"""WITH pv AS ({_PV}), rq AS (SELECT CAST(c_custkey AS VARCHAR) AS doc, c_custkey % 2 = 0 AS ctl, n AS name FROM customer, (VALUES ('account'), ('segment'), ('owner'), ('signature')) t(n)),
ab AS (SELECT rq.*, NOT ctl AND name = 'owner' AS blind FROM rq ANTI JOIN pv USING (doc, name))
SELECT doc, 'placeholder.empty' AS code, '/placeholders/' || name AS rule_id, 1 AS n FROM pv WHERE value = ''
UNION ALL SELECT doc, 'placeholder.missing', '/placeholders/' || name, 1 FROM ab WHERE NOT blind
UNION ALL SELECT doc, 'placeholder.unverifiable', '/placeholders', count(*) FROM ab WHERE blind GROUP BY doc""")
def p11(spark, sf):
    b = account_lines(spark, sf)
    req = table(spark, sf, "region").limit(1).selectExpr("inline(array(struct('account' as name, true as framed, true as inferred), struct('segment' as name, true as framed, true as inferred), struct('owner' as name, false as framed, true as inferred), struct('signature' as name, false as framed, false as inferred)))")
    return LI.placeholder_checks(b, LI.placeholder_values(b, frames(spark, sf)), req, b.where("sdt_tag is not null")).select("doc", "code", "rule_id", "n")


@query("p12_section_checks", """WITH h AS (SELECT l_orderkey, l_returnflag AS key, min(l_linenumber) AS idx FROM lineitem GROUP BY ALL), d AS (SELECT DISTINCT l_orderkey FROM lineitem), r AS (SELECT * FROM (VALUES (0, 'A'), (1, 'N'), (2, 'R')) t(pos, key)),
j AS (SELECT d.l_orderkey, pos, r.key, idx FROM d CROSS JOIN r LEFT JOIN h ON h.l_orderkey = d.l_orderkey AND h.key = r.key), p AS (SELECT l_orderkey, string_agg(key, ' > ' ORDER BY pos) AS w, string_agg(key, ' > ' ORDER BY idx, key) AS s FROM j WHERE idx IS NOT NULL GROUP BY 1)
SELECT CAST(l_orderkey AS VARCHAR) AS doc, 'structure.section_missing' AS code, key AS expected, NULL AS actual FROM j WHERE idx IS NULL UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'structure.section_order', w, s FROM p WHERE w <> s""")
def p12(spark, sf):
    h = table(spark, sf, "lineitem").selectExpr("cast(l_orderkey as string) as doc", "l_linenumber as idx", "l_returnflag as key")
    req = table(spark, sf, "region").limit(1).selectExpr("inline(array(struct(0 as pos, 'A' as key), struct(1 as pos, 'N' as key), struct(2 as pos, 'R' as key)))")
    return LI.section_checks(h, h, req).select("doc", "code", "expected", "actual")


# required wording: the first line of each benchmark passage
_WORDING = "SELECT slot, wtext FROM (SELECT item_id * 100 + unnest(range(len(s))) AS slot, unnest(s) AS wtext FROM (SELECT item_id, string_split(text, chr(10)) AS s FROM benchmark)) WHERE wtext <> ''"


def wording(spark, sf):
    """Every line of every passage is required wording."""
    cut = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return cut.where("text <> ''").select((F.col("item_id") * 100 + F.col("line")).alias("slot"), "text")


_BOIL = f"""WITH {LINES_SQL}, w AS ({_WORDING}), hit AS (SELECT doc, slot, bool_or({exact_sql('text')} = {exact_sql('wtext')}) AS exact FROM tb JOIN w ON {match_sql('text')} = {match_sql('wtext')} GROUP BY ALL)"""


# the other side's levenshtein counts bytes: letters beyond ASCII become control signs, which no text here holds, one for one
_WIDE = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"


def _narrow(col):
    return f"translate({col}, '{_WIDE}', {' || '.join(f'chr({i})' for i in range(1, 9))} || {' || '.join(f'chr({i})' for i in range(14, 14 + len(_WIDE) - 8))})"


@query("p14_near_misses", f"""WITH {LINES_SQL}, w AS (SELECT slot, {_narrow(match_sql('wtext'))} AS wk FROM ({_WORDING})), b AS (SELECT doc, idx, {_narrow(match_sql('text'))} AS bk FROM tb),
p AS (SELECT doc, idx, slot, round(1 - levenshtein(bk, wk) / greatest(length(bk), length(wk)), 9) AS ratio FROM b JOIN w ON abs(length(bk) - length(wk)) < 0.2 * greatest(length(bk), length(wk)) AND bk <> wk)
SELECT doc, slot, round(max(ratio), 6) AS ratio FROM p WHERE ratio > 0.8 GROUP BY ALL""")
def p14(spark, sf):
    return LI.near_misses(lines(spark, sf), wording(spark, sf)).select("doc", "slot", F.round("ratio", 6).alias("ratio"))


_NEAR = f"""nw AS (SELECT slot, {_narrow(match_sql('wtext'))} AS wk FROM ({_WORDING})), nb AS (SELECT DISTINCT doc, {_narrow(match_sql('text'))} AS bk FROM tb),
near AS (SELECT DISTINCT doc, slot FROM nb JOIN nw ON abs(length(bk) - length(wk)) < 0.2 * greatest(length(bk), length(wk)) AND bk <> wk
  WHERE round(1 - levenshtein(bk, wk) / greatest(length(bk), length(wk)), 9) > 0.8)"""


@query("p13_boilerplate", _BOIL + f", {_NEAR} SELECT CAST(doc_id AS VARCHAR) AS doc, CASE WHEN exact IS NULL AND near.slot IS NULL THEN 'structure.boilerplate_missing' ELSE 'structure.boilerplate_altered' END AS code, CASE WHEN exact IS NULL AND near.slot IS NULL THEN 'warn' ELSE 'error' END AS severity, '/skeleton/slots/' || w.slot AS rule_id FROM documents CROSS JOIN w LEFT JOIN hit ON hit.doc = CAST(doc_id AS VARCHAR) AND hit.slot = w.slot LEFT JOIN near ON near.doc = CAST(doc_id AS VARCHAR) AND near.slot = w.slot WHERE NOT coalesce(exact, false)")
def p13(spark, sf):
    b = lines(spark, sf)
    return LI.boilerplate_checks(b, b, wording(spark, sf), LI.near_misses(b, wording(spark, sf))).select("doc", "code", "severity", "rule_id")


@query("p15_pattern_checks", f"WITH pv AS ({_PV}) SELECT doc, CASE WHEN name = 'account' THEN 'placeholder.pattern' ELSE 'placeholder.bad_pattern' END AS code, value AS actual FROM pv WHERE (name = 'account' AND NOT regexp_matches(value, '^Customer#\\d{{8}}[0-7]$')) OR (name = 'segment' AND value <> '')")
def p15(spark, sf):
    v = LI.placeholder_values(account_lines(spark, sf), frames(spark, sf))
    pats = table(spark, sf, "region").limit(1).selectExpr("inline(array(struct('account' as name, '^Customer#[0-9]{8}[0-7]$' as pattern), struct('segment' as name, '(' as pattern)))")
    return LI.pattern_checks(v, pats).select("doc", "code", "actual")


@query("p16_structure_severity", _BOIL + f", {_NEAR} SELECT CASE WHEN exact IS NULL AND near.slot IS NULL THEN 'structure.boilerplate_missing' ELSE 'structure.boilerplate_altered' END AS code, CASE WHEN exact IS NULL AND near.slot IS NULL THEN 'info' ELSE 'error' END AS severity, count(*) AS n FROM documents CROSS JOIN w LEFT JOIN hit ON hit.doc = CAST(doc_id AS VARCHAR) AND hit.slot = w.slot LEFT JOIN near ON near.doc = CAST(doc_id AS VARCHAR) AND near.slot = w.slot WHERE NOT coalesce(exact, false) GROUP BY ALL")
def p16(spark, sf):
    b = lines(spark, sf)
    f = LI.boilerplate_checks(b, b, wording(spark, sf), LI.near_misses(b, wording(spark, sf)))
    return f.groupBy("code", LI.structure_severity(F.col("code"), {"structure.boilerplate_missing": "info"}).alias("severity")).agg(F.count("*").alias("n"))


@query("p20_edit_plan", f"""WITH {P_SQL} SELECT cl.doc, cl.idx, CASE WHEN style_name <> want THEN 'set-style ' || want || '; ' ELSE '' END || CASE WHEN alignment IS NOT NULL THEN 'strip-para keep sectPr,pageBreakBefore; ' ELSE '' END || 'strip-run keep span emphasis' AS ops FROM cl JOIN rm USING (role) WHERE role NOT IN ('empty', 'placeholder')""")
def p20(spark, sf):
    c = settle(classified(spark, sf)).withColumn("has_tabs", F.lit(False)).withColumn("has_ppr", F.col("alignment").isNotNull())
    return LI.edit_plan(c, roles_to_styles(spark, sf, c)).select("doc", "idx", F.array_join("ops", "; ").alias("ops"))


_REP = """SELECT CAST(page_id AS VARCHAR) AS doc, count(CASE WHEN severity = 'error' THEN 1 END) AS errors, count(CASE WHEN severity = 'warn' THEN 1 END) AS warnings, CASE WHEN count(CASE WHEN severity = 'error' THEN 1 END) > 0 THEN 1 ELSE 0 END AS exit_code FROM pages LEFT JOIN fnd ON fnd.doc = CAST(page_id AS VARCHAR) GROUP BY ALL"""


@query("p21_report", f"{_AGG} {_REP}")
def p21(spark, sf):
    docs = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("doc"))
    return LI.report(findings(spark, sf), docs).select("doc", "errors", "warnings", "exit_code")


@query("a17_findings_json", _AGG + " SELECT doc, CASE WHEN bool_or(severity = 'error') THEN 1 ELSE 0 END AS exit_code, CAST(count(*) AS INT) AS n_findings, first(code ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, idx, code) AS first_code FROM fnd GROUP BY doc")
def a17(spark, sf):
    j = LI.findings_json(findings(spark, sf))
    return j.select("doc", "exit_code", "n_findings", F.get_json_object("json", "$.findings[0].code").alias("first_code"))
