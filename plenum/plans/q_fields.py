"""Declared fields: letters drafted per customer, cells of order tables, near-copies of a form."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import keys as K
from plenum.operators import byexample as BX
from plenum.operators import fields as FI
from plenum.plans.q_text import collapse_sql
from plenum.plans.registry import query, table
from plenum.skew import spread

# lines of a letter, valid in both dialects
LETTER = [
    "'Dear {{full_name*|Full name}} of ' || c_name || ','",
    "'Your segment is «Segment» and code ###Code###, ' || c_mktsegment",
    "'{{check: vip}} VIP {{choice: status | Draft, Final}} {{number: balance}} {{date: due}}'",
    "CASE WHEN c_custkey % 3 = 0 THEN '[Job Title] and {{a b c d e f g}} [see appendix]' ELSE 'no fields here' END",
    "'{{items.material|Used material}} | {{items.quantity}} | {{check: items.returned}}'",
    "CASE WHEN c_custkey % 2 = 0 THEN '{{full_name}} again' ELSE '«full name»' END",
]


def letters(spark, sf):
    entries = ", ".join(f"struct({i} as idx, {e} as text)" for i, e in enumerate(LETTER))
    return spread(table(spark, sf, "customer"), "c_custkey").selectExpr("cast(c_custkey as string) as doc", f"inline(array({entries}))")


LETTER_SQL = "lt AS (" + " UNION ALL ".join(
    f"SELECT CAST(c_custkey AS VARCHAR) AS doc, {i} AS idx, {e} AS text FROM customer" for i, e in enumerate(LETTER)) + ")"


def _q(s: str) -> str:
    return s.replace("'", "''")


_SLUGQ = "substr(coalesce(nullif(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'field'), 1, 48)"
# every marker parsed: (doc, idx, style_no, pos, raw, kind, name, required, label, choices)
MARK_SQL = f"""{LETTER_SQL},
raws AS ({' UNION ALL '.join(f"SELECT doc, idx, {i} AS sn, '{s}' AS style, unnest(regexp_extract_all(text, '{_q(p)}')) AS raw, generate_subscripts(regexp_extract_all(text, '{_q(p)}'), 1) AS pos, '{_q(p)}' AS pat FROM lt" for i, (s, p) in enumerate(FI.MARKERS))}),
inn AS (SELECT *, trim(CASE sn {' '.join(f"WHEN {i} THEN regexp_extract(raw, '{_q(p)}', 1)" for i, (s, p) in enumerate(FI.MARKERS))} END) AS inner_text FROM raws),
gr AS (SELECT *, regexp_extract(inner_text, '(?i)^\\s*(?:choice|select|pick)\\s*:\\s*([^|]+?)\\s*(?:\\|\\s*(.*?))?\\s*$', 1) AS ch,
  regexp_extract(inner_text, '(?i)^\\s*(?:choice|select|pick)\\s*:\\s*([^|]+?)\\s*(?:\\|\\s*(.*?))?\\s*$', 2) AS opts,
  lower(regexp_extract(inner_text, '{FI.TYPED}', 1)) AS ty, regexp_extract(inner_text, '{FI.TYPED}', 2) AS tb FROM inn),
g2 AS (SELECT *, CASE WHEN ty <> '' THEN tb ELSE inner_text END AS body FROM gr),
g3 AS (SELECT *, trim(CASE WHEN ch <> '' THEN ch ELSE string_split(body, '|')[1] END) AS named,
  CASE WHEN ch <> '' THEN 'choice' WHEN ty IN ('image','img') THEN 'image' WHEN ty IN ('check','checkbox','bool') THEN 'checkbox' WHEN ty = 'date' THEN 'date' WHEN ty IN ('number','num','amount') THEN 'number' ELSE 'text' END AS kind,
  CASE WHEN ch <> '' THEN '' ELSE trim(regexp_extract(body, '\\|(.*)$', 1)) END AS label, CASE WHEN ch <> '' THEN regexp_replace(opts, '\\s*,\\s*', ',', 'g') ELSE '' END AS choices FROM g2),
mk AS (SELECT doc, idx, sn, style, pos, raw, kind, trim(regexp_replace(named, '\\*$', '')) AS name, named LIKE '%*' AS required, label, choices FROM g3),
ml AS (SELECT *, row_number() OVER (PARTITION BY doc, idx ORDER BY sn, pos) - 1 AS ordinal, {_SLUGQ.format(x='name')} AS slug FROM mk
  WHERE name <> '' AND len(string_split(name, ' ')) <= 6 AND NOT regexp_matches(name, '{FI.DOTTED}'))"""


@query("l1_markers", f"WITH {MARK_SQL} SELECT doc, idx, CAST(ordinal AS INT) AS ordinal, style, raw, slug FROM ml")
def l1(spark, sf):
    return FI.markers(letters(spark, sf)).select("doc", "idx", "ordinal", "style", "raw", "slug")


@query("l2_marker_grammar", f"WITH {MARK_SQL} SELECT kind, name, required, label, choices, count(*) AS n FROM ml GROUP BY ALL")
def l2(spark, sf):
    return FI.markers(letters(spark, sf)).groupBy("kind", "name", "required", "label", F.array_join("choices", ",").alias("choices")).agg(F.count("*").alias("n"))


_INSTR = "CASE o_orderkey % 4 WHEN 0 THEN 'MERGEFIELD \"' || o_orderpriority || '\" \\* MERGEFORMAT' WHEN 1 THEN 'DOCPROPERTY Status' WHEN 2 THEN 'SEQ Figure \\* ARABIC' ELSE 'fillin Order.Date' END"


@query("l3_instruction_fields", f"""WITH i AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc, {_INSTR} AS t FROM orders),
n AS (SELECT doc, upper(regexp_extract(t, '{_q(FI.INSTRUCTION)}', 1)) AS source, trim(regexp_extract(t, '{_q(FI.INSTRUCTION)}', 2)) AS name FROM i)
SELECT doc, source, {_SLUGQ.format(x="regexp_replace(name, '^[0-9]{1,3} ?[-.:)] ?', '')")} AS slug FROM n WHERE name <> ''""")
def l3(spark, sf):
    i = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("doc"), F.lit(0).alias("idx"), F.expr(_INSTR.replace("\\", "\\\\")).alias("instruction"))
    return FI.instruction_fields(i).select("doc", "source", "slug")


# order forms as tables: a header row, then one row per line number; empty cells are the fields
_CELL = [("1", "'Order number:'"), ("2", "CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag || ' returned' END"), ("3", "CASE WHEN l_linenumber = 3 THEN '3. Ship date' ELSE '' END")]


def cells(spark, sf):
    entries = ", ".join(f"struct(l_linenumber * 10 + {c} as idx, l_linenumber as row, {c} as col, {e} as text)" for c, e in _CELL)
    # one line per (order, number): keys repeat in the synthetic data
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    return li.selectExpr("cast(l_orderkey as string) as doc", f"inline(array({entries}))").withColumn("tbl", F.lit("t1"))


_CELL_SQL = "lg AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL), ce AS (" + " UNION ALL ".join(
    f"SELECT CAST(l_orderkey AS VARCHAR) AS doc, l_linenumber * 10 + {c} AS idx, l_linenumber AS r, {c} AS c, {e} AS text FROM lg" for c, e in _CELL) + ")"
_RANK = "CASE WHEN regexp_matches(text, '^\\s*\\(?\\d{1,3}\\)?\\s*[-.:)]\\s*\\S') OR text LIKE '%:' THEN 2 WHEN len(string_split(text, ' ')) <= 6 THEN 1 ELSE 0 END"


@query("l5_labels", f"""WITH {_CELL_SQL}, us AS (SELECT *, {_RANK} AS rank FROM ce WHERE text <> ''), fd AS (SELECT * FROM ce WHERE text = ''),
ab AS (SELECT fd.doc, fd.idx, us.text, row_number() OVER (PARTITION BY fd.doc, fd.idx ORDER BY us.r DESC) AS near FROM fd JOIN us ON us.doc = fd.doc AND us.c = fd.c AND us.r < fd.r),
pr AS (SELECT fd.doc, fd.idx, us.text, row_number() OVER (PARTITION BY fd.doc, fd.idx ORDER BY us.idx DESC) AS near FROM fd JOIN us ON us.doc = fd.doc AND us.idx < fd.idx)
SELECT fd.doc, fd.idx, coalesce(ab.text, pr.text, '') AS label FROM fd LEFT JOIN ab ON ab.doc = fd.doc AND ab.idx = fd.idx AND ab.near = 1 LEFT JOIN pr ON pr.doc = fd.doc AND pr.idx = fd.idx AND pr.near = 1""")
def l5(spark, sf):
    b = cells(spark, sf)
    return FI.labels(b.where("text = ''").select("doc", "idx"), b)


_BOX = "CASE WHEN p_size % 2 = 0 THEN '☐ ' || p_name || ' ☐ ' || p_type ELSE p_name || ' ☐ ' || p_type || ' ☐' END"


@query("l6_checkbox_labels", """SELECT CAST(p_partkey AS VARCHAR) AS doc, o AS ordinal, CASE WHEN p_size % 2 = 0 THEN 'after' ELSE 'before' END AS side, CASE WHEN o = 0 THEN p_name ELSE p_type END AS label FROM part, range(0, 2) t(o)""")
def l6(spark, sf):
    b = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("doc"), F.lit(0).alias("idx"), F.expr(_BOX).alias("text"))
    return FI.checkbox_labels(b).select("doc", "ordinal", "side", "label")


_ALT = "CASE page_id % 3 WHEN 0 THEN '{{image: logo | The logo}}' WHEN 1 THEN 'a photo of {{headshot*}} here' ELSE '[A Note] on ' || url END"


@query("l7_picture_fields", """SELECT CAST(page_id AS VARCHAR) AS doc, CASE page_id % 3 WHEN 0 THEN 'logo' ELSE 'headshot' END AS slug, 'image' AS kind, page_id % 3 = 1 AS required,
 CASE page_id % 3 WHEN 0 THEN 'The logo' ELSE '' END AS label FROM pages WHERE page_id % 3 < 2""")
def l7(spark, sf):
    alts = table(spark, sf, "pages").selectExpr("cast(page_id as string) as doc", f"inline(array(struct(0 as idx, {_ALT} as text), struct(1 as idx, {_ALT} as text)))")
    return FI.picture_fields(alts).select("doc", "slug", "kind", "required", "label")


@query("l8_repeat_columns", f"""WITH {MARK_SQL}, d AS (SELECT *, regexp_extract(name, '{FI.DOTTED}', 1) AS c1, trim(regexp_extract(name, '{FI.DOTTED}', 2)) AS c2 FROM mk WHERE regexp_matches(name, '{FI.DOTTED}'))
SELECT doc, lower(c1) AS collection, lower(c2) AS "column", min(kind) AS kind, coalesce(nullif(min(label), ''), upper(min(c2)[1]) || lower(min(c2)[2:])) AS label FROM d GROUP BY doc, c1, c2""")
def l8(spark, sf):
    return FI.repeats(letters(spark, sf)).select("doc", "collection", "column", "kind", "label")


@query("l9_field_list", f"""WITH {MARK_SQL}, v AS (SELECT *, CASE WHEN slug = 'segment' THEN 'known' WHEN slug = 'code' THEN '____' ELSE '' END AS value FROM ml),
u AS (SELECT *, row_number() OVER (PARTITION BY doc, slug ORDER BY idx, ordinal) AS nth FROM v)
SELECT doc, CASE WHEN nth = 1 THEN slug ELSE slug || '_' || nth END AS name, kind, value NOT IN ('', '____') AS filled, value IN ('', '____') AND kind <> 'checkbox' AS unfilled FROM u""")
def l9(spark, sf):
    found = FI.markers(letters(spark, sf)).withColumn("value", F.when(F.col("slug") == "segment", "known").when(F.col("slug") == "code", "____").otherwise(""))
    return FI.field_list(found).select("doc", "name", "kind", "filled", "unfilled")


# filled copies of one form per nation: the smallest customer is the base
def copies(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "cast(c_nationkey as string) as form", "cast(c_custkey as string) as doc",
        "inline(array(struct(0 as idx, 'Account holder: ' || c_name as text), struct(1 as idx, 'Market segment: ' || c_mktsegment || ' (main)' as text),"
        " struct(2 as idx, 'Balance due: ' || cast(cast(c_acctbal as decimal(12,2)) as string) as text), struct(3 as idx, 'Opened on 2024-01-' || lpad(cast(c_custkey % 28 + 1 as string), 2, '0') as text),"
        " struct(4 as idx, 'Unchanged wording.' as text)))")


def bases(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("form")).agg(F.min("c_custkey").cast("string").alias("doc"))


@query("k1_changed_blocks", """WITH c AS (SELECT c_nationkey AS form, 0 AS idx, c_custkey, 'Account holder: ' || c_name AS text FROM customer UNION ALL SELECT c_nationkey, 1, c_custkey, 'Market segment: ' || c_mktsegment || ' (main)' FROM customer
 UNION ALL SELECT c_nationkey, 2, c_custkey, 'Balance due: ' || CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) FROM customer UNION ALL SELECT c_nationkey, 3, c_custkey, 'Opened on 2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') FROM customer)
SELECT CAST(form AS VARCHAR) AS form, idx, first(text ORDER BY c_custkey) AS base, count(*) AS copies FROM c GROUP BY form, idx HAVING min(text) <> max(text)""")
def k1(spark, sf):
    return BX.compare_copies(copies(spark, sf), bases(spark, sf))


_SPANS = """c AS (SELECT c_nationkey AS form, 0 AS idx, c_custkey, 'Account holder: ' AS a, c_name AS v, '' AS z, 'text' AS kind, 'account_holder' AS name FROM customer
 UNION ALL SELECT c_nationkey, 1, c_custkey, 'Market segment: ', c_mktsegment, ' (main)', 'text', 'market_segment' FROM customer
 UNION ALL SELECT c_nationkey, 2, c_custkey, 'Balance due: ', CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR), '', 'number', 'balance_due' FROM customer
 UNION ALL SELECT c_nationkey, 3, c_custkey, 'Opened on ', '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0'), '', 'date', 'opened_on' FROM customer),
g AS (SELECT CAST(form AS VARCHAR) AS form, idx, first(a ORDER BY c_custkey) AS label, first(v ORDER BY c_custkey) AS v, first(z ORDER BY c_custkey) AS z, first(kind) AS kind, first(name) AS name FROM c GROUP BY form, idx HAVING min(v) <> max(v))"""


@query("k2_varying_spans", f"WITH {_SPANS} SELECT form, idx, label || v || z AS base, length(label) AS start, length(label) + length(v) AS stop, label FROM g")
def k2(spark, sf):
    return BX.varying_spans(copies(spark, sf), bases(spark, sf))


@query("k3_marked_template", f"""WITH {_SPANS} SELECT form, idx, length(label) AS start, length(label) + length(v) AS stop, kind, name,
 '{{{{' || CASE kind WHEN 'text' THEN '' ELSE kind || ': ' END || name || '}}}}' AS marker FROM g""")
def k3(spark, sf):
    return BX.name_spans(BX.varying_spans(copies(spark, sf), bases(spark, sf))).select("form", "idx", "start", "stop", "kind", "name", "marker")
