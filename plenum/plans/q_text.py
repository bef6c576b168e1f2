"""Text keys, block sources and per-block lexical features over documents, pages and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import codec, pointers
from plenum.functions import keys as K
from plenum.operators import features as FE
from plenum.plans.registry import query, table
from plenum.skew import spread
from plenum.sources import text as X

SPACE = r"[\s\p{Z}]+"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def match_sql(x: str) -> str:
    no_cf = f"regexp_replace({x}, '\\p{{Cf}}', '', 'g')"
    folded = f"translate({no_cf}, '‐‑‒–—―−‘’‚‛“”„«»', '-------''''''''\"\"\"\"\"')"
    return collapse_sql(f"replace({folded}, '…', '...')")


def exact_sql(x: str) -> str:
    return collapse_sql(f"nfc_normalize(regexp_replace({x}, '\\p{{Cf}}', '', 'g'))")


def heading_sql(x: str) -> str:
    m = match_sql(x)
    bare = f"regexp_replace({m}, '^\\s*(?:\\d+(?:\\.\\d+)*|[IVXLC]+|[A-Za-z])[.)]?(?:\\s+|\\s*[-–]\\s*)(\\S)', '\\1')"
    return f"lower(coalesce(nullif({bare}, ''), {m}))"


LINES_SQL = """tb AS (SELECT CAST(doc_id AS VARCHAR) AS doc, lang, source, generate_subscripts(ls, 1) - 1 AS idx, unnest(ls) AS text
  FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents))"""

# the page cut at block-level tags, as rows of (doc, pos, tag, raw)
_TAGS = X.BLOCK_TAGS + "|" + X.EDGE_TAGS
_ENT = "regexp_replace(raw, '<[^>]*>', '', 'gs')"
for _e, _c in X.ENTITIES:
    _ENT = "replace({}, '{}', '{}')".format(_ENT, _e, _c.replace("'", "''"))
_STYLE = "CASE " + " ".join(f"WHEN tag = '{t}' THEN '{s}'" for t, s in X.TAG_STYLES.items()) + " ELSE 'normal' END"
HTML_SQL = f"""cut AS (SELECT CAST(page_id AS VARCHAR) AS doc, string_split(regexp_replace(
    regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script.*?</script>|<style.*?</style>', '', 'gsi'),
    '<(/?)({_TAGS})(\\s[^>]*)?>', chr(1) || '\\1\\2' || chr(2), 'gsi'), chr(1)) AS ps FROM pages),
pieces AS (SELECT doc, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS piece FROM cut),
flow AS (SELECT doc, pos, lower(string_split(piece, chr(2))[1]) AS tag, string_split(piece, chr(2))[2] AS raw
  FROM pieces WHERE pos > 0),
parted AS (SELECT *, last_value(CASE WHEN tag IN ('head','nav','article','footer') THEN tag
    WHEN tag IN ('/head','/nav','/article','/footer') THEN 'body' END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos
    ROWS UNBOUNDED PRECEDING) AS part FROM flow),
hb AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS idx, part, tag, {_STYLE} AS style_name,
  regexp_matches(raw, '(?i)<b[\\s>]') AS bold, {collapse_sql(_ENT)} AS text
  FROM parted WHERE regexp_full_match(tag, '{X.BLOCK_TAGS}'))"""


def lines(spark, sf):
    return X.text_blocks(spread(table(spark, sf, "documents"), "doc_id"), F.col("doc_id").cast("string"), F.col("text"), "lang", "source")


def page_blocks(spark, sf):
    return X.html_blocks(table(spark, sf, "pages"), F.col("page_id").cast("string"), F.col("html"))


_STEM = "coalesce(nullif(regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '[^/]*$'), '(.)\\.[^.]*$', '\\1'), ''), 'doc')"


@query("a2_doc_ids", f"""WITH s AS (SELECT url, {_STEM} AS stem FROM pages)
SELECT url, stem, CASE WHEN rn = 1 THEN stem ELSE stem || '#' || rn END AS doc
FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY path) AS rn
      FROM (SELECT *, regexp_replace(url, '[?#].*$', '') || chr(0) || url AS path FROM s))""")
def a2(spark, sf):
    pages = table(spark, sf, "pages").select("url", F.regexp_replace("url", "[?#].*$", "").alias("bare"))
    # the query string is not part of the file name; the full url settles the order of equal paths
    df = X.with_doc_ids(pages.withColumn("path", F.col("bare")), "path", ["bare", "url"])
    return df.select("url", "stem", "doc")


@query("a4_text_blocks", f"WITH {LINES_SQL} SELECT doc, CAST(idx AS INT) AS idx, text, {collapse_sql('text')} = '' AS is_empty FROM tb")
def a4(spark, sf):
    return lines(spark, sf).select("doc", "idx", "text", "is_empty")


@query("a5_html_blocks", f"WITH {HTML_SQL} SELECT doc, CAST(idx AS INT) AS idx, part, tag, style_name, bold, text FROM hb")
def a5(spark, sf):
    return page_blocks(spark, sf).select("doc", F.col("idx").cast("int").alias("idx"), "part", "tag", "style_name", "bold", "text")


@query("a6_turn_blocks", f"""SELECT CAST(conv_id AS VARCHAR) AS doc, CAST(turn AS INT) AS idx, role AS kind,
 lower({match_sql('text')}) AS key FROM conversations""")
def a6(spark, sf):
    return X.turn_blocks(table(spark, sf, "conversations")).select("doc", "idx", "kind", "key")


@query("a8_document_text", f"""WITH {LINES_SQL} SELECT doc, string_agg(text, chr(10) ORDER BY idx) AS text FROM tb
 WHERE {collapse_sql('text')} <> '' AND NOT starts_with(text, 'La ') GROUP BY doc""")
def a8(spark, sf):
    # lines opening with "La " stand for a deleted revision
    b = lines(spark, sf).select("doc", "idx", "text", F.lit("p").alias("kind"),
                                F.startswith("text", F.lit("La ")).alias("in_del"), F.lit(False).alias("is_placeholder"))
    return X.document_text(b)


@query("b1_match_key", f"WITH {LINES_SQL} SELECT {match_sql('text')} AS key, count(*) AS n FROM tb GROUP BY ALL")
def b1(spark, sf):
    return lines(spark, sf).groupBy(K.match_key(F.col("text")).alias("key")).agg(F.count("*").alias("n"))


@query("b2_exact_key", f"WITH {LINES_SQL} SELECT {exact_sql('text')} AS key, count(*) AS n FROM tb GROUP BY ALL")
def b2(spark, sf):
    return lines(spark, sf).groupBy(K.exact_key(F.col("text")).alias("key")).agg(F.count("*").alias("n"))


_NUMBERED = "CASE page_id % 4 WHEN 0 THEN '2.' || page_id || ' ' WHEN 1 THEN 'IV. ' WHEN 2 THEN 'A) ' ELSE '' END"


@query("b3_heading_key", f"""WITH {HTML_SQL}, h AS (SELECT doc, CASE CAST(doc AS INT) % 4 WHEN 0 THEN '2.' || doc || ' '
 WHEN 1 THEN 'IV. ' WHEN 2 THEN 'A) ' ELSE '' END || text AS text FROM hb WHERE tag = 'h1')
SELECT doc, {heading_sql('text')} AS key FROM h""")
def b3(spark, sf):
    typed = F.expr("CASE cast(doc as int) % 4 WHEN 0 THEN '2.' || doc || ' ' WHEN 1 THEN 'IV. ' WHEN 2 THEN 'A) ' ELSE '' END || text")
    return page_blocks(spark, sf).where("tag = 'h1'").select("doc", K.heading_key(typed).alias("key"))


_SLUG = "regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_Q = "CAST(p_partkey % 97 AS VARCHAR) || ') ' || p_name"


@query("b4_slugs", f"""SELECT p_partkey, coalesce(nullif({_SLUG.format(x="p_name || ' ' || p_brand")}, ''), 'field') AS slug,
 coalesce(nullif(substr({_SLUG.format(x=f"regexp_replace({_Q}, '^[(]?[0-9]{{1,3}}[)]?[ ]*[-‐‒-―.:)]?[ ]*', '')")}, 1, 48), ''), 'field') AS question,
 lower({collapse_sql("p_type || '   ' || p_name")}) AS style,
 list_aggregate(list_transform(string_split(replace(p_name, ' ', '_'), '_'), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') AS human,
 substr(CASE WHEN regexp_matches(p_brand, '^[A-Za-z]') THEN '' ELSE 'b' END || regexp_replace(p_brand, '[^A-Za-z0-9_]', '_', 'g'), 1, 40) AS bookmark
FROM part""")
def b4(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", K.slug(F.expr("p_name || ' ' || p_brand")).alias("slug"),
        K.question_slug(F.expr("cast(p_partkey % 97 as string) || ') - ' || p_name")).alias("question"),
        K.style_key(F.expr("p_type || '   ' || p_name")).alias("style"),
        K.humanise(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("human"),
        K.bookmark(F.col("p_brand")).alias("bookmark"))


def _mask_sql(x: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace(substr({x}, 1, 40), '\\p{{Lu}}', 'A', 'g'), "
            f"'\\p{{Ll}}', 'a', 'g'), '\\p{{Nd}}', '0', 'g')")


@query("b5_mask", f"SELECT {_mask_sql('url')} AS shape, count(*) AS n FROM pages GROUP BY ALL")
def b5(spark, sf):
    return table(spark, sf, "pages").groupBy(K.mask(F.col("url")).alias("shape")).agg(F.count("*").alias("n"))


# columns whose values are shown as shapes
SHAPED = ("'c_name', c_name, 'c_mktsegment', c_mktsegment, 'c_acctbal', cast(c_acctbal as string)")
_SHAPED_SQL = """vals AS (SELECT 'c_name' AS col, c_name AS value FROM customer
 UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer
 UNION ALL SELECT 'priority', o_orderpriority FROM orders)"""


@query("b5_shapes_of", f"""WITH {_SHAPED_SQL}, d AS (SELECT DISTINCT col, value FROM vals),
five AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY value) AS rn FROM d) WHERE rn <= 5),
m AS (SELECT col, {_mask_sql('value')} AS shape, min(rn) AS first_rn FROM five GROUP BY ALL)
SELECT col, shape FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY first_rn) AS k FROM m WHERE shape <> '') WHERE k <= 2""")
def b5_shapes(spark, sf):
    cust, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    vals = cust.selectExpr("stack(2, 'c_name', c_name, 'c_mktsegment', c_mktsegment) as (col, value)").unionByName(
        orders.selectExpr("'priority' as col", "o_orderpriority as value"))
    return FE.shapes_of(vals, ["col"], "value").select("col", "shape")


# measures derived from prices: what a profile writes must read back
_MEASURES = """m AS (
 SELECT l_orderkey, l_linenumber, '/page/primary/margins/left' AS pointer, CAST(floor(l_extendedprice / 10) AS BIGINT) AS raw, CAST(NULL AS VARCHAR) AS rule FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber, '/styles/paragraph/normal/run/size', CAST(l_quantity AS BIGINT), NULL FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber, '/styles/paragraph/normal/para/line_spacing', CAST(l_quantity AS BIGINT) * 12,
   CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'atLeast' ELSE 'auto' END FROM lineitem)"""


def _short_sql(x: str) -> str:
    return f"regexp_replace(CAST(CAST(round({x}, 4) AS DECIMAL(18,4)) AS VARCHAR), '\\.?0+$', '')"


@query("b6_measures", f"""WITH {_MEASURES}, e AS (SELECT pointer, raw, rule, CASE
  WHEN pointer LIKE '%/left' AND abs(raw) >= 720 AND abs(raw) * 100 % 1440 = 0 THEN {_short_sql('raw / 1440')} || 'in'
  WHEN pointer LIKE '%/left' THEN {_short_sql('raw / 20')} || 'pt'
  WHEN pointer LIKE '%/size' THEN {_short_sql('raw / 2')} || 'pt'
  WHEN rule = 'auto' THEN {_short_sql('raw / 240')} || 'x'
  ELSE rule || ' ' || {_short_sql('raw / 20')} || 'pt' END AS text FROM m)
SELECT pointer, text, raw, rule, raw AS back, true AS stable, count(*) AS n FROM e GROUP BY ALL""")
def b6(spark, sf):
    li = table(spark, sf, "lineitem")
    m = li.selectExpr("""inline(array(
      named_struct('pointer', '/page/primary/margins/left', 'raw', cast(floor(l_extendedprice / 10) as bigint), 'rule', cast(null as string)),
      named_struct('pointer', '/styles/paragraph/normal/run/size', 'raw', cast(l_quantity as bigint), 'rule', cast(null as string)),
      named_struct('pointer', '/styles/paragraph/normal/para/line_spacing', 'raw', cast(l_quantity as bigint) * 12,
        'rule', case l_returnflag when 'A' then 'exact' when 'N' then 'atLeast' else 'auto' end)))""")
    counted = m.groupBy("pointer", "raw", "rule").agg(F.count("*").alias("n"))
    p, r, u = F.col("pointer"), F.col("raw"), F.col("rule")
    read = counted.withColumn("text", codec.encode(p, r, u)).withColumn("d", codec.decode(p, F.col("text")))
    return read.select("pointer", "text", "raw", "rule", F.col("d.raw").alias("back"),
                       codec.round_trips(p, r, u, F.col("d")).alias("stable"), "n")


@query("b7_pointers", """SELECT '/' || replace(replace(p_type || '/' || p_brand, '~', '~0'), '/', '~1') || '/size' AS pointer,
 p_type || '/' || p_brand AS token, 'size' AS leaf, p_type = 'SMALL' AND p_brand = 'Brand#1' AS is_under, count(*) AS n
FROM part GROUP BY ALL""")
def b7(spark, sf):
    token = F.expr("p_type || '/' || p_brand")
    p = table(spark, sf, "part").groupBy(pointers.ptr(token, F.lit("size")).alias("pointer")).agg(F.count("*").alias("n"))
    tokens = pointers.split(F.col("pointer"))
    return p.select("pointer", tokens[0].alias("token"), F.element_at(tokens, -1).alias("leaf"),
                    pointers.under(F.col("pointer"), "/SMALL~1Brand#1").alias("is_under"), "n")


_NEST = """SELECT c_nationkey AS k, c_mktsegment AS a, count(*) AS n FROM customer GROUP BY ALL"""


@query("b7_nest", f"""WITH c AS ({_NEST}), s AS (SELECT k, '"segments":{{' || string_agg('"' || a || '":' || n, ',' ORDER BY '"' || a || '":' || n) || '}}' AS j FROM c GROUP BY k),
t AS (SELECT k, '"total":' || sum(n) AS j FROM c GROUP BY k)
SELECT CAST(s.k AS VARCHAR) AS doc, '{{' || s.j || ',' || t.j || '}}' AS json FROM s JOIN t USING (k)""")
def b7_nest(spark, sf):
    return pointers.nest(_segment_pointers(spark, sf), "doc", 2)


@query("b7_flatten", f"""WITH c AS ({_NEST}) SELECT CAST(k AS VARCHAR) AS doc, '/segments/' || a AS pointer, CAST(n AS VARCHAR) AS value FROM c
UNION ALL SELECT CAST(k AS VARCHAR), '/total', CAST(sum(n) AS VARCHAR) FROM c GROUP BY k""")
def b7_flatten(spark, sf):
    return pointers.flatten(pointers.nest(_segment_pointers(spark, sf), "doc", 2), "doc", "json", 2)


def _segment_pointers(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    doc = F.col("c_nationkey").cast("string").alias("doc")
    per = c.select(doc, pointers.ptr(F.lit("segments"), F.col("c_mktsegment")).alias("pointer"), F.col("n").alias("json"))
    total = c.groupBy(doc).agg(F.sum("n").alias("json")).select("doc", F.lit("/total").alias("pointer"), "json")
    return per.unionByName(total)


_GLYPHS = [("Symbol", ""), ("Wingdings", ""), ("Symbol", ""), ("Courier New", "o"),
           ("Wingdings", ""), ("Arial", "")]
_FONT = "CASE p_size % 6 " + " ".join(f"WHEN {i} THEN '{f}'" for i, (f, _) in enumerate(_GLYPHS)) + " END"
_GLYPH = "CASE p_size % 6 " + " ".join(f"WHEN {i} THEN '{g}'" for i, (_, g) in enumerate(_GLYPHS)) + " END"


@query("b8_bullets", f"""SELECT font, CASE WHEN lower(font) = 'symbol' THEN translate(g, '', '•✔')
 WHEN lower(font) = 'wingdings' THEN translate(g, '', '▪◆') ELSE g END AS marker, count(*) AS n
FROM (SELECT {_FONT} AS font, {_GLYPH} AS g FROM part) GROUP BY ALL""")
def b8(spark, sf):
    p = table(spark, sf, "part").select(F.expr(_FONT).alias("font"), F.expr(_GLYPH).alias("g"))
    return p.groupBy("font", K.canonical_bullet(F.col("g"), F.col("font")).alias("marker")).agg(F.count("*").alias("n"))


_LETTERS = "regexp_replace(text, '[^\\p{L}]', '', 'g')"


@query("d1_lexical", f"""WITH {LINES_SQL} SELECT doc, CAST(idx AS INT) AS idx,
 CASE WHEN {collapse_sql('text')} = '' THEN 0 ELSE len(string_split({collapse_sql('text')}, ' ')) END AS words,
 regexp_matches({collapse_sql('text')}, '[.!?:;…]$') AS ends_with_terminal,
 regexp_full_match({_LETTERS}, '\\p{{Lu}}+') AS all_caps,
 regexp_matches(text, '(?i)^\\s*(figure|fig\\.?|table|exhibit|chart|plate)\\s*[\\d\\w]') AS caption_lead,
 {collapse_sql('text')} = '' AS is_empty FROM tb""")
def d1(spark, sf):
    return FE.lexical(lines(spark, sf)).select("doc", "idx", "words", "ends_with_terminal", "all_caps", "caption_lead", "is_empty")


@query("d3_body_ordinal", f"""WITH {LINES_SQL} SELECT doc, CAST(idx AS INT) AS idx,
 CASE WHEN {collapse_sql('text')} <> '' THEN sum(CASE WHEN {collapse_sql('text')} <> '' THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc ORDER BY idx) END AS body_ordinal FROM tb""")
def d3(spark, sf):
    b = lines(spark, sf).withColumn("ctx_kind", F.lit("body"))
    return FE.body_ordinal(b).select("doc", "idx", "body_ordinal")
