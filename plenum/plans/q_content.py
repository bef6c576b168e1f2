"""Runs, captions, lists, tables and Markdown over orders, line items and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import content as CO
from plenum.operators import features as FE
from plenum.plans.q_text import HTML_SQL, LINES_SQL, collapse_sql, lines, page_blocks
from plenum.plans.registry import query, table

# pieces of one paragraph per order
_PIECES = [("text", "o_orderpriority", "false"), ("tab", "NULL", "false"), ("text", "'gone'", "true"), ("sym", "NULL", "false"), ("noBreakHyphen", "NULL", "false"),
           ("begin", "NULL", "false"), ("instr", "' SEQ  Fig'", "false"), ("instr", "CASE WHEN o_orderkey % 2 = 0 THEN 'ure \\* ARABIC' ELSE 'TABLE x' END", "false"), ("begin", "NULL", "false"), ("instr", "'PAGE '", "false"), ("end", "NULL", "false"), ("separate", "NULL", "false"), ("instr", "'late'", "false"), ("text", "'3'", "false"), ("end", "NULL", "false"), ("break", "NULL", "false"), ("text", "o_orderstatus", "false"), ("delText", "'x'", "false")]


def pieces(spark, sf):
    e = ", ".join("struct({i} as seq, '{p}' as piece, cast({t} as string) as text, {d} as deleted)".format(i=i, p=p, t=t.replace("\\", "\\\\"), d=d) for i, (p, t, d) in enumerate(_PIECES))
    return table(spark, sf, "orders").selectExpr("cast(o_orderkey as string) as doc", "0 as idx", f"inline(array({e}))")


@query("a7_assemble_text", "SELECT CAST(o_orderkey AS VARCHAR) AS doc, o_orderpriority || chr(9) || '￼-3' || chr(10) || o_orderstatus AS text FROM orders")
def a7(spark, sf):
    return CO.assemble_text(pieces(spark, sf)).select("doc", "text")


@query("a9_field_instructions", "SELECT CAST(o_orderkey AS VARCHAR) AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 'SEQ Figure \\* ARABICPAGE' ELSE 'SEQ FigTABLE xPAGE' END AS instruction FROM orders")
def a9(spark, sf):
    return CO.field_instructions(pieces(spark, sf)).select("doc", "instruction")


@query("d2_sequence_kind", "SELECT CAST(o_orderkey AS VARCHAR) AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 'Figure' ELSE 'Figtable' END AS seq_kind FROM orders")
def d2(spark, sf):
    return FE.sequence_kind(CO.field_instructions(pieces(spark, sf))).select("doc", "seq_kind")


@query("a12_front_matter", "SELECT CAST(c_custkey AS VARCHAR) AS doc, 'title' AS name, c_name AS value FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'segment', c_mktsegment FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'body', 'Text ' || c_nationkey FROM customer")
def a12(spark, sf):
    t = table(spark, sf, "customer").selectExpr("cast(c_custkey as string) as doc", "concat('---\\ntitle: \"', c_name, '\"\\nsegment: ', c_mktsegment, '\\n---\\nText ', c_nationkey) as text")
    meta, body = CO.front_matter(t)
    return meta.where("error is null").select("doc", "name", "value").unionByName(body.select("doc", F.lit("body").alias("name"), F.col("body").alias("value")))


@query("a13_doc_properties", "SELECT CAST(o_custkey AS VARCHAR) AS doc, o_orderstatus AS name, first(o_orderpriority ORDER BY o_orderkey) AS value FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL")
def a13(spark, sf):
    p = table(spark, sf, "orders").selectExpr("cast(o_custkey as string) as doc", "o_orderstatus as name", "if(o_orderkey % 3 = 0, '  ', o_orderpriority) as value", "o_orderkey as source_order")
    return CO.doc_properties(p)


_TYPE = "CASE (CAST(doc AS INT) + idx) % 5 WHEN 0 THEN 'figure' WHEN 2 THEN 'table' ELSE 'para' END"
_CTEXT = "CASE WHEN idx % 2 = 1 THEN 'Figure 3. ' || text ELSE text END"
_CLAB = "CASE WHEN idx % 2 = 1 AND (CAST(doc AS INT) + idx) % 5 IN (1, 3, 4) THEN 'lab' || idx END"


@query("t1_caption_pairs", f"""WITH {LINES_SQL}, b AS (SELECT doc, idx, {_TYPE} AS type, {_CTEXT} AS text, {_CLAB} AS label FROM tb), c AS (SELECT *, type = 'para' AND regexp_matches(text, '(?i)^\\s*(figure|fig\\.?|table)\\s*[\\d{{]') AS cap, lag(type) OVER w AS pt, lead(type) OVER w AS nt FROM b WINDOW w AS (PARTITION BY doc ORDER BY idx)),
d AS (SELECT *, cap AND coalesce(pt = 'figure', false) AS fig, cap AND NOT coalesce(pt = 'figure', false) AND coalesce(nt = 'table', false) AS tab FROM c), e AS (SELECT *, lead(fig) OVER w AS nf, lag(tab) OVER w AS pb, lead(label) OVER w AS nl, lag(label) OVER w AS pl, lead(text) OVER w AS ntx, lag(text) OVER w AS ptx FROM d WINDOW w AS (PARTITION BY doc ORDER BY idx))
SELECT doc, CAST(idx AS INT) AS idx, CASE WHEN type = 'figure' AND nf THEN ntx WHEN type = 'table' AND pb THEN ptx END AS caption, coalesce(label, CASE WHEN type = 'figure' AND nf THEN nl WHEN type = 'table' AND pb THEN pl END) AS label FROM e WHERE NOT fig AND NOT tab""")
def t1(spark, sf):
    b = lines(spark, sf).select("doc", "idx", F.expr(_TYPE).alias("type"), F.expr(_CTEXT).alias("text"), F.expr(_CLAB).alias("label"))
    return CO.pair_captions(b).select("doc", "idx", "caption", "label")


@query("t2_label_index", """SELECT CAST(o_orderkey AS VARCHAR) AS doc, 'reference' AS what, 'fig:' || o_orderstatus AS label FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'footnote', 'n' || (o_orderkey % 3) FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'label', 'sec:' || o_custkey FROM orders""")
def t2(spark, sf):
    return CO.label_index(table(spark, sf, "orders").selectExpr("cast(o_orderkey as string) as doc", "concat('See [](#fig:', o_orderstatus, ') and[^n', o_orderkey % 3, '] here {#sec:', o_custkey, '}') as text"))


@query("t3_renumber", "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS kind, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber * 1000000 + l_partkey) AS number FROM lineitem")
def t3(spark, sf):
    return CO.renumber(table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_orderkey as doc", "l_returnflag as kind", "l_linenumber * 1000000 + l_partkey as idx")).select("l_orderkey", "l_linenumber", "l_partkey", "kind", "number")


_PAR = " ".join(f"WHEN depth = {k} THEN last_value(CASE WHEN depth = {k - 1} THEN idx END IGNORE NULLS) OVER (PARTITION BY doc, list_id ORDER BY idx ROWS UNBOUNDED PRECEDING)" for k in range(1, 10))


@query("t4_nest_lists", f"""WITH {LINES_SQL}, b AS (SELECT doc, idx, length(text) % 7 <> 0 AS it, length(text) % 5 = 0 AS o, length(text) % 4 AS level FROM tb), c AS (SELECT *, sum(CASE WHEN it AND (NOT coalesce(pi, false) OR po <> o) THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY idx) AS list_id FROM (SELECT *, lag(it) OVER (PARTITION BY doc ORDER BY idx) AS pi, lag(o) OVER (PARTITION BY doc ORDER BY idx) AS po FROM b)),
d AS (SELECT *, row_number() OVER (PARTITION BY doc, list_id ORDER BY idx) AS i FROM c WHERE it), e AS (SELECT *, i + min(CASE WHEN i = 1 THEN 0 ELSE level END - i) OVER (PARTITION BY doc, list_id ORDER BY idx) AS depth FROM d)
SELECT doc, CAST(idx AS INT) AS idx, CAST(list_id AS BIGINT) AS list_id, CAST(depth AS INT) AS depth, CAST(CASE {_PAR} END AS INT) AS parent FROM e""")
def t4(spark, sf):
    b = lines(spark, sf).selectExpr("doc", "idx", "length(text) % 7 <> 0 as is_item", "length(text) % 5 = 0 as ordered", "length(text) % 4 as level")
    return CO.nest_lists(b).select("doc", "idx", "list_id", "depth", "parent")


# an order's lines as rows of a table; the third column is often missing
def cells(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"))).alias("r"))
    return li.select(F.col("l_orderkey").cast("string").alias("doc"), F.posexplode("r").alias("p", "r")).selectExpr(
        "doc", "1 as tbl", "p + 1 as row", "inline(array(struct(1 as col, cast(r.l_partkey as string) as text, 'left' as align), struct(2 as col, r.l_returnflag as text, if(r.l_linestatus = 'O', 'right', 'both') as align), struct(3 as col, if(r.l_linestatus = 'F', 'F', null) as text, 'center' as align)))").where("text is not null")


_CELLS = """cs AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS r, l_partkey, l_returnflag, l_linestatus FROM lineitem), sz AS (SELECT l_orderkey, CASE WHEN bool_or(l_linestatus = 'F') THEN 3 ELSE 2 END AS n, max(r) AS m FROM cs GROUP BY 1),
al AS (SELECT cs.l_orderkey, l_linestatus FROM cs JOIN sz ON sz.l_orderkey = cs.l_orderkey AND r = least(2, m))"""


@query("t5_shape_tables", f"""WITH {_CELLS} SELECT CAST(cs.l_orderkey AS VARCHAR) AS doc, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, CASE c WHEN 1 THEN CAST(l_partkey AS VARCHAR) WHEN 2 THEN l_returnflag ELSE CASE WHEN cs.l_linestatus = 'F' THEN 'F' ELSE '' END END AS text, r = 1 AS header,
 CASE WHEN c = 2 AND al.l_linestatus = 'O' THEN 'right' WHEN c = 3 AND al.l_linestatus = 'F' THEN 'center' ELSE 'left' END AS align FROM cs JOIN sz USING (l_orderkey) JOIN al USING (l_orderkey), range(1, 4) t(c) WHERE c <= n""")
def t5(spark, sf):
    return CO.shape_tables(cells(spark, sf)).select("doc", "row", "col", "text", "header", "align")


@query("t6_merge_inlines", "SELECT CAST(o_orderkey AS VARCHAR) AS doc, 'text' AS kind, NULL AS strong, o_orderstatus || 'b' AS value FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'emphasis', true, 'xy' FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'emphasis', false, o_orderpriority FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'other', NULL, 'k' FROM orders")
def t6(spark, sf):
    i = table(spark, sf, "orders").selectExpr("cast(o_orderkey as string) as doc", "0 as idx", """array(struct(0 as seq, 'text' as kind, cast(null as boolean) as strong, o_orderstatus as value), struct(1 as seq, 'text' as kind, null as strong, 'b' as value), struct(2 as seq, 'emphasis' as kind, true as strong, 'x' as value), struct(3 as seq, 'emphasis' as kind, true as strong, 'y' as value),
      struct(4 as seq, 'emphasis' as kind, false as strong, o_orderpriority as value), struct(5 as seq, 'other' as kind, null as strong, 'k' as value), struct(6 as seq, 'text' as kind, null as strong, '' as value)) as inlines""")
    return CO.merge_inline_lists(i).select("doc", "kind", "strong", "value")


def page_content(spark, sf):
    """Page blocks as content blocks; list items of the navigation, headings and paragraphs."""
    b = page_blocks(spark, sf).where("tag in ('h1', 'p', 'li') and text <> ''")
    return b.select("doc", "idx", F.expr("case tag when 'h1' then 'heading' when 'li' then 'list_item' else 'para' end").alias("type"), F.expr("case tag when 'h1' then 1 when 'li' then 0 end").alias("level"),
                    F.lit(False).alias("ordered"), F.lit(None).cast("string").alias("label"), "text", F.lit(None).cast("string").alias("alt"))


_ESC = r"regexp_replace(text, '([\\`*_\[\]])', '\\\1', 'g')"


@query("a18_to_markdown", f"""WITH {HTML_SQL}, b AS (SELECT doc, idx, tag, {_ESC} AS text FROM hb WHERE tag IN ('h1', 'p', 'li') AND text <> ''), l AS (SELECT *, lag(tag) OVER (PARTITION BY doc ORDER BY idx) AS pt FROM b)
SELECT doc, rtrim(string_agg(CASE WHEN pt IS NULL THEN '' WHEN pt = 'li' AND tag = 'li' THEN chr(10) ELSE chr(10) || chr(10) END || CASE tag WHEN 'h1' THEN '# ' || text WHEN 'li' THEN '- ' || text ELSE text END, '' ORDER BY idx)) || chr(10) AS text FROM l GROUP BY doc""")
def a18(spark, sf):
    return CO.to_markdown(page_content(spark, sf))


@query("a11_markdown_blocks", f"""WITH {HTML_SQL} SELECT doc, CASE tag WHEN 'h1' THEN 'heading' WHEN 'li' THEN 'list_item' ELSE 'para' END AS type, count(*) AS n FROM hb WHERE tag IN ('h1', 'p', 'li') AND text <> '' GROUP BY ALL""")
def a11(spark, sf):
    # the Markdown of every page read back: the same blocks
    return CO.markdown_blocks(CO.to_markdown(page_content(spark, sf))).groupBy("doc", "type").agg(F.count("*").alias("n"))


@query("a18_pipe_tables")
def a18_tables(spark, sf):
    return CO.render_tables(CO.shape_tables(cells(spark, sf)))
