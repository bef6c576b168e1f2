"""Inheritance and indirection: region -> nation -> supplier as a style tree, orders as lists, events as sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import hierarchy as H
from plenum.plans.q_text import LINES_SQL, collapse_sql, lines
from plenum.plans.registry import query, table
from plenum.skew import settle

# (id, based_on, condition) in both dialects; nation 3's parent is itself, nation 4's is missing
_TREE = [("region", "'R' || r_regionkey", "CAST(NULL AS {STR})"), ("nation", "'N' || n_nationkey", "CASE WHEN n_nationkey = 3 THEN 'N3' WHEN n_nationkey = 4 THEN 'R99' ELSE 'R' || n_regionkey END"), ("supplier", "'S' || s_suppkey", "'N' || s_nationkey")]


def styles(spark, sf):
    out = None
    for t, i, b in _TREE:
        df = table(spark, sf, t).selectExpr("'tree' as doc", f"{i} as style_id", "'paragraph' as type", f"{b.format(STR='STRING')} as based_on")
        out = df if out is None else out.unionByName(df)
    return out


TREE_SQL = "sty AS (" + " UNION ALL ".join(f"SELECT {i} AS id, {b.format(STR='VARCHAR')} AS up FROM {t}" for t, i, b in _TREE) + """),
ch AS (WITH RECURSIVE r AS (SELECT id, 0 AS depth, id AS anc, up, [id] AS seen, false AS cyc FROM sty
  UNION ALL SELECT r.id, depth + 1, s.id, s.up, list_append(seen, s.id), list_contains(seen, s.id) FROM r JOIN sty s ON r.up = s.id WHERE NOT r.cyc) SELECT * FROM r)"""


@query("c1_ancestry", f"WITH {TREE_SQL} SELECT id AS style_id, string_agg(anc, '>' ORDER BY depth DESC) AS path FROM ch WHERE NOT cyc GROUP BY id")
def c1(spark, sf):
    return H.paths(H.ancestry(styles(spark, sf))).select("style_id", F.array_join("path", ">").alias("path"))


@query("c2_style_faults", f"WITH {TREE_SQL} SELECT DISTINCT id AS style_id, 'cycle' AS fault, NULL AS target FROM ch WHERE cyc UNION ALL SELECT id, 'dangling', up FROM sty WHERE up IS NOT NULL AND up NOT IN (SELECT id FROM sty)")
def c2(spark, sf):
    s = styles(spark, sf)
    return H.style_faults(s, H.ancestry(s)).select("style_id", "fault", "target")


_PROPS = """SELECT 'R' || r_regionkey AS anc, 20 AS size, 'Serif' AS font, CAST(NULL AS {STR}) AS theme FROM region UNION ALL
SELECT 'N' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END, CASE WHEN n_nationkey % 5 = 0 THEN 'Sans' END, CASE WHEN n_nationkey % 3 = 0 THEN 'minor' END FROM nation UNION ALL
SELECT 'S' || s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 48 END, NULL, CASE WHEN s_suppkey % 11 = 0 THEN 'major' END FROM supplier"""


def props(spark, sf):
    for t in ("region", "nation", "supplier"):
        table(spark, sf, t).createOrReplaceTempView(f"plenum_{t}")
    sql = _PROPS.format(STR="STRING")
    for t in ("region", "nation", "supplier"):
        sql = sql.replace(f"FROM {t}", f"FROM plenum_{t}")
    return spark.sql(sql).select(F.lit("tree").alias("doc"), F.col("anc").alias("ancestor"), "size", "font", "theme")


_FOLD = f"""WITH {TREE_SQL}, pr AS ({_PROPS.format(STR='VARCHAR')}), j AS (SELECT id, depth, pr.* FROM ch JOIN pr USING (anc) WHERE NOT cyc)
SELECT j.id AS style_id, arg_min(size, depth) FILTER (WHERE size IS NOT NULL) AS size, arg_min({{'f': font, 't': theme}}, depth) FILTER (WHERE font IS NOT NULL OR theme IS NOT NULL) AS g FROM j GROUP BY j.id"""


@query("c3_fold", f"SELECT style_id, size, g.f AS font, g.t AS theme FROM ({_FOLD})")
def c3(spark, sf):
    return H.fold(H.ancestry(styles(spark, sf)), props(spark, sf), ["size"], [["font", "theme"]]).select("style_id", "size", "font", "theme")


_KIND = "CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'N' THEN 'paragraph' ELSE 'character' END"
_BIT = "CASE WHEN l_linestatus = 'F' THEN l_linenumber % 3 <> 0 WHEN l_linenumber % 2 = 0 THEN false END"


@query("c4_toggle", f"""WITH l AS (SELECT l_orderkey, l_linenumber AS n, {_KIND} AS kind, min({_BIT}) AS v FROM lineitem GROUP BY ALL), o AS (SELECT o_orderkey, o_orderstatus = 'F' AS def, CASE WHEN o_orderkey % 13 = 0 THEN true END AS direct FROM orders),
lv AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, kind) AS i FROM l WHERE v IS NOT NULL),
rs AS (SELECT l_orderkey, max(CASE WHEN NOT v OR kind <> 'character' THEN i ELSE 0 END) AS r FROM lv GROUP BY 1),
st AS (SELECT lv.l_orderkey, r, max(CASE WHEN i = r THEN v END) AS base, count(CASE WHEN i > r THEN 1 END) AS flips FROM lv JOIN rs USING (l_orderkey) GROUP BY ALL)
SELECT CAST(o_orderkey AS VARCHAR) AS doc, coalesce(direct, CASE WHEN st.l_orderkey IS NULL THEN def ELSE coalesce(base, def) <> (flips % 2 = 1) END) AS shown FROM o LEFT JOIN st ON l_orderkey = o_orderkey""")
def c4(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber as n", f"{_KIND} as kind", f"{_BIT} as value").groupBy("l_orderkey", "n", "kind").agg(F.min("value").alias("value"))
    levels = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", "kind", "value"))).alias("levels"))
    o = table(spark, sf, "orders").join(levels, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.expr("cast(array() as array<struct<n:int,kind:string,value:boolean>>)")
    return o.select(F.col("o_orderkey").cast("string").alias("doc"), H.toggle(F.col("o_orderstatus") == "F", F.coalesce("levels", none), F.expr("if(o_orderkey % 13 = 0, true, cast(null as boolean))")).alias("shown"))


@query("c5_effective", f"""WITH f AS (SELECT style_id, size FROM ({_FOLD})) SELECT CAST(c_custkey AS VARCHAR) AS doc, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 30 END, CASE WHEN c_custkey % 3 = 0 THEN n.size END, r.size, 22) AS size,
 CASE WHEN c_custkey % 9 = 0 THEN false ELSE (c_custkey % 3 = 0) <> true END AS bold FROM customer JOIN f n ON n.style_id = 'N' || c_nationkey LEFT JOIN f r ON r.style_id = 'R' || (c_nationkey % 5)""")
def c5(spark, sf):
    folded = H.fold(H.ancestry(styles(spark, sf)), props(spark, sf), ["size"], []).select("style_id", "size")
    cust = table(spark, sf, "customer")
    keys = cust.select(F.col("c_custkey").cast("string").alias("doc"), "c_custkey", "c_nationkey")
    para = keys.withColumn("style_id", F.expr("'R' || (c_nationkey % 5)")).join(folded, "style_id").withColumn("bold", F.lit(True)).select("doc", "style_id", "size", "bold")
    char = keys.where("c_custkey % 3 = 0").withColumn("style_id", F.expr("'N' || c_nationkey")).join(folded, "style_id").withColumn("bold", F.lit(True)).select("doc", "style_id", "size", "bold")
    direct = keys.selectExpr("doc", "0 as idx", "'R' || (c_nationkey % 5) as para_style", "if(c_custkey % 3 = 0, 'N' || c_nationkey, null) as char_style", "if(c_custkey % 4 = 0, 30, null) as size", "if(c_custkey % 9 = 0, false, cast(null as boolean)) as bold")
    defaults = keys.selectExpr("doc", "22 as size", "false as bold")
    return H.effective(defaults, para, char, direct, ["size"], ["bold"]).select("doc", "size", "bold")


def order_styles(spark, sf):
    """A customer is a document, its orders are style definitions."""
    return table(spark, sf, "orders").selectExpr(
        "cast(o_custkey as string) as doc", "cast(o_orderkey as string) as style_id", "if(o_orderstatus = 'P', 'character', 'paragraph') as type", "o_orderpriority = '1-URGENT' as is_default",
        "lower(if(o_orderpriority = '5-LOW', 'normal', o_orderpriority)) as name_key", "o_orderkey as pos", "array(lower(o_orderstatus), if(o_orderkey % 2 = 0, '2-high', 'even')) as aliases")


_OS = """os AS (SELECT o_custkey AS doc, o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'character' ELSE 'paragraph' END AS type, o_orderpriority = '1-URGENT' AS is_default, lower(CASE WHEN o_orderpriority = '5-LOW' THEN 'normal' ELSE o_orderpriority END) AS name_key,
 [lower(o_orderstatus), CASE WHEN o_orderkey % 2 = 0 THEN '2-high' ELSE 'even' END] AS aliases FROM orders)"""


@query("c6_default_style", f"""WITH {_OS}, d AS (SELECT doc, coalesce(max(CASE WHEN is_default THEN id END), min(CASE WHEN name_key = 'normal' THEN id END)) AS def FROM os WHERE type = 'paragraph' GROUP BY doc)
SELECT CAST(l_orderkey AS VARCHAR) AS ref, CAST(c.doc AS VARCHAR) AS doc, CAST(CASE WHEN os.id IS NOT NULL THEN os.id ELSE def END AS VARCHAR) AS style_id FROM (SELECT DISTINCT l_orderkey, l_orderkey % 1500 AS doc FROM lineitem) c LEFT JOIN os ON os.doc = c.doc AND os.id = c.l_orderkey LEFT JOIN d ON d.doc = c.doc""")
def c6(spark, sf):
    refs = table(spark, sf, "lineitem").selectExpr("cast(l_orderkey as string) as ref", "cast(l_orderkey % 1500 as string) as doc").distinct()
    return H.style_or_default(refs, order_styles(spark, sf)).select("ref", "doc", "style_id")


@query("c7_name_index", f"""WITH {_OS}, n AS (SELECT doc, type, name_key AS name, id, 0 AS p FROM os UNION ALL SELECT doc, type, unnest(aliases), id, 1 FROM os)
SELECT CAST(doc AS VARCHAR) AS doc, type, name, CAST(id AS VARCHAR) AS style_id FROM (SELECT *, row_number() OVER (PARTITION BY doc, type, name ORDER BY p, id) AS rn FROM n) WHERE rn = 1""")
def c7(spark, sf):
    return H.name_index(order_styles(spark, sf))


@query("c8_theme", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Face' || (p_partkey % 25) ELSE p_brand END AS font_shown, CASE WHEN p_size % 3 = 0 THEN 'ABC' WHEN p_size % 3 = 1 THEN 'HUE' || (p_partkey % 25) ELSE 'auto' END AS color_shown FROM part""")
def c8(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", "cast(p_partkey % 25 as string) as doc", "p_brand as font", "if(p_size % 2 = 0, 'minorHAnsi', null) as font_token", "if(p_size % 3 = 0, 'abc', 'auto') as color", "if(p_size % 3 = 1, 'text1', null) as color_token")
    theme = table(spark, sf, "nation").selectExpr("cast(n_nationkey as string) as doc", "inline(array(struct('minorHAnsi' as slot, concat('Face', n_nationkey) as value), struct('dk1' as slot, concat('HUE', n_nationkey) as value)))")
    return H.resolve_theme(rows, theme).select("p_partkey", "font_shown", "color_shown")


# customers as lists: the nation is the definition; some definitions only point at another list's style
def numbering(spark, sf):
    cust, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    nums = cust.selectExpr("'d' as doc", "c_custkey as num_id", "cast(c_nationkey as bigint) as abstract_id")
    abstracts = nation.where("n_nationkey <> 24").selectExpr("'d' as doc", "cast(n_nationkey as bigint) as abstract_id", "if(n_nationkey % 5 = 0, concat('style', n_nationkey), null) as num_style_link")
    # style n carries a list of the next nation; 10 -> 15 -> 10 is a cycle, 20's list does not exist
    target = cust.groupBy("c_nationkey").agg(F.min("c_custkey").alias("num_id"))
    link = nation.where("n_nationkey % 5 = 0").selectExpr("concat('style', n_nationkey) as style_id", "case n_nationkey when 10 then 15 when 15 then 10 else n_nationkey + 1 end as c_nationkey", "n_nationkey")
    carried = link.join(target, "c_nationkey").where("n_nationkey <> 20").selectExpr("'d' as doc", "style_id", "num_id")
    return nums, abstracts, carried


_NUM = """tg AS (SELECT c_nationkey AS k, min(c_custkey) AS num FROM customer GROUP BY 1), lk AS (SELECT n_nationkey AS aid, CASE n_nationkey WHEN 10 THEN 15 WHEN 15 THEN 10 ELSE n_nationkey + 1 END AS nxt FROM nation WHERE n_nationkey % 5 = 0 AND n_nationkey <> 20),
rs AS (SELECT c_custkey AS num_id, CASE WHEN c_nationkey = 24 THEN NULL WHEN c_nationkey IN (10, 15) THEN NULL WHEN c_nationkey = 20 THEN 20 WHEN c_nationkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS abstract_id FROM customer)"""


@query("c9_abstract_for", f"WITH {_NUM} SELECT num_id, CAST(CASE WHEN num_id IN (SELECT num FROM tg WHERE k IN (10, 15)) THEN abstract_id ELSE abstract_id END AS BIGINT) AS abstract_id FROM rs")
def c9(spark, sf):
    return H.abstract_for(*numbering(spark, sf)).select("num_id", "abstract_id")


_LV = "SELECT n_nationkey AS abstract_id, i AS ilvl, CASE WHEN i = 0 THEN 'decimal' ELSE 'bullet' END AS fmt, n_name || i AS marker, 1 AS start, 360 * i AS indent, i = 2 AS tentative FROM nation, range(0, 3) t(i)"
_OV = "SELECT c_custkey AS num_id, 0 AS ilvl, CASE WHEN c_custkey % 2 = 0 THEN 'roman' END AS o_fmt, CASE WHEN c_custkey % 2 = 0 THEN 'M' END AS o_marker, CASE WHEN c_custkey % 2 = 0 THEN 4 END AS o_start, CASE WHEN c_custkey % 3 = 0 THEN 7 END AS start_override FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0"


def list_levels(spark, sf):
    resolved = settle(H.abstract_for(*numbering(spark, sf)).where("abstract_id is not null"))
    levels = table(spark, sf, "nation").selectExpr("'d' as doc", "cast(n_nationkey as bigint) as abstract_id", "explode(sequence(0, 2)) as ilvl", "n_name").selectExpr(
        "doc", "abstract_id", "ilvl", "if(ilvl = 0, 'decimal', 'bullet') as fmt", "n_name || ilvl as marker", "1 as start", "360 * ilvl as indent", "ilvl = 2 as tentative")
    overrides = table(spark, sf, "customer").where("c_custkey % 2 = 0 or c_custkey % 3 = 0").selectExpr(
        "'d' as doc", "c_custkey as num_id", "0 as ilvl", "if(c_custkey % 2 = 0, 'roman', null) as o_fmt", "if(c_custkey % 2 = 0, 'M', null) as o_marker", "if(c_custkey % 2 = 0, 4, null) as o_start", "if(c_custkey % 3 = 0, 7, null) as start_override")
    return H.list_levels(resolved, levels, overrides)


_LL = f"""{_NUM}, lv AS ({_LV}), ov AS ({_OV}), ll AS (SELECT num_id, ilvl, coalesce(o_fmt, fmt) AS fmt, CASE WHEN o_fmt IS NOT NULL THEN o_marker ELSE marker END AS marker,
 coalesce(start_override, CASE WHEN o_fmt IS NOT NULL THEN o_start ELSE start END) AS start, CASE WHEN o_fmt IS NULL THEN indent END AS indent, coalesce(tentative, false) AS tentative
 FROM (SELECT * FROM rs JOIN lv USING (abstract_id)) b FULL JOIN ov USING (num_id, ilvl) WHERE fmt IS NOT NULL OR o_fmt IS NOT NULL)"""


@query("c9_list_levels", f"WITH {_LL} SELECT num_id, CAST(ilvl AS INT) AS ilvl, fmt, marker, CAST(start AS INT) AS start FROM ll")
def c9_levels(spark, sf):
    return list_levels(spark, sf).select("num_id", "ilvl", "fmt", "marker", "start")


_PA = "CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN 0 ELSE o_custkey END"
_PI = "CASE WHEN o_orderkey % 4 < 2 THEN NULL ELSE o_orderkey % 4 END"


@query("c10_list_reference", f"""WITH {_LL}, sl AS (SELECT o_orderpriority AS style_id, min(o_custkey) AS s_num FROM orders WHERE o_orderpriority < '4' GROUP BY 1),
p AS (SELECT o_orderkey, {_PA} AS num_id, {_PI} AS ilvl, s_num FROM orders LEFT JOIN sl ON style_id = o_orderpriority),
r AS (SELECT o_orderkey, CASE WHEN num_id IS NULL THEN s_num WHEN num_id <> 0 THEN num_id END AS ref_num, CASE WHEN num_id IS NULL OR (ilvl IS NULL AND s_num = num_id) THEN 1 ELSE coalesce(ilvl, 0) END AS l,
 CASE WHEN num_id IS NULL AND s_num IS NOT NULL THEN 'level-pstyle' WHEN num_id = 0 THEN 'removed' WHEN num_id IS NULL THEN 'none' WHEN ilvl IS NULL AND s_num = num_id THEN 'level-pstyle' ELSE 'style' END AS source FROM p)
SELECT o_orderkey AS idx, ref_num, CASE WHEN ref_num IS NOT NULL THEN CAST(l AS INT) END AS ref_ilvl, source, ref_num IS NOT NULL AND EXISTS (SELECT 1 FROM ll WHERE ll.num_id = ref_num AND ll.ilvl = l) AS resolved FROM r""")
def c10(spark, sf):
    o = table(spark, sf, "orders")
    paras = o.selectExpr("'d' as doc", "o_orderkey as idx", f"{_PA} as num_id", f"cast({_PI} as int) as ilvl", "o_orderpriority as style_id")
    style_levels = o.where("o_orderpriority < '4'").groupBy(F.col("o_orderpriority").alias("style_id")).agg(F.min("o_custkey").alias("s_num")).withColumn("s_ilvl", F.lit(1)).withColumn("doc", F.lit("d"))
    return H.list_reference(paras, list_levels(spark, sf), style_levels).select("idx", "ref_num", "ref_ilvl", "source", "resolved")


@query("c10_duplicate_ids", "SELECT CAST(p_size AS VARCHAR) AS doc, lower(p_brand) AS nsid, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def c10_dup(spark, sf):
    return H.duplicate_ids(table(spark, sf, "part").selectExpr("cast(p_size as string) as doc", "p_brand as nsid"))


# an order's lines are the levels of its list
_SIG = """sg AS (SELECT DISTINCT l_orderkey, l_linenumber AS ilvl, l_returnflag AS fmt, l_linestatus AS marker FROM lineitem WHERE l_linenumber < 4),
si AS (SELECT l_orderkey, sha256(string_agg(ilvl || ':' || fmt || ':' || marker || ':1:-', '|' ORDER BY ilvl, fmt, marker)) AS signature, sha256(string_agg(ilvl || ':' || fmt || ':' || marker, '|' ORDER BY ilvl, fmt, marker)) AS shape FROM sg GROUP BY 1)"""


def order_signatures(spark, sf):
    lv = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber as ilvl", "l_returnflag as fmt", "l_linestatus as marker", "1 as start", "cast(null as int) as indent", "l_linenumber >= 4 as tentative")
    return H.signatures(lv, ["l_orderkey"])


@query("c11_list_signature", f"WITH {_SIG} SELECT signature, shape, count(*) AS lists FROM si GROUP BY ALL")
def c11(spark, sf):
    return order_signatures(spark, sf).groupBy("signature", "shape").agg(F.count("*").alias("lists"))


_EV = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def events(spark, sf):
    return table(spark, sf, "events").selectExpr("user_id as doc", "ts", "event_id", "event_type = 'purchase' as is_break", "event_type", "value")


def hour():
    return F.date_trunc("hour", F.col("ts"))


@query("c12_section_assignment", f"SELECT event_id, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id {_EV}), 0) AS BIGINT) AS section FROM events")
def c12(spark, sf):
    return H.assign_sections(events(spark, sf), ["ts", "event_id"], hour()).select("event_id", "section")


def slots(spark, sf):
    e = table(spark, sf, "events")
    return e.selectExpr("user_id as doc", "event_type as slot", "event_id as sec", "ts", "if(value < 30, concat('rId', event_id), null) as rid", "if(event_type = 'view', 'default', if(event_type = 'click', 'first', 'even')) as type", "event_id % 2 = 0 as title_page", "user_id % 2 = 0 as even_and_odd")


_SLOT = """sl AS (SELECT user_id, event_id AS sec, event_type, last_value(CASE WHEN value < 30 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS src,
 event_type = 'view' OR (event_type = 'click' AND event_id % 2 = 0) OR (event_type NOT IN ('view', 'click') AND user_id % 2 = 0) AS active FROM events)"""


def resolved_slots(spark, sf):
    return H.active(H.inherit_slots(slots(spark, sf), ["ts", "sec"], hour()))


@query("c13_slot_inheritance", f"WITH {_SLOT} SELECT sec, 'rId' || src AS resolved_rid, src AS defined_in, active FROM sl")
def c13(spark, sf):
    return resolved_slots(spark, sf).select("sec", "resolved_rid", "defined_in", "active")


@query("c14_orphan_parts", f"WITH {_SLOT} SELECT user_id AS doc, 'rId' || event_id AS part FROM events e WHERE value < 30 AND NOT EXISTS (SELECT 1 FROM sl WHERE sl.user_id = e.user_id AND sl.src = e.event_id AND active)")
def c14(spark, sf):
    r = resolved_slots(spark, sf).withColumn("part", F.col("resolved_rid"))
    return H.slot_use(r, slots(spark, sf).where("rid is not null").select("doc", F.col("rid").alias("part"))).select("doc", "part")


@query("c14_linked_to_previous", f"WITH {_SLOT} SELECT sec, src AS defined_in FROM sl WHERE src IS NOT NULL AND src <> sec")
def c14_linked(spark, sf):
    return H.linked_to_previous(resolved_slots(spark, sf)).select("sec", "defined_in")


_GEO = {"width": "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS BIGINT) * 300 END", "height": "CAST(l_quantity AS BIGINT) * 400", "left": "l_linenumber * 500", "right": "CASE WHEN l_linenumber % 2 = 0 THEN 720 END", "top": "720", "bottom": "720",
        "gutter": "CASE WHEN l_returnflag = 'R' THEN 100 END", "columns": "l_linenumber % 3 + 1", "equal_width": "l_linestatus = 'O'", "first_col": "CASE WHEN l_returnflag = 'A' THEN 2000 END", "space": "CASE WHEN l_linenumber % 2 = 1 THEN 720 END", "col_widths": "l_linenumber % 2 + 1"}
_GQ = ", ".join(f'{e} AS "{n}"' for n, e in _GEO.items())
_GSQL = f"""ge AS (SELECT l_orderkey, l_linenumber, l_partkey, {_GQ} FROM lineitem), gm AS (SELECT *, width - coalesce("left", 0) - coalesce("right", 0) - coalesce(gutter, 0) AS cw, height - 1440 AS chh FROM ge)"""


def geo(spark, sf):
    g = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[F.expr(e).alias(n) for n, e in _GEO.items()])
    return H.geometry(g)


@query("c15_geometry", f"""WITH {_GSQL} SELECT l_orderkey, l_linenumber, l_partkey, cw AS content_width, chh AS content_height, CAST(CASE WHEN "columns" <= 1 THEN cw WHEN NOT equal_width AND first_col IS NOT NULL THEN first_col ELSE floor((cw - ("columns" - 1) * coalesce(space, 0)) / "columns") END AS BIGINT) AS column_width FROM gm""")
def c15(spark, sf):
    return geo(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "content_width", "content_height", "column_width")


@query("c16_section_problems", f"""WITH {_GSQL} SELECT CAST(l_orderkey AS VARCHAR) AS doc, 'no page size' AS problem, count(*) AS n FROM gm WHERE width IS NULL GROUP BY 1 UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'margins leave no text width', count(*) FROM gm WHERE cw <= 0 GROUP BY 1
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'column widths missing', count(*) FROM gm WHERE "columns" > 1 AND NOT equal_width AND col_widths < "columns" GROUP BY 1 UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'even-page header missing', count(*) FROM gm WHERE l_orderkey % 2 = 0 AND l_linenumber <> 1 GROUP BY 1""")
def c16(spark, sf):
    g = geo(spark, sf).selectExpr("*", "cast(l_orderkey as string) as doc", "cast(l_linenumber as bigint) as sec", "l_orderkey % 2 = 0 as even_and_odd", "if(l_linenumber = 1, 'h.xml', null) as even_part", "'d.xml' as default_part")
    return H.section_problems(g).groupBy("doc", "problem").agg(F.count("*").alias("n"))


@query("c17_primary_section", f"WITH {LINES_SQL}, s AS (SELECT doc, idx // 3 AS section, count(*) AS n, min(idx) AS f FROM tb WHERE {collapse_sql('text')} <> '' GROUP BY ALL) SELECT doc, CAST(first(section ORDER BY n DESC, f) AS INT) AS section FROM s GROUP BY doc")
def c17(spark, sf):
    return H.primary_section(lines(spark, sf).withColumn("section", F.floor(F.col("idx") / 3).cast("int")))
