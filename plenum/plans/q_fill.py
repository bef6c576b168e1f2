"""Mail merge: one template per nation, one letter per customer, one row per line item."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import fill as FL
from plenum.plans.registry import query, table
from plenum.skew import spread

TEMPLATE = [
    "'Dear {{full_name*|Full name}} of ' || n_name || ','",
    "'Your segment is «Segment», code ###Code###.'",
    "'{{check: vip}} VIP, {{choice: status | Draft, Final}}, {{number: balance}} by {{date: due}} {{image: photo}}'",
    "'[Job Title] {{nobody}} [see appendix]'",
]
ROW = "'{{items.material}} | {{items.quantity}} | {{check: items.returned}} | {{items.missing}}.'"


def template(spark, sf):
    entries = ", ".join(f"struct({i} as idx, {e} as text)" for i, e in enumerate(TEMPLATE))
    return FL.templates(table(spark, sf, "nation").selectExpr("n_nationkey as template_id", f"inline(array({entries}))"))


def records(spark, sf):
    return spread(table(spark, sf, "customer"), "c_custkey").selectExpr(
        "cast(c_custkey as string) as record", "c_nationkey as template_id",
        """map('full_name', c_name, 'segment', c_mktsegment, 'code', '{{full_name}}', 'vip', if(c_acctbal > 5000, ' Yes', 'no'), 'status', 'Final',
          'balance', cast(cast(c_acctbal as decimal(12,2)) as string), 'due', cast(null as string), 'photo', 'bytes', 'extra', 'unused') as answers""")


_BAL = "CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR)"
_FILLED = [
    "'Dear ' || c_name || ' of ' || n_name || ','", "'Your segment is ' || c_mktsegment || ', code {{full_name}}.'",
    f"CASE WHEN c_acctbal > 5000 THEN '☒' ELSE '☐' END || ' VIP, Final, ' || {_BAL} || ' by  {{{{image: photo}}}}'", "'[Job Title] {{nobody}} [see appendix]'",
]
_FILL_SQL = " UNION ALL ".join(f"SELECT CAST(c_custkey AS VARCHAR) AS record, {i} AS idx, {e} AS text FROM customer JOIN nation ON c_nationkey = n_nationkey" for i, e in enumerate(_FILLED))


@query("m1_fill", _FILL_SQL)
def m1(spark, sf):
    return FL.fill(template(spark, sf), records(spark, sf)).select("record", "idx", "text")


_YES = "CASE o_orderkey % 6 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes ' WHEN 2 THEN 'X' WHEN 3 THEN '0' WHEN 4 THEN 'off' END"


@query("m2_kind_rendering", """SELECT o_orderstatus AS status, CASE o_orderkey % 6 WHEN 0 THEN '☒' WHEN 1 THEN '☒' WHEN 2 THEN '☒' ELSE '☐' END AS box, coalesce(CASE o_orderkey % 6 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes ' WHEN 2 THEN 'X' WHEN 3 THEN '0' WHEN 4 THEN 'off' END, '') AS plain, count(*) AS n FROM orders GROUP BY ALL""")
def m2(spark, sf):
    v = F.expr(_YES)
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"), FL.rendered(F.lit("checkbox"), v).alias("box"), FL.rendered(F.lit("date"), v).alias("plain")).agg(F.count("*").alias("n"))


# a marker torn over four runs; only {{name}} will be filled
_RUNS = ["'To {{na'", "'me'", "'}} from ' || c_mktsegment || ' {{oth'", "'er}} end'"]
_JOINED = ["'To {{name}}'", "''", "' from ' || c_mktsegment || ' {{oth'", "'er}} end'"]


@query("m3_split_markers", " UNION ALL ".join(f"SELECT CAST(c_custkey AS VARCHAR) AS doc, {i} AS run_no, {e} AS text FROM customer" for i, e in enumerate(_JOINED)))
def m3(spark, sf):
    entries = ", ".join(f"struct({i} as run_no, {e} as text)" for i, e in enumerate(_RUNS))
    c = table(spark, sf, "customer")
    runs = c.selectExpr("cast(c_custkey as string) as doc", "0 as idx", f"inline(array({entries}))")
    return FL.coalesce_runs(runs, c.select(F.lit("name").alias("name")).limit(1)).select("doc", "run_no", "text")


@query("m4_repeat_rows", """SELECT CAST(l_orderkey AS VARCHAR) AS record, l_linenumber AS pos, CAST(l_partkey AS VARCHAR) || ' | ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' | ' || CASE WHEN l_returnflag = 'R' THEN '☒' ELSE '☐' END || ' | .' AS text FROM lineitem""")
def m4(spark, sf):
    t = FL.templates(table(spark, sf, "region").where("r_regionkey = 0").selectExpr("0 as template_id", "0 as idx", f"{ROW} as text"))
    rows = table(spark, sf, "lineitem").selectExpr(
        "cast(l_orderkey as string) as record", "0 as template_id", "l_linenumber as pos",
        "map('material', cast(l_partkey as string), 'quantity', cast(cast(l_quantity as int) as string), 'returned', if(l_returnflag = 'R', 'x', '')) as answers")
    return FL.expand_repeats(t, rows, "items").select("record", "pos", "text")


@query("m5_fill_report", """SELECT CAST(c_custkey AS VARCHAR) AS record, 'balance,code,due,full_name,segment,status,vip' AS filled, 'extra' AS unknown, '{{full_name}} {{image: photo}} {{nobody}}' AS leftover FROM customer""")
def m5(spark, sf):
    r = FL.fill_report(FL.fill(template(spark, sf), records(spark, sf)))
    return r.select("record", F.array_join("filled", ",").alias("filled"), F.array_join("unknown", ",").alias("unknown"), F.array_join("leftover", " ").alias("leftover"))


_FIELDS = "inline(array(struct('phone' as name, 'text' as kind, 'old' as value), struct('segment' as name, 'text' as kind, 'old' as value), struct('agree' as name, 'checkbox' as kind, 'on' as value)))"


@query("m5_clear_unsupplied", """SELECT CAST(c_custkey AS VARCHAR) AS record, 'phone' AS name, 'cleared' AS outcome, '' AS value FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'segment', CASE WHEN c_acctbal > 0 THEN 'filled' ELSE 'cleared' END, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'agree', 'untouched', 'on' FROM customer""")
def m5_clear(spark, sf):
    c = table(spark, sf, "customer")
    fields = c.selectExpr("cast(c_custkey as string) as record", _FIELDS)
    answers = c.where("c_acctbal > 0").selectExpr("cast(c_custkey as string) as record", "'segment' as name", "c_mktsegment as answer")
    return FL.clear_unsupplied(fields, answers)


@query("m6_choice_index", """SELECT o_orderpriority AS value, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderpriority = '2-HIGH' THEN 1 WHEN o_orderpriority = '5-LOW' THEN 2 END AS index, count(*) AS n FROM orders GROUP BY ALL""")
def m6(spark, sf):
    options = F.array(F.lit("1-urgent"), F.lit(" 2-High "), F.lit("5-LOW"))
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("value"), FL.choice_index(options, F.col("o_orderpriority")).alias("index")).agg(F.count("*").alias("n"))


@query("m7_refill", _FILL_SQL.replace("'Your segment is ' || c_mktsegment", "'Your segment is ' || CASE WHEN c_custkey % 2 = 0 THEN 'CHANGED' ELSE c_mktsegment END"))
def m7(spark, sf):
    t = template(spark, sf)
    saved = FL.session(FL.fill(t, records(spark, sf)))
    changed = table(spark, sf, "customer").where("c_custkey % 2 = 0").selectExpr("cast(c_custkey as string) as record", "map('segment', 'CHANGED') as changes")
    return FL.refill(saved, t, changed).select("record", "idx", "text")


_ORD = "CAST(o_orderkey AS VARCHAR)"


@query("m8_preflight", f"""
SELECT {_ORD} AS record, 'placeholder.missing' AS code, 'owner' AS subject FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT {_ORD}, 'placeholder.shape', 'priority' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^\\d-[A-Z]+$')
UNION ALL SELECT {_ORD}, 'placeholder.bad_pattern', 'status' FROM orders
UNION ALL SELECT {_ORD}, 'reference.dangling', 'fig:2' FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT {_ORD}, 'footnote.undefined', 'n2' FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT {_ORD}, 'footnote.unused', 'n1' FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT {_ORD}, 'directive.unknown', o_orderstatus FROM orders WHERE o_orderstatus <> 'O'
UNION ALL SELECT {_ORD}, 'placeholder.unresolved', 'left' FROM orders WHERE o_orderkey % 11 = 0""")
def m8(spark, sf):
    o = table(spark, sf, "orders").withColumn("record", F.col("o_orderkey").cast("string"))
    values = o.select("record", F.expr("""inline(array(struct('owner' as name, if(o_orderkey % 7 = 0, '', 'x') as value),
        struct('priority' as name, o_orderpriority as value), struct('status' as name, o_orderstatus as value)))"""))
    one = o.limit(1)
    specs = one.selectExpr("""inline(array(struct('owner' as name, true as required, cast(null as string) as pattern, true as pattern_ok),
        struct('priority' as name, true as required, '^[0-9]-[A-Z]+$' as pattern, true as pattern_ok), struct('status' as name, true as required, '(' as pattern, false as pattern_ok)))""")
    return FL.preflight(
        values, specs, o.selectExpr("record", "if(o_orderkey % 11 = 0, 'see {{ left }}', 'fine') as text"), o.selectExpr("record", "'fig:1' as label"),
        o.selectExpr("record", "if(o_orderkey % 5 = 0, 'fig:2', 'fig:1') as label"), o.selectExpr("record", "'n1' as label"),
        o.selectExpr("record", "if(o_orderstatus = 'P', 'n2', 'n1') as label"), o.selectExpr("record", "o_orderstatus as name"), ["O"])
