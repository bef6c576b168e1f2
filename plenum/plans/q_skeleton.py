"""Alignment and slots: customer account forms derived from the customer table, conversations, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import keys as K
from plenum.operators import skeleton as SK
from plenum.operators import slots as SL
from plenum.plans.q_roles import SCORE_SQL, classified
from plenum.plans.q_text import LINES_SQL, collapse_sql, heading_sql, lines, match_sql
from plenum.plans.registry import query, table
from plenum.skew import pieces, settle, small
from plenum.sources import text as X

# (pos, kind, text, condition): one form per customer; optional lines are left out by condition
FORM = [
    (0, "body", "'Distribution Statement A: approved for public release.'", "true"),
    (1, "body", "'Account No. ' || c_name", "true"),
    (2, "body", "'Segment ' || c_mktsegment || ' desk'", "true"),
    (3, "body", "CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS {STR})", "true"),
    (4, "body", "'Prepared for nation ' || CAST(c_nationkey AS {STR}) || ' office'", "c_custkey % 3 <> 0"),
    (5, "h1", "CASE WHEN c_custkey % 2 = 0 THEN '2. Terms' ELSE 'Terms' END", "c_custkey % 10 <> 0"),
    (6, "body", "'Payment is due in thirty days.'", "true"),
    (7, "body", "'The account of ' || c_name || ' remains in good standing and is reviewed every year by the ' || c_mktsegment || ' desk in full.'", "true"),
    (8, "h1", "'Contacts'", "c_custkey % 4 = 0"),
    (9, "body", "'Desk ' || CAST(c_nationkey AS {STR})", "c_custkey % 4 = 0"),
]


def form_rows(spark, sf):
    entries = ", ".join(
        f"named_struct('pos', {p}, 'kind', '{k}', 'text', {t.format(STR='STRING')}, 'on', {c})" for p, k, t, c in FORM)
    cust = table(spark, sf, "customer").selectExpr("cast(c_custkey as string) as doc", f"inline(array({entries}))").where("on")
    heading = F.col("kind").startswith("h")
    rows = cust.select(
        F.lit("forms").alias("corpus"), "doc", "pos", "kind", "text",
        F.when(heading, K.heading_key(F.col("text"))).otherwise(F.lower(K.match_key(F.col("text")))).alias("key"),
        heading.alias("is_heading"), F.lit(None).cast("string").alias("sdt_tag"),
        F.when(F.col("pos") == 9, 'DOCPROPERTY "Desk Number"').alias("instruction"))
    rows = rows.repartition(pieces(spark, table(spark, sf, "customer").count() * len(FORM)), "doc")
    return SK.sections(rows).withColumn("section", F.col("section").cast("string"))


def form_totals(spark, sf):
    return table(spark, sf, "customer").groupBy().agg(F.count("*").alias("n_docs")).select(F.lit("forms").alias("corpus"), "n_docs")


_FORM_UNION = "\nUNION ALL ".join(
    f"SELECT CAST(c_custkey AS VARCHAR) AS doc, {p} AS pos, '{k}' AS kind, {t.format(STR='VARCHAR')} AS text FROM customer WHERE {c}"
    for p, k, t, c in FORM)
FORM_SQL = f"""fr AS ({_FORM_UNION}),
fi AS (SELECT 'forms' AS corpus, doc, pos, kind, text, kind LIKE 'h%' AS is_heading,
  CASE WHEN kind LIKE 'h%' THEN {heading_sql('text')} ELSE lower({match_sql('text')}) END AS key,
  CAST(sum(CASE WHEN kind LIKE 'h%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) - 1 AS VARCHAR) AS section FROM fr),
tot AS (SELECT 'forms' AS corpus, count(*) AS n_docs FROM customer)"""


def align_sql(src: str, out: str, max_gap: int = 300) -> str:
    """CTEs adding ``col`` to ``src`` (corpus, section, doc, pos, kind, key, is_heading, ...)."""
    o = out
    doc = "PARTITION BY corpus, section, doc ORDER BY pos"
    last = lambda what, flag: f"last_value(CASE WHEN {flag} THEN {what} END IGNORE NULLS) OVER ({doc} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    same = "x.corpus = y.corpus AND x.section = y.section AND x.doc = y.doc"
    return f"""
{o}_w AS (SELECT DISTINCT corpus, section FROM (SELECT corpus, section, doc, count(*) AS n FROM {src} GROUP BY ALL) WHERE n > {max_gap}),
{o}_c AS (SELECT *, row_number() OVER (PARTITION BY corpus, section, doc, kind, key ORDER BY pos) AS occ, row_number() OVER ({doc}) AS rn FROM {src}
  WHERE (corpus, section) NOT IN (SELECT (corpus, section) FROM {o}_w)),
{o}_a AS (SELECT corpus, section, kind, key, occ, concat_ws('|', 'k', kind, key, occ) AS anchor, n >= 0.9 * n_docs AS backbone FROM
  (SELECT corpus, section, kind, key, occ, is_heading, count(*) AS n FROM {o}_c GROUP BY ALL) JOIN tot USING (corpus) WHERE n >= 2 AND (is_heading OR n >= 0.5 * n_docs)),
{o}_m AS (SELECT * FROM {o}_c LEFT JOIN {o}_a USING (corpus, section, kind, key, occ)),
{o}_s AS (SELECT corpus, section, anchor, round(sum(rn) / count(*), 6) AS at_ FROM {o}_m WHERE backbone GROUP BY ALL),
{o}_b AS (SELECT corpus, section, anchor, coalesce(gap, '') AS gap, count(*) AS n, round(sum(rn - coalesce(from_, 0)) / count(*), 6) AS off_ FROM
  (SELECT *, {last('anchor', 'backbone')} AS gap, {last('rn', 'backbone')} AS from_ FROM {o}_m) WHERE anchor IS NOT NULL AND NOT backbone GROUP BY ALL),
{o}_u AS (SELECT * FROM {o}_b QUALIFY row_number() OVER (PARTITION BY corpus, section, anchor ORDER BY n DESC, gap) = 1),
{o}_n AS (SELECT corpus, section, anchor, row_number() OVER (PARTITION BY corpus, section ORDER BY at_, gap, off_, anchor) AS no FROM (
  SELECT corpus, section, anchor, at_, anchor AS gap, 0.0 AS off_ FROM {o}_s
  UNION ALL SELECT u.corpus, u.section, u.anchor, coalesce(s.at_, 0.0), u.gap, u.off_ FROM {o}_u u LEFT JOIN {o}_s s ON s.corpus = u.corpus AND s.section = u.section AND s.anchor = u.gap)),
{o}_i AS (SELECT corpus, section, doc, pos, no FROM {o}_m JOIN {o}_n USING (corpus, section, anchor)),
{o}_l AS (SELECT *, 1 AS len FROM {o}_i UNION SELECT y.*, x.len + 1 FROM {o}_l x JOIN {o}_i y ON {same} AND y.pos > x.pos AND y.no > x.no),
{o}_z AS (SELECT corpus, section, doc, pos, no, max(len) AS len FROM {o}_l GROUP BY ALL),
{o}_k AS (SELECT * FROM (SELECT * FROM {o}_z QUALIFY row_number() OVER (PARTITION BY corpus, section, doc ORDER BY len DESC, pos DESC) = 1)
  UNION ALL SELECT y.* FROM {o}_k x JOIN {o}_z y ON {same} AND y.len = x.len - 1 AND y.pos < x.pos AND y.no < x.no
    AND NOT EXISTS (SELECT 1 FROM {o}_z v WHERE v.corpus = x.corpus AND v.section = x.section AND v.doc = x.doc AND v.len = x.len - 1 AND v.pos < x.pos AND v.no < x.no AND v.pos > y.pos)),
{o}_h AS (SELECT m.* REPLACE (CASE WHEN k.pos IS NOT NULL THEN anchor END AS anchor) FROM {o}_m m LEFT JOIN {o}_k k ON k.corpus = m.corpus AND k.section = m.section AND k.doc = m.doc AND k.pos = m.pos),
{o}_g AS (SELECT *, coalesce({last('anchor', 'backbone AND anchor IS NOT NULL')}, 'start') AS gap FROM {o}_h),
{o}_o AS (SELECT *, row_number() OVER (PARTITION BY corpus, section, doc, gap, kind, anchor IS NULL ORDER BY pos) AS ord FROM {o}_g),
{o} AS (SELECT * EXCLUDE (occ, rn, anchor, backbone, gap, ord), coalesce(anchor, concat_ws('|', 'g', gap, kind, ord)) AS col FROM {o}_o
  UNION ALL SELECT *, NULL FROM {src} WHERE (corpus, section) IN (SELECT (corpus, section) FROM {o}_w))"""


TIER_SQL = f"""{FORM_SQL},
hsrc AS (SELECT * REPLACE ('headings' AS section), section AS sec FROM fi WHERE is_heading),{align_sql('hsrc', 'hal', 1 << 40)},
bsrc AS (SELECT b.* REPLACE (coalesce(h.col, '') AS section) FROM (SELECT * FROM fi WHERE NOT is_heading) b LEFT JOIN hal h ON h.corpus = b.corpus AND h.doc = b.doc AND h.sec = b.section),{align_sql('bsrc', 'bal')},
al AS (SELECT corpus, section, doc, pos, kind, key, text, is_heading, col FROM bal UNION ALL SELECT corpus, col, doc, pos, kind, key, text, is_heading, col FROM hal)"""

STATS_SQL = f"""{TIER_SQL},
tk AS (SELECT corpus, section, col, kind, key, is_heading, count(*) AS n, sum(pos) AS pos FROM al GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY corpus, section, col ORDER BY n DESC, kind, key) AS rn, sum(n) OVER (PARTITION BY corpus, section, col) AS members,
  sum(pos) OVER (PARTITION BY corpus, section, col) AS allpos FROM tk),
st AS (SELECT corpus, section, col, is_heading, CAST(members AS BIGINT) AS members, members / n_docs AS occupancy, kind AS modal_kind, key AS modal_key, n / members AS agreement,
  round(allpos / members, 6) AS place FROM tr JOIN tot USING (corpus) WHERE rn = 1)"""


def split_sql(src: str, by: str, out: str) -> str:
    """CTEs giving ``out`` (by..., doc, prefix, suffix, middle, is_field) from ``src`` (by..., doc, text)."""
    o = out
    return f"""
{o}_l AS (SELECT {by}, doc, string_split({collapse_sql('text')}, ' ') AS w FROM {src} WHERE {collapse_sql('text')} <> ''),
{o}_n AS (SELECT {by}, count(*) AS n, min(len(w)) AS shortest FROM {o}_l GROUP BY ALL HAVING count(*) >= 2),
{o}_p AS (SELECT {by}, at_, count(DISTINCT word) = 1 AND count(*) = any_value(n) AS same FROM (SELECT {by}, n, unnest(w) AS word, generate_subscripts(w, 1) AS at_ FROM {o}_l JOIN {o}_n USING ({by})) GROUP BY ALL),
{o}_h AS (SELECT {by}, coalesce(min(CASE WHEN NOT same THEN at_ END), max(at_) + 1) - 1 AS nh FROM {o}_p GROUP BY ALL),
{o}_r AS (SELECT {by}, doc, w, nh, list_reverse(w[nh + 1:]) AS rest FROM {o}_l JOIN {o}_h USING ({by})),
{o}_q AS (SELECT {by}, at_, count(DISTINCT word) = 1 AND count(*) = any_value(n) AS same FROM (SELECT {by}, n, unnest(rest) AS word, generate_subscripts(rest, 1) AS at_ FROM {o}_r JOIN {o}_n USING ({by})) GROUP BY ALL),
{o}_t AS (SELECT {by}, coalesce(min(CASE WHEN NOT same THEN at_ END), max(at_) + 1) - 1 AS nt FROM {o}_q GROUP BY ALL),
{o}_e AS (SELECT DISTINCT {by}, true AS bare FROM {o}_r WHERE len(rest) = 0),
{o}_f AS (SELECT {by}, doc, w, nh, CASE WHEN bare THEN 0 ELSE coalesce(nt, 0) END AS nt FROM {o}_r LEFT JOIN {o}_t USING ({by}) LEFT JOIN {o}_e USING ({by})),
{o}_m AS (SELECT {by}, doc, CASE WHEN nh > 0 THEN array_to_string(w[1:nh], ' ') || ' ' ELSE '' END AS prefix, CASE WHEN nt > 0 THEN ' ' || array_to_string(w[len(w) - nt + 1:], ' ') ELSE '' END AS suffix,
  array_to_string(w[nh + 1:len(w) - nt], ' ') AS middle FROM {o}_f WHERE nh > 0 OR nt > 0),
{o} AS (SELECT m.*, d > 1 AS is_field FROM {o}_m m JOIN (SELECT {by}, count(DISTINCT middle) AS d, max(middle) AS hi FROM {o}_m GROUP BY ALL) USING ({by}) WHERE hi <> '')"""


B = "corpus, section, col"
_VALUE_OK = "len(string_split({x}, ' ')) <= {n} AND NOT regexp_matches({x}, '[.?!:;]$')"
SLOT_SQL = f"""{STATS_SQL},{split_sql('al', B, 'spl')},
tx AS (SELECT {B}, text, count(*) AS n FROM al GROUP BY ALL),
tt AS (SELECT {B}, first(text ORDER BY n DESC, text) AS modal_text, max(n) / sum(n) AS text_agreement, bool_and({_VALUE_OK.format(x=collapse_sql('text'), n=6)}) AS bare FROM tx GROUP BY ALL),
kd AS (SELECT {B}, first(kind ORDER BY n DESC, kind) AS role FROM (SELECT {B}, kind, count(*) AS n FROM al GROUP BY ALL) GROUP BY ALL),
fv AS (SELECT {B}, prefix, suffix, bool_and(middle = '' OR ({_VALUE_OK.format(x='middle', n=12)})) AS value_like FROM spl WHERE is_field GROUP BY ALL),
s0 AS (SELECT {B}, is_heading, members, occupancy, place, modal_text, text_agreement, role, prefix, suffix, occupancy < 0.75 AS optional,
  CASE WHEN occupancy < 0.4 THEN 'free_content' WHEN text_agreement >= 0.95 THEN 'boilerplate' WHEN coalesce(value_like, false) OR bare THEN 'placeholder' ELSE 'free_content' END AS kind,
  coalesce(value_like, false) AS vl FROM st JOIN tt USING ({B}) JOIN kd USING ({B}) LEFT JOIN fv USING ({B})),
s1 AS (SELECT * EXCLUDE (prefix, suffix, vl), kind = 'placeholder' AND vl AS framed, CASE WHEN kind = 'placeholder' AND vl THEN prefix END AS prefix, CASE WHEN kind = 'placeholder' AND vl THEN suffix END AS suffix,
  kind = 'boilerplate' AND NOT is_heading AND NOT optional AND role NOT IN ('title','caption','toc') AND section = '' AS enforced,
  kind = 'free_content' AND optional AND occupancy >= 0.4 AS review FROM s0),
sl AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY place, section, col) - 1 AS idx,
  coalesce(lag(modal_text) OVER (PARTITION BY corpus ORDER BY place, section, col), '') AS previous_text FROM s1 WHERE occupancy >= 0.4),
va AS (SELECT al.corpus, al.section, al.col, doc, pos, CASE WHEN framed THEN trim(substr({collapse_sql('text')}, length(prefix) + 1, greatest(length({collapse_sql('text')}) - length(prefix) - length(suffix), 0)))
  ELSE {collapse_sql('text')} END AS value FROM al JOIN (SELECT {B}, framed, prefix, suffix FROM sl WHERE kind = 'placeholder') USING ({B}))"""

PROPS = "SELECT 'forms' AS corpus, CAST(c_custkey AS VARCHAR) AS doc, 'Market Segment' AS name, c_mktsegment AS value FROM customer"
NAME_SQL = f"""{SLOT_SQL}, props AS ({PROPS}),
ph AS (SELECT {B}, name AS pname, count(*) AS hits FROM va JOIN props USING (corpus, doc, value) WHERE value <> '' GROUP BY ALL),
nv AS (SELECT {B}, count(*) AS nval FROM va GROUP BY ALL),
cand AS (
 SELECT {B}, 1 AS rank, 'account_number' AS name, 1.0 AS confidence, 'a confirmed name' AS source FROM sl WHERE framed AND trim(prefix) = 'Account No.' AND trim(suffix) = ''
 UNION ALL SELECT {B}, 3, 'desk_number', 0.95, 'document property' FROM va WHERE pos = 9 GROUP BY ALL
 UNION ALL SELECT {B}, 4, 'market_segment', 0.85, 'a document property' FROM ph JOIN nv USING ({B}) WHERE hits >= greatest(2, nval // 2)
 UNION ALL SELECT {B}, 5, regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 0.60, 'the label beside it' FROM
  (SELECT *, coalesce(nullif(trim(regexp_replace(trim(coalesce(prefix, '')), '[:–-]+$', '')), ''), nullif(regexp_extract(previous_text, '^\\s*([A-Za-z][A-Za-z0-9 /&''.-]{{1,40}}?)\\s*[:–-]\\s*$', 1), '')) AS label FROM sl WHERE kind = 'placeholder') WHERE label IS NOT NULL
 UNION ALL SELECT {B}, 6, 'field_' || idx, 0.30, 'its position' FROM sl WHERE kind = 'placeholder'),
cb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {B} ORDER BY rank, name) AS rn FROM cand) WHERE rn = 1),
nm AS (SELECT sl.*, cb.name AS base, confidence AS name_confidence, source AS name_source, row_number() OVER (PARTITION BY sl.corpus, cb.name ORDER BY idx) AS nth FROM sl LEFT JOIN cb USING ({B})),
named AS (SELECT *, CASE WHEN base IS NOT NULL AND nth > 1 THEN base || '_' || nth ELSE base END AS name,
  review OR (base IS NOT NULL AND nth > 1) OR coalesce(name_confidence <= 0.60, false) AS needs_review FROM nm)"""


def aligned(spark, sf):
    # every later step reads the alignment several times
    return settle(SK.two_tier(settle(form_rows(spark, sf)), form_totals(spark, sf)).where("col is not null"))


def slots(spark, sf):
    a, t = aligned(spark, sf), form_totals(spark, sf)
    s = settle(SL.ordered(SL.classify_columns(a, t)))
    return a, s, settle(SL.slot_values(a, s))


def named(spark, sf):
    a, s, v = slots(spark, sf)
    props = table(spark, sf, "customer").selectExpr("'forms' as corpus", "cast(c_custkey as string) as doc", "'Market Segment' as name", "c_mktsegment as value")
    known = props.limit(1).selectExpr("'account_number' as name", "'Account No. {account_number}' as template")
    return a, SL.name_slots(s, SL.name_candidates(s, v, props, known)), v


@query("i1_items", f"""WITH {SCORE_SQL}, k AS (SELECT *, CASE WHEN level IS NOT NULL THEN 'h' || level ELSE role END AS ikind,
 CASE WHEN level IS NOT NULL THEN {heading_sql('text')} ELSE lower({match_sql('text')}) END AS key FROM cl WHERE ctx_kind = 'body' AND NOT is_empty AND role <> 'empty')
SELECT doc, idx AS pos, CAST(sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY idx) - 1 AS INT) AS section, ikind AS kind, key FROM k""")
def i1(spark, sf):
    b = classified(spark, sf).withColumns({"table_depth": F.lit(0), "row": F.lit(0), "col": F.lit(0)})
    return SK.items(b).select("doc", "pos", "section", "kind", "key")


def turns(spark, sf):
    t = X.turn_blocks(table(spark, sf, "conversations"))
    return t.select(F.lit("talk").alias("corpus"), F.lit("").alias("section"), "doc", F.col("idx").alias("pos"), "kind", "key", "text", F.lit(False).alias("is_heading"))


# two turns are the same token when speaker and whole text agree
_TURN_SQL = f"""tn AS (SELECT 'talk' AS corpus, '' AS section, CAST(conv_id AS VARCHAR) AS doc, CAST(turn AS INT) AS pos, role AS kind, lower({match_sql('text')}) AS key, text, false AS is_heading FROM conversations),
tot AS (SELECT 'talk' AS corpus, count(DISTINCT conv_id) AS n_docs FROM conversations),
tp AS (SELECT corpus, doc, kind, key, count(*) AS n FROM tn GROUP BY ALL), tl AS (SELECT corpus, doc, count(*) AS len FROM tn GROUP BY ALL)"""


@query("i2_similarity", f"""WITH {_TURN_SQL}, pr AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS a, CAST(conv_id + 1 AS VARCHAR) AS b FROM conversations),
sh AS (SELECT pr.a, pr.b, sum(least(x.n, y.n)) AS shared FROM pr JOIN tp x ON x.doc = pr.a JOIN tp y ON y.doc = pr.b AND x.kind = y.kind AND x.key = y.key GROUP BY ALL)
SELECT pr.a, pr.b, round(CASE WHEN coalesce(la.len, 0) + coalesce(lb.len, 0) = 0 THEN 1.0 ELSE 2 * coalesce(shared, 0) / (coalesce(la.len, 0) + coalesce(lb.len, 0)) END, 6) AS similarity
FROM pr LEFT JOIN tl la ON la.doc = pr.a LEFT JOIN tl lb ON lb.doc = pr.b LEFT JOIN sh ON sh.a = pr.a AND sh.b = pr.b""")
def i2(spark, sf):
    pairs = table(spark, sf, "conversations").selectExpr("'talk' as corpus", "cast(conv_id as string) as a", "cast(conv_id + 1 as string) as b").distinct()
    return SK.similarity(pairs, turns(spark, sf)).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("i3_medoid", f"""WITH {_TURN_SQL}, pairs AS (SELECT x.doc AS a, y.doc AS b, 2 * sum(least(x.n, y.n)) / any_value(lx.len + ly.len) AS sim
 FROM tp x JOIN tp y ON x.kind = y.kind AND x.key = y.key AND x.doc <> y.doc JOIN tl lx ON lx.doc = x.doc JOIN tl ly ON ly.doc = y.doc GROUP BY ALL)
SELECT tl.doc, round(coalesce(sum(sim), 0), 6) AS score FROM tl LEFT JOIN pairs ON a = tl.doc GROUP BY ALL""")
def i3(spark, sf):
    return SK.medoid_scores(turns(spark, sf)).select("doc", F.round("score", 6).alias("score"))


@query("i4_align", f"WITH RECURSIVE {_TURN_SQL},{align_sql('tn', 'al')} SELECT doc, pos, kind, col FROM al")
def i4(spark, sf):
    t = turns(spark, sf)
    totals = t.select("corpus", "doc").distinct().groupBy("corpus").agg(F.count("*").alias("n_docs"))
    return SK.align(t, totals).select("doc", "pos", "kind", "col")


@query("i5_two_tier", f"WITH RECURSIVE {TIER_SQL} SELECT doc, CAST(pos AS INT) AS pos, section, col FROM al")
def i5(spark, sf):
    return aligned(spark, sf).select("doc", "pos", "section", "col")


@query("i6_wide_sections", f"""WITH {LINES_SQL} SELECT corpus, '' AS section, max(n) AS widest FROM (SELECT lang AS corpus, doc, count(*) AS n FROM tb GROUP BY ALL) GROUP BY corpus HAVING max(n) > 30""")
def i6(spark, sf):
    rows = lines(spark, sf).select(F.col("lang").alias("corpus"), F.lit("").alias("section"), "doc")
    return SK.wide_sections(rows, 30)


@query("i7_column_stats", f"WITH RECURSIVE {STATS_SQL} SELECT section, col, members, round(occupancy, 6) AS occupancy, modal_kind, modal_key, round(agreement, 6) AS agreement, place, is_heading AND occupancy >= 0.75 AS required FROM st")
def i7(spark, sf):
    st = SK.column_stats(aligned(spark, sf), form_totals(spark, sf))
    return st.select("section", "col", "members", F.round("occupancy", 6).alias("occupancy"), "modal_kind", "modal_key", F.round("agreement", 6).alias("agreement"),
                     "place", (F.col("is_heading") & (F.col("occupancy") >= SK.PRESENT)).alias("required"))


@query("i8_split_variable_part", f"WITH RECURSIVE {TIER_SQL},{split_sql('al', B, 'spl')} SELECT section, col, doc, prefix, suffix, middle, is_field FROM spl")
def i8(spark, sf):
    a = aligned(spark, sf).select(*SL.BY, "doc", "text")
    return SK.split_variable_part(a, SL.BY).drop("corpus")


@query("j1_slot_kinds", f"WITH RECURSIVE {SLOT_SQL} SELECT section, col, kind, role, optional, round(occupancy, 6) AS occupancy, round(text_agreement, 6) AS agreement, framed, prefix, suffix, review AS needs_review FROM s1")
def j1(spark, sf):
    s = SL.classify_columns(aligned(spark, sf), form_totals(spark, sf))
    return s.select("section", "col", "kind", "role", "optional", F.round("occupancy", 6).alias("occupancy"), F.round("agreement", 6).alias("agreement"), "framed", "prefix", "suffix", "needs_review")


@query("j2_enforced", f"WITH RECURSIVE {SLOT_SQL} SELECT section, col, enforced FROM s1")
def j2(spark, sf):
    return SL.classify_columns(aligned(spark, sf), form_totals(spark, sf)).select("section", "col", "enforced")


@query("j3_names", f"WITH RECURSIVE {NAME_SQL} SELECT section, col, base AS name, CAST(name_confidence AS DOUBLE) AS confidence, name_source AS source FROM named WHERE kind = 'placeholder'")
def j3(spark, sf):
    _, n, _ = named(spark, sf)
    return n.where("kind = 'placeholder'").select("section", "col", F.regexp_replace("name", "_[0-9]+$", "").alias("n"), "name", F.col("name_confidence").alias("confidence"), F.col("name_source").alias("source")).drop("n")


@query("j4_unique_names", f"WITH RECURSIVE {NAME_SQL} SELECT idx, name, needs_review FROM named WHERE kind = 'placeholder'")
def j4(spark, sf):
    return named(spark, sf)[1].where("kind = 'placeholder'").select(F.col("index").cast("bigint").alias("idx"), "name", "needs_review")


# unpivoted columns of the star schema
_COLS = [("customer", "c_name", "c_name"), ("customer", "segment", "c_mktsegment"), ("orders", "priority", "o_orderpriority"),
         ("orders", "status", "o_orderstatus"), ("orders", "date", "CAST(CAST(o_orderdate AS DATE) AS {STR})"), ("part", "brand", "p_brand"),
         ("part", "name", "p_name"), ("part", "size", "CAST(p_size AS {STR})"), ("supplier", "s_name", "s_name"), ("pages", "url", "url"),
         ("nation", "nation", "n_name"), ("part", "person", "'J. ' || upper(left(p_name, 1)) || substr(p_name, 2, 3)")]
_COL_SQL = "uv AS (" + " UNION ALL ".join(f"SELECT '{n}' AS col, {e.format(STR='VARCHAR')} AS value FROM {t}" for t, n, e in _COLS) + ")"


def unpivoted(spark, sf):
    out = None
    for t, n, e in _COLS:
        df = table(spark, sf, t).select(F.lit(n).alias("col"), F.expr(e.format(STR="STRING")).alias("value"))
        out = df if out is None else out.unionByName(df)
    return out


_PAT_SQL = """dv AS (SELECT col, value, count(*) AS n FROM uv WHERE value <> '' GROUP BY ALL),
sh AS (SELECT col, regexp_extract_all(value, '[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+') AS ps FROM dv),
sm AS (SELECT col FROM sh GROUP BY col HAVING min(len(ps)) = max(len(ps))),
pc AS (SELECT col, at_, piece, CASE WHEN regexp_full_match(piece, '[0-9]+') THEN 'digit' WHEN regexp_full_match(piece, '\\p{Lu}+') THEN 'upper' WHEN regexp_full_match(piece, '\\p{Ll}+') THEN 'lower' ELSE 'literal' END AS k
  FROM (SELECT col, unnest(ps) AS piece, generate_subscripts(ps, 1) AS at_ FROM sh JOIN sm USING (col))),
pa AS (SELECT col, at_, count(DISTINCT k) = 1 AND (min(k) <> 'literal' OR count(DISTINCT piece) = 1) AS good,
  CASE min(k) WHEN 'literal' THEN regexp_replace(min(piece), '([()\\[\\]{}?*+\\-|^$\\\\.&~# \\t\\n\\r\\x0b\\f])', '\\\\\\1', 'g')
   ELSE CASE min(k) WHEN 'digit' THEN '\\d' WHEN 'upper' THEN '[A-Z]' ELSE '[a-z]' END || CASE WHEN min(len(piece)) = max(len(piece)) THEN '{' || min(len(piece)) || '}' ELSE '{' || min(len(piece)) || ',' || max(len(piece)) || '}' END END AS part
  FROM pc GROUP BY ALL),
pt AS (SELECT col, '^' || string_agg(part, '' ORDER BY at_) || '$' AS pattern FROM pa GROUP BY col HAVING bool_and(good) AND regexp_matches(string_agg(part, ''), '[\\[\\\\]'))"""


@query("j5_value_types", f"""WITH {_COL_SQL},{_PAT_SQL},
fl AS (SELECT col, bool_and(len(string_split(value, ' ')) <= 5 AND (regexp_matches(value, '(?i)\\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)') OR regexp_matches(value, '(^|\\s)\\d{{1,4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,4}}(\\s|$)'))
   AND try_strptime(value, ['%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y', '%d/%m/%Y']) IS NOT NULL) AS dates, bool_and(TRY_CAST(replace(value, ',', '') AS DOUBLE) IS NOT NULL) AS numbers,
  bool_and(regexp_matches(value, '^[A-Z][A-Za-z.''-]*(?:\\s+[A-Z][A-Za-z.''-]*){{1,3}}$')) AS people, count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n_values FROM dv GROUP BY col),
ty AS (SELECT *, CASE WHEN dates THEN 'date' WHEN numbers THEN 'number' WHEN n_distinct <= 5 AND n_values >= 2 * n_distinct AND n_values >= 4 THEN 'enum' WHEN people THEN 'person' WHEN pattern IS NOT NULL THEN 'identifier' ELSE 'text' END AS value_type FROM fl LEFT JOIN pt USING (col))
SELECT col, value_type, CASE WHEN value_type = 'identifier' THEN pattern END AS pattern, n_distinct, n_values FROM ty""")
def j5(spark, sf):
    return SL.infer_types(unpivoted(spark, sf), ["col"])


@query("j6_shared_patterns", f"WITH {_COL_SQL},{_PAT_SQL} SELECT col, pattern FROM pt")
def j6(spark, sf):
    return SL.shared_patterns(unpivoted(spark, sf), ["col"])


_DONOR = "'7'"


@query("j7_exemplar_location", f"WITH RECURSIVE {NAME_SQL} SELECT sl.section, sl.col, CAST(a.pos AS INT) AS donor_index, coalesce(va.value, {collapse_sql('a.text')}) AS donor_value FROM sl LEFT JOIN (SELECT * FROM al WHERE doc = {_DONOR}) a USING ({B}) LEFT JOIN (SELECT * FROM va WHERE doc = {_DONOR}) va USING ({B})")
def j7(spark, sf):
    a, s, v = slots(spark, sf)
    return SL.locate_in_donor(s, a, v, donors(spark, sf)).select("section", "col", "donor_index", "donor_value")


def donors(spark, sf):
    return table(spark, sf, "customer").where("c_custkey = 7").select(F.lit("forms").alias("corpus"), F.col("c_custkey").cast("string").alias("doc"))


@query("j8_specs", f"""WITH RECURSIVE {NAME_SQL}, {_PAT_SQL.replace('FROM uv', 'FROM uvx').replace('dv AS', "uvx AS (SELECT section || chr(0) || col AS col, value FROM va), dv AS", 1)},
fl AS (SELECT col, false AS dates, bool_and(TRY_CAST(replace(value, ',', '') AS DOUBLE) IS NOT NULL) AS numbers, bool_and(regexp_matches(value, '^[A-Z][A-Za-z.''-]*(?:\\s+[A-Z][A-Za-z.''-]*){{1,3}}$')) AS people,
  count(*) AS n_distinct, sum(n) AS n_values FROM dv GROUP BY col),
ty AS (SELECT *, CASE WHEN numbers THEN 'number' WHEN n_distinct <= 5 AND n_values >= 2 * n_distinct AND n_values >= 4 THEN 'enum' WHEN people THEN 'person' WHEN pattern IS NOT NULL THEN 'identifier' ELSE 'text' END AS value_type FROM fl LEFT JOIN pt USING (col))
SELECT name, coalesce(value_type, 'text') AS type, NOT optional AS required, CASE WHEN value_type = 'identifier' THEN pattern END AS pattern, needs_review,
 CASE WHEN framed THEN prefix || '{{' || name || '}}' || suffix END AS template FROM named LEFT JOIN ty ON ty.col = named.section || chr(0) || named.col WHERE kind = 'placeholder'""")
def j8(spark, sf):
    _, n, v = named(spark, sf)
    return SL.specs(n, SL.infer_types(v, SL.BY)).select("name", "type", "required", "pattern", "needs_review", "template")


@query("j8_unconfident_required", f"WITH RECURSIVE {NAME_SQL} SELECT 'unconfident' AS list, name AS item FROM named WHERE kind = 'placeholder' AND NOT optional AND name_confidence < 0.7 UNION ALL SELECT 'required section', modal_text FROM sl WHERE is_heading AND NOT optional")
def j8_lists(spark, sf):
    _, n, _ = named(spark, sf)
    return SL.unconfident(n).select(F.lit("unconfident").alias("list"), F.col("name").alias("item")).unionByName(
        SL.required_sections(n).select(F.lit("required section").alias("list"), F.col("modal_text").alias("item")))


@query("j10_prompts", f"""WITH RECURSIVE {NAME_SQL}, lo AS (SELECT n.name, CAST(a.pos AS INT) AS donor_index, a.text AS block, va.value FROM named n JOIN (SELECT * FROM al WHERE doc = {_DONOR}) a USING ({B}) JOIN (SELECT * FROM va WHERE doc = {_DONOR}) va USING ({B}) WHERE n.kind = 'placeholder')
SELECT name, donor_index, CASE WHEN (length(block) - length(replace(block, value, ''))) // length(value) > 1 THEN 'value not unique in its block' END AS reason,
 CASE WHEN (length(block) - length(replace(block, value, ''))) // length(value) = 1 THEN replace(block, value, list_aggregate(list_transform(string_split(name, '_'), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ')) END AS text FROM lo""")
def j10(spark, sf):
    a, n, v = named(spark, sf)
    located = SL.locate_in_donor(n, a, v, donors(spark, sf))
    texts = a.join(small(donors(spark, sf).select("doc")), "doc").select("corpus", F.col("pos").alias("donor_index"), "text")
    return SL.prompts(located, texts).select("name", "donor_index", "reason", "text")
