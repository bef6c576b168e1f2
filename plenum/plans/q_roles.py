"""Roles of page blocks: half of the pages carry style names, the other half only looks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.operators import corpus as C
from plenum.operators import features as FE
from plenum.operators import locate as L
from plenum.operators import roles as R
from plenum.operators import votes as O
from plenum.plans import sqlparts as S
from plenum.plans.q_text import HTML_SQL, collapse_sql, page_blocks
from plenum.plans.registry import query, table
from plenum.skew import settle

# looks of the page blocks, valid in both dialects; tags of the pages stand for properties
LOOKS = {
    "style_name": "CASE WHEN CAST(doc AS INT) % 2 = 0 THEN style_name ELSE 'normal' END",
    "size": "CAST(CASE WHEN tag = 'title' THEN 36 WHEN tag = 'h1' THEN 32 WHEN tag = 'div' THEN 18 WHEN tag = 'footer' THEN 16 ELSE 20 END AS INT)",
    "font": "CASE WHEN part = 'nav' THEN 'Arial' ELSE 'Calibri' END",
    "bold": "bold OR tag = 'h1'",
    "keep_next": "tag = 'h1' OR CAST(doc AS INT) % 5 = 0",
    "alignment": "CASE WHEN tag = 'title' THEN 'center' WHEN tag = 'p' THEN 'both' END",
    "indent_left": "CAST(CASE WHEN tag = 'li' THEN 720 END AS INT)",
    "outline_level": "CAST(CASE WHEN tag = 'h1' AND CAST(doc AS INT) % 3 = 0 THEN 0 END AS INT)",
    "num_id": "CAST(CASE WHEN tag = 'li' THEN 1 END AS INT)",
    "ilvl": "CAST(CASE WHEN tag = 'li' THEN 0 END AS INT)",
    "is_bullet": "tag = 'li'",
    "has_drawing": "tag = 'div'",
    "ctx_kind": "CASE WHEN part = 'footer' THEN 'footer' ELSE 'body' END",
}


def features(spark, sf):
    b = page_blocks(spark, sf)
    cols = ["doc", F.col("idx").cast("int").alias("idx"), "tag", "text", F.col("part").alias("region")]
    looks = [F.expr(e).alias(n) for n, e in LOOKS.items()]
    fixed = [F.expr(e).alias(n) for n, e in {
        "part": "CASE WHEN part = 'footer' THEN 'footer' ELSE 'main' END", "kind": "'p'", "italic": "false",
        "caps": "false", "seq_kind": "cast(null as string)", "sdt_tag": "cast(null as string)"}.items()]
    df = FE.lexical(b.select(*cols, *looks, *fixed))
    return df.withColumn("is_empty", F.col("is_empty") & ~F.col("has_drawing"))


WORDS = f"CASE WHEN {collapse_sql('text')} = '' THEN 0 ELSE len(string_split({collapse_sql('text')}, ' ')) END"
FT_SQL = f"""{HTML_SQL},
ft0 AS (SELECT doc, CAST(idx AS INT) AS idx, tag, text, part AS region, {', '.join(f'{e} AS {n}' for n, e in LOOKS.items())},
  CASE WHEN part = 'footer' THEN 'footer' ELSE 'main' END AS part, {WORDS} AS words,
  regexp_matches({collapse_sql('text')}, '[.!?:;…]$') AS ends_with_terminal,
  regexp_full_match(regexp_replace(text, '[^\\p{{L}}]', '', 'g'), '\\p{{Lu}}+') AS all_caps,
  regexp_matches(text, '(?i)^\\s*(figure|fig\\.?|table|exhibit|chart|plate)\\s*[\\d\\w]') AS caption_lead FROM hb),
ft AS (SELECT *, {collapse_sql('text')} = '' AND NOT has_drawing AS is_empty FROM ft0),
adj AS (SELECT *,
  coalesce(last_value(CASE WHEN NOT is_empty THEN has_drawing END IGNORE NULLS) OVER (PARTITION BY doc, part ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS follows_graphic,
  coalesce(first_value(CASE WHEN NOT is_empty THEN has_drawing END IGNORE NULLS) OVER (PARTITION BY doc, part ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS precedes_graphic,
  CASE WHEN NOT is_empty AND ctx_kind = 'body' THEN sum(CASE WHEN NOT is_empty AND ctx_kind = 'body' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY idx) END AS body_ordinal
  FROM ft),
wt AS (SELECT doc, size, font, nullif(style_name, '') AS style, CASE WHEN words >= 8 AND ends_with_terminal AND outline_level IS NULL AND num_id IS NULL THEN words ELSE 0 END AS wp,
  greatest(words, 1) AS wf FROM ft WHERE NOT is_empty),
pv AS (SELECT doc, 'size' AS prop, CAST(size AS VARCHAR) AS val, wp, wf FROM wt UNION ALL SELECT doc, 'font', font, wp, wf FROM wt
  UNION ALL SELECT doc, 'style', style, wp, wf FROM wt),
pc AS (SELECT doc, prop, val, sum(wp) AS wp, sum(wf) AS wf FROM pv WHERE val IS NOT NULL GROUP BY ALL),
ph AS (SELECT doc, sum(CASE WHEN prop = 'size' THEN wp ELSE 0 END) > 0 AS has FROM pc GROUP BY doc),
pw AS (SELECT doc, prop, val, CASE WHEN has THEN wp ELSE wp + wf END AS w FROM pc JOIN ph USING (doc)),
pr AS (SELECT *, row_number() OVER (PARTITION BY doc, prop ORDER BY w DESC, val) AS rn FROM pw WHERE w > 0),
modal AS (SELECT doc, CAST(max(CASE WHEN prop = 'size' THEN val END) AS INT) AS modal_size, max(CASE WHEN prop = 'font' THEN val END) AS modal_font,
  max(CASE WHEN prop = 'style' THEN val END) AS modal_style FROM pr WHERE rn = 1 GROUP BY doc),
share AS (SELECT doc, style_name, count(*) / sum(count(*)) OVER (PARTITION BY doc) AS share FROM ft WHERE NOT is_empty GROUP BY doc, style_name),
cx AS (SELECT a.*, modal_size, coalesce(share, 0.0) AS share, coalesce(size, 20) / coalesce(modal_size, 20) AS size_ratio,
  concat_ws('|', style_name, size, bold, false, false, coalesce(alignment, '~'), coalesce(CAST(indent_left AS VARCHAR), '~'), coalesce(CAST(outline_level AS VARCHAR), '~'), coalesce(CAST(ilvl AS VARCHAR), '~'), is_bullet) AS signature
  FROM adj a LEFT JOIN modal USING (doc) LEFT JOIN share USING (doc, style_name))"""

_ROLE_OF = """CASE WHEN style_name = 'title' THEN 'title' WHEN style_name = 'subtitle' THEN 'subtitle'
 WHEN regexp_full_match(style_name, 'heading \\d') THEN 'heading' || style_name[9]
 WHEN style_name IN ('caption','figure caption','table caption') THEN 'caption' WHEN style_name IN ('quote','intense quote','block text') THEN 'quote'
 WHEN regexp_full_match(style_name, 'list bullet ?\\d?') THEN 'list_bullet' WHEN regexp_full_match(style_name, 'list (number|paragraph) ?\\d?') THEN 'list_number'
 WHEN style_name IN ('body text','normal','default paragraph','plain text','no spacing') THEN 'body' END"""
_XR = "CAST(CAST(round_even(size_ratio * 10, 0) / 10 AS DECIMAL(10,1)) AS VARCHAR) || 'x'"
SIG_SQL = f"""{FT_SQL},
sr AS (SELECT *, num_id IS NOT NULL AND num_id <> 0 AS numbered, {_ROLE_OF} AS r0 FROM cx),
sp AS (SELECT *, CASE WHEN r0 = 'body' AND numbered THEN NULL ELSE r0 END AS style_role FROM sr),
ev AS (
 SELECT doc, idx, 0 AS seq, style_role AS role, 0.35 AS weight, 'style ' || style_name || ' is shared by ' || CAST(CAST(round_even(share * 100, 0) AS BIGINT) AS VARCHAR) || '% of the paragraphs' AS evidence, true AS prior FROM sp WHERE style_role IS NOT NULL AND share >= 0.7 AND NOT is_empty
 UNION ALL SELECT doc, idx, 2, style_role, 0.85, 'style ' || style_name || ', unknown to the profile', false FROM sp WHERE style_role IS NOT NULL AND share < 0.7 AND NOT is_empty
 UNION ALL SELECT doc, idx, 3, 'heading' || (outline_level + 1), 0.90, 'outlined at depth ' || outline_level, false FROM sp WHERE outline_level < 9 AND NOT is_empty
 UNION ALL SELECT doc, idx, 4, CASE WHEN is_bullet THEN 'list_bullet' ELSE 'list_number' END, 0.95, 'list numbering, level ' || coalesce(ilvl, 0), false FROM sp WHERE numbered AND NOT is_empty
 UNION ALL SELECT doc, idx, 6, 'caption', 0.70, 'opens with caption wording, ' || CASE WHEN follows_graphic THEN 'follows' ELSE 'precedes' END || ' a graphic', false FROM sp WHERE caption_lead AND (follows_graphic OR precedes_graphic) AND NOT is_empty
 UNION ALL SELECT doc, idx, 7, 'title', 0.65, {_XR} || ' as large as body text, among the first paragraphs', false FROM sp WHERE NOT numbered AND size_ratio >= 1.8 AND words < 25 AND body_ordinal <= 3 AND NOT is_empty
 UNION ALL SELECT doc, idx, 8, 'heading', 0.65, {_XR} || ' as large as body text', false FROM sp WHERE NOT numbered AND NOT is_empty AND ((size_ratio >= 1.8 AND words < 25 AND coalesce(body_ordinal > 3, true)) OR (size_ratio >= 1.12 AND NOT (size_ratio >= 1.8 AND words < 25) AND words < 30 AND NOT ends_with_terminal))
 UNION ALL SELECT doc, idx, 9, 'caption', 0.55, {_XR} || ' of body text size, beside a graphic', false FROM sp WHERE NOT numbered AND size_ratio <= 0.92 AND (follows_graphic OR precedes_graphic) AND NOT is_empty
 UNION ALL SELECT doc, idx, 10, 'body', 0.60, 'sized like body text', false FROM sp WHERE NOT numbered AND size_ratio BETWEEN 0.93 AND 1.07 AND NOT is_empty
 UNION ALL SELECT doc, idx, 11, 'heading', 0.60, 'short bold line without end mark that stays with the next', false FROM sp WHERE bold AND words > 0 AND words < 12 AND NOT ends_with_terminal AND keep_next AND NOT is_empty
 UNION ALL SELECT doc, idx, 12, 'heading', 0.45, 'few words, all capitals', false FROM sp WHERE all_caps AND words > 0 AND words < 12 AND NOT ends_with_terminal AND NOT is_empty
 UNION ALL SELECT doc, idx, 91, 'empty', 0.99, 'blank', false FROM sp WHERE is_empty),
sg AS (SELECT * FROM ev UNION ALL SELECT doc, idx, 90, 'body', 0.50, 'no sign of anything but body text', false FROM sp
 WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.doc = sp.doc AND ev.idx = sp.idx AND NOT ev.prior))"""

SCORE_SQL = f"""{SIG_SQL},
s1 AS (SELECT doc, idx, role, min(seq) AS seq, greatest(1 - coalesce(product(1 - CAST(CASE WHEN NOT prior THEN weight END AS DOUBLE)), 1.0),
   coalesce(max(CASE WHEN prior THEN weight END), 0.0)) AS score FROM sg GROUP BY ALL),
hd AS (SELECT doc, idx, score AS h FROM s1 WHERE role = 'heading'),
bl AS (SELECT doc, idx, role AS best FROM (SELECT *, row_number() OVER (PARTITION BY doc, idx ORDER BY score DESC, seq) AS rn FROM s1 WHERE regexp_matches(role, '^heading.')) WHERE rn = 1),
s2 AS (SELECT s1.doc, s1.idx, role, CASE WHEN role = best AND h IS NOT NULL THEN 1 - (1 - score) * (1 - h) ELSE score END AS score
  FROM s1 LEFT JOIN hd USING (doc, idx) LEFT JOIN bl USING (doc, idx) WHERE NOT (role = 'heading' AND best IS NOT NULL)),
s3 AS (SELECT *, row_number() OVER (PARTITION BY doc, idx ORDER BY round(score, 12) DESC, role) AS rn FROM s2),
alt AS (SELECT doc, idx, string_agg(role || '=' || CAST(CAST(round(score, 3) AS DECIMAL(6,3)) AS VARCHAR), ';' ORDER BY rn) AS alternatives FROM s3 WHERE rn BETWEEN 2 AND 4 GROUP BY ALL),
c0 AS (SELECT cx.*, s3.role, s3.score AS confidence, TRY_CAST(nullif(regexp_extract(s3.role, '^heading(\\d+)$', 1), '') AS INT) AS level, coalesce(alternatives, '') AS alternatives
  FROM cx JOIN s3 USING (doc, idx) LEFT JOIN alt USING (doc, idx) WHERE rn = 1),
c1 AS (SELECT * REPLACE (CASE WHEN role = 'title' AND nth > 1 THEN 'heading' ELSE role END AS role) FROM
  (SELECT *, sum(CASE WHEN role = 'title' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY idx) AS nth FROM c0)),
fm AS (SELECT doc, idx, dense_rank() OVER (PARTITION BY doc ORDER BY -coalesce(size, 0), NOT bold, coalesce(indent_left, 0)) AS rnk FROM c1 WHERE role = 'heading'),
bs AS (SELECT doc, greatest(1, coalesce(min(level), 1)) AS base FROM c1 GROUP BY doc),
c2 AS (SELECT c1.* REPLACE (CASE WHEN role = 'heading' THEN 'heading' || least(9, base + rnk - 1) ELSE role END AS role,
  CAST(CASE WHEN role = 'heading' THEN least(9, base + rnk - 1) ELSE level END AS INT) AS level) FROM c1 LEFT JOIN fm USING (doc, idx) JOIN bs USING (doc)),
gv AS (SELECT doc, signature, role, round(sum(confidence), 9) AS votes, count(*) AS n FROM c2 WHERE NOT is_empty GROUP BY ALL),
gw AS (SELECT doc, signature, role AS w_role, votes, tot FROM (SELECT *, sum(n) OVER (PARTITION BY doc, signature) AS tot,
  row_number() OVER (PARTITION BY doc, signature ORDER BY votes DESC, role DESC) AS rn FROM gv) WHERE rn = 1 AND tot >= 3),
mv AS (SELECT c2.doc, c2.idx, w_role, least(0.95, votes / tot) AS w_conf FROM c2 JOIN gw USING (doc, signature) WHERE NOT is_empty AND w_role <> role),
c3 AS (SELECT c2.* REPLACE (coalesce(w_role, role) AS role, coalesce(w_conf, confidence) AS confidence,
  CASE WHEN w_role IS NOT NULL THEN TRY_CAST(nullif(regexp_extract(w_role, '^heading(\\d+)$', 1), '') AS INT) ELSE level END AS level) FROM c2 LEFT JOIN mv USING (doc, idx)),
hs AS (SELECT doc, idx, level, row_number() OVER (PARTITION BY doc ORDER BY idx) AS i FROM c3 WHERE level IS NOT NULL),
hf AS (SELECT doc, idx, CAST(i + min(level - i) OVER (PARTITION BY doc ORDER BY idx) AS INT) AS fixed FROM hs),
c4 AS (SELECT c3.* REPLACE (CASE WHEN fixed < level THEN 'heading' || fixed ELSE role END AS role, CASE WHEN fixed < level THEN fixed ELSE level END AS level,
  CASE WHEN fixed < level THEN confidence * 0.9 ELSE confidence END AS confidence) FROM c3 LEFT JOIN hf USING (doc, idx)),
cl AS (SELECT *, confidence < 0.55 AS needs_review FROM c4)"""


def context(spark, sf):
    # the features are measured once; context and classification read them several times
    return FE.context(settle(features(spark, sf)))


def classified(spark, sf):
    return R.classify(context(spark, sf))


@query("d4_graphic_adjacency", f"WITH {FT_SQL} SELECT doc, idx, follows_graphic, precedes_graphic FROM adj")
def d4(spark, sf):
    return FE.adjacency(features(spark, sf)).select("doc", "idx", "follows_graphic", "precedes_graphic")


@query("d5_modal_body", f"WITH {FT_SQL} SELECT * FROM modal")
def d5(spark, sf):
    return FE.modal_body(features(spark, sf))


@query("d6_style_share", f"WITH {FT_SQL} SELECT doc, style_name, round(share, 6) AS share FROM share")
def d6(spark, sf):
    return FE.style_share(features(spark, sf)).select("doc", "style_name", F.round("share", 6).alias("share"))


@query("d7_size_ratio", f"WITH {FT_SQL} SELECT doc, idx, round(size_ratio, 6) AS size_ratio FROM cx")
def d7(spark, sf):
    return context(spark, sf).select("doc", "idx", F.round("size_ratio", 6).alias("size_ratio"))


@query("d8_format_signature", f"WITH {FT_SQL} SELECT doc, signature, count(*) AS n FROM cx GROUP BY ALL")
def d8(spark, sf):
    return features(spark, sf).groupBy("doc", FE.signature().alias("signature")).agg(F.count("*").alias("n"))


@query("d9_direct_density", """SELECT CAST(l_orderkey AS VARCHAR) AS doc, count(*) AS runs, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS direct_runs,
 round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS direct_density, count(DISTINCT l_returnflag) AS styles_used FROM lineitem GROUP BY l_orderkey""")
def d9(spark, sf):
    runs = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc"),
                                               (F.col("l_discount") > 0.05).alias("direct"), F.col("l_returnflag").alias("style_name"))
    return FE.direct_density(runs, ["doc"]).withColumn("direct_density", F.round("direct_density", 6))


@query("e1_signals", f"WITH {SIG_SQL} SELECT doc, idx, role, CAST(weight AS DOUBLE) AS weight, evidence, prior FROM sg")
def e1(spark, sf):
    return R.signals(context(spark, sf)).select("doc", "idx", F.inline("signals")).select("doc", "idx", "role", "weight", "evidence", "prior")


@query("e2_scores", f"WITH {SCORE_SQL} SELECT doc, idx, role, round(confidence, 6) AS confidence, alternatives FROM c0")
def e2(spark, sf):
    alt = F.expr("array_join(transform(alternatives, a -> concat(a.role, '=', cast(cast(a.score as decimal(6,3)) as string))), ';')")
    return R.score(R.signals(context(spark, sf))).select("doc", "idx", "role", F.round("confidence", 6).alias("confidence"),
                                                         alt.alias("alternatives"))


@query("e3_one_title", f"WITH {SCORE_SQL} SELECT doc, idx, role FROM c1 WHERE role IN ('title', 'heading')")
def e3(spark, sf):
    return R.one_title(R.score(R.signals(context(spark, sf)))).where("role in ('title', 'heading')").select("doc", "idx", "role")


@query("e4_heading_levels", f"WITH {SCORE_SQL} SELECT doc, idx, role, level FROM c2 WHERE level IS NOT NULL")
def e4(spark, sf):
    return R.assign_levels(R.one_title(R.score(R.signals(context(spark, sf))))).where("level is not null").select("doc", "idx", "role", "level")


@query("e5_consistency", f"WITH {SCORE_SQL} SELECT doc, idx, role, round(confidence, 6) AS confidence FROM c3")
def e5(spark, sf):
    scored = R.score(R.signals(context(spark, sf)))
    return R.enforce_consistency(R.assign_levels(R.one_title(scored))).select("doc", "idx", "role", F.round("confidence", 6).alias("confidence"))


@query("e6_classified", f"WITH {SCORE_SQL} SELECT doc, idx, role, level, round(confidence, 6) AS confidence, needs_review FROM cl")
def e6(spark, sf):
    return classified(spark, sf).select("doc", "idx", "role", "level", F.round("confidence", 6).alias("confidence"), "needs_review")


@query("e7_role_counts", f"WITH {SCORE_SQL} SELECT doc, role, count(*) AS n FROM cl GROUP BY ALL")
def e7(spark, sf):
    return R.role_counts(classified(spark, sf))


@query("e7_explain", f"WITH {SIG_SQL} SELECT sg.doc, sg.idx, role, CAST(weight AS DOUBLE) AS weight, evidence FROM sg JOIN cx USING (doc, idx) WHERE contains(text, 'the')")
def e7_explain(spark, sf):
    return R.explain(R.signals(context(spark, sf)), "the").select("doc", "idx", "role", "weight", "evidence")


_ROLE_OBS = """obs AS (SELECT 'all' AS corpus, doc, '/roles/' || role || '/run/size' AS pointer, 'sz' AS tag, CAST(size AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS str FROM cl WHERE {w}
 UNION ALL SELECT 'all', doc, '/roles/' || role || '/run/bold', 'b', NULL, CAST(bold AS VARCHAR) FROM cl WHERE {w}
 UNION ALL SELECT 'all', doc, '/roles/' || role || '/para/alignment', 's', NULL, alignment FROM cl WHERE {w} AND alignment IS NOT NULL
 UNION ALL SELECT 'all', doc, '/roles/' || role || '/para/indent_left', 'len', CAST(indent_left AS DOUBLE), NULL FROM cl WHERE {w} AND indent_left IS NOT NULL)""".format(
    w="NOT is_empty AND NOT needs_review AND role <> 'empty' AND ctx_kind = 'body'")


@query("f4_role_ballots", f"WITH {SCORE_SQL},{_ROLE_OBS} SELECT pointer, tag, coalesce(str, CAST(CAST(num AS BIGINT) AS VARCHAR)) AS value, count(*) AS n, count(DISTINCT doc) AS docs FROM obs GROUP BY ALL")
def f4(spark, sf):
    return R.role_ballots(classified(spark, sf)).groupBy(
        "pointer", "tag", F.coalesce("str", F.col("num").cast("bigint").cast("string")).alias("value")).agg(
        F.count("*").alias("n"), F.countDistinct("doc").alias("docs"))


@query("f4_role_votes", f"""WITH {SCORE_SQL},{_ROLE_OBS},{S.votes("SELECT 'all' AS corpus, CAST(page_id AS VARCHAR) AS doc FROM pages")}
SELECT pointer, bkey, observed_in, modal_count, n_docs, status FROM votes""")
def f4_votes(spark, sf):
    docs = table(spark, sf, "pages").select(F.lit("all").alias("corpus"), F.col("page_id").cast("string").alias("doc"))
    return O.vote_all(R.role_ballots(classified(spark, sf)), docs).select("pointer", "bkey", "observed_in", "modal_count", "n_docs", "status")


_HP = " || ".join(
    f"CASE WHEN h{k} IS NOT NULL AND h{k}.idx > greatest(-1, {', '.join(f'coalesce(h{j}.idx, -1)' for j in range(k)) or '-1'}) THEN h{k}.title || ' > ' ELSE '' END"
    for k in range(10))
LOC_SQL = f"""{SCORE_SQL},
lv AS (SELECT *, CASE WHEN role = 'title' THEN 0 ELSE TRY_CAST(nullif(regexp_extract(role, '^heading(\\d+)$', 1), '') AS INT) END AS lev,
  CASE WHEN {collapse_sql('text')} = '' THEN '(untitled)' ELSE {collapse_sql('text')} END AS ttl FROM cl),
hh AS (SELECT *, {', '.join(f"last_value(CASE WHEN lev = {k} THEN {{'idx': idx, 'title': ttl}} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx ROWS UNBOUNDED PRECEDING) AS h{k}" for k in range(10))},
  sum(CASE WHEN lev IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY idx) AS sec FROM lv),
loc AS (SELECT *, {_HP} AS hp, row_number() OVER (PARTITION BY doc, sec ORDER BY idx) AS ordinal, count(*) OVER (PARTITION BY doc, sec) AS total FROM hh)"""


@query("p17_heading_path", f"WITH {LOC_SQL} SELECT doc, idx, regexp_replace(hp, ' > $', '') AS heading_path FROM loc")
def p17(spark, sf):
    return L.heading_paths(classified(spark, sf)).select("doc", "idx", F.array_join("heading_path", " > ").alias("heading_path"))


@query("p18_ordinal_container", f"WITH {LOC_SQL} SELECT doc, idx, ordinal, total AS of_total, ctx_kind AS container FROM loc")
def p18(spark, sf):
    b = classified(spark, sf).withColumns({"table_depth": F.lit(0), "table_no": F.lit(0), "row": F.lit(0), "col": F.lit(0),
                                           "in_textbox": F.lit(False), "in_sdt": F.lit(False)})
    return L.containers(L.ordinals(b)).select("doc", "idx", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("of").alias("of_total"), "container")


_FLAT = collapse_sql("text")


@query("p19_find_string", f"""WITH {HTML_SQL}, f AS (SELECT doc, idx, {_FLAT} AS flat FROM hb),
w AS (SELECT doc, string_agg(flat, chr(10) ORDER BY idx) AS whole FROM f WHERE flat <> '' GROUP BY doc),
c AS (SELECT f.doc, f.idx, k, flat, whole, array_to_string(string_split(flat, ' ')[1:k], ' ') AS cand
  FROM f JOIN w USING (doc), range(5, 15) t(k) WHERE flat <> ''),
u AS (SELECT doc, idx, min(CASE WHEN length(whole) - length(replace(whole, cand, '')) <= length(cand) THEN k END) AS k FROM c GROUP BY ALL)
SELECT f.doc, CAST(f.idx AS INT) AS idx, CASE WHEN flat = '' THEN '' ELSE array_to_string(string_split(flat, ' ')[1:coalesce(k, 14)], ' ') END AS find_string
FROM f LEFT JOIN u USING (doc, idx)""")
def p19(spark, sf):
    return L.find_strings(page_blocks(spark, sf)).select("doc", F.col("idx").cast("int").alias("idx"), "find_string")


@query("t7_cover", f"WITH {SCORE_SQL} SELECT doc, idx, tag FROM (SELECT *, min(CASE WHEN level IS NOT NULL THEN idx END) OVER (PARTITION BY doc) AS first_h FROM cl) WHERE idx < first_h")
def t7(spark, sf):
    return L.cover(classified(spark, sf)).select("doc", "idx", "tag")


META_FIX = {"in_textbox": "false", "in_sdt": "tag = 'footer'", "in_ins": "false", "in_del": "false"}
# a block's sentences are its runs; what the page says of them stands for their properties, valid in both dialects
RUN_MARKERS = "CASE WHEN region = 'nav' THEN {a}'u', 'color'{b} WHEN sentence LIKE '%***%' THEN {a}'b', 'highlight'{b} WHEN bold THEN {a}'b', 'i'{b} ELSE {a}'rStyle'{b} END"


def page_runs(spark, sf):
    cut = features(spark, sf).select("doc", "idx", "region", "bold", F.explode(F.split("text", "\\. ", -1)).alias("sentence"))
    return cut.select("doc", "idx", F.expr(RUN_MARKERS.format(a="array(", b=")")).alias("markers"))


def meta(spark, sf):
    f = features(spark, sf)
    closed = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("doc"), "html").select(
        "doc", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("corpus"), F.endswith("html", F.lit("</html>")).alias("closed"))
    f = f.withColumns({n: F.expr(e) for n, e in META_FIX.items()}).withColumn(
        "part", F.when(F.col("region") == "nav", "nav").otherwise(F.col("part"))).withColumn(
        "ctx_kind", F.when(F.col("region") == "nav", "header").otherwise(F.col("ctx_kind")))
    return FE.doc_meta(f, page_runs(spark, sf)).join(closed, "doc")


_META_SQL = f"""{FT_SQL}, pg AS (SELECT CAST(page_id AS VARCHAR) AS doc, regexp_extract(html, 'lang="([a-z]+)"', 1) AS corpus, html LIKE '%</html>' AS closed FROM pages),
rw AS (SELECT doc, idx, count(*) AS n_runs, count(CASE WHEN list_has_any(markers, ['rFonts', 'sz', 'szCs', 'color', 'highlight', 'shd', 'spacing', 'position', 'kern', 'u', 'bdr', 'em']) THEN 1 END) AS n_direct FROM
  (SELECT doc, idx, {RUN_MARKERS.format(a='[', b=']')} AS markers FROM (SELECT doc, idx, region, bold, unnest(string_split(text, '. ')) AS sentence FROM ft)) GROUP BY ALL),
meta AS (SELECT doc, any_value(pg.corpus) AS corpus, any_value(closed) AS closed, count(*) AS blocks, count(*) AS paragraphs, CAST(sum(n_runs) AS BIGINT) AS runs, CAST(sum(n_direct) AS BIGINT) AS direct_runs,
 sum(n_direct) / sum(n_runs) AS direct_density, count(DISTINCT style_name) AS styles_used, count(DISTINCT num_id) AS list_count,
 CAST(max(CASE WHEN region = 'nav' THEN 1 ELSE 0 END) AS BIGINT) AS header_parts, CAST(max(CASE WHEN region = 'footer' THEN 1 ELSE 0 END) AS BIGINT) AS footer_parts,
 bool_or(tag = 'footer') AS has_content_controls FROM ft JOIN pg USING (doc) JOIN rw USING (doc, idx) GROUP BY doc)"""


@query("a14_doc_meta", f"WITH {_META_SQL} SELECT doc, blocks, paragraphs, runs, direct_runs, round(direct_density, 6) AS direct_density, styles_used, list_count, header_parts, footer_parts, has_content_controls FROM meta")
def a14(spark, sf):
    return meta(spark, sf).select("doc", "blocks", "paragraphs", "runs", "direct_runs", F.round("direct_density", 6).alias("direct_density"),
                                  "styles_used", "list_count", "header_parts", "footer_parts", "has_content_controls")


_STYLE_OBS = """obs AS (SELECT pg.corpus, ft.doc, '/styles/paragraph/' || style_name || '/run/size' AS pointer, 'sz' AS tag, CAST(size AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS str FROM ft JOIN pg USING (doc))"""


@query("h7_donor_scores", f"""WITH {_META_SQL}, {_STYLE_OBS},{S.votes("SELECT corpus, doc FROM pg")},
agr AS (SELECT dv.corpus, dv.doc, avg(CASE WHEN dv.bkey = votes.bkey THEN 1.0 ELSE 0.0 END) AS agreement FROM dv JOIN votes USING (corpus, pointer) GROUP BY ALL),
want AS (SELECT DISTINCT corpus, string_split(pointer, '/')[4] AS style FROM votes WHERE in_donor),
nw AS (SELECT corpus, count(*) AS wanted FROM want GROUP BY corpus),
had AS (SELECT corpus, doc, count(*) AS had FROM (SELECT DISTINCT pg.corpus, doc, style_name AS style FROM ft JOIN pg USING (doc)) JOIN want USING (corpus, style) GROUP BY ALL),
sc AS (SELECT corpus, doc, coalesce(agreement, 0.0) AS agreement, coalesce(had, 0) / wanted AS role_coverage,
 ((header_parts > 0)::INT + (footer_parts > 0)::INT + (list_count > 0)::INT + 1 + (paragraphs >= 10)::INT) / 5 AS completeness, direct_density, NOT closed AS disqualified
 FROM meta LEFT JOIN agr USING (corpus, doc) LEFT JOIN had USING (corpus, doc) JOIN nw USING (corpus))
SELECT corpus, doc, round(agreement, 6) AS agreement, round(role_coverage, 6) AS role_coverage, round(completeness, 6) AS completeness, disqualified,
 CASE WHEN NOT disqualified THEN round(0.45 * agreement + 0.30 * role_coverage + 0.25 * completeness - 0.60 * direct_density, 6) END AS score,
 row_number() OVER (PARTITION BY corpus ORDER BY CASE WHEN disqualified THEN '-inf'::DOUBLE ELSE 0.45 * agreement + 0.30 * role_coverage + 0.25 * completeness - 0.60 * direct_density END DESC, doc) AS place FROM sc""")
def h7(spark, sf):
    m = meta(spark, sf).withColumn("section_count", F.lit(1)).withColumn("disqualified", ~F.col("closed"))
    styles = features(spark, sf).join(m.select("doc", "corpus"), "doc").select("corpus", "doc", F.col("style_name").alias("style"), "size")
    obs = styles.select("corpus", "doc", F.concat(F.lit("/styles/paragraph/"), "style", F.lit("/run/size")).alias("pointer"), F.lit("sz").alias("tag"),
                        F.col("size").cast("double").alias("num"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("string").alias("rule"))
    docs = m.select("corpus", "doc")
    dv = O.document_votes(obs)
    v = O.votes(dv, O.corpus_sizes(docs))
    scores = C.ranked(C.donor_scores(C.agreement_by_document(dv, v, docs), m, styles, v))
    return scores.select("corpus", "doc", *[F.round(c, 6).alias(c) for c in ("agreement", "role_coverage", "completeness")], "disqualified",
                         F.when(~F.col("disqualified"), F.round("score", 6)).alias("score"), "place")
