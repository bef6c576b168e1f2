"""Steps whose time or memory must not grow faster than their input."""

import re

from pyspark.sql import functions as F

from plenum.functions import keys as K
from plenum.operators import content as CO
from plenum.operators import fields as FI
from plenum.operators import fill as FL
from plenum.operators import locate as LO
from plenum.operators import verify as VE
from plenum.plans import q_fields, q_fill, q_text
from plenum.sources import text as X

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_markers_are_looked_for_once_and_on_all_cores(spark):
    letters = q_fields.letters(spark, SF)
    assert letters.rdd.getNumPartitions() >= 8
    found = FI.markers(letters)
    assert sum(line.count("regexp_extract_all(") for line in plan(found).splitlines()) == len(FI.MARKERS)


def test_answers_are_kept_once_and_never_sorted(spark):
    saved = FL.session(FL.fill(q_fill.template(spark, SF), q_fill.records(spark, SF)))
    n = saved.select("record").distinct().count()
    assert saved.where("answers is not null").count() == n < saved.count()
    again = FL.refill(saved, q_fill.template(spark, SF), saved.limit(0).select("record", F.col("answers").alias("changes")))
    assert "any_value" not in plan(again)
    assert again.select("record", "idx", "text").exceptAll(saved.select("record", "idx", "text")).count() == 0 and again.count() == saved.count()


def test_outputs_without_answers_are_refilled_too(spark):
    t = FL.templates(spark.createDataFrame([(1, 0, "{{a}}!"), (1, 1, "{{b}}?")], "template_id int, idx int, text string"))
    r = spark.createDataFrame([("r", 1, None), ("s", 1, {"b": None})], "record string, template_id int, answers map<string,string>")
    changed = spark.createDataFrame([("r", {"a": "y"})], "record string, changes map<string,string>")
    got = FL.refill(FL.session(FL.fill(t, r)), t, changed)
    assert {(x.record, x.idx, x.text) for x in got.collect()} == {("r", 0, "y!"), ("r", 1, "{{b}}?"), ("s", 0, "{{a}}!"), ("s", 1, "?")}


def test_lines_are_keyed_on_all_cores_and_travel_as_digests(spark):
    lines = q_text.lines(spark, SF)
    assert lines.rdd.getNumPartitions() >= 8
    snap = spark.createDataFrame([("d", False, 0, "k")], "doc string, chrome boolean, seq int, key string")
    dealt = [line for line in plan(VE.text_faults(snap, snap.limit(1))).splitlines() if "RepartitionByExpression" in line or "Union" in line]
    assert dealt and "xxhash64" in plan(VE.text_faults(snap, snap.limit(1))).split("RepartitionByExpression")[1]


def test_plain_text_is_told_by_cheap_searches_and_nothing_else_is(spark):
    texts = ["", "a", "a b", "naïve Größe", " a", "a ", "a  b", "a\n", "a\tb", "a\u00a0b", "x\u2028", "e\u0301", "\u00ad", "½", "a – b", "“q”", "…", None]
    got = {r.t: (r.k, r.plain) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", K.match_key(F.col("t")).alias("k"), K._plain(F.col("t")).alias("plain")).collect()}
    assert [t for t in texts if got[t][1]] == ["", "a", "a b", "naïve Größe"]
    assert got["a  b"][0] == got["a\tb"][0] == got["a\u00a0b"][0] == "a b" and got["e\u0301"][0] == "é" and got["a\n"][0] == "a" and got[None][0] is None


def test_pages_are_cut_with_one_sort_and_rows_and_cells_counted_as_before(spark):
    blocks = q_text.page_blocks(spark, SF)
    assert len(re.findall(r"\bSort \[", blocks._jdf.queryExecution().executedPlan().toString())) == 1
    assert blocks.rdd.getNumPartitions() >= 8
    tags = "td table td tr th td table tr td /table td tr td /table p tr td table td /table".split()
    df = spark.createDataFrame([("d", "".join(f"<{t}>{i}" for i, t in enumerate(tags)))], "doc string, html string")
    got = {r.text: (r.row, r.col) for r in X.html_blocks(df, F.col("doc"), F.col("html")).collect()}
    want, tbl, tr, depth = {}, 0, 0, 0
    for i, t in enumerate(tags):
        depth += (t == "table") - (t == "/table")
        tbl, tr = tbl + (t == "table"), tr + (t == "tr")
        so_far = [(tags[j], tags[: j + 1].count("table"), tags[: j + 1].count("tr")) for j in range(i + 1)]
        if t in ("td", "th", "p"):
            want[str(i)] = (sum(x == "tr" and n == tbl for x, n, _ in so_far), sum(x in ("td", "th") and n == tr for x, _, n in so_far)) if depth > 0 else (None, None)
    assert got == want


def test_find_strings_need_no_join(spark):
    texts = ["a b c d e f", "a b c d e g", "a b c d e", "x", "", "x", None, "one two three four five six"]
    df = spark.createDataFrame([("d", i, t, "kept") for i, t in enumerate(texts)] + [("e", 0, "x", "kept")], "doc string, idx int, text string, more string")
    out = LO.find_strings(df)
    assert "Join" not in plan(out) and out.columns == ["doc", "idx", "text", "more", "find_string"]
    got = {(r.doc, r.idx): (r.text, r.more, r.find_string) for r in out.collect()}
    assert [got["d", i][2] for i in range(8)] == ["a b c d e f", "a b c d e g", "a b c d e", "x", "", "x", None, "one two three four five"]
    assert got["e", 0] == ("x", "kept", "x") and len(got) == 9


def test_tables_meet_once(spark):
    cells = spark.createDataFrame([("a", 1, 1, 1, "h", "left"), ("a", 1, 1, 4, "hh", "right"), ("a", 1, 2, 2, "long text", "center"), ("a", 1, 3, 4, "z", "right"), ("b", 1, 2, 1, "no head", "right")],
                                  "doc string, tbl int, row int, col int, text string, align string")
    out = CO.render_tables(CO.shape_tables(cells))
    assert "Join" not in plan(out) and out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    want = "| h   |           |     | hh  |\n| --- | :-------: | --- | --- |\n|     | long text |     |     |\n|     |           |     | z   |"
    assert {tuple(r) for r in out.collect()} == {("a", 1, want), ("b", 1, "| no head |")}
