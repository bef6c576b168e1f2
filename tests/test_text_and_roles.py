import unicodedata

import pytest
from pyspark.sql import functions as F

from plenum import skew
from plenum.functions import codec
from plenum.functions import keys as K
from plenum.operators import byexample as BX
from plenum.operators import content as CO
from plenum.operators import features as FE
from plenum.operators import fields as FI
from plenum.operators import fill as FL
from plenum.operators import lint as LI
from plenum.operators import redact as RD
from plenum.operators import roles as R
from plenum.operators import skeleton as SK
from plenum.operators import slots as SL
from plenum.operators import verify as VE


def col(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


TEXTS = ["plain text", "  two  blanks ", "ﬁne ﬂow", "Ａ１ full", "a​b﻿", "x y\tz\nq", "été", "Việt", "½ cup ™", "日本　語 ㎏", "soft­hyphen", "", " "]


def python_match(t):
    import re
    t = "".join(c for c in t if unicodedata.category(c) != "Cf")
    t = unicodedata.normalize("NFKC", t)
    for a, b in [("‐‑‒–—―−", "-"), ("‘’‚‛", "'"), ("“”„«»", '"')]:
        for c in a:
            t = t.replace(c, b)
    return re.sub(r"\s+", " ", t.replace("…", "...")).strip()


def test_match_key_is_compatibility_folding(spark):
    assert col(spark, TEXTS + ["“a” – b… ‘c’"], K.match_key) == [python_match(t) for t in TEXTS + ["“a” – b… ‘c’"]]


def test_exact_key_keeps_dashes(spark):
    assert col(spark, ["a – b", "é", "ﬁ"], K.exact_key) == ["a – b", "é", "ﬁ"]


def test_names(spark):
    assert col(spark, ["2.3 Thermal Soak", "IV. Scope", "A) One", "Intro"], K.heading_key) == ["thermal soak", "scope", "one", "intro"]
    assert col(spark, ["Report No.", "!!"], K.slug) == ["report_no", "field"]
    assert col(spark, ["01 -  Full name", "3. Date of birth"], K.question_slug) == ["full_name", "date_of_birth"]
    assert col(spark, ["LR-2024-0041"], K.mask) == ["AA-0000-0000"]
    assert col(spark, ["__", "9x:y"], K.bookmark) == ["ref", "b9x_y"]


@pytest.mark.parametrize("pointer, rule, raw, text", [
    ("/page/margins/left", None, 1440, "1in"), ("/x/space_after", None, 120, "6pt"), ("/x/size", None, 22, "11pt"), ("/x/size", None, 23, "11.5pt"),
    ("/x/line_spacing", "auto", 276, "1.15x"), ("/x/line_spacing", "exact", 240, "exact 12pt")])
def test_measures(spark, pointer, rule, raw, text):
    df = spark.createDataFrame([(pointer, rule, raw)], "p string, rule string, raw bigint").withColumn("t", codec.encode(F.col("p"), F.col("raw"), F.col("rule")))
    r = df.withColumn("d", codec.decode(F.col("p"), F.col("t"))).first()
    assert (r.t, r.d.raw, r.d.rule) == (text, raw, rule)


def page(spark, rows):
    """rows: (size, bold, text); everything styled normal."""
    df = spark.createDataFrame([("d", i, s, b, t) for i, (s, b, t) in enumerate(rows)], "doc string, idx int, size int, bold boolean, text string")
    fixed = {"part": "'m'", "kind": "'p'", "ctx_kind": "'body'", "style_name": "'normal'", "font": "'F'", "italic": "false", "caps": "false", "keep_next": "bold", "alignment": "cast(null as string)",
             "indent_left": "cast(null as int)", "outline_level": "cast(null as int)", "num_id": "cast(null as int)", "ilvl": "cast(null as int)", "is_bullet": "false", "seq_kind": "cast(null as string)", "has_drawing": "false", "sdt_tag": "cast(null as string)"}
    return FE.lexical(df.withColumns({k: F.expr(v) for k, v in fixed.items()}))


BODY = "This is a body paragraph with more than eight words in it."


def classify(spark, rows):
    return [r.role for r in R.classify(FE.context(page(spark, rows))).orderBy("idx").collect()]


def test_roles_from_looks(spark):
    rows = [(56, True, "The Title"), (32, True, "One"), (22, False, BODY), (26, True, "Two"), (22, False, BODY), (26, True, "Three"), (22, False, BODY)]
    assert classify(spark, rows) == ["title", "heading1", "body", "heading2", "body", "heading2", "body"]


def test_blank_is_empty(spark):
    assert classify(spark, [(22, False, BODY), (22, False, "  ")]) == ["body", "empty"]


def test_level_skip(spark):
    df = spark.createDataFrame([("d", i, l) for i, l in enumerate([1, 3, 4, 2, 5])], "doc string, idx int, level int").withColumns({"role": F.concat(F.lit("heading"), "level"), "confidence": F.lit(1.0)})
    assert [r.level for r in R.repair_level_skips(df).orderBy("idx").collect()] == [1, 2, 3, 2, 3]


def lab(spark):
    docs = {"a": ("LR-2024-0041", "L. Craig"), "b": ("LR-2025-0118", "R. Patel"), "c": ("LR-2026-0142", "K. Ito")}
    rows = []
    for d, (n, who) in docs.items():
        body = [("title", "Thermal Margin Analysis"), ("body", "Distribution Statement A: approved for public release."), ("body", f"Report No. {n}"), ("body", f"Prepared by {who}"),
                ("h1", "Introduction"), ("body", f"What {who} found is told here."), ("h1", "Methods"), ("body", f"How {n} was done is told here.")]
        rows += [("all", d, i, k, t) for i, (k, t) in enumerate(body)]
    df = spark.createDataFrame(rows, "corpus string, doc string, pos int, kind string, text string").withColumn("is_heading", F.col("kind") == "h1")
    df = SK.sections(df.withColumn("key", F.lower("text"))).withColumn("section", F.col("section").cast("string")).withColumns({"sdt_tag": F.lit(None).cast("string"), "instruction": F.lit(None).cast("string")})
    return df, spark.createDataFrame([("all", 3)], "corpus string, n_docs bigint")


def test_lab_report_corpus(spark):
    rows, totals = lab(spark)
    a = SK.two_tier(rows, totals)
    s = SL.ordered(SL.classify_columns(a, totals))
    got = {(r.kind, r.text, r.enforced) for r in s.collect()}
    assert ("boilerplate", "Distribution Statement A: approved for public release.", True) in got
    number = s.where("prefix = 'Report No. '").first()
    assert number.kind == "placeholder"
    values = SL.slot_values(a, s)
    types = {r.prefix: (r.value_type, r.pattern) for r in SL.infer_types(values, SL.BY).join(s.select(*SL.BY, "prefix"), SL.BY).collect()}
    assert types["Report No. "] == ("identifier", "^[A-Z]{2}\\-\\d{4}\\-\\d{4}$")
    assert types["Prepared by "][0] == "person"
    assert [r.modal_text for r in SL.required_sections(s).orderBy("index").collect()] == ["Introduction", "Methods"]


def test_split_frames(spark):
    df = spark.createDataFrame([("g", "a", "No. 1 of X"), ("g", "b", "No. 22 of X"), ("h", "a", "same"), ("h", "b", "same"), ("i", "a", "one"), ("j", "a", "x y"), ("j", "b", "x")], "g string, doc string, text string")
    got = {(r.g, r.doc): (r.prefix, r.middle, r.suffix, r.is_field) for r in SK.split_variable_part(df, ["g"]).collect()}
    assert got == {("g", "a"): ("No. ", "1", " of X", True), ("g", "b"): ("No. ", "22", " of X", True), ("j", "a"): ("x ", "y", "", True), ("j", "b"): ("x ", "", "", True)}


def test_long_section_is_free(spark):
    rows = spark.createDataFrame([("all", "", "d", i, "body", str(i), False) for i in range(5)], "corpus string, section string, doc string, pos int, kind string, key string, is_heading boolean")
    totals = spark.createDataFrame([("all", 1)], "corpus string, n_docs bigint")
    free = SK.align(rows, totals, max_gap=4)
    assert free.count() == 5 and free.where("col is null").count() == 5 and SK.align(rows, totals, max_gap=5).where("col is not null").count() == 5
    assert SK.column_stats(free, totals).count() == 0
    assert [(r.widest, "free content" in r.message) for r in SK.skeleton_warnings(rows, 4).collect()] == [(5, True)]


def _section(spark, texts):
    rows = [("c", "s", d, i, "body", t.lower(), False) for d, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "corpus string, section string, doc string, pos int, kind string, key string, is_heading boolean")
    return df, spark.createDataFrame([("c", len(texts))], "corpus string, n_docs bigint")


def test_one_wide_document_leaves_no_row_out(spark):
    df, totals = _section(spark, {"a": [f"line {i}" for i in range(301)], "b": ["line 0", "line 1"], "c": ["line 1"]})
    other = df.where("doc <> 'a'").withColumn("section", F.lit("t"))
    out = SK.align(df.unionByName(other), totals)
    assert out.count() == 307 and out.where("col is null").count() == 304 and out.where("section = 't' and col is not null").count() == 3


def test_swapped_blocks_do_not_share_columns_across(spark):
    straight = ["Start", "One", "Two", "Three", "End"]
    df, totals = _section(spark, {"a": straight, "b": straight, "c": straight, "d": ["Start", "Three", "One", "Two", "End"]})
    col = {(r.doc, r.key): r.col for r in SK.align(df, totals).collect()}
    assert all(col["a", k] == col["d", k] for k in ("start", "one", "two", "end"))
    assert col["a", "three"] == col["c", "three"] != col["d", "three"]
    order = [col["a", k.lower()] for k in straight]
    assert len(set(order)) == 5 and col["d", "three"] not in order


def test_columns_of_a_document_never_cross(spark):
    import random
    rng = random.Random(6)
    blocks = [f"b{i}" for i in range(12)]
    texts = {}
    for d in range(20):
        line = [b for b in blocks if rng.random() < .9]
        for _ in range(rng.randint(0, 3)):
            i, j = rng.randrange(len(line)), rng.randrange(len(line))
            line[i], line[j] = line[j], line[i]
        texts[f"d{d}"] = line
    df, totals = _section(spark, texts)
    marked = SK._anchors(df, totals)
    order = {r.anchor: r.ord for r in SK.column_order(marked).collect()}
    by = {}
    for r in SK.align(df, totals).orderBy("doc", "pos").collect():
        if r.col in order:
            by.setdefault(r.doc, []).append(order[r.col])
    assert len(by) == 20 and all(x == sorted(set(x)) for x in by.values())
    for d, line in texts.items():  # and no longer run in order exists
        ranks = [order.get(f"k|body|{b}|1") for b in line]
        run = []
        for i, x in enumerate(ranks):
            run.append(0 if x is None else 1 + max([run[j] for j in range(i) if ranks[j] is not None and ranks[j] < x], default=0))
        assert len(by[d]) == max(run)


def test_marker_grammar(spark):
    df = spark.createDataFrame([("d", 0, "{{full_name*|Full name}} {{choice: status | Draft, Final}} {{check: agreed}} ###Address### «Fornavn» [Job Title] {{items.qty}} {{a b c d e f g}}")], "doc string, idx int, text string")
    got = {(r.slug, r.kind, r.required, r.label, tuple(r.choices)) for r in FI.markers(df).collect()}
    assert got == {("full_name", "text", True, "Full name", ()), ("status", "choice", False, "", ("Draft", "Final")), ("agreed", "checkbox", False, "", ()),
                   ("address", "text", False, "", ()), ("fornavn", "text", False, "", ()), ("job_title", "text", False, "", ())}


def test_a_value_that_looks_like_a_marker_is_not_read_again(spark):
    t = FL.templates(spark.createDataFrame([(1, 0, "{{a}} {{b}}")], "template_id int, idx int, text string"))
    r = spark.createDataFrame([("r", 1, {"a": "{{b}}", "b": "x"})], "record string, template_id int, answers map<string,string>")
    assert FL.fill(t, r).first().text == "{{b}} x"


def test_template_by_example(spark):
    rows = [("f", "a", 0, "Name: K. Ito"), ("f", "b", 0, "Name: J. Doe"), ("f", "a", 1, "Salary: 90000"), ("f", "b", 1, "Salary: 72000"), ("f", "a", 2, "Same"), ("f", "b", 2, "Same")]
    c = spark.createDataFrame(rows, "form string, doc string, idx int, text string")
    base = spark.createDataFrame([("f", "a")], "form string, doc string")
    got = [(r.name, r.kind) for r in BX.name_spans(BX.varying_spans(c, base)).orderBy("idx").collect()]
    assert got == [("name", "text"), ("salary", "number")]


def test_lines_only_one_document_has_are_not_vouched_for(spark):
    rows = [("c", f"d{i}", k) for i in range(4) for k in ("House", f"own {i}")]
    lines = spark.createDataFrame(rows, "corpus string, doc string, key string")
    sizes = spark.createDataFrame([("c", 4)], "corpus string, n_docs bigint")
    assert {r.key for r in RD.filter_lines(lines, sizes).where("kept").collect()} == {"House"}


def test_small_corpus_keeps_its_body(spark):
    b = spark.createDataFrame([("c", "d", 0, "text", False, "body")], "corpus string, doc string, idx int, text string, is_empty boolean, ctx_kind string")
    keep = b.where("false").select("corpus", "doc", "idx")
    for n, cleared in ((2, False), (3, True)):
        assert RD.clear_body(b, keep, spark.createDataFrame([("c", n)], "corpus string, n_docs bigint")).first().cleared is cleared


def test_near_miss_is_reported_as_altered(spark):
    blocks = spark.createDataFrame([("d", 0, "Distribution Statement A: approved for pubic release.")], "doc string, idx int, text string")
    w = spark.createDataFrame([(1, "Distribution Statement A: approved for public release.")], "slot int, text string")
    near = LI.near_misses(blocks, w)
    assert near.first().ratio > .95
    f = LI.boilerplate_checks(blocks, blocks, w, near).first()
    assert (f.code, f.severity) == ("structure.boilerplate_altered", "error")


def test_gate_writes_nothing_on_a_fault(spark, tmp_path):
    df = spark.range(1)
    with pytest.raises(VE.Refused):
        VE.guarded_write(df, spark.createDataFrame([("x",)], "fault string"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_stripping_twice_changes_nothing(spark):
    from plenum.operators import apply as A
    runs = spark.createDataFrame([("d", 0, 0, ["b", "sz"]), ("d", 0, 1, ["sz", "vertAlign"])], "doc string, idx int, run_no int, props array<string>")
    once = A.strip_runs(runs).select("doc", "idx", "run_no", F.col("kept").alias("props"))
    twice = A.strip_runs(once).select("doc", "idx", "run_no", F.col("kept").alias("props"))
    assert VE.same_rows(once, twice).count() == 0


def test_hot_key_numbering_and_running(spark):
    df = spark.range(1000).selectExpr("'hot' as k", "id", "id % 7 = 0 as hit")
    assert skew.numbered(df.repartition(7), ["k"], ["id"], "n").where("n <> id + 1").count() == 0
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, id long")
    assert sorted((r.k or "", r.id, r.n) for r in skew.numbered(nulls, ["k"], ["id"], "n").collect()) == [("", 1, 1), ("", 2, 2), ("a", 1, 1)]
    run = skew.running(df, ["k"], ["id"], F.floor(F.col("id") / 64), sums={"s": F.col("hit").cast("int")}, lasts={"l": F.when(F.col("hit"), F.col("id"))})
    assert run.where("s <> floor(id / 7) + 1 or l <> floor(id / 7) * 7").count() == 0


def test_text_moved_around_a_repeated_line_is_reordered(spark):
    def snap(lines):
        return spark.createDataFrame([("d", False, i, k) for i, k in enumerate(lines)], "doc string, chrome boolean, seq int, key string")
    faults = VE.text_faults(snap("ABACA"), snap("ACABA")).collect()
    assert [(r.fault, r.n) for r in faults] == [("reordered", 5)]
    assert VE.text_faults(snap("ABACA"), snap("ABACA")).count() == 0
    assert sorted((r.fault, r.n) for r in VE.text_faults(snap("AAB"), snap("BCC")).collect()) == [("invented", 2), ("lost", 2)]


def test_many_headings_keep_the_heading_tier(spark):
    rows = [("c", d, i, "h1", f"part {i}", True) for d in ("a", "b") for i in range(350 if d == "a" else 5)]
    df = spark.createDataFrame(rows, "corpus string, doc string, pos int, kind string, key string, is_heading boolean").withColumn("text", F.col("key"))
    out = SK.two_tier(SK.sections(df).withColumn("section", F.col("section").cast("string")), spark.createDataFrame([("c", 2)], "corpus string, n_docs bigint"))
    assert out.where("is_heading").count() == 355


def test_a_block_some_documents_lack_does_not_split_a_field(spark):
    texts = {"a": ["Start", "extra", "value one", "End"], "b": ["Start", "extra", "value two", "End"], "c": ["Start", "value three", "End"]}
    rows = [("c", "s", d, i, "body", t.lower(), False) for d, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "corpus string, section string, doc string, pos int, kind string, key string, is_heading boolean")
    out = SK.align(df, spark.createDataFrame([("c", 3)], "corpus string, n_docs bigint"))
    assert len({r.col for r in out.where("key like 'value%'").collect()}) == 1


def test_placeholders_empty_missing_and_unverifiable(spark):
    docs = spark.createDataFrame([("d",)], "doc string")
    values = spark.createDataFrame([("d", "note", 4, "")], "doc string, name string, idx int, value string")
    need = spark.createDataFrame([("x", False, True), ("y", False, True), ("z", True, True)], "name string, framed boolean, inferred boolean")
    got = sorted((r.code, r.rule_id, r.n) for r in LI.placeholder_checks(docs, values, need, docs.where("false")).collect())
    assert got == [("placeholder.empty", "/placeholders/note", 1), ("placeholder.missing", "/placeholders/z", 1), ("placeholder.unverifiable", "/placeholders", 2)]


def test_a_block_without_a_style_is_wrong_too(spark):
    c = spark.createDataFrame([("d", 0, "body", None), ("d", 1, "body", "normal")], "doc string, idx int, role string, style_name string")
    roles = spark.createDataFrame([("body", "normal")], "role string, want_style string")
    assert [r.idx for r in LI.wrong_styles(c, roles).collect()] == [0]


def test_deep_lists_have_parents(spark):
    b = spark.createDataFrame([("d", i, True, False, i) for i in range(14)] + [("d", 14, True, False, 3)], "doc string, idx int, is_item boolean, ordered boolean, level int")
    got = {r.idx: (r.depth, r.parent) for r in CO.nest_lists(b).collect()}
    assert got[13] == (13, 12) and got[14] == (3, 2) and got[0] == (0, None)


def test_pictures_are_not_empty_and_sizes_have_a_default(spark):
    b = spark.createDataFrame([("d", 0, "", True), ("d", 1, " ", False)], "doc string, idx int, text string, has_drawing boolean")
    assert [r.is_empty for r in FE.lexical(b).orderBy("idx").collect()] == [False, True]


def test_refill_of_a_template_that_starts_elsewhere(spark):
    t = FL.templates(spark.createDataFrame([(1, 3, "{{a}}!")], "template_id int, idx int, text string"))
    r = spark.createDataFrame([("r", 1, {"a": "x"})], "record string, template_id int, answers map<string,string>")
    saved = FL.session(FL.fill(t, r))
    changed = spark.createDataFrame([("r", {"a": "y"})], "record string, changes map<string,string>")
    assert [x.text for x in FL.refill(saved, t, changed).collect()] == ["y!"]


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    df = spark.createDataFrame([("x" * 500,)] * 20, "t string")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(skew.small(df)) and not hinted(skew.small(df, max_rows=5)) and not hinted(skew.small(df, max_bytes=100))


def test_written_intermediates_can_be_released(spark):
    kept = skew.settle(spark.range(3)).inputFiles()[0].removeprefix("file:")
    assert skew.release(spark) >= 1
    import os
    assert not os.path.exists(kept)


def test_near_misses_match_plain_edit_distance(spark, monkeypatch):
    import random

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)
    monkeypatch.setattr(LI, "WORDING_BLOCK", 4)  # several blocks
    made = ["".join(rng.choices("abé ß😀", k=n)).strip() for n in (1, 2, 3, 5, 9, 20, 21, 40, 60, 90)]

    def spoil(t):
        out = list(t)
        for _ in range(rng.randint(0, len(t) // 4 + 1)):
            i = rng.randrange(len(out) + 1)
            out[i:i + rng.randint(0, 1)] = rng.choices("abxyé", k=rng.randint(0, 1))
        return "".join(out)

    texts = [t for t in (spoil(w) for w in made for _ in range(12)) if t] + ["", "unlike anything"]
    blocks = spark.createDataFrame([(f"d{i % 7}", i, t) for i, t in enumerate(texts)], "doc string, idx int, text string")
    wording = spark.createDataFrame(list(enumerate(made)), "slot int, text string")
    key = lambda t: " ".join(t.split())
    want = {}
    for i, t in enumerate(texts):
        for slot, w in enumerate(made):
            a, b = key(t), key(w)
            if a and b and a != b and (r := round(1 - edits(a, b) / max(len(a), len(b)), 9)) > .8:
                want[f"d{i % 7}", slot] = max(want.get((f"d{i % 7}", slot), 0), r)
    got = {(r.doc, r.slot): r.ratio for r in LI.near_misses(blocks, wording).collect()}
    assert got == want and len(got) > 10
    assert LI.near_misses(blocks.limit(0), wording).count() == 0 and LI.near_misses(blocks, wording.limit(0)).count() == 0


def test_near_misses_are_not_measured_where_edits_lie_apart():
    """Eleven insertions spoil two trigrams each: ten edits could spoil as many, but not at these places."""
    from plenum.operators.lint import _Wordings
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQR"
    text = "".join(letters[i:i + 4] + "0123456789#"[i // 4] for i in range(0, 44, 4))
    assert list(_Wordings([letters]).candidates(text)) == []
    assert list(_Wordings([letters]).candidates(text.replace("#", ""))) == [0]


def test_direct_runs_are_counted_by_their_markers(spark):
    """Bold and italic are emphasis; a size, colour or underline of its own is direct; deleted blocks are silent."""
    from plenum.operators import features as FE
    block = "doc string, idx int, kind string, in_del boolean, style_name string, num_id int, ctx_kind string, part string, in_textbox boolean, in_sdt boolean, in_ins boolean"
    blocks = spark.createDataFrame([("d", 0, "p", False, "a", None, "body", "m", False, False, False), ("d", 1, "p", True, "b", None, "body", "m", False, False, False),
                                    ("d", 2, "tbl", False, "c", None, "body", "m", False, False, False), ("e", 0, "p", False, "a", 1, "header", "h", False, True, False)], block)
    runs = spark.createDataFrame([("d", 0, ["b", "i"]), ("d", 0, ["b", "sz"]), ("d", 0, []), ("d", 0, ["color", "u"]), ("d", 1, ["sz"]), ("d", 2, ["sz"])], "doc string, idx int, markers array<string>")
    got = {r.doc: (r.blocks, r.paragraphs, r.runs, r.direct_runs, r.direct_density, r.disqualified) for r in FE.doc_meta(blocks, runs).collect()}
    assert got == {"d": (3, 1, 4, 2, .5, True), "e": (1, 1, 0, 0, 0.0, False)}


def test_boilerplate_found_altered_and_missing(spark, monkeypatch):
    monkeypatch.setattr(LI, "WORDING_LOT", 2)  # the list is taken in several lots
    blocks = spark.createDataFrame([("a", 0, "Keep dry."), ("a", 1, "Handle with  care."), ("b", 0, "Keep dry"), ("b", 1, "Handle with care"), ("c", 0, "else")], "doc string, idx int, text string")
    wording = spark.createDataFrame([(10, "Keep dry."), (20, "Handle with care."), (30, "This side up."), (40, "Fragile."), (50, "Keep dry.")], "slot int, text string")
    docs = blocks.select("doc").unionByName(spark.createDataFrame([("empty",)], "doc string"))
    got = {}
    for r in LI.boilerplate_checks(docs, blocks, wording, LI.near_misses(blocks, wording)).collect():
        got.setdefault(r.doc, {})[int(r.rule_id.split("/")[-1])] = r.code.split("_")[-1]
    assert got["a"] == {30: "missing", 40: "missing"}
    assert got["b"] == {10: "altered", 50: "altered", 20: "altered", 30: "missing", 40: "missing"}
    assert set(got["c"].values()) == set(got["empty"].values()) == {"missing"} and len(got["c"]) == len(got["empty"]) == 5
    assert LI.boilerplate_checks(docs, blocks, wording.limit(0)).count() == 0


def test_inlines_are_merged_in_rows_and_in_lists_alike(spark):
    from plenum.operators import content as CO
    rows = [("a", 0, 2, "text", None, "b"), ("a", 0, 1, "text", None, "a"), ("a", 0, 3, "other", None, "k"), ("a", 0, 4, "other", None, "k"), ("a", 0, 5, "emphasis", True, "x"),
            ("a", 0, 6, "emphasis", False, "y"), ("a", 0, 7, "emphasis", False, None), ("a", 1, 1, "text", None, ""), ("b", 0, 1, "text", True, "t"), ("b", 0, 2, "text", None, "u")]
    inlines = spark.createDataFrame(rows, "doc string, idx int, seq int, kind string, strong boolean, value string")
    want = [("a", 0, "emphasis", False, "y"), ("a", 0, "emphasis", True, "x"), ("a", 0, "other", None, "k"), ("a", 0, "other", None, "k"), ("a", 0, "text", None, "ab"),
            ("b", 0, "text", None, "u"), ("b", 0, "text", True, "t")]
    assert sorted((tuple(r) for r in CO.merge_inlines(inlines).collect()), key=str) == sorted(want, key=str)
    lists = spark.createDataFrame([("a", 0, [r[2:] for r in rows if r[:2] == ("a", 0)]), ("c", 0, []), ("d", 0, None)], "doc string, idx int, inlines array<struct<seq int, kind string, strong boolean, value string>>")
    got = CO.merge_inline_lists(lists)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((w for w in want if w[0] == "a"), key=str)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_extremes_are_found_before_anything_is_sorted(spark):
    rows = [("f", "1", 0, "Name: Ann"), ("f", "2", 0, "Name: Bob Zed"), ("f", "3", 0, None), ("f", "1", 1, "Same."), ("f", "2", 1, "Same."), ("f", "3", 1, "\U0001f600 x"), ("f", "2", 2, "\uffee x"), ("f", "1", 2, None)]
    copies = spark.createDataFrame(rows, "form string, doc string, idx int, text string").repartition(3)
    out = BX.varying_spans(copies, spark.createDataFrame([("f", "1")], "form string, doc string"))
    assert [tuple(r) for r in out.orderBy("idx").collect()] == [("f", 0, "Name: Ann", 6, 9, "Name: "), ("f", 1, "Same.", 0, 5, "")]
    # whole copies are not sorted: each batch is reduced to its groups' ends first
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_alignment_deals_documents_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 1)
    assert skew.pieces(spark, 4_600_000, 500_000) == 10 and skew.pieces(spark, 3) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.createDataFrame([("c", "", d, p, "body", k, False) for d in ("a", "b", "c") for p, k in enumerate(("x", "y", "z") if d != "c" else ("y", "x", "z"))],
                                 "corpus string, section string, doc string, pos int, kind string, key string, is_heading boolean")
    out = SK.align(rows, spark.createDataFrame([("c", 3)], "corpus string, n_docs bigint"), parts=3)
    col = {(r.doc, r.key): r.col for r in out.collect()}
    assert col["a", "x"] == col["b", "x"] == "k|body|x|1" and len({col["c", k] for k in "xyz"}) == 3 and sum(col["c", k].startswith("k|") for k in "xyz") == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
