"""Rules joined to documents: findings, edits, report.

A finding is ``(doc, code, severity, rule_id, expected, actual, n, idx)``. Rule tables are broadcast
behind a size check; block tables are never joined to each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import codec
from plenum.functions import keys as K
from plenum.functions import values as V
from plenum.operators.roles import role_for_style_name
from plenum.skew import few, numbered, settle, small

# Fixed values
RANK = {"error": 0, "warn": 1, "info": 2}
STRUCTURE_WARN = ["structure.section_order", "structure.boilerplate_missing", "structure.section_missing"]
NEAR_MISS = 0.80
TRIGRAM_BITS, WORDING_BLOCK = 14, 2000  # slots of the trigram table, and wordings it holds at a time
WORDING_LOT = 4096  # wordings whose complement is taken at a time
FINDING = ["doc", "code", "severity", "rule_id", "expected", "actual", "n", "idx"]


def finding(df: DataFrame, code, severity, rule_id, expected=None, actual=None, n=None, idx=None) -> DataFrame:
    def c(x, t="string"):
        return x if isinstance(x, Column) else F.lit(x).cast(t)
    return df.select("doc", c(code).alias("code"), c(severity).alias("severity"), c(rule_id).alias("rule_id"), c(expected).cast("string").alias("expected"),
                     c(actual).cast("string").alias("actual"), c(1 if n is None else n, "bigint").cast("bigint").alias("n"), c(idx, "int").cast("int").alias("idx"))


def refusals(flags: DataFrame) -> DataFrame:
    """Documents that must not be restyled. ``flags``: doc, track_changes, protected, write_protected, alt_chunk, revisions."""
    reasons = F.array_compact(F.array(
        F.when(F.col("track_changes"), "change tracking is on"), F.when(F.col("protected"), "editing is restricted"),
        F.when(F.col("write_protected"), "writing needs a password"), F.when(F.col("alt_chunk"), "embedded foreign content is out of reach"),
        F.when(~F.col("track_changes") & F.col("revisions"), "unresolved revisions remain")))
    return finding(flags.withColumn("reason", F.explode(reasons)), "document.refused", "error", None, actual=F.col("reason"))


def without_refused(df: DataFrame, refused: DataFrame) -> DataFrame:
    """A refused document reports nothing else."""
    return df.join(refused.select("doc").distinct(), "doc", "left_anti")


def effective_severity(rules: DataFrame, muted: DataFrame, overrides: DataFrame) -> DataFrame:
    """Muted is off, an override wins, derived values are never enforced."""
    m = small(muted.select("pointer").distinct().withColumn("_m", F.lit(True)))
    o = small(overrides.select("pointer", F.col("severity").alias("_o")))
    return rules.join(m, "pointer", "left").join(o, "pointer", "left").withColumn("severity", F.when(F.col("_m"), "off").when(
        codec.is_derived(F.col("pointer")), "off").otherwise(F.coalesce("_o", "severity"))).drop("_m", "_o")


# The page rules and the finding each one raises.
PAGE_RULES = {
    "/page/primary/orientation": "page.orientation",
    "/page/primary/width": "page.size",
    "/page/primary/height": "page.size",
    "/page/primary/margins/top": "page.margins",
    "/page/primary/margins/bottom": "page.margins",
    "/page/primary/margins/left": "page.margins",
    "/page/primary/margins/right": "page.margins",
    "/page/primary/margins/header": "page.margins",
    "/page/primary/margins/footer": "page.margins",
    "/page/primary/columns": "page.columns",
}


def single_valued(rules: DataFrame, actual: DataFrame, codes: dict[str, str] | None = None) -> DataFrame:
    """One value per document against the rule; both bucketed. ``actual``: doc, pointer, bkey, value.

    Only pointers of the code table are checked; a rule without a code is no page rule.
    """
    codes = PAGE_RULES if codes is None else codes
    code = F.element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), F.col("pointer"))
    live = small(rules.where("severity <> 'off'").where(F.col("pointer").isin(list(codes))).select("pointer", "severity", F.col("bkey").alias("want"), F.col("value").alias("expected")))
    hits = actual.join(live, "pointer").where("bkey <> want")
    return finding(hits, code, F.col("severity"), F.col("pointer"), F.col("expected"), F.col("value"))


def role_styles(style_names: DataFrame, recorded: DataFrame) -> DataFrame:
    """Role -> style: a style the corpus used first (in name order), then the recorded mapping."""
    used = style_names.withColumn("role", role_for_style_name(F.col("style"))).where("role is not null").select("role", "style", F.lit(0).alias("p"))
    more = recorded.select("role", K.style_key(F.col("style")).alias("style"), F.lit(1).alias("p"))
    return used.unionByName(more).groupBy("role").agg(F.min(F.struct("p", "style"))["style"].alias("want_style"))


def wrong_styles(classified: DataFrame, roles: DataFrame) -> DataFrame:
    """P5: blocks whose style is not their role's."""
    live = classified.where("role not in ('empty', 'placeholder')")
    return live.join(small(roles), "role").where("not (style_name <=> want_style)")


def property_deviations(classified: DataFrame, roles: DataFrame, rules: DataFrame, props: dict[str, tuple[str, str]]) -> DataFrame:
    """Properties of rightly styled blocks that differ from the rule.

    ``props``: column -> (leaf path, tag). An unset property is no deviation where it is optional.
    """
    live = classified.where("role not in ('empty', 'placeholder')").join(small(roles), "role").where("style_name = want_style")
    entries = [F.struct(F.lit(leaf).alias("leaf"), F.lit(c).alias("prop"), F.lit(tag).alias("tag"),
                        (F.lit(None) if tag in ("s", "b") else F.col(c)).cast("double").alias("num"), (F.col(c) if tag in ("s", "b") else F.lit(None)).cast("string").alias("str"))
               for c, (leaf, tag) in props.items()]
    wide = live.select("doc", "idx", "role", F.concat(F.lit("/styles/paragraph/"), "style_name").alias("base"), F.inline(F.array(*entries)))
    pointer = wide.withColumn("pointer", F.concat("base", "leaf"))
    bkey = V.bkey(F.col("pointer"), F.col("tag"), F.col("num"), F.col("str"), F.lit(None).cast("string"))
    on = small(rules.where("severity <> 'off'").select("pointer", "severity", "status", F.col("bkey").alias("want"), F.col("value").alias("expected")))
    return (
        pointer.withColumn("bkey", bkey).join(on, "pointer").where("not (bkey <=> want) and not (bkey is null and status = 'optional_consistent')")
        .select("doc", "idx", "role", "prop", "pointer", "severity", "expected", "bkey", V.shown(F.col("num"), F.col("str")).alias("actual")))


def aggregate_deviations(wrong: DataFrame, deviations: DataFrame) -> DataFrame:
    """One finding per (code, role, property, wrong value) with a count and the first place."""
    first = F.min_by("needs_review", "idx")
    styled = wrong.groupBy("doc", "role", "style_name", "want_style").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("idx"), first.alias("review"))
    a = finding(styled, "style.wrong", F.when(F.col("review"), "warn").otherwise("error"), F.concat(F.lit("/styles/paragraph/"), "want_style"), F.col("want_style"), F.col("style_name"), F.col("n"), F.col("idx"))
    b = deviations.groupBy("doc", "role", "prop", "pointer", "severity", "expected", "bkey").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("idx"), F.min_by("actual", "idx").alias("actual"))
    return a.unionByName(finding(b, F.concat(F.lit("style."), "prop"), F.col("severity"), F.col("pointer"), F.col("expected"), F.col("actual"), F.col("n"), F.col("idx")))


def list_checks(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Marker and indents of list paragraphs, once per (kind, level, property).

    ``items``: doc, idx, kind, level, marker, indent_left, indent_hanging.
    """
    wide = items.select("doc", "idx", "kind", "level", F.expr(
        "inline(array(struct('marker' as prop, 's' as tag, cast(null as double) as num, marker as str), struct('indent_left' as prop, 'len' as tag, cast(indent_left as double) as num, cast(null as string) as str),"
        " struct('indent_hanging' as prop, 'len' as tag, cast(indent_hanging as double) as num, cast(null as string) as str)))")).where("num is not null or str is not null")
    pointer = wide.withColumn("pointer", F.format_string("/lists/%s/level%d/%s", "kind", "level", "prop"))
    bkey = V.bkey(F.col("pointer"), F.col("tag"), F.col("num"), F.col("str"), F.lit(None).cast("string"))
    on = small(rules.where("severity <> 'off'").select("pointer", "severity", F.col("bkey").alias("want"), F.col("value").alias("expected")))
    bad = pointer.withColumn("bkey", bkey).join(on, "pointer").where("bkey <> want").withColumn("actual", V.shown(F.col("num"), F.col("str")))
    once = bad.groupBy("doc", "pointer", "prop", "severity", "expected").agg(F.min("idx").alias("idx"), F.min_by("actual", "idx").alias("actual"))
    return finding(once, F.concat(F.lit("list."), "prop"), F.col("severity"), F.col("pointer"), F.col("expected"), F.col("actual"), idx=F.col("idx"))


def header_checks(docs: DataFrame, slots: DataFrame, rules: DataFrame) -> DataFrame:
    """header/footer missing or reading differently. ``slots``: doc, pointer, text."""
    live = rules.where("severity <> 'off' and pointer like '/hdrftr/%/text'").select("pointer", "severity", F.col("value").alias("expected"))
    # a profile has at most six slots: the rule list is one small array per document
    arr = few(live, "header rules").agg(F.collect_list(F.struct("pointer", "severity", "expected")).alias("rules"))
    want = docs.select("doc").distinct().withColumn("k", F.lit(1)).join(F.broadcast(arr.withColumn("k", F.lit(1))), "k").select("doc", F.inline("rules"))
    got = want.join(slots.select("doc", "pointer", F.col("text").alias("actual")), ["doc", "pointer"], "left")
    bad = got.where(F.col("actual").isNull() | (K.match_key(F.col("actual")) != K.match_key(F.col("expected"))))
    return finding(bad, F.when(F.col("actual").isNull(), "hdrftr.missing").otherwise("hdrftr.text"), F.col("severity"), F.col("pointer"), F.col("expected"), F.col("actual"))


def placeholder_values(blocks: DataFrame, frames: DataFrame, tag_prefix: str = "plenum.") -> DataFrame:
    """P10: a field's value, by control or by the wording around it; ``(doc, name, idx, value)``, first in order.

    ``frames``: name, prefix, suffix (match-normalised); ``blocks``: doc, idx, text, sdt_tag, is_placeholder.
    """
    ours = F.startswith(F.coalesce("sdt_tag", F.lit("")), F.lit(tag_prefix))
    tagged = blocks.where(ours).select(
        "doc", F.substring("sdt_tag", len(tag_prefix) + 1, 1000).alias("name"), "idx", F.lit(0).alias("src"), F.when(F.col("is_placeholder"), "").otherwise(F.trim("text")).alias("value"))
    # frames meet blocks through the first word of the literal that opens or closes the text
    f = frames.where("prefix <> '' or suffix <> ''").withColumn("head", F.col("prefix") != "").withColumn(
        "word", F.when(F.col("head"), F.substring("prefix", 1, 1)).otherwise(F.substring("suffix", -1, 1)))
    texted = blocks.withColumn("t", K.match_key(F.col("text"))).where("t <> ''")
    ends = texted.select("doc", "idx", "t", F.expr("inline(array(struct(true as head, substring(t, 1, 1) as word), struct(false as head, substring(t, -1, 1) as word)))"))
    hit = ends.join(small(f), ["head", "word"]).where("startswith(t, prefix) and endswith(t, suffix) and length(t) >= length(prefix) + length(suffix)")
    framed = hit.select("doc", "name", "idx", F.lit(1).alias("src"), F.expr("trim(substring(t, length(prefix) + 1, length(t) - length(prefix) - length(suffix)))").alias("value"))
    both = tagged.unionByName(framed)
    return both.groupBy("doc", "name").agg(
        F.min(F.struct((F.col("value") == "").alias("empty"), F.col("src"), F.col("idx"), F.col("value"))).alias("m")).select("doc", "name", F.col("m.idx").alias("idx"), F.col("m.value").alias("value"))


def placeholder_checks(docs: DataFrame, values: DataFrame, required: DataFrame, has_controls: DataFrame) -> DataFrame:
    """Fields that are empty (required or not), required fields that are missing, and one finding per
    document for those that cannot be checked.

    ``required``: name, framed, inferred; ``has_controls``: doc of documents carrying our controls.
    """
    arr = few(required, "required fields").agg(F.collect_list(F.struct("name", "framed", "inferred")).alias("r"))
    want = docs.select("doc").distinct().withColumn("k", F.lit(1)).join(F.broadcast(arr.withColumn("k", F.lit(1))), "k").select("doc", F.inline("r"))
    absent = want.join(values.select("doc", "name"), ["doc", "name"], "left_anti").join(
        has_controls.select("doc").distinct().withColumn("_c", F.lit(True)), "doc", "left")
    blind = F.col("_c").isNull() & ~F.col("framed") & F.col("inferred")
    rule = F.concat(F.lit("/placeholders/"), "name")
    empty = finding(values.where("value = ''"), "placeholder.empty", "warn", rule, idx=F.col("idx"))
    missing = finding(absent.where(~blind), "placeholder.missing", "error", rule)
    unseen = absent.where(blind).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    return empty.unionByName(missing).unionByName(finding(unseen, "placeholder.unverifiable", "info", "/placeholders", n=F.col("n")))


def section_checks(docs: DataFrame, headings: DataFrame, required: DataFrame) -> DataFrame:
    """Required sections missing, and present ones out of order. ``headings``: doc, idx, key; ``required``: pos, key."""
    arr = few(required, "required sections").agg(F.collect_list(F.struct("pos", "key")).alias("r"))
    want = docs.select("doc").distinct().withColumn("k", F.lit(1)).join(F.broadcast(arr.withColumn("k", F.lit(1))), "k").select("doc", F.inline("r"))
    first = headings.groupBy("doc", "key").agg(F.min("idx").alias("idx"))
    joined = want.join(first, ["doc", "key"], "left")
    missing = finding(joined.where("idx is null"), "structure.section_missing", structure_severity(F.lit("structure.section_missing")), "/skeleton", F.col("key"))
    # required sections are few: the order test is two arrays per document
    per = joined.where("idx is not null").groupBy("doc").agg(
        F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("w"), F.array_sort(F.collect_list(F.struct("idx", "key"))).alias("s")).select(
        "doc", F.array_join(F.transform("w", lambda x: x["key"]), " > ").alias("w"), F.array_join(F.transform("s", lambda x: x["key"]), " > ").alias("s"))
    order = finding(per.where("w <> s"), "structure.section_order", structure_severity(F.lit("structure.section_order")), "/skeleton/order", F.col("w"), F.col("s"))
    return missing.unionByName(order)


def boilerplate_checks(docs: DataFrame, blocks: DataFrame, wording: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Required wording found by the tolerant key and verified by the strict one.

    ``wording``: slot, text. ``near``: doc, slot, text of near misses (P14), reported as altered.
    """
    listed = numbered(wording.select("slot", F.col("text").alias("wanted"), K.match_key(F.col("text")).alias("mk"), K.exact_key(F.col("text")).alias("ek")), [], ["slot"], "number")
    listed = settle(listed)
    total = listed.count()
    hits = settle(blocks.withColumn("mk", K.match_key(F.col("text"))).where("mk <> ''").join(small(listed.drop("wanted")), "mk").groupBy("doc", "number").agg(
        F.bool_or(K.exact_key(F.col("text")) == F.col("ek")).alias("exact"), F.min(F.struct("idx", "text")).alias("m")))
    # what a document lacks is the complement of what it has, lot by lot of the list: no document meets every wording
    lot = lambda n: F.floor((n - 1) / F.lit(WORDING_LOT)).cast("bigint")
    has = hits.where("exact").groupBy("doc", lot(F.col("number")).alias("lot")).agg(F.collect_list("number").alias("has"))
    every = docs.select("doc").distinct().where(F.lit(total > 0)).withColumn("lot", F.explode(F.expr(f"sequence(0L, {max(total - 1, 0) // WORDING_LOT}L)")))
    first = F.col("lot") * WORDING_LOT + 1
    lacking = every.join(has, ["doc", "lot"], "left").select("doc", F.explode(F.array_except(
        F.sequence(first, F.least(first + WORDING_LOT - 1, F.lit(total).cast("bigint"))), F.coalesce("has", F.array().cast("array<bigint>")))).alias("number"))
    bad = lacking.join(small(listed.select("number", "slot", "wanted")), "number").join(hits.drop("exact"), ["doc", "number"], "left")
    if near is not None:
        bad = bad.join(near.select("doc", "slot", F.col("text").alias("near")), ["doc", "slot"], "left")
    else:
        bad = bad.withColumn("near", F.lit(None).cast("string"))
    code = F.when(F.col("m").isNull() & F.col("near").isNull(), "structure.boilerplate_missing").otherwise("structure.boilerplate_altered")
    return finding(bad.withColumn("code", code), F.col("code"), structure_severity(F.col("code")), F.concat(F.lit("/skeleton/slots/"), F.col("slot").cast("string")), F.col("wanted"), F.coalesce("m.text", "near"), idx=F.col("m.idx"))


def _reach(longer):
    """Most edits two texts may differ by: fewer than a fifth of the longer one."""
    return (longer - 1) // 5


def _slots(text: str) -> np.ndarray:
    """Slots of a text's trigrams in order; trigrams that share a slot only make a text look nearer."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    code = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA77) + points[2:]
    code = code * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - TRIGRAM_BITS)).astype(np.int64)


def _within(missing: np.ndarray, edits: int) -> bool:
    """Whether so many edits can spoil the trigrams at these places: one edit spoils three that follow each other at most."""
    free = -1
    for place in missing.tolist():
        if place >= free:
            edits -= 1
            if edits < 0:
                return False
            free = place + 3
    return True


class _Wordings:
    """Trigrams of a block of wordings, shortest first, as a table (slot, wording)."""

    def __init__(self, texts: list[str]):
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        self.numbers, self.length = np.array(order), np.array([len(texts[i]) for i in order])
        self.table, self.many = np.zeros((1 << TRIGRAM_BITS, len(texts)), np.uint8), np.zeros(len(texts), np.int64)
        self.places = [_slots(texts[i]) for i in order]
        for column, places in enumerate(self.places):
            slots = np.unique(places)
            self.table[slots, column], self.many[column] = 1, len(slots)
        self.held = np.zeros(1 << TRIGRAM_BITS, bool)

    def candidates(self, text: str) -> np.ndarray:
        """Wordings that an edit distance within reach does not rule out.

        The trigrams that one side lacks are first counted (an edit spoils three at most), then covered by edits in order.
        """
        n = len(text)
        low, high = np.searchsorted(self.length, [n - _reach(n), n + (n + 3) // 4], side="left")
        if low >= high:
            return self.numbers[:0]
        length = self.length[low:high]
        reach = _reach(np.maximum(length, n))
        places = _slots(text)
        slots = np.unique(places)
        shared = self.table[slots, low:high].sum(axis=0, dtype=np.uint16).astype(np.int64)
        near = (np.abs(length - n) <= reach) & (np.maximum(self.many[low:high], len(slots)) - shared <= 3 * reach)
        self.held[slots] = True
        found = [low + i for i in np.flatnonzero(near)
                 if _within(np.flatnonzero(~self.held[self.places[low + i]]), reach[i]) and _within(np.flatnonzero(self.table[places, low + i] == 0), reach[i])]
        self.held[slots] = False
        return self.numbers[found]


def _candidates(texts: DataFrame, wordings: list[tuple[int, str]]) -> DataFrame:
    """``(bk, number)``: which of a block of wordings each text may be near."""
    shared = texts.sparkSession.sparkContext.broadcast(wordings)

    def run(batches):
        block, numbers = _Wordings([w for _, w in shared.value]), np.array([i for i, _ in shared.value])
        for batch in batches:
            found = [(text, block.candidates(text)) for text in batch.column(0).to_pylist()]
            found = [(text, numbers[c]) for text, c in found if len(c)]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, c in found for _ in c], pa.string()), pa.array([int(i) for _, c in found for i in c], pa.int64())], ["bk", "number"])

    return texts.mapInArrow(run, "bk string, number long")


def near_misses(blocks: DataFrame, wording: DataFrame) -> DataFrame:
    """The closest block above .80 for each wording, ``1 - edit distance / longer length``.

    An exact bounded similarity search: distinct texts are counted against an inverted table of the wordings'
    trigrams, and the trigrams a pair does not share are covered by as few edits as they need, which rules out what
    cannot be within reach (and nothing else); only the rest is measured, by an edit distance that stops at the bound. Wordings are taken in blocks of ``WORDING_BLOCK``, however many there are.
    """
    keyed = wording.select("slot", K.match_key(F.col("text")).alias("wk")).where("wk <> ''")
    distinct = numbered(keyed.select("wk").distinct(), [], ["wk"], "number")
    distinct = settle(distinct.withColumn("block", F.floor((F.col("number") - 1) / F.lit(WORDING_BLOCK)).cast("int")))
    known = settle(blocks.withColumn("bk", K.match_key(F.col("text"))).where("bk <> ''").select("doc", "idx", "bk"))
    texts = settle(known.select("bk").distinct())
    found = None
    for block in range(int(distinct.agg(F.max("block")).first()[0] or 0) + 1):
        part = [(r.number, r.wk) for r in distinct.where(F.col("block") == block).select("number", "wk").toLocalIterator()]
        near = _candidates(texts, part)
        found = near if found is None else found.unionByName(near)
    longer = F.greatest(F.length("bk"), F.length("wk"))
    measured = found.join(small(distinct.drop("block")), "number").where("bk <> wk").withColumn("edits", F.expr("levenshtein(bk, wk, cast((greatest(length(bk), length(wk)) - 1) div 5 as int))")).where("edits >= 0")
    ratios = settle(measured.select("bk", "wk", F.round(1 - F.col("edits") / longer, 9).alias("ratio")).where(F.col("ratio") > NEAR_MISS))
    best = known.join(small(ratios), "bk").join(small(keyed), "wk").groupBy("doc", "slot").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "bk", "idx")).alias("m"))
    return best.select("doc", "slot", F.col("m.idx").alias("idx"), F.col("m.bk").alias("text"), (-F.col("m.r")).alias("ratio"))


def pattern_checks(values: DataFrame, patterns: DataFrame) -> DataFrame:
    """Filled values against their pattern; a broken pattern is one finding per document.

    ``patterns``: name, pattern. The few patterns are compiled once on the driver.
    """
    rows = patterns.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 field patterns: not a profile a person can own")
    jvm = values.sparkSession._jvm
    bad = []
    for r in rows:
        try:
            jvm.java.util.regex.Pattern.compile(r["pattern"])
        except Exception:  # the JVM says the pattern does not compile
            bad.append(r["name"])
    p = small(patterns.withColumn("ok", ~F.col("name").isin(bad) if bad else F.lit(True)))
    joined = values.where("value <> ''").join(p, "name")
    miss = joined.where("not ok or not if(ok, value rlike if(ok, pattern, '.'), true)")
    return finding(miss, F.when(F.col("ok"), "placeholder.pattern").otherwise("placeholder.bad_pattern"), "warn", F.concat(F.lit("/placeholders/"), "name"), F.col("pattern"), F.col("value"), idx=F.col("idx"))


def structure_severity(code: Column, overrides: dict[str, str] | None = None) -> Column:
    """Severity of structural rules by code, tunable by code."""
    out = F.when(code.isin(STRUCTURE_WARN), "warn").otherwise("error")
    for name, level in (overrides or {}).items():
        out = F.when(code == name, level).otherwise(out)
    return out


def edit_plan(classified: DataFrame, roles: DataFrame) -> DataFrame:
    """P20: what a reformat would do to each block, as an ordered list of operations."""
    live = classified.where("role not in ('empty', 'placeholder')").join(small(roles), "role")
    keep = F.concat(F.lit("keep sectPr,pageBreakBefore"), F.when(F.col("has_tabs") & F.contains("text", F.lit("\t")), ",tabs").otherwise(""))
    ops = F.array_compact(F.array(
        F.when(F.col("style_name") != F.col("want_style"), F.concat(F.lit("set-style "), "want_style")),
        F.when(F.col("has_ppr"), F.concat(F.lit("strip-para "), keep)), F.lit("strip-run keep span emphasis")))
    return live.select("doc", "idx", "role", "confidence", ops.alias("ops"), F.concat(F.lit("/styles/paragraph/"), "want_style").alias("rule_id"), "needs_review")


def report(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Counts, exit code (3 refused, 1 errors, 0 clean) per document."""
    c = lambda s: F.count(F.when(F.col("severity") == s, 1))
    per = findings.groupBy("doc").agg(c("error").alias("errors"), c("warn").alias("warnings"), c("info").alias("infos"), F.bool_or(F.col("code") == "document.refused").alias("refused"))
    zero = F.lit(0)
    return docs.select("doc").distinct().join(per, "doc", "left").select(
        "doc", F.coalesce("errors", zero).alias("errors"), F.coalesce("warnings", zero).alias("warnings"), F.coalesce("infos", zero).alias("infos"),
        F.when(F.coalesce("refused", F.lit(False)), 3).when(F.coalesce("errors", zero) > 0, 1).otherwise(0).alias("exit_code"))


def findings_json(findings: DataFrame) -> DataFrame:
    """One JSON report per document, findings worst first, then in document order."""
    rank = F.lit(9)
    for name, r in RANK.items():
        rank = F.when(F.col("severity") == name, r).otherwise(rank)
    entry = F.struct(rank.alias("rank"), F.coalesce("idx", F.lit(-1)).alias("at"), "code", "severity", "rule_id", "expected", "actual", "n")
    per = findings.groupBy("doc").agg(F.array_sort(F.collect_list(entry)).alias("f"), F.bool_or(F.col("code") == "document.refused").alias("refused"))
    exit_code = F.when(F.col("refused"), 3).when(F.exists("f", lambda x: x["severity"] == "error"), 1).otherwise(0)
    return per.select("doc", exit_code.alias("exit_code"), F.size("f").alias("n_findings"), F.to_json(F.struct(
        F.col("doc").alias("document"), exit_code.alias("exit_code"), F.transform("f", lambda x: F.struct(
            x["code"].alias("code"), x["severity"].alias("severity"), x["rule_id"].alias("rule"), x["expected"].alias("expected"), x["actual"].alias("actual"), x["n"].alias("n"))).alias("findings"))).alias("json"))
