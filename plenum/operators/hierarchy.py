"""Resolving inheritance and indirection: style chains, toggles, numbering, sections, themes.

Chains are followed level by level with equi-joins on (document, id); each level is written to the
checkpoint folder, so the walk is as deep as the data and its plan stays one join long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.skew import running, settle, small


def ancestry(styles: DataFrame) -> DataFrame:
    """``(doc, style_id, depth, ancestor, cyclic)``; depth 0 is the style itself.

    A walk ends at a repeated id, a missing parent or a change of type. ``styles``: doc, style_id,
    type, based_on.
    """
    parent = styles.select("doc", F.col("style_id").alias("_pid"), F.col("type").alias("_ptype"), F.col("based_on").alias("_pnext"))
    front = settle(styles.select("doc", "style_id", "type", F.lit(0).alias("depth"), F.col("style_id").alias("ancestor"),
                                 F.col("based_on").alias("next"), F.array("style_id").alias("seen"), F.lit(False).alias("cyclic")))
    out = front
    while True:
        step = front.where("next is not null and not cyclic").join(
            parent, (front.doc == parent.doc) & (F.col("next") == F.col("_pid")) & (F.col("type") == F.col("_ptype"))).select(
            front.doc, "style_id", "type", (F.col("depth") + 1).alias("depth"), F.col("_pid").alias("ancestor"), F.col("_pnext").alias("next"),
            F.concat("seen", F.array("_pid")).alias("seen"), F.array_contains("seen", F.col("_pid")).alias("cyclic"))
        front = settle(step)
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out.select("doc", "style_id", "depth", "ancestor", "cyclic")


def paths(chain: DataFrame) -> DataFrame:
    """Root-first path of each style."""
    kept = chain.where("not cyclic").groupBy("doc", "style_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "ancestor"))).alias("c"))
    return kept.select("doc", "style_id", F.transform("c", lambda x: x["ancestor"]).alias("path"))


def style_faults(styles: DataFrame, chain: DataFrame) -> DataFrame:
    """Styles in or below a cycle, and parents nobody defines."""
    loops = chain.where("cyclic").select("doc", "style_id", F.lit("cycle").alias("fault"), F.lit(None).cast("string").alias("target")).distinct()
    lost = styles.where("based_on is not null").join(styles.select("doc", F.col("style_id").alias("based_on")).distinct(), ["doc", "based_on"], "left_anti")
    return loops.unionByName(lost.select("doc", "style_id", F.lit("dangling").alias("fault"), F.col("based_on").alias("target")))


def fold(chain: DataFrame, props: DataFrame, singles: list[str], groups: list[list[str]]) -> DataFrame:
    """Nearest value along the chain; the members of a group move together.

    ``props``: doc, ancestor, property columns.
    """
    joined = chain.where("not cyclic").join(props, ["doc", "ancestor"])
    near = lambda v, ok: F.min_by(v, F.when(ok, F.col("depth")))
    aggs = [near(F.col(c), F.col(c).isNotNull()).alias(c) for c in singles]
    for i, g in enumerate(groups):
        some = F.coalesce(*[F.col(c).cast("string") for c in g]).isNotNull()
        aggs.append(near(F.struct(*g), some).alias(f"_g{i}"))
    out = joined.groupBy("doc", "style_id").agg(*aggs)
    return out.select("doc", "style_id", *singles, *[F.col(f"_g{i}")[c].alias(c) for i, g in enumerate(groups) for c in g])


def toggle(default: Column, levels: Column, direct: Column) -> Column:
    """C4: direct wins; table and paragraph levels set, character levels flip, an explicit off resets.

    ``levels``: array of struct(kind, value) from the outermost in.
    """
    start = F.coalesce(default, F.lit(False))
    state = F.aggregate(levels, start, lambda s, x: F.when(x["value"].isNull(), s).when(~x["value"], F.lit(False)).when(x["kind"] == "character", ~s).otherwise(F.lit(True)))
    return F.coalesce(direct, state)


def effective(defaults: DataFrame, para: DataFrame, char: DataFrame, direct: DataFrame, values: list[str], toggles: list[str]) -> DataFrame:
    """Defaults, then paragraph style, then character style, then direct formatting.

    ``direct``: doc, idx, para_style, char_style, columns; ``para``/``char``: doc, style_id, folded columns.
    """
    cols = values + toggles
    p = para.select("doc", F.col("style_id").alias("para_style"), *[F.col(c).alias(f"p_{c}") for c in cols])
    c = char.select("doc", F.col("style_id").alias("char_style"), *[F.col(x).alias(f"c_{x}") for x in cols])
    d = defaults.select("doc", *[F.col(x).alias(f"d_{x}") for x in cols])
    joined = direct.join(p, ["doc", "para_style"], "left").join(c, ["doc", "char_style"], "left").join(d, "doc", "left")
    level = lambda kind, x: F.struct(F.lit(kind).alias("kind"), F.col(x).alias("value"))
    return joined.select(
        "doc", "idx", *[F.coalesce(x, f"c_{x}", f"p_{x}", f"d_{x}").alias(x) for x in values],
        *[toggle(F.col(f"d_{x}"), F.array(level("paragraph", f"p_{x}"), level("character", f"c_{x}")), F.col(x)).alias(x) for x in toggles])


def default_style(styles: DataFrame) -> DataFrame:
    """The last paragraph style marked default, else the one named normal."""
    p = styles.where("type = 'paragraph'").groupBy("doc").agg(
        F.max(F.when(F.col("is_default"), F.struct("pos", "style_id"))).alias("d"), F.min(F.when(F.col("name_key") == "normal", F.struct("pos", "style_id"))).alias("n"))
    return p.select("doc", F.coalesce("d.style_id", "n.style_id").alias("default_id"))


def style_or_default(refs: DataFrame, styles: DataFrame) -> DataFrame:
    """A missing or dangling reference means the default style."""
    known = styles.select("doc", F.col("style_id").alias("ref"), F.lit(True).alias("_k")).distinct()
    return refs.join(known, ["doc", "ref"], "left").join(default_style(styles), "doc", "left").withColumn(
        "style_id", F.when(F.col("_k"), F.col("ref")).otherwise(F.col("default_id"))).drop("_k", "default_id")


def name_index(styles: DataFrame) -> DataFrame:
    """(type, name) -> style over names and aliases; a name beats an alias, then the first definition."""
    own = styles.select("doc", "type", F.col("name_key").alias("name"), "style_id", F.lit(0).alias("p"), "pos")
    alias = styles.select("doc", "type", F.explode("aliases").alias("name"), "style_id", F.lit(1).alias("p"), "pos")
    return own.unionByName(alias).groupBy("doc", "type", "name").agg(F.min(F.struct("p", "pos", "style_id"))["style_id"].alias("style_id"))


# Colour tokens of text and their theme slots.
COLOR_SLOTS = {
    "text1": "dk1", "background1": "lt1", "text2": "dk2", "background2": "lt2", "dark1": "dk1", "light1": "lt1", "dark2": "dk2",
    "light2": "lt2", "accent1": "accent1", "accent2": "accent2", "accent3": "accent3", "accent4": "accent4", "accent5": "accent5",
    "accent6": "accent6", "hyperlink": "hlink", "followedHyperlink": "folHlink",
}


def resolve_theme(rows: DataFrame, theme: DataFrame) -> DataFrame:
    """A theme face beats an explicit font; an explicit colour (not auto) beats the theme's.

    ``rows``: doc, font, font_token, color, color_token; ``theme``: doc, slot, value.
    """
    slot = F.lit(None).cast("string")
    for token, name in COLOR_SLOTS.items():
        slot = F.when(F.col("color_token") == token, name).otherwise(slot)
    t = theme.select("doc", F.col("slot"), "value")
    faces = t.select("doc", F.col("slot").alias("font_token"), F.col("value").alias("_face"))
    hues = t.select("doc", F.col("slot").alias("_slot"), F.col("value").alias("_hue"))
    work = rows.withColumn("_slot", F.when(F.col("color_token") == "none", None).otherwise(F.coalesce(slot, "color_token")))
    joined = work.join(faces, ["doc", "font_token"], "left").join(hues, ["doc", "_slot"], "left")
    explicit = F.when(F.lower("color") != "auto", F.upper("color"))
    return joined.withColumn("font_shown", F.coalesce("_face", "font")).withColumn(
        "color_shown", F.coalesce(explicit, F.when(F.col("color_token").isNotNull(), F.col("_hue")).otherwise(F.col("color")))).drop("_slot", "_face", "_hue")


def abstract_for(nums: DataFrame, abstracts: DataFrame, style_nums: DataFrame) -> DataFrame:
    """Num -> abstract, through style links; cycles and missing definitions give null.

    ``nums``: doc, num_id, abstract_id; ``abstracts``: doc, abstract_id, num_style_link; ``style_nums``:
    doc, style_id, num_id (the list a style carries).
    """
    a = abstracts.select("doc", F.col("abstract_id").alias("_aid"), F.col("num_style_link").alias("_link"))
    hop = style_nums.join(nums.select("doc", "num_id", F.col("abstract_id").alias("_next")), ["doc", "num_id"], "left").select(
        "doc", F.col("style_id").alias("_link"), F.col("num_id").alias("_hop"), "_next")
    front = settle(nums.select("doc", "num_id", F.col("num_id").alias("at"), F.col("abstract_id").alias("aid"), F.array().cast("array<bigint>").alias("seen")))
    done = None
    while True:
        looked = front.join(a, (front.doc == a.doc) & (F.col("aid") == F.col("_aid")), "left").drop(a.doc).join(hop, ["doc", "_link"], "left")
        looked = settle(looked.withColumn("lost", F.col("_aid").isNull() | F.array_contains("seen", F.col("aid"))).withColumn(
            "final", ~F.col("lost") & (F.col("_link").isNull() | F.col("_hop").isNull() | (F.col("_hop") == F.col("at")))))
        ended = looked.where("lost or final").select("doc", "num_id", F.when(F.col("final"), F.col("aid")).alias("abstract_id"))
        done = ended if done is None else done.unionByName(ended)
        front = looked.where("not lost and not final").select("doc", "num_id", F.col("_hop").alias("at"), F.col("_next").alias("aid"), F.concat("seen", F.array("aid")).alias("seen"))
        if front.isEmpty():
            return done


def list_levels(resolved: DataFrame, levels: DataFrame, overrides: DataFrame) -> DataFrame:
    """Levels of each list: an override replaces the level, a start override patches it.

    ``levels``: doc, abstract_id, ilvl, fmt, marker, start, indent, tentative; ``overrides``: doc, num_id,
    ilvl, o_fmt, o_marker, o_start, start_override.
    """
    base = resolved.join(levels, ["doc", "abstract_id"])
    both = base.drop("abstract_id").join(overrides, ["doc", "num_id", "ilvl"], "full")
    replaced = F.col("o_fmt").isNotNull()
    return both.where("fmt is not null or o_fmt is not null").select(
        "doc", "num_id", "ilvl", F.when(replaced, F.col("o_fmt")).otherwise(F.col("fmt")).alias("fmt"),
        F.when(replaced, F.col("o_marker")).otherwise(F.col("marker")).alias("marker"),
        F.coalesce("start_override", F.when(replaced, F.col("o_start")).otherwise(F.col("start"))).alias("start"),
        F.when(replaced, None).otherwise(F.col("indent")).alias("indent"), F.coalesce("tentative", F.lit(False)).alias("tentative"))


def list_reference(paras: DataFrame, levels: DataFrame, style_levels: DataFrame) -> DataFrame:
    """A paragraph's list: none, removed (0), by its style's level, or level 0 by default.

    ``paras``: doc, idx, num_id, ilvl, style_id; ``style_levels``: doc, style_id, s_num, s_ilvl.
    """
    j = paras.join(style_levels, ["doc", "style_id"], "left")
    by_style = F.col("s_num").isNotNull()
    pinned = by_style & (F.col("s_num") == F.col("num_id"))
    num = F.when(F.col("num_id").isNull(), F.col("s_num")).when(F.col("num_id") != 0, F.col("num_id"))
    lvl = F.when(F.col("num_id").isNull(), F.col("s_ilvl")).when(F.col("ilvl").isNull() & pinned, F.col("s_ilvl")).otherwise(F.coalesce("ilvl", F.lit(0)))
    source = F.when(F.col("num_id").isNull() & by_style, "level-pstyle").when(F.col("num_id") == 0, "removed").when(
        F.col("num_id").isNull(), "none").when(F.col("ilvl").isNull() & pinned, "level-pstyle").otherwise("style")
    known = levels.select("doc", F.col("num_id").alias("ref_num"), F.col("ilvl").alias("ref_ilvl"), F.lit(True).alias("resolved")).distinct()
    return j.select("doc", "idx", num.alias("ref_num"), F.when(num.isNotNull(), lvl).alias("ref_ilvl"), source.alias("source")).join(
        known, ["doc", "ref_num", "ref_ilvl"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def duplicate_ids(abstracts: DataFrame) -> DataFrame:
    """List definitions that share an identity and would be merged."""
    return abstracts.where("nsid is not null").groupBy("doc", F.lower("nsid").alias("nsid")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def signatures(levels: DataFrame, by: list[str]) -> DataFrame:
    """C11: document-independent identity of a list: its levels in order, padding left out.

    ``levels``: by..., ilvl, fmt, marker, start, indent, tentative. A list has nine levels at most.
    """
    entry = F.struct("ilvl", F.coalesce("fmt", F.lit("decimal")).alias("fmt"), F.coalesce("marker", F.lit("")).alias("marker"),
                     F.coalesce("start", F.lit(1)).alias("start"), F.coalesce(F.col("indent").cast("string"), F.lit("-")).alias("indent"))
    text = F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["ilvl"].cast("string"), x["fmt"], x["marker"], x["start"].cast("string"), x["indent"])), "|")
    shape = F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["ilvl"].cast("string"), x["fmt"], x["marker"])), "|")
    return levels.where("not tentative").groupBy(*by).agg(F.array_sort(F.collect_set(entry)).alias("l")).select(*by, F.sha2(text, 256).alias("signature"), F.sha2(shape, 256).alias("shape"))


def assign_sections(blocks: DataFrame, order: list[str], chunk: Column) -> DataFrame:
    """A break belongs to the section it ends, so a block's section is the breaks BEFORE it.

    ``blocks``: doc, order..., is_break. Runs in pieces of a document (see :func:`plenum.skew.running`).
    """
    hit = F.col("is_break").cast("bigint")
    out = running(blocks, ["doc"], order, chunk, sums={"_upto": hit})
    return out.withColumn("section", F.col("_upto") - hit).drop("_upto")


def inherit_slots(slots: DataFrame, order: list[str], chunk: Column) -> DataFrame:
    """Each header/footer slot falls back to the last section that declared it.

    ``slots``: doc, slot, sec (and further order columns), rid (null = not declared).
    """
    declared = F.when(F.col("rid").isNotNull(), F.struct(F.col("sec").alias("sec"), F.col("rid").alias("rid")))
    out = running(slots, ["doc", "slot"], order, chunk, lasts={"_src": declared})
    return out.withColumn("resolved_rid", F.col("_src.rid")).withColumn("defined_in", F.col("_src.sec")).drop("_src")


def active(slots: DataFrame) -> DataFrame:
    """First-page slots need the section's title page, even-page ones the document's setting.

    ``slots``: type, title_page, even_and_odd.
    """
    return slots.withColumn("active", (F.col("type") == "default") | ((F.col("type") == "first") & F.col("title_page")) | ((F.col("type") == "even") & F.col("even_and_odd")))


def slot_use(resolved: DataFrame, parts: DataFrame) -> DataFrame:
    """C14: parts no active slot shows. ``resolved``: doc, part, active; ``parts``: doc, part."""
    used = resolved.where("active and part is not null").select("doc", "part").distinct()
    return parts.join(used, ["doc", "part"], "left_anti")


def linked_to_previous(resolved: DataFrame) -> DataFrame:
    """C14: slots shown by inheritance."""
    return resolved.where("defined_in is not null and defined_in <> sec")


def geometry(sections: DataFrame) -> DataFrame:
    """Text width and height, column width, and the page signature. Twips throughout."""
    z = F.lit(0)
    width = F.col("width") - F.coalesce("left", z) - F.coalesce("right", z) - F.coalesce("gutter", z)
    height = F.col("height") - F.coalesce("top", z) - F.coalesce("bottom", z)
    one = F.col("columns") <= 1
    col = F.when(one, F.col("content_width")).when(~F.col("equal_width") & F.col("first_col").isNotNull(), F.col("first_col")).otherwise(
        F.floor((F.col("content_width") - (F.col("columns") - 1) * F.coalesce("space", z)) / F.col("columns")))
    sig = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("width", "height", "top", "right", "bottom", "left", "gutter", "columns")])
    return sections.withColumn("content_width", width).withColumn("content_height", height).withColumn("column_width", col.cast("bigint")).withColumn("signature", sig)


def section_problems(measured: DataFrame, blocks_after: DataFrame | None = None) -> DataFrame:
    """``(doc, sec, problem)``. ``measured`` from :func:`geometry` plus col_widths, even_and_odd, even_part, default_part."""
    checks = F.array_compact(F.array(
        F.when(F.col("width").isNull() | F.col("height").isNull(), "no page size"),
        F.when(F.col("content_width") <= 0, "margins leave no text width"),
        F.when((F.col("columns") > 1) & ~F.col("equal_width") & (F.col("col_widths") < F.col("columns")), "column widths missing"),
        F.when(F.col("even_and_odd") & F.col("even_part").isNull() & F.col("default_part").isNotNull(), "even-page header missing")))
    out = measured.select("doc", "sec", F.explode(checks).alias("problem"))
    if blocks_after is not None:
        out = out.unionByName(blocks_after.where("n > 0").select("doc", F.lit(None).cast("bigint").alias("sec"), F.lit("blocks follow the last section").alias("problem")))
    return out


def primary_section(blocks: DataFrame) -> DataFrame:
    """C17: the section with the most non-empty body paragraphs; the first on ties."""
    n = blocks.where("not is_empty").groupBy("doc", "section").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    return n.groupBy("doc").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("first"), F.col("section")))["section"].alias("section"))
