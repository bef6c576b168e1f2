"""Ballots of a shredded package: used styles, rendered looks, defaults, lists, headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions import keys as K

_OUT = ["corpus", "doc", "pointer", "tag", "num", "str", "rule"]


def _ballots(df: DataFrame, base, specs: list[tuple[str, str, str]]) -> DataFrame:
    entries = [F.struct(F.lit(leaf).alias("leaf"), F.lit(tag).alias("tag"), (F.lit(None) if tag in ("s", "b") else F.col(c)).cast("double").alias("num"),
                        (F.col(c) if tag in ("s", "b") else F.lit(None)).cast("string").alias("str")) for leaf, tag, c in specs]
    return df.select("corpus", "doc", base.alias("base"), F.inline(F.array(*entries))).where("num is not null or str is not null").select(
        "corpus", "doc", F.concat("base", "leaf").alias("pointer"), "tag", "num", "str", F.lit(None).cast("string").alias("rule"))


def style_ballots(styles: DataFrame, used: DataFrame, specs: list[tuple[str, str, str]]) -> DataFrame:
    """only styles a document uses vote, on resolved values; the parent votes as a name.

    ``styles``: corpus, doc, style_id, type, name_key, based_on, value columns; ``used``: doc, name_key.
    """
    parent = styles.select("doc", F.col("style_id").alias("based_on"), F.col("name_key").alias("parent_name"))
    live = styles.join(used.select("doc", "name_key").distinct(), ["doc", "name_key"], "left_semi").join(parent, ["doc", "based_on"], "left")
    return _ballots(live, F.concat(F.lit("/styles/"), "type", F.lit("/"), "name_key"), [*specs, ("/based_on", "s", "parent_name")])


def rendered_ballots(blocks: DataFrame, para: list[tuple[str, str, str]], run: list[tuple[str, str, str]]) -> DataFrame:
    """what paragraphs of each style really looked like; run looks from the first run only.

    ``blocks`` carry the look of their first run already (null if there is none).
    """
    live = blocks.where("kind = 'p' and not in_del")
    return _ballots(live, F.concat(F.lit("/rendered/"), "style_name"), [*para, *run])


def document_ballots(rows: DataFrame, prefix: str, specs: list[tuple[str, str, str]]) -> DataFrame:
    """defaults, theme and settings: one row per document."""
    return _ballots(rows, F.lit(prefix), specs)


def page_ballots(sections: DataFrame, blocks: DataFrame, specs: list[tuple[str, str, str]]) -> DataFrame:
    """page setup from the section that holds the bulk of the text, and the section count.

    Ties go to the first section, so a document without any text is described by its first one; a null document is one like any other.
    """
    n = blocks.where("not is_empty").groupBy(F.col("doc").alias("_doc"), F.col("section").alias("_sec")).agg(F.count(F.lit(1)).alias("_n"))
    held = sections.join(n, sections.doc.eqNullSafe(F.col("_doc")) & (sections.sec == F.col("_sec")), "left")
    order = F.struct((-F.coalesce("_n", F.lit(0))).alias("neg"), "sec", *dict.fromkeys(c for _, _, c in specs))
    main = held.groupBy("corpus", "doc").agg(F.min(order).alias("m"), F.count(F.lit(1)).alias("n_sections"))
    return _ballots(main.select("corpus", "doc", "m.*"), F.lit("/page/primary"), specs).unionByName(_ballots(main, F.lit("/page"), [("/section_count", "n", "n_sections")]))


def list_ballots(paras: DataFrame, levels: DataFrame) -> DataFrame:
    """the most used bullet and the most used numbered list of a document vote, by level.

    ``paras``: corpus, doc, num_id; ``levels``: doc, num_id, ilvl, fmt, marker, start, indent, tentative.
    """
    n = paras.where("num_id is not null and num_id <> 0").groupBy("corpus", "doc", "num_id").agg(F.count(F.lit(1)).alias("n"))
    zero = levels.where("ilvl = 0").select("doc", "num_id", F.when(F.col("fmt") == "bullet", "bullet").otherwise("numbered").alias("kind"))
    best = n.join(zero, ["doc", "num_id"]).groupBy("corpus", "doc", "kind").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("num_id")))["num_id"].alias("num_id"))
    rows = best.join(levels.where("not tentative"), ["doc", "num_id"])
    return _ballots(rows, F.format_string("/lists/%s/level%d", "kind", "ilvl"), [("/num_fmt", "s", "fmt"), ("/marker", "s", "marker"), ("/indent_left", "len", "indent"), ("/start", "n", "start")])


def header_ballots(slots: DataFrame, texts: DataFrame) -> DataFrame:
    """slots declared in their own section: their text, and that they are there.

    ``slots``: corpus, doc, kind, type, part, sec, defined_in; ``texts``: doc, part, idx, text.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    body = texts.where(K.collapse(F.col("text")) != "").groupBy("doc", "part").agg(joined.alias("t"))
    own = slots.where("part is not null and defined_in = sec").join(body, ["doc", "part"], "left").withColumn("shown", K.match_key(F.coalesce("t", F.lit("")))).withColumn("present", F.lit("true"))
    return _ballots(own, F.concat(F.lit("/hdrftr/"), "kind", F.lit("/"), "type"), [("/text", "s", "shown"), ("/present", "b", "present")])


# The style each role is written as.
ROLE_STYLES = {"title": "Title", "subtitle": "Subtitle", "body": "Body Text", "caption": "Caption", "quote": "Quote", "list_bullet": "List Bullet", "list_number": "List Number"}


def materialise_roles(voted: DataFrame, donor_styles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roles of the consensus as styles: new rows where the exemplar lacks one, and the mapping.

    ``voted``: pointer (``/roles/<role>/...``), value, in_donor; ``donor_styles``: name_key.
    """
    token = F.split("pointer", "/")
    live = voted.where("in_donor and startswith(pointer, '/roles/')").select(F.get(token, 2).alias("role"), F.concat_ws("/", F.slice(token, 4, 9)).alias("prop"), "value")
    name = F.when(F.col("role").rlike(r"^heading\d$"), F.concat(F.lit("Heading "), F.substring("role", 8, 1)))
    for role, style in ROLE_STYLES.items():
        name = F.when(F.col("role") == role, style).otherwise(name)
    styled = live.withColumn("style", name).where("style is not null").withColumn("name_key", K.style_key(F.col("style")))
    mapping = styled.select("role", "style", "name_key").distinct()
    new = styled.join(donor_styles.select("name_key").distinct(), "name_key", "left_anti").select("style", "prop", "value")
    return new, mapping.select("role", "style")
