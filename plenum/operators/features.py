"""Measuring a block and the document it lives in.

Block windows are partitioned by document; the blocks of one document come from one source row
(one page, one text, one file), so a partition is never larger than that row. All of them share the
(doc) partitioning, so a chain of them shuffles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import keys as K

# Fixed values
TERMINAL = "[.!?:;…]$"
CAPTION_LEAD = r"(?i)^\s*(figure|fig\.?|table|exhibit|chart|plate)\s*[\d\w]"
PROSE_WORDS = 8
IMPLICIT_HALF_POINTS = 20


def _doc():
    return Window.partitionBy("doc").orderBy("idx")


def _whole():
    return Window.partitionBy("doc")


def words_of(text: Column) -> Column:
    flat = K.collapse(text)
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))


def lexical(blocks: DataFrame) -> DataFrame:
    """Word count, closing punctuation, capitals, caption opening, emptiness."""
    letters = F.regexp_replace("text", r"[^\p{L}]", "")
    blank = K.collapse(F.col("text")) == ""
    if "has_drawing" in blocks.columns:  # a paragraph that holds only a picture has no text and is not empty
        blank = blank & ~F.coalesce("has_drawing", F.lit(False))
    return (
        blocks.withColumn("words", words_of(F.col("text")))
        .withColumn("ends_with_terminal", K.collapse(F.col("text")).rlike(TERMINAL))
        .withColumn("all_caps", letters.rlike(r"^\p{Lu}+$"))
        .withColumn("caption_lead", F.col("text").rlike(CAPTION_LEAD))
        .withColumn("is_empty", blank)
    )


def shapes_of(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """The first two distinct shapes among the five smallest distinct values of a group.

    ``row_number() <= 5`` lets Spark keep five rows per group before the shuffle.
    """
    order = Window.partitionBy(*by).orderBy(value)
    first = values.select(*by, value).where(F.col(value).isNotNull()).distinct().withColumn(
        "_rn", F.row_number().over(order)).where("_rn <= 5")
    shaped = (
        first.withColumn("shape", K.mask(F.col(value))).where("shape <> ''")
        .groupBy(*by, "shape").agg(F.min("_rn").alias("at")))
    return shaped.withColumn(
        "place", F.row_number().over(Window.partitionBy(*by).orderBy("at"))).where("place <= 2")


def body_ordinal(blocks: DataFrame) -> DataFrame:
    """D3: position among the non-empty body paragraphs."""
    counts = ~F.col("is_empty") & (F.col("ctx_kind") == "body")
    so_far = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("body_ordinal", F.when(counts, F.count(F.when(counts, 1)).over(so_far)))


def sequence_kind(instructions: DataFrame) -> DataFrame:
    """Figure/Table of a SEQ instruction; ``(doc, idx, seq_no, instruction)`` to one row a block."""
    kind = F.initcap(F.nullif(F.regexp_extract("instruction", r"(?i)\bSEQ\s+(\w+)", 1), F.lit("")))
    hits = instructions.withColumn("seq_kind", kind).where("seq_kind is not null")
    return hits.groupBy("doc", "idx").agg(F.min_by("seq_kind", "seq_no").alias("seq_kind"))


def adjacency(blocks: DataFrame) -> DataFrame:
    """Is the nearest block that is not a blank spacer, on either side in the same part, a graphic?"""
    near = Window.partitionBy("doc", "part").orderBy("idx")
    spacer = (F.col("kind") == "p") & F.col("is_empty") & ~F.col("has_drawing")
    graphic = F.when(~spacer, F.col("has_drawing") | (F.col("kind") == "tbl"))
    back = near.rowsBetween(Window.unboundedPreceding, -1)
    ahead = near.rowsBetween(1, Window.unboundedFollowing)
    return (
        blocks.withColumn("follows_graphic", F.coalesce(F.last(graphic, ignorenulls=True).over(back), F.lit(False)))
        .withColumn("precedes_graphic", F.coalesce(F.first(graphic, ignorenulls=True).over(ahead), F.lit(False)))
    )


def modal_body(blocks: DataFrame) -> DataFrame:
    """Word-weighted modal size, font and style of the prose of each document.

    Prose is at least eight words, closed by punctuation, neither heading nor list. A document
    without a sized prose block falls back to every non-empty sized block.
    """
    real = (F.col("kind") == "p") & ~F.col("is_empty")
    prose = real & (F.col("words") >= PROSE_WORDS) & F.col("ends_with_terminal") & F.col(
        "outline_level").isNull() & F.col("num_id").isNull()
    weighed = blocks.where(real).select(
        "doc", F.when(prose, F.col("words")).otherwise(0).alias("wp"),
        F.when(F.col("size").isNotNull(), F.greatest("words", F.lit(1))).otherwise(0).alias("wf"),
        F.expr("inline(array(struct('size' as prop, cast(size as string) as val), struct('font' as prop, font as val),"
               " struct('style' as prop, nullif(style_name, '') as val)))"))
    counted = weighed.where("val is not null").groupBy("doc", "prop", "val").agg(
        F.sum("wp").alias("wp"), F.sum("wf").alias("wf"))
    has = F.sum(F.when(F.col("prop") == "size", F.col("wp")).otherwise(0)).over(_whole()) > 0
    weight = F.when(has, F.col("wp")).otherwise(F.col("wp") + F.col("wf"))
    top = counted.withColumn("w", weight).where("w > 0").groupBy("doc").agg(*[
        F.min(F.when(F.col("prop") == p, F.struct((-F.col("w")).alias("w"), "val")))["val"].alias(f"modal_{p}")
        for p in ("size", "font", "style")])
    return top.withColumn("modal_size", F.col("modal_size").cast("int"))


def style_share(blocks: DataFrame) -> DataFrame:
    """Share of a document's non-empty paragraphs carrying each style."""
    n = blocks.where("kind = 'p' and not is_empty").groupBy("doc", "style_name").agg(F.count(F.lit(1)).alias("n"))
    return n.select("doc", "style_name", (F.col("n") / F.sum("n").over(_whole())).alias("share"))


SIGNATURE = ["style_name", "size", "bold", "italic", "caps", "alignment", "indent_left", "outline_level",
             "ilvl", "is_bullet"]


def signature() -> Column:
    """What "formatted the same way" means: ten properties as one key."""
    flags = {"bold", "italic", "caps", "is_bullet"}
    parts = [F.coalesce(F.col(c), F.lit(False)).cast("string") if c in flags
             else F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in SIGNATURE]
    return F.concat_ws("|", *parts)


def context(blocks: DataFrame) -> DataFrame:
    """D1-D8 together: every measure the classifier asks about, over one partitioning by document."""
    measured = body_ordinal(adjacency(blocks))
    modal, share = modal_body(measured), style_share(measured)
    return (
        measured.join(modal, "doc", "left").join(share, ["doc", "style_name"], "left")
        .withColumn("size_ratio", F.coalesce("size", F.lit(IMPLICIT_HALF_POINTS)) / F.coalesce("modal_size", F.lit(IMPLICIT_HALF_POINTS)))
        .withColumn("share", F.coalesce("share", F.lit(0.0)))
        .withColumn("signature", signature())
    )


def direct_density(runs: DataFrame, by: list[str]) -> DataFrame:
    """Share of runs whose author reached past the styles, and the styles used."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.count(F.when(F.col("direct"), 1)).alias("direct_runs"),
        F.avg(F.col("direct").cast("double")).alias("direct_density"),
        F.countDistinct("style_name").alias("styles_used"))


# Run properties that say an author reached past the styles; bold and italic are emphasis and do not
DIRECT_MARKERS = ["rFonts", "sz", "szCs", "color", "highlight", "shd", "spacing", "position", "kern", "u", "bdr", "em"]


def doc_meta(blocks: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per document: counts, flags and what disqualifies it as an exemplar.

    ``runs(doc, idx, markers)`` has one row per run of a block with the names of its own properties. Runs of deleted
    blocks and of blocks that are no paragraphs do not count.
    """
    flag = lambda c: F.coalesce(F.bool_or(F.col(c)), F.lit(False))
    own = runs.groupBy("doc", "idx").agg(F.count(F.lit(1)).alias("n_runs"), F.count(F.when(F.arrays_overlap("markers", F.array(*map(F.lit, DIRECT_MARKERS))), 1)).alias("n_direct"))
    live = (F.col("kind") == "p") & ~F.col("in_del")
    total, direct = (F.coalesce(F.sum(F.when(live, F.col(c))), F.lit(0)) for c in ("n_runs", "n_direct"))
    return blocks.join(own, ["doc", "idx"], "left").groupBy("doc").agg(
        F.count(F.lit(1)).alias("blocks"), F.count(F.when(live, 1)).alias("paragraphs"), total.alias("runs"), direct.alias("direct_runs"),
        F.coalesce(F.try_divide(direct, total), F.lit(0.0)).alias("direct_density"),
        F.countDistinct(F.when(live, F.col("style_name"))).alias("styles_used"),
        F.countDistinct("num_id").alias("list_count"),
        F.countDistinct(F.when(F.col("ctx_kind") == "header", F.col("part"))).alias("header_parts"),
        F.countDistinct(F.when(F.col("ctx_kind") == "footer", F.col("part"))).alias("footer_parts"),
        flag("in_textbox").alias("has_textbox"), flag("in_sdt").alias("has_content_controls"),
        F.bool_or(F.col("kind") == "altChunk").alias("has_alt_chunk"),
        (flag("in_ins") | flag("in_del")).alias("has_tracked_changes"),
    ).withColumn("disqualified", F.col("has_alt_chunk") | F.col("has_tracked_changes"))
