"""Telling a person where a block is: heading path, place in its section, container, find string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import keys as K

# Find strings run from five to fourteen words.
MIN_WORDS, MAX_WORDS = 5, 14
MAX_LEVEL = 9


def _doc():
    return Window.partitionBy("doc").orderBy("idx")


def _so_far():
    return _doc().rowsBetween(Window.unboundedPreceding, 0)


def heading_level(blocks: DataFrame) -> DataFrame:
    """Depth of a heading in the outline: a title is 0, other blocks null."""
    found = F.nullif(F.regexp_extract("role", r"^heading(\d+)$", 1), F.lit("")).cast("int")
    return blocks.withColumn("_level", F.when(F.col("role") == "title", 0).otherwise(found))


def heading_paths(blocks: DataFrame) -> DataFrame:
    """Open headings above each block, outermost first.

    Per depth the last heading so far; it is still open if no shallower heading came after it.
    """
    work = heading_level(blocks)
    title = K.collapse(F.col("text"))
    title = F.when(title == "", "(untitled)").otherwise(title)
    for k in range(MAX_LEVEL + 1):
        here = F.when(F.col("_level") == k, F.struct("idx", title.alias("title")))
        work = work.withColumn(f"_h{k}", F.last(here, ignorenulls=True).over(_so_far()))
    newest = None
    opened = []
    for k in range(MAX_LEVEL + 1):
        at = F.col(f"_h{k}")
        alive = at["idx"].isNotNull() if newest is None else at["idx"] > F.coalesce(newest, F.lit(-1))
        opened.append(F.when(alive, at["title"]))
        newest = at["idx"] if newest is None else F.greatest(newest, at["idx"])
    return work.withColumn("heading_path", F.array_compact(F.array(*opened))).drop(
        *[f"_h{k}" for k in range(MAX_LEVEL + 1)])


def ordinals(blocks: DataFrame) -> DataFrame:
    """Nth paragraph of how many since its heading."""
    work = blocks if "_level" in blocks.columns else heading_level(blocks)
    work = work.withColumn("_sec", F.count("_level").over(_so_far()))
    section = Window.partitionBy("doc", "_sec")
    return (
        work.withColumn("ordinal", F.row_number().over(section.orderBy("idx")))
        .withColumn("of", F.count(F.lit(1)).over(section)).drop("_sec"))


def containers(blocks: DataFrame) -> DataFrame:
    """P18: "table 3, row 2, column 1", a story name, a text box, a control, or the body."""
    nested = F.when(F.col("table_depth") > 1, F.format_string(" (nested %d deep)", "table_depth")).otherwise("")
    in_table = F.concat(F.format_string("table %d, row %d, column %d", "table_no", "row", "col"), nested)
    control = F.when(F.coalesce("sdt_tag", F.lit("")) != "", F.concat(F.lit("content control '"), F.col("sdt_tag"), F.lit("'"))
                     ).otherwise("content control")
    return blocks.withColumn(
        "container", F.when(F.col("ctx_kind") == "table", in_table)
        .when(F.col("ctx_kind").isin("header", "footer", "footnote", "endnote", "comment"), F.col("ctx_kind"))
        .when(F.col("in_textbox"), "text box").when(F.col("in_sdt"), control).otherwise("body"))


def find_strings(blocks: DataFrame) -> DataFrame:
    """The shortest opening of 5-14 words that occurs once in the document, as a substring.

    A document's blocks are gathered once, with its whole text beside them; a longer opening is only tried where the
    shorter ones occur again.
    """
    names = [c for c in blocks.columns if c != "doc"]
    flat = blocks.select("doc", F.struct("idx", K.collapse(F.col("text")).alias("flat"), F.struct(*names).alias("block")).alias("b"))
    docs = flat.groupBy("doc").agg(F.collect_list("b").alias("bs"))
    shown = F.transform(F.array_sort(F.transform(F.filter("bs", lambda b: b["flat"] != ""), lambda b: F.struct(b["idx"].alias("idx"), b["flat"].alias("flat")))), lambda b: b["flat"])
    docs = docs.withColumn("whole", F.array_join(shown, "\n"))

    def opening(flat: Column, k: int) -> Column:
        return F.substring_index(flat, " ", k)

    def once(words: Column) -> Column:
        return F.length("whole") - F.length(F.replace(F.col("whole"), words)) <= F.length(words)

    found = F.when(F.col("flat") == "", "")
    for k in range(MIN_WORDS, MAX_WORDS):
        found = found.when(once(opening(F.col("flat"), k)), opening(F.col("flat"), k))
    rows = docs.select("doc", "whole", F.explode_outer("bs").alias("b")).select("doc", "whole", "b.flat", "b.block.*")
    return rows.withColumn("find_string", found.otherwise(opening(F.col("flat"), MAX_WORDS))).select(*blocks.columns, "find_string")


def cover(blocks: DataFrame) -> DataFrame:
    """The blocks before the first heading; none if the document has no heading."""
    first = F.min(F.when(F.col("level").isNotNull(), F.col("idx"))).over(Window.partitionBy("doc"))
    return blocks.withColumn("_first", first).where("idx < _first").drop("_first")
