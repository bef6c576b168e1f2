"""Runs to text, Markdown to blocks and back, captions, lists, tables, inlines.

Windows and collected arrays are per block, per table or per document, all of which come from one
source row or file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import keys as K

# Fixed patterns
CAPTION = r"(?i)^\s*(figure|fig\.?|table)\s*[\d{]"
LABEL = r"\{#([A-Za-z0-9_:.\-]+)\}\s*$"
REFERENCE = r"\[\]\(#([^)\s]+)\)"
NOTE_USE = r"\[\^([^\]\s]+)\]"
NOTE_DEF = r"^\[\^([^\]\s]+)\]:\s?(.*)$"
DIRECTIVE = r"^:::+\s*([A-Za-z0-9_-]*)\s*$"
FRONT = r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)"
ESCAPES = r"([\\`*_\[\]])"


def _doc():
    return Window.partitionBy("doc").orderBy("idx")


def _upto():
    return _doc().rowsBetween(Window.unboundedPreceding, 0)


def _ordered_text(rows: DataFrame, by: list[str], order: str, text: str, glue: str, name: str) -> DataFrame:
    """Strings of a group joined in order; the order is sorted explicitly."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), glue)
    return rows.groupBy(*by).agg(joined.alias(name))


def assemble_text(runs: DataFrame) -> DataFrame:
    """Visible text of a paragraph from its pieces ``(doc, idx, seq, piece, text, deleted)``."""
    shown = (
        F.when(F.col("deleted") | F.col("piece").isin("instr", "delText"), "").when(F.col("piece") == "tab", "\t").when(F.col("piece") == "break", "\n")
        .when(F.col("piece") == "noBreakHyphen", "-").when(F.col("piece") == "sym", "￼").when(F.col("piece").isin("text", "math"), F.coalesce("text", F.lit(""))).otherwise(""))
    return _ordered_text(runs.withColumn("s", shown), ["doc", "idx"], "seq", "s", "", "text")


def field_instructions(runs: DataFrame) -> DataFrame:
    """Instruction text of outermost fields, put together across runs: ``(doc, idx, seq_no, instruction)``.

    The depth is a running sum; text counts between a begin and the first separate or end at depth one.
    """
    here = Window.partitionBy("doc", "idx").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(F.col("piece") == "begin", 1).when(F.col("piece") == "end", -1).otherwise(0)).over(here)
    work = runs.withColumn("depth", depth)
    opens = (F.col("piece") == "begin") & (F.col("depth") == 1)
    closes = ((F.col("piece") == "separate") & (F.col("depth") == 1)) | ((F.col("piece") == "end") & (F.col("depth") == 0))
    work = work.withColumn("seq_no", F.count(F.when(opens, 1)).over(here)).withColumn("closes", closes)
    shut = F.sum(F.when(F.col("closes"), 1).otherwise(0)).over(Window.partitionBy("doc", "idx", "seq_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    text = work.withColumn("shut", shut).where("piece = 'instr' and depth >= 1 and shut = 0 and seq_no > 0").withColumn("s", F.coalesce("text", F.lit("")))
    out = _ordered_text(text, ["doc", "idx", "seq_no"], "seq", "s", "", "raw")
    return out.withColumn("instruction", K.collapse(F.col("raw"))).where("instruction <> ''").drop("raw")


def doc_properties(props: DataFrame) -> DataFrame:
    """Name -> value; the first source in order wins, blanks do not count."""
    live = props.withColumn("value", F.trim("value")).where("value <> ''")
    return live.groupBy("doc", "name").agg(F.min_by("value", "source_order").alias("value"))


def front_matter(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc, text)`` to flat keys and values and the remaining body; nested YAML is an error row."""
    head = F.regexp_extract("text", FRONT, 1)
    split = texts.select("doc", head.alias("head"), F.regexp_replace("text", FRONT, "").alias("body"))
    line = split.select("doc", F.explode(F.split("head", "\n")).alias("line")).where("trim(line) <> '' and not startswith(trim(line), '#')")
    key = F.trim(F.regexp_extract("line", r"^([A-Za-z0-9_ .-]+):(?:\s|$)", 1))
    value = F.regexp_replace(F.trim(F.regexp_replace("line", r"^[A-Za-z0-9_ .-]+:", "")), "^(['\"])(.*)\\1$", "$2")
    meta = line.select("doc", F.when(F.col("line").rlike(r"^\s") | (key == ""), None).otherwise(key).alias("name"), value.alias("value"))
    return meta.withColumn("error", F.when(F.col("name").isNull(), "nested or malformed front matter")), split.select("doc", "body")


def markdown_blocks(texts: DataFrame) -> DataFrame:
    """Markdown bodies ``(doc, text)`` to blocks ``(doc, idx, type, level, label, text)``.

    Lines get a class; fences and math switch by the parity of their marks so far; a block starts at a
    blank line, at a change of class, or at every line of a class that stands alone.
    """
    lines = texts.select("doc", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    fence, math = F.col("line").rlike(r"^\s{0,3}```"), F.col("line").rlike(r"^\s*\$\$\s*$")
    work = lines.withColumn("_f", F.count(F.when(fence, 1)).over(_upto())).withColumn("_isf", fence)
    inside = (F.col("_f") % 2 == 1) | F.col("_isf")
    work = work.withColumn("_m", F.count(F.when(~inside & math, 1)).over(_upto())).withColumn("_ism", ~inside & math)
    c = F.col("line")
    klass = (
        F.when(inside, "code").when((F.col("_m") % 2 == 1) | F.col("_ism"), "math").when(c.rlike(r"^\s*$"), "blank")
        .when(c.rlike(r"(?i)^\s*<!--\s*toc\s*-->"), "toc").when(c.rlike(r"(?i)^\s*<!--\s*(page-?break|newpage)\s*-->"), "pagebreak")
        .when(c.rlike(r"^#{1,6}\s"), "heading").when(c.rlike(DIRECTIVE), "directive").when(c.rlike(NOTE_DEF), "footnote")
        .when(c.rlike(r"^\s{0,3}(?:-{3,}|\*{3,}|_{3,})\s*$"), "hr").when(c.rlike(r"^\s*\|.*\|\s*$"), "table").when(c.rlike(r"^\s*>"), "quote")
        .when(c.rlike(r"^\s*(?:[-*+]|\d+[.)])\s+"), "list_item").when(c.rlike(r"^\s*<[A-Za-z!/]"), "html").otherwise("para"))
    work = work.withColumn("type", klass)
    alone = F.col("type").isin("heading", "list_item", "toc", "pagebreak", "hr", "directive", "footnote")
    opening = (F.col("type") == "code") & F.col("_isf") & (F.col("_f") % 2 == 1)
    prior = F.lag("type").over(_doc())
    starts = alone | opening | prior.isNull() | (prior != F.col("type"))
    grouped = work.withColumn("_g", F.sum(F.when(starts, 1).otherwise(0)).over(_upto())).where("type <> 'blank'")
    block = grouped.groupBy("doc", "_g", "type").agg(F.min("idx").alias("idx"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n").alias("raw"))
    level = F.when(F.col("type") == "heading", F.length(F.regexp_extract("raw", r"^(#{1,6})", 1))).when(F.col("type") == "list_item", F.floor(F.length(F.regexp_extract("raw", r"^(\s*)", 1)) / 2).cast("int"))
    body = (
        F.when(F.col("type") == "heading", F.regexp_replace("raw", r"^#{1,6}\s+|\s+#*\s*$", "")).when(F.col("type") == "list_item", F.regexp_replace("raw", r"^\s*(?:[-*+]|\d+[.)])\s+", ""))
        .when(F.col("type") == "code", F.regexp_replace("raw", r"^\s*```[^\n]*\n|\n?\s*```\s*$", "")).when(F.col("type") == "math", F.regexp_replace("raw", r"^\s*\$\$\n|\n\$\$\s*$", ""))
        .when(F.col("type") == "quote", F.regexp_replace("raw", r"(?m)^\s*>\s?", "")).when(F.col("type") == "para", F.regexp_replace("raw", r"\n", " ")).otherwise(F.col("raw")))
    label = F.when(F.col("type").isin("heading", "para"), F.nullif(F.regexp_extract("raw", LABEL, 1), F.lit("")))
    text = F.when(F.col("type").isin("heading", "para"), F.trim(F.regexp_replace(body, LABEL, ""))).otherwise(body)
    return block.select("doc", "idx", "type", level.alias("level"), label.alias("label"), text.alias("text"))


def html_warnings(blocks: DataFrame) -> DataFrame:
    """HTML has no counterpart and is dropped with a warning."""
    return blocks.where("type = 'html'").select("doc", "idx", F.substring("text", 1, 40).alias("dropped"))


def pair_captions(blocks: DataFrame) -> DataFrame:
    """A figure takes the caption after it, a table the one before it; labels move to the thing captioned.

    ``blocks``: doc, idx, type, text, label.
    """
    cap = (F.col("type") == "para") & F.col("text").rlike(CAPTION)
    work = blocks.withColumn("_cap", cap).withColumn("_pt", F.lag("type").over(_doc())).withColumn("_nt", F.lead("type").over(_doc()))
    work = work.withColumn("_fig", F.col("_cap") & F.coalesce(F.col("_pt") == "figure", F.lit(False)))
    work = work.withColumn("_tab", F.col("_cap") & ~F.col("_fig") & F.coalesce(F.col("_nt") == "table", F.lit(False)))
    info = F.struct("text", "label")
    below = F.when((F.col("type") == "figure") & F.coalesce(F.lead("_fig").over(_doc()), F.lit(False)), F.lead(info).over(_doc()))
    above = F.when((F.col("type") == "table") & F.coalesce(F.lag("_tab").over(_doc()), F.lit(False)), F.lag(info).over(_doc()))
    paired = work.withColumn("_c", F.coalesce(below, above)).where("not _fig and not _tab")
    return paired.select("doc", "idx", "type", "text", F.col("_c.text").alias("caption"), F.coalesce("label", "_c.label").alias("label"))


def label_index(blocks: DataFrame) -> DataFrame:
    """Labels defined, references made, footnotes used: ``(doc, what, label)``."""
    def found(pattern: str, what: str) -> DataFrame:
        return blocks.select("doc", F.lit(what).alias("what"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("label"))
    return found(r"(?m)" + LABEL, "label").unionByName(found(REFERENCE, "reference")).unionByName(found(NOTE_USE + "(?!:)", "footnote"))


def renumber(items: DataFrame) -> DataFrame:
    """Captions counted again per kind."""
    return items.withColumn("number", F.row_number().over(Window.partitionBy("doc", "kind").orderBy("idx")))


def nest_lists(blocks: DataFrame) -> DataFrame:
    """T4: list id, depth and parent of list items; anything else, or a change of kind, ends a list.

    ``blocks``: doc, idx, is_item, ordered, level. An item may be one deeper than the one before at most.
    """
    changed = F.col("is_item") & (F.coalesce(~F.lag("is_item").over(_doc()), F.lit(True)) | (F.lag("ordered").over(_doc()) != F.col("ordered")))
    items = blocks.withColumn("list_id", F.sum(F.when(changed, 1).otherwise(0)).over(_upto())).where("is_item")
    one = Window.partitionBy("doc", "list_id").orderBy("idx")
    upto = one.rowsBetween(Window.unboundedPreceding, 0)
    items = items.withColumn("_i", F.row_number().over(one)).withColumn("_l", F.when(F.col("_i") == 1, 0).otherwise(F.col("level")))
    items = items.withColumn("depth", (F.col("_i") + F.min(F.col("_l") - F.col("_i")).over(upto)).cast("int"))
    # depth grows by one at most, so the last item before a run of deeper ones is the parent at any depth:
    # the last item one level up, read per (list, level) over levels of neighbouring depth
    pairs = items.select("*", F.explode(F.array(F.col("depth"), F.col("depth") + 1)).alias("_at"))
    level = Window.partitionBy("doc", "list_id", "_at").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    above = F.last(F.when(F.col("_at") == F.col("depth") + 1, F.col("idx")), ignorenulls=True).over(level)
    return pairs.withColumn("parent", above).where("_at = depth").drop("_i", "_l", "_at")


def shape_tables(cells: DataFrame) -> DataFrame:
    """T5: rectangular tables: ragged rows padded, the first row is the header, alignment from the first body row.

    ``cells``: doc, tbl, row, col, text, align. The cells of a table meet once: rows are gathered, then tables, in one partitioning.
    """
    rows = cells.repartition("doc", "tbl").groupBy("doc", "tbl", "row").agg(F.collect_list(F.struct("col", "text", "align")).alias("cs"), F.max("col").alias("n"))
    tables = rows.groupBy("doc", "tbl").agg(F.collect_list(F.struct("row", "cs")).alias("ls"), F.max("n").alias("cols"), F.max("row").alias("rows"))
    body = F.flatten(F.transform(F.filter("ls", lambda r: r["row"] == F.least(F.lit(2), F.col("rows"))), lambda r: r["cs"]))
    aligned = F.filter(body, lambda c: c["align"].isin("center", "right"))
    row = tables.withColumn("aligned", aligned).select("doc", "tbl", "cols", "aligned", F.explode_outer("ls").alias("l")).select("doc", "tbl", "cols", "aligned", "l.row", "l.cs")
    grid = row.select("doc", "tbl", "row", F.posexplode_outer(F.transform(F.sequence(F.lit(1), F.col("cols")), lambda k: F.struct(
        k.alias("col"), F.filter("cs", lambda c: c["col"] == k).alias("own"), F.get(F.filter("aligned", lambda c: c["col"] == k), F.lit(0))["align"].alias("align")))).alias("_p", "g"))
    filled = grid.select("doc", "tbl", "row", F.col("g.col").alias("col"), F.explode_outer("g.own").alias("c"), F.col("g.align").alias("_a"))
    return filled.select("doc", "tbl", "row", "col", F.coalesce("c.text", F.lit("")).alias("text"), (F.col("row") == 1).alias("header"), F.coalesce("_a", F.lit("left")).alias("align"))


def merge_inlines(inlines: DataFrame) -> DataFrame:
    """Neighbouring texts, and emphases of one strength, become one; empty texts go.

    ``inlines``: doc, idx, seq, kind (text | emphasis | other), strong, value.
    """
    return merge_inline_lists(inlines.groupBy("doc", "idx").agg(F.collect_list(F.struct("seq", "kind", "strong", "value")).alias("inlines")))


def merge_inline_lists(blocks: DataFrame) -> DataFrame:
    """T6 for blocks ``(doc, idx, inlines)`` that carry their inlines ``(seq, kind, strong, value)`` as one array: no shuffle, no sort of rows.

    A new inline starts where one differs from the one before; each runs up to the next start.
    """
    same = "inlines[i - 1].kind = inlines[i - 2].kind and inlines[i - 1].strong <=> inlines[i - 2].strong and inlines[i - 1].kind in ('text', 'emphasis')"
    sorted_ = blocks.where("size(inlines) > 0").select("doc", "idx", F.array_sort("inlines").alias("inlines"))
    starts = sorted_.withColumn("starts", F.expr(f"filter(sequence(1, size(inlines)), i -> i = 1 or not coalesce({same}, false))"))
    merged = starts.select("doc", "idx", F.expr(
        "inline(transform(starts, (s, n) -> struct(inlines[s - 1].kind as kind, inlines[s - 1].strong as strong,"
        " array_join(transform(slice(inlines, s, coalesce(get(starts, n + 1), size(inlines) + 1) - s), x -> x.value), '') as value)))"))
    return merged.where("not (kind = 'text' and value = '')")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPES, r"\\$1")


def render_tables(shaped: DataFrame) -> DataFrame:
    """Padded pipe tables: ``(doc, tbl, text)``."""
    rows = shaped.groupBy("doc", "tbl", "row").agg(F.array_sort(F.collect_list(F.struct("col", "text", "align"))).alias("cs"), F.max("header").alias("header"), F.max("col").alias("n"))
    tables = rows.groupBy("doc", "tbl").agg(F.array_sort(F.collect_list(F.struct("row", "header", "cs"))).alias("ls"), F.max("n").alias("cols"))
    longest = lambda r, k: F.array_max(F.transform(F.filter(r["cs"], lambda c: c["col"] == k), lambda c: F.length(c["text"])))
    widths = F.transform(F.sequence(F.lit(1), F.col("cols")), lambda k: F.greatest(F.lit(3), F.array_max(F.transform("ls", lambda r: longest(r, k)))))
    width = lambda c: F.get(F.col("ws"), c["col"] - 1)

    def cell(c: Column) -> Column:
        return F.rpad(c["text"], width(c), F.lit(" "))

    def rule(c: Column) -> Column:
        dashes = lambda n: F.repeat(F.lit("-"), width(c) - n)
        return F.when(c["align"] == "right", F.concat(dashes(1), F.lit(":"))).when(c["align"] == "center", F.concat(F.lit(":"), dashes(2), F.lit(":"))).otherwise(dashes(0))

    def line(cells: Column, shown) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, shown), " | "), F.lit(" |"))

    lines = F.flatten(F.transform("ls", lambda r: F.when(r["header"], F.array(line(r["cs"], cell), line(r["cs"], rule))).otherwise(F.array(line(r["cs"], cell)))))
    # written out row by row before it is used, so that the widths are worked out once for a table
    return tables.select("doc", "tbl", "ls", F.explode_outer(F.array(widths)).alias("ws")).select("doc", "tbl", F.array_join(lines, "\n").alias("text"))


def to_markdown(blocks: DataFrame) -> DataFrame:
    """One Markdown text per document.

    ``blocks``: doc, idx, type (heading | para | list_item | table | code | quote | math | hr | toc |
    pagebreak | figure | footnote), level, ordered, label, text, alt. Tables carry their rendered text.
    """
    label = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit(" {#"), F.col("label"), F.lit("}"))).otherwise("")
    prior = F.lag("type").over(_doc())
    work = blocks.withColumn("_new", (F.col("type") != "list_item") | prior.isNull() | (prior != "list_item") | (F.lag("ordered").over(_doc()) != F.col("ordered")))
    work = work.withColumn("_g", F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(_upto()))
    nth = F.row_number().over(Window.partitionBy("doc", "_g", "level").orderBy("idx"))
    t, safe = F.col("type"), escape(F.coalesce("text", F.lit("")))
    shown = (
        F.when(t == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.col("level")))), F.lit(" "), safe, label))
        .when(t == "list_item", F.concat(F.repeat(F.lit("  "), F.coalesce("level", F.lit(0))), F.when(F.col("ordered"), F.concat(nth.cast("string"), F.lit("."))).otherwise("-"), F.lit(" "), safe))
        .when(t == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```"))).when(t == "math", F.concat(F.lit("$$\n"), F.col("text"), F.lit("\n$$")))
        .when(t == "quote", F.concat(F.lit("> "), F.replace(safe, F.lit("\n"), F.lit("\n> ")))).when(t == "hr", "---").when(t == "toc", "<!-- toc -->").when(t == "pagebreak", "<!-- pagebreak -->")
        .when(t == "figure", F.concat(F.lit("!["), escape(F.coalesce("alt", F.lit(""))), F.lit("]("), F.col("text"), F.lit(")"), label))
        .when(t == "footnote", F.concat(F.lit("[^"), F.col("label"), F.lit("]: "), safe)).when(t == "table", F.col("text")).otherwise(F.concat(safe, label)))
    lines = work.withColumn("s", shown).withColumn("_last", (t == "footnote").cast("int"))
    chunk = _ordered_text(lines, ["doc", "_g", "_last"], "idx", "s", "\n", "s").where("s <> ''").withColumn("at", F.struct("_last", "_g"))
    return _ordered_text(chunk, ["doc"], "at", "s", "\n\n", "text").withColumn("text", F.concat(F.rtrim("text"), F.lit("\n")))
