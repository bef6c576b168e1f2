"""Ordinary tables as documents: text lines, HTML blocks and conversation turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import keys as K
from plenum.skew import numbered, spread


def with_doc_ids(df: DataFrame, path: str, order: list[str] | None = None) -> DataFrame:
    """A2: file stem as document id; the second ``a.docx`` becomes ``a#2`` in path order."""
    name = F.substring_index(F.regexp_replace(path, r"/+$", ""), "/", -1)
    stem = F.coalesce(F.nullif(F.regexp_replace(name, r"(.)\.[^.]*$", "$1"), F.lit("")), F.lit("doc"))
    out = numbered(df.withColumn("stem", stem), ["stem"], order or [path], "_n")
    doc = F.when(F.col("_n") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("#"), F.col("_n").cast("string")))
    return out.withColumn("doc", doc).drop("_n")


def text_blocks(df: DataFrame, doc: Column, text: Column, *keep: str) -> DataFrame:
    """A4: one row per line, in order; no shuffle."""
    # outer, then no nulls: for an inner explode Spark would split every text twice
    cut = df.select(doc.alias("doc"), *keep, F.posexplode_outer(F.split(text, "\n", -1)).alias("idx", "text")).where("idx is not null")
    return cut.withColumn(
        "is_empty", K.collapse(F.col("text")) == "")


def turn_blocks(df: DataFrame) -> DataFrame:
    """A conversation is a document, its turns are blocks, the speaker is the kind."""
    return df.select(
        F.col("conv_id").cast("string").alias("doc"), F.col("turn").cast("int").alias("idx"),
        F.col("role").alias("kind"), F.lower(K.match_key(F.col("text"))).alias("key"), "text")


def document_text(blocks: DataFrame) -> DataFrame:
    """Visible paragraphs joined by newlines; deleted, prompt and blank blocks left out."""
    seen = blocks.where("kind = 'p' and not in_del and not is_placeholder").where(K.collapse(F.col("text")) != "")
    return seen.groupBy("doc").agg(
        F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("b")
    ).select("doc", F.array_join(F.col("b.text"), "\n").alias("text"))


# The HTML elements that open a block, those that only delimit, and the entities.
BLOCK_TAGS = "h1|h2|h3|h4|h5|h6|p|li|td|th|title|div|blockquote|footer|pre|figcaption"
EDGE_TAGS = "ul|ol|table|tr|article|nav|section|header|head|body|html|main"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
            ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
TAG_STYLES = {**{f"h{n}": f"heading {n}" for n in range(1, 7)}, "title": "title", "li": "list bullet",
              "blockquote": "quote", "figcaption": "caption"}
SPLIT_AT, TAG_END = "\x01", "\x02"


def strip_markup(fragment: Column) -> Column:
    text = F.regexp_replace(fragment, r"(?s)<[^>]*>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return K.collapse(text)


def html_blocks(df: DataFrame, doc: Column, html: Column) -> DataFrame:
    """A5: headings, paragraphs, list items and cells in document order, with table coordinates.

    The page is cut at block-level tags inside its own row, so an unclosed ``<p>`` ends where the
    next block starts. Pages are dealt over all cores before they are cut; the only windows are per page and share one sort.
    """
    pages = spread(df.select(doc.alias("doc"), html.alias("html")), "doc")
    html = F.col("html")
    clean = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    clean = F.regexp_replace(clean, r"(?is)<script.*?</script>|<style.*?</style>", "")
    marked = F.regexp_replace(
        clean, rf"(?is)<(/?)({BLOCK_TAGS}|{EDGE_TAGS})(\s[^>]*)?>", f"{SPLIT_AT}$1$2{TAG_END}")
    # outer, then no nulls: for an inner explode Spark would mark every page twice
    pieces = pages.select("doc", F.posexplode_outer(F.split(marked, SPLIT_AT)).alias("pos", "piece")).where("pos > 0")
    order = Window.partitionBy("doc").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    tag = F.lower(F.substring_index("piece", TAG_END, 1))
    flow = (
        pieces.withColumn("tag", tag)
        .withColumn("raw", F.substring_index("piece", TAG_END, -1))
        .withColumn("part", F.last(F.when(F.col("tag").isin("head", "nav", "article", "footer"), F.col("tag"))
                                   .when(F.col("tag").isin("/head", "/nav", "/article", "/footer"), "body"),
                                   ignorenulls=True).over(so_far))
        .withColumn("tbl", F.count(F.when(F.col("tag") == "table", 1)).over(so_far))
        .withColumn("table_depth", F.sum(F.when(F.col("tag") == "table", 1).when(F.col("tag") == "/table", -1)
                                         .otherwise(0)).over(so_far))
        .withColumn("tr", F.count(F.when(F.col("tag") == "tr", 1)).over(so_far))
        .withColumn("cells", F.count(F.when(F.col("tag").isin("td", "th"), 1)).over(so_far))
    )
    # rows since the table opened, cells since the row opened: differences of running counts
    since = lambda n, opening: F.col(n) - F.coalesce(F.last(F.when(F.col("tag") == opening, F.col(n)), ignorenulls=True).over(so_far), F.lit(0))
    cell = F.col("table_depth") > 0
    placed = flow.withColumn("row", F.when(cell, since("tr", "table"))).withColumn("col", F.when(cell, since("cells", "tr")))
    style = F.lit("normal")
    for name, value in TAG_STYLES.items():
        style = F.when(F.col("tag") == name, value).otherwise(style)
    blocks = placed.where(F.col("tag").rlike(f"^({BLOCK_TAGS})$")).withColumn("text", strip_markup(F.col("raw")))
    return blocks.select(
        "doc", (F.row_number().over(order) - 1).alias("idx"), "part", "tag", style.alias("style_name"),
        F.col("table_depth").cast("int").alias("table_depth"), F.col("row").cast("int").alias("row"),
        F.col("col").cast("int").alias("col"), F.col("raw").rlike(r"(?i)<b[\s>]").alias("bold"), "text",
        (F.col("text") == "").alias("is_empty"))
