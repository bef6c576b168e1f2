"""Fields a document declares by typed markers, instructions, controls, labels and alt texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import keys as K

# Fixed patterns: the four marker styles, the typed prefixes, dotted names, field instructions.
MARKERS = [
    ("###", r"###\s*([^#]{1,40}?)\s*###"), ("merge", r"«\s*([^»]{1,40}?)\s*»"),
    ("braces", r"\{\{\s*([^}]{1,40}?)\s*\}\}"), ("bracket", r"\[([A-Z][A-Za-z0-9 _/'-]{2,30})\]"),
]
SIGNS = {MARKERS[0][1]: "###", MARKERS[1][1]: "«", MARKERS[2][1]: "{{", MARKERS[3][1]: "["}  # what every match of a pattern holds
ANY_MARKER = "|".join(p for _, p in MARKERS)
CLEAR_MARKER = "|".join(p for n, p in MARKERS if n != "bracket")
CHOICE = r"(?i)^\s*(?:choice|select|pick)\s*:\s*([^|]+?)\s*(?:\|\s*(.*?))?\s*$"
TYPED = r"(?i)^\s*(image|img|check|checkbox|bool|date|number|num|amount)\s*:\s*(.+?)\s*$"
KINDS = {"image": "image", "img": "image", "check": "checkbox", "checkbox": "checkbox", "bool": "checkbox",
         "date": "date", "number": "number", "num": "number", "amount": "number"}
DOTTED = r"^\s*([A-Za-z0-9_]+)\.([A-Za-z0-9_. -]+?)\s*$"
INSTRUCTION = r'(?i)^\s*(MERGEFIELD|FILLIN|ASK|DOCPROPERTY|DOCVARIABLE)\s+"?([A-Za-z0-9_ .\-]+?)"?\s*(?:\\|$)'
AUTO_NAME = r"(?i)^(?:text|check|dropdown|dropdown list|list)\s*\d*$"
FILLER = "^[\\s\\x{2002}-\\x{200b} ._]*$"
NAME_WORDS = 6


def _heads(inner: Column) -> Column:
    """What decides how a marker is read: its inner text, the name of a choice, the typed prefix."""
    return F.struct(inner.alias("inner"), F.regexp_extract(inner, CHOICE, 1).alias("choice"), F.lower(F.regexp_extract(inner, TYPED, 1)).alias("typed"))


def _read(heads: Column) -> Column:
    inner, choice, typed = heads["inner"], heads["choice"], heads["typed"]
    is_choice = choice != ""
    body = F.when(typed != "", F.regexp_extract(inner, TYPED, 2)).otherwise(inner)
    kind = F.lit("text")
    for prefix, value in KINDS.items():
        kind = F.when(typed == prefix, value).otherwise(kind)
    named = F.trim(F.when(is_choice, choice).otherwise(F.substring_index(body, "|", 1)))
    options = F.filter(F.transform(F.split(F.regexp_extract(inner, CHOICE, 2), ","), lambda o: F.trim(o)), lambda o: o != "")
    label = F.when(is_choice, "").otherwise(F.trim(F.regexp_extract(body, r"(?s)\|(.*)$", 1)))
    return F.struct(
        F.when(is_choice, "choice").otherwise(kind).alias("kind"),
        F.trim(F.regexp_replace(named, r"\*$", "")).alias("name"),
        F.when(is_choice, options).otherwise(F.array().cast("array<string>")).alias("choices"),
        named.endswith("*").alias("required"), label.alias("label"))


def parse_marker(inner: Column) -> Column:
    """L2: ``[type:] name [*] [| label]`` as ``struct(kind, name, choices, required, label)``."""
    return _read(_heads(inner))


def _found(text: Column, styles: list[tuple[str, str]]) -> Column:
    """Markers of a text with their parsed parts, style by style, in reading order within a style.

    A pattern is tried only where its sign stands. Each step is bound by a transform of its own, so that no
    expression on a marker is worked out again where a later one uses it.
    """
    none = F.array().cast("array<string>")

    def of(style: str, pattern: str) -> Column:
        raws = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if pattern in SIGNS:
            raws = F.when(F.contains(text, F.lit(SIGNS[pattern])), raws).otherwise(none)
        return F.transform(raws, lambda raw: F.struct(
            F.lit(style).alias("style"), raw.alias("raw"), F.trim(F.regexp_extract(raw, pattern, 1)).alias("inner")))

    found = F.concat(*[of(style, pattern) for style, pattern in styles])
    headed = F.transform(found, lambda m: F.struct(m["style"].alias("style"), m["raw"].alias("raw"), _heads(m["inner"]).alias("heads")))
    return F.transform(headed, lambda m: F.struct(m["style"].alias("style"), m["raw"].alias("raw"), _read(m["heads"]).alias("p")))


def _exploded(blocks: DataFrame, styles) -> DataFrame:
    """One row per marker with its parsed parts; ``pos`` is its place in the block."""
    # outer, then no nulls: for an inner explode Spark would find the markers twice, first to see whether there are any
    rows = blocks.select("doc", "idx", F.posexplode_outer(_found(F.col("text"), styles)).alias("pos", "m")).where("m is not null")
    return rows.select("doc", "idx", "pos", "m.style", "m.raw", "m.p.*")


def markers(blocks: DataFrame, styles=None) -> DataFrame:
    """L1: typed markers of every block. Dotted names (repeat columns) and long names are left out."""
    rows = _exploded(blocks, styles or MARKERS).where(
        (F.col("name") != "") & (F.size(F.split(F.trim("name"), r"\s+")) <= NAME_WORDS) & ~F.col("name").rlike(DOTTED))
    block = Window.partitionBy("doc", "idx").orderBy("pos")
    return rows.withColumn("ordinal", F.row_number().over(block) - 1).withColumn("slug", K.question_slug(F.col("name")))


def instruction_fields(instructions: DataFrame) -> DataFrame:
    """L3: fields named by a field instruction."""
    name = F.trim(F.regexp_extract("instruction", INSTRUCTION, 2))
    return instructions.withColumn("name", name).where("name <> ''").select(
        "doc", "idx", F.upper(F.regexp_extract("instruction", INSTRUCTION, 1)).alias("source"),
        K.question_slug(F.col("name")).alias("slug"), F.lit(0.95).alias("confidence"))


def control_fields(controls: DataFrame, tag_prefix: str = "plenum.") -> DataFrame:
    """L4: content controls by their tag, legacy form fields by their own name unless auto-made.

    ``controls``: doc, idx, ordinal, source (sdt | ffData), tag, field_kind, choices, result, default_text.
    """
    bare = F.regexp_replace(F.coalesce("tag", F.lit("")), "^" + tag_prefix.replace(".", "\\."), "")
    own = F.when(F.col("source") == "sdt", bare).when(~bare.rlike(AUTO_NAME), bare).otherwise("")
    value = F.coalesce(F.nullif(F.col("result"), F.lit("")), F.col("default_text"), F.lit(""))
    named = controls.withColumn("own", own).withColumn("value", value)
    first = Window.partitionBy("doc", "idx", "source", "tag").orderBy("ordinal")
    return (
        named.withColumn("_n", F.row_number().over(first)).where("source <> 'sdt' or _n = 1")
        .select("doc", "idx", "ordinal", "source", F.col("field_kind").alias("kind"), "choices", "value",
                F.when(F.col("own") != "", K.question_slug(F.col("own"))).alias("slug"),
                F.when(F.col("source") == "sdt", 1.0).when(F.col("own") != "", 0.9).alias("confidence")))


def label_rank(text: Column) -> Column:
    return (F.when(text.rlike(K.QUESTION_NUMBER) | text.rlike("[:：]$"), 2).when(F.size(F.split(text, " ")) <= 6, 1).otherwise(0))


def labels(fields: DataFrame, blocks: DataFrame) -> DataFrame:
    """The words a reader takes for a field's name.

    ``blocks``: doc, idx, tbl, row, col, text (tbl null outside tables); ``fields``: doc, idx. Earlier
    text in the same cell, then the nearest filled cell above in the column, else the last usable
    block before; label-like text beats merely near text.
    """
    flat = K.collapse(F.col("text"))
    usable = blocks.withColumn("flat", flat).where((flat != "") & ~flat.rlike(FILLER) & (F.size(F.split(flat, " ")) <= 12)).withColumn(
        "rank", label_rank(F.col("flat"))).select("doc", F.col("idx").alias("at"), F.col("tbl").alias("t"), F.col("row").alias("r"), F.col("col").alias("c"), "flat", "rank")
    here = fields.join(blocks.select("doc", "idx", "tbl", "row", "col"), ["doc", "idx"])
    cell = here.where("tbl is not null").join(
        usable, (here.doc == usable.doc) & (F.col("tbl") == F.col("t")) & (F.col("col") == F.col("c")) & (F.col("at") < F.col("idx")) & (F.col("r") <= F.col("row"))
    ).select(here.doc, "idx", "row", "r", "at", "flat", "rank")
    nearest = Window.partitionBy("doc", "idx")
    above = F.max(F.when(F.col("r") < F.col("row"), F.col("r"))).over(nearest)
    ranked = cell.withColumn("up", above).where("r = row or r = up").withColumn(
        "seq", F.when(F.col("r") == F.col("row"), F.col("at")).otherwise(F.lit(1 << 40) - F.col("at")))
    tabled = ranked.groupBy("doc", "idx").agg(F.min(F.struct(-F.col("rank"), F.col("r") < F.col("row"), F.col("seq"), F.col("flat")))["flat"].alias("near"))
    # last usable block before, wherever it is
    marked = blocks.select("doc", "idx").join(usable.select("doc", F.col("at").alias("idx"), "flat"), ["doc", "idx"], "left")
    so_far = Window.partitionBy("doc").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    before = marked.withColumn("prior", F.last("flat", ignorenulls=True).over(so_far)).select("doc", "idx", "prior")
    return fields.join(tabled, ["doc", "idx"], "left").join(before, ["doc", "idx"], "left").select(
        "doc", "idx", F.coalesce("near", "prior", F.lit("")).alias("label"))


def checkbox_labels(blocks: DataFrame, box: str = "☐") -> DataFrame:
    """For each box of a paragraph the words it belongs to; the paragraph itself shows the side."""
    segments = F.transform(F.split("text", box), lambda s: K.collapse(s))
    rows = blocks.where(F.contains("text", F.lit(box))).withColumn("seg", segments)
    side = F.expr("case when seg[0] = '' and element_at(seg, -1) <> '' then 'after' when seg[0] <> '' and element_at(seg, -1) = '' then 'before' else 'after' end")
    boxes = rows.withColumn("side", side).select("doc", "idx", "side", F.expr("posexplode(slice(arrays_zip(seg, slice(concat(seg, array('')), 2, size(seg))), 1, size(seg) - 1))").alias("ordinal", "z"))
    before, after = F.col("z")["seg"], F.col("z")["1"]
    own = F.when(F.col("side") == "after", F.coalesce(F.nullif(after, F.lit("")), before)).otherwise(F.coalesce(F.nullif(before, F.lit("")), after))
    return boxes.select("doc", "idx", "ordinal", "side", own.alias("label"))


def picture_fields(alts: DataFrame) -> DataFrame:
    """An image field is a marker in a picture's alt text (never the bracket style); one per name.

    ``alts``: doc, idx, text.
    """
    hit = markers(alts, [m for m in MARKERS if m[0] != "bracket"]).where("ordinal = 0")
    first = hit.groupBy("doc", "slug").agg(F.min(F.struct("idx", "required", "label")).alias("m"))
    return first.select("doc", F.col("m.idx").alias("idx"), "slug", F.lit("image").alias("kind"), F.col("m.required").alias("required"), F.col("m.label").alias("label"))


def repeats(blocks: DataFrame) -> DataFrame:
    """Dotted names as columns of a collection, in first-seen order."""
    rows = _exploded(blocks, MARKERS).where(F.col("name").rlike(DOTTED))
    column = F.trim(F.regexp_extract("name", DOTTED, 2))
    named = rows.withColumn("collection", K.question_slug(F.regexp_extract("name", DOTTED, 1))).withColumn("column", K.question_slug(column)).withColumn(
        "shown", F.coalesce(F.nullif(F.col("label"), F.lit("")), F.initcap(F.trim(F.replace(column, F.lit("_"), F.lit(" "))))))
    return named.groupBy("doc", "collection", "column").agg(F.min(F.struct("idx", "pos", "kind", "shown", "choices")).alias("m")).select(
        "doc", "collection", "column", F.col("m.idx").alias("idx"), F.col("m.pos").alias("pos"), F.col("m.kind").alias("kind"), F.col("m.shown").alias("label"), F.col("m.choices").alias("choices"))


def field_list(found: DataFrame) -> DataFrame:
    """Fields in order with unique names (``_2``, ``_3``…) and whether they still need a value.

    ``found``: doc, idx, ordinal, kind, slug, value.
    """
    nth = F.row_number().over(Window.partitionBy("doc", "slug").orderBy("idx", "ordinal"))
    filled = (K.collapse(F.coalesce("value", F.lit(""))) != "") & ~F.coalesce("value", F.lit("")).rlike(FILLER)
    return found.withColumn("_n", nth).withColumn(
        "name", F.when(F.col("_n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("_"), F.col("_n").cast("string")))
    ).withColumn("filled", filled).withColumn("unfilled", ~F.col("filled") & (F.col("kind") != "checkbox")).drop("_n")
