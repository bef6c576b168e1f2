"""Removing what the corpus does not vouch for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.skew import small

# Fixed values
MIN_CORPUS = 3
LINE_SHARE = 0.5
PERSONAL = ["creator", "lastModifiedBy", "lastPrinted", "title", "contentStatus", "identifier", "version",
            "description", "keywords", "subject", "category", "Company", "Manager"]
IDENTITY = ["creator", "lastModifiedBy", "Company", "Manager"]
APP_CONTENT = ["TitlesOfParts", "HeadingPairs", "Template", "HyperlinkBase", "Words", "Characters", "Lines",
               "Paragraphs", "Pages", "TotalTime"]
DATA_TREES = ["customXml/", "word/glossary/", "word/printerSettings/", "word/webextensions/", "word/activeX/", "_xmlsignatures/"]
DATA_FILES = ["word/vbaProject.bin", "word/vbaData.xml"]
DATA_TYPES = ["thumbnail", "customXml", "printerSettings", "signature", "signatureOrigin"]
PRUNABLE = ["image", "oleObject", "chart", "hyperlink", "package"]
SESSION_ATTRS = ["rsid", "rsidR", "rsidRPr", "rsidDel", "rsidP", "rsidRDefault", "rsidSect", "rsidTr"]
SCRUB_ELEMENTS = {
    "spell-check markers": ["proofErr"], "content-control locks": ["lock"], "data bindings": ["dataBinding"],
    "comment anchors": ["commentRangeStart", "commentRangeEnd", "commentReference"],
    "document settings": ["rsids", "proofState", "docVars", "documentProtection", "writeProtection"],
    "attached template": ["attachedTemplate"],
}
KEPT_ON_PURPOSE = {"docMetadata/LabelInfo.xml": "a sensitivity label", "customUI/customUI.xml": "a ribbon customisation",
                   "customUI/customUI14.xml": "a ribbon customisation"}


def keep_indices(located: DataFrame) -> DataFrame:
    """Exemplar blocks the skeleton vouches for: headings, fixed wording, fields."""
    return located.where("donor_index is not null and (is_heading or kind in ('boilerplate', 'placeholder'))").select("corpus", F.col("donor_index").alias("idx")).distinct()


def clear_body(blocks: DataFrame, keep: DataFrame, sizes: DataFrame) -> DataFrame:
    """Text of unvouched body blocks emptied; a corpus of fewer than three documents is left alone.

    ``blocks``: corpus, doc, idx, text, is_empty, ctx_kind; ``keep``: corpus, doc, idx; ``sizes``: corpus, n_docs.
    """
    vouched = keep.select("corpus", "doc", "idx").distinct().withColumn("_k", F.lit(True))
    joined = blocks.join(small(sizes), "corpus", "left").join(vouched, ["corpus", "doc", "idx"], "left")
    cleared = (F.col("n_docs") >= MIN_CORPUS) & F.col("_k").isNull() & ~F.col("is_empty") & F.col("ctx_kind").isin("body", "table")
    return joined.withColumn("cleared", F.coalesce(cleared, F.lit(False))).withColumn(
        "text", F.when(F.col("cleared"), "").otherwise(F.col("text"))).drop("_k", "n_docs")


def collapse_cleared(cleared: DataFrame) -> DataFrame:
    """Of consecutive cleared siblings one stays; section breaks and a cell's only block always do."""
    siblings = Window.partitionBy("corpus", "doc", "parent").orderBy("idx")
    alone = F.count(F.lit(1)).over(Window.partitionBy("corpus", "doc", "parent")) <= 1
    run = F.col("cleared") & F.coalesce(F.lag("cleared").over(siblings), F.lit(False))
    return cleared.withColumn("dropped", run & ~F.col("is_break") & ~(F.col("in_cell") & alone))


def vouched_lines(lines: DataFrame, sizes: DataFrame, share: float = LINE_SHARE) -> DataFrame:
    """Keys that enough OTHER documents of the corpus repeat: ``(corpus, key)``.

    A key in at least half of the documents; their number is at most twice the mean document length,
    so the result is small whatever the corpus holds. Keys are counted over distinct (document, key).
    """
    once = lines.where("key <> ''").select("corpus", "doc", "key").distinct()
    support = once.groupBy("corpus", "key").agg(F.count(F.lit(1)).alias("docs")).join(small(sizes), "corpus")
    others = F.col("n_docs") - 1
    return support.where((others >= 1) & (F.col("docs") - 1 >= F.greatest(F.lit(1), F.floor(others * share)))).select("corpus", "key")


def filter_lines(lines: DataFrame, sizes: DataFrame, share: float = LINE_SHARE) -> DataFrame:
    """Each line with ``kept``; a corpus of one has nothing to compare with and is kept."""
    ok = vouched_lines(lines, sizes, share).withColumn("_ok", F.lit(True))
    joined = lines.join(small(sizes), "corpus").join(small(ok), ["corpus", "key"], "left")
    return joined.withColumn("kept", (F.col("n_docs") < 2) | F.col("_ok").isNotNull() | (F.col("key") == "")).drop("_ok", "n_docs")


def clear_field_results(pieces: DataFrame) -> DataFrame:
    """The shown result of each outermost field emptied and its begin marked dirty.

    ``pieces``: doc, idx, seq, piece (begin | separate | end | text | instr), text. Windows per paragraph.
    """
    here = Window.partitionBy("doc", "idx").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.when(F.col("piece") == "begin", 1).when(F.col("piece") == "end", -1).otherwise(0)).over(here)
    work = pieces.withColumn("depth", depth)
    last = F.last(F.when((F.col("piece").isin("begin", "separate", "end")) & (F.col("depth") == F.when(F.col("piece") == "end", 0).otherwise(1)), F.col("piece")), ignorenulls=True).over(here)
    inside = (F.col("piece") == "text") & (F.col("depth") >= 1) & (F.col("_last") == "separate")
    return work.withColumn("_last", last).withColumn("cleared", inside & (F.coalesce("text", F.lit("")) != "")).withColumn(
        "text", F.when(F.col("cleared"), "").otherwise(F.col("text"))).withColumn(
        "dirty", (F.col("piece") == "begin") & (F.col("depth") == 1)).drop("_last", "depth")


def scrub_properties(props: DataFrame) -> DataFrame:
    """Custom values emptied (names stay), personal ones emptied, content summaries dropped.

    ``props``: doc, source (core | custom | extended), name, value.
    """
    gone = (F.col("source") == "extended") & F.col("name").isin(APP_CONTENT)
    wiped = (F.col("source") == "custom") | F.col("name").isin(PERSONAL)
    return props.withColumn("action", F.when(gone, "dropped").when(wiped & (F.trim(F.coalesce("value", F.lit(""))) != ""), "cleared").otherwise("kept")).withColumn(
        "value", F.when(F.col("action") != "kept", "").otherwise(F.col("value")))


def identities(props: DataFrame) -> DataFrame:
    """Names that labelled a document and were removed."""
    return props.where(F.col("name").isin(IDENTITY) & (F.length(F.trim("value")) > 2)).select("doc", F.trim("value").alias("identity")).distinct()


def drop_payload(parts: DataFrame) -> DataFrame:
    """Parts that are payload by type or by place. ``parts``: doc, part, reltype."""
    tree = F.lit(False)
    for prefix in DATA_TREES:
        tree = tree | F.startswith("part", F.lit(prefix))
    bad = ~F.endswith("part", F.lit(".rels")) & (tree | F.col("part").isin(DATA_FILES) | F.coalesce(F.col("reltype").isin(DATA_TYPES), F.lit(False)))
    return parts.withColumn("dropped", bad)


# Notes that are furniture, not content.
STRUCTURAL_NOTES = ["separator", "continuationSeparator", "continuationNotice"]


def unreferenced_notes(notes: DataFrame, refs: DataFrame) -> DataFrame:
    """Notes nothing refers to. ``notes``: doc, kind (footnote or endnote), note_id, note_type; ``refs``: doc, kind, note_id.

    Each kind counts its own ids; structural notes and ids below one always stay.
    """
    loose = notes.where(~F.coalesce(F.col("note_type").isin(STRUCTURAL_NOTES), F.lit(False)) & (F.col("note_id") > 0))
    return loose.join(refs.select("doc", "kind", "note_id").distinct(), ["doc", "kind", "note_id"], "left_anti")


def prune_rels(rels: DataFrame, used: DataFrame) -> DataFrame:
    """Content relationships no attribute uses go; the others stay."""
    alive = used.select("doc", "source_part", "rid").distinct().withColumn("_u", F.lit(True))
    return rels.join(alive, ["doc", "source_part", "rid"], "left").withColumn(
        "dropped", F.col("_u").isNull() & F.col("reltype").isin(PRUNABLE)).drop("_u")


def orphan_media(parts: DataFrame, kept_rels: DataFrame) -> DataFrame:
    """Media and embeddings no remaining internal relationship reaches."""
    media = parts.where("part like 'word/media/%' or part like 'word/embeddings/%'")
    reach = kept_rels.where("not external").select("doc", F.col("target").alias("part")).distinct()
    return media.join(reach, ["doc", "part"], "left_anti")


def identity_survivors(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Removed names that still occur, as substrings, in kept text; reported, never deleted.

    A name is met through its first three characters: texts are cut into distinct trigrams, which
    join the names by equality, and only those pairs are tested.
    """
    heads = names.select(F.col("identity"), F.substring("identity", 1, 3).alias("tri")).distinct()
    every = F.array_distinct(F.regexp_extract_all("text", F.lit("(?s)(?=(.{3}))"), F.lit(1)))
    grams = texts.select("doc", "part", "text", F.explode(every).alias("tri"))
    return grams.join(small(heads), "tri").where(F.contains("text", F.col("identity"))).select("doc", "part", "identity").distinct()


def scrub(attrs: DataFrame) -> DataFrame:
    """Session ids and hostile elements of a shredded package, counted by kind.

    ``attrs``: doc, part, element, attr (null for an element row), value.
    """
    kind = F.when(F.col("attr").isin(SESSION_ATTRS), "editing-session ids")
    for name, elements in SCRUB_ELEMENTS.items():
        kind = kind.when(F.col("attr").isNull() & F.col("element").isin(elements), name)
    return attrs.withColumn("kind", kind)


def scrub_counts(scrubbed: DataFrame) -> DataFrame:
    return scrubbed.where("kind is not null").groupBy("doc", "kind").agg(F.count(F.lit(1)).alias("n"))


def redaction_report(counts: DataFrame) -> DataFrame:
    """Totals per document from ``(doc, what, n)`` rows."""
    return counts.groupBy("doc").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("what", "n"))).alias("parts")).select(
        "doc", "total", F.when(F.col("total") == 0, "the exemplar carried no content of its own").otherwise(F.concat(
            F.lit("removed "), F.array_join(F.transform(F.filter("parts", lambda p: p["n"] > 0), lambda p: F.concat(p["n"].cast("string"), F.lit(" "), p["what"])), ", "))).alias("summary"))


def kept_notes(parts: DataFrame) -> DataFrame:
    """Parts kept on purpose that a person might still want gone."""
    what = F.lit(None).cast("string")
    for part, text in KEPT_ON_PURPOSE.items():
        what = F.when(F.col("part") == part, text).otherwise(what)
    return parts.withColumn("what", what).where("what is not null").select("doc", "part", "what")
