"""Lining up the documents of a corpus into shared columns.

Alignment is keyed, not pairwise: a token most documents share anchors a column, and what lies
between two anchors is matched by kind and order inside the gap. Sections of more than ``MAX_GAP``
blocks in any document are free content: their rows stay, without a column, and a warning names them.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions import keys as K
from plenum.skew import pieces, settle, small

# Fixed values
MAX_GAP = 300
PRESENT = 0.75
OPTIONAL = 0.40
ANCHOR_SHARE = 0.5  # share of documents a body token needs to anchor a column
BACKBONE_SHARE = 0.9  # share of documents an anchor needs to part one gap from the next


def items(classified: DataFrame) -> DataFrame:
    """Non-empty body paragraphs and cells as ``(doc, pos, section, kind, key, text, ...)``.

    ``section`` counts the headings so far minus one (-1 = before the first).
    """
    heading = F.col("level").isNotNull()
    kind = (
        F.when(F.col("ctx_kind") == "table", F.format_string("cell:%d:%d:%d", "table_depth", "row", "col"))
        .when(heading, F.concat(F.lit("h"), F.col("level").cast("string"))).otherwise(F.col("role")))
    key = F.when(heading, K.heading_key(F.col("text"))).otherwise(F.lower(K.match_key(F.col("text"))))
    keep = classified.where("kind = 'p' and ctx_kind in ('body', 'table') and not is_empty and role <> 'empty'")
    out = keep.select("doc", F.col("idx").alias("pos"), kind.alias("kind"), key.alias("key"), "text",
                      "sdt_tag", heading.alias("is_heading"))
    return sections(out)


def sections(rows: DataFrame) -> DataFrame:
    so_far = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", (F.count(F.when(F.col("is_heading"), 1)).over(so_far) - 1).cast("int"))


def token_profile(rows: DataFrame) -> DataFrame:
    """Token counts per document with the document's length."""
    counts = rows.groupBy("corpus", "doc", "kind", "key").agg(F.count(F.lit(1)).alias("n"))
    length = rows.groupBy("corpus", "doc").agg(F.count(F.lit(1)).alias("len"))
    return counts.join(length, ["corpus", "doc"])


def similarity(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``2 * shared tokens / total tokens`` for the requested ``(corpus, a, b)`` pairs.

    The multiset overlap is an upper bound of a ratio that minds the order.
    """
    t = token_profile(rows)
    ta = t.select("corpus", F.col("doc").alias("a"), "kind", "key", F.col("n").alias("na"))
    tb = t.select("corpus", F.col("doc").alias("b"), "kind", "key", F.col("n").alias("nb"))
    common = pairs.join(ta, ["corpus", "a"]).join(tb, ["corpus", "b", "kind", "key"]).groupBy("corpus", "a", "b").agg(
        F.sum(F.least("na", "nb")).alias("shared"))
    length = rows.groupBy("corpus", "doc").agg(F.count(F.lit(1)).alias("len"))
    la = length.select("corpus", F.col("doc").alias("a"), F.col("len").alias("la"))
    lb = length.select("corpus", F.col("doc").alias("b"), F.col("len").alias("lb"))
    total = F.coalesce("la", F.lit(0)) + F.coalesce("lb", F.lit(0))
    return (
        pairs.join(la, ["corpus", "a"], "left").join(lb, ["corpus", "b"], "left").join(common, ["corpus", "a", "b"], "left")
        .select("corpus", "a", "b", F.when(total == 0, 1.0).otherwise(
            2 * F.coalesce("shared", F.lit(0)) / total).alias("similarity")))


def medoid_scores(rows: DataFrame) -> DataFrame:
    """Sum of similarities of each document to all others, without forming pairs.

    Documents enter a token's sum only through (count, length), so each token compares its distinct
    (count, length) classes, whose number does not grow with the corpus.
    """
    t = token_profile(rows)
    classes = t.groupBy("corpus", "kind", "key", "n", "len").agg(F.count(F.lit(1)).alias("docs"))
    other = classes.select("corpus", "kind", "key", F.col("n").alias("n2"), F.col("len").alias("len2"), F.col("docs").alias("docs2"))
    gain = (
        classes.join(other, ["corpus", "kind", "key"])
        .groupBy("corpus", "kind", "key", "n", "len")
        .agg(F.sum(F.col("docs2") * 2 * F.least("n", "n2") / (F.col("len") + F.col("len2"))).alias("gain")))
    # a document's similarity to itself (one) is part of the sum and taken out
    return t.join(gain, ["corpus", "kind", "key", "n", "len"]).groupBy("corpus", "doc").agg(
        F.round(F.sum("gain") - 1, 9).alias("score"))


def medoid(rows: DataFrame) -> DataFrame:
    """The document most like all others; ties go to the smallest id."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("doc")))
    return medoid_scores(rows).groupBy("corpus").agg(best.alias("m")).select(
        "corpus", F.col("m.doc").alias("doc"), (-F.col("m.s")).alias("score"))


def wide_sections(rows: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Sections too long to align in at least one document."""
    size = rows.groupBy("corpus", "section", "doc").agg(F.count(F.lit(1)).alias("n"))
    return size.groupBy("corpus", "section").agg(F.max("n").alias("widest")).where(F.col("widest") > max_gap)


def _counted(rows: DataFrame, parts: int) -> DataFrame:
    """Rows with ``occ`` (which of its equals in the document) and ``rn`` (place in the document)."""
    in_key = Window.partitionBy("corpus", "section", "doc", "kind", "key").orderBy("pos")
    flow = Window.partitionBy("corpus", "section", "doc").orderBy("pos")
    # one partitioning by document serves both windows
    return rows.repartition(parts, "corpus", "section", "doc").withColumn("rn", F.row_number().over(flow)).withColumn("occ", F.row_number().over(in_key))


def _anchors(rows: DataFrame, totals: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows with ``occ``, ``rn``, and ``anchor`` and ``backbone`` where their token anchors a column.

    Anchors are met by all documents: they are joined as a table of few rows, so that no anchor's rows are gathered.
    """
    counted = settle(_counted(rows, parts or pieces(rows.sparkSession, rows.count())))
    share = counted.groupBy("corpus", "section", "kind", "key", "occ", "is_heading").agg(F.count(F.lit(1)).alias("n"))
    anchors = settle(
        share.join(totals, "corpus")
        .where((F.col("n") >= 2) & (F.col("is_heading") | (F.col("n") >= ANCHOR_SHARE * F.col("n_docs"))))
        .select("corpus", "section", "kind", "key", "occ", F.concat_ws("|", F.lit("k"), "kind", "key", F.col("occ").cast("string")).alias("anchor"),
                (F.col("n") >= BACKBONE_SHARE * F.col("n_docs")).alias("backbone")))
    return counted.join(small(anchors), ["corpus", "section", "kind", "key", "occ"], "left")


def _gap(flag, value):
    """Of the rows before this one in its document, the last flagged one's value."""
    before = Window.partitionBy("corpus", "section", "doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(flag, value), ignorenulls=True).over(before)


def column_order(marked: DataFrame) -> DataFrame:
    """The order of a section's anchors, ``(corpus, section, anchor, ord)``.

    Backbone anchors stand by their mean place in the documents, the others behind the backbone anchor they follow in
    most documents, by their mean distance from it.
    """
    by = ["corpus", "section", "anchor"]
    live = marked.where("anchor is not null")
    spine = live.where("backbone").groupBy(*by).agg(F.round(F.sum("rn") / F.count(F.lit(1)), 6).alias("at"))
    behind = live.withColumn("gap", _gap(F.col("backbone"), F.col("anchor"))).withColumn("off", F.col("rn") - F.coalesce(_gap(F.col("backbone"), F.col("rn")), F.lit(0)))
    behind = behind.where("not backbone").groupBy(*by, "gap").agg(F.count(F.lit(1)).alias("n"), F.sum("off").alias("off"))
    usual = behind.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.coalesce("gap", F.lit("")).alias("gap"), "off")).alias("m")).select(
        *by, F.col("m.gap").alias("gap"), F.round(-F.col("m.off") / F.col("m.n"), 6).alias("off"))
    placed = usual.join(spine.withColumnRenamed("anchor", "gap"), ["corpus", "section", "gap"], "left").select(*by, F.coalesce("at", F.lit(0.0)).alias("at"), "gap", "off")
    every = placed.unionByName(spine.select(*by, "at", F.col("anchor").alias("gap"), F.lit(0.0).alias("off")))
    return every.select(*by, F.row_number().over(Window.partitionBy("corpus", "section").orderBy("at", "gap", "off", "anchor")).alias("ord"))


def _rising(batches):
    """Of each document's anchors in order, the places of a longest sequence that keeps to the columns' order (by patience)."""
    for batch in batches:
        out: dict[tuple, list] = {}
        for corpus, section, doc, line in zip(*(batch.column(i).to_pylist() for i in range(4))):
            tails, piles, before = [], [], []
            for i, x in enumerate(line):
                at = bisect_left(tails, x["ord"])
                tails[at:at + 1], piles[at:at + 1] = [x["ord"]], [i]
                before.append(piles[at - 1] if at else None)
            i = piles[-1]
            while i is not None:
                out.setdefault((corpus, section, doc), []).append(line[i]["pos"])
                i = before[i]
        columns = [pa.array([k[i] for k in out], pa.string()) for i in range(3)] + [pa.array(list(out.values()), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["corpus", "section", "doc", "kept"])


def align(rows: DataFrame, totals: DataFrame, max_gap: int | None = MAX_GAP, parts: int | None = None) -> DataFrame:
    """I4: adds ``col`` to every item; it is null for the items of sections too wide to align (free content).

    A token that most documents share anchors a column. The anchors of a section have one order, and a document
    keeps to the longest run of its anchors that follows it: anchors that cross others, as those of swapped blocks do,
    are matched like any other block, by kind and order inside their gap. Gaps lie between anchors that nearly all
    documents share: a block that some documents lack does not move what follows it into another gap.

    ``rows``: corpus, section (string), doc, pos, kind, key, is_heading; ``totals``: corpus, n_docs.
    ``parts``: tasks the documents are dealt over (by default from the number of rows).
    """
    parts = parts or pieces(rows.sparkSession, rows.count())
    narrow, free = rows, None
    if max_gap is not None:
        wide = settle(wide_sections(rows, max_gap).select("corpus", "section"))
        if not wide.isEmpty():
            wide = small(wide)
            narrow, free = rows.join(wide, ["corpus", "section"], "left_anti"), rows.join(wide, ["corpus", "section"], "left_semi")
    marked = _anchors(narrow, totals, parts)
    live = settle(marked.where("anchor is not null").select("corpus", "section", "doc", F.col("pos").cast("bigint").alias("pos"), "rn", "anchor", "backbone")).repartition(parts, "corpus", "section", "doc")
    order = settle(column_order(live))
    runs = live.join(small(order), ["corpus", "section", "anchor"])
    # one document's anchors: from one source row, and of one section; only lines that cross are searched
    before = Window.partitionBy("corpus", "section", "doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    crossed = runs.withColumn("_high", F.max("ord").over(before)).groupBy("corpus", "section", "doc").agg(
        F.bool_or(F.col("_high") > F.col("ord")).alias("crosses"), F.array_sort(F.collect_list(F.struct("pos", "ord"))).alias("line")).where("crosses").drop("crosses")
    kept = crossed.mapInArrow(_rising, "corpus string, section string, doc string, kept array<bigint>")
    held = marked.drop("rn").repartition(parts, "corpus", "section", "doc").join(kept, ["corpus", "section", "doc"], "left").withColumn(
        "anchor", F.when(F.col("doc").isNotNull() & F.col("pos").isNotNull() & (F.col("kept").isNull() | F.array_contains("kept", F.col("pos").cast("bigint"))), F.col("anchor")))
    placed = held.withColumn("gap", F.coalesce(_gap(F.col("backbone") & F.col("anchor").isNotNull(), F.col("anchor")), F.lit("start")))
    loose = Window.partitionBy("corpus", "section", "doc", "gap", "kind", F.col("anchor").isNull()).orderBy("pos")
    found = placed.withColumn("nth", F.row_number().over(loose)).select(
        *rows.columns, F.coalesce("anchor", F.concat_ws("|", F.lit("g"), "gap", "kind", F.col("nth").cast("string"))).alias("col"))
    return found if free is None else found.unionByName(free.withColumn("col", F.lit(None).cast("string")))


def skeleton_warnings(rows: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """What the alignment leaves free, as warnings ``(corpus, section, widest, message)``."""
    return wide_sections(rows, max_gap).select("corpus", "section", "widest", F.concat(
        F.lit("section "), "section", F.lit(" holds "), F.col("widest").cast("string"), F.lit(" blocks in one document and stays free content")).alias("message"))


def two_tier(rows: DataFrame, totals: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Headings first; bodies only meet inside the same heading column ('' = before the first).

    Returns items with ``section`` replaced by the heading column and ``col``; heading rows carry
    their own column as section.
    """
    parts = pieces(rows.sparkSession, rows.count())
    heads = align(rows.where("is_heading").withColumn("_sec", F.col("section")).withColumn("section", F.lit("headings")), totals, None, parts)
    heads = settle(heads.withColumn("section", F.col("col")))
    names = heads.select("corpus", "doc", "_sec", F.col("col").alias("_head"))
    bodies = (
        rows.where("not is_heading").withColumn("_sec", F.col("section")).repartition(parts, "corpus", "doc", "_sec")
        .join(names, ["corpus", "doc", "_sec"], "left")
        .withColumn("section", F.coalesce("_head", F.lit(""))).drop("_head"))
    return align(bodies, totals, max_gap, parts).unionByName(heads).drop("_sec")


def column_stats(aligned: DataFrame, totals: DataFrame) -> DataFrame:
    """Occupancy, modal token, token agreement, place of each column; free content has no column."""
    by = ["corpus", "section", "col"]
    tokens = aligned.where("col is not null").groupBy(*by, "kind", "key", "is_heading").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos"))
    top = F.min(F.struct((-F.col("n")).alias("neg"), F.col("kind"), F.col("key"))).alias("m")
    stats = tokens.groupBy(*by).agg(top, F.sum("n").alias("members"), F.sum("pos").alias("pos"), F.bool_or("is_heading").alias("is_heading"))
    return stats.join(totals, "corpus").select(
        *by, "is_heading", "members", (F.col("members") / F.col("n_docs")).alias("occupancy"),
        F.col("m.kind").alias("modal_kind"), F.col("m.key").alias("modal_key"),
        (-F.col("m.neg") / F.col("members")).alias("agreement"), F.round(F.col("pos") / F.col("members"), 6).alias("place"))


def required_headings(stats: DataFrame) -> DataFrame:
    """I7."""
    return stats.where(F.col("is_heading") & (F.col("occupancy") >= PRESENT))


def _leading(a: str, b: str) -> Column:
    """How many leading words two arrays share."""
    same = f"transform(sequence(1, least(size({a}), size({b}))), i -> get({a}, i - 1) = get({b}, i - 1))"
    return F.expr(f"cast(if(array_position({same}, false) = 0, least(size({a}), size({b})), array_position({same}, false) - 1) as int)")


def _ends(by: list[str]):
    """Per batch and group: number of texts, least and greatest word sequence forwards and backwards, fewest and most words."""
    def reduce(batches):
        for batch in batches:
            out: dict[tuple, list] = {}
            for *key, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.split(" ")
                back, n = words[::-1], len(words)
                e = out.get(key := tuple(key))
                if e is None:
                    out[key] = [1, words, words, back, back, n, n]
                else:
                    out[key] = [e[0] + 1, min(e[1], words), max(e[2], words), min(e[3], back), max(e[4], back), min(e[5], n), max(e[6], n)]
            columns = [pa.array([k[i] for k in out], f.type) for i, f in enumerate(batch.schema) if i < len(by)]
            seen = list(out.values())
            types = [pa.int64()] + [pa.list_(pa.string())] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays(columns + [pa.array([e[i] for e in seen], t) for i, t in enumerate(types)], [*by, "n", "a", "b", "c", "d", "shortest", "longest"])
    return reduce


def frames(values: DataFrame, by: list[str]) -> DataFrame:
    """I8: the words every text of a group opens and closes with, from one aggregation.

    The common prefix of a set of word sequences is the common prefix of its smallest and largest
    member, so ``min``/``max`` over the word arrays replace any gathering. Spark would sort all rows for them; each
    batch of rows is therefore reduced to its groups' ends where it is read, and only these are aggregated.
    """
    live = values.select(*by, K.collapse(F.col("text")).alias("text")).where("text <> ''")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in live.schema if f.name in by)
    schema += ", n bigint, a array<string>, b array<string>, c array<string>, d array<string>, shortest int, longest int"
    ends = live.mapInArrow(_ends(by), schema).groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"), F.min("c").alias("c"), F.max("d").alias("d"),
        F.min("shortest").alias("shortest"), F.max("longest").alias("longest")).where("n >= 2")
    cut = ends.withColumn("n_head", _leading("a", "b")).withColumn(
        "n_tail", F.least(_leading("c", "d"), F.col("shortest") - F.col("n_head")))
    # a frame needs wording, and something (not everywhere nothing) inside it
    return cut.where("(n_head > 0 or n_tail > 0) and longest > n_head + n_tail").select(
        *by, "n_head", "n_tail", F.expr("if(n_head > 0, concat(array_join(slice(a, 1, n_head), ' '), ' '), '')").alias("prefix"),
        F.expr("if(n_tail > 0, concat(' ', array_join(reverse(slice(c, 1, n_tail)), ' ')), '')").alias("suffix"),
        F.expr("a <> b").alias("is_field"))


def split_variable_part(values: DataFrame, by: list[str]) -> DataFrame:
    """I8: one row per document of the groups that have a frame: by..., doc, prefix, suffix, middle, is_field."""
    words = values.withColumn("words", F.split(K.collapse(F.col("text")), " ")).where(K.collapse(F.col("text")) != "")
    middle = F.expr("array_join(slice(words, n_head + 1, greatest(size(words) - n_head - n_tail, 0)), ' ')")
    return words.join(small(settle(frames(values, by))), by).select(*by, "doc", "prefix", "suffix", middle.alias("middle"), "is_field")
