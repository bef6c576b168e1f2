"""Reformatting as table transforms: remapping styles and lists, stripping, grafting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.operators.hierarchy import name_index
from plenum.skew import settle, small

# Fixed values
EMPHASIS = ["b", "bCs", "i", "iCs", "u", "strike", "dstrike"]
SEMANTIC = ["rStyle", "vertAlign", "lang", "rtl", "cs", "em", "eastAsianLayout", "specVanish", "oMath", "noProof"]
FORMAT_PARTS = ["styles", "theme", "fontTable"]


def style_map(source: DataFrame, donor: DataFrame) -> DataFrame:
    """Q1: source style -> exemplar style by (type, name), then by alias in order; null = unmatched."""
    index = name_index(donor).select("type", F.col("name").alias("key"), F.col("style_id").alias("target"))
    own = source.select("doc", "style_id", "type", F.col("name_key").alias("key"), F.lit(-1).alias("p"))
    alias = source.select("doc", "style_id", "type", F.posexplode("aliases").alias("p", "key")).select("doc", "style_id", "type", "key", "p")
    hits = own.unionByName(alias).join(small(index), ["type", "key"], "left")
    return hits.groupBy("doc", "style_id").agg(F.min_by("target", F.when(F.col("target").isNotNull(), F.col("p"))).alias("target"))


def remap_references(refs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Q2: references follow the map; an unmatched character style is dropped, others stay."""
    joined = refs.join(mapping, ["doc", "style_id"], "left")
    return joined.withColumn("new_id", F.when(F.col("target").isNotNull(), F.col("target")).when(F.col("kind") == "rStyle", None).otherwise(F.col("style_id"))).drop("target")


def merge_lists(source: DataFrame, donor: DataFrame) -> DataFrame:
    """Q3: used source lists in the exemplar's numbering.

    ``source``: doc, num_id, signature, numbered; ``donor``: num_id, abstract_id, signature. Bullets with
    a known signature are reused as they are; everything else gets a fresh instance, numbered ones
    restarting, unknown ones a fresh definition. New ids continue after the largest in use, in
    (num_id) order per document.
    """
    known = donor.groupBy("signature").agg(F.min(F.struct("num_id", "abstract_id")).alias("d"))
    top = donor.agg(F.max("num_id").alias("top_num"), F.max("abstract_id").alias("top_abs"))
    one = top.withColumn("k", F.lit(1))
    j = source.join(small(known), "signature", "left").withColumn("k", F.lit(1)).join(F.broadcast(one), "k")
    reuse = F.col("d").isNotNull() & ~F.col("numbered")
    fresh = F.col("d").isNull()
    order = Window.partitionBy("doc").orderBy("num_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    nth = F.count(F.when(~F.col("reused"), 1)).over(so_far)
    nth_abs = F.count(F.when(F.col("fresh"), 1)).over(so_far)
    return j.withColumn("reused", reuse).withColumn("fresh", fresh).select(
        "doc", "num_id", F.when(F.col("reused"), F.col("d.num_id")).otherwise(F.col("top_num") + nth).alias("new_num"),
        F.when(F.col("fresh"), F.col("top_abs") + nth_abs).otherwise(F.col("d.abstract_id")).alias("new_abstract"),
        F.when(F.col("reused"), "reused").when(F.col("fresh"), "imported").otherwise("restarted").alias("outcome"))


def span_scope(runs: DataFrame) -> DataFrame:
    """Q4: how much of a block each property covers: all, some or none. ``runs``: doc, idx, run_no, props array."""
    n = runs.groupBy("doc", "idx").agg(F.count(F.lit(1)).alias("runs"))
    carrying = runs.select("doc", "idx", "run_no", F.explode(F.array_distinct("props")).alias("prop")).groupBy("doc", "idx", "prop").agg(F.count(F.lit(1)).alias("n"))
    return carrying.join(n, ["doc", "idx"]).select("doc", "idx", "prop", F.when(F.col("n") == F.col("runs"), "all").otherwise("some").alias("scope"))


def strip_runs(runs: DataFrame) -> DataFrame:
    """Q4: meaning stays, emphasis stays only on part of a block, every other property goes."""
    some = span_scope(runs).where("scope = 'some'").where(F.col("prop").isin(EMPHASIS)).groupBy("doc", "idx").agg(F.collect_set("prop").alias("some"))
    joined = runs.join(some, ["doc", "idx"], "left")
    allowed = F.coalesce("some", F.array().cast("array<string>"))
    keep = F.filter("props", lambda p: p.isin(SEMANTIC) | F.array_contains(F.col("allowed"), p))
    return joined.withColumn("allowed", allowed).withColumn("kept", keep).drop("some", "allowed")


def strip_paragraphs(blocks: DataFrame) -> DataFrame:
    """Q5: paragraph properties reduced to what is kept: section and page breaks, tabs if used, numbering if asked.

    ``blocks``: doc, idx, text, ppr map, numbered.
    """
    def kept(k, v):
        return k.isin("sectPr", "pageBreakBefore") | ((k == "tabs") & F.contains(F.col("text"), F.lit("\t"))) | ((k == "numPr") & F.col("numbered"))
    return blocks.withColumn("kept", F.map_filter("ppr", kept))


def apply_edits(blocks: DataFrame, edits: DataFrame, low_confidence: str = "keep") -> DataFrame:
    """Q6: edits on their blocks; unsure ones are kept as they were (or applied) and commented on.

    ``edits``: doc, idx, new_style, needs_review, role, confidence.
    """
    j = blocks.join(edits, ["doc", "idx"], "left")
    go = F.col("new_style").isNotNull() & (~F.col("needs_review") | F.lit(low_confidence == "apply"))
    return j.withColumn("applied", F.coalesce(go, F.lit(False))).withColumn("style_name", F.when(F.col("applied"), F.col("new_style")).otherwise(F.col("style_name"))).withColumn(
        "comment", F.when(F.coalesce("needs_review", F.lit(False)), F.format_string("read as %s (%s%% sure)", "role", F.rint(F.col("confidence") * 100).cast("bigint").cast("string")))).drop("new_style", "needs_review", "role", "confidence")


def transitive_parts(rels: DataFrame, roots: DataFrame) -> DataFrame:
    """Q7: parts reachable from the roots over internal relationships. ``roots``: doc, part."""
    edges = rels.where("not external").select("doc", F.col("source_part").alias("part"), F.col("target").alias("_to")).distinct()
    seen = front = settle(roots.select("doc", "part").distinct())
    while True:
        step = front.join(edges, ["doc", "part"]).select("doc", F.col("_to").alias("part")).distinct().join(seen, ["doc", "part"], "left_anti")
        front = settle(step)
        if front.isEmpty():
            return seen
        seen = settle(seen.unionByName(front))


def graft(target: DataFrame, donor: DataFrame, donor_rels: DataFrame) -> DataFrame:
    """Q7: the target's parts with format parts, headers and footers (and what they need) from the exemplar.

    ``target``: doc, part, role; ``donor``: part, role (one exemplar). Result: doc, part, role, origin.
    """
    format_roles = FORMAT_PARTS + ["header", "footer"]
    roots = donor.where(F.col("role").isin(format_roles)).select(F.lit("donor").alias("doc"), "part")
    reach = transitive_parts(donor_rels, roots).select("part").distinct()
    carried = small(donor.join(reach, "part").select("part", "role"))
    kept = target.where(~F.col("role").isin(format_roles)).join(carried.select("part"), "part", "left_anti").withColumn("origin", F.lit("target"))
    docs = target.select("doc").distinct().withColumn("k", F.lit(1))
    brought = docs.join(carried.withColumn("k", F.lit(1)), "k").select("doc", "part", "role", F.lit("exemplar").alias("origin"))
    return kept.select("doc", "part", "role", "origin").unionByName(brought)
