"""Exact duplicates by deterministic block naming.

Every document loses its white space and is cut into blocks of a fixed number of bytes. Equal blocks
get one integer name, given in sort order; then adjacent names are paired and each distinct pair is
named again, level by level, until a document has one name. Two documents are equal exactly when
they end at the same level with the same name: names stand for content, so nothing can collide.

Blocks are gathered under a 64-bit fingerprint, reduced on the map side to the least and the greatest
block of each fingerprint. Where the two differ, the fingerprint is shared by different contents and
its blocks are named by their full bytes instead; everywhere else the comparison has just proved that
fingerprint and content are the same thing, so only numbers travel from there on.

Defined cases: null and white-space-only texts are the empty content and equal each other; a text of
any length is cut to its end; repeated rows (same id, same text) are separate members of a group and
the first row read stays; a null ``doc_id`` sorts before all others; an empty table gives an empty
result; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.common import SPACE_BYTES, documents, fresh, rounds_for, settle, sorted_ids, with_rows

NAME = "op10_exact_block_naming"
BLOCK_BYTES = 4096

ORACLE = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents),
n AS (SELECT doc_id, length(text) AS len, sha256(norm) AS text_sha256, norm FROM t)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS kept,
       text_sha256
FROM n
"""

_CUT_SCHEMA = "row long, doc_id long, n_points long, sha string, n_blocks int, idx int, print long, block binary"


def _cut(block_bytes: int):
    def run(batches):
        for batch in batches:
            rows = {k: [] for k in ("row", "doc_id", "n_points", "sha", "n_blocks", "idx", "print", "block")}
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = text or ""
                data = text.encode("utf-8", "surrogatepass").translate(None, SPACE_BYTES)
                n = max(1, -(-len(data) // block_bytes))
                sha = hashlib.sha256(data).hexdigest()
                for i in range(n):
                    block = data[i * block_bytes: (i + 1) * block_bytes]
                    first = i == 0  # document-level values ride on the first block only
                    for k, v in zip(rows, (row, doc if first else None, len(text) if first else None, sha if first else None, n, i,
                                           xxhash.xxh3_64_intdigest(block) - (1 << 63), block)):
                        rows[k].append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in zip(rows, types)], list(rows))

    return run


def cut_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Written table of blocks: one row per block, the document's own values on block 0."""
    return settle(docs.mapInArrow(_cut(block_bytes), _CUT_SCHEMA))


def name_blocks(blocks: DataFrame) -> DataFrame:
    """``(row, idx, name)``: an integer per distinct block content, in sort order."""
    prints = settle(blocks.groupBy("print").agg(F.min("block").alias("least"), F.max("block").alias("most"))
                    .select("print", (F.col("least") == F.col("most")).alias("pure")))
    pure = prints.where("pure").select("print", F.lit(None).cast("binary").alias("block"))
    shared = prints.where(~F.col("pure")).select("print")
    several = not shared.isEmpty()  # then, and only then, blocks travel a second time
    if several:
        pure = pure.unionByName(blocks.join(shared, "print", "left_semi").select("print", "block").distinct())
    names = sorted_ids(pure, ["print", "block"], "name")
    by_print = names.where("block is null").select("print", "name")
    by_bytes = names.where("block is not null").select("print", "block", F.col("name").alias("own_name"))
    one = blocks.select("row", "idx", "print").join(by_print, "print", "left").where("name is not null").select("row", "idx", "name")
    if not several:
        return settle(one)
    other = blocks.join(by_bytes, ["print", "block"]).select("row", "idx", F.col("own_name").alias("name"))
    return settle(one.unionByName(other))


def pair_up(named: DataFrame) -> DataFrame:
    """One level: names two by two, each distinct pair named in sort order; a last odd name pairs with -1."""
    pairs = named.groupBy("row", (F.col("idx") / 2).cast("int").alias("idx")).agg(
        F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
    names = sorted_ids(pairs.select("left", "right").distinct(), ["left", "right"], "name")
    return settle(pairs.join(names, ["left", "right"]).select("row", "idx", "name"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(row, doc_id, n_points, sha, level, name)`` for ``docs(row, doc_id, text)``; ``row`` is unique."""
    blocks = cut_blocks(docs, block_bytes)
    heads = blocks.where("idx = 0").select("row", "doc_id", "n_points", "sha", "n_blocks")
    most = heads.agg(F.max("n_blocks")).first()[0] or 1
    named = name_blocks(blocks.select("row", "idx", "print", "block"))
    sizes = heads.select("row", "n_blocks")
    done = []
    for level in range(rounds_for(most) + 1):
        left = F.ceil(F.col("n_blocks") / F.lit(float(2 ** level)))
        if level:
            before = F.ceil(F.col("n_blocks") / F.lit(float(2 ** (level - 1))))
            going = named.join(sizes.where(before > 1).select("row"), "row", "left_semi")
            named = pair_up(going)
            sizes_here = sizes.where((left == 1) & (before > 1))
        else:
            sizes_here = sizes.where(left == 1)
        done.append(named.join(sizes_here.select("row"), "row", "left_semi").select("row", F.lit(level).alias("level"), "name"))
    names = done[0]
    for part in done[1:]:
        names = names.unionByName(part)
    return heads.join(names, "row")


def groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(row, doc_id, keep_row, keep_id, group_size, kept, text_sha256)`` for ``docs(row, doc_id, text)``.

    The row with the most code points stays, then the smallest ``doc_id``, then the first row read.
    Groups are counted with map-side partials; no group is gathered anywhere.
    """
    known = settle(identities(docs, block_bytes))
    best = known.groupBy("level", "name").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id"), F.col("row"))).alias("best"))
    return known.join(best, ["level", "name"]).select(
        "row", "doc_id", F.col("best.row").alias("keep_row"), F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def keyed(docs: DataFrame) -> DataFrame:
    """The two columns that are read, and the number of each row."""
    return with_rows(docs.select("doc_id", "text"), "row").select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def drop_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, with all its columns, without the rows whose content another row keeps."""
    row = fresh(docs, "row_no")
    rows = with_rows(docs, row)
    kept = groups(rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), block_bytes)
    return rows.join(kept.where("kept").select(F.col("row").alias(row)), row, "left_semi").drop(row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(keyed(documents(spark, sf_dir))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
