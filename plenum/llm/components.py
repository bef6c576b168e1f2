"""Connected components of links between long ids: union-find inside partitions, stars between them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import settle

_PIECE = 1_000_000  # links that one union-find holds before it hands on its forest


def _forest(batches):
    """Links of one partition reduced to ``(node, root)``; a forest says the same with fewer links."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    def out():
        pairs = [(x, find(x)) for x in root]
        pairs = [p for p in pairs if p[0] != p[1]]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                low, high = min(x, y), max(x, y)
                root[high] = low
                root.setdefault(low, low)
        if len(root) > _PIECE:
            yield out()
    if root:
        yield out()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star operation on links with ``a > b``: every node points its larger (smaller) neighbours to the least one."""
    if large:
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ends = links
    least = ends.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = ends.join(least, "a")
    if large:
        new = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return new.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the least node of its component.

    The alternation ends when the links stop changing; each round is written, so no plan grows and a lost
    executor costs one round. A node's neighbours are never gathered: least neighbours come from map-side
    partial minima, and the join back to the links can be split where one node has many.
    """
    now = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_forest, "a long, b long"))
    mark = None
    while True:
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == mark:
            break
        mark = (n, total)
        now = settle(_star(_star(now, True), False))
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
