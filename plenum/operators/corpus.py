"""Judging a corpus from its votes: outliers, mixtures of two conventions, warnings, best exemplar."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.operators.votes import percent
from plenum.skew import numbered, settle, spread

# Fixed values
OUTLIER_AGREEMENT = 0.60
SPLIT_STRENGTH = 1.5
MIN_CORPUS = 3
SPLIT_MIN_DOCS = 4
W_AGREEMENT, W_STYLES, W_COMPLETENESS, W_DIRECT = 0.45, 0.30, 0.25, 0.60

# Distances are taken between distinct vote vectors, in tiles of so many on a side.
TILE = 250


def agreement_by_document(doc_votes: DataFrame, voted: DataFrame, docs: DataFrame) -> DataFrame:
    """H1: share of a document's votes that went with the corpus; 1.0 for a silent document.

    Every document speaks on a common pointer, so the votes are skewed on (corpus, pointer); the modal
    side has one row per key, which adaptive execution broadcasts or, if it is large, joins in split
    partitions.
    """
    modal = voted.select("corpus", "pointer", F.col("bkey").alias("modal_bkey"))
    spoken = (
        doc_votes.join(modal, ["corpus", "pointer"])
        .groupBy("corpus", "doc")
        .agg(F.avg((F.col("bkey") == F.col("modal_bkey")).cast("double")).alias("agreement"))
    )
    return (
        docs.select("corpus", "doc").distinct().join(spoken, ["corpus", "doc"], "left")
        .select("corpus", "doc", F.coalesce("agreement", F.lit(1.0)).alias("agreement"))
    )


def outliers(agreement: DataFrame) -> DataFrame:
    """H2."""
    return agreement.where(F.col("agreement") < OUTLIER_AGREEMENT)


def vote_vectors(doc_votes: DataFrame) -> DataFrame:
    """Documents grouped by identical vote vectors: ``(corpus, vector, members, profile)``.

    ``vector`` is the smallest document id of the group, ``profile`` the pointer -> bucket map.
    """
    entry = F.struct(F.col("pointer").alias("key"), F.col("bkey").alias("value"))
    profile = doc_votes.groupBy("corpus", "doc").agg(F.array_sort(F.collect_list(entry)).alias("profile"))
    return (
        profile.groupBy("corpus", "profile")
        .agg(F.min("doc").alias("vector"), F.count(F.lit(1)).alias("members"))
        .select("corpus", "vector", "members", F.map_from_entries("profile").alias("profile"))
    )


def distances(vectors: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """H3: share of shared pointers on which two vectors differ (1.0 when nothing is shared).

    For requested ``pairs(corpus, a, b)`` the entries of both sides meet by pointer. Without them the result is the
    upper triangle of the matrix over distinct vectors, computed tile by tile as products of incidence matrices.
    """
    if pairs is None:
        return _blocks(_tiled(vectors)).mapInPandas(_upper, "corpus string, a string, b string, distance double")
    entry = vectors.select("corpus", "vector", F.explode("profile").alias("pointer", "bkey"))
    left = pairs.join(entry.select("corpus", F.col("vector").alias("a"), "pointer", F.col("bkey").alias("ka")), ["corpus", "a"])
    met = left.join(entry.select("corpus", F.col("vector").alias("b"), "pointer", F.col("bkey").alias("kb")), ["corpus", "b", "pointer"])
    counts = met.groupBy("corpus", "a", "b").agg(F.count(F.lit(1)).alias("shared"), F.count(F.when(F.col("ka") != F.col("kb"), 1)).alias("differing"))
    return pairs.join(counts, ["corpus", "a", "b"], "left").select("corpus", "a", "b", F.coalesce(F.col("differing") / F.col("shared"), F.lit(1.0)).alias("distance"))


def _tiled(vectors: DataFrame) -> DataFrame:
    """Written vectors with their ``tile``: alike ones side by side, so that a tile's bounds are tight; none above ``TILE``."""
    order = F.array_join(F.transform(F.array_sort(F.map_entries("profile")), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    placed = numbered(vectors.withColumn("_order", order), ["corpus"], ["_order", "vector"], "_pos")
    return settle(placed.withColumn("tile", F.floor((F.col("_pos") - 1) / F.lit(TILE)).cast("int")).drop("_order", "_pos"))


def _matrix(a, b) -> np.ndarray:
    """Distances between two lists of profiles, from the products of their incidence matrices."""
    def product(marks):
        """How many marks each profile of ``a`` shares with each of ``b``."""
        sides = [[marks(p) for p in side] for side in (a, b)]
        number = {k: i for i, k in enumerate(dict.fromkeys(k for side in sides for p in side for k in p))}
        left, right = (np.zeros((len(side), len(number)), np.float32) for side in sides)
        for out, side in ((left, sides[0]), (right, sides[1])):
            for i, p in enumerate(side):
                out[i, [number[k] for k in p]] = 1
        return (left @ right.T).astype(np.float64)

    shared, equal = product(lambda p: list(p)), product(lambda p: list(p.items()))
    return np.where(shared > 0, (shared - equal) / np.maximum(shared, 1), 1.0)


_BLOCK = "corpus string, tile_a int, tile_b int, names_a array<string>, names_b array<string>, members_a array<long>, members_b array<long>, block binary"


def _block(key: Any, pdf: pd.DataFrame) -> pd.DataFrame:
    """One tile of the distance matrix, in both orientations where it is not on the diagonal."""
    corpus, tile_a, tile_b = key
    side = [pdf[pdf.tile == t].sort_values("vector") for t in (tile_a, tile_b)]
    d = _matrix(list(side[0].profile), list(side[1].profile))
    if tile_a == tile_b:
        np.fill_diagonal(d, 0.0)
    rows = [(corpus, tile_a, tile_b, *(list(s.vector) for s in side), *(list(s.members) for s in side), d.tobytes())]
    if tile_a != tile_b:
        rows.append((corpus, tile_b, tile_a, *(list(s.vector) for s in side[::-1]), *(list(s.members) for s in side[::-1]), np.ascontiguousarray(d.T).tobytes()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _BLOCK.split(", ")])


def _blocks(tiled: DataFrame) -> DataFrame:
    """All blocks of the distance matrices, dealt out by (corpus, tile, tile): no key holds a corpus."""
    tiles = tiled.groupBy("corpus").agg((F.max("tile") + 1).alias("tiles"))
    met = tiled.join(tiles, "corpus").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = met.select("corpus", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"), "tile", "vector", "members", "profile")
    return dealt.groupBy("corpus", "tile_a", "tile_b").applyInPandas(_block, _BLOCK)


def _square(row) -> np.ndarray:
    return np.frombuffer(row.block, np.float64).reshape(len(row.names_a), len(row.names_b))


def _upper(frames):
    for pdf in frames:
        for row in pdf.itertuples():
            if row.tile_a > row.tile_b:
                continue
            a, b = np.array(row.names_a, object), np.array(row.names_b, object)
            i, j = np.triu_indices(len(a), 1) if row.tile_a == row.tile_b else (x.ravel() for x in np.indices((len(a), len(b))))
            low, high = np.where(a[i] < b[j], a[i], b[j]), np.where(a[i] < b[j], b[j], a[i])
            yield pd.DataFrame({"corpus": row.corpus, "a": low, "b": high, "distance": _square(row)[i, j]})


def split(vectors: DataFrame) -> DataFrame:
    """H4: corpora that are really two conventions."""
    return best_medoids(vectors).where("is_split").drop("is_split")


def _bounds(key: Any, pdf: pd.DataFrame) -> pd.DataFrame:
    """What the vectors of one tile add at least to the cost of any pair of medoids from two tiles."""
    pdf = pdf.sort_values("tile_a")
    least, weight = np.stack(pdf.least.to_numpy()), np.array(pdf.members_b.iloc[0], np.float64)
    i, j = np.triu_indices(len(pdf))
    tiles = pdf.tile_a.to_numpy()
    return pd.DataFrame({"corpus": key[0], "tile_a": tiles[i], "tile_b": tiles[j], "part": [float(np.minimum(least[x], least[y]) @ weight) for x, y in zip(i, j)]})


def _least(frames):
    for pdf in frames:
        yield pd.DataFrame({"corpus": pdf.corpus, "tile_a": pdf.tile_a, "tile_c": pdf.tile_b, "members_b": pdf.members_b, "least": [_square(r).min(axis=0) for r in pdf.itertuples()]})


def _costs(frames):
    """Rows sorted by pair of tiles: adds up the cost of every pair of medoids block by block, keeps the best of each pair of tiles."""
    key, cost, names = None, None, None

    def best():
        a, b = names
        i, j = np.triu_indices(len(a), 1) if key[1] == key[2] else (x.ravel() for x in np.indices((len(a), len(b))))
        if not len(i):  # a lone vector
            return
        of = np.round(cost[i, j], 9)
        i, j, low = i[of == of.min()], j[of == of.min()], of.min()
        pair = min((min(a[x], b[y]), max(a[x], b[y])) for x, y in zip(i, j))
        yield pd.DataFrame({"corpus": [key[0]], "cost": [low], "medoid_a": [pair[0]], "medoid_b": [pair[1]]})

    for pdf in frames:
        for r in pdf.itertuples():
            if key != (r.corpus, r.tile_a, r.tile_b):
                if key is not None:
                    yield from best()
                key, names, cost = (r.corpus, r.tile_a, r.tile_b), (r.names_a, r.names_b), np.zeros((len(r.names_a), len(r.names_b)))
            weight = np.array(r.members_c, np.float64)
            a, b = (np.frombuffer(x, np.float64).reshape(len(n), len(weight)) for x, n in ((r.block_a, r.names_a), (r.block_b, r.names_b)))
            for i in range(len(a)):
                cost[i] += np.minimum(a[i], b) @ weight
    if key is not None:
        yield from best()


def _pair_costs(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """The best pair of medoids ``(corpus, cost, medoid_a, medoid_b)`` of each pair of tiles."""
    side = lambda x: blocks.select("corpus", F.col("tile_a").alias(f"tile_{x}"), F.col("tile_b").alias("tile_c"), F.col("names_a").alias(f"names_{x}"), F.col("block").alias(f"block_{x}"))
    weight = blocks.where("tile_a = 0").select("corpus", F.col("tile_b").alias("tile_c"), F.col("members_b").alias("members_c"))
    met = pairs.join(side("a"), ["corpus", "tile_a"]).join(side("b"), ["corpus", "tile_b", "tile_c"]).join(weight, ["corpus", "tile_c"])
    keys = ["corpus", "tile_a", "tile_b"]
    dealt = met.select(*keys, "tile_c", "names_a", "names_b", "members_c", "block_a", "block_b").repartition(*keys).sortWithinPartitions(*keys, "tile_c")
    return dealt.mapInPandas(_costs, "corpus string, cost double, medoid_a string, medoid_b string")


def _means(frames):
    """Of one block above the diagonal: distances and numbers of pairs, within the two groups and between them."""
    for pdf in frames:
        out = []
        for r in pdf.itertuples():
            weight = np.outer(np.array(r.members_a, np.float64), np.array(r.members_b, np.float64))
            if r.tile_a == r.tile_b:
                weight = np.triu(weight, 1)
            same = np.equal.outer(np.array(r.in_a, bool), np.array(r.in_b, bool))
            d = _square(r)
            out.append((r.corpus, (d * weight)[same].sum(), weight[same].sum(), (d * weight)[~same].sum(), weight[~same].sum()))
        yield pd.DataFrame(out, columns=["corpus", "within", "n_within", "between", "n_between"])


# One task searches a corpus of at most so many cells (vectors times pointers, or times pointer sets), pointers and pointer sets.
CELLS, POINTERS, CLASSES = 1 << 21, 64, 128
AT_ONCE = 1 << 20  # numbers that a step of that search holds at once
BLOCKS_A_FILE = 64  # a scan reads thousands of rows of a file at once, and a block has half a megabyte

_FOUND = ("corpus string, medoid_a string, medoid_b string, size_a long, size_b long, twins long, "
          "within double, n_within double, between double, n_between double")


def _codes(profiles) -> np.ndarray:
    """A row per profile and a column per pointer: the number of the bucket, -1 where a profile is silent."""
    columns: dict = {}
    numbers: dict = {}
    cells = [(i, columns.setdefault(k, len(columns)), numbers.setdefault((k, v), len(numbers))) for i, p in enumerate(profiles) for k, v in (p or {None: None}).items()]
    out = np.full((len(profiles), len(columns)), -1, np.int32)
    row, column, code = np.array(cells).T
    out[row, column] = code
    return out


def _classes(codes: np.ndarray, most: int) -> tuple[np.ndarray, list[int]]:
    """Classes of vectors with one pointer set and one bucket on each of the returned pointers, those of fewest buckets; ``most`` at most,
    unless there are more pointer sets."""
    together = lambda marks: np.unique(marks, axis=0, return_inverse=True)[1].reshape(-1)
    of, tail = together(codes >= 0), list(range(codes.shape[1]))
    for p in sorted(tail, key=lambda p: len(np.unique(codes[:, p]))):
        finer = together(np.stack([of, codes[:, p]], 1))
        if finer.max() >= most:
            break
        of = finer
        tail.remove(p)
    return of, [p for p in range(codes.shape[1]) if p not in tail]


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """On how many pointers each row of ``a`` has the bucket of each row of ``b``."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for p in range(a.shape[1]):
        out += (a[:, p, None] == b[None, :, p]) & (a[:, p] >= 0)[:, None]
    return out


def _best_pair(codes: np.ndarray, weight: np.ndarray, names: list[str], most: int) -> tuple[float, str, str, int]:
    """``(cost, medoid_a, medoid_b, pairs that were costed)`` of the pair of least cost; ties go to the smallest names.

    What a vector saves by a medoid is the share of their common pointers on which they agree. Two classes save
    ``least`` on their head pointers alone, whichever of their members are the medoids; a medoid adds to that what it
    saves beyond, counted by classes. The sum is exact but where both medoids go beyond ``least`` for one vector, so that few pairs
    need their cost in full.
    """
    of, head = _classes(codes, most)
    order = np.argsort(of, kind="stable")
    codes, weight, of, names = codes[order], weight[order], of[order], np.array(names, object)[order]
    tail = [p for p in range(codes.shape[1]) if p not in head]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    last, n, k = np.append(first[1:], len(of)), len(of), len(first)
    has = (codes[first] >= 0).astype(np.float64)
    common = np.maximum(has @ has.T, 1)
    alike = _equal(codes[first][:, head], codes[first][:, head]).astype(np.float64)
    in_class, total = np.add.reduceat(weight, first), weight.sum()
    least = np.stack([in_class @ np.maximum(alike[:, [c]] / common[:, [c]], alike / common) for c in range(k)])
    beyond = np.empty((n, k))  # by medoid and class of the other one
    more = np.arange(1, len(tail) + 1)
    step = max(1, AT_ONCE // max(n, k * len(more)))
    for c in range(k):
        gain = np.maximum(0, (alike[:, c, None, None] + more[:, None]) / common[:, c, None, None] - np.maximum(alike[:, [c]] / common[:, [c]], alike / common)[:, None])
        for low in range(first[c], last[c], step):
            rows = slice(low, min(low + step, last[c]))
            agree = _equal(codes[rows][:, tail], codes[:, tail])
            held = [np.add.reduceat(np.where(agree == m, weight, 0.0), first, axis=1) for m in range(1, int(agree.max()) + 1)]
            beyond[rows] = np.stack(held, 2).reshape(len(agree), -1) @ gain[:, :len(held)].reshape(-1, k) if held else 0.0
    most_beyond = np.maximum.reduceat(beyond, first, axis=0)
    upper = np.where(np.tri(k, k=-1, dtype=bool), -np.inf, least + most_beyond + most_beyond.T)
    best, costed = (np.inf, "", ""), 0
    for at in np.argsort(-upper, axis=None, kind="stable"):
        x, y = divmod(int(at), k)
        if upper[x, y] < total - best[0] - 1e-6:
            break
        step = max(1, AT_ONCE // (last[y] - first[y]))
        for low in range(first[x], last[x], step):
            high = min(low + step, last[x])
            saved = least[x, y] + beyond[low:high, y, None] + beyond[None, first[y]: last[y], x]
            if x == y:
                saved[np.arange(first[y], last[y]) <= np.arange(low, high)[:, None]] = -np.inf
            i, j = np.nonzero(saved >= total - best[0] - 1e-6)
            saved = saved[i, j]
            by = np.argsort(-saved, kind="stable")
            i, j, saved = i[by] + low, j[by] + first[y], saved[by]
            done = 0
            while done < len(i) and saved[done] >= total - best[0] - 1e-6:
                a, b = (z[done: done + max(1, min(64, AT_ONCE // n))] for z in (i, j))
                cost = np.round((1 - np.maximum(_equal(codes[a], codes) / common[x][of], _equal(codes[b], codes) / common[y][of])) @ weight, 9)
                best = min(best, min((c, min(p, q), max(p, q)) for c, p, q in zip(cost, names[a], names[b]) if c == cost.min()))
                done += len(a)
                costed += len(a)
    return (*best, costed)


def _searched(key: Any, pdf: pd.DataFrame) -> pd.DataFrame:
    """The whole search of one corpus that fits a task."""
    names, members = list(pdf.vector), pdf.members.to_numpy(np.float64)
    if len(names) < 2:
        return pd.DataFrame(columns=[c.split()[0] for c in _FOUND.split(", ")])
    codes = _codes(list(pdf.profile))
    patterns = len(np.unique(codes >= 0, axis=0))
    _, a, b, _ = _best_pair(codes, members, names, max(patterns, min(CLASSES, 4 * CELLS // len(names))))
    has = (codes >= 0).astype(np.float32)

    def away(rows):
        shared = (has[rows] @ has.T).astype(np.float64)
        return np.where(shared > 0, (shared - _equal(codes[rows], codes)) / np.maximum(shared, 1), 1.0)

    at = [names.index(a), names.index(b)]
    to = away(at)
    to[[0, 1], at] = 0.0
    in_a = to[0] <= to[1]
    sides = np.stack([members * in_a, members * ~in_a], 1)
    sums = np.zeros((2, 2))
    step = max(1, AT_ONCE // len(names))
    for low in range(0, len(names), step):
        rows = slice(low, low + step)
        d = away(rows)
        d[np.arange(len(d)), np.arange(low, low + len(d))] = 0.0
        sums += sides[rows].T @ (d @ sides)
    size, squares = sides.sum(axis=0), (sides ** 2).sum(axis=0)
    row = (key[0], a, b, int(size[0]), int(size[1]), int((members * (members - 1) / 2).sum()),
           (sums[0, 0] + sums[1, 1]) / 2, ((size ** 2 - squares) / 2).sum(), sums[0, 1], size[0] * size[1])
    return pd.DataFrame([row], columns=[c.split()[0] for c in _FOUND.split(", ")])


def _fitting(vectors: DataFrame) -> DataFrame:
    """Corpora that one task can search within bounded memory."""
    keys = F.array_sort(F.map_keys("profile"))
    sets = vectors.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(keys).alias("sets"))
    width = vectors.select("corpus", F.explode(keys).alias("pointer")).distinct().groupBy("corpus").agg(F.count(F.lit(1)).alias("width"))
    return sets.join(width, "corpus").where((F.col("width") <= POINTERS) & (F.col("sets") <= CLASSES) & (F.col("n") * F.greatest("width", "sets") <= CELLS)).select("corpus")


def best_medoids(vectors: DataFrame) -> DataFrame:
    """H4: the best pair of medoids over distinct vectors, weighted by members, by an exact pruned search.

    Returns ``(corpus, medoid_a, medoid_b, size_a, size_b, strength, is_split)``.

    A corpus is searched in one task that never holds a distance matrix, where its vectors fit; the others by tiles. Both find the same.
    """
    vectors = settle(vectors.where("corpus is not null"))
    fitting = settle(_fitting(vectors))
    found = spread(vectors.join(fitting, "corpus"), "corpus").groupBy("corpus").applyInPandas(_searched, _FOUND)
    rest = vectors.join(fitting, "corpus", "left_anti")
    if not rest.isEmpty():
        found = found.unionByName(_by_tiles(rest))
    zero = F.lit(0.0)
    strength = (
        F.when(F.col("mw") > 0, F.try_divide(F.col("mb"), F.col("mw")))
        .when(F.col("mb") > 0, F.lit(float("inf"))).otherwise(zero))
    return (
        found
        .withColumn("mw", F.coalesce(F.try_divide(F.col("within"), F.col("n_within") + F.col("twins")), zero))
        .withColumn("mb", F.coalesce(F.try_divide(F.col("between"), F.col("n_between")), zero))
        .withColumn("strength", strength)
        .withColumn("is_split", (F.col("size_a") >= 2) & (F.col("size_b") >= 2)
                    & (F.col("size_a") + F.col("size_b") >= SPLIT_MIN_DOCS)
                    & (F.col("strength") >= SPLIT_STRENGTH))
        .select("corpus", "medoid_a", "medoid_b", "size_a", "size_b", "strength", "is_split")
    )


def _by_tiles(vectors: DataFrame) -> DataFrame:
    """``_FOUND`` of corpora of any size.

    The distance matrix is kept as written tiles. For two tiles of vectors, every vector adds at least its smaller
    distance to their nearest members; these sums bound the cost of all their pairs from below (no triangle inequality is
    needed, which does not hold where vectors share different pointers). The pair of tiles with the least bound is
    searched in full, and then only those whose bound does not exceed what it found.
    """
    vectors = _tiled(vectors)
    blocks = settle(_blocks(vectors), BLOCKS_A_FILE)
    least = blocks.mapInPandas(_least, "corpus string, tile_a int, tile_c int, members_b array<long>, least array<double>")
    bounds = least.groupBy("corpus", "tile_c").applyInPandas(_bounds, "corpus string, tile_a int, tile_b int, part double")
    bounds = settle(bounds.groupBy("corpus", "tile_a", "tile_b").agg(F.sum("part").alias("bound")))
    first = bounds.groupBy("corpus").agg(F.min(F.struct("bound", "tile_a", "tile_b")).alias("m")).select("corpus", "m.tile_a", "m.tile_b")
    found = settle(_pair_costs(blocks, first))
    open_ = bounds.join(first, ["corpus", "tile_a", "tile_b"], "left_anti").join(found.select("corpus", "cost"), "corpus", "left").where(
        F.col("cost").isNull() | (F.col("bound") <= F.col("cost") + 1e-6))
    every = found.unionByName(_pair_costs(blocks, open_.select("corpus", "tile_a", "tile_b")))
    best = settle(every.groupBy("corpus").agg(F.min(F.struct("cost", "medoid_a", "medoid_b")).alias("m")).select("corpus", "m.medoid_a", "m.medoid_b"))
    wanted = best.join(vectors.select("corpus", "vector"), "corpus")
    away = distances(vectors, wanted.select("corpus", F.explode(F.array("medoid_a", "medoid_b")).alias("a"), F.col("vector").alias("b")))
    away = away.withColumn("distance", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("distance")))
    side = settle(wanted.join(away.select("corpus", F.col("a").alias("medoid_a"), F.col("b").alias("vector"), F.col("distance").alias("da")), ["corpus", "medoid_a", "vector"])
                  .join(away.select("corpus", F.col("a").alias("medoid_b"), F.col("b").alias("vector"), F.col("distance").alias("db")), ["corpus", "medoid_b", "vector"])
                  .join(vectors.select("corpus", "vector", "members", "tile"), ["corpus", "vector"])
                  .select("corpus", "medoid_a", "medoid_b", "vector", "members", "tile", (F.col("da") <= F.col("db")).alias("in_a")))
    flags = side.groupBy("corpus", "tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("vector", "in_a"))), lambda x: x["in_a"]).alias("flags"))
    flagged = blocks.where("tile_a <= tile_b").join(flags.select("corpus", F.col("tile").alias("tile_a"), F.col("flags").alias("in_a")), ["corpus", "tile_a"]).join(
        flags.select("corpus", F.col("tile").alias("tile_b"), F.col("flags").alias("in_b")), ["corpus", "tile_b"])
    means = flagged.mapInPandas(_means, "corpus string, within double, n_within double, between double, n_between double").groupBy("corpus").agg(
        *[F.sum(c).alias(c) for c in ("within", "n_within", "between", "n_between")])
    sizes = side.groupBy("corpus", "medoid_a", "medoid_b").agg(
        F.sum(F.when(F.col("in_a"), F.col("members")).otherwise(0)).alias("size_a"),
        F.sum(F.when(F.col("in_a"), 0).otherwise(F.col("members"))).alias("size_b"),
        F.sum(F.expr("members * (members - 1) div 2")).alias("twins"))
    return sizes.join(means, "corpus")


def warnings(sizes: DataFrame, agreement: DataFrame, voted: DataFrame, splits: DataFrame) -> DataFrame:
    """H5: one row per thing a person should know, ``(corpus, kind, subject, message)``."""
    n = F.col("n_docs")
    small = sizes.where(n < MIN_CORPUS).select(
        "corpus", F.lit("small").alias("kind"), F.lit("").alias("subject"),
        F.format_string("with %d document(s) agreement moves in steps of %s", n,
                        percent(1 / F.greatest(n, F.lit(1)))).alias("message"))
    odd = outliers(agreement).select(
        "corpus", F.lit("outlier").alias("kind"), F.col("doc").alias("subject"),
        F.format_string("%s shares %s of the common votes", "doc", percent(F.col("agreement"))).alias("message"))
    two = splits.select(
        "corpus", F.lit("split").alias("kind"), F.concat_ws(" / ", "medoid_a", "medoid_b").alias("subject"),
        F.format_string("two groups of %d and %d documents", "size_a", "size_b").alias("message"))
    undecided = (
        voted.where("status = 'undecided'").groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))
        .select("corpus", F.lit("undecided").alias("kind"), F.lit("").alias("subject"),
                F.format_string("%d pointer(s) without a majority", "n").alias("message")))
    return small.unionByName(odd).unionByName(two).unionByName(undecided)


def by_status(voted: DataFrame, *statuses: str) -> DataFrame:
    """H6."""
    return voted.where(F.col("status").isin(*statuses))


def donor_values(voted: DataFrame) -> DataFrame:
    """H6: what an exemplar should carry."""
    return voted.where("in_donor")


def needs_review(voted: DataFrame) -> DataFrame:
    """H6."""
    return voted.where("needs_review")


def enforceable(voted: DataFrame) -> DataFrame:
    """H6."""
    return voted.where("severity <> 'off'")


def consensus_styles(voted: DataFrame) -> DataFrame:
    """Style names under ``/styles/<type>/<name>/...`` the exemplar should have."""
    token = F.split("pointer", "/")
    return (
        voted.where("in_donor and startswith(pointer, '/styles/')").where(F.size(token) > 3)
        .select("corpus", F.get(token, 3).alias("style")).distinct()
    )


def donor_scores(agreement: DataFrame, meta: DataFrame, styles_used: DataFrame, voted: DataFrame) -> DataFrame:
    """H7: score every document as an exemplar; disqualified ones score minus infinity."""
    wanted = consensus_styles(voted)
    n_wanted = wanted.groupBy("corpus").agg(F.count(F.lit(1)).alias("wanted"))
    had = (styles_used.select("corpus", "doc", "style").distinct().join(wanted, ["corpus", "style"])
           .groupBy("corpus", "doc").agg(F.count(F.lit(1)).alias("had")))
    signals = [F.col("header_parts") > 0, F.col("footer_parts") > 0, F.col("list_count") > 0,
               F.col("section_count") >= 1, F.col("paragraphs") >= 10]
    complete = sum((s.cast("int") for s in signals), F.lit(0)) / F.lit(len(signals))
    total = (W_AGREEMENT * F.col("agreement") + W_STYLES * F.col("role_coverage")
             + W_COMPLETENESS * F.col("completeness") - W_DIRECT * F.col("direct_density"))
    return (
        meta.join(agreement, ["corpus", "doc"], "left").join(had, ["corpus", "doc"], "left")
        .join(n_wanted, "corpus", "left")
        .select(
            "corpus", "doc", F.coalesce("agreement", F.lit(0.0)).alias("agreement"),
            F.when(F.coalesce("wanted", F.lit(0)) == 0, F.lit(1.0))
            .otherwise(F.coalesce("had", F.lit(0)) / F.col("wanted")).alias("role_coverage"),
            complete.alias("completeness"), "direct_density", "disqualified")
        .withColumn("score", F.when(F.col("disqualified"), F.lit(float("-inf"))).otherwise(total))
    )


def best_donor(scores: DataFrame) -> DataFrame:
    """H7: the best exemplar per corpus (ties: smallest id); none if all are disqualified."""
    key = F.struct((-F.col("score")).alias("s"), F.col("doc"))
    return (
        scores.where(~F.col("disqualified")).groupBy("corpus")
        .agg(F.min(key).alias("m")).select("corpus", "m.doc", (-F.col("m.s")).alias("score"))
    )


def ranked(scores: DataFrame) -> DataFrame:
    """H7: every candidate with its place; corpora of exemplars, so one window per corpus is the
    report itself, not a step others build on."""
    order = Window.partitionBy("corpus").orderBy(F.desc("score"), "doc")
    return scores.withColumn("place", F.row_number().over(order))
