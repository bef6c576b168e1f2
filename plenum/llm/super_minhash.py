"""Near duplicates by SuperMinHash signatures, banding, verification and union-find grouping.

*Signature.* Each shingle draws a random permutation of the signature's places and a random fraction per
step; in step ``j`` it offers ``j + fraction`` to the ``j``-th place of its permutation, and each place keeps
the least offer. The ranks of one element are correlated (no place twice), which lowers the variance of the
estimate, and since later steps only offer more, a document stops as soon as every place is taken: long
documents need two or three steps. Permutations are never stored; a place is found by tracing the swaps made
so far backwards.

*Grouping.* Documents with equal shingle sets form classes, and only one of each class goes on. Signatures
are cut into bands; documents that share a band are candidates. First each candidate is held against the
least document of its bucket; the links that full sets confirm give components. Then, bucket by bucket, only
documents of different components are held against each other, so a bucket of thousands of near copies that
hang together costs no pairs. That is done twice: pairs whose signatures agree as linked ones mostly do come first,
and what they join need not be compared any more when the others, of which few are linked, have their turn. Before any set travels, a pair must be able to reach the threshold: shingles
that no other candidate has cannot be shared, and ``min(shared a, shared b)`` bounds the intersection from
above. That bound is exact, and it removes edited copies that only look alike.

Links are confirmed on full sets by integer arithmetic. A pair at the threshold escapes all bands with
probability ``(1 - 0.85^4)^32``, about 6e-11.

Defined cases: a text without words (null, empty, white space) has no shingles and is linked with nothing; a
text with fewer words than a shingle is one shingle; equal texts share a class, also when a row is repeated;
ids may repeat and be null (a null id is never the name of a component that has another); texts of any length
are taken whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.common import documents, fresh, give_back, settle, utf8_column, with_rows
from plenum.llm.components import components
from plenum.llm.shingles import FACTOR, mix, shingle_sets

NAME = "op4_super_minhash"
ORACLE = None  # all-pairs set similarity of whole texts is too slow in SQL
BANDS, ROWS = 32, 4
KEYS = 128  # keys kept per signature: the first BANDS look for candidates, all of them estimate a pair's similarity
STAGE_WORDS, STAGE_PERCENT = 5, 80  # stages on word shingles unless a contract says otherwise
QUERY_WORDS, QUERY_PERCENT = 3, 85
_U = np.uint64
HELD = 8192  # elements whose permutations are held at once, at two bytes a place
TRACED = 4  # steps in which places are found by tracing swaps back; long documents need no more


@lru_cache
def _salts(size: int) -> np.ndarray:
    return mix(np.arange(1, size + 1, dtype=_U) * FACTOR)


def _draw(element: np.ndarray, j: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What each element offers in step ``j``, and the place it swaps with the ``j``-th."""
    drawn = mix(element ^ _salts(size)[j])
    return (drawn >> _U(11)).astype(np.float64) / 9007199254740992.0 + j, (j + (mix(drawn) % _U(size - j))).astype(np.int16)


def _open(out: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which elements are of documents with places that nothing has taken (``of`` ascends)."""
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return np.repeat(np.isinf(out[of[first]]).any(axis=1), np.diff(first, append=len(of)))


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` values per non-empty set (rows of empty sets stay infinite)."""
    order = np.argsort([-len(s) for s in sets], kind="stable")  # documents that need as many steps side by side
    sets = [sets[i] for i in order]
    out = np.full((len(sets), size), np.inf)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.zeros(0, _U)
    swaps: list[np.ndarray] = []
    for j in range(min(TRACED, size)):
        offer, swap = _draw(element, j, size)
        place = swap.copy()
        for i in range(j - 1, -1, -1):  # what the swapped place held before: trace the earlier swaps back
            np.copyto(place, np.int16(i), where=place == swaps[i])
        np.minimum.at(out.reshape(-1), of * size + place, offer)
        open_ = _open(out, of)
        element, of, swaps = element[open_], of[open_], [s[open_] for s in [*swaps, swap]]
    low = 0
    while low < len(element):  # whole documents: an element must not find its document filled by later steps of others
        high = max(np.searchsorted(of, of[min(low + HELD, len(of) - 1)]), np.searchsorted(of, of[low], "right")) if low + HELD < len(of) else len(of)
        _finish(out, element[low:high], of[low:high], [s[low:high] for s in swaps])
        low = high
    back = np.empty_like(out)
    back[order] = out
    return back


def _finish(out: np.ndarray, element: np.ndarray, of: np.ndarray, swaps: list[np.ndarray]) -> None:
    """The steps after ``swaps`` on held permutations, until every place of the elements' documents is taken.

    An offer of a later step is never less than what a taken place has, so a step too many changes nothing.
    """
    size = out.shape[1]
    held, row = np.tile(np.arange(size, dtype=np.int16), (len(element), 1)), np.arange(len(element))
    for j, swap in enumerate(swaps):
        held[row, swap] = held[:, j]
    for j in range(len(swaps), size):
        offer, swap = _draw(element, j, size)
        np.minimum.at(out.reshape(-1), of * size + held[row, swap], offer)
        held[row, swap] = held[row, j]
        if j < 16 or j % 8 == 0:
            open_ = _open(out, of)
            if not open_.all():
                element, of, row = element[open_], of[open_], row[open_]
                if not len(element):
                    break


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key per band: four values of the signature in 16 bits each, so that keys can also be compared by value."""
    short = mix(values.view(_U)).reshape(len(values), bands, ROWS) & _U(0xFFFF)
    return (short << (_U(16) * np.arange(ROWS, dtype=_U))).sum(axis=2, dtype=_U).view(np.int64)


def agreeing(left: str, right: str):
    """How many values of two signatures agree, from their band keys."""
    def differing(x, y):
        bits = x.bitwiseXOR(y)
        for n in (8, 4, 2, 1):  # gathers the sixteen bits of each value in its lowest
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, n))
        return F.bit_count(bits.bitwiseAND(F.lit(0x0001000100010001)))

    apart = F.aggregate(F.zip_with(left, right, differing), F.lit(0), lambda total, n: total + n)
    return ROWS * F.size(left) - apart


def least_agreement(percent: int, bands: int = KEYS) -> int:
    """Five standard deviations under what a pair at the threshold shows on average (one such pair in 3 million is below)."""
    n, p = bands * ROWS, percent / 100
    return int(n * p - 5 * (n * p * (1 - p)) ** 0.5)


def typical_agreement(percent: int, bands: int = KEYS) -> int:
    """One standard deviation under that average: most pairs at the threshold and nearly all above show this much."""
    n, p = bands * ROWS, percent / 100
    return int(n * p - (n * p * (1 - p)) ** 0.5)


def _list_column(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


SLICE_ROWS = 2048  # rows taken out of a batch at once: their bytes are copied, those of the others are not


def _pieces(batch, limit: int = 1 << 20):
    """Row ranges of a batch with about ``limit`` bytes of text each."""
    for first in range(0, batch.num_rows, SLICE_ROWS):
        raw, at = utf8_column(batch.column(1).slice(first, SLICE_ROWS))
        low, rows = 0, len(at) - 1
        while low < rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + limit)))
            high = min(high, rows)
            yield first + low, first + high, raw[at[low]: at[high]], at[low: high + 1] - at[low]
            low = high


def sketch(rows: DataFrame, words: int, bands: int = KEYS) -> DataFrame:
    """``rows(row, text, doc_id)`` to ``(row, doc_id, n, print_a, print_b, keys)``; ``keys`` is empty without shingles."""
    def run(batches):
        for batch in batches:
            for low, high, raw, at in _pieces(batch):
                sets = shingle_sets(raw, at, words)
                keys = band_keys(signatures(sets, bands * ROWS), bands)
                with np.errstate(over="ignore"):  # two independent folds of the set: 128 bits name it
                    a = np.array([mix(s).sum(dtype=_U) for s in sets], _U).view(np.int64)
                    b = np.array([np.bitwise_xor.reduce(mix(s * FACTOR + _U(7)), initial=_U(0)) for s in sets], _U).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(a), pa.array(b), _list_column([k if len(s) else k[:0] for k, s in zip(keys, sets)])],
                    ["row", "doc_id", "n", "print_a", "print_b", "keys"])

    return rows.select("row", "text", "doc_id").mapInArrow(run, "row long, doc_id long, n long, print_a long, print_b long, keys array<long>")


def full_sets(rows: DataFrame, words: int) -> DataFrame:
    """``rows(row, text)`` to ``(row, shingles)``."""
    def run(batches):
        for batch in batches:
            for low, high, raw, at in _pieces(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), _list_column(shingle_sets(raw, at, words))], ["row", "shingles"])

    return rows.select("row", "text").mapInArrow(run, "row long, shingles array<long>")


def _reachable(percent: int):
    """Whether a pair's sizes and shared shingles let it reach the threshold."""
    most = F.least("shared_a", "shared_b")
    return 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Written table of the pairs ``(a, b)`` whose full sets reach the threshold."""
    left = pairs.join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("set_b")), "b")
    both = left.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    counted = both.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
    return settle(counted.where(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).select("a", "b"))


def links(rows: DataFrame, leaders: DataFrame, words: int, percent: int) -> DataFrame:
    """Components ``(node, root)`` of the class leaders ``(row, n, keys)`` that are linked with another one."""
    entries = leaders.select("row", F.posexplode(F.slice("keys", 1, BANDS)).alias("band", "key"))
    buckets = entries.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members"), F.min("row").alias("center")).where("members > 1")
    entries = settle(entries.join(buckets.select("band", "key", "center"), ["band", "key"]))
    candidates = entries.select("row").distinct()
    sets = settle(full_sets(rows.join(candidates, "row", "left_semi"), words))
    # a shingle that one candidate alone has cannot be in any intersection
    alone = sets.select("row", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("holders"), F.min("row").alias("row")).where("holders = 1")
    alone = alone.groupBy("row").agg(F.count(F.lit(1)).alias("alone"))
    sizes = settle(sets.select("row", F.size("shingles").cast("long").alias("n")).join(alone, "row", "left")
                   .select("row", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared")))
    sized = settle(entries.join(sizes, "row"))
    middle = sizes.select(F.col("row").alias("center"), F.col("n").alias("n_a"), F.col("shared").alias("shared_a"))
    spokes = sized.where("row <> center").withColumnsRenamed({"n": "n_b", "shared": "shared_b"}).join(middle, "center").where(_reachable(percent))
    first = confirm(spokes.select(F.col("center").alias("a"), F.col("row").alias("b")).distinct(), sets, percent)
    high = typical_agreement(percent)
    strong = _met(sized, leaders, components(first), sets, percent, high, None)
    near = first.unionByName(strong)
    weak = _met(sized, leaders, components(near), sets, percent, least_agreement(percent), high)
    return components(near.unionByName(weak))


def _met(sized: DataFrame, leaders: DataFrame, found: DataFrame, sets: DataFrame, percent: int, low: int, below: int | None) -> DataFrame:
    """Written table of the linked pairs that share a bucket, lie in different components of ``found`` and agree in ``low``
    values or more, but in fewer than ``below``."""
    found = settle(found)
    placed = sized.join(found.withColumnRenamed("node", "row"), "row", "left").select("band", "key", "row", "n", "shared", F.coalesce("root", "row").alias("root"))
    mixed = placed.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band", "key")
    able = placed.where(100 * F.col("shared") >= percent * F.col("n"))  # cannot link with anything otherwise
    open_ = settle(able.join(mixed, ["band", "key"], "left_semi").join(leaders.select("row", "keys"), "row"))
    side = lambda name: open_.select("band", "key", *[F.col(c).alias(f"{n}_{name}") for c, n in (("root", "root"), ("n", "n"), ("shared", "shared"), ("keys", "keys"))], F.col("row").alias(name))
    left, right = side("a"), side("b")
    # a pair is met in every band it shares and taken in the first
    foremost = F.array_position(F.zip_with(F.slice("keys_a", 1, BANDS), F.slice("keys_b", 1, BANDS), lambda x, y: x == y), True) == left["band"] + 1
    top = KEYS * ROWS if below is None else below - 1
    between = F.abs(2 * agreeing("keys_a", "keys_b") - (low + top)) <= top - low  # low <= agreeing <= top, computed once
    across = left.join(right, (left["band"] == right["band"]) & (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b"))
                       & _reachable(percent) & foremost & between)
    linked = confirm(across.select("a", "b"), sets, percent)
    give_back(open_)
    return linked


def keyed(docs: DataFrame) -> DataFrame:
    return with_rows(docs.select("doc_id", "text"), "row").select("row", F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))


def groups(docs: DataFrame, words: int = STAGE_WORDS, percent: int = STAGE_PERCENT) -> DataFrame:
    """``grouped`` for every row of ``docs(doc_id, text)``."""
    return grouped(keyed(docs), words, percent)


def grouped(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """``(row, doc_id, n_shingles, component_id, kept, stays)`` for every one of ``rows(row, text, doc_id)``.

    ``kept`` says that the id is the component's name; ``stays`` marks exactly one row of a component.
    """
    known = settle(sketch(rows, words))
    classes = settle(known.where("n > 0").groupBy("n", "print_a", "print_b").agg(
        F.min("row").alias("leader"), F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("first")))
    leaders = known.join(classes.select(F.col("leader").alias("row")), "row", "left_semi").select("row", "n", "keys")
    linked = settle(links(rows, leaders, words, percent))
    rooted = classes.join(linked.withColumnRenamed("node", "leader"), "leader", "left").withColumn("root", F.coalesce("root", "leader"))
    tops = rooted.groupBy("root").agg(F.min("class_id").alias("component_id"), F.min("first").alias("best"))
    named = settle(rooted.select("n", "print_a", "print_b", "root").join(tops, "root").select(
        "n", "print_a", "print_b", "component_id", F.col("best.row").alias("best")))
    full = known.where("n > 0").drop("keys").join(named, ["n", "print_a", "print_b"]).select("row", "doc_id", "n", "component_id", "best")
    lone = known.where("n = 0").select("row", "doc_id", "n", F.col("doc_id").alias("component_id"), F.col("row").alias("best"))
    return full.unionByName(lone).select(
        "row", "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("row") == F.col("best")).alias("stays"))


def drop_near_copies(docs: DataFrame, words: int = STAGE_WORDS, percent: int = STAGE_PERCENT) -> DataFrame:
    """``docs``, with all its columns, with one row of each component (the one with the smallest id)."""
    row = fresh(docs, "row_no")
    rows = with_rows(docs, row)
    stay = grouped(rows.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id")), words, percent)
    return rows.join(stay.where("stays").select(F.col("row").alias(row)), row, "left_semi").drop(row)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(documents(spark, sf_dir), QUERY_WORDS, QUERY_PERCENT)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
