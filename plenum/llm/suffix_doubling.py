"""Substring duplicates by distributed prefix doubling.

Suffix positions of all documents are ranked by growing prefixes; a position that has become unique among
the documents leaves, and the rest goes on until the threshold of 50 bytes is passed.

*Sampled suffixes.* Ranking every byte position would sort as many rows as there are bytes. Of every 50-byte
string only one position is ranked: the start of its least 20-byte string by hash (leftmost among equals).
Equal 50-byte strings choose alike, so no match is lost, and one position stands for the whole run of
strings that chose it, about sixteen.

*Rank 20.* Spark deals the sampled positions out by the rank of their first 20 bytes. Positions whose 20 bytes
occur in one document only leave here. Of the others, those with equal surroundings (from the first to the
last byte of the strings they stand for) and a smaller document are covered as a whole. A lot of positions in
which one 20-byte string has more than ``HOT`` different surroundings sends one of them, marked, to the meeting;
the others need no meeting, for they stay open anyway.

*Rank 50.* What is left is the rim of matches: one position per distinct surrounding. It goes back to its
document, the strings it stands for are ranked by pairs (rank of bytes 0-24, rank of bytes 25-49), dealt out by
Spark by the rank of the whole string, and a string whose pair also occurs in a smaller document is covered. Each
task settles its own strings first, so a string arrives at most once per lot and document it is first in. The surrounding of the
smallest document speaks for all later ones with the same surrounding, so a passage with thousands of copies
sends one position to this step.

A rank is a 48-bit hash where only a filter depends on it, and 96 bits and more where a decision does.
Positions travel as packed, compressed columns, one block per task and partition; before they leave a task,
repeated surroundings are settled in it, so a passage that fills the corpus arrives once per task. The number of
partitions follows the bytes of the texts and, for the strings of the rim, their count; a partition has one bucket.

Defined cases: null counts as empty; texts under 50 bytes lose nothing; matches inside one document, and
between rows that share a document id, remove nothing; a null id counts as greater than all others; repeated
rows are answered one by one; texts of any length are cut into overlapping segments inside a task; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.common import documents, settle, shuffle_partitions, utf8_column, with_rows
from plenum.llm.shingles import FACTOR, mix, powers

NAME = "op7_suffix_doubling"
ORACLE = None  # all substrings of whole texts are too many for SQL
LENGTH, SEED_LENGTH = 50, 20
SEGMENT = 1 << 20
FLUSH = 500_000
LAST = (1 << 63) - 1
_U = np.uint64
_LOW48 = _U((1 << 48) - 1)
_COVERED, _OPEN, _HOT, _MANY = 0x80, 0x40, 0x20, 0x1F  # marks above the number of strings
HOT = 64
PART_BYTES, PART_STRINGS = 32 << 20, 2_000_000
_WIDE = 2 * LENGTH - SEED_LENGTH  # bytes of the widest surrounding


@lru_cache(maxsize=1)
def _inverse() -> int:
    return pow(int(FACTOR), -1, 1 << 64)


_INVERSES = np.ones(1, _U)


def inverses(n: int) -> np.ndarray:
    """``FACTOR ** -(0 .. n-1)`` modulo 2^64."""
    global _INVERSES
    if len(_INVERSES) < n:
        steps = np.full(n, _inverse(), _U)
        steps[0] = 1
        _INVERSES = np.cumprod(steps)
    return _INVERSES[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; the hash of bytes ``[i, j)`` is ``mix((s[j] - s[i]) * inverse[i])``."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * powers(len(data)), out=out[1:])
    return out


def sampled(segments: list[bytes]) -> dict[str, np.ndarray]:
    """Per run of strings that choose one position: segment, first string, how many, the position's place, hashes."""
    raw = np.frombuffer(b"".join(segments), np.uint8)
    start = np.concatenate([[0], np.cumsum([len(s) for s in segments])]).astype(np.int64)
    names = ("segment", "q", "n", "x", "g", "c")
    if len(raw) < LENGTH:
        return {k: np.zeros(0, np.int64 if k not in "gc" else _U) for k in names}
    sums, inv = prefix_sums(raw), inverses(len(raw) + 1)
    g = mix((sums[SEED_LENGTH:] - sums[:-SEED_LENGTH]) * inv[: len(raw) - SEED_LENGTH + 1])
    # hash above, position below: the least of a window is its leftmost least hash
    least = (g >> _U(24) << _U(24)) | np.arange(len(g), dtype=_U)
    width, have = LENGTH - SEED_LENGTH + 1, 1
    out_len = len(g) - width + 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[:out_len], least[width - have: width - have + out_len])
    place = (least & _U(0xFFFFFF)).astype(np.int64)
    of = np.repeat(np.arange(len(segments)), np.diff(start))
    inside = of[:out_len] == of[LENGTH - 1:]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (of[1:out_len] != of[: out_len - 1])])
    first = np.flatnonzero(inside & (new | np.concatenate([[True], ~inside[:-1]])))
    last = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    segment, n, x = of[first], last - first + 1, place[first] - first
    c = mix((sums[last + LENGTH] - sums[first]) * inv[first] + n.astype(_U) * FACTOR + x.astype(_U) * _U(0xD6E8FEB86659FD93))
    return {"segment": segment, "q": first - start[segment], "n": n, "x": x, "g": g[place[first]] & _LOW48, "c": c & _LOW48}


_FIELDS = (("g", 6), ("c", 6), ("q", 4), ("x", 1), ("n", 1), ("row", 8), ("doc", 8))


def pack(columns: dict[str, np.ndarray], tail: bytes = b"") -> bytes:
    """Columns as byte planes; rows and documents as differences, which are mostly zero."""
    n = len(columns["g"])
    row, doc = columns["row"].astype(np.int64), columns["doc"].astype(np.int64)
    flat = {**columns, "row": np.diff(row, prepend=0), "doc": np.diff(doc - row, prepend=0)}
    planes = b"".join(flat[k].astype(np.int64).view(np.uint8).reshape(n, 8)[:, :w].T.tobytes() for k, w in _FIELDS)
    return struct.pack("<q", n) + zstandard.ZstdCompressor(level=1).compress(planes + tail)


def unpack(blob: bytes) -> tuple[dict[str, np.ndarray], bytes]:
    n = struct.unpack("<q", blob[:8])[0]
    data, at, out = zstandard.ZstdDecompressor().decompress(blob[8:]), 0, {}
    for k, w in _FIELDS:
        full = np.zeros((n, 8), np.uint8)
        full[:, :w] = np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T
        out[k] = full.reshape(-1).view(np.int64).copy()
        at += n * w
    out["row"] = np.cumsum(out["row"])
    out["doc"] = np.cumsum(out["doc"]) + out["row"]
    return out, data[at:]


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start flags and group numbers of sorted keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new, np.cumsum(new) - 1


def settle_in_task(rows: dict[str, np.ndarray]) -> None:
    """Marks as covered what has an equal surrounding in a smaller document of the same lot."""
    order = np.lexsort((rows["doc"], rows["c"], rows["g"]))
    _, group = _groups(rows["g"][order], rows["c"][order])
    doc = rows["doc"][order]
    first = doc[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))][group] if len(doc) else doc
    rows["n"][order[doc > first]] |= _COVERED


def open_in_task(rows: dict[str, np.ndarray]) -> None:
    """Marks as open the positions of a hot string of the lot, all but one, which says so to the other lots."""
    live = np.flatnonzero(rows["n"] & _COVERED == 0)
    live = live[np.argsort(rows["g"][live], kind="stable")]
    if not len(live):
        return
    new, group = _groups(rows["g"][live])
    starts, doc = np.flatnonzero(new), rows["doc"][live]
    several = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)  # hence several surroundings
    hot = (several & (np.bincount(group) > HOT))[group]
    rows["n"][live[hot & ~new]] |= _OPEN
    rows["n"][live[hot & new]] |= _HOT


def even_labels(spark: SparkSession, parts: int) -> np.ndarray:
    """As many bucket numbers as partitions, each of which Spark's hash partitioning sends to a partition of its own."""
    number = F.col("id").cast("int")
    first = spark.range(64 * parts).groupBy(F.pmod(F.hash(number), F.lit(parts)).alias("part")).agg(F.min(number).alias("label"))
    return np.array(sorted(row.label for row in first.collect()), np.int64)


def _blocks(rows: dict[str, np.ndarray], labels: np.ndarray):
    """Packed blocks by bucket; what is settled already goes to a bucket of its document."""
    key = np.where(rows["n"] & (_COVERED | _OPEN), rows["row"], rows["g"]).astype(_U)
    bucket = labels[(mix(key) % _U(len(labels))).astype(np.int64)]
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for low, high in zip(edges, np.append(edges[1:], len(order))):
        at = order[low:high]
        yield int(bucket[at[0]]), pack({k: v[at] for k, v in rows.items()})


def _emit(pairs):
    batch, size = [], 0
    for bucket, blob in pairs:
        batch.append((bucket, blob))
        size += len(blob)
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in batch], pa.int32()), pa.array([x for _, x in batch], pa.binary())], ["bucket", "block"])
            batch, size = [], 0
    if batch:
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in batch], pa.int32()), pa.array([x for _, x in batch], pa.binary())], ["bucket", "block"])


def _positions(labels: np.ndarray):
    """Texts to packed sampled positions."""
    def run(batches):
        held: list[dict[str, np.ndarray]] = []
        waiting: list[tuple[int, int, int, bytes]] = []

        def sample():
            if waiting:
                found = sampled([w[3] for w in waiting])
                at = found.pop("segment")
                row, doc, base = (np.array([w[i] for w in waiting], np.int64) for i in range(3))
                held.append({**{k: v.view(np.int64) if v.dtype == _U else v for k, v in found.items()}, "q": found["q"] + base[at], "row": row[at], "doc": doc[at]})
                waiting.clear()

        def flush():
            rows = _joined(held)
            held.clear()
            settle_in_task(rows)
            open_in_task(rows)
            yield from _emit(_blocks(rows, labels))

        size = 0
        for batch in batches:
            raw, at = utf8_column(batch.column(2))
            for i, (row, doc) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                for low in range(int(at[i]), max(int(at[i]) + 1, int(at[i + 1]) - LENGTH + 1), SEGMENT):
                    part = raw[low: min(low + SEGMENT + LENGTH - 1, int(at[i + 1]))]
                    if len(part) >= LENGTH:
                        waiting.append((row, doc, low - int(at[i]), part))
                        size += len(part)
                    if size >= SEGMENT:
                        sample()
                        size = 0
                        if sum(len(h["g"]) for h in held) >= FLUSH:
                            yield from flush()
        sample()
        if held:
            yield from flush()

    return run


def _mark_rows(row, q, n, x, open_):
    for at in range(0, len(row), 200_000):
        s = slice(at, at + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(row[s]), pa.array(q[s].astype(np.int32)), pa.array(n[s].astype(np.int16)), pa.array(x[s].astype(np.int16)), pa.array(open_[s])],
                                         ["row", "q", "n", "x", "open"])


def rank_seeds(batches):
    """One partition of buckets: positions unique among documents leave, equal surroundings are covered, the rim stays open."""
    parts = [unpack(b)[0] for batch in batches for b in batch.column(1).to_pylist()]
    if not parts:
        return
    rows = _joined(parts)
    del parts
    done, hot = (rows["n"] & (_COVERED | _OPEN)) > 0, (rows["n"] & _HOT) > 0
    open_ = (rows["n"][done] & _OPEN) > 0
    rows["n"] &= _MANY
    yield from _mark_rows(*(rows[k][done] for k in ("row", "q", "n", "x")), open_)
    order = np.argsort(np.where(done, -1, rows["g"]), kind="stable")[int(done.sum()):]
    _, group = _groups(rows["g"][order])
    if not len(order):
        return
    doc = rows["doc"][order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    known = np.logical_or.reduceat(hot[order], starts)
    several = (known | (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)))[group]
    hot[order] = known[group]
    order = order[several]
    order = order[np.lexsort((rows["doc"][order], rows["c"][order], rows["g"][order]))]
    if not len(order):
        return
    rows, hot = {k: v[order] for k, v in rows.items()}, hot[order]
    new, kind = _groups(rows["g"], rows["c"])
    first = rows["doc"][np.flatnonzero(new)][kind]
    _, group = _groups(rows["g"])
    kinds = np.bincount(group, weights=new)[group]
    covered = rows["doc"] > first
    say = covered | (kinds > 1) | hot
    yield from _mark_rows(*(rows[k][say] for k in ("row", "q", "n", "x")), ~covered[say])


_SALTED = mix(np.arange(1, 257, dtype=_U) * _U(0xA4093822299F31D0))  # another number for each byte


def pair_ranks(wide: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every string of every surrounding: which surrounding, its offset there, two independent ranks of its pair."""
    half, inv, many = LENGTH // 2, inverses(_WIDE + 1), int(n.max(initial=0))
    pick = np.arange(many) < n[:, None]
    ranks = []
    for values in (wide.astype(_U) + _U(1), _SALTED[wide]):
        sums = np.zeros((len(wide), _WIDE + 1), _U)
        np.cumsum(values * powers(_WIDE), axis=1, out=sums[:, 1:])
        a, b, c = sums[:, :many], sums[:, half: half + many], sums[:, LENGTH: LENGTH + many]
        ranks.append((mix(mix((b - a) * inv[:many]) * FACTOR + mix((c - b) * inv[half: half + many])) & _LOW48)[pick].view(np.int64))
    return *np.nonzero(pick), *ranks


def _rims(labels: np.ndarray):
    """Marked texts to packed strings of open positions."""
    def run(batches):
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def flush():
            rows = _joined(held)
            held.clear()
            settle_in_task(rows)
            settled = rows["n"] & _COVERED > 0
            rows["g"][settled] = rows["c"][settled] = 0
            yield from _emit(_blocks(rows, labels))

        for batch in batches:
            raw, at = utf8_column(batch.column(2))
            row, doc = (np.array(batch.column(i).to_pylist(), np.int64) for i in range(2))
            marks = batch.column(3)
            many = np.diff(marks.offsets.to_numpy())
            of = np.repeat(np.arange(batch.num_rows), many)
            q, n, x, open_ = (marks.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
            pick = np.flatnonzero(open_)
            of, q, n = of[pick], q[pick].astype(np.int64), n[pick].astype(np.int64)
            data = np.frombuffer(raw, np.uint8)
            for low in range(0, len(of), 10_000):
                s = slice(low, low + 10_000)
                base = at[of[s]] + q[s]
                wide = base[:, None] + np.arange(_WIDE)
                wide = np.where(np.arange(_WIDE) < (n[s] + LENGTH - 1)[:, None], data[np.minimum(wide, len(data) - 1)], 0).astype(np.uint8)
                rim, j, g, c = pair_ranks(wide, n[s])
                held.append({"g": g, "c": c, "q": q[s][rim] + j, "x": np.zeros(len(g), np.int64), "n": np.ones(len(g), np.int64), "row": row[of[s]][rim], "doc": doc[of[s]][rim]})
                size += len(g)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def rank_pairs(batches):
    """One partition of buckets: strings whose pair of ranks occurs in a smaller document, as runs ``(row, q, n)``."""
    parts = [unpack(b)[0] for batch in batches for b in batch.column(1).to_pylist()]
    if not parts:
        return
    rows = _joined(parts)
    del parts
    done = rows["n"] & _COVERED > 0
    order = np.flatnonzero(~done)
    order = order[np.lexsort((rows["doc"][order], rows["c"][order], rows["g"][order]))]
    new, group = _groups(rows["g"][order], rows["c"][order])
    doc = rows["doc"][order]
    hit = np.concatenate([np.flatnonzero(done), order[doc > doc[np.flatnonzero(new)][group]]])
    if not len(hit):
        return
    hit = hit[np.lexsort((rows["q"][hit], rows["row"][hit]))]
    row, q = rows["row"][hit], rows["q"][hit]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (q[1:] > q[:-1] + 1)]))
    last = np.append(first[1:], len(row)) - 1
    for s in range(0, len(first), 200_000):
        a, b = first[s: s + 200_000], last[s: s + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(row[a]), pa.array(q[a].astype(np.int32)), pa.array((q[b] - q[a] + 1).astype(np.int32))], ["row", "q", "n"])


def remove(text: bytes, q: np.ndarray, n: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """Bytes covered by the strings that start at ``q .. q + n - 1``, and the maximal spans."""
    if not len(q):
        return 0, []
    order = np.argsort(q, kind="stable")
    low, high = q[order].astype(np.int64), (q + n - 1 + LENGTH)[order].astype(np.int64)
    reach = np.maximum.accumulate(high)
    new = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]]))
    ends = reach[np.append(new[1:], len(low)) - 1]
    spans = list(zip(low[new].tolist(), ends.tolist()))
    return sum(b - a for a, b in spans), spans


RESULT = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"


def _finish(with_text: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def lists(column):
        lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
        at = np.concatenate([[0], np.cumsum(lengths)])
        flat = column.flatten()
        return at, [flat.field(i).to_numpy(zero_copy_only=False) for i in range(flat.type.num_fields)]

    def run(batches):
        for batch in batches:
            raw, at = utf8_column(batch.column(2))
            m_at, (mq, mn, _, mo) = lists(batch.column(3))
            r_at, (rq, rn) = lists(batch.column(4))
            out = []
            for i, (row, doc) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                text, m, r = raw[at[i]: at[i + 1]], slice(m_at[i], m_at[i + 1]), slice(r_at[i], r_at[i + 1])
                whole = ~mo[m].astype(bool)
                q, n = np.concatenate([mq[m][whole], rq[r]]).astype(np.int64), np.concatenate([mn[m][whole], rn[r]]).astype(np.int64)
                removed, spans = remove(text, q, n)
                edges = [0, *[e for s in spans for e in s], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((row, doc, len(text), removed, len(spans), [{"start": a, "end": b} for a, b in spans],
                            kept if with_text else hashlib.sha256(kept).hexdigest().encode()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), kind, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(types)],
                                             ["row", "doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return run


def removed(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``RESULT`` for ``docs(row, doc_id, text)``; ``kept`` holds the remaining bytes, or their hex digest."""
    least = shuffle_partitions(docs.sparkSession)
    texts = docs.select("row", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(least, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    blocks = texts.mapInArrow(_positions(even_labels(texts.sparkSession, parts)), "bucket int, block binary")
    marks = settle(blocks.repartition(parts, "bucket").mapInArrow(rank_seeds, "row long, q int, n short, x short, open boolean"))
    marked = texts.join(marks.groupBy("row").agg(F.collect_list(F.struct("q", "n", "x", "open")).alias("marks")), "row", "left")
    parts = max(least, -(-(marks.where("open").agg(F.sum("n")).first()[0] or 0) // PART_STRINGS))
    rims = marked.where("marks is not null").select("row", "doc", "text", "marks").mapInArrow(_rims(even_labels(texts.sparkSession, parts)), "bucket int, block binary")
    runs = rims.repartition(parts, "bucket").mapInArrow(rank_pairs, "row long, q int, n int")
    runs = runs.groupBy("row").agg(F.collect_list(F.struct("q", "n")).alias("runs"))
    none = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    both = marked.join(runs, "row", "left").select(
        "row", "doc", "text", none("marks", "array<struct<q:int,n:short,x:short,open:boolean>>"), none("runs", "array<struct<q:int,n:int>>"))
    return both.mapInArrow(_finish(with_text), RESULT).withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))


def keyed(docs: DataFrame) -> DataFrame:
    return with_rows(docs.select("doc_id", "text"), "row").select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed(keyed(documents(spark, sf_dir)), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))
