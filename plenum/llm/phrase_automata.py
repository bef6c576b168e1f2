"""Repeated passages by sharded Aho-Corasick automata.

A passage counts as repeated where twenty consecutive words also start earlier. Three steps find all of them.

*Confirm.* Every window of twenty words chooses one phrase of eight words in it (the least by hash, leftmost
among equals); equal windows choose alike. Choices travel as packed numbers, dealt out by phrase; phrases
chosen twice or more recur, and each is led by its first place. Phrases are told apart by two independent 48-bit
hashes, since only the text of the leading place is compiled.

*Compile.* Recurring phrases are gathered in shards by the document that leads them, so that the phrases of
one passage, and of all its copies, meet in one shard and a document visits few shards. A shard has about
``SHARD_PHRASES`` phrases; its documents are dealt over as many tasks as they need, each with the whole
automaton, so a passage that a third of the corpus contains is searched by many tasks.

*Locate.* Each task compiles the phrases of a shard with pyahocorasick, streams the shard's documents through
the automaton and so finds every place where a phrase really stands. The windows that chose such a place are
compared inside the task; where a shard is dealt over several tasks, the first window of each task is
compared once more across them. Each window has one chosen phrase, hence one shard, so nothing is missed and
nothing is compared twice.

Windows are compared by 128-bit hashes of their words, phrases by 96 bits and found by their text.

Defined cases: null text has no words; a text of fewer than twenty words loses none; windows that overlap an
earlier equal window of their own document count (only the later one is removed); rows that share a document
id are different documents neither of which is earlier; a null id comes after all others; repeated rows are
answered one by one; texts of any length are taken whole; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.common import documents, settle, shuffle_partitions, utf8_column, with_rows
from plenum.llm.shingles import _SPACE, mix
from plenum.llm.suffix_doubling import _LOW48, LAST, _emit, _groups, _joined, inverses, pack, powers, prefix_sums, unpack

NAME = "op3_phrase_automata"
ORACLE = None  # windows of all words of all documents are too many for SQL
WINDOW, PHRASE = 20, 8
SHARD_PHRASES, TASK_DOCUMENTS = 20_000, 20_000
FLUSH, LOT = 500_000, 1 << 20
_U = np.uint64
_LENGTHS = _U(0xD6E8FEB86659FD93)
_PLACES = _U((1 << 31) - 1)  # no text has more words
_SECOND = _U(0xA4093822299F31D0)  # sets the second phrase hash apart from the first


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and which text it is in."""
    raw = b"\n".join(texts)
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    border = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = border[::2], border[1::2]
    sums = prefix_sums(data)
    h = mix((sums[end] - sums[start]) * inverses(len(data) + 1)[start] + (end - start).astype(_U) * _LENGTHS)
    return h, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")


def _rolling(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` numbers."""
    sums = np.zeros(len(h) + 1, _U)
    np.cumsum(h * powers(len(h)), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * inverses(len(h) - size + 1))


def chosen(h: np.ndarray, of: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Choices of documents with word hashes ``h``: document, two phrase hashes, the phrase's first word, first window, how many windows.

    ``of`` says which document each word is in; words and windows are counted from its first word.
    """
    n = len(h) - WINDOW + 1
    if n <= 0:
        return {k: np.zeros(0, _U if k in "gc" else np.int64) for k in ("of", "g", "c", "at", "q", "n")}
    of = np.zeros(len(h), np.int64) if of is None else of
    g = _rolling(mix(h), PHRASE)
    # hash above, place below: the least of a window is its leftmost least hash
    least = (g & ~_PLACES) | np.arange(len(g), dtype=_U)
    width, have = WINDOW - PHRASE + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    at = (np.minimum(least[:n], least[width - have: width - have + n]) & _PLACES).astype(np.int64)
    inside = of[:n] == of[WINDOW - 1:]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:n] != of[: n - 1])])
    first = np.flatnonzero(inside & (new | np.concatenate([[True], ~inside[:-1]])))
    last = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    c = _rolling(mix(h ^ _SECOND), PHRASE)[at[first]]
    begin = np.searchsorted(of, of[first])
    return {"of": of[first], "g": g[at[first]] & _LOW48, "c": c & _LOW48, "at": at[first] - begin, "q": first - begin, "n": last - first + 1}


def window_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every window."""
    return _rolling(mix(h ^ _U(0x243F6A8885A308D3)), WINDOW), _rolling(mix(h ^ _U(0x13198A2E03707344)), WINDOW)


def _choices(buckets: int):
    """Texts to packed choices."""
    def run(batches):
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def flush():
            rows = _joined(held)
            held.clear()
            bucket = (mix(rows["g"].astype(_U)) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            yield from _emit((int(bucket[order[low]]), pack({k: v[order[low:high]] for k, v in rows.items()})) for low, high in zip(edges, np.append(edges[1:], len(order))))

        for batch in batches:
            raw, at = utf8_column(batch.column(2))
            row, doc = (np.array(batch.column(i).to_pylist(), np.int64) for i in range(2))
            low = 0
            while low < len(row):
                high = min(len(row), max(low + 1, int(np.searchsorted(at, at[low] + LOT))))
                found = chosen(*word_hashes([raw[at[i]: at[i + 1]] for i in range(low, high)]))
                n = len(found["g"])
                of = found["of"] + low
                held.append({"g": found["g"].view(np.int64), "c": found["c"].view(np.int64), "q": found["at"], "x": np.zeros(n, np.int64), "n": np.zeros(n, np.int64), "row": row[of], "doc": doc[of]})
                size += n
                low = high
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return run


def _repeated(*keys: np.ndarray) -> np.ndarray:
    """Which of the sorted keys stand beside an equal one."""
    new = np.append(_groups(*keys)[0], True)
    return ~(new[1:] & new[:-1])


def recurring(batches):
    """One partition of buckets: choices of phrases chosen more than once, with the row that leads the phrase."""
    parts = [unpack(b)[0] for batch in batches for b in batch.column(1).to_pylist()]
    if not parts:
        return
    rows = _joined(parts)
    order = np.argsort(rows["g"], kind="stable")
    order = order[_repeated(rows["g"][order])]
    order = order[np.lexsort((rows["q"][order], rows["row"][order], rows["doc"][order], rows["c"][order], rows["g"][order]))]
    order = order[_repeated(rows["g"][order], rows["c"][order])]
    if not len(order):
        return
    new, group = _groups(rows["g"][order], rows["c"][order])
    row, q = rows["row"][order], rows["q"][order]
    lead = row[np.flatnonzero(new)][group]
    for at in range(0, len(order), 200_000):
        s = slice(at, at + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(row[s]), pa.array(q[s].astype(np.int32)), pa.array(lead[s]), pa.array(new[s])], ["row", "at", "lead_row", "leads"])


def plain(raw: bytes) -> tuple[str, list[bytes]]:
    """The words with single blanks between and around them."""
    found = raw.split()
    return f" {b' '.join(found).decode('utf-8', 'replace')} ", found


def _route(batches):
    """Documents to the shards they visit; phrases of a leading document to every task of their shard, ahead of documents."""
    names = ["shard", "salt", "kind", "row", "doc", "text"]
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        out, size = [], 0
        for row, doc, text, shards, leads in zip(*(batch.column(i) for i in range(5))):
            row, doc, text = row.as_py(), doc.as_py(), text.as_py()
            raw = text.encode("utf-8", "surrogatepass")
            found = plain(raw)[1] if len(leads) else []
            for lead in leads.as_py():
                phrase = plain(b" ".join(found[lead["at"]: lead["at"] + PHRASE]))[0]
                out += [(lead["shard"], salt, 0, row, doc, phrase) for salt in range(lead["tasks"])]
                size += len(phrase) * lead["tasks"]
            for s in shards.as_py():
                out.append((s["shard"], row % s["tasks"], 1, row, doc, text))
                size += len(text)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)


class _Shard:
    """One task's part of a shard: the automaton, then the windows found so far."""

    def __init__(self):
        self.automaton, self.ready = ahocorasick.Automaton(), False
        self.found: list[tuple] = []

    def add(self, phrase: str) -> None:
        self.automaton.add_word(phrase, len(phrase))

    def search(self, row: int, doc: int, raw: bytes) -> None:
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        line = b" %b " % b" ".join(raw.split())
        text = line.decode("utf-8", "replace")
        hits = np.array([end - size + 1 for end, size in self.automaton.iter(text)], np.int64) if len(self.automaton) else np.zeros(0, np.int64)
        if not len(hits):
            return
        signs = np.frombuffer(line, np.uint8)
        begins = np.flatnonzero(signs == 32)[:-1]  # the blank before each word, as the count of characters before it
        if len(text) != len(line):
            begins = begins - np.cumsum(signs & 0xC0 == 0x80)[begins]
        places = np.searchsorted(begins, hits)
        h = word_hashes([raw])[0]
        own = chosen(h)
        pick = np.flatnonzero(np.isin(own["at"], places))
        if not len(pick):
            return
        many = own["n"][pick]
        q = np.repeat(own["q"][pick] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
        a, b = window_hashes(h)
        self.found.append((a[q], b[q], np.full(len(q), doc, np.int64), np.full(len(q), row, np.int64), q))

    def result(self, alone: bool):
        """Runs of covered windows; where other tasks share the shard, also the windows that are first here."""
        if not self.found:
            return
        a, b, doc, row, q = (np.concatenate([f[i] for f in self.found]) for i in range(5))
        order = np.lexsort((q, row, doc, b, a))
        a, b, doc, row, q = a[order], b[order], doc[order], row[order], q[order]
        new, group = _groups(a, b)
        again = ~new & np.concatenate([[False], row[1:] == row[:-1]])
        hit = (doc > doc[np.flatnonzero(new)][group]) | again
        yield from _runs(row[hit], q[hit])
        if not alone:
            for s in _slices(np.flatnonzero(~hit)):
                yield pa.RecordBatch.from_arrays([pa.array(row[s]), pa.array(q[s]), pa.array(np.ones(len(s), np.int64)), pa.array(a[s].view(np.int64)), pa.array(b[s].view(np.int64)), pa.array(doc[s])], _FOUND)


_FOUND = ["row", "q", "n", "a", "b", "doc"]


def _slices(index: np.ndarray, size: int = 200_000):
    return (index[at: at + size] for at in range(0, len(index), size))


def _runs(row: np.ndarray, q: np.ndarray):
    if not len(row):
        return
    order = np.lexsort((q, row))
    row, q = row[order], q[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (q[1:] > q[:-1] + 1)]))
    n = q[np.append(first[1:], len(row)) - 1] - q[first] + 1
    for s in _slices(np.arange(len(first))):
        none = pa.nulls(len(s), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(row[first[s]]), pa.array(q[first[s]]), pa.array(n[s]), none, none, none], _FOUND)


def locate(batches):
    """Rows sorted by shard, task and kind: phrases first, then the documents to search."""
    key, shard = None, None
    for batch in batches:
        for number, salt, kind, row, doc, text, tasks in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if key != (number, salt):
                if shard is not None:
                    yield from shard.result(key_tasks == 1)
                key, shard, key_tasks = (number, salt), _Shard(), tasks
            if kind == 0:
                shard.add(text)
            else:
                shard.search(row, doc, text.encode("utf-8", "surrogatepass"))
    if shard is not None:
        yield from shard.result(key_tasks == 1)


def covered(docs: DataFrame, shard_phrases: int = SHARD_PHRASES, task_documents: int = TASK_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Texts ``(row, doc, text)`` and runs ``(row, q, n)`` of windows that also start earlier."""
    parts = shuffle_partitions(docs.sparkSession)
    texts = docs.select("row", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = texts.mapInArrow(_choices(8 * parts), "bucket int, block binary")
    choices = settle(blocks.repartition(parts, "bucket").mapInArrow(recurring, "row long, at int, lead_row long, leads boolean"))
    shards = max(1, -(-choices.where("leads").count() // shard_phrases))
    placed = choices.withColumn("shard", F.pmod(F.xxhash64("lead_row"), F.lit(shards)).cast("int"))
    visits = settle(placed.groupBy("row", "shard").agg(F.collect_list(F.when(F.col("leads"), F.col("at"))).alias("leads")))
    tasks = settle(visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(task_documents))).cast("int").alias("tasks")))
    routes = visits.join(tasks, "shard").groupBy("row").agg(
        F.collect_list(F.struct("shard", "tasks")).alias("shards"),
        F.flatten(F.collect_list(F.transform("leads", lambda at: F.struct(at.alias("at"), F.col("shard"), F.col("tasks"))))).alias("leads"))
    routed = texts.join(routes, "row").select("row", "doc", "text", "shards", "leads").mapInArrow(_route, "shard int, salt int, kind int, row long, doc long, text string")
    dealt = routed.join(F.broadcast(tasks) if shards <= 100_000 else tasks, "shard").select("shard", "salt", "kind", "row", "doc", "text", "tasks")
    lined = dealt.repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind", "doc", "row")
    found = settle(lined.mapInArrow(locate, "row long, q long, n long, a long, b long, doc long"))
    shared = found.where("a is not null")
    first = shared.groupBy("a", "b").agg(F.min("doc").alias("first"))
    later = shared.join(first, ["a", "b"]).where("doc > first").select("row", "q", "n")
    return texts, found.where("a is null").select("row", "q", "n").unionByName(later)


RESULT = "row long, doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


def _finish(with_text: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = []
            for row, doc, text, runs in zip(*(batch.column(i) for i in range(4))):
                found = text.as_py().encode("utf-8", "surrogatepass").split()
                spans: list[list[int]] = []
                for run_ in sorted((r["q"], r["n"]) for r in runs.as_py() or []):
                    low, high = run_[0], run_[0] + run_[1] - 1 + WINDOW
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
                edges = [0, *[e for s in spans for e in s], len(found)]
                kept = b" ".join(w for a, b in zip(edges[::2], edges[1::2]) for w in found[a:b])
                out.append((row.as_py(), doc.as_py(), len(found), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans],
                            kept.decode("utf-8", "replace") if with_text else hashlib.sha256(kept).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), kind, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["row", "doc_id", "n_words", "n_removed", "spans", "kept"])

    return run


def removed(docs: DataFrame, with_text: bool = True, **sizes) -> DataFrame:
    """``RESULT`` for ``docs(row, doc_id, text)``; ``kept`` holds the remaining words, or their hex digest."""
    texts, runs = covered(docs, **sizes)
    per = runs.groupBy("row").agg(F.collect_list(F.struct("q", "n")).alias("runs"))
    done = texts.join(per, "row", "left").select("row", "doc", "text", "runs").mapInArrow(_finish(with_text), RESULT)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))


def keyed(docs: DataFrame) -> DataFrame:
    return with_rows(docs.select("doc_id", "text"), "row").select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(keyed(documents(spark, sf_dir)), with_text=False).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
