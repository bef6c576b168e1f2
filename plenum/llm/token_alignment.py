"""Alignment of two tokenizers by the spans their libraries report.

Both vocabularies cut the same bytes: a blank and the text. Where a token of the byte-level vocabulary (A) and a
piece of the SentencePiece vocabulary (B) end at one byte, the text is cut into a group and the two are linked.

*Coarse cuts* are the libraries' own spans: character offsets of `tokenizers`, byte spans of SentencePiece's proto.
*Refinement*: tokens whose spans overlap or are empty (parts of a multibyte character, byte fallback) form a run
between two sure cuts; inside it the tokens' decoded bytes are laid one after the other. A run whose tokens do not
spell its bytes shows that the texts differ, and such a document has no tokens.

*Chunks.* No token of either vocabulary reaches across the start of a single blank or line end that stands between
two characters that are not white space (A's pattern and B's pieces are such; B is checked when it is loaded), so a
text falls into chunks that are aligned once and kept in a bounded store of the worker. New chunks are encoded many
at a time, as one text. Groups end at chunk ends, hence a document's groups are its chunks'.

*Links.* The shorter token of a link is a suffix of the longer, so the vocabularies themselves bound the possible
pairs (one for each suffix of an entry that the other vocabulary has, some hundred thousand). Pairs are numbered on
that ground alone, alike everywhere. A first pass writes every document's distinct links and how often they occur;
tasks add them up as dense vectors, Spark sums these, and the vector of corpus-wide counts, whose size the
vocabularies prove, is broadcast to the second pass. The texts are tokenized once.

Defined cases: null and empty texts, and texts that B's normaliser changes or that hold B's blank sign, have no
tokens and zeros; special strings inside a text are plain text; a text of any length is taken whole; repeated rows
count and are answered one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.common import documents, settle
from plenum.llm.token_counts import vocabulary

NAME = "op12_tokenizer_spans"
ORACLE = None  # tokenizers have no SQL
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MARK = "▁"
STORE_CHUNKS, STORE_LINKS, STORE_LENGTH = 400_000, 4_000_000, 64
SLICE, ENCODE = 2 << 20, 1 << 14  # characters taken at a time from texts, and to the libraries


def byte_signs() -> dict[str, int]:
    """The sign of every byte in byte-level entries: itself where printable, else the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Both vocabularies: libraries, the bytes of every entry, and the numbers of all possible links."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a.decode("utf-8")), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        sign = byte_signs()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(sign[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        whole = [p for i, p in enumerate(pieces) if not self.b.IsByte(i)]
        if any(MARK in p.lstrip(MARK) or "\n" in p[1:] for p in whole):
            raise ValueError("pieces that cross a blank or a line end cannot be aligned chunk by chunk")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.IsByte(i) else p.replace(MARK, " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        numbers = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.written = [np.array([n + sign for n in numbers], object) for sign in ",|;"]
        self.digits = np.array([len(n) + 1 for n in numbers], np.int64)
        self.codes = self._links()

    def _links(self) -> np.ndarray:
        """Sorted codes ``a * pieces + b`` of all links that can be: one entry is a suffix of the other."""
        a_of, b_of = {}, {}
        for table, of in ((self.a_bytes, a_of), (self.b_bytes, b_of)):
            for i, x in enumerate(table):
                of.setdefault(x, []).append(i)
        found = set()
        for table, other, code in ((self.a_bytes, b_of, lambda i, j: (i, j)), (self.b_bytes, a_of, lambda i, j: (j, i))):
            for i, x in enumerate(table):
                for at in range(len(x)):
                    found.update(code(i, j) for j in other.get(x[at:], ()))
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pairs[:, 0] * len(self.b_bytes) + pairs[:, 1]

    def lot(self, keys: list[str]):
        """Of chunks that stand alone: ``(A's tokens, B's tokens, groups)``, the groups in writing, the links of all.

        The chunks are encoded as one text behind a chunk of its own; None where the tokens do not spell it.
        """
        data = [" a", *map(chunk_of, keys)]
        text = "".join(data)
        raw = text.encode("utf-8")
        x, pieces = self.a.encode(text, add_special_tokens=False), self.b.encode(text[1:], return_type="proto").pieces
        a, b = np.array(x.ids), np.array([p.id for p in pieces])
        spans = np.fromiter(chain.from_iterable(x.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
        ends = np.cumsum([len(d) for d in data])
        if len(raw) != len(text):
            spans, ends = byte_places(text)[spans], byte_places(text)[ends]
        cuts = np.array([p.end for p in pieces]) + 1  # the blank of the first chunk is the one that the library adds
        a_ends = refined_all(spans[:, 0], spans[:, 1], a, self.a_sizes)
        b_ends = refined_all(np.concatenate([[0], cuts[:-1]]), cuts, b, self.b_sizes)
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        closes = np.searchsorted(both, ends)
        if (b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw
                or closes[-1] >= len(both) or not np.array_equal(both[closes], ends)):
            return None
        ga, gb = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        na, nb = np.bincount(ga, minlength=len(both)).cumsum(), np.bincount(gb, minlength=len(both)).cumsum()
        last_a, last_b = na - 1, nb - 1
        place_a, place_b = np.arange(len(a)) + np.concatenate([[0], nb[:-1]])[ga], np.arange(len(b)) + na[gb]
        signs, sizes = np.empty(len(a) + len(b), object), np.empty(len(a) + len(b), np.int64)
        signs[place_a], signs[place_b] = self.written[0][a], self.written[0][b]
        signs[place_a[last_a]], signs[place_b[last_b]] = self.written[1][a[last_a]], self.written[2][b[last_b]]
        sizes[place_a], sizes[place_b] = self.digits[a], self.digits[b]
        line, upto = "".join(signs.tolist()), sizes.cumsum()[(na + nb)[closes] - 1].tolist()
        groups = [line[low: high - 1] for low, high in zip(upto, upto[1:])]
        counts = np.diff(np.stack([na[closes], nb[closes], closes + 1], axis=1), axis=0)
        return counts, groups, (a[last_a] * len(self.b_bytes) + b[last_b])[closes[0] + 1:]

    def alone(self, key: str):
        """``lot`` for one chunk of any kind, behind the same first chunk; no tokens where they do not spell it."""
        text = " a" + chunk_of(key)
        data = text.encode("utf-8")
        x, pieces = self.a.encode(text, add_special_tokens=False), self.b.encode(text[1:], return_type="proto").pieces
        at = byte_places(text).tolist()
        ids = [p.id for p in pieces]
        # the first piece also stands for the blank that the library adds; all other spans lie one byte further on
        a_ends = refined([(at[s], at[e]) for s, e in x.offsets], [self.a_bytes[i] for i in x.ids], data)
        b_ends = refined([(p.begin + 1 if k else 0, p.end + 1) for k, p in enumerate(pieces)], [self.b_bytes[i] for i in ids], data)
        if a_ends is None or b_ends is None:
            return np.zeros((1, 3), np.int64), [""], np.zeros(0, np.int64)
        both = set(a_ends).intersection(b_ends)
        a, b = _cut(x.ids, a_ends, both)[1:], _cut(ids, b_ends, both)[1:]
        groups = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in zip(a, b))
        return np.array([[sum(map(len, a)), sum(map(len, b)), len(a)]]), [groups], np.array([p[-1] * len(self.b_bytes) + q[-1] for p, q in zip(a, b)], np.int64)

    def aligned(self, keys: list[str]):
        """``lot`` for chunks of all kinds, lot by lot; yields ``(keys, counts, groups, links)``."""
        plain = [k for k in keys if not k[0].isspace() and not k[-1].isspace() or k[0] == "\n" and k[1:2] and not k[1].isspace() and not k[-1].isspace()]
        at = 0
        while at < len(plain):
            end, size = at, 0
            while end < len(plain) and (end == at or size + len(plain[end]) < ENCODE):
                size += len(plain[end]) + 1
                end += 1
            found = self.lot(plain[at:end])
            for part, some in [(plain[at:end], found)] if found else [([k], self.alone(k)) for k in plain[at:end]]:
                yield part, *some
            at = end
        stand = set(plain)
        for k in keys:
            if k not in stand:
                yield [k], *self.alone(k)


def chunk_of(key: str) -> str:
    """The chunk that a key names: its own white space and text, or a blank and the text."""
    return key if key[0] in " \n" else " " + key


def byte_places(text: str) -> np.ndarray:
    """Where each character starts in UTF-8, and the end."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))])


def refined_all(starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """End bytes of many tokens: sure cuts as the spans give them, between them the decoded bytes one by one."""
    before = np.concatenate([[0], np.maximum.accumulate(ends)[:-1]])
    sure = (ends > before) & np.concatenate([starts[1:] >= ends[:-1], [True]])
    upto = np.cumsum(sizes[ids])
    last = np.maximum.accumulate(np.where(sure, np.arange(len(ids)), -1))
    base = np.where(last >= 0, ends[last] - upto[last], 0)
    return np.where(sure, ends, base + upto)


def refined(spans: list[tuple[int, int]], tokens: list[bytes], data: bytes) -> list[int] | None:
    """End byte of every token; None where the tokens do not spell ``data``."""
    ends: list[int] = []
    low = first = 0
    last = len(tokens) - 1
    for i, (_, end) in enumerate(spans):
        if i < last and (spans[i + 1][0] < end or end <= low):
            continue  # shares a character with the next token, or stands for a part of one
        if i == last:
            end = len(data)
        if b"".join(tokens[first: i + 1]) != data[low:end]:
            return None
        for token in tokens[first:i]:
            low += len(token)
            ends.append(low)
        ends.append(end)
        low, first = end, i + 1
    return ends if low == len(data) else None


def _cut(ids: list[int], ends: list[int], both: set[int]) -> list[list[int]]:
    out: list[list[int]] = [[]]
    for i, end in zip(ids, ends):
        out[-1].append(i)
        if end in both:
            out.append([])
    return out[:-1]


CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def keys_of(text: str) -> list[str]:
    """Keys of the chunks of a text: cut before single blanks and line ends between characters that are no white space.

    A chunk that starts with its only blank goes by its text without it, any other by itself.
    """
    parts = text.split()
    between = text.count(" ") + text.count("\n")
    if len(parts) == between + 1 and sum(map(len, parts)) + between == len(text):
        return text.replace("\n", " \n").split(" ") if "\n" in text else parts
    return [c[1:] if c[0] == " " and c[1:2] and not c[1].isspace() else c for c in CUT.split(" " + text)]


class Store:
    """Aligned chunks of a worker, bounded by their number and their links."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes, self.links, self.starts = array("i"), array("i"), array("q", [0])

    def add(self, keys: list[str]) -> dict[str, int]:
        """Aligns new chunks; the long ones are numbered for this time only."""
        once: dict[str, int] = {}
        for part, counts, groups, codes in self.pair.aligned(keys):
            for i, key in enumerate(part, len(self.groups)):
                (self.number if len(key) <= STORE_LENGTH else once)[key] = i
            self.groups += groups
            self.sizes.frombytes(counts.astype(np.int32).tobytes())
            self.links.frombytes(np.searchsorted(self.pair.codes, codes).astype(np.int32).tobytes())
            self.starts.frombytes((self.starts[-1] + np.cumsum(counts[:, 2])).astype(np.int64).tobytes())
        return once

    def documents(self, texts: list[str | None]):
        """Of every text: tokens of A, of B, groups, the groups in writing; and (text, link, times) of all."""
        split = [keys_of(t) if t else [] for t in texts]
        known = self.number
        once = self.add([w for w in set().union(*split) if w not in known])
        if once:
            at = [[once[w] if w in once else known[w] for w in s] for s in split]
        else:
            at = [list(map(known.__getitem__, s)) for s in split]
        sizes, starts, links = np.array(self.sizes, np.int64).reshape(-1, 3), np.array(self.starts), np.array(self.links, np.int64)
        many = np.array([len(x) for x in at])
        flat = np.fromiter((i for x in at for i in x), np.int64, int(many.sum()))
        of = np.repeat(np.arange(len(at)), many)
        spoiled = np.zeros(len(at), bool)
        spoiled[of[sizes[flat, 2] == 0]] = True
        flat, of = flat[~spoiled[of]], of[~spoiled[of]]
        totals = np.stack([np.bincount(of, sizes[flat, k], len(at)).astype(np.int64) for k in range(3)], axis=1) if len(at) else np.zeros((0, 3), np.int64)
        n = starts[flat + 1] - starts[flat]
        place = np.repeat(starts[flat] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        keys, times = np.unique(np.repeat(of, n) * len(self.pair.codes) + links[place], return_counts=True)
        written = ["" if bad else ";".join([self.groups[i] for i in x]) for x, bad in zip(at, spoiled)]
        if len(self.groups) > STORE_CHUNKS or len(self.links) > STORE_LINKS:
            self.clear()
        return totals, written, keys // len(self.pair.codes), keys % len(self.pair.codes), times


@lru_cache(maxsize=1)
def _store(name: str, a: bytes, b: bytes) -> Store:
    return Store(Pair(a, b))


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, links array<int>, times array<int>"


def aligned(docs: DataFrame, a: bytes, b: bytes, with_groups: bool = True) -> DataFrame:
    """``ALIGNED`` for every row of ``docs(doc_id, text)``; ``groups`` is written out, or its hex digest."""
    shared, name = docs.sparkSession.sparkContext.broadcast((a, b)), hashlib.sha256(a + b).hexdigest()

    def run(batches):
        store = _store(name, *shared.value)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, end, size = [], at, 0
                while end < batch.num_rows and size < SLICE:
                    texts.append(batch.column(1)[end].as_py())
                    size += len(texts[-1] or "")
                    end += 1
                totals, written, of, links, times = store.documents(texts)
                if not with_groups:
                    written = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
                offsets = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (links, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *[pa.array(totals[:, k]) for k in range(3)], pa.array(written, pa.string()), *lists],
                                                 ["doc_id", "n_a", "n_b", "n_groups", "groups", "links", "times"])
                at = end

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ALIGNED)


def _sums(size: int):
    """Links of one partition, added up as a dense vector."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            links, times = (batch.column(i).flatten().to_numpy() for i in range(2))
            total += np.bincount(links, times, size).astype(np.int64)
        held = np.flatnonzero(total)
        for low in range(0, len(held), 100_000):
            part = held[low: low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part])], ["link", "n"])

    return run


def link_counts(rows: DataFrame, pair: Pair) -> DataFrame:
    """``(a, b, n)``: how often every pair of ids is linked in the corpus, for ``aligned`` rows."""
    counts = rows.select("links", "times").mapInArrow(_sums(len(pair.codes)), "link int, n long").groupBy("link").agg(F.sum("n").alias("n"))
    codes, n_b = rows.sparkSession.sparkContext.broadcast(pair.codes), len(pair.b_bytes)

    def named(batches):
        for batch in batches:
            code = codes.value[batch.column(0).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(code // n_b), pa.array(code % n_b), batch.column(1)], ["a", "b", "n"])

    return counts.mapInArrow(named, "a long, b long, n long")


SCORED = "doc_id long, n_a long, n_b long, n_groups long, groups string, n_links long, n_best long, count_sum long"


def scored(rows: DataFrame, pair: Pair) -> DataFrame:
    """``SCORED`` for written ``aligned`` rows."""
    n_b, size = len(pair.b_bytes), len(pair.codes)
    counts = np.zeros(size, np.int64)
    found = link_counts(rows, pair).toArrow()  # at most one row per possible link, a bound the vocabularies prove
    code = found.column("a").to_numpy() * n_b + found.column("b").to_numpy()
    counts[np.searchsorted(pair.codes, code)] = found.column("n").to_numpy()
    highest = np.zeros(n_b, np.int64)
    np.maximum.at(highest, pair.codes % n_b, counts)
    shared = rows.sparkSession.sparkContext.broadcast((counts, counts == highest[pair.codes % n_b]))

    def run(batches):
        count, best = shared.value
        for batch in batches:
            links, times = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (5, 6))
            ends = np.cumsum(np.diff(batch.column(5).offsets.to_numpy()))
            out = []
            for value in (times, times * best[links], times * count[links]):
                upto = np.concatenate([[0], np.cumsum(value)])[np.concatenate([[0], ends])]
                out.append(pa.array(np.diff(upto), pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], *out], ["doc_id", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum"])

    return rows.mapInArrow(run, SCORED)


def align(docs: DataFrame, a: bytes | None = None, b: bytes | None = None, with_groups: bool = True) -> DataFrame:
    """``SCORED`` for ``docs``; ``groups`` is written out, or its hex digest."""
    a, b = vocabulary(FILE_A) if a is None else a, vocabulary(FILE_B) if b is None else b
    return scored(settle(aligned(docs, a, b, with_groups)), Pair(a, b))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(documents(spark, sf_dir), with_groups=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
