"""SentencePiece encoding and decoding with a Viterbi search that words share.

A text is normalised as its model says and cut into marked words (a run of word marks and what follows
up to the next mark: no piece goes across such a border, which is checked when a model is loaded). The
distinct words of a batch are sorted; read in that order they are a depth-first walk of their trie, so
the forward column of every prefix is computed once and stays on a stack for all words that share it.

The forward step depends on the model's kind. In a *unigram* model it is the plain Viterbi maximum over
pieces that end here, by the sum of piece scores. In a *merge* (BPE) model the scores are merge
priorities that cannot be added up; there a path may step from one piece to the next only if merging
their joint text leaves exactly these two, and a text has exactly one such path: the one that merging
gives. Both kinds therefore return what the reference library returns, which the tests confirm.

Characters without a piece fall back to byte pieces where the model has them, else to the unknown piece.
Decoding concatenates pieces and bytes, turns marks into blanks and drops the leading one that encoding
added. Nothing is shuffled: words are only unique per task, and each task keeps a bounded store of them.

Defined cases: null text gives null ids and a null decoded text; an empty text gives no ids; a text that
holds the mark sign itself or normalises to another text decodes to blanks or the normalised text, and
``round_trip`` says so; a lone surrogate becomes the replacement character; repeated rows are encoded one
by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.llm.common import documents

NAME = "op2_piece_viterbi"
ORACLE = None  # a segmentation search has no SQL
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MODEL_BYTES = 64 << 20  # a larger file is no piece vocabulary
MARK = "▁"
STORE_WORDS, STORE_LENGTH = 250_000, 64
CHUNK, LEAN_CHUNK = 8 << 20, 1 << 20  # characters whose words are held at once; large chunks share more columns
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(data: bytes) -> dict[int, list]:
    """Fields of a protocol-buffer message: numbers as they are, nested messages and strings as bytes."""
    out: dict[int, list] = {}
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            value, at = data[at: at + size], at + size
        out.setdefault(key >> 3, []).append(value)
    return out


class Vocabulary:
    """A model's pieces, and what its file says about how to use them."""

    def __init__(self, model: bytes):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        message = _fields(model)
        trainer = _fields(message[2][0])
        rules = _fields(message.get(3, [b""])[0])
        self.merges = trainer.get(3, [1])[0] == 2
        self.prefix_mark = bool(rules.get(3, [1])[0])
        size = sp.get_piece_size()
        kinds = [_fields(x).get(3, [1])[0] for x in message[1]]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
        if 4 in kinds:
            raise ValueError("models with user-defined pieces are not supported")
        self.ids = {sp.id_to_piece(i): i for i in range(size) if kinds[i] == 1}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.unknown = sp.unk_id()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if kinds[i] == 6}
        ends: dict[str, set[int]] = {}  # the last two characters of longer pieces, and how long such pieces are
        for piece in self.ids:
            if len(piece) > 1:
                ends.setdefault(piece[-2:], set()).add(len(piece))
        self.lengths = {k: sorted(v, reverse=True) for k, v in ends.items()}
        self.penalty = min(self.scores.values(), default=0.0) - 10.0
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.text = [b"" if kinds[i] == 3 else " ⁇ ".encode() if kinds[i] == 2 else
                     bytes([int(sp.id_to_piece(i)[3:5], 16)]) if kinds[i] == 6 else sp.id_to_piece(i).replace(MARK, " ").encode("utf-8") for i in range(size)]
        self._apart: dict[tuple[str, str] | str, bool] = {}  # also: pieces that merging makes of their own text

    def words(self, text: str) -> list[str]:
        marked = self.library.normalize(text)
        return WORDS.findall(marked) if self.splits else [marked] if marked else []

    def merged(self, text: str) -> list[str]:
        """Merge rule on a short text: best-scored neighbours first, the leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Whether merging leaves these two pieces side by side."""
        key = (left, right)
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= 1_000_000:
                self._apart.clear()
            known = self._apart[key] = self.merged(left + right) == [left, right]
        return known

    def id_bytes(self, pieces: list[str]) -> bytes:
        out, unknown_before = array("i"), False
        for piece in pieces:
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode("utf-8"))
            elif not unknown_before:
                out.append(self.unknown)
            unknown_before = known is None
        return out.tobytes()

    def encode_sorted(self, words: list[str]):
        """Yields ``(word, id bytes)`` for words in sorted order, sharing forward columns along common prefixes."""
        before = ""
        cut, best = [0], [0.0]  # per prefix: length of its last piece, score of its best path
        step = self._last_merged if self.merges else self._last_scored
        ids = self.ids
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del cut[shared + 1:], best[shared + 1:]
            step(word, shared + 1, cut, best)
            end, pieces = len(word), []
            while end:
                start = end - cut[end]
                pieces.append(word[start:end])
                end = start
            pieces.reverse()
            try:
                yield word, array("i", map(ids.__getitem__, pieces)).tobytes()
            except KeyError:
                yield word, self.id_bytes(pieces)
            before = word

    def _last_scored(self, word: str, first: int, cut: list[int], best: list[float]) -> None:
        """Forward columns by the sum of scores; of equal paths the one with the longer last piece stays."""
        scores, lengths = self.scores, self.lengths
        for end in range(first, len(word) + 1):
            top, length = None, 1
            for n in lengths.get(word[max(0, end - 2): end], ()):
                if n <= end:
                    score = scores.get(word[end - n: end])
                    if score is not None and (top is None or best[end - n] + score > top):
                        top, length = best[end - n] + score, n
            one = best[end - 1] + scores.get(word[end - 1], self.penalty)
            if top is None or one > top:
                top, length = one, 1
            cut.append(length)
            best.append(top)

    def _last_merged(self, word: str, first: int, cut: list[int], best: list[float]) -> None:
        """Forward columns of the one path whose neighbours merging leaves apart."""
        ids, lengths, known = self.ids, self.lengths, self._apart
        for end in range(first, len(word) + 1):
            length = 1
            for n in lengths.get(word[max(0, end - 2): end], ()):
                if n > end:
                    continue
                start = end - n
                piece = word[start:end]
                if piece not in ids:
                    continue
                if start == 0:
                    fits = known.get(piece)
                    if fits is None:
                        fits = known[piece] = self.merged(piece) == [piece]
                else:
                    left = word[start - cut[start]: start]
                    fits = known.get((left, piece))
                    if fits is None:
                        fits = self.apart(left, piece)
                if fits:
                    length = n
                    break
            cut.append(length)

    def decode(self, ids) -> str:
        out = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.prefix_mark and out.startswith(" ") else out


def read_model(path: str = MODEL_FILE) -> bytes:
    """Bytes of a model file on the driver; refused when too large to send to every task."""
    with open(path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return data


class Store:
    """Words met lately and their ids: two generations, the older one forgotten when the younger is full."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, words: set[str]) -> list[str]:
        """Takes over what the older generation knows; returns the others."""
        young, old = self.young, self.old
        absent = []
        for word in words:
            if word not in young:
                known = old.get(word)
                if known is None:
                    absent.append(word)
                else:
                    young[word] = known
        return absent

    def age(self, long_words: list[str]) -> None:
        for word in long_words:  # rarely met again
            self.young.pop(word, None)
        if len(self.young) > STORE_WORDS:
            self.old, self.young = self.young, {}


@lru_cache(maxsize=2)
def loaded(model: bytes) -> tuple[Vocabulary, Store]:
    """A model and its words, kept by a worker process from task to task."""
    return Vocabulary(model), Store()


def encode_texts(vocabulary: Vocabulary, texts: list, store: Store) -> list:
    """Int32 bytes per text; ``store`` keeps words between calls."""
    split = [None if t is None else vocabulary.words(t.encode("utf-8", "replace").decode("utf-8")) for t in texts]
    new = store.missing({w for words in split if words for w in words})
    new.sort()
    store.young.update(vocabulary.encode_sorted(new))
    look = store.young.__getitem__
    out = [None if words is None else b"".join(map(look, words)) for words in split]
    store.age([w for w in new if len(w) > STORE_LENGTH])
    return out


def _lists(parts: list) -> pa.Array:
    """Int32 bytes per text as one list column."""
    offsets, total = [], 0
    for part in parts:
        offsets.append(None if part is None else total)
        total += len(part or b"") // 4
    flat = pa.array(memoryview(b"".join(p for p in parts if p)).cast("i"), pa.int32()) if total else pa.array([], pa.int32())
    return pa.ListArray.from_arrays(pa.array([*offsets, total], pa.int32()), flat)


def encoded(docs: DataFrame, model: bytes | None = None, keep: bool = True) -> DataFrame:
    """``docs``, with its columns, and ``piece_ids``, ``n_pieces``, ``decoded_text`` and ``round_trip``; own columns of these names give way.

    With ``keep`` a worker process holds the model and the words met from task to task; without, a task gives them back
    at its end and holds the words of less text at once, so that other work on the executor has the memory.
    """
    chunk = CHUNK if keep else LEAN_CHUNK
    shared = docs.sparkSession.sparkContext.broadcast(read_model() if model is None else model)
    new = T.StructType.fromDDL("piece_ids array<int>, n_pieces long, decoded_text string, round_trip boolean")
    docs = docs.select(*[c for c in docs.columns if c.lower() not in new.names])
    at, schema = docs.columns.index("text"), T.StructType([*docs.schema.fields, *new.fields])

    def run(batches):
        vocabulary, store = loaded(shared.value) if keep else (Vocabulary(shared.value), Store())
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                part, high, size = [], low, 0
                while high < batch.num_rows and size < chunk:
                    part.append(batch.column(at)[high].as_py())
                    size += len(part[-1] or "")
                    high += 1
                ids = encode_texts(vocabulary, part, store)
                decoded = [None if x is None else vocabulary.decode(array("i", x)) for x in ids]
                found = [_lists(ids), pa.array([None if x is None else len(x) // 4 for x in ids], pa.int64()), pa.array(decoded, pa.string()),
                         pa.array([None if d is None else d == t for d, t in zip(decoded, part)], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, *found], [*batch.schema.names, *new.names])
                low = high

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return encoded(docs).select("doc_id", F.col("n_pieces").alias("n_ids"), F.col("piece_ids").alias("ids"), "round_trip", F.sha2(F.col("decoded_text"), 256).alias("decoded_sha256"))
