"""Token counts behind a cache of digests.

A document's content is reduced to a normal form that the tokenizer cannot tell from the text, and to the digest
of that form. Digest and tokenizer version (a digest of the vocabulary file and the library's version) are joined
to stored counts; only contents without one are encoded, each once, and their counts are appended to the cache, a
Parquet table with one folder per tokenizer version. A count is therefore paid once per content and version,
whatever the number of copies, documents or runs.

*Normal form.* A vocabulary whose rules drop white space and never look across it (``words_apart`` reads that from
the file) gives the same number for a text and for its words joined by single blanks; other vocabularies keep the
text as it is. Words are runs without ASCII white space, ``[^\\x20\\x09-\\x0D]+``.

*Misses.* Contents that miss are reduced to one text per digest, in each task first, so a text that fills a third
of the corpus travels once per task and is encoded once. Where words stand apart, a worker counts each distinct
word once and keeps a bounded store of counts (two generations). When few contents miss, their digests are
broadcast after a check of rows and bytes and the other texts never leave their scan.

*Answer.* Every document meets the count of its digest. Digests that hold more than a thousandth of all rows are
at most a thousand, so their counts are broadcast; all others are joined by digest.

The cache is written by Spark's committer: a lost executor repeats its tasks, a lost driver leaves no half-written
file in sight, and two runs that store one digest twice do no harm, since reading takes one row per digest.

Defined cases: null counts as empty, an empty text has no tokens; texts of any length are counted whole; special
strings inside a text are what the library makes of them by default; repeated rows are answered one by one, a null
id is an id like any other; an empty table gives an empty result and stores nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.common import documents, join_facts, path_exists, scratch_path, settle
from plenum.skew import small

NAME = "op11_token_count_cache"
ORACLE = None  # a tokenizer has no SQL
VOCABULARY = "word_bpe_49k.json"  # a path, or the name of a file of the public vocabularies
VOCABULARY_BYTES = 64 << 20  # a larger file is no vocabulary
LIMIT = 2048
STORE_WORDS, STORE_LENGTH = 250_000, 64
SLICE = 4 << 20
CACHED = "digest binary, n_tokens long, tokenizer string"


def vocabulary(path: str = VOCABULARY) -> bytes:
    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary")
    with open(path, "rb") as file:
        return file.read()


def version(data: bytes) -> str:
    """What a stored count depends on besides the content."""
    import tokenizers

    return hashlib.sha256(data + f"tokenizers {tokenizers.__version__}".encode()).hexdigest()


def words_apart(data: bytes) -> bool:
    """Whether white space is dropped and nothing is matched across it, as far as the file's rules show.

    True only for the rule sets known to be so: normalisers that work inside words or squeeze white space, and a
    first split that removes everything but matches of a pattern whose parts cannot hold white space.
    """
    rules = json.loads(data)
    normal = rules.get("normalizer") or {"type": "Sequence", "normalizers": []}
    local = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "
                for n in normal.get("normalizers", [normal]))
    before = rules.get("pre_tokenizer") or {}
    first = (before.get("pretokenizers") or [before])[0]
    parts = first.get("pattern", {}).get("Regex", " ") if first.get("type") == "Split" else " "
    alone = all(p.startswith("'") and p[1:].isalpha() or p in ("[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+") for p in parts.split("|"))
    added = all(not t["lstrip"] and not t["rstrip"] and not t["normalized"] and not set(t["content"]) & set(" \t\n\v\f\r") for t in rules.get("added_tokens", []))
    plain = rules.get("post_processor") is None and rules.get("truncation") is None and rules.get("padding") is None
    return local and first.get("invert") is True and first.get("behavior") == "Removed" and alone and added and plain


class Counter:
    """Counts of one vocabulary, with a bounded store of words."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.apart = Tokenizer.from_str(data.decode("utf-8")), words_apart(data)
        self.library.no_truncation()
        self.library.no_padding()
        self.new: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def encode(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        at = 0
        while at < len(texts):  # as many texts at a time as memory for their encodings allows
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < 1 << 19):
                size += len(texts[end])
                end += 1
            out += [len(e.ids) for e in self.library.encode_batch_fast(texts[at:end], add_special_tokens=False)]
            at = end
        return out

    def counts(self, texts: list[str]) -> list[int]:
        if not self.apart:
            return self.encode(texts)
        split = [t.encode("utf-8", "replace").split() for t in texts]
        seen, known = {}, self.new
        for word in set().union(*split):
            n = known.get(word)
            if n is None:
                n = self.old.get(word)
                if n is not None:
                    known[word] = n
            seen[word] = n
        missing = [w for w, n in seen.items() if n is None]
        for word, n in zip(missing, self.encode([w.decode("utf-8") for w in missing])):
            seen[word] = n
            if len(word) <= STORE_LENGTH:
                known[word] = n
        if len(known) > STORE_WORDS:
            self.new, self.old = {}, known
        return [sum(map(seen.__getitem__, words)) for words in split]


@lru_cache(maxsize=1)
def _counter(version_: str, data: bytes) -> Counter:
    return Counter(data)


def encode_texts(texts: DataFrame, data: bytes) -> DataFrame:
    """``(digest, text)`` to ``(digest, n_tokens)``."""
    shared, name = texts.sparkSession.sparkContext.broadcast(data), version(data)

    def run(batches):
        counter = _counter(name, shared.value)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held, end, size = [], at, 0
                while end < batch.num_rows and size < SLICE:
                    held.append(batch.column(1)[end].as_py() or "")
                    size += len(held[-1])
                    end += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(counter.counts(held), pa.int64())], ["digest", "n_tokens"])
                at = end

    return texts.mapInArrow(run, "digest binary, n_tokens long")


def normal_form(text, apart: bool):
    """The text as far as the vocabulary can see it."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")) if apart else text


def digests(docs: DataFrame, apart: bool) -> DataFrame:
    form = normal_form(F.col("text"), apart)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(form.cast("binary"), 256)).alias("digest"),
                       F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_bytes"), form.alias("text"))


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """``(digest, n_tokens)`` of one version; nothing where the cache does not exist yet."""
    rows = spark.read.schema(CACHED).parquet(cache) if path_exists(spark, cache) else spark.createDataFrame([], CACHED)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def counted(docs: DataFrame, cache: str, data: bytes | None = None) -> DataFrame:
    """``(doc_id, digest, n_bytes, n_tokens)`` of every row of ``docs``; ``cache`` is a folder all executors reach."""
    spark, data = docs.sparkSession, vocabulary() if data is None else data
    tokenizer, whole = version(data), digests(docs, words_apart(data))
    keys = settle(whole.drop("text"))
    held = settle(keys.groupBy("digest").agg(F.count(F.lit(1)).alias("rows_held")))
    missing = settle(held.select("digest").join(stored(spark, cache, tokenizer), "digest", "left_anti"))
    hinted = small(missing)
    texts, one = whole.select("digest", "text"), lambda rows: rows.groupBy("digest").agg(F.first("text").alias("text"))
    texts = one(texts).join(missing, "digest", "left_semi") if hinted is missing else one(texts.join(hinted, "digest", "left_semi"))
    if not missing.isEmpty():
        encode_texts(texts, data).withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    return join_facts(keys, stored(spark, cache, tokenizer), held, "digest").select("doc_id", "digest", "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over a cache of its own, so that one measurement never lives on another's counts."""
    found = counted(documents(spark, sf_dir), scratch_path(spark, "token-counts"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
