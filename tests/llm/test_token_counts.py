import random

import pytest
from tokenizers import Tokenizer

from plenum.llm import token_counts as tc

PARTS = ["a", "B", "'s", "'", "'LL", "é", "é", "́", "ΑΣ", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "　", "​",
         "<|endoftext|>", "<|ENDOFTEXT|>", "<|start", "中", "1", "23", "!", "ﬁ", "😀", "\x00", "İ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(tc.vocabulary().decode())


def brute(library, rows):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    out = []
    for d, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        out.append((d, len((t or "").encode()), n, n > 2048))
    return sorted(out, key=key)


def test_words_add_up_to_their_text(library):
    rnd, counter = random.Random(5), tc.Counter(tc.vocabulary())
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 16))) for _ in range(3000)]
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_store_of_words_stays_bounded(library, monkeypatch):
    monkeypatch.setattr(tc, "STORE_WORDS", 5)
    counter = tc.Counter(tc.vocabulary())
    for i in range(40):
        text = f"w{i} w{i // 2} common " + "y" * 100
        assert counter.counts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]
    assert len(counter.new) + len(counter.old) < 20


def test_query_matches_the_library(spark, make_docs, store, library):
    long = "word é中 " * 4000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, " a  b\n"), (6, long), (7, long), (7, "twice"), (7, "twice"), (None, "no id"), (None, "no id"),
            (8, "<|endoftext|> in a text"), (9, "x" * 5000), (10, "A\x0bB\x1cC\x85D\xa0E")]
    rows += [(100 + i, "the same text in a third of all rows") for i in range(1500)] + [(5000 + i, f"other {i}") for i in range(1500)]
    got = tc.query(spark, store(make_docs(rows))).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0, *r[1:])) == brute(library, rows)


def test_cache_is_read_and_grows_by_misses(spark, make_docs, tmp_path, monkeypatch):
    cache, encoded = str(tmp_path / "cache"), []
    real = tc.encode_texts
    monkeypatch.setattr(tc, "encode_texts", lambda texts, data: encoded.append(texts.count()) or real(texts, data))
    first = make_docs([(1, "one two"), (2, "one  two\n"), (3, "three"), (4, None)])
    tc.counted(first, cache).collect()
    assert encoded == [3]  # two rows share a normal form
    stored = lambda: spark.read.parquet(cache).count()
    assert stored() == 3
    again = tc.counted(first, cache).collect()
    assert encoded == [3] and stored() == 3 and len(again) == 4
    more = tc.counted(make_docs([(9, "three"), (10, "four")]), cache).collect()
    assert encoded == [3, 1] and stored() == 4 and sorted(r.doc_id for r in more) == [9, 10]
    other = tc.vocabulary("byte_bpe_50k.json")
    assert not tc.words_apart(other)
    exact = tc.counted(first, cache, other).collect()
    whole = Tokenizer.from_str(other.decode())
    assert encoded == [3, 1, 4]  # white space counts for this one
    assert {r.doc_id: r.n_tokens for r in exact} == {i: len(whole.encode(t or "").ids) for i, t in first.select("doc_id", "text").collect()}


def test_double_entries_of_two_runs_count_once(spark, make_docs, tmp_path):
    cache = str(tmp_path / "cache")
    docs = make_docs([(1, "one two")])
    tc.counted(docs, cache).collect()
    spark.read.schema(tc.CACHED).parquet(cache).toPandas()
    rows = spark.createDataFrame(spark.read.schema(tc.CACHED).parquet(cache).collect(), tc.CACHED)
    rows.write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert tc.counted(docs, cache).count() == 1


def test_empty_table(spark, make_docs, store):
    got = tc.query(spark, store(make_docs([])))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == 0
