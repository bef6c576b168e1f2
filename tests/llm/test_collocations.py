import random
import re
from collections import Counter

import numpy as np
import pytest

from plenum.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                f.update(("und" if lang is None else lang, tuple(w[i: i + n])) for i in range(len(w) - n + 1))
    return f


def brute(rows, least=10, within=50, top=2000):
    f, out = counts(rows), []
    for lang in {k for k, _ in f}:
        words = sum(n for (g, p), n in f.items() if g == lang and len(p) == 1)
        cand = {p: n for (g, p), n in f.items() if g == lang and len(p) > 1 and n >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and any(q[i: i + len(p)] == p for i in range(len(q))) and 100 * n >= within * a for q, n in cand.items()):
                continue
            cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, i, phrase.decode(), -a, left, right, words, -score))
    return sorted(out)


def texts():
    rnd = random.Random(3)
    words = ["the", "of", "and", "a", "in", "é", "Straße", "\x1c", "don't", "x-y", "中文", "\x00", "\xa0", "😀"] + [f"w{i}" for i in range(40)]
    made = []
    for i in range(400):
        lang = rnd.choice(["en", "en", "en", "de", None, "und", ""])
        made.append((lang, "".join(rnd.choice(words[: rnd.choice([5, 14, 54])]) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " The Of "]) for _ in range(rnd.randint(0, 60)))))
    return made + [("en", None), ("en", ""), ("fr", " . , "), ("en", "the the the the the the the the the the the the the"), ("rare", "only once here")]


@pytest.fixture()
def tables(spark, store):
    def put(rows):
        full = [(i % 50, t, g, "s", 1, "x", "y", 5) for i, (g, t) in enumerate(rows)]
        return store(spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars int, phrase string, words string, n int"))

    return put


def test_query_matches_brute_force(spark, tables):
    rows = texts()
    got = sorted(map(tuple, co.query(spark, tables(rows)).collect()))
    assert got and got == brute(rows)


@pytest.mark.parametrize("common", [0, 3])
def test_order_and_lots_change_nothing(spark, common, monkeypatch):
    rows = texts()[:120]
    monkeypatch.setattr(co, "FLUSH_WORDS", 50)
    monkeypatch.setattr(co, "_BITS", 3)  # lots with more words than packed keys can hold
    docs = spark.createDataFrame([(t, g) for g, t in rows], "text string, lang string")
    got = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in co.frequent(docs, 2, common=common).where("words > 0").collect()}
    assert got == {k: n for k, n in counts(rows).items() if n >= 2}


def test_very_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(co, "PART_TEXT", 7)
    rnd = random.Random(8)
    rows = [("en", "".join(rnd.choice(["a", "bb", "ccccccccccccc", "d"]) + rnd.choice([" ", " ", "  ", ".", "\t"]) for _ in range(300))) for _ in range(5)]
    docs = spark.createDataFrame([(t, g) for g, t in rows], "text string, lang string")
    got = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in co.frequent(docs, 2).where("words > 0").collect()}
    assert got == {k: n for k, n in counts(rows).items() if n >= 2}


def test_every_phrase_lies_in_one_chunk():
    rnd = np.random.default_rng(2)
    ids = rnd.integers(1, 7, 400)
    order = np.array([0, 0, 5, 3, 3, 9, 1], np.uint64)  # two words share a place
    seen = Counter()
    for at, l2, l1, r1, r2 in zip(*co.chunks(ids, order)):
        line = [x for x in (l2, l1) if x] + [ids[at]] + [x for x in (r1, r2) if x]
        t = sum(x > 0 for x in (l2, l1))
        for n in (1, 2, 3):
            seen.update(tuple(line[i: i + n]) for i in range(len(line) - n + 1) if i <= t < i + n)
    want = Counter()
    for piece in "".join(map(str, ids)).split("1"):
        want.update(tuple(map(int, piece[i: i + n])) for n in (1, 2, 3) for i in range(len(piece) - n + 1))
    assert seen == want


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_007
    rows = [("en", "a b", 2, big), ("en", "a", 1, big + 9), ("en", "b", 1, big + 1), ("en", None, 0, 7 * big)]
    monkeypatch.setattr(co, "frequent", lambda docs, least, **_: spark.createDataFrame(rows, co.FREQUENT))
    got = co.collocations(spark.createDataFrame([], "text string, lang string")).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", big, big + 9, big + 1, 7 * big, 1_000_000 * big * big // ((big + 9) * (big + 1)))]


def test_empty_table(spark, tables):
    got = co.query(spark, tables([]))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0
