import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from plenum.llm import token_alignment as ta
from plenum.llm.token_counts import vocabulary

PARTS = ["a", "the", "B", "'s", "é", "é", "́", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "　", "​", "<|endoftext|>", "<s>", "</s>",
         "<unk>", "<0x41>", "中", "文字", "123", "!", "...", "ﬁ", "😀", "👩‍👩‍👧", "\x00", "Ⅳ", "ñandú", "x" * 20, "Ġ"]


@pytest.fixture(scope="module")
def pair():
    return ta.Pair(vocabulary(ta.FILE_A), vocabulary(ta.FILE_B))


def tokens(pair, text):
    """Ids and ends of both vocabularies over the whole text; none where the bytes differ."""
    if not text:
        return None
    data = (" " + text).encode()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text, num_threads=1)
    if b"".join(pair.a_bytes[i] for i in a) != data or b"".join(pair.b_bytes[i] for i in b) != data:
        return None
    ends = lambda ids, table: [sum(len(table[j]) for j in ids[: i + 1]) for i in range(len(ids))]
    return a, ends(a, pair.a_bytes), b, ends(b, pair.b_bytes)


def brute(pair, rows):
    links, out = Counter(), []
    each = [(d, tokens(pair, t)) for d, t in rows]
    pairs = [[(i, j) for i, e in zip(t[0], t[1]) for j, f in zip(t[2], t[3]) if e == f] if t else [] for _, t in each]
    for p in pairs:
        links.update(p)
    best = {}
    for (_, j), n in links.items():
        best[j] = max(best.get(j, 0), n)
    for (d, t), p in zip(each, pairs):
        if t is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        both = sorted(set(t[1]) & set(t[3]))
        low, groups = 0, []
        for cut in both:
            inside = lambda ids, ends: ",".join(str(i) for i, e in zip(ids, ends) if low < e <= cut)  # noqa: E731, B023
            groups.append(f"{inside(t[0], t[1])}|{inside(t[2], t[3])}")
            low = cut
        out.append((d, len(t[0]), len(t[2]), len(both), len(p), sum(links[x] == best[x[1]] for x in p), sum(links[x] for x in p),
                    hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=key)


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def texts():
    rnd = random.Random(11)
    made = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 14))) for _ in range(700)]
    return [None, "", " ", "  a  b ", "a▁b", "▁", "plain words, here.", "plain words, here.", "words 中文 and 😀😀 é", "\n\nx\n", "tail \n", *made]


def test_query_matches_brute_force(spark, make_docs, store, pair):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (None, "no id"), (3, "same id")] + [(9000 + i, "a hot text of many copies") for i in range(400)]
    got = ta.query(spark, store(make_docs(rows))).collect()
    assert sorted(map(tuple, got), key=key) == brute(pair, rows)


def test_store_may_be_cleared_and_slices_cut(spark, make_docs, pair, monkeypatch):
    monkeypatch.setattr(ta, "STORE_CHUNKS", 3)
    monkeypatch.setattr(ta, "ENCODE", 40)
    store = ta.Store(pair)
    for text in texts()[:200]:
        totals, written, of, links, times = store.documents([text, "common words"])
        t = tokens(pair, text)
        assert tuple(totals[0]) == ((len(t[0]), len(t[2]), len(set(t[1]) & set(t[3]))) if t else (0, 0, 0))
        assert len(store.groups) < 60


def test_very_long_texts(pair):
    long = "x1é" * 20_000 + " " + "word " * 30_000
    totals, written, of, links, times = ta.Store(pair).documents([long])
    assert totals[0][0] == len(pair.a.encode(" " + long, add_special_tokens=False).ids)
    assert totals[0][1] == len(pair.b.encode(long)) and totals[0][2] == times.sum() == written[0].count(";") + 1


def test_links_are_suffixes_and_all_numbered(pair):
    n_b = len(pair.b_bytes)
    total = sum(map(len, pair.a_bytes)) * 2 + sum(map(len, pair.b_bytes))
    assert 0 < len(pair.codes) <= total
    for code in pair.codes[::5000]:
        x, y = pair.a_bytes[code // n_b], pair.b_bytes[code % n_b]
        assert x.endswith(y) or y.endswith(x)


def test_refined_lays_decoded_bytes_between_sure_cuts():
    data = " é中".encode()
    assert ta.refined([(0, 1), (1, 3), (1, 3), (3, 6)], [b" ", b"\xc3", b"\xa9", "中".encode()], data) == [1, 2, 3, 6]
    assert ta.refined([(0, 1), (1, 1), (1, 3), (3, 6)], [b" ", b"\xc3", b"\xa9", "中".encode()], data) == [1, 2, 3, 6]
    assert ta.refined([(0, 1), (1, 3), (3, 6)], [b" ", b"e!", "中".encode()], data) is None
    assert ta.refined([], [], b"") == []
    sizes = np.array([1, 1, 1, 3])
    for starts, ends in (([0, 1, 1, 3], [1, 3, 3, 6]), ([0, 1, 1, 3], [1, 1, 3, 6])):
        assert ta.refined_all(np.array(starts), np.array(ends), np.arange(4), sizes).tolist() == [1, 2, 3, 6]


def test_keys_name_their_chunks_and_lots_equal_single_chunks(pair):
    for text in filter(None, texts()):
        assert "".join(map(ta.chunk_of, ta.keys_of(text))) == " " + text
    keys = sorted({k for t in filter(None, texts()) for k in ta.keys_of(t)})
    for part, counts, groups, links in pair.aligned(keys):
        each = [pair.alone(k) for k in part]
        assert groups == [g for _, e, _ in each for g in e] and links.tolist() == [c for _, _, e in each for c in e.tolist()]
        assert counts.tolist() == [c for e, _, _ in each for c in e.tolist()]


def test_groups_in_writing_and_empty_table(spark, make_docs, store, pair):
    got = ta.align(make_docs([(1, "one two")])).collect()[0]
    assert got.groups.count("|") == got.n_groups and got.n_links == got.n_best == 2
    none = ta.query(spark, store(make_docs([])))
    assert none.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and none.count() == 0
