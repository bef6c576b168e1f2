import random
import re

import numpy as np
import pytest

from plenum.llm import shingles as sh
from plenum.llm import super_minhash as sm
from plenum.llm.components import components

SF = "/root/testdata/sf0.001"


def plain_set(text, width):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    n = min(width, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows, width, percent):
    sets = [plain_set(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def plain_signature(elements, size):
    """One element at a time, permutations written out."""
    out = [float("inf")] * size
    for e in elements:
        p = list(range(size))
        for j in range(size):
            drawn = sh.mix(np.array([e], np.uint64) ^ sh.mix(np.array([j + 1], np.uint64) * sh.FACTOR))
            fraction = float(drawn[0] >> np.uint64(11)) / 2 ** 53
            k = j + int(sh.mix(drawn)[0] % np.uint64(size - j))
            p[j], p[k] = p[k], p[j]
            out[p[j]] = min(out[p[j]], j + fraction)
    return out


@pytest.mark.filterwarnings("ignore:overflow")
def test_signatures_match_written_out_permutations():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64)) for n in (1, 2, 5, 40, 300, 0)]
    got = sm.signatures(sets, 16)
    for s, g in zip(sets, got):
        assert list(g) == plain_signature(s, 16)


def test_estimate_is_close():
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 2 ** 63, 1200, dtype=np.uint64))
    rng.shuffle(pool)
    a, b = np.sort(pool[:1000]), np.sort(pool[100:1100])
    s = sm.signatures([a, b], 1024)
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.05


def test_agreement_counts_equal_values(spark):
    rng = np.random.default_rng(6)
    a = rng.random((5, 128))
    b = np.where(rng.random((5, 128)) < 0.7, a, rng.random((5, 128)))
    rows = [(x.tolist(), y.tolist(), int((p == q).sum())) for p, q, x, y in zip(a, b, sm.band_keys(a, 32), sm.band_keys(b, 32))]
    frame = spark.createDataFrame(rows, "x array<long>, y array<long>, want int")
    assert frame.select((sm.agreeing("x", "y") == frame["want"]).alias("ok")).where("not ok").count() == 0


def test_shingle_counts_match_plain_sets():
    texts = ["A b\tC", "a", "", " \n", "x y", "é É e", "a b c a b c a b c", "w" * 5000 + " b c d", "q " * 700, "a\x0bb\x0cc"]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = sh.shingle_sets(b"".join(raw), at, 3)
    assert [len(g) for g in got] == [len(plain_set(t, 3)) for t in texts]
    alone = [sh.shingle_sets(r, np.array([0, len(r)]), 3)[0].tolist() for r in raw]
    assert [g.tolist() for g in got] == alone  # neighbours in a batch do not matter


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.random()}"
    return " ".join(out)


def test_groups_match_brute_force(make_docs):
    rng = random.Random(7)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = [(100 + i, edited(base, rng.randrange(9), rng)) for i in range(60)]
    chain = list(base[::-1])
    for i in range(12):  # each near the one before, the ends far apart
        chain[10 * i % 120: 10 * i % 120 + 2] = [f"c{i}", f"d{i}"]
        rows.append((300 - i, " ".join(chain)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "x"), (7, "x"), (None, "x"), (None, "lone one"), (8, "b " * 9000), (9, "b " * 5)]
    rows += [(500 + i, rows[0][1]) for i in range(5)]
    for width, percent in ((3, 85), (5, 80)):
        got = sm.groups(make_docs(rows), width, percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, width, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    left = sm.drop_near_copies(make_docs(rows), 3, 85)
    names = {(r.component_id if r.n_shingles else ("empty", r.row)) if r.component_id is not None else ("null", r.row) for r in sm.groups(make_docs(rows), 3, 85).collect()}
    assert left.columns == make_docs([]).columns and left.count() == len(names)


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sm.query(spark, SF).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 85)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 299), (299, 298), (7, 7)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: 298, 299: 298, 298: 298}
    assert got == want


def test_empty_table(make_docs):
    assert sm.groups(make_docs([])).count() == 0 and sm.drop_near_copies(make_docs([])).count() == 0


def test_a_batch_is_not_copied_as_a_whole(monkeypatch):
    import pyarrow as pa

    from plenum.llm import super_minhash as sm
    taken = []
    monkeypatch.setattr(sm, "utf8_column", lambda column, real=sm.utf8_column: taken.append(len(column)) or real(column))
    texts = [f"text {i}" if i % 7 else None for i in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(texts)], ["row", "text"])
    got = [(low + i, raw[at[i]: at[i + 1]].decode()) for low, high, raw, at in sm._pieces(batch, 1000) for i in range(high - low)]
    assert got == [(i, t or "") for i, t in enumerate(texts)] and max(taken) < 5000 and sm._pieces.__defaults__[0] <= 1 << 20


def test_a_loose_group_is_not_held_against_itself(make_docs, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    # the one that all are held against first has many edits, so that it brings few of the others together
    rows = [(i, edited(base, 3 if i < 1 else rng.choice((1, 1, 2, 2, 3)), rng)) for i in range(120)]
    asked, real = [], sm.confirm
    monkeypatch.setattr(sm, "confirm", lambda pairs, sets, percent: asked.append(pairs.count()) or real(pairs, sets, percent))
    got = sm.groups(make_docs(rows).repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id"), 5, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 5, 80)
    assert sum(asked[1:]) < 1000, asked  # 1,458 in one round, 431 and 73 in two


def test_signatures_of_short_texts_trace_few_swaps(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64)) for n in [3] * 40 + [0, 1, 700] + [60] * 300]
    monkeypatch.setattr(sm, "HELD", 100)
    calls, copyto = [], np.copyto
    monkeypatch.setattr(np, "copyto", lambda *a, **k: (calls.append(1), copyto(*a, **k)))
    got = sm.signatures(sets, 128)
    assert len(calls) < 100  # every step traced back made 8,128 of them
    for i in (0, 39, 40, 41, 42, 43, 342):  # permutations written out
        want = np.full(128, np.inf)
        for element in sets[i]:
            place = list(range(128))
            for j in range(128):
                drawn = sm.mix(np.array([element]) ^ sm.mix(np.array([j + 1], np.uint64) * sm.FACTOR))
                k = j + int(sm.mix(drawn)[0] % np.uint64(128 - j))
                place[j], place[k] = place[k], place[j]
                want[place[j]] = min(want[place[j]], j + float(drawn[0] >> np.uint64(11)) / 9007199254740992.0)
        assert np.array_equal(got[i], want)
