import hashlib
import re

from plenum.llm import contextual_pii as cp

SF = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                  "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def check(rows, got):
    want = sorted((d, *(sum(s[0] == k for s in plain(t)) for k in PLAIN), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain(t)).encode()).hexdigest()) for d, t in rows)
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        kinds = [s.split(":") for s in r.spans.split(",") if s]
        order = [(cp.KINDS.index(k), int(a), int(b)) for k, a, b in kinds]
        assert order == sorted(order) and len(kinds) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_context


def test_seeds_of_all_documents_match_plain_matching(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(rows, cp.query(spark, SF).collect())


def test_hard_texts(make_docs, store, spark):
    texts = [
        None, "", "a@b.co_x@y.zz", "x@@y@z.com", "a@b@c.de", "a..b%+-@d-e.f.g-. z", "é🙂 q@r.st", "\x01 m@n.op \x01", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1", "0001.02.255.256 0000255.1.1.1",
        "4111 1111-1111 1111", "4111111111111111 1", "4111  1111", "4111-1111-1111-1112", "+1 (988) 555-2485.", "+1 . . 9", "+12", "+49 30 1234567 +49-30-7654321", "+1 2" * 5,
        "1" * 30_000, "a." * 40_000, "7 " * 20_000, "a@b." + "c." * 20_000, "+1" + " " * 20_000, "x@y.z " * 3000, "12345678901234567890.1.1.1", "a@b.c" * 50,
    ]
    rows = list(enumerate(texts)) + [(5, texts[5])]
    check(rows, cp.query(spark, store(make_docs(rows))).collect())
    assert cp.query(spark, store(make_docs([]))).count() == 0


def test_contexts_lead_to_unseen_identifiers(make_docs, store, spark):
    rows = [(i, f"please write to user{i}@mail.example.com today. nothing in {1000 + i} of note") for i in range(12)]
    rows += [(100, "please write to AB-778899-Q, then go. in 1990 of"), (101, "again AB-778899-Q."), (102, "please write to user3@mail.example.com or 5550")]
    got = {r.doc_id: r for r in cp.query(spark, store(make_docs(rows))).collect()}
    assert got[100].spans == "context:16:27" and got[100].n_context == 1
    assert got[101].spans == "context:6:17"  # another place of an instance that is believed
    assert got[0].spans == "email:16:38" and got[102].n_context == 0
