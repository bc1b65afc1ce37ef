import hashlib
import random
import re

import pytest

from helixframe.llm import pii

DIGIT = "0-9"
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def keeps(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {
        "email": True,
        "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")),
        "card": 13 <= len(digits) <= 19 and luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in p.finditer(text or "") if keeps(k, m[0])]


CASES = [
    None, "", "a@b.co_x@y.z, a@b..c x@y", "é+@b.co 😀 me.too@x-y.zz.q", "x@@y.z a@b.c@d.e", "%%%a@b.c",
    "1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.255 0000.1.2.03", "call +1 (555) 123-4567 or +12345678 x +1----------2", "+1 +22 333 4444 55",
    "4111 1111 1111 1111 4111-1111-1111-1112 4316522678525456 12--34", "1 " * 3000, "9" * 3000, "a" * 5000, "a." * 3000 + "@", "+1" + "(" * 3000,
    "49927398716 4992739871600000000 378282246310005", "12.34.56.78.90@1.2.3.4",
]


def test_base_matches_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "doc_id long, text string, pii string")
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.pii if s.kind in BASE] for r in pii.find_pii(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(CASES)}
    for r in pii.find_pii(df).collect():
        assert all(CASES[r.doc_id][s.start : s.end] == s.text for s in r.pii)


def test_checksums_and_context_add_spans(spark):
    good = "iban GB29 NWBK 6016 1331 9268 19 The"
    rows = [(1, good), (2, good.replace("6016", "6017")), (3, "my ssn 123-45-6789"), (4, "code 123-45-6789"), (5, "DE89370400440532013000"), (6, "call (555) 123-4567"), (6, None)]
    got = [(r.doc_id, [s.kind for s in r.pii]) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "text").collect()]
    assert got == [(1, ["iban"]), (2, []), (3, ["ssn"]), (4, []), (5, ["iban"]), (6, []), (6, ["tel"])]


def test_redact(spark):
    df = pii.find_pii(spark.createDataFrame([(1, "é a@b.co x"), (2, None), (3, "")], "doc_id long, text string"))
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == ["é <email> x", None, ""]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = {r.doc_id: r for r in pii.op1_pii(spark, d).collect()}
    assert len(got) == len(docs)
    for r in docs:
        want = brute(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[r.doc_id].n_card == sum(x.startswith("card") for x in want)


def test_empty(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def iban(country, account):
    moved = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{country}{98 - int(moved) % 97:02d}{account}"


def test_planted_kinds_in_documents(spark):
    """Valid accounts are found wherever they stand, numbers beside a context word on either side; broken ones and bare shapes stay out."""
    rng = random.Random(3)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text and len(r.text) < 5000]
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    rows, want = [], {}
    for i in range(240):
        good = iban(rng.choice(["DE", "FR", "ES"]), digits(18))
        ssn, tel = f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", f"{digits(3)}-{digits(3)}-{digits(4)}"
        lead, item, tail, kind = rng.choice([
            ("", good, "", "iban"), ("IBAN ", " ".join(good[k : k + 4] for k in range(0, len(good), 4)), "", "iban"), ("", good[:-1] + str((int(good[-1]) + 1) % 10), "", None), ("SSN: ", ssn, "", "ssn"), ("", ssn, " (social security)", "ssn"), ("", ssn, "", None),
            ("call ", tel, "", "tel"), ("phone 1 234-567-8901 or ", tel, "", "tel"), ("part ", tel, "", None),
        ])
        text = rng.choice(docs)
        at = text.find(" ", rng.randint(0, len(text)))
        at = len(text) if at < 0 else at
        start = at + 1 + len(lead)
        rows.append((i, f"{text[:at]} {lead}{item}{tail} {text[at + 1 :]}"))
        want[i] = kind and (kind, start, start + len(item))
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.pii if s.kind not in BASE} for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(w in got[i] for i, w in want.items() if w)
    assert caught >= 0.97 * sum(w is not None for w in want.values())
    assert sum(bool(got[i]) for i, w in want.items() if w is None) <= 2


def test_context_reaches_through_matches_of_the_kind(spark):
    rows = [(1, "cards: 4111 1111 1111 1111, 4316522678525456"), (2, "4111 1111 1111 1111" + " x" * 40 + " 4316522678525456")]
    got = {r.doc_id: [round(s.score, 2) for s in r.pii] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [1.0, 1.0], 2: [0.9, 0.9]}


def test_texts_with_very_many_matches(spark):
    """More matches than a block of the running fold holds, and a long text."""
    text = "".join(f"u{i}@a.b é " + "z" * (i % 50) for i in range(30_000))
    df = pii.find_pii(spark.createDataFrame([(1, text), (2, "a@b.c " * 65)], "doc_id long, text string"))
    by = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.pii] for r in df.collect()}
    assert by[1] == brute(text) and by[2] == brute("a@b.c " * 65)
    done = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert done[1] == BASE["email"].sub("<email>", text) and done[2] == "<email> " * 65


def test_redact_overlaps(spark):
    spans = [("a", 3, 9), ("b", 5, 7), ("c", 8, 12), ("d", 12, 13), ("e", 4990, 5003)]
    text = "é" * 6000
    df = spark.createDataFrame([(1, text, [(k, s, e, 1.0, "") for k, s, e in spans])], f"doc_id long, text string, pii {pii.SPANS}")
    assert pii.redact(df).first().text == "ééé<a><d>" + "é" * 4977 + "<e>" + "é" * 997


def test_added_spans_keep_off_base_ones(spark):
    text = "call +1 (743) 555-3824 or 555-123-4567, phone 555-123-4567@mail.example or 555-123-9999"
    kinds = [(s.kind, s.text) for s in pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().pii]
    assert kinds == [("email", "555-123-4567@mail.example"), ("phone", "+1 (743) 555-3824"), ("tel", "555-123-4567"), ("tel", "555-123-9999")]
