import hashlib
import random
import re

from mockloom.llm import pii

#: Patterns of the base kinds (fixed values).
BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def holds(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def brute(text):
    spans = sorted((m.start(), k, name, m.end()) for k, (name, p) in enumerate(BASE) for m in re.finditer(p, text or "") if holds(name, m[0]))
    return ",".join(f"{name}:{a}:{b}" for a, _, name, b in spans)


def test_base_spans_match_brute_force(spark, documents, edges):
    r = random.Random(5)
    parts = [*"0123456789 .-+()@%abZ_é😀\n", "a@b.c", "1.2.3.4", "+1 (555) 010-9999", "4785380592391139", "GB82 WEST 1234 5698 7654 32", "123-45-6789", " ssn "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 80))) for _ in range(800)]
    texts += ["a@b.c " * 3000, "1" * 20_000, "a." * 5000 + "@x.y" * 3000, "+1((((" * 1000, "4785380592391139 " * 700, None, ""]
    made = spark.createDataFrame(list(enumerate(texts, 1_000_000)), "doc_id long, text string")
    docs = documents.select("doc_id", "text").union(edges.selectExpr("doc_id + 500000", "text")).union(made)
    found = {r.doc_id: r for r in pii.digest(pii.find(docs)).collect()}
    for doc, text in docs.collect():
        assert found[doc].base_sha256 == hashlib.sha256(brute(text).encode()).hexdigest(), doc


def test_long_runs_take_linear_time(spark):
    docs = spark.createDataFrame([(1, "a" * 400_000), (2, "7" * 400_000), (3, "1." * 200_000)], "doc_id long, text string")
    assert {r.n_email + r.n_card for r in pii.digest(pii.find(docs)).collect()} == {0}


def test_checksums_and_context(spark):
    texts = ["account GB82 WEST 1234 5698 7654 32 here", "GB83 WEST 1234 5698 7654 32", "ssn: 123-45-6789", "code 123-45-6789", "ssn 666-45-6789", "me@mail.org"]
    found = {r.doc_id: r for r in pii.digest(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert [found[i].n_iban for i in range(6)] == [1, 0, 0, 0, 0, 0]
    assert [found[i].n_ssn for i in range(6)] == [0, 0, 1, 0, 0, 0]
    assert found[2].spans == "ssn:5:16" and found[0].spans == "iban:8:35" and found[5].spans == "email:0:11"


def test_ibans_end_where_their_country_says(spark):
    spaced, plain = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000"
    cases = [
        (f"IBAN {spaced} BIC COBADEFFXXX", [spaced]), (f"{plain} EUR 120", [plain]), (f"{spaced} 100 GB82 WEST 1234 5698 7654 32 X", [spaced, "GB82 WEST 1234 5698 7654 32"]),
        (f"NR12 {spaced} UND", [spaced]), (f"ES12 {spaced}", [spaced]), (f"{plain} {plain}", [plain, plain]), ("NO93 8601 1117 947 KTO", ["NO93 8601 1117 947"]),
        (f"x{plain} {plain}EUR {plain[:-1]}1 A", []), ("FR14 2004 1010 0505 0001 3M02 606 PARIS", ["FR14 2004 1010 0505 0001 3M02 606"]), (f"é😀 {plain}\nABC " * 600, [plain] * 600),
    ]
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string")
    for r in pii.find(docs).collect():
        text, wanted = cases[r.doc_id]
        found = [s for s in r.spans if s["kind"] == "iban"]
        assert [s["span"] for s in found] == wanted == [text[s["start"]:s["end"]] for s in found], text[:80]


def test_empty_table(nothing):
    assert pii.digest(pii.find(nothing)).count() == 0
