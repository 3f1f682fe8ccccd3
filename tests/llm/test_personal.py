import hashlib
import re

from hypothesis import given, settings, strategies as st

from callharmony.llm import personal as p

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def checksum(number):
    odd, even = number[-1::-2], number[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def brute(text):
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and checksum(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], p.BASE.index(s[0])))


TEXTS = st.one_of(
    st.text(st.sampled_from("a1.@+-_ (é😀"), max_size=40),
    st.text(st.sampled_from("0123 .-"), max_size=40),
    st.text(st.sampled_from("+1 23().-9"), max_size=30),
    st.lists(st.sampled_from(["4111111111111111", "4111 1111-1111 1111", "1.2.3.4", ".", "300.1.1.1", "+1 (222) 333-4444", "a@b.co", " ", "@", "x"]), max_size=8).map("".join),
)


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_base_spans(text):
    assert [span for span in p.spans_of(text) if span[0] in p.BASE] == brute(text)


def test_added_kinds():
    text = "see https://user.example.org/a?b=1. IBAN: DE89 3704 0044 0532 0130 00, Account no: 12345678; account holder; iban DE00123456789012"
    assert [(kind, text[a:b]) for kind, a, b in p.spans_of(text) if kind not in p.BASE] == [
        ("url", "https://user.example.org/a?b=1"),
        ("iban", "DE89 3704 0044 0532 0130 00"),
        ("account", "12345678"),
    ]


def test_clean_prose_has_no_spans():
    assert p.spans_of("In 2019 the account was closed, at 5 p.m. on 12 May; e-mail me @ home + 3 more.") == []


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {row["doc_id"]: row["text"] for row in docs.collect()}
    for row in p.find_personal(docs).collect():
        base = brute(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(p.joined(base).encode()).hexdigest()
        assert [row[f"n_{kind}"] for kind in p.BASE] == [sum(s[0] == kind for s in base) for kind in p.BASE]
        assert set(p.joined(base).split(",")) <= {*row["spans"].split(","), ""}


def test_odd_rows(odd, empty):
    found = p.find_personal(odd, masked=True)
    assert found.count() == odd.count() and p.find_personal(empty).count() == 0
    assert {row["spans"] for row in found.where("doc_id IN (1, 3, 4, 5)").collect()} == {""}
    assert p.mask("mail a@b.co now", p.spans_of("mail a@b.co now")) == "mail [email] now"


def test_long_texts_in_linear_time():
    for text in ("a" * 300_000 + "@", "1." * 150_000, "9" * 300_000, "+1" + " " * 300_000, "a@" * 100_000):
        p.spans_of(text)


def test_parts_of_thousands_of_zeros():
    zeros = "0" * 5_000
    text = f"{zeros}.0.0.{zeros}9 and {zeros}256.1.1.1"
    assert [(kind, a, b) for kind, a, b in p.spans_of(text) if kind == "ip"] == [("ip", 0, 2 * len(zeros) + 6)]
