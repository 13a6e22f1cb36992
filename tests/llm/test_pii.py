"""Personal data against a plain reading of the patterns."""

import hashlib
import re

import pytest

from custodia.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain(text):
    found = []
    num = lambda m: re.sub("[^0-9]", "", m)
    for rank, (kind, rx, ok) in enumerate((
            ("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(x) <= 255 for x in m.split("."))),
            ("card", CARD, lambda m: 14 <= len(num(m)) <= 19 and luhn(num(m))), ("phone", PHONE, lambda m: 10 <= len(num(m)) <= 15))):
        found += [(m.start(), rank, kind, m.end()) for m in rx.finditer(text or "") if ok(m[0])]
    return [(k, a, b) for a, _, k, b in sorted(found)]


CASES = [
    None, "", "nothing here", "a@b.c", "a@b.c_d@e.f", "x.y%z@mail.example.com.", "a@b", "@a.b", "é@ex.org ü", "a@b..c a@b.-",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.0003.255", "1.2.3", "0000000000000000001.2.3.4", "99999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111  1111 1111 1111", "5 4111111111111111", "4111 1111 1111 1111@x.com",
    "12345678901234", "0" * 14, "0" * 19, "0" * 20, "1" * 5000, "+1 (918) 555-3922", "+1234567890", "+123456789", "++1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "+1 (918) 555-3922 190.137.223.204 du", "+1 918 555 3922)", "tel +49 30 123456 78\nmail a@b.de 10.0.0.1", "\U0001f600 a@b.c \U0001f600 10.1.1.1",
    "a" * 40_000, "a@" * 3000, "1." * 20_000, "+" * 3000, "4111111111111111 " * 600, "x@y.zz " * 1000 + "10.0.0.1",
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(CASES)] + [(0, None, "x"), (None, "a@b.c", None)], "doc_id long, text string, spans string")
    return df, pii.report(df).collect()


def test_base_spans_are_those_of_the_patterns(rows):
    by_id = {r.doc_id: r for r in rows[1] if r.doc_id is not None}
    assert len(rows[1]) == len(CASES) + 2
    for i, text in enumerate(CASES):
        want, r = plain(text), by_id[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in want) for k in ("email", "ip", "card", "phone")], repr(text)[:80]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (repr(text)[:80], r.spans[:100])


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.report(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_checksums_and_context_add_spans(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 end", "GB83 WEST 1234 5698 7654 32", "my ssn is 123-45-6789.", "part 123-45-6789", "ssn 000-45-6789", "call (212) 555-0199", "room (212) 555-0199"]
    got = [r.spans for r in pii.report(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).orderBy("doc_id").collect()]
    assert [bool(x) for x in got] == [True, False, True, False, False, True, False]
    assert got[0] == "iban:5:32"


def found(spark, texts):
    return [r.spans for r in pii.report(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).orderBy("doc_id").collect()]


def test_iban_ends_by_its_country(spark):
    a, b = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    texts = [f"IBAN {a} BIC COBADEFFXXX", f"{a} Please pay", "DE89 3704 0044 0532 0130 00 Thanks", f"{a} 42", f"{b} 1000 EUR", f"{a} {b} A",
             f"({a})", f"{a}7", f"X{a}", "NO9386011117947 NO", "MT84MALT011000012345MTLCAST001S X1", "DE88370400440532013000 Please"]
    assert found(spark, texts) == ["iban:5:27", "iban:0:22", "iban:0:27", "iban:0:22", "iban:0:27", "iban:0:22,iban:23:50",
                                   "iban:1:23", "", "", "iban:0:15", "iban:0:31", ""]
    rows = spark.createDataFrame([(1, texts[0])], "doc_id int, text string")
    assert pii.redact(rows).first().text == "IBAN <IBAN> BIC COBADEFFXXX"


def test_context_reaches_over_neighbours(spark):
    """A window is cut from the text, not from the gap to the next match; wherever in a long text it stands."""
    three, calls = "SSN: 123-45-6789, 234-56-7891, 345-67-8912", "phone (212) 555-0199, (212) 555-0198"
    texts = [three, "123-45-6789, 234-56-7891 ssn", calls, "123-45-6789, 234-56-7891", "SSN" + " " * 38 + "123-45-6789", "SSN" + " " * 37 + "123-45-6789"]
    for n in (470, 490, 505, 512, 1020):
        texts.append("\U0001f600" * n + " " + three)
    got = found(spark, texts)
    assert got[0] == "ssn:5:16,ssn:18:29,ssn:31:42" and got[1] == "ssn:0:11,ssn:13:24"
    assert got[2] == "local_phone:6:20,local_phone:22:36" and got[3] == "" and got[4] == "" and got[5] == "ssn:40:51"
    assert [x.count("ssn") for x in got[6:]] == [3] * 5


def test_redaction(spark):
    rows = [(1, "mail a@b.cc now", 15), (2, None, None), (3, "4111 1111 1111 1111@x.com!", 26), (4, "clean", 5)]
    got = {r.doc_id: r for r in pii.redact(spark.createDataFrame(rows, "doc_id int, text string, n_chars long")).collect()}
    assert got[1].text == "mail <EMAIL> now" and got[1].n_chars == 16
    assert got[2].text is None and got[4].text == "clean"
    assert got[3].text == "<CARD>!"


def test_empty_table_and_no_python(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.report(df).count() == 0
    plan = pii.report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
