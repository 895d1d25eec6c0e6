import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from keytide.llm import pii

from . import cases

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The base kinds by their patterns alone."""
    number = lambda m: re.sub("[^0-9]", "", m.group())
    total = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1]))
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(number(m)) <= 19 and total(number(m)) % 10 == 0]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(number(m)) <= 15]


def base(text):
    return [s[:3] for s in pii.find(text) if s[0] in pii.BASE_KINDS]


def test_base_kinds_equal_the_patterns():
    r = random.Random(3)
    for _ in range(40_000):
        alphabet = r.choice(["a@.b%- 1", "0123456789. -", "+1 (.)-9", "a@b.c1.2 +()é"])
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
        assert base(text) == plain(text), text


@pytest.mark.parametrize("unit", ["a", "1", "@", "a@", "1.", "+1", "+1 ", "A1", "0-", "DE89 ", "123-45-6789 "])
def test_long_runs_are_linear(unit):
    began = time.monotonic()
    pii.find(unit * (600_000 // len(unit)))
    assert time.monotonic() - began < 5


def test_validators():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")


def kinds(text):
    return [s[0] for s in pii.find(text)]


def test_scored_kinds_need_checksum_or_context():
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert kinds("DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00.") == []
    assert kinds("bank AB12 CDEF GHIJ KLMN OPQR stock list") == []
    assert kinds("serial DE88 3704 0044 0532 0130 00.") == [] and kinds("serial DE89 3704 0044 0532 0130 00.") == ["iban"]
    unknown = "ZZ" + f"{98 - int('1111222233334444' + '3535' + '00') % 97:02d}" + "1111222233334444"
    assert pii.mod97(unknown) and kinds(unknown) == [] and kinds(f"account {unknown}") == kinds(f"{unknown} (account)") == ["iban"]
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("123-45-6789") == [] and kinds("ssn 666-45-6789") == []
    assert kinds("123-45-6789 is the taxpayer's") == ["ssn"] and kinds("ssn" + " x" * 30 + " 123-45-6789") == []
    secret = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
    assert kinds(f'token = "{secret}"') == ["secret"] and kinds(f"sha1 {secret}") == [] and kinds(secret) == []


def test_ibans_end_where_the_check_digits_say():
    spans = lambda t: [t[a:b] for k, a, b, _ in pii.find(t) if k == "iban"]
    german, british = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    assert spans("DE89370400440532013000 EUR 500") == ["DE89370400440532013000"]
    assert spans(f"{german} BIC COBADEFF") == spans(f"IBAN {german} BIC COBADEFF") == [german]
    assert spans(f"{german} {british} REF 7") == [german, british]
    assert spans(f"REF AB12 3456 7890 1234 {german}")[-1:] == [german]
    assert spans(f"PO1 {german}, or {british}.") == [german, british]
    assert spans("IBAN DE88 3704 0044 0532 0130 00 EUR 500") == []
    assert spans("pay DE89370400440532013000 NOW please") == ["DE89370400440532013000"]
    assert spans(f"{german} BIC COBADEFFXXX") == [german]
    assert pii.redacted("pay DE89370400440532013000 EUR 500") == "pay <IBAN> EUR 500"


def slow_scored(text):
    """The scored kinds by trying every span that a kind's rule may mean."""
    out, end = [], 0
    free = lambda i: i < 0 or i >= len(text) or not (text[i].isascii() and text[i].isalnum())
    for a in range(len(text)):
        if a < end or not re.match("[A-Z]{2}[0-9]{2}", text[a:]) or not free(a - 1):
            continue
        best = None
        for b in range(a + 15, min(len(text), a + 67) + 1):
            found = text[a:b]
            compact = found.replace(" ", "")
            if not re.fullmatch("[A-Z]{2}[0-9]{2}( ?[A-Z0-9])+", found) or not free(b):
                continue
            known = pii.IBAN_LENGTHS.get(found[:2])
            if (len(compact) == known if known else 15 <= len(compact) <= 34):
                number = int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4]))
                if number % 97 == 1:
                    best = b
        if best:
            end = best
            near = set(re.findall("[a-z0-9]+", (text[max(0, a - 48) : a] + " " + text[best : best + 48]).lower()))
            score = (0.8 if text[a : a + 2] in pii.IBAN_LENGTHS else 0.5) + 0.3 * bool(near & set(pii.CONTEXT_WORDS["iban"][0])) - 0.2 * bool(near & set(pii.CONTEXT_WORDS["iban"][1]))
            if score >= 0.6 - 1e-9:
                out.append(("iban", a, best))
    return out


def test_account_numbers_equal_a_slow_search():
    r = random.Random(8)

    def number(country, length):
        body = "".join(r.choice("0123456789ABC") for _ in range(length - 4))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        made = f"{country}{check:02d}{body}"
        return made if r.random() < 0.5 else " ".join(made[i : i + 4] for i in range(0, length, 4))

    found = 0
    for _ in range(1500):
        parts = [r.choice((number("DE", 22), number("NO", 15), number("ZZ", 20), "AB12", "EUR 5", "iban", "serial", "x", "DE88 3704 0044 0532 0130 00", ",", "GB82WEST", "1")) for _ in range(r.randint(1, 5))]
        text = " ".join(parts)
        got = [s[:3] for s in pii.find(text) if s[0] == "iban"]
        assert got == slow_scored(text), text
        found += len(got)
    assert found > 500


def test_redaction():
    assert pii.redacted("mail me@x.org or +1 (212) 555-7890!") == "mail <EMAIL> or <PHONE>!"
    assert pii.redacted(None) is None and pii.redacted("") == "" and pii.redacted("clean") == "clean"


def test_query_over_awkward_rows(spark, tmp_path):
    extra = [(200, "me@x.org 1.2.3.4, +12 345 678 90, 4539 5787 6362 1486", None, None, None), (201, "é a@b.co é 999.1.1.1", None, None, None)]
    docs = cases.with_clashes(cases.frame(spark, cases.awkward() + extra))
    got = pii.op1_pii(spark, cases.save(docs, tmp_path, "documents")).collect()
    want = []
    for doc_id, text, *_ in cases.awkward() + extra:
        found = plain(text or "")
        said = ",".join(f"{k}:{a}:{b}" for k in pii.BASE_KINDS for x, a, b in found if x == k)
        want.append((doc_id, *(sum(s[0] == k for s in found) for k in pii.BASE_KINDS), hashlib.sha256(said.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.spans.startswith("email:0:8,ip:9:16,card:") for r in got if r.doc_id == 200)
    empty = pii.detect(docs.limit(0))
    assert empty.count() == 0


def test_redact_keeps_columns(spark):
    docs = cases.with_clashes(cases.frame(spark, [(1, "a@b.co x", "xx", None, 8), (2, None, None, None, None), (3, "", "x", "y", 0)]))
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, "<EMAIL> x", 9), (2, None, None), (3, "", 0)}
    assert pii.redact(docs.where(F.lit(False))).count() == 0
