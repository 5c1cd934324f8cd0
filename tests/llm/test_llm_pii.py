import hashlib
import re
from random import Random

from newsloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(s[::-1])) % 10 == 0


HOLDS = {
    "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
    "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}


def by_hand(text):
    return {k: [m.span() for m in re.finditer(p, text) if HOLDS[k](m.group())] for k, p in PATTERNS.items()}


def check(text):
    got = pii.find_spans(text)
    assert {k: got[k] for k in PATTERNS} == by_hand(text), text


def test_against_patterns():
    r = Random(3)
    for _ in range(20_000):
        check("".join(r.choice("0123456789..--+ ()@@aB_%é\n") for _ in range(r.randint(0, 40))))
    for t in ("a@b@c.de", "a@b.co@d.com", "1.2.3.4.5.6.7.8", "+1 (2) 3", "4111 1111 1111 1111", "9" * 4000 + ".1.1.1",
              "4111-1111-1111-1111 4111111111111111x", "x@-.-", "+12345678901234567"):
        check(t)


def test_cues():
    text = 'token = "49ab8b03847cdef0" IBAN: DE89 3704 0044 0532 0130 00 account no. 12345678 see https://bob:pw@x.org/a, ok'
    s = pii.find_spans(text)
    assert [text[a:b] for a, b in s["secret"]] == ["49ab8b03847cdef0"]
    assert [text[a:b] for a, b in s["account"]] == ["DE89 3704 0044 0532 0130 00", "12345678"]
    assert [text[a:b] for a, b in s["url"]] == ["https://bob:pw@x.org/a"]
    assert pii.mask("to a@b.de or 1.2.3.4", pii.find_spans("to a@b.de or 1.2.3.4")) == "to [EMAIL] or [IP]"
    assert not any(pii.find_spans("token of the secretary, account of 12 pages, http://x.org/y")[k] for k in pii.KINDS)


def test_counts(spark):
    docs = spark.createDataFrame([(1, "a@b.de, c@d.org or https://bob:pw@x.org/a, account no. 12345678 from 1.2.3.4")],
                                 "doc_id long, text string")
    r = pii.find_pii(docs).first()
    kinds = [x.split(":")[0] for x in r["spans"].split(",")]
    assert {c: r[c] for c in pii.COUNTS} == {f"n_{k}": kinds.count(k) for k in pii.KINDS}
    assert r["n_spans"] == len(kinds) and r["n_url"] == r["n_account"] == r["n_ip"] == 1


def test_odd_rows(odd, none):
    got = pii.find_pii(odd).collect()
    assert all(r["n_spans"] == 0 for r in got)
    assert len(got) == odd.count() and {r["spans"] for r in got} == {""}
    assert {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find_pii(none).collect() == []
    kept = odd.select(pii.masked(odd.text).alias("m"), "text").collect()
    assert all(r["m"] == r["text"] for r in kept)
