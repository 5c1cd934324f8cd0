"""Personal data by anchor expansion.

One automaton passes over the text once and stops at anchors only: at-signs, plus signs, schemes,
digits and the cues that come before identifiers. At each anchor a small parser for that kind
expands to the borders and checks what it found. Spans are code points, end exclusive.

Kinds with fixed patterns, leftmost and non-overlapping within a kind: email, ip, card, phone. A
candidate that fails its check is dropped and what it covered is not looked at again for that kind.
Kinds that the cues add: url (a web address that carries a login or a personal page), account (a
number after a cue such as IBAN or account; IBANs must have the right check digits), secret (a
long value after a cue such as token or password).
"""

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")

# Words that announce an identifier or a secret.
ACCOUNT_CUES = ["iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport"]
SECRET_CUES = ["token", "secret", "password", "passwd", "api_key", "apikey", "api-key",
               "access_key", "private_key"]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL_TAIL = re.compile(r"[^\s<>\"'\x00-\x20]+")
PERSONAL = re.compile(r"[^/@]+@|.*/(?:~|u/|user/|users/|profile/|people/)[^/]", re.S)
GLUE = re.compile(r"(?:[ \t]?(?:no|nr|number|id)\b\.?)?[ \t]*(?:[:=#][ \t]*)?[\"']?", re.I)
SECRET_VALUE = re.compile(r"[A-Za-z0-9_+/=.-]{16,}")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,19}(?![0-9])")

_automaton = None


def _anchors():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for c in sorted(DIGITS):
            a.add_word(c, ("digit", 1))
        a.add_word("@", ("at", 1))
        a.add_word("+", ("plus", 1))
        a.add_word("://", ("scheme", 3))
        for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
            for cue in cues:
                for form in {cue, cue.capitalize(), cue.upper()}:
                    a.add_word(form, (kind, len(form)))
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_holds(value: str) -> bool:
    value = value.replace(" ", "")
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    tail = DOMAIN.match(text, at + 1) if start < at else None
    return (start, tail.end()) if tail else None


def _url(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1].isascii() and text[start - 1].isalnum():
        start -= 1
    tail = URL_TAIL.match(text, at + 3) if start < at else None
    if tail is None:
        return None
    rest = tail.group().rstrip(".,;:!?)]}")
    return (start, at + 3 + len(rest)) if PERSONAL.match(rest) else None


def _account(text: str, at: int) -> tuple[int, int] | None:
    at = GLUE.match(text, at).end()
    found = IBAN.match(text, at)
    if found:
        value = found.group()
        while len(value.replace(" ", "")) >= 15:  # the letters after an IBAN may look like part of it
            if iban_holds(value):
                return at, at + len(value)
            value = value[:-1].rstrip(" ")
    found = ACCOUNT.match(text, at)
    return found.span() if found else None


def _secret(text: str, at: int) -> tuple[int, int] | None:
    found = SECRET_VALUE.match(text, GLUE.match(text, at).end())
    if found and any(c in DIGITS for c in found.group()):
        return found.span()
    return None


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind in one text, in order and without overlap within a kind."""
    out: dict[str, list] = {k: [] for k in KINDS}
    ends = dict.fromkeys(KINDS, 0)
    for last, (anchor, width) in _anchors().iter(text):
        at = last - width + 1
        if anchor == "digit":
            if at and text[at - 1] in DIGITS:
                continue
            if at >= ends["ip"] and (m := IP.match(text, at)):
                ends["ip"] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m.group().split(".")):
                    out["ip"].append(m.span())
            if at >= ends["card"] and (m := CARD.match(text, at)):
                ends["card"] = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        elif anchor == "at":
            if at >= ends["email"] and (span := _email(text, at, ends["email"])):
                ends["email"] = span[1]
                out["email"].append(span)
        elif anchor == "plus":
            if at >= ends["phone"] and (m := PHONE.match(text, at)):
                ends["phone"] = m.end()
                if 8 <= sum(c in DIGITS for c in m.group()) <= 15:
                    out["phone"].append(m.span())
        elif anchor == "scheme":
            if at >= ends["url"] and (span := _url(text, at, ends["url"])):
                ends["url"] = span[1]
                out["url"].append(span)
        elif at >= ends[anchor]:
            span = (_account if anchor == "account" else _secret)(text, last + 1)
            if span:
                ends[anchor] = span[1]
                out[anchor].append(span)
    return out


def describe(spans: dict, kinds=KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def mask(text: str, spans: dict) -> str:
    """The text with every span replaced by its kind in brackets; where spans of two kinds overlap,
    the one that starts first, or else the longer one, stands for both."""
    flat = sorted((a, -b, KINDS.index(k)) for k in KINDS for a, b in spans[k])
    out, at = [], 0
    for a, b, k in flat:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


COUNTS = tuple(f"n_{k}" for k in KINDS)
FOUND = ", ".join(f"{c} long" for c in COUNTS) + ", n_spans long, base_sha256 string, spans string"


def _found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for t in texts:
            s = find_spans(t or "")
            counts = [len(s[k]) for k in KINDS]
            base = describe(s, BASE_KINDS)
            rows.append((*counts, sum(counts), hashlib.sha256(base.encode()).hexdigest(), describe(s)))
        yield pd.DataFrame(rows, columns=[*COUNTS, "n_spans", "base_sha256", "spans"])


def _masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([None if t is None else mask(t, find_spans(t)) for t in texts], dtype=object)


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of spans of each kind (n_email, n_ip, n_card, n_phone, n_url, n_account,
    n_secret) and of all (n_spans), base_sha256 (of the first four kinds' spans) and spans (of all
    kinds, as kind:start:end); columns of these names are replaced. NULL is read as the empty text.
    Row by row: repeated rows each get their spans, no rows give none."""
    found = docs.withColumn("_found_pii", F.pandas_udf(_found, FOUND)("text"))
    names = (*COUNTS, "n_spans", "base_sha256", "spans")
    return found.withColumns({n: F.col(f"_found_pii.{n}") for n in names}).drop("_found_pii")


def masked(text: Column) -> Column:
    """A text with its personal data replaced by the kind's name in brackets; NULL stays NULL."""
    return F.pandas_udf(_masked, "string")(text)
