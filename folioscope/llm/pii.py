"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in the whole text: at-signs, plus signs, digits, schemes and cues of identifiers. From each anchor a deterministic parser of its kind expands to both sides, finds the boundaries and validates; no pattern is run over the text. Each parser yields what its kind's pattern would find leftmost and without overlaps.

Base kinds: email, ip, card, phone. Added kinds: url (scheme://, up to white space or a quote or bracket, without closing punctuation), iban (two letters, two digits and 11 to 30 letters or digits in one run, passing the check by 97, behind no letter or digit) and ssn (three, two and four digits behind a cue such as "ssn:").
"""

from __future__ import annotations

import re
import string
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioscope.llm.common import map_texts

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "iban", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS

_DIGITS = frozenset(string.digits)
_LABEL = frozenset(string.ascii_letters + string.digits + "-")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_PHONE = frozenset(string.digits + " ().-")
_ALNUM = frozenset(string.ascii_letters + string.digits)
_UPPER = frozenset(string.ascii_uppercase)
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("ssn:", "ssn ", "ssn=", "social security number:")
IBAN_CUES = ("IBAN", "iban", "Iban")
_URL_END = re.compile(r"[\s\"'<>()\[\]{}]")

Span = tuple[int, int]


def luhn(digits: list[int]) -> bool:
    total = sum(digits[-1::-2])
    for d in digits[-2::-2]:
        total += 2 * d if d < 5 else 2 * d - 9
    return total % 10 == 0


def _run(text: str, at: int, allowed: frozenset[str]) -> int:
    """End of the run of allowed characters that begins at a place."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def expand_email(text: str, at: int, floor: int) -> Span | None:
    """The address around the at-sign at a place; nothing before floor belongs to it."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while text[end : end + 1] == "." and (after := _run(text, end + 1, _LABEL)) > end + 1:
        end, labels = after, labels + 1
    return (start, end) if labels > 1 else None


def expand_ip(text: str, at: int) -> tuple[int, Span | None]:
    """From the first digit of a run: where to go on, and the address if four parts follow and none is over 255."""
    parts, end = [], at
    while True:
        after = _run(text, end, _DIGITS)
        if after == end:
            return (parts[-1][1] if parts else at + 1), None
        parts.append((end, after))
        if len(parts) == 4:
            valid = all(len(x := text[a:b].lstrip("0")) <= 3 and int(x or 0) <= 255 for a, b in parts)
            return after, (at, after) if valid else None
        if text[after : after + 1] != ".":
            return after, None
        end = after + 1


def expand_card(text: str, at: int) -> tuple[int, Span | None]:
    """From a digit: the longest run of digits, each two at most one blank or hyphen apart; valid with 14 to 19 digits and a right check digit."""
    digits, end, n = [int(text[at])], at + 1, len(text)
    while end < n:
        if text[end] in _DIGITS:
            digits.append(int(text[end]))
            end += 1
        elif text[end] in " -" and text[end + 1 : end + 2] in _DIGITS:
            digits.append(int(text[end + 1]))
            end += 2
        else:
            break
    return end, (at, end) if 14 <= len(digits) <= 19 and luhn(digits) else None


def expand_phone(text: str, at: int) -> tuple[int, Span | None]:
    """From a plus sign: where to go on, and the number if it has 10 to 15 digits."""
    if text[at + 1 : at + 2] not in _DIGITS:
        return at + 1, None
    end = _run(text, at + 1, _PHONE)
    while text[end - 1] not in _DIGITS:
        end -= 1
    if end - at < 4:  # the sign, a digit, one more character and a digit
        return at + 1, None
    count = sum(c in _DIGITS for c in text[at:end])
    return end, (at, end) if 10 <= count <= 15 else None


def expand_url(text: str, scheme: int, body: int) -> Span | None:
    if text[body : body + 1] not in _ALNUM:  # looked at first: a text of many such schemes is walked through once
        return None
    found = _URL_END.search(text, body)
    end = found.start() if found else len(text)
    while text[end - 1] in ".,;:!?":
        end -= 1
    return scheme, end


def expand_iban(text: str, at: int) -> Span | None:
    """The account number behind a cue: after blanks, colon or equals sign."""
    while at < len(text) and text[at] in " :=\t":
        at += 1
    end = at + _run(text[at : at + 35], 0, _ALNUM)  # a run of 35 or more is none, however long
    run = text[at:end]
    if not (15 <= len(run) <= 34 and run[0] in _UPPER and run[1] in _UPPER and run[2] in _DIGITS and run[3] in _DIGITS):
        return None
    return (at, end) if int("".join(str(int(c, 36)) for c in run[4:] + run[:4])) % 97 == 1 else None


def expand_ssn(text: str, at: int) -> Span | None:
    while at < len(text) and text[at] in " :=\t":
        at += 1
    run = text[at : at + 11]
    shape = len(run) == 11 and run[3] == run[6] == "-" and all(c in _DIGITS for c in run[:3] + run[4:6] + run[7:])
    return (at, at + 11) if shape and text[at + 11 : at + 12] not in _DIGITS and run[:3] != "000" else None


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in string.digits:
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for word in SCHEMES:
        found.add_word(word, ("url", len(word)))
    for kind, cues in (("iban", IBAN_CUES), ("ssn", (*CUES, *(c.upper() for c in CUES)))):
        for word in cues:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def find(text: str | None) -> dict[str, list[Span]]:
    """Spans (code points, end exclusive) by kind, in order."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not text:
        return out
    floor = dict.fromkeys(KINDS, 0)  # nothing before it may begin a span of the kind
    add = lambda kind, span: (out[kind].append(span), floor.__setitem__(kind, span[1]))
    for last, (anchor, size) in _anchors().iter(text):
        at = last + 1 - size
        if anchor == "digit":
            if at >= floor["ip"]:
                floor["ip"], span = expand_ip(text, at)
                if span:
                    out["ip"].append(span)
            if at >= floor["card"]:
                floor["card"], span = expand_card(text, at)
                if span:
                    out["card"].append(span)
        elif anchor == "email":
            if at >= floor["email"] and (span := expand_email(text, at, floor["email"])):
                add("email", span)
        elif anchor == "phone":
            if at >= floor["phone"]:
                floor["phone"], span = expand_phone(text, at)
                if span:
                    out["phone"].append(span)
        elif at >= floor[anchor]:
            span = expand_url(text, at, last + 1) if anchor == "url" else expand_iban(text, last + 1) if anchor == "iban" else expand_ssn(text, last + 1)
            if span:
                add(anchor, span)
    return out


def joined(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    """kind:start:end of the spans, by start and then the order of kinds, joined by commas."""
    found = sorted((start, rank, end) for rank, kind in enumerate(kinds) for start, end in spans[kind])
    return ",".join(f"{kinds[rank]}:{start}:{end}" for start, rank, end in found)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
OUTPUT = ("n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans")


def pii_spans(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs's columns (or those in keep), the counts of the base kinds, base_spans (as text) and spans: an array of kind, start and end over all kinds, by start and then kind.

    Whole texts are read, however long; null and empty texts have no spans; repeated rows give repeated results; an empty table gives an empty table. Spans of different kinds may overlap; those of one kind don't. Input columns with an output's name give way.
    """
    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS), T.StructField("base_spans", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))]

    def make():
        def work(texts):
            found = [find(t) for t in texts]
            counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE_KINDS]
            rows = [[{"kind": KINDS[r], "start": a, "end": b} for a, r, b in sorted((a, r, b) for r, k in enumerate(KINDS) for a, b in f[k])] for f in found]
            return [*counts, pa.array([joined(f, BASE_KINDS) for f in found], pa.string()), pa.array(rows, _SPANS)]

        return work

    return map_texts(docs, fields, make, text_col, keep)
