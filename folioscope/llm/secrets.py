"""Secret scans by a trigram inverted index.

Each rule is a regular expression. From its parse tree a Boolean query over trigrams is derived that every match must satisfy (letters in lower case): a literal run asks for all its trigrams, alternatives for one of theirs, a repetition with a minimum of one or more for its body's. For each block of documents (an Arrow batch) postings are built of the trigrams that any query names, the queries are evaluated by intersecting and uniting postings, and only candidates are verified with the rule itself, over the whole text. A rule whose query is empty (as runs of hexadecimal digits have no mandatory trigram) scans every document.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioscope.llm.common import map_texts


@dataclass(frozen=True)
class Rule:
    """A kind, its pattern, and what a match must have besides; valid names a check in CHECKS."""

    kind: str
    pattern: str
    valid: str = "any"


CHECKS: dict[str, Callable[[re.Match], bool]] = {
    "any": lambda m: True,
    "value6": lambda m: len(m[2]) >= 6,
    "long20": lambda m: m.end() - m.start() >= 20,
    "long24": lambda m: m.end() - m.start() >= 24,
}

#: Letters of the names in either case; what follows them as written.
BASE_RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "value6"),
    Rule("access", r"AKIA[A-Z0-9]+", "long20"),
    Rule("hex", r"[0-9a-f]+", "long24"),
)
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + ADDED_RULES

# Queries: True (any document), a trigram (str), ("and", ...) or ("or", ...)
ANY = True
_MOST = 16  # strings of a set that are kept apart; beyond it a set is forgotten, which only widens the query


def both(parts: list) -> object:
    parts = [p for p in dict.fromkeys(parts) if p is not ANY]
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def either(parts: list) -> object:
    return ANY if any(p is ANY for p in parts) or not parts else next(iter(set(parts))) if len(set(parts)) == 1 else ("or", *dict.fromkeys(parts))


def _of(strings: set[str]) -> object:
    """The query of a text that holds one of the strings."""
    return either([both([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _single(op, arg) -> set[str] | None:
    """The characters (in lower case) that an element can match, if they are few."""
    if op is K.LITERAL:
        return {chr(arg).lower()}
    if op is K.IN:
        out: set[str] = set()
        for o, a in arg:
            if o is K.LITERAL:
                out.add(chr(a).lower())
            elif o is K.RANGE and a[1] - a[0] < _MOST:
                out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= _MOST else None
    return None


def _walk(tree) -> tuple[set[str] | None, object]:
    """(all strings that the tree can match, or None if they are many; a query that holds for every match)."""
    current: set[str] | None = {""}  # what the run up to here can be
    queries = []

    def cut():
        nonlocal current
        if current:
            queries.append(_of(current))
        current = None

    exact = True
    for op, arg in tree:
        if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            continue
        if op is K.SUBPATTERN:
            strings, query = _walk(arg[3])
        elif op is K.BRANCH:
            found = [_walk(x) for x in arg[1]]
            strings = set().union(*(s for s, _ in found)) if all(s is not None for s, _ in found) else None
            query = ANY if strings is not None else either([both([q, _of(s)]) if s else q for s, q in found])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner, query = _walk(body)
            times = {""}
            for _ in range(low if inner is not None and len(inner) ** low <= _MOST else 0):
                times = {a + b for a in times for b in inner}
            if low and high != low and times != {""} and (current is None or len(current) * len(times) <= _MOST):
                # the least number of repetitions stands right behind what is before, the last one right before what follows
                current = times if current is None else {a + b for a in current for b in times}
                exact = False
                cut()
                current = set(inner)
                continue
            if high == 1 and low == 0 and inner is not None:
                strings, query = inner | {""}, ANY
            elif low == high and inner is not None and len(inner) ** low <= _MOST:
                strings, query = times, ANY
            else:
                strings, query = None, query if low else ANY
        else:
            strings, query = _single(op, arg), ANY
        queries.append(query)
        if strings is None or current is not None and len(current) * len(strings) > _MOST:
            exact = False
            cut()
            current = set(strings) if strings else None
        elif current is None:
            current = set(strings)
        else:
            current = {a + b for a in current for b in strings}
    if exact and current is not None:
        return current, both(queries)  # what the strings ask for is left to the caller, who may join them to more
    cut()
    return None, both(queries)


def trigram_query(pattern: str) -> object:
    """The Boolean query that every text with a match of the pattern satisfies; True if none is mandatory."""
    strings, query = _walk(_parser.parse(pattern))
    return both([query, _of(strings)]) if strings else query


def trigrams(query: object) -> set[str]:
    return set() if query is ANY else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


def _code(gram: str) -> int:
    b = gram.encode("latin-1")
    return b[0] << 16 | b[1] << 8 | b[2]


class Scanner:
    """Rules with their queries; scans blocks of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.patterns = [re.compile(r.pattern) for r in rules]
        self.queries = [self._ascii(trigram_query(r.pattern)) for r in rules]
        self.grams = sorted(set().union(*map(trigrams, self.queries)))
        self.wanted = np.zeros(1 << 24, dtype=bool)
        self.wanted[[_code(g) for g in self.grams]] = True

    def _ascii(self, query: object) -> object:
        """Trigrams beyond ASCII aren't indexed (their lower case may have other bytes); without them the query is wider."""
        if isinstance(query, str):
            return query if query.isascii() else ANY
        return query if query is ANY else (both if query[0] == "and" else either)([self._ascii(q) for q in query[1:]])

    def postings(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Documents of the block by trigram, ascending; letters A-Z count as lower case."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        found: dict[str, list[np.ndarray]] = {g: [] for g in self.grams}
        names = {_code(g): g for g in self.grams}
        at, size = 0, 0
        while at < len(raw):  # some MB at once
            first, size = at, 0
            while at < len(raw) and (size < 1 << 22 or at == first):
                size += len(raw[at]) + 1
                at += 1
            flat = np.frombuffer(b"\0".join(raw[first:at]).lower() + b"\0", dtype=np.uint8).astype(np.uint32)
            codes = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
            hits = np.nonzero(self.wanted[codes])[0]
            docs = np.searchsorted(ends, hits + (ends[first - 1] if first else 0), side="right")
            own = codes[hits]
            for code in np.unique(own):
                found[names[int(code)]].append(np.unique(docs[own == code]))
        return {g: np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for g, x in found.items()}

    def candidates(self, query: object, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
        if query is ANY:
            return np.arange(n)
        if isinstance(query, str):
            return postings[query]
        parts = sorted((self.candidates(q, postings, n) for q in query[1:]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out

    def scan(self, texts: list[str]) -> list[dict[str, list[tuple[int, int]]]]:
        """For each text the spans (code points, end exclusive) of each kind with any."""
        out: list[dict[str, list[tuple[int, int]]]] = [{} for _ in texts]
        index = self.postings(texts)
        for rule, pattern, query in zip(self.rules, self.patterns, self.queries):
            valid = CHECKS[rule.valid]
            for i in self.candidates(query, index, len(texts)).tolist():
                spans = [m.span() for m in pattern.finditer(texts[i]) if valid(m)]
                if spans:
                    out[i][rule.kind] = spans
        return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds: list[str]) -> str:
    found = sorted((start, rank, end) for rank, kind in enumerate(kinds) for start, end in spans.get(kind, ()))
    return ",".join(f"{kinds[rank]}:{start}:{end}" for start, rank, end in found)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = tuple(r.kind for r in BASE_RULES), text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs's columns (or those in keep), n_<kind> for the kinds in base, base_spans (as text) and spans: an array of kind, start and end, by start and then the order of the rules.

    Each rule's matches are leftmost and don't overlap; those that fail its check are dropped without a retry. Whole texts are read; null and empty texts have no spans; repeated rows give repeated results; an empty table gives an empty table. Input columns with an output's name give way.
    """
    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in base), T.StructField("base_spans", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))]
    kinds = [r.kind for r in rules]

    def make():
        scanner = Scanner(rules)

        def work(texts):
            found = scanner.scan([t or "" for t in texts])
            rows = [[{"kind": kinds[r], "start": a, "end": b} for a, r, b in sorted((a, r, b) for r, k in enumerate(kinds) for a, b in f.get(k, ()))] if f else [] for f in found]
            return [*(pa.array([len(f.get(k, ())) for f in found], pa.int64()) for k in base), pa.array([joined(f, list(base)) for f in found], pa.string()), pa.array(rows, _SPANS)]

        return work

    return map_texts(docs, fields, make, text_col, keep)
