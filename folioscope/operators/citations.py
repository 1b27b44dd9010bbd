"""Citations in brackets: two grammars, resolution, rewriting to numbers and back.

The strict grammar (drafts) knows @ids and numbers and drops a bracket with any part that is no citation; the lenient one (finished texts) takes what numbers it finds. They are kept apart on purpose. Reading a bracket is a sequential parse, so it is done by Arrow functions; most brackets come again and again, and are remembered.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import text as X

#: What may stand before a reference, the reference, and what may follow it as a locator.
PREFIX = r"(?:(?:Цит\.\s*по(?:\s*(?:кн|ст)\.)?|[СсCc]м\.|[Сс]р\.)\s*:?\s*)?"
ID = r"@([A-Za-z0-9_](?:[A-Za-z0-9_.:\-]*[A-Za-z0-9_])?)"
NUMBER = r"([1-9]\d{0,2})(?:\s*[–—-]\s*([1-9]\d{0,2}))?"
LOCATOR = r"\s*,\s*(?:[сСcCpP]{1,2}\.|стр\.|[тТ]\.|[гГ]л\.|разд\.|[рР]ис\.|[тТ]абл\.|[чЧ]\.|[сС]т\.|§|[vV]ol\.|[nN]o\.|pp?\.|[сС]\s*\d)"
LENIENT_PREFIX = r"\s*(?:цит\.?\s*по(?:\s*(?:кн|ст)\.?)?|см\.?(?:\s*также)?|ср\.?|подробнее\s+см\.?|cit\.?\s*(?:by|from|in)?|see(?:\s+also)?|cf\.?)\s*:?\s*"
#: Brackets of either grammar, and a number or range with the further numbers directly behind it.
BRACKET = r"\[([^\[\]\n]{1,400})\]"
LENIENT_BRACKET = r"(?<![\w\])])\[([^\[\]\n]{1,200})\]"
LENIENT_NUMBERS = r"([0-9]{1,3})(?:[ \t\n\r\f\v]*[-–—][ \t\n\r\f\v]*([0-9]{1,3}))?(?=$|[ \t\n\r\f\v,])((?:[ \t\n\r\f\v]*,[ \t\n\r\f\v]*[0-9]{1,3}(?=[ \t\n\r\f\v]*(?:,|$)))*)"

_PART = re.compile(rf"\s*({PREFIX})(?:{ID}|{NUMBER})(\s*,[^;]*)?\s*", re.ASCII)
_LOCATOR, _LIST = re.compile(LOCATOR, re.ASCII), re.compile(r"\s*,\s*\d[\d\s,]*", re.ASCII)
_BRACKET, _CODE = re.compile(BRACKET), re.compile(r"`[^`\n]+`")
_PIECE = re.compile(r"`[^`\n]+`|\[[^\[\]\n]{1,400}\]|[^\[`]+|\[|`")
_LENIENT, _LENIENT_PREFIX, _LENIENT_NUMBERS = re.compile(LENIENT_BRACKET), re.compile(LENIENT_PREFIX.replace(r"\s", r"[ \t\n\r\f\v]"), re.I), re.compile(LENIENT_NUMBERS)

PART = T.StructType([T.StructField(n, T.ArrayType(T.IntegerType()) if n == "nums" else T.StringType()) for n in ("prefix", "kind", "id", "nums", "loc")])
PIECE = T.StructType([T.StructField("s", T.StringType()), T.StructField("p", T.ArrayType(PART))])
_PART_ARROW = pa.struct([("prefix", pa.string()), ("kind", pa.string()), ("id", pa.string()), ("nums", pa.list_(pa.int32())), ("loc", pa.string())])


def _strict_part(text: str) -> dict | None:
    m = _PART.fullmatch(text)
    if m is None:
        return None
    prefix, name, first, last, loc = m[1], m[2] or "", m[3] and int(m[3]), m[4] and int(m[4]), (m[5] or "").rstrip(" ")
    kind = "id" if name else "range" if last is not None else "list" if _LIST.fullmatch(loc) else "num"
    if kind == "range" and not first <= last <= first + 50 or kind == "num" and loc and not _LOCATOR.match(loc):
        return None
    more = [int(x) for x in re.findall("[0-9]+", loc)] if kind == "list" else []
    if any(n > 0x7FFFFFFF for n in more):
        return None
    nums = [] if kind == "id" else list(range(first, last + 1)) if kind == "range" else [first, *more]
    return {"prefix": prefix, "kind": kind, "id": name, "nums": nums, "loc": "" if kind == "list" else loc}


@lru_cache(maxsize=50_000)
def _strict_bracket(inner: str) -> list[dict]:
    """The parts of a bracket's content; none where any of them is no citation."""
    parts = [_strict_part(p) for p in inner.split(";")]
    return [] if None in parts else parts


@F.arrow_udf(T.ArrayType(T.ArrayType(PART)))
def _strict(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        if not t or "[" not in t:
            out.append([])
            continue
        if "`" in t:
            t = _CODE.sub(lambda m: " " * len(m[0]), t)
        out.append([g for g in map(_strict_bracket, _BRACKET.findall(t)) if g])
    return pa.array(out, pa.list_(pa.list_(_PART_ARROW)))


def strict_citations(c: Column) -> Column:
    """The citations of a text, inline code left out: an array of arrays of parts (prefix, kind, id, nums, loc). kind is id, range, list or num; nums are the part's numbers."""
    return _strict(c.cast("string"))


def refs_of(citations: Column) -> Column:
    """All references of citations in order, as text: @id or a number."""
    return F.flatten(F.transform(F.flatten(citations), lambda p: F.when(p["kind"] == "id", F.array(F.concat(F.lit("@"), p["id"]))).otherwise(p["nums"].cast("array<string>"))))


def strict_refs(c: Column) -> Column:
    """All references of a text in order, as text: @id or a number."""
    return refs_of(strict_citations(c))


@lru_cache(maxsize=50_000)
def _lenient_bracket(inner: str) -> list[int]:
    out: list[int] = []
    for part in inner.split(";"):
        m = _LENIENT_NUMBERS.match((_LENIENT_PREFIX.sub("", part, count=1) if _LENIENT_PREFIX.match(part) else part).strip(" "))
        if m:
            first, last = int(m[1]), m[2] and int(m[2])
            out += range(first, last + 1) if last and first < last <= first + 20 else [first]
            out += [int(x) for x in re.findall("[0-9]+", m[3])]
    return [n for n in out if 1 <= n <= 500]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _lenient_numbers(texts: pa.Array) -> pa.Array:
    return pa.array([[n for b in _LENIENT.findall(t) for n in _lenient_bracket(b)] if t and "[" in t else [] for t in texts.to_pylist()], pa.list_(pa.int32()))


def lenient_numbers(c: Column) -> Column:
    """Numbers from 1 to 500 of the brackets that no word character, bracket or parenthesis stands before; a range counts if it goes up by 20 at most, else its first number."""
    return _lenient_numbers(c.cast("string"))


@F.arrow_udf(T.ArrayType(PIECE))
def _pieces(texts: pa.Array) -> pa.Array:
    """The text cut at inline code and brackets; a bracket that is a citation has its parts."""
    out = []
    for t in texts.to_pylist():
        out.append([{"s": s, "p": _strict_bracket(s[1:-1]) if len(s) > 2 and s[0] == "[" and s[-1] == "]" else []} for s in _PIECE.findall(t or "")])
    return pa.array(out, pa.list_(pa.struct([("s", pa.string()), ("p", pa.list_(_PART_ARROW))])))


def render_numbers(nums: Column) -> Column:
    """Sorted and different; more than two in a row as a range."""
    own = F.array_sort(F.array_distinct(nums))
    whole = (F.size(own) > 2) & (F.element_at(own, -1) - F.element_at(own, 1) == F.size(own) - 1)
    return F.when(whole, F.concat(F.element_at(own, 1).cast("string"), F.lit("–"), F.element_at(own, -1).cast("string"))).otherwise(F.array_join(own.cast("array<string>"), "; "))


def rewritten(c: Column, numbers: Column) -> Column:
    """The text with each citation as numbers by a map from @id or number (as text); a citation with an unknown reference stays."""

    def part(p: Column) -> Column:
        keys = F.when(p["kind"] == "id", F.array(F.concat(F.lit("@"), p["id"]))).otherwise(p["nums"].cast("array<string>"))
        return F.struct(p["kind"].alias("kind"), p["prefix"].alias("prefix"), p["loc"].alias("loc"), F.transform(keys, lambda k: F.try_element_at(numbers, k)).alias("found"))

    def shown(p: Column) -> Column:
        nums = F.when(p["kind"] == "range", render_numbers(p["found"])).otherwise(F.array_join(p["found"].cast("array<string>"), ", "))
        return F.when(F.forall(p["found"], lambda n: n.isNotNull()), F.concat(p["prefix"], nums, p["loc"]))

    def joined(x: Column) -> Column:
        return F.when((F.size(x["p"]) > 0) & F.forall(x["p"], lambda t: t.isNotNull()), F.concat(F.lit("["), F.array_join(x["p"], "; "), F.lit("]"))).otherwise(x["s"])

    found = F.transform(_pieces(c.cast("string")), lambda x: F.struct(x["s"].alias("s"), F.transform(x["p"], part).alias("p")))
    done = F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.transform(x["p"], shown).alias("p")))
    return F.array_join(F.transform(done, joined), "")


def rewrite(texts: DataFrame, registry: DataFrame, by: str, text: str, ref: str, number: str, out: str = "rewritten") -> DataFrame:
    """texts with its citations as numbers of the registry of the same group; a group's registry is one map."""
    maps = registry.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(ref, number))).alias("__numbers"))
    joined = texts.join(maps, by, "left")
    return joined.withColumn(out, rewritten(F.col(text), F.coalesce("__numbers", F.create_map().cast("map<string,int>")))).drop("__numbers")


def after_period(c: Column) -> Column:
    """A citation behind a full stop, not that of an abbreviation of up to three letters or an initial."""
    return X.null_empty(c).rlike(r"(?<=[\p{L}\p{N})»\"]{4})\.\s*\[\d{1,3}(?:[,;–-][^\]]*)?\](?!\s*\.)")
