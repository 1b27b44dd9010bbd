"""Scalar text functions, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a word in any script; Java's \w and \b know ASCII only.
W = r"[\p{L}\p{N}_]"
SPACE = r"(?U)\s+"


def null_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse_space(c: Column) -> Column:
    """White space of any kind as one blank, none at the ends."""
    return F.trim(F.regexp_replace(null_empty(c), SPACE, " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold(c: Column) -> Column:
    """Lower case, with ё as е."""
    return F.replace(F.lower(c), F.lit("ё"), F.lit("е"))


def normalise_phrase(c: Column) -> Column:
    """Without quotes around it, folded, with single blanks."""
    bare = F.regexp_replace(collapse_space(c), r"^(?:\"(.*)\"|'(.*)'|«(.*)»|“(.*)”)$", "$1$2$3$4")
    return fold(collapse_space(bare))


def heading_key(c: Column) -> Column:
    """What headings are compared by: folded, single blanks, no full stop, colon or semicolon at the end."""
    return F.regexp_replace(fold(collapse_space(c)), r"[\s.:;]+$", "")


def title_key(c: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(null_empty(c), SPACE, ""))


def paragraphs(c: Column, more_than: int = 30) -> Column:
    """Lines, with single blanks, of more than so many characters."""
    lines = F.transform(F.split(null_empty(c), "\n"), collapse_space)
    return F.filter(lines, lambda p: F.length(p) > more_than)


def split_sentences(c: Column) -> Column:
    """Parts behind a full stop, exclamation or question mark and white space; those of up to five characters go."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: (F.length(s) > 5) & (F.length(strip(s)) > 0))


def sentences(paras: Column) -> Column:
    return F.flatten(F.transform(paras, split_sentences))


def tokens(c: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(null_empty(c), SPACE), lambda t: F.length(t) > 0)


def word_count(c: Column) -> Column:
    return F.regexp_count(null_empty(c), F.lit(rf"{W}+"))


def letter_words(c: Column) -> Column:
    """Words of letters only, in lower case: a run of letters, digits and underscores that holds nothing else than letters."""
    return F.regexp_extract_all(F.lower(null_empty(c)), F.lit(rf"(?<!{W})\p{{L}}+(?!{W})"), F.lit(0))


def count_bounded(text: Column, phrase: str) -> Column:
    """How often a phrase stands in a normalised text with no word character at either side. Most texts don't hold it at all, which needs no pattern; the pattern begins with the phrase, as a literal is searched for by leaps, and looks at what is beside it only where it stands."""
    quoted = "".join(rf"\{x}" if x in r"\.[]{}()*+-?^$|&~#" else x for x in phrase)
    return F.when(F.contains(text, F.lit(phrase)), F.regexp_count(text, F.lit(rf"{quoted}(?<!{W}{quoted})(?!{W})"))).otherwise(F.when(text.isNotNull(), 0))


def count_plain(text: Column, phrase: Column) -> Column:
    """How often a phrase stands in a text, without overlaps and whatever is beside it."""
    return F.when(F.length(phrase) > 0, ((F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.length(phrase)).cast("int")).otherwise(0)


def looks_like_toc(c: Column, most: int = 250) -> Column:
    """A short line that ends with a tab, dots or a line and a page number."""
    return (F.length(strip(null_empty(c))) <= most) & null_empty(c).rlike(r"(?:\t|\.{3,}|…+|_{3,})\s*\d{1,4}\s*$")


def is_upper(c: Column) -> Column:
    """Four letters or more, all of them capitals."""
    letters = F.regexp_replace(null_empty(c), r"[^\p{L}]", "")
    return (F.length(letters) >= 4) & (letters == F.upper(letters))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…")))


def is_url(c: Column) -> Column:
    return F.lower(null_empty(c)).rlike(r"^https?://\S+$")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(null_empty(c)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_path(c: Column) -> Column:
    """A relative path without scheme, drive or a step above its root."""
    path = F.replace(null_empty(c), F.lit("\\"), F.lit("/"))
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")),
        lambda a, s: F.struct((n := a["d"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("d"), F.least(a["m"], n).alias("m")),
    )
    return (F.length(path) > 0) & ~path.rlike(r"^(?:/|[A-Za-z]:|[A-Za-z][A-Za-z0-9+.-]*://)") & (depth["m"] >= 0)


def logical_id(c: Column) -> Column:
    """A path with slashes, without ./ and doubled slashes."""
    path = F.regexp_replace(F.replace(null_empty(c), F.lit("\\"), F.lit("/")), "/{2,}", "/")
    return F.regexp_replace(path, r"^(?:\./)+", "")


def strip_comments(c: Column) -> Column:
    """Without HTML comments; a comment's line breaks stay."""
    parts = F.split(null_empty(c), r"(?s)(?=<!--)|(?<=-->)")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"(?s)^<!--.*-->$"), F.regexp_replace(p, r"[^\n]", "")).otherwise(p)), "")


def mask_code(c: Column) -> Column:
    """Without fenced blocks (an open one runs to the end) and inline code; the number of lines stays."""
    lines = F.split(null_empty(c), "\n")
    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, line: Column) -> Column:
        mark = F.regexp_extract(line, r"^ {0,3}(`{3,}|~{3,})", 1)
        inside = F.length(a["fence"]) > 0
        closes = inside & (F.length(mark) >= F.length(a["fence"])) & (F.substring(mark, 1, 1) == F.substring(a["fence"], 1, 1)) & strip(line).rlike(r"^(?:`+|~+)$")
        opens = ~inside & (F.length(mark) > 0)
        fence = F.when(closes, F.lit("")).when(opens, mark).otherwise(a["fence"])
        kept = F.when(inside | opens, F.lit("")).otherwise(F.regexp_replace(line, r"(`+)(?!`).*?(?<!`)\1(?!`)", ""))
        return F.struct(fence.alias("fence"), F.concat(a["out"], F.array(kept)).alias("out"))

    return F.array_join(F.aggregate(lines, start, step)["out"], "\n")


def table_cells(c: Column) -> Column:
    """Cells of a pipe table's row; a pipe behind a backslash is text."""
    inner = F.regexp_replace(strip(null_empty(c)), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: F.replace(strip(x), F.lit("\\|"), F.lit("|")))


def significant_length(c: Column) -> Column:
    """Letters and digits that are left without code, comments, headings and list marks."""
    plain = F.regexp_replace(strip_comments(mask_code(c)), r"(?m)^\s*(?:#{1,6}\s.*|[-*+]\s+|\d+[.)]\s+)", "")
    return F.length(F.regexp_replace(plain, r"[^\p{L}\p{N}]", ""))


def pages_range(c: Column) -> Column:
    """A hyphen between page numbers as an en dash."""
    return F.regexp_replace(null_empty(c), r"(\d)\s*[-–—]\s*(?=\d)", "$1–")


def sha256_text(c: Column) -> Column:
    return F.sha2(null_empty(c).cast("binary"), 256)


def canonical_sha256(*columns: str) -> Column:
    """SHA-256 of the columns as compact JSON with sorted keys; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def iso_timestamp(c: Column) -> Column:
    """A date, or a date and a time with blank or T, a fraction and a zone; anything else is null. Times without a zone are UTC."""
    text = strip(null_empty(c))
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ](?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d)?)?)?$")
    plain = F.regexp_replace(F.regexp_replace(F.replace(F.replace(text, F.lit(","), F.lit(".")), F.lit("T"), F.lit(" ")), r"(\.\d{6})\d+", "$1"), r"([+-]\d{2})(\d{2})?$", "$1:$2")
    plain = F.when(F.length(text) == 10, text).otherwise(F.regexp_replace(F.regexp_replace(plain, r"([+-]\d{2}):$", "$1:00"), "Z$", "+00:00"))
    return F.when(shape, plain.try_cast("timestamp"))


def is_dotted_date(c: Column) -> Column:
    return null_empty(c).rlike(r"^\d{2}\.\d{2}\.\d{4}$")


def twips_to_mm(c: Column) -> Column:
    return c * 25.4 / 1440


def emu_to_mm(c: Column) -> Column:
    return c / 36000.0


def emu_to_pt(c: Column) -> Column:
    return c / 12700.0


#: Roman digits in order of value.
ROMAN = ((100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(n: int) -> str:
    out = ""
    for value, letters in ROMAN:
        out += letters * (n // value)
        n %= value
    return out


def to_roman(c: Column, most: int = 60) -> Column:
    """The Roman numeral of a number from 1 to most; null for others."""
    return F.when(c.between(1, most), F.get(F.array(*[F.lit(roman(i)) for i in range(1, most + 1)]), c.cast("int") - 1))


def from_roman(c: Column, most: int = 60) -> Column:
    """The number of a canonical Roman numeral up to most, in either case; null for others."""
    at = F.array_position(F.array(*[F.lit(roman(i)) for i in range(1, most + 1)]), F.upper(c))
    return F.when(at > 0, at.cast("int"))
