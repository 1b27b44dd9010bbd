"""Works as wholes: regions by places, statistics of a build, keys of their content, questions about paragraphs, and checks of what people enter."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import text as X
from folioscope.operators import registry as R
from folioscope.operators import segments as S

#: Abbreviations that a sentence doesn't end with, ways of confirming a source, sections that no snapshot holds, kinds of a build's blocks.
ABBREVIATIONS = r"и\s*др|и\s*пр|и\s*т\.\s*д|и\s*т\.\s*п|т\.\s*е|т\.\s*д|т\.\s*п|т\.\s*к|т\.\s*н|см|ср|напр|г|гг|в|вв|с|стр|р|рис|табл|им|ст|ч|п|пп|гл|разд|т|тт|вып|изд|ред|сост|пер|англ|нем|фр|лат|др|пр|акад|проф|доц|канд|млн|млрд|тыс|руб|коп|долл|мин|сек|обл|ул|пос|кв|экз|л|№|et\s+al|etc|vol|vols|p|pp|no|nos|ed|eds|cf|ibid|op\.\s*cit|e\.\s*g|i\.\s*e|fig|ch|sec|univ|dept|jr|sr|dr|prof|inc|ltd|co"
METHODS = ("catalog", "doi", "publisher", "original", "web_search")
SOURCE_STATUSES = ("pending", "confirmed", "suspicious", "rejected")
LEFT_OUT = ("Независимый аудит", "История сессий", "Журнал текущей работы", "Handoff и продолжение", "Память и продолжение")
LAST_UPDATE = "последнее обновление"
KINDS = ("chapter", "paragraph", "appendix", "table", "figure", "listing", "list")

#: What stands before an abbreviation, initials and the number of a section at the end of a line.
_BEFORE = r"(?:^|[\s(«\"'„“\[/—–-])"
_INITIALS = r"(?:^|[\s(«\"„“])(?:[А-ЯЁA-Z]\.\s*){1,3}$"
_SECTION = r"(?:^|\s)(?:п\.\s*|пп\.\s*|§\s*)?\d+(?:\.\d+)+\.\s*$"


def open_ended(c: Column) -> Column:
    """Whether a text ends with an abbreviation, initials, a section's number or an ellipsis, so that its full stop ends no sentence."""
    text = F.regexp_replace(X.null_empty(c), r"(?U)\s+$", "")
    dots = text.endswith("...") | text.endswith("…")
    return dots | (text.endswith(".") & (text.rlike(rf"(?iu){_BEFORE}(?:{ABBREVIATIONS})\.$") | text.rlike(_INITIALS) | text.rlike(_SECTION)))


def validator_regions(blocks: DataFrame) -> DataFrame:
    """blocks with place: title, toc, main, bibliography, appendix, last_page or other, by where the first and last of certain blocks stand.

    blocks: doc_id, idx, text and flags (segments.FLAGS; centred and breaks besides, where they are known). The title ends with its last styled line, or before the first heading of a part, or behind the first page break among the first lines. The bibliography is the first heading of that name behind the conclusion, or without a conclusion the last styled one. It ends with a table, an appendix, another part or a first-level heading without a number. The last page begins at its heading by the oath's table, or at the first title-styled line behind the main text.
    """
    df = S.classified(blocks)
    for flag in ("centred", "breaks"):
        df = df if flag in df.columns else df.withColumn(flag, F.lit(False))
    doc = Window.partitionBy("doc_id")
    idx, kind, toc = F.col("idx"), F.col("kind"), F.col("toc")
    first = lambda c: F.min(F.when(F.coalesce(c, F.lit(False)), idx)).over(doc)
    last = lambda c: F.max(F.when(F.coalesce(c, F.lit(False)), idx)).over(doc)
    part = kind.isin("annotation", "contents", "introduction", "conclusion", "bibliography", "chapter")
    size = F.sum(F.length("text")).over(doc.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(doc.orderBy("idx"))
    df = df.withColumns({"__n": F.max(idx).over(doc) + 1, "__structure": first(toc | part), "__early": (place <= 40) & (size <= 1500)})
    titled = last(F.col("title_style") & (F.col("__structure").isNull() | (idx < F.col("__structure"))))
    df = df.withColumn("__title", F.coalesce(titled + 1, F.col("__structure"), first(F.col("breaks") & F.col("__early")) + 1, F.lit(0)))
    df = df.withColumn("__conclusion", first((idx >= F.col("__title")) & ~toc & (kind == "conclusion")))
    listed = ~toc & (kind == "bibliography")
    behind = first(listed & (idx > F.col("__conclusion")))
    styled = last(listed & (F.col("heading_level").isNotNull() | F.col("bold") | F.col("centred")))
    df = df.withColumn("__bib", F.coalesce(behind, styled, last(listed)))
    after = F.greatest(F.col("__title"), F.coalesce("__conclusion", F.lit(0)))
    # the heading of the last sheet among the four blocks before the oath's table, or what follows the table
    oath = (F.col("type") == "tbl") & F.col("oath")
    sheet = F.last(F.when((X.heading_key(F.col("text")) == S.LAST_SHEET) & (idx >= after), idx), ignorenulls=True).over(doc.orderBy("idx").rowsBetween(-4, -1))
    following = F.first(F.when(F.col("type") != "tbl", idx), ignorenulls=True).over(doc.orderBy("idx").rowsBetween(1, Window.unboundedFollowing))
    df = df.withColumn("__sworn", F.when(oath, F.coalesce(sheet, F.when(following >= after, following))))
    df = df.withColumn("__last", F.coalesce(F.min("__sworn").over(doc), first(F.col("title_style") & (idx >= after) & (F.col("__conclusion").isNull() | (idx > F.col("__conclusion"))))))
    df = df.withColumn("__appendix", first(F.col("appendix_label") & (idx >= F.coalesce("__bib", "__conclusion", "__title"))))
    df = df.withColumn("__appendix", F.when(F.col("__last").isNull() | (F.col("__appendix") <= F.col("__last")), F.col("__appendix")))
    ends = (F.col("type") == "tbl") | (idx >= F.col("__last")) | F.col("appendix_label") | kind.isin("annotation", "contents", "introduction", "conclusion") | ((F.col("heading_level") == 1) & ~F.col("text").rlike(r"^\s*\d") & ~F.col("in_list"))
    df = df.withColumn("__bib_end", F.when(F.col("__bib").isNotNull(), F.coalesce(first((idx > F.col("__bib")) & F.coalesce(ends, F.lit(False))), F.col("__n"))))
    df = df.withColumn("__main_end", F.coalesce(F.least("__bib", "__appendix", "__last"), F.col("__n")))
    region = (
        F.when(toc, "toc").when(idx < F.col("__title"), "title").when(idx >= F.col("__last"), "last_page").when((idx >= F.col("__bib")) & (idx < F.col("__bib_end")), "bibliography")
        .when(idx >= F.col("__appendix"), "appendix").when(idx >= F.col("__main_end"), "other").otherwise("main")
    )
    return df.withColumn("place", region).select(*blocks.columns, "place")


def build_stats(blocks: DataFrame, listed: DataFrame, cited: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many blocks of each kind a work has, and how many sources it lists and cites. blocks: by, kind; listed and cited: by, ref."""
    counts = blocks.groupBy(*by).agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in KINDS])
    refs = lambda df, name: df.groupBy(*by).agg(F.count_distinct("ref").alias(name))
    return counts.join(refs(listed, "in_list"), list(by), "left").join(refs(cited, "cited"), list(by), "left").na.fill(0)


def seeded_questions(paragraphs: DataFrame, questions: Mapping[str, Sequence[str]], generic: Sequence[str], keep: Sequence[str], seed: int, most: int = 3) -> DataFrame:
    """Up to most questions for each paragraph: one for each of its first categories, by a hash of seed, place and category, and a generic one where there are fewer. paragraphs: keep, categories (an array, in the order of the patterns). Placeholders in braces stand for the paragraph."""

    def choice(options: Sequence[str], category: Column) -> Column:
        salt = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keep], category)
        place = F.conv(F.substring(F.md5(salt), 1, 8), 16, 10).cast("long") % len(options)
        return F.regexp_replace(F.get(F.array(*[F.lit(q) for q in options]), place.cast("int")), r"\{[^{}]*\}", "this paragraph")

    def asked(c: Column) -> Column:
        text = F.lit(None).cast("string")
        for name, options in questions.items():
            text = F.when(c == name, choice(options, c)).otherwise(text)
        return F.struct(c.alias("category"), text.alias("question"))

    known = F.slice(F.filter(F.array_distinct("categories"), lambda c: c.isin(*questions)), 1, most)
    own = F.transform(known, asked)
    more = F.when(F.size(known) < most, F.array(F.struct(F.lit("generic").alias("category"), choice(generic, F.lit("generic")).alias("question")))).otherwise(F.array().cast("array<struct<category:string,question:string>>"))
    return paragraphs.select(*keep, F.posexplode(F.concat(own, more)).alias("pos", "q")).select(*keep, "pos", "q.category", "q.question")


#: Numbers of captions by kind.
CAPTION_NUMBERS = {"table": r"(?iu)^\s*таблица\s+((?:[А-ЯA-Z]\.)?\d+(?:\.\d+)*)", "figure": r"(?iu)^\s*(?:рисунок|рис\.)\s+((?:[А-ЯA-Z]\.)?\d+(?:\.\d+)*)"}


def caption_numbers(blocks: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep, kind and number of each caption."""
    each = [F.struct(F.lit(kind).alias("kind"), F.regexp_extract(X.null_empty(F.col("text")), p, 1).alias("number")) for kind, p in CAPTION_NUMBERS.items()]
    return blocks.select(*keep, F.explode(F.filter(F.array(*each), lambda x: x["number"] != "")).alias("x")).select(*keep, "x.kind", "x.number")


#: Fixed value: a chapter's number at the beginning of its heading.
CHAPTER_PREFIX = r"(?iuU)^\s*глава\s+([IVXLCDM]+|\d+|перв\w*|втор\w*|трет\w*|четв[её]рт\w*|пят\w*|шест\w*)(?=$|[\s.:,)—–-])"


def chapter_prefix(c: Column) -> Column:
    """(numbering, doubled) of a heading that begins with a chapter's number: arabic, spelled, or null where it is Roman or there is none; whether the prefix stands twice."""
    line = F.trim(F.get(F.split(X.null_empty(c), "\n"), 0))
    token = F.regexp_extract(line, CHAPTER_PREFIX, 1)
    kind = F.when((token == "") | (token.rlike(r"^[IVXLCDM]+$") & (X.from_roman(token, 100) > 0)), None).when(token.rlike(r"^\d+$"), "arabic").otherwise("spelled")
    return F.struct(kind.alias("numbering"), ((token != "") & X.collapse_space(F.lower(c)).rlike(r"^глава\s+\S+\s+глава\s+\S+")).alias("doubled"))


_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"[ \t]{0,3}(#{1,2})[ \t]+(.*?)[ \t#]*$")
_SKIPPED = {"".join(t.split()).casefold() for t in LEFT_OUT}


def _projected(text: str) -> str:
    """Lines of all sections but those left out; what lies in a fence is neither a heading nor an update."""
    kept, fence, hidden = [], "", False
    for line in text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        mark = _FENCE.match(line)
        if fence:
            shown = not hidden
            fence = "" if mark and mark[1].startswith(fence) else fence
        elif mark:
            shown, fence = not hidden, mark[1]
        else:
            if heading := _HEADING.match(line):
                hidden = heading[1] == "##" and "".join(heading[2].split()).casefold() in _SKIPPED
            shown = not hidden and not line.lstrip(" \t*_->#").casefold().startswith(LAST_UPDATE)
        if shown:
            kept.append(line.rstrip())
    return "\n".join(kept).strip("\n") + "\n"


@F.arrow_udf(T.StringType())
def _project(texts: pa.Array) -> pa.Array:
    return pa.array([_projected(t or "") for t in texts.to_pylist()], pa.string())


def state_projection(c: Column) -> Column:
    """What a snapshot holds of a state text: without sections that change all the time, lines of the last update and white space at the ends. Fences are followed line by line, so it is an Arrow function."""
    return _project(c.cast("string"))


def draft_key(c: Column) -> Column:
    """A draft's SHA-256 whatever its blanks: single blanks, no blanks at the ends of lines, one empty line at most."""
    lines = F.transform(F.split(F.regexp_replace(F.ltrim(X.null_empty(c), F.lit("﻿")), r"\r\n?", "\n"), "\n"), lambda x: X.strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.sha2(X.strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")).cast("binary"), 256)


def content_key(drafts: DataFrame, documents: DataFrame, by: str, protocol: str, tools: str) -> DataFrame:
    """A snapshot's envelope for each work: the key of its drafts' texts and its document's fingerprint, with the versions that made it. drafts: by, path, text; documents: by, fingerprint."""
    rows = drafts.select(by, "path", draft_key(F.col("text")).alias("key")).groupBy(by).agg(F.array_sort(F.collect_list(F.array("path", "key"))).alias("drafts"))
    df = rows.join(documents.select(by, "fingerprint"), by, "full_outer")
    body = F.to_json(F.struct(F.coalesce("drafts", F.array().cast("array<array<string>>")).alias("drafts"), F.col("fingerprint").alias("docx")))
    return df.select(by, F.sha2(body, 256).alias("content_key"), F.lit(protocol).alias("protocol_version"), F.lit(tools).alias("tool_versions"))


def mark_problems(marks: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Marks of sources that can't be taken: an unknown status or method, a confirmation without its method and place, a doubt without a note. marks: keep, status, method, url, note."""
    has = lambda c: F.trim(X.null_empty(F.col(c))) != ""
    status = R.normal_status(F.col("status"))
    codes = F.array_compact(
        F.array(
            F.when(~status.isin(*SOURCE_STATUSES), "status"),
            F.when(has("method") & ~F.trim("method").isin(*METHODS), "method"),
            F.when((status == "confirmed") & ~(has("method") & (has("url") | has("note"))), "unproved"),
            F.when(status.isin("suspicious", "rejected") & ~has("note"), "no note"),
        )
    )
    return marks.select(*keep, F.explode(codes).alias("problem"))


def content_problems(df: DataFrame, keep: Sequence[str], json: str, fields: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """All problems of objects given as JSON: no object, unknown keys (those that begin with _ are anyone's), required ones that are absent or empty, and values of another kind. fields: kind (string, number, list or object) by key."""
    raw = F.from_json(F.col(json), T.MapType(T.StringType(), T.StringType()))
    names = F.array(*[F.lit(k) for k in fields])
    keys = F.map_keys("__o")
    unknown = F.transform(F.array_sort(F.filter(F.array_except(keys, names), lambda k: ~k.startswith("_"))), lambda k: F.concat(F.lit("unknown "), k))
    value = lambda k: F.col("__o")[k]
    absent = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(value(k), F.lit(""))) == "", F.lit(f"missing {k}")) for k in required]))
    shapes = {"number": r"^-?\d+(?:\.\d+)?$", "list": r"^\[", "object": r"^\{"}
    wrong = F.array_compact(F.array(*[F.when(value(k).isNotNull() & (~value(k).rlike(shapes[v]) if v in shapes else value(k).rlike(r"^[\[{]")), F.lit(f"no {v} {k}")) for k, v in fields.items()]))
    found = df.withColumn("__o", raw)
    problems = F.when(F.col("__o").isNull(), F.array(F.lit("no object"))).otherwise(F.concat(unknown, absent, wrong))
    return found.select(*keep, F.explode(problems).alias("problem"))


def may_overwrite(registries: DataFrame, by: Sequence[str]) -> DataFrame:
    """Whether a registry may be written anew: it holds nothing that was checked."""
    return registries.groupBy(*by).agg((F.count_if(R.normal_status(F.col("status")) != "pending") == 0).alias("may_overwrite"))


def report_counts(found: DataFrame, by: Sequence[str], most: int = 20) -> DataFrame:
    """Errors and warnings of a report, and the first codes of each in order. found: by, severity, code."""
    first = lambda s: F.slice(F.array_sort(F.collect_set(F.when(F.col("severity") == s, F.col("code")))), 1, most)
    return found.groupBy(*by).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.array_join(first("error"), "; ").alias("error_codes"), F.array_join(first("warning"), "; ").alias("warning_codes"))
