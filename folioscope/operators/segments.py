"""Structure of documents: kinds of blocks, regions, sections, chapters; markers and patterns in paragraphs.

Blocks are rows (doc_id, idx, text and flags). A block's kind is a chain of conditions; regions are running windows over a document's blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X

#: Names of parts of a work, as heading_key gives them.
ANNOTATION = r"^(?:аннотация|реферат|abstract)$"
CONTENTS = r"^(?:содержание|оглавление)$"
BIBLIOGRAPHY = r"(?U)^(?:список\s+(?:использованн\w+\s+|цитируем\w+\s+)?(?:литературы|источников)(?:\s+и\s+(?:литературы|источников))?|библиографическ\w+\s+список|библиография|(?:использованная\s+)?литература(?:\s+и\s+источники)?|источники\s+и\s+литература)$"
CHAPTER = r"(?U)^глава\s+(\d{1,2}|[ivxlc]{1,7}|первая|вторая|третья|четвертая|пятая|шестая)((?!\w).*)?$"
APPENDIX = r"(?U)^приложение(?:\s+(?:№\s*)?(\d{1,2}|[а-яa-z])(?!\w))?(.*)$"
SEPARATED = r"^\s*[.:—–-]\s*(.*)$"
CONCLUSIONS = r"^выводы\s+(?:по\s+)?(?:главе|первой|второй|третьей|четвертой|пятой|[ivx\d]+\s+главе)"
ORDINALS = {"первая": 1, "вторая": 2, "третья": 3, "четвертая": 4, "пятая": 5, "шестая": 6}
LAST_SHEET = "выпускная квалификационная работа"
OATH = r"(?iuU)выполнена\s+мной\s+(?:совершенно\s+)?самостоятельно"
CAPTION = r"(?iu)^(?:(?:таблица|рисунок|рис\.|листинг|схема|диаграмма)\s*(?:№\s*)?[\dA-Za-zА-Яа-яЁё]{1,4}(?:\.\d+)*(?:\s*[.:—–-]\s*.{0,250})?|источник\s*:.{0,300})$"
PLACEHOLDER = r"(?iu)^\[\s*Здесь\s+вставить[^\]]*\]$"
BODY = ("introduction", "chapter", "conclusion")
AFTER = ("conclusion", "bibliography", "appendix", "appendix_divider", "other")

#: Marks of unfinished text, by code.
MARKERS = (
    ("CHECK_SOURCE", r"(?iu)\[ПРОВЕРИТЬ(?:[:\s][^\]\n]*)?\]"),
    ("NEEDS_CLARIFICATION", r"(?iu)\[ТРЕБУЕТ\s+УТОЧНЕНИЯ(?:[:\s][^\]\n]*)?\]"),
    ("FILL_IN", r"(?iu)\[(?:ВСТАВИТЬ|ЗАПОЛНИТЬ|ДОПОЛНИТЬ)(?:[:\s][^\]\n]*)?\]"),
    ("VALUE_PLACEHOLDER", r"\[(?:N|X)\]"),
    ("VALUE_PLACEHOLDER", r"(?iu)\[список\]"),
    ("TEMPLATE_VARIABLE", r"\{\{[^{}\n]{1,80}\}\}"),
    ("TITLE_PLACEHOLDER", r"(?iu)\[Название[^\]\n]*\]"),
    ("DRAFT_COMMENT", r"(?iu)<!--\s*(?:Черновик|Заполняется)"),
    ("TODO", r"(?<![\p{L}\p{N}_])(?:TODO|FIXME|TBD)(?![\p{L}\p{N}_])"),
    ("TODO", r"\[XXX\]"),
    ("FIGURE_PLACEHOLDER", r"(?iu)\[\s*Здесь\s+вставить[^\]\n]*\]"),
)

#: Flags that a block may have; a table without a flag's column has it nowhere.
FLAGS = ("toc", "code", "caption", "in_list", "title_style", "bold", "upper", "appendix_label", "appendix_title", "bibliography_style", "oath")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def with_flags(blocks: DataFrame) -> DataFrame:
    df = blocks
    for flag in FLAGS:
        df = df.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) if flag in blocks.columns else F.lit(False))
    for name, kind in (("type", "string"), ("heading_level", "int")):
        if name not in blocks.columns:
            df = df.withColumn(name, F.lit("p" if name == "type" else None).cast(kind))
    return df


def chapter_number(token: Column) -> Column:
    """From digits, an ordinal word or a canonical Roman numeral."""
    words = F.create_map(*[F.lit(x) for pair in ORDINALS.items() for x in pair])
    digits = F.when(token.rlike(r"^\d+$"), token.try_cast("int"))
    return F.nullif(F.coalesce(digits, F.try_element_at(words, token), X.from_roman(token)), F.lit(0))


def classified(blocks: DataFrame) -> DataFrame:
    """blocks with kind (the boundary that a block is, or null) and number (of a chapter)."""
    df = with_flags(blocks).withColumn("__key", X.heading_key(F.col("text")))
    key, styled = F.col("__key"), F.col("heading_level").isNotNull()
    loose = styled | F.col("bold") | F.col("upper")
    rest = F.regexp_extract(key, CHAPTER, 2)
    title = F.when(rest.rlike(SEPARATED), F.regexp_extract(rest, SEPARATED, 1)).when(loose & rest.rlike(r"^\s"), F.trim(rest))
    number = F.when(key.rlike(CHAPTER), chapter_number(F.regexp_extract(key, CHAPTER, 1)))
    chapter = number.isNotNull() & ~rest.rlike(r"^\.\d") & ((F.trim(rest) == "") | (title.isNotNull() & (loose | ~title.rlike(r"[.!?]\s+\S"))))
    tail = F.regexp_extract(key, APPENDIX, 2)
    appendix = key.rlike(APPENDIX) & ((F.trim(tail) == "") | tail.rlike(SEPARATED) | (loose & (F.regexp_extract(key, APPENDIX, 1) != "") & tail.rlike(r"^\s")))
    none = F.lit(None).cast("string")
    kind = (
        F.when(F.col("type") == "tbl", F.when(F.col("oath"), "last_sheet"))
        .when(F.col("toc") | (X.strip(X.null_empty(F.col("text"))) == "") | X.looks_like_toc(F.col("text")) | (key == ""), none)
        .when(F.col("appendix_label"), "appendix")
        .when(F.col("appendix_title") | F.col("bibliography_style") | F.col("code") | F.col("caption"), none)
        .when(F.col("in_list") & ~styled, none)
        .when(F.col("title_style"), F.when(key == LAST_SHEET, "last_sheet"))
        .when((F.length(key) > 300) & ~styled, none)
        .when(key.rlike(ANNOTATION), "annotation")
        .when(key.rlike(CONTENTS), "contents")
        .when(key == "введение", "introduction")
        .when(key == "заключение", "conclusion")
        .when(key.rlike(BIBLIOGRAPHY), "bibliography")
        .when(key == "приложения", "appendix_divider")
        .when(chapter, "chapter")
        .when(appendix, "appendix")
        .when(key == LAST_SHEET, "last_sheet")
        .when(styled & ~key.rlike(CONCLUSIONS), "heading")
    )
    return df.withColumn("kind", kind).withColumn("number", F.when(F.col("kind") == "chapter", number)).drop("__key")


def regions(blocks: DataFrame) -> DataFrame:
    """blocks with region (counted in each document from 0), region_kind, chapter_no and starts (is it the region's heading).

    A block belongs to the last boundary before it. A first-level heading inside introduction or chapter is a chapter of its own where the document names none; a chapter's number is the one given, or one more than the largest so far. The last sheet counts only behind the body.
    """
    every = Window.partitionBy("doc_id")
    upto = every.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    before = every.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    kind, level, key = F.col("kind"), F.col("heading_level"), X.heading_key(F.col("text"))
    heads = (F.coalesce(kind, F.lit("")) == "heading") & (F.coalesce(level, F.lit(0)) == 1)
    df = classified(blocks).withColumns({"__lead": F.when(heads, F.regexp_extract(key, r"^(\d{1,2})(?:\.|\)|\s)\s*\S", 1).try_cast("int")), "__sub": heads & key.rlike(r"^\d+\.\d+")})
    df = df.withColumns({"__named": F.coalesce(F.bool_or(kind == "chapter").over(every), F.lit(False)), "__seen": F.coalesce(F.bool_or(kind.isin(*BODY, "bibliography")).over(before), F.lit(False))})
    # boundaries that hold by themselves; the last one tells what a heading between them is
    df = df.withColumn("__own", F.when((kind == "heading") | ((kind == "last_sheet") & ~F.col("__seen")), None).otherwise(kind))
    df = df.withColumn("__last", F.coalesce(F.last("__own", ignorenulls=True).over(before), F.lit("front")))
    implied = F.when(heads & ~F.col("__named") & ~F.col("__sub") & F.col("__last").isin("introduction", "chapter"), "chapter").when(heads & F.col("__last").isin(*AFTER), "other")
    df = df.withColumn("__kind", F.coalesce("__own", implied))
    # the largest number so far: t = max(t + step, given), hence the sum of steps and the largest given less the sum up to it
    chapter = F.col("__kind") == "chapter"
    given = F.when(chapter, F.when(kind == "heading", F.col("__lead")).otherwise(F.col("number")))
    step = F.when(chapter & ((kind == "heading") | F.col("number").isNull()), 1).otherwise(0)
    df = df.withColumns({"__given": given, "__sum": F.sum(step).over(upto)})
    df = df.withColumn("__top", F.col("__sum") + F.greatest(F.lit(0), F.coalesce(F.max(F.col("__given") - F.col("__sum")).over(upto), F.lit(0))))
    number = F.when(chapter, F.when(kind == "heading", F.col("__top")).otherwise(F.coalesce("number", "__top"))).cast("int")
    df = df.withColumns({"__number": number, "region": F.count("__kind").over(upto).cast("int"), "region_kind": F.coalesce(F.last("__kind", ignorenulls=True).over(upto), F.lit("front")), "starts": F.col("__kind").isNotNull()})
    df = df.withColumn("chapter_no", F.when(F.col("region_kind") == "chapter", F.last("__number", ignorenulls=True).over(upto)))
    return df.drop("__lead", "__sub", "__named", "__seen", "__own", "__last", "__kind", "__given", "__sum", "__top", "__number")


def chosen_bibliography(blocks: DataFrame) -> DataFrame:
    """Of each document the list of references that counts: doc_id, region, heading_idx, entries, after_conclusion, and how many regions there are.

    Those with entries come first, then those behind the last conclusion (any, where there is none), then the earlier one. blocks: as regions gives them, with entry (is the block a list's entry). Two aggregates and a join of a few rows a document."""
    lists = blocks.filter("region_kind = 'bibliography'").groupBy("doc_id", "region").agg(F.min("idx").alias("heading_idx"), F.count_if(F.col("entry") & ~F.col("starts")).alias("entries"))
    last = blocks.filter("region_kind = 'conclusion' and starts").groupBy("doc_id").agg(F.max("idx").alias("__last"))
    seen = lists.join(last, "doc_id", "left").withColumn("after_conclusion", F.col("heading_idx") > F.coalesce("__last", F.lit(-1)))
    rank = F.struct((F.col("entries") == 0).alias("none"), (~F.col("after_conclusion")).alias("early"), "heading_idx", "region", "entries", "after_conclusion")
    best = seen.groupBy("doc_id").agg(F.min(rank).alias("b"), F.count("*").alias("regions"))
    return best.select("doc_id", *[F.col(f"b.{c}").alias(c) for c in ("region", "heading_idx", "entries", "after_conclusion")], "regions")


def section_name(kind: Column, number: Column) -> Column:
    return F.when(kind == "chapter", F.concat(F.lit("chapter"), number.cast("string"))).when(kind.isin("introduction", "conclusion"), kind)


def measured(text: Column) -> Column:
    """Is a paragraph text to be measured: no heading, code, caption, placeholder or short line of conclusions? Of rows with flags; text has single blanks."""
    service = F.col("toc") | F.col("code") | F.col("caption") | F.col("title_style") | F.col("appendix_label") | F.col("appendix_title") | F.col("heading_level").isNotNull() | X.looks_like_toc(F.col("text"))
    short = (F.length(text) < 80) & X.heading_key(text).rlike(CONCLUSIONS)
    return (F.col("type") == "p") & ~service & (text != "") & ~text.rlike(CAPTION) & ~text.rlike(PLACEHOLDER) & ~short


def analysed(blocks: DataFrame) -> DataFrame:
    """Paragraphs that are text to be measured; text has single blanks."""
    text = X.collapse_space(F.col("text"))
    return with_flags(blocks).filter(measured(text)).withColumn("text", text)


def sections(blocks: DataFrame) -> DataFrame:
    """The text of each named section of a document: its analysed paragraphs over 30 characters, in order."""
    df = analysed(regions(blocks).filter("not starts")).withColumn("section", section_name(F.col("region_kind"), F.col("chapter_no"))).filter("section is not null")
    parts = F.array_sort(F.collect_list(F.when(F.length("text") > 30, F.struct("idx", "text"))))
    return df.groupBy("doc_id", "section").agg(F.size(parts).cast("long").alias("paragraphs"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def missing_sections(found: DataFrame) -> DataFrame:
    """Sections that a document should have and hasn't: introduction, conclusion and every chapter up to its last one."""
    top = F.coalesce(F.max(F.regexp_extract("section", r"^chapter(\d+)$", 1).try_cast("int")), F.lit(0))
    wanted = found.groupBy("doc_id").agg(top.alias("n")).select("doc_id", F.explode(F.concat(F.array(F.lit("introduction"), F.lit("conclusion")), F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: F.concat(F.lit("chapter"), i.cast("string")))).otherwise(F.array().cast("array<string>")))).alias("section"))
    return wanted.join(found.select("doc_id", "section"), ["doc_id", "section"], "left_anti")


def chapter_ranges(headings: DataFrame, last: DataFrame) -> DataFrame:
    """[start, end) of each chapter: up to the next heading, or the document's end. headings: doc_id, idx; last: doc_id, n."""
    following = F.lead("idx").over(Window.partitionBy("doc_id").orderBy("idx"))
    return headings.withColumn("__next", following).join(last, "doc_id").select("doc_id", F.col("idx").alias("start"), F.coalesce("__next", "n").alias("end"))


def may_hold_marks(text: Column) -> Column:
    """Most texts hold nothing that one of MARKERS could begin with."""
    return reduce(or_, [F.contains(text, F.lit(x)) for x in ("[", "{{", "<!--", "TODO", "FIXME", "TBD")])


def marks_of(text: Column, patterns: Sequence[tuple[str, str]] = MARKERS) -> Column:
    """The marks of a text in the order of the patterns: rank, code and mark. Each pattern is a literal of its own, compiled once."""
    def named(i: int, code: str) -> Callable[[Column], Column]:
        return lambda m: F.struct(F.lit(i).alias("rank"), F.lit(code).alias("code"), m.alias("mark"))

    return F.flatten(F.array(*[F.transform(F.regexp_extract_all(X.null_empty(text), F.lit(p), F.lit(0)), named(i, code)) for i, (code, p) in enumerate(patterns)]))


def markers(df: DataFrame, keep: Sequence[str], text: str = "text", patterns: Sequence[tuple[str, str]] = MARKERS) -> DataFrame:
    """A row for each mark: code, place in the order of the patterns, and the mark."""
    if patterns is MARKERS:
        df = df.filter(may_hold_marks(F.col(text)))
    return df.select(*keep, F.posexplode(marks_of(F.col(text), patterns)).alias("pos", "m")).select(*keep, "pos", "m.code", "m.mark")


def is_soft(mark: Column) -> Column:
    return F.upper(F.trim(mark)).startswith("[ПРОВЕРИТЬ")


def distinct_marks(found: DataFrame, keep: Sequence[str], most: int = 10) -> DataFrame:
    """Different marks in the order of their first place: the first ones, and how many more there are."""
    each = found.groupBy(*keep, "mark").agg(F.min("pos").alias("pos"))
    all_ = F.array_sort(F.collect_list(F.struct("pos", "mark")))
    return each.groupBy(*keep).agg(F.array_join(F.transform(F.slice(all_, 1, most), lambda m: m["mark"]), " ").alias("shown"), F.greatest(F.size(all_) - most, F.lit(0)).cast("long").alias("more"))


def tagged(paragraphs: DataFrame, patterns: Sequence[tuple[str, Sequence[str], Sequence[str]]], keep: Sequence[str], section: str | None = None, text: str = "text", allowed: Sequence[str] = ()) -> DataFrame:
    """A row for each category that applies to a paragraph, with the markers found. patterns: (category, markers, sections in which it counts; none: in all). A marker stands within word bounds; allowed ones don't count."""
    low = F.lower(X.collapse_space(F.col(text)))
    skip = {a.lower() for a in allowed}
    each = []
    for category, words, where in patterns:
        hits = F.array_compact(F.array(*[F.when(X.count_bounded(low, w.lower()) > 0, F.lit(w)) for w in words if w.lower() not in skip])) if any(w.lower() not in skip for w in words) else F.array().cast("array<string>")
        fits = F.lit(True) if not where or section is None else F.col(section).isin(*where)
        each.append(F.when(fits & (F.size(hits) > 0), F.struct(F.lit(category).alias("category"), F.array_join(hits, ";").alias("found"))))
    return paragraphs.select(*keep, F.explode(F.array_compact(F.array(*each))).alias("t")).select(*keep, "t.category", "t.found")


def service_paragraph(c: Column, phrases: Sequence[str]) -> Column:
    low = F.lower(X.null_empty(c))
    return F.exists(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: F.contains(low, p)) if phrases else F.lit(False)


def html_blocks(pages: DataFrame, keep: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """Visible text blocks of web pages in order: scripts, styles, navigation and footers go, block tags end a block."""
    plain = F.regexp_replace(X.null_empty(F.col(html)), r"(?is)<(script|style|nav|footer|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    parts = F.split(plain, r"(?i)<\s*/?\s*(?:p|div|h[1-6]|li|ul|ol|br|tr|td|table|article|section|body|html)\b[^>]*>")
    clean = F.filter(F.transform(parts, lambda p: _entities(X.collapse_space(F.regexp_replace(p, r"(?s)<[^>]*>", "")))), lambda p: p != "")
    return pages.select(*keep, F.posexplode(clean).alias("idx", "text"))


def _entities(c: Column) -> Column:
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


def text_fingerprint(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """SHA-256 of a document's text lines in order."""
    lines = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return blocks.groupBy(*by).agg(F.count("*").alias("lines"), F.sha2(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").cast("binary"), 256).alias("fingerprint"))
