"""Rules over works: each yields rows (doc_id, rule, severity, code), and one failing rule doesn't stop the others.

Blocks come with their region (segments.regions). Most rules over them are told by what is gathered in one row for each document (Facts), so that a report gathers for all rules in one pass and stores no blocks. Rules about geometry read the tables that the document reader makes: sections, runs and paras.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import bibliography as B
from folioscope.operators import citations as C
from folioscope.operators import segments as S
from folioscope.operators.deal import small_batches
from folioscope.operators.registry import both_sides

#: Page and margins in millimetres with their tolerance; indent in centimetres; characters of a page.
PAGE, PAGE_TOLERANCE = (210.0, 297.0), 1.0
MARGINS = {"top": 20.0, "bottom": 20.0, "left": 35.0, "right": 10.0}
INDENT, INDENT_TOLERANCE = 1.25, 0.1

CHECK = "doc_id, rule, severity, code"


def _rows(df: DataFrame, rule: str, severity: Column, code: Column) -> DataFrame:
    return df.select("doc_id", F.lit(rule).alias("rule"), severity.alias("severity"), code.alias("code")).filter("severity is not null")


@dataclass(frozen=True)
class Facts:
    """What a rule gathers: columns of a block, columns of windows over them, aggregates over a document, columns of these, and the findings that follow (an array of severity and code). A name stands for the same column in all rules."""

    each: Mapping[str, Column]
    all: Mapping[str, Column]
    found: Column
    walks: Sequence[Mapping[str, Column]] = field(default=())
    then: Mapping[str, Column] = field(default_factory=dict)


def _gathered(blocks: DataFrame, facts: Mapping[str, Facts]) -> DataFrame:
    """Rows of rules by one pass over the blocks. Texts end with the columns of a block, and where blocks are together by document already nothing is shuffled."""
    df = S.with_flags(blocks)
    if "text" in blocks.columns:
        df = df.withColumn("__tidy", X.collapse_space(F.col("text")))
    own = facts.values()
    merged = lambda dicts: {k: c for d in dicts for k, c in d.items()}
    df = df.select("doc_id", *[c.alias(k) for k, c in merged(f.each for f in own).items()])
    for i in range(max(len(f.walks) for f in own)):
        if walk := merged(f.walks[i] for f in own if i < len(f.walks)):
            df = df.withColumns(walk)
    df = df.groupBy("doc_id").agg(*[c.alias(k) for k, c in merged(f.all for f in own).items()])
    if then := merged(f.then for f in own):
        df = df.withColumns(then)
    named = [F.transform(f.found, _named(name)) for name, f in facts.items()]
    return df.select("doc_id", F.explode(F.concat(*named)).alias("x")).select("doc_id", "x.rule", "x.severity", "x.code")


def _named(rule: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(rule).alias("rule"), x["s"].alias("severity"), x["c"].alias("code"))


def _finding(when: Column, severity: Column | str, code: Column | str) -> Column:
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.when(when, F.struct(lit(severity).alias("s"), lit(code).alias("c")))


def _each_finding(values: Column, severity: str, code: str) -> Column:
    """A finding for each value of an array, its code with the value behind it."""
    return F.transform(values, lambda x: F.struct(F.lit(severity).alias("s"), F.concat(F.lit(code), x.cast("string")).alias("c")))


def _flat(name: str) -> Column:
    """All of an array column over a document; blocks without any take no room."""
    return F.flatten(F.collect_list(F.when(F.size(name) > 0, F.col(name))))


_TIDY = "__tidy"
#: Parts whose headings are counted.
_PARTS = {"chapters": "chapter", "introductions": "introduction", "conclusions": "conclusion", "bibliographies": "bibliography", "contents": "contents"}


def _parts(*names: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """How many parts of some kinds a document has."""
    return {"kind": F.col("region_kind"), "starts": F.col("starts")}, {n: F.count_if((F.col("kind") == _PARTS[n]) & F.col("starts")) for n in names}


def _structure_facts() -> Facts:
    names = (("contents", "contents"), ("introductions", "introduction"), ("chapters", "chapter"), ("conclusions", "conclusion"), ("bibliographies", "bibliography"))
    each, all_ = _parts(*[c for c, _ in names])
    return Facts(each, all_, F.array_compact(F.array(*[_finding(F.col(c) == 0, "error", f"missing {name}") for c, name in names])))


def required_structure(blocks: DataFrame) -> DataFrame:
    """Parts that are absent."""
    return _gathered(blocks, {"structure": _structure_facts()})


def _conclusion_facts() -> Facts:
    each, all_ = _parts("chapters")
    concludes = F.startswith(X.fold(F.col(_TIDY)), F.lit("выводы")) & X.heading_key(F.col(_TIDY)).rlike(S.CONCLUSIONS)
    fewer = _finding(F.col("chapter_conclusions") < F.col("chapters"), "warning", "fewer conclusions than chapters")
    return Facts(each | {"concludes": concludes}, all_ | {"chapter_conclusions": F.count_if("concludes")}, F.array_compact(F.array(fewer)))


def chapter_conclusions(blocks: DataFrame) -> DataFrame:
    """Fewer conclusions of chapters than chapters."""
    return _gathered(blocks, {"chapter_conclusions": _conclusion_facts()})


def _contents_facts() -> Facts:
    each, all_ = _parts("contents")
    lines = F.count_if((F.col("kind") == "contents") & ~F.col("starts"))
    return Facts(each, all_ | {"contents_lines": lines}, F.array_compact(F.array(_finding((F.col("contents") > 0) & (F.col("contents_lines") == 0), "error", "empty contents"))))


def contents_filled(blocks: DataFrame) -> DataFrame:
    return _gathered(blocks, {"contents": _contents_facts()})


def _profile_facts() -> Facts:
    each, all_ = _parts("chapters")
    return Facts(each, all_, F.array_compact(F.array(_finding(F.col("chapters") != 3, "error", F.concat(F.lit("chapters: "), F.col("chapters").cast("string"))))))


def three_chapters(blocks: DataFrame) -> DataFrame:
    return _gathered(blocks, {"profile": _profile_facts()})


def _marker_facts() -> Facts:
    said = F.transform(S.marks_of(F.col("text")), lambda m: F.struct(F.when(S.is_soft(m["mark"]), "warning").otherwise("error").alias("s"), m["code"].alias("c")))
    return Facts({"marks": F.when(S.may_hold_marks(F.col("text")), F.array_distinct(said))}, {"all_marks": _flat("marks")}, F.array_distinct("all_marks"))


def unfinished(blocks: DataFrame) -> DataFrame:
    """Marks of unfinished text: soft ones are warnings."""
    return _gathered(blocks, {"markers": _marker_facts()})


def _length_facts(page: int = 1800) -> Facts:
    """Lengths are gathered by line and summed by chapter: few chapters of a document, whatever its lines."""
    text = F.col(_TIDY)
    line = F.when((F.col("region_kind") == "chapter") & ~F.col("starts"), F.when(S.measured(text), F.struct(F.col("chapter_no").alias("no"), F.length(text).alias("n"))))

    def finding(no: Column) -> Column:
        total = F.aggregate(F.filter("chapter_lines", lambda x: x["no"].eqNullSafe(no)), F.lit(0).cast("long"), lambda a, x: a + x["n"])
        return S.let(total / page, lambda p: S.let(F.when(p < 5, "too short").when(p < 8, "short").when(p > 25, "long"), lambda code: _finding(code.isNotNull(), F.when(p < 5, "error").otherwise("warning"), F.concat(F.lit("chapter "), no.cast("string"), F.lit(" "), code))))

    found = F.array_compact(F.transform(F.array_distinct(F.transform("chapter_lines", lambda x: x["no"])), finding))
    return Facts({"chapter_line": line}, {"chapter_lines": F.collect_list("chapter_line")}, found)


def chapter_lengths(blocks: DataFrame, page: int = 1800) -> DataFrame:
    """Chapters of under 5 or 8, or over 25 pages."""
    g = S.analysed(blocks.filter("region_kind = 'chapter' and not starts")).groupBy("doc_id", "chapter_no").agg((F.sum(F.length("text")) / page).alias("p"))
    code = F.when(F.col("p") < 5, "too short").when(F.col("p") < 8, "short").when(F.col("p") > 25, "long")
    return _rows(g, "chapter_length", F.when(F.col("p") < 5, "error").when(code.isNotNull(), "warning"), F.concat(F.lit("chapter "), F.col("chapter_no").cast("string"), F.lit(" "), code))


#: Names of captions and how a text mentions them.
CAPTIONS = (("table", r"(?iu)^таблица\s*(?:№\s*)?(\d+(?:\.\d+)*)", r"(?iu)(?:табл\.|таблиц\p{L}*)\s*(?:№\s*)?(\d+(?:\.\d+)*)"), ("figure", r"(?iu)^(?:рисунок|рис\.)\s*(?:№\s*)?(\d+(?:\.\d+)*)", r"(?iu)(?:рис\.|рисун\p{L}*)\s*(?:№\s*)?(\d+(?:\.\d+)*)"))


def caption_mentions(blocks: DataFrame) -> DataFrame:
    """Tables and figures that no text mentions, and mentions of such as don't exist."""
    text = X.collapse_space(F.col("text"))
    low = F.lower("text")
    blocks = blocks.filter(F.contains(low, F.lit("табл")) | F.contains(low, F.lit("рис")))  # no other text can hold either
    out = None
    for kind, caption, mention in CAPTIONS:
        have = blocks.select("doc_id", F.regexp_extract(text, caption, 1).alias("n")).filter("n <> ''").distinct()
        said = blocks.filter(~text.rlike(caption)).select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(mention), F.lit(1))).alias("n")).distinct()
        rows = _rows(have.join(said, ["doc_id", "n"], "left_anti"), "captions", F.lit("warning"), F.concat(F.lit(f"{kind} not mentioned: "), F.col("n"))).unionByName(_rows(said.join(have, ["doc_id", "n"], "left_anti"), "captions", F.lit("error"), F.concat(F.lit(f"{kind} absent: "), F.col("n"))))
        out = rows if out is None else out.unionByName(rows)
    return out


def _caption_facts() -> Facts:
    text, low = F.col(_TIDY), F.lower("text")
    held = F.contains(low, F.lit("табл")) | F.contains(low, F.lit("рис"))
    each, all_, found = {}, {}, []
    for kind, caption, mention in CAPTIONS:
        have, said = f"{kind}_have", f"{kind}_said"
        each |= {have: F.when(held, F.nullif(F.regexp_extract(text, caption, 1), F.lit(""))), said: F.when(held & ~text.rlike(caption), F.array_distinct(F.regexp_extract_all(text, F.lit(mention), F.lit(1))))}
        all_ |= {f"{have}_all": F.collect_set(have), f"{said}_all": _flat(said)}
        found += [_each_finding(F.array_except(f"{have}_all", f"{said}_all"), "warning", f"{kind} not mentioned: "), _each_finding(F.array_except(f"{said}_all", f"{have}_all"), "error", f"{kind} absent: ")]
    return Facts(each, all_, F.concat(*found))


def _table_facts() -> Facts:
    c, t = F.col("table_captions"), F.col("tables")
    all_ = {"tables": F.count_if("is_table"), "table_captions": F.count_if("is_caption")}
    return Facts({"is_table": F.col("type") == "tbl", "is_caption": F.col(_TIDY).rlike(CAPTIONS[0][1])}, all_, F.array_compact(F.array(_finding(c < t, "warning", F.concat(F.lit("without caption: "), (t - c).cast("string"))))))


def table_captions(blocks: DataFrame) -> DataFrame:
    """Fewer captions of tables than tables."""
    return _gathered(blocks, {"table_captions": _table_facts()})


def pronoun_rule(blocks: DataFrame, forms: Sequence[str]) -> DataFrame:
    """Personal pronouns: an error in the main text, a warning in appendices."""
    low = F.lower(X.null_empty(F.col("text")))
    n = F.regexp_count(low, F.lit(rf"(?<!{X.W})(?:{'|'.join(forms)})(?!{X.W})"))
    g = blocks.groupBy("doc_id").agg(F.sum(F.when(F.col("region_kind").isin(*S.BODY), n)).alias("a"), F.sum(F.when(F.col("region_kind") == "appendix", n)).alias("b"))
    return _rows(g, "pronouns", F.when(F.col("a") > 0, "error").when(F.col("b") > 0, "warning"), F.when(F.col("a") > 0, "main text").otherwise("appendix"))


def cliche_rule(blocks: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """Phrases in the main text: none, to three, to eight, more."""
    low = F.lower(X.null_empty(F.col("text")))
    n = F.lit(0)
    for p in phrases:
        n = n + X.count_plain(low, F.lit(p.lower()))
    g = blocks.filter(F.col("region_kind").isin(*S.BODY)).groupBy("doc_id").agg(F.sum(n).alias("n"))
    return _rows(g, "cliches", F.when(F.col("n") == 0, None).when(F.col("n") <= 3, "info").when(F.col("n") <= 8, "warning").otherwise("error"), F.col("n").cast("string"))


def _bracketed(blocks: DataFrame) -> DataFrame:
    """Blocks that can hold a citation."""
    return blocks.filter(F.contains("text", F.lit("[")))


def citation_rule(blocks: DataFrame, least: int = 20) -> DataFrame:
    """No citations, few of them, or some in the conclusion."""
    df = _bracketed(blocks).withColumn("n", F.size(C.lenient_numbers(F.col("text"))))
    some = df.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum(F.when((F.col("region_kind") == "conclusion") & (F.col("n") > 0), 1).otherwise(0)).alias("c"))
    g = blocks.select("doc_id").distinct().join(some, "doc_id", "left").na.fill(0, ["n", "c"])
    both = F.array_compact(F.array(F.when(F.col("n") == 0, F.struct(F.lit("error").alias("s"), F.lit("none").alias("c"))).when(F.col("n") < least, F.struct(F.lit("info").alias("s"), F.lit("few").alias("c"))), F.when(F.col("c") > 0, F.struct(F.lit("error").alias("s"), F.lit("in conclusion").alias("c")))))
    return _rows(g.select("doc_id", F.explode(both).alias("x")), "citations", F.col("x.s"), F.col("x.c"))


def _bracket_facts() -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """Numbers cited in the conclusion, in other parts that have to be listed, and elsewhere. Texts that can hold a citation are read together for a document: no bracket goes beyond its line."""
    kind, text = F.col("region_kind"), F.when(F.contains("text", F.lit("[")), F.col("text"))
    each = {"in_conclusion": F.when(kind == "conclusion", text), "in_body": F.when(kind.isin(*S.BODY, "appendix") & (kind != "conclusion"), text), "in_others": F.when(~F.coalesce(kind.isin(*S.BODY, "appendix"), F.lit(False)), text)}
    return each, {f"all_{k}": F.array_join(F.collect_list(k), "\n") for k in each}, {f"cited_{k}": C.lenient_numbers(F.col(f"all_{k}")) for k in each}


def _citation_facts(least: int = 20) -> Facts:
    each, all_, then = _bracket_facts()
    n, c = sum((F.size(k) for k in list(then)[1:]), F.size(list(then)[0])), F.size("cited_in_conclusion")
    return Facts(each, all_, F.array_compact(F.array(_finding(n < least, F.when(n == 0, "error").otherwise("info"), F.when(n == 0, "none").otherwise("few")), _finding(c > 0, "error", "in conclusion"))), then=then)


_GIVEN, _PLACE = r"^\s*\[?(\d{1,3})[\].)]\s*", r"^\s*\[?\d{1,3}[\].)]\s*"
_WORD = r"([\p{L}'’\-]+)"


def _entry_lines(blocks: DataFrame) -> DataFrame:
    """Lines of the bibliography: whether they head a group, the number that they give, and the entry without it."""
    df = blocks.filter("region_kind = 'bibliography' and not starts").withColumn("text", X.collapse_space(F.col("text"))).filter("text <> ''")
    return df.select("doc_id", "idx", B.group_heading(F.col("text"), X.is_upper(F.col("text"))).alias("heads"), F.regexp_extract("text", _GIVEN, 1).try_cast("int").alias("given"), F.regexp_replace("text", _PLACE, "").alias("entry"))


def _entry_facts() -> tuple[dict[str, Column], list[dict[str, Column]], dict[str, Column]]:
    """Entries of the bibliography as running windows over all blocks of a document, which are sorted already: their group and number."""
    text = F.col(_TIDY)
    line = lambda c: F.when((F.col("region_kind") == "bibliography") & ~F.col("starts") & (text != ""), c)
    each = {"idx": F.col("idx"), "heads": line(B.group_heading(text, X.is_upper(text))), "given": line(F.regexp_extract(text, _GIVEN, 1).try_cast("int"))}
    upto = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    walks = [{"grp": F.sum(F.col("heads").cast("int")).over(upto), "counted": F.count_if(~F.col("heads")).over(upto)}, {"number": F.when(~F.col("heads"), F.coalesce("given", F.col("counted").cast("int")))}]
    return each, walks, {"numbers": F.array_sort(F.collect_list("number"))}


def _reference_facts() -> Facts:
    each, all_, then = _bracket_facts()
    lines, walks, numbers = _entry_facts()
    cited = F.concat("cited_in_conclusion", "cited_in_body")
    return Facts(each | lines, all_ | numbers, F.concat(_each_finding(F.array_except(cited, F.col("numbers")), "error", "not listed: "), _each_finding(F.array_except(F.col("numbers"), cited), "warning", "not cited: ")), walks, then)


def _order_facts() -> Facts:
    each, walks, all_ = _entry_facts()
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    key = F.when((F.col("region_kind") == "bibliography") & ~F.col("starts") & (F.col(_TIDY) != ""), B.collation_key(F.regexp_extract(F.regexp_replace(_TIDY, _PLACE, ""), _WORD, 1)))
    late = ~F.col("heads") & (F.col("last.grp") == F.col("grp")) & (F.col("last.key") > F.col("key"))
    walks = [walks[0], walks[1] | {"last": F.last(F.when(~F.col("heads"), F.struct("grp", "key")), ignorenulls=True).over(before)}]
    numbers = F.col("numbers")
    doubled = F.filter(numbers, lambda x, i: (x == F.get(numbers, i - 1)) & ~x.eqNullSafe(F.get(numbers, i - 2)))
    gaps = (F.array_min(numbers) != 1) | (F.array_max(numbers) - F.array_min(numbers) + 1 != F.size(F.array_distinct(numbers)))
    found = F.concat(_each_finding(F.col("late"), "warning", "order: "), _each_finding(doubled, "error", "doubled: "), F.array_compact(F.array(_finding((F.size(numbers) > 0) & gaps, "error", "numbering"))))
    return Facts(each | {"key": key}, all_ | {"late": F.collect_list(F.when(late, F.col("number")))}, found, walks)


def _numbered(lines: DataFrame) -> DataFrame:
    """Entries with group and number, by one sort; it holds only the columns of lines that are read."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    df = lines.withColumn("grp", F.sum(F.col("heads").cast("int")).over(w)).withColumn("counted", F.count_if(~F.col("heads")).over(w)).filter("not heads")
    return df.withColumn("number", F.coalesce("given", F.col("counted").cast("int"))).drop("heads", "given", "counted")


def entries(blocks: DataFrame) -> DataFrame:
    """Entries of the bibliography: their number (given, or counted), group and place. A heading in capitals begins a group."""
    return _numbered(_entry_lines(blocks)).select("doc_id", "idx", "grp", "number", "entry")


def cross_references(blocks: DataFrame) -> DataFrame:
    """Numbers cited but not listed, and listed but not cited."""
    cited = _bracketed(blocks).filter(F.col("region_kind").isin(*S.BODY, "appendix")).select("doc_id", F.explode(C.lenient_numbers(F.col("text"))).alias("number"))
    sides = both_sides(cited, entries(blocks).select("doc_id", "number"), ["doc_id", "number"])
    left = F.col("side") == "left"
    return _rows(sides, "references", F.when(left, "error").otherwise("warning"), F.concat(F.when(left, "not listed: ").otherwise("not cited: "), F.col("number").cast("string")))


def bibliography_order(blocks: DataFrame) -> DataFrame:
    """Entries out of alphabetical order in their group, doubled numbers and gaps.

    Entries are sorted once by place and once by number, and all is told by what stands beside an entry: nothing is grouped, and sorts hold short rows."""
    word = F.regexp_extract("entry", _WORD, 1)
    e = _numbered(_entry_lines(blocks).withColumn("word", word).drop("entry"))
    w = Window.partitionBy("doc_id").orderBy("idx")
    e = e.withColumn("key", B.collation_key(F.col("word"))).withColumn("last", F.lag(F.struct("grp", "key")).over(w))
    e = e.select("doc_id", "number", F.coalesce((F.col("last.grp") == F.col("grp")) & (F.col("last.key") > F.col("key")), F.lit(False)).alias("late"))
    w = Window.partitionBy("doc_id").orderBy("number")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("one", F.lag("number").over(w)).withColumn("two", F.lag("number", 2).over(w)).withColumn("next", F.lead("number").over(w)).withColumn("lo", F.min("number").over(so_far))
    e = e.withColumn("k", F.count_if(~F.col("number").eqNullSafe(F.col("one"))).over(so_far))
    found = lambda when, severity, code: F.when(when, F.struct(F.lit(severity).alias("s"), code.alias("c")))
    number = F.col("number").cast("string")
    all_ = F.array(
        found(F.col("late"), "warning", F.concat(F.lit("order: "), number)),
        found((F.col("one") == F.col("number")) & ~F.col("two").eqNullSafe(F.col("number")), "error", F.concat(F.lit("doubled: "), number)),
        found(F.col("next").isNull() & ((F.col("lo") != 1) | (F.col("number") - F.col("lo") + 1 != F.col("k"))), "error", F.lit("numbering")),
    )
    return _rows(e.select("doc_id", F.explode(F.array_compact(all_)).alias("x")), "bibliography", F.col("x.s"), F.col("x.c"))


_INITIAL = r"[А-ЯЁ]\."
_LATE_INITIALS, _FIRST_INITIALS = r"([А-ЯЁ][а-яё]{2,})\s+[А-ЯЁ]\.\s?[А-ЯЁ]\.", r"[А-ЯЁ]\.\s?[А-ЯЁ]\.\s?([А-ЯЁ][а-яё]{2,})"


def _stem(c: Column) -> Column:
    return F.substring(F.lower(c), 1, 5)


def _surname_facts() -> Facts:
    text = X.null_empty(F.col("text"))
    names = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(1)))
    held = text.rlike(_INITIAL)
    each = {"late_names": F.when(held & F.col("region_kind").isin(*S.BODY), names(_LATE_INITIALS)), "stems": F.when(held, F.array_distinct(F.transform(names(_FIRST_INITIALS), _stem)))}
    all_ = {"all_late_names": _flat("late_names"), "all_stems": _flat("stems")}
    known = F.filter(F.array_distinct("all_late_names"), lambda x: F.array_contains("all_stems", _stem(x)))
    return Facts(each, all_, _each_finding(known, "warning", ""))


def surnames(blocks: DataFrame) -> DataFrame:
    """Initials behind a surname in running text (they belong before it), where the surname is one: the same stem stands with initials somewhere in the work."""
    text = X.null_empty(F.col("text"))
    blocks = blocks.filter(text.rlike(_INITIAL))
    body = blocks.filter(F.col("region_kind").isin(*S.BODY))
    late = body.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(_LATE_INITIALS), F.lit(1))).alias("name"))
    known = blocks.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(_FIRST_INITIALS), F.lit(1))).alias("name"))
    hits = late.withColumn("stem", _stem(F.col("name"))).join(known.select("doc_id", _stem(F.col("name")).alias("stem")).distinct(), ["doc_id", "stem"], "left_semi")
    return _rows(hits.select("doc_id", "name").distinct(), "surnames", F.lit("warning"), F.col("name"))


def _sample_facts(least: int = 5) -> Facts:
    text = F.lower(X.null_empty(F.col("text")))
    held = reduce(or_, [F.contains(text, F.lit(x)) for x in ("человек", "участник", "респондент", "студент", "школьник", "обучающ", "испытуем")])
    n = F.regexp_extract_all(text, F.lit(r"(\d{1,3})\s+(?:человек|участник\p{L}*|респондент\p{L}*|студент\p{L}*|школьник\p{L}*|обучающ\p{L}*|испытуем\p{L}*)"), F.lit(1))
    smallest = F.array_min(F.filter(F.transform(n, lambda x: x.cast("int")), lambda x: x.between(1, 500)))
    return Facts({"people": F.when(held, smallest)}, {"fewest": F.min("people")}, F.array_compact(F.array(_finding(F.col("fewest") < least, "warning", F.col("fewest").cast("string")))))


def sample_size(blocks: DataFrame, least: int = 5) -> DataFrame:
    """The smallest sample that the work names (1 to 500 people), if it is too small."""
    return _gathered(blocks, {"sample": _sample_facts(least)})


def frame_words(blocks: DataFrame, words: Sequence[str], good: int = 5, fair: int = 2) -> DataFrame:
    """How many different words of a frame a work holds."""
    low = F.lower(X.null_empty(F.col("text")))
    g = blocks.groupBy("doc_id").agg(*[F.max(F.contains(low, F.lit(w)).cast("int")).alias(f"w{i}") for i, w in enumerate(words)])
    n = sum((F.col(f"w{i}") for i in range(1, len(words))), F.col("w0"))
    return _rows(g, "frame", F.when(n >= good, None).when(n >= fair, "warning").otherwise("error"), n.cast("string"))


ANNOTATION_FIELDS = (("pages", r"(?iu)\d+\s*(?:с\.|стр|лист)"), ("sources", r"(?iu)источник"), ("keywords", r"(?iu)ключевые\s+слова"), ("goal", r"(?iu)цел[ьи]"), ("object", r"(?iu)объект"), ("relevance", r"(?iu)актуальн"), ("topic", r"(?iu)тем[аы]"))


def _annotation_facts() -> Facts:
    line = F.when((F.col("region_kind") == "annotation") & ~F.col("starts"), F.struct("idx", "text"))
    lines = F.array_sort(F.collect_list("annotation_line"))
    text = F.when(F.count("annotation_line") > 0, F.array_join(F.transform(lines, lambda x: x["text"]), "\n"))
    t = F.col("annotation")
    return Facts({"annotation_line": line}, {"annotation": text}, F.array_compact(F.array(*[_finding(~t.rlike(p), "warning", f"no {name}") for name, p in ANNOTATION_FIELDS], _finding(~F.length(t).between(100, 1000), "warning", "length"))))


def annotation_content(blocks: DataFrame) -> DataFrame:
    """Fields that an annotation lacks, and a length outside of 100 to 1000 characters."""
    return _gathered(blocks, {"annotation": _annotation_facts()})


def page_size(sections: DataFrame) -> DataFrame:
    """Pages that aren't A4 in either direction. sections: doc_id, section, width, height (twips)."""
    w, h = X.twips_to_mm(F.col("width")), X.twips_to_mm(F.col("height"))
    near = lambda a, b: F.abs(a - b) <= PAGE_TOLERANCE
    ok = (near(w, PAGE[0]) & near(h, PAGE[1])) | (near(w, PAGE[1]) & near(h, PAGE[0]))
    return _rows(sections, "page_size", F.when(~ok, "error"), F.concat(F.lit("section "), F.col("section").cast("string")))


def margins(sections: DataFrame) -> DataFrame:
    """Margins off by more than a millimetre; a landscape section may be turned either way."""
    mm = {k: X.twips_to_mm(F.col(k)) for k in MARGINS}
    fits = lambda want: F.lit(True) & (F.abs(mm["top"] - want[0]) <= 1) & (F.abs(mm["bottom"] - want[1]) <= 1) & (F.abs(mm["left"] - want[2]) <= 1) & (F.abs(mm["right"] - want[3]) <= 1)
    t, b, left, r = MARGINS.values()
    wide = F.col("width") > F.col("height")
    ok = fits((t, b, left, r)) | (wide & (fits((left, r, t, b)) | fits((r, left, t, b))))
    return _rows(sections, "margins", F.when(~ok, "error"), F.concat(F.lit("section "), F.col("section").cast("string")))


def fonts(runs: DataFrame, font: str = "Times New Roman", half_points: int = 28) -> DataFrame:
    """Font and size that most characters have. runs: doc_id, idx, chars, font, size (half points)."""
    best = lambda c: F.max_by(F.col(c), F.struct(F.col("w"), -F.col("at")))
    out = None
    for column, want in (("font", font), ("size", half_points)):
        g = runs.groupBy("doc_id", column).agg(F.sum("chars").alias("w"), F.min("idx").alias("at")).groupBy("doc_id").agg(best(column).alias("v"))
        rows = _rows(g, "fonts", F.when(~F.col("v").eqNullSafe(F.lit(want)), "error"), F.concat(F.lit(f"{column}: "), F.coalesce(F.col("v").cast("string"), F.lit("none"))))
        out = rows if out is None else out.unionByName(rows)
    return out


def spacing_key(line: Column, rule: Column) -> Column:
    """1.0, 1.5 or 2.0 lines within 0.05, exact, at least, or other."""
    near = lambda x: F.abs(line - x) <= 0.05
    return F.when(rule == "exact", "exact").when(rule == "atLeast", "at least").when(near(1.5), "1.5").when(near(1.0), "1.0").when(near(2.0), "2.0").otherwise("other")


def line_spacing(paras: DataFrame, want: str = "1.5", good: float = 0.8) -> DataFrame:
    """Share of body paragraphs with the wanted spacing. paras: doc_id, idx, line (lines), line_rule, indent_cm, alignment."""
    g = paras.groupBy("doc_id").agg(F.avg((spacing_key(F.col("line"), F.col("line_rule")) == want).cast("double")).alias("s"))
    return _rows(g, "spacing", F.when(F.col("s") < good, "error"), F.round(F.col("s"), 3).cast("string"))


def first_line_indent(paras: DataFrame, good: float = 0.85, fair: float = 0.6) -> DataFrame:
    g = paras.groupBy("doc_id").agg(F.avg((F.abs(F.col("indent_cm") - INDENT) <= INDENT_TOLERANCE + 1e-9).cast("double")).alias("s"))
    return _rows(g, "indent", F.when(F.col("s") >= good, None).when(F.col("s") >= fair, "warning").otherwise("error"), F.round(F.col("s"), 3).cast("string"))


def alignment(paras: DataFrame) -> DataFrame:
    """Body paragraphs that aren't justified: three or more, and a tenth or more of all."""
    g = paras.groupBy("doc_id").agg(F.count_if(F.coalesce("alignment", F.lit("left")) != "both").alias("n"), F.count("*").alias("k"))
    return _rows(g, "alignment", F.when((F.col("n") >= 3) & (F.col("n") >= 0.1 * F.col("k")), "warning"), F.col("n").cast("string"))


def colours(runs: DataFrame, dark: int = 30, most: int = 5) -> DataFrame:
    """Runs whose colour isn't black (a channel over dark), the most frequent colours first."""
    channel = lambda i: F.conv(F.substring("colour", i, 2), 16, 10).cast("int")
    off = runs.filter(F.col("colour").rlike("(?i)^[0-9a-f]{6}$") & ((channel(1) > dark) | (channel(3) > dark) | (channel(5) > dark)))
    g = off.groupBy("doc_id", F.upper("colour").alias("colour")).agg(F.sum("chars").alias("n"))
    top = g.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "colour"))).filter(F.col("k") <= most)
    return _rows(top, "colour", F.lit("warning"), F.concat_ws(" ", "colour", F.col("n").cast("string")))


def page_breaks(paras: DataFrame) -> DataFrame:
    """Chapters that don't begin a page: the last visible thing before them isn't a break. paras: doc_id, idx, chapter (boolean), breaks (boolean), visible (boolean)."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("visible") | F.col("breaks"), F.col("breaks")), ignorenulls=True).over(w)
    return _rows(paras.withColumn("before", before).filter("chapter"), "page_break", F.when(~F.coalesce(F.col("before"), F.lit(True)) & ~F.col("breaks"), "warning"), F.col("idx").cast("string"))


def trailing_page(paras: DataFrame) -> DataFrame:
    """A break behind the last visible paragraph."""
    g = paras.groupBy("doc_id").agg(F.max(F.when(F.col("visible"), F.col("idx"))).alias("v"), F.max(F.when(F.col("breaks"), F.col("idx"))).alias("b"))
    return _rows(g, "empty_last_page", F.when(F.col("b") > F.col("v"), "warning"), F.col("b").cast("string"))


def _heading_facts() -> Facts:
    text = X.strip(X.null_empty(F.col("text")))
    codes = F.array_compact(F.array(F.when(text.rlike(r"[^.]\.$"), "full stop"), F.when(text.rlike(r"(?iu)^глава\s+[ivxlc]+(?![\p{L}\p{N}])"), "roman number")))
    found = F.transform(codes, lambda c: F.struct(F.lit("warning").alias("s"), F.concat_ws(" ", c, F.col("idx").cast("string")).alias("c")))
    return Facts({"headed": F.when(F.col("starts") | F.col("heading_level").isNotNull(), found)}, {"all_headed": _flat("headed")}, F.col("all_headed"))


def heading_mechanics(blocks: DataFrame) -> DataFrame:
    """Headings that end with a full stop, and chapters with Roman numbers."""
    return _gathered(blocks, {"headings": _heading_facts()})


#: Rules over blocks with regions, in the order of a report.
RULES: Mapping[str, Callable[[DataFrame], DataFrame]] = {
    "structure": required_structure,
    "chapter_conclusions": chapter_conclusions,
    "contents": contents_filled,
    "markers": unfinished,
    "headings": heading_mechanics,
    "profile": three_chapters,
    "sample": sample_size,
    "chapter_length": chapter_lengths,
    "captions": caption_mentions,
    "table_captions": table_captions,
    "citations": citation_rule,
    "references": cross_references,
    "bibliography": bibliography_order,
    "surnames": surnames,
    "annotation": annotation_content,
}


#: What those rules gather from a document's blocks.
FACTS: Mapping[Callable[[DataFrame], DataFrame], Callable[[], Facts]] = {
    required_structure: _structure_facts,
    chapter_conclusions: _conclusion_facts,
    contents_filled: _contents_facts,
    unfinished: _marker_facts,
    heading_mechanics: _heading_facts,
    three_chapters: _profile_facts,
    sample_size: _sample_facts,
    chapter_lengths: _length_facts,
    caption_mentions: _caption_facts,
    table_captions: _table_facts,
    citation_rule: _citation_facts,
    cross_references: _reference_facts,
    bibliography_order: _order_facts,
    surnames: _surname_facts,
    annotation_content: _annotation_facts,
}


def checks(blocks: DataFrame, rules: Mapping[str, Callable[[DataFrame], DataFrame]] = RULES) -> DataFrame:
    """All rules' rows over blocks with regions. A rule that can't be planned gives one row of its own for all documents, and the others go on.

    The library's own rules, if all of them can be planned, gather their facts in one pass over the blocks, so no blocks are kept; any other rule reads the blocks by itself."""
    own = {name for name, rule in rules.items() if rule in FACTS}
    out = []
    if own:
        try:
            out = [_gathered(small_batches(blocks), {name: FACTS[rules[name]]() for name in own})]
        except Exception:  # noqa: BLE001 - told by the rule that it is, below
            own = set()
    for name, rule in rules.items():
        if name in own:
            continue
        try:
            rows = rule(blocks)
        except Exception as error:  # noqa: BLE001 - isolation of rules is the point
            text = f"{type(error).__name__}: {error}".split("\n")[0][:200]
            rows = blocks.select("doc_id").distinct().select("doc_id", F.lit(name).alias("rule"), F.lit("error").alias("severity"), F.lit(text).alias("code"))
        out.append(rows)
    return reduce(DataFrame.unionByName, out) if out else None


def summary(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Errors, warnings and notes of each document, and whether it passes."""
    g = found.groupBy("doc_id").agg(*[F.count_if(F.col("severity") == s).alias(s + "s") for s in ("error", "warning", "info")])
    out = docs.select("doc_id").join(g, "doc_id", "left").na.fill(0)
    return out.withColumn("passed", F.col("errors") == 0)
