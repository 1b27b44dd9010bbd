"""Bibliographic records: people, types, formatting by type, hints from raw entries, search queries, collation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X

#: Record types and the names that stand for them.
TYPES = ("book", "article", "collection_article", "conference", "newspaper", "electronic", "dissertation", "autoreferat", "normative", "standard", "software_doc", "repository", "preprint", "dataset", "patent", "video")
ALIASES = {
    "книга": "book", "monograph": "book", "монография": "book", "учебник": "book",
    "статья": "article", "journal_article": "article",
    "collection": "collection_article", "сборник": "collection_article", "chapter": "collection_article", "book_chapter": "collection_article",
    "конференция": "conference", "proceedings": "conference",
    "газета": "newspaper",
    "web": "electronic", "online": "electronic", "internet": "electronic", "url": "electronic", "website": "electronic", "site": "electronic", "электронный": "electronic", "электронный_ресурс": "electronic",
    "thesis": "dissertation", "дисс": "dissertation", "диссертация": "dissertation",
    "autoref": "autoreferat", "автореферат": "autoreferat",
    "нормативный": "normative", "закон": "normative", "law": "normative",
    "gost": "standard", "гост": "standard", "стандарт": "standard",
    "documentation": "software_doc", "docs": "software_doc", "документация": "software_doc",
    "repo": "repository", "github": "repository", "репозиторий": "repository",
    "arxiv": "preprint", "препринт": "preprint",
    "датасет": "dataset", "набор_данных": "dataset",
    "патент": "patent",
    "видео": "video", "youtube": "video",
}
#: Names of fields that stand for a field.
FIELDS = {
    "place": ("city", "город", "место"),
    "number": ("issue", "номер", "выпуск"),
    "pages": ("pages_range", "pages_total", "страницы", "стр"),
    "title": ("name", "название", "заглавие"),
    "year": ("год",),
    "authors": ("автор", "авторы", "author"),
    "editors": ("editor", "редактор", "редакторы"),
    "journal": ("journal_name", "журнал", "container", "контейнер", "платформа", "platform"),
    "publisher": ("издательство",),
    "url": ("ссылка", "link"),
    "access_date": ("accessed", "accessed_date", "дата_обращения"),
    "thesis_type": ("тип_диссертации",),
    "language": ("lang", "язык"),
}
#: Endings of surnames and of their genitives, the first that fits counts; and endings that stay.
GENITIVE = (("ский", "ского"), ("цкий", "цкого"), ("ская", "ской"), ("цкая", "цкой"), ("ова", "овой"), ("ева", "евой"), ("ёва", "ёвой"), ("ина", "иной"), ("ына", "ыной"), ("ов", "ова"), ("ев", "ева"), ("ёв", "ёва"), ("ин", "ина"), ("ын", "ына"))
UNCHANGED = r"(ко|их|ых|аго|яго|ово|ич|юк|ук|ак|ян|дзе|швили|сон|ман|ер)$"
#: Labels of a Russian record and of any other.
LABELS = {
    "text": (" [Текст]", ""),
    "pages_total": ("с.", "p."),
    "pages": ("С.", "P."),
    "volume": ("Т.", "Vol."),
    "number": ("№", "No."),
    "no_place": ("[Б. м.]", "[S. l.]"),
    "no_publisher": ("[б. и.]", "[s. n.]"),
    "no_year": ("[б. г.]", "[s. a.]"),
    "et_al": (" [и др.]", " [et al.]"),
}
ELECTRONIC = " [Электронный ресурс]"
NOTES = {"repository": "репозиторий", "preprint": "препринт", "dataset": "датасет"}

#: Every field that a formatter may read; a table lacks what its records don't have.
RECORD = (
    "type", "title", "subtitle", "journal", "container_title", "place", "publisher", "year", "volume", "number", "pages", "url", "access_date", "doi", "edition", "title_note", "newspaper", "date", "published",
    "thesis_type", "degree", "field", "organization", "doc_type", "adoption_note", "source", "designation", "introduced", "country", "ipc", "holder", "application_number", "filed", "responsibility", "editors_text", "translation", "language",
)
PERSON = "struct<last:string,initials:string,is_organization:boolean>"


def canonical_type(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit("book"))))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), low), low)


def folded_fields(df: DataFrame) -> DataFrame:
    """df with the standard names of fields; a field's own column counts before its other names."""
    out = df
    for field, others in FIELDS.items():
        have = [c for c in (field, *others) if c in df.columns]
        if have and have != [field]:
            out = out.withColumn(field, F.coalesce(*[df[c] for c in have])).drop(*[c for c in have if c != field])
    return out


_INITIALS = r"\p{L}\.(?:\s?-?\p{L}\.)?"
_SURNAME = r"\p{L}[\p{L}'’\-]*"


def person(c: Column) -> Column:
    """A person's last name and initials from one of six forms, or an organisation; null for what is neither."""
    s = X.collapse_space(c)
    make = lambda last, initials, org: F.struct(last.alias("last"), initials.alias("initials"), F.lit(org).alias("is_organization"))
    after, before = rf"^({_SURNAME}),?\s+({_INITIALS})$", rf"^({_INITIALS})\s*({_SURNAME})$"
    capital = lambda x: x == F.upper(x)
    squeeze = lambda x: F.regexp_replace(x, r"\s+", "")
    full = r"^([А-ЯЁ][а-яё\-]+)\s+([А-ЯЁ])[а-яё]+\s+([А-ЯЁ])[а-яё]+$"
    a, b = F.regexp_extract(s, after, 2), F.regexp_extract(s, before, 1)
    return (
        F.when(s.rlike(after) & capital(a), make(F.regexp_extract(s, after, 1), squeeze(a), False))
        .when(s.rlike(before) & capital(b), make(F.regexp_extract(s, before, 2), squeeze(b), False))
        .when(s.rlike(full) & s.rlike("(вич|вна|чна|ична|оглы|кызы)$"), make(F.regexp_extract(s, full, 1), F.concat(F.regexp_extract(s, full, 2), F.lit("."), F.regexp_extract(s, full, 3), F.lit(".")), False))
        .when(s.rlike(r"^\S+$") & (s.rlike(r"\d") | s.rlike("[a-zа-яё][A-ZА-ЯЁ]") | s.rlike("^[A-ZА-ЯЁ&]{2,}$")), make(s, F.lit(""), True))
        .when(s.rlike(rf"^{_SURNAME}$"), make(s, F.lit(""), False))
        .when(s.rlike("[А-ЯЁа-яёA-Za-z]") & ~s.rlike(r"(?<![А-ЯЁа-яёA-Za-z])[А-ЯЁA-Z]\."), make(s, F.lit(""), True))
    )


def genitive(surname: Column) -> Column:
    """A Russian surname in the genitive; null where no rule is sure."""
    out = F.when(F.lower(surname).rlike(UNCHANGED), surname)
    for ending, other in reversed(GENITIVE):
        out = F.when(F.lower(surname).endswith(ending) & (F.length(surname) > len(ending) + 1), F.concat(F.substring(surname, F.lit(1), F.length(surname) - len(ending)), F.lit(other))).otherwise(out)
    return out


def joined_areas(*parts: Column) -> Column:
    """Areas of a record joined by a full stop and a dash, without doubled full stops; empty ones are left out."""
    bare = F.transform(F.filter(F.array(*[F.trim(X.null_empty(p)) for p in parts]), lambda p: p != ""), lambda p: F.rtrim(F.regexp_replace(p, r"\.+$", "")))
    step = lambda a, p: F.when(a == "", p).when(a.rlike("[?!]$"), F.concat(a, F.lit(" – "), p)).otherwise(F.concat(a, F.lit(". – "), p))
    out = F.aggregate(bare, F.lit(""), step)
    return F.when((out == "") | out.rlike("[?!.]$"), out).otherwise(F.concat(out, F.lit(".")))


def _letters(c: Column, pattern: str) -> Column:
    return F.regexp_count(F.lower(c), F.lit(pattern))


def is_russian(df_field) -> Column:
    """A Russian record: by its language, else if 0.3 of the letters of title and people are Cyrillic, else (no letters) by the other fields, else yes."""
    f = df_field
    language = F.lower(f("language"))
    people = F.array_join(F.transform(F.concat(f.people("authors"), f.people("editors")), lambda p: X.null_empty(p["last"])), " ")
    first = F.concat_ws(" ", f("title"), f("subtitle"), people)
    other = F.concat_ws(" ", f("journal"), f("container_title"), f("newspaper"), f("publisher"), f("place"))
    share = lambda c: _letters(c, "[а-яё]") / (_letters(c, "[а-яё]") + _letters(c, "[a-z]"))
    has = lambda c: _letters(c, "[а-яёa-z]") > 0
    return F.when(language != "", language.isin("ru", "rus", "russian", "русский", "ru-ru")).when(has(first), share(first) >= 0.3).when(has(other), share(other) >= 0.3).otherwise(F.lit(True))


class Fields:
    """Trimmed fields of a table of records; empty where a table has no such column."""

    def __init__(self, df: DataFrame):
        self.columns = set(df.columns)

    def __call__(self, name: str) -> Column:
        return F.trim(X.null_empty(F.col(name))) if name in self.columns else F.lit("")

    def people(self, name: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast(f"array<{PERSON}>")) if name in self.columns else F.array().cast(f"array<{PERSON}>")


def _if(value: Column, *parts) -> Column:
    """The parts where a value is not empty, else nothing."""
    return F.when(value != "", F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])).otherwise(F.lit(""))


def _by_slash(p: Column) -> Column:
    return F.when(p["is_organization"], p["last"]).otherwise(F.trim(F.concat(X.null_empty(p["initials"]), F.lit(" "), p["last"])))


def formatted(df: DataFrame, out: str = "record", error: str = "error") -> DataFrame:
    """df with each record's text by its type, or an error: unknown type, no title, or a required field that is missing.

    authors and editors are arrays of (last, initials, is_organization).
    """
    f = Fields(df)
    kind = canonical_type(F.col("type") if "type" in df.columns else F.lit(None).cast("string"))
    df = df.withColumn("__ru", is_russian(f)).withColumn("__kind", kind)
    ru, kind = F.col("__ru"), F.col("__kind")
    label = lambda name: F.when(ru, LABELS[name][0]).otherwise(LABELS[name][1])
    authors, editors = f.people("authors"), f.people("editors")
    first = F.get(authors, 0)
    lead = F.when((F.size(authors).between(1, 3)) & ~F.coalesce(first["is_organization"], F.lit(False)), F.when(X.null_empty(first["initials"]) == "", F.concat(first["last"], F.lit("."))).otherwise(F.concat(first["last"], F.lit(", "), first["initials"]))).otherwise(F.lit(""))
    title = F.concat(f("title"), _if(f("subtitle"), ": ", f("subtitle")))
    named = F.transform(authors, _by_slash)
    after = F.when(F.size(authors) >= 5, F.concat(F.array_join(F.slice(named, 1, 3), ", "), label("et_al"))).otherwise(F.array_join(named, ", "))
    responsible = F.when(f("responsibility") != "", f("responsibility")).otherwise(after)
    by_ru = F.array_join(F.transform(editors, lambda p: F.when(p["is_organization"], p["last"]).otherwise(F.trim(F.concat(X.null_empty(p["initials"]), F.lit(" "), F.coalesce(genitive(p["last"]), p["last"]))))), ", ")
    edited = F.when(f("editors_text") != "", f("editors_text")).when(F.size(editors) == 0, "").when(ru, F.concat(F.lit("под ред. "), by_ru)).otherwise(F.concat(F.lit("ed. by "), F.array_join(F.transform(editors, _by_slash), ", ")))
    joined = lambda *xs: F.array_join(F.filter(F.array(*xs), lambda x: x != ""), "; ")
    slash = lambda *xs: _if(joined(*xs), " / ", joined(*xs))
    headed = F.trim(F.concat(lead, F.lit(" "), title))
    marker = F.when(f("url") != "", ELECTRONIC).otherwise(label("text"))
    area = lambda mark, note, with_editors=True: F.concat(headed, mark, _if(note, ": ", note), slash(responsible, *([edited] if with_editors else []), f("translation")))

    place, publisher, year = f("place"), f("publisher"), f("year")
    house = F.when(publisher != "", F.concat(F.when(place != "", place).otherwise(label("no_place")), F.lit(": "), publisher))
    full = F.concat(house.when(place != "", F.concat(place, F.lit(": "), label("no_publisher"))).otherwise(""), F.when((publisher == "") & (place == ""), year).when(year != "", F.concat(F.lit(", "), year)).otherwise(F.concat(F.lit(", "), label("no_year"))))
    required = F.when((place == "") & (publisher == "") & (year == ""), F.concat(label("no_place"), F.lit(": "), label("no_publisher"), F.lit(", "), label("no_year"))).otherwise(full)
    short = house.otherwise(place)
    imprint = F.when(year == "", short).when(short == "", year).otherwise(F.concat(short, F.lit(", "), year))
    volume = _if(f("volume"), label("volume"), " ", f("volume"))
    issue = _if(f("number"), label("number"), " ", f("number"))
    both = F.array_join(F.filter(F.array(volume, issue), lambda x: x != ""), ", ")
    pages = _if(f("pages"), label("pages"), " ", X.pages_range(f("pages")))
    total = _if(f("pages"), f("pages"), " ", label("pages_total"))
    doi = _if(f("doi"), "DOI: ", f("doi"))
    url = _if(f("url"), "URL: ", f("url"), _if(f("access_date"), " (дата обращения: ", f("access_date"), ")"))
    where = F.when((place != "") | (publisher != ""), imprint).otherwise(year)
    container = F.when(f("container_title") != "", f("container_title")).otherwise(f("journal"))
    site = F.when(f("journal") != "", f("journal")).otherwise(f("container_title"))
    paper = F.when(f("newspaper") != "", f("newspaper")).otherwise(site)
    note = F.when(f("title_note") != "", f("title_note"))
    for k, v in NOTES.items():
        note = note.when(kind == k, v)
    degree = F.when(f("degree") != "", f("degree")).otherwise("канд.")
    science = F.when(F.lower(degree).contains("наук"), degree).otherwise(F.concat(degree, F.lit(" "), F.when(f("field") != "", f("field")).otherwise("пед."), F.lit(" наук")))
    thesis = F.when(f("thesis_type") != "", f("thesis_type")).when(kind == "autoreferat", F.concat(F.lit("автореф. дис. … "), science)).otherwise(F.concat(F.lit("Дис. … "), science))
    school = F.when(f("organization") != "", f("organization")).otherwise(publisher)
    at = F.concat(F.when(place != "", place).otherwise("[Б. м.]"), _if(school, ": ", school), _if(year, ", ", year))
    ru_text = F.when(f("url") != "", ELECTRONIC).otherwise(" [Текст]")
    details = F.array_join(F.filter(F.array(f("doc_type"), _if(f("date"), "от ", f("date")), _if(f("number"), "№ ", f("number"))), lambda x: x != ""), " ")
    day = F.when((f("date") != "") & (f("number") != ""), F.concat(f("date"), F.lit(" ("), issue, F.lit(")"))).when(f("date") != "", f("date")).otherwise(issue)
    claim = F.concat(F.lit("Пат. "), f("number"), _if(f("country"), " ", f("country")), _if(f("ipc"), ", МПК ", f("ipc")), F.lit(". "), title, F.lit(" [Текст]"), slash(after, f("holder")))
    filed = F.array_join(F.filter(F.array(_if(f("application_number"), "№ ", f("application_number")), _if(f("filed"), "заявл. ", f("filed")), _if(f("published"), "опубл. ", f("published"))), lambda x: x != ""), "; ")

    text = (
        F.when(kind == "book", joined_areas(area(marker, f("title_note")), f("edition"), required, total, doi, url))
        .when(kind == "article", joined_areas(F.concat(area(marker, f("title_note")), F.lit(" // "), f("journal")), where, both, pages, doi, url))
        .when(kind.isin("collection_article", "conference"), joined_areas(F.concat(area(marker, f("title_note"), False), F.lit(" // "), container, _if(edited, " / ", edited)), imprint, volume, issue, pages, doi, url))
        .when(kind == "newspaper", joined_areas(F.concat(area(marker, F.lit("")), F.lit(" // "), paper), year, day, pages, url))
        .when(kind.isin("electronic", "software_doc", "repository", "preprint", "dataset", "video"), joined_areas(F.concat(area(F.lit(ELECTRONIC), X.null_empty(note)), _if(site, " // ", site)), where, _if(f("published"), "Дата публикации: ", f("published")), both, pages, doi, url))
        .when(kind.isin("dissertation", "autoreferat"), joined_areas(F.concat(headed, F.lit(": "), thesis, F.lit(" [Текст]"), _if(responsible, " / ", responsible)), at, _if(f("pages"), f("pages"), " с.")))
        .when(kind == "normative", joined_areas(F.concat(title, ru_text, _if(details, ": ", details), _if(f("adoption_note"), ": ", f("adoption_note"))), f("source"), url))
        .when(kind == "standard", joined_areas(F.concat(_if(f("designation"), f("designation"), ". "), title, ru_text), _if(f("introduced"), "Введ. ", f("introduced")), imprint, _if(f("pages"), f("pages"), " с."), url))
        .when(kind == "patent", joined_areas(claim, filed))
    )
    wrong = (
        F.when(~kind.isin(*TYPES), "unknown type")
        .when(f("title") == "", "no title")
        .when((kind == "article") & (f("journal") == ""), "no journal")
        .when(kind.isin("collection_article", "conference") & (container == ""), "no container")
        .when((kind == "newspaper") & (paper == ""), "no newspaper")
        .when(kind.isin("electronic", "software_doc", "repository", "preprint", "dataset", "video") & (f("url") == "") & (f("doi") == ""), "no url or doi")
        .when(kind.isin("dissertation", "autoreferat") & (F.size(authors) == 0), "no author")
        .when((kind == "patent") & (f("number") == ""), "no number")
    )
    return df.withColumn(error, wrong).withColumn(out, F.when(F.col(error).isNull(), text)).drop("__ru", "__kind")


def collation_key(c: Column) -> Column:
    """Weights of a text's characters: blanks before digits before Cyrillic (ё as е) before Latin (marks taken off) before others; punctuation parts words. Arrays compare in this order."""
    low = F.translate(F.lower(X.null_empty(c)), "ёàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "еaaaaaaceeeeiiiinooooouuuuyy")

    def weight(ch: Column) -> Column:
        code = F.ascii(ch)
        return (
            F.when(ch.rlike("[0-9]"), code - 47)
            .when(ch.rlike("[а-я]"), code - 1072 + 20)
            .when(ch.rlike("[a-z]"), code - 97 + 60)
            .when(ch.rlike(r"\p{L}"), code + 1000)
            .otherwise(0)
        )

    weights = F.transform(F.regexp_extract_all(low, F.lit(r"(?s)."), F.lit(0)), weight)
    squeezed = F.aggregate(weights, F.array().cast("array<int>"), lambda a, w: F.when((w > 0) | (F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), a), -1), F.lit(0)) != 0), F.concat(a, F.array(w))).otherwise(a))
    return F.when(F.try_element_at(squeezed, F.lit(-1)) == 0, F.slice(squeezed, F.lit(1), F.greatest(F.size(squeezed) - 1, F.lit(0)))).otherwise(squeezed)


#: What the parts of a raw entry look like.
AUTHOR = r"^([А-ЯЁA-Z][А-ЯЁа-яёA-Za-z'’\-]*[а-яёa-z'’])(?:\s*,\s*|\s+)([А-ЯЁA-Z]\.\s*(?:[А-ЯЁA-Z]\.)?)"
TITLE_STOP = r"(?iu)\s*\[[^\]]{0,60}\]|\s+//\s*|\s+/\s+|\s*\.\s*[–—-]\s+|\s*:\s*(?=(?:электрон|дис\.|дисс|автореф|учеб|монограф|сб\.|сборник|материал|федер|приказ|закон|постановлен|указ\b|распоряжен|гост\b|стандарт|справочн|словар|пособ|практикум|хрестомат|курс\s+лекций|методическ|научн\w*\s+(?:журнал|электрон)))"
URL = r"(?i)https?://[^\s<>«»\"]+"
DOI = r"(?i)(?:\bdoi\s*:?\s*|https?://(?:dx\.)?doi\.org/)(10\.\d{4,9}/[^\s,;]+)"
ISBN = r"(?i)\bisbn[\s:]*((?:97[89][\s-]?)?(?:\d[\s-]?){9}[\dXx])"
YEAR = r"(?<!\d)(1[89]\d{2}|20\d{2})(?!\d)"
NORMATIVE = r"(?iu)(?:федеральн\p{L}*\s+закон|федер\.\s*закон|приказ|постановлени\p{L}*|кодекс|гост|фгос|указ|распоряжени\p{L}*|конституци\p{L}*)(?![\p{L}\p{N}_])"


HINTS = ("author_last", "author_initials", "title", "year", "doi", "url", "isbn", "doc_number", "type", "language")


def hints(df: DataFrame, raw: str, out: str = "hints") -> DataFrame:
    """df with a struct of author_last, author_initials, title, year, doi, url, isbn, doc_number, type and language of raw entries; null where nothing is found.

    What several hints read, and each hint, is a column of its own: as one expression all of it would be worked out anew wherever a hint is used.
    """
    name = lambda x: f"__{out}_{x}"
    own = lambda x: F.col(f"`{name(x)}`")
    some = lambda x: F.nullif(x, F.lit(""))
    without = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?iu)\(\s*дата\s+обращения[^)]*\)", " "), URL, " ")
    head, body, text, whole, low = own("head"), own("body"), own("text"), own("raw"), own("low")
    kind = (
        F.when(whole.rlike(NORMATIVE), "normative")
        .when(low.contains("автореф"), "autoreferat")
        .when(low.rlike(rf"(?<!{X.W})(?:дисс?\.|диссертаци)"), "dissertation")
        .when(whole.contains(" // "), "article")
        .when(low.contains("[электронный ресурс]") | low.contains("[electronic resource]") | low.contains("url:"), "electronic")
        .otherwise("book")
    )
    probe = F.coalesce(own("title"), text)
    steps = (
        {"raw": X.collapse_space(F.col(raw))},
        {"text": F.regexp_replace(whole, r"^\s*(?:\[\d{1,3}\]|\d{1,3}\s*[.)])\s*", ""), "low": F.lower(whole)},
        {"body": F.trim(F.regexp_replace(text, AUTHOR, ""))},
        {"head": F.get(F.split(body, TITLE_STOP, 2), 0)},
        {"title": some(F.regexp_replace(head, r"^[ .,:;«»\"]+|[ .,:;«»\"]+$", "")), "rest": without(F.substring(body, F.length(head) + 1, F.length(body)))},
        {
            "author_last": some(F.regexp_extract(text, AUTHOR, 1)),
            "author_initials": some(F.regexp_replace(F.regexp_extract(text, AUTHOR, 2), r"\s+", "")),
            "year": F.coalesce(some(F.regexp_extract(own("rest"), YEAR, 1)), some(F.regexp_extract(without(text), YEAR, 1))).cast("int"),
            "doi": some(F.regexp_replace(F.regexp_extract(whole, DOI, 1), r"\.+$", "")),
            "url": F.regexp_replace(F.get(F.filter(F.regexp_extract_all(whole, F.lit(URL), F.lit(0)), lambda u: ~F.lower(u).contains("doi.org/")), 0), r"[.,;)]+$", ""),
            "isbn": some(F.regexp_replace(F.regexp_extract(whole, ISBN, 1), r"\s+", "")),
            "doc_number": some(F.regexp_replace(F.regexp_extract(whole, r"№\s*([\p{L}\p{N}_\-–/]+)", 1), r"[.,]+$", "")),
            "type": kind,
            "language": F.when(probe.rlike("[A-Za-z]") & ~probe.rlike("[А-Яа-яЁё]"), "en"),
        },
    )
    done = df
    for step in steps:
        done = done.withColumns({name(k): v for k, v in step.items()})
    return done.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.struct(*[own(h).alias(h) for h in HINTS]).alias(out))


def search_queries(h: Column) -> Column:
    """An array of (engine, query) by which a source of these hints can be looked up, each query once."""
    q = lambda engine, text, when: F.when(when & text.isNotNull(), F.struct(F.lit(engine).alias("engine"), F.trim(text).alias("query")))
    quoted = F.concat(F.lit('"'), h["title"], F.lit('"'))
    author = F.concat_ws(" ", h["author_last"], h["author_initials"])
    known, foreign = h["title"].isNotNull(), F.coalesce(h["language"] == "en", F.lit(False))
    each = [
        q("web_search", quoted, known),
        q("web_search", F.concat(author, F.lit(" "), quoted), known & h["author_last"].isNotNull()),
        q("web_search", F.concat(h["author_last"], F.lit(" "), h["title"]), known & h["author_last"].isNotNull()),
        q("web_search", F.concat(quoted, F.lit(" "), h["year"].cast("string")), known),
        q("web_search", F.concat(quoted, F.lit(" site:cyberleninka.ru")), known & ~foreign & h["type"].isin("article", "collection_article", "conference")),
        q("web_search", F.concat(quoted, F.lit(" site:elibrary.ru")), known & ~foreign & h["type"].isin("article", "collection_article", "conference", "book", "dissertation", "autoreferat")),
        q("web_search", F.concat(quoted, F.lit(" site:dissercat.com")), known & h["type"].isin("dissertation", "autoreferat")),
        q("web_search", F.concat_ws(" ", author, h["year"].cast("string")), ~known & h["author_last"].isNotNull()),
        q("web_search", F.concat(F.lit('"№ '), h["doc_number"], F.lit('"')), h["type"] == "normative"),
        q("web_fetch", F.concat(F.lit("https://doi.org/"), h["doi"]), F.lit(True)),
        q("web_search", F.concat(F.lit('"'), h["doi"], F.lit('"')), F.lit(True)),
        q("web_search", F.concat(F.lit("ISBN "), h["isbn"]), F.lit(True)),
        q("web_fetch", h["url"], F.lit(True)),
    ]
    return F.array_distinct(F.array_compact(F.array(*each)))


#: How a line begins that continues the entry before it, and how an entry ends that goes on.
CONTINUES = r"(?iu)^(?:[–—\-/:;,.)\]]|//|\(\s*дата|url\b|doi\b|https?://|www\.|режим\s+доступа|isbn\b|с\.\s*\d|p\.\s*\d|pp\.\s*\d|vol\.|no\.|№|т\.\s*\d|вып\.)"
HANGS = r"(?:[–—\-/:;,(«\"]|//)\s*$"


def continues(previous: Column, line: Column) -> Column:
    """Does a line go on with the entry that ends with the previous line?"""
    s = F.ltrim(X.null_empty(line))
    return F.coalesce((s != "") & (X.null_empty(previous) != "") & (s.rlike(CONTINUES) | s.rlike(r"^\p{Ll}") | (s.rlike(r"^\d") & ~previous.rlike(r"[.!?…]\s*$")) | previous.rlike(HANGS)), F.lit(False))


def group_heading(line: Column, emphasised: Column, most: int = 100) -> Column:
    """A line that heads a group of entries: emphasised, short, without year and marks of an entry."""
    return emphasised & (F.length(line) <= most) & ~line.rlike(YEAR) & ~line.rlike(r"(?iu)\s[/–—]\s|//|https?://|\[\s*(?:текст|электронный\s+ресурс)")


def missing_fields(df: DataFrame, fields: Sequence[str], out: str = "missing") -> DataFrame:
    """df with the names of its empty fields."""
    return df.withColumn(out, F.array_compact(F.array(*[F.when(F.trim(X.null_empty(F.col(f))) == "", F.lit(f)) for f in fields])))
