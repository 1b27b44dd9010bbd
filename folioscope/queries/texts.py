"""Grammars and patterns over the real texts of documents and conversations: marks and citations are made out of the texts' own words and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import citations as C
from folioscope.operators import segments as S
from folioscope.operators import works as K
from folioscope.queries.common import Catalog, table

catalog = Catalog()

#: DuckDB: white space of any kind.
_WHITE = r"[\t-\r\x{85}\p{Z} ]"


def _replaced(column, *pairs):
    for pattern, by in pairs:
        column = F.regexp_replace(column, pattern, by)
    return column


def _sql_replaced(text: str, *pairs) -> str:
    for pattern, by in pairs:
        text = f"regexp_replace({text}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return text


#: Words that become marks: some stand in for a template's variable, a title, a value, a source to be looked up.
_TO_MARKS = (("[\\[\\]{}]", " "), (" of ", " TODO "), (" und ", " [N] "), (" les? ", " [X] "), (" Th([a-z]+) ", " {{Th$1}} "), (" De([a-z]*) ", " [Название De$1] "), (" ([a-z]+tion) ", " [ПРОВЕРИТЬ: $1] "), (" el ", " FIXMEel TBD "))
_MARKS_SQL = (
    ("CHECK_SOURCE", r"\[ПРОВЕРИТЬ(?:[:\s][^\]\n]*)?\]"),
    ("VALUE_PLACEHOLDER", r"\[(?:N|X)\]"),
    ("TEMPLATE_VARIABLE", r"\{\{[^{}\n]{1,80}\}\}"),
    ("TITLE_PLACEHOLDER", r"\[Название[^\]\n]*\]"),
    ("TODO", None),
)


def _marks_sql() -> str:
    each = []
    for code, pattern in _MARKS_SQL:
        found = f"regexp_extract_all(t, '{pattern}')" if pattern else r"regexp_extract_all(regexp_replace(' ' || t || ' ', '([^\p{L}\p{N}_])', '\1\1', 'g'), '[^\p{L}\p{N}_](TODO|FIXME|TBD)[^\p{L}\p{N}_]', 1)"
        each.append(f"[{{'code': '{code}', 'mark': m}} FOR m IN {found}]")
    return f"flatten([{', '.join(each)}])"


@catalog.add(
    "text_markers",
    f"WITH d AS (SELECT doc_id, {_sql_replaced('text', *_TO_MARKS)} AS t FROM documents), m AS (SELECT doc_id, {_marks_sql()} AS m FROM d) SELECT doc_id, unnest(range(len(m)))::INT AS pos, unnest(m).code AS code, unnest(m).mark AS mark FROM m",
)
def text_markers(spark, sf_dir):
    return S.markers(table(spark, sf_dir, "documents").select("doc_id", _replaced(F.col("text"), *_TO_MARKS).alias("text")), ["doc_id"])


_ENDS = rf"(?i)(?:^|[\s(«\"''„“\[/—–-])(?:{K.ABBREVIATIONS})\.$"
_INITIALS_SQL, _SECTION_SQL = K._INITIALS, K._SECTION


@catalog.add(
    "text_open_ends",
    rf"""WITH l AS (SELECT conv_id AS id, turn AS pos, 'turn' AS kind, text AS line FROM conversations UNION ALL SELECT doc_id, unnest(range(len(ls))), 'line', unnest(ls) FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    t AS (SELECT id, pos, kind, regexp_replace(coalesce(line, ''), '{_WHITE}+$', '') AS t FROM l)
    SELECT id, pos, kind, ends_with(t, '...') OR ends_with(t, '…') OR (ends_with(t, '.') AND (regexp_matches(t, '{_ENDS}') OR regexp_matches(t, '{_INITIALS_SQL}') OR regexp_matches(t, '{_SECTION_SQL}'))) AS open_ended FROM t""",
)
def text_open_ends(spark, sf_dir):
    """All lines of documents and all turns of conversations."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("id", F.col("pos").cast("long").alias("pos"), F.lit("line").alias("kind"), "line")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.lit("turn").alias("kind"), F.col("text").alias("line"))
    return lines.unionByName(turns).select("id", "pos", "kind", K.open_ended(F.col("line")).alias("open_ended"))


#: Numbers and words that become references.
_TO_REFS = (("[\\[\\]`]", " "), ("([0-9]+)", "[$1]"), (" ([a-z]+)tion ", " [@$1] "), (" ([a-z]+)ung ", " [см. @$1; 12–14] "))


@catalog.add(
    "text_refs",
    rf"""WITH d AS (SELECT doc_id, {_sql_replaced("text", *_TO_REFS)} AS t FROM documents),
    r AS (SELECT doc_id, flatten([CASE WHEN ends_with(b, '; 12–14') THEN [regexp_extract(b, '@[a-z]+'), '12', '13', '14'] ELSE [b] END FOR b IN regexp_extract_all(t, '\[(@[a-z]+|[1-9][0-9]{{0,2}}|см\. @[a-z]+; 12–14)\]', 1)]) AS refs FROM d)
    SELECT doc_id, len(refs) AS n_refs, array_to_string(refs, ' ') AS refs FROM r""",
)
def text_refs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", C.strict_refs(_replaced(F.col("text"), *_TO_REFS)).alias("refs"))
    return docs.select("doc_id", F.size("refs").cast("long").alias("n_refs"), F.array_join("refs", " ").alias("refs"))


@catalog.add(
    "text_numbers",
    rf"""WITH d AS (SELECT doc_id, {_sql_replaced("text", *_TO_REFS[:2])} AS t FROM documents),
    n AS (SELECT doc_id, [x FOR x IN regexp_extract_all(t, '(?:^|[^\p{{L}}\p{{N}}_\]\)])\[([0-9]{{1,3}})\]', 1) IF x::INT BETWEEN 1 AND 500] AS n FROM d)
    SELECT doc_id, len(n) AS n_numbers, array_to_string([x::INT FOR x IN n], ' ') AS numbers FROM n""",
)
def text_numbers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", C.lenient_numbers(_replaced(F.col("text"), *_TO_REFS[:2])).alias("n"))
    return docs.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.array_join(F.col("n").cast("array<string>"), " ").alias("numbers"))


#: First words of lines that become captions; the numbers are made of the lines' own letters.
_TO_CAPTIONS = (("^T([a-z]*) ", "Таблица T.$1 "), ("^E([a-z]*) ", "  рисунок 1.2 $1 "), ("^D([a-z]*) ", "Рис. А.3.4.$1 "), ("^(In|An|La) ", "ТАБЛИЦА 7 $1 "))


@catalog.add(
    "text_captions",
    rf"""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS idx, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), t AS (SELECT doc_id, idx, {_sql_replaced("line", *_TO_CAPTIONS)} AS t FROM l),
    n AS (SELECT doc_id, idx, unnest(['table', 'figure']) AS kind, unnest([regexp_extract(t, '(?i)^\s*таблица\s+((?:[А-ЯA-Z]\.)?[0-9]+(?:\.[0-9]+)*)', 1), regexp_extract(t, '(?i)^\s*(?:рисунок|рис\.)\s+((?:[А-ЯA-Z]\.)?[0-9]+(?:\.[0-9]+)*)', 1)]) AS number FROM t)
    SELECT * FROM n WHERE number <> ''""",
)
def text_captions(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    return K.caption_numbers(lines.select("doc_id", F.col("idx").cast("long").alias("idx"), _replaced(F.col("line"), *_TO_CAPTIONS).alias("text")), ["doc_id", "idx"])


@catalog.add(
    "text_service_lines",
    "WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS idx, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (contains(lower(line), 'license') OR contains(lower(line), ' the of ') OR contains(lower(line), 'cookie')) AS n_service FROM l GROUP BY doc_id",
)
def text_service_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(S.service_paragraph(F.col("line"), ["License", " the of ", "Cookie"])).alias("n_service"))


@catalog.add("text_title_keys", rf"SELECT item_id, lower(regexp_replace(text, '{_WHITE}+', '', 'g')) AS key FROM benchmark")
def text_title_keys(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.title_key(F.col("text")).alias("key"))
