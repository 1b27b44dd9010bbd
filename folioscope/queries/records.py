"""Citations and bibliographic records, on strings and records built from the star schema's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import bibliography as B
from folioscope.operators import citations as C
from folioscope.operators import registry as R
from folioscope.operators.deal import dealt
from folioscope.queries.common import Catalog, table

catalog = Catalog()


def _citing(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 900 + 1).alias("k"))
    text = F.concat(F.lit("Alpha [@p"), F.col("l_partkey").cast("string"), F.lit(", p. 3] beta ["), F.col("k").cast("string"), F.lit("; "), F.col("l_linenumber").cast("string"), F.lit(", с. 5] gamma [3-6] arr[25] [6-3] [Цит. по: "), F.col("k").cast("string"), F.lit(", с. 235] `[7]` [text] [1, 2]."))
    return lines.withColumn("text", text)


_K = "(l_suppkey % 900 + 1)"


@catalog.add("citation_refs", f"SELECT l_orderkey, l_linenumber, '@p' || l_partkey || ',' || {_K} || ',' || l_linenumber || ',3,4,5,6,25,' || {_K} || ',1,2' AS refs, 7 AS n_citations FROM lineitem")
def citation_refs(spark, sf_dir):
    return _citing(spark, sf_dir).select("l_orderkey", "l_linenumber", C.strict_citations(F.col("text")).alias("c")).select("l_orderkey", "l_linenumber", F.array_join(C.refs_of(F.col("c")), ",").alias("refs"), (F.size("c") + 1).alias("n_citations"))


_SMALL = f"CASE WHEN {_K} <= 500 THEN {_K} || ',' ELSE '' END"  # the grammar of finished texts knows no larger number


@catalog.add("citation_numbers", f"SELECT l_orderkey, l_linenumber, {_SMALL} || l_linenumber || ',3,4,5,6,6,' || {_SMALL} || '7,1,2' AS numbers FROM lineitem")
def citation_numbers(spark, sf_dir):
    return _citing(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join(C.lenient_numbers(F.col("text")).cast("array<string>"), ",").alias("numbers"))


@catalog.add(
    "citations_rewritten",
    """WITH n AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS number FROM supplier WHERE s_suppkey % 5 <> 0),
    t AS (SELECT s.s_suppkey, a.number AS a, b.number AS b FROM supplier s LEFT JOIN n a ON a.s_nationkey = s.s_nationkey AND a.s_suppkey = s.s_suppkey LEFT JOIN n b ON b.s_nationkey = s.s_nationkey AND b.s_suppkey = s.s_suppkey + 1)
    SELECT s_suppkey, 'See ' || CASE WHEN a IS NULL THEN '[@s' || s_suppkey || ', с. 2]' ELSE '[' || a || ', с. 2]' END || ' and ' || CASE WHEN a IS NULL OR b IS NULL THEN '[@s' || (s_suppkey + 1) || '; @s' || s_suppkey || ']' ELSE '[' || b || '; ' || a || ']' END || ' or arr[x].' AS rewritten FROM t""",
)
def citations_rewritten(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey")
    own, following = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") + 1).cast("string")
    texts = suppliers.withColumn("text", F.concat(F.lit("See [@s"), own, F.lit(", с. 2] and [@s"), following, F.lit("; @s"), own, F.lit("] or arr[x].")))
    registry = R.numbered(suppliers.filter("s_suppkey % 5 <> 0"), ["s_nationkey"], [F.col("s_suppkey")]).select("s_nationkey", F.concat(F.lit("@s"), F.col("s_suppkey").cast("string")).alias("ref"), F.col("number").cast("int").alias("number"))
    return C.rewrite(texts, registry, "s_nationkey", "text", "ref", "number").select("s_suppkey", "rewritten")


@catalog.add("citations_in_conclusion", "SELECT source, count(*) AS documents, count(*) FILTER (doc_id % 3 = 0) AS with_citations, CASE WHEN count(*) FILTER (doc_id % 3 = 0) < 20 THEN 'few' ELSE 'ok' END AS level FROM documents GROUP BY source")
def citations_in_conclusion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, F.lit(" [12, с. 3]")).otherwise(F.lit(""))).alias("text"))
    has = F.size(C.lenient_numbers(F.col("text"))) > 0
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(has).alias("with_citations"), F.when(F.count_if(has) < 20, "few").otherwise("ok").alias("level"))


@catalog.add("citation_after_period", "SELECT l_orderkey, l_linenumber, l_linenumber % 3 = 1 AS after_period FROM lineitem")
def citation_after_period(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    text = F.when(F.col("l_linenumber") % 3 == 1, "Вывод сделан автором. [12, с. 4] Далее").when(F.col("l_linenumber") % 3 == 2, "Вывод сделан автором [12, с. 4]. Далее").otherwise("Это верно и т. д. [12]. Далее")
    return lines.select("l_orderkey", "l_linenumber", C.after_period(text).alias("after_period"))


def _records(spark, sf_dir):
    part, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    who = lambda i: F.struct(F.concat(F.lit("Smith"), F.chr(F.lit(97 + i))).alias("last"), F.lit("A.B.").alias("initials"), F.lit(False).alias("is_organization"))
    people = F.when(n % 6 == 5, F.array(*[who(i) for i in range(5)])).when(n % 2 == 0, F.array(who(0))).otherwise(F.array(who(0), who(1)))
    return part.select(
        "p_partkey",
        F.when(n % 4 == 0, "book").when(n % 4 == 1, "journal_article").when(n % 4 == 2, "web").otherwise("poem").alias("type"),
        F.col("p_name").alias("title"),
        people.alias("authors"),
        F.when(n % 5 != 0, "Journal of Parts").alias("journal"),
        F.lit("London").alias("place"),
        F.when(n % 3 != 0, F.col("p_brand")).alias("publisher"),
        (F.lit(1990) + F.col("p_size") % 30).cast("string").alias("year"),
        F.concat(F.lit("1-"), F.col("p_size").cast("string")).alias("pages"),
        F.when((n % 4 == 2) & (n % 7 != 0), F.concat(F.lit("https://example.org/"), n.cast("string"))).alias("url"),
        F.lit("01.02.2024").alias("access_date"),
        F.lit("en").alias("language"),
    )


_PEOPLE = "CASE WHEN p_partkey % 6 = 5 THEN 'A.B. Smitha, A.B. Smithb, A.B. Smithc [et al.]' WHEN p_partkey % 2 = 0 THEN 'A.B. Smitha' ELSE 'A.B. Smitha, A.B. Smithb' END"
_LEAD = "CASE WHEN p_partkey % 6 = 5 THEN p_name ELSE 'Smitha, A.B. ' || p_name END"
_YEAR = "(1990 + p_size % 30)"
_PLACE = f"CASE WHEN p_partkey % 3 <> 0 THEN 'London: ' || p_brand || ', ' || {_YEAR} ELSE @ || ', ' || {_YEAR} END"
FORMAT = f"""
WITH r AS (SELECT *, {_LEAD} AS lead, {_PEOPLE} AS people FROM part),
e AS (SELECT *, CASE WHEN p_partkey % 4 = 3 THEN 'unknown type' WHEN p_partkey % 4 = 1 AND p_partkey % 5 = 0 THEN 'no journal' WHEN p_partkey % 4 = 2 AND p_partkey % 7 = 0 THEN 'no url or doi' END AS error FROM r)
SELECT p_partkey, error, CASE WHEN error IS NULL THEN CASE p_partkey % 4
  WHEN 0 THEN lead || ' / ' || people || '. – ' || {_PLACE.replace("@", "'London: [s. n.]'")} || '. – 1-' || p_size || ' p.'
  WHEN 1 THEN lead || ' / ' || people || ' // Journal of Parts. – ' || {_PLACE.replace("@", "'London'")} || '. – P. 1–' || p_size || '.'
  WHEN 2 THEN lead || ' [Электронный ресурс] / ' || people || CASE WHEN p_partkey % 5 <> 0 THEN ' // Journal of Parts' ELSE '' END || '. – ' || {_PLACE.replace("@", "'London'")} || '. – P. 1–' || p_size || '. – URL: https://example.org/' || p_partkey || ' (дата обращения: 01.02.2024).'
  END END AS record FROM e
"""


@catalog.add("format_records", FORMAT)
def format_records(spark, sf_dir):
    return B.formatted(_records(spark, sf_dir)).select("p_partkey", "error", "record")


def _raw(spark, sf_dir):
    n = F.col("p_partkey").cast("string")
    year = (F.lit(1990) + F.col("p_size") % 30).cast("string")
    raw = F.concat(F.lit("12. Smith, A. B. "), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, " [Text] // Journal. – ").otherwise(" / A.B. Smith. – London: X, "), year, F.lit(". – DOI: 10.1234/abc."), n, F.lit(". – URL: https://example.org/"), n, F.lit(" – ISBN 978-5-12345-678-X"))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))


@catalog.add(
    "hint_parse",
    "SELECT p_partkey, 'Smith' AS author_last, 'A.B.' AS author_initials, p_name AS title, 1990 + p_size % 30 AS year, '10.1234/abc.' || p_partkey AS doi, 'https://example.org/' || p_partkey AS url, '978-5-12345-678-X' AS isbn, NULL::VARCHAR AS doc_number, CASE WHEN p_partkey % 2 = 0 THEN 'article' ELSE 'electronic' END AS type, 'en' AS language FROM part",
)
def hint_parse(spark, sf_dir):
    return B.hints(dealt(_raw(spark, sf_dir)), "raw", "h").select("p_partkey", "h.*")


@catalog.add(
    "search_queries",
    """SELECT p_partkey, unnest(['"' || p_name || '"', 'Smith A.B. "' || p_name || '"', 'Smith ' || p_name, '"' || p_name || '" ' || (1990 + p_size % 30), 'https://doi.org/10.1234/abc.' || p_partkey, '"10.1234/abc.' || p_partkey || '"', 'ISBN 978-5-12345-678-X', 'https://example.org/' || p_partkey]) AS query FROM part""",
)
def search_queries(spark, sf_dir):
    found = B.hints(dealt(_raw(spark, sf_dir)), "raw", "h")
    return found.select("p_partkey", F.explode(B.search_queries(F.col("h"))).alias("q")).select("p_partkey", "q.query")


@catalog.add("people", "SELECT n_nationkey, form, CASE form WHEN 3 THEN upper(n) || '4' WHEN 4 THEN n || ' and Sons' ELSE n END AS last, CASE WHEN form < 2 THEN 'A.B.' ELSE '' END AS initials, form >= 3 AS is_organization FROM (SELECT n_nationkey, 'Nation' || chr(97 + n_nationkey) AS n FROM nation), (VALUES (0), (1), (2), (3), (4)) f(form)")
def people(spark, sf_dir):
    n = F.concat(F.lit("Nation"), F.chr(F.col("n_nationkey") + 97))
    each = table(spark, sf_dir, "nation").select("n_nationkey", n.alias("n"), F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("form"))
    form, n = F.col("form"), F.col("n")
    text = F.when(form == 0, F.concat(n, F.lit(", A. B."))).when(form == 1, F.concat(F.lit("A.B. "), n)).when(form == 2, n).when(form == 3, F.concat(F.upper(n), F.lit("4"))).otherwise(F.concat(n, F.lit(" and Sons")))
    return each.select("n_nationkey", "form", B.person(text).alias("p")).select("n_nationkey", "form", "p.*")


_WEIGHTS = "[CASE WHEN regexp_matches(ch, '[0-9]') THEN ord(ch) - 47 WHEN regexp_matches(ch, '[a-z]') THEN ord(ch) - 97 + 60 ELSE 0 END FOR ch IN string_split(lower(c_name), '')]"


@catalog.add("collation", f"SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_WEIGHTS}, c_custkey) AS number, list_sum({_WEIGHTS})::BIGINT AS weight FROM customer")
def collation(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("key", B.collation_key(F.col("c_name")))
    out = R.numbered(df, ["c_nationkey"], [F.col("key"), F.col("c_custkey")])
    return out.select("c_custkey", "c_nationkey", "number", F.aggregate("key", F.lit(0).cast("long"), lambda a, w: a + w).alias("weight"))


#: The types beside books, articles and sites, in the order of the remainders that make them.
OTHER_TYPES = ("collection_article", "conference", "newspaper", "electronic", "software_doc", "repository", "preprint", "dataset", "video", "dissertation", "autoreferat", "normative", "standard", "patent")
_ONLINE = OTHER_TYPES[3:9]


def _other_records(spark, sf_dir):
    """All parts as records of the other types, in two languages, some without what their type requires."""
    n, kinds = F.col("p_partkey"), len(OTHER_TYPES)
    person = lambda last, initials: F.struct(F.lit(last).alias("last"), F.lit(initials).alias("initials"), F.lit(False).alias("is_organization"))
    five = F.array(*[person(f"Smith{x}", "A.B.") for x in "abcde"])
    people = F.when(n % 6 == 5, five).when(n % 2 == 0, F.slice(five, 1, 1)).otherwise(F.slice(five, 1, 2))
    kind = F.element_at(F.array(*[F.lit(t) for t in OTHER_TYPES]), (n % kinds + 1).cast("int"))
    full = n % 5 != 0
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        kind.alias("type"),
        F.col("p_name").alias("title"),
        F.when(kind.isin("dissertation", "autoreferat") & (n % 7 == 0), F.array().cast(f"array<{B.PERSON}>")).otherwise(people).alias("authors"),
        F.when(kind.isin("collection_article", "conference"), F.array(person("Петров", "В.Г."))).alias("editors"),
        F.when(kind.isin("collection_article", "conference") & full, text("Proceedings of ", F.col("p_brand"))).alias("container_title"),
        F.when((kind == "newspaper") & full, text("Daily ", F.col("p_brand"))).alias("newspaper"),
        F.when(kind.isin(*_ONLINE), "The Site").alias("journal"),
        F.lit("London").alias("place"),
        F.when(n % 3 != 0, F.col("p_brand")).alias("publisher"),
        (F.lit(1990) + F.col("p_size") % 30).cast("string").alias("year"),
        F.lit("2").alias("volume"),
        F.when((kind != "patent") | full, "7").alias("number"),
        text("1-", F.col("p_size")).alias("pages"),
        F.when(kind.isin(*_ONLINE, "normative") & full, text("https://example.org/", n)).alias("url"),
        F.when(n % 10 == 0, "10.1/x").alias("doi"),
        F.lit("01.02.2024").alias("access_date"),
        F.lit("03.04.2020").alias("date"),
        F.lit("02.02.2020").alias("published"),
        F.lit("Act").alias("doc_type"),
        F.lit("Gazette").alias("source"),
        text("ISO ", n).alias("designation"),
        F.lit("2021-01-01").alias("introduced"),
        F.lit("US").alias("country"),
        F.lit("A61B").alias("ipc"),
        F.lit("Acme").alias("holder"),
        F.lit("123").alias("application_number"),
        F.lit("01.01.2019").alias("filed"),
        F.when(F.floor(n / kinds) % 2 == 0, "ru").otherwise("en").alias("language"),
    )


def _areas(*parts: str) -> str:
    return f"array_to_string([rtrim(x, '.') FOR x IN [{', '.join(parts)}] IF x <> ''], '. – ') || '.'"


_MARK, _WHERE, _PP = "CASE WHEN ru THEN ' [Текст]' ELSE '' END", "'London' || CASE WHEN p_partkey % 3 <> 0 THEN ': ' || p_brand ELSE '' END || ', ' || year", "CASE WHEN ru THEN 'С. ' ELSE 'P. ' END || '1–' || p_size"
_VOL, _ISSUE = "CASE WHEN ru THEN 'Т. 2' ELSE 'Vol. 2' END", "CASE WHEN ru THEN '№ 7' ELSE 'No. 7' END"
_URL, _DOI = "CASE WHEN p_partkey % 5 <> 0 THEN 'URL: https://example.org/' || p_partkey || ' (дата обращения: 01.02.2024)' ELSE '' END", "CASE WHEN p_partkey % 10 = 0 THEN 'DOI: 10.1/x' ELSE '' END"
_EDITED = "CASE WHEN ru THEN 'под ред. В.Г. Петрова' ELSE 'ed. by В.Г. Петров' END"
_NOTE = "CASE t WHEN 5 THEN ': репозиторий' WHEN 6 THEN ': препринт' WHEN 7 THEN ': датасет' ELSE '' END"
OTHER_FORMATS = f"""
WITH r AS (SELECT p_partkey, p_name, p_brand, p_size, p_partkey % 14 AS t, (p_partkey // 14) % 2 = 0 AS ru, (1990 + p_size % 30)::VARCHAR AS year, p_partkey % 6 = 5 AS many FROM part),
n AS (SELECT *, CASE WHEN t IN (9, 10) AND p_partkey % 7 = 0 THEN '' WHEN many THEN 'A.B. Smitha, A.B. Smithb, A.B. Smithc' || CASE WHEN ru THEN ' [и др.]' ELSE ' [et al.]' END WHEN p_partkey % 2 = 0 THEN 'A.B. Smitha' ELSE 'A.B. Smitha, A.B. Smithb' END AS people, CASE WHEN many THEN p_name ELSE 'Smitha, A.B. ' || p_name END AS lead,
  CASE WHEN p_partkey % 5 = 0 AND t IN (0, 1) THEN 'no container' WHEN p_partkey % 5 = 0 AND t = 2 THEN 'no newspaper' WHEN p_partkey % 10 = 5 AND t BETWEEN 3 AND 8 THEN 'no url or doi' WHEN p_partkey % 7 = 0 AND t IN (9, 10) THEN 'no author' WHEN p_partkey % 5 = 0 AND t = 13 THEN 'no number' END AS error FROM r)
SELECT p_partkey, error, CASE WHEN error IS NULL THEN CASE
  WHEN t IN (0, 1) THEN {_areas(f"lead || {_MARK} || ' / ' || people || ' // Proceedings of ' || p_brand || ' / ' || {_EDITED}", _WHERE, _VOL, _ISSUE, _PP, f"CASE WHEN t < 9 THEN {_DOI} END")}
  WHEN t = 2 THEN {_areas(f"lead || {_MARK} || ' / ' || people || ' // Daily ' || p_brand", "year", f"'03.04.2020 (' || {_ISSUE} || ')'", _PP)}
  WHEN t < 9 THEN {_areas(f"lead || ' [Электронный ресурс]' || {_NOTE} || ' / ' || people || ' // The Site'", _WHERE, "'Дата публикации: 02.02.2020'", f"{_VOL} || ', ' || {_ISSUE}", _PP, _DOI, _URL)}
  WHEN t IN (9, 10) THEN {_areas("lead || ': ' || CASE t WHEN 9 THEN 'Дис. … канд. пед. наук' ELSE 'автореф. дис. … канд. пед. наук' END || ' [Текст] / ' || people", _WHERE, "'1-' || p_size || ' с.'")}
  WHEN t = 11 THEN {_areas("p_name || CASE WHEN p_partkey % 5 <> 0 THEN ' [Электронный ресурс]' ELSE ' [Текст]' END || ': Act от 03.04.2020 № 7'", "'Gazette'", _URL)}
  WHEN t = 12 THEN {_areas("'ISO ' || p_partkey || '. ' || p_name || ' [Текст]'", "'Введ. 2021-01-01'", _WHERE, "'1-' || p_size || ' с.'")}
  ELSE {_areas("'Пат. 7 US, МПК A61B. ' || p_name || ' [Текст] / ' || people || '; Acme'", "'№ 123; заявл. 01.01.2019; опубл. 02.02.2020'")}
  END END AS record FROM n
"""


@catalog.add("format_other_types", OTHER_FORMATS)
def format_other_types(spark, sf_dir):
    return B.formatted(_other_records(spark, sf_dir)).select("p_partkey", "error", "record")
