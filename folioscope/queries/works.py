"""Works as wholes, on tables made from the driver's."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import works as K
from folioscope.queries.audit import _BLOCKS, work_blocks
from folioscope.queries.common import Catalog, table

catalog = Catalog()


def _s():
    return F.col("s_suppkey")


def _choice(key, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


ENDINGS = ("ends here.", "и т. д.", "by A. B.", "see п. 2.3.", "and so on…", "и так далее", "Smith et al.", "wait...")


@catalog.add("open_ends", "SELECT s_suppkey, s_suppkey % 8 NOT IN (0, 5) AS open_ended FROM supplier")
def open_ends(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", K.open_ended(F.concat("s_name", F.lit(" "), _choice(_s(), *ENDINGS))).alias("open_ended"))


@catalog.add(
    "places",
    f"""WITH {_BLOCKS}, pn AS (SELECT *, max(idx) OVER d + 1 AS n, min(idx) FILTER (kind IN ('contents', 'introduction', 'chapter', 'conclusion', 'bibliography')) OVER d AS structure FROM k WINDOW d AS (PARTITION BY doc_id)),
    pt AS (SELECT *, coalesce(structure, 0) AS title FROM pn), pc AS (SELECT *, min(idx) FILTER (kind = 'conclusion' AND idx >= title) OVER (PARTITION BY doc_id) AS con FROM pt),
    pb AS (SELECT *, coalesce(min(idx) FILTER (kind = 'bibliography' AND idx > con) OVER d, max(idx) FILTER (kind = 'bibliography') OVER d) AS bib FROM pc WINDOW d AS (PARTITION BY doc_id)),
    pa AS (SELECT *, min(idx) FILTER (kind = 'appendix' AND idx >= coalesce(bib, con, title)) OVER (PARTITION BY doc_id) AS app FROM pb),
    pe AS (SELECT *, CASE WHEN bib IS NOT NULL THEN coalesce(min(idx) FILTER (idx > bib AND kind IS NOT NULL) OVER (PARTITION BY doc_id), n) END AS bib_end, coalesce(least(bib, app), n) AS main_end FROM pa)
    SELECT doc_id, idx, CASE WHEN idx < title THEN 'title' WHEN idx >= bib AND idx < bib_end THEN 'bibliography' WHEN idx >= app THEN 'appendix' WHEN idx >= main_end THEN 'other' ELSE 'main' END AS place FROM pe""",
)
def places(spark, sf_dir):
    blocks = work_blocks(spark, sf_dir).withColumn("appendix_label", F.col("text") == "Приложение 1")
    return K.validator_regions(blocks).select("doc_id", "idx", "place")


@catalog.add(
    "build_stats",
    f"""SELECT l_orderkey, {', '.join(f"count(*) FILTER (l_linenumber = {i + 1}) AS {k}s" for i, k in enumerate(K.KINDS))}, count(DISTINCT l_suppkey) AS in_list, count(DISTINCT CASE WHEN l_quantity > 25 THEN l_suppkey END) AS cited FROM lineitem GROUP BY l_orderkey""",
)
def build_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    blocks = lines.select("l_orderkey", F.get(F.array(*[F.lit(k) for k in K.KINDS]), F.col("l_linenumber") - 1).alias("kind"))
    refs = lines.select("l_orderkey", F.col("l_suppkey").alias("ref"), "l_quantity")
    return K.build_stats(blocks, refs, refs.filter("l_quantity > 25"), ["l_orderkey"])


QUESTIONS = {"fact": ("Where is {this} from?", "Who counted it?"), "choice": ("Why so?", "What else was there?", "Who chose {it}?"), "result": ("How was it measured?",)}
GENERIC = ("What does {it} mean?", "What for?", "What follows?")


def _asked(category: str, options) -> str:
    n = f"('0x' || substr(md5('42|' || s_suppkey || '|{category}'), 1, 8))::BIGINT % {len(options)}"
    return f"regexp_replace({list(options)!r}[{n} + 1], '\\{{[^{{}}]*\\}}', 'this paragraph', 'g')".replace('["', "['").replace('"]', "']").replace('", "', "', '")


@catalog.add(
    "seeded_questions",
    f"""WITH q AS (SELECT s_suppkey, [x FOR x IN [CASE WHEN s_suppkey % 2 = 0 THEN {{'category': 'fact', 'question': {_asked('fact', QUESTIONS['fact'])}}} END, CASE WHEN s_suppkey % 3 = 0 THEN {{'category': 'choice', 'question': {_asked('choice', QUESTIONS['choice'])}}} END, CASE WHEN s_suppkey % 5 = 0 THEN {{'category': 'result', 'question': {_asked('result', QUESTIONS['result'])}}} END] IF x IS NOT NULL] AS own, {{'category': 'generic', 'question': {_asked('generic', GENERIC)}}} AS more FROM supplier),
    a AS (SELECT s_suppkey, CASE WHEN len(own) < 3 THEN list_append(own, more) ELSE own END AS xs FROM q), u AS (SELECT s_suppkey, unnest(range(len(xs)))::INT AS pos, unnest(xs) AS x FROM a) SELECT s_suppkey, pos, x.category AS category, x.question AS question FROM u""",
)
def seeded_questions(spark, sf_dir):
    categories = F.array_compact(F.array(F.when(_s() % 2 == 0, "fact"), F.when(_s() % 3 == 0, "choice"), F.when(_s() % 5 == 0, "result"), F.when(_s() % 2 == 0, "fact"), F.lit("unheard of")))
    return K.seeded_questions(table(spark, sf_dir, "supplier").select("s_suppkey", categories.alias("categories")), QUESTIONS, GENERIC, ["s_suppkey"], 42)


@catalog.add("caption_numbers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'table' ELSE 'figure' END AS kind, CASE WHEN l_linenumber % 4 = 3 THEN 'A.' ELSE '' END || l_linenumber || '.' || l_suppkey AS number FROM lineitem WHERE l_linenumber <> 5")
def caption_numbers(spark, sf_dir):
    n = F.col("l_linenumber")
    number = F.concat(F.when(n % 4 == 3, "A.").otherwise(""), n.cast("string"), F.lit("."), F.col("l_suppkey").cast("string"), F.lit(" – data"))
    text = F.when(n == 5, F.concat(F.lit("На рисунок "), number)).otherwise(F.concat(F.when(n % 2 == 0, "Таблица ").when(n == 1, "Рисунок ").otherwise("рис. "), number))
    return K.caption_numbers(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text")), ["l_orderkey", "l_linenumber"])


@catalog.add("chapter_prefixes", "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'arabic' WHEN 2 THEN 'spelled' WHEN 4 THEN 'arabic' END AS numbering, s_suppkey % 5 = 4 AS doubled FROM supplier")
def chapter_prefixes(spark, sf_dir):
    text = _choice(_s(), "Глава 1. Основы", "ГЛАВА II", "Глава вторая: итоги", "Введение", "Глава 3. Глава III. Итоги")
    return table(spark, sf_dir, "supplier").select("s_suppkey", K.chapter_prefix(text).alias("p")).select("s_suppkey", "p.*")


@catalog.add("state_texts", "SELECT s_suppkey, '# State' || chr(10) || s_name || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN '```' || chr(10) || '## История сессий' || chr(10) || '```' || chr(10) ELSE '' END || '## Next' || chr(10) || 'end' || chr(10) AS state FROM supplier")
def state_texts(spark, sf_dir):
    fence = F.when(_s() % 2 == 0, "```\n## История сессий\n```\n").otherwise("##  история сессий \nold\n### more\n```\n# no heading\n```\n")
    text = F.concat(F.lit("﻿# State  \r\n"), "s_name", F.lit("\nПоследнее обновление: вчера\n"), fence, F.lit("## Next\n**Последнее обновление** 5\nend\n\n\n"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", K.state_projection(text).alias("state"))


@catalog.add("draft_keys", "SELECT s_suppkey, sha256('a ' || s_name || chr(10) || chr(10) || 'b') AS key FROM supplier")
def draft_keys(spark, sf_dir):
    text = F.when(_s() % 2 == 0, F.concat(F.lit("﻿a \t "), "s_name", F.lit("  \r\n\r\n\r\n \n b\n"))).otherwise(F.concat(F.lit("a "), "s_name", F.lit("\n\nb")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", K.draft_key(text).alias("key"))


@catalog.add(
    "content_keys",
    """WITH d AS (SELECT s_nationkey, '[' || string_agg('["' || s_name || '","' || sha256('text ' || s_suppkey) || '"]', ',' ORDER BY s_name) || ']' AS drafts FROM supplier GROUP BY s_nationkey)
    SELECT s_nationkey, sha256('{"drafts":' || drafts || CASE WHEN s_nationkey % 2 = 0 THEN ',"docx":"f' || s_nationkey || '"' ELSE '' END || '}') AS content_key, '2' AS protocol_version, 'x 1.0' AS tool_versions FROM d""",
)
def content_keys(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    drafts = s.select("s_nationkey", F.col("s_name").alias("path"), F.concat(F.lit("text  "), _s().cast("string"), F.lit(" \n")).alias("text"))
    documents = s.filter("s_nationkey % 2 = 0").select("s_nationkey", F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("fingerprint")).distinct()
    return K.content_key(drafts, documents, "s_nationkey", "2", "x 1.0")


@catalog.add(
    "mark_problems",
    """WITH m AS (SELECT o_orderkey, ['pending', 'confirmed', 'suspicious', 'rejected', 'verified', 'lost'][o_orderkey % 6 + 1] AS status, ['doi', 'guess', NULL, 'catalog', ''][o_orderkey % 5 + 1] AS method, CASE WHEN o_orderkey % 7 < 3 THEN 'https://x' END AS url, CASE WHEN o_orderkey % 4 = 0 THEN 'n' ELSE ' ' END AS note FROM orders)
    SELECT o_orderkey, unnest([x FOR x IN [CASE WHEN status = 'lost' THEN 'status' END, CASE WHEN method = 'guess' THEN 'method' END, CASE WHEN status IN ('confirmed', 'verified') AND NOT (coalesce(method, '') <> '' AND (url IS NOT NULL OR note = 'n')) THEN 'unproved' END, CASE WHEN status IN ('suspicious', 'rejected') AND note <> 'n' THEN 'no note' END] IF x IS NOT NULL]) AS problem FROM m""",
)
def mark_problems(spark, sf_dir):
    k = F.col("o_orderkey")
    marks = table(spark, sf_dir, "orders").select("o_orderkey", _choice(k, "pending", "confirmed", "suspicious", "rejected", "verified", "lost").alias("status"), _choice(k, "doi", "guess", None, "catalog", "").alias("method"), F.when(k % 7 < 3, "https://x").alias("url"), F.when(k % 4 == 0, "n").otherwise(" ").alias("note"))
    return K.mark_problems(marks, ["o_orderkey"])


@catalog.add(
    "content_problems",
    """SELECT event_id, unnest(CASE event_id % 6 WHEN 0 THEN ['no object'] WHEN 1 THEN ['unknown extra', 'missing title'] WHEN 2 THEN ['missing title', 'no number year'] WHEN 3 THEN ['no list authors', 'no string title'] WHEN 4 THEN [] ELSE ['unknown a', 'unknown b', 'missing title'] END) AS problem FROM events""",
)
def content_problems(spark, sf_dir):
    text = _choice(F.col("event_id"), "{broken", '{"k": 1, "extra": 2, "_own": 3}', '{"title": " ", "year": "MMXX"}', '{"title": {"a": 1}, "authors": "me"}', '{"title": "T", "year": 2020, "authors": ["a"], "k": "x"}', '{"b": 1, "a": 2}')
    return K.content_problems(table(spark, sf_dir, "events").select("event_id", text.alias("json")), ["event_id"], "json", {"title": "string", "year": "number", "authors": "list", "k": "string"}, ["title"])


@catalog.add("overwritable", "SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'O') = 0 AS may_overwrite FROM orders GROUP BY o_custkey")
def overwritable(spark, sf_dir):
    return K.may_overwrite(table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "P", "suspicious").alias("status")), ["o_custkey"])


@catalog.add(
    "report_counts",
    """SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type IN ('click', 'view')) AS warnings, coalesce(array_to_string(list_sort(list(DISTINCT 'c' || event_id % 30) FILTER (event_type = 'error'))[:20], '; '), '') AS error_codes, coalesce(array_to_string(list_sort(list(DISTINCT 'c' || event_id % 30) FILTER (event_type IN ('click', 'view')))[:20], '; '), '') AS warning_codes FROM events GROUP BY user_id""",
)
def report_counts(spark, sf_dir):
    kind = F.col("event_type")
    found = table(spark, sf_dir, "events").select("user_id", F.when(kind == "error", "error").when(kind.isin("click", "view"), "warning").otherwise("info").alias("severity"), F.concat(F.lit("c"), (F.col("event_id") % 30).cast("string")).alias("code"))
    return K.report_counts(found, ["user_id"])
