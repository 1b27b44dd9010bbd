"""Rules over works made from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import rules as V
from folioscope.operators import segments as S
from folioscope.operators.deal import dealt_by
from folioscope.queries.audit import _REGIONS, work_blocks
from folioscope.queries.common import Catalog, table

catalog = Catalog()


def _works(spark, sf_dir):
    return S.regions(work_blocks(spark, sf_dir))


@catalog.add(
    "rule_structure",
    f"WITH {_REGIONS}, n AS (SELECT DISTINCT doc_id FROM r), w(part) AS (VALUES ('contents'), ('introduction'), ('chapter'), ('conclusion'), ('bibliography')), h AS (SELECT DISTINCT doc_id, region_kind AS part FROM r WHERE starts) SELECT doc_id, 'structure' AS rule, 'error' AS severity, 'missing ' || part AS code FROM n CROSS JOIN w WHERE (doc_id, part) NOT IN (SELECT (doc_id, part) FROM h)",
)
def rule_structure(spark, sf_dir):
    return V.required_structure(_works(spark, sf_dir))


@catalog.add("rule_three_chapters", f"WITH {_REGIONS}, g AS (SELECT doc_id, count(*) FILTER (starts AND region_kind = 'chapter') AS n FROM r GROUP BY doc_id) SELECT doc_id, 'profile' AS rule, 'error' AS severity, 'chapters: ' || n AS code FROM g WHERE n <> 3")
def rule_three_chapters(spark, sf_dir):
    return V.three_chapters(_works(spark, sf_dir))


@catalog.add("rule_chapter_conclusions", f"WITH {_REGIONS}, g AS (SELECT doc_id, count(*) FILTER (starts AND region_kind = 'chapter') AS n FROM r GROUP BY doc_id) SELECT doc_id, 'chapter_conclusions' AS rule, 'warning' AS severity, 'fewer conclusions than chapters' AS code FROM g WHERE n > 0")
def rule_chapter_conclusions(spark, sf_dir):
    return V.chapter_conclusions(_works(spark, sf_dir))


FORMS = ("he", "that", "elle", "ein")
PHRASES = ("of the", "de la", "und", "que")


@catalog.add(
    "rule_pronouns",
    f"""WITH {_REGIONS}, c AS (SELECT doc_id, region_kind, len(regexp_extract_all(regexp_replace(' ' || lower(text) || ' ', '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '[^\\p{{L}}\\p{{N}}_](?:{"|".join(FORMS)})[^\\p{{L}}\\p{{N}}_]')) AS n FROM r),
    g AS (SELECT doc_id, sum(n) FILTER (region_kind IN ('introduction', 'chapter', 'conclusion')) AS a, sum(n) FILTER (region_kind = 'appendix') AS b FROM c GROUP BY doc_id)
    SELECT doc_id, 'pronouns' AS rule, CASE WHEN a > 0 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN a > 0 THEN 'main text' ELSE 'appendix' END AS code FROM g WHERE a > 0 OR b > 0""",
)
def rule_pronouns(spark, sf_dir):
    return V.pronoun_rule(_works(spark, sf_dir), FORMS)


_PLAIN = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{p}', ''))) // {len(p)}" for p in PHRASES)


@catalog.add(
    "rule_cliches",
    f"WITH {_REGIONS}, g AS (SELECT doc_id, sum({_PLAIN})::BIGINT AS n FROM r WHERE region_kind IN ('introduction', 'chapter', 'conclusion') GROUP BY doc_id) SELECT doc_id, 'cliches' AS rule, CASE WHEN n <= 3 THEN 'info' WHEN n <= 8 THEN 'warning' ELSE 'error' END AS severity, n::VARCHAR AS code FROM g WHERE n > 0",
)
def rule_cliches(spark, sf_dir):
    return V.cliche_rule(_works(spark, sf_dir), PHRASES)


@catalog.add(
    "rule_captions",
    "SELECT l_orderkey AS doc_id, 'captions' AS rule, CASE WHEN l_linenumber % 2 = 0 THEN 'warning' ELSE 'error' END AS severity, CASE WHEN l_linenumber % 2 = 0 THEN 'table not mentioned: ' ELSE 'figure absent: ' END || l_linenumber AS code FROM lineitem GROUP BY ALL",
)
def rule_captions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber").distinct()
    n = F.col("l_linenumber").cast("string")
    blocks = lines.select("doc_id", F.col("l_linenumber").alias("idx"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Таблица "), n, F.lit(". Данные"))).otherwise(F.concat(F.lit("Итоги (рис. "), n, F.lit(") видны")))).toDF("doc_id", "idx", "text")
    return V.caption_mentions(blocks)


def _listed(spark, sf_dir):
    """Orders as works: lines cite their number, and the list has the numbers of lines with a small quantity."""
    lines = dealt_by(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q")), "doc_id").groupBy("doc_id", "n").agg(F.max("q").alias("q"))
    n = F.col("n").cast("string")
    text = lines.select("doc_id", F.col("n").alias("idx"), F.concat(F.lit("Тезис ["), n, F.lit(", с. 5].")).alias("text"), F.lit("chapter").alias("region_kind"))
    listed = lines.filter("q < 30").select("doc_id", (F.col("n") + 100).alias("idx"), F.concat(n, F.lit(". Автор "), F.chr(F.lit(65) + F.col("q").cast("int") % 26), F.lit(". Книга")).alias("text"), F.lit("bibliography").alias("region_kind"))
    return text.unionByName(listed).withColumn("starts", F.lit(False))


@catalog.add("rule_references", "SELECT l_orderkey AS doc_id, 'references' AS rule, 'error' AS severity, 'not listed: ' || l_linenumber AS code FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING max(l_quantity) >= 30")
def rule_references(spark, sf_dir):
    return V.cross_references(_listed(spark, sf_dir))


@catalog.add("rule_bibliography", "WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, max(l_quantity) AS q FROM lineitem GROUP BY ALL), g AS (SELECT doc_id, min(n) AS lo, max(n) AS hi, count(*) AS k FROM l WHERE q < 30 GROUP BY doc_id) SELECT doc_id, 'bibliography' AS rule, 'error' AS severity, 'numbering' AS code FROM g WHERE lo <> 1 OR hi - lo + 1 <> k")
def rule_bibliography(spark, sf_dir):
    return V.bibliography_order(_listed(spark, sf_dir))


@catalog.add("rule_checks")
def rule_checks(spark, sf_dir):
    return V.checks(_works(spark, sf_dir))


@catalog.add("rule_summary")
def rule_summary(spark, sf_dir):
    return V.summary(V.checks(_works(spark, sf_dir)), table(spark, sf_dir, "documents"))


_SECTIONS = "SELECT o_custkey AS doc_id, o_orderkey AS section, CASE WHEN o_orderkey % 3 = 0 THEN 16838 ELSE 11906 END AS width, CASE WHEN o_orderkey % 3 = 0 THEN 11906 WHEN o_orderkey % 5 = 0 THEN 15840 ELSE 16838 END AS height, 1134 AS top, 1134 AS bottom, CASE WHEN o_orderkey % 4 = 0 THEN 1701 ELSE 1985 END AS \"left\", 567 AS \"right\" FROM orders"


def _geometry(spark, sf_dir):
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), n.alias("section"), F.when(n % 3 == 0, 16838).otherwise(11906).alias("width"), F.when(n % 3 == 0, 11906).when(n % 5 == 0, 15840).otherwise(16838).alias("height"), F.lit(1134).alias("top"), F.lit(1134).alias("bottom"), F.when(n % 4 == 0, 1701).otherwise(1985).alias("left"), F.lit(567).alias("right"))


@catalog.add("rule_page_size", f"WITH s AS ({_SECTIONS}) SELECT doc_id, 'page_size' AS rule, 'error' AS severity, 'section ' || section AS code FROM s WHERE NOT ((abs(width * 25.4 / 1440 - 210) <= 1 AND abs(height * 25.4 / 1440 - 297) <= 1) OR (abs(width * 25.4 / 1440 - 297) <= 1 AND abs(height * 25.4 / 1440 - 210) <= 1))")
def rule_page_size(spark, sf_dir):
    return V.page_size(_geometry(spark, sf_dir))


@catalog.add("rule_margins", f"WITH s AS ({_SECTIONS}) SELECT doc_id, 'margins' AS rule, 'error' AS severity, 'section ' || section AS code FROM s WHERE abs(\"left\" * 25.4 / 1440 - 35) > 1")
def rule_margins(spark, sf_dir):
    return V.margins(_geometry(spark, sf_dir))


@catalog.add("rule_indent", "WITH g AS (SELECT l_suppkey AS doc_id, avg((abs(1.15 + (l_linenumber % 4) * 0.1 - 1.25) <= 0.1 + 1e-9)::INT) AS s FROM lineitem GROUP BY l_suppkey) SELECT doc_id, 'indent' AS rule, CASE WHEN s >= 0.6 THEN 'warning' ELSE 'error' END AS severity, CASE WHEN round(s, 3) = 1 THEN '1.0' ELSE round(s, 3)::VARCHAR END AS code FROM g WHERE s < 0.85")
def rule_indent(spark, sf_dir):
    return V.first_line_indent(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (1.15 + (F.col("l_linenumber") % 4) * 0.1).alias("indent_cm")))


@catalog.add("rule_colours", "WITH r AS (SELECT l_suppkey AS doc_id, ['000000', '1A1A1A', 'FF0000', '0000ff'][l_linenumber % 4 + 1] AS colour, l_quantity::BIGINT AS chars FROM lineitem), g AS (SELECT doc_id, upper(colour) AS colour, sum(chars)::BIGINT AS n FROM r WHERE colour IN ('FF0000', '0000ff') GROUP BY ALL) SELECT doc_id, 'colour' AS rule, 'warning' AS severity, colour || ' ' || n AS code FROM g")
def rule_colours(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.element_at(F.array(F.lit("000000"), F.lit("1A1A1A"), F.lit("FF0000"), F.lit("0000ff")), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("colour"), F.col("l_quantity").cast("long").alias("chars"))
    return V.colours(runs)


_LINES = "SELECT l_suppkey AS doc_id, l_orderkey * 10 + l_linenumber AS idx, l_quantity::BIGINT AS chars, CASE l_linenumber % 3 WHEN 0 THEN 'Times New Roman' WHEN 1 THEN 'Arial' END AS font, CASE WHEN l_linenumber % 4 = 0 THEN 24 ELSE 28 END AS size FROM lineitem"


def _own_lines(spark, sf_dir, *columns):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), *columns)


@catalog.add(
    "rule_fonts",
    f"""WITH r AS ({_LINES}), f AS (SELECT doc_id, font AS v, sum(chars) AS w, min(idx) AS pos FROM r GROUP BY ALL), s AS (SELECT doc_id, size AS v, sum(chars) AS w, min(idx) AS pos FROM r GROUP BY ALL),
    a AS (SELECT doc_id, v FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, pos) = 1), b AS (SELECT doc_id, v FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, pos) = 1)
    SELECT doc_id, 'fonts' AS rule, 'error' AS severity, 'font: ' || coalesce(v, 'none') AS code FROM a WHERE v IS DISTINCT FROM 'Times New Roman' UNION ALL SELECT doc_id, 'fonts', 'error', 'size: ' || v FROM b WHERE v <> 28""",
)
def rule_fonts(spark, sf_dir):
    n = F.col("l_linenumber")
    return V.fonts(_own_lines(spark, sf_dir, F.col("l_quantity").cast("long").alias("chars"), F.when(n % 3 == 0, "Times New Roman").when(n % 3 == 1, "Arial").alias("font"), F.when(n % 4 == 0, 24).otherwise(28).alias("size")))


@catalog.add("rule_spacing", "WITH g AS (SELECT l_suppkey AS doc_id, round(avg((l_quantity > 10 AND l_linenumber <> 7)::INT), 3) AS r, avg((l_quantity > 10 AND l_linenumber <> 7)::INT) AS s FROM lineitem GROUP BY l_suppkey) SELECT doc_id, 'spacing' AS rule, 'error' AS severity, CASE WHEN r = 0 THEN '0.0' ELSE r::VARCHAR END AS code FROM g WHERE s < 0.8")
def rule_spacing(spark, sf_dir):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    return V.line_spacing(_own_lines(spark, sf_dir, F.when(q <= 5, 1.0).when(q <= 10, 2.04).otherwise(1.46).alias("line"), F.when(n == 7, "exact").otherwise("auto").alias("line_rule")))


@catalog.add("rule_alignment", "WITH g AS (SELECT l_suppkey AS doc_id, count(*) FILTER (l_linenumber > 5) AS n, count(*) AS k FROM lineitem GROUP BY l_suppkey) SELECT doc_id, 'alignment' AS rule, 'warning' AS severity, n::VARCHAR AS code FROM g WHERE n >= 3 AND n >= 0.1 * k")
def rule_alignment(spark, sf_dir):
    n = F.col("l_linenumber")
    return V.alignment(_own_lines(spark, sf_dir, F.when(n <= 5, "both").when(n == 6, "center").alias("alignment")))


FRAME = ("the", "und", "que", "les", "ein", "ción", "ung")


@catalog.add("rule_frame", f"WITH g AS (SELECT doc_id, {' + '.join(f'contains(lower(coalesce(text, {chr(39) * 2})), {chr(39)}{w}{chr(39)})::INT' for w in FRAME)} AS n FROM documents) SELECT doc_id, 'frame' AS rule, CASE WHEN n >= 2 THEN 'warning' ELSE 'error' END AS severity, n::VARCHAR AS code FROM g WHERE n < 5")
def rule_frame(spark, sf_dir):
    return V.frame_words(table(spark, sf_dir, "documents").select("doc_id", "text"), FRAME)


def _pages(spark, sf_dir):
    part = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx")).agg(F.min("l_partkey").alias("l_partkey")).select("doc_id", "idx", (F.col("idx") % 3 == 0).alias("chapter"), (part % 4 == 0).alias("breaks"), (part % 3 != 0).alias("visible"))


_PAGES = "p AS (SELECT l_orderkey AS doc_id, l_linenumber AS idx, l_linenumber % 3 = 0 AS chapter, min(l_partkey) % 4 = 0 AS breaks, min(l_partkey) % 3 <> 0 AS visible FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@catalog.add("rule_page_breaks", f"WITH {_PAGES}, w AS (SELECT *, last_value(CASE WHEN visible OR breaks THEN breaks END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p) SELECT doc_id, 'page_break' AS rule, 'warning' AS severity, idx::VARCHAR AS code FROM w WHERE chapter AND NOT before AND NOT breaks")
def rule_page_breaks(spark, sf_dir):
    return V.page_breaks(_pages(spark, sf_dir))


@catalog.add("rule_last_page", f"WITH {_PAGES}, g AS (SELECT doc_id, max(idx) FILTER (visible) AS v, max(idx) FILTER (breaks) AS b FROM p GROUP BY doc_id) SELECT doc_id, 'empty_last_page' AS rule, 'warning' AS severity, b::VARCHAR AS code FROM g WHERE b > v")
def rule_last_page(spark, sf_dir):
    return V.trailing_page(_pages(spark, sf_dir))


@catalog.add("chapter_ranges", f"WITH {_REGIONS}, h AS (SELECT doc_id, idx FROM r WHERE starts AND region_kind = 'chapter'), m AS (SELECT doc_id, max(idx) + 1 AS n FROM r GROUP BY doc_id) SELECT doc_id, idx AS start, coalesce(lead(idx) OVER (PARTITION BY doc_id ORDER BY idx), n) AS \"end\" FROM h JOIN m USING (doc_id)")
def chapter_ranges(spark, sf_dir):
    works = _works(spark, sf_dir)
    return S.chapter_ranges(works.filter("starts and region_kind = 'chapter'"), works.groupBy("doc_id").agg((F.max("idx") + 1).alias("n")))


@catalog.add(
    "marks_shown",
    "WITH m AS (SELECT l_suppkey AS doc_id, '[Вставить: ' || (l_partkey % 40) || ']' AS mark, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, mark) AS n FROM m) SELECT doc_id, string_agg(mark, ' ' ORDER BY n) FILTER (n <= 10) AS shown, greatest(count(*) - 10, 0) AS more FROM k GROUP BY doc_id",
)
def marks_shown(spark, sf_dir):
    lines = _own_lines(spark, sf_dir, F.concat(F.lit("Text [Вставить: "), (F.col("l_partkey") % 40).cast("string"), F.lit("] goes on")).alias("text"))
    found = S.markers(lines, ["doc_id", "idx"]).select("doc_id", F.col("idx").alias("pos"), "mark")
    return S.distinct_marks(found, ["doc_id"])
