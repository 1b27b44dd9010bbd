"""Checks of projects made from customers and orders: review records, what is handed in, and the checks of doctor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from folioscope.operators import doctor as H
from folioscope.operators import finals as Z
from folioscope.queries.common import Catalog, table

catalog = Catalog()

_STAGES = "['draft', 'prefinal', 'final'][{0} % 3 + 1]"
_P = f"p AS (SELECT c_custkey AS project_id, {_STAGES.format('c_custkey')} AS stage FROM customer)"
_BY = "CASE stage WHEN 'final' THEN '{2}' WHEN 'prefinal' THEN '{1}' ELSE '{0}' END"


def _pick(key, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _stage(key):
    return _pick(key, "draft", "prefinal", "final")


def projects(spark, sf_dir, *more):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), _stage("c_custkey").alias("stage"), *more)


def orders(spark, sf_dir, *columns):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), *columns)


def _k():
    return F.col("o_orderkey")


_INPUTS = "a AS (SELECT o_custkey AS project_id, o_orderkey::VARCHAR AS path, o_orderstatus AS sha256 FROM orders WHERE o_orderkey % 90 <> 4), b AS (SELECT o_custkey AS project_id, o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE o_orderstatus END AS sha256 FROM orders)"


def _inputs(spark, sf_dir):
    path = _k().cast("string").alias("path")
    old = orders(spark, sf_dir, _k(), path, F.col("o_orderstatus").alias("sha256")).filter(_k() % 90 != 4).drop("o_orderkey")
    return old, orders(spark, sf_dir, path, F.when(_k() % 17 == 0, "X").otherwise(F.col("o_orderstatus")).alias("sha256"))


@catalog.add(
    "doctor_snapshots",
    f"""WITH {_P}, {_INPUTS}, r AS (SELECT c_custkey AS project_id, 's' || c_custkey % 50 AS sha, CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE 's' || c_custkey % 50 END AS manifest_sha, CASE WHEN c_custkey % 13 <> 0 THEN 's' || c_custkey % 50 END AS copy_sha FROM customer WHERE c_custkey % 7 <> 0),
    d AS (SELECT project_id, min(path) AS path FROM a FULL JOIN b USING (project_id, path) WHERE a.sha256 IS DISTINCT FROM b.sha256 GROUP BY project_id)
    SELECT project_id, 'AUDIT_SNAPSHOT_MISSING' AS code, {_BY.format('INFO', 'WARNING', 'ERROR')} AS severity, 'audit/snapshot-inputs.json' AS path FROM p WHERE project_id % 7 = 0
    UNION ALL SELECT project_id, 'AUDIT_SNAPSHOT_HASH_MISMATCH', {_BY.format('WARNING', 'ERROR', 'ERROR')}, 'audit/snapshot-inputs.json' FROM p JOIN r USING (project_id) WHERE sha <> manifest_sha OR copy_sha IS NULL
    UNION ALL SELECT project_id, 'AUDIT_SNAPSHOT_STALE', {_BY.format('INFO', 'WARNING', 'ERROR')}, path FROM p JOIN r USING (project_id) JOIN d USING (project_id)""",
)
def doctor_snapshots(spark, sf_dir):
    sha = F.concat(F.lit("s"), (F.col("c_custkey") % 50).cast("string"))
    recorded = table(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("project_id"), sha.alias("sha"), F.when(F.col("c_custkey") % 11 == 0, "x").otherwise(sha).alias("manifest_sha"), F.when(F.col("c_custkey") % 13 != 0, sha).alias("copy_sha"))
    return Z.snapshots(projects(spark, sf_dir), recorded, *_inputs(spark, sf_dir))


@catalog.add(
    "doctor_audit",
    f"""WITH {_P}, o AS (SELECT o.*, stage, project_id, CASE WHEN c_custkey % 2 = 0 THEN '2-HIGH' ELSE '5-LOW' END AS recorded FROM orders o JOIN customer ON c_custkey = o_custkey JOIN p ON project_id = o_custkey), t AS (SELECT *, {_BY.format('WARNING', 'ERROR', 'ERROR')} AS three FROM o)
    SELECT project_id, 'AUDIT_REPORT_ORPHAN' AS code, three AS severity, 'r' || o_orderkey AS path FROM t WHERE o_orderkey % 23 = 0
    UNION ALL SELECT DISTINCT project_id, 'AUDIT_LEGACY_RUNS', 'WARNING', 'audit/manifest.json' FROM t WHERE o_orderkey % 19 = 0
    UNION ALL SELECT project_id, 'AUDIT_REPLAY_PROBLEM', three, 'duplicate ' || o_orderkey FROM t WHERE o_orderkey % 29 = 0
    UNION ALL SELECT project_id, 'AUDIT_FINDINGS_OPEN', three, 'F' || o_orderkey FROM t WHERE o_orderstatus = 'O' AND o_orderkey % 4 < 2
    UNION ALL SELECT project_id, 'AUDIT_RUNS_INCOMPLETE', CASE stage WHEN 'draft' THEN 'INFO' ELSE 'ERROR' END, o_orderkey::VARCHAR FROM t WHERE o_orderkey % 19 <> 0 AND (o_orderkey % 5 < 2 OR (o_orderkey % 5 = 2 AND o_orderkey % 3 > 0))
    UNION ALL SELECT project_id, 'AUDIT_FAIL_UNCLOSED', three, o_orderkey::VARCHAR FROM t WHERE o_orderkey % 19 <> 0 AND o_orderpriority IN ('1-URGENT', recorded) AND o_orderkey % 6 = 0""",
)
def doctor_audit(spark, sf_dir):
    p = projects(spark, sf_dir, F.lit("1-URGENT").alias("current_sha"), F.when(F.col("c_custkey") % 2 == 0, "2-HIGH").otherwise("5-LOW").alias("recorded_sha"))
    name = _k().cast("string")
    runs = orders(spark, sf_dir, _k().alias("run_id"), _pick("o_orderkey", "planned", "running", "reported", "complete", "cancelled").alias("status"), (_k() % 3).alias("pending"), F.when(_k() % 6 == 0, 1).otherwise(0).alias("unclosed"), F.col("o_orderpriority").alias("snapshot_sha"), (_k() % 19 == 0).alias("legacy"))
    findings = orders(spark, sf_dir, F.concat(F.lit("F"), name).alias("finding_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved").alias("status"), _pick("o_orderkey", "BLOCKER", "MAJOR", "MINOR", "INFO").alias("severity"))
    reports = orders(spark, sf_dir, _k(), F.concat(F.lit("r"), name).alias("path"))
    problems = orders(spark, sf_dir, _k(), F.concat(F.lit("duplicate "), name).alias("problem")).filter(_k() % 29 == 0)
    return Z.audit_registry(p, runs, findings, reports, reports.filter(_k() % 23 != 0), problems)


@catalog.add(
    "doctor_final_files",
    f"""WITH {_P}, f AS (SELECT o_custkey AS project_id, CASE WHEN o_orderkey % 10 = 0 THEN 'final/work.docx' ELSE 'final/' || o_orderkey END AS path, o_orderkey % 3 <> 0 AS doc, o_orderkey % 5 AS k, o_orderkey % 7 = 0 AS damaged FROM orders JOIN p ON project_id = o_custkey AND stage = 'final'),
    g AS (SELECT project_id, count(*) FILTER (doc) AS docs, count(*) FILTER (NOT doc) AS others, coalesce(bool_or(doc AND path = 'final/work.docx'), false) AS named FROM p LEFT JOIN f USING (project_id) WHERE stage = 'final' GROUP BY project_id)
    SELECT project_id, unnest([x FOR x IN [CASE WHEN others > 0 THEN 'FINAL_EXTRA_FILES' END, CASE WHEN docs > 0 AND NOT named THEN 'FINAL_DOCX_NAME' END, CASE WHEN docs = 0 THEN 'FINAL_DOCX_MISSING' END, CASE WHEN docs > 1 THEN 'FINAL_DOCX_MULTIPLE' END] IF x IS NOT NULL]) AS code, 'ERROR' AS severity, 'final/' AS path FROM g
    UNION ALL SELECT project_id, 'FINAL_DOCX_INVALID', 'ERROR', path FROM f WHERE doc AND k < 2
    UNION ALL SELECT project_id, 'FINAL_DOCX_CORRUPT', 'ERROR', path FROM f WHERE doc AND k > 0 AND damaged""",
)
def doctor_final_files(spark, sf_dir):
    parts = F.when(_k() % 5 == 1, F.array(F.lit(Z.PARTS[0]))).when(_k() % 5 > 1, F.array(*[F.lit(p) for p in Z.PARTS]))
    files = orders(spark, sf_dir, F.when(_k() % 10 == 0, Z.FINAL).otherwise(F.concat(F.lit("final/"), _k().cast("string"))).alias("path"), (_k() % 3 != 0).alias("is_document"), parts.alias("parts"), (_k() % 7 == 0).alias("damaged"))
    return Z.final_files(projects(spark, sf_dir), files)


@catalog.add("doctor_build", f"WITH {_P}, {_INPUTS}, d AS (SELECT DISTINCT project_id FROM a FULL JOIN b USING (project_id, path) WHERE a.sha256 IS DISTINCT FROM b.sha256) SELECT project_id, 'FINAL_DOCX_OUTDATED' AS code, 'ERROR' AS severity, 'final/work.docx' AS path FROM p JOIN d USING (project_id) WHERE stage <> 'draft' AND project_id % 4 <> 0")
def doctor_build(spark, sf_dir):
    files = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("project_id"), F.lit(Z.FINAL).alias("path"))
    return Z.outdated_build(projects(spark, sf_dir), files, *_inputs(spark, sf_dir))


@catalog.add(
    "doctor_annotation",
    f"""WITH {_P}, d AS (SELECT project_id, stage, project_id % 5 AS k, project_id % 60 AS n, CASE WHEN project_id % 7 <> 0 THEN project_id % 60 + project_id % 2 END AS pages FROM p WHERE stage <> 'draft'),
    s AS (SELECT *, CASE k WHEN 0 THEN [n] WHEN 1 THEN [n] WHEN 3 THEN [10, n] WHEN 4 THEN [n] ELSE [] END AS raw FROM d), t AS (SELECT *, [x FOR x IN raw IF x > 0] AS stated FROM s),
    c AS (SELECT *, CASE WHEN len(stated) = 0 OR pages IS NULL THEN 'ANNOTATION_PAGES_UNVERIFIED' WHEN list_contains(stated, pages) OR (len(stated) > 1 AND list_sum(stated) = pages) THEN NULL WHEN k = 1 THEN 'ANNOTATION_PAGES_PARTIAL' ELSE 'ANNOTATION_PAGES_MISMATCH' END AS code FROM t)
    SELECT project_id, code, CASE code WHEN 'ANNOTATION_PAGES_MISMATCH' THEN 'ERROR' WHEN 'ANNOTATION_PAGES_PARTIAL' THEN 'WARNING' ELSE CASE WHEN len(stated) > 0 AND stage = 'final' THEN 'WARNING' ELSE 'INFO' END END AS severity, 'drafts/annotation.md' AS path FROM c WHERE code IS NOT NULL""",
)
def doctor_annotation(spark, sf_dir):
    k, n = F.col("c_custkey"), (F.col("c_custkey") % 60).cast("string")
    text = F.when(k % 5 == 0, F.concat(F.lit("Работа на "), n, F.lit(" с., 3 рисунка. <!-- 99 стр. -->"))).when(k % 5 == 1, F.concat(F.lit("Цель. Объём текстовой части – "), n, F.lit(" страниц; таблиц 2."))).when(k % 5 == 2, "Объём не назван, источников 30.").when(k % 5 == 3, F.concat(F.lit("Том 10 с. и ещё "), n, F.lit(" стр. приложений"))).otherwise(F.concat(n, F.lit(" страницы, `77 с.`")))
    c = table(spark, sf_dir, "customer")
    annotations = c.select(k.alias("project_id"), F.lit("drafts/annotation.md").alias("path"), text.alias("text"))
    return Z.annotation_pages(projects(spark, sf_dir), annotations, c.select(k.alias("project_id"), F.when(k % 7 != 0, k % 60 + k % 2).cast("int").alias("pages")))


@catalog.add(
    "doctor_validation",
    f"""WITH {_P}, d AS (SELECT project_id, stage, project_id % 4 <> 0 AS has, project_id % 8 <> 1 AS readable, project_id % 3 <> 0 AS same, CASE WHEN project_id % 6 = 0 THEN 'b' ELSE 'a' END AS profile, project_id % 5 % 2 AS r_errors, project_id % 2 AS r_warnings, CASE WHEN project_id % 9 <> 0 THEN project_id % 2 END AS errors, project_id % 5 AS warnings FROM p WHERE project_id % 5 <> 0 AND project_id % 11 <> 0),
    e AS (SELECT *, stage = 'final' AS fin, has AND readable AS ok FROM d)
    SELECT project_id, unnest([x FOR x IN [CASE WHEN fin AND NOT has THEN 'AUTOMATED_VALIDATION_MISSING' END, CASE WHEN fin AND has AND NOT readable THEN 'AUTOMATED_VALIDATION_INVALID' END, CASE WHEN fin AND ok AND NOT (same AND profile = 'a') THEN 'AUTOMATED_VALIDATION_STALE' END, CASE WHEN fin AND errors IS NULL THEN 'VALIDATION_FAILED_TO_RUN' END, CASE WHEN fin AND errors > 0 THEN 'VALIDATION_ERRORS' END, CASE WHEN fin AND errors IS NOT NULL AND ok AND same AND r_errors <> errors THEN 'AUTOMATED_VALIDATION_MISMATCH' END] IF x IS NOT NULL]) AS code, 'ERROR' AS severity, 'final/work.docx' AS path FROM e
    UNION ALL SELECT project_id, 'VALIDATION_WARNINGS', 'WARNING', 'final/work.docx' FROM e WHERE CASE WHEN fin THEN errors IS NOT NULL AND warnings > 0 ELSE ok AND same AND r_warnings > 0 END""",
)
def doctor_validation(spark, sf_dir):
    k = F.col("c_custkey")
    c, key = table(spark, sf_dir, "customer"), k.alias("project_id")
    documents = c.filter("c_custkey % 5 <> 0").select(key, F.explode(F.when(k % 11 == 0, F.array(F.lit(Z.FINAL), F.lit("final/other.docx"))).otherwise(F.array(F.lit(Z.FINAL)))).alias("path"), F.lit("d").alias("sha256"))
    reports = c.filter("c_custkey % 4 <> 0").select(key, F.when(k % 3 == 0, "old").otherwise("d").alias("document_sha256"), F.when(k % 6 == 0, "b").otherwise("a").alias("profile"), (k % 5 % 2).alias("errors"), (k % 2).alias("warnings"), (k % 8 != 1).alias("readable"))
    reruns = c.select(key, F.when(k % 9 != 0, k % 2).alias("errors"), (k % 5).alias("warnings"))
    return Z.validation(projects(spark, sf_dir, F.lit("a").alias("profile")), documents, reports, reruns)


@catalog.add(
    "doctor_waves",
    f"""WITH {_P}, i AS (SELECT project_id, project_id % 3 AS own FROM p WHERE stage = 'final'),
    r AS (SELECT o_custkey AS project_id, o_orderkey AS run, o_orderkey % 2 = 0 AS prim, o_orderkey AS planned, o_orderkey + 50 AS closed, o_orderkey % 11 = 0 AS degraded, o_orderkey % 4 AS lvl, [o_orderkey % 5, o_orderkey % 7] AS auditors, [o_orderkey % 101] AS execs, o_orderstatus = 'O' AND o_orderkey % 7 <> 0 AS good FROM orders),
    a AS (SELECT r.*, CASE WHEN lvl < 3 THEN lvl ELSE 1 END AS applied FROM r JOIN i USING (project_id) WHERE good AND prim), b AS (SELECT * FROM r WHERE good AND NOT prim),
    x AS (SELECT project_id, min(a.planned) AS p, arg_min(a.applied, a.planned) AS applied FROM a JOIN b USING (project_id) WHERE b.planned > a.closed AND (a.degraded OR b.degraded OR NOT list_has_any(a.auditors, b.auditors)) AND NOT list_has_any(a.execs, b.execs) GROUP BY project_id),
    e AS (SELECT x.project_id, applied, max(lvl) AS top FROM x JOIN r ON r.project_id = x.project_id AND r.planned < x.p AND lvl < 3 GROUP BY ALL)
    SELECT project_id, 'AUDIT_PRIMARY_WAVE_MISSING' AS code, 'ERROR' AS severity, 'audit/manifest.json' AS path FROM i WHERE project_id NOT IN (SELECT project_id FROM a)
    UNION ALL SELECT project_id, 'AUDIT_BLIND_WAVE_MISSING', 'ERROR', 'audit/manifest.json' FROM i WHERE project_id IN (SELECT project_id FROM a) AND project_id NOT IN (SELECT project_id FROM x)
    UNION ALL SELECT project_id, 'AUDIT_INTENSITY_LOWERED', 'WARNING', 'project.json' FROM e WHERE top > applied""",
)
def doctor_waves(spark, sf_dir):
    p = projects(spark, sf_dir, F.lit("O").alias("current_sha"), F.lit("strict").alias("intensity"))
    runs = orders(
        spark,
        sf_dir,
        _k().alias("run_id"),
        _pick("o_orderkey", "primary", "blind_regression").alias("kind"),
        F.col("o_orderstatus").alias("snapshot_sha"),
        _k().alias("planned"),
        (_k() + 50).alias("closed"),
        (_k() % 7 != 0).alias("complete"),
        (_k() % 11 == 0).alias("degraded"),
        _pick("o_orderkey", *Z.INTENSITIES, "other").alias("intensity"),
        F.array(_k() % 5, _k() % 7).alias("auditors"),
        F.array(_k()).alias("tasks"),
        F.array(_k() % 101).alias("executions"),
    )
    return Z.final_waves(p, runs)


@catalog.add("doctor_defense", f"WITH {_P} SELECT project_id, 'USER_EVIDENCE_REQUIRED' AS code, 'ERROR' AS severity, 'evidence/index.json' AS path FROM p WHERE stage = 'final' AND project_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 3 > 0)")
def doctor_defense(spark, sf_dir):
    return Z.defense_evidence(projects(spark, sf_dir), orders(spark, sf_dir, F.when(F.col("o_orderpriority") == "1-URGENT", "defense").otherwise("pilot").alias("group"), (_k() % 3).alias("size")))


@catalog.add(
    "doctor_next",
    """WITH f AS (SELECT user_id AS project_id, event_type AS code, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END AS severity, count(*) AS n FROM events GROUP BY ALL)
    SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY list_position(['ERROR', 'WARNING', 'INFO'], severity), n DESC, code) AS place, code, severity, n FROM f QUALIFY place <= 3""",
)
def doctor_next(spark, sf_dir):
    kind = F.col("event_type")
    return Z.next_actions(table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), kind.alias("code"), F.when(kind == "error", "ERROR").when(kind.isin("view", "click"), "WARNING").otherwise("INFO").alias("severity"), F.lit("").alias("path")))


# doctor's other checks


@catalog.add("doctor_unreadable", "SELECT user_id AS project_id, 'JSON_INVALID' AS code, 'ERROR' AS severity, event_type || ':' || event_id AS path FROM events WHERE event_id % 7 = 0")
def doctor_unreadable(spark, sf_dir):
    return H.unreadable(table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_type").alias("file"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 7 == 0, "bad").alias("error")))


@catalog.add("doctor_config", "SELECT project_id, 'CONFIG_INVALID' AS code, 'ERROR' AS severity, path FROM (SELECT c_custkey AS project_id, unnest([x FOR x IN [CASE WHEN c_custkey % 4 = 3 THEN 'mode' END, CASE WHEN c_custkey % 5 >= 3 THEN 'audit_intensity' END] IF x IS NOT NULL]) AS path FROM customer)")
def doctor_config(spark, sf_dir):
    return H.config(projects(spark, sf_dir, _pick("c_custkey", "full", "section", "audit", "other").alias("mode"), _pick("c_custkey", "balanced", "strict", "maximum", "?", None).alias("audit_intensity")))


@catalog.add("doctor_labels", "SELECT project_id, 'STATE_LABEL_MISSING' AS code, 'WARNING' AS severity, path FROM (SELECT doc_id AS project_id, unnest([x FOR x IN ['the', 'und', 'que'] IF NOT contains(coalesce(text, ''), x)]) AS path FROM documents)")
def doctor_labels(spark, sf_dir):
    return H.labels(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("project_id"), "text"), ("the", "und", "que"))


@catalog.add(
    "doctor_evidence",
    """WITH e AS (SELECT o_custkey AS project_id, CASE WHEN o_orderkey % 2 = 0 THEN 'E' ELSE 'e' END || o_orderkey % 10 // 2 AS id, CASE o_orderkey % 4 WHEN 0 THEN 'evidence/a' WHEN 1 THEN '../a' WHEN 2 THEN '' END AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'https://x' END AS url FROM orders)
    SELECT project_id, 'EVIDENCE_INVALID' AS code, 'ERROR' AS severity, id AS path FROM e WHERE (coalesce(path, '') <> '') = (url IS NOT NULL) OR path = '../a'
    UNION ALL SELECT project_id, 'EVIDENCE_DUPLICATE', 'ERROR', lower(id) FROM e GROUP BY project_id, lower(id) HAVING count(*) > 1""",
)
def doctor_evidence(spark, sf_dir):
    number = F.floor(_k() % 10 / 2).cast("string")
    return H.evidence(orders(spark, sf_dir, F.concat(F.when(_k() % 2 == 0, "E").otherwise("e"), number).alias("id"), _pick("o_orderkey", "evidence/a", "../a", "", None).alias("path"), F.when(_k() % 3 == 0, "https://x").alias("url")))


@catalog.add(
    "doctor_sources",
    f"""WITH {_P}, r AS (SELECT project_id, stage, o_orderkey AS pos, 'S' || o_orderkey AS id, 'Title, ' || o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN '10.1/' || o_orderkey % 4 END AS doi, ['confirmed', 'pending', 'rejected', 'verified'][o_orderkey % 4 + 1] AS status, CASE WHEN o_orderkey % 5 <> 0 THEN 'web' END AS method, CASE WHEN o_orderkey % 7 <> 0 THEN 'https://x' END AS url FROM orders JOIN p ON project_id = o_custkey),
    k AS (SELECT project_id, coalesce('doi:' || doi, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS key FROM r)
    SELECT project_id, 'SOURCE_UNCONFIRMED' AS code, CASE status WHEN 'rejected' THEN 'ERROR' ELSE {_BY.format('INFO', 'WARNING', 'ERROR')} END AS severity, id AS path FROM r WHERE status IN ('pending', 'rejected')
    UNION ALL SELECT project_id, 'VERIFICATION_INCOMPLETE', 'ERROR', id || ':' || array_to_string([x FOR x IN [CASE WHEN method IS NULL THEN 'method' END, CASE WHEN url IS NULL THEN 'url' END] IF x IS NOT NULL], '+') FROM r WHERE status IN ('confirmed', 'verified') AND (method IS NULL OR url IS NULL)
    UNION ALL SELECT project_id, 'SOURCE_DUPLICATE', 'WARNING', key FROM (SELECT *, row_number() OVER (PARTITION BY project_id, key) AS n FROM k) WHERE n > 1""",
)
def doctor_sources(spark, sf_dir):
    name = _k().cast("string")
    records = orders(spark, sf_dir, _k().alias("pos"), F.concat(F.lit("S"), name).alias("id"), F.concat(F.lit("Title, "), "o_orderpriority").alias("title"), F.when(_k() % 3 == 0, F.concat(F.lit("10.1/"), (_k() % 4).cast("string"))).alias("doi"), _pick("o_orderkey", "confirmed", "pending", "rejected", "verified").alias("status"), F.when(_k() % 5 != 0, "web").alias("method"), F.lit("2024-01-01").alias("checked_at"), F.when(_k() % 7 != 0, "https://x").alias("url"))
    return H.sources(records.withColumn("stage", _stage("project_id")), F.col("stage"))


@catalog.add(
    "doctor_placeholders",
    f"""WITH m(k, code, soft) AS (VALUES (0, 'TODO', false), (1, 'CHECK_SOURCE', true), (2, 'VALUE_PLACEHOLDER', false)), d AS (SELECT c_custkey AS project_id, {_STAGES.format('c_custkey')} AS stage FROM customer)
    SELECT project_id, 'PLACEHOLDER' AS code, CASE WHEN soft THEN {_BY.format('INFO', 'INFO', 'ERROR')} ELSE {_BY.format('INFO', 'ERROR', 'ERROR')} END AS severity, 'drafts/a.md:' || m.code AS path FROM d JOIN m ON project_id % 4 = k""",
)
def doctor_placeholders(spark, sf_dir):
    text = _pick("c_custkey", "Text TODO and TODO `[N]`", "Source [Проверить: 12].", "From [N] to [X].", "Nothing `TODO` here.\n```\nFIXME\n```")
    return H.placeholders(projects(spark, sf_dir, F.lit("drafts/a.md").alias("path"), text.alias("text")), F.col("stage"))


@catalog.add("doctor_title", f"WITH d AS (SELECT c_custkey AS project_id, {_STAGES.format('c_custkey')} AS stage, unnest([x FOR x IN [CASE WHEN c_custkey % 4 = 0 THEN 'university' END, CASE WHEN c_custkey % 5 = 0 THEN 'topic' END, CASE WHEN c_custkey % 6 = 0 THEN 'year' END] IF x IS NOT NULL]) AS path FROM customer) SELECT project_id, 'TITLE_FIELD_MISSING' AS code, {_BY.format('INFO', 'WARNING', 'ERROR')} AS severity, path FROM d")
def doctor_title(spark, sf_dir):
    k = F.col("c_custkey")
    return H.title_page(projects(spark, sf_dir, F.when(k % 4 != 0, "U").alias("university"), F.when(k % 5 != 0, F.col("c_name")).otherwise(" ").alias("topic"), F.col("c_name").alias("author"), F.when(k % 6 != 0, 2024).alias("year")), F.col("stage"))


@catalog.add("doctor_pages", "SELECT doc_id AS project_id, 'PAGES_STALE' AS code, 'WARNING' AS severity, source AS path FROM documents WHERE abs(n_chars + doc_id % 50 * 10 - coalesce(length(text), 0)) > 0.2 * coalesce(length(text), 0)")
def doctor_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = (F.col("doc_id").alias("project_id"), F.col("source").alias("path"))
    return H.page_count(docs.select(*key, (F.col("n_chars") + F.col("doc_id") % 50 * 10).alias("chars")), docs.select(*key, F.coalesce(F.length("text"), F.lit(0)).alias("n")))


@catalog.add(
    "doctor_claims",
    f"""WITH {_P}, l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), s AS (SELECT s_suppkey, s_suppkey % 3 = 0 AS ok FROM supplier WHERE s_suppkey % 20 <> 0),
    g AS (SELECT l_orderkey, count(*) FILTER (s_suppkey IS NULL) AS gone, count(*) FILTER (ok) AS fine FROM l LEFT JOIN s ON s_suppkey = l_suppkey GROUP BY l_orderkey)
    SELECT project_id, 'CLAIM_UNSUPPORTED' AS code, CASE WHEN gone > 0 THEN 'ERROR' ELSE {_BY.format('INFO', 'WARNING', 'ERROR')} END AS severity, o_orderkey::VARCHAR AS path FROM g JOIN orders ON o_orderkey = l_orderkey JOIN p ON project_id = o_custkey WHERE gone > 0 OR fine = 0""",
)
def doctor_claims(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("source_ids"))
    claims = ids.join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("project_id"), _k().alias("claim_id"), "source_ids")
    records = table(spark, sf_dir, "supplier").filter("s_suppkey % 20 <> 0").select(F.col("s_suppkey").alias("id"), _pick("s_suppkey", "confirmed", "pending", "rejected").alias("status"))
    return H.claims(claims, records, _stage("project_id"))


@catalog.add("doctor_readiness")
def doctor_readiness(spark, sf_dir):
    """The verdict over all checks of this module's projects."""
    checks = [doctor_snapshots, doctor_audit, doctor_final_files, doctor_build, doctor_annotation, doctor_validation, doctor_waves, doctor_defense, doctor_config, doctor_evidence, doctor_sources, doctor_placeholders, doctor_title, doctor_claims]
    return H.readiness(H.diagnose(*[c(spark, sf_dir).select("project_id", "code", "severity", "path") for c in checks]), projects(spark, sf_dir))


_ALL = [name for name in catalog.sql if name in {"doctor_snapshots", "doctor_audit", "doctor_final_files", "doctor_build", "doctor_annotation", "doctor_validation", "doctor_waves", "doctor_defense", "doctor_config", "doctor_evidence", "doctor_sources", "doctor_placeholders", "doctor_title", "doctor_claims"}]
catalog.sql["doctor_readiness"] = (
    "WITH f AS ("
    + reduce(lambda a, b: f"{a} UNION ALL {b}", [f"SELECT project_id, severity FROM ({catalog.sql[n]})" for n in _ALL])
    + """), g AS (SELECT c_custkey AS project_id, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings, count(*) FILTER (severity = 'INFO') AS infos FROM customer LEFT JOIN f ON project_id = c_custkey GROUP BY c_custkey)
    SELECT *, CASE WHEN errors > 0 THEN 'not_ready' WHEN warnings > 0 THEN 'ready_with_warnings' ELSE 'ready' END AS status FROM g"""
)
