"""Review logs over the event table, and structure of documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import audit as A
from folioscope.operators import segments as S
from folioscope.operators.deal import dealt_by
from folioscope.queries.common import SQL_PARAS, Catalog, table

catalog = Catalog()


def log(spark, sf_dir):
    """The event table as a review log: users are findings, event types are actions and verdicts."""
    e = table(spark, sf_dir, "events")
    n, kind = F.col("event_id"), F.col("event_type")
    return e.select(
        F.concat(F.lit("F-"), F.col("user_id").cast("string")).alias("finding_id"),
        n.alias("seq"),
        F.when(kind == "error", 1).otherwise(0).alias("ord"),
        F.when(kind == "view", "register").when(kind == "error", F.when(n % 2 == 0, "accept_risk").otherwise("waive")).otherwise("recheck").alias("action"),
        F.when(kind == "click", "pass").when(kind == "purchase", F.when(n % 3 == 0, "fail").otherwise("partial")).when(kind == "signup", "invalid_finding").alias("verdict"),
        F.floor(n / 100).cast("long").alias("snapshot_seq"),
        F.concat(F.lit("s"), (F.floor(n / 100) % 40).cast("string")).alias("snapshot_sha"),
        F.concat(F.lit("A "), (n % 7).cast("string")).alias("auditor"),
        F.concat(F.lit("E"), (n % 5).cast("string")).alias("evidence_level"),
        F.element_at(F.array(*[F.lit(s) for s in A.SEVERITIES]), (F.col("user_id") % 4 + 1).cast("int")).alias("severity"),
        F.element_at(F.array(*[F.lit(s) for s in A.GATES]), (F.col("user_id") % 9 + 1).cast("int")).alias("gate"),
        F.when(F.col("user_id") % 3 == 0, "SUPERVISOR_APPROVAL").otherwise("SAFE_EDIT").alias("fix_class"),
        F.when(n % 4 != 0, "accepted").alias("reason"),
        (n % 6 != 1).alias("allowed"),
    )


_REPLAY = """
WITH RECURSIVE e AS (SELECT 'F-' || user_id AS id, event_id AS seq, event_type AS kind, event_id % 2 = 0 AS even, CASE event_type WHEN 'click' THEN 'pass' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'fail' ELSE 'partial' END WHEN 'signup' THEN 'invalid_finding' END AS verdict,
    event_id // 100 AS sseq, 's' || (event_id // 100) % 40 AS ssha, event_id % 7 AS auditor, event_id % 5 AS level, user_id % 4 AS sev, user_id % 9 AS gate, user_id % 3 = 0 AS approval, event_id % 4 <> 0 AS reasoned, event_id % 6 <> 1 AS allowed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT DISTINCT id, 0::BIGINT AS k, NULL::VARCHAR AS status, 0::BIGINT AS fseq, ''::VARCHAR AS fsha, 0::BIGINT AS faud, []::VARCHAR[] AS neg, 0 AS history, NULL::BIGINT AS resolved, 0::BIGINT AS sev, 0::BIGINT AS gate FROM e
  UNION ALL SELECT id, k, ns, CASE WHEN starts THEN sseq ELSE fseq END, CASE WHEN starts THEN ssha ELSE fsha END, CASE WHEN starts THEN auditor ELSE faud END, CASE WHEN status IS NOT NULL AND verdict IN ('fail', 'partial') THEN list_append(neg, ssha) ELSE neg END,
    history + CASE WHEN status IS NOT NULL AND kind <> 'view' AND (kind <> 'error' OR ns <> status) THEN 1 ELSE 0 END, CASE WHEN status IS NOT NULL AND kind <> 'view' AND ns <> status THEN CASE WHEN ns <> 'open' THEN seq END ELSE resolved END, esev, egate
  FROM (SELECT r.id, e.k, r.status, r.fseq, r.fsha, r.faud, r.neg, r.history, r.resolved, e.seq, e.kind, e.verdict, e.sseq, e.ssha, e.auditor, e.sev AS esev, e.gate AS egate, r.status IS NULL AND kind = 'view' AS starts,
    CASE WHEN r.status IS NULL THEN CASE WHEN kind = 'view' THEN 'open' END
      WHEN verdict = 'pass' AND r.status = 'open' AND NOT list_contains(neg, ssha) AND sseq > fseq AND ssha <> fsha THEN 'resolved'
      WHEN verdict = 'invalid_finding' AND r.status = 'open' AND NOT list_contains(neg, ssha) AND auditor <> faud AND level >= 3 THEN 'rejected'
      WHEN verdict IN ('fail', 'partial') AND r.status IN ('resolved', 'rejected') THEN 'open'
      WHEN kind = 'error' AND even AND r.status = 'open' AND reasoned AND e.sev >= 2 AND allowed THEN 'accepted_risk'
      WHEN kind = 'error' AND NOT even AND r.status = 'open' AND approval AND allowed THEN 'waived' ELSE r.status END AS ns
    FROM r JOIN e ON e.id = r.id AND e.k = r.k + 1)),
l AS (SELECT id AS finding_id, status, ['BLOCKER', 'MAJOR', 'MINOR', 'INFO'][sev + 1] AS severity, ['MET', 'SRC', 'LOG', 'LNG', 'STY', 'EVD', 'TEC', 'DOC', 'OWN'][gate + 1] AS gate, history, resolved AS resolved_seq FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1)
"""


@catalog.add("replay_status", _REPLAY + "SELECT * FROM l WHERE status IS NOT NULL")
def replay_status(spark, sf_dir):
    return A.replay(log(spark, sf_dir))


@catalog.add("replay_view", _REPLAY + f"SELECT gate, {', '.join(f'count(*) FILTER (status = {chr(39)}{s}{chr(39)}) AS {s}' for s in A.STATUSES)}, coalesce(string_agg(finding_id, ',' ORDER BY finding_id) FILTER (status = 'open' AND severity IN ('BLOCKER', 'MAJOR')), '') AS open_high FROM l WHERE status IS NOT NULL GROUP BY gate")
def replay_view(spark, sf_dir):
    return A.findings_view(A.replay(log(spark, sf_dir)), ["gate"])


_LOG = "SELECT 'F-' || user_id AS finding_id, event_id AS seq, (event_type = 'error')::INT AS ord, CASE WHEN event_type = 'view' THEN 'register' WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'accept_risk' ELSE 'waive' END ELSE 'recheck' END AS action FROM events"


@catalog.add(
    "replay_problems",
    f"WITH l AS ({_LOG}), f AS (SELECT finding_id, min(seq) FILTER (action = 'register') AS q FROM l GROUP BY finding_id) SELECT finding_id, seq, CASE WHEN action = 'register' THEN 'duplicate' WHEN action = 'recheck' THEN 'unknown recheck' ELSE 'unknown decision' END AS problem FROM l JOIN f USING (finding_id) WHERE (action = 'register' AND seq > q) OR (action <> 'register' AND (q IS NULL OR seq < q))",
)
def replay_problems(spark, sf_dir):
    return A.replay_problems(log(spark, sf_dir))


@catalog.add(
    "first_registrations",
    f"WITH l AS ({_LOG}) SELECT finding_id, min(seq) AS seq FROM l WHERE action = 'register' GROUP BY finding_id",
)
def first_registrations(spark, sf_dir):
    return A.first_registrations(log(spark, sf_dir)).select("finding_id", "seq")


_PRESETS, _INTENSITIES = list(A.MATRIX), ["balanced", "strict", "maximum"]
_PLAN = ", ".join(f"('{p}', '{i}', {j}, {o}, '{role}', {n})" for p in _PRESETS for i in _INTENSITIES for j in (False, True) for o in (False, True) for role, n in A.plan_rows(p, i, j, o))


def _runs(spark, sf_dir):
    n = F.col("event_id")
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(n.cast("string").alias("run_id"), pick(_PRESETS, n / 10).alias("preset"), pick(_INTENSITIES, n / 30).alias("intensity"), (n % 20 == 0).alias("project"), (n % 30 == 0).alias("odd_index"))


@catalog.add(
    "plan_tasks",
    f"""WITH p(preset, intensity, project, odd_index, role, replicas) AS (VALUES {_PLAN}),
    r AS (SELECT event_id::VARCHAR AS run_id, {_PRESETS}[(floor(event_id / 10)::BIGINT % {len(_PRESETS)}) + 1] AS preset, {_INTENSITIES}[(floor(event_id / 30)::BIGINT % 3) + 1] AS intensity, event_id % 20 = 0 AS project, event_id % 30 = 0 AS odd_index FROM events)
    SELECT run_id, role, replica::INT AS replica, run_id || '-' || role || '-' || replica AS task_id FROM (SELECT *, unnest(range(1, replicas + 1)) AS replica FROM r JOIN p USING (preset, intensity, project, odd_index))""",
)
def plan_tasks(spark, sf_dir):
    n = F.col("run_id").cast("long")
    runs = _runs(spark, sf_dir)
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    return A.plan_tasks(runs.withColumn("preset", pick(_PRESETS, F.floor(n / 10))).withColumn("intensity", pick(_INTENSITIES, F.floor(n / 30))))


_REPORT = "SELECT event_id AS report_id, ['BLOCKER', 'MAJOR', 'MINOR', 'INFO', 'OTHER'][event_id % 5 + 1] AS severity, 'E' || (event_id % 6) AS evidence_level, event_id % 3 AS n_evidence, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE 'c' END AS criterion, CASE WHEN event_id % 2 = 0 THEN 's' END AS section, CASE WHEN event_id % 7 = 0 THEN 'q' END AS quote FROM events"


@catalog.add(
    "report_problems",
    f"""WITH r AS ({_REPORT}), h AS (SELECT *, severity IN ('BLOCKER', 'MAJOR') AS high FROM r)
    SELECT report_id, unnest([x FOR x IN [CASE WHEN severity = 'OTHER' THEN 'severity' END, CASE WHEN evidence_level = 'E5' THEN 'evidence_level' END, CASE WHEN high AND evidence_level < 'E2' THEN 'weak evidence' END, CASE WHEN high AND n_evidence = 0 THEN 'no evidence' END, CASE WHEN high AND trim(criterion) = '' THEN 'no criterion' END, CASE WHEN high AND section IS NULL AND quote IS NULL THEN 'no place' END] IF x IS NOT NULL]) AS problem FROM h""",
)
def report_problems(spark, sf_dir):
    n = F.col("event_id")
    reports = table(spark, sf_dir, "events").select(
        n.alias("report_id"),
        F.element_at(F.array(*[F.lit(s) for s in (*A.SEVERITIES, "OTHER")]), (n % 5 + 1).cast("int")).alias("severity"),
        F.concat(F.lit("E"), (n % 6).cast("string")).alias("evidence_level"),
        (n % 3).alias("n_evidence"),
        F.when(n % 4 == 0, " ").otherwise("c").alias("criterion"),
        F.when(n % 2 == 0, "s").alias("section"),
        F.when(n % 7 == 0, "q").alias("quote"),
    )
    return A.report_problems(reports)


@catalog.add("close_outcome", "WITH t AS (SELECT user_id, event_id % 40 AS run, CASE event_type WHEN 'error' THEN 'pending' WHEN 'signup' THEN 'fail' WHEN 'click' THEN 'not_applicable' ELSE 'pass' END AS status FROM events) SELECT user_id, run, CASE WHEN bool_or(status = 'pending') THEN 'open' WHEN bool_and(status IN ('pass', 'not_applicable')) THEN 'complete' ELSE 'reported' END AS outcome FROM t GROUP BY user_id, run")
def close_outcome(spark, sf_dir):
    kind = F.col("event_type")
    tasks = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 40).alias("run"), F.when(kind == "error", "pending").when(kind == "signup", "fail").when(kind == "click", "not_applicable").otherwise("pass").alias("status"))
    return A.close_outcome(tasks, ["user_id", "run"])


@catalog.add(
    "run_order",
    """WITH a AS (SELECT user_id AS run_id, event_type AS task_id, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 9 ELSE row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) END AS attempt, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
    r AS (SELECT user_id AS run_id, min(event_id) + 10 AS planned, max(event_id) - 10 AS closed FROM events GROUP BY user_id)
    SELECT run_id, task_id, seq, unnest([x FOR x IN [CASE WHEN attempt <> n THEN 'number' END, CASE WHEN seq <= planned THEN 'before plan' END, CASE WHEN seq >= closed THEN 'after close' END] IF x IS NOT NULL]) AS problem FROM a JOIN r USING (run_id)""",
)
def run_order(spark, sf_dir):
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    attempts = events.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("task_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 == 0, 9).otherwise(n).alias("attempt"))
    runs = events.groupBy(F.col("user_id").alias("run_id")).agg((F.min("event_id") + 10).alias("planned"), (F.max("event_id") - 10).alias("closed"))
    return A.run_order_problems(runs, attempts)


@catalog.add(
    "snapshot_sha",
    """WITH i AS (SELECT o_custkey, 'orders/' || o_orderkey AS logical_id, o_orderpriority AS kind, sha256(o_orderstatus) AS sha256 FROM orders)
    SELECT o_custkey, count(*) AS n_inputs, sha256('[' || string_agg('{"logical_id":"' || logical_id || '","kind":"' || kind || '","sha256":"' || sha256 || '"}', ',' ORDER BY logical_id, kind, sha256) || ']') AS snapshot_sha FROM i GROUP BY o_custkey""",
)
def snapshot_sha(spark, sf_dir):
    inputs = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("logical_id"), F.col("o_orderpriority").alias("kind"), F.sha2(F.col("o_orderstatus").cast("binary"), 256).alias("sha256"))
    return A.snapshot_sha(inputs, ["o_custkey"])


@catalog.add(
    "event_chain",
    """WITH h AS (SELECT user_id, event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS h FROM events),
    c AS (SELECT user_id, list(h ORDER BY event_id) AS hs FROM h GROUP BY user_id)
    SELECT user_id, list_reduce(list_prepend('', hs), lambda a, x: sha256(a || '|' || x)) AS last_sha FROM c""",
)
def event_chain(spark, sf_dir):
    chained = A.chained_ids(table(spark, sf_dir, "events"), ["user_id"], "event_id", ["event_type", "user_id"])
    return chained.groupBy("user_id").agg(F.max_by("event_sha", "event_id").alias("last_sha"))


@catalog.add("journal_append", "SELECT event_id, event_type FROM events WHERE event_id % 3 = 2")
def journal_append(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    found = events.filter("event_id % 3 <> 1")
    return A.journal_append(events.filter("event_id % 3 <> 2"), found.unionByName(found))


@catalog.add("handoff_staleness", "WITH h AS (SELECT c_custkey AS user_id, c_custkey * 7 AS recorded FROM customer), l AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY user_id) SELECT user_id, recorded, last, coalesce(last > recorded, false) AS stale FROM h LEFT JOIN l USING (user_id)")
def handoff_staleness(spark, sf_dir):
    handoff = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") * 7).alias("recorded"))
    return A.staleness(handoff, table(spark, sf_dir, "events"), ["user_id"], "recorded", "event_id")


@catalog.add("readiness", "SELECT user_id, event_id % 20 AS project, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS warnings, count(*) FILTER (event_type NOT IN ('error', 'purchase')) AS infos, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'not_ready' WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'ready_with_warnings' ELSE 'ready' END AS status FROM events GROUP BY ALL")
def readiness(spark, sf_dir):
    kind = F.col("event_type")
    findings = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 20).alias("project"), F.when(kind == "error", "ERROR").when(kind == "purchase", "WARNING").otherwise("INFO").alias("severity"))
    return A.verdict(findings, ["user_id", "project"])


@catalog.add("intensity_lowered", "SELECT * FROM (SELECT user_id, event_id, event_id % 3 AS rank, max(event_id % 3) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM events) WHERE rank < highest")
def intensity_lowered(spark, sf_dir):
    return A.lowered(table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 3).alias("rank")), ["user_id"], "event_id", "rank")


@catalog.add(
    "blind_pairs",
    """WITH r AS (SELECT user_id AS work, event_id AS run_id, CASE WHEN event_id % 2 = 0 THEN 'primary' ELSE 'blind' END AS kind, event_id AS planned, CASE WHEN event_id % 5 <> 0 THEN event_id + 100 END AS closed, [event_id % 4, event_id % 6] AS auditors FROM events)
    SELECT a.work, a.run_id AS primary_run, b.run_id AS blind_run FROM r a JOIN r b USING (work) WHERE a.kind = 'primary' AND b.kind = 'blind' AND a.closed IS NOT NULL AND b.planned > a.closed AND NOT list_has_any(a.auditors, b.auditors)""",
)
def blind_pairs(spark, sf_dir):
    n = F.col("event_id")
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("work"), n.alias("run_id"), F.when(n % 2 == 0, "primary").otherwise("blind").alias("kind"), n.alias("planned"), F.when(n % 5 != 0, n + 100).alias("closed"), F.array(n % 4, n % 6).alias("auditors"))
    return A.blind_pairs(runs)


@catalog.add(
    "marker_scan",
    "SELECT doc_id, unnest([0, 1, 2]) AS pos, unnest(['CHECK_SOURCE', 'VALUE_PLACEHOLDER', 'TODO']) AS code, unnest(['[проверить: ' || doc_id || ']', '[N]', 'TODO']) AS mark FROM documents WHERE doc_id % 5 = 0",
)
def marker_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("TODO [N] [проверить: "), F.col("doc_id").cast("string"), F.lit("] "), X.null_empty(F.col("text")))).otherwise(F.col("text")))
    return S.markers(docs, ["doc_id"])


PATTERNS = (("fact", ("the", "und"), ()), ("choice", ("of", "que", "les"), ("src1", "src2", "src3")), ("result", ("is", "ein"), ("src4",)))


@catalog.add(
    "ownership_tags",
    "WITH "
    + SQL_PARAS
    + r""", p2 AS (SELECT doc_id, source, unnest(paras) AS t, unnest(range(len(paras))) AS idx FROM s JOIN documents USING (doc_id)),
    w AS (SELECT doc_id, idx, source, regexp_extract_all(lower(t), '[\p{L}\p{N}_]+') AS w FROM p2),
    f AS (SELECT doc_id, idx, unnest(['fact', 'choice', 'result']) AS category, unnest([array_to_string([x FOR x IN ['the', 'und'] IF list_contains(w, x)], ';'), CASE WHEN source IN ('src1', 'src2', 'src3') THEN array_to_string([x FOR x IN ['of', 'que', 'les'] IF list_contains(w, x)], ';') ELSE '' END, CASE WHEN source = 'src4' THEN array_to_string([x FOR x IN ['is', 'ein'] IF list_contains(w, x)], ';') ELSE '' END]) AS found FROM w)
    SELECT doc_id, idx::INT AS idx, category, found FROM f WHERE found <> ''""",
)
def ownership_tags(spark, sf_dir):
    paras = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(X.paragraphs(F.col("text"))).alias("idx", "text"))
    return S.tagged(paras, PATTERNS, ["doc_id", "idx"], "source")


@catalog.add(
    "html_blocks",
    r"""WITH p AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<nav\b.*?</nav\s*>|<footer\b.*?</footer\s*>|<head\b.*?</head\s*>|<!--.*?-->', ' ', 'g') AS t FROM pages),
    b AS (SELECT page_id, [x FOR x IN [trim(regexp_replace(regexp_replace(y, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) FOR y IN string_split_regex(t, '(?i)<\s*/?\s*(?:p|div|h[1-6]|li|ul|ol|br|tr|td|table|article|section|body|html)\b[^>]*>')] IF x <> ''] AS b FROM p)
    SELECT page_id, unnest(range(len(b)))::INT AS idx, replace(replace(replace(replace(replace(replace(unnest(b), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS text FROM b""",
)
def html_blocks(spark, sf_dir):
    return S.html_blocks(table(spark, sf_dir, "pages"))


@catalog.add("html_fingerprints", f"SELECT page_id, count(*) AS lines, sha256(string_agg(text, chr(10) ORDER BY idx)) AS fingerprint FROM ({catalog.sql['html_blocks']}) GROUP BY page_id")
def html_fingerprints(spark, sf_dir):
    return S.text_fingerprint(S.html_blocks(table(spark, sf_dir, "pages")), ["page_id"])


def work_blocks(spark, sf_dir):
    """Documents as works: headings are put between their lines. Documents are dealt out by key, so that their blocks are together when they are cut."""
    docs = dealt_by(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    own = F.filter(F.split(X.null_empty(F.col("text")), "\n"), lambda p: F.length(p) > 0)
    n = F.col("doc_id")
    heads = F.array(*[F.lit(x) for x in ("Содержание", "Введение.", "Глава 1. Основы", "ГЛАВА II", "Заключение", "Список литературы", "Приложение 1")])
    each = docs.select("doc_id", F.posexplode(own).alias("i", "line"))
    head = F.when((F.col("i") + n) % 5 == 0, F.element_at(heads, ((F.col("i") / 5 + n) % 7 + 1).cast("int")))
    both = each.select("doc_id", F.explode(F.array(F.struct((F.col("i") * 2).alias("idx"), head.alias("text")), F.struct((F.col("i") * 2 + 1).alias("idx"), F.col("line").alias("text")))).alias("b"))
    return both.filter("b.text is not null").select("doc_id", "b.idx", "b.text").withColumn("heading_level", F.when(F.col("idx") % 2 == 0, 1))


_KINDS = "CASE text WHEN 'Содержание' THEN 'contents' WHEN 'Введение.' THEN 'introduction' WHEN 'Глава 1. Основы' THEN 'chapter' WHEN 'ГЛАВА II' THEN 'chapter' WHEN 'Заключение' THEN 'conclusion' WHEN 'Список литературы' THEN 'bibliography' WHEN 'Приложение 1' THEN 'appendix' END"
_BLOCKS = f"""
d AS (SELECT doc_id, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF length(x) > 0] AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
b AS (SELECT doc_id, (i * 2)::INT AS idx, ['Содержание', 'Введение.', 'Глава 1. Основы', 'ГЛАВА II', 'Заключение', 'Список литературы', 'Приложение 1'][trunc((i / 5 + doc_id) % 7 + 1)::INT] AS text FROM e WHERE (i + doc_id) % 5 = 0 UNION ALL SELECT doc_id, (i * 2 + 1)::INT, line FROM e),
k AS (SELECT doc_id, idx, text, {_KINDS} AS kind, CASE text WHEN 'Глава 1. Основы' THEN 1 WHEN 'ГЛАВА II' THEN 2 END AS number FROM b)
"""


@catalog.add(
    "regions",
    f"""WITH {_BLOCKS} SELECT doc_id, idx, coalesce(last_value(kind IGNORE NULLS) OVER w, 'front') AS region_kind, CASE WHEN last_value(kind IGNORE NULLS) OVER w = 'chapter' THEN last_value(CASE WHEN kind = 'chapter' THEN number END IGNORE NULLS) OVER w END AS chapter_no, count(kind) OVER w AS region, kind IS NOT NULL AS starts FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)""",
)
def regions(spark, sf_dir):
    return S.regions(work_blocks(spark, sf_dir)).select("doc_id", "idx", "region_kind", "chapter_no", "region", "starts")


_REGIONS = f"""{_BLOCKS}, r AS (SELECT doc_id, idx, text, coalesce(last_value(kind IGNORE NULLS) OVER w, 'front') AS region_kind, CASE WHEN last_value(kind IGNORE NULLS) OVER w = 'chapter' THEN last_value(CASE WHEN kind = 'chapter' THEN number END IGNORE NULLS) OVER w END AS chapter_no, kind IS NOT NULL AS starts FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING))"""
_SECTIONS = f"""{_REGIONS}, t AS (SELECT doc_id, idx, CASE WHEN region_kind = 'chapter' THEN 'chapter' || chapter_no WHEN region_kind IN ('introduction', 'conclusion') THEN region_kind END AS section, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM r WHERE NOT starts),
sec AS (SELECT doc_id, section, count(*) FILTER (length(t) > 30) AS paragraphs, coalesce(string_agg(t, chr(10) ORDER BY idx) FILTER (length(t) > 30), '') AS text FROM t WHERE section IS NOT NULL AND t <> '' AND NOT (length(t) <= 250 AND regexp_matches(t, '(?:\\t|\\.{{3,}}|…+|_{{3,}})\\s*\\d{{1,4}}\\s*$')) GROUP BY doc_id, section)"""


@catalog.add("sections", f"WITH {_SECTIONS} SELECT * FROM sec")
def sections(spark, sf_dir):
    return S.sections(work_blocks(spark, sf_dir))


@catalog.add(
    "missing_sections",
    f"""WITH {_SECTIONS}, g AS (SELECT doc_id, coalesce(max(TRY_CAST(regexp_extract(section, '^chapter(\\d+)$', 1) AS INT)), 0) AS n FROM sec GROUP BY doc_id), w AS (SELECT doc_id, unnest(list_concat(['introduction', 'conclusion'], ['chapter' || i FOR i IN range(1, n + 1)])) AS section FROM g) SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM sec WHERE sec.doc_id = w.doc_id AND sec.section = w.section)""",
)
def missing_sections(spark, sf_dir):
    return S.missing_sections(S.sections(work_blocks(spark, sf_dir)))
