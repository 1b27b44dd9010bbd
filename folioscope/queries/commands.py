"""Commands on review runs over the event table: users are runs, event types are commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import commands as C
from folioscope.operators.audit import SEVERITIES
from folioscope.queries.common import Catalog, table

catalog = Catalog()


def commands(spark, sf_dir):
    """All events as commands: views plan, clicks and purchases record, signups close, errors accept or waive."""
    n, kind = F.col("event_id"), F.col("event_type")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    plan = F.when(n % 10 == 0, F.array().cast("array<string>")).when(n % 10 == 1, F.array(F.lit("T0"), F.lit("T1"), F.lit("T0"))).otherwise(F.array(F.lit("T0"), F.lit("T1"), F.lit("T2")))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("R-"), F.col("user_id").cast("string")).alias("run_id"),
        F.col("ts").alias("time"),
        n.alias("seq"),
        F.when(kind == "view", "plan").when(kind.isin("click", "purchase"), "record").when(kind == "signup", "close").otherwise(pick("accept_risk", "waive")).alias("action"),
        F.when(kind == "view", plan).alias("tasks"),
        F.when(n % 11 == 5, "T9").otherwise(F.concat(F.lit("T"), (n % 3).cast("string"))).alias("task_id"),
        F.when(kind == "click", F.when(n % 13 == 0, "unclear").otherwise(pick("pass", "not_applicable", "pass"))).otherwise(pick("fail", "partial")).alias("status"),
        F.when((kind == "purchase") | (n % 8 == 0), pick(*SEVERITIES, "MINOR", "INFO", "INFO")).alias("severity"),
        pick("SAFE_EDIT", "SUPERVISOR_APPROVAL", "USER_DECISION").alias("fix_class"),
        F.concat(F.lit("F-00"), (n % 4 + 1).cast("string")).alias("finding_id"),
        F.when(n % 17 == 0, " ").otherwise(F.concat(F.lit("Person "), (n % 5).cast("string"))).alias("auditor"),
        F.when(n % 3 != 1, "said").alias("reason"),
    )


_COMMANDS = """
c AS (SELECT 'R-' || user_id AS run_id, ts AS time, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_id AS n,
    CASE WHEN event_type = 'view' THEN 'plan' WHEN event_type IN ('click', 'purchase') THEN 'record' WHEN event_type = 'signup' THEN 'close' WHEN event_id % 2 = 0 THEN 'accept_risk' ELSE 'waive' END AS action,
    event_id % 3 + 1 AS t, event_id % 11 = 5 AS unknown, CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 13 = 0 THEN 'unclear' ELSE ['pass', 'not_applicable', 'pass'][event_id % 3 + 1] END ELSE ['fail', 'partial'][event_id % 2 + 1] END AS report,
    CASE WHEN event_type = 'purchase' OR event_id % 8 = 0 THEN ['BLOCKER', 'MAJOR', 'MINOR', 'INFO', 'MINOR', 'INFO', 'INFO'][event_id % 7 + 1] END AS severity, ['SAFE_EDIT', 'SUPERVISOR_APPROVAL', 'USER_DECISION'][event_id % 3 + 1] AS fix,
    event_id % 4 + 1 AS f, CASE WHEN event_id % 17 <> 0 THEN 'person' || event_id % 5 END AS auditor, event_id % 3 <> 1 AS reasoned FROM events)
"""

_STATE = "NULL::VARCHAR AS status, [0, 0, 0]::INT[] AS att, ['', '', '']::VARCHAR[] AS st, ['', '', '']::VARCHAR[] AS aud, []::STRUCT(status VARCHAR, severity VARCHAR, fix VARCHAR)[] AS fin"

DECIDED = f"""
WITH RECURSIVE {_COMMANDS},
w AS (SELECT DISTINCT run_id, NULL::TIMESTAMP AS time, 0::BIGINT AS seq, 0::BIGINT AS k, ''::VARCHAR AS action, ''::VARCHAR AS code, {_STATE}, 0 AS attempt, 0 AS finding FROM c
  UNION ALL
  SELECT run_id, time, seq, k, action, code,
    CASE WHEN code = 'planned' THEN 'planned' WHEN code = 'recorded' THEN 'running' WHEN code IN ('invalidated', 'abandoned', 'complete', 'reported') THEN code ELSE status END,
    CASE WHEN code = 'planned' THEN [0, 0, 0]::INT[] WHEN code = 'recorded' THEN [CASE WHEN i = t THEN att[i] + 1 ELSE att[i] END FOR i IN [1, 2, 3]] ELSE att END,
    CASE WHEN code = 'planned' THEN ['', '', ''] WHEN code = 'recorded' THEN [CASE WHEN i <> t THEN st[i] WHEN report = 'pass' AND severity IN ('BLOCKER', 'MAJOR') THEN 'fail' ELSE report END FOR i IN [1, 2, 3]] ELSE st END,
    CASE WHEN code = 'planned' THEN ['', '', ''] WHEN code = 'recorded' THEN [CASE WHEN i = t THEN auditor ELSE aud[i] END FOR i IN [1, 2, 3]] ELSE aud END,
    CASE WHEN code = 'recorded' AND severity IS NOT NULL THEN list_append(fin, {{'status': 'open', 'severity': severity, 'fix': fix}}) WHEN code IN ('accepted_risk', 'waived') THEN [CASE WHEN i = f THEN {{'status': code, 'severity': fin[i].severity, 'fix': fin[i].fix}} ELSE fin[i] END FOR i IN range(1, len(fin) + 1)] ELSE fin END,
    CASE WHEN code = 'recorded' THEN att[t] + 1 END, CASE WHEN code = 'recorded' AND severity IS NOT NULL THEN len(fin) + 1 WHEN code IN ('accepted_risk', 'waived') THEN f END
  FROM (SELECT *, CASE
      WHEN action = 'plan' THEN CASE WHEN n % 10 = 0 THEN 'PLAN_EMPTY' WHEN n % 10 = 1 THEN 'PLAN_DUPLICATE_TASK' WHEN status IN ('planned', 'running') THEN 'RUN_ALREADY_OPEN' WHEN status = 'complete' THEN 'RUN_ALREADY_COMPLETE' WHEN status = 'reported' AND opened THEN 'RUN_HAS_OPEN_FINDINGS' ELSE 'planned' END
      WHEN action = 'record' THEN CASE WHEN status IS NULL THEN 'RUN_NOT_FOUND' WHEN unknown THEN 'TASK_NOT_FOUND' WHEN status NOT IN ('planned', 'running') THEN 'RUN_CLOSED' WHEN auditor IS NULL THEN 'AUDITOR_ID_INVALID' WHEN att[t] > 0 AND NOT reasoned THEN 'RETRY_REASON_REQUIRED'
        WHEN list_contains([aud[i] FOR i IN [1, 2, 3] IF i <> t], auditor) THEN 'AUDITOR_NOT_INDEPENDENT' WHEN report = 'unclear' THEN 'REPORT_SCHEMA_INVALID' ELSE 'recorded' END
      WHEN action = 'close' THEN CASE WHEN status IS NULL THEN 'RUN_NOT_FOUND' WHEN status IN ('complete', 'invalidated', 'abandoned') THEN 'already closed' WHEN list_sum(att) = 0 THEN 'invalidated' WHEN list_contains(att, 0) THEN CASE WHEN reasoned THEN 'abandoned' ELSE 'RUN_TASKS_PENDING' END
        WHEN NOT opened AND len([x FOR x IN st IF x NOT IN ('pass', 'not_applicable')]) = 0 THEN 'complete' ELSE 'reported' END
      WHEN action = 'accept_risk' AND NOT reasoned THEN 'REASON_REQUIRED' WHEN f > len(fin) THEN 'FINDING_NOT_FOUND'
      WHEN action = 'accept_risk' THEN CASE WHEN fin[f].status <> 'open' OR fin[f].severity IN ('BLOCKER', 'MAJOR') THEN 'ACCEPT_RISK_DENIED' ELSE 'accepted_risk' END
      WHEN fin[f].status <> 'open' OR fin[f].fix <> 'SUPERVISOR_APPROVAL' THEN 'WAIVE_DENIED' ELSE 'waived' END AS code
    FROM (SELECT w.run_id, c.time, c.seq, c.k, c.action, c.n, c.t, c.unknown, c.report, c.severity, c.fix, c.f, c.auditor, c.reasoned, w.status, w.att, w.st, w.aud, w.fin, len([x FOR x IN w.fin IF x.status = 'open']) > 0 AS opened FROM w JOIN c ON c.run_id = w.run_id AND c.k = w.k + 1)))
SELECT run_id, time, seq, action, code = lower(code) AS accepted, code, status AS run_status, attempt, CASE WHEN finding IS NOT NULL THEN 'F-' || lpad(finding::VARCHAR, 3, '0') END AS finding, CASE WHEN finding IS NOT NULL THEN fin[finding].status END AS finding_status FROM w WHERE k > 0
"""


@catalog.add("command_log", DECIDED)
def command_log(spark, sf_dir):
    return C.decided(commands(spark, sf_dir))


@catalog.add("command_rejections", DECIDED.replace("\nSELECT run_id, time, seq, action, code = lower", ", o AS (SELECT run_id, time, seq, action, code = lower") + ") SELECT run_id, code, count(*) AS n FROM o WHERE NOT accepted GROUP BY run_id, code")
def command_rejections(spark, sf_dir):
    return C.decided(commands(spark, sf_dir)).filter("not accepted").groupBy("run_id", "code").agg(F.count("*").alias("n"))
