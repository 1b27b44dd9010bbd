"""Facts about reviews that their decisions rest on, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import audit as A
from folioscope.queries.common import Catalog, table

catalog = Catalog()

_RUNS = """r AS (SELECT user_id AS work, event_id AS run_id, CASE WHEN event_id % 7 = 0 THEN 'blind' ELSE 'primary' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'product' ELSE 'subsection' END AS preset,
    CASE WHEN event_id % 11 = 0 THEN 'other' WHEN event_id % 11 = 1 THEN NULL ELSE 'subsection-' || (event_id % 3 + 1) || '.' || (event_id % 5 + 1) END AS checkpoint, event_id AS planned, CASE WHEN event_type IN ('view', 'purchase', 'click') THEN event_id + 50 + event_id % 200 END AS closed FROM events),
    c AS (SELECT *, coalesce(checkpoint, run_id::VARCHAR) AS name, nullif(regexp_extract(checkpoint, '^subsection-([0-9]+)[.][0-9]', 1), '') AS chapter FROM r)"""


@catalog.add(
    "subsection_index",
    f"""WITH {_RUNS}, n AS (SELECT a.run_id, count(DISTINCT b.name) AS index FROM c AS a LEFT JOIN c AS b ON a.work = b.work AND b.kind = 'primary' AND b.closed < a.planned AND b.name <> a.name AND CASE WHEN a.chapter IS NOT NULL THEN b.chapter = a.chapter ELSE b.preset = 'subsection' END GROUP BY a.run_id)
    SELECT work, run_id, chapter, index, index % 2 = 1 AS odd FROM c JOIN n USING (run_id)""",
)
def subsection_index(spark, sf_dir):
    n = F.col("event_id")
    name = F.concat(F.lit("Subsection-0"), (n % 3 + 1).cast("string"), F.lit("."), (n % 5 + 1).cast("string"))
    runs = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("work"), n.alias("run_id"), F.when(n % 7 == 0, "blind").otherwise("primary").alias("kind"), F.when(n % 3 == 0, "product").otherwise("subsection").alias("preset"),
        F.when(n % 11 == 0, "other").when(n % 11 == 1, None).otherwise(name).alias("checkpoint"), n.alias("planned"), F.when(F.col("event_type").isin("view", "purchase", "click"), n + 50 + n % 200).alias("closed"),
    )
    return A.subsection_index(runs)


@catalog.add(
    "approval_problems",
    """WITH d AS (SELECT o_custkey, o_orderkey, o_orderkey % 10 AS k FROM orders)
    SELECT o_custkey, o_orderkey, CASE WHEN k IN (0, 1) THEN 'outside' WHEN k IN (2, 3) THEN 'missing' WHEN k = 4 THEN 'unregistered' WHEN k = 5 AND o_orderkey % 4 = 1 THEN 'changed' END AS problem FROM d WHERE k <= 4 OR (k = 5 AND o_orderkey % 4 = 1)""",
)
def approval_problems(spark, sf_dir):
    """Approvals of all orders: outside of the folder, missing, empty, in another group of the index, changed, or right under another spelling."""
    n, k = F.col("o_orderkey"), F.col("o_orderkey") % 10
    orders = table(spark, sf_dir, "orders")
    name = lambda *before: F.concat(*[F.lit(b) for b in before], n.cast("string"), F.lit(".pdf"))
    decisions = orders.select("o_custkey", n, F.when(k == 0, name("evidence/../../")).when(k == 1, name("audit/")).when(k == 6, name("./Evidence\\")).otherwise(name("evidence/")).alias("approval"), F.when(n % 2 == 1, F.lit("sha-a")).alias("sha"))
    files = orders.filter(k != 2).select("o_custkey", F.when(k == 1, name("audit/")).otherwise(name("evidence/")).alias("path"), F.when(k == 3, 0).otherwise(10).alias("size"), F.when((k == 5) & (n % 4 == 1), "sha-b").otherwise("sha-a").alias("sha256"))
    entries = orders.select("o_custkey", F.when(k == 4, "defense").otherwise("approvals").alias("grp"), name("evidence/").alias("path"))
    return A.approval_problems(decisions, files, entries, ["o_custkey"], "o_orderkey")


@catalog.add(
    "stored_reports",
    """WITH r AS (SELECT user_id, event_id, sha256('[{"key":"n","value":"' || event_id % 2 || '"},{"key":"status","value":"\\"' || event_type || '\\""}]') AS sha FROM events WHERE event_id % 19 <> 0)
    SELECT user_id, event_id, sha FROM r QUALIFY lag(sha) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM sha""",
)
def stored_reports(spark, sf_dir):
    """Reports of all events, whose keys stand in either order, with a time and a host that change each time; some are no JSON."""
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    two = (F.col("event_id") % 2).cast("string")
    one = F.concat(F.lit('{"status":"'), kind, F.lit('","at":"'), n, F.lit('","n":'), two, F.lit(',"host":{"name":"h'), n, F.lit('"}}'))
    other = F.concat(F.lit('{ "n": '), two, F.lit(', "host": null, "status": "'), kind, F.lit('"}'))
    payload = F.when(F.col("event_id") % 19 == 0, "broken").when(F.col("event_id") % 3 == 0, other).otherwise(one)
    return A.stored_reports(table(spark, sf_dir, "events").select("user_id", "event_id", payload.alias("payload")), ["user_id"], "event_id", "payload", ["at", "host"])


_GATES = list(A.GATES)


@catalog.add(
    "risk_facts",
    f"""WITH a AS (SELECT user_id, event_id AS seq FROM events WHERE event_type = 'error'),
    f AS (SELECT user_id, {_GATES}[user_id % 9 + 1] AS gate, min(event_id) FILTER (event_type = 'view') AS run_id, min(event_id) AS planned, 'k' || user_id % 11 AS key, 'E' || user_id % 5 AS level, CASE WHEN user_id % 4 = 3 THEN 'MAJOR' ELSE 'MINOR' END AS severity FROM events GROUP BY user_id),
    w AS (SELECT {_GATES}[event_id % 9 + 1] AS gate, event_id AS run_id, event_id AS planned, CASE WHEN event_id % 13 <> 0 THEN event_id + 5 + event_id % 40 END AS closed, CASE WHEN event_id % 17 <> 0 THEN 'k' || event_id % 11 END AS key FROM events WHERE event_type = 'view'),
    x AS (SELECT DISTINCT gate, run_id FROM f WHERE level >= 'E2'),
    o AS (SELECT a.user_id, a.seq, count(DISTINCT w.key) >= 3 AND count(x.run_id) = 0 AS allowed FROM a JOIN f USING (user_id) LEFT JOIN w ON w.gate = f.gate AND w.planned > f.planned AND w.closed < a.seq AND w.key <> f.key LEFT JOIN x ON x.gate = w.gate AND x.run_id = w.run_id
      WHERE f.gate IN ('STY', 'LNG', 'LOG') AND f.severity = 'MINOR' GROUP BY a.user_id, a.seq)
    SELECT user_id AS finding_id, seq, coalesce(allowed, true) AS allowed FROM a LEFT JOIN o USING (user_id, seq)""",
)
def risk_facts(spark, sf_dir):
    """All errors as decisions to accept a finding's risk, with what the later waves of its gate allow."""
    n, u = F.col("event_id"), F.col("user_id")
    gate = lambda k: F.element_at(F.array(*[F.lit(g) for g in A.GATES]), (k % 9 + 1).cast("int"))
    events = table(spark, sf_dir, "events")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    asks = events.filter("event_type = 'error'").select(u.alias("finding_id"), n.alias("seq"), F.lit("accept_risk").alias("action"), F.lit(True).alias("allowed"))
    findings = events.groupBy(u.alias("finding_id")).agg(F.min(F.when(F.col("event_type") == "view", n)).alias("run_id"), F.min(n).alias("planned"))
    f = F.col("finding_id")
    findings = findings.select(f, gate(f).alias("gate"), "run_id", "planned", text("k", f % 11).alias("content_key"), text("E", f % 5).alias("evidence_level"), F.when(f % 4 == 3, "MAJOR").otherwise("MINOR").alias("severity"))
    waves = events.filter("event_type = 'view'").select(gate(n).alias("gate"), n.alias("run_id"), n.alias("planned"), F.when(n % 13 != 0, n + 5 + n % 40).alias("closed"), F.when(n % 17 != 0, text("k", n % 11)).alias("content_key"))
    return A.risk_facts(asks, waves, findings).select("finding_id", "seq", "allowed")
