"""Registry checks over the star schema and the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import audit as A
from folioscope.operators import registry as R
from folioscope.queries.common import Catalog, table

catalog = Catalog()

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'pending' ELSE 'suspicious' END"


@catalog.add(
    "registry_report",
    f"""WITH s AS (SELECT replace({STATUS}, 'verified', 'confirmed') AS s, coalesce(o_totalprice < 200000, false) AS v, coalesce(o_orderdate < TIMESTAMP '1993-01-01', false) AS t FROM orders),
    c AS (SELECT count(*) AS n, count(*) FILTER (s = 'confirmed') AS confirmed, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'suspicious') AS suspicious, count(*) FILTER (s = 'rejected') AS rejected, count(*) FILTER (s = 'confirmed' AND NOT v) AS unverified, count(*) FILTER (t) AS stale FROM s)
    SELECT *, n > 0 AND confirmed = n AND unverified = 0 AND stale = 0 AS clean FROM c""",
)
def registry_report(spark, sf_dir):
    return R.status_report(table(spark, sf_dir, "orders"), F.expr(STATUS), F.col("o_totalprice") < 200000, F.col("o_orderdate") < F.lit("1993-01-01").cast("timestamp_ntz"))


@catalog.add("dangling_refs", "SELECT l_orderkey, l_linenumber, l_partkey AS ref FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def dangling_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("ref"))
    return R.unmatched(refs, table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("ref")), ["ref"]).select("l_orderkey", "l_linenumber", "ref")


@catalog.add("unused_refs", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unused_refs(spark, sf_dir):
    return R.unmatched(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@catalog.add(
    "captions_mentions",
    "WITH a AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS number FROM lineitem WHERE l_returnflag = 'N'), b AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS number FROM lineitem WHERE l_linestatus = 'O') SELECT doc, number, 'left' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT doc, number, 'right' AS side FROM (FROM b EXCEPT FROM a)",
)
def captions_mentions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("number"), "l_returnflag", "l_linestatus")
    return R.both_sides(lines.filter("l_returnflag = 'N'"), lines.filter("l_linestatus = 'O'"), ["doc", "number"])


@catalog.add("resolved_refs", "SELECT l_orderkey, l_linenumber, l_suppkey, s_name AS resolved FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey")
def resolved_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return R.resolve(refs, table(spark, sf_dir, "supplier").filter("s_acctbal > 0"), "l_suppkey", "s_suppkey", "s_name").select("l_orderkey", "l_linenumber", "l_suppkey", "resolved")


@catalog.add("flagged_refs", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY l_orderkey")
def flagged_refs(spark, sf_dir):
    sources = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return R.flagged(table(spark, sf_dir, "lineitem").select("l_orderkey"), sources, ["l_orderkey"], F.col("o_orderstatus") == "P").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@catalog.add(
    "claim_resolution",
    """WITH c AS (SELECT l_orderkey, list(l_partkey) FILTER (l_quantity > 5) AS refs FROM lineitem GROUP BY l_orderkey),
    e AS (SELECT l_orderkey, unnest(CASE WHEN len(coalesce(refs, [])) = 0 THEN [NULL] ELSE refs END) AS k FROM c),
    s AS (SELECT p_partkey AS k, CASE WHEN p_size > 30 THEN 'confirmed' ELSE 'pending' END AS s FROM part WHERE p_retailprice > 950),
    g AS (SELECT l_orderkey, count(k) AS n_refs, count(*) FILTER (k IS NOT NULL AND s IS NULL) AS n_missing, count(*) FILTER (s = 'confirmed') AS n_confirmed FROM e LEFT JOIN s USING (k) GROUP BY l_orderkey)
    SELECT *, CASE WHEN n_missing > 0 THEN 'missing' WHEN n_confirmed = 0 THEN 'unsupported' ELSE 'supported' END AS outcome FROM g""",
)
def claim_resolution(spark, sf_dir):
    claim = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_quantity") > 5, F.col("l_partkey"))).alias("refs"))
    sources = table(spark, sf_dir, "part").filter("p_retailprice > 950").select("p_partkey", F.when(F.col("p_size") > 30, "supported").otherwise("pending").alias("status"))
    return R.claims(claim, "l_orderkey", "refs", sources, "p_partkey", "status")


@catalog.add(
    "duplicates",
    r"""WITH k AS (SELECT doc_id AS pos, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]', '', 'g') AS key FROM documents), f AS (SELECT *, min(pos) OVER (PARTITION BY key) AS first_pos FROM k WHERE key <> '') SELECT sha256(key) AS key, pos, first_pos FROM f WHERE pos > first_pos""",
)
def duplicates(spark, sf_dir):
    found = R.duplicates(table(spark, sf_dir, "documents"), F.sha2(F.nullif(F.regexp_replace(F.lower(X.null_empty(F.col("text"))), r"[^\p{L}\p{N}]", ""), F.lit("")).cast("binary"), 256), "doc_id")
    return found.select("key", "pos", "first_pos")


@catalog.add("duplicate_ids", "SELECT lower(c_mktsegment) AS key, c_custkey AS pos, min(c_custkey) OVER (PARTITION BY c_nationkey, lower(c_mktsegment)) AS first_pos, c_nationkey FROM customer QUALIFY pos > first_pos")
def duplicate_ids(spark, sf_dir):
    return R.duplicates(table(spark, sf_dir, "customer"), F.lower("c_mktsegment"), "c_custkey", ["c_nationkey"])


_OLD = "SELECT o_orderkey, sha256(o_orderstatus || '|' || o_orderpriority) AS sha FROM orders WHERE o_orderkey % 10 <> 3"
_NEW = "SELECT o_orderkey, sha256(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END || '|' || o_orderpriority) AS sha FROM orders WHERE o_orderkey % 11 <> 5"


def _snapshots(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    sha = lambda s: F.sha2(F.concat_ws("|", s, "o_orderpriority").cast("binary"), 256).alias("sha")
    return orders.filter("o_orderkey % 10 <> 3").select("o_orderkey", sha(F.col("o_orderstatus"))), orders.filter("o_orderkey % 11 <> 5").select("o_orderkey", sha(F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))))


@catalog.add("snapshot_diff", f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT o_orderkey, CASE WHEN a.sha IS NULL THEN 'added' WHEN b.sha IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (o_orderkey) WHERE a.sha IS DISTINCT FROM b.sha")
def snapshot_diff(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return R.snapshot_diff(old, new, ["o_orderkey"], "sha")


@catalog.add("field_mismatches", "SELECT o_orderkey, array_to_string([x FOR x IN [CASE WHEN o_orderkey % 7 = 0 AND o_orderstatus <> 'X' THEN 'o_orderstatus' END, CASE WHEN o_orderkey % 5 = 0 AND o_orderpriority <> '1-URGENT' THEN 'o_orderpriority' END] IF x IS NOT NULL], ',') AS differ FROM orders WHERE (o_orderkey % 7 = 0 AND o_orderstatus <> 'X') OR (o_orderkey % 5 = 0 AND o_orderpriority <> '1-URGENT')")
def field_mismatches(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    other = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, "1-URGENT").otherwise(F.col("o_orderpriority")))
    return R.mismatches(orders, other, ["o_orderkey"], ["o_orderstatus", "o_orderpriority", "o_custkey"])


@catalog.add(
    "seq_gaps",
    """WITH b AS (SELECT event_id AS s FROM events WHERE event_id % 97 <> 0 UNION ALL SELECT event_id FROM events WHERE event_id % 501 = 2 AND event_id % 97 <> 0),
    c AS (SELECT s, count(*) AS n FROM b GROUP BY s), l AS (SELECT s, n, lag(s) OVER (ORDER BY s) AS p FROM c)
    SELECT p + 1 AS first, s - 1 AS last, 'missing' AS problem FROM l WHERE s - p > 1 UNION ALL SELECT s, s, 'duplicate' FROM c WHERE n > 1""",
)
def seq_gaps(spark, sf_dir):
    kept = table(spark, sf_dir, "events").filter("event_id % 97 <> 0").select("event_id")
    return R.sequence_gaps(kept.unionByName(kept.filter("event_id % 501 = 2")), "event_id")


@catalog.add("turn_gaps", "WITH l AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 3 <> 1)) SELECT conv_id, p + 1 AS first, turn - 1 AS last, 'missing' AS problem FROM l WHERE turn - p > 1 UNION ALL SELECT conv_id, turn, turn, 'duplicate' FROM conversations WHERE turn % 3 <> 1 GROUP BY ALL HAVING count(*) > 1")
def turn_gaps(spark, sf_dir):
    return R.sequence_gaps(table(spark, sf_dir, "conversations").filter("turn % 3 <> 1"), "turn", ["conv_id"])


@catalog.add("numbering", "WITH c AS (SELECT l_orderkey, l_linenumber AS k, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY ALL) SELECT l_orderkey, min(k) <> 1 AS bad_start, count(*) FILTER (n > 1) AS doubled, (max(k) - min(k) + 1 - count(*))::BIGINT AS left_out FROM c GROUP BY l_orderkey")
def numbering(spark, sf_dir):
    return R.numbering_problems(table(spark, sf_dir, "lineitem").filter("l_quantity > 10"), ["l_orderkey"], "l_linenumber")


@catalog.add("numbered_sources", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_linenumber) AS number FROM lineitem")
def numbered_sources(spark, sf_dir):
    return R.numbered(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col("l_shipdate"), F.col("l_partkey"), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", "number")


@catalog.add("alphabet_inversions", "SELECT n_regionkey, pos, key, before FROM (SELECT n_regionkey, n_nationkey AS pos, lower(n_name) AS key, lag(lower(n_name)) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS before FROM nation) WHERE before > key")
def alphabet_inversions(spark, sf_dir):
    return R.inversions(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_nationkey", F.lower("n_name"))


@catalog.add("next_number", "SELECT c_mktsegment, max(regexp_extract(c_name, '(\\d+)$', 1)::BIGINT) + 1 AS next FROM customer GROUP BY c_mktsegment")
def next_number(spark, sf_dir):
    return R.next_number(table(spark, sf_dir, "customer"), ["c_mktsegment"], F.col("c_name"))


@catalog.add("last_records", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def last_records(spark, sf_dir):
    return R.last_rows(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "event_type")


@catalog.add("joined_entries", "WITH r AS (SELECT *, sum(CASE WHEN turn = 0 OR length(text) % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM conversations) SELECT conv_id, min(turn) AS first, string_agg(text, ' ' ORDER BY turn) AS entry FROM r GROUP BY conv_id, run")
def joined_entries(spark, sf_dir):
    return R.joined_lines(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", (F.col("turn") == 0) | (F.length("text") % 3 != 0))


_IDS = """
WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT % 4 AS wanted, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::BIGINT % 4) AS k FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, k, CASE WHEN wanted > 0 THEN wanted ELSE 1 END AS id, [CASE WHEN wanted > 0 THEN wanted ELSE 1 END] AS used FROM l WHERE k = 1
  UNION ALL SELECT l.l_orderkey, l.l_linenumber, l.k, CASE WHEN wanted > 0 AND NOT list_contains(used, wanted) THEN wanted ELSE list_max(used) + 1 END, list_append(used, CASE WHEN wanted > 0 AND NOT list_contains(used, wanted) THEN wanted ELSE list_max(used) + 1 END) FROM r JOIN l ON l.l_orderkey = r.l_orderkey AND l.k = r.k + 1)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, id FROM r
"""


@catalog.add("assigned_ids", _IDS)
def assigned_ids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_quantity").cast("long") % 4).alias("wanted"))
    return R.assigned_ids(lines, ["l_orderkey"], "l_linenumber", "wanted")


@catalog.add("independence", "SELECT user_id, count(DISTINCT event_type) AS gates, count(DISTINCT event_id) AS tasks FROM events GROUP BY user_id HAVING gates > 1 OR tasks > gates")
def independence(spark, sf_dir):
    return R.pairs_not_independent(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@catalog.add("same_person_pairs", "WITH e AS (SELECT DISTINCT user_id, event_type, event_id % 2 AS h FROM events) SELECT DISTINCT a.user_id, a.event_type AS gate, b.event_type AS other_gate FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type <> b.event_type WHERE a.h = 0 AND b.h = 1")
def same_person_pairs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return R.same_person_pairs(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"), "user_id", "event_type")


@catalog.add(
    "newer_snapshots",
    "WITH e AS (SELECT user_id AS g, event_id AS q, sha256(event_type) AS h FROM events) SELECT p.g, p.q, p.h, count(*) FILTER (s.q > p.q AND s.h <> p.h) AS newer FROM e p JOIN e s USING (g) GROUP BY ALL",
)
def newer_snapshots(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), F.col("event_id").alias("q"), F.sha2(F.col("event_type").cast("binary"), 256).alias("h"))
    return R.newer(events, events, ["g"], "q", "h")


_WAVES = "p AS (SELECT user_id AS g, event_id AS pos, event_id + 4000 AS until FROM events), w AS (SELECT user_id AS g, event_id AS planned, CASE WHEN event_id % 3 <> 0 THEN event_id + 500 END AS closed FROM events)"


def _waves(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), "event_id")
    points = events.select("g", F.col("event_id").alias("pos"), (F.col("event_id") + 4000).alias("until"))
    return points, events.select("g", F.col("event_id").alias("planned"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") + 500).alias("closed"))


@catalog.add("waves_since", f"WITH {_WAVES} SELECT g, pos, until, count(*) FILTER (planned >= pos AND closed IS NOT NULL AND closed < until) AS waves FROM p LEFT JOIN w USING (g) GROUP BY ALL")
def waves_since(spark, sf_dir):
    return R.waves_since(*_waves(spark, sf_dir), ["g"], "pos", "planned", "closed", "until")


@catalog.add("waves_from", f"WITH {_WAVES} SELECT g, pos, until, count(*) FILTER (planned >= pos AND closed IS NOT NULL) AS waves FROM p LEFT JOIN w USING (g) GROUP BY ALL")
def waves_from(spark, sf_dir):
    return R.waves_since(*_waves(spark, sf_dir), ["g"], "pos", "planned", "closed")


NEEDED = (("view", 3), ("click", 2), ("purchase", 2), ("refund", 1))


@catalog.add(
    "wave_coverage",
    f"WITH r(event_type, need) AS (VALUES {', '.join(f'{x}' for x in NEEDED)}), h AS (SELECT user_id, event_type, count(DISTINCT event_id % 4) AS have FROM events GROUP BY ALL) SELECT user_id, event_type, need, coalesce(have, 0) AS have FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN r LEFT JOIN h USING (user_id, event_type) WHERE coalesce(have, 0) < need",
)
def wave_coverage(spark, sf_dir):
    done = table(spark, sf_dir, "events").withColumn("replica", F.col("event_id") % 4)
    return R.coverage(done, spark.createDataFrame(NEEDED, "event_type string, need int"), ["user_id"], "event_type", "replica", "need")


@catalog.add(
    "weighted_mode",
    "WITH e AS (SELECT l_suppkey, l_shipmode, sum(l_quantity) AS w, min(l_orderkey * 10 + l_linenumber) AS pos FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem) GROUP BY ALL) SELECT l_suppkey, arg_max(l_shipmode, {'w': w, 'p': -pos}) AS mode, max(w) AS weight, round(max(w) / sum(w), 6) AS share FROM e GROUP BY l_suppkey",
)
def weighted_mode(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("l_shipmode"), "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return R.weighted_mode(lines, ["l_suppkey"], "l_shipmode", F.col("l_quantity"), "pos")


@catalog.add("tolerance_share", "WITH c AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (abs(l_discount - 0.05) <= 0.025) AS within FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, n, within, within / n AS share, CASE WHEN within / n >= 0.5 THEN 'ok' WHEN within / n >= 0.4 THEN 'warning' ELSE 'error' END AS level FROM c")
def tolerance_share(spark, sf_dir):
    return R.tolerance_share(table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.abs(F.col("l_discount") - 0.05) <= 0.025, 0.5, 0.4)


@catalog.add("median_gaps", "WITH g AS (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) SELECT user_id, median(gap) AS median_gap FROM g GROUP BY user_id")
def median_gaps(spark, sf_dir):
    from pyspark.sql import Window

    gaps = table(spark, sf_dir, "events").withColumn("gap", F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")))
    return gaps.groupBy("user_id").agg(F.median("gap").alias("median_gap"))


@catalog.add("status_counts", 'SELECT user_id, count(*) FILTER (event_type = \'view\') AS "view", count(*) FILTER (event_type = \'click\') AS click, count(*) FILTER (event_type = \'purchase\') AS purchase, count(*) FILTER (event_type = \'error\') AS error FROM events GROUP BY user_id')
def status_counts(spark, sf_dir):
    return R.counts_by_status(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["view", "click", "purchase", "error"])


@catalog.add("top_values", "SELECT c_nationkey, c_mktsegment, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS rank FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)) WHERE rank <= 3")
def top_values(spark, sf_dir):
    return R.top_k(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", 3)


@catalog.add("seeded_sample")
def seeded_sample(spark, sf_dir):
    paras = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.paragraphs(F.col("text"))).alias("pos", "paragraph"))
    return R.seeded_sample(paras, ["doc_id"], "pos", 5, 42)


@catalog.add("override_union", "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 3 = 1 THEN 'old' ELSE 'new' END AS origin FROM orders")
def override_union(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return R.override_union(orders.filter("o_orderkey % 3 <> 2").withColumn("origin", F.lit("old")), orders.filter("o_orderkey % 3 <> 1").withColumn("origin", F.lit("new")), on=["o_orderkey"])


@catalog.add("filled_forward", "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter FROM events")
def filled_forward(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return R.filled_forward(events, ["user_id"], "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")), "chapter").drop("event_type")


@catalog.add("set_algebra", "WITH g AS (SELECT l_orderkey, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'N') AS a, list(DISTINCT l_suppkey) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, len([x FOR x IN coalesce(a, []) IF NOT list_contains(coalesce(b, []), x)]) AS only_first, len([x FOR x IN coalesce(b, []) IF list_contains(coalesce(a, []), x)]) AS in_both, len([x FOR x IN coalesce(b, []) IF NOT list_contains(coalesce(a, []), x)]) = 0 AS subset FROM g")
def set_algebra(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_suppkey"))).alias("a"), F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_suppkey"))).alias("b"))
    return g.select("l_orderkey", F.size(F.array_except("a", "b")).cast("long").alias("only_first"), F.size(F.array_intersect("a", "b")).cast("long").alias("in_both"), (F.size(F.array_except("b", "a")) == 0).alias("subset"))


@catalog.add(
    "text_forms",
    r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'))::INT AS words, CASE WHEN length(text) <= 40 THEN text ELSE rtrim(substring(text, 1, 39), ' ') || '…' END AS short, trim(regexp_replace(lower(source || ' ' || lang || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug, doc_id % 3 = 1 AS is_url,
    CASE WHEN doc_id % 70 BETWEEN 1 AND 60 THEN repeat('L', (doc_id % 70 // 50)::INT) || ['', 'X', 'XX', 'XXX', 'XL'][doc_id % 70 % 50 // 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][doc_id % 10 + 1] END AS roman, doc_id % 2 = 0 AS dated, sha256(coalesce(text, '')) AS sha FROM documents""",
)
def text_forms(spark, sf_dir):
    n = F.col("doc_id")
    url = F.when(n % 3 == 0, "ftp://x.org").when(n % 3 == 1, "HTTPS://x.org/a?b").otherwise("https://x y")
    date = F.when(n % 2 == 0, "01.02.2024").otherwise("1.2.2024")
    return table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("words"), X.truncate(F.col("text"), 40).alias("short"), X.slug(F.concat("source", F.lit(" "), "lang", F.lit("!"))).alias("slug"), X.is_url(url).alias("is_url"), X.to_roman(n % 70).alias("roman"), X.is_dotted_date(date).alias("dated"), X.sha256_text(F.col("text")).alias("sha"))


@catalog.add(
    "review_forms",
    """SELECT event_id, list_concat(['a', 'b', 'c', 'd'][event_id % 9 % 4 + 1:], ['a', 'b', 'c', 'd'][:event_id % 9 % 4]) AS parts, CASE WHEN event_type = 'click' AND event_id % 3 < 2 THEN 'fail' WHEN event_type = 'click' THEN 'pass' ELSE event_type END AS status, CASE WHEN event_id % 5 = 0 THEN 'recovery_required' WHEN event_id % 4 = 0 THEN 'needs_rebaseline' WHEN event_id % 3 = 0 THEN 'external_changes' ELSE 'ok' END AS memory,
    coalesce(CASE WHEN event_id % 3 <> 0 THEN event_type END, '') <> 'view' AS stale, event_id % 4 IN (0, 1, 2) AS forbidden FROM events""",
)
def review_forms(spark, sf_dir):
    n, kind = F.col("event_id"), F.col("event_type")
    severities = F.array(F.lit("INFO"), F.element_at(F.array(*[F.lit(s) for s in ("BLOCKER", "MAJOR", "MINOR")]), (n % 3 + 1).cast("int")))
    name = F.element_at(F.array(*[F.lit(s) for s in ("checkGhostText2", "ghost_a", "G-h-o-s-t", "aghost")]), (n % 4 + 1).cast("int"))
    flag = lambda k: F.when(n % k == 0, 1).otherwise(0)
    return table(spark, sf_dir, "events").select(
        "event_id",
        A.review_order(F.array(*[F.lit(x) for x in "abcd"]), (n % 9).cast("int")).alias("parts"),
        A.stored_status(F.when(kind == "click", "pass").otherwise(kind), severities).alias("status"),
        A.memory_status(flag(3), flag(4), F.lit(0), flag(5)).alias("memory"),
        A.verification_stale(F.when(n % 3 != 0, kind), F.lit("view")).alias("stale"),
        A.forbidden_identifier(name, ["ghost"]).alias("forbidden"),
    )


@catalog.add("new_snapshots", "SELECT o_orderkey, sha256(o_orderpriority || o_orderkey) AS snapshot_sha FROM orders WHERE o_orderkey % 4 IN (0, 3)")
def new_snapshots(spark, sf_dir):
    found = table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).cast("binary"), 256).alias("snapshot_sha"))
    return A.snapshots_to_add(found.filter("o_orderkey % 4 <> 1"), found.filter("o_orderkey % 4 in (1, 2)"))


@catalog.add(
    "run_blocking",
    """WITH t AS (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS s, max(l_partkey) AS p FROM lineitem GROUP BY ALL), g AS (SELECT l_orderkey, count(*) FILTER (s % 3 = 0 AND s % 5 <> 0) AS pending FROM t GROUP BY l_orderkey),
    f AS (SELECT l_orderkey, unnest([p % 200, p % 77]) AS finding_id FROM t), o AS (SELECT l_orderkey, count(*) AS unclosed, count(*) FILTER (s_suppkey % 4 < 2) AS open_high FROM f JOIN supplier ON s_suppkey = finding_id AND s_suppkey % 3 <> 0 GROUP BY l_orderkey)
    SELECT l_orderkey, pending, coalesce(unclosed, 0) AS unclosed, coalesce(open_high, 0) AS open_high FROM g LEFT JOIN o USING (l_orderkey)""",
)
def run_blocking(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("task_id")).agg(F.max("l_suppkey").alias("s"), F.max("l_partkey").alias("p"))
    tasks = lines.select("l_orderkey", "task_id", F.when(F.col("s") % 3 == 0, 0).otherwise(1).alias("attempts"), F.when(F.col("s") % 5 == 0, "cancelled").otherwise("planned").alias("status"), F.array(F.col("p") % 200, F.col("p") % 77).alias("finding_ids"))
    registry = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("finding_id"), F.when(F.col("s_suppkey") % 3 == 0, "resolved").otherwise("open").alias("status"), F.element_at(F.array(*[F.lit(s) for s in A.SEVERITIES]), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("severity"))
    return A.blocking(tasks, registry, ["l_orderkey"])
