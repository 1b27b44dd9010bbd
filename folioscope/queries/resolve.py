"""Rules of precedence over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import audit as A
from folioscope.operators import resolve as R
from folioscope.queries.common import Catalog, table

catalog = Catalog()

_PRESETS = list(A.MATRIX)


def _pick(xs, k):
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))


def _sql_value(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()


_POLICY = ", ".join(f"({', '.join(map(_sql_value, row))})" for row in R.NOT_APPLICABLE)
_KEYS = ("gate", "preset", "type", "has_docx", "has_product")


def _by_policy_sql(rows: str, policy: str, keys, decision: str, id_cols: str) -> str:
    """Each row against all rows of the policy that fit, ranked by how many keys these give."""
    fits = " AND ".join(f"(p.{k} IS NULL OR p.{k} = r.{k})" for k in keys)
    given = " + ".join(f"(p.{k} IS NOT NULL)::INT" for k in keys)
    return f"""m AS (SELECT r.*, p.{decision} AS d, {given} AS s FROM {rows} AS r LEFT JOIN {policy} AS p ON {fits}),
    b AS (SELECT *, max(s) OVER (PARTITION BY {id_cols}) AS most FROM m)
    SELECT {id_cols}, min(d) AS {decision}, CASE WHEN min(d) IS NOT NULL THEN min(most)::INT END AS specificity, coalesce(min(d) <> max(d), false) AS conflict FROM b WHERE s = most OR d IS NULL GROUP BY {id_cols}"""


@catalog.add(
    "policy_decisions",
    f"""WITH p(gate, preset, type, has_docx, has_product, allowed) AS (VALUES {_POLICY}),
    r AS (SELECT event_id, {list(A.GATES)}[user_id % 9 + 1] AS gate, {_PRESETS}[event_id % {len(_PRESETS)} + 1] AS preset, CASE WHEN event_id % 7 < 3 THEN 'regular' WHEN event_id % 7 < 6 THEN 'project' END AS type, event_id % 2 = 0 AS has_docx, event_id % 5 = 0 AS has_product FROM events),
    {_by_policy_sql("r", "p", _KEYS, "allowed", "event_id")}""",
)
def policy_decisions(spark, sf_dir):
    n = F.col("event_id")
    kind = F.when(n % 7 < 3, "regular").when(n % 7 < 6, "project")
    rows = table(spark, sf_dir, "events").select(n, _pick(A.GATES, F.col("user_id")).alias("gate"), _pick(_PRESETS, n).alias("preset"), kind.alias("type"), (n % 2 == 0).alias("has_docx"), (n % 5 == 0).alias("has_product"))
    policy = spark.createDataFrame(list(R.NOT_APPLICABLE), R.NOT_APPLICABLE_COLUMNS)
    return R.by_policy(rows, policy, _KEYS, "allowed").drop(*_KEYS)


@catalog.add(
    "policy_conflicts",
    f"""WITH p AS (SELECT CASE WHEN ps_suppkey % 3 <> 0 THEN 'Brand#' || (ps_suppkey % 5 + 1) || (ps_suppkey % 4 + 1) END AS brand, CASE WHEN ps_suppkey % 2 = 0 THEN ps_suppkey % 50 + 1 END AS size, ['PROMO', 'ECONOMY', 'STANDARD'][ps_suppkey % 4 + 1] AS container, ps_suppkey % 6 AS grade FROM (SELECT s_suppkey AS ps_suppkey FROM supplier)),
    r AS (SELECT p_partkey, p_brand AS brand, p_size AS size, split_part(p_type, ' ', 1) AS container FROM part),
    {_by_policy_sql("r", "p", ("brand", "size", "container"), "grade", "p_partkey")}""",
)
def policy_conflicts(spark, sf_dir):
    s = F.col("s_suppkey")
    brand = F.when(s % 3 != 0, F.concat(F.lit("Brand#"), (s % 5 + 1).cast("string"), (s % 4 + 1).cast("string")))
    policy = table(spark, sf_dir, "supplier").select(brand.alias("brand"), F.when(s % 2 == 0, s % 50 + 1).alias("size"), F.get(F.array(*[F.lit(x) for x in ("PROMO", "ECONOMY", "STANDARD")]), (s % 4).cast("int")).alias("container"), (s % 6).alias("grade"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("container"))
    return R.by_policy(rows, policy, ("brand", "size", "container"), "grade").drop("brand", "size", "container")


_PLAIN = r"lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"


@catalog.add(
    "page_records",
    rf"""WITH d AS (SELECT doc_id, sha256({_PLAIN}) AS print, sha256(coalesce(text, '')) AS sha, n_chars FROM documents),
    r AS (SELECT 'rec-' || doc_id AS record_id, CASE WHEN doc_id % 3 <> 0 THEN print END AS print, CASE WHEN doc_id % 4 <> 0 THEN sha END AS sha FROM d),
    p AS (SELECT print, min(record_id) AS record_id FROM r WHERE print IS NOT NULL GROUP BY print), s AS (SELECT sha, min(record_id) AS record_id FROM r WHERE sha IS NOT NULL GROUP BY sha)
    SELECT doc_id, coalesce(p.record_id, s.record_id) AS record_id, CASE WHEN p.record_id IS NOT NULL THEN 'fingerprint' WHEN s.record_id IS NOT NULL THEN 'hash' END AS source FROM d LEFT JOIN p USING (print) LEFT JOIN s USING (sha)""",
)
def page_records(spark, sf_dir):
    """Documents against records of which some have a fingerprint of the text, some a hash of the bytes, some both."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))).cast("binary"), 256).alias("print"), F.sha2(text.cast("binary"), 256).alias("sha"))
    records = docs.select(F.concat(F.lit("rec-"), F.col("doc_id").cast("string")).alias("record_id"), F.when(F.col("doc_id") % 3 != 0, F.col("print")).alias("print"), F.when(F.col("doc_id") % 4 != 0, F.col("sha")).alias("sha"))
    return R.by_ranked_keys(docs, records, "doc_id", "record_id", [("fingerprint", F.col("print"), F.col("print")), ("hash", F.col("sha"), F.col("sha"))])


_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@catalog.add(
    "nearest_config",
    r"""WITH u AS (SELECT page_id, rtrim(""" + _PATH + r""", '/') AS path FROM pages),
    c AS (SELECT CASE page_id % 4 WHEN 0 THEN path WHEN 1 THEN regexp_replace(path, '/[^/]*$', '') ELSE split_part(path, '/', 1) END AS place, page_id, page_id % 3 AS level FROM u WHERE page_id % 4 <> 3),
    b AS (SELECT place, min({'p': page_id, 'l': level}) AS v FROM (SELECT place, page_id, level FROM c) GROUP BY place),
    m AS (SELECT DISTINCT u.path, b.place, b.v FROM (SELECT DISTINCT path FROM u) AS u LEFT JOIN b ON u.path = b.place OR starts_with(u.path, b.place || '/'))
    SELECT path, place AS config, v.p AS page_id, v.l AS level FROM m QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(place) DESC NULLS LAST) = 1""",
)
def nearest_config(spark, sf_dir):
    """Every page's path with the nearest configuration; three of four pages bring one for their place, their folder or their host."""
    path = F.rtrim(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), F.lit("/"))
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    n = F.col("page_id") % 4
    at = F.when(n == 0, F.col("path")).when(n == 1, F.regexp_replace("path", "/[^/]*$", "")).when(n == 2, F.split_part("path", F.lit("/"), F.lit(1)))
    configs = pages.select(at.alias("config"), "page_id", (F.col("page_id") % 3).alias("level"))
    return R.nearest(pages, configs, "path", "config", ["page_id", "level"])


_OLD = "SELECT l_orderkey, l_linenumber AS number, 'S' || l_linenumber || '-' || l_partkey AS source FROM lineitem"
_NEW = """SELECT l_orderkey, source, unnest(CASE l_orderkey % 6
    WHEN 0 THEN [number] WHEN 1 THEN [CASE number WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE number END] WHEN 2 THEN [number + 1] WHEN 3 THEN CASE WHEN number = 1 THEN [1, 9] ELSE [number] END
    WHEN 4 THEN [CASE WHEN number <= 2 THEN 1 ELSE number END] ELSE CASE WHEN number = 1 THEN [] ELSE [number - 1] END END) AS number FROM old
    UNION ALL SELECT l_orderkey, 'new' AS source, 20 AS number FROM old WHERE l_orderkey % 6 = 0 AND number = 1"""


def _registries(spark, sf_dir):
    """The order lines as numbered lists, and as they are after their works were renumbered in one of six ways."""
    key, n = F.col("l_orderkey") % 6, F.col("l_linenumber")
    old = table(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("number"), F.concat(F.lit("S"), n.cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("source"))
    n = F.col("number")
    places = (
        F.when(key == 0, F.array(n)).when(key == 1, F.array(F.when(n == 1, 2).when(n == 2, 1).otherwise(n))).when(key == 2, F.array(n + 1))
        .when(key == 3, F.when(n == 1, F.array(F.lit(1), F.lit(9))).otherwise(F.array(n))).when(key == 4, F.array(F.when(n <= 2, 1).otherwise(n)))
        .otherwise(F.when(n == 1, F.array().cast("array<int>")).otherwise(F.array(n - 1)))
    )
    new = old.select("l_orderkey", "source", F.explode(places.cast("array<int>")).alias("number"))
    return old, new.unionByName(old.filter((key == 0) & (n == 1)).select("l_orderkey", F.lit("new").alias("source"), F.lit(20).alias("number")))


@catalog.add(
    "renumbered",
    f"""WITH old AS ({_OLD}), new AS ({_NEW}), o AS (SELECT l_orderkey, source, min(number) AS old FROM old GROUP BY ALL), n AS (SELECT l_orderkey, source, min(number) AS new, count(DISTINCT number) AS k FROM new GROUP BY ALL),
    s AS (SELECT l_orderkey, number AS new FROM new GROUP BY ALL HAVING count(DISTINCT source) > 1), h AS (SELECT l_orderkey, number AS new, min(source) AS holder FROM old GROUP BY ALL)
    SELECT l_orderkey, source, CASE WHEN o.old IS NULL THEN 'added' WHEN n.new IS NULL THEN 'removed' WHEN n.k > 1 THEN 'split' WHEN s.new IS NOT NULL THEN 'merged' WHEN o.old = n.new THEN 'kept' WHEN t.new = o.old THEN 'swapped' ELSE 'moved' END AS status, o.old, n.new
    FROM o FULL JOIN n USING (l_orderkey, source) LEFT JOIN s USING (l_orderkey, new) LEFT JOIN h USING (l_orderkey, new) LEFT JOIN n AS t ON t.l_orderkey = l_orderkey AND t.source = h.holder""".replace("LEFT JOIN n AS t ON t.l_orderkey = l_orderkey AND", "LEFT JOIN n AS t ON t.l_orderkey = h.l_orderkey AND"),
)
def renumbered(spark, sf_dir):
    old, new = _registries(spark, sf_dir)
    return R.renumbered(old, new, ["l_orderkey"], "number", "source")


_ENTRIES = """e AS (SELECT l_orderkey, CASE WHEN l_orderkey % 4 = 1 AND l_linenumber = 2 THEN 1 ELSE l_linenumber END AS number, 'S' || CASE WHEN l_orderkey % 4 = 2 AND l_linenumber = 1 THEN 2 ELSE l_linenumber END AS source, CASE WHEN l_orderkey % 4 = 3 AND l_linenumber = 3 THEN 'other text' ELSE 'Record ' || l_partkey END AS text FROM lineitem),
    r AS (SELECT l_orderkey, 'S' || l_linenumber AS source, 'Record ' || l_partkey AS text FROM lineitem WHERE NOT (l_orderkey % 4 = 0 AND l_linenumber = 4))"""


@catalog.add(
    "map_problems",
    f"""WITH {_ENTRIES}, o AS (SELECT l_orderkey, source, min(text) AS now FROM r GROUP BY ALL), t AS (SELECT DISTINCT l_orderkey, text FROM r), k AS (SELECT l_orderkey, number FROM e GROUP BY ALL HAVING count(*) > 1)
    SELECT l_orderkey, number, source, unnest([x FOR x IN [CASE WHEN k.number IS NOT NULL THEN 'doubled' END, CASE WHEN now IS NULL THEN 'unknown' WHEN text <> now AND t.text IS NOT NULL THEN 'foreign' WHEN text <> now THEN 'changed' END] IF x IS NOT NULL]) AS problem
    FROM e LEFT JOIN o USING (l_orderkey, source) LEFT JOIN t USING (l_orderkey, text) LEFT JOIN k USING (l_orderkey, number)""",
)
def map_problems(spark, sf_dir):
    """Built lists against their registries; in one of four works each, a number is doubled, tied to another source, an entry is changed, or a source is gone."""
    key, n = F.col("l_orderkey") % 4, F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("Record "), F.col("l_partkey").cast("string"))
    name = lambda c: F.concat(F.lit("S"), c.cast("string"))
    entries = lines.select("l_orderkey", F.when((key == 1) & (n == 2), 1).otherwise(n).alias("number"), name(F.when((key == 2) & (n == 1), 2).otherwise(n)).alias("source"), F.when((key == 3) & (n == 3), "other text").otherwise(text).alias("text"))
    registry = lines.filter(~((key == 0) & (n == 4))).select("l_orderkey", name(n).alias("source"), text.alias("text"))
    return R.map_problems(entries, registry, ["l_orderkey"], "number", "source", "text")


_CHAIN = """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    c AS (SELECT user_id, event_id, k, ''::VARCHAR AS p, sha256('|' || h) AS sha FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, c.sha, sha256(c.sha || '|' || e.h) FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1),
    t AS (SELECT user_id, event_id, CASE WHEN event_id % 97 = 1 THEN 'f' || substr(sha, 2) ELSE sha END AS sha, CASE WHEN event_id % 101 = 2 THEN lag(p) OVER w WHEN event_id % 103 = 3 THEN '' ELSE p END AS p, CASE WHEN event_id % 89 = 4 THEN sha256('else') ELSE h END AS h FROM c JOIN e USING (user_id, event_id) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    g AS (SELECT user_id, event_id, sha, nullif(p, '') AS p, sha = sha256(coalesce(p, '') || '|' || h) AS own FROM t WHERE event_id % 83 <> 5),
    f AS (SELECT user_id, p, min(event_id) AS first FROM g GROUP BY user_id, p HAVING count(*) > 1),
    b AS (SELECT g.user_id, g.event_id, unnest([x FOR x IN [CASE WHEN NOT own THEN 'tampered' END, CASE WHEN g.p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM g AS o WHERE o.user_id = g.user_id AND o.sha = g.p) THEN 'orphan' END, CASE WHEN g.event_id > f.first THEN CASE WHEN g.p IS NULL THEN 'beginning' ELSE 'fork' END END] IF x IS NOT NULL]) AS problem
      FROM g LEFT JOIN f ON f.user_id = g.user_id AND f.p IS NOT DISTINCT FROM g.p)
"""


@catalog.add("chain_problems", _CHAIN + "SELECT user_id, event_id, problem, event_id = min(event_id) OVER (PARTITION BY user_id) AS first FROM b")
def chain_problems(spark, sf_dir):
    """Chains of all events, with hashes and links changed, and records deleted, by rules on their ids."""
    n = F.col("event_id")
    both = A.chained_ids(table(spark, sf_dir, "events"), ["user_id"], "event_id", ["event_type", "user_id"], digest="content")
    both = both.withColumn("content", F.when(n % 89 == 4, F.sha2(F.lit("else").cast("binary"), 256)).otherwise(F.col("content")))
    back = F.lag("previous_sha").over(A.Window.partitionBy("user_id").orderBy("event_id"))
    tampered = both.select("user_id", n, F.when(n % 97 == 1, F.concat(F.lit("f"), F.substring("event_sha", 2, 63))).otherwise(F.col("event_sha")).alias("sha"), F.when(n % 101 == 2, back).when(n % 103 == 3, "").otherwise(F.col("previous_sha")).alias("previous"), "content")
    return R.chain_problems(tampered.filter(n % 83 != 5), ["user_id"], "event_id", "sha", "previous", F.col("content"))


@catalog.add(
    "manifest_kinds",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'native' WHEN event_type IN ('error', 'signup') AND event_id % 4 < 2 THEN 'tampered' ELSE 'legacy' END AS kind FROM events",
)
def manifest_kinds(spark, sf_dir):
    n = F.col("event_id")
    schema = F.when(n % 3 == 0, "audit-manifest").when(n % 3 == 1, "older")
    seq = F.when(F.col("event_type").isin("error", "signup") & (n % 4 == 0), n)
    sha = F.when(F.col("event_type").isin("error", "signup") & (n % 4 == 1), "sha")
    return table(spark, sf_dir, "events").select("event_id", R.manifest_kind(F.coalesce(schema, F.lit("")), seq.isNotNull() | sha.isNotNull(), "audit-manifest").alias("kind"))
