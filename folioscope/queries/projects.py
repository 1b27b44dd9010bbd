"""Projects, builds, merges and drafts on tables made from the driver's."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import doctor as H
from folioscope.operators import merge
from folioscope.operators.deal import dealt
from folioscope.plans import api
from folioscope.queries.common import Catalog, table
from folioscope.sources import files
from folioscope.sources.markdown import md_blocks

catalog = Catalog()


@catalog.add("doctor_structure", "WITH w(path) AS (VALUES ('1'), ('2'), ('3'), ('4')) SELECT DISTINCT o_orderkey AS project_id, 'STRUCTURE_MISSING' AS code, 'ERROR' AS severity, path FROM orders CROSS JOIN w WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber::VARCHAR = path)")
def doctor_structure(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").cast("string").alias("path")).distinct()
    return H.absent(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id")), have, ["1", "2", "3", "4"])


@catalog.add("doctor_memory", "WITH a AS (SELECT o_custkey AS project_id, o_orderkey::VARCHAR AS path, o_orderstatus AS sha256 FROM orders WHERE o_orderkey % 4 <> 0), b AS (SELECT o_custkey AS project_id, o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS sha256 FROM orders WHERE o_orderkey % 6 <> 1) SELECT project_id, path, CASE WHEN b.sha256 IS NULL THEN 'MEMORY_MISSING' WHEN a.sha256 IS NULL THEN 'MEMORY_UNTRACKED' ELSE 'MEMORY_CHANGED' END AS code, CASE WHEN b.sha256 IS NULL THEN 'ERROR' ELSE 'WARNING' END AS severity FROM a FULL JOIN b USING (project_id, path) WHERE a.sha256 IS DISTINCT FROM b.sha256")
def doctor_memory(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("sha256"))
    new = o.filter("k % 6 <> 1").withColumn("sha256", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("sha256")))
    return H.memory(o.filter("k % 4 <> 0").drop("k"), new.drop("k"))


@catalog.add("doctor_drafts", r"SELECT doc_id AS project_id, 'DRAFT_EMPTY' AS code, CASE WHEN doc_id % 3 = 0 THEN 'INFO' ELSE 'ERROR' END AS severity, source AS path FROM documents WHERE length(regexp_replace(regexp_replace(coalesce(text, ''), '(^|\n)\s*(?:#{1,6}\s[^\n]*|[-*+]\s+|\d+[.)]\s+)', '\1', 'g'), '[^\p{L}\p{N}]', '', 'g')) < 300")
def doctor_drafts(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("project_id"), F.col("source").alias("path"), "text")
    return H.drafts(texts, F.when(F.col("project_id") % 3 == 0, "draft").otherwise("final"))


@catalog.add("jsonl_lines", "SELECT event_id, event_id % 7 = 0 AS bad, CASE WHEN event_id % 7 <> 0 THEN (props->>'k')::BIGINT END AS k FROM events")
def jsonl_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{bad "), "props")).otherwise(F.col("props")).alias("line"))
    return files.parsed_lines(lines, "line", "k bigint").select("event_id", F.col("error").isNotNull().alias("bad"), F.col("value.k").alias("k"))


def _drafts(spark, sf_dir):
    docs = dealt(table(spark, sf_dir, "documents"))
    text = F.concat(F.lit("# Title\n\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")), F.lit("\n\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"))
    return docs.select("doc_id", text.alias("text"))


@catalog.add("markdown_blocks")
def markdown_blocks(spark, sf_dir):
    return md_blocks(_drafts(spark, sf_dir), "doc_id").select("doc_id", "idx", "kind", "level", "text", "first_line", "end_line", "problem")


@catalog.add("bag_diff", "WITH a AS (SELECT conv_id, sha256(role || '|' || text) AS sig FROM conversations WHERE turn % 5 <> 2), b AS (SELECT conv_id, sha256(role || '|' || text) AS sig FROM conversations WHERE turn % 4 <> 3) SELECT conv_id, sig, 'old' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT conv_id, sig, 'new' FROM (FROM b EXCEPT ALL FROM a)")
def bag_diff(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws("|", "role", "text").cast("binary"), 256).alias("sig"))
    return merge.bag_diff(c.filter("turn % 5 <> 2"), c.filter("turn % 4 <> 3"), "conv_id")


@catalog.add("sequence_diff")
def sequence_diff(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", merge.signature(F.col("role"), F.col("text")).alias("sig"))
    return merge.sequence_diff(c.filter("turn % 5 <> 2"), c.filter("turn % 4 <> 3"), "conv_id", "turn")


@catalog.add("merged_drafts")
def merged_drafts(spark, sf_dir):
    d = _drafts(spark, sf_dir).select("doc_id", F.col("text").alias("old"), F.regexp_replace("text", "Title", "New title").alias("new"))
    return merge.merge_drafts(d, "doc_id")


def _work(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    texts = suppliers.select("s_nationkey", "s_suppkey", F.concat(F.lit("See [@s"), k, F.lit("] and [@s"), (F.col("s_suppkey") + 1).cast("string"), F.lit("].")).alias("text"))
    registry = suppliers.filter("s_suppkey % 5 <> 0").select("s_nationkey", F.concat(F.lit("s"), k).alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "verified").otherwise("pending").alias("status"), F.lit("book").alias("type"), F.col("s_name").alias("title"), F.lit("London").alias("place"), F.lit("X").alias("publisher"), F.lit("2001").alias("year"), F.lit("en").alias("language"))
    return api.build(texts, registry, "s_nationkey", "s_suppkey")


@catalog.add(
    "build_violations",
    """WITH r AS (SELECT s_nationkey, s_suppkey AS k FROM supplier UNION SELECT s_nationkey, s_suppkey + 1 FROM supplier), g AS (SELECT s_nationkey, s_suppkey AS k FROM supplier WHERE s_suppkey % 5 <> 0)
    SELECT s_nationkey, '@s' || k AS ref, 'error' AS level, 'no source' AS problem FROM r WHERE (s_nationkey, k) NOT IN (SELECT (s_nationkey, k) FROM g) UNION ALL SELECT s_nationkey, '@s' || k, 'warning', 'not confirmed' FROM g WHERE k % 3 <> 0""",
)
def build_violations(spark, sf_dir):
    return _work(spark, sf_dir)["violations"]


@catalog.add(
    "build_texts",
    """WITH n AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS number FROM supplier WHERE s_suppkey % 5 <> 0)
    SELECT s.s_nationkey, s.s_suppkey, 'See ' || coalesce('[' || a.number || ']', '[@s' || s.s_suppkey || ']') || ' and ' || coalesce('[' || b.number || ']', '[@s' || (s.s_suppkey + 1) || ']') || '.' AS rewritten FROM supplier s LEFT JOIN n a ON a.s_nationkey = s.s_nationkey AND a.s_suppkey = s.s_suppkey LEFT JOIN n b ON b.s_nationkey = s.s_nationkey AND b.s_suppkey = s.s_suppkey + 1""",
)
def build_texts(spark, sf_dir):
    return _work(spark, sf_dir)["texts"]


@catalog.add("all_metrics")
def all_metrics(spark, sf_dir):
    m = api.metrics(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return m.select("doc_id", *[F.col(f"{c}.verdict").alias(c) for c in ("burstiness", "phrases", "lexical", "rhythm", "starters", "passive", "readability", "anchors", "pronouns")])
