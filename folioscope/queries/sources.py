"""Registries and settings written as text and read back, records of mixed versions, and the choice among lists of references."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import migrate as M
from folioscope.operators import segments as S
from folioscope.queries.audit import _BLOCKS, work_blocks
from folioscope.queries.common import Catalog, table
from folioscope.sources import profiles as P
from folioscope.sources import yaml as Y

catalog = Catalog()


def _text(*parts):
    return F.concat(*[F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts])


def _yaml(spark, sf_dir):
    """All orders as YAML: quotes, comments, nesting, inline lists, lists at their key's own indent."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        _text(
            "# order ", "$o_orderkey", "\nsources:\n  - id: ", "$o_orderkey", '\n    title: "Order #', "$o_orderkey", ', first"   # a comment, with "quotes"\n    meta:\n      status: \'', "$o_orderstatus", "'\n\n      date: ", "$o_orderdate", "\n    tags: [", "$o_orderpriority",
            ', "a, ', "$o_custkey", "\", 'b # c', plain#d]\n  -   id: second\n      url: http://x.example/", "$o_custkey", "#top\nowner:\n- customer ", "$o_custkey", "  # one\n- \"it's: ", "$o_custkey", '"\nempty:\nnote: ends "here, # and on\n',
        ).alias("yaml"),
    )


_LEAVES = (
    ("sources[0].id", "o_orderkey::VARCHAR"),
    ("sources[0].title", "'Order #' || o_orderkey || ', first'"),
    ("sources[0].meta.status", "o_orderstatus"),
    ("sources[0].meta.date", "o_orderdate::VARCHAR"),
    ("sources[0].tags[0]", "o_orderpriority"),
    ("sources[0].tags[1]", "'a, ' || o_custkey"),
    ("sources[0].tags[2]", "'b # c'"),
    ("sources[0].tags[3]", "'plain#d'"),
    ("sources[1].id", "'second'"),
    ("sources[1].url", "'http://x.example/' || o_custkey || '#top'"),
    ("owner[0]", "'customer ' || o_custkey"),
    ("owner[1]", "'it''s: ' || o_custkey"),
    ("note", "'ends \"here, # and on'"),
)


@catalog.add("yaml_values", "SELECT o_orderkey, unnest([" + ", ".join(f"'{p}'" for p, _ in _LEAVES) + "]) AS path, unnest([" + ", ".join(v for _, v in _LEAVES) + "]) AS value FROM orders")
def yaml_values(spark, sf_dir):
    return Y.values(_yaml(spark, sf_dir), ["o_orderkey"], "yaml").select("o_orderkey", "path", "value")


@catalog.add(
    "yaml_records",
    "SELECT o_orderkey, 0 AS number, o_orderkey::VARCHAR AS id, 'Order #' || o_orderkey || ', first' AS title, o_orderstatus AS meta_status, NULL AS url FROM orders UNION ALL SELECT o_orderkey, 1, 'second', NULL, NULL, 'http://x.example/' || o_custkey || '#top' FROM orders",
)
def yaml_records(spark, sf_dir):
    found = Y.values(_yaml(spark, sf_dir), ["o_orderkey"], "yaml")
    return Y.records(found, ["o_orderkey"], "sources", ["id", "title", "meta.status", "url"])


@catalog.add(
    "yaml_allowlist",
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents),
    p AS (SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN [w[1] || ' ' || w[2], w[3] || ', ' || w[4], w[5] || ' # ' || w[6]] WHEN 1 THEN [w[1] || '  ' || w[2], w[3]] WHEN 2 THEN [w[1] || ' ' || w[2]] ELSE [] END) AS p FROM w WHERE len(w) >= 6)
    SELECT DISTINCT doc_id, lower(trim(regexp_replace(p, '\\s+', ' ', 'g'))) AS phrase FROM p""",
)
def yaml_allowlist(spark, sf_dir):
    """Settings of all documents of six words or more, in one of four forms, with phrases out of their own words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")).filter("size(w) >= 6")
    for i in range(6):
        docs = docs.withColumn(f"w{i}", F.get("w", F.lit(i)))
    n = F.col("doc_id") % 4
    form = (
        F.when(n == 0, _text('cliche_allowlist: ["', "$w0", " ", "$w1", "\", '", "$w2", ", ", "$w3", "', \"", "$w4", " # ", "$w5", '"] # three\n'))
        .when(n == 1, _text("cliche_allowlist:\n# none yet\n- '", "$w0", "  ", "$w1", "'\n\n- ", "$w2", " # why\n"))
        .when(n == 2, _text("cliche_allowlist:   ", "$w0", " ", "$w1", "\n"))
        .otherwise(_text("# cliche_allowlist: [", "$w0", "]\ncliche_allowlist: ~\n"))
    )
    texts = docs.select("doc_id", F.concat(F.lit("style: 1\n"), form, F.lit("other:\n  - x\n")).alias("yaml"))
    return Y.allowlist(Y.values(texts, ["doc_id"], "yaml"), ["doc_id"], "cliche_allowlist")


def _second(record):
    return F.concat(F.lit('{"version":2,"key":'), F.expr("try_variant_get(record, '$.k', 'string')"), F.lit("}"))


def _third(record):
    key = F.expr("try_variant_get(record, '$.key', 'bigint')")
    return F.concat(F.lit('{"version":3,"key":'), key.cast("string"), F.lit(',"band":"'), F.floor(key / 10).cast("string"), F.lit('x"}'))


@catalog.add(
    "migrated_records",
    """WITH e AS (SELECT event_id, regexp_extract(props, '[0-9]+') AS k FROM events),
    p AS (SELECT event_id, k, CASE WHEN event_id % 50 = 7 THEN '{"k": ' WHEN event_id % 50 = 8 THEN '{"version":9,"key":1}' WHEN event_id % 50 = 9 THEN '{"other":1}' WHEN event_id % 50 = 10 THEN '[1]' WHEN event_id % 3 = 0 THEN '{"k": ' || k || '}' WHEN event_id % 3 = 1 THEN '{"key":' || k || ',"version":2}' ELSE '{"band":"' || k::BIGINT // 10 || 'x","key":' || k || ',"version":3}' END AS payload,
      CASE WHEN event_id % 50 IN (7, 10) THEN NULL WHEN event_id % 50 = 8 THEN 9 WHEN event_id % 50 = 9 THEN 1 ELSE event_id % 3 + 1 END::INT AS from_version,
      CASE WHEN event_id % 50 IN (7, 10) THEN 'unreadable' WHEN event_id % 50 = 8 THEN 'unknown version' WHEN event_id % 50 = 9 THEN 'not version 1' END AS problem FROM e)
    SELECT event_id, from_version, CASE WHEN problem IS NULL THEN '{"band":"' || k::BIGINT // 10 || 'x","key":' || k || ',"version":3}' END AS record, problem, CASE WHEN problem IS NULL AND from_version < 3 THEN sha256(payload) END AS legacy_sha256 FROM p""",
)
def migrated_records(spark, sf_dir):
    """The properties of all events in three versions, some of them broken, of a version that nobody knows, or without what a version needs."""
    n, k = F.col("event_id"), F.regexp_extract("props", "[0-9]+", 0)
    band = F.floor(k.cast("bigint") / 10).cast("string")
    payload = (
        F.when(n % 50 == 7, '{"k": ').when(n % 50 == 8, '{"version":9,"key":1}').when(n % 50 == 9, '{"other":1}').when(n % 50 == 10, "[1]")
        .when(n % 3 == 0, F.concat(F.lit('{"k": '), k, F.lit("}"))).when(n % 3 == 1, F.concat(F.lit('{"key":'), k, F.lit(',"version":2}')))
        .otherwise(F.concat(F.lit('{"band":"'), band, F.lit('x","key":'), k, F.lit(',"version":3}')))
    )
    steps = [(_second, F.expr("try_variant_get(record, '$.k', 'bigint')").isNotNull()), (_third, F.expr("try_variant_get(record, '$.key', 'bigint')").isNotNull())]
    return M.migrated(table(spark, sf_dir, "events").select("event_id", payload.alias("payload")), "payload", steps).drop("payload")


@catalog.add(
    "chosen_bibliography",
    f"""WITH {_BLOCKS}, r AS (SELECT *, count(kind) OVER w AS region, last_value(kind IGNORE NULLS) OVER w AS rk FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT doc_id, max(idx) AS last FROM r WHERE kind = 'conclusion' GROUP BY doc_id),
    g AS (SELECT doc_id, region, min(idx) AS heading_idx, count(*) FILTER (kind IS NULL AND regexp_matches(text, '^\\p{{Lu}}.{{30,}}[.]$')) AS entries FROM r WHERE rk = 'bibliography' GROUP BY doc_id, region)
    SELECT doc_id, region::INT AS region, heading_idx, entries, heading_idx > coalesce(last, -1) AS after_conclusion, count(*) OVER (PARTITION BY doc_id) AS regions FROM g LEFT JOIN c USING (doc_id)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (entries > 0) DESC, (heading_idx > coalesce(last, -1)) DESC, heading_idx) = 1""",
)
def chosen_bibliography(spark, sf_dir):
    blocks = S.regions(work_blocks(spark, sf_dir)).withColumn("entry", F.col("text").rlike(r"^\p{Lu}.{30,}[.]$"))
    return S.chosen_bibliography(blocks)


@catalog.add(
    "profile_anchors",
    """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents), p AS (SELECT doc_id, unnest([1, 2, 3, 4]) AS ord, unnest([w[1] || ' ' || w[2], w[5] || ' ' || w[6], w[2] || ' ' || w[3], w[3] || ' ' || w[4]]) AS phrase FROM w WHERE len(w) >= 6),
    f AS (SELECT doc_id, lower(phrase) AS phrase, min(ord) AS ord FROM p GROUP BY ALL) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1)::INT AS pos, phrase FROM f""",
)
def profile_anchors(spark, sf_dir):
    """State texts of all documents of six words or more, with phrases out of their own words inside and outside of the profile's list."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")).filter("size(w) >= 6")
    for i in range(6):
        docs = docs.withColumn(f"w{i}", F.get("w", F.lit(i)))
    text = _text(
        "# State\n- «before»\n## personal_style_profile\n- «no list yet»\n**Якорьки для ВКР:**\n- «", "$w0", "  ", "$w1", "»\n- [«template one»]\n<!-- «hidden» -->\n* [«template»] \"", "$w4", " ", "$w5", "\" and «", "$w5", " ", "$w0", "»\n```\n- «in a fence»\n## Other\n```\n- no quotes\n",
        "**Оборот для критики:** «", "$w1", " ", "$w2", "», «second»\n- «not in the list»\n### Ниже\nЯкорьки\n+ „", "$w2", " ", "$w3", "“\n**Прочее**\n- «after bold»\n## Next\nЯкорьки\n- «outside»\n",
    )
    return P.personal_anchors(docs.select("doc_id", text.alias("state")), ["doc_id"], "state")
