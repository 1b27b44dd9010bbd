"""Rules of precedence, walks, chains, YAML and migration on cases that the queries' tables don't hold."""

import hashlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators import audit as A
from folioscope.operators import migrate as M
from folioscope.operators import resolve as R
from folioscope.operators.walk import walked
from folioscope.sources import yaml as Y


def test_policy_wildcards_conflicts_and_nulls(spark):
    policy = spark.createDataFrame([("a", None, 1), (None, "x", 2), ("a", "x", 3), ("b", None, 4), ("b", None, 4), ("c", None, 5), ("c", None, 6)], "k string, l string, d int")
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "z", "x"), (4, "b", "x"), (5, "b", None), (6, None, None), (7, "c", "q"), (8, "a", "x")], "id int, k string, l string")
    got = {r.id: (r.d, r.specificity, r.conflict) for r in R.by_policy(rows, policy, ["k", "l"], "d").collect()}
    assert got == {1: (3, 2, False), 2: (1, 1, False), 3: (2, 1, False), 4: (2, 1, True), 5: (4, 1, False), 6: (None, None, False), 7: (5, 1, True), 8: (3, 2, False)}
    default = policy.unionByName(spark.createDataFrame([(None, None, 9)], policy.schema))
    assert {r.id: r.d for r in R.by_policy(rows, default, ["k", "l"], "d").collect()}[6] == 9
    assert R.by_policy(rows, policy.filter("false"), ["k", "l"], "d").filter("d is not null or conflict").count() == 0


def test_ranked_keys(spark):
    rows = spark.createDataFrame([(1, "p", "s"), (2, None, "s"), (3, "q", None), (4, None, None)], "id int, a string, b string")
    records = spark.createDataFrame([("r2", "p", None), ("r1", "p", "t"), ("r3", None, "s"), ("r0", None, None)], "rec string, a string, b string")
    got = {r.id: (r.rec, r.source) for r in R.by_ranked_keys(rows, records, "id", "rec", [("print", F.col("a"), F.col("a")), ("hash", F.col("b"), F.col("b"))]).collect()}
    assert got == {1: ("r1", "print"), 2: ("r3", "hash"), 3: (None, None), 4: (None, None)}


def test_nearest_takes_the_longest_place(spark):
    paths = spark.createDataFrame([("/a/b/c.txt",), ("/a/bc/d",), ("/x",), (None,), ("a/b",)], "p string")
    configs = spark.createDataFrame([("/a/", 1), ("/a/b", 2), ("/a/b", 3), ("/a/b/c", 4), ("b", 5), ("/", 6)], "c string, v int")
    got = {r.p: (r.c, r.v) for r in R.nearest(paths, configs, "p", "c", ["v"]).collect()}
    assert got == {"/a/b/c.txt": ("/a/b", 2), "/a/bc/d": ("/a", 1), "/x": ("", 6), "a/b": (None, None)}


def test_chain_of_one_large_group_is_walked(spark):
    n = 20_000
    events = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("o"), F.concat(F.lit("c"), "id").alias("v"))
    got = {r.o: (r.event_sha, r.previous_sha) for r in A.chained_ids(events, ["g"], "o", ["v"]).collect()}
    last = ""
    for i in range(n):
        content = hashlib.sha256(f'{{"v":"c{i}"}}'.encode()).hexdigest()
        now = hashlib.sha256(f"{last}|{content}".encode()).hexdigest()
        assert got[i] == (now, last)
        last = now
    assert R.chain_problems(A.chained_ids(events, ["g"], "o", ["v"]).join(events, ["g", "o"]), ["g"], "o", "event_sha", "previous_sha", A.X.canonical_sha256("v")).count() == 0


def test_walk_begins_anew_for_each_key(spark):
    def make():
        seen = []

        def step(row):
            seen.append(row["v"])
            return {"total": sum(seen)} if row["v"] else None

        return step

    rows = spark.createDataFrame([(None, 1, 5), ("a", 2, 2), ("a", 1, 1), ("b", 1, 0), ("b", 2, 7), (None, 2, 5)], "k string, o int, v int")
    got = walked(rows, ["k"], ["o"], make, [T.StructField("total", T.IntegerType())])
    assert got.columns == ["k", "o", "total"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, 1, 5), (None, 2, 10), ("a", 1, 1), ("a", 2, 3), ("b", 2, 7)], key=repr)


YAML = """﻿---
# all
a: 1   # one
'b c': "x # y: z"
list:
- p
- "q, r"
-   k: v
    l:
      - deep
      - m: n
    e: # nothing
nested:
    one:
        two: 'it''s'
    http: http://x/#y
inline: [ a , "b, c", 'd', ]
empty: []
after: "open # and on
"""


def test_yaml_of_many_forms(spark):
    texts = spark.createDataFrame([(1, YAML), (2, None), (3, ""), (4, "just: this")], "id int, t string")
    got = [(r.id, r.path, r.value) for r in Y.values(texts, ["id"], "t").orderBy("id", "line", "path").collect()]
    assert got == [
        (1, "a", "1"), (1, "b c", "x # y: z"), (1, "list[0]", "p"), (1, "list[1]", "q, r"), (1, "list[2].k", "v"), (1, "list[2].l[0]", "deep"), (1, "list[2].l[1].m", "n"),
        (1, "nested.one.two", "it''s"), (1, "nested.http", "http://x/#y"), (1, "inline[0]", "a"), (1, "inline[1]", "b, c"), (1, "inline[2]", "d"), (1, "after", '"open # and on'), (4, "just", "this"),
    ]


def test_migration_twice_changes_nothing(spark):
    def second(r):
        return F.concat(F.lit('{"version":2,"b":'), F.expr("try_variant_get(record, '$.a', 'string')"), F.lit("}"))

    steps = [(second, F.expr("try_variant_get(record, '$.a', 'bigint')").isNotNull())]
    rows = spark.createDataFrame([(1, '{"a":7}'), (2, '{"version":2,"b":7}'), (3, '{"version":"x"}'), (4, None), (5, '"text"'), (6, '{"a":"no"}'), (7, '{"version":0}')], "id int, p string")
    once = M.migrated(rows, "p", steps)
    got = {r.id: (r.from_version, r.record, r.problem) for r in once.collect()}
    assert got[1] == (1, '{"b":7,"version":2}', None) and got[2] == (2, '{"b":7,"version":2}', None)
    assert [got[i][2] for i in (3, 4, 5, 6, 7)] == ["unknown version", "unreadable", "unreadable", "not version 1", "unknown version"]
    again = M.migrated(once.filter("record is not null").select("id", F.col("record").alias("p")), "p", steps)
    assert {(r.id, r.record, r.legacy_sha256) for r in again.collect()} == {(1, '{"b":7,"version":2}', None), (2, '{"b":7,"version":2}', None)}


def test_stored_reports_skip_what_only_times_change(spark):
    rows = [(1, '{"at":1,"x":{"b":1,"a":2}}'), (2, '{"x":{"a":2,"b":1},"at":2}'), (3, "no json"), (4, '{"x":{"a":2,"b":1}}'), (5, '{"x":3}'), (6, None), (7, '{"at":9,"x":{"a":2,"b":1}}')]
    reports = spark.createDataFrame([("g", i, p) for i, p in rows], "g string, i int, p string")
    assert [r.i for r in A.stored_reports(reports, ["g"], "i", "p", ["at"]).orderBy("i").collect()] == [1, 5, 7]


def test_yaml_lines_are_matched_once_and_not_sent(spark):
    """Texts are dealt out by key before they are cut, and the pattern of a line stands once in the plan."""
    from folioscope.operators.deal import KEYED_PARTS

    texts = spark.createDataFrame([(1, "a: 1\r\nb:\n- x # one\n- k: [p, 'q # r']\n"), (2, None), (3, "a\rb: 2\n-\n")], "k int, t string")
    out = Y.values(texts, ["k"], "t")
    assert sorted((r.k, r.path, r.value) for r in out.collect()) == [(1, "a", "1"), (1, "b[0]", "x"), (1, "b[1].k[0]", "p"), (1, "b[1].k[1]", "q # r"), (3, "a\rb", "2")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^:]*?") == 1 and plan.index("Generate posexplode") < plan.index("RepartitionByExpression")
    assert out.rdd.getNumPartitions() == KEYED_PARTS


def test_links_of_a_chain_meet_once(spark):
    """Each record is sent once as what it asks for and what it offers, without a join; digests in other letters are other texts."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    a = sha("|c")
    b = sha(f"{a}|c")
    rows = [(1, 1, a, None, "c"), (1, 2, b, a, "c"), (1, 3, b, a, "c"), (1, 4, sha("|d"), "", "d"), (2, 1, "f", None, "c"), (2, 2, sha(f"{a.upper()}|c"), a.upper(), "c"), (2, 3, None, "f", "c")]
    out = R.chain_problems(spark.createDataFrame(rows, "g int, o int, sha string, p string, c string"), ["g"], "o", "sha", "p", F.col("c"))
    assert sorted((r.g, r.o, r.problem, r.first) for r in out.collect()) == [(1, 3, "fork", True), (1, 4, "beginning", False), (2, 1, "tampered", True), (2, 2, "orphan", False), (2, 3, "tampered", False)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_yaml_records_match_lines_once(spark, sf):
    from folioscope import catalog

    out = catalog.queries()["yaml_records"](spark, sf)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[^:]*?") == 1
    assert out.count() == 2 * spark.read.parquet(f"{sf}/orders.parquet").count()


def test_yaml_texts_are_walked_whole(spark):
    """Lines are rows only behind the walk, and keep their numbers; what other systems end lines with stands within a line; texts of one key are read one behind the other."""
    odd = "\n\n---\na: # none\n  - 'b # c' : \"d\" # e\n  \n  -\n  - f\r: g\r\n\u2028h\n    i: j\u2028\n"
    texts = spark.createDataFrame([(1, odd), (2, "p:\n- q: 1\n"), (2, "s:\n  t: 2\n"), (3, "# only")], "k int, t string")
    out = Y.values(texts, ["k"], "t")
    got = sorted((r.k, r.line, r.path, r.value) for r in out.collect())
    assert got == [(1, 4, "a[0].b # c", "d"), (1, 7, "a[2].f\r", "g"), (1, 9, "i", "j"), (2, 1, "p[0].q", "1"), (2, 1, "s.t", "2")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("MapInArrow") < plan.index("Sort [") < plan.index("RepartitionByExpression")


def test_yaml_records_of_a_nested_list(spark):
    """The list's path is taken as it is written, without a pattern for each value; a record without the fields is one all the same."""
    text = "p.q:\n- s:\n  - id: 1\n    t: [x, y]\n  - u: 3\npxq:\n- s:\n  - id: 4\np:\n- v\n'p.q[x].s[0].id': 5\n"
    found = Y.values(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t")
    out = Y.records(found, ["k"], "p.q[0].s", ["id", "t[1]"])
    assert sorted(map(tuple, out.collect())) == [(1, 0, "1", "y"), (1, 1, None, None)]
    assert sorted(map(tuple, Y.records(found, ["k"], "p.q", ["s[0].id"]).collect())) == [(1, 0, "1")]
    odd = Y.values(spark.createDataFrame([(1, "s:\n- x\ry: z\n"), (2, "s: [a, '', \"b]\", ' c ', ]\nt: []")], "k int, t string"), ["k"], "t")
    assert sorted((r.k, r.path, r.value) for r in odd.collect()) == [(1, "s[0].x\ry", "z"), (2, "s[0]", "a"), (2, "s[1]", ""), (2, "s[2]", "b]"), (2, "s[3]", " c ")]
    assert sorted(map(tuple, Y.records(odd, ["k"], "s", ["x\ry"]).collect())) == [(1, 0, "z")]
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0].lower()
    assert "regexp" not in above and "rlike" not in above
