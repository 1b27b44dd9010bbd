"""Ordered folds and grammars against plain Python, and invariance of results."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import audit as A
from folioscope.operators import bibliography as B
from folioscope.operators import citations as C
from folioscope.operators import metrics as M
from folioscope.operators import registry as R
from folioscope.operators import rules as V
from folioscope.operators import segments as S
from folioscope.queries.audit import log


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


def test_mtld(spark, sf):
    def plain(words):
        types, n, factors = set(), 0, 0
        for w in words:
            types.add(w)
            n += 1
            if len(types) / n < 0.72:
                factors, types, n = factors + 1, set(), 0
        if n:
            factors += (1 - len(types) / n) / (1 - 0.72)
        return len(words) / factors if factors > 0 else len(words)

    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(60).select(X.letter_words(F.col("text")).alias("w"), M.mtld(X.letter_words(F.col("text"))).alias("m")).collect()
    assert all(math.isclose(r.m, plain(r.w), rel_tol=1e-9) for r in rows if r.w)


def plain_replay(events):
    state = {}
    for e in sorted(events, key=lambda e: (e.seq, e.ord)):
        f = state.get(e.finding_id)
        if e.action == "register":
            if f is None:
                state[e.finding_id] = {"status": "open", "source": e, "negative": set(), "history": 0, "at": None}
            continue
        if f is None:
            continue
        before, src = f["status"], f["source"]
        if e.action == "recheck":
            f["history"] += 1
            clean = e.snapshot_sha not in f["negative"]
            if e.verdict == "pass" and before == "open" and clean and e.snapshot_seq > src.snapshot_seq and e.snapshot_sha != src.snapshot_sha:
                f["status"] = "resolved"
            elif e.verdict == "invalid_finding" and before == "open" and clean and e.auditor.replace(" ", "").lower() != src.auditor.replace(" ", "").lower() and e.evidence_level in ("E3", "E4"):
                f["status"] = "rejected"
            elif e.verdict in ("fail", "partial"):
                if before in ("resolved", "rejected"):
                    f["status"] = "open"
                f["negative"].add(e.snapshot_sha)
        elif e.action == "accept_risk" and before == "open" and (e.reason or "").strip() and src.severity not in A.HIGH and e.allowed is not False:
            f["status"], f["history"] = "accepted_risk", f["history"] + 1
        elif e.action == "waive" and before == "open" and src.fix_class == "SUPERVISOR_APPROVAL" and e.allowed:
            f["status"], f["history"] = "waived", f["history"] + 1
        if f["status"] != before:
            f["at"] = None if f["status"] == "open" else e.seq
    return {k: (f["status"], f["source"].severity, f["source"].gate, f["history"], f["at"]) for k, f in state.items()}


@pytest.mark.parametrize("parts", [1, 7])
def test_replay(spark, parts):
    """The same in any order of rows and number of partitions."""
    events = log(spark, "/root/testdata/sf0.01")
    got = {r.finding_id: (r.status, r.severity, r.gate, r.history, r.resolved_seq) for r in A.replay(events.orderBy(F.rand(parts)).repartition(parts)).collect()}
    want = plain_replay(events.collect())
    assert got == want and len({s for s, *_ in want.values()}) > 3


def test_replay_by_hand(spark):
    def event(seq, action, verdict=None, sha="s1", q=1, auditor="a", level="E2", severity="MINOR", fix="SAFE_EDIT", reason=None, allowed=None):
        return ("F", seq, 0, action, verdict, q, sha, auditor, level, severity, "LOG", fix, reason, allowed)

    schema = "finding_id string, " + A.EVENT[7:-1].replace(":", " ").replace(",", ", ")
    status = lambda *es: A.replay(spark.createDataFrame([event(1, "register"), *es], schema)).first()["status"]
    assert status() == "open"
    assert status(event(2, "recheck", "pass")) == "open"  # the same snapshot doesn't close
    assert status(event(2, "recheck", "pass", "s2", 2)) == "resolved"
    assert status(event(2, "recheck", "fail", "s2", 2), event(3, "recheck", "pass", "s2", 2)) == "open"
    assert status(event(2, "recheck", "pass", "s2", 2), event(3, "recheck", "fail", "s3", 3)) == "open"
    assert status(event(2, "recheck", "invalid_finding", "s2", 2, "a", "E3")) == "open"
    assert status(event(2, "recheck", "invalid_finding", "s2", 2, "b", "E3")) == "rejected"
    assert status(event(2, "accept_risk", reason="why")) == "accepted_risk"
    assert status(event(2, "accept_risk", reason=" ")) == "open"
    assert status(event(2, "waive", allowed=True)) == "open"


def test_risk_facts(spark):
    schema = "finding_id string, " + A.EVENT[7:-1].replace(":", " ").replace(",", ", ")
    events = spark.createDataFrame([("F", 100, 1, "accept_risk", *[None] * 8, "why", None)], schema)
    findings = [("F", "LOG", "r0", 1, "k0", "E1", "MINOR")]
    waves = [("LOG", f"r{i}", 10 * i, 10 * i + 5, f"k{i}") for i in (1, 2, 3)]
    allowed = lambda w, f: A.risk_facts(events, spark.createDataFrame(w, "gate string, run_id string, planned long, closed long, content_key string"), spark.createDataFrame(f, "finding_id string, gate string, run_id string, planned long, content_key string, evidence_level string, severity string")).first()["allowed"]
    assert allowed(waves, findings) is True
    assert allowed(waves[:2], findings) is False
    assert allowed(waves, [*findings, ("G", "LOG", "r2", 20, "k2", "E2", "INFO")]) is False
    assert allowed([*waves[:2], ("LOG", "r3", 30, 35, "k0")], findings) is False


def test_risk_facts_by_pairs(spark):
    """Many questions and waves of a gate: as by pairs, and without any join of the two."""
    rng = random.Random(4)
    findings = [(i, rng.choice(["LOG", "STY", "MET"]), rng.randrange(400), rng.choice([None, 1, 150, 300]), rng.choice([None, *"abcdefgh"]), rng.choice(["E1", "E1", "E1", "E2"]), rng.choice(["MINOR", "MINOR", "MAJOR"])) for i in range(60)]
    waves = [(rng.choice(["LOG", "STY", "MET"]), i, p := rng.choice([None, *range(1, 400)]), rng.choice([None, (p or 0) + rng.randrange(40)]), rng.choice([None, *"abcdefgh"])) for i in range(400)]
    asks = [(f, s, "accept_risk", None) for f in range(60) for s in rng.sample(range(450), 6)]
    new = {(g, r) for _, g, r, _, _, level, _ in findings if level == "E2"}
    want = {}
    for f, g, _, start, key, _, severity in findings:
        for s in (s for i, s, _, _ in asks if i == f):
            seen = [(w, k) for gate, w, p, c, k in waves if gate == g and None not in (p, c, k, start) and p > start and c < s and k != key]
            want[f, s] = len({k for _, k in seen}) >= 3 and not any((g, w) in new for w, _ in seen) if g != "MET" and severity == "MINOR" else None
    out = A.risk_facts(spark.createDataFrame(asks, "finding_id long, seq long, action string, allowed boolean"), spark.createDataFrame(waves, "gate string, run_id long, planned long, closed long, content_key string"), spark.createDataFrame(findings, "finding_id long, gate string, run_id long, planned long, content_key string, evidence_level string, severity string"))
    assert {(r.finding_id, r.seq): r.allowed for r in out.collect()} == want and {True, False, None} == set(want.values())
    nodes, todo = [], [out._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert not any(n.nodeName() == "Join" and "seq" in n.toString().split("\n")[0] and "<" in n.toString().split("\n")[0] for n in nodes)  # no question meets each wave


def test_assigned_ids(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice([None, 0, -1, 1, 2, 3, 7])) for g in range(30) for i in range(8)]
    got = {(r.g, r.i): r.id for r in R.assigned_ids(spark.createDataFrame(rows, "g int, i long, w long"), ["g"], "i", "w").collect()}
    for g in range(30):
        used = []
        for _, i, w in sorted(r for r in rows if r[0] == g):
            own = w if w and w > 0 and w not in used else max(used, default=0) + 1
            used.append(own)
            assert got[g, i] == own


def test_citation_grammars(spark):
    strict = {
        "[15]": "15", "[15, с. 23]": "15", "[15, с. 23–25]": "15", "[15; 17]": "15,17", "[15, 17, 19]": "15,17,19", "[3-6]": "3,4,5,6", "[6-3]": "", "[Цит. по: 27, с. 235]": "27", "arr[25]": "25", "[0]": "", "[1-60]": "",
        "[@smith2001, p. 4; 7]": "@smith2001,7", "[text]": "", "[15; text]": "", "`[3]`": "", "[15, чушь]": "",
    }
    lenient = {"[15]": "15", "[15, с. 23–25]": "15", "[15; 17]": "15,17", "[15, 17, 19]": "15,17,19", "[3-6]": "3,4,5,6", "[6-3]": "6", "[Цит. по: 27, с. 235]": "27", "arr[25]": "", "matrix[n][30]": "", "f(x)[1]": "", "[501]": "", "[15; text]": "15", "[См.: 12; 13]": "12,13", "[15, т. 2, с. 45]": "15"}
    for want, refs in ((strict, C.strict_refs), (lenient, lambda c: C.lenient_numbers(c).cast("array<string>"))):
        rows = spark.createDataFrame(list(want.items()), "t string, w string").select("t", "w", F.array_join(refs(F.col("t")), ",").alias("g")).collect()
        assert [(r.t, r.g) for r in rows if r.g != r.w] == []
    numbers = F.create_map(F.lit("@a"), F.lit(3), F.lit("7"), F.lit(1), F.lit("8"), F.lit(2), F.lit("9"), F.lit(3))
    got = spark.createDataFrame([("See [@a, с. 2] and [7; 8], [7-9], [@b], `[7]` x[1",)], "t string").select(C.rewritten(F.col("t"), numbers).alias("x")).first()["x"]
    assert got == "See [3, с. 2] and [1; 2], [1–3], [@b], `[7]` x[1"


def test_people(spark):
    forms = {"Иванов И.О.": ("Иванов", "И.О.", False), "Иванов, И. О.": ("Иванов", "И.О.", False), "И.О. Иванов": ("Иванов", "И.О.", False), "Петров Иван Сергеевич": ("Петров", "И.С.", False), "W3C": ("W3C", "", True), "Платон": ("Платон", "", False), "Институт права": ("Институт права", "", True), "": None}
    rows = spark.createDataFrame([(k,) for k in forms], "t string").select("t", B.person(F.col("t")).alias("p")).collect()
    assert {r.t: None if r.p is None else tuple(r.p) for r in rows} == forms
    assert [spark.createDataFrame([(s,)], "s string").select(B.genitive(F.col("s")).alias("g")).first()["g"] for s in ("Петров", "Петрова", "Достоевский", "Шевченко", "Ли")] == ["Петрова", "Петровой", "Достоевского", "Шевченко", None]


def test_records(spark):
    person = lambda last, initials: (last, initials, False)
    schema = f"type string, title string, authors array<{B.PERSON}>, editors array<{B.PERSON}>, journal string, container_title string, place string, publisher string, year string, pages string, number string, volume string, designation string, introduced string, thesis_type string, doc_type string, date string, source string, country string, holder string"
    rows = [
        ("book", "Педагогика", [person("Иванов", "И.О.")], None, None, None, "М.", "Наука", "2001", "250", *[None] * 10),
        ("article", "Метод", [person("Иванов", "И.О."), person("Петров", "П.П.")], None, "Вопросы", None, None, None, "2010", "3-9", "4", "12", *[None] * 8),
        ("сборник", "Доклад", [person("Иванов", "И.О.")], [person("Петров", "П.П.")], None, "Труды", "М.", "Наука", "2011", "5-6", *[None] * 10),
        ("standard", "Запись", None, None, None, None, "М.", "Стандартинформ", "2008", "19", None, None, "ГОСТ Р 7.0.5-2008", "2009-01-01", *[None] * 6),
        ("patent", "Способ", [person("Иванов", "И.О.")], None, None, None, None, None, None, None, "123", *[None] * 7, "РФ", "Завод"),
        ("закон", "Об образовании", *[None] * 8, "273-ФЗ", *[None] * 4, "федер. закон", "29.12.2012", "Рос. газета", None, None),
        ("dissertation", "Тема", [person("Иванов", "И.О.")], None, None, None, "М.", None, "1999", "180", *[None] * 10),
        ("poem", "X", *[None] * 18),
    ]
    got = [(r.record, r.error) for r in B.formatted(spark.createDataFrame(rows, schema)).collect()]
    assert got == [
        ("Иванов, И.О. Педагогика [Текст] / И.О. Иванов. – М.: Наука, 2001. – 250 с.", None),
        ("Иванов, И.О. Метод [Текст] / И.О. Иванов, П.П. Петров // Вопросы. – 2010. – Т. 12, № 4. – С. 3–9.", None),
        ("Иванов, И.О. Доклад [Текст] / И.О. Иванов // Труды / под ред. П.П. Петрова. – М.: Наука, 2011. – С. 5–6.", None),
        ("ГОСТ Р 7.0.5-2008. Запись [Текст]. – Введ. 2009-01-01. – М.: Стандартинформ, 2008. – 19 с.", None),
        ("Пат. 123 РФ. Способ [Текст] / И.О. Иванов; Завод.", None),
        ("Об образовании [Текст]: федер. закон от 29.12.2012 № 273-ФЗ. – Рос. газета.", None),
        ("Иванов, И.О. Тема: Дис. … канд. пед. наук [Текст] / И.О. Иванов. – М., 1999. – 180 с.", None),
        (None, "unknown type"),
    ]


def test_collation(spark):
    words = ["яблоко", "ёлка", "ель", "apple", "Éclair", "10 книг", "2 книги", "а б", "аб", "Я"]
    keys = spark.createDataFrame([(w,) for w in words], "t string").orderBy(B.collation_key(F.col("t")), "t").collect()
    assert [r.t for r in keys] == ["10 книг", "2 книги", "а б", "аб", "ёлка", "ель", "Я", "яблоко", "apple", "Éclair"]


def test_scalars(spark):
    text = lambda f, *xs: [r.x for r in spark.createDataFrame([(x,) for x in xs], "t string").select(f(F.col("t")).alias("x")).collect()]
    assert text(X.from_roman, "IV", "iv", "IIII", "LX", "LXI", "") == [4, 4, None, 60, None, None]
    assert text(X.collapse_space, " a  b\tc ", None) == ["a b c", ""]
    assert text(X.heading_key, " Ёлка: Глава . ") == ["елка: глава"]
    assert text(X.normalise_phrase, "«Ёж  и Лис»", '"a"') == ["еж и лис", "a"]
    assert text(X.looks_like_toc, "Глава\t12", "Глава ..... 3", "Глава 3", "Глава … 3") == [True, True, False, True]
    assert text(X.safe_path, "a/b.md", "../a", "a/../../b", "/a", "C:\\x", "http://x", "a/../b", "") == [True, False, False, False, False, False, True, False]
    assert text(X.table_cells, "| a | b\\|c |") == [["a", "b|c"]]
    assert text(X.mask_code, "x `y` z\n```\ncode\n```\nend\n~~~\nopen") == ["x  z\n\n\n\nend\n\n"]
    assert text(X.strip_comments, "a<!-- x\ny -->b") == ["a\nb"]
    assert text(X.is_upper, "АБВГ", "АБв Г", "A1B2C3D") == [True, False, True]
    assert [None if x is None else str(x) for x in text(X.iso_timestamp, "2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05.1234567+03:00", "2024-01-02T25:00:00", "x")] == ["2024-01-02 00:00:00", "2024-01-02 03:04:05", "2024-01-02 00:04:05.123456", None, None]
    assert text(X.split_sentences, "One two. Three four! No. Last one") == [["One two.", "Three four!", "Last one"]]


def test_regions(spark):
    rows = ["Титул", "Введение", "Текст введения.", "Первая часть", "Текст 1", "Вторая", "Заключение", "Итог", "Список литературы", "1. Книга", "Приложение А", "Данные", "Выпускная квалификационная работа"]
    heads = {1, 3, 5, 6, 8, 10}
    df = spark.createDataFrame([(1, i, t, 1 if i in heads else None) for i, t in enumerate(rows)], "doc_id int, idx int, text string, heading_level int")
    got = [(r.region_kind, r.chapter_no) for r in S.regions(df).orderBy("idx").collect()]
    assert got == [("front", None), ("introduction", None), ("introduction", None), ("chapter", 1), ("chapter", 1), ("chapter", 2), ("conclusion", None), ("conclusion", None), ("bibliography", None), ("bibliography", None), ("appendix", None), ("appendix", None), ("last_sheet", None)]
    kinds = {"Глава 1.1 Цель": None, "Глава IV. Итоги": "chapter", "ГЛАВА ВТОРАЯ": "chapter", "Глава IIII": None, "Введение\t5": None, "Приложение разработано": None, "Выводы по главе 1": None}
    found = S.classified(spark.createDataFrame([(1, i, t) for i, t in enumerate(kinds)], "doc_id int, idx int, text string")).collect()
    assert {r.text: r.kind for r in found} == kinds


def test_markers(spark):
    text = "Текст [ПРОВЕРИТЬ] и [ТРЕБУЕТ УТОЧНЕНИЯ: выборка] и [N]%.\n```python\nitems[x] = {{ value }}  # TODO\n```\nПриложение ToDo, XXX Олимпиада, arr[n]. TBD\n"
    found = S.markers(spark.createDataFrame([(1, text)], "k int, text string").withColumn("text", X.mask_code(F.col("text"))), ["k"]).orderBy("pos").collect()
    assert [(r.code, r.mark) for r in found] == [("CHECK_SOURCE", "[ПРОВЕРИТЬ]"), ("NEEDS_CLARIFICATION", "[ТРЕБУЕТ УТОЧНЕНИЯ: выборка]"), ("VALUE_PLACEHOLDER", "[N]"), ("TODO", "TBD")]
    assert re.search("ПРОВЕРИТЬ", text)


def test_plan_counts():
    total = lambda *a: sum(n for _, n in A.plan_rows(*a))
    assert total("final", "strict") == 15 and total("final", "balanced") == 9 and total("final", "maximum") == 18
    assert [total("subsection", "strict", False, o) for o in (False, True)] == [3, 4]
    assert total("sources", "balanced") == 3 and total("docx", "balanced") == 4


def test_hints_are_worked_out_once(spark):
    """Hints are columns that queries read, and not expressions that each reader repeats."""
    raw = spark.createDataFrame([(1, "3. Иванов, И. И. Книга о книгах / И. И. Иванов. – М.: Наука, 2001"), (2, None)], "k int, raw string")
    found = B.hints(raw, "raw").select("k", B.search_queries(F.col("hints")).alias("q"))
    assert {r.k: [q.query for q in r.q] for r in found.collect()}[1][:2] == ['"Книга о книгах"', 'Иванов И.И. "Книга о книгах"']
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_costly_maps_are_dealt_out(spark, sf):
    from folioscope import catalog

    for name in ("search_queries", "hint_parse", "all_metrics", "risk_score", "risk_score_full", "burstiness", "markdown_blocks", "merged_drafts"):
        assert catalog.queries()[name](spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_reach_python_in_small_batches(spark):
    """A batch of drafts is closed by its bytes, not by its rows alone."""
    from folioscope.operators import merge
    from folioscope.sources.markdown import md_blocks

    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    drafts = spark.createDataFrame([(1, "# A\n\ntext", "# B\n\ntext")], "k int, old string, new string")
    for make in (lambda: merge.merge_drafts(drafts, "k"), lambda: md_blocks(drafts, "k", "old")):
        spark.conf.unset(conf)
        assert make().count() > 0 and int(spark.conf.get(conf)) == 2 << 20
    spark.conf.set(conf, "1m")
    assert md_blocks(drafts, "k", "old").count() == 2 and spark.conf.get(conf) == "1m"  # a bound of the session's own stays
    spark.conf.unset(conf)


def test_metrics_share_what_they_read(spark, sf):
    """Paragraphs of all measures are split once."""
    from folioscope.plans import api

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = api.metrics(docs)
    assert out.columns == ["doc_id", "burstiness", "phrases", "lexical", "rhythm", "starters", "passive", "readability", "anchors", "pronouns"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("AS paras#") == 1


def test_both_sides_are_read_once(spark):
    """Keys of one side; a null has no partner; no join."""
    side = lambda rows: spark.createDataFrame(rows, "a int, b int")
    out = R.both_sides(side([(1, 1), (1, 1), (2, 1), (3, None)]), side([(2, 1), (4, 1), (3, None)]), ["a", "b"])
    assert sorted((r.a, r.b or 0, r.side) for r in out.collect()) == [(1, 1, "left"), (3, 0, "left"), (3, 0, "right"), (4, 1, "right")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def _bibliographies(spark):
    """Works with doubled numbers, gaps, group headings, entries without a number, and entries out of order."""
    lists = {
        1: ["1. Автор А. Книга", "2. Борис Б. Книга", "3. Вера В. Книга"],
        2: ["1. Вера В. Книга", "1. Автор А. Книга", "1. Борис Б. Книга", "4. Ёлка Ё. Книга"],
        3: ["ЗАКОНЫ СТРАНЫ", "1. Яков Я. Книга", "КНИГИ И СТАТЬИ", "Автор А. Книга", "2. Абрам А. Книга"],
        4: ["2. Автор А. Книга"],
        5: ["КНИГИ И СТАТЬИ"],
    }
    rows = [(k, i + 100, t, "bibliography", False) for k, ts in lists.items() for i, t in enumerate(ts)]
    rows += [(1, 0, "Текст [1; 3] и [1].", "chapter", False), (2, 0, "Текст [9].", "chapter", False), (6, 0, "Текст [2].", "chapter", False)]
    return spark.createDataFrame(rows, "doc_id int, idx int, text string, region_kind string, starts boolean")


def test_bibliography_order_is_one_pass(spark):
    """Entries are read once, and nothing is grouped or joined."""
    out = V.bibliography_order(_bibliographies(spark))
    got = sorted((r.doc_id, r.severity, r.code) for r in out.collect())
    assert got == [(2, "error", "doubled: 1"), (2, "error", "numbering"), (2, "warning", "order: 1"), (3, "error", "doubled: 2"), (3, "warning", "order: 2"), (4, "error", "numbering")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in ("Aggregate", "Join", "Union") if x in plan]


def test_listed_works_are_dealt_out_by_key(spark, sf):
    from folioscope import catalog
    from folioscope.operators.deal import KEYED_PARTS

    assert catalog.queries()["rule_bibliography"](spark, sf).rdd.getNumPartitions() == KEYED_PARTS


def test_cross_references_group_both_sides_at_once(spark):
    """Numbers cited and listed meet in one group, without a join."""
    out = V.cross_references(_bibliographies(spark))
    got = sorted((r.doc_id, r.code) for r in out.collect())
    assert got == [(1, "not cited: 2"), (2, "not cited: 1"), (2, "not cited: 4"), (2, "not listed: 9"), (3, "not cited: 1"), (3, "not cited: 2"), (4, "not cited: 2"), (6, "not listed: 2")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
