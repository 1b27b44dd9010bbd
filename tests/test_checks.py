"""A report of all rules: one pass over the documents, with the rows of the rules alone."""

import random

from folioscope import catalog
from folioscope.operators import rules as V
from folioscope.operators import segments as S

HEADS = ["Аннотация", "Содержание", "Введение.", "Глава 1. Основы", "ГЛАВА II", "Заключение", "Список литературы", "Приложение 1", "ВЫВОДЫ  по второй главе: ", "Особое название.", "4 Ещё глава"]
BITS = ["Таблица 1. Данные", "Рисунок 3 – Вид", "см. табл. 1 и рис. 3", "рис. 9", "[1, с. 5]", "[3–5; 12]", "[ПРОВЕРИТЬ: год]", "[ВСТАВИТЬ]", "TODO", "{{имя}}", "Иванов И. И. писал", "И. И. Иванова", "Петрова П. П.", "в опыте 3 человека", "120 студентов", "1. Автор Б. Книга. 2001", "7) Яков", "[2] Анна В. Труд", "КНИГИ", "цель, тема, 50 с.", "текст " * 60, "слово " * 900, " \t ", "word[4]", "[5] [6]", "a\rb [7]", ""]


def _works():
    r, rows = random.Random(5), []
    for doc in range(60):
        for i in range(r.choice([1, 5, 60])):
            k = r.random()
            text, level, kind = (r.choice(HEADS), r.choice([1, 2, None]), "p") if k < 0.25 else (r.choice([None, "Таблица 6"]), None, "tbl") if k < 0.3 else (" ".join(r.choice(BITS) for _ in range(r.choice([1, 2]))), None, "p")
            rows.append((doc, 2 * i, text, level, kind))
    return rows


def test_one_pass_gives_the_rows_of_each_rule(spark, tmp_path):
    S.regions(spark.createDataFrame(_works(), "doc_id long, idx int, text string, heading_level int, type string")).write.parquet(str(tmp_path / "blocks"))
    blocks = spark.read.parquet(str(tmp_path / "blocks"))
    rows = lambda df: sorted(map(str, df.collect()))
    got = V.checks(blocks).collect()
    assert {x.rule for x in got} == set(V.RULES)
    for name, rule in V.RULES.items():
        assert rows(rule(blocks)) == sorted(str(x) for x in got if x.rule == name), name


def test_a_broken_rule_stands_alone(spark):
    rows = V.checks(spark.createDataFrame([(1, "TODO"), (2, "x")], "doc_id long, text string")).collect()
    assert [(x.doc_id, x.severity, x.code) for x in rows if x.rule == "markers"] == [(1, "error", "TODO")]
    assert sorted(x.doc_id for x in rows if x.rule == "structure" and "region_kind" in x.code) == [1, 2]


def test_reports_keep_no_blocks(spark, sf):
    for name, scans in (("rule_checks", 1), ("rule_summary", 2)):  # the summary takes the documents' ids too
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" not in plan and plan.count("Relation [") == scans, name
