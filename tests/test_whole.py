"""Queries without SQL read whole tables."""

from collections import defaultdict

from folioscope import catalog

HEADS = ("contents", "introduction", "chapter1", "chapter2", "conclusion", "bibliography", "appendix")


def test_long_documents(spark, tmp_path):
    """Lines behind the fortieth are in the sections, and the rules see them."""
    lines = {n: [f"line {i} of document {n} with enough characters" for i in range(130)] for n in (1, 2)}
    spark.createDataFrame([(n, "\n\n".join(own)) for n, own in lines.items()], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, starts = defaultdict(list), defaultdict(int)
    for n, own in lines.items():
        region = "front"
        for i, line in enumerate(own):
            if (i + n) % 5 == 0:
                region = HEADS[int((i / 5 + n) % 7)]
                starts[n] += region.startswith("chapter")
            if region in ("introduction", "chapter1", "chapter2", "conclusion"):
                want[n, region].append(line)
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.section): r.text.split("\n") for r in run("sections")} == want
    assert run("missing_sections") == []
    assert {r.doc_id: r.code for r in run("rule_checks") if r.rule == "profile"} == {n: f"chapters: {k}" for n, k in starts.items()}


def test_all_orders_are_listed(spark, tmp_path):
    """An order's findings don't depend on its key."""
    lines = [(order, n, float((order * 7 + n * 11) % 40)) for order in range(1, 40) for n in range(1, 8)]
    rows = [(order + shift, n, q) for order, n, q in lines for shift in (0, 100_000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = [tuple(r) for r in catalog.queries()["rule_bibliography"](spark, str(tmp_path)).collect()]
    low = sorted(r for r in found if r[0] < 100_000)
    assert low and sorted((r[0] - 100_000, *r[1:]) for r in found if r[0] >= 100_000) == low
