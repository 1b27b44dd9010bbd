"""Readers: Word packages, Markdown, JSON lines; streams equal to batches."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.operators import audit as A
from folioscope.operators import merge
from folioscope.operators import rules as V
from folioscope.operators import segments as S
from folioscope.plans import api
from folioscope.queries.audit import log
from folioscope.sources import docx, files, markdown
from folioscope.streaming import journal

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://x/officeDocument" Target="{}"/></Relationships>'
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="a"/><Default Extension="rels" ContentType="b"/></Types>'
STYLES = f'<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Times New Roman"/><w:sz w:val="28"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:styleId="base"><w:name w:val="Normal"/><w:pPr><w:spacing w:line="360"/><w:ind w:firstLine="709"/><w:jc w:val="both"/></w:pPr></w:style><w:style w:styleId="h1"><w:name w:val="heading 1"/><w:basedOn w:val="base"/></w:style></w:styles>'


def p(text, style="base", run=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>'


def package(body, **other):
    parts = {"[Content_Types].xml": TYPES, "_rels/.rels": RELS.format("word/document.xml"), "word/styles.xml": STYLES, "word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>", **{k.replace("__", "/"): v for k, v in other.items()}}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            if data is not None:
                z.writestr(name, data)
    return out.getvalue()


FIELD = '<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>PAGE</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>7</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p>'
BODY = p("Введение", "h1") + p("Текст.") + FIELD + '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B</w:t></w:r></w:p></w:tc></w:tr></w:tbl>' + p("Красный", run='<w:color w:val="FF0000"/><w:sz w:val="20"/>') + '<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1134" w:bottom="1134" w:left="1701" w:right="567"/></w:sectPr>'


@pytest.fixture(scope="module")
def packages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docx")
    (folder / "good.docx").write_bytes(package(BODY))
    (folder / "bad.docx").write_bytes(package(BODY, **{"[Content_Types].xml": None, "word/extra.xml": "<a:b/>", "word/_rels/document.xml.rels": RELS.format("absent.xml")}))
    (folder / "none.docx").write_bytes(b"no archive")
    return docx.read_packages(spark, str(folder))


def named(rows, name):
    return [r for r in rows if name in (r["doc_id"] if "doc_id" in r.asDict() else r["path"])]


def test_blocks(packages):
    rows = named(docx.blocks(packages).orderBy("idx").collect(), "good")
    assert [(r.type, r.text, r.heading_level) for r in rows] == [("p", "Введение", 1), ("p", "Текст.", None), ("p", "7", None), ("tbl", "A B", None), ("p", "Красный", None)]
    assert rows[3]["rows"] == [["A", "B"]]
    assert {r.region_kind for r in S.regions(docx.blocks(packages)).collect()} == {"introduction"}


def test_geometry_rules(packages):
    found = lambda df: {(r.rule, r.severity, r.code) for r in named(df.collect(), "good")}
    assert found(V.page_size(docx.sections(packages))) == set()
    assert found(V.margins(docx.sections(packages))) == {("margins", "error", "section 0")}
    assert found(V.fonts(docx.runs(packages))) == set()
    assert found(V.colours(docx.runs(packages))) == {("colour", "warning", "FF0000 7")}
    body = docx.paras(packages).filter("visible and alignment is not null")
    assert found(V.line_spacing(body)) == set() and found(V.first_line_indent(body)) == set() and found(V.alignment(body)) == set()


def test_package_checks(packages):
    rows = docx.package_problems(packages).collect()
    assert not named(rows, "good")
    assert {r.problem for r in named(rows, "bad")} == {"no content types", "word/extra.xml: prefix a", "word/_rels/document.xml.rels: absent: word/absent.xml"}
    assert [r.problem for r in named(rows, "none")] == ["no archive"]
    assert docx.parts(packages).filter("path like '%good%'").count() == 4
    assert docx.fingerprints(packages).select("fingerprint").distinct().count() == 1
    assert docx.metadata_issues(packages).filter("path like '%good%'").first()["revisions"] == 0


def test_markdown():
    text = "# T\n\nТаблица: Имя\n| a | b\\|c |\n|---|---|\n| 1 | 2 |\nИсточник: сам\n\n1. one\n2. two\n\n3. three\n\n1. new\n- x\n  y\n```py\n# no\n```\n![cap](p.png)\n<!-- c\nd -->\nlast\nmore\n~~~\nopen"
    got = [(b.kind, b.text, b.title, b.items, b.rows, b.problem) for b in markdown.parse(text)]
    assert got == [
        ("heading", "T", "", [], [], None),
        ("table", "", "Имя", [], [["a", "b|c"], ["1", "2"]], None),
        ("list", "", "", ["one", "two", "three"], [], None),
        ("list", "", "", ["new"], [], None),
        ("list", "", "", ["x y"], [], None),
        ("listing", "# no", "", [], [], None),
        ("figure", "p.png", "cap", [], [], None),
        ("paragraph", "last more", "", [], [], None),
        ("listing", "open", "", [], [], "CODE_BLOCK_UNCLOSED"),
    ]
    assert markdown.parse(None) == [] and markdown.parse("") == []


def test_merge():
    old, new = "# A\n\none\n\ntwo\n\nthree\n", "# A\n\none\n\n2\n\nthree\n\nfour\n"
    assert merge.merged_text(old, new) == (new, 2)
    assert merge.merged_text(old, old) == (old, 0)
    assert merge.merged_text("", "x\n") == ("x\n", 1)


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\nnot json\n{"k": 2}\n', encoding="utf-8")
    rows = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k int").orderBy("line_no").collect()
    assert [(r.line_no, r.value and r.value.k, r.error) for r in rows] == [(1, 1, None), (3, None, "not JSON"), (4, 2, None)]
    (tmp_path / "r.json").write_text(json.dumps({"items": [{"id": 1}, {"id": 2}]}), encoding="utf-8")
    assert sorted(r.id for r in files.registry_items(files.read_json(spark, str(tmp_path / "r.json"))).collect()) == [1, 2]
    (tmp_path / "lex.json").write_text(json.dumps({"_comment": "c", "strong": ["a", "b"], "medium": ["c"]}), encoding="utf-8")
    assert files.read_lexicon(spark, str(tmp_path / "lex.json")).count() == 3
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "chapter-2.md").write_text("x", encoding="utf-8")
    (tmp_path / "d" / ".hidden").write_text("x", encoding="utf-8")
    assert files.drafts(spark, str(tmp_path / "d")).select("kind", "number").collect() == [("chapter", 2)]
    assert [r.logical_id for r in files.tracked_files(spark, str(tmp_path / "d")).collect()] == ["chapter-2.md"]
    files.write_new(spark.range(1), str(tmp_path / "new"))
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        files.write_new(spark.range(1), str(tmp_path / "new"))
    files.append_journal(spark.range(1), str(tmp_path / "new"))
    files.write_report(spark.range(5), str(tmp_path / "new"))
    assert spark.read.json(str(tmp_path / "new")).count() == 5


def test_streams_equal_batches(spark, sf, tmp_path):
    events = log(spark, sf)
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    got: dict = {}
    write = lambda df: got.update({r.finding_id: r for r in df.collect()})
    for i in range(3):  # late and early events in any batch
        events.filter(F.pmod(F.xxhash64("seq"), F.lit(3)) == i).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        journal.follow(journal.read_events(spark, str(tmp_path / "in"), schema), str(tmp_path / "log"), str(tmp_path / "check"), write).awaitTermination()
    assert got == {r.finding_id: r for r in A.replay(events).collect()}
    for _ in range(2):
        stream = journal.without_doubles(journal.read_events(spark, str(tmp_path / "in"), schema), "seq")
        journal.into_journal(stream, str(tmp_path / "journal"), str(tmp_path / "check2")).awaitTermination()
        assert spark.read.json(str(tmp_path / "journal")).count() == events.count()
        events.limit(10).coalesce(1).write.mode("append").json(str(tmp_path / "in"))


def test_api(spark, sf):
    m = api.metrics(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(5))
    assert m.count() == 5 and "readability" in m.columns
    assert api.citations(spark.createDataFrame([(1, "a [3; 4]")], "k int, text string"), "k").count() == 2
