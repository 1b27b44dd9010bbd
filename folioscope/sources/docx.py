"""Word packages: parts, body blocks, geometry, and checks of the package.

Packages come from spark.read.format("binaryFile") (path, content). A package is one row, read where it lies.
"""

from __future__ import annotations

import io
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
#: Elements whose text doesn't count, and fonts of code.
DROPPED = {W + "del", W + "moveFrom", MC + "Fallback", W + "pPr"}
MONO = ("consolas", "courier new", "courier", "lucida console", "menlo", "monaco", "dejavu sans mono", "liberation mono", "source code pro", "jetbrains mono", "fira code", "roboto mono", "ubuntu mono", "pt mono", "cascadia code", "cascadia mono")


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _parts(content: bytes) -> list[tuple[str, bytes]]:
    """(name, bytes) in the archive's order, doubled names too; empty for what is no archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [(i.filename, z.read(i)) for i in z.infolist()]
    except zipfile.BadZipFile:
        return []


def _mapped(packages: DataFrame, schema: str, rows: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    kind = T._parse_datatype_string(schema)
    names = kind.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                found = list(rows(path, bytes(content)))
                out = pd.DataFrame(found, columns=names)
                for f in kind.fields:
                    if isinstance(f.dataType, T.IntegerType | T.LongType):
                        out[f.name] = out[f.name].astype("Int64")
                    elif isinstance(f.dataType, T.BooleanType):
                        out[f.name] = out[f.name].astype("boolean")
                yield out

    return packages.select("path", "content").mapInPandas(run, kind)


def parts(packages: DataFrame) -> DataFrame:
    """A row for each entry of each package."""
    return _mapped(packages, "path string, ord int, name string, content binary", lambda path, content: ((path, i, n, b) for i, (n, b) in enumerate(_parts(content))))


class Text:
    """Visible text of runs: a field's code is skipped and its result kept; tabs, breaks and hard hyphens are characters; deleted and fallback content is skipped."""

    def __init__(self):
        self.fields: list[str] = []

    def of(self, element: ET.Element) -> str:
        out = []
        for child in element:
            tag = child.tag
            if tag in DROPPED:
                continue
            if tag == W + "fldChar":
                state = child.get(W + "fldCharType")
                if state == "begin":
                    self.fields.append("code")
                elif state == "separate" and self.fields:
                    self.fields[-1] = "result"
                elif state == "end" and self.fields:
                    self.fields.pop()
            elif tag == W + "t" and "code" not in self.fields:
                out.append(child.text or "")
            elif tag in (W + "tab", W + "br", W + "cr"):
                out.append("\t" if tag == W + "tab" else "\n")
            elif tag == W + "noBreakHyphen":
                out.append("-")
            elif tag not in (W + "instrText", W + "rPr"):
                out.append(self.of(child))
        return "".join(out)


def _val(element: ET.Element | None, path: str, attr: str = "val") -> str | None:
    found = None if element is None else element.find("/".join(W + x for x in path.split("/")))
    return None if found is None else found.get(W + attr)


def _on(element: ET.Element | None, name: str) -> bool | None:
    found = None if element is None else element.find(W + name)
    return None if found is None else found.get(W + "val", "1") not in ("0", "false", "off")


class Styles:
    """Styles with what they are based on: the first value on the chain counts, then the document's default."""

    def __init__(self, root: ET.Element | None):
        self.by_id = {s.get(W + "styleId"): s for s in root.iter(W + "style")} if root is not None else {}
        self.default = root.find(f"{W}docDefaults") if root is not None else None

    def chain(self, style: str | None) -> list[ET.Element]:
        out = []
        while style in self.by_id and self.by_id[style] not in out:
            out.append(self.by_id[style])
            style = _val(out[-1], "basedOn")
        return out

    def first(self, own: ET.Element | None, style: str | None, group: str, path: str, attr: str = "val") -> str | None:
        sources = [own, *(s.find(W + group) for s in self.chain(style))]
        if self.default is not None:
            sources.append(self.default.find(f"{W}{group}Default/{W}{group}"))
        return next((v for s in sources if (v := _val(s, path, attr)) is not None), None)

    def name(self, style: str | None) -> str:
        return _val(self.by_id.get(style), "name") or ""

    def level(self, own: ET.Element | None, style: str | None) -> int | None:
        found = self.first(own, style, "pPr", "outlineLvl")
        if found is not None and int(found) < 9:
            return int(found) + 1
        for s in self.chain(style):
            words = (_val(s, "name") or "").lower().rsplit(" ", 1)
            if words[0] in ("heading", "заголовок") and words[-1].isdigit():
                return int(words[-1])
        return None


def _walk(body: ET.Element) -> Iterator[ET.Element]:
    """Paragraphs, tables and sections in order, through content controls but not through tables of contents."""
    for child in body:
        if child.tag in (W + "p", W + "tbl", W + "sectPr"):
            yield child
        elif child.tag == W + "sdt":
            gallery = _val(child.find(W + "sdtPr"), "docPartObj/docPartGallery") or ""
            if "table of contents" not in gallery.lower() and (content := child.find(W + "sdtContent")) is not None:
                yield from _walk(content)
        elif child.tag == W + "customXml":
            yield from _walk(child)


def _document(content: bytes) -> tuple[ET.Element | None, Styles]:
    have = dict(_parts(content))
    try:
        root = ET.fromstring(have["word/document.xml"])
        styles = Styles(ET.fromstring(have["word/styles.xml"]) if "word/styles.xml" in have else None)
    except (KeyError, ET.ParseError):
        return None, Styles(None)
    return root.find(W + "body"), styles


def _int(x: str | None) -> int | None:
    try:
        return None if x is None else int(float(x))
    except ValueError:
        return None


def _block_rows(path: str, content: bytes) -> Iterator[tuple]:
    body, styles = _document(content)
    for i, e in enumerate(x for x in (_walk(body) if body is not None else ()) if x.tag != W + "sectPr"):
        if e.tag == W + "tbl":
            table = [["\n".join(Text().of(p) for p in c.iter(W + "p")).strip() for c in r.iter(W + "tc")] for r in e.iter(W + "tr")]
            yield (path, i, "tbl", " ".join(c for r in table for c in r if c), None, None, False, False, False, False, False, table)
            continue
        ppr = e.find(W + "pPr")
        style = _val(ppr, "pStyle")
        text = Text().of(e)
        runs = [r for r in e.iter(W + "r") if Text().of(r).strip()]
        name = styles.name(style).lower()
        bold = bool(runs) and all(_on(r.find(W + "rPr"), "b") or (_on(r.find(W + "rPr"), "b") is None and any(_on(s.find(W + "rPr"), "b") for s in styles.chain(style))) for r in runs)
        mono = sum(len(Text().of(r)) for r in runs if (styles.first(r.find(W + "rPr"), style, "rPr", "rFonts", "ascii") or "").lower() in MONO)
        code = bool(runs) and mono >= 0.6 * sum(len(Text().of(r)) for r in runs) or any(x in name for x in ("listing", "листинг", "source code"))
        letters = [c for c in text if c.isalpha()]
        yield (path, i, "p", text, styles.name(style), styles.level(ppr, style), ppr is not None and ppr.find(W + "numPr") is not None, name.startswith(("toc", "оглавление")), code, bold, len(letters) >= 4 and all(c.isupper() for c in letters), None)


def blocks(packages: DataFrame) -> DataFrame:
    """Body blocks in order, as segments.regions takes them."""
    return _mapped(packages, "doc_id string, idx int, type string, text string, style string, heading_level int, in_list boolean, toc boolean, code boolean, bold boolean, upper boolean, rows array<array<string>>", _block_rows)


def _section_rows(path: str, content: bytes) -> Iterator[tuple]:
    body, _ = _document(content)
    for i, s in enumerate(body.iter(W + "sectPr") if body is not None else ()):
        yield (path, i, *(_int(_val(s, "pgSz", a)) for a in ("w", "h")), *(_int(_val(s, "pgMar", a)) for a in ("top", "bottom", "left", "right")))


def sections(packages: DataFrame) -> DataFrame:
    """Page sizes and margins in twips."""
    return _mapped(packages, "doc_id string, section int, width int, height int, top int, bottom int, left int, right int", _section_rows)


def _run_rows(path: str, content: bytes) -> Iterator[tuple]:
    body, styles = _document(content)
    for i, p in enumerate(x for x in (_walk(body) if body is not None else ()) if x.tag == W + "p"):
        style = _val(p.find(W + "pPr"), "pStyle")
        for r in p.iter(W + "r"):
            own = r.find(W + "rPr")
            if n := len(Text().of(r).strip()):
                yield (path, i, n, styles.first(own, style, "rPr", "rFonts", "ascii"), _int(styles.first(own, style, "rPr", "sz")), styles.first(own, style, "rPr", "color"))


def runs(packages: DataFrame) -> DataFrame:
    """Characters of each run with the font, size (half points) and colour that count for it."""
    return _mapped(packages, "doc_id string, idx int, chars int, font string, size int, colour string", _run_rows)


def _para_rows(path: str, content: bytes) -> Iterator[tuple]:
    body, styles = _document(content)
    for i, p in enumerate(x for x in (_walk(body) if body is not None else ()) if x.tag == W + "p"):
        own = p.find(W + "pPr")
        style = _val(own, "pStyle")
        get = lambda path, attr="val", own=own, style=style: styles.first(own, style, "pPr", path, attr)
        rule = get("spacing", "lineRule") or "auto"
        line, indent = _int(get("spacing", "line")), _int(get("ind", "firstLine"))
        breaks = any(b.get(W + "type") == "page" for b in p.iter(W + "br")) or get("pageBreakBefore") is not None and get("pageBreakBefore") not in ("0", "false")
        yield (path, i, (line or 240) / 240 if rule == "auto" else None, rule, (indent or 0) * 2.54 / 1440, get("jc"), breaks, bool(Text().of(p).strip()))


def paras(packages: DataFrame) -> DataFrame:
    """Line spacing, first line's indent, alignment and breaks of paragraphs."""
    return _mapped(packages, "doc_id string, idx int, line double, line_rule string, indent_cm double, alignment string, breaks boolean, visible boolean", _para_rows)


def xml_problems(name: str, data: bytes) -> list[str]:
    """Not well-formed, a document type declaration, or prefixes that aren't declared where they are used."""
    found: list[str] = []
    scopes: list[set[str]] = [{"xml", "xmlns"}]

    def start(tag, attributes):
        own = {a.partition(":")[2] for a in attributes if a.startswith("xmlns:")}
        scopes.append(scopes[-1] | own)
        used = [tag, *(a for a in attributes if not a.startswith("xmlns"))]
        for prefix in (u.partition(":")[0] for u in used if ":" in u):
            if prefix not in scopes[-1] and f"{name}: prefix {prefix}" not in found:
                found.append(f"{name}: prefix {prefix}")

    def doctype(*_):
        raise ValueError

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = start, lambda _: scopes.pop(), doctype
    try:
        parser.Parse(data, True)
    except ValueError:
        return [f"{name}: document type"]
    except expat.ExpatError:
        return [f"{name}: not well-formed"]
    return found


def _simple(data: bytes) -> list[tuple[str, dict[str, str]]]:
    try:
        return [(e.tag.rpartition("}")[2], dict(e.attrib)) for e in ET.fromstring(data).iter()]
    except ET.ParseError:
        return []


def _package_rows(path: str, content: bytes) -> Iterator[tuple]:
    entries = _parts(content)
    if not entries:
        yield (path, "no archive")
        return
    names, have = [n for n, _ in entries], dict(entries)
    folded: dict[str, str] = {}
    for i, n in enumerate(names):
        if n in names[:i]:
            yield (path, f"doubled: {n}")
        elif folded.setdefault(n.lower(), n) != n:
            yield (path, f"same but for case: {n}")
    files = [n for n in have if not n.endswith("/")]
    for n in files:
        if n.lower().endswith((".xml", ".rels")):
            yield from ((path, p) for p in xml_problems(n, have[n]))
    types = _simple(have.get("[Content_Types].xml", b""))
    if "[Content_Types].xml" not in have:
        yield (path, "no content types")
    else:
        by_ext = {a.get("Extension", "").lower() for t, a in types if t == "Default"}
        by_name = {a.get("PartName", "").lstrip("/").lower() for t, a in types if t == "Override"}
        yield from ((path, f"no content type: {n}") for n in files if n != "[Content_Types].xml" and n.lower() not in by_name and n.rpartition(".")[2].lower() not in by_ext)
    known = {n.lower() for n in files}
    for n in (x for x in files if x.lower().endswith(".rels")):
        base = posixpath.dirname(posixpath.dirname(n))
        for tag, a in _simple(have[n]):
            if tag == "Relationship" and a.get("TargetMode", "").lower() != "external":
                target = a.get("Target", "").split("#")[0]
                whole = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(base, target)) if target else ""
                if not a.get("Target"):
                    yield (path, f"{n}: no target")
                elif whole.startswith(".."):
                    yield (path, f"{n}: outside: {target}")
                elif target and whole.lower() not in known:
                    yield (path, f"{n}: absent: {whole}")
    main = [a for t, a in _simple(have.get("_rels/.rels", b"")) if t == "Relationship" and a.get("Type", "").endswith("/officeDocument")]
    if not main:
        yield (path, "no main document")


def package_problems(packages: DataFrame) -> DataFrame:
    """What is wrong with each package: names, XML, content types, relationships, main document."""
    return _mapped(packages, "path string, problem string", _package_rows)


def metadata_issues(packages: DataFrame) -> DataFrame:
    """Counts of what a clean package has none of: insertions and deletions, comments, revision ids, and names of people."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        have = dict(_parts(content))
        body = b"".join(v for k, v in have.items() if k.startswith("word/") and k.endswith(".xml"))
        core = _simple(have.get("docProps/core.xml", b""))
        yield (path, body.count(b"<w:ins ") + body.count(b"<w:del "), sum(k.startswith("word/comments") for k in have), body.count(b"w:rsid"), sum(t in ("creator", "lastModifiedBy") for t, _ in core))

    return _mapped(packages, "path string, revisions int, comment_parts int, rsids int, people int", rows)


def fingerprints(packages: DataFrame) -> DataFrame:
    """SHA-256 of each package's visible text lines, without tables of contents."""
    lines = F.array_sort(F.collect_list(F.struct("idx", F.regexp_replace(F.trim("text"), r"\s+", " ").alias("t"))))
    return blocks(packages).filter("not toc or toc is null").groupBy("doc_id").agg(F.sha2(F.array_join(F.filter(F.transform(lines, lambda x: x["t"]), lambda t: t != ""), "\n").cast("binary"), 256).alias("fingerprint"))
