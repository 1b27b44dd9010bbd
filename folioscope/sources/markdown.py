"""Markdown drafts as rows of blocks.

A line machine over one draft: each line gets a class, and a small state (what is open) decides what it joins. Drafts are rows of text; they are parsed where they lie, batch by batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioscope.operators.deal import small_batches

FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})\s*([\w+#.-]*)\s*$")
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
FIGURE = re.compile(r"^!\[([^\]]*)\]\(([^)]+)\)\s*$")
ITEM = re.compile(r"^(\s*)([-*+]|\d{1,3}[.)])\s+(.*)$")
RULE = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*$")
#: Lines that caption a table or listing, and that name a table's source.
TABLE_CAPTION = re.compile(r"^Таблица\s*(?:\d+(?:\.\d+)*)?\s*[:.—–-]\s*(.+)$", re.IGNORECASE)
LISTING_CAPTION = re.compile(r"^Листинг\s*(?:\d+(?:\.\d+)*)?\s*[:.—–-]\s*(.+)$", re.IGNORECASE)
SOURCE = re.compile(r"^Источник\s*:\s*(.+)$", re.IGNORECASE)

BLOCK = T.StructType(
    [
        T.StructField("idx", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("ordered", T.BooleanType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("first_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("problem", T.StringType()),
    ]
)


@dataclass
class Block:
    kind: str
    first_line: int
    end_line: int
    level: int | None = None
    text: str = ""
    title: str = ""
    source: str = ""
    ordered: bool | None = None
    items: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    problem: str | None = None
    last: int = 0
    lines: int = 1


def cells(line: str) -> list[str]:
    """A pipe row's cells; a pipe behind a backslash is text."""
    inner = line.strip().removeprefix("|")
    inner = inner[:-1] if inner.endswith("|") and not inner.endswith("\\|") else inner
    return [c.replace("\0", "|").strip() for c in inner.replace("\\|", "\0").split("|")]


def without_comments(lines: list[str], code: set[int]) -> list[str]:
    """Lines without HTML comments outside of code; their number stays."""
    held = {i: lines[i] for i in code}
    text = "\n".join("" if i in code else line for i, line in enumerate(lines))
    plain = re.sub(r"<!--.*?-->", lambda m: "\n" * m[0].count("\n"), text, flags=re.DOTALL).split("\n")
    return [held.get(i, line) for i, line in enumerate(plain)]


def fenced(lines: list[str]) -> list[tuple[int, int, str, bool]]:
    """(first line, end, language, closed) of each fenced block; an open one runs to the end."""
    out, mark, first, language = [], "", 0, ""
    for i, line in enumerate(lines):
        m = FENCE.match(line)
        if m and not mark:
            mark, first, language = m[1], i, m[2]
        elif m and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not m[2]:
            out.append((first, i + 1, language, True))
            mark = ""
    return [*out, (first, len(lines), language, False)] if mark else out


class Parser:
    def __init__(self, text: str):
        self.raw = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.code = {first: (end, language, closed) for first, end, language, closed in fenced(self.raw)}
        self.lines = without_comments(self.raw, {i for a, (b, _, _) in self.code.items() for i in range(a, b)})
        self.out: list[Block] = []

    def special(self, i: int) -> bool:
        line = self.lines[i]
        return i in self.code or bool(HEADING.match(line) or FIGURE.match(line) or ITEM.match(line)) or line.strip().startswith("|")

    def caption(self, pattern: re.Pattern, block: Block) -> None:
        """A one-line paragraph right before a block that captions it goes into the block."""
        if self.out and self.out[-1].kind == "paragraph" and self.out[-1].lines == 1 and (m := pattern.match(self.out[-1].text)):
            block.title, block.first_line = m[1].strip(), self.out.pop().first_line

    def parse(self) -> list[Block]:
        i = 0
        while i < len(self.lines):
            i = self.step(i) if self.lines[i].strip() or i in self.code else i + 1
        return self.out

    def step(self, i: int) -> int:
        line = self.lines[i]
        if i in self.code:
            end, language, closed = self.code[i]
            block = Block("listing", i, end, text="\n".join(self.raw[i + 1 : end - closed]), source=language, problem=None if closed else "CODE_BLOCK_UNCLOSED")
            self.caption(LISTING_CAPTION, block)
        elif m := HEADING.match(line):
            block = Block("heading", i, i + 1, level=len(m[1]), text=m[2].strip())
        elif m := FIGURE.match(line):
            block = Block("figure", i, i + 1, title=m[1].strip(), text=re.sub(r'\s+"[^"]*"$', "", m[2]).strip())
        elif line.strip().startswith("|"):
            block = self.table(i)
        elif m := ITEM.match(line):
            return self.item(i, m)
        else:
            end = i + 1
            while end < len(self.lines) and self.lines[end].strip() and not self.special(end):
                end += 1
            block = Block("paragraph", i, end, text=" ".join(x.strip() for x in self.lines[i:end]), lines=end - i)
        self.out.append(block)
        return block.end_line

    def table(self, i: int) -> Block:
        end = i
        while end < len(self.lines) and self.lines[end].strip().startswith("|"):
            end += 1
        block = Block("table", i, end, rows=[cells(x) for x in self.lines[i:end] if not RULE.match(x)])
        self.caption(TABLE_CAPTION, block)
        block.problem = None if block.title else "TABLE_NO_CAPTION"
        for k in range(end, min(end + 3, len(self.lines))):
            if self.lines[k].strip():
                m = SOURCE.match(self.lines[k].strip())
                if m and (k + 1 == len(self.lines) or not self.lines[k + 1].strip() or self.special(k + 1)):
                    block.source, block.end_line = m[1].strip(), k + 1
                break
        return block

    def item(self, i: int, m: re.Match) -> int:
        number = int(m[2][:-1]) if m[2][0].isdigit() else 0
        ordered = number > 0 or m[2][0].isdigit()
        before = self.out[-1] if self.out else None
        joins = before is not None and before.kind == "list" and before.ordered == ordered
        if joins:
            beside = before.end_line == i
            joins = not (ordered and number == 1 and before.last >= 2) if beside else not ordered or number == before.last + 1
        block = before if joins else Block("list", i, i + 1, ordered=ordered)
        if not joins:
            self.out.append(block)
        if len(m[1].expandtabs(4)) >= 2:
            block.problem = "LIST_NESTED"
        end = i + 1
        while end < len(self.lines) and self.lines[end].strip() and not self.special(end):
            end += 1
        block.items.append(" ".join([m[3].strip(), *(x.strip() for x in self.lines[i + 1 : end])]))
        block.last, block.end_line = number, end
        return end


def parse(text: str | None) -> list[Block]:
    return Parser(text or "").parse()


def md_blocks(drafts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row for each block of each draft: key and BLOCK's fields."""
    schema = T.StructType([T.StructField("key", drafts.schema[key].dataType), *BLOCK.fields])
    names = [f.name for f in BLOCK.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *(i if n == "idx" else getattr(b, n) for n in names)) for k, t in zip(batch["key"], batch["text"]) for i, b in enumerate(parse(t))]
            out = pd.DataFrame(rows, columns=["key", *names])
            yield out.astype({"level": "Int32", "ordered": "boolean"})

    return small_batches(drafts).selectExpr(f"`{key}` as key", f"`{text}` as text").mapInPandas(run, schema).withColumnRenamed("key", key)
