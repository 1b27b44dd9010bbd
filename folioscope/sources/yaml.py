"""YAML of registries and settings: block maps and lists by indentation, inline lists, quotes and comments.

Texts are taken apart by column expressions, all lines of a text in one pass; where a line belongs is told by the nearest line above it that is less indented, which an ordered walk over a text's lines finds with a stack as deep as the text is nested. Anchors, tags, block scalars and several documents in one text aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioscope.functions import text as X
from folioscope.operators.deal import dealt_by, small_batches

_ITEM = r"""((?:"[^"]*(?:"|$)|'[^']*(?:'|$)|[^"',])*+)(?:,|$)"""
#: Each line's part before a comment. A quote holds all up to the next one of its kind, or up to the line's end.
_CODE = r"""(?md)^((?:[^"'#\n]++|"[^"\n]*+"?+|'[^'\n]*+'?+|(?<=[^ \t\n])#)*+)[^\n]*+"""
#: The end of a line's text; a sign that other systems end lines with, and that a full stop doesn't match, may stand before it.
_END = r"(?=[ ]*+$|[\r\u0085\u2028\u2029][ ]*+$)"
_REST = r"(?-d:.*)"
#: Each line's indent, dash, name, value behind a name, value without one, and what is left: one of the values is empty. All are empty for a blank line and for what begins a document.
_LINE = rf"""(?md)^(?:[ ]*+(?:---[ ]*+)?+$|([ ]*)(-(?:[ ]+|{_END}))?(?:("[^"\n]*"|'[^'\n]*'|(?=[^:\n]*+:)[^\s"'\[{{#:-][^:]*?)[ ]*:(?:[ ]+({_REST})|[ ]*){_END}|({_REST}))([^\n]*+))"""
_WRITTEN, _PARTS = "$1\n$2\n$3\n$4$5\n$6", 5


def line_parts(text: Column) -> Column:
    """A text with each of its lines written as _PARTS lines, one for each part. A comment stands behind a number sign that begins a line or follows a blank, outside of quotes."""
    text = F.when(F.startswith(text, F.lit("\uFEFF")), F.substring(text, F.lit(2), F.length(text))).otherwise(text)
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    code = F.when(F.contains(text, F.lit("#")), F.regexp_replace(text, _CODE, "$1")).otherwise(text)
    return F.regexp_replace(code, _LINE, _WRITTEN)


def unquoted(value: Column) -> Column:
    """A value without the pair of quotes around it; white space outside of them goes."""
    v = F.trim(value)
    pair = (F.length(v) >= 2) & ((F.startswith(v, F.lit('"')) & F.endswith(v, F.lit('"'))) | (F.startswith(v, F.lit("'")) & F.endswith(v, F.lit("'"))))
    return F.when(pair, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)


def inline_items(value: Column) -> Column:
    """The items of [a, "b, c", 'd'], unquoted; empty items are left out. Null for what is no inline list."""
    v = F.trim(value)
    body = F.regexp_extract(v, r"^\[(.*)\]$", 1)
    items = F.regexp_extract_all(body, F.lit(_ITEM), F.lit(1))
    return F.when(F.startswith(v, F.lit("[")) & v.rlike(r"^\[.*\]$"), F.transform(F.filter(items, lambda i: F.trim(i) != ""), unquoted))


def _tree() -> Callable[[str], tuple[list[str | None], list[str | None]]]:
    """A step for each text of a key: the path of each line's value and the value, or nothing where a line has none."""
    stack: list[tuple[int, bool, int, str]] = []  # indent, is it a list's item, its number, path up to it

    def step(text: str) -> tuple[list[str | None], list[str | None]]:
        paths: list[str | None] = []
        raws: list[str | None] = []
        parts = iter(text.split("\n"))
        for blanks, dash, key, value, left in zip(*[parts] * _PARTS):
            path = raw = None
            if blanks or dash or key or value or left:
                indent = len(blanks)
                if dash:
                    # an item hangs on a list at its own indent, or on the key above it
                    while stack and stack[-1][0] > indent:
                        stack.pop()
                    number = stack.pop()[2] + 1 if stack and stack[-1][1] and stack[-1][0] == indent else 0
                    above = f"{stack[-1][3] if stack else ''}[{number}]"
                    stack.append((indent, True, number, above))
                    indent += max(len(dash), 2)
                else:
                    while stack and stack[-1][0] >= indent:
                        stack.pop()
                    above = stack[-1][3] if stack else ""
                raw = value.strip(" ") or None
                if key:
                    name = key[1:-1] if key[0] in "\"'" else key
                    above = f"{above}.{name}" if above else name
                    if not raw:
                        stack.append((indent, False, 0, above))
                path = above if raw else None
            paths.append(path)
            raws.append(raw)
        return paths, raws

    return step


_FOUND = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("raw", T.StringType())]))


def _walked(texts: DataFrame, by: Sequence[str]) -> DataFrame:
    """by and found: the path and the value of each line of texts, whose lines line_parts has taken apart and whose rows are dealt out by key. A walk holds the stack of one key."""
    schema = T.StructType([*(texts.schema[c] for c in by), T.StructField("found", _FOUND)])
    out_schema, width = to_arrow_schema(schema), len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = None, None
        for batch in batches:
            paths: list[str | None] = []
            raws: list[str | None] = []
            ends = [0]
            keys = zip(*(c.to_pylist() for c in batch.columns[:width]))
            for key, text in zip(keys, batch.columns[width].to_pylist()):
                if step is None or key != at:
                    at, step = key, _tree()
                own_paths, own_raws = step(text)
                paths += own_paths
                raws += own_raws
                ends.append(len(paths))
            kind = out_schema.field("found").type
            lines = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(raws, pa.string())], fields=[kind.value_type.field(i) for i in range(2)])
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines, type=kind)
            own = [c.cast(f.type) for c, f in zip(batch.columns[:width], out_schema)]
            yield pa.RecordBatch.from_arrays([*own, found], schema=out_schema)

    return small_batches(texts).sortWithinPartitions(*by, "__text").mapInArrow(run, schema)


def values(texts: DataFrame, by: Sequence[str], text_col: str) -> DataFrame:
    """by, line, path and value of each value in texts: paths as sources[0].title, items of inline lists numbered behind their path. Texts of by that repeats are read as one, one behind the other in a fixed order; null and empty texts have no values.

    Whole texts are dealt out by key, sorted and walked, and lines are rows only once they have their values: a row for each line costs more to sort and to send to a walk than the line's step."""
    # an empty text instead of a filter, which would make the text twice
    dealt = dealt_by(texts.select(*by, X.null_empty(F.col(text_col)).alias("__text")), *by)
    found = _walked(dealt.select(*by, line_parts(F.col("__text")).alias("__text")), by).select(*by, F.posexplode("found").alias("line", "v")).select(*by, "line", "v.path", "v.raw").filter("raw IS NOT NULL")
    items = F.transform(inline_items(F.col("raw")), lambda v, i: F.struct(F.concat(F.col("path"), F.lit("["), i.cast("string"), F.lit("]")).alias("path"), v.alias("value")))
    # items in a column of their own: what stands beside a lambda in explode isn't compiled
    found = found.select(*by, "line", "path", unquoted(F.col("raw")).alias("value"), items.alias("__items"))
    return found.select(*by, "line", F.explode(F.coalesce("__items", F.array(F.struct("path", "value")))).alias("v")).select(*by, "line", "v.path", "v.value")


_ALL = (1 << 31) - 1


def records(found: DataFrame, by: Sequence[str], root: str, fields: Sequence[str]) -> DataFrame:
    """A row for each record of a list under root (by, its number, and the fields as text, null where a record hasn't one). root is a path as it is written."""
    own = found.filter(F.startswith("path", F.lit(f"{root}["))).select(*by, F.substring("path", len(root) + 2, _ALL).alias("__rest"), "value")
    own = own.filter(F.contains("__rest", F.lit("]."))).select(*by, F.substring_index("__rest", "].", 1).alias("__number"), "__rest", "value")
    own = own.filter((F.col("__number") != "") & (F.translate("__number", "0123456789", "") == ""))
    own = own.select(*by, F.col("__number").cast("int").alias("number"), F.substring("__rest", F.length("__number") + 3, F.lit(_ALL)).alias("field"), "value")
    return own.groupBy(*by, "number").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f.replace(".", "_").replace("[", "_").replace("]", "")) for f in fields])


def allowlist(found: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """by and phrase: what a setting allows, as one value, an inline list or a list in lines; normalised, each once."""
    own = found.filter(F.col("path").rlike(rf"^{key}(\[\d+\])?$") & ~F.col("value").isin("~", "null", "None"))
    return own.select(*by, X.normalise_phrase(F.col("value")).alias("phrase")).filter("phrase <> ''").distinct()
