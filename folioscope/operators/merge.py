"""Differences of block sequences, and drafts with an import's changes.

The longest common subsequence isn't relational: each pair of documents is one group, compared by difflib where it lies; a pair's blocks are those of two versions of one document. Bags of blocks are compared as tables.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators.deal import small_batches
from folioscope.sources.markdown import parse


def signature(kind: Column, text: Column, level: Column | None = None) -> Column:
    """What two blocks are compared by: kind, level and the text with single blanks."""
    return F.sha2(F.concat_ws("|", kind, X.null_empty(level) if level is not None else F.lit(""), X.collapse_space(text)), 256)


def bag_diff(old: DataFrame, new: DataFrame, by: str, sig: str = "sig") -> DataFrame:
    """Blocks that only one side has, as often as it has more of them."""
    a, b = old.select(by, sig), new.select(by, sig)
    return a.exceptAll(b).withColumn("side", F.lit("old")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))


OPS = "doc string, op string, old_from int, old_to int, new_from int, new_to int"


def sequence_diff(old: DataFrame, new: DataFrame, by: str, order: str = "idx", sig: str = "sig") -> DataFrame:
    """Steps that turn the old sequence of each document into the new one: equal, replace, delete, insert."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        key = str((a if len(a) else b)["k"].iloc[0])
        left, right = (list(x.sort_values("o")["s"]) if len(x) else [] for x in (a, b))
        steps = difflib.SequenceMatcher(a=left, b=right, autojunk=False).get_opcodes()
        return pd.DataFrame([(key, *s) for s in steps], columns=[c.split()[0] for c in OPS.split(", ")])

    side = lambda df: df.select(F.col(by).cast("string").alias("k"), F.col(order).alias("o"), F.col(sig).alias("s"))
    return side(old).groupBy("k").cogroup(side(new).groupBy("k")).applyInPandas(run, OPS)


def merged_text(old: str, new: str) -> tuple[str, int]:
    """The old draft with the new one's blocks where they differ, and how many blocks changed; what is between unchanged blocks stays."""
    a, b = parse(old), parse(new)
    key = lambda x: (x.kind, x.level, " ".join(x.text.split()), x.title, tuple(x.items), tuple(map(tuple, x.rows)))
    lines, fresh, changed = old.split("\n"), new.split("\n"), 0
    for tag, i1, i2, j1, j2 in reversed(difflib.SequenceMatcher(a=[key(x) for x in a], b=[key(x) for x in b], autojunk=False).get_opcodes()):
        if tag == "equal":
            continue
        changed += max(i2 - i1, j2 - j1)
        body = fresh[b[j1].first_line : b[j2 - 1].end_line] if j1 < j2 else []
        first = a[i1].first_line if i1 < i2 else a[i1 - 1].end_line if i1 else 0
        end = a[i2 - 1].end_line if i1 < i2 else first
        lines[first:end] = body if i1 < i2 else ["", *body, ""]
    out = [x for i, x in enumerate(lines) if x.strip() or i == 0 or lines[i - 1].strip()]
    return "\n".join(out).strip("\n") + "\n", changed


def merge_drafts(pairs: DataFrame, key: str, old: str = "old", new: str = "new") -> DataFrame:
    """key, merged and changed for rows with an old and a new draft."""
    schema = f"k {pairs.schema[key].dataType.simpleString()}, merged string, changed int"

    def run(batches):
        for batch in batches:
            done = [merged_text(o or "", n or "") for o, n in zip(batch["o"], batch["n"])]
            yield pd.DataFrame({"k": batch["k"], "merged": [d[0] for d in done], "changed": [d[1] for d in done]})

    return small_batches(pairs).select(F.col(key).alias("k"), F.col(old).alias("o"), F.col(new).alias("n")).mapInPandas(run, schema).withColumnRenamed("k", key)
