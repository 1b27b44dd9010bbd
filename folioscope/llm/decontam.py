"""Benchmark decontamination by a generalised suffix automaton.

The automaton holds all normalised test items, as sequences of word numbers. A document's words run through it, and at each word the length of the longest match that ends there is tracked: from window words on, the last window words are hit; an item shorter than the window is hit as a whole where it ends. Words that no item has end a match, so only runs of known words are walked, and only in documents that hold some window's longest word.

The automaton is broadcast with the tasks. Its size follows the benchmark's, which is checked: a benchmark of over block_bytes of text is dealt into blocks by item id, and the documents pass by one block after the other, at_once blocks in one job; between jobs they are stored. So the driver and each core hold at_once blocks at most, whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import _WORD, ascii_lower, bounded_batches, free_columns, held, stored, words_of

OUTPUT = ("n_words", "n_hit", "longest", "item_ids", "contaminated")


class SuffixAutomaton:
    """All factors of the items. States: transitions, suffix link, length of the longest factor."""

    def __init__(self, items: Sequence[tuple[int | None, Sequence[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for i, words in items if words]
        for _, word_ids in coded:
            last = 0
            for w in word_ids:
                last = self._extend(last, w)
        # state that holds the window at the end of a match: the one on the suffix path whose lengths take the window in
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.window_state = [0] * len(self.length)
        for s in order:
            if self.length[s] >= window:
                up = self.link[s]
                self.window_state[s] = s if self.length[up] < window else self.window_state[up]
        self.items_of: dict[int, set] = {}
        ends: dict[int, list[tuple[int, int | None]]] = {}
        self.shortest = window
        for item, word_ids in coded:
            state = 0
            for n, w in enumerate(word_ids, 1):
                state = self.next[state][w]
                if n >= window:
                    # a prefix of an item may share its state with longer factors; the window's own state is on the path
                    self.items_of.setdefault(self.window_state[state], set()).add(item)
            if len(word_ids) < window:
                ends.setdefault(state, []).append((len(word_ids), item))
                self.shortest = min(self.shortest, len(word_ids))
        # every occurrence of a window holds the window's longest word
        self.anchors = {max(words[i : i + window], key=len) for _, words in items if words for i in range(max(1, len(words) - window + 1))}
        # short items that end where a match ends, the state's own and those of its suffixes
        self.short: list[tuple[tuple[int, int | None], ...]] = [()] * len(self.length)
        for s in order:
            self.short[s] = (*ends.get(s, ()), *self.short[self.link[s]])

    def _clone(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        self.link[state] = len(self.length) - 1
        return self.link[state]

    def _redirect(self, p: int, w: int, old: int, new: int) -> None:
        while p >= 0 and self.next[p].get(w) == old:
            self.next[p][w] = new
            p = self.link[p]

    def _extend(self, last: int, w: int) -> int:
        """The state of the last state's longest factor with one word more."""
        known = self.next[last].get(w)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            clone = self._clone(known, self.length[last] + 1)
            self._redirect(last, w, known, clone)
            return clone
        new = len(self.length)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                clone = self._clone(q, self.length[p] + 1)
                self._redirect(p, w, q, clone)
                self.link[new] = clone
        return new

    def hits(self, words: list[bytes]) -> tuple[bytearray | None, set, int]:
        """(a 0 or 1 for each word, or None where nothing is hit; the items with occurring windows; length of the longest match, or 0 where nothing is hit)."""
        if self.anchors.isdisjoint(words):
            return None, set(), 0
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), dtype=np.int64, count=len(words))
        known = np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])
        edges = np.diff(known)
        flags, items, longest = None, set(), 0
        step, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        for first, end in zip(np.nonzero(edges == 1)[0].tolist(), np.nonzero(edges == -1)[0].tolist()):
            if end - first < self.shortest:
                continue
            state = matched = 0
            for i, w in enumerate(ids[first:end].tolist(), first + 1):
                while state and w not in step[state]:
                    state = link[state]
                    matched = length[state]
                if w in step[state]:
                    state, matched = step[state][w], matched + 1
                if matched > longest:
                    longest = matched
                if matched >= window:
                    flags = flags or bytearray(len(words))
                    flags[i - window : i] = b"\1" * window
                    items |= self.items_of[self.window_state[state]]
                if short[state]:
                    for n, item in short[state]:
                        if n <= matched:
                            flags = flags or bytearray(len(words))
                            flags[i - n : i] = b"\1" * n
                            items.add(item)
        return flags, items, longest if flags else 0


def _automaton(items: tuple, window: int) -> SuffixAutomaton:
    """One automaton in each worker and block."""
    return held("automaton", (items, window), lambda: SuffixAutomaton([(i, words_of(t)) for i, t in items], window))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[tuple, bool]]:
    """The benchmark's (id, text), in blocks of about block_bytes of text, each with whether it is the last one; an item belongs to one block."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).filter("t is not null and t <> ''")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(size // block_bytes) + 1
    for k in range(n):
        own = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield tuple(sorted(((r["i"], r["t"]) for r in own.collect()), key=lambda r: (str(r[0]), r[1]))), k == n - 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 20, text_col: str = "text", keep: Sequence[str] | None = None, clean: bool = False, item_id: str = "item_id", block_bytes: int = 1 << 20, at_once: int = 4) -> DataFrame:
    """docs's columns (or those in keep), n_words, n_hit, longest, item_ids and contaminated; with clean also clean_text, the text without its hit spans (from a hit run's first word to its last). Input columns of these names give way.

    A window is window consecutive words of an item, or a whole item of fewer words (but not none); a document's word inside any occurrence of a window is hit. item_ids are the items with occurring windows (ascending; an item without id is left out of the list); contaminated: any word is hit and coverage * n_hit >= n_words. Null and empty texts have no words; whole texts are read; repeated rows give repeated results; an empty benchmark hits nothing; an empty table gives an empty table.
    """
    names = [*OUTPUT, *(["clean_text"] if clean else [])]
    base = free_columns(docs, names)
    passed = [c for c in (base.columns if keep is None else keep) if c in base.columns]
    item_type = benchmark.schema[item_id].dataType
    df = base.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(passed)], F.col(f"`{text_col}`").cast("string").alias("t"))
    state = [T.StructField("n", T.LongType()), T.StructField("flags", T.BinaryType()), T.StructField("longest", T.IntegerType()), T.StructField("items", T.ArrayType(item_type))]
    out_fields = [*df.schema.fields, *state]
    for k, (block, last) in enumerate(_blocks(benchmark, item_id, "text", block_bytes)):
        schema = T.StructType(out_fields if clean or not last else [f for f in out_fields if f.name != "t"])
        df = bounded_batches(df).mapInArrow(_scan(block, window, k == 0, clean or not last, schema), schema)
        if not last and (k + 1) % at_once == 0:
            df = stored(df, "scanned")
    flags = F.coalesce(F.col("flags").cast("string"), F.lit(""))
    hit = F.length(flags) - F.length(F.replace(flags, F.lit("1"), F.lit("")))
    done = [F.col("n").alias("n_words"), hit.cast("long").alias("n_hit"), F.col("longest"), F.array_sort(F.array_distinct("items")).alias("item_ids")]
    done.append(((hit > 0) & (hit * coverage >= F.col("n"))).alias("contaminated"))
    if clean:
        df = bounded_batches(df).mapInArrow(_cut(df.schema), df.schema)
        done.append(F.col("t").alias("clean_text"))
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(passed)], *done)


def _scan(block: tuple, window: int, first: bool, with_text: bool, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(block, window)
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            n, flags, longest, items = [], [], [], []
            before = zip(columns["flags"].to_pylist(), columns["longest"].to_pylist(), columns["items"].to_pylist()) if not first else iter(lambda: (None, 0, []), 0)
            for text, (old, most, seen) in zip(columns["t"].to_pylist(), before):
                words = words_of(text)
                own, found, length = automaton.hits(words)
                if own is not None:
                    own = bytes(b + 48 for b in own)
                    own = own if old is None else bytes(max(a, b) for a, b in zip(own, old))
                n.append(len(words))
                flags.append(own if own is not None else old)
                longest.append(max(length, most))
                items.append([*seen, *(i for i in found if i is not None and i not in seen)])
            made = {"n": n, "flags": flags, "longest": longest, "items": items}
            kinds = pa.schema([(f.name, _arrow(f.dataType)) for f in schema.fields if f.name in made])
            columns |= {k: pa.array(v, kinds.field(k).type) for k, v in made.items()}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], names=[f.name for f in schema.fields])

    return run


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _cut(schema: T.StructType):
    """Takes hit spans out of the text."""

    def without(text: str | None, flags: bytes | None) -> str | None:
        if text is None or flags is None:
            return text
        spans = [m.span() for m in _WORD.finditer(ascii_lower(text))]
        out, at, i = [], 0, 0
        while i < len(spans):
            if flags[i] == 49:
                j = i
                while j + 1 < len(spans) and flags[j + 1] == 49:
                    j += 1
                out.append(text[at : spans[i][0]])
                at, i = spans[j][1], j
            i += 1
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("t")
            texts = [without(t, f) for t, f in zip(batch.column(i).to_pylist(), batch.column(batch.schema.get_field_index("flags")).to_pylist())]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.column(i).type))

    return run
