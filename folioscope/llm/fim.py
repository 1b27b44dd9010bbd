"""Fill-in-the-middle transformation by a parallel automaton scan.

A text is cut into lines, and two cuts between lines make a prefix, a middle and a suffix, which are written in another order behind marks. One automaton follows both where lines start and whether a mark occurs. A chunk of bytes is scanned without knowing the state it is entered in: it gives its transition function (the end state for each start state) and the number of lines that start in it for each start state. Functions compose associatively, so neighbours are joined in a tree, first inside chunks, then over the chunks of a text; that resolves the state and the line number at each chunk's start, and tells which chunk holds a cut. Only that chunk is looked at again.

Texts of one chunk are done where they are read. Giant texts are dealt out by chunk, so that one text is scanned by many tasks; only functions come back, at most 32,768 of 64 KB for a text, as a row holds 2 GB at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import adding_columns, bounded_batches, settled

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
OUTPUT = ("n_units", "form", "prefix_chars", "middle_chars", "output")
NEWLINE = 10


class Automaton:
    """Follows lines (`[^\\n]*\\n|[^\\n]+`) and marks over the bytes of UTF-8. A state is a line state (0: a line starts with the next byte, 1: inside a line) and what was read of a mark."""

    def __init__(self, marks: Sequence[str] = MARKS):
        marked = [m.encode() for m in marks]
        seen = [b"", *sorted({m[:k] for m in marked for k in range(1, len(m))}, key=lambda p: (len(p), p))]
        own = sorted({NEWLINE, *b"".join(marked)})
        self.classes = bytes(own.index(b) + 1 if b in own else 0 for b in range(256))
        self.found = len(seen)
        width = len(seen) + 1
        self.states = 2 * width
        self.step = np.zeros((len(own) + 1, self.states), dtype=np.uint8)
        self.starts = np.zeros((len(own) + 1, self.states), dtype=np.int64)
        for c, byte in enumerate([None, *own]):
            for state in range(self.states):
                line, part = divmod(state, width)
                if part != self.found:
                    read = seen[part] + (bytes([byte]) if byte is not None else b"\xff")
                    if any(m in read for m in marked):
                        part = self.found
                    else:
                        part = max(i for i, p in enumerate(seen) if read.endswith(p))
                self.step[c, state] = (0 if byte == NEWLINE else width) + part
                self.starts[c, state] = line == 0
        #: classes of which a run acts as one byte does
        self.same = np.array([bool((s[s] == s).all() and not n[s].any()) for s, n in zip(self.step, self.starts)])
        self.width = width

    def marked(self, state: np.ndarray) -> np.ndarray:
        """Whether a mark was read on the way to a state."""
        return state % self.width == self.found

    def in_line(self, state: int) -> bool:
        return state >= self.width

    def functions(self, chunks: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(end state, number of lines that start) of each chunk, for each start state."""
        ends = np.tile(np.arange(self.states, dtype=np.uint8), (len(chunks), 1))
        starts = np.zeros((len(chunks), self.states), dtype=np.int64)
        symbol = np.frombuffer(b"".join(chunks).translate(self.classes), dtype=np.uint8)
        if not len(symbol):
            return ends, starts
        chunk = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
        keep = np.append(True, (symbol[1:] != symbol[:-1]) | ~self.same[symbol[1:]] | (chunk[1:] != chunk[:-1]))
        symbol, chunk = symbol[keep], chunk[keep]
        end, start, chunk = composed(self.step[symbol], self.starts[symbol], chunk)
        ends[chunk], starts[chunk] = end, start
        return ends, starts


def composed(end: np.ndarray, start: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions of each owner, in order, composed into one: in each round neighbours become one function. Owners are ascending."""
    while len(owner) > 1 and (owner[1:] == owner[:-1]).any():
        first = np.append(True, owner[1:] != owner[:-1])
        at = np.arange(len(owner))
        place = at - np.maximum.accumulate(np.where(first, at, 0))
        left = np.nonzero(place % 2 == 0)[0]
        pair = left[np.append(owner[1:] == owner[:-1], False)[left]]
        e, s = end[left], start[left]
        rows = np.searchsorted(left, pair)
        s[rows] += np.take_along_axis(start[pair + 1], end[pair].astype(np.int64), axis=1)
        e[rows] = np.take_along_axis(end[pair + 1], end[pair].astype(np.int64), axis=1)
        end, start, owner = e, s, owner[left]
    return end, start, owner


def line_start(chunk: bytes, in_line: bool, k: int) -> int:
    """Place of the k-th line start (from 0) in a chunk that is entered inside a line or at a line's start."""
    if not in_line:
        if k == 0:
            return 0
        k -= 1
    breaks = np.nonzero(np.frombuffer(chunk, dtype=np.uint8) == NEWLINE)[0]
    return int(breaks[k]) + 1


def chars(data: bytes) -> int:
    """Code points of a piece of UTF-8, each counted at its first byte."""
    return int(((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80).sum())


def transformed(text: bytes, form: str, low: int, high: int, marks: Sequence[str] = MARKS) -> bytes:
    """The text in its form; low and high are the places of its cuts."""
    p, s, m = (x.encode() for x in marks)
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if form == "psm":
        return b"".join((p, prefix, s, suffix, m, middle))
    return b"".join((s, suffix, p, prefix, m, middle)) if form == "spm" else text


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


MADE = [T.StructField("n_units", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("bytes", T.BinaryType())]
_MADE_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())


def _made(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate(_MADE_TYPES)]


def _form(text: bytes, marked: bool, wanted: str) -> str:
    return "plain" if not text or marked else wanted


def _short(automaton: Automaton, marks: Sequence[str]):
    """Rows of one chunk: text, draws and wanted form to the made columns."""

    def work(texts: list[bytes], one: list[int], two: list[int], wanted: list[str]) -> list[tuple]:
        ends, starts = automaton.functions(texts)
        out = []
        for text, end, n, a, b, form in zip(texts, ends[:, 0], starts[:, 0].tolist(), one, two, wanted):
            form = _form(text, bool(automaton.marked(end)), form)
            if form == "plain":
                out.append((n, form, None, None, text))
                continue
            low, high = (len(text) if k == n else line_start(text, False, k) for k in sorted((a % (n + 1), b % (n + 1))))
            out.append((n, form, chars(text[:low]), chars(text[low:high]), transformed(text, form, low, high, marks)))
        return out

    return work


PIECE = T.StructType([T.StructField("row", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("one", T.LongType()), T.StructField("two", T.LongType()), T.StructField("data", T.BinaryType())])
FUNCTION = T.StructType([*PIECE.fields[:4], T.StructField("size", T.LongType()), T.StructField("ends", T.BinaryType()), T.StructField("starts", T.BinaryType())])
RESOLVED = T.StructType([T.StructField("row", T.LongType()), T.StructField("n", T.LongType()), T.StructField("marked", T.BooleanType()), *(T.StructField(f"{side}_{what}", T.LongType()) for side in ("low", "high") for what in ("piece", "state", "line"))])


def _giants(giants: DataFrame, passed: list[str], automaton: Automaton, marks: Sequence[str], chunk_bytes: int) -> DataFrame:
    """Rows of several chunks, as _short makes them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, one, two, text in zip(*(c.to_pylist() for c in batch.columns)):
                for at in range(0, len(text), chunk_bytes * 16):
                    data = [text[k : k + chunk_bytes] for k in range(at, min(at + chunk_bytes * 16, len(text)), chunk_bytes)]
                    n, first = len(data), at // chunk_bytes
                    yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array(range(first, first + n), pa.int32()), pa.array([one] * n, pa.int64()), pa.array([two] * n, pa.int64()), pa.array(data, pa.binary())], names=PIECE.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(4).to_pylist()
            ends, starts = automaton.functions(data)
            made = [pa.array([len(d) for d in data], pa.int64()), pa.array([e.tobytes() for e in ends], pa.binary()), pa.array([s.astype("<i8").tobytes() for s in starts], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], names=FUNCTION.names)

    def resolve(table: pa.Table) -> pa.Table:
        """Of one text: its lines, whether a mark occurs, and for each cut its chunk, the state that is entered in and the line start there (piece -1: the text's end)."""
        table = table.sort_by("piece")
        ends = np.stack([np.frombuffer(e, dtype=np.uint8) for e in table["ends"].to_pylist()])
        starts = np.stack([np.frombuffer(s, dtype="<i8") for s in table["starts"].to_pylist()])
        entered, before, state, n = [], [], 0, 0
        for end, start in zip(ends, starts):
            entered.append(state)
            before.append(n)
            state, n = int(end[state]), n + int(start[state])
        one, two = table["one"][0].as_py(), table["two"][0].as_py()
        found = [table["row"][0].as_py(), n, bool(automaton.marked(np.array(state)))]
        for k in sorted((one % (n + 1), two % (n + 1))):
            piece = int(np.searchsorted(before, k, side="right")) - 1
            found += [-1, 0, 0] if k == n else [piece, entered[piece], k - before[piece]]
        return pa.Table.from_arrays([pa.array([v]) for v in found], names=RESOLVED.names)

    pieces = giants.select("row", "one", "two", "t").mapInArrow(cut, PIECE).repartition("row", "piece")
    resolved = bounded_batches(pieces).mapInArrow(scan, FUNCTION).groupBy("row").applyInArrow(resolve, RESOLVED)
    located = giants.join(resolved, "row").select(*passed, "wanted", *RESOLVED.names[1:], "t")
    schema = T.StructType([*(located.schema[c] for c in passed), *MADE])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def place(text, piece, state, line):
            return len(text) if piece < 0 else piece * chunk_bytes + line_start(text[piece * chunk_bytes : (piece + 1) * chunk_bytes], automaton.in_line(state), line)

        for batch in batches:
            rest, rows = batch.columns[: len(passed)], []
            for form, n, marked, *cuts, text in zip(*(c.to_pylist() for c in batch.columns[len(passed) :])):
                form = _form(text, marked, form)
                if form == "plain":
                    rows.append((n, form, None, None, text))
                    continue
                low, high = place(text, *cuts[:3]), place(text, *cuts[3:])
                rows.append((n, form, chars(text[:low]), chars(text[low:high]), transformed(text, form, low, high, marks)))
            yield pa.RecordBatch.from_arrays([*rest, *_made(rows)], names=schema.names)

    return located.mapInArrow(finish, schema)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "7", percent: int = 100, spm_percent: int = 50, marks: Sequence[str] = MARKS, chunk_bytes: int = 1 << 16
) -> DataFrame:
    """docs with n_units, form, prefix_chars, middle_chars and output; all other columns stay, input columns of these names give way.

    The draws are the first four 8-digit groups of the sha256 of seed, a colon and the id (null: nothing behind the colon). With n lines, the prefix ends after the smaller and the middle after the larger of the first two draws modulo n + 1. form is plain if the text is empty (as null is) or holds a mark, or if the third draw modulo 100 is percent or more; else spm if the fourth modulo 100 is below spm_percent, else psm. output: the text (plain), marks with prefix, suffix and middle (psm), or with suffix, prefix and middle (spm). prefix_chars and middle_chars are code points, null where plain.

    Rows are worked on one by one: repeated ids and texts have equal results where both are equal. An empty table gives an empty table. Whole texts are read; those of over chunk_bytes bytes are scanned by chunk, in tasks of their own.
    """
    automaton = Automaton(marks)

    def work(d: DataFrame, name: dict[str, str]) -> DataFrame:
        d = settled(d)
        passed = d.columns
        digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(name[id_col]).cast("string"), F.lit(""))).cast("binary"), 256)
        draw = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
        wanted = F.when(draw[2] % 100 >= percent, "plain").when(draw[3] % 100 < spm_percent, "spm").otherwise("psm")
        text = F.coalesce(F.col(name[text_col]).cast("string"), F.lit("")).cast("binary")
        rows = d.select(*passed, draw[0].alias("one"), draw[1].alias("two"), wanted.alias("wanted"), text.alias("t"))
        short = rows.filter(F.octet_length("t") <= chunk_bytes)
        giants = d.select(*passed, F.monotonically_increasing_id().alias("row"), draw[0].alias("one"), draw[1].alias("two"), wanted.alias("wanted"), text.alias("t")).filter(F.octet_length("t") > chunk_bytes)
        schema = T.StructType([*(d.schema[c] for c in passed), *MADE])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make = _short(automaton, marks)
            for batch in batches:
                *rest, one, two, wanted, texts = batch.columns
                yield pa.RecordBatch.from_arrays([*rest, *_made(make(texts.to_pylist(), one.to_pylist(), two.to_pylist(), wanted.to_pylist()))], names=schema.names)

        both = bounded_batches(short).mapInArrow(run, schema).unionByName(_giants(giants, passed, automaton, marks, chunk_bytes))
        return both.withColumn("output", F.col("bytes").cast("string")).drop("bytes")

    return adding_columns(docs, OUTPUT, work)
