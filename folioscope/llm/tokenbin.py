"""Token files in Simple-8b.

A block holds the ids of whole documents, one behind the other; each document begins with a word of its own. A word has 64 bits: the upper four select how many ids of how many bits the lower sixty hold (behind a document's last id they are zeros). Ids of over sixty bits are escapes: a zero stands in their place, and place and value follow behind the words. A block's payload, little-endian: 4 bytes magic, counts of documents, words and escapes (32 bits each), each document's number of ids and then of words (32 bits each), the words, the escapes' places (number of the id in the block, 32 bits each) and values (64 bits each). So blocks can be joined without being packed anew.

Blocks are rows of Parquet files (written and committed by Spark, on any store): part, seq, start (ids before the block in its part), n_ids, doc_ids, ends (end of each document in the block) and payload. With ends every document of a block can be reached without its neighbours.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.bpe import WINDOW, codec
from folioscope.llm.common import bounded_batches, shared_dir

MAGIC = b"S8B2"
#: Fixed values of the format: (ids, bits of each) by selector.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNTS = np.array([n for n, _ in SELECTORS], dtype=np.int64)
_LONGEST = int(_COUNTS.max())
#: Bits of each number below 2^16.
_BITS = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits of each value (below 2^60)."""
    if not len(values) or int(values.max()) < len(_BITS):
        return _BITS[values]
    low, high = (values & np.uint64(0x3FFFFFFF)).astype(np.float64), (values >> np.uint64(30)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 30, np.frexp(low)[1]).astype(np.uint8)


def _selected(bits: np.ndarray) -> np.ndarray:
    """The selector of a word that begins at each place but the last _LONGEST ones: the first one whose bits suffice. Selectors hold ever fewer ids of ever more bits, so it is the number of those that don't do."""
    n = len(bits) - _LONGEST
    spans, width = {1: bits}, 1
    while width * 2 <= _LONGEST:
        spans[width * 2] = np.maximum(spans[width][:-width], spans[width][width:])
        width *= 2
    out = np.zeros(n, dtype=np.uint8)
    for count, size in SELECTORS[:-1]:
        p = 1 << (count.bit_length() - 1)
        out += np.maximum(spans[p][:n], spans[p][count - p : count - p + n]) > size
    return out


def pack(ids: np.ndarray, ends: Sequence[int] | None = None) -> list[bytes]:
    """A block's payload for each document: ids are unsigned integers of up to 64 bits, document after document; ends are the documents' ends (none: one document)."""
    ends = np.array([len(ids)] if ends is None else ends, dtype=np.int64)
    starts = np.append(0, ends[:-1])
    sizes = ends - starts
    # zeros behind each document, so that its last words take nothing of the next one
    shift = np.arange(len(ends)) * _LONGEST
    values = np.zeros(len(ids) + (len(ends) + 1) * _LONGEST, dtype=np.uint64)
    values[np.arange(len(ids)) + np.repeat(shift, sizes)] = ids
    at_escape = np.nonzero(values >> np.uint64(60))[0]
    escaped = values[at_escape]
    values[at_escape] = 0
    choice = _selected(_bits(values))
    steps, places, firsts = _COUNTS[choice].tolist(), [], [0]
    for i, end in zip((starts + shift).tolist(), (ends + shift).tolist()):
        while i < end:
            places.append(i)
            i += steps[i]
        firsts.append(len(places))
    at = np.array(places, dtype=np.int64)
    chosen = choice[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        count, size = SELECTORS[selector]
        own = np.nonzero(chosen == selector)[0] if size else []
        if len(own):
            block = values[at[own][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(size))
            words[own] |= np.bitwise_or.reduce(block, axis=1)
    raw, cut = memoryview(words.astype("<u8").tobytes()), np.searchsorted(at_escape, np.append(starts + shift, len(values)))
    out = []
    for k, n in enumerate(sizes.tolist()):
        own = slice(cut[k], cut[k + 1])
        n_words, n_escapes = firsts[k + 1] - firsts[k], int(cut[k + 1] - cut[k])
        tail = (at_escape[own] - starts[k] - shift[k]).astype("<u4").tobytes() + escaped[own].astype("<u8").tobytes() if n_escapes else b""
        out.append(b"".join([MAGIC, struct.pack("<5I", 1, n_words, n_escapes, n, n_words), raw[8 * firsts[k] : 8 * firsts[k + 1]], tail]))
    return out


def _parts(payload: bytes) -> tuple[np.ndarray, ...]:
    """(ids and words of each document, words, escapes' places, escapes)"""
    if payload[:4] != MAGIC:
        raise ValueError("this is no block of ids")
    docs, words, escapes = struct.unpack_from("<III", payload, 4)
    out, at = [], 16
    for kind, n in (("<u4", docs), ("<u4", docs), ("<u8", words), ("<u4", escapes), ("<u8", escapes)):
        out.append(np.frombuffer(payload, dtype=kind, count=n, offset=at))
        at += n * int(kind[2])
    return tuple(out)


def join(payloads: Sequence[bytes]) -> bytes:
    """One block of the documents of several; nothing is packed anew."""
    parts = [_parts(p) for p in payloads]
    before = np.cumsum([0, *(int(p[0].sum()) for p in parts)])
    places = [p[3] + np.uint32(b) for p, b in zip(parts, before) if len(p[3])]
    counts = (sum(len(p[k]) for p in parts) for k in (0, 2, 3))
    return b"".join([MAGIC, struct.pack("<III", *counts), *(p[0].tobytes() for p in parts), *(p[1].tobytes() for p in parts), *(p[2].tobytes() for p in parts), *(p.astype("<u4").tobytes() for p in places), *(p[4].tobytes() for p in parts)])


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a block; each selector's words at once."""
    sizes, n_words, words, places, escaped = _parts(payload)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selectors]
    starts = np.cumsum(counts) - counts
    room = int(counts.sum())
    wide = np.zeros(room + _LONGEST, dtype=np.uint64)
    for selector in np.unique(selectors):
        count, size = SELECTORS[selector]
        if size:
            own = np.nonzero(selectors == selector)[0]
            wide[starts[own][:, None] + np.arange(count)] = (words[own][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(size))) & np.uint64((1 << size) - 1)
    # each document's last word may have room for more than its ids
    sizes, begins = sizes.astype(np.int64), np.append(starts, room)[np.cumsum(n_words, dtype=np.int64) - n_words]
    out = wide[np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
    out[places] = escaped
    return out


BLOCK = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


#: A document with its ids packed, in the part that it belongs to.
PACKED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("i", T.LongType()), T.StructField("n", T.LongType()), T.StructField("payload", T.BinaryType())])


def write_tokens(docs: DataFrame, path: str, definition: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 16, pieces: int = 800_000, part_rows: int = 200_000) -> None:
    """Write every whole text's ids (null: none) and end_id, in ascending id order (null first; rows that repeat an id by their packed ids, so repeated rows give equal documents side by side), as blocks under path.

    Texts are encoded and packed where they are read; only packed ids are shuffled, by ranges of the id that a first pass over the ids alone finds, so parts are even; rows of an id that fills several parts are dealt out among them by their packed ids. A block ends with the document in which it reaches block_ids; A part has about part_rows documents at most. pieces bounds a worker's memory of pieces, and is larger than where other operators share the worker. An empty table gives no blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    # parts grow with the table, so that a task's share doesn't
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.select("i").count() // part_rows))
    shares = [k / parts for k in range(1, parts)]
    least = np.iinfo(np.int64).min
    bounds = rows.agg(F.percentile_approx(F.coalesce("i", F.lit(int(least))), shares, max(10_000, 20 * parts))).first()[0] if shares else None
    bounds = np.array(sorted(bounds or []), dtype=np.int64)
    end = np.array([end_id], dtype=np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(definition, pattern, pieces)

        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            i = np.concatenate([b.column(0).fill_null(least).to_numpy() for b in held])
            null = np.concatenate([np.asarray(b.column(0).is_null()) for b in held])
            ids, before = own.encode_column(pa.concat_arrays([b.column(1) for b in held]))
            ids, ends = np.insert(ids, before[1:], end[0]), before[1:] + np.arange(1, len(i) + 1)
            payloads = pack(ids, ends)
            low, high = (np.searchsorted(bounds, i, side=s) for s in ("left", "right"))
            part = low + np.array([zlib.crc32(p) for p in payloads]) % (high - low + 1)
            return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(i, mask=null), pa.array(np.diff(ends, prepend=0)), pa.array(payloads, pa.binary())], names=PACKED.names)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= WINDOW:
                yield packed(held)
                held, size = [], 0
        if size or held:
            yield packed(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, start, held = None, 0, 0, 0
        ids, counts, payloads = [], [], []

        def block() -> pa.RecordBatch:
            nonlocal seq, start, held
            ends = np.cumsum(counts).tolist()
            out = pa.RecordBatch.from_pylist([{"part": at, "seq": seq, "start": start, "n_ids": held, "doc_ids": list(ids), "ends": ends, "payload": join(payloads)}], schema=_ARROW)
            seq, start, held = seq + 1, start + held, 0
            for x in (ids, counts, payloads):
                x.clear()
            return out

        for batch in batches:
            for part, i, n, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at:
                    if ids:
                        yield block()
                    at, seq, start = part, 0, 0
                ids.append(i)
                counts.append(n)
                payloads.append(payload)
                held += n
                if held >= block_ids:
                    yield block()
        if ids:
            yield block()

    dealt = bounded_batches(rows).mapInArrow(encode, PACKED).repartitionById(parts, "part").sortWithinPartitions("part", "i", "payload")
    dealt.mapInArrow(run, BLOCK).write.parquet(path)


_ARROW = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())])


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """The documents in the files under path: doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and, if asked for, ids."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task of the writer, whatever the number of documents
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = blocks.join(F.broadcast(parts), "part").select((F.col("start") + F.col("before")).alias("start"), "doc_ids", "ends", "payload")
    fields = [("doc_id", T.LongType(), pa.int64()), ("start", T.LongType(), pa.int64()), ("n_tokens", T.LongType(), pa.int64()), ("ids_crc32", T.LongType(), pa.int64())]
    schema = T.StructType([T.StructField(n, t) for n, t, _ in fields] + ([T.StructField("ids", T.ArrayType(T.LongType(), True))] if ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, docs, ends, payload in zip(*(c.to_pylist() for c in batch.columns)):
                values = unpack(payload)
                raw = memoryview(values.astype("<u4").tobytes())
                ends = np.array(ends, dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                out = [pa.array(docs, pa.int64()), pa.array(starts + start), pa.array(ends - starts), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64())]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return bounded_batches(rows).mapInArrow(run, schema)


def token_files(docs: DataFrame, definition: str, pattern: str, end_id: int, path: str | None = None, **options) -> DataFrame:
    """Write the token files (under path, or in the shared folder) and read them back: read_tokens's rows without ids. A row for each row of docs, repeated ones too; a null or empty text has the end id alone; an empty table gives an empty table; docs's other columns play no part."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, definition, pattern, end_id, **options)
    return read_tokens(spark, path, ids=False)
