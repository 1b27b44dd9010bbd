"""Exact Jaccard join of word n-grams by a size-aware split into light and heavy sets.

A document is its set of distinct shingles; equal sets are one node. Two nodes of a and b shingles are linked if they share t(a, b) = ceil(s (a + b) / (1 + s)) of them, s being the similarity.

Light sets, up to a boundary, enumerate subsets: for each size b that a partner can have, all subsets of t(a, b) shingles, keyed with both sizes. Two light sets are linked if and only if they share a key, so all sets of one size with a key are linked to all of the other size, and a key joins its sets in a line, without pairs. Heavy sets scan inverted lists. By one order of all shingles, rarest first, linked sets share one of their first a - ceil(s a) + 1 shingles; only these are in lists, with those of light sets that can have a heavy partner. The boundary is the size where enumerating costs least in all, by a histogram of sizes and the expected length of lists.

The order is by counts that a table of fixed size holds (2^22 cells, as a byte of their logarithm): any order gives the same result, a good one short lists. Lists are worked off in two rounds. In the first, each list's members are compared with its smallest member, which joins groups of near copies in time linear in the lists; nothing else is compared for members that are in one component then. In the second, lists that still hold several components, and more than two members, are dealt out as tiles of bounded size, and a tile scans its sets' full inverted lists for exact overlaps. Before whole sets are sent for either round, a set's spread (counts of its shingles by ranges of the hash, a byte for four) tells whether a link is possible at all. So no pair is written unless it is compared with a list's first member, or is a verified link, and nothing is capped.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import adding_columns, bounded_batches, map_texts, settled, step_path, stored
from folioscope.llm.exactdup import all_cells, cell_map, filter_size, seen
from folioscope.llm.neardup import Joined, components, mix, shingles

OUTPUT = ("n_shingles", "component_id")
#: In UTF-8, ASCII white space separates words; A-Z become lower case.
WORD_BYTES = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Sets of more shingles are never light: their subsets are too many.
MOST_LIGHT = 16
#: Cells of the count table are sent in pieces.
CELLS = 1 << 14
_U = np.uint64


class Law:
    """Sizes and overlaps of a similarity of percent / 100, in whole numbers."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent is from 1 to 100")
        self.percent = percent

    def overlap(self, a: int, b: int) -> int:
        return -(-self.percent * (a + b) // (100 + self.percent))

    def linked(self, both, a, b):
        return 100 * both >= self.percent * (a + b - both)

    def partners(self, a: int) -> range:
        """Sizes of sets that one of size a can be linked to."""
        return range(-(-self.percent * a // 100), 100 * a // self.percent + 1)

    def prefix(self, a):
        """How many of its first shingles a set's lists need."""
        return a - -(-self.percent * a // 100) + 1

    def subsets(self, a: int, boundary: int) -> list[tuple[int, int, int]]:
        """(smaller size, larger size, subset size) of the keys of a light set. Sets of equal size that share all are one node, so these need no key."""
        found = [(min(a, b), max(a, b), self.overlap(a, b)) for b in self.partners(a) if 0 < b <= boundary]
        return [k for k in found if not k[0] == k[1] == k[2]]

    def boundary(self, sizes: dict[int, int], list_length: float) -> int:
        """The largest light size, by cost: a key or a place in a list costs 1, and a list's place is compared with the expected others, at a sixteenth for each shingle."""

        def light(a, boundary):
            return sum(math.comb(a, t) for _, _, t in self.subsets(a, boundary))

        def heavy(a):
            return self.prefix(a) * (1 + list_length * a / 16)

        def cost(x):
            # light sets with partners beyond the boundary are in lists too
            return sum(n * ((light(a, x) + (heavy(a) if self.partners(a)[-1] > x else 0)) if a <= x else heavy(a)) for a, n in sizes.items() if a <= MOST_LIGHT)

        return min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def subset_keys(elements: np.ndarray, wanted: list[tuple[int, int, int]]) -> list[tuple[bytes, int]]:
    """(128-bit key, 1 where the set has the smaller size and 2 where the larger, 3 for both) of a light set's subsets."""
    out = []
    for small, large, size in wanted:
        chosen = elements[np.array(list(itertools.combinations(range(len(elements)), size)), dtype=np.int64)]
        keys = np.zeros((len(chosen), 2), dtype=np.uint64)
        for half in (0, 1):
            state = np.full(len(chosen), small * 64 + large + (half << 40), dtype=np.uint64)
            for k in range(size):
                state = mix(state * _U(31) + chosen[:, k] + _U(half))
            keys[:, half] = state
        side = 3 if small == large else 1 if len(elements) == small else 2
        out += [(k.tobytes(), side) for k in keys.astype("<u8")]
    return out


def _chunks(texts: Sequence[str | None]) -> Iterator[Sequence[str | None]]:
    """Runs of texts of some MB, so that memory follows the longest text and not the batch."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > 2_000_000:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def sets_of(texts: Sequence[str | None], words: int) -> Iterator[np.ndarray]:
    """Each text's ascending distinct shingles as 64-bit hashes."""
    for chunk in _chunks(texts):
        doc, element, _, _ = shingles(chunk, words, WORD_BYTES)
        ends = np.searchsorted(doc, np.arange(len(chunk) + 1))
        for i in range(len(chunk)):
            yield element[ends[i] : ends[i + 1]]


def _cell(elements: np.ndarray, bits: int) -> np.ndarray:
    return (elements >> _U(64 - bits)).astype(np.int64)


def _narrow(counts: np.ndarray) -> str:
    """The least number of bytes for counts."""
    most = int(counts.max())
    return "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8"


def spread(elements: np.ndarray) -> bytes:
    """How many shingles lie in each part of the range of hashes, a byte each: about a part for four shingles. Empty if a byte is too small."""
    parts = 16
    while 4 * parts < len(elements):
        parts *= 2
    counts = np.bincount(_cell(elements, parts.bit_length() - 1), minlength=parts)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_link(law: Law, n: int, spread: bytes, sizes: np.ndarray, spreads: Sequence[bytes]) -> np.ndarray:
    """Whether a set's link to each of others is possible: parts whose counts differ by d in all hold d shingles at least that the sets don't share."""
    out = (100 * np.minimum(sizes, n) >= law.percent * np.maximum(sizes, n))
    if not spread:
        return out
    own = np.frombuffer(spread, dtype=np.uint8).astype(np.int64)
    for parts in {len(s) for i, s in enumerate(spreads) if out[i] and s}:
        at = np.array([i for i, s in enumerate(spreads) if out[i] and len(s) == parts])
        theirs = np.frombuffer(b"".join(spreads[i] for i in at), dtype=np.uint8).astype(np.int64).reshape(len(at), parts)
        least = min(parts, len(own))
        apart = np.abs(theirs.reshape(len(at), least, -1).sum(axis=2) - own.reshape(least, -1).sum(axis=1)).sum(axis=1)
        out[at] = law.linked((sizes[at] + n - apart) // 2, n, sizes[at])
    return out


def count_table(texts: DataFrame, words: int, bits: int) -> tuple[np.ndarray, dict[int, int], float]:
    """(a byte for each of 2^bits cells: 8 times the binary logarithm of its count of shingles; number of texts of each size up to MOST_LIGHT; expected length of a shingle's list). All texts are counted; what comes to the driver has a fixed size: a byte for each cell, and a few numbers for each piece of the table."""
    cells, last = min(CELLS, 1 << bits), (1 << bits) // min(CELLS, 1 << bits)
    schema = "piece int, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, small = np.zeros(1 << bits, dtype=np.int64), np.zeros(cells, dtype=np.int64)
        for batch in batches:
            for elements in sets_of(batch.column(0).to_pylist(), words):
                np.add.at(table, _cell(elements, bits), 1)
                if len(elements) <= MOST_LIGHT:
                    small[len(elements)] += 1
        pieces = [(i, p) for i, p in enumerate([*table.reshape(-1, cells), small]) if p.any()]
        for at in range(0, len(pieces), 64):
            own = pieces[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int32()), pa.array([p.astype(_narrow(p)).tobytes() for _, p in own], pa.binary())], names=["piece", "counts"])

    def summary(piece: int, counts: np.ndarray) -> pa.RecordBatch:
        """A piece's levels (of the sizes: their counts), its counts' sum and the sum of their squares."""
        level = counts.astype("<i8") if piece == last else np.where(counts > 0, np.minimum(8 * np.log2(np.maximum(counts, 1)), 255), 0).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([level.tobytes()], pa.binary()), pa.array([int(counts.sum())], pa.int64()), pa.array([float((counts.astype(float) ** 2).sum())], pa.float64())], names=["piece", "level", "total", "squares"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for piece, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if piece != at:
                    if at is not None:
                        yield summary(at, total)
                    at, total = piece, np.zeros(cells, dtype=np.int64)
                total += np.frombuffer(counts, dtype=f"<u{len(counts) // cells}")
        if at is not None:
            yield summary(at, total)

    parts = bounded_batches(texts).mapInArrow(count, schema)
    summed = parts.repartition("piece").sortWithinPartitions("piece").mapInArrow(add, "piece int, level binary, total long, squares double")
    level = np.zeros(1 << bits, dtype=np.uint8)
    small, squares, total = np.zeros(cells, dtype=np.int64), 0.0, 0
    for row in summed.toLocalIterator():
        if row.piece == last:
            small = np.frombuffer(row.level, dtype="<i8")
            continue
        level[row.piece * cells : (row.piece + 1) * cells] = np.frombuffer(row.level, dtype=np.uint8)
        squares, total = squares + row.squares, total + row.total
    expected = max(squares / total - total / (1 << bits), 0.0) if total else 0.0
    return level, {a: int(n) for a, n in enumerate(small[: MOST_LIGHT + 1].tolist()) if a and n}, expected


SIGNED = (
    T.StructField("digest", T.BinaryType()),
    T.StructField("n", T.LongType()),
    T.StructField("spread", T.BinaryType()),
    T.StructField("prefix", T.ArrayType(T.LongType(), True)),
    T.StructField("keys", T.ArrayType(T.BinaryType(), True)),
    T.StructField("sides", T.ArrayType(T.IntegerType(), True)),
)


def signer(words: int, law: Law, boundary: int, level, bits: int):
    """For each text: digest of its set (null where it has no words), size, spread, first shingles for lists, keys of subsets and their sides. level: broadcast."""
    wanted = {a: law.subsets(a, boundary) for a in range(1, boundary + 1)}

    def make():
        table = level.value

        def work(texts):
            out = []
            for elements in sets_of(texts, words):
                n = len(elements)
                if not n:
                    out.append((None, 0, b"", [], [], []))
                    continue
                keys = subset_keys(elements, wanted[n]) if n <= boundary else []
                first = np.zeros(0, dtype=np.int64)
                if law.partners(n)[-1] > boundary:
                    count = table[_cell(elements, bits)]
                    own = np.lexsort((elements, count))[: law.prefix(n)]
                    first = elements[own[count[own] > 0]].astype(np.int64)  # a cell of one shingle is in no other text
                out.append((hashlib.md5(elements.tobytes()).digest(), n, spread(elements), first, [k for k, _ in keys], [s for _, s in keys]))
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()))
            return [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]

        return work

    return make


LINK = "u long, v long"


def _light_links(nodes: DataFrame) -> DataFrame:
    """(u, v): each key's sets joined with the smallest of the other size (of the same size: with the smallest)."""
    each = nodes.select("node", F.explode(F.arrays_zip("keys", "sides")).alias("k")).select("node", F.col("k.keys").alias("key"), F.col("k.sides").alias("side"))
    first = F.min(F.when(F.col("side").bitwiseAND(1) > 0, F.col("node")))
    second = F.min(F.when(F.col("side").bitwiseAND(2) > 0, F.col("node")))
    keys = each.groupBy("key").agg(first.alias("a"), second.alias("b"), F.count("*").alias("m")).filter("m > 1 and a is not null and b is not null").drop("m")
    other = F.when(F.col("side") == 1, F.col("b")).otherwise(F.col("a"))
    return each.join(keys, "key").select(F.col("node").alias("u"), other.alias("v")).filter("u <> v")


def _sets(texts: DataFrame, wanted: DataFrame, words: int, broadcast_rows: int, most_bits: int) -> DataFrame:
    """(node, set) of the wanted nodes, from their texts. A large list of nodes is first met by a bit map of bounded size, so that only texts that may be wanted are shuffled."""
    n = wanted.count()
    if n > broadcast_rows:
        size = filter_size(n, most_bits)
        bits = F.broadcast(stored(cell_map(all_cells(wanted, "node", size)), "bits"))
        texts = seen(texts, "node", bits, size).filter("__maybe").drop("__maybe")
    own = texts.join(F.broadcast(wanted) if n <= broadcast_rows else wanted, "node").select("node", "text")

    def make():
        def work(batch):
            return [pa.array([s.astype("<u8").tobytes() for s in sets_of(batch, words)], pa.binary())]

        return work

    return map_texts(own, [T.StructField("elements", T.BinaryType())], make, "text", ["node"])


def _possible(pairs: DataFrame, nodes: DataFrame, law: Law) -> DataFrame:
    """The pairs (u, v) that their sizes and spreads let be links."""
    own = nodes.select("node", "n", "spread")
    both = pairs.join(own.select(F.col("node").alias("u"), F.col("n").alias("a"), F.col("spread").alias("x")), "u").join(own.select(F.col("node").alias("v"), F.col("n").alias("b"), F.col("spread").alias("y")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [bool(may_link(law, a, x, np.array([b]), [y])[0]) for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return bounded_batches(both.select("u", "v", "a", "b", "x", "y")).mapInArrow(run, LINK)


def _compared(pairs: DataFrame, sets: DataFrame, law: Law) -> DataFrame:
    """The linked ones of the pairs (u, v)."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("elements").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("elements").alias("y")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for u, v, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                if len(a) > len(b):
                    a, b = b, a
                shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                if law.linked(shared, len(a), len(b)):
                    out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return bounded_batches(both.select("u", "v", "x", "y")).mapInArrow(run, LINK)


def scanned(nodes: list[int], roots: list[int], blocks: list[int], sets: list[np.ndarray], law: Law) -> list[tuple[int, int]]:
    """Links that join all linked sets of one tile which aren't in one component (root) yet: each set scans the inverted lists of its shingles, which gives its exact overlaps. Where there are two blocks, pairs are across them."""
    across = len(set(blocks)) > 1
    sizes = np.array([len(s) for s in sets])
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    block, root = np.array(blocks), np.array(roots)
    place = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    own, joined, out = np.array([place[r] for r in roots]), Joined(len(place)), []
    for i, s in enumerate(sets):
        low, high = np.searchsorted(element, s, side="left"), np.searchsorted(element, s, side="right")
        runs = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        good = law.linked(both, sizes[i], sizes) & (both > 0) & (root != root[i]) & (np.arange(len(sets)) > i)
        if across:
            good &= block != block[i]
        for j in np.nonzero(good)[0].tolist():
            if joined.join(int(own[i]), int(own[j])):
                out.append((nodes[i], nodes[j]))
    return out


def _blocks(members: DataFrame, tile: int, tile_bytes: int, each_bytes: int) -> DataFrame:
    """members with the number of blocks of their list; of lists of equal members one is kept."""
    lists = members.groupBy("element").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")).alias("s")).filter("m > 1")
    kept = lists.groupBy("m", "x", "s").agg(F.min(F.struct("element", "total")).alias("k")).select("k.element", "m", "k.total")
    blocks = F.greatest(F.ceil(F.col("m") / F.greatest(F.lit(tile), F.ceil(8 * F.sqrt("m")))), F.ceil(2 * each_bytes * F.col("total") / F.lit(tile_bytes))).cast("int")
    return members.join(kept.select("element", blocks.alias("blocks")), "element")


def _in_tiles(rows: DataFrame, columns: Sequence[str], work, schema: str) -> DataFrame:
    """What work makes of each two blocks of each list; it gets the element, the blocks' numbers and a list for each column."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("element", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", *columns)
    dealt = dealt.repartition("element", "low", "high").sortWithinPartitions("element", "low", "high")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        at = None

        def done():
            return work(at[0], *zip(*own)) if len(own) > 1 else []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            found = []
            for element, low, high, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (element, low, high) != at:
                    found += done()
                    own, at = [], (element, low, high)
                own.append(tuple(row))
            if found:
                yield out(found)
        if found := done():
            yield out(found)

    return bounded_batches(dealt).mapInArrow(compare, schema).distinct()


def _hopeful(members: DataFrame, spreads: DataFrame | None, law: Law, tile: int, tile_bytes: int) -> DataFrame:
    """(element, node): members of lists (element, node, root, n, pos) with a possible partner among the members of other components.

    If a list's shingle is the first that two sets share, each of them has no more of those places before it than the shingles that it may lack; other pairs meet in an earlier list. spreads: (node, spread), or None to go by sizes and places alone.
    """
    rows = _blocks(members, tile, tile_bytes, 1)
    rows = rows.withColumn("spread", F.lit(None).cast("binary")) if spreads is None else rows.join(spreads, "node")

    def work(element, block, node, root, n, pos, spread):
        sizes, places, roots, blocks = np.array(n), np.array(pos), np.array(root), np.array(block)
        across, good = len(set(block)) > 1, np.zeros(len(node), dtype=bool)
        for i in range(len(node) - 1):
            overlap = -(-law.percent * (sizes[i + 1 :] + n[i]) // (100 + law.percent))
            other = (roots[i + 1 :] != roots[i]) & (places[i + 1 :] <= sizes[i + 1 :] - overlap) & (pos[i] <= n[i] - overlap)
            if across:
                other &= blocks[i + 1 :] != blocks[i]
            found = np.nonzero(other)[0] + i + 1
            if len(found):
                found = found[may_link(law, n[i], spread[i] or b"", sizes[found], [spread[j] or b"" for j in found])]
                good[found] = True
                good[i] |= bool(len(found))
        return [(element, node[i]) for i in np.nonzero(good)[0]]

    return _in_tiles(rows, ["node", "root", "n", "pos", "spread"], work, "element long, node long")


def _tiles(members: DataFrame, sets: DataFrame, law: Law, tile: int, tile_bytes: int) -> DataFrame:
    """Links across components in the lists (element, node, root, n)."""

    def work(element, block, node, root, data):
        return scanned(node, root, block, [np.frombuffer(d, dtype="<u8") for d in data], law)

    return _in_tiles(_blocks(members, tile, tile_bytes, 8).join(sets, "node"), ["node", "root", "elements"], work, LINK)


def _heavy_links(nodes: DataFrame, texts: DataFrame, light: DataFrame, law: Law, words: int, tile: int, tile_bytes: int, broadcast_rows: int, most_bits: int) -> DataFrame:
    """(u, v): links that join what inverted lists find, together with the light links."""
    spark = nodes.sparkSession
    places = nodes.select(F.posexplode("prefix").alias("pos", "element"), "node", F.col("n").cast("int").alias("n"))
    lists = places.groupBy("element").agg(F.count("*").alias("m"), F.min(F.struct("node", "n", "pos")).alias("first")).filter("m > 1")
    path = step_path(spark, "lists")
    listed = stored(places.join(lists, "element").select("element", "node", "n", "pos", "m", F.col("first.node").alias("first"), F.col("first.n").alias("first_n"), F.col("first.pos").alias("first_pos")), path=path)
    overlap = F.ceil(law.percent * (F.col("n") + F.col("first_n")) / F.lit(100 + law.percent))
    fits = (100 * F.least("n", "first_n") >= law.percent * F.greatest("n", "first_n")) & (F.col("pos") <= F.col("n") - overlap) & (F.col("first_pos") <= F.col("first_n") - overlap)
    first_pairs = listed.filter((F.col("node") != F.col("first")) & fits).select(F.col("first").alias("u"), F.col("node").alias("v")).distinct()
    pairs = stored(_possible(first_pairs, nodes, law), "pairs")
    wanted = stored(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "wanted")
    sets_path = step_path(spark, "sets")
    stored(_sets(texts, wanted, words, broadcast_rows, most_bits), path=sets_path)

    def sets():
        return spark.read.schema("node long, elements binary").parquet(sets_path)

    links_path = step_path(spark, "links")
    links = stored(_compared(pairs, sets(), law).unionByName(light).distinct(), path=links_path)
    rooted = components(links)
    # lists of two are done with; of the others those are left which hold several components
    left = spark.read.schema(listed.schema).parquet(path).filter("m > 2").select("element", "node", "n", "pos").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = left.groupBy("element").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("element")
    mixed = stored(left.join(several, "element"), "mixed")
    # by sizes and places alone, then by spreads: members without a possible partner leave a list before anything larger is sent
    for spreads in (None, nodes.select("node", "spread")):
        mixed = stored(mixed.join(stored(_hopeful(mixed, spreads, law, tile, tile_bytes), "hopeful"), ["element", "node"], "left_semi"), "mixed")
    members = mixed
    more = stored(members.select("node").distinct(), "wanted")
    new = more.join(wanted, "node", "left_anti")
    others = stored(_sets(texts, stored(new, "wanted"), words, broadcast_rows, most_bits), "sets")
    tiled = _tiles(members, sets().join(more, "node", "left_semi").unionByName(others), law, tile, tile_bytes)
    return spark.read.schema(LINK).parquet(links_path).unionByName(tiled)


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bits: int = 22, tile: int = 256, tile_bytes: int = 32 << 20, broadcast_rows: int = 1 << 20, most_bits: int = 1 << 30
) -> DataFrame:
    """docs with n_shingles and component_id; all other columns stay, input columns of these names give way.

    Words are what ASCII white space separates, with A-Z in lower case. A text's set is its distinct shingles of words words; a text of fewer words is one shingle, and one without words (as null is) has none, n_shingles 0, and is linked with nothing. Two rows are linked if 100 * intersection >= percent * union; component_id is the smallest id (null passed over, unless no row has another) of the rows that links reach. Repeated rows are linked as any equal texts; rows that repeat an id with different texts have their texts' components. Whole texts are read. An empty table gives an empty table. A table that isn't read from files alone is stored first.

    Shingles are compared by 64-bit hashes, sets by 128-bit digests.
    """
    law = Law(percent)
    if bits < 6:
        raise ValueError("bits is 6 or more")

    def work(d: DataFrame, name: dict[str, str]) -> DataFrame:
        d = settled(d)
        spark = d.sparkSession
        row, text = F.monotonically_increasing_id().alias("node"), F.col(name[text_col]).cast("string").alias("text")
        level, sizes, length = count_table(d.select(text), words, bits)
        boundary = law.boundary(sizes, length)
        sent = spark.sparkContext.broadcast(level)
        path = step_path(spark, "signed")
        signed = stored(map_texts(d.select(F.col(name[id_col]).alias("id"), row, text), SIGNED, signer(words, law, boundary, sent, bits), "text", ["id", "node"]), path=path)
        sent.destroy()  # signed is read from its files from here on
        own = signed.filter("digest is not null").groupBy("digest").agg(F.min("node").alias("node"), F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("spread").alias("spread"), F.first("prefix").alias("prefix"), F.first("keys").alias("keys"), F.first("sides").alias("sides"))
        nodes_path = step_path(spark, "nodes")
        nodes = stored(own, path=nodes_path)
        light = stored(_light_links(nodes).distinct(), "light")
        rooted = components(_heavy_links(nodes, d.select(row, text), light, law, words, tile, tile_bytes, broadcast_rows, most_bits))
        each = spark.read.schema(nodes.schema).parquet(nodes_path).select("digest", "node", "id", "copies").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # only classes of several rows are looked up; other rows are their own component
        least = each.groupBy("root").agg(F.min("id").alias("least"), F.sum("copies").alias("rows")).filter("rows > 1")
        found = stored(each.select("digest", "root").join(least, "root").select("digest", "least"), "classes")
        rows = spark.read.schema(signed.schema).parquet(path).select("id", "node", "n", "digest").join(found, "digest", "left")
        results = rows.select("node", F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))
        # a row's place is its own, so this join has no hot key
        return d.select(*d.columns, row).join(results, "node").drop("node")

    return adding_columns(docs, OUTPUT, work)
