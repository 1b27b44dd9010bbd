"""Near duplicates by ProbMinHash, banding and verification.

Texts that are equal after lower-casing A-Z are one node. A node is a set of shingles of five words, each weighted by 1 + ln(its count). ProbMinHash signs it: elements arrive by Poisson processes whose rates are the weights, with early termination, and slots agree as often as the probability Jaccard says. Two nodes are linked if their probability Jaccard is 0.8 or more, with these weights or with equal ones (which is the Jaccard similarity of the sets). So a text that repeats shingles has two signatures, one for either; for all others they are the same one. Nodes that agree on all slots of a band, in either signature, are in one bucket. In each bucket, pairs are verified by the exact similarities of their whole sets; as classes are connected components, a pair that verified links have already joined is skipped. A pair is looked at in its first common band only.

A bucket is dealt into blocks of bounded size, and each two blocks are compared in a task of their own; so no task holds a whole bucket, no pair is written unless it is a verified link, and nothing is capped. Components are found by large-star and small-star steps on stored tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import _WORD_BYTES, adding_columns, ascii_lower_col, bounded_batches, heavy_rows, held, keeping_columns, map_texts, removed, settled, step_path, stored
from folioscope.llm.exactdup import all_cells, cell_map, filter_size, seen

OUTPUT = ("class_id", "class_size", "kept")

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiplications and shifts."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as they are asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, _BACK)]), dtype=np.uint64)
        return self.up, self.down


_POWERS = Powers()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, place of the first byte) of each blank-separated word: a polynomial of its bytes, finalised."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate([[0], (raw != 32).astype(np.int8), [0]])
    edges = np.diff(inside)
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    up, down = _POWERS.to(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + _U(1)) * up[: len(raw)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def shingles(texts: list[str | None], words: int = 5, letters: bytes = _WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(document, 64-bit hash and count of each distinct shingle, ordered by document and hash; each text's words joined by blanks).

    A text of fewer words than a shingle, but not none, is one shingle. letters: what each byte becomes; blanks separate words.
    """
    clean = [(t or "").encode("utf-8", "surrogatepass").translate(letters) for t in texts]
    hashes, at = word_hashes(b" ".join(clean))
    ends = np.cumsum([len(c) + 1 for c in clean])
    doc = np.searchsorted(ends, at, side="right")
    total = np.zeros(max(len(hashes) - words + 1, 0), dtype=np.uint64)
    for k in range(words):
        total = mix(total + hashes[k : k + len(total)] + _U(k))
    whole = doc[: len(total)] == doc[words - 1 :] if len(total) else np.zeros(0, dtype=bool)
    counts = np.bincount(doc, minlength=len(texts))
    short = np.nonzero((counts > 0) & (counts < words))[0]
    firsts = np.searchsorted(doc, short)
    small = np.array([int(np.bitwise_xor.reduce(mix(hashes[f : f + counts[d]] + np.arange(counts[d], dtype=np.uint64) * _BASE))) for d, f in zip(short, firsts)], dtype=np.uint64)
    doc = np.concatenate([doc[: len(total)][whole], short])
    total = np.concatenate([total[whole], small])
    order = np.lexsort((total, doc))
    doc, total = doc[order], total[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])]) if len(doc) else np.zeros(0, dtype=bool)
    first = np.nonzero(new)[0]
    return doc[first], total[first], np.diff(np.append(first, len(doc))), clean


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """A row of slots elements for each document (0 where it has none): the collision probability of a slot is the probability Jaccard of the weighted sets.

    Each element is a Poisson process whose rate is its weight, seeded by the element alone; an arrival falls into one slot, and a slot keeps the element that arrives first. An element is given up once its next arrival is later than the latest of its document's slots.
    """
    time = np.full(n_docs * slots, np.inf)
    held = np.zeros(n_docs * slots, dtype=np.uint64)
    now = np.zeros(len(doc))
    doc, element, weight = doc.astype(np.int64), element.copy(), weight.astype(np.float64)
    draw = 0
    while len(doc):
        draw += 1
        random = mix(element + _U(draw * int(_BASE) & 0xFFFFFFFFFFFFFFFF))
        now = now - np.log(((random >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)) / weight
        slot = doc * slots + (mix(random) % _U(slots)).astype(np.int64)
        earlier = np.nonzero(now < time[slot])[0]
        np.minimum.at(time, slot[earlier], now[earlier])
        won = earlier[now[earlier] == time[slot[earlier]]]
        held[slot[won]] = element[won]
        latest = time.reshape(n_docs, slots).max(axis=1)
        stay = now < latest[doc]
        doc, element, weight, now = doc[stay], element[stay], weight[stay], now[stay]
    return held.reshape(n_docs, slots)


class Signer:
    """Signatures of texts: slots = bands * rows."""

    def __init__(self, words: int = 5, bands: int = 20, rows: int = 5):
        self.words, self.bands, self.rows = words, bands, rows

    def _chunks(self, texts: list[str | None]) -> Iterator[list[str | None]]:
        """Runs of texts of some MB, so that memory follows the longest text and not the batch."""
        own, size = [], 0
        for t in texts:
            own.append(t)
            size += len(t or "")
            if size > 2_000_000 or len(own) >= 1000:
                yield own
                own, size = [], 0
        if own:
            yield own

    def sets(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text (keys of its bands, ascending distinct shingle hashes, their counts); no keys where there are no words, and twice as many where shingles are repeated."""
        held("signatures", None, lambda: None)
        for chunk in self._chunks(texts):
            doc, element, count, _ = shingles(chunk, self.words)
            slots = self.bands * self.rows
            plain = self.keys(prob_minhash(doc, element, np.ones(len(doc)), len(chunk), slots))
            repeats = np.zeros(len(chunk), dtype=bool)
            repeats[doc[count > 1]] = True
            some = np.nonzero(repeats)[0]
            own = repeats[doc]
            weighted = self.keys(prob_minhash(np.searchsorted(some, doc[own]), element[own], weights(count[own]), len(some), slots))
            ends, at = np.searchsorted(doc, np.arange(len(chunk) + 1)), 0
            for i in range(len(chunk)):
                keys = plain[i] if ends[i] < ends[i + 1] else plain[i, :0]
                if repeats[i]:
                    keys, at = np.concatenate([keys, weighted[at]]), at + 1
                yield keys, element[ends[i] : ends[i + 1]], count[ends[i] : ends[i + 1]]

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """A long for each band of each signature: the band's number above a hash of its slots."""
        band = np.arange(self.bands, dtype=np.uint64)
        out = np.tile(band, (len(signatures), 1))
        for k in range(self.rows):
            out = mix(out * _U(31) + signatures[:, k :: self.rows])
        return ((band << _U(57)) | (out >> _U(7))).astype(np.int64)


def weights(count: np.ndarray) -> np.ndarray:
    """Of shingles, by how often a text holds them."""
    return 1.0 + np.log(count)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of two ascending sets with weights: the sum, over what both hold, of 1 / (sum over all elements j of max(x_j / x_i, y_j / y_i)).

    With r = x_i / y_i the inner sum is that of x_j where x_j / y_j >= r, and of r y_j elsewhere, by x_i; ordered by x_j / y_j, these are running sums.
    """
    every = np.union1d(a, b)
    u, v = np.zeros(len(every)), np.zeros(len(every))
    u[np.searchsorted(every, a)], v[np.searchsorted(every, b)] = x, y
    ratio = np.divide(u, v, out=np.full(len(every), np.inf), where=v > 0)
    order = np.argsort(ratio, kind="stable")
    ratio, u, v = ratio[order], u[order], v[order]
    above = np.append(np.cumsum(u[::-1])[::-1], 0.0)
    below = np.append(0.0, np.cumsum(v))
    both = (u > 0) & (v > 0)
    first = np.searchsorted(ratio, ratio[both], side="left")
    return float((u[both] / (above[first] + ratio[both] * below[first])).sum())


def linked(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, similar: float) -> bool:
    """Whether two sets with the counts m and n (empty: all 1) are similar, by equal weights or by those of the counts."""
    if jaccard(a, b) >= similar:
        return True
    if not len(m) and not len(n):
        return False
    return probability_jaccard(a, weights(m) if len(m) else np.ones(len(a)), b, weights(n) if len(n) else np.ones(len(b))) >= similar


class Joined:
    """Disjoint sets of places."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


#: Candidate pairs of a tile that are held at once.
PAIRS = 1 << 20


def links(nodes: list[bytes], keys: list[bytes], sets: list[bytes], counts: list[bytes], block: np.ndarray, bands: int, band: int, similar: float) -> list[tuple[bytes, bytes]]:
    """Verified links that join all similar nodes of one tile: pairs whose first common band is this one, likeliest first (of PAIRS at a time, which bounds a tile's memory), without those that links found before have joined. keys holds the bands of each node's signature or signatures, counts the shingles' counts (empty: all 1). block tells the tile's two blocks apart (all 0: one block); pairs of a tile with two are across them.

    Where neither text repeats a shingle, the smaller set's size is at most the union's times the similarity, so pairs whose sizes differ by more are no links.
    """
    n = len(nodes)
    across = block.min() != block.max()
    own = np.stack([np.resize(np.frombuffer(k, dtype="<i8"), 2 * bands) for k in keys]).reshape(n, 2, bands)
    double = np.array([len(c) > 0 for c in counts])
    sizes = np.array([len(s) // 8 for s in sets])
    out, joined, arrays = [], Joined(n), {}

    def verify(rates: list[np.ndarray], lefts: list[np.ndarray], rights: list[np.ndarray]) -> None:
        rate, left, right = map(np.concatenate, (rates, lefts, rights))
        order = np.argsort(-rate.astype(np.int16), kind="stable")
        for at in range(0, len(order), 4096):
            roots = np.array([joined.root(k) for k in range(n)])
            i, j = left[order[at : at + 4096]], right[order[at : at + 4096]]
            apart = roots[i] != roots[j]
            for i, j in zip(i[apart].tolist(), j[apart].tolist()):
                if joined.root(i) == joined.root(j) or nodes[i] == nodes[j]:
                    continue
                (a, m), (b, k) = (arrays.setdefault(x, (np.frombuffer(sets[x], dtype="<u8"), np.frombuffer(counts[x], dtype="<u4"))) for x in (i, j))
                if linked(a, m, b, k, similar):
                    joined.join(i, j)
                    out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))

    held, size = ([], [], []), 0
    for i in range(n - 1):
        equal = own[i + 1 :, 0] == own[i, 0]
        if double.any():
            equal |= (own[i + 1 :, 1] == own[i, 0]) | (own[i + 1 :, 0] == own[i, 1]) | (own[i + 1 :, 1] == own[i, 1])
        good = equal[:, band] & ~equal[:, :band].any(axis=1)
        good &= (np.minimum(sizes[i + 1 :], sizes[i]) >= similar * np.maximum(sizes[i + 1 :], sizes[i])) | double[i + 1 :] | double[i]
        if across:
            good &= block[i + 1 :] != block[i]
        right = np.nonzero(good)[0]
        for column, values in zip(held, (equal[right].sum(axis=1).astype(np.uint8), np.full(len(right), i, dtype=np.int32), (right + i + 1).astype(np.int32))):
            column.append(values)
        size += len(right)
        if size >= PAIRS:
            verify(*held)
            held, size = ([], [], []), 0
    if size:
        verify(*held)
    return out


def _node(text: Column) -> Column:
    return F.unhex(F.md5(ascii_lower_col(text.cast("string")).cast("binary")))


LINK = T.StructType([T.StructField("u", T.BinaryType()), T.StructField("v", T.BinaryType())])


def verified_links(base: DataFrame, nodes: DataFrame, signer: Signer, similar: float, tile: int, tile_bytes: int, broadcast_rows: int) -> DataFrame:
    """(u, v): links between nodes. base has row and text; nodes has node, best (id and row of the node's own row), bands and size (number of shingles)."""
    each = nodes.select("node", "size", F.explode(F.array_distinct("bands")).alias("key"))
    buckets = each.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(20,0)")).alias("s")).filter("n > 1")
    # buckets of equal members say the same; the one of the first band stays
    kept = buckets.groupBy("n", "x", "s").agg(F.min(F.struct("key", "shingles")).alias("k")).select("k.key", "n", "k.shingles")
    # a block's rows grow with the square root of the bucket's, so both a tile and the copies of a row do; a block of long texts has fewer
    rows_each = F.greatest(F.lit(tile), F.ceil(8 * F.sqrt("n")))
    blocks = F.greatest(F.ceil(F.col("n") / rows_each), F.ceil(12 * F.col("shingles") / F.lit(tile_bytes))).cast("int")
    members = stored(each.drop("size").join(kept.select("key", blocks.alias("blocks")), "key"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "best"), "node")
    wanted = stored(wanted.select("node", F.col("best.row").alias("row")), "wanted")
    # a row's place is its own, so this join has no hot key
    texts = base.select("row", "text").join(F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted, "row").select("node", "text")
    fields = [T.StructField(n, T.BinaryType()) for n in ("bands", "shingles", "counts")]

    def make():
        def work(batch):
            found = [(k.astype("<i8").tobytes(), e.astype("<u8").tobytes(), c.astype("<u4").tobytes() if (c > 1).any() else b"") for k, e, c in signer.sets(batch)]
            return [pa.array([f[k] for f in found], pa.binary()) for k in range(3)]

        return work

    sets = map_texts(texts, fields, make, "text", ["node"])
    rows = members.join(sets, "node").withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiled = rows.select("key", "node", "bands", "shingles", "counts", "block", other)
    tiled = tiled.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "bands", "shingles", "counts")
    dealt = tiled.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    bands = signer.bands

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[list] = [[], [], [], [], []]
        at = None

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["u", "v"])

        def done():
            if len(own[0]) < 2:
                return []
            node, band, shingle, count, block = own
            return links(node, band, shingle, count, np.array(block), bands, at[0] >> 57, similar)

        for batch in batches:
            found = []
            key, low, high, block, node, band, shingle, count = (c.to_pylist() for c in batch.columns)
            for i, tile_key in enumerate(zip(key, low, high)):
                if tile_key != at:
                    found += done() if at else []
                    own, at = [[], [], [], [], []], tile_key
                for k, column in enumerate((node, band, shingle, count, block)):
                    own[k].append(column[i])
            if found:
                yield out(found)
        if at and (found := done()):
            yield out(found)

    return bounded_batches(dealt).mapInArrow(compare, LINK).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for every node of an edge but the roots themselves. edges: (u, v).

    Large-star and small-star steps until nothing changes; each step is stored, so lineage stays short.
    """
    spark = edges.sparkSession
    path = step_path(spark, "edges")
    edges = stored(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), path=path)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        down = large.select(F.col("v").alias("high"), F.col("u").alias("low"))
        lowest = down.groupBy("high").agg(F.min("low").alias("m"))
        pairs = down.join(lowest, "high")
        small = pairs.select(F.col("m").alias("u"), F.col("low").alias("v")).unionByName(pairs.select(F.col("m").alias("u"), F.col("high").alias("v"))).filter("u <> v").distinct()
        old, path = path, step_path(spark, "edges")
        edges = stored(small, path=path)
        removed(spark, old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        state = tuple(now)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = 0.8, words: int = 5, bands: int = 20, rows: int = 5, tile: int = 256, tile_bytes: int = 32 << 20, broadcast_rows: int = 1 << 20, most_bits: int = 1 << 30) -> DataFrame:
    """docs with class_id, class_size and kept; input columns of these names give way.

    A class is a connected component of texts whose shingles (of words words; a text of fewer words, but not none, is one shingle) have a probability Jaccard of similar or more, weighted by 1 + ln(count) or equally (the Jaccard similarity of the sets), or that are equal after lower-casing A-Z (null counts as empty); texts without words are linked to equal texts only. class_id is the smallest id of the class (null is the smallest), class_size its number of rows; kept is true in exactly one row of each class, one with that id. Whole texts are read. An empty table gives an empty table. A table that isn't read from files alone is stored first, since it is read more than once.

    Rows of texts in classes of one row pass straight through: a bit map of the others' nodes (16 bits for each, most_bits at most) is broadcast, and what it lets through by mistake is only shuffled.

    Candidates: pairs that agree on a band of rows slots, in the signature of either weighting; with the standard 20 bands of 5, a pair of similarity 0.8 does so with a probability of 0.9996, however often each text repeats its shingles.
    """
    return adding_columns(docs, OUTPUT, lambda d, name: _grouped(d, name[id_col], name[text_col], similar, words, bands, rows, tile, tile_bytes, broadcast_rows, most_bits))


def _grouped(docs: DataFrame, id_col: str, text_col: str, similar: float, words: int, bands: int, rows: int, tile: int, tile_bytes: int, broadcast_rows: int, most_bits: int) -> DataFrame:
    base = docs = settled(docs)
    signer = Signer(words, bands, rows)
    place = F.monotonically_increasing_id()
    narrow = docs.select(F.col(id_col).alias("id"), place.alias("row"), _node(F.col(text_col)).alias("node"), F.col(text_col).cast("string").alias("text"))

    def make():
        def work(batch):
            found = [(k, len(e)) for k, e, _ in signer.sets(batch)]
            return [pa.array([k for k, _ in found], pa.list_(pa.int64())), pa.array([n for _, n in found], pa.int64())]

        return work

    fields = [T.StructField("bands", T.ArrayType(T.LongType(), True)), T.StructField("size", T.LongType())]
    signed = map_texts(narrow, fields, make, "text", ["id", "row", "node"])
    nodes = stored(signed.groupBy("node").agg(F.min(F.struct("id", "row")).alias("best"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("size").alias("size")), "nodes")
    texts = docs.select(place.alias("row"), F.col(text_col).cast("string").alias("text"))
    roots = components(verified_links(texts, nodes, signer, similar, tile, tile_bytes, broadcast_rows))
    rooted = nodes.select("node", "best", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = rooted.groupBy("root").agg(F.min("best").alias("__best"), F.sum("copies").alias("__size"))
    # nodes of one row are their own class; only the others are looked up
    several = stored(rooted.select(F.col("node").alias("__node"), "root", "copies").join(classes.filter("__size > 1"), "root").select("__node", "copies", "__best", "__size"), "classes")
    heavy = heavy_rows(nodes.agg(F.sum("copies")).first()[0] or 0)
    hot = F.broadcast(several.filter(F.col("copies") > heavy).select("__node", F.col("__best").alias("__hot_best"), F.col("__size").alias("__hot_size")))
    rest = several.filter(F.col("copies") <= heavy).select(F.col("__node").alias("__key"), F.lit(False).alias("__hot"), "__best", "__size")
    # a bit map of these nodes, of bounded size: rows that it doesn't hold pass straight through
    size = filter_size(several.count(), most_bits)
    bits = F.broadcast(stored(cell_map(all_cells(several, "__node", size)), "bits"))
    rows = seen(base.withColumns({"__row": place, "__node": _node(docs[text_col])}), "__node", bits, size)
    alone = rows.filter("not __maybe").withColumns({"class_id": F.col(id_col), "class_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    out = rows.filter("__maybe").join(hot, "__node", "left")
    # rows of a hot text have their answer, and are dealt out by their places
    is_hot = F.col("__hot_size").isNotNull()
    out = out.withColumns({"__hot": is_hot, "__key": F.when(is_hot, F.col("__row").cast("string").cast("binary")).otherwise(F.col("__node"))}).join(rest, ["__key", "__hot"], "left")
    best, total = F.coalesce("__hot_best", "__best"), F.coalesce("__hot_size", "__size")
    out = out.withColumns({"class_id": F.when(total.isNull(), F.col(id_col)).otherwise(best["id"]), "class_size": F.coalesce(total, F.lit(1)).cast("long"), "kept": F.coalesce(best["row"] == F.col("__row"), F.lit(True))})
    return alone.select(*base.columns, *OUTPUT).unionByName(out.select(*base.columns, *OUTPUT))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, with docs's columns."""
    return keeping_columns(docs, lambda d, name: near_groups(d, name[id_col], name[text_col], **options).filter("kept"))
