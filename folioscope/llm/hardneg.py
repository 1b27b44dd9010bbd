"""Hard-negative mining by bit-sliced integer products.

Components become integers, and a vector is stored as bit-planes of two's complement: the plane of the sign first, then the others, most significant first. Scores of anchors against rows are sums over planes of 2^k times the sum of the anchor's components where the plane has a bit. After some planes a score lies in an interval: what the planes left out can add is at most (2^k - 1) times the sum of the anchor's positive components, and at least that of its negative ones. With each plane the interval tightens, and a row is dropped for an anchor once its interval can't qualify: for positives, once it is below as many lower ends as are wanted; for negatives, once it is outside of all windows, or below as many rows that are sure to be inside. After the last plane intervals are scores, so results are exact.

Anchors and rows are dealt into blocks of bounded size, and each pair of blocks is a task's group; it hands on each anchor's few best rows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioscope.llm.common import bounded_batches, step_path, stored

OUTPUT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
#: Anchors that are worked on at once.
STRIP = 64


def sliced(q: list[int]) -> tuple[int, bytes]:
    """(number of planes, the planes one after the other, sign first) of integers; each plane is padded to whole bytes."""
    if not q:
        return 1, b""
    bits = max(x.bit_length() if x >= 0 else (~x).bit_length() for x in q) + 1
    if bits < 63:
        planes = (np.array(q, dtype=np.int64)[None, :] >> np.arange(bits - 1, -1, -1, dtype=np.int64)[:, None]) & 1
    else:
        planes = np.array([[(x >> k) & 1 for x in q] for k in range(bits - 1, -1, -1)])
    return bits, np.packbits(planes.astype(np.uint8), axis=1).tobytes()


class Slices:
    """Vectors of a block as planes: planes[k] has a row of bits for each vector; the first plane is the sign's and has the weight -2^(bits - 1). Shorter vectors are padded with zeros, those of fewer planes by repeating the sign."""

    def __init__(self, bits: list[int], dims: list[int], data: list[bytes]):
        self.bits, self.dims = max(bits, default=1), max(dims, default=0)
        width = (self.dims + 7) // 8
        self.planes = np.zeros((self.bits, len(data), width), dtype=np.uint8)
        for shape in set(zip(bits, dims)):
            own = [i for i, s in enumerate(zip(bits, dims)) if s == shape]
            b, w = shape[0], (shape[1] + 7) // 8
            raw = np.frombuffer(b"".join(data[i] for i in own), dtype=np.uint8).reshape(len(own), b, w).transpose(1, 0, 2)
            self.planes[self.bits - b :, own, :w] = raw
            self.planes[: self.bits - b, own, :w] = raw[0]

    def bits_of(self, k: int, rows: np.ndarray, dims: int) -> np.ndarray:
        """Plane k of some vectors, a 0 or 1 for each component, with dims components."""
        found = np.unpackbits(self.planes[k][rows], axis=1)[:, : min(dims, self.dims)]
        return np.pad(found, ((0, 0), (0, dims - found.shape[1]))) if found.shape[1] < dims else found

    def weight(self, k: int) -> int:
        return -(1 << (self.bits - 1)) if k == 0 else 1 << (self.bits - 1 - k)

    def values(self, rows: np.ndarray) -> np.ndarray:
        """The integers themselves; as Python's where 64 bits are too few."""
        kind = np.int64 if self.bits < 60 else object
        out = np.zeros((len(rows), self.dims), dtype=kind)
        for k in range(self.bits):
            out += self.bits_of(k, rows, self.dims).astype(kind) * self.weight(k)
        return out


def _number(anchors: np.ndarray, bits: int):
    """A number type that holds all sums of these anchors exactly: 32-bit floats up to 2^24, 64-bit floats up to 2^53, else Python's integers."""
    most = int(np.abs(anchors).sum(axis=1).max(initial=0)) << (bits + 1)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def _sum(x: np.ndarray) -> np.ndarray:
    return x.sum(axis=1)[:, None] if x.shape[1] else np.zeros((len(x), 1), dtype=x.dtype)


def narrowed(anchors: np.ndarray, slices: Slices, rows: np.ndarray, alive: np.ndarray, judge) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows left, alive, scores) of anchors against rows of a block. alive: whether a row is a candidate of an anchor; judge(lower, upper, alive) tells which still are."""
    dims = max(anchors.shape[1], slices.dims)
    number = _number(anchors, slices.bits)
    a = np.zeros((len(anchors), dims), dtype=number)
    a[:, : anchors.shape[1]] = anchors
    above, below = _sum(np.where(a > 0, a, 0)), _sum(np.where(a < 0, a, 0))
    score = np.zeros((len(anchors), len(rows)), dtype=number)
    for k in range(slices.bits):
        plane = slices.bits_of(k, rows, dims).astype(number)
        score += (a @ plane.T) * number(slices.weight(k)) if number is not object else (a.dot(plane.T) * slices.weight(k) if dims else 0)
        rest = (1 << (slices.bits - 1 - k)) - 1
        if k:
            alive = judge(score + rest * below, score + rest * above, alive)
            stay = alive.any(axis=0)
            if stay.sum() < 0.8 * len(rows):
                rows, alive, score = rows[stay], alive[:, stay], score[:, stay]
    if slices.bits == 1:
        alive = judge(score, score, alive)
    return rows, alive, score


def _least(values: np.ndarray, sure: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest value among the sure ones of each row, or less than any where there are fewer."""
    if values.shape[1] < n:
        return np.full((len(values), 1), -np.inf)
    held = np.where(sure, values, -np.inf)
    return (np.partition(held, held.shape[1] - n, axis=1) if held.dtype != object else np.sort(held, axis=1))[:, held.shape[1] - n][:, None]


def best_of(n: int):
    """Judge of those that can be among the n best."""

    def judge(lower, upper, alive):
        return alive & (upper >= _least(lower, alive, n))

    return judge


def in_windows(low: np.ndarray, high: np.ndarray, n: int):
    """Judge of those that can be among the n best inside one of each anchor's windows (low and high: anchors by windows; low above high: none)."""
    least = np.where(low <= high, low, np.inf).min(axis=1)[:, None]
    most = np.where(low <= high, high, -np.inf).max(axis=1)[:, None]

    def judge(lower, upper, alive):
        alive = alive & (upper >= least) & (lower <= most)
        if alive.mean() > 0.1:  # windows are looked at one by one once there are fewer candidates
            return alive
        stay = np.zeros_like(alive)
        some = np.nonzero(alive.any(axis=0))[0]
        lo, up, own = lower[:, some], upper[:, some], alive[:, some]
        kept = np.zeros_like(own)
        for w in range(low.shape[1]):
            a, b = low[:, w][:, None], high[:, w][:, None]
            kept |= own & (up >= a) & (lo <= b) & (up >= _least(lo, own & (lo >= a) & (up <= b), n))
        stay[:, some] = kept
        return stay

    return judge


PREPARED = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("anchor", T.BooleanType()), T.StructField("bits", T.IntegerType()), T.StructField("dims", T.IntegerType()), T.StructField("planes", T.BinaryType())])
FOUND = T.StructType([T.StructField("row", T.LongType()), T.StructField("window", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of finite components whose squares' sum is under 2^63, sliced."""
    for batch in batches:
        out = []
        for id_, label, anchor, vector in zip(*(c.to_pylist() for c in batch.columns)):
            if any(x is None or x - x != 0 for x in vector):
                continue
            q = [int(256 * int(x)) if abs(x) > 1e15 else int(np.floor(256.0 * x)) for x in vector]
            if sum(x * x for x in q) < 1 << 63:
                out.append((id_, label, anchor, *((s := sliced(q))[0], len(q), s[1])))
        kinds = (pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=PREPARED.names)


def _ids(column) -> np.ndarray:
    """Ids, with null as the largest (it comes last among equals)."""
    return np.array([np.iinfo(np.int64).max if x is None else x for x in column.to_pylist()], dtype=np.int64)


def _in_tiles(anchors: DataFrame, rows: DataFrame, anchor_block: int, row_block: int, n_anchors: int, n_rows: int, same: bool, n: int) -> DataFrame:
    """FOUND: of each pair of blocks, each anchor's n best rows of the same label (or of other labels, in each of the anchor's windows). An anchor's own id is no candidate."""
    a_blocks, r_blocks = -(-n_anchors // anchor_block), -(-n_rows // row_block)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    a = anchors.withColumn("ab", F.pmod(F.xxhash64("row"), F.lit(max(a_blocks, 1))).cast("int")).withColumn("rb", each(r_blocks))
    r = rows.withColumn("rb", F.pmod(F.xxhash64("row"), F.lit(max(r_blocks, 1))).cast("int")).withColumn("ab", each(a_blocks))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        nulls = set()
        if left.num_rows and right.num_rows:
            own = Slices(*(left[c].to_pylist() for c in ("bits", "dims", "planes")))
            a_row, a_id, a_label = np.array(left["row"].to_pylist()), _ids(left["id"]), np.array(left["label"].to_pylist(), dtype=object)
            if not same:
                low, high = _windows(left)
            bits, dims, planes = (right[c].to_pylist() for c in ("bits", "dims", "planes"))
            ids, labels = _ids(right["id"]), np.array(right["label"].to_pylist(), dtype=object)
            nulls = {i for i, x in enumerate(right["id"].to_pylist()) if x is None}
            # vectors of very large components are worked on apart from the others
            large = np.array([b > 20 for b in bits])
            for group in (np.nonzero(~large)[0], np.nonzero(large)[0]):
                if not len(group):
                    continue
                slices = Slices([bits[i] for i in group], [dims[i] for i in group], [planes[i] for i in group])
                order = np.argsort(a_label, kind="stable")
                for at in range(0, len(order), STRIP):
                    strip = order[at : at + STRIP]
                    # of the same label: only rows of the strip's labels are looked at
                    rows_here = np.nonzero(np.isin(labels[group], list(set(a_label[strip].tolist()))))[0] if same else np.arange(len(group))
                    alive = (a_label[strip][:, None] == labels[group[rows_here]][None, :]) == same
                    alive &= a_id[strip][:, None] != ids[group[rows_here]][None, :]
                    judge = best_of(n) if same else in_windows(low[strip], high[strip], n)
                    left_rows, alive, score = narrowed(own.values(strip), slices, rows_here, alive, judge)
                    for i, anchor in enumerate(strip):
                        for w in range(1 if same else low.shape[1]):
                            good = np.nonzero(alive[i] if same else alive[i] & (score[i] >= low[anchor, w]) & (score[i] <= high[anchor, w]))[0]
                            if not len(good):
                                continue
                            places = group[left_rows[good]]
                            first = np.lexsort((ids[places], -score[i, good].astype(np.int64)))[:n]
                            out[0].append(np.full(len(first), a_row[anchor]))
                            out[1].append(np.full(len(first), w))
                            out[2].append(places[first])
                            out[3].append(score[i, good[first]].astype(np.int64))
        row, window, place, score = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out)
        found = [None if p in nulls else int(ids[p]) for p in place.tolist()] if len(place) else []
        return pa.Table.from_arrays([pa.array(row, pa.int64()), pa.array(window, pa.int32()), pa.array(found, pa.int64()), pa.array(score, pa.int64())], names=FOUND.names)

    tiles = bounded_batches(a).groupBy("ab", "rb").cogroup(r.groupBy("ab", "rb")).applyInArrow(compare, FOUND)
    best = Window.partitionBy("row", "window").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return tiles.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def _windows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The anchors' windows as two tables, filled up with empty ones; as Python's integers where floats don't hold them."""
    ends = [table[c].to_pylist() for c in ("low", "high")]
    width = max(len(w) for w in ends[0])
    number = np.float64 if max((abs(x) for e in ends for w in e for x in w), default=0) < 1 << 53 else object
    return tuple(np.array([w + [empty] * (width - len(w)) for w in e], dtype=number) for e, empty in zip(ends, (1, 0)))


def hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, anchor_block: int = 4096, row_block: int = 8192
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hard negatives of rows where anchor is true.

    Each component x is floor(256 x). A row's score is its integer inner product with the anchor (the shorter vector is padded with zeros); higher scores come first, ties by the smaller id, null last. An anchor's positives are its first positives rows of the same label and another id; for each, its first negatives rows of other labels with least * positive_score <= 100 * negative_score <= most * positive_score are returned, ranked from 1; a positive without any gives no row.

    Rows with a null label, a null vector, or a null or non-finite component take no part, nor do vectors whose integers' squares sum up to 2^63 or more, as a score might not be a long. Repeated rows count as rows of their own: a repeated anchor has its results twice, a repeated candidate takes a rank for each. An empty vector has the score 0. Other columns are not handed on. An empty table gives an empty table.
    """
    fields = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    prepared = bounded_batches(fields.filter("label is not null and v is not null")).mapInArrow(_prepare, PREPARED)
    spark, path = vectors.sparkSession, step_path(vectors.sparkSession, "vectors")
    rows = stored(prepared.withColumn("row", F.monotonically_increasing_id()), path=path)
    n_rows, n_anchors = rows.agg(F.count("*"), F.count(F.when(F.col("anchor"), 1))).first()
    anchors, rows = spark.read.schema(rows.schema).parquet(path).filter("anchor").drop("anchor"), rows.drop("anchor")
    first = _in_tiles(anchors, rows, anchor_block, row_block, n_anchors, n_rows, True, positives)
    chosen = stored(first.select("row", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 50 p <= 100 s <= 95 p in whole numbers, by decimals as 100 s may not be a long
    p = F.col("positive_score").cast("decimal(38,0)")
    windows = chosen.select("row", "place", F.ceil(p * least / 100).cast("decimal(38,0)").cast("long").alias("low"), F.floor(p * most / 100).cast("decimal(38,0)").cast("long").alias("high"))
    windows = windows.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("w"))
    windows = windows.select("row", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    second = _in_tiles(anchors.join(windows, "row"), rows, anchor_block, row_block, n_anchors, n_rows, False, negatives)
    second = second.select("row", (F.col("window") + 1).alias("place"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return chosen.join(second, ["row", "place"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row").select(*OUTPUT)
