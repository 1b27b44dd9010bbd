"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws -ln(u) / weight, where u is a hash of the key and the child's path, and the smallest draw wins; so a child gets keys in proportion to its weight, and a change of one child's weight moves keys only to or from that child. Capacity is added as a new subtree at the root: the weights of the old subtrees stay, hence every key that moves goes into the new shard.

All of it is DataFrame functions; only doc_id and the text's size and checksum are read, and texts are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import adding_columns

OUTPUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


@dataclass(frozen=True)
class ShardTree:
    """Weights of the shards by region and rack; shards are numbered from 0 in this order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    def __post_init__(self):
        if not self.regions or any(not racks or any(not rack for rack in racks) for racks in self.regions):
            raise ValueError("every region needs a rack and every rack a shard")
        if any(w <= 0 for racks in self.regions for rack in racks for w in rack):
            raise ValueError("weights are positive")

    @classmethod
    def even(cls, regions: int, racks: int, shards: int) -> ShardTree:
        return cls(((((1.0,) * shards),) * racks,) * regions)

    def grown(self, weight: float = 1.0) -> ShardTree:
        """This tree and one shard more, in a region of its own."""
        return ShardTree((*self.regions, ((weight,),)))

    @property
    def size(self) -> int:
        return sum(len(rack) for racks in self.regions for rack in racks)


def _draw(key: Column, path: str, weight: float) -> Column:
    """Exponential with the weight as its rate, fixed by key and path; 53 bits of the hash make u."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(weight)


def _winner(key: Column, prefix: str, weights: list[float]) -> Column:
    """The place of the child with the smallest draw; the first of equal ones."""
    if len(weights) == 1:
        return F.lit(0)
    return F.array_min(F.array(*[F.struct(_draw(key, f"{prefix}{i}", w).alias("d"), F.lit(i).alias("i")) for i, w in enumerate(weights)]))["i"]


def _choose(on: Column, options: list[Column]) -> Column:
    out = options[-1]
    for i in range(len(options) - 2, -1, -1):
        out = F.when(on == i, options[i]).otherwise(out)
    return out


def place(df: DataFrame, tree: ShardTree, key: Column, out: str) -> DataFrame:
    """df with the shard of each key in column out."""
    r, k = "__region", "__rack"
    df = df.withColumn(r, _winner(key, "r", [sum(map(sum, racks)) for racks in tree.regions]))
    df = df.withColumn(k, _choose(F.col(r), [_winner(key, f"r{i}/k", [sum(rack) for rack in racks]) for i, racks in enumerate(tree.regions)]))
    first, leaves = 0, []
    for i, racks in enumerate(tree.regions):
        own = []
        for j, rack in enumerate(racks):
            own.append(_winner(key, f"r{i}/k{j}/s", list(rack)) + F.lit(first))
            first += len(rack)
        leaves.append(_choose(F.col(k), own))
    return df.withColumn(out, _choose(F.col(r), leaves).cast("int")).drop(r, k)


def shard(docs: DataFrame, tree: ShardTree, grow: float | None = 1.0, id_col: str = "doc_id", text_col: str = "text", run_rows: int = 500_000) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard; input columns of these names give way, all others stay.

    Size is the text's UTF-8 bytes (null: 0) plus 8. The shard depends on the id and the tree only (a null id is a key like any other). Slots are gapless from 0 in each shard: a shard's rows are numbered in runs (by a hash of id and text; of about run_rows rows, but 64 runs at least), and runs are put one behind the other, so that no task holds a whole shard; rows that repeat id and text get neighbouring slots in any order. grown_shard is the shard after tree.grown(grow), or null where grow is None. An empty table gives an empty table.
    """
    return adding_columns(docs, OUTPUT, lambda d, name: _sharded(d, tree, grow, name[id_col], name[text_col], run_rows))


def _sharded(docs: DataFrame, tree: ShardTree, grow: float | None, id_col: str, text_col: str, run_rows: int) -> DataFrame:
    key = F.col(id_col).cast("string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.withColumns({"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text.cast("binary")), "law": F.lit("key")})
    df = place(df, tree, key, "shard")
    if grow is None:
        df = df.withColumn("grown_shard", F.lit(None).cast("int"))
    else:
        old = F.array_min(F.array(*[_draw(key, f"r{i}", sum(map(sum, racks))) for i, racks in enumerate(tree.regions)]))
        df = df.withColumn("grown_shard", F.when(_draw(key, f"r{len(tree.regions)}", grow) < old, F.lit(tree.size)).otherwise(F.col("shard")))
    runs = max(64, -(-docs.count() // (tree.size * run_rows)))
    df = df.withColumn("__run", F.pmod(F.xxhash64(key, F.col("text_crc32")), F.lit(runs)).cast("int"))
    by_shard = Window.partitionBy("shard").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each run: 64 for each shard, or one for every run_rows rows of the table
    starts = df.groupBy("shard", "__run").agg(F.count("*").alias("__n")).select("shard", "__run", F.coalesce(F.sum("__n").over(by_shard), F.lit(0)).alias("__start"))
    own = Window.partitionBy("shard", "__run").orderBy(key, "text_crc32", "size")
    numbered = df.withColumn("__rank", F.row_number().over(own)).join(F.broadcast(starts), ["shard", "__run"])
    return numbered.withColumn("slot", (F.col("__start") + F.col("__rank") - 1).cast("long")).select(*[c for c in df.columns if c not in ("__run", *OUTPUT)], *OUTPUT)
