"""Sharding and exact deduplication against plain Python."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import exactdup, sharding
from folioscope.llm.common import ascii_lower
from tests.llm.data import SCHEMA, documents, empty, stored


def draw(key: str | None, path: str, weight: float) -> float:
    seed = 42
    if key is not None:
        seed = xxhash.xxh64(key.encode(), seed=seed).intdigest()
    u = ((xxhash.xxh64(path.encode(), seed=seed).intdigest() >> 11) + 0.5) / 2**53
    return -math.log(u) / weight


def place(key, tree: sharding.ShardTree) -> int:
    least = lambda prefix, weights: min(range(len(weights)), key=lambda i: draw(key, f"{prefix}{i}", weights[i]))
    r = least("r", [sum(map(sum, x)) for x in tree.regions])
    k = least(f"r{r}/k", [sum(x) for x in tree.regions[r]])
    s = least(f"r{r}/k{k}/s", list(tree.regions[r][k]))
    flat = [(i, j, m) for i, a in enumerate(tree.regions) for j, b in enumerate(a) for m in range(len(b))]
    return flat.index((r, k, s))


def test_shards_as_by_hand(spark, tmp_path):
    docs = stored(documents(spark), tmp_path)
    tree = sharding.ShardTree(regions=(((1.0, 2.0), (1.0,)), ((3.0, 1.0, 1.0),)))
    rows = sharding.shard(docs, tree).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        key = None if r.doc_id is None else str(r.doc_id)
        data = (r.text or "").encode()
        assert r["shard"] == place(key, tree)
        assert r.grown_shard == place(key, tree.grown())
        assert r.grown_shard in (r["shard"], tree.size)
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        slots[r["shard"]].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_follow_weights(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    tree = sharding.ShardTree((((1.0, 3.0), (2.0,)), ((2.0,),)))
    n = Counter(r["shard"] for r in sharding.shard(docs, tree, grow=None).select("shard", "grown_shard").collect())
    for shard, share in enumerate((1 / 8, 3 / 8, 2 / 8, 2 / 8)):
        assert abs(n[shard] / 20_000 - share) < 0.015


def test_a_change_stays_in_its_subtree(spark):
    docs = spark.range(5_000).selectExpr("id as doc_id", "'x' as text")
    a = sharding.ShardTree((((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0),)))
    b = sharding.ShardTree((((1.0, 1.0), (1.5, 0.5)), ((1.0, 1.0),)))  # two shards of one rack trade weight
    moved = [(x["shard"], y["shard"]) for x, y in zip(*(sorted(sharding.shard(docs, t).collect(), key=lambda r: r.doc_id) for t in (a, b))) if x["shard"] != y["shard"]]
    assert moved and set(moved) == {(3, 2)}


def test_native_empty_and_bad(spark):
    assert sharding.shard(empty(spark), sharding.ShardTree.even(2, 3, 4)).count() == 0
    assert exactdup.exact_groups(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        sharding.ShardTree(((),))
    with pytest.raises(ValueError):
        sharding.ShardTree((((0.0,),),))
    with pytest.raises(ValueError):
        exactdup.exact_groups(empty(spark), most_bits=100)


def test_filter_grows_with_the_rows(spark, tmp_path):
    """The share of rows that the filter lets through stays near the share of repeats at ten times the rows."""
    for n in (20_000, 200_000):
        rows = spark.range(n).select((F.col("id") - F.when(F.col("id") % 10 == 0, F.col("id") % 20).otherwise(0)).cast("string").alias("t"))
        size = exactdup.filter_size(n, 1 << 30)
        keys = rows.select(F.unhex(F.sha2("t", 256)).alias("digest"))
        bits = exactdup.repeated_cells(keys, "digest", size)
        share = exactdup.seen(keys, "digest", bits, size).filter("__maybe").count() / n
        assert 0.1 <= share < 0.13
    assert exactdup.filter_size(10**12, 1 << 30) == 1 << 30


@pytest.mark.parametrize("bits", [1 << 15, 1 << 27])
def test_exact_groups(spark, tmp_path, bits):
    """With a filter so small that it errs, and with the standard one."""
    more = [(100 + i, "Same Text" if i % 2 else "sAME tEXT", *[None] * 18) for i in range(500)] + [(1000 + i, f"other {i}", *[None] * 18) for i in range(3000)]
    docs = stored(documents(spark, more), tmp_path)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[ascii_lower(r.text or "")].append(r.doc_id)
    rows = exactdup.exact_groups(docs, most_bits=bits).collect()
    assert len(rows) == docs.count()
    kept = Counter()
    for r in rows:
        ids = groups[ascii_lower(r.text or "")]
        known = [i for i in ids if i is not None]
        assert (r.keep_id, r.group_size) == (max(known, default=None), len(ids))
        assert r.text_sha256 == hashlib.sha256(ascii_lower(r.text or "").encode()).hexdigest()
        if r.kept:
            assert r.doc_id == r.keep_id
            kept[r.text_sha256] += 1
    assert len(kept) == len(groups) and set(kept.values()) == {1}
    left = exactdup.exact_dedup(docs)
    assert left.count() == len(groups) and set(left.columns) <= set(SCHEMA.names)
