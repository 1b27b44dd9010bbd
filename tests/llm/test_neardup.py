"""Near duplicates against all pairs, and the signature's law."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import neardup
from folioscope.llm.common import ascii_lower, words_of
from tests.llm.data import SCHEMA, documents, empty, stored, words


def shingle_counts(text):
    w = words_of(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def shingle_set(text):
    return set(shingle_counts(text))


def exact_probability_jaccard(a, b):
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def similar(a, b):
    """Of two counters: the Jaccard similarity of the sets, or the probability Jaccard with weights 1 + ln(count)."""
    if len(a.keys() & b.keys()) >= 0.8 * len(a.keys() | b.keys()):
        return True
    if max(*a.values(), *b.values()) == 1:
        return False
    return exact_probability_jaccard(*({k: 1 + math.log(n) for k, n in x.items()} for x in (a, b))) >= 0.8


def classes(rows):
    """Smallest id of each row's class, by comparing all pairs."""
    nodes = defaultdict(list)
    for i, t in rows:
        nodes[ascii_lower(t or "")].append(i)
    names, sets = list(nodes), [shingle_counts(n) for n in nodes]
    up = list(range(len(names)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            if sets[a] and sets[b] and not sets[a].keys().isdisjoint(sets[b]) and similar(sets[a], sets[b]):
                up[root(a)] = root(b)
    members = defaultdict(list)
    for k, n in enumerate(names):
        members[root(k)] += nodes[n]
    least = lambda ids: None if None in ids else min(ids)
    return {n: (least(members[root(k)]), len(members[root(k)])) for k, n in enumerate(names)}


def test_all_pairs(spark, tmp_path):
    rng = random.Random(4)
    extra, n = [], 100
    for _ in range(30):
        base = words(rng, rng.randint(20, 150)).split()
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            extra.append((n, " ".join(copy), *[None] * 18))
            n += 1
    docs = stored(documents(spark, extra), tmp_path)
    want = classes([(r.doc_id, r.text) for r in docs.collect()])
    rows = neardup.near_groups(docs, tile=8).collect()  # small tiles: groups are dealt over several
    assert len(rows) == docs.count()
    kept = defaultdict(int)
    for r in rows:
        assert (r.class_id, r.class_size) == want[ascii_lower(r.text or "")], r.text
        kept[want[ascii_lower(r.text or "")], r.class_id if r.class_size > 1 else (r.text, r.doc_id)] += r.kept
    assert sum(kept.values()) == neardup.near_dedup(docs).count()
    left = neardup.near_dedup(docs)
    assert set(left.columns) <= set(SCHEMA.names)


def test_one_group_of_a_third(spark, tmp_path):
    rng = random.Random(5)
    base = words(rng, 100).split()
    rows = []
    for i in range(400):
        copy = list(base) if i % 3 == 0 else words(rng, 30).split()
        if i % 3 == 0:
            copy[rng.randrange(100)] = words(rng, 1)
        rows.append((i, " ".join(copy), *[None] * 18))
    docs = stored(spark.createDataFrame(rows, SCHEMA), tmp_path)
    want = classes([(r[0], r[1]) for r in rows])
    assert all((r.class_id, r.class_size) == want[r.text] for r in neardup.near_groups(docs, tile=16).collect())


def test_repeated_passages(spark, tmp_path):
    """Texts whose sets are similar are linked, however often either repeats a passage."""
    rng = random.Random(6)
    rows = []
    for times in (5, 50, 500):
        for share in (0.2, 0.3):
            for changed in (0, 3):
                for _ in range(6):
                    base = words(rng, 200).split()
                    passage, rest = base[: int(200 * share)], base[int(200 * share) :]
                    again = list(rest)
                    for k in range(changed):
                        again[10 + 30 * k] = words(rng, 1)
                    rows += [(len(rows), " ".join(base), *[None] * 18), (len(rows) + 1, " ".join(passage * times + again), *[None] * 18)]
    docs = stored(spark.createDataFrame(rows, SCHEMA), tmp_path)
    want = classes([(r[0], r[1]) for r in rows])
    assert {n for _, n in want.values()} == {2}
    assert all((r.class_id, r.class_size) == want[r.text] for r in neardup.near_groups(docs).collect())


def test_weighted_links(spark, tmp_path):
    """Texts that are alike by their weights alone: a passage of both, repeated, outweighs what only one has."""
    rng = random.Random(9)
    rows = []
    for _ in range(30):
        passage = words(rng, 40)
        rows += [(len(rows) + k, " ".join([passage] * 60 + [words(rng, extra)]), *[None] * 18) for k, extra in enumerate((11, 12))]
    want = classes([(r[0], r[1]) for r in rows])
    sets = [shingle_set(r[1]) for r in rows]
    assert all(len(a & b) < 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2])) and {n for _, n in want.values()} == {2}
    docs = stored(spark.createDataFrame(rows, SCHEMA), tmp_path)
    assert all((r.class_id, r.class_size) == want[r.text] for r in neardup.near_groups(docs).collect())


def test_probability_jaccard():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = ({int(k): float(rng.integers(1, 5)) for k in rng.integers(1, 40, rng.integers(1, 30))} for _ in range(2))
        arrays = [(np.array(sorted(x), dtype=np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert abs(neardup.probability_jaccard(*arrays[0], *arrays[1]) - exact_probability_jaccard(a, b)) < 1e-9


def test_not_from_files(spark):
    """A table whose rows come in another order at each reading."""
    rows = [(i, f"one two three four five six {i % 7}", *[None] * 18) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("lang", F.rand().cast("string"))
    found = neardup.near_groups(docs).collect()
    assert sum(r.kept for r in found) == len({r.class_id for r in found})


def test_empty(spark):
    assert neardup.near_groups(empty(spark)).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    slots, a, b = 4000, {}, {}
    for e in rng.integers(1, 1 << 62, 60).tolist():
        if rng.random() < 0.8:
            a[e] = float(rng.integers(1, 4))
        if rng.random() < 0.8:
            b[e] = float(rng.integers(1, 4))
    sign = lambda x: neardup.prob_minhash(np.zeros(len(x), dtype=np.int64), np.array(list(x), dtype=np.uint64), np.array(list(x.values())), 1, slots)[0]
    exact = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
    assert abs((sign(a) == sign(b)).mean() - exact) < 4 * np.sqrt(exact * (1 - exact) / slots)


def test_shingles_do_not_cross_documents():
    texts = ["a b c d e f", "g h", None, "a b c d e f a b c d e f", "!!"]
    doc, element, count, _ = neardup.shingles(texts)
    for i, t in enumerate(texts):
        assert (doc == i).sum() == len(shingle_set(t))
        alone = neardup.shingles([t])
        assert sorted(zip(alone[1].tolist(), alone[2].tolist())) == sorted(zip(element[doc == i].tolist(), count[doc == i].tolist()))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    name = lambda i: b"%04d" % i
    df = spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in edges], neardup.LINK)
    got = {bytes(r.node): bytes(r.root) for r in neardup.components(df).collect()}
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        x, y = root(name(a)), root(name(b))
        up[max(x, y)] = min(x, y)
    assert all(got.get(x, x) == root(x) for x in up)
