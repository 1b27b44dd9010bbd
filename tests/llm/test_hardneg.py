"""Hard negatives against all scores in Python's integers."""

import math
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm import hardneg
from tests.llm.data import stored

SCHEMA = "vec_id long, embedding array<double>, label int, row string, `a.b` string, score long"


def brute(rows, anchor, positives=5, negatives=3, least=50, most=95):
    kept = []
    for id_, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            q = [math.floor(256 * x) for x in vector]
            if sum(x * x for x in q) < 1 << 63:
                kept.append((id_, q, label))
    order = lambda scored: sorted(scored, key=lambda s: (-s[0], s[1] is None, s[1] or 0))
    out = []
    for id_, q, label in (k for k in kept if anchor(k[0])):
        scored = [(sum(a * b for a, b in zip(q, r)), i, other) for i, r, other in kept if i != id_]
        for p, pid, _ in order(s for s in scored if s[2] == label)[:positives]:
            good = order(s for s in scored if s[2] != label and least * p <= 100 * s[0] <= most * p)
            out += [(id_, pid, k + 1, s[1], p, s[0]) for k, s in enumerate(good[:negatives])]
    return sorted(out, key=repr)


def found(spark, tmp_path, rows, **options):
    df = stored(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA), tmp_path)
    made = hardneg.hard_negatives(df, F.col("vec_id") % 5 == 0, **options)
    assert made.columns == list(hardneg.OUTPUT)
    return sorted((tuple(r) for r in made.collect()), key=repr)


def vectors(n, dims, seed, scale=0.2):
    rng = random.Random(seed)
    centre = [rng.gauss(0, scale) for _ in range(dims)]
    return [(i, [c + rng.gauss(0, scale) for c in centre], rng.choice([0, 0, 1, 2])) for i in range(n)]


def test_small_blocks(spark, tmp_path):
    rows = vectors(150, 16, 1)
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 100
    assert found(spark, tmp_path, rows, anchor_block=7, row_block=20) == want


def test_awkward_rows(spark, tmp_path):
    rows = vectors(60, 6, 2)
    rows += [(None, rows[3][1], 1), (61, None, 1), (65, [0.1, None, 0.2, 0.0, 0.0, 0.0], 0), (66, [float("inf")] * 6, 0), (67, [float("nan")] * 6, 0), (70, [], 1), (71, [0.3], 0), (72, [0.2] * 9, 2), (75, rows[5][1], None)]
    rows += [rows[5], rows[7], rows[7], (80, [3000.0, -2e6, 0.5, 1.0, 2.0, 3.0], 0), (81, [3000.0, -1.9e6, 0.5, 1.0, 2.0, 3.0], 0), (82, [2000.0, -1.5e6, 0.0, 1.0, 2.0, 3.0], 1), (85, [1e12] * 6, 0)]
    rows += [(100 + i, [0.25, 0.25], i % 2) for i in range(12)]  # ties
    want = brute(rows, lambda i: i is not None and i % 5 == 0)
    assert found(spark, tmp_path, rows, anchor_block=5, row_block=16) == want


def test_empty(spark, tmp_path):
    assert found(spark, tmp_path, [(1, [0.1], 1)]) == [] and found(spark, tmp_path / "n", [(5, None, 1)]) == []
    assert hardneg.hard_negatives(spark.createDataFrame([], T._parse_datatype_string(SCHEMA)), F.col("vec_id") % 5 == 0).count() == 0


def test_slices_give_back_their_integers():
    rng = random.Random(3)
    rows = [[rng.randint(-(2**b), 2**b) for _ in range(d)] for b in (0, 3, 9, 30) for d in (1, 5, 8, 17)]
    made = [hardneg.sliced(r) for r in rows]
    slices = hardneg.Slices([b for b, _ in made], [len(r) for r in rows], [p for _, p in made])
    values = slices.values(np.arange(len(rows)))
    assert [v[: len(r)].tolist() for v, r in zip(values, rows)] == rows


def test_intervals_drop_rows_early():
    rng = np.random.default_rng(7)
    q = rng.integers(-60, 60, (500, 32))
    made = [hardneg.sliced(r.tolist()) for r in q]
    slices = hardneg.Slices([b for b, _ in made], [32] * 500, [p for _, p in made])
    seen = []
    judge = hardneg.best_of(5)

    def watched(lower, upper, alive):
        seen.append(int(alive.sum()))
        return judge(lower, upper, alive)

    rows, alive, score = hardneg.narrowed(q[:3], slices, np.arange(500), np.ones((3, 500), dtype=bool), watched)
    assert seen[-1] < seen[0] / 5
    for i in range(3):
        exact = q @ q[i]
        best = np.sort(exact)[-5:]
        assert sorted(score[i, alive[i]].astype(int))[-5:] == best.tolist()
