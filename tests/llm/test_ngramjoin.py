"""The n-gram join against all pairs of sets; keys of subsets, lists and tiles each on their own."""

import itertools
import random
import re

import numpy as np
import pytest

from folioscope.llm import ngramjoin
from folioscope.llm.common import ascii_lower
from tests.llm.data import documents, empty, stored, words


def shingle_set(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def brute(rows, percent=80):
    """(n_shingles, component_id) of each row."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            up[root(i)] = root(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[root(i)] = min(id_, least.get(root(i), id_))
    return sorted(((id_, len(sets[i]), least.get(root(i))) for i, (id_, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def corpus(seed):
    """Short and long texts, copies, chains of near copies, and passages that many texts share."""
    rng = random.Random(seed)
    common = words(rng, 14)
    out = [words(rng, n) for n in range(1, 30)]
    for n in (6, 7, 9, 11, 13, 16, 20, 40, 200):
        text = words(rng, n).split()
        for _ in range(6):
            out.append(" ".join(text))
            text = list(text)
            text[rng.choice([0, -1, rng.randrange(n)])] = words(rng, 1)
    out += [f"{common} {words(rng, k)}" for k in (1, 1, 1, 2, 2, 3, 30, 30)] + [f"{words(rng, 1)} {common}" for _ in range(4)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("bits", [6, 22])
def test_all_pairs(spark, tmp_path, bits):
    rows = corpus(3)
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path)
    assert found(ngramjoin.ngram_components(docs, bits=bits, tile=2)) == brute(rows)


def test_awkward_rows(spark, tmp_path):
    docs = stored(documents(spark, [(3, "another text of the same id", *[None] * 18)]), tmp_path)
    made = ngramjoin.ngram_components(docs)
    assert made.columns == [*docs.columns, *ngramjoin.OUTPUT]
    assert found(made) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert ngramjoin.ngram_components(empty(spark)).count() == 0


def test_names_stay(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b c d e f g h", "kept", 7, 8) for i in range(3)], "doc_id long, text string, `a.b` string, node int, digest int")
    rows = ngramjoin.ngram_components(stored(docs, tmp_path), broadcast_rows=1).collect()
    assert {(r["a.b"], r["node"], r["digest"], r.component_id) for r in rows} == {("kept", 7, 8, 0)}


@pytest.mark.parametrize("boundary", [6, 12])
def test_light_sets_share_a_key_if_and_only_if_linked(boundary):
    rng, law = random.Random(boundary), ngramjoin.Law(80)
    sets = []
    for _ in range(60):
        own = rng.sample(range(1000), rng.randint(1, boundary))
        for _ in range(3):
            sets.append(frozenset(own))
            own = [*own[1:], *rng.sample(range(1000), 1)] if rng.random() < 0.5 or len(own) == boundary else [*own, rng.randint(2000, 3000)]
    sets = sorted(set(sets), key=sorted)
    keys = [ngramjoin.subset_keys(np.array(sorted(s), dtype=np.uint64), law.subsets(len(s), boundary)) for s in sets]
    for (a, ka), (b, kb) in itertools.combinations(zip(sets, keys), 2):
        shared = any(k == m and (s | t) == 3 for k, s in ka for m, t in kb)
        assert shared == (100 * len(a & b) >= 80 * len(a | b))


def test_boundary_follows_cost():
    law = ngramjoin.Law(80)
    sizes = {a: 1000 for a in range(1, 17)}
    cheap, dear = law.boundary(sizes, 0.0), law.boundary(sizes, 500.0)
    assert cheap <= dear and dear >= 8


def test_tile_scan_is_exact():
    rng = random.Random(9)
    base = [rng.sample(range(10_000), 50) for _ in range(5)]
    sets = [np.unique(np.array([*b[: 50 - k], *rng.sample(range(10_000, 90_000), k)], dtype=np.uint64)) for b in base for k in range(0, 12, 2)]
    n, law = len(sets), ngramjoin.Law(80)
    pairs = {(i, j) for i, j in itertools.combinations(range(n), 2) if law.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    links = ngramjoin.scanned(list(range(n)), list(range(n)), [0] * n, sets, law)
    assert set(links) <= pairs
    halves = [i % 2 for i in range(n)]
    assert set(ngramjoin.scanned(list(range(n)), list(range(n)), halves, sets, law)) <= {(i, j) for i, j in pairs if halves[i] != halves[j]}

    def classes(edges):
        up = list(range(n))
        for _ in range(n):
            for i, j in edges:
                up[i] = up[j] = min(up[i], up[j])
        return up

    assert classes(links) == classes(pairs)
    roots = classes(pairs)
    assert ngramjoin.scanned(list(range(n)), roots, [0] * n, sets, law) == []


def test_driver_gets_a_byte_for_each_cell(spark, monkeypatch):
    """Of the count table the driver gets levels, a byte each, and a few numbers for each piece; not the counts."""
    from folioscope.llm import ngramjoin

    docs = spark.createDataFrame([(" ".join(f"w{i * j % 97}" for i in range(40)),) for j in range(1, 30)], "text string")
    got, read = [], type(docs).toLocalIterator

    def counted(self, *args):
        for row in read(self, *args):
            got.append(sum(len(x) for x in row if isinstance(x, bytes | bytearray)))
            yield row

    monkeypatch.setattr(type(docs), "toLocalIterator", counted)
    level, sizes, length = ngramjoin.count_table(docs, 5, 16)
    assert sum(got) <= (1 << 16) + 8 * ngramjoin.CELLS
    counts = np.zeros(1 << 16, dtype=np.int64)
    for elements in ngramjoin.sets_of([r.text for r in docs.collect()], 5):
        np.add.at(counts, ngramjoin._cell(elements, 16), 1)
    assert (level == np.where(counts > 0, np.minimum(8 * np.log2(np.maximum(counts, 1)), 255), 0).astype(np.uint8)).all()
    assert length == max(float((counts.astype(float) ** 2).sum()) / counts.sum() - counts.sum() / (1 << 16), 0.0) and sizes == {}
