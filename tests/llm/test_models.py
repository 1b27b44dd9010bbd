"""The two classifiers: held-out accuracy on labelled documents, and awkward input."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import quality, queries, toxicity
from tests.llm.data import documents, empty, stored

SF = "/root/testdata/sf0.01"


def held_out(spark, name, label, n, rest):
    rows = queries.queries()[name](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    bad = rows.filter("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count()
    assert bad == 0
    found = rows.filter("held_out").join(labels, "doc_id").collect()
    assert found and all(np.array([r.held_out for r in found]))
    return [(r[label], r.predicted) for r in found]


def test_quality_held_out(spark):
    pairs = held_out(spark, "op4_quality", "quality", 5, 0)
    assert np.mean([a == b for a, b in pairs]) > 0.95


def test_toxicity_held_out(spark):
    pairs = held_out(spark, "op9_toxicity", "toxic", 4, 2)
    assert np.mean([a == b for a, b in pairs]) > 0.9
    assert np.mean([b for a, b in pairs if a == 0]) < 0.03


def test_toxicity_by_language(spark):
    """Held-out recall in each language with 30 toxic labels or more."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    labelled = docs.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("toxic is not null")
    enough = {r.lang for r in labelled.filter("toxic = 1").groupBy("lang").count().filter("count >= 30").collect()}
    tried = labelled.filter(queries._remainder(4) == 2)
    found = toxicity.toxicity(tried, queries.toxicity_model(spark, sf), keep=["doc_id", "lang", "toxic"]).collect()
    assert enough == {"en", "de", "fr", "es"}
    for lang in enough:
        assert np.mean([r.predicted for r in found if r.lang == lang and r.toxic == 1]) >= 0.8, lang
    assert np.mean([r.predicted for r in found if r.toxic == 0]) < 0.02


def plain_quality(text, model):
    """The score by loops over tokens, passages and units."""
    tokens = (text or "").split()
    rows = []
    for at in range(0, len(tokens), 60):
        own = tokens[at : at + 60]
        mean = [0.0] * 17
        for t in own:
            n, letters, digits = len(t), sum(c.isalpha() for c in t), sum(c.isdigit() for c in t)
            upper = 0 if t.islower() else 1 if t.istitle() else sum(c.isupper() for c in t)
            code = zlib.crc32(t[:3].lower().encode())
            row = [min(n, 20) / 10, letters / n, upper / n, digits / n, (n - letters - digits) / n, t[-1] in ".!?", letters > 1 and upper == letters, letters == 0, n > 20]
            row += [(1 if code & 256 else -1) if k == code % 8 else 0 for k in range(8)]
            mean = [m + x / len(own) for m, x in zip(mean, row)]
        same = sum(at + k > 0 and tokens[at + k] == tokens[at + k - 1] for k in range(len(own))) / len(own)
        rows.append([*mean, len(set(own)) / len(own), same, len(own) / 60, math.log1p(-(-len(tokens) // 60)) / 5, len(set(tokens)) / len(tokens)])
    rows = rows or [[0.0] * 22]
    p, sigmoid = model.weights, lambda x: 1 / (1 + math.exp(-x))
    hidden, gates = [], []
    for row in rows:
        x = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(row, model.mean, model.spread)]
        h = [math.tanh(sum(v * p["E"][i][j] for i, v in enumerate(x)) + p["e"][j]) for j in range(len(p["e"]))]
        gate = [math.tanh(sum(v * p["V"][i][j] for i, v in enumerate(h))) * sigmoid(sum(v * p["U"][i][j] for i, v in enumerate(h))) for j in range(len(p["w"]))]
        hidden.append(h)
        gates.append(math.exp(sum(g * w for g, w in zip(gate, p["w"]))))
    z = [sum(g * h[j] for g, h in zip(gates, hidden)) / sum(gates) for j in range(len(p["e"]))]
    return sigmoid(sum(v * c for v, c in zip(z, p["c"])) + float(p["b"]))


def plain_toxicity(text, model):
    """The score by loops over tokens, trees and the steps of the calibration."""
    roots = frozenset(t[: toxicity.ROOT].rstrip("*") for t in (*model.lexicon, *model.dense, *toxicity.SEEDS))
    tokens = (text or "").split()
    rows = [toxicity.token_features(t, model.lexicon, model.dense, roots) for t in tokens]
    s = [sum(column) for column in zip(*rows)] if rows else [0.0] * toxicity.WIDTH
    bad = [i for i, r in enumerate(rows) if r[0] > 0 or r[2] > 0 or r[3] > 0]
    second = [i for i, r in enumerate(rows) if r[4] > 0]
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i in bad)
    n, letters, chars, log = max(len(tokens), 1), max(s[7], 1), max(len(text or ""), 1), math.log1p
    x = [s[0] / n, log(s[0]), s[1] / n, log(s[2]), max((r[1] for r in rows), default=0), s[3] / n, log(s[3]), s[4] / n, log(near), near / n, s[5] / n, s[6] / letters, s[8] / chars, s[9] / chars, s[10] / chars, s[11] / n, s[12] / n]
    x += [log(len(tokens)), s[13] / n, log(s[13]), max((r[13] for r in rows), default=0)]
    total = model.trees.base
    for feature, cut, value in model.trees.trees:
        node = 0
        while node < 2**model.trees.depth - 1 and feature[node] >= 0:
            node = 2 * node + 1 + (x[feature[node]] > cut[node])
        total += value[node]
    at, p = model.at.tolist(), np.maximum.accumulate(model.probability).tolist()
    if total <= at[0] or len(at) == 1:
        return p[0]
    for k in range(1, len(at)):
        if total <= at[k]:
            return p[k - 1] + (p[k] - p[k - 1]) * (total - at[k - 1]) / (at[k] - at[k - 1])
    return p[-1]


def test_scores_by_brute_force(spark, sf):
    """Each score of both queries, worked out without arrays."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    models = {"op4_quality": (plain_quality, quality.fit(queries._labelled(spark, sf, "quality", queries._remainder(5) != 0))), "op9_toxicity": (plain_toxicity, queries.toxicity_model(spark, sf))}
    for name, (plain, model) in models.items():
        rows = queries.queries()[name](spark, sf).collect()
        assert len(rows) == len(docs)
        for r in rows:
            assert abs(r.score - plain(docs[r.doc_id], model)) < 1e-4, (name, r.doc_id)
            n, left = (5, 0) if name == "op4_quality" else (4, 2)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == left)


def test_dense_terms():
    counts = Counter({"abcdef": 3, "xy": 1, "abcdzz": 1})
    text = " ".join([w for w, n in counts.items() for _ in range(n)] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)])
    assert toxicity.dense_terms(text) == ["abcd*", "abcde*", "abcdef"]
    assert toxicity.dense_terms(None) == []


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    x, starts, y = rng.normal(size=(12, quality.WIDTH)), np.array([0, 3, 7, 8]), np.array([1.0, 0.0, 1.0, 0.0])
    model = quality.Attention.new(x, 5, 3, 0.5)
    loss = lambda: -np.mean(y * np.log(model.forward(x, starts)["y"]) + (1 - y) * np.log(1 - model.forward(x, starts)["y"]))
    gradient = model.gradient(x, starts, y, 0.0)
    for k, w in model.weights.items():
        flat = w.reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 5)):
            kept = flat[i]
            flat[i] = kept + 1e-5
            up = loss()
            flat[i] = kept - 1e-5
            down = loss()
            flat[i] = kept
            assert abs((up - down) / 2e-5 - gradient[k].reshape(-1)[i]) < 1e-6, k


def test_isotonic_and_trees():
    score, y = np.array([0.1, 0.2, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 0, 1, 1.0])
    at, p = toxicity.isotonic(score, y)
    assert (np.diff(at) > 0).all() and (np.diff(p) >= 0).all()
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    assert (((toxicity.Trees().fit(x, y).score(x)) > 0) == y).mean() > 0.95
    assert np.allclose(toxicity.Trees().fit(x, np.zeros(600)).score(x), np.log(1e-3 / (1 - 1e-3)))


def test_obfuscated_words_count():
    plain = toxicity.features(["he is here and there"], {}, {})
    for bad in ("he is an idiot", "he is an 1d1ot", "he is an i.d.i.o.t", "he is stuuupid"):
        row = dict(zip(toxicity.FEATURES, toxicity.features([bad], {}, {})[0]))
        assert row["seeds"] + row["hidden"] > 0, bad
    assert plain[0][1] == 0 and plain[0][6] == 0


def test_awkward_input(spark, tmp_path):
    docs = stored(documents(spark), tmp_path)
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("y"))
    none, one = rows.filter("false"), rows.filter("doc_id = 7").withColumn("y", F.lit(1))
    for labelled in (none, one, rows):
        for fit, score in ((quality.fit, quality.quality), (toxicity.fit, toxicity.toxicity)):
            found = score(docs, fit(labelled)).collect()
            assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["lang"] in ("en", None) for r in found)
            assert score(empty(spark), fit(none)).count() == 0
