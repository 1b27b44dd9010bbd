"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a document: densities and counts of lexicon words, their nearness to words of the second person, rates of capitals, punctuation and obfuscation. The lexicon has fixed seeds and the words and word beginnings that the labels single out: by standing in toxic texts at all, or by standing in them densely (in languages whose clean texts hold them now and then). Labelled rows are split by a hash of their id: from one half terms are learned, on the other half trees are grown and, from predictions across folds, calibrated. The labelled rows used are bounded (max_rows); everything is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import held, map_texts, stored
from folioscope.llm.tokens import TokenTable

#: Common English insults; any other term comes from the labels.
SEEDS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown clowns fool imbecile ugly hate hateful shut disgrace vile filth filthy creep jerk lunatic".split())
SECOND_PERSON = frozenset("you your yours yourself u ur you're youre du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
_LEET = str.maketrans("013457@$!|", "oieastasil")
_REPEAT = re.compile(r"(.)\1{2,}")
PREFIXES = (4, 5, 6)
ROOT = 3
NEAR = 5
WIDTH = 14
#: A term is dense in a text that has it so often at least, and once in so many words.
DENSE_TIMES, DENSE_WORDS = 2, 100


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings with a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def dense_terms(text: str | None) -> list[str]:
    """The terms that are dense in a text, ascending."""
    words = Counter("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    counts: Counter[str] = Counter()
    for word, n in words.items():
        for term in terms_of(word):
            counts[term] += n
    least = max(DENSE_TIMES, sum(words.values()) / DENSE_WORDS)
    return sorted(t for t, n in counts.items() if n >= least)


def token_features(token: str, lexicon: dict[str, float], dense: dict[str, float], roots: frozenset[str]) -> tuple[float, ...]:
    """Of a whitespace token: seed, learned weight, learned, seed after undoing an obfuscation, second person, all capitals, capitals, letters, exclamation marks, question marks, other signs, digits or signs between letters, letter repeated thrice, densely learned weight. roots: the first letters of both lexicons' terms."""
    letters = len(token)
    if plain := token.isalpha():
        bare = core = token.lower()
    else:
        bare = token.strip(".,;:!?\"'()[]{}<>*_-").lower()
        core = bare if bare.isalpha() else "".join(filter(str.isalpha, bare))
        letters = sum(map(str.isalpha, token))
    if plain and core == token and core[:ROOT] not in roots and not _REPEAT.search(core):  # as most words are
        return (0.0, 0.0, 0.0, 0.0, float(core in SECOND_PERSON), 0.0, 0.0, float(letters), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    upper = 0 if token.islower() else 1 if token.istitle() else sum(map(str.isupper, token))
    get = lexicon.get
    terms = terms_of(core) if core[:ROOT] in roots else ()
    weight, often = max((get(t, 0.0) for t in terms), default=0.0), max((dense.get(t, 0.0) for t in terms), default=0.0)
    seed = core in SEEDS and bare is core
    stretched = float(_REPEAT.search(bare) is not None)
    hidden = not seed and (bare is not core or stretched) and bool(core) and (core in SEEDS or _REPEAT.sub(r"\1", "".join(filter(str.isalpha, bare.translate(_LEET)))) in SEEDS)
    if plain:
        return (float(seed), weight, float(weight > 0), float(hidden), float(bare in SECOND_PERSON), float(letters > 1 and upper == letters), float(upper), float(letters), 0.0, 0.0, 0.0, 0.0, stretched, often)
    exclaimed, asked = token.count("!"), token.count("?")
    signs = len(token) - sum(map(str.isalnum, token)) - exclaimed - asked
    mixed = len(bare) > 2 and bare is not core and bare[0].isalpha() and not bare.replace("'", "").replace("-", "").isalpha()
    return (float(seed), weight, float(weight > 0), float(hidden), float(bare in SECOND_PERSON), float(letters > 1 and upper == letters), float(upper), float(letters), float(exclaimed), float(asked), float(signs), float(mixed), stretched, often)


FEATURES = ("seed rate", "seeds", "learned rate", "learned", "strongest", "hidden rate", "hidden", "second rate", "near", "near rate", "shouted rate", "capitals", "exclamations", "questions", "signs", "mixed rate", "repeats", "length", "dense rate", "dense", "densest")


def features(texts: list[str | None], lexicon: dict[str, float], dense: dict[str, float]) -> np.ndarray:
    """A row of FEATURES for each whole text; null and empty texts have zeros."""
    table = _table(tuple(sorted(lexicon.items())), tuple(sorted(dense.items())))
    out = np.zeros((len(texts), len(FEATURES)))
    for r, text in enumerate(texts):
        tokens = (text or "").split()
        if not tokens:
            continue
        numbers, rows = table(tokens)
        own = rows[numbers]
        s = own.sum(axis=0, dtype=np.float64)
        n, letters, chars = len(tokens), max(s[7], 1.0), max(len(text), 1)
        bad = np.nonzero((own[:, 0] > 0) | (own[:, 2] > 0) | (own[:, 3] > 0))[0]
        near = 0
        if len(bad) and s[4]:
            second = np.nonzero(own[:, 4] > 0)[0]
            at = np.searchsorted(second, bad)
            near = int((np.minimum(np.abs(bad - second[np.maximum(at - 1, 0)]), np.abs(second[np.minimum(at, len(second) - 1)] - bad)) <= NEAR).sum())
        out[r] = (s[0] / n, np.log1p(s[0]), s[1] / n, np.log1p(s[2]), own[:, 1].max(), s[3] / n, np.log1p(s[3]), s[4] / n, np.log1p(near), near / n, s[5] / n, s[6] / letters, s[8] / chars, s[9] / chars, s[10] / chars, s[11] / n, s[12] / n, np.log1p(n), s[13] / n, np.log1p(s[13]), own[:, 13].max())
    return out


def _table(lexicon: tuple, dense: tuple) -> TokenTable:
    words, often = dict(lexicon), dict(dense)
    roots = frozenset(t[:ROOT].rstrip("*") for t in (*words, *often, *SEEDS))
    return held("toxicity", (lexicon, dense), lambda: TokenTable(lambda token: token_features(token, words, often, roots), WIDTH))


@dataclass
class Trees:
    """Boosted trees with a logistic loss; splits are chosen on quantile bins."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    leaf: float = 1.0
    least: int = 3
    base: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        if not len(y) or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        # a feature that is zero but for a few rows has no other quantile: its non-zero values get bins of their own
        cuts = [np.unique(np.concatenate([c, np.quantile(v[v != 0], [0.0, 0.25, 0.5, 0.75]) - 1e-9 if (v != 0).any() else []])) for c, v in zip(cuts, x.T)]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            node = np.zeros(len(y), dtype=np.int64)
            for k in range(size):
                rows = np.nonzero(node == k)[0]
                if not len(rows):
                    continue
                g, h = grad[rows].sum(), hess[rows].sum()
                value[k] = g / (h + self.leaf) * self.rate
                if k >= 2**self.depth - 1 or len(rows) < 2 * self.least:
                    continue
                best = (1e-6, -1, 0)
                for f, c in enumerate(cuts):
                    if len(c):
                        b, w = binned[rows, f], len(c) + 1
                        gs, hs, ns = (np.cumsum(np.bincount(b, weights=z, minlength=w))[:-1] for z in (grad[rows], hess[rows], np.ones(len(rows))))
                        gain = gs**2 / (hs + self.leaf) + (g - gs) ** 2 / (h - hs + self.leaf) - g**2 / (h + self.leaf)
                        gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (gain[i], f, i)
                if best[1] >= 0:
                    feature[k], cut[k] = best[1], cuts[best[1]][best[2]]
                    node[rows] = 2 * k + 1 + (x[rows, best[1]] > cut[k])
            score += value[node]
            self.trees.append((feature, cut, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        out = np.full(len(x), self.base)
        every = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (x[every, np.maximum(f, 0)] > cut[node]), node)
            out += value[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities): the monotonous fit by pooling adjacent violators, at the middle of each pool; a pool's share is drawn to the whole share by one row, so that it's never 0 or 1."""
    order = np.argsort(score, kind="stable")
    share = y.mean() if len(y) else 0.5
    pools: list[list[float]] = []  # sum of y, rows, lowest and highest score
    for s, v in zip(score[order].tolist(), y[order].tolist()):
        if pools and pools[-1][3] == s:
            pools[-1][0] += v
            pools[-1][1] += 1
        else:
            pools.append([v, 1, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            v2, n2, _, high = pools.pop()
            pools[-1][0] += v2
            pools[-1][1] += n2
            pools[-1][3] = high
    if not pools:
        return np.array([0.0]), np.array([share])
    return np.array([(p[2] + p[3]) / 2 for p in pools]), np.array([(p[0] + share) / (p[1] + 1) for p in pools])


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    dense: dict[str, float]
    trees: Trees
    at: np.ndarray
    probability: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        raw = self.trees.score(features(texts, self.lexicon, self.dense))
        return np.clip(np.interp(raw, self.at, np.maximum.accumulate(self.probability)), 0.0, 1.0)


def _telling(rows: DataFrame, terms: Column, most: int, least: int, floor: float) -> dict[str, float]:
    """Terms of an array that toxic rows hold far more often: the lower bound of their log odds, over floor; most of them at most."""
    pos, neg = (float(x or 0) for x in rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
    if not pos or not neg:
        return {}
    found = rows.select("y", F.explode(terms).alias("term")).filter("term is not null").groupBy("term").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).filter(F.col("p") >= least)
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1)) - 1.64 * F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    top = found.select("term", odds.alias("w")).filter(F.col("w") > floor).orderBy(F.desc("w"), "term").limit(most)  # the bound of the lexicon
    return {r["term"]: float(r["w"]) for r in top.collect()}


def learned_terms(rows: DataFrame, most: int = 2000, least: int = 6, floor: float = 1.5) -> dict[str, float]:
    """Words and word beginnings that more toxic rows hold. rows has text and y."""
    words = F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)"))
    terms = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, *[F.when(F.length(w) > n, F.concat(F.substring(w, 1, n), F.lit("*"))) for n in PREFIXES]))))
    return _telling(rows, terms, most, least, floor)


def learned_dense(rows: DataFrame, most: int = 500, least: int = 3, floor: float = 1.0) -> dict[str, float]:
    """Words and word beginnings that are dense in more toxic rows. rows has text and y."""
    make = lambda: lambda texts: [pa.array([dense_terms(t) for t in texts], pa.list_(pa.string()))]
    return _telling(map_texts(rows, [T.StructField("terms", T.ArrayType(T.StringType(), True))], make, keep=["y"]), F.col("terms"), most, least, floor)


def fit(labelled: DataFrame, max_rows: int = 12_000, folds: int = 3) -> ToxicityModel:
    """Fit on labelled (doc_id, text, y with 0 or 1), of which the max_rows rows with the smallest hash of doc_id are used. Without rows of both labels the score is the labels' share (or 0.5)."""
    rows = labelled.filter("y is not null").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("y").cast("double").alias("y"))
    total = rows.select("doc_id").count()
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("rows")), F.lit(1_000_000))
    # a bounded number of rows, which the steps below read again and again
    used = stored(rows.filter(part < F.lit(int(min(1.0, max_rows / max(total, 1)) * 1_000_000))), "sample")
    half = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")), F.lit(2))
    lexicon, dense = learned_terms(used.filter(half == 0)), learned_dense(used.filter(half == 0))
    fields = [T.StructField("x", T.ArrayType(T.DoubleType(), True))]
    make = lambda: lambda texts: [pa.array(list(features(texts, lexicon, dense)), pa.list_(pa.float64()))]
    seen = sorted(map_texts(used.filter(half == 1), fields, make, keep=["doc_id", "y"]).collect(), key=lambda r: str(r["doc_id"]))
    x, y = np.array([r["x"] for r in seen]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in seen])
    fold = np.arange(len(y)) % folds
    held = np.zeros(len(y))
    for k in range(folds):
        held[fold == k] = Trees().fit(x[fold != k], y[fold != k]).score(x[fold == k])
    return ToxicityModel(lexicon, dense, Trees().fit(x, y), *isotonic(held, y))


def toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs's columns (or those in keep), score (0 to 1, higher: likelier toxic) and predicted (1 from the threshold on); input columns of these names give way.

    Scores depend on the whole text alone; null counts as empty and has a score like any text; repeated rows have equal scores; an empty table gives an empty table.
    """
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def make():
        def work(texts):
            score = model.score(texts)
            return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

        return work

    return map_texts(docs, fields, make, text_col, keep)
