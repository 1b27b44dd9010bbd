"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of sixty whitespace tokens; every passage of it is encoded. A gated attention, learned from the documents' labels alone, weighs the passages, and the weighted representation is scored. Training is full-batch gradient descent (Adam) in numpy on a bounded number of labelled rows; everything is scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import held, map_texts
from folioscope.llm.tokens import TokenTable

PASSAGE = 60
LEXICAL = 8
TOKEN_WIDTH = 9 + LEXICAL
#: Features of a passage: means over its tokens, then those of the whole passage.
WIDTH = TOKEN_WIDTH + 5


def token_features(token: str) -> tuple[float, ...]:
    """Length (to 20), shares of letters, capitals, digits and other signs, sentence end, all capitals, no letter, long; then a signed hash of the beginning in one of LEXICAL places."""
    n = len(token)
    lexical = _lexical(token[:3].lower())
    if token.isalpha():
        if token.islower():
            return (min(n, 20) / 10, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, float(n > 20), *lexical)
        letters, digits = n, 0
    else:
        letters, digits = sum(map(str.isalpha, token)), sum(map(str.isdigit, token))
    upper = 0 if token.islower() else 1 if token.istitle() else sum(map(str.isupper, token))
    return (min(n, 20) / 10, letters / n, upper / n, digits / n, (n - letters - digits) / n, float(token[-1] in ".!?"), float(letters > 1 and upper == letters), float(not letters), float(n > 20), *lexical)


@lru_cache(maxsize=50_000)
def _lexical(start: str) -> tuple[float, ...]:
    code = zlib.crc32(start.encode("utf-8", "surrogatepass"))
    return tuple((1.0 if code & 0x100 else -1.0) if i == code % LEXICAL else 0.0 for i in range(LEXICAL))


def _table() -> TokenTable:
    return held("quality", None, lambda: TokenTable(token_features, TOKEN_WIDTH))


def passages(text: str | None) -> np.ndarray:
    """A row of features for each passage of the whole text; one row of zeros for an empty or null text."""
    tokens = (text or "").split()
    if not tokens:
        return np.zeros((1, WIDTH), dtype=np.float32)
    numbers, table = _table()(tokens)
    n = len(tokens)
    starts = np.arange(0, n, PASSAGE)
    sizes = np.diff(np.append(starts, n)).astype(np.float32)
    out = np.zeros((len(starts), WIDTH), dtype=np.float32)
    out[:, :TOKEN_WIDTH] = np.add.reduceat(table[numbers], starts, axis=0) / sizes[:, None]
    place = np.arange(n) // PASSAGE
    kinds = np.unique(place * (int(numbers.max()) + 1) + numbers) // (int(numbers.max()) + 1)
    out[:, TOKEN_WIDTH] = np.bincount(kinds, minlength=len(starts)) / sizes
    same = np.append(False, numbers[1:] == numbers[:-1])
    out[:, TOKEN_WIDTH + 1] = np.add.reduceat(same.astype(np.float32), starts) / sizes
    out[:, TOKEN_WIDTH + 2] = sizes / PASSAGE
    out[:, TOKEN_WIDTH + 3] = np.log1p(len(starts)) / 5
    out[:, TOKEN_WIDTH + 4] = len(np.unique(numbers)) / n
    return out


@dataclass
class Attention:
    """h = tanh(E x + e); attention of a passage: w (tanh(V h) sigmoid(U h)), softmax in the bag; score: sigmoid(c z + b) of the weighted sum z."""

    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, x: np.ndarray, hidden: int, gate: int, share: float, seed: int = 7) -> Attention:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
        return cls(mean, spread, {"E": draw(WIDTH, hidden), "e": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden) * 0.1, "b": np.array(np.log(share / (1 - share)))})

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """starts: the first passage of each bag."""
        p = self.weights
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (v * u) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "bag": bag, "h": h, "v": v, "u": u, "a": a, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["b"])))}

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p, f = self.weights, self.forward(x, starts)
        d = (f["y"] - y) / len(y)
        dz = d[:, None] * p["c"]
        own = dz[f["bag"]]
        da = (own * f["h"]).sum(axis=1)
        ds = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["bag"]])
        dv, du = ds[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2), ds[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
        dh = f["a"][:, None] * own + dv @ p["V"].T + du @ p["U"].T
        dx = dh * (1 - f["h"] ** 2)
        out = {"E": f["x"].T @ dx, "e": dx.sum(axis=0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": ((f["v"] * f["u"]) * ds[:, None]).sum(axis=0), "c": f["z"].T @ d, "b": d.sum()}
        return {k: g + (decay * p[k] if k in "EVUc" else 0) for k, g in out.items()}

    def train(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.02, decay: float = 1e-4) -> Attention:
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for t in range(1, steps + 1):
            for k, g in self.gradient(x, starts, y, decay).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                self.weights[k] = self.weights[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        bags = [passages(t) for t in texts]
        starts = np.cumsum([0, *(len(b) for b in bags)])[:-1]
        return self.forward(np.concatenate(bags), starts)["y"]


def fit(labelled: DataFrame, max_rows: int = 4_000, hidden: int = 16, gate: int = 8, max_chars: int = 200_000) -> Attention:
    """Fit on labelled (doc_id, text, y with 0 or 1), of which about max_rows rows, those with the smallest hash of doc_id among texts of up to max_chars characters, are used; so what the driver collects is bounded. Without rows of both labels the score is the labels' share (or 0.5)."""
    rows = labelled.filter("y is not null").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("y").cast("double").alias("y")).filter(F.length("text") <= max_chars)
    total = rows.select("doc_id").count()
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("rows")), F.lit(1_000_000))
    used = rows.filter(part < F.lit(int(min(1.0, max_rows / max(total, 1)) * 1_000_000)))
    make = lambda: lambda texts: [pa.array([passages(t).tobytes() for t in texts], pa.binary())]
    seen = sorted(map_texts(used, [T.StructField("x", T.BinaryType())], make, keep=["doc_id", "y"]).collect(), key=lambda r: str(r["doc_id"]))
    bags = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, WIDTH) for r in seen]
    y = np.array([r["y"] for r in seen])
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, WIDTH))
    model = Attention.new(x, hidden, gate, share)
    if not len(y) or y.min() == y.max():
        model.weights["c"] *= 0
        return model
    return model.train(x, np.cumsum([0, *(len(b) for b in bags)])[:-1], y)


def quality(docs: DataFrame, model: Attention, threshold: float = 0.3, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs's columns (or those in keep), score (0 to 1, higher: likelier good) and predicted (1 from the threshold on); input columns of these names give way.

    Scores depend on the whole text alone; null and empty texts are a bag of one passage of zeros; repeated rows have equal scores; an empty table gives an empty table.
    """
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def make():
        def work(texts):
            score = np.concatenate([model.score(texts[i : i + 256]) for i in range(0, len(texts), 256)])
            return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

        return work

    return map_texts(docs, fields, make, text_col, keep)
