"""Quality classifier: Bradley-Terry scores from preference pairs, by logistic loss on feature differences."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACE_BYTES, blocks_of, column, unwrap, wrap

#: At most so many labelled rows are fitted on (those with the smallest seeded hashes).
SAMPLE_ROWS = 6000
HASHED = 2048
FEATURES = HASHED + 8
STEPS, PAIRS, RATE, DECAY = 2500, 256, 0.03, 1e-4
#: A score at or above this predicts label 1.
CUT = 0.3
SEED = 53


def features(text: bytes) -> np.ndarray:
    """Of the whole text: roots of hashed byte pair shares, and shares of word and line repetition and length.

    Shares are shrunk for short texts (a text without words is all zeros but for its length).
    """
    out = np.zeros(FEATURES, np.float32)
    a = np.frombuffer(text, np.uint8).astype(np.int64)
    if len(a) > 1:
        pairs = np.bincount((((a[:-1] * 257 + a[1:]) * 2654435761) >> 8) & (HASHED - 1), minlength=HASHED)
        out[:HASHED] = np.sqrt(pairs / (len(a) + 100.0))
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.translate(None, SPACE_BYTES)]
    shrink = n / (n + 20.0)
    out[HASHED:] = (
        1.0 / (1.0 + n / 10.0),
        shrink * (len(set(words)) / n if n else 0.0),
        shrink * (sum(map(bytes.__eq__, words, words[1:])) / n if n else 0.0),
        shrink * (1 - len(set(lines)) / len(lines) if lines else 0.0),
        shrink * (1 - len(set(zip(words, words[1:]))) / max(n - 1, 1) if n > 1 else 0.0),
        shrink * sum(map(bytes.isupper, words)) / max(n, 1),
        shrink * len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz" + SPACE_BYTES)) / max(len(text), 1),
        shrink * len(lines) / max(n, 1),
    )
    return out


def fit_bradley_terry(x: np.ndarray, y: np.ndarray, seed: int = SEED, steps: int = STEPS) -> np.ndarray:
    """Weights w for which P(a preferred to b) = sigmoid(w (x_a - x_b)), over random pairs of a label 1 and a label 0 row.

    Without rows of either label there is nothing to prefer: zeros.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1], np.float64)
    if not len(good) or not len(bad):
        return w
    rng, m, v = np.random.default_rng(seed), np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        gap = (x[rng.choice(good, PAIRS)] - x[rng.choice(bad, PAIRS)]).astype(np.float64)
        grad = -(gap / (1 + np.exp(np.clip(gap @ w, -50, 50)))[:, None]).mean(0) + DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def quantile_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The score quantile that parts the labels with the fewest errors (of equally good ones, their middle)."""
    if not len(scores) or y.min() == y.max():
        return 0.0
    levels = np.linspace(0, 1, 401)
    at = np.quantile(scores, levels)
    errors = np.array([((scores >= t) != (y == 1)).sum() for t in at])
    best = at[errors == errors.min()]
    below, above = scores[scores < best[0]], scores[scores >= best[-1]]
    return float((best[0] + best[-1]) / 2 if len(best) > 1 else (max(below.max(), best[0] - 0.5) + best[0]) / 2 if len(below) else best[0])


class Model:
    """Weights and cut; ``score`` maps the cut to CUT and grows with the Bradley-Terry score, between 0 and 1."""

    def __init__(self, w: np.ndarray, cut: float):
        self.w, self.cut = w, cut

    def score(self, text: bytes | None) -> float:
        z = float(features(text or b"") @ self.w) - self.cut + np.log(CUT / (1 - CUT))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(key: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the key's text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _feature_rows(batches):
    for batch in (part for whole in batches for part in blocks_of(whole, 0, rows=256)):
        texts = batch.column(0).cast(pa.large_binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([features(t or b"").tobytes() for t in texts], pa.binary()), batch.column(1)], names=["x", "y"]
        )


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, label_key: str | None = None) -> Model:
    """Fit on at most ``sample_rows`` labelled rows that are not held out; those rows alone come to the driver.

    ``label_key``: the key's name in ``labels``, where it is another one. Labels other
    than 0 and 1, null keys and labels without a document are ignored; a document with
    both labels counts as both. Ties in the hash that picks rows go by key and label.
    """
    known = labels.select(column(labels, label_key or key).alias("_k"), column(labels, label).cast("int").alias("y")).where("y in (0, 1) and _k is not null")
    known = known.where(~held_out(F.col("_k"))).distinct()
    # sample_rows bounds what is broadcast.
    picked = known.orderBy(F.xxhash64(F.lit(SEED), "_k", "y"), "_k", "y").limit(sample_rows)
    rows = docs.select(column(docs, key).alias("_k"), column(docs, text).alias("t")).join(F.broadcast(picked), "_k").select("t", "y")
    # Repeated rows of a document could exceed the bound: the limit holds for rows too.
    got = rows.mapInArrow(_feature_rows, "x binary, y int").orderBy(F.xxhash64("x", "y")).limit(sample_rows).toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)
    y = got.column("y").to_numpy()
    w = fit_bradley_terry(x, y)
    return Model(w, quantile_cut(x @ w, y))


def _scorer(model: Model):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts.cast(pa.large_binary())], pa.float64())

    return score


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (double, 0 to 1) and predicted (int, 1 from CUT upward); only the text is looked at.

    Null text scores as the empty one; very long texts are read whole. Repeated rows
    (ties) score alike, an empty table stays empty, columns named like the results are
    replaced, all others pass through, whatever their names.
    """
    out = wrap(docs).withColumn("_score", _scorer(model)(F.col("_doc")[text]))
    return unwrap(out, docs.columns, {"score": F.col("_score"), "predicted": (F.col("_score") >= CUT).cast("int")})


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
