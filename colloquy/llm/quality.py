"""Quality classification by positive-unlabelled learning.

Trusted positives are rows labelled 1; unlabelled text is any text of the training rows,
whatever its label. A linear scorer over bounded features of the whole text minimises the
non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the sigmoid loss. The class prior is estimated as the least ratio of unlabelled to
positive mass over the upper level sets of a first positive-against-unlabelled scorer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, fold, schema_with

#: At most so many rows of each kind (trusted positives, unlabelled) fit the model, chosen by a hash of their ids.
FIT_ROWS = 4_000

#: Byte classes whose neighbouring pairs are counted.
_KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!?", "|", "*#$%&@^~", "()[]{}<>", "-_'\"`", ":;/\\=+"]
CLASSES = np.full(256, len(_KINDS), np.int64)  # further control bytes
for _k, _kind in enumerate(_KINDS):
    CLASSES[np.frombuffer(_kind.encode(), np.uint8)] = _k
CLASSES[128:] = len(_KINDS) + 1
N_CLASSES = len(_KINDS) + 2
N_FEATURES = N_CLASSES * N_CLASSES + N_CLASSES + 8


def features(text: str | None) -> np.ndarray:
    """Bounded features of a whole text; zeros for null and empty ones but for the last, which marks them."""
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        out[-1] = 1
        return out
    raw = text.encode()
    kinds = CLASSES[np.frombuffer(raw, np.uint8)]
    pairs = np.bincount(kinds[:-1] * N_CLASSES + kinds[1:], minlength=N_CLASSES * N_CLASSES)
    single = np.bincount(kinds, minlength=N_CLASSES)
    out[: N_CLASSES * N_CLASSES] = np.sqrt(pairs / len(raw))
    out[N_CLASSES * N_CLASSES : N_CLASSES * (N_CLASSES + 1)] = np.sqrt(single / len(raw))
    words = raw.split()
    n, distinct = len(words), len(set(words))
    lines = raw.split(b"\n")
    again = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    out[N_CLASSES * (N_CLASSES + 1) :] = [np.log1p(len(raw)) / 10, np.log1p(n) / 10, np.log1p(distinct) / 10, distinct / max(n, 1), again / max(n, 1), len(set(lines)) / len(lines), min(len(raw) / max(n, 1), 50) / 10, 0]
    return out


def _descend(x: np.ndarray, gradient, steps: int, rate: float = 0.03) -> np.ndarray:
    """Adam from zero weights; gradient(x @ w) gives the risk's derivative by the scores. Few rows are held to small weights."""
    decay = max(1e-4, 0.5 / len(x))
    w = np.zeros(x.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x.T @ gradient(x @ w) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio of unlabelled to positive mass above a threshold of a first scorer's output, over thresholds that keep
    at least 2/5 of the positives."""
    cuts = np.quantile(positive, np.linspace(0.0, 0.6, 61))
    return float(np.clip(min(np.mean(unlabelled >= c) / max(np.mean(positive >= c), 1e-9) for c in cuts), 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400) -> dict:
    """Weights, bias, and scales of a scorer; without positives or unlabelled rows every score is the prior's guess of 1/2."""
    if not len(positive) or not len(unlabelled):
        return {"w": np.zeros(N_FEATURES), "b": 0.0, "prior": 0.5}
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    x = np.concatenate([positive, unlabelled]).astype(np.float64)
    x = np.clip((x - mean) / scale, -8, 8)
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    n, u = len(positive), len(unlabelled)

    # each half's rows are scored by the first scorer of the other half, so that the prior isn't read off rows it has learnt
    first, half = np.zeros(len(x)), np.arange(len(x)) % 2
    for part in (0, 1):
        rows, others = np.flatnonzero(half == part), np.flatnonzero(half != part)
        is_positive = rows < n
        share = np.where(is_positive, 1 / max(is_positive.sum(), 1), 1 / max((~is_positive).sum(), 1))
        first[others] = x[others] @ _descend(x[rows], lambda z, p=is_positive, s=share: (_sigmoid(z) - p) * s, steps // 2)
    prior = class_prior(first[:n], first[n:])

    def non_negative(z):
        s = _sigmoid(z)
        slope = s * (1 - s)  # loss of calling it positive: 1 - s; negative: s
        if s[n:].mean() - prior * s[:n].mean() >= 0:
            return np.concatenate([-2 * prior * slope[:n] / n, slope[n:] / u])
        return np.concatenate([prior * slope[:n] / n, -slope[n:] / u])  # the negative part rises until it is no longer below zero

    w = _descend(x, non_negative, steps)
    return {"w": w[:-1] / scale, "b": float(w[-1] - (w[:-1] * mean / scale).sum()), "mean": mean, "scale": scale, "prior": prior}


def score_features(x: np.ndarray, model: dict) -> np.ndarray:
    if "mean" not in model:
        return np.full(len(x), 0.5)
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ (model["w"] * model["scale"]) + model["b"] + (model["w"] * model["mean"]).sum()
    return _sigmoid(z)


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds column features (binary, float32)."""
    kept = df.drop("features")
    at = kept.columns.index(text)

    def per_partition():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features(x).tobytes() for x in batch.column(at).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "features"])

        return step

    return arrow_rows(kept, schema_with(kept, "features binary"), per_partition)


def _sampled(df: DataFrame, doc_id: str, most: int) -> DataFrame:
    """About 9/10 of `most` rows, by a hash of the id; all rows where there are fewer."""
    n = df.count()
    return df if n <= 0.9 * most else df.where(F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(1_000_003)) < int(1_000_003 * 0.9 * most / n))


def _matrix(df: DataFrame, doc_id: str, most: int) -> np.ndarray:
    """Fixed-size features of at most `most` rows, the same in each run."""
    rows = sorted((r[0], bytes(r[1])) for r in with_features(df.distinct()).select(doc_id, "features").collect())[:most]
    return np.stack([np.frombuffer(f, np.float32) for _, f in rows]) if rows else np.zeros((0, N_FEATURES), np.float32)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """A model from docs (doc_id, text) and labels (doc_id, quality), both already held to the training rows.

    Repeated label rows count once, as do rows that repeat id and text; labels of other values than 1 are not used, nor are rows of
    null ids. About fit_rows rows of each kind are gathered at any size of docs. Without any, every score is 1/2.
    """
    trusted = labels.where(F.col("quality") == 1).select("doc_id").where("doc_id is not null").distinct()
    positive = _matrix(docs.select("doc_id", "text").join(_sampled(trusted, "doc_id", fit_rows), "doc_id", "left_semi"), "doc_id", fit_rows)
    chosen = _sampled(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", fit_rows)
    unlabelled = _matrix(docs.select("doc_id", "text").join(chosen, "doc_id", "left_semi"), "doc_id", fit_rows)
    return fit(positive, unlabelled)


def score(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5 on) from the whole text alone, however long; null and empty texts get a score too.
    Clashing columns are replaced; equal texts and repeated rows get equal scores; an empty table gives an empty one."""
    kept = df.drop("score", "predicted")
    at, shared = kept.columns.index(text), df.sparkSession.sparkContext.broadcast(model)

    def per_partition():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = score_features(np.stack([features(x) for x in batch.column(at).to_pylist()]), shared.value).tolist()
            more = [pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "score", "predicted"])

        return step

    return arrow_rows(kept, schema_with(kept, "score double", "predicted int"), per_partition)


FOLDS, HELD_OUT = 3, 1


def trained(spark, sf_dir) -> dict:
    from .common import read

    learn = fold("doc_id", FOLDS) != HELD_OUT
    return train(read(spark, sf_dir, "documents").select("doc_id", "text").where(learn), read(spark, sf_dir, "labels").where(learn))


def op7_quality(spark, sf_dir):
    """doc_id, held_out, score and predicted of every document."""
    from .common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    return score(docs, trained(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")
