"""A selector of tokens: a linear-chain model trained over all partitions, and its inference.

Tokens are scored by hashed features, neighbouring tags by transitions. In each round every task works out the loss and gradient
of its own sequences by forward and backward sums; Spark adds them up, and the driver, which holds the weights (their number is
fixed, whatever the input), takes a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import table
from .spans import viterbi

TAGS = 3
#: Hashed features, and those that a token has.
BUCKETS = 1 << 12


def token_features(words: Column, buckets: int = BUCKETS) -> Column:
    """For each word of a list its features: itself, its neighbours, its ending, length, case and place, as hashes below `buckets`."""
    said = lambda i: F.coalesce(F.lower(F.get(words, i)), F.lit(""))

    def of(word: Column, i: Column) -> Column:
        kinds = {
            "w": F.lower(word), "p": said(i - 1), "n": said(i + 1), "e": F.lower(F.right(word, F.lit(3))), "l": F.least(F.length(word), F.lit(12)).cast("string"),
            "c": F.concat((word == F.lower(word)).cast("string"), F.regexp_extract(word, r"\W$", 0)), "i": F.least(i, F.lit(3)).cast("string"), "b": F.lit(""),
        }
        return F.array(*[F.pmod(F.xxhash64(F.lit(k), v), F.lit(buckets)).cast("int") for k, v in kinds.items()])

    return F.transform(words, of)


@dataclass
class Selector:
    """weights: a row for each feature, a column for each tag; moves: scores of a tag (row) before another; start: of first tags; losses: the mean
    loss a sequence before each round."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, TAGS)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((TAGS, TAGS)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(TAGS))
    losses: list[float] = field(default_factory=list)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.moves.ravel(), self.start])

    @staticmethod
    def of(flat: np.ndarray, losses: list[float] = ()) -> Selector:
        cut = len(flat) - TAGS * TAGS - TAGS
        return Selector(flat[:cut].reshape(-1, TAGS), flat[cut:-TAGS].reshape(TAGS, TAGS), flat[-TAGS:], list(losses))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_gradient(model: Selector, features: list[np.ndarray], tags: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """Negative log likelihood of sequences, none empty, and its gradient by all weights. features: a row of hashes for each token."""
    order = sorted(range(len(features)), key=lambda k: -len(features[k]))
    sizes = np.array([len(features[k]) for k in order])
    n, most = len(order), int(sizes[0])
    scores, gold = np.zeros((n, most, TAGS)), np.zeros((n, most), int)
    for row, k in enumerate(order):
        scores[row, : sizes[row]] = model.weights[features[k]].sum(axis=1)
        gold[row, : sizes[row]] = tags[k]
    live = [int(np.searchsorted(-sizes, -t, "left")) for t in range(most + 1)]  # sequences of more than t tokens
    ahead = np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0] + model.start
    for t in range(1, most):
        m = live[t]
        ahead[:m, t] = _log_sum(ahead[:m, t - 1, :, None] + model.moves, 1) + scores[:m, t]
    back = np.zeros_like(scores)
    for t in range(most - 2, -1, -1):
        m = live[t + 1]
        back[:m, t] = _log_sum(model.moves + (scores[:m, t + 1] + back[:m, t + 1])[:, None, :], 2)
    rows = np.arange(n)
    whole = _log_sum(ahead[rows, sizes - 1], 1)
    share = np.exp(ahead + back - whole[:, None, None])
    loss, off = float(whole.sum()), share
    moves, start = np.zeros((TAGS, TAGS)), share[:, 0].sum(axis=0)
    for t in range(most):
        m = live[t]
        off[rows[:m], t, gold[:m, t]] -= 1
        loss -= float(scores[rows[:m], t, gold[:m, t]].sum())
        if t == 0:
            loss -= float(model.start[gold[:m, 0]].sum())
            np.subtract.at(start, gold[:m, 0], 1)
        else:
            both = ahead[:m, t - 1, :, None] + model.moves + (scores[:m, t] + back[:m, t])[:, None, :] - whole[:m, None, None]
            moves += np.exp(both).sum(axis=0)
            np.subtract.at(moves, (gold[:m, t - 1], gold[:m, t]), 1)
            loss -= float(model.moves[gold[:m, t - 1], gold[:m, t]].sum())
    weights = np.zeros_like(model.weights)
    for row, k in enumerate(order):
        for column in range(features[k].shape[1]):
            np.add.at(weights, features[k][:, column], off[row, : sizes[row]])
    return loss, np.concatenate([weights.ravel(), moves.ravel(), start])


def _arrays(rows: pd.Series) -> list[np.ndarray]:
    return [np.array([list(f) for f in r], int) for r in rows]


def train(sequences: DataFrame, rounds: int = 25, rate: float = 0.3, decay: float = 1e-4) -> Selector:
    """A selector of sequences (features, as token_features gives them, and tags, 0 to 2). Every round goes over all of them; Adam's steps on the
    mean loss with a weight decay. Empty sequences tell nothing; without any other the weights stay 0."""
    rows = table(sequences.where(F.size("features") > 0).select("features", "tags"), "selector-rows")
    total = rows.count()
    model = Selector()
    flat, first, second = model.flat(), np.zeros(model.flat().size), np.zeros(model.flat().size)
    losses: list[float] = []
    for step in range(1, rounds + 1 if total else 1):
        held = Selector.of(flat)

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            loss, gradient = 0.0, None
            for batch in batches:
                if len(batch):
                    more, g = loss_and_gradient(held, _arrays(batch["features"]), [np.asarray(t, int) for t in batch["tags"]])
                    loss, gradient = loss + more, g if gradient is None else gradient + g
            if gradient is not None:
                used = np.flatnonzero(gradient)
                yield pd.DataFrame({"place": np.append(used, -1), "value": np.append(gradient[used], loss)})

        sums = rows.mapInPandas(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()  # a row a weight at most
        gradient = np.zeros(flat.size)
        inside = sums["place"].to_numpy() >= 0
        gradient[sums["place"].to_numpy()[inside]] = sums["value"].to_numpy()[inside] / total
        losses.append(float(sums["value"].to_numpy()[~inside].sum()) / total)
        gradient += decay * flat
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        flat = flat - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Selector.of(flat, losses)


def selected(sequences: DataFrame, model: Selector) -> DataFrame:
    """sequences with best, the likeliest tags of their features; none for empty ones."""
    columns = [c for c in sequences.columns if c != "best"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for features in _arrays(batch["features"]):
                if not len(features):
                    found.append([])
                    continue
                scores = model.weights[features].sum(axis=1)
                scores[0] += model.start
                found.append(viterbi(scores, model.moves))
            yield batch.assign(best=found)

    kept = sequences.select(*columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInPandas(run, f"{kinds}, best array<int>")
