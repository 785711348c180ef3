"""Language identification by nearest centroid.

A text becomes an L2-normalised TF-IDF vector of hashed byte bigrams and trigrams of its
lower-cased letters. Each language has several centroids, found by spherical k-means over
its own texts; the nearest centroid by cosine names the language, and a text farther from
all centroids than a learnt distance is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, fold, schema_with, slices, squeezed, unsqueezed

DIMS = 1 << 12
#: About so many labelled rows fit the model at most, spread evenly over all languages; a language has one at least.
FIT_ROWS = 2_000
CENTROIDS = 3
UNKNOWN = "und"
#: ASCII bytes other than lower-case letters become spaces.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_HAS_LETTER = regex.compile(r"\p{L}").search


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of the whole text; None if it has no letter."""
    if not text or not _HAS_LETTER(text):
        return None
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    two = raw[:-1] << np.uint32(8) | raw[1:]
    three = two[:-1] << np.uint32(8) | raw[2:] | np.uint32(1 << 24)
    keys = np.concatenate([two, three]) * np.uint32(2654435761) >> np.uint32(20)
    return np.bincount(keys, minlength=DIMS)


def weigh(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.power(rows, 0.75, dtype=np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; begins with the vector nearest the mean, then the farthest from those chosen."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    c = x[chosen]
    for _ in range(rounds):
        mine = (x @ c.T).argmax(axis=1)
        c = np.stack([x[mine == j].mean(axis=0) if (mine == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def fit(rows: np.ndarray, langs: list[str]) -> dict:
    """A model from count vectors and their languages; without any, every text is unknown."""
    names = sorted(set(langs))
    if not names:
        return {"names": [], "owner": [], "centroids": np.zeros((0, DIMS), np.float32), "idf": np.ones(DIMS, np.float32), "least": 0.0}
    idf = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1).astype(np.float32)
    x, of = weigh(rows, idf), np.array([names.index(g) for g in langs])
    found = [centroids(x[of == j], CENTROIDS) for j in range(len(names))]
    owner = np.concatenate([[j] * len(c) for j, c in enumerate(found)])
    likeness = (x @ np.concatenate(found).T).max(axis=1)
    return {"names": names, "owner": owner, "centroids": np.concatenate(found), "idf": idf, "least": 0.5 * float(np.quantile(likeness, 0.001))}


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """A model from docs (doc_id, text, lang) already held to the training rows; rows without language, text or letter are left out.

    Every language among them is learnt. Rows are drawn by a hash of id and text, and rows that repeat both count once, so the
    sample that is gathered has about fit_rows rows at any size of docs. Without usable rows every text is unknown.
    """
    usable = docs.where("lang is not null and text is not null")
    sizes = usable.groupBy("lang").count().orderBy("lang").collect()  # a row for each language
    if not sizes:
        return fit(np.zeros((0, DIMS)), [])
    each = fit_rows // len(sizes) or 1
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], float(min(1.0, max(0.9 * each, 4) / r["count"])))])
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 40)) < share[F.col("lang")] * float(1 << 40)
    chosen = usable.where(drawn).select("doc_id", "lang", "text").distinct()

    def per_partition():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [None if (c := counts(x)) is None else squeezed(c) for x in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "lang", "counts"])

        return step

    kept: dict[str, list] = {}
    for r in arrow_rows(chosen, schema_with(chosen.select("doc_id", "lang"), "counts binary"), per_partition).where("counts is not null").collect():
        kept.setdefault(r["lang"], []).append((r["doc_id"] if r["doc_id"] is not None else -1, bytes(r["counts"])))
    rows = [(g, c) for g in sorted(kept) for _, c in sorted(kept[g])[:each]]
    return fit(np.stack([unsqueezed(c) for _, c in rows]) if rows else np.zeros((0, DIMS)), [g for g, _ in rows])


def identify(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (cosine with the nearest centroid, 0 to 1) and rejected, from the whole text alone.

    lang_pred is `und` for null texts and those without a letter (score 0, rejected); the nearest centroid names it
    otherwise, also where its distance rejects it. Among equally near ones the first language by name wins. Clashing
    columns are replaced. Texts of any length are taken whole; rows that repeat are judged each, alike; an empty table gives an empty one.
    """
    kept = df.drop("lang_pred", "score", "rejected")
    at, shared = kept.columns.index(text), df.sparkSession.sparkContext.broadcast(model)

    def per_partition():
        m = shared.value
        c = np.ascontiguousarray(m["centroids"].T)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores, rejected = [], [], []
            for part in slices(batch, 256):
                rows = [counts(x) for x in part.column(at).to_pylist()]
                if c.shape[1] and any(r is not None for r in rows):
                    likeness = weigh(np.stack([np.zeros(DIMS) if r is None else r for r in rows]), m["idf"]) @ c
                    best, value = likeness.argmax(axis=1), np.clip(likeness.max(axis=1), 0, 1)
                for k, r in enumerate(rows):
                    known = r is not None and c.shape[1] > 0
                    names.append(m["names"][m["owner"][best[k]]] if known else UNKNOWN)
                    scores.append(float(value[k]) if known else 0.0)
                    rejected.append(not known or scores[-1] < m["least"])
            more = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

        return step

    return arrow_rows(kept, schema_with(kept, "lang_pred string", "score double", "rejected boolean"), per_partition)


FOLDS, HELD_OUT = 5, 0


def trained(docs: DataFrame) -> dict:
    return train(docs.select("doc_id", "text", "lang").where(fold("doc_id", FOLDS) != HELD_OUT))


def op6_language_id(spark, sf_dir):
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    from .common import read

    docs = read(spark, sf_dir, "documents")
    return identify(docs.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text"), trained(docs)).drop("text")
