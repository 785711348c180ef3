"""Places for models: each is a function over a batch of rows, given by the caller; defaults are deterministic stand-ins.

A model's `load` runs once in each Python worker's task and returns the function of a batch, so that weights load there and
not on the driver. Batches arrive as Arrow record batches turned into pandas.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def applied(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], dict]], added: dict[str, str]) -> DataFrame:
    """df with columns worked out by a model: load() gives a function from a batch to {column: values}; added names their types."""
    schema = StructType([StructField(f.name, f.dataType) for f in df.schema.fields])
    for name, kind in added.items():
        schema = schema.add(name, StructType.fromDDL(f"x {kind}").fields[0].dataType)

    def run(batches):
        model = load()
        for rows in batches:
            yield rows.assign(**model(rows))

    return df.mapInPandas(run, schema)


def rewritten(df: DataFrame, load: Callable | None = None, text: str = "input", most: int = 32) -> DataFrame:
    """Adds rewrite: by default the input's first `most` distinct words."""

    def default():
        return lambda rows: {"rewrite": [" ".join(list(dict.fromkeys((t or "").split()))[:most]) for t in rows[text]]}

    return applied(df, load or default, {"rewrite": "string"})


def sampled_rewrites(df: DataFrame, load: Callable | None = None, samples: int = 2, seed: int = 0, key: str = "sample_id", text: str = "input", most: int = 32) -> DataFrame:
    """Adds greedy (one rewrite) and samples (a list of so many), each sampled with a generator seeded by sample and number, so that
    batches and tasks don't change them. load: gives a function of (texts, generators for each text), to {greedy, samples}."""

    def default():
        def rewrites(texts, generators):
            words = [list(dict.fromkeys((t or "").split())) for t in texts]
            drawn = [[" ".join(w for w in ws if g.random() < 0.5)[:10_000] for g in gs] for ws, gs in zip(words, generators, strict=True)]
            return {"greedy": [" ".join(ws[:most]) for ws in words], "samples": drawn}

        return rewrites

    def seeded():
        rewrites = (load or default)()

        def run(rows):
            ids = [[int(hashlib.sha256(f"{seed}\0{k}\0{n}".encode()).hexdigest()[:16], 16) for n in range(samples)] for k in rows[key]]
            return rewrites(rows[text], [[np.random.default_rng(i) for i in own] for own in ids])

        return run

    return applied(df, seeded, {"greedy": "string", "samples": "array<string>"})


def encoded(df: DataFrame, load: Callable | None = None, text: str = "text", size: int = 64) -> DataFrame:
    """Adds vector (unit length): by default words hashed into `size` places."""

    def default():
        def vectors(rows):
            out = []
            for t in rows[text]:
                v = np.zeros(size)
                for w in (t or "").lower().split():
                    h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                    v[int.from_bytes(h[:4], "little") % size] += 1 if h[4] & 1 else -1
                out.append((v / max(np.linalg.norm(v), 1e-9)).astype(np.float32).tolist())
            return {"vector": out}

        return vectors

    return applied(df, load or default, {"vector": "array<float>"})


def selected(df: DataFrame, load: Callable | None = None, tokens: str = "tokens", least: int = 7) -> DataFrame:
    """Adds kept (list of places): by default tokens of at least so many characters."""

    def default():
        return lambda rows: {"kept": [[k for k, t in enumerate(ts) if len(t) >= least] for ts in rows[tokens]]}

    return applied(df, load or default, {"kept": "array<int>"})


def labelled(df: DataFrame, load: Callable) -> DataFrame:
    """Adds labels (JSON text) from an injected label client."""
    return applied(df, load, {"labels": "string"})


def allocated(needs: dict, pools: dict) -> dict:
    """A pool item for each need, none used twice: needs {need: acceptable pools}, pools {pool: items}. Raises if impossible.

    Augmenting paths over pools with capacities; needs and pools in order of their digests, so the result repeats.
    """
    order = lambda x: hashlib.sha1(str(x).encode()).hexdigest()
    held: dict[object, list] = {p: [] for p in pools}

    def place(need, seen: set) -> bool:
        for p in sorted(needs[need], key=order):
            if p in seen:
                continue
            seen.add(p)
            if len(held[p]) < len(pools[p]):
                held[p].append(need)
                return True
            for k, other in enumerate(held[p]):
                if place(other, seen):
                    held[p][k] = need
                    return True
        return False

    for need in sorted(needs, key=order):
        if not place(need, set()):
            raise ValueError(f"nothing left for {need}")
    return {need: item for p, got in held.items() for need, item in zip(got, sorted(pools[p], key=order), strict=False)}
