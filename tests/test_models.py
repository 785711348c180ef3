"""The trained selector and the count model's samples."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import sampling, selector


def small(rng, n=5, buckets=7):
    features = [rng.integers(0, buckets, (rng.integers(1, 5), 3)) for _ in range(n)]
    return features, [rng.integers(0, 3, len(f)) for f in features]


def test_loss_over_all_paths_and_gradient_by_differences():
    rng = np.random.default_rng(1)
    model = selector.Selector(rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    features, tags = small(rng)

    def path(f, t):
        scores = model.weights[f].sum(axis=1)
        return model.start[t[0]] + sum(scores[k, x] for k, x in enumerate(t)) + sum(model.moves[a, b] for a, b in itertools.pairwise(t))

    want = sum(math.log(sum(math.exp(path(f, p)) for p in itertools.product(range(3), repeat=len(f)))) - path(f, t) for f, t in zip(features, tags, strict=True))
    loss, gradient = selector.loss_and_gradient(model, features, tags)
    assert loss == pytest.approx(want)
    flat = model.flat()
    for k in range(flat.size):
        step = np.zeros(flat.size)
        step[k] = 1e-5
        up, down = (selector.loss_and_gradient(selector.Selector.of(flat + s), features, tags)[0] for s in (step, -step))
        assert gradient[k] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_training_falls_and_is_the_same_however_dealt(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        words = [rng.choice("keep these two words but not any other ones".split()) for _ in range(rng.randint(0, 9))]
        kept = [w in ("keep", "words") for w in words]
        rows.append((k, words, [0 if not x else 2 if i and kept[i - 1] else 1 for i, x in enumerate(kept)]))
    df = spark.createDataFrame(rows, "id int, words array<string>, tags array<int>").withColumn("features", selector.token_features(F.col("words")))
    one, other = selector.train(df.repartition(1), 12), selector.train(df.repartition(7), 12)
    assert np.allclose(one.flat(), other.flat(), atol=1e-6) and one.losses[-1] < 0.2 * one.losses[0]
    found = selector.selected(df.select("id", "features", "tags"), one).collect()
    assert len(found) == 300 and all(r.best == r.tags for r in found)
    assert not selector.train(df.where("size(words) = 0"), 2).flat().any()


def test_choices(spark):
    model = spark.createDataFrame([("a", "x", 6), ("a", "y", 3), ("a", "z", 3), ("a", "q", 1), ("b", "x", 1)], "before string, word string, n long")
    of = lambda *how: {r.before: [(o.word, round(o.upto, 6)) for o in r.options] for r in sampling.choices(model, *how).collect()}
    assert of(1.0, 3, 1.0)["a"] == [("x", 0.5), ("y", 0.75), ("z", 1.0)]
    assert of(0.0, 9, 1.0)["a"] == [("x", 1.0)] and of(1.0, 9, 0.4)["a"] == [("x", 1.0)]
    assert of(1.0, 9, 0.6)["a"] == [("x", round(6 / 9, 6)), ("y", 1.0)]
    assert of(0.5, 2, 1.0)["a"] == [("x", 0.8), ("y", 1.0)] and of(0.5, 2, 1.0)["b"] == [("x", 1.0)]
    with pytest.raises(ValueError):
        sampling.choices(model, 1.0, 0, 1.0)


def test_samples_follow_the_model_and_repeat(spark):
    texts = spark.createDataFrame([("a b",)] * 6 + [("a c",)] * 3 + [("d",)] + [("",), (None,)], "text string")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")
    model = sampling.successions(texts, words)
    prompts = spark.createDataFrame([(f"p{k}", None) for k in range(150)] + [("from a", "a"), ("unknown", "zz")], "sequence_id string, last string")
    options = sampling.choices(model, 1.0, 5, 1.0)
    rows = [(r.sequence_id, r.sample, tuple(r.words)) for r in sampling.sampled(prompts, options, 20, 3, "s").collect()]
    again = [(r.sequence_id, r.sample, tuple(r.words)) for r in sampling.sampled(prompts.repartition(9), options, 20, 3, "s").collect()]
    assert sorted(rows) == sorted(again) and len(rows) == 152 * 20
    free = collections.Counter(w for p, _, w in rows if p.startswith("p"))
    for seq, share in {("a", "b"): 0.6, ("a", "c"): 0.3, ("d",): 0.1}.items():
        assert free[seq] / 3000 == pytest.approx(share, abs=4 * math.sqrt(share * (1 - share) / 3000))
    assert {w for p, _, w in rows if p == "from a"} == {("b",), ("c",)} and {w for p, _, w in rows if p == "unknown"} == {()}
    assert {tuple(r.words) for r in sampling.sampled(prompts.where("last is null"), sampling.choices(model, 0.0, 5, 1.0), 2, 1, "s").collect()} == {("a",)}


def test_selector_beats_the_length_rule(spark, sf_dir):
    from colloquy.plans import modelled

    larger = sf_dir.replace("sf0.001", "sf0.01")
    found = {r.system: r for r in modelled.selector_f1(spark, larger).collect()}
    assert found["selector"].f1 > 0.2 > found["length rule"].f1


def test_dense_tiles_hold_few_scores_and_find_the_same():
    """Ties at the k-th place too; a tile of one query at a time, and more queries than one product could hold in memory at once."""
    import types

    import pyarrow as pa

    from colloquy.operators import retrieval

    rng = np.random.default_rng(3)
    rows = rng.integers(-1, 2, (500, 4)).astype(float)
    asked = rng.integers(-1, 2, (40, 4)).astype(float)
    batches = [pa.RecordBatch.from_arrays([pa.array([f"{k:04}" for k in range(a, a + 250)]), pa.array(rows[a : a + 250].tolist())], names=["docid", "vector"]) for a in (0, 250)]
    shared = types.SimpleNamespace(value=(asked, [f"q{k}" for k in range(40)]))
    of = lambda k, tile: [tuple(r.values()) for b in retrieval._best_of(shared, k, tile)(iter(batches)) for r in b.to_pylist()]
    scores = asked @ rows.T
    for k in (1, 7, 500, 900):
        want = [(f"q{q}", f"{d:04}", scores[q, d]) for q in range(40) for d in sorted(range(500), key=lambda d: (-scores[q, d], -d))[:k]]
        assert of(k, 1) == want and of(k, retrieval.TILE) == want
    many = types.SimpleNamespace(value=(np.zeros((70_000, 4)), list(range(70_000))))
    import tracemalloc

    tracemalloc.start()
    n = sum(b.num_rows for b in retrieval._best_of(many, 3, 1 << 20)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 210_000 and peak < 200 << 20  # all scores at once would take 280 MB, their order as much again


def test_bm25_by_blocks_of_queries_and_passages(spark, monkeypatch):
    """Against plain sums, with blocks of few terms, repeated passages that tie, and k beyond the passages found."""
    from colloquy.operators import retrieval

    rng = random.Random(8)
    words = [f"t{k}" for k in range(12)]
    docs = {f"d{k:03}": " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for k in range(60)}
    docs |= {f"e{k}": docs["d001"] or "t1 t2" for k in range(30)}
    asks = {f"q{k}": " ".join(rng.sample([*words, "absent"], rng.randint(1, 5))) for k in range(15)} | {"none": "absent", "empty": ""}
    average = sum(len(t.split()) for t in docs.values()) / len(docs)
    df = collections.Counter(w for t in docs.values() for w in set(t.split()))
    want = []
    for k in (3, 500):
        for q, text in asks.items():
            scored = {}
            for d, t in docs.items():
                tf = collections.Counter(t.split())
                parts = [math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + 0.9 * (0.6 + 0.4 * len(t.split()) / average)) for w in set(text.split()) if tf[w]]
                if parts:
                    scored[d] = round(sum(parts), 6)
            want += [(k, q, n + 1, d) for n, d in enumerate(sorted(scored, key=lambda d: (-scored[d], d))[:k])]
    corpus = spark.createDataFrame(list(docs.items()), "docid string, text string").repartition(3)
    queries = spark.createDataFrame(list(asks.items()), "query_id string, query string")
    for rows in (retrieval.TERM_ROWS, 10):
        monkeypatch.setattr(retrieval, "TERM_ROWS", rows)
        got = [(k, r.query_id, r["rank"], r.docid) for k in (3, 500) for r in retrieval.bm25(queries, corpus, k).collect()]
        assert sorted(got) == sorted(want)
    assert retrieval.bm25(queries.where("query = ''"), corpus, 3).count() == 0
