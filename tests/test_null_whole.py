"""Matched nulls of every user, with the reference's number of draws."""

import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import statistics
from colloquy.plans import generic


def test_every_user_is_tested_against_all_values(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    want = {r[0] for r in e.where("value is not null").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type")).distinct().collect()}
    rows = generic.null_mc(spark, sf_dir).collect()
    assert {r.group for r in rows} == want and len(rows) == len(want)
    assert all(round(r.p * 10_001, 6) == round(r.p * 10_001) for r in rows)


def test_best_of_draws_without_replacement(spark):
    rows = [("g", 2, [0.0, 1.0, 2.0, 3.0], 0.0, 3.0), ("all", 4, [0.0, 1.0, 2.0, 3.0], 0.0, 3.0)]
    g = {r.group: r for r in statistics.null_monte_carlo(spark.createDataFrame(rows, "group string, needed int, pool array<double>, baseline double, observed double")).collect()}
    # the best of two of four is 3 in three of six pairs, 2 in two, 1 in one
    assert g["g"].p == pytest.approx(0.5, abs=0.03) and g["g"].null_mean == pytest.approx(14 / 6, abs=0.05)
    assert g["all"].p == 1.0 and g["all"].null_mean == 3.0


def test_intervals_use_the_references_draws():
    assert all(inspect.signature(f).parameters["draws"].default == 10_000 for f in (statistics.cluster_bootstrap, statistics.f1_bootstrap, statistics.null_monte_carlo))


def test_ranks_follow_their_exact_distribution():
    u = np.random.default_rng(3).random(200_000)
    for size, needed in ((6, 2), (300, 40), (5, 5), (1, 1)):
        got = np.bincount(statistics.best_ranks(size, needed, u), minlength=size + 1) / len(u)
        want = np.array([0.0] + [math.comb(k - 1, needed - 1) / math.comb(size, needed) for k in range(1, size + 1)])
        assert np.abs(got - want).max() < 0.006 and got[:needed].sum() == 0
    assert (np.abs(np.mean(statistics.best_ranks(10**10, 9, u) / 10**10) - 0.9)) < 0.002


def test_pooled_nulls_against_plain_draws(spark, monkeypatch):
    monkeypatch.setattr(statistics, "POOL_GROUPS", 3)
    monkeypatch.setattr(statistics, "POOL_PARTS", 40)
    rng = np.random.default_rng(5)
    pools = {"a": np.round(rng.normal(size=900), 1).tolist(), "b": [1.0] * 500 + [2.0] * 3, None: [4.0, 5.0]}
    values = spark.createDataFrame([(p, v) for p, vs in pools.items() for v in [*vs, None]], "pool string, value double")
    groups = [("a", f"a{n}-{o}", n, 0.5, o) for n in (1, 3, 50) for o in (0.0, 0.4, 1.0, 2.5)] + [("b", "b", 40, 0.0, 2.0), ("b", "none", 0, 0.0, 0.0), (None, "null", 9, 1.0, 4.0), ("empty", "e", 2, 0.0, 1.0)]
    got = {r.group: r for r in statistics.pooled_nulls(values, spark.createDataFrame(groups, "pool string, group string, needed int, baseline double, observed double"), ["pool"]).collect()}
    assert len(got) == len(groups)
    for pool, name, needed, baseline, observed in groups:
        held = np.array(pools.get(pool, []))
        n = min(needed, len(held))
        best = np.array([max(0.0, rng.permutation(held)[:n].max() - baseline) for _ in range(4_000)]) if n else np.zeros(10)
        assert got[name].null_mean == pytest.approx(best.mean(), abs=0.05), name
        assert got[name].p == pytest.approx((best >= observed).mean(), abs=0.04), name


def test_pooled_nulls_of_nothing(spark):
    values = spark.createDataFrame([], "pool string, value double")
    assert statistics.pooled_nulls(values, spark.createDataFrame([], "pool string, group string, needed int, baseline double, observed double"), ["pool"]).collect() == []
