"""Null pools and matched nulls against plain counting."""

import itertools
import math
import random

import pytest

from colloquy.operators import nulls


def most_matched(eligible, room):
    """Places that can be filled, by Hall's rule over all sets of pools."""
    pools = list(room)
    lack = max(sum(room[p] for p in s) - len(set().union(*(eligible[p] for p in s))) for k in range(len(pools) + 1) for s in itertools.combinations(pools, k))
    return sum(room.values()) - lack


def test_allocation_fills_all_that_can_be():
    for seed in range(300):
        rng = random.Random(seed)
        items = [f"i{k}" for k in range(rng.randint(0, 12))]
        required = {p: rng.randint(1, 4) for p in range(1, rng.randint(2, 6))}
        desired = {p: n + rng.randint(0, 3) for p, n in required.items()}
        eligible = {p: [i for i in items if rng.random() < 0.5] for p in required}
        held, lacking, wanting = nulls.allocation(eligible, required, desired, "s")
        given = [i for found in held.values() for i in found]
        assert len(given) == len(set(given)) and set(given) == set().union(*eligible.values())  # each once, and all of them
        assert all(set(found) <= set(eligible[p]) for p, found in held.items())
        assert sum(required.values()) - sum(lacking.values()) == most_matched(eligible, required)
        if not lacking:
            assert sum(desired.values()) - sum(wanting.values()) == most_matched(eligible, desired)
        assert nulls.allocation(eligible, required, desired, "s") == (held, lacking, wanting)


def test_what_is_left_is_spread():
    eligible = {p: [f"i{k}" for k in range(40)] for p in (1, 2, 3)}
    held, lacking, wanting = nulls.allocation(eligible, dict.fromkeys(eligible, 1), dict.fromkeys(eligible, 2), "s")
    assert sorted(map(len, held.values())) == [13, 13, 14] and not lacking and not wanting


def test_allocated_by_groups(spark):
    items = [("a", "f", p, f"i{k}", k / 10) for k in range(6) for p in (1, 2) if (k + p) % 3] + [("b", "f", 1, "i0", 0.5), ("b", "f", 9, "i1", 0.5)]
    needs = [("a", "f", 1, 2, 3), ("a", "f", 2, 1, 2), ("b", "f", 1, 2, 3), ("c", "f", 1, 1, 1)]
    pools, support = nulls.allocated(spark.createDataFrame(items + items[:3], "s string, f string, pool int, item string, reward double").repartition(5), spark.createDataFrame(needs, "s string, f string, pool int, required int, desired int"), ["s", "f"])
    found = {(r.s, r.pool): r for r in support.collect()}
    assert [(found[k].lacking, found[k].eligible) for k in (("a", 1), ("a", 2), ("b", 1), ("c", 1))] == [(0, 4), (0, 4), (1, 1), (1, 0)]
    rows = pools.collect()
    assert sorted(r.item for r in rows if r.s == "a") == [f"i{k}" for k in range(6)] and [r.item for r in rows if r.s != "a"] == ["i0"]
    odd = spark.createDataFrame([("a", "f", 1, "i", 0.5), ("a", "f", 2, "i", 0.6)], "s string, f string, pool int, item string, reward double")
    with pytest.raises(Exception, match="two rewards"):
        nulls.allocated(odd, spark.createDataFrame(needs, "s string, f string, pool int, required int, desired int"), ["s", "f"])[0].collect()


def exact(pools, required, baseline):
    """The gains of all equally likely draws."""
    out = []
    for draw in itertools.product(*(itertools.combinations(pools[p], n) for p, n in required.items())):
        out.append(max(0.0, max(v for part in draw for v in part) - baseline))
    return out


def test_nulls_against_all_draws(spark):
    rng = random.Random(4)
    cases = {}
    for k in range(12):
        pools = {p: [round(rng.choice([0.0, 0.1, 0.2, 0.25, 0.5, 1.0]), 2) for _ in range(rng.randint(2, 7))] for p in range(1, rng.randint(2, 4))}
        required = {p: rng.randint(1, min(3, len(v))) for p, v in pools.items()}
        cases[f"u{k}"] = pools, required, rng.choice([0.0, 0.1, 0.3]), rng.choice([0.0, 0.2, 0.5])
    values = [("f" if u < "u3" else "g", u, p, v) for u, (pools, *_) in cases.items() for p, found in pools.items() for v in found]
    needs = [("f" if u < "u3" else "g", u, p, n) for u, (_, required, *_) in cases.items() for p, n in required.items()] + [("g", "short", 1, 3)]
    units = spark.createDataFrame([("f" if u < "u3" else "g", u, b, o) for u, (_, _, b, o) in cases.items()], "family string, unit string, baseline double, observed double")
    steps = nulls.best_steps(spark.createDataFrame(values + [("g", "short", 1, 0.5)], "family string, unit string, pool int, value double").repartition(4), spark.createDataFrame(needs, "family string, unit string, pool int, required int"), ["family", "unit"])
    assert {r.unit for r in steps.select("unit").distinct().collect()} == set(cases)
    expected = {r.unit: r.expected for r in nulls.expected_gains(steps, units, ["family", "unit"]).collect()}
    by_unit, whole = nulls.family_nulls(steps, units, "family", "unit")
    found = {r.unit: r for r in by_unit.collect()}
    for u, (pools, required, baseline, observed) in cases.items():
        gains = exact(pools, required, baseline)
        assert expected[u] == pytest.approx(sum(gains) / len(gains), abs=1e-8)
        assert found[u].null_mean == pytest.approx(expected[u], abs=0.02)
        share = sum(round(g, 9) >= observed for g in gains) / len(gains)
        assert found[u].p == pytest.approx((10_000 * share + 1) / 10_001, abs=0.025)
        assert round(found[u].p * 10_001, 6) == round(found[u].p * 10_001)
    for r in whole.collect():
        mine = [u for u in cases if (u < "u3") == (r.family == "f")]
        assert r.units == len(mine) and r.null_mean == pytest.approx(sum(expected[u] for u in mine) / len(mine), abs=0.01)
        assert r.observed == pytest.approx(sum(cases[u][3] for u in mine) / len(mine), abs=1e-8)
    again = nulls.family_nulls(steps.repartition(3), units, "family", "unit")[0]
    assert {r.unit: (r.p, r.null_mean) for r in again.collect()} == {u: (r.p, r.null_mean) for u, r in found.items()}


def test_log_factorials(spark):
    rows = spark.range(0, 400).select("id", nulls.log_factorial(__import__("pyspark.sql.functions", fromlist=["col"]).col("id")).alias("f")).collect()
    assert all(r.f == pytest.approx(math.lgamma(r.id + 1), abs=1e-9) for r in rows)
