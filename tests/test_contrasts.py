"""Contrasts of systems and cells with their intervals against plain resampling."""

import numpy as np
import pytest

from colloquy.operators import studies

VALUES = "system string, epoch int, route string, unit string, value double"
PAIRS, ENDS = {"t-c": ("t", "c"), "c-p": ("c", "p")}, {"p": 0, "c": 2, "t": 2}


def plain(delta, cluster=None, draws=4_000):
    """95 % interval of the mean of delta when clusters are drawn."""
    rng, cluster = np.random.default_rng(1), np.arange(len(delta)) if cluster is None else cluster
    sums = [(delta[cluster == c].sum(), (cluster == c).sum()) for c in np.unique(cluster)]
    s, n = map(np.array, zip(*sums, strict=True))
    at = rng.integers(0, len(s), (draws, len(s)))
    return np.quantile(s[at].sum(1) / n[at].sum(1), [0.025, 0.975])


def test_endpoints_paired_one_to_one(spark):
    rng = np.random.default_rng(2)
    held = {(s, r, u): float(np.round(rng.random(), 3)) for s in "pct" for r in ("x", "y") for u in range(60)}
    rows = [(s, e, r, f"u{u}", v if e == ENDS[s] else 99.0) for (s, r, u), v in held.items() for e in (0, 1, 2) if s != "p" or e == 0]
    pairs = studies.endpoint_pairs(spark.createDataFrame(rows, VALUES), PAIRS, ENDS, "route", "unit", "value")
    got = {(r.comparison, r.route): r for r in studies.endpoint_contrasts(pairs, "route", "unit").collect()}
    assert len(got) == 4
    for (name, route), r in got.items():
        left, right = (np.array([held[s, route, u] for u in range(60)]) for s in PAIRS[name])
        delta = left - right
        assert (r.n, r.better, r.worse, r.equal) == (60, (delta > 0).sum(), (delta < 0).sum(), (delta == 0).sum())
        assert (r.left, r.right, r.delta) == pytest.approx((left.mean(), right.mean(), delta.mean()), abs=1e-8)
        assert (r.low, r.high) == pytest.approx(tuple(plain(delta)), abs=0.012)


def test_endpoints_that_do_not_pair(spark):
    def pairs(rows, **more):
        return studies.endpoint_pairs(spark.createDataFrame(rows, VALUES), {"t-c": ("t", "c")}, {"c": 2, "t": 2}, "route", "unit", "value", **more)

    whole = [("t", 2, "x", "a", 1.0), ("c", 2, "x", "a", 0.5)]
    for odd, told in ((("t", 2, "x", "a", 1.0), "twice"), (("t", 2, "x", "b", 1.0), "lacks"), (("c", 2, "y", "a", 1.0), "lacks")):
        with pytest.raises(ValueError, match=told):
            pairs([*whole, odd])
    assert [tuple(r) for r in pairs([*whole, ("t", 2, "x", "b", 1.0), ("c", 2, "x", "b", None)], complete=False).collect()] == [("t-c", "x", "a", 1.0, 0.5, 0.5)]
    assert pairs([]).collect() == [] and pairs([*whole, ("t", 1, "x", "z", 1.0), ("other", 2, "x", "z", 1.0)]).count() == 1


def test_design_cells_share_their_draws(spark):
    rng = np.random.default_rng(6)
    clusters = np.repeat(np.arange(25), rng.integers(1, 5, 25))
    base = rng.random(len(clusters)) + clusters / 10  # what all cells of a cluster have in common is as large as can be
    cells = {"a": base, "b": base + 0.1, "c": base + rng.normal(0, 0.2, len(clusters))}
    rows = [("g", n, int(c), name, float(v[n])) for name, v in cells.items() for n, c in enumerate(clusters)]
    schema = "group string, unit int, cluster int, cell string, value double"
    run = lambda rows: studies.design_contrasts(spark.createDataFrame(rows, schema), list(cells), {"b-a": ("b", "a"), "c-a": ("c", "a")}, ["unit"], "cluster", ["group"])
    got = {r.comparison: r for r in run(rows).collect()}
    assert (got["b-a"].low, got["b-a"].delta, got["b-a"].high) == pytest.approx((0.1, 0.1, 0.1), abs=1e-8) and got["b-a"].n == len(clusters)
    delta = cells["c"] - base
    assert got["c-a"].delta == pytest.approx(delta.mean(), abs=1e-8)
    assert (got["c-a"].low, got["c-a"].high) == pytest.approx(tuple(plain(delta, clusters)), abs=0.01)
    for odd in (rows[1:], [*rows, rows[0]], [*rows[1:], (*rows[0][:4], None)]):
        with pytest.raises(ValueError, match="not complete"):
            run(odd)
