"""Evaluations of routes and budgets ask with the turns of every conversation."""

import pytest

from colloquy.operators import routes
from colloquy.plans import bindings, composites, evidence

CELLS = {(r, b) for r in routes.ROUTES for b in composites.BUDGETS}


def test_budget_sweep_asks_with_every_turn(spark, sf_dir):
    every = bindings.samples(spark, sf_dir).count()
    assert {(r.route, r.budget): r.n for r in composites.budget_sweep(spark, sf_dir).collect()} == dict.fromkeys(CELLS, every)


def test_design_bootstrap_draws_from_every_conversation(spark, sf_dir):
    means = {f"{r.route}_{r.budget}": r.mrr for r in composites.budget_sweep(spark, sf_dir).collect()}
    got = {r.metric: r for r in composites.design_bootstrap(spark, sf_dir).collect()}
    assert {m: r.mean for m, r in got.items()} == pytest.approx(means, abs=1e-8) and all(r.low <= r.mean <= r.high for r in got.values())
    assert any(r.low < r.high for r in got.values())  # the tables' one conversation divisible by 50 alone has no width


def test_paired_quality_intervals_pair_every_turn(spark, sf_dir):
    every = bindings.samples(spark, sf_dir).count()
    got = evidence.paired_quality_intervals(spark, sf_dir).collect()
    assert len(got) == 7 and all(r.n == every and r.low <= r.delta <= r.high for r in got)
