"""Games over all questions of a conversation."""

import itertools
from math import factorial

import pytest

from colloquy.plans import conversations


def test_shapley_plays_all_questions(spark, tmp_path):
    words = [["apple", "pear"], ["pear", "plum"], ["plum"], [], ["apple", "quince"], ["quince", "melon", "pear"]]
    said = {1: words, 2: [["lemon"]] * 20, 3: words[:3]}
    rows = [(c, 2 * k + who, ("user", "assistant")[who], " ".join(w) if who == 0 else "yes") for c, ws in said.items() for k, w in enumerate(ws) for who in (0, 1)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.game, r.player): r.phi for r in conversations.shapley_exact(spark, str(tmp_path)).collect()}
    assert set(got) == {(c, k) for c, ws in said.items() for k in range(len(ws))}
    worth = lambda c, players: len(set().union(*(said[c][p] for p in players)))
    for c in (1, 3):
        n = len(said[c])
        for p in range(n):
            rest = [x for x in range(n) if x != p]
            phi = sum(factorial(k) * factorial(n - k - 1) / factorial(n) * (worth(c, (*s, p)) - worth(c, s)) for k in range(n) for s in itertools.combinations(rest, k))
            assert got[c, p] == pytest.approx(phi, abs=1e-8)
    assert all(got[2, k] == 0.05 for k in range(20))
