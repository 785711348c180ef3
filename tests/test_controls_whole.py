"""Control masks of histories deeper than the exhaustive ones."""

from collections import Counter
from math import comb

from colloquy.operators import candidates


def test_every_number_of_kept_turns_has_its_masks(spark):
    depths = {f"s{n}-{k}": n for n in (9, 10, 11, 12) for k in range(40)}
    rows = candidates.controls(spark.createDataFrame(list(depths.items()), "sample_id string, depth long")).collect()
    masks = {(r.sample_id, r.mask) for r in rows}
    assert len(masks) == len(rows) and all(len(r.mask) == r.depth for r in rows)
    assert Counter((s, m.count("1")) for s, m in masks) == {(s, c): min(10, comb(n, c)) for s, n in depths.items() for c in range(1, n + 1)}
