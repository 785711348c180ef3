"""Matched nulls of candidate families: controls allocated to pools, and best draws from several pools at once."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import table
from .statistics import DECIMALS, REPLICATES, matched, preceding, seed_of

#: What a pool should hold besides what it must: so many more items, and so many at least.
BUFFER, LEAST = 2, 5


def _order(*parts: object) -> str:
    return hashlib.sha1(":".join(map(str, parts)).encode()).hexdigest()


def _matching(eligible: dict[int, list[str]], room: dict[int, int], held: dict[int, list[str]], owner: dict[str, int]) -> None:
    """Gives pools items up to their room by shortest augmenting paths, pools with the fewest eligible items first. A pool that has an item
    never ends with fewer."""
    for pool in sorted(room, key=lambda p: (len(eligible[p]), p)):
        while len(held[pool]) < room[pool]:
            came, queue, free = {pool: None}, deque([pool]), None
            while queue and free is None:
                at = queue.popleft()
                for item in eligible[at]:
                    holder = owner.get(item)
                    if holder is None:
                        free = at, item
                        break
                    if holder not in came:
                        came[holder] = at, item
                        queue.append(holder)
            if free is None:
                break
            at, item = free
            while True:
                held[at].append(item)
                owner[item] = at
                if came[at] is None:
                    break
                before, item = came[at]
                held[at].remove(item)
                at = before


def allocation(eligible: dict[int, list[str]], required: dict[int, int], desired: dict[int, int], salt: str) -> tuple[dict[int, list[str]], dict[int, int], dict[int, int]]:
    """(items of each pool, what each lacks of its required, and of its desired number). eligible: the items each pool may take.

    No item is used twice. As many required places as can be are filled; if all are, as many desired ones as can be. Each item that is left
    goes to the eligible pool that is least full for its desired number. Ties go by digests of the salt, so the result repeats.
    """
    listed = {p: sorted(set(eligible.get(p, ())), key=lambda i: _order(salt, p, i)) for p in required}
    held, owner = {p: [] for p in required}, {}
    _matching(listed, required, held, owner)
    lacking = {p: n - len(held[p]) for p, n in required.items() if len(held[p]) < n}
    if not lacking:
        _matching(listed, desired, held, owner)
    wanting = {p: n - len(held[p]) for p, n in desired.items() if len(held[p]) < n}
    takers: dict[str, list[int]] = {}
    for p, items in listed.items():
        for i in items:
            if i not in owner:
                takers.setdefault(i, []).append(p)
    for i in sorted(takers, key=lambda i: _order(salt, "left", i)):
        p = min(takers[i], key=lambda p: (len(held[p]) / max(1, desired[p]), _order(salt, "to", i, p)))
        held[p].append(i)
    return held, lacking, wanting


def allocated(items: DataFrame, needs: DataFrame, by: list[str], salt: str = "null") -> tuple[DataFrame, DataFrame]:
    """(pools: by, pool, item, reward; support: by, pool, required, desired, eligible, lacking, wanting).

    items: by, pool, item, reward, a row for each pool that an item may go to; needs: by, pool, required, desired. Each group of `by` is allocated
    by itself (see allocation), in one task: a group is what one sample's masks give. Items of pools without a need are left out. An item
    with two rewards raises.
    """
    kinds = {f.name: f.dataType.simpleString() for f in needs.schema.fields}
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    useful = items.join(needs.select(*by, "pool").where("pool is not null"), [*by, "pool"], "left_semi").select(*by, "pool", "item", "reward").distinct()

    def run(key: tuple, group: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        required = {int(p): int(n) for p, n in zip(asked["pool"], asked["required"], strict=True) if n > 0}
        desired = {int(p): max(int(n), required[int(p)]) for p, n in zip(asked["pool"], asked["desired"], strict=True) if int(p) in required}
        eligible: dict[int, list[str]] = {p: [] for p in required}
        rewards: dict[str, float] = {}
        for p, item, reward in zip(group["pool"], group["item"], group["reward"], strict=True):
            if rewards.setdefault(item, reward) != reward:
                raise ValueError(f"{item} of {key} has two rewards")
            if p in eligible:
                eligible[int(p)].append(item)
        held, lacking, wanting = allocation(eligible, required, desired, _order(salt, *key))
        rows = [(*key, p, i, rewards[i], None, None, None, None, None) for p, found in held.items() for i in sorted(found, key=lambda i, p=p: _order(salt, *key, "pool", p, i))]
        rows += [(*key, p, None, None, required[p], desired[p], len(set(eligible[p])), lacking.get(p, 0), wanting.get(p, 0)) for p in required]
        return pd.DataFrame(rows, columns=[*by, "pool", "item", "reward", "required", "desired", "eligible", "lacking", "wanting"])

    schema = f"{keys}, pool int, item string, reward double, required int, desired int, eligible int, lacking int, wanting int"
    both = table(useful.groupBy(*by).cogroup(needs.groupBy(*by)).applyInPandas(run, schema), "null-pools")
    return both.where("item is not null").select(*by, "pool", "item", "reward"), both.where("item is null").select(*by, "pool", "required", "desired", "eligible", "lacking", "wanting")


def log_factorial(n: Column) -> Column:
    """ln n!, from logarithms up to 20, beyond from Stirling's series (to about 1e-13)."""
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, k: s + F.log(k))
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    return F.when(n <= 20, small).otherwise(series)


def best_steps(pools: DataFrame, needs: DataFrame, by: list[str]) -> DataFrame:
    """by, value, low and high: the best of all draws has this value with probability high - low, and at most this one with probability high.

    pools: by, pool, value; needs: by, pool, required: so many values are drawn from each pool without replacement, and the best of all counts.
    Of N values the best of n is among the first k with probability C(k, n) / C(N, n); the pools' probabilities are multiplied. Values are
    counted first, and sums run over ranges of values, so no task holds a pool. Groups with a pool that is short of values have no rows.
    """
    counted = pools.groupBy(*by, "pool", "value").agg(F.count("*").alias("_c"))
    sizes = counted.groupBy(*by, "pool").agg(F.sum("_c").alias("_all"))
    wanted = table(matched(needs.where("required > 0").select(*by, "pool", "required"), sizes, [*by, "pool"], "left").withColumn("_all", F.coalesce("_all", F.lit(0))), "null-needs")
    short = wanted.where("_all < required").select(*by).distinct()
    ready = wanted.join(short, by, "left_anti")
    opened = ready.groupBy(*by).agg(F.count("*").alias("_pools"))
    placed = matched(preceding(counted, [*by, "pool"], [F.col("value")], F.col("_c")), ready, [*by, "pool"])
    n, upto = F.col("required"), F.col("_before") + F.col("_c")
    chance = lambda k: log_factorial(k) - log_factorial(k - n) - log_factorial(F.col("_all")) + log_factorial(F.col("_all") - n)
    opens = (F.col("_before") < n) & (upto >= n)
    gain = F.when(upto < n, 0.0).when(opens, chance(upto)).otherwise(chance(upto) - chance(F.col("_before")))
    merged = placed.groupBy(*by, "value").agg(F.sum(gain).alias("_gain"), F.sum(opens.cast("bigint")).alias("_opens"))
    summed = preceding(merged, by, [F.col("value")], F.col("_opens")).withColumnRenamed("_before", "_opened")
    both = matched(preceding(summed, by, [F.col("value")], F.col("_gain")), opened, by)
    whole = lambda ready, log: F.when(ready < F.col("_pools"), 0.0).when(log > -1e-9, 1.0).otherwise(F.exp(log))
    low = whole(F.col("_opened"), F.col("_before"))
    high = whole(F.col("_opened") + F.col("_opens"), F.col("_before") + F.col("_gain"))
    return both.select(*by, "value", low.alias("low"), high.alias("high")).where("high > low")


def expected_gains(steps: DataFrame, units: DataFrame, by: list[str]) -> DataFrame:
    """by and expected: the mean of the best draw's gain over the baseline, at least 0, in steps; 0 for units (by, baseline) without any need."""
    gain = (F.col("high") - F.col("low")) * F.greatest(F.col("value") - F.col("baseline"), F.lit(0.0))
    return matched(steps, units.select(*by, "baseline"), by).groupBy(*by).agg(F.round(F.sum(gain), DECIMALS).alias("expected"))


def family_nulls(steps: DataFrame, units: DataFrame, family: str, unit: str, draws: int = REPLICATES, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(a row for each unit: family, unit, observed, null_mean, p; a row for each family: family, units, observed, null_mean, p).

    units: family, unit, baseline, observed gain, of the units that have steps (family, unit, value, low, high). In draw r a unit gains the best draw less the baseline, at
    least 0, and a family the mean over its units; p = (draws of at least what was observed + 1) / (draws + 1). A unit's numbers come from
    a seed of its own, so every task that holds a part of its steps draws the same and keeps those that fall into its part; tasks add up their
    units' draws before anything is shuffled, `draws` numbers for a family.
    """
    asked = matched(steps, units, [family, unit])
    dealt = asked.select(F.col(family).alias("family"), F.col(unit).alias("unit"), "value", "low", "high", "baseline", "observed").repartitionByRange("family", "unit", "value").sortWithinPartitions("family", "unit", "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, np.ndarray] = {}
        of, numbers = None, None
        for batch in batches:
            out = []
            for (name, who), rows in batch.groupby(["family", "unit"], sort=False, dropna=False):
                if (name, who) != of:
                    of, numbers = (name, who), np.random.default_rng(seed_of(seed, f"{name}\0{who}")).random(draws)
                high = rows["high"].to_numpy()
                mine = np.flatnonzero((numbers >= rows["low"].iloc[0]) & (numbers < high[-1]))
                gains = np.maximum(rows["value"].to_numpy()[np.searchsorted(high, numbers[mine], "right")] - rows["baseline"].iloc[0], 0.0)
                total = sums.setdefault(name, np.zeros(draws))
                total[mine] += gains
                out.append((name, who, float(gains.sum()), int((np.round(gains, DECIMALS) >= round(rows["observed"].iloc[0], DECIMALS)).sum()), None))
            yield pd.DataFrame(out, columns=["family", "unit", "total", "hits", "draws"])
        if sums:
            yield pd.DataFrame([(name, None, None, None, total) for name, total in sums.items()], columns=["family", "unit", "total", "hits", "draws"])

    kind = units.schema[unit].dataType.simpleString()
    drawn = table(dealt.mapInPandas(run, f"family {units.schema[family].dataType.simpleString()}, unit {kind}, total double, hits long, draws array<double>"), "null-draws")
    each = drawn.where("draws is null").groupBy("family", "unit").agg(F.round(F.sum("total") / draws, DECIMALS).alias("null_mean"), ((F.sum("hits") + 1) / (draws + 1)).alias("p"))
    by_unit = units.select(F.col(family).alias("family"), F.col(unit).alias("unit"), "observed").join(each, ["family", "unit"]).withColumnsRenamed({"family": family, "unit": unit})
    seen = by_unit.groupBy(F.col(family).alias("family")).agg(F.count("*").alias("units"), F.round(F.avg("observed"), DECIMALS).alias("observed"))
    by_draw = drawn.where("draws is not null").select("family", F.posexplode("draws").alias("draw", "total")).groupBy("family", "draw").agg(F.sum("total").alias("total"))
    means = by_draw.join(seen, "family").withColumn("_mean", F.round(F.col("total") / F.col("units"), DECIMALS))
    whole = means.groupBy("family", "units", "observed").agg(F.round(F.avg("_mean"), DECIMALS).alias("null_mean"), ((F.count_if(F.col("_mean") >= F.col("observed")) + 1) / (draws + 1)).alias("p"))
    return by_unit, whole.withColumnRenamed("family", family)
