"""Summaries, resampling and inference.

Sums by cluster are Spark aggregates; only those small tables reach the grouped NumPy kernels
that draw bootstrap and Monte-Carlo samples, one task for each group of results.
"""

from __future__ import annotations

import hashlib
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import table

DECIMALS = 9
#: Draws of bootstraps and Monte-Carlo nulls.
REPLICATES = 10_000
#: Degrees of freedom up to which quantiles of Student's t are worked out one by one; a series serves beyond.
T_LISTED = 200


@cache
def t_975(freedom: int) -> float:
    """The 97.5 % quantile of Student's t. With t = sqrt(v) tan(x) its density is cos(x) ** (v - 1) up to a factor, which is
    integrated by Gauss and Legendre's rule; the quantile is then found by bisection."""
    nodes, weights = np.polynomial.legendre.leggauss(200)
    mass = lambda x: float(weights @ np.cos((nodes + 1) * x / 2) ** (freedom - 1)) * x / 2
    low, high, wanted = 0.0, np.pi / 2, 0.95 * mass(np.pi / 2)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mass(middle) < wanted else (low, middle)
    return float(np.sqrt(freedom) * np.tan(low))


def t_quantile(freedom: Column) -> Column:
    """The 97.5 % quantile of Student's t by degrees of freedom; null below 1. Beyond T_LISTED the Cornish-Fisher series is exact
    to ten decimals."""
    z = 1.959963984540054
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    series = F.lit(z)
    for power, term in enumerate(terms, 1):
        series = series + term / F.pow(freedom.cast("double"), F.lit(power))
    listed = F.array(*[F.lit(t_975(v)) for v in range(1, T_LISTED + 1)])
    return F.when(freedom > T_LISTED, series).when(freedom >= 1, F.get(listed, freedom.cast("int") - 1))


def moments(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, variance (0 for one value), min, max and a normal 95 % interval of the mean."""
    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance"), F.min(value).alias("least"), F.max(value).alias("most"))
    half = 1.96 * F.sqrt(F.col("variance") / F.col("n"))
    r = lambda c: F.round(c, DECIMALS)
    return g.select(*by, "n", r(F.col("mean")).alias("mean"), r(F.col("variance")).alias("variance"), "least", "most", r(F.col("mean") - half).alias("low"), r(F.col("mean") + half).alias("high"))


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of the one row of right that has its keys; null keys are equal. Without keys right is one row. how: `left` keeps
    rows without a match."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def preceding(df: DataFrame, by: list[str], order: list[Column], weight: Column) -> DataFrame:
    """Adds _before: the sum of the weights of the rows before in the group, by an order without ties.

    Rows are dealt to ranges of group and order and written; only the ranges' sums meet, so that no task holds a whole group.
    """
    dealt = table(df.withColumn("_weight", weight).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*by, "_part").agg(F.sum("_weight").alias("_sum"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = F.sum("_weight").over(Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    both = matched(dealt.withColumn("_within", F.coalesce(within, F.lit(0))), starts, ["_part", *by])
    return both.withColumn("_before", F.col("_start") + F.col("_within")).drop("_part", "_weight", "_within", "_start")


def quantiles(df: DataFrame, value: str, by: list[str], points: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, a column for each named point; null where a group has no values.

    Rows become counts of each group's values, and these are placed by ranges.
    """
    counts = df.select(*by, F.col(value).alias("_v")).groupBy(*by, "_v").agg(F.count("_v").alias("_c"))
    placed = preceding(counts, by, [F.col("_v")], F.col("_c"))
    sized = matched(placed, placed.groupBy(*by).agg(F.sum("_c").alias("_n")), by)

    def at(place: Column) -> Column:
        here = (F.col("_before") <= place) & (place < F.col("_before") + F.col("_c"))
        return F.max(F.when(here, F.col("_v").cast("double")))

    def point(p: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)
        mixed = (F.max(high) - F.max(place)) * at(low) + (F.max(place) - F.max(low)) * at(high)
        return F.round(F.when(F.max(low) == F.max(high), at(low)).otherwise(mixed), DECIMALS)

    return sized.groupBy(*by).agg(*[point(p).alias(name) for name, p in points.items()])


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """column, n and share of each value; nulls are a value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), DECIMALS))


def rolling_mean(df: DataFrame, value: str, keys: list[str], order: list[str], rows: int = 100) -> DataFrame:
    """Adds rolling: the mean of the last `rows` rows of a group, of fewer at its start."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, Window.currentRow)
    return df.withColumn("rolling", F.round(F.avg(value).over(w), DECIMALS))


def running(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Adds running_sum and running_max."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({"running_sum": F.round(F.sum(value).over(w), 6), "running_max": F.max(value).over(w)})


def holm(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
    """Adds holm: p values adjusted step down within each family. Null counts as 1 in its family and stays null."""
    family = Window.partitionBy(*keys)
    order = family.orderBy(F.coalesce(p, F.lit(1.0)))
    place = F.row_number().over(order)
    raw = F.coalesce(p, F.lit(1.0)) * (F.count("*").over(family) - place + 1)
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = df.withColumn("_raw", raw).withColumn("holm", F.when(F.col(p).isNotNull(), F.round(F.least(F.lit(1.0), F.max("_raw").over(up_to)), DECIMALS)))
    return adjusted.drop("_raw")


def student_interval(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """runs, mean, deviation, least, most, variation and a Student-t 95 % interval; the interval is null for one run."""
    g = df.groupBy(*by).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("most"))
    half = F.when(F.col("runs") > 1, t_quantile(F.col("runs") - 1) * F.col("deviation") / F.sqrt("runs"))
    r = lambda c: F.round(c, DECIMALS)
    return g.select(*by, "runs", r(F.col("mean")).alias("mean"), r(F.col("deviation")).alias("deviation"), "least", "most", r(F.col("deviation") / F.col("mean")).alias("variation"), r(F.col("mean") - half).alias("low"), r(F.col("mean") + half).alias("high"))


def cluster_sums(df: DataFrame, cluster: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows and sums of each cluster: all that a cluster bootstrap needs."""
    return df.groupBy(*(by or []), cluster).agg(F.count("*").alias("rows"), *[F.sum(v).alias(v) for v in values])


def seed_of(*parts: object) -> int:
    return int(hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()[:16], 16)


#: Clusters that one task draws for at most (on average).
PART_CLUSTERS = 5_000


def drawn_sums(sums: DataFrame, cluster: str, values: list[str], by: list[str], draws: int = REPLICATES, seed: int = 7) -> DataFrame:
    """by, draw and the sums of `values` over clusters drawn with replacement, as many as the group has.

    Clusters are dealt to parts of a bounded size. All parts of a group draw the same numbers of clusters for each part (a
    multinomial), and each part then draws its own clusters (another), which together is the multinomial over all of them.
    """
    sums = sums.select(*by, cluster, *values)
    most = sums.groupBy(*by).count().agg(F.max("count")).first()[0] or 1
    parts = -(-most // PART_CLUSTERS)
    dealt = sums.withColumn("_part", F.pmod(F.xxhash64(cluster), F.lit(parts)))
    sizes = dealt.groupBy(*by, "_part").count().groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_part", "count"))).alias("_sizes"))
    of = sizes.select(*by, F.transform("_sizes", lambda x: x["_part"]).alias("_parts"), F.transform("_sizes", lambda x: x["count"]).alias("_counts"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*by).schema.fields), "draw int", *(f"`{v}` double" for v in values)])

    def kernel(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        *key, part = key
        rows = rows.sort_values(cluster)
        counts = np.array(rows["_counts"].iloc[0])
        own = list(rows["_parts"].iloc[0]).index(part)
        shared = np.random.default_rng(seed_of(seed, *key)).multinomial(counts.sum(), counts / counts.sum(), size=draws)[:, own]
        rng, x = np.random.default_rng(seed_of(seed, *key, "part", part)), rows[values].to_numpy(float)
        found = [rng.multinomial(shared[at : at + 100], np.full(len(x), 1 / len(x))) @ x for at in range(0, draws, 100)]
        out = pd.DataFrame(np.concatenate(found), columns=values)
        out.insert(0, "draw", np.arange(draws, dtype=np.int32))
        for name, value in reversed(list(zip(by, key, strict=True))):
            out.insert(0, name, value)
        return out

    drawn = dealt.join(of, by).groupBy(*by, "_part").applyInPandas(kernel, schema)
    return drawn.groupBy(*by, "draw").agg(*[F.sum(v).alias(v) for v in values])


def interval(drawn: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """by, low and high: the 2.5 and 97.5 % quantiles of a value over a fixed number of draws."""
    return drawn.groupBy(*by).agg(F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"))


def cluster_bootstrap(sums: DataFrame, cluster: str, values: list[str], by: list[str], draws: int = REPLICATES, seed: int = 7) -> DataFrame:
    """by, metric, mean, low and high (2.5 and 97.5 %): clusters are drawn with replacement and each draw's mean is the drawn sums over
    the drawn rows. All values of a group share their draws. sums: as cluster_sums gives them."""
    drawn = drawn_sums(sums, cluster, ["rows", *values], by, draws, seed)
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), (F.col(v) / F.col("rows")).alias("m")) for v in values])).alias("x")
    low_high = interval(drawn.select(*by, each).select(*by, "x.*"), F.col("m"), [*by, "metric"])
    means = sums.groupBy(*by).agg(*[(F.sum(v) / F.sum("rows")).alias(v) for v in values]).select(*by, F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("mean")) for v in values])).alias("x")).select(*by, "x.*")
    return means.join(low_high, [*by, "metric"]).select(*by, "metric", "mean", "low", "high")


def singleton_bootstrap(rows: DataFrame, cluster: str, values: list[str], by: list[str], draws: int = REPLICATES, seed: int = 7) -> DataFrame:
    """cluster_bootstrap over single rows; raises if a cluster of a group has more than one."""
    if odd := rows.groupBy(*by, cluster).count().where("count > 1").head(1):
        raise ValueError(f"several rows of {odd[0][cluster]}")
    return cluster_bootstrap(rows.select(*by, cluster, *values, F.lit(1).alias("rows")), cluster, values, by, draws, seed)


def stratified_bootstrap(rows: DataFrame, stratum: str, unit: str, value: str, salt: str, draws: int = REPLICATES) -> DataFrame:
    """stratum, n, mean, low and high of each stratum by itself; rows of a stratum are drawn with a seed of the salt and its name."""
    each = singleton_bootstrap(rows.select(stratum, unit, value), unit, [value], [stratum], draws, int(hashlib.sha1(salt.encode()).hexdigest()[:8], 16))
    return rows.groupBy(stratum).agg(F.count("*").alias("n")).join(each.drop("metric"), stratum)


def paired(df: DataFrame, unit: list[str], arm: str, left: object, right: object, value: str) -> DataFrame:
    """unit, left, right and delta (right less left) of the units that have both arms."""
    wide = df.where(F.col(arm).isin([left, right])).groupBy(*unit).pivot(arm, [left, right]).agg(F.first(value))
    named = wide.withColumnsRenamed({str(left): "left", str(right): "right"}).where("left is not null and right is not null")
    return named.withColumn("delta", F.round(F.col("right") - F.col("left"), DECIMALS))


#: Ranks of a pool that share a key when draws are looked up, such runs of a pool (larger pools have longer runs), and groups and kinds
#: (pool and number) that one task tests and draws for (on average).
POOL_RANKS, POOL_PARTS, POOL_GROUPS, POOL_KINDS = 64, 1_000_000, 5_000, 16


def _log_factorials(n: np.ndarray) -> np.ndarray:
    """ln n!, from a table up to 255, from Stirling's series beyond."""
    listed = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])
    x = np.maximum(n, 256).astype(float)
    return np.where(n < 256, listed[np.minimum(n, 255)], x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3))


def best_ranks(size: int, needed: int, u: np.ndarray) -> np.ndarray:
    """The rank (1 to size) of the best of `needed` values drawn from `size` without replacement, for each uniform number: it is k or less
    with probability C(k, needed) / C(size, needed)."""
    low, high = np.full(len(u), needed), np.full(len(u), size)
    whole = _log_factorials(np.array(size)) - _log_factorials(np.array(size - needed))
    while (low < high).any():
        middle = (low + high) // 2
        reached = np.exp(_log_factorials(middle) - _log_factorials(middle - needed) - whole) > u
        low, high = np.where(reached, low, np.minimum(middle + 1, high)), np.where(reached, middle, high)
    return low


def pooled_nulls(values: DataFrame, groups: DataFrame, by: list[str], draws: int = REPLICATES, seed: int = 7) -> DataFrame:
    """Matched null of each group (by, group, needed, baseline, observed gain) against the values (by, value) of its pool: `draws` times the
    best of `needed` values drawn without replacement, less the baseline, at least 0. Gives by, group, null_mean, null_max and
    p = (draws at or above the observed gain + 1) / (draws + 1).

    Draws are ranks, which are found without the values; groups of one pool and number share them, so each p is right by itself
    and those of such groups go together. Values are counted and numbered by ranges, and drawn ranks meet them by short runs of ranks,
    so no task holds a pool; groups meet their `draws` best values in parts of POOL_GROUPS. Null values don't count; where more
    are needed than there are, all are drawn; without any, or with none needed, each draw gains 0.
    """
    counted = values.where("value is not null").groupBy(*by, F.col("value").cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    counted = table(counted, "pool-values")
    sizes = counted.groupBy(*by).agg(F.sum("_c").alias("_all"))
    asked = table(groups.select(*by, "group", "needed", "baseline", "observed"), "pool-groups")
    kinds = matched(asked.groupBy(*by, "needed").agg(F.count("*").alias("_groups")), sizes, by, "left").withColumn("_all", F.coalesce("_all", F.lit(0)))
    kinds = table(kinds, "pool-kinds")
    tasks = min(-(-kinds.count() // POOL_KINDS) or 1, 10_000)  # few bytes make many draws, so their number tells how to deal them
    wide = lambda size: F.greatest(F.lit(POOL_RANKS), F.ceil(size / POOL_PARTS)).cast("long")
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(*by).schema.fields)
    number = asked.schema["needed"].dataType.simpleString()

    def draw(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                key = tuple(row[c] for c in by)
                n = min(int(row["needed"]), int(row["_all"]))
                if n > 0:
                    u = np.random.default_rng(seed_of(seed, *key, int(row["needed"]))).random(draws)
                    ranks, times = np.unique(best_ranks(int(row["_all"]), n, u), return_counts=True)
                    out += [(*key, row["needed"], int(row["_all"]), int(r) - 1, int(t)) for r, t in zip(ranks, times, strict=True)]
            yield pd.DataFrame(out, columns=[*by, "needed", "_all", "_at", "_times"])

    drawn = kinds.repartition(tasks, *by, "needed").mapInPandas(draw, f"{keys}, needed {number}, _all long, _at long, _times long").withColumn("_run", F.floor(F.col("_at") / wide(F.col("_all"))))
    placed = matched(preceding(counted, by, [F.col("_v")], F.col("_c")), sizes, by)
    width = wide(F.col("_all"))
    runs = placed.select(*by, "_v", "_before", "_c", F.explode(F.sequence(F.floor(F.col("_before") / width), F.floor((F.col("_before") + F.col("_c") - 1) / width))).alias("_run"))
    named = runs.withColumnsRenamed({c: f"_of_{c}" for c in [*by, "_run"]})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*by, "_run"]])
    inside = (F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_c"))
    best = drawn.join(named, same & inside).groupBy(*by, "needed", "_v").agg(F.sum("_times").alias("_times"))
    parts = kinds.select(*by, "needed", F.ceil(F.col("_groups") / POOL_GROUPS).cast("int").alias("_parts"))
    dealt = matched(asked, parts, [*by, "needed"]).withColumn("_part", F.pmod(F.xxhash64("group"), F.col("_parts")).cast("int")).drop("_parts")
    spread = matched(best, parts, [*by, "needed"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    together = [*by, "needed", "_part"]

    def test(key: tuple, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        v, times = (found["_v"].to_numpy(), found["_times"].to_numpy()) if len(found) else (np.array([-np.inf]), np.array([draws]))
        out = []
        for name, baseline, observed in rows[["group", "baseline", "observed"]].itertuples(index=False):
            gains = np.maximum(v - baseline, 0.0)
            out.append((*key[: len(by)], name, float((gains * times).sum() / draws), float(gains.max()), (int(times[gains >= observed].sum()) + 1) / (draws + 1)))
        return pd.DataFrame(out, columns=[*by, "group", "null_mean", "null_max", "p"])

    kind = asked.schema["group"].dataType.simpleString()
    return dealt.groupBy(*together).cogroup(spread.groupBy(*together)).applyInPandas(test, f"{keys}, `group` {kind}, null_mean double, null_max double, p double")


def null_monte_carlo(pools: DataFrame, draws: int = REPLICATES, seed: int = 7) -> DataFrame:
    """pooled_nulls of groups with a pool each (group, needed int, pool array<double>, baseline double, observed double)."""
    kept = table(pools.withColumn("_pool", F.col("group")), "pools")
    values = kept.select("_pool", F.explode("pool").alias("value"))
    return pooled_nulls(values, kept.drop("pool"), ["_pool"], draws, seed).drop("_pool")


def padding_report(lengths: DataFrame, batch: int, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """batches, tokens, padded and overhead when rows (column length) are dealt to batches within each group, in an order without ties."""
    by = by or []
    placed = preceding(lengths, by, order, F.lit(1))
    batched = placed.withColumn("_batch", F.floor(F.col("_before") / batch)).groupBy(*by, "_batch").agg(F.sum("length").alias("t"), (F.max("length") * F.count("*")).alias("p"))
    total = batched.groupBy(*by).agg(F.count("*").alias("batches"), F.sum("t").alias("tokens"), F.sum("p").alias("padded"))
    return total.withColumn("overhead", F.round(1 - F.col("tokens") / F.col("padded"), DECIMALS))


def unknown_report(tokens: DataFrame, vocabulary: DataFrame, by: list[str], token: str = "token") -> DataFrame:
    """by, tokens, unknown (tokens outside the vocabulary, one row a token) and share. Tokens are counted before they meet it."""
    counts = tokens.groupBy(*by, token).agg(F.count("*").alias("n"))
    known = vocabulary.select(token).distinct().withColumn("_known", F.lit(1))
    g = counts.join(known, token, "left").groupBy(*by)
    sums = g.agg(F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0)).alias("unknown"))
    return sums.withColumn("share", F.round(F.col("unknown") / F.col("tokens"), DECIMALS))


def length_comparison(lengths: DataFrame, arm: str, left: str, right: str, by: list[str]) -> DataFrame:
    """by, left and right (mean lengths of both arms), delta, ratio and reduction (the share that right saves); lengths: column length."""
    g = lengths.groupBy(*by).agg(F.avg(F.when(F.col(arm) == left, F.col("length"))).alias("l"), F.avg(F.when(F.col(arm) == right, F.col("length"))).alias("r"))
    r = lambda c: F.round(c, DECIMALS)
    ratio = F.try_divide(F.col("r"), F.col("l"))
    return g.select(*by, r(F.col("l")).alias("left"), r(F.col("r")).alias("right"), r(F.col("r") - F.col("l")).alias("delta"), r(ratio).alias("ratio"), r(1 - ratio).alias("reduction"))


def paired_interval(pairs: DataFrame, cluster: str, by: list[str], draws: int = REPLICATES, seed: int = 7) -> DataFrame:
    """by, n, mean, low and high of paired's delta; clusters of units are drawn together."""
    sums = cluster_sums(pairs, cluster, ["delta"], by)
    n = pairs.groupBy(*by).agg(F.count("*").alias("n"))
    return matched(n, cluster_bootstrap(sums, cluster, ["delta"], by, draws, seed).drop("metric"), by)


def histogram(df: DataFrame, length: str, most: int, width: int) -> DataFrame:
    """from_length and n of the buckets of lengths 1 to most, empty ones included; longer ones count in the last."""
    buckets = df.sparkSession.range(0, -(-most // width)).select((F.col("id") * width + 1).alias("from_length"))
    held = F.greatest(F.lit(1), F.least(F.col(length), F.lit(most)))
    counts = df.groupBy((F.floor((held - 1) / width) * width + 1).alias("from_length")).agg(F.count("*").alias("n"))
    return buckets.join(counts, "from_length", "left").select("from_length", F.coalesce("n", F.lit(0)).alias("n"))


def f1_bootstrap(counts: DataFrame, cluster: str, by: list[str], draws: int = REPLICATES, seed: int = 7) -> DataFrame:
    """by, f1, low and high: micro F1 of clusters' tp, fp and fn, worked out anew from each draw's pooled counts."""
    f1 = 2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1e-300))
    found = counts.groupBy(*by).agg(*[F.sum(c).cast("double").alias(c) for c in ("tp", "fp", "fn")]).select(*by, f1.alias("f1"))
    return found.join(interval(drawn_sums(counts, cluster, ["tp", "fp", "fn"], by, draws, seed), f1, by), by)
