"""Comparisons over evaluated inputs: strata, groups of turns, choices between models, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import table
from . import statistics

DECIMALS = 9


def r(c: Column) -> Column:
    return F.round(c, DECIMALS)


def with_switch_flag(turns: DataFrame, topic: str, conversation: str, order: str) -> DataFrame:
    """Adds switched: 1 where the topic differs from that of the turn before, 0 in a first turn. A missing topic raises."""
    known = F.when(F.col(topic).isNull(), F.raise_error(F.lit("a turn without a topic")).cast("string")).otherwise(F.col(topic).cast("string"))
    before = F.lag(known).over(Window.partitionBy(conversation).orderBy(order))
    return turns.withColumn("switched", F.coalesce((known != before).cast("int"), F.lit(0)))


def by_group(values: DataFrame, group: str, arm: str, value: str, unit: list[str], reference: str) -> DataFrame:
    """group, arm, n, mean, and delta: the mean difference to the reference arm over the units of the group, which all arms must have."""
    wide = values.groupBy(group, *unit).pivot(arm).agg(F.first(value))
    arms = [c for c in wide.columns if c not in (group, *unit)]
    whole = wide.withColumn("_gap", F.when(F.greatest(*[F.col(f"`{a}`").isNull().cast("int") for a in arms], F.lit(0)) == 1, F.raise_error(F.lit("a unit lacks an arm")).cast("int")).otherwise(F.lit(0)))
    each = whole.select(group, "_gap", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"`{a}`").alias("v"), (F.col(f"`{a}`") - F.col(f"`{reference}`")).alias("d")) for a in arms])).alias("x"))
    return each.groupBy(group, F.col("x.arm").alias("arm")).agg(F.count("*").alias("n"), r(F.avg("x.v")).alias("mean"), r(F.avg("x.d")).alias("delta"), F.max("_gap").alias("_gap")).drop("_gap")


def strata(values: DataFrame, stratum: str, value: str, by: list[str]) -> DataFrame:
    """n, share of the rows of `by`, mean, and a normal 95 % interval of each stratum."""
    g = values.groupBy(*by, stratum).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    half = 1.96 * F.sqrt(F.col("v") / F.col("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))  # a row for each stratum
    return g.select(*by, stratum, "n", r(share).alias("share"), r(F.col("m")).alias("mean"), r(F.col("m") - half).alias("low"), r(F.col("m") + half).alias("high"))


def granularities(lengths: DataFrame, reference: str) -> DataFrame:
    """granularity, budget, n, mean length, and how much shorter than the reference it is, in tokens and as a share; lengths: sample_id,
    granularity, budget, length. A sample that lacks a granularity raises."""
    g = lengths.groupBy("granularity", "budget").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    base = g.where(F.col("granularity") == reference).select("budget", F.col("n").alias("_n"), F.col("mean").alias("_mean"))
    both = g.join(F.broadcast(base), "budget")  # a row for each budget
    same = F.when(F.col("n") != F.col("_n"), F.raise_error(F.lit("a sample lacks a granularity")).cast("long")).otherwise(F.col("n"))
    return both.select("granularity", "budget", same.alias("n"), r(F.col("mean")).alias("mean"), r(F.col("mean") - F.col("_mean")).alias("delta"), r(F.try_divide(F.col("mean") - F.col("_mean"), F.col("_mean"))).alias("change"))


def chosen_model(arms: DataFrame, orders: dict[str, list[str]]) -> DataFrame:
    """The one admissible arm of the highest mrr whose interval's low end is above 0; ties go to the smaller budget, then by the given
    order of values of each further column. No row if none qualifies. arms: mrr, low, budget, admissible and those columns."""
    place = lambda c, values: F.array_position(F.array(*map(F.lit, values)), F.col(c))
    fit = arms.where(F.col("admissible") & (F.col("low") > 0))
    return fit.orderBy(F.col("mrr").desc(), "budget", *[place(c, v) for c, v in orders.items()]).limit(1)


def gate_passed(choice: DataFrame, least: float) -> bool:
    """Whether there is a choice and its mrr reaches the gate."""
    return bool(choice.where(F.col("mrr") >= least).head(1))


def trajectory(values: DataFrame, epoch: str, arm: str, value: str, unit: list[str]) -> DataFrame:
    """epoch, arm, n, mean, and gain: the mean difference of the same units to the arm's first epoch."""
    first = values.groupBy(arm).agg(F.min(epoch).alias(epoch))
    base = values.join(F.broadcast(first), [arm, epoch]).select(arm, *unit, F.col(value).alias("_base"))  # first: a row for each arm
    g = values.join(base, [arm, *unit], "left").groupBy(epoch, arm)
    return g.agg(F.count("*").alias("n"), r(F.avg(value)).alias("mean"), r(F.avg(F.col(value) - F.col("_base"))).alias("gain"))


def segment_report(segments: DataFrame) -> DataFrame:
    """Of each split, segment_type and budget: count, least, mean and most raw and included tokens, mean and most utilisation, and the
    shares of segments cut by their bucket and by the whole input. segments: raw, in_bucket and included tokens."""
    used = F.col("in_bucket") / F.col("budget")
    spans = [agg(c).alias(f"{c}_{name}") if name != "mean" else r(agg(c)).alias(f"{c}_mean") for c in ("raw", "included") for name, agg in (("least", F.min), ("mean", F.avg), ("most", F.max))]
    cut = lambda a, b: r(F.avg((F.col(a) > F.col(b)).cast("int")))
    return segments.groupBy("split", "segment_type", "budget").agg(F.count("*").alias("count"), *spans, r(F.avg(used)).alias("used_mean"), r(F.max(used)).alias("used_most"), cut("raw", "in_bucket").alias("bucket_cut"), cut("in_bucket", "included").alias("input_cut"))


def hit_patterns_of(fused: DataFrame, gold: DataFrame, lists: list[str], k: int = 10) -> DataFrame:
    """pattern and n: by which of the named lists (columns list, query_id, rank, docid) each query's gold is found, joined by `+`, or neither."""
    found = fused.where(F.col("rank") <= k).join(gold, ["query_id", "docid"], "left_semi").groupBy("query_id").agg(F.collect_set("list").alias("have"))
    named = F.array_join(F.filter(F.array(*map(F.lit, lists)), lambda x: F.array_contains("have", x)), "+")
    each = gold.select("query_id").distinct().join(found, "query_id", "left").select(F.when(F.col("have").isNull(), "neither").otherwise(named).alias("pattern"))
    return each.groupBy("pattern").agg(F.count("*").alias("n"))


def endpoint_pairs(values: DataFrame, comparisons: dict[str, tuple[str, str]], endpoints: dict[str, int], route: str, unit: str, value: str, complete: bool = True) -> DataFrame:
    """comparison, route, unit, left, right and delta (left less right) of the units of both systems of each comparison, each system at its
    endpoint. values: system, epoch, route, unit and value. A unit that a system has twice at its endpoint raises, as does one that only one system of a
    comparison has, unless not complete: then it goes. Null values count as missing."""
    at = reduce(lambda x, y: x | y, [(F.col("system") == s) & (F.col("epoch") == e) for s, e in endpoints.items()])
    ends = values.where(at & F.col(value).isNotNull()).select("system", route, unit, F.col(value).cast("double").alias("_v"))
    ends = table(ends.groupBy("system", route, unit).agg(F.count("*").alias("_n"), F.max("_v").alias("_v")), "endpoints")
    if twice := ends.where("_n > 1").head(1):
        raise ValueError(f"{twice[0].system} has {twice[0][unit]} twice")
    wide = ends.groupBy(route, unit).pivot("system", list(endpoints)).agg(F.first("_v"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("comparison"), F.col(f"`{left}`").alias("left"), F.col(f"`{right}`").alias("right")) for name, (left, right) in comparisons.items()]))
    pairs = wide.select(route, unit, each.alias("x")).select("x.comparison", route, unit, "x.left", "x.right")
    if complete and (odd := pairs.where(F.col("left").isNull() != F.col("right").isNull()).head(1)):
        raise ValueError(f"{odd[0][unit]} lacks a side of {odd[0].comparison}")
    return pairs.where("left is not null and right is not null").withColumn("delta", F.col("left") - F.col("right"))


def contrast_summary(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, mean left and right, delta, and how many units are better, worse and equal on the left."""
    sign = lambda test: F.count_if(test).alias
    d = F.col("delta")
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), r(F.avg("left")).alias("left"), r(F.avg("right")).alias("right"), r(F.avg("delta")).alias("delta"), sign(d > 0)("better"), sign(d < 0)("worse"), sign(d == 0)("equal"))


def endpoint_contrasts(pairs: DataFrame, route: str, unit: str, draws: int = statistics.REPLICATES, seed: int = 7) -> DataFrame:
    """contrast_summary of endpoint_pairs by comparison and route with low and high, the 95 % interval of delta: units are drawn one by one."""
    by = ["comparison", route]
    pairs = table(pairs, "endpoint-pairs")
    ends = statistics.singleton_bootstrap(pairs, unit, ["delta"], by, draws, seed).select(*by, r(F.col("low")).alias("low"), r(F.col("high")).alias("high"))
    return statistics.matched(contrast_summary(pairs, by), ends, by)


def design_contrasts(values: DataFrame, cells: list[str], comparisons: dict[str, tuple[str, str]], unit: list[str], cluster: str, by: list[str], draws: int = statistics.REPLICATES, seed: int = 7) -> DataFrame:
    """by, comparison, n, left, right, delta, low and high: means of two cells of a complete design and the interval of their difference.

    values: by, unit, cluster, cell and value. All cells and comparisons of a group come from the same draws of clusters. A unit without one of the cells, or
    with one twice, raises.
    """
    counted = table(values.groupBy(*by, *unit, cluster).pivot("cell", cells).agg(F.max("value").cast("double").alias("v"), F.count("value").alias("n")), "design")
    if odd := counted.where(reduce(lambda x, y: x | y, [F.coalesce(F.col(f"`{c}_n`"), F.lit(0)) != 1 for c in cells])).head(1):
        raise ValueError(f"the design is not complete: {[odd[0][u] for u in unit]}")
    names = {c: f"c{n}" for n, c in enumerate(cells)}
    wide = counted.select(*by, *unit, cluster, *[F.col(f"`{c}_v`").alias(n) for c, n in names.items()])
    sums = table(statistics.cluster_sums(wide, cluster, list(names.values()), by), "design-sums")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("comparison"), (F.col(names[a]) / F.col("rows")).alias("left"), (F.col(names[b]) / F.col("rows")).alias("right")) for k, (a, b) in comparisons.items()])).alias("x")
    drawn = statistics.drawn_sums(sums, cluster, ["rows", *names.values()], by, draws, seed).select(*by, each).select(*by, "x.*")
    ends = statistics.interval(drawn, F.col("left") - F.col("right"), [*by, "comparison"])
    whole = sums.groupBy(*by).agg(F.sum("rows").alias("rows"), *[F.sum(n).alias(n) for n in names.values()])
    means = whole.select(*by, F.col("rows").alias("n"), each).select(*by, "n", "x.*")
    found = statistics.matched(means, ends, [*by, "comparison"])
    return found.select(*by, "comparison", "n", r(F.col("left")).alias("left"), r(F.col("right")).alias("right"), r(F.col("left") - F.col("right")).alias("delta"), r(F.col("low")).alias("low"), r(F.col("high")).alias("high"))
