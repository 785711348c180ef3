"""Samples and splits of conversations and rows, by hashes, so that they repeat."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import table
from .statistics import preceding


def salted(salt: str, *parts: str) -> Column:
    """A hex digest that orders rows the same way in each run."""
    return F.sha1(F.concat_ws(":", F.lit(salt), *[F.col(p).cast("string") for p in parts]))


def stratified(df: DataFrame, stratum: str, unit: str, n: int, salt: str) -> DataFrame:
    """The n units of each stratum of the least digests; all where there are fewer."""
    order = Window.partitionBy(stratum).orderBy(salted(salt, unit), F.col(unit))
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def fraction(units: DataFrame, unit: str, share: float, salt: str, stratum: str | None = None) -> DataFrame:
    """units with split `first` for the ceil(share n) of each stratum (or of all) of the least digests, `rest` for the others.

    Without a stratum the units are ranked within ranges of their digests, whose sizes are summed first.
    """
    keyed = units.withColumn("_d", salted(salt, unit))
    if stratum:
        w = Window.partitionBy(stratum)
        place, total = F.row_number().over(w.orderBy("_d", unit)), F.count("*").over(w)
        return keyed.withColumn("split", F.when(place <= F.ceil(total * share), "first").otherwise("rest")).drop("_d")
    keyed = keyed.withColumn("_range", F.conv(F.substring("_d", 1, 3), 16, 10).cast("int"))
    sizes = keyed.groupBy("_range").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 4,096 ranges at most
    ranges = sizes.select("_range", start.alias("_start"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_d", unit)) + F.col("_start")
    return keyed.join(F.broadcast(ranges), "_range").withColumn("split", F.when(place <= F.ceil(F.col("_all") * share), "first").otherwise("rest")).drop("_d", "_range", "_start", "_all")


def exact_subset(sizes: DataFrame, unit: str, size: str, target: int, salt: str) -> DataFrame:
    """Rows of whole units whose sizes sum to the target exactly; raises if there are none such. A unit's size is 1 at least.

    Units are gone through in the order of their digests, and the set is the one that this order reaches first: it ends with the first unit
    u with which any set of the units so far has the target's sum, and before u comes the set that is reached first for what then is
    missing. So a run of the first units is kept less some units, which make up the run's excess over the target: from u back, each unit
    goes that leaves an excess the units before it can make up. The excess is nearly always below the largest size, so that the driver
    sees the first few units of each size up to there and the runs' sums about the target; the window of runs widens until one serves.
    """
    if target < 0:
        raise ValueError("the target can't be negative")
    if odd := sizes.where((F.col(size) < 1) | F.col(size).isNull()).head(1):
        raise ValueError(f"{odd[0][unit]} has no rows")
    if not target:
        return sizes.limit(0)
    placed = table(preceding(sizes.select(unit, F.col(size).cast("long").alias("_s"), salted(salt, unit).alias("_d")), [], [F.col("_d"), F.col(unit)], F.col("_s")), "runs")
    total, largest = placed.agg(F.sum("_s"), F.max("_s")).first()
    if total is None or total < target:
        raise ValueError(f"no set of whole units has {target} rows")
    most = min(total - target, largest)
    while True:
        made = _made_up(placed, most)
        ends = placed.withColumn("_end", F.col("_before") + F.col("_s")).where((F.col("_end") >= target) & (F.col("_end") <= target + most)).select("_end", "_before").orderBy("_end")
        for end, before in ends.toLocalIterator():
            if made.get(end - target, before + 1) <= before:
                kept = placed.where(F.col("_before") < end)
                out = _left_out(placed, unit, end - target, before, made)
                return sizes.join((kept.where(~F.col(unit).isin(out)) if out else kept).select(unit), unit, "left_semi")
        if most == total - target:
            raise ValueError(f"no set of whole units has {target} rows")
        most = min(total - target, 2 * most)


def _made_up(placed: DataFrame, most: int) -> dict[int, int]:
    """Of each sum up to `most` that whole units make up: where the last of the first units that do so ends. Of each size only the first
    most / size units can be needed."""
    order = Window.partitionBy("_s").orderBy("_before")
    early = placed.where(F.col("_s") <= most).withColumn("_n", F.row_number().over(order)).where(F.col("_n") * F.col("_s") <= most)
    made = {0: 0}
    for size, before in early.orderBy("_before").select("_s", "_before").toLocalIterator():
        for at in [t for t in made if t + size <= most and t + size not in made]:
            made[at + size] = before + size
    return made


def _left_out(placed: DataFrame, unit: str, excess: int, before: int, made: dict[int, int]) -> list:
    """The units before the place `before` that go, from there backward, until the excess is gone."""
    out = []
    if not excess:
        return out
    nearest = placed.where((F.col("_before") < before) & (F.col("_s") <= excess)).orderBy(F.desc("_before")).select(unit, "_s", "_before")
    for name, size, start in nearest.toLocalIterator():
        if size <= excess and made.get(excess - size, start + 1) <= start:
            out.append(name)
            excess -= size
        if not excess:
            break
    return out


def depth_balanced(samples: DataFrame, bins: list[str], each: int, salt: str, strict: bool = True) -> DataFrame:
    """`each` samples (sample_id, conv_id, depth, bin) of each bin in the order given, one of each conversation over all bins, with exact depths balanced: the
    next comes from the depth chosen least so far, of several from the one with the fewest conversations left, then the deepest; of that
    depth first from the conversation whose deepest sample in the bin is the shallowest, then by digest. A bin with fewer
    conversations left raises, or, unless strict, gives what it has.

    The choice is sequential by nature, but can't go beyond the first conversations of each bin and exact depth, as many as are chosen in
    all. Only those, their rows of other depths and the sizes of the depths reach the one group that chooses: at most (depths ** 2 *
    each * bins ** 2) rows, whatever the input.
    """
    most = each * len(bins)
    digest = salted(salt, "bin", "depth", "conv_id", "sample_id")
    d = samples.where(F.col("bin").isin(bins)).select("sample_id", F.col("conv_id").cast("string").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "bin").withColumn("_d", digest)
    one = d.groupBy("bin", "conv_id", "depth").agg(F.min(F.struct("_d", "sample_id")).alias("_first"))
    deepest = d.groupBy("bin", "conv_id").agg(F.max("depth").alias("_most"))
    rows = table(one.join(deepest, ["bin", "conv_id"]).select("bin", "conv_id", "depth", "_most", "_first._d", "_first.sample_id"), "depths")
    order = Window.partitionBy("bin", "depth").orderBy("_most", "_d", "conv_id", "sample_id")
    first = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    known = rows.join(first.select("conv_id").distinct(), "conv_id", "left_semi").withColumn("_size", F.lit(None).cast("long"))
    sizes = rows.groupBy("bin", "depth").agg(F.count("*").alias("_size"))
    counts = {r[0]: r[1] for r in rows.groupBy("bin").agg(F.count_distinct("conv_id")).collect()}  # a row a bin
    if strict and (few := [b for b in bins if counts.get(b, 0) < each]):
        raise ValueError(f"bins with fewer than {each} conversations: {few}")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for name in bins:
            of_bin = rows[rows["bin"] == name]
            left = {int(d): int(n) for d, n in of_bin[of_bin["_size"].notna()][["depth", "_size"]].itertuples(index=False)}
            held = of_bin[of_bin["_size"].isna()].sort_values(["_most", "_d", "conv_id", "sample_id"])
            at: dict[int, list] = {d: [] for d in left}
            depths: dict[str, list] = {}
            for conv, depth, sample in held[["conv_id", "depth", "sample_id"]].itertuples(index=False):
                at[int(depth)].append((conv, sample))
                depths.setdefault(conv, []).append(int(depth))
            for conv in used:
                for depth in depths.get(conv, ()):
                    left[depth] -= 1
            taken = dict.fromkeys(left, 0)
            for place in range(each):
                if not (can := [d for d, n in left.items() if n]):
                    if strict:
                        raise ValueError(f"{name} has no further conversations")
                    break
                depth = min(can, key=lambda d: (taken[d], left[d], -d))
                conv, sample = next(r for r in at[depth] if r[0] not in used)
                taken[depth] += 1
                for other in depths[conv]:
                    left[other] -= 1
                used.add(conv)
                out.append((sample, conv, depth, name, place + 1))
        return pd.DataFrame(out, columns=["sample_id", "conv_id", "depth", "bin", "place"])

    needed = known.unionByName(sizes, allowMissingColumns=True)
    return needed.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(choose, "sample_id string, conv_id string, depth long, bin string, place int")


def bundle(samples: DataFrame, bins: list[str], each: int, exact: dict[str, int], salt: str, strict: bool = True) -> DataFrame:
    """sample_id, conv_id and split: `gate` for the samples that depth_balanced chooses of `samples` (sample_id, conv_id, depth, bin); of the conversations that
    the gate leaves, whole ones with exactly so many samples for each name in `exact`, in that order and each from what those before left;
    `rest` for the others. The other samples of a gate's conversation have split `none`, so no conversation is in two splits.

    Raises where the gate, or an exact size, can't be reached.
    """
    rows = table(samples.select("sample_id", F.col("conv_id").cast("string").alias("conv_id"), "depth", "bin"), "bundle-samples")
    gate = table(depth_balanced(rows, bins, each, f"{salt}:gate", strict).select("sample_id", "conv_id"), "bundle-gate")
    left = table(rows.join(gate.select("conv_id").distinct(), "conv_id", "left_anti").groupBy("conv_id").agg(F.count("*").alias("_n")), "bundle-left")
    named = None
    for name, size in exact.items():
        part = table(exact_subset(left, "conv_id", "_n", size, f"{salt}:{name}").select("conv_id", F.lit(name).alias("split")), "bundle-part")
        left = table(left.join(part, "conv_id", "left_anti"), "bundle-left")
        named = part if named is None else named.unionByName(part)
    others = left.select("conv_id", F.lit("rest").alias("split"))
    by_conv = others if named is None else named.unionByName(others)
    chosen = rows.select("sample_id", "conv_id").join(by_conv, "conv_id", "left").join(gate.select("sample_id", F.lit(True).alias("_gate")), "sample_id", "left")
    return chosen.select("sample_id", "conv_id", F.when(F.col("_gate"), "gate").otherwise(F.coalesce("split", F.lit("none"))).alias("split"))
