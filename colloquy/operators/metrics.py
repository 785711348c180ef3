"""Retrieval, set and label metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECIMALS = 9
#: A column of queries, and of gold, that names a set of passages which several queries share.
SET = "gold_set"


def judged(queries: DataFrame, hits: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id and n_gold of the queries with gold, the hits that are gold).

    gold: query_id and docid; or gold_set and docid, where queries (query_id, gold_set) share sets. Sets are counted and looked up as they are
    and never repeated for the queries that share them.
    """
    named = gold.withColumn("docid", F.col("docid").cast("string"))
    listed = hits.withColumn("docid", F.col("docid").cast("string"))
    if SET not in gold.columns:
        wanted = named.select("query_id", "docid").distinct()
        return wanted.groupBy("query_id").agg(F.count("*").alias("n_gold")), listed.join(wanted, ["query_id", "docid"])
    of, wanted = queries.select("query_id", SET).distinct(), named.select(SET, "docid").distinct()
    sizes = of.join(wanted.groupBy(SET).agg(F.count("*").alias("n_gold")), SET).select("query_id", "n_gold")
    return sizes, listed.join(of, "query_id").join(wanted, [SET, "docid"]).drop(SET)


def per_query(queries: DataFrame, hits: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """query_id, n_gold, target_rank, MRR, and R@k and nDCG@k (as R_k, nDCG_k) of every query (query_id).

    hits (query_id, rank, docid), gold (query_id, docid, or shared sets as in judged). Misses, and queries without hits or gold, count with zeros. A
    docid repeated in the hits counts once for recall and each time for nDCG.
    """
    return scored(queries, *judged(queries, hits.select("query_id", "rank", "docid"), gold), ks)


def scored(queries: DataFrame, sizes: DataFrame, found: DataFrame, ks: list[int]) -> DataFrame:
    """per_query from the sizes of gold (query_id, n_gold) and the hits that are gold (query_id, rank, docid)."""
    if not ks or min(ks) < 1:
        raise ValueError("cutoffs must be positive")
    aggs: list[Column] = [F.min("rank").alias("target_rank")]
    for k in sorted(set(ks)):
        inside = F.col("rank") <= k
        aggs += [F.count_distinct(F.when(inside, F.col("docid"))).alias(f"_found_{k}"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"_gain_{k}")]
    rows = queries.select("query_id").distinct().join(sizes, "query_id", "left").join(found.groupBy("query_id").agg(*aggs), "query_id", "left")
    out = [F.col("query_id"), F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.col("target_rank"), F.round(F.coalesce(1 / F.col("target_rank"), F.lit(0.0)), DECIMALS).alias("MRR")]
    for k in sorted(set(ks)):
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        out += [F.round(F.coalesce(F.col(f"_found_{k}") / F.col("n_gold"), F.lit(0.0)), DECIMALS).alias(f"R_{k}"), F.round(F.coalesce(F.col(f"_gain_{k}") / ideal, F.lit(0.0)), DECIMALS).alias(f"nDCG_{k}")]
    return rows.select(*out)


def aggregate(metrics: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """A row for each group and metric: metric, n (non-null), mean and variance (0 for a single value)."""
    stacked = metrics.unpivot(by or [], names, "metric", "value")
    return stacked.groupBy(*(by or []), "metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), DECIMALS).alias("mean"), F.round(F.coalesce(F.var_samp("value"), F.lit(0.0)), DECIMALS).alias("variance"))


def union_recall(gold: DataFrame, left: DataFrame, right: DataFrame, ks: list[int], queries: DataFrame | None = None) -> DataFrame:
    """Of each gold pair (query_id, docid) and cutoff: which of two lists holds it. cutoff, category (both, left_only, right_only,
    neither), pairs and share; every category of every cutoff has a row. Where gold is shared sets, queries (query_id, gold_set) name them.
    Pairs that neither list holds are counted by what is left of the sets' sizes."""
    sides = [judged(queries, hits, gold) for hits in (left, right)]
    ranks = [found.groupBy("query_id", "docid").agg(F.min("rank").alias(side)) for side, (_, found) in zip(("left", "right"), sides, strict=True)]
    cut = ranks[0].join(ranks[1], ["query_id", "docid"], "full").withColumn("cutoff", F.explode(F.array(*[F.lit(k) for k in ks])))
    a, b = (F.coalesce(F.col(s) <= F.col("cutoff"), F.lit(False)) for s in ("left", "right"))
    counted = cut.groupBy("cutoff").agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only"))
    total = sides[0][0].agg(F.sum("n_gold").alias("total")).where("total > 0").withColumn("cutoff", F.explode(F.array(*[F.lit(k) for k in ks])))
    every = total.join(counted, "cutoff", "left").na.fill(0).withColumn("neither", F.col("total") - F.col("both") - F.col("left_only") - F.col("right_only"))
    return every.unpivot(["cutoff", "total"], ["both", "left_only", "right_only", "neither"], "category", "pairs").select("cutoff", "category", "pairs", F.round(F.col("pairs") / F.col("total"), DECIMALS).alias("share"))


def hit_patterns(samples: DataFrame, hits: DataFrame, views: list[str]) -> DataFrame:
    """sample_id, pattern: the views (in this order, joined by +) that have a row in hits (sample_id, view); `neither` without any."""
    had = hits.groupBy("sample_id").agg(F.collect_set("view").alias("had"))
    listed = F.array_join(F.filter(F.array(*map(F.lit, views)), lambda v: F.array_contains(F.col("had"), v)), "+")
    return samples.select("sample_id").join(had, "sample_id", "left").select("sample_id", F.when(F.col("had").isNull() | (listed == ""), "neither").otherwise(listed).alias("pattern"))


def divided(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), DECIMALS)


def micro_prf(labelled: DataFrame, outside: object = 0, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and accuracy of columns gold and pred, labels other than `outside` counting as positive."""
    g, p = F.col("gold"), F.col("pred")
    counts = labelled.groupBy(*(by or [])).agg(
        F.count_if((g == p) & (g != outside)).alias("tp"), F.count_if((p != outside) & (g != p)).alias("fp"), F.count_if((g != outside) & (g != p)).alias("fn"), F.count_if(g == p).alias("same"), F.count("*").alias("n")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*(by or []), "tp", "fp", "fn", divided(tp, tp + fp).alias("precision"), divided(tp, tp + fn).alias("recall"), divided(2 * tp, 2 * tp + fp + fn).alias("f1"), divided(F.col("same"), F.col("n")).alias("accuracy"))


def per_class_prf(labelled: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 of each label of columns gold and pred."""
    both = labelled.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), (F.col("gold") == F.col("pred")).cast("int").alias("tp"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.lit(0).alias("tp"), F.lit(1).alias("p")))).alias("x")).select("x.*")
    c = both.groupBy("label").agg(F.sum("g").alias("support"), F.sum("tp").alias("tp"), F.sum("p").alias("predicted"))
    return c.select("label", "support", divided(F.col("tp"), F.col("predicted")).alias("precision"), divided(F.col("tp"), F.col("support")).alias("recall"), divided(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"))


def macro_f1(per_class: DataFrame, outside: list | None = None) -> DataFrame:
    """classes and macro_f1 of per_class_prf's rows: the plain mean of f1 over labels other than those outside."""
    kept = per_class.where(~F.col("label").isin(outside)) if outside else per_class
    return kept.agg(F.count("*").alias("classes"), F.round(F.avg("f1"), DECIMALS).alias("macro_f1"))


def span_prf(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of exactly equal spans, each a row of `keys`."""
    both = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p")).distinct().union(pred.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("p")).distinct())
    each = both.groupBy(*keys).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    c = each.agg(F.count_if(F.expr("g = 1 and p = 1")).alias("tp"), F.count_if(F.col("g") == 0).alias("fp"), F.count_if(F.col("p") == 0).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", divided(tp, tp + fp).alias("precision"), divided(tp, tp + fn).alias("recall"), divided(2 * tp, 2 * tp + fp + fn).alias("f1"))


def balanced_weights(df: DataFrame, label: str, classes: list) -> DataFrame:
    """label, n and weight N / (K n); raises if a class is absent."""
    counts = df.groupBy(label).agg(F.count("*").alias("n")).where(F.col(label).isin(classes))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row for each class
    complete = F.assert_true(F.count("*").over(Window.partitionBy(F.lit(0))) == len(classes), F.lit("a class has no rows"))
    return counts.select(label, "n", F.round(total / (len(classes) * F.col("n")), DECIMALS).alias("weight"), complete.alias("_c")).where("_c is null").drop("_c")


def metric_columns(df: DataFrame) -> list[str]:
    """Columns that hold metrics by their names."""
    return [c for c in df.columns if c == "MRR" or c.startswith(("nDCG@", "nDCG_", "R@", "R_"))]
