"""Score normalisation, rank fusion and ranked-list operators over hits (query_id, rank, docid, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 10
DECIMALS = 9


def normalised(hits: DataFrame, how: str = "minmax", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds score_norm: minmax (1 where all scores are equal), top (score by the largest; 0 where that is 0) or softmax."""
    w = Window.partitionBy(*keys)
    high, low, s = F.max("score").over(w), F.min("score").over(w), F.col("score")
    if how == "minmax":
        norm = F.when(high > low, (s - low) / (high - low)).otherwise(1.0)
    elif how == "top":
        norm = F.when(high != 0, s / high).otherwise(0.0)
    elif how == "softmax":
        power = F.exp(s - high)
        norm = power / F.sum(power).over(w)
    else:
        raise ValueError(how)
    return hits.withColumn("score_norm", F.round(norm, DECIMALS))


def ranked(scored: DataFrame, k: int | None = None, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds rank by falling score, ties by rising docid as text; the k best, if given."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("docid").cast("string").asc())
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def first_occurrences(hits: DataFrame, k: int | None = None, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Each docid at its first place, places kept as `rank` and closed up as `position`."""
    first = hits.groupBy(*keys, "docid").agg(F.min("rank").alias("rank"))
    out = first.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")))
    return out if k is None else out.where(F.col("position") <= k)


def rrf(lists: DataFrame, k: int | None = None, constant: int = RRF_K, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Reciprocal rank fusion of lists (keys, view, rank, docid): a docid's first rank in each view counts 1 / (constant + rank);
    repeats are passed over but keep their places."""
    first = lists.groupBy(*keys, "view", "docid").agg(F.min("rank").alias("rank"))
    fused = first.groupBy(*keys, "docid").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), DECIMALS).alias("score"))
    return ranked(fused, k, keys)


def minmax_sum(lists: DataFrame, k: int | None = None, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Fusion by the sum of min-max scores over views."""
    norm = normalised(lists, "minmax", (*keys, "view"))
    first = norm.groupBy(*keys, "view", "docid").agg(F.min_by("score_norm", "rank").alias("s"))
    return ranked(first.groupBy(*keys, "docid").agg(F.round(F.sum("s"), DECIMALS).alias("score")), k, keys)


def distinct_views(views: DataFrame, order: list[str]) -> DataFrame:
    """Views (sample_id, view, query_norm) without those whose query an earlier view of the sample asks already."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("view"))
    first = Window.partitionBy("sample_id", "query_norm").orderBy(place)
    return views.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def fused_view_set(views: DataFrame, hits: DataFrame, order: list[str], k: int | None = None) -> DataFrame:
    """sample_id, rank, docid of the views' lists (hits: sample_id, view, rank, docid): one list as it is, several fused by rrf."""
    kept = distinct_views(views, order)
    n = kept.groupBy("sample_id").agg(F.count("*").alias("n_views"))
    lists = hits.join(kept.select("sample_id", "view"), ["sample_id", "view"])
    alone = first_occurrences(lists.join(n.where("n_views = 1"), "sample_id"), k, ("sample_id",)).select("sample_id", F.col("position").alias("rank"), "docid")
    many = rrf(lists.join(n.where("n_views > 1"), "sample_id"), k, keys=("sample_id",)).select("sample_id", "rank", "docid")
    return alone.unionByName(many)


def merged_partials(partials: DataFrame, k: int | None = None) -> DataFrame:
    """One list of each query's partial lists: a docid's largest score counts."""
    best = partials.groupBy("query_id", "docid").agg(F.max("score").alias("score"))
    return ranked(best, k)


def best_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group by an order that ends in a unique column."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def prefixes(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank and docids: the docids up to each of the first k ranks."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.where(F.col("rank") <= k).withColumn("docids", F.collect_list("docid").over(w))


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """query_id, shared: how many docids both lists of a query hold."""
    a, b = (d.select("query_id", "docid").distinct() for d in (left, right))
    return a.join(b, ["query_id", "docid"]).groupBy("query_id").agg(F.count("*").alias("shared"))
