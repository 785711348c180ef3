"""Several tag paths of one sample as views of its query: retrieved, fused and compared."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import metrics, ranking
from .retrieval import distinct_queries, fanned_out
from .sampling import uniform
from .spans import sampled_path, viterbi

BEST = "viterbi"


def tag_paths(tokens: DataFrame, moves: list[list[float]], n: int, seed: str) -> DataFrame:
    """sample_id, view, words and tags: the best tag path of each row (`viterbi`) and n drawn from the exact distribution of paths (`sample_1`, ...).

    tokens: sample_id, words, scores (a list of tag scores for each word); rows without words go. Each place of each draw has a number from a
    digest of seed, sample, view and place.
    """
    views = [BEST, *[f"sample_{k}" for k in range(1, n + 1)]]
    rows = tokens.where(F.size("words") > 0).withColumn("view", F.explode(F.array(*map(F.lit, views))))
    numbered = rows.withColumn("_u", F.transform("words", lambda _, t: uniform(F.lit(seed), F.col("sample_id"), F.col("view"), t)))
    between = np.asarray(moves, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tags = []
            for view, scores, numbers in zip(batch["view"], batch["scores"], batch["_u"], strict=True):
                each = np.array([list(s) for s in scores], float)
                tags.append(viterbi(each, between) if view == BEST else sampled_path(each, between, np.asarray(numbers, float)))
            yield batch[["sample_id", "view", "words"]].assign(tags=tags)

    kind = tokens.schema["sample_id"].dataType.simpleString()
    return numbered.select("sample_id", "view", "words", "scores", "_u").mapInPandas(run, f"sample_id {kind}, view string, words array<string>, tags array<int>")


def path_queries(paths: DataFrame) -> DataFrame:
    """query_id, sample_id, view and query: the words that a path keeps; all of them where it keeps none."""
    kept = F.filter(F.zip_with("words", "tags", lambda w, t: F.when(t > 0, w)), lambda w: w.isNotNull())
    query = F.array_join(F.when(F.size(kept) > 0, kept).otherwise(F.col("words")), " ")
    return paths.select(F.concat_ws("|", "sample_id", "view").alias("query_id"), "sample_id", "view", query.alias("query"))


def retrieved_views(queries: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """sample_id, view, rank, docid, score of path_queries; queries of one lowered form, which have the same terms, are searched once."""
    hits = search(distinct_queries(queries, T.lowered_form).select("query_id", F.col("query_norm").alias("query")))
    every = fanned_out(queries.select("query_id", "query"), hits, T.lowered_form)
    return queries.select("query_id", "sample_id", "view").join(every, "query_id").select("sample_id", "view", "rank", "docid", "score")


def fusion_routes(hits: DataFrame, samples: DataFrame, gold: DataFrame, routes: dict[str, list[str]], ks: list[int], k: int) -> DataFrame:
    """sample_id, route and metrics: each route fuses the lists of its views by reciprocal ranks; a single view's list stays as it is.
    samples: sample_id; gold: sample_id, docid, or shared sets that samples name (gold_set)."""
    out = None
    asked, judged = samples.withColumnRenamed("sample_id", "query_id"), gold.withColumnRenamed("sample_id", "query_id")
    for route, views in routes.items():
        mine = hits.where(F.col("view").isin(views))
        lists = mine.select("sample_id", "rank", "docid") if len(views) == 1 else ranking.rrf(mine, k, keys=("sample_id",)).select("sample_id", "rank", "docid")
        part = metrics.per_query(asked, lists.withColumnRenamed("sample_id", "query_id"), judged, ks).withColumn("route", F.lit(route))
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("query_id", "sample_id")


def view_recalls(hits: DataFrame, samples: DataFrame, gold: DataFrame, views: list[str], cutoffs: list[int]) -> DataFrame:
    """cutoff, n, <view>_recall, union_recall and gain (of the union over the best view): the shares of samples of which a view, or any, finds gold."""
    _, held = metrics.judged(samples.withColumnRenamed("sample_id", "query_id"), hits.withColumnRenamed("sample_id", "query_id"), gold.withColumnRenamed("sample_id", "query_id"))
    found = held.withColumnRenamed("query_id", "sample_id").groupBy("sample_id").agg(*[F.min(F.when(F.col("view") == v, F.col("rank"))).alias(v) for v in views])
    each = samples.select("sample_id").distinct().join(found, "sample_id", "left").withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs))))
    has = {v: F.coalesce(F.col(v) <= F.col("cutoff"), F.lit(False)) for v in views}
    any_of = F.greatest(*[h.cast("int") for h in has.values()])
    r = lambda c: F.round(c, metrics.DECIMALS)
    g = each.groupBy("cutoff").agg(F.count("*").alias("n"), *[r(F.avg(h.cast("int"))).alias(f"{v}_recall") for v, h in has.items()], r(F.avg(any_of)).alias("union_recall"))
    return g.withColumn("gain", r(F.col("union_recall") - F.greatest(*[F.col(f"{v}_recall") for v in views])))
