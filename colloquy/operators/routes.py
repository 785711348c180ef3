"""The three routes from a conversation to a query, at a budget of white-space tokens.

I asks with the question and the whole history, R with the question and the selected history, D with the selected history
alone (the question where there is no history). History goes newest first, answers before questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import metrics, ranking, retrieval

ROUTES = ["I", "R", "D"]


def long_words(tokens: Column) -> Column:
    """The default selection: tokens of more than six characters."""
    return F.filter(tokens, lambda t: F.length(t) > 6)


def inputs(with_history: DataFrame, budgets: list[int], select: Callable[[Column], Column] = long_words) -> DataFrame:
    """sample_id, conv_id, depth, route, budget, query and tokens of each sample, route and budget. with_history: columns question and history."""
    said = F.flatten(F.transform(F.reverse("history"), lambda t: F.concat(T.words(t["answer"]), T.words(t["question"]))))
    asked, chosen = T.words(F.col("question")), select(said)
    texts = [F.struct(F.lit(r).alias("route"), t.alias("tokens")) for r, t in (("I", F.concat(asked, said)), ("R", F.concat(asked, chosen)), ("D", F.when(F.size("history") == 0, asked).otherwise(chosen)))]
    rows = with_history.select("sample_id", "conv_id", F.size("history").alias("depth"), F.explode(F.array(*texts)).alias("r")).select("sample_id", "conv_id", "depth", "r.*")
    cut = rows.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).withColumn("tokens", F.slice("tokens", F.lit(1), F.col("budget")))
    return cut.withColumn("query", F.array_join("tokens", " "))


def searched(asked: DataFrame, passages: DataFrame, k: int = 10) -> DataFrame:
    """Hits of inputs (sample_id, route, budget), each distinct query retrieved once."""
    q = asked.withColumn("query_id", F.sha2("query", 256))
    hits = retrieval.bm25(q.groupBy("query_id").agg(F.first("query").alias("query")), passages, k)
    return q.select("sample_id", "conv_id", "depth", "route", "budget", "query_id").join(hits, "query_id")


def evaluated(asked: DataFrame, hits: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Metrics of every input; gold: sample_id, docid, or shared sets that asked names (gold_set)."""
    key = F.concat_ws("|", "sample_id", "route", F.col("budget").cast("string")).alias("query_id")
    q = asked.select(key, "sample_id", "conv_id", "depth", "route", "budget", *[c for c in gold.columns if c == metrics.SET])
    wanted = gold if metrics.SET in gold.columns else q.join(gold, "sample_id").select("query_id", "docid")
    m = metrics.per_query(q, hits.select(key, "rank", "docid"), wanted, ks)
    return m.join(q.drop(metrics.SET), "query_id")


def fused(hits: DataFrame, method: str, k: int = 10) -> DataFrame:
    """The routes of each sample and budget fused by rrf10, rrf60 or minmax_sum."""
    lists, keys = hits.withColumnRenamed("route", "view"), ("sample_id", "budget")
    return ranking.minmax_sum(lists, k, keys) if method == "minmax_sum" else ranking.rrf(lists, k, int(method.removeprefix("rrf")), keys)
