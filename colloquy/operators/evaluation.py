"""Candidates scored by what retrieval finds for their rewrites, and what chance would have found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.stores import RewriteChain
from . import conversation, metrics


def candidate_inputs(masks: DataFrame, samples: DataFrame) -> DataFrame:
    """sample_id, mask and text of each distinct candidate: the question and then the kept turns' questions and answers, oldest first.
    samples: sample_id, question, history."""
    kept = F.flatten(F.transform(conversation.masked("history", "mask"), lambda t: F.array(F.coalesce(t["question"], F.lit("")), F.coalesce(t["answer"], F.lit("")))))
    text = F.array_join(F.concat(F.array(F.coalesce("question", F.lit(""))), kept), " ")
    return masks.select("sample_id", "mask").distinct().join(samples.select("sample_id", "question", "history"), "sample_id").select("sample_id", "mask", text.alias("text"))


def term_rewrite(inputs: DataFrame, most: int = 24) -> DataFrame:
    """A rewriter without a model: an input's distinct lexical terms in order, `most` at most."""
    return inputs.select("input_key", F.array_join(F.slice(T.lexical_terms(F.col("text")), 1, most), " ").alias("rewrite"))


def scored_candidates(masks: DataFrame, samples: DataFrame, gold: DataFrame, chain: RewriteChain, rewrite: Callable, model: str, search: Callable, index: str, k: int, batch: str) -> tuple[DataFrame, DataFrame]:
    """(sample_id, mask, rewrite, target_rank, MRR and R_k of each distinct candidate, counts of the chain).

    masks: sample_id, mask; gold: query_id (a sample's id), docid, or shared sets that samples name (gold_set). Masks become inputs, distinct inputs rewrites and distinct rewrites
    rankings, through the chain's stores; a ranking is then held against each sample's gold whose candidates led to it. Candidates whose
    rewrite has no words, and samples without gold, score 0.
    """
    inputs = candidate_inputs(masks, samples).withColumn("request_id", F.concat_ws("|", "sample_id", "mask"))
    named, hits, counts = chain.run(inputs.select("request_id", "text"), rewrite, model, search, index, k, batch)
    about = inputs.select("request_id", "sample_id", "mask").join(named, "request_id")
    pairs = about.select("sample_id", "ranking_key").distinct().where("ranking_key is not null").withColumn("pair", F.concat_ws("|", "sample_id", "ranking_key"))
    asked = pairs.select(F.col("pair").alias("query_id"), "sample_id", "ranking_key")
    shared = metrics.SET in gold.columns
    if not shared:
        gold = gold.select(F.col("query_id").alias(metrics.SET), "docid")
        asked = asked.withColumn(metrics.SET, F.col("sample_id"))
    else:
        asked = asked.join(samples.select("sample_id", metrics.SET), "sample_id")
    wanted = gold.select(metrics.SET, F.col("docid").cast("string").alias("docid")).distinct()
    sizes = asked.join(wanted.groupBy(metrics.SET).agg(F.count("*").alias("n_gold")), metrics.SET).select("query_id", "n_gold")
    if shared:  # a ranking's hits meet the sets before they meet the candidates, so that only gold is fanned out
        found = asked.join(hits.join(wanted, "docid"), ["ranking_key", metrics.SET])
    else:
        found = asked.join(hits, "ranking_key").join(wanted, [metrics.SET, "docid"])
    found = found.select("query_id", "rank", "docid")
    each = metrics.scored(asked, sizes, found, [k]).join(asked.drop(metrics.SET), "query_id")
    scores = about.join(each, ["sample_id", "ranking_key"], "left").na.fill({"MRR": 0.0, f"R_{k}": 0.0})
    return scores.select("sample_id", "mask", "rewrite", "target_rank", "MRR", f"R_{k}"), counts


def kept_turns(mask: Column) -> Column:
    return F.when(mask == "[]", 0).otherwise(F.length(F.replace(mask, F.lit("0"), F.lit(""))))


def generator_needs(rows: DataFrame, scores: DataFrame, most: int, least: int, buffer: int) -> DataFrame:
    """sample_id, family, pool, required and desired: for each number of kept turns, how many distinct rewrites a generator family has (each at the
    least number that gives it), and how many controls should stand against them: `buffer` more and `least` at least, up to `most` masks
    of so many turns. rows: sample_id, depth, mask, role, family; scores: sample_id, mask, rewrite."""
    mine = rows.where("role = 'generator'").select("sample_id", "depth", "family", "mask").distinct().join(scores.select("sample_id", "mask", "rewrite"), ["sample_id", "mask"])
    first = mine.withColumn("pool", kept_turns(F.col("mask"))).groupBy("sample_id", "depth", "family", "rewrite").agg(F.min("pool").alias("pool"))
    counted = first.groupBy("sample_id", "depth", "family", "pool").agg(F.count("*").cast("int").alias("required"))
    masks = F.aggregate(F.sequence(F.lit(1), F.greatest("pool", F.lit(1))), F.lit(1.0), lambda c, i: F.least(F.lit(float(most)), c * (F.col("depth") - F.col("pool") + i) / i))
    return counted.select("sample_id", "family", "pool", "required", F.least(F.round(masks).cast("int"), F.greatest(F.lit(least), F.col("required") + buffer)).alias("desired"))


def control_items(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """sample_id, pool (kept turns), item (a rewrite) and reward of the control masks; a rewrite has a row for each number of turns that gives it."""
    return rows.where("role = 'control'").select("sample_id", "mask").distinct().join(scores, ["sample_id", "mask"]).select("sample_id", kept_turns(F.col("mask")).alias("pool"), F.col("rewrite").alias("item"), F.col("MRR").alias("reward")).distinct()
