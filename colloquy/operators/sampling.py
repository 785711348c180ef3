"""Seeded sequences from a count model: greedy or drawn under a temperature, the likeliest k and a nucleus.

The model is a table of how often each word follows another. Sequences grow by one word a round, by a join of their last words with
the model; each draw's number is a digest of the seed, the sequence and the place, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import table
from .retrieval import bounded_broadcast

START, END = "<s>", "</s>"


def successions(texts: DataFrame, words: Column) -> DataFrame:
    """before, word and n: how often each word follows another, from START to END of every text that has words."""
    listed = texts.select(words.alias("_w")).where(F.size("_w") > 0).select(F.concat(F.array(F.lit(START)), "_w", F.array(F.lit(END))).alias("_w"))
    pairs = listed.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.struct(F.get("_w", i - 1).alias("before"), F.get("_w", i).alias("word")))).alias("p"))
    return pairs.groupBy("p.before", "p.word").agg(F.count("*").alias("n"))


def choices(model: DataFrame, temperature: float, top_k: int, top_p: float) -> DataFrame:
    """before and options: a list of (upto, word) from the likeliest word down, whose upto are the cumulative probabilities.

    The top_k likeliest words, ties in order of the words, are weighted n ** (1 / temperature), and of them the fewest that together reach top_p stay; a
    temperature of 0 leaves the likeliest alone.
    """
    if temperature < 0 or top_k < 1 or not 0 < top_p <= 1:
        raise ValueError("temperature must be 0 or more, top_k 1 or more, top_p in (0, 1]")
    order = Window.partitionBy("before").orderBy(F.desc("n"), "word")
    first = model.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= (top_k if temperature else 1))
    most = F.max("n").over(Window.partitionBy("before"))
    weight = F.pow(F.col("n") / most, F.lit(1 / temperature)) if temperature else F.lit(1.0)
    weighed = first.withColumn("_w", F.round(weight, 12))
    total = F.sum("_w").over(Window.partitionBy("before"))
    upto = F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = weighed.withColumns({"_upto": upto, "_total": total}).where(F.round(F.col("_upto") - F.col("_w"), 9) < F.round(F.lit(top_p) * F.col("_total"), 9))
    held = F.max("_upto").over(Window.partitionBy("before"))
    scaled = kept.withColumn("upto", F.round(F.col("_upto") / held, 9))
    listed = F.array_sort(F.collect_list(F.struct("_rank", "upto", "word")))  # top_k at most
    return scaled.groupBy("before").agg(F.transform(listed, lambda x: F.struct(x["upto"].alias("upto"), x["word"].alias("word"))).alias("options"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the digest of the parts: its first 48 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def sampled(prompts: DataFrame, options: DataFrame, n: int, most: int, seed: str) -> DataFrame:
    """sequence_id, sample (from 1), words: n sequences for each prompt (sequence_id, last: the word to go on from, START for none).

    A sequence ends at END, at a word that nothing follows, or after `most` words. options: as choices gives them.
    """
    every = prompts.select("sequence_id", F.coalesce("last", F.lit(START)).alias("last"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("sample"))
    going = every.withColumn("words", F.array().cast("array<string>"))
    known = bounded_broadcast(table(options, "choices"))
    done = None
    for place in range(1, most + 1):
        u = uniform(F.lit(seed), F.col("sequence_id"), F.col("sample"), F.lit(place))
        asked = going.join(known, going["last"] == known["before"], "left").drop("before")
        fits = F.filter("options", lambda x: x["upto"] > F.col("_u"))
        drawn = asked.withColumn("_u", u).withColumn("_next", F.when(F.col("options").isNull(), END).otherwise(F.coalesce(F.get(fits, 0)["word"], F.get("options", F.size("options") - 1)["word"])))
        step = table(drawn.select("sequence_id", "sample", F.when(F.col("_next") == END, F.col("words")).otherwise(F.concat("words", F.array("_next"))).alias("words"), F.col("_next").alias("last")), "sequences")
        ended = step.where(F.col("last") == END).select("sequence_id", "sample", "words")
        done = ended if done is None else done.unionByName(ended)
        going = step.where(F.col("last") != END)
    rest = going.select("sequence_id", "sample", "words")
    return rest if done is None else done.unionByName(rest)
