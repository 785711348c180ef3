"""Conversations: turns, ordered histories, topics, renderings and masks.

Windows run within one conversation, so one shuffle by conversation serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .integrity import require_unique

CONVERSATION = ["split", "conv_id"]


def turns(messages: DataFrame, split: str = "dev") -> DataFrame:
    """split, conv_id, turn_id, question, answer: each user message with the next assistant message before the next question.

    turn_id counts questions from 1; a missing answer is empty; messages before the first question are left out.
    """
    number = F.sum((F.col("role") == "user").cast("long")).over(Window.partitionBy("conv_id").orderBy("turn"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    grouped = messages.withColumn("turn_id", number).where("turn_id > 0").groupBy("conv_id", "turn_id")
    return grouped.agg(F.max(F.when(user, F.col("text"))).alias("question"), F.coalesce(F.min_by("text", F.when(assistant, F.col("turn"))), F.lit("")).alias("answer")).select(F.lit(split).alias("split"), "conv_id", "turn_id", "question", "answer")


def with_sample_id(df: DataFrame) -> DataFrame:
    """Adds sample_id and history_depth (earlier turns)."""
    return df.withColumns({"sample_id": T.sample_id(F.col("split"), F.col("conv_id"), F.col("turn_id")), "history_depth": F.col("turn_id") - 1})


def _earlier() -> object:
    return Window.partitionBy(*CONVERSATION).orderBy("turn_id").rowsBetween(Window.unboundedPreceding, -1)


def with_history(df: DataFrame, least: int = 0) -> DataFrame:
    """Adds history: the earlier turns in order; rows with fewer than `least` of them go."""
    unit = F.struct("turn_id", "question", "answer")
    return df.withColumn("history", F.collect_list(unit).over(_earlier())).where(F.size("history") >= least)


def with_substituted_context(df: DataFrame) -> DataFrame:
    """Adds context: the flat list of earlier questions and answers, questions by their current utterance: the rewrite if one is
    at hand for the first turn, the question for later ones."""
    said = F.when((F.col("turn_id") == 1) & (T.clean(F.col("rewrite")) != ""), T.clean(F.col("rewrite"))).otherwise(T.clean(F.col("question")))
    pairs = F.collect_list(F.array(said, T.clean(F.col("answer")))).over(_earlier())
    return df.withColumn("context", F.flatten(pairs))


def with_topics(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Adds topic_id (dense, by first appearance), topic_switch (differs from the last topic), topic_switch_depth,
    topics_in_conversation and cumulative_switches. A null topic has no id and no switch and is looked through."""
    whole = Window.partitionBy(*CONVERSATION)
    first = F.when(F.col(topic).isNotNull(), F.min("turn_id").over(Window.partitionBy(*CONVERSATION, topic)))
    df = df.withColumn("_first", first)
    dense = F.dense_rank().over(whole.orderBy(F.col("_first").asc_nulls_last()))
    last = F.last(topic, ignorenulls=True).over(_earlier())
    df = df.withColumns({"topic_id": F.when(F.col(topic).isNotNull(), dense).cast("long"), "topic_switch": F.coalesce(F.col(topic) != last, F.lit(False))})
    up_to = whole.orderBy("turn_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns(
        {
            "topic_switch_depth": F.col("topic_id") - 1,
            "topics_in_conversation": F.coalesce(F.max("topic_id").over(whole), F.lit(0)).cast("long"),
            "cumulative_switches": F.sum(F.col("topic_switch").cast("long")).over(up_to),
        }
    ).drop("_first")


def rendered(history: str | Column, recent_first: bool = False) -> Column:
    """T<id> Q: <question> / A: <answer>, a blank line after each turn."""
    h = F.reverse(history) if recent_first else F.col(history) if isinstance(history, str) else history
    return F.array_join(F.transform(h, lambda t: F.concat(F.lit("T"), t["turn_id"].cast("string"), F.lit(" Q: "), F.coalesce(t["question"], F.lit("")), F.lit("\nA: "), F.coalesce(t["answer"], F.lit("")), F.lit("\n\n"))), "")


def field_offsets(history: str) -> Column:
    """Where each turn's question and answer stand in rendered(history), in code points: list of turn_id, question_start, answer_start."""

    def place(acc: Column, t: Column) -> Column:
        q = acc["end"] + F.length(t["turn_id"].cast("string")) + 5
        a = q + F.length(F.coalesce(t["question"], F.lit(""))) + 4
        row = F.struct(t["turn_id"].alias("turn_id"), q.alias("question_start"), a.alias("answer_start"))
        return F.struct((a + F.length(F.coalesce(t["answer"], F.lit(""))) + 2).alias("end"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<turn_id:bigint,question_start:int,answer_start:int>>").alias("rows"))
    return F.aggregate(history, empty, place)["rows"]


def masked(history: str, mask: str | Column) -> Column:
    """The turns whose bit in the mask is 1."""
    m = F.col(mask) if isinstance(mask, str) else mask
    return F.filter(history, lambda t, i: F.substring(m, i + F.lit(1), F.lit(1)) == "1")


def expanded(selected: DataFrame, source: DataFrame, granularity: str) -> DataFrame:
    """Selected fields (sample_id, turn_id, field, in `source` rows sample_id, turn_id, question, answer) widened to whole fields
    (`qa`) or whole turns (`turn`); rows of empty text go, order is the source's. A turn that the source hasn't, or has twice, raises."""
    require_unique(source, ["sample_id", "turn_id"])
    if odd := selected.join(source, ["sample_id", "turn_id"], "left_anti").select("sample_id", "turn_id").head(1):
        raise KeyError(f"no turn {odd[0].asDict()}")
    kept = selected.select("sample_id", "turn_id", "field").distinct()
    fields = source.select("sample_id", "turn_id", F.explode(F.array(F.struct(F.lit("question").alias("field"), F.col("question").alias("text")), F.struct(F.lit("answer").alias("field"), F.col("answer").alias("text")))).alias("f")).select("sample_id", "turn_id", "f.*").where("text <> ''")
    keys = ["sample_id", "turn_id", "field"] if granularity == "qa" else ["sample_id", "turn_id"]
    return fields.join(kept.select(*keys).distinct(), keys, "left_semi")


def chunks(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Selected tokens (keys, index, token) with consecutive indices joined by spaces: keys, start, end, text."""
    island = F.col("index") - F.row_number().over(Window.partitionBy(*keys).orderBy("index"))
    grouped = tokens.withColumn("_island", island).groupBy(*keys, "_island")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "token"))), lambda t: t["token"]), " ")
    return grouped.agg(F.min("index").alias("start"), F.max("index").alias("end"), joined.alias("text")).drop("_island")


def direct_query(selected: Column, question: Column, depth: Column) -> Column:
    """The selected history's text as a query; the question itself where there is no history."""
    return F.when(depth == 0, question).otherwise(T.clean(selected))
