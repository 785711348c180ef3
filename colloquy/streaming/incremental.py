"""Structured Streaming over arriving queries and messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..sources.writers import RankingStore, append_log


def retrieve_arriving(spark: SparkSession, folder: str, store: RankingStore, retrieve: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Ranks the queries (query_id, query) of Parquet files as they arrive in a folder, once each: a micro-batch that runs again
    finds its queries in the store already."""
    arriving = spark.readStream.schema("query_id string, query string").parquet(folder)

    def step(batch: DataFrame, number: int) -> None:
        store.add(batch.dropDuplicates(["query_id"]), retrieve, f"stream-{number:012}")

    return arriving.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_arriving(spark: SparkSession, folder: str, schema: str, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends arriving rows of Parquet files to a log, once for each key, also when a micro-batch runs again."""
    arriving = spark.readStream.schema(schema).parquet(folder)
    return arriving.writeStream.foreachBatch(lambda batch, _: append_log(batch, path, key) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_moments(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, n, sum, squares, least and most, of a stream (kept up to date, output mode complete or update) or a table; moments_of finishes them."""
    v = F.col(value).cast("double")
    return values.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"), F.min(v).alias("least"), F.max(v).alias("most"))


def moments_of(running: DataFrame, by: list[str]) -> DataFrame:
    """by, n, mean, deviation (of the population), least and most."""
    mean = F.col("total") / F.col("n")
    return running.select(*by, "n", F.round(mean, 9).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - mean * mean)), 6).alias("deviation"), "least", "most")


DIALOGUE = "conv_id long, turn_id int, depth int, history array<string>, question string"


def growing_dialogues(messages: DataFrame, most: int = 1_000) -> DataFrame:
    """A row for each question as it arrives, with the dialogue so far: messages (conv_id, turn, role, text) of a stream. depth counts all
    earlier messages, history holds the last `most` of them, which bounds the state. Within a micro-batch messages are taken by turn;
    a message that repeats a turn already seen is passed over."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, turns, depth, history = state.get if state.exists else (-1, 0, 0, [])
        history, out = list(history), []
        for m in sorted((m for rows in batches for m in rows.itertuples(index=False)), key=lambda m: m.turn):
            if m.turn <= seen:
                continue
            seen = int(m.turn)
            if m.role == "user":
                turns += 1
                out.append((key[0], turns, depth, list(history), m.text))
            depth += 1
            history = [*history, m.text or ""][-most:]
        state.update((seen, turns, depth, history))
        yield pd.DataFrame(out, columns=["conv_id", "turn_id", "depth", "history", "question"])

    return messages.groupBy("conv_id").applyInPandasWithState(step, DIALOGUE, "seen int, turns int, depth int, history array<string>", "append", "NoTimeout")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n and total of events (ts, event_type, value) by event time; a stream's events later than the watermark go."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    g = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def windows_arriving(spark: SparkSession, folder: str, path: str, checkpoint: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The windows (see windowed_counts) that are complete once all files (ts, event_type, value) now in the folder are taken in. Each is appended to
    path when the watermark, the latest time seen less `late`, has passed its end; later calls with the same checkpoint go on from there.
    Rows of windows that the watermark has passed go; those of others count, however late."""
    arriving = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(folder)
    counts = windowed_counts(arriving, width, late)
    counts.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema("window_start timestamp, event_type string, n long, total double").parquet(path)
