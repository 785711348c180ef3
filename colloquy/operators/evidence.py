"""Evidence of gold passages in the history: BM25 weights of its tokens, and their projection to a tokenizer's pieces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as T
from ..llm.common import bounded
from ..session import table
from . import conversation, retrieval
from .index import Index
from .spans import TEXTS, tokens_with_offsets
from .statistics import DECIMALS

PIECES = "piece_ids array<int>, segments array<int>, starts array<int>, ends array<int>, kept int"


def history_tokens(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """key, turn_id, field (question or answer), start, end and text: the runs of anything but white space in every field of the history, with
    their places in the field in code points. Null fields have none."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"t.{f}").alias("said")) for f in ("question", "answer")])
    bounded(samples.sparkSession)
    each = samples.select(key, F.explode("history").alias("t")).select(key, F.col("t.turn_id").alias("turn_id"), F.explode(fields).alias("f"))
    placed = each.select(key, "turn_id", F.col("f.field").alias("field"), F.explode(tokens_with_offsets("f.said")).alias("w"))
    return placed.select(key, "turn_id", "field", "w.start", "w.end", "w.text")


def only_gold(gold: DataFrame, key: str = "sample_id") -> DataFrame:
    """key and docid: the one gold passage of each sample; a sample with several different ones, or a null one, raises."""
    g = gold.groupBy(key).agg(F.min("docid").alias("docid"), F.max("docid").alias("_last"), F.bool_or(F.col("docid").isNull()).alias("_null"))
    odd = F.col("_null") | (F.col("docid") != F.col("_last"))
    told = F.concat(F.lit("not exactly one gold passage: "), F.col(key).cast("string"))
    return g.select(key, F.when(odd, F.raise_error(told).cast(gold.schema["docid"].dataType)).otherwise(F.col("docid")).alias("docid"))


def passage_weights(found: Index, docids: DataFrame, k1: float = retrieval.K1, b: float = retrieval.B) -> DataFrame:
    """docid, term and BM25 weight of all terms of the named passages; one that the index lacks raises. Only their postings leave the scan."""
    s = found.statistics
    wanted = table(docids.select(F.col("docid").cast(s["docid"]).alias("docid")).distinct(), "gold-passages")
    if lost := wanted.join(found.documents.select("docid"), "docid", "left_anti").head(1):
        raise ValueError(f"the index lacks the passage {lost[0].docid}")
    held = found.documents.join(wanted, "docid", "left_semi")
    postings = held.select("docid", "length", F.explode("terms").alias("t")).select("docid", "length", "t.term", "t.tf")
    weighed = retrieval.weight(F.col("tf"), F.col("length"), F.col("df"), F.lit(s["documents"]), F.lit(s["average_length"] or 1.0), k1, b)
    return postings.join(found.frequencies.select("term", "df"), "term").select("docid", "term", weighed.alias("weight"))


def gold_token_scores(samples: DataFrame, gold: DataFrame, found: Index, key: str = "sample_id") -> DataFrame:
    """history_tokens of the samples that gold (key, docid) names, with docid, score_raw and score_norm.

    score_raw is the sum of the BM25 weights in the sample's gold passage of all terms of the token, repeats included; score_norm divides it by the
    sample's largest, and is 0 where that is 0. Samples must have exactly one gold passage, which the index must hold; those without any are left out.
    Tokens of equal text are scored once in a passage.
    """
    gold = table(only_gold(gold, key), "only-gold")
    tokens = table(history_tokens(samples, key).join(gold, key), "history-tokens")
    texts = tokens.select("docid", "text").distinct()
    terms = texts.select("docid", "text", F.explode(T.terms(F.col("text"))).alias("term"))
    weights = passage_weights(found, gold).withColumn("docid", F.col("docid").cast(gold.schema["docid"].dataType))
    scores = terms.join(weights, ["docid", "term"]).groupBy("docid", "text").agg(F.sum("weight").alias("score_raw"))
    scored = table(tokens.join(scores, ["docid", "text"], "left").withColumn("score_raw", F.coalesce("score_raw", F.lit(0.0))), "token-scores")
    most = scored.groupBy(key).agg(F.max("score_raw").alias("_most"))
    norm = F.when(F.col("_most") > 0, F.col("score_raw") / F.col("_most")).otherwise(0.0)
    return scored.join(most, key).select(key, "docid", "turn_id", "field", "start", "end", "text", F.round("score_raw", DECIMALS).alias("score_raw"), F.round(norm, DECIMALS).alias("score_norm"))


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encoded_pieces(pairs: DataFrame, path: str, most: int, opening: str, closing: str, first: str = "query", second: str = "said", strict: bool = True) -> DataFrame:
    """Adds piece_ids, segments (0 and 1, null for markers), starts and ends (code points in the piece's own text; 0 and 0 for markers) and kept to
    rows with two texts: the opening marker, the first text's pieces, the closing marker, the second's and the closing marker, `most` in all. Only
    the second text is cut, to `kept` pieces; a first one that leaves no room raises, or has nulls if not strict. Null texts are empty. path: a
    tokenizer file that every executor can read."""
    names = pairs.columns
    schema = pairs.schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(path)
        marks = t.token_to_id(opening), t.token_to_id(closing)
        if None in marks:
            raise ValueError("the tokenizer lacks a marker")
        for batch in (b[at : at + TEXTS] for b in batches for at in range(0, len(b), TEXTS)):
            asked, said = (t.encode_batch([x if isinstance(x, str) else "" for x in batch[c]], add_special_tokens=False) for c in (first, second))
            rows = []
            for a, b in zip(asked, said, strict=True):
                room = most - 3 - len(a.ids)
                if room < 0 and not strict:
                    rows.append((None,) * 5)
                    continue
                if room < 0:
                    raise ValueError("the first text is too long")
                kept = min(room, len(b.ids))
                places = [(0, 0), *a.offsets, (0, 0), *b.offsets[:kept], (0, 0)]
                rows.append(([marks[0], *a.ids, marks[1], *b.ids[:kept], marks[1]], [None, *[0] * len(a.ids), None, *[1] * kept, None], [s for s, _ in places], [e for _, e in places], kept))
            found = pd.DataFrame(rows, columns=["piece_ids", "segments", "starts", "ends", "kept"]).astype({"kept": "Int32"})
            yield pd.concat([batch[names].reset_index(drop=True), found], axis=1)

    bounded(pairs.sparkSession)
    return pairs.mapInPandas(run, f"{schema}, {PIECES}")


def encoded_history(samples: DataFrame, path: str, most: int, opening: str, closing: str, recent_first: bool = False, key: str = "sample_id", strict: bool = True) -> DataFrame:
    """key, query, said (the rendered history) and its encoded_pieces for samples with a question and a history."""
    pairs = samples.select(key, F.coalesce("question", F.lit("")).alias("query"), conversation.rendered("history", recent_first).alias("said"))
    return encoded_pieces(pairs, path, most, opening, closing, strict=strict)


@F.pandas_udf(ArrayType(DoubleType()))
def _over(segments: pd.Series, starts: pd.Series, ends: pd.Series, froms: pd.Series, tos: pd.Series, values: pd.Series) -> pd.Series:
    def project(parts, low, high, at, to, score):
        if parts is None:
            return None
        out = np.zeros(len(parts))
        if at is not None and len(at):
            first, last = np.searchsorted(to, low, "right"), np.searchsorted(at, high, "left")
            for n, part in enumerate(parts):
                if part == 1 and high[n] > low[n] and last[n] > first[n]:
                    out[n] = max(0.0, score[first[n] : last[n]].max())
        return out

    return pd.Series([project(*row) for row in zip(segments, starts, ends, froms, tos, values, strict=True)])


def piece_scores(encoded: DataFrame, scores: DataFrame, samples: DataFrame, recent_first: bool = False, key: str = "sample_id") -> DataFrame:
    """key, piece_ids, segments and scores: for each piece of the history the largest score_norm of the tokens it overlaps, 0 for all others; null
    where there are no pieces.

    scores: as gold_token_scores gives them; samples: their histories, which say where each field stands in the rendered text. Only a
    sample's own positive tokens meet in a row.
    """
    order = F.reverse("history") if recent_first else F.col("history")
    fields = conversation.field_offsets(order)
    placed = samples.select(key, F.explode(fields).alias("o")).select(key, F.col("o.turn_id").alias("turn_id"), F.explode(F.create_map(F.lit("question"), F.col("o.question_start"), F.lit("answer"), F.col("o.answer_start"))).alias("field", "_from"))
    positive = scores.where("score_norm > 0").join(placed, [key, "turn_id", "field"])
    spans = positive.groupBy(key).agg(F.collect_list(F.struct((F.col("start") + F.col("_from")).alias("start"), (F.col("end") + F.col("_from")).alias("end"), F.col("score_norm").alias("score"))).alias("_spans"))
    bounded(samples.sparkSession)
    sorted_ = spans.withColumn("_spans", F.array_sort("_spans"))
    return encoded.join(sorted_, key, "left").select(key, "piece_ids", "segments", _over("segments", "starts", "ends", "_spans.start", "_spans.end", "_spans.score").alias("scores"))
