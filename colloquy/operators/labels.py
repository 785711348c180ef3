"""Label rows of a teacher: usage, finalisation, and how they are held against samples and gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .integrity import require_unique


def usage(rows: DataFrame, metadata: str = "teacher_metadata") -> DataFrame:
    """One row: prompt_tokens, completion_tokens and total_tokens over all rows; missing metadata and numbers count as 0."""
    of = lambda c: F.coalesce(F.sum(F.coalesce(F.col(metadata)[c], F.lit(0))), F.lit(0)).cast("long")
    sums = rows.agg(of("prompt_tokens").alias("prompt_tokens"), of("completion_tokens").alias("completion_tokens"))
    return sums.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def finalised(rows: DataFrame, expected: int, errors: int = 0) -> DataFrame:
    """One row that describes a finished set of labels: rows, error_count, invalid_spans and usage. Other than `expected` rows raise."""
    if (n := rows.count()) != expected:
        raise ValueError(f"{n} of {expected} labels")
    invalid = rows.agg(F.count("*").alias("rows"), F.lit(errors).alias("error_count"), F.coalesce(F.sum(F.size(F.coalesce("invalid_spans", F.array()))), F.lit(0)).cast("long").alias("invalid_spans"))
    return invalid.crossJoin(usage(rows))  # one row each


def aligned(labels: DataFrame, samples: DataFrame, gold: DataFrame, prefix: str, order: str = "place") -> DataFrame:
    """Labels (sample_id, ..., place) with their sample's columns and gold (sample_id, docid) as a list, in the labels' order.

    A label whose id lacks the prefix, has no sample or no gold, or that repeats, raises; samples without a label go.
    """
    require_unique(labels, ["sample_id"])
    require_unique(samples, ["sample_id"])
    if odd := labels.where(~F.col("sample_id").startswith(prefix)).head(1):
        raise ValueError(f"{odd[0]['sample_id']} is of another split")
    listed = gold.groupBy("sample_id").agg(F.array_sort(F.collect_set("docid")).alias("gold"))
    for name, other in (("sample", samples), ("gold passage", listed)):
        if odd := labels.join(other, "sample_id", "left_anti").head(1):
            raise KeyError(f"no {name} for {odd[0]['sample_id']}")
    return labels.join(samples, "sample_id").join(listed, "sample_id").orderBy(order)


def disagreements(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: rows of both populations, ids on one side only, and for each column how many shared rows differ (nulls are equal)."""
    a, b = left.select(key, *columns, F.lit(1).alias("_a")), right.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(1).alias("_b"))
    both = a.join(b, key, "full")
    shared = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    differ = [F.count_if(shared & ~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(f"{c}_differs") for c in columns]
    return both.agg(F.count("_a").alias("left_rows"), F.count("_b").alias("right_rows"), F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"), *differ)


def chosen_positions(labels: str | Column) -> Column:
    """The places of those tokens (list of lists of labels) that have a label."""
    places = F.transform(labels, lambda x, i: F.when(F.size(x) > 0, i))
    return F.array_compact(places)
