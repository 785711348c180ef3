"""Checks that raise: required columns, unique keys, join cardinality, equal populations; and fingerprints of populations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"columns are missing: {missing}")
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if repeated := df.groupBy(*keys).count().where("count > 1").head(1):
        raise ValueError(f"rows repeat the key {repeated[0].asDict()}")
    return df


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """A join whose sides have been checked: one_to_one, one_to_many, many_to_one or many_to_many."""
    if validate.startswith("one"):
        require_unique(left, keys)
    if validate.endswith("one"):
        require_unique(right, keys)
    return left.join(right, keys, how)


def null_safe_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A join in which null keys match each other."""
    return left.join(right.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), how).drop("_key")


def require_same_ids(left: DataFrame, right: DataFrame, key: str) -> None:
    both = left.select(key, F.lit(1).alias("a")).distinct().join(right.select(key, F.lit(1).alias("b")).distinct(), key, "full")
    if odd := both.where("a is null or b is null").head(1):
        raise ValueError(f"an id is on one side only: {odd[0][0]}")


def require_complete(df: DataFrame, names: list[str]) -> DataFrame:
    if df.where(" or ".join(f"`{n}` is null" for n in names)).head(1):
        raise ValueError(f"nulls in {names}")
    return df


def population_hash(ids: str | Column) -> Column:
    """sha256 of a group's sorted ids joined by line feeds; for groups of a bounded size, such as a conversation's samples."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(ids)), "\n"), 256)


def population_sum(ids: str) -> Column:
    """An order-free fingerprint for populations of any size: the sum of the ids' 64-bit hashes."""
    return F.sum(F.xxhash64(ids).cast("decimal(38,0)"))


def ordinal_join(left: DataFrame, right: DataFrame, group: str, left_order: str, right_order: str) -> DataFrame:
    """Joins the k-th row of a group with its k-th row on the other side; groups must be as large on both."""
    from pyspark.sql import Window

    a = left.withColumn("ordinal", F.row_number().over(Window.partitionBy(group).orderBy(left_order)))
    b = right.withColumn("ordinal", F.row_number().over(Window.partitionBy(group).orderBy(right_order)))
    sizes = a.groupBy(group).agg(F.count("*").alias("n")).join(b.groupBy(group).agg(F.count("*").alias("m")), group, "full")
    if odd := sizes.where("not (n <=> m)").head(1):
        raise ValueError(f"sizes of group {odd[0][0]} differ")
    return a.join(b, [group, "ordinal"])


def id_derived_join(left: DataFrame, right: DataFrame, ids: str, split: str, key: str = "sample_id") -> DataFrame:
    """Joins ids of the form <conversation>_<turn> with sample ids <split>:<conversation>:<turn>; a row of either side without a
    partner raises."""
    derived = F.concat(F.lit(split + ":"), F.regexp_extract(ids, r"^(.*)_(\d+)$", 1), F.lit(":"), F.regexp_extract(ids, r"^(.*)_(\d+)$", 2))
    named = left.withColumn(key, derived)
    require_same_ids(named, right, key)
    return named.join(right, key)


def attached(samples: DataFrame, metadata: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """samples with metadata columns; raises if a sample has two different rows of them, none, or other values already."""
    one = require_unique(metadata.select(key, *columns).distinct(), [key])
    had = [c for c in columns if c in samples.columns]
    joined = samples.join(one.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key, "left")
    if odd := joined.where(" or ".join([f"`_{columns[0]}` is null", *[f"not (`{c}` <=> `_{c}`)" for c in had]])).head(1):
        raise ValueError(f"no metadata, or other values, for {odd[0][key]}")
    return joined.drop(*had).withColumnsRenamed({f"_{c}": c for c in columns})


def cluster_key(*columns: str) -> Column:
    """The columns as one JSON list: an id of a cluster of rows."""
    return F.to_json(F.array(*[F.col(c).cast("string") for c in columns]))
