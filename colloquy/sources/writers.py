"""Sinks and stores: collections, rankings, incremental result stores and content-addressed caches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..operators import ranking
from ..operators.integrity import population_sum, require_same_ids
from ..session import table
from . import schemas
from .stores import KeyedStore


def collection(passages: DataFrame, titles: bool = True) -> DataFrame:
    """id and contents, with the title before the text; ` [SEP] ` in titles becomes a space."""
    title = F.replace(F.coalesce("title", F.lit("")), F.lit(" [SEP] "), F.lit(" "))
    contents = F.trim(F.concat_ws(" ", title, F.coalesce("text", F.lit("")))) if titles else F.coalesce("text", F.lit(""))
    return passages.select("id", contents.alias("contents"))


def write_rankings(hits: DataFrame, path: str) -> None:
    """JSON lines {query_id, docids}, gzipped; docids in order of rank."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "docid"))), lambda h: h["docid"])
    hits.groupBy("query_id").agg(listed.alias("docids")).write.option("compression", "gzip").json(path)


def write_trec_run(hits: DataFrame, path: str, tag: str) -> None:
    hits.select(F.concat_ws(" ", "query_id", F.lit("Q0"), "docid", F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(tag)).alias("value")).write.text(path)


def write_partials(hits: DataFrame, path: str) -> None:
    """Partial hits by session (column shard_session), for merging later."""
    hits.write.mode("append").partitionBy("shard_session").parquet(path)


def merge_partials(spark: SparkSession, path: str, k: int) -> DataFrame:
    return ranking.merged_partials(spark.read.parquet(path), k)


def manifest(df: DataFrame, key: str) -> DataFrame:
    """rows and ids_sum of an artefact: what a later reader can hold it against."""
    return df.agg(F.count("*").alias("rows"), population_sum(key).alias("ids_sum"))


class RankingStore:
    """Rankings kept by query in a KeyedStore; only queries that it doesn't hold are retrieved. A batch that runs again, and writers that
    rank the same queries at once, leave one ranking a query."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.store = KeyedStore(spark, path, schemas.HITS, "query_id", buckets)

    def read(self) -> DataFrame:
        return self.store.rows()

    def pending(self, queries: DataFrame) -> DataFrame:
        """Queries (query_id, query) without a stored ranking. Queries that found nothing are stored with a null docid."""
        return self.store.missing(queries)

    def add(self, queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], batch: str | None = None) -> None:
        """Retrieves for the pending queries and keeps what is found. batch: the name of what may be tried again; its own name otherwise."""
        todo = self.pending(queries)
        hits = retrieve(todo).select("query_id", "rank", "docid", "score")
        rows = todo.select("query_id").distinct().join(hits, "query_id", "left")
        found = rows.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("docid").cast("string").alias("docid"), F.col("score").cast("double").alias("score"))
        self.store.put(table(found, "rankings"), batch or uuid.uuid4().hex)

    def hits(self) -> DataFrame:
        return self.read().where("docid is not null")


def merged_stores(stores: list[DataFrame], k: int) -> DataFrame:
    """One ranking of several stores over the same queries; a docid's largest score counts."""
    for other in stores[1:]:
        require_same_ids(stores[0], other, "query_id")
    out = stores[0]
    for other in stores[1:]:
        out = out.unionByName(other)
    return ranking.merged_partials(out, k)


def cached(requests: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], signature: str) -> tuple[DataFrame, DataFrame]:
    """(answers to requests (payload), rows to append to the cache): rows are keyed by sha256 of signature and payload, each distinct
    payload is computed once, and only if the cache (key, value) doesn't hold it. compute: key, payload to key, value."""
    keyed = requests.withColumn("key", F.sha2(F.concat(F.lit(signature + "\0"), F.col("payload")), 256))
    misses = keyed.select("key", "payload").distinct().join(cache.select("key"), "key", "left_anti")
    fresh = compute(misses).select("key", "value")
    return keyed.join(cache.select("key", "value").unionByName(fresh), "key"), fresh


def by_priority(sources: list[DataFrame], key: str) -> DataFrame:
    """A row for each key from the first source that has it."""
    union = None
    for place, source in enumerate(sources):
        part = source.withColumn("_place", F.lit(place))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    return ranking.best_row(union, [key], F.col("_place")).drop("_place")


def numbered_collection(passages: DataFrame, order: list[str]) -> DataFrame:
    """Passages with id, their place from 0 in the given order as text. Rows are dealt to ranges and only their sizes meet."""
    dealt = table(passages.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "collection-ranges")
    sizes = dealt.groupBy("_part").count().withColumn("_start", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_within", within).join(F.broadcast(sizes.select("_part", "_start")), "_part").withColumn("id", (F.col("_start") + F.col("_within")).cast("string")).drop("_part", "_start", "_within")


def renumbered_gold(gold: DataFrame, collection_: DataFrame) -> DataFrame:
    """gold (sample_id, raw_passage_id) with id, the number of the last passage of that raw id; null where the collection lacks it."""
    last = collection_.where("raw_passage_id is not null").groupBy("raw_passage_id").agg(F.max(F.col("id").cast("long")).cast("string").alias("id"))
    return gold.join(last, "raw_passage_id", "left").select("sample_id", "raw_passage_id", "id")


def score_cache(spark: SparkSession, path: str, hits: DataFrame, canonical: DataFrame) -> DataFrame:
    """Scores kept beside a ranking cache: hits (query_id, rank, docid, score) are written and read again; raises if their lists aren't
    the canonical ones (query_id, rank, docid), place by place."""
    hits.select("query_id", F.col("rank").cast("int"), F.col("docid").cast("string"), F.col("score").cast("double")).write.parquet(path)
    stored = spark.read.schema(schemas.HITS).parquet(path)
    both = stored.join(canonical.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("docid").cast("string").alias("_docid")), ["query_id", "rank"], "full")
    if odd := both.where("not (docid <=> _docid)").head(1):
        raise ValueError(f"the list of {odd[0]['query_id']} differs at rank {odd[0]['rank']}")
    return stored


def write_csv(df: DataFrame, path: str) -> None:
    """Delimited text with a header; nested columns as JSON, numbers in their shortest exact form."""
    nested = lambda f: isinstance(f.dataType, (ArrayType, MapType, StructType))
    columns = [F.to_json(f.name).alias(f.name) if nested(f) else F.col(f.name) for f in df.schema.fields]
    df.select(*columns).write.option("header", True).option("escape", '"').csv(path)


def write_flat_shards(vectors: DataFrame, path: str, rows: int, order: str = "docid") -> None:
    """Vectors (docid, vector) as numbered shards of `rows` rows in order of their ids: Parquet folders by shard_id, each row with its
    place in the shard."""
    numbered = numbered_collection(vectors, [order]).withColumn("_n", F.col("id").cast("long")).drop("id")
    numbered.select("docid", F.col("vector").cast("array<float>").alias("vector"), F.floor(F.col("_n") / rows).cast("int").alias("shard_id"), F.pmod("_n", F.lit(rows)).cast("int").alias("place")).write.partitionBy("shard_id").parquet(path)


def append_log(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Appends those rows to a log whose key it hasn't yet, and gives the whole log. Parquet's commit makes an append whole or nothing; a
    key that two writers append at once is read once, its least row."""
    spark = rows.sparkSession
    try:
        held = spark.read.schema(rows.schema).parquet(path)
        fresh = rows.dropDuplicates([key]).join(held.select(key), key, "left_anti").select(*rows.columns)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        fresh = rows.dropDuplicates([key])
    fresh.write.mode("append").parquet(path)
    return read_log(spark, path, rows.schema, key)


def read_log(spark: SparkSession, path: str, schema, key: str) -> DataFrame:
    """The log's rows, one for each key."""
    held = spark.read.schema(schema).parquet(path)
    return held.groupBy(key).agg(F.min(F.struct(*held.columns)).alias("row")).select("row.*")
