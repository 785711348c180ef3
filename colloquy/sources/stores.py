"""Stores by key that survive repeated batches and several writers, and a chain of them for rewriting and retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import table

BUCKETS = 32


class KeyedStore:
    """Rows by a key in a Parquet folder, a folder for each bucket of keys and batch.

    A batch that is put again replaces its own files and nothing else, as Spark overwrites only the folders that it writes; writers with
    other batches never touch them, so none can lose another's rows. Where batches overlap, a key's rows are those of its last batch in
    order of their names, all of them and no others. compact() drops what no reader sees any more.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _held(self) -> DataFrame:
        whole = f"{self.schema}, bucket int, batch string"
        try:
            return self.spark.read.schema(whole).parquet(self.path)
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], whole)
            raise

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        """The rows that count, with their batch."""
        held = self._held()
        last = held.groupBy("bucket", self.key).agg(F.max("batch").alias("batch"))
        return held.join(last, ["bucket", self.key, "batch"]).drop("bucket")

    def rows(self) -> DataFrame:
        return self.read().drop("batch")

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys; only the buckets that they fall into are read."""
        wanted = keys.select(self.key).distinct().withColumn("bucket", self._bucket())
        buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]  # BUCKETS at most
        held = self._held().where(F.col("bucket").isin(buckets))
        mine = held.join(wanted, ["bucket", self.key], "left_semi")
        last = mine.groupBy("bucket", self.key).agg(F.max("batch").alias("batch"))
        return mine.join(last, ["bucket", self.key, "batch"]).drop("bucket", "batch")

    def missing(self, keys: DataFrame) -> DataFrame:
        """keys (with any further columns) that the store doesn't hold."""
        return keys.join(self._held().select(self.key).distinct(), self.key, "left_anti")

    def put(self, rows: DataFrame, batch: str) -> None:
        """Writes rows, all those of their keys, as a batch."""
        whole = rows.select(*[c for c in self._held().columns if c not in ("bucket", "batch")]).withColumn("bucket", self._bucket()).withColumn("batch", F.lit(batch))
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.path)

    def compact(self, batch: str) -> None:
        """All rows that count as one batch; the others go. No other writer may be at work."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        kept = table(self.rows(), "compacted")
        for bucket in files.listStatus(where):
            if bucket.isDirectory():
                for old in files.listStatus(bucket.getPath()):
                    files.delete(old.getPath(), True)
        self.put(kept, batch)


class RewriteChain:
    """Inputs to rewrites to rankings, each level kept by content: an input's key is its text's digest; a rewrite's is that of the rewriter's
    signature and the input's key; a ranking's that of the index's signature, k and the rewrite's normal form. So another
    rewriter leaves inputs valid and rewrites none, and rankings stay valid for all texts that it writes as the last one did;
    another index invalidates rankings alone."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.inputs = KeyedStore(spark, f"{path}/inputs", "input_key string, text string", "input_key", buckets)
        self.rewrites = KeyedStore(spark, f"{path}/rewrites", "rewrite_key string, rewrite string", "rewrite_key", buckets)
        self.rankings = KeyedStore(spark, f"{path}/rankings", "ranking_key string, rank int, docid string, score double", "ranking_key", buckets)

    def run(self, requests: DataFrame, rewrite: Callable[[DataFrame], DataFrame], model: str, search: Callable[[DataFrame, int], DataFrame], index: str, k: int, batch: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(rewritten requests: request_id, input_key, rewrite, ranking_key; hits: ranking_key, rank, docid, score; counts: level, asked, held, computed).

        requests: request_id, text. rewrite: (input_key, text) to (input_key, rewrite); search: (query_id, query), k to (query_id, rank, docid,
        score). Each distinct input is rewritten once, and each distinct lowered form searched once, unless the chain holds it. Rewrites without
        a word have no ranking. A search without hits is kept as such.
        """
        key = lambda *parts: F.sha2(F.concat_ws("\0", *parts), 256)
        asked = table(requests.select("request_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("input_key", key(F.col("text"))).withColumn("rewrite_key", key(F.lit(model), F.col("input_key"))), "chain-asked")
        inputs = asked.select("input_key", "rewrite_key", "text").distinct()
        new_inputs = table(self.inputs.missing(inputs.select("input_key", "text")), "chain-inputs")
        self.inputs.put(new_inputs, batch)
        to_write = table(self.rewrites.missing(inputs), "chain-misses")
        written = rewrite(to_write.select("input_key", "text")).select("input_key", "rewrite").join(to_write.select("input_key", "rewrite_key"), "input_key")
        new_rewrites = table(written.select("rewrite_key", F.coalesce("rewrite", F.lit("")).alias("rewrite")), "chain-rewrites")
        self.rewrites.put(new_rewrites, batch)
        known = self.rewrites.of(inputs).join(inputs.select("rewrite_key", "input_key"), "rewrite_key").withColumn("norm", T.lowered_form(F.col("rewrite")))
        named = table(known.withColumn("ranking_key", F.when(F.col("norm") != "", key(F.lit(index), F.lit(str(k)), F.col("norm")))).select("input_key", "rewrite", "norm", "ranking_key"), "chain-named")
        queries = named.where("ranking_key is not null").select("ranking_key", F.col("norm").alias("query")).distinct()
        to_search = table(self.rankings.missing(queries), "chain-queries")
        found = search(to_search.select(F.col("ranking_key").alias("query_id"), "query"), k).select(F.col("query_id").alias("ranking_key"), F.col("rank").cast("int").alias("rank"), F.col("docid").cast("string").alias("docid"), F.col("score").cast("double").alias("score"))
        self.rankings.put(table(to_search.select("ranking_key").join(found, "ranking_key", "left"), "chain-rankings"), batch)
        level = lambda name, all_, new: all_.agg(F.count("*").alias("asked")).select(F.lit(name).alias("level"), "asked", (F.col("asked") - F.lit(new.count())).alias("held"), F.lit(new.count()).cast("long").alias("computed"))
        counts = table(level("inputs", inputs, new_inputs).unionByName(level("rewrites", inputs, new_rewrites)).unionByName(level("rankings", queries, to_search)), "chain-counts")
        hits = self.rankings.of(queries).where("docid is not null")
        return asked.select("request_id", "input_key").join(named.select("input_key", "rewrite", "ranking_key"), "input_key"), hits, counts
