"""A lexical index as an artefact: written once, searched many times.

Three Parquet tables under one path: `documents` (a row for each passage with its length and its distinct terms and their
frequencies), `frequencies` (documents and occurrences of each term) and `statistics` (one row). A passage is tokenised once,
in the pass that writes it; nothing is shuffled but the terms' counts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..llm.common import in_arrow
from ..session import new_path

DOCUMENTS = "docid {kind}, length int, terms array<struct<term: string, tf: int>>"
FREQUENCIES = "term string, df long, occurrences long"
_TERM = re.compile("[a-z0-9]+")
STATISTICS = "documents long, average_length double, terms long, postings long, docid string"


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str

    @property
    def statistics(self):
        return self.spark.read.schema(STATISTICS).parquet(f"{self.path}/statistics").first()

    @property
    def documents(self) -> DataFrame:
        return self.spark.read.schema(DOCUMENTS.format(kind=self.statistics["docid"])).parquet(f"{self.path}/documents")

    @property
    def frequencies(self) -> DataFrame:
        return self.spark.read.schema(FREQUENCIES).parquet(f"{self.path}/frequencies")


def _counted(batches):
    """docid, length and terms of lower-cased texts: distinct terms in order, with how often each occurs."""
    for batch in batches:
        found = [Counter(_TERM.findall(x)) for x in batch.column(1).to_pylist()]
        listed = [sorted(c) for c in found]
        terms = pa.array([t for of in listed for t in of], pa.string())
        tf = pa.array([c[t] for c, of in zip(found, listed, strict=True) for t in of], pa.int32())
        entries = pa.StructArray.from_arrays([terms, tf], names=["term", "tf"])
        starts = pa.array(np.cumsum([0, *map(len, listed)]), pa.int32())
        lengths = pa.array([c.total() for c in found], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), lengths, pa.ListArray.from_arrays(starts, entries)], names=["docid", "length", "terms"])


def write(passages: DataFrame, path: str) -> Index:
    """The index of passages (docid, text); null and empty texts have no terms but count as documents."""
    spark = passages.sparkSession
    kind = passages.schema["docid"].dataType.simpleString()
    schema = DOCUMENTS.format(kind=kind)
    lowered = passages.select("docid", F.lower(F.coalesce("text", F.lit(""))).alias("text"))  # as T.terms lowers them
    in_arrow(lowered, _counted, StructType.fromDDL(schema)).write.parquet(f"{path}/documents")
    documents = spark.read.schema(schema).parquet(f"{path}/documents")
    postings = documents.select(F.explode("terms").alias("t")).select("t.*")
    postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences")).write.parquet(f"{path}/frequencies")
    frequencies = spark.read.schema(FREQUENCIES).parquet(f"{path}/frequencies")
    d = documents.agg(F.count("*").alias("documents"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average_length"))
    f = frequencies.agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
    d.crossJoin(f).withColumn("docid", F.lit(kind)).coalesce(1).write.parquet(f"{path}/statistics")  # one row each
    return Index(spark, path)


def inspected(index: Index, passages: DataFrame | None = None) -> DataFrame:
    """One row: documents, average_length, terms and postings of a written index, whether its tables agree with each other, and
    whether it holds as many documents as passages (null without them)."""
    s = index.statistics
    found = index.documents.agg(F.count("*").alias("documents"), F.round(F.avg("length"), 9).alias("average_length"), F.sum(F.size("terms")).alias("postings"))
    f = index.frequencies.agg(F.count("*").alias("terms"), F.sum("df").alias("_df"))
    source = F.lit(None).cast("boolean") if passages is None else F.lit(passages.count()) == F.col("documents")
    agree = (F.col("postings") == F.col("_df")) & (F.col("documents") == s["documents"]) & (F.col("terms") == s["terms"])
    return found.crossJoin(f).select("documents", "average_length", "terms", "postings", agree.alias("agree"), source.alias("complete"))


#: Indexes written by this process, by application, and the names, sizes and times of the files they were made from.
_WRITTEN: dict[tuple, Index] = {}


def of_files(passages: DataFrame) -> Index:
    """The index of passages read from files, in the shared folder; written again only if the files have changed."""
    spark = passages.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = []
    for name in sorted(passages.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        files.append((name, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, tuple(passages.columns), tuple(files))
    if key not in _WRITTEN:
        _WRITTEN[key] = write(passages, new_path(spark, "lexical-index"))
    return _WRITTEN[key]
