"""Sessions, the shared folder, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def session(name: str = "colloquy", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC times; conf adds to these."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the master is local and none is set."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="colloquy-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and lost executors lose nothing. by: a column whose values
    get folders of their own. The shuffle files of the writing go as soon as it is done."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(cleanup, before) if before is not None else spark.conf.unset(cleanup)
    schema = StructType([f for f in df.schema.fields if f.name != by] + [f for f in df.schema.fields if f.name == by])
    found = spark.read.schema(schema).parquet(path)
    found.written_to = path
    return found


def discard(df: DataFrame | None) -> None:
    """Deletes what table() wrote for df, which must not be read again."""
    if path := getattr(df, "written_to", None):
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
