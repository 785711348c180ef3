"""Published artefacts with manifests, and tables that are looked up by ordinal."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.statistics import preceding

#: Rows of a bucket of an ordinal table.
BUCKET_ROWS = 10_000


class Artefacts:
    """Tables under a folder, each in versions of its own: Parquet files, a manifest (identity, schema, rows, and size and SHA-256 of each file) and a
    pointer to the version that counts.

    A version is written beside the others, its manifest after its files and the pointer last, by a rename that replaces the old one at
    once. So a writer that dies leaves the last version as it was, and readers see one version or the other, whole.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()

    def _files(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def _said(self, path: str) -> str | None:
        if not self._files(path).exists(self._path(path)):
            return None
        return "\n".join(r[0] for r in self.spark.read.text(path).collect())  # a pointer or a manifest

    def _say(self, path: str, text: str) -> None:
        out = self._files(path).create(self._path(path), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _digests(self, path: str) -> dict[str, list]:
        """Size and SHA-256 of each data file, worked out where Spark reads them; a file is one that Spark wrote, a task's worth."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
        return {r[0].rsplit("/", 1)[1]: [r[1], r[2]] for r in found.select("path", "length", F.sha2("content", 256)).collect()}  # a row a file

    def publish(self, df: DataFrame, name: str, identity: dict) -> dict:
        """Writes df as the version of `name` that counts, and gives its manifest. identity: what it was made from. A name whose version has
        another identity is refused; of the same identity, the version that is there stays and nothing is written."""
        try:
            return self.manifest(name, identity)
        except KeyError:
            pass
        version = uuid.uuid4().hex
        path = f"{self.root}/{name}/{version}"
        df.write.parquet(f"{path}/data")
        files = self._digests(f"{path}/data")
        rows = self.spark.read.schema(df.schema).parquet(f"{path}/data").count()
        self._say(f"{path}/manifest.json", json.dumps({"identity": identity, "schema": df.schema.jsonValue(), "rows": rows, "files": files, "version": version}, sort_keys=True))
        self._point(name, version)
        return self.manifest(name, identity)

    def _point(self, name: str, version: str) -> None:
        jvm = self.spark._jvm
        new, pointer = f"{self.root}/{name}/{version}/pointer", f"{self.root}/{name}/current"
        self._say(new, version)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        option = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path(new), self._path(pointer), option)

    def manifest(self, name: str, identity: dict) -> dict:
        """The manifest of the version that counts. Raises KeyError where there is none, ValueError where it has another identity."""
        version = self._said(f"{self.root}/{name}/current")
        if version is None:
            raise KeyError(name)
        found = json.loads(self._said(f"{self.root}/{name}/{version}/manifest.json"))
        if found["identity"] != json.loads(json.dumps(identity)):
            raise ValueError(f"{name} was made from {found['identity']}, not {identity}")
        return found

    def read(self, name: str, identity: dict, verify: bool = True) -> DataFrame:
        """The table of a name. verify: hold its files against the manifest first; missing, further and changed ones raise ValueError."""
        found = self.manifest(name, identity)
        path = f"{self.root}/{name}/{found['version']}/data"
        if verify and (now := self._digests(path)) != found["files"]:
            odd = sorted(k for k in now.keys() | found["files"].keys() if now.get(k) != found["files"].get(k))
            raise ValueError(f"files of {name} differ from its manifest: {odd}")
        return self.spark.read.schema(StructType.fromJson(found["schema"])).parquet(path)


def write_ordinals(df: DataFrame, order: list[Column], path: str, rows: int = BUCKET_ROWS) -> None:
    """df with `ordinal`, each row's place from 0 in an order without ties, in a folder for every `rows` ordinals."""
    placed = preceding(df, [], order, F.lit(1).cast("bigint")).withColumnRenamed("_before", "ordinal")
    bucket = F.expr(f"ordinal div {rows}").cast("int")
    placed.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "ordinal").write.partitionBy("bucket").parquet(path)


def at_ordinals(spark: SparkSession, path: str, wanted: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """wanted (ordinal, ...) with the columns of the rows at these ordinals; only the buckets asked for are read. An ordinal beyond the table, or a null
    one, raises."""
    asked = wanted.withColumn("bucket", F.expr(f"ordinal div {rows}").cast("int"))
    buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # of the rows asked for
    held = spark.read.parquet(path).where(F.col("bucket").isin(buckets))
    found = asked.join(held.withColumn("_found", F.lit(True)), ["bucket", "ordinal"], "left")
    beyond = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no row at ordinal "), F.coalesce(F.col("ordinal").cast("string"), F.lit("null")))).cast("boolean")).otherwise(True)
    return found.where(beyond).drop("bucket", "_found")
