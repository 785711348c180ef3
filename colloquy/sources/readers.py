"""Readers of conversation, passage, label and ranking files. All read by Spark, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators.integrity import require_complete, require_unique
from . import schemas


def turns_a(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """JSON lists of turns, one path for each split, with gold ids and topic (the first titled passage's title up to ` [SEP] `)."""
    out = None
    for split, path in paths.items():
        part = spark.read.schema(schemas.TURNS_A).option("multiLine", True).json(path).select(F.lit(split).alias("split"), "*")
        out = part if out is None else out.unionByName(part)
    titled = F.filter("positive_ctxs", lambda c: F.coalesce(c["title"], F.lit("")) != "")
    return out.withColumns({"positive_ctx_passage_ids": F.transform("positive_ctxs", lambda c: c["passage_id"]), "topic": F.split(F.get(titled, 0)["title"], r" \[SEP\] ", 2)[0]})


def turns_b(spark: SparkSession, paths: dict[str, str], gold_only: bool = False) -> DataFrame:
    """JSON lists of renamed turns; empty answers, rewrites and passages fall through to their alternatives."""
    out = None
    for split, path in paths.items():
        part = spark.read.schema(schemas.TURNS_B).option("multiLine", True).json(path).select(F.lit(split).alias("split"), "*")
        out = part if out is None else out.unionByName(part)
    gold = F.when(F.size(F.coalesce("Truth_passages", F.array())) > 0, F.col("Truth_passages")).otherwise(F.coalesce("Passages", F.array()))
    named = out.select(
        "split", F.col("Conversation_no").alias("conv_id"), F.col("Turn_no").alias("turn_id"), F.col("Question").alias("question"), T.falsy_or(F.col("Truth_answer"), F.col("Answer")).alias("answers"),
        T.falsy_or(F.col("Truth_rewrite"), F.col("Rewrite")).alias("rewrite"), F.coalesce("Context", F.array()).alias("context"), F.col("Conversation_source").alias("conversation_source"), gold.alias("positive_ctx_passage_ids"), F.lit(False).alias("topic_switch"), F.lit(1).alias("topics_in_conversation"),
    )
    return named.where(F.size("positive_ctx_passage_ids") > 0) if gold_only else named


def passages_tsv(spark: SparkSession, path: str) -> DataFrame:
    """id, text, title of a tab-separated file with a header and quoted fields."""
    return spark.read.schema(schemas.PASSAGES_TSV).option("header", True).option("sep", "\t").option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def passages_json(spark: SparkSession, path: str) -> DataFrame:
    """id, text, raw_passage_id, title of JSON lines; text falls through to contents, then to empty; control characters are allowed."""
    raw = spark.read.schema(schemas.PASSAGES_JSON).option("allowUnquotedControlChars", True).json(path)
    return raw.select("id", T.falsy_or(F.col("text"), F.coalesce("contents", F.lit(""))).alias("text"), "raw_passage_id", "title")


def json_lines(spark: SparkSession, path: str, schema, unique: list[str] | None = None, torn_tail: bool = False) -> DataFrame:
    """JSON lines; blank lines are passed over and a broken line raises. torn_tail: a file's last line may be broken off, as a
    writer that was stopped leaves it, and goes; broken lines before it still raise. unique: a key that may not be null or repeat."""
    columns = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    lines = spark.read.text(path).select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("start")).where(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", columns.add("_broken", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    columns = StructType(columns.fields[:-1])
    broken = parsed.where("row._broken is not null")
    if torn_tail:
        tails = {}
        for file in [r[0] for r in broken.select("file_path").distinct().collect()]:  # a name for each damaged file
            whole = spark.read.option("wholetext", False).text(file).select(F.col("value"), F.monotonically_increasing_id().alias("_at")).where(F.trim("value") != "")
            tails[file] = whole.orderBy(F.col("_at").desc()).first()["value"]
        last = F.create_map(*[F.lit(x) for pair in tails.items() for x in pair])[F.col("file_path")] if tails else F.lit(None).cast("string")
        broken = broken.where(~F.coalesce(F.col("value") == last, F.lit(False)))
    if bad := broken.select("file_path", "value").head(1):
        raise ValueError(f"a broken line in {bad[0][0]}: {bad[0][1][:200]}")
    df = parsed.where("row._broken is null").select(*[F.col("row")[f.name].alias(f.name) for f in columns.fields])
    if unique:
        require_complete(require_unique(df, unique), unique)
    return df


def rankings(spark: SparkSession, path: str, wanted: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """query_id, rank, docid of JSON lines {query_id, docids}, gzipped or not; a repeated query or a wanted one that is missing raises."""
    rows = require_unique(spark.read.schema(schemas.RANKINGS).json(path), ["query_id"])
    if wanted is not None:
        if gone := wanted.select("query_id").distinct().join(rows, "query_id", "left_anti").head(1):
            raise KeyError(f"no ranking for {gone[0][0]}")
        rows = rows.join(wanted.select("query_id").distinct(), "query_id", "left_semi")
    out = rows.select("query_id", F.posexplode("docids").alias("i", "docid")).select("query_id", (F.col("i") + 1).alias("rank"), "docid")
    return out if k is None else out.where(F.col("rank") <= k)


def trec_run(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """query_id, rank, docid, score of `qid Q0 docid rank score tag` lines: a docid's first place by rank counts, ranks close up.

    Lines of other than six parts, ranks below 1, and a rank that repeats within a query raise.
    """
    parts = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("p"), "value")
    checked = parts.withColumn("p", F.when((F.size("p") == 6) & (F.expr("try_cast(p[3] as int)") >= 1), F.col("p")).otherwise(F.raise_error(F.concat(F.lit("not a run line: "), F.col("value"))).cast("array<string>")))
    rows = checked.select(F.col("p")[0].alias("query_id"), F.col("p")[3].cast("int").alias("rank"), F.col("p")[2].alias("docid"), F.col("p")[4].cast("double").alias("score"))
    require_unique(rows, ["query_id", "rank"])
    first = rows.groupBy("query_id", "docid").agg(F.min("rank").alias("_r"), F.min_by("score", "rank").alias("score"))
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_r"))).select("query_id", "rank", "docid", "score")
    return out if k is None else out.where(F.col("rank") <= k)


def query_bundle(spark: SparkSession, path: str, family: str, system: str, budget: int, views: list[str]) -> DataFrame:
    """Queries of one family, system, budget and some views; the predicate is part of the scan."""
    return spark.read.schema(schemas.QUERY_BUNDLE).json(path).where((F.col("family") == family) & (F.col("system") == system) & (F.col("budget") == budget) & F.col("view").isin(views))


def by_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of a table whose key is in ids."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def stripe(df: DataFrame, ordinal: str, stripes: int, number: int) -> DataFrame:
    """Every stripes-th row."""
    return df.where(F.pmod(F.col(ordinal), F.lit(stripes)) == number)


def shards(df: DataFrame, first: int, last: int, column: str = "shard_id") -> DataFrame:
    """A contiguous range of shards, by partition column; raises if one is missing."""
    part = df.where(F.col(column).between(first, last))
    if (n := part.select(column).distinct().count()) != last - first + 1:
        raise ValueError(f"{last - first + 1 - n} shards of {first} to {last} are missing")
    return part


def shard_summary(df: DataFrame, column: str = "shard_id", vector: str = "vector") -> DataFrame:
    """A row for each shard: rows, dimension, bytes of a flat float32 index of it with its 45-byte header, and whether it follows the last one."""
    g = df.groupBy(column).agg(F.count("*").alias("rows"), F.max(F.size(vector)).alias("dimension"), F.min(F.size(vector)).alias("_least"))
    follows = F.coalesce(F.lag(column).over(Window.orderBy(column)) == F.col(column) - 1, F.lit(True))  # a row for each shard
    return g.select(column, "rows", "dimension", (F.col("rows") * F.col("dimension") * 4 + 45).alias("bytes"), (F.col("_least") == F.col("dimension")).alias("even"), follows.alias("contiguous"))


def first_group(df: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of the group that comes first."""
    first = df.select(order, key).orderBy(order, key).limit(1).select(F.col(key).alias("_first"))
    return df.join(F.broadcast(first), F.col(key) == F.col("_first"), "left_semi")


def results_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """Some columns of delimited results with a header, by an explicit schema; a line that doesn't fit it raises."""
    df = spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    return df.select(*columns) if columns else df


def flat_shards(spark: SparkSession, path: str, first: int, last: int, docid: str = "bigint") -> DataFrame:
    """Vectors of a contiguous range of shards, in their order; a missing shard raises. Other shards aren't read."""
    return shards(spark.read.schema(f"docid {docid}, vector array<float>, place int, shard_id int").parquet(path), first, last)


def points(df: DataFrame, wanted: DataFrame, ordinal: str, key: str) -> DataFrame:
    """The rows at the wanted ordinals (columns ordinal and key); raises if one is missing or its key isn't the one expected."""
    found = wanted.select(ordinal, F.col(key).alias("_key")).join(df, ordinal, "left")
    if odd := found.where(~F.col(key).eqNullSafe(F.col("_key"))).head(1):
        raise KeyError(f"at {odd[0][ordinal]} stands {odd[0][key]}, not {odd[0]['_key']}")
    return found.drop("_key")
