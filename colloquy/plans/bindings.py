"""The driver's tables as the engine's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS
from ..operators import conversation, index
from ..operators.index import Index
from ..session import read

#: Searches ask with every row whose id is divisible by this, against all rows; some evaluations of routes and budgets ask with all.
ASK = 50


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.turns(read(spark, sf_dir, "conversations"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.with_sample_id(turns(spark, sf_dir))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("docid"), "text")


def indexed(spark: SparkSession, sf_dir: str) -> Index:
    """The lexical index of all documents, written once for these files."""
    return index.of_files(passages(spark, sf_dir))


def asked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the asking conversations with the previous turn's text."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn_id")
    before = F.concat_ws(" ", F.lag("question").over(w), F.lag("answer").over(w))
    return samples(spark, sf_dir).where(F.col("conv_id") % ASK == 0).withColumn("before", before)


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, view, query: D0 asks the question, D1 the question with the previous turn."""
    both = F.explode(F.array(F.struct(F.lit("D0").alias("view"), F.col("question").alias("query")), F.struct(F.lit("D1").alias("view"), F.trim(F.concat_ws(" ", "question", "before")).alias("query"))))
    return asked_turns(spark, sf_dir).select("sample_id", "conv_id", both.alias("v")).select("sample_id", "conv_id", "v.*")


#: SQL of the tables above, to be put before a query.
TURNS = """
numbered AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
turns AS (SELECT conv_id, n::BIGINT AS turn_id, max(text) FILTER (WHERE role = 'user') AS question, coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant'), '') AS answer FROM numbered WHERE n > 0 GROUP BY conv_id, n),
samples AS (SELECT 'dev:' || conv_id || ':' || turn_id AS sample_id, turn_id - 1 AS history_depth, * FROM turns)"""
VIEWS = f"""{TURNS},
asked AS (SELECT *, concat_ws(' ', lag(question) OVER w, lag(answer) OVER w) AS before FROM samples WHERE conv_id % {ASK} = 0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn_id)),
views AS (SELECT sample_id, conv_id, 'D0' AS view, question AS query FROM asked UNION ALL SELECT sample_id, conv_id, 'D1', trim(concat_ws(' ', question, before)) FROM asked)"""
STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS) + "]"


def lexical_sql(column: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[a-z0-9]+'), lambda x: length(x) > 1 AND NOT list_contains({STOP}, x))))"


def bm25_sql(queries: str, k: int = 10, name: str = "hits") -> str:
    """CTEs that end in `name` (query_id, rank, docid, score) for the query_id and query columns of a relation."""
    p = name
    return f"""
{p}_q AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(query, '')), '[a-z0-9]+'))) AS term FROM {queries}),
{p}_d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS terms FROM documents),
{p}_c AS (SELECT count(*) AS n, avg(len(terms)) AS average FROM {p}_d),
{p}_u AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM {p}_d),
{p}_p AS (SELECT doc_id, dl, term, count(*) AS tf FROM {p}_u WHERE term IN (SELECT term FROM {p}_q) GROUP BY ALL),
{p}_f AS (SELECT term, count(*) AS df FROM {p}_p GROUP BY term),
{p}_w AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / average)) AS weight FROM {p}_p JOIN {p}_f USING (term), {p}_c),
{p}_s AS (SELECT query_id, doc_id::VARCHAR AS docid, round(sum(weight), 6) AS score FROM {p}_w JOIN {p}_q USING (term) GROUP BY query_id, doc_id),
{name} AS (SELECT query_id, rank, docid, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, docid) AS rank FROM {p}_s) WHERE rank <= {k})"""
