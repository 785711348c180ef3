"""The corpus pipeline: quality, language, near duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all
but the last return the columns of documents, so that columns of other names, clashing ones
too, go with the first stage. Empty tables pass through; null texts are judged as empty; very
long texts are judged whole. Quality, language and tokens judge each row by itself, so ties and
repeated rows fare alike; in the others rows of one id stay or go together, and rows of null
ids stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe, decontaminate, language_id, near_dedup, quality
from colloquy.llm.common import fold, read, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less the rows of these ids; rows of null ids stay."""
    gone = table(ids.select("doc_id").distinct(), "pipeline-gone")
    return docs.join(decontaminate.small(gone), "doc_id", "left_anti").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels of its training fold, doesn't reject."""
    learn = fold("doc_id", quality.FOLDS) != quality.HELD_OUT
    model = quality.train(docs.select("doc_id", "text").where(learn), read(spark, sf_dir, "labels").where(learn))
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification doesn't reject: those with letters, near enough to a known language. Where no row that is
    learnt from names a language nothing can be told, and all rows stay."""
    model = language_id.trained(docs)
    if not model["names"]:
        return docs.select(*COLUMNS)
    return language_id.identify(docs.select(*COLUMNS), model).where("not rejected").select(*COLUMNS)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group (five words, similarity 0.8); rows of one id stay or go together."""
    groups = near_dedup.groups(docs.select("doc_id", "text"))
    return _without(docs, groups.where("not kept and doc_id is not null"))


def keep_clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands (windows of five-word shingles, similarity 0.8)."""
    return _without(docs, decontaminate.leaks(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark")))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (packed little-endian 32-bit integers) and text, decoded from them."""
    import public_tokenizers as public

    path = public.path("byte_bpe_50k.tiktoken")
    both = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, public.PATTERN, decoded="decoded")
    return both.select("doc_id", "lang", "source", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_duplicates", keep_one_of_copies), ("benchmark_leaks", keep_clean_of_benchmarks), ("tokens", to_tokens)]
#: Model fits and sampled seating have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
