"""Lexical and dense retrieval as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..llm.common import in_arrow
from ..session import new_path, table
from . import index
from .index import Index

K1, B = 0.9, 0.4
#: Distinct query terms, or query vectors, that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Scores are compared at so many decimals, so that equal ones tie.
DECIMALS = 6


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: the distinct terms of each query (query_id, query)."""
    return queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term"))


def as_index(corpus: DataFrame | Index) -> Index:
    """An index as it is, or one written of passages (docid, text)."""
    return corpus if isinstance(corpus, Index) else index.write(corpus, new_path(corpus.sparkSession, "lexical-index"))


def term_statistics(corpus: DataFrame | Index) -> DataFrame:
    """term, document_frequency and occurrences over all passages."""
    return as_index(corpus).frequencies.select("term", F.col("df").alias("document_frequency"), "occurrences")


def weight(tf: Column, length: Column, df: Column, documents: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    idf = F.log(1 + (documents - df + 0.5) / (df + 0.5))
    return idf * tf / (tf + k1 * (1 - b + b * length / average))


def weighted_postings(corpus: DataFrame | Index, wanted: DataFrame, k1: float = K1, b: float = B, docids: DataFrame | None = None) -> DataFrame:
    """docid, term and weight of the wanted terms (column term), in all passages or those of docids; postings of other terms never leave
    the scan, and those of other passages are not even listed."""
    found = as_index(corpus)
    s = found.statistics
    frequency = table(found.frequencies.join(bounded_broadcast(wanted.select("term").distinct()), "term", "left_semi").select("term", "df"), "frequencies")
    documents = found.documents
    if docids is not None:
        documents = documents.join(bounded_broadcast(table(docids.select(F.col("docid").cast(s["docid"]).alias("docid")).distinct(), "named-passages")), "docid", "left_semi")
    postings = documents.select("docid", "length", F.explode("terms").alias("t")).select("docid", "length", "t.term", "t.tf")
    joined = postings.join(bounded_broadcast(frequency), "term")
    return joined.select("docid", "term", weight(F.col("tf"), F.col("length"), F.col("df"), F.lit(s["documents"]), F.lit(s["average_length"] or 1.0), k1, b).alias("weight"))


def top_k(scored: DataFrame, k: int, descending_ids: bool = False) -> DataFrame:
    """query_id, rank, docid (as text), score: the k best of each query, ties by docid."""
    docid = F.col("docid").cast("string")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), docid.desc() if descending_ids else docid.asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", docid.alias("docid"), "score")


#: Rows of queries' terms that go to the executors at once.
TERM_ROWS = 4_000_000
#: In indexes of more passages than SEED_FROM, or where there are more pairs of queries and passages than SEED_PAIRS, one passage of
#: SEED_SHARE is scored first, SEED_ROWS in a task, or fewer to occupy all cores, but SEED_LEAST.
SEED_FROM, SEED_PAIRS, SEED_SHARE, SEED_ROWS, SEED_LEAST = 1_000_000, 1 << 30, 16, 20_000, 500


def bm25(queries: DataFrame, passages: DataFrame | Index, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """The k best passages (an index, or docid and text) of each query (query_id, query); queries without a matching passage have no rows.

    Queries of the same terms are searched once. They go out in blocks of about TERM_ROWS distinct terms in all, one pass over the index for
    each. A task scores BLOCK_ROWS passages at a time, passes over those that can't be among the k best of a query any more, and hands on the
    others' k best, so that pairs of queries and passages are never shuffled. Where there are many passages, or pairs, a share of the passages is scored first:
    a query's k-th best score there is a bound that its k best of all passages reach, from which every task then sets out. Scores are rounded
    before they are compared; ties go by docid, ascending.
    """
    found = as_index(passages)
    spark, s = found.spark, found.statistics
    listed = queries.select("query_id", F.array_sort(F.array_distinct(T.terms(F.col("query")))).alias("_terms")).where(F.size("_terms") > 0)
    named = table(listed.withColumn("_set", F.sha2(F.array_join("_terms", " "), 256)), "query-sets")
    one = table(named.groupBy("_set").agg(F.first("_terms").alias("_terms")).withColumn("_one", F.monotonically_increasing_id()), "query-numbers")
    asked = table(one.select(F.col("_one").alias("query_id"), F.explode("_terms").alias("term")), "query-terms")
    schema = f"query_id long, docid {s['docid']}, score double"
    blocks = -(-asked.count() // TERM_ROWS) or 1
    dealt = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    known = found.frequencies.join(bounded_broadcast(asked.select("term").distinct()), "term", "left_semi").select("term", "df")
    known = table(known, "frequencies")
    out, share = spark.createDataFrame([], schema), None
    if s["documents"] > SEED_FROM or s["documents"] * one.count() > SEED_PAIRS:
        share = found.documents.where(F.pmod(F.xxhash64("docid"), F.lit(SEED_SHARE)) == 0)
        size = s["documents"] // SEED_SHARE
        share = table(share.repartition(max(1, size // SEED_ROWS, min(spark.sparkContext.defaultParallelism, size // SEED_LEAST))), "passage-share")
    for block in range(blocks):
        rows = table(dealt.where(F.col("_block") == block).join(known, "term").select("query_id", "term", "df"), "block-terms")
        terms = rows.select("term", "df").distinct().toArrow()
        lists = rows.groupBy("query_id").agg(F.collect_list("term").alias("terms")).toArrow()  # TERM_ROWS, a tenth more or less
        if not lists.num_rows:
            continue
        ids, listed_, value_set = (t.column(c).combine_chunks() for t, c in ((lists, "query_id"), (lists, "terms"), (terms, "term")))
        place = pc.index_in(listed_.flatten(), value_set=value_set).to_numpy()
        of = pc.list_parent_indices(listed_).to_numpy()
        wanted = np.stack([of, place], axis=1).astype(np.int32)[np.lexsort((place, of))]
        df = terms.column("df").to_numpy().astype(float)
        idf = np.log(1 + (s["documents"] - df + 0.5) / (df + 0.5))
        shared = spark.sparkContext.broadcast((ids, wanted, value_set, idf, s["average_length"] or 1.0, k1, b))
        floor = None
        if share is not None:
            first = top_k(in_arrow(share, _lexical_best(shared, k), StructType.fromDDL(schema)), k)
            reached = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k).toArrow()  # a row for each query of the block
            start = np.full(len(ids), -np.inf)
            start[pc.index_in(reached.column("query_id"), value_set=ids).to_numpy()] = reached.column("score").to_numpy()
            floor = spark.sparkContext.broadcast(start)
        out = out.union(in_arrow(found.documents, _lexical_best(shared, k, floor=floor), StructType.fromDDL(schema)))
    best = table(top_k(out, k), "best")  # a search runs once, however often its hits are read
    return best.withColumnRenamed("query_id", "_one").join(named.join(one.select("_set", "_one"), "_set").select("query_id", "_one"), "_one").select("query_id", "rank", "docid", "score")


#: Postings of wanted terms that a task holds at once, weights that it holds as rows of frequent terms, scores that it adds up at once,
#: and hits that it hands on at once.
POSTINGS, ROW_CELLS, SCORE_CELLS, HANDED_ROWS = 4 << 20, 8 << 20, 1 << 18, 1 << 16


def _lexical_best(shared, k: int, block_rows: int = 20_000, postings: int = POSTINGS, floor=None):
    """The k best of every block of passages for each query, less those below the k best of a task's earlier blocks. wanted: rows of
    (query, term), in order of queries. floor: scores that each query's k best are known to reach.

    Weights of rare terms are added up by their postings; frequent terms have a row of weights. A query's frequent terms are added from the
    weightiest on until the rest of them can't lift a passage over the k best so far; for passages that still may, they are added one by one.
    """

    def run(batches):
        ids, wanted, term_set, idf, average, k1, b = shared.value
        first = np.searchsorted(wanted[:, 0], np.arange(len(ids) + 1))
        reached = np.full((len(ids), k), -np.inf)  # each query's k best scores, ascending
        if floor is not None:
            reached[:] = floor.value[:, None]
        held: list[tuple] = []

        def best():
            docids = pa.concat_arrays([d for d, *_ in held])
            n = len(docids)
            order = pc.sort_indices(docids.cast(pa.string())).to_numpy()
            at = np.empty(n, np.int32)
            at[order] = np.arange(n, dtype=np.int32)
            starts = np.cumsum([0, *[len(d) for d, *_ in held[:-1]]])
            doc = at[np.concatenate([s + d for s, (_, d, _, _) in zip(starts, held, strict=True)])]
            term = np.concatenate([t for *_, t, _ in held])
            weight = np.concatenate([w for *_, w in held])
            by_term = np.argsort(term, kind="stable")
            doc, weight = doc[by_term], weight[by_term]
            upto = np.searchsorted(term[by_term], np.arange(len(term_set) + 1))
            del term, by_term
            size = np.diff(upto)
            frequent = np.flatnonzero(size > n // 32)
            frequent = frequent[np.argsort(-size[frequent], kind="stable")][: max(1, ROW_CELLS // n)]
            row_of = np.full(len(term_set), -1)
            row_of[frequent] = np.arange(len(frequent))
            rows = np.zeros((len(frequent), n))
            for r, t in enumerate(frequent):
                rows[r, doc[upto[t] : upto[t + 1]]] = weight[upto[t] : upto[t + 1]]
            most = rows.max(axis=1) if len(frequent) else np.zeros(0)
            by_most = np.argsort(-most, kind="stable")  # rows are called by their place in this order
            most = most[by_most]
            row_of[frequent[by_most]] = np.arange(len(frequent))
            names, places, found, ready = [], [], [], 0

            def handed():
                of, where = pa.array(np.concatenate(names)), pa.array(order[np.concatenate(places)])
                return pa.RecordBatch.from_arrays([ids.take(of), docids.take(where), pa.array(np.concatenate(found))], names=["query_id", "docid", "score"])

            step = max(1, SCORE_CELLS // n)
            for begin in range(0, len(ids), step):
                end = min(begin + step, len(ids))
                of, term = wanted[first[begin] : first[end]].T
                line_of, rare = row_of[term], row_of[term] < 0
                many = size[term[rare]]  # the rare terms' postings of all these queries
                posting = np.arange(many.sum()) + np.repeat(upto[term[rare]] - np.cumsum(many) + many, many)
                cell = np.repeat((of[rare] - begin).astype(np.int64) * n, many) + doc[posting]
                scores = (np.bincount(cell, weight[posting], (end - begin) * n) if len(cell) else np.zeros((end - begin) * n)).reshape(end - begin, n)
                for q in range(begin, end):
                    score = scores[q - begin]
                    line = line_of[first[q] - first[begin] : first[q + 1] - first[begin]]
                    line = np.sort(line[line >= 0])
                    rest = np.cumsum(most[line][::-1])[::-1]
                    least = reached[q, 0] - 10.0**-DECIMALS
                    added = np.count_nonzero(rest >= least)
                    for row in by_most[line[:added]]:
                        score += rows[row]
                    if added < len(line):
                        near = np.flatnonzero(score >= least - rest[added] - 1e-9)
                    else:
                        near = np.flatnonzero(score >= least)
                    if not len(near):
                        continue
                    value = score[near]
                    for at_row, row in enumerate(by_most[line[added:]], added + 1):
                        value += rows[row][near]
                        if at_row < len(line):
                            keep = value >= least - rest[at_row] - 1e-9
                            near, value = near[keep], value[keep]
                    keep = (value > 0) & (value >= least)
                    near, value = near[keep], np.round(value[keep], DECIMALS)
                    bound = reached[q, 0] if len(value) <= k else max(reached[q, 0], np.partition(value, len(value) - k)[len(value) - k])
                    near, value = near[value >= bound], value[value >= bound]
                    top = np.argsort(-value, kind="stable")[:k]
                    if not len(top):
                        continue
                    reached[q] = np.sort(np.concatenate([reached[q], value[top]]))[-k:]
                    names.append(np.full(len(top), q))
                    places.append(near[top])
                    found.append(value[top])
                    ready += len(top)
                if ready >= HANDED_ROWS:
                    yield handed()
                    names, places, found, ready = [], [], [], 0
            if ready:
                yield handed()

        count = hits = 0
        for batch in batches:
            lists = batch.column("terms")
            flat = pc.list_flatten(lists)
            if batch.num_rows == 0:
                continue
            number = pc.index_in(flat.field("term"), value_set=term_set)
            hit = number.is_valid().to_numpy(zero_copy_only=False)
            parent = pc.list_parent_indices(lists).to_numpy()[hit].astype(np.int32)
            tf = flat.field("tf").to_numpy(zero_copy_only=False)[hit].astype(float)
            term = number.filter(number.is_valid()).to_numpy().astype(np.int32)
            length = batch.column("length").to_numpy(zero_copy_only=False)[parent]
            held.append((batch.column("docid").take(pa.array(np.arange(batch.num_rows))), parent, term, idf[term] * tf / (tf + k1 * (1 - b + b * length / average))))
            count, hits = count + batch.num_rows, hits + len(term)
            if count >= block_rows or hits >= postings:
                yield from best()
                held, count, hits = [], 0, 0
        if held:
            yield from best()

    return run


def term_weights(pairs: DataFrame, passages: DataFrame | Index) -> DataFrame:
    """query_id, docid, term and weight of each query term (0 if absent) in the one passage paired with it (query_id, query, docid)."""
    asked = table(query_terms(pairs), "query-terms")
    weights = weighted_postings(passages, asked, docids=pairs)
    wanted = pairs.select("query_id", "docid").join(asked, "query_id")
    return wanted.join(weights, ["docid", "term"], "left").select("query_id", "docid", "term", F.coalesce("weight", F.lit(0.0)).alias("weight"))


#: Bytes of query vectors that go to the executors at once, rows that are held against them at once, and scores that a task holds at once.
QUERY_BYTES, BLOCK_ROWS, TILE = 32 << 20, 20_000, 1 << 22


def dense(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """The k vectors (docid, vector) of largest inner product with each query (query_id, vector); ties by docid, descending.

    Queries go out in blocks of a fixed number of bytes, one pass over the vectors for each. A task holds BLOCK_ROWS rows
    against so many queries at once that their scores are TILE at most, and hands on its k best of each query; only those are shuffled. Null
    vectors are passed over; vectors of other lengths than the queries' raise.
    """
    spark, kind = vectors.sparkSession, vectors.schema["docid"].dataType.simpleString()
    asked = table(queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector")), "query-vectors")
    size = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    each = max(1, QUERY_BYTES // (8 * (size[1] or 1)))
    blocks = -(-size[0] // each) or 1
    dealt = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, docid {kind}, score double"
    rows = vectors.where("vector is not null").select("docid", F.col("vector").cast("array<double>").alias("vector"))
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        q = dealt.where(F.col("_block") == block).select("query_id", "vector").collect()  # QUERY_BYTES, a tenth more or less
        if q:
            shared = spark.sparkContext.broadcast((np.array([r["vector"] for r in q]), [r["query_id"] for r in q]))
            out = out.union(rows.mapInArrow(_best_of(shared, k), schema))
    return top_k(out, k, descending_ids=True)


def _best_of(shared, k: int, tile: int = TILE):
    def run(batches):
        asked, ids = shared.value
        asked_ids = pa.array(ids)
        held: list[pa.RecordBatch] = []

        def best():
            rows = pa.Table.from_batches(held).combine_chunks()
            docids = rows.column("docid").combine_chunks()
            order = pc.sort_indices(docids.cast(pa.string()), sort_keys=[("", "descending")]).to_numpy()
            flat = pc.list_flatten(rows.column("vector")).to_numpy()
            if len(flat) != rows.num_rows * asked.shape[1]:
                raise ValueError("vectors of unequal lengths")
            columns = flat.reshape(rows.num_rows, -1)[order].T
            step = max(1, tile // rows.num_rows)
            for at in range(0, len(ids), step):
                scores = np.round(asked[at : at + step] @ columns, DECIMALS)
                if k < rows.num_rows:  # the k best are among those that reach the k-th largest score
                    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                    near = [np.flatnonzero(row >= bound) for row, bound in zip(scores, least, strict=True)]
                else:
                    near = [np.arange(rows.num_rows)] * len(scores)
                top = [n[np.argsort(-row[n], kind="stable")[:k]] for row, n in zip(scores, near, strict=True)]
                names = pa.array(np.repeat(np.arange(at, at + len(top)), [len(t) for t in top]))
                yield pa.RecordBatch.from_arrays([asked_ids.take(names), docids.take(pa.array(order[np.concatenate(top)])), pa.array(np.concatenate([row[t] for row, t in zip(scores, top, strict=True)]))], names=["query_id", "docid", "score"])

        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield from best()
                held, n = [], 0
        if n:
            yield from best()

    return run


def distinct_queries(queries: DataFrame, form: Callable[[Column], Column] = T.normal_form) -> DataFrame:
    """query_norm, by the form of texts, and the least query_id that has it; empty queries go."""
    normed = queries.withColumn("query_norm", form(F.col("query"))).where("query_norm <> ''")
    return normed.groupBy("query_norm").agg(F.min("query_id").alias("query_id"), F.count("*").alias("queries"))


def fanned_out(queries: DataFrame, hits: DataFrame, form: Callable[[Column], Column] = T.normal_form) -> DataFrame:
    """Hits of distinct queries (query_id as distinct_queries gives it) for every query that shares their form."""
    norms = queries.select(F.col("query_id").alias("asked_id"), form(F.col("query")).alias("query_norm"))
    named = distinct_queries(queries, form).select("query_norm", "query_id")
    return norms.join(named, "query_norm").join(hits, "query_id").select(F.col("asked_id").alias("query_id"), "rank", "docid", "score")


def remapped(hits: DataFrame, mapping: DataFrame, k: int | None = None) -> DataFrame:
    """Hits with ids translated by mapping (docid, new_docid); the first of those that become one stays and ranks close up. A hit
    whose id has no translation raises."""
    known = F.when(F.col("new_docid").isNull(), F.raise_error(F.concat(F.lit("no translation of docid "), F.col("docid").cast("string"))).cast(mapping.schema["new_docid"].dataType)).otherwise(F.col("new_docid"))
    moved = hits.join(mapping, "docid", "left").withColumn("new_docid", known).groupBy("query_id", F.col("new_docid").alias("docid")).agg(F.min_by("score", "rank").alias("score"), F.min("rank").alias("_old"))
    out = moved.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_old"))).drop("_old")
    return out if k is None else out.where(F.col("rank") <= k)
