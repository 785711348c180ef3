"""Steps that must not grow with the product of two tables, or hold more than a bounded part of one."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from colloquy.llm.common import BATCH_BYTES, BATCH_ROWS
from colloquy.operators import evidence, metrics, retrieval
from colloquy.operators.spans import TEXTS, tokens_with_offsets


def test_history_tokens_come_in_bounded_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    texts = [f"wort{n}  é zwei" if n % 3 else None for n in range(2 * TEXTS + 5)]
    rows = [(str(n), [(1, t, "")]) for n, t in enumerate(texts)]
    samples = spark.createDataFrame(rows, "sample_id string, history array<struct<turn_id: long, question: string, answer: string>>")
    found = evidence.history_tokens(samples)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= BATCH_BYTES
    got = {(r.sample_id, r.text, r.start, r.end) for r in found.collect()}
    assert got == {(str(n), t[a:b], a, b) for n, t in enumerate(texts) if t for a, b in ((0, t.index(" ")), (t.index("é"), t.index("é") + 1), (len(t) - 4, len(t)))}
    assert spark.range(0).select(tokens_with_offsets(F.lit("a"))).count() == 0


class Shared:
    def __init__(self, value):
        self.value = value


def test_lexical_search_passes_over_what_cannot_be_best():
    rng, n, k = np.random.default_rng(3), 3000, 5
    vocabulary = [f"t{v}" for v in range(60)]
    chance = np.array([0.6, 0.5, 0.4, *[0.02] * 57])
    terms = [[{"term": t, "tf": int(rng.integers(1, 4))} for t, c in zip(vocabulary, chance, strict=True) if rng.random() < c] for _ in range(n)]
    length = [sum(t["tf"] for t in listed) + 3 for listed in terms]
    df = np.array([sum(any(t["term"] == v for t in listed) for listed in terms) for v in vocabulary])
    idf, average = np.log(1 + (n - df + 0.5) / (df + 0.5)), float(np.mean(length))
    queries = [sorted(rng.choice(60, size, replace=False).tolist()) for size in (1, 2, 5, 20, 60)] + [[0], [0, 1, 2], [0, 7]]
    wanted = np.array([(q, t) for q, listed in enumerate(queries) for t in listed], np.int32)
    ids = [f"q{q}" for q in range(len(queries))]
    shared = Shared((pa.array(ids), wanted, pa.array(vocabulary), idf, average, 0.9, 0.4))
    docids = rng.permutation(n)
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    batches = [pa.RecordBatch.from_arrays([pa.array(docids[a : a + 100]), pa.array(length[a : a + 100], pa.int32()), pa.array(terms[a : a + 100], kind)], names=["docid", "length", "terms"]) for a in range(0, n, 100)]
    found = [r for b in retrieval._lexical_best(shared, k, block_rows=300, postings=10**9)(iter(batches)) for r in b.to_pylist()]
    number = {v: j for j, v in enumerate(vocabulary)}
    weights = [{number[t["term"]]: idf[number[t["term"]]] * t["tf"] / (t["tf"] + 0.9 * (1 - 0.4 + 0.4 * size / average)) for t in listed} for listed, size in zip(terms, length, strict=True)]
    for q, listed in enumerate(queries):
        every = [(-round(sum(w[t] for t in listed if t in w), 6), str(d)) for d, w in zip(docids, weights, strict=True) if any(t in w for t in listed)]
        got = sorted((-r["score"], str(r["docid"])) for r in found if r["query_id"] == f"q{q}")[:k]
        assert np.allclose([s for s, _ in got], [s for s, _ in sorted(every)[:k]]) and [d for _, d in got] == [d for _, d in sorted(every)[:k]], q
    assert len(found) < len(queries) * k * 10 * 0.8  # ten blocks


def test_gold_sets_that_queries_share_are_as_gold_of_each(spark):
    queries = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 3), ("e", None)], "query_id string, gold_set int")
    sets = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (2, "z")], "gold_set int, docid string")
    gold = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "z")], "query_id string, docid string")
    rows = [("a", 1, "y"), ("a", 2, "z"), ("b", 3, "x"), ("b", 1, "q"), ("c", 1, "x"), ("e", 1, "x")]
    hits = spark.createDataFrame(rows, "query_id string, rank int, docid string")
    one, two = (sorted(map(tuple, metrics.per_query(queries, hits, g, [1, 3]).collect())) for g in (gold, sets))
    assert one == two and len(one) == 5
    right = hits.where("rank > 1")
    each = [sorted(map(tuple, metrics.union_recall(g, hits, right, [1, 5], queries).collect())) for g in (gold, sets)]
    assert each[0] == each[1] and (5, "both", 1, 0.2) in each[0] and (1, "neither", 4, 0.8) in each[0] and len(each[0]) == 8
    assert not metrics.union_recall(gold.limit(0), hits, right, [1]).collect()
    # gold is looked up by set, never repeated for each query that shares it
    plan = metrics.judged(queries, hits, sets)[0]
    assert sorted(map(tuple, plan.collect())) == [("a", 2), ("b", 2), ("c", 1)]


def test_term_weights_list_the_named_passages_alone(spark):
    passages = spark.createDataFrame([(1, "red fox fox"), (2, "red hen"), (3, "hen hen")], "docid long, text string")
    wanted, named = spark.createDataFrame([("red",), ("hen",)], "term string"), spark.createDataFrame([(2,)], "docid long")
    every = {(r.docid, r.term): r.weight for r in retrieval.weighted_postings(passages, wanted).collect()}
    some = {(r.docid, r.term): r.weight for r in retrieval.weighted_postings(passages, wanted, docids=named).collect()}
    assert set(every) == {(1, "red"), (2, "red"), (2, "hen"), (3, "hen")} and some == {k: v for k, v in every.items() if k[0] == 2}


def test_a_share_of_the_passages_bounds_a_search(spark, monkeypatch):
    """What a share of the passages reaches leaves a search's hits as they are, and tasks then hand on far fewer."""
    passages = spark.range(600).selectExpr("id AS docid", "concat_ws(' ', 'all', concat('m', id % 7), concat('r', id % 41), repeat('x ', int(id % 5))) AS text").repartition(6)
    queries = spark.range(60).selectExpr("concat('q', id) AS query_id", "concat_ws(' ', 'all', concat('m', id % 7), concat('r', id % 41), 'x') AS query")
    found = retrieval.as_index(passages)
    whole = sorted(map(tuple, retrieval.bm25(queries, found, 3).collect()))
    monkeypatch.setattr(retrieval, "SEED_FROM", 100)
    monkeypatch.setattr(retrieval, "SEED_SHARE", 2)
    assert sorted(map(tuple, retrieval.bm25(queries, found, 3).collect())) == whole and len(whole) == 180
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([2] * 50, pa.int32()), pa.array([[{"term": "a", "tf": 1 + n % 9}] for n in range(50)], kind)], names=["docid", "length", "terms"])
    shared = Shared((pa.array(["q"]), np.array([[0, 0]], np.int32), pa.array(["a"]), np.array([1.0]), 2.0, 0.9, 0.4))
    rows = lambda **more: sum(b.num_rows for b in retrieval._lexical_best(shared, 10, **more)(iter([batch])))
    assert rows() == 10 and rows(floor=Shared(np.array([9 / 9.9]))) == 5


def test_a_search_of_many_queries_reads_the_index_once(spark, monkeypatch):
    """Some 580,000 terms of queries go out together: the index is read once, not once for each 400,000 of them."""
    reads, lexical = [], retrieval._lexical_best
    monkeypatch.setattr(retrieval, "_lexical_best", lambda *a, **b: reads.append(1) or lexical(*a, **b))
    passages = spark.createDataFrame([(n, f"t{n}") for n in range(3_000)], "docid long, text string")
    queries = spark.range(3_000).selectExpr("concat('q', id) AS query_id", "array_join(transform(sequence(0, 199), x -> concat('t', pmod(xxhash64(id, x), 3000))), ' ') AS query")
    retrieval.bm25(queries, passages, 1).count()
    assert len(reads) == 1


def test_an_index_counts_terms_as_spark_finds_them(spark):
    from colloquy.functions import text as T

    texts = ["B b a-1 K İstanbul straße", "", None, "zz9 ZZ9, zz9٣", "Éa 한글a"]
    passages = spark.createDataFrame(list(enumerate(texts)), "docid long, text string")
    want = {r.docid: sorted(r.t) for r in passages.select("docid", T.terms(F.col("text")).alias("t")).collect()}
    rows = retrieval.as_index(passages).documents.collect()
    assert {r.docid: [t.term for t in r.terms for _ in range(t.tf)] for r in rows} == want and all(r.length == len(want[r.docid]) for r in rows)
