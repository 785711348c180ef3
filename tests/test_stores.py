"""Stores by key and the chain of inputs, rewrites and rankings."""

from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.session import new_path
from colloquy.sources.stores import KeyedStore, RewriteChain

SCHEMA = "query_id string, rank int, docid string, score double"


def rows(spark, *found):
    return spark.createDataFrame([(q, k + 1, d, 1.0 / (k + 1)) for q, docids in found for k, d in enumerate(docids)], SCHEMA)


def held(store):
    return sorted((r.query_id, r["rank"], r.docid) for r in store.rows().collect())


def test_batches_again_and_two_writers(spark):
    store = KeyedStore(spark, new_path(spark, "store"), SCHEMA, "query_id", 4)
    assert held(store) == [] and store.missing(rows(spark, ("a", "x")).select("query_id")).count() == 1
    first = rows(spark, ("a", "xy"), ("b", "z"))
    for _ in range(2):
        store.put(first, "2024-1")
    assert held(store) == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]
    # two writers saw neither's rows and both rank b; each key keeps one ranking, and none loses a key
    one, two = KeyedStore(spark, store.path, SCHEMA, "query_id", 4), KeyedStore(spark, store.path, SCHEMA, "query_id", 4)
    mine, other = rows(spark, ("b", "pq"), ("c", "r")), rows(spark, ("b", "s"), ("d", "t"))
    one.put(mine, "2024-2")
    two.put(other, "2024-3")
    one.put(mine, "2024-2")
    want = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "s"), ("c", 1, "r"), ("d", 1, "t")]
    assert held(store) == want
    store.compact("2024-4")
    assert held(store) == want and store.read().select("batch").distinct().count() == 1
    keys = spark.createDataFrame([("a",), ("nobody",)], "query_id string")
    assert sorted(r.docid for r in store.of(keys).collect()) == ["x", "y"] and [r[0] for r in store.missing(keys).collect()] == ["nobody"]


def test_a_changed_rewriter_and_a_changed_index(spark):
    chain = RewriteChain(spark, new_path(spark, "chain"), 4)
    asked = spark.createDataFrame([("1", "The Engine"), ("2", "The Engine"), ("3", "engine, the"), ("4", None), ("5", "steam words")], "request_id string, text string")
    calls = []

    def writer(fold):
        def run(inputs):
            calls.append(inputs.count())
            return inputs.select("input_key", fold(F.col("text")).alias("rewrite"))

        return run

    def search(queries, k):
        calls.append(queries.count())
        return queries.where("query <> 'nothing'").select("query_id", F.lit(1).alias("rank"), F.col("query").alias("docid"), F.lit(1.0).alias("score"))

    terms = lambda c: F.array_join(T.lexical_terms(c), " ")
    levels = lambda counts: {r.level: (r.asked, r.held, r.computed) for r in counts.collect()}
    named, hits, counts = chain.run(asked, writer(terms), "m1", search, "i1", 5, "b1")
    assert levels(counts) == {"inputs": (4, 0, 4), "rewrites": (4, 0, 4), "rankings": (2, 0, 2)} and calls == [4, 2]
    joined = {r.request_id: r.docid for r in named.join(hits, "ranking_key", "left").collect()}
    assert joined == {"1": "engine", "2": "engine", "3": "engine", "4": None, "5": "steam words"}
    assert levels(chain.run(asked, writer(terms), "m1", search, "i1", 5, "b2")[2]) == {"inputs": (4, 4, 0), "rewrites": (4, 4, 0), "rankings": (2, 2, 0)}
    # another rewriter: inputs stay, rankings stay for what it writes alike
    other = writer(lambda c: F.when(c.startswith("steam"), "nothing").otherwise(F.lower(F.regexp_extract(c, "(?i)engine", 0))))
    named, hits, counts = chain.run(asked, other, "m2", search, "i1", 5, "b3")
    assert levels(counts) == {"inputs": (4, 4, 0), "rewrites": (4, 0, 4), "rankings": (2, 1, 1)}
    assert {r.request_id: r.docid for r in named.join(hits, "ranking_key", "left").collect()}["5"] is None
    # a search without hits isn't made again; another index, or another k, ranks anew
    assert levels(chain.run(asked, other, "m2", search, "i1", 5, "b4")[2])["rankings"] == (2, 2, 0)
    assert levels(chain.run(asked, other, "m2", search, "i2", 5, "b5")[2])["rankings"] == (2, 0, 2)
    assert levels(chain.run(asked, other, "m2", search, "i2", 6, "b6")[2]) == {"inputs": (4, 4, 0), "rewrites": (4, 4, 0), "rankings": (2, 0, 2)}


def test_rankings_of_a_batch_again_and_of_two_writers(spark):
    from colloquy.sources.writers import RankingStore

    path = new_path(spark, "rankings")
    queries = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "")], "query_id string, query string")
    find = lambda q: q.where("query <> ''").select("query_id", F.lit(1).alias("rank"), F.col("query").alias("docid"), F.lit(1.0).alias("score"))
    one, two = RankingStore(spark, path, 2), RankingStore(spark, path, 2)
    pending = two.pending(queries)
    one.add(queries, find, "stream-1")
    two.store.put(find(pending), "late")  # saw an empty store, as a writer at the same time would
    two.store.put(find(queries), "late")
    one.add(queries, find, "stream-1")
    assert sorted((r.query_id, r.docid) for r in one.hits().collect()) == [("a", "x"), ("b", "y")]
    assert one.read().count() == 3 and one.pending(queries).count() == 0


def test_artefacts(spark):
    import pytest

    from colloquy.sources.artefacts import Artefacts

    a = Artefacts(spark, new_path(spark, "artefacts"))
    with pytest.raises(KeyError):
        a.read("t", {"seed": 1})
    df = spark.range(100).repartition(3)
    m = a.publish(df, "t", {"seed": 1})
    assert m["rows"] == 100 and len(m["files"]) == 3 and a.read("t", {"seed": 1}).count() == 100
    assert a.publish(spark.range(5), "t", {"seed": 1})["version"] == m["version"]  # kept as it is
    for call in (lambda: a.publish(df, "t", {"seed": 2}), lambda: a.read("t", {"seed": 2})):
        with pytest.raises(ValueError, match="was made from"):
            call()
    # a writer that died after its files, before the pointer, changes nothing
    df.write.parquet(f"{a.root}/t/torn/data")
    assert a.read("t", {"seed": 1}).count() == 100
    a._say(f"{a.root}/t/other/manifest.json", "{}")
    assert a.manifest("t", {"seed": 1})["version"] == m["version"]
    # a changed file, and one too many
    data = f"{a.root}/t/{m['version']}/data"
    spark.range(1).write.mode("append").parquet(data)
    with pytest.raises(ValueError, match="differ from its manifest"):
        a.read("t", {"seed": 1})
    assert a.read("t", {"seed": 1}, verify=False).count() == 101
    name = next(iter(m["files"]))
    b = Artefacts(spark, new_path(spark, "artefacts"))
    b.publish(df, "t", {})
    version = b.manifest("t", {})["version"]
    victim = next(iter(b.manifest("t", {})["files"]))
    b._say(f"{b.root}/t/{version}/data/{victim}", "not what was written")
    with pytest.raises(ValueError, match=victim):
        b.read("t", {})
    assert name != victim


def test_rows_by_ordinal(spark):
    import pytest

    from colloquy.sources import artefacts

    path = new_path(spark, "ordinals")
    artefacts.write_ordinals(spark.range(1000).select((F.lit(2000) - F.col("id")).alias("v")).repartition(7), [F.col("v")], path, 50)
    wanted = spark.createDataFrame([(0, "a"), (999, "b"), (120, "c"), (120, "d")], "ordinal long, why string")
    found = artefacts.at_ordinals(spark, path, wanted, 50)
    assert sorted((r.why, r.v) for r in found.collect()) == [("a", 1001), ("b", 2000), ("c", 1121), ("d", 1121)]
    scans = [line for line in found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if "PartitionFilters" in line]
    assert any("bucket" in line for line in scans)
    held = spark.read.parquet(path)
    assert held.where(F.col("bucket").isin(0, 2, 19)).inputFiles() and len(found.select("v").inputFiles()) >= 3
    files = spark.read.parquet(path).where(F.col("bucket").isin(0, 2, 19)).select(F.input_file_name()).distinct().count()
    assert files == 3 < held.select(F.input_file_name()).distinct().count() == 20
    for bad in (1000, None):
        with pytest.raises(Exception, match="no row at ordinal"):
            artefacts.at_ordinals(spark, path, spark.createDataFrame([(bad,)], "ordinal long"), 50).collect()


def test_split_bundle(spark):
    import random

    import pytest

    from colloquy.operators import splits

    rng = random.Random(6)
    rows = [(f"{c}:{k}", c, k, "deep" if k > 3 else "shallow") for c in range(80) for k in range(rng.randint(1, 8))]
    df = spark.createDataFrame(rows, "sample_id string, conv_id int, depth int, bin string")
    out = splits.bundle(df, ["deep", "shallow"], 5, {"validation": 40, "train": 100}, "s").collect()
    assert len(out) == len(rows)
    convs = {}
    for r in out:
        convs.setdefault(r.conv_id, set()).add(r.split)
    count = lambda name: sum(r.split == name for r in out)
    assert count("gate") == 10 and count("validation") == 40 and count("train") == 100 and count("rest") > 0
    assert all(len(s) == 1 or s == {"gate", "none"} for s in convs.values())
    with pytest.raises(ValueError):
        splits.bundle(df, ["deep"], 5, {"validation": 10_000}, "s")
