"""The corpus pipeline's stages on rows of every kind, against what each is to do."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import language_id, quality

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def larger(sf_dir):
    return sf_dir.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def odd(spark, larger):
    """Rows of the tables with null, empty, repeated and very long ones, and columns whose names stages use themselves."""
    docs = spark.read.parquet(f"{larger}/documents.parquet").where("doc_id < 120")
    some = docs.orderBy("doc_id").limit(1).first()
    more = [(None, "no id here", "en", "s", 1), (900_001, None, "en", "s", 0), (900_002, "", None, None, 0), (some.doc_id, some.text, some.lang, some.source, some.n_chars), (900_003, "word " * 60_000, "en", "s", 300_000)]
    return docs.select(*corpus_pipeline.COLUMNS).union(spark.createDataFrame(more, SCHEMA)).withColumns({c: F.lit("mine") for c in ("score", "predicted", "lang_pred", "rejected", "kept", "component_id", "row", "size", "ids", "n_tokens")})


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows_and_empty_tables(spark, larger, odd, name):
    out = STAGES[name](spark, odd, larger)
    if name != "tokens":
        assert out.columns == corpus_pipeline.COLUMNS
        assert out.exceptAll(odd.select(*corpus_pipeline.COLUMNS)).count() == 0
    else:
        assert out.count() == odd.count() and set(out.columns) == {"doc_id", "lang", "source", "n_tokens", "ids", "text"}
        assert out.where("text <> coalesce(text, '') or n_tokens * 4 <> octet_length(ids)").count() == 0
    assert STAGES[name](spark, odd.limit(0), larger).count() == 0


def test_quality_and_language_stages_keep_what_their_operators_keep(spark, larger, odd):
    learn = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) != 1
    model = quality.train(odd.select("doc_id", "text").where(learn), spark.read.parquet(f"{larger}/labels.parquet").where(learn))
    texts = odd.select("doc_id", "text").collect()
    want = [(r.doc_id, r.text) for r in texts if quality.score_features(quality.features(r.text)[None, :], model)[0] >= 0.5]
    assert rows_of(STAGES["quality"](spark, odd, larger)) == sorted(want, key=str)
    kept = rows_of(STAGES["language"](spark, odd, larger))
    assert not {900_001, 900_002} & {i for i, _ in kept} and len(kept) > 60
    unnamed = odd.withColumn("lang", F.lit(None).cast("string"))
    assert STAGES["language"](spark, unnamed, larger).count() == odd.count()
    assert not language_id.trained(unnamed)["names"]


def test_copies_and_leaks_go_and_others_stay(spark, larger):
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    base, rows = [text(200) for _ in range(12)], []
    for k, words in enumerate(base):
        rows.append((k, " ".join(words)))
        if k % 3 == 0:
            rows.append((100 + k, " ".join(words).upper()))  # the same words
        if k % 3 == 1:
            rows.append((100 + k, " ".join([*words[:90], "changed", *words[91:]])))
        if k % 3 == 2:
            rows.append((100 + k, " ".join(text(100) + words[:100])))  # half of it alone
    items = [r.text for r in spark.read.parquet(f"{larger}/benchmark.parquet").limit(3).collect()]
    rows += [(500 + k, " ".join(text(50)) + " " + item + " " + " ".join(text(50))) for k, item in enumerate(items)]
    rows += [(None, "null id"), (600, None), (601, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    once = STAGES["near_duplicates"](spark, docs, larger)
    gone = {100 + k for k in range(12) if k % 3 != 2}
    assert rows_of(once) == sorted([(i, t) for i, t in rows if i not in gone], key=str)
    clean = STAGES["benchmark_leaks"](spark, once, larger)
    assert rows_of(clean) == sorted([(i, t) for i, t in rows if i not in gone | {500, 501, 502}], key=str)
