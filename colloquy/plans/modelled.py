"""Queries over models that are trained here: sequences from a count model, and a selector of tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics, sampling, selector, spans
from ..session import table
from .bindings import TURNS, samples

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Conversations of every fifth number are held out.
HELD_OUT = 5


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


_WALK = r"""{turns}, w AS (SELECT sample_id, regexp_extract_all(lower(coalesce(question, '')), '\S+') AS words FROM samples),
pairs AS (SELECT unnest(list_zip(list_prepend('<s>', words), list_append(words, '</s>'))) AS p FROM w WHERE len(words) > 0),
model AS (SELECT p[1] AS before, p[2] AS word, count(*) AS n FROM pairs GROUP BY ALL), firsts AS (SELECT *, row_number() OVER (PARTITION BY before ORDER BY n DESC, word) AS rank, max(n) OVER (PARTITION BY before) AS most FROM model),
weighed AS (SELECT *, round({weight}, 12) AS weight FROM firsts WHERE rank <= {k}),
summed AS (SELECT *, sum(weight) OVER (PARTITION BY before) AS total, sum(weight) OVER (PARTITION BY before ORDER BY rank) AS upto FROM weighed),
kept AS (SELECT * FROM summed WHERE round(upto - weight, 9) < round({p} * total, 9)), scaled AS (SELECT *, round(upto / max(upto) OVER (PARTITION BY before), 9) AS high FROM kept),
options AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY before ORDER BY rank), 0) AS low, rank = max(rank) OVER (PARTITION BY before) AS final FROM scaled),
walk(sample_id, sample, place, last, words) AS (
  SELECT sample_id, unnest(range(1, {n} + 1)) AS sample, 0, coalesce(words[-1], '<s>'), []::VARCHAR[] FROM w
  UNION ALL SELECT d.sample_id, d.sample, d.place, coalesce(o.word, '</s>'), CASE WHEN coalesce(o.word, '</s>') = '</s>' THEN d.words ELSE list_append(d.words, o.word) END
  FROM (SELECT sample_id, sample, place + 1 AS place, last, words, ('0x' || substr(md5(concat_ws('|', '{seed}', sample_id, sample, place + 1)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM walk WHERE last <> '</s>' AND place < 8) d
  LEFT JOIN options o ON o.before = d.last AND o.low <= d.u AND (d.u < o.high OR o.final))
SELECT sample_id, sample::INT AS sample, array_to_string(arg_max(words, place), ' ') AS words FROM walk GROUP BY sample_id, sample"""


def _questions(spark, d):
    """sample_id and words, lower-cased, of every question."""
    return samples(spark, d).select("sample_id", "conv_id", T.words(F.lower(F.coalesce("question", F.lit("")))).alias("words"))


def _continued(spark, d, temperature: float, top_k: int, top_p: float, n: int, seed: str):
    asked = _questions(spark, d)
    model = table(sampling.successions(asked, F.col("words")), "successions")
    prompts = asked.select(F.col("sample_id").alias("sequence_id"), F.try_element_at("words", F.lit(-1)).alias("last"))
    found = sampling.sampled(prompts, sampling.choices(model, temperature, top_k, top_p), n, 8, seed)
    return found.select(F.col("sequence_id").alias("sample_id"), "sample", F.array_join("words", " ").alias("words"))


@query("WITH RECURSIVE " + _WALK.format(turns=TURNS, weight="1.0::DOUBLE", k=1, p="1.0", n=1, seed="greedy"))
def greedy_continuations(spark, d):
    """The likeliest words after each question, by how often words follow each other in all questions."""
    return _continued(spark, d, 0.0, 1, 1.0, 1, "greedy")


@query("WITH RECURSIVE " + _WALK.format(turns=TURNS, weight="(n / most) ** (1 / 0.8::DOUBLE)", k=20, p="0.9", n=3, seed="draws"))
def sampled_continuations(spark, d):
    """Three seeded continuations of each question: temperature 0.8, the 20 likeliest words, of them a nucleus of 0.9."""
    return _continued(spark, d, 0.8, 20, 0.9, 3, "draws")


def _tagged(spark, d):
    """sample_id, held_out, words, tags and features of every question; words that the answer repeats are to be kept, 1 begins a run of them."""
    fold = lambda w: F.regexp_replace(F.lower(w), r"(?U)\W+", "")
    s = samples(spark, d).select("sample_id", "conv_id", T.words(F.coalesce("question", F.lit(""))).alias("words"), F.array_distinct(F.transform(T.words(F.coalesce("answer", F.lit(""))), fold)).alias("said"))
    kept = s.withColumn("kept", F.transform("words", lambda w: (fold(w) != "") & F.array_contains("said", fold(w))))
    tags = F.transform("kept", lambda k, i: F.when(~k, 0).when((i > 0) & F.get("kept", i - 1), 2).otherwise(1))
    return kept.select("sample_id", (F.col("conv_id") % HELD_OUT == 0).alias("held_out"), "words", tags.alias("tags"), selector.token_features(F.col("words")).alias("features"))


def _spans(tagged, column: str):
    each = tagged.select("sample_id", F.posexplode(column).alias("index", "tag"))
    return spans.tag_spans(each, ["sample_id"])


def _selected(spark, d):
    tagged = table(_tagged(spark, d), "selector-questions")
    model = selector.train(tagged.where("not held_out"))
    return table(selector.selected(tagged.where("held_out").select("sample_id", "words", "tags", "features"), model).drop("features"), "selector-found")


@query()
def selector_spans(spark, d):
    """Runs of words (start, end, from 0) that the selector keeps of questions of held-out conversations."""
    return _spans(_selected(spark, d), "best").select("sample_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query()
def selector_f1(spark, d):
    """Span scores on held-out conversations of the trained selector, and of the rule that keeps words of more than six letters."""
    found = _selected(spark, d)
    long = F.transform("words", lambda w: F.when(F.length(w) > 6, 1).otherwise(0))
    ruled = found.withColumn("rule", F.transform(long, lambda k, i: F.when(k == 0, 0).when((i > 0) & (F.get(long, i - 1) == 1), 2).otherwise(1)))
    gold = _spans(found, "tags")
    out = None
    for name, column in (("selector", "best"), ("length rule", "rule")):
        part = metrics.span_prf(gold, _spans(ruled, column), ["sample_id", "start", "end"]).withColumn("system", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
