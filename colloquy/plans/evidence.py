"""Queries over gold passages' evidence in histories, and paired contrasts with their intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conversation, evidence, routes, studies
from ..session import read, table
from .bindings import TURNS, indexed, samples
from .composites import ASKED, BUDGETS, _all_inputs, _evaluated

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Pieces of a pair, and the tokenizer that the queries use.
PAIR_PIECES, TOKENIZER, OPENING, CLOSING = 512, "word_bpe_49k.json", "<|startoftext|>", "<|endoftext|>"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _judged(spark, d):
    """Samples with a history, and a gold passage for each by a rule that stands for judgements."""
    s = conversation.with_history(samples(spark, d), 1).select("sample_id", "conv_id", "turn_id", "question", "history")
    docs = read(spark, d, "documents").select("doc_id")
    size = docs.agg(F.max("doc_id") + 1).first()[0] or 1
    ruled = s.select("sample_id", F.pmod(F.col("conv_id") * 31 + F.col("turn_id") * 7, F.lit(size)).alias("doc_id"))
    return s, ruled.join(docs.distinct(), "doc_id").select("sample_id", F.col("doc_id").alias("docid"))


@query(rf"""WITH {TURNS}, g AS (SELECT s.*, d.doc_id FROM samples s JOIN (SELECT DISTINCT doc_id FROM documents) d ON d.doc_id = (s.conv_id * 31 + s.turn_id * 7) % (SELECT max(doc_id) + 1 FROM documents)),
  f AS (SELECT g.sample_id, g.doc_id, h.turn_id, unnest(['question', 'answer']) AS field, unnest([coalesce(h.question, ''), coalesce(h.answer, '')]) AS said FROM g JOIN turns h ON h.conv_id = g.conv_id AND h.turn_id < g.turn_id),
  m AS (SELECT *, regexp_extract_all(said, '\s*\S+') AS parts FROM f), u AS (SELECT sample_id, doc_id, turn_id, field, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM m),
  w AS (SELECT sample_id, doc_id, turn_id, field, regexp_extract(part, '\S+') AS text, sum(length(part)) OVER (PARTITION BY sample_id, turn_id, field ORDER BY i) AS upto FROM u),
  d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS terms FROM documents), c AS (SELECT count(*) AS n, avg(len(terms)) AS average FROM d),
  p AS (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM d), tf AS (SELECT doc_id, length, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  weights AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * length / average)) AS weight FROM tf JOIN df USING (term), c),
  t AS (SELECT sample_id, doc_id, turn_id, field, upto, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM w),
  s AS (SELECT sample_id, turn_id, field, upto, sum(weight) AS raw FROM t JOIN weights USING (doc_id, term) GROUP BY ALL),
  r AS (SELECT w.*, coalesce(raw, 0) AS raw FROM w LEFT JOIN s USING (sample_id, turn_id, field, upto))
  SELECT sample_id, doc_id AS docid, turn_id, field, (upto - length(text))::INT AS start, upto::INT AS "end", round(raw, 9) AS score_raw, round(CASE WHEN max(raw) OVER (PARTITION BY sample_id) > 0 THEN raw / max(raw) OVER (PARTITION BY sample_id) ELSE 0 END, 9) AS score_norm FROM r""")
def gold_token_scores(spark, d):
    """Every history token's BM25 weight in its sample's one gold passage, with its place, raw and by the sample's largest."""
    s, gold = _judged(spark, d)
    found = evidence.gold_token_scores(s, gold, indexed(spark, d))
    return found.select("sample_id", "docid", "turn_id", "field", "start", "end", "score_raw", "score_norm")


def _path():
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query()
def encoded_subwords(spark, d):
    """Questions and rendered histories as pieces of a tokenizer, 512 at most, with the pieces' places."""
    s = conversation.with_history(samples(spark, d), 1)
    e = evidence.encoded_history(s, _path(), PAIR_PIECES, OPENING, CLOSING, strict=False)
    joined = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), " ", "-"), 256).alias(c)
    return e.select("sample_id", F.size("piece_ids").alias("pieces"), "kept", joined("piece_ids"), joined("starts"), joined("ends"))


@query()
def evidence_pieces(spark, d):
    """Gold passages' token scores carried over to pieces: pieces of the history, those with evidence, and its sum."""
    s, gold = _judged(spark, d)
    s = table(s, "judged")
    e = evidence.encoded_history(s, _path(), PAIR_PIECES, OPENING, CLOSING, strict=False)
    p = evidence.piece_scores(e, evidence.gold_token_scores(s, gold, indexed(spark, d)), s)
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    return p.select("sample_id", F.size(F.filter("segments", lambda x: x == 1)).alias("pieces"), F.size(F.filter("scores", lambda x: x > 0)).alias("with_evidence"), F.round(total, 6).alias("evidence"))


#: Event types stand for systems, the last digit of an event's id by four for the epoch, and halves of the day for routes.
ENDPOINTS = {"view": 0, "click": 3, "purchase": 3}
COMPARISONS = {"purchase_minus_click": ("purchase", "click"), "click_minus_view": ("click", "view"), "purchase_minus_view": ("purchase", "view")}


def _endpoints(spark, d):
    half = F.when(F.hour("ts") < 12, "am").otherwise("pm").alias("route")
    e = read(spark, d, "events").where("user_id is not null").groupBy(F.col("event_type").alias("system"), (F.col("event_id") % 4).alias("epoch"), half, "user_id").agg(F.avg("value").alias("v"))
    return studies.endpoint_pairs(e, COMPARISONS, ENDPOINTS, "route", "user_id", "v", complete=False)


@query("""WITH e AS (SELECT event_type AS system, CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS route, user_id, avg(value) AS v FROM events WHERE user_id IS NOT NULL AND event_id % 4 = CASE event_type WHEN 'view' THEN 0 ELSE 3 END GROUP BY ALL HAVING avg(value) IS NOT NULL),
  c AS (SELECT * FROM (VALUES ('purchase_minus_click', 'purchase', 'click'), ('click_minus_view', 'click', 'view'), ('purchase_minus_view', 'purchase', 'view')) AS t(comparison, l, r))
  SELECT comparison, a.route, count(*) AS n, round(avg(a.v), 9) AS "left", round(avg(b.v), 9) AS "right", round(avg(a.v - b.v), 9) AS delta, count(*) FILTER (a.v > b.v) AS better, count(*) FILTER (a.v < b.v) AS worse, count(*) FILTER (a.v = b.v) AS equal
  FROM c JOIN e a ON a.system = l JOIN e b ON b.system = r AND b.route = a.route AND b.user_id = a.user_id GROUP BY ALL""")
def endpoint_contrasts(spark, d):
    """Users' mean values at the endpoints of three systems, two by two."""
    return studies.contrast_summary(_endpoints(spark, d), ["comparison", "route"])


@query()
def endpoint_intervals(spark, d):
    """endpoint_contrasts with the interval of each difference."""
    return studies.endpoint_contrasts(_endpoints(spark, d), "route", "user_id")


@query()
def paired_quality_intervals(spark, d):
    """Routes against route I at each budget, and budgets against each other, all from the same draws of all conversations."""
    m = _evaluated(spark, d, _all_inputs).select("sample_id", "conv_id", F.concat_ws("_", "route", F.col("budget").cast("string")).alias("cell"), F.col("mrr").alias("value"), F.lit("all").alias("design"))
    cells = [f"{r}_{b}" for r in routes.ROUTES for b in BUDGETS]
    pairs = {f"{r}_{b} - I_{b}": (f"{r}_{b}", f"I_{b}") for r in routes.ROUTES if r != "I" for b in BUDGETS}
    pairs |= {f"{r}_{BUDGETS[1]} - {r}_{BUDGETS[0]}": (f"{r}_{BUDGETS[1]}", f"{r}_{BUDGETS[0]}") for r in routes.ROUTES}
    return studies.design_contrasts(m, cells, pairs, ["sample_id"], "conv_id", ["design"]).drop("design")


@query()
def depth_strata_intervals(spark, d):
    """Routes' mean reciprocal ranks and differences to route I by bin of history depth; routes of a bin share their population and draws."""
    m = _evaluated(spark, d).where("budget = 64").select("sample_id", "conv_id", F.col("route").alias("cell"), F.col("mrr").alias("value"), T.bin_of(F.col("depth"), T.DEPTH_BINS).alias("bin"))
    return studies.design_contrasts(m, list(routes.ROUTES), {f"{r} - I": (r, "I") for r in routes.ROUTES if r != "I"}, ["sample_id"], "conv_id", ["bin"])
