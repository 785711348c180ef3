"""Queries over turns, histories, topics, text and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conversation as C
from ..operators import integrity, metrics, retrieval, shapley, spans
from ..operators.statistics import value_shares
from ..session import read
from .bindings import TURNS, lexical_sql, samples, turns

#: Games of up to so many players are played through all coalitions.
ENUMERATED = 4

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@query(f"WITH {TURNS} SELECT sample_id, conv_id, turn_id, history_depth, sha256('dev' || chr(0) || conv_id || chr(0) || turn_id) AS hashed FROM samples")
def sample_ids(spark, d):
    return samples(spark, d).select("sample_id", "conv_id", "turn_id", "history_depth", T.hashed_id(F.col("split"), F.col("conv_id"), F.col("turn_id")).alias("hashed"))


@query(f"WITH {TURNS} SELECT conv_id, turn_id, question, answer FROM turns")
def conversation_turns(spark, d):
    return turns(spark, d).drop("split")


_UNIT = "'T' || h.turn_id || ' Q: ' || h.question || chr(10) || 'A: ' || h.answer || chr(10) || chr(10)"


@query(f"""WITH {TURNS} SELECT t.sample_id, string_agg({_UNIT}, '' ORDER BY h.turn_id) AS oldest_first, string_agg({_UNIT}, '' ORDER BY h.turn_id DESC) AS newest_first,
  count(*) AS history_turns FROM samples t JOIN turns h ON h.conv_id = t.conv_id AND h.turn_id < t.turn_id GROUP BY t.sample_id""")
def render_history(spark, d):
    h = C.with_history(samples(spark, d), 1)
    return h.select("sample_id", C.rendered("history").alias("oldest_first"), C.rendered("history", True).alias("newest_first"), F.size("history").cast("long").alias("history_turns"))


@query(f"""WITH {TURNS}, placed AS (SELECT t.sample_id, h.turn_id, length('' || h.turn_id) AS w, length(h.question) AS q, length(h.answer) AS a,
  coalesce(sum(length('' || h.turn_id) + length(h.question) + length(h.answer) + 11) OVER (PARTITION BY t.sample_id ORDER BY h.turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM samples t JOIN turns h ON h.conv_id = t.conv_id AND h.turn_id < t.turn_id)
  SELECT sample_id, turn_id, (before + w + 5)::INTEGER AS question_start, (before + w + 9 + q)::INTEGER AS answer_start FROM placed""")
def history_offsets(spark, d):
    h = C.with_history(samples(spark, d), 1)
    return h.select("sample_id", F.explode(C.field_offsets("history")).alias("f")).select("sample_id", "f.*")


@query(f"""WITH {TURNS} SELECT CASE WHEN history_depth = 0 THEN 'd00' WHEN history_depth = 1 THEN 'd01' WHEN history_depth <= 4 THEN 'd02_04' WHEN history_depth <= 6 THEN 'd05_06'
  WHEN history_depth <= 8 THEN 'd07_08' WHEN history_depth <= 10 THEN 'd09_10' WHEN history_depth <= 14 THEN 'd11_14' ELSE 'd15_plus' END AS bin, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM samples GROUP BY 1""")
def history_depth_bins(spark, d):
    s = samples(spark, d).withColumn("bin", T.bin_of(F.col("history_depth"), T.DEPTH_BINS)).where("bin is not null")
    return s.groupBy("bin").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"))


_TOPIC = "nullif(substr(regexp_extract(lower(question), '[a-z0-9]+'), 1, 1), '')"
_TOPICS = f"""{TURNS}, topic AS (SELECT *, {_TOPIC} AS topic FROM samples), firsts AS (SELECT *, CASE WHEN topic IS NOT NULL THEN min(turn_id) OVER (PARTITION BY conv_id, topic) END AS first FROM topic),
ids AS (SELECT *, CASE WHEN topic IS NOT NULL THEN dense_rank() OVER (PARTITION BY conv_id ORDER BY first NULLS LAST) END AS topic_id,
  coalesce(topic <> last_value(topic IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS topic_switch FROM firsts)"""


def _topics(spark, d):
    first = F.regexp_extract(F.lower("question"), "[a-z0-9]+", 0)
    return C.with_topics(samples(spark, d).withColumn("topic", F.when(first != "", F.substring(first, 1, 1))))


@query(f"""WITH {_TOPICS} SELECT sample_id, topic, topic_id, topic_switch, topic_id - 1 AS topic_switch_depth, coalesce(max(topic_id) OVER (PARTITION BY conv_id), 0) AS topics_in_conversation FROM ids""")
def topic_ids_switches(spark, d):
    return _topics(spark, d).select("sample_id", "topic", "topic_id", "topic_switch", "topic_switch_depth", "topics_in_conversation")


@query(f"""WITH {_TOPICS} SELECT sample_id, sum(topic_switch::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn_id)::BIGINT AS cumulative_switches FROM ids""")
def cum_topic_switches(spark, d):
    return _topics(spark, d).select("sample_id", "cumulative_switches")


@query(f"""WITH {_TOPICS}, c AS (SELECT conv_id, count(*) AS turns, count(DISTINCT topic) AS topics, sum(topic_switch::BIGINT) AS switches FROM ids GROUP BY 1)
  SELECT min(turns) AS least_turns, round_even(avg(turns), 2) AS mean_turns, max(turns) AS most_turns, round_even(avg(topics), 2) AS mean_topics, round_even(avg(switches), 2) AS mean_switches FROM c""")
def split_summary(spark, d):
    c = _topics(spark, d).groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("topic").alias("topics"), F.sum(F.col("topic_switch").cast("long")).alias("switches"))
    return c.agg(F.min("turns").alias("least_turns"), F.bround(F.avg("turns"), 2).alias("mean_turns"), F.max("turns").alias("most_turns"), F.bround(F.avg("topics"), 2).alias("mean_topics"), F.bround(F.avg("switches"), 2).alias("mean_switches"))


@query(f"""WITH {TURNS} SELECT t.sample_id, string_agg({_UNIT}, '' ORDER BY h.turn_id) AS kept FROM samples t JOIN turns h ON h.conv_id = t.conv_id AND h.turn_id < t.turn_id AND h.turn_id % 2 = 1 GROUP BY 1""")
def masked_history(spark, d):
    h = C.with_history(samples(spark, d), 1)
    mask = F.array_join(F.transform("history", lambda t, i: (F.lit(1) - i % 2).cast("string")), "")
    return h.withColumn("mask", mask).select("sample_id", C.rendered(C.masked("history", "mask")).alias("kept"))


@query(f"""WITH {TURNS} SELECT t.sample_id, string_agg(trim(h.question) || '|' || trim(h.answer), '|' ORDER BY h.turn_id) AS context FROM samples t JOIN turns h ON h.conv_id = t.conv_id AND h.turn_id < t.turn_id GROUP BY 1""")
def substituted_context(spark, d):
    c = C.with_substituted_context(samples(spark, d).withColumn("rewrite", F.lit("")))
    return c.where(F.size("context") > 0).select("sample_id", F.array_join("context", "|").alias("context"))


@query(f"""WITH {TURNS} SELECT sample_id, array_to_string({lexical_sql('question')}, ' ') AS terms, len({lexical_sql('question')}) AS n FROM samples""")
def lexical_tokens(spark, d):
    terms = T.lexical_terms(F.col("question"))
    return samples(spark, d).select("sample_id", F.array_join(terms, " ").alias("terms"), F.size(terms).cast("long").alias("n"))


_NORM = "trim(regexp_replace(replace(lower(question), 'ß', 'ss'), '\\s+', ' ', 'g'))"


@query(f"""WITH {TURNS} SELECT {_NORM} AS query_norm, min(sample_id) AS query_id, count(*) AS queries FROM samples WHERE {_NORM} <> '' GROUP BY 1""")
def normalize_query_dedup(spark, d):
    return retrieval.distinct_queries(samples(spark, d).select(F.col("sample_id").alias("query_id"), F.col("question").alias("query")))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS rough_tokens, length(text) AS chars FROM documents""")
def word_counts(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.size(T.words(t)).cast("long").alias("words"), T.rough_tokens(t).cast("long").alias("rough_tokens"), F.length(t).cast("long").alias("chars"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/?_p\\d+$', '') AS base, list_filter(string_split(regexp_replace(url, '[/:.]+', ' ', 'g'), ' '), lambda x: x <> '')[1] AS first_id FROM pages")
def id_normalisers(spark, d):
    p = read(spark, d, "pages")
    ids = T.docid_list(F.regexp_replace("url", "[/:.]+", " "))
    return p.select("page_id", T.base_passage(F.regexp_replace("url", "[?#].*$", "")).alias("base"), F.get(ids, 0).alias("first_id"))


@query(f"""WITH {TURNS} SELECT sample_id, CASE WHEN answer = '' THEN question ELSE answer END AS falsy, CASE WHEN trim(answer) <> '' THEN trim(answer) ELSE trim(question) END AS first_answer,
  CASE WHEN history_depth = 0 THEN question ELSE trim(answer) END AS direct FROM samples""")
def fallbacks(spark, d):
    q, a = F.col("question"), F.col("answer")
    return samples(spark, d).select("sample_id", T.falsy_or(a, q).alias("falsy"), T.first_nonempty(F.array(a, q)).alias("first_answer"), C.direct_query(a, q, F.col("history_depth")).alias("direct"))


@query(f"""WITH {TURNS}, f AS (SELECT sample_id, turn_id, 'question' AS field, question AS text FROM samples UNION ALL SELECT sample_id, turn_id, 'answer', answer FROM samples), s AS (SELECT * FROM f WHERE text <> ''),
  picked AS (SELECT sample_id, turn_id, CASE WHEN turn_id % 2 = 0 THEN 'question' ELSE 'answer' END AS field FROM samples)
  SELECT 'qa' AS granularity, s.* FROM s SEMI JOIN picked USING (sample_id, turn_id, field) UNION ALL SELECT 'turn', s.* FROM s SEMI JOIN picked USING (sample_id, turn_id)""")
def granularity_expansion(spark, d):
    s = samples(spark, d)
    picked = s.select("sample_id", "turn_id", F.when(F.col("turn_id") % 2 == 0, "question").otherwise("answer").alias("field"))
    return C.expanded(picked, s, "qa").select(F.lit("qa").alias("granularity"), "*").unionByName(C.expanded(picked, s, "turn").select(F.lit("turn").alias("granularity"), "*"))


# tokens of questions with tags: words of more than six letters are kept
_TOKENS = f"""{TURNS}, listed AS (SELECT sample_id, regexp_extract_all(question, '\\S+') AS words FROM samples),
tokens AS (SELECT sample_id, unnest(words) AS token, (generate_subscripts(words, 1) - 1)::INT AS index FROM listed),
tags AS (SELECT *, CASE WHEN length(token) <= 6 THEN 0 WHEN index % 3 = 0 THEN 1 ELSE 2 END AS tag, CASE WHEN length(token) <= 5 THEN 0 ELSE 2 END AS pred, length(token) % 4 - 1 AS score FROM tokens)"""


def _tags(spark, d):
    t = samples(spark, d).select("sample_id", F.posexplode(T.words(F.col("question"))).alias("index", "token"))
    n = F.length("token")
    return t.withColumns({"tag": F.when(n <= 6, 0).when(F.col("index") % 3 == 0, 1).otherwise(2), "pred": F.when(n <= 5, 0).otherwise(2), "score": n % 4 - 1})


_ISLANDS = """SELECT sample_id, min(index) AS start, max(index) + 1 AS "end" FROM (SELECT *, sum(opens) OVER (PARTITION BY sample_id ORDER BY index) AS run FROM
  (SELECT *, CASE WHEN coalesce(lag({tag}) OVER w, 0) = 0 {or_one} THEN 1 ELSE 0 END AS opens FROM tags WINDOW w AS (PARTITION BY sample_id ORDER BY index)) WHERE {tag} > 0) GROUP BY sample_id, run"""


@query(f"WITH {_TOKENS} {_ISLANDS.format(tag='tag', or_one='OR tag = 1')}")
def bio_spans(spark, d):
    return spans.tag_spans(_tags(spark, d), ["sample_id"])


@query(f"WITH {_TOKENS} {_ISLANDS.format(tag='pred', or_one='')}")
def binary_spans(spark, d):
    return spans.tag_spans(_tags(spark, d).select("sample_id", "index", F.col("pred").alias("tag")), ["sample_id"], begins=False)


@query(f"""WITH {_TOKENS}, c AS (SELECT count(*) FILTER (tag = pred AND tag <> 0) AS tp, count(*) FILTER (pred <> 0 AND tag <> pred) AS fp, count(*) FILTER (tag <> 0 AND tag <> pred) AS fn, count(*) FILTER (tag = pred) AS same, count(*) AS n FROM tags)
  SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round(coalesce(same / nullif(n, 0), 0), 9) AS accuracy FROM c""")
def token_prf(spark, d):
    return metrics.micro_prf(_tags(spark, d).select(F.col("tag").alias("gold"), "pred"))


@query(f"""WITH {_TOKENS}, l AS (SELECT tag AS label, 1 AS g, (tag = pred)::INT AS tp, 0 AS p FROM tags UNION ALL SELECT pred, 0, 0, 1 FROM tags), c AS (SELECT label, sum(g)::BIGINT AS support, sum(tp) AS tp, sum(p) AS predicted FROM l GROUP BY 1)
  SELECT label, support, round(coalesce(tp / nullif(predicted, 0), 0), 9) AS precision, round(coalesce(tp / nullif(support, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(predicted + support, 0), 0), 9) AS f1 FROM c""")
def class_prf(spark, d):
    return metrics.per_class_prf(_tags(spark, d).select(F.col("tag").alias("gold"), "pred"))


@query(f"""WITH {_TOKENS}, g AS ({_ISLANDS.format(tag='tag', or_one='OR tag = 1')}), p AS ({_ISLANDS.format(tag='pred', or_one='')}), c AS (SELECT (SELECT count(*) FROM g SEMI JOIN p USING (sample_id, start, "end")) AS tp,
  (SELECT count(*) FROM p ANTI JOIN g USING (sample_id, start, "end")) AS fp, (SELECT count(*) FROM g ANTI JOIN p USING (sample_id, start, "end")) AS fn)
  SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c""")
def span_prf(spark, d):
    return metrics.span_prf(bio_spans(spark, d), binary_spans(spark, d), ["sample_id", "start", "end"])


@query(f"""WITH {_TOKENS} SELECT sample_id, index, CASE WHEN tag > 0 THEN tag WHEN score > 0 THEN CASE WHEN coalesce(lag(tag > 0 OR score > 0) OVER (PARTITION BY sample_id ORDER BY index), false) THEN 2 ELSE 1 END ELSE 0 END AS relabel FROM tags""")
def hard_relabel(spark, d):
    return spans.relabelled(_tags(spark, d), ["sample_id"]).select("sample_id", "index", "relabel")


@query(f"""WITH {_TOKENS}, i AS (SELECT *, index - row_number() OVER (PARTITION BY sample_id ORDER BY index) AS island FROM tags WHERE tag > 0)
  SELECT sample_id, min(index) AS start, max(index) AS "end", string_agg(token, ' ' ORDER BY index) AS text FROM i GROUP BY sample_id, island""")
def adjacent_chunks(spark, d):
    return C.chunks(_tags(spark, d).where("tag > 0"), ["sample_id"])


@query(f"""WITH {_TOKENS}, s AS (SELECT sample_id, index, tag, sum(length(token) + 1) OVER (PARTITION BY sample_id ORDER BY index) AS "end", length(token) AS n FROM tags),
  k AS (SELECT *, "end" - n AS start, index - row_number() OVER (PARTITION BY sample_id ORDER BY index) AS island FROM s WHERE tag > 0),
  o AS (SELECT *, count(*) FILTER (WHERE tag = 1) OVER (PARTITION BY sample_id, island ORDER BY index) AS run FROM k)
  SELECT sample_id, min(start)::BIGINT AS start, max("end")::BIGINT AS "end" FROM o GROUP BY sample_id, island, run""")
def merged_char_spans(spark, d):
    """Spans of kept tokens under collapsed labels. (Tokens stand closer than the gap here; the SQL needs islands and beginnings only.)"""
    from pyspark.sql import Window

    end = F.sum(F.length("token") + 1).over(Window.partitionBy("sample_id").orderBy("index"))
    placed = _tags(spark, d).withColumn("end", end).withColumn("start", F.col("end") - F.length("token"))
    return spans.merged_char_spans(placed, ["sample_id"], "index", "tag", begins=1)


@query(f"""WITH {TURNS}, w AS (SELECT sample_id, conv_id, turn_id, regexp_extract_all(question, '\\S+')[1:32] AS q, regexp_extract_all(answer, '\\S+')[1:32] AS a FROM samples),
  h AS (SELECT t.sample_id, sum(len(o.q) + len(o.a)) AS n FROM w t JOIN w o ON o.conv_id = t.conv_id AND o.turn_id < t.turn_id GROUP BY 1), l AS (SELECT w.sample_id, 2 + len(w.q) + coalesce(h.n, 0) AS raw FROM w LEFT JOIN h USING (sample_id))
  SELECT sample_id, least(raw, 64)::INTEGER AS included, raw::INTEGER AS raw_length, raw > 64 AS truncated FROM l""")
def serialised_inputs(spark, d):
    h = C.with_history(samples(spark, d))
    return h.withColumn("s", spans.serialised("question", "history", 64)).select("sample_id", F.size("s.tokens").alias("included"), F.col("s.raw_length").alias("raw_length"), F.col("s.truncated").alias("truncated"))


@query(f"""WITH {TURNS}, l AS (SELECT sample_id, conv_id, turn_id, {lexical_sql('question')} AS terms FROM samples WHERE turn_id <= 4), n AS (SELECT conv_id, max(turn_id)::INT AS players FROM l GROUP BY 1),
  m AS (SELECT conv_id, players, unnest(range(0, (1 << players)::BIGINT))::INT AS mask FROM n), e AS (SELECT conv_id, turn_id::INT AS turn_id, unnest(terms) AS term FROM l),
  v AS (SELECT m.conv_id, players, mask, count(DISTINCT term) AS v FROM m LEFT JOIN e ON e.conv_id = m.conv_id AND (mask >> (e.turn_id - 1)) & 1 = 1 GROUP BY ALL),
  p AS (SELECT *, unnest(range(0, players)) AS player FROM v), o AS (SELECT a.conv_id, a.player, a.players, bit_count(a.mask) AS s, b.v - a.v AS gain FROM p a JOIN v b ON b.conv_id = a.conv_id AND b.mask = a.mask | (1 << a.player::INT) WHERE (a.mask >> a.player::INT) & 1 = 0)
  SELECT conv_id AS game, player::INT AS player, round(sum(gain * factorial(s::INT) * factorial((players - s - 1)::INT) / factorial(players)), 9) AS phi FROM o GROUP BY 1, 2""")
def shapley_exact(spark, d):
    """Worth of a set of a conversation's questions: their distinct lexical terms. Games of up to ENUMERATED questions go through all
    coalitions, longer ones through the closed form of coverage games. (The SQL states games of up to four.)"""
    s = samples(spark, d).select(F.col("conv_id").alias("game"), F.col("turn_id").cast("int").alias("t"), T.lexical_terms(F.col("question")).alias("terms"))
    games = s.groupBy("game").agg(F.max("t").alias("players"))
    masks = shapley.coalitions(games.where(F.col("players") <= ENUMERATED))
    terms = s.select("game", "t", F.explode("terms").alias("term"))
    inside = (masks["game"] == terms["game"]) & (F.expr("(mask & shiftleft(1, t - 1)) <> 0"))
    values = masks.join(terms, inside, "left").groupBy(masks["game"], "players", "mask").agg(F.count_distinct("term").alias("v"))
    long = s.join(games.where(F.col("players") > ENUMERATED).select("game"), "game", "left_semi").select("game", (F.col("t") - 1).alias("player"), "terms")
    return shapley.shapley(values).unionByName(shapley.coverage(long, long.select("game", "player", F.explode("terms").alias("term"))))


@query(f"WITH {TURNS} SELECT conv_id, sha256(string_agg(sample_id, chr(10) ORDER BY sample_id)) AS population, count(*) AS n FROM samples GROUP BY 1")
def population_hash(spark, d):
    return samples(spark, d).groupBy("conv_id").agg(integrity.population_hash("sample_id").alias("population"), F.count("*").alias("n"))


@query(f"""WITH {TURNS}, a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id) AS ordinal FROM samples), b AS (SELECT conv_id, conv_id || '_' || turn_id AS qid, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id) AS ordinal FROM samples)
  SELECT a.sample_id, a.ordinal, b.qid FROM a JOIN b USING (conv_id, ordinal)""")
def ordinal_join(spark, d):
    s = samples(spark, d)
    ids = s.select("conv_id", F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn_id").cast("string")).alias("qid"), F.col("turn_id").alias("t"))
    return integrity.ordinal_join(s, ids, "conv_id", "turn_id", "t").select("sample_id", F.col("ordinal").cast("long").alias("ordinal"), "qid")


@query(f"WITH {TURNS} SELECT conv_id || '_' || turn_id AS qid, sample_id, turn_id FROM samples")
def id_derived_join(spark, d):
    s = samples(spark, d)
    ids = s.select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn_id").cast("string")).alias("qid"))
    return integrity.id_derived_join(ids, s, "qid", "dev").select("qid", "sample_id", "turn_id")


@query(f"""WITH {TURNS}, s AS (SELECT sample_id, conv_id, turn_id, split_part(trim(question), ' ', 1) AS word FROM samples WHERE trim(question) <> ''), f AS (SELECT sample_id, conv_id, turn_id, question AS content FROM samples)
  SELECT s.sample_id, CASE WHEN position(s.word IN f.content) > 0 THEN 'exact' ELSE 'invalid' END AS status, position(s.word IN f.content) - 1 AS start FROM s JOIN f USING (sample_id)""")
def span_validation(spark, d):
    s = samples(spark, d).where(F.trim("question") != "")
    claimed = s.select("sample_id", F.lit(1).alias("span_id"), "turn_id", F.lit("question").alias("field"), F.lit("ENTITY").alias("label"), F.split(F.trim("question"), " ", 2)[0].alias("text"))
    fields = s.select("sample_id", "turn_id", F.lit("question").alias("field"), F.col("question").alias("content"))
    return spans.validated(claimed, fields).select("sample_id", "status", F.col("start").cast("long").alias("start"))


@query("SELECT role, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM conversations GROUP BY role")
def role_shares(spark, d):
    return value_shares(read(spark, d, "conversations"), "role")


@query()
def token_offsets(spark, d):
    """White-space tokens of every question with their places."""
    t = samples(spark, d).select("sample_id", F.explode(spans.tokens_with_offsets(F.col("question"))).alias("t"))
    return t.select("sample_id", "t.*")


@query()
def token_span_labels(spark, d):
    """Labels, BIO tags and taxonomy ids of every question's tokens under two overlapping spans."""
    s = samples(spark, d).withColumn("tokens", spans.tokens_with_offsets(F.col("question")))
    two = F.array(*[F.struct(F.lit(k).alias("span_id"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(label).alias("label")) for k, a, b, label in ((1, 0, 12, "ENTITY"), (2, 8, 20, "CONCEPT"))])
    s = s.withColumn("spans", two)
    return s.select("sample_id", F.to_json(spans.token_labels("tokens", "spans")).alias("labels"), F.array_join(spans.bio("tokens", "spans"), "").alias("bio"), F.array_join(spans.taxonomy_ids("tokens", "spans"), "").alias("taxonomy"))


@query()
def crf_paths(spark, d):
    """Best and sampled tag sequences of every question under scores from token lengths."""
    import numpy as np
    import pandas as pd

    from ..operators.spans import sampled_path, viterbi

    s = samples(spark, d).select("sample_id", F.transform(T.words(F.col("question")), lambda w: F.length(w)).alias("n")).where(F.size("n") > 0)

    def decode(batches):
        moves = np.array([[0.2, 0.0, -9.0], [0.0, -0.5, 0.6], [0.0, -0.5, 0.6]])
        for rows in batches:
            out = []
            for sample, n in zip(rows["sample_id"], rows["n"], strict=True):
                n = np.asarray(n, float)
                scores = np.stack([6 - n, n - 6, n - 6.5], axis=1) / 3
                uniforms = np.random.default_rng(int(n @ np.arange(1, len(n) + 1))).random(len(n))
                out.append((sample, "".join(map(str, viterbi(scores, moves))), "".join(map(str, sampled_path(scores, moves, uniforms)))))
            yield pd.DataFrame(out, columns=["sample_id", "best", "sampled"])

    return s.mapInPandas(decode, "sample_id string, best string, sampled string")


@query(f"""WITH {TURNS}, w AS (SELECT sample_id, len(regexp_extract_all(question, '\\S+')) AS n FROM samples), p AS (SELECT sample_id, n, unnest(range(0, n)) AS i FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY md5('control:' || sample_id || ':' || i)) AS place FROM p)
  SELECT sample_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS places FROM r WHERE place <= 5 GROUP BY sample_id""")
def random_token_control(spark, d):
    """Five places of each question's words, drawn by digests."""
    n = F.size(T.words(F.col("question")))
    s = samples(spark, d).withColumn("places", T.chosen_places(n, F.lit(5), F.lit("control"), F.col("sample_id")))
    return s.where(F.size("places") > 0).select("sample_id", F.array_join("places", ",").alias("places"))


@query(f"WITH {TURNS} SELECT sample_id, conv_id, '[\"dev\",\"' || conv_id || '\"]' AS cluster FROM samples")
def attached_metadata(spark, d):
    s = samples(spark, d)
    meta = s.select("sample_id", integrity.cluster_key("split", "conv_id").alias("cluster"))
    return integrity.attached(s.select("sample_id", "conv_id"), meta, "sample_id", ["cluster"])


@query(f"""WITH {_TOKENS} SELECT sample_id, index, tag > 0 AS teacher, score > 0 AS evidence, tag > 0 OR score > 0 AS target FROM tags""")
def united_targets(spark, d):
    t = _tags(spark, d)
    return spans.united_targets(t.select("sample_id", "index", (F.col("tag") > 0).alias("kept")), t.select("sample_id", "index", F.col("score").alias("score_raw")), ["sample_id", "index"])


@query(f"WITH {TURNS} SELECT sample_id, question FROM samples WHERE conv_id = (SELECT min(conv_id) FROM samples)")
def first_group_scan(spark, d):
    from ..sources.readers import first_group

    return first_group(samples(spark, d).select("sample_id", "conv_id", "question"), "conv_id", "conv_id").select("sample_id", "question")


@query()
def f1_bootstrap(spark, d):
    """Interval of the token F1, conversations drawn with replacement."""
    from ..operators.statistics import f1_bootstrap as bootstrap

    t = _tags(spark, d).select(F.regexp_extract("sample_id", ":(\\d+):", 1).alias("conv"), F.col("tag").alias("gold"), "pred")
    counts = metrics.micro_prf(t, 0, ["conv"]).withColumn("arm", F.lit("words"))
    return bootstrap(counts, "conv", ["arm"])
