"""Queries over entity candidates, refills, labels, collections, shards, comparisons and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates as M
from ..operators import conversation, index, labels, models, retrieval, statistics, studies
from ..session import new_path, read, table
from ..sources import readers, writers
from ..streaming import incremental
from .bindings import ASK, TURNS, asked_turns, indexed, lexical_sql, passages, samples
from .composites import ASKED, BUDGETS, _evaluated, _inputs_sql
from .masks import ENTITY_OVERLAP, ENTITY_RECENT, UNITS, S, entity_samples
from .search import GOLD, HITS, _asked, _gold, _view_hits, _vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _entity_samples(spark, d):
    return entity_samples(samples(spark, d).withColumn("depth", F.col("history_depth")))


_UNITS = f"{S}, {UNITS}"


@query(f"WITH {_UNITS} {ENTITY_OVERLAP}")
def cand_entity_overlap(spark, d):
    return M.entity_overlap(_entity_samples(spark, d))


@query(f"WITH {_UNITS} {ENTITY_RECENT}")
def cand_entity_recent(spark, d):
    return M.entity_recent(_entity_samples(spark, d))


@query(f"""WITH {_UNITS}, a AS (SELECT DISTINCT sample_id FROM units WHERE len(list_intersect(asked, said)) > 0) SELECT depth, count(*) AS samples, count(a.sample_id) AS anchored, round(count(a.sample_id) / count(*), 9) AS share FROM s LEFT JOIN a USING (sample_id) GROUP BY depth""")
def entity_anchor_coverage(spark, d):
    return M.entity_coverage(_entity_samples(spark, d), ["depth"])


_ROUGH = "len(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9_]+'))"


@query(f"""WITH {S}, h AS (SELECT t.sample_id, list({_ROUGH.format('h.question')} ORDER BY h.turn_id) AS q, list({_ROUGH.format('h.answer')} ORDER BY h.turn_id) AS a FROM s t JOIN s h ON h.conv_id = t.conv_id AND h.turn_id < t.turn_id GROUP BY 1)
  SELECT sample_id, {_ROUGH.format('question')} AS question_tokens, array_to_string(coalesce(q, []), ' ') AS question_lengths, array_to_string(coalesce(a, []), ' ') AS answer_lengths,
  array_to_string(list_transform(list_zip(coalesce(q, []), coalesce(a, [])), lambda x: x[1] + x[2]), ' ') AS turn_lengths, {_ROUGH.format('question')} + coalesce(list_sum(q), 0) + coalesce(list_sum(a), 0) AS conversation_tokens FROM s LEFT JOIN h USING (sample_id)""")
def length_features(spark, d):
    f = M.length_features(conversation.with_history(samples(spark, d)))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return f.select("sample_id", F.col("question_tokens").cast("long").alias("question_tokens"), joined("question_lengths"), joined("answer_lengths"), joined("turn_lengths"), F.col("conversation_tokens").cast("long").alias("conversation_tokens"))


@query(f"""WITH {S}, m AS (SELECT sample_id, depth, lpad(bin(unnest(range(1, (1 << depth::INT)::BIGINT))), depth::INT, '0') AS mask FROM s WHERE depth BETWEEN 2 AND 6), n AS (SELECT *, length(replace(mask, '0', '')) AS kept FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, kept ORDER BY mask) AS place, count(*) OVER (PARTITION BY sample_id, kept) AS total FROM n)
  SELECT sample_id, kept::INT AS kept, count(*) AS found, string_agg(mask, ' ' ORDER BY mask) AS masks FROM r WHERE place > 1 AND total > 1 GROUP BY ALL""")
def refill_masks(spark, d):
    """All masks of a number of kept turns but the first, which counts as tried, of histories of 2 to 6 turns."""
    s = samples(spark, d).select("sample_id", F.col("history_depth").cast("int").alias("depth")).where("depth between 2 and 6")
    needs = s.withColumn("kept", F.explode(F.sequence(F.lit(1), F.col("depth")))).withColumn("wanted", F.lit(64))
    tried = needs.select("sample_id", F.concat(F.repeat(F.lit("0"), F.col("depth") - F.col("kept")), F.repeat(F.lit("1"), F.col("kept"))).alias("mask"))
    return M.refilled(needs, tried).groupBy("sample_id", "kept").agg(F.count("*").alias("found"), F.array_join(F.array_sort(F.collect_list("mask")), " ").alias("masks"))


_LABELS = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 50 END AS prompt_tokens, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE quality END AS completion_tokens, toxic FROM labels"


def _teacher_rows(spark, d):
    p = F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 50).cast("int")
    c = F.when(F.col("doc_id") % 11 != 0, F.col("quality")).cast("int")
    meta = F.when(F.col("doc_id") % 13 != 0, F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens")))
    return read(spark, d, "labels").select("doc_id", meta.alias("teacher_metadata"), F.array_repeat(F.lit("bad"), F.col("toxic").cast("int")).alias("invalid_spans"))


@query(f"""WITH l AS ({_LABELS}), u AS (SELECT coalesce(sum(prompt_tokens) FILTER (doc_id % 13 <> 0), 0)::BIGINT AS p, coalesce(sum(completion_tokens) FILTER (doc_id % 13 <> 0), 0)::BIGINT AS c, count(*) AS n, sum(toxic)::BIGINT AS bad FROM l)
  SELECT n AS rows, 3 AS error_count, bad AS invalid_spans, p AS prompt_tokens, c AS completion_tokens, p + c AS total_tokens FROM u""")
def label_finalisation(spark, d):
    rows = _teacher_rows(spark, d)
    return labels.finalised(rows, read(spark, d, "labels").count(), 3)


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS place, lang, source, 'g' || (doc_id % 5) || ' g' || (doc_id % 5 + 5) AS gold FROM labels JOIN documents USING (doc_id)")
def label_alignment(spark, d):
    """Labels in an order of their own, with their documents and gold."""
    place = F.row_number().over(Window.orderBy(F.col("doc_id").desc())).cast("long")  # the labels of one evaluation
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id"), "doc_id", "left_semi").select(F.concat(F.lit("dev:"), F.col("doc_id").cast("string")).alias("sample_id"), "doc_id", place.alias("place"))
    docs = read(spark, d, "documents").select(F.concat(F.lit("dev:"), F.col("doc_id").cast("string")).alias("sample_id"), "lang", "source")
    gold = rows.select("sample_id", F.explode(F.array(*[F.concat(F.lit("g"), (F.col("doc_id") % 5 + k).cast("string")) for k in (5, 0)])).alias("docid"))
    return labels.aligned(rows, docs, gold, "dev:").select("doc_id", "place", "lang", "source", F.array_join("gold", " ").alias("gold"))


@query("""WITH a AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 10 <> 1), b AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE quality END AS quality, 1 - toxic AS toxic FROM labels WHERE doc_id % 10 <> 2)
  SELECT count(a.doc_id) AS left_rows, count(b.doc_id) AS right_rows, count(*) FILTER (b.doc_id IS NULL) AS left_only, count(*) FILTER (a.doc_id IS NULL) AS right_only, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.quality IS DISTINCT FROM b.quality) AS quality_differs,
  count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.toxic IS DISTINCT FROM b.toxic) AS toxic_differs FROM a FULL JOIN b USING (doc_id)""")
def label_disagreements(spark, d):
    l = read(spark, d, "labels").select("doc_id", "quality", "toxic")  # noqa: E741
    changed = l.where("doc_id % 10 <> 2").select("doc_id", F.when(F.col("doc_id") % 6 != 0, F.col("quality")).alias("quality"), (1 - F.col("toxic")).alias("toxic"))
    return labels.disagreements(l.where("doc_id % 10 <> 1"), changed, "doc_id", ["quality", "toxic"])


@query(rf"""WITH {TURNS}, w AS (SELECT sample_id, turn_id, regexp_extract_all(question, '\S+') AS ws FROM samples) SELECT sample_id, turn_id, array_to_string(list_filter(range(0, len(ws)), lambda i: length(ws[i + 1]) > 6), ' ') AS positions FROM w""")
def selected_positions(spark, d):
    tokens = samples(spark, d).select("sample_id", "turn_id", F.transform(T.words(F.col("question")), lambda w: F.when(F.length(w) > 6, F.array(F.lit("long"))).otherwise(F.array().cast("array<string>"))).alias("labels"))
    return tokens.select("sample_id", "turn_id", F.array_join(F.transform(labels.chosen_positions("labels"), lambda i: i.cast("string")), " ").alias("positions"))


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS id, source AS raw FROM documents), l AS (SELECT raw, max(id) AS id FROM n GROUP BY 1), g AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'no such' ELSE source END AS raw FROM documents)
  SELECT raw AS raw_passage_id, id::VARCHAR AS id, count(*) AS gold FROM g LEFT JOIN l USING (raw) GROUP BY ALL""")
def collection_ids(spark, d):
    """Documents numbered by source and id, and gold given by source names mapped to the last document of each."""
    docs = read(spark, d, "documents").select(F.col("source").alias("raw_passage_id"), "doc_id")
    numbered = writers.numbered_collection(docs, ["raw_passage_id", "doc_id"])
    gold = docs.select(F.col("doc_id").alias("sample_id"), F.when(F.col("doc_id") % 4 == 0, "no such").otherwise(F.col("raw_passage_id")).alias("raw_passage_id"))
    return writers.renumbered_gold(gold, numbered).groupBy("raw_passage_id", "id").agg(F.count("*").alias("gold"))


@query(f"WITH {HITS} SELECT query_id, rank, docid, score FROM hits")
def score_cache(spark, d):
    """Rankings and scores stored apart, held against each other."""
    hits = table(_view_hits(spark, d).select("query_id", "rank", F.col("docid").cast("string").alias("docid"), "score"), "hits")
    path = new_path(spark, "rankings")
    writers.write_rankings(hits, path)
    stored = writers.score_cache(spark, new_path(spark, "scores"), hits, readers.rankings(spark, path))
    return stored.select("query_id", F.col("rank").cast("long").alias("rank"), "docid", "score")


@query("""WITH d AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS n, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS k FROM documents)
  SELECT count(*) AS documents, round(avg(n), 9) AS average_length, (SELECT count(DISTINCT term) FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)) AS terms, sum(k)::BIGINT AS postings, sum(k) = (SELECT count(*) FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)) AS agree, count(*) = (SELECT count(*) FROM documents) AS complete FROM d""")
def index_status(spark, d):
    return index.inspected(indexed(spark, d), passages(spark, d))


@query("SELECT vec_id AS docid, (vec_id - first) // 100 AS shard_id, (vec_id - first) % 100 AS place FROM embeddings, (SELECT min(vec_id) AS first FROM embeddings) WHERE (vec_id - first) // 100 BETWEEN 1 AND 2")
def flat_shards(spark, d):
    """Vectors written as shards of a hundred; shards 1 and 2 read again."""
    path = new_path(spark, "shards")
    writers.write_flat_shards(_vectors(spark, d)[1], path, 100)
    found = readers.flat_shards(spark, path, 1, 2)
    return found.select("docid", F.col("shard_id").cast("long").alias("shard_id"), F.col("place").cast("long").alias("place"))


@query("SELECT event_id, value, '{\"type\":\"' || event_type || '\"}' AS cell FROM events")
def csv_roundtrip(spark, d):
    """Results written as delimited text, nested cells as JSON, and two of their columns and a cell read again."""
    path = new_path(spark, "csv")
    e = read(spark, d, "events").select("event_id", "user_id", "value", F.struct(F.col("event_type").alias("type")).alias("cell"))
    writers.write_csv(e, path)
    return readers.results_csv(spark, path, "event_id long, user_id long, value double, cell string", ["event_id", "value", "cell"])


@query("SELECT event_id, (event_id * event_id * 997)::BIGINT AS size, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1024 ** 2 THEN printf('%.1f KB', size / 1024) WHEN size < 1024 ** 3 THEN printf('%.1f MB', size / 1024 ** 2) WHEN size < 1024 ** 4 THEN printf('%.1f GB', size / 1024 ** 3) ELSE printf('%.1f TB', size / 1024 ** 4) END AS label FROM events")
def byte_sizes(spark, d):
    e = read(spark, d, "events").select("event_id", (F.col("event_id") * F.col("event_id") * 997).cast("long").alias("size"))
    return e.withColumn("label", T.byte_size(F.col("size")))


@query("SELECT event_id, [event_id::INT, -event_id::INT, 65536]::VARCHAR AS numbers, 12 AS bytes FROM events")
def packed_numbers(spark, d):
    """Lists of whole numbers packed and unpacked."""
    i = F.col("event_id").cast("int")
    e = read(spark, d, "events").select("event_id", T.packed_ints(F.array(i, -i, F.lit(65536))).alias("blob"))
    text = F.concat(F.lit("["), F.array_join(F.transform(T.unpacked_ints(F.col("blob")), lambda x: x.cast("string")), ", "), F.lit("]"))
    return e.select("event_id", text.alias("numbers"), F.octet_length("blob").alias("bytes"))


_PER = f"{ASKED}, per64 AS (SELECT * FROM per WHERE budget = 64)"


@query(f"""WITH {_PER}, t AS (SELECT conv_id, turn_id, sample_id, substr(regexp_extract(lower(coalesce(question, '')), '[a-z0-9]+') || '-', 1, 1) AS topic FROM samples WHERE conv_id % {ASK} = 0), f AS (SELECT sample_id, coalesce((topic <> lag(topic) OVER (PARTITION BY conv_id ORDER BY turn_id))::INT, 0) AS switched FROM t),
  b AS (SELECT sample_id, mrr AS base FROM per64 WHERE route = 'I') SELECT switched, route AS arm, count(*) AS n, round(avg(mrr), 9) AS mean, round(avg(mrr - base), 9) AS delta FROM per64 JOIN f USING (sample_id) JOIN b USING (sample_id) GROUP BY ALL""")
def topic_switch_groups(spark, d):
    """Routes compared among turns that change the topic and those that don't."""
    topic = F.substring(F.concat(F.regexp_extract(F.lower(F.coalesce("question", F.lit(""))), "[a-z0-9]+", 0), F.lit("-")), 1, 1)
    flags = studies.with_switch_flag(asked_turns(spark, d).withColumn("topic", topic), "topic", "conv_id", "turn_id").select("sample_id", "switched")
    values = _evaluated(spark, d).where("budget = 64").join(flags, "sample_id")
    return studies.by_group(values, "switched", "route", "mrr", ["sample_id"], "I").select(F.col("switched").cast("int").alias("switched"), "arm", "n", "mean", "delta")


@query(f"""WITH {_PER}, g AS (SELECT route, least(depth, 3) AS stratum, count(*) AS n, avg(mrr) AS m, coalesce(var_samp(mrr), 0) AS v FROM per64 GROUP BY ALL)
  SELECT route, stratum, n, round(n / sum(n) OVER (PARTITION BY route), 9) AS share, round(m, 9) AS mean, round(m - 1.96 * sqrt(v / n), 9) AS low, round(m + 1.96 * sqrt(v / n), 9) AS high FROM g""")
def structure_strata(spark, d):
    values = _evaluated(spark, d).where("budget = 64").withColumn("stratum", F.least(F.col("depth"), F.lit(3)).cast("long"))
    return studies.strata(values, "stratum", "mrr", ["route"])


@query(f"""WITH {_inputs_sql('TRUE')}, g AS (SELECT route AS granularity, budget, count(*) AS n, avg(len(tokens)) AS m FROM inputs GROUP BY ALL)
  SELECT a.granularity, a.budget, a.n, round(a.m, 9) AS mean, round(a.m - b.m, 9) AS delta, round((a.m - b.m) / nullif(b.m, 0), 9) AS change FROM g a JOIN g b ON b.budget = a.budget AND b.granularity = 'I'""")
def granularity_table(spark, d):
    from .composites import _all_inputs

    rows = _all_inputs(spark, d).select("sample_id", F.col("route").alias("granularity"), F.col("budget").cast("int").alias("budget"), F.size("tokens").alias("length"))
    return studies.granularities(rows, "I")


@query(f"""WITH {ASKED}, arms AS (SELECT route, budget, round(avg(mrr), 9) AS mrr, round(avg(mrr) - 1.96 * sqrt(coalesce(var_samp(mrr), 0) / count(*)), 9) AS low FROM per GROUP BY ALL)
  SELECT route, budget, mrr FROM arms WHERE route <> 'D' AND low > 0 ORDER BY mrr DESC, budget, list_position(['R', 'I'], route) LIMIT 1""")
def chosen_route(spark, d):
    """The admissible route and budget of the highest MRR whose interval lies above 0."""
    m = statistics.moments(_evaluated(spark, d), "mrr", ["route", "budget"])
    arms = m.select("route", F.col("budget").cast("int").alias("budget"), F.col("mean").alias("mrr"), "low", (F.col("route") != "D").alias("admissible"))
    return studies.chosen_model(arms, {"route": ["R", "I", "D"]}).select("route", "budget", "mrr")


@query("""WITH e AS (SELECT user_id, event_type, event_id % 4 AS epoch, avg(value) AS v FROM events GROUP BY ALL), f AS (SELECT event_type, min(epoch) AS epoch FROM e GROUP BY 1), b AS (SELECT event_type, user_id, v AS base FROM e JOIN f USING (event_type, epoch))
  SELECT epoch, event_type, count(*) AS n, round(avg(v), 6) AS mean, round(avg(v - base), 6) AS gain FROM e LEFT JOIN b USING (event_type, user_id) GROUP BY ALL""")
def training_trajectory(spark, d):
    """Users' mean values by a number standing for the epoch, and how they gain on the first."""
    e = read(spark, d, "events").groupBy("user_id", "event_type", (F.col("event_id") % 4).alias("epoch")).agg(F.avg("value").alias("v"))
    t = studies.trajectory(e, "epoch", "event_type", "v", ["user_id"])
    return t.withColumns({c: F.round(c, 6) for c in ("mean", "gain")})


@query(f"""WITH {_inputs_sql('TRUE')}, seg AS (SELECT 'dev' AS split, route AS segment_type, budget, len(tokens) AS in_bucket, least(len(tokens), 40) AS included, (SELECT len(t.tokens) FROM routed t WHERE t.sample_id = inputs.sample_id AND t.route = inputs.route) AS raw FROM inputs)
  SELECT split, segment_type, budget, count(*) AS count, min(raw) AS raw_least, round(avg(raw), 9) AS raw_mean, max(raw) AS raw_most, min(included) AS included_least, round(avg(included), 9) AS included_mean, max(included) AS included_most, round(avg(in_bucket / budget), 9) AS used_mean, round(max(in_bucket / budget), 9) AS used_most,
  round(avg((raw > in_bucket)::INT), 9) AS bucket_cut, round(avg((in_bucket > included)::INT), 9) AS input_cut FROM seg GROUP BY ALL""")
def segment_buckets(spark, d):
    """Route inputs as segments: cut to the budget by their bucket and to 40 tokens by the whole input."""
    from ..operators import routes

    h = conversation.with_history(samples(spark, d))
    whole = routes.inputs(h, [1 << 30]).select("sample_id", "route", F.size("tokens").alias("raw"))
    rows = routes.inputs(h, BUDGETS).select("sample_id", "route", "budget", F.size("tokens").alias("in_bucket")).join(whole, ["sample_id", "route"])
    seg = rows.select(F.lit("dev").alias("split"), F.col("route").alias("segment_type"), F.col("budget").cast("int").alias("budget"), F.col("raw").cast("long").alias("raw"), F.col("in_bucket").cast("long").alias("in_bucket"), F.least("in_bucket", F.lit(40)).cast("long").alias("included"))
    return studies.segment_report(seg)


@query(f"""WITH {HITS}, {GOLD}, f AS (SELECT DISTINCT sample_id, view FROM hits JOIN gold USING (sample_id, docid) WHERE rank <= 10), p AS (SELECT g.sample_id, coalesce((SELECT string_agg(view, '+' ORDER BY view) FROM f WHERE f.sample_id = g.sample_id), 'neither') AS pattern FROM (SELECT DISTINCT sample_id FROM gold) g) SELECT pattern, count(*) AS n FROM p GROUP BY 1""")
def candidate_fusion_patterns(spark, d):
    hits = _view_hits(spark, d).select(F.col("view").alias("list"), F.col("sample_id").alias("query_id"), "rank", F.col("docid").cast("string").alias("docid"))
    return studies.hit_patterns_of(hits, _gold(spark, d).withColumnRenamed("sample_id", "query_id"), ["D0", "D1"])


@query()
def topic_bootstrap(spark, d):
    """Intervals of questions' lengths among turns that change the topic and those that don't, each by itself."""
    named = samples(spark, d).withColumn("topic", F.regexp_extract(F.lower(F.coalesce("question", F.lit(""))), "[a-z0-9]+", 0))
    s = conversation.with_topics(named).select("sample_id", F.when(F.col("topic_switch"), "switch").otherwise("same").alias("topic"), F.coalesce(F.length("question"), F.lit(0)).cast("double").alias("n"))
    return statistics.stratified_bootstrap(s, "topic", "sample_id", "n", "topics")


@query()
def seeded_rewrites(spark, d):
    """A greedy and two seeded sampled rewrites of each asking question."""
    return models.sampled_rewrites(asked_turns(spark, d).select("sample_id", F.col("question").alias("input")))


def _streamed(spark, query_, schema):
    """The rows that a stream appends, written to files and read again."""
    path = new_path(spark, "streamed")
    query_.writeStream.format("parquet").option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(schema).parquet(path)


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS before, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_id FROM conversations) SELECT conv_id, turn_id::INT AS turn_id, before::INT AS depth, text AS question FROM m WHERE role = 'user'""")
def growing_dialogues(spark, d):
    """Messages arrive as a stream; each question goes out with the dialogue so far."""
    folder = new_path(spark, "messages")
    read(spark, d, "conversations").select("conv_id", "turn", "role", "text").write.parquet(folder)
    arriving = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(folder)
    found = _streamed(spark, incremental.growing_dialogues(arriving), incremental.DIALOGUE)
    return found.select("conv_id", "turn_id", "depth", "question")


@query("SELECT event_type, count(value) AS n, round(avg(value), 9) AS mean, round(stddev_pop(value), 6) AS deviation, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def streamed_moments(spark, d):
    """Moments of event values kept up to date over a stream of files."""
    folder, name = new_path(spark, "events"), f"moments_{new_path(spark, 'm')[-32:]}"
    read(spark, d, "events").select("event_type", "value").repartition(3).write.parquet(folder)
    arriving = spark.readStream.schema("event_type string, value double").option("maxFilesPerTrigger", 2).parquet(folder)
    running = incremental.running_moments(arriving, "value", ["event_type"])
    running.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()  # a row for each type
    return incremental.moments_of(spark.table(name), ["event_type"])


@query("SELECT event_id, event_type FROM events")
def streamed_log(spark, d):
    """Events that arrive in files, some of them twice, appended to a log once each."""
    folder, path = new_path(spark, "arriving"), new_path(spark, "log")
    e = read(spark, d, "events").select("event_id", "event_type")
    e.write.parquet(folder)
    e.where("event_id % 3 = 0").write.mode("append").parquet(folder)
    incremental.log_arriving(spark, folder, "event_id long, event_type string", path, "event_id", new_path(spark, "stream")).awaitTermination()
    writers.append_log(e.where("event_id % 5 = 0"), path, "event_id")
    return writers.read_log(spark, path, e.schema, "event_id")


@query("""WITH b AS (SELECT epoch_us(min(ts)) AS low, epoch_us(max(ts)) AS high FROM events), c AS (SELECT low + (high - low) // 2 AS cut, high FROM b),
  e AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, value FROM events, c WHERE NOT (event_id % 7 = 0 AND epoch_us(ts) < cut - 86400000000))
  SELECT window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM e, c WHERE epoch_us(window_start) + 3600000000 <= high - 600000000 GROUP BY ALL""")
def streamed_windows(spark, d):
    """Hourly counts of a stream that arrives in two halves of time. Every seventh event from over a day before the second half comes with that half,
    behind the watermark, and goes; every eleventh of the last ten minutes before it comes late too, within the watermark, and counts. Windows are written once
    the watermark has passed them."""
    e = read(spark, d, "events").where("ts is not null").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withColumn("us", F.unix_micros("ts"))
    low, high = e.agg(F.min("us"), F.max("us")).first()
    cut, day = (low or 0) + ((high or 0) - (low or 0)) // 2, 86_400_000_000
    late = ((F.col("event_id") % 7 == 0) & (F.col("us") < cut - day)) | ((F.col("event_id") % 11 == 0) & (F.col("us") >= cut - 600_000_000))
    first = (F.col("us") < cut) & ~late
    folder, out, checkpoint = new_path(spark, "halves"), new_path(spark, "windows"), new_path(spark, "stream")
    for half in (first, ~first):
        e.where(half).select("ts", "event_type", "value").write.mode("append").parquet(folder)
        found = incremental.windows_arriving(spark, folder, out, checkpoint)
    return found.withColumn("window_start", F.col("window_start").cast(read(spark, d, "events").schema["ts"].dataType))  # a watermark needs times with a zone
