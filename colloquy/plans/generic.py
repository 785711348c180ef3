"""Queries that run the generic operators (joins, windows, summaries, reshaping, inference) over the larger tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import integrity, metrics, ranking, statistics
from ..session import read
from ..sources import readers, writers
from ..streaming.incremental import windowed_counts as counts_in_windows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@query("SELECT event_type, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.9), 9) AS p90, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99 FROM events GROUP BY event_type")
def quantile_summary(spark, d):
    return statistics.quantiles(read(spark, d, "events"), "value", ["event_type"], {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


@query("""WITH g AS (SELECT event_type, count(value) AS n, avg(value) AS m, coalesce(var_samp(value), 0) AS v, min(value) AS least, max(value) AS most FROM events GROUP BY 1)
  SELECT event_type, n, round(m, 6) AS mean, round(v, 6) AS variance, least, most, round(m - 1.96 * sqrt(v / n), 6) AS low, round(m + 1.96 * sqrt(v / n), 6) AS high FROM g""")
def moments(spark, d):
    m = statistics.moments(read(spark, d, "events"), "value", ["event_type"])
    return m.withColumns({c: F.round(c, 6) for c in ("mean", "variance", "low", "high")})


_P = "CASE WHEN event_type = 'error' THEN NULL ELSE round((event_id * 37 % 1000) / 1000, 3) END"


@query(f"""WITH p AS (SELECT event_id, user_id, {_P} AS p FROM events), r AS (SELECT *, coalesce(p, 1) * (count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY coalesce(p, 1)) + 1) AS raw FROM p)
  SELECT event_id, p, CASE WHEN p IS NOT NULL THEN round(least(1, max(raw) OVER (PARTITION BY user_id ORDER BY coalesce(p, 1))), 9) END AS holm FROM r""")
def holm_adjust(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") != "error", F.round(F.col("event_id") * 37 % 1000 / 1000, 3)).alias("p"))
    return statistics.holm(e, "p", ["user_id"]).select("event_id", "p", "holm")



def _student_sql(groups: str, by: str) -> str:
    """Intervals of a relation of `by` and value. The quantile is found by halving an angle x with t = sqrt(v) tan(x), whose
    probability within -t and t is a finite sum of powers of cos(x), one for odd and one for even degrees of freedom."""
    odd = "(x + sin(x) * cos(x) * list_sum(list_transform(range(0, greatest((v - 1) // 2, 0)), lambda k: exp(coalesce(list_sum(list_transform(range(1, k + 1), lambda j: ln(2.0 * j / (2 * j + 1)))), 0)) * cos(x) ** (2 * k)))) * 2 / pi()"
    even = "sin(x) * list_sum(list_transform(range(0, v // 2), lambda k: exp(coalesce(list_sum(list_transform(range(1, k + 1), lambda j: ln((2.0 * j - 1) / (2 * j)))), 0)) * cos(x) ** (2 * k)))"
    return f"""WITH RECURSIVE g AS (SELECT {by}, count(value) AS runs, avg(value) AS m, stddev_samp(value) AS sd, min(value) AS least, max(value) AS most FROM ({groups}) GROUP BY 1),
  halved AS (SELECT DISTINCT runs - 1 AS v, 0::DOUBLE AS low, pi() / 2 AS high, pi() / 4 AS x, 0 AS step FROM g WHERE runs > 1 UNION ALL
    SELECT v, low, high, (low + high) / 2, step + 1 FROM (SELECT v, step, CASE WHEN p < 0.95 THEN x ELSE low END AS low, CASE WHEN p < 0.95 THEN high ELSE x END AS high FROM (SELECT *, CASE WHEN v = 1 THEN x * 2 / pi() WHEN v % 2 = 1 THEN {odd} ELSE {even} END AS p FROM halved WHERE step < 52))),
  t AS (SELECT v, sqrt(v) * tan(x) AS t FROM halved WHERE step = 52), h AS (SELECT g.*, t * sd / sqrt(runs) AS half FROM g LEFT JOIN t ON v = runs - 1)
  SELECT {by}, runs, round(m, 6) AS mean, round(sd, 6) AS deviation, least, most, round(sd / m, 6) AS variation, round(m - half, 6) AS low, round(m + half, 6) AS high FROM h"""


def _rounded_interval(df, by):
    s = statistics.student_interval(df, "value", [by])
    return s.withColumns({c: F.round(c, 6) for c in ("mean", "deviation", "variation", "low", "high")})


@query(_student_sql("SELECT s_nationkey, s_acctbal AS value FROM supplier", "s_nationkey"))
def student_t_ci(spark, d):
    return _rounded_interval(read(spark, d, "supplier").select("s_nationkey", F.col("s_acctbal").alias("value")), "s_nationkey")


_SERIES = "floor((sqrt(8.0 * o_orderkey + 1) - 1) / 2)::BIGINT"


@query(_student_sql(f"SELECT least({_SERIES}, 60) AS series, o_totalprice::DOUBLE AS value FROM orders WHERE o_orderkey < 4000", "series"))
def student_t_runs(spark, d):
    """Intervals of series of growing numbers of runs: series n has up to n + 1 orders, the last one all further of the first orders."""
    o = read(spark, d, "orders").where("o_orderkey < 4000")
    series = F.least(F.floor((F.sqrt(8.0 * F.col("o_orderkey") + 1) - 1) / 2), F.lit(60)).cast("long")
    return _rounded_interval(o.select(series.alias("series"), F.col("o_totalprice").cast("double").alias("value")), "series")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS rolling FROM events")
def rolling_mean_100(spark, d):
    return statistics.rolling_mean(read(spark, d, "events"), "value", ["user_id"], ["event_id"]).select("event_id", "rolling")


@query("SELECT event_id, round(sum(value) OVER w, 6) AS running_sum, max(value) OVER w AS running_max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_totals(spark, d):
    return statistics.running(read(spark, d, "events"), "value", ["user_id"], ["event_id"]).select("event_id", "running_sum", "running_max")


@query("SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY lang")
def value_shares(spark, d):
    return statistics.value_shares(read(spark, d, "documents"), "lang")


@query("SELECT quality, count(*) AS n, round(sum(count(*)) OVER () / (2 * count(*)), 9) AS weight FROM labels WHERE quality IN (0, 1) GROUP BY quality")
def class_weights(spark, d):
    return metrics.balanced_weights(read(spark, d, "labels"), "quality", [0, 1])


_PAD = """SELECT '{name}' AS arrangement, source, count(*) AS batches, sum(t)::BIGINT AS tokens, sum(p)::BIGINT AS padded, round(1 - sum(t) / sum(p), 9) AS overhead FROM (SELECT source, b, sum(length) AS t, max(length) * count(*) AS p FROM
  (SELECT source, length, (row_number() OVER (PARTITION BY source ORDER BY {order}) - 1) // 16 AS b FROM l) GROUP BY ALL) GROUP BY source"""


@query(rf"WITH l AS (SELECT doc_id, source, len(regexp_extract_all(text, '\S+')) AS length FROM documents) {_PAD.format(name='as it comes', order='doc_id')} UNION ALL {_PAD.format(name='by length', order='length, doc_id')}")
def length_buckets_padding(spark, d):
    """Padding of batches of 16 documents of a source, as they come and by length."""
    lengths = read(spark, d, "documents").select("doc_id", "source", F.size(T.words(F.col("text"))).cast("long").alias("length"))
    plain = statistics.padding_report(lengths, 16, [F.col("doc_id")], ["source"]).select(F.lit("as it comes").alias("arrangement"), "*")
    return plain.unionByName(statistics.padding_report(lengths, 16, [F.col("length"), F.col("doc_id")], ["source"]).select(F.lit("by length").alias("arrangement"), "*"))


@query(r"""WITH l AS (SELECT lang, len(regexp_extract_all(text, '\S+')) AS n FROM documents) SELECT lang, count(*) AS documents, sum(n)::BIGINT AS tokens, min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most, round(quantile_cont(n, 0.9), 6) AS p90, round(avg((n > 384)::INT), 9) AS truncated FROM l GROUP BY lang""")
def corpus_length_stats(spark, d):
    lengths = read(spark, d, "documents").select("lang", F.size(T.words(F.col("text"))).cast("long").alias("n"))
    g = lengths.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.min("n").alias("least"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.round(F.avg((F.col("n") > 384).cast("int")), 9).alias("truncated"))
    ends = statistics.quantiles(lengths, "n", ["lang"], {"p90": 0.9})
    return statistics.matched(g, ends, ["lang"]).withColumn("p90", F.round("p90", 6))


@query(r"""WITH l AS (SELECT greatest(1, least(len(regexp_extract_all(text, '\S+')), 512)) AS n FROM documents), c AS (SELECT (n - 1) // 8 * 8 + 1 AS from_length, count(*) AS n FROM l GROUP BY 1)
  SELECT b.from_length, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(1, 513, 8)) AS from_length) b LEFT JOIN c USING (from_length)""")
def length_histogram(spark, d):
    return statistics.histogram(read(spark, d, "documents").select(F.size(T.words(F.col("text"))).cast("long").alias("length")), "length", 512, 8)


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def anti_join_pending(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT source, count(*) AS labelled FROM documents SEMI JOIN labels USING (doc_id) GROUP BY source")
def semi_join_filter(spark, d):
    return readers.by_ids(read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("labelled"))


@query("SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def validated_left_join(spark, d):
    customers = read(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    joined = integrity.validated_join(read(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_totalprice"), customers, ["custkey"])
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH a AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_regionkey END AS k, n_name FROM nation), b AS (SELECT r_regionkey AS k, r_name FROM region UNION ALL SELECT NULL, 'NONE')
  SELECT n_name, r_name FROM a LEFT JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def null_safe_join(spark, d):
    """Nations with some regions unset, which match the region without a key."""
    a = read(spark, d, "nation").select(F.when(F.col("n_nationkey") % 5 != 0, F.col("n_regionkey")).alias("k"), "n_name")
    b = read(spark, d, "region").select(F.col("r_regionkey").alias("k"), "r_name").union(spark.range(1).select(F.lit(None).cast("long"), F.lit("NONE")))
    return integrity.null_safe_join(a, b, "k").select("n_name", "r_name")


@query("""WITH g AS (SELECT event_type, hour FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(range(0, 24)) AS hour)), c AS (SELECT event_type, hour(ts) AS hour, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, hour::INT AS hour, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (event_type, hour)""")
def zero_filled_grid(spark, d):
    e = read(spark, d, "events").select("event_type", F.hour("ts").alias("hour"))
    grid = e.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return grid.join(e.groupBy("event_type", "hour").agg(F.count("*").alias("n")), ["event_type", "hour"], "left").na.fill(0, ["n"])


@query("""SELECT o_orderstatus, metric, value FROM (SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(max(o_totalprice), 4) AS most FROM orders GROUP BY 1) UNPIVOT (value FOR metric IN (mean, most))""")
def melt_pivot(spark, d):
    g = read(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.max("o_totalprice"), 4).alias("most"))
    return g.unpivot("o_orderstatus", ["mean", "most"], "metric", "value")


@query("""SELECT lang, coalesce(count(*) FILTER (quality = 0), 0) AS low, coalesce(count(*) FILTER (quality = 1), 0) AS high FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def pivot_zero_fill(spark, d):
    j = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id")
    return j.groupBy("lang").pivot("quality", [0, 1]).count().na.fill(0).withColumnsRenamed({"0": "low", "1": "high"})


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    return read(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def best_row_per_group(spark, d):
    return ranking.best_row(read(spark, d, "orders"), ["o_custkey"], F.col("o_totalprice").desc(), F.col("o_orderkey").asc()).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def revenue_by_nation(spark, d):
    part = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    return part.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    return counts_in_windows(read(spark, d, "events"))


@query("""SELECT event_type, round(avg(CAST(json_extract_string(props, '$.k') AS BIGINT)), 6) AS mean, count(DISTINCT json_extract_string(props, '$.k')) AS distinct_keys FROM events GROUP BY 1""")
def json_properties(spark, d):
    k = F.from_json("props", "k long")["k"]
    return read(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(k), 6).alias("mean"), F.count_distinct(k).alias("distinct_keys"))


_SHARDS = "SELECT CASE WHEN vec_id % 5 = 4 THEN 6 ELSE vec_id % 5 END AS shard_id, CASE WHEN vec_id % 10 = 3 THEN embedding[1:8] ELSE embedding END AS vector FROM embeddings"


@query(f"""WITH v AS ({_SHARDS}), g AS (SELECT shard_id, count(*) AS rows, max(len(vector)) AS dimension, count(DISTINCT len(vector)) = 1 AS even FROM v GROUP BY 1)
  SELECT shard_id, rows, dimension, rows * dimension * 4 + 45 AS bytes, even, NOT EXISTS (SELECT 1 FROM g f WHERE f.shard_id < g.shard_id) OR EXISTS (SELECT 1 FROM g f WHERE f.shard_id = g.shard_id - 1) AS contiguous FROM g""")
def shard_summary(spark, d):
    """Shards 0 to 3 and 6; some vectors of shard 3 are cut short."""
    shard = F.when(F.col("vec_id") % 5 == 4, 6).otherwise(F.col("vec_id") % 5).cast("long")
    v = read(spark, d, "embeddings").select(shard.alias("shard_id"), F.when(F.col("vec_id") % 10 == 3, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("vector"))
    return readers.shard_summary(v).withColumn("dimension", F.col("dimension").cast("long"))


@query("SELECT doc_id::VARCHAR AS id, trim(source || ' ' || text) AS contents FROM documents")
def collection_sink(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text")
    return writers.collection(docs)


@query("SELECT doc_id, lang, (doc_id % 7)::INT AS stripe FROM documents")
def striped_scan(spark, d):
    """All seven stripes of a table, each scanned by itself."""
    docs = read(spark, d, "documents").select("doc_id", "lang")
    out = None
    for k in range(7):
        part = readers.stripe(docs, "doc_id", 7, k).withColumn("stripe", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT lang, count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def distinct_counts(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("source").alias("sources"))


@query("SELECT doc_id, coalesce(quality, -1) AS value, CASE WHEN quality IS NULL THEN 'default' ELSE 'labels' END AS origin FROM documents LEFT JOIN labels USING (doc_id)")
def priority_lookup(spark, d):
    first = read(spark, d, "labels").select("doc_id", F.col("quality").alias("value"), F.lit("labels").alias("origin"))
    rest = read(spark, d, "documents").select("doc_id", F.lit(-1).alias("value"), F.lit("default").alias("origin"))
    return writers.by_priority([first, rest], "doc_id").join(read(spark, d, "documents").select("doc_id"), "doc_id", "left_semi")


@query("SELECT user_id, CASE WHEN event_type = 'click' THEN -1 ELSE length(event_type) END AS value FROM events")
def cached_computation(spark, d):
    """A value for each event's type; only types that the cache lacks are computed, once each. The cache holds -1 for one type."""
    asked = read(spark, d, "events").select("user_id", F.col("event_type").alias("payload"))
    held = spark.createDataFrame([("click",)], "payload string").select(F.sha2(F.concat(F.lit("v1\0"), F.col("payload")), 256).alias("key"), F.lit(-1).alias("value"))
    answers, _ = writers.cached(asked, held, lambda misses: misses.select("key", F.length("payload").alias("value")), "v1")
    return answers.select("user_id", F.col("value").cast("long").alias("value"))


@query()
def null_mc(spark, d):
    """Matched null of each user's best event value of a type, less the type's median: draws of as many values from the whole type's."""
    e = read(spark, d, "events").where("value is not null and user_id is not null and event_type is not null").select("user_id", "event_type", F.col("value").cast("double").alias("value"))
    middle = statistics.quantiles(e, "value", ["event_type"], {"baseline": 0.5})
    per = e.groupBy("user_id", "event_type").agg(F.count("*").cast("int").alias("needed"), F.max("value").alias("best"))
    per = statistics.matched(per, middle, ["event_type"])
    groups = per.select("event_type", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("group"), "needed", "baseline", (F.col("best") - F.col("baseline")).alias("observed"))
    return statistics.pooled_nulls(e, groups, ["event_type"]).drop("event_type")


@query("SELECT lang, sum((quality = 1 AND toxic = 0)::INT)::BIGINT AS tp, sum((quality = 0 AND toxic = 0)::INT)::BIGINT AS fp, sum((quality = 1 AND toxic = 1)::INT)::BIGINT AS fn, round(2 * sum((quality = 1 AND toxic = 0)::INT) / (2 * sum((quality = 1 AND toxic = 0)::INT) + sum((quality <> 1 - toxic)::INT)), 9) AS f1 FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def agreement_f1(spark, d):
    j = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id").select("lang", F.col("quality").alias("gold"), (1 - F.col("toxic")).alias("pred"))
    return metrics.micro_prf(j, 0, ["lang"]).select("lang", "tp", "fp", "fn", "f1")
