"""Queries over candidate masks, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import candidates as M
from ..operators import conversation, splits
from ..session import read
from .bindings import TURNS, lexical_sql, samples

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _samples(spark, d):
    return samples(spark, d).withColumn("depth", F.col("history_depth"))


REFERENCES = """SELECT sample_id, depth, CASE WHEN depth = 0 THEN '[]' ELSE repeat('1', depth) END AS mask, 'reference' AS role, 'recency' AS family, 'full_history' AS origin, 1 AS rank FROM s
  UNION ALL SELECT sample_id, depth, CASE WHEN depth = 0 THEN '[]' ELSE repeat('0', depth) END, 'reference', 'query_only', 'no_history', 1 FROM s"""
RECENT = """SELECT sample_id, depth, repeat('0', depth - k) || repeat('1', k) AS mask, 'generator' AS role, 'recent_variants' AS family, 'recent_last_' || k AS origin, k::INT AS rank FROM (SELECT *, unnest(range(1, least(depth, 8) + 1)) AS k FROM s WHERE depth > 0)"""
ANCHORS = """SELECT sample_id, depth, mask, 'generator' AS role, 'position_anchor' AS family, origin, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY place)::INT AS rank FROM (SELECT sample_id, depth, mask, arg_min(origin, place) AS origin, min(place) AS place FROM (
  SELECT sample_id, depth, repeat('1', k) || repeat('0', depth - k) AS mask, 'oldest_' || k AS origin, k AS place FROM (SELECT *, unnest([1, 2, 3, 5, 8]) AS k FROM s) WHERE k <= depth
  UNION ALL SELECT sample_id, depth, '1' || repeat('0', depth - k - 1) || repeat('1', k), 'first_plus_recent_' || k, 100 + k FROM (SELECT *, unnest([1, 2, 4]) AS k FROM s) WHERE k + 1 <= depth) GROUP BY ALL)) WHERE rank <= 8"""
CONTROLS = """SELECT sample_id, depth, lpad(bin(k), depth::INT, '0') AS mask, 'control' AS role, 'control_space' AS family, 'exhaustive_' || k AS origin, k::INT AS rank FROM (SELECT *, unnest(range(1, (1 << depth::INT)::BIGINT)) AS k FROM s WHERE depth BETWEEN 1 AND 8)"""
LEXICAL = f"""SELECT sample_id, depth, (SELECT string_agg(CASE WHEN list_contains(turns[1:k], i) THEN '1' ELSE '0' END, '' ORDER BY i) FROM (SELECT unnest(range(0, depth)) AS i)) AS mask, 'generator' AS role, 'lexical_overlap' AS family, 'lexical_top_' || k AS origin, k::INT AS rank FROM
  (SELECT *, unnest(range(1, least(len(turns), 8) + 1)) AS k FROM (SELECT sample_id, depth, list(i ORDER BY jaccard DESC, shared DESC, i DESC) AS turns FROM
  (SELECT sample_id, depth, i, len(list_intersect(asked, said)) AS shared, len(list_intersect(asked, said)) / len(list_distinct(list_concat(asked, said))) AS jaccard FROM
  (SELECT t.sample_id, t.depth, h.turn_id - 1 AS i, {lexical_sql('t.question')} AS asked, {lexical_sql("(h.question || ' ' || h.answer)")} AS said FROM s t JOIN s h ON h.conv_id = t.conv_id AND h.turn_id < t.turn_id)) WHERE shared > 0 GROUP BY ALL))"""
S = f"{TURNS}, s AS (SELECT *, history_depth AS depth FROM samples)"


def _entities_sql(column: str) -> str:
    return f"list_filter({lexical_sql(column)}, lambda x: length(x) >= 8)"


def _prefix_sql(ranked: str, family: str) -> str:
    return f"""SELECT sample_id, depth, (SELECT string_agg(CASE WHEN list_contains(turns[1:k], i) THEN '1' ELSE '0' END, '' ORDER BY i) FROM (SELECT unnest(range(0, depth)) AS i)) AS mask, 'generator' AS role, '{family}' AS family, '{family}_top_' || k AS origin, k::INT AS rank
  FROM (SELECT *, unnest(range(1, least(len(turns), 8) + 1)) AS k FROM ({ranked}))"""


UNITS = f"""units AS (SELECT t.sample_id, t.depth, h.turn_id - 1 AS i, {_entities_sql('t.question')} AS asked, {_entities_sql("(coalesce(h.question, '') || ' ' || coalesce(h.answer, ''))")} AS said FROM s t JOIN s h ON h.conv_id = t.conv_id AND h.turn_id < t.turn_id)"""
ENTITY_OVERLAP = _prefix_sql("SELECT sample_id, depth, list(i ORDER BY len(list_intersect(asked, said)) DESC, i DESC) AS turns FROM units WHERE len(list_intersect(asked, said)) > 0 GROUP BY ALL", "entity_overlap")
ENTITY_RECENT = _prefix_sql("SELECT sample_id, depth, list(i ORDER BY i DESC) AS turns FROM units WHERE len(said) > 0 GROUP BY ALL", "entity_recent")


def all_sql(where: str = "") -> str:
    """CTEs that end in s (the samples) and rows (their candidates of all families), of all samples or those that `where` keeps."""
    parts = " UNION ALL ".join((REFERENCES, RECENT, ANCHORS, LEXICAL, CONTROLS, ENTITY_OVERLAP, ENTITY_RECENT))
    return f"{S.removesuffix(')')} {where}), {UNITS}, rows AS ({parts})"


ALL = all_sql()


def entity_samples(s):
    return M.with_entities(conversation.with_history(s), T.entities)


def all_of(s):
    """The candidates of all families of samples with depth."""
    h = conversation.with_history(s)
    e = entity_samples(s)
    out = M.references(s)
    for part in (M.recent(s), M.anchors(s), M.lexical(h), M.controls(s), M.entity_overlap(e), M.entity_recent(e)):
        out = out.unionByName(part)
    return out


def _all(spark, d):
    return all_of(_samples(spark, d))


@query(f"WITH {S} {REFERENCES}")
def cand_references(spark, d):
    return M.references(_samples(spark, d))


@query(f"WITH {S} {RECENT}")
def cand_recent(spark, d):
    return M.recent(_samples(spark, d))


@query(f"WITH {S} {ANCHORS}")
def cand_anchor(spark, d):
    return M.anchors(_samples(spark, d))


@query(f"WITH {S} {LEXICAL}")
def cand_lexical(spark, d):
    return M.lexical(conversation.with_history(_samples(spark, d)))


@query(f"WITH {S} {CONTROLS}")
def cand_control_exhaustive(spark, d):
    return M.controls(_samples(spark, d))


@query(f"""WITH {ALL}, g AS (SELECT sample_id, depth, mask, list_sort(list_distinct(list(role))) AS roles, array_to_string(list_sort(list_distinct(list(origin))), ',') AS origins, string_agg(role || '/' || family || '/' || rank || '/' || origin, ',' ORDER BY role, family, rank, origin) AS provenance, count(*) - 1 AS duplicates FROM rows GROUP BY ALL)
  SELECT sample_id || '::cand_' || lpad(row_number() OVER (ORDER BY sample_id, mask)::VARCHAR, 6, '0') AS candidate_id, sample_id, mask, array_to_string(roles, ',') AS roles, origins, provenance, duplicates,
  CASE WHEN list_contains(roles, 'reference') THEN 'reference' WHEN list_contains(roles, 'generator') THEN 'generator' ELSE 'control' END AS budget_family, CASE WHEN mask = '[]' THEN 0 ELSE length(replace(mask, '0', '')) END AS kept, CASE WHEN depth > 0 THEN round(length(replace(mask, '0', '')) / depth, 9) ELSE 0 END AS ratio FROM g""")
def cand_dedup_provenance(spark, d):
    c = M.deduplicated(_all(spark, d))
    listed = F.array_join(F.transform("provenance", lambda p: F.concat_ws("/", p["role"], p["family"], p["rank"].cast("string"), p["origin"])), ",")
    return c.select("candidate_id", "sample_id", "mask", F.array_join("roles", ",").alias("roles"), F.array_join("origins", ",").alias("origins"), listed.alias("provenance"), "duplicates", "budget_family", F.col("kept").cast("long").alias("kept"), "ratio")


@query(f"""WITH {ALL}, c AS (SELECT family, sample_id, count(*) AS n FROM rows WHERE role = 'generator' GROUP BY ALL), g AS (SELECT f.family, s.sample_id, coalesce(n, 0) AS n FROM s CROSS JOIN (SELECT DISTINCT family FROM c) f LEFT JOIN c USING (family, sample_id))
  SELECT family, round(avg(n), 9) AS mean, median(n) AS median, max(n) AS most, count(*) FILTER (n = 0) AS abstentions FROM g GROUP BY family""")
def generator_coverage(spark, d):
    return M.coverage(_all(spark, d), _samples(spark, d))


@query(f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha1('split:' || doc_id), doc_id) AS place, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN place <= ceil(n * 0.2) THEN 'first' ELSE 'rest' END AS split FROM r""")
def hash_split(spark, d):
    return splits.fraction(read(spark, d, "documents").select("doc_id"), "doc_id", 0.2, "split")


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha1('sample:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 5""")
def stratified_sample(spark, d):
    return splits.stratified(read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 5, "sample")


@query()
def subset_sum_split(spark, d):
    """Whole conversations of just half of all turns."""
    sizes = samples(spark, d).groupBy("conv_id").agg(F.count("*").alias("turns"))
    target = sizes.agg(F.sum("turns")).first()[0] // 2
    return splits.exact_subset(sizes, "conv_id", "turns", target, "half")


@query()
def depth_balanced(spark, d):
    """Ten samples of each depth bin (all that are left where there are fewer), one of a conversation, depths balanced, deepest bin first."""
    s = samples(spark, d).withColumn("bin", T.bin_of(F.col("history_depth"), T.DEPTH_BINS)).withColumnRenamed("history_depth", "depth")
    return splits.depth_balanced(s.select("sample_id", "conv_id", "depth", "bin"), list(reversed(T.DEPTH_BINS)), 10, "gate", strict=False)


@query(f"""WITH {TURNS}, n AS (SELECT count(*) AS n FROM samples) SELECT split, sum(samples)::BIGINT AS samples, bool_and(whole) AS whole FROM (
    SELECT 'first' AS split, n // 5 AS samples, TRUE AS whole FROM n UNION ALL SELECT 'second', n // 7, TRUE FROM n
    UNION ALL SELECT 'gate and other', n - n // 5 - n // 7, TRUE FROM n) GROUP BY split""")
def split_bundle(spark, d):
    """Sizes of a bundle: two exact sets of whole conversations beside a gate of ten samples a bin, and whether conversations are in one split
    each. (The SQL knows the sizes; the gate, what is left of its conversations and the rest are counted together.)"""
    s = samples(spark, d).withColumn("bin", T.bin_of(F.col("history_depth"), T.DEPTH_BINS)).withColumnRenamed("history_depth", "depth")
    n = s.count()
    out = splits.bundle(s, list(reversed(T.DEPTH_BINS)), 10, {"first": n // 5, "second": n // 7}, "bundle", strict=False)
    name = F.when(F.col("split").isin("first", "second"), F.col("split")).otherwise("gate and other")
    kinds = F.array_sort(F.collect_set("split"))  # of one conversation
    alone = out.groupBy("conv_id").agg((~F.arrays_overlap(kinds, F.array(F.lit("first"), F.lit("second"), F.lit("rest"))) | (F.size(kinds) == 1)).alias("whole"))
    return out.join(alone, "conv_id").groupBy(name.alias("split")).agg(F.count("*").alias("samples"), F.bool_and("whole").alias("whole"))
