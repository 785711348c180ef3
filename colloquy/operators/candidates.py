"""Candidate masks over a conversation's history: which earlier turns a candidate keeps.

A mask is a text of 0 and 1, a digit for each turn, oldest first; without history it is `[]`.
Samples have sample_id, depth (turns of history) and, for lexical overlap, question and history.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import table

EMPTY = "[]"
MOST = 8


def bits(n: Column, chosen: Column) -> Column:
    """The mask of n digits with 1 at the given places, from 0."""
    digit = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.array_contains(chosen, i), "1").otherwise("0"))
    return F.when(n == 0, EMPTY).otherwise(F.array_join(digit, ""))


def _rows(df: DataFrame, role: str, family: str) -> DataFrame:
    return df.select("sample_id", "depth", "mask", F.lit(role).alias("role"), F.lit(family).alias("family"), "origin", F.col("rank").cast("int").alias("rank"))


def _listed(df: DataFrame, specs: Column) -> DataFrame:
    """specs: list of (origin, rank, mask)."""
    return df.select("sample_id", "depth", F.explode(specs).alias("s")).select("sample_id", "depth", "s.*")


def _spec(origin: Column, rank: Column, mask: Column) -> Column:
    return F.struct(origin.alias("origin"), rank.cast("int").alias("rank"), mask.alias("mask"))


def references(samples: DataFrame) -> DataFrame:
    """All of the history, and none of it."""
    whole = F.when(F.col("depth") == 0, EMPTY)
    n = F.col("depth").cast("int")
    full = _rows(samples.select("sample_id", "depth", whole.otherwise(F.repeat(F.lit("1"), n)).alias("mask"), F.lit("full_history").alias("origin"), F.lit(1).alias("rank")), "reference", "recency")
    none = _rows(samples.select("sample_id", "depth", whole.otherwise(F.repeat(F.lit("0"), n)).alias("mask"), F.lit("no_history").alias("origin"), F.lit(1).alias("rank")), "reference", "query_only")
    return full.unionByName(none)


def recent(samples: DataFrame, most: int = MOST) -> DataFrame:
    """The last 1, 2, ... turns."""
    n = F.col("depth").cast("int")
    specs = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))), lambda s: _spec(F.concat(F.lit("recent_last_"), s.cast("string")), s, F.concat(F.repeat(F.lit("0"), n - s), F.repeat(F.lit("1"), s))))
    return _rows(_listed(samples.where("depth > 0"), specs), "generator", "recent_variants")


def anchors(samples: DataFrame, most: int = MOST) -> DataFrame:
    """The oldest 1, 2, 3, 5, 8 turns, and the first with the last 1, 2, 4; masks that repeat within a sample go."""
    n = F.col("depth").cast("int")
    oldest = [F.when(n >= s, F.struct(F.lit(f"oldest_{s}").alias("origin"), F.lit(k).alias("place"), F.concat(F.repeat(F.lit("1"), F.lit(s)), F.repeat(F.lit("0"), n - s)).alias("mask"))) for k, s in enumerate((1, 2, 3, 5, 8))]
    ends = [F.when(n >= r + 1, F.struct(F.lit(f"first_plus_recent_{r}").alias("origin"), F.lit(5 + k).alias("place"), F.concat(F.lit("1"), F.repeat(F.lit("0"), n - r - 1), F.repeat(F.lit("1"), F.lit(r))).alias("mask"))) for k, r in enumerate((1, 2, 4))]
    listed = samples.where("depth > 0").select("sample_id", "depth", F.explode(F.array_compact(F.array(*oldest, *ends))).alias("s")).select("sample_id", "depth", "s.*")
    first = listed.groupBy("sample_id", "depth", "mask").agg(F.min_by("origin", "place").alias("origin"), F.min("place").alias("place"))
    placed = first.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy("place"))).where(F.col("rank") <= most)
    return _rows(placed, "generator", "position_anchor")


def overlap_prefixes(scored: DataFrame, most: int, family: str, prefix: str) -> DataFrame:
    """The best 1, 2, ... turns of scored (sample_id, depth, turns: list of (index, best first))."""
    n = F.col("depth").cast("int")
    specs = F.transform(F.sequence(F.lit(1), F.least(F.size("turns"), F.lit(most))), lambda k: _spec(F.concat(F.lit(prefix), k.cast("string")), k, bits(n, F.slice(F.col("turns"), F.lit(1), k))))
    return _rows(_listed(scored.where(F.size("turns") > 0), specs), "generator", family)


def lexical(samples: DataFrame, most: int = MOST) -> DataFrame:
    """Turns that share a lexical term with the question, by falling Jaccard similarity, shared terms and place."""
    asked = T.lexical_terms(F.col("question"))
    units = samples.select("sample_id", "depth", asked.alias("asked"), F.posexplode("history").alias("index", "turn"))
    said = units.withColumn("terms", T.lexical_terms(F.concat_ws(" ", "turn.question", "turn.answer")))
    shared = F.size(F.array_intersect("asked", "terms"))
    scored = said.select("sample_id", "depth", "index", shared.alias("shared"), (shared / F.size(F.array_union("asked", "terms"))).alias("jaccard")).where("shared > 0")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("jaccard")).alias("j"), (-F.col("shared")).alias("s"), (-F.col("index")).alias("i"), "index"))), lambda x: x["index"])
    return overlap_prefixes(scored.groupBy("sample_id", "depth").agg(ordered.alias("turns")), most, "lexical_overlap", "lexical_top_")


def with_entities(samples: DataFrame, recognise: Callable[[Column], Column]) -> DataFrame:
    """Adds asked_entities (of the question) and turn_entities (a list for each turn of the history). recognise: a text column to
    its distinct entities; a model's output joins in as a column the same way."""
    said = F.transform("history", lambda t: recognise(F.concat_ws(" ", t["question"], t["answer"])))
    return samples.withColumns({"asked_entities": recognise(F.col("question")), "turn_entities": said})


def entity_overlap(samples: DataFrame, most: int = MOST) -> DataFrame:
    """Turns that share an entity with the question (columns of with_entities), by falling number shared, the later first."""
    places = F.transform("turn_entities", lambda e, i: F.struct((-F.size(F.array_intersect(e, F.col("asked_entities")))).alias("n"), (-i).alias("i")))
    turns = F.transform(F.array_sort(F.filter(places, lambda x: x["n"] < 0)), lambda x: -x["i"])
    return overlap_prefixes(samples.select("sample_id", "depth", turns.alias("turns")), most, "entity_overlap", "entity_overlap_top_")


def entity_recent(samples: DataFrame, most: int = MOST) -> DataFrame:
    """Turns with any entity, newest first."""
    places = F.transform("turn_entities", lambda e, i: F.when(F.size(e) > 0, i))
    turns = F.reverse(F.array_compact(places))
    return overlap_prefixes(samples.select("sample_id", "depth", turns.alias("turns")), most, "entity_recent", "entity_recent_top_")


def entity_coverage(samples: DataFrame, by: list[str]) -> DataFrame:
    """samples, anchored (those whose question shares an entity with its history) and their share."""
    anchored = F.size(F.array_intersect("asked_entities", F.array_distinct(F.flatten("turn_entities")))) > 0
    g = samples.withColumn("_a", F.coalesce(anchored, F.lit(False))).groupBy(*by).agg(F.count("*").alias("samples"), F.count_if("_a").alias("anchored"))
    return g.withColumn("share", F.round(F.col("anchored") / F.col("samples"), 9))


def length_features(samples: DataFrame, count: Callable[[Column], Column] = T.rough_tokens) -> DataFrame:
    """question_tokens of each sample, question_lengths, answer_lengths and turn_lengths of its history (lists, oldest first) and
    conversation_tokens, their sum."""
    of = lambda f: F.transform("history", f)
    lengths = samples.select("sample_id", count(F.col("question")).alias("question_tokens"), of(lambda t: count(t["question"])).alias("question_lengths"), of(lambda t: count(t["answer"])).alias("answer_lengths"))
    whole = lengths.withColumn("turn_lengths", F.zip_with("question_lengths", "answer_lengths", lambda a, b: a + b))
    return whole.withColumn("conversation_tokens", F.col("question_tokens") + F.aggregate("turn_lengths", F.lit(0), lambda a, b: a + b))


def refilled(needs: DataFrame, seen: DataFrame, seed: str = "refill") -> DataFrame:
    """Masks that haven't been tried: needs (sample_id, depth, kept, wanted), seen (sample_id, mask). Gives sample_id, kept, rank and
    mask, `wanted` of them or as many as there are: drawn until found, or from all that are left where more than half were tried."""
    tried = seen.groupBy("sample_id").agg(F.collect_set("mask").alias("tried"))  # of one sample's history
    drawn = F.udf(lambda sample, depth, kept, wanted, tried: _unseen(f"{seed}\0{sample}\0{kept}", depth, kept, wanted, set(tried or ())), "array<string>")
    rows = needs.join(tried, "sample_id", "left").select("sample_id", "kept", F.posexplode(drawn("sample_id", "depth", "kept", "wanted", "tried")).alias("rank", "mask"))
    return rows.withColumn("rank", F.col("rank") + 1)


def _mask(depth: int, kept) -> str:
    return "".join("1" if i in kept else "0" for i in range(depth))


def _unseen(seed: str, depth: int, kept: int, wanted: int, tried: set[str]) -> list[str]:
    gone = sum(len(m) == depth and m.count("1") == kept for m in tried)
    left = max(0, comb(depth, kept) - gone)
    rng, found = random.Random(seed), {}
    if 2 * (gone + wanted) > comb(depth, kept):  # the combinations are at most twice those tried and wanted
        rest = [m for c in combinations(range(depth), kept) if (m := _mask(depth, set(c))) not in tried]
        rng.shuffle(rest)
        return rest[:wanted]
    while len(found) < min(wanted, left):
        mask = _mask(depth, set(rng.sample(range(depth), kept)))
        if mask not in tried:
            found[mask] = None
    return list(found)


def controls(samples: DataFrame, exhaustive: int = 8, each: int = 10, seed: str = "control") -> DataFrame:
    """All masks but the empty one for histories of at most `exhaustive` turns; for longer ones `each` masks of every number of kept
    turns, or all where there are no more. Draws are seeded by sample and number, so the same in each run."""
    n = F.col("depth").cast("int")
    short = samples.where((F.col("depth") > 0) & (F.col("depth") <= exhaustive)).select("sample_id", "depth", F.explode(F.sequence(F.lit(1), F.shiftleft(F.lit(1), exhaustive) - 1)).alias("rank")).where(F.col("rank") < F.expr("shiftleft(1, cast(depth as int))"))
    all_of = _rows(short.select("sample_id", "depth", "rank", F.lpad(F.bin("rank"), n, "0").alias("mask"), F.concat(F.lit("exhaustive_"), F.col("rank").cast("string")).alias("origin")), "control", "control_space")
    deep = samples.where(F.col("depth") > exhaustive)
    listed = F.udf(lambda sample, depth: _drawn(f"{seed}\0{sample}", depth, each), "array<struct<origin: string, rank: int, mask: string>>")
    few = deep.select("sample_id", "depth", F.explode(listed("sample_id", n)).alias("s")).select("sample_id", "depth", "s.*")
    return all_of.unionByName(_rows(few, "control", "control_space"))


def _drawn(seed: str, depth: int, each: int) -> list[tuple[str, int, str]]:
    """origin, rank and mask of `each` distinct masks of every number of kept turns: all combinations where there are no more, else draws."""
    out = []
    for kept in range(1, depth + 1):
        if comb(depth, kept) <= each:
            found = list(combinations(range(depth), kept))
        else:
            rng, seen = random.Random(f"{seed}\0{kept}"), {}
            while len(seen) < each:
                seen[tuple(sorted(rng.sample(range(depth), kept)))] = None
            found = list(seen)
        for rank, turns in enumerate(found, 1):
            held = set(turns)
            out.append((f"sampled_{kept}", rank, "".join("1" if i in held else "0" for i in range(depth))))
    return out


def deduplicated(rows: DataFrame) -> DataFrame:
    """A row for each mask of a sample with where it came from, and candidate ids numbered over samples and masks in text order."""
    provenance = F.array_sort(F.collect_list(F.struct("role", "family", "rank", "origin")))
    g = rows.groupBy("sample_id", "depth", "mask").agg(
        F.array_sort(F.collect_set("role")).alias("roles"), F.array_sort(F.collect_set("origin")).alias("origins"), F.array_sort(F.collect_set("family")).alias("families"), F.array_sort(F.collect_set(F.when(F.col("role") == "generator", F.col("origin")))).alias("generators"), provenance.alias("provenance"), (F.count("*") - 1).alias("duplicates")
    )
    has = lambda role: F.array_contains("roles", role)
    kept = F.length(F.replace(F.col("mask"), F.lit("0"), F.lit("")))
    kept = F.when(F.col("mask") == EMPTY, 0).otherwise(kept)
    named = g.withColumns({"budget_family": F.when(has("reference"), "reference").when(has("generator"), "generator").when(has("control"), "control").otherwise("other"), "kept": kept, "ratio": F.when(F.col("depth") > 0, F.round(kept / F.col("depth"), 9)).otherwise(0.0)})
    return numbered(named, "sample_id", "mask")


def numbered(df: DataFrame, group: str, order: str) -> DataFrame:
    """Adds candidate_id `<group>::cand_<number>`, numbers running over all rows by group, then order.

    Group sizes are dealt out by ranges of the group and summed within each range; only a total for each range meets in one place.
    """
    sizes = table(df.groupBy(group).agg(F.count("*").alias("_n")).repartitionByRange(F.col(group)).withColumn("_range", F.spark_partition_id()), "group-sizes")
    totals = sizes.groupBy("_range").agg(F.sum("_n").alias("_all")).withColumn("_start", F.coalesce(F.sum("_all").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    up_to = Window.partitionBy("_range").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_earlier", F.coalesce(F.sum("_n").over(up_to), F.lit(0))).join(totals, "_range").select(group, (F.col("_start") + F.col("_earlier")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group).orderBy(order))
    number = (within + F.col("_before")).cast("string")
    return df.join(before, group).withColumn("candidate_id", F.concat(F.col(group), F.lit("::cand_"), F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number))).drop("_before")


def coverage(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Of each generator family: mean, median and most candidates of a sample, and how many samples it abstains from."""
    families = rows.where("role = 'generator'").select("family").distinct()
    counts = rows.where("role = 'generator'").groupBy("family", "sample_id").agg(F.count("*").alias("n"))
    grid = samples.select("sample_id").crossJoin(F.broadcast(families)).join(counts, ["family", "sample_id"], "left").na.fill(0, ["n"])
    return grid.groupBy("family").agg(F.round(F.avg("n"), 9).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("abstentions"))


def headroom(scored: DataFrame) -> DataFrame:
    """sample_id, recency, best_generator, best_control, headroom and relation from candidate scores (sample_id, role, origin, rr)."""
    of = lambda cond: F.max(F.when(cond, F.col("rr")))
    g = scored.groupBy("sample_id").agg(of(F.col("origin") == "full_history").alias("recency"), of(F.col("role") == "generator").alias("best_generator"), of(F.col("role") == "control").alias("best_control"))
    best = F.greatest("best_generator", "best_control")
    gain = F.round(best - F.col("recency"), 9)
    return g.withColumn("headroom", gain).withColumn("relation", F.when(gain > 0, "positive").when(gain < 0, "negative").otherwise("neutral"))
