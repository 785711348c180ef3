"""Spans over tokens and text: overlaps, label projection, tag decoding, validation."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import text as T

# Label ids of the collapsed tag set, the taxonomy, and the id of tokens that are not judged.
TAGS = {"O": 0, "B-KEEP": 1, "I-KEEP": 2}
TAXONOMY = {"O": 0, "ENTITY": 1, "CONCEPT": 2, "KEY_TERM": 3, "DEFINITION": 4, "RELATION_CUE": 5}
IGNORED = -100

TOKENS = ArrayType(StructType([StructField("text", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


#: Texts whose tokens are Python objects at once.
TEXTS = 64


@F.arrow_udf(TOKENS)
def tokens_with_offsets(texts: pa.Array) -> pa.Array:
    """Runs of anything but white space with their places in code points; null gives none."""
    parts = []
    for at in range(0, max(1, len(texts)), TEXTS):
        found = [list(re.finditer(r"\S+", t or "")) for t in texts.slice(at, TEXTS).to_pylist()]
        flat = [m for each in found for m in each]
        columns = [pa.array([m[0] for m in flat], pa.string()), pa.array([m.start() for m in flat], pa.int32()), pa.array([m.end() for m in flat], pa.int32())]
        tokens = pa.StructArray.from_arrays(columns, names=["text", "start", "end"])
        parts.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), tokens))
    return pa.concat_arrays(parts)


def overlapping(tokens: str, spans: str) -> Column:
    """For each token (start, end): the spans (start, end, ...) that overlap it."""
    return F.transform(tokens, lambda t: F.filter(spans, lambda s: (t["start"] < s["end"]) & (t["end"] > s["start"])))


def token_labels(tokens: str, spans: str) -> Column:
    """For each token the distinct labels of its spans, in order."""
    return F.transform(overlapping(tokens, spans), lambda found: F.array_sort(F.array_distinct(F.transform(found, lambda s: s["label"]))))


def taxonomy_ids(tokens: str, spans: str) -> Column:
    """For each token the taxonomy id of its overlapping span of the least span_id; 0 without any."""
    ids = F.create_map(*[F.lit(x) for pair in TAXONOMY.items() for x in pair])
    first = lambda found: F.get(F.array_sort(F.transform(found, lambda s: F.struct(s["span_id"].alias("span_id"), s["label"].alias("label")))), 0)["label"]
    return F.transform(overlapping(tokens, spans), lambda found: F.coalesce(ids[first(found)], F.lit(0)))


def bio(tokens: str, spans: str) -> Column:
    """For each token 1 where its first overlapping span begins, 2 where it goes on, 0 without one."""
    owner = F.transform(overlapping(tokens, spans), lambda found: F.get(F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["span_id"].alias("span_id")))), 0)["span_id"])
    return F.transform(owner, lambda s, i: F.when(s.isNull(), 0).when((i > 0) & s.eqNullSafe(F.get(owner, i - 1)), 2).otherwise(1))


def tag_spans(tags: DataFrame, keys: list[str], begins: bool = True) -> DataFrame:
    """keys, start, end (exclusive) of the runs of tags (keys, index, tag) other than 0; tag 1 begins a new run if `begins`."""
    w = Window.partitionBy(*keys).orderBy("index")
    before = F.coalesce(F.lag("tag").over(w), F.lit(0))
    opens = (before == 0) | (F.lit(begins) & (F.col("tag") == 1)) | (F.lag("index").over(w) != F.col("index") - 1)
    runs = tags.withColumn("_opens", opens).where("tag > 0").withColumn("_run", F.sum(F.col("_opens").cast("int")).over(w))
    return runs.groupBy(*keys, "_run").agg(F.min("index").alias("start"), (F.max("index") + 1).alias("end")).drop("_run")


def relabelled(tags: DataFrame, keys: list[str]) -> DataFrame:
    """Adds relabel: a kept tag (1 or 2) stays; tag 0 with a positive score becomes 2 if the tag before it, so relabelled, is kept, else 1.

    What goes before a token is kept exactly if its tag is kept or its score positive, so one lag decides.
    """
    kept = (F.col("tag") > 0) | (F.col("score") > 0)
    before = F.coalesce(F.lag(kept).over(Window.partitionBy(*keys).orderBy("index")), F.lit(False))
    return tags.withColumn("relabel", F.when(F.col("tag") > 0, F.col("tag")).when(F.col("score") > 0, F.when(before, 2).otherwise(1)).otherwise(0))


def validated(spans: DataFrame, fields: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """spans (sample_id, span_id, turn_id, field, label, text) with status and found_turn, found_field, start.

    exact: the text stands in its own field; moved: in exactly one other field of the sample; moved_any_case: in exactly one field
    when case doesn't count; else invalid, as are unknown labels and empty texts. fields: sample_id, turn_id, field, content.
    """
    known = labels or [x for x in TAXONOMY if x != "O"]
    f = fields.select("sample_id", F.col("turn_id").alias("f_turn"), F.col("field").alias("f_field"), "content")
    joined = spans.join(f, "sample_id", "left")
    own = (F.col("turn_id") == F.col("f_turn")) & (F.col("field") == F.col("f_field"))
    at, at_any = F.expr("locate(text, content)"), F.expr("locate(lower(text), lower(content))")
    place = lambda a: F.struct(F.col("f_turn").alias("turn"), F.col("f_field").alias("field"), (a - 1).alias("start"))
    g = joined.groupBy("sample_id", "span_id", "turn_id", "field", "label", "text").agg(
        F.max(F.when(own & (at > 0), place(at))).alias("here"), F.count_if(at > 0).alias("n"), F.max(F.when(at > 0, place(at))).alias("there"), F.count_if(at_any > 0).alias("n_any"), F.max(F.when(at_any > 0, place(at_any))).alias("there_any")
    )
    usable = F.col("label").isin(known) & (F.coalesce(F.col("text"), F.lit("")) != "")
    status = F.when(~usable, "invalid").when(F.col("here").isNotNull(), "exact").when(F.col("n") == 1, "moved").when((F.col("n") == 0) & (F.col("n_any") == 1), "moved_any_case").otherwise("invalid")
    where = F.when(F.col("status") == "exact", F.col("here")).when(F.col("status") == "moved", F.col("there")).when(F.col("status") == "moved_any_case", F.col("there_any"))
    out = g.withColumn("status", status).withColumn("w", where)
    return out.select("sample_id", "span_id", "turn_id", "field", "label", "text", "status", F.col("w.turn").alias("found_turn"), F.col("w.field").alias("found_field"), F.col("w.start").alias("start"))


def merged_char_spans(tokens: DataFrame, keys: list[str], order: str, tag: str, begins: int | None = None, gap: int = 4) -> DataFrame:
    """Character spans (keys, start, end) of runs of kept tokens. tokens: keys, start, end, `order` and `tag` of every token, 0 for a dropped one.

    A run ends at every dropped token, where a token starts more than `gap` characters after the one before, and before every token tagged
    `begins`, if that is given (collapsed labels). Null tags are dropped ones.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    kept = F.coalesce(F.col(tag) != 0, F.lit(False))
    apart = ~F.coalesce(F.lag(kept).over(w), F.lit(False)) | (F.col("start") > F.lag("end").over(w) + gap)
    opens = apart | (F.col(tag) == begins) if begins is not None else apart
    runs = tokens.withColumn("_kept", kept).withColumn("_run", F.sum((kept & opens).cast("int")).over(w)).where("_kept")
    return runs.groupBy(*keys, "_run").agg(F.min_by("start", order).alias("start"), F.max_by("end", order).alias("end")).drop("_run")


def serialised(query: str, history: str, budget: int, query_most: int = 32, field_most: int = 32) -> Column:
    """tokens, raw_length and truncated of `question: <query> context: <newest answer> <newest question> ...` by white-space tokens: the query and
    each field are cut at their own limits, the whole at the budget, whose last token stays the text's last."""
    cut = lambda t, n: F.slice(F.filter(F.split(F.coalesce(t, F.lit("")), r"(?U)\s+"), lambda x: x != ""), 1, n)
    fields = F.flatten(F.transform(F.reverse(history), lambda t: F.concat(cut(t["answer"], field_most), cut(t["question"], field_most))))
    whole = F.concat(F.array(F.lit("question:")), cut(F.col(query), query_most), F.array(F.lit("context:")), fields)
    held = F.when(F.size(whole) > budget, F.concat(F.slice(whole, 1, budget - 1), F.slice(whole, -1, 1))).otherwise(whole)
    return F.struct(held.alias("tokens"), F.size(whole).alias("raw_length"), (F.size(whole) > budget).alias("truncated"))


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best tag sequence under token scores [n, tags] and transition scores [tags, tags]."""
    best, back = scores[0], []
    for row in scores[1:]:
        total = best[:, None] + moves
        back.append(total.argmax(axis=0))
        best = total.max(axis=0) + row
    path = [int(best.argmax())]
    for pointers in reversed(back):
        path.append(int(pointers[path[-1]]))
    return path[::-1]


def sampled_path(scores: np.ndarray, moves: np.ndarray, uniforms: np.ndarray) -> list[int]:
    """A tag sequence drawn from the exact joint distribution: forward sums, then backward draws, one uniform number each."""
    forward = [scores[0]]
    for row in scores[1:]:
        forward.append(np.logaddexp.reduce(forward[-1][:, None] + moves, axis=0) + row)
    path: list[int] = []
    for t in range(len(scores) - 1, -1, -1):
        logits = forward[t] + (moves[:, path[-1]] if path else 0)
        p = np.exp(logits - logits.max())
        path.append(int(min(np.searchsorted(np.cumsum(p) / p.sum(), uniforms[t], side="right"), len(p) - 1)))
    return path[::-1]


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def surface_match(tokens: Column, phrase: Column) -> Column:
    """places of a phrase's words among tokens, and how they were found; words are compared without punctuation and case, and those that are
    only punctuation count on neither side.

    found: `run` for the only unbroken run of the phrase, `spread` for the first places at which its words follow each other with gaps, where
    there is no run; `ambiguous` for several runs and `missing` where the words don't all follow each other, or there are none, both without places.
    Nulls have no words.
    """
    none = F.array().cast("array<int>")
    fold = lambda t: T.casefold(F.regexp_replace(t, r"(?U)\W+", ""))
    folded = F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t, k: F.struct(fold(t).alias("word"), k.alias("place")))
    have = F.filter(folded, lambda t: F.coalesce(t["word"], F.lit("")) != "")
    want = F.filter(F.transform(T.words(phrase), fold), lambda w: w != "")

    def matched(x: Column) -> Column:
        n, m = F.size(x["have"]), F.size(x["want"])
        words = F.transform(x["have"], lambda t: t["word"])
        starts = F.when((m > 0) & (n >= m), F.sequence(F.lit(0), n - m)).otherwise(none)
        runs = F.filter(starts, lambda k: F.slice(words, k + 1, m) == x["want"])

        def step(at: Column, word: Column) -> Column:
            place = F.array_position(F.slice(words, at["next"] + 1, n), word).cast("int")
            whole = at["whole"] & (place > 0)
            return F.struct(F.when(whole, at["next"] + place).otherwise(at["next"]).alias("next"), F.when(whole, F.concat(at["at"], F.array(at["next"] + place - 1))).otherwise(none).alias("at"), whole.alias("whole"))

        spread = F.aggregate(x["want"], F.struct(F.lit(0).alias("next"), none.alias("at"), F.lit(True).alias("whole")), step, lambda at: at["at"])
        at = F.when(F.size(runs) == 1, F.transform(x["want"], lambda _, k: F.get(runs, 0) + k)).when(F.size(runs) == 0, spread).otherwise(none)
        how = F.when(F.size(runs) == 1, "run").when(F.size(runs) > 1, "ambiguous").when(F.size(spread) > 0, "spread").otherwise("missing")
        return F.struct(F.transform(at, lambda k: F.get(x["have"], k)["place"]).alias("places"), how.alias("found"))

    return _bound(F.struct(have.alias("have"), want.alias("want")), matched)


def kept_text(field: Column, spans: Column, word: str = r"(?U)\w") -> Column:
    """A field's text under spans (list of start, end), held within it: chunks in order of place, white space as single spaces, chunks of
    punctuation alone (without a match of word) and repeats (but for case) left out. A null field or list gives an empty text."""
    texts = F.array().cast("array<string>")
    held = F.array_sort(F.transform(spans, lambda s: F.struct(F.greatest(F.lit(0), s["start"]).alias("a"), F.least(F.length(field), s["end"]).alias("b"))))
    cut = F.transform(held, lambda s: T.clean(F.regexp_replace(F.substring(field, s["a"] + 1, F.greatest(F.lit(0), s["b"] - s["a"])), r"(?U)\s+", " ")))
    chunks = F.transform(F.filter(cut, lambda x: x.rlike(word)), lambda x: F.struct(x.alias("text"), T.casefold(x).alias("folded")))

    def step(kept: Column, x: Column) -> Column:
        longer = F.struct(F.concat(kept["seen"], F.array(x["folded"])).alias("seen"), F.concat(kept["out"], F.array(x["text"])).alias("out"))
        return F.when(F.array_contains(kept["seen"], x["folded"]), kept).otherwise(longer)

    joined = F.aggregate(chunks, F.struct(texts.alias("seen"), texts.alias("out")), step, lambda kept: F.array_join(kept["out"], " "))
    return F.coalesce(joined, F.lit(""))


def word_spans(words: Column) -> Column:
    """start and end of each word of a list in the text that joins them by single spaces."""
    start = lambda k: F.aggregate(F.slice(words, F.lit(1), k), F.lit(0), lambda n, w: n + F.length(w) + 1)
    return F.transform(words, lambda w, k: _bound(start(k), lambda at: F.struct(at.alias("start"), (at + F.length(w)).alias("end"))))


def projected(pieces: Column, scored: Column) -> Column:
    """The largest score of those scored spans (start, end, score) that each piece (start, end) overlaps; 0 where there are none."""

    def best(p: Column) -> Column:
        over = F.filter(scored, lambda s: (s["start"] < p["end"]) & (p["start"] < s["end"]))
        return F.coalesce(F.array_max(F.transform(over, lambda s: s["score"].cast("double"))), F.lit(0.0))

    return F.transform(pieces, best)


def pair_encoded(first: Column, second: Column, most: int, opening: str = "<s>", closing: str = "</s>") -> Column:
    """tokens, segments (0 and 1) and kept (how many of the second list stay) of two lists of tokens between markers, `most` in all; only the
    second is cut. A first list that leaves no room raises."""
    room = F.lit(most - 3) - F.size(first)
    kept = F.when(room < 0, F.raise_error(F.lit("the first text is too long")).cast("int")).otherwise(F.least(room, F.size(second)))

    def put(n: Column) -> Column:
        tokens = F.concat(F.array(F.lit(opening)), first, F.array(F.lit(closing)), F.slice(second, F.lit(1), n), F.array(F.lit(closing)))
        segments = F.concat(F.array_repeat(F.lit(0), F.size(first) + 2), F.array_repeat(F.lit(1), n + 1))
        return F.struct(tokens.alias("tokens"), segments.alias("segments"), n.alias("kept"))

    return _bound(kept, put)


def united_targets(labelled: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, teacher, evidence and target of the tokens of both: kept by the teacher (column kept), or of positive score (score_raw)."""
    both = labelled.select(*keys, F.col("kept").alias("teacher")).join(scored.select(*keys, (F.col("score_raw") > 0).alias("evidence")), keys, "full")
    return both.na.fill(False, ["teacher", "evidence"]).withColumn("target", F.col("teacher") | F.col("evidence"))
