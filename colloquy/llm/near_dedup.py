"""Near-duplicate groups by a signature-coordinate inverted join.

A document's set of word shingles gets a MinHash signature of K coordinates, and the
document is posted under each coordinate-value pair. Documents of similarity 0.8 agree in
at least T of K coordinates (but for a chance of about 2e-7 at exactly 0.8). Postings are
ordered by how rare their pair is: two documents with T agreements share one of the
K - T + 1 rarest pairs of each, so only these prefixes are joined. The long lists behind
them are skipped; agreements in them are counted on the candidates' signatures. Pairs above
the match threshold are confirmed on the documents' full shingle sets.

Documents of equal sets are one class from the start. Within a list the classes are first
held against one leader each, the least edited copy, in rounds with different leaders. Only
lists with several components are looked at again: between() pairs their classes across
components by the places of their shared shingles. So a large group of copies costs its
size and not its square, and no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Remembering, arrow_rows, discard, mix, once, schema_with, table

K, T = 48, 22
#: Id tables of up to so many rows (8 bytes each) are broadcast to pick texts; larger ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of word hashes that a task remembers at most.
REMEMBERED = 24 << 20
#: Followers of a leader that one task confirms, about.
FOLLOWERS = 100
#: Rounds of leaders at most before the remaining classes are paired.
ROUNDS = 2


class WordHashes(Remembering):
    def work_out(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of all words as one if there are fewer; empty without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    hashes.age()
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        out += h[k : k + n] * _ODD[k]
    return np.unique(mix(out))


_MULTIPLIERS = (mix(np.arange(1000, 1000 + K, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)


def signature(hashed: np.ndarray) -> np.ndarray:
    """K coordinate-value pairs, each as one 64-bit number."""
    least = np.full((K, 1), 2**32 - 1, np.uint32)
    for at in range(0, len(hashed), 4096):  # so many at once stay in a cache
        x = hashed[at : at + 4096].astype(np.uint32)[None, :] * _MULTIPLIERS
        least = np.minimum(least, (x ^ (x >> np.uint32(15))).min(axis=1, keepdims=True))
    return mix(least[:, 0].astype(np.uint64) * np.uint64(K + 1) + np.arange(K, dtype=np.uint64))


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set; null without words) and keys (the coordinate-value pairs) of each row."""
    kept = docs.select("doc_id", "text")

    def per_partition():
        hashes = once("words", 0, lambda: WordHashes(REMEMBERED))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(x, width, hashes) for x in batch.column(1).to_pylist()]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            keys = np.concatenate([signature(s).view(np.int64) for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * K), pa.array(keys))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists], names=["doc_id", "n_shingles", "digest", "keys"])

        return step

    return arrow_rows(kept, schema_with(kept.select("doc_id"), "n_shingles long", "digest binary", "keys array<long>"), per_partition, "words")


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids (a written table)."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def confirmed(docs: DataFrame, pairs: DataFrame, width: int, least: tuple[int, int]) -> DataFrame:
    """Those pairs (a, b) whose full sets have least[1] * intersection >= least[0] * union. pairs is a written table.

    A leader's followers are dealt to shares of about FOLLOWERS; its text goes once to each share, and each follower's once.
    """
    ids = table(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-ids")
    texts = picked(docs.select("doc_id", "text"), ids).dropDuplicates(["doc_id"])
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("shares"))
    dealt = pairs.join(shares, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"))
    leaders = dealt.select("a", "share").distinct().join(texts.select(F.col("doc_id").alias("a"), "text"), "a").select("a", "share", F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "text")
    followers = dealt.select("a", "share", "b").join(texts.select(F.col("doc_id").alias("b"), "text"), "b").select("a", "share", "b", "text")
    lined = leaders.union(followers).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())

    def per_partition():
        hashes = once("words", 0, lambda: WordHashes(REMEMBERED))
        leader: list = [None]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            good = []
            for b, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = shingles(x, width, hashes)
                if b is None:
                    leader[0] = found
                    good.append(False)
                    continue
                common = len(np.intersect1d(leader[0], found, assume_unique=True))
                good.append(common > 0 and least[1] * common >= least[0] * (len(leader[0]) + len(found) - common))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

        return step

    return arrow_rows(lined, pairs.select("a", "b").schema, per_partition, "words")


def components(edges: DataFrame) -> DataFrame:
    """id, component (its least reachable id) of every id in edges (a, b), by alternating large-star and small-star steps."""
    state = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-star")
    before = None
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        large = table(large, "near-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        older, state = state, table(small, "near-star")
        discard(older)
        discard(large)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return state.select(F.col("u").alias("id"), F.col("v").alias("component")).union(state.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        before = now


def _alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates that agree in at least T coordinates."""
    of = classes.select("rep", "keys")
    joined = pairs.join(of.select(F.col("rep").alias("a"), F.col("keys").alias("keys_a")), "a").join(of.select(F.col("rep").alias("b"), F.col("keys").alias("keys_b")), "b")
    return joined.where(F.size(F.array_intersect("keys_a", "keys_b")) >= T).select("a", "b")


def groups(docs: DataFrame, width: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text).

    Rows are linked if least[1] * intersection >= least[0] * union of their sets of word shingles (A-Z lower-cased, words cut
    at ASCII white space; with fewer words than `width`, all words are one shingle). Rows without words are linked with
    nothing. component_id is the least doc_id reachable, kept marks the row of that id. Null ids take part in nothing and
    have a null component and kept false. Rows that repeat a doc_id share its component. Extra columns are ignored, whatever their
    names. Very long texts are taken whole. An empty table gives an empty one.
    """
    every = table(signed(docs, width), "near-signed")
    worded = every.where("digest is not null and doc_id is not null")
    classes = table(worded.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "near-classes")
    posted = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("f")).where("f > 1")
    # a class with fewer than T shared pairs has no partner; its unshared pairs, the rarest, fill the prefix first
    ordered = posted.join(shared, "key").groupBy("rep").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("f", "key"))).alias("shared")).where(F.size("shared") >= T)
    prefix = table(ordered.select("rep", "n", (K - F.size("shared")).alias("alone"), F.explode(F.slice("shared", F.lit(1), F.size("shared") - F.lit(T - 1))).alias("s")).select("rep", "n", "alone", "s.key"), "near-prefix")
    of = spread(prefix)
    edges = None
    for turn in range(ROUNDS):
        open_lists = of.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), _leader(turn).alias("leader"), F.count("*").alias("size")).where("lo < hi")
        led = of.join(open_lists, "key").where((F.col("rep") != F.col("leader.rep")) & (F.col("component") != F.col("leader.component")) & _sizes(F.col("n"), F.col("leader.n"), least))
        pairs = led.groupBy("rep").agg(F.max(F.struct("size", "leader.rep")).alias("l")).select(F.col("l.rep").alias("a"), F.col("rep").alias("b"))
        found = table(confirmed(docs, table(_alike(pairs, classes), "near-pairs"), width, least), "near-edges")
        edges = found if edges is None else edges.union(found)
        labels = table(components(edges), "near-labels")
        of = table(spread(prefix, labels), "near-prefix")
    mixed = of.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest = table(of.join(mixed, "key", "left_semi").select("rep", "component").distinct(), "near-rest")
    pairs = table(_alike(between(docs, rest, width, least), classes), "near-pairs")
    labels = table(components(edges.union(confirmed(docs, pairs, width, least))), "near-labels")
    return _labelled(every, classes, labels)


def between(docs: DataFrame, rest: DataFrame, width: int, least: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of classes of different components (rest: rep, component) that can be alike, by the shingles themselves.

    A pair that is alike shares so many of its shingles that, ordered by how many classes have them, the first one both have
    stands early in each, the shorter one's place being bounded tighter, and enough shingles follow it in both. The lists of
    shingles of edited copies begin with those of their edits, which no other class has; copies too far apart never meet.
    """
    kept = picked(docs.select("doc_id", "text"), table(rest.select(F.col("rep").alias("doc_id")), "near-ids"))

    def per_partition():
        hashes = once("words", 0, lambda: WordHashes(REMEMBERED))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(x, width, hashes).view(np.int64) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "hashes"])

        return step

    sets = arrow_rows(kept, schema_with(kept.select(F.col("doc_id").alias("rep")), "hashes array<long>"), per_partition, "words").dropDuplicates(["rep"])
    posted = table(sets.join(rest, "rep").select("rep", "component", F.size("hashes").alias("n"), F.explode("hashes").alias("h")), "near-shingles")
    shared = posted.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    low, high = least
    ordered = posted.join(shared, "h").groupBy("rep", "component", "n").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("shared")).where(high * F.size("shared") >= low * F.col("n"))
    longer = F.col("n") - F.ceil(F.col("n") * low / high - 1e-9) + 1  # places within which the first common shingle of the longer one stands
    shorter = F.col("n") - F.ceil(F.col("n") * (2 * low) / (low + high) - 1e-9) + 1
    placed = ordered.select("rep", "component", "n", (F.col("n") - F.size("shared")).alias("alone"), F.posexplode("shared").alias("i", "s")).select("rep", "component", "n", (F.col("alone") + F.col("i") + 1).alias("p"), "s.h").where(F.col("p") <= longer)
    placed = table(placed.withColumn("early", F.col("p") <= shorter), "near-placed")
    x, y = (placed.select("h", "early", *(F.col(c).alias(f"{c}_{side}") for c in ("rep", "n", "component", "p"))) for side in "xy")
    first = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("rep_x") < F.col("rep_y")))
    room = 1 + F.least(F.col("n_x") - F.col("p_x"), F.col("n_y") - F.col("p_y"))
    enough = (low + high) * room >= low * (F.col("n_x") + F.col("n_y"))
    met = x.where("early").drop("early").join(y.drop("early"), "h").where(first & (F.col("component_x") != F.col("component_y")) & (high * F.col("n_x") >= low * F.col("n_y")) & enough)
    return met.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct()


def _sizes(n: F.Column, m: F.Column, least: tuple[int, int]) -> F.Column:
    """Whether sets of these sizes can be alike enough."""
    return F.least(n, m) * least[1] >= F.greatest(n, m) * least[0]


def _leader(turn: int) -> F.Column:
    """One member of a list: the one with the fewest pairs that no other class has, the least edited copy, at first; others by a hash later."""
    member = F.struct("rep", "n", "component")
    return F.min_by(member, F.struct("alone", "rep") if turn == 0 else F.xxhash64("rep", F.lit(turn)))


def spread(prefix: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The prefix postings with the component of each class: its own id where it has no link yet."""
    if labels is None:
        return prefix.withColumn("component", F.col("rep"))
    return prefix.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _labelled(every: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    several = classes.where("copies > 1").select("digest", "rep")
    rows = every.select("doc_id", "n_shingles", "digest").join(several, "digest", "left").withColumn("id", F.coalesce("rep", "doc_id"))
    rows = rows.join(labels, "id", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id")))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op9_near_dedup(spark, sf_dir):
    """doc_id, n_shingles, component_id and kept of every document, by shingles of four words."""
    from .common import read

    return groups(read(spark, sf_dir, "documents").select("doc_id", "text"), width=4)


#: All pairs with a shared shingle, and reachability; for small tables.
OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (n + m - c)), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, b.b FROM reached r JOIN sides b ON b.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least USING (doc_id)
"""
