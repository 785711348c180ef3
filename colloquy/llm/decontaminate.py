"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

A window of an item's length can reach the similarity only if 8 of 9 of its word shingles
(at 0.8) stand in the item. So it holds one of any ninth and one more of them: documents are
looked up under the shingles of an item that the fewest items share, and boilerplate calls up
nothing. Windows are then cut only where a document holds enough of an item's shingles: at the starts that line up a shared shingle's places, and all starts
between such. Between neighbours a and b, a window of n shingles holds at most 2 n - (b - a)
shared ones, so gaps that leave too few are skipped. Windows and items get 64-bit SimHashes
over their shingles, each occurrence hashed as a term of its own, so that a shingle repeated
k times weighs no more than k distinct ones. Multi-index blocks find all pairs within the
radius: two fingerprints that differ in at most R of 64 bits differ in at most R // B bits in
one of B blocks, so each item is filed under all near values of each of its blocks, and a
window is looked up there among the items that brought its document up. Pairs within the radius are held to the exact weighted Jaccard similarity of their shingles.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, table

BITS, BLOCKS, RADIUS = 64, 8, 23


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words: runs of digits, letters and any non-ASCII characters. None for null texts."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: str, width: int) -> Column:
    """Hashes of the runs of `width` words, in order; an empty list where there are fewer."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(width)]))
    return F.when(F.size(words) >= width, runs).otherwise(F.array().cast("array<bigint>"))


def fingerprints(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n (shingles with repeats) and fingerprint, from rows of keys, h and count: a bit is set if more than half the occurrences
    have it, each hashed with its number."""
    terms = shingles.select(*keys, "h", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("occurrence")).select(*keys, F.xxhash64("h", "occurrence").alias("term"))
    ones = [F.sum(F.shiftright("term", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS)]
    summed = terms.groupBy(*keys).agg(F.count("*").alias("n"), *ones)
    bits = [F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(BITS)]
    return summed.select(*keys, "n", reduce(lambda x, y: x.bitwiseOR(y), bits).alias("fingerprint"))


def _block(b: int) -> Column:
    width = BITS // BLOCKS
    return F.shiftright("fingerprint", b * width).bitwiseAND(F.lit((1 << width) - 1))


def _counted(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "h").agg(F.count("*").alias("count"))


def leaks(docs: DataFrame, items: DataFrame, width: int = 5, least: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, item_id, start_word and similarity: where a document's window of an item's length is best alike with the item.

    docs (doc_id, text), items (item_id, text). A pair is reported if least[1] * S >= least[0] for the weighted Jaccard
    similarity S of their shingles of `width` words (of all words in items with fewer); the best window counts, the first
    of equals. Null and empty texts, and texts without words, match nothing; rows with null ids are left out. Rows that repeat a
    doc_id or item_id are judged each, and the best counts. Extra columns are ignored, whatever their names. Very long texts and items
    are taken whole. Empty tables on either side give an empty one.
    """
    need = lambda n: F.ceil(n * (2 * least[0]) / (least[0] + least[1]) - 1e-9)  # noqa: E731  shared shingles, with repeats, of n
    i = items.where("item_id is not null").select("item_id", word_hashes(F.col("text")).alias("words")).where(F.size("words") > 0)
    i = i.withColumns({"size": F.size("words"), "m": F.least(F.size("words"), F.lit(width))})
    i = i.withColumn("shingles", reduce(lambda x, y: F.coalesce(x, y), [F.when(F.col("m") == m, shingle_hashes("words", m)) for m in range(1, width + 1)]))
    placed = table(i.select(F.xxhash64("words").alias("item_key"), "item_id", "size", "m", F.posexplode("shingles").alias("offset", "h")), "leak-items")
    widths = sorted(r[0] for r in placed.select("m").distinct().collect())
    per_item = table(placed.groupBy("item_key", "size", "m").agg(F.countDistinct("offset").alias("n")), "leak-items")

    d = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    hashed = d.select("doc_id", F.xxhash64("text").alias("row"), word_hashes(F.col("text")).alias("words"))
    of_width = [hashed.select("doc_id", "row", F.posexplode(shingle_hashes("words", m)).alias("p", "h")).withColumn("m", F.lit(m)) for m in widths or [width]]
    found = reduce(DataFrame.union, of_width)
    # a window that is alike holds one of the item's rarest shingles, so documents are looked up under those alone
    filed = table(placed.select("item_key", "size", "m", "offset", "h").distinct(), "leak-filed")
    spread = filed.select("m", "h", "item_key").distinct().groupBy("m", "h").agg(F.count("*").alias("items"))
    rarity = F.row_number().over(Window.partitionBy("item_key", "size").orderBy("items", "h", "offset"))
    few = F.col("n") - F.ceil(F.col("n") * least[0] / least[1] - 1e-9) + 1
    rare = filed.join(small(table(spread, "leak-spread")), ["m", "h"]).join(small(per_item.select("item_key", "size", "n")), ["item_key", "size"]).withColumn("k", rarity).where(F.col("k") <= few).select("item_key", "size", "m", "h").distinct()
    met = table(found.join(small(table(rare, "leak-rare")), ["m", "h"]).select("doc_id", "row", "m", "item_key", "size").distinct(), "leak-met")
    at = table(met.select("doc_id").distinct(), "leak-docs")
    suspects = table(d.join(small(at), "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("row"), word_hashes(F.col("text")).alias("words")).distinct(), "leak-texts")
    shingled = [suspects.select("doc_id", "row", F.lit(m).alias("m"), F.posexplode(shingle_hashes("words", m)).alias("p", "h")) for m in widths or [width]]
    asked = met.join(small(filed), ["item_key", "size", "m"])
    hits = asked.join(reduce(DataFrame.union, shingled), ["doc_id", "row", "m", "h"]).select("doc_id", "row", "item_key", "size", "p", (F.col("p") - F.col("offset")).alias("start"))
    dense = hits.groupBy("doc_id", "row", "item_key", "size").agg(F.size(F.collect_set("p")).alias("places"), F.sort_array(F.collect_set("start")).alias("starts"))
    dense = dense.join(small(per_item), ["item_key", "size"]).where(F.col("places") >= need(F.col("n")) * F.lit(least[0]) / F.lit(least[0] + least[1]))
    # from each aligned start on to the next, unless no window between them can hold the shared shingles needed; windows before the
    # first hold no more than it, but as much for as many places as shingles may be missing
    ends = F.transform("starts", lambda s, k: F.struct(F.when(k == 0, s - (F.col("n") - need(F.col("n")))).otherwise(s).alias("a"), s.alias("s"), F.coalesce(F.get(F.col("starts"), k + 1), s).alias("b")))
    spans = dense.select("doc_id", "row", "item_key", "size", "m", "n", F.explode(ends).alias("s"))
    spans = spans.select("doc_id", "row", "item_key", "size", "m", F.col("s.a").alias("a"), F.when(F.col("s.b") - F.col("s.s") <= 2 * F.col("n") - need(F.col("n")), F.col("s.b")).otherwise(F.col("s.s")).alias("b"))
    each = spans.select("doc_id", "row", "item_key", "size", "m", F.explode(F.sequence("a", "b")).alias("start"))
    sized = suspects.select("doc_id", "row", F.size("words").alias("words"))
    each = each.join(small(table(sized, "leak-sizes")), ["doc_id", "row"]).withColumn("start", F.greatest(F.lit(0), F.least(F.col("start"), F.col("words") - F.col("size")))).drop("words")
    starts = table(each.distinct(), "leak-starts")

    cut = suspects.join(starts.drop("item_key").distinct(), ["doc_id", "row"]).select("doc_id", "row", "size", "m", "start", F.slice("words", F.col("start") + 1, F.col("size")).alias("words"))
    if widths:
        cut = cut.withColumn("shingles", reduce(lambda x, y: F.coalesce(x, y), [F.when(F.col("m") == m, shingle_hashes("words", m)) for m in widths]))
    else:
        cut = cut.withColumn("shingles", F.array().cast("array<bigint>"))
    window = ["doc_id", "row", "size", "start"]
    pieces = table(_counted(cut.select(*window, F.explode("shingles").alias("h")), window), "leak-windows")
    item_pieces = table(_counted(placed.select("item_key", "size", "offset", "h").distinct(), ["item_key", "size"]), "leak-items")

    windows, marked = fingerprints(pieces, window), table(fingerprints(item_pieces, ["item_key", "size"]), "leak-items")
    masks = [sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BITS // BLOCKS), k)]
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), _block(b).alias("value")) for b in range(BLOCKS)])
    near = marked.select("item_key", "size", F.col("n").alias("n_item"), F.col("fingerprint").alias("fingerprint_item"), F.explode(blocks).alias("e")).select("*", F.explode(F.array(*map(F.lit, masks))).alias("mask"))
    filed = table(near.select("item_key", "size", "n_item", "fingerprint_item", "e.block", F.col("e.value").bitwiseXOR(F.col("mask").cast("bigint")).alias("value")), "leak-blocks")
    # a window is looked up among the items whose shingles its document holds, so rows joined grow with matches and not with items
    met = starts.select(*window, "item_key").join(windows.select(*window, "n", "fingerprint", F.explode(blocks).alias("e")), window).select(*window, "item_key", "n", "fingerprint", "e.*").join(small(filed), ["size", "item_key", "block", "value"])
    close = met.where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("fingerprint_item"))) <= RADIUS).select(*window, "n", "item_key", "n_item").distinct()

    common = close.join(pieces.withColumnRenamed("count", "times"), window).join(small(item_pieces), ["item_key", "size", "h"]).groupBy(*window, "n", "item_key", "n_item").agg(F.sum(F.least("times", "count")).alias("both"))
    union = F.col("n") + F.col("n_item") - F.col("both")
    alike = common.where(least[1] * F.col("both") >= least[0] * union).withColumn("similarity", F.col("both") / union)
    named = alike.join(small(table(placed.select("item_key", "item_id").distinct(), "leak-names")), "item_key")
    best = named.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.start").cast("long").alias("start_word"), (-F.col("b.s")).alias("similarity"))


def op10_decontaminate(spark, sf_dir):
    """doc_id, item_id, start_word and similarity of every benchmark item that stands in a document."""
    from .common import read

    return leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))
