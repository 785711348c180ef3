"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

The terms of a text are its words, weighted by how often they occur. For each of K samples
and each term, hashes of term and sample give r and c from Gamma(2, 1) and b from the unit
interval; with t = floor(ln w / r + b) the sample takes the term of the least

    ln a = ln c - r (t - b + 1)

and two texts take the same (term, t) with probability equal to the generalised Jaccard
similarity of their weights, sum of minima over sum of maxima. A fingerprint is the K
samples, each as a number that orders by ln a and tells term and t.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 32
#: Documents to a range of ids, and ranges at most.
RANGE_DOCS, RANGES = 1_500, 1 << 16


def _uniform(seed: Column, at: int, bits: int) -> Column:
    """A number inside (0, 1) from some bits of a 64-bit hash."""
    return (F.shiftrightunsigned(seed, at).bitwiseAND(F.lit((1 << bits) - 1)) + 0.5) / float(1 << bits)


def sample(term: Column, ln_weight: Column, k: int) -> Column:
    """Sample k's number for a term; the least over a text's terms is the text's."""
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.ln(_uniform(one, 0, 32) * _uniform(one, 32, 32))
    ln_c = F.ln(-F.ln(_uniform(two, 0, 20) * _uniform(two, 20, 20)))
    b = _uniform(two, 40, 24)
    ln_a = ln_c - r * (F.floor(ln_weight / r + b) - b + 1)
    # 41 bits of order, 22 bits of the term; ln a lies well inside +-100
    return F.shiftleft(((ln_a + 128.0) * float(1 << 33)).cast("long"), 22).bitwiseOR(one.bitwiseAND(F.lit((1 << 22) - 1)))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and samples (K numbers; null without words), from rows already dealt out by some of the keys, which must tell rows apart."""
    words = texts.select(*keys, F.explode_outer(F.split(F.col(text), r"[\x00-\x20]+")).alias("word"))
    weights = words.select(*keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("term")).groupBy(*keys, "term").agg(F.ln(F.count("*")).alias("ln_weight"))
    least = weights.groupBy(*keys).agg(*[F.min(F.when(F.col("term").isNotNull(), sample(F.col("term"), F.col("ln_weight"), k))).alias(f"s{k}") for k in range(K)])
    return least.select(*keys, F.when(F.col("s0").isNotNull(), F.array(*[f"s{k}" for k in range(K)])).alias("samples"))


def likeness(a: str, b: str) -> Column:
    """The share of equal samples; texts without words are like each other and unlike all others."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / float(K)
    return F.when(F.col(a).isNull() | F.col(b).isNull(), (F.col(a).isNull() & F.col(b).isNull()).cast("double")).otherwise(equal)


def printed(samples: str) -> Column:
    return F.coalesce(F.concat_ws("", F.transform(samples, lambda x: F.lpad(F.hex(x), 16, "0"))), F.lit(""))


def ranges(docs: DataFrame) -> list[int]:
    """Bounds that cut the ids into ranges of about RANGE_DOCS documents; as many as a power of two less one."""
    n = docs.count()
    bits = max(1, min(RANGES, -(-n // RANGE_DOCS))).bit_length()
    size = (1 << bits) - 1
    found = docs.agg(F.percentile_approx("doc_id", [(k + 1) / (size + 1) for k in range(size)], 8 * (size + 1))).first()[0] or []
    return sorted(found) + [2**63 - 1] * (size - len(found))


def range_of(doc_id: Column, bounds: Column, size: int) -> Column:
    """How many bounds are at most the id, by binary search; null ids come before all."""
    steps = [1 << k for k in reversed(range(size.bit_length()))]
    at = F.lit(0)
    found = F.aggregate(F.array(*map(F.lit, steps)), at, lambda lo, step: F.when(F.get(bounds, lo + step - 1) <= doc_id, lo + step).otherwise(lo))
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(found)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """range, row (its place there), extra, doc_id, text and edited of each row: the last floor(n / 2) code points of the text replaced by the first as many (or all) of the
    next document's, ascending ids, rows of one id by their text's hash; after the last comes the first. Null texts are empty.

    One shuffle of the texts, by ranges of ids; each range also gets the first document of the next one,
    marked extra and without an edited text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = ranges(rows.select("doc_id"))
    held = F.array(*map(F.lit, bounds))
    rows = rows.withColumns({"range": range_of(F.col("doc_id"), held, len(bounds)), "extra": F.lit(False)})
    firsts = rows.groupBy("range").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("first")).orderBy("range").collect()  # at most RANGES rows
    if not firsts:
        return rows.select("range", F.lit(1).alias("row"), "extra", "doc_id", "text", F.col("text").alias("edited"))
    before = {b["first"]: a["range"] for a, b in zip([firsts[-1], *firsts], firsts, strict=False)}
    ids = docs.sparkSession.createDataFrame(sorted(before.items()), "first long, before int")
    extra = rows.join(F.broadcast(ids), F.coalesce("doc_id", F.lit(-(2**63))) == F.col("first")).select("doc_id", "text", F.col("before").alias("range"), F.lit(True).alias("extra"))
    order = Window.partitionBy("range").orderBy("extra", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    # a partition for each range keeps the tables of terms below small
    after = rows.unionByName(extra).repartition(len(bounds) + 1, "range").select("range", "extra", "doc_id", "text", F.lead("text").over(order).alias("next"), F.row_number().over(order).alias("row"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    return after.select("range", "row", "extra", "doc_id", "text", F.when(~F.col("extra"), edited).alias("edited"))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row of docs (doc_id, text).

    near_edited: likeness of the text's fingerprint to the edited text's; near_next: to the next document's. Null and empty
    texts have empty fingerprints, which are like each other (1) and unlike all others (0). A single row is its own next.
    Extra columns are ignored, whatever their names; rows that repeat are judged each. Very long texts are taken whole. An empty
    table gives an empty one.
    """
    pairs = edited_pairs(docs)
    both = pairs.select("range", "row", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("text")), F.struct(F.lit(1).alias("k"), F.col("edited").alias("text")))).alias("v"))
    both = both.select("range", (F.col("row") * 2 + F.col("v.k")).cast("long").alias("row"), "v.text").where("text is not null")
    prints = fingerprints(both, ["range", "row"])
    # rows of a range: text, edited text, next text, ...
    order = Window.partitionBy("range").orderBy("row")
    lined = prints.select("range", "row", "samples", F.lead("samples", 1).over(order).alias("edited"), F.lead("samples", 2).over(order).alias("next"))
    lined = lined.where(F.col("row") % 2 == 0).select("range", F.expr("cast(row div 2 as int)").alias("row"), printed("samples").alias("fingerprint"), printed("edited").alias("edited_fingerprint"), likeness("samples", "edited").alias("near_edited"), likeness("samples", "next").alias("near_next"))
    about = pairs.where(~F.col("extra")).select("range", "row", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    return about.join(lined, ["range", "row"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_fingerprints(spark, sf_dir):
    """Fingerprints of every document and its edited text, and how alike they are."""
    from .common import read

    return compared(read(spark, sf_dir, "documents").select("doc_id", "text"))
