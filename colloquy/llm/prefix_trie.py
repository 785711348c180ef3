"""A trie of conversations by their common beginnings, with counts and savings of every subtree.

A conversation's prefixes are known by chained digests of its turns, so equal beginnings have equal
digests wherever they lie; a digest of d turns points to that of the first d - 1, its parent.
What the nodes count is then rolled up by pointer jumping: in round k each node that is deep
enough hands the sums of its next 2^k levels to the ancestor 2^k levels up, and its pointer
becomes its ancestor's pointer. So all ancestors have their sums after about log2(depth) rounds.

Turns are dealt to ranges and digests chained in blocks of BLOCK turns, whose ends are chained in the
same way one level up, so that no task holds a conversation. Pointers to nodes with many
children are salted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC_SQL, discard, fold, in_arrow, placed, read, schema_with, table

#: Turns of a conversation that are chained by one task in order.
BLOCK = 1_024
#: Rows that point to one node before these are salted; more where otherwise over SALTED nodes would be listed.
HOT, SALTED = 1_000, 100_000
#: Characters of conversation ids that one row holds when a node's ids are listed.
LISTED = 1 << 20
#: Conversations of one block of so many ids begin with the first one's turns, fewer than TURNS.
FAMILY, TURNS = 100, 6
#: The digest of no turns.
ROOT = hashlib.sha256(b"").digest()


def turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows (conv_id, at from 0, left: turns after it, digest, points) of the rebuilt conversations; their ids (conv_id, n, the turns each has then); tables written.

    turns: conv_id, turn, digest, points. Conversation c has the first h turns of conversation c - c % FAMILY and then its own after
    its first h, where h is crc32(decimal c) % TURNS.
    """
    found, _, written = placed(turns, F.col("conv_id"), [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")])
    lined = found.select("conv_id", "_at", "_n", "digest", "points")
    ids = lined.where("_at = 0").select("conv_id", F.col("_n").alias("own"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), fold("conv_id", TURNS).cast("bigint").alias("h"))
    sizes = ids.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    head = F.least("h", F.coalesce("of_base", F.lit(0)))
    convs = table(ids.join(sizes, "base", "left").select("conv_id", "base", "h", head.alias("head"), (head + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"), "own"), "trie-conversations")
    firsts = lined.where(F.col("_at") < TURNS - 1).select(F.col("conv_id").alias("base"), "_at", "digest", "points")
    heads = convs.join(firsts, "base").where("_at < head").select("conv_id", F.col("_at").alias("at"), (F.col("n") - 1 - F.col("_at")).alias("left"), "digest", "points")
    # a conversation's own turns meet what is known of it by runs of BLOCK turns
    known = convs.select("conv_id", "h", "head", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(own - 1) div {BLOCK}"))).alias("_run"))
    own = lined.withColumn("_run", F.expr(f"_at div {BLOCK}")).join(known, ["conv_id", "_run"]).where("_at >= h").withColumn("at", F.col("head") + F.col("_at") - F.col("h"))
    rows = heads.unionByName(own.select("conv_id", "at", (F.col("n") - 1 - F.col("at")).alias("left"), "digest", "points"))
    return rows, convs.select("conv_id", "n"), [*written, convs]


def _chained(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Adds prefix and parent to rows in order of conversation and at, each chained from the start of its block. parent: null there."""
    before, so_far = None, b""
    for batch in batches:
        names = batch.schema.names
        prefixes, parents = [], []
        for conv, at, digest in zip(*(batch.column(names.index(c)).to_pylist() for c in ("conv_id", "at", "digest")), strict=True):
            key = conv, at // block
            parent = so_far if key == before else None
            so_far = hashlib.sha256((parent or b"") + digest).digest()
            before = key
            prefixes.append(so_far)
            parents.append(parent)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prefixes, pa.binary()), pa.array(parents, pa.binary())], names=[*names, "prefix", "parent"])


def chained(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (conv_id, at, left, digest, ...; at: 0, 1, 2, ... in each conversation, left: the rows after it there) with prefix, the digest of the digests so far, and parent, that
    of those before (null for the first)."""
    dealt = rows.withColumn("_block", F.expr(f"at div {block}")).repartition("conv_id", "_block").sortWithinPartitions("conv_id", "at")
    inner = table(in_arrow(dealt, lambda batches: _chained(batches, block), schema_with(dealt, "prefix binary", "parent binary")), "trie-chained")
    if (inner.agg(F.max("_block")).first()[0] or 0) == 0:
        return inner.drop("_block")
    # the blocks' ends are chained likewise; what lies before a block is then put before what is known inside
    ends = inner.where(F.expr(f"at % {block} = {block - 1}") | (F.col("left") == 0)).select("conv_id", F.col("_block").alias("at"), F.expr(f"(at + left) div {block} - _block").alias("left"), F.col("prefix").alias("digest"))
    outer = table(chained(ends, block).select("conv_id", F.col("at").alias("_block"), F.col("parent").alias("_outer"), F.col("digest").alias("_end")), "trie-blocks")
    both = lambda a, b: F.unhex(F.sha2(F.concat(F.lit(b"o"), a, b), 256))
    ended = outer.select("conv_id", (F.col("_block") + 1).alias("_block"), F.when(F.col("_outer").isNull(), F.col("_end")).otherwise(both(F.col("_outer"), F.col("_end"))).alias("_before"))
    near = outer.select("conv_id", "_block", "_outer").join(ended, ["conv_id", "_block"], "left")
    placed_ = inner.join(near, ["conv_id", "_block"])
    whole = lambda inside: F.when(F.col("_outer").isNull(), inside).otherwise(both(F.col("_outer"), inside))
    return placed_.withColumns({"prefix": whole(F.col("prefix")), "parent": F.when(F.col("parent").isNull(), F.col("_before")).otherwise(whole(F.col("parent")))}).drop("_block", "_outer", "_before")


def pointed(rows: DataFrame, key: str, to: DataFrame, counts: DataFrame) -> DataFrame:
    """rows left-joined to `to` by the column `key`, of which `to` has one row a value. counts: how many rows each value has, as (key, _c)
    with one row a value. Keys of many rows are salted: their row of `to` is repeated for every HOT rows."""
    most = max(HOT, counts.agg(F.sum("_c")).first()[0] or 0) if counts is not None else HOT
    hot = F.broadcast(table(counts.where(F.col("_c") > max(HOT, most // SALTED)).select(key, F.ceil(F.col("_c") / HOT).cast("int").alias("_copies")), "trie-hot"))  # SALTED rows at most
    one = F.coalesce("_copies", F.lit(1))
    salted = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64("prefix"), one).cast("int")).drop("_copies")
    repeated = to.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_copies")
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")


def rolled_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """prefix and the sum of each value over the node's subtree, itself included. nodes: prefix, parent (null for the root), depth, values."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    parts = [nodes.select("prefix", *values)]
    at, reach, gone = nodes.where("depth >= 1").select("prefix", F.col("parent").alias("pointer"), "depth", *values), 1, []
    while reach <= deepest:
        sums = table(at.groupBy("pointer").agg(*[F.sum(v).alias(v) for v in values], F.count("*").alias("_c")), "trie-sums")
        parts.append(sums.select(F.col("pointer").alias("prefix"), *values))
        gone.append(sums)
        if 2 * reach > deepest:
            break
        mine = sums.select(F.col("pointer").alias("prefix"), *[F.col(v).alias(f"_{v}") for v in values])
        deep = at.where(F.col("depth") >= 2 * reach).join(mine, "prefix", "left").select("prefix", "pointer", "depth", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
        # at depth 2 * reach the next pointer is the root, which nobody needs to be asked for
        far = deep.where(F.col("depth") > 2 * reach)
        jumps = at.where(F.col("depth") > reach).select(F.col("prefix").alias("pointer"), F.col("pointer").alias("_next"))
        counts = far.groupBy("pointer").agg(F.count("*").alias("_c"))
        moved = pointed(far, "pointer", jumps, counts).select("prefix", F.col("_next").alias("pointer"), "depth", *values)
        last, at = at, table(deep.where(F.col("depth") == 2 * reach).withColumn("pointer", F.lit(ROOT)).unionByName(moved), "trie-pointers")
        discard(last)
        gone.append(at)
        reach *= 2
    found = table(reduce(DataFrame.unionByName, parts).groupBy("prefix").agg(*[F.sum(v).alias(v) for v in values]), "trie-totals")
    for written in gone:
        discard(written)
    return found


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (prefix, conv_id) in order, as rows (prefix, conv_id, the first; ids, comma-joined, of LISTED characters or a few more)."""
    key, first, held, size = None, 0, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["prefix", "conv_id", "ids"])

    for batch in batches:
        for prefix, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (prefix != key or size > LISTED):
                yield row()
                held, size = [], 0
            if not held:
                key, first = prefix, conv
            held.append(str(conv))
            size += len(held[-1]) + 1
    if held:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None

    def rows(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([d for _, d in found], pa.string())], names=["prefix", "ends_sha256"])

    for batch in batches:
        done = []
        for prefix, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if prefix == key:
                digest.update(b"," + ids.encode())
            else:
                if digest:
                    done.append((key, digest.hexdigest()))
                key, digest = prefix, hashlib.sha256(ids.encode())
        if done:
            yield rows(done)
    if digest:
        yield rows([(key, digest.hexdigest())])


def listed(ends: DataFrame) -> DataFrame:
    """prefix and ends_sha256: the digest of its conv_ids, ascending and comma-joined. Ids are joined by ranges; one task then reads a
    node's joined ids as a stream, since a SHA-256 takes its text in order."""
    ranged = ends.select("prefix", "conv_id").repartitionByRange("prefix", "conv_id").sortWithinPartitions("prefix", "conv_id")
    packs = in_arrow(ranged, _packed, schema_with(ranged, "ids string"), gather=1_000)
    one = packs.repartition("prefix").sortWithinPartitions("prefix", "conv_id")
    return in_arrow(one, _hashed, schema_with(one.select("prefix"), "ends_sha256 string"))


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see rebuilt): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text. Turns are ordered by turn, null first, those of one turn by role and then digest; repeated rows are
    turns each. Null roles and texts are empty ones. Rows without a conv_id belong to no conversation and are left out. Extra columns
    are ignored, whatever their names. Long texts count whole. Without conversations there are no rows, else always the root's.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), turn_digest(role, text).alias("digest"), F.length(text).cast("bigint").alias("points"))
    rows, convs, written = rebuilt(turns)
    chain = chained(rows)
    below = chain.groupBy("prefix").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), (F.max("at") + 1).alias("depth"), F.max(F.coalesce("parent", F.lit(ROOT))).alias("parent"), F.max("points").alias("points"))
    top = convs.groupBy().agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = top.select(F.lit(ROOT).alias("prefix"), "n_convs", "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("points"))
    nodes = table(below.unionByName(root), "trie-nodes")
    children = table(nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("_c")), "trie-children")
    counted = nodes.join(children.select(F.col("parent").alias("prefix"), F.col("_c").alias("n_children")), "prefix", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    summed = rolled_up(counted.select("prefix", "parent", "depth", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = chain.where(F.col("left") == 0).select("prefix", "conv_id").unionByName(convs.where("n = 0").select(F.lit(ROOT).alias("prefix"), "conv_id"))
    about = counted.select("prefix", "conv_id", "depth", "n_convs", "n_children", "parent").join(summed, "prefix").join(listed(ends), "prefix", "left")
    named = pointed(about, "parent", nodes.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id")), children)
    none = hashlib.sha256(b"").hexdigest()
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir):
    """The trie of all conversations' beginnings."""
    return trie(read(spark, sf_dir, "conversations"))


OP13_SQL = """
WITH {crc}, own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations WHERE conv_id IS NOT NULL
), lined AS (
  SELECT conv_id, digest, length(text) AS points, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) - 1 AS spot FROM own
), convs AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {crc_of} % 6 AS h FROM own, crc
), parts AS (
  SELECT c.conv_id, 0 AS part, spot, digest, points FROM convs c JOIN lined l ON l.conv_id = c.base AND spot < h
  UNION ALL
  SELECT c.conv_id, 1, spot, digest, points FROM convs c JOIN lined l ON l.conv_id = c.conv_id AND spot >= h
), prefixes AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS key, points, lead(1) OVER w IS NULL AS ends FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, spot)
  UNION ALL
  SELECT c.conv_id, 0, '', 0, p.conv_id IS NULL FROM convs c LEFT JOIN (SELECT DISTINCT conv_id FROM parts) p ON p.conv_id = c.conv_id
), nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(points) AS points, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM prefixes GROUP BY key, depth
), children AS (
  SELECT left(key, 64 * (depth - 1)) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), rolled AS (
  SELECT left(n.key, 64 * up) AS key, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * points) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM nodes) n LEFT JOIN children c ON c.key = n.key GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM nodes n JOIN rolled r ON r.key = n.key LEFT JOIN children c ON c.key = n.key LEFT JOIN nodes p ON n.depth > 0 AND p.key = left(n.key, 64 * (n.depth - 1))
""".replace("{crc}", CRC_SQL[0]).replace("{crc_of}", CRC_SQL[1].format("conv_id"))
