"""A Merkle manifest of a dataset, its proofs and what they say of rows that were tampered with.

Rows are leaves of a tree for each group; the groups' roots are leaves of one more tree. For every
parent the manifest stores its preimage, that is its children's digests one after the other. A
leaf joins its ancestors' preimages: cutting its own slot of 64 characters out of each gives the
siblings, and putting another digest into that slot gives what a changed row folds to.

Digests are SHA-256 as lower-case hexadecimal text. Trees grow level by level, so that a task
holds FAN digests; leaves get their places by ranges of group and order, so that no task
holds a group, however large. Ancestors' preimages go down from parents to their children, never
to all leaves of a group by one key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC_SQL, discard, fold, placed, read, table

#: Children of a parent, and characters of a digest.
FAN, DIGEST = 16, 64
#: Leaves whose ids' CRC these divide get tampered with in op12.
TAMPERED = 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 bytes' number, a colon and the value; integers are written decimally."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row of these values, nulls included."""
    return digest_of(F.concat(*map(field, values)))


def grown(leaves: DataFrame, most: int) -> list[DataFrame]:
    """The levels of the groups' trees, leaves (_g, _at, _n, digest; at most `most` a group) first: while a group has several nodes, every FAN consecutive ones
    become the digest of their digests. Each level above is a written table of _g, _at, _n, preimage and digest."""
    levels = [leaves]
    while most > 1:
        runs = levels[-1].where("_n > 1").select("_g", F.expr(f"_at div {FAN}").alias("_up"), F.expr(f"cast(ceil(_n / {FAN}) as bigint)").alias("_m"), "_at", "digest")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "digest"))), lambda c: c["digest"]), "")  # FAN digests at most
        parents = runs.groupBy("_g", "_up", "_m").agg(joined.alias("preimage"))
        levels.append(table(parents.select("_g", F.col("_up").alias("_at"), F.col("_m").alias("_n"), "preimage", digest_of(F.col("preimage")).alias("digest")), "merkle-level"))
        most = -(-most // FAN)
    return levels


def with_paths(levels: list[DataFrame], crown: Callable[[DataFrame], DataFrame], handed: list[str]) -> DataFrame:
    """The leaves with their paths: for each ancestor from the parent up its preimage and the slot of the child that leads to the leaf.
    crown adds path (from a group's own root up) and the columns `handed`, which go down to all leaves, to groups' roots."""
    above = None
    for level in reversed(levels):
        here = crown(level.where("_n = 1"))
        if above is not None:
            up = above.select("_g", F.col("_at").alias("_up"), F.col("preimage").alias("_preimage"), F.col("path").alias("_path"), *handed)
            step = F.struct(F.col("_preimage").alias("preimage"), F.expr(f"cast(_at % {FAN} as int)").alias("slot"))
            below = level.where("_n > 1").withColumn("_up", F.expr(f"_at div {FAN}")).join(up, ["_g", "_up"])
            here = here.unionByName(below.withColumn("path", F.concat(F.array(step), "_path")).select(*here.columns))
        above = here
    return above


def _left(step: Column) -> Column:
    return F.substring(step["preimage"], F.lit(1), step["slot"] * DIGEST)


def _right(step: Column) -> Column:
    return F.substring(step["preimage"], step["slot"] * DIGEST + DIGEST + 1, F.length(step["preimage"]))


def proof_digest(path: Column) -> Column:
    """The digest of a path's siblings, level by level upward, left to right."""
    return digest_of(F.array_join(F.transform(path, lambda s: F.concat(_left(s), _right(s))), ""))


def folded(start: Column, path: Column) -> Column:
    """The root to which a leaf folds along its path."""
    return F.aggregate(path, start, lambda so_far, s: digest_of(F.concat(_left(s), so_far, _right(s))))


@dataclass
class Manifest:
    """levels: those of the groups' trees, leaves first; tree: those of the tree over the groups' roots; written: the tables below."""

    levels: list[DataFrame]
    tree: list[DataFrame]
    written: list[DataFrame]

    def root(self) -> str | None:
        """None for an empty dataset."""
        found = self.tree[-1].first()
        return found and found["digest"]

    def leaves(self) -> DataFrame:
        """The leaves with subroot, root and path, which leads to the root."""
        own = {"path": F.array().cast("array<struct<preimage:string,slot:int>>"), "root": F.lit(self.root()).cast("string")}
        tops = with_paths(self.tree, lambda roots: roots.withColumns(own), ["root"])
        groups = table(tops.select(F.col("group").alias("_g"), "path", "root", F.col("digest").alias("subroot")), "merkle-groups")
        self.written.append(groups)
        return with_paths(self.levels, lambda roots: roots.join(groups, "_g"), ["root", "subroot"])

    def discard(self) -> None:
        """Deletes the written tables; nothing of the manifest may be read again."""
        for written in [*self.levels[1:], *self.tree[1:], *self.written]:
            discard(written)


def manifest(rows: DataFrame, group: str, order: list[Column]) -> Manifest:
    """The manifest of rows that have a column `digest`: a tree for each value of the column `group` over its rows in this order, and a tree over their
    roots, ordered by group (null first, then by UTF-8 bytes). Rows of one order and group should be told apart by their digest in
    `order`; rows that are equal may stand in any order, which changes nothing.

    Null groups are a group of their own, other than empty text. An empty table gives an empty manifest without a root. A lone node is
    its group's root as it is. Rows may have any further columns but _g, _at, _n, _row, _part, path, root and subroot, which are replaced.
    """
    own = rows.drop("_g", "_at", "_n", "_row", "_part", "path", "root", "subroot")
    leaves, most, written = placed(own, F.col(group), order)
    levels = grown(leaves, most)
    roots = reduce(DataFrame.union, [level.where("_n = 1").select(F.col("_g").alias("group"), "digest") for level in levels])
    tops, groups, more = placed(roots, F.lit(None).cast("string"), [F.col("group")])
    return Manifest(levels, grown(tops, groups), written + more)


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root and proof_sha256 of each row of docs (doc_id, source, lang, n_chars, text), and folded_root and verified for what the row became: where
    TAMPERED divides crc32(decimal doc_id), only A-Z of its text are lower-cased, else it is as before.

    Rows are ordered by doc_id in their source, null ids first, rows of one id by their digest. A null id counts as empty text in
    the CRC, so it is tampered with; a null text stays null, so its row is verified, as is one without capitals. Repeated rows are leaves each.
    Extra columns are ignored, whatever their names. Long texts are hashed whole. An empty table gives an empty one.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    cols = {c: F.col(c) for c in columns}
    changed = leaf(*(cols | {"text": F.translate("text", UPPER, UPPER.lower())}).values())
    hit = fold("doc_id", TAMPERED) == 0
    rows = docs.select("doc_id", "source", leaf(*cols.values()).alias("digest"), F.when(hit, changed).alias("changed"))
    leaves = manifest(rows, "source", [F.col("doc_id").asc_nulls_first(), F.col("digest")]).leaves()
    return leaves.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("changed", "digest"), F.col("path")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark, sf_dir):
    """The Merkle manifest of all documents, by source, and the verdict on tampered rows."""
    return verified(read(spark, sf_dir, "documents"))


OP12_SQL = """
WITH RECURSIVE {crc},
hit AS (
  SELECT DISTINCT doc_id, {crc_of} % 5 = 0 AS hit
  FROM documents, crc WHERE doc_id IS NOT NULL
), fields AS (
  SELECT d.doc_id, source, coalesce(hit, TRUE) AS hit, text, concat(coalesce(octet_length(encode(d.doc_id::VARCHAR)) || ':' || d.doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
    coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')) AS head,
    CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' END AS tail FROM documents d LEFT JOIN hit h ON d.doc_id = h.doc_id
), hashed AS (
  SELECT doc_id, source, sha256(head || tail || coalesce(text, '')) AS leaf,
    CASE WHEN hit THEN sha256(head || tail || coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')) ELSE sha256(head || tail || coalesce(text, '')) END AS changed FROM fields
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed
), nodes(source, lvl, pos, n, digest) AS (
  SELECT source, 0, pos, count(*) OVER (PARTITION BY source), leaf FROM leaves
  UNION ALL
  SELECT source, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY source, lvl, n, pos // 16
), subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1
), tree(lvl, pos, n, digest) AS (
  SELECT 0, pos, count(*) OVER (), subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lvl, n, pos // 16
), runs AS (
  SELECT source, lvl, pos // 16 AS run, list(digest ORDER BY pos) AS kin FROM nodes WHERE n > 1 GROUP BY ALL
), tree_runs AS (
  SELECT lvl, pos // 16 AS run, list(digest ORDER BY pos) AS kin FROM tree WHERE n > 1 GROUP BY ALL
), steps AS (
  SELECT l.source, l.pos, lvl, kin, (l.pos // (16 ** lvl)::BIGINT) % 16 AS slot FROM leaves l JOIN runs r ON r.source IS NOT DISTINCT FROM l.source AND r.run = l.pos // (16 ** (lvl + 1))::BIGINT
  UNION ALL
  SELECT l.source, l.pos, 1000 + lvl, kin, (s.pos // (16 ** lvl)::BIGINT) % 16 FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN tree_runs r ON r.run = s.pos // (16 ** (lvl + 1))::BIGINT
), cut AS (
  SELECT source, pos, list({'l': array_to_string(kin[:slot], ''), 'r': array_to_string(kin[slot + 2:], '')} ORDER BY lvl) AS path FROM steps GROUP BY source, pos
), found AS (
  SELECT doc_id, leaf, changed, subroot, (SELECT digest FROM tree WHERE n = 1) AS root, coalesce(path, []) AS path FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
  LEFT JOIN cut c ON c.source IS NOT DISTINCT FROM l.source AND c.pos = l.pos
), folding AS (
  SELECT *, sha256(list_aggregate(list_prepend('', [p.l || p.r FOR p IN path]), 'string_agg', '')) AS proof_sha256,
    list_reduce(list_prepend({'l': changed, 'r': ''}, path), lambda a, p: {'l': sha256(p.l || a.l || p.r), 'r': ''}).l AS folded_root FROM found
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folding
""".replace("{crc}", CRC_SQL[0]).replace("{crc_of}", CRC_SQL[1].format("doc_id"))
