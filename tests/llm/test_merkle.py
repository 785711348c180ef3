"""Merkle manifests against a plain tree in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from colloquy.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """The root, and each leaf's runs from below: (digests before it, digests after it)."""
    paths, spot = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for path, at in zip(paths, spot, strict=True):
            run = digests[at // 16 * 16 : at // 16 * 16 + 16]
            path.append((run[: at % 16], run[at % 16 + 1 :]))
        digests = [sha("".join(digests[k : k + 16])) for k in range(0, len(digests), 16)]
        spot = [at // 16 for at in spot]
    return digests[0], paths


def lowered(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    subs, out = [], []
    for source in sources:
        mine = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subs.append((mine, *tree([leaf_of(r) for r in mine])))
    root, upper = tree([s[1] for s in subs])
    for (mine, subroot, paths), above in zip(subs, upper, strict=True):
        for row, path in zip(mine, paths, strict=True):
            whole = path + above
            proof = sha("".join("".join(a + b) for a, b in whole))
            hit = zlib.crc32(b"" if row[0] is None else str(row[0]).encode()) % 5 == 0
            digest = leaf_of((*row[:4], lowered(row[4]))) if hit else leaf_of(row)
            for a, b in whole:
                digest = sha("".join([*a, digest, *b]))
            out.append((row[0], leaf_of(row), subroot, root, proof, digest, digest == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    sources = [None, "", "hot", "hot", "hot", "ä", "z", "Z"] + [f"s{k}" for k in range(20)]
    rows = [(k, rng.choice(sources), rng.choice(["en", None, ""]), rng.choice([None, k]), rng.choice([None, "", "plain", "Wörter UND Ähren", "A" * 70_000])) for k in range(n)]
    return rows + [(None, "hot", None, None, None), (None, None, None, None, "Null ID"), (3, "hot", "en", 1, "Twice"), (3, "hot", "en", 1, "Twice"), (3, "hot", "en", 1, "Other")] + [(-7, "alone", "en", 1, "One LEAF")]


@pytest.mark.parametrize("n", [0, 14, 700])
def test_against_a_plain_tree(spark, n):
    rows = corpus(n, n)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert rows_of(merkle.verified(df)) == sorted(brute(rows), key=str)


def test_one_source_one_row_and_no_rows(spark):
    for rows in ([(5, "a", "en", 1, "X")], [(k, "a", "en", 1, "X") for k in range(17)]):
        assert rows_of(merkle.verified(spark.createDataFrame(rows, SCHEMA))) == sorted(brute(rows), key=str)
    empty = merkle.verified(spark.createDataFrame([], SCHEMA))
    assert empty.columns == COLUMNS and empty.count() == 0


def test_tampering_shows_only_where_a_capital_went(spark):
    rows = [(k, "s", "en", 1, t) for k in range(60) for t in ["lower only", "With Capitals"]]
    for r in merkle.verified(spark.createDataFrame(rows, SCHEMA)).collect():
        hit = zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.verified == (not hit or r.leaf == leaf_of((r.doc_id, "s", "en", 1, "lower only")))


def test_general_manifest_with_clashing_columns(spark):
    rows = spark.createDataFrame([(k, k % 3, "x", "y") for k in range(40)], "id long, part int, path string, _n string").withColumn("digest", merkle.leaf(F.col("id")))
    m = merkle.manifest(rows, "part", [F.col("id")])
    found = m.leaves()
    digests = [[sha(f"{len(str(k))}:{k}") for k in range(40) if k % 3 == p] for p in range(3)]
    assert m.root() == tree([tree(d)[0] for d in digests])[0]
    assert found.select(merkle.folded(F.col("digest"), F.col("path")).alias("f")).distinct().collect() == [(m.root(),)]
    m.discard()
    assert merkle.manifest(rows.where("id < 0"), "part", [F.col("id")]).root() is None
