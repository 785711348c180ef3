"""The trie of conversations against plain tuples of turns."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from colloquy.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], digest(*t[1:])))] for c, turns in convs.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    say = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], say(ends[k])) for k, m in members.items()), key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def conversations(seed, n=260):
    rng = random.Random(seed)
    stock = [("user", "hello"), ("assistant", "hi ä"), ("system", "x"), ("user", ""), (None, None), ("u", "ser")]
    rows = []
    for c in range(n):
        own = c + 40 * (c % 3 == 0)
        for t in range(rng.choice([0, 1, 2, 3, 6, 8])):
            rows.append((own, t, *rng.choice(stock[: 2 + c % 5])))
    rows += [(7, None, "user", "null turn"), (7, None, None, "null turn"), (8, 1, "user", "twice"), (8, 1, "user", "twice"), (None, 0, "user", "nobody's"), (999, 0, "user", "L" * 50_000), (450, 0, "user", "base absent")]
    return rows


@pytest.mark.parametrize("hot", [prefix_trie.HOT, 2])
def test_against_tuples(spark, monkeypatch, hot):
    monkeypatch.setattr(prefix_trie, "HOT", hot)  # 2: nearly all pointers are salted
    rows = conversations(hot)
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(prefix_trie.trie(df)) == brute(rows)
    clashing = df.withColumns({"at": F.lit("x"), "prefix": F.lit(1), "_g": F.lit(2)})
    if hot > 2:
        assert rows_of(prefix_trie.trie(clashing)) == brute(rows)


def test_long_conversations_and_few(spark):
    long = [(c, t, "user", f"turn {t if t < 37 + c % 2 else (t, c)}") for c in (300, 301, 302) for t in range(45 + c % 3)]
    for rows in (long, [(5, 0, "a", "b")], [(200, 0, "a", "b"), (101, 0, "a", "b")]):
        assert rows_of(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    empty = prefix_trie.trie(spark.createDataFrame([], SCHEMA))
    assert empty.columns == COLUMNS and empty.count() == 0


def test_blocks_chain_like_whole_sequences(spark):
    """Blocks of three turns, three levels deep: equal beginnings, and only these, have equal digests, and parents are the ones before."""
    seqs = {1: [b"a"] * 30, 2: [b"a"] * 17 + [b"b"] * 13, 3: [b"a"] * 9, 4: [b"b"], 5: [b"a"] * 18 + [b"b"] * 3}
    rows = [(c, k, len(s) - 1 - k, bytearray(d)) for c, s in seqs.items() for k, d in enumerate(s)]
    df = spark.createDataFrame(rows, "conv_id long, at long, left long, digest binary")
    known, parents = {}, {}
    found = prefix_trie.chained(df, 3).collect()
    assert len(found) == len(rows)
    for r in found:
        key = tuple(seqs[r.conv_id][: r["at"] + 1])
        assert known.setdefault(key, bytes(r.prefix)) == bytes(r.prefix)
        parents[key] = r.parent and bytes(r.parent)
    assert len(set(known.values())) == len(known)
    assert all(parents[k] == known.get(k[:-1]) for k in known)


def test_ids_of_a_node_in_many_packs(spark, monkeypatch):
    ids = random.Random(1).sample(range(10**6), 5_000)
    ends = spark.createDataFrame([(bytearray(b"k"), c) for c in ids] + [(bytearray(b"l"), 3)], "prefix binary, conv_id long").repartition(9)
    found = {bytes(r.prefix): r.ends_sha256 for r in prefix_trie.listed(ends).collect()}
    assert found == {b"k": hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), b"l": hashlib.sha256(b"3").hexdigest()}
