"""Operators over a whole corpus: fingerprints, language model, near duplicates, leaks, pipeline."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, fingerprint, lm_score, near_dedup

WORDS = [f"w{k}" for k in range(400)]


def texts(seed, n=60):
    """Texts with exact copies, edited copies, a shared passage, empty and short ones."""
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) for _ in range(rng.randint(1, 120))] for _ in range(n)]
    passage = [rng.choice(WORDS) for _ in range(25)]
    for w in list(base[: n // 2]):
        for edits in (0, 1, 2, 3, 5):
            c = list(w)
            for _ in range(edits):
                c[rng.randrange(len(c))] = rng.choice(WORDS)
            base.append(c)
    base += [w + passage for w in base[:20]]
    return [None, "", " \n", "one", "one", "two words", "Two  WORDS"] + [" ".join(w) for w in base]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = list(enumerate(texts(1)))
    random.Random(0).shuffle(rows)
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, kept int").repartition(5), dict(rows)


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_groups(docs, width):
    sets = {i: shingle_set(t, width) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_near_dedup(corpus, width):
    df, docs = corpus
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(df, width).collect()}
    assert got == brute_groups(docs, width)


def test_near_dedup_cases(spark):
    one = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "A b  c d e"), (3, None)], "doc_id long, text string")
    rows = collections.Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.groups(one, 4).collect())
    assert rows == {(None, None, False): 1, (7, 7, True): 2, (9, 7, False): 1, (3, 3, True): 1}
    assert near_dedup.groups(one.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (103, 101)], "a long, b long")
    found = {r.id: r.component for r in near_dedup.components(edges).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}


def test_fingerprints(spark, corpus):
    df, docs = corpus
    rows = {r.doc_id: r for r in fingerprint.compared(df).collect()}
    assert len(rows) == len(docs)
    ids = sorted(docs)
    errors = []
    count = lambda t: collections.Counter(w for w in re.split(r"[\x00-\x20]+", t) if w)
    for k, i in enumerate(ids):
        text, after = docs[i] or "", docs[ids[(k + 1) % len(ids)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((rows[i].near_edited, edited), (rows[i].near_next, after)):
            a, b = count(text), count(other)
            true = sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0
            errors.append(near - true)
            assert true not in (0.0, 1.0) or near == true
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.45
    by_text = collections.defaultdict(set)
    for i in ids:
        by_text[docs[i] or ""].add(rows[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprint_cases(spark):
    schema = "doc_id long, text string"
    assert fingerprint.compared(spark.createDataFrame([], schema)).count() == 0
    (alone,) = fingerprint.compared(spark.createDataFrame([(5, "a b")], schema)).collect()
    assert (alone.near_edited, alone.near_next, alone.n_chars) == (1.0, 1.0, 3) or alone.near_next == 1.0
    many = fingerprint.compared(spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "c"), (6, None)], schema)).collect()
    assert len(many) == 4


def learnt_from_even(df):
    return df.withColumn("learn", F.col("doc_id") % 2 == 0)


def test_language_model_counts(spark, corpus):
    df, docs = corpus
    rows = {r.doc_id: r for r in lm_score.score(learnt_from_even(df).withColumn("score", F.lit(1)).withColumn("block", F.lit("x")), "learn").collect()}
    c = collections.Counter(w for i, t in docs.items() if i % 2 == 0 for w in lm_score.tokens_of(t))
    n, v = sum(c.values()), len(c)
    assert set(rows) == set(docs)
    for i, t in docs.items():
        tokens = lm_score.tokens_of(t)
        assert rows[i].n_tokens == len(tokens) and rows[i].n_known == sum(c[w] > 0 for w in tokens) and rows[i].train_tokens == n
        assert math.isclose(rows[i].base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel_tol=1e-9, abs_tol=1e-9)
        assert rows[i].score < 0 and rows[i].block == "x" and "text" not in rows[i]


def brute_language_model(texts, scored, sweeps, burn_in, strength, rng):
    """Log10 probabilities of the scored texts: a plain sampler that moves every customer of every restaurant in each sweep."""
    end = lm_score.END
    pairs = collections.Counter()
    for t in texts:
        w = lm_score.tokens_of(t)
        pairs.update(zip([end, *w], w, strict=False))
    counts = collections.Counter()
    for (_, w), n in pairs.items():
        counts[w] += n
    vocabulary = sorted(counts)
    once, twice = (sum(n == k for n in pairs.values()) for k in (1, 2))
    d = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
    below = collections.Counter(w for _, w in pairs)
    once, twice = (sum(n == k for n in below.values()) for k in (1, 2))
    d0 = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
    tables, root = collections.defaultdict(list), collections.defaultdict(list)
    n_root, t_root, t_of = 0, 0, collections.Counter()

    def root_p(w):
        own = sum(root[w]) - d0 * len(root[w]) if w in root else 0
        return (own + (strength + d0 * t_root) / (len(vocabulary) + 1)) / (strength + n_root)

    def sit(seats, weight, discount):
        r = rng.random() * (weight + sum(k - discount for k in seats))
        for i, k in enumerate(seats):
            r -= k - discount
            if r < 0:
                seats[i] += 1
                return False
        seats.append(1)
        return True

    def rise(seats):
        r = rng.randrange(sum(seats))
        for i, k in enumerate(seats):
            r -= k
            if r < 0:
                seats[i] -= 1
                if not seats[i]:
                    del seats[i]
                    return True
                return False

    def enter(u, w):
        nonlocal n_root, t_root
        if sit(tables[u, w], (strength + d * t_of[u]) * root_p(w), d):
            t_of[u] += 1
            t_root += sit(root[w], (strength + d0 * t_root) / (len(vocabulary) + 1), d0)
            n_root += 1

    def leave(u, w):
        nonlocal n_root, t_root
        if rise(tables[u, w]):
            t_of[u] -= 1
            t_root -= rise(root[w])
            n_root -= 1

    n_of = collections.Counter()
    for (u, w), n in pairs.items():
        n_of[u] += n
        for _ in range(n):
            enter(u, w)
    total = [[0.0] * (len(lm_score.tokens_of(t))) for t in scored]
    for number in range(1, sweeps + 1):
        for (u, w), n in pairs.items():
            for _ in range(n):
                leave(u, w)
                enter(u, w)
        if number > burn_in:
            for row, t in zip(total, scored, strict=True):
                w = lm_score.tokens_of(t)
                for k, (u, x) in enumerate(zip([end, *w], w, strict=False)):
                    own = sum(tables[u, x]) - d * len(tables[u, x]) if (u, x) in pairs else 0
                    row[k] += (own + (strength + d * t_of[u]) * root_p(x)) / (strength + n_of[u])
    return [sum(math.log10(p / (sweeps - burn_in)) for p in row) for row in total], [sum(p / (sweeps - burn_in) for p in row) for row in total]


def test_language_model_against_a_plain_sampler(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SWEEPS", 24)
    monkeypatch.setattr(lm_score, "BURN_IN", 4)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(14)]
    made = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(14)], k=rng.randint(1, 14))) for _ in range(70)]
    learnt, other = made[:50], [*made[50:], "never w1", "", None]
    rows = [(k, t, k < 50) for k, t in enumerate(learnt + other)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3)
    got = {r.doc_id: r for r in lm_score.score(df, "learn").collect()}
    want, _ = brute_language_model(learnt, learnt + other, 120, 20, lm_score.STRENGTH, rng)
    each = [(got[k].score - want[k]) / got[k].n_tokens for k in range(len(rows))]
    assert max(map(abs, each)) < 0.1 and abs(sum(each) / len(each)) < 0.01


def test_seating_follows_its_distribution():
    """Tables of a dish of c customers: t with weight S(c, t) x ** t, for generalised Stirling numbers S."""
    for c, x, d in ((2, 0.3, 0.7), (5, 0.8, 0.6), (9, 2.5, 0.4)):
        stirling = {(1, 1): 1.0}
        for n in range(1, c):
            for t in range(1, n + 2):
                stirling[n + 1, t] = stirling.get((n, t - 1), 0) + (n - t * d) * stirling.get((n, t), 0)
        weight = np.array([stirling[c, t] * x**t for t in range(1, c + 1)])
        n = 20_000
        customers, x_ = np.full(n, c), np.full(n, x)
        sizes, t = lm_score.begun(customers, x_, d)
        for sweep in range(1, 12):
            sizes, t = lm_score.reseated(sizes, t, customers, x_, d, lm_score.Chance(np.arange(n, dtype=np.uint64), sweep))
            assert (np.add.reduceat(sizes, np.cumsum(t) - t) == c).all() and sizes.min() >= 1
        assert abs(np.bincount(t, minlength=c + 1)[1:] / n - weight / weight.sum()).max() < 0.015


def test_newcomers_and_leavers():
    customers = np.array([3, 40, 1, 7])
    sizes, t = np.array([1, 1, 1, 5, 2, 1]), np.array([3, 1, 1, 1])
    sizes, t = lm_score.reseated(sizes, t, customers, np.full(4, 0.5), 0.5, lm_score.Chance(np.arange(4, dtype=np.uint64), 1))
    assert np.add.reduceat(sizes, np.cumsum(t) - t).tolist() == customers.tolist()


def test_chance_gamma():
    for shape in (1.0, 4.5, 300.0):
        drawn = lm_score.Chance(np.arange(40_000, dtype=np.uint64), 3).gamma(np.full(40_000, shape))
        assert abs(drawn.mean() / shape - 1) < 0.03 and abs(drawn.var() / shape - 1) < 0.06


def test_language_model_cases(spark):
    schema = "doc_id long, text string, learn boolean"
    unlearnt = lm_score.score(spark.createDataFrame([(1, "a b", False), (2, None, None)], schema), "learn").orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in unlearnt] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert lm_score.score(spark.createDataFrame([], schema), "learn").count() == 0
    again = [(7, "a b a b", True), (7, "a b a b", True), (None, "x " * 50_000, False), (8, "", True)]
    names = ["_row", "bucket", "values", "n_tokens", "codes", "words"]
    df = spark.createDataFrame(again, schema).withColumns({c: F.lit("mine") for c in names})
    rows = lm_score.score(df, "learn").collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 50_001), (7, 5), (7, 5), (8, 1)]
    assert all(r[c] == "mine" for r in rows for c in names if c != "n_tokens") and len({r.score for r in rows if r.doc_id == 7}) == 1


def test_language_model_blocks_agree(spark, corpus, monkeypatch):
    df, docs = corpus
    whole = {r.doc_id: r for r in lm_score.score(learnt_from_even(df), "learn").collect()}
    monkeypatch.setattr(lm_score, "BLOCK", 300)
    monkeypatch.setattr(lm_score, "BUCKET_DOCS", 20)
    for r in lm_score.score(learnt_from_even(df), "learn").collect():
        assert (r.n_tokens, r.n_known) == (whole[r.doc_id].n_tokens, whole[r.doc_id].n_known) and math.isclose(r.base_score, whole[r.doc_id].base_score)
        assert abs(r.score - whole[r.doc_id].score) < 0.02 * r.n_tokens


def brute_leaks(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    runs = lambda w, m: collections.Counter(tuple(w[k : k + m]) for k in range(len(w) - m + 1))
    out = {}
    for i, t in docs.items():
        w = cut(t)
        for k, item in items.items():
            x = cut(item)
            m = min(5, len(x))
            if not m:
                continue
            a, best = runs(x, m), (0.0, 0)
            for s in range(max(1, len(w) - len(x) + 1)):
                b = runs(w[s : s + len(x)], m)
                same = sum((a & b).values()) / max(1, sum((a | b).values()))
                best = max(best, (same, -s))
            if best[0] >= 0.8:
                out[i, k] = (-best[1], best[0])
    return out


def test_leaks(spark):
    rng = random.Random(9)
    items = {k: " ".join(rng.choice(WORDS) for _ in range(rng.randint(6, 70))) for k in range(12)} | {20: None, 21: "", 22: "just three words", 23: "w1 w1 w1 w1 w1 w1 w1 w1 w1"}
    docs = dict(enumerate(texts(3, 20)))
    for k in range(12):
        w = items[k].split()
        if len(w) > 40:
            w[rng.randrange(len(w))] = "other"
        if k % 3 == 0 and len(w) > 40:
            w.insert(20, "more")
        docs[1000 + k] = (docs[10] or "") + ". " + " ".join(w).upper() + "! " + (docs[30] or "")
    docs[2000], docs[2001] = "so JUST three-words here", "w1 " * 30
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    i = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in decontaminate.leaks(d.withColumn("size", F.lit(1)), i).collect()}
    want = brute_leaks(docs, items)
    assert got == want
    assert decontaminate.leaks(d, i.limit(0)).count() == 0 and decontaminate.leaks(d.limit(0), i).count() == 0


def test_leaks_with_halves_swapped(spark):
    rng = random.Random(21)
    items, docs = {}, {}
    for k, (n, between) in enumerate([(100, 1), (100, 6), (300, 25), (50, 1), (100, 40)]):
        words = [f"v{rng.randrange(5000)}" for _ in range(n)]
        items[k] = " ".join(words)
        noise = lambda c: [f"z{rng.randrange(5000)}" for _ in range(c)]
        docs[k] = " ".join(noise(400) + words[n // 2 :] + noise(between) + words[: n // 2] + noise(400))
    found = decontaminate.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    want = brute_leaks(docs, items)
    assert set(want) == {(k, k) for k in range(4)}
    assert {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in found.collect()} == want


def test_leaks_that_run_into_a_repeated_word(spark):
    rng = random.Random(22)
    items, docs = {}, {}
    for k, (n, kept) in enumerate([(300, 272), (300, 274), (500, 460), (200, 182)]):
        words = [f"v{rng.randrange(50_000)}" for _ in range(n)]
        items[k] = " ".join(words)
        docs[k] = " ".join(words[:kept] + ["pad"] * 60)
        items[10 + k] = " ".join(words[:kept] + ["fill"] * (n - kept))
    found = decontaminate.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    want = brute_leaks(docs, items)
    assert {(k, k) for k in range(4)} <= set(want)
    assert {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in found.collect()} == want


def test_leaks_under_shared_boilerplate(spark):
    """Items that share most of their words with each other are still told apart, and the shared words alone are no leak."""
    rng = random.Random(23)
    common = [f"b{k}" for k in range(30)]
    items = {k: " ".join(common + [f"i{k}x{j}" for j in range(20)]) for k in range(40)}
    docs = {k: " ".join([f"d{rng.randrange(999)}" for _ in range(20)] + common) for k in range(30)}
    docs |= {100 + k: "before " + items[k] + " after" for k in range(0, 40, 4)} | {200: None, 201: ""}
    d = spark.createDataFrame([*docs.items(), (100, docs[100])], "doc_id long, text string")
    found = decontaminate.leaks(d, spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in found.collect()} == brute_leaks(docs, items) == {(100 + k, k): (1, 1.0) for k in range(0, 40, 4)}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == columns, name
        kept = after.count()
        assert 0 < kept <= docs.count()
        docs = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert out.join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").where("not (text <=> coalesce(was, ''))").count() == 0


@pytest.mark.parametrize("d", [0.1, 0.5, 0.8, 0.95])
def test_tables_of_large_dishes(d):
    """Chances beyond the list are those of the recurrence, from one table to almost one a customer, and draws follow them after one sweep."""
    n, logs = 1_500, lm_score.stirling_logs(d, 1_500)[1_500, 1:]
    for x in (1e-4, 0.5, 20.0, 300.0, 2_000.0, 1e5, 1e8):
        want = logs + np.log(x) * np.arange(1, n + 1)
        want = np.exp(want - want.max())
        least, got = lm_score.large_chances(n, x, d)
        whole = np.zeros(n)
        whole[least - 1 : least - 1 + len(got)] = got / got.sum()
        assert abs(whole - want / want.sum()).max() < 1e-6
    want = logs + np.log(20.0) * np.arange(1, n + 1)
    want = np.exp(want - want.max())
    want /= want.sum()
    mean, spread = want @ np.arange(1, n + 1), np.sqrt(want @ np.arange(1, n + 1) ** 2 - (want @ np.arange(1, n + 1)) ** 2)
    for customers in (n, 1_000):
        drawn = lm_score.tables_drawn(np.full(400, customers), np.full(400, 20.0), d, lm_score.Chance(np.arange(400, dtype=np.uint64), 1))
        assert drawn.min() >= 1 and drawn.max() <= customers and (customers != n or abs(drawn.mean() - mean) < 5 * spread / 20)


def test_small_dishes_are_drawn_whole():
    """One draw has the distribution that many single steps lead to, whatever the dishes' sizes."""
    for c, x, d in ((2, 0.3, 0.7), (9, 2.5, 0.4), (300, 4.0, 0.6)):
        want = lm_score.stirling_logs(d)[c, 1 : c + 1] + np.log(x) * np.arange(1, c + 1)
        want = np.exp(want - want.max())
        drawn = lm_score.tables_drawn(np.full(20_000, c), np.full(20_000, x), d, lm_score.Chance(np.arange(20_000, dtype=np.uint64), 1))
        assert abs(np.bincount(drawn, minlength=c + 1)[1:] / 20_000 - want / want.sum()).max() < 0.015
    assert lm_score.tables_drawn(np.array([0, 1, 2]), np.ones(3), 0.5, lm_score.Chance(np.arange(3, dtype=np.uint64), 1))[:2].tolist() == [0, 1]


def test_every_customer_gets_up():
    """A dish of one table too many for its weight loses it in one sweep, though it has hundreds of customers."""
    customers, sizes, t = np.full(50, 200), np.full(10_000, 1), np.full(50, 200)
    _, t = lm_score.reseated(sizes, t, customers, np.full(50, 0.01), 0.1, lm_score.Chance(np.arange(50, dtype=np.uint64), 1))
    assert t.max() < 150
