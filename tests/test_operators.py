"""Hand-checked cases of the operators."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import candidates, conversation, integrity, metrics, ranking, retrieval, shapley, spans, splits, statistics
from colloquy.session import new_path
from colloquy.sources import readers, writers


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


def lists(spark, **views):
    return spark.createDataFrame([("q", view, k + 1, doc) for view, docs in views.items() for k, doc in enumerate(docs)], "query_id string, view string, rank int, docid string")


def ids(df):
    return [r.docid for r in df.orderBy("rank").collect()]


def test_fusion(spark):
    fused = ranking.rrf(lists(spark, a=["a", "b", "c"], b=["b", "d"])).orderBy("rank").collect()
    assert [(r.docid, r.score) for r in fused] == [("b", round(1 / 12 + 1 / 11, 9)), ("a", round(1 / 11, 9)), ("d", round(1 / 12, 9)), ("c", round(1 / 13, 9))]
    assert ids(ranking.rrf(lists(spark, a=["y"], b=["x"]))) == ["x", "y"]
    repeated = {r.docid: r.score for r in ranking.rrf(lists(spark, a=["a", "a", "b"], b=["c"])).collect()}
    assert repeated["b"] == round(1 / 13, 9)


def test_metrics(spark):
    hits = spark.createDataFrame([("q", 1, "d3"), ("q", 2, "d1"), ("q", 3, "d9")], "query_id string, rank int, docid string")
    gold = spark.createDataFrame([("q", "d1"), ("q", "d7")], "query_id string, docid string")
    queries = spark.createDataFrame([("q",), ("none",)], "query_id string")
    rows = {r.query_id: r for r in metrics.per_query(queries, hits, gold, [3]).collect()}
    dcg = 1 / np.log2(3)
    assert (rows["q"].target_rank, rows["q"].MRR, rows["q"].R_3) == (2, 0.5, 0.5)
    assert rows["q"].nDCG_3 == pytest.approx(dcg / (1 + dcg), abs=1e-9)
    assert (rows["none"].target_rank, rows["none"].MRR, rows["none"].R_3, rows["none"].nDCG_3) == (None, 0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        metrics.per_query(queries, hits, gold, [])


def test_normalisation_and_merges(spark):
    flat = spark.createDataFrame([("q", 1, "a", 2.0), ("q", 2, "b", 2.0)], "query_id string, rank int, docid string, score double")
    assert [r.score_norm for r in ranking.normalised(flat).collect()] == [1.0, 1.0]
    parts = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 1.0), ("q", "a", 3.0), ("q", "c", 1.0)], "query_id string, docid string, score double")
    assert [(r.docid, r.score) for r in ranking.merged_partials(parts).orderBy("rank").collect()] == [("a", 3.0), ("b", 1.0), ("c", 1.0)]
    assert ids(retrieval.top_k(parts.distinct().where("docid <> 'a'"), 2, descending_ids=True)) == ["c", "b"]


def test_topics(spark):
    rows = spark.createDataFrame([("s", 1, k + 1, t) for k, t in enumerate(["A", None, "A", "B", "A"])], "split string, conv_id long, turn_id long, topic string")
    out = conversation.with_topics(rows).orderBy("turn_id").collect()
    assert [r.topic_id for r in out] == [1, None, 1, 2, 1]
    assert [r.topic_switch for r in out] == [False, False, False, True, True]
    assert [r.topic_switch_depth for r in out] == [0, None, 0, 1, 0]
    assert [r.cumulative_switches for r in out] == [0, 0, 0, 1, 2] and {r.topics_in_conversation for r in out} == {2}


def test_masks(spark):
    s = spark.createDataFrame([("s5", 5), ("s3", 3), ("s0", 0)], "sample_id string, depth long")
    of = lambda df, sample: {r.origin: r.mask for r in df.where(F.col("sample_id") == sample).collect()}
    assert sorted(of(candidates.recent(s), "s5").values()) == ["00001", "00011", "00111", "01111", "11111"]
    assert of(candidates.anchors(s), "s3") == {"oldest_1": "100", "oldest_2": "110", "oldest_3": "111", "first_plus_recent_1": "101"}
    assert len(of(candidates.controls(s), "s3")) == 7
    assert of(candidates.references(s), "s0") == {"full_history": "[]", "no_history": "[]"}
    deep = candidates.controls(spark.createDataFrame([("d", 11)], "sample_id string, depth long")).collect()
    assert len({r.mask for r in deep}) == len(deep) and {len(r.mask) for r in deep} == {11}
    assert sum(r.mask.count("1") == 4 for r in deep) == 10 and sum(r.mask.count("1") == 11 for r in deep) == 1


def test_shapley(spark):
    games = spark.createDataFrame([("g", 2, 0, 0.0), ("g", 2, 1, 0.0), ("g", 2, 2, 0.0), ("g", 2, 3, 1.0)], "game string, players int, mask int, v double")
    assert [r.phi for r in shapley.shapley(games).orderBy("player").collect()] == [0.5, 0.5]
    rng = random.Random(1)
    worth = {m: rng.random() for m in range(16)}
    rows = shapley.shapley(spark.createDataFrame([("g", 4, m, v) for m, v in worth.items()], "game string, players int, mask int, v double")).collect()
    assert sum(r.phi for r in rows) == pytest.approx(worth[15] - worth[0], abs=1e-8)


def test_holm(spark):
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "k int, p double").withColumn("family", F.lit(1))
    assert [r.holm for r in statistics.holm(p, "p", ["family"]).orderBy("k").collect()] == pytest.approx([0.03, 0.06, 0.06])


def test_spans(spark):
    tags = lambda values: spark.createDataFrame([("s", k, v) for k, v in enumerate(values)], "s string, index int, tag int")
    got = {(r.start, r.end) for r in spans.tag_spans(tags([0, 1, 2, 1, 0, 2, 2]), ["s"]).collect()}
    assert got == {(1, 3), (3, 4), (5, 7)}
    assert {(r.start, r.end) for r in spans.tag_spans(tags([0, 1, 2, 1, 0, 2, 2]), ["s"], begins=False).collect()} == {(1, 4), (5, 7)}
    scored = spark.createDataFrame([("s", k, t, x) for k, (t, x) in enumerate(zip([0, 1, 0, 0], [1, 0, 1, 0], strict=True))], "s string, index int, tag int, score int")
    assert [r.relabel for r in spans.relabelled(scored, ["s"]).orderBy("index").collect()] == [1, 1, 2, 0]


def test_span_validation(spark):
    fields = spark.createDataFrame([("s", 1, "question", "Who was Ada?"), ("s", 1, "answer", "Ada Lovelace."), ("s", 2, "answer", "the ENGINE")], "sample_id string, turn_id int, field string, content string")
    claims = [(1, 1, "question", "ENTITY", "Ada"), (2, 2, "answer", "ENTITY", "Lovelace"), (3, 1, "answer", "CONCEPT", "engine"), (4, 2, "answer", "ENTITY", "Ada"), (5, 1, "question", "WRONG", "Who"), (6, 1, "question", "ENTITY", "absent")]
    got = spans.validated(spark.createDataFrame([("s", *c) for c in claims], "sample_id string, span_id int, turn_id int, field string, label string, text string"), fields)
    assert {r.span_id: r.status for r in got.collect()} == {1: "exact", 2: "moved", 3: "moved_any_case", 4: "invalid", 5: "invalid", 6: "invalid"}


def test_sequence_sampling():
    rng = np.random.default_rng(3)
    scores, moves = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    paths = [(a, b, c, d) for a in range(3) for b in range(3) for c in range(3) for d in range(3)]
    total = {p: sum(scores[t, p[t]] for t in range(4)) + sum(moves[p[t], p[t + 1]] for t in range(3)) for p in paths}
    assert tuple(spans.viterbi(scores, moves)) == max(total, key=total.get)
    draws = [tuple(spans.sampled_path(scores, moves, rng.random(4))) for _ in range(20000)]
    z = np.logaddexp.reduce(list(total.values()))
    for p in sorted(total, key=total.get)[-5:]:
        assert draws.count(p) / 20000 == pytest.approx(np.exp(total[p] - z), abs=0.02)


def test_text(spark):
    assert one(spark, T.normal_form(F.col("t")), t="  Wo   IST die STRASSE\tß ") == "wo ist die strasse ss"
    assert one(spark, T.clean(F.col("t")), t=" x ") == "x"
    assert one(spark, T.docid_list(F.col("t")), t="['a', 'b'] c,d") == ["a", "b", "c", "d"]
    assert one(spark, T.base_passage(F.col("t")), t="doc/_p12") == "doc"
    assert one(spark, T.first_nonempty(F.array(F.lit(" "), F.col("t"))), t=" x ") == "x"
    assert one(spark, T.sample_id(F.lit(None), F.lit(1), F.lit(2))) == "None:1:2"
    assert one(spark, T.lexical_terms(F.col("t")), t="The engine of the Engine x 42") == ["42", "engine"]


def test_splits(spark):
    sizes = spark.createDataFrame([("a", 3), ("b", 5), ("c", 2)], "conv string, n int")
    reachable = {sum(c) for k in range(4) for c in combinations([3, 5, 2], k)}
    for target in range(12):
        if target in reachable:
            assert sum(r.n for r in splits.exact_subset(sizes, "conv", "n", target, "s").collect()) == target
        else:
            with pytest.raises(ValueError):
                splits.exact_subset(sizes, "conv", "n", target, "s")
    even = spark.createDataFrame([(k, 4 if k % 2 else 6) for k in range(40)], "conv int, n int")
    assert sum(r.n for r in splits.exact_subset(even, "conv", "n", 98, "s").collect()) == 98
    units = spark.range(101).select(F.col("id").alias("u"))
    assert splits.fraction(units, "u", 0.3, "x").where("split = 'first'").count() == 31
    samples = spark.createDataFrame([(f"{c}:{k}", c, k, "all") for c in range(12) for k in range(2, 5)], "sample_id string, conv_id int, depth int, bin string")
    got = splits.depth_balanced(samples, ["all"], 6, "x").collect()
    assert len(got) == 6 and len({r.conv_id for r in got}) == 6


def test_integrity(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError):
        integrity.require_unique(a, ["k"])
    with pytest.raises(ValueError):
        integrity.validated_join(a, a, ["k"])
    with pytest.raises(KeyError):
        integrity.require_columns(a, "z")
    with pytest.raises(ValueError):
        integrity.require_same_ids(a, spark.createDataFrame([(2,)], "k int"), "k")
    with pytest.raises(Exception, match="no rows"):
        metrics.balanced_weights(a, "v", ["x", "z"]).collect()


def test_null_monte_carlo_repeats(spark):
    pool = spark.createDataFrame([("g", 2, [0.1, 0.3, 0.7], 0.2, 0.5)], "group string, needed int, pool array<double>, baseline double, observed double")
    first, again = (statistics.null_monte_carlo(pool).first() for _ in range(2))
    assert first == again and 0 <= first.null_mean <= first.null_max <= 0.5


def test_bootstrap_covers(spark):
    rows = spark.createDataFrame([(c, float(c % 5)) for c in range(40) for _ in range(3)], "cluster int, value double").withColumn("arm", F.lit("a"))
    out = statistics.cluster_bootstrap(statistics.cluster_sums(rows, "cluster", ["value"], ["arm"]), "cluster", ["value"], ["arm"]).first()
    assert out["mean"] == 2.0 and out["low"] < 2.0 < out["high"]


def test_files(spark, tmp_path):
    turns = tmp_path / "turns.json"
    turns.write_text('[{"conv_id": 1, "turn_id": 1, "question": "q", "answers": ["a"], "positive_ctxs": [{"passage_id": "p", "title": "T [SEP] S", "text": "x"}]}, {"conv_id": 1, "turn_id": 2, "question": "r", "answers": [], "positive_ctxs": []}]')
    out = readers.turns_a(spark, {"dev": str(turns)}).orderBy("turn_id").collect()
    assert [(r.split, r.topic, r.positive_ctx_passage_ids) for r in out] == [("dev", "T", ["p"]), ("dev", None, [])]
    other = tmp_path / "other.json"
    other.write_text('[{"Conversation_no": 1, "Turn_no": 1, "Question": "q", "Truth_answer": "", "Answer": "a", "Truth_rewrite": "w", "Context": [], "Passages": ["p"]}, {"Conversation_no": 2, "Turn_no": 1, "Question": "q", "Answer": "b"}]')
    rows = readers.turns_b(spark, {"train": str(other)}).orderBy("conv_id").collect()
    assert [(r.answers, r.rewrite) for r in rows] == [("a", "w"), ("b", None)]
    assert readers.turns_b(spark, {"train": str(other)}, gold_only=True).count() == 1
    tsv = tmp_path / "passages.tsv"
    tsv.write_text('id\ttext\ttitle\n1\t"a ""quoted""\ttab"\tT\n2\tplain\tU\n')
    assert [(r.id, r.text) for r in readers.passages_tsv(spark, str(tsv)).orderBy("id").collect()] == [("1", 'a "quoted"\ttab'), ("2", "plain")]
    lines = tmp_path / "passages.jsonl"
    lines.write_text('{"id": "1", "contents": "c", "text": ""}\n\n{"id": "2"}\n')
    assert [r.text for r in readers.passages_json(spark, str(lines)).orderBy("id").collect()] == ["c", ""]
    run = tmp_path / "run.txt"
    run.write_text("q Q0 b 2 1.0 t\nq Q0 a 1 2.0 t\nq Q0 b 3 0.5 t\n")
    assert [(r["rank"], r.docid) for r in readers.trec_run(spark, str(run)).orderBy("rank").collect()] == [(1, "a"), (2, "b")]
    run.write_text("q Q0 b 0 1.0 t\n")
    with pytest.raises(Exception, match="not a run line"):
        readers.trec_run(spark, str(run)).collect()
    bundle = tmp_path / "bundle.jsonl"
    bundle.write_text('{"family": "f", "system": "s", "sample_id": "1", "budget": 64, "view": "I", "query": "q"}\n{"family": "f", "system": "s", "sample_id": "1", "budget": 64, "view": "D", "query": "q"}\n')
    assert readers.query_bundle(spark, str(bundle), "f", "s", 64, ["I", "R"]).count() == 1


def test_stores(spark):
    hits = spark.createDataFrame([("q", 1, "a", 2.0, "s1"), ("q", 1, "b", 3.0, "s2")], "query_id string, rank int, docid string, score double, shard_session string")
    path = new_path(spark, "partials")
    writers.write_partials(hits, path)
    assert ids(writers.merge_partials(spark, path, 5)) == ["b", "a"]
    with pytest.raises(ValueError):
        writers.merged_stores([hits, hits.withColumn("query_id", F.lit("r"))], 5)
    store = writers.RankingStore(spark, new_path(spark, "store"))
    asked = spark.createDataFrame([("q", "x"), ("r", "y")], "query_id string, query string")
    calls = []

    def retrieve(todo):
        calls.append(todo.count())
        return hits.join(todo.select("query_id"), "query_id", "left_semi")

    store.add(asked, retrieve)
    store.add(asked, retrieve)
    assert calls == [2, 0] and store.hits().count() == 2


def test_offsets_stand_where_they_say(spark):
    h = spark.createDataFrame([("s", 1, 1, "qé", "a"), ("s", 1, 2, "second", ""), ("s", 1, 12, "third", "c")], "split string, conv_id long, turn_id long, question string, answer string")
    last = conversation.with_history(h).where("turn_id = 12").select(conversation.rendered("history").alias("t"), conversation.field_offsets("history").alias("o")).first()
    for o, (q, a) in zip(last.o, [("qé", "a"), ("second", "")], strict=True):
        assert last.t[o.question_start :].startswith(q) and last.t[o.answer_start :].startswith(a + "\n\n")


def test_surface_and_kept_text(spark):
    tokens = F.array(*map(F.lit, "The Analytical, engine and the engine".split()))
    asks = {"analytical engine": ([1, 2], "run"), "the engine": ([4, 5], "run"), "analytical the": ([1, 4], "spread"), "absent": ([], "missing"), "engine engine": ([2, 5], "spread"), "engine analytical": ([], "missing"), "": ([], "missing"), "the": ([], "ambiguous"), "--": ([], "missing")}
    for phrase, (places, how) in asks.items():
        found = one(spark, spans.surface_match(tokens, F.lit(phrase)))
        assert (found.places, found.found) == (places, how), phrase
    assert one(spark, spans.surface_match(tokens, F.lit(None).cast("string"))).found == "missing"
    # words that are only punctuation count on neither side
    dashed = F.split(F.lit("foo x bar foo - bar"), " ")
    assert one(spark, spans.surface_match(dashed, F.lit("foo bar"))).places == [3, 5]
    assert one(spark, spans.surface_match(dashed, F.lit("foo -- BAR!"))).places == [3, 5]


def test_char_spans_end_at_dropped_tokens(spark):
    rows = [("s", k, t, a, b) for k, (t, a, b) in enumerate([(1, 0, 4), (0, 5, 7), (2, 8, 12), (2, 13, 15), (1, 16, 18), (2, 30, 33), (None, 34, 35), (2, 36, 40)])]
    df = spark.createDataFrame(rows, "sample_id string, index int, tag int, start int, end int").repartition(3)
    spans_of = lambda **how: sorted((r.start, r.end) for r in spans.merged_char_spans(df, ["sample_id"], "index", "tag", **how).collect())
    assert spans_of() == [(0, 4), (8, 18), (30, 33), (36, 40)]
    assert spans_of(begins=1) == [(0, 4), (8, 15), (16, 18), (30, 33), (36, 40)]
    assert spans_of(gap=12) == [(0, 4), (8, 33), (36, 40)]


def first_reached(sizes, target):
    """A plain table of sums: for each, with which unit it was first reached."""
    reached = {0: None}
    for unit, size in sizes:
        for at in sorted(reached, reverse=True):
            if at + size <= target and at + size not in reached:
                reached[at + size] = (unit, at)
        if target in reached:
            break
    else:
        return None
    kept = set()
    while target:
        unit, target = reached[target]
        kept.add(unit)
    return kept


def test_exact_subset_is_the_first_reached(spark):
    digest = lambda u: hashlib.sha1(f"s:{u}".encode()).hexdigest()
    for seed in range(10):
        rng = random.Random(seed)
        sizes = {u: rng.choice([2, 3, 5, 7, 9, 14] if seed % 2 else [4, 6, 10]) for u in range(rng.randint(3, 60))}
        df = spark.createDataFrame(list(sizes.items()), "conv int, n int").repartition(3)
        ordered = sorted(sizes.items(), key=lambda x: (digest(x[0]), x[0]))
        target = rng.randint(1, sum(sizes.values()))
        want = first_reached(ordered, target)
        if want is None:
            with pytest.raises(ValueError):
                splits.exact_subset(df, "conv", "n", target, "s")
        else:
            assert {r.conv for r in splits.exact_subset(df, "conv", "n", target, "s").collect()} == want, (seed, target)
    at = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 13), (13, 14), (15, 27), (-3, 3))])
    assert one(spark, spans.kept_text(F.lit("Ada  Lovelace, ada lovelace!"), at)) == "Ada Ada Lovelace"
    ends = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 3), (4, 6))])
    assert one(spark, spans.kept_text(F.lit("las ñ."), ends)) == "las ñ." and one(spark, spans.kept_text(F.lit("las ñ."), ends, r"\w")) == "las"
    assert one(spark, spans.kept_text(F.lit(None).cast("string"), at)) == "" and one(spark, spans.kept_text(F.lit(""), at)) == ""


def test_encoded_pairs(spark):
    words = lambda text: F.split(F.lit(text), " ")
    e = one(spark, spans.pair_encoded(words("a b"), words("c d e"), 7))
    assert (e.tokens, e.segments, e.kept) == (["<s>", "a", "b", "</s>", "c", "d", "</s>"], [0, 0, 0, 0, 1, 1, 1], 2)
    assert one(spark, spans.pair_encoded(words("a b"), words("c d e"), 5)).kept == 0
    with pytest.raises(Exception, match="too long"):
        one(spark, spans.pair_encoded(words("a b"), words("c"), 4))


def test_ranged_quantiles_and_padding(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in rng.integers(0, 40, 300)] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    points = {"least": 0.0, "median": 0.5, "p93": 0.93, "most": 1.0}
    want = df.groupBy("g").agg(*[F.round(F.percentile("v", F.lit(p)), 9).alias(n) for n, p in points.items()])
    key = lambda r: str(r[0])
    assert sorted(statistics.quantiles(df, "v", ["g"], points).collect(), key=key) == sorted(want.collect(), key=key)
    whole = statistics.quantiles(df, "v", [], {"median": 0.5}).first()
    assert whole.median == np.median([v for _, v in rows if v is not None])
    lengths = [int(n) for n in rng.integers(1, 90, 250)]
    got = statistics.padding_report(spark.createDataFrame(list(enumerate(lengths)), "id int, length int").repartition(5), 16, [F.col("id")]).first()
    batches = [lengths[k : k + 16] for k in range(0, 250, 16)]
    assert (got.batches, got.tokens, got.padded) == (16, sum(lengths), sum(max(b) * len(b) for b in batches))


def plainly_balanced(rows, bins, each):
    """The choice over plain rows (sample, conv, depth, bin), which are gone through anew for every place."""
    digest = lambda r: hashlib.sha1(f"x:{r[3]}:{r[2]}:{r[1]}:{r[0]}".encode()).hexdigest()
    used, out = set(), []
    for name in bins:
        mine = [r for r in rows if r[3] == name]
        deepest = {c: max(r[2] for r in mine if r[1] == c) for c in {r[1] for r in mine}}
        taken = dict.fromkeys({r[2] for r in mine}, 0)
        for place in range(each):
            free = [r for r in mine if r[1] not in used]
            convs = {d: {r[1] for r in free if r[2] == d} for d in taken}
            depth = min((d for d in convs if convs[d]), key=lambda d: (taken[d], len(convs[d]), -d))
            row = min((r for r in free if r[2] == depth), key=lambda r: (deepest[r[1]], digest(r), str(r[1]), r[0]))
            taken[depth] += 1
            used.add(row[1])
            out.append((row[0], str(row[1]), depth, name, place + 1))
    return out


def test_depth_balanced_chooses_as_over_all_rows(spark):
    rng = random.Random(3)
    bins = ["deep", "shallow"]
    schema = "sample_id string, conv_id int, depth int, bin string"
    rows = [(f"{c}:{k}", c, k, "deep" if k > 4 else "shallow") for c in range(400) for k in rng.sample(range(9), 4)]
    rows += [(f"again {c}", c, k, b) for _, c, k, b in rows[:50]]
    got = [tuple(r) for r in splits.depth_balanced(spark.createDataFrame(rows, schema).repartition(4), bins, 5, "x").collect()]
    assert got == plainly_balanced(rows, bins, 5)
    few = [(f"{c}:{k}", c, k, "deep") for c in range(8) for k in (5, 6, 7)]
    got = splits.depth_balanced(spark.createDataFrame(few, schema), ["deep"], 6, "x").collect()
    assert sorted(r.depth for r in got) == [5, 5, 6, 6, 7, 7] and [tuple(r) for r in got] == plainly_balanced(few, ["deep"], 6)
    with pytest.raises(ValueError, match="fewer than 9"):
        splits.depth_balanced(spark.createDataFrame(few, schema), ["deep"], 9, "x")
    assert splits.depth_balanced(spark.createDataFrame(few, schema), ["deep"], 9, "x", strict=False).count() == 8


def test_paired_interval(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(1.0, 2.0, 300)
    df = spark.createDataFrame([("x", c, float(v)) for c, v in enumerate(values)], "g string, c int, delta double")
    got = statistics.paired_interval(df, "c", ["g"]).first()
    half = 1.96 * values.std(ddof=1) / 300**0.5
    assert got.n == 300 and abs(got.mean - values.mean()) < 1e-9
    assert abs(got.low - values.mean() + half) < 0.03 and abs(got.high - values.mean() - half) < 0.03


def test_metadata_conflicts(spark):
    s = spark.createDataFrame([("a", 1)], "sample_id string, conv int")
    with pytest.raises(ValueError):
        integrity.attached(s, spark.createDataFrame([("a", 2)], "sample_id string, conv int"), "sample_id", ["conv"])
    with pytest.raises(ValueError):
        integrity.attached(s, spark.createDataFrame([("b", 1)], "sample_id string, conv int"), "sample_id", ["conv"])


def test_allocation():
    from colloquy.operators import models

    got = models.allocated({"x": ["p"], "y": ["p", "q"], "z": ["q", "r"]}, {"p": [1], "q": [2], "r": [3]})
    assert got["x"] == 1 and sorted(got.values()) == [1, 2, 3]
    with pytest.raises(ValueError):
        models.allocated({"x": ["p"], "y": ["p"]}, {"p": [1]})


def test_injected_models(spark):
    from colloquy.operators import models

    df = spark.createDataFrame([("a a b c",), (None,)], "input string")
    assert {r.rewrite for r in models.rewritten(df).collect()} == {"a b c", ""}
    loud = models.rewritten(df, lambda: lambda rows: {"rewrite": rows["input"].str.upper()})
    assert {r.rewrite for r in loud.collect()} == {"A A B C", None}
