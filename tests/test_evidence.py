"""Evidence of gold passages against plain code and the tokenizer's own pair encoding."""

import math
import random
import re

import pytest

from colloquy.operators import evidence, index
from colloquy.session import new_path

PASSAGES = [(1, "red fox red-brown fox"), (2, "blue whale"), (3, ""), (4, "fox hunts whale, hunts fox"), (5, None)]
HISTORY = "sample_id string, question string, history array<struct<turn_id:bigint,question:string,answer:string>>"


@pytest.fixture(scope="module")
def found(spark):
    return index.write(spark.createDataFrame(PASSAGES, "docid long, text string"), new_path(spark, "index"))


def weight(docid, token):
    terms = {d: re.findall("[a-z0-9]+", (t or "").lower()) for d, t in PASSAGES}
    average = sum(map(len, terms.values())) / len(terms)
    total = 0.0
    for term in re.findall("[a-z0-9]+", token.lower()):
        tf, df = terms[docid].count(term), sum(term in t for t in terms.values())
        if tf:
            total += math.log(1 + (len(terms) - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (0.6 + 0.4 * len(terms[docid]) / average))
    return total


ROWS = [
    ("a", "and now?", [(1, "A  Fox?", "red-fox/fox hunts whale"), (2, None, " fox \n red ")]),
    ("b", "why", [(1, "blue", "nothing here")]),
    ("c", "none", []),
    ("d", None, [(1, "red", None)]),
]


def test_tokens_with_places_and_sums_over_terms(spark, found):
    samples = spark.createDataFrame(ROWS, HISTORY)
    gold = spark.createDataFrame([("a", 4), ("a", 4), ("b", 3), ("c", 1), ("x", 2)], "sample_id string, docid long")
    got = {(r.sample_id, r.turn_id, r.field, r.start): r for r in evidence.gold_token_scores(samples, gold, found).collect()}
    want = {}
    for name, docid in (("a", 4), ("b", 3)):
        for turn, *texts in dict((r[0], r[2]) for r in ROWS)[name]:
            for field, said in zip(("question", "answer"), texts, strict=True):
                for m in re.finditer(r"\S+", said or ""):
                    want[name, turn, field, m.start()] = (m.end(), m[0], weight(docid, m[0]), docid)
    assert set(got) == set(want)
    for k, (end, text, raw, docid) in want.items():
        most = max(w[2] for o, w in want.items() if o[0] == k[0])
        assert (got[k].end, got[k].text, got[k].docid) == (end, text, docid)
        assert got[k].score_raw == pytest.approx(raw, abs=1e-8) and got[k].score_norm == pytest.approx(raw / most if most else 0, abs=1e-8)


def test_exactly_one_gold_passage_that_the_index_holds(spark, found):
    samples = spark.createDataFrame(ROWS, HISTORY)
    for gold, told in (([("a", 1), ("a", 4)], "exactly one"), ([("a", None)], "exactly one"), ([("a", 99)], "lacks")):
        with pytest.raises(Exception, match=told):
            evidence.gold_token_scores(samples, spark.createDataFrame(gold, "sample_id string, docid long"), found).collect()
    assert evidence.gold_token_scores(samples.limit(0), spark.createDataFrame([], "sample_id string, docid long"), found).collect() == []


def tokenizer(path, most):
    from tokenizers import Tokenizer
    from tokenizers.processors import TemplateProcessing

    t = Tokenizer.from_file(path)
    marks = [(m, t.token_to_id(m)) for m in ("<|startoftext|>", "<|endoftext|>")]
    t.post_processor = TemplateProcessing(single="<|startoftext|> $A", pair="<|startoftext|> $A:0 <|endoftext|>:0 $B:1 <|endoftext|>:1", special_tokens=marks)
    t.enable_truncation(most, strategy="only_second")
    return t


def test_pieces_equal_the_librarys_pairs_and_carry_scores(spark, found):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rng = random.Random(4)
    words = ["Unbelievable", "fox", "naïve", "漢字", "\U0001f600", "hunts,", "red-brown", "x" * 30]
    rows = ROWS + [(f"r{n}", " ".join(rng.choices(words, k=3)), [(k, " ".join(rng.choices(words, k=4)), "  ".join(rng.choices(words, k=rng.randint(0, 12)))) for k in range(1, rng.randint(2, 6))]) for n in range(12)]
    samples = spark.createDataFrame(rows, HISTORY)
    for recent in (False, True):
        encoded = evidence.encoded_history(samples, path, 48, "<|startoftext|>", "<|endoftext|>", recent)
        library = tokenizer(path, 48)
        got = {r.sample_id: r for r in encoded.collect()}
        assert len(got) == len(rows) and any(len(r.piece_ids) == 48 for r in got.values())
        for r in got.values():
            e = library.encode(r.query, r.said)
            assert list(r.piece_ids) == e.ids and list(r.segments) == e.sequence_ids
            assert list(zip(r.starts, r.ends, strict=True)) == e.offsets and r.kept == e.sequence_ids.count(1)

        gold = spark.createDataFrame([(r[0], 4) for r in rows], "sample_id string, docid long")
        scores = evidence.gold_token_scores(samples, gold, found)
        told = {}
        for s in scores.collect():
            told.setdefault(s.sample_id, []).append(s)
        for p in evidence.piece_scores(encoded, scores, samples, recent).collect():
            said, want = got[p.sample_id].said, []
            history = dict((r[0], r[2]) for r in rows)[p.sample_id]
            begins, at = {}, 0
            for turn, q, a in history[::-1] if recent else history:
                begins[turn, "question"] = at + len(f"T{turn} Q: ")
                begins[turn, "answer"] = begins[turn, "question"] + len(q or "") + len("\nA: ")
                at = begins[turn, "answer"] + len(a or "") + 2
            assert at == len(said)
            for part, low, high in zip(p.segments, got[p.sample_id].starts, got[p.sample_id].ends, strict=True):
                over = [t.score_norm for t in told.get(p.sample_id, []) if t.start + begins[t.turn_id, t.field] < high and low < t.end + begins[t.turn_id, t.field]]
                want.append(max(over, default=0.0) if part == 1 else 0.0)
            assert list(p.scores) == want


def test_a_first_text_without_room_raises(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    pairs = spark.createDataFrame([("one two three four", "x")], "query string, said string")
    assert evidence.encoded_pieces(pairs, path, 7, "<|startoftext|>", "<|endoftext|>").first().kept == 0
    with pytest.raises(Exception, match="too long"):
        evidence.encoded_pieces(pairs, path, 6, "<|startoftext|>", "<|endoftext|>").collect()
    assert [tuple(r)[2:] for r in evidence.encoded_pieces(pairs, path, 6, "<|startoftext|>", "<|endoftext|>", strict=False).collect()] == [(None,) * 5]
    assert evidence.encoded_pieces(pairs.limit(0), path, 6, "<|startoftext|>", "<|endoftext|>").collect() == []
