"""Operators that judge each text by itself: token counts, byte BPE, licenses, URLs, language, quality."""

import random
import re

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F

from colloquy.llm import bpe, language_id, license_scan, quality, token_counts, url_filter

NASTY = [None, "", " ", "\n\t", "a", "ab  cd   ", " ▁x▁", "İstanbul ß ǅ 日本語　x", "<s> <|endoftext|> </s>", "😀😀\u200d x", "under the MIT license", "x" * 5000, "word " * 30000, "a\x00b", "Released under the MIT License.\r\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "z", 1) for k, t in enumerate(NASTY)] + [(3, NASTY[3], "z", 1), (None, "no id", "z", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score int")


def test_token_counts_at_every_prefix():
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = token_counts.PrefixCounter(token_counts.load_pieces(path))
    rng = random.Random(5)
    made = ["".join(rng.choice("ab .,\nTheéß▁12日'") for _ in range(rng.randint(1, 40))) for _ in range(150)]
    for text in [t for t in NASTY if t and len(t) < 200] + made:
        counts = np.cumsum(counter(text), dtype=int).tolist()
        assert counts == [len(model.encode(text[:n])) for n in range(1, len(text) + 1)], text


def test_unspaced_texts_fill_no_memory():
    """Texts without spaces make single long units, which are worked out and not kept."""
    import sys

    rng = random.Random(8)
    counter = token_counts.PrefixCounter(token_counts.load_pieces(public.path("piece_bpe_32k.model")))
    encoder = bpe.Encoder(bpe.PerfectHash(bpe.load_ranks(public.path("byte_bpe_50k.tiktoken"))), public.PATTERN)
    for _ in range(40):
        text = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(3000))
        assert len(counter(text)) == 3000 and encoder(text)
    for kept in (counter, encoder):
        assert sum(sys.getsizeof(k) + sys.getsizeof(v) for part in (kept, kept.old) for k, v in part.items()) < 1 << 20
        kept.most = 4_000
        for n in range(2_000):
            kept(f"word{n} x{n}") if kept is encoder else kept(f"word{n} x{n}")
        assert kept.held < 8_000


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    model = quality.fit(np.zeros((0, quality.N_FEATURES), np.float32), np.zeros((0, quality.N_FEATURES), np.float32))
    path = public.path("byte_bpe_50k.tiktoken")
    assert token_counts.prefix_counts(none, public.path("piece_bpe_32k.model"), budgets=(3,)).count() == 0
    assert bpe.decode(bpe.encode(none, path, public.PATTERN), path).count() == 0
    assert license_scan.scan(none).count() == 0 and quality.score(none, model).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(url_filter.with_host_and_path(pages), url_filter.RULES, url_filter.DEFAULTS).count() == 0


def test_token_count_columns(spark, docs):
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = token_counts.prefix_counts(docs, path, budgets=(7,), steps="steps")
    out = out.withColumns({"at_3": token_counts.tokens_at("steps", F.lit(3)), "fit": token_counts.longest_fit("steps", F.lit(7))})
    rows = out.collect()
    assert len(rows) == len(NASTY) + 2
    for r in rows:
        text = r["text"] or ""
        assert r["n_tokens"] == len(model.encode(text))
        if len(text) < 200:
            assert r["fit_7"] == max([n for n in range(len(text) + 1) if len(model.encode(text[:n])) <= 7])
            assert r["at_3"] == len(model.encode(text[:3])) and r["fit"] == r["fit_7"]


def test_byte_bpe_is_the_library_s(spark, docs):
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode(bpe.encode(docs, path, public.PATTERN, decoded="at_once"), path)
    assert out.count() == len(NASTY) + 2
    for r in bpe.encode(docs, path, public.PATTERN).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(r["ids"]) // 4
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") and r["at_once"] == r["decoded"] for r in out.collect())


def test_perfect_hash():
    keys = {f"key {k}".encode(): k for k in range(3000)}
    hashed = bpe.PerfectHash(keys)
    assert sorted(hashed.values) == list(range(3000))
    assert all(hashed.get(k) == v for k, v in keys.items()) and hashed.get(b"other") == -1


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for label, phrase in license_scan.BASE:
        p = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base(spark, docs):
    rng = random.Random(2)
    made = [" ".join(rng.choice("under the mit License apache version 2 cc by nc É x-y".split()) for _ in range(60)) for _ in range(80)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(made)], "doc_id long, text string"))
    for r in license_scan.scan(df.withColumn("labels", F.lit(1))).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(r.text)
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def test_license_templates():
    t = license_scan.Template("x", "copyright {{2}} all [[of the]] rights reserved")
    accepted = ["copyright all rights reserved", "copyright 2020 all rights reserved", "copyright 2020 me all of the rights reserved"]
    for text in accepted + ["copyright a b c all rights reserved", "copyright all of rights reserved", "copyright all rights"]:
        words = license_scan.words_of("so: " + text + "!")
        assert bool(t.places(words, b" " + b" ".join(words) + b" ")) == (text in accepted), text
    with pytest.raises(ValueError):
        license_scan.Template("x", "[[open]] start")


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_license_texts(spark):
    """Optional and replaceable wording may differ; mandatory wording may not."""
    texts = {
        "whole": "Copyright 2020 Someone\n\n" + MIT, "replaced": MIT.replace("SHALL THE AUTHORS OR COPYRIGHT HOLDERS", "SHALL ACME INC"), "optional gone": MIT.replace("sublicense, ", "").replace('(the "Software"), ', ""),
        "optional added": MIT.replace("this permission notice shall", "this permission notice (including the next paragraph) shall"), "mandatory changed": MIT.replace("free of charge", "for a fee"), "mandatory gone": MIT.replace("merge, ", ""), "cut": MIT[:-30], "too long a replacement": MIT.replace("THE AUTHORS OR", "THE VERY MANY AND NOT SO FAMOUS AUTHORS OR"),
    }
    found = {r.name: r.labels.split(",") for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "name string, text string")).collect()}
    assert {name for name, labels in found.items() if "mit-text" in labels} == {"whole", "replaced", "optional gone", "optional added"}
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    (row,) = license_scan.scan(spark.createDataFrame([(apache,)], "text string")).collect()
    assert row.labels == "apache-2,apache-2.0-notice,apache-2.0-text" and row.base_labels == "apache-2"


def brute_rule(host, path):
    best = None
    for r in url_filter.RULES:
        h, p = r.name.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.name) > len(best.name)):
            best = r
    return best


def brute_blocked(host, path):
    """The block list told without globs."""
    labels = host.split(".")
    ends = (".exe", ".zip", ".apk", ".iso", ".jpg", ".png", ".gif", ".css", ".js")
    if any(w in host for w in ("spam", "pills", "casino", "viagra", "lottery")) or any(x.startswith(("poker", "bet365", "adserver")) for x in labels):
        return True
    if any(x in ("ads", "track", "tracker", "click", "doubleclick") or len(x.encode()) == 3 and x.startswith("ad") for x in labels[:-1]):
        return True
    if ".".join(labels[-2:]) in ("bit.ly", "t.co", "goo.gl") or path.endswith(ends) or re.search(r"\.(mp.|jp.g|woff.)\Z", path, re.S):
        return True
    if path.startswith(("/login", "/signup", "/checkout", "/cgi-bin/", "/calendar/", "/cart/", "/wp-admin/")) or path.endswith("/login") or any(w in path[1:] for w in ("/logout", "/cart/", "/wp-admin/", "/calendar/")):
        return True
    return bool(re.match(r"/.*/page/....|/.*/tag/.*/feed|/search/.*/search/", path, re.S))


def test_url_rules(spark):
    rng = random.Random(3)
    urls = [None, "", "no scheme", "http://", "http://NET", "https://net/", "x://a.example.NET/en/1?q#f", "http://example.net#/en/", "http://xexample.com/de/", "http://a.b.org/fr/" + "x" * 40000, "http://org//fr/", "http://y/net/", "a://b://c.net/", "http://spam.example.com/x", "http://net/é?u"]
    urls += ["http://" + "".join(rng.choice(["a.", "example.", "net", "com", "org", "/en/", "/de/", "/fr/", "/", "?", "#"]) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    urls += ["http://" + "".join(rng.choice(["spam", "pills", "a.", "ads.", "adx.", "bit.ly", "poker", "de", "/", "/login", "/logout", "/cart/", "page/", "1234", "tag/", "feed", ".exe", ".mp4", "search/", "calendar/", "?"]) for _ in range(rng.randint(1, 8))) for _ in range(600)]
    df = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    rows = url_filter.judge(url_filter.with_host_and_path(df), url_filter.RULES, url_filter.DEFAULTS).collect()
    assert len(rows) == len(urls)
    for r in rows:
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        assert (r.host, r.path) == (host, path)
        rule = brute_rule(host, path)
        assert r.rule == (rule.name if rule else None), r
        blocked = brute_blocked(host, path)
        assert r.verdict == (rule.action if rule else "block" if blocked else "allow"), r


@pytest.mark.parametrize(("url", "verdict"), [("http://spam-farm.example.de/en/728", "block"), ("https://www.cheap-pills.example.com/x?y", "block"), ("http://my.casino.de", "block"), ("http://example.de/spam/pills", "allow"), ("http://ads.example.de/x", "block"), ("http://roads.example.de/x", "allow"), ("http://bet365.example.de/", "block"), ("http://better.example.de/", "allow"), ("http://a.de/shop/cart/7", "block"), ("http://a.de/shop/cartoon/7", "allow"), ("http://a.de/x/y.exe", "block"), ("http://a.de/x.exe/manual", "allow"), ("http://bit.ly/3", "block"), ("http://orbit.lyon.fr/3", "allow"), ("http://a.de/b/page/1234", "block"), ("http://a.de/b/page/12", "allow"), ("http://casino.org/fr/x", "allow")])
def test_default_globs(spark, url, verdict):
    df = spark.createDataFrame([(1, url)], "page_id long, url string")
    assert url_filter.judge(url_filter.with_host_and_path(df), url_filter.RULES, url_filter.DEFAULTS).first().verdict == verdict


def test_automaton_against_regular_expressions():
    rng = random.Random(4)
    globs = ["".join(rng.choice("ab/*?") for _ in range(rng.randint(1, 9))) for _ in range(90)]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    found = url_filter.Automaton(globs)([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert found[i, j] == bool(re.fullmatch(re.escape(g).replace(r"\*", ".*").replace(r"\?", "."), t)), (t, g)


@pytest.fixture(scope="module")
def larger(sf_dir):
    """The next larger tables, for learning from enough rows."""
    return sf_dir.replace("sf0.001", "sf0.01")


def test_languages(spark, larger):
    sf_dir = larger
    out = language_id.op6_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.9


def test_language_cases(spark, sf_dir, docs):
    model = language_id.trained(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = {r.doc_id: r for r in language_id.identify(docs.select("doc_id", "text", "score"), model).collect()}
    for k in (0, 1, 2, 3):
        assert (rows[k].lang_pred, rows[k].score, rows[k].rejected) == ("und", 0.0, True)
    assert rows[12].lang_pred in model["names"] and 0 <= rows[12].score <= 1
    nothing = language_id.train(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    assert {r.lang_pred for r in language_id.identify(docs.select("doc_id", "text"), nothing).collect()} == {"und"}
    assert language_id.identify(docs.select("doc_id", "text").limit(0), model).count() == 0


def test_quality(spark, larger):
    sf_dir = larger
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality.op7_quality(spark, sf_dir)
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = out.join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_quality_cases(spark, docs):
    empty = quality.train(docs.limit(0).select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 0.3, (300, quality.N_FEATURES)), rng.normal(-1, 0.3, (200, quality.N_FEATURES))
    model = quality.fit(good[:150].astype(np.float32), np.concatenate([good[150:], bad]).astype(np.float32))
    assert abs(model["prior"] - 150 / 350) < 0.12
    assert (quality.score_features(good, model) > 0.5).mean() > 0.95 and (quality.score_features(bad, model) < 0.5).mean() > 0.95
