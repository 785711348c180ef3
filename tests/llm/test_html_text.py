"""Main texts of pages made from known articles."""

import random
from html import escape

import pytest
from pyspark.sql import functions as F

from colloquy.llm import html_text

SCHEMA = "page_id long, url string, html string"
JUNK = {
    "menu": '<nav><ul><li><a href="/a">All our long and winding section names</a><li><a href="/b">More</a></ul></nav>',
    "header": '<header class="masthead"><h1>The Site of Sites.</h1><p>We write about everything that ever was, every day.</p></header>',
    "notice": '<div class="cookie-notice"><p>We use cookies to do what cookies do. Please agree, or leave the site now.</p></div>',
    "advert": '<div class="ad">Buy the one thing that you have always wanted, now. It is cheap.</div><!-- ad <p>not text</p> -->',
    "sidebar": '<aside><p>Elsewhere on the site we tell of other matters, at some length too.</p></aside><div id="sidebar-2"><p>And here once more, at length.</p></div>',
    "form": '<form action="/s"><p>Tell us your name and address, please, and we shall write.</p><input type=text><select><option>One</select></form>',
    "script": '<script>var t="</p><p>Not a word of this.</p>";</script><style>p{margin:0}</style><noscript><p>Turn it on, please, to see.</p></noscript>',
    "comments": '<section class="comments"><h2>Comments</h2><div><p>I have never read anything better than this in my whole life, truly.</p></div></section>',
    "footer": "<footer><p>&copy; All rights are reserved by those who hold them, since then.</p></footer>",
}
TEMPLATES = {
    "article": "<!DOCTYPE html><html><head><title>T &amp; T</title></head><body>{menu}{header}{notice}{advert}<article>{body}</article>{sidebar}{form}{comments}{footer}{script}</body></html>",
    "div": '<html><body class="no-sidebar comments-open">{script}{header}{menu}<div id="page"><div class="entry-{n} clearfix">{body}{advert}</div>{comments}{sidebar}</div>{form}{notice}{footer}',
    "cells": "<body>{header}<table><tr><td>{menu}<td class=x{n}>{body}</td><td>{sidebar}</td></tr></table>{notice}{comments}{footer}{script}{form}{advert}",
    "inside": '<body>{menu}<main><DIV CLASS="story">{notice}{body}{advert}{form}</DIV>{comments}</main>{sidebar}{footer}{header}{script}</body>',
}


def article(rng):
    words = "river stone <b> & \"quoted\" über naïve snow lamp 5 > 3 window – night".split()
    blocks = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 60))) + "." for _ in range(rng.randint(2, 6))]
    title = f"Of {rng.choice(words)} things"
    html = f"<h1>{escape(title)}</h1>"
    for k, b in enumerate(blocks):
        inner = escape(b).replace(" lamp", "\n <i>lamp</i>").replace(" snow", '<br><a href="/snow">snow</a>').replace("naïve", "na&#239;ve").replace(" river", "&nbsp;\t river")
        html += f"<p>{inner}" if k % 2 else f"<p><b>{inner}</b></p>\n"
    return html, "\n".join([title, *blocks])


def page(template, n, rng, but=()):
    body, text = article(rng)
    return TEMPLATES[template].format(n=n, body=body, **{k: "" if k in but else v for k, v in JUNK.items()}), text


@pytest.mark.parametrize("template", sorted(TEMPLATES))
def test_one_page_by_itself(template):
    rng = random.Random(template)
    for n in range(30):
        html, text = page(template, n, rng)
        assert html_text.main_text(html_text.parsed(html), []) == text


def test_a_hosts_pages_agree(spark):
    """On some pages readers write more than the author, and their remarks stand under names that tell nothing; the host's other pages do."""
    rng = random.Random(5)
    rows, want = [], {}
    remarks = '<div class="zq9">' + "<p>Readers go on and on about what they have seen themselves, and elsewhere.</p>" * 60 + "</div>"
    for n in range(40):
        html, text = page("cells", n, rng)
        if n % 4 == 0:
            html = html.replace("<td class=", f"<td>{remarks}</td><td class=")
        rows.append((n, f"https://One.example.org/p/{n}", html))
        want[n] = text
    for n in range(40, 60):
        html, text = page("div", n, rng)
        rows.append((n, f"http://two.example.org?x={n}", html))
        want[n] = text
    found = {r.page_id: r for r in html_text.extracted(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()}
    assert {k: r.text for k, r in found.items()} == want
    assert all(r.n_chars == len(r.text) for r in found.values())
    # alone, such a page is misread
    assert html_text.main_text(html_text.parsed(rows[0][2]), []) != want[0]


def test_odd_rows(spark):
    long = "<article>" + "<p>Of many words.</p>" * 30_000 + "</article>"
    rows = [
        (1, None, None), (2, "no host", ""), (3, "http://h/", "plain words & no mark-up"), (4, "http://h/", "<p>Unclosed <b>bold<p>next<div"), (5, "http://x/", long), (5, "http://x/", long),
        (None, "http://y/", "<body><div>a &lt;tag&gt; &amp &unknown; &#x41;</div><div>  \n </div></body>"), (7, "http://z/", "<nav>only a menu</nav>"), (8, "http://z/", "</div></p></article>text</section>after<!-- unclosed"),
        (9, "http://h/", "<script>never closed <p>x</p>"), (10, "http://w/", "<table><tr><td>one<td>two</table><ul><li>three<li>four</ul>5 < 6 and <3"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"host": F.lit(1), "text": F.lit("clash"), "paths": F.lit("x"), "path": F.lit("y")})
    got = html_text.extracted(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r.text for r in got.collect()}
    assert got.count() == len(rows)
    assert found == {
        1: "", 2: "", 3: "plain words & no mark-up", 4: "Unclosed bold\nnext", 5: "\n".join(["Of many words."] * 30_000), None: "a <tag> & &unknown; A", 7: "", 8: "text\nafter", 9: "", 10: "one\ntwo\nthree\nfour\n5 < 6 and <3",
    }
    assert html_text.extracted(df.where("page_id > 99")).count() == 0


def test_votes_and_winners(spark):
    rows = [("h", f'<body><div class="post-{n}"><p>{"Words are said here, and more. " * 9}</p></div><div class="s"><p>Little here, it is true.</p></div></body>') for n in range(5)]
    rows += [("h", "<p>" + "Only a body, and no container at all. " * 9), ("", "<p>Nobody asks a page without a host.</p>"), ("k", None)]
    voted = html_text.votes(spark.createDataFrame(rows, "host string, html string").repartition(3))
    assert {r.host for r in voted.collect()} == {"h"}
    assert [tuple(r) for r in html_text.winners(voted).collect()] == [("h", ["body/div.post-#", "body"])]
