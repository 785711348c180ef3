"""Main text of web pages by paths that the pages of a host agree on.

Each page's containers are scored: the share of the page's prose that a container holds, times how
little else it holds. Pages vote with these scores for the generalised paths of tags and classes
of their containers, and Spark sums the votes of each host. Then every page is read again, and
its text is what stands under its host's winning path; pages that have no such container go to
the next paths, and at last to their own best one. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are left out wherever they stand.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, read, schema_with, small, table
from .url_filter import with_host_and_path

#: Paths that a host's pages are tried with, best first; further ones lose to a page's own container.
PATHS = 3
#: Text of so many characters, or one that ends like a sentence, is prose; headings and links aren't.
PROSE = 40
#: Permille of a page's prose that a container must hold to be voted for, and by how much marked containers count more.
LEAST, MARKED = 500, 2

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is no text of the page, to be passed over unread, and those that are no part of an article.
UNREAD = "script|style|noscript|template|title|textarea|select|svg|math|iframe|object|audio|video|canvas|noframes|xmp"
OUTSIDE = frozenset("nav footer aside form dialog fieldset menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of classes and ids that mark what is no part of an article. They are held against each part of a name, and against the whole.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner banners billboard breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright
    disqus disclaimer feedback footer form forms gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications pager
    pagination popup popups promo promos promoted promotion related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe
    subscription toolbar topbar warning widget widgets""".split()
)
#: Words that mark an article's container.
ARTICLE = frozenset("article story post entry content body text main blog prose".split())
#: These are never left out for their class, which may speak of the whole page.
WHOLE = frozenset("html body main article".split())

TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({UNREAD})\b[^>]*>.*?(?:</\1\b[^>]*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[/!?a-zA-Z][^>]*(?:>|\Z)", re.IGNORECASE | re.DOTALL
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")
#: What an opening tag closes: the open element of these tags, if it is nearer than one of those.
CLOSES = {
    **dict.fromkeys(["li"], (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"]))),
    **dict.fromkeys(["dt", "dd"], (frozenset(["dt", "dd"]), frozenset(["dl"]))),
    **dict.fromkeys(["td", "th"], (frozenset(["td", "th"]), frozenset(["tr", "table"]))),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    **dict.fromkeys(["tbody", "thead", "tfoot"], (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"]))),
}


@dataclass
class Element:
    tag: str
    parent: int
    path: str
    out: bool  # no part of an article, or inside such
    marked: bool = False
    prose: int = 0
    all: int = 0
    text: bool = False


@dataclass
class Page:
    """Elements in page order and blocks (element, raw text): text between two borders of block elements."""

    elements: list[Element] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def _words(names: str) -> set[str]:
    return {w.lower() for n in names.split() for w in [n, *PARTS.findall(n)]}


def parsed(html: str) -> Page:
    """The page's block elements and texts. Elements may be unclosed, closed twice or nested wrongly; text outside the body counts too."""
    page = Page([Element("body", -1, "body", False)])
    stack, said, linked, link = [0], [], 0, False

    def flush() -> None:
        nonlocal linked, link
        if said:
            raw = "".join(said)
            size = len(" ".join(raw.split()))
            if size:
                at = stack[-1]
                e = page.elements[at]
                page.blocks.append((at, raw))
                prose = 0 if e.tag in HEADINGS or not (size >= PROSE or raw.rstrip()[-1] in ".!?…。") else max(0, size - 2 * linked)
                other = 0 if e.tag in HEADINGS else size
                here = at
                while here >= 0:
                    up = page.elements[here]
                    up.all += other
                    if not e.out:
                        up.prose += prose
                        up.text = True
                    here = up.parent
            said.clear()
        linked, link = 0, False

    def close(upto: int) -> None:
        flush()
        del stack[upto:]

    at = 0
    for m in TAG.finditer(html):
        if m.start() > at:
            text = html[at : m.start()]
            said.append(text)
            linked += len(text) if link else 0
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag not in BLOCKS:
            if tag == "a":
                link = not m[2] and "href" in m[4].lower()
            elif tag in ("br", "wbr", "img", "input"):
                said.append(" " if tag == "br" else "")
            continue
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if page.elements[stack[k]].tag == tag:
                    close(k)
                    break
            else:
                flush()
            continue
        flush()
        if tag in ("html", "body"):
            continue
        for k in range(len(stack) - 1, 0, -1):
            name = page.elements[stack[k]].tag
            if name == "p" or tag in HEADINGS and name in HEADINGS and k == len(stack) - 1:  # neither holds blocks
                close(k)
            elif tag in CLOSES and name in CLOSES[tag][0]:
                close(k)
                break
            elif tag not in CLOSES or name in CLOSES[tag][1]:
                break
        if tag == "hr":
            continue
        parent = page.elements[stack[-1]]
        own = _attributes(m[4]) if m[4].strip() else {}
        words = _words(own.get("class", "") + " " + own.get("id", ""))
        inside = any(page.elements[k].tag in ("article", "main") for k in stack)
        out = (
            parent.out
            or tag in OUTSIDE
            or tag == "header" and not inside
            or tag not in WHOLE and (bool(words & MARKS) or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower())
            or own.get("role", "").lower() in ROLES
        )
        classes = ".".join(sorted({DIGITS.sub("#", c) for c in own.get("class", "").split()}))
        marked = tag in ("article", "main") or own.get("role") in ("main", "article") or own.get("itemprop") == "articleBody" or bool(words & ARTICLE)
        page.elements.append(Element(tag, stack[-1], f"{parent.path}/{tag}{'.' if classes else ''}{classes}", out, marked))
        stack.append(len(page.elements) - 1)
    if at < len(html):
        said.append(html[at:])
    flush()
    return page


def scores(page: Page) -> dict[int, int]:
    """Elements that hold LEAST permille of the page's prose or more, and their scores in permille."""
    whole = page.elements[0].prose
    found = {}
    for k, e in enumerate(page.elements):
        if whole and not e.out and e.tag != "p" and 1000 * e.prose >= LEAST * whole:
            found[k] = round(1000 * (e.prose / whole) * (e.prose / e.all) ** 2 * (MARKED if e.marked else 1))
    return found


def best(own: dict[int, int]) -> int:
    """The element of the highest score, the first among equals."""
    return max(own, key=lambda k: (own[k], -k))


def _under(page: Page, chosen: set[int]) -> str:
    """The text of the blocks under these elements."""
    inside = [False] * len(page.elements)
    for k, e in enumerate(page.elements):  # parents come before their children
        inside[k] = not e.out and (k in chosen or e.parent >= 0 and inside[e.parent])
    return "\n".join(t for t in (" ".join(unescape(raw).split()) for k, raw in page.blocks if inside[k]) if t)


def main_text(page: Page, paths: list[str]) -> str:
    """The text under the first of these paths that the page has prose or, failing that, text at; else that of its own best container."""
    for wants in ("prose", "text"):
        for path in paths:
            chosen = {k for k, e in enumerate(page.elements) if e.path == path and not e.out and getattr(e, wants)}
            if chosen and (found := _under(page, chosen)):
                return found
    own = scores(page)
    if own:
        return _under(page, {best(own)})
    articles = {k for k, e in enumerate(page.elements) if e.tag in ("article", "main") and e.text and not e.out}
    return _under(page, articles or {0})


def votes(pages: DataFrame) -> DataFrame:
    """host, path and score, summed, of the containers that the pages (host, html) of each host vote for. Pages without a host don't vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parsed(html)
                if own := scores(page):
                    k = best(own)
                    found[host, page.elements[k].path] += own[k]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found]), pa.array([p for _, p in found]), pa.array(list(found.values()), pa.int64())], names=["host", "path", "score"])

    asked = pages.where("host <> '' and html is not null").select("host", "html")
    one = in_arrow(asked, run, schema_with(asked.select("host"), "path string", "score long"))
    return one.groupBy("host", "path").agg(F.sum("score").alias("score"))


def winners(voted: DataFrame) -> DataFrame:
    """host and paths: its PATHS paths of the highest scores, best first, ties by path."""
    order = Window.partitionBy("host").orderBy(F.desc("score"), "path")
    ranked = voted.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= PATHS)
    listed = F.array_sort(F.collect_list(F.struct("_rank", "path")))  # PATHS at most
    return ranked.groupBy("host").agg(F.transform(listed, lambda p: p["path"]).alias("paths"))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (its code points) of each row of pages (page_id, url, html).

    The text's blocks are joined by line feeds, white space inside one is a single space and character references are decoded.
    A null html counts as empty, and its text is empty. Pages of a null url, or one without `://`, have no host: each is read by its own best
    container. Repeated rows vote each and fare alike; ties of paths go to the first in order. Extra columns are ignored, whatever
    their names. Long pages are read whole. An empty table gives an empty one.
    """
    hosted = with_host_and_path(pages.select("page_id", "url", "html")).drop("path")
    paths = table(winners(votes(hosted)), "html-paths")
    asked = hosted.join(small(paths), "host", "left").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(parsed(html), paths or []) for html, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return in_arrow(asked, run, schema_with(asked.select("page_id", "url"), "text string", "n_chars long"))


def op11_html_text(spark, sf_dir):
    """The main text of every page."""
    return extracted(read(spark, sf_dir, "pages"))


#: For pages whose article is what an `article` element holds, in headings and paragraphs, and whose references are these few.
OP11_SQL = r"""
WITH article AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS held FROM pages
), blocks AS (
  SELECT page_id, url, generate_subscripts(parts, 1) AS n, unnest(parts) AS raw FROM (SELECT page_id, url, regexp_split_to_array(held, '</?(p|h1)>') AS parts FROM article)
), told AS (
  SELECT page_id, url, n, trim(regexp_replace(replace(regexp_replace(replace(regexp_replace(replace(raw, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&(amp;|amp\b)', '&', 'g'), chr(160), ' '), '\s+', ' ', 'g')) AS block FROM blocks
), joined AS (
  SELECT page_id, url, coalesce(string_agg(block, chr(10) ORDER BY n) FILTER (WHERE block <> ''), '') AS text FROM told GROUP BY page_id, url
)
SELECT page_id, url, text, length(text) AS n_chars FROM joined
"""
