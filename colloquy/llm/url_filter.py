"""URL filtering by a bit-parallel wildcard automaton.

All glob rules share one multiword bit vector: a state for the start of each rule and one
for each of its characters. For every byte c of a canonical URL the states step together,

    D = ((D << 1) & accepts[c]) | (D & loops[c])

where `*` makes the state before it loop on any byte, and `%` on any byte but `/` (the
host's part). Many URLs step at once, a row of words each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, schema_with

#: Bytes of URLs that step together at most.
BLOCK = 1 << 21


@dataclass(frozen=True)
class Rule:
    """action: allow or block. A glob is held against `.host/path`; host and path rules fit the host with all its subdomains."""

    action: str
    glob: str
    name: str | None = None
    weight: int = 0


def host_rule(action: str, host: str, path: str = "/") -> Rule:
    if set(host + path) & set("*%?"):
        raise ValueError(f"no wildcards in a host rule: {host}{path}")
    return Rule(action, f"%.{host}{path}*", host + path, len(host + path))


class Automaton:
    def __init__(self, globs: list[str]):
        states: list[tuple[bool, bytes | None, str]] = []  # is a start, the byte accepted (None: any), what it loops on
        finals = []
        for glob in globs:
            raw = glob.encode()
            states.append((True, b"", ""))
            for k in range(len(raw)):
                c = raw[k : k + 1]
                if c in b"*%":
                    start, byte, loop = states[-1]
                    states[-1] = (start, byte, "*" if c == b"*" or loop == "*" else "%")
                else:
                    states.append((False, None if c == b"?" else c, ""))
            finals.append(len(states) - 1)
        words = (len(states) + 63) // 64 or 1
        self.accepts, self.loops = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        self.initial = np.zeros(words, np.uint64)
        self.finals = np.array(finals, np.int64)
        for s, (start, byte, loop) in enumerate(states):
            word, bit = s // 64, np.uint64(1 << s % 64)
            if start:
                self.initial[word] |= bit
            elif byte is None:
                self.accepts[:, word] |= bit
            else:
                self.accepts[byte[0], word] |= bit
            if loop:
                self.loops[:, word] |= bit
            if loop == "%":
                self.loops[ord("/"), word] &= ~bit

    def _step_all(self, urls: list[bytes]) -> np.ndarray:
        """For URLs in order of falling length: which rules accept each."""
        sizes = np.array([len(u) for u in urls], np.int64)
        text = np.zeros((len(urls), max(int(sizes[0]), 1)), np.uint8)
        for row, u in zip(text, urls, strict=True):
            row[: len(u)] = np.frombuffer(u, np.uint8)
        at = np.repeat(self.initial[None, :], len(urls), axis=0)
        for k in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -k, side="left"))  # rows of more than k bytes
            now, c = at[:n], text[:n, k]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            at[:n] = (moved & self.accepts[c]) | (now & self.loops[c])
        return (at[:, self.finals // 64] >> (self.finals % 64).astype(np.uint64)) & np.uint64(1) != 0

    def __call__(self, urls: list[bytes]) -> np.ndarray:
        """A row for each URL, a column for each rule."""
        out = np.zeros((len(urls), len(self.finals)), bool)
        order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        k = 0
        while k < len(order):
            n = max(1, BLOCK // max(1, len(urls[order[k]]) + 8 * self.initial.size))
            part = order[k : k + n]
            out[part] = self._step_all([urls[i] for i in part])
            k += n
        return out


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (from the first `://` to `/`, `?`, `#` or the end; A-Z lower-cased) and path (then to `?`, `#` or the end).
    Both are empty for a null url and one without `://`. Columns of these names are replaced."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return df.withColumns({"host": F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower()), "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def judge(df: DataFrame, rules: list[Rule], defaults: list[Rule] = (), otherwise: str = "allow") -> DataFrame:
    """Adds rule and verdict to rows with host and path. The fitting rule of the largest weight decides, the first listed
    among equals. Without one, rule is null and the first fitting default decides, else `otherwise`.

    Null hosts and paths count as empty. URLs are judged whole, however long, and each by itself, so repeated rows agree. Clashing
    columns are replaced; an empty table gives an empty one.
    """
    kept = df.drop("rule", "verdict")
    host, path = kept.columns.index("host"), kept.columns.index("path")
    ranked = sorted(rules, key=lambda r: -r.weight)
    every = [*ranked, *defaults]
    names = [r.name or r.glob for r in ranked] + [None] * (len(defaults) + 1)
    actions = [r.action for r in every] + [otherwise]

    def per_partition():
        fits = Automaton([r.glob for r in every])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            urls = [f".{h or ''}{p or ''}".encode() for h, p in zip(batch.column(host).to_pylist(), batch.column(path).to_pylist(), strict=True)]
            found = np.concatenate([fits(urls), np.ones((len(urls), 1), bool)], axis=1).argmax(axis=1).tolist()
            more = [pa.array([names[i] for i in found], pa.string()), pa.array([actions[i] for i in found], pa.string())]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "rule", "verdict"])

        return step

    return arrow_rows(kept, schema_with(kept, "rule string", "verdict string"), per_partition)


#: The rules of op3.
RULES = [host_rule("block", "net"), host_rule("allow", "example.net", "/en/"), host_rule("block", "example.com", "/de/"), host_rule("allow", "org", "/fr/")]
# Globs of the block list for urls that no rule fits, by kind. A glob is held against `.host/path` (`.host` alone where there
# is no path); `%` stands for any bytes but `/`, so up to it a glob speaks of the host, `*` for any bytes, `?` for one.
BLOCKED = {
    "words of spam, pills and gambling in a host": ["%spam*", "%pills*", "%casino*", "%.poker*", "%.bet365*", "%viagra*", "%lottery*"],
    "hosts of advertising, tracking and short links": ["%.ads.*", "%.ad?.*", "%.adserver*", "%.track.*", "%.tracker.*", "%.click.*", "%.doubleclick.*", "%.bit.ly", "%.bit.ly/*", "%.t.co", "%.t.co/*", "%.goo.gl", "%.goo.gl/*"],
    "pages behind a session": ["%/*/login", "%/login*", "%/*/logout*", "%/signup*", "%/*/cart/*", "%/cart/*", "%/checkout*", "%/*/wp-admin/*", "%/wp-admin/*", "%/cgi-bin/*"],
    "files that hold no text": ["%/*.exe", "%/*.zip", "%/*.apk", "%/*.iso", "%/*.mp?", "%/*.jp?g", "%/*.jpg", "%/*.png", "%/*.gif", "%/*.woff?", "%/*.css", "%/*.js"],
    "endless listings": ["%/*/page/????*", "%/calendar/*", "%/*/calendar/*", "%/*/tag/*/feed*", "%/search/*/search/*"],
}
#: What the method says of a url that no rule fits: these globs block it.
DEFAULTS = [Rule("block", glob) for globs in BLOCKED.values() for glob in globs]


def op3_url_filter(spark, sf_dir):
    """page_id, host, path, rule and verdict of every page."""
    from .common import read

    pages = with_host_and_path(read(spark, sf_dir, "pages").select("page_id", "url"))
    return judge(pages.select("page_id", "host", "path"), RULES, DEFAULTS)


#: The same rules and the same block list, told by conditions on host and path instead of globs.
OP3_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN contains(host, 'spam') OR contains(host, 'pills') OR contains(host, 'casino') OR contains(host, 'viagra') OR contains(host, 'lottery') THEN 'block'
  WHEN len(list_filter(string_split(host, '.'), lambda l: starts_with(l, 'poker') OR starts_with(l, 'bet365') OR starts_with(l, 'adserver'))) > 0 THEN 'block'
  WHEN len(list_filter(string_split(host, '.')[:-2], lambda l: l IN ('ads', 'track', 'tracker', 'click', 'doubleclick') OR octet_length(encode(l)) = 3 AND starts_with(l, 'ad'))) > 0 THEN 'block'
  WHEN host IN ('bit.ly', 't.co', 'goo.gl') OR ends_with(host, '.bit.ly') OR ends_with(host, '.t.co') OR ends_with(host, '.goo.gl') THEN 'block'
  WHEN starts_with(path, '/login') OR starts_with(path, '/signup') OR starts_with(path, '/checkout') OR starts_with(path, '/cgi-bin/') OR starts_with(path, '/calendar/') THEN 'block'
  WHEN ends_with(path, '/login') OR contains(path[2:], '/logout') OR contains(path, '/cart/') OR contains(path, '/wp-admin/') OR contains(path, '/calendar/') THEN 'block'
  WHEN len(list_filter(['.exe', '.zip', '.apk', '.iso', '.jpg', '.png', '.gif', '.css', '.js'], lambda e: ends_with(path, e))) > 0 OR regexp_matches(path, '(?s)\.(mp.|jp.g|woff.)$') THEN 'block'
  WHEN regexp_matches(path, '(?s)^/.*/page/....') OR regexp_matches(path, '(?s)^/.*/tag/.*/feed') OR regexp_matches(path, '(?s)^/search/.*/search/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
