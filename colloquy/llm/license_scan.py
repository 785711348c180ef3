"""License scans by template markup compiled into token automata.

A template is mandatory wording with `[[optional words]]` and `{{n}}`, a replaceable region
of up to n words of any kind. It compiles into an automaton over words with a state for
each place in the template; a text is accepted where the mandatory wording stands exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows, schema_with

#: Bytes that part words become spaces, A-Z becomes a-z; all bytes of non-ASCII characters belong to words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORDS).split()


@dataclass
class Template:
    label: str
    markup: str
    base: bool = False
    #: Of each state: the words that lead on, where any word leads, and where nothing need be read.
    by_word: list[dict[bytes, int]] = field(default_factory=list)
    by_any: list[int | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    anchor: bytes = b""
    mandatory: int = 0

    def __post_init__(self):
        self._state()
        runs: list[list[bytes]] = [[]]
        depth_at: int | None = None
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", self.markup):
            if part == "[[":
                if depth_at is not None:
                    raise ValueError("optional regions don't nest")
                depth_at = len(self.by_word) - 1
                runs.append([])
            elif part == "]]":
                self.free[depth_at].append(len(self.by_word) - 1)
                depth_at = None
                runs.append([])
            elif part.startswith("{{"):
                begun = [len(self.by_word) - 1]
                for _ in range(int(part[2:-2])):
                    self.by_any[-1] = len(self.by_word)
                    self._state()
                    begun.append(len(self.by_word) - 1)
                for s in begun[:-1]:
                    self.free[s].append(begun[-1])
                runs.append([])
            else:
                for word in words_of(part):
                    self.by_word[-1][word] = len(self.by_word)
                    self._state()
                    if depth_at is None:
                        self.mandatory += 1
                        runs[-1].append(word)
        if depth_at is not None or not self.by_word[0] or self.free[0]:
            raise ValueError(f"a template must begin with mandatory wording and close its regions: {self.markup}")
        self.anchor = b" " + max((b" ".join(r) for r in runs), key=len) + b" "
        (self.first,) = self.by_word[0]

    def _state(self) -> None:
        self.by_word.append({})
        self.by_any.append(None)
        self.free.append([])

    def accepts_at(self, words: list[bytes], i: int) -> bool:
        """Whether the template matches from word i on; reads at most as many words as it has states."""
        end, now = len(self.by_word) - 1, {0}
        while now:
            todo = list(now)
            while todo:
                for s in self.free[todo.pop()]:
                    if s not in now:
                        now.add(s)
                        todo.append(s)
            if end in now:
                return True
            if i == len(words):
                return False
            word, after = words[i], set()
            for s in now:
                if (t := self.by_word[s].get(word)) is not None:
                    after.add(t)
                if (t := self.by_any[s]) is not None:
                    after.add(t)
            now, i = after, i + 1
        return False

    def places(self, words: list[bytes], joined: bytes) -> list[int]:
        """The starts of all matches. joined: the words, each between spaces."""
        if self.anchor not in joined:
            return []
        found, i = [], -1
        try:
            while True:
                i = words.index(self.first, i + 1)
                if self.accepts_at(words, i):
                    found.append(i)
        except ValueError:
            return found


#: Base phrases: exact wording, all places.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
# Templates whose labels the method adds; whole texts of licenses, then notices and tags.
OWN = [
    ("mit-text", """permission is hereby granted free of charge to any person obtaining a copy of this {{2}} and associated documentation files [[the software]]
     to deal in the {{1}} without restriction including without limitation the rights to use copy modify merge publish distribute [[sublicense]] and or sell copies of the
     {{1}} and to permit persons to whom the {{1}} is furnished to do so subject to the following conditions the above copyright notice and this permission notice
     [[including the next paragraph]] shall be included in all copies or substantial portions of the {{1}} the {{1}} is provided as is without warranty of any kind
     express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{6}}
     be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the {{1}}
     or the use or other dealings in the {{1}}"""),
    ("isc-text", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
     notice and this permission notice appear in all copies the software is provided as is and {{6}} disclaims all warranties with regard to this software including all
     implied warranties of merchantability and fitness in no event shall {{6}} be liable for any special direct indirect or consequential damages or any damages whatsoever
     resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or
     performance of this software"""),
    ("bsd-text", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]]
     redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must
     reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""),
    ("bsd-3-clause-text", """neither the name of {{8}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific
     prior written permission"""),
    ("zlib-text", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of
     this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to
     the following restrictions"""),
    ("apache-2.0-text", """licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance with the license you may obtain a copy of the
     license at [[http]] [[https]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is
     distributed on an as is basis without warranties or conditions of any kind either express or implied"""),
    ("gpl-text", """this program is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as published by the
     free software foundation either version {{2}} of the license or at your option any later version"""),
    ("mit-notice", "released under [[the terms of]] the mit license"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 [[the license]]"),
    ("cc-by-nc-4.0-notice", "licensed under [[a]] [[the]] [[creative commons]] cc by nc 4 0"),
    ("cc-by-4.0-notice", "licensed under [[a]] [[the]] [[creative commons]] cc by 4 0"),
    ("gpl-notice", "under the terms of the gnu [[lesser]] [[affero]] general public license"),
    ("mpl-2.0-notice", "subject to the terms of the mozilla public license v 2 0"),
    ("spdx-tag", "spdx license identifier"),
    ("all-rights-reserved", "copyright {{12}} all rights reserved"),
]


def default_templates() -> list[Template]:
    return [Template(label, phrase, True) for label, phrase in BASE] + [Template(label, markup) for label, markup in OWN]


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_words(words: list[bytes], templates: list[Template]) -> tuple:
    joined = b" " + b" ".join(words) + b" "
    base_places: list[int] = []
    base_labels, labels, weight = set(), set(), 0
    for t in templates:
        if not (places := t.places(words, joined)):
            continue
        labels.add(t.label)
        weight += t.mandatory
        if t.base:
            base_labels.add(t.label)
            base_places += places
    first, last = (min(base_places), max(base_places)) if base_places else (None, None)
    return len(words), len(base_places), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), weight / (weight + 1.0)


def scan(df: DataFrame, templates: list[tuple[str, str, bool]] | None = None, text: str = "text") -> DataFrame:
    """Adds n_words, n_base (places of base phrases), first_word, last_word (null without any), base_labels, labels (distinct,
    sorted, comma-joined, empty without any) and score: m / (m + 1) for m mandatory words in the templates found.

    templates: (label, markup, whether it is a base phrase). Null and empty texts have no words. Clashing columns are replaced. Texts
    are scanned whole, however long, and each by itself, so repeated rows agree; an empty table gives an empty one.
    """
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    kept = df.drop(*names)
    at = kept.columns.index(text)

    def per_partition():
        compiled = default_templates() if templates is None else [Template(*t) for t in templates]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [scan_words(words_of(x or ""), compiled) for x in batch.column(at).to_pylist()]
            more = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

        return step

    return arrow_rows(kept, schema_with(kept, *SCHEMA.split(", ")), per_partition)


def op5_license_scan(spark, sf_dir):
    """What the license scan finds in every document."""
    from .common import read

    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("text")


def _pattern(markup: str) -> str:
    """The markup as a regular expression over words, each followed by a space."""
    out = ""
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup):
        out += {"[[": "(?:", "]]": ")?"}.get(part) or (f"(?:[^ ]+ ){{0,{part[2:-2]}}}" if part[0] == "{" else f"{part} ")
    return out


def sql() -> str:
    """What op5 returns, as DuckDB SQL."""
    base = {label: phrase.split() for label, phrase in BASE}
    places = ", ".join(f"list_filter(range(1, len(ws) + 1), lambda i: ws[i:i + {len(p) - 1}] = {p}) AS p{k}" for k, p in enumerate(base.values()))
    own = [(label, f"regexp_matches(joined, ' {_pattern(markup)}')", Template(label, markup).mandatory) for label, markup in OWN]
    found = [(label, f"len(p{k}) > 0", len(p)) for k, (label, p) in enumerate(base.items())] + own
    listed = lambda kinds: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {test} THEN '{label}' END" for label, test, _ in kinds) + "], lambda x: x IS NOT NULL)), ',')"
    weight = " + ".join(f"CASE WHEN {test} THEN {n} ELSE 0 END" for _, test, n in found)
    every = " || ".join(f"p{k}" for k in range(len(base)))
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS n_words, ' ' || array_to_string(ws, ' ') || ' ' AS joined, {places} FROM w), a AS (SELECT *, {every} AS places, {weight} AS weight FROM p)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, {listed(found[: len(base)])} AS base_labels, {listed(found)} AS labels, weight / (weight + 1) AS score FROM a"""
