"""License scans by template-markup matching.

A template is a license's wording with two kinds of markup:

* ``[[ ... ]]`` is an optional region (it may hold regions itself);
* ``{{*n}}`` is a replaceable region: up to n words of any kind (the name of
  an owner, a year); ``{{a|b c}}`` must be one of the wordings it lists.

All other words are mandatory and must stand in the text word for word; case,
punctuation and layout never matter.  Templates compile into one automaton of
words, run once over a text from left to right, every thread of it carrying
where it began and how many free words it has taken.  A template's places are
its leftmost, then longest, matches that do not overlap.

In Spark, words, phrase counts and the test for a template's anchor (a run of
mandatory words that no match can lack) are expressions; only texts that hold
an anchor go to Python, in Arrow batches, and the rows never move between
tasks: there is no shuffle.

Defined results: null text is empty; a text without words has no places; the
score is 0 without any evidence, 0.5 for a bare phrase, and for a template
0.5 plus half the share of its longest place's words that are not free; rows
with null or repeated ids give a row each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that name a license, and its label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_AS_IS = "is provided {{by the copyright holders and contributors|by {{*8}}|}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_DAMAGES = (
    "in no event shall {{*12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to"
    " procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability"
    " whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software"
    " even if advised of the possibility of such damage"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
    " in the documentation and or other materials provided with the distribution"
)
_CC = {"": "by", "-nc": "by nc", "-sa": "by sa", "-nd": "by nd", "-nc-sa": "by nc sa", "-nc-nd": "by nc nd"}

#: (label, template): the wording of widely used licenses and notices.  Fixed
#: values: a license's mandatory words are what its authors published.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
            " [[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge publish"
            " distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the"
            " following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all"
            " copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including"
            " but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{*12}} be"
            " liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection"
            " with the software or the use or other dealings in the software"),
    ("mit", "{{released|licensed|distributed|available|published}} under the [[terms of the]] mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the"
            " above copyright notice and this permission notice appear in all copies the software is provided as is and {{*8}} disclaims all warranties"
            " with regard to this software including all implied warranties of merchantability and fitness"),
    ("bsd-3-clause", f"{_BSD} [[3]] neither the name of {{{{*14}}}} nor the names of its contributors may be used to endorse or promote products derived from"
                     f" this software without specific prior written permission this software {_AS_IS} {_DAMAGES}"),
    ("bsd-2-clause", f"{_BSD} this software {_AS_IS} {_DAMAGES}"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
                   " [[you may obtain a copy of the license at {{*12}}]] unless required by applicable law or agreed to in writing software distributed"
                   " under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
                   " [[see the license for the specific language governing permissions and limitations under the license]]"),
    ("apache-2.0", "{{released|licensed|distributed|available|published}} under the [[terms of the]] apache license [[version]] 2 0"),
    ("gpl-3.0", "[[this work is]] {{released|licensed|distributed|available|published}} under the [[terms of the]] gnu general public license [[version|v]] {{3|v3}} [[0]]"),
    ("gpl-3.0", "[[this work is]] {{released|licensed|distributed|available|published}} under the [[terms of the]] gnu general public license version {{3}} [[0]]"),
    ("gpl-2.0", "[[this work is]] {{released|licensed|distributed|available|published}} under the [[terms of the]] gnu general public license version {{2}} [[0]]"),
    ("gpl", "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the"
            " free software foundation {{either|}} version {{2|3}} of the license [[or at your option any later version]]"),
    ("lgpl", "is free software you can redistribute it and or modify it under the terms of the gnu {{lesser|library}} general public license as published"
             " by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file"
                " you can obtain one at {{*8}} mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or"
                  " distribute this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising"
             " from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to"
             " alter it and redistribute it freely"),
    *[(f"cc-by{kind}-4.0", f"{{{{released|licensed|distributed|available|published}}}} under [[{{{{a|the}}}}]] [[creative commons]] cc {words} 4 0 [[international]] [[license]]")
      for kind, words in _CC.items()],
    *[(name, f"spdx license identifier {re.sub(r'[-.]', ' ', name)}")
      for name in ("mit", "isc", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "gpl-2.0", "gpl-3.0", "mpl-2.0", "cc-by-4.0", "cc-by-nc-4.0", "cc-by-sa-4.0", "zlib", "unlicense")],
]


def words_of(text: str) -> list[str]:
    lowered = text.translate(str.maketrans(UPPER, LOWER))
    return [w for w in re.split(GAPS, lowered) if w]


_TOKEN = re.compile(r"\[\[|\]\]|\{\{\*\d+\}\}|\{\{|\}\}|\||[^\s\[\]{}|]+")


def parse(template: str) -> list:
    """Nested lists: words, ("free", n) and ("any_of", alternatives)."""
    tokens = _TOKEN.findall(template)
    at = 0

    def sequence(ends: tuple[str, ...]) -> list:
        nonlocal at
        out: list = []
        while at < len(tokens) and tokens[at] not in ends:
            token = tokens[at]
            at += 1
            if token in ("[[", "{{"):
                close = "]]" if token == "[[" else "}}"
                ways = [sequence(("|", close))]
                while at < len(tokens) and tokens[at] == "|":
                    at += 1
                    ways.append(sequence(("|", close)))
                if at == len(tokens):
                    raise ValueError(f"{token} without {close}")
                at += 1
                out.append(("any_of", ways + [[]] if token == "[[" else ways))
            elif token.startswith("{{*"):
                out.append(("free", int(token[3:-2])))
            elif token in ("]]", "}}", "|"):
                raise ValueError(f"{token} stands alone")
            else:
                out += words_of(token)
        return out

    return sequence(())


def anchor(parts: list) -> str:
    """The longest run of words that every match holds one after another."""
    best: list[str] = []
    run: list[str] = []
    for part in [*parts, None]:
        if isinstance(part, str):
            run.append(part)
        else:
            best = max(best, run, key=len)
            run = []
    if not best:
        raise ValueError("a template needs mandatory words")
    return " ".join(best)


class Automaton:
    """States with edges by word, edges by any word, and accepting marks; the
    steps that read nothing are closed over when it is built."""

    def __init__(self, templates: list[list]):
        self.by_word: list[dict[str, list[int]]] = []
        self.by_any: list[list[int]] = []
        self._skip: list[list[int]] = []
        accepts: dict[int, int] = {}
        entries = []
        for n, parts in enumerate(templates):
            first = self._state()
            accepts[self._chain(parts, first)] = n
            entries.append(first)
        closed = [self._closure(s) for s in range(len(self._skip))]
        #: What reaching a state means: templates accepted, states to read on from.
        self.accepts = [[accepts[t] for t in c if t in accepts] for c in closed]
        self.reads = [[t for t in c if self.by_word[t] or self.by_any[t]] for c in closed]
        self.starts: dict[str, list[int]] = {}
        self.any_starts: list[int] = []
        for first in entries:
            for s in self.reads[first]:
                for word, to in self.by_word[s].items():
                    self.starts.setdefault(word, []).extend(to)
                self.any_starts += self.by_any[s]

    def _state(self) -> int:
        self.by_word.append({})
        self.by_any.append([])
        self._skip.append([])
        return len(self._skip) - 1

    def _chain(self, parts: list, at: int) -> int:
        for part in parts:
            end = self._state()
            if isinstance(part, str):
                self.by_word[at].setdefault(part, []).append(end)
            elif part[0] == "free":
                self._skip[at].append(end)
                for _ in range(part[1]):
                    to = self._state()
                    self.by_any[at].append(to)
                    self._skip[to].append(end)
                    at = to
            else:
                for way in part[1]:
                    first = self._state()
                    self._skip[at].append(first)
                    self._skip[self._chain(way, first)].append(end)
            at = end
        return at

    def _closure(self, state: int) -> list[int]:
        seen, todo = {state}, [state]
        while todo:
            for to in self._skip[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return sorted(seen)

    def places(self, words: list[str]) -> list[tuple[int, int, int, int]]:
        """(template, start, end, free words), leftmost, then longest, then
        with fewest free words, not overlapping within a template."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        active: dict[tuple[int, int], int] = {}  # (state, start): free words
        for at, word in enumerate(words):
            now: dict[tuple[int, int], int] = {}

            def reach(states: list[int], start: int, free: int) -> None:
                for s in states:
                    if free < now.get((s, start), 1 << 60):
                        now[s, start] = free

            for (state, start), free in active.items():
                for s in self.reads[state]:
                    reach(self.by_word[s].get(word, ()), start, free)
                    reach(self.by_any[s], start, free + 1)
            reach(self.starts.get(word, ()), at, 0)
            reach(self.any_starts, at, 1)
            for (state, start), free in now.items():
                for template in self.accepts[state]:
                    old = found.get((template, start), (0, 0))
                    found[template, start] = max(old, (at + 1, -free))
            active = now
        out: list[tuple[int, int, int, int]] = []
        for (template, start), (end, free) in sorted(found.items()):
            if not out or out[-1][0] != template or out[-1][2] <= start:
                out.append((template, start, end, -free))
        return out


def _spaced(text: str) -> Column:
    """The words with one space before, between and behind."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, GAPS, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


PLACE = "array<struct<label:string, first:long, n:long, free:long>>"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``base`` (for each phrase: label, places,
    first and last start) and ``places`` (of templates: label, first word,
    number of words, free words among them)."""
    templates = TEMPLATES if templates is None else templates
    parts = [parse(t) for _, t in templates]
    labels = [label for label, _ in templates]
    anchors = sorted({anchor(p) for p in parts})
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(PLACE)
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(parts)
        for batch in batches:
            yield pd.Series([
                None if x is None else [{"label": labels[t], "first": a, "n": b - a, "free": free} for t, a, b, free in automaton.places(x.split())] for x in batch
            ], index=batch.index, dtype=object)

    spaced = F.col("_spaced")
    has_anchor = F.lit(False)
    for a in anchors:
        has_anchor = has_anchor | F.contains(spaced, F.lit(f" {a} "))

    def phrase(words: str, label: str) -> Column:
        length = len(words.split())
        around = F.split(spaced, f" {words}(?= )", -1)
        held = F.when(F.contains(spaced, F.lit(f" {words} ")), around).otherwise(F.array(spaced))
        return F.struct(
            F.lit(label).alias("label"), (F.size(held) - 1).cast("long").alias("n"), _spaces(F.element_at(held, 1)).cast("long").alias("first"),
            (F.col("n_words") - length - _spaces(F.element_at(held, -1)) + 1).cast("long").alias("last"),
        )

    wide = docs.withColumn("_spaced", _spaced(text)).withColumn(
        "n_words", F.when(spaced == "  ", F.lit(0)).otherwise(_spaces(spaced) - 1).cast("long")
    )
    found = wide.withColumn("base", F.filter(F.array(*[phrase(*x) for x in PHRASES.items()]), lambda b: b["n"] > 0)).withColumn(
        "places", F.coalesce(matched(F.when(has_anchor, spaced)), F.array().cast(PLACE))
    )
    return found.drop("_spaced")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, places)."""
    base, places = F.col("base"), F.col("places")
    total = F.aggregate(base, F.lit(0).cast("long"), lambda a, b: a + b["n"])
    joined = lambda names: F.array_join(F.array_sort(F.array_distinct(names)), ",")
    longest = F.element_at(F.array_sort(F.transform(places, lambda p: F.struct(p["n"], p["free"]))), -1)
    found = scan(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", total.alias("n_base"), F.array_min(base["first"]).alias("first_word"), F.array_max(base["last"]).alias("last_word"),
        joined(base["label"]).alias("base_labels"), joined(F.concat(base["label"], places["label"])).alias("labels"),
        F.when(F.size(places) > 0, 0.5 + 0.5 * (1 - longest["free"] / longest["n"])).when(total > 0, F.lit(0.5)).otherwise(F.lit(0.0)).alias("score"),
        "places",
    )
