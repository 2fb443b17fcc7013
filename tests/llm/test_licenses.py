"""License templates against regular expressions, and the query's columns
against plain Python."""

import random
import re

import pytest

from graphloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def as_regex(parts):
    out = ""
    for p in parts:
        if isinstance(p, str):
            out += re.escape(p) + " "
        elif p[0] == "free":
            out += f"(?:[^ ]+ ){{0,{p[1]}}}"
        else:
            out += "(?:" + "|".join(as_regex(w) for w in p[1]) + ")"
    return out


def longest_places(parts, words):
    """Leftmost, longest, by trying every end of every start."""
    pattern, out, at = re.compile(as_regex(parts)), [], 0
    while at < len(words):
        ends = [b for b in range(len(words), at, -1) if pattern.fullmatch("".join(w + " " for w in words[at:b]))]
        if ends:
            out.append((at, ends[0]))
            at = ends[0]
        else:
            at += 1
    return out


def test_automaton_equals_regular_expressions():
    r = random.Random(4)
    templates = ["a b [[c]] d", "a {{*3}} b", "{{a|b c|}} d [[a [[b]] c]] b", "[[a|b]] c {{*2}} d {{a|b}}", "{{*2}} a b", "a a a"]
    parsed = [licenses.parse(t) for t in templates]
    automaton = licenses.Automaton(parsed)
    for _ in range(600):
        words = [r.choice("abcdx") for _ in range(r.randint(0, 14))]
        got = automaton.places(words)
        for n, parts in enumerate(parsed):
            assert [(a, b) for t, a, b, _ in got if t == n] == longest_places(parts, words), (templates[n], words)


def filled(parts, r):
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(p)
        elif p[0] == "free":
            out += [f"name{r.randint(0, 9)}" for _ in range(r.randint(0, p[1]))]
        else:
            out += filled(r.choice(p[1]), r)
    return out


def test_every_template_accepts_its_wording_and_no_other():
    r = random.Random(8)
    for label, template in licenses.TEMPLATES:
        parts = licenses.parse(template)
        automaton = licenses.Automaton([parts])
        for _ in range(5):
            words = filled(parts, r)
            (place,) = automaton.places(["zz", *words, "zz"])[:1]
            assert place[2] - place[1] >= len([w for w in words if not w.startswith("name")]), label
            run = licenses.anchor(parts).split()
            assert any(words[i : i + len(run)] == run for i in range(len(words)))
            cut = next(i for i in range(len(words)) if words[i : i + len(run)] == run)
            assert not automaton.places([*words[:cut], "other", *words[cut + 1 :]]) or words.count(run[0]) > 1
    for broken in ("[[a", "a ]]", "{{a", "[[a]]", "{{*3}}"):
        with pytest.raises(ValueError):
            licenses.anchor(licenses.parse(broken))


def brute(doc_id, text):
    words = plain_words(text)
    base = {}
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        if at:
            base[label] = at
    places = [(label, a, b) for label, template in licenses.TEMPLATES if f" {licenses.anchor(licenses.parse(template))} " in f" {' '.join(words)} "
              for a, b in longest_places(licenses.parse(template), words)]
    starts = [a for x in base.values() for a in x]
    return (doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted({*base, *(p[0] for p in places)}))), places


TEXTS = [
    None, "", " .. -- ", "plain prose with no license of any kind", "MIT License MIT license mit-license", "the mit license, and the APACHE\tLicense; cc by cc by",
    "GNU General Public License gnu general public license", "é mit éxlicense mit license", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.", "x. Licensed under the Apache License, Version 2.0. y", "SPDX-License-Identifier: Apache-2.0",
    "transmit license ", "mit licenses", "cc bylaws acc by", "Licensed under the Creative Commons CC BY-SA 4.0 International License", "\x00mit\x01license\x7f", "一mit license",
    "licensed under the gnu general public license version 2 0 and released under the terms of the apache license 2.0",
]


def test_scan_equals_brute_force(spark, sf_dir):
    made = [(n, t, "x", 3) for n, t in enumerate(TEXTS)] + [(None, TEXTS[9], "y", 1), (4, TEXTS[4], "z", 2)]
    rng = random.Random(1)
    full = " ".join(filled(licenses.parse(licenses.TEMPLATES[0][1]), rng)).title()
    made += [(100, f"Copyright 2020 Someone\n\n{full}.", "x", 1), (101, full.replace("Obtaining", "Getting"), "x", 1)]
    df = spark.createDataFrame(made, "doc_id long, text string, n_words string, places int").repartition(3)
    got = sorted((tuple(x) for x in licenses.digest(df).collect()), key=str)
    want = sorted(((x, p) for x, p in (brute(d, t) for d, t, *_ in made)), key=str)
    assert sorted((g[:7] for g in got), key=str) == sorted((w[0] for w in want), key=str)
    by_id = {g[0]: g for g in got}
    for (d, *_), places in want:
        assert sorted((p.label, p.first, p.first + p.n) for p in by_id[d][8]) == sorted(places)
        score = by_id[d][7]
        assert 0 <= score <= 1 and (score == 0) == (not by_id[d][6]) and (score > 0.5) == bool(places)
    assert licenses.digest(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars < 900 OR n_chars < 4000 AND (text LIKE '%icensed under%' OR text LIKE '%eleased under%')")
    got = {x.doc_id: tuple(x)[:7] for x in licenses.digest(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == brute(r.doc_id, r.text)[0]
    assert any(g[6] != g[5] for g in got.values())
