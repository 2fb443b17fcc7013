"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are words (lower case, ASCII punctuation apart).  The CGK
random walk reads a sequence with a pointer that moves on or stays by a
random bit of the word under it, and writes that word at each step: two
sequences at a small edit distance give outputs at a small Hamming distance.
Outputs at sampled steps make the keys of the LSH; a key shared by a window
of a text and an item makes a candidate, and several walks with many samples
each reach the target recall (0.99 at a fifth of the words edited, measured
by the tests).  Windows are sized by item length class.  They start at every
``stride``-th word, while items are embedded from each of their words, so that
edits, rewritten or missing stretches anywhere leave windows that line up.  The samples of a key lie in the first steps of its
walk, in more of them from key to key: short keys survive edits spread
evenly, where few words in a row are kept.

Of the candidates, stretches that hold too few of the item's words are
dropped (no match is lost).  The rest are verified exactly: the smallest word
edit distance between the whole item and any stretch of the text there
(Myers' bit-parallel search) may be a fifth of the item's words.

The items' keys go to every task behind a check of the benchmark's words;
larger benchmarks go through in parts of that size.  Texts are read once a
part and never shuffled.

Defined results: null and empty texts match nothing, null and empty items
are never found; null ids stay null, and such documents are cleaned away like
any other; repeated documents give their rows again, repeated items (same
text) are searched once and reported under each id; empty tables give no
rows; extra columns are ignored (kept by ``clean``), whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_SIMILARITY = 0.8
#: Words of benchmark text whose keys one index holds (some 300 bytes each).
PART_WORDS = 300_000
WALKS = 3
SAMPLES = 12
#: (shortest item in words, stride of windows, steps of a walk, steps in a key,
#: steps that the shortest key draws from)
CLASSES = ((40, 4, 24, 4, 6), (20, 2, 16, 4, 6), (10, 1, 10, 3, 4), (5, 1, 7, 2, 2), (1, 1, 2, 1, 2))
PAD = 64
FILTER_BITS = 18
FILTER_SHIFT = np.uint32(32 - FILTER_BITS)

_BLANK = bytes.maketrans(
    b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum()),
    b" " * sum(1 for c in range(33, 127) if not chr(c).isalnum()),
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_BLANK).split()


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = xxhash.xxh32_intdigest(word) or 1
        self[word] = value
        return value


def hashes_of(words: list[bytes], known: _WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint32, count=len(words))


class Cgk:
    """Keys of windows for one length class: fixed random steps and samples."""

    def __init__(self, number: int, steps: int, picks: int, shortest: int) -> None:
        rng = np.random.default_rng(1000 + number)
        odd = lambda *shape: rng.integers(0, 1 << 31, shape, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.steps = steps
        self.turns = odd(WALKS, steps)
        # One step from each part of the span, so that a key's words lie apart.
        spans = np.linspace(shortest, steps, SAMPLES).astype(int)
        edges = [np.linspace(0, span, picks + 1).astype(int) for span in spans]
        self.samples = [
            [[int(rng.integers(a, b)) for a, b in zip(e[:-1], e[1:])] for e in edges] for _ in range(WALKS)
        ]
        self.factors = odd(WALKS, SAMPLES, picks)

    def keys(self, tokens: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the key, keys of all starts); ``tokens`` must go on for
        ``steps`` words after the last start."""
        for number, key, _ in self._walks(tokens, starts, False):
            yield number, key

    def apart(self, tokens: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys of all starts, whether a key's words are at as many places)."""
        for _, key, places in self._walks(tokens, starts, True):
            yield key, (np.diff(places, axis=0) > 0).all(axis=0)

    def _walks(self, tokens: np.ndarray, starts: np.ndarray, placed: bool) -> Iterator[tuple]:
        for walk in range(len(self.turns)):
            at = starts.copy()
            out, places = [], []
            for turn in self.turns[walk]:
                if placed:
                    places.append(at.copy())
                seen = tokens[at]
                out.append(seen)
                at += ((seen * turn) >> np.uint32(31)).astype(at.dtype)
            for sample in range(SAMPLES):
                key = np.zeros(len(starts), dtype=np.uint32)
                for step, factor in zip(self.samples[walk][sample], self.factors[walk, sample]):
                    key += out[step] * factor
                key ^= key >> np.uint32(15)
                yield walk * SAMPLES + sample, key, [places[step] for step in self.samples[walk][sample]] if placed else None


class Index:
    """The keys of all items, by class."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        known = _WordHashes()
        self.items = [(i, words_of(t)) for i, t in items]
        self.words_by_key = dict(self.items)
        self.words = [hashes_of(w, known) for _, w in self.items]
        by_class: dict[int, list[int]] = defaultdict(list)
        for n, w in enumerate(self.words):
            if len(w):
                by_class[next(c for c, (least, *_) in enumerate(CLASSES) if len(w) >= least)].append(n)
        self.classes = []
        for c, members in sorted(by_class.items()):
            least, stride, steps, picks, shortest = CLASSES[c]
            cgk = Cgk(c, steps, picks, shortest)
            # Items of under five words admit no edit: their start is enough.
            owners = np.array(
                [(n, at) for n in members for at in range(1 if least == 1 else len(self.words[n]) - picks + 1)],
                dtype=np.int32,
            )
            joined = np.concatenate([np.append(self.words[n], np.zeros(PAD, np.uint32)) for n in members])
            sizes = np.array([len(self.words[n]) + PAD for n in members])
            begins = dict(zip(members, (np.cumsum(sizes) - sizes).tolist()))
            starts = np.array([begins[n] + at for n, at in owners.tolist()], dtype=np.int32)
            tables = []
            for keys, apart in cgk.apart(joined, starts):
                # A walk that stood still says too little: its keys are left out.
                mine = np.flatnonzero(apart)
                order = mine[np.argsort(keys[mine], kind="stable")].astype(np.int32)
                tables.append((keys[order], order))
            self.classes.append((stride, cgk, owners, tables))
        self.filled: list[list[np.ndarray]] = []

    def filters(self) -> list[list[np.ndarray]]:
        """For each table which upper parts of keys it has.  Made where it is
        used: only the keys themselves travel."""
        if not self.filled:
            for _, _, _, tables in self.classes:
                made = []
                for known, _ in tables:
                    has = np.zeros(1 << FILTER_BITS, dtype=bool)
                    has[known >> FILTER_SHIFT] = True
                    made.append(has)
                self.filled.append(made)
        return self.filled

    def candidates(self, tokens: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows of (document, item, word where the item would begin) from texts laid
        out in ``tokens`` with padding after each."""
        found = [np.empty((0, 3), dtype=np.int64)]
        for (stride, cgk, owners, tables), filters in zip(self.classes, self.filters()):
            counts = -(-sizes // stride)
            doc = np.repeat(np.arange(len(sizes)), counts)
            step = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            starts = (begins[doc] + step * stride).astype(np.int32)
            if not len(starts):
                continue
            for number, keys in cgk.keys(tokens, starts):
                known, order = tables[number]
                hits = np.flatnonzero(filters[number][keys >> FILTER_SHIFT])
                low = np.searchsorted(known, keys[hits], "left")
                many = np.searchsorted(known, keys[hits], "right") - low
                w = np.repeat(hits, many)
                place = np.arange(len(w)) - np.repeat(np.cumsum(many) - many - low, many)
                item, shift = owners[order[place]].T
                found.append(np.stack([doc[w], item, step[w] * stride - shift], axis=1))
        return np.concatenate(found)


def search_distance(item: list[int], text: list[int]) -> tuple[int, int]:
    """(smallest edit distance of the whole item to a stretch of the text,
    end of the first such stretch)."""
    m = len(item)
    where: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        where[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = (m, 0)
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        grow = down | ~(diag | up) & full
        fall = up & diag
        if grow & top:
            score += 1
        elif fall & top:
            score -= 1
        grow = (grow << 1) & full
        fall = (fall << 1) & full
        up = fall | ~(diag | grow) & full
        down = grow & diag
        if score < best[0]:
            best = (score, j + 1)
    return best


MATCH = "doc_id string, item_key long, edit_distance int, item_words int, similarity double, end_word long"


def allowed(words: int, similarity: float) -> int:
    return math.floor(words * (1 - similarity) + 1e-9)


def _blocks(index: Index, texts: list, known: _WordHashes, similarity: float) -> Iterator[tuple[int, list[tuple]]]:
    """(number of the first text, matches) for texts of some 65,536 words at a time."""
    low = 0
    while low < len(texts):
        held, size, high = [], 0, low
        while high < len(texts) and (not held or size < 1 << 16):
            held.append(hashes_of(words_of(texts[high]), known))
            size += len(held[-1])
            high += 1
        rows = _matches(index, held, similarity)
        yield low, [r for r in rows if _confirmed(index, r, texts[low + r[0]], similarity)]
        low = high


def _confirmed(index: Index, row: tuple, text: str, similarity: float) -> bool:
    """Whether the words themselves are as near as their hashes said."""
    item, end = index.words_by_key[row[1]], row[5]
    number: dict[bytes, int] = {}
    numbers = lambda words: [number.setdefault(w, len(number)) for w in words]
    stretch = words_of(text)[max(0, end - 2 * len(item)) : end]
    return search_distance(numbers(item), numbers(stretch))[0] <= allowed(len(item), similarity)


def _find(index: Index, similarity: float):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        for batch in batches:
            ids = batch["doc_id"].tolist()
            for low, rows in _blocks(index, batch["text"].tolist(), known, similarity):
                if rows:
                    out = pd.DataFrame(rows, columns=["n", *[c.split()[0] for c in MATCH.split(", ")][1:]])
                    out.insert(0, "doc_id", [ids[low + n] for n in out.pop("n")])
                    yield out

    return find


def _matches(index: Index, held: list[np.ndarray], similarity: float) -> list[tuple]:
    pad = np.zeros(PAD, dtype=np.uint32)
    tokens = np.concatenate([x for h in held for x in (h, pad)])
    sizes = np.array([len(h) for h in held])
    begins = np.cumsum(sizes + PAD) - sizes - PAD
    best: dict[tuple[int, int], tuple[int, int]] = {}
    lengths = np.array([len(w) for w in index.words], dtype=np.int64)
    most = np.array([allowed(n, similarity) for n in lengths.tolist()], dtype=np.int64)
    found = index.candidates(tokens, begins, sizes)
    # Candidates a few words apart look at the same stretch: round down to a
    # step and widen by as much.
    steps = most[found[:, 1]] + 1
    found[:, 2] = found[:, 2] // steps * steps
    for doc, item, start in np.unique(found, axis=0).tolist():
        words = index.words[item]
        slack = step = int(most[item]) + 1
        low = max(0, start - slack)
        stretch = held[doc][low : start + step + len(words) + slack]
        # What is kept of the item lies in the stretch word for word.
        if np.isin(stretch, words).sum() < len(words) - most[item]:
            continue
        distance, end = search_distance(words.tolist(), stretch.tolist())
        if distance <= allowed(len(words), similarity):
            key = (doc, item)
            best[key] = min(best.get(key, (distance, low + end)), (distance, low + end))
    return [
        (doc, index.items[item][0], d, len(index.words[item]), 1 - d / len(index.words[item]), end)
        for (doc, item), (d, end) in sorted(best.items())
    ]


def _indexes(benchmark: DataFrame) -> Iterator[tuple[Index, DataFrame]]:
    """Indexes over the distinct item texts, in parts of about ``PART_WORDS``
    words (a word costs a bounded number of keys), each with its items."""
    items = benchmark.filter("text IS NOT NULL").select("item_id", F.xxhash64("text").alias("item_key"), "text")
    texts = items.select("item_key", "text").dropDuplicates(["item_key"])
    words = texts.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = max(1, -(-words // PART_WORDS))
    for part in range(parts):
        mine = texts if parts == 1 else texts.filter(F.pmod("item_key", F.lit(parts)) == part)
        yield Index([tuple(r) for r in mine.collect()]), items


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = LEAST_SIMILARITY) -> DataFrame:
    """One row per document (doc_id, text) and item (item_id, text) that it
    holds with at most ``1 - similarity`` of the item's words edited."""
    found = None
    for index, items in _indexes(benchmark):
        rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(_find(index, similarity), MATCH)
        rows = rows.join(items.select("item_key", "item_id"), "item_key")
        found = rows if found is None else found.unionByName(rows)
    return found.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "item_id", "edit_distance", "item_words", "similarity", "end_word"
    )


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = LEAST_SIMILARITY) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item: every row is
    judged by its own text, where it is."""
    left = docs
    for index, _ in _indexes(benchmark):
        left = left.filter(_free(index, similarity)("text"))
    return left


def _free(index: Index, similarity: float):
    """Whether a text holds none of the index's items."""

    def free(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _WordHashes()
        for texts in series:
            bad = np.zeros(len(texts), dtype=bool)
            for low, rows in _blocks(index, texts.tolist(), known, similarity):
                bad[[low + r[0] for r in rows]] = True
            yield pd.Series(~bad)

    return F.pandas_udf(free, "boolean")
