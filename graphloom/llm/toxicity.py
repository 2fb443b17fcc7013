"""Toxicity: noisy-channel restoration, then a classifier of restored text.

A character language model is counted over all documents (runs of four
symbols; the alphabet bounds its size).  Text that looks obfuscated becomes a
lattice: a sign or digit offers the letters it may stand for, or nothing; a
run of one letter may be one or two of it; a separator between letters that
stand apart may be dropped or be the end of a word.  Viterbi search finds the
path that the language model and the channel (a fixed log price for each
step) make likeliest, and the restored words take the place of what stood
there.  Tokens are decoded if they hold a letter and a sign that may stand
for one, or a letter three times in a row; runs of letters that stand apart are
decoded as a whole, which also finds where their words end.

A restored text is scored on the set of its words and their beginnings by
logistic regression over the features that the training labels single out.
It learns from a bounded sample of labelled rows (``SAMPLE_ROWS``); language,
source and ids are not features.

Defined results: null and empty texts get the score of a text without any
feature; rows without a label, or whose label is null, only get scored; a
document that has several labels counts with the largest, an id that several
rows share with its smallest text; repeated rows are scored as often as they
occur; null ids are not held out; with no labels, or of one class only, every
score is the share of positives (0 if there are none); an empty table gives no
rows; extra columns are ignored (kept by ``drop_toxic``), whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, materialize

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE_ROWS = 20_000
FEATURES = 4096
#: A feature needs this many positive texts and this share of them.
LEAST_POSITIVE = 4
LEAST_SHARE = 0.02
THRESHOLD = 0.7
ORDER = 4

#: What a sign in a word may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h", "€": "e",
}
SYMBOLS = 29  # boundary, a-z, a byte of another letter, anything else
SUBSTITUTED = math.log(0.05)
DROPPED = math.log(0.3)
#: A separator between letters that stand apart goes, or ends a word.
CLOSED, WORD_END = math.log(0.8), math.log(0.2)

_SYMBOL = np.full(256, 28, dtype=np.int64)
_SYMBOL[[9, 10, 11, 12, 13, 32]] = 0
for _c in range(26):
    _SYMBOL[97 + _c] = _SYMBOL[65 + _c] = 1 + _c
_SYMBOL[128:] = 27

_STRIP = ".,;:!?\"'()[]{}<>|_-=+#&%~`/\\"
_SIGN = re.compile(r"[\d@$!|+(<*#€]")
_LETTER = re.compile(r"[^\W\d_]")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
#: Three letters or more that stand apart, with signs for some of them.
_APART = re.compile(r"(?<![^\W_])[^\W_](?:[ \t.,\-_*~/']{1,3}(?:[^\W_]|[@$!|+€])){2,}(?![^\W_])")


# --- the language model ---------------------------------------------------


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(SYMBOLS**ORDER, dtype=np.int64)

    def add(chunk: bytes) -> None:
        s = _SYMBOL[np.frombuffer(b" " * (ORDER - 1) + chunk + b" ", dtype=np.uint8)]
        # A gram may reach back over a boundary only as boundaries.
        g = s[ORDER - 1 :].copy()
        cut = np.zeros(len(g), dtype=bool)
        for back in range(1, ORDER):
            t = s[ORDER - 1 - back : len(s) - back]
            cut |= t == 0
            g += np.where(cut, 0, t) * SYMBOLS**back
        total.__iadd__(np.bincount(g, minlength=len(total)))

    held: list[bytes] = []
    size = 0
    for batch in batches:
        for text in batch["text"]:
            if text:
                held.append(text.encode())
                size += len(held[-1])
                if size > 4 << 20:
                    add(b" ".join(held))
                    held, size = [], 0
    if held:
        add(b" ".join(held))
    kept = np.flatnonzero(total)
    yield pd.DataFrame({"gram": kept, "n": total[kept]})


def character_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all symbol runs over all documents; its size is fixed by
    the alphabet (SYMBOLS ** ORDER), whatever the input."""
    rows = docs.select("text").mapInPandas(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = rows.toArrow()
    counts = np.zeros(SYMBOLS**ORDER, dtype=np.float64)
    counts[found["gram"].to_numpy()] = found["n"].to_numpy()
    return counts


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | three before), each order backed by the next lower one
    (Witten-Bell), as float32 over all runs."""
    shape = (SYMBOLS,) * ORDER
    full = counts.reshape(shape)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        c = full.sum(axis=tuple(range(ORDER - order)))
        n = c.sum(axis=-1, keepdims=True)
        kinds = (c > 0).sum(axis=-1, keepdims=True)
        p = (c + kinds * p) / np.maximum(n + kinds, 1) if order > 1 else (c + kinds * p) / max(1, (n + kinds).item())
        p = np.where(n + kinds > 0, p, 1 / SYMBOLS)
    return np.log(np.maximum(p, 1e-9)).astype(np.float32).ravel()


def _symbol(ch: str) -> int:
    if "a" <= ch <= "z":
        return ord(ch) - 96
    return 27 if ord(ch) > 127 and ch.isalpha() else 28


def lattice(token: str, apart: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of equal characters, what it may stand for, with the
    channel's log price.  ``apart``: the letters stand apart, what is between
    them goes or ends a word."""
    out = []
    for m in re.finditer(r"[ \t.,\-_*~/']+|." if apart else r"(.)\1*", token, re.S):
        piece = m.group(0)
        ch, n = piece[0], len(piece)
        if apart and ch in " \t.,-_*~/'":
            out.append([("", CLOSED), (" ", WORD_END)])
            continue
        letters = [ch] if ch.isalpha() else list(LEET.get(ch, ""))
        price = 0.0 if ch.isalpha() else SUBSTITUTED
        choices = []
        for letter in letters:
            choices.append((letter, price if n != 2 else price + SUBSTITUTED))
            if n >= 2:
                choices.append((letter * 2, price if n == 2 else price + DROPPED))
        if not ch.isalpha():
            choices.append(("", DROPPED + SUBSTITUTED))
        out.append(choices)
    return out


def decode(token: str, logp: list[float], apart: bool = False) -> str:
    """The likeliest words behind ``token`` (Viterbi over its lattice).
    States are the last symbols read; a word's end forgets them."""
    keep = SYMBOLS ** (ORDER - 2)
    states: dict[int, tuple[float, str]] = {0: (0.0, "")}
    for choices in lattice(token, apart):
        grown: dict[int, tuple[float, str]] = {}
        for context, (score, word) in states.items():
            for letters, price in choices:
                s, c = score + price, context
                for ch in letters:
                    sym = 0 if ch == " " else _symbol(ch)
                    s += logp[c * SYMBOLS + sym]
                    c = c % keep * SYMBOLS + sym if sym else 0
                if c not in grown or s > grown[c][0]:
                    grown[c] = (s, word + letters)
        states = grown
    return max((score + logp[c * SYMBOLS], word) for c, (score, word) in states.items())[1]


# --- words and features ---------------------------------------------------


class Restorer:
    """The words of texts, with obfuscated ones restored."""

    def __init__(self, logp: np.ndarray) -> None:
        self.logp = logp.tolist()
        self.known: dict[str, str] = {}

    def of_token(self, token: str) -> str:
        """The word behind a lower-case token; empty if it has none."""
        if token.isalpha() and not _REPEATED.search(token):
            return token
        found = self.known.get(token)
        if found is None:
            found = token.strip(_STRIP)
            if found and _LETTER.search(found) and (_SIGN.search(found) or _REPEATED.search(found)):
                found = decode(found, self.logp) or found
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[token] = found
        return found

    def _closed(self, m: re.Match) -> str:
        run = m.group(0)
        letters = len(_LETTER.findall(run))
        if letters < 3 or letters * 2 < sum(c not in " \t.,-_*~/'" for c in run):
            return run
        return f" {decode(run, self.logp, apart=True)} "

    def joined(self, text: str | None) -> str:
        """The text in lower case, letters that stand apart joined to words."""
        return _APART.sub(self._closed, (text or "").lower())

    def words(self, text: str | None) -> set[str]:
        return {w for w in map(self.of_token, set(self.joined(text).split())) if w}


def restored_text(text: str | None, logp: np.ndarray) -> str:
    """``text`` in lower case with obfuscated parts replaced."""
    restorer = Restorer(logp)
    return re.sub(r"\S+", lambda m: restorer.of_token(m.group(0)) or m.group(0), restorer.joined(text))


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}~" for k in (4, 5, 6) if len(word) > k)]


def _text_features(restorer: Restorer, text: str | None) -> set[str]:
    return {f for w in restorer.words(text) for f in features_of(w)}


# --- the classifier -------------------------------------------------------


def _fit(rows: list[np.ndarray], labels: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sets of feature numbers,
    from the weights ``first`` on: what the sample leaves open (which of the
    words that come together counts) stays as each word's own log odds say."""
    size = len(first)
    index = np.concatenate(rows) if rows else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = first.copy(), math.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    # Adagrad on the full sample: a fixed number of steps, no randomness.
    gw2, gb2 = np.full(size, 1e-6), 1e-6
    for _ in range(800):
        z = b + np.bincount(row, weights=w[index], minlength=len(rows))
        err = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels
        gw = np.bincount(index, weights=err[row], minlength=size) / len(rows) + 2e-6 * w
        gb = err.mean()
        gw2 += gw * gw
        gb2 += gb * gb
        w -= 1.0 * gw / np.sqrt(gw2)
        b -= 0.3 * gb / math.sqrt(gb2)
    return w, b


def train(docs: DataFrame, labels: DataFrame, logp: np.ndarray, sample_rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], float]:
    """Feature weights and bias from the labelled rows that are not held out."""
    sample = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id", 3))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    # At most sample_rows short rows: bounded, whatever the input.
    rows = materialize(
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"),
        "toxic-sample",
    )
    whole = rows.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    size, positive = whole[0], whole[1] or 0
    if positive in (0, size):
        return {}, 30.0 if size and positive == size else -30.0

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, seen = Restorer(logp), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                seen[int(toxic == 1)].update(_text_features(restorer, text))
        names = [f for f in seen[1]]
        names += [f for f in seen[0] if f not in seen[1]]
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pd.DataFrame({"feature": part, "pos": [seen[1][f] for f in part], "neg": [seen[0][f] for f in part]})

    counts = rows.mapInPandas(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (positive + 1)) - F.log((F.col("neg") + 0.5) / (size - positive + 1))
    # At most FEATURES rows reach the driver.
    chosen = (
        counts.filter((F.col("pos") >= LEAST_POSITIVE) & (F.col("pos") >= LEAST_SHARE * positive))
        .withColumn("odds", odds)
        .filter(F.col("odds") > math.log(8))
        .orderBy(F.desc(F.col("pos") * F.col("odds")), "feature")
        .limit(FEATURES)
        .toArrow()
    )
    names, first = chosen["feature"].to_pylist(), chosen["odds"].to_numpy().astype(np.float64)
    number = {f: i for i, f in enumerate(names)}

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(logp)
        for batch in batches:
            found = [
                np.array(sorted(number[f] for f in _text_features(restorer, t) if f in number), dtype=np.int32).tobytes()
                for t in batch["text"]
            ]
            yield pd.DataFrame({"toxic": (batch["toxic"] == 1).astype("int32"), "found": found})

    table = rows.mapInPandas(numbered, "toxic int, found binary").toArrow()
    lists = [np.frombuffer(x, dtype=np.int32) for x in table["found"].to_pylist()]
    w, b = _fit(lists, table["toxic"].to_numpy().astype(np.float64), first)
    return dict(zip(names, w.tolist())), float(b)


def scorer(weights: dict[str, float], bias: float, logp: np.ndarray):
    """A column function from texts to scores; rows stay where they are."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(logp)
        by_token: dict[str, tuple[str, ...]] = {}
        # Every feature of a word begins as the word does.
        heads = {f[:4] for f in weights}
        for texts in batches:
            out = []
            for text in texts:
                found: set[str] = set()
                for token in set(restorer.joined(text).split()):
                    hits = by_token.get(token)
                    if hits is None:
                        words = restorer.of_token(token).split()
                        hits = tuple(f for w in words if w[:4] in heads for f in features_of(w) if f in weights)
                        if len(by_token) > 150_000:
                            by_token.clear()
                        by_token[token] = hits
                    if hits:
                        found.update(hits)
                z = bias + sum(weights[f] for f in sorted(found))
                out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, z)))))
            yield pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")


def fitted(docs: DataFrame, labels: DataFrame):
    """The scorer of a model of ``docs`` (doc_id, text) and ``labels``."""
    logp = language_model(character_counts(docs))
    return scorer(*train(docs, labels, logp), logp)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    return docs.filter(fitted(docs, labels)("text") < threshold)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    scored = docs.select("doc_id", is_held_out("doc_id", 3).alias("held_out"), fitted(docs, labels)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
