"""Hierarchical Pitman-Yor bigram model, sampled in parallel by Gibbs.

Every word that occurs before another is a context with a restaurant of its
own; its customers are the words that follow.  All contexts share one parent
restaurant, whose customers are the tables of the contexts, over a uniform
base.  Seating is sampled by Gibbs: all customers of one dish leave a
restaurant and are seated again one after another, with a Metropolis step
because their joint draw is only nearly the conditional; the dishes of a sweep
are drawn at once against the totals of the sweep before.  A sweep seats the
contexts under the shared parent, then the parent under the tables that they
opened; the predictive probability is averaged over the sweeps after the
first ones.  Discounts follow from the counts of ones and twos, and a level's
strength is the likeliest of a grid given its first seating.

What Spark exchanges:

* A chunk (some megabytes of an input partition) is read once and kept as
  numbers into its own vocabulary.
* A word has a home and a pair of words an owner, by hash.  Pairs go by their
  context, but those of a frequent context (more than a fourth of an owner's
  share of all tokens) are dealt by both words; homes add up the tables of
  such a context.  So owners hold level shares however the words are spread.
* Chunks ask once for each distinct word and pair, in one packed message for
  each home or owner that has any (as a shuffle has one block); owners ask
  homes only for words of dishes with two customers or more, as a single
  customer always has a table of its own.
* Only totals (a row of sums a sweep) reach the driver.

Defined results: a null text is empty, it consists of its end alone; null
ids hash as the empty string and count as separate rows; repeated rows count
and are scored as often as they occur; a table without training rows gives
every text a uniform share; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import by_owner, packed, packed_rising, unpacked, unpacked_rising
from .common import bounded_batches, bucket_count, bucketed, drop_table, materialize

FOLDS = 5
HELD = 1
#: Sweeps that are left out, and sweeps that are averaged.
BURN_IN = 2
SWEEPS = 3
STRENGTHS = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0)
#: Beyond so many customers, the wait for the next table is drawn from its
#: power-law limit in one step.
ONE_BY_ONE = 256
#: Customers of a dish up to which its tables are drawn exactly.
EXACT = 16
#: Bytes of text in a chunk, and of input for each owner.
CHUNK_BYTES = 8 << 20
OWNER_BYTES = 6 << 20
END = np.uint64(0)


# --- seating ----------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - np.log(shift)


def discount_of(ones: float, twos: float) -> float:
    return min(0.98, max(0.02, ones / (ones + 2 * twos))) if ones + twos > 0 else 0.5


def fits(customers: np.ndarray, tables: np.ndarray, discount: float) -> list[float]:
    """The log likelihood of restaurants with these totals for each of ``STRENGTHS``."""
    out = []
    for s in STRENGTHS:
        opened = log_gamma(s / discount + tables) - log_gamma(np.full(1, s / discount))
        seated = log_gamma(s + customers) - log_gamma(np.full(1, s))
        out.append(float((tables * np.log(discount) + opened - seated).sum()))
    return out


def likeliest(sums: list[float]) -> float:
    return max(zip(sums, STRENGTHS), key=lambda x: x[0])[1]


def seat(c, p, elsewhere, strength, discount, rng) -> tuple[np.ndarray, np.ndarray]:
    """Seat ``c`` customers of each dish one after another in a restaurant
    with ``elsewhere`` tables of other dishes; ``p`` is the parent's
    probability of the dish.  Returns tables and the draw's log weight.

    ``c`` must fall."""
    n = len(c)
    tables = np.ones(n)
    weight = np.zeros(n)
    most = int(c[0]) if n else 0
    rising = -c
    for i in range(1, min(most, ONE_BY_ONE)):
        k = int(np.searchsorted(rising, -i, side="left"))  # dishes with more than i customers
        t = tables[:k]
        new = (strength + discount * (elsewhere[:k] + t)) * p[:k]
        total = new + i - discount * t
        weight[:k] += np.log(total)
        t += rng.random(k) * total < new
    live = np.flatnonzero(c > ONE_BY_ONE)
    at = np.full(len(live), float(ONE_BY_ONE))
    while len(live):
        t = tables[live]
        new = (strength + discount * (elsewhere[live] + t)) * p[live]
        base = at - discount * t
        jump = base * np.exp(np.minimum(-np.log(rng.random(len(live))) / np.maximum(new, 1e-12), 40))
        stop = np.maximum(at + 1, np.ceil(discount * t + jump))
        end = np.minimum(stop, c[live])
        weight[live] += log_gamma(end - discount * t + new) - log_gamma(at - discount * t + new)
        tables[live] += stop < c[live]
        keep = stop < c[live]
        live, at = live[keep], stop[keep]
    return tables, weight


def _log_stirling(most: int, discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) for c, t up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(1, most + 1):
        t = np.arange(1, c + 1)
        with np.errstate(divide="ignore"):
            stay = out[c - 1, 1 : c + 1] + np.log(np.maximum(c - 1 - discount * t, 0))
        out[c, 1 : c + 1] = np.logaddexp(out[c - 1, :c], stay)
    return out


def draw_exactly(c: int, p, elsewhere, strength, discount, stirling, rng) -> np.ndarray:
    """Tables of dishes with ``c`` customers each, from their exact distribution."""
    t = np.arange(1, c + 1)
    opened = np.log(strength + discount * (elsewhere[:, None] + t - 1))
    weight = np.cumsum(opened, axis=1) + t * np.log(np.maximum(p, 1e-300))[:, None] + stirling[c, 1 : c + 1]
    share = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
    return 1 + (rng.random(len(p))[:, None] * share[:, -1:] > share).sum(axis=1)


def resample(count, tables, weight, p, elsewhere, strength, discount, rng) -> tuple[np.ndarray, np.ndarray]:
    """One Gibbs sweep over dishes with ``count`` customers each (two or
    more): new (tables, log weights).  Up to ``EXACT`` customers tables are
    drawn from their exact distribution; beyond, as one block by the seating
    rule with a Metropolis step, and ``weight`` is that of the last draw (NaN:
    none, the draw is taken)."""
    order = np.argsort(-count, kind="stable")
    falling = count[order]
    out, kept = tables.copy(), np.full(len(count), np.nan, dtype=np.float32)
    big = order[: int(np.searchsorted(-falling, -EXACT, side="left"))]
    if len(big):
        new, drawn = seat(count[big].astype(np.float64), p[big], elsewhere[big], strength, discount, rng)
        taken = np.isnan(weight[big]) | (np.log(rng.random(len(big))) < drawn - weight[big])
        out[big] = np.where(taken, new, tables[big])
        kept[big] = np.where(taken, drawn, weight[big])
    stirling = _log_stirling(EXACT, discount)
    for c in range(2, EXACT + 1):
        low, high = np.searchsorted(-falling, [-c, -c + 1], side="left")
        for at in range(low, high, 1 << 16):
            same = order[at : min(high, at + (1 << 16))]
            out[same] = draw_exactly(c, p[same], elsewhere[same], strength, discount, stirling, rng)
    return out, kept


# --- chunks ---------------------------------------------------------------------


_RNG = np.random.default_rng(20)
_LETTER = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95)
_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BLANK = re.compile(rb"[\x09-\x0d\x20]")
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = np.multiply.accumulate(np.append(np.uint64(1), np.full(max(n, 1 << 20), base, np.uint64)))
    return _POWERS[base][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _slice_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], _GAP[b], [True]])
    begins, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    out = (ends - begins).astype(np.uint64)
    for letters, step in zip(_LETTER, _STEP):
        sums = np.append(np.uint64(0), np.cumsum(letters[b] * _powers(step, len(b))))
        back = _powers(pow(step, -1, 1 << 64), len(b) + 1)[begins]
        out = _mixed(out ^ (sums[ends] - sums[begins]) * back)
    out[out == END] = 1
    return begins, out


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of each word: two polynomials over random
    letters, by prefix sums, a megabyte at a time."""
    parts, at = [(np.empty(0, np.int64), np.empty(0, np.uint64))], 0
    while at < len(data):
        blank = _BLANK.search(data, at + (1 << 20))
        stop = blank.end() if blank else len(data)
        begins, hashes = _slice_hashes(data[at:stop])
        parts.append((begins + at, hashes))
        at = stop
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def is_held(doc_id: str | None) -> bool:
    return zlib.crc32((doc_id or "").encode()) % FOLDS == HELD


CHUNK = "chunk long, ids binary, sizes binary, words binary, token binary"


def chunk_row(number: int, ids: list[str | None], texts: list[bytes]) -> tuple:
    """Documents as numbers into the chunk's own vocabulary; each ends with END."""
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    begins, hashes = word_hashes(b" ".join(texts))
    counts = np.bincount(np.searchsorted(offsets, begins, side="right") - 1, minlength=len(texts))
    sizes = counts[: len(texts)] + 1
    tokens = np.full(len(hashes) + len(texts), END, dtype=np.uint64)
    last = np.zeros(len(tokens), dtype=bool)
    last[np.cumsum(sizes) - 1] = True
    tokens[~last] = hashes
    words, token = np.unique(tokens, return_inverse=True)
    names = zlib.compress(json.dumps(ids).encode(), 1)
    return number, names, packed(sizes.astype(np.int32)), packed_rising(words), packed(token.astype(np.uint32))


def _chunks(chunk_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        names = [c.split()[0] for c in CHUNK.split(", ")]
        for batch in batches:
            for i, t in zip(batch["id"], batch["text"]):
                ids.append(i if isinstance(i, str) else None)
                texts.append(t.encode().lower() if isinstance(t, str) else b"")
                size += len(texts[-1]) + 64
                if size >= chunk_bytes:
                    yield pd.DataFrame([chunk_row(number, ids, texts)], columns=names)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield pd.DataFrame([chunk_row(number, ids, texts)], columns=names)

    return run


class Chunk:
    """A chunk's numbers: words by hash, tokens as numbers of words, and the
    distinct pairs (context, next) with the pair of each token."""

    def __init__(self, row) -> None:
        self.ids = json.loads(zlib.decompress(row.ids))
        self.sizes = unpacked(row.sizes, np.int32).astype(np.int64)
        self.words = unpacked_rising(row.words)
        self.token = unpacked(row.token, np.uint32)
        self.held = np.array([is_held(i) for i in self.ids], dtype=bool)
        self.train = np.repeat(~self.held, self.sizes)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.token, weights=self.train, minlength=len(self.words)).astype(np.int64)

    def find_pairs(self) -> None:
        # The end of a text is the context of the first word of the next.
        before = np.roll(self.token, 1)
        pair = before.astype(np.uint64) << np.uint64(32) | self.token
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        self.context = (self.pairs >> np.uint64(32)).astype(np.int64)
        self.next = (self.pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair, weights=self.train, minlength=len(self.pairs)).astype(np.int64)

    def pairs_by_owner(self, owners: int, frequent: np.ndarray):
        """(owner, contexts, pairs a context has, places of the pairs), the
        pairs in order; ``frequent`` tells which words are split as contexts."""
        h = self.words[self.context]
        both = _mixed(h + _mixed(self.words[self.next]))
        owner = (np.where(frequent[self.context], both, _mixed(h)) % np.uint64(owners)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[order], np.arange(owners + 1))
        for o in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            places = order[edges[o] : edges[o + 1]]
            contexts, sizes = np.unique(self.context[places], return_counts=True)
            yield o, contexts, sizes, places


# --- words and their homes ----------------------------------------------------------


ASK_WORDS = "home int, chunk long, words binary, counts binary"
TELL_IDS = "chunk long, home int, ids binary, counts binary, tokens long, distinct long"


def _ask_words(homes: int):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                chunk = Chunk(row)
                counts = chunk.word_counts().astype(np.int32)
                rows = [(o, row.chunk, packed_rising(chunk.words[part]), packed(counts[part])) for o, part in by_owner(chunk.words, homes)]
                yield pd.DataFrame(rows, columns=["home", "chunk", "words", "counts"])

    return ask


class Home:
    """A home's words in order of their training counts (the rank), from what
    the chunks ask; ``places``: the ranks that each asked for."""

    def __init__(self, frame: pd.DataFrame) -> None:
        asked = [unpacked_rising(b) for b in frame["words"]]
        words, index = np.unique(np.concatenate(asked), return_inverse=True)
        weights = np.concatenate([unpacked(b, np.int32) for b in frame["counts"]])
        counts = np.bincount(index, weights=weights, minlength=len(words)).astype(np.int64)
        order = np.lexsort((words, -counts))
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        self.counts = counts[order]
        self.places = np.split(rank[index], np.cumsum([len(a) for a in asked])[:-1])


def _narrow(ids: np.ndarray) -> bytes:
    return packed(ids.astype(np.uint32 if ids.max(initial=0) < 1 << 32 else np.uint64))


def _wide(raw: bytes, count: int) -> np.ndarray:
    a = unpacked(raw, np.uint8)
    return a.view(np.uint32 if len(a) == 4 * count else np.uint64).astype(np.int64)


def _tell_ids(homes: int):
    def tell(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        home = Home(frame)
        first = np.arange(len(frame)) == 0
        return pd.DataFrame(
            {
                "chunk": frame["chunk"], "home": frame["home"],
                "ids": [_narrow(r * homes + key[0]) for r in home.places],
                "counts": [_narrow(home.counts[r]) for r in home.places],
                "tokens": np.where(first, home.counts.sum(), 0), "distinct": np.where(first, (home.counts > 0).sum(), 0),
            }
        )

    return tell


def _told(chunk: Chunk, homes: int, rows: pd.DataFrame, columns: list[str], read) -> list[np.ndarray]:
    """What homes told a chunk about its words, one array a column."""
    rows = rows.set_index("home")
    out = [np.zeros(len(chunk.words), dtype=np.int64 if c in ("ids", "counts") else np.float64) for c in columns]
    for o, part in by_owner(chunk.words, homes):
        for a, c in zip(out, columns):
            a[part] = read(rows.at[o, c], len(part))
    return out


# --- pairs and their owners ---------------------------------------------------------


ASK_PAIRS = "owner int, chunk long, contexts binary, sizes binary, split binary, ids binary, counts binary"


def _ask_pairs(owners: int, most: float):
    def ask(key: tuple, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in frame.itertuples():
            chunk = Chunk(row)
            chunk.find_pairs()
            ids, seen = _told(chunk, owners, told, ["ids", "counts"], _wide)
            counts = chunk.pair_counts().astype(np.int32)
            for o, contexts, sizes, pairs in chunk.pairs_by_owner(owners, seen > most):
                rows.append((o, key[0], _narrow(ids[contexts]), packed(sizes.astype(np.int32)), packed(seen[contexts] > most),
                             _narrow(ids[chunk.next[pairs]]), packed(counts[pairs])))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ASK_PAIRS.split(", ")])

    return ask


class Gathered:
    """An owner's distinct pairs in order (context, word), from what chunks
    ask, and which of them each asked for."""

    def __init__(self, frame: pd.DataFrame) -> None:
        sizes = [unpacked(b, np.int32) for b in frame["sizes"]]
        self.pairs_asked = [int(s.sum()) for s in sizes]
        self.contexts_asked = [len(s) for s in sizes]
        contexts = np.concatenate([_wide(b, n) for b, n in zip(frame["contexts"], self.contexts_asked)])
        split = np.concatenate([unpacked(b, bool) for b in frame["split"]])
        ids = np.concatenate([_wide(b, n) for b, n in zip(frame["ids"], self.pairs_asked)])
        counts = np.concatenate([unpacked(b, np.int32) for b in frame["counts"]])
        #: Contexts by id, and those whose pairs other owners share.
        self.names, first, self.context_index = np.unique(contexts, return_index=True, return_inverse=True)
        self.split = split[first]
        row = np.repeat(self.context_index, np.concatenate(sizes))
        width = int(ids.max(initial=0)) + 1
        if len(self.names) * width < 1 << 62:
            key = row * width + ids
            order = np.argsort(key, kind="stable")
            fresh = np.diff(key[order], prepend=-1) > 0
        else:
            order = np.lexsort((ids, row))
            fresh = (np.diff(row[order], prepend=-1) != 0) | (np.diff(ids[order], prepend=-1) != 0)
        begin = np.flatnonzero(fresh)
        self.index = np.empty(len(order), dtype=np.int64)
        self.index[order] = np.cumsum(fresh) - 1
        self.count = np.add.reduceat(counts[order].astype(np.int64), begin) if len(begin) else np.empty(0, np.int64)
        self.row, self.word = row[order][begin], ids[order][begin]

    def several(self) -> np.ndarray:
        """Dishes with two customers or more."""
        return np.flatnonzero(self.count > 1)


#: One row an owner or home with its state (packed arrays by name), or a
#: message from one to the other; sums are of what all of them have.
TABLE = "kind string, at int, source int, arrays binary, sums array<double>"


def _small(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type."""
    if a.dtype.kind not in "iu" or not len(a):
        return a
    for kind in (np.uint8, np.uint16, np.uint32):
        if a.min() >= 0 and a.max() <= np.iinfo(kind).max:
            return a.astype(kind)
    return a


def _arrays(**named: np.ndarray) -> bytes:
    """Arrays in one packed value; whole numbers come back as int64."""
    parts = [(k, _small(a), a.dtype.kind in "iu") for k, a in named.items()]
    line = json.dumps([(k, a.dtype.str, len(a), whole) for k, a, whole in parts]).encode() + b"\n"
    return packed(np.frombuffer(line + b"".join(np.ascontiguousarray(a).tobytes() for _, a, _ in parts), np.uint8))


def _named(raw: bytes) -> dict[str, np.ndarray]:
    data = unpacked(raw, np.uint8).tobytes()
    line = data.index(b"\n")
    out, at = {}, line + 1
    for k, kind, n, whole in json.loads(data[:line]):
        size = np.dtype(kind).itemsize * n
        a = np.frombuffer(data[at : at + size], kind)
        out[k] = a.astype(np.int64) if whole else a.copy()
        at += size
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "at", "source", "arrays", "sums"])


def _first_state(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """An owner's state before any seating: every dish has one table."""
    g = Gathered(frame)
    several = g.several()
    seated = g.count > 0
    whole = lambda weights: np.bincount(g.row, weights=weights, minlength=len(g.names)).astype(np.int64)
    words, counts = np.unique(g.word[g.count == 1], return_counts=True)
    state = _arrays(
        names=np.diff(g.names, prepend=0), split=g.split, customers=whole(g.count), tables=whole(seated),
        step=np.diff(g.row[several], prepend=0), word=g.word[several], count=g.count[several],
        seated=np.ones(len(several), np.int64), weight=np.full(len(several), np.nan, np.float32), single=words, alone=counts,
    )
    return _frame([("state", key[0], key[0], state, [float((g.count == 1).sum()), float((g.count == 2).sum())])])


def _state(raw: bytes) -> dict[str, np.ndarray]:
    s = _named(raw)
    s["names"], s["row"] = np.cumsum(s["names"]), np.cumsum(s.pop("step"))
    return s


def _stored(s: dict) -> bytes:
    s = {k: a for k, a in s.items() if k not in ("total", "whole")}
    s["names"], s["step"] = np.diff(s["names"], prepend=0), np.diff(s.pop("row"), prepend=0)
    return _arrays(**s)


def _words_of(word: np.ndarray, weights: np.ndarray, homes: int):
    """(home, words, summed weights) of each home that has any."""
    words, index = np.unique(word, return_inverse=True)
    sums = np.bincount(index, weights=weights, minlength=len(words)).astype(np.int64)
    home = words % homes
    order = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[order], np.arange(homes + 1))
    for h in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        mine = order[edges[h] : edges[h + 1]]
        yield h, words[mine], sums[mine]


def _asks(key: int, s: dict, homes: int) -> list[tuple]:
    """Messages of an owner to homes: tables of its words, and its part of
    split contexts."""
    rows = {h: {"word": np.diff(w // homes, prepend=0), "tables": t} for h, w, t in _words_of(s["word"], s["seated"], homes)}
    for h, w, t in _words_of(s["single"], s["alone"], homes) if "single" in s else ():
        rows.setdefault(h, {}).update(single=np.diff(w // homes, prepend=0), alone=t)
    parts = np.flatnonzero(s["split"])
    for h in np.unique(s["names"][parts] % homes).tolist():
        mine = parts[s["names"][parts] % homes == h]
        rows.setdefault(h, {}).update(context=s["names"][mine], part=np.stack([s["tables"][mine], s["customers"][mine]], axis=1).ravel())
    return [("ask", h, key, _arrays(**a), None) for h, a in sorted(rows.items())]


class Level:
    """What a sweep knows of the whole: scalars only."""

    def __init__(self, discount: float, strength: float, base: float, opened: float = 0.0, customers: float = 0.0) -> None:
        self.discount, self.strength, self.base = discount, strength, base
        self.opened, self.customers = opened, customers

    def parent(self, customers: np.ndarray, seated: np.ndarray) -> np.ndarray:
        """The parent's probability of words with so many customers and tables."""
        inside = customers - self.discount * seated
        return (inside + (self.strength + self.discount * self.opened) * self.base) / (self.strength + self.customers)


def _owner_step(number: int, level: Level | None, discount: float, strength: float, homes: int, kept: bool):
    """Take the homes' answers, keep the last sweep's totals if ``kept``, seat
    again, and ask anew.  Without ``level``: the first asks."""

    def step(key: tuple, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for raw in frame["arrays"]:
            s = _state(raw)
            sums = [0.0] * len(STRENGTHS)
            if level is None:
                whole = ~s["split"] & (s["customers"] > 0)
                sums = fits(s["customers"][whole].astype(np.float64), s["tables"][whole].astype(np.float64), discount)
                rows += _asks(key[0], s, homes)
                s.pop("single"), s.pop("alone")
            else:
                p = _answers(s, told, homes, level)
                if kept:
                    _keep(s)
                before = s["seated"]
                rng = np.random.default_rng([number, key[0]])
                elsewhere = np.maximum(s["total"][s["row"]] - before, 0)
                s["seated"], s["weight"] = resample(s["count"], before, s["weight"], p, elsewhere, strength, discount, rng)
                more = np.bincount(s["row"], weights=s["seated"] - before, minlength=len(s["names"])).astype(np.int64)
                s["tables"] = s["tables"] + more
                rows += _asks(key[0], s, homes)
            rows.append(("state", key[0], key[0], _stored(s), sums))
        return _frame(rows)

    return step


def _answers(s: dict, told: pd.DataFrame, homes: int, level: Level) -> np.ndarray:
    """The parent's probability of each dish; sets the whole restaurants'
    totals for split contexts."""
    words = np.unique(s["word"])
    customers, seated = np.zeros(len(words)), np.zeros(len(words))
    s["total"], s["whole"] = s["tables"].copy(), s["customers"].copy()
    for source, raw in zip(told["source"], told["arrays"]):
        a = _named(raw)
        if "count" in a:
            mine = words % homes == source
            customers[mine], seated[mine] = a["count"], a["seated"]
        if "context" in a:
            at = np.searchsorted(s["names"], a["context"])
            s["total"][at], s["whole"][at] = a["part"].reshape(-1, 2).T
    return level.parent(customers, seated)[np.searchsorted(words, s["word"])]


def _keep(s: dict) -> None:
    """Add this seating to what the predictive probability is averaged from:
    the tables of each dish, summed, and of each restaurant, sweep by sweep."""
    s["sum"] = s.get("sum", 0) + s["seated"]
    s["totals"] = np.concatenate([s.get("totals", np.empty(0, np.int64)), s["total"]])


def _home_step(number: int, level: Level, first: bool, kept: bool, homes: int):
    """Add up the tables that owners ask with, seat the parent again, answer."""

    def step(key: tuple, frame: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        asks = [(int(r.source), _named(r.arrays)) for r in frame.itertuples()]
        for _, a in asks:
            a |= {k: np.cumsum(a[k]) for k in ("word", "single") if k in a}
        if first:
            most = max((int(a[k][-1]) + 1 for _, a in asks for k in ("word", "single") if k in a), default=0)
            s = {"alone": np.zeros(most, np.int64)}
            for _, a in asks:
                if "single" in a:
                    s["alone"][a["single"]] += a["alone"]
        else:
            s = {k: a for raw in old["arrays"] for k, a in _named(raw).items()}
        customers = s["alone"].copy()
        for _, a in asks:
            if "word" in a:
                customers[a["word"]] += a["tables"]
        seated = np.minimum(customers, 1)
        weight = np.full(len(customers), np.nan, dtype=np.float32)
        if not first:
            at = np.flatnonzero(customers > 1)
            before = np.minimum(s["seated"][at], customers[at])
            same = np.where(s["count"][at] == customers[at], s["weight"][at], np.nan)
            rng = np.random.default_rng([7919 + number, key[0]])
            elsewhere = np.maximum(level.opened - before, 0)
            p = np.full(len(at), level.base)
            seated[at], weight[at] = resample(customers[at], before, same, p, elsewhere, level.strength, level.discount, rng)
        s.update(seated=seated, weight=weight, count=customers)
        if kept:
            s["kept"] = np.concatenate([s.get("kept", np.empty(0, np.int64)), customers, seated])
        # Restaurants that several owners share: tables and customers of all parts.
        parts: dict[int, np.ndarray] = {}
        for _, a in asks:
            for c, part in zip(a.get("context", ()), a["part"].reshape(-1, 2) if "part" in a else ()):
                parts[int(c)] = parts.get(int(c), 0) + part
        sums = [customers.sum(), seated.sum(), (customers == 1).sum(), (customers == 2).sum()]
        rows = [("state", key[0], key[0], _arrays(**s), [float(x) for x in sums])]
        for source, a in asks:
            out = {}
            if "word" in a:
                # Before the parent is first seated, a word's customers are its share.
                out |= {"count": customers[a["word"]], "seated": seated[a["word"]] * (not first)}
            if "context" in a:
                out |= {"context": a["context"], "part": np.concatenate([parts[int(c)] for c in a["context"]])}
            rows.append(("tell", source, key[0], _arrays(**out), None))
        return _frame(rows)

    return step


# --- answers and scores -------------------------------------------------------------


TELL = "chunk long, kind string, home int, a binary, b binary"


def _tell_pairs(level: Level, homes: int):
    def tell(key: tuple, frame: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["chunk", "kind", "home", "a", "b"])
        g = Gathered(frame)
        s = next(_state(raw) for raw in table.loc[table["kind"] == "state", "arrays"])
        _answers(s, table[table["kind"] == "tell"], homes, level)
        _keep(s)
        tables = np.zeros(len(g.count), dtype=np.int64)
        tables[g.several()] = s["sum"]
        totals = np.concatenate([s["whole"], s["totals"]]).reshape(-1, len(g.names))
        cut = np.cumsum(g.pairs_asked)[:-1]
        a = zip(np.split(g.count[g.index], cut), np.split(tables[g.index], cut))
        b = np.split(totals[:, g.context_index], np.cumsum(g.contexts_asked)[:-1], axis=1)
        return pd.DataFrame(
            {"chunk": frame["chunk"].to_numpy(), "kind": "pairs", "home": key[0],
             "a": [_arrays(count=c, tables=t) for c, t in a], "b": [_arrays(totals=x.ravel()) for x in b]}
        )

    return tell


def _tell_words(sweeps: int):
    def tell(key: tuple, frame: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["chunk", "kind", "home", "a", "b"])
        home = Home(frame)
        kept = np.zeros((2 * sweeps, len(home.counts)), dtype=np.int64)
        for raw in table.loc[table["kind"] == "state", "arrays"]:
            known = _named(raw)["kept"].reshape(2 * sweeps, -1)
            kept[:, : known.shape[1]] = known
        return pd.DataFrame(
            {"chunk": frame["chunk"].to_numpy(), "kind": "words", "home": key[0],
             "a": [_arrays(kept=kept[:, r].ravel()) for r in home.places], "b": [_narrow(home.counts[r]) for r in home.places]}
        )

    return tell


SCORES = (
    "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
    "score double"
)


def _score(owners: int, levels: list[Level], discount: float, strength: float, tokens: int, distinct: int, most: float):
    def score(key: tuple, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c.split()[0]: [] for c in SCORES.split(", ")})]
        for row in frame.itertuples():
            chunk = Chunk(row)
            chunk.find_pairs()
            words = told[told["kind"] == "words"].set_index("home")
            pairs = told[told["kind"] == "pairs"].set_index("home")
            k, n = len(levels), len(chunk.words)
            kept, counts = np.zeros((2 * k, n)), np.zeros(n, dtype=np.int64)
            for o, part in by_owner(chunk.words, owners):
                kept[:, part] = _named(words.at[o, "a"])["kept"].reshape(2 * k, -1)
                counts[part] = _wide(words.at[o, "b"], len(part))
            inside, totals = np.zeros(len(chunk.pairs)), np.zeros((k + 1, n))
            for o, contexts, _, places in chunk.pairs_by_owner(owners, counts > most):
                a = _named(pairs.at[o, "a"])
                # A single customer has one table in every sweep.
                tables = np.where(a["count"] == 1, 1, a["tables"] / k)
                inside[places] = a["count"] - discount * tables
                totals[:, contexts] = _named(pairs.at[o, "b"])["totals"].reshape(k + 1, -1)
            whole = strength + totals[0]
            p = inside / whole[chunk.context]
            for i, level in enumerate(levels):
                parent = level.parent(kept[2 * i], kept[2 * i + 1])
                passed = (strength + discount * totals[i + 1]) / whole
                p = p + passed[chunk.context] * parent[chunk.next] / k
            begins = np.cumsum(chunk.sizes) - chunk.sizes
            add = lambda values: np.add.reduceat(values, begins)
            base = np.log10((counts + 0.5) / (tokens + 0.5 * (distinct + 1)))
            out.append(pd.DataFrame(
                {
                    "doc_id": chunk.ids, "held_out": chunk.held, "n_tokens": chunk.sizes,
                    "n_known": add((counts > 0).astype(np.int64)[chunk.token]),
                    "train_tokens": np.full(len(chunk.sizes), tokens, dtype=np.int64),
                    "base_score": add(base[chunk.token]), "score": add(np.log10(p)[chunk.pair]),
                }
            ))
        return pd.concat(out[1:] or out, ignore_index=True)

    return score


def _sums(table: DataFrame, n: int) -> list[float]:
    row = table.filter("kind = 'state'").agg(*[F.sum(F.col("sums")[i]) for i in range(n)]).first()
    return [x or 0.0 for x in row]


def score_texts(docs: DataFrame, burn_in: int = BURN_IN, sweeps: int = SWEEPS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) scored by a model of those that
    are not held out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text")
    n = bucket_count(spark, rows, OWNER_BYTES)
    chunks = bucketed(rows.mapInPandas(_chunks(CHUNK_BYTES), CHUNK), "chunk", n, "chunks")
    asked = chunks.mapInPandas(_ask_words(n), ASK_WORDS)
    ids = materialize(asked.groupBy("home").applyInPandas(_tell_ids(n), TELL_IDS), "ids")
    tokens, distinct = (int(x or 0) for x in ids.agg(F.sum("tokens"), F.sum("distinct")).first())
    most = max(1.0, tokens / (4 * n))
    pairs = chunks.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInPandas(_ask_pairs(n, most), ASK_PAIRS)
    # Dealt as the buckets are: one file an owner, read twice in place.
    pairs = bucketed(pairs.repartition(n, "owner"), "owner", n, "pairs")
    drop_table(ids)
    state = materialize(pairs.groupBy("owner").applyInPandas(_first_state, TABLE), "owners")
    discount = discount_of(*_sums(state, 2))
    base = 1.0 / (distinct + 1)
    of = lambda table, kind: table.filter(F.col("kind") == kind)

    def turn(step, left: DataFrame, right: DataFrame, label: str, *done: DataFrame) -> DataFrame:
        """One step, written; the tables that nothing reads any more go."""
        out = materialize(left.groupBy("at").cogroup(right.groupBy("at")).applyInPandas(step, TABLE), label)
        for table in done:
            drop_table(table)
        return out

    nothing = spark.createDataFrame([], TABLE)
    owners = turn(_owner_step(0, None, discount, 1.0, n, False), state, nothing, "owners", state)
    strength = likeliest(_sums(owners, len(STRENGTHS)))
    homes = turn(_home_step(0, Level(0.5, 1.0, base), True, False, n), of(owners, "ask"), nothing, "homes")
    customers, opened, ones, twos = _sums(homes, 4)
    parent = discount_of(ones, twos)
    above = likeliest(fits(np.array([customers]), np.array([opened]), parent))
    level = Level(parent, above, base, 0.0, customers)
    levels = []
    for sweep in range(burn_in + sweeps):
        step = _owner_step(sweep + 1, level, discount, strength, n, sweep > burn_in)
        owners = turn(step, of(owners, "state"), of(homes, "tell"), "owners", owners)
        step = _home_step(sweep + 1, Level(parent, above, base, opened, customers), False, sweep >= burn_in, n)
        homes = turn(step, of(owners, "ask"), of(homes, "state"), "homes", homes)
        customers, opened, _, _ = _sums(homes, 4)
        level = Level(parent, above, base, opened, customers)
        if sweep >= burn_in:
            levels.append(level)
    last = of(owners, "state").unionByName(of(homes, "tell"))
    of_pairs = pairs.groupBy("owner").cogroup(last.groupBy("at")).applyInPandas(_tell_pairs(level, n), TELL)
    of_words = asked.groupBy("home").cogroup(of(homes, "state").groupBy("at")).applyInPandas(_tell_words(sweeps), TELL)
    told = of_pairs.unionByName(of_words)
    step = _score(n, levels, discount, strength, tokens, distinct, most)
    scored = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(step, SCORES)
    return scored.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
