"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every suffix matters only through its first ``LENGTH`` bytes (its window),
and only windows that repeat matter at all, so the sort goes by passes of
digits and drops a group as soon as it is alone:

1. The first digit of a window is the 16-byte string in it whose hash is
   smallest (leftmost on ties), with its offset.  Equal windows agree on it,
   and neighbouring windows mostly share one, so about one digit in eighteen
   bytes is exchanged: its hash goes to the partition that owns it, and comes
   back as one bit that says whether it occurs in a second document.
2. Only windows under repeated digits go on: for each digit the bytes around
   it, equal ones of a chunk once with their smallest document.  The owner
   sorts all windows of a digit by their 8-byte digits, most significant
   first, at most seven passes, keeping groups of two or more.  What is left
   are exactly the repeated windows, each with its smallest document.
3. Masks of windows that a smaller document holds return to the chunks, and
   the covered bytes go.

Documents are dealt to chunks by a hash of the id; chunks and owners number
in proportion to the input, so memory per task stays level.  Copies meet as
equal bytes with one smallest document and never as pairs.

Defined results: a null text is empty; rows that repeat an id are separate
texts of one document, neither smaller than the other; a null id is larger
than all others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import by_owner, packed, packed_rising, unpacked, unpacked_rising
from .common import bucket_count

LENGTH = 50
DIGIT = 16
REACH = LENGTH - DIGIT  # a digit begins at most so far into its window
AROUND = LENGTH + REACH  # bytes around a digit that its windows cover
#: Bytes that are laid out at a time.
SEGMENT = 1 << 19
#: Digits go by the upper 48 bits of their hash when asked for; a clash only
#: lets a lone digit go on.
NAME_SHIFT = np.uint64(16)
NO_ID = np.iinfo(np.int64).max


def _digit_hash(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each position of ``data``."""
    n = len(data) - DIGIT + 1
    halves = np.ndarray((n + 8,), dtype="<u8", buffer=data, strides=(1,))
    h = halves[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += halves[8:]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def digits(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, place, first window, last window) of each run of windows that
    share a digit, for the texts at ``begins`` in ``data``."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    h = _digit_hash(data)
    place = np.arange(len(h), dtype=np.uint64)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | place
    width = 1
    while width * 2 <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    valid = np.zeros(len(data) + 1, dtype=np.int32)
    has = sizes >= LENGTH
    np.add.at(valid, begins[has], 1)
    np.add.at(valid, begins[has] + sizes[has] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[: len(least)]) > 0)
    at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(starts)) - 1
    at = at[first]
    return h[at], at, starts[first], starts[last]


def segments(texts: list[bytes]):
    """Texts laid out end to end in segments; long ones in overlapping
    pieces.  Yields (data, number of each piece's text, its offset there,
    begins, sizes)."""
    held, size = [], 0
    for number, text in enumerate(texts):
        for low in range(0, max(1, len(text) - LENGTH + 1), SEGMENT):
            piece = text[low : low + SEGMENT + LENGTH - 1]
            held.append((number, low, piece))
            size += len(piece)
            if size >= SEGMENT:
                yield _laid_out(held)
                held, size = [], 0
    if held:
        yield _laid_out(held)


def _laid_out(held):
    sizes = np.array([len(p) for _, _, p in held], dtype=np.int64)
    data = np.frombuffer(b"".join(p for _, _, p in held), dtype=np.uint8)
    return data, np.array([n for n, _, _ in held]), np.array([low for _, low, _ in held]), np.cumsum(sizes) - sizes, sizes


def _texts(frame: pd.DataFrame) -> tuple[np.ndarray, list[bytes]]:
    """Ids, which travel as text (a float would not hold them), and texts in order."""
    texts = [t.encode() if isinstance(t, str) else b"" for t in frame["text"]]
    ids = [int(i) if isinstance(i, str) else NO_ID for i in frame["doc_id"]]
    order = sorted(range(len(ids)), key=lambda n: (ids[n], texts[n]))
    return np.array([ids[n] for n in order], dtype=np.int64), [texts[n] for n in order]


def _chunk_digits(frame: pd.DataFrame):
    """The distinct digits of a chunk, and whether two of its documents have each."""
    ids, texts = _texts(frame)
    found, docs = [], []
    for data, number, _, begins, sizes in segments(texts):
        h, at, _, _ = digits(data, begins, sizes)
        found.append(h >> NAME_SHIFT)
        docs.append(ids[number[np.searchsorted(begins, at, side="right") - 1]])
    h = np.concatenate(found) if found else np.empty(0, np.uint64)
    d = np.concatenate(docs) if docs else np.empty(0, np.int64)
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    if not len(first):
        return h, np.empty(0, bool)
    return h[first], np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)


ASK_DIGITS = "owner int, chunk int, hashes binary, many binary"
TELL_DIGITS = "chunk int, owner int, again binary, kind int"


def _ask_digits(owners: int):
    def ask(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        h, many = _chunk_digits(frame)
        rows = [
            (o, key[0], packed_rising(h[part]), np.packbits(many[part]).tobytes()) for o, part in by_owner(h, owners)
        ]
        return pd.DataFrame(rows, columns=["owner", "chunk", "hashes", "many"])

    return ask


def _tell_digits(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    asked = [unpacked_rising(b) for b in frame["hashes"]]
    weight = np.concatenate(
        [1 + np.unpackbits(np.frombuffer(m, np.uint8), count=len(a)).astype(np.int64) for a, m in zip(asked, frame["many"])]
    )
    joined = np.concatenate(asked)
    distinct, index = np.unique(joined, return_inverse=True)
    again = (np.bincount(index, weights=weight, minlength=len(distinct)) >= 2)[index]
    cuts = np.cumsum([len(a) for a in asked])[:-1]
    return pd.DataFrame(
        {
            "chunk": frame["chunk"].to_numpy(),
            "owner": np.full(len(frame), key[0], dtype=np.int32),
            "again": [np.packbits(x).tobytes() for x in np.split(again, cuts)],
            "kind": np.zeros(len(frame), dtype=np.int32),
        }
    )


ASK_WINDOWS = "owner int, chunk int, shape binary, doc binary, bytes binary, places binary"
TELL_WINDOWS = "chunk int, owner int, masks binary, places binary"
#: Where a mask applies: text of the chunk, first window, row of the mask, all windows gone.
PLACE = np.dtype([("text", "<i4"), ("at", "<i8"), ("row", "<i4"), ("gone", "u1"), ("n", "u1")])


def _ask_windows(owners: int):
    def ask(key: tuple, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in ASK_WINDOWS.split(", ")]
        if not len(frame) or not len(told):
            return pd.DataFrame(columns=names)
        distinct, _ = _chunk_digits(frame)
        bits = dict(zip(told["owner"], told["again"]))
        kept = [
            distinct[part][np.unpackbits(np.frombuffer(bits[o], np.uint8), count=len(part)).astype(bool)]
            for o, part in by_owner(distinct, owners)
        ]
        repeated = np.sort(np.concatenate(kept)) if kept else np.empty(0, np.uint64)
        if not len(repeated):
            return pd.DataFrame(columns=names)
        ids, texts = _texts(frame)
        parts = []
        for data, number, low, begins, sizes in segments(texts):
            h, at, first, last = digits(data, begins, sizes)
            if not len(h):
                continue
            name = h >> NAME_SHIFT
            keep = repeated[np.minimum(np.searchsorted(repeated, name), len(repeated) - 1)] == name
            h, at, first, last = h[keep], at[keep], first[keep], last[keep]
            piece = np.searchsorted(begins, at, side="right") - 1
            wide = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(LENGTH, np.uint8)])
            around = np.lib.stride_tricks.sliding_window_view(wide, AROUND)[at].copy()
            # Bytes that no window of the run covers must not tell runs apart.
            column = np.arange(AROUND)
            begin, end = REACH - (at - first), REACH - (at - last) + LENGTH
            around[(column < begin[:, None]) | (column >= end[:, None])] = 0
            parts.append((h, at - first, at - last, number[piece], first - begins[piece] + low[piece], around))
        if not parts:
            return pd.DataFrame(columns=names)
        h, far, near, text, start, around = (np.concatenate(x) for x in zip(*parts))
        shape = np.stack([far, near], axis=1).astype(np.uint8)
        rows = []
        for o, part in by_owner(h >> NAME_SHIFT, owners):
            # Equal bytes of the chunk are one row with the smallest document.
            whole = np.ascontiguousarray(
                np.concatenate([h[part].astype("<u8").view(np.uint8).reshape(-1, 8), shape[part], around[part]], axis=1)
            )
            void = whole.view(np.dtype((np.void, whole.shape[1]))).ravel()
            _, one, row = np.unique(void, return_index=True, return_inverse=True)
            doc = ids[text[part]]
            least = np.full(len(one), NO_ID)
            np.minimum.at(least, row, doc)
            place = np.empty(len(part), dtype=PLACE)
            place["text"], place["at"], place["row"] = text[part], start[part], row
            place["gone"], place["n"] = doc > least[row], (far - near)[part] + 1
            chosen = part[one]
            rows.append(
                (o, key[0], packed(shape[chosen]), packed(least), packed(around[chosen]), packed(place))
            )
        return pd.DataFrame(rows, columns=names)

    return ask


def repeated_windows(group: np.ndarray, shape: np.ndarray, doc: np.ndarray, around: np.ndarray) -> np.ndarray:
    """For each row a mask of the windows that a smaller document holds too.
    Rows with equal ``group`` share a digit."""
    masks = np.zeros(len(group), dtype=np.uint64)
    counts = shape[:, 0].astype(np.int64) - shape[:, 1] + 1
    row = np.repeat(np.arange(len(group)), counts)
    step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    offset = shape[row, 0].astype(np.int64) - step  # of the digit in the window
    # First pass: the digit and its offset.  Then 8 bytes a pass.
    where = np.arange(len(row))
    now = group[row].astype(np.int64) * (REACH + 1) + offset
    padded = np.concatenate([around, np.zeros((len(around), 8), np.uint8)], axis=1)
    flat, width = padded.ravel(), padded.shape[1]
    for low in range(-8, LENGTH, 8):
        if low < 0:
            value = np.zeros(len(where), dtype=np.uint64)
        else:
            place = row[where] * width + REACH - offset[where] + low
            value = np.ndarray((max(0, len(flat) - 7),), dtype="<u8", buffer=flat, strides=(1,))[place]
            if low + 8 > LENGTH:
                value = value & np.uint64((1 << (8 * (LENGTH - low))) - 1)
        order = np.lexsort((value, now))
        a, b = now[order], value[order]
        fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(order) else np.empty(0, bool)
        name = np.cumsum(fresh) - 1
        alone = np.bincount(name, minlength=1)[name] < 2 if len(name) else np.empty(0, bool)
        where, now = where[order][~alone], name[~alone]
        if not len(where):
            return masks
    first = np.flatnonzero(np.append(True, now[1:] != now[:-1]))
    owner = doc[row[where]]
    least = np.minimum.reduceat(owner, first)[np.cumsum(np.append(True, now[1:] != now[:-1])) - 1]
    gone = where[owner > least]
    np.bitwise_or.at(masks, row[gone], np.uint64(1) << step[gone].astype(np.uint64))
    return masks


def _tell_windows(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    shapes = [unpacked(b, np.uint8).reshape(-1, 2) for b in frame["shape"]]
    sizes = [len(x) for x in shapes]
    shape = np.concatenate(shapes)
    doc = np.concatenate([unpacked(b, np.int64) for b in frame["doc"]])
    around = np.concatenate([unpacked(b, np.uint8) for b in frame["bytes"]]).reshape(-1, AROUND)
    halves = np.ascontiguousarray(around[:, REACH : REACH + DIGIT]).view("<u8")
    digit = np.unique(halves, axis=0, return_inverse=True)[1].ravel().astype(np.uint64)
    # Equal bytes of several chunks are one row too.
    whole = np.ascontiguousarray(
        np.concatenate([digit.astype("<u8").view(np.uint8).reshape(-1, 8), shape, around], axis=1)
    )
    void = whole.view(np.dtype((np.void, whole.shape[1]))).ravel()
    _, one, row = np.unique(void, return_index=True, return_inverse=True)
    least = np.full(len(one), NO_ID)
    np.minimum.at(least, row, doc)
    _, group, members = np.unique(digit[one], return_inverse=True, return_counts=True)
    crowd = members[group] > 1
    masks = np.zeros(len(one), dtype=np.uint64)
    masks[crowd] = repeated_windows(group[crowd], shape[one][crowd], least[crowd], around[one][crowd])
    answer = np.where(doc > least[row], ~np.uint64(0), masks[row])
    cuts = np.cumsum(sizes)[:-1]
    return pd.DataFrame(
        {
            "chunk": frame["chunk"].to_numpy(),
            "owner": np.full(len(frame), key[0], dtype=np.int32),
            "masks": [packed(x) for x in np.split(answer, cuts)],
            "places": frame["places"].to_numpy(),
        }
    )


RESULT = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _finish(with_text: bool):
    def finish(key: tuple, frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        ids, texts = _texts(frame)
        marks: list[list] = [[] for _ in texts]
        for packed_masks, packed_places in zip(told["masks"], told["places"]):
            masks, places = unpacked(packed_masks, np.uint64), unpacked(packed_places, PLACE)
            mask = np.where(places["gone"] == 1, ~np.uint64(0), masks[places["row"]])
            hit = mask != 0
            places, mask = places[hit], mask[hit]
            n = places["n"].astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            on = (mask[row] >> step.astype(np.uint64)) & np.uint64(1) == 1
            text, start = places["text"][row][on], places["at"][row][on] + step[on]
            order = np.argsort(text, kind="stable")
            text, start = text[order], start[order]
            if len(text):
                for part in np.split(np.arange(len(text)), np.flatnonzero(text[1:] != text[:-1]) + 1):
                    marks[text[part[0]]].append(start[part])
        out = []
        for i, text in enumerate(texts):
            removed = spans = 0
            kept = text
            if marks[i]:
                edge = np.zeros(len(text) + 1, dtype=np.int32)
                starts = np.concatenate(marks[i])
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = int(gone.sum())
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((ids[i], len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        result = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
        result["doc_id"] = [None if i == NO_ID else str(i) for i in result["doc_id"].tolist()]
        return result

    return finish


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """For each row of ``docs`` (doc_id, text) what is left of its bytes."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    chunks = bucket_count(docs.sparkSession, rows, 4 << 20)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64(F.coalesce("doc_id", "text")), F.lit(chunks)).cast("int"))
    ask = dealt.groupBy("chunk").applyInPandas(_ask_digits(chunks), ASK_DIGITS)
    told = ask.groupBy("owner").applyInPandas(_tell_digits, TELL_DIGITS)
    asked = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_ask_windows(chunks), ASK_WINDOWS)
    answers = asked.groupBy("owner").applyInPandas(_tell_windows, TELL_WINDOWS)
    left = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_finish(with_text), RESULT)
    return left.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, with_text=False).drop("kept")
