"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens with a target weight (by default its own
share of all tokens).  In each round every queue that still holds tokens adds
its quota, its weight's share of one window, to its deficit, and serves whole
quanta while the deficit covers at least half of the next one; what it earned
and did not serve carries over to the next round.  The served quanta, round
after round, form one stream that is cut into windows, so every window is full
(but for the last) and holds the target proportions to within a quantum or so
a source.  When a queue runs dry the others share its quota from the next
round on.

Quotas change only where a queue runs dry, so between two such rounds (a
phase) all deficits grow linearly and a round's state has a closed form.  A
task needs the phases (one row a queue) and the place of its own documents in
their queues (a prefix sum over blocks of documents) to know windows and
offsets: deficits carry across windows and partitions without any task
waiting for another.  ``sequential`` in the tests serves the same queues one
quantum after another.

Queues are bounded: the ``QUEUES - 1`` sources with the most tokens have one
each and all others share the last, so what reaches the driver and every task
does not grow with the input.

Defined results: a null text is an empty document, which still has its end
id; a null source shares the queue of the empty name; null ids stay null and
count as separate documents; repeated rows are packed as often as they occur;
an empty table gives no pieces; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 2048
QUANTUM = 128
#: Queues at most; the sources with the fewest tokens share the last.
QUEUES = 1000
END_ID = 1
#: Quotas and deficits are counted in this part of a token.
UNIT = 1 << 16


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable
    Latin-1 characters stand for themselves, the others follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def word_merger(spec: dict):
    """For lower-casing vocabularies of words whose ids rise in the order of
    merges and whose words end in a marked symbol (None for others): a
    function from words, a blank after each, to their ids.  Merging the lowest
    id first, with the blank for the mark, is then the model's own rule, and
    a byte-pair library applies it many times faster."""
    model = spec["model"]
    if [p.get("type") for p in (spec.get("normalizer") or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
        return None
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    ids = [model["vocab"].get("".join(m)) for m in merges]
    mark = model.get("end_of_word_suffix")
    if model.get("type") != "BPE" or not mark or None in ids or ids != sorted(ids):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return None
    import tiktoken

    value = {letter: b for b, letter in enumerate(_byte_letters())}
    ranks = {}
    for token, number in model["vocab"].items():
        ended = token.endswith(mark) and token != mark
        stem = token[: -len(mark)] if ended else token
        if not set(stem) <= set(value):
            return None
        ranks[bytes(value[c] for c in stem) + b" " * ended] = number
    if len(ranks) != max(ranks.values()) + 1:
        return None
    return tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _plain_pieces() -> re.Pattern:
    """The vocabulary's splitter for characters below U+0300, where every text
    is its own composed form."""
    kind = lambda k: "".join(re.escape(chr(c)) for c in range(0x300) if unicodedata.category(chr(c))[0] == k)
    letters, digits = kind("L"), kind("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\\s{letters}{digits}]+")


class TextEncoder:
    """Texts to ids: through the merger where the vocabulary allows, with the
    tokenizer itself for texts with characters whose composed form, case or
    splitting need its own tables, and for any other tokenizer."""

    #: One for each worker process and file: tasks of a worker share it.
    shared: dict[str, TextEncoder] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 65536 else "I"
        with open(path, encoding="utf-8") as f:
            self.merge = word_merger(json.load(f))
        self.pieces = _plain_pieces()
        self.odd = re.compile("[^\x00-\u02ff]")

    @classmethod
    def of(cls, path: str) -> TextEncoder:
        if path not in cls.shared:
            cls.shared[path] = cls(path)
        return cls.shared[path]

    def _ids(self, text: str) -> list[int]:
        low = text.lower()
        # Lower case can leave the plain characters, and can come from others.
        odd = not text.isascii() and (self.odd.search(text) or self.odd.search(low))
        if self.merge is None or odd or "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        pieces = self.pieces.findall
        words = [w if w.isalpha() else " ".join(pieces(w)) for w in low.split()]
        return self.merge(" ".join(words) + " ") if words else []

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids, then the end id, as packed integers."""
        return [array(self.code, [*self._ids(t or ""), END_ID]).tobytes() for t in texts]


TOKENS = "block long, queue string, doc_id string, n long, before long, ids binary"


def tokenize(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row a document: its ids, and in its block (an input partition) the
    tokens of its source before it.  Ids of documents travel as text."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = TextEncoder.of(tokenizer_path)
        width = array(encoder.code).itemsize
        block, served = TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                ids = encoder.encode(part["text"].tolist())
                n = [len(x) // width for x in ids]
                before = []
                for queue, count in zip(part["queue"], n):
                    before.append(served.get(queue, 0))
                    served[queue] = before[-1] + count
                yield pd.DataFrame(
                    {"block": block, "queue": part["queue"].to_numpy(), "doc_id": part["doc_id"].to_numpy(),
                     "n": n, "before": before, "ids": ids}
                )

    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("source", F.lit("")).alias("queue"), "text")
    return named.mapInPandas(encode, TOKENS)


class RoundRobin:
    """Deficits and places of a weighted round-robin, for any round.

    ``totals`` are the queues' tokens and ``weights`` their target weights
    (None: the totals).  A queue's credit, in units, is what it has earned
    since the start; it has served ``(credit + half a quantum) // quantum``
    quanta, and all it holds once half of the last one is earned.
    """

    def __init__(self, totals: list[int], weights: list[float] | None = None, window: int = WINDOW, quantum: int = QUANTUM) -> None:
        self.window, self.quantum = window, quantum
        self.totals = np.array(totals, dtype=np.int64)
        share = self.totals.astype(np.float64) if weights is None else np.array(weights, dtype=np.float64)
        if (share < 0).any() or not np.isfinite(share).all():
            raise ValueError("target weights must be finite and not negative")
        # A queue is dry once half of its last quantum, a short one, is earned.
        begin = np.maximum(-(-self.totals // quantum) - 1, 0) * quantum
        self.last = last = begin * UNIT + (self.totals - begin) * UNIT // 2
        # Queues begin at different parts of a quantum, lest those of equal
        # weight be served in the same rounds.
        begin = ((np.arange(len(totals)) * 0.618034 + 0.5) % 1 - 0.5) * quantum * UNIT
        credit, first = np.minimum(np.floor(begin).astype(np.int64), last - 1), 0
        self.begin = credit
        firsts, credits, quotas = [], [], []
        active = self.totals > 0
        while active.any():
            # Queues without weight wait until only such are left.
            live = active & (share > 0) if (active & (share > 0)).any() else active
            weight = np.where(live, np.where(share > 0, share, 1.0), 0.0)
            quota = np.where(live, np.maximum(1, np.floor(window * UNIT * (weight / weight.sum())).astype(np.int64)), 0)
            firsts.append(first)
            credits.append(credit)
            quotas.append(quota)
            rounds = int((-(-(last - credit)[live] // quota[live])).min())
            first, credit = first + rounds, credit + rounds * quota
            active = active & (credit < last)
        self.firsts = np.array(firsts, dtype=np.int64)
        self.credits = np.array(credits, dtype=np.int64).reshape(len(firsts), len(totals))
        self.quotas = np.array(quotas, dtype=np.int64).reshape(len(firsts), len(totals))
        self.rounds = first

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens each queue has served after each of ``rounds``: (rounds, queues)."""
        phase = np.maximum(np.searchsorted(self.firsts, rounds, side="left") - 1, 0)
        credit = self.credits[phase] + (rounds - self.firsts[phase])[:, None] * self.quotas[phase]
        step = self.quantum * UNIT
        return np.where(credit >= self.last, self.totals, (credit + step // 2) // step * self.quantum)

    def places(self, queue: np.ndarray, quanta: np.ndarray) -> np.ndarray:
        """Where each of the given quanta of the given queues begins in the stream."""
        out = np.empty(len(quanta), dtype=np.int64)
        step = self.quantum * UNIT
        for q in np.unique(queue):
            mine = np.flatnonzero(queue == q)
            need = np.minimum(quanta[mine] * step + step // 2, self.last[q])
            # The phase in whose rounds the credit first reaches the need.
            phase = np.searchsorted(self.credits[:, q], need, side="left") - 1
            gap = need - self.credits[phase, q]
            rounds = self.firsts[phase] - (-gap // self.quotas[phase, q])
            distinct, index = np.unique(rounds, return_inverse=True)
            begin, then = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
            for low in range(0, len(distinct), 2048):
                part = distinct[low : low + 2048]
                now, was = self.served(part), self.served(part - 1)
                begin[low : low + 2048] = was.sum(axis=1) + (now - was)[:, :q].sum(axis=1)
                then[low : low + 2048] = was[:, q]
            out[mine] = (begin - then)[index] + self.quantum * quanta[mine]
        return out


PIECE = (
    "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, source string"
)


def cut(places: RoundRobin, queue: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, length, place) of the pieces of documents that hold
    the tokens at .. at + n of their queues."""
    q, w = places.quantum, places.window
    first_quantum = at // q
    count = (at + n - 1) // q - first_quantum + 1
    doc = np.repeat(np.arange(len(at)), count)
    quanta = first_quantum[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begins = np.maximum(quanta * q, at[doc])
    where = places.places(queue[doc], quanta) + (begins - quanta * q)
    ends = np.minimum((quanta + 1) * q, (at + n)[doc])
    # Quanta of a document that follow one another in the stream are one run.
    fresh = np.ones(len(quanta), dtype=bool)
    fresh[1:] = (where[1:] != where[:-1] + (ends - begins)[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(quanta)) - 1
    run_doc, run_place = doc[first], where[first]
    run_start = begins[first] - at[run_doc]
    run_length = ends[last] - begins[first]
    # Runs are cut where windows end.
    pieces = (run_place + run_length - 1) // w - run_place // w + 1
    run = np.repeat(np.arange(len(first)), pieces)
    step = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    place = np.maximum(run_place[run], (run_place[run] // w + step) * w)
    stop = np.minimum(run_place[run] + run_length[run], (place // w + 1) * w)
    return run_doc[run], run_start[run] + place - run_place[run], stop - place, place


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, quantum: int = QUANTUM,
    weights: Mapping[str, float] | None = None, queues: int = QUEUES,
) -> DataFrame:
    """One row a piece of a document of ``docs`` (doc_id, source, text).
    ``weights`` are target proportions by source, 0 for sources it leaves out
    (these come when all others are dry); None keeps the sources' own."""
    tokens = materialize(tokenize(docs, tokenizer_path), "tokens")
    blocks = materialize(tokens.groupBy("queue", "block").agg(F.sum("n").alias("n")), "blocks")
    # The sources named in the weights, then the largest, one row each and bounded in number.
    wanted = F.col("queue").isin(*[s for s, w in (weights or {}).items() if w > 0])
    largest = blocks.groupBy("queue").agg(F.sum("n").alias("n")).orderBy(F.desc(wanted), F.desc("n"), "queue").limit(queues)
    named = [r.queue for r in largest.collect()]
    shared = named[queues - 1 :]
    named = sorted(named[: queues - 1])
    number = F.lit(len(named))
    if named:
        known = F.create_map(*[x for i, s in enumerate(named) for x in (F.lit(s), F.lit(i))])
        number = F.coalesce(F.try_element_at(known, F.col("queue")), F.lit(len(named)))
    # In the shared queue a block's sources follow one another.
    numbered = blocks.withColumn("number", number)
    earlier = Window.partitionBy("number").orderBy("block", "queue").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(
        numbered.select("queue", "block", "number", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "bases"
    )
    sums = {r.number: r.n for r in numbered.groupBy("number").agg(F.sum("n").alias("n")).collect()}
    totals = [sums.get(i, 0) for i in range(len(named) + bool(shared))]
    targets = None if weights is None else [*(float(weights.get(s, 0)) for s in named), *[0.0] * bool(shared)]
    # Written tables have a known size: Spark broadcasts the bases where they
    # are small and sorts both sides where they are not.
    placed = tokens.join(bases, ["queue", "block"]).select(
        "queue", "number", "doc_id", "n", (F.col("base") + F.col("before")).alias("at"), "ids"
    )

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = RoundRobin(totals, targets, window, quantum)
        for batch in batches:
            low, n = 0, batch["n"].to_numpy()
            while low < len(batch):
                # Documents of about a million tokens at a time.
                high = low + max(1, int(np.searchsorted(np.cumsum(n[low : low + 1024]), 1 << 20)))
                yield _pieces(places, batch.iloc[low:high])
                low = high

    return placed.mapInPandas(pieces, PIECE).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _pieces(places: RoundRobin, batch: pd.DataFrame) -> pd.DataFrame:
    n = batch["n"].to_numpy(np.int64)
    doc, start, length, place = cut(places, batch["number"].to_numpy(np.int64), batch["at"].to_numpy(np.int64), n)
    wide = [
        np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * k else "<u4").astype("<u4").tobytes() for ids, k in zip(batch["ids"], n)
    ]
    stop = (start + length) * 4
    sums = [zlib.crc32(wide[d][4 * a : b]) for d, a, b in zip(doc.tolist(), start.tolist(), stop.tolist())]
    return pd.DataFrame(
        {
            "doc_id": batch["doc_id"].to_numpy()[doc],
            "start": start,
            "length": length,
            "ids_crc32": np.array(sums, dtype=np.int64),
            "doc_tokens": n[doc],
            "sequence_id": place // places.window,
            "offset": place % places.window,
            "source": batch["queue"].to_numpy()[doc],
        }
    )
