"""Pack documents into token sequences of a fixed size by the sum-of-squares rule."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import as_table

from .common import batches, text_or_empty

#: A window closes at this many pieces or bytes of ids; a group of unfilled sequences holds this many.
WINDOW, WINDOW_BYTES, GROUP = 8192, 24 << 20, 16384
#: Entries of each of the two caches of a Python worker.
CACHE = 300_000
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("filled", pa.int64())])
_DDL = ("doc_id bigint, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint, "
        "filled bigint")


#: How the byte-level model writes bytes: printable ones as themselves, the others from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_SHOWN = {b: 256 + k for k, b in enumerate(_HIDDEN)}


class WordEncoder:
    """The ids of a text as little-endian unsigned 32-bit bytes, the same that the tokenizer gives.

    The tokenizer never merges across white space, so it is asked for new chunks only. Plain chunks are cut
    into its words first, because most of those are known already. Its special strings keep their ids.
    """

    #: Chunks in which Python's letters and digits are the pattern's, and normal forms do not matter.
    _PLAIN = re.compile(r"[!-^`-~À-ÖØ-öø-ÿ¡¿«»]+")
    _WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\s\w]+")
    _ODD = re.compile("[\x1c-\x1f]")

    def __init__(self, file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(file)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder()
                                           .values()) or "(?!)")
        model = self.tokenizer.model
        self.of_word = lambda w: array("I", [t.id for t in model.tokenize(
            w if w.isascii() else w.encode().decode("latin-1").translate(_SHOWN))]).tobytes()
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in
                self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        plain, found = {}, {}
        for c in missing:
            if self._PLAIN.fullmatch(c) and not self.special.search(c):
                plain[c] = self._WORDS.findall(c.lower())
        other = [c for c in missing if c not in plain]
        found.update(zip(other, self._ask(other), strict=True))
        known = {w: self.of_word(w) for ws in plain.values() for w in ws if w not in self.words}
        for c, ws in plain.items():
            found[c] = b"".join([known[w] if w in known else self.words[w] for w in ws])
        if len(self.words) < CACHE:
            self.words.update(known)
        return found

    def ids(self, text: str) -> bytes:
        if self._ODD.search(text):
            return self._ask([text])[0]
        chunks, known = text.split(), self.chunks
        missing = [c for c in set(chunks) if c not in known]
        if not missing:
            return b"".join([known[c] for c in chunks])
        found = self._learn(missing)
        out = b"".join([known[c] if c in known else found[c] for c in chunks])
        if len(known) < CACHE:
            known.update((c, v) for c, v in found.items() if len(c) < 64)
        return out

    def forget(self) -> None:
        """Empty the caches; a worker outlives its task and would hold them beside other work."""
        self.chunks.clear()
        self.words.clear()


@lru_cache(maxsize=4)
def encoder(file: str) -> WordEncoder:
    """One encoder for each worker and file."""
    return WordEncoder(file)


def sum_of_squares(lengths: list[int], room: int) -> list[int]:
    """A bin for each item: the one that leaves the smallest sum of squared counts of open bins by gap.

    Moving a bin from gap g to g - s changes the sum by 2 (n[g - s] - n[g]) + 2; filling it by 1 - 2 n[g];
    a new bin by 2 n[room - s] + 1. Among equals the smallest gap wins, a new bin last. Items of no length
    share whatever bin comes first.
    """
    n = np.zeros(room + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    out, bins = [], 0
    far = np.iinfo(np.int64).max
    for s in lengths:
        if s >= room:
            out.append(bins)
            bins += 1
            continue
        cost = 2 * (n[:room - s] - n[s:room]) + 2
        if s:
            cost[0] = 1 - 2 * n[s]
        cost[n[s:room] == 0] = far
        k = int(cost.argmin())
        if cost[k] <= (2 * n[room - s] + 1 if s else far - 1):
            b, gap = open_bins[k + s].pop(), k
            n[k + s] -= 1
        else:
            b, gap = bins, room - s
            bins += 1
        if gap:
            n[gap] += 1
            open_bins[gap].append(b)
        out.append(b)
    return out


def plan(lengths: list[int], room: int) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, its offset there, how much each bin holds); longer items are placed first."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    where = sum_of_squares([lengths[i] for i in order], room)
    bins, offsets, filled = [0] * len(lengths), [0] * len(lengths), [0] * (max(where, default=-1) + 1)
    for i, b in zip(order, where, strict=True):
        bins[i], offsets[i] = b, filled[b]
        filled[b] += lengths[i]
    return bins, offsets, filled


def _pack_windows(file: str, room: int, end_id: int, keep: bool = True):
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(file)

        def rows() -> Iterator[tuple]:
            encode, end = known.ids, end_id.to_bytes(4, "little")
            first, held, size = TaskContext.get().partitionId() << 36, [], 0

            def flush() -> Iterator[tuple]:
                nonlocal first
                bins, offsets, filled = plan([h[3] for h in held], room)
                for h, b, o in zip(held, bins, offsets, strict=True):
                    yield (*h, first + b, o, filled[b])
                first += len(filled)

            for batch in incoming:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = encode(text.as_py()) + end
                    for piece, at in enumerate(range(0, len(ids), 4 * room)):
                        part = ids[at:at + 4 * room]
                        held.append((doc, piece, at // 4, len(part) // 4, part))
                        size += len(part) + 100
                        if len(held) >= WINDOW or size >= WINDOW_BYTES:
                            yield from flush()
                            held, size = [], 0
            yield from flush()
        try:
            yield from batches(_SCHEMA, rows())
        finally:
            if not keep:
                known.forget()
                pa.default_memory_pool().release_unused()
    return run


def _join_bins(room: int):
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in incoming if b.num_rows]
        if tables:
            ids, filled = (sum((t.column(k).to_pylist() for t in tables), []) for k in (0, 1))
            bins, offsets, _ = plan(filled, room)
            lead: dict[int, int] = {}
            to = [lead.setdefault(b, i) for i, b in zip(ids, bins, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (ids, to, offsets)],
                                             ["sequence_id", "to", "base"])
    return run


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 2048, end_id: int = 0,
                   doc_id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian uint32), sequence_id, offset.

    A document is its ids and end_id; null and empty texts are end_id alone. Only documents longer than
    `room` are cut. Places in a sequence have no gaps. Repeated rows are packed each; a null doc_id is
    carried along. Other columns are not read. Without keep, workers forget the words of a task at its end.

    A task packs a window of pieces at a time by the sum-of-squares rule. The sequences that a window leaves
    unfilled, a small share, are packed once more as items of their own in large groups; only their
    pieces move, so the ids of all others are never shuffled.
    """
    slim = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), text_or_empty(docs[f"`{text}`"]).alias("text"))
    pieces = as_table(slim.mapInArrow(_pack_windows(tokenizer, room, end_id, keep), _DDL))
    left = pieces.where(F.col("filled") < room)
    unfilled = left.groupBy("sequence_id").agg(F.first("filled").alias("filled"))
    unfilled = as_table(unfilled)
    groups = max(1, -(-unfilled.count() // GROUP))
    joined = (unfilled.repartition(groups, "sequence_id").sortWithinPartitions("filled", "sequence_id")
              .mapInArrow(_join_bins(room), "sequence_id bigint, to bigint, base bigint"))
    moved = left.join(as_table(joined), "sequence_id").withColumns(
        {"sequence_id": F.col("to"), "offset": F.col("offset") + F.col("base")})
    columns = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    return pieces.where(F.col("filled") >= room).select(columns).union(moved.select(columns))
