"""Encode text to the pieces of a merge vocabulary with seeded merge-dropout, and decode it again."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, text_or_empty, without

SPACE = "▁"
_LITERAL = "\udc81"  # a SPACE that stands in the text itself; no valid text holds this
_NEVER = np.iinfo(np.int32).max
#: Chunks up to the last of these lengths share matrices of such a width, longer ones get an agenda of their own.
WIDTHS = (2, 4, 6, 8, 12, 16, 24, 32, 48)
#: Signs of text taken together, which bounds a task's memory but for texts that are longer by themselves.
BLOCK = 500_000
#: Multipliers of start, split and end in the key of a candidate.
_START, _SPLIT, _END = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_MIX, _MIX2, _WORD = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_pieces", pa.int64())])


class Pieces:
    """A merge vocabulary with byte fallback.

    Candidate merges wait on an agenda, best piece first, leftmost among equals. A candidate joins the pieces
    start..split and split..end. When it comes off the agenda it is skipped for good if the hash of seed, document,
    start, split and end falls below `dropout`; both pieces stay open for other candidates. Pieces never cross
    from other signs into a space mark, so chunks between them have agendas of their own. Those of many chunks
    are rows of a matrix, and in each turn every row takes its best candidate off.

    A symbol stands for a piece: its rank; after them come signs that are only parts of pieces, and one for all others.
    """

    def __init__(self, file: str, dropout: float, seed: int) -> None:
        import sentencepiece
        p = sentencepiece.SentencePieceProcessor(model_file=file)
        ids = range(p.get_piece_size())
        normal = [i for i in ids if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        order = sorted(normal, key=lambda i: (-p.get_score(i), i))
        self.rank = {p.id_to_piece(i): n for n, i in enumerate(order)}
        self.id = np.array(order, np.uint32)
        self.byte = {int(p.id_to_piece(i)[3:5], 16): i for i in ids if p.is_byte(i)}
        self.bytes = [b""] * len(ids)
        for i in normal:
            self.bytes[i] = p.id_to_piece(i).replace(SPACE, " ").encode()
        for value, i in self.byte.items():
            self.bytes[i] = bytes([value])
        symbols = dict(self.rank)
        for sign in sorted(set("".join(self.rank))):
            symbols.setdefault(sign, len(symbols))
        self.other = len(symbols)
        self.sign = np.full(0x110000, self.other, np.int32)
        for sign, n in symbols.items():
            if len(sign) == 1:
                self.sign[ord(sign)] = n
        pairs = {}
        for piece, n in self.rank.items():
            for k in range(1, len(piece)):
                x, y = symbols.get(piece[:k]), symbols.get(piece[k:])
                if x is not None and y is not None:
                    pairs[x * (self.other + 1) + y] = n
        self.pairs = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.pairs.tolist()], np.int32)
        self.below, self.seed = round(dropout * (1 << 16)), seed

    def key(self, doc: int) -> int:
        return xxhash.xxh64_intdigest(doc.to_bytes(8, "little", signed=True), self.seed)

    def skips(self, key: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Whether candidates are skipped in the document of their key; places count from its start. All uint64."""
        with np.errstate(over="ignore"):
            x = key + a * np.uint64(_START) + b * np.uint64(_SPLIT) + c * np.uint64(_END)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
        return (x >> np.uint64(48)) < self.below

    def _skips_one(self, key: int, a: int, b: int, c: int) -> bool:
        x = (key + a * _START + b * _SPLIT + c * _END) & _WORD
        x = ((x ^ (x >> 30)) * _MIX) & _WORD
        x = ((x ^ (x >> 27)) * _MIX2) & _WORD
        return x >> 48 < self.below

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the piece that two symbols make, _NEVER for none."""
        key = x.astype(np.int64) * (self.other + 1) + y
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joined[at], _NEVER).astype(np.int32)

    def _rows(self, signs: np.ndarray, piece: np.ndarray, at: np.ndarray, length: np.ndarray, width: int,
              key: np.ndarray, base: np.ndarray) -> None:
        """Agendas of chunks up to `width` signs, which begin `at` in signs; symbols go to `piece` where they begin."""
        cols = np.arange(width + 2)
        inside = cols < length[:, None]
        symbol = np.where(inside, signs[np.minimum(at[:, None] + cols, len(signs) - 1)], self.other)
        start = np.minimum(cols, length[:, None]).astype(np.int32)
        rank = np.full(symbol.shape, _NEVER, np.int32)
        rank[:, :-1] = self._ranks(symbol[:, :-1], symbol[:, 1:])

        def write(rows: np.ndarray) -> None:
            whole = start[rows] < length[rows, None]
            piece[(at[rows, None] + start[rows])[whole]] = symbol[rows][whole]

        while len(at):
            best_at = rank.argmin(1)
            best = rank[np.arange(len(at)), best_at]
            row = np.flatnonzero(best != _NEVER)
            if len(row) < 0.7 * len(at):
                write(np.flatnonzero(best == _NEVER))
                symbol, start, rank, best_at, best = symbol[row], start[row], rank[row], best_at[row], best[row]
                at, length, key, base = at[row], length[row], key[row], base[row]
                row = np.arange(len(at))
            i = best_at[row]
            if self.below:
                a, b, c = (base[row] + start[row, i + k].astype(np.uint64) for k in range(3))
                skipped = self.skips(key[row], a, b, c)
                rank[row[skipped], i[skipped]] = _NEVER
                row, i = row[~skipped], i[~skipped]
            if not len(row):
                continue
            here, new = np.arange(len(row)), best[row]
            for table, first in ((symbol, i + 1), (start, i + 1), (rank, i)):
                old = table[row]
                moved = np.concatenate([old[:, 1:], old[:, -1:]], 1)
                table[row] = np.where(cols >= first[:, None], moved, old)
            symbol[row, i] = new
            rank[row, i] = self._ranks(new, symbol[row, i + 1])
            left = here[i > 0]
            rank[row[left], i[left] - 1] = self._ranks(symbol[row[left], i[left] - 1], new[left])

    def _alone(self, part: str, key: int, base: int) -> list[int]:
        """The places where pieces of a long chunk begin: candidates wait in a heap, and pieces are a linked list."""
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def propose(a: int, b: int, c: int) -> None:
            r = self.rank.get(part[a:c])
            if r is not None:
                heappush(agenda, (r, a, b, c))

        for i in range(n - 1):
            propose(i, i + 1, i + 2)
        while agenda:
            _, a, b, c = heappop(agenda)
            if after[a] != b or b >= n or after[b] != c:
                continue  # one side has been merged meanwhile
            if self.below and self._skips_one(key, base + a, base + b, base + c):
                continue
            after[a], after[b] = c, -1
            if c < n:
                before[c] = a
                propose(a, c, after[c])
            if before[a] >= 0:
                propose(before[a], a, c)
        out, a = [], 0
        while a < n:
            out.append(a)
            a = after[a]
        return out

    def _ids(self, piece: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the symbols of pieces in order, and how many each has: one, or one for each byte of a lone sign."""
        known = piece < len(self.id)
        count = np.ones(len(piece), np.int64)
        lone, which = np.unique(points[~known], return_inverse=True)
        spelt = [[self.byte[x] for x in chr(p).replace(_LITERAL, SPACE).encode()] for p in lone.tolist()]
        count[~known] = np.array([len(x) for x in spelt], np.int64)[which] if len(lone) else 1
        out = np.empty(count.sum(), np.uint32)
        first = np.cumsum(count) - count
        out[first[known]] = self.id[piece[known]]
        places = first[~known]
        for k, x in enumerate(spelt):
            mine = places[which == k]
            for j, value in enumerate(x):
                out[mine + j] = value
        return out, count

    def encode_all(self, texts: list[str], docs: list[int]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        marked = [SPACE + t.replace(SPACE, _LITERAL).replace(" ", SPACE) if t else "" for t in texts]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(points):
            return [b""] * len(texts)
        size = np.array([len(t) for t in marked])
        begin = np.cumsum(size) - size
        space = points == ord(SPACE)
        starts = space & ~np.concatenate([[False], space[:-1]])
        starts[begin[size > 0]] = True  # of a text, though the one before may end with a space
        at = np.flatnonzero(starts)
        length = np.diff(at, append=len(points))
        owner = np.searchsorted(begin, at, "right") - 1
        key = np.array([self.key(d) for d in docs], np.uint64)[owner]
        base = (at - begin[owner]).astype(np.uint64)
        signs = self.sign[points]
        piece = np.full(len(points), -1, np.int32)
        least = 0
        for width in WIDTHS:
            rows = np.flatnonzero((length > least) & (length <= width))
            step = max(1, BLOCK // width)
            for k in range(0, len(rows), step):
                r = rows[k:k + step]
                self._rows(signs, piece, at[r], length[r], width, key[r], base[r])
            least = width
        for r in np.flatnonzero(length > least).tolist():
            part = points[at[r]:at[r] + length[r]].tobytes().decode("utf-32-le", "surrogatepass")
            places = self._alone(part, int(key[r]), int(base[r]))
            ends = [*places[1:], len(part)]
            piece[at[r] + np.array(places)] = [
                self.rank[part[x:y]] if y - x > 1 else int(self.sign[ord(part[x])]) for x, y in zip(places, ends, strict=True)]
        place = np.flatnonzero(piece >= 0)
        ids, count = self._ids(piece[place], points[place])
        data = ids.astype("<u4").tobytes()
        ends = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(place, np.append(begin, len(points)))] * 4
        return [data[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, text: str, doc: int) -> bytes:
        return self.encode_all([text], [doc])[0]

    def decode(self, ids: bytes) -> str:
        """The text whose encoding this is, whatever merges were skipped."""
        joined = b"".join([self.bytes[i] for i in array("I", ids)])
        return joined[1:].decode("utf-8", "replace") if joined[:1] == b" " else joined.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(file: str, dropout: float, seed: int) -> Pieces:
    """One for each worker and setting."""
    return Pieces(file, dropout, seed)


def _together(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[str]]]:
    """Rows of a batch in groups of about BLOCK signs, at least one row each."""
    docs, texts, size = [], [], 0
    for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        docs.append(doc)
        texts.append(t.as_py())
        size += len(texts[-1])
        if size >= BLOCK:
            yield docs, texts
            docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def encode_documents(docs: DataFrame, file: str, dropout: float = 0.1, seed: int = 42, doc_id: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian uint32), n_pieces: one row per input row.

    Each candidate merge is skipped with probability `dropout` when it comes off the agenda, by a hash of seed, doc_id and
    its own start, split and end: the same seed, doc_id and text always give the same ids, copies under other ids others. With dropout 0 the ids are those of
    the vocabulary's own encoder, but for a literal space mark, which is written in bytes so that it comes
    back. Null and empty texts have no pieces. A null doc_id counts as -1. Repeated rows repeat.
    """
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            encode = vocabulary(file, dropout, seed).encode_all
            for batch in incoming:
                for docs, texts in _together(batch):
                    for doc, ids in zip(docs, encode(texts, [-1 if d is None else d for d in docs]), strict=True):
                        yield doc, ids, len(ids) // 4
        yield from batches(_SCHEMA, rows())

    return docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), text_or_empty(docs[f"`{text}`"]).alias("text")
                       ).mapInArrow(run, "doc_id bigint, ids binary, n_pieces bigint")


def decode_documents(encoded: DataFrame, file: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Every input row with `out`: the text of its ids; null for null ids. A column called like it is replaced."""
    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        v = vocabulary(file, 0.0, 0)
        return column.map(lambda x: None if x is None else v.decode(bytes(x)))

    return encoded.select(*without(encoded, out), decode(encoded[f"`{ids}`"]).alias(out))
