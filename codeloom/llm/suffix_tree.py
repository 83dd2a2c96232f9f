"""Scores of texts by a probabilistic suffix tree over words, grown and used across the cluster.

A state of the tree is a context of no, one or two words. Contexts of a share MIN_SHARE of the training tokens
are candidates; one stays where what follows it differs from what follows its shorter suffix by KEEP nats a
token, measured with every token left out of its own counts. A token is scored from the state of the longest
suffix of what precedes it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import as_table

from .common import batches, text_or_empty
from .simhash_dedup import _word_lists

#: A candidate context has at least this share of the training tokens, so there are at most 1 / MIN_SHARE of a
#: length however large the corpus; the counts of what follows them grow with it.
MIN_SHARE = 1e-5
#: Nats a token by which a context must beat its suffix, and weight of the suffix in a smoothed distribution.
KEEP, WEIGHT = 0.01, 8.0
#: Tokens of a chunk, of which each task holds one at a time, and tokens for each bucket of the counts.
CHUNK, BUCKET = 1 << 19, 1 << 21
_END = b" "  # no word holds a blank
_ORDERS = (0, 1, 2)

_CHUNK = pa.schema([("chunk", pa.int64()), ("lead", pa.int32()), ("own", pa.int64()), ("trained", pa.int64()),
                    ("docs", pa.binary()), ("ids", pa.binary()), ("flags", pa.binary()), ("starts", pa.binary()),
                    ("tokens", pa.binary()), ("words", pa.binary())])
_BLOCK = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_TOTAL = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("totals", pa.binary()), ("common", pa.binary()),
                    ("distinct", pa.int64())])
_JOINED = pa.schema([*_CHUNK, *[(f"totals{k}", pa.binary()) for k in _ORDERS]])
_CONTEXT = pa.schema([("depth", pa.int32()), ("key", pa.int64()), ("suffix", pa.int64()), ("n", pa.int64()), ("gain", pa.float64())])
_SCORE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("learned", pa.bool_()), ("n_tokens", pa.int64()),
                    ("n_known", pa.int64()), ("base_score", pa.float64()),
                    ("score", pa.float64()), ("from_one", pa.int64()), ("from_two", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    names = {"int64": "bigint", "int32": "int", "bool": "boolean"}
    return ", ".join(f"{f.name} {names.get(str(f.type), str(f.type))}" for f in schema)


def _planes(a: np.ndarray) -> bytes:
    """Bytes of one significance side by side, compressed: numbers are small or repeat in their high bytes."""
    return zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def _flat(b: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()


def _rising(keys: np.ndarray) -> bytes:
    """Sorted keys as steps; of those within a bucket the highest bytes are zero."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two, sensitive to their order."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (a >> np.uint64(29))
    h = (h + b) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


#: Flags of a text: learned from; without a doc_id.
_LEARN, _NAMELESS = 1, 2


class _Chunk:
    """Tokens of several texts, or of a part of a long one, with up to two tokens of lead where a text goes on."""

    def __init__(self, number: int) -> None:
        self.number, self.ids = number, _Ids()
        self.parts: list[np.ndarray] = []
        self.size = self.lead = self.trained = 0
        self.docs: list[tuple] = []  # row, doc_id, flags, start

    def begin(self, row: int, doc_id: int | None, learn: bool, lead: list[bytes]) -> None:
        flags = _LEARN * learn | _NAMELESS * (doc_id is None)
        self.docs.append((row, doc_id or 0, flags, self.size))
        if lead:
            self._put(lead)
            self.lead = len(lead)

    def add(self, words: list[bytes]) -> None:
        self._put(words)
        self.trained += len(words) * (self.docs[-1][2] & _LEARN)

    def _put(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.uint32, len(words)))
        self.size += len(words)

    def batch(self) -> pa.RecordBatch:
        hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, self.ids)), ">u8").astype(np.uint64)
        row, ids, flags, start = (np.array(v, np.int64) for v in zip(*self.docs))
        return _one(_CHUNK, (self.number, self.lead, self.size - self.lead, self.trained, row.tobytes(), ids.tobytes(),
                             flags.astype(np.uint8).tobytes(), start.tobytes(), _planes(np.concatenate(self.parts)),
                             hashes.tobytes()))


def _one(schema: pa.Schema, row: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)


def _rows(incoming: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in incoming:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _chunks(size: int):
    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        row, now = number, _Chunk(number)
        for batch in incoming:
            for i in range(batch.num_rows):
                doc_id, learn, text = (batch.column(c)[i] for c in range(3))
                name = (row, doc_id.as_py(), learn.as_py())
                row += 1
                now.begin(*name, [])
                last: list[bytes] = []
                for words in chain(_slices(text.as_buffer().to_pybytes().lower(), size), [[_END]]):
                    if now.size + len(words) > size and now.size > now.lead:
                        yield now.batch()
                        number += 1
                        now = _Chunk(number)
                        now.begin(*name, last)
                    now.add(words)
                    last = (last + words[-2:])[-2:]
        if now.size:
            yield now.batch()
    return work


def _slices(text: bytes, size: int) -> Iterator[list[bytes]]:
    for words in _word_lists(text):
        for at in range(0, len(words), size):
            yield words[at:at + size]


class _Read:
    """A chunk read back: tokens as hashes, whose text each is of and how many tokens of it come before."""

    def __init__(self, row: dict) -> None:
        self.docs, self.ids, starts = (np.frombuffer(row[c], np.int64) for c in ("docs", "ids", "starts"))
        self.flags = np.frombuffer(row["flags"], np.uint8)
        self.hash = np.frombuffer(row["words"], np.uint64)[_flat(row["tokens"], np.uint32)]
        lengths = np.diff(starts, append=len(self.hash))
        self.doc = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
        self.before = np.arange(len(self.hash), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)
        self.lead = row["lead"]
        self.learn = (self.flags & _LEARN).astype(bool)[self.doc]

    def grams(self, order: int, common: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of own tokens after a candidate context of that length, their keys and the context's keys."""
        places = np.flatnonzero(self.before[self.lead:] >= order) + self.lead
        if order == 0:
            return places, self.hash[places], np.zeros(0, np.uint64)
        context = self.hash[places - 1]
        if order == 2:
            context = _mix(self.hash[places - 2], context)
        held = _index(common, context) >= 0
        places, context = places[held], context[held]
        return places, _mix(context, self.hash[places]), context


def _index(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each among sorted keys, -1 where it is not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def _blocks(order: int, bits: int, common):
    """Distinct keys of a chunk with their counts in training texts, cut by their highest bits."""
    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(incoming):
            c = _Read(row)
            places, keys, _ = c.grams(order, common.value[order - 1][0] if order else None)
            learnt, counts = np.unique(keys[c.learn[places]], return_counts=True)
            keys = np.unique(keys)
            n = np.zeros(len(keys), np.uint32)
            n[np.searchsorted(keys, learnt)] = counts
            firsts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits if bits else 0)
            edges = [0, *np.searchsorted(keys, firsts), len(keys)]
            yield from batches(_BLOCK, ((b, row["chunk"], _rising(keys[lo:hi]), _planes(n[lo:hi]))
                                        for b, (lo, hi) in enumerate(pairwise(edges)) if hi > lo))
    return work


def _totals(least: float):
    """For each block the corpus counts of its keys; for each bucket the keys that reach `least`."""
    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in _rows(incoming):
            if held and held[0][0] != row["bucket"]:
                yield from batches(_TOTAL, add(held))
                held = []
            held.append((row["bucket"], row["chunk"], np.cumsum(_flat(row["keys"], np.uint64)), _flat(row["counts"], np.uint32)))
        if held:
            yield from batches(_TOTAL, add(held))

    def add(held: list[tuple]) -> Iterator[tuple]:
        keys, which = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
        n = np.bincount(which, weights=np.concatenate([h[3] for h in held]), minlength=len(keys)).astype(np.int64)
        mine = n[which]
        ends = np.cumsum([len(h[2]) for h in held])
        for h, e in zip(held, ends, strict=True):
            yield h[1], h[0], _planes(mine[e - len(h[2]):e]), None, None
        often = n >= least
        yield -1, held[0][0], _planes(n[often]), keys[often].tobytes(), int((n > 0).sum())
    return work


def _joined(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the totals of their keys, in the order of the keys; a chunk comes before its totals."""
    now, totals = None, [[], [], []]

    def done() -> pa.RecordBatch:
        return _one(_JOINED, (*now, *[_planes(np.concatenate(t or [np.zeros(0, np.int64)])) for t in totals]))
    for row in _rows(incoming):
        if row["order"] < 0:
            if now:
                yield done()
            now, totals = tuple(row[f.name] for f in _CHUNK), [[], [], []]
        else:
            totals[row["order"]].append(_flat(row["totals"], np.int64))
    if now:
        yield done()


@dataclass(frozen=True)
class _Sums:
    tokens: int
    distinct: int


@dataclass(frozen=True)
class _State:
    """Tokens of a chunk after candidate contexts of one length: places, contexts, the counts of the token there and
    of all tokens there, and the probabilities from the suffix."""

    places: np.ndarray
    contexts: np.ndarray
    n: np.ndarray
    of: np.ndarray
    below: np.ndarray


def _states(c: _Read, row: dict, sums: _Sums, common: list[tuple], weight: float) -> Iterator[tuple[np.ndarray, _State]]:
    """Probabilities of all tokens from the states of no word, then of up to one and of up to two."""
    p = np.ones(len(c.hash))
    for k in _ORDERS:
        places, keys, contexts = c.grams(k, common[k - 1][0] if k else None)
        which = np.unique(keys, return_inverse=True)[1]
        del keys
        n = _flat(row[f"totals{k}"], np.int64)[which]
        if k:
            of, below = common[k - 1][1][_index(common[k - 1][0], contexts)], p[places]
            p[places] = (n + weight * below) / (of + weight)
        else:
            of = below = n
            p[places] = (n + 1) / (sums.tokens + sums.distinct + 1)
        yield p, _State(places, contexts, n, of, below)


def _gains(sums: _Sums, common, weight: float):
    """Contexts, their suffixes, the training tokens after them in a chunk and the gain of these over the suffix."""
    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(incoming):
            c = _Read(row)
            for k, (_, s) in enumerate(_states(c, row, sums, common.value, weight)):
                if not k:
                    continue
                mine = c.learn[s.places]
                below = s.below[mine]
                p = (s.n[mine] - 1 + weight * below) / (s.of[mine] - 1 + weight)
                keys, first, which = np.unique(s.contexts[mine], return_index=True, return_inverse=True)
                suffix = c.hash[s.places[mine][first] - 1] if k == 2 else np.zeros(len(keys), np.uint64)
                columns = [np.full(len(keys), k, np.int32), keys.view(np.int64), suffix.view(np.int64),
                           np.bincount(which, minlength=len(keys)),
                           np.bincount(which, weights=np.log(p / below), minlength=len(keys))]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _CONTEXT)], schema=_CONTEXT)
    return work


def _score(sums: _Sums, common, states, weight: float):
    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(incoming):
            c = _Read(row)
            doc = c.doc[c.lead:]
            total = lambda x: np.bincount(doc, weights=x[c.lead:], minlength=len(c.docs))
            depth = np.zeros(len(c.hash), np.int8)
            for k, (p, s) in enumerate(_states(c, row, sums, common.value, weight)):
                if not k:
                    known = np.zeros(len(c.hash), bool)
                    known[s.places] = s.n > 0
                    base, score = total(np.log10(p)), np.log10(p)
                else:
                    held = _index(states.value[k - 1], s.contexts) >= 0
                    at = s.places[held]
                    score[at], depth[at] = np.log10(p[at]), k
            columns = [c.docs, pa.array(c.ids, mask=(c.flags & _NAMELESS) > 0), (c.flags & _LEARN) > 0,
                       np.bincount(doc, minlength=len(c.docs)), total(known).astype(np.int64), base, total(score),
                       total(depth == 1).astype(np.int64), total(depth == 2).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _SCORE)], schema=_SCORE)
    return work


@dataclass(frozen=True)
class Scored:
    """scores: doc_id, learned, n_tokens, n_known, train_tokens, base_score, score (both log10), from_one, from_two
    (tokens scored from a state of that many words). contexts: the candidates (depth, key and suffix as hashes, n,
    gain in nats, kept)."""

    scores: DataFrame
    contexts: DataFrame


def _candidates(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their counts; there are at most 1 / min_share of them."""
    found = rows.select("common", "totals").where(F.length("common") > 0).collect()
    keys = np.concatenate([np.frombuffer(r.common, np.uint64) for r in found] or [np.zeros(0, np.uint64)])
    n = np.concatenate([_flat(r.totals, np.int64) for r in found] or [np.zeros(0, np.int64)])
    order = np.argsort(keys)
    return keys[order], n[order]


def score_texts(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", min_share: float = MIN_SHARE,
                keep: float = KEEP, weight: float = WEIGHT, chunk: int = CHUNK, bucket: int = BUCKET) -> Scored:
    """Score every row by a tree grown from the rows where `learn` holds (null: not learned from).

    Tokens are words between ASCII white space, A-Z lowered, then one end. base_score sums log10 of
    (c + 1) / (N + V + 1); a state's distribution is (n + weight * that of its suffix) / (n of all + weight).
    Null and empty texts have the end alone. Repeated rows count and are scored each by itself, a null doc_id
    like any other; very long texts go through several chunks. With nothing to learn from, every token has
    probability 1. Only the two named columns and those of `learn` are read, so others cannot clash. Words and
    contexts are told apart by 64-bit hashes.

    Texts become chunks of token numbers, written once. Each chunk sends its distinct keys, not its tokens, to
    buckets that add up counts and send totals back, once for each length of context. A key holds the word that
    follows, so a frequent context is spread over all buckets. Only candidate contexts (at most 1 / min_share
    of a length) pass through the driver.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    chunks = as_table(docs.select(
        docs[f"`{doc_id}`"].cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"),
        text_or_empty(docs[f"`{text}`"]).cast("binary").alias("content")).mapInArrow(_chunks(chunk), _ddl(_CHUNK)))
    own, trained = (x or 0 for x in chunks.agg(F.sum("own"), F.sum("trained")).first())
    bits = max(0, int(np.ceil(np.log2(max(1, own / bucket)))))
    common: list[tuple[np.ndarray, np.ndarray]] = []
    every = chunks.select("*", F.lit(-1).alias("order"), F.lit(-1).cast("long").alias("bucket"),
                          F.lit(None).cast("binary").alias("totals"))
    for k in _ORDERS:
        blocks = chunks.mapInArrow(_blocks(k, bits, share(common)), _ddl(_BLOCK))
        found = as_table(blocks.repartition("bucket").sortWithinPartitions("bucket")
                         .mapInArrow(_totals(max(1.0, min_share * trained)), _ddl(_TOTAL)))
        summed = found.where("chunk = -1")
        if k == 0:
            sums = _Sums(trained, summed.agg(F.sum("distinct")).first()[0] or 0)
        if k < _ORDERS[-1]:
            common.append(_candidates(summed))
        every = every.unionByName(found.where("chunk >= 0").select("chunk", F.lit(k).alias("order"), "bucket", "totals"),
                                  allowMissingColumns=True)
    joined = as_table(every.repartition("chunk").sortWithinPartitions("chunk", "order", "bucket")
                      .mapInArrow(_joined, _ddl(_JOINED)))
    sent = share(common)
    contexts = (joined.mapInArrow(_gains(sums, sent, weight), _ddl(_CONTEXT)).groupBy("depth", "key")
                .agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("gain").alias("gain")))
    better = as_table(contexts.withColumn("better", F.col("gain") >= keep * F.col("n")))
    # A suffix of a state is a state.
    needed = better.where("depth = 2 and better").select(F.lit(1).alias("depth"), F.col("suffix").alias("key"),
                                                         F.lit(True).alias("needed")).distinct()
    tree = as_table(better.join(needed, ["depth", "key"], "left").select(
        "depth", "key", "suffix", "n", "gain", (F.col("better") | F.coalesce("needed", F.lit(False))).alias("kept")))
    states = [np.sort(np.array([r.key for r in tree.where(f"kept and depth = {k}").select("key").collect()],
                               np.int64).view(np.uint64)) for k in (1, 2)]
    parts = joined.mapInArrow(_score(sums, sent, share(states), weight), _ddl(_SCORE))
    scores = parts.groupBy("row", "doc_id", "learned").agg(
        *[F.sum(f.name).alias(f.name) for f in list(_SCORE)[3:]]).withColumn("train_tokens", F.lit(trained).cast("long"))
    return Scored(scores.drop("row"), tree)
