"""SimHash near-duplicates: 64-bit fingerprints joined with themselves by walking binary tries in pairs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import as_table

from .common import text_or_empty
from .components import connected_components

BITS = 64
#: Fingerprints a task walks at once, and at most in half a cell of a crowded bucket.
RUN, CHUNK = 1 << 18, 1 << 14
#: Node pairs expanded together, and products of node sizes compared directly.
FRONTIER, LEAF = 1 << 18, 16
_PART = 4 << 20
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a part of it at a time."""
    at = 0
    while at < len(text):
        end = at + _PART
        while end < len(text) and not text[end:end + 1].isspace():
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Majority of the XXH64 bits over all word shingles, repeats included; zero for a text without words."""
    digest, ones, n, kept = xxhash.xxh64_digest, np.zeros(BITS, np.int64), 0, []
    for part in _word_lists(text.lower()):
        w = kept + part
        hashes = b"".join([digest(s, seed) for s in map(b" ".join, zip(*(islice(w, i, None) for i in range(words)),
                                                                      strict=False))])
        kept = w[-(words - 1):] if words > 1 else []
        if hashes:
            m, c = _ones(np.frombuffer(hashes, np.uint8))
            n, ones = n + m, ones + c
    if not n and kept:
        n, ones = _ones(np.frombuffer(digest(b" ".join(kept), seed), np.uint8))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True) if n else 0


def _ones(digests: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of 8-byte digests and how often each bit, highest first, is set. Byte sums of 255 rows fit a byte."""
    rows = np.unpackbits(digests).reshape(-1, BITS)
    n, full = len(rows), len(rows) // 255 * 255
    ones = rows[full:].sum(axis=0, dtype=np.int64)
    if full:
        ones += rows[:full].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return n, ones


def _fingerprints(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in incoming:
        prints = [fingerprint(v.as_buffer().to_pybytes()) for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (a signed long), one row per input row; a null text counts as empty."""
    return docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"),
                       text_or_empty(docs[f"`{text}`"]).cast("binary").alias("content")
                       ).mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


class Forest:
    """Union-find over positions, whole arrays at a time; every label is its component's first position."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self._seams()

    def _seams(self) -> None:
        self.change = np.concatenate(([0], np.cumsum(self.label[1:] != self.label[:-1])))

    def one_component(self, alo, ahi, blo, bhi) -> np.ndarray:
        """Where two ranges already lie in one component."""
        c, of = self.change, self.label
        return (c[ahi - 1] == c[alo]) & (c[bhi - 1] == c[blo]) & (of[alo] == of[blo])

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                break
            up = np.arange(len(self.label))
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while True:
                upper = up[up]
                if np.array_equal(upper, up):
                    break
                up = upper
            self.label = up[self.label]
        self._seams()


def trie_self_join(group: np.ndarray, rest: np.ndarray, bits: int, budget: int) -> np.ndarray:
    """Component label of each position, linking values of one group that differ in at most budget bits.

    group and rest (uint64, `bits` low bits used) are sorted together, so a trie node is a range. Pairs of
    nodes go down together, one bit a level; a pair whose prefixes differ in more than budget bits is
    dropped, and so is a pair of ranges that other links have joined already. Small pairs are compared
    value by value. Pairs wait on a stack in blocks, which bounds memory.
    """
    forest, ones = Forest(len(rest)), {}
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, int)
    end = np.append(start[1:], len(group))
    stack = [(0, start, end, start, end, np.zeros(len(start), np.int8))]
    while stack:
        level, *pairs = stack.pop()
        if len(pairs[0]) > FRONTIER:
            stack.append((level, *[p[FRONTIER:] for p in pairs]))
            pairs = [p[:FRONTIER] for p in pairs]
        alo, ahi, blo, bhi, diff = pairs
        go = ~forest.one_component(alo, ahi, blo, bhi)
        alo, ahi, blo, bhi, diff = (p[go] for p in (alo, ahi, blo, bhi, diff))
        few = (ahi - alo) * (bhi - blo) <= LEAF
        if few.any():
            i, j = _product(alo[few], ahi[few], blo[few], bhi[few])
            near = np.bitwise_count(rest[i] ^ rest[j]) <= budget
            near &= i < j
            if near.any():
                forest.unite(i[near], j[near])
        alo, ahi, blo, bhi, diff = (p[~few] for p in (alo, ahi, blo, bhi, diff))
        if not len(alo) or level == bits:
            continue
        if level not in ones:
            bit = (rest >> np.uint64(bits - 1 - level)) & np.uint64(1)
            ones[level] = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
        c = ones[level]
        am, bm, same = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo]), alo == blo
        cross = np.concatenate([np.ones(2 * len(alo), bool), np.ones(len(alo), bool), ~same])
        lo1, hi1 = np.concatenate([alo, am, alo, am]), np.concatenate([am, ahi, am, ahi])
        lo2, hi2 = np.concatenate([blo, bm, bm, blo]), np.concatenate([bm, bhi, bhi, bm])
        d = np.concatenate([diff, diff, diff + 1, diff + 1])
        live = cross & (hi1 > lo1) & (hi2 > lo2) & (d <= budget)
        stack.append((level + 1, lo1[live], hi1[live], lo2[live], hi2[live], d[live]))
    return forest.label


def _product(alo, ahi, blo, bhi) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all value pairs of each pair of ranges."""
    wide = bhi - blo
    n = (ahi - alo) * wide
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return alo[of] + k // wide[of], blo[of] + k % wide[of]


def _walk_cells(bits: int, budget: int):
    """Walk the tries of the cells of one task; rows come as (trie, prefix, chunk, rest, fp), sorted."""
    def walk(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            *cell, rest, fp = cols
            label = trie_self_join(np.cumsum(_starts(cell)), rest.view(np.uint64), bits, budget)
            linked = np.flatnonzero(label != np.arange(len(label)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], schema=_EDGE)

        held: list[list[np.ndarray]] = []
        for batch in incoming:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(h[0]) for h in held) >= RUN:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = np.flatnonzero(_starts(cols[:3]))[-1]  # the last cell may go on
                if cut:
                    yield from solve([c[:cut] for c in cols])
                held = [[c[cut:] for c in cols]]
        if held:
            yield from solve([np.concatenate(c) for c in zip(*held, strict=True)])
    return walk


def _starts(cell: list[np.ndarray]) -> np.ndarray:
    """Where a cell begins."""
    new = np.ones(len(cell[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cell])
    return new


def _widths(blocks: int) -> list[int]:
    return [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]


def _rotations(budget: int, blocks: int) -> list[tuple[list[int], list[int]]]:
    """Which blocks lead and which follow in each trie: budget bits cannot touch them all."""
    return [(list(lead), [i for i in range(blocks) if i not in lead])
            for lead in combinations(range(blocks), blocks - budget)]


def _gather(fp: Column, blocks: list[int], widths: list[int]) -> Column:
    """The bits of some blocks of fp, moved together."""
    out, place = F.lit(0).cast("long"), 0
    for i in reversed(blocks):
        value = F.shiftrightunsigned(fp, sum(widths[i + 1:])).bitwiseAND(F.lit((1 << widths[i]) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(value, place))
        place += widths[i]
    return out


def near_links(prints: DataFrame, budget: int = 4, blocks: int | None = None) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within budget bits of each other, and no others.

    A pair that differs in at most budget bits agrees on at least one of budget + 1 blocks of bits. For each
    choice of leading blocks the fingerprints form a trie; its top levels, the leading blocks, are left to
    the shuffle, which brings together only equal prefixes. Below, each task walks node pairs.

    A task returns a spanning forest, never all pairs. Crowded buckets (one prefix in very many
    fingerprints) are cut into chunks and every pair of chunks is a cell of its own. More blocks mean
    smaller buckets and more copies; without a choice there are budget + 1 up to 2^25 fingerprints, then
    budget + 2. The links found are the same.
    """
    if blocks is None:
        blocks = budget + 1 if prints.count() <= 1 << 25 else budget + 2
    widths, keys = _widths(blocks), []
    for k, (lead, follow) in enumerate(_rotations(budget, blocks)):
        keys.append(F.struct(F.lit(k).alias("trie"), _gather(F.col("fp"), lead, widths).alias("prefix"),
                             _gather(F.col("fp"), follow, widths).alias("rest")))
    # all rotations leave about as many bits; the widest counts, shorter ones have leading zeros
    bits = max(sum(widths[i] for i in follow) for _, follow in _rotations(budget, blocks))
    rows = prints.select("fp", F.inline(F.array(*keys)))
    crowded = (rows.groupBy("trie", "prefix").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
               .select("trie", "prefix", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    cells = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.transform(
        F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != own),
        lambda c: F.least(c, own) * F.col("chunks") + F.greatest(c, own)))
    rows = (rows.join(crowded, ["trie", "prefix"], "left")
            .select("trie", "prefix", F.explode(cells).alias("chunk"), "rest", "fp"))
    dealt = rows.repartition("trie", "prefix", "chunk").sortWithinPartitions("trie", "prefix", "chunk", "rest")
    return dealt.mapInArrow(_walk_cells(bits, budget), "a bigint, b bigint")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = 4) -> DataFrame:
    """doc_id, fp, component_id: one row per input row, with the smallest doc_id reachable over links.

    Equal fingerprints are linked at no cost: only distinct ones are joined. Nulls and texts without words
    have fingerprint zero and are linked like any other. Repeated rows repeat. A component whose doc_ids
    are all null has a null component_id. Other columns are not read.
    """
    prints = as_table(fingerprints(docs, doc_id, text))
    distinct = as_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = connected_components(near_links(distinct.select("fp"), budget)).withColumnRenamed("node", "fp")
    root = as_table(root.join(distinct, "fp"))
    least = root.groupBy("root").agg(F.min("least").alias("reached"))
    reached = root.join(least, "root").select("fp", "reached")
    classes = distinct.join(reached, "fp", "left").select(
        "fp", F.coalesce("reached", "least").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget: int = 4) -> DataFrame:
    """The documents with the smallest doc_id of their component of near fingerprints, see keep_first."""
    return keep_first(docs, simhash_components(docs, doc_id, text, budget), doc_id, text)


def keep_first(docs: DataFrame, components: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the smallest doc_id of their component, with all their columns.

    Rows that repeat an id are one document if their texts are equal, and one row of them stays. Documents
    without an id stay if nothing in their component has one.
    """
    found = as_table(components)
    stay = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("__stay"))
            .agg(F.count("*").alias("__rows")))

    def among(ids: DataFrame) -> DataFrame:
        return docs.join(ids, docs[f"`{doc_id}`"].cast("long").eqNullSafe(ids["__stay"]), "left_semi")

    repeated = stay.where(F.col("__rows") > 1)
    if repeated.isEmpty():
        return among(stay)
    return among(stay.where(F.col("__rows") == 1)).union(among(repeated).dropDuplicates([doc_id, text]))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
