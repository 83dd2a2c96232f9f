"""Words that are one edit apart, found on dense matrices of code points, block by block.

Two words differ by one inserted, deleted or replaced code point exactly where their common prefix and common
suffix together reach the longer length less one. Such words share the first part or the last part of the longer
one, so only words with an equal part meet; what meets is laid out as padded matrices and compared in tiles.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import as_table

from .common import batches, text_or_empty

LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Code points of a side of a tile, rows of it at most, and distinct words a task counts before it passes them on.
TILE_POINTS, TILE_ROWS, HELD = 1 << 21, 2048, 1 << 19
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

_COUNT = pa.schema([("word", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def respelt(doc_id: int | None, word: str, one_in: int = 97) -> str:
    """The word as this document has it: where one_in divides the checksum, one code point is missing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _counts(least: int):
    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held: Counter = Counter()
            for batch in incoming:
                for i in range(batch.num_rows):
                    doc_id = batch.column(0)[i].as_py()
                    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in _runs(batch.column(1)[i].as_py()):
                        if not zlib.crc32(word.encode(), head) % 97:
                            word = respelt(doc_id, word)
                        if len(word) >= least:
                            held[word] += n
                    if len(held) > HELD:
                        yield from held.items()
                        held.clear()
            yield from held.items()
        yield from batches(_COUNT, rows())
    return work


def _runs(text: str, part: int = 4 << 20) -> Iterator[tuple[str, int]]:
    """Lower-cased runs of letters with their counts, a part of the text at a time."""
    at = 0
    while at < len(text):
        end = at + part
        while end < len(text) and _RUN.match(text[end]) and _RUN.match(text[end - 1]):
            end += 1
        yield from Counter(_RUN.findall(text[at:end].translate(_LOWER) if not text.isascii() else text[at:end].lower())).items()
        at = end


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of letters of all texts, A-Z lowered and respelt by document, of that length and count.

    A null text has none; repeated rows count each; a null doc_id is an empty one in the checksum.
    """
    slim = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), text_or_empty(docs[f"`{text}`"]).alias("text"))
    return (slim.mapInArrow(_counts(least_length), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


def matrix(words: list[str], dtype: type) -> np.ndarray:
    """Code points of words of at most two lengths, left-aligned, padded with zeros to the longer."""
    wide = max(map(len, words))
    flat = np.frombuffer("".join(w.ljust(wide, "\0") for w in words).encode("utf-32-le"), "<u4")
    return np.ascontiguousarray(flat.astype(dtype).reshape(len(words), wide).T)


def common_prefix(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length, up to most, of the common prefix of every column of a with every column of b."""
    alive = np.ones((a.shape[1], b.shape[1]), bool)
    n = np.zeros(alive.shape, np.uint8 if most < 256 else np.int32)
    for k in range(most):
        alive &= a[k][:, None] == b[k][None, :]
        if not alive.any():
            break
        n += alive
    return n


class _Side:
    """Words of one length in a tile: matrices from the front and from the back."""

    def __init__(self, words: list[str], n: list[int], dtype: type) -> None:
        self.words, self.n = words, np.array(n, np.int64)
        self.front = matrix(words, dtype)
        self.back = np.ascontiguousarray(self.front[::-1])
        #: Places in an order in which the first near word is the form: largest n, then smallest word.
        self.rank = np.empty(len(words), np.int64)


def _near(a: _Side, b: _Side, by_front: bool) -> np.ndarray:
    """Pairs, a no longer than b, whose prefix and suffix reach the longer length less one.

    Pairs with a common prefix of at least half are those of the front, the others those of the back, so that
    each is found once.
    """
    short, long = len(a.front), len(b.front)
    prefix = common_prefix(a.front, b.front, short)
    mine = (prefix >= (long - 1) // 2) == by_front
    if not mine.any():
        return mine
    suffix = common_prefix(a.back, b.back, short)
    differ = prefix < short if short == long else np.ones(prefix.shape, bool)
    return mine & differ & (prefix.astype(np.int32) + suffix >= long - 1)


class _Best:
    """Near words of one side: how many, and the place of the best."""

    def __init__(self, size: int) -> None:
        self.count, self.first = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)

    def add(self, hits: np.ndarray, ranks: np.ndarray) -> None:
        self.count += hits.sum(axis=1)
        i, j = np.nonzero(hits)
        np.minimum.at(self.first, i, ranks[j])


def _tile(rows: list[tuple]) -> Iterator[tuple]:
    """Near words within a tile of one longer length. rows: group, longer length, by_front, left, right, word, n.

    Words of block `left` meet those of block `right`; where the blocks are one, they meet each other.
    """
    _, long, by_front, left, right, *_ = rows[0]
    dtype = np.uint8 if all(r[6].isascii() or max(r[6]) < "Ā" for r in rows) else np.uint32
    ranked = sorted({(-r[7], r[6]) for r in rows})
    place = {w: i for i, (_, w) in enumerate(ranked)}
    sides: dict[tuple, _Side] = {}
    for block in {left, right}:
        for size in (long - 1, long):
            mine = [r for r in rows if r[5] == block and len(r[6]) == size]
            if mine:
                s = sides[block, size] = _Side([r[6] for r in mine], [r[7] for r in mine], dtype)
                s.rank = np.array([place[w] for w in s.words], np.int64)
    best = {k: _Best(len(s.words)) for k, s in sides.items()}
    pairs = [((left, long), (right, long))]
    pairs += [((left, long - 1), (right, long))] + ([((right, long - 1), (left, long))] if left != right else [])
    for x, y in pairs:
        if x in sides and y in sides:
            hits = _near(sides[x], sides[y], by_front)
            best[x].add(hits, sides[y].rank)
            if x != y:
                best[y].add(hits.T, sides[x].rank)
    for k, s in sides.items():
        for i in np.flatnonzero(best[k].count):
            n, w = ranked[best[k].first[i]]
            yield s.words[i], int(best[k].count[i]), -n, w


def _tiles(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        held: list[tuple] = []
        for batch in incoming:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:5] != row[:5]:
                    yield from _tile(held)
                    held = []
                held.append(row)
        if held:
            yield from _tile(held)
    yield from batches(_NEAR, rows())


def near_words(words: DataFrame, tile_points: int = TILE_POINTS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """word, n_near, form, form_n for the words (distinct, with n) that have a word one edit away.

    n_near: how many; form: the one of largest n, of these the smallest in code-point order; form_n: its n.

    For each longer length it may be part of, a word is dealt out by the first half and by the last half of
    that length. A crowded half is cut into blocks that meet pair by pair, each pair of blocks a tile of bounded
    size; a tile gives each word its count and best, not its pairs.
    """
    length = F.length("word")
    keyed = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("long")).select(
        "word", "n", "long", F.explode(F.array(F.lit(True), F.lit(False))).alias("by_front"))
    half = F.floor((F.col("long") - 1) / 2).cast("int")
    part = F.when(F.col("by_front"), F.substring("word", F.lit(1), half)).otherwise(
        F.reverse(F.substring(F.reverse("word"), F.lit(1), F.col("long") - half)))
    keyed = as_table(keyed.withColumn("group", F.xxhash64(part)))
    key = ["group", "long", "by_front"]
    sizes = keyed.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1").withColumn(
        "blocks", F.ceil(F.col("size") / F.greatest(F.lit(1), F.least(F.lit(tile_rows), F.floor(F.lit(tile_points) / F.col("long"))))))
    # A table of its own, so that a crowded half is split where its words meet its size.
    met = keyed.join(as_table(sizes.drop("size")), key)
    block = F.pmod(F.xxhash64("word", F.lit("block")), F.col("blocks"))
    met = met.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = met.select(*key, F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "word", "n")
    at = [*key, "left", "right"]
    found = tiles.repartition(*at).sortWithinPartitions(*at).mapInArrow(
        _tiles, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.word").alias("form"), (-F.col("b.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms. Each round doubles the steps; forms never lead back, as n grows."""
    now = as_table(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = now.join(ahead, "root", "left")
        now = as_table(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO, **tiles: int) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word (distinct, with its count n).

    form: of the words one edit away the one of largest n (ties: smallest in code-point order) where that n is
    at least ratio times the word's, else null; root: the last of the chain of forms, the word itself without one.
    """
    words = as_table(words.select("word", "n"))
    near = words.join(near_words(words, **tiles), "word", "left").withColumn("led", F.col("form_n") >= ratio * F.col("n"))
    led = as_table(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                               F.when(F.col("led"), F.col("form")).alias("form"), F.when(F.col("led"), F.col("form_n")).alias("form_n")))
    return led.join(roots(led.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
