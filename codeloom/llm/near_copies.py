"""Near copies: all pairs of texts whose word shingles have a given Jaccard similarity, none left to chance.

SimHash fingerprints of the same shingles, joined by walking tries, propose pairs; their shingles are compared
in full. At a similarity of 0.8 most pairs differ in more bits than tries can be walked for, so the rest is found
exactly: two sets of at least that similarity share a shingle among the first few of each, in any order that holds
for all texts (prefix filter). Only those are dealt out, rare ones first, and what meets is compared in full too.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import as_table

from .common import text_or_empty
from .components import connected_components
from .simhash_dedup import _word_lists, fingerprint, near_links

WORDS, SIMILARITY = 5, 0.8
#: Bits in which fingerprints of a proposed pair may differ.
BUDGET = 4
#: One text in SAMPLE tells which shingles are common; at most COMMON are put last. They order the work, nothing else.
SAMPLE, COMMON = 16, 200_000
#: Pairs for each row dealt out that may meet at once, and turns before they do in any case.
FULL, TURNS = 16, 2
#: Texts worked on before their rows are sent on.
PART = 512
_HELD, _SLACK = 64, 1e-9


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle. A-Z count as a-z."""
    digest = xxhash.xxh64_digest
    w = np.frombuffer(b"".join(digest(x) for part in _word_lists(text.lower()) for x in part), ">u8").astype(np.uint64)
    if not len(w):
        return w
    wide = min(words, len(w))
    h = np.full(len(w) - wide + 1, wide, np.uint64)
    for i in range(wide):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i:len(h) + i]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def _parts(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts of a few texts, so that what a worker makes of one stays small."""
    for batch in incoming:
        for at in range(0, batch.num_rows, PART):
            yield batch.slice(at, PART)


def _keys(words: int):
    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(incoming):
            sets = (shingles(v.as_buffer().to_pybytes(), words) for v in batch.column(1))
            found = [(xxhash.xxh64_intdigest(s.tobytes()), len(s)) for s in sets]
            key = np.array([k for k, _ in found], np.uint64).view(np.int64)
            packed = pa.array([zstandard.compress(v.as_buffer(), 3) for v in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key), pa.array([n for _, n in found], pa.int32()),
                                              packed], ["doc_id", "key", "n", "content"])
    return work


def _of_packed(v: pa.Scalar, words: int) -> np.ndarray:
    """Shingles of a text as it is stored and sent: compressed."""
    return shingles(zstandard.decompress(v.as_buffer()), words)


def _all_shingles(words: int):
    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for v in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_of_packed(v, words).view(np.int64))], ["h"])
    return work


def _first(words: int, similarity: float, common: np.ndarray, often: np.ndarray):
    """(h, key, n, at): the shingles of each text of which a similar text must hold one, rare ones first."""
    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(incoming):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for key, v in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
                h = _of_packed(v, words)
                if len(common):
                    place = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.argsort(np.where(common[place] == h, often[place], 0), kind="stable")]
                n = len(h)
                h = h[:n - int(np.ceil(similarity * n - _SLACK)) + 1]
                for column, values in zip(out, (h.view(np.int64), np.full(len(h), key), np.full(len(h), n, np.int32),
                                                np.arange(len(h), dtype=np.int32)), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["h", "key", "n", "at"])
    return work


def _alike(words: int, similarity: float):
    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(key: int, v: pa.Scalar) -> np.ndarray:
            if key not in held:
                held[key] = _of_packed(v, words)
                if len(held) > _HELD:
                    held.popitem(last=False)
            held.move_to_end(key)
            return held[key]

        for batch in incoming:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            near = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                s, t = of(a[i], x), of(b[i], y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                near[i] = both >= similarity * (len(s) + len(t) - both) - _SLACK
            yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], ["a", "b"])
    return work


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of shingles that many texts of a sample share."""
    counts = as_table(texts.where(F.pmod("key", F.lit(SAMPLE)) == 0).select("content")
                      .mapInArrow(_all_shingles(words), "h bigint").groupBy("h").agg(F.count("*").alias("n"))
                      .where("n > 3"))
    by_size = counts.groupBy(F.floor(F.log2("n")).alias("power")).count().collect()
    least, total = 63, 0
    for power, rows in sorted(((x.power, x["count"]) for x in by_size), reverse=True):
        total += rows
        if total > COMMON:
            break
        least = power
    got = counts.where(F.col("n") >= 1 << least).toPandas().sort_values("n") if total else None
    if got is None or not len(got):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, n = got["h"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _possible(x: str, y: str, similarity: float) -> Column:
    """Whether two texts that meet at this shingle, the first they share, can be similar: by size and by what is left."""
    n, m, left_n, left_m = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at")
    return ((F.least(n, m) >= F.greatest(n, m) * similarity - _SLACK)
            & (F.least(left_n, left_m) >= (n + m) * (similarity / (1 + similarity)) - _SLACK))


def _prints(words: int):
    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            prints = [fingerprint(zstandard.decompress(v.as_buffer()), words) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["key", "fp"])
    return work


def proposed_pairs(texts: DataFrame, words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """(a, b), a < b: pairs of keys that SimHash proposes; texts as in similar_links.

    Texts of one fingerprint meet the smallest key of it, and those keys meet along the links of the fingerprints.
    """
    prints = as_table(texts.select("key", "content").mapInArrow(_prints(words), "key bigint, fp bigint"))
    least = as_table(prints.groupBy("fp").agg(F.min("key").alias("least")))
    same = prints.join(least, "fp").select(F.col("key").alias("x"), F.col("least").alias("y"))
    near = (near_links(least.select("fp"), budget)
            .join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a")
            .join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select("x", "y"))
    return (same.union(near).where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def similar_links(texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links that connect all keys whose contents are similar, and no others. texts: key, n, content (compressed).

    First the pairs that fingerprints propose are compared, and every text meets the smallest and the largest key of each shingle. While too many texts that share a
    shingle are still apart, they meet one of them, another each turn; that is linear and joins large groups.
    In the end all that are still apart meet each other, however many they are.
    """
    texts = texts.where("n > 0").select("key", "content")
    common, often = _common(texts, words)
    first = as_table(texts.mapInArrow(_first(words, similarity, common, often), "h bigint, key bigint, n int, at int"))
    dealt = first.count()
    # Most shingles are of one text: counted by themselves, they go before wider rows are dealt out.
    several = as_table(first.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"))
    first = as_table(first.join(several, "h", "left_semi"))
    whole = F.struct("key", "n", "at")
    ends = (first.groupBy("h").agg(F.min(whole).alias("low"), F.max(whole).alias("high"))
            .where("low.key < high.key"))
    shared = as_table(first.join(ends, "h").select("h", whole.alias("one"), "low", "high"))

    def pairs(met: DataFrame, x: str, y: str) -> DataFrame:
        return met.where(_possible(x, y, similarity) & (F.col(f"{x}.key") != F.col(f"{y}.key"))).select(
            F.least(f"{x}.key", f"{y}.key").alias("a"), F.greatest(f"{x}.key", f"{y}.key").alias("b"))

    def alike(ab: DataFrame) -> DataFrame:
        left = texts.select(F.col("key").alias("a"), F.col("content").alias("x"))
        right = texts.select(F.col("key").alias("b"), F.col("content").alias("y"))
        return as_table(ab.join(left, "a").join(right, "b").select("a", "b", "x", "y")
                        .mapInArrow(_alike(words, similarity), "a bigint, b bigint"))

    tried = as_table(proposed_pairs(texts, words).union(pairs(shared, "one", "low")).union(pairs(shared, "one", "high"))
                     .distinct())
    links, most, turn = alike(tried), FULL * dealt, 0
    while True:
        root = as_table(connected_components(links))
        rooted = as_table(shared.select("h", "one", F.col("one.key").alias("node")).join(root, "node", "left")
                          .select("h", "one", F.coalesce("root", "node").alias("root")))
        apart = (rooted.groupBy("h", "root").agg(F.count("*").alias("n")).groupBy("h")
                 .agg(F.sum("n").cast("double").alias("rows"), F.sum(F.col("n") * F.col("n")).cast("double").alias("same"))
                 .where("rows * rows > same and rows > 2"))
        open_ = as_table(rooted.join(apart, "h"))
        met = apart.agg(F.sum((F.col("rows") * F.col("rows") - F.col("same")) / 2)).first()[0] or 0.0
        p = open_.select("h", F.col("one").alias("p"), F.col("root").alias("p_root"))
        last = met <= most or turn == TURNS
        if last:
            q = open_.select("h", F.col("one").alias("q"), F.col("root").alias("q_root"))
            both = p.join(q, "h").where("p.key < q.key and p_root <> q_root")
        else:
            q = open_.groupBy("h").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "h", "one.key").alias("by"), "one", "root"))
                                       .alias("q")).select("h", F.col("q.one").alias("q"), F.col("q.root").alias("q_root"))
            both = p.join(q, "h").where("p_root <> q_root")
        more = as_table(pairs(both, "p", "q").distinct().join(tried, ["a", "b"], "left_anti"))
        links = links.union(alike(more))
        if last:
            return links
        tried, turn = tried.union(more), turn + 1


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                       similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id: one row per input row, with the smallest doc_id reachable over similar texts.

    Texts with the same shingles are one; nulls and texts without words are one too. A component whose doc_ids
    are all null has a null component_id. Other columns are not read.
    """
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"),
                       text_or_empty(docs[f"`{text}`"]).cast("binary").alias("content"))
    rows = as_table(rows.mapInArrow(_keys(words), "doc_id bigint, key bigint, n int, content binary"))
    texts = as_table(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"),
                                             F.first("content").alias("content")))
    root = connected_components(similar_links(texts, words, similarity)).withColumnRenamed("node", "key")
    root = as_table(root.join(texts.select("key", "least"), "key"))
    reached = root.groupBy("root").agg(F.min("least").alias("reached"))
    classes = (texts.select("key", "least").join(root.join(reached, "root").select("key", "reached"), "key", "left")
               .select("key", F.coalesce("reached", "least").alias("component_id")))
    return rows.select("doc_id", "key").join(classes, "key").select("doc_id", "component_id")
