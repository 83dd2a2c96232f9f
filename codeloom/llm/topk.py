"""Exact top-k inner products by distributed histogram selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.session import as_table

#: Rows of a candidate cell and of a query block at most (on average), bins of a histogram, and scores that
#: a task holds at once.
CELL, BLOCK, BINS, SCORES = 32768, 8192, 2048, 1 << 22
#: The range of a score, either way; products beyond it count as its end.
LARGEST = (1 << 63) - 1


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id, v (floor(scale * x) of every component), dim; only whole finite vectors with an id."""
    v = F.col(f"`{vector}`").cast("array<double>")
    return (vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("x"))
            .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()
                   & F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
            .select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"), F.size("x").alias("dim")))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; floating point is used only where every partial sum is exact."""
    most = np.abs(q.astype(float)).max(initial=0) * np.abs(c.astype(float)).max(initial=0) * max(1, q.shape[1])
    if most < 2 ** 53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    if most < 2 ** 62:
        return q @ c.T
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, -LARGEST, LARGEST).astype(np.int64)


def _scored(queries: pa.Table, cands: pa.Table):
    """(query position, scores, candidate ids) for one cell, a block of queries at a time."""
    if not len(queries) or not len(cands):
        return
    dim = queries["dim"][0].as_py()
    q, c = _matrix(queries["v"], dim), _matrix(cands["v"], dim)
    ids, own = cands["vec_id"].to_numpy(), queries["query_id"].to_numpy()
    step = max(1, SCORES // len(ids))
    for at in range(0, len(q), step):
        for k, s in enumerate(_products(q[at:at + step], c), at):
            other = ids != own[k]
            yield k, s[other], ids[other]


def _histograms(queries: pa.Table, cands: pa.Table) -> pa.Table:
    """(query_id, bin, n): counts of scores in [lo, hi] from the top down.

    Bins below the one that holds this cell's own need-th score are left out: over all cells the need-th
    score cannot lie lower.
    """
    out: list[list] = [[], [], []]
    lo, hi, need, qid = (queries[c].to_numpy() for c in ("lo", "hi", "need", "query_id"))
    for k, s, _ in _scored(queries, cands):
        width = -(-(int(hi[k]) - int(lo[k]) + 1) // BINS)
        inside = s[(s >= lo[k]) & (s <= hi[k])]
        below = np.uint64(int(hi[k]) % 2 ** 64) - inside.astype(np.int64).view(np.uint64)  # may pass what a long holds
        n = np.bincount((below // np.uint64(width)).astype(np.int64), minlength=1)
        bins = np.flatnonzero(n)
        upto = np.searchsorted(np.cumsum(n[bins]), need[k]) + 1
        bins = bins[:upto]
        for column, values in zip(out, (np.full(len(bins), qid[k]), bins, n[bins]), strict=True):
            column.append(values)
    return pa.table({name: np.concatenate([np.empty(0, np.int64), *c]).astype(np.int64)
                     for name, c in zip(("query_id", "bin", "n"), out, strict=True)})


def _winners(queries: pa.Table, cands: pa.Table) -> pa.Table:
    """(query_id, vec_id, score): all scores above the kth value, and as many equal ones as are needed."""
    out: list[list] = [[], [], []]
    kth, need, qid = (queries[c].to_numpy() for c in ("lo", "need", "query_id"))
    for k, s, ids in _scored(queries, cands):
        above, equal = s > kth[k], np.sort(ids[s == kth[k]])[:need[k]]
        out[0].append(np.full(above.sum() + len(equal), qid[k]))
        out[1] += [ids[above], equal]
        out[2] += [s[above], np.full(len(equal), kth[k])]
    return pa.table({name: np.concatenate([np.empty(0, np.int64), *c]).astype(np.int64)
                     for name, c in zip(("query_id", "vec_id", "score"), out, strict=True)})


def _over_cells(states: DataFrame, cands: DataFrame, cells: int, blocks: int, work, schema: str) -> DataFrame:
    """Every query block meets every candidate cell of its dimension, each pair in a task of its own."""
    q = states.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn(
        "cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    c = cands.withColumn("cell", F.pmod(F.xxhash64(F.lit(1), "vec_id", "row"), F.lit(cells)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return (q.groupBy("dim", "block", "cell").cogroup(c.groupBy("dim", "block", "cell"))
            .applyInArrow(work, schema))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id",
                vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of highest integer inner product for each query.

    Components become floor(scale * x). is_query is a condition on vec_id; candidates are all rows with
    another vec_id and as many components. Ties go to the smaller vec_id. Queries with fewer candidates get
    all of them. Vectors that are null, hold null or non-finite components or have no id take no part; of
    rows that repeat a query's id the smallest vector asks. Repeated candidates count each. Scores
    are exact over the whole range of a long; products beyond it count as its end and tie
    there. Other columns are not read.

    Each pass scores everything, cell by cell, and returns counts only: histograms of the score range in
    which each query's kth value must lie. Their sums narrow the range until it is one value, after a few
    passes whatever the number of rows. The last pass returns what is above the kth value, and of what
    equals it no more than is missing. Vectors are dealt out by hash, so common ones do not meet in one task.
    """
    rows = as_table(quantised(vectors, vec_id, vector, scale).withColumn("row", F.monotonically_increasing_id()))
    asked = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("dim", "v")).alias("q"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = rows.agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("norm")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    cells = int(max(1, -(-size.n // CELL), min(2 * cores, size.n // 1024)))
    bound = F.ceil(F.least(F.sqrt(square) * float(size.norm or 0) * 1.001 + 1, F.lit(float(LARGEST))))
    states = as_table(asked.select("query_id", "q.dim", "q.v").withColumns(
        {"lo": -bound, "hi": bound, "need": F.lit(k).cast("long")}))
    blocks = int(max(1, -(-states.count() // BLOCK)))

    while not states.where("lo < hi").isEmpty():
        active = states.where("lo < hi")
        counts = (_over_cells(active, rows, cells, blocks, _histograms, "query_id bigint, bin bigint, n bigint")
                  .groupBy("query_id", "bin").agg(F.sum("n").alias("n")))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("query_id").orderBy("bin")))
        found = (upto.join(active.select("query_id", "need"), "query_id").where("upto >= need")
                 .groupBy("query_id").agg(F.min(F.struct("bin", "upto", "n")).alias("f")))
        lo, hi, at = (F.col(c).cast("decimal(20,0)") for c in ("lo", "hi", "f.bin"))  # differences pass a long
        width = F.ceil((hi - lo + 1).cast("decimal(38,0)") / BINS).cast("decimal(20,0)")
        top = hi - at * width
        open_ = F.col("lo") < F.col("hi")
        states = as_table(states.join(found, "query_id", "left").select(
            "query_id", "dim", "v",
            F.when(open_ & F.col("f").isNotNull(), F.greatest(lo, top - width + 1).cast("long"))
            .otherwise(F.col("lo")).alias("lo"),
            # fewer scores than asked for: everything from lo on is wanted
            F.when(~open_, F.col("hi")).when(F.col("f").isNotNull(), top.cast("long")).otherwise(F.col("lo")).alias("hi"),
            F.when(open_ & F.col("f").isNotNull(), F.col("need") - F.col("f.upto") + F.col("f.n"))
            .otherwise(F.col("need")).alias("need")))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    won = _over_cells(states, rows, cells, blocks, _winners, "query_id bigint, vec_id bigint, score bigint")
    return (won.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
