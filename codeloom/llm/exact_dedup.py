"""Exact duplicates by Grace hash partitioning and tables that compare whole contents."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from contextlib import ExitStack
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import as_table

from .common import batches, text_or_empty

#: Bytes of different contents a task holds at once before it spills, and files per spill.
TABLE_BYTES, FANOUT = 48 << 20, 16
_LOCAL = pa.schema([("digest", pa.binary()), ("content", pa.large_binary()), ("ids", pa.list_(pa.int64()))])
_MEMBER = pa.schema([("digest", pa.binary()), ("ordinal", pa.int64()), ("ids", pa.list_(pa.int64()))])


class ContentTable:
    """Open addressing with linear probing. Equal digests lead to a slot; only equal contents share it."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.entries: list[tuple[bytes, bytes, int]] = []  # digest, content, ordinal among equal digests
        self.bytes = 0

    def place(self, digest: bytes, content: bytes, ordinal: int = -1) -> int:
        """Index of the entry with this content, made if it is new."""
        if 2 * len(self.entries) >= len(self.slots):
            self._grow()
        mask, same = len(self.slots) - 1, 0
        at = int.from_bytes(digest[:8], "big") & mask
        while (i := self.slots[at]) >= 0:
            d, c, o = self.entries[i]
            if d == digest:
                if c == content:
                    return i
                same = max(same, o + 1)
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append((digest, content, same if ordinal < 0 else ordinal))
        self.bytes += len(content) + 150
        return len(self.entries) - 1

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for i, (digest, _, _) in enumerate(self.entries):
            at = int.from_bytes(digest[:8], "big") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def _collapse(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the copies that one task sees before anything is shuffled."""
    def rows() -> Iterator[tuple]:
        table, members, held = ContentTable(), [], 0

        def flush() -> Iterator[tuple]:
            for (digest, content, _), ids in zip(table.entries, members, strict=True):
                yield digest, content, ids

        for batch in incoming:
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_buffer().to_pybytes().lower()
                k = table.place(hashlib.sha256(content).digest(), content)
                if k == len(members):
                    members.append([])
                members[k].append(batch.column(0)[i].as_py())
                held += 16
                if table.bytes + held > TABLE_BYTES:
                    yield from flush()
                    table, members, held = ContentTable(), [], 0
        yield from flush()
    yield from batches(_LOCAL, rows())


def _classes(records: Iterator[tuple], depth: int = 0, room: int = TABLE_BYTES) -> Iterator[tuple]:
    """(digest, ordinal, ids) for each record; splits into files by the next digest bits when full."""
    table = ContentTable()
    with ExitStack() as stack:
        files: list = []
        for digest, content, ids, ordinal in records:
            if not files:
                d, _, o = table.entries[table.place(digest, content, ordinal)]
                if ids:
                    yield d, o, ids
                if table.bytes > room and len(table.entries) > 1 and depth < 2 * len(digest):
                    folder = Path(stack.enter_context(tempfile.TemporaryDirectory(prefix="grace-")))
                    paths = [folder / str(n) for n in range(FANOUT)]
                    files = [stack.enter_context(p.open("wb")) for p in paths]
                    for d, c, o in table.entries:
                        pickle.dump((d, c, [], o), files[_nibble(d, depth)])
                    table = ContentTable()
            else:
                pickle.dump((digest, content, ids, ordinal), files[_nibble(digest, depth)])
        if files:
            for f, p in zip(files, paths, strict=True):
                f.close()
                yield from _classes(_spilled(p), depth + 1, room)
                p.unlink()


def _nibble(digest: bytes, depth: int) -> int:
    return (digest[-1 - depth // 2] >> (4 * (depth % 2))) % FANOUT


def _spilled(path: Path) -> Iterator[tuple]:
    with path.open("rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _bucket(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[tuple]:
        for batch in incoming:
            for i in range(batch.num_rows):
                yield (batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), -1)
    yield from batches(_MEMBER, _classes(records()))


def duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, digest (SHA-256 of the text with A-Z lowered), ordinal.

    Rows have equal texts if and only if digest and ordinal agree; the ordinal tells apart different
    contents of one digest, which the tables would find because they compare whole contents.
    """
    slim = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"),
                       text_or_empty(docs[f"`{text}`"]).cast("binary").alias("content"))
    local = slim.mapInArrow(_collapse, "digest binary, content binary, ids array<bigint>")
    members = local.repartition("digest").mapInArrow(_bucket, "digest binary, ordinal bigint, ids array<bigint>")
    return as_table(members).select(F.explode("ids").alias("doc_id"), "digest", "ordinal")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, ordinal, keep_id, group_size, kept: one row per input row, dropped ones too.

    Of rows with equal texts (A-Z lowered, nulls as empty) the largest doc_id stays. Rows that repeat both
    doc_id and text cannot be told apart and carry the same answer. A null doc_id never wins against
    another; a group of nulls keeps null. Only texts reach the tables, so other columns cannot clash.

    Copies inside a task meet before the shuffle, so a text that fills a third of all rows sends one
    content per task. Class sizes are counted on ids alone, with partial sums.
    """
    rows = duplicate_classes(docs, doc_id, text)
    # A table of its own, so that the rows of a large class are split where they meet it.
    groups = rows.groupBy("digest", "ordinal").agg(F.max("doc_id").alias("keep_id"),
                                                   F.count("*").alias("group_size"))
    return rows.join(as_table(groups), ["digest", "ordinal"]).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
