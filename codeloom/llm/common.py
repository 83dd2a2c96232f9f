"""Column expressions and small helpers shared by the operators of this folder."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the contracts count it.
BLANKS = " \t\n\x0b\x0c\r"


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII strings take the fast byte-wise way."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def fingerprint128(c: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a string: one seeded plainly, one through a constant."""
    return F.xxhash64(c), F.xxhash64(F.lit(7), c)


def held_out(c: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def without(df: DataFrame, *names: str) -> list[Column]:
    """The columns of df except those an operator is about to produce under the same name."""
    taken = {n.lower() for n in names}
    return [df[f"`{c}`"] for c in df.columns if c.lower() not in taken]


def batches(schema: pa.Schema, rows: Iterator[tuple], most_rows: int = 4096,
            most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Pack tuples into record batches of bounded size; strings and bytes count by length."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (bytes, str, list)))
        if len(held) >= most_rows or size >= most_bytes:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(v, type=f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)
