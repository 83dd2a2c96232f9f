"""Source files to definitions, attributes and parse errors."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed, text
from ..functions.python_source import read_attributes, read_names, read_python
from ..functions.script_source import read_script
from ..schemas import NAMES, PARSED
from ..session import as_table, ordinal


def language(path: str | Column) -> Column:
    """Language by file suffix, null when none owns it. A bare dot name has no suffix."""
    path, out = text.col(path), None
    for name, (extensions, _) in fixed.LANGUAGES.items():
        owned = path.rlike("[^/](?:" + "|".join(e.replace(".", "[.]") for e in extensions) + ")$")
        out = F.when(owned, name) if out is None else out.when(owned, name)
    return out


def module_qualname(path: str | Column) -> Column:
    """`src/pkg/app.py` is `pkg.app`; `src/pkg/index.ts` is `pkg`."""
    path = text.col(path)
    bare = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    inside = F.when(path.endswith(".py"), F.regexp_replace(bare, "^(?:(?:src|lib)(?:/|$))+", "")) \
              .otherwise(F.regexp_replace(bare, "^(?:(?:src|lib|dist)(?:/|$))+", ""))
    return F.replace(F.regexp_replace(inside, "(?:^|/)(?:__init__|index)$", ""),
                     F.lit("/"), F.lit("."))


def _column(values: list, shape: pa.DataType) -> pa.Array:
    """Values as Arrow, field by field: no type is looked up value by value."""
    if pa.types.is_list(shape) and None not in values:
        ends = np.cumsum([0, *map(len, values)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _column([x for v in values for x in v], shape.value_type),
                                        type=shape)
    if pa.types.is_struct(shape) and None not in values:
        return pa.StructArray.from_arrays([_column([v[f.name] for v in values], f.type) for f in shape], fields=list(shape))
    return pa.array(values, shape)


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Python's search for cycles rests: trees and rows hold none, and it would walk all rows read so far again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@F.arrow_udf(PARSED)
def _parse(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    shape = to_arrow_type(PARSED)
    for batch in batches:
        rows = []
        with _no_cycles():
            for data, mod, rel, kind in zip(*(column.to_pylist() for column in batch)):
                if data is None:
                    rows.append({"defs": [], "attributes": [], "error": f"{rel}: cannot be read"})
                else:
                    read = read_python if kind == "python" else read_script
                    rows.append(read(data, mod, rel))
            parsed = _column(rows, shape)
        yield parsed


@F.arrow_udf(NAMES)
def _names(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    shape = to_arrow_type(NAMES)
    for batch in batches:
        with _no_cycles():
            named = _column([{"defs": [], "attributes": []} if data is None else (read_names if kind == "python" else read_script)(data, mod, rel)
                             for data, mod, rel, kind in zip(*(column.to_pylist() for column in batch))], shape)
        yield named


@F.arrow_udf(T.ArrayType(T.StringType()))
def _attributes(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([[] if data is None else read_attributes(data) if kind == "python"
                        else read_script(data, mod, rel)["attributes"]
                        for data, mod, rel, kind in zip(*(column.to_pylist() for column in batch))], pa.list_(pa.string()))


# Not duplicated by the optimizer into filters on their own result.
_parse, _names, _attributes = _parse.asNondeterministic(), _names.asNondeterministic(), _attributes.asNondeterministic()


def parse_files(files: DataFrame) -> DataFrame:
    """One row per source file: (repo, file, parsed). Unknown languages are dropped first.

    Files are parsed where they are read; the readers deal paths out before content is opened.
    """
    return _read(files, _parse)


def parse_names(files: DataFrame) -> DataFrame:
    """parse_files with the names, parameters and lines of definitions alone, for what asks for no text or calls."""
    return _read(files, _names)


def _read(files: DataFrame, reader: Callable[..., Column]) -> DataFrame:
    known = files.where(language("path").isNotNull())
    return known.select("repo", F.col("path").alias("file"), reader(
        F.col("content"), module_qualname("path"), F.col("path"), language("path")).alias("parsed"))


def definitions(parsed: DataFrame) -> DataFrame:
    """One row per definition of each file, before duplicates across files are settled."""
    return parsed.select("repo", "file", F.explode("parsed.defs").alias("d")) \
                 .select("repo", "file", "d.*")


def _may_clash(defs: DataFrame) -> DataFrame:
    """(repo, file) of the files that may define a qualname which another file defines too.

    A definition's qualname continues its file's module, so the modules of two such files are equal or one
    continues the other. Files with a module of their own need no look at their definitions. Where a
    qualname does not continue its module, all files of the repository are looked at.
    """
    at = defs.select("repo", "file", "qualname", module_qualname("file").alias("module"))
    odd = ~((F.col("module") == "") | F.col("qualname").startswith(F.concat("module", F.lit("."))))
    files = at.groupBy("repo", "file", "module").agg(F.max(odd).alias("odd"))
    parts = F.split("module", "[.]")
    # The module itself and every shorter dotted prefix of it; all modules continue the empty one.
    outer = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))))
    spread = files.select("repo", "file", "module", "odd", F.explode(outer).alias("key"))
    met = (spread.groupBy("repo", "key")
           .agg(F.count_if(F.col("key") == F.col("module")).alias("owners"), F.count("*").alias("n"), F.max("odd").alias("odd"))
           .where("n > 1 and (owners > 0 or odd)").select("repo", "key"))
    return spread.join(met, ["repo", "key"], "left_semi").select("repo", "file").distinct()


def unique_symbols(defs: DataFrame) -> DataFrame:
    """One row per (repo, qualname): the last file's definition, at the first one's position.

    Files are ordered folder by folder, so what is in `pkg/` comes before `pkg.py`.

    Modules tell which files may clash at all; only narrow keys of their definitions are grouped. The wide
    rows stay where they are unless more than one file defines a qualname.
    """
    parts = F.split("file", "/").alias("parts")
    kept = defs.withColumn("ord", ordinal(parts, "pos"))
    suspects = as_table(_may_clash(defs))
    if not suspects.isEmpty():
        clashes = (defs.select("repo", "file", "qualname", "pos").join(suspects, ["repo", "file"], "left_semi")
                   .groupBy("repo", "qualname")
                   .agg(F.max(F.struct(parts, "file")).alias("last"), F.min("file").alias("one_file"),
                        F.min(ordinal(parts, "pos")).alias("first_ord"))
                   .where("one_file <> last.file or first_ord.parts <> last.parts")
                   .select("repo", "qualname", F.col("last.file").alias("last_file"), "first_ord"))
        kept = (defs.join(as_table(clashes), ["repo", "qualname"], "left")
                .where("last_file is null or file = last_file")
                .withColumn("ord", F.coalesce("first_ord", ordinal(parts, "pos")))
                .drop("last_file", "first_ord"))
    return kept.withColumn("line_count", F.expr("end_line - start_line + 1")).drop("pos")


def attribute_names(parsed: DataFrame) -> DataFrame:
    """Distinct instance attributes per repository."""
    return parsed.select("repo", F.explode("parsed.attributes").alias("name")).distinct()


def attributes_of_files(files: DataFrame) -> DataFrame:
    """attribute_names of files that are read for nothing else: no definition leaves the parser."""
    known = files.where(language("path").isNotNull())
    return known.select("repo", F.explode(_attributes(
        F.col("content"), module_qualname("path"), F.col("path"), language("path"))).alias("name")).distinct()


def parse_errors(parsed: DataFrame) -> DataFrame:
    return (parsed.where(F.col("parsed.error").isNotNull())
            .select("repo", "file", F.col("parsed.error").alias("error")))


def kind_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("repo", "kind").agg(F.count("*").alias("n"))


# ---- public API names ---------------------------------------------------------------

def exported_names(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Names each repository declares public, as distinct (repo, name)."""
    parts = F.split("path", "/")
    init = files.where(
        text.base_name("path").eqNullSafe("__init__.py")
        & ~F.arrays_overlap(parts, F.array(*[F.lit(p) for p in fixed.SKIP_DIRS
                                             + fixed.TEST_DIRS])))
    line = init.select("repo", F.explode(text.lines(
        F.make_valid_utf8(F.col("content").cast("string")))).alias("line")) \
        .select("repo", text.strip("line").alias("line"))
    imported = (line.where(F.col("line").startswith("from .") & F.col("line").contains(" import "))
                .select("repo", F.explode(F.split(F.regexp_replace(
                    "line", "^.*? import ", ""), ",")).alias("part"))
                .select("repo", F.regexp_replace(text.strip("part"), "^[()]+|[()]+$", "").alias("part"))
                .select("repo", text.strip(F.substring_index("part", " as ", -1)).alias("name")))
    listed = (line.where(F.col("line").startswith("__all__")
                         & ~F.col("line").startswith("from ."))
              .select("repo", F.explode(F.split(F.translate(F.regexp_replace(
                  "line", "^[^=]*=", ""), "[]", "  "), ",")).alias("part"))
              .select("repo", F.regexp_replace(
                  text.strip("part"), "^[\"']+|[\"']+$", "").alias("name")))
    marked = symbols.where("exported").select("repo", "name")
    return (imported.unionByName(listed).unionByName(marked)
            .where(F.col("name").rlike(r"^[\p{L}_][\p{L}\p{N}_]*$")).distinct())


@dataclass
class Analysis:
    """The relations of an analysed corpus. Each is a DataFrame keyed by ``repo``."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    unresolved: DataFrame
    attributes: DataFrame
    errors: DataFrame
    exports: DataFrame
