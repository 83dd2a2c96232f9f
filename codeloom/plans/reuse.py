"""Saved runs that are whole or not there, and maps that are built again only where something changed."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import modules
from ..operators.generation import Completer, FactCompleter
from ..operators.symbols import Analysis
from ..session import as_table
from ..sources import artifacts
from ..sources.snapshots import Snapshots
from .document import State, stage_map


class Runs:
    """Maps, drafts and reviews of repositories under one folder, a version for each save.

    A save writes all its tables and then the pointer. Readers follow the pointer, so a save that breaks off
    changes nothing, and map, draft and review always come from the same run.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.tables = Snapshots(spark, f"{root.rstrip('/')}/runs")

    def save(self, **kinds: DataFrame) -> int:
        """Replace the repositories of each kind's rows. Other repositories, and kinds not given, are carried over."""
        last = self.tables.current()
        version = 0 if last is None else last + 1
        known = self._kinds(last) if last is not None else []
        for kind in sorted({*kinds, *known}):
            rows = kinds.get(kind)
            if kind in known:
                old = self.tables.read(kind, last)
                rows = old if rows is None else old.join(rows.select("repo").distinct(), "repo", "left_anti") \
                    .unionByName(rows, allowMissingColumns=True)
            self.tables.write(rows, kind, version)
        self.tables.finish(version)
        return version

    def _kinds(self, version: int) -> list[str]:
        return [k for k in artifacts.KINDS if self.tables.has(k, version)]

    def load(self, kind: str) -> DataFrame:
        return self.tables.read(kind)

    def repos(self) -> DataFrame:
        """Repositories with a finished run."""
        return self.load("map").select("repo").distinct()

    def load_all(self, repo: str) -> dict[str, DataFrame]:
        """Map, draft and review of one repository, or an error that names what is missing."""
        now = self.tables.current()
        held = {k: self.tables.read(k, now).where(F.col("repo") == repo) for k in (self._kinds(now) if now is not None else ())}
        missing = [k for k in artifacts.KINDS if k not in held or held[k].isEmpty()]
        if missing:
            raise FileNotFoundError(f"no saved {', '.join(missing)} for {repo!r} under {self.tables.root}")
        return held


def _only(a: Analysis, repos: DataFrame) -> Analysis:
    return Analysis(**{f.name: getattr(a, f.name).join(repos, "repo", "left_semi") for f in fields(a)})


def map_key(a: Analysis, top: int, subdir: str) -> DataFrame:
    """(repo, version): of what a map is made of. Another size or folder of the map is another map."""
    return artifacts.content_key(a).withColumn("version", F.concat_ws(
        "|", "version", F.lit(str(top)), F.lit(subdir.strip("/"))))


def build_map(a: Analysis, top: int, completer: Completer) -> DataFrame:
    st = State(files=a.files, analysis=a)
    stage_map(st, completer, top)
    return artifacts.repo_map(st.notes, st.components, st.entry, modules.surface_counts(a.symbols, a.edges))


def load_or_build_map(runs: Runs, a: Analysis, top: int = 10, subdir: str = "",
                      completer: Completer | None = None) -> tuple[DataFrame, int]:
    """The maps of all repositories of `a`, saved ones where nothing changed, and how many had to be built.

    Built ones are saved with their key, so that the next call finds them. Only stale repositories are ranked and
    described; when none is, no prompt is made.
    """
    key = map_key(a, top, subdir)
    if runs.tables.current() is not None and runs.tables.has("map", runs.tables.current()) and "version" in runs.load("map").columns:
        stale = as_table(key.join(runs.load("map").select("repo", "version"), ["repo", "version"], "left_anti"))
    else:
        stale = as_table(key)
    n = stale.count()
    if n:
        built = build_map(_only(a, stale.select("repo")), top, completer or FactCompleter())
        runs.save(map=built.join(stale, "repo"))
    return runs.load("map").join(key.select("repo"), "repo", "left_semi"), n
