"""Progress of a run as a stream: one line after each stage."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.document import State, stages


def caption(stage: str, st: State) -> str:
    if stage == "analyze":
        return f"{st.analysis.symbols.count()} symbols, {st.analysis.edges.count()} edges"
    if stage == "map":
        return f"{st.notes.count()} notes, {st.components.count()} components"
    if stage == "write":
        return f"{st.sections.count()} sections"
    if stage.startswith("review"):
        t = st.reviews.agg(F.count_if("passed").alias("ok"), F.count("*").alias("n")).first()
        return f"{t.ok} of {t.n} sections verified"
    return f"round {st.round}"


def follow(files: DataFrame, **options) -> Iterator[tuple[str, str, State]]:
    """(stage, caption, state) as soon as each stage is done."""
    for stage, st in stages(files, **options):
        yield stage, caption(stage, st), st
