import pytest

from codeloom.operators.callgraph import analyze_files
from codeloom.plans import reuse
from codeloom.plans.reuse import Runs, load_or_build_map

FILES = "repo string, path string, content binary"


def kind(spark, text, *repos):
    return spark.createDataFrame([(r, text) for r in repos], "repo string, body string")


def test_a_save_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    runs = Runs(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="map, draft, review"):
        runs.load_all("007")
    runs.save(map=kind(spark, "one", "007", "b"), draft=kind(spark, "one", "007"), review=kind(spark, "one", "007"))
    write = type(runs.tables).write

    def broken(self, df, name, version, *by):
        return write(self, df, name, version, *by) if name == "draft" else 1 / 0
    with monkeypatch.context() as m:
        m.setattr(type(runs.tables), "write", broken)
        with pytest.raises(ZeroDivisionError):
            runs.save(map=kind(spark, "two", "007"), draft=kind(spark, "two", "007"), review=kind(spark, "two", "007"))
    assert {k: v.first().body for k, v in runs.load_all("007").items()} == {"map": "one", "draft": "one", "review": "one"}
    runs.save(map=kind(spark, "two", "007", "c"), draft=kind(spark, "two", "007"), review=kind(spark, "two", "007"))
    assert {v.first().body for v in runs.load_all("007").values()} == {"two"}
    assert {r.repo for r in runs.repos().collect()} == {"007", "b", "c"}
    with pytest.raises(FileNotFoundError, match="draft, review"):
        runs.load_all("b")


def test_maps_are_built_again_only_where_something_changed(spark, tmp_path, monkeypatch):
    def analysis(**bodies):
        return analyze_files(spark.createDataFrame(
            [(r, "m.py", bytearray(f"def f():\n    return g()\n\n\ndef g():\n    return {b}\n".encode())) for r, b in bodies.items()], FILES))
    built = []
    build = reuse.build_map
    monkeypatch.setattr(reuse, "build_map", lambda a, top, c: built.append(
        sorted(x.repo for x in a.symbols.select("repo").distinct().collect())) or build(a, top, c))
    runs, now = Runs(spark, str(tmp_path)), analysis(a=1, b=2)
    maps, n = load_or_build_map(runs, now)
    assert n == 2 and {(x.repo, x.total_symbols, x.total_edges) for x in maps.collect()} == {("a", 2, 1), ("b", 2, 1)}
    assert load_or_build_map(runs, now)[1] == 0
    maps, n = load_or_build_map(runs, analysis(a=1, b=3))
    assert n == 1 and maps.count() == 2
    assert load_or_build_map(runs, analysis(a=1), top=3)[1] == 1 and load_or_build_map(runs, analysis(a=1), top=3)[1] == 0
    assert built == [["a", "b"], ["b"], ["a"]]
