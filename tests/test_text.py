import json
import pytest
from codeloom.functions import text
from codeloom.operators import findings, retrieval
from codeloom.sources import code_tree
from pyspark.sql import functions as F


@pytest.fixture
def each(spark):
    def run(fn, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r[1] for r in df.select("i", fn("v")).orderBy("i").collect()]
    return run


def test_json_salvage(each):
    raw = ['{"a": 1}', 'Here:\n```json\n{"a": 1}\n```\nBye {', 'Sure! {"a": 1} ok', "```\n[1, 2]\n```",
           '{"n": {"b": [1, {"c": 2}]}}']
    assert [json.loads(x) for x in each(text.json_text, raw)] == [
        {"a": 1}, {"a": 1}, {"a": 1}, [1, 2], {"n": {"b": [1, {"c": 2}]}}]


def test_mentions(each):
    body = "Use `app.run()` and `**kwargs`, `'Key'`, `a=1`, `.env`, `src/x.py`, `abc`, ` Name `.\n`x\ny`"
    found = each(text.mentions, [body])[0]
    assert found[:2] == ["app.run()", "**kwargs"] and found[-1] == "Name"
    tokens = each(lambda c: F.transform(text.mentions(c), text.mention_token), [body])[0]
    assert [t for t in tokens if t] == ["app.run", "kwargs", "Name"]


def test_fences(each):
    body = "Use `x`.\n```python\ndef go():\n    y = 1\nif y == 2: pass\n```\nafter `go`"
    assert "def go" not in each(text.without_fences, [body])[0]
    assert sorted(each(text.self_defined, [body])[0]) == ["go", "y"]
    assert "pass" in each(text.example_names, [body])[0]
    assert [(b.lang, b.body[:6]) for b in each(text.fenced, [body])[0]] == [("python", "def go")]


def test_labels(each):
    assert each(text.short_purpose, [
        "Converts a view function's return value into a response", "splits text, then joins", "of the"
    ]) == ["Converts a view function's return value", "Splits text", ""]
    assert each(text.title_from_name, ["m._select_central", "m.PaperBlock", "m.__", "run"]) == [
        "Select central", "PaperBlock", "__", "Run"]
    assert each(text.name_severity, ["a.b", "a_b", "FooBar", "Key", "key"]) == [
        "error", "error", "error", "warning", "warning"]
    assert each(text.dependency_name, ["Click>=8.1", "foo[x]>=1; y", " bar ~= 2"]) == [
        "click", "foo", "bar"]
    assert each(text.heading_slug, ["What's `new` here?"]) == ["whats-new-here"]


def test_clean_body(each):
    assert each(text.clean_body, ["It — well – runs `a` (Orchestrator) a–b.\n\nCalls (verified): `x`\ny"]
                ) == ["It, well, runs `a` a-b."]


def test_lines_like_python(each):
    raw = ["a\r\nb\rc\n", "", "x\n\ny", "p\x0bq\x0cr" + chr(0x2028) + "s"]
    assert each(text.lines, raw) == [r.splitlines() for r in raw]


def test_paths(spark):
    want = {"a.py": (False, False), "tests/a.py": (False, True), "x/test_a.py": (False, True),
            "x/a.spec.ts": (False, True), "node_modules/a.js": (True, False), "setup.py": (False, True),
            "docs/a.py": (True, False), "test": (False, False)}
    df = spark.createDataFrame([(p,) for p in want], "path string")
    got = {r.path: (r.s, r.t) for r in df.select("path", code_tree.skipped().alias("s"),
                                                code_tree.is_test_path().alias("t")).collect()}
    assert got == want


def test_windows_cover_the_text():
    lines = [f"    line_{i} = compute({i})" for i in range(200)]
    w = retrieval.line_windows(lines, 1000, 8)
    assert w[0][1] == 0 and all(len(t) <= 1000 for t, _ in w) and len(w) > 1
    assert all(b[1] > a[1] for a, b in zip(w, w[1:]))
    assert {ln for t, _ in w for ln in t.split("\n")} == set(lines)
    assert retrieval.line_windows(["x" * 3000, "y"], 1000, 8) == [("x" * 3000, 0), ("y", 1)]


def test_annotation_rules(spark):
    df = spark.createDataFrame([("def f(x):",), ("def f(x: int):",), ("def f(x,",), ("def f(x) -> int:",)],
                               "source string")
    got = df.select(findings.annotated().alias("a"), findings.annotated(True).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(True, False), (True, True), (False, False), (True, True)]


def test_a_first_letter_stays_one_letter(each):
    assert each(text.short_purpose, ["\u00dfen geht", "\ufb01nds names", "\u1fb3 x", "\u00e4pfel"]) == [
        "\u1e9een geht", "\ufb01nds names", "\u1fbc x", "\u00c4pfel"]
