import json

import pytest
from codeloom.functions import fixed
from codeloom.operators import dependencies, examples, findings, retrieval
from codeloom.operators.generation import FactCompleter, FunctionCompleter
from codeloom.plans import document, render
from codeloom.sources import artifacts, code_tree, manifests
from pyspark.sql import functions as F

from conftest import GARDEN


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("src") / "plot"
    for path, body in {
        "src/plot/__init__.py": "from .garden import Tomato as Tomato, water\n__all__ = ['Plant']\n",
        "src/plot/garden.py": GARDEN, "src/plot/__main__.py": "print(1)\n",
        "examples/demo/__init__.py": "from .x import blog\n",
        "tests/test_garden.py": "def test_water():\n    assert water(1) == 2\n\n\ndef test_long():\n"
                                "    x = water\n    return x\n",
        "web/app.test.js": "test()", "web/ui.tsx": "export function Ui() { return draw(); }",
        "pyproject.toml": '[project]\nname = "plot"\ndependencies = ["click>=8"]\n',
        "README.md": "```bash\n$ pip install plot\n```\n```python\nimport plot\n```\n",
    }.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)
    return root


@pytest.fixture(scope="module")
def files(spark, tree):
    return code_tree.read_tree(spark, str(tree)).cache()


def test_every_file_is_seen(files):
    kept = {r.path for r in code_tree.source_files(files).collect()}
    assert kept == {"src/plot/__init__.py", "src/plot/garden.py", "src/plot/__main__.py", "web/ui.tsx"}
    assert {r.path for r in code_tree.source_files(files, subdir="web").collect()} == {"web/ui.tsx"}
    assert [(r.folder, r.n) for r in code_tree.suggest_subdirs(files).orderBy("rank").collect()] == [
        ("src", 3), ("web", 1)]
    with pytest.raises(FileNotFoundError, match="examples, src, tests, web"):
        code_tree.check_folder(files, "nope")


def test_manifest_and_steps(files):
    m = manifests.read_manifest(files, code_tree.source_files(files))
    r = m.first()
    assert (r["name"], r.dependencies, r.install_cmds) == ("plot", ["click>=8"], ["pip install plot"])
    assert r.runnable_modules == ["src/plot/__main__.py"] and r.has_tests
    body = render.getting_started(m).first().body
    steps = [ln for ln in body.splitlines() if ln.startswith("### ")]
    assert [s[4] for s in steps] == ["1", "2", "3", "4"]
    empty = files.where("path = 'web/ui.tsx'")
    assert render.getting_started(manifests.read_manifest(empty)).count() == 0


class Liar(FactCompleter):
    """Writes one false call into every component and names an invented function."""

    def _write(self):
        return F.concat(super()._write(), F.lit("\n\nHere `water` calls `grow`. Also `turbo_fill` helps."))


def test_loop_finds_and_removes_what_is_false(spark, files, tree):
    seen = [(name, st.reviews.where("not passed").count() if st.reviews else None)
            for name, st in document.stages(files, top=4, completer=Liar())]
    names = [n for n, _ in seen]
    assert names == ["analyze", "map", "write", "review 0", "revise 1", "review 1"]
    assert seen[3][1] > 0 and seen[-1][1] == 0
    st = document.run(files, top=4)
    assert {r.name for r in st.analysis.exports.collect()} == {"Tomato", "water", "Plant", "Ui"}
    kept = code_tree.source_files(files)
    body = render.build_documents(st, manifests.read_manifest(files, kept), kept).first().body
    for head in ("# plot", "## Contents", "## Getting started", "## Architecture", "```mermaid",
                 "## Symbol reference", "## Verification report", "## Limits"):
        assert head in body
    out = str(tree.parent / "out")
    from codeloom.operators.modules import surface_counts
    counts = surface_counts(st.analysis.symbols, st.analysis.edges)
    artifacts.save(artifacts.repo_map(st.notes, st.components, st.entry, counts), out, "map")
    with pytest.raises(FileNotFoundError, match="draft, review"):
        artifacts.load_all(spark, out, "plot")
    artifacts.save(artifacts.draft(st.sections), out, "draft")
    artifacts.save(artifacts.review(st.reviews, st.issues), out, "review")
    assert artifacts.load_all(spark, out, "plot")["draft"].first().sections[0].key == "overview"


def test_findings_order(garden, files):
    f = findings.findings(garden.symbols, garden.edges, garden.exports,
                          files.select("repo", "path")).collect()
    assert {r.ord for r in f} == {0, 1, 3, 4, 5}
    body = findings.findings_markdown(findings.findings(
        garden.symbols, garden.edges, garden.exports, files.select("repo", "path"))).first().body
    good = ["Every private", "No two files", "Tests in 1 file", "100% of signatures"]
    assert [any(g in ln for g in good) for ln in body.splitlines()] == sorted(
        any(g in ln for g in good) for ln in body.splitlines())


def test_examples_prefer_calls(spark, files):
    from codeloom.operators.callgraph import analyze_files
    tests = analyze_files(code_tree.test_sources(files)).symbols
    want = spark.createDataFrame([("plot", "plot.garden.water"), ("plot", "x.it")], "repo string, name string")
    got = examples.find_examples(want, tests).orderBy("rank").collect()
    assert [(r.uses, r.name) for r in got] == [("water", "test_water"), ("water", "test_long")]


def test_answer_states(spark, garden, files):
    e = retrieval.HashingEmbedder(32)
    vectors = e.embed(retrieval.build_chunks(garden.symbols, garden.edges), "text")
    q = list(e.embed(spark.createDataFrame([("water",)], "text string"), "text").first()["embedding"])

    def reply(coverage):
        said = json.dumps({"answer": "ok", "coverage": coverage})
        return FunctionCompleter(lambda prompts: [said] * len(prompts))

    one = lambda c, v=vectors: document.ask("how", garden, v, q, c, verify=False).first()
    assert one(reply("background")).provenance.startswith("from general knowledge")
    assert one(reply("odd")).coverage == "grounded"
    from codeloom.operators.callgraph import analyze_files
    tests = analyze_files(code_tree.test_sources(files)).symbols
    named = FunctionCompleter(lambda prompts: [json.dumps({
        "answer": "see `water()`", "coverage": "grounded" if "(a garden)" in prompts[0] else "background"})] * len(prompts))
    about = spark.createDataFrame([("plot", "a garden")], "repo string, summary string")
    full = document.ask("how", garden, vectors, q, named, verify=False, tests=tests, summaries=about).first()
    assert full.sources[0].score == full.best_score and "garden.water" in {s.qualname for s in full.sources}
    assert full.example.startswith("def test_water")
    told = document.ask("how", garden, vectors, q, reply("background"), verify=False, tests=tests).first()
    assert told.example is None and told.sources
    none = one(reply("grounded"), vectors.where("false"))
    assert none.sources is None
    assert none.coverage == "insufficient" and none.best_score == 0.0


def test_failed_reply_is_marked(spark, garden):
    from codeloom.operators import generation, ranking
    notes = ranking.rank_symbols(garden.symbols, garden.edges, garden.exports, 3)

    def broken(prompts):
        raise RuntimeError("down")

    out = generation.describe_symbols(notes, garden.symbols, garden.edges, FunctionCompleter(broken))
    assert {(r.purpose, r.confidence) for r in out.collect()} == {("(failed: no valid reply)", "low")}


def test_tables_of_a_run_are_dropped(spark, monkeypatch):
    import os

    from codeloom import session
    monkeypatch.setattr(session, "_TABLES", [])
    kept = session.as_table(spark.range(3))
    folder = session._TABLES[0].removeprefix("file:")
    assert kept.count() == 3 and os.path.isdir(folder)
    session.drop_tables(spark)
    assert not os.path.exists(folder) and not session._TABLES


def test_command_line_keeps_every_row(spark, tree, tmp_path, capsys, monkeypatch):
    from codeloom import cli
    monkeypatch.setattr(cli, "drop_tables", lambda spark: None)  # other tests still read theirs
    cli.main(["files", str(tree)])
    assert len(capsys.readouterr().out.splitlines()) == 4
    cli.main(["files", str(tree), "--limit", "3"])
    assert capsys.readouterr().out.splitlines()[-1].startswith("... 1 more rows")
    cli.main(["manifest", str(tree)])
    said = capsys.readouterr().out
    assert "examples/demo" not in said and "src/plot/__main__.py" in said
    cli.main(["rank", str(tree), "--subdir", "web", "--out", str(tmp_path)])
    rows = [json.loads(ln) for f in tmp_path.glob("rank/*.json") for ln in f.read_text().splitlines()]
    assert [r["qualname"] for r in rows] == ["web.ui.Ui"]
    for _ in range(2):
        cli.main(["search", str(tree), "water", "--out", str(tmp_path)])
        hits = [json.loads(ln) for f in tmp_path.glob("search/*.json") for ln in f.read_text().splitlines()]
        assert len(hits) == 5


def test_packaging_is_read_once(spark, tree):
    listed = code_tree.list_tree(spark, str(tree))
    plan = manifests.read_manifest(code_tree.contents(listed.where(code_tree.packaging())), None, listed)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in text  # the content is a stored table by now


class Knows(FactCompleter):
    """Answers about alternatives with the given text."""

    def __init__(self, said):
        self.said = said

    def _alternatives(self):
        return F.when(F.col("repo") == "app", self.said)


PACKAGES = [("requests", "HTTP client for people", "Apache-2.0", "https://r.example", [], [1.0, 0.0]),
            ("httpx", "HTTP client, also async", "BSD", "https://h.example", ["certifi"], [0.8, 0.6]),
            ("httpx", "HTTP client, also async", "BSD", "https://h.example", ["certifi"], [0.8, 0.6]),
            ("grequests", "requests in parallel", None, "", ["requests"], [1.0, 0.0]),
            ("pandas", "tables", "BSD", "", [], [0.0, 1.0]), ("mute", None, None, None, [], [0.0, 1.0])]


def test_alternatives_from_reply_to_text(spark):
    deps = spark.createDataFrame([("app", 0, "Requests>=2"), ("app", 1, "tiny"), ("app", 2, "requests[socks]"), ("app", 3, ""),
                                  ("mum", 0, "requests")], "repo string, ord int, spec string")
    packages = spark.createDataFrame(PACKAGES, "name string, summary string, license string, home string, requires "
                                     "array<string>, embedding array<double>").withColumn("_v", F.lit(fixed.PACKAGE_VERSION))
    said = json.dumps({"alternatives": [
        {"dependency": "requests", "does": " talks HTTP ", "substitutes": ["httpx==1", "HTTPX", "grequests", "late"]},
        {"dependency": "requests", "does": "again", "substitutes": ["mute"]},
        {"dependency": "unasked", "does": "x", "substitutes": ["httpx"]}, {"does": "nobody"}]})
    found = dependencies.find_alternatives(deps, packages, Knows(said))
    got = {(r.repo, r.dependency, r.candidate): r for r in found.collect()}
    assert set(got) == {("app", "requests", "httpx"), ("app", "requests", "grequests"), ("app", "tiny", None),
                        ("mum", "requests", None)}
    r = got["app", "requests", "httpx"]
    assert (r.does, r.license, r.home, r.relevance, r.rejected) == ("talks HTTP", "BSD", "https://h.example", 0.8, None)
    body = {r.repo: r.body for r in render.alternatives_text(found).collect()}
    assert body["app"] == ("**`requests`**, here for: talks HTTP\n\n- [httpx](https://h.example): HTTP client, also async; "
                           "license BSD; closeness 0.80\n\n**`tiny`**\n\n- No proposal passed.\n\n"
                           "Not taken: grequests (needs requests itself).")
    assert "No proposal passed" in body["mum"]
    for broken in ("no json", "", '{"alternatives": 3}'):
        rows = dependencies.find_alternatives(deps, packages, Knows(broken)).collect()
        assert sorted((r.repo, r.dependency, r.candidate) for r in rows) == [
            ("app", "requests", None), ("app", "tiny", None), ("mum", "requests", None)]
    assert dependencies.find_alternatives(deps.limit(0), packages, Knows(said)).count() == 0


def test_alternatives_command(spark, tmp_path, monkeypatch, capsys):
    from codeloom import cli
    monkeypatch.setattr(cli, "drop_tables", lambda spark: None)
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "requirements.txt").write_text("requests>=2\n")
    saved = spark.createDataFrame([p[:5] for p in PACKAGES if p[0] != "httpx"] + [PACKAGES[1][:5]],
                                  "name string, summary string, license string, home string, requires array<string>")
    artifacts.save_packages(saved, str(tmp_path))
    monkeypatch.setattr(cli, "COMPLETER", type("K", (FactCompleter,), {"_alternatives": lambda self: F.lit(json.dumps(
        {"alternatives": [{"dependency": "requests", "does": "http", "substitutes": ["httpx", "absent"]}]}))})())
    cli.run(spark, ["alternatives", str(tmp_path / "code"), "--packages", str(tmp_path)])
    out = capsys.readouterr().out
    assert "[httpx](https://h.example)" in out and "absent (no such package)" in out
    with pytest.raises(SystemExit):
        cli.run(spark, ["alternatives", str(tmp_path / "code")])


def test_install_step_says_what_is_a_guess(make_files):
    quoted = make_files("q", **{"README.md": "```\n$ pip install it\n```\n", "requirements.txt": "a\n"})
    guessed = make_files("g", **{"README.md": "# words\n", "requirements.txt": "a\n"})
    bare = make_files("b", **{"package.json": '{"name": "b", "dependencies": {"x": "1"}}'})
    m = manifests.read_manifest(quoted.union(guessed).union(bare))
    body = {r.repo: r.body for r in render.getting_started(m).collect()}
    assert "*As README.md has it*\n\n```bash\npip install it" in body["q"]
    assert "*A guess from requirements.txt, since README.md has no command*" in body["g"]
    assert "*A guess from package.json*\n\n```bash\nnpm install" in body["b"]


class Listening(FactCompleter):
    """Keeps the prompts of each task."""

    def __init__(self):
        self.heard = {}

    def complete(self, df, task):
        self.heard.setdefault(task, []).extend(r.prompt for r in df.select("prompt").collect())
        return super().complete(df, task)


def test_prompts_hold_what_the_graph_knows(spark, garden):
    from codeloom.operators import generation, modules, ranking
    ear = Listening()
    ranked = ranking.rank_symbols(garden.symbols, garden.edges, garden.exports, 6)
    notes = generation.describe_symbols(ranked, garden.symbols, garden.edges, ear).cache()
    water = notes.where("qualname LIKE '%.water'").first()
    comps = generation.describe_components(ranking.components(notes), ear, notes)
    assert any(f"water ({water.kind}, {water.role}): {water.purpose}" in p for p in ear.heard["component"])
    entry = notes.select("repo", "qualname", "rank").limit(0)
    sections = generation.write_sections(notes, comps, ranking.reading_order(notes, None), entry,
                                         modules.surface_counts(garden.symbols, garden.edges), ear).cache()
    fact = f"water: {water.kind}, {water.role}, {water.file}:{water.start_line}; uses nothing known"
    assert any(fact in p for p in ear.heard["write"])
    assert ["Known from the call graph" in p for p in ear.heard["write"]] == [" has " not in p.split("\n")[0]
                                                                             for p in ear.heard["write"]]
    issues = sections.select("repo", "key", F.lit("q").alias("quote"), F.lit("s").alias("subject"))
    told = sections.select("repo", "key", F.lit("wrong").alias("text"))
    again = sections.withColumn("rewrite", F.col("kind") == "component")
    generation.rewrite_sections(again, issues, told, ear, notes).count()
    assert ear.heard["rewrite"] and all("Known from the call graph" in p for p in ear.heard["rewrite"])
    assert any(fact in p for p in ear.heard["rewrite"])
    plain = Listening()
    generation.rewrite_sections(again, issues, told, plain).count()
    assert not any("Known from" in p for p in plain.heard["rewrite"])
