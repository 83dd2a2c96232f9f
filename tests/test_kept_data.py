"""Nothing is dropped on the way: saved runs, call logs, replies, damaged source, hubs."""

from codeloom.functions.python_source import read_python
from codeloom.operators import callgraph, generation, reviews
from codeloom.operators.retrieval import line_windows
from codeloom.sources import artifacts


def test_saving_one_repository_leaves_the_others(spark, tmp_path):
    root = str(tmp_path)
    for repo, body in (("alpha", "one"), ("007", "two"), ("beta", "three"), ("007", "again")):
        artifacts.save_markdown(spark.createDataFrame([(repo, body)], "repo string, body string"), root)
        artifacts.save(spark.createDataFrame([(repo, 1)], "repo string, total_symbols int"), root, "map")
    texts = {p.parent.name: p.read_text() for p in tmp_path.glob("final/repo=*/*.txt")}
    assert texts == {"repo=alpha": "one\n", "repo=007": "again\n", "repo=beta": "three\n"}
    assert {r.repo for r in artifacts.saved_repos(spark, root).collect()} == {"alpha", "007", "beta"}


def test_rows_without_a_run_are_counted(spark):
    rows = [(None, 1, "a", 1.0, 10), (None, 2, "b", 1.0, 10), ("r", 1, "a", None, None), (None, 3, "b", 2.0, 20)]
    log = spark.createDataFrame(rows, "run string, seq long, model string, seconds double, output_tokens long")
    got = {r.run: (r.calls, r.seconds, r.output_tokens, r.swaps, r.tokens_per_sec, r.thrash)
           for r in reviews.call_stats(log).collect()}
    assert got == {None: (3, 4.0, 40, 1, 10.0, True), "r": (1, 0.0, 0, 0, 0.0, False)}


def test_one_failing_prompt_costs_only_itself(spark):
    def ask(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("refused")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("bad" if i == 7 else f"p{i}",) for i in range(20)], "prompt string").coalesce(1)
    out = generation.FunctionCompleter(ask).complete(df, "t").collect()
    assert [r.reply for r in out] == [None if i == 7 else f"P{i}" for i in range(20)]


DAMAGED = b'''import os

@wrap
class A(Base):
    """Doc."""

    size = 1

    def ok(self):
        return helper(1)

    def bad(self:
        return 2

    @cached
    def ok2(self, x):
        self.y = x
        return self.ok()


def after():
    return A()
'''


def test_a_bad_member_does_not_take_its_class():
    out = read_python(DAMAGED, "m", "m.py")
    found = {d["qualname"]: d for d in out["defs"]}
    assert set(found) == {"m.A", "m.A.ok", "m.A.ok2", "m.after"} and out["error"]
    assert found["m.A"]["bases"] == ["Base"] and found["m.A"]["docstring"] == "Doc."
    assert found["m.A.ok2"]["source"].startswith("@cached") and found["m.A.ok2"]["params"] == ["x"]
    assert (found["m.A.ok"]["start_line"], found["m.A.ok2"]["start_line"], found["m.after"]["start_line"]) == (9, 15, 21)
    assert out["attributes"] == ["y"]


def test_very_many_classes_of_one_name(spark):
    n = 5000
    schema = ("repo string, qualname string, name string, kind string, owner_class string, bases array<string>, "
              "ord struct<file:string,pos:int>")
    rows = [("r", f"m{i}.Meta", "Meta", "class", None, [], ("f", i)) for i in range(n)]
    rows += [("r", f"u{i}.User", "User", "class", None, ["Meta"], ("f", n + i)) for i in range(n)]
    rows += [("r", f"m{i}.Meta.go", "go", "method", f"m{i}.Meta", [], ("f", 2 * n + i)) for i in (4000, 40)]
    symbols = spark.createDataFrame(rows, schema)
    wanted = spark.createDataFrame([("r", f"u{i}.User", "go") for i in range(n)], "repo string, owner string, simple string")
    out = callgraph.resolve_inherited(wanted, symbols)
    assert out.count() == n and {r.target for r in out.select("target").distinct().collect()} == {"m40.Meta.go"}


def test_a_class_that_shares_its_base_s_name_is_not_its_own_base(make_files):
    a = callgraph.analyze_files(make_files("r", **{
        "a.py": "class Foo:\n    def run(self):\n        return 1\n",
        "b.py": "import a\nclass Foo(a.Foo):\n    def run(self):\n        return super().run()\n"}))
    assert [(e.caller, e.callee) for e in a.edges.collect()] == [("b.Foo.run", "a.Foo.run")]


def test_windows_follow_the_rule():
    lines = ["x" * n for n in (3, 0, 9, 30, 2, 2, 2, 2, 8)]
    for limit in (1, 4, 10, 12, 40, 100):
        for overlap in (0, 1, 2, 5):
            got = line_windows(lines, limit, overlap)
            assert got[0][1] == 0 and got[-1][0].endswith(lines[-1])
            for (t, a), nxt in zip(got, [*got[1:], None]):
                k = t.count("\n") + 1
                size = sum(len(x) + 1 for x in lines[a:a + k])
                assert t == "\n".join(lines[a:a + k]) and (size <= limit or k == 1)
                if nxt:
                    assert size + len(lines[a + k]) + 1 > limit
                    assert nxt[1] == max(a + 1, a + k - overlap)
    assert line_windows([], 10, 1) == [("", 0)]
