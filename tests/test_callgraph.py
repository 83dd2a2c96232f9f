from codeloom.functions.python_source import read_python
from codeloom.functions.script_source import read_script
from codeloom.operators import callgraph, symbols
from pyspark.sql import functions as F


def pairs(a):
    return {(r.caller, r.callee) for r in a.edges.collect()}


def test_golden_graph(garden):
    assert pairs(garden) == {
        ("garden.season", "garden.season.spring"), ("garden.season.spring", "garden.water"),
        ("garden.Plant.grow", "garden.water"), ("garden.Tomato.ripen", "garden.Plant.grow"),
        ("garden.Tomato.rest", "garden.Plant.grow"), ("garden.Tomato.record", "garden.water"),
        ("garden.year", "garden.season")}
    assert garden.symbols.count() == 11
    assert garden.unresolved.count() == 0 and garden.errors.count() == 0
    assert {r.name for r in garden.attributes.collect()} == {"leaves"}
    ripen = garden.symbols.where("name = 'ripen'").first()
    assert ripen.source.startswith("@functools.cache") and ripen.kind == "method"
    assert garden.symbols.where("name = 'Tomato'").first().bases == ["Plant"]


def test_source_is_right_after_other_alphabets():
    d = read_python("# é ü 漢\nx = 'é'\ndef f(a, *b, c: int = 1, **d):\n    'dé'\n".encode(), "m", "m.py")
    f = d["defs"][0]
    assert f["source"].startswith("def f(") and f["params"] == ["a", "b", "c", "d"]
    assert f["docstring"] == "dé"


def test_partial_parse_keeps_the_rest():
    d = read_python(b"def a():\n    b()\n\ndef broken(:\n\n@deco\ndef c(): pass\n", "m", "m.py")
    assert [(x["name"], x["start_line"]) for x in d["defs"]] == [("a", 1), ("c", 6)]
    assert d["error"] == "m.py: syntax errors (partial parse)"


def test_script_definitions():
    d = read_script(b"""/** Says hi. */
export function hi(a, {b}, ...c) { const pick = (x) => low(x); return this.go(pick(1)); }
class Box extends Base { open(m) { return new Box().open(hi(m)); } }
""", "m", "m.js")
    got = {x["qualname"]: x for x in d["defs"]}
    assert set(got) == {"m.hi", "m.hi.pick", "m.Box", "m.Box.open"}
    assert got["m.hi"]["exported"] and got["m.hi"]["docstring"] == "Says hi."
    assert got["m.hi"]["params"] == ["a", "c"]
    # A named arrow's calls also count for the function around it.
    assert [c["display"] for c in got["m.hi"]["calls"]] == ["low", "this.go", "pick"]
    assert [c["display"] for c in got["m.Box.open"]["calls"]] == ["new Box().open", "Box", "hi"]


def test_inheritance_is_breadth_first_and_cycle_safe(make_files):
    code = """
class A(B, C):
    def run(self):
        return self.far()
class B(D):
    pass
class C:
    def far(self): pass
class D(A):
    def far(self): pass
class E:
    def again(self):
        return self.again()
"""
    a = callgraph.analyze_files(make_files("r", **{"m.py": code}))
    assert pairs(a) == {("m.A.run", "m.C.far")}


def test_ambiguous_missing_and_builtin(make_files):
    a = callgraph.analyze_files(make_files("r", **{
        "a.py": "def go(): pass\ndef run():\n    go(); nope(); nope(); x.append(1); run()\n",
        "b.py": "def go(): pass\n"}))
    assert pairs(a) == set()
    assert {(r.text, r.n) for r in a.unresolved.collect()} == {("go (ambiguous: 2)", 1), ("nope", 2)}
    rate = callgraph.resolution_rate(a.edges, a.unresolved).first()
    assert (rate.edges, rate.unresolved, rate.pct) == (0, 3, 0.0)


def test_last_file_wins_at_the_first_place(make_files):
    files = make_files("r", **{"lib/m.py": "def f(): one()\n", "src/m.py": "def f(): two()\n"})
    s = symbols.unique_symbols(symbols.definitions(symbols.parse_files(files))).collect()
    assert [(r.qualname, r.file, "/".join(r.ord.parts)) for r in s] == [("m.f", "src/m.py", "lib/m.py")]


def test_module_names(spark):
    want = {"src/shop/app.py": "shop.app", "src/cart/index.ts": "cart", "lib.py": "",
            "dist/a.py": "dist.a", "dist/a.js": "a", "pkg/__init__.py": "pkg", "lib/src/x.py": "x",
            "index.ts": ""}
    df = spark.createDataFrame([(p,) for p in want], "path string")
    got = {r.path: r.m for r in df.select("path", symbols.module_qualname("path").alias("m")).collect()}
    assert got == want


def test_hub_neighbours_are_cut_in_name_order(spark):
    ring = [("g", f"n{i:03}", f"n{(i + 1) % 400:03}") for i in range(400)]
    spokes = [("g", f"n{i:03}", "hub") for i in range(400)]
    e = spark.createDataFrame(ring + spokes, "repo string, caller string, callee string")
    out = {r.qualname: r.names for r in callgraph.callees(e, 10).collect()}
    assert out["n000"] == ["hub", "n001"]
    fan = {r.qualname: (r.fan_in, r.fan_out) for r in callgraph.fan_counts(e).collect()}
    assert fan["hub"] == (400, 0) and fan["n007"] == (1, 2)
    inn = callgraph.callers(e, 3).where(F.col("qualname") == "hub").first().names
    assert inn == ["n000", "n001", "n002"]


def test_clashes_across_modules_of_different_depth(make_files):
    files = make_files("r", **{"a.py": "class b:\n    def f(self): pass\n", "a/b.py": "def f(): pass\ndef g(): pass\n",
                               "c.py": "def f(): pass\n"})
    s = symbols.unique_symbols(symbols.definitions(symbols.parse_files(files))).collect()
    assert {(r.qualname, r.file, "/".join(r.ord.parts)) for r in s} == {
        ("a.b", "a.py", "a.py"), ("a.b.f", "a.py", "a/b.py"), ("a.b.g", "a/b.py", "a/b.py"), ("c.f", "c.py", "c.py")}


def test_modules_of_their_own_are_not_suspects(make_files):
    files = make_files("r", **{"p/__init__.py": "import os\n", "p/a.py": "def f(): pass\n", "p/ab.py": "def f(): pass\n"})
    assert symbols._may_clash(symbols.definitions(symbols.parse_files(files))).collect() == []


def test_attributes_alone_are_those_of_the_whole_reading(make_files):
    files = make_files("r", **{"a.py": "class A:\n    def f(self):\n        if x:\n            self.y = 1\n",
                               "bad.py": "def (:\ndef g(self):\n    self.z += 2\n"})
    whole = symbols.attribute_names(symbols.parse_files(files)).collect()
    assert sorted(whole) == sorted(symbols.attributes_of_files(files).collect()) != []


def test_equal_calls_are_counted_in_long_lists_too(make_files):
    code = "def run():\n    " + "; ".join(["b()", "a()"] + [f"f{i}()" for i in range(callgraph.IN_ROW)] + ["a()"]) + "\n"
    files = make_files("r", **{"m.py": code + "def few():\n    b(); a(); a()\n"})
    s = symbols.unique_symbols(symbols.definitions(symbols.parse_files(files)))
    got = {(r.caller, r.simple): (r.n, r.call_ord.call_pos) for r in callgraph.call_sites(s).collect()}
    assert len(got) == callgraph.IN_ROW + 4
    assert got["m.run", "a"] == got["m.few", "a"][:1] + (1,) and got["m.few", "b"] == (1, 0)


def test_a_very_deep_expression_is_read(make_files):
    chain = "x" + ".a()" * 400
    files = make_files("r", **{"m.py": f"def f():\n    return {chain}\n"})
    d = symbols.definitions(symbols.parse_files(files)).first()
    assert len(d.calls) == 400
