"""Everyday JavaScript and TypeScript, form by form."""

import time

import pytest

from codeloom.functions.script_source import read_script


def read(code, path="m.ts"):
    out = read_script(code.encode(), "m", path)
    return {d["qualname"]: d for d in out["defs"]}, out["error"]


def calls(code, of="m.f", path="m.ts"):
    return [(c["simple"], c["display"]) for c in read(code, path)[0][of]["calls"]]


@pytest.mark.parametrize("code,names", [
    ("export function id<T>(x: T): T { return x }", {"m.id"}),
    ("class Box<T> extends Base<T> { get<K>(k: K) { return k } }", {"m.Box", "m.Box.get"}),
    ("const f = <T,>(x: T) => use(x)", {"m.f"}),
    ("const f = async <T extends { a: () => void }>(x: T): Promise<T> => use(x)", {"m.f"}),
    ("abstract class A { abstract area(a: number): number; protected abstract name(): string\n real() { return 1 } }",
     {"m.A", "m.A.area", "m.A.name", "m.A.real"}),
    ("interface I { a(): void }\nfunction g() {}", {"m.I", "m.g"}),
    ("function f() { return /[{(]/.test(x) }\nfunction g() {}", {"m.f", "m.g"}),
    ("const a = b / c; function f() { return a / 2 } function g() { return 1 / 3 }", {"m.f", "m.g"}),
    ("const x = <A b={y} /> ; const z = <B c={y} />; function g() {}", {"m.g"}),
    ("function f() { return `a ${ `b ${ g({a: 1}) }` } {` }\nfunction g() {}", {"m.f", "m.g"}),
    ("const f = async <T,>(x: T): Promise<{a: T}> => { return g(x) }", {"m.f"}),
    ("const f: (x: { a: number }) => void = (x) => { g(x) }, h = async y => 1, z = 2, k = function named() {}",
     {"m.f", "m.h", "m.k"}),
    ("function f() { setTimeout(function tick(x) { u() }) }\nconst M = memo(function Inner(p) { return p })", {"m.f"}),
    ("export default class extends B { run(): { a: 1 } { return go() } }", {"m.run"}),
    ("class A { #p(x) { return this.#q() }\n delete(id) {}\n *gen() {}\n get size() { return 1 } }",
     {"m.A", "m.A.#p", "m.A.delete", "m.A.gen", "m.A.size"}),
    ("function f(" + ", ".join(f"a{i}" for i in range(3)) + "): a is string\nfunction f(x: any): x is string { return x }",
     {"m.f"}),
    ("function f<" + ", ".join(f"T{i} extends Base<{{ a: T{i} }}>" for i in range(150)) + ">(x: T1): T2 { return g(x) }",
     {"m.f"}),
    ("interface A extends B<{ x: 1 }> { a(): void }\nclass C extends mix({ a: 1 }) implements I<{ y: 2 }> { go() {} }",
     {"m.A", "m.C", "m.C.go"}),
    ("function f() { return <a>http://x.com {go()} it's</a> }\nfunction g() {}", {"m.f", "m.g"}),
    ("const P = () => (\n <>\n  {/* it's */}\n  <Q on={() => `${x}`} {...rest}/>\n </>\n)\nfunction g() {}", {"m.P", "m.g"}),
    ("type F = <T>(x: T) => void\nconst f: F = <T extends {}>(x: T) => use(x)\nfunction g() {}", {"m.f", "m.g"}),
    ("const a = b < c\nfunction f(): A extends B ? { x: 1 } : (y: number) => void { return g() }", {"m.f"}),
])
def test_definitions(code, names):
    found, error = read(code, "m.tsx")
    assert set(found) == names and error is None


@pytest.mark.parametrize("code,want", [
    ("function f() { return `hi ${fmt(x)} and ${a.b(`${c()}`)}` }",
     [("fmt", "fmt"), ("b", "a.b"), ("c", "c")]),
    ("function f() { foo<string>(1); a.map<Map<string, number>>(g) }", [("foo", "foo"), ("map", "a.map")]),
    ("function f() { const a = new Foo; return new b.Bar; }", [("Foo", "Foo"), ("Bar", "b.Bar")]),
    ("function f() { return new Foo(1) }", [("Foo", "Foo")]),
    ("function f() { if (a < b && c > (d)) g(); return a < b }", [("g", "g")]),
    ("function f() { return x.replace(/`/g, '').split(/[)'\"]/) }",
     [("split", "x.replace(/`/g, '').split"), ("replace", "x.replace")]),
    ("function f() { return $q(1) + $.ajax(2) }", [("$q", "$q"), ("ajax", "$.ajax")]),
    ("function f(): { a: number } { return g() }", [("g", "g")]),
    ("function f(): Promise<{ a: () => void }[]> { return g() }", [("g", "g")]),
    ("function f() { setTimeout(function tick(x) { u() }) }", [("setTimeout", "setTimeout"), ("u", "u")]),
    ("function f() { return i++ / a(i) / b(i) }", [("a", "a"), ("b", "b")]),
    ("function f() { if (x) /[(]/.test(y); return (x) / a(1) / 2 }", [("test", "/[(]/.test"), ("a", "a")]),
    ("function f() { return q().catch(h).finally(k) }",
     [("finally", "q().catch(h).finally"), ("catch", "q().catch"), ("q", "q")]),
    ("function f() { return (await a()).json() }", [("json", "(await a()).json"), ("a", "a")]),
    ("function f() { return [1, 2].map(g) }", [("map", "[1, 2].map")]),
    ("function f() { const x: { a(): void } = b() as { c(): number }; type T = { d(): void }\n e() }",
     [("b", "b"), ("e", "e")]),
    ("function f() { return a!.b() + tag`x ${c()}` }", [("b", "a!.b"), ("tag", "tag"), ("c", "c")]),
])
def test_calls(code, want):
    assert calls(code) == want


def test_calls_within_markup():
    code = """export function f() {
  return <p title="it's" onClick={() => save(`${a()}`)}>
    It's {b()} and it's {list.map(x => <li key={x}>{c(x)} // no comment</li>)} {'}'}
    <img src="x"/> <A.B {...d()} /> a < {e()} </p>
}
const g = () => 1
"""
    found, error = read(code.replace("a < {", "a {"), "m.tsx")
    assert set(found) == {"m.f", "m.g"} and error is None and found["m.f"]["end_line"] == 5
    assert [c["simple"] for c in found["m.f"]["calls"]] == ["save", "a", "b", "map", "c", "d", "e"]
    assert read(code, "m.jsx")[1]  # an element that never ends is told


def test_parameters_with_types_of_several_arguments():
    found, _ = read("function f(a: Map<string, number>, { b }: P, c = 1, ...d: T[]) {}")
    assert found["m.f"]["params"] == ["a", "c", "d"]


@pytest.mark.parametrize("code", ["a < " * 3000, "f<" * 3000 + "x" + ">" * 3000 + "()", "(x: A extends B ? " * 400,
                                  "<a>" * 3000, "`${" * 3000, "const a = [" * 2000, "((((" * 1000 + "=>"])
def test_odd_files_end_soon(code):
    start = time.perf_counter()
    for path in ("m.ts", "m.tsx", "m.js"):
        read(code, path)
    assert time.perf_counter() - start < 20


def test_comparisons_in_plain_javascript_are_no_type_arguments():
    assert calls("function f() { return a < b > (c) }", path="m.js") == []


def test_spans_of_signatures():
    found, _ = read("abstract class A {\n  abstract area(a: number): number;\n}\n")
    area = found["m.A.area"]
    assert (area["source"], area["kind"], area["params"], area["start_line"], area["end_line"]) == (
        "abstract area(a: number): number", "method", ["a"], 2, 2)


@pytest.mark.parametrize("code", ["function f() { } }", "function f( { }", "const a = [1, 2", "f(`${a`)"])
def test_unmatched_brackets_are_told(code):
    assert read(code)[1]


def test_time_grows_with_the_file():
    def took(n):
        code = "function all() {\n" + "".join(f"  function f{i}() {{ return g{i}(a) }}\n" for i in range(n)) + "}\n"
        start = time.perf_counter()
        assert len(read(code)[0]) == n + 1
        return time.perf_counter() - start
    took(500)
    assert took(8000) < 40 * took(1000)
