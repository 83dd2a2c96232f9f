"""The reader of Python files passes over names and constants, and rests the search for cycles while it reads."""

import ast
import gc

from codeloom.functions import python_source
from codeloom.operators import symbols


def test_children_are_the_nodes_that_hold_others():
    call = ast.parse("f(a, 1, *g(b), k=h.i, **j())").body[0].value
    assert [type(n).__name__ for n in python_source._children(call)] == ["Starred", "keyword", "keyword"]
    assert python_source._children(ast.parse("a + 1").body[0].value) == []


def test_calls_keep_their_order():
    body = ast.parse("x = {f(): g(h()), **i()}\nreturn_ = a() if b() else c()\nd(e := j(), *k(), l=m.n(o()), **p())").body
    found = python_source._calls(body, python_source._Text(ast.unparse(ast.Module(body, [])).encode()))
    assert [c["simple"] for c in found] == ["f", "g", "h", "i", "a", "b", "c", "d", "j", "k", "n", "o", "p"]


def test_search_for_cycles_rests_and_goes_on():
    assert gc.isenabled()
    try:
        with symbols._no_cycles():
            assert not gc.isenabled()
            raise ValueError
    except ValueError:
        assert gc.isenabled()
    gc.collect()
    with symbols._no_cycles():
        for text in (b"class A(B):\n    def f(self):\n        return self.g(1)\n", b"def f(:\nclass A:\n    def g(self: pass\n"):
            python_source.read_python(text, "m", "m.py")
        assert gc.collect() == 0
