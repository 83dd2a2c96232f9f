"""Definitions, calls and attributes of one Python file, read with the stdlib parser.

Runs inside Spark tasks on one file at a time; everything that needs more than
one file (name resolution, inheritance, the graph) is a join, not code here.
"""

from __future__ import annotations

import ast
import re

DEFS = frozenset((ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
_ASSIGNS = (ast.Assign, ast.AugAssign, ast.AnnAssign)
PARTIAL = "syntax errors (partial parse)"
_QUOTED = re.compile(r"^[a-zA-Z]{0,2}(\"\"\"|'''|\"|')(.*)\1$", re.S)
_TOP_LEVEL = re.compile(rb"^(?=[A-Za-z@_])", re.M)
_CLASS_HEAD = re.compile(rb"^class\b[^\n]*?(?:\([^)]*\))?\s*:[ \t]*(?:#[^\n]*)?\n", re.M)


class _Text:
    """Source slices by the parser's (line, utf-8 byte column) positions."""

    def __init__(self, data: bytes):
        self.lines = data.split(b"\n")

    def cut(self, l1: int, c1: int, l2: int, c2: int) -> str:
        if l1 == l2:
            part = self.lines[l1 - 1][c1:c2]
        else:
            part = b"\n".join([self.lines[l1 - 1][c1:], *self.lines[l1:l2 - 1],
                               self.lines[l2 - 1][:c2]])
        return part.decode("utf8", "replace")

    def of(self, node: ast.AST) -> str:
        return self.cut(node.lineno, node.col_offset, node.end_lineno, node.end_col_offset)


# Nodes whose fields are not stored in source order.
_UNORDERED = (ast.Call, ast.Dict, ast.IfExp, ast.arguments)
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")
#: Fields with names, operators and flags: nothing in them is called.
_PLAIN = {"ctx", "op", "ops", "id", "attr", "arg", "type_comment", "kind", "conversion", "names", "module", "level"}
_KINDS = [k for k in vars(ast).values() if isinstance(k, type) and issubclass(k, ast.AST)
          and (k is ast.Constant or not issubclass(k, ast.Constant))]
_INNER = {k: tuple(f for f in k._fields if f not in _PLAIN) for k in _KINDS} | {ast.Constant: ()}
_HELD = {k: tuple(b for b in _BLOCKS if b in k._fields) for k in _KINDS}
_IN_ORDER = {k: k not in _UNORDERED for k in _KINDS}
#: Classes of nodes that hold others; names and constants, most of a tree, are passed over.
_DEEP = frozenset(k for k in _KINDS if _INNER[k])


def _place(node: ast.AST) -> tuple[int, int]:
    return getattr(node, "lineno", 0), getattr(node, "col_offset", 0)


def _children(node: ast.AST) -> list[ast.AST]:
    """The nodes within one that hold others, in source order."""
    found, kind = [], node.__class__
    for field in _INNER[kind]:
        value = getattr(node, field)
        if value.__class__ is list:
            for v in value:
                if v.__class__ in _DEEP:
                    found.append(v)
        elif value.__class__ in _DEEP:
            found.append(value)
    if len(found) > 1 and not _IN_ORDER[kind]:
        found.sort(key=_place)
    return found


def _docstring(node: ast.AST, text: _Text) -> str | None:
    first = node.body[0]
    if not (isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant)
            and isinstance(first.value.value, str)):
        return None
    quoted = _QUOTED.match(text.of(first.value))
    return quoted.group(2).strip() if quoted and quoted.group(2) else None


def _calls(body: list[ast.stmt], text: _Text) -> list[dict]:
    """Calls in source order, outer ones first; inner definitions speak for themselves."""
    out, stack = [], body[::-1]
    while stack:
        node = stack.pop()
        kind = node.__class__
        if kind in DEFS:
            continue
        if kind is ast.Call:
            fn = node.func
            if fn.__class__ is ast.Name:
                out.append({"simple": fn.id, "display": fn.id})
            elif fn.__class__ is ast.Attribute:
                out.append({"simple": fn.attr, "display": text.of(fn)})
        if kind in _DEEP:
            inner = _children(node)
            if len(inner) > 1:
                inner.reverse()
            stack += inner
    return out


def _params(args: ast.arguments) -> list[str]:
    named = [*args.posonlyargs, *args.args, *args.kwonlyargs,
             *filter(None, (args.vararg, args.kwarg))]
    if len(named) > 1:
        named.sort(key=_place)
    return [a.arg for a in named if a.arg not in ("self", "cls")]


def _bases(node: ast.ClassDef) -> list[str]:
    return [b.id if isinstance(b, ast.Name) else b.attr for b in node.bases
            if isinstance(b, (ast.Name, ast.Attribute))]


def _attribute_names(node: ast.AST):
    targets = node.targets if isinstance(node, ast.Assign) else [node.target]
    for t in targets:
        if (isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name)
                and t.value.id in ("self", "cls")):
            yield t.attr


def _definition(node, text: _Text, qual: str, owner: str | None) -> dict:
    is_class = isinstance(node, ast.ClassDef)
    line, col = node.lineno, node.col_offset
    if node.decorator_list:
        line = node.decorator_list[0].lineno
        col = max(text.lines[line - 1].find(b"@"), 0)
    return dict(
        qualname=qual, name=node.name,
        kind="class" if is_class else ("method" if owner else "function"),
        start_line=line, end_line=node.end_lineno,
        docstring=_docstring(node, text),
        source=text.cut(line, col, node.end_lineno, node.end_col_offset),
        owner_class=owner,
        calls=[] if is_class else _calls(node.body, text),
        bases=_bases(node) if is_class else [],
        params=[] if is_class else _params(node.args),
        exported=False)


def _named(node, text: _Text, qual: str, owner: str | None) -> dict:
    """What _definition tells of names and lines; nothing within the definition is looked at."""
    line = node.decorator_list[0].lineno if node.decorator_list else node.lineno
    return dict(qualname=qual, start_line=line, end_line=node.end_lineno,
                params=[] if isinstance(node, ast.ClassDef) else _params(node.args))


def _visit(node: ast.AST, text: _Text, prefix: str, owner: str | None, found: dict,
           attributes: set[str], define=_definition) -> None:
    """Definitions and attribute assignments sit in statement blocks only."""
    for block in _HELD[node.__class__]:
        for child in getattr(node, block):
            kind = child.__class__
            if kind in DEFS:
                qual = f"{prefix}.{child.name}" if prefix else child.name
                if qual not in found:
                    found[qual] = define(child, text, qual, owner)
                _visit(child, text, qual, qual if kind is ast.ClassDef else None,
                       found, attributes, define)
            else:
                if kind in _ASSIGNS:
                    attributes.update(_attribute_names(child))
                if _HELD[kind]:
                    _visit(child, text, prefix, owner, found, attributes, define)


def _assigned(node: ast.AST, attributes: set[str]) -> None:
    """The attribute assignments that _visit finds, without the definitions around them."""
    for block in _HELD[node.__class__]:
        for child in getattr(node, block):
            if child.__class__ in _ASSIGNS:
                attributes.update(_attribute_names(child))
            elif _HELD[child.__class__]:
                _assigned(child, attributes)


def _blocks(data: bytes, starts: list[int]) -> list[tuple[int, bytes]]:
    """(offset, text) of the blocks that begin at starts; decorator lines go with what follows."""
    out: list[tuple[int, bytes]] = []
    open_decorators = False
    for a, b in zip(starts, [*starts[1:], len(data)], strict=True):
        if open_decorators:
            out[-1] = (out[-1][0], out[-1][1] + data[a:b])
        else:
            out.append((a, data[a:b]))
        open_decorators = data[a:b].lstrip().startswith(b"@")
    return out


def _class_in_parts(block: bytes) -> ast.stmt | None:
    """A class with what parses of its members, when the whole of it does not."""
    head = _CLASS_HEAD.search(block)
    inside = head and re.match(rb"(?:[ \t]*(?:#[^\n]*)?\n)*([ \t]+)\S", block[head.end():])
    if not inside:
        return None
    indent = inside.group(1)
    member = re.compile(rb"^" + re.escape(indent) + rb"(?=[^\s#)\]}])", re.M)
    starts = [m.start() for m in member.finditer(block, head.end())]
    top, whole = block[:head.end()], None
    for at, part in _blocks(block, starts):
        lines = block.count(b"\n", head.end(), at)
        try:
            node = ast.parse(top + b"\n" * lines + part).body[0]
        except (SyntaxError, ValueError, IndexError):
            continue
        if whole is None:
            whole = node
        else:
            whole.body += node.body
            whole.end_lineno, whole.end_col_offset = node.end_lineno, node.end_col_offset
    return whole


def _tree(data: bytes) -> tuple[ast.Module, bool]:
    """The module, or what is left of it: blocks that parse, and classes without bad members."""
    try:
        return ast.parse(data), False
    except (SyntaxError, ValueError):
        kept: list[ast.stmt] = []
        starts = [m.start() for m in _TOP_LEVEL.finditer(data)] or [0]
        for at, block in _blocks(data, starts):
            try:
                body = ast.parse(block).body
            except (SyntaxError, ValueError):
                found = _class_in_parts(block)
                body = [found] if found else []
            for node in body:
                ast.increment_lineno(node, data.count(b"\n", 0, at))
            kept += body
        return ast.Module(body=kept, type_ignores=[]), True


def _clean(content: bytes) -> bytes:
    """Only bad bytes are replaced; line ends are kept so that positions hold."""
    data = content.decode("utf8", "replace").removeprefix("\ufeff").encode("utf8")
    return data.replace(b"\r\n", b"\n").replace(b"\r", b"\n")


def read_python(content: bytes, module: str, path: str, define=_definition) -> dict:
    data = _clean(content)
    try:
        tree, partial = _tree(data)
        text, found, attributes = _Text(data), {}, set()
        _visit(tree, text, module, None, found, attributes, define)
    except RecursionError:
        return {"defs": [], "attributes": [], "error": f"{path}: {PARTIAL}"}
    defs = [{**d, "pos": i} for i, d in enumerate(found.values())]
    return {"defs": defs, "attributes": sorted(attributes),
            "error": f"{path}: {PARTIAL}" if partial else None}


def read_names(content: bytes, module: str, path: str) -> dict:
    """What read_python finds, as far as names, parameters and lines go: no text is cut, no call looked for."""
    return read_python(content, module, path, _named)


def read_attributes(content: bytes) -> list[str]:
    """The attributes that read_python finds, and nothing else."""
    try:
        attributes: set[str] = set()
        _assigned(_tree(_clean(content))[0], attributes)
    except RecursionError:
        return []
    return sorted(attributes)
