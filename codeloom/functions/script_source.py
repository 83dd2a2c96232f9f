"""Definitions and calls of one JavaScript or TypeScript file.

Tokens are read with the state of what surrounds them (template, hole, tag, text between tags), brackets and
angle brackets are matched once per file, and types are read by rule where the grammar has one: after a
parameter list, a declared name, `as`, and in a type alias.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_TOKEN = re.compile(
    r"(?P<comment>\A#![^\n]*|/\*.*?\*/|//[^\n]*)"
    r"|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"
    r"|(?P<name>#?(?:[^\W\d]|\$(?!\{))(?:[\w]|\$(?!\{))*)"
    r"|(?P<number>\d[\w.]*)"
    r"|(?P<op>=>|\?\.|\.\.\.|[-+*/%<>=!&|^?:;,.(){}\[\]~@#`])", re.S)
_REGEX = re.compile(r"/(?![*/>])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_QUASI = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(?:`|\$\{|\Z)", re.S)
# An element's beginning (a fragment has no name), the attributes up to a hole or the tag's end, and its end.
_OPEN = re.compile(r"<([A-Za-z_$][\w$.:-]*(?=[\s/>])(?!\s+extends\b)|(?=>))")
_ATTRIBUTES = re.compile(r"(?:[\s=]|//[^\n]*|/\*.*?\*/|\"[^\"]*\"|'[^']*'|[\w$.:-])*", re.S)
_CLOSE = re.compile(r"</\s*[\w$.:-]*\s*>")
# A hole in a template or in markup is a bracket of its own kind, so that it is never taken for a body.
_PAIRS = {"(": ")", "{": "}", "[": "]", "${": "}$"}
_CLOSERS = frozenset(_PAIRS.values())
# After these words a value begins: a slash is a pattern there, an angle bracket an element.
_BEFORE_VALUE = frozenset("return typeof case in of do else void delete throw new instanceof await "
                          "yield default".split())
# What stands in parentheses after these words is no value.
_HEADS = frozenset("if while for with".split())
# Words that can stand before "(" without being a call or a method name.
_WORDS = frozenset("if for while switch catch with return typeof await yield super import "
                   "function do else new delete void in of case throw constructor_".split())
_MODIFIERS = frozenset("async static get set public private protected readonly override "
                       "abstract declare accessor".split())
# Words that join or begin parts of a type.
_TYPE_WORDS = frozenset("keyof typeof readonly extends infer is in out const new abstract unique asserts".split())
_TYPE_PREFIXES = frozenset("keyof typeof readonly infer unique asserts new abstract".split())
# Words that carry a statement on over a line's end.
_JOINING = frozenset("in of as satisfies instanceof".split())


class _NoMarkup(Exception):
    """What was taken for an element is none, or never ends."""


class _Lexer:
    """(kind, text, start, end) of each token; templates and markup are read into their holes."""

    def __init__(self, text: str, markup: bool):
        self.text, self.markup = text, markup
        self.out: list[tuple[str, str, int, int]] = []
        self.around: list[list] = []  # [template hole | markup hole | tag | text, open braces]
        self.before: list[tuple[str, str, int, int]] = [("op", ";", 0, 0)] * 3
        self.heads: list[bool] = []
        self.after_head = False
        self.closed: dict[str, int] = {}

    def emit(self, kind: str, start: int, end: int, tok: str | None = None) -> int:
        if end > start:
            token = (kind, tok or self.text[start:end], start, end)
            self.out.append(token)
            if kind != "comment":
                self.before = [*self.before[1:], token]
        return end

    def quasi(self, start: int, at: int) -> int:
        """A template's characters up to its end or its next hole."""
        end = _QUASI.match(self.text, at).end()
        if self.text.startswith("${", end - 2) and end - 2 >= at:
            self.emit("string", start, end - 2)
            self.around.append(["template", 0])
            return self.emit("op", end - 2, end, "${")
        return self.emit("string", start, end)

    def value_begins(self) -> bool:
        """Whether an operand, not an operator, is due."""
        early, mid, (kind, tok, start, _) = self.before
        if kind == "name":
            return tok in _BEFORE_VALUE and mid[1] not in (".", "?.")
        if kind != "op":
            return False
        if tok == ")":
            return self.after_head
        if tok in "+-" and mid[1] == tok and mid[3] == start:  # after a value, ++ and -- end it
            return not (early[0] != "op" or early[1] in (")", "]")) or early[1] in _BEFORE_VALUE
        return tok not in ("]", "<", "}$")

    def element(self, at: int) -> int | None:
        """The place after an element's name where one begins at `<`."""
        m = _OPEN.match(self.text, at) if self.markup and self.value_begins() else None
        if not m:
            return None
        name = m.group(1)
        if self.text.startswith(">", m.end()):  # no attributes: maybe type parameters, which have no end tag
            if name not in self.closed:
                self.closed[name] = self.text.rfind("</" + name)
            if self.closed[name] < at:
                return None
        return m.end()

    def in_tag(self, at: int) -> int:
        end = _ATTRIBUTES.match(self.text, at).end()
        self.emit("string", at, end)
        if self.text.startswith("{", end):
            self.around.append(["hole", 0])
            return self.emit("op", end, end + 1, "${")
        if self.text.startswith("/>", end):
            self.around.pop()
            return self.emit("string", end, end + 2)
        if self.text.startswith(">", end):
            self.around[-1] = ["text", 0]
            return self.emit("string", end, end + 1)
        raise _NoMarkup

    def in_text(self, at: int) -> int:
        end = at
        while end < len(self.text) and self.text[end] not in "<{":
            end += 1
        self.emit("string", at, end)
        if self.text.startswith("{", end):
            self.around.append(["hole", 0])
            return self.emit("op", end, end + 1, "${")
        if m := _CLOSE.match(self.text, end):
            self.around.pop()
            return self.emit("string", end, m.end())
        if m := _OPEN.match(self.text, end):
            self.around.append(["tag", 0])
            return self.emit("string", end, m.end())
        raise _NoMarkup

    def in_code(self, at: int) -> int:
        m = _TOKEN.search(self.text, at)
        if not m:
            return len(self.text)
        kind, tok, start, end = m.lastgroup, m.group(), m.start(), m.end()
        if kind != "op":
            return self.emit(kind, start, end)
        if tok == "`":
            return self.quasi(start, end)
        if tok == "}" and self.around and not self.around[-1][1]:
            template = self.around.pop()[0] == "template"
            self.emit("op", start, end, "}$")
            return self.quasi(end, end) if template else end
        if tok == "/" and self.value_begins() and (pattern := _REGEX.match(self.text, start)):
            return self.emit("string", start, pattern.end())
        if tok == "<" and (inside := self.element(start)) is not None:
            self.around.append(["tag", 0])
            return self.emit("string", start, inside)
        if tok == "(":
            self.heads.append(self.before[-1][1] in _HEADS and self.before[-2][1] != ".")
        elif tok == ")":
            self.after_head = bool(self.heads) and self.heads.pop()
        elif self.around:
            self.around[-1][1] += (tok == "{") - (tok == "}")
        return self.emit(kind, start, end)

    def run(self) -> list[tuple[str, str, int, int]]:
        at = 0
        while at < len(self.text):
            where = self.around[-1][0] if self.around else "code"
            at = self.in_tag(at) if where == "tag" else self.in_text(at) if where == "text" else self.in_code(at)
        if any(w[0] in ("tag", "text") for w in self.around):
            raise _NoMarkup
        return self.out


def _tokens(text: str, markup: bool) -> tuple[list[tuple[str, str, int, int]], bool]:
    """Tokens, and whether markup had to be given up: then every angle bracket is an operator."""
    try:
        return _Lexer(text, markup).run(), False
    except _NoMarkup:
        return _Lexer(text, False).run(), True


class _Scan:
    def __init__(self, text: str, typed: bool = True, markup: bool = False):
        self.text, self.typed = text, typed
        raw, self.broken = _tokens(text, markup)
        self.comments = {end: tok for kind, tok, _, end in raw if kind == "comment"}
        toks = [t for t in raw if t[0] != "comment"]
        self.kind = [t[0] for t in toks]
        self.tok = [t[1] for t in toks]
        self.at = [t[2] for t in toks]
        self.end = [t[3] for t in toks]
        self.pair: dict[int, int] = {}
        self.inside: list[int] = []  # the bracket around each token
        stack: list[int] = []
        for i, t in enumerate(self.tok):
            closes = self.kind[i] == "op" and t in _CLOSERS
            if closes and stack and _PAIRS[self.tok[stack[-1]]] == t:
                o = stack.pop()
                self.pair[o], self.pair[i] = i, o
            elif closes:
                self.broken = True
            self.inside.append(stack[-1] if stack else -1)
            if self.kind[i] == "op" and t in _PAIRS:
                stack.append(i)
        self.broken |= bool(stack)
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.comment_ends = sorted(self.comments)
        self.angle: dict[int, int] = self.match_angles() if typed else {}
        self.class_bodies = {b for i, t in enumerate(self.tok) if t in ("class", "interface") and self.is_name(i)
                             and not self.follows_dot(i) and (b := self.find_body(i + 1, len(toks))) is not None}
        self.declared: set[int] = set()  # names after the comma of a declaration
        self.types = dict(self.type_spans()) if typed else {}

    def match_angles(self) -> dict[int, int]:
        """Angle brackets that can hold types, matched level by level in one pass."""
        pair: dict[int, int] = {}
        levels: list[list[int]] = [[]]
        ternary = [False]  # whether `extends` allows a `?`
        for i, t in enumerate(self.tok):
            op = self.kind[i] == "op"
            if op and i in self.pair:
                if t in _PAIRS:
                    levels.append([])
                    ternary.append(False)
                else:
                    levels.pop()
                    ternary.pop()
                continue
            doubled = op and i > 0 and self.kind[i - 1] == "op" and self.tok[i - 1] == t and self.end[i - 1] == self.at[i]
            if op and t == "<":
                levels[-1].append(i)
                if doubled or self.is_op(i + 1, "=") and self.at[i + 1] == self.end[i]:
                    levels[-1].clear()
            elif op and t == ">":
                if levels[-1]:
                    o = levels[-1].pop()
                    pair[o], pair[i] = i, o
            elif levels[-1]:
                if op:
                    ends = (t in ";+*/%!^~@#" or t == "?." or t in "&|=" and doubled
                            or t == "?" and not ternary[-1] and not self.is_op(i + 1, ":")
                            or t == "-" and not (self.kind[i - 1] == "op" and self.kind[i + 1:i + 2] == ["number"]))
                else:
                    ternary[-1] |= t == "extends"
                    ends = (self.is_name(i) and t not in _TYPE_WORDS and self.is_value(i - 1)
                            and self.tok[i - 1] not in _TYPE_WORDS)
                if ends:
                    levels[-1].clear()
                    ternary[-1] = False
        return pair

    def type_spans(self):
        """(first, end) of the types after declared names and `as`, and of type aliases."""
        for i, t in enumerate(self.tok):
            if not self.is_name(i):
                continue
            if t in ("const", "let", "var") and self.is_name(i + 1) and self.is_op(i + 2, ":"):
                yield i + 3, self.type_end(i + 3)
            elif t in ("as", "satisfies") and self.is_value(i - 1) and not self.is_op(i + 1, "("):
                yield i + 1, self.type_end(i + 1)
            elif t == "type" and self.is_name(i + 1) and not self.is_value(i - 1, same_line=True):
                at = self.past_types(i + 2)
                if self.is_op(at, "="):
                    yield at + 1, self.type_end(at + 1)

    def past_types(self, i: int) -> int:
        """The token after type arguments or parameters that begin at i; i where there are none."""
        return self.angle.get(i, i - 1) + 1 if self.is_op(i, "<") else i

    def type_end(self, i: int) -> int:
        """The token after the type that begins at i."""
        n = len(self.tok)
        while i < n:
            while i < n and (self.is_op(i, "|") or self.is_op(i, "&")
                             or self.is_name(i) and self.tok[i] in _TYPE_PREFIXES
                             and (self.is_name(i + 1) or self.tok[i + 1:i + 2] in (["("], ["["], ["{"], ["<"]))):
                i += 1
            i = self.past_types(i)
            if i >= n or self.kind[i] == "op" and self.tok[i] not in ("(", "{", "[", "-"):
                return i
            opens = i
            i += self.is_op(i, "-")
            if self.is_op(i, "(") and self.is_op(self.pair.get(i, i) + 1, "=>") and self.lists_parameters(i):
                i = self.pair[i] + 2  # a function's type goes on with its result
                continue
            i = self.pair.get(i, i) + 1
            while i < n:  # what follows a part of a type
                if self.is_op(i, ".") and self.is_name(i + 1):
                    i += 2
                elif i in self.angle and self.is_op(i, "<"):
                    i = self.angle[i] + 1
                elif self.is_op(i, "[") and i in self.pair and self.line(self.at[i]) == self.line(self.end[i - 1] - 1):
                    i = self.pair[i] + 1
                elif self.is_op(i, "(") and self.tok[opens] == "import" and i == opens + 1:
                    i = self.pair.get(i, i) + 1
                elif self.is_op(i, "${"):  # a template's type
                    i = self.pair.get(i, i) + 1
                elif self.kind[i] == "string" and self.is_op(i - 1, "}$"):
                    i += 1
                else:
                    break
            if self.is_name(i) and self.tok[i] in ("is", "extends") or self.is_op(i, "?") and self.conditional(i):
                i += 1
            elif self.is_op(i, ":") and self.conditional(i):
                i += 1
            elif not ((self.is_op(i, "|") or self.is_op(i, "&")) and self.tok[i + 1:i + 2] != [self.tok[i]]):
                return i
        return i

    def conditional(self, i: int) -> bool:
        """Whether `?` or `:` at i belongs to a conditional type: `extends` stands before it in the same line of tokens."""
        depth = 0
        j = i - 1
        while j >= 0 and j != self.inside[i]:
            j = self.pair[j] if j in self.pair and self.tok[j] in _CLOSERS else \
                self.angle[j] if j in self.angle and self.is_op(j, ">") else j
            if self.is_op(i, ":"):
                depth += (self.is_op(j, "?")) - (self.is_op(j, ":"))
                if depth > 0:
                    return self.conditional(j)
                if depth < 0 and not self.is_op(j, ":"):
                    return False
            elif self.is_name(j) and self.tok[j] == "extends":
                return True
            if self.kind[j] == "op" and self.tok[j] in (";", "=", ",", "=>"):
                return False
            j -= 1
        return False

    def lists_parameters(self, i: int) -> bool:
        """Whether the parenthesis at i holds parameters rather than a type."""
        return (self.pair.get(i) == i + 1 or self.tok[i + 1] in ("...", "{", "[")
                or self.is_name(i + 1) and self.tok[i + 2] in (":", ",", "?", ")"))

    def is_op(self, i: int, t: str) -> bool:
        return 0 <= i < len(self.tok) and self.kind[i] == "op" and self.tok[i] == t

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tok) and self.kind[i] == "name"

    def follows_dot(self, i: int) -> bool:
        return self.is_op(i - 1, ".") or self.is_op(i - 1, "?.")

    def is_value(self, i: int, same_line: bool = False) -> bool:
        """Whether a value may end at token i."""
        if i < 0 or same_line and self.line(self.end[i] - 1) != self.line(self.at[i + 1]):
            return False
        if self.kind[i] == "name":
            return self.follows_dot(i) or self.tok[i] not in _BEFORE_VALUE | _HEADS | {
                "export", "declare", "switch", "catch", "import"}
        return self.kind[i] != "op" or self.tok[i] in (")", "]", "}", "}$")

    def statement_starts(self, i: int) -> bool:
        """Whether a statement begins at i, or at the words for a declaration right before it."""
        while self.is_name(i - 1) and self.tok[i - 1] in ("export", "default", "async", "declare", "abstract") \
                and not self.follows_dot(i - 1):
            i -= 1
        if i == 0 or self.kind[i - 1] == "op":
            return i == 0 or self.tok[i - 1] in ("{", "}", ";", ")") \
                or self.tok[i - 1] in ("]", "}$") and not self.is_value(i - 1, same_line=True)
        return self.tok[i - 1] in ("else", "do") or self.is_value(i - 1) and not self.is_value(i - 1, same_line=True)

    def line(self, offset: int) -> int:
        return bisect_right(self.breaks, offset - 1) + 1

    def find_body(self, i: int, stop: int) -> int | None:
        """First `{` at this level from i, past an extends clause."""
        while i < stop:
            if self.is_op(i, "{"):
                return i if i in self.pair else None
            if self.is_op(i, ";") or self.is_op(i, "}") or self.is_op(i, ")") or self.is_op(i, "="):
                return None
            i = self.pair.get(i, i) + 1 if self.tok[i] in ("(", "[") else max(self.past_types(i), i + 1)
        return None

    def body_after(self, close: int, stop: int) -> int | None:
        """The `{` of a body after the parameter list that ends at close, past the type of the result."""
        i = self.type_end(close + 2) if self.is_op(close + 1, ":") else close + 1
        return i if i < stop and self.is_op(i, "{") and i in self.pair else None

    def doc_before(self, offset: int) -> str | None:
        k = bisect_right(self.comment_ends, offset)
        if k == 0 or self.text[self.comment_ends[k - 1]:offset].strip():
            return None
        text = self.comments[self.comment_ends[k - 1]]
        if not text.startswith("/*"):
            return None
        lines = [ln.strip().lstrip("*").strip() for ln in text.strip("/*").splitlines()]
        return " ".join(ln for ln in lines if ln and not ln.startswith("@")).strip() or None

    def params(self, i: int) -> list[str]:
        """Plain names bound at the top level of the parenthesis opened at i."""
        out, j, fresh = [], i + 1, True
        while j < self.pair[i]:
            if fresh and self.is_name(j) and self.tok[j] not in _MODIFIERS:
                out.append(self.tok[j])
                fresh = False
            elif self.is_op(j, ","):
                fresh = True
            elif not (self.is_op(j, "...") or (self.is_name(j) and self.tok[j] in _MODIFIERS)):
                fresh = False
            j = self.pair.get(j, j) + 1 if self.tok[j] in _PAIRS else max(self.past_types(j), j + 1)
        return [n for n in out if n not in ("self", "cls", "this")]

    def callee_start(self, i: int) -> int:
        """First token of the member chain whose last segment is token i."""
        through_call = False
        while self.follows_dot(i):
            i -= 2
            while True:  # arguments, indices, types and signs that stand after a value
                if self.is_op(i, "!") and self.is_value(i - 1):
                    i -= 1
                elif self.is_op(i, ">") and i in self.angle and self.is_value(self.angle[i] - 1):
                    i = self.angle[i] - 1
                elif i in self.pair and self.tok[i] in (")", "]"):
                    o = self.pair[i]
                    before = o - 1 if not self.is_op(o - 1, "?.") else o - 2
                    if self.is_op(before, ">") and before in self.angle:
                        before = self.angle[before] - 1
                    if not (self.is_value(before) or self.tok[before:before + 1] == ["import"] or
                            self.is_op(before, "!") and self.is_value(before - 1)) or self.is_op(before, "}"):
                        i = o
                        break
                    through_call |= self.tok[i] == ")"
                    i = before
                elif self.kind[i] == "string" and self.text[self.end[i] - 1] == "`":
                    while self.is_op(i - 1, "}$") or self.is_op(i, "}$"):  # over the holes
                        i = self.pair.get(i - self.is_op(i - 1, "}$"), 1) - 1
                    if not self.is_value(i - 1, same_line=True) or self.kind[i - 1] == "string":
                        break
                    i -= 1
                else:
                    break
        if through_call and i > 0 and self.tok[i - 1] == "new":
            i -= 1
        return max(i, 0)


def _calls(s: _Scan, lo: int, hi: int, skip: list[tuple[int, int]]) -> list[dict]:
    found, jumps = [], dict(reversed(skip))
    i = lo
    while i < hi:
        jump = jumps.get(i)
        if jump is not None:
            i = jump + 1
            continue
        if i in s.types:
            i = max(s.types[i], i + 1)
            continue
        if s.is_name(i) and (s.tok[i] not in _WORDS or s.follows_dot(i)) and not _function_word(s, i):
            p, a = s.past_types(i + 1), s.callee_start(i)
            p += s.is_op(p, "?.") and s.is_op(p + 1, "(")
            tagged = s.kind[p:p + 1] == ["string"] and s.text[s.at[p]] == "`"
            called = s.is_op(p, "(") or tagged
            bare = s.tok[a - 1:a] == ["new"] and not (
                s.is_op(i + 1, ".") or s.is_op(i + 1, "?.") or called)
            if (called or bare) and (s.kind[a] != "op" or s.tok[a] in ("(", "[")):
                # An outer call comes before the calls inside it.
                close = s.pair.get(p, p) if called else i
                found.append((s.at[a], -s.end[close],
                              {"simple": s.tok[i], "display": s.text[s.at[a]:s.end[i]]}))
        i += 1
    return [c for _, _, c in sorted(found, key=lambda f: f[:2])]


def _function_word(s: _Scan, i: int) -> bool:
    """Whether the name at i is the one of a function."""
    k = i - 1 - s.is_op(i - 1, "*")
    return s.is_name(k) and s.tok[k] == "function" and not s.follows_dot(k)


def _declarator(s: _Scan, n: int, hi: int):
    """A declared name whose value is a function; other names of the declaration are noted on the way."""
    j = n + 1 + s.is_op(n + 1, "!")
    if s.is_op(j, ":"):
        j = s.type_end(j + 1)
    if not s.is_op(j, "="):
        if s.is_op(j, ",") and s.is_name(j + 1):
            s.declared.add(j + 1)
        return None
    value = j + 1
    j = value + (s.is_name(value) and s.tok[value] == "async" and not s.is_op(value + 1, "=>"))
    hit = None
    if s.is_name(j) and s.tok[j] == "function":
        p = j + 1 + s.is_op(j + 1, "*")
        p = s.past_types(p + s.is_name(p))
        if s.is_op(p, "(") and p in s.pair:
            hit = "arrow", n, p, s.body_after(s.pair[p], hi)
    else:
        j = s.past_types(j)
        p = j if s.is_op(j, "(") and j in s.pair else None
        k = j + 1 if p is None else s.pair[p] + 1
        if p is not None and s.is_op(k, ":"):
            k = s.type_end(k + 1)
        if s.is_op(k, "=>") and (p is not None or s.is_name(j)):
            hit = "arrow", n, p, k + 1
    body = hit[3] if hit and hit[3] is not None else value
    last = _statement_end(s, body, hi)
    if s.is_op(last + 1, ",") and s.is_name(last + 2):
        s.declared.add(last + 2)
    return hit


def _match(s: _Scan, i: int, hi: int):
    """(form, name index, parameter index, body index) of a definition at token i."""
    if not s.is_name(i) or s.follows_dot(i):
        return None
    word, in_class = s.tok[i], s.inside[i] in s.class_bodies
    p = s.past_types(i + 1)
    if in_class or word not in _WORDS and s.tok[i - 1:i] != ["new"] and not _function_word(s, i):
        if s.is_op(p, "(") and p in s.pair:
            if in_class and "abstract" in s.tok[max(i - 3, 0):i] and s.body_after(s.pair[p], hi) is None:
                return "signature", i, p, p
            body = s.body_after(s.pair[p], hi) if in_class or not s.is_op(s.pair[p] + 1, ":") else None
            # Within a class a name followed by a body is a member, else it might be the word before a block.
            if body is not None and not s.is_op(i - 1, "="):
                return "method", i, p, body
    if in_class:
        return None
    if word == "function" and s.statement_starts(i):
        n = i + 2 if s.is_op(i + 1, "*") else i + 1
        p = s.past_types(n + 1)
        if s.is_name(n) and s.is_op(p, "(") and p in s.pair:
            return "func", n, p, s.body_after(s.pair[p], hi)
    elif word in ("class", "interface") and s.is_name(i + 1) and s.statement_starts(i) \
            and s.tok[i + 1] not in ("extends", "implements"):
        body = s.find_body(i + 2, hi)
        if body is not None:
            return "class", i + 1, None, body
    elif word in ("const", "let", "var") and s.is_name(i + 1):
        return _declarator(s, i + 1, hi)
    elif i in s.declared:
        return _declarator(s, i, hi)
    return None


def _statement_end(s: _Scan, i: int, hi: int) -> int:
    """Last token of an arrow body that starts at i."""
    if s.is_op(i, "{") and i in s.pair:
        return s.pair[i]
    last = i
    while i < hi:
        if s.tok[i] in (";", ",", ")", "}", "]", "}$") and s.kind[i] == "op":
            break
        if i > last and s.kind[i] == "name" \
                and (s.kind[i - 1] != "op" or s.tok[i - 1] in (")", "]", "}")) \
                and s.tok[i] not in _JOINING and s.line(s.at[i]) > s.line(s.end[i - 1] - 1):
            break
        if s.kind[i] == "op" and s.tok[i] in _PAIRS and i not in s.pair:
            return i  # never closed
        last = s.pair.get(i, i) if s.tok[i] in _PAIRS else max(s.past_types(i) - 1, i)
        i = last + 1
    return last


def _walk(s: _Scan, lo: int, hi: int, prefix: str, owner: str | None,
          found: dict, stops: list[tuple[int, int]]) -> None:
    i = lo
    while i < hi:
        hit = _match(s, i, hi)
        if hit is None or hit[3] is None:
            i += 1
            continue
        form, n, p, body = hit
        close = _statement_end(s, body, hi) if form == "arrow" else s.pair[body]
        if form == "signature" and s.is_op(close + 1, ":"):
            close = s.type_end(close + 2) - 1
        first = n if form == "arrow" else i
        while first > lo and form != "arrow" and s.is_name(first - 1) and not s.follows_dot(first - 1) \
                and (s.tok[first - 1] in _MODIFIERS or s.tok[first - 1] == "default"):
            first -= 1
        exported = form in ("func", "class") and first > 0 and s.tok[first - 1] == "export"
        first -= exported
        name, is_class = s.tok[n], form == "class"
        qual = f"{prefix}.{name}" if prefix else name
        inner: list[tuple[int, int]] = []
        sub: dict = {}
        if form != "signature":
            _walk(s, body + 1 if s.is_op(body, "{") else body, close + (form == "arrow"), qual,
                  qual if is_class else None, sub, inner)
        found.setdefault(qual, dict(
            qualname=qual, name=name,
            kind="class" if is_class else ("method" if owner else "function"),
            start_line=s.line(s.at[first]), end_line=s.line(s.end[close] - 1),
            docstring=None if form == "arrow" else s.doc_before(s.at[first]),
            source=s.text[s.at[first]:s.end[close]], owner_class=owner,
            calls=[] if is_class or form == "signature" else _calls(s, body, close + 1, inner), bases=[],
            params=s.params(p) if p is not None and not is_class else [],
            exported=exported))
        for q, d in sub.items():
            found.setdefault(q, d)
        # A named arrow is a definition, but its calls also count for what encloses it.
        stops += inner if form == "arrow" else [(i, close)]
        i = close + 1


def read_script(content: bytes, module: str, path: str) -> dict:
    s = _Scan(content.decode("utf8", "replace").removeprefix("\ufeff"),
              typed=path.endswith((".ts", ".tsx", ".mts")), markup=not path.endswith((".ts", ".mts")))
    found: dict = {}
    _walk(s, 0, len(s.tok), module, None, found, [])
    return {"defs": [{**d, "pos": i} for i, d in enumerate(found.values())], "attributes": [],
            "error": f"{path}: syntax errors (partial parse)" if s.broken else None}
