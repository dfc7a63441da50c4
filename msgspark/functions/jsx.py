"""A lenient reader of JavaScript and TypeScript with JSX: tokens in bracket groups, and elements as trees. Plain Python, for use inside executors."""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)+", re.DOTALL)
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"\d[\w.]*")
_TAG = re.compile(r"[A-Za-z_$][\w$.:-]*")
_PUNCT = re.compile(r"=>|\?\?=?|\?\.|\.\.\.|[=!]==?|&&|\|\||[-+*/%<>=!&|^~?:;,.@#]")
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\n\\])*\]|[^/\n\\\[])+/[a-z]*")
_ESCAPE = re.compile(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r?\n|.)", re.DOTALL)
_BEFORE_VALUE = frozenset("return typeof case in of default do else void delete await yield new throw instanceof".split())
_CLOSE = {"(": ")", "[": "]", "{": "}"}


class Unreadable(ValueError):
    """The code has no closing bracket, quote or tag."""


@dataclass
class Token:
    kind: str  # name, number, string, template, punct, regex, group, jsx, text, hole
    text: str
    start: int
    end: int = 0
    parts: list = field(default_factory=list)  # a group's tokens; a template's strings and expressions in turn
    attributes: list[tuple[str, int, int, Token | None]] = field(default_factory=list)  # name, start, end, value
    children: list[Token] = field(default_factory=list)


def unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] == "u" and len(c) > 1:
            return chr(int(c.strip("u{}"), 16))
        if c[0] == "x" and len(c) == 3:
            return chr(int(c[1:], 16))
        return {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}.get(c, "" if c[-1] == "\n" else c)

    return _ESCAPE.sub(one, s)


class Reader:
    def __init__(self, code: str) -> None:
        self.code = code
        self.lines = [0, *(m.end() for m in re.finditer("\n", code))]

    def place(self, at: int) -> tuple[int, int]:
        """Line from 1, column from 0."""
        n = bisect_right(self.lines, at)
        return n, at - self.lines[n - 1]

    def read(self) -> list[Token]:
        tokens, at = self._tokens(0, "")
        if at != len(self.code):
            raise Unreadable(f"unexpected {self.code[at]!r} at {at}")
        return tokens

    def _tokens(self, i: int, close: str) -> tuple[list[Token], int]:
        code, out = self.code, []
        while True:
            if m := _SPACE.match(code, i):
                i = m.end()
            if i >= len(code):
                if close:
                    raise Unreadable(f"no {close}")
                return out, i
            c = code[i]
            if c in ")]}":
                if c != close:
                    if close:
                        raise Unreadable(f"{c} for {close} at {i}")
                    return out, i
                return out, i
            if c in _CLOSE:
                parts, j = self._tokens(i + 1, _CLOSE[c])
                out.append(Token("group", c, i, j + 1, parts))
                i = j + 1
            elif c in "\"'":
                out.append(t := self._string(i))
                i = t.end
            elif c == "`":
                out.append(t := self._template(i))
                i = t.end
            elif c == "<" and self._value_next(out) and (m := re.compile(r"<(?:>|[A-Za-z_$])").match(code, i)) and not re.compile(r"<\s*[A-Za-z_$][\w$]*\s*(?:,|extends\b)").match(code, i):
                out.append(t := self._element(i))
                i = t.end
            elif c == "/" and self._value_next(out) and (m := _REGEX.match(code, i)):
                out.append(Token("regex", m[0], i, m.end()))
                i = m.end()
            elif m := _NAME.match(code, i):
                out.append(Token("name", m[0], i, m.end()))
                i = m.end()
            elif m := _NUMBER.match(code, i):
                out.append(Token("number", m[0], i, m.end()))
                i = m.end()
            elif m := _PUNCT.match(code, i):
                out.append(Token("punct", m[0], i, m.end()))
                i = m.end()
            else:
                i += 1

    @staticmethod
    def _value_next(out: list[Token]) -> bool:
        """Whether a value, not an operator, stands next."""
        if not out:
            return True
        last = out[-1]
        return last.kind == "punct" or last.kind == "name" and last.text in _BEFORE_VALUE or last.kind == "group" and last.text == "{"

    def _string(self, i: int) -> Token:
        m = re.compile(r"(['\"])((?:\\.|(?!\1)[^\\\n])*)\1", re.DOTALL).match(self.code, i)
        if not m:
            raise Unreadable(f"no end of string at {i}")
        return Token("string", unescape(m[2]), i, m.end())

    def _template(self, i: int) -> Token:
        code, j, text, parts = self.code, i + 1, "", []
        while True:
            if j >= len(code):
                raise Unreadable(f"no end of template at {i}")
            if code[j] == "\\":
                text, j = text + code[j : j + 2], j + 2
            elif code[j] == "`":
                return Token("template", "", i, j + 1, [*parts, unescape(text)])
            elif code.startswith("${", j):
                inner, end = self._tokens(j + 2, "}")
                parts += [unescape(text), inner]
                text, j = "", end + 1
            else:
                text, j = text + code[j], j + 1

    def _skip(self, i: int) -> int:
        m = _SPACE.match(self.code, i)
        return m.end() if m else i

    def _element(self, i: int) -> Token:
        """An element or a fragment, whose name is empty."""
        code = self.code
        j = self._skip(i + 1)
        m = _TAG.match(code, j)
        out = Token("jsx", m[0] if m else "", i)
        j = self._skip(m.end() if m else j)
        if m and code.startswith("<", j):  # type arguments
            depth = 0
            while j < len(code):
                depth += {"<": 1, ">": -1}.get(code[j], 0)
                j += 1
                if not depth:
                    break
            j = self._skip(j)
        while True:
            if j >= len(code):
                raise Unreadable(f"no end of tag at {i}")
            if code.startswith("/>", j):
                out.end = j + 2
                return out
            if code[j] == ">":
                j += 1
                break
            if code[j] == "{":
                parts, end = self._tokens(j + 1, "}")
                out.attributes.append(("...", j, end + 1, Token("group", "{", j, end + 1, parts)))
                j = self._skip(end + 1)
                continue
            m = _TAG.match(code, j)
            if not m:
                raise Unreadable(f"no attribute at {j}")
            name, start, j = m[0], j, self._skip(m.end())
            value = None
            if code.startswith("=", j):
                j = self._skip(j + 1)
                if code[j : j + 1] in ("'", '"') and j < len(code):
                    end = code.find(code[j], j + 1)
                    if end < 0:
                        raise Unreadable(f"no end of attribute at {j}")
                    value = Token("string", html.unescape(code[j + 1 : end]), j, end + 1)
                elif code.startswith("{", j):
                    parts, end = self._tokens(j + 1, "}")
                    value = Token("group", "{", j, end + 1, parts)
                elif code.startswith("<", j):
                    value = self._element(j)
                else:
                    raise Unreadable(f"no value at {j}")
                j = value.end
            out.attributes.append((name, start, value.end if value else m.end(), value))
            j = self._skip(j)
        while True:
            k = j
            while k < len(code) and code[k] not in "<{":
                k += 1
            if k >= len(code):
                raise Unreadable(f"no end of element at {i}")
            if k > j:
                out.children.append(Token("text", html.unescape(code[j:k]), j, k))
            if code[k] == "{":
                parts, end = self._tokens(k + 1, "}")
                out.children.append(Token("hole", "", k, end + 1, parts))
                j = end + 1
            elif code.startswith("</", k):
                out.end = code.find(">", k) + 1
                if not out.end:
                    raise Unreadable(f"no end of element at {i}")
                return out
            else:
                child = self._element(k)
                out.children.append(child)
                j = child.end


@contextmanager
def deep(code: str) -> Iterator[None]:
    """Lets pure Python functions recurse as deep as the code can nest. Such frames live on the heap, so depth costs memory only."""
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(max(old, 6 * len(code) + 1000))
    try:
        yield
    finally:
        sys.setrecursionlimit(old)


PIECE = 128  # files that a task holds as Python objects at once


def pieces(batches: Iterator) -> Iterator:
    """Arrow batches cut to PIECE rows, so that a task's objects and results don't grow with Spark's batches."""
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE):
            yield batch.slice(start, PIECE)


def read(code: str) -> list[Token]:
    """The tokens of a file, however deep it nests."""
    with deep(code):
        return Reader(code).read()


def begins_statement(code: str, before: Token | None, keyword: Token) -> bool:
    """Whether a function or class keyword after `before` (async left out) begins a declaration; a new line does, after what may end a statement."""
    if before is None or before.text in (";", "export", "default") or before.kind == "group" and before.text == "{" or before.kind in ("string", "jsx"):
        return True
    return before.kind != "punct" and "\n" in code[before.end : keyword.start]


def has_jsx(tokens: list) -> bool:
    todo = [tokens]
    while todo:
        for t in todo.pop():
            if isinstance(t, Token):
                if t.kind == "jsx":
                    return True
                if t.kind == "group":
                    todo.append(t.parts)
                elif t.kind == "template":
                    todo += [p for p in t.parts if isinstance(p, list)]
    return False


def names_in(tokens: list) -> set[str]:
    """All names in tokens, at any depth."""
    todo, found = [tokens], set()
    while todo:
        for t in todo.pop():
            if isinstance(t, Token):
                if t.kind == "name":
                    found.add(t.text)
                todo += [[p] if isinstance(p, Token) else p for p in t.parts if not isinstance(p, str)]
                todo += [[v] for *_, v in t.attributes if v is not None] + [t.children]
    return found


def bound_names(tokens: list, deeply: bool = True) -> set[str]:
    """Names that tokens declare: variables, functions, classes, parameters, and what patterns may bind (all names in them); at any depth, or on this level only."""
    todo, found = [tokens], set()
    while todo:
        here = [t for t in todo.pop() if isinstance(t, Token)]
        for i, t in enumerate(here):
            after = here[i + 1] if i + 1 < len(here) else None
            if t.kind == "name" and t.text in ("const", "let", "var", "function", "class", "catch") and after is not None:
                found |= {after.text} if after.kind == "name" else names_in(after.parts) if after.kind == "group" else set()
                later = here[i + 2] if i + 2 < len(here) else None
                if t.text == "function" and later is not None and later.kind == "group" and later.text == "(":
                    found |= names_in(later.parts)
            elif t.kind == "punct" and t.text == "=>" and i:
                before = here[i - 1]
                found |= {before.text} if before.kind == "name" else names_in(before.parts) if before.kind == "group" else set()
            if deeply:
                todo += ([t.parts] if t.kind in ("group", "hole") else []) + [p for p in t.parts if isinstance(p, list)]
                todo += [[v] for *_, v in t.attributes if v is not None] + [t.children]
    return found


@dataclass(frozen=True)
class Import:
    """One import or re-export. names: (imported, local); default and * are imported under these names."""

    source: str
    names: tuple[tuple[str, str], ...]
    type_only: bool
    start: int
    end: int
    group: Token | None = None  # the braces of named imports


def _clause(tokens: list[Token]) -> tuple[list[tuple[str, str]], bool, Token | None]:
    """Names of an import clause, whether all of them are types, and its braces."""
    names, types, group = [], [], None
    for i, t in enumerate(tokens):
        if t.kind == "group" and t.text == "{":
            group, item = t, []
            for x in [*t.parts, Token("punct", ",", t.end)]:
                if x.kind == "punct" and x.text == ",":
                    words = [y.text for y in item]
                    typed = len(words) > 1 and words[0] == "type" and words[1] != "as"
                    words = words[1:] if typed else words
                    if words:
                        names.append((words[0], words[-1]))
                        types.append(typed)
                    item = []
                else:
                    item.append(x)
        elif t.kind == "punct" and t.text == "*":
            names.append(("*", tokens[i + 2].text if i + 2 < len(tokens) else "*"))
            types.append(False)
        elif t.kind == "name" and t.text not in ("as", "type") and not (i and tokens[i - 1].text == "as"):
            names.append(("default", t.text))
            types.append(False)
    return names, bool(types) and all(types), group


def imports(tokens: list[Token]) -> list[Import]:
    """Import declarations and re-exports of a module's top level, in order."""
    out, i = [], 0
    while i < len(tokens):
        t = tokens[i]
        if t.kind == "name" and t.text in ("import", "export") and not (i and tokens[i - 1].text == "."):
            j = i + 1
            typed = j < len(tokens) and tokens[j].text == "type" and j + 1 < len(tokens) and tokens[j + 1].text not in ("from", ",")
            clause = j + typed
            while j < len(tokens) and j - clause < 8 and (tokens[j].kind == "name" and tokens[j].text not in ("from", "const", "let", "var", "function", "class", "import", "export", "default") or tokens[j].text in ("*", ",") or tokens[j].kind == "group" and tokens[j].text == "{"):
                j += 1
            if t.text == "import" and j < len(tokens) and tokens[j].kind == "string" and j == i + 1:
                out.append(Import(tokens[j].text, (), False, t.start, tokens[j].end))
                i = j
            elif j + 1 < len(tokens) and tokens[j].text == "from" and tokens[j + 1].kind == "string":
                names, all_types, group = _clause(tokens[clause:j])
                only = typed or (all_types and t.text == "import")
                out.append(Import(tokens[j + 1].text, tuple(names) if t.text == "import" else (), only, t.start, tokens[j + 1].end, group))
                i = j + 1
        i += 1
    return out


def runtime_imports(tokens: list[Token]) -> list[str]:
    """Distinct sources that a file loads when it runs [AGG17]: imports and re-exports but those of types alone, and import() of a string at any depth."""
    found = dict.fromkeys(x.source for x in imports(tokens) if not x.type_only)
    todo = [tokens]
    while todo:
        here = todo.pop()
        for i, t in enumerate(here):
            if not isinstance(t, Token):
                continue
            if t.kind == "name" and t.text == "import" and not (i and isinstance(here[i - 1], Token) and here[i - 1].text == ".") and i + 1 < len(here) and here[i + 1].kind == "group" and here[i + 1].text == "(" and here[i + 1].parts and here[i + 1].parts[0].kind == "string":
                found[here[i + 1].parts[0].text] = None
            todo += ([t.parts] if t.kind in ("group", "hole") else []) + [p for p in t.parts if isinstance(p, list)]
            todo += [[v] for *_, v in t.attributes if v is not None] + [t.children]
    return list(found)


def template_text(t: Token) -> str | None:
    """A template with its expressions as {name}; a.b.c becomes aBC, repeated names get 2, 3 ...; None if an expression is neither a name nor a path."""
    out, used = "", set()
    for part in t.parts:
        if isinstance(part, str):
            out += part
            continue
        names = [p.text for p in part[::2]]
        if not part or len(part) % 2 == 0 or any(p.kind != "name" for p in part[::2]) or any(p.text != "." for p in part[1::2]):
            return None
        name = final = names[0] + "".join(n[0].upper() + n[1:] for n in names[1:])
        n = 2
        while final in used:
            final, n = f"{name}{n}", n + 1
        used.add(final)
        out += "{" + final + "}"
    return out


def template_values(t: Token) -> list[tuple[str, str]]:
    """The placeholders of template_text with their expressions."""
    found, used = [], set()
    for part in t.parts:
        if isinstance(part, list):
            names = [p.text for p in part[::2]]
            name = final = names[0] + "".join(n[0].upper() + n[1:] for n in names[1:])
            n = 2
            while final in used:
                final, n = f"{name}{n}", n + 1
            used.add(final)
            found.append((final, ".".join(names)))
    return found


def unwrap(tokens: list[Token]) -> list[Token]:
    while len(tokens) == 1 and tokens[0].kind == "group" and tokens[0].text == "(":
        tokens = tokens[0].parts
    return tokens


def ternary(tokens: list[Token]) -> tuple[list[Token], list[Token]] | None:
    """Both branches, if the tokens are a conditional expression."""
    at = next((i for i, t in enumerate(tokens) if t.kind == "punct" and t.text == "?"), None)
    if at is None:
        return None
    depth = 0
    for i in range(at + 1, len(tokens)):
        if tokens[i].kind == "punct":
            if tokens[i].text == "?":
                depth += 1
            elif tokens[i].text == ":":
                if not depth:
                    return tokens[at + 1 : i], tokens[i + 1 :]
                depth -= 1
    return None
