"""Uses of module-level names in JavaScript and TypeScript with JSX: where they stand, and whether each could become a call. Plain Python, for use inside executors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from . import jsx as J

#: Methods that change an array in place.
MUTATING = ["push", "splice", "pop", "shift", "unshift", "sort", "reverse", "fill"]

_STARTS = frozenset("const let var export import function class type interface enum declare async if for while switch try return throw".split())
_GOES_ON = frozenset("as satisfies instanceof in of".split())
_UNFINISHED = frozenset("as satisfies instanceof in of typeof new await return delete void extends keyof".split())
_HEADS = frozenset("if for while switch catch with".split())


@dataclass(frozen=True)
class Declared:
    """A top-level `const name: type = value`. at: the name's token; ends are places in the code."""

    name: str
    exported: bool
    at: J.Token
    equals: J.Token
    value: tuple[int, int]
    tokens: list[J.Token] = field(compare=False)


@dataclass(frozen=True)
class Use:
    name: J.Token
    body: int  # where the component's body begins
    waits: bool
    short: bool  # { name } in an object


@dataclass(frozen=True)
class _Where:
    component: str | None = None
    carrier: str | None = None
    function: bool = False
    body: int | None = None
    waits: bool = False
    params: bool = False
    braces: bool = False  # directly in { }
    hidden: frozenset[str] = frozenset()


def value_end(code: str, tokens: list[J.Token], i: int) -> int:
    """The index after the expression or type that begins at i: at a semicolon, a comma, or a line that cannot continue it."""
    j = i + 1
    while j < len(tokens):
        t, before = tokens[j], tokens[j - 1]
        if t.kind == "punct" and t.text in (";", ","):
            break
        open_ended = before.kind == "punct" or before.kind == "name" and before.text in _UNFINISHED
        if not open_ended and t.kind != "punct":
            line = "\n" in code[before.end : t.start]
            if line and not (t.kind == "template" or t.kind == "group" and t.text in "([" or t.kind == "name" and t.text in _GOES_ON):
                break
            if t.kind == "name" and t.text in _STARTS and before.kind in ("group", "string", "number", "template"):
                break
        j += 1
    return j


def pattern_names(tokens: list[J.Token]) -> set[str]:
    """Names that a pattern, or a list of parameters, binds: neither keys, defaults nor types."""
    found: set[str] = set()
    for item in split(tokens):
        item = item[1:] if item and item[0].text == "..." else item
        if not item:
            continue
        first = item[0]
        if first.kind == "group" and first.text in "{[":
            for part in split(first.parts):
                keyed = first.text == "{" and len(part) > 2 and part[1].text == ":"
                found |= pattern_names(part[2:] if keyed else part)
        elif first.kind == "name":
            found.add(first.text)
    return found


def split(tokens: list[J.Token]) -> Iterator[list[J.Token]]:
    """Items between commas."""
    item: list[J.Token] = []
    for t in tokens:
        if t.kind == "punct" and t.text == ",":
            yield item
            item = []
        else:
            item.append(t)
    yield item


def level_names(tokens: list[J.Token]) -> set[str]:
    """Names that the statements of one block declare."""
    found: set[str] = set()
    for i, t in enumerate(tokens[:-1]):
        after = tokens[i + 1]
        if t.kind == "name" and t.text in ("const", "let", "var") and not (i and tokens[i - 1].text == "as"):
            j = i + 1
            while j < len(tokens):  # declarators
                found |= pattern_names([tokens[j]])
                while j < len(tokens) and not (tokens[j].kind == "punct" and tokens[j].text in (",", ";")) and not (j > i + 1 and tokens[j].kind == "name" and tokens[j].text in ("const", "let", "var")):
                    j += 1
                if j >= len(tokens) or tokens[j].text != ",":
                    break
                j += 1
        elif t.kind == "name" and t.text in ("function", "class") and after.kind == "name":
            found.add(after.text)
    return found


def constants(code: str, tokens: list[J.Token]) -> list[Declared]:
    """The top-level constants with a plain name and a value, in order."""
    out = []
    for i, t in enumerate(tokens):
        if t.kind != "name" or t.text != "const" or i and tokens[i - 1].text == "as" or i + 1 < len(tokens) and tokens[i + 1].text == "enum":
            continue
        exported, j = i > 0 and tokens[i - 1].text == "export", i + 1
        while j < len(tokens):
            k = next((k for k in range(j + 1, len(tokens)) if tokens[k].kind == "punct" and tokens[k].text in ("=", ";")), len(tokens))
            if k + 1 >= len(tokens) or tokens[k].text == ";":
                break
            end = value_end(code, tokens, k + 1)
            if tokens[j].kind == "name":
                out.append(Declared(tokens[j].text, exported, tokens[j], tokens[k], (tokens[k + 1].start, tokens[end - 1].end), tokens[k + 1 : end]))
            if end >= len(tokens) or tokens[end].text != ",":
                break
            j = end + 1
    return out


class Uses:
    """The uses of module-level names: found, those in components that could become calls; reasons, why a name must stay as it is."""

    def __init__(self, code: str, tokens: list[J.Token], names: set[str]) -> None:
        self.code, self.names, self.found, self.reasons = code, names, [], {}
        skipped = [(x.start, x.end) for x in J.imports(tokens)]
        kept = [t for t in tokens if not any(a <= t.start < b for a, b in skipped)] if skipped else tokens
        with J.deep(code):
            self.walk(kept, _Where())

    def unsafe(self, name: str, why: str) -> None:
        self.reasons.setdefault(name, why)

    def clash(self, bound: set[str], where: str) -> None:
        for name in sorted(bound & self.names):
            self.unsafe(name, f"bound again by a {where}")

    def inner(self, tokens: list[J.Token], where: _Where) -> None:
        """A block: what it declares hides names around it."""
        self.walk(tokens, replace(where, hidden=where.hidden | (level_names(tokens) & self.names)))

    def walk(self, tokens: list[J.Token], where: _Where) -> None:
        arrows = {self.first(tokens, k): k for k, t in enumerate(tokens) if t.kind == "punct" and t.text == "=>"}
        i, outer = 0, where
        while i < len(tokens):
            t, before, after = tokens[i], tokens[i - 1] if i else None, tokens[i + 1] if i + 1 < len(tokens) else None
            member = before is not None and before.kind == "punct" and before.text in (".", "?.")
            if not outer.function and t.kind == "punct" and t.text == ";":
                where = outer
            if not outer.function and t.kind == "name" and t.text in ("const", "let", "var", "export") and not (before is not None and before.text == "as"):
                where = replace(outer, carrier=after.text if t.text != "export" and after is not None and after.kind == "name" else None)
            if i in arrows:
                i = self.arrow(tokens, i, arrows[i], where)
                continue
            if t.kind == "name" and not member:
                if t.text == "function":
                    i = self.function(tokens, i, where)
                    continue
                if t.text == "class":
                    j = next((j for j in range(i, len(tokens)) if tokens[j].kind == "group" and tokens[j].text == "{"), len(tokens))
                    self.walk(tokens[i + 1 : j], where)
                    self.inner(tokens[j].parts if j < len(tokens) else [], replace(where, component=None, function=True, body=None))
                    i = j + 1
                    continue
                if t.text == "type" and after is not None and after.kind == "name" and i + 2 < len(tokens) and tokens[i + 2].text in ("=", "<"):
                    i = value_end(self.code, tokens, i + 2)
                    continue
                if t.text == "interface" and after is not None and after.kind == "name":
                    i = next((j for j in range(i, len(tokens)) if tokens[j].kind == "group" and tokens[j].text == "{"), len(tokens)) + 1
                    continue
                if t.text == "export" and after is not None and after.kind == "group" and after.text == "{":
                    for item in split(after.parts):
                        if len(item) > 1 and item[0].text in self.names:
                            self.unsafe(item[0].text, "exported under another name")
                    i += 2
                    continue
                if t.text in self.names and t.text not in where.hidden:
                    self.use(tokens, i, where)
            if t.kind == "group" and t.text == "(" and after is not None and after.kind == "group" and after.text == "{" and before is not None and before.kind == "name":
                bound = level_names(t.parts) if before.text == "for" else set() if before.text in _HEADS - {"catch"} else pattern_names(t.parts)
                self.clash(bound, "loop, method or catch")
            self.token(t, where)
            i += 1

    def token(self, t: J.Token, where: _Where) -> None:
        plain = replace(where, braces=False)
        if t.kind == "group":
            self.inner(t.parts, replace(where, braces=t.text == "{"))
        elif t.kind == "hole":
            self.walk(t.parts, plain)
        elif t.kind == "template":
            for p in t.parts:
                if isinstance(p, list):
                    self.walk(p, plain)
        elif t.kind == "jsx":
            if (root := re.split(r"[.:]", t.text)[0]) in self.names and root not in where.hidden:
                self.unsafe(root, "used as an element")
            for *_, value in t.attributes:
                if value is not None and value.kind == "group":
                    self.walk(value.parts, plain)
                elif value is not None:
                    self.token(value, plain)
            for c in t.children:
                self.token(c, plain)

    @staticmethod
    def first(tokens: list[J.Token], k: int) -> int:
        """Where the parameters of the arrow at k begin; a result type may stand between."""
        i = k - 1
        while i > 0 and not (tokens[i].kind == "group" and tokens[i].text == "(" and (i + 1 == k or tokens[i + 1].text == ":")) and not (i + 1 == k and tokens[i].kind == "name"):
            i -= 1
        return max(i, 0)

    def scope(self, own: str | None, params: list[J.Token], body: J.Token | None, waits: bool, where: _Where) -> _Where:
        start = body.start + 1 if body is not None else None
        bound = pattern_names(params) | (level_names(body.parts) if body is not None else set())
        now = replace(where, carrier=None, function=True, braces=False, hidden=where.hidden | (bound & self.names))
        return replace(now, component=own, body=start, waits=waits) if own else now

    def arrow(self, tokens: list[J.Token], first: int, k: int, where: _Where) -> int:
        own = None if where.function else where.carrier
        block = tokens[k + 1] if k + 1 < len(tokens) and tokens[k + 1].kind == "group" and tokens[k + 1].text == "{" else None
        params = tokens[first].parts if tokens[first].kind == "group" else [tokens[first]]
        now = self.scope(own, params, block, first > 0 and tokens[first - 1].text == "async", where)
        self.walk(params, replace(now, params=True))
        if block is not None:
            self.inner(block.parts, now)
            return k + 2
        end = value_end(self.code, tokens, k + 1) if k + 1 < len(tokens) else k + 1
        self.walk(tokens[k + 1 : end], now)
        return end

    def function(self, tokens: list[J.Token], i: int, where: _Where) -> int:
        before = tokens[i - 1] if i else None
        waits = before is not None and before.text == "async"
        before = (tokens[i - 2] if i > 1 else None) if waits else before
        statement = J.begins_statement(self.code, before, tokens[i])
        j = next((j for j in range(i, len(tokens)) if tokens[j].kind == "group" and tokens[j].text == "("), len(tokens))
        k = next((k for k in range(j + 1, len(tokens)) if tokens[k].kind == "group" and tokens[k].text == "{" and tokens[k - 1].text not in (":", "|", "&")), len(tokens))
        if k >= len(tokens):
            return i + 1
        name = next((t.text for t in tokens[i + 1 : j] if t.kind == "name"), None)
        own = name if statement else None if where.function else where.carrier
        now = self.scope(own, tokens[j].parts, tokens[k], waits, where)
        self.walk(tokens[j].parts, replace(now, params=True))
        self.inner(tokens[k].parts, now)
        return k + 1

    def use(self, tokens: list[J.Token], i: int, where: _Where) -> None:
        t, before, after = tokens[i], tokens[i - 1] if i else None, tokens[i + 1] if i + 1 < len(tokens) else None
        begins = before is None or before.kind == "punct" and before.text == ","
        if where.braces and begins and after is not None and after.text == ":":
            return  # a key
        if not where.function and before is not None and before.text == "const" or before is not None and before.text == "," and not where.function and not where.braces and after is not None and after.text in ("=", ":"):
            return  # its own declaration
        if before is not None and before.kind == "name" and before.text == "typeof":
            kind = tokens[i - 2] if i > 1 else None
            if kind is None or kind.text not in (":", "keyof", "as", "<", "|", "&", "satisfies"):
                self.unsafe(t.text, "its type is asked for")
            return
        if why := self.changed(tokens, i):
            self.unsafe(t.text, why)
        elif where.params:
            self.unsafe(t.text, "used in a parameter's default")
        elif not (where.component and re.match("[A-Z]", where.component)):
            self.unsafe(t.text, "used outside a component")
        elif where.body is None:
            self.unsafe(t.text, "used in a component without a block body")
        elif after is not None and after.kind == "group" and after.text == "(":
            self.unsafe(t.text, "called")
        else:
            self.found.append(Use(t, where.body, where.waits, where.braces and begins and (after is None or after.text == ",")))

    @staticmethod
    def changed(tokens: list[J.Token], i: int) -> str | None:
        """Why the use at i changes the value: assignment, update, deletion or a method, of itself or of what it holds at any depth."""
        if i and tokens[i - 1].text == "delete":
            return "changed by delete"
        if i > 1 and tokens[i - 1].text in ("+", "-") and tokens[i - 2].text == tokens[i - 1].text and tokens[i - 2].end == tokens[i - 1].start and tokens[i - 1].end == tokens[i].start:
            return "changed by an update"
        j = i + 1
        while j < len(tokens):
            if tokens[j].text in (".", "?.") and j + 1 < len(tokens) and tokens[j + 1].kind == "name":
                if tokens[j + 1].text in MUTATING and j + 2 < len(tokens) and tokens[j + 2].kind == "group" and tokens[j + 2].text == "(":
                    return f"changed by .{tokens[j + 1].text}()"
                j += 2
            elif tokens[j].kind == "group" and tokens[j].text == "[" or tokens[j].text == "!" and j + 1 < len(tokens) and tokens[j + 1].text in (".", "["):
                j += 1
            else:
                break
        run = ""
        while j < len(tokens) and tokens[j].kind == "punct" and (not run or tokens[j - 1].end == tokens[j].start):
            run, j = run + tokens[j].text, j + 1
        if re.match(r"(?:\+\+|--)", run):
            return "changed by an update"
        return "changed by assignment" if re.match(r"(?:\*\*|<<|>>>?|&&|\|\||\?\?|[-+*/%&|^])?=(?![=>])", run) else None


class Calls(Uses):
    """The uses of local names in the body of a function: keys, the first arguments of their calls where these are plain strings; reasons, why a name has other uses. The same scopes hold: names bound again are others."""

    #: Methods of a translator that take a key.
    METHODS = frozenset(["rich", "markup", "raw", "has"])

    def __init__(self, code: str, tokens: list[J.Token], names: set[str]) -> None:
        self.keys: list[J.Token] = []
        super().__init__(code, tokens, names)

    def use(self, tokens: list[J.Token], i: int, where: _Where) -> None:
        before, j = tokens[i - 1] if i else None, i + 1
        begins = before is None or before.kind == "punct" and before.text == ","
        if where.braces and begins and j < len(tokens) and tokens[j].text == ":":
            return  # a key
        if not where.function and before is not None and before.text == "const":
            return  # its own declaration
        if j + 1 < len(tokens) and tokens[j].text in (".", "?.") and tokens[j + 1].text in self.METHODS:
            j += 2
        args = tokens[j].parts if j < len(tokens) and tokens[j].kind == "group" and tokens[j].text == "(" else []
        if args and args[0].kind == "string" and (len(args) == 1 or args[1].text == ","):
            self.keys.append(args[0])
        else:
            self.unsafe(tokens[i].text, "used other than in a call with a plain string")
