"""A streaming reader of JSON documents: the string leaves in the order of the document, with a stack of paths in place of a tree. Plain Python, for use inside executors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_OTHER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")
_LONE = re.compile("[\ud800-\udfff]")


class Malformed(ValueError):
    """The text is a malformed JSON document."""


class Repeated(Exception):
    """An object has a name twice."""


class Step:
    """A member on the path: its name, its place among the names of its object, and which value of a repeated name it is. members: of its object, how many values each name has by now."""

    __slots__ = ("members", "name", "nth", "place")

    def __init__(self, name: str, members: dict[str, list[int]]) -> None:
        place, n = members.setdefault(name, [len(members), 0])
        members[name][1] = n + 1
        self.name, self.place, self.nth, self.members = name, place, n + 1, members

    def last(self) -> bool:
        return self.nth == self.members[self.name][1]


def well_formed(s: str) -> str:
    """Lone surrogates, which JSON can spell but UTF-8 cannot, become U+FFFD."""
    return _LONE.sub("�", s)


def string_leaves(document: str, repeats: bool = False) -> Iterator[tuple[tuple[Step, ...], str]]:
    """Path and value of each string that only objects hold, in order. What arrays hold, numbers, booleans and nulls are read over; a document that is no object has no leaves.

    One pass without a tree: kept are the path, and for each open object the names seen in it. Raises Malformed, which may come at the very end; then what came before must be forgotten. At the second value of a name Repeated is
    raised, unless repeats.
    """
    space, other, n = _SPACE.match, _OTHER.match, len(document)
    path: list[Step] = []
    open_: list[dict[str, list[int]] | None] = []  # the members of each open object, None for an array
    arrays, i, state = 0, space(document).end(), "value"

    def text(at: int) -> tuple[str, int]:
        try:
            found, end = scanstring(document, at + 1, True)
        except ValueError as e:
            raise Malformed(str(e)) from None
        return well_formed(found), end

    while True:
        c = document[i : i + 1]
        if state == "value" and c in ("{", "["):
            i = space(document, i + 1).end()
            open_.append({} if c == "{" else None)
            arrays += c == "["
            closing = document[i : i + 1] == ("}" if c == "{" else "]")
            state = "close" if closing else "name" if c == "{" else "value"
        elif state == "value":
            if c == '"':
                value, i = text(i)
                if open_ and not arrays:
                    yield tuple(path), value
            else:
                m = other(document, i)
                if m is None:
                    raise Malformed(f"no value at {i}")
                i = m.end()
            state = "after"
        elif state == "name":
            if c != '"':
                raise Malformed(f"no name at {i}")
            name, i = text(i)
            path.append(Step(name, open_[-1]))
            if path[-1].nth > 1 and not repeats:
                raise Repeated(name)
            i = space(document, i).end()
            if document[i : i + 1] != ":":
                raise Malformed(f"no colon at {i}")
            i, state = space(document, i + 1).end(), "value"
        elif state == "close":
            arrays -= open_.pop() is None
            i, state = i + 1, "after"
        else:
            i = space(document, i).end()
            if not open_:
                if i < n:
                    raise Malformed(f"more after the document at {i}")
                return
            inside = open_[-1] is not None
            if inside:
                path.pop()
            c = document[i : i + 1]
            if c == ",":
                i, state = space(document, i + 1).end(), "name" if inside else "value"
            elif c == ("}" if inside else "]"):
                state = "close"
            else:
                raise Malformed(f"neither comma nor end at {i}")


def dotted(path: tuple[Step, ...]) -> str:
    """The key of a path. A key that is empty so far adds no dot."""
    key = ""
    for step in path:
        key = f"{key}.{step.name}" if key else step.name
    return key


def leaves(document: str) -> list[tuple[str, str]]:
    """Dotted key and value of each string leaf in the order of the document [SRC3, STR6]; raises Malformed.

    Of a repeated name the last value counts, with all that is below it, at the place of the first, as a parser that builds a tree has it; so does of two paths with one dotted key the later value at the earlier place.
    """
    try:
        found = [(dotted(path), value) for path, value in string_leaves(document)]
    except Repeated:
        every = [row for row in list(string_leaves(document, repeats=True)) if all(step.last() for step in row[0])]
        every.sort(key=lambda row: [step.place for step in row[0]])
        found = [(dotted(path), value) for path, value in every]
    return list(dict(found).items())


def entries(document: str, strict: bool = False) -> dict[str, str]:
    """The strings of a flat object by name, in order, of a repeated name the last; raises Malformed. strict: an object with strings below the top is malformed too."""
    every = list(string_leaves(document, repeats=True))
    below = next((path[0].name for path, _ in every if len(path) > 1), None)
    if strict and below is not None:
        raise Malformed(f"{below} is no string")
    flat = [(path[0].place, path[0].name, value) for path, value in every if len(path) == 1 and path[0].last()]
    return {name: value for _, name, value in sorted(flat, key=lambda row: row[0])}
