"""A reader of a part of a JSON document that begins after some comma outside strings, for documents that no task holds whole. Plain Python, for use inside executors and, for `compose`, on summaries of parts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from json.decoder import scanstring
from typing import NamedTuple

from .json_leaves import _OTHER, _SPACE, Malformed, well_formed

_ESCAPED = re.compile(r"\\.", re.DOTALL)
PIECE = 65_536  # characters that are read at once, or a string of more


class Level(NamedTuple):
    """An open object or array: its bracket, and the name and number of the member that holds it (None for the document and for what an array holds)."""

    kind: str
    name: str | None
    id: int | None


class Member(NamedTuple):
    """A member of an object: its number in the document's order; how many of the levels open at the part's begin are closed by now; how many members of this part lead to it, and the number of the last of them; names and numbers of
    these members, its own last (its own alone, if its value is no string); its value, None if it is no string."""

    id: int
    up: int
    depth: int
    parent: int | None
    names: list[str]
    ids: list[int]
    value: str | None


def quotes(segment: str) -> int:
    """How many quotes of a stretch between commas begin or end a string."""
    return (_ESCAPED.sub("", segment) if "\\" in segment else segment).count('"')


class Chunk:
    """Reads one part, in order, in pieces that end after a comma outside strings or at the part's end.

    Which brackets are open at the begin isn't known: that the levels around are objects or arrays is learned from what follows (a string and a colon, or a closing bracket) and kept in `outer`, innermost first, for compose() to check. What an array
    opened in this part holds gives no members.
    """

    def __init__(self, number: int) -> None:
        self.next = number << 40
        self.open: list[Level] = []
        self.outer: list[str] = []
        self.up = self.arrays = 0
        self.state = "item" if number else "value"  # what comes next: item, after a comma; name; value; after a value

    def _around(self) -> str | None:
        return self.open[-1].kind if self.open else self.outer[self.up] if self.up < len(self.outer) else None

    def _learned(self, kind: str) -> None:
        if not self.open and self.up == len(self.outer):
            self.outer.append(kind)

    def feed(self, document: str) -> Iterator[Member]:
        """The members that begin in the piece; raises Malformed. As it is a generator, it must be read to its end."""
        space, i, n = _SPACE.match, 0, len(document)
        name, id_ = None, None

        def text(at: int) -> tuple[str, int]:
            try:
                found, end = scanstring(document, at + 1, True)
            except ValueError as e:
                raise Malformed(str(e)) from None
            return well_formed(found), space(document, end).end()

        while True:
            i = space(document, i).end()
            if i == n and self.state in ("item", "after"):
                return
            c = document[i : i + 1]
            if self.state in ("item", "name"):
                around = self._around()
                if c == '"' and around != "[":
                    found, end = text(i)
                    if document[end : end + 1] == ":":
                        self._learned("{")
                        name, id_, i, self.next = found, self.next, space(document, end + 1).end(), self.next + 1
                        self.state = "value"
                        if not self.arrays and document[i : i + 1] != '"':
                            yield self._member(id_, name, None)
                        continue
                    if around == "{":
                        raise Malformed(f"no colon at {end}")
                elif around == "{":
                    raise Malformed(f"no name at {i}")
                self._learned("[")
                self.state = "value"
            elif self.state == "value":
                if c == '"':
                    found, i = text(i)
                    if name is not None and not self.arrays:
                        yield self._member(id_, name, found)
                    self.state = "after"
                elif c in ("{", "["):
                    self.open.append(Level(c, name, id_))
                    self.arrays += c == "["
                    i = space(document, i + 1).end()
                    empty = document[i : i + 1] == ("}" if c == "{" else "]")
                    self.state = "after" if empty else "name" if c == "{" else "value"
                else:
                    m = _OTHER.match(document, i)
                    if m is None:
                        raise Malformed(f"no value at {i}")
                    i, self.state = m.end(), "after"
                name = id_ = None
            elif c == ",":
                i, self.state = i + 1, "item"
            elif c in ("}", "]"):
                kind = "{" if c == "}" else "["
                if self._around() not in (None, kind):
                    raise Malformed(f"{c} for another bracket at {i}")
                self._learned(kind)
                if self.open:
                    self.arrays -= self.open.pop().kind == "["
                else:
                    self.up += 1
                i += 1
            else:
                raise Malformed(f"neither comma nor end at {i}")

    def _member(self, id_: int, name: str, value: str | None) -> Member:
        depth = len(self.open) - bool(self.open and self.open[0].name is None)  # only the document itself has no name here
        parent, held = self.open[-1].id if depth else None, self.open[-depth:] if depth and value is not None else []
        return Member(id_, self.up, depth, parent, [*(level.name for level in held), name], [*(level.id for level in held), id_], value)

    def summary(self) -> dict:
        return {"outer": self.outer, "up": self.up, "open": self.open, "state": self.state}


def read(number: int, last: bool, segments: Iterable[str]) -> Iterator[Member | dict]:
    """The members of a part given as its stretches between commas, and at the end its summary. last: whether it is the document's last part, after which no comma stands. Held is one piece."""
    chunk, held, size, inside = Chunk(number), [], 0, False
    try:
        for segment in segments:
            if size >= PIECE and not inside:
                yield from chunk.feed(",".join(held) + ",")
                held, size = [], 0
            held.append(segment)
            size += len(segment)
            inside ^= quotes(segment) & 1
        yield from chunk.feed(",".join(held) + ("" if last else ","))
        yield chunk.summary()
    except Malformed as e:
        yield {"error": str(e)}


def compose(summaries: list[dict]) -> list[list[Level]]:
    """The levels open at the begin of each part, outermost first, from the summaries of all parts in order; raises Malformed if they make no document."""
    levels: list[Level] = []
    begins = []
    for i, s in enumerate(summaries):
        begins.append(levels)
        if "error" in s:
            raise Malformed(f"{s['error']} of part {i}")
        if len(s["outer"]) > len(levels) or any(kind != level.kind for kind, level in zip(s["outer"], reversed(levels), strict=False)):
            raise Malformed(f"brackets of part {i} that belong to no others")
        levels = levels[: len(levels) - s["up"]] + [Level(*x) for x in s["open"]]
        if not levels and i + 1 < len(summaries):
            raise Malformed(f"more after the document in part {i + 1}")
    if levels or summaries and summaries[-1]["state"] != "after":
        raise Malformed("no end of the document")
    return begins
