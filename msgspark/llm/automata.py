"""Weighted finite-state transducers that read and write one symbol at a time: composition, and the best path through a sequence."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

Arc = tuple[str, int, float]  # output, next state, weight


@dataclass
class Machine:
    """State 0 is the start. arcs[state][symbol]: the arcs that read the symbol; a missing one ends the path. final: states in which a sequence may end."""

    arcs: list[dict[str, list[Arc]]] = field(default_factory=lambda: [{}])
    final: set[int] = field(default_factory=set)

    def best(self, symbols: str) -> tuple[float, str] | None:
        """Weight and output of the heaviest path that reads all symbols and ends in a final state; None without one. Of equal paths the one found first, in the order of states and arcs.

        Paths are linked lists that share their beginnings, so memory follows the sequence and not the number of paths.
        """
        front: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for s in symbols:
            after: dict[int, tuple[float, tuple | None]] = {}
            for state, (weight, path) in front.items():
                for out, to, w in self.arcs[state].get(s, ()):
                    if to not in after or weight + w > after[to][0]:
                        after[to] = (weight + w, (path, out))
            front = after
        ends = [x for state, x in front.items() if state in self.final]
        if not ends:
            return None
        weight, path = max(ends, key=lambda x: x[0])
        out = []
        while path is not None:
            path, last = path
            out.append(last)
        return weight, "".join(reversed(out))


def machine(rules: Iterable[tuple[str, str, str | None, str, float]], final: Iterable[str]) -> Machine:
    """From rules (state, symbols read, output or None for the symbol itself, next state, weight); the first rule's state is the start."""
    names: dict[str, int] = {}
    made = Machine([])
    number = lambda name: names.setdefault(name, len(names))
    for state, read, out, to, weight in rules:
        a, b = number(state), number(to)
        while len(made.arcs) < len(names):
            made.arcs.append({})
        for s in read:
            made.arcs[a].setdefault(s, []).append((out or s, b, weight))
    made.final = {names[f] for f in final if f in names}
    return made


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that does what `second` does to what `first` writes: reachable pairs of states, weights added."""
    numbers, todo, made = {(0, 0): 0}, [(0, 0)], Machine([{}])
    for pair in todo:  # grows while it is read
        p, q = pair
        here = made.arcs[numbers[pair]]
        for s, arcs in first.arcs[p].items():
            for out, p2, w in arcs:
                for out2, q2, w2 in second.arcs[q].get(out, ()):
                    if (p2, q2) not in numbers:
                        numbers[p2, q2] = len(made.arcs)
                        made.arcs.append({})
                        todo.append((p2, q2))
                    here.setdefault(s, []).append((out2, numbers[p2, q2], w + w2))
        if p in first.final and q in second.final:
            made.final.add(numbers[pair])
    return made
