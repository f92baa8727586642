"""Small weighted finite-state transducers: composition and the best path.

A `Machine` reads symbols and writes symbols; an arc may also name events, which a table of weights pays for. The
value of a path is the sum of its events' weights, and a reading's value is that of its best accepted path. Machines
may be non-deterministic: a guess about what follows is an arc into a state that only the awaited symbol leaves for
an accepting one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

Arc = tuple[str, tuple[str, ...], object]  # output, events, next state


@dataclass(frozen=True)
class Machine:
    start: object
    arcs: dict[tuple[object, str], tuple[Arc, ...]]
    finals: frozenset

    def best(self, symbols: Iterable[str], weights: dict[str, float]) -> tuple[float, tuple[str, ...]] | None:
        """Value and events of the best accepted path; None where no path is accepted. Of equal values the first arc wins."""
        here: dict[object, tuple[float, tuple[str, ...]]] = {self.start: (0.0, ())}
        for symbol in symbols:
            there: dict[object, tuple[float, tuple[str, ...]]] = {}
            for state, (value, events) in here.items():
                for _, paid, onward in self.arcs.get((state, symbol), ()):
                    v = value + sum(weights[e] for e in paid) if paid else value
                    if onward not in there or v > there[onward][0]:
                        there[onward] = (v, events + paid)
            here = there
        ends = [x for state, x in here.items() if state in self.finals]
        return max(ends, key=lambda x: x[0]) if ends else None


def machine(start: object, alphabet: Iterable[str], step: Callable[[object, str], list[Arc]], accepts: Callable[[object], bool]) -> Machine:
    """The machine of a rule: `step` gives the arcs that leave a state by a symbol; states are those reached."""
    alphabet, arcs, todo, seen = tuple(alphabet), {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in alphabet:
            out = tuple(step(state, symbol))
            if out:
                arcs[state, symbol] = out
            for _, _, onward in out:
                if onward not in seen:
                    seen.add(onward)
                    todo.append(onward)
    return Machine(start, arcs, frozenset(s for s in seen if accepts(s)))


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that feeds what `first` writes to `second`: states are pairs, paths are pairs of paths."""
    alphabet = sorted({symbol for _, symbol in first.arcs})

    def step(state: tuple, symbol: str) -> list[Arc]:
        a, b = state
        return [
            (out, paid + paid_too, (onward, onward_too))
            for middle, paid, onward in first.arcs.get((a, symbol), ()) for out, paid_too, onward_too in second.arcs.get((b, middle), ())
        ]

    whole = machine((first.start, second.start), alphabet, step, lambda s: s[0] in first.finals and s[1] in second.finals)
    # plain numbers for states, in the order they are reached
    name: dict[object, int] = {whole.start: 0}
    for (state, _), out in whole.arcs.items():
        for s in (state, *(onward for *_, onward in out)):
            name.setdefault(s, len(name))
    arcs = {(name[s], x): tuple((o, paid, name[onward]) for o, paid, onward in out) for (s, x), out in whole.arcs.items()}
    return Machine(0, arcs, frozenset(name[s] for s in whole.finals))
