"""Finite-state transducers over the symbols of a clause, and their composition.

A step of a transducer reads a (symbol, event) pair and writes an event. Machines are given as step functions over
hashable states, composed into one machine whose state is the tuple of theirs, and compiled to tables by visiting
the states that can be reached.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = SYMBOLS = "oitynr"
#: What a clause can say: an insult, one aimed at somebody, a threat in passing, one aimed at somebody.
BARE_INSULT, AIMED_INSULT, BARE_THREAT, AIMED_THREAT = KINDS = "IDBT"
#: Each as it stands, denied, or told of others.
PLAIN, NEGATED, REPORTED = MODES = ("plain", "negated", "reported")
LABELS = [f"{kind}-{mode}" for mode in MODES for kind in KINDS]

Step = Callable[[object, str, str], tuple[object, str]]


@dataclass(frozen=True)
class Machine:
    start: object
    step: Step


def _aged(age: int, most: int) -> int:
    """Tokens since something was seen, up to most; most + 1: out of reach."""
    return min(age + 1, most + 1)


def aim(reach: int = 3) -> Machine:
    """Insults and threats, aimed if a target stands within reach before or after them."""

    def step(state, symbol, _):
        target, insult, threat = state
        event = ""
        if symbol == INSULT:
            event, insult = (AIMED_INSULT if target <= reach else BARE_INSULT), 0
        elif symbol == THREAT:
            event, threat = (AIMED_THREAT if target <= reach else BARE_THREAT), 0
        elif symbol == TARGET:
            event = AIMED_THREAT if threat <= reach else AIMED_INSULT if insult <= reach else ""
            target = 0
        return (_aged(target, reach), _aged(insult, reach), _aged(threat, reach)), event

    return Machine((reach + 1,) * 3, step)


def deny(reach: int = 3) -> Machine:
    """Marks events within reach after a negation."""

    def step(age, symbol, event):
        if symbol == NEGATION:
            age = 0
        made = f"{event}-{NEGATED if age <= reach else PLAIN}" if event else ""
        return _aged(age, reach), made

    return Machine(reach + 1, step)


def report() -> Machine:
    """Marks events after a verb of saying in the clause."""

    def step(told, symbol, event):
        told = told or symbol == REPORT
        return told, (f"{event.partition('-')[0]}-{REPORTED}" if event and told else event)

    return Machine(False, step)


def compose(*machines: Machine) -> Machine:
    """Each machine's events are the next one's."""

    def step(states, symbol, event):
        moved = []
        for machine, state in zip(machines, states):
            state, event = machine.step(state, symbol, event)
            moved.append(state)
        return tuple(moved), event

    return Machine(tuple(m.start for m in machines), step)


@dataclass(frozen=True)
class Tables:
    """A compiled machine: by state, each symbol's next state and label (an index into LABELS, or -1)."""

    moves: list[dict[str, tuple[int, int]]]

    def labels(self, symbols: Iterable[str], told: bool = False) -> list[tuple[int, int]]:
        """(place, label) of the events of a clause; told: it goes on with what somebody is quoted to have said."""
        state, found = (self.moves[0][REPORT][0] if told else 0), []
        for i, symbol in enumerate(symbols):
            state, label = self.moves[state][symbol]
            if label >= 0:
                found.append((i, label))
        return found


def compiled(machine: Machine) -> Tables:
    numbers, queue, moves = {machine.start: 0}, [machine.start], []
    while queue:
        state, row = queue.pop(0), {}
        for symbol in SYMBOLS:
            following, event = machine.step(state, symbol, "")
            if following not in numbers:
                numbers[following] = len(numbers)
                queue.append(following)
            row[symbol] = (numbers[following], LABELS.index(event) if event else -1)
        moves.append(row)
    return Tables(moves)


GRAMMAR = compiled(compose(aim(), deny(), report()))
