"""Reports on units, and the registers that passages keep to."""

from __future__ import annotations

import functools
from typing import NamedTuple

from lexiloom.functions import lexicon
from lexiloom.functions.grammar import RULE, broken, decode, decode_all, evidence, is_marked, lacks_predicate, strains, tags_of
from lexiloom.functions.style import Note, notes
from lexiloom.functions.units import Token, mended, tokenise, units

#: Conventions by bit, the price of an unexplained finding and of a convention given up, and how many registers are tried.
CONVENTIONS = ("predicate", "marks", "apostrophes", "fresh", "plain")
PREDICATE, MARKS, APOSTROPHES, FRESH, PLAIN = (1 << k for k in range(5))
FINDING, GIVEN_UP, TRIED = 100, 150, 8


class Report(NamedTuple):
    tags: list[int]
    faults: list[tuple[int, int, int]]
    unknown: list[int]
    notes: list[Note]

    @property
    def clean(self) -> bool:
        return not (self.faults or self.unknown or self.notes)


class Reading:
    """A unit read once, as a sentence and as a phrase; judged under any register."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.fused = mended(tokens)
        self.allowed = tuple(evidence(self.tokens))
        self.unknown = [k for k, (_, key, _, _, capitalised, mention) in enumerate(self.tokens) if not mention and not lexicon.readings(key, capitalised)]

    @functools.cached_property
    def states(self) -> tuple[tuple[int, ...], tuple[int, ...]]:
        return decode(self.allowed)

    @functools.lru_cache(maxsize=2)  # noqa: B019
    def _shape(self, phrase: bool) -> tuple[list[int], list, list[Note]]:
        states = self.states[phrase]
        tags = tags_of(states)
        return tags, broken(states), notes(self.tokens, tags)

    def under(self, waived: int) -> Report:
        phrase = bool(waived & PREDICATE)
        tags, faults, found = self._shape(phrase)
        faults = list(faults)
        if not waived & APOSTROPHES:
            faults += [(k, k + 1, RULE["Unapostrophed"]) for k in self.fused]
        if not phrase and lacks_predicate(self.states[0]):
            faults.append((0, len(tags), RULE["NoPredicate"]))
        if not waived & MARKS and not is_marked(self.tokens):
            faults.append((0, len(self.tokens), RULE["Unmarked"]))
        return Report(tags, faults, self.unknown, [n for n in found if not waived & (FRESH if n.flaw == "echo" else PLAIN)])

    @functools.cached_property
    def costs(self) -> list[int]:
        """The price of what stays unexplained, under each of the 32 registers."""
        return [FINDING * (len(r.faults) + len(r.unknown) + len(r.notes)) for r in map(self.under, range(32))]


def read_all(some: list[list[Token]]) -> list[Reading]:
    """Many units read side by side."""
    found = [Reading(tokens) for tokens in some]
    for r, states in zip(found, decode_all(r.allowed for r in found), strict=True):
        r.states = states
    return found


def check(tokens: list[Token], waived: int = MARKS) -> Report:
    return Reading(tokens).under(waived)


def integration_cost(tags: list[int]) -> tuple[int, int]:
    """Referents between subjects and verbs: their sum and the most."""
    found = [n for _, _, n in strains(tags)]
    return sum(found), max(found, default=0)


def settled(costs: list[int], adopted: list[int]) -> int:
    return min(adopted, key=lambda r: (costs[r], r.bit_count()))


def adopted(all_costs: list[list[int]]) -> list[int]:
    """The registers a passage keeps to: the set that leaves least unexplained for what it gives up."""
    asked: list[int] = []
    for costs in all_costs:
        wanted = sum(1 << k for k in range(5) if costs[1 << k] < costs[0])
        if wanted and wanted not in asked:
            asked.append(wanted)
    asked = asked[:TRIED]
    best, least = [0], None
    for choice in range(1 << len(asked)):
        tried = [0, *(r for k, r in enumerate(asked) if choice >> k & 1)]
        waived = functools.reduce(int.__or__, tried)
        spent = GIVEN_UP * waived.bit_count() + sum(min(c[r] for r in tried) for c in all_costs)
        if least is None or spent < least:
            best, least = tried, spent
    return best


def read_passage(text: str) -> list[tuple[list[Token], Reading, int]]:
    """Each unit, its reading and the register it settles on."""
    found = [(tokens, Reading(tokens)) for tokens in units(text)]
    kept = adopted([r.costs for _, r in found])
    return [(tokens, r, settled(r.costs, kept)) for tokens, r in found]


def register_of(registers: list[int]) -> int:
    """The commonest register; of equals the one met last for the first time."""
    count = {r: registers.count(r) for r in dict.fromkeys(registers)}
    return max(reversed(count), key=count.__getitem__) if count else 0


def assess(text: str) -> tuple[list[Token], Report, tuple[int, int]]:
    """The whole text as one sentence."""
    tokens = tokenise(text)
    report = check(tokens)
    return tokens, report, integration_cost(report.tags)
