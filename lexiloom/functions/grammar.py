"""The reading of a unit: the cheapest path over (clause frame, tag) states, exact.

A frame is the clause context. Its successors and charges are worked out once per (state, tag) and kept;
costs are whole numbers, a broken rule outweighing any friction a unit can gather. Ties go to the state
that comes first (frames in the order they are reached, then tags).
"""

from __future__ import annotations

import functools
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

from lexiloom.functions import lexicon
from lexiloom.functions.lexicon import KIND, MARKS, NOMINAL, NUMBER, TAG, TAGS, TENSED, VERBS, of_kind
from lexiloom.functions.units import ENDERS, Token

#: Rules by number.
RULES = (
    "DeterminerNumber", "DeterminerTarget", "SubjectVerb", "ModalTakesBase", "ToTakesBase", "PrepositionTarget", "DoubledTense", "StrandedParticiple",
    "PronounIsWhole", "AttributiveSingular", "Subjectless", "NoPredicate", "Unmarked", "Unapostrophed",
)
RULE = {name: k for k, name in enumerate(RULES)}
#: Costs in twentieths: friction a quarter is 5, a reading's rank 1, at most 160; a broken rule outweighs 4,096 tokens of them.
BREACH = 1_000_000
WIDTH = len(TAGS)

EMPTY, NONE, THIRD, FIRST, OTHER, ACTIVITY, EITHER, COMMAND = range(8)
WHOLE, LINKED, OPEN = range(3)
NOTHING, FOR_MODAL, FOR_TO = range(3)


class Frame(NamedTuple):
    subject: int = EMPTY
    tensed: bool = False
    outer: tuple[int, bool] | None = None
    ever: bool = False
    read: bool = False  # whether a subject has been read for the clause
    aside: bool = False  # whether a preposition has opened a modifier
    phrase: int = WHOLE
    wants: int = NOTHING


def answering(f: Frame) -> int:
    """The subject that a verb here would answer to."""
    return f.outer[0] if f.outer and not f.outer[1] and f.tensed else f.subject


_FEATURES = {t: THIRD for t in of_kind("noun.s", "name.s", "pron.3ss", "pron.3so", "pron.3se")} | {TAG["verb.ger"]: ACTIVITY} | {t: FIRST for t in of_kind("pron.1ss", "pron.1so", "pron.1se")}
_FEATURES = {t: OTHER for t in NOMINAL} | _FEATURES
_ENDS_SLOT, _HEADS = VERBS | MARKS | of_kind("modal", "sub"), of_kind("det", "num") | NOMINAL
_LINKS = of_kind("prep", "coord", "sub", "to", "verb.ger", "verb.part")
_MODAL, _TO, _PREP, _ADV, _SUB = (TAG[x] for x in ("modal", "to", "prep", "adv", "sub"))
_COUNTS = frozenset((THIRD, FIRST, OTHER, ACTIVITY, EITHER))


def _phrase(before: int, t: int) -> int:
    if KIND[t] in ("det", "num"):
        return OPEN
    if KIND[t] in ("adj", "adv") or before == OPEN and t == TAG["verb.part"]:
        return before
    if before == OPEN and t == TAG["verb.ger"]:
        return WHOLE
    return LINKED if t in _LINKS else WHOLE


def after(f: Frame, t: int) -> Frame:
    """The frame after a tag: what any tag carries on, then the first case that applies."""
    wants = FOR_MODAL if t == _MODAL else FOR_TO if t == _TO else f.wants if t == _ADV else NOTHING
    go = f._replace(wants=wants, phrase=_phrase(f.phrase, t), aside=t == _PREP or f.aside and t not in _ENDS_SLOT)
    spent = lambda s: COMMAND if s == EMPTY else s
    named = _FEATURES.get(t)
    as_subject = {"subject": NONE if named is None else named, "read": named is not None}
    ready = f.phrase != OPEN
    fresh = not f.tensed and f.read and f.phrase == WHOLE
    if t == _SUB and not f.outer:
        return go._replace(subject=EMPTY, tensed=False, outer=(f.subject, f.tensed), read=False, aside=f.aside)
    if t == TAG["mark.stop"]:
        return go._replace(subject=EMPTY, tensed=False, outer=None, ever=f.ever or f.tensed, read=False, aside=f.aside)
    if t == TAG["mark.pause"]:
        return go._replace(subject=f.outer[0], tensed=f.outer[1], outer=None) if f.outer else go
    if KIND[t] == "coord":
        joins = not f.tensed and not f.aside
        if t == TAG["coord.sum"] and joins and f.subject in _COUNTS:
            return go._replace(subject=EITHER if f.subject in (ACTIVITY, EITHER) else OTHER)
        if t == TAG["coord.choice"] and joins:
            return go._replace(subject=NONE, read=False, aside=f.aside)
        return go._replace(tensed=False, read=False, aside=f.aside)
    if t in TENSED and ready and f.tensed and f.outer and not f.outer[1]:
        return go._replace(subject=spent(answering(f)), tensed=True, ever=True, outer=None, read=True)
    if t in TENSED and ready and not f.tensed or t == _MODAL and ready:
        return go._replace(subject=spent(f.subject), tensed=True, ever=True)
    if fresh and KIND[t] in ("noun", "name"):
        return go._replace(**as_subject)
    if fresh and not f.outer and t in _HEADS:
        return go._replace(**as_subject, outer=(f.subject, f.tensed))
    if f.tensed:
        return go if named is None else go._replace(subject=named, read=True)
    if not f.read or f.subject in (EMPTY, NONE):
        return go._replace(**as_subject)
    return go


@functools.cache
def _walk() -> tuple[list[Frame], dict[Frame, int], list[int]]:
    found, at, moves, k = [Frame()], {Frame(): 0}, [], 0
    while k < len(found):
        for t in range(WIDTH):
            new = after(found[k], t)
            if new not in at:
                at[new] = len(found)
                found.append(new)
            moves.append(at[new])
        k += 1
    return found, at, moves


def frames() -> tuple[list[Frame], dict[Frame, int]]:
    """All frames that can be reached, in the order a breadth-first walk reaches them."""
    return _walk()[:2]


def _disagree(a: int, b: int) -> bool:
    """Whether a nominal and a tensed form beside each other disagree (in the pair alone)."""
    form, one = TAGS[b][5:], NUMBER[a] == "s"
    third = one and (KIND[a] != "pron" or TAGS[a][5] == "3")
    you = KIND[a] == "pron" and TAGS[a][5] == "2"
    good = {"past": True, "third": third, "base": not third, "pasts": one and not you, "pastp": not one or you}
    return not good[form]


@functools.cache
def pair_rule(a: int, b: int) -> int | None:
    """The rule that two tags beside each other break, whatever the clause."""
    ka, kb = KIND[a], KIND[b]
    if ka == "det":
        if kb in ("noun", "name") and NUMBER[a] != NUMBER[b]:
            return RULE["DeterminerNumber"]
        if kb == "verb" and TAGS[b][5:] not in ("ger", "part", "past") or kb in ("modal", "prep", "mark", "to"):
            return RULE["DeterminerTarget"]
    if ka == "prep" and (kb == "modal" or kb == "verb" and b != TAG["verb.ger"]):
        return RULE["PrepositionTarget"]
    if a in NOMINAL and b in TENSED and _disagree(a, b):
        return RULE["SubjectVerb"]
    if a in TENSED and TAGS[b] in ("verb.third", "verb.pasts", "verb.pastp"):
        return RULE["DoubledTense"]
    if kb in ("noun", "name"):
        if ka == "pron":
            return RULE["PronounIsWhole"]
        if TAGS[a] == "noun.p":
            return RULE["AttributiveSingular"]
    return None


@functools.cache
def friction(a: int, b: int) -> int:
    ka, kb = KIND[a], KIND[b]
    free = {"det": ("noun", "adj", "num"), "adj": ("noun",), "adv": ("adj", "verb"), "prep": ("det", "noun", "name")}
    if kb in free.get(ka, ()) or a in NOMINAL and kb == "verb":
        return 0
    return 20 if (ka, kb) == ("name", "noun") else 10 if (ka, kb) == ("noun", "noun") else 5


#: Rules that only the frame judges.
_BY_FRAME = frozenset((RULE["SubjectVerb"], RULE["DoubledTense"]))
_DISAGREE = {THIRD: ("verb.base", "verb.pastp"), ACTIVITY: ("verb.base", "verb.pastp"), FIRST: ("verb.third", "verb.pastp"), OTHER: ("verb.third", "verb.pasts")}
_MEETS = MARKS | of_kind("coord", "sub", "verb.base", "adv")


def held_pair_rule(f: Frame, a: int, b: int) -> int | None:
    rule = pair_rule(a, b)
    return None if rule in _BY_FRAME or rule == RULE["PrepositionTarget"] and f.outer else rule


def frame_rules(f: Frame, t: int) -> list[int]:
    """Rules a tag breaks in a frame, the gravest first."""
    found = []
    if f.wants == NOTHING and TAGS[t] in _DISAGREE.get(answering(f), ()):
        found.append(RULE["SubjectVerb"])
    if f.tensed and f.subject == EMPTY and not f.outer and TAGS[t] in ("verb.third", "verb.past", "verb.pasts", "verb.pastp"):
        found.append(RULE["DoubledTense"])
    if answering(f) == NONE and not f.tensed and (t == _MODAL or t in TENSED):
        found.append(RULE["Subjectless"])
    if t == TAG["verb.part"] and f.subject == EMPTY and not f.tensed and f.wants == NOTHING:
        found.append(RULE["StrandedParticiple"])
    if f.wants != NOTHING and t not in _MEETS:
        found.append(RULE["ModalTakesBase"] if f.wants == FOR_MODAL else RULE["ToTakesBase"])
    return found


_steps: dict[int, tuple[int, int]] = {}


def _step(state: int, t: int) -> tuple[int, int]:
    """Cost of a tag after a state, and the state it leads to."""
    every, at = frames()
    f, a = every[state // WIDTH], state % WIDTH
    rules = set(frame_rules(f, t))
    if (rule := held_pair_rule(f, a, t)) is not None:
        rules.add(rule)
    rub = friction(a, t) if pair_rule(a, t) is None else 0
    return len(rules) * BREACH + rub, at[after(f, t)] * WIDTH + t


@functools.cache
def _ending(frame: int, phrasal: bool) -> int:
    """What it costs to end in a frame."""
    f = frames()[0][frame]
    rules = set()
    if f.subject == NONE or (f.outer is not None if phrasal else not (f.tensed or f.ever)) or f.outer and not f.outer[1]:
        rules.add("NoPredicate")
    if f.wants != NOTHING:
        rules.add(f.wants)
    return len(rules) * BREACH


_NAME, _PASTP, _PAST = TAG["name.s"], TAG["verb.pastp"], TAG["verb.past"]


def evidence(tokens: list[Token]) -> list[tuple[int, ...]]:
    """Readings of each token in its place, likeliest first; none for an unknown word."""
    found, subordinate, readings = [], False, lexicon.readings
    for k, (_, key, _, _, capitalised, mention) in enumerate(tokens):
        own = (_NAME,) if mention else readings(key, capitalised and k > 0)
        if subordinate and _PASTP in own:
            own = (*own, _PAST)
        if key == "to" and k and tokens[k - 1].key in lexicon.TAKES_INFINITIVE:
            own = (_TO,)
        subordinate = subordinate or _SUB in readings(key, capitalised)
        found.append(own)
    return found


_EVERY = tuple((t, 0) for t in range(WIDTH))


@functools.lru_cache(maxsize=20_000)
def _ranked(allowed: tuple[int, ...]) -> tuple[tuple[int, int], ...]:
    if not allowed:
        return _EVERY
    first: dict[int, int] = {}
    for k, t in enumerate(allowed):
        first.setdefault(t, min(k, 160))
    return tuple(sorted(first.items()))


@functools.lru_cache(maxsize=50_000)
def decode(allowed: tuple[tuple[int, ...], ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """States of the best reading as a sentence, and as a phrase; both share all but the end."""
    if not allowed:
        return (), ()
    at = frames()[1]
    opening = {at[after(Frame(), t)] * WIDTH + t: r for t, r in _ranked(allowed[0])}
    costs, backs = dict(sorted(opening.items())), []
    for own in allowed[1:]:
        new: dict[int, int] = {}
        back: dict[int, int] = {}
        ranked = _ranked(own)
        for state, cost in costs.items():
            for t, rank in ranked:
                key = state * WIDTH + t
                found = _steps.get(key)
                if found is None:
                    found = _steps[key] = _step(state, t)
                total, to = cost + found[0] + rank, found[1]
                if to not in new or total < new[to]:
                    new[to] = total
                    back[to] = state
        costs = dict(sorted(new.items()))
        backs.append(back)
    paths = []
    for phrasal in (False, True):
        state = min(costs, key=lambda s: costs[s] + _ending(s // WIDTH, phrasal))
        path = [state]
        for back in reversed(backs):
            path.append(back[path[-1]])
        paths.append(tuple(path[::-1]))
    return paths[0], paths[1]


#: Units read at once; a step of more tries than WIDE for one unit is kept, up to KEPT_BYTES, as runs of unknown words repeat it.
UNITS, WIDE, KEPT_BYTES = 64, 4_000, 32_000_000
_BITS, _FAR = 14, np.iinfo(np.int64).max


class _Tables:
    """Costs and moves of every state that can be reached, by its place among them."""

    def __init__(self):
        every, _, moves = _walk()
        moves = np.array(moves, np.int64).reshape(-1, WIDTH)
        kinds: dict[tuple, list[int]] = {}
        rules = np.array([kinds.get(k) or kinds.setdefault(k, [len(frame_rules(f, t)) for t in range(WIDTH)]) for f in every for k in [(f.subject, f.tensed, f.outer, f.wants)]])
        inside = np.array([f.outer is not None for f in every]).astype(int)
        held = np.array([[[held_pair_rule(f, a, t) is not None for t in range(WIDTH)] for a in range(WIDTH)] for f in (Frame(), Frame(outer=(EMPTY, False)))])
        rub = np.array([[friction(a, t) if pair_rule(a, t) is None else 0 for t in range(WIDTH)] for a in range(WIDTH)])
        self.states = np.unique(moves * WIDTH + np.arange(WIDTH))
        place = np.full(len(every) * WIDTH, -1)
        place[self.states] = np.arange(len(self.states))
        frame, tag = self.states // WIDTH, self.states % WIDTH
        self.size = len(self.states)
        assert self.size <= 1 << _BITS
        self.to = place[moves[frame] * WIDTH + np.arange(WIDTH)].ravel()
        # A frame's rules and a pair's are never the same ones, so they add up.
        self.cost = ((rules[frame] + held[inside[frame], tag]) * BREACH + rub[tag]).ravel()
        self.opening = place[moves[0] * WIDTH + np.arange(WIDTH)]
        self.ending = [np.array([_ending(f, phrasal) for f in range(len(every))])[frame] for phrasal in (False, True)]
        self.best = np.full(UNITS * self.size, _FAR)
        self.kept: dict[tuple, tuple] = {}
        self.kept_bytes = 0

    def advance(self, unit, state, cost, own, ways):
        """The rows of units (by unit, then state) after one more token each, and the row each came from."""
        tags, ranks, start, count = ways
        reps = count[own]
        row = np.repeat(np.arange(len(state)), reps)
        way = np.arange(len(row)) + np.repeat(start[own] - np.cumsum(reps) + reps, reps)
        before = state[row]
        at = before * WIDTH + tags[way]
        total = cost[row] + self.cost[at] + ranks[way]
        key = unit[row] * self.size + self.to[at]
        packed = (total << _BITS) | before  # of equal costs the state that comes first
        np.minimum.at(self.best, key, packed)
        won = np.flatnonzero(self.best[key] == packed)
        self.best[key] = _FAR
        won = won[np.argsort(key[won])]
        to = key[won]
        return to // self.size, to % self.size, total[won], row[won]

    def widely(self, state, cost, allowed, ways):
        """advance of one unit with many states: the same costs, but for a constant, are worked out once."""
        least = cost.min()
        asked = (state.tobytes(), (cost - least).tobytes(), allowed)
        found = self.kept.get(asked)
        if found is None:
            zero = np.zeros(len(state), np.int64)
            _, to, total, row = self.advance(zero, state, cost - least, zero, ways)
            found = to, total, to.astype(np.int16), row.astype(np.int16)
            self.kept_bytes += sum(x.nbytes for x in found) + len(asked[0]) + len(asked[1])
            if self.kept_bytes > KEPT_BYTES:
                self.kept.clear()
                self.kept_bytes = 0
            self.kept[asked] = found
        to, total, slim, row = found
        return to, total + least, slim, row


@functools.cache
def _tables() -> _Tables:
    return _Tables()


def _ways(classes: Iterable[tuple[int, ...]]) -> tuple[np.ndarray, ...]:
    """tags and ranks of each class of readings, one after the other, where each starts and how many it has."""
    ranked = [_ranked(own) for own in classes]
    tags, ranks = (np.array([x[k] for some in ranked for x in some], np.int64) for k in (0, 1))
    count = np.array([len(some) for some in ranked], np.int64)
    return tags, ranks, np.cumsum(count) - count, count


def _together(some: list[tuple[tuple[int, ...], ...]]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """decode of UNITS units at most, none of them empty and the longest first."""
    table = _tables()
    classes = {own: k for k, own in enumerate(dict.fromkeys(own for allowed in some for own in allowed))}
    ways, alone = _ways(classes), {own: _ways([own]) for own in classes}
    count = ways[3]
    lengths = np.array([len(x) for x in some])
    seen = np.zeros((len(some), lengths[0]), np.int64)
    for u, allowed in enumerate(some):
        seen[u, : len(allowed)] = [classes[own] for own in allowed]
    # Per unit and step: its states and, of each, the place among those of the step before.
    trails: list[list[tuple[np.ndarray, np.ndarray | None]]] = [[] for _ in some]
    paths: list[tuple] = [()] * len(some)
    parts = []
    for allowed in some:
        told = sorted((int(table.opening[t]), r) for t, r in _ranked(allowed[0]))
        parts.append((np.array([s for s, _ in told], np.int64), np.array([r for _, r in told], np.int64)))
    for u, (state, _) in enumerate(parts):
        trails[u].append((state, None))
    for k in range(1, lengths[0] + 1):
        live = int(np.searchsorted(-lengths, -k, "left"))
        for u in range(live, len(parts)):
            paths[u] = _traced(table, trails[u], *parts[u])
            trails[u] = []
        del parts[live:]
        if not live:
            break
        own = seen[:live, k]
        wide = {u for u in np.flatnonzero(np.array([len(s) for s, _ in parts]) * count[own] > WIDE).tolist()}
        narrow = [u for u in range(live) if u not in wide]
        for u in wide:
            state, total, slim, row = table.widely(*parts[u], some[u][k], alone[some[u][k]])
            parts[u] = state, total
            trails[u].append((slim, row))
        if narrow:
            sizes = np.array([len(parts[u][0]) for u in narrow])
            local = np.repeat(np.arange(len(narrow)), sizes)
            unit, state, total, row = table.advance(local, np.concatenate([parts[u][0] for u in narrow]), np.concatenate([parts[u][1] for u in narrow]), own[narrow][local], ways)
            row = (row - (np.cumsum(sizes) - sizes)[unit]).astype(np.int16)
            slim = state.astype(np.int16)
            bounds = np.searchsorted(unit, np.arange(len(narrow) + 1)).tolist()
            for u, a, b in zip(narrow, bounds, bounds[1:], strict=False):
                parts[u] = state[a:b], total[a:b]
                trails[u].append((slim[a:b], row[a:b]))
    return paths


def _traced(table: _Tables, trail: list, state: np.ndarray, cost: np.ndarray) -> tuple[tuple[int, ...], tuple[int, ...]]:
    paths: list[tuple[int, ...]] = []
    ends = [int((cost + table.ending[phrasal][state]).argmin()) for phrasal in (0, 1)]
    for end in dict.fromkeys(ends):
        at, path = end, []
        for states, row in reversed(trail):
            path.append(int(states[at]))
            if row is not None:
                at = row[at]
        paths.append(tuple(table.states[path[::-1]].tolist()))
    return paths[0], paths[-1]


def decode_all(every: Iterable[tuple[tuple[int, ...], ...]]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """decode of many units, read side by side; equal ones are read once."""
    every = list(every)
    told = sorted((x for x in dict.fromkeys(every) if x), key=len, reverse=True)
    found: dict[tuple, tuple] = {(): ((), ())}
    for k in range(0, len(told), UNITS):
        some = told[k : k + UNITS]
        found.update(zip(some, _together(some), strict=True))
    return [found[x] for x in every]


def tags_of(states: tuple[int, ...]) -> list[int]:
    return [s % WIDTH for s in states]


@functools.lru_cache(maxsize=200_000)
def _breaks(state: int, tag: int) -> tuple[int | None, int | None]:
    """The pair's rule and the frame's gravest one that a tag breaks after a state."""
    f = frames()[0][state // WIDTH]
    return held_pair_rule(f, state % WIDTH, tag), next(iter(frame_rules(f, tag)), None)


def broken(states: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(start, end, rule) of what a reading breaks between neighbours: pair rules first, then frames'."""
    pairs = [_breaks(a, b % WIDTH) for a, b in zip(states, states[1:], strict=False)]
    return [(k, k + 2, x[i]) for i in (0, 1) for k, x in enumerate(pairs) if x[i] is not None]


def is_imperative(tags: list[int]) -> bool:
    rest = next((t for t in tags if t != _ADV), None)
    return rest == TAG["verb.base"] and len(tags) > 1


def lacks_predicate(states: tuple[int, ...]) -> bool:
    if not states or is_imperative(tags_of(states)):
        return False
    f = frames()[0][states[-1] // WIDTH]
    return not (f.tensed or f.ever or f.outer)


def is_marked(tokens: list[Token]) -> bool:
    return bool(tokens) and tokens[0].capitalised and tokens[-1].word in ENDERS


def clauses(tags: list[int]) -> list[tuple[int, int]]:
    """(subject head, tensed word) of each clause."""
    found, head, modifying, settled = [], None, False, False
    for k, t in enumerate(tags):
        if t in (_PREP, _SUB):
            modifying, settled = head is not None, False
        elif (t in TENSED or t == _MODAL) and not settled:
            if head is not None:
                found.append((head, k))
                head, settled = None, True
            modifying = False
        elif KIND[t] in ("mark", "coord"):
            head, modifying, settled = None, False, False
        elif t in NOMINAL and not modifying and not settled:
            head = k
    return found


_REFERENTS = of_kind("noun", "name") | TENSED


def strains(tags: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, referents between) of clauses whose subject and verb stand apart."""
    found = [(a, b + 1, sum(t in _REFERENTS for t in tags[a + 1 : b])) for a, b in clauses(tags)]
    return [x for x in found if x[2]]
