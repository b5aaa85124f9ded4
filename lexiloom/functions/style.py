"""Wasteful wording: phrases, fillers, delayed openings and echoes, with what says the same."""

from __future__ import annotations

import functools
from typing import NamedTuple

from lexiloom.functions import words
from lexiloom.functions.lexicon import FILLERS, of_kind
from lexiloom.functions.units import Token


class Note(NamedTuple):
    start: int
    end: int
    flaw: str
    instead: str | None  # None: nothing says it shorter; "": leave it out


PHRASES: dict[tuple[str, ...], tuple[str | None, str]] = {}
for _line in words.PHRASES.strip().split("\n"):
    _words, _instead, _flaw = (x.strip() for x in _line.split("|"))
    PHRASES[tuple(_words.split())] = (None if _instead == "-" else _instead, _flaw)
LENGTHS = sorted({len(x) for x in PHRASES})
_STARTS = {x[0] for x in PHRASES}
_QUALIFIED, _CONTENT = of_kind("verb", "adj", "adv", "modal"), of_kind("noun", "verb", "adj", "adv")
LOOK_BACK = 8


@functools.lru_cache(maxsize=100_000)
def stem(word: str, least: int = 3) -> str:
    for end in ("ing", "ed", "es", "s"):
        if word.endswith(end) and len(word.encode()) - len(end) >= least:
            return word[: -len(end)]
    return word


_BE = frozenset(("is", "are", "was", "were"))


def delayed(keys: list[str]) -> list[Note]:
    if _BE.isdisjoint(keys):
        return []
    late = {k for k, x in enumerate(keys) if x in ("that", "to")}
    last = max(late, default=-1)
    found = []
    for k, (a, b) in enumerate(zip(keys, keys[1:], strict=False)):
        if b in _BE and (a == "there" or a == "it" and last >= k + 2):
            found.append(Note(k, k + 2, "delayed", None))
    return found


def notes(tokens: list[Token], tags: list[int]) -> list[Note]:
    keys = ["" if t.mention else t.key for t in tokens]
    found, at = [], 0
    while at < len(keys):
        hit = None
        if keys[at] in _STARTS:
            hit = next((n for n in LENGTHS if tuple(keys[at : at + n]) in PHRASES), None)
        if hit:
            instead, flaw = PHRASES[tuple(keys[at : at + hit])]
            found.append(Note(at, at + hit, flaw, instead))
            at += hit
            continue
        if keys[at] in FILLERS and at + 1 < len(tags) and tags[at + 1] in _QUALIFIED:
            found.append(Note(at, at + 1, "filler", ""))
        at += 1
    echoes, last = [], {}  # last: where each stem of a content word stood last
    for k, (key, tag) in enumerate(zip(keys, tags, strict=False)):
        if tag in _CONTENT:
            own = stem(key)
            if k - last.get(own, -LOOK_BACK - 1) <= LOOK_BACK:
                echoes.append(Note(k, k + 1, "echo", None))
            if len(key.encode()) >= 3:
                last[own] = k
    phrases = list(found)
    fresh = lambda n: not any(p.start < n.end and n.start < p.end for p in phrases)
    return sorted([*found, *filter(fresh, delayed(keys)), *filter(fresh, echoes)], key=lambda n: n.start)
