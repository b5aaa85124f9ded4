"""Repairs by inflection, passages cut to their point, and plain rewrites of wasteful wording."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from lexiloom.functions import lexicon, words
from lexiloom.functions.grammar import RULE, strains
from lexiloom.functions.judge import MARKS, Report, check, read_passage
from lexiloom.functions.lexicon import KIND, NOMINAL, TAG, TENSED, of_kind
from lexiloom.functions.style import notes, stem
from lexiloom.functions.units import ENDERS, Token, retyped, units

VOWELS = "aeiou"

# Morphology -----------------------------------------------------------------------------------------


def marked(word: str) -> str | None:
    """The word with the ending of a plural, or of a third person."""
    if not word:
        return None
    if word.endswith(("s", "x", "z", "ch", "sh")):
        return word + "es"
    hard = len(word) > 1 and word[-2] not in VOWELS
    if word[-1] == "y" and hard:
        return word[:-1] + "ies"
    return word + ("es" if word[-1] == "o" and hard else "s")


def unmarked(word: str) -> str | None:
    """The stem whose marked spelling is the word."""
    tried = [word[: -len(end)] + tail for end, tail in (("ies", "y"), ("es", ""), ("s", "")) if word.endswith(end)]
    return next((s for s in tried if marked(s) == word), None)


def third(word: str) -> str | None:
    return marked(word.lower())


def is_plural(word: str) -> bool:
    low = word.lower()
    return unmarked(low) is not None and not lexicon.offers(low, TAG["noun.s"])


def bare(word: str) -> str | None:
    """A past form's stem, unless it ends in a doubled consonant."""
    s = word.removesuffix("ed")
    if s == word or not s or len(s) > 1 and s[-1] == s[-2] and s[-1] not in VOWELS:
        return None
    return s


def pluralised(phrase: str) -> str:
    front, space, head = phrase.rpartition(" ")
    low = head.lower()
    return front + space + (head if low in lexicon.INVARIANT else marked(head) or head + "s")


_PARTNERS: list[tuple[str, str]] = [tuple(x.split(":")) for x in words.PAIRS.split()]


def forms(word: str, wants_base: bool = False) -> list[str]:
    """Other inflections of a word that the lexicon can place, likeliest first."""
    low = word.lower()
    if not low.isalpha():
        return []
    found = [b if a == low else a for a, b in _PARTNERS if low in (a, b)]
    if not lexicon.is_closed(low):
        single = unmarked(low)
        if single is not None:
            found += [] if lexicon.offers(low, TAG["noun.s"]) else [single]
        elif lexicon.offers(low, TAG["noun.p"]) or not lexicon.offers(low, TAG["adv"]):
            found += [] if low.endswith(("ed", "ing")) else [marked(low)]
        if wants_base and (base := bare(low)):
            found.append(base)
    good = lexicon.places if lexicon.places(low) else lexicon.knows
    return [w for w, _ in itertools.groupby(w for w in found if w and w != low and good(w))]


# Repair ---------------------------------------------------------------------------------------------


class Edit(NamedTuple):
    at: int
    word: str


_INFLECTED = of_kind("noun", "verb", "det", "pron")


def applied(tokens: list[Token], edits: list[Edit]) -> list[Token]:
    found = list(tokens)
    for e in edits:
        if e.at < len(found):
            found[e.at] = retyped(found[e.at], e.word)
    return found


def _tried(tokens: list[Token], report: Report) -> Iterator[list[Edit]]:
    """One swap at a time from the last site back, then two at a time."""
    sites = sorted({x for a, b, _ in report.faults for x in (a, max(b - 1, 0))}, reverse=True)
    sites = [k for k in sites if k < len(tokens) and (k >= len(report.tags) or report.tags[k] in _INFLECTED)]
    plain = {RULE["ModalTakesBase"], RULE["ToTakesBase"]}
    stripped = {k for k in sites if any(r in plain and a <= k < b for a, b, r in report.faults) and k < len(report.tags) and report.tags[k] in (TAG["verb.past"], TAG["verb.part"])}
    offered = {k: [Edit(k, w) for w in forms(tokens[k].word, k in stripped)] for k in sites}
    for k in sites:
        yield from ([e] for e in offered[k])
    for a, b in itertools.combinations(sites, 2):
        yield from map(list, itertools.product(offered[a], offered[b]))


def repair(tokens: list[Token], waived: int = 0) -> list[Edit] | None:
    """The fewest swaps that leave the unit clean; None if it has no fault, an unknown word, or no repair."""
    waived |= MARKS
    report = check(tokens, waived)
    if not report.faults or report.unknown:
        return None
    return next((e for e in _tried(tokens, report) if check(applied(tokens, e), waived).clean), None)


# Condense -------------------------------------------------------------------------------------------

#: Terms of a passage at most, and prices of a token, a referent in between, a flaw and a byte past a plain word's.
TERMS, TOKEN, STRAIN, FLAW, LATINATE, PLAIN = 12, 0.125, 0.05, 0.5, 0.15, 6
_ABSTRACT = tuple(words.ABSTRACT.split())
_VERBAL = TENSED | of_kind("modal")
_FRAMES = of_kind("sub", "coord", "prep", "to", "mark", "verb", "modal", "adv")
_OPENERS = of_kind("adv", "sub", "coord", "prep", "to")
_BREAKS = of_kind("mark", "sub", "coord")


def bears_content(token: Token) -> bool:
    return len(token.key.encode()) >= 3 and token.key.isalpha() and not lexicon.is_closed(token.key) and token.key not in lexicon.FILLERS


def is_abstract(word: str) -> bool:
    return any(word.endswith(e) and len(word.encode()) > len(e) + 2 for e in _ABSTRACT)


def terms(found: list[list[Token]]) -> list[str]:
    """Stems of content words that a passage comes back to; without any, its short concrete words."""
    weight: dict[str, float] = {}
    for t in itertools.chain.from_iterable(found):
        if bears_content(t):
            s = stem(t.key)
            weight[s] = weight.get(s, 0.0) + 1.0
    weight = {w: n * 0.25 if is_abstract(w) else n for w, n in weight.items()}
    kept = {w: n for w, n in weight.items() if n >= 2} or {w: n for w, n in weight.items() if len(w.encode()) <= PLAIN and not is_abstract(w)}
    return sorted(kept, key=lambda w: (-kept[w], w))[:TERMS]


def _carried(tokens: list[Token], place: dict[str, int]) -> int:
    held = 0
    for t in tokens:
        held |= 1 << place[s] if (s := stem(t.key)) in place else 0
    return held


def _stands(tokens: list[Token], tags: list[int], moved: bool) -> bool:
    if len(tokens) < 3 or moved and tags and tags[0] in _FRAMES:
        return False
    return any(t in NOMINAL for t in tags) and any(t in _VERBAL for t in tags)


def _severable(tags: list[int]) -> bool:
    stop = max((k for k, t in enumerate(tags) if t == TAG["mark.stop"]), default=len(tags))
    body = tags[:stop]
    return any(t in NOMINAL for t in body) and any(t in _VERBAL for t in body)


def paired(text: str) -> bool:
    close, open_ = {"]": "[", ")": "(", "}": "{"}, []
    for c in text:
        if c in close.values():
            open_.append(c)
        elif c in close and (not open_ or open_.pop() != close[c]):
            return False
    return not open_ and text.count("`") % 2 == 0


def trimmed(tokens: list[Token], tags: list[int], place: dict[str, int], carries: int, source: str) -> str:
    """A unit without framing clauses that carry no term: a slice of the source, as it was written."""
    start, stop = 0, len(tokens)
    for k in range(len(tokens) - 1):
        if k < len(tags) and KIND[tags[k]] == "mark" and tokens[k].word not in ENDERS and _carried(tokens[k + 1 :], place) == carries and _stands(tokens[k + 1 :], tags[k + 1 :], True):
            start = k + 1
    for k in range(len(tokens) - 1, start, -1):
        if k >= len(tags) or tags[k] not in _BREAKS:
            continue
        while k > start and tags[k - 1] in _OPENERS:
            k -= 1
        if k > start and _carried(tokens[start:k], place) == carries and _stands(tokens[start:k], tags[start:k], start > 0) and _severable(tags[k:]):
            stop = k
    slice_of = lambda some: source[some[0].start : some[-1].end] if some else ""
    kept = tokens[start:stop]
    worse = len(kept) < len(tokens) and len(check(kept).faults) > len(check(tokens).faults)
    if worse or len(kept) < len(tokens) and not paired(slice_of(kept)):
        kept = tokens
    if len(kept) == len(tokens):
        start = 0
    text = slice_of(kept)
    text = (text[:1].upper() + text[1:] if start else text).rstrip(",;:")
    return text if text.endswith((".", "?", "!")) else text + "."


def chosen(carries: list[int], prices: list[float], width: int) -> list[int]:
    """Sentences of the best walk over sets of terms: a new term is worth 1, a sentence costs its price."""
    masks = np.arange(1 << width)
    best = np.where(masks == 0, 0.0, -np.inf)
    came, by = np.full(len(masks), -1), np.full(len(masks), -1)
    bits = np.bitwise_count(masks).astype(float)
    for k, (own, price) in enumerate(zip(carries, prices, strict=True)):
        live = np.flatnonzero(np.isfinite(best))
        to = live | own
        total = best[live] + (bits[to] - bits[live]) - price
        order = np.lexsort((live, -total, to))
        to, live, total = to[order], live[order], total[order]
        first = np.flatnonzero(np.diff(to, prepend=-1))
        to, live, total = to[first], live[first], total[first]
        up = total > best[to]
        best, came, by = best.copy(), came.copy(), by.copy()
        best[to[up]], came[to[up]], by[to[up]] = total[up], live[up], k
    held = int(best.argmax())
    if by[held] < 0:
        return [min(range(len(carries)), key=lambda k: (-carries[k].bit_count(), prices[k]))] if carries else []
    found = []
    while by[held] >= 0:
        found.append(int(by[held]))
        if came[held] == held:
            break
        held = int(came[held])
    return sorted(found)


class Core(NamedTuple):
    kept: list[str]
    dropped: int
    about: list[str]

    @property
    def text(self) -> str:
        return " ".join(self.kept)


def condense(passage: str) -> Core:
    found = units(passage)
    about = terms(found)
    place = {w: k for k, w in enumerate(about)}
    texts, prices, carries = [], [], []
    for tokens in found:
        report = check(tokens)
        flaws = sum(n.flaw != "echo" for n in notes(tokens, report.tags)) + len(report.faults)
        strain = sum(n for _, _, n in strains(report.tags))
        latinate = sum(max(0, len(t.key.encode()) - PLAIN) for t in tokens if bears_content(t))
        own = _carried(tokens, place)
        carries.append(own)
        prices.append(len(tokens) * TOKEN + strain * STRAIN + flaws * FLAW + latinate * LATINATE)
        texts.append(trimmed(tokens, report.tags, place, own, passage))
    picked = chosen(carries, prices, len(about))
    return Core([texts[k] for k in picked], len(found) - len(picked), about)


# Rewriting ------------------------------------------------------------------------------------------


class Swap(NamedTuple):
    start: int
    was: str
    now: str


class Lines:
    """Prose lines joined by single spaces, with the way back to where they stood."""

    def __init__(self, blocks: list[list[tuple[int, str]]]):
        self.lines = list(itertools.chain.from_iterable(blocks))
        self.text = " ".join(line for _, line in self.lines)

    def source(self, at: int) -> int | None:
        for begin, line in self.lines:
            if at < len(line):
                return begin + at
            at -= len(line) + 1
            if at < 0:
                return None
        return None

    def whole(self, start: int, end: int) -> int | None:
        """Where a stretch stands in the source, if it stands there in one piece."""
        a, b = self.source(start), self.source(end - 1)
        return a if a is not None and b is not None and b + 1 - a == end - start else None


def repairs_of(blocks: list[list[tuple[int, str]]]) -> list[Swap]:
    """Swaps that repair the units of a file's prose, each under its own register."""
    lines, found = Lines(blocks), []
    for tokens, _, register in read_passage(lines.text):
        for e in repair(tokens, register) or []:
            now = retyped(tokens[e.at], e.word).word
            at = lines.source(tokens[e.at].start)
            if now != tokens[e.at].word and at is not None:
                found.append(Swap(at, tokens[e.at].word, now))
    return sorted(found, key=lambda s: s.start)


def _findings(text: str, register: int) -> int:
    total = 0
    for tokens in units(text):
        report = check(tokens, register)
        total += len(report.faults) + len(notes(tokens, report.tags))
    return total


def _sound(prose: str, first: int, start: int, end: int, now: str, register: int) -> bool:
    stop = next((k + 1 for k in range(first, len(prose)) if prose[k] in ENDERS), len(prose))
    if end > stop or start < first:
        return False
    return _findings(prose[first:start] + now + prose[end:stop], register) <= _findings(prose[first:stop], register)


def plain_of(blocks: list[list[tuple[int, str]]]) -> list[Swap]:
    """Swaps that say wasteful wording shorter, where that leaves no more faults or notes than before."""
    lines, found = Lines(blocks), {}
    prose = lines.text
    capital = lambda w: w[:1].upper() + w[1:]
    for tokens, _, register in read_passage(prose):
        for note in notes(tokens, check(tokens, register).tags):
            if note.instead is None or note.end > len(tokens):
                continue
            first, last = tokens[note.start], tokens[note.end - 1]
            if (at := lines.whole(first.start, last.end)) is None:
                continue
            end, now = last.end, note.instead
            if not now:  # left out: the next word takes its place
                after = next((t for t in tokens if t.start >= last.end + 1), None)
                if after is None or after.start != last.end + 1 or lines.whole(first.start, after.end) is None:
                    continue
                end, now = after.end, after.word
            now = capital(now) if first.capitalised else now
            if at not in found and _sound(prose, tokens[0].start, first.start, end, now, register):
                found[at] = Swap(at, prose[first.start : end], now)
    return sorted(found.values(), key=lambda s: s.start)


def rewritten(source: str, swaps: list[Swap]) -> str:
    """The source with each swap whose text still stands there, from the last back."""
    for s in reversed(swaps):
        if source[s.start : s.start + len(s.was)] == s.was:
            source = source[: s.start] + s.now + source[s.start + len(s.was) :]
    return source
