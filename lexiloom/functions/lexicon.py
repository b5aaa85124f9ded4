"""Readings of words: listed ones by class, and what an ending reveals.

Tags are small numbers; ``TAGS`` names them in their fixed order, which also settles ties of the decoder.
"""

from __future__ import annotations

import functools

from lexiloom.functions import words

FORMS = ("base", "third", "past", "pasts", "pastp", "part", "ger")
_pairs = lambda text: [tuple(x.split(":")) for x in text.split()]
_PRONOUNS = _pairs(words.PRONOUNS)
TAGS = (
    *("modal", "prep", "adj", "adv", "coord.sum", "coord.choice", "sub", "to", "num", "mark.pause", "mark.stop"),
    *(f"{kind}.{n}" for n in "sp" for kind in ("det", "noun", "name")),
    *dict.fromkeys(f"pron.{x}" for _, x in _PRONOUNS),
    *(f"verb.{x}" for x in FORMS),
)
TAG = {name: k for k, name in enumerate(TAGS)}
KIND = tuple(x.split(".")[0] for x in TAGS)


def of_kind(*kinds: str) -> frozenset[int]:
    return frozenset(k for k, x in enumerate(TAGS) if x in kinds or KIND[k] in kinds)


NOMINAL = of_kind("noun", "name", "pron")
TENSED = of_kind("verb.base", "verb.third", "verb.past", "verb.pasts", "verb.pastp")
VERBS, MARKS = of_kind("verb"), of_kind("mark")
#: s or p, for the tags that have a number.
NUMBER = tuple(x[-1] if KIND[k] in ("det", "noun", "name") else x[6] if KIND[k] == "pron" else "" for k, x in enumerate(TAGS))


def _listing() -> dict[str, tuple[int, ...]]:
    found: dict[str, list[int]] = {}

    def add(word: str, *tags: str) -> None:
        found.setdefault(word, []).extend(TAG[t] for t in tags)

    for word, numbers in _pairs(words.DETERMINERS):
        add(word, *(f"det.{n}" for n in numbers))
    for word, what in _PRONOUNS:
        add(word, f"pron.{what}")
    for word, forms in _pairs(words.IRREGULAR_VERBS):
        add(word, *(f"verb.{f}" for f in forms.split("+")))
    for word, number in _pairs(words.IRREGULAR_NOUNS):
        add(word, f"noun.{number}")
    for text, tags in (
        (words.SINGULAR_S_NOUNS, ("noun.s",)), (words.INVARIANT_NOUNS, ("noun.s", "noun.p")), (words.MODALS, ("modal",)), (words.PREPOSITIONS, ("prep",)),
    ):
        for word in text.split():
            add(word, *tags)
    for word, join in _pairs(words.COORDINATORS):
        add(word, f"coord.{join}")
    for text, tag in ((words.SUBORDINATORS, "sub"), (words.BARE_ADVERBS, "adv"), (words.BARE_ADJECTIVES, "adj")):
        for word in dict.fromkeys(text.split()):
            add(word, tag)
    add("to", "to", "prep")
    return {k: tuple(v) for k, v in found.items()}


LISTED = _listing()
MODALS, INVARIANT = frozenset(words.MODALS.split()), frozenset(words.INVARIANT_NOUNS.split())
AUXILIARIES = frozenset(words.AUXILIARIES.split()) | MODALS
PRONOUN_WORDS = frozenset(w for w, _ in _PRONOUNS) | {"there", "here", "who"}
TAKES_INFINITIVE = frozenset(words.TAKES_INFINITIVE.split())
FILLERS = frozenset(words.FILLERS.split())
_CLOSED = of_kind("det", "pron", "prep", "coord", "sub", "modal", "to", "mark")
#: Endings that settle a class: (endings, shortest stem in bytes, tags). What follows them in ``by_ending`` has exceptions.
_ENDINGS = (
    (("ing",), 3, ("verb.ger",)), (("ed",), 2, ("verb.past", "verb.part")), (("ly",), 3, ("adv",)), (("ness", "tion", "ment", "ity"), 0, ("noun.s",)),
    (("ous", "ful", "ive", "able", "ic", "less"), 0, ("adj",)), (("er", "est"), 3, ("adj",)), (("wise",), 3, ("adv",)),
)


def listed(key: str) -> tuple[int, ...] | None:
    if key and all(c in "0123456789-" for c in key) and any(c != "-" for c in key):
        return (TAG["num"],)
    if not any(c.isalnum() for c in key):
        return (TAG["mark.stop"] if any(c in ".!?;:" for c in key) else TAG["mark.pause"],)
    return LISTED.get(key)


def by_ending(key: str, capitalised: bool = False) -> tuple[int, ...]:
    """Readings that an ending allows, likeliest first."""
    if not any(c in "aeiouy" for c in key):
        return ()
    size = lambda s: len(s.encode())
    found = ["name.s"] if capitalised else []
    for endings, least, tags in _ENDINGS:
        end = next((e for e in endings if key.endswith(e)), None)
        if end is not None and size(key) - len(end) >= least:
            found += tags
    loose = key.endswith("ed") and size(key) >= 4 and key[:-2].endswith("e")
    stem = key[:-1]
    if key.endswith("s") and size(stem) >= 2 and not stem.endswith("s"):
        found += ["noun.p", "verb.third"] + (["noun.s"] if stem[-1] in "ui" else [])
    if capitalised:
        found = [x for x in found if not x.startswith("noun")]
    placed = any(x.startswith("verb") or x == "noun.p" for x in found) and not loose
    if size(key) >= 2 and not placed:
        found += ["noun.s", "verb.base"]
    return tuple(TAG[x] for x in dict.fromkeys(found))


@functools.lru_cache(maxsize=100_000)
def readings(key: str, capitalised: bool = False) -> tuple[int, ...]:
    """All readings of a word, likeliest first; none if it can't be placed."""
    found = listed(key)
    return found if found is not None else by_ending(key, capitalised)


def places(key: str) -> bool:
    return listed(key) is not None


def knows(key: str) -> bool:
    return bool(readings(key))


def offers(key: str, tag: int) -> bool:
    return tag in (listed(key) or ()) or tag in by_ending(key)


def likeliest(key: str) -> int | None:
    return next(iter(readings(key)), None)


def carries_verb(key: str) -> bool:
    return any(t in VERBS for t in listed(key) or ())


def is_closed(key: str) -> bool:
    found = listed(key)
    return bool(found) and (key in AUXILIARIES or all(t in _CLOSED for t in found))
