"""Words and marks of English prose, and the units (sentences, or lines without a mark) they form.

Offsets are code points of the whole text, end exclusive.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

from lexiloom.functions import lexicon

#: Marks of a medium, not of a sentence: they give no token.
FORMATTING = "*\\#~|"
QUOTES = frozenset('"`“”')
#: Endings that are words, and how each is spelt without its apostrophe.
CLITICS = {"n't": "nt", "'s": "s", "'re": "re", "'ve": "ve", "'ll": "ll", "'d": "d", "'m": "m"}
RUN = re.compile(r"\S+")
PIECE = re.compile(r"(?:[^\W_]|['-])+|.", re.DOTALL)
TAIL = ".,;:!?)"
NAME = re.compile(r"[/_]|::|\.[^\W_]")
ENDERS = frozenset(".!?")


class Token(NamedTuple):
    word: str
    key: str
    start: int
    end: int
    capitalised: bool
    mention: bool


def _plain(text: str, start: int, end: int) -> Token:
    word = text[start:end]
    return Token(word, word.lower(), start, end, word[0].isupper(), False)


def _split(text: str, start: int, end: int) -> list[Token]:
    """A word and the clitics on its right."""
    tail: list[Token] = []
    while True:
        low = text[start:end].lower()
        clitic = next((c for c in CLITICS if low.endswith(c) and len(low) > len(c)), None)
        if clitic is None:
            return [_plain(text, start, end), *reversed(tail)]
        tail.append(_plain(text, end - len(clitic), end))
        end -= len(clitic)


def _folded(tokens: list[Token], text: str) -> list[Token]:
    """A term between quotation marks or backticks is one token; a mark that is never closed is dropped."""
    found: list[Token] = []
    held: tuple[int, int] | None = None
    for token in tokens:
        if token.word.lstrip("\\") not in QUOTES:
            found.append(token)
        elif held is None:
            held = len(found), token.start
        else:
            inner = " ".join(x.word for x in found[held[0] :])
            found[held[0] :] = [Token(text[held[1] : token.end], inner.lower(), held[1], token.end, True, True)]
            held = None
    return found


def _run(run: str) -> tuple[Token, ...]:
    """The tokens of a run without white space, before quoted terms are folded."""
    found: list[Token] = []
    begin, name = 0, run.rstrip(TAIL)
    if name and NAME.search(name):
        begin = len(name)
        found.append(Token(name, name.lower(), 0, begin, True, True))
    for piece in PIECE.finditer(run, begin):
        a, b = piece.span()
        if piece[0][0].isalnum() or piece[0][0] in "'-":
            found += _split(run, a, b)
        elif piece[0] not in FORMATTING:
            found.append(_plain(run, a - (a > 0 and run[a - 1] == "\\"), b))
    return tuple(found)


#: Runs longer than LONGEST_RUN aren't kept, so that what is kept stays small.
LONGEST_RUN = 64
_kept_run = functools.lru_cache(maxsize=50_000)(_run)
_ANY_QUOTE = re.compile("[" + "".join(sorted(QUOTES)) + "]")


def tokenise(text: str, offset: int = 0) -> list[Token]:
    found: list[Token] = []
    quoted = _ANY_QUOTE.search(text)
    shift = 0 if quoted else offset
    for run in RUN.finditer(text):
        at, said = run.start() + shift, run[0]
        for word, key, start, end, capitalised, mention in _kept_run(said) if len(said) <= LONGEST_RUN else _run(said):
            found.append(Token(word, key, start + at, end + at, capitalised, mention))
    if not quoted:
        return found
    found = _folded(found, text)
    return [t._replace(start=t.start + offset, end=t.end + offset) for t in found] if offset else found


def units(text: str) -> list[list[Token]]:
    """Runs of tokens up to a full stop, exclamation or question mark, or to the end of a line."""
    found, at = [], 0
    for line in text.split("\n"):
        held: list[Token] = []
        for token in tokenise(line.removesuffix("\r"), at):
            held.append(token)
            if token.word in ENDERS:
                found.append(held)
                held = []
        if held:
            found.append(held)
        at += len(line) + 1
    return found


@functools.lru_cache(maxsize=100_000)
def _fused(key: str) -> tuple[str, str] | None:
    """The stem and clitic of a word written without its apostrophe, if both are listed and can join."""
    if lexicon.places(key):
        return None
    for clitic, bare in CLITICS.items():
        stem = key.removesuffix(bare)
        hosts = lexicon.AUXILIARIES if clitic == "n't" else lexicon.PRONOUN_WORDS
        if stem and stem != key and stem in hosts and lexicon.places(stem) and lexicon.places(clitic):
            return stem, clitic
    return None


def halves(token: Token) -> tuple[Token, Token] | None:
    if (parts := _fused(token.key)) is None:
        return None
    stem, clitic = parts
    cut = token.start + len(stem)
    return Token(token.word[: len(stem)], stem, token.start, cut, token.capitalised, False), Token(clitic, clitic, cut, token.end, False, False)


def mended(tokens: list[Token]) -> tuple[list[Token], list[int]]:
    """Tokens with fused contractions split, and the places (before that) where they stood."""
    if not any(_fused(t.key) for t in tokens):
        return tokens, []
    found, fused = [], []
    for k, token in enumerate(tokens):
        if parts := halves(token):
            found += parts
            fused.append(k)
        else:
            found.append(token)
    return found, fused


def retyped(token: Token, word: str) -> Token:
    word = word[:1].upper() + word[1:] if token.capitalised else word
    return token._replace(word=word, key=word.lower())


def detokenised(tokens: list[Token]) -> str:
    joined = lambda t: not t.mention and (t.key[0] == "'" or t.key == "n't" or t.key in {".", ",", "!", "?", ";", ":"})
    return "".join(t.word if k == 0 or joined(t) else " " + t.word for k, t in enumerate(tokens))
