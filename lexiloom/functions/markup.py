"""Prose in files: comment lines and markdown paragraphs, with where each line stands (in code points)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

FENCE = "```"
Blocks = list[list[tuple[int, str]]]


def _numbered(source: str) -> Iterator[tuple[int, str]]:
    at = 0
    for line in source.split("\n"):
        yield at, line.removesuffix("\r")
        at += len(line) + 1


def _blocks(source: str, prose: Callable[[str], tuple[int, str] | None], fence_closes: bool) -> Blocks:
    """prose: where a line's text starts, and the text; None for a line that is no prose and ends block and fence."""
    found: Blocks = [[]]
    fenced = False
    for at, line in _numbered(source):
        told = prose(line)
        if told is None:
            fenced = False
            found.append([])
            continue
        skip, text = told
        if text.startswith(FENCE):
            fenced = not fenced
            if fence_closes:
                found.append([])
        elif fenced or text.startswith(("#", "|")):
            continue
        elif text:
            found[-1].append((at + skip, text))
        else:
            found.append([])
    return [b for b in found if b]


def markdown_blocks(source: str) -> Blocks:
    return _blocks(source, lambda line: (len(line) - len(line.lstrip()), line.strip()), True)


def comment_blocks(source: str) -> Blocks:
    def prose(line: str) -> tuple[int, str] | None:
        text = line.lstrip()
        if not text.startswith(("///", "//!")):
            return None
        rest = text[3:]
        return len(line) - len(rest.lstrip()), rest.strip()

    return _blocks(source, prose, False)


def joined(blocks: Blocks) -> str:
    """Each line and a space; a line end after each block."""
    return "".join("".join(line + " " for _, line in b) + "\n" for b in blocks)
