"""Byte-pair merges of many words at once, in rounds over one flat array of symbols.

A round finds for every word the pair of neighbours with the lowest rank (by binary search over sorted
pair keys), merges it wherever it stands in the word, and looks up only the pairs beside what it made.
Merging all places of a pair at once equals merging them one by one from the left, unless what it makes
can take part in a merge of lower rank; for such ranks (found beforehand in the table) a round merges the
leftmost place alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.int32(2**31 - 1)
#: Texts handled at once hold about so many characters.
CHARS = 1_500_000
#: Words whose encoding a worker remembers; when full, it keeps those in use (this touches speed only).
REMEMBERED = 250_000


class Merges:
    """left, right, merged: symbol numbers of each merge; rank: its place (ascending: first)."""

    def __init__(self, left: Sequence[int], right: Sequence[int], merged: Sequence[int], rank: Sequence[int], symbols: int):
        left, right, merged, rank = (np.asarray(x, dtype=np.int64) for x in (left, right, merged, rank))
        self.width = np.int64(symbols + 1)
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], rank[order].astype(np.int32)
        size = int(rank.max(initial=-1)) + 1
        self.made = np.zeros(size, dtype=np.int64)
        self.made[rank] = merged
        #: The lowest rank that a symbol takes part in; a rank is rash if its result has a lower one.
        lowest = np.full(symbols + 1, NONE, dtype=np.int64)
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        self.rash = lowest[self.made] <= np.arange(size)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.rank[at], NONE) if len(self.key) else np.full(len(key), NONE)

    def run(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words, end to end, and how many each word has: the same after all merges."""
        count = len(lengths)
        word = np.repeat(np.arange(count), lengths)
        symbols = symbols.astype(np.int64)
        rank = np.full(len(symbols), NONE, dtype=np.int32)
        if len(symbols) > 1:
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same] = self.ranks(symbols[same], symbols[same + 1])
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            opens = np.empty(len(word), dtype=bool)
            opens[0], opens[1:] = True, word[1:] != word[:-1]
            best = np.minimum.reduceat(rank, np.flatnonzero(opens))
            place = np.cumsum(opens) - 1
            best_at = best[place]
            live = best_at < NONE
            if not (going := np.count_nonzero(live)):
                break
            if going < 0.7 * len(live):
                ended.append((symbols[~live], word[~live]))
                symbols, word, rank, best_at = symbols[live], word[live], rank[live], best_at[live]
                live = live[live]
            at = np.flatnonzero((rank == best_at) & live)
            follows = np.diff(at, prepend=-2) == 1
            if follows.any():
                run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            rash = self.rash[best_at[at]]
            if rash.any():
                at = at[~rash | (np.diff(word[at], prepend=-1) != 0)]
            symbols[at] = self.made[best_at[at]]
            kept = np.ones(len(symbols), dtype=bool)
            kept[at + 1] = False
            rank[at] = rank[at + 1]
            symbols, word, rank = symbols[kept], word[kept], rank[kept]
            at = at - np.arange(len(at))
            for beside in (at, at - 1):
                beside = beside[(beside >= 0) & (beside < len(word) - 1)]
                beside = beside[word[beside] == word[beside + 1]]
                rank[beside] = self.ranks(symbols[beside], symbols[beside + 1])
        ended.append((symbols, word))
        symbols, word = (np.concatenate(x) for x in zip(*ended, strict=True))
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=count)


def portions(batch: pa.RecordBatch, column: str, chars: int = CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """batch in slices of about chars characters of column each; a null text counts as empty."""
    values = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    for begin, end in slices(sizes, chars):
        yield batch.slice(begin, end - begin), [x or "" for x in values.slice(begin, end - begin).to_pylist()]


def remembered(known: dict, words: set[str], encode: Callable[[list[str]], Sequence], fixed: dict | None = None) -> None:
    """Add what known lacks of words."""
    if missing := [x for x in words if x not in known]:
        if len(known) + len(missing) > REMEMBERED:
            used = {x: known[x] for x in words if x in known}
            known.clear()
            known.update(fixed or {})
            known.update(used)
        known.update(zip(missing, encode(missing), strict=True))


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to most, or of one row."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield begin, end
        begin = end
