"""Counts over whole texts that the quality rules and the quality classifier share.

A null text counts as empty: all counts are 0. Words are runs of anything but ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexiloom.llm.merges import portions

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_distinct", "n_upper", "n_letters", "n_digits", "n_marks", "n_cries", "n_other")
WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def _classes(*sets: bytes) -> np.ndarray:
    table = np.zeros((256, len(sets)), dtype=np.int64)
    for k, x in enumerate(sets):
        table[list(x), k] = 1
    return table


#: white, symbols, upper case, letters, digits, marks, cries, continuation bytes, first bytes beyond ASCII
CLASSES = _classes(WHITE, SYMBOLS, bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)]), b"0123456789", b".,;:?'\"()-", b"!", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100)))


def repeated_words(words: list[bytes], window: int = WINDOW) -> tuple[int, int]:
    """Words that stand in a window found twice or more, and how many different words there are."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    n = len(ids) - window + 1
    if n < 2 or len(number) == len(ids):
        return 0, len(number)
    key, distinct = ids[:n], len(number)
    for k in range(1, window):  # numbers of longer and longer windows, exact
        key = key * len(number) + ids[k : n + k]
        distinct *= len(number)
        if distinct * len(number) > 2**62 and k < window - 1:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            distinct = int(key.max()) + 1
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0, len(number)
    begins = np.zeros(len(ids) + 1, dtype=np.int64)
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    begins[twice] += 1
    begins[twice + window] -= 1
    return int(np.count_nonzero(np.cumsum(begins) > 0)), len(number)


def counts(text: str) -> tuple[int, ...]:
    data = text.encode()
    words = data.split()
    seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ CLASSES
    white, symbols, upper, letters, digits, marks, cries, inner, first = seen.tolist()
    lines = data.split(b"\n")
    filled = [x for x in lines if x.strip()] if len(lines) > 1 else lines
    repeat, distinct = repeated_words(words)
    chars = len(data) - inner
    return len(words), chars - white, symbols, (len(filled) - len(set(filled)) if len(filled) > 1 else 0), repeat, chars, len(filled), distinct, upper, letters, digits, marks, cries, first


def counted(docs: DataFrame, keep: list[str], text: str = "text", prefix: str = "") -> DataFrame:
    """The columns keep of docs and the counts of its text."""
    names = [prefix + x for x in COUNTS]
    source = docs.select(*dict.fromkeys([*keep, text]))
    at = [source.columns.index(x) for x in keep]
    schema = T.StructType([*(source.schema.fields[k] for k in at), *(T.StructField(x, T.LongType(), False) for x in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in portions(batch, text):
                found = np.array([counts(x) for x in texts], dtype=np.int64).reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in at), *(pa.array(x) for x in np.ascontiguousarray(found.T))], names=[*keep, *names])

    return source.mapInArrow(run, schema)
