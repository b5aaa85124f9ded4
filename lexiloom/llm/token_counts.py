"""Token counts as a sentencepiece BPE model gives them, by the whole-token shortcut.

No piece has the space mark after another character, so no merge crosses from a word to the mark before
the next one, and a text can be cut there; it can be cut beside any character that no longer piece holds,
such as a line end. Both facts are proved from the vocabulary when it is loaded, and so is the list of
pieces that, alone, encode as one token. A word in that list counts one; only the rest is merged, many
words at once (lexiloom.llm.merges). Characters outside the vocabulary count one token for each byte.

Defined results: a null or empty text has no bytes and no tokens; strings of control pieces inside a text
are ordinary text, as is the library's default; very long texts are counted whole; repeated rows and
empty tables need nothing special; other columns are kept, and columns with the names of results replaced.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.bpe import vocabulary_path
from lexiloom.llm.merges import Merges, portions, remembered
from lexiloom.session import table

NAME = "op3_token_counts"
MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"
#: Texts that a normalizer, or another treatment of spaces, would change.
PROBES = [" a", "a ", "a  b", "a\tb\nc", "\u3000a", "Ａ", "ﬁ", "Ⅷ", "e\u0301", "a\u200bb"]


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in ordinary}
        place = {x: k for k, x in enumerate(sorted(pieces, key=lambda x: -pieces[x]))}
        long = [x for x in place if len(x) > 1]
        if any(MARK in x.lstrip(MARK) for x in place) or any(c not in place for x in long for c in x):
            raise ValueError("this vocabulary can't be cut at spaces, or holds a piece without a character of it")
        splits = [(place[x[:k]], place[x[k:]], place[x]) for x in long for k in range(1, len(x)) if x[:k] in place and x[k:] in place]
        left, right, merged = zip(*splits, strict=True)
        self.unknown = len(place)
        self.merges = Merges(left, right, merged, merged, len(place))
        self.symbol = np.full(0x110000, self.unknown, dtype=np.int32)
        for x in place:
            if len(x) == 1:
                self.symbol[ord(x)] = place[x]
        alone = "".join(c for c in map(chr, range(128)) if not any(c in x for x in long) and c != MARK)
        self.cut = re.compile(f"{MARK}*[^{MARK}{re.escape(alone)}]+|{MARK}+|[{re.escape(alone)}]" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        counts, ends = self._merged(long)
        self.whole = {x: 1 for x, n, s in zip(long, counts, ends, strict=True) if n == 1 and s == place[x]}
        self.known: dict[str, int] = dict(self.whole)
        # A model that normalizes, or treats spaces in another way, is none that this counts for.
        if self.counts(PROBES) != [len(model.encode(x)) for x in PROBES]:
            raise ValueError("this model prepares texts in a way that is not worked out here")

    def _merged(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Tokens of each word, and its last symbol."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = self.symbol[points]
        # An unknown character takes as many tokens as it has bytes; one of them is counted as its symbol.
        more = np.where(flat == self.unknown, (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF), 0)
        begin = np.cumsum(lengths) - lengths
        extra = np.add.reduceat(more, begin) if len(words) else more
        symbols, sizes = self.merges.run(flat, lengths)
        return (sizes + extra).tolist(), symbols[np.cumsum(sizes) - 1].tolist()

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.cut.findall(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
        remembered(self.known, set(chain.from_iterable(cut)), lambda words: self._merged(words)[0], self.whole)
        return [sum(map(self.known.__getitem__, x)) for x in cut]


@functools.lru_cache(maxsize=2)
def counter(name: str) -> Counter:
    return Counter(vocabulary_path(name))


def count_tokens(docs: DataFrame, model: str = MODEL, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit."""
    docs = docs.drop("n_bytes", "n_tokens", "over_limit").withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in portions(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counter(model).counts(texts), pa.int64())], names=[*names, "n_tokens"])

    return docs.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")
