"""Byte-level BPE: texts to token ids and back, with the vocabulary of a tokenizers .json file.

Texts are cut into words as the byte-level pre-tokenizer does; the words of a portion of texts that are
not remembered are merged together in numpy rounds (lexiloom.llm.merges). Special strings inside a text
become their own ids, as the library does by default; nothing is added, truncated or padded.

Defined results: a null text is encoded as empty (no ids); null ids stay null when decoded; repeated
rows, ties and empty tables need nothing special; very long texts and words are encoded whole; other
columns are kept, and a column with the name of a result is replaced.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.merges import Merges, portions, remembered, slices
from lexiloom.session import table

NAME = "op8_bpe_encode_decode"
VOCABULARY = "byte_bpe_50k.json"
#: Ids decoded at once.
IDS = 500_000
#: White space of Unicode.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with the space before it, or a run of white space without the last space before a word.
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The published pattern of byte-level pre-tokenization, for use inside a chunk.
INSIDE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+")
PLAIN = re.compile(r" ?[A-Za-z]+")


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        shaped = told.get("pre_tokenizer") or {}
        if told["model"].get("type", "BPE") != "BPE" or told.get("normalizer") or shaped.get("type") != "ByteLevel" or shaped.get("add_prefix_space") or not shaped.get("use_regex", True):
            raise ValueError("only byte-level BPE without a normalizer or an added space is worked out here")
        vocab, letters = told["model"]["vocab"], byte_letters()
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in told["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.whole = {k: np.int32(v).tobytes() for k, v in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.merges = Merges([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], [vocab[a + b] for a, b in pairs], range(len(pairs)), size)
        self.symbol = np.array([vocab[x] for x in letters], dtype=np.int64)
        byte = {x: b for b, x in enumerate(letters)}
        self.bytes = [b""] * size
        for piece, number in vocab.items():
            self.bytes[number] = bytes(byte[x] for x in piece)
        for content, number in self.special.items():
            self.bytes[number] = content.encode()
        self.size = np.fromiter(map(len, self.bytes), dtype=np.int64, count=size)
        #: Ids of a chunk, as the bytes of 32-bit numbers.
        self.known: dict[str, bytes] = {}

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each chunk: cut by the inner pattern, all its parts merged at once."""
        parts = [[x] if PLAIN.fullmatch(x) else INSIDE.findall(x) for x in words]
        raw = [x.encode() for x in chain.from_iterable(parts)]
        flat = self.symbol[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        ids, sizes = self.merges.run(flat, np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        held = np.add.reduceat(sizes, np.cumsum([0, *map(len, parts[:-1])]))
        data, ends = ids.astype(np.int32).tobytes(), (4 * np.cumsum(held)).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end to end, and the offsets of each text."""
        cut = [self._chunks(x) for x in texts]
        remembered(self.known, set(chain.from_iterable(cut)) - self.special.keys(), self.words)
        known = self.known
        if any(s in x for s in self.special for x in texts):
            ids = [b"".join([self.whole.get(y) or known[y] for y in x]) for x in cut]
        else:
            ids = [b"".join(map(known.__getitem__, x)) for x in cut]
        return np.frombuffer(b"".join(ids), dtype=np.int32), np.cumsum([0, *map(len, ids)]) // 4

    def _chunks(self, text: str) -> list[str]:
        if self.cut and any(x in text for x in self.special):
            return [y for x in self.cut.split(text) for y in ([x] if x in self.special else CHUNK.findall(x))]
        return CHUNK.findall(text)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """The text of each list; all bytes are joined at once, and texts that aren't whole UTF-8 one by one."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        data = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        at = np.concatenate([[0], np.cumsum(self.size[ids])])[np.concatenate([[0], np.cumsum(sizes)])]
        begins = np.frombuffer(data, dtype=np.uint8)[at[at < len(data)]]
        if lists.null_count or len(data) >= 2**31 or (begins & 0xC0 == 0x80).any() or not _whole(data):
            return pa.array([None if x is None else self.decode(x) for x in lists.to_pylist()], pa.string())
        return pa.StringArray.from_buffers(len(lists), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))


def _whole(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


@functools.lru_cache(maxsize=2)
def codec(name: str) -> Codec:
    return Codec(vocabulary_path(name))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", ids: str = "ids", decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with ids (array of int); decoded: also the text that decoding them gives, in the same pass."""
    names = [x for x in (docs.columns if keep is None else keep) if x not in (ids, decoded)]
    source = docs.select(*dict.fromkeys([*names, text]))
    at = [source.columns.index(x) for x in names]
    made = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded, T.StringType(), False)] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in portions(batch, text):
                own = codec(vocabulary)
                found, offsets = own.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))
                back = [own.decode_lists(lists)] if decoded else []
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in at), lists, *back], names=[*names, *(f.name for f in made)])

    return source.mapInArrow(run, T.StructType([*(source.schema.fields[k] for k in at), *made]))


def decode(rows: DataFrame, vocabulary: str = VOCABULARY, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text of their ids, special strings included."""
    kept = [x for x in rows.columns if x != text]
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index(ids)
            sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            for begin, end in slices(sizes, IDS):
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, codec(vocabulary).decode_lists(part.column(column))], names=[*kept, text])

    return rows.select(*kept).mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    rows = encode(docs, decoded="text", keep=["doc_id"])
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
