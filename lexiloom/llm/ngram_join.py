"""Jaccard self-join on word n-grams: a MinHash LSH forest proposes, exact verification decides.

Texts are compared as sets of five-word shingles (words: runs of anything but ASCII white space; a text
of fewer words is one shingle), and linked at a similarity of 0.8 or more.

1. Equal texts become one node, with the number of its copies; copies are never expanded.
2. Each node gets a signature of ``DEPTH`` MinHash values (16 bits of each) in each of ``TREES`` trees. All
   signatures are sorted by ranges, so that the nodes below a prefix are a run of neighbours: the sorted order
   is the tries, and the length of the prefix that neighbours share is read from it.
3. A node's matched prefixes start at full depth. They are shortened by one value, tree after tree, until
   its expected recall reaches ``RECALL`` at the lowest similarity that a link of a set of its size can have
   (at the threshold itself from a few shingles on; small sets can't get as low, and keep longer prefixes).
   The nodes of a run whose shared prefix is long enough for one of them are joined to the run's smallest.
4. The components of these stars are the groups in which links can be. A group is read by one task if its
   shingles and the pairs to compare are few; a larger one is cut into blocks, and each pair of blocks is a
   task. No pair is written: a task counts each node's links and tells, for each node, the smallest one it is
   connected to.
5. In a task a prefix filter over the rarest shingles proposes partners, and the sizes of the intersections
   are counted over inverted lists. All links of a group are found, between all its blocks.

Result: a row per document with class_id (the smallest doc_id connected to it by links) and n_links (how
many other documents it is linked to, copies included).

Defined results: null texts and texts without a word have no links and are a class each; repeated rows are
copies, linked to each other; ids may be of any type that can be ordered; null ids count as documents and
come last in the choice of class_id (null only if all of a class are null); very long texts are compared
whole; empty tables give no rows; other columns are kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.components import components, grouped
from lexiloom.llm.merges import portions
from lexiloom.session import cut, table

NAME = "op5_ngram_jaccard_join"
WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 40, 8, 0.9998
#: Shingles of a block, about: so many 64-bit numbers a task holds, or twice as many for two blocks.
BLOCK = 800_000
#: Nodes of a group times its shingles, for one task: a bound of the steps along its inverted lists.
WORK = 20_000_000
#: From so many shingles on, the weakest link of a set counts as being at the threshold.
MANY = 64
SEED = 7
_random = np.random.default_rng(SEED)
FLIP = _random.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
TIMES = _random.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The set of shingles of each text: sorted 64-bit numbers."""
    split = [x.encode().split() for x in texts]
    number = {w: xxhash.xxh3_64_intdigest(w) for w in {w for x in split for w in x}}
    found = []
    for x in split:
        h = np.fromiter(map(number.__getitem__, x), dtype=np.uint64, count=len(x))
        if not len(h):
            found.append(h)
            continue
        n = max(1, len(h) - words + 1)
        value = np.zeros(n, dtype=np.uint64)
        for k in range(min(words, len(h))):
            value = value * BASE + h[k : n + k]
        found.append(np.unique(mixed(value)))
    return found


def weakest(n: int, similarity: float = SIMILARITY) -> float:
    """The lowest similarity of the threshold or more that a set of n can have to another."""
    return min(i / u for i in range(1, n + 1) for u in range(n, int(i / similarity + 1e-9) + 1) if i / u >= similarity - 1e-9)


def expected_recall(shortened: int, similarity: float, trees: int = TREES, depth: int = DEPTH) -> float:
    """How likely some tree matches a pair, with prefixes shortened so many times in all, tree after tree."""
    whole, more = divmod(shortened, trees)
    miss = lambda k: 1 - similarity**k
    return 1 - miss(depth - whole) ** (trees - more) * (miss(depth - whole - 1) ** more if more else 1)


def shortening(n: int, similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """How many times the prefixes of a set of n shingles are shortened until the recall is reached."""
    lowest, most = weakest(n, similarity), trees * (depth - 1)
    return next((c for c in range(most) if expected_recall(c, lowest, trees, depth) >= recall), most)


def signature(values: np.ndarray) -> bytes:
    """MinHash values of a set of shingles, DEPTH for each tree; 16 well-mixed bits of each."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(FLIP), 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(low), 512):
        best = np.minimum(best, ((low[at : at + 512, None] ^ FLIP) * TIMES).min(axis=0))
    return (((best ^ (best >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(">u2").tobytes()


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), n (shingles), signature (null if there are none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in portions(batch, "text"):
                sets = shingles(texts)
                made = pa.array([signature(x) if len(x) else None for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in sets], pa.int64()), made], names=["doc_id", "key", "n", "signature"])

    rows = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), "text")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("n", T.LongType()), T.StructField("signature", T.BinaryType())])
    return rows.mapInArrow(run, schema)


# The forest -----------------------------------------------------------------------------------------


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """The bytes of a column of binaries of one width, a row for each."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(len(column), width)


def stars(shared: np.ndarray, wanted: np.ndarray, keys: np.ndarray, least: int) -> np.ndarray:
    """For rows in sorted order, the row with the smallest key of the widest run that is matched, or the row itself.

    shared: values of the prefix that each row shares with the one before it; wanted: the length that matches it.
    """
    n = len(shared)
    leader = np.arange(n)
    near = shared >= least
    near[:-1] |= near[1:].copy()
    some = np.flatnonzero(near)
    if not len(some):
        return leader
    both = keys[some].view(">u8").astype(np.uint64)
    order = np.lexsort((both[:, 1], both[:, 0]))
    rank = np.empty(len(some), dtype=np.int64)
    rank[order] = np.arange(len(some))
    prefix, length = shared[some], wanted[some]
    for d in range(DEPTH, least - 1, -1):
        opens = np.flatnonzero(prefix < d)
        sizes = np.diff(opens, append=len(some))
        matched = (np.minimum.reduceat(length, opens) <= d) & (sizes > 1)
        first = order[np.minimum.reduceat(rank, opens)]
        inside = np.repeat(matched, sizes)
        leader[some[inside]] = some[np.repeat(first, sizes)[inside]]
    return leader


def matched(signed: DataFrame, least: int) -> DataFrame:
    """signed: prefix (a signature in one tree), key, depth (of the prefix that matches it). a, b: edges between keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix, keys, depth = fixed(batch.column(0), 2 * DEPTH).view(">u2"), fixed(batch.column(1), 16), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            equal = np.zeros((len(keys), DEPTH), dtype=bool)
            equal[1:] = prefix[1:] == prefix[:-1]
            leader = stars(np.logical_and.accumulate(equal, axis=1).sum(axis=1), depth, keys, least)
            at = np.flatnonzero(leader != np.arange(len(keys)))
            a, b = [keys[k].tobytes() for k in at], [keys[k].tobytes() for k in leader[at]]
            first, last = keys[leader[0]].tobytes(), keys[leader[-1]].tobytes()
            if tail and tail[0][: 2 * least] == prefix[0].tobytes()[: 2 * least]:
                a.append(max(first, tail[1]))
                b.append(min(first, tail[1]))
                last = min(last, b[-1]) if leader[0] == leader[-1] else last
            head, tail = head or (prefix[0].tobytes(), first), (prefix[-1].tobytes(), last)
            yield made(a, b)
        if head:  # the seams between ranges are closed from these
            yield made([head[1]], [tail[1]], [TaskContext.get().partitionId()], [head[0]], [tail[0]])

    def made(a: list, b: list, *more: list) -> pa.RecordBatch:
        part, head, tail = more or [[None] * len(a)] * 3
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(part, pa.int32()), pa.array(head, pa.binary()), pa.array(tail, pa.binary())], names=["a", "b", "part", "head", "tail"])

    found = cut(signed.repartitionByRange("prefix", "key").sortWithinPartitions("prefix").mapInArrow(run, "a binary, b binary, part int, head binary, tail binary"))
    ends = found.where("part IS NOT NULL").orderBy("part").collect()  # a row per range
    seams = [(bytes(x["b"]), bytes(y["a"])) for x, y in zip(ends, ends[1:], strict=False) if x["tail"][: 2 * least] == y["head"][: 2 * least]]
    return found.where("part IS NULL").select("a", "b").unionByName(signed.sparkSession.createDataFrame(seams, "a binary, b binary"))


def forest(nodes: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """nodes: key, n, signature. a, b: edges that join all nodes that share a matched prefix, T for each at most."""
    counts = [shortening(n, similarity, recall) for n in range(1, MANY + 1)]
    times = F.element_at(F.lit(counts), F.least(F.col("n"), F.lit(MANY)).cast("int"))
    trees = nodes.select("key", "signature", times.alias("times"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    depth = DEPTH - F.floor(F.col("times") / TREES) - (F.col("tree") < F.col("times") % TREES).cast("int")
    signed = trees.select(F.substring("signature", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("prefix"), "key", depth.cast("byte").alias("depth"))
    return matched(signed, DEPTH - max(-(-c // TREES) for c in counts))


# Verification ---------------------------------------------------------------------------------------


class Group:
    """Links within a group of sets, or between two blocks of it."""

    def __init__(self, sets: list[np.ndarray], side: np.ndarray, copies: np.ndarray, similarity: float):
        self.sets, self.side, self.copies, self.similarity = sets, side, copies, similarity
        self.links = np.zeros(len(sets), dtype=np.int64)
        self.parent = list(range(len(sets)))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def find(self) -> None:
        sizes = np.array([len(x) for x in self.sets])
        owner = np.repeat(np.arange(len(self.sets)), sizes)
        _, token, count = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        shared = count[token] > 1
        begin = np.cumsum(sizes) - sizes
        # Every set's tokens from the rarest on; of these, the first n - ceil(s n) + 1 are its prefix.
        order = np.lexsort((token, count[token], owner))
        prefix = np.zeros(len(token), dtype=bool)
        prefix[order] = np.arange(len(token)) - begin[owner[order]] < (sizes - np.ceil(self.similarity * sizes - 1e-9).astype(int) + 1)[owner[order]]
        lists = {}
        for name, kept in (("all", shared), ("prefix", prefix & shared)):
            tokens, owners = token[kept], owner[kept]
            by = np.argsort(tokens, kind="stable")
            ends = np.cumsum(np.bincount(tokens, minlength=len(count)))
            lists[name] = owners[by], ends
        mine_all, mine_prefix = (np.split(np.where(k, token, -1), begin[1:]) for k in (shared, prefix & shared))
        for i in range(len(self.sets)):
            wanted = self._partners(i, self._listed(lists["prefix"], mine_prefix[i]), sizes)
            if not len(wanted):
                continue
            common = np.bincount(self._listed(lists["all"], mine_all[i]), minlength=len(self.sets))[wanted]
            linked = wanted[common >= self.similarity * (sizes[i] + sizes[wanted] - common) - 1e-9]
            self.links[i] += self.copies[linked].sum()
            self.links[linked] += self.copies[i]
            for j in linked.tolist():
                a, b = sorted((self.root(i), self.root(j)))
                self.parent[b] = a

    @staticmethod
    def _listed(lists: tuple[np.ndarray, np.ndarray], tokens: np.ndarray) -> np.ndarray:
        owners, ends = lists
        parts = [owners[(ends[t - 1] if t else 0) : ends[t]] for t in tokens[tokens >= 0].tolist()]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def _partners(self, i: int, found: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        found = np.unique(found[found < i])
        near = (np.minimum(sizes[found], sizes[i]) >= self.similarity * np.maximum(sizes[found], sizes[i]) - 1e-9) & ((self.side[found] != self.side[i]) | (self.side[i] < 0))
        return found[near]


def verified(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """rows: task, side (-1: alone), key, copies, text. key, links, root, for nodes with a link."""

    def result(held: list[tuple]) -> pa.RecordBatch:
        unique = list({(x[1], x[2]): x for x in held}.values())
        unique.sort(key=lambda x: x[2])
        sets = shingles([x[4] for x in unique])
        group = Group(sets, np.array([x[1] for x in unique]), np.array([x[3] for x in unique], dtype=np.int64), similarity)
        group.find()
        some = np.flatnonzero(group.links).tolist()
        keys = [x[2] for x in unique]
        return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in some], pa.binary()), pa.array(group.links[some], pa.int64()), pa.array([keys[group.root(k)] for k in some], pa.binary())], names=["key", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):  # few rows at a time: their texts are copied
                for row in zip(*(x.to_pylist() for x in batch.slice(begin, 200).columns), strict=True):
                    if held and held[0][0] != row[0]:
                        if len(held) > 1:
                            yield result(held)
                        held = []
                    held.append(row)
        if len(held) > 1:
            yield result(held)

    dealt = rows.select("task", "side", "key", "copies", "text").repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(run, "key binary, links long, root binary")


def tasks(groups: DataFrame, block: int = BLOCK, work: int = WORK) -> DataFrame:
    """groups: key, label, n, copies, rep. The same rows with task and side; those of a cut group are repeated for each pair of blocks."""
    size = groups.groupBy(F.col("label").alias("l")).agg(F.sum("n").alias("whole"), F.count("*").alias("nodes"))
    # Blocks by hash, half full on average, so that none is much larger than meant.
    pairs = F.col("whole") * F.col("nodes").cast("double")
    blocks = F.greatest(F.when(F.col("whole") > block, F.ceil(2 * F.col("whole") / block)).otherwise(1), F.when(pairs > work, F.ceil(2 * F.sqrt(pairs / work))).otherwise(1))
    rows = groups.join(size.withColumn("_blocks", blocks.cast("long")), F.col("label") == F.col("l")).drop("l", "whole", "nodes")
    small = rows.where("_blocks = 1").select(*groups.columns, F.concat(F.lit("g"), F.hex("label")).alias("task"), F.lit(-1).alias("side"))
    large = rows.where("_blocks > 1").withColumn("_own", F.pmod(F.xxhash64("key"), "_blocks"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda o: F.struct(F.least(o, F.col("_own")).alias("lo"), F.greatest(o, F.col("_own")).alias("hi")))
    large = large.withColumn("_pair", F.explode(pair))
    side = F.when(F.col("_pair.lo") == F.col("_pair.hi"), -1).when(F.col("_own") == F.col("_pair.lo"), 0).otherwise(1)
    large = large.select(*groups.columns, F.concat_ws("-", F.lit("b"), F.hex("label"), "_pair.lo", "_pair.hi").alias("task"), side.alias("side"))
    return small.unionByName(large)


def copied(texts: DataFrame) -> DataFrame:
    return texts.withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))


#: A key with this share of the rows is hot; there can't be more hot keys than its inverse.
HOT = 0.001


def with_told(rows: DataFrame, told: DataFrame, total: int) -> DataFrame:
    """rows (key, n) with what is told of each key that has shingles; told: k, copies and more.

    The keys with many copies are broadcast (there are 1 / HOT at most), so that none is one task of a join.
    """
    many = F.col("copies") > max(1.0, total * HOT)
    hot = F.broadcast(told.where(many))
    full = rows.where("n > 0")
    on = F.col("key") == F.col("k")
    return full.join(hot, on).unionByName(full.join(F.broadcast(hot.select("k")), on, "left_anti").join(told.where(~many), on))


def linked(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, work: int = WORK) -> DataFrame:
    """doc_id, key, class_id, n_links and stays of each row of docs (doc_id, text).

    stays: the row is the class's smallest by (doc_id, nulls last, key); repeated rows all say so.
    """
    docs = docs.select("doc_id", "text")
    sketch = cut(sketched(docs))
    full = sketch.where("n > 0")
    nodes = cut(full.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("signature").alias("signature")))
    found = grouped(forest(nodes, similarity, recall))
    groups = found.join(nodes, F.col("node") == F.col("key")).select("key", "label", "n", "copies", "rep")
    dealt = tasks(cut(groups), block, work).select(F.col("key").alias("k"), "rep", "copies", "task", "side")
    told = copied(docs).join(dealt, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("task", "side", "key", "copies", "text")
    links = cut(verified(told, similarity))
    classes = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    best = classes.join(nodes, F.col("node") == F.col("key")).groupBy(F.col("label").alias("l")).agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key")).alias("first"))
    named = classes.join(best, F.col("label") == F.col("l")).select("node", F.col("first.rep").alias("class"), (F.col("node") == F.col("first.key")).alias("chosen"))
    total = links.groupBy(F.col("key").alias("t")).agg(F.sum("links").alias("links"))
    told = nodes.join(named, F.col("key") == F.col("node"), "left").join(total, F.col("key") == F.col("t"), "left")
    told = cut(told.select(F.col("key").alias("k"), "copies", F.when(F.col("node").isNotNull(), F.col("class")).otherwise(F.col("rep")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("chosen", F.lit(True)).alias("chosen")))
    slim = sketch.select("doc_id", "key", "n")
    rows = with_told(slim, told, slim.count()).select("doc_id", "key", "class_id", "n_links", (F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("stays"))
    return rows.unionByName(slim.where("n = 0").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("stays")))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without all but one document of each class: the smallest by (doc_id, nulls last, digest of the text), once."""
    found = linked(docs, **how)
    kept = found.where("stays").select(F.col("key").alias("_k"), F.col("doc_id").alias("_d"))
    kept = kept.groupBy("_k", "_d").agg(F.count("*").alias("_n"))
    kept = cut(kept)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("_key"), F.col("doc_id").alias("_id"))
    stay = rows.join(kept, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_d")))
    if not kept.where("_n > 1").isEmpty():  # repeated rows: only these are compared
        once = stay.where("_n > 1").dropDuplicates(["_k", "_d"])
        stay = stay.where("_n = 1").unionByName(once)
    return stay.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
