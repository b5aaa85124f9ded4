"""Describing a corpus by sentences it wrote: one per part, chosen against repetition.

Everything that grows with the corpus is an aggregation or a join; only the claims (``CLAIMS`` at most),
their sentences and their characteristic words reach the driver, where the subset is searched.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.operators.corpus import BROADCAST_FEATURES, BROADCAST_WORDS, Corpus, discount, written
from lexiloom.session import cut, few
from lexiloom.sources import trees

#: Claims weighed at once, characteristic words of a part, lengths worth reading, items searched exactly, and the beam beyond.
CLAIMS, CHARACTERISTIC, SHORTEST, LONGEST, EXACT, BEAM = 64, 24, 3, 40, 20, 64


class Claim(NamedTuple):
    feature: str
    worth: float
    trust: float
    start: tuple


def leading(corpus: Corpus, feature: str, considered: int | None = None) -> DataFrame:
    """feature, doc, number, first_pos, tokens, text: the sentence that speaks for each value of a feature.

    Readable sentences; of these, ones with a characteristic word of the part, if any; of these, ones that
    open a passage, if any; of these, the first. All sentences of a part are candidates, or (considered) its first ones.
    """
    words = corpus.characteristic(feature, CHARACTERISTIC).groupBy(F.col("feature").alias("f")).agg(F.collect_set("word").alias("words"))
    words = cut(words)
    found = corpus.best_sentences(feature, words, SHORTEST, LONGEST, considered)
    if found is not None:
        rows = found.join(few(words, BROADCAST_FEATURES), F.col("feature").eqNullSafe(F.col("f")), "left").drop("f")
        return rows.select("feature", "doc", "number", "first_pos", "tokens", written(F.col("tokens")).alias("text"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    # More words than are sent with each task: sentences are joined.
    rate = corpus.marking_rate()
    rows = corpus.passage_sentences()
    if considered:
        in_order = Window.partitionBy(feature).orderBy("doc", "number")
        rows = rows.withColumn("_n", F.row_number().over(in_order)).where(F.col("_n") <= considered).drop("_n")
    ending = (F.char_length(F.element_at("tokens", -1)["spelling"]) == 1).cast("long")
    body = F.col("length") - ending
    rows = rows.where(F.col("length").between(SHORTEST, LONGEST) & (body > 0) & ((F.col("marks") - ending) / body <= rate))
    rows = rows.join(few(words, BROADCAST_FEATURES), F.col(feature).eqNullSafe(F.col("f")), "left").drop("f")
    about = F.col("words").isNull() | F.exists("tokens", lambda t: F.array_contains("words", F.lower(t["spelling"])))
    rows = rows.withColumn("_place", F.when(about & (F.col("first_pos") == 0), 0).when(about, 1).otherwise(2))
    # The best of each part by numbers alone; its tokens are taken up afterwards, so no part is sorted anywhere.
    best = rows.groupBy(F.col(feature).alias("b")).agg(F.min(F.struct("_place", F.col("doc").alias("d"), F.col("number").alias("k"))).alias("best"))
    best = cut(best.select("best.d", "best.k"))
    rows = rows.join(few(best, BROADCAST_FEATURES), (F.col("doc") == F.col("d")) & (F.col("number") == F.col("k")), "left_semi")
    return rows.select(F.col(feature).alias("feature"), "doc", "number", "first_pos", "tokens", written(F.col("tokens")).alias("text"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def claims(corpus: Corpus, feature: str, text: DataFrame) -> DataFrame:
    """feature, weight, worth, start: parts by how much they say (rows of text: the passages), the largest first."""
    count = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    parts = text.groupBy(F.col(feature).alias("feature")).agg(F.sum(count).alias("weight"), F.min(corpus.key).alias("start")).where("weight > 0")
    total = parts.agg(F.sum("weight")).first()[0] or 1
    return parts.withColumn("worth", F.col("weight") / F.lit(float(total))).orderBy(F.col("weight").desc(), "start").limit(CLAIMS)


def clause_cost(corpus: Corpus, feature: str, rows: DataFrame) -> DataFrame:
    """rows of leading with cost: what its words gain from the part, and its pairs from their company."""
    tokens = max(corpus.totals[0], 1)
    each = rows.select("feature", "doc", "number", F.posexplode("tokens").alias("k", "t")).select("feature", "doc", "number", "k", F.lower("t.spelling").alias("w"))
    by = Window.partitionBy("feature", "doc", "number").orderBy("k")
    each = cut(each.withColumn("after", F.lead("w").over(by)))
    # Only what these sentences need of the corpus's counts goes into the joins.
    held = few(each.select(F.col("w").alias("h")).distinct(), BROADCAST_WORDS)
    beside = few(each.where("after IS NOT NULL").select(F.col("w").alias("h1"), F.col("after").alias("h2")).distinct(), BROADCAST_WORDS)
    affinity = corpus.affinity(feature).select(F.col("feature").alias("f"), F.col("word").alias("aw"), "affinity").join(held, F.col("aw") == F.col("h"), "left_semi")
    gained = each.join(affinity, F.col("feature").eqNullSafe(F.col("f")) & (F.col("w") == F.col("aw")), "left").withColumn("gain", F.log(F.greatest(F.coalesce("affinity", F.lit(1.0)), F.lit(1.0))))
    seen = corpus.seen.join(held, F.col("folded") == F.col("h"), "left_semi")
    after = corpus.transitions_of(held)
    pairs = after.join(beside, (F.col("w1") == F.col("h1")) & (F.col("w2") == F.col("h2")), "left_semi")
    varied = after.groupBy(F.col("w1").alias("v")).agg(F.count("*").alias("varied"))
    linked = each.where("after IS NOT NULL").join(pairs, (F.col("w") == F.col("w1")) & (F.col("after") == F.col("w2")), "left")
    linked = linked.join(varied, F.col("w") == F.col("v"), "left").join(seen.select(F.col("folded").alias("l"), F.col("seen").alias("s1")), F.col("w") == F.col("l")).join(seen.select(F.col("folded").alias("r"), F.col("seen").alias("s2")), F.col("after") == F.col("r"))
    common = F.col("s2") / tokens
    n, many = F.coalesce("n", F.lit(0)), F.coalesce("varied", F.lit(0))
    ratio = ((n + many * common) / (F.col("s1") + many)) / common
    linked = linked.withColumn("link", F.log(F.pow(ratio, discount(n, F.col("s1"), F.col("s2")))))
    key = ["feature", "doc", "number"]
    cost = gained.groupBy(key).agg(F.sum("gain").alias("g")).join(linked.groupBy(key).agg(F.sum("link").alias("l")), key, "left")
    return cost.select(*key, (-F.col("g") - F.coalesce("l", F.lit(0.0))).alias("cost"))


def repetition(first: list[tuple[str, bool]], second: list[tuple[str, bool]], rate: dict[str, float]) -> float:
    """How much of what the lighter sentence carries the first one shares with the second."""
    weigh = lambda w, symbol: 0.0 if symbol or rate.get(w, 0.0) <= 0 else -math.log(rate[w])
    left, right = (sum(weigh(*x) for x in s) for s in (first, second))
    if left <= 0 or right <= 0:
        return 0.0
    held = {w for w, _ in second}
    return min(1.0, sum(weigh(*x) for x in first if x[0] in held) / min(left, right))


def best_subset(worth: np.ndarray, pair: np.ndarray, most: int = 0) -> list[int]:
    """Items of the greatest worth together with their pairs: exact to EXACT items, by a beam beyond."""
    n = len(worth)
    limit = most if 0 < most < n else n
    if n <= EXACT:
        value, size = np.zeros(1), np.zeros(1, dtype=int)
        for k in range(n):
            linked = np.zeros(1)
            for j in range(k):
                linked = np.concatenate([linked, linked + pair[j, k]])
            value, size = np.concatenate([value, value + worth[k] + linked]), np.concatenate([size, size + 1])
        value[(size > limit) | (size == 0)] = -np.inf
        mask = int(value.argmax())
        return [k for k in range(n) if mask >> k & 1]
    beam: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for k in range(n):
        more = [(v + worth[k] + sum(pair[j, k] for j in some), (*some, k)) for v, some in beam if len(some) < limit]
        beam = sorted([*beam, *more], key=lambda x: -x[0])[:BEAM]
    return list(next((some for _, some in beam if some), (int(worth.argmax()),)))


def breaks(words: list[set[str]]) -> list[int]:
    """Where a new passage starts: before a stretch of neighbours that share least."""
    links = [len(a & b) / min(len(a), len(b)) if a and b else 0.0 for a, b in zip(words, words[1:], strict=False)]
    ends = [math.inf, *links, math.inf]
    return [k + 1 for k, x in enumerate(links) if x < ends[k] and x <= ends[k + 2]]


def describe(docs: DataFrame, feature: str, most: int = 0, key: str = "doc_id", parts: DataFrame | None = None) -> DataFrame:
    """passage, position, feature, sentence; or one row with a refusal, if there is nothing to say.

    parts: feature, worth, start of what is to be described (CLAIMS rows at most); by default by how much each says.
    """
    spark = docs.sparkSession
    names = "passage int, position int, feature string, sentence string, refusal string"
    refused = lambda why: spark.createDataFrame([(None, None, None, None, why)], names)
    corpus = Corpus(docs.withColumn(feature, F.col(feature).cast("string")), key, (feature,))
    if not corpus.totals[0]:
        return refused("the corpus holds no words to say anything with")
    if corpus.terminators.isEmpty():
        return refused("the input never finishes a sentence")
    if parts is None:
        parts = claims(corpus, feature, docs.withColumn(feature, F.col(feature).cast("string")))
    sentences = leading(corpus, feature)
    told = parts.join(sentences, parts["feature"].eqNullSafe(sentences["feature"])).select(parts["feature"], "worth", "start", "tokens", "text", "words").orderBy("start").collect()
    if not told:
        return refused("the input never wrote a finished sentence about any of its parts")
    wanted = spark.createDataFrame(sorted({(t["spelling"].lower(),) for r in told for t in r["tokens"]}), "w string")
    total = corpus.totals[0]
    rate = {r["w"]: r["seen"] / total for r in corpus.seen.join(F.broadcast(wanted), F.col("folded") == F.col("w")).select("w", "seen").collect()}  # words of CLAIMS sentences
    symbol = lambda s: len(s) == 1 or not any(c.isalnum() for c in s)
    said = [[(t["spelling"].lower(), symbol(t["spelling"])) for t in r["tokens"]] for r in told]
    worth, pair = np.array([r["worth"] for r in told]), np.zeros((len(told), len(told)))
    for a in range(len(told)):
        for b in range(a + 1, len(told)):
            pair[a, b] = -(repetition(said[a], said[b], rate) ** 3) * max(worth[a], worth[b])
    chosen = [told[k] for k in best_subset(worth, pair, most)]
    new = set(breaks([set(r["words"]) for r in chosen]))
    passage, rows = 0, []
    for k, r in enumerate(chosen):
        passage += k in new
        rows.append((passage, k, r["feature"], r["text"], None))
    return spark.createDataFrame(rows, names)


def describe_tree(spark: SparkSession, root: str, most: int = 0) -> DataFrame:
    """A source tree described by the notes of its modules, each weighed by how many of its items carry one."""
    found = trees.files(spark, root)
    rows = trees.passages(found).orderBy("place").withColumn("doc_id", F.monotonically_increasing_id())
    rows = cut(rows)
    told = trees.parts(found).join(rows.groupBy("part").agg(F.min("doc_id").alias("start")), "part")
    told = told.orderBy("depth", F.col("spoken").desc(), "start").limit(CLAIMS).where("spoken > 0")
    total = trees.parts(found).agg(F.sum("spoken")).first()[0] or 1
    trust = F.when(F.col("itself"), 1.0).otherwise(1 / F.col("weight"))
    parts = told.select(F.col("part").alias("feature"), (F.col("spoken") / F.lit(float(total)) * trust).alias("worth"), "start")
    if rows.isEmpty():
        return spark.createDataFrame([(None, None, None, None, "no source was found to read")], "passage int, position int, feature string, sentence string, refusal string")
    return describe(rows.select("doc_id", "part", "text"), "part", most, parts=parts)


def tally(corpus: Corpus, parts: DataFrame) -> DataFrame:
    """claims, words, tokens: how much there is to describe."""
    return parts.agg(F.count("*").alias("claims")).withColumns({"words": F.lit(corpus.vocabulary.count()), "tokens": F.lit(corpus.totals[0])})


def describe_prose(text: DataFrame, most: int = 0, key: str = "doc_id") -> DataFrame:
    """One document described by its paragraphs (text: its row): parts are runs between blank lines."""
    parts = text.select(F.posexplode(F.split("text", "\n\n")).alias(key, "text")).withColumn("text", F.trim("text")).where("text <> ''")
    return describe(parts.withColumn("part", F.col(key).cast("string")), "part", most, key)
