"""SpotSigs fingerprints (DataFrame functions only).

A spot is an anchor, a common word or the start of a sentence or line, and its signature the chain of the
next ``CHAIN`` content words, anchors between them left out. A text's fingerprint is its set of signatures
(32-bit hashes, ascending). Sets are partitioned by their length, so that two sets of a Jaccard similarity of
``least`` or more are in one partition or in neighbouring ones, and compared through pruned Jaccard: the bound
that lengths and value ranges give comes first, and the sets are read only where it allows the least. What is
not pruned is exact. ``near`` searches all documents for those near to a set of queries in this way. The query
of this module tells the exact likeness of every pair it names, whatever it is, so its least is anything above
0: there only pairs that can share nothing are pruned.

For each document, the query also fingerprints an edited text, whose second half comes from the next
document by descending id. Ids are dealt into ranges whose bounds are quantiles, and each range is sorted
by itself; the first document of each range also goes to the end of the one before it.

Defined results: a null text counts as empty (no signature); the likeness of two empty sets is 1, of an
empty and another 0; a null id is last in descending order, and equal ids are ordered by the digests of
their texts, so that repeated rows follow each other; a single document is its own next; very long texts are read whole; an empty table gives no rows; other columns are kept by
``fingerprinted``, and those with the names of its results replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.operators.ordering import range_bounds, range_of
from lexiloom.session import cut, table

NAME = "op9_document_fingerprints"
CHAIN = 3
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to a in is that it for on was with be by as at are this from or an not have he his her they we you were which "
    "der die und den das von ein zu im mit des dem ist auf sich eine als auch nicht es "
    "de la le et les un une du que en dans qui pour est par sur au plus ce avec son pas "
    "el y los se las del por con su para al lo como mas o si"
).split()
STOP = "¶"


def _trie(words: list[str]) -> str:
    """A pattern for any of the words that shares their beginnings, so that most words fail at once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    ends = "" in heads
    parts = [h + _trie(rest) for h, rest in heads.items() if h]
    if not parts:
        return ""
    return ("(?:" + "|".join(parts) + ")" if len(parts) > 1 or ends else parts[0]) + ("?" if ends else "")


#: An anchor, to be marked, among words with one space between them; and a chain once they are marked.
ANCHOR = f" ({_trie(sorted(set(ANCHORS)))})(?= )"
SPOT = rf"(?= ({STOP}[^ ]*+(?:(?: {STOP}[^ ]*+)*+ [^ {STOP}][^ ]*+){{1,{CHAIN}}}))"
INNER = rf" {STOP}[^ ]*"
#: Rows of a range in the order of documents, about.
RANGE_ROWS = 4_000
FIRST = -(2**63)
LEAST = 0.8


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The set of signatures of a text: ascending ints."""
    spot = SPOT.replace(f"{{1,{CHAIN}}}", f"{{1,{chain}}}")
    flat = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(STOP), F.lit(" "))
    for mark in (".", "!", "?", "\n"):
        flat = F.replace(flat, F.lit(mark), F.lit(f" {STOP} "))
    flat = F.regexp_replace(F.concat(F.lit(f" {STOP} "), flat, F.lit(" ")), rf"[^\p{{L}}\p{{N}}{STOP}]+", " ")
    spots = F.regexp_extract_all(F.regexp_replace(flat, ANCHOR, f" {STOP}$1"), F.lit(spot), F.lit(1))
    bare = lambda s: F.when(F.contains(s, F.lit(f" {STOP}")), F.regexp_replace(s, INNER, "")).otherwise(s)
    return F.sort_array(F.array_distinct(F.transform(spots, lambda s: F.hash(bare(s)))))


def length_partition(n: Column, least: float = LEAST) -> Column:
    """Of a set of n signatures: sets of lengths within the ratio least differ by 1 at most."""
    return F.floor(F.log(n.cast("double")) / -math.log(least)).cast("int")


def most_alike(a: Column, b: Column) -> Column:
    """No less than the Jaccard similarity of two ascending sets, by their lengths and value ranges alone."""
    m, n = F.size(a), F.size(b)
    apart = (F.element_at(a, -1) < F.get(b, F.lit(0))) | (F.element_at(b, -1) < F.get(a, F.lit(0)))
    return F.when((m == 0) & (n == 0), 1.0).when((m == 0) | (n == 0), 0.0).when(apart, 0.0).otherwise(F.least(m, n) / F.greatest(m, n).cast("double"))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two ascending sets; 0 for pairs whose bound is 0 or short of least."""
    m, n = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    bound = most_alike(a, b)
    return F.when((m == 0) & (n == 0), 1.0).when((bound <= 0) | (bound < least), 0.0).otherwise(common / (m + n - common).cast("double"))


def near(queries: DataFrame, docs: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Search docs (doc_id, text) for sets near to those of a stated, small set of queries (doc_id, text).

    First: fingerprint_key of a query, near_key, likeness, for pairs of different sets. Second: doc_id and
    fingerprint_key of each of docs, so that equal fingerprints are pairs once, whatever their copies. Texts
    without a signature are near to none. Two sets this near share one of the first (1 - least) of their
    signatures, ascending (a prefix filter), and a length partition or its neighbour.
    """
    key = lambda rows: rows.select("doc_id", signatures(F.col("text")).alias("_s")).withColumn("fingerprint_key", F.md5(printed(F.col("_s"))))
    sets = lambda rows: rows.where(F.size("_s") > 0).groupBy("fingerprint_key").agg(F.first("_s").alias("_s"))
    members = cut(key(docs))
    first = F.slice("_s", F.lit(1), (F.size("_s") - F.ceil(F.size("_s") * F.lit(least) - 1e-9) + 1).cast("int"))
    part = length_partition(F.size("_s"), least)
    wanted, held = cut(sets(key(queries))), cut(sets(members))
    ask = wanted.select(F.col("fingerprint_key").alias("q"), F.explode(F.sequence(part - 1, part + 1)).alias("p"), first.alias("f")).select("q", "p", F.explode("f").alias("f"))
    told = held.select(F.col("fingerprint_key").alias("k"), part.alias("p"), F.explode(first).alias("f"))
    pairs = ask.join(told, ["p", "f"]).where("q <> k").select("q", "k").distinct()
    both = pairs.join(wanted.select(F.col("fingerprint_key").alias("q"), F.col("_s").alias("_a")), "q").join(held.select(F.col("fingerprint_key").alias("k"), F.col("_s").alias("_b")), "k")
    found = both.select(F.col("q").alias("fingerprint_key"), F.col("k").alias("near_key"), likeness(F.col("_a"), F.col("_b"), least).alias("likeness")).where(F.col("likeness") >= least - 1e-9)
    return found, members.select("doc_id", "fingerprint_key")


def printed(signs: Column) -> Column:
    return F.array_join(signs.cast("array<string>"), ",")


def fingerprinted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with fingerprint (text of the ascending signatures) and n_signatures."""
    docs = docs.drop("fingerprint", "n_signatures").withColumn("_s", signatures(F.col(text)))
    return docs.withColumns({"fingerprint": printed(F.col("_s")), "n_signatures": F.size("_s")}).drop("_s")


def edited(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, text, signs, edited, edited_signs, next_signs.

    The texts are dealt once. The first document of each range also goes, as a ghost, to the end of the
    range before it in descending order, so each text meets the next one in its own range.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"o": F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)), "key": F.md5("text")})
    order = cut(rows.select("o", "key"))
    bounds = range_bounds(order, "o", order.count() // RANGE_ROWS)
    firsts = order.groupBy(range_of(F.col("o"), bounds).alias("r")).agg(F.max(F.struct("o", "key")).alias("f")).orderBy(F.col("r").desc()).collect()  # a row per range
    told = [(x["f"]["o"], x["f"]["key"], firsts[k - 1]["r"]) for k, x in enumerate(firsts)]
    ghosts = F.broadcast(docs.sparkSession.createDataFrame(told, "_o long, _key string, _to int"))
    dealt = rows.withColumn("_range", range_of(F.col("o"), bounds)).join(ghosts, (F.col("o") == F.col("_o")) & (F.col("key") == F.col("_key")), "left")
    places = F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("ghost")))).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("ghost")), F.struct(F.col("_to").alias("r"), F.lit(True).alias("ghost"))))
    dealt = dealt.select("doc_id", "text", "o", "key", F.explode(places).alias("_p")).select("doc_id", "text", "o", "key", "_p.r", "_p.ghost")
    dealt = dealt.repartition("r").withColumn("signs", signatures(F.col("text")))
    by = Window.partitionBy("r").orderBy(F.col("ghost"), F.col("o").desc(), F.col("key").desc())
    found = dealt.withColumns({"next_text": F.lead("text").over(by), "next_signs": F.lead("signs").over(by)}).where(~F.col("ghost"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.char_length("text") - half)
    found = found.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), half)))
    return found.withColumn("edited_signs", signatures(F.col("edited"))).select("doc_id", "text", "signs", "edited", "edited_signs", "next_signs")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), printed(F.col("signs")).alias("fingerprint"), printed(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"), likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )
