"""Wasteful phrases over whole tables, inside the JVM: a line without any of them costs one pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.style import LENGTHS, PHRASES

WORD = r"[\p{L}\p{N}'-]+|[^\s*\\#~|]"
ANY = "|".join(re.escape(" ".join(p)).replace("\\ ", r"\s+") for p in PHRASES)
HIT = "struct<start:int,phrase:string>"


def phrases_in(line: Column) -> Column:
    """(start word, phrase) of the phrases in a line, leftmost first and none inside another."""
    words = F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))
    known = F.create_map(*(F.lit(x) for p in PHRASES for x in (" ".join(p), True)))

    def at(k: Column) -> Column:
        tried = [F.array_join(F.slice(words, k + 1, F.lit(n)), " ") for n in LENGTHS]
        return F.coalesce(*(F.when(F.try_element_at(known, t), t) for t in tried))

    hits = F.filter(F.transform(words, lambda _, k: F.struct(k.alias("start"), at(k).alias("phrase"))), lambda h: h["phrase"].isNotNull())
    start = F.struct(F.lit(0).alias("free"), F.array().cast(f"array<{HIT}>").alias("kept"))

    def step(done: Column, h: Column) -> Column:
        end = h["start"] + F.size(F.split(h["phrase"], " "))
        more = F.array(F.struct(h["start"].alias("start"), h["phrase"].alias("phrase"))).cast(f"array<{HIT}>")
        free = h["start"] >= done["free"]
        return F.struct(F.when(free, end).otherwise(done["free"]).alias("free"), F.when(free, F.concat(done["kept"], more)).otherwise(done["kept"]).alias("kept"))

    found = F.aggregate(hits, start, step, lambda done: done["kept"])
    return F.when(line.rlike(f"(?i){ANY}"), found).otherwise(F.array().cast(f"array<{HIT}>"))


def phrase_notes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """line_no, start (word of the line), phrase, flaw, instead of every wasteful phrase."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    hits = lines.select(key, "line_no", F.explode(phrases_in(F.col("line"))).alias("h")).select(key, "line_no", "h.start", "h.phrase")
    told = docs.sparkSession.createDataFrame([(" ".join(p), f, i) for p, (i, f) in PHRASES.items()], "p string, flaw string, instead string")  # 62 rows, fixed
    return hits.join(F.broadcast(told), F.col("phrase") == F.col("p")).drop("p")
