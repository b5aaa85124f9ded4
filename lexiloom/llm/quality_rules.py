"""Quality rules with risk-controlled cutoffs.

The base rules are fixed: fewer than 10 words, or over a fifth of the words in repeated 5-word windows.
Each further rule rejects a document if a ratio of its text reaches a cutoff. The cutoffs are chosen, per
stratum (lang), on labelled documents that pass the base rules, and nothing is fitted besides, so all of
these are holdout:

- a cutoff is allowed if the exact binomial test rejects "it rejects more than its share of ``limit``
  of the good documents": P(X <= k) <= delta / (strata x rules), for k false rejections among n good ones;
- cutoffs are tested from the highest down and the first failure ends that (fixed-sequence testing needs
  no correction within a rule); Bonferroni covers the strata and rules. So, with probability 1 - delta, in
  no stratum do the rules together reject more than ``limit`` of the good documents;
- of the allowed ones, the cutoff that best parts bad from good is taken, in the middle of its equals.

All labelled rows count: their ratios are summed into a histogram per stratum and rule (map-side first).
A stratum with too few good labels gets no cutoffs.

Defined results: a null text has no words (base_failed); a null lang is a stratum of its own, apart from the empty string; labels that
are null, or of unknown documents, are ignored, and repeated ones count each; repeated rows are each
judged alike; very long texts are read whole; empty tables give empty results or no cutoffs; other columns
are kept by ``judged``, and those with the names of its results replaced.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.textstats import COUNTS, counted
from lexiloom.session import cut, table

NAME = "op4_quality_rules"
LIMIT, DELTA = 0.05, 0.05
#: Ratio of each rule, over the counts of a text (the higher, the worse), and its share of the limit.
RULES = {"symbols": ("n_symbols", "n_words"), "upper": ("n_upper", "n_letters"), "dup_lines": ("n_dup_lines", "n_lines")}
SHARES = {"symbols": 0.4, "upper": 0.4, "dup_lines": 0.2}
CUTOFFS = tuple(round(0.01 * 1.1**k, 4) for k in range(60))
BROADCAST_STRATA = 10_000
PREFIX = "_t_"


def ratio(rule: str) -> Column:
    over, under = (F.col(PREFIX + x) for x in RULES[rule])
    return F.when(under > 0, over / under).otherwise(0.0)


def base_failed() -> Column:
    words, repeat = F.col(PREFIX + "n_words"), F.col(PREFIX + "n_repeat_words")
    return (words < 10) | (100 * repeat > 20 * words)


def binomial_below(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p): the regularized incomplete beta I_{1-p}(n-k, k+1)."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1.0 - p
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_part(b, a, 1.0 - x)
    return _beta_part(a, b, x)


def _beta_part(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularized incomplete beta function (for x below its mean)."""
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / (c if abs(c) > tiny else tiny)
            value *= (step := c * d)
        if abs(step - 1.0) < 1e-12:
            break
    return front * value


def chosen_cutoff(hist: pd.DataFrame, risk: float, level: float) -> float:
    """hist: bin (cutoffs reached), good, bad. The cutoff taken, infinite if none is allowed."""
    good = [0] * (len(CUTOFFS) + 1)
    bad = [0] * (len(CUTOFFS) + 1)
    for k, g, b in zip(hist["bin"], hist["good"], hist["bad"], strict=True):
        good[k] += g
        bad[k] += b
    n, all_bad = sum(good), sum(bad)
    best, equals, k, caught = 0.0, [], 0, 0
    for at in range(len(CUTOFFS), 0, -1):  # the bin at holds ratios from cutoff at - 1 on
        k, caught = k + good[at], caught + bad[at]
        if not n or binomial_below(k, n, risk) > level:
            break
        gain = caught / max(all_bad, 1) - k / n
        if gain > best + 1e-12:
            best, equals = gain, [at]
        elif equals and abs(gain - best) <= 1e-12:
            equals.append(at)
    return CUTOFFS[equals[len(equals) // 2] - 1] if equals else math.inf


def cutoffs(rows: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """rows: doc_id, lang and the counts. A row per stratum with a labelled document: stratum, and a cutoff for each rule."""
    reached = lambda r: F.aggregate(F.array(*map(F.lit, CUTOFFS)), F.lit(0), lambda n, c: n + (ratio(r) >= c).cast("int"))
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), "quality")
    tried = rows.where(~base_failed()).withColumn("_stratum", F.col("lang")).join(known, F.col("doc_id") == F.col("_id"))
    each = tried.select("_stratum", "quality", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), reached(r).alias("bin")) for r in RULES))).alias("x"))
    hist = each.groupBy("_stratum", "x.rule", "x.bin").agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") == 0).cast("long")).alias("bad"))
    hist = cut(hist)
    strata = max(1, hist.select("_stratum").distinct().count())

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        found = {r: chosen_cutoff(part[part["rule"] == r], limit * SHARES[r], delta / (strata * len(RULES))) for r in RULES}
        return pd.DataFrame([{"stratum": part["_stratum"].iloc[0], **found}])

    return cut(hist.groupBy("_stratum").applyInPandas(choose, "stratum string, " + ", ".join(f"{r} double" for r in RULES)))


def verdict(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """rows (lang and the counts) with base_failed and kept."""
    if chosen.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA:
        chosen = F.broadcast(chosen)
    chosen = chosen.select(F.col("stratum").alias("_stratum"), *(F.col(r).alias(f"_c_{r}") for r in RULES))
    found = rows.join(chosen, F.col("lang").eqNullSafe(F.col("_stratum")), "left")
    passed = ~base_failed()
    for r in RULES:
        passed = passed & (ratio(r) < F.coalesce(f"_c_{r}", F.lit(math.inf)))
    return found.withColumns({"base_failed": base_failed(), "kept": passed}).drop("_stratum", *(f"_c_{r}" for r in RULES))


def judged(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """docs with the counts, base_failed and kept. The texts are counted twice, and never shuffled."""
    chosen = cutoffs(counted(docs, ["doc_id", "lang"], prefix=PREFIX), labels, limit, delta)
    docs = docs.drop(*COUNTS[:5], "base_failed", "kept")
    rows = verdict(counted(docs, docs.columns, prefix=PREFIX), chosen)
    return rows.withColumnsRenamed({PREFIX + x: x for x in COUNTS[:5]}).drop(*(PREFIX + x for x in COUNTS[5:]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = cut(counted(table(spark, sf_dir, "documents"), ["doc_id", "lang"], prefix=PREFIX))
    rows = verdict(slim, cutoffs(slim, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", F.col(PREFIX + "n_words").alias("n_words"), *(F.col(PREFIX + x).alias(x) for x in COUNTS[1:5]), "base_failed", "kept")
