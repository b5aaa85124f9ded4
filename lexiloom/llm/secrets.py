"""Secret scan: fixed patterns, and a battery of randomness tests for what they miss (DataFrame functions only).

Base spans: assign (a password, token or key that is assigned), access (AKIA...) and hex (16 digits or
more). All other tokens are candidates, of any length and of any characters. The narrowest
encoding whose alphabet holds a candidate is inferred (hex, upper hex, base32, base36, base62, base64), and
three tests are made of it: chi-squared uniformity over that alphabet, runs of character classes, and serial
correlation of neighbours. Their probabilities are combined twice, by Fisher's method:

- under a random string of the alphabet (each test two-sided): the combined one must be ``GATE`` at least;
- under a text-like string (each test one-sided, towards randomness): the chi-squared sum over the alphabet's
  letters against what the letter frequencies of English give, the runs against a fixed rate of changes of
  class, and the correlation of neighbours (of being a vowel) against the alternation of speech. A correlation
  above 0, that of a random string, counts as 0. The combined one is the evidence that is weighed below.

Short strings give weak evidence, so the false discovery rate is controlled within classes of length: the
candidates of the whole corpus are counted by class and size of probability (a histogram of bounded size),
Benjamini and Hochberg's rule gives a bound per class, and candidates below it become spans of kind random.
No bound is looser than the rate itself, and the best evidence that a token can give follows from its length
and its runs of one character class. Tokens whose best evidence is short of the rate (most words, and all of
under four characters at a rate of 0.01) can be no discovery: they are counted in their class, untested.

Defined results: a null text counts as empty; offsets are code points, end exclusive; a token that
overlaps a base span is no candidate; equal starts are ordered by kind as listed; repeated rows have equal
spans and count each in the rate; very long texts are read whole, in time that grows with their length; the
three private characters U+E000 to U+E002 in a text count as some other mark; an empty table gives no rows;
other columns are kept by ``find_secrets``, and those with the names of its results replaced.
"""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.session import cut, table

NAME = "op1_secret_scan"
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters or more
HEX = r"[0-9a-f]{16,}"
#: Cheap to look for; a text without these has no match.
MAYBE = r"(?i:passw|secret|token|api_?key)"
LETTER = "A-Za-z0-9+/_-"
RUN = "(?:[0-9]++|[a-z]++|[A-Z]++|[+/_-]++)"
RATE, GATE = 0.01, 1e-4
#: Changes of class, and correlation of being a vowel, between neighbours in text-like tokens.
CHANGES, ALTERNATION = 0.2, -0.3
#: Bins of -log10 of the probability, ten to a unit; length classes are powers of two.
BINS_PER_UNIT, BINS, CLASSES = 10, 400, 20
#: Relative frequencies of a to z in English, in percent.
ENGLISH = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: From the narrowest on. The last two share the rest: letters of both, with the marks as they occur.
ALPHABETS = (
    ("^[0-9a-f]+$", DIGITS + "abcdef"), ("^[0-9A-F]+$", DIGITS + "ABCDEF"), ("^[A-Z2-7]+$", LOWER.upper() + "234567"), ("^[0-9a-z]+$", DIGITS + LOWER), ("^[0-9A-Z]+$", DIGITS + LOWER.upper()),
    ("^[0-9A-Za-z]+$", DIGITS + LOWER.upper() + LOWER), ("^[0-9A-Za-z+/]+$", DIGITS + LOWER.upper() + LOWER + "+/"), (".", DIGITS + LOWER.upper() + LOWER + "_-"),
)
SPAN = "struct<start:int,rank:int,end:int,kind:string>"
#: Private characters that set off a match and stand for what base spans cover, and what replaces them in a text.
OPEN, SHUT, COVER, OTHER = "\ue000", "\ue001", "\ue002", "\ue003"
BLOCK = 32


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(sizes: Column, depth: int = 2) -> Column:
    """The sums before each element of an array that isn't empty, by blocks: no array that is appended to gets long."""
    more = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    plain = lambda some: F.aggregate(some, F.array(F.lit(0)), more)
    if not depth:
        return bound(plain(sizes), lambda sums: F.slice(sums, F.lit(1), F.size(sums) - 1))

    def joined_blocks(blocks: Column) -> Column:
        ahead = running(F.transform(blocks, lambda x: F.element_at(x, -1)), depth - 1)
        return F.flatten(F.zip_with(blocks, ahead, lambda block, at: F.transform(F.slice(block, F.lit(1), F.size(block) - 1), lambda x: x + at)))

    def cut_up(some: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(some) - 1) / BLOCK).cast("int"))
        return bound(F.transform(starts, lambda k: plain(F.slice(some, k * BLOCK + 1, F.lit(BLOCK)))), joined_blocks)

    return bound(sizes, cut_up)


def pieces(text: Column, pattern: str) -> Column:
    """What stands before, in and between the matches of a pattern, and after the last: matches are every second one."""
    return F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{SHUT}"), f"[{OPEN}{SHUT}]")


def found_at(text: Column, pattern: str) -> Column:
    """Matches of a pattern (never empty) in a text without private characters: array of (start, end, hit)."""

    def placed(parts: Column) -> Column:
        starts = running(F.transform(parts, lambda p: F.char_length(p)))
        each = F.zip_with(parts, starts, lambda p, at: F.struct(at.alias("start"), (at + F.char_length(p)).alias("end"), p.alias("hit")))
        return F.filter(each, lambda _, k: k % 2 == 1)

    return bound(pieces(text, pattern), placed)


@functools.lru_cache
def needed_runs(rate: float) -> list[int]:
    """For lengths from 0 on, the fewest runs of one character class with which a token could give evidence of the rate.

    The last holds for all greater lengths, too, and is 1; more runs than characters: no token could.
    """
    least = -math.log10(rate) - 0.02  # lower_tail is an approximation
    normal, even, found = NormalDist().cdf, 1.0, []

    def part(m: int) -> tuple[float, float]:
        """For m letters of one case: how far below text the most even use of them is, and the variance."""
        each, more = divmod(m, 26)
        return more * (each + 1) ** 2 + (26 - more) * each**2 - text_mean(m), text_variance(m)

    for n in range(1000):
        for m in range(n // 2 + 1):  # n letters, as evenly dealt as can be, m of them of the other case
            (low, spread), (low2, spread2) = part(m), part(n - m)
            even = min(even, normal((low + low2) / math.sqrt(max(spread + spread2, 1.0))) if n > 1 else 1.0)
        serial = 1 - normal(-ALTERNATION * math.sqrt(n - 1)) if n > 3 else 1.0
        runs = 1
        while runs <= n:
            changes = 1 - normal((runs - 1 - (n - 1) * CHANGES - 0.5) / math.sqrt((n - 1) * CHANGES * (1 - CHANGES))) if n > 1 else 1.0
            fisher = sum(-math.log(max(p, 1e-18)) for p in (even, changes, serial))
            if (fisher - math.log(1 + fisher + fisher**2 / 2)) / math.log(10) >= least:
                break
            runs += 1
        found.append(runs)
        if n and runs == 1:
            return found
    raise ValueError(f"no token gives evidence of a rate of {rate}")


_Q = [x / sum(ENGLISH) for x in ENGLISH]
Q2, Q3 = sum(x**2 for x in _Q), sum(x**3 for x in _Q)


def text_mean(m):
    """Of the sum of squared counts of m letters of a text (a number or a column)."""
    return m * (m - 1) * Q2 + m


def text_variance(m):
    return 2 * m * (m - 1) * Q2 + 4 * m * m * m * (Q3 - Q2**2)


@functools.lru_cache
def candidate(rate: float) -> str:
    """A pattern for the tokens that could be discoveries, none of which touches what is covered."""
    need = needed_runs(rate)
    longest, beside = len(need) - 1, f"[{COVER}{LETTER}]"
    word = min((n for n, r in enumerate(need) if 2 < n and r < 3), default=longest) - 1
    some = [rf"(?={RUN}{{{r}}})[{LETTER}]{{{n}}}(?!{beside})" for n, r in enumerate(need[:-1]) if 0 < n and r <= n]
    return rf"(?<!{beside})(?![A-Z]?+[a-z]{{0,{word - 1}}}+(?!{beside}))(?:{'|'.join([rf'[{LETTER}]{{{longest},}}+(?!{COVER})', *some])})"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


BARE = ASSIGN.replace("((?i:", "(?i:").replace("key))", "key)").replace("([A-Za-z0-9+/_.=-]+)", "[A-Za-z0-9+/_.=-]+")


def _assigned(hit: Column) -> Column:
    return F.char_length(F.regexp_extract(hit, ASSIGN, 2)) >= 12


def base_spans(text: Column) -> Column:
    """array of (start, rank, end, kind), in order."""

    def spans(kind: str, hits: Column) -> Column:
        rank = KINDS.index(kind)
        return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))).cast(f"array<{SPAN}>")

    parts = [
        F.when(text.rlike(MAYBE), spans("assign", F.filter(found_at(text, BARE), lambda x: _assigned(x["hit"])))).otherwise(_none(SPAN)),
        F.when(text.contains("AKIA"), spans("access", found_at(text, ACCESS))).otherwise(_none(SPAN)),
        F.when(text.rlike(HEX), spans("hex", found_at(text, HEX))).otherwise(_none(SPAN)),
    ]
    return F.array_sort(F.concat(*parts))


def uncovered(text: Column) -> Column:
    """text with every character of a base span replaced by COVER.

    What is left of a run of digits or capitals that an assignment covers in part touches a COVER, so whether
    it is covered, too, makes no difference to the tokens that do not.
    """
    parts = F.transform(pieces(text, BARE), lambda p, k: F.when((k % 2 == 1) & _assigned(p), F.repeat(F.lit(COVER), F.char_length(p))).otherwise(p))
    text = F.when(text.rlike(MAYBE), F.array_join(parts, "")).otherwise(text)
    for found, letter in ((r"AKIA[A-Z0-9]{14}", "[A-Z0-9]"), ("[0-9a-f]{16}", "[0-9a-f]")):  # each character of a run that begins so
        text = F.regexp_replace(text, rf"(?:(?={found})|(?!\A)\G){letter}", COVER)
    return text


def lower_tail(z: Column) -> Column:
    """The normal distribution function (a published rational approximation), within 8 deviations."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) * 0.3989422804 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z < 0, tail).otherwise(1 - tail)


def log10_of_three(x: Column) -> Column:
    """-log10 of the combined probability of three, from the sum of their -ln (Fisher's method)."""
    return (x - F.log(1 + x + x * x / 2)) / math.log(10)


def tested(hits: Column) -> Column:
    """(start, end, hit) to (start, end, even: no test speaks against a random string, bin: the evidence, length class)."""
    alphabet = lambda s: F.coalesce(*(F.when(s.rlike(p), F.lit(a)) for p, a in ALPHABETS))
    count = lambda s, c: (F.char_length(s) - F.char_length(F.replace(s, c, F.lit("")))).cast("double")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    letters = lambda s: F.split(s, "")
    count_of = lambda s, pattern: F.regexp_count(s, F.lit(pattern)).cast("double")

    def numbers(x: Column) -> Column:
        s, a = x["hit"], x["a"]
        squares = F.transform(letters(a), lambda c: F.struct(F.pow(count(s, c), F.lit(2.0)).alias("v"), c.rlike("[A-Za-z]").alias("letter")))
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"),
            F.char_length(s).cast("double").alias("n"), F.char_length(a).cast("double").alias("k"), squares.alias("squares"),
            F.size(F.array_remove(F.regexp_extract_all(s, F.lit("[0-9]+|[a-z]+|[A-Z]+|[^0-9A-Za-z]+"), F.lit(0)), "")).cast("double").alias("runs"),
            F.transform(letters(s), lambda c: F.position(c, a).cast("double")).alias("index"),
            F.transform(letters(F.regexp_replace(s, "[^A-Za-z]", "")), lambda c: c.rlike("(?i)[aeiou]").cast("double")).alias("vowel"),
            F.array(count_of(s, "[0-9]"), count_of(s, "[a-z]"), count_of(s, "[A-Z]"), count_of(s, "[^0-9A-Za-z]")).alias("class"),
        )

    around = lambda values: bound(total(values) / F.size(values), lambda mean: F.transform(values, lambda v: v - mean))

    def sums(x: Column) -> Column:
        squares = total(F.transform(x["squares"], lambda q: q["v"])), total(F.transform(x["squares"], lambda q: F.when(q["letter"], q["v"]).otherwise(0.0)))
        return F.struct(*(x[c].alias(c) for c in ("start", "end", "n", "k", "runs", "class")), squares[0].alias("squares"), squares[1].alias("lettered"), around(x["index"]).alias("index"), around(x["vowel"]).alias("vowel"))

    def beside(values: Column) -> Column:
        """Correlation of neighbours; null if all are equal."""
        spread, m = total(F.transform(values, lambda v: v * v)), F.size(values) - 1
        return F.when(spread > 1e-9, total(F.zip_with(F.slice(values, F.lit(1), m), F.slice(values, F.lit(2), m), lambda a, b: a * b)) / spread)

    # One step for what later ones use more than once: an expression is worked out wherever it stands.
    def deviations(x: Column) -> Column:
        n, k = x["n"], x["k"]
        lower, upper = x["class"][1], x["class"][2]
        free = k - 1
        same = total(F.transform(x["class"], lambda c: c * (c - 1))) / (n * (n - 1))
        apart = x["lettered"] - text_mean(lower) - text_mean(upper)
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), n.alias("n"), (lower + upper).alias("m"), x["runs"].alias("runs"), same.alias("same"),
            ((F.pow((k / n * x["squares"] - n) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))).alias("chi"),
            beside(x["index"]).alias("index"), beside(x["vowel"]).alias("vowel"), (apart / F.sqrt(F.greatest(text_variance(lower) + text_variance(upper), F.lit(1.0)))).alias("text_chi"),
        )

    def tails(x: Column) -> Column:
        """Each test's deviation, below 0: under a random string, then under a text-like one."""
        n, m, same = x["n"], x["m"], x["same"]
        runs = (x["runs"] - 1 - (n - 1) * (1 - same)) / F.sqrt(F.greatest((n - 1) * same * (1 - same), F.lit(1.0)))
        text_runs = (x["runs"] - 1 - (n - 1) * CHANGES - 0.5) / F.sqrt((n - 1) * CHANGES * (1 - CHANGES))
        alternates = (ALTERNATION - F.least(F.coalesce(x["vowel"], F.lit(-1.0)), F.lit(0.0))) * F.sqrt(m - 1)
        random = F.array(-F.abs(x["chi"]), -F.abs(runs), -F.abs(F.coalesce(x["index"] * F.sqrt(n), F.lit(99.0))))
        text = F.array(F.when(m > 1, x["text_chi"]).otherwise(8.0), -text_runs, F.when(m > 3, alternates).otherwise(8.0))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), n.alias("n"), random.alias("random"), text.alias("text"))

    def combined(x: Column) -> Column:
        """The sums of -ln of the probabilities; two-sided ones for the random string."""
        logs = lambda some, sides: total(F.transform(some, lambda z: -F.log(F.greatest(sides * lower_tail(z), F.lit(1e-18)))))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["n"].alias("n"), logs(x["random"], 2).alias("random"), logs(x["text"], 1).alias("text"))

    def judged(x: Column) -> Column:
        even = log10_of_three(x["random"]) <= -math.log10(GATE)
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), even.alias("even"),
            F.when(even, F.least(F.floor(F.greatest(log10_of_three(x["text"]), F.lit(0.0)) * BINS_PER_UNIT), F.lit(BINS - 1))).otherwise(0).cast("int").alias("bin"),
            F.least(F.floor(F.log2(x["n"])), F.lit(CLASSES - 1)).cast("int").alias("class"),
        )

    found = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), alphabet(x["hit"]).alias("a")))
    for step in (numbers, sums, deviations, tails, combined, judged):
        found = F.transform(found, step)
    return found


TESTED = "struct<start:int,end:int,even:boolean,bin:int,class:int>"


def examined(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """docs with _base, _candidates, and _plain: how many tokens of each class of length were left untested."""
    value = F.coalesce(F.col(text), F.lit(""))
    private = OPEN + SHUT + COVER
    rows = docs.withColumn("_text", F.when(value.rlike(f"[{private}]"), F.translate(value, private, OTHER * 3)).otherwise(value))
    rows = rows.withColumn("_base", base_spans(F.col("_text")))
    rows = rows.withColumn("_text", F.when(F.size("_base") > 0, uncovered(F.col("_text"))).otherwise(F.col("_text")))
    pattern, longest = candidate(rate), len(needed_runs(rate)) - 1
    beside, said = f"[{COVER}{LETTER}]", F.col("_text")

    def plain(k: int) -> Column:
        if 2**k >= longest:
            return F.lit(0)
        tokens = rf"(?<!{beside})[{LETTER}]{{{2**k},{2 ** (k + 1) - 1}}}(?!{beside})"
        return F.regexp_count(said, F.lit(tokens)) - F.size(F.filter("_hits", lambda x: F.length(x["hit"]).between(2**k, 2 ** (k + 1) - 1)))

    rows = rows.withColumn("_hits", F.when(said.rlike(pattern), found_at(said, pattern)).otherwise(_none("struct<start:int,end:int,hit:string>")))
    rows = rows.withColumn("_candidates", F.when(F.size("_hits") > 0, tested(F.col("_hits")).cast(f"array<{TESTED}>")).otherwise(_none(TESTED)))
    return rows.withColumn("_plain", F.array(*map(plain, range(CLASSES)))).drop("_hits", "_text")


def bounds(rows: DataFrame, rate: float = RATE) -> dict[int, int]:
    """The lowest bin whose candidates are discoveries, per class of length (Benjamini and Hochberg)."""
    hist = rows.select(F.explode("_candidates").alias("c")).groupBy("c.class", "c.bin").count().collect()  # CLASSES x BINS rows at most
    plain = rows.select(F.posexplode("_plain").alias("class", "n")).groupBy("class").agg(F.sum("n").alias("n")).collect() if "_plain" in rows.columns else []  # CLASSES rows at most
    untested = {r["class"]: r["n"] for r in plain}
    found = {}
    for k in {r["class"] for r in hist}:
        counts = {r["bin"]: r["count"] for r in hist if r["class"] == k}
        every, above = sum(counts.values()) + untested.get(k, 0), 0
        for b in sorted(counts, reverse=True):
            above += counts[b]
            if b and 10 ** (-b / BINS_PER_UNIT) * every <= rate * above:
                found[k] = b
    return found


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """docs with spans. Texts are examined twice: once for the corpus's bounds, once for the result."""
    docs = docs.drop("spans", "_base", "_candidates", "_plain", "_hits", "_text")
    return with_bounds(examined(docs, rate=rate), bounds(examined(docs.select("text"), rate=rate), rate))


def with_bounds(rows: DataFrame, least: dict[int, int]) -> DataFrame:
    """examined rows with spans: start, rank, end, kind."""
    bound = F.create_map(*(F.lit(x) for k in range(CLASSES) for x in (k, least.get(k, BINS))))
    random = F.filter("_candidates", lambda c: c["even"] & (c["bin"] >= bound[c["class"]]))
    more = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["end"].alias("end"), F.lit("random").alias("kind"))).cast(f"array<{SPAN}>")
    return rows.withColumn("spans", F.array_sort(F.concat("_base", more))).drop("_base", "_candidates", "_plain")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = cut(examined(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    rows = with_bounds(slim, bounds(slim))
    base = F.filter("spans", lambda x: x["rank"] < 3)
    number = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(number, KINDS[:3]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
