"""Column expressions over words and lines: all of them stay in the JVM.

Lengths that decide an ending count bytes, as the lexicon's do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions import words
from lexiloom.functions.lexicon import FILLERS, LISTED, TAGS, is_closed

ABSTRACT = tuple(words.ABSTRACT.split())


def _cut(word: Column, n: int) -> Column:
    return F.left(word, F.char_length(word) - n)


def stem(word: Column) -> Column:
    """Without the first of -ing, -ed, -es, -s that leaves 3 bytes."""
    found = word
    for end in ("s", "es", "ed", "ing"):
        found = F.when(F.endswith(word, F.lit(end)) & (F.octet_length(word) >= len(end) + 3), _cut(word, len(end))).otherwise(found)
    return found


def is_abstract(word: Column) -> Column:
    found = F.lit(False)
    for end in ABSTRACT:
        found = found | (F.endswith(word, F.lit(end)) & (F.octet_length(word) > len(end) + 2))
    return found


def bears_content(key: Column) -> Column:
    closed = [w for w in LISTED if is_closed(w)]
    return (F.octet_length(key) >= 3) & key.rlike(r"^\p{L}+$") & ~key.isin(*closed, *sorted(FILLERS))


def marked(word: Column) -> Column:
    """With the ending of a plural or a third person."""
    hard = word.rlike("[^aeiou].$")
    return (
        F.when(word == "", F.lit(None))
        .when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .when(word.endswith("y") & hard, F.concat(_cut(word, 1), F.lit("ies")))
        .when(word.endswith("o") & hard, F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def unmarked(word: Column) -> Column:
    """The stem whose marked spelling is the word; null if there is none."""
    tried = []
    for end, tail in (("ies", "y"), ("es", ""), ("s", "")):
        s = F.concat(_cut(word, len(end)), F.lit(tail))
        tried.append(F.when(word.endswith(end) & (marked(s) == word), s))
    return F.coalesce(*tried)


def bare(word: Column) -> Column:
    s = _cut(word, 2)
    return F.when(word.endswith("ed") & (s != "") & ~s.rlike(r"([^aeiou])\1$"), s)


def readings_by_ending(key: Column, capitalised: Column) -> Column:
    """Tag names that an ending allows, likeliest first."""
    size = F.octet_length(key)
    none = F.array().cast("array<string>")

    def given(when: Column, *tags: str) -> Column:
        return F.when(when, F.array(*map(F.lit, tags))).otherwise(none)

    ends = lambda *e: F.greatest(*(F.endswith(key, F.lit(x)) for x in e)) if len(e) > 1 else F.endswith(key, F.lit(e[0]))
    loose = key.rlike("eed$") & (size >= 4)
    plural = key.rlike("[^s]s$") & (size >= 3)
    first = F.concat(
        given(capitalised, "name.s"), given(ends("ing") & (size >= 6), "verb.ger"), given(ends("ed") & (size >= 4), "verb.past", "verb.part"), given(ends("ly") & (size >= 5), "adv"),
        given(ends("ness", "tion", "ment", "ity"), "noun.s"), given(ends("ous", "ful", "ive", "able", "ic", "less"), "adj"),
        given(F.when(ends("er"), size >= 5).otherwise(ends("est") & (size >= 6)), "adj"), given(ends("wise") & (size >= 7), "adv"), given(plural, "noun.p", "verb.third"), given(plural & key.rlike("[ui]s$"), "noun.s"),
    )
    first = F.when(capitalised, F.filter(first, lambda t: ~F.startswith(t, F.lit("noun")))).otherwise(first)
    placed = F.exists(first, lambda t: F.startswith(t, F.lit("verb")) | (t == "noun.p")) & ~loose
    found = F.concat(first, given((size >= 2) & ~placed, "noun.s", "verb.base"))
    return F.when(key.rlike("[aeiouy]"), F.array_distinct(found)).otherwise(none)


def lexicon_rows() -> list[tuple[str, list[str], bool]]:
    """word, its listed readings (ranked, repeats kept), and whether it belongs to a closed class."""
    return [(w, [TAGS[t] for t in tags], is_closed(w)) for w, tags in LISTED.items()]


def identifier_words(name: Column) -> Column:
    """An identifier's words, lower-cased and joined by spaces: snake, kebab and camel; runs of capitals stay whole."""
    apart = F.regexp_replace(F.regexp_replace(name, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), "[_-]+", " ")
    return F.trim(F.translate(apart, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def declared_words(line: Column) -> Column:
    """Leading words of a line up to its first other punctuation."""
    return F.regexp_extract_all(F.regexp_extract(line, r"^([\p{L}\p{N}_$\s]*)", 1), F.lit(r"[\p{L}\p{N}_$]+"), F.lit(0))


def uncommented(line: Column) -> Column:
    """What a comment line says, without its marks and a leading @tag; null if it is no comment."""
    line = F.trim(line)
    opened = line.rlike(r"^(///|//!|//|/\*\*|/\*|\*/|#|<!--|--|\*( |$))")
    rest = F.regexp_replace(line, r"^(?:///|//!|//|/\*\*|/\*|\*/|#|<!--|--|\*(?= |$))", "")
    rest = F.trim(F.regexp_replace(F.regexp_replace(rest, r"(?:-->)+$", ""), r"(?:\*/)+$", ""))
    rest = F.when(rest.startswith("@"), F.when(rest.rlike(r"\s"), F.regexp_replace(rest, r"^@\S*\s", "")).otherwise("")).otherwise(rest)
    return F.when(opened, F.trim(rest))
