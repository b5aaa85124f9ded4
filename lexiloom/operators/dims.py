"""The engine's fixed dimensions as tables: small, and the same for every corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.functions import grammar, judge, lexicon, style
from lexiloom.functions.columns import lexicon_rows
from lexiloom.functions.lexicon import KIND, NOMINAL, NUMBER, TAGS, TENSED

#: What each rule, flaw and convention asks, in one line.
RULE_SAYS = {
    "DeterminerNumber": "a determiner and its noun must agree in number",
    "DeterminerTarget": "a determiner must introduce a noun phrase",
    "SubjectVerb": "a tensed verb must agree with its subject",
    "ModalTakesBase": "a modal is followed by the plain form of a verb",
    "ToTakesBase": "infinitival to is followed by the plain form of a verb",
    "PrepositionTarget": "a preposition is followed by a noun phrase",
    "DoubledTense": "two tensed verbs cannot be adjacent",
    "StrandedParticiple": "a participle needs an auxiliary before it",
    "PronounIsWhole": "a pronoun cannot have a noun attached to it",
    "AttributiveSingular": "a noun modifying another noun takes the singular",
    "Subjectless": "a tensed verb needs a subject",
    "NoPredicate": "a sentence needs a tensed verb",
    "Unmarked": "a sentence opens with a capital and closes with a mark",
    "Unapostrophed": "a contraction is spelled with an apostrophe",
}
FLAW_SAYS = {
    "redundant": "this says the same thing twice", "roundabout": "a shorter connective says this", "delayed": "this delays the subject", "buried": "the verb is hidden inside a noun",
    "filler": "this qualifier changes nothing", "worn": "this phrase is worn smooth and carries no content", "echo": "this word was just used",
}
CONVENTION_SAYS = {
    "predicate": "every sentence has a tensed verb", "marks": "every sentence opens with a capital and closes with a mark", "apostrophes": "contractions are spelled with an apostrophe",
    "fresh": "a word is not repeated close to itself", "plain": "no filler and no worn phrase",
}


def tags(spark: SparkSession) -> DataFrame:
    rows = [(k, t, KIND[k], NUMBER[k] or None, k in NOMINAL, k in TENSED) for k, t in enumerate(TAGS)]
    return spark.createDataFrame(rows, "tag_id int, tag string, kind string, number string, nominal boolean, tensed boolean")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, r, RULE_SAYS[r]) for k, r in enumerate(grammar.RULES)], "rule_id int, rule string, says string")


def frames(spark: SparkSession) -> DataFrame:
    """Every frame that can be reached, by number."""
    rows = [(k, f.subject, f.tensed, list(map(int, f.outer)) if f.outer else None, f.ever, f.read, f.aside, f.phrase, f.wants) for k, f in enumerate(grammar.frames()[0])]
    return spark.createDataFrame(rows, "frame_id int, subject int, tensed boolean, outer array<int>, ever boolean, read boolean, aside boolean, phrase int, wants int")


def pairs(spark: SparkSession) -> DataFrame:
    """left, right, rule, friction (in quarters) of any two tags beside each other."""
    rows = [(TAGS[a], TAGS[b], None if (r := grammar.pair_rule(a, b)) is None else grammar.RULES[r], grammar.friction(a, b) / 20) for a in range(len(TAGS)) for b in range(len(TAGS))]
    return spark.createDataFrame(rows, "left string, right string, rule string, friction double")


def flaws(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, s, "fresh" if f == "echo" else "plain") for f, s in FLAW_SAYS.items()], "flaw string, says string, convention string")


def registers(spark: SparkSession) -> DataFrame:
    rows = [(r, [c for k, c in enumerate(judge.CONVENTIONS) if r >> k & 1], [c for k, c in enumerate(judge.CONVENTIONS) if not r >> k & 1]) for r in range(32)]
    return spark.createDataFrame(rows, "register int, waived array<string>, held array<string>")


def words(spark: SparkSession) -> DataFrame:
    """word, tags (ranked, repeats kept), closed: everything that is listed."""
    return spark.createDataFrame(lexicon_rows(), "word string, tags array<string>, closed boolean")


def phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(" ".join(p), i, f) for p, (i, f) in style.PHRASES.items()], "phrase string, instead string, flaw string")


def likeliest(key: str) -> str | None:
    found = lexicon.likeliest(key)
    return None if found is None else TAGS[found]
