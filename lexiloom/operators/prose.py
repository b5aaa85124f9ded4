"""Reports, registers, repairs, cuts and rewrites of prose, as columns.

Per-unit results stay in the tasks that hold the texts; nothing here shuffles but the tallies.
"""

from __future__ import annotations

import itertools
from collections import Counter
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import grammar, judge, markup, revise, style
from lexiloom.functions.lexicon import TAGS
from lexiloom.functions.units import Token, detokenised, tokenise, units
from lexiloom.operators.kernels import each_text
from lexiloom.session import dealt

TOKENS = "array<struct<word:string,key:string,start:int,end:int,capitalised:boolean,mention:boolean>>"
FAULTS = "array<struct<start:int,end:int,rule:string>>"
NOTES = "array<struct<start:int,end:int,flaw:string,instead:string>>"
EDITS = "array<struct<at:int,word:string>>"
REPORT = f"tags array<string>, faults {FAULTS}, unknown array<int>, notes {NOTES}"


def _tokens(found: list[Token]) -> list[dict]:
    return [t._asdict() for t in found]


def _report(r: judge.Report) -> tuple:
    return [TAGS[t] for t in r.tags], [{"start": a, "end": b, "rule": grammar.RULES[k]} for a, b, k in r.faults], r.unknown, [n._asdict() for n in r.notes]


def conventions(waived: int) -> list[str]:
    return [c for k, c in enumerate(judge.CONVENTIONS) if waived >> k & 1]


def unit_tokens(docs: DataFrame) -> DataFrame:
    """unit_no, tokens of each unit."""
    return each_text(docs, f"unit_no int, tokens {TOKENS}", lambda text: ((k, _tokens(u)) for k, u in enumerate(units(text))))


def _judged(texts: list[str], waived: int) -> list[list[tuple[int, judge.Report]]]:
    """The tokens and the report of each unit of some texts, whose units are read side by side."""
    found = [units(text) for text in texts]
    every = list(itertools.chain.from_iterable(found))
    reports = ((len(u), r.under(waived)) for u, r in zip(every, judge.read_all(every), strict=True))
    return [list(itertools.islice(reports, len(some))) for some in found]


def unit_reports(docs: DataFrame, waived: int = 0) -> DataFrame:
    """unit_no, n_tokens and the report of each unit, under one register."""

    def rows(judged: list[tuple[int, judge.Report]]):
        for k, (n, report) in enumerate(judged):
            yield k, n, *_report(report)

    return each_text(docs, f"unit_no int, n_tokens int, {REPORT}", rows, prepare=partial(_judged, waived=waived))


def unit_counts(docs: DataFrame, waived: int = 0) -> DataFrame:
    """unit_no, n_tokens and how many tags, faults, unknown words and notes the report of each unit has."""

    def rows(judged: list[tuple[int, judge.Report]]):
        for k, (n, r) in enumerate(judged):
            yield k, n, len(r.tags), len(r.faults), len(r.unknown), len(r.notes)

    return each_text(dealt(docs), "unit_no int, n_tokens int, n_tags int, n_faults int, n_unknown int, n_notes int", rows, prepare=partial(_judged, waived=waived))


def text_counts(docs: DataFrame, waived: int = 0) -> DataFrame:
    """n_units, n_tokens, n_faults, n_unknown, n_notes of each text that has units."""

    def rows(judged: list[tuple[int, judge.Report]]):
        if judged:
            yield len(judged), sum(n for n, _ in judged), *(sum(len(getattr(r, x)) for _, r in judged) for x in ("faults", "unknown", "notes"))

    return each_text(dealt(docs), "n_units long, n_tokens long, n_faults long, n_unknown long, n_notes long", rows, prepare=partial(_judged, waived=waived))


def audit(docs: DataFrame, waived: int = 0) -> DataFrame:
    """tally of the unit reports, which are counted where they are made."""

    def rows(judged: list[tuple[int, judge.Report]]):
        found: Counter[str] = Counter()
        for _, r in judged:
            found.update(grammar.RULES[k] for _, _, k in r.faults)
            found.update(n.flaw for n in r.notes)
            if r.unknown:
                found["Unknown"] += len(r.unknown)
        return found.items()

    each = each_text(dealt(docs), "rule string, n long", rows, keep=[], prepare=partial(_judged, waived=waived))
    return each.groupBy("rule").agg(F.sum("n").alias("n"))


def passage_reports(docs: DataFrame) -> DataFrame:
    """unit_no, unit, waived (conventions given up), its report under the register the passage settles on, and its repair."""

    def rows(text: str):
        for k, (tokens, reading, register) in enumerate(judge.read_passage(text)):
            edits = revise.repair(tokens, register)
            mended = detokenised(revise.applied(tokens, edits)) if edits else None
            yield k, detokenised(tokens), conventions(register), *_report(reading.under(register)), [e._asdict() for e in edits or []], mended

    return each_text(docs, f"unit_no int, unit string, waived array<string>, {REPORT}, edits {EDITS}, repaired string", rows)


def passage_registers(docs: DataFrame) -> DataFrame:
    """waived: the conventions that most units of a passage give up; n_units."""

    def rows(text: str):
        found = [register for _, _, register in judge.read_passage(text)]
        yield conventions(judge.register_of(found)), len(found)

    return each_text(docs, "waived array<string>, n_units int", rows)


def assessments(docs: DataFrame) -> DataFrame:
    """Each text as one sentence: its report, integration cost, repair and whether it is clean."""

    def rows(text: str):
        tokens, report, (cost, worst) = judge.assess(text)
        edits = revise.repair(tokens) or []
        yield len(tokens), *_report(report), report.clean, cost, worst, cost / len(tokens) if tokens else 0.0, [e._asdict() for e in edits], detokenised(revise.applied(tokens, edits))

    return each_text(docs, f"n_tokens int, {REPORT}, clean boolean, cost int, worst int, cost_per_word double, edits {EDITS}, repaired string", rows)


def condensed(docs: DataFrame) -> DataFrame:
    """core (the sentences that carry the point), kept, dropped, about."""

    def rows(text: str):
        core = revise.condense(text)
        yield core.text, core.kept, core.dropped, core.about

    return each_text(docs, "core string, kept array<string>, dropped int, about array<string>", rows)


def rewritten(docs: DataFrame, plain: bool = True, repairs: bool = True, markdown: bool = True) -> DataFrame:
    """swaps and the new text of a file: its prose repaired and said plainer, all else as it was."""

    def rows(source: str):
        blocks = markup.markdown_blocks(source) if markdown else markup.comment_blocks(source)
        found = (revise.repairs_of(blocks) if repairs else []) + (revise.plain_of(blocks) if plain else [])
        found = sorted({s.start: s for s in found}.values(), key=lambda s: s.start)
        yield [s._asdict() for s in found], revise.rewritten(source, found)

    return each_text(docs, "swaps array<struct<start:int,was:string,now:string>>, rewritten string", rows)


def proposals(docs: DataFrame, markdown: bool = True) -> DataFrame:
    """Blocks of a file's prose that come down to fewer words: at, was, now. Nothing is written."""

    def rows(source: str):
        for block in markup.markdown_blocks(source) if markdown else markup.comment_blocks(source):
            was = " ".join(line for _, line in block)
            now = revise.condense(was).text
            if len(now.split()) < len(was.split()):
                yield block[0][0], was, now

    return each_text(docs, "at int, was string, now string", rows)


def tally(reports: DataFrame) -> DataFrame:
    """rule, n: how often each rule is broken; unknown words count as rule Unknown, notes by their flaw."""
    what = F.concat(F.transform("faults", lambda f: f["rule"]), F.transform("unknown", lambda _: F.lit("Unknown")), F.transform("notes", lambda n: n["flaw"]))
    return reports.select(F.explode(what).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def single_sentences(docs: DataFrame) -> DataFrame:
    """tokens of each text, read as one sentence."""
    return each_text(docs, f"tokens {TOKENS}", lambda text: [(_tokens(tokenise(text)),)])


def noted(docs: DataFrame) -> DataFrame:
    """notes on each unit's wording, whatever the register."""

    def rows(text: str):
        for k, u in enumerate(units(text)):
            yield k, [n._asdict() for n in style.notes(u, judge.check(u).tags)]

    return each_text(docs, f"unit_no int, notes {NOTES}", rows)
