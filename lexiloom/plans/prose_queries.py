"""Reports on prose: labelled fixtures with what they must give, and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import prose
from lexiloom.plans import fixtures
from lexiloom.session import table


def _lines(text: str, columns: int) -> list[tuple]:
    return [(k, *(x.strip() for x in line.split(" | "))) if columns > 1 else (k, line) for k, line in enumerate(text.strip().split("\n"))]


GOOD, BAD, WASTEFUL = _lines(fixtures.GOOD, 1), _lines(fixtures.BAD, 2), _lines(fixtures.WASTEFUL, 2)


def _values(rows: list[tuple], names: str) -> str:
    told = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(told, r)) + ')' for r in rows)}) AS t({names})"


def grammatical_sentences(spark: SparkSession, d: str) -> DataFrame:
    found = prose.assessments(spark.createDataFrame(GOOD, "id int, text string").withColumn("sentence", F.col("text")))
    return found.select("id", F.col("sentence").alias("text"), "clean")


def faulty_sentences(spark: SparkSession, d: str) -> DataFrame:
    found = prose.assessments(spark.createDataFrame(BAD, "id int, text string, rule string").withColumn("sentence", F.col("text")))
    again = prose.assessments(found.select("id", F.col("repaired").alias("text"))).select("id", F.col("clean").alias("mends"))
    found = found.withColumn("caught", F.exists("faults", lambda f: f["rule"] == F.col("rule"))).withColumn("swaps", F.size("edits"))
    return found.join(again, "id").select("id", F.col("sentence").alias("text"), "rule", "caught", "mends", (F.col("swaps").between(1, 2)).alias("few"))


def wasteful_sentences(spark: SparkSession, d: str) -> DataFrame:
    found = prose.assessments(spark.createDataFrame(WASTEFUL, "id int, text string, flaw string").withColumn("sentence", F.col("text")))
    return found.select("id", F.col("sentence").alias("text"), "flaw", F.exists("notes", lambda n: n["flaw"] == F.col("flaw")).alias("noted"))


def registers(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n, t, list(w)) for n, (t, w) in fixtures.PASSAGES.items()]
    found = prose.passage_registers(spark.createDataFrame(rows, "name string, text string, expected array<string>"))
    holds = F.when(F.size("expected") == 0, F.size("waived") == 0).otherwise(F.size(F.array_except("expected", "waived")) == 0)
    return found.select("name", holds.alias("recovered"))


def spoiled_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n, t + "\n" + fixtures.SPOILED[n]) for n, (t, _) in fixtures.PASSAGES.items()]
    found = prose.passage_reports(spark.createDataFrame(rows, "name string, text string"))
    last = found.groupBy("name").agg(F.max_by(F.size("faults"), "unit_no").alias("n"), F.max_by("unit", "unit_no").alias("unit"))
    return last.select("name", (F.col("n") > 0).alias("caught"))


def condensed_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k, t) for k, (t, _) in enumerate(fixtures.CONDENSED)]
    return prose.condensed(spark.createDataFrame(rows, "id int, text string")).select("id", "core")


def conversation_reports(spark: SparkSession, d: str) -> DataFrame:
    """Units of every turn, with how many faults, unknown words and notes each has."""
    found = prose.unit_counts(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"))
    return found.select("conv_id", "turn", "role", "unit_no", "n_tokens", "n_tags", "n_faults", "n_unknown", "n_notes")


def document_reports(spark: SparkSession, d: str) -> DataFrame:
    """Every unit of every document judged: how many there are per document, and what was found."""
    found = prose.text_counts(table(spark, d, "documents").select("doc_id", "text"))
    return found.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("n_units", "n_tokens", "n_faults", "n_unknown", "n_notes")))


def document_audit(spark: SparkSession, d: str) -> DataFrame:
    return prose.audit(table(spark, d, "documents").select("text"))


def conversation_units(spark: SparkSession, d: str) -> DataFrame:
    found = prose.unit_tokens(table(spark, d, "conversations"))
    return found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_units"), F.sum(F.size("tokens")).cast("long").alias("n_tokens"))


def benchmark_units(spark: SparkSession, d: str) -> DataFrame:
    found = prose.unit_tokens(table(spark, d, "benchmark"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_units"), F.sum(F.size("tokens")).cast("long").alias("n_tokens"))


def conversation_audit(spark: SparkSession, d: str) -> DataFrame:
    return prose.audit(table(spark, d, "conversations").select("text"))


def benchmark_registers(spark: SparkSession, d: str) -> DataFrame:
    return prose.passage_registers(table(spark, d, "benchmark")).select("item_id", F.array_join("waived", ",").alias("waived"), "n_units")


def benchmark_assessments(spark: SparkSession, d: str) -> DataFrame:
    found = prose.assessments(table(spark, d, "benchmark"))
    return found.select("item_id", "n_tokens", "clean", "cost", "worst", F.size("faults").alias("n_faults"), F.size("unknown").alias("n_unknown"), F.size("edits").alias("n_edits"))


def benchmark_cores(spark: SparkSession, d: str) -> DataFrame:
    return prose.condensed(table(spark, d, "benchmark")).select("item_id", "core", "dropped", F.array_join("about", " ").alias("about"))


def benchmark_rewrites(spark: SparkSession, d: str) -> DataFrame:
    return prose.rewritten(table(spark, d, "benchmark")).select("item_id", F.size("swaps").alias("n_swaps"), "rewritten")


def _file(lines: tuple[str, ...]) -> str:
    return "".join(f"/// {x}\n" for x in lines) + "fn main() {}\n"


def file_rewrites(spark: SparkSession, d: str) -> DataFrame:
    rows = [(n, kind, _file(lines)) for n, (lines, kind, _) in fixtures.REWRITES.items()]
    found = spark.createDataFrame(rows, "name string, kind string, text string")
    done = [prose.rewritten(found.where(F.col("kind") == k), plain=k == "plain", repairs=k == "repairs", markdown=False) for k in ("plain", "repairs")]
    return done[0].unionByName(done[1]).select("name", "rewritten")


QUERIES = {
    f.__name__: f
    for f in (grammatical_sentences, faulty_sentences, wasteful_sentences, registers, spoiled_passages, condensed_passages, conversation_reports, conversation_audit, document_reports, document_audit, conversation_units, benchmark_units, benchmark_registers, benchmark_assessments, benchmark_cores, benchmark_rewrites, file_rewrites)
}
#: The tables hold no quotation marks, contractions or names with marks inside, so tokens and units can be counted by patterns.
_UNITS = r"""SELECT K, list_sum(list_transform(string_split(text, chr(10)), lambda l: len(regexp_extract_all(l, '[.!?]')) + CASE WHEN regexp_matches(l, '[^\s*\\#~|.!?][\s*\\#~|]*$') THEN 1 ELSE 0 END))::BIGINT AS n_units,
len(regexp_extract_all(text, '[\p{L}\p{N}''-]+|[^\s*\\#~|]'))::BIGINT AS n_tokens FROM T WHERE regexp_matches(text, '[^\s*\\#~|]')"""
ORACLES = {
    "conversation_units": _UNITS.replace("K,", "conv_id, turn,").replace("FROM T", "FROM conversations"),
    "benchmark_units": _UNITS.replace("K,", "item_id,").replace("FROM T", "FROM benchmark"),
    "grammatical_sentences": _values([(k, t, True) for k, t in GOOD], "id, text, clean"),
    "faulty_sentences": _values([(k, t, r, True, True, True) for k, t, r in BAD], "id, text, rule, caught, mends, few"),
    "wasteful_sentences": _values([(k, t, f, True) for k, t, f in WASTEFUL], "id, text, flaw, noted"),
    "registers": _values([(n, True) for n in fixtures.PASSAGES], "name, recovered"),
    "spoiled_passages": _values([(n, True) for n in fixtures.PASSAGES], "name, caught"),
    "condensed_passages": _values([(k, c) for k, (_, c) in enumerate(fixtures.CONDENSED)], "id, core"),
    "file_rewrites": _values([(n, _file(out)) for n, (_, _, out) in fixtures.REWRITES.items()], "name, rewritten"),
}
