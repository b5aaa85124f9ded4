"""The per-text operators over streams.

Tokens, reports, registers, repairs, cuts and rewrites need one text at a time and keep no state, so the
batch operators run unchanged on a streaming DataFrame. Corpus statistics and descriptions need the whole
corpus and are batch only; ``corpus_batches`` refreshes them per micro-batch from a growing table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.operators import prose

STATELESS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "unit_tokens": prose.unit_tokens, "unit_reports": prose.unit_reports, "passage_reports": prose.passage_reports, "passage_registers": prose.passage_registers,
    "assessments": prose.assessments, "condensed": prose.condensed, "rewritten": prose.rewritten, "proposals": prose.proposals, "noted": prose.noted,
}


def applied(stream: DataFrame, operator: str) -> DataFrame:
    """A stateless operator on a stream of rows with a text column."""
    return STATELESS[operator](stream)


def tallied(stream: DataFrame) -> DataFrame:
    """How often each rule is broken so far: a running aggregation with one row of state per rule."""
    return prose.tally(prose.unit_reports(stream))


def corpus_batches(stream: DataFrame, path: str, refresh: Callable[[SparkSession, DataFrame], None]):
    """A writer that appends each micro-batch to the table at path and hands all of it to refresh."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("append").parquet(path)
        refresh(rows.sparkSession, rows.sparkSession.read.parquet(path))

    return stream.writeStream.foreachBatch(batch)
