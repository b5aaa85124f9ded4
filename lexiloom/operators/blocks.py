"""Prose blocks of documents by gaps and islands over their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def markdown_blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """block_no, start (code points), n_lines, prose of each paragraph outside fences, headings and tables."""
    raw = F.split(F.col("text"), "\n")
    lines = docs.select(key, F.posexplode(raw).alias("n", "raw"))
    by = Window.partitionBy(key).orderBy("n")
    lines = lines.withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    lines = lines.withColumn("at", F.coalesce(F.sum(F.char_length("raw") + 1).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fence = F.startswith("line", F.lit("```"))
    lines = lines.withColumn("fence", fence).withColumn("fenced", F.sum(F.col("fence").cast("int")).over(by) % 2 == 1)
    shut = F.col("fence") | (~F.col("fenced") & (F.col("line") == ""))
    lines = lines.withColumn("block", F.sum(shut.cast("int")).over(by))
    prose = ~F.col("fence") & ~F.col("fenced") & (F.col("line") != "") & ~F.startswith("line", F.lit("#")) & ~F.startswith("line", F.lit("|"))
    start = F.col("at") + F.char_length("raw") - F.char_length(F.regexp_replace("raw", r"^\s+", ""))
    told = lines.where(prose).withColumn("start", start)
    blocks = told.groupBy(key, "block").agg(F.min("start").cast("long").alias("start"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("block"))
    return blocks.select(key, number.alias("block_no"), "start", "n_lines", F.array_join(F.transform("lines", lambda x: x["line"]), " ").alias("prose"))
