"""Neighbours and running sums along one global order, without a window over a single partition.

Keys are dealt into ranges (by quantiles, or by Spark's own sampling), each range is sorted by itself, and the
seams between ranges are closed from a table of one row per range, which is all that reaches the driver. The
number of ranges grows with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import cut

#: Rows of a range, about. Ranges are found in two steps of STEP at most.
RANGE_ROWS, STEP = 50_000, 512


def range_bounds(rows: DataFrame, key: str, count: int) -> list[list]:
    """Bounds of count ranges of a number: lists of STEP at most, the first of them the bounds between the others."""
    count = max(1, min(STEP * STEP, count))
    told = rows.agg(F.percentile_approx(key, [k / count for k in range(1, count)], max(10_000, 20 * count))).first()[0] if count > 1 else None
    bounds = sorted(set(told or []))
    parts = [bounds[k : k + STEP] for k in range(0, len(bounds), STEP)] or [[]]
    return [[x[-1] for x in parts[:-1]], *parts]


def range_of(key: Column, bounds: list[list]) -> Column:
    """The number of a key's range; it grows with the key."""
    below = lambda some: F.size(F.filter(some, lambda b: b < key))
    if len(bounds) < 3:
        return below(F.lit(bounds[1])) if bounds[1] else F.lit(0)
    part = below(F.lit(bounds[0]))
    return (part * STEP + below(F.element_at(F.array(*map(F.lit, bounds[1:])), part + 1))).cast("int")


def ranged(rows: DataFrame, key: str) -> DataFrame:
    """rows with _range: a number that grows with key."""
    return rows.withColumn("_range", range_of(F.col(key), range_bounds(rows, key, rows.count() // RANGE_ROWS)))


def with_sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each name, the sum of a number over all rows before each in an order (that leaves no ties)."""
    dealt = cut(rows.withColumns(sums).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    by = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(*(F.sum(n).alias(n) for n in sums)).orderBy("_range").collect()  # a row per range
    ahead, told = dict.fromkeys(sums, 0), []
    for r in totals:
        told.append((r["_range"], *ahead.values()))
        ahead = {n: v + (r[n] or 0) for n, v in ahead.items()}
    kind = ", ".join(f"_ahead_{n} {dealt.agg(F.sum(n)).dtypes[0][1]}" for n in sums)
    table = F.broadcast(rows.sparkSession.createDataFrame(told, f"_r int, {kind}"))
    found = dealt.withColumns({n: F.coalesce(F.sum(n).over(by), F.lit(0)) for n in sums}).join(table, F.col("_range") == F.col("_r"))
    return found.withColumns({n: F.col(n) + F.col(f"_ahead_{n}") for n in sums}).drop("_range", "_r", *(f"_ahead_{n}" for n in sums))


def with_neighbours(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """rows (key unique) with next_<value> and prev_<value> of the rows beside each by key; null at the ends."""
    by = Window.partitionBy("_range").orderBy(key)
    found = ranged(rows, key)
    found = found.withColumns({f"{side}_{v}": f(v).over(by) for v in values for side, f in (("next", F.lead), ("prev", F.lag))})
    found = found.withColumns({"_first": F.row_number().over(by) == 1, "_last": F.lead(key).over(by).isNull()})
    edge = F.struct(key, *(v for v in values if v != key))
    seams = found.groupBy("_range").agg(F.min(edge).alias("lo"), F.max(edge).alias("hi")).orderBy("_range").collect()
    if len(seams) < 2:
        return found.drop("_range", "_first", "_last")
    told = [(r["_range"], seams[k + 1]["lo"] if k + 1 < len(seams) else None, seams[k - 1]["hi"] if k else None) for k, r in enumerate(seams)]
    kind = rows.select(edge.alias("e")).schema["e"].dataType.simpleString()
    table = F.broadcast(rows.sparkSession.createDataFrame(told, f"_r int, _after {kind}, _before {kind}"))
    found = found.join(table, F.col("_range") == F.col("_r"), "left")
    for v in values:
        found = found.withColumns({f"next_{v}": F.when(F.col("_last"), F.col(f"_after.{v}")).otherwise(F.col(f"next_{v}")), f"prev_{v}": F.when(F.col("_first"), F.col(f"_before.{v}")).otherwise(F.col(f"prev_{v}"))})
    return found.drop("_range", "_first", "_last", "_r", "_after", "_before")


def with_running_sum(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows (key unique) with the sum of value over all rows before each by key."""
    by = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged(rows, key).withColumn(name, F.coalesce(F.sum(value).over(by), F.lit(0)))
    sums = found.groupBy("_range").agg(F.sum(value).alias("s")).orderBy("_range").collect()
    total, told = 0, []
    for r in sums:
        told.append((r["_range"], total))
        total += r["s"] or 0
    if len(told) < 2:
        return found.drop("_range")
    table = F.broadcast(rows.sparkSession.createDataFrame(told, "_r int, _offset long"))
    return found.join(table, F.col("_range") == F.col("_r"), "left").withColumn(name, F.col(name) + F.col("_offset")).drop("_range", "_r", "_offset")
