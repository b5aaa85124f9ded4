"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document gets a 60-bit hash of its id. Sizes are summed by source and hash bucket (map-side
first, so a source with a third of all rows is spread over 4,096 buckets); the bucket in which a
source's budget ends is split again by the next 12 bits, and only its rows are read for that, until one
hash is left. A document is then taken by comparing its hash with its source's threshold: nothing is
sorted, and the same rows always give the same mix.

Defined results:
- null text: size 0; null source: a source of its own, last in the order of sources;
- null id: the text's digest stands for it;
- rows with one id have one hash and are taken or left together (with a null id: equal texts);
- an empty table gives an empty result; a source whose documents are all empty has target 0;
- other columns are kept by ``mix``; columns with the names of its results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.operators.ordering import with_sums_before
from lexiloom.session import cut, table

NAME = "op10_mix_sources"
WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BITS, LEVELS = 12, 5
#: A table of one row per source is sent to all executors only below so many rows (about 100 bytes each).
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits, so that they fit a long and any SQL engine with md5 can give them too."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_size": size_of(F.col("text")), "_hash": hash_of(F.col("doc_id"), F.col("text"))})


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """sources: source, source_size. Adds target: shares by weight, none above most times its source.

    Where a cap binds, the excess goes to the rest by weight until none is above. In order of
    cap/weight, the capped ones come first; the level of the rest follows from running sums, which are
    taken range by range of that order, so that no task holds all sources.
    """
    named = with_sums_before(sources, [F.col("source").asc_nulls_last()], {"_place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int")).cast("long")
    ranked = named.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * most).alias("_cap"))
    ranked = with_sums_before(ranked, [(F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last()], {"_c": F.col("_cap"), "_u": F.col("_w")})
    ranked = cut(ranked)
    every = ranked.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    size, whole = (every["size"] or 0) * float(share), every["w"] or 0
    level = (F.lit(size) - F.col("_c")) / (F.lit(whole) - F.col("_u"))
    ranked = ranked.withColumn("_level", level)
    free = F.struct((F.col("_cap") / F.col("_w")).alias("at"), F.col("_level").alias("level"))
    first = ranked.where(F.col("_cap") / F.col("_w") > F.col("_level")).agg(F.min(free).alias("free")).first()["free"]
    own = F.col("_cap").cast("double")
    target = own if first is None else F.when(F.col("_cap") <= F.col("_w") * F.lit(first["level"]), own).otherwise(F.col("_w") * F.lit(first["level"]))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(slim: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """slim: source, _size, _hash. One row per source: source_size, target, full, below.

    A document is taken full times, and once more if its hash is less than below.
    """
    shift = BITS * (LEVELS - 1)

    def histogram(rows: DataFrame, shift: int) -> DataFrame:
        bucket = F.shiftright("_hash", shift)
        return rows.groupBy("source", bucket.alias("_bucket")).agg(F.sum("_size").alias("_sum"), F.min("_hash").alias("_lo"), F.max("_hash").alias("_hi"))

    first = cut(histogram(slim, shift))
    goal = targets(first.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, most)
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    goal = cut(goal.withColumn("full", full.cast("long")).withColumn("_left", F.col("target") - F.col("full") * F.col("source_size")))

    def boundary(hist: DataFrame, state: DataFrame) -> DataFrame:
        """The bucket in which what is left of a source's budget ends, and what is left before it."""
        ahead = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = _held(state.select(F.col("source").alias("_owner"), "_left"))
        both = hist.join(held, F.col("source").eqNullSafe(F.col("_owner"))).withColumn("_rest", F.col("_left") - ahead)
        return both.where((F.col("_rest") >= 0) & (F.col("_rest") < F.col("_sum"))).select("source", "_bucket", "_rest", "_sum", "_lo", "_hi")

    state = cut(boundary(first, goal.select("source", "_left")))
    for _ in range(LEVELS - 1):
        if state.where("_lo < _hi").isEmpty():
            break
        shift -= BITS
        some = _held(state.where("_lo < _hi").select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.col("_rest").alias("_left")))
        inside = slim.join(some, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("_hash", shift + BITS) == F.col("_b")), "left_semi")
        finer = boundary(histogram(inside, shift), state.select("source", F.col("_rest").alias("_left")))
        state = cut(state.where("_lo >= _hi").unionByName(finer))
    ends = state.select(F.col("source").alias("_s"), F.when(2 * F.col("_rest") >= F.col("_sum"), F.col("_lo") + 1).otherwise(F.col("_lo")).alias("_below"))
    return cut(
        goal.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left")
        .select("source", "source_size", "target", "full", F.coalesce("_below", F.lit(0).cast("long")).alias("below"))
    )


def _held(per_source: DataFrame) -> DataFrame:
    """Broadcast a table of one row per source if its counted size allows; else Spark joins by shuffle."""
    small = per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return F.broadcast(per_source) if small else per_source


def applied(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with source, _size, _hash: adds size, source_size, target, copies, taken."""
    plan = _held(plan.select(F.col("source").alias("_s"), *(F.col(c).alias(f"_{c}") for c in ("source_size", "target", "full", "below"))))
    copies = F.col("_full") + (F.col("_hash") < F.col("_below")).cast("long")
    found = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")), "left")
    return found.withColumns({"size": F.col("_size"), "source_size": F.col("_source_size"), "target": F.col("_target"), "copies": copies, "taken": copies * F.col("_size")}).drop("_s", "_size", "_hash", "_source_size", "_target", "_full", "_below")


RESULTS = ("size", "source_size", "target", "copies", "taken")


def _mixed(docs: DataFrame, weights, share, most) -> DataFrame:
    """row (all columns of docs) and the results."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", size_of(F.col("text")).alias("_size"), hash_of(F.col("doc_id"), F.col("text")).alias("_hash"))
    plan = thresholds(cut(rows.select("source", "_size", "_hash")), weights, share, most)
    return applied(rows, plan).select("row", *RESULTS)


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """docs (doc_id, text, source, any others) with size, source_size, target, copies and taken."""
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in RESULTS]
    return _mixed(docs, weights, share, most).select(*kept, *RESULTS)


def repeated(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    mixed = _mixed(docs, weights, share, most).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    slim = cut(measured(docs).drop("text"))
    return applied(slim, thresholds(slim.select("source", "_size", "_hash"))).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, source_size * 2 AS cap,
             CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM r),
v AS (SELECT arg_min(level, cap::DOUBLE / w) FILTER (WHERE cap::DOUBLE / w > level) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN v.level IS NULL OR cap <= w * v.level THEN cap::DOUBLE ELSE w * v.level END AS target FROM l, v),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS full_copies FROM t),
k AS (SELECT source, h, sum(size) AS z FROM d GROUP BY source, h),
c AS (SELECT source, h, z, coalesce(sum(z) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM k),
b AS (SELECT c.source, max(CASE WHEN 2 * (g.target - g.full_copies * g.source_size - ahead) >= z THEN h + 1 ELSE h END) AS below
      FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source
      WHERE g.target - g.full_copies * g.source_size - ahead >= 0 AND g.target - g.full_copies * g.source_size - ahead < z GROUP BY c.source)
SELECT d.doc_id, d.size, g.source_size, g.target,
       (d.size * (g.full_copies + CASE WHEN d.h < coalesce(b.below, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
