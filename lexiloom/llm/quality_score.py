"""Quality classifier: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

Statistics of a text are standardized and mapped to ``FEATURES`` cosines of random projections, which
approximate a Gaussian kernel. Each task sums its rows' part of the normal equations, of fixed size, and
these are added up; the solution scores every document. A fold that the regression never saw gives, over
a histogram of raw scores, the isotonic map from raw score to probability.

Learned from: labelled documents whose crc32(doc_id as text) mod 5 is 2, 3 or 4 (regression) or 1
(calibration). Held out: 0. Labels, lang, source and doc_id are no inputs.

Defined results: a null text is scored as an empty one; a null doc_id is not held out and has no label;
repeated rows get equal scores, and repeated labels count each; null labels are ignored; without any
label all scores are 0.5; very long texts are read whole; an empty table gives no rows; other columns are
kept by ``scored``, and those with the names of its results replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.textstats import COUNTS, counted
from lexiloom.session import cut, table

NAME = "op2_quality_classifier"
FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 11
BINS, LOW, HIGH = 2_000, -0.5, 1.5
FOLDS, CALIBRATION = 5, 1
CUT = 0.3
#: Sums of so many tasks are added up at once, and what that gives once more; each is FEATURES rows of FEATURES + 2 numbers.
ADDED = 64
PREFIX = "_t_"
STATISTICS = [PREFIX + x for x in COUNTS]


def inputs(frame: pd.DataFrame) -> np.ndarray:
    """Statistics of each text, none of which grows with its length but by a logarithm."""
    x = {c: frame[PREFIX + c].to_numpy(dtype=float) for c in COUNTS}
    words, chars, lines = np.maximum(x["n_words"], 1), np.maximum(x["n_chars"], 1), np.maximum(x["n_lines"], 1)
    found = [
        np.log1p(x["n_words"]), x["word_chars"] / words, np.minimum(x["n_symbols"] / words, 5), x["n_dup_lines"] / lines, x["n_repeat_words"] / words,
        np.log(words / np.maximum(x["n_distinct"], 1)), x["n_upper"] / np.maximum(x["n_letters"], 1), x["n_digits"] / chars,
        x["n_marks"] / words, np.minimum(x["n_cries"] / words, 5), np.log(words / lines), x["n_other"] / chars,
    ]
    return np.stack(found, axis=1)


class Model:
    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        random = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.weights = random.normal(size=(len(mean), FEATURES - 1)) / WIDTH
        self.shift = random.uniform(0, 2 * np.pi, FEATURES - 1)
        self.solution: np.ndarray | None = None
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, frame: pd.DataFrame) -> np.ndarray:
        z = np.clip((inputs(frame) - self.mean) / self.deviation, -8, 8)
        cosines = np.sqrt(2 / FEATURES) * np.cos(z @ self.weights + self.shift)
        return np.concatenate([np.ones((len(frame), 1)), cosines], axis=1)

    def raw(self, frame: pd.DataFrame) -> np.ndarray:
        return self.features(frame) @ self.solution

    def score(self, frame: pd.DataFrame) -> np.ndarray:
        if self.solution is None:
            return np.full(len(frame), 0.5)
        if self.steps is None:
            return np.clip(self.raw(frame), 0, 1)
        return np.clip(np.interp(self.raw(frame), *self.steps), 0, 1)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to value (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(n), s / w) for s, w, n in blocks]) if blocks else np.zeros(0)


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """rows: doc_id and the counts of its text, all of them."""

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = inputs(frame)
            yield pd.DataFrame({"k": range(x.shape[1]), "n": float(len(x)), "s": x.sum(0), "q": (x**2).sum(0)})

    told = rows.select(*STATISTICS).mapInPandas(moments, "k int, n double, s double, q double").groupBy("k").agg(F.sum("n"), F.sum("s"), F.sum("q")).orderBy("k").collect()
    if not told or not told[0][1]:
        return Model(np.zeros(len(told) or 12), np.ones(len(told) or 12))
    n, s, q = (np.array([r[i] for r in told], dtype=float) for i in (1, 2, 3))
    model = Model(s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0)))

    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y"))
    learn = cut(rows.join(known, F.col("doc_id") == F.col("_id")).where(fold() != 0).select(*STATISTICS, "_y", fold().cast("int").alias("_fold")))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES, FEATURES + 2))
        for frame in frames:
            z, y = model.features(frame), frame["_y"].to_numpy()
            total += np.concatenate([z.T @ z, (z.T @ y)[:, None], np.full((FEATURES, 1), float(len(y)))], axis=1)
        yield pd.DataFrame({"g": TaskContext.get().partitionId() // ADDED, "k": range(FEATURES), "row": list(total)})

    def added(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [part["g"].iloc[0]], "k": [part["k"].iloc[0]], "row": [np.sum(np.stack(part["row"]), axis=0)]})

    kind = "g int, k int, row array<double>"
    parts = learn.where(F.col("_fold") != CALIBRATION).mapInPandas(sums, kind)
    if parts.rdd.getNumPartitions() > ADDED:
        parts = parts.groupBy("g", "k").applyInPandas(added, kind)
    found = np.array([r["row"] for r in sorted(parts.groupBy("k").applyInPandas(added, kind).collect(), key=lambda r: r["k"])])
    if not len(found) or not (count := found[0, -1]):
        return model
    model.solution = np.linalg.solve(found[:, :FEATURES] / count + RIDGE / FEATURES * np.eye(FEATURES), found[:, FEATURES] / count)

    def raw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.clip((model.raw(frame) - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)
            yield pd.DataFrame({"bin": at, "y": frame["_y"]})

    hist = learn.where(F.col("_fold") == CALIBRATION).mapInPandas(raw, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("s")).orderBy("bin").collect()
    if hist:
        weight = np.array([r["n"] for r in hist], dtype=float)
        middle = LOW + (np.array([r["bin"] for r in hist]) + 0.5) * (HIGH - LOW) / BINS
        model.steps = middle, isotonic(np.array([r["s"] for r in hist]) / weight, weight)
    return model


def with_score(rows: DataFrame, model: Model) -> DataFrame:
    """rows (with the counts) with held_out, score and predicted, without the counts."""
    names = [x for x in rows.columns if x not in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(pa.Table.from_batches([batch]).select(STATISTICS).to_pandas())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in names), pa.array(score, pa.float64())], names=[*names, "score"])

    schema = T.StructType([*rows.select(*names).schema.fields, T.StructField("score", T.DoubleType(), False)])
    found = rows.mapInArrow(run, schema)
    return found.withColumns({"held_out": F.coalesce(fold() == 0, F.lit(False)), "predicted": (F.col("score") >= CUT).cast("int")})


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score and predicted."""
    model = fit(cut(counted(docs, ["doc_id"], prefix=PREFIX)), labels)
    docs = docs.drop("held_out", "score", "predicted")
    return with_score(counted(docs, docs.columns, prefix=PREFIX), model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = cut(counted(table(spark, sf_dir, "documents"), ["doc_id"], prefix=PREFIX))
    return with_score(slim, fit(slim, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
