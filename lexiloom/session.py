"""Session helpers: worker import path, shared folder, lineage cutting."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What goes to a Python worker at once, unless the session says otherwise than Spark's default. Tasks hold
#: several batches on both sides, and a task with two kernels has two workers.
BATCH_BYTES, BATCH_SETTING = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's default. Asked for with a default of one's own, an unset setting would give that instead.
DEFAULT_BYTES = "67108864b"
ROOT = str(Path(__file__).resolve().parents[1])


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is run from a checkout, and bound their batches."""
    if spark.conf.get(BATCH_SETTING) == DEFAULT_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only on a single machine where none is set."""
    sc = spark.sparkContext
    if not (found := sc.getCheckpointDir()):
        if not (found := spark.conf.get("spark.checkpoint.dir", None)):
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir names no folder that all machines share")
            found = tempfile.mkdtemp(prefix="lexiloom-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return made[-1]


#: Folders made in the shared one by this process.
made: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again: columns that nobody asks for aren't read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str | None = None) -> None:
    """Delete a folder made in the shared one, or all that this process made, once nothing reads them any more."""
    for p in [path] if path else list(made):
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if p in made:
            made.remove(p)


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has so many rows at most; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder once and go on from there (reliable checkpoint, eager)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(rows: DataFrame) -> DataFrame:
    """rows of a scan, dealt to all cores if it has fewer partitions than there are cores.

    That is a small input (a file of one row group is one task however large the cluster); a large one has
    partitions enough and is left alone. Only where the rows are computed changes.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Characters of a task of a kernel that reads prose.
TASK_CHARACTERS = 8_000_000


def dealt(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows dealt to tasks of TASK_CHARACTERS of text each, about, if they have fewer partitions than that makes.

    A table's partitions follow its compressed size, not the work on its rows.
    """
    tasks = (rows.agg(F.sum(F.char_length(text))).first()[0] or 0) // TASK_CHARACTERS
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


#: Tables whose rows are costly to work on.
TEXTS = ("documents", "pages", "conversations", "benchmark")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows
