"""Session settings and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "corpusspark", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution; partition counts and memory stay with the caller's settings."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a session without one gets a folder of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(named)
        return
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(os.environ.get("CORPUSSPARK_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="corpusspark-"))


def data_stamp(spark: SparkSession, folder: str) -> int:
    """Changes when a file of the folder is added, removed or rewritten: stages kept for it are then built anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files, found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(found)))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own inside the checkpoint folder, for tables that a job writes in several steps."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid4().hex}"


#: Spark's setting that removes the shuffle files of a job when it ends.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: list[list[str]] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the checkpoint folder and go on from there.

    Lost executors then cost no recomputation of earlier stages, later plans stay small, and the planner
    knows the true size of the stage: it broadcasts small ones by itself and reads only the columns it needs.
    Nothing reads the job's shuffle files after that, so they go when it ends.
    """
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "stage")
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(SHUFFLES_END) if before is None else spark.conf.set(SHUFFLES_END, before)
    if _open:
        _open[-1].append(folder)
    stage = spark.read.schema(df.schema).parquet(folder)
    stage._stage_folder = folder
    return stage


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes the stages that :func:`cut_lineage` writes inside the block when it ends, except those handed to ``keep``."""
    kept: list[str] = []

    def keep(stage: DataFrame) -> DataFrame:
        kept.append(stage._stage_folder)
        return stage

    _open.append([])
    try:
        yield keep
    finally:
        written = _open.pop()
        if _open:
            _open[-1].extend(f for f in written if f in kept)
        for folder in (f for f in written if f not in kept):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for the small state of a loop turn."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
