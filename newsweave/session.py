"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch of texts; a Python worker holds a batch several times over.
BATCH_BYTES = 4 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT_LIMIT = "67108864b"


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume; cluster settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if folder is None and current.isDefined():
        folder = current.get()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="newsweave-")
    if not current.isDefined():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, one per run."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at BATCH_BYTES, unless the session has a limit of its own."""
    if spark.conf.get(BATCH_LIMIT, DEFAULT_LIMIT) == DEFAULT_LIMIT:
        spark.conf.set(BATCH_LIMIT, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Return freed memory of a Python worker to the system.

    Workers are kept for other steps, and their allocators keep what the largest batch so far took.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def united(first: DataFrame, *more: DataFrame) -> DataFrame:
    """The rows of all frames, written out.

    Spark takes a union of frames that are hash-partitioned alike as partitioned itself and leaves out the
    shuffle a following aggregate needs, while adaptive execution may merge partitions of each frame in its
    own way; equal keys then meet in different tasks.
    """
    whole = first
    for rows in more:
        whole = whole.unionByName(rows)
    return cut(whole)


def spread_work(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the keys into a fixed number of partitions.

    For work that is heavy per row but small in bytes: adaptive execution would merge such partitions
    into few tasks, and an explicit number keeps it from doing so.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
