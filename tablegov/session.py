"""Session set-up and lineage cutting."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

# Most rows of a narrow frame that may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def get_spark(app: str = "tablegov", cpus: str = "*", **conf: str) -> SparkSession:
    """A session with the settings the library expects.  On a cluster pass the
    master through spark-submit; ``local[cpus]`` is only the fallback."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Checkpoints of iterative operators go away with the frames that use them.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.  Only a local
    session without that setting gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablegov-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files, so a
    lost executor re-reads instead of replaying an iterative plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a frame that every round of a loop reads.  Blocks that do not fit
    in memory go to disk, and lost ones are computed again from ``df``; nothing
    built inside may be used lazily after the block."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``BROADCAST_ROWS`` rows,
    else as it is.  Spark cannot estimate a checkpointed frame, so the rows are
    counted; pass ``rows`` where the count is known."""
    if rows is None:
        rows = df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
