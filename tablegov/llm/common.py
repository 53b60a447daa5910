"""Small helpers shared by the operators of this package.

Operators that return the columns of their input use names with two leading
underscores for their own; an input should not have such columns.
"""

from __future__ import annotations

import string
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegov.session import ensure_checkpoint_dir

# Texts are long: an Arrow batch of this many keeps a Python worker small.
TEXTS_PER_BATCH = 512
# Packed rows are larger still: their batches end at this size.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffles_freed(spark: SparkSession):
    """Inside, Spark removes the shuffle files of an execution when it ends, not when
    the driver happens to collect its garbage.  For executions nobody repeats."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession):
    """Inside, an Arrow batch for Python ends at ``BATCH_BYTES``, which Spark and its worker both hold."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and go on from
    the files, so that later reads do not replay the plan and a lost executor
    only re-reads.  Shuffle files of the plan are gone afterwards."""
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def lent(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """As ``written``, for the time of the block: its rows leave the disk at the end."""
    frame, path = _written(df, name)
    try:
        yield frame
    finally:
        df.sparkSession.range(0).write.mode("overwrite").parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch size for operators that send whole texts to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXTS_PER_BATCH:
        spark.conf.set(key, str(TEXTS_PER_BATCH))


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)



_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this library to the Python workers, once per application, so that
    they can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()).resolve() / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
