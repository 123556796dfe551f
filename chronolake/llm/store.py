"""Tables of intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Batches for Python are bounded in bytes, as texts may be long; Spark's own bound is for larger machines.
BATCH_BYTES, DEFAULT_BATCH, SMALL_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, as in tests, a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if spark.conf.get(BATCH_BYTES) == DEFAULT_BATCH:
        spark.conf.set(BATCH_BYTES, SMALL_BATCH)
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='chronolake-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _next_shuffle(spark: SparkSession) -> int:
    return spark.sparkContext._jsc.sc().newShuffleId()


def _drop_shuffles(spark: SparkSession, first: int, last: int) -> None:
    """Removes the shuffle files of a finished query, whose numbers lie in between. Where other jobs are
    running, which may have some of the numbers, files are left to Spark's own cleaner."""
    context = spark.sparkContext
    cleaner = context._jsc.sc().cleaner()
    if cleaner.isDefined() and not context.statusTracker().getActiveJobsIds():
        for number in range(first + 1, last):
            cleaner.get().doCleanupShuffle(number, False)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back: cuts its lineage, and the files
    outlive the executors. The shuffle files behind it are then removed, so a chain of steps holds the
    files of one step at a time."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/chronolake/{name}-{uuid.uuid4().hex}"
    first = _next_shuffle(spark)
    df.write.parquet(path)
    _drop_shuffles(spark, first, _next_shuffle(spark))
    schema = df.schema
    del df
    gc.collect()
    return spark.read.schema(schema).parquet(path)
