"""A folder as a queue of tasks: files of JSON lines come in, results go out, each once.

A run takes the files that have come since the last one as a batch, by the stream's checkpoint.  What an attempt at a
batch makes is written to a folder of its own and published by a manifest that names it, put in place by a rename.  A
reader follows manifests only, so it never sees half of an attempt, and the first attempt that is published stays: one that
is killed before leaves nothing to see, and one that is made again after changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.streaming.runs import Run, pieces


class Manifests:
    """Names of published attempts in a folder, one file for each batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.folder, self.files = folder, self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, number: int):
        return self.path(f"{self.folder}/{number:012}.json")

    def has(self, number: int) -> bool:
        return self.files.exists(self._file(number))

    def publish(self, number: int, attempt: str) -> None:
        """Names ``attempt`` for a batch; the file is written whole beside its place and then renamed."""
        beside = self.path(f"{self.folder}/.{attempt}.tmp")
        out = self.files.create(beside, True)
        out.write(bytearray(json.dumps({"batch": number, "attempt": attempt}).encode()))
        out.close()
        if not self.files.rename(beside, self._file(number)):
            raise OSError(f"batch {number} can't be published")


def worker(spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Does ``work`` on the tasks of a batch and publishes what it gives, unless the batch has been published."""

    def attempt(batch: DataFrame, number: int) -> None:
        manifests = Manifests(spark, f"{folder}/manifests")
        if manifests.has(number):
            return
        name = f"{number}-{uuid.uuid4().hex}"
        work(batch).write.parquet(f"{folder}/attempts/{name}")
        manifests.publish(number, name)

    return attempt


def results(spark: SparkSession, folder: str) -> DataFrame:
    """The results of published attempts."""
    named = [r.attempt for r in spark.read.schema("batch long, attempt string").json(f"{folder}/manifests").select("attempt").collect()]
    return spark.read.parquet(*(f"{folder}/attempts/{n}" for n in sorted(named)))


def tasks(rows: DataFrame) -> DataFrame:
    """rows: lines of text. task (a long) and body of each line; a line that is no object with a number as task has the
    error ``bad_task`` and no task."""
    task = F.get_json_object("value", "$.task").try_cast("long")
    return rows.select(task.alias("task"), F.when(task.isNotNull(), F.get_json_object("value", "$.body")).alias("body"), F.when(task.isNull(), "bad_task").alias("error"))


def queue(spark: SparkSession) -> Run:
    """A queue of lines of text; ``put`` adds files, ``go(worker(...))`` takes what has come."""
    return Run(spark, "value string", tasks, "text")


def worked(spark: SparkSession, lines: DataFrame, order: str, work: Callable[[DataFrame], DataFrame], n: int = 2) -> DataFrame:
    """Results of ``work`` on lines (value and order) that come in n parts."""
    run = queue(spark)
    for piece in pieces(run, lines, order, n):
        run.put(piece.select("value"))
        run.go(worker(run.spark, run.folder, work))
    return results(spark, run.folder)
