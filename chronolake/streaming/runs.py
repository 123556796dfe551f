"""Runs of streams over arrivals: each run picks up from the checkpoint of the one before."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, on one machine only, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='chronolake-')}"
    return f"{root.rstrip('/')}/streams/{uuid.uuid4().hex}"


def stateful(spark: SparkSession) -> SparkSession:
    """A session of its own for streams with map state and timers, so the caller's settings stay as they are."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return own


class Run:
    """A stream of the files of a folder to another one, with its checkpoint beside them."""

    def __init__(self, spark: SparkSession, schema, build: Callable[[DataFrame], DataFrame], kind: str = "parquet"):
        self.folder, self.spark, self.schema, self.build, self.kind = shared_folder(spark), stateful(spark), schema, build, kind

    def put(self, arrivals: DataFrame) -> None:
        arrivals.write.mode("append").format(self.kind).save(f"{self.folder}/in")

    def go(self, write: Callable[[DataFrame, int], None] | None = None) -> None:
        """Reads all that has arrived since, in one batch or more, and stops. Each batch is given to ``write`` with its
        number. Without it, batches are appended to a folder whose log names the files of finished batches, so one
        that is run again publishes its rows once."""
        rows = self.build(self.spark.readStream.schema(self.schema).format(self.kind).load(f"{self.folder}/in"))
        sink = rows.writeStream.outputMode("append").option("checkpointLocation", f"{self.folder}/state")
        sink = sink.foreachBatch(write) if write else sink.format("parquet").option("path", f"{self.folder}/out")
        sink.trigger(availableNow=True).start().awaitTermination()

    def published(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/out")


def pieces(run: Run, arrivals: DataFrame, order: str, n: int) -> list[DataFrame]:
    """arrivals, written once beside the run, in n parts by ranges of ``order``; equal values stay together, and a null
    order comes first."""
    arrivals.write.parquet(f"{run.folder}/all")
    arrivals = arrivals.sparkSession.read.schema(arrivals.schema).parquet(f"{run.folder}/all")
    bounds = arrivals.approxQuantile(order, [k / n for k in range(1, n)], 0.01) if n > 1 else []
    piece = sum(((F.coalesce(F.col(order), F.lit(-(2**62))) > b).cast("int") for b in bounds), F.lit(0))
    return [arrivals.filter(piece == k) for k in range(n)]


def replay(spark: SparkSession, arrivals: DataFrame, order: str, build: Callable[[DataFrame], DataFrame], n: int = 3) -> DataFrame:
    """What a stream publishes for arrivals that come in n parts, ``order`` by ``order``. The stream is stopped after each part and
    started again from its checkpoint, so the result must not depend on where it was cut."""
    run = Run(spark, arrivals.schema, build)
    for piece in pieces(run, arrivals, order, n):
        run.put(piece)
        run.go()
    return run.published(spark)
