"""Messages of one stream, routed by their type to a table each; what can't be routed goes to a table of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.streaming.runs import Run, pieces

#: Types of messages and the fields of their data.
TYPES = {
    "ping": "sent_at string",
    "upload_request": "file_name string, file_size bigint, file_hash string, output_format string, upload_mode string, chunk_size int, total_chunks int",
    "upload_data": "task_id string, file_data string",
    "upload_chunk": "task_id string, chunk_index int, chunk_data string, chunk_hash string",
    "finalize_upload": "task_id string",
    "task_status": "task_id string",
    "task_status_batch": "task_ids array<string>",
    "cancel_task": "task_id string",
}
DEAD = "dead"


def _missing(path: str) -> Column:
    """No value, or one that counts as none: null, empty text or an empty list."""
    return F.coalesce(F.get_json_object("body", path), F.lit("")).isin("", "[]", "null")


def routed(raw: DataFrame) -> DataFrame:
    """raw: id, body (text). Adds route, the message's type or ``dead``, and error, why it is dead, else null.

    A body that is null or no JSON is invalid_json, one that is no object message_error, other types are
    unknown_message_type, and data that is no object is message_error where it is read. Required fields are checked as far as the message alone shows.
    """
    value = F.try_parse_json("body")
    kind = F.schema_of_variant(value)
    data = F.coalesce(F.schema_of_variant(F.try_variant_get(value, "$.data", "variant")), F.lit("OBJECT<>"))
    name = F.try_variant_get(value, "$.type", "string")
    lacks = F.when(name == "finalize_upload", F.when(F.get_json_object("body", "$.data.terms").isNotNull(), "protocol_error"))
    lacks = F.coalesce(
        lacks,
        F.when(name.isin("finalize_upload", "task_status", "cancel_task", "upload_data") & _missing("$.data.task_id"), "missing_task_id"),
        F.when((name == "upload_chunk") & (_missing("$.data.task_id") | F.get_json_object("body", "$.data.chunk_index").isNull()), "missing_chunk_data"),
        F.when((name == "task_status_batch") & (_missing("$.data.task_ids") | ~F.coalesce(F.get_json_object("body", "$.data.task_ids").startswith("["), F.lit(False))), "missing_task_ids"),
        F.when((name == "upload_request") & ~F.coalesce(F.get_json_object("body", "$.data.output_format"), F.lit("json")).isin("json", "srt"), "invalid_format"),
        F.when((name == "upload_request") & (_missing("$.data.file_name") | _missing("$.data.file_size") | _missing("$.data.file_hash")), "upload_error"),
    )
    known = F.coalesce(name.isin(*TYPES), F.lit(False))
    error = F.when(value.isNull(), "invalid_json").when(~kind.startswith("OBJECT"), "message_error").when(~known, "unknown_message_type")
    error = error.when((name != "ping") & ~data.startswith("OBJECT"), "message_error").otherwise(lacks)
    return raw.withColumn("error", error).withColumn("route", F.when(F.col("error").isNull(), name).otherwise(DEAD))


def writer(folder: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch of routed messages to a table for each type and one for dead messages. A batch has a folder of
    its own in each, which is written anew if the batch is run again, so no message is there twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for name, fields in TYPES.items():
            own = batch.filter(F.col("route") == name).select("id", F.from_json(F.get_json_object("body", "$.data"), fields).alias("data"))
            own.select("id", "data.*").write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.filter(F.col("route") == DEAD).select("id", "error", "body").write.mode("overwrite").parquet(f"{folder}/{DEAD}/batch={number}")
        batch.unpersist()

    return write


def dispatched(spark: SparkSession, raw: DataFrame, order: str = "id", n: int = 2) -> dict[str, DataFrame]:
    """The tables, by name, that a stream of raw messages (id, body) is written to when it comes in n parts."""
    run = Run(spark, raw.schema, routed)
    for piece in pieces(run, raw, order, n):
        run.put(piece)
        run.go(writer(f"{run.folder}/tables"))
    return {name: spark.read.parquet(f"{run.folder}/tables/{name}") for name in (*TYPES, DEAD)}
