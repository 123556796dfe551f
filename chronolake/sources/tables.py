"""Input tables, and timeline views derived from them. A timeline row has (conv_id, pos): positions carry meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, pos, speaker, text, start_ms, end_ms: turns of conversations on a timeline in milliseconds."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    step = F.length("text") * 10 + 200 + (F.col("turn") % 3) * 1500
    start = F.coalesce(F.sum(step).over(before), F.lit(0)).cast("long")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("speaker"), "text", start.alias("start_ms"))
    return rows.withColumn("end_ms", F.col("start_ms") + F.length("text") * 10)


def two_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segments with speakers that hold two turns each, so that runs can merge."""
    return segments(spark, sf_dir).withColumn("speaker", F.when(F.col("pos") % 4 < 2, "A").otherwise("B"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """two_speakers, later by 700 ms: overlaps segments in part."""
    return two_speakers(spark, sf_dir).select("conv_id", "pos", "speaker", (F.col("start_ms") + 700).alias("start_ms"), (F.col("end_ms") + 700).alias("end_ms"))


def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, file_hash, status, seconds, created_at from events."""
    status = F.create_map(*(F.lit(x) for p in (("click", "completed"), ("view", "processing"), ("signup", "pending"), ("purchase", "cancelled"), ("error", "failed")) for x in p))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.col("user_id").alias("file_hash"), status[F.col("event_type")].alias("status"), F.col("value").alias("seconds"), F.col("ts").alias("created_at"))


def cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file_hash, engine, result, created_min, accessed_min (minutes) from documents."""
    engine = F.element_at(F.array(*map(F.lit, ("funasr", "qwen3", "qwen3+nospk", "qwen3+wa:chi"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5((F.col("doc_id") % 53).cast("string").cast("binary")).alias("file_hash"), engine.alias("engine"), F.col("text").alias("result"), F.col("doc_id").alias("created_min"), ((F.col("doc_id") * 7919) % 100003).alias("accessed_min"))


#: The same views for DuckDB.
SEGMENTS_SQL = """seg as (select conv_id, turn as pos, role as speaker, text, coalesce(sum(length(text) * 10 + 200 + (turn % 3) * 1500)
  over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as start_ms,
  (coalesce(sum(length(text) * 10 + 200 + (turn % 3) * 1500) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)
  + length(text) * 10)::bigint as end_ms from conversations),
seg2 as (select conv_id, pos, case when pos % 4 < 2 then 'A' else 'B' end as speaker, text, start_ms, end_ms from seg),
turns as (select conv_id, pos, speaker, start_ms + 700 as start_ms, end_ms + 700 as end_ms from seg2)"""
TASKS_SQL = """tasks as (select event_id as task_id, user_id as file_hash, case event_type when 'click' then 'completed' when 'view' then 'processing'
  when 'signup' then 'pending' when 'purchase' then 'cancelled' when 'error' then 'failed' end as status, value as seconds, ts as created_at from events)"""
CACHE_SQL = """cache as (select doc_id as id, md5((doc_id % 53)::varchar) as file_hash,
  case doc_id % 4 when 0 then 'funasr' when 1 then 'qwen3' when 2 then 'qwen3+nospk' else 'qwen3+wa:chi' end as engine,
  text as result, doc_id as created_min, (doc_id * 7919) % 100003 as accessed_min from documents)"""
