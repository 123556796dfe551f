"""The keyed result cache and the life of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled", "timed_out")


def variant_key(engine: Column, word_align: Column, language: Column, diarize: Column, srt: Column) -> Column:
    """Cache key of a variant: qwen3[+wa:language][+nospk]; other engines as they are; SRT never has words."""
    words = F.when(word_align & ~srt, F.concat(F.lit("+wa:"), language)).otherwise("")
    return F.when(engine == "qwen3", F.concat(engine, words, F.when(diarize, "").otherwise("+nospk"))).otherwise(engine)


def lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests: req_id, file_hash, engine. The row of the exact key, else that of the key without +nospk, else the
    newest of a bare engine if the key is bare; null without any."""
    newest_first = F.min(F.struct((-F.col("created_min")).alias("age"), (-F.col("id")).alias("no"))).alias("m")
    have = cache.groupBy("file_hash", F.col("engine").alias("have")).agg(newest_first).select("file_hash", "have", (-F.col("m.no")).alias("id"), (-F.col("m.age")).alias("created_min"))
    r = requests.alias("r").join(have, "file_hash", "left")
    base = F.regexp_replace("engine", "\\+nospk$", "")
    rank = F.when(F.col("have") == F.col("engine"), 1).when(F.col("have") == base, 2).when(~F.col("engine").contains("+") & ~F.col("have").contains("+"), 3)
    best = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), (-F.col("created_min")).alias("age"), (-F.col("id")).alias("no"), F.col("have").alias("have"))))
    return r.groupBy("req_id").agg(best.alias("b")).select("req_id", (-F.col("b.no")).alias("id"), F.col("b.have").alias("engine"), F.col("b.rank").cast("long").alias("rank"))


def newest(cache: DataFrame) -> DataFrame:
    """Newest row of a bare engine of each hash (ties: the larger id)."""
    bare = cache.filter(~F.col("engine").contains("+"))
    return bare.groupBy("file_hash").agg(F.max(F.struct("created_min", "id")).alias("m")).select("file_hash", "m.id", "m.created_min")


def expire(cache: DataFrame, cutoff_min: int) -> DataFrame:
    return cache.filter(F.col("created_min") >= cutoff_min)


def least_recently_used(cache: DataFrame, keep: int) -> DataFrame:
    """Rows beyond the ``keep`` most recently used ones: (accessed_min, id) at or before a bound, which a top-k over
    the table finds without sorting it; keep <= 0 evicts nothing."""
    if keep <= 0:
        return cache.limit(0)
    over = cache.orderBy(F.desc("accessed_min"), F.desc("id")).limit(keep).agg(F.min(F.struct("accessed_min", "id")).alias("m"), F.count(F.lit(1)).alias("n"))
    bound = F.broadcast(over)  # one row
    return cache.crossJoin(bound).filter((F.col("n") >= keep) & (F.struct("accessed_min", "id") < F.col("m"))).drop("m", "n")


def stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("engine").agg(F.count(F.lit(1)).alias("total"), F.sum(F.length("result")).alias("chars"))


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new replace those of cache with the same hash and engine."""
    own = ["file_hash", "engine"]
    return cache.join(new.select(own).distinct(), own, "left_anti").unionByName(new)


def first_terminal(events: DataFrame, key: str, order: str) -> DataFrame:
    """Status of each key: its first terminal one, which later events cannot change, else the latest."""
    terminal = F.col("status").isin(*TERMINAL)
    found = events.groupBy(key).agg(F.min(F.when(terminal, F.struct(F.col(order), F.col("task_id"), F.col("status")))).alias("t"), F.max(F.struct(F.col(order), F.col("task_id"), F.col("status"))).alias("l"))
    return found.select(key, F.coalesce("t.status", "l.status").alias("status"), F.col("t").isNotNull().alias("terminal"))


def watchdog(tasks: DataFrame, now: Column, limit_s: int) -> DataFrame:
    """Processing tasks older than the limit become timed_out."""
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    late = (F.col("status") == "processing") & (age > limit_s)
    return tasks.withColumn("status", F.when(late, "timed_out").otherwise(F.col("status")))


def evict(tasks: DataFrame, cutoff: Column, keep: int) -> DataFrame:
    """Terminal tasks before the cutoff, or beyond each file's ``keep`` newest terminal ones; no other task goes."""
    done = tasks.filter(F.col("status").isin(*TERMINAL))
    order = Window.partitionBy("file_hash").orderBy(F.desc("created_at"), F.desc("task_id"))
    return done.withColumn("rank", F.row_number().over(order)).filter((F.col("created_at") < cutoff) | (F.col("rank") > keep)).drop("rank")


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("seconds") > 0, 1).otherwise(0)).alias("timed"))


def alerts(scrapes: DataFrame, key: str, order: str, surge: int) -> DataFrame:
    """Scrapes with the rise of a monotonic counter; the first one is the baseline and never fires."""
    rise = F.col("errors") - F.lag("errors").over(Window.partitionBy(key).orderBy(order))
    return scrapes.withColumn("rise", rise).withColumn("fires", F.coalesce(rise >= surge, F.lit(False)))
