"""The service around the engine: uploads, queues, retries, alert states, files and status answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators.ordered import ordered_pass
from chronolake.operators.results import TERMINAL


def assemble(chunks: DataFrame, uploads: DataFrame, chunk_bytes: int) -> DataFrame:
    """chunks: upload, idx, data, md5; uploads: upload, total, size, md5. Chunks out of bounds, of a wrong length or with a wrong
    hash are left out, and repeated ones count once. data: all chunks in order, null until all are there; valid: length and hash agree."""
    whole = chunks.join(uploads.select("upload", "total", "size"), "upload")
    last = F.col("idx") == F.col("total") - 1
    length = F.when(last, F.col("size") - last.cast("long") * chunk_bytes * (F.col("total") - 1)).otherwise(chunk_bytes)
    good = whole.filter((F.col("idx") >= 0) & (F.col("idx") < F.col("total")) & (F.octet_length("data") == length) & (F.md5("data") == F.lower("md5")))
    one = good.groupBy("upload", "idx").agg(F.min("data").alias("data"))
    parts = one.groupBy("upload").agg(F.count(F.lit(1)).alias("received"), F.sort_array(F.collect_list(F.struct("idx", "data"))).alias("p"))
    rows = uploads.join(parts, "upload", "left").withColumn("received", F.coalesce("received", F.lit(0)))
    joined = F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["data"]))
    rows = rows.withColumn("data", F.when(F.col("received") == F.col("total"), joined))
    return rows.select("upload", "received", "total", "data", ((F.octet_length("data") == F.col("size")) & (F.md5("data") == F.lower("md5"))).alias("valid"))


def admitted(events: DataFrame, most: int, key: str, order: str) -> DataFrame:
    """events: key, order, kind (submit or finish). Submits are refused while ``most`` are waiting; a finish frees a place. The depth
    depends on earlier refusals, so each queue's events are folded in order (in Catalyst)."""
    row = F.struct(F.col(order).alias("o"), F.col("kind").alias("kind"))
    rows = events.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("e"))
    kind = "array<struct<o:bigint,depth:int,ok:boolean>>"

    def step(s: Column, x: Column) -> Column:
        depth = F.coalesce(F.try_element_at(s, F.lit(-1))["depth"], F.lit(0))
        submit = x["kind"] == "submit"
        ok = ~submit | (depth < most)
        new = F.when(submit & ok, depth + 1).when(submit, depth).otherwise(F.greatest(depth - 1, F.lit(0)))
        return F.concat(s, F.array(F.struct(x["o"].cast("bigint").alias("o"), new.alias("depth"), ok.alias("ok")))).cast(kind)

    return rows.select(key, F.explode(F.aggregate("e", F.array().cast(kind), step)).alias("r")).select(key, F.col("r.o").alias(order), F.col("r.depth").alias("depth"), F.col("r.ok").alias("admitted"))


def retries(attempts: DataFrame, most: int, key: str = "task_id", order: str = "at") -> DataFrame:
    """attempts: key, order, kind (null: success). Attempts up to the first success, the first error that isn't worth a retry, or ``most`` retries."""
    w = Window.partitionBy(key).orderBy(order)
    again = F.col("kind").isin("model_error", "engine_error")
    rows = attempts.withColumn("n", F.row_number().over(w)).withColumn("ends", F.col("kind").isNull() | ~again | (F.col("n") > most))
    stop = F.min(F.when(F.col("ends"), F.col("n"))).over(Window.partitionBy(key))
    used = rows.withColumn("stop", stop).filter("stop is null or n <= stop")
    out = used.groupBy(key).agg((F.max("n") - 1).alias("retries"), F.max_by(F.struct("kind", "ends"), "n").alias("l"))
    return out.select(key, "retries", F.when(~F.col("l.ends"), "pending").when(F.col("l.kind").isNull(), "completed").otherwise("failed").alias("status"))


def alert_states(scrapes: DataFrame, key: str, at: str, firing: str, cooldown: int, recovers: bool = True) -> DataFrame:
    """scrapes: key, at (seconds), firing (null: unknown, the state stays). Notices: fire when a rule begins to hold, again once ``cooldown`` has
    passed since the last notice, recovery when it ends. The last notice depends on earlier ones, so rules are folded in order."""
    def fold(rows):
        since = last = None
        for _, now, on in rows:
            if on is None:
                continue
            if not on:
                if since is not None and recovers:
                    yield now, "recovery"
                since = last = None
            elif since is None or now - last >= cooldown:
                yield now, "fire" if since is None else "repeat"
                since, last = now if since is None else since, now

    rows = scrapes.select(key, F.col(at).cast("long").alias("at"), F.col(firing).alias("firing"))
    return ordered_pass(rows, key, ["at", "firing"], ["at", "firing"], fold, "at long, notice string")


def status_answers(requests: DataFrame, tasks: DataFrame, evicted: DataFrame, most: int = 50) -> DataFrame:
    """requests: req, ids. Status of each request's first ``most`` ids; those evicted are expired, unknown ones not_found."""
    ids = requests.select("req", F.posexplode(F.slice("ids", 1, most)).alias("n", "task_id"))
    rows = ids.join(tasks.select("task_id", "status"), "task_id", "left").join(evicted.select("task_id").distinct().withColumn("gone", F.lit(True)), "task_id", "left")
    return rows.select("req", F.col("n").cast("long").alias("n"), "task_id", F.coalesce("status", F.when(F.col("gone"), "expired"), F.lit("not_found")).alias("status"))


def orphans(files: DataFrame, tasks: DataFrame, now_s: int, grace_s: int) -> DataFrame:
    """files: path, modified_s. Files older than the grace period to which no task refers that is still alive."""
    live = tasks.filter(~F.col("status").isin(*TERMINAL)).select("path").distinct()
    return files.filter(now_s - F.col("modified_s") > grace_s).join(live, "path", "left_anti")


def file_needed(tasks: DataFrame) -> DataFrame:
    """Whether another task that is alive has the same file, by counts of one shuffle."""
    live = (~F.col("status").isin(*TERMINAL)).cast("int")
    others = F.sum(live).over(Window.partitionBy("file_hash")) - live
    return tasks.withColumn("needed", others > 0)


def notices(tasks: DataFrame, connections: DataFrame) -> DataFrame:
    """tasks: task_id, status. One message for each connection (connection, task_id) of a task, of the type that its status asks
    for; a connection that follows a task twice is told once."""
    kind = F.when(F.col("status") == "completed", "task_complete").when(F.col("status") == "failed", "task_error").otherwise("task_progress")
    return connections.select("connection", "task_id").distinct().join(tasks.withColumn("type", kind), "task_id")


def metadata(rows: DataFrame) -> DataFrame:
    """rows: word_align, has_words, language, diarize, cap_s, terms. Options as they took effect: words only where delivered, auto without a language, caps only above 0."""
    words = F.coalesce("word_align", F.lit(False)) & F.coalesce("has_words", F.lit(False))
    language = F.coalesce(F.nullif(F.trim("language"), F.lit("")), F.lit("auto"))
    meta = F.struct(words.alias("word_align"), F.when(words, language).alias("language"), F.coalesce("diarize", F.lit(True)).alias("diarize"), F.when(F.col("cap_s") > 0, F.col("cap_s")).alias("cap_s"))
    return rows.withColumn("metadata", meta).withColumn("cacheable", F.coalesce(F.size("terms"), F.lit(0)) <= 0)


def without_speakers(results: DataFrame) -> DataFrame:
    """results: segments (array of structs with speaker), speakers. Speakers become null and their list empty."""
    return results.withColumns({"segments": F.transform("segments", lambda s: s.withField("speaker", F.lit(None).cast("string"))), "speakers": F.array().cast("array<string>")})
