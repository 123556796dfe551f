"""Queries by streams: tables arrive as messages or events in parts, and each part is read by a run of the stream that
picks up from the checkpoint of the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolake.plans.timeline import query
from chronolake.sources import tables as S
from chronolake.streaming import alerts, directory, life, messages, queues, runs, uploads

START_S = 1_704_067_200  # 2024-01-01
CHUNK = 1000


def _at(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds + START_S)


def _rows(schema: str, rows: DataFrame) -> DataFrame:
    """rows with the columns of schema, those that it lacks null."""
    pairs = [f.split() for f in schema.split(", ")]
    return rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in pairs))


def upload_messages(docs: DataFrame) -> DataFrame:
    """Texts of docs as uploads in chunks: those of odd ids come from behind, each first chunk is sent twice, that of even
    ids spoilt before, every seventh lacks its last, every eleventh has a wrong hash and every fifth meets a full queue."""
    i = F.col("doc_id")
    docs = docs.select("doc_id", F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("bin")).withColumn("whole", F.md5("bin"))
    docs = docs.withColumns({"size": F.octet_length("bin").cast("long"), "total": F.ceil(F.octet_length("bin") / CHUNK).cast("int"), "pool": i % 8, "upload": i, "start": i * 7})
    last = F.col("total") * 3 + 1
    opened = docs.select("pool", "upload", F.lit("open").alias("kind"), "total", F.lit(CHUNK).alias("chunk_bytes"), "size", F.when(i % 11 == 0, "wrong").otherwise(F.col("whole")).alias("md5"), F.col("start").alias("s"), F.lit(0).alias("step"))
    sent = docs.filter("total > 0").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("total") - 1)))
    sent = sent.withColumn("idx", F.when(i % 2 == 1, F.col("total") - 1 - F.col("p")).otherwise(F.col("p"))).filter(~((i % 7 == 0) & (F.col("p") == F.col("total") - 1)))
    sent = sent.withColumn("data", F.substring("bin", F.col("idx") * CHUNK + 1, F.lit(CHUNK))).withColumn("hash", F.md5("data"))

    def chunk(rows: DataFrame, hash_: Column, step: int) -> DataFrame:
        return rows.select("pool", "upload", F.lit("chunk").alias("kind"), "idx", "data", hash_.alias("md5"), (F.col("start") + 1 + 3 * F.col("p") + step).alias("s"), (1 + 3 * F.col("p") + step).alias("step"))

    chunks = chunk(sent.filter((i % 2 == 0) & (F.col("p") == 0)), F.lit("spoilt"), 0).unionByName(chunk(sent, F.col("hash"), 1)).unionByName(chunk(sent.filter("p = 0"), F.lit(None).cast("string"), 2))

    def later(rows: DataFrame, kind: str, after: int, full: Column) -> DataFrame:
        return rows.select("pool", "upload", F.lit(kind).alias("kind"), full.alias("full"), (F.col("start") + last + after).alias("s"), (last + after).alias("step"))

    whole = docs.filter((i % 7 != 0) & (F.col("total") > 0))
    none, refused = F.lit(None).cast("boolean"), i % 5 == 0
    asked = later(whole, "queue", 10, refused).unionByName(later(whole.filter(refused), "finalize", 20, none)).unionByName(later(whole.filter(refused), "queue", 30, F.lit(False))).unionByName(later(whole, "finalize", 40, none))
    rest = docs.agg(F.max(F.col("start") + last).alias("s")).filter("s is not null").select((F.col("s") + 100_000).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pool"), F.lit("ping").alias("kind"), F.lit(0).alias("step"))
    rows = opened.unionByName(chunks, True).unionByName(asked, True).unionByName(rest, True)
    return _rows(uploads.MESSAGE, rows.withColumns({"at": _at(F.col("s")), "seq": F.coalesce("upload", F.lit(0)) * 1_000_000 + F.col("step")}))


@query("""with d as (select doc_id, octet_length(encode(coalesce(text, ''))) as size, ceil(octet_length(encode(coalesce(text, ''))) / 1000.0)::bigint as total, md5(coalesce(text, '')) as whole from documents),
o as (select *, case when total = 0 then 'chunked_upload_error' when doc_id % 7 = 0 then 'expired' when doc_id % 11 = 0 then 'file_hash_mismatch' else 'upload_complete' end as outcome from d),
p as (select *, outcome = 'upload_complete' as done, total - case when doc_id % 7 = 0 and total > 0 then 1 else 0 end as n from o)
select doc_id, outcome, n as received, case when n = 0 or (n = 1 and outcome = 'file_hash_mismatch') then 0 else 1 end as duplicates, case when n > 0 and doc_id % 2 = 0 then 1 else 0 end as spoilt,
case when done and doc_id % 5 = 0 then 1 else 0 end as refused, case when done then 1 else 0 end as asked_again,
case when outcome = 'file_hash_mismatch' then case when doc_id % 5 = 0 then 4 else 2 end + case when n = 1 then 1 else 0 end else 0 end as not_found,
case when done then size end as size, case when done then whole end as md5 from p""")
def upload_stream(spark, d) -> DataFrame:
    """All documents, uploaded in chunks to eight pools and put together in state."""
    sent = upload_messages(S.table(spark, d, "documents")).withColumn("s", F.unix_timestamp("at"))
    answers = runs.replay(spark, sent, "s", lambda rows: uploads.upload_sessions(rows.drop("s"), most=1_000_000))
    count = {"received": "received", "duplicates": "duplicate", "spoilt": "chunk_hash_mismatch", "refused": "queue_full", "asked_again": "status", "not_found": "session_not_found"}
    ends = F.col("answer").isin("chunked_upload_error", "expired", "file_hash_mismatch", "upload_complete")
    return answers.groupBy(F.col("upload").alias("doc_id")).agg(F.max(F.when(ends, F.col("answer"))).alias("outcome"), *(F.count_if(F.col("answer") == a).alias(n) for n, a in count.items()), F.max("size").alias("size"), F.max("md5").alias("md5"))


@query("""with recursive e as (select user_id as queue, event_id as event, event_type in ('view', 'signup') as submit, value as seconds, event_id % 13 = 0 as refused, row_number() over (partition by user_id order by event_id) as k from events where user_id is not null),
f as (select *, submit and refused as no, case when not submit and seconds > 0 then seconds end as v from e),
r as (select queue, event, k, case when submit and not no then 1 else 0 end::bigint as depth, not no as ok, 90.0::double as est, 0::bigint as before, submit, v as ema from f where k = 1
 union all select f.queue, f.event, f.k, case when f.submit and not f.no and r.depth < 3 then r.depth + 1 when f.submit then r.depth else greatest(r.depth - 1, 0) end, not f.submit or (not f.no and r.depth < 3), coalesce(r.ema, 90.0), r.depth, f.submit,
 case when f.v is null then r.ema when r.ema is null then f.v else 0.3::double * f.v + (1 - 0.3::double) * r.ema end from r join f on f.queue = r.queue and f.k = r.k + 1)
select queue, event, depth, ok as admitted, case when not ok then greatest(1, floor(est / 2)::bigint) end as retry_after, case when submit and ok then floor(before / 2.0::double * est)::bigint end as wait, round(ema, 6) as ema from r""")
def admission_stream(spark, d) -> DataFrame:
    """Events as a queue for each user: views and signups are submits, others have finished."""
    kind = F.when(F.col("event_type").isin("view", "signup"), "submit").otherwise("finish")
    events = S.table(spark, d, "events").select(F.col("user_id").alias("queue"), F.col("event_id").alias("event"), kind.alias("kind"), F.col("value").alias("seconds"), (F.col("event_id") % 13 == 0).alias("refused"))
    return runs.replay(spark, events, "event", lambda rows: queues.admissions(rows, 3, 2)).withColumn("ema", F.round("ema", 6))


def raw_messages(docs: DataFrame) -> DataFrame:
    """A message for each of docs, its type by its id: all types, with and without what they require, and spoilt ones."""
    i = F.col("doc_id")
    task = F.when(i % 17 > 0, F.concat(F.lit("t"), i))
    chunk = F.struct(task.alias("task_id"), F.when(i % 19 > 0, i % 5).alias("chunk_index"), F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("chunk_data"))
    asked = F.struct(F.concat(F.lit("f"), i, F.lit(".wav")).alias("file_name"), F.col("n_chars").alias("file_size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("file_hash"), F.when(i % 5 == 0, "xml").alias("output_format"))
    whole = F.struct(task.alias("task_id"), F.col("text").alias("file_data"))
    data = {"ping": F.struct(i.cast("string").alias("sent_at")), "upload_request": asked, "upload_data": whole, "upload_chunk": chunk, "finalize_upload": F.struct(task.alias("task_id"), F.when(i % 5 == 0, F.array(F.lit("x"))).alias("terms")), "task_status": F.struct(task.alias("task_id")), "task_status_batch": F.struct(F.when(i % 17 > 0, F.array(F.lit("a"), i.cast("string"))).alias("task_ids")), "cancel_task": F.struct(task.alias("task_id"))}
    body = F.when(i % 11 == 8, F.concat(F.lit("{"), F.coalesce("text", F.lit("")))).when(i % 11 == 9, F.lit('{"type": "shout", "data": {}}')).when(i % 11 == 10, F.to_json(F.array(i)))
    for k, (name, value) in enumerate(data.items()):
        body = body.when(i % 11 == k, F.to_json(F.struct(F.lit(name).alias("type"), value.alias("data"))))
    return docs.select(i.alias("id"), body.alias("body"))


@query("""with d as (select doc_id as id, doc_id % 11 as k, text, n_chars, case when doc_id % 17 > 0 then 't' || doc_id end as task from documents),
m as (select *, case k when 0 then 'ping' when 1 then 'upload_request' when 2 then 'upload_data' when 3 then 'upload_chunk' when 4 then 'finalize_upload' when 5 then 'task_status' when 6 then 'task_status_batch' when 7 then 'cancel_task' end as t,
case when k = 8 then 'invalid_json' when k = 9 then 'unknown_message_type' when k = 10 then 'message_error' when k = 1 then case when id % 5 = 0 then 'invalid_format' when n_chars is null then 'upload_error' end
 when k = 4 and id % 5 = 0 then 'protocol_error' when k in (2, 4, 5, 7) and task is null then 'missing_task_id' when k = 3 and (task is null or id % 19 = 0) then 'missing_chunk_data' when k = 6 and id % 17 = 0 then 'missing_task_ids' end as error from d)
select id, case when error is null then t else 'dead' end as route, error, case when error is not null or k = 0 then null when k = 1 then md5(coalesce(text, '')) when k = 6 then 'a,' || id else task end as value,
case when error is null and k = 1 then n_chars when error is null and k = 2 then length(text) when error is null and k = 3 then id % 5 end as number from m""")
def message_stream(spark, d) -> DataFrame:
    """All documents as messages, each in the table of its type or among the dead."""
    tables = messages.dispatched(spark, raw_messages(S.table(spark, d, "documents")))
    value = {"upload_request": "file_hash", "task_status_batch": "array_join(task_ids, ',')", "ping": "cast(null as string)", messages.DEAD: "cast(null as string)"}
    number = {"upload_request": "file_size", "upload_data": "length(file_data)", "upload_chunk": "chunk_index"}
    found = [t.selectExpr("id", f"'{n}' as route", "error" if n == messages.DEAD else "cast(null as string) as error", f"{value.get(n, 'task_id')} as value", f"cast({number.get(n, 'null')} as bigint) as number") for n, t in tables.items()]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def life_events(orders: DataFrame) -> DataFrame:
    """Orders as tasks: a quarter ends well, one fails again and again, one never ends and one is cancelled."""
    k = F.col("o_orderkey")
    steps = {
        0: [(0, "create", None), (5, "start", None), (30, "done", None), (40, "cancel", None)],
        1: [(0, "create", None), (5, "start", None), (10, "error", "model_error"), (12, "start", None), (20, "error", "engine_error"), (22, "start", None), (30, "error", "model_error"), (31, "done", None)],
        2: [(0, "create", None), (5, "start", None), (4000, "done", None)],
        3: [(0, "create", None), (3, "cancel", None), (5, "start", None)],
    }
    rows = [F.array(*(F.struct(F.lit(s).alias("after"), F.lit(kind).alias("kind"), F.lit(e).cast("string").alias("error")) for s, kind, e in x)) for x in steps.values()]
    own = F.when(k % 4 == 0, rows[0]).when(k % 4 == 1, rows[1]).when(k % 4 == 2, rows[2]).otherwise(rows[3])
    events = orders.select((k % 16).alias("shard"), k.alias("task"), F.posexplode(own).alias("n", "e")).select("shard", "task", "n", "e.*")
    rest = orders.agg(F.max(k).alias("task")).filter("task is not null").select(F.explode(F.sequence(F.lit(0), F.lit(15))).alias("shard"), F.lit(0).alias("n"), (F.col("task") + 100_000).alias("after"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("error"))
    rows = events.withColumn("after", F.col("after") + F.col("task")).unionByName(rest, True)
    return _rows(life.EVENT, rows.withColumns({"at": _at(F.col("after")), "seq": F.coalesce("task", F.lit(0)) * 10 + F.col("n")}))


@query("""with t as (select o_orderkey as task, o_orderkey % 4 as k, o_orderkey + 1704067200 as s from orders),
e as (select *, case k when 0 then s + 30 when 1 then s + 30 when 2 then (s + 5 + 3600) // 60 * 60 + 60 else s + 3 end as over from t)
select task, case k when 0 then 'completed' when 1 then 'failed' when 2 then 'timed_out' else 'cancelled' end as status, case k when 0 then 'done' when 1 then 'model_error' when 2 then 'watchdog' else 'cancel' end as reason,
case when k = 1 then 2 else 0 end as retries, over as ended_s, (over + 3600) // 60 * 60 + 60 as evicted_s, case k when 0 then 3 when 1 then 7 when 2 then 3 else 2 end as changes from e""")
def task_life_stream(spark, d) -> DataFrame:
    """The end of each task, and when it is evicted."""
    events = life_events(S.table(spark, d, "orders")).withColumn("s", F.unix_timestamp("at"))
    limits = life.Limits(kept=1_000_000)
    changes = runs.replay(spark, events, "s", lambda rows: life.task_life(rows.drop("s"), limits))
    over, gone = F.col("status").isin(*life.ENDED), F.col("status") == "evicted"
    end = F.max(F.when(over, F.struct("status", "reason", "retries", F.unix_timestamp("at").alias("ended_s")))).alias("end")
    out = changes.groupBy("task").agg(end, F.max(F.when(gone, F.unix_timestamp("at"))).alias("evicted_s"), F.count_if(~gone).alias("changes"))
    return out.select("task", "end.*", "evicted_s", "changes")


def probe_rows(events: DataFrame) -> DataFrame:
    """Events as probes of twenty servers, each followed by what has become of its alerts."""
    i = F.col("event_id")
    probe = events.select((F.col("user_id") % 20).alias("server"), F.col("ts").alias("at"), (i * 10).alias("seq"), F.lit("probe").alias("kind"), (F.col("event_type") != "error").alias("reachable"), F.when(i % 3 > 0, "healthy").alias("health"), (i % 4 > 0).alias("metrics"), (i % 11).cast("double").alias("queue"), F.lit(10.0).alias("queue_max"), F.floor(i / 40).cast("double").alias("errors"))
    rules = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(r).alias("rule")) for n, r in enumerate((alerts.DOWN, alerts.FULL, alerts.SURGE))))
    back = events.select((F.col("user_id") % 20).alias("server"), F.col("ts").alias("at"), i.alias("i"), F.explode(rules).alias("r")).select("server", "at", (F.col("i") * 10 + 1 + F.col("r.n")).alias("seq"), F.lit("delivery").alias("kind"), "r.rule", ((F.col("i") + F.col("r.n")) % 3 > 0).alias("delivered"))
    return _rows(alerts.ROW, probe.unionByName(back, True))


@query()
def alert_stream(spark, d) -> DataFrame:
    """Alerts of all probes; a third of them isn't delivered."""
    rows = probe_rows(S.table(spark, d, "events")).withColumn("s", F.unix_timestamp("at"))
    return runs.replay(spark, rows, "s", lambda x: alerts.alert_loop(x.drop("s"), alerts.Thresholds(surge=2.0, cooldown_s=7200.0)))


@query("""select case when doc_id % 13 > 0 then doc_id end as task, case when doc_id % 13 = 0 then 'bad_task' end as error, case when doc_id % 13 > 0 then md5(coalesce(text, '')) end as hash, case when doc_id % 13 > 0 then length(coalesce(text, '')) end as size from documents""")
def directory_queue(spark, d) -> DataFrame:
    """Documents as tasks in files of a folder; every thirteenth line can't be read."""
    i = F.col("doc_id")
    line = F.when(i % 26 == 0, "no task").when(i % 13 == 0, '{"task": "x"}').otherwise(F.to_json(F.struct(i.alias("task"), F.coalesce("text", F.lit("")).alias("body"))))
    work = lambda rows: rows.select("task", "error", F.md5(F.col("body").cast("binary")).alias("hash"), F.length("body").cast("long").alias("size"))
    return directory.worked(spark, S.table(spark, d, "documents").select(i, line.alias("value")), "doc_id", work)
