"""Queries on jobs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.functions import rules
from chronolake.operators import evaluation, jobs
from chronolake.plans.timeline import CACHE, SEG, TASKS, query
from chronolake.sources import tables as S


def _hits(spark, d) -> DataFrame:
    """Documents as cached results: every third an SRT, every fourth asked for as one."""
    i, text = F.col("doc_id"), F.col("text")
    srt = F.struct(F.when(i % 3 == 0, "srt").otherwise("txt").alias("format"), (i % 2 == 0).alias("projected"), text.alias("content"), F.when(i % 5 > 0, i % 5 * 1.5).alias("duration"))
    body = F.struct(F.struct((i % 5 == 0).alias("projected"), (i % 7 == 0).alias("segment_merge_applied")).alias("metadata"), F.array(F.length("text")).alias("segments"), (i % 9 * 0.5).alias("duration"), (i % 4 * 0.25).alias("processing_time"))
    asked = F.when(i % 4 == 0, "srt").otherwise("json")
    return S.table(spark, d, "documents").select("doc_id", asked.alias("output_format"), F.when(asked == "srt", F.to_json(srt)).otherwise(F.to_json(body)).alias("body"))


@query("""select doc_id, doc_id % 4 <> 0 or doc_id % 3 = 0 as usable, case when doc_id % 4 = 0 then doc_id % 3 = 0 and doc_id % 2 = 0 else doc_id % 5 = 0 end as projected, doc_id % 4 <> 0 and doc_id % 7 = 0 as merged from documents""")
def cache_hit_metadata(spark, d) -> DataFrame:
    return jobs.hit_metadata(_hits(spark, d)).select("doc_id", "usable", "projected", "merged")


@query("""select doc_id, case when doc_id % 4 = 0 then text end as content, case when doc_id % 4 = 0 then '[]' else '[' || length(text) || ']' end as segments,
case when doc_id % 4 = 0 then doc_id % 5 * 1.5 else doc_id % 9 * 0.5 end::double as duration, case when doc_id % 4 = 0 then 0 else doc_id % 4 * 0.25 end::double as processing_time from documents where doc_id % 4 <> 0 or doc_id % 3 = 0""")
def cache_hit_tasks(spark, d) -> DataFrame:
    return jobs.task_from_hit(_hits(spark, d)).select("doc_id", "content", "segments", "duration", "processing_time")


@query(f"""{CACHE}, r as (select event_id % 997 as id, max(event_id % 100003) as at_min from events group by 1) select cache.id, greatest(accessed_min, at_min) as accessed_min from cache left join r using (id)""")
def cache_touch(spark, d) -> DataFrame:
    reads = S.table(spark, d, "events").select((F.col("event_id") % 997).alias("id"), (F.col("event_id") % 100003).alias("at_min"))
    return jobs.touched(S.cache_rows(spark, d), reads).select("id", "accessed_min")


@query(f"""{CACHE}, t as (select o_orderkey as task_id, md5((o_orderkey % 60)::varchar) as file_hash, o_orderkey % 90 as queued_min, o_orderkey % 90 + o_orderkey % 7 * 10 as start_min from orders),
j as (select task_id, coalesce(bool_or(created_min <= queued_min), false) as known, arg_min(id, (created_min, id)) filter (where created_min > queued_min and created_min <= start_min) as id from t left join cache using (file_hash) group by task_id)
select task_id, case when not known then id end as hit from j""")
def answered_meanwhile(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    tasks = S.table(spark, d, "orders").select(k.alias("task_id"), F.md5((k % 60).cast("string").cast("binary")).alias("file_hash"), (k % 90).alias("queued_min"), (k % 90 + k % 7 * 10).alias("start_min"))
    return jobs.answered_meanwhile(tasks, S.cache_rows(spark, d)).select("task_id", "hit")


@query("""select doc_id, case when n_chars is null or n_chars <= 0 then 'empty_file' when n_chars > 1500 then 'file_too_large' when doc_id % 7 = 0 then 'bad_hash' when doc_id % 5 = 0 then 'invalid_output_format' when doc_id % 3 = 0 then 'invalid_format' end as error,
case doc_id % 3 when 0 then true when 1 then false else doc_id % 2 = 0 end as word_align from documents""")
def request_checks(spark, d) -> DataFrame:
    i = F.col("doc_id")
    digest = F.when(i % 7 == 0, "no digest").otherwise(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    error = jobs.request_error(F.col("n_chars"), digest, F.when(i % 5 == 0, "xml").otherwise("json"), F.when(i % 3 == 0, ".exe").otherwise(".WAV"), 1500, (".wav", ".mp3"))
    asked = F.when(i % 3 == 0, F.lit(True)).when(i % 3 == 1, F.lit(False))
    return S.table(spark, d, "documents").select("doc_id", error.alias("error"), jobs.effective_option(asked, i % 2 == 0).alias("word_align"))


@query("""with t as (select user_id, case when event_id % 3 > 0 then event_id % 5 end as p, event_id % 4 * 30 as w, event_type = 'error' as r from events)
select user_id, count(p) as waiting, count(*) filter (where r) as refused, min(p) filter (where p > 0) as least_queue_position, max(p) filter (where p > 0) as most_queue_position, min(w) filter (where w > 0) as least_wait_s, max(w) filter (where w > 0) as most_wait_s from t group by user_id""")
def waiting_ranges(spark, d) -> DataFrame:
    i = F.col("event_id")
    rows = S.table(spark, d, "events").select("user_id", F.when(i % 3 > 0, i % 5).alias("queue_position"), (i % 4 * 30).alias("wait_s"), (F.col("event_type") == "error").alias("refused"))
    return jobs.waiting_ranges(rows, "user_id")


@query(f"{TASKS} select task_id, row_number() over (partition by status order by created_at, task_id) as value from tasks")
def terminal_counters(spark, d) -> DataFrame:
    return jobs.counters(S.task_rows(spark, d), "status", ["created_at", "task_id"], F.date_trunc("hour", "created_at")).select("task_id", "value")


@query("""with p as (select user_id, event_id, event_type <> 'error' as up, event_id % 3 = 0 as sick, case when event_id % 4 > 0 then event_id * 3 end as errors, event_id % 11 as q, event_id % 2 * 10 as qm from events),
k as (select *, case when up and errors is not null then errors end as e from p), l as (select *, last_value(e ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as b from k)
select event_id, not up or sick as server_down, case when e is not null then qm > 0 and q >= 0.8 * qm end as queue_saturation, e - b >= 600 as error_surge from l""")
def probe_alerts(spark, d) -> DataFrame:
    i = F.col("event_id")
    rows = S.table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("reachable"), F.when(i % 3 != 0, "healthy").alias("health"), (i % 11).alias("queue"), (i % 2 * 10).alias("queue_max"), F.when(i % 4 > 0, i * 3).alias("errors"))
    return jobs.probe_alerts(rows, "user_id", "event_id", 0.8, 600).select("event_id", "server_down", "queue_saturation", "error_surge")


@query("""select user_id, max(event_id) filter (where event_id % 3 > 0) as last, arg_max(event_type, event_id) filter (where event_id % 3 > 0) as name, count(*) filter (where event_id % 3 = 0) as lost from events group by user_id""")
def sent_alerts(spark, d) -> DataFrame:
    rows = S.table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("name"), (F.col("event_id") % 3 > 0).alias("delivered"))
    return jobs.sent_states(rows, "user_id", "event_id")


@query(f"""{SEG}, c as (select conv_id, speaker, sum(end_ms - start_ms) as ms, count(*) as n, min(pos) as first from turns group by 1, 2), t as (select *, sum(ms) over (partition by conv_id) as total from c)
select conv_id, count(*) as clusters, sum(n)::bigint as turns, string_agg(printf('%.2f', round(ms / 1000.0::double, 2)), ',' order by ms desc, first) as seconds, string_agg(printf('%.4f', case when total > 0 then round(ms / total::double, 4) else 0 end), ',' order by ms desc, first) as shares from t group by conv_id""")
def cluster_shares(spark, d) -> DataFrame:
    text = lambda c, n: F.array_join(F.transform(c, lambda x: F.when(x.isNotNull(), F.format_string(f"%.{n}f", x))), ",").alias(c)
    return jobs.cluster_shares(S.turns(spark, d)).select("conv_id", "clusters", "turns", text("seconds", 2), text("shares", 4))


@query(f"""{SEG}, r as (select *, row_number() over (partition by conv_id, speaker order by end_ms - start_ms desc, pos) as a, row_number() over (partition by conv_id order by pos) as b, row_number() over (partition by conv_id order by pos desc) as c from seg2) select conv_id, pos, speaker, a as by_length from r where a <= 2 or b <= 1 or c <= 1""")
def speaker_samples(spark, d) -> DataFrame:
    return jobs.samples(S.two_speakers(spark, d), 2, 1).select("conv_id", "pos", "speaker", F.col("by_length").cast("long").alias("by_length"))


@query(f"""{SEG} select conv_id, pos, pos % 2 = 0 and sum((pos % 2 = 0)::int) over (partition by conv_id order by pos) <= 2 as runs from seg""")
def first_runnable(spark, d) -> DataFrame:
    rows = S.segments(spark, d).select("conv_id", F.col("pos").alias("chunk"), (F.col("pos") % 2 == 0).alias("runs"))
    return jobs.first_runnable(rows, 2).select("conv_id", F.col("chunk").alias("pos"), "runs")


@query(f"""{SEG}, n as (select conv_id, pos, speaker, regexp_replace(lower(nfc_normalize(text)), '[\\p{{P}}\\p{{Z}}\\p{{S}}\\x{{FEFF}}\\n\\r\\t]', '', 'g') as t, row_number() over (partition by conv_id order by pos) - 1 as segment from seg), b as (select *, coalesce(sum(length(t)) over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding), 0) as before from n),
c as (select *, unnest(range(0, length(t))) as i from b where t <> '') select conv_id, (before + i)::bigint as n, substr(t, i + 1, 1) as ch, speaker, segment from c""")
def hypothesis_chars(spark, d) -> DataFrame:
    return jobs.hypothesis(S.segments(spark, d), evaluation.plain(F.col("text"))).withColumn("segment", F.col("segment").cast("long"))


@query(f"""{SEG}, a as (select conv_id, (max(end_ms) + 1000) / 1000.0::double as audio, count(*) as n, string_agg(distinct speaker, ',' order by speaker) as speakers from seg group by 1), w as (select conv_id, sum((end_ms - start_ms) / 1000.0::double) as done, count(*) as windows from seg where pos % 2 = 0 group by 1)
select conv_id, round(n * 0.5 / audio, 6) as rtf_audio, round(case when coalesce(done, 0) = 0 then 0 else n * 0.5 / done end, 6) as rtf_processed, coalesce(windows, 0) as windows, n as segments, speakers from a left join w using (conv_id)""")
def run_summaries(spark, d) -> DataFrame:
    rows = S.segments(spark, d)
    runs = rows.groupBy("conv_id").agg(((F.max("end_ms") + 1000) / 1000).alias("audio_s"), (F.count(F.lit(1)) * 0.5).alias("elapsed_s"))
    windows = rows.filter("pos % 2 = 0").select("conv_id", ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("processed_s"))
    out = jobs.run_summary(runs, windows, rows)
    return out.withColumns({"rtf_audio": F.round("rtf_audio", 6), "rtf_processed": F.round("rtf_processed", 6), "speakers": F.array_join("speakers", ",")})


@query("""select doc_id, sha256('{"engine":"' || lang || '","features":{"terms":' || (doc_id % 2 = 0)::varchar || '},"runtime":"r' || doc_id % 3 || '","schema_version":1}') as capability, left(sha256(coalesce(text, '')), 16) as reference,
text ~ '^[一-鿿]' as cjk, case when doc_id % 4 > 0 then 'Terms:' || chr(10) || 'a' || doc_id || chr(10) || 'b' end as prompt, case doc_id % 3 when 0 then 'bad ' || doc_id end as align_error from documents""")
def small_functions(spark, d) -> DataFrame:
    i = F.col("doc_id")
    number = i.cast("string")
    terms = F.when(i % 4 > 0, F.array(F.concat(F.lit("a"), number), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    object_ = F.concat(F.lit('{"word_align":{"error":"bad '), number, F.lit('"}}'))
    raw = F.when(i % 3 == 0, object_).when(i % 3 == 1, F.concat(F.lit("["), object_, F.lit("]"))).otherwise('{"word_align":null}')
    return S.table(spark, d, "documents").select(
        "doc_id",
        jobs.capability_id(F.col("lang"), F.concat(F.lit("r"), (i % 3).cast("string")), i % 2 == 0, 1).alias("capability"),
        jobs.log_reference(F.coalesce("text", F.lit(""))).alias("reference"),
        jobs.is_cjk(F.col("text")).alias("cjk"),
        jobs.prompt("Terms:\n", terms).alias("prompt"),
        jobs.align_error(raw).alias("align_error"),
    )


@query("""select event_id, floor(least(10 + coalesce(value, 0) / ((event_id % 50 + 1) / 10.0::double) * 80, 85))::int as percent, least(5 + event_id % 40 * 3, 95)::int as beat from events""")
def progress_curves(spark, d) -> DataFrame:
    rows = S.table(spark, d, "events")
    return rows.select("event_id", jobs.progress(F.coalesce("value", F.lit(0.0)), F.col("event_id") % 50 + 1).alias("percent"), jobs.heartbeat(F.col("event_id") % 40).cast("int").alias("beat"))


@query("""select event_id, case when event_id % 7 <> 1 then (event_id % 90)::bigint + 7 end as used, case when event_id % 3 > 0 then event_id % 1000 end::int as free from events""")
def memory_logs(spark, d) -> DataFrame:
    i = F.col("event_id")
    log = F.concat((i + 1).cast("string"), F.lit(", 5\n\n "), i.cast("string"), F.lit(", "), (i % 90).cast("string"), F.lit("\n"), i.cast("string"), F.lit(",7\n"), F.when(i % 14 == 1, "[N/A], 5\n").when(i % 14 == 8, "none\n").otherwise(""))
    free = F.when(i % 3 > 0, F.concat(F.lit(" "), (i % 1000).cast("string"), F.lit(" \n9\n"))).otherwise("[N/A]\n9")
    return S.table(spark, d, "events").select("event_id", jobs.process_memory(log, i).alias("used"), jobs.free_memory(free).alias("free"))


@query("""select doc_id, case when doc_id % 5 = 0 then 'p' else coalesce('f' || case when doc_id % 2 = 0 then doc_id end, 'd') end as engine, case when doc_id % 3 = 0 then 'e' when doc_id % 5 = 0 then null else 'd' end as model,
case when doc_id % 7 = 0 then 'off' end as cache, case when doc_id % 7 > 0 then '9' end as cache_size, 3 as keys from documents""")
def layered_settings(spark, d) -> DataFrame:
    """Defaults, a file, a profile and the environment of each document."""
    i, text = F.col("doc_id"), lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    empty = F.create_map().cast("map<string,string>")
    file = F.map_concat(F.when(i % 2 == 0, text("asr.engine", F.concat(F.lit("f"), i.cast("string")), "asr._comment_engine", "no")).otherwise(empty), F.when(i % 7 == 0, text("cache", "off")).otherwise(empty))
    chosen = jobs.profile(F.when(i % 5 == 0, " Server").when(i % 5 == 1, "unknown").otherwise(""), {"server": {"asr.engine": "p", "asr.model": None}, "laptop": {"asr.engine": "l"}})
    environment = F.when(i % 3 == 0, text("asr.model", "e")).otherwise(empty)
    out = jobs.without_comments(jobs.layered(text("asr.engine", "d", "asr.model", "d", "cache.size", "9", "_comment", "x"), file, chosen, environment))
    rows = S.table(spark, d, "documents").select("doc_id", out.alias("m"))
    return rows.select("doc_id", F.col("m")["asr.engine"].alias("engine"), F.col("m")["asr.model"].alias("model"), F.col("m")["cache"].alias("cache"), F.col("m")["cache.size"].alias("cache_size"), F.size("m").alias("keys"))


@query("""select o_orderkey, '| t' || o_orderkey || ' | ' || printf('%.1f', (o_orderkey % 9)::double + 0.25) || ' | ' || printf('%.0f', (o_orderkey % 50)::double) || ' | ' || printf('%.3f', (o_orderkey % 8) / 8.0::double) || ' | ' || o_orderkey % 12 || ' | ' || printf('%.1f', (o_orderkey % 5)::double) || ' | 0.0 |' as row from orders""")
def benchmark_rows(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    meta = F.struct((k % 9 + 0.25).alias("wall"), (k % 50).cast("double").alias("duration"), (k % 8 / 8).alias("rtf"), (k % 12).alias("n_segments"))
    task = F.struct(meta.alias("meta"), F.create_map(F.lit("asr"), (k % 5).cast("double")).alias("totals"))
    body = F.to_json(F.struct(F.create_map(F.concat(F.lit("t"), k.cast("string")), task).alias("tasks")))
    return jobs.benchmark_rows(S.table(spark, d, "orders").select("o_orderkey", body.alias("body")), "body", ["asr", "diarize"]).select("o_orderkey", "row")


@query(f"{TASKS} select task_id, epoch(timestamp '2030-01-01' )::bigint - floor(epoch(case when status = 'completed' then created_at + interval 90 second else created_at end))::bigint as age from tasks")
def task_ages(spark, d) -> DataFrame:
    done = F.when(F.col("status") == "completed", F.col("created_at") + F.expr("interval 90 seconds"))
    return S.task_rows(spark, d).select("task_id", jobs.age_seconds(F.lit("2030-01-01").cast("timestamp"), done, F.col("created_at")).alias("age"))


@query("""with e as (select event_id, event_id % 4 as k, 'dir.x/File' || event_id || case event_id % 3 when 0 then '.WAV' when 1 then '.exe' else '' end as name from events)
select event_id, k in (0, 1) as admitted, case when event_id % 2 = 0 then 'qwen3+nospk' else 'qwen3+wa:eng+nospk' end as saved, k = 0 as any_engine, k = 0 or event_id % 100 >= 50 as headroom,
case event_id % 3 when 0 then '.wav' when 1 then '.exe' else '' end as extension, event_id % 3 = 0 and event_id % 100 <= 60 as file_ok, case k when 0 then 'cuda' when 1 then 'mac_ane' when 2 then case when event_id % 3 = 0 then 'cuda' else 'cpu' end else 'cpu' end as runtime,
floor(greatest(event_id % 9 - 1, 0) / greatest(event_id % 3, 1)::double * 30)::int as wait_s from e""")
def engine_rules(spark, d) -> DataFrame:
    """Each rule on the ids of events: engines, keys, memory, files, platforms and places in a queue."""
    i = F.col("event_id")
    k, text = i % 4, i.cast("string")
    name = F.concat(F.lit("dir.x/File"), text, F.when(i % 3 == 0, ".WAV").when(i % 3 == 1, ".exe").otherwise(""))
    return S.table(spark, d, "events").select(
        "event_id",
        rules.engine_admitted(F.when(k == 0, " ").when(k == 1, "qwen3").otherwise("funasr"), F.lit("qwen3")).alias("admitted"),
        rules.save_key(F.lit("qwen3+wa:eng+nospk"), i % 2 != 0).alias("saved"),
        rules.cross_engine(F.when(k == 0, "qwen3").otherwise("qwen3+nospk")).alias("any_engine"),
        rules.headroom(F.when(k > 0, i % 100), F.lit(50)).alias("headroom"),
        rules.extension(name).alias("extension"),
        rules.file_admitted(name, i % 100, (".wav", ".mp3"), 60).alias("file_ok"),
        rules.runtime(F.when(k == 0, " CUDA "), F.when(k == 1, "darwin").when(k == 2, "linux").otherwise("win32"), i % 3 == 0).alias("runtime"),
        rules.wait_seconds(i % 9, F.lit(30.0), i % 3).alias("wait_s"),
    )
