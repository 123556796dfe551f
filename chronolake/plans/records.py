"""Queries on records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.operators import records
from chronolake.plans.timeline import OVERLAP, SEG, TASKS, _vectors, query
from chronolake.sources import tables as S


@query(f"{SEG} select conv_id, row_number() over (partition by conv_id order by pos) - 1 as pos, 'Speaker' || (pos % 3 + 1) as speaker, trim(text) as text, start_ms, end_ms from seg where trim(text) <> ''")
def sentence_parse(spark, d) -> DataFrame:
    """Segments written as a model's JSON, and parsed."""
    rows = S.segments(spark, d).filter("trim(text) <> ''").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end"), "text", (F.col("pos") % 3).alias("spk")).alias("s")))).alias("l"))
    body = F.to_json(F.array(F.struct(F.lit("all").alias("text"), F.transform("l", lambda x: x["s"]).alias("sentence_info"))))
    return records.sentences(rows.select("conv_id", body.alias("result")), "conv_id").drop("error")


@query("select doc_id, coalesce(lang, 'und') as lang, 'funasr' as engine from documents")
def migrate(spark, d) -> DataFrame:
    return records.migrated(S.table(spark, d, "documents").select("doc_id", "lang"), {"lang": "und", "engine": "funasr"})


@query(f"""{SEG}, i as (select * from seg), p as (select a.conv_id, a.pos, b.speaker, ({OVERLAP}) / greatest(a.end_ms - a.start_ms, 1)::double as c, row_number() over (partition by a.conv_id, a.pos order by {OVERLAP} desc, b.pos) as k
  from i a join turns b on a.conv_id = b.conv_id and {OVERLAP} > 0), lo as (select i.* from i left join p on i.conv_id = p.conv_id and i.pos = p.pos where p.pos is null),
f as (select a.conv_id, a.pos, b.speaker, b.start_ms <= (a.start_ms + a.end_ms) / 2.0 and (a.start_ms + a.end_ms) / 2.0 <= b.end_ms as inside, b.end_ms - b.start_ms as len, b.pos as bp,
  least(abs(b.start_ms - (a.start_ms + a.end_ms) / 2.0), abs(b.end_ms - (a.start_ms + a.end_ms) / 2.0)) as dist from lo a join turns b on a.conv_id = b.conv_id),
r as (select *, row_number() over (partition by conv_id, pos order by inside desc, case when inside then len else dist end, bp) as k from f)
select conv_id, pos, speaker, round(least(1, c), 9) as confidence from p where k = 1 union all select conv_id, pos, speaker, case when inside then 0.5 else 0 end from r where k = 1""")
def label_items(spark, d) -> DataFrame:
    rows = records.label_items(S.segments(spark, d), S.turns(spark, d))
    return rows.select("conv_id", "pos", "speaker", F.round("confidence", 9).alias("confidence"))


@query(f"""{SEG}, n as (select *, case when lag(speaker) over (partition by conv_id order by pos) is not distinct from speaker and row_number() over (partition by conv_id order by pos) > 1 then 0 else 1 end as new from seg2),
r as (select *, sum(new) over (partition by conv_id order by pos) as run from n) select conv_id, run::bigint as run, min(speaker) as speaker, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) filter (where pos % 3 = 0) as low, string_agg(text, '' order by pos) as text from r group by conv_id, run""")
def aligned_runs(spark, d) -> DataFrame:
    return records.aligned_runs(S.two_speakers(spark, d).withColumn("confidence", F.when(F.col("pos") % 3 == 0, 0.2).otherwise(0.9)))


@query(f"""{SEG}, w as (select conv_id, pos, start_ms + end_ms as mid from turns), q as (select *, end_ms = max(end_ms) over (partition by conv_id) as last from seg)
select w.conv_id, w.pos, q.pos as piece from w join q on w.conv_id = q.conv_id and q.start_ms * 2 <= mid and (mid < q.end_ms * 2 or (last and mid = q.end_ms * 2))""")
def piece_of(spark, d) -> DataFrame:
    return records.piece_of(S.turns(spark, d), S.segments(spark, d))


@query("""with v as (select label, vec_id, embedding::double[] as e, lag(embedding::double[]) over (partition by label order by vec_id) as b from embeddings)
select label, vec_id, round(1 - list_cosine_similarity(e, b), 6) as distance from v where b is not null""")
def embedding_jumps(spark, d) -> DataFrame:
    return records.jumps(_vectors(spark, d), "label", "vec_id", "label").select("label", "vec_id", F.round("distance", 6).alias("distance"))


CLOCK = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query(f"""{SEG} select conv_id, string_agg(n || chr(10) || {CLOCK.format('start_ms')} || ' --> ' || {CLOCK.format('end_ms')} || chr(10) || trim(text), chr(10) || chr(10) order by n) as srt
from (select *, row_number() over (partition by conv_id order by pos) as n from seg) where trim(text) <> '' and pos % 3 <> 1 group by conv_id""")
def srt_raw(spark, d) -> DataFrame:
    return records.srt(S.segments(spark, d).withColumn("text", F.when(F.col("pos") % 3 == 1, " ").otherwise(F.col("text"))))


@query(f"{SEG} select conv_id, pos, 'Speaker' || (pos % 2 + 1) as speaker, round_even((start_ms + 500) / 1000.0::double, 2) as start_time, round_even((end_ms + 500) / 1000.0::double, 2) as end_time from seg")
def external_segments(spark, d) -> DataFrame:
    rows = records.moved(S.segments(spark, d).withColumn("speaker", F.col("pos") % 2), F.lit(500))
    return records.external(rows).select("conv_id", "pos", "speaker", "start_time", "end_time")


@query(f"{TASKS} select task_id, case when task_id % 3 = 0 and status in ('pending', 'processing') then 'cancelled' else status end as status from tasks")
def cancel(spark, d) -> DataFrame:
    tasks = S.task_rows(spark, d)
    return records.cancelled(tasks, tasks.select("task_id").filter("task_id % 3 = 0")).select("task_id", "status")


@query(f"{TASKS} select file_hash, count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'processing') as processing, count(distinct status) as kinds from tasks group by file_hash")
def metrics_snapshot(spark, d) -> DataFrame:
    return records.snapshot(S.task_rows(spark, d), "file_hash").select("file_hash", "pending", "processing", F.size("totals").cast("long").alias("kinds"))


@query("""with n as (select l_returnflag, l_linenumber, l_linestatus, count(distinct l_suppkey) as n from lineitem group by 1, 2, 3)
select l_returnflag, l_linenumber, count(*) as backends, min(n) as fewest, max(n) as most, min(n) = max(n) as equal from n group by 1, 2""")
def backend_parity(spark, d) -> DataFrame:
    return records.parity(S.table(spark, d, "lineitem"), ["l_returnflag", "l_linenumber"], "l_linestatus", "l_suppkey")


@query("select event_type, round(sum(value), 4) as total, count(*) as n from events group by event_type")
def stage_totals(spark, d) -> DataFrame:
    return records.stage_totals(S.table(spark, d, "events"), "event_type", "value").withColumn("total", F.round("total", 4))


@query("select doc_id, regexp_replace(replace(replace(text, 'the', 'THE'), 'THE ', 'a '), '\\bof\\s+a\\b', 'of one', 'g') as text from documents")
def glossary(spark, d) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", records.glossary(F.col("text"), [("the", "THE"), ("THE ", "a ")], ((r"\bof\s+a\b", "of one"),)).alias("text"))
