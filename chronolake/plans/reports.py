"""Queries on readers of logs, labels by segment, fan-out and roll-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions import parse
from chronolake.operators import clusters, evaluation, records, service
from chronolake.plans.review import CHARS, MAPPED, SIL, _chars, _silences
from chronolake.plans.timeline import NORMAL, SEG, TASKS, query
from chronolake.sources import tables as S

MAJORITY = f"""{SEG}, {CHARS}, {MAPPED}, more as (select rec, count(distinct own) > count(distinct "true") as more, min("true") as sole from cnf group by rec),
sg as (select rec, segment, own, "true", count(*) as n from chr group by all),
tp as (select rec, segment, own, sum(n)::bigint as matched, arg_min("true", (-n, "true")) as majority, max(n) as n from sg group by 1, 2, 3),
lb as (select tp.*, majority = case when more then sole when own = 'A' then m[1] else m[2] end as "right", n < 0.9 * matched as mixed from tp join bm using (rec) join more using (rec))"""


def _labels(spark, d) -> DataFrame:
    chars = _chars(spark, d)
    return evaluation.segment_majority(chars, clusters.label_mapping(evaluation.confusion(chars)))


@query(f'{MAJORITY} select rec, segment, matched, majority, "right", mixed from lb')
def segment_labels(spark, d) -> DataFrame:
    return _labels(spark, d)


@query(f'{MAJORITY}, w as (select *, row_number() over (partition by rec order by matched desc, segment) as rank from lb where not "right") select rec, segment, matched, majority, mixed, rank::int as rank from w where rank <= 12')
def worst_segments(spark, d) -> DataFrame:
    return evaluation.worst_segments(_labels(spark, d)).drop("right")


@query(f"""{MAJORITY} select rec, count(*) as considered, count(*) filter (where "right") as ok, count(*) filter (where not "right") as wrong, count(*) filter (where mixed) as mixed,
  round(count(*) filter (where "right") / count(*)::double, 9) as accuracy from lb group by rec""")
def segment_report(spark, d) -> DataFrame:
    return evaluation.segment_report(_labels(spark, d)).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""{SEG}, b as (select *, coalesce(sum(length(text)) over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding), 0) as before from seg),
c as (select conv_id, unnest(range(0, length(text))) as i, before, start_ms from b where text <> ''), ch as (select conv_id, before + i + 1 as n, start_ms + i * 10 + (before + i + 1) % 7 as s, start_ms + i * 10 + 10 - (before + i + 1) % 5 as e from c)
select b.conv_id, b.pos, abs(b.start_ms - f.s)::bigint as start_off, abs(b.end_ms - l.e)::bigint as end_off from b join ch f on f.conv_id = b.conv_id and f.n = b.before + 1 join ch l on l.conv_id = b.conv_id and l.n = b.before + length(b.text) where b.text <> ''""")
def char_alignment(spark, d) -> DataFrame:
    """Segments beside the times of all their characters, each a little off."""
    rows = S.segments(spark, d)
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chars = rows.withColumn("before", before).filter("text <> ''").select("conv_id", "before", "start_ms", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("i"))
    n, at = F.col("before") + F.col("i") + 1, F.col("start_ms") + F.col("i") * 10
    return evaluation.char_offsets(rows, chars.select("conv_id", n.alias("n"), (at + n % 7).alias("start_ms"), (at + 10 - n % 5).alias("end_ms")))


@query("""with c as (select user_id, case event_type when 'error' then 'error' when 'signup' then 'warning' else 'ok' end as severity, 'check' || event_id % 7 as name, event_id as "at" from events),
o as (select user_id, severity, name, min("at") as "at" from c group by all)
select user_id, case when count(*) filter (where severity = 'error') > 0 then 'error' when count(*) filter (where severity = 'warning') > 0 then 'warning' else 'ok' end as status,
  coalesce(string_agg(name, ',' order by "at") filter (where severity = 'warning'), '') as warnings, coalesce(string_agg(name, ',' order by "at") filter (where severity = 'error'), '') as errors from o group by user_id""")
def check_report(spark, d) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warning").otherwise("ok")
    checks = S.table(spark, d, "events").select("user_id", severity.alias("severity"), F.concat(F.lit("check"), F.col("event_id") % 7).alias("name"), F.col("event_id").alias("at"))
    return evaluation.check_report(checks, "user_id").withColumns({c: F.array_join(c, ",") for c in ("warnings", "errors")})


SENSORS = ("GPU HW active residency", "ANE Power", "CPU Power", "GPU Power")


@query(f"""with r as (select user_id, list_extract({list(SENSORS)!r}, (event_id % 4 + 1)::int) as name, floor(value * 10) / 10 as v from events where value is not null and event_id % 9 <> 0)
select user_id, name, round(avg(v), 6) as mean, max(v) as peak, count(*) as n from r group by user_id, name""")
def power_logs(spark, d) -> DataFrame:
    """Values written as a power log of each user, with lines that no reading can be taken from, and read back."""
    name = F.element_at(F.array(*map(F.lit, SENSORS)), (F.col("event_id") % 4 + 1).cast("int"))
    share = F.col("event_id") % 4 == 0
    tenths = F.floor(F.col("value") * 10)
    number = F.concat(F.expr("cast(floor(value * 10) as bigint) div 10").cast("string"), F.lit("."), (tenths % 10).cast("string"))
    # every ninth line has the other kind of unit and doesn't count
    unit = F.when(share == (F.col("event_id") % 9 != 0), "%").otherwise(" mW")
    line = F.concat(name, F.lit(":  "), number, unit)
    logs = S.table(spark, d, "events").filter("value is not null").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("l")))).alias("l"))
    logs = logs.select("user_id", F.array_join(F.transform("l", lambda x: x["l"]), "\n").alias("log"))
    return parse.sensors(logs, "user_id").withColumn("mean", F.round("mean", 6))


@query(f"""{SEG}, mp as (select distinct conv_id, speaker, 'person' || conv_id % 5 as "to" from seg where (conv_id + length(speaker)) % 3 <> 0)
select seg.conv_id, pos, coalesce("to", speaker) as speaker, "to" is not null as known from seg left join mp using (conv_id, speaker)""")
def speaker_remap(spark, d) -> DataFrame:
    """Speakers under new names; known: the row also stays where those without an entry go."""
    rows = S.segments(spark, d).select("conv_id", "pos", "speaker")
    mapping = rows.filter((F.col("conv_id") + F.length("speaker")) % 3 != 0).select("conv_id", "speaker", F.concat(F.lit("person"), F.col("conv_id") % 5).alias("to")).distinct()
    kept = clusters.remap(rows, mapping, ["conv_id"], inner=True).select("conv_id", "pos", F.lit(True).alias("known"))
    return clusters.remap(rows, mapping, ["conv_id"]).join(kept, ["conv_id", "pos"], "left").na.fill({"known": False})


@query(f"""{TASKS}, cn as (select o_custkey as connection, o_orderkey as task_id from orders) select distinct connection, task_id, status, case status when 'completed' then 'task_complete' when 'failed' then 'task_error' else 'task_progress' end as type from cn join tasks using (task_id)""")
def connection_notices(spark, d) -> DataFrame:
    """What each connection is told of the tasks that it follows."""
    follows = S.table(spark, d, "orders").select(F.col("o_custkey").alias("connection"), F.col("o_orderkey").alias("task_id"))
    return service.notices(S.task_rows(spark, d).select("task_id", "status"), follows)


def _log_lines(silences: DataFrame, keys: list[str]) -> DataFrame:
    """A log for each key, with an end before any start, a start that another one replaces, and an end that comes twice."""
    sec = lambda c: F.format_string("%d.%03d", F.expr(f"{c} div 1000"), F.col(c) % 1000)
    end = F.concat(F.lit("silence_end: "), sec("end_ms"), F.lit(" | silence_duration: 1"))
    line = F.concat(F.lit("silence_start: 0\n[x] silence_start: "), sec("start_ms"), F.lit("\n"), end, F.lit("\n"), end)
    logs = silences.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start_ms", line.alias("l")))).alias("l"))
    return logs.select(*keys, F.concat(F.lit("silence_end: 0.5 | silence_duration: 1\n"), F.array_join(F.transform("l", lambda x: x["l"]), "\n")).alias("log"))


@query(f"{SEG}, {NORMAL}, {SIL} select conv_id, s::bigint as start_ms, e::bigint as end_ms from sil")
def paired_silences(spark, d) -> DataFrame:
    return parse.paired_silences(_log_lines(_silences(spark, d), ["conv_id"]), ["conv_id"], strict=True)


@query(f"""{SEG}, {NORMAL}, {SIL}, du as (select conv_id, max(end_ms) + 1000 as du from seg group by conv_id), wn as (select conv_id, unnest(range(0, du, 20000)) as from_ms, du from du),
c as (select wn.conv_id, from_ms, greatest(s, from_ms) as a, least(e, from_ms + 20000, du) as b from wn join sil on sil.conv_id = wn.conv_id and s < least(from_ms + 20000, du) and e > from_ms where least(from_ms + 20000, du) - from_ms >= 1000)
select conv_id, from_ms, a::bigint as start_ms, b::bigint as end_ms from c where b - a >= 500""")
def window_silences(spark, d) -> DataFrame:
    """Logs of windows of 20 s, on each window's own clock, read back to the clock of the recording."""
    ends = S.segments(spark, d).groupBy("conv_id").agg((F.max("end_ms") + 1000).alias("whole"))
    # the windows that a silence meets follow from its ends, without a join of ranges
    rows = _silences(spark, d).join(ends, "conv_id").withColumn("from_ms", F.explode(F.expr("sequence(start_ms div 20000 * 20000, (end_ms - 1) div 20000 * 20000, 20000)")))
    rows = rows.withColumn("to_ms", F.least(F.col("from_ms") + 20_000, "whole"))
    own = rows.select("conv_id", "from_ms", "to_ms", (F.greatest("start_ms", "from_ms") - F.col("from_ms")).alias("start_ms"), (F.least("end_ms", "to_ms") - F.col("from_ms")).alias("end_ms"))
    return parse.window_silences(_log_lines(own, ["conv_id", "from_ms", "to_ms"]), ["conv_id"])


@query(f"{TASKS} select file_hash, 'engine_tasks_total' as name, count(*)::double as value from tasks where status is not null group by file_hash")
def counter_sums(spark, d) -> DataFrame:
    """Counters by status written as metrics text, read back and summed over their labels."""
    rows = S.task_rows(spark, d).filter("status is not null").groupBy("file_hash", F.col("status").alias("label")).agg(F.count(F.lit(1)).alias("value"))
    rows = rows.withColumns({"name": F.lit("tasks_total"), "kind": F.lit("counter"), "help": F.lit("tasks"), "label_name": F.lit("status")})
    return parse.summed(parse.metrics(parse.exposition(rows, ["file_hash"]), ["file_hash"]), ["file_hash"])


@query("""with s as (select o_custkey, o_orderkey, any_value(o_totalprice) as memory, sum(l_quantity)::double as load from orders join lineitem on l_orderkey = o_orderkey group by 1, 2)
select o_custkey, round(avg(load), 6) as load_mean, max(load) as load_peak, round(avg(memory), 6) as memory_mean, max(memory) as memory_peak, count(*) as samples from s group by o_custkey""")
def system_load(spark, d) -> DataFrame:
    """Orders as samples, with their lines as cores."""
    cores = S.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_quantity").cast("double")).alias("cores"))
    samples = S.table(spark, d, "orders").join(cores, "o_orderkey").select("o_custkey", "cores", F.col("o_totalprice").alias("memory"))
    return evaluation.system_load(samples, "o_custkey").withColumns({"load_mean": F.round("load_mean", 6), "memory_mean": F.round("memory_mean", 6)})


@query(f"""{SEG} select conv_id, row_number() over (partition by conv_id order by pos) as para, case when pos % 2 = 0 then '主持人' else '嘉宾' end as speaker,
  array_to_string([trim(x) for x in string_split(trim(text), chr(10)) if trim(x) not in ('', '---')], '') as text from seg""")
def transcript_paragraphs(spark, d) -> DataFrame:
    """Conversations written as transcripts with a head, and parsed."""
    said = F.concat(F.when(F.col("pos") % 2 == 0, "主持人").otherwise("嘉宾"), F.lit("："), F.trim("text"))
    files = S.segments(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", said.alias("l")))).alias("l"))
    head = F.lit("title\n---\n主持人：not yet\n---\nlost line\n")
    return parse.transcript(files.select("conv_id", F.concat(head, F.array_join(F.transform("l", lambda x: x["l"]), "\n")).alias("text")), "conv_id", ("主持人", "嘉宾"))


@query(f"{SEG} select conv_id, row_number() over (partition by conv_id order by pos) - 1 as pos, (pos % 3)::int as speaker, start_ms, end_ms from seg")
def json_turns(spark, d) -> DataFrame:
    """Turns written as JSON under either of two names, and parsed."""
    turn = F.struct((F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.concat(F.lit("Speaker "), (F.col("pos") % 3 + 1).cast("string")).alias("speaker"))
    rows = S.segments(spark, d).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", turn.alias("t")))), lambda x: x["t"]).alias("t"))
    first = F.to_json(F.struct(F.col("t").alias("diarization_turns"), F.array(F.struct(F.lit(9.0).alias("start"))).alias("segments")))
    body = F.when(F.col("conv_id") % 2 == 0, first).otherwise(F.to_json(F.struct(F.col("t").alias("segments"))))
    return records.json_turns(rows.select("conv_id", body.alias("body")), "conv_id")


@query("""select event_id, case when event_id % 4 = 3 and value >= 0 then value when event_id % 3 = 2 and value >= 0 then value * 2 when event_id % 5 > 0 then event_id % 50 + 60.5 end::double as seconds from events""")
def probe_durations(spark, d) -> DataFrame:
    """The container's duration, or the stream's, or the last clock of a log."""
    i, text = F.col("event_id"), lambda c: c.cast("string")
    container = F.when(i % 4 == 0, F.lit("N/A")).when(i % 4 == 1, "nan").when(i % 4 == 2, "-1").otherwise(text(F.col("value")))
    stream = F.when(i % 3 == 0, F.lit(None).cast("string")).when(i % 3 == 1, "inf").otherwise(text(F.col("value") * 2))
    log = F.when(i % 5 > 0, F.concat(F.lit("time=00:00:09.00 x\nsize=1 time=00:01:"), F.lpad(text(i % 50), 2, "0"), F.lit(".50 speed=1"))).otherwise("no clock")
    return S.table(spark, d, "events").select("event_id", parse.duration(container, stream, log).alias("seconds"))


SPOKEN = "printf('%02d:%02d:%02d,%03d', floor({0})::bigint // 3600, floor({0})::bigint // 60 % 60, floor({0})::bigint % 60, round_even(({0} - floor({0})) * 1000, 0)::bigint)"


@query(f"""{SEG}, n as (select conv_id, row_number() over (partition by conv_id order by pos) as n, pos % 3 as speaker, case when pos % 4 = 1 then ' ' else text end as text, start_ms / 1000.0::double as s, (end_ms + pos % 2 * 0.25::double) / 1000 as e from seg)
select conv_id, string_agg(n || chr(10) || {SPOKEN.format("s")} || ' --> ' || {SPOKEN.format("e")} || chr(10) || 'Speaker' || (speaker + 1) || ': ' || trim(text) || chr(10), chr(10) order by n) as srt from n where trim(text) <> '' group by conv_id""")
def spoken_srt(spark, d) -> DataFrame:
    """Subtitles with speakers; every fourth segment is blank, and some ends lie between milliseconds."""
    rows = S.segments(spark, d).withColumn("text", F.when(F.col("pos") % 4 == 1, " ").otherwise(F.col("text")))
    rows = rows.withColumns({"speaker": F.col("pos") % 3, "start_s": F.col("start_ms") / 1000, "end_s": (F.col("end_ms") + F.col("pos") % 2 * F.lit(0.25)) / 1000})
    return records.spoken_srt(rows)
