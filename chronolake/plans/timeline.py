"""Queries on timelines, speakers, the cache and tasks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions import text as T
from chronolake.operators import intervals, records, results, sequence, speakers
from chronolake.sources import tables as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


SEG, TASKS, CACHE = f"with recursive {S.SEGMENTS_SQL}", f"with {S.TASKS_SQL}", f"with {S.CACHE_SQL}"


def _merge_sql(join: str) -> str:
    return f"""{SEG}, s as (select *, row_number() over (partition by conv_id order by pos) as rn from seg2),
r as (select conv_id, rn, speaker, start_ms as cs, end_ms as ce, start_ms as ps, 0::bigint as g, text as t from s where rn = 1
  union all select s.conv_id, s.rn, s.speaker, case when {join} then r.cs else s.start_ms end, case when {join} then greatest(r.ce, s.end_ms) else s.end_ms end,
    s.start_ms, case when {join} then r.g else r.g + 1 end, case when {join} then r.t || s.text else s.text end from r join s on s.conv_id = r.conv_id and s.rn = r.rn + 1),
l as (select *, row_number() over (partition by conv_id, g order by rn desc) as k from r)
select conv_id, g as seg_no, speaker, t as text, cs as start_ms, ce as end_ms from l where k = 1"""


@query(_merge_sql("(r.speaker is not distinct from s.speaker and s.start_ms >= r.ps and s.start_ms - r.ce < 2000 and s.end_ms - r.cs <= 60000)"))
def merge_view(spark, d) -> DataFrame:
    return sequence.merge_segments(S.two_speakers(spark, d), 2000, 60_000)


@query(_merge_sql("(r.speaker is not distinct from s.speaker and s.start_ms - r.ce <= 1700)"))
def merge_same_speaker(spark, d) -> DataFrame:
    return sequence.merge_segments(S.two_speakers(spark, d), 1700, 0, closed=True, guard=False)


@query(f"""{SEG}, n as (select *, case when lag(speaker) over w is distinct from speaker or row_number() over w = 1 then 1 else 0 end as new from seg2 where trim(text) <> '' window w as (partition by conv_id order by pos)),
r as (select *, sum(new) over (partition by conv_id order by pos) as run from n)
select conv_id, run::bigint as run, min(speaker) as speaker, min(start_ms) as start_ms, arg_max(end_ms, pos) as end_ms, count(*) as n from r group by conv_id, run""")
def speaker_runs(spark, d) -> DataFrame:
    return sequence.speaker_runs(S.two_speakers(spark, d))


@query()
def aba_smooth(spark, d) -> DataFrame:
    return sequence.smooth_aba(S.two_speakers(spark, d), 3000, dense_ms=3000)


@query(f"""{SEG}, t as (select file_hash, seconds, row_number() over (partition by file_hash order by task_id) as rn from (select user_id as file_hash, value as seconds, event_id as task_id from events) where seconds > 0),
r as (select file_hash, rn, seconds as e from t where rn = 1 union all select t.file_hash, t.rn, r.e * (1 - 0.3::double) + t.seconds * 0.3::double from r join t on t.file_hash = r.file_hash and t.rn = r.rn + 1)
select file_hash, round(arg_max(e, rn), 6) as ema from r group by file_hash""")
def ema(spark, d) -> DataFrame:
    return sequence.ema(S.task_rows(spark, d), "file_hash", "task_id", "seconds").withColumn("ema", F.round("ema", 6))


@query(f"""{SEG}, s as (select conv_id, start_ms, row_number() over (partition by conv_id order by start_ms) as rn from seg2),
r as (select conv_id, rn, start_ms, start_ms as kept, true as k from s where rn = 1 union all select s.conv_id, s.rn, s.start_ms, case when s.start_ms - r.kept > 4000 then s.start_ms else r.kept end, s.start_ms - r.kept > 4000 from r join s on s.conv_id = r.conv_id and s.rn = r.rn + 1)
select conv_id, start_ms from r where k""")
def epsilon_dedup(spark, d) -> DataFrame:
    return sequence.last_kept(S.two_speakers(spark, d), "conv_id", "start_ms", 4000)


@query(f"""{SEG}, c as (select *, lag(speaker) over (partition by conv_id order by pos) <> speaker as change from seg2)
select conv_id, count(*) filter (where change) as switches, max(end_ms) - min(start_ms) as span_ms from c group by conv_id""")
def switch_rate(spark, d) -> DataFrame:
    return sequence.switches(S.two_speakers(spark, d))


@query(f"""{SEG}, o as (select conv_id, speaker, sum(end_ms - start_ms)::bigint as duration_ms from seg group by conv_id, speaker)
select conv_id, speaker, duration_ms, duration_ms / sum(duration_ms) over (partition by conv_id)::double as share,
  duration_ms / sum(duration_ms) over (partition by conv_id)::double >= 0.03 as is_main from o""")
def speaker_share(spark, d) -> DataFrame:
    return speakers.shares(S.segments(spark, d))


@query(f"""{SEG}, o as (select conv_id, speaker, sum(end_ms - start_ms)::bigint as duration_ms from seg group by conv_id, speaker)
select *, row_number() over (partition by conv_id order by duration_ms desc, speaker) - 1 as new_id from o""")
def relabel_by_duration(spark, d) -> DataFrame:
    return speakers.relabel_by_duration(S.segments(spark, d))


@query(f"{SEG} select speaker, count(*) as segments, sum(end_ms - start_ms)::bigint as duration_ms, sum(length(text))::bigint as chars from seg group by speaker")
def speaker_profile(spark, d) -> DataFrame:
    return speakers.profile(S.segments(spark, d))


@query(f"""{SEG} select case when end_ms - start_ms < 1000 then 'a_under_1s' when end_ms - start_ms < 3000 then 'b_1_3s' when end_ms - start_ms < 10000 then 'c_3_10s'
  when end_ms - start_ms < 30000 then 'd_10_30s' else 'e_30s_up' end as bucket, count(*) as n, max(end_ms - start_ms) as longest_ms from seg group by 1""")
def length_histogram(spark, d) -> DataFrame:
    return speakers.length_histogram(S.segments(spark, d))


@query(f"""{SEG}, v as (select conv_id, end_ms - start_ms as x, row_number() over (partition by conv_id order by end_ms - start_ms) as rn, count(*) over (partition by conv_id) as n from seg)
select conv_id, x as median from v where rn = n // 2 + 1""")
def upper_median(spark, d) -> DataFrame:
    return speakers.upper_median(S.segments(spark, d).withColumn("x", F.col("end_ms") - F.col("start_ms")), "conv_id", "x")


OVERLAP = "least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)"
PAIRS = f"from seg a join turns b on a.conv_id = b.conv_id and {OVERLAP} > 0"


@query(f"{SEG} select a.conv_id, a.pos as l_pos, b.pos as r_pos, {OVERLAP} as overlap_ms {PAIRS}")
def chunk_turn_overlap(spark, d) -> DataFrame:
    return intervals.overlap_join(S.segments(spark, d), S.turns(spark, d), "conv_id").select("conv_id", "l_pos", "r_pos", "overlap_ms")


@query(f"""{SEG}, p as (select a.conv_id, a.pos, b.pos as segment, {OVERLAP} as overlap_ms, row_number() over (partition by a.conv_id, a.pos order by {OVERLAP} desc, b.pos) as k {PAIRS})
select conv_id, pos, segment, overlap_ms from p where k = 1""")
def word_attach(spark, d) -> DataFrame:
    return intervals.attach(S.segments(spark, d), S.turns(spark, d))


@query(f"""{SEG}, p as (select a.conv_id, a.pos, b.speaker, sum({OVERLAP})::bigint as overlap_ms {PAIRS} group by all),
k as (select *, row_number() over (partition by conv_id, pos order by overlap_ms desc, speaker desc) as k from p) select conv_id, pos, speaker, overlap_ms from k where k = 1""")
def overlap_majority(spark, d) -> DataFrame:
    return intervals.majority(S.segments(spark, d), S.turns(spark, d))


@query(f"""{SEG}, p as (select a.conv_id, a.pos, {OVERLAP} as o {PAIRS}) select conv_id, pos, count(*) as n, sum(o)::bigint as total_ms from p group by conv_id, pos""")
def silence_overlap(spark, d) -> DataFrame:
    pairs = intervals.overlap_join(S.segments(spark, d), S.turns(spark, d), "conv_id")
    return pairs.groupBy("conv_id", F.col("l_pos").alias("pos")).agg(F.count(F.lit(1)).alias("n"), F.sum("overlap_ms").alias("total_ms"))


NORMAL = """m as (select conv_id, start_ms, end_ms, max(end_ms) over (partition by conv_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach from seg where end_ms - start_ms >= 300),
i as (select *, sum(case when reach is null or start_ms - reach > 500 then 1 else 0 end) over (partition by conv_id order by start_ms, end_ms rows unbounded preceding) as island from m),
reg as (select conv_id, min(start_ms) as start_ms, max(end_ms) as end_ms from i group by conv_id, island)"""


def _regions(spark, d) -> DataFrame:
    return intervals.normalize(S.segments(spark, d), 300, 500)


@query(f"{SEG}, {NORMAL} select * from reg")
def region_normalize(spark, d) -> DataFrame:
    return _regions(spark, d)


@query(f"""{SEG}, {NORMAL}, e as (select conv_id, start_ms, end_ms from reg union all select conv_id, max(end_ms) + 1000, max(end_ms) + 1000 from seg group by conv_id),
f as (select *, coalesce(max(end_ms) over (partition by conv_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding), 0) as from_ms from e)
select conv_id, from_ms as start_ms, start_ms as end_ms from f where start_ms > from_ms""")
def silence_complement(spark, d) -> DataFrame:
    ends = S.segments(spark, d).groupBy("conv_id").agg((F.max("end_ms") + 1000).alias("duration_ms"))
    return intervals.complement(_regions(spark, d), ends)


@query(f"{SEG} select conv_id, pos, greatest(start_ms, 2000) - 2000 as start_ms, least(end_ms, 20000) - 2000 as end_ms from seg where least(end_ms, 20000) - greatest(start_ms, 2000) >= 50")
def clip_window(spark, d) -> DataFrame:
    return intervals.clip(S.segments(spark, d), 2000, 20_000, 50).select("conv_id", "pos", "start_ms", "end_ms")


@query(f"""{SEG}, c as (select *, start_ms // 40000 as "window", lag(speaker) over (partition by conv_id order by pos) as before from seg2)
select conv_id, "window", count(*) as segments, count(distinct speaker) as speakers, sum(length(text))::bigint as chars, count(*) filter (where before <> speaker) as switches from c group by conv_id, "window" """)
def tumbling_40s(spark, d) -> DataFrame:
    rows = intervals.tumbling(S.two_speakers(spark, d))
    rows = rows.withColumn("change", F.lag("speaker").over(Window.partitionBy("conv_id").orderBy("pos")) != F.col("speaker"))
    return rows.groupBy("conv_id", "window").agg(F.count(F.lit(1)).alias("segments"), F.countDistinct("speaker").alias("speakers"), F.sum(F.length("text")).alias("chars"), F.count_if("change").alias("switches"))


@query(f"""{SEG}, {NORMAL}, p as (select conv_id, start_ms as at_ms from turns), t as (select conv_id, start_ms as at_ms from reg union select conv_id, end_ms from reg),
k as (select p.conv_id, p.at_ms, t.at_ms as target, row_number() over (partition by p.conv_id, p.at_ms order by abs(t.at_ms - p.at_ms), t.at_ms) as k from p left join t on p.conv_id = t.conv_id and abs(t.at_ms - p.at_ms) <= 2000)
select conv_id, at_ms, target as target_ms from k where k = 1""")
def nearest_snap(spark, d) -> DataFrame:
    regions = _regions(spark, d)
    targets = regions.select("conv_id", F.explode(F.array("start_ms", "end_ms")).alias("at_ms"))
    return intervals.nearest_boundary(S.turns(spark, d).select("conv_id", F.col("start_ms").alias("at_ms")), targets, 2000)


@query(f"""{SEG}, n as (select conv_id, pos, start_ms, end_ms - start_ms as span, greatest(1, ceil((end_ms - start_ms) / 5000.0))::bigint as n from seg), e as (select *, unnest(range(0, n)) as piece from n)
select conv_id, pos, piece, start_ms + span * piece // n as from_ms, start_ms + span * (piece + 1) // n as to_ms from e""")
def long_split(spark, d) -> DataFrame:
    return intervals.equal_windows(S.segments(spark, d), 5000).select("conv_id", "pos", "piece", "from_ms", "to_ms")


@query(f"""{SEG} select conv_id, string_agg((rn || chr(10) || f(start_ms) || ' --> ' || f(end_ms) || chr(10) || text), chr(10) || chr(10) order by rn) as srt
from (select *, row_number() over (partition by conv_id order by pos) as rn from seg where trim(text) <> '') group by conv_id""".replace("f(start_ms)", "printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000)").replace("f(end_ms)", "printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000)"))
def srt_render(spark, d) -> DataFrame:
    rows = S.segments(spark, d).filter(F.trim("text") != "").withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("pos")))
    line = F.concat(F.col("rn").cast("string"), F.lit("\n"), T.clock(F.col("start_ms")), F.lit(" --> "), T.clock(F.col("end_ms")), F.lit("\n"), F.col("text"))
    parts = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("rn", line.alias("line")))).alias("p"))
    return parts.select("conv_id", F.array_join(F.transform("p", lambda x: x["line"]), "\n\n").alias("srt"))


@query()
def terms_normalize(spark, d) -> DataFrame:
    rows = S.table(spark, d, "documents").select("doc_id", F.split("text", ",").alias("raw")).withColumn("terms", T.normalize_terms(F.col("raw")))
    return rows.select("doc_id", "terms", records.term_error(F.col("raw"), F.col("terms")).alias("error"))


@query(f"""{SEG}, w as (select seg.conv_id, seg.pos, t.pos as word, least(seg.end_ms, t.end_ms) - greatest(seg.start_ms, t.start_ms) as o, row_number() over (partition by seg.conv_id, t.pos order by least(seg.end_ms, t.end_ms) - greatest(seg.start_ms, t.start_ms) desc, seg.pos) as k
  from seg join (select conv_id, pos, start_ms, case when pos % 5 = 0 then start_ms else end_ms end as end_ms from turns) t on seg.conv_id = t.conv_id and (least(seg.end_ms, t.end_ms) > greatest(seg.start_ms, t.start_ms) or t.start_ms = t.end_ms and seg.start_ms <= t.start_ms and t.start_ms <= seg.end_ms))
select seg.conv_id, seg.pos, string_agg(w.word::varchar, ',' order by w.word) as words from seg left join (select * from w where k = 1) w on seg.conv_id = w.conv_id and seg.pos = w.pos group by seg.conv_id, seg.pos""")
def words_of_segments(spark, d) -> DataFrame:
    """Turns as words, every fifth of no length."""
    words = S.turns(spark, d).withColumn("end_ms", F.when(F.col("pos") % 5 == 0, F.col("start_ms")).otherwise(F.col("end_ms")))
    rows = intervals.words_of(S.segments(spark, d), words)
    return rows.select("conv_id", "pos", F.array_join(F.col("words").cast("array<string>"), ",").alias("words"))


@query(f"""{SEG}, t as (select conv_id, pos, speaker, start_ms, case when pos % 3 = 0 then end_ms else start_ms end as end_ms from turns), s as (select a.conv_id, a.pos, b.speaker, sum(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) as o from seg a join t b on a.conv_id = b.conv_id and least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms) group by all),
m as (select *, row_number() over (partition by conv_id, pos order by o desc, speaker desc) as k from s),
n as (select a.conv_id, a.pos, b.speaker, row_number() over (partition by a.conv_id, a.pos order by abs(a.start_ms + a.end_ms - b.start_ms - b.end_ms), b.pos) as k from seg a join t b on a.conv_id = b.conv_id anti join m on m.conv_id = a.conv_id and m.pos = a.pos)
select conv_id, pos, speaker, o::bigint as overlap_ms from m where k = 1 union all select conv_id, pos, speaker, 0 from n where k = 1""")
def majority_or_nearest(spark, d) -> DataFrame:
    """Two of three turns have no length, so that some segments meet none."""
    return intervals.majority_or_nearest(S.segments(spark, d), S.turns(spark, d).withColumn("end_ms", F.when(F.col("pos") % 3 == 0, F.col("end_ms")).otherwise(F.col("start_ms"))))


@query()
def repetition(spark, d) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.first_repetition(F.col("text")).alias("unit")).filter("unit is not null")


@query(f"""{CACHE}, q as (select o_orderkey as req_id, md5((o_orderkey % 60)::varchar) as file_hash, case o_orderkey % 4 when 0 then 'qwen3+nospk' when 1 then 'qwen3' when 2 then 'funasr' else 'qwen3+wa:eng' end as engine from orders),
j as (select q.req_id, c.id, c.engine as have, created_min, case when c.engine = q.engine then 1 when c.engine = regexp_replace(q.engine, '\\+nospk$', '') then 2 when not contains(q.engine, '+') and not contains(c.engine, '+') then 3 end as rank from q left join cache c using (file_hash)),
k as (select *, row_number() over (partition by req_id order by rank nulls last, created_min desc, id desc) as k from j)
select req_id, case when rank is not null then id end as id, case when rank is not null then have end as engine, rank::bigint as rank from k where k = 1""")
def cache_lookup(spark, d) -> DataFrame:
    orders = S.table(spark, d, "orders")
    engine = F.element_at(F.array(*map(F.lit, ("qwen3+nospk", "qwen3", "funasr", "qwen3+wa:eng"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return results.lookup(orders.select(F.col("o_orderkey").alias("req_id"), F.md5((F.col("o_orderkey") % 60).cast("string").cast("binary")).alias("file_hash"), engine.alias("engine")), S.cache_rows(spark, d))


@query(f"{CACHE} select file_hash, id, created_min from (select *, row_number() over (partition by file_hash order by created_min desc, id desc) as k from cache where not contains(engine, '+')) where k = 1")
def cache_latest(spark, d) -> DataFrame:
    return results.newest(S.cache_rows(spark, d))


@query(f"{CACHE} select id, engine, accessed_min from (select *, row_number() over (order by accessed_min desc, id desc) as k from cache) where k > 100")
def cache_lru_evict(spark, d) -> DataFrame:
    return results.least_recently_used(S.cache_rows(spark, d), 100).select("id", "engine", "accessed_min")


@query(f"{CACHE} select id, created_min from cache where created_min >= 500")
def cache_ttl(spark, d) -> DataFrame:
    return results.expire(S.cache_rows(spark, d), 500).select("id", "created_min")


@query(f"{CACHE} select engine, count(*) as total, sum(length(result))::bigint as chars from cache group by engine")
def cache_stats(spark, d) -> DataFrame:
    return results.stats(S.cache_rows(spark, d))


@query("""select doc_id, case when doc_id % 3 = 0 then 'funasr' else 'qwen3' || case when doc_id % 2 = 0 and doc_id % 5 <> 0 then '+wa:' || lang else '' end || case when doc_id % 7 = 0 then '+nospk' else '' end end as tag from documents""")
def variant_key(spark, d) -> DataFrame:
    i = F.col("doc_id")
    tag = results.variant_key(F.when(i % 3 == 0, "funasr").otherwise("qwen3"), i % 2 == 0, F.col("lang"), i % 7 != 0, i % 5 == 0)
    return S.table(spark, d, "documents").select("doc_id", tag.alias("tag"))


@query(f"{TASKS} select status, count(*) as n, count(*) filter (where seconds > 0) as timed from tasks group by status")
def task_status_counts(spark, d) -> DataFrame:
    return results.status_counts(S.task_rows(spark, d))


@query(f"""{TASKS}, t as (select *, row_number() over (partition by file_hash order by status in ('completed', 'failed', 'cancelled') desc,
  case when status in ('completed', 'failed', 'cancelled') then epoch_us(created_at) else -epoch_us(created_at) end,
  case when status in ('completed', 'failed', 'cancelled') then task_id else -task_id end) as k from tasks)
select file_hash, status, status in ('completed', 'failed', 'cancelled') as terminal from t where k = 1""")
def terminal_first_wins(spark, d) -> DataFrame:
    return results.first_terminal(S.task_rows(spark, d), "file_hash", "created_at")


@query(f"{TASKS} select task_id, case when status = 'processing' and epoch(timestamp '2024-01-20 00:00:00') - floor(epoch(created_at)) > 3600 then 'timed_out' else status end as status from tasks")
def watchdog(spark, d) -> DataFrame:
    return results.watchdog(S.task_rows(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp"), 3600).select("task_id", "status")


@query(f"""{TASKS}, k as (select *, row_number() over (partition by file_hash order by created_at desc, task_id desc) as k from tasks where status in ('completed', 'failed', 'cancelled'))
select task_id, status from k where created_at < timestamp '2024-01-10 00:00:00' or k > 20""")
def task_evict(spark, d) -> DataFrame:
    return results.evict(S.task_rows(spark, d), F.lit("2024-01-10 00:00:00").cast("timestamp"), 20).select("task_id", "status")


@query("""with h as (select user_id, date_trunc('day', ts) as day, count(*) filter (where event_type = 'error') as e from events group by 1, 2),
c as (select user_id, day, sum(e) over (partition by user_id order by day)::bigint as errors from h), r as (select *, errors - lag(errors) over (partition by user_id order by day) as rise from c)
select user_id, day, errors, rise, coalesce(rise >= 2, false) as fires from r""")
def alert_eval(spark, d) -> DataFrame:
    daily = S.table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("e"))
    scrapes = daily.withColumn("errors", F.sum("e").over(Window.partitionBy("user_id").orderBy("day"))).drop("e")
    return results.alerts(scrapes, "user_id", "day", 2)


def _vectors(spark, d) -> DataFrame:
    return S.table(spark, d, "embeddings").withColumn("duration_ms", 1000 + F.col("vec_id") % 7000)


CENTROIDS = """b as (select *, row_number() over (partition by label order by 1000 + vec_id % 7000 desc, vec_id) as k from embeddings),
u as (select label, unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as i from b where k <= 30), m as (select label, i, avg(x) as x from u group by label, i),
z as (select label, i, x / sqrt(sum(x * x) over (partition by label)) as x from m)"""


@query(f"with {CENTROIDS} select label, i - 1 as i, round(x, 6) as x from z")
def centroid_build(spark, d) -> DataFrame:
    rows = speakers.centroids(_vectors(spark, d)).select("label", F.posexplode("centroid").alias("i", "x"))
    return rows.select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(f"with {CENTROIDS} select a.label as a, b.label as b, round(sum(a.x * b.x), 6) as cosine from z a join z b on a.i = b.i and a.label < b.label group by 1, 2")
def cosine_matrix(spark, d) -> DataFrame:
    c = speakers.centroids(_vectors(spark, d))  # a row for each label
    a, b = c.select(F.col("label").alias("a"), F.col("centroid").alias("ca")), c.select(F.col("label").alias("b"), F.col("centroid").alias("cb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(speakers.cosine(F.col("ca"), F.col("cb")), 6).alias("cosine"))


@query("select o_orderkey, trunc(least(greatest(300 + floor(o_totalprice) / 50 * 0.3::double, 600), 3600))::int as timeout from orders")
def timeout_rule(spark, d) -> DataFrame:
    return S.table(spark, d, "orders").select("o_orderkey", T.processing_timeout(F.floor("o_totalprice") / 50).alias("timeout"))
