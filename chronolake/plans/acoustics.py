"""Queries on what is heard in windows, on log-mel bands, and on turns from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators import acoustics, frames, intervals, risk
from chronolake.plans import review
from chronolake.plans.review import ASK, NORMAL, RISK, SIL, TELL
from chronolake.plans.timeline import SEG, query
from chronolake.sources import tables as S

WIDTH = 40_000


def _windows(spark, d) -> DataFrame:
    """The windows of 40 seconds in which segments begin, cut at the last end."""
    until = F.max("end_ms").over(Window.partitionBy("conv_id"))
    rows = intervals.tumbling(S.two_speakers(spark, d).withColumn("until", until), WIDTH)
    return rows.groupBy("conv_id", "window").agg((F.col("window") * WIDTH).alias("start_ms"), F.least((F.col("window") + 1) * WIDTH, F.max("until")).alias("end_ms"))


def _heard(spark, d) -> DataFrame:
    """Segments with the vector (conv_id * 13 + pos) % 600, which some lack; each recording's speakers are two vectors."""
    vectors = S.table(spark, d, "embeddings").select("vec_id", "embedding")
    rows = intervals.tumbling(S.two_speakers(spark, d), WIDTH).withColumn("vec_id", (F.col("conv_id") * 13 + F.col("pos")) % 600)
    pieces = rows.join(vectors, "vec_id", "left").select("conv_id", "window", "pos", "speaker", "start_ms", "end_ms", "embedding")
    convs = rows.select("conv_id").distinct()
    own = convs.select("conv_id", F.explode(F.array(F.struct(F.lit("A").alias("label"), (F.col("conv_id") * 13 % 50).alias("vec_id")), F.struct(F.lit("B").alias("label"), (F.col("conv_id") * 13 % 50 + 2).alias("vec_id")))).alias("c")).select("conv_id", "c.*")
    centroids = own.join(vectors, "vec_id").select("conv_id", "label", F.col("embedding").alias("centroid"))
    blocks = rows.select("conv_id", F.col("start_ms").alias("at_ms"), (F.length("text") % 100 / 100).alias("rms"))
    return acoustics.window_features(_windows(spark, d), S.turns(spark, d), pieces, centroids, review._silences(spark, d), blocks)


HEARD = f"""win as (select conv_id, start_ms // 40000 as w, (start_ms // 40000) * 40000 as ws, least((start_ms // 40000 + 1) * 40000, max(max(end_ms)) over (partition by conv_id)) as we from seg2 group by conv_id, start_ms // 40000),
lt as (select win.conv_id, w, pos, speaker, greatest(start_ms, ws) as s, least(end_ms, we) - greatest(start_ms, ws) as ms from win join turns t on t.conv_id = win.conv_id and least(end_ms, we) - greatest(start_ms, ws) > 0),
ls as (select *, lag(speaker) over (partition by conv_id, w order by s, pos) as b from lt), lp as (select conv_id, w, speaker, count(*) as n, count(*) filter (where b <> speaker) as sw, sum(ms) as ms, min(ms) as lo, max(ms) as hi from ls group by all),
la as (select conv_id, w, sum(n)::bigint as turns, count(*) as sp, sum(sw)::bigint as sw, sum(ms) as ms, min(lo) as lo, max(hi) as hi, case when count(*) > 1 and sum(ms) > 0 then min(ms) / sum(ms)::double else 0 end as mi from lp group by all),
qu as (select win.conv_id, w, count(*) as n, sum(least(sil.e, we) - greatest(sil.s, ws))::bigint as ms from win join sil on sil.conv_id = win.conv_id and least(sil.e, we) - greatest(sil.s, ws) > 0 group by all),
en as (select win.conv_id, w, avg(length(text) % 100 / 100.0::double) as m, stddev_pop(length(text) % 100 / 100.0::double) as sd from win join seg2 s on s.conv_id = win.conv_id and s.start_ms >= ws and s.start_ms < we group by all),
du as (select conv_id, speaker, sum(end_ms - start_ms) as ms from seg2 group by all), pr as (select conv_id, arg_max(speaker, (ms, -ascii(speaker))) as dom, case when count(*) > 1 then arg_min(speaker, (ms, -ascii(speaker))) end as mino from du group by 1),
v as (select vec_id, embedding::double[] as e from embeddings),
pc as (select s.conv_id, s.start_ms // 40000 as w, pos, speaker, e from seg2 s join v on v.vec_id = (s.conv_id * 13 + pos) % 600 where e is not null),
ev as (select p.*, lag(p.e) over o as pe, lag(speaker) over o as pl, dom, mino, list_cosine_similarity(p.e, vd.e) as td, list_cosine_similarity(p.e, vm.e) as tm from pc p left join pr using (conv_id)
 left join v vd on mino is not null and vd.vec_id = p.conv_id * 13 % 50 + case dom when 'B' then 2 else 0 end left join v vm on vm.vec_id = p.conv_id * 13 % 50 + case mino when 'B' then 2 when 'A' then 0 end window o as (partition by p.conv_id, start_w order by pos)),
e2 as (select *, case speaker when dom then tm - td when mino then td - tm end as mg, 1 - list_cosine_similarity(pe, e) as st from ev),
ea as (select conv_id, w, count(*) filter (where mg > 0.05) as dis, count(*) filter (where speaker = dom and mg > 0.1) as rd, count(*) filter (where speaker = mino and mg > 0.1) as rm, min(td) filter (where speaker = dom) as dc, min(tm) filter (where speaker = mino) as mc, greatest(max(st), 0) as ws, count(*) filter (where speaker = pl and st > 0.4) as fp from e2 group by all),
hd as (select win.conv_id, win.w, coalesce(la.turns, 0) as turns, coalesce(la.sp, 0) as sp, coalesce(la.sw, 0) as sw, round(coalesce(la.ms, 0) / greatest(we - win.ws, 1)::double, 3) as speech, coalesce(la.lo, 0) as lo, coalesce(la.hi, 0) as hi, round(coalesce(la.mi, 0), 3) as mi,
 coalesce(dis, 0) as dis, coalesce(rd, 0) as rd, coalesce(rm, 0) as rm, round(dc, 4) as dc, round(mc, 4) as mc, round(coalesce(ea.ws, 0), 4) as step, coalesce(fp, 0) as fp, coalesce(qu.n, 0) as sn, coalesce(qu.ms, 0) as sms, round(coalesce(en.m, 0), 5) as em, round(coalesce(en.sd, 0), 5) as es
 from win left join la using (conv_id, w) left join ea using (conv_id, w) left join qu using (conv_id, w) left join en using (conv_id, w))""".replace("start_w", "w")


@query(f"""{SEG}, {NORMAL}, {SIL}, {HEARD} select conv_id, w as "window", turns, sp as speakers, sw as switches, speech, lo as shortest_ms, hi as longest_ms, mi as minority, dis as disagreements, rd as refuted_dominant, rm as refuted_minority,
dc as dominant_cos, mc as minority_cos, step as widest_step, fp as far_pairs, sn as silences, sms as silence_ms, em as energy_mean, es as energy_std from hd""")
def window_audio(spark, d) -> DataFrame:
    return _heard(spark, d).drop("start_ms", "end_ms")


@query(f"""{RISK}, {NORMAL}, {SIL}, {HEARD}, j as (select sc.*, hd.sp as hsp, hd.sw as hsw, hd.mi, dis, rd, rm, fp, dc, sms from sc join hd on hd.conv_id = sc.conv_id and hd.w = sc.w),
s2 as (select *, 4 * least(3, rd) + 4 * least(3, rm) + (case when dis > 0 and rd + rm = 0 then least(3, dis) else 0 end) + 3 * least(3, fp) + (case when hsw - sw >= 3 then 3 when hsw - sw = 2 then 1.5::double else 0 end)
 + (case when dc < 0.4 then 2 when dc < 0.55 then 1 else 0 end) + (case when sp <= 1 and hsp >= 2 and mi >= 0.25 and sms < 6000 then 3 when sp <= 1 and hsp >= 2 and mi >= 0.15 then 1 else 0 end)
 + (case when sp = 1 and q > 0 and a > 0 then 1.5::double else 0 end) + 1.5::double * least(2, mixed) + least(3, hinted) + 0.75::double * least(4, tight) + 0.5::double * least(4, short) + (case when aba then 1.5::double else 0 end) + cr + 0.5::double * least(3, odd)
 + (case when q > 0 and a > 0 and sp <= 2 then 0.3::double else 0 end) + (case when sms < 500 and hsp >= 2 and sp >= 2 then 0.5::double else 0 end) as s from j)
select conv_id, w as "window", round(s, 3) as score from s2""")
def risk_windows_heard(spark, d) -> DataFrame:
    """The score of windows by what is said and what is heard."""
    rows = acoustics.scored(risk.features(S.two_speakers(spark, d), question=ASK, answer=TELL), _heard(spark, d))
    return rows.select("conv_id", "window", F.round("score", 3).alias("score"))


@query()
def log_mel(spark, d) -> DataFrame:
    """Log-mel bands of signals made of twenty vectors each."""
    parts = S.table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 20).alias("rec")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    bands = acoustics.log_mel(parts.select("rec", F.flatten(F.transform("v", lambda x: x["embedding"])).alias("samples")))
    return bands.select("rec", "frame", F.transform("bands", lambda x: F.round(x, 4)).alias("bands"))


@query()
def end_to_end_turns(spark, d) -> DataFrame:
    """Turns of recordings made of orders, the first four of which are one chunk; slots have vectors of the table."""
    own = review._frames(spark, d).filter("rec >= 4 or chunk = 0")
    slots = own.select("rec", "chunk").distinct().select("rec", "chunk", F.explode(F.array(*map(F.lit, range(3)))).alias("slot"))
    vectors = S.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    made = slots.withColumn("vec_id", (F.col("rec") * 15 + F.col("chunk") * 3 + F.col("slot")) % 500).join(vectors, "vec_id")
    last = own.groupBy("rec").agg(F.max("chunk").alias("c")).select("rec", (frames.CHUNK + F.col("c") * frames.STEP - F.when(F.col("rec") % 2 == 1, 5000).otherwise(0)).alias("samples"))
    return frames.diarized(own, made, last, count=3).select("rec", "cluster", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))
