"""Plans of long recordings: macro segments, chunk grids, triggers and the choice between versions."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def macro_cuts(duration: int, gaps: list[tuple[int, int]], target: int, soft: int, hard: int, least: int, search: int) -> list[float]:
    """Ends of macro segments: near the target at the middle of a gap (ties: the longer), else any gap before the hard
    limit, else the target; a rest shorter than ``least`` joins the last segment."""
    if not 0 < least <= target <= soft <= hard:
        raise ValueError("0 < least <= target <= soft <= hard must hold")
    gaps = sorted(gaps, key=sum)
    middles = [sum(g) / 2 for g in gaps]

    def between(low: float, high: float) -> list[tuple[int, int]]:
        return gaps[bisect_left(middles, low) : bisect_right(middles, high)]

    ends, at = [], 0.0
    while at < duration:
        if duration - at <= soft:
            end = float(duration)
        else:
            goal = at + target
            near = between(max(at + least, goal - search), min(at + soft, goal + search))
            near = near or between(at + least, min(duration, at + hard))
            end = sum(min(near, key=lambda g: (abs(sum(g) / 2 - goal), g[0] - g[1], g))) / 2 if near else goal
        if duration - end < least:
            end = float(duration)
        ends.append(end)
        at = end
    return ends


def macro_segments(silences: DataFrame, durations: DataFrame, target_ms: int = 720_000, soft_ms: int = 900_000, hard_ms: int = 1_200_000, least_ms: int = 180_000, search_ms: int = 60_000, gap_ms: int = 800, overlap_ms: int = 0, key: str = "conv_id") -> DataFrame:
    """durations: key, duration_ms. Segments of each recording with the range to read (earlier by overlap_ms but for the first).
    The next start is the last end, so a recording is planned in one pass over its silences of gap_ms or more."""
    gaps = silences.filter(F.col("end_ms") - F.col("start_ms") >= gap_ms).select(key, F.struct("start_ms", "end_ms").alias("g")).groupBy(key).agg(F.sort_array(F.collect_list("g")).alias("gaps"))
    rows = durations.filter("duration_ms > 0").join(gaps, key, "left").select(key, "duration_ms", F.transform("gaps", lambda g: g["start_ms"]).alias("a"), F.transform("gaps", lambda g: g["end_ms"]).alias("b"))

    def plan(parts):
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                gaps = [] if r.a is None else list(zip(map(int, r.a), map(int, r.b)))
                at = 0.0
                for i, end in enumerate(macro_cuts(int(r.duration_ms), gaps, target_ms, soft_ms, hard_ms, least_ms, search_ms)):
                    out.append((r[0], i, at, end, max(0.0, at - overlap_ms) if i else at))
                    at = end
            yield pd.DataFrame(out, columns=[key, "idx", "start_ms", "end_ms", "read_ms"])

    return rows.mapInPandas(plan, f"{key} {durations.schema[key].dataType.simpleString()}, idx long, start_ms double, end_ms double, read_ms double")


def macro_of(points: DataFrame, macros: DataFrame, slack_ms: int = 500, key: str = "conv_id") -> DataFrame:
    """The first macro segment within slack_ms of each point (pos, at_ms). Macros of a recording are few: one array each."""
    m = macros.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")))).alias("m"))
    hit = F.filter("m", lambda x: (F.col("at_ms") >= x["s"] - slack_ms) & (F.col("at_ms") <= x["e"] + slack_ms))
    return points.join(m, key).withColumn("hit", F.try_element_at(hit, F.lit(1))).filter("hit is not null").select(key, "pos", "at_ms", F.col("hit.idx").alias("macro"), F.col("hit.s").alias("macro_ms"))


def chunk_grid(segments: DataFrame, macros: DataFrame, width_ms: int = 40_000, key: str = "conv_id") -> DataFrame:
    """Segments with the macro segment of their start and the chunk of width_ms within it."""
    rows = macro_of(segments.select(key, "pos", F.col("start_ms").alias("at_ms")), macros, key=key)
    return rows.select(key, "pos", "macro", F.floor(F.greatest(F.col("at_ms") - F.col("macro_ms"), F.lit(0)) / width_ms).alias("chunk"))


def chunk_triggers(rows: DataFrame, silences: Column, keys: list[str], single_ms: int = 25_000) -> DataFrame:
    """rows: keys, speaker, from_ms, to_ms (of the chunk), one for each segment; silences: number of silences in its middle. Chunks of two or more
    speakers, long ones of one speaker with silences, and those to skip."""
    c = rows.groupBy(*keys).agg(F.countDistinct("speaker").alias("speakers"), F.count(F.lit(1)).alias("segments"), F.max(F.col("to_ms") - F.col("from_ms")).alias("span_ms"), F.max(silences).alias("silences"))
    long = (F.col("span_ms") >= single_ms) & (F.col("span_ms") - 10_000 > 1000)
    label = F.when(F.col("speakers") >= 2, "trigger_cross").when(long & (F.col("silences") > 0), "trigger_silence").otherwise("skip")
    return c.withColumn("label", label)


def accept(source: DataFrame, refined: DataFrame, low_confidence: Column, keys: list[str]) -> DataFrame:
    """Whether refined rows of each key replace its source rows, with the reasons against it. source and refined: keys, pos, speaker, start_ms, end_ms;
    low_confidence: of a refined row."""
    order = Window.partitionBy(*keys).orderBy("pos")

    def shape(df: DataFrame, p: str, low: Column) -> DataFrame:
        df = df.withColumn("change", F.coalesce((~F.lag("speaker").over(order).eqNullSafe(F.col("speaker"))) & (F.row_number().over(order) > 1), F.lit(False)))
        span = F.col("end_ms") - F.col("start_ms")
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{p}_n"), F.count_if("change").alias(f"{p}_switches"), F.count_if(span < 350).alias(f"{p}_short"), F.count_if(low).alias(f"{p}_low"))

    both = shape(source, "a", F.lit(False)).join(shape(refined, "b", low_confidence), keys, "left")
    both = both.join(drift(source, refined, keys), keys, "left")
    b = lambda c: F.coalesce(F.col(c), F.lit(0))
    empty = b("b_n") == 0
    rules = (
        ("low_confidence", b("b_low") > 0.35 * b("b_n")),
        ("many_switches", b("b_switches") > F.greatest(F.lit(8), F.col("a_switches") + 5)),
        ("many_segments", b("b_n") > F.greatest(F.lit(10), F.col("a_n") * 4 + 4)),
        ("many_short_segments", b("b_short") >= 4),
        ("duration_drift", (F.col("drift") > 1.25) & (F.col("a_switches") <= 1) & (F.col("labels_a") >= 2) & (F.col("labels_b") >= 2)),
    )
    reasons = F.when(empty, F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*(F.when(c, n) for n, c in rules))))
    return both.select(*keys, reasons.alias("reasons")).withColumn("accepted", F.size("reasons") == 0)


def drift(source: DataFrame, refined: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over speakers of the difference between their durations in both versions, by the source's total."""
    own = lambda df, c: df.groupBy(*keys, "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias(c))
    both = own(source, "a").join(own(refined, "b"), [*keys, "speaker"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = both.groupBy(*keys).agg(F.sum(F.abs(zero("a") - zero("b"))).alias("off"), F.sum(zero("a")).alias("total"), F.count("a").alias("labels_a"), F.count("b").alias("labels_b"))
    return rows.withColumn("drift", F.col("off") / F.greatest(F.col("total").cast("double"), F.lit(1e-3))).drop("off", "total")


def replace_accepted(source: DataFrame, refined: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """Refined rows of accepted keys, and source rows of all others."""
    ok = accepted.filter("accepted").select(*keys)
    return source.join(ok, keys, "left_anti").unionByName(refined.join(ok, keys, "left_semi"), allowMissingColumns=True)
