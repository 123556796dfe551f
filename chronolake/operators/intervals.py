"""Interval algebra. Range joins go by buckets, so they plan as equi-joins; no pair is made twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, key: str, width_ms: int = 5000, least_ms: int = 0) -> DataFrame:
    """Pairs that overlap by more than least_ms, with columns l_* and r_* and overlap_ms. width_ms: of a bucket, about
    the length of most intervals."""

    def cut(df: DataFrame, p: str) -> DataFrame:
        named = df.select(F.col(key), *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key))
        lo, hi = (F.floor(F.col(f"{p}_{c}") / width_ms) for c in ("start_ms", "end_ms"))
        return named.withColumn(f"{p}_low", lo).withColumn("bucket", F.explode(F.sequence(lo, F.greatest(lo, hi))))

    pairs = cut(left, "l").join(cut(right, "r"), [key, "bucket"])
    own = F.greatest("l_low", "r_low") == F.col("bucket")
    overlap = F.least("l_end_ms", "r_end_ms") - F.greatest("l_start_ms", "r_start_ms")
    return pairs.filter(own & (overlap > least_ms)).withColumn("overlap_ms", overlap).drop("bucket", "l_low", "r_low")


def attach(words: DataFrame, segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each word's segment of largest overlap (ties: the smallest position); words without one are left out."""
    best = Window.partitionBy(key, "l_pos").orderBy(F.desc("overlap_ms"), "r_pos")
    return overlap_join(words, segments, key).withColumn("rank", F.row_number().over(best)).filter("rank = 1").select(key, F.col("l_pos").alias("pos"), F.col("r_pos").alias("segment"), "overlap_ms")


def majority(segments: DataFrame, turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """The speaker with the largest summed overlap of each segment (ties: the larger label)."""
    summed = overlap_join(segments, turns, key).groupBy(key, F.col("l_pos").alias("pos"), F.col("r_speaker").alias("speaker")).agg(F.sum("overlap_ms").alias("overlap_ms"))
    top = summed.groupBy(key, "pos").agg(F.max(F.struct("overlap_ms", "speaker")).alias("m"))
    return top.select(key, "pos", "m.speaker", "m.overlap_ms")


def words_of(segments: DataFrame, words: DataFrame, key: str = "conv_id") -> DataFrame:
    """Positions of each segment's words, in order: a word goes to the segment of its largest overlap, one of no length
    to the first segment that it stands in (ends included). A segment without words has null; other words are left out."""
    point = F.col("start_ms") == F.col("end_ms")
    # a point is met by a segment that is longer by a bit at both ends, by twice that bit
    wide = lambda df, by: df.withColumns({"start_ms": F.col("start_ms") * 2 - by, "end_ms": F.col("end_ms") * 2 + by})
    points = overlap_join(wide(words.filter(point), 1), wide(segments, 1), key, 10_000)
    points = points.groupBy(key, F.col("l_pos").alias("pos")).agg(F.min("r_pos").alias("segment"))
    found = attach(words.filter(~point), segments, key).select(key, "pos", "segment").unionByName(points)
    lists = found.groupBy(key, F.col("segment").alias("pos")).agg(F.sort_array(F.collect_list("pos")).alias("words"))
    return segments.join(lists, [key, "pos"], "left")


def majority_or_nearest(segments: DataFrame, turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """majority, and for segments that overlap no turn the speaker of the turn with the nearest middle (ties: the
    earlier one) with an overlap of 0."""
    own = majority(segments, turns, key)
    rest = segments.join(own, [key, "pos"], "left_anti").select(key, "pos", (F.col("start_ms") + F.col("end_ms")).alias("mid"))
    both = rest.select(key, "pos", "mid", F.lit(None).cast("string").alias("speaker"), F.lit(1).alias("probe"))
    both = both.unionByName(turns.select(key, "pos", (F.col("start_ms") + F.col("end_ms")).alias("mid"), "speaker", F.lit(0).alias("probe")))
    turn = F.when(F.col("probe") == 0, F.struct("mid", "pos", "speaker"))
    back = Window.partitionBy(key).orderBy("mid", "probe", F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.desc("mid"), "probe", F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumns({"low": F.last(turn, True).over(back), "high": F.last(turn, True).over(ahead)}).filter("probe = 1")
    far = lambda c: F.struct(F.abs(F.col(c)["mid"] - F.col("mid")).alias("far"), F.col(c)["pos"].alias("pos"), F.col(c)["speaker"].alias("speaker"))
    near = F.least(F.when(F.col("low").isNotNull(), far("low")), F.when(F.col("high").isNotNull(), far("high")))
    rows = rows.withColumn("near", near).filter("near is not null")
    return own.unionByName(rows.select(key, "pos", F.col("near.speaker").alias("speaker"), F.lit(0).cast("long").alias("overlap_ms")))


def normalize(regions: DataFrame, least_ms: int, gap_ms: int, key: str = "conv_id") -> DataFrame:
    """Drops regions shorter than least_ms and merges those with gaps of gap_ms or less."""
    rows = regions.filter(F.col("end_ms") - F.col("start_ms") >= least_ms)
    order = Window.partitionBy(key).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(reach.isNull() | (F.col("start_ms") - reach > gap_ms), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def complement(regions: DataFrame, durations: DataFrame, key: str = "conv_id") -> DataFrame:
    """What regions leave of 0..duration_ms: head, gaps and tail."""
    ends = durations.select(key, F.col("duration_ms").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    order = Window.partitionBy(key).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    rows = regions.select(key, "start_ms", "end_ms").unionByName(ends).withColumn("from_ms", F.coalesce(F.max("end_ms").over(order), F.lit(0)))
    return rows.filter("start_ms > from_ms").select(key, F.col("from_ms").alias("start_ms"), F.col("start_ms").alias("end_ms"))


def clip(regions: DataFrame, low_ms: int, high_ms: int, least_ms: int) -> DataFrame:
    """Regions within a window, relative to its start; those of less than least_ms go."""
    rows = regions.withColumns({"start_ms": F.greatest("start_ms", F.lit(low_ms)) - low_ms, "end_ms": F.least("end_ms", F.lit(high_ms)) - low_ms})
    return rows.filter(F.col("end_ms") - F.col("start_ms") >= least_ms)


def tumbling(segments: DataFrame, width_ms: int = 40_000) -> DataFrame:
    return segments.withColumn("window", F.floor(F.greatest("start_ms", F.lit(0)) / width_ms))


def nearest_boundary(points: DataFrame, targets: DataFrame, tolerance_ms: int, key: str = "conv_id") -> DataFrame:
    """Each point's nearest target within tolerance_ms (ties: the smaller), by one scan in each direction over both
    sides together; target_ms is null without one."""
    both = points.select(key, F.col("at_ms").alias("t"), F.lit(1).alias("probe")).unionByName(targets.select(key, F.col("at_ms").alias("t"), F.lit(0).alias("probe")))
    own = F.when(F.col("probe") == 0, F.col("t"))
    back = Window.partitionBy(key).orderBy("t", "probe").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.desc("t"), "probe").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumns({"low": F.last(own, True).over(back), "high": F.last(own, True).over(ahead)}).filter("probe = 1")
    near = F.when(F.col("high").isNull() | (F.col("t") - F.col("low") <= F.col("high") - F.col("t")), F.col("low")).otherwise(F.col("high"))
    return rows.select(key, F.col("t").alias("at_ms"), F.when(F.abs(near - F.col("t")) <= tolerance_ms, near).alias("target_ms"))


def equal_windows(regions: DataFrame, most_ms: int) -> DataFrame:
    """Regions cut into the fewest equal windows of most_ms or less (integer milliseconds)."""
    span = F.col("end_ms") - F.col("start_ms")
    n = F.greatest(F.lit(1), F.ceil(span / most_ms))
    rows = regions.withColumn("n", n).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    at = lambda k: F.col("start_ms") + F.floor(span * k / F.col("n"))
    return rows.withColumns({"from_ms": at(F.col("piece")), "to_ms": at(F.col("piece") + 1)}).drop("n")
