"""Operators on ordered segments. State that depends on earlier output is one ordered pass over a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions import rules
from chronolake.operators.ordered import ordered_pass

_ORDER = ["pos", "speaker", "text", "start_ms", "end_ms"]
_OUT = "seg_no long, speaker string, text string, start_ms long, end_ms long"


def _columns() -> list[str | Column]:
    return ["pos", "speaker", "text", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms")]


def merge_segments(segments: DataFrame, gap_ms: int, cap_ms: int, closed: bool = False, guard: bool = True, key: str = "conv_id", placed: bool = False) -> DataFrame:
    """Merges a segment into the one before if the speaker is the same (null-safe), the gap is below gap_ms (closed:
    or equal) and the merged span is at most cap_ms (<= 0: no cap). guard: and it does not start before the
    previous input row. End is the larger one; texts are joined. Times that are null merge with nothing, and a null
    text makes the joined one null."""

    def joins(speaker, first, until, last, who, start, end) -> bool:
        if speaker != who or start is None or until is None or (guard and (last is None or start < last)):
            return False
        if cap_ms > 0 and (end is None or first is None or end - first > cap_ms):
            return False
        return start - until <= gap_ms if closed else start - until < gap_ms

    def fold(rows):
        n, speaker, texts, first, until, last = -1, None, None, None, None, None
        for _, _, who, text, start, end in rows:
            if n >= 0 and joins(speaker, first, until, last, who, start, end):
                texts.append(text)
                until = max(until, end) if end is not None else until
            else:
                if n >= 0:
                    yield n, speaker, None if None in texts else "".join(texts), first, until
                n, speaker, texts, first, until = n + 1, who, [text], start, end
            last = start
        yield n, speaker, None if None in texts else "".join(texts), first, until

    return ordered_pass(segments, key, _ORDER, _columns(), fold, _OUT, placed)


def smooth_aba(segments: DataFrame, most_ms: int, dense_ms: int = 1000, dense_cps: float = 5.0, wide: bool = False, key: str = "conv_id", placed: bool = False) -> DataFrame:
    """A short middle segment between two of another speaker takes their speaker if it is a backchannel, or no
    longer than dense_ms with dense_cps characters a second or more. Left to right: a changed segment is the
    next one's left neighbour. wide: more assents, and tails of questions."""
    span = F.col("end_ms") - F.col("start_ms")
    bare = F.trim("text")
    small = rules.backchannel(bare, wide) | ((span <= dense_ms) & (F.length(bare) * 1000 >= dense_cps * span) & (span > 0))
    if wide:
        small = small | rules.question_tail(F.col("text"))
    small = F.coalesce((span <= most_ms) & small, F.lit(False)).alias("small")

    def fold(rows):
        before = held = None  # the last two segments, of which the later one may still change
        n = 0
        for _, _, who, text, start, end, may in rows:
            if held is not None:
                if before is not None and held[4] and before[0] == who and held[0] != who:
                    held = (who, *held[1:])
                yield n, *held[:4]
                n += 1
            before, held = held, (who, text, start, end, may)
        yield n, *held[:4]

    return ordered_pass(segments, key, _ORDER, [*_columns(), small], fold, _OUT, placed)


def speaker_runs(segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """Runs of one speaker over non-empty texts: gaps and islands; the end is the last row's."""
    order = Window.partitionBy(key).orderBy("pos")
    rows = segments.filter(F.trim("text") != "")
    rows = rows.withColumn("new", F.coalesce((~F.lag("speaker").over(order).eqNullSafe(F.col("speaker"))).cast("int"), F.lit(1)))
    rows = rows.withColumn("new", F.when(F.row_number().over(order) == 1, 1).otherwise(F.col("new"))).withColumn("run", F.sum("new").over(order))
    return rows.groupBy(key, "run").agg(F.min_by("speaker", "pos").alias("speaker"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"), F.count(F.lit(1)).alias("n"))


def ema(rows: DataFrame, key: str, order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """Exponential moving average over each key's positive values in order; null without any."""
    seen = rows.filter(F.col(value) > 0).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("rows"))
    folded = F.aggregate("rows", F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x["v"]).otherwise(a * (1 - alpha) + x["v"] * alpha))
    return seen.select(key, folded.alias("ema"))


def last_kept(points: DataFrame, key: str, point: str, epsilon: int) -> DataFrame:
    """Sorted points without those within epsilon of the last kept one."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        last = None
        for _, at in rows:
            if last is None or at - last > epsilon:
                last = at
                yield (at,)

    rows = points.select(key, F.col(point).cast("long").alias(point)).filter(F.col(point).isNotNull())
    return ordered_pass(rows, key, [point], [point], fold, f"{point} long")


def switches(segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """Speaker changes and minutes of each recording."""
    order = Window.partitionBy(key).orderBy("pos")
    marked = segments.withColumn("change", (F.lag("speaker").over(order) != F.col("speaker")).cast("int"))
    return marked.groupBy(key).agg(F.coalesce(F.sum("change"), F.lit(0)).alias("switches"), (F.max("end_ms") - F.min("start_ms")).alias("span_ms"))
