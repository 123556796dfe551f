"""The short-segment guard and other corrections of who speaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions import rules
from chronolake.operators import sequence
from chronolake.operators.ordered import ordered_pass


def absorb_tiny(segments: DataFrame, least_ms: int, gap_ms: int | None = 100, key: str = "conv_id") -> DataFrame:
    """A segment shorter than least_ms with a text joins the nearer neighbour (ties: the one before) if the gap is at
    most gap_ms (None: any). The one before is the last row put out; one that took in its predecessor isn't tested again."""

    def fold(rows):
        n, last, skip = 0, None, False  # last may still take in what follows
        cur = next(rows)[2:]
        while cur is not None:
            ahead = next(rows, None)
            ahead = ahead and ahead[2:]
            (who, text, start, end), now = cur, cur
            cur = ahead
            if skip:
                skip = False
                continue
            if start is not None and end is not None and end - start < least_ms and (text or "").strip(" "):
                back = None if last is None or last[3] is None else start - last[3]
                front = None if ahead is None or ahead[2] is None else ahead[2] - end
                to_last = last is not None and (ahead is None or (back is not None and front is not None and back <= front))
                gap = back if to_last else front
                if (to_last or ahead is not None) and (gap_ms is None or (gap is not None and gap <= gap_ms)):
                    if to_last:
                        last = (last[0], (last[1] or "") + (text or ""), last[2], end if last[3] is None else max(last[3], end))
                        continue
                    now = (ahead[0], (text or "") + (ahead[1] or ""), start if ahead[2] is None else min(start, ahead[2]), ahead[3])
                    skip = True
            if last is not None:
                yield n, *last
                n += 1
            last = now
        yield n, *last

    return ordered_pass(segments, key, sequence._ORDER, sequence._columns(), fold, sequence._OUT)


def short_guard(segments: DataFrame, least_ms: int = 1500, middle_ms: int = 1500, gap_ms: int = 50, cap_ms: int = 0, key: str = "conv_id") -> DataFrame:
    """absorb_tiny, smooth_aba, then the merge of neighbours of one speaker: three passes after one shuffle."""
    rows = absorb_tiny(segments, least_ms, gap_ms, key).withColumnRenamed("seg_no", "pos")
    rows = sequence.smooth_aba(rows, middle_ms, key=key, placed=True).withColumnRenamed("seg_no", "pos")
    return sequence.merge_segments(rows, gap_ms, cap_ms, closed=True, guard=False, key=key, placed=True)


def has_aba(segments: DataFrame, most_ms: int, keys: list[str]) -> DataFrame:
    """Whether any row of each key lies between two of another speaker and lasts at most most_ms."""
    order = Window.partitionBy(*keys).orderBy("pos")
    a, c = F.lag("speaker").over(order), F.lead("speaker").over(order)
    hit = (F.row_number().over(order) > 1) & F.lead("pos").over(order).isNotNull() & a.eqNullSafe(c) & ~a.eqNullSafe(F.col("speaker")) & (F.col("end_ms") - F.col("start_ms") <= most_ms)
    return segments.withColumn("hit", hit).groupBy(*keys).agg(F.bool_or("hit").alias("aba"))


def boundary_hints(segments: DataFrame, gap_ms: int = 250, short_ms: int = 1000, key: str = "conv_id") -> DataFrame:
    """hints of each row: a change of speaker within gap_ms to the left or right, and very short turns."""
    order = Window.partitionBy(key).orderBy("pos")
    left = ~F.lag("speaker").over(order).eqNullSafe(F.col("speaker")) & (F.abs(F.col("start_ms") - F.lag("end_ms").over(order)) <= gap_ms)
    right = ~F.lead("speaker").over(order).eqNullSafe(F.col("speaker")) & (F.abs(F.lead("start_ms").over(order) - F.col("end_ms")) <= gap_ms)
    hints = F.array_compact(F.array(F.when(left, "tight_left_speaker_boundary"), F.when(right, "tight_right_speaker_boundary"), F.when(F.col("end_ms") - F.col("start_ms") <= short_ms, "very_short_turn_low_confidence")))
    return segments.withColumn("hints", hints).withColumn("mixed_speaker", F.exists("hints", lambda h: h.startswith("tight_")))


def roles(segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """answer (the speaker with most characters) and question of each recording with exactly two speakers; ties: the
    one who speaks first answers."""
    mass = segments.groupBy(key, "speaker").agg(F.sum(F.length("text")).alias("chars"), F.min("pos").alias("first"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("chars")).alias("c"), "first", "speaker")))
    rows = mass.groupBy(key).agg(order.alias("o")).filter(F.size("o") == 2)
    return rows.select(key, F.get("o", F.lit(0))["speaker"].alias("answer"), F.get("o", F.lit(1))["speaker"].alias("question"))


def smooth_roles(segments: DataFrame, question: tuple = rules.QUESTION_CUES, answer: tuple = rules.ANSWER_CUES, question_ms: int = 10_000, answer_ms: int = 12_000, key: str = "conv_id") -> DataFrame:
    """Short segments of a two-person interview whose cues belong to the other role take its speaker."""
    rows = segments.join(roles(segments, key), key, "left")
    q, a, span = rules.cues(F.col("text"), question), rules.cues(F.col("text"), answer), F.col("end_ms") - F.col("start_ms")
    asks = (F.col("speaker") == F.col("answer")) & (span <= question_ms) & (q >= 1) & (q >= a)
    tells = (F.col("speaker") == F.col("question")) & (span <= answer_ms) & (a >= 1) & (a > q)
    new = F.when(asks, F.col("question")).when(tells, F.col("answer")).otherwise(F.col("speaker"))
    return rows.withColumn("smoothed_from", F.when(asks | tells, F.col("speaker"))).withColumn("speaker", new).drop("answer", "question")
