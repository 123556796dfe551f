"""Risk of windows: cues, switches and odd segments in windows of a recording, their score and the choice of the riskiest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions import rules
from chronolake.operators import guard, intervals


def features(segments: DataFrame, width_ms: int = 40_000, middle_ms: int = 2000, tight_ms: int = 250, question: tuple = rules.QUESTION_CUES, answer: tuple = rules.ANSWER_CUES, key: str = "conv_id") -> DataFrame:
    """One row for each recording and window, by one shuffle on the recording."""
    whole = Window.partitionBy(key)
    rows = guard.boundary_hints(segments, key=key).withColumn("until", F.max("end_ms").over(whole))
    rows = intervals.tumbling(rows, width_ms)
    order = Window.partitionBy(key, "window").orderBy("pos")
    before, after = F.lag("speaker").over(order), F.lead("speaker").over(order)
    inner = (F.row_number().over(order) > 1) & F.lead("pos").over(order).isNotNull()
    span = F.col("end_ms") - F.col("start_ms")
    edge = F.least((F.col("window") + 1) * width_ms, F.col("until"))
    rate = F.length("text") * 1000 / F.greatest(span.cast("double"), F.lit(1e-3))
    change = F.coalesce(before != F.col("speaker"), F.lit(False))
    rows = rows.withColumns({"q": rules.cues(F.col("text"), question), "a": rules.cues(F.col("text"), answer), "change": change, "odd": (rate < 1) | (rate > 8), "short": span <= 1000,
        "cross": (F.col("start_ms") < edge - 5000) & (F.col("end_ms") > edge) & (span >= 12_000), "tight": change & (F.abs(F.col("start_ms") - F.lag("end_ms").over(order)) <= tight_ms),
        "aba": inner & (before == after) & (before != F.col("speaker")) & (span <= middle_ms)})
    both = (F.col("q") > 0) & (F.col("a") > 0)
    found = rows.groupBy(key, "window").agg(
        F.count(F.lit(1)).alias("segments"), F.sum(F.length("text")).alias("chars"), F.countDistinct("speaker").alias("speakers"), F.count_if("change").alias("switches"),
        F.sum("q").alias("question_cues"), F.sum("a").alias("answer_cues"), F.count_if(both).alias("mixed_cues"), F.bool_or(F.coalesce("aba", F.lit(False))).alias("aba"),
        F.count_if("short").alias("short_turns"), F.count_if("tight").alias("tight_boundaries"), F.count_if(F.size("hints") > 0).alias("hinted"),
        F.count_if("cross").alias("long_cross"), F.count_if("odd").alias("odd_rates"),
    )
    return found.withColumn("single_label", (F.col("speakers") == 1) & (F.col("question_cues") > 0) & (F.col("answer_cues") > 0))


def scored(windows: DataFrame) -> DataFrame:
    """features with score and reasons."""
    c = F.col
    # Points of each reason, by the feature and the number that still counts.
    parts = (
        ("single_label", c("single_label"), F.lit(5.0)),
        ("mixed_cues", c("mixed_cues") > 0, 3.5 * F.least(F.lit(2), c("mixed_cues"))),
        ("hinted", c("hinted") > 0, 2.0 * F.least(F.lit(3), c("hinted"))),
        ("tight_boundaries", c("tight_boundaries") > 0, 1.5 * F.least(F.lit(4), c("tight_boundaries"))),
        ("short_turns", c("short_turns") > 0, 1.0 * F.least(F.lit(4), c("short_turns"))),
        ("aba", c("aba"), F.lit(3.0)),
        ("long_cross", c("long_cross") > 0, 2.5 * c("long_cross")),
        ("long_single", (c("segments") <= 1) & (c("chars") >= 120) & (c("question_cues") + c("answer_cues") > 0), F.lit(3.0)),
        ("many_segments", c("segments") >= 5, F.lit(1.5)),
        ("many_switches", c("switches") >= 3, F.lit(1.5)),
        ("odd_rates", c("odd_rates") > 0, 0.75 * F.least(F.lit(3), c("odd_rates"))),
        ("both_cues", (c("question_cues") > 0) & (c("answer_cues") > 0) & (c("speakers") <= 2), F.lit(1.0)),
    )
    score = sum((F.when(hit, points).otherwise(0.0) for _, hit, points in parts), F.lit(0.0))
    return windows.withColumns({"score": F.bround(score, 3), "reasons": F.array_compact(F.array(*(F.when(hit, name) for name, hit, _ in parts)))})


def riskiest(windows: DataFrame, least: float = 5.0, most: int = 0, key: str = "conv_id") -> DataFrame:
    """Windows with a score of ``least`` or more; most > 0: the first ``most`` of each recording (ties: the earlier)."""
    rows = windows.filter(F.col("score") >= least)
    if most <= 0:
        return rows
    order = Window.partitionBy(key).orderBy(F.desc("score"), "window")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("rank")
