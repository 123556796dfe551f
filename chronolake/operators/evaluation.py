"""Reports: errors of texts, confusion of speakers, offsets of timestamps, alignment of boundaries, runs of benchmarks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from chronolake.functions.blocks import blocks, gaps, similarity
from chronolake.functions.text import unit_ratio
from chronolake.operators import intervals


@F.pandas_udf(Y.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility normal form, which has no built-in."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def plain(text: Column) -> Column:
    """Lower case without punctuation, symbols and separators, in compatibility normal form."""
    return F.regexp_replace(F.lower(nfkc(text)), r"[\p{P}\p{Z}\p{S}\x{FEFF}\n\r\t]", "")


def edit_stats(pairs: DataFrame, key: str, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Equal, inserted, deleted and replaced characters, edits and their share of the reference, by matching blocks; a null text
    counts as empty."""
    rows = pairs.select(key, F.length(ref).alias("ref_chars"), F.length(hyp).alias("hyp_chars"), ref, hyp, blocks(ref, hyp).alias("blocks"))
    rows = rows.withColumn("gaps", gaps(F.col("blocks"), F.col(ref), F.col(hyp)))

    def total(column: str, value) -> Column:
        return F.aggregate(column, F.lit(0), lambda s, x: s + value(x))

    both = lambda x: (x["a"] > 0) & (x["b"] > 0)
    rows = rows.select(
        key, "ref_chars", "hyp_chars", total("blocks", lambda x: x["n"]).alias("equal"),
        total("gaps", lambda x: F.when(x["a"] == 0, x["b"]).otherwise(0)).alias("inserted"), total("gaps", lambda x: F.when(x["b"] == 0, x["a"]).otherwise(0)).alias("deleted"),
        total("gaps", lambda x: F.when(both(x), x["a"]).otherwise(0)).alias("replaced_ref"), total("gaps", lambda x: F.when(both(x), x["b"]).otherwise(0)).alias("replaced_hyp"),
    )
    rows = rows.withColumn("edits", F.col("inserted") + F.col("deleted") + F.greatest("replaced_ref", "replaced_hyp"))
    return rows.withColumn("error_rate", unit_ratio(F.col("edits"), F.col("ref_chars")))


def confusion(chars: DataFrame, key: str = "rec") -> DataFrame:
    """chars: key, own, true for each compared character. Counts of label pairs."""
    return chars.groupBy(key, "own", "true").agg(F.count(F.lit(1)).alias("n"))


def mapped_accuracy(counts: DataFrame, mapping: DataFrame, key: str = "rec") -> DataFrame:
    """Share of characters whose mapped label is the true one."""
    rows = counts.join(mapping, [key, "own"], "left")
    hit = F.when(F.col("mapped") == F.col("true"), F.col("n")).otherwise(0)
    return rows.groupBy(key).agg(unit_ratio(F.sum(hit), F.sum("n")).alias("accuracy"))


def segment_majority(chars: DataFrame, mapping: DataFrame, key: str = "rec", mixed: float = 0.9) -> DataFrame:
    """chars: key, segment, own, true. Each segment's most frequent true label (ties: the smaller), whether it is the mapped one,
    and whether it holds less than ``mixed`` of the segment."""
    counts = chars.groupBy(key, "segment", "own", "true").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(key, "segment", "own").agg(F.sum("n").alias("matched"), F.min(F.struct((-F.col("n")).alias("o"), "true")).alias("m"))
    rows = top.join(mapping, [key, "own"], "left")
    return rows.select(key, "segment", "matched", F.col("m.true").alias("majority"), F.coalesce(F.col("mapped") == F.col("m.true"), F.lit(False)).alias("right"), (-F.col("m.o") < mixed * F.col("matched")).alias("mixed"))


def worst_segments(segments: DataFrame, most: int = 12, key: str = "rec") -> DataFrame:
    """The wrong segments with most characters of each recording."""
    order = Window.partitionBy(key).orderBy(F.desc("matched"), "segment")
    return segments.filter("not right").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def segment_report(labels: DataFrame, key: str = "rec") -> DataFrame:
    """labels: rows of segment_majority. Segments considered, with the mapped label, with another, and mixed ones."""
    rows = labels.groupBy(key).agg(F.count(F.lit(1)).alias("considered"), F.count_if("right").alias("ok"), F.count_if(~F.col("right")).alias("wrong"), F.count_if("mixed").alias("mixed"))
    return rows.withColumn("accuracy", unit_ratio(F.col("ok"), F.col("considered")))


def boundary_alignment(segments: DataFrame, regions: DataFrame, durations: DataFrame, tolerance_ms: int = 300, epsilon_ms: int = 10, key: str = "conv_id") -> DataFrame:
    """Share of the segments' boundaries that lie outside speech or within tolerance_ms of a region's edge; 1 without any.
    durations: key, duration_ms."""
    from chronolake.operators import sequence

    edges = segments.select(key, F.explode(F.array("start_ms", "end_ms")).alias("at_ms")).join(durations, key)
    edges = edges.filter((F.col("at_ms") > epsilon_ms) & (F.col("at_ms") < F.col("duration_ms") - epsilon_ms))
    kept = sequence.last_kept(edges, key, "at_ms", epsilon_ms)
    inner = intervals.overlap_join(kept.select(key, F.col("at_ms").alias("pos"), F.col("at_ms").alias("start_ms"), (F.col("at_ms") + 1).alias("end_ms")), regions.select(key, F.lit(0).alias("pos"), "start_ms", "end_ms"), key)
    inner = inner.filter("r_start_ms < l_pos and l_pos < r_end_ms").select(key, F.col("l_pos").alias("at_ms"), F.lit(True).alias("speech")).distinct()
    targets = regions.select(key, F.explode(F.array("start_ms", "end_ms")).alias("at_ms"))
    near = intervals.nearest_boundary(kept, targets, tolerance_ms, key)
    rows = near.join(inner, [key, "at_ms"], "left").withColumn("quiet", F.col("speech").isNull())
    ok = F.col("quiet") | F.col("target_ms").isNotNull()
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("boundaries"), F.count_if("quiet").alias("in_silence"), F.count_if(ok).alias("aligned"))
    out = durations.select(key).join(found, key, "left").na.fill(0)
    return out.withColumn("ratio", F.when(F.col("boundaries") > 0, F.col("aligned") / F.col("boundaries")).otherwise(F.lit(1.0)))


def offsets(rows: DataFrame, key: str, offset: str, limits: tuple = (100, 200, 500)) -> DataFrame:
    """Mean, elements n // 2 and 9 n // 10 of the sorted offsets, the largest, and the shares within the limits."""
    v = rows.groupBy(key).agg(F.count(offset).alias("n"), F.avg(offset).alias("mean"), F.max(offset).alias("most"), F.sort_array(F.collect_list(offset)).alias("v"), *(F.avg((F.col(offset) <= x).cast("int")).alias(f"within_{x}") for x in limits))
    at = lambda p: F.get("v", F.floor(F.col("n") * p).cast("int"))
    return v.withColumns({"p50": at(0.5), "p90": F.get("v", F.floor(F.col("n") * 9 / 10).cast("int"))}).drop("v")


def zip_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a, b: key, pos, ch, at_ms. Rows of equal rank with equal characters and how far apart they are."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    left = a.select(key, rank.alias("k"), "ch", F.col("at_ms").alias("a_ms"))
    right = b.select(key, rank.alias("k"), F.col("ch").alias("other"), F.col("at_ms").alias("b_ms"))
    # a row for each character: its size is guessed far too low, and so it must not be broadcast
    return left.hint("merge").join(right, [key, "k"]).filter("ch = other").select(key, "k", "ch", F.abs(F.col("a_ms") - F.col("b_ms")).alias("offset_ms"))


def char_offsets(segments: DataFrame, chars: DataFrame, key: str = "conv_id") -> DataFrame:
    """chars: key, n (place in the whole text from 1), start_ms, end_ms. How far each segment's ends are from those of its first and last character,
    by the running length of texts."""
    order = Window.partitionBy(key).orderBy("pos")
    rows = segments.filter("text <> ''").withColumn("to", F.sum(F.length("text")).over(order)).withColumn("from", F.col("to") - F.length("text") + 1)
    first, last = chars.select(key, F.col("n").alias("from"), F.col("start_ms").alias("c_start")), chars.select(key, F.col("n").alias("to"), F.col("end_ms").alias("c_end"))
    # a row for each character: its size is guessed far too low, and so it must not be broadcast
    hit = rows.join(first.hint("merge"), [key, "from"]).join(last.hint("merge"), [key, "to"])
    return hit.select(key, "pos", F.abs(F.col("start_ms") - F.col("c_start")).alias("start_off"), F.abs(F.col("end_ms") - F.col("c_end")).alias("end_off"))


def speaker_summary(segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """Speakers of each recording by falling duration with their shares (4 places), and totals."""
    own = segments.groupBy(key, "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), F.count(F.lit(1)).alias("n"))
    rows = own.groupBy(key).agg(F.sum("ms").alias("total_ms"), F.sum("n").alias("segments"), F.count(F.lit(1)).alias("speakers"), F.sort_array(F.collect_list(F.struct((-F.col("ms")).alias("o"), "speaker", "ms"))).alias("l"))
    total = F.when(F.col("total_ms") == 0, 1).otherwise(F.col("total_ms"))
    return rows.select(key, "total_ms", "segments", "speakers", F.transform("l", lambda x: F.struct(x["speaker"].alias("speaker"), F.bround(x["ms"] / total, 4).alias("share"))).alias("by_speaker"))


def count_verdict(found: DataFrame, keys: list[str], truth: str) -> DataFrame:
    """found: keys, speaker, truth. Whether the number of speakers is right, over or under."""
    rows = found.groupBy(*keys).agg(F.countDistinct("speaker").alias("n"), F.max(truth).alias("truth"))
    return rows.withColumn("verdict", F.when(F.col("n") == F.col("truth"), "OK").when(F.col("n") > F.col("truth"), "over").otherwise("under"))


def similar_run(texts: DataFrame, least: float = 0.95, run: int = 4, key: str = "conv_id") -> DataFrame:
    """The first run of ``run`` texts in a row in which each is nearly the one before; places count texts that aren't blank."""
    rows = texts.withColumn("t", F.trim("text")).filter("t <> ''")
    order = Window.partitionBy(key).orderBy("pos")
    rows = rows.select(key, "pos", "t", (F.row_number().over(order) - 1).alias("i"), F.lag("t").over(order).alias("before"))
    # Lengths bound the ratio from above, so few pairs reach the comparison.
    bound = 2 * F.least(F.length("t"), F.length("before")) / (F.length("t") + F.length("before"))
    rows = rows.withColumn("sim", F.when(F.col("t") == F.col("before"), F.lit(1.0)).when(bound >= least, similarity("before", "t")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("block", F.sum(F.when(F.col("sim") >= least, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.min("i").over(Window.partitionBy(key, "block")))
    hits = rows.filter(F.col("i") - F.col("start") + 1 >= run)
    first = hits.groupBy(key).agg(F.min(F.struct("i", "start", "sim")).alias("m"))
    return first.select(key, F.col("m.start").cast("long").alias("segment_start"), F.col("m.i").cast("long").alias("segment_end"), F.bround("m.sim", 4).alias("similarity"))


def run_report(runs: DataFrame, keys: list[str]) -> DataFrame:
    """runs: keys, seconds (processing), audio_s, wall_s, ok. Counts, spread of times, both ratios (mean of ratios and ratio of
    sums), and concurrency; 0 where nothing can be divided."""
    done = F.when(F.col("ok"), F.col("seconds"))
    audio = F.when(F.col("ok"), F.col("audio_s"))
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("ok").alias("done"), unit_ratio(F.count_if("ok") * 100, F.count(F.lit(1))).alias("done_pct"),
        F.avg(done).alias("mean_s"), F.min(done).alias("least_s"), F.max(done).alias("most_s"), F.coalesce(F.stddev_samp(done), F.lit(0.0)).alias("deviation_s"),
        F.coalesce(F.avg(F.try_divide(done, F.nullif(audio, F.lit(0)))), F.lit(0.0)).alias("mean_ratio"), unit_ratio(F.sum(done), F.sum(audio)).alias("sum_ratio"),
        unit_ratio(F.sum(audio), F.max("wall_s")).alias("efficiency"), unit_ratio(F.sum(done), F.max("wall_s")).alias("speedup"),
    )


def against_first(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Speed of each row relative to the first one of its key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("speedup", F.try_divide(F.first(value).over(w).cast("double"), F.nullif(F.col(value), F.lit(0))))


def stage_ratio(stages: DataFrame, stage: str, level: str, value: str, low: int = 1, high: int = 2) -> DataFrame:
    """Mean of each stage at the high level by that at the low one."""
    return stages.groupBy(stage).agg(unit_ratio(F.avg(F.when(F.col(level) == high, F.col(value))), F.avg(F.when(F.col(level) == low, F.col(value)))).alias("ratio"))


def peaks(samples: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Mean and largest value and when it was reached first; null for a key without values."""
    top = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col(value)).alias("o"), F.col(at).alias("t"))))
    return samples.groupBy(key).agg(F.avg(value).alias("mean"), F.max(value).alias("peak"), top.alias("m")).select(key, "mean", "peak", F.col("m.t").alias("at"))


def listing(before: DataFrame, after: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Old and new values of all names, N/A where one is missing; names without any value are left out."""
    both = before.select(name, F.col(value).alias("old")).join(after.select(name, F.col(value).alias("new")), name, "full").filter("old is not null or new is not null")
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    return both.select(name, F.concat(show("old"), F.lit(" -> "), show("new")).alias("line"))


def check_report(checks: DataFrame, key: str) -> DataFrame:
    """checks: key, severity (ok, warning, error), name, at. The worst severity and the names of warnings and of errors, each
    once, by their first appearance."""
    once = checks.groupBy(key, "severity", "name").agg(F.min("at").alias("at"))
    named = lambda s: F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.struct("at", "name"))))
    rows = once.groupBy(key).agg(named("warning").alias("w"), named("error").alias("e"))
    status = F.when(F.size("e") > 0, "error").when(F.size("w") > 0, "warning").otherwise("ok")
    return rows.select(key, status.alias("status"), F.transform("w", lambda x: x["name"]).alias("warnings"), F.transform("e", lambda x: x["name"]).alias("errors"))


def system_load(samples: DataFrame, key: str) -> DataFrame:
    """samples: key, cores (use of each), memory. Mean and peak of the use summed over cores, and of memory."""
    whole = F.aggregate("cores", F.lit(0.0), lambda s, x: s + x)
    rows = samples.select(key, whole.alias("load"), "memory")
    return rows.groupBy(key).agg(F.avg("load").alias("load_mean"), F.max("load").alias("load_peak"), F.avg("memory").alias("memory_mean"), F.max("memory").alias("memory_peak"), F.count(F.lit(1)).alias("samples"))
