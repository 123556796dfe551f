"""Acoustic evidence on windows of a recording, and log-mel bands of its samples."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators import intervals
from chronolake.operators.speakers import cosine

#: Margins between the cosines to both speakers from which on a label is doubted, or refuted.
DOUBT, REFUTED = 0.05, 0.10
#: Cosine distance of neighbours of one label that are far from each other.
FAR = 0.4


def local_turns(windows: DataFrame, turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """windows: key, window, start_ms, end_ms; turns: key, pos, speaker, start_ms, end_ms. The turns of each window, cut at its
    ends: turns, speakers, switches, speech_ms, the shortest and longest turn, and the lesser speaker's share of speech."""
    cut = intervals.overlap_join(turns, windows, key, 40_000).select(key, F.col("r_window").alias("window"), F.col("l_pos").alias("pos"), F.col("l_speaker").alias("speaker"), F.greatest("l_start_ms", "r_start_ms").alias("start_ms"), F.col("overlap_ms").alias("ms"))
    order = Window.partitionBy(key, "window").orderBy("start_ms", "pos")
    rows = cut.withColumn("switch", F.coalesce((F.lag("speaker").over(order) != F.col("speaker")).cast("int"), F.lit(0)))
    own = rows.groupBy(key, "window", "speaker").agg(F.count(F.lit(1)).alias("n"), F.sum("switch").alias("switches"), F.sum("ms").alias("ms"), F.min("ms").alias("shortest"), F.max("ms").alias("longest"))
    found = own.groupBy(key, "window").agg(F.sum("n").alias("turns"), F.count(F.lit(1)).alias("speakers"), F.sum("switches").alias("switches"), F.sum("ms").alias("speech_ms"), F.min("shortest").alias("shortest_ms"), F.max("longest").alias("longest_ms"), F.min("ms").alias("least_ms"))
    return found.withColumn("minority", F.when((F.col("speakers") > 1) & (F.col("speech_ms") > 0), F.col("least_ms") / F.col("speech_ms")).otherwise(0.0)).drop("least_ms")


def main_pair(segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """The two speakers of most time of each recording: dominant and minority (null if there is one; ties: the smaller label)."""
    order = Window.partitionBy(key).orderBy(F.desc("ms"), "speaker")
    own = segments.filter("speaker is not null").groupBy(key, "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms")).withColumn("rank", F.row_number().over(order))
    return own.filter("rank <= 2").groupBy(key).agg(F.max(F.when(F.col("rank") == 1, F.col("speaker"))).alias("dominant"), F.max(F.when(F.col("rank") == 2, F.col("speaker"))).alias("minority"))


def label_evidence(segments: DataFrame, centroids: DataFrame, pair: DataFrame, key: str = "conv_id") -> DataFrame:
    """segments: key, window, pos, speaker, embedding; centroids: key, label, centroid; pair: key, dominant, minority. By window how
    many labels the vectors doubt or refute, the least cosine to the own speaker, and how far neighbours are apart. Segments
    without a vector are passed over."""
    order = Window.partitionBy(key, "window").orderBy("pos")
    rows = segments.filter("embedding is not null").withColumns({"before": F.lag("embedding").over(order), "label_before": F.lag("speaker").over(order)})
    both = pair.join(centroids.select(key, F.col("label").alias("dominant"), F.col("centroid").alias("d")), [key, "dominant"], "left").join(centroids.select(key, F.col("label").alias("minority"), F.col("centroid").alias("m")), [key, "minority"], "left")
    known = F.col("d").isNotNull() & F.col("m").isNotNull()
    rows = rows.join(both, key, "left").withColumns({"to_d": F.when(known, cosine(F.col("embedding"), F.col("d"))), "to_m": F.when(known, cosine(F.col("embedding"), F.col("m"))), "step": F.when(F.col("before").isNotNull(), 1 - cosine(F.col("before"), F.col("embedding")))})
    on_d, on_m = F.col("speaker") == F.col("dominant"), F.col("speaker") == F.col("minority")
    margin = F.when(on_d, F.col("to_m") - F.col("to_d")).when(on_m, F.col("to_d") - F.col("to_m"))  # above 0: nearer to the other one
    rows = rows.withColumns({"margin": margin, "on_d": on_d, "on_m": on_m})
    return rows.groupBy(key, "window").agg(
        F.count_if(F.col("margin") > DOUBT).alias("disagreements"),
        F.count_if(F.col("on_d") & (F.col("margin") > REFUTED)).alias("refuted_dominant"),
        F.count_if(F.col("on_m") & (F.col("margin") > REFUTED)).alias("refuted_minority"),
        F.min(F.when(F.col("on_d"), F.col("to_d"))).alias("dominant_cos"),
        F.min(F.when(F.col("on_m"), F.col("to_m"))).alias("minority_cos"),
        F.greatest(F.max("step"), F.lit(0.0)).alias("widest_step"),
        F.count_if((F.col("speaker") == F.col("label_before")) & (F.col("step") > FAR)).alias("far_pairs"),
    )


def window_features(windows: DataFrame, turns: DataFrame, segments: DataFrame, centroids: DataFrame, silences: DataFrame, blocks: DataFrame, key: str = "conv_id") -> DataFrame:
    """Adds to windows (key, window, start_ms, end_ms) what is heard in each: its local turns, the evidence for its labels,
    silences and energy. segments: with window and embedding; blocks: key, at_ms, rms. Windows without any keep their row.

    The parts are aggregated to one row for a window each before they meet on (key, window), so nothing else is moved twice."""
    quiet = intervals.overlap_join(silences, windows, key, 40_000).groupBy(key, F.col("r_window").alias("window")).agg(F.count(F.lit(1)).alias("silences"), F.sum("overlap_ms").alias("silence_ms"))
    point = blocks.select(key, "rms", F.col("at_ms").alias("start_ms"), (F.col("at_ms") + 1).alias("end_ms"))
    energy = intervals.overlap_join(point, windows, key, 40_000).groupBy(key, F.col("r_window").alias("window")).agg(F.avg("l_rms").alias("energy_mean"), F.stddev_pop("l_rms").alias("energy_std"))
    rows = windows
    for part in (local_turns(windows, turns, key), label_evidence(segments, centroids, main_pair(segments, key), key), quiet, energy):
        rows = rows.join(part, [key, "window"], "left")
    zero = ("turns", "speakers", "switches", "speech_ms", "shortest_ms", "longest_ms", "disagreements", "refuted_dominant", "refuted_minority", "far_pairs", "silences", "silence_ms")
    rows = rows.na.fill(0, list(zero)).na.fill(0.0, ["minority", "widest_step", "energy_mean", "energy_std"])
    speech = F.round(F.col("speech_ms") / F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1)), 3)
    return rows.withColumns({"speech": speech, "minority": F.round("minority", 3), "dominant_cos": F.round("dominant_cos", 4), "minority_cos": F.round("minority_cos", 4), "widest_step": F.round("widest_step", 4), "energy_mean": F.round("energy_mean", 5), "energy_std": F.round("energy_std", 5)}).drop("speech_ms")


def scored(lexical: DataFrame, heard: DataFrame, key: str = "conv_id") -> DataFrame:
    """lexical: risk.features; heard: window_features. The windows of lexical with score and reasons by both; what isn't heard
    counts as nothing."""
    c = F.col
    own = heard.select(key, "window", *(c(n).alias(f"heard_{n}") for n in ("speakers", "switches", "minority", "disagreements", "refuted_dominant", "refuted_minority", "far_pairs", "dominant_cos", "silence_ms")))
    rows = lexical.join(own, [key, "window"], "left")
    rows = rows.na.fill(0, [n for n in own.columns if n not in (key, "window", "heard_dominant_cos")])
    more = c("heard_switches") - c("switches")
    one, two = c("speakers") <= 1, c("heard_speakers") >= 2
    strict = one & two & (c("heard_minority") >= 0.25) & (c("heard_silence_ms") < 6000)

    def some(name: str, points: float, most: int | None = None) -> tuple[Column, Column]:
        return c(name) > 0, points * (c(name) if most is None else F.least(F.lit(most), c(name)))

    # Points of each reason, by the feature and the number that still counts.
    parts: dict[str, tuple[Column, Column]] = {
        "refuted_dominant": some("heard_refuted_dominant", 4.0, 3),
        "refuted_minority": some("heard_refuted_minority", 4.0, 3),
        "doubted_label": ((c("heard_disagreements") > 0) & (c("heard_refuted_dominant") + c("heard_refuted_minority") == 0), 1.0 * F.least(F.lit(3), c("heard_disagreements"))),
        "far_neighbours": some("heard_far_pairs", 3.0, 3),
        "many_more_switches": (more >= 3, F.lit(3.0)),
        "more_switches": (more == 2, F.lit(1.5)),
        "dominant_far": (c("heard_dominant_cos") < 0.40, F.lit(2.0)),
        "dominant_off": ((c("heard_dominant_cos") >= 0.40) & (c("heard_dominant_cos") < 0.55), F.lit(1.0)),
        "two_heard_strict": (strict, F.lit(3.0)),
        "two_heard": (~strict & one & two & (c("heard_minority") >= 0.15), F.lit(1.0)),
        "single_label": (c("single_label"), F.lit(1.5)),
        "mixed_cues": some("mixed_cues", 1.5, 2),
        "hinted": some("hinted", 1.0, 3),
        "tight_boundaries": some("tight_boundaries", 0.75, 4),
        "short_turns": some("short_turns", 0.5, 4),
        "aba": (c("aba"), F.lit(1.5)),
        "long_cross": some("long_cross", 1.0),
        "odd_rates": some("odd_rates", 0.5, 3),
        "both_cues": ((c("question_cues") > 0) & (c("answer_cues") > 0) & (c("speakers") <= 2), F.lit(0.3)),
        "no_silence": ((c("heard_silence_ms") < 500) & two & (c("speakers") >= 2), F.lit(0.5)),
    }
    score = sum((F.when(hit, points).otherwise(0.0) for hit, points in parts.values()), F.lit(0.0))
    return rows.withColumns({"score": F.bround(score, 3), "reasons": F.array_compact(F.array(*(F.when(hit, name) for name, (hit, _) in parts.items())))})


# Samples a second, of a frame's window, between frames and of a transform; bands; weight of the sample before;
# what is added before the logarithm and to a band's deviation.
RATE, WINDOW, HOP, SIZE, BANDS, EMPHASIS, FLOOR, LEAST = 16_000, 400, 160, 512, 80, 0.97, 2.0**-24, 1e-5
#: Frames that are transformed at once, and rows of a batch that is handed on.
BLOCK = 4096


def _mel(hertz):
    """Linear below 1000 Hz, then logarithmic."""
    hertz = np.asarray(hertz, np.float64)
    return np.where(hertz < 1000, hertz * 3 / 200, 15 + np.log(np.maximum(hertz, 1000) / 1000) * 27 / np.log(6.4))


def _hertz(mel):
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


@lru_cache(maxsize=4)
def mel_filters(rate: int = RATE, size: int = SIZE, bands: int = BANDS) -> np.ndarray:
    """Triangles over the bins of a transform (bins x bands), each of the same area."""
    edges = _hertz(np.linspace(_mel(0.0), _mel(rate / 2), bands + 2))
    bins = np.linspace(0, rate / 2, size // 2 + 1)[:, None]
    up = (bins - edges[:-2]) / np.diff(edges)[:-1]
    down = (edges[2:] - bins) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(up, down)) * 2 / (edges[2:] - edges[:-2])


def log_mel_of(samples: np.ndarray) -> np.ndarray:
    """Log-mel bands (frames x bands) of a recording, each band with mean 0 and population deviation 1 over time."""
    x = np.asarray(samples, np.float64)
    x = np.append(x[:1], x[1:] - EMPHASIS * x[:-1])
    x = np.pad(np.pad(x, (0, max(0, SIZE - len(x)))), SIZE // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(x, SIZE)[::HOP]
    shape = np.zeros(SIZE)
    shape[:WINDOW] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)
    out = np.empty((len(frames), BANDS))
    for at in range(0, len(frames), BLOCK):
        power = np.abs(np.fft.rfft(frames[at : at + BLOCK] * shape)) ** 2
        out[at : at + BLOCK] = np.log(power @ mel_filters() + FLOOR)
    return (out - out.mean(axis=0)) / (out.std(axis=0) + LEAST)


def log_mel(recordings: DataFrame, key: str = "rec") -> DataFrame:
    """recordings: key, samples (array of numbers). key, frame and bands for each frame. A null or empty recording has no frames,
    null samples are 0. A recording is held by one task: its samples and bands, a hundredth of a second to 80 numbers."""

    def run(batches):
        for batch in batches:
            for name, samples in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not samples.is_valid or not len(samples):
                    continue
                bands = log_mel_of(samples.values.fill_null(0.0).to_numpy())
                for at in range(0, len(bands), BLOCK):
                    part = bands[at : at + BLOCK]
                    flat = pa.ListArray.from_arrays(np.arange(0, part.size + 1, BANDS, dtype=np.int32), part.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), batch.schema.field(0).type), pa.array(np.arange(at, at + len(part))), flat], names=[key, "frame", "bands"])

    rows = recordings.select(key, F.col("samples").cast("array<double>").alias("samples"))
    return rows.mapInArrow(run, f"{key} {recordings.schema[key].dataType.simpleString()}, frame long, bands array<double>")
