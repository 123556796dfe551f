"""Frames of overlapping chunks to turns: votes on one grid, top speakers of each frame, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators import clusters

# Samples of a chunk, of a step between chunks, between frames and under a frame; samples a second.
CHUNK, STEP, SHIFT, FIELD, RATE = 160_000, 16_000, 270, 991, 16_000


def on_grid(frames: DataFrame) -> DataFrame:
    """frames: rec, chunk, frame, active (array of 0 or 1 by slot). at: the frame's place on the recording's grid; frames
    beyond the grid's end are left out."""
    last = F.max("chunk").over(Window.partitionBy("rec"))
    rows = frames.withColumn("at", F.floor(F.col("chunk") * STEP / SHIFT + 0.5) + F.col("frame"))
    return rows.withColumn("size", F.floor((CHUNK + last * STEP) / SHIFT) + 1).filter("at < size").drop("size")


def speakers_per_frame(frames: DataFrame) -> DataFrame:
    """Mean number of active slots over the chunks that cover a frame, rounded half up."""
    active = F.aggregate("active", F.lit(0), lambda s, x: s + x)
    rows = on_grid(frames).groupBy("rec", "at").agg(F.sum(active).alias("n"), F.count(F.lit(1)).alias("w"))
    return rows.select("rec", "at", F.floor(F.col("n") / (F.col("w") + 1e-12) + 0.5).alias("speakers"))


def without_overlap(frames: DataFrame) -> DataFrame:
    """Frames with two or more active slots count as silent."""
    active = F.aggregate("active", F.lit(0), lambda s, x: s + x)
    return frames.withColumn("active", F.when(active >= 2, F.transform("active", lambda x: F.lit(0))).otherwise(F.col("active")))


def _runs(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Runs of consecutive places: from and to (exclusive)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    return rows.withColumn("island", F.col(at) - rank).groupBy(*keys, "island").agg(F.min(at).alias("from"), (F.max(at) + 1).alias("to")).drop("island")


def _slots(frames: DataFrame) -> DataFrame:
    return frames.select(*(c for c in frames.columns if c != "active"), F.posexplode("active").alias("slot", "on")).filter("on = 1").drop("on")


def sample_ranges(frames: DataFrame, least: int = 10) -> DataFrame:
    """Samples over which a slot of a chunk speaks alone, if it does so in ``least`` frames or more. A run up to the
    chunk's end ends with its last frame's begin."""
    counts = frames.groupBy("rec", "chunk").agg((F.max("frame") + 1).alias("n"))
    alone = _slots(without_overlap(frames))
    enough = alone.groupBy("rec", "chunk", "slot").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least).drop("k")
    runs = _runs(alone, ["rec", "chunk", "slot"], "frame").join(enough, ["rec", "chunk", "slot"], "left_semi").join(counts, ["rec", "chunk"])
    sample = lambda f: (f / F.col("n") * CHUNK).cast("long") + F.col("chunk") * STEP
    end = F.when(F.col("to") < F.col("n"), F.col("to")).otherwise(F.col("n") - 1)
    return runs.select("rec", "chunk", "slot", sample(F.col("from")).alias("from_sample"), sample(end).alias("to_sample"))


def votes(frames: DataFrame, clusters: DataFrame) -> DataFrame:
    """clusters: rec, chunk, slot, cluster. How many chunks see a cluster in each frame of the grid; slots without a cluster
    are left out, and two slots of a chunk with one cluster vote once."""
    seen = _slots(on_grid(frames)).join(clusters, ["rec", "chunk", "slot"]).select("rec", "chunk", "at", "cluster").distinct()
    return seen.groupBy("rec", "at", "cluster").agg(F.count(F.lit(1)).alias("votes"))


def truncated(counted: DataFrame, samples: Column) -> DataFrame:
    """Without the frames of padding: if the last chunk isn't whole, frames end with the recording's samples."""
    part = (samples > CHUNK) & ((samples - CHUNK) % STEP > 0)
    return counted.filter(~part | (F.col("at") <= F.floor(samples / SHIFT)))


def top_clusters(counted: DataFrame, per_frame: DataFrame) -> DataFrame:
    """The clusters with most votes in each frame, as many as speakers there (ties: the smaller cluster)."""
    order = Window.partitionBy("rec", "at").orderBy(F.desc("votes"), "cluster")
    return counted.withColumn("rank", F.row_number().over(order)).join(per_frame, ["rec", "at"]).filter("rank <= speakers").select("rec", "at", "cluster")


def to_turns(labels: DataFrame, sizes: DataFrame, on_s: float = 0.3, off_s: float = 0.5) -> DataFrame:
    """labels: rec, at, cluster; sizes: rec, n (frames). Turns in seconds: runs of a cluster, merged over gaps of off_s or less;
    turns of on_s or less are left out."""
    runs = _runs(labels, ["rec", "cluster"], "at").join(sizes, "rec")
    end = F.when(F.col("to") < F.col("n"), F.col("to")).otherwise(F.col("n") - 1)
    second = lambda f: f * (SHIFT / RATE) + 0.5 * FIELD / RATE
    rows = runs.select("rec", "cluster", second(F.col("from")).alias("start"), second(end).alias("end"))
    order = Window.partitionBy("rec", "cluster").orderBy("start")
    gap = F.col("start") - F.lag("end").over(order)
    rows = rows.withColumn("new", F.when((gap > 0) & (gap <= off_s), 0).otherwise(1)).withColumn("turn", F.sum("new").over(order))
    merged = rows.groupBy("rec", "cluster", "turn").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.filter(F.col("end") - F.col("start") > on_s).drop("turn")


def sliding_chunks(recordings: DataFrame, chunk: int = CHUNK, step: int = STEP) -> DataFrame:
    """recordings: rec, samples. Begins of chunks of ``chunk`` samples each ``step``, and how many zeros fill the last one."""
    whole = F.floor(F.greatest(F.col("samples") - chunk, F.lit(0)) / step)
    more = F.when((F.col("samples") > chunk) & ((F.col("samples") - chunk) % step > 0), 1).otherwise(0)
    rows = recordings.filter("samples > 0").select("rec", "samples", F.explode(F.sequence(F.lit(0).cast("long"), whole + more)).alias("chunk"))
    begin = F.col("chunk") * step
    return rows.select("rec", "chunk", begin.alias("from_sample"), F.greatest(begin + chunk - F.col("samples"), F.lit(0)).alias("padding"))


def diarized(frames: DataFrame, vectors: DataFrame, samples: DataFrame, threshold: float = 0.9, count: int | None = None, least_s: float = 0.3, on_s: float = 0.3, off_s: float = 0.5) -> DataFrame:
    """Turns of recordings from end to end. frames: rec, chunk, frame, active; vectors: rec, chunk, slot, embedding, made by a
    model from the samples of sample_ranges; samples: rec, samples. rec, cluster, start, end in seconds.

    A recording of one chunk needs no clusters: its slots are the speakers. Otherwise the slots of all chunks are clustered
    by their vectors, and each frame has the clusters with most votes, as many as speakers are heard in it. Slots that speak
    alone for less than ``least_s`` or whose vector is null or holds nan have no cluster; recordings without any have no turns."""
    chunks = frames.groupBy("rec").agg(F.max("chunk").alias("last"), (F.max("frame") + 1).alias("n"))
    lone, more = chunks.filter("last = 0"), chunks.filter("last > 0")
    slots = _slots(frames.join(lone.select("rec"), "rec", "left_semi")).select("rec", F.col("frame").alias("at"), F.col("slot").alias("cluster"))
    rest = frames.join(more.select("rec"), "rec", "left_semi")
    ranges = sample_ranges(rest).join(samples, "rec")
    heard = ranges.groupBy("rec", "chunk", "slot").agg(F.sum(F.greatest(F.least("to_sample", "samples") - F.col("from_sample"), F.lit(0))).alias("k")).filter(F.col("k") >= least_s * RATE)
    good = vectors.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: F.isnan(x) | x.isNull())).join(heard, ["rec", "chunk", "slot"], "left_semi")
    numbered = good.withColumn("vec_id", F.col("chunk").cast("long") * 16 + F.col("slot"))
    labels = clusters.clustering(numbered, "rec", threshold, count)
    pairs = labels.select("rec", F.floor(F.col("vec_id") / 16).alias("chunk"), (F.col("vec_id") % 16).alias("slot"), "cluster")
    counted = votes(rest, pairs).join(samples, "rec")
    top = top_clusters(truncated(counted, F.col("samples")), speakers_per_frame(rest))
    grid = more.select("rec", (F.floor((CHUNK + F.col("last") * STEP) / SHIFT) + 1).alias("n")).join(samples, "rec")
    part = (F.col("samples") > CHUNK) & ((F.col("samples") - CHUNK) % STEP > 0)
    sizes = grid.select("rec", F.when(part, F.least("n", F.floor(F.col("samples") / SHIFT) + 1)).otherwise(F.col("n")).alias("n"))
    return to_turns(slots.unionByName(top), lone.select("rec", "n").unionByName(sizes), on_s, off_s)


def powerset_slots(classes: Column) -> Column:
    """Active slots of a class of none, one or two of three speakers."""
    # Slots by class.
    table = ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1))
    return F.get(F.array(*(F.array(*map(F.lit, t)) for t in table)), classes)


def block_rms(samples: Column, block: int) -> Column:
    """Mean and population deviation of the root mean square of whole blocks of samples."""
    n = F.floor(F.size(samples) / block).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rms = F.transform(starts, lambda i: F.sqrt(F.aggregate(F.slice(samples, i * block + 1, F.lit(block)), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / block))
    mean = F.aggregate(rms, F.lit(0.0), lambda s, x: s + x) / F.nullif(n, F.lit(0))
    spread = F.sqrt(F.aggregate(rms, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.nullif(n, F.lit(0)))
    return F.struct(mean.alias("mean"), spread.alias("deviation"))
