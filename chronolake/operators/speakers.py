"""Speakers: shares, labels, profiles; embeddings: centroids and their similarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(segments: DataFrame, key: str = "conv_id", main: float = 0.03) -> DataFrame:
    """Duration and share of each speaker, and whether the share makes it a main one. A total of 0 counts as 1."""
    own = segments.groupBy(key, "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    total = F.sum("duration_ms").over(Window.partitionBy(key))
    own = own.withColumn("share", F.col("duration_ms") / F.when(total == 0, F.lit(1)).otherwise(total))
    return own.withColumn("is_main", F.col("share") >= main)


def relabel_by_duration(segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """New ids of speakers from 0 by duration, longest first (ties: the smaller label)."""
    own = segments.groupBy(key, "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    return own.withColumn("new_id", (F.row_number().over(Window.partitionBy(key).orderBy(F.desc("duration_ms"), "speaker")) - 1).cast("long"))


def profile(segments: DataFrame) -> DataFrame:
    return segments.groupBy("speaker").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.sum(F.length("text")).alias("chars"))


def length_histogram(segments: DataFrame) -> DataFrame:
    """Segments by length in five buckets."""
    span = F.col("end_ms") - F.col("start_ms")
    bucket = F.when(span < 1000, "a_under_1s").when(span < 3000, "b_1_3s").when(span < 10000, "c_3_10s").when(span < 30000, "d_10_30s").otherwise("e_30s_up")
    return segments.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max(span).alias("longest_ms"))


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """Element n // 2 of each key's sorted values, not interpolated."""
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("v"))
    return rows.select(key, F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("median"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; -1 if a vector is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull() | (norm == 0), F.lit(-1.0)).otherwise(dot(a, b) / norm)


def centroids(vectors: DataFrame, label: str = "label", duration: str = "duration_ms", top: int = 30) -> DataFrame:
    """Mean of the vectors of each label's ``top`` longest rows (ties: the smaller vec_id), scaled to length 1."""
    order = Window.partitionBy(label).orderBy(F.desc(duration), "vec_id")
    best = vectors.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    means = best.select(label, F.posexplode("embedding").alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    rows = rows.select(label, F.transform("v", lambda s: s["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("norm", norm).select(label, F.when(F.col("norm") > 1e-12, F.transform("v", lambda x: x / F.col("norm"))).otherwise(F.col("v")).alias("centroid"))
