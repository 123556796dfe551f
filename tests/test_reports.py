"""Readers of logs, labels by segment, fan-out and roll-ups: literal cases and plain Python."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from chronolake.functions import parse
from chronolake.operators import clusters, evaluation, sequence, service
from chronolake.operators import records as record_operators
from chronolake.plans import records, reports, review

D = "/root/testdata/sf0.001"


def test_paired_silences(spark):
    log = "silence_end: 1 | d\nsilence_start: 2\nsilence_start: 3.5\nsilence_end: 4 \nsilence_end: 5.25 | d\nsilence_end: 6 | d\nsilence_start: bad\nsilence_end: 8 | d\nsilence_start: -0.5\nsilence_end: 0.25|"
    df = spark.createDataFrame([(1, log), (2, ""), (3, None), (4, "silence_start: 7"), (5, "silence_start: 1e-05\nsilence_end: nan\nsilence_end: 2")], "k int, log string")
    got = lambda **a: sorted((r.k, r.start_ms, r.end_ms) for r in parse.paired_silences(df, ["k"], **a).collect())
    # A line with a bar only closes in strict mode; one that can't be read opens nothing there.
    assert got(strict=True) == [(1, -500, 250), (1, 3500, 5250)]
    # Otherwise the end without a bar closes, and an end that can't be read ("0.25|", "nan") uses its start up.
    assert got() == [(1, 3500, 4000)]


def test_window_silences(spark):
    log = "silence_start: 0.5\nsilence_end: 1\nsilence_start: 2\nsilence_end: 2.499"
    df = spark.createDataFrame([(1, 10_000, 13_000, log), (1, 20_000, 20_999, log)], "k int, from_ms long, to_ms long, log string")
    assert [(r.from_ms, r.start_ms, r.end_ms) for r in parse.window_silences(df, ["k"]).collect()] == [(10_000, 10_500, 11_000)]


def test_sensors(spark):
    log = "GPU HW active residency:  12.5% (x)\nANE Power: 30 mW\nANE Power: 50mW\nCPU Power: 7%\nGPU Power: 1.2.3 mW\nGPU HW active residency: 9 mW\nOther Power: 4 mW"
    df = spark.createDataFrame([(1, log), (2, ""), (3, None)], "k int, log string")
    assert sorted((r.k, r.name, r["mean"], r.peak, r.n) for r in parse.sensors(df, "k").collect()) == [(1, "ANE Power", 40.0, 50.0, 2), (1, "GPU HW active residency", 12.5, 12.5, 1)]


def test_segment_labels_equal_python(spark):
    rng = random.Random(5)
    rows = [(rec, seg, f"s{seg % (2 + rec)}", rng.choice("XYZ"[: 1 + seg % 3])) for rec in range(3) for seg in range(40) for _ in range(rng.randrange(1, 25))]
    chars = spark.createDataFrame(rows, "rec int, segment int, own string, true string")
    mapping = clusters.label_mapping(evaluation.confusion(chars))
    to = {(r.rec, r.own): r.mapped for r in mapping.collect()}
    counts, own = defaultdict(Counter), {}
    for rec, seg, o, t in rows:
        counts[rec, seg][t] += 1
        own[rec, seg] = o
    want = {}
    for k, c in counts.items():
        label, n = min(c.items(), key=lambda x: (-x[1], x[0]))
        want[k] = (sum(c.values()), label, label == to.get((k[0], own[k])), n / sum(c.values()) < 0.9)
    labels = evaluation.segment_majority(chars, mapping)
    assert {(r.rec, r.segment): (r.matched, r.majority, r.right, r.mixed) for r in labels.collect()} == want
    worst = {rec: [s for _, s in sorted((-v[0], s) for (r, s), v in want.items() if r == rec and not v[2])[:12]] for rec in range(3)}
    got = defaultdict(list)
    for r in evaluation.worst_segments(labels).orderBy("rec", "rank").collect():
        got[r.rec].append(r.segment)
    assert dict(got) == {k: v for k, v in worst.items() if v}
    for r in evaluation.segment_report(labels).collect():
        mine = [v for k, v in want.items() if k[0] == r.rec]
        assert (r.considered, r.ok, r.wrong, r.mixed) == (len(mine), sum(v[2] for v in mine), sum(not v[2] for v in mine), sum(v[3] for v in mine))
        assert r.accuracy == r.ok / r.considered


def test_check_report(spark):
    rows = [(1, "warning", "b", 1), (1, "warning", "a", 2), (1, "warning", "b", 3), (1, "ok", "c", 4), (2, "ok", "a", 1), (3, "warning", "a", 1), (3, "error", "z", 2), (3, "error", "y", 3)]
    got = {r.k: (r.status, r.warnings, r.errors) for r in evaluation.check_report(spark.createDataFrame(rows, "k int, severity string, name string, at int"), "k").collect()}
    assert got == {1: ("warning", ["b", "a"], []), 2: ("ok", [], []), 3: ("error", ["a"], ["z", "y"])}


def test_remap_and_notices(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, None)], "k int, pos int, speaker string")
    to = spark.createDataFrame([(1, "a", "x", "spare")], "k int, speaker string, to string, extra string")
    both = [sorted((r.k, r.pos, r.speaker) for r in clusters.remap(rows, to, ["k"], inner).collect()) for inner in (False, True)]
    assert both == [[(1, 0, "x"), (1, 1, "b"), (2, 0, "a"), (2, 1, None)], [(1, 0, "x")]]
    tasks = spark.createDataFrame([(1, "completed"), (2, "failed"), (3, "processing"), (4, "failed")], "task_id int, status string")
    follows = spark.createDataFrame([("c", 1), ("c", 1), ("d", 1), ("d", 2), ("d", 3), ("e", 9)], "connection string, task_id int")
    got = sorted((r.connection, r.task_id, r.type) for r in service.notices(tasks, follows).collect())
    assert got == [("c", 1, "task_complete"), ("d", 1, "task_complete"), ("d", 2, "task_error"), ("d", 3, "task_progress")]


def test_system_load_and_offsets(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 5.0), ("a", [], 7.0), ("b", [4.0], None)], "k string, cores array<double>, memory double")
    got = {r.k: (r.load_mean, r.load_peak, r.memory_mean, r.memory_peak, r.samples) for r in evaluation.system_load(df, "k").collect()}
    assert got == {"a": (1.5, 3.0, 6.0, 7.0, 2), "b": (4.0, 4.0, None, None, 1)}
    rows = spark.createDataFrame([(1, 0, "ab", 0, 20), (1, 1, "", 20, 20), (1, 2, "c", 30, 45)], "conv_id int, pos int, text string, start_ms long, end_ms long")
    chars = spark.createDataFrame([(1, 1, 1, 9), (1, 2, 10, 18), (1, 3, 33, 41)], "conv_id int, n int, start_ms long, end_ms long")
    assert sorted((r.pos, r.start_off, r.end_off) for r in evaluation.char_offsets(rows, chars).collect()) == [(0, 1, 2), (2, 3, 4)]


def test_merges_stay_within_recordings(spark):
    """Each recording's merge is that of its own labels, and shares after it add up."""
    rows = review._shares(spark, D).withColumn("label", F.col("label").cast("string"))
    held = defaultdict(list)
    for r in rows.orderBy("rec", "label").collect():
        held[r.rec].append((r.label, float(r.duration), np.array(r.centroid)))
    got = defaultdict(dict)
    for r in review.centroid_merge(spark, D).collect():
        got[r.rec][r.label] = r.merged
    assert len(held) > 1 and dict(got) == {k: clusters.merge_labels(v) for k, v in held.items()}
    merged = clusters.merged_clusters(rows.select("rec", "label", "duration", "centroid")).withColumnRenamed("merged", "to")
    for r in clusters.regrouped(rows.select("rec", "label", "duration"), merged).collect():
        mine = [d for n, d, _ in held[r.rec] if got[r.rec][n] == r.label]
        assert np.isclose(r.duration, sum(mine)) and np.isclose(r.share, sum(mine) / sum(d for _, d, _ in held[r.rec]))


def test_reports_use_all_rows(spark):
    n = spark.read.parquet(f"{D}/conversations.parquet").count()
    assert reports.json_turns(spark, D).count() == reports.speaker_remap(spark, D).count() == reports.transcript_paragraphs(spark, D).count() == n
    assert reports.probe_durations(spark, D).count() == spark.read.parquet(f"{D}/events.parquet").count()


def test_peaks_and_kept_points(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("a", 3, 7.0), ("a", 4, 7.0), ("b", 1, None)], "k string, at int, v double")
    assert {r.k: (r["mean"], r.peak, r["at"]) for r in evaluation.peaks(df, "k", "at", "v").collect()} == {"a": (19 / 3, 7.0, 3), "b": (None, None, None)}
    rng = random.Random(8)
    points = [(k, rng.randrange(5_000)) for k in range(3) for _ in range(400)]
    want = set()
    for k in range(3):
        last = None
        for p in sorted(p for c, p in points if c == k):
            if last is None or p - last > 10:
                last = p
                want.add((k, p))
    got = [(r.k, r.p) for r in sequence.last_kept(spark.createDataFrame([*points, (0, None)], "k int, p long"), "k", "p", 10).collect()]
    assert set(got) == want and len(got) == len(want)
    # One key with many points is one pass.
    many = spark.range(200_000).select((F.col("id") * 0).alias("k"), F.col("id").alias("p"))
    assert sequence.last_kept(many, "k", "p", 1).count() == 100_000


def test_vectors_without_label_stay(spark, tmp_path):
    rows = [(i, [float(i % 3), 1.0], None if i % 2 else i % 4) for i in range(12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert review.linkage(spark, str(tmp_path)).count() == 12
    assert records.embedding_jumps(spark, str(tmp_path)).filter("label is null").count() == 5


def test_spoken_srt(spark):
    df = spark.createDataFrame([(1, 0, 0, " hi ", 0.0, 1.0625), (1, 1, 1, " ", 2.0, 3.0), (1, 2, 1, "yo", 3661.9996, 3662.5)], "conv_id int, pos int, speaker int, text string, start_s double, end_s double")
    want = "1\n00:00:00,000 --> 00:00:01,062\nSpeaker1: hi\n\n3\n01:01:01,1000 --> 01:01:02,500\nSpeaker2: yo\n"
    assert [r.srt for r in record_operators.spoken_srt(df).collect()] == [want]
