"""What queries hold and move: rows that joins make, broadcasts, and the memory and time of large keys."""

import hashlib
import random
import time
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from chronolake.functions import blocks
from chronolake.functions import text as T
from chronolake.operators import clusters, jobs
from chronolake.plans import reports, review
from chronolake.streaming import alerts, life, queues, uploads
from chronolake.streaming.ordered import in_order


def join_rows(df):
    """Rows that each join of df has put out."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        else:
            if "Join" in name:
                found.append(p.metrics().apply("numOutputRows").value())
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_answered_meanwhile_makes_no_pairs(spark):
    rng = random.Random(3)
    tasks = [(i, f"h{i % 5}", rng.choice([None, rng.randrange(90)]), rng.randrange(90, 150)) for i in range(400)]
    cache = [(i, f"h{i % 4}", rng.choice([None, rng.randrange(20 * (i % 4), 200)])) for i in range(300)]
    want = {}
    for task, h, queued, start in tasks:
        own = [(at, i) for i, g, at in cache if g == h and at is not None and queued is not None]
        between = [x for x in own if queued < x[0] <= start]
        want[task] = None if any(at <= queued for at, _ in own) or not between else min(between)[1]
    got = jobs.answered_meanwhile(spark.createDataFrame(tasks, "task_id int, file_hash string, queued_min int, start_min int"), spark.createDataFrame(cache, "id int, file_hash string, created_min int"))
    assert {r.task_id: r.hit for r in got.collect()} == want
    assert len({v for v in want.values() if v is not None}) > 1 and join_rows(got) == [len(tasks)]


def test_characters_are_not_broadcast(spark, tmp_path):
    rows = [(c, t, "user", "ab c" * (20 + t)) for c in range(40) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    for df in (reports.char_alignment(spark, str(tmp_path)), review.positional_zip(spark, str(tmp_path))):
        assert df.count() > 0
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_shares_are_rounded_as_doubles(spark):
    # 57 / 800 is 0.07125, whose product by 10,000 is a little below the half
    got = jobs.cluster_shares(spark.createDataFrame([(1, 0, "A", 0, 570), (1, 1, "B", 0, 7430), (2, 0, "A", 0, 0)], "conv_id int, pos int, speaker string, start_ms long, end_ms long"))
    assert {r.conv_id: (r.seconds, r.shares) for r in got.collect()} == {1: ([7.43, 0.57], [0.9288, 0.0712]), 2: ([0.0], [0.0])}


def test_short_turns_are_refined_too(spark, tmp_path):
    rows = [(c, t, "user", "short") for c in range(4, 8) for t in range(6)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.pos): r.speaker for r in review.refine_or_keep(spark, str(tmp_path)).collect()}
    want = {(c, t): "B" if c % 5 and c % 3 == 0 and t % 2 == 0 else "A" if t % 4 < 2 else "B" for c, t, _, _ in rows}
    assert got == want
    assert {r.conv_id: r.reasons for r in review.refinement_reasons(spark, str(tmp_path)).collect()} == {4: "many_short_segments", 5: "empty", 6: "many_short_segments", 7: "many_short_segments"}


def test_rows_in_order_by_parts():
    rng = random.Random(9)
    rows = [(i, rng.choice([None, 1.0, 2.0]), rng.choice(["x", None]), b"d") for i in (rng.randrange(40) for _ in range(500))]
    frames = [pd.DataFrame(rows[k : k + 30], columns=["at", "seq", "kind", "data"]) for k in range(0, 500, 30)]
    plain = [tuple(r) for r in in_order(iter(frames), ["at", "seq"])]
    parts = [tuple(r) for r in in_order(iter(frames), ["at", "seq"], held=60)]
    clean = lambda l: [tuple(None if v != v else v for v in r) for r in l]
    assert clean(parts) == clean(plain) == sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0))
    assert list(in_order(iter([]), ["at"])) == []


class Stored:
    """State of one key in memory that counts its calls."""

    calls, value = 0, None

    def __init__(self):
        self.data = {}

    def __getattr__(self, name):
        def call(*a):
            Stored.calls += 1
            if name == "iterator":
                return iter(list(self.data.items()))
            if name == "containsKey":
                return a[0] in self.data
            if name == "getValue":
                return self.data[a[0]]
            if name == "updateValue":
                self.data[a[0]] = a[1]
            elif name == "removeKey":
                self.data.pop(a[0], None)
            elif name == "exists":
                return self.value is not None
            elif name == "update":
                self.value = a[0]
            elif name == "clear":
                self.value = None
            return self.value if name == "get" else []

        return call


class Handle:
    getMapState = getValueState = lambda self, *a: Stored()

    def __getattr__(self, name):
        return lambda *a: []


def test_task_life_touches_state_little():
    """What a batch costs in state is bounded by what is left at its end, not by its events."""
    steps = [(0, "create"), (5, "start"), (30, "done")]
    rows = [(pd.Timestamp(1_700_000_000 + k + s, unit="s"), k * 10 + n, k, kind, None) for k in range(30_000) for n, (s, kind) in enumerate(steps)]
    frame = pd.DataFrame(rows, columns=["at", "seq", "task", "kind", "error"])
    own = life.TaskLife(life.Limits(kept=1_000_000, remembered=1000))
    own.init(Handle())
    Stored.calls = 0
    out = pd.concat(own.handleInputRows((0,), iter([frame]), None))
    assert (out.status == "evicted").sum() > 20_000 and Stored.calls < 6000


def test_alerts_are_handed_on_in_parts():
    rows = [(1, pd.Timestamp(1_700_000_000 + i, unit="s"), i, "probe", i % 2 == 0, "healthy", False, None, None, None, None, None) for i in range(30_000)]
    frame = pd.DataFrame(rows, columns=[f.split()[0] for f in alerts.ROW.split(", ")])
    own = alerts.AlertLoop(alerts.Thresholds(cooldown_s=0.0))
    own.init(Handle())
    found = list(own.handleInputRows((1,), iter([frame]), None))
    assert len(found) > 1 and sum(map(len, found)) == 15_000


def test_queues_share_calls():
    """A call takes a shard of queues, and hands their events on together."""
    rows = [(i % 700, i, "submit", None, False) for i in range(2100)]
    own = queues.Admission(2, 2)
    own.init(Handle())
    found = list(own.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["queue", "event", "kind", "seconds", "refused"])]), None))
    assert len(found) == 1 and found[0].queue.nunique() == 700 and found[0].admitted.sum() == 1400


def test_uploads_of_one_batch_touch_state_little():
    """Chunks that come and go in one batch never reach the state."""
    names = [f.split()[0] for f in uploads.MESSAGE.split(", ")]
    data, rows = b"x" * 10, []
    for u in range(300):
        sent = [("open", None, 10, 10, 100, hashlib.md5(data * 10).hexdigest(), None, None), *(("chunk", i, None, None, None, None, data, None) for i in range(10)), ("queue", None, None, None, None, None, None, False)]
        rows += [(1, pd.Timestamp(1_700_000_000 + u, unit="s"), u * 100 + n, kind, u, *rest) for n, (kind, *rest) in enumerate(sent)]
    own = uploads.Sessions(1800, 1000, 86_400)
    own.init(Handle())
    Stored.calls = 0
    out = pd.concat(own.handleInputRows((1,), iter([pd.DataFrame(rows, columns=names)]), None))
    assert (out.answer == "upload_complete").sum() == 300 and (out.answer == "received").sum() == 3000 and Stored.calls < 1000


def test_linkage_in_memory_linear_in_the_vectors(monkeypatch):
    """Rounds of mutual nearest clusters make the merges of one square of distances, in blocks; copies are merged ahead."""
    rng = np.random.default_rng(8)
    for t in range(60):
        n = int(rng.integers(1, 40))
        x = rng.normal(size=(n, 4)) if t % 2 else rng.normal(size=(8, 4))[rng.integers(0, 8, n)]
        k = int(rng.integers(1, len(np.unique(x, axis=0)) + 1))
        cases = [{"threshold": 0.2}, {"threshold": 0.9}, {"threshold": 1.6}, {"count": k}]
        monkeypatch.setattr(clusters, "SQUARE", 2048, raising=False)
        want = [clusters.complete_linkage(x, **c).tolist() for c in cases]
        monkeypatch.setattr(clusters, "SQUARE", 3, raising=False)
        monkeypatch.setattr(clusters, "BLOCK", int(rng.integers(1, 300)), raising=False)
        assert [clusters.complete_linkage(x, **c).tolist() for c in cases] == want
    monkeypatch.undo()
    x = rng.normal(size=(500, 16))[rng.integers(0, 500, 5000)] + rng.normal(size=(5000, 16)) * 0.05
    tracemalloc.start()
    labels = clusters.complete_linkage(x, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and 3 < labels.max() < 500  # a square of 5,000 has 200 MB


def test_blocks_of_a_batch_take_little_memory(spark, monkeypatch):
    df = spark.createDataFrame([("a", "b"), (None, "x"), ("", None), ("abcd", "abxd")], "a string, b string").coalesce(1)
    got = df.select(blocks.blocks("a", "b").alias("m")).collect()
    assert [[tuple(m) for m in r.m] for r in got] == [[], [], [], [(0, 0, 2), (3, 3, 1)]]
    assert [r.m for r in df.limit(1).select(blocks.blocks("a", "b").alias("m")).collect()] == [[]] and not df.limit(0).select(blocks.blocks("a", "b")).collect()
    monkeypatch.setattr(blocks, "matching", lambda a, b: [(7 * k, 6 * k, 6) for k in range(80)])
    texts = pa.array(["x" * 500] * 10_000)
    tracemalloc.start()
    assert len(blocks.blocks.func(texts, texts)) == 10_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # a dictionary for each block has 180 MB


def test_repetition_is_linear_in_the_text(spark):
    """A text that has almost a repetition at each place took 77 steps a character; one without a unit ends as fast."""
    rng = random.Random(9)
    words = ["".join(rng.choice("ab") for _ in range(k)) for k in range(2, 13)]
    texts = [w * n + rng.choice(["", "c", " \x1c"]) + w for w in words for n in (4, 5, 6, 7)] + ["", None, "x", "\U0001f600b" * 6, "ab" * 3 + " \n" + "ab" * 3]

    def first(text):
        text = "".join((text or "").split())
        return next((text[i : i + k] for k in range(2, 13) for i in range(len(text) - 6 * k + 1) if text[i : i + 6 * k] == text[i : i + k] * 6), None)

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r.i: r.u for r in df.select("i", T.first_repetition(F.col("t")).alias("u")).collect()} == {i: first(t) for i, t in enumerate(texts)}
    long = "".join(rng.choice("ab") * rng.randint(1, 5) + rng.choice("cd") for _ in range(1_000_000))
    began = time.process_time()
    assert T._first_unit(long + "xyz" * 6, range(3, 4), 6) == "xyz" and T._first_unit("ab" * 5 + "c", range(2, 13), 6) is None
    assert T._first_unit("".join(map(chr, range(0x4E00, 0x9000))) * 100, range(2, 13), 6) is None
    assert time.process_time() - began < 10
