"""Streams with state against plain Python, whatever the places where they are stopped and started again."""

import datetime
import hashlib
import json
import random
from types import SimpleNamespace

import pytest

from chronolake.operators import sequence, service
from chronolake.streaming import alerts, directory, life, messages, queues, runs, uploads
from pyspark.sql import functions as F

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def rows_of(schema, rows):
    """Dictionaries as rows of a schema; what they lack is null."""
    names = [f.split()[0] for f in schema.split(", ")]
    return [tuple(r.get(n) for n in names) for r in rows]


def streamed(spark, schema, rows, build, n):
    df = spark.createDataFrame(rows_of(schema, rows), schema).withColumn("s", F.unix_timestamp("at"))
    return runs.replay(spark, df.repartition(3), "s", lambda x: build(x.drop("s")), n).collect()


def md5(b):
    return hashlib.md5(b).hexdigest()


def brute_uploads(rows, idle, most):
    out, pools = [], {}
    for m in sorted(rows, key=lambda m: (m["at"], m["seq"])):
        now = (m["at"] - T0).total_seconds()
        open_, done = pools.setdefault(m["pool"], ({}, set()))
        for u in [u for u, s in open_.items() if s["phase"] != "finalizing" and now - s["last"] > idle]:
            out.append((u, open_[u]["last"] + idle, "expired", None, None))
            del open_[u]
        if m["kind"] == "ping":
            continue
        u, kind = m["upload"], m["kind"]
        s = open_.get(u)

        def say(text, size=None, hash_=None):
            out.append((u, now, text, size, hash_))

        def finalize():
            s["last"] = now
            if s["phase"] == "uploading":
                whole = b"".join(s["chunks"][i] for i in sorted(s["chunks"]))
                if len(s["chunks"]) < s["total"] or md5(whole) != s["md5"]:
                    del open_[u]
                    return say("file_hash_mismatch")
                s["size"] = len(whole)
            s["phase"] = "finalizing"
            say("finalizing")

        if kind == "open":
            if s:
                say("session_exists")
            elif len(open_) >= most:
                say("too_many_sessions")
            elif not m["total"]:
                say("chunked_upload_error")
            else:
                open_[u] = {"total": m["total"], "bytes": m["chunk_bytes"], "md5": m["md5"], "chunks": {}, "last": now, "phase": "uploading"}
                say("upload_ready")
        elif s is None:
            say("status" if kind == "finalize" and u in done else "session_not_found")
        elif kind == "finalize":
            finalize()
        elif kind == "queue":
            if s["phase"] != "finalizing":
                say("message_error")
            elif m["full"]:
                s["phase"], s["last"] = "ready", now
                say("queue_full")
            else:
                done.add(u)
                del open_[u]
                say("upload_complete", s["size"], s["md5"])
        else:
            i, data = m["idx"], m["data"]
            if i is None:
                say("missing_chunk_data")
            elif not 0 <= i < s["total"]:
                say("upload_error")
            elif not data:
                say("missing_chunk_data")
            elif len(data) > s["bytes"] or (i < s["total"] - 1 and len(data) < s["bytes"]):
                say("upload_error")
            elif s["phase"] != "uploading" or i in s["chunks"]:
                s["last"] = now
                say("duplicate")
            elif m["md5"] and md5(data) != m["md5"]:
                say("chunk_hash_mismatch")
            else:
                s["chunks"][i], s["last"] = data, now
                say("received")
                if len(s["chunks"]) == s["total"]:
                    finalize()
    return sorted(out, key=str)


def upload_case(seed=7):
    rng, rows = random.Random(seed), []

    def add(second, **m):
        rows.append({"at": at(second), "seq": len(rows)} | m)

    second = 0
    names = list(range(40))
    texts = {u: bytes(rng.choice(b"abc") for _ in range(rng.choice([1, 4, 5, 8, 11]))) for u in names}
    for _ in range(1800):
        second += rng.choice([0, 1, 1, 2, 30])
        u = rng.choice(names[len(rows) // 55 : len(rows) // 55 + 7])
        pool, total = u % 3, -(-len(texts[u]) // 4)
        kind = rng.choices(["open", "chunk", "finalize", "queue"], [4, 20, 1, 2])[0]
        own = {"pool": pool, "upload": u, "kind": kind}
        if kind == "open":
            own |= {"total": total if u % 9 else 0, "chunk_bytes": 4, "size": len(texts[u]), "md5": md5(texts[u]) if u % 5 else "wrong"}
        elif kind == "chunk":
            i = rng.choice([*range(total)] * 6 + [total, -1, None])
            data = texts[u][4 * i : 4 * i + 4] if i is not None and 0 <= i < total else b"ab"
            own |= {"idx": i, "data": rng.choice([data] * 9 + [None, data[:-1], data + b"abcde"]), "md5": rng.choice([None, "good", "good", "bad"])}
            if own["md5"] == "good":
                own["md5"] = md5(own["data"] or b"")
        elif kind == "queue":
            own["full"] = rng.random() < 0.4
        add(second, **own)
    for pool in range(3):
        add(second + 10_000, pool=pool, kind="ping")
    return rows


@pytest.mark.parametrize("n", [1, 4])
def test_uploads(spark, n):
    rows = upload_case()
    got = streamed(spark, uploads.MESSAGE, rows, lambda x: uploads.upload_sessions(x, 100, 2), n)
    want = brute_uploads(rows, 100, 2)
    assert sorted(((r.upload, (r.at - T0).total_seconds(), r.answer, r.size, r.md5) for r in got), key=str) == want
    kinds = {w[2] for w in want}
    assert kinds >= {"expired", "too_many_sessions", "upload_complete", "queue_full", "status", "file_hash_mismatch", "duplicate", "chunk_hash_mismatch", "upload_error", "missing_chunk_data", "chunked_upload_error", "message_error", "session_exists"}


def test_uploads_forget(spark):
    """Submitted uploads are known for the time given, and then leave the state."""
    rows = [{"kind": "open", "total": 1, "chunk_bytes": 4, "md5": md5(b"ab")}, {"kind": "chunk", "idx": 0, "data": b"ab"}, {"kind": "queue", "full": False}, {"kind": "finalize"}, {"kind": "ping"}, {"kind": "finalize"}]
    for k, (r, s) in enumerate(zip(rows, [0, 1, 2, 60, 5000, 5001])):
        r |= {"pool": 1, "upload": 4, "at": at(s), "seq": k}
    got = streamed(spark, uploads.MESSAGE, rows, lambda x: uploads.upload_sessions(x, 100, 5, 200), 3)
    assert [r.answer for r in sorted(got, key=lambda r: (r.at, r.seq))] == ["upload_ready", "finalizing", "received", "upload_complete", "status", "session_not_found"] or [r.answer for r in sorted(got, key=lambda r: (r.at, r.seq, r.answer != "received"))] == ["upload_ready", "received", "finalizing", "upload_complete", "status", "session_not_found"]


def test_shared_folder(spark):
    """On a cluster a folder that all share must be named."""
    conf = {"spark.checkpoint.dir": None}
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k)), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError):
        runs.shared_folder(cluster)
    conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert runs.shared_folder(cluster).startswith("hdfs://x/y/streams/")


def test_admission(spark):
    """Equal to the batch operators over the same events."""
    rng = random.Random(3)
    rows = [(rng.randrange(5), k, rng.choice(["submit", "submit", "finish"]), rng.choice([None, -1.0, 0.0, 3.0, 12.5, 100.0]), False) for k in range(600)]
    events = spark.createDataFrame(rows, "queue long, event long, kind string, seconds double, refused boolean")
    got = runs.replay(spark, events, "event", lambda x: queues.admissions(x, 3, 2), 4).collect()
    batch = {r.event: (r.depth, r.admitted) for r in service.admitted(events, 3, "queue", "event").collect()}
    assert {r.event: (r.depth, r.admitted) for r in got} == batch
    emas = {r.queue: r.ema for r in sequence.ema(events.filter("kind = 'finish'"), "queue", "event", "seconds").collect()}
    last = {r.queue: r.ema for r in sorted(got, key=lambda r: r.event)}
    assert last == pytest.approx(emas)
    for r in got:
        submit = rows[r.event][2] == "submit"
        assert (r.retry_after is None) == r.admitted and (r.wait is None) == (not submit or not r.admitted)
        assert r.retry_after is None or r.retry_after >= 1


def test_admission_rollback(spark):
    """A queue that refuses a task gives its place back; times are those of the state at the event."""
    rows = [(1, 0, "submit", None, False), (1, 1, "submit", None, True), (1, 2, "submit", None, False), (1, 3, "submit", None, False), (1, 4, "finish", 10.0, None), (1, 5, "submit", None, None), (None, 6, "submit", None, None)]
    events = spark.createDataFrame(rows, "queue long, event long, kind string, seconds double, refused boolean")
    got = sorted(map(tuple, runs.replay(spark, events, "event", lambda x: queues.admissions(x, 2, 4), 2).collect()))
    assert [r[2:6] for r in got] == [(1, True, None, 0), (1, False, 22, None), (2, True, None, 22), (2, False, 22, None), (1, True, None, None), (2, True, None, 2)]


MESSAGES = {
    '{"type": "ping"}': ("ping", None),
    '{"type": "ping", "data": null}': ("ping", None),
    '{"type": "task_status", "data": {"task_id": "a"}}': ("task_status", None),
    '{"type": "task_status", "data": {"task_id": ""}}': ("dead", "missing_task_id"),
    '{"type": "task_status"}': ("dead", "missing_task_id"),
    '{"type": "cancel_task", "data": [1]}': ("dead", "message_error"),
    '{"type": "cancel_task", "data": {"task_id": null}}': ("dead", "missing_task_id"),
    '{"type": "finalize_upload", "data": {"terms": ["x"], "task_id": "a"}}': ("dead", "protocol_error"),
    '{"type": "finalize_upload", "data": {"task_id": "a"}}': ("finalize_upload", None),
    '{"type": "upload_chunk", "data": {"task_id": "a", "chunk_index": 0, "chunk_data": "eA=="}}': ("upload_chunk", None),
    '{"type": "upload_chunk", "data": {"task_id": "a", "chunk_data": "eA=="}}': ("dead", "missing_chunk_data"),
    '{"type": "upload_data", "data": {"task_id": "a", "file_data": "eA=="}}': ("upload_data", None),
    '{"type": "task_status_batch", "data": {"task_ids": ["a", "b"]}}': ("task_status_batch", None),
    '{"type": "task_status_batch", "data": {"task_ids": []}}': ("dead", "missing_task_ids"),
    '{"type": "task_status_batch", "data": {"task_ids": "a"}}': ("dead", "missing_task_ids"),
    '{"type": "upload_request", "data": {"file_name": "a.wav", "file_size": 3, "file_hash": "x"}}': ("upload_request", None),
    '{"type": "upload_request", "data": {"file_name": "a.wav", "file_size": 3, "file_hash": "x", "output_format": "pdf"}}': ("dead", "invalid_format"),
    '{"type": "upload_request", "data": {"file_name": "a.wav"}}': ("dead", "upload_error"),
    '{"type": "other", "data": 3}': ("dead", "unknown_message_type"),
    '{"data": {}}': ("dead", "unknown_message_type"),
    '{"type": "ping"': ("dead", "invalid_json"),
    "": ("dead", "invalid_json"),
    "[1, 2]": ("dead", "message_error"),
    "5": ("dead", "message_error"),
    "null": ("dead", "message_error"),
}


def test_messages(spark, tmp_path):
    cases = [*MESSAGES.items(), (None, ("dead", "invalid_json"))]
    raw = spark.createDataFrame([(k, body) for k, (body, _) in enumerate(cases)], "id long, body string")
    assert {r.id: (r.route, r.error) for r in messages.routed(raw).collect()} == {k: v for k, (_, v) in enumerate(cases)}
    tables = messages.dispatched(spark, raw, n=2)
    found = {name: sorted(r.id for r in t.collect()) for name, t in tables.items()}
    assert found == {name: [k for k, (_, v) in enumerate(cases) if v[0] == name] for name in (*messages.TYPES, "dead")}
    assert {r.error for r in tables["dead"].collect() if r.body is None} == {"invalid_json"}
    chunk = tables["upload_chunk"].first()
    assert (chunk.task_id, chunk.chunk_index, chunk.chunk_data, chunk.chunk_hash) == ("a", 0, "eA==", None)
    # a batch that is run again replaces its rows
    write = messages.writer(f"file://{tmp_path}")
    for _ in range(2):
        write(messages.routed(raw), 3)
        write(messages.routed(raw.limit(2)), 4)
    assert spark.read.parquet(f"{tmp_path}/ping").count() == 4 and spark.read.parquet(f"{tmp_path}/dead").count() == found["dead"].__len__()


def brute_life(rows, limits):
    """Every maintenance, one after another."""
    out, shards = [], {}
    end = max((r["at"] - T0).total_seconds() for r in rows)
    for shard in {r["shard"] for r in rows}:
        tasks, gone = {}, []
        events = sorted((r for r in rows if r["shard"] == shard), key=lambda r: (r["at"], r["seq"]))
        tick = 0

        def maintain(now):
            for task, t in sorted(tasks.items()):
                if t["status"] == "processing" and now - t["started"] > limits.running_s:
                    t |= {"status": "timed_out", "ended": now}
                    out.append((shard, task, now, "timed_out", "watchdog"))
            ended = sorted((t["ended"], k) for k, t in tasks.items() if t["status"] in life.ENDED)
            old = [k for e, k in ended if now - e > limits.kept_s]
            rest = [k for e, k in ended if now - e <= limits.kept_s]
            more = rest[: max(0, len(tasks) - len(old) - limits.kept)]
            for reason, keys in (("kept too long", old), ("too many", more)):
                for k in keys:
                    del tasks[k]
                    out.append((shard, k, now, "evicted", reason))
                    if k not in gone:
                        gone.append(k)
                        del gone[: max(0, len(gone) - limits.remembered)]

        for e in [*events, None]:
            now = (e["at"] - T0).total_seconds() if e else end
            while tick <= now:
                maintain(tick)
                tick += limits.every_s
            if not e or e.get("kind") is None:
                continue
            k, kind = e["task"], e["kind"]
            t = tasks.get(k)
            if kind == "status":
                out.append((shard, k, now, t["status"] if t else "expired" if k in gone else "not_found", "asked"))
            elif kind == "create" and t is None:
                tasks[k] = {"status": "pending", "retries": 0}
                out.append((shard, k, now, "pending", "created"))
            elif t and t["status"] not in life.ENDED and kind != "create":
                new, reason = None, kind
                if kind == "start":
                    new = "processing" if t["status"] == "pending" else None
                    t["started"] = now if new else t["started"]
                elif kind == "error" and e["error"] in ("model_error", "engine_error") and t["retries"] < limits.retries:
                    new, reason = "pending", "retry"
                    t["retries"] += 1
                else:
                    new = {"done": "completed", "cancel": "cancelled", "error": "failed"}[kind]
                    reason = e["error"] if kind == "error" else kind
                    t["ended"] = now
                if new:
                    t["status"] = new
                    out.append((shard, k, now, new, reason))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 3])
def test_life(spark, n):
    rng, rows, second = random.Random(5), [], 0
    for k in range(700):
        second += rng.choice([0, 1, 3, 10, 40])
        task = rng.randrange(max(0, k // 8 - 5), k // 8 + 6)
        kind = rng.choice(["create", "create", "start", "start", "done", "error", "error", "cancel", "status"])
        rows.append({"shard": task % 3, "at": at(second), "seq": k, "task": task, "kind": kind, "error": rng.choice(["model_error", "engine_error", "bad_input"]) if kind == "error" else None})
    rows += [{"shard": s, "at": at(second + 5000), "seq": 10_000 + s} for s in range(3)]
    limits = life.Limits(running_s=100, kept_s=300, kept=4, retries=2, every_s=60, remembered=3)
    want = brute_life(rows, limits)
    got = streamed(spark, life.EVENT, rows, lambda x: life.task_life(x, limits), n)
    assert sorted(((r.shard, r.task, (r.at - T0).total_seconds(), r.status, r.reason) for r in got), key=str) == want
    assert {w[3] for w in want} >= {"timed_out", "evicted", "failed", "completed", "cancelled", "expired", "not_found"} and {w[4] for w in want} >= {"retry", "kept too long", "too many"}


def brute_alerts(rows, limits, saved):
    """Each round as a whole: rules, delivery, and the state that is kept."""
    out = []
    for server in sorted({r["server"] for r in rows}):
        own = sorted((r for r in rows if r["server"] == server), key=lambda r: (r["at"], r["seq"]))
        try:
            state = json.loads(saved.get(server) or "{}")
            state = state if isinstance(state, dict) else {}
        except ValueError:
            state = {}
        probes = [k for k, r in enumerate(own) if r["kind"] == "probe"]
        for k, stop in zip(probes, [*probes[1:], len(own)]):
            p, told = own[k], {r["rule"]: r["delivered"] for r in own[k + 1 : stop]}
            now, before = (p["at"] - datetime.datetime(1970, 1, 1)).total_seconds(), dict(state.get("active", {}))
            fires = {"server_down": not p["reachable"] or p["health"] != "healthy"}
            new = dict(state)
            if p["metrics"]:
                full = p.get("queue") is not None and p.get("queue_max") is not None and p["queue_max"] > 0 and p["queue"] / p["queue_max"] >= limits.queue_ratio
                fires["queue_saturation"] = full
                total = p.get("errors") or 0.0
                fires["error_surge"] = "errors" in state and total - state["errors"] >= limits.surge
                new["errors"] = total
            active, sent = {}, []
            for rule in ("server_down", "queue_saturation", "error_surge"):
                was = before.get(rule)
                if rule not in fires:
                    if was and rule == "queue_saturation":
                        active[rule] = was
                elif fires[rule]:
                    if was and now - was["last"] < limits.cooldown_s:
                        active[rule] = was
                    else:
                        active[rule] = {"since": was["since"] if was else now, "last": now}
                        sent.append((rule, "critical" if rule == "server_down" else "warning"))
                elif was and rule != "error_surge":
                    sent.append((rule, "recovery"))
            for rule, level in sent:
                out.append((server, p["at"], rule, level))
                if not told.get(rule):
                    active.pop(rule, None)
                    if rule in before:
                        active[rule] = before[rule]
                    if rule == "error_surge":
                        new["errors"] = state["errors"]
            state = new | {"active": active}
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 3])
def test_alerts(spark, n):
    rng, rows, second, errors = random.Random(9), [], 0, 0
    for k in range(400):
        second += rng.choice([60, 60, 300, 1200])
        errors += rng.choice([0, 0, 1, 12])
        rows.append({"server": k % 3, "at": at(second), "seq": 10 * k, "kind": "probe", "reachable": rng.random() < 0.8, "health": rng.choice(["healthy", "healthy", "degraded", None]), "metrics": rng.random() < 0.8, "queue": rng.choice([None, 1.0, 8.0, 9.0]), "queue_max": rng.choice([None, 0.0, 10.0]), "errors": rng.choice([float(errors), None])})
        for j, rule in enumerate(rng.sample(["server_down", "queue_saturation", "error_surge"], 2)):
            # the feedback may come in a later run
            rows.append({"server": k % 3, "at": at(second + rng.choice([0, 50])), "seq": 10 * k + 1 + j, "kind": "delivery", "rule": rule, "delivered": rng.random() < 0.6})
    limits = alerts.Thresholds(0.8, 10.0, 1800.0)
    saved = {0: '{"active": {"server_down": {"since": 1.0, "last": 1704067190.0}}, "errors": 3.0}', 1: '{"active": {"ser', 2: "[]"}
    first = spark.createDataFrame(list(saved.items()), "server long, state string")

    def build(x):
        own = x.sparkSession.createDataFrame(first.collect(), first.schema)
        return alerts.alert_loop(x, limits, own)

    got = streamed(spark, alerts.ROW, rows, build, n)
    want = brute_alerts(rows, limits, saved)
    assert sorted(((r.server, r.at, r.rule, r.level) for r in got), key=str) == want
    assert {(w[2], w[3]) for w in want} == {("server_down", "critical"), ("server_down", "recovery"), ("queue_saturation", "warning"), ("queue_saturation", "recovery"), ("error_surge", "warning")}


def test_alert_states():
    assert alerts.load_state(None) == alerts.load_state("{") == alerts.load_state("[]") == alerts.load_state('{"active": 3}') == {}
    state = {"active": {"server_down": {"since": 5.0, "last": 9.0}}, "errors": 7.0, "sent": {"server_down": False, "error_surge": False}, "before": {"active": {}, "errors": 2.0}}
    assert alerts.settle(state) == {"active": {}, "errors": 2.0}


def test_directory_queue(spark):
    """Attempts that are killed at any step leave nothing to see, and each result is published once."""
    run = directory.queue(spark)
    made = []

    def work(rows):
        made.append(1)
        return rows.selectExpr("task", "upper(body) as body", "error")

    def put(*lines):
        run.put(spark.createDataFrame([(x,) for x in lines], "value string"))

    def killed(step):
        """A worker that ends before, or after, its attempt is published."""
        whole = directory.worker(run.spark, run.folder, work)

        def attempt(batch, number):
            if step == "work":
                work(batch).write.parquet(f"{run.folder}/attempts/{number}-lost")
            else:
                whole(batch, number)
            raise RuntimeError("killed")

        return attempt

    def seen():
        return sorted((tuple(r) for r in directory.results(spark, run.folder).select("task", "body", "error").collect()), key=str)

    put('{"task": 1, "body": "a"}', "not json")
    with pytest.raises(Exception, match="killed"):
        run.go(killed("work"))
    with pytest.raises(Exception, match="killed"):
        run.go(killed("publish"))
    assert seen() == [(1, "A", None), (None, None, "bad_task")]
    run.go(directory.worker(run.spark, run.folder, work))  # the batch is published already
    assert seen() == [(1, "A", None), (None, None, "bad_task")] and len(made) == 2
    put('{"task": 2, "body": "b"}', '{"task": 2, "body": "b"}', '{"body": "c"}')
    run.go(directory.worker(run.spark, run.folder, work))
    run.go(directory.worker(run.spark, run.folder, work))
    assert seen() == [(1, "A", None), (2, "B", None), (2, "B", None), (None, None, "bad_task"), (None, None, "bad_task")] and len(made) == 3
