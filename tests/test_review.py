"""Operators without SQL against plain Python, and literal cases."""

import math
import random
import time
from difflib import SequenceMatcher
from itertools import permutations, product

import numpy as np
from pyspark.sql import functions as F

from chronolake.functions import blocks, parse, rules
from chronolake.functions import text as T
from chronolake.operators import allocate, clusters, evaluation, frames, guard, intervals, planning, records, service
from chronolake.plans import records as plans
from chronolake.plans import review
from chronolake.sources import tables as S
from tests.test_engine import segments


def rows_of(rng, n, speakers="AB", longest=4000):
    out, t = [], 0
    for _ in range(n):
        t += rng.choice([0, 20, 60, 300, 2000])
        span = rng.choice([200, 700, 1200, longest])
        out.append((rng.choice(speakers), rng.choice(["", "对", "so", "a longer text here"]), t, t + span))
        t += span
    return out


def absorbed(rows, least, gap):
    rows, out, i = [list(r) for r in rows], [], 0
    while i < len(rows):
        s, text, a, b = rows[i]
        prev, nxt = (out[-1] if out else None), (rows[i + 1] if i + 1 < len(rows) else None)
        back = a - prev[3] if prev else math.inf
        ahead = nxt[2] - b if nxt else math.inf
        if b - a < least and text.strip() and min(back, ahead) <= gap:
            if back <= ahead:
                prev[1], prev[3] = prev[1] + text, max(prev[3], b)
            else:
                out.append([nxt[0], text + nxt[1], min(a, nxt[2]), nxt[3]])
                i += 1
        else:
            out.append([s, text, a, b])
        i += 1
    return out


def guarded(rows, least, middle, gap):
    out = absorbed(rows, least, gap)
    for a, b, c in zip(out, out[1:], out[2:]):
        span, text = b[3] - b[2], b[1].strip()
        if a[0] == c[0] != b[0] and span <= middle and (text in ("", "对") or (0 < span <= 1000 and len(text) * 1000 >= 5 * span)):
            b[0] = a[0]
    merged = []
    for r in out:
        if merged and merged[-1][0] == r[0] and r[2] - merged[-1][3] <= gap:
            merged[-1][1] += r[1]
            merged[-1][3] = max(merged[-1][3], r[3])
        else:
            merged.append(list(r))
    return merged


def test_guard_equals_python(spark):
    rng = random.Random(5)
    for n in (1, 2, 7, 40, 60):
        rows = rows_of(rng, n)
        df = segments(spark, rows)
        got = [[r.speaker, r.text, r.start_ms, r.end_ms] for r in guard.absorb_tiny(df, 1000, 100).orderBy("seg_no").collect()]
        assert got == absorbed(rows, 1000, 100)
        got = [[r.speaker, r.text, r.start_ms, r.end_ms] for r in guard.short_guard(df, 1000, 1500, 60).orderBy("seg_no").collect()]
        assert got == guarded(rows, 1000, 1500, 60)


def pieces(text, weights):
    total = sum(weights)
    if total <= 0:
        weights, total = [1.0] * len(weights), len(weights)
    out, at, acc = [], 0, 0.0
    for w in weights[:-1]:
        acc += w
        target = max(at, round(len(text) * acc / total))
        reach = min(18, max(2, round((target - at) * 0.5)))
        if 0 < target < len(text):
            marks = [i for i in range(max(1, target - reach), min(len(text) - 1, target + reach) + 1) if text[i - 1] in allocate.STOPS]
            target = min(marks, key=lambda i: (abs(i - target), i), default=target)
        out.append(text[at:target])
        at = target
    return [*out, text[at:]]


def test_weighted_split(spark):
    rng = random.Random(6)
    cases = [("".join(rng.choice("abc。?") for _ in range(rng.randint(0, 60))), [float(rng.choice([0, 1, 3, 700])) for _ in range(rng.randint(1, 6))]) for _ in range(200)]
    df = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(cases)], "i int, t string, w array<double>")
    got = {r.i: r.p for r in df.select("i", allocate.weighted_split(F.col("t"), F.col("w")).alias("p")).collect()}
    assert all(got[i] == pieces(t, w) for i, (t, w) in enumerate(cases))


def test_chunk_turns(spark):
    rng = random.Random(7)
    chunks = [("-", "".join(rng.choice("ab。") for _ in range(40)), 5000 * i, 5000 * i + 4000) for i in range(20)]
    turns = sorted((s, s + rng.randint(10, 6000), rng.choice("XY")) for s in (rng.randint(0, 60_000) for _ in range(15)))
    want = []
    for i, (_, text, a, b) in enumerate(chunks):
        cuts = [(max(a, s), min(b, e), w) for s, e, w in turns if min(b, e) - max(a, s) > 30]
        if not cuts:
            mid = (a + b) / 2
            cuts = [(a, b, min(turns, key=lambda t: min(abs(t[0] - mid), abs(t[1] - mid)))[2])]
        want += [(i, w, s, e, p) for (s, e, w), p in zip(cuts, pieces(text, [e - s for s, e, _ in cuts])) if p]
    t = spark.createDataFrame([(1, i, w, s, e) for i, (s, e, w) in enumerate(turns)], "conv_id long, pos long, speaker string, start_ms long, end_ms long")
    got = allocate.chunk_turns(segments(spark, chunks), t)
    assert sorted((r.pos, r.speaker, r.start_ms, r.end_ms, r.text) for r in got.collect()) == sorted(want)
    alone = allocate.chunk_turns(segments(spark, chunks), t.limit(0))
    assert {r.speaker for r in alone.collect()} == {"0"} and alone.count() == 20


def test_split_long(spark):
    rng = random.Random(8)
    rows = [("A", "x" * 50 + "。" + "y" * 50, 0, 95_000), ("B", "short", 95_000, 99_000), ("B", " ", 99_000, 200_000)]
    quiet = sorted(rng.sample(range(1000, 90_000, 2), 8))
    s = spark.createDataFrame([(1, q - 100, q + 100) for q in quiet], "conv_id long, start_ms long, end_ms long")
    got = allocate.split_long(segments(spark, rows), s, 20_000, 500).orderBy("pos", "piece").collect()
    first = [r for r in got if r.pos == 0]
    assert [r.text for r in got if r.pos > 0] == ["short", " "]
    assert "".join(r.text for r in first) == rows[0][1] and len(first) == 5
    cuts, hard, prev = [], 0, 0.0
    for i in range(1, 5):
        low, high = max(prev + 500, 95_000 - 20_000 * (5 - i)), min(prev + 20_000, 95_000 - 500 * (5 - i))
        fit = [q for q in quiet if low <= q <= high]
        target = 95_000 * i / 5
        hard += not fit
        prev = min(fit, key=lambda q: abs(q - target)) if fit else min(max(target, low), high)
        cuts.append(prev)
    assert [r.end_ms for r in first][:-1] == cuts and first[0].hard_cuts == hard


def test_linear_split_without_turns(spark):
    texts = spark.createDataFrame([(1, "abc"), (2, "")], "conv_id long, text string")
    none = spark.createDataFrame([], "conv_id long, pos long, speaker string, start_ms long, end_ms long")
    assert [tuple(r) for r in allocate.linear_split(texts, none).collect()] == [(1, 0, "0", 0, 0, "abc")]


def test_macro_plan():
    assert planning.macro_cuts(10_000, [], 4000, 5000, 7000, 1000, 500) == [4000, 8000, 10_000]
    assert planning.macro_cuts(10_000, [(3900, 4300)], 4000, 5000, 7000, 1000, 500)[0] == 4100
    assert planning.macro_cuts(10_000, [(6000, 6200)], 4000, 5000, 7000, 1000, 500)[0] == 6100
    assert planning.macro_cuts(4800, [], 4000, 5000, 7000, 1000, 500) == [4800]
    assert planning.macro_cuts(5100, [(4500, 4700)], 4000, 5000, 7000, 1000, 700) == [5100]


def test_linkage():
    rng = np.random.default_rng(3)
    for n in (1, 2, 25):
        x = rng.normal(size=(n, 4))
        got = clusters.complete_linkage(x, 0.5)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        far, groups = 1 - unit @ unit.T, [[i] for i in range(n)]
        while len(groups) > 1:
            d, i, j = min((max(far[a, b] for a in p for b in q), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
            if d > 0.5:
                break
            groups[i] += groups.pop(j)
        assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(got == k)) for k in set(got)}
    assert list(clusters.complete_linkage(np.eye(3), count=3)) == [0, 1, 2]
    assert len(set(clusters.complete_linkage(np.eye(3), count=1))) == 1


def test_label_merge():
    e = np.eye(3)
    close = [0.9, math.sqrt(1 - 0.81), 0]
    assert clusters.merge_labels([("a", 50, e[0]), ("b", 49, close), ("c", 1, e[2])]) == {"a": "a", "b": "a", "c": "c"}
    assert clusters.merge_labels([("a", 50, e[0]), ("b", 48, e[1]), ("c", 2, close)])["c"] == "a"
    assert clusters.merge_labels([("a", 90, e[0]), ("b", 10, [0.65, math.sqrt(1 - 0.65**2), 0])]) == {"a": "a", "b": "a"}
    assert clusters.merge_labels([("a", 98, e[0]), ("c", 2, [0.52, math.sqrt(1 - 0.52**2), 0])]) == {"a": "a", "c": "a"}
    assert clusters.merge_labels([("a", 98, e[0]), ("c", 2, None)]) == {"a": "a", "c": "c"}


def test_mapping():
    assert clusters.best_mapping({("1", "x"): 5, ("1", "y"): 6, ("2", "y"): 9}) == {"1": "x", "2": "y"}
    assert clusters.best_mapping({("1", "x"): 5, ("2", "x"): 6, ("3", "y"): 1}) == {"1": "x", "2": "x", "3": "y"}
    assert clusters.best_mapping({}) == {}


def test_greedy_pairs(spark):
    rows = [(0, "a", "X", 5.0), (0, "a", "Y", 4.0), (0, "b", "X", 4.5), (0, "b", "Y", 1.0), (0, "c", "Y", 0.0)]
    got = clusters.greedy_pairs(spark.createDataFrame(rows, "rec int, local string, label string, score double")).collect()
    assert {(r.local, r.label) for r in got} == {("a", "X"), ("b", "Y")}


def test_alert_states(spark):
    seen = [(0, True), (100, True), (900, True), (1000, None), (1900, True), (2000, False), (2100, False), (2200, True)]
    df = spark.createDataFrame([("k", t, f) for t, f in seen], "k string, at long, f boolean")
    got = [(r.at, r.notice) for r in service.alert_states(df, "k", "at", "f", 900).orderBy("at").collect()]
    assert got == [(0, "fire"), (900, "repeat"), (1900, "repeat"), (2000, "recovery"), (2200, "fire")]


def test_similar_run(spark):
    rng = random.Random(9)
    texts = [rng.choice(["the very same sentence, said again", "the very same sentence, said againn", "other", " "]) for _ in range(60)]
    kept, start, want = [t for t in texts if t.strip()], 0, None
    for i in range(1, len(kept)):
        if SequenceMatcher(None, kept[i - 1], kept[i]).ratio() < 0.95:
            start = i
        elif i - start + 1 >= 4:
            want = (start, i)
            break
    got = evaluation.similar_run(segments(spark, [("A", t, 0, 1) for t in texts])).collect()
    assert [(r.segment_start, r.segment_end) for r in got] == ([want] if want else [])


def test_edit_stats(spark):
    df = spark.createDataFrame([(1, "abcd", "abxd"), (2, "", "ab"), (3, "abc", "")], "k int, ref string, hyp string")
    got = {r.k: (r.equal, r.inserted, r.deleted, r.edits, r.error_rate) for r in evaluation.edit_stats(df, "k").collect()}
    assert got == {1: (3, 0, 0, 1, 0.25), 2: (0, 2, 0, 2, 0.0), 3: (0, 0, 3, 3, 1.0)}


def test_logs(spark):
    log = "x\nsilence_start: 0\nsilence_end: 1.5 | d: 1\nsilence_start: 3.25\n"
    df = spark.createDataFrame([(1, log, 5000), (2, "", 700), (3, "silence_end: 1\nsilence_start: 0.05", 60), (4, "silence_end: 1\nsilence_start: 2\nsilence_end: 3", 5000)], "k int, log string, duration_ms long")
    got = {(r.k, r.start_ms, r.end_ms) for r in parse.silence_log(df, "k").collect()}
    assert got == {(1, 1500, 3250), (2, 0, 700), (4, 0, 2000), (4, 3000, 5000)}
    text = "# HELP a b\na 18\nb{kind=\"x\",z=\"q\"} 2.5\nb{kind=\"x\"} 3\nbad\nc nope\nd{} 4\n"
    got = {(r.name, r.label, r.value) for r in parse.metrics(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).collect()}
    assert got == {("a", None, 18.0), ("b", "x", 3.0), ("d", None, 4.0)}
    row = spark.sql("select 'time=00:00:01.50 time=01:02:03.25' l, 'Speaker12' s, 'need 512 MB now' m, 'N/A' n").select(parse.last_clock(F.col("l")), parse.speaker_number(F.col("s")), parse.buffer_gb(F.col("m")), parse.duration(F.col("n"), F.col("n"), F.col("l"))).first()
    assert tuple(row) == (3723.25, 12, 0.5, 3723.25)


def test_transcript(spark):
    text = "title\n---\nx\n---\nlost\n甲：one\n two\n\n乙：three"
    got = parse.transcript(spark.createDataFrame([(1, text)], "k int, text string"), "k", ("甲", "乙")).orderBy("para").collect()
    assert [(r.speaker, r.text) for r in got] == [("甲", "onetwo"), ("乙", "three")]


def test_uploads(spark):
    import hashlib

    md5 = lambda b: hashlib.md5(b).hexdigest()
    chunks = [("a", 0, b"12345"), ("a", 0, b"12345"), ("a", 1, b"67"), ("b", 0, b"12345"), ("b", 7, b"x"), ("c", 0, b"xx")]
    c = spark.createDataFrame([(u, i, x, md5(x)) for u, i, x in chunks], "upload string, idx int, data binary, md5 string")
    u = spark.createDataFrame([("a", 2, 7, md5(b"1234567")), ("b", 2, 7, md5(b"")), ("c", 1, 2, md5(b"yy"))], "upload string, total int, size long, md5 string")
    got = {r.upload: (r.received, r.data and bytes(r.data), r.valid) for r in service.assemble(c, u, 5).collect()}
    assert got == {"a": (2, b"1234567", True), "b": (1, None, None), "c": (1, b"xx", False)}


def test_metrics_code(spark):
    cases = [("/m?token=t", None, "t", "0.0.0.0", None), ("/m", "Bearer t", "t", "x", None), ("/m", "t", "t", "x", None), ("/m", None, "t", "x", 403), ("/m", None, None, "::", 403), ("/m", None, "", "10.0.0.1", None)]
    df = spark.createDataFrame(cases, "p string, h string, t string, o string, want int")
    assert all(r.got == r.want for r in df.withColumn("got", rules.metrics_code(F.col("p"), F.col("h"), F.col("t"), F.col("o"))).collect())


def test_frames(spark):
    rows = [(0, 0, f, [1 if 2 <= f < 14 or f == 20 else 0, 1 if f == 3 else 0, 0]) for f in range(30)]
    df = spark.createDataFrame(rows, "rec int, chunk int, frame int, active array<int>")
    got = {(r["from_sample"], r["to_sample"]) for r in frames.sample_ranges(df, 10).collect()}
    at = lambda f: int(f / 30 * frames.CHUNK)
    assert got == {(at(2), at(3)), (at(4), at(14)), (at(20), at(21))}
    row = spark.sql("select array(3, 4, 0, 5, 1) s").select(frames.block_rms(F.col("s"), 2).alias("r"), frames.powerset_slots(F.lit(5)).alias("p")).first()
    assert math.isclose(row.r.mean, (math.sqrt(12.5) * 2) / 2) and math.isclose(row.r.deviation, 0, abs_tol=1e-12) and row.p == [1, 0, 1]


def test_accept(spark):
    old = segments(spark, [("A", "", 0, 5000), ("B", "", 5000, 9000)])
    many = segments(spark, [("AB"[i % 2], "", i * 100, i * 100 + 100) for i in range(40)])
    got = planning.accept(old, many, F.lit(False), ["conv_id"]).first()
    assert not got.accepted and set(got.reasons) == {"many_switches", "many_segments", "many_short_segments"}
    none = planning.accept(old, many.limit(0), F.lit(False), ["conv_id"]).first()
    assert none.reasons == ["empty"] and planning.accept(old, old, F.lit(False), ["conv_id"]).first().accepted


def test_plans_have_no_nested_loops(spark):
    rng = random.Random(1)
    df = segments(spark, rows_of(rng, 30))
    quiet = intervals.complement(df, spark.createDataFrame([(1, 100_000)], "conv_id long, duration_ms long"))
    for out in (allocate.chunk_turns(df, df), allocate.snap(df, quiet), clusters.spurious(df), allocate.split_long(df, quiet, 2000, 100)):
        plan = out._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sentence_shapes(spark):
    cases = {1: '[{"text":"a","sentence_info":[{"start":1000,"end":2500,"text":" a ","spk":1},{"text":" "},{"text":"b","spk":"x"}]}]', 2: '{"text":" "}', 3: '{"text":"a"}', 4: '{"text":"a","sentence_info":[]}', 5: "[]", 6: "nonsense", 7: '{"text":"a","sentence_info":{}}'}
    got = records.sentences(spark.createDataFrame(list(cases.items()), "k int, result string"), "k").collect()
    assert sorted((r.k, r.speaker, r.text, r.start_ms, r.end_ms) for r in got if r.error is None) == [(1, "Speaker1", "b", 0, 0), (1, "Speaker2", "a", 1000, 2500)]
    assert {r.k for r in got if r.error} == {3, 4, 6, 7}


def test_small_records(spark):
    body = '{"segments":[{"start":0.5,"end":1.25,"speaker":"Speaker2"}]}'
    got = records.json_turns(spark.createDataFrame([(1, body), (2, "{}")], "k int, body string"), "k").collect()
    assert [(r.k, r.speaker, r.start_ms, r.end_ms) for r in got] == [(1, 1, 500, 1250)]
    df = spark.createDataFrame([(["a"] * 101, ), (["a" * 257],), ([str(i) for i in range(60)],), (["a" * 65],), ([f"{i:02}" + "b" * 60 for i in range(20)],), (["ok"],)], "t array<string>")
    assert [r[0] for r in df.coalesce(1).select(records.term_error(F.col("t"), T.normalize_terms(F.col("t")))).collect()] == ["too_many_raw_items", "raw_item_too_long", "too_many_terms", "term_too_long", "total_too_long", None]
    chunks = segments(spark, [("A", "x", 0, 10), ("A", " ", 10, 20)])
    texts = spark.createDataFrame([(1, "x", 20), (2, "whole", 50)], "conv_id long, text string, duration_ms long")
    assert sorted(tuple(r) for r in records.without_turns(chunks, texts).collect()) == [(1, 0, "x", 0, 10), (2, 0, "whole", 0, 50)]


def test_roles_equal_python(spark):
    rng = random.Random(11)
    rows = [(rng.choice("AB"), rng.choice(["why ask", "so I say it", "why so", "nothing"]), 20_000 * i, 20_000 * i + rng.choice([3000, 11_000, 15_000])) for i in range(40)]
    mass = {s: sum(len(t) for w, t, _, _ in rows if w == s) for s in "AB"}
    tell, ask = sorted("AB", key=lambda s: -mass[s])
    assert mass["A"] != mass["B"]
    want = []
    for s, t, a, b in rows:
        q, n = int("why" in t), int("so" in t)
        want.append(ask if s == tell and b - a <= 10_000 and q >= 1 and q >= n else tell if s == ask and b - a <= 12_000 and n >= 1 and n > q else s)
    got = guard.smooth_roles(segments(spark, rows), ("why",), ("so",)).orderBy("pos").collect()
    assert [r.speaker for r in got] == want
    three = segments(spark, [*rows, ("C", "why", 900_000, 900_100)])
    assert guard.smooth_roles(three, ("why",), ("so",)).filter("smoothed_from is not null").count() == 0


def test_chunk_grid_equals_python(spark):
    starts = [0, 900, 9400, 10_400, 10_600, 21_000, 40_000]
    m = spark.createDataFrame([(1, 0, 0.0, 10_000.0), (1, 1, 10_000.0, 20_600.0)], "conv_id long, idx long, start_ms double, end_ms double")
    got = planning.chunk_grid(segments(spark, [("A", "x", s, s + 10) for s in starts]), m, 4000).orderBy("pos").collect()
    # Slack of 500 ms: 10,400 still belongs to the first segment, 21,000 to the second, 40,000 to none.
    assert [(r.pos, r.macro, r.chunk) for r in got] == [(0, 0, 0), (1, 0, 0), (2, 0, 2), (3, 0, 2), (4, 1, 0), (5, 1, 2)]


def test_frame_turns_equal_python(spark):
    rng = random.Random(12)
    n = 400
    on = {c: [rng.random() < 0.5 if i % 40 < 10 else c == 0 or i % 7 < 5 for i in range(n)] for c in range(2)}
    want, second = set(), lambda f: f * (frames.SHIFT / frames.RATE) + 0.5 * frames.FIELD / frames.RATE
    for c, row in on.items():
        merged = []
        for i in range(n):
            if row[i] and (i == 0 or not row[i - 1]):
                end = next((j for j in range(i, n) if not row[j]), n)
                a, b = second(i), second(min(end, n - 1))
                if merged and 0 < a - merged[-1][1] <= 0.04:
                    merged[-1][1] = b
                else:
                    merged.append([a, b])
        want |= {(c, round(a, 6), round(b, 6)) for a, b in merged if b - a > 0.1}
    labels = spark.createDataFrame([(0, i, c) for c, row in on.items() for i in range(n) if row[i]], "rec int, at long, cluster int")
    got = frames.to_turns(labels, spark.createDataFrame([(0, n)], "rec int, n long"), 0.1, 0.04).collect()
    assert {(r.cluster, round(r.start, 6), round(r.end, 6)) for r in got} == want


def test_text_queries_use_whole_texts(spark, tmp_path):
    long = "b" * 300 + "a" * 40
    near = "the very same sentence, said again"
    rows = [(1, 0, "user", long)] + [(2, i, "user", near + "n" * (i % 2)) for i in range(4)] + [(3, i, "user", f"{i} unlike " * (i + 1)) for i in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    r = review.edit_stats(spark, str(tmp_path)).filter("row = '1:0'").first()
    assert (r.ref_chars, r.hyp_chars, r.edits) == (340, 300, 40)
    assert [(r.conv_id, r.segment_start, r.segment_end) for r in review.similar_run(spark, str(tmp_path)).collect()] == [(2, 0, 3)]


def test_mapping_of_many_labels_is_exact():
    rng = random.Random(4)
    for n, m in ((8, 8), (5, 8), (2, 9)):
        counts = {(f"a{i}", f"b{j}"): rng.choice([0, 3, 9, 10]) for i in range(n) for j in range(m)}
        got = clusters.best_mapping(counts)
        best = max(sum(counts[f"a{i}", f"b{j}"] for i, j in enumerate(p)) for p in permutations(range(m), n))
        assert len(set(got.values())) == n and sum(counts[x] for x in got.items()) == best


def test_speaker_accuracy_of_all_recordings(spark):
    counts = {}
    for r in evaluation.confusion(review._chars(spark, "/root/testdata/sf0.001")).collect():
        counts.setdefault(r.rec, {})[r.own, r.true] = r.n
    want = {}
    for rec, c in counts.items():
        own, true = sorted({a for a, _ in c}), sorted({b for _, b in c})
        trials = permutations(true, len(own)) if len(own) <= len(true) else product(true, repeat=len(own))
        want[rec] = round(max(sum(c.get(x, 0) for x in zip(own, t)) for t in trials) / sum(c.values()), 9)
    assert {r.rec: r.accuracy for r in review.speaker_accuracy(spark, "/root/testdata/sf0.001").collect()} == want


def test_queries_without_slices(spark):
    d = "/root/testdata/sf0.001"
    items = S.segments(spark, d)
    assert plans.label_items(spark, d).select("conv_id", "pos").exceptAll(items.select("conv_id", "pos")).isEmpty()
    assert plans.label_items(spark, d).count() == items.count()
    assert review.status_batch(spark, d).count() == 50 * S.table(spark, d, "customer").count()
    assert review.chunk_triggers(spark, d).agg(F.sum("segments")).first()[0] == items.count()


def test_blocks_equal_the_definition_and_stay_linear():
    rng = random.Random(21)

    def joined(found):
        out = []
        for i, j, n in found:
            if out and (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]) == (i, j):
                out[-1][2] += n
            else:
                out.append([i, j, n])
        return out

    for t in range(300):
        letters = "ab" if t % 3 else "abcdefgh 的"
        a = [rng.choice(letters) for _ in range(rng.choice([0, 1, 20, 210, 260]))]
        b = [rng.choice([c, c, c, c, "x", "", "b"]) for c in a] if t % 2 else [rng.choice(letters) for _ in range(rng.choice([0, 3, 199, 200, 250]))]
        for skip in (False, True):
            want = [list(m) for m in SequenceMatcher(None, "".join(a), "".join(b), autojunk=skip).get_matching_blocks() if m.size]
            assert joined(blocks.matching("".join(a), "".join(b), skip)) == want
    began, text = time.time(), "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    assert sum(n for _, _, n in blocks.matching(text, text[:40_000] + "!" + text[40_003:])) == 99_997
    assert time.time() - began < 20
