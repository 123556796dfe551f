import hashlib
import random
import re
import unicodedata

import duckdb
import pytest

import __spark_entry__ as entry
from chronolake import catalog
from chronolake.functions import text as T
from chronolake.operators import intervals, records, results, sequence, speakers
from chronolake.sources import tables
from chronolake.streaming import tasks
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SEGMENT = "conv_id long, pos long, speaker string, text string, start_ms long, end_ms long"


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return str(v) if hasattr(v, "year") else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    cur = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    want = sorted(repr([plain(v) for v in r]) for r in cur.fetchall())
    got = sorted(repr([plain(v) for v in r]) for r in catalog.queries()[name](spark, DATA).select(columns).collect())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def segments(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], SEGMENT).repartition(3)


def test_merge_cap_and_order(spark):
    rows = [("A", "a", 0, 50_000), ("A", "b", 50_500, 100_000), ("A", "c", 100_500, 150_000)]
    got = [(r.start_ms, r.end_ms, r.text) for r in sequence.merge_segments(segments(spark, rows), 2000, 120_000).orderBy("seg_no").collect()]
    assert got == [(0, 100_000, "ab"), (100_500, 150_000, "c")]
    nested = [(None, "a", 0, 9000), (None, "b", 1000, 2000), (None, "c", 500, 9500)]
    got = [(r.speaker, r.end_ms, r.text) for r in sequence.merge_segments(segments(spark, nested), 2000, 0).orderBy("seg_no").collect()]
    assert got == [(None, 9000, "ab"), (None, 9500, "c")]


def test_aba_cascade(spark):
    rows = [("A", "x" * 50, 0, 5000), ("B", "y" * 20, 5000, 5900), ("A", "z" * 20, 5900, 6800), ("B", "w" * 50, 6800, 9000)]
    got = [r.speaker for r in sequence.smooth_aba(segments(spark, rows), 1000).orderBy("seg_no").collect()]
    assert got == ["A", "A", "A", "B"]


def test_overlap_join_equals_brute_force(spark):
    rng = random.Random(2)
    make = lambda: [("S", "t", s, s + rng.randint(0, 15_000)) for s in (rng.randint(0, 60_000) for _ in range(40))]
    a, b = make(), make()
    got = {(r.l_pos, r.r_pos, r.overlap_ms) for r in intervals.overlap_join(segments(spark, a), segments(spark, b), "conv_id").collect()}
    want = {(i, j, o) for i, x in enumerate(a) for j, y in enumerate(b) if (o := min(x[3], y[3]) - max(x[2], y[2])) > 0}
    assert got == want
    plan = intervals.overlap_join(segments(spark, a), segments(spark, b), "conv_id")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cosine_of_nothing(spark):
    row = spark.sql("select array(0d, 0d) z, array(1d, 0d) a, cast(null as array<double>) n").select(*(speakers.cosine(F.col(x), F.col(y)) for x, y in (("z", "a"), ("n", "a"), ("a", "a")))).first()
    assert tuple(row) == (-1.0, -1.0, 1.0)


def test_texts(spark):
    row = spark.sql("select 'ab' || repeat('xyz', 6) t, array(' a  b', 'a b', '', 'c') l, 3661001L ms").select(T.first_repetition(F.col("t")), T.normalize_terms(F.col("l")), T.clock(F.col("ms"))).first()
    assert tuple(row) == ("xyz", ["a b", "c"], "01:01:01,001")


def test_repetition_equals_brute_force(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab  \n\u00a0\x1c") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["ab ab ab ab ab ab", "na na na na na na nan", *(r.text for r in tables.table(spark, DATA, "documents").collect())]

    def first(text):
        text = "".join(text.split())
        for k in range(2, 13):
            for i in range(len(text) - 6 * k + 1):
                if text[i : i + 6 * k] == text[i : i + k] * 6:
                    return text[i : i + k]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.first_repetition(F.col("t")).alias("u")).collect()
    assert {r.i: r.u for r in rows} == {i: first(t) for i, t in enumerate(texts)}


def test_terms_equal_plain_python(spark):
    """Compatibility forms, every kind of white space, and each limit in its order."""
    lists = [["ＡＢＣ", "ABC", " a\u3000b\tc ", "", "\u00a0"], ["x"] * 101, ["y" * 257], [f"t{i}" for i in range(51)], ["z" * 65], [f"{i:02}" + "w" * 60 for i in range(20)], [], ["ﬁ" * 100], ["ﬁ" * 33]]

    def judge(raw):
        clean = list(dict.fromkeys(c for t in raw if (c := re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).strip()))))
        limits = [(len(raw) > 100, "too_many_raw_items"), (any(len(t) > 256 for t in raw), "raw_item_too_long"), (len(clean) > 50, "too_many_terms"), (any(len(t) > 64 for t in clean), "term_too_long"), (sum(map(len, clean)) > 1024, "total_too_long")]
        return clean, next((name for broken, name in limits if broken), None)

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, raw array<string>").withColumn("terms", T.normalize_terms(F.col("raw")))
    got = {r.i: (r.terms, r.error) for r in rows.select("i", "terms", records.term_error(F.col("raw"), F.col("terms")).alias("error")).collect()}
    assert got == {i: judge(x) for i, x in enumerate(lists)}


def test_upsert(spark):
    cache = spark.createDataFrame([("h", "e", 1), ("h", "f", 2)], "file_hash string, engine string, v int")
    new = spark.createDataFrame([("h", "e", 3)], cache.schema)
    assert sorted(r.v for r in results.upsert(cache, new).collect()) == [2, 3]


def test_stream_equals_batch(spark, tmp_path):
    rows = tables.task_rows(spark, DATA).select("file_hash", "created_at", "task_id", "status")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    query = tasks.sticky_status(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("sticky").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.file_hash: (r.status, r.terminal) for r in spark.table("sticky").collect()}
    want = {r.file_hash: (r.status, r.terminal) for r in results.first_terminal(rows, "file_hash", "created_at").collect()}
    assert got == want


def test_cache_lookup_answers_every_request(spark):
    names = ("qwen3+nospk", "qwen3", "funasr", "qwen3+wa:eng")
    keys = [r.o_orderkey for r in tables.table(spark, DATA, "orders").select("o_orderkey").distinct().collect()]
    newest = {}
    for r in tables.cache_rows(spark, DATA).select("file_hash", "engine", "created_min", "id").collect():
        newest[r.file_hash, r.engine] = max(newest.get((r.file_hash, r.engine), (-1, -1)), (r.created_min, r.id))
    want = {}
    for k in keys:
        h, e = hashlib.md5(str(k % 60).encode()).hexdigest(), names[k % 4]
        tries = [(1, [e]), (2, [e.removesuffix("+nospk")]), (3, ["funasr", "qwen3"] if "+" not in e else [])]
        found = [(rank, max((newest[h, x], x) for x in xs if (h, x) in newest)) for rank, xs in tries if any((h, x) in newest for x in xs)]
        want[k] = (found[0][1][0][1], found[0][1][1], found[0][0]) if found else (None, None, None)
    rows = catalog.queries()["cache_lookup"](spark, DATA).collect()
    assert len(rows) == len(want) > 501
    assert {r.req_id: (r.id, r.engine, r.rank) for r in rows} == want


def test_terms_are_whole_and_judged(spark, tmp_path):
    rows = [(1, ",".join(f"term{i}" for i in range(60))), (2, "a, b ,a"), (3, ",".join(f"term{i}" for i in range(1200)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.terms, r.error) for r in catalog.queries()["terms_normalize"](spark, str(tmp_path)).collect()}
    assert got == {1: ([f"term{i}" for i in range(60)], "too_many_terms"), 2: (["a", "b"], None), 3: ([f"term{i}" for i in range(1200)], "too_many_raw_items")}
