import hashlib
import random

import numpy as np
import pytest

from chronolake.llm import bag_minhash
from chronolake.llm import components as components_of
from chronolake.llm import regions as R
from chronolake.llm import embedding_dedup, substring_automaton, substring_suffix
from chronolake.llm.components import components

from . import brute
from .conftest import CLASHING


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("width", [100, 12])
def test_suffix_dedup(spark, small, width):
    want = {}
    for d, mask in brute.suffix_cover(small, width).items():
        raw = (dict(small)[d] or "").encode()
        spans = sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))
        want[d] = (len(raw), sum(mask), spans, bytes(b for b, m in zip(raw, mask) if not m))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substring_suffix.dedup_substrings(frame(spark, small), width).collect()}
    assert got == want


def test_dedup_texts_keeps_characters(spark):
    rows = [(1, "é中😀" * 60), (2, "x" + "é中😀" * 60), (3, None)]
    got = {r.doc_id: r.text for r in substring_suffix.dedup_texts(frame(spark, rows), 10).collect()}
    assert got[1] == "é中😀中😀"[:3] and got[2] == "x" and got[3] is None


def test_copies_within_texts(spark):
    """Passages that come back in one document, in copies of it and in parts of it, in one task and in several."""
    rng = np.random.default_rng(12)
    parts = [" ".join(f"p{k}q{rng.integers(10**6)}" for _ in range(45)) for k in range(5)]
    rows = [(int(d), " ".join(parts[k][c : c + 300] for k, c in zip(rng.integers(0, 5, n), rng.integers(0, 90, n)))) for d, n in zip(rng.permutation(80), rng.integers(1, 7, 80))]
    rows += [(200 + d, t) for d, t in rows[:25]]
    for tasks in (1, 6):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks)
        got = {r.doc_id: r.n_removed for r in substring_suffix.dedup_substrings(docs).collect()}
        assert got == {d: sum(m) for d, m in brute.suffix_cover(rows, 100).items()}
        got = {r.doc_id: r.n_removed for r in substring_automaton.remove_passages(docs, 12).collect()}
        assert got == {d: sum(m) for d, (_, m) in brute.word_cover(rows, 12).items()}


@pytest.mark.parametrize("width", [35, 6])
def test_automaton_dedup(spark, small, width):
    want = {d: (len(w), sum(m), " ".join(x for x, y in zip(w, m) if not y)) for d, (w, m) in brute.word_cover(small, width).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in substring_automaton.remove_passages(frame(spark, small), width).collect()}
    assert got == want


def test_frequent_anchors(spark):
    """A line in most documents is frequent; the result stays exact."""
    line = "this very common line stands in nearly every document of the table and is longer than a hundred bytes in all"
    rows = [(i, f"own start {i * i} {line} and own end {i * 31}") for i in range(300)]
    docs = frame(spark, rows).coalesce(2)
    cells = substring_suffix.R.hot_cells(substring_suffix.keyed(docs), substring_suffix.R.Plan(100, 24))
    assert cells.any()
    got = {r.doc_id: r.n_removed for r in substring_suffix.dedup_substrings(docs).collect()}
    assert got == {d: sum(m) for d, m in brute.suffix_cover(rows, 100).items()}


def test_bag_minhash(spark, small):
    got = {r.doc_id: r.component_id for r in bag_minhash.near_duplicates(frame(spark, small)).collect()}
    assert got == brute.near_components(small)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    error = []
    for _ in range(30):
        h = rng.integers(1, 2**63, 40, dtype=np.uint64)
        a = rng.integers(0, 7, 40)
        b = np.where(rng.random(40) < 0.6, a, rng.integers(0, 7, 40))
        row = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = bag_minhash.signatures(row, np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 512)
        error.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(error)) < 0.015


def test_near_dedup_edges(spark, edge_rows):
    docs = spark.createDataFrame(edge_rows, CLASHING)
    kept = bag_minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 5, 5]
    assert bag_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_substring_edges(spark, edge_rows):
    docs = spark.createDataFrame(edge_rows, CLASHING)
    for rows in (substring_suffix.dedup_substrings(docs), substring_automaton.remove_passages(docs)):
        got = rows.collect()
        assert len(got) == 6 and {r.own for r in got} == {3} and {r.lang for r in got} == {None}
        assert rows.filter("doc_id = 4").first().kept is not None
    assert substring_suffix.dedup_substrings(docs.limit(0)).count() == 0
    assert substring_automaton.remove_passages(docs.limit(0)).count() == 0
    assert substring_suffix.dedup_texts(docs).columns == docs.columns


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2001 + i) for i in range(40)]
    # tasks contract three edges at once, so hot nodes are left to the steps
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == brute.components(nodes, [p for p in pairs if p[0] != p[1]])
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 16))
    rows = []
    for i in range(240):
        v = base[i % 30] + rng.standard_normal(16) * 0.12 * (i % 4)
        rows.append((i, [float(np.float32(x)) for x in v], i % 3 if i % 17 else None))
    rows += [(500 + i, rows[5][1], rows[5][2]) for i in range(4)] + [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, [1.0, None], 1), (604, [], 1), (605, [2.0, 1.0], 1)]
    units = {k: np.array(v) / np.linalg.norm(v) for k, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {k: lab for k, _, lab in rows}
    linked = [(a, b) for a in units for b in units if a < b and label[a] == label[b] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.93]
    want_root = brute.components([k for k, _, _ in rows], linked)
    want = {k: (sum(k in p for p in linked), want_root[k]) for k in want_root}
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicate_vectors(vectors).collect()}
    assert got == want
    assert embedding_dedup.near_duplicate_vectors(vectors.limit(0)).count() == 0


def test_hot_nodes(spark, monkeypatch):
    """Nodes with very many neighbours are met by broadcast; the result is the same."""
    monkeypatch.setattr(components_of, "HOT_EDGES", 8)
    monkeypatch.setattr(components_of, "MOST_HOT", 40)
    rng = np.random.default_rng(9)
    pairs = [(5000, i) for i in range(200)] + [(i, 7000 + i) for i in range(0, 200, 3)] + [(9000 + i, 100 + i) for i in range(40)] + [(int(a), int(b)) for a, b in rng.integers(20_000, 20_400, (300, 2))]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == brute.components(nodes, [p for p in pairs if p[0] != p[1]])


def test_hot_copies(spark, monkeypatch):
    """Groups of very many copies are met by broadcast; the result is the same."""
    monkeypatch.setattr(components_of, "HOT_EDGES", 4)
    rows = [(i, "the very same text of more than five words" if i % 3 else f"own text {i} of a few more words") for i in range(90)]
    got = {r.doc_id: r.component_id for r in bag_minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: 1 if i % 3 else i for i, _ in rows}
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [0.0, 1.0 + i], 1) for i in range(60)], "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicate_vectors(vectors).collect()}
    assert found == {i: (39, 1) if i % 3 else (19, 0) for i in range(60)}


def test_embedding_edges(spark, monkeypatch):
    """A bucket of several blocks, repeated and null ids, a column whose name clashes."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(8)
    rows = [(i, [float(x) for x in base + rng.standard_normal(8) * (0.03 if i % 5 else 2.0)], 1, i) for i in range(150)]
    rows += [(3, [float(x) for x in base], 1, 0), (None, [float(x) for x in -base], 1, 0), (None, [float(x) for x in -2 * base], 1, 1)]
    units = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for _, v, _, _ in rows]
    links = [sum(a @ b >= 0.93 for b in units) - 1 for a in units]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key int").repartition(3)
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links) for r in embedding_dedup.near_duplicate_vectors(vectors).collect())
    assert got == sorted((-1 if r[0] is None else r[0], n) for r, n in zip(rows, links))


def test_recall_of_bag_minhash(spark):
    """No link of brute force is missed among all documents of a table."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in bag_minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_components(rows)


def test_null_ids_are_one_document(spark):
    """Rows without an id stand for one document, however many there are."""
    rows = [(None, f"own{i} " * 3 + "the same passage of words again " * 20) for i in range(30)] + [(7, "other words")]
    for made in (substring_suffix.dedup_substrings(frame(spark, rows)), substring_automaton.remove_passages(frame(spark, rows))):
        assert made.count() == 31 and made.filter("doc_id = 7").first().n_removed == 0


def test_digest_of_query(spark):
    rows = substring_suffix.op2_suffix_dedup(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    r = rows.filter("n_removed = 0").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(f"doc_id = {r.doc_id}").first().text
    assert r.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


def family(n, own, changed, step):
    """Texts over one template that resemble each other below 0.8; every step-th has a twin above it."""
    template = " ".join(f"template{i}" for i in range(180))
    words = lambda i, k: " ".join(f"own{i}x{j}" for j in range(k))
    rows = [(i, f"{template} {words(i, own)}") for i in range(n)]
    return rows + [(100_000 + i, f"{template} {words(i, own - changed)} {words(100_000 + i, changed)}") for i in range(5, n, step)]


def test_template_family(spark):
    got = {r.doc_id: r.component_id for r in bag_minhash.near_duplicates(frame(spark, family(400, 24, 22, 20))).collect()}
    assert got == {d: d % 100_000 for d in got} and len(got) == 420


def test_blocks_of_a_band(spark, monkeypatch):
    monkeypatch.setattr(bag_minhash, "BLOCK", 32)
    rows = family(90, 24, 22, 10)
    got = {r.doc_id: r.component_id for r in bag_minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_components(rows)


@pytest.mark.parametrize("most", [substring_automaton.ONE_POINT, 3])
def test_names_of_one_or_two_points(monkeypatch, most):
    """Passages are the same whatever the width of names; two points are never found out of place."""
    rng = random.Random(7)
    strings = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))).encode() for _ in range(40)]
    texts, points = substring_automaton._symbols(strings, most)
    assert points == (1 if most > 8 else 2) and [len(t) for t in texts] == [points * len(s.split()) for s in strings]
    plan = R.Plan(4, 2, "word", "any")
    monkeypatch.setattr(substring_automaton, "_symbols", lambda own, f=substring_automaton._symbols: f(own, most))
    windows = np.array([max(0, len(s.split()) - 3) for s in strings])
    numbers, heads = substring_automaton.classes_by_automaton(plan, strings, windows, np.ones(len(strings), np.int64))
    own = [tuple(s.split()[k : k + 4]) for s in strings for k in range(len(s.split()) - 3)]
    counts = {}
    for w in own:
        counts[w] = counts.get(w, 0) + 1
    assert sorted(set(numbers.tolist())) == [k for k, w in enumerate(own) if counts[w] > 1]
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(numbers)]):
        assert len({own[k] for k in numbers[a:b].tolist()}) == 1


def test_more_words_than_code_points():
    """Above the number of code points words have two: a million and a half different words in one comparison."""
    words = [b"w%d" % k for k in range(1_500_000)]
    texts, points = substring_automaton._symbols([b" ".join(words), b" ".join(words[:50])])
    assert points == 2 and texts[0].startswith(texts[1]) and len(set(texts[0][k : k + 2] for k in range(0, len(texts[0]), 2))) == len(words)
