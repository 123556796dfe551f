import gzip
import json
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from chronolake.llm import html_extraction, merges, packing, quality_rules, sentencepiece_backend, token_counts, warc
from chronolake.llm import regions as R

from . import brute
from .conftest import CLASHING

DATA = "/root/testdata/sf0.001"
ALPHABET = [*"abS1 2'!.,\n\t  ", "'s", "'re", "'ll", "n't", "é", "中", "٣", " ", "<|endoftext|>", "😀", "́", "\r\n", "_", "\x00", "▁", "<s>", "<0x0A>", " the"]


def mixed(n=1500, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_token_counts(small):
    path = public_tokenizers.path(token_counts.TOKENIZER)
    texts = mixed() + [t or "" for _, t in small]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    data, offsets = R.texts_of(pa.array(texts))
    assert token_counts.CountTransducer(path).count(data, offsets).tolist() == want


def test_merge_transducer():
    """Counts of pretokens are the library's, for words, runs and any bytes, also where transitions are let go."""
    path = public_tokenizers.path(token_counts.TOKENIZER)
    machine, model = merges.MergeTransducer(path), Tokenizer.from_file(path).model
    letter = {b: c for c, b in merges.byte_alphabet().items()}
    rng = random.Random(8)
    spans = [bytes(rng.choice(b"aAb eintsh \xe9\xc3\xa4\xb8\xad-=_*.") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    spans += [bytes([c]) * n for c in b" -=_*a0.\n" for n in range(1, 150)] + [bytes(rng.randrange(256) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    want = [len(model.tokenize("".join(letter[b] for b in s))) for s in spans]
    assert [machine.count(s) for s in spans] == want
    assert [len(machine.merged(s)) for s in spans[:300]] == want[:300]
    merges.MOST, kept = 500, merges.MOST
    try:
        assert [machine.count(s) for s in spans[:2000]] == want[:2000] and len(machine.steps) < 1000
    finally:
        merges.MOST = kept


def test_merges_out_of_order(tmp_path):
    """Where a merge needs a token that a later one makes, the merge process itself decides what fits."""
    letter = {b: c for c, b in merges.byte_alphabet().items()}
    vocab = [letter[b] for b in range(256)] + ["abc", "bc", "ab", "cd"]
    model = {"type": "BPE", "vocab": {t: k for k, t in enumerate(vocab)}, "merges": [["a", "bc"], ["b", "c"], ["a", "b"], ["c", "d"]]}
    (tmp_path / "t.json").write_text(json.dumps({"version": "1.0", "added_tokens": [], "model": model}))
    machine, own = merges.MergeTransducer(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json")).model
    rng = random.Random(2)
    for _ in range(2000):
        s = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12)))
        assert machine.count(s.encode()) == len(own.tokenize(s))


def test_count_tokens_edges(spark, edge_rows):
    path = public_tokenizers.path(token_counts.TOKENIZER)
    rows = [*edge_rows, (8, "tail " * 60_000 + "<|endoftext|>", 7, "k", None, "b", 2, 9, 1, None, None, 3, 4)]
    docs = spark.createDataFrame(rows, CLASHING)
    got = token_counts.count_tokens(docs, path).collect()
    want = [len(Tokenizer.from_file(path).encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    assert [(r.n_tokens, r.over_limit) for r in got] == [(n, n > 512) for n in want] and {r.own for r in got} == {3}
    assert [r.n_bytes for r in got] == [len((r[1] or "").encode()) for r in rows]
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_sentencepiece_parity_of_whole_texts(small):
    path = public_tokenizers.path(sentencepiece_backend.MODEL)
    texts = mixed(seed=4) + [t or "" for _, t in small]
    codec = sentencepiece_backend.Codec(path)
    data, offsets = R.texts_of(pa.array(texts))
    ids, at, wrong = codec.encode(data, offsets)
    got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    assert got == own.encode(texts) and not wrong.any()
    assert codec.decode(got) == own.decode(got)


def test_sentencepiece_round_trip(spark, edge_rows):
    path = public_tokenizers.path(sentencepiece_backend.MODEL)
    docs = spark.createDataFrame(edge_rows, CLASHING)
    rows = sentencepiece_backend.decode(sentencepiece_backend.encode(docs, path), path).collect()
    assert [r.decoded for r in rows] == [r.text or "" for r in rows] and all(r.parity for r in rows)
    assert sentencepiece_backend.encode(docs.limit(0), path).count() == 0


def test_unigram_model_is_rebuilt():
    def field(number, kind, value):
        return bytes([number << 3 | kind]) + (bytes([len(value)]) + value if kind == 2 else value)

    def piece(text, score, kind):
        return field(1, 2, field(1, 2, text.encode()) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind])))

    raw = piece("<unk>", 0, 2) + b"".join(piece(t, s, 1) for t, s in (("▁a", -1), ("b", -2), ("▁ab", -2.5), ("▁", -4), ("a", -4)))
    raw += field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00"))
    model = sentencepiece_backend.Model(raw)
    assert model.type == sentencepiece_backend.UNIGRAM and model.tokenizer().encode(" ab b").tokens == ["▁ab", "▁", "b"]


@pytest.mark.parametrize("local_items", [20_000, 15])
def test_packing(spark, small, local_items):
    path = public_tokenizers.path(packing.TOKENIZER)
    docs = spark.createDataFrame(small, "doc_id long, text string").repartition(3)
    rows = packing.pack_pieces(packing.token_pieces(docs, path), local_items=local_items).collect()
    encoded = Tokenizer.from_file(path).encode_batch_fast([t or "" for _, t in small], add_special_tokens=False)
    want = set()
    for (d, _), e in zip(small, encoded):
        ids = np.array([*e.ids, 0], "<u4")
        want |= {(d, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + (2 if local_items > 100 else 8)


def test_packing_edges(spark, edge_rows):
    docs = spark.createDataFrame(edge_rows, CLASHING)
    path = public_tokenizers.path(packing.TOKENIZER)
    assert packing.pack_documents(docs, path).count() == 6
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_one_bin_is_half_empty():
    """What bounds the bins that are handed on: best-fit leaves one bin at most that is filled by half or less,
    so no more hosts are needed than parts meet, and fewer bins handed on give as few sequences."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        lengths = rng.integers(1, rng.integers(2, 101), rng.integers(1, 400))
        bins, _ = packing.best_fit(lengths, 100)
        assert (2 * np.bincount(bins, lengths) <= 100).sum() <= 1


@pytest.mark.parametrize("lengths", [[60] * 300 + [30] * 100, [51] * 200 + [40] * 30 + [9] * 150])
def test_bins_handed_on(spark, monkeypatch, lengths):
    pieces = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(2)
    monkeypatch.setattr(packing, "NEARLY", 1)
    found = []
    for most in (packing.FAN_IN, 10**6):
        monkeypatch.setattr(packing, "HANDED_ON", most)
        found.append(packing.pack_pieces(pieces, 100, 20).select("sequence_id").distinct().count())
    assert found[0] <= found[1]


def test_best_fit():
    bins, offsets = packing.best_fit(np.array([6, 5, 4, 5, 10, 1]), 10)
    fill = np.bincount(bins, [6, 5, 4, 5, 10, 1])
    assert sorted(fill.tolist()) == [1, 10, 10, 10] and offsets.max() <= 9


def test_quality(spark, small, edge_rows):
    docs = spark.createDataFrame(small, "doc_id long, text string")
    got = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    assert got == {d for d, t in small if brute.quality_kept(t, set(quality_rules.STOP_WORDS))}
    rows = quality_rules.quality(spark.createDataFrame(edge_rows, CLASHING))
    assert rows.count() == 6 and rows.filter("quality.n_words is null or quality.kept is null").count() == 0
    assert quality_rules.quality(docs.limit(0)).count() == 0
    r = quality_rules.quality(spark.createDataFrame([(1, "a b c d e a b c d e\nx")], "doc_id long, text string")).first().quality
    assert (r.n_words, r.n_repeat_words, r.base_failed) == (11, 10, True)


def test_warc(spark, tmp_path):
    rows = [(4, "http://a/ b\n", "same"), (2, "http://b", "same"), (9, None, None), (7, "u", ""), (None, "n", "null id"), (5, "é", "<p>é😀</p>" * 500), (2, "http://b2", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folders = [f"file://{tmp_path}/{k}" for k in "ab"]
    manifests = [warc.write_archives(pages, f, 3, roll_bytes=300) for f in folders]
    assert sorted(manifests[0].collect()) == sorted(manifests[1].collect()) and manifests[0].count() > 3
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(manifests[0], folders[0]).collect()}
    assert got == {(4, "revisit", 2, 4), (2, "response", None, 4), (9, "revisit", 7, 0), (7, "response", None, 0), (None, "response", None, 7), (5, "response", None, 13 * 0 + len(("<p>é😀</p>" * 500).encode()))}
    payloads = {r.page_id: r.payload for r in warc.read_archives(manifests[0], folders[0]).filter("payload is not null").collect()}
    assert bytes(payloads[5]).decode() == "<p>é😀</p>" * 500
    assert warc.write_archives(pages.limit(0), f"file://{tmp_path}/c", 2).count() == 0


def test_warc_is_deterministic(spark, tmp_path):
    """Equal tables give equal files, however they are partitioned, and shards hold about as many rows."""
    rows = [(i * i % 100_003 if i else -(2**60), f"http://h/{i}", f"page {i % 700}") for i in range(6000)] + [(None, "n", "x")]
    found = []
    for k, parts in enumerate((3, 11)):
        pages = spark.createDataFrame(rows[:: 1 - 2 * k], "page_id long, url string, html string").repartition(parts)
        found.append(warc.write_archives(pages, f"file://{tmp_path}/{k}", 4).collect())
        assert sorted(f for f in os.listdir(f"{tmp_path}/{k}") if not f.startswith((".", "_"))) == sorted(["manifest", *(r.file for r in found[k])])
    assert sorted(map(tuple, found[0]), key=str) == sorted(map(tuple, found[1]), key=str)
    assert len(found[0]) == 4 and max(r.records for r in found[0]) < 2200
    assert warc.read_archives(spark.createDataFrame(found[0], warc.MANIFEST), f"file://{tmp_path}/0").count() == 6001


def test_warc_detects_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "some text", 5), (1, "u", "some text", 6)], "page_id long, url string, html string, digest int")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/a", 1)
    file = tmp_path / "a" / manifest.first().file
    raw = file.read_bytes()
    at = raw.rindex(b"\x1f\x8b")
    file.write_bytes(raw[:at] + gzip.compress(gzip.decompress(raw[at:]).replace(b"some text", b"same text")))
    with pytest.raises(Exception, match="wrong digest"):
        warc.read_archives(manifest, f"file://{tmp_path}/a").collect()


@pytest.mark.parametrize("keys", [[], [7], [5] * 900 + [6], [*range(3000)], [-(2**63), *range(1000), 2**63 - 1]])
def test_shard_bounds(spark, keys):
    bounds = warc.shard_bounds(spark.createDataFrame([(k,) for k in keys], "key long"), 5)
    assert bounds == sorted(bounds) and len(bounds) < 5
    if len(set(keys)) > 900:
        held = np.bincount(np.searchsorted(bounds, keys, "right"), minlength=5)
        assert held.max() <= 1.3 * len(keys) / 5


CASES = [
    (None, ""),
    ("", ""),
    ("<p>plain", "plain"),
    ("<nav>menu</nav><article><h1>T &amp; &eacute;</h1><p>a\n b<br>c<p><b>d</article><footer>f</footer>", "T & é\n\na b c\n\nd"),
    ("<div class='sidebar'>s</div><main><p>x</p><aside>no</aside><form>f<p>g</form><div id=comments><p>c</div>y</main>", "x\n\ny"),
    ("<article><script>var a='</p>';</script><style>p{}</style>ok<!-- <p>no</p> --> go</article>", "ok go"),
    ("<article>1 < 2 &lt;b&gt; &#65;&nbsp;&nbsp;z<span> q</span></article>", "1 < 2 <b> A z q"),
    ("<article><p>a<nav><p>n</nav>b</article><p>outside", "a\n\nb"),
    ("<article>Body</article><article class='comment'>Nice post!</article><article class='promo box'>Buy</article>", "Body"),
    ("<article class='post no-comments'><p>a</p><div class='related-work'>b</div><div class='related-posts'>c</div><p class='ad-slot'>d</p></article>", "a\n\nb"),
    ("<main class='has-sidebar'>a<ul><li>b<li>c</ul></main>", "a\n\nb\n\nc"),
    ("<div class='layout has-sidebar'><nav>n</nav><article><p>Body</p></article><div class='has-sidebar'>x</div></div>", "Body"),
    ("<form id='aspnetForm'><input><article><p>Body</p></article><p>Name</p></form>", "Body"),
    ("<article><section id='ad-hoc-queries'><p>Body</p></section><div class='ad-slot'>x</div></article>", "Body"),
    ("<div id='comments'><article><p>nice</p></article></div><aside><article>teaser</article></aside><p>text", "text"),
    ("<form><div>All of the page</div><p>is in a form</p></form><p>short", "All of the page\n\nis in a form\n\nshort"),
    ("<p>long text of the page</p><form><p>Name</p></form>", "long text of the page"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_page_cases(spark, page, text):
    rows = html_extraction.extract(spark.createDataFrame([(1, "http://h/x", page)], "page_id long, url string, html string")).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in rows] == [(1, text, len(text))]


def test_page_edges(spark):
    """Repeated and null ids, columns that clash with the operator's, a very long page."""
    long = "<p>" + " ".join(f"word{i}" for i in range(60_000)) + "</p>"
    rows = [(1, "http://h/", "<article>a</article>", 1, "x"), (1, "http://h/", "<article>b</article>", 2, "x"), (None, None, "<article>c</article>", 3, None), (None, "no url", "<p>own</p>", 4, None), (2, "//h", long, 5, "y"), (3, "http://h", None, 6, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key int, text string")
    got = html_extraction.extract(pages).collect()
    assert sorted(((r.page_id or 0), r.text) for r in got) == [(0, "c"), (0, "own"), (1, "a"), (1, "b"), (2, long[3:-4]), (3, "")]
    assert all(r.n_chars == len(r.text) for r in got)


def test_pages_without_article_equal_brute_force(spark):
    """What 48 bytes or more of share with other pages of the host decides, as counted in plain Python."""
    rng = random.Random(4)
    shared = [" ".join(f"s{k}x{rng.randrange(10**6)}" for _ in range(12)) for k in range(6)]
    rows = []
    for i in range(60):
        blocks = [rng.choice(shared) if rng.random() < 0.4 else " ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.randint(3, 20))) for _ in range(6)]
        if i % 7 == 0:
            blocks.append(shared[i % 6][:60].strip() + " " + " ".join(f"t{rng.randrange(10**6)}" for _ in range(rng.choice((3, 25)))))
        rows.append((i, f"http://h{i % 3}/", blocks))
    whole = " ".join(f"w{k}x{rng.randrange(10**6)}" for k in range(12))
    rows += [(100, "http://h9/", [whole, whole[:60].strip() + " own tail"]), (101, "http://h9/", [whole])]
    pages = spark.createDataFrame([(i, u, "".join(f"<div>{b}</div>" for b in bs)) for i, u, bs in rows], "page_id long, url string, html string").repartition(4)
    holders = {}
    for i, u, bs in rows:
        t = " ".join(bs)
        for k in range(len(t) - html_extraction.RUN + 1):
            holders.setdefault((u, t[k : k + html_extraction.RUN]), set()).add(i)
    want = {}
    for i, u, bs in rows:
        t, at, own = " ".join(bs), 0, []
        mask = [False] * len(t)
        for k in range(len(t) - html_extraction.RUN + 1):
            if len(holders[u, t[k : k + html_extraction.RUN]]) > 1:
                mask[k : k + html_extraction.RUN] = [True] * html_extraction.RUN
        for b in bs:
            own += [b] if 2 * sum(mask[at : at + len(b)]) < len(b) else []
            at += len(b) + 1
        want[i] = "\n\n".join(own)
    assert {r.page_id: r.text for r in html_extraction.extract(pages).collect()} == want


def test_copies_on_a_host_keep_their_text(spark):
    """Pages without an article that hold the same count as one; what others have too is boilerplate for all of them."""
    bar, story = "<div>Home of the daily news and more, all rights reserved by this site</div>", "a story that two pages of a host have in the very same words " * 2
    rows = [(1, "http://h/1", f"{bar}<p>{story}</p>"), (2, "http://h/2", f"{bar}<p>{story}</p>"), (3, "http://h/3", f"{bar}<p>another page</p>"), (4, "http://g/", f"<p>{story}</p>"), (5, "http://g/", f"<p>{story}</p><article>own</article>")]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {1: story.strip(), 2: story.strip(), 3: "another page", 4: story.strip(), 5: "own"}


def test_host_boilerplate(spark):
    bar = "<div>Home of the daily news and more, all rights reserved by the publisher of this site</div>"
    rows = [(i, f"http://Site.example:80/{i}", f"<body>{bar}<div>own story number {i} with its own words {i * 7919}</div></body>") for i in range(6)]
    rows += [(10, "http://other.example/", f"<body>{bar}</body>"), (11, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    assert all(got[i] == f"own story number {i} with its own words {i * 7919}" for i in range(6))
    assert got[10].startswith("Home of") and got[11] == ""
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_unsure_blocks_of_articles_are_decided_by_the_host(spark):
    """In articles a name with a word of noise among others says little: what other pages of the host have too goes."""
    ask = "Subscribe to our letter and follow the authors of this site for more of it"
    page = lambda i, more="": f"<article><p>story {i} before</p><div class='inline-newsletter-ask'>{ask}</div><p>story {i} after</p>{more}</article>"
    rows = [(i, "http://h/", page(i, f"<section id='ad-hoc-queries'>{' '.join(f'w{i}x{k * 7919 % 104729}' for k in range(i + 1, i + 9))}</section>")) for i in range(4)]
    rows += [(10, "http://g/", page(10)), (11, "http://g/", "<p>bare</p>"), (12, "http://h/", f"<article><div class='inline-newsletter-ask'>{ask}</div></article>")]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    want = {i: f"story {i} before\n\nstory {i} after\n\n{' '.join(f'w{i}x{k * 7919 % 104729}' for k in range(i + 1, i + 9))}" for i in range(4)}
    assert got == want | {10: f"story 10 before\n\n{ask}\n\nstory 10 after", 11: "bare", 12: ask}


def test_suffix_array_takes_pages_with_articles(spark, monkeypatch):
    seen = []
    whole = html_extraction.R.repeated_ranges
    monkeypatch.setattr(html_extraction.R, "repeated_ranges", lambda docs, *rest: seen.append(docs.count()) or whole(docs, *rest))
    rows = [(i, "http://h/", f"<nav>menu {i}</nav><article>body {i}</article>") for i in range(3)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"body {i}" for i in range(3)} and seen == [3]
