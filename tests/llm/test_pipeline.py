import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from chronolake.llm import quality_rules

from . import brute


def test_run_equals_plain_python(spark, small, tmp_path):
    rows = [(d, t, "en", "s", len(t or "")) for d, t in small]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = [(d, t) for d, t in small if brute.quality_kept(t, set(quality_rules.STOP_WORDS))]
    root = brute.near_components(docs)
    docs = [(d, t) for d, t in docs if root[d] == d]
    cover, left = brute.suffix_cover(docs, 100), {}
    for d, t in docs:
        at, out = 0, ""
        for c in t:
            n = len(c.encode())
            out += "" if all(cover[d][at : at + n]) else c
            at += n
        left[d] = out
    encoded = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch_fast(list(left.values()), add_special_tokens=False)
    want = {d: len(e.ids) + 1 for d, e in zip(left, encoded)}
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and len(got) > 50


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "suffix_dedup", "best_fit_packing"]
