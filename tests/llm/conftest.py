import pyarrow.parquet as pq
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    """(doc_id, text) of a small table, with cases added: null, empty, short, long, periodic and copied texts."""
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    rows = [r for r in rows if len(r[1]) < 4000][:120]
    passage = " ".join(f"passage{i} of" for i in range(40))
    long = " ".join(f"w{i * i % 9973}" for i in range(9000))
    near = " ".join(f"near{i}" for i in range(200))
    more = [None, "", " \n\t", "one two three", "a" * 450, "ab " * 200, f"start {passage} end", f"{passage}", f"other {passage} 😀é tail", long, near, near.replace("near77 ", "changed "), near, "x\x00y" * 60, "é中😀" * 40]
    return rows + [(10_000 + k, t) for k, t in enumerate(more)]


#: Columns whose names clash with those of the operators.
CLASHING = "doc_id long, text string, key long, kept string, n_words int, n_bytes string, row int, doc long, found int, ranges int, lang string, own int, quality int"


@pytest.fixture(scope="session")
def edge_rows():
    texts = ["plain words of the text", None, "", "plain words of the text", "z" * 300, "z" * 300]
    ids = [1, None, 3, 4, 5, 5]
    return [(i, t, 7, "k", None, "b", 2, 9, 1, None, None, 3, 4) for i, t in zip(ids, texts)]
