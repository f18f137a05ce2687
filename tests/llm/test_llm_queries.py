from pathlib import Path

import pytest

from signalpanel.llm import contamination as C
from signalpanel.llm import queries as Q
from signalpanel.llm import templates as T

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_runs(spark, name):
    df = Q.QUERIES[name](spark, str(DATA))
    assert df.columns and df.count() > 0


def test_what_any_packing_must_fulfil(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pack_budgets"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    q = c.execute(Q.ORACLES["p6_invariants"])
    names = [d[0] for d in q.description]
    rows = Q.p6_invariants(spark, str(DATA))
    assert sorted(names) == sorted(rows.columns)
    assert sorted(tuple(r) for r in rows.select(*names).collect()) == sorted(q.fetchall())


def test_words_counted_are_those_of_the_tables(spark):
    from signalpanel.llm.packing import count_tokens

    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("n_tokens is not null and text is not null")
    assert docs.where(count_tokens(docs.text) != docs.n_tokens).count() == 0


def test_no_leak_is_lost(spark):
    """Every document of the smallest table aligned with every item, without any choice of candidates."""
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet").collect() for t in ("documents", "eval_items"))
    reader = T.Reader()
    words = lambda t: [reader.folded[x] for x, c in zip(w.raw, w.code) if c] if (w := reader.read([t])) else []
    own = {r.item_id: words(r.text) for r in items}
    want = set()
    for r in docs:
        d = words(r.text)
        known = set(d)
        # an item of which fewer than two fifths of the words occur at all can't be held
        want |= {(r.doc_id, i) for i, w in own.items() if sum(x in known for x in w) >= 0.4 * len(w) and C.align(w, d, C.least_stretch(len(w)))[0] >= 0.4 * len(w)}
    assert want and {tuple(r) for r in Q.p7_found(spark, str(DATA)).collect()} == want
