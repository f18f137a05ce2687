"""Truncated SVD against numpy: vectors of the fit rows only, more terms than a dense Gram matrix would allow for."""

from pathlib import Path

import numpy as np
import pytest

from signalpanel.operators import features as T
from signalpanel.operators import models as M
from signalpanel.plans import modelling


def test_fit_rows_and_sparse_terms(spark):
    rng = np.random.default_rng(3)
    x = rng.random((30, 40)) * (rng.random((30, 40)) < 0.4)
    rows = [("a", i, "train" if i < 20 else "test", j, float(x[i, j])) for i in range(30) for j in range(40) if x[i, j]]
    df = spark.createDataFrame(rows, "scope string, doc_id long, role string, t int, value double")
    got = M.truncated_svd(df, ["scope"], "doc_id", "t", "value", 4, "role = 'train'", 200, 1e-8).collect()
    v = np.linalg.svd(x[:20])[2][:4].T
    want = x @ (v * np.sign(v[np.argmax(np.abs(v), axis=0), range(4)]))
    m = np.zeros((30, 4))
    for r in got:
        m[r.doc_id, r.component] = r.score
    np.testing.assert_allclose(m, want, atol=1e-6)


def test_many_terms(spark):
    n = 30_000
    rows = [("a", i, j, 1.0) for i in range(12) for j in range(i * 2_500, min(n, i * 2_500 + 2_600 - 100 * (i == 11)))]
    df = spark.createDataFrame(rows, "scope string, doc_id long, t int, value double")
    got = M.truncated_svd(df, ["scope"], "doc_id", "t", "value", 64).collect()
    x = np.zeros((12, n))
    for _, i, j, v in rows:
        x[i, j] = v
    s = np.linalg.svd(x, compute_uv=False)[:11]
    sums = np.zeros(11)
    for r in got:
        sums[r.component] += r.score**2
    np.testing.assert_allclose(np.sqrt(sums), s, rtol=1e-3)


def test_rows_of_texts_are_those_of_tfidf(spark):
    """Nulls, empty texts, marks, letters that only lower to ASCII, a document of two rows and of two roles, words that only other splits train on."""
    texts = ["the cat's mat", "The CAT sat - on the mat's edge", "", None, "a", "the the the cat", "Kelvin straße cat it's", "on the mat", "rock-n-roll the cat sat", "... 12 !"]
    rows = [("a", "train" if i < 9 else "test", i, x) for i, x in enumerate(texts + texts[:6])] + [("b", "train" if i % 2 else "test", i, x) for i, x in enumerate(texts)]
    rows += [("a", "train", 1, "sat on the cat"), ("a", "test", 2, "the mat"), ("c", "test", 1, "the cat"), (None, "train", 1, "the cat"), (None, "train", 2, "the cat"), ("a", "train", 1, "sat on the cat")]
    df = spark.createDataFrame(rows, "split_id string, role string, doc_id long, text string")
    for low, high, least, most, limit in ((1, 2, 2, 0.95, 8), (1, 1, 1, 1.0, 100), (2, 3, 1, 1.0, 100)):
        vocab = T.vocabulary(df.where("role = 'train'"), ["split_id"], "text", low, high, least, most, limit)
        want = {(r.split_id, r.doc_id, r.term_index): r.value for r in T.tfidf(df.where("split_id is not null"), ["split_id"], "text", vocab, low, high).collect()}
        got = T.tfidf_rows(df, ["split_id"], "text", low, high, least, most, limit, "role = 'train'").where("split_id is not null").collect()
        assert len({(r.split_id, r.doc_id) for r in got}) == len(got)
        entries = {(r.split_id, r.doc_id, t): v for r in got for t, v in zip(r.t, r.v, strict=True)}
        assert want.keys() == entries.keys() and want
        np.testing.assert_allclose([entries[k] for k in want], list(want.values()), rtol=1e-12)
        train = {(r[0], r[2]) for r in rows if r[1] == "train"}
        assert all(r.fit == ((r.split_id, r.doc_id) in train) for r in got)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_query_shuffles_texts_only(spark):
    """n-grams of 100,000 documents took the query beyond its time: nothing but the texts is moved before the passes, and none is exploded."""
    plan = modelling.r15(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "explode(" not in plan.replace("posexplode(", "") and "Window" not in plan
