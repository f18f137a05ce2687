"""Text features: ASCII tokens, n-grams, dictionary tone, vocabulary and TF-IDF."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z][A-Za-z\-']*"


def tokens(text: Column | str) -> Column:
    """All ASCII matches of the token pattern, in lower case after matching; an empty array for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def ngrams(toks: Column, low: int, high: int) -> Column:
    """Space-joined n-grams for low..high, shorter ones first. ``toks`` should be a column, not an expression: lambdas evaluate it anew."""
    one = lambda n: toks if n == 1 else F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.array_join(F.slice(toks, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[one(n) for n in range(low, high + 1)])


def dictionary_tone(blocks: DataFrame, keys: list[str], text: str, dictionary: DataFrame) -> DataFrame:
    """Hits and share of words by category for each block of text: keys, category, n_words, hits, share (denominator 1 if empty).

    dictionary(category, term) is a word list; it is broadcast when the optimizer sees that it is small. Every category appears for every block.
    """
    toks = blocks.select(*keys, tokens(text).alias("_t")).withColumn("n_words", F.size("_t"))
    terms = dictionary.select("category", F.lower(F.trim("term")).alias("term")).where("term <> ''").distinct()
    counts = toks.select(*keys, F.explode("_t").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("c"))
    hits = counts.join(terms, "term").groupBy(*keys, "category").agg(F.sum("c").alias("hits"))
    every = toks.select(*keys, "n_words").join(F.broadcast(terms.select("category").distinct()), how="cross")
    out = every.join(hits, [*keys, "category"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.withColumn("share", F.col("hits") / F.greatest(F.col("n_words"), F.lit(1)))


def vocabulary(docs: DataFrame, scope: list[str], text: str, low: int, high: int, min_df: int, max_df: float, max_features: int) -> DataFrame:
    """scope, term, df, tf, n_docs, term_index: terms in at least ``min_df`` documents and at most a fraction ``max_df`` of them.

    The ``max_features`` most frequent are kept (ties by term), then numbered alphabetically. n_docs counts empty texts too. Documents
    are counted by partial aggregation; only one row per distinct term meets the top-k window.
    """
    toks = docs.select(*scope, "doc_id", tokens(text).alias("_t"))
    grams = toks.select(*scope, "doc_id", F.explode(ngrams(F.col("_t"), low, high)).alias("term")).groupBy(*scope, "doc_id", "term").agg(F.count("*").alias("c"))
    stats = grams.groupBy(*scope, "term").agg(F.count("*").alias("df"), F.sum("c").alias("tf"))
    return _most_frequent(stats, docs, scope, min_df, max_df, max_features)


def _most_frequent(stats: DataFrame, docs: DataFrame, scope: list[str], min_df: int, max_df: float, max_features: int) -> DataFrame:
    n = docs.groupBy(*scope).agg(F.countDistinct("doc_id").alias("n_docs"))
    kept = stats.join(F.broadcast(n), scope).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n_docs")))
    w = Window.partitionBy(*scope)
    top = kept.withColumn("_r", F.row_number().over(w.orderBy(F.desc("tf"), "term"))).where(F.col("_r") <= max_features).drop("_r")
    return top.withColumn("term_index", F.row_number().over(w.orderBy("term")) - 1)


def tfidf(docs: DataFrame, scope: list[str], text: str, vocab: DataFrame, low: int, high: int) -> DataFrame:
    """scope, doc_id, term, term_index, value: sublinear tf, smooth idf ln((1+n)/(1+df))+1, L2 norm. Empty documents have no rows."""
    toks = docs.select(*scope, "doc_id", tokens(text).alias("_t"))
    grams = toks.select(*scope, "doc_id", F.explode(ngrams(F.col("_t"), low, high)).alias("term")).groupBy(*scope, "doc_id", "term").agg(F.count("*").alias("c"))
    raw = (1 + F.log("c")) * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)
    v = grams.join(vocab.drop("tf"), [*scope, "term"]).withColumn("_v", raw)
    norm = F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(Window.partitionBy(*scope, "doc_id")))
    return v.select(*scope, "doc_id", "term", "term_index", (F.col("_v") / norm).alias("value"))


class _Grams(NamedTuple):
    """n-grams of whole documents. terms: the distinct ones; rows: a row for each (scope, doc_id), with ``of`` for its scope's first row;
    row, term, count: entries, sorted by row."""

    terms: list[str]
    rows: pd.DataFrame
    row: np.ndarray
    term: np.ndarray
    count: np.ndarray


def _count_grams(pdf: pd.DataFrame, scope: list[str], low: int, high: int) -> _Grams:
    """Each distinct text is read once; texts of one (scope, doc_id) are counted together, n-grams don't cross from one to the next."""
    of_text, texts = pd.factorize(pdf["text"].fillna(""))
    find, known, ids, sizes = re.compile(TOKEN).findall, {}, [], []
    for text in texts:
        found = find(text)
        ids.extend([known.setdefault(w, len(known)) for w in " ".join(found).lower().split(" ")] if found else [])
        sizes.append(len(found))
    words, doc = list(known), np.repeat(np.arange(len(texts)), sizes)
    one = last = np.array(ids, dtype=np.int64)
    names, terms, gram, owner = words, [], [], []
    for n in range(1, high + 1):
        if n > 1:  # an n-gram is an (n-1)-gram and the word that follows it in the same text
            same = doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :]
            pair, back = np.unique((last[: len(same)] * max(1, len(words)) + one[n - 1 :])[same], return_inverse=True)
            names = [f"{names[p // len(words)]} {words[p % len(words)]}" for p in pair.tolist()]
            last = np.full(len(same), -1)
            last[same] = back
        if n >= low:
            whole = last >= 0
            gram.append(last[whole] + len(terms))
            owner.append(doc[: len(last)][whole])
            terms.extend(names)
    width = max(1, len(terms))
    cell, count = np.unique(np.concatenate(owner) * width + np.concatenate(gram), return_counts=True)
    begin = np.searchsorted(cell, np.arange(len(texts) + 1) * width)
    n = np.diff(begin)[of_text]
    at = np.arange(n.sum()) + np.repeat(begin[of_text] - (np.cumsum(n) - n), n)
    row, term, count = np.repeat(np.arange(len(pdf)), n), cell[at] % width, count[at]
    keys = [*scope, "doc_id"]
    rows = pdf.groupby(keys, sort=False, dropna=False).agg(fit=("fit", "max")).reset_index()
    if len(rows) < len(pdf):
        group = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        cell, back = np.unique(group[row] * width + term, return_inverse=True)
        row, term, count = cell // width, cell % width, np.bincount(back, count).astype(np.int64)
    return _Grams(terms, rows.assign(of=rows.groupby(scope, sort=False, dropna=False).ngroup()), row, term, count)


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Batches sorted by doc_id, cut anew between documents after some 3,000 rows."""
    rest = None
    for batch in (b.slice(at, 3_000) for b in batches for at in range(0, b.num_rows, 3_000)):
        pdf = batch.to_pandas(integer_object_nulls=True)
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        codes = pd.factorize(pdf["doc_id"], use_na_sentinel=False)[0]
        cut = int(np.argmax(codes == codes[-1])) if len(codes) else 0
        rest = pdf.iloc[cut:]
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def tfidf_rows(docs: DataFrame, scope: list[str], text: str, low: int, high: int, min_df: int, max_df: float, max_features: int, fit: str = "true", then: tuple[Callable, str] | None = None) -> DataFrame:
    """scope, doc_id, fit, t ARRAY<INT>, v ARRAY<DOUBLE>: ``tfidf`` of all documents over the ``vocabulary`` of those with ``fit``, a row for each document with terms.

    Only texts are shuffled, never n-grams: a document's are counted in numpy where it lies, first to find the vocabularies, then to
    look them up in these, which are broadcast (at most ``max_features`` terms a scope). A document of several rows has the n-grams of all,
    and ``fit`` if one of them has. ``then`` is a function of iterators of Arrow batches that takes these rows on in the same task, with the columns
    that it gives. Runs a job when called.
    """
    use = docs.select(*scope, "doc_id", F.coalesce(F.expr(fit), F.lit(False)).alias("fit"), F.col(text).alias("text"))
    lie = lambda df: df.repartition("doc_id").sortWithinPartitions("doc_id", *scope)
    kinds = {k: use.schema[k].dataType.simpleString() for k in [*scope, "doc_id"]}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        for pdf in _whole_documents(chain([first], batches)):
            g = _count_grams(pdf, scope, low, high)
            of = g.rows["of"].to_numpy()[g.row]
            for k, (_, head) in enumerate(g.rows.drop_duplicates("of").iterrows()):
                own = of == k
                df, tf = np.bincount(g.term[own], minlength=len(g.terms)), np.bincount(g.term[own], g.count[own], minlength=len(g.terms)).astype(np.int64)
                have = np.flatnonzero(df)
                for at in range(0, len(have), 10_000):
                    x = have[at : at + 10_000]
                    keys = [pa.array([head[c]] * len(x), first.schema.field(c).type, from_pandas=True) for c in scope]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array([g.terms[i] for i in x], pa.string()), pa.array(df[x]), pa.array(tf[x])], [*scope, "term", "df", "tf"])

    train = use.where("fit")
    parts = lie(train).mapInArrow(counted, ", ".join(f"{k} {kinds[k]}" for k in scope) + ", term string, df long, tf long")
    stats = parts.groupBy(*scope, "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    top = _most_frequent(stats, train, scope, min_df, max_df, max_features)
    top = top.select(*scope, "term", "term_index", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf")).toArrow().sort_by("term_index")
    of = top.select(scope).to_pandas().groupby(scope, sort=False, dropna=False).ngroup().to_numpy()
    each = [top.filter(pa.array(of == k)) for k in range(of.max(initial=-1) + 1)]
    # a scope's terms lie in the order of their numbers
    held = docs.sparkSession.sparkContext.broadcast({tuple(p.select(scope).slice(0, 1).to_pylist()[0].values()): (p["term"].combine_chunks(), p["idf"].to_numpy()) for p in each})

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        vocab = {k: ({w: i for i, w in enumerate(terms.to_pylist())}, idf) for k, (terms, idf) in held.value.items()}
        for pdf in _whole_documents(chain([first], batches)):
            g = _count_grams(pdf, scope, low, high)
            of = g.rows["of"].to_numpy()
            for k, (_, head) in enumerate(g.rows.drop_duplicates("of").iterrows()):
                index, idf = vocab.get(tuple(head[c] for c in scope), ({}, np.zeros(0)))
                column = np.array([index.get(w, -1) for w in g.terms], dtype=np.int32)
                mine = np.flatnonzero(of == k)
                x = np.flatnonzero((of[g.row] == k) & (column[g.term] >= 0))
                t = column[g.term[x]]
                v = (1 + np.log(g.count[x])) * idf[t]
                norm = np.sqrt(np.bincount(g.row[x], v * v, minlength=len(g.rows)))
                v /= norm[g.row[x]]
                n = np.bincount(g.row[x], minlength=len(g.rows))
                mine = mine[n[mine] > 0]
                offsets = pa.array(np.concatenate([[0], np.cumsum(n[mine])]), pa.int32())
                rows = g.rows.iloc[mine]
                cols = [pa.array(rows[c], first.schema.field(c).type, from_pandas=True) for c in [*scope, "doc_id", "fit"]]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(offsets, pa.array(t)), pa.ListArray.from_arrays(offsets, pa.array(v))], [*scope, "doc_id", "fit", "t", "v"])

    own = lambda batches: looked_up(batches) if then is None else then[0](looked_up(batches))
    return lie(use).mapInArrow(own, ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", fit boolean, t array<int>, v array<double>" if then is None else then[1])
