"""Queries of tokens, dictionaries and TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpanel.operators import features as T
from signalpanel.operators import panel as P
from signalpanel.plans.evaluate import _round
from signalpanel.session import table

#: A small word list with categories, in place of a licensed dictionary.
WORDS = {"uncertainty": "may might could risk depend exposed cannot assume believes", "litigation": "litigation agreement clause covenant covenants liability", "negative": "fell declined contracted shortages loss impaired deteriorate poorer delays"}


def dictionary(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(c, w) for c, ws in WORDS.items() for w in ws.split()], "category string, term string")


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", "source")


def f1_tokens(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.size(T.tokens("text")).alias("n_words"), F.md5(F.array_join(T.tokens("text"), " ")).alias("digest"))


def f2_bigrams(s: SparkSession, d: str) -> DataFrame:
    g = docs(s, d).select(T.tokens("text").alias("t")).select(F.explode(T.ngrams(F.col("t"), 1, 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return g


def f4_tone(s: SparkSession, d: str) -> DataFrame:
    return _round(T.dictionary_tone(docs(s, d), ["doc_id"], "text", dictionary(s)))


def _vocab(s: SparkSession, d: str) -> DataFrame:
    return T.vocabulary(docs(s, d).withColumn("scope", F.col("doc_id") % 2), ["scope"], "text", 1, 1, 3, 0.5, 300)


def a17_vocabulary(s: SparkSession, d: str) -> DataFrame:
    return _vocab(s, d)


def a18_tfidf(s: SparkSession, d: str) -> DataFrame:
    return _round(T.tfidf(docs(s, d).withColumn("scope", F.col("doc_id") % 2), ["scope"], "text", _vocab(s, d), 1, 1).drop("term_index"))


def r35_manifest(s: SparkSession, d: str) -> DataFrame:
    terms = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("term_index", "term"))), lambda x: x["term"]), ",")
    return _vocab(s, d).groupBy("scope").agg(F.count("*").alias("n_terms"), F.sha2(terms, 256).alias("digest"))


#: Reference's largest published vocabulary and decomposition: 1-2-grams in 5 documents at least and 95 % at most, 50,000 terms, 64 components.
GRAMS, FIT, COMPONENTS = (1, 2), (5, 0.95, 50_000), 64
_QUARTERS = ["2024-07-01", "2024-10-01", "2025-01-01", "2025-04-01", "2025-07-01"]


def split_docs(s: SparkSession, d: str) -> DataFrame:
    """Documents by split and role: expanding windows from 2024 on with a quarter each for validation and test, 20 days of embargo."""
    day = lambda x: F.lit(x).cast("date")
    windows = s.createDataFrame([(f"test_{b}", a, b, c) for a, b, c in zip(_QUARTERS, _QUARTERS[1:], _QUARTERS[2:])], "split_id string, v string, t string, e string").select(
        "split_id", day("2024-01-01").alias("train_start"), F.date_sub("v", 1).alias("train_end"), F.col("v").cast("date").alias("validation_start"),
        F.date_sub("t", 1).alias("validation_end"), F.col("t").cast("date").alias("test_start"), F.date_sub("e", 1).alias("test_end"),
    )
    dated = table(s, d, "documents").select("doc_id", "text", F.col("ingested_at").cast("date").alias("event_date"))
    dated = dated.withColumns({"window_start": F.date_add("event_date", 1), "window_end": F.date_add("event_date", 1)})
    return P.assign_splits(dated, windows, 20).where("status = 'pass'").select("split_id", "role", "doc_id", "text")


def split_vocab(s: SparkSession, d: str) -> DataFrame:
    """A vocabulary for each split, of its train documents alone."""
    return T.vocabulary(split_docs(s, d).where("role = 'train'"), ["split_id"], "text", *GRAMS, *FIT)


def split_tfidf(s: SparkSession, d: str) -> DataFrame:
    """TF-IDF of all documents of a split over its train vocabulary."""
    return T.tfidf(split_docs(s, d), ["split_id"], "text", split_vocab(s, d), *GRAMS)


def a18_split(s: SparkSession, d: str) -> DataFrame:
    return _round(split_tfidf(s, d).drop("term_index"))


def r35_split(s: SparkSession, d: str) -> DataFrame:
    terms = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("term_index", "term"))), lambda x: x["term"]), ",")
    return split_vocab(s, d).groupBy("split_id").agg(F.count("*").alias("n_terms"), F.sha2(terms, 256).alias("digest"))


def f24_hashes(s: SparkSession, d: str) -> DataFrame:
    payload = F.format_string('{"document": "%s", "source": "%s"}', F.col("doc_id").cast("string"), F.col("source"))
    return docs(s, d).select("doc_id", F.sha2("text", 256).alias("text_hash"), F.substring(F.sha2(payload, 256), 1, 16).alias("spec_id"))


_TOK = "toks as (select doc_id, [lower(x) for x in regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z\\-'']*')] t from documents)"
_DICT = "dict(category, term) as (values " + ", ".join(f"('{c}', '{w}')" for c, ws in WORDS.items() for w in ws.split()) + ")"
_VOC = f"""{_TOK}, g as (select doc_id % 2 scope, doc_id, term, count(*) c from (select doc_id, unnest(t) term from toks) group by all), n as (select doc_id % 2 scope, count(*) n_docs from documents group by 1),
st as (select scope, term, count(*) df, cast(sum(c) as bigint) tf from g group by 1, 2), k as (select st.*, n_docs, row_number() over (partition by scope order by tf desc, term) r from st join n using (scope) where df >= 3 and df <= 0.5 * n_docs),
voc as (select scope, term, df, tf, n_docs, row_number() over (partition by scope order by term) - 1 term_index from k where r <= 300)"""
_SPLITS = f"""{_TOK}, w(split_id, v, t, e) as (values {", ".join(f"('test_{b}', date '{a}', date '{b}', date '{c}')" for a, b, c in zip(_QUARTERS, _QUARTERS[1:], _QUARTERS[2:]))}),
dd as (select doc_id, cast(ingested_at as date) dt from documents), sd as (select split_id, doc_id, case when dt < v then 'train' when dt < t then 'validation' else 'test' end role from dd join w on dt >= date '2024-01-01' and dt < e and not (dt < t and dt + 1 >= case when dt < v then v else t end - 20)),
dg as (select doc_id, gram term, count(*) c from (select doc_id, unnest(t) gram from toks union all select doc_id, unnest([t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) from toks) group by all),
n as (select split_id, count(*) n_docs from sd where role = 'train' group by 1), st as (select split_id, term, count(*) df, cast(sum(c) as bigint) tf from dg join sd using (doc_id) where role = 'train' group by 1, 2),
k as (select st.*, n_docs, row_number() over (partition by split_id order by tf desc, term) r from st join n using (split_id) where df >= {FIT[0]} and df <= {FIT[1]} * n_docs),
voc as (select split_id, term, df, tf, n_docs, row_number() over (partition by split_id order by term) - 1 term_index from k where r <= {FIT[2]})"""
QUERIES = {
    "A17_split_vocabulary": split_vocab, "A18_R14_split_tfidf": a18_split, "R35_split_manifest": r35_split,
    "F1_F3_tokens": f1_tokens, "F2_ngrams": f2_bigrams, "F4_R12_dictionary_tone": f4_tone, "A17_vocabulary": a17_vocabulary, "A18_R14_tfidf": a18_tfidf, "R35_vocabulary_manifest": r35_manifest,
    "F24_hashes": f24_hashes,
}
ORACLES = {
    "A17_split_vocabulary": f"with {_SPLITS} select split_id, term, df, tf, n_docs, term_index from voc",
    "A18_R14_split_tfidf": f"with {_SPLITS}, z as (select split_id, doc_id, term, (1 + ln(c)) * (ln((1 + n_docs) / (1 + df)) + 1) v from sd join dg using (doc_id) join voc using (split_id, term)) select split_id, doc_id, term, round(v / sqrt(sum(v * v) over (partition by split_id, doc_id)), 6) \"value\" from z",
    "R35_split_manifest": f"with {_SPLITS} select split_id, count(*) n_terms, sha256(string_agg(term, ',' order by term_index)) digest from voc group by 1",
    "F1_F3_tokens": f"with {_TOK} select doc_id, cast(len(t) as int) n_words, md5(array_to_string(t, ' ')) digest from toks",
    "F2_ngrams": f"with {_TOK}, g as (select unnest(t) gram from toks union all select unnest([t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) from toks) select gram, count(*) n from g group by 1",
    "F4_R12_dictionary_tone": f"with {_TOK}, {_DICT} select doc_id, c.category, cast(len(t) as int) n_words, cast(len([x for x in t if x in c.terms]) as bigint) hits, round(len([x for x in t if x in c.terms]) / greatest(len(t), 1), 6) \"share\" from toks cross join (select category, list(term) terms from dict group by 1) c",
    "A17_vocabulary": f"with {_VOC} select scope, term, df, tf, n_docs, term_index from voc",
    "A18_R14_tfidf": f"with {_VOC}, v as (select scope, doc_id, term, (1 + ln(c)) * (ln((1 + n_docs) / (1 + df)) + 1) v from g join voc using (scope, term)) select scope, doc_id, term, round(v / sqrt(sum(v * v) over (partition by scope, doc_id)), 6) \"value\" from v",
    "R35_vocabulary_manifest": f"with {_VOC} select scope, count(*) n_terms, sha256(string_agg(term, ',' order by term_index)) digest from voc group by 1",
    "F24_hashes": """select doc_id, sha256(text) text_hash, substr(sha256('{"document": "' || doc_id || '", "source": "' || source || '"}'), 1, 16) spec_id from documents""",
}
