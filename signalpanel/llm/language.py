"""Languages of texts and of the stretches of mixed texts.

Script ranges narrow the candidates: Kana and the Han beside them are Japanese, Hangul Korean, Greek, Thai and Hebrew have one language each, Han without
Kana is Chinese, and words of scripts that many languages share are of unknown language, as none of those is modelled; Latin words are left to the others. A Viterbi
pass over per-word scores with a penalty for switching, smaller at the end of a sentence, then labels each Latin word, and runs of equal labels are spans.
Word scores are smoothed log probabilities counted over a bounded sample of the texts themselves, in two rounds: first by the labels as
received, many of them wrong, and by the function words below; then by the sentences' languages under the scores of the first round.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalpanel.llm.normal import clean, fold
from signalpanel.session import cut, even

#: Function words by which sentences of the sample are first assigned.
SEEDS = {
    "en": "the of and to in for our we is are with by may not that which was were be from",
    "de": "der die das und von für wir nicht mit auf zu den dem ein eine im des wurden sich durch",
    "fr": "le la les des et du une nous pour dans par sur au aux est qui ont été cette avec",
    "es": "el la los las de y en que una con por para hemos se del sin como más al esta",
    "pt": "o a os as de e em que uma com por para da do no na não dos das ao",
    "it": "il la le di e che una con per del della gli nel sono dei al abbiamo si alla lo",
    "nl": "de het een van en in op te voor met zijn wij niet dat aan door wordt werd om bij",
}
LATIN = tuple(SEEDS)
LANGS = (*LATIN, "ja")
#: Codes and English names by which a label may denote a language; regions are cut off before.
LABELS = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français", "es": "es spa spanish castilian español", "pt": "pt por portuguese português",
    "it": "it ita italian italiano", "nl": "nl nld dut dutch flemish nederlands", "ja": "ja jpn jp japanese",
}
#: Language without a name: a script that several languages share, or words without any evidence.
UNKNOWN = "und"
#: Parameters: texts in the sample for word counts (chosen by hash), smoothing, switching penalties in nats.
SAMPLE_TEXTS, SMOOTH, SWITCH, SWITCH_AT_END = 6_000, 0.5, 7.0, 2.5
#: A whole sentence: words, or Japanese characters, and the share of its known words that must be in the language.
MIN_WORDS, MIN_CHARS, SHARE = 6, 20, 0.75

#: Ranges of scripts with the language that a script stands for, and how sure that is, in nats.
SCRIPTS = {
    "han": ("\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff々", "zh", 1.0), "kana": ("\u3041-\u30ffーｦ-ﾟ", "ja", 3.0), "hangul": ("\u1100-\u11ff\u3130-\u318f\uac00-\ud7af", "ko", 3.0),
    "greek": ("\u0370-\u03ff\u1f00-\u1fff", "el", 3.0), "thai": ("\u0e01-\u0e5b", "th", 3.0), "hebrew": ("\u0591-\u05f4", "he", 2.0),
    "cyrillic": ("\u0400-\u052f", UNKNOWN, 0.0), "arabic": ("\u0600-\u06ff\u0750-\u077f", UNKNOWN, 0.0), "devanagari": ("\u0900-\u097f", UNKNOWN, 0.0), "other": ("\u0530-\u058f\u0980-\u0e00\u0e80-\u10ff\u1200-\u1dff", UNKNOWN, 0.0),
}
_ALL = "".join(r for r, _, _ in SCRIPTS.values())
_CJK = SCRIPTS["han"][0] + SCRIPTS["kana"][0]
_RUNS = re.compile("|".join(f"(?P<{n}>[{r}]+)" for n, r in (("cjk", _CJK), *((k, v[0]) for k, v in SCRIPTS.items() if k not in ("han", "kana")))))
_UNIT = re.compile("|".join([f"[{_CJK}]+", *(f"[{r}]+" for k, (r, _, _) in SCRIPTS.items() if k not in ("han", "kana")), rf"(?:(?![{_ALL}])[^\W\d_])+(?:['’](?:(?![{_ALL}])[^\W\d_])+)*"]))
_IS_SCRIPT, _IS_KANA, _IS_CJK = re.compile(f"[{_ALL}]"), re.compile(f"[{SCRIPTS['kana'][0]}]"), re.compile(f"[{_CJK}]")
_SENTENCE_END = r"[.!?]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[」』”）]*|\n[ \t]*\n\s*"
_END = re.compile(_SENTENCE_END)
#: Words, numbers and sentence ends of a text in Latin script.
_TOKEN = re.compile(rf"[^\W\d_]+(?:['’][^\W\d_]+)*|\d\w*|{_SENTENCE_END}")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a cleaned text: up to an end mark before space, or a paragraph's end."""
    out, at = [], 0
    for m in _END.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


@lru_cache(maxsize=200_000)
def _parts(word: str) -> list[str]:
    return re.split(r"['’]", fold(word))


def seed_language(words: list[str]) -> str | None:
    """Language of most function words, if there are two at least and a third more than of the next."""
    hits = sorted(((sum(w in s for w in words), lang) for lang, s in _SEEDS.items()), reverse=True)
    return hits[0][1] if hits[0][0] >= 2 and hits[0][0] > 1.34 * hits[1][0] else None


_SEEDS = {lang: {fold(w) for w in words.split()} for lang, words in SEEDS.items()}


def _count_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, lang, n): texts by the received label, and by the function words of a sentence at a half; a long text counts once."""
    for batch in batches:
        n: Counter = Counter()
        for text, label in zip(batch["text"], _code_of(batch["label"])):
            t, received, seeded = clean(text), set(), set()
            for a, b in sentences(t):
                words = [p for m in _UNIT.finditer(t, a, b) if not _IS_SCRIPT.match(m[0]) for p in _parts(m[0])]
                if label in LATIN:
                    received.update((w, label) for w in words)
                if len(words) >= MIN_WORDS and (lang := seed_language(words)):
                    seeded.update((w, lang) for w in words)
            n.update(dict.fromkeys(received, 1.0))
            n.update(dict.fromkeys(seeded, 0.5))
        yield pd.DataFrame([(w, lang, float(c)) for (w, lang), c in n.items()], columns=["word", "lang", "n"])


def _count_again(model: dict[str, tuple[float, ...]], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, lang, n): texts by the languages in which the word's sentences are whole under ``model``."""
    scorer = Scorer(model)
    for batch in batches:
        n: Counter = Counter()
        for text in batch["text"]:
            n.update({(p, lang) for w, lang in scorer.in_whole_sentences(clean(text)) if lang in LATIN for p in _parts(w)})
        yield pd.DataFrame([(w, lang, float(c)) for (w, lang), c in n.items()], columns=["word", "lang", "n"])


def _scores(counts: DataFrame) -> dict[str, tuple[float, ...]]:
    """Word -> score in each Latin language: log P(word | language) less the mean over languages."""
    counts = counts.groupBy("word", "lang").agg(F.sum("n").alias("n"))
    words = counts.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    by = {r["word"]: Counter(r["by"]) for r in words.collect()}
    for lang, seeds in _SEEDS.items():
        for w in seeds:
            by.setdefault(w, Counter())[lang] += 1
    total = {lang: sum(c[lang] for c in by.values()) + SMOOTH * len(by) for lang in LATIN}
    out = {}
    for w, c in by.items():
        logs = [math.log((c[lang] + SMOOTH) / total[lang]) for lang in LATIN]
        mean = sum(logs) / len(logs)
        out[w] = tuple(x - mean for x in logs)
    return out


def word_scores(df: DataFrame, doc_id: str, text: str, label: str | None) -> dict[str, tuple[float, ...]]:
    """The model: scores of the words of a bounded sample of texts.

    The sample is the ``SAMPLE_TEXTS`` rows of smallest hash of the id, of those that share an id any, so that the model is bounded and the same however
    the rows lie. Hashes alone are sorted, and texts are read where they lie.
    """
    t = F.col(f"`{text}`")
    received = F.col(f"`{label}`") if label else F.lit(None).cast("string")
    rows = df.select(t.alias("text"), received.alias("label"), F.xxhash64(F.col(f"`{doc_id}`")).alias("h"))
    last = rows.select("h").distinct().orderBy("h").limit(SAMPLE_TEXTS).agg(F.max("h")).first()[0]
    few = rows.where((F.col("h") <= (last if last is not None else 0)) & F.col("text").isNotNull()).groupBy("h").agg(F.max(F.struct("text", "label")).alias("x"))
    rows = cut(few.select("x.*").repartition(16))
    schema = "word string, lang string, n double"
    shared = df.sparkSession.sparkContext.broadcast(_scores(rows.mapInPandas(_count_first, schema)))
    model = _scores(rows.mapInPandas(lambda batches: _count_again(shared.value, batches), schema))
    shared.unpersist()
    return model


def label_words(scores: np.ndarray, ends: np.ndarray | list[bool]) -> np.ndarray:
    """Viterbi path over languages for rows of scores. ends: whether a sentence ended before the word.

    Where no run of words gains in another language what its ends cost, each end by half as two other languages may share it, the best path can't
    switch, and is the language of the greatest sum.
    """
    total = scores.sum(0)
    top = int(total.argmax())
    sums = np.vstack([np.zeros(scores.shape[1]), np.cumsum(scores - scores[:, top : top + 1], 0)])
    half = np.where(np.append(ends, False), SWITCH_AT_END / 2, SWITCH / 2)[:, None]
    half[0] = half[-1] = 0
    if ((sums - half)[1:] - np.minimum.accumulate(sums + half, 0)[:-1]).max() <= 1e-9:
        return np.full(len(scores), top)
    best, back = [0.0] * scores.shape[1], []
    k = range(scores.shape[1])
    for s, end in zip(scores.tolist(), list(ends)):
        top = max(k, key=best.__getitem__)
        jump = best[top] - (SWITCH_AT_END if end else SWITCH)
        back.append([i if best[i] >= jump else top for i in k])
        best = [(b if b >= jump else jump) + x for b, x in zip(best, s)]
    state = max(k, key=best.__getitem__)
    path = np.zeros(len(scores), int)
    for t in range(len(scores) - 1, -1, -1):
        path[t] = state
        state = back[t][state]
    return path


class Scorer:
    """Labels texts by a model; keeps the scores of words as written, in rows of one matrix (row 0: no evidence)."""

    def __init__(self, model: dict[str, tuple[float, ...]]):
        self.model, self.seen = model, {}
        self.rows = np.zeros((1024, len(LATIN)))
        self.used = 1

    def row(self, token: str) -> int:
        """Row of a word; -1 for a sentence end and -2 for a number."""
        r = self.seen.get(token)
        if r is None:
            r = 0
            if not token[0].isalpha():
                r = -2 if token[0].isdigit() or token[0].isnumeric() else -1
            elif known := [s for p in _parts(token) if (s := self.model.get(p))]:
                if self.used == len(self.rows):
                    self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
                r = self.used
                self.rows[r] = np.sum(known, 0)
                self.used += 1
            self.seen[token] = r
        return r

    def _path(self, at: np.ndarray, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language of each word, and its lead over the next language."""
        scores = self.rows[at]
        path = label_words(scores, np.append(False, sent[1:] != sent[:-1]))
        own = scores[np.arange(len(path)), path]
        scores[np.arange(len(path)), path] = -np.inf
        return path, own - scores.max(1)

    def latin(self, t: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Words, languages, leads, sentences, and the languages of whole sentences (-1: none) of a text in Latin script; None without words."""
        tokens = _TOKEN.findall(t)
        get = self.seen.get
        codes = np.array([r if (r := get(w)) is not None else self.row(w) for w in tokens], np.int64)
        is_word = codes >= 0
        if not is_word.any():
            return None
        every = np.cumsum(codes == -1)
        at, sent, n = codes[is_word], every[is_word], int(every[-1]) + 1
        path, lead = self._path(at, sent)
        units = np.bincount(sent, minlength=n)
        long = (units >= MIN_WORDS) | ((units == MIN_WORDS - 1) & (units + np.bincount(every[codes == -2], minlength=n) >= MIN_WORDS))
        held = np.bincount((sent * len(LATIN) + path)[at > 0], minlength=n * len(LATIN)).reshape(n, -1)
        most = held.argmax(1)
        count = held[np.arange(n), most]
        whole = np.where(long & (count >= 3) & (count >= SHARE * held.sum(1)), most, -1)
        return [w for w, k in zip(tokens, is_word.tolist()) if k], path, lead, sent, whole

    def mixed(self, t: str) -> tuple[list[str], list[int], list[str], list[float], dict[int, str]]:
        """Words, their sentences, languages, leads over the next language, and the languages of whole sentences of a text with other scripts."""
        ranges = sentences(t)
        words, where = [], []
        for k, (a, b) in enumerate(ranges):
            own = _UNIT.findall(t, a, b)
            words += own
            where += [k] * len(own)
        japanese = _IS_KANA.search(t) is not None
        labels, leads, known, cjk, other = [], [], [], [], []
        for w in words:
            m = _RUNS.match(w)
            name = m.lastgroup if m else ""
            _, lang, lead = SCRIPTS["kana" if japanese else "han"] if name == "cjk" else SCRIPTS[name] if name else ("", "", 0.0)
            labels.append(lang)
            leads.append(lead)
            cjk.append(name == "cjk")
            other.append(bool(name))
            known.append(bool(name))
        latin = [i for i, o in enumerate(other) if not o]
        if latin:
            at, sent = np.array([max(0, self.row(words[i])) for i in latin]), np.array([where[i] for i in latin])
            path, lead = self._path(at, sent)
            for i, p, x, r in zip(latin, path.tolist(), lead.tolist(), at.tolist()):
                labels[i], leads[i], known[i] = LATIN[p], x, r > 0
            if not (at > 0).any():
                for i in latin:
                    labels[i], leads[i] = UNKNOWN, 0.0
        by_sentence: dict[int, list[int]] = {}
        for i, k in enumerate(where):
            by_sentence.setdefault(k, []).append(i)
        whole: dict[int, str] = {}
        for k, own in by_sentence.items():
            chars = sum(len(words[i]) for i in own if cjk[i])
            # a sentence of Han and Kana is in one language; Latin words there are names and go with it
            if chars and (chars >= MIN_CHARS // 2 or len(own) < 2 * MIN_WORDS) and sum(not cjk[i] for i in own) < 2 * MIN_WORDS:
                _, lang, lead = SCRIPTS["kana" if japanese else "han"]
                for i in own:
                    labels[i], leads[i] = lang, lead
                if len(t[slice(*ranges[k])].strip()) >= MIN_CHARS:
                    whole[k] = lang
                continue
            evidence = Counter(labels[i] for i in own if known[i] and labels[i] != UNKNOWN)
            if evidence and len(own) >= MIN_WORDS - 1 and (len(own) >= MIN_WORDS or len(_WORD.findall(t, *ranges[k])) >= MIN_WORDS):
                lang, n = evidence.most_common(1)[0]
                if n >= 3 and n >= SHARE * evidence.total():
                    whole[k] = lang
        return words, where, labels, leads, whole

    def _room(self) -> None:
        if len(self.seen) > 500_000:  # between texts only, as a text's rows must stay
            self.seen, self.used = {}, 1

    def in_whole_sentences(self, t: str) -> list[tuple[str, str]]:
        """(word, language) of the words of a cleaned text's whole sentences."""
        self._room()
        if _IS_SCRIPT.search(t):
            words, where, _, _, whole = self.mixed(t)
            return [(w, whole[k]) for w, k in zip(words, where) if k in whole and not _IS_SCRIPT.match(w)]
        found = self.latin(t)
        return [(w, LATIN[k]) for w, k in zip(found[0], found[4][found[3]].tolist()) if k >= 0] if found else []

    def spans(self, text: str | None) -> list[tuple[str, float, int, int, bool]]:
        """(language, confidence, units, characters, has a whole sentence) of each span of a text, in order; none for a text without words."""
        if not text:
            return []
        self._room()
        t = clean(text)
        if _IS_SCRIPT.search(t):
            words, where, labels, leads, whole = self.mixed(t)
            out: list[list] = []
            for w, k, lang, lead in zip(words, where, labels, leads):
                if not out or out[-1][0] != lang:
                    out.append([lang, 0.0, 0, 0, False])
                s = out[-1]
                s[1] += lead
                s[2] += 1
                s[3] += len(w)
                s[4] = s[4] or whole.get(k) == lang
            return [(lang, _logistic(m), n, c, w) for lang, m, n, c, w in out]
        found = self.latin(t)
        if not found:
            return []
        words, path, lead, sent, whole = found
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
        in_whole = np.maximum.reduceat(whole[sent] == path, first)
        unknown = len(first) == 1 and not self.rows[[self.seen[w] for w in words]].any()
        return [
            (UNKNOWN if unknown else LATIN[p], 0.0 if unknown else _logistic(m), n, c, w)
            for p, m, n, c, w in zip(path[first].tolist(), np.add.reduceat(lead, first).tolist(), np.diff(np.append(first, len(path))).tolist(), np.add.reduceat(sizes, first).tolist(), in_whole.tolist())
        ]


def _logistic(m: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, m))))


def label_language(label: Column) -> Column:
    """Two-letter code that a label denotes; "" for missing or unknown ones."""
    names = F.create_map(*[F.lit(x) for code, every in LABELS.items() for n in every.split() for x in (n, code)])
    plain = F.lower(F.trim(label))
    return F.when(plain.isNull(), "").otherwise(F.coalesce(F.try_element_at(names, F.regexp_extract(plain, r"^[^-_ (]*", 0)), F.try_element_at(names, plain), F.lit("")))


def _code_of(labels: pd.Series) -> list[str]:
    """The same as :func:`label_language`, for the sample."""
    names = {n: code for code, every in LABELS.items() for n in every.split()}
    return ["" if x is None else names.get(re.split(r"[-_ (]", x.strip().lower())[0], names.get(x.strip().lower(), "")) for x in labels]


def text_languages(df: DataFrame, doc_id: str, text: str, label: str | None = None) -> DataFrame:
    """doc_id, span INT, lang, confidence DOUBLE, n_units, n_chars, whole BOOLEAN: the language spans of every text, in order.

    A text without words (null, empty, digits only) has one row with span 0, lang null and confidence 0. lang is ``und`` where a script is shared by
    several languages (confidence 0.5) and where nothing is known of any word (0). confidence is the logistic of the span's lead over the next best language. whole: the span holds a whole sentence (``MIN_WORDS`` words or ``MIN_CHARS``
    Japanese characters). Repeated texts and ids are labelled alike, row by row. Extra columns are ignored. Map-only, apart from the
    fit on the bounded sample; the model (the words of the sample) is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(word_scores(df, doc_id, text, label))

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = []
            for i, t in zip(batch["id"], batch["text"]):
                rows += [(i, k, *s) for k, s in enumerate(scorer.spans(t) or [(None, 0.0, 0, 0, False)])]
            yield pd.DataFrame(rows, columns=["id", "span", "lang", "confidence", "n_units", "n_chars", "whole"])

    kind = df.schema[doc_id].dataType.simpleString()
    out = even(df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))).mapInPandas(spans, f"id {kind}, span int, lang string, confidence double, n_units int, n_chars int, whole boolean")
    return out.withColumnRenamed("id", doc_id)
