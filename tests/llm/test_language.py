import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from signalpanel.llm import language as L

TEXTS = {
    "en": "The group expects that demand for freight software will recover in the second half of the year. We opened two sites in the northern region and the trend continued after the close.",
    "de": "Die Nachfrage nach Messtechnik sank durch den Zukauf und dieser Trend hielt bis zum Jahresende an. Wir haben im ersten Halbjahr rund hundert Filialen in den nördlichen Ländern geprüft.",
    "fr": "Le résultat opérationnel a augmenté grâce aux nouveaux contrats et cette tendance s'est poursuivie. Nous avons contrôlé environ cent machines dans les régions du nord pour cette raison.",
    "es": "La dirección considera que la deuda neta podría seguir creciendo si los precios siguen altos. Hemos adquirido unas cien instalaciones en el mercado nacional, lo que juzgamos pasajero.",
    "pt": "A administração considera que o lucro antes dos impostos poderá piorar se os juros subirem. Verificamos cerca de cem instalações no exterior e essa tendência continuou até o fim do ano.",
    "it": "Il grado di utilizzo degli impianti è diminuito dopo la chiusura di uno stabilimento. Abbiamo rinnovato circa cento unità lungo la costa e questa tendenza è proseguita per tutto l'anno.",
    "nl": "De dochter meldde over dit jaar een opbrengst van ruim duizend terwijl het aantal werknemers gelijk bleef. Wij beheren nu veel winkels in de noordelijke gebieden van het land.",
    "ja": "当社は沿岸地域において多くの店舗を取得しました。経営陣は在庫水準が見直される可能性があると考えています。",
}


def frame(spark, rows):
    return spark.createDataFrame([(n, t, lab, "x") for n, (t, lab) in enumerate(rows)], "doc_id long, text string, lang string, span string")


def run(spark, rows):
    out: dict = {}
    for r in L.text_languages(frame(spark, rows), "doc_id", "text", "lang").orderBy("doc_id", "span").collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_languages_and_edges(spark):
    mixed = TEXTS["en"] + "\n\n" + TEXTS["it"]
    rows = [(t, lang) for lang, t in TEXTS.items()] * 3 + [(mixed, "en"), (None, "en"), ("", "en"), ("-- 17 --", None), ("12 | 340", ""), (TEXTS["fr"].upper(), "de"), ("<p>" + TEXTS["de"] + "</p>", None), (TEXTS["nl"] * 400, "en"), (TEXTS["es"] + " (à la carte)", "es")]
    got = run(spark, rows)
    n = len(TEXTS) * 3
    for k in range(n):
        assert {r.lang for r in got[k] if r.whole} == {list(TEXTS)[k % len(TEXTS)]}, k
    assert [r.lang for r in got[n]] == ["en", "it"] and all(r.whole and r.confidence > 0.9 for r in got[n])
    assert all(got[n + k][0].lang is None and got[n + k][0].confidence == 0 for k in (1, 2, 3, 4))
    assert [{r.lang for r in got[n + k] if r.whole} for k in (5, 6, 7, 8)] == [{"fr"}, {"de"}, {"nl"}, {"es"}]
    assert L.text_languages(frame(spark, []), "doc_id", "text", "lang").count() == 0


def test_shortcut_gives_the_viterbi_path():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.normal(0, 2, (12, len(L.LATIN)))
        ends = rng.random(12) < 0.2
        best, paths = np.zeros(len(L.LATIN)), [[k] for k in range(len(L.LATIN))]
        for t in range(12):
            new, back = [], []
            for k in range(len(L.LATIN)):
                cost = [best[j] - (0 if j == k else L.SWITCH_AT_END if ends[t] else L.SWITCH) for j in range(len(L.LATIN))]
                j = int(np.argmax(cost))
                new.append(cost[j] + s[t, k])
                back.append(paths[j][1:] + [k] if t == 0 else paths[j] + [k])
            best, paths = np.array(new), back
        value = lambda p: sum(s[t, k] for t, k in enumerate(p)) - sum((L.SWITCH_AT_END if ends[t] else L.SWITCH) for t in range(1, 12) if p[t] != p[t - 1])
        assert abs(value(L.label_words(s, list(ends))) - value(paths[int(best.argmax())])) < 1e-9


def test_labels(spark):
    labels = ["EN", "en_GB", "English", "deu", "pt-BR", None, "", " unknown ", "und", "Japanese", "zh", "Portuguese (Brazil)"]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(labels)], "n int, x string").select("n", L.label_language(F.col("x")).alias("c"))
    want = ["en", "en", "en", "de", "pt", "", "", "", "", "ja", "", "pt"]
    assert [r.c for r in df.orderBy("n").collect()] == want == L._code_of(pd.Series(labels))


def test_scripts(spark):
    """Scripts of one language have it, shared scripts and unknown words have none, and mixed texts keep their Latin stretches."""
    known = [(t, lang) for lang, t in TEXTS.items()] * 3
    rows = [
        ("Компания ожидает, что спрос на программное обеспечение восстановится во втором полугодии.", "en"), ("회사는 하반기에 소프트웨어 수요가 회복될 것으로 예상하고 있습니다.", None),
        ("Η εταιρεία αναμένει ότι η ζήτηση λογισμικού θα ανακάμψει το δεύτερο εξάμηνο.", None), ("公司预计下半年软件需求将会恢复并且价格将继续上升直到年底。", "ja"), (TEXTS["ja"], None), ("qwzx vkjq xqzw wvkx zzqk", "en"),
        (TEXTS["en"] + " " + TEXTS["en"] + "\n\n회사는 하반기에 소프트웨어 수요가 회복될 것으로 예상하고 있습니다.", None),
        ("Ｔｈｅ ｇｒｏｕｐ ｅｘｐｅｃｔｓ ｔｈａｔ ｄｅｍａｎｄ ｆｏｒ ｆｒｅｉｇｈｔ ｓｏｆｔｗａｒｅ ｗｉｌｌ ｒｅｃｏｖｅｒ ｉｎ ｔｈｅ ｓｅｃｏｎｄ ｈａｌｆ ｏｆ ｔｈｅ ｙｅａｒ．", "de"),
    ]
    got = run(spark, known + rows)
    n = len(known)
    assert [[r.lang for r in got[n + k]] for k in range(8)] == [["und"], ["ko"], ["el"], ["zh"], ["ja"], ["und"], ["en", "ko"], ["en"]]
    assert got[n][0].confidence == 0.5 and got[n + 5][0].confidence == 0 and not got[n][0].whole and not got[n + 5][0].whole
    assert 0.5 < got[n + 3][0].confidence and got[n + 3][0].whole and got[n + 7][0].whole


def test_sample_is_bounded_where_ids_are_alike(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_TEXTS", 3)
    same = spark.createDataFrame([(1, t, lang) for lang, t in TEXTS.items()] + [(None, TEXTS["en"], "en")], "doc_id long, text string, lang string")
    assert L.word_scores(same, "doc_id", "text", "lang")
