import random

import pytest

from signalpanel.llm import contamination as C
from signalpanel.llm import templates as T

WORDS = [a + b for a in ("bar", "cle", "dri", "fon", "gul", "hem", "jor", "kal") for b in ("ben", "dor", "fin", "gas", "lum", "mir", "nop", "ras", "tev", "wix")]


def text(rnd, n):
    return [rnd.choice(WORDS) for _ in range(n)]


def brute(item, doc, least):
    """Most words of any chain: for every cell the best total for each length of the stretch that ends there, over all pairs of cells."""
    cells = [(i, j) for i, x in enumerate(item) for j, y in enumerate(doc) if x == y]
    best = {}  # (cell, words in its stretch) -> words in all
    for c in cells:
        done = max((t for (p, n), t in best.items() if n >= least and p[0] < c[0] and p[1] < c[1]), default=0)
        best[c, 1] = done + 1
        for di, dj in ((1, 1), (2, 2), (2, 1), (1, 2)):
            for n in range(1, len(item) + 1):
                if (t := best.get(((c[0] - di, c[1] - dj), n))) is not None:
                    best[c, n + 1] = max(best.get((c, n + 1), 0), t + 1)
    return max((t for (_, n), t in best.items() if n >= least), default=0)


def test_align_against_brute_force():
    rnd = random.Random(1)
    for _ in range(40):
        item = text(rnd, 36)[: rnd.randrange(8, 36)]
        doc = text(rnd, 5)
        for a, b in ((0, 14), (rnd.randrange(10, 20), 34)):
            part = item[a:b]
            for k in range(rnd.randrange(2, 6), len(part) - 1, rnd.randrange(2, 6)):
                part[k] = "changed"
            if rnd.random() < 0.5:
                part = part[:6] + part[7:]
            doc += part + text(rnd, rnd.randrange(0, 9))
        least = rnd.choice((2, 5, 8))
        held, n, places = C.align(item, doc, least)
        assert held == brute(item, doc, least) == len(places)
        assert all(item[i] == doc[j] for i, j in places) and (n > 0) == (held > 0)


def plain_leaks(items, docs):
    """Every document aligned with every item, without any choice of candidates."""
    r = T.Reader()
    words = [[r.folded[x] for x, c in zip(w.raw, w.code) if c] for t in (items, docs) for w in [r.read([x]) for x in t]]
    a, b = words[: len(items)], words[len(items) :]
    return sorted((n, m) for n, d in enumerate(b) for m, i in enumerate(a) if i and C.align(i, d, C.least_stretch(len(i)))[0] >= 0.4 * len(i) - 1e-9)


def found(spark, items, docs, least=0.4):
    it = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in C.find_leaks(make(spark, docs), "doc_id", "text", it, "item_id", "text").where(f"share >= {least}").collect())


def make(spark, docs):
    return spark.createDataFrame([(n, t, "x", 1.0) for n, t in enumerate(docs)], "doc_id long, text string, item string, share double")


def test_find(spark):
    rnd = random.Random(2)
    items = [" ".join(text(rnd, 100)) for _ in range(5)] + [None, "", "..."]
    it = spark.createDataFrame([(n, t) for n, t in enumerate(items)], "item_id long, text string")
    w = items[0].split()
    upper = "<p>" + " ".join(w[:60]).upper().replace(" ", "\n", 3) + "</p>"
    hyphen = " ".join(w[:50])[:-3] + "-\n" + " ".join(w[:50])[-3:]
    edited = [x if k % 8 else "other" for k, x in enumerate(w[20:80])]
    two = w[:14] + text(rnd, 30) + w[40:54] + text(rnd, 9) + w[70:84]
    docs = [
        items[1], upper, hyphen, " ".join(edited), " ".join(two), " ".join(w[:30]), None, "", "—", " ".join(w[50:] + w[:39]),
        " ".join(x for k, y in enumerate(w[:60]) for x in ([y] if k % 3 else ["u", "v"])), " ".join(text(rnd, 3000) + w[:45] + text(rnd, 3000)), items[2] + " " + items[3],
    ]
    got = sorted((r.doc_id, r.item_id) for r in C.find_leaks(make(spark, docs), "doc_id", "text", it, "item_id", "text").collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 0), (9, 0), (11, 0), (12, 2), (12, 3)]
    assert C.find_leaks(make(spark, []), "doc_id", "text", it, "item_id", "text").count() == 0
    assert C.find_leaks(make(spark, docs), "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def edited(words, every, rnd):
    return [w if k % every else "".join(rnd.sample("qwzkvx", 6)) for k, w in enumerate(words, 1)]


def test_no_case_is_lost(spark):
    """Against alignment of every pair: items that share halves, dense edits, few short items, copies and long texts."""
    rnd = random.Random(5)
    half = text(rnd, 50)
    items = [" ".join(half + text(rnd, 50)) for _ in range(60)] + [" ".join(text(rnd, n)) for n in (1, 2, 3, 5, 7, 9, 12, 20, 29, 30, 31, 200)]
    docs = []
    for k in range(0, len(items), 3):
        w = items[k].split()
        for every in (2, 3, 4, 5, 6, 11):
            docs.append(" ".join(text(rnd, 7) + edited(w, every, rnd) + text(rnd, 7)))
        a = rnd.randrange(0, max(1, len(w) // 2))
        docs.append(" ".join(text(rnd, 40) + w[a : a + max(1, int(0.46 * len(w)))] + text(rnd, 40)))
        docs.append(" ".join(text(rnd, 3) + w[:13] + text(rnd, 30) + edited(w[15:45], 3, rnd) + text(rnd, 20) + w[-12:]))
    docs += [" ".join(text(rnd, 400)) for _ in range(20)] + docs[:5]
    want = plain_leaks(items, docs)
    assert len(want) > 200 and found(spark, items, docs) == want


@pytest.mark.parametrize("every", [2, 5])
def test_dense_edits(spark, every):
    """A change in every fifth word, and in every second: no run of five, or of two, equal words is left."""
    rnd = random.Random(6)
    item = text(rnd, 100)
    assert found(spark, [" ".join(item)], [" ".join(edited(item, every, rnd))]) == [(0, 0)]


def test_shared_half_is_found_whatever_else_is_searched(spark, monkeypatch):
    """46 of an item's 100 words in one stretch, all of them in the half that 1,499 other items have, too: every item is carried, in any blocks."""
    rnd = random.Random(7)
    half = text(rnd, 50)
    items = [" ".join(half + text(rnd, 50)) for _ in range(300)]
    doc = [" ".join(half[:46]) + ". " + " ".join(text(rnd, 60))]
    assert found(spark, items[:1], doc) == [(0, 0)]
    every = [(0, k) for k in range(300)]
    assert found(spark, items, doc) == every
    monkeypatch.setattr(C, "BLOCK_ROWS", 70_000)
    assert found(spark, items, doc) == every


def test_reparameterised_copies(spark):
    """All names and numbers replaced, each alike; and not alike."""
    item = (
        "In the worked example the panel of Alto Brava Labs counted 215 crates at 25 percent and then 215 crates more while the barge charter lapsed. "
        "Without any notice from Cleo Dorn Foods the sponsor, Alto Brava Labs, paid 812 thousand before 2019 and asked how the lease of Cleo Dorn Foods would end."
    )
    new = item.replace("215", "3,714").replace("Alto Brava Labs", "Contoso Widgets").replace("Cleo Dorn Foods", "Umbra Field").replace("812", "77").replace("2019", "2031").replace("25", "61")
    odd = new.replace("3,714", "12", 1).replace("Contoso Widgets", "Nimbus Partners", 1)
    it = spark.createDataFrame([(1, item), (2, "Said by others of crates.")], "item_id long, text string")
    got = {r.doc_id: r for r in C.find_leaks(make(spark, [new, odd, item, item.replace("crates", "boxes")]), "doc_id", "text", it, "item_id", "text").collect()}
    assert got[0].template_share > 0.95 and got[0].share < 0.95 and got[0].slots_alike and got[0].n_slots == 9
    assert got[1].template_share < got[0].template_share and not got[1].slots_alike
    assert got[2].share == 1 and got[2].n_slots == 0 and got[2].slots_alike
    assert 0.9 < got[3].share < 1 and got[3].n_slots == 0


@pytest.mark.parametrize("a,b", [("year-\n-end", "year-end"), ("１４，６２１－ｕｎｉｔ　ｌｅｓｓｅｅ＇ｓ", "14,621-unit lessee's"), ("lessee´s", "lessee's"), ("l’e&#769;le&#768;ve", "l'élève"), ("in 2,423 units", "in 2423 units"), ("in 2 423 units", "in 2423 units"), ("seller’s", "seller's"), ("ﬁne", "fine"), ("ÉLÈVE", "eleve"), ("prim-\neiro", "primeiro"), ("e\u0301le\u0300ve", "élève"), ("of\n" + " " * 60 + "12" + " " * 60 + "\nthe", "of\nthe"), ("of\n" + "—" * 50 + " 12 " + "—" * 50 + "\nthe", "of\nthe")])
def test_variants(a, b):
    r = T.Reader()
    words = [[r.folded[x] for x, c in zip(w.raw, w.code) if c] for w in (r.read([a]), r.read([b]))]
    assert words[0] == words[1]
