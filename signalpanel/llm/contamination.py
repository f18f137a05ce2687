"""Held-out evaluation texts that leaked, wholly or partly, into a corpus.

Template canonicalisation: numbers, units and names become typed placeholders, by their form and on both sides. The items' windows of
words and of template tokens are a table of hashes. The corpus is read once, against a bitmap of the windows of fixed size, and only texts
with enough covered words go on, as their covered parts alone. Their windows are hash-joined to the window table, in blocks of bounded
size; pairs whose joint windows cover enough of the item in long enough stretches are aligned word by word and token by token, where a
slot counts only if it is replaced alike throughout.

No stage loses a case: in a case's stretches every word is in a window of four words, each following the one before directly or after
one word left out, so all of the item's held words are covered by windows of such shapes that both texts have.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalpanel.llm.templates import PAD, PLAIN, WINDOW, Filter, Reader, collapse, shapes, slotted, windows, word_code
from signalpanel.session import cut, even

#: A case: share of the item's words held, and words in a stretch that counts beside others.
MIN_SHARE, MIN_STRETCH = 0.4, 12
#: Rows of the window table that are broadcast at once (some 24 bytes each).
BLOCK_ROWS = 1_500_000
#: Characters of text read at once, and the least and largest bitmap, as logarithms of its bits.
CHARS, LOG2_BITS = 2_000_000, (16, 28)
_BREAK = "\x00"


def least_stretch(n: int) -> int:
    """Words of a stretch that counts, in an item of n words."""
    return min(MIN_STRETCH, math.ceil(MIN_SHARE * n))


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``CHARS`` characters."""
    a = size = 0
    for b, t in enumerate(texts):
        if size > CHARS:
            yield a, b
            a, size = b, 0
        size += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def read_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """item, words, kinds (one digit a word), n: the items that have words."""
    reader = Reader()
    for batch in batches:
        rows = []
        for a, b in _parts(list(batch["text"])):
            w = reader.read(list(batch["text"])[a:b])
            full = np.flatnonzero(w.code)
            at, count = np.unique(w.text[full], return_counts=True)
            for k, own in zip(at.tolist(), np.split(full, np.cumsum(count)[:-1])):
                rows.append((batch["item"].iloc[a + k], " ".join(reader.folded[r] for r in w.raw[own].tolist()), "".join(map(str, w.kind[own].tolist())), len(own)))
        yield pd.DataFrame(rows, columns=["item", "words", "kinds", "n"])


def item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """irow, h, shape, start, slots: the windows of each item's words, and those of its template that have slots and enough words of their own.

    shape is the number of the window's shape, start its first place among the words or, where slots is true, among the template's tokens. Items
    too short for a stretch of ``WINDOW`` words have shorter windows.
    """
    for batch in batches:
        out = [pd.DataFrame({"irow": [], "h": [], "shape": [], "start": [], "slots": []}, dtype=np.int64)]
        for irow, words, kinds in zip(batch["irow"], batch["words"], batch["kinds"]):
            w = Text(words, kinds)
            for slots, code, k in ((False, w.code, min(WINDOW, least_stretch(len(w.code)))), (True, w.token_code, WINDOW)):
                if slots and not (w.token_kind != PLAIN).any():
                    continue
                for shape, h in windows(code, k):
                    at = np.flatnonzero(slotted(w.token_kind, shape)) if slots else np.arange(len(h))
                    out.append(pd.DataFrame({"irow": irow, "h": h[at].view(np.int64), "shape": SHAPES.index(shape), "start": at, "slots": int(slots)}))
        yield pd.concat(out, ignore_index=True)


#: All shapes of windows, of one word up to ``WINDOW``.
SHAPES = [s for k in range(1, WINDOW + 1) for s in shapes(k)]
#: Offset of each of a shape's words, by shape; the last again where it has fewer.
OFFSETS = np.array([[s[min(k, len(s) - 1)] for s in SHAPES] for k in range(WINDOW)])


class Text:
    """Codes of the words and template tokens of a text that was read before."""

    def __init__(self, words: str, kinds: str, code_of: dict[str, int] | None = None):
        self.words, self.kinds = words.split(" "), kinds
        self.code = np.array([word_code(w) for w in self.words] if code_of is None else [c if (c := code_of.get(w)) is not None else code_of.setdefault(w, word_code(w)) for w in self.words], np.uint64)
        kind = np.frombuffer(kinds.encode(), np.uint8).astype(np.int8) - 48
        self.first, self.size, self.token_code = collapse(self.code, kind)
        self.token_kind = kind[self.first]

    def tokens(self) -> list[str]:
        """Words, or the number of a placeholder's type."""
        return [self.words[f] if k == PLAIN else f"\x01{k}" for f, k in zip(self.first.tolist(), self.token_kind.tolist())]

    def span(self, k: int) -> str:
        f = self.first[k]
        return " ".join(self.words[f : f + self.size[k]])


class Prober:
    """Finds the texts, and the parts of them, that items' windows cover."""

    def __init__(self, bitmap: Filter, sizes: list[int], slots: bool, least: int, need: int):
        self.bitmap, self.sizes, self.slots, self.least, self.need, self.reader = bitmap, sizes, slots, least, need, Reader()

    def probe(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of the text, words, kinds) of the parts of texts that could hold stretches of a case, breaks between them."""
        w = self.reader.read(texts)
        if not len(w.code):
            return
        covered = np.zeros(len(w.code), bool)
        for k in self.sizes:
            for shape, h in windows(w.code, k):
                at = self.bitmap.has(h)
                for o in shape:
                    covered[at + o] = True
        first, size, code = w.template()
        touched = np.add.reduceat(covered, first) > 0
        if self.slots:
            kind = w.kind[first]
            for shape, h in windows(code, WINDOW):
                at = np.flatnonzero(slotted(kind, shape))
                at = at[self.bitmap.has(h[at])]
                for o in shape:
                    touched[at + o] = True
        c = np.flatnonzero(touched)
        if not len(c):
            return
        begins, ends, held = stretches_of(c, size)
        good = held >= self.least
        begins, ends, held = c[begins[good]], c[ends[good]], held[good]
        text = w.text[first[begins]]
        keep = np.bincount(text, held, len(texts))[text] >= self.need
        begins, ends, text = first[begins[keep]], first[ends[keep]] + size[ends[keep]], text[keep]
        folded, last = self.reader.folded, -1
        words: list[str] = []
        kinds: list[str] = []
        for t, a, b in [*zip(text.tolist(), begins.tolist(), ends.tolist()), (-2, 0, 0)]:
            if t != last:
                if words:
                    yield last, " ".join(words), "".join(kinds)
                words, kinds, last = [], [], t
            elif words:
                words += [_BREAK] * PAD
                kinds += ["0"] * PAD
            words += [folded[r] for r in w.raw[a:b].tolist()]
            kinds += map(str, w.kind[a:b].tolist())


def stretches_of(c: np.ndarray, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, weight) of the runs of covered places ``c`` with at most one other place between; texts lie further apart."""
    begins = np.flatnonzero(np.append(True, np.diff(c) > 2))
    ends = np.append(begins[1:], len(c)) - 1
    return begins, ends, ends - begins + 1 if size is None else np.add.reduceat(size[c], begins)


class Block:
    """Items of one block with their window table: hash-joins texts' windows to it."""

    def __init__(self, items: list[tuple], irow: np.ndarray, h: np.ndarray, shape: np.ndarray, start: np.ndarray, slots: np.ndarray):
        """items: (irow, item, words, kinds). All places of all items' words, and then of their tokens, lie in one row."""
        self.items = items
        texts = self.texts = [Text(w, k) for _, _, w, k in items]
        lengths = self.lengths = np.array([[len(t.code) for t in texts], [len(t.first) for t in texts]]).reshape(2, -1)
        self.base = (np.cumsum(lengths + PAD) - lengths.ravel() - PAD).reshape(2, -1)
        self.total = int((lengths + PAD).sum())
        self.owner = np.repeat(np.tile(np.arange(len(items)), 2), (lengths + PAD).ravel())
        self.side = np.repeat([0, 1], (lengths + PAD).sum(1))
        self.least = np.vectorize(least_stretch, otypes=[int])(lengths)
        self.need = np.ceil(MIN_SHARE * lengths - 1e-9).astype(int)
        number = {r: k for k, (r, *_) in enumerate(items)}
        own = np.array([number[r] for r in irow.tolist()], np.int64)
        at = self.base[slots, own] + start
        # a window of words without slots is one of the template, too
        token = [np.append(np.cumsum(np.isin(np.arange(len(t.code)), t.first)) - 1, 0) for t in texts]
        plain = [np.append((t.token_kind == PLAIN)[x[:-1]] if len(t.code) else [], False) for t, x in zip(texts, token)]
        offset = np.cumsum([0, *[len(x) for x in plain]])
        flat_plain, flat_token = np.concatenate([*plain, [False]]), np.concatenate([*token, [0]])
        extra = []
        for n, s in enumerate(SHAPES):
            r = np.flatnonzero((shape == n) & (slots == 0) & (len(s) == WINDOW))
            for o in range(s[-1] + 1):
                r = r[flat_plain[offset[own[r]] + start[r] + o]]
            extra.append((h[r], self.base[1, own[r]] + flat_token[offset[own[r]] + start[r]], shape[r]))
        all_h, all_at, all_shape = (np.concatenate([x, *y]) for x, y in zip((h, at, shape), zip(*extra)))
        # one table for all shapes: a text's window of any shape may meet an item's of any other
        all_h = all_h.view(np.uint64)
        order = np.argsort(all_h, kind="stable")
        self.h, self.from_, self.count = np.unique(all_h[order], return_index=True, return_counts=True)
        self.at, self.shape = all_at[order], all_shape[order]
        self.sizes = sorted({len(SHAPES[n]) for n in np.unique(shape[slots == 0])})
        self.with_slots = bool(slots.any())
        self.code_of: dict[str, int] = {}

    def candidates(self, t: Text) -> list[tuple[int, list[np.ndarray]]]:
        """(item, [agreeing places of words, of tokens]) for items that the text's windows cover enough, in stretches long enough, by words or by tokens.

        Places are (of the item, of the text) pairs that lie in a window which both have, as rows in order.
        """
        hashes, starts, kinds = [], [], []
        for slots, code in ((False, t.code), (True, t.token_code)):
            for k in self.sizes if not slots else [WINDOW] * self.with_slots:
                for shape, h in windows(code, k):
                    at = np.flatnonzero((h != 0) & slotted(t.token_kind, shape)) if slots else np.flatnonzero(h)
                    hashes.append(h[at])
                    starts.append(at)
                    kinds.append(np.full(len(at), 2 * SHAPES.index(shape) + slots))
        if not hashes or not len(self.h):
            return []
        h, start, kind = (np.concatenate(x) for x in (hashes, starts, kinds))
        k = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = np.flatnonzero(self.h[k] == h)
        k, start, kind = k[hit], start[hit], kind[hit]
        at, shape, _ = self._rows(np.unique(k))
        covered = np.zeros(self.total, bool)
        for o in range(WINDOW):
            covered[at + OFFSETS[o, shape]] = True
        c = np.flatnonzero(covered)
        if not len(c):
            return []
        begins, _, held = stretches_of(c)
        side, owner = self.side[c[begins]], self.owner[c[begins]]
        good = held >= self.least[side, owner]
        sums = np.zeros(self.need.shape)
        np.add.at(sums, (side[good], owner[good]), held[good])
        able = (sums >= self.need) & (sums > 0)
        found = np.flatnonzero(able.any(0))
        if not len(found):
            return []
        # the agreeing places, for these items alone
        at, shape, row = self._rows(k)
        own = np.flatnonzero(able[self.side[at], self.owner[at]])
        at, shape, start, kind = at[own], shape[own], start[row[own]], kind[row[own]]
        to_token = np.cumsum(np.isin(np.arange(len(t.code)), t.first, assume_unique=True)) - 1
        width = len(t.code) + 3  # so that no step leads into another row
        b = start + OFFSETS[:, kind // 2]
        # a window of words that meets tokens is free of slots
        pure = (self.side[at] == 1) & (kind % 2 == 0)
        b[:, pure] = to_token[b[:, pure]]
        points = np.unique((at + OFFSETS[:, shape]) * width + b)
        points = points[_in_stretches(points, width, self.least[self.side[points // width], self.owner[points // width]])]
        place, doc = points // width, points % width
        held = np.zeros(self.need.shape)
        new = place[np.append(True, place[1:] != place[:-1])] if len(place) else place
        np.add.at(held, (self.side[new], self.owner[new]), 1)
        found = found[(held >= self.need)[:, found].any(0)]
        ends = np.searchsorted(place, self.base[:, found] + np.stack([self.lengths[0][found], self.lengths[1][found]]))
        begins = np.searchsorted(place, self.base[:, found])
        return [(n, [np.stack([place[begins[x, k] : ends[x, k]] - self.base[x, n], doc[begins[x, k] : ends[x, k]]]) for x in (0, 1)]) for k, n in enumerate(found.tolist())]

    def _rows(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, shape, number in k) of all rows of the table with the k-th hashes."""
        n = self.count[k]
        rows = np.repeat(self.from_[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.at[rows], self.shape[rows], np.repeat(np.arange(len(k)), n)

    def leaks(self, words: str, kinds: str) -> list[tuple]:
        """(item, share, template_share, n_words, n_stretches, n_slots, slots_alike) of the items that the text's parts carry."""
        if len(self.code_of) > 500_000:
            self.code_of = {}
        t, out = Text(words, kinds, self.code_of), []
        for k, points in self.candidates(t):
            found = compare(self.texts[k], t, *points)
            if max(found[:2]) >= MIN_SHARE:
                out.append((self.items[k][1], *found))
        return out


def _in_stretches(points: np.ndarray, width: int, least: np.ndarray) -> np.ndarray:
    """Which of the agreeing places (item's place times width, plus text's; in order) lie on a path of stretch steps with ``least`` places at least."""
    steps = [di * width + dj for di in (1, 2) for dj in (1, 2)]
    most = int(least.max(initial=1))

    def lengths(sign: int) -> np.ndarray:
        """Places on the longest path up to each place, as far as it matters."""
        neighbour = []
        for d in steps:
            k = np.minimum(np.searchsorted(points, points + sign * d), len(points) - 1)
            neighbour.append(np.where(points[k] == points + sign * d, k, len(points)))
        n = np.append(np.ones(len(points), np.int8), 0).astype(np.int8)
        for _ in range(most - 1):
            n[:-1] = 1 + np.maximum(np.maximum(n[neighbour[0]], n[neighbour[1]]), np.maximum(n[neighbour[2]], n[neighbour[3]]))
        return n[:-1].astype(int)

    return lengths(-1) + lengths(1) - 1 >= least


def align(item: list[str], doc: list[str], least: int) -> tuple[int, int, list[tuple[int, int]]]:
    """:func:`chain` over all places where the words agree."""
    where: dict[str, list[int]] = defaultdict(list)
    for j, w in enumerate(doc):
        where[w].append(j)
    return chain([(i, j) for i, w in enumerate(item) for j in where.get(w, ())], least)


def chain(points: list[tuple[int, int]], least: int) -> tuple[int, int, list[tuple[int, int]]]:
    """(places held in order, stretches, the places) of the best chain of stretches over agreeing places (of the item, of the text), in order.

    In a stretch no two neighbouring words are changed, dropped or added, and it has at least ``least`` words. Exact: the best of all chains.
    """
    one: dict[int, list] = {}
    two: dict[int, list] = {}
    closed_j: list[int] = []  # ends of whole stretches with growing totals
    closed: list[tuple] = []
    now: dict[int, list] = {}
    last = -1
    for i, j in [*points, (1 << 60, 0)]:
        if i != last:  # the row is done
            for e, states in now.items():
                s = states[0]
                if s[0] >= least:
                    k = bisect_left(closed_j, e)
                    if (k == 0 or closed[k - 1][1] < s[1]) and not (k < len(closed_j) and closed_j[k] == e and closed[k][1] >= s[1]):
                        end = k
                        while end < len(closed) and closed[end][1] <= s[1]:
                            end += 1
                        closed_j[k:end], closed[k:end] = [e], [s]
            one, two = (now, one) if i == last + 1 else ({}, now) if i == last + 2 else ({}, {})
            now, last = {}, i
        k = bisect_left(closed_j, j) if closed_j else 0
        base = closed[k - 1] if k else None
        # state: words in the stretch up to least, total, places, state before
        states = [(1, (base[1] if base else 0) + 1, i, j, base)]
        for row in (one, two):
            if row:
                for before in (row.get(j - 1), row.get(j - 2)):
                    if before:
                        for s in before:
                            states.append((s[0] + 1 if s[0] < least else least, s[1] + 1, i, j, s))
        if len(states) > 1:
            states.sort(key=_by_size, reverse=True)
            kept, top = [], 0
            for s in states:
                if s[1] > top:
                    kept.append(s)
                    top = s[1]
            states = kept
        now[j] = states
    if not closed:
        return 0, 0, []
    s, pairs, count = closed[-1], [], 0
    held = s[1]
    while s:
        pairs.append((s[2], s[3]))
        before = s[4]
        count += before is None or s[2] - before[2] > 2 or s[3] - before[3] > 2
        s = before
    return held, count, pairs[::-1]


def _by_size(s: tuple) -> tuple[int, int]:
    return s[0], s[1]


def compare(item: Text, doc: Text, words: np.ndarray, tokens: np.ndarray) -> tuple[float, float, int, int, int, bool]:
    """(share of words held, share of template tokens held, words, stretches, replaced slots, each replaced alike) of an item in a text's parts.

    words and tokens are the agreeing places. A slot that isn't replaced by the text by which its value is mostly replaced counts as a changed token.
    """
    n, m = len(item.words), len(item.first)
    held, stretches, places = chain(list(zip(*words.tolist())), least_stretch(n))
    if held == n:
        return 1.0, 1.0, n, stretches, 0, True
    token_held, token_stretches, pairs = chain(list(zip(*tokens.tolist())), least_stretch(m))
    slots = [(item.span(i), doc.span(j)) for i, j in pairs if item.token_kind[i] != PLAIN]
    usual = {x: Counter(d for s, d in slots if s == x).most_common(1)[0][0] for x in {s for s, _ in slots}}
    odd = sum(usual[s] != d for s, d in slots)
    return held / n, (token_held - odd) / m, n, stretches or token_stretches, sum(s != d for s, d in slots), odd == 0


def _bitmap(postings: DataFrame, n: int) -> Filter:
    """The windows' bitmap, with sixteen bits or more a window while the largest size lasts; its words of 64 bits come to the driver."""
    log2 = min(LOG2_BITS[1], max(LOG2_BITS[0], math.ceil(math.log2(16 * max(n, 1)))))
    mask = (1 << log2) - 1
    places = F.array(F.shiftrightunsigned("h", 64 - log2), F.shiftrightunsigned("h", 20).bitwiseAND(mask), F.col("h").bitwiseAND(mask))
    bits = postings.select(F.explode(places).alias("x")).select(F.shiftright("x", 3).alias("at"), F.expr("shiftleft(1, cast(x & 7 as int))").alias("bit"))
    table = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (log2 - 3), np.uint8)
    out[table["at"].to_numpy()] = table["bits"].to_numpy()
    return Filter(out, log2)


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """doc_id, item_id, share DOUBLE, template_share DOUBLE, n_words, n_stretches, n_slots, slots_alike: each document with each item that it carries.

    share is the part of the item's words that the document holds in its order, in one stretch that reaches ``MIN_SHARE`` by itself or in
    stretches of at least ``MIN_STRETCH`` words; template_share the same for the tokens of the template, where a number, unit or name may be
    replaced by another, the same for every occurrence. A pair comes out if either reaches ``MIN_SHARE``. n_slots counts replaced slots,
    slots_alike tells whether each was replaced by the same text throughout. Case, accents, punctuation, markup, white space, broken lines and
    variants of a character are no changes. Names are capitalised words within a sentence, so a text all in one case has none.

    Null, empty and wordless texts carry nothing and wordless items are carried by nothing; an item of one or two words is carried by every text
    that has them so. Repeated rows give repeated results; ids may be null. Extra columns are ignored, whatever their names. Whole texts are
    searched, however long. Whether a pair comes out depends on its two texts only.

    Scale: documents are read once and not shuffled, against a bitmap of at most 32 MB. With more than ``BLOCK_ROWS`` windows the items come in
    blocks, for each of which only the covered parts of the texts are read, from the checkpoint folder.
    """
    spark = docs.sparkSession
    doc_type, item_type = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    source = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{item_text}`").alias("text")).where("text is not null")
    table = cut(source.mapInPandas(read_items, f"item {item_type}, words string, kinds string, n long").withColumn("irow", F.monotonically_increasing_id()))
    share = lambda c: F.ceil(F.lit(MIN_SHARE) * c - 1e-9)
    k = F.least(F.lit(MIN_STRETCH), share(F.col("n")))
    known = table.agg(F.min(k).alias("least"), F.min(share(F.col("n"))).alias("need"), F.collect_set(F.least(F.lit(WINDOW), k).cast("int")).alias("sizes"), F.max(F.col("kinds").rlike("[1-9]")).alias("slots"), F.count("*").alias("n")).first()
    table_windows = cut(table.select("irow", "words", "kinds").mapInPandas(item_windows, "irow long, h long, shape int, start int, slots int"))
    n = table_windows.count()
    prober = spark.sparkContext.broadcast((_bitmap(table_windows, n), sorted(known["sizes"]), bool(known["slots"]), known["least"] or 1, known["need"] or 1))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = Prober(*prober.value)
        for batch in batches:
            texts, ids = list(batch["text"]), batch["doc"]
            for a, b in _parts(texts):
                rows = [(a + k, words, kinds) for k, words, kinds in p.probe(texts[a:b])]
                if rows:
                    yield pd.DataFrame({"doc": ids.iloc[[r[0] for r in rows]].reset_index(drop=True), "words": [r[1] for r in rows], "kinds": [r[2] for r in rows]})

    rows = even(docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text")).where("text is not null")).mapInPandas(probe, f"doc {doc_type}, words string, kinds string")
    blocks = -(-n // BLOCK_ROWS)
    if blocks != 1:
        rows = cut(rows)
    schema = f"doc {doc_type}, item {item_type}, share double, template_share double, n_words int, n_stretches int, n_slots int, slots_alike boolean"
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        own = F.pmod(F.xxhash64("irow"), F.lit(blocks)) == k
        t = table_windows.where(own).toArrow()
        block = spark.sparkContext.broadcast(([tuple(r) for r in table.where(own).select("irow", "item", "words", "kinds").collect()], *(t[c].to_numpy() for c in ("irow", "h", "shape", "start", "slots"))))

        def decide(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            b, names = Block(*block.value), ["share", "template_share", "n_words", "n_stretches", "n_slots", "slots_alike"]
            for batch in batches:
                seen: dict[tuple[str, str], list] = {}  # exact copies are aligned once
                found = []
                for doc, t in zip(batch["doc"], zip(batch["words"], batch["kinds"])):
                    if t not in seen:
                        seen[t] = b.leaks(*t)
                    found += [(doc, *x) for x in seen[t]]
                yield pd.DataFrame(found, columns=["doc", "item", *names])

        part = rows.mapInPandas(decide, schema)
        out = part if k == 0 else out.unionByName(part)
    return out.withColumnsRenamed({"doc": doc_id, "item": item_id})
