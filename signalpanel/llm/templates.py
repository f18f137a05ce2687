"""Words of texts and their templates: numbers, units and names as typed placeholders, and windows of words and of templates.

Everything here works on many texts at once, in numpy arrays; only words as written that weren't met before go through Python.
A word's type depends on its form and on its own text alone, never on other texts or on a list of names.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import product

import numpy as np

from signalpanel.llm.normal import clean, fold

#: Words in a window, and the share of a sentence's words up to which single capitalised words in it are names (more: a language that capitalises nouns).
WINDOW, SINGLE_NAMES = 4, 0.1
PLAIN, NUMBER, UNIT, NAME, END = range(5)
#: Words for units of measure, as folded.
UNITS = frozenset("percent prozent cent ciento procent thousand million millions billion tausend milliers miles millones mille eur usd euro euros dollar dollars kg km tons units stuck unidades unites".split())

#: A word with its inner apostrophes, hyphens (over a line end, too) and marks between digits, all of which vanish; or the end of a sentence.
_TOKEN = re.compile(r"[^\W_]+(?:(?:['’‘ʼ`´′]|[-‐-―−]\s*-?|(?<=\d)[.,\s](?=\d))[^\W_]+)*|[.!?:;。！？]")
_NOT_WORD = re.compile(r"[\W_]+")
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Between two texts, and between two parts of one: more unknown words than a stretch can pass over.
PAD = 4
_SLOT = {k: np.uint64(int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=8).digest(), "little")) for k in (NUMBER, UNIT, NAME)}


def shapes(k: int) -> list[tuple[int, ...]]:
    """Offsets of k words of which each follows the one before directly or leaves out one word between."""
    return [tuple(np.cumsum((0, *gaps)).tolist()) for gaps in product((1, 2), repeat=k - 1)]


@dataclass
class Words:
    """Words of many texts in one row, each text followed by ``PAD`` empty ones. code 0 is an empty word."""

    text: np.ndarray  # number of the text
    raw: np.ndarray  # number of the word as written
    code: np.ndarray  # hash of the folded word
    kind: np.ndarray

    def template(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return collapse(self.code, self.kind)


def collapse(code: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, code) of a template's tokens: a run of name words is one token, placeholders have their type's code."""
    name = kind == NAME
    first = np.flatnonzero(~name | ~np.append(False, name[:-1]))
    out = code[first]
    for k, c in _SLOT.items():
        out[kind[first] == k] = c
    return first, np.diff(np.append(first, len(name))), out


def word_code(w: str) -> int:
    """Hash of a folded word, never 0; the break between two parts of a text is 0."""
    return 0 if w == "\x00" else int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") or 1


class Reader:
    """Reads texts into :class:`Words`; remembers the words that it met, at most ``limit`` between two batches."""

    def __init__(self, limit: int = 500_000):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.folded: list[str] = [""]
        self.code, self.kind, self.capital = [0], [PLAIN], [False]
        self._arrays: tuple[int, tuple] = (0, ())

    def add(self, token: str) -> int:
        n = self.number[token] = len(self.folded)
        w = _NOT_WORD.sub("", fold(token))
        self.folded.append(w)
        if not w:
            self.code.append(0)
            self.kind.append(END)
            self.capital.append(False)
            return n
        self.code.append(word_code(w))
        self.kind.append(NUMBER if w[0].isdigit() or w[-1].isdigit() else UNIT if w in UNITS else PLAIN)
        self.capital.append(token[0].isupper() or token[0].istitle())
        return n

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._arrays[0] != len(self.folded):
            self._arrays = (len(self.folded), (np.array(self.code, np.uint64), np.array(self.kind, np.int8), np.array(self.capital, bool)))
        return self._arrays[1]

    def read(self, texts: list[str | None]) -> Words:
        if len(self.folded) > self.limit:
            self.forget()
        ids, sizes, caseless, get, add, find = [], [], [], self.number.get, self.add, _TOKEN.findall
        for text in texts:
            t = clean(text) if text else ""
            own = find(t)
            ids += [n if (n := get(w)) is not None else add(w) for w in own]
            sizes.append(len(own))
            caseless.append(t.islower() or t.isupper())
        code, kind, capital = self.arrays()
        raw, size = np.array(ids, np.int64), np.array(sizes, np.int64)
        text = np.repeat(np.arange(len(texts)), size)
        # sentences: an end mark ends one, and so does a text
        end = kind[raw] == END
        word = np.flatnonzero(~end)
        begins = np.append(True, end[:-1]) if len(raw) else np.zeros(0, bool)
        begins[(np.cumsum(size) - size)[size > 0]] = True
        sentence = (np.cumsum(end) - end + text)[word]  # grows with every mark and every text
        raw, text, begins = raw[word], text[word], begins[word]
        kinds = kind[raw]
        high = capital[raw] & ~np.array(caseless, bool)[text] & ~begins & (kinds == PLAIN)
        if high.any():
            starts = high & ~np.append(False, high[:-1] & (sentence[1:] == sentence[:-1]))
            run = np.cumsum(starts) - 1
            length = np.bincount(run[high])
            single = high & (length[np.maximum(run, 0)] == 1)
            n = int(sentence[-1]) + 1
            few = np.bincount(sentence, single, n) <= np.maximum(1, SINGLE_NAMES * np.bincount(sentence, minlength=n))
            kinds[high & (~single | few[sentence])] = NAME
        at = np.arange(len(raw)) + PAD * text
        out = Words(*(np.zeros(len(raw) + PAD * len(texts), d) for d in (np.int64, np.int64, np.uint64, np.int8)))
        count = np.bincount(text, minlength=len(texts)) if len(texts) else np.zeros(0, int)
        out.text[:] = np.repeat(np.arange(len(texts)), count + PAD)
        out.raw[at], out.code[at], out.kind[at] = raw, code[raw], kinds
        return out


def windows(code: np.ndarray, k: int) -> list[tuple[tuple[int, ...], np.ndarray]]:
    """(offsets, hash of the window that begins at each place; 0 where it holds an empty word) for each shape of k words."""
    n = len(code)
    if n == 0:
        return []
    parts = [code * w for w in _WEIGHTS[:k]]
    empty = code == 0
    out = []
    for shape in shapes(k):
        m = n - shape[-1]
        if m <= 0:
            continue
        h, bad = parts[0][:m] + np.uint64(k), empty[:m].copy()
        for p, o in zip(parts[1:], shape[1:]):
            h = h + p[o : o + m]
            bad |= empty[o : o + m]
        h[bad] = 0
        out.append((shape, h))
    return out


def slotted(kind: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Whether the window at each place has a placeholder and, too, enough words of its own: half of them at least."""
    m = len(kind) - shape[-1]
    plain = sum((kind[o : o + m] == PLAIN).astype(np.int8) for o in shape)
    return (plain < len(shape)) & (plain * 2 >= len(shape))


class Filter:
    """Set of window hashes in a bitmap of fixed size, three bits each: tells surely which aren't in it."""

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.log2 = bits, log2

    @staticmethod
    def places(h: np.ndarray, log2: int) -> list[np.ndarray]:
        mask = np.uint64((1 << log2) - 1)
        return [(h >> np.uint64(64 - log2)), (h >> np.uint64(20)) & mask, h & mask]

    def has(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be in the set."""
        at = np.flatnonzero(h)
        for k in range(3):
            x = self.places(h[at], self.log2)[k]
            at = at[(self.bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return at
