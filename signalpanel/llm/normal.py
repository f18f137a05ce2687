"""Cleaning of received texts: markup, character variants, broken lines, page lines. Plain Python, for use inside Arrow-batched functions."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"<(/?)(p|br|div|li|ul|ol|tr|table|h[1-6]|section|article|body|html|title|hr|td|th)\b[^<>]*>", re.I)
_ANY_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_INVISIBLE = re.compile(r"[­​-‏‪-‮⁠﻿]")
#: Hyphen, line end, and perhaps the hyphen again: a word broken over two lines.
_BROKEN = re.compile(r"[-‐‑](?<=[^\W\d_].)[ \t]*\n[ \t]*(-?)(?=[^\W\d_])")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff]+")
_PAGE = re.compile(r"^[ \t]*(?:[-–—=*]+[ \t]*)?(?:(?:page|seite|p[aá]gina|pag\.|p\.|blz\.|ページ)[ \t]*)?\d{1,4}(?:[ \t]*(?:/|of|von|de|di|van)[ \t]*\d{1,4})?(?:[ \t]*(?:ページ|[-–—=*]+))?[ \t]*$", re.I)
#: Longest page line looked for, in characters without the blanks and dashes around it.
_PAGE_CHARS, _BLANK = 40, " \t-–—=*"
_FOLD = str.maketrans({"ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


def plain_forms(text: str) -> str:
    """The text with full-width and other compatibility forms as plain ones, and without marks that belong to no letter form."""
    if text.isascii():
        return text
    # the acute accent that stands alone would become a blank
    return _MARKS.sub("", unicodedata.normalize("NFKC", text.replace("´", "'")))


def clean(text: str) -> str:
    """Text in plain forms of its characters, without tags, entities, invisible characters and page lines; words broken over lines joined; paragraphs end in two line ends."""
    text = plain_forms(text)
    if "<" in text:
        text = _ANY_TAG.sub("", _TAG.sub("\n\n", text))
    if "&" in text:
        text = plain_forms(html.unescape(text))
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\n" in text:
        text = _BROKEN.sub(r"\1", text)
    lines = text.split("\n")
    pages = [k for k, x in enumerate(lines) if x and (len(x) < _PAGE_CHARS or len(x.strip(_BLANK)) < _PAGE_CHARS) and _PAGE.match(x)]
    for k in pages:
        lines[k] = ""
    return "\n".join(lines) if pages else text


def fold(text: str) -> str:
    """Lower case, compatibility forms, no accents: all combining marks vanish but the Kana's."""
    text = text.lower()
    if text.isascii():
        return text
    parts = unicodedata.normalize("NFKD", text.translate(_FOLD))
    return unicodedata.normalize("NFC", "".join(c for c in parts if not unicodedata.combining(c) or c in "\u3099\u309a"))
