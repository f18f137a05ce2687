"""Text of marked-up filings and the sections of annual ones, as expressions within the row: no shuffle, and no Python."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalpanel.operators.features import tokens

#: Elements whose content is no text, elements that begin and end lines, and the order of the items of an annual filing.
OPAQUE = ("script", "style", "noscript")
BLOCKS = (
    "address", "article", "aside", "blockquote", "br", "caption", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p",
    "pre", "section", "table", "td", "th", "tr", "ul",
)
ITEM_ORDER = ("1", "1a", "1b", "1c", "2", "3", "4", "5", "6", "7", "7a", "8", "9", "9a", "9b", "9c", "10", "11", "12", "13", "14", "15", "16")
#: Fixed patterns: a heading line, and the page number at the end of a line of a table of contents.
HEADING, CONTENTS = r"(?i)^\s*item\s+([0-9]{1,2}[a-z]?)\s*[.\-:–—]?\s*(.*?)\s*$", r"(?:\.{2,}|\s{2,})\s*\d+\s*$"
#: The same in all lines of a text that opens and closes with a line end, the heading's line as the match.
_HEADING_LINES = r"(?im)^[^\S\n]*item[^\S\n]+[0-9]{1,2}[a-z]?(?![0-9a-z])[^\n]*$"
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
_WORDS = {"manual_review": 100, "short": 500}


def decode_entities(text: Column) -> Column:
    """Entities that end in a semicolon as their characters: decimal, hexadecimal and the standard names; unknown ones stay.

    One at a time over the distinct entities of the text, the ampersand's last, so that what it uncovers isn't decoded as well.
    """
    names = F.create_map(*[F.lit(x) for k, v in html.entities.html5.items() if k.endswith(";") for x in (k[:-1], v)])
    body = lambda e: F.regexp_replace(e, "^&#?|;$", "")

    def char(e: Column) -> Column:
        b = body(e)
        code = F.when(F.lower(F.substring(b, 1, 1)) == "x", F.conv(F.substring(b, 2, 7), 16, 10).cast("int")).otherwise(b.try_cast("int"))
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(F.when(F.substring(e, 2, 1) == "#", numeric).otherwise(F.try_element_at(names, b)), e)

    found = F.array_distinct(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)))
    last = lambda e: F.lower(e).isin("&amp;", "&#38;", "&#x26;")
    ordered = F.concat(F.filter(found, lambda e: ~last(e)), F.filter(found, last))
    return F.aggregate(ordered, text, lambda t, e: F.replace(t, e, char(e)))


def html_text(page: Column) -> Column:
    """Visible text: opaque elements and comments dropped, line ends around block elements, other tags dropped, entities decoded twice, blanks collapsed
    within lines, at most one blank line running. Null for null; a text without markup keeps its words and lines. An opaque element or comment without an end runs to
    the text's end.
    """
    t = F.regexp_replace(page, rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(OPAQUE)})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\z)", "")
    t = F.regexp_replace(t, rf"(?i)</?(?:{'|'.join(BLOCKS)})(?=[\s/>])[^>]*>", "\n")
    t = F.regexp_replace(t, r"</?[A-Za-z][^>]*>|<[!?][^>]*>", "")
    t = F.when(page.contains("<"), t).otherwise(page)
    # within lambdas, so that neither the text's expression nor the table of names is written out again for every use
    once = lambda x: F.element_at(F.transform(F.array(x), decode_entities), 1)
    t = F.when(t.contains("&"), F.element_at(F.transform(F.array(t), lambda x: once(decode_entities(x))), 1)).otherwise(t)
    t = F.regexp_replace(t, r"\r\n?|[\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]", "\n")
    # only runs that change are matched; then no line has more than one blank at either end
    t = F.regexp_replace(t, r"[ \t\x{a0}]{2,}|[\t\x{a0}]", " ")
    t = F.replace(F.replace(t, F.lit("\n "), F.lit("\n")), F.lit(" \n"), F.lit("\n"))
    return F.btrim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(" \t\n\x0b\x0c\r"))


def diagnostics(page: Column) -> dict[str, Column]:
    """inline_xbrl: the page has an inline-XBRL tag; n_tables: opening table tags."""
    return {"inline_xbrl": page.rlike(r"(?i)<\s*ix:"), "n_tables": F.regexp_count(page, F.lit(r"(?i)<table\b"))}


def heading_lines(text: Column) -> Column:
    """array<struct<pos, start, ord, item, contents>>: where each heading's line begins and ends (from 0), the item's place in the filing, and whether it is a line of contents."""
    order = F.create_map(*[F.lit(x) for k, i in enumerate(ITEM_ORDER) for x in (i, k)])
    framed = F.concat(F.lit("\n"), text, F.lit("\n"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,line:string>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        at = F.call_function("locate", F.concat(F.lit("\n"), line, F.lit("\n")), framed, acc["at"] + 1)
        return F.struct((at - 1).alias("at"), F.array_append(acc["out"], F.struct((at - 1).alias("pos"), line.alias("line"))).alias("out"))

    found = F.aggregate(F.regexp_extract_all(text, F.lit(_HEADING_LINES), F.lit(0)), begin, step, lambda acc: acc["out"])
    item = lambda x: F.lower(F.regexp_extract(x["line"], HEADING, 1))
    heads = F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), (x["pos"] + F.length(x["line"])).alias("start"), F.try_element_at(order, item(x)).alias("ord"), item(x).alias("item"), x["line"].rlike(CONTENTS).alias("contents")))
    return F.filter(heads, lambda x: x["ord"].isNotNull())


def parse_sections(docs: DataFrame, doc_id: str, text: str, wanted: tuple[str, ...]) -> DataFrame:
    """doc_id, item, status, start, end, length, body, n_headings, n_contents for each document and wanted item.

    Headings are lines ``Item N``. A heading's span ends at the next later heading of a higher item, lines of contents included, else at the text's
    end; of several headings of an item, lines of contents apart, the longest span (then the latest) is the section. start and end are those of the
    body without blanks around it (from 0); they and the body are null if there is no heading (``missing``) or nothing after it (``failed``). n_headings
    above 1 is a duplicate heading. A null text has no headings. Repeated documents give repeated rows. Map-only: everything happens within the row.
    """
    t = docs.select(F.col(doc_id).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    heads = F.when(F.col("t").rlike(_HEADING_LINES), heading_lines(F.col("t"))).otherwise(F.filter(heading_lines(F.lit("")), lambda x: F.lit(False)))
    t = t.withColumn("hs", heads)
    end = lambda x: F.coalesce(F.array_min(F.transform(F.filter("hs", lambda h: (h["pos"] > x["pos"]) & (h["ord"] > x["ord"])), lambda h: h["pos"])), F.length("t"))
    spans = F.transform("hs", lambda x: F.struct((end(x) - x["start"]).alias("size"), x["pos"].alias("pos"), x["start"].alias("start"), end(x).alias("end"), x["item"].alias("item"), x["contents"].alias("contents")))
    t = t.withColumn("spans", spans).withColumn("item", F.explode(F.array(*[F.lit(i) for i in wanted])))
    own = F.filter("spans", lambda x: x["item"] == F.col("item"))
    t = t.withColumns({"own": F.filter(own, lambda x: ~x["contents"]), "n_contents": F.size(F.filter(own, lambda x: x["contents"]))}).withColumn("best", F.array_max("own"))
    t = t.withColumn("raw", F.substring("t", F.col("best.start") + 1, F.col("best.end") - F.col("best.start")))
    t = t.withColumn("left", F.regexp_replace("raw", r"^\s+", "")).withColumn("body", F.regexp_replace("left", r"\s+$", ""))
    parsed = F.length("body") > 0
    start = F.when(parsed, F.col("best.start") + F.length("raw") - F.length("left"))
    status = F.when(F.col("best").isNull(), "missing").when(parsed, "parsed").otherwise("failed")
    return t.select(
        F.col("d").alias(doc_id), "item", status.alias("status"), start.alias("start"), (start + F.length("body")).alias("end"), F.coalesce(F.length("body"), F.lit(0)).alias("length"),
        F.when(parsed, F.col("body")).alias("body"), F.size("own").alias("n_headings"), "n_contents",
    )


def section_quality(sections: DataFrame) -> DataFrame:
    """Word count and flag of each section: under 100 words manual_review, under 500 short, else ok."""
    n = F.size(tokens("body"))
    flag = F.lit("ok")
    for name, least in reversed(_WORDS.items()):
        flag = F.when(n < least, name).otherwise(flag)
    return sections.withColumns({"n_words": n, "flag": flag})
