"""Queries of page text and sections, and their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpanel.operators import sections as X
from signalpanel.session import table

WANTED = ("1", "1a", "3", "7")


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


def _sections(s: SparkSession, d: str) -> DataFrame:
    """The four usual items of every document, after its markup is removed."""
    return X.parse_sections(_pages(s, d).select("doc_id", X.html_text(F.col("text")).alias("t")), "doc_id", "t", WANTED)


def f18_html(s: SparkSession, d: str) -> DataFrame:
    """Digest of the visible text, inline-XBRL flag and number of tables."""
    return _pages(s, d).select("doc_id", F.md5(X.html_text(F.col("text"))).alias("digest"), *(c.alias(n) for n, c in X.diagnostics(F.col("text")).items()))


def r10_sections(s: SparkSession, d: str) -> DataFrame:
    return _sections(s, d).select("doc_id", "item", "status", "start", "end", "length", "n_headings", "n_contents", F.sha2("body", 256).alias("digest"))


def f21_quality(s: SparkSession, d: str) -> DataFrame:
    q = X.section_quality(_sections(s, d).where("status = 'parsed'"))
    return q.groupBy("item", "flag").agg(F.count("*").alias("n"), F.sum("n_words").alias("n_words"), F.count_if(F.col("flag") == "manual_review").alias("n_excluded"))


def a25_parsing(s: SparkSession, d: str) -> DataFrame:
    """Parsing quality by document: wanted sections found, missing and failed, duplicate headings, characters and share of the text covered, warnings."""
    of = lambda x: F.count_if(F.col("status") == x)
    size = F.length(X.html_text(F.col("text"))).alias("n_text")
    q = _sections(s, d).groupBy("doc_id").agg(of("parsed").alias("n_parsed"), of("missing").alias("n_missing"), of("failed").alias("n_failed"), F.count_if(F.col("n_headings") > 1).alias("n_repeated"), F.sum("n_contents").alias("n_contents"), F.sum("length").alias("n_chars"))
    share = F.round(F.col("n_chars") / F.greatest("n_text", F.lit(1)), 6)
    warnings = F.concat_ws(",", F.when(F.col("n_missing") > 0, "missing_sections"), F.when(F.col("n_failed") > 0, "empty_sections"), F.when(F.col("n_repeated") > 0, "duplicate_headings"))
    return q.join(_pages(s, d).select("doc_id", size), "doc_id").withColumns({"covered": share, "warnings": warnings}).drop("n_text")


def r36_review(s: SparkSession, d: str) -> DataFrame:
    """Sections for manual review: parsed but short, by length and document."""
    q = X.section_quality(_sections(s, d).where("status = 'parsed'"))
    return q.where("flag = 'manual_review'").select("doc_id", "item", "n_words", "length")


_ORD = "[" + ", ".join(f"'{i}'" for i in X.ITEM_ORDER) + "]"
_OPAQUE = "|".join(rf"<{t}(?:[\s/][^>]*)?>.*?(?:</{t}\s*>|\z)" for t in X.OPAQUE)
_HTML = (
    r"""h0 as (select doc_id, text raw, regexp_replace(regexp_replace(regexp_replace(text, '(?is)<!--.*?(?:-->|\z)|@OPAQUE', '', 'g'), '(?i)</?(?:@BLOCKS)(?:[\s/][^>]*)?>', chr(10), 'g'), '</?[A-Za-z][^>]*>|<[!?][^>]*>', '', 'g') t from documents),
h1 as (select doc_id, raw, replace(replace(replace(replace(replace(replace(t, '&#39;', ''''), '&amp;', '&'), '&AMP;', '&'), '&#39;', ''''), '&amp;', '&'), '&AMP;', '&') t from h0),
h2 as (select doc_id, raw, regexp_replace(regexp_replace(regexp_replace(t, '\r\n?|[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '[ \t\x{a0}]+', ' ', 'g'), '(?m)^ | $', '', 'g') t from h1),
html as (select doc_id, raw, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') t from h2)"""
).replace("@OPAQUE", _OPAQUE).replace("@BLOCKS", "|".join(X.BLOCKS))
_SECTIONS = _HTML + (
    r""", lines as (select doc_id, t, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) k from html),
placed as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) pos from lines),
heads as (select doc_id, pos, pos + length(line) st, list_position(@ORD, item) ord, item, regexp_matches(line, '(?:\.{2,}|\s{2,})\s*\d+\s*$') contents
  from (select *, lower(regexp_extract(line, '(?i)^\s*item\s+([0-9]{1,2}[a-z]?)', 1)) item from placed) where list_contains(@ORD, item)),
spans as (select h.*, coalesce(min(g.pos), any_value(length(html.t))) en from heads h join html using (doc_id) left join heads g on g.doc_id = h.doc_id and g.pos > h.pos and g.ord > h.ord group by all),
best as (select doc_id, item, count(*) n_headings, arg_max(st, (en - st, pos)) st, arg_max(en, (en - st, pos)) en from spans where not contents group by 1, 2),
toc as (select doc_id, item, count(*) n_contents from spans where contents group by 1, 2),
cutout as (select best.*, t[cast(st as int) + 1:cast(en as int)] part from best join html using (doc_id)),
bodies as (select *, regexp_replace(part, '^\s+', '') l, regexp_replace(regexp_replace(part, '^\s+', ''), '\s+$', '') body from cutout),
sec as (select html.doc_id, w.item, case when b.doc_id is null then 'missing' when length(body) > 0 then 'parsed' else 'failed' end status, case when length(body) > 0 then cast(st + length(part) - length(l) as int) end "start",
  case when length(body) > 0 then cast(st + length(part) - length(l) + length(body) as int) end "end", cast(coalesce(length(body), 0) as int) "length", case when length(body) > 0 then body end body,
  cast(coalesce(n_headings, 0) as int) n_headings, cast(coalesce(n_contents, 0) as int) n_contents, length(html.t) n_text
  from html cross join (select unnest(@WANTED) item) w left join bodies b on b.doc_id = html.doc_id and b.item = w.item left join toc on toc.doc_id = html.doc_id and toc.item = w.item),
q as (select *, case when n_words < 100 then 'manual_review' when n_words < 500 then 'short' else 'ok' end flag from (select *, cast(len(regexp_extract_all(body, '[A-Za-z][A-Za-z\-'']*')) as int) n_words from sec where status = 'parsed'))"""
).replace("@ORD", _ORD).replace("@WANTED", str(list(WANTED)))
_COUNT = "count(*) filter (status = '{}')"
QUERIES = {
    "F18_F19_html_text": f18_html, "R10_W13_W14_W15_sections": r10_sections, "F21_A24_A32_section_quality": f21_quality, "A25_parsing_quality": a25_parsing, "R36_manual_review": r36_review,
}
ORACLES = {
    "F18_F19_html_text": rf"with {_HTML} select doc_id, md5(t) digest, regexp_matches(raw, '(?i)<\s*ix:') inline_xbrl, cast(len(regexp_extract_all(raw, '(?i)<table\b')) as int) n_tables from html",
    "R10_W13_W14_W15_sections": f'with {_SECTIONS} select doc_id, item, status, "start", "end", "length", n_headings, n_contents, sha256(body) digest from sec',
    "F21_A24_A32_section_quality": f"with {_SECTIONS} select item, flag, count(*) n, cast(sum(n_words) as bigint) n_words, count(*) filter (flag = 'manual_review') n_excluded from q group by 1, 2",
    "R36_manual_review": f"with {_SECTIONS} select doc_id, item, n_words, \"length\" from q where flag = 'manual_review'",
    "A25_parsing_quality": f"""with {_SECTIONS}, c as (select doc_id, {_COUNT.format("parsed")} n_parsed, {_COUNT.format("missing")} n_missing, {_COUNT.format("failed")} n_failed, count(*) filter (n_headings > 1) n_repeated,
cast(sum(n_contents) as bigint) n_contents, cast(sum("length") as bigint) n_chars, max(n_text) n_text from sec group by 1)
select * exclude (n_text), round(n_chars / greatest(n_text, 1), 6) covered, concat_ws(',', case when n_missing > 0 then 'missing_sections' end, case when n_failed > 0 then 'empty_sections' end, case when n_repeated > 0 then 'duplicate_headings' end) warnings from c""",
}
