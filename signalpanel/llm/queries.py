"""Queries of the text problems p6 to p8, each over its whole tables, and the reference SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpanel.llm.contamination import MIN_SHARE, find_leaks
from signalpanel.llm.language import label_language, text_languages
from signalpanel.llm.packing import count_tokens, pack
from signalpanel.session import table


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    # texts are read only where the count is missing
    counted = count_tokens(F.when(F.col("n_tokens").isNull(), F.col("text")))
    return docs.select("doc_id", F.coalesce(F.col("n_tokens").cast("long"), counted).alias("n"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(_sizes(spark, d), "doc_id", "n", table(spark, d, "pack_budgets"), "budget_id", "capacity_tokens")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Each document's container, for each budget."""
    return _packed(spark, d)


def p6_unused(spark: SparkSession, d: str) -> DataFrame:
    """Containers, their fewest possible number, and the unused room, by budget."""
    budgets = table(spark, d, "pack_budgets")
    each = _packed(spark, d).groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("used"))
    n = each.groupBy("budget_id").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    cap = F.col("capacity_tokens").cast("long")
    return n.join(budgets, "budget_id").select("budget_id", cap.alias("capacity"), "n_containers", F.ceil(F.col("n_tokens") / cap).alias("least_containers"), "n_tokens", (F.col("n_containers") * cap - F.col("n_tokens")).alias("unused"), "fullest")


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any answer, by budget: documents and tokens placed, documents in more than their whole containers, containers over capacity."""
    sizes = _sizes(spark, d)
    pieces = _packed(spark, d).join(table(spark, d, "pack_budgets").select("budget_id", F.col("capacity_tokens").cast("long").alias("cap")), "budget_id")
    docs = pieces.groupBy("budget_id", "cap", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("placed"), F.countDistinct("container_id").alias("c"))
    docs = docs.join(sizes, "doc_id", "left").groupBy("budget_id").agg(
        F.count("*").alias("n_documents"), F.sum("placed").alias("n_tokens"), F.count_if(F.col("placed") != F.col("n")).alias("n_wrong_size"),
        F.count_if((F.col("k") != F.ceil(F.col("n") / F.col("cap"))) | (F.col("k") != F.col("c"))).alias("n_split"),
    )
    full = pieces.groupBy("budget_id", "cap", "container_id").agg(F.sum("n_tokens").alias("used")).groupBy("budget_id").agg(F.count_if(F.col("used") > F.col("cap")).alias("n_overfull"))
    return docs.join(full, "budget_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold enough of an evaluation item's own words, with the item; the operator's other rows are re-parameterised copies."""
    return _leaks(spark, d).where(F.col("share") >= MIN_SHARE).select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """The same with the share held, the stretches and the replaced slots."""
    return _leaks(spark, d).withColumns({"share": F.round("share", 6), "template_share": F.round("template_share", 6)})


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return text_languages(table(spark, d, "documents"), "doc_id", "text", "lang")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of documents whose label is missing, wrong, or one of several languages."""
    whole = _spans(spark, d).where("whole").groupBy("doc_id").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    labels = table(spark, d, "documents").select("doc_id", label_language(F.col("lang")).alias("label"))
    cases = whole.join(labels, "doc_id").where((F.size("langs") > 1) | (F.col("langs")[0] != F.col("label")))
    return cases.select("doc_id", F.explode("langs").alias("lang")).distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every document's stretches of one language, with confidence."""
    return _spans(spark, d).withColumn("confidence", F.round("confidence", 6))


QUERIES = {f.__name__: f for f in (p6_containers, p6_unused, p6_invariants, p7_found, p7_leaks, p8_found, p8_spans)}
#: Packing, alignment and span labelling have no SQL; tests hold them against brute force. What any packing must fulfil has.
ORACLES: dict[str, str] = {
    "p6_invariants": r"""with sizes as (select doc_id, coalesce(n_tokens, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{1c}-\x{1f}\x{85}\x{0b}]+'))) n from documents)
select budget_id, count(*) n_documents, cast(sum(n) as bigint) n_tokens, cast(0 as bigint) n_wrong_size, cast(0 as bigint) n_split, cast(0 as bigint) n_overfull from sizes cross join pack_budgets where n > 0 group by 1""",
}
