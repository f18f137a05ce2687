"""Domain tables derived from the shared ones, once as DataFrames and once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpanel.session import table

#: ticker x date prices: the quantity-weighted price of a supplier's line items of a day.
PANEL_SQL = "panel as (select l_suppkey ticker, cast(l_shipdate as date) date, round(sum(l_extendedprice) / sum(l_quantity) + 1e-8, 6) price from lineitem group by 1, 2)"
#: One event for each order: its first line's supplier on the order date, scored by the order's size.
EVENTS_SQL = "events0 as (select o_orderkey doc_id, l_suppkey ticker, cast(o_orderdate as date) event_date, round(o_totalprice / 10000, 1) yhat, round(l_extendedprice / 1000 - 20, 2) y, l_quantity yhat2 from orders join (select l_orderkey, min(l_suppkey) l_suppkey, max(l_extendedprice) l_extendedprice, max(l_quantity) l_quantity from lineitem where l_linenumber = 1 group by 1) on o_orderkey = l_orderkey)"
META_SQL = "meta as (select s_suppkey ticker, case when n_nationkey % 7 = 0 then '' else n_name end industry, r_name sector, case when s_acctbal > 0 then s_acctbal end cap from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
#: Two models' predictions by split (year) and role.
SCORED_SQL = f"""{EVENTS_SQL}, {META_SQL},
scored as (select 'm1::y::' || year(event_date) model_id, 'm1' model, year(event_date) split_id, case when year(event_date) >= 1999 then 'test' else 'validation' end role, doc_id, e.ticker, event_date, y, yhat, industry, sector, cap
  from events0 e join meta m on e.ticker = m.ticker
union all select 'm2::y::' || year(event_date), 'm2', year(event_date), case when year(event_date) >= 1999 then 'test' else 'validation' end, doc_id, e.ticker, event_date, y, yhat2, industry, sector, cap
  from events0 e join meta m on e.ticker = m.ticker)"""


def panel(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date")).agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity") + 1e-8, 6).alias("price"))


def events(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("l_suppkey"), F.max("l_extendedprice").alias("l_extendedprice"), F.max("l_quantity").alias("l_quantity"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return o.join(first, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("doc_id"), F.col("l_suppkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("event_date"),
        F.round(F.col("o_totalprice") / 10000, 1).alias("yhat"), F.round(F.col("l_extendedprice") / 1000 - 20, 2).alias("y"), F.col("l_quantity").alias("yhat2"),
    )


def meta(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    j = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    industry = F.when(F.col("n_nationkey") % 7 == 0, "").otherwise(F.col("n_name"))
    return j.select(F.col("s_suppkey").alias("ticker"), industry.alias("industry"), F.col("r_name").alias("sector"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("cap"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).join(meta(spark, d), "ticker")
    e = e.withColumns({"split_id": F.year("event_date"), "role": F.when(F.year("event_date") >= 1999, "test").otherwise("validation")})
    both = F.inline(F.array(F.struct(F.lit("m1").alias("model"), F.col("yhat").cast("double").alias("p")), F.struct(F.lit("m2").alias("model"), F.col("yhat2").cast("double").alias("p"))))
    rows = e.select("split_id", "role", "doc_id", "ticker", "event_date", "y", "industry", "sector", "cap", both)
    return rows.select(F.concat_ws("::", "model", F.lit("y"), F.col("split_id").cast("string")).alias("model_id"), "*").withColumnRenamed("p", "yhat")
