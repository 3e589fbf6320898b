"""Metric frames derived from the relational test tables, in Spark and as the SQL that gives the same rows.

ev: hours of events, an entity per event type (case 0). user: days of events, a case per user. ord: days of orders, an
entity per priority. li: days of lineitem, an entity per flag and status. Times count hours or days from 1970-01-01.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import unpivot_metrics

#: Injection times: 2024-01-20 in hours and days, 2000-01-01 in days.
EV, USER, OLD = 19742 * 24, 19742, 10957


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(ts: str) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = (day("ts") * 24 + F.hour("ts")).alias("t")
    return unpivot_metrics(table(spark, sf_dir, "events").groupBy(t, "event_type").agg(F.count("*").alias("cnt"), F.avg("value").alias("lat"), F.max("value").alias("max")), "event_type", ["cnt", "lat", "max"])


def user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", day("ts").alias("t"), "event_type").agg(F.count("*").alias("cnt"), F.sum("value").alias("sum"))
    return unpivot_metrics(rows, "event_type", ["cnt", "sum"], "user_id")


def ord_(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(day("o_orderdate").alias("t"), F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]", "").alias("e")).agg(F.count("*").alias("cnt"), F.sum("o_totalprice").alias("total"))
    return unpivot_metrics(rows, "e", ["cnt", "total"])


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(day("l_shipdate").alias("t"), F.concat("l_returnflag", "l_linestatus").alias("e"))
    return unpivot_metrics(rows.agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("disc")), "e", ["qty", "price", "disc"])


def _sql(case: str, t: str, e: str, source: str, metrics: dict[str, str]) -> str:
    parts = " UNION ALL ".join(f"SELECT c, t, e || '_{m}' AS node, CAST(m_{m} AS DOUBLE) AS value FROM g" for m in metrics)
    aggregates = ", ".join(f"{x} AS m_{m}" for m, x in metrics.items())
    return f"(WITH g AS (SELECT {case} AS c, {t} AS t, {e} AS e, {aggregates} FROM {source} GROUP BY 1, 2, 3), l AS ({parts}) SELECT CAST(c AS VARCHAR) AS case_id, CAST(t AS BIGINT) AS t, node, dense_rank() OVER (PARTITION BY c ORDER BY node) - 1 AS pos, value FROM l)"


def _day(ts: str) -> str:
    return f"date_diff('day', DATE '1970-01-01', CAST({ts} AS DATE))"


SQL = {
    "ev": _sql("0", f"{_day('ts')} * 24 + extract('hour' FROM ts)", "event_type", "events", {"cnt": "count(*)", "lat": "avg(value)", "max": "max(value)"}),
    "usr": _sql("user_id", _day("ts"), "event_type", "events", {"cnt": "count(*)", "sum": "sum(value)"}),
    "ord": _sql("0", _day("o_orderdate"), "regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g')", "orders", {"cnt": "count(*)", "total": "sum(o_totalprice)"}),
    "li": _sql("0", _day("l_shipdate"), "l_returnflag || l_linestatus", "lineitem", {"qty": "sum(l_quantity)", "price": "sum(l_extendedprice)", "disc": "avg(l_discount)"}),
}
