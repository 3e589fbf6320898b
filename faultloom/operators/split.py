"""Row filters and splits (F): every side is a flag or a filter on one pass, never two copies of a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def after(inject: int | Column) -> Column:
    """anomalous from the injection on."""
    return F.col("t") >= inject


def times(frame: DataFrame) -> DataFrame:
    """The times of each case, numbered from 1 (up) and from the end (down)."""
    own = Window.partitionBy("case_id")
    return frame.select("case_id", "t").distinct().withColumn("up", F.row_number().over(own.orderBy("t"))).withColumn("down", F.row_number().over(own.orderBy(F.desc("t"))))


def of_times(frame: DataFrame, wanted: DataFrame) -> DataFrame:
    return frame.join(wanted.select("case_id", "t"), ["case_id", "t"], "left_semi")


def by_index(frame: DataFrame, first: int) -> DataFrame:
    """the frame with anomalous = false on the first times of each case."""
    return frame.join(times(frame).select("case_id", "t", (F.col("up") > first).alias("anomalous")), ["case_id", "t"])


def symmetric(frame: DataFrame, inject: int, length: int) -> DataFrame:
    """the last length times before the injection and the first length from it on."""
    side = frame.select("case_id", "t").distinct().withColumn("a", after(inject))
    near = Window.partitionBy("case_id", "a").orderBy(F.abs(F.col("t") - inject), "t")
    return of_times(frame, side.withColumn("n", F.row_number().over(near)).where(F.col("n") <= length))


def equal_lengths(frame: DataFrame, inject: int) -> DataFrame:
    """as many times on both sides: the last normal ones and the first anomalous ones."""
    side = frame.select("case_id", "t").distinct().withColumn("a", after(inject))
    near = Window.partitionBy("case_id", "a").orderBy(F.abs(F.col("t") - inject), "t")
    own = Window.partitionBy("case_id")
    sizes = F.least(F.sum(F.when(F.col("a"), 1).otherwise(0)).over(own), F.sum(F.when(F.col("a"), 0).otherwise(1)).over(own))
    return of_times(frame, side.withColumn("n", F.row_number().over(near)).withColumn("m", sizes).where(F.col("n") <= F.col("m")))


def prefix(frame: DataFrame, length: int) -> DataFrame:
    """F5."""
    return of_times(frame, times(frame).where(F.col("up") <= length))


def train_flag(frame: DataFrame, share: float = 0.7) -> DataFrame:
    """train = true on the first share of each case's times."""
    own = times(frame)
    return frame.join(own.select("case_id", "t", (F.col("up") <= F.floor(share * (F.col("up") + F.col("down") - 1))).alias("train")), ["case_id", "t"])


def between(frame: DataFrame, start: int, end: int) -> DataFrame:
    """F7."""
    return frame.where(F.col("t").between(start, end))


def delayed(inject: int | Column, delta: int) -> int | Column:
    """F8."""
    return inject + delta


def choose_indicator(frame: DataFrame, service: str, default: str) -> DataFrame:
    """sli of each case: <service>_latency, else <service>_lat_90, else the default."""
    has = lambda name: F.bool_or(F.col("node") == name)
    sli = F.when(has(f"{service}_latency"), f"{service}_latency").when(has(f"{service}_lat_90"), f"{service}_lat_90").otherwise(default)
    return frame.groupBy("case_id").agg(sli.alias("sli"))


def top(ranks: DataFrame, k: int) -> DataFrame:
    """F10."""
    return ranks.where(F.col("rank") <= k)
