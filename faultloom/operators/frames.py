"""The metric frame: one row per case, time and node (an entity's metric), and its conversions.

Columns: case_id STRING, t BIGINT, node STRING ("entity_metric"), pos INT (place of the column in the wide form; breaks
ties of ranks), value DOUBLE. A missing reading is a missing row or a null. A frame travels in long form: operators on
columns are then row filters on a per-node aggregate, and cases of any number and width share one job.

What all operators on frames do, unless they say otherwise. A null or missing value is a gap: aggregates leave it out, fills
fill it. A null case_id is a case of its own. A reading is named by (case_id, t, node); where rows repeat it, aggregates
count each, pairs of nodes are made of each, and kernels take the last: once() makes readings unique. Empty frames give
empty results. Columns beyond COLUMNS are ignored or passed on, but for names that begin with two underscores, which
operators use themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COLUMNS = ("case_id", "t", "node", "pos", "value")


def entity(node: Column | str = "node") -> Column:
    return F.split(F.col(node) if isinstance(node, str) else node, "_").getItem(0)


def metric(node: Column | str = "node") -> Column:
    return F.split(F.col(node) if isinstance(node, str) else node, "_").getItem(1)


def steady(score: Column | str) -> Column:
    """A score to ten significant digits: what ranks and ties go by, so that they don't hang on the order of additions."""
    x = F.col(score) if isinstance(score, str) else score
    return F.when(x.isNotNull(), F.format_string("%.9e", x).cast("double"))


def from_wide(df: DataFrame, time: str = "time", case: str | None = None) -> DataFrame:
    """Long frame of a wide one; without case all rows are of case "0". Columns keep their order in pos."""
    nodes = [c for c in df.columns if c not in (time, case)]
    cells = F.array(*[F.struct(F.lit(c).alias("node"), F.lit(k).alias("pos"), F.col(f"`{c}`").cast("double").alias("value")) for k, c in enumerate(nodes)])
    rows = df.select((F.col(case).cast("string") if case else F.lit("0")).alias("case_id"), F.col(time).cast("long").alias("t"), F.explode(cells).alias("x"))
    return rows.select("case_id", "t", "x.node", "x.pos", "x.value")


def to_wide(frame: DataFrame, nodes: list[str] | None = None) -> DataFrame:
    """Wide form; give the nodes to spare the pass that finds them."""
    return frame.groupBy("case_id", "t").pivot("node", nodes).agg(F.first("value")).orderBy("case_id", "t")


def with_positions(rows: DataFrame) -> DataFrame:
    """rows (case_id, t, node, value) with pos by node name within each case."""
    names = rows.select("case_id", "node").distinct()
    placed = names.withColumn("pos", F.row_number().over(Window.partitionBy("case_id").orderBy("node")) - 1)
    return rows.join(placed, ["case_id", "node"]).select(*COLUMNS)


def unpivot_metrics(grouped: DataFrame, entity_col: str, metrics: list[str], case_col: str | None = None) -> DataFrame:
    """Frame of a grouped table (t, entity, one column per metric): a node per entity and metric."""
    cells = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in metrics])
    rows = grouped.select((F.col(case_col).cast("string") if case_col else F.lit("0")).alias("case_id"), "t", F.col(entity_col).alias("e"), F.explode(cells).alias("x"))
    return with_positions(rows.select("case_id", "t", F.concat_ws("_", "e", "x.m").alias("node"), F.col("x.v").alias("value")))


def full_grid(frame: DataFrame) -> DataFrame:
    """A row for every time and node of a case; values that weren't there are null."""
    times, nodes = frame.select("case_id", "t").distinct(), frame.select("case_id", "node", "pos").distinct()
    return times.join(nodes, "case_id").join(frame, ["case_id", "t", "node", "pos"], "left").select(*COLUMNS)


def series() -> Window:
    """Window over a node's readings in time order."""
    return Window.partitionBy("case_id", "node").orderBy("t")


def drop_time(frame: DataFrame, names: tuple[str, ...] = ("time", "time.1", "Time", "timestamp")) -> DataFrame:
    """Nodes that are a time column go, whatever their case; null names stay. Repeated rows stay repeated."""
    return frame.where(F.col("node").isNull() | ~F.lower("node").isin([n.lower() for n in names]))


def column_numbers(frame: DataFrame) -> DataFrame:
    """(case_id, node, number): places 0, 1, ... of each case's nodes by pos, then name; a repeated node counts once."""
    nodes = frame.groupBy("case_id", "node").agg(F.min("pos").alias("pos"))
    return nodes.select("case_id", "node", (F.row_number().over(Window.partitionBy("case_id").orderBy("pos", "node")) - 1).alias("number"))


def running_time(times: DataFrame) -> DataFrame:
    """Mean running time of the cases of each method in (method, case_id, seconds): method, cases, mean_seconds. Nulls don't count."""
    return times.groupBy("method").agg(F.count("seconds").alias("cases"), F.avg("seconds").alias("mean_seconds"))


def once(frame: DataFrame) -> DataFrame:
    """The frame with one row a reading: of repeated ones the largest value, and its place pos; gaps only where all are null."""
    best = frame.groupBy("case_id", "t", "node").agg(F.min("pos").alias("pos"), F.max("value").alias("value"))
    return best.select(*COLUMNS)
