"""Cleaning: gaps, resampling, normalisation (N), and column rules (P) as filters on per-node aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import COLUMNS, drop_time, series

#: Prefixes of nodes that are not services, and the infix of an external one.
EXTRA_PREFIXES = ("main_", "PassthroughCluster_", "redis_", "rabbitmq", "queue", "session", "istio-proxy")
EXTRA_INFIX = "frontend-external"


def finite(value: Column | str = "value") -> Column:
    """value, with NaN and infinities as null."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def forward_fill(frame: DataFrame, zero: bool = True) -> DataFrame:
    """Infinities and NaN are gaps; gaps take the last reading; with zero, what is left is 0."""
    last = F.last(finite(), ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))
    return frame.withColumn("value", F.coalesce(last, F.lit(0.0)) if zero else last)


def fill_both(frame: DataFrame) -> DataFrame:
    """Gaps take the next reading, else the last one, else 0."""
    v = finite()
    after = F.first(v, ignorenulls=True).over(series().rowsBetween(0, Window.unboundedFollowing))
    before = F.last(v, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))
    return frame.withColumn("value", F.coalesce(after, before, F.lit(0.0)))


def absolute(frame: DataFrame) -> DataFrame:
    """N4."""
    return frame.withColumn("value", F.abs("value"))


def resample(frame: DataFrame, start: int, end: int, interval: int) -> DataFrame:
    """Means on the grid start, start + interval, ... <= end; gaps are interpolated in time, ends take the nearest."""
    inside = frame.where(F.col("t").between(start, end)).withColumn("t", F.lit(start) + F.floor((F.col("t") - start) / interval) * interval)
    means = inside.groupBy("case_id", "node", "pos", "t").agg(F.avg(finite()).alias("value"))
    grid = frame.select("case_id", "node", "pos").distinct().withColumn("t", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end).cast("long"), F.lit(interval).cast("long"))))
    rows = grid.join(means, ["case_id", "node", "pos", "t"], "left")
    known = F.when(F.col("value").isNotNull(), F.struct("t", "value"))
    back = F.last(known, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(known, ignorenulls=True).over(series().rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("__b", back).withColumn("__a", ahead)
    slope = (F.col("__a.value") - F.col("__b.value")) / (F.col("__a.t") - F.col("__b.t"))
    between = F.when(F.col("__a.t") == F.col("__b.t"), F.col("__b.value")).otherwise(F.col("__b.value") + slope * (F.col("t") - F.col("__b.t")))
    return rows.withColumn("value", F.coalesce(between, "__b.value", "__a.value")).select(*COLUMNS)


def look_back(frame: DataFrame, detect: int, lookup: int, current: int, interval: int = 1, prune: bool = True) -> DataFrame:
    """The window [detect - lookup, current] on its grid; constant nodes go (prune) or gaps become 0."""
    out = resample(frame, detect - lookup, current, interval)
    return keep_nodes(out, F.count_distinct("value") > 1) if prune else out.fillna(0.0, ["value"])


def normalise(frame: DataFrame) -> DataFrame:
    """(x - mean) / sample deviation of each node; a constant node has null."""
    own = Window.partitionBy("case_id", "node")
    return frame.withColumn("value", (F.col("value") - F.avg("value").over(own)) / F.nullif(F.stddev_samp("value").over(own), F.lit(0.0)))


def centre(frame: DataFrame) -> DataFrame:
    """N8."""
    return frame.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("case_id", "node")))


def moving_average(frame: DataFrame, width: int = 25) -> DataFrame:
    """Trend and residual by a centred mean in which the first and the last reading stand in beyond the ends."""
    half, own = width // 2, Window.partitionBy("case_id", "node")
    w = series()
    n, size = F.row_number().over(w), F.count("*").over(own)
    total = F.sum("value").over(w.rowsBetween(-half, half))
    first, last = F.first("value").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("value").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    trend = (total + first * F.greatest(F.lit(half) + 1 - n, F.lit(0)) + last * F.greatest(n + half - size, F.lit(0))) / width
    return frame.withColumn("trend", trend).withColumn("residual", F.col("value") - F.col("trend"))


def trailing_mean(frame: DataFrame, depth: int) -> DataFrame:
    """Mean of the last depth readings, from the depth-th on."""
    out = frame.withColumn("value", F.avg("value").over(series().rowsBetween(1 - depth, 0))).withColumn("__n", F.row_number().over(series()))
    return out.where(F.col("__n") >= depth).drop("__n")


def standardise(frame: DataFrame, train: Column) -> DataFrame:
    """Z-scores by mean and population deviation of the rows where train holds; a zero deviation counts as 1."""
    own = Window.partitionBy("case_id", "node")
    v = F.when(train, F.col("value"))
    spread = F.stddev_pop(v).over(own)
    return frame.withColumn("value", (F.col("value") - F.avg(v).over(own)) / F.when(spread > 0, spread).otherwise(1.0))


def keep_nodes(frame: DataFrame, condition: Column) -> DataFrame:
    """Rows of the nodes whose aggregate meets condition: one small aggregate and a semi join."""
    kept = frame.groupBy("case_id", "node").agg(condition.alias("__ok")).where("__ok").select("case_id", "node")
    return frame.join(kept, ["case_id", "node"], "left_semi")


def _first() -> Column:
    return F.min_by("value", "t")


def drop_constant(frame: DataFrame, nulls: bool = True) -> DataFrame:
    """Nodes whose every value equals the first one go; with nulls a gap counts as different (so all-gap nodes stay).

    One aggregate decides. NaN equals NaN; repeated rows and the order of equal times make no difference.
    """
    gap = F.bool_or(F.col("value").isNull())
    differs = F.coalesce(F.min("value") != F.max("value"), F.lit(False))
    return keep_nodes(frame, differs | gap if nulls else differs)


def drop_single_valued(frame: DataFrame) -> DataFrame:
    """Nodes with exactly one distinct value go, gaps not counted."""
    return keep_nodes(frame, F.count_distinct("value") != 1)


def drop_near_constant(frame: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Nodes stay if more than threshold of their rows differ from the first."""
    stats = frame.groupBy("case_id", "node").agg(F.min_by("value", "t").alias("__f"))
    rows = frame.join(stats, ["case_id", "node"])
    share = F.avg(F.when(F.col("value") == F.col("__f"), 0.0).otherwise(1.0))
    kept = rows.groupBy("case_id", "node").agg((share > threshold).alias("__ok")).where("__ok")
    return frame.join(kept, ["case_id", "node"], "left_semi")


def drop_extra(frame: DataFrame) -> DataFrame:
    """Nodes that aren't services go, and a repeated time column."""
    name = F.col("node")
    bad = (name == "time.1") | name.contains(EXTRA_INFIX)
    for prefix in EXTRA_PREFIXES:
        bad = bad | name.startswith(prefix)
    return frame.where(~bad)


def memory_in_mb(frame: DataFrame, whole: bool = False) -> DataFrame:
    """Values of *_mem nodes in millions, truncated if whole."""
    scaled = F.col("value") / 1e6
    return frame.withColumn("value", F.when(F.col("node").endswith("_mem"), scaled.cast("long").cast("double") if whole else scaled).otherwise(F.col("value")))


def select_latency(frame: DataFrame, percentile: int = 90) -> DataFrame:
    """Of latency nodes only those of one percentile stay."""
    return frame.where(~F.col("node").rlike("_lat_\\d+$|_latency-\\d+$") | F.col("node").rlike(f"(_lat_|_latency-){percentile}$"))


def select_useful(frame: DataFrame) -> DataFrame:
    """*_cpu and *_mem nodes with a sample deviation over 1, and *lat50* nodes with one of 1000 x over 10."""
    name, spread = F.col("node"), F.stddev_samp("value")
    return keep_nodes(frame, F.max(F.when(name.rlike("_(cpu|mem)$"), 1).when(name.contains("lat50"), 2).otherwise(0)).eqNullSafe(1) & (spread > 1) | F.max(F.when(name.contains("lat50"), 1).otherwise(0)).eqNullSafe(1) & (spread * 1000 > 10))


def select_varying(frame: DataFrame, least: float = 1.0) -> DataFrame:
    """Nodes with a sample deviation over least."""
    return keep_nodes(frame, F.coalesce(F.stddev_samp("value") > least, F.lit(False)))


def on_both_sides(frame: DataFrame, anomalous: Column) -> DataFrame:
    """P10: nodes with readings on both sides."""
    return keep_nodes(frame, F.coalesce(F.bool_or(anomalous) & F.bool_or(~anomalous), F.lit(False)))


def varying_on_both_sides(frame: DataFrame, anomalous: Column) -> DataFrame:
    """P1 on each side, then P10, in one pass."""
    side = F.when(anomalous, 1).otherwise(0)
    first = frame.groupBy("case_id", "node", side.alias("__s")).agg((F.min("value") != F.max("value")).alias("__v"))
    kept = first.groupBy("case_id", "node").agg((F.sum(F.when(F.col("__v"), 1).otherwise(0)) == 2).alias("__ok")).where("__ok")
    return frame.join(kept, ["case_id", "node"], "left_semi")


def suffix_filter(frame: DataFrame, drop: tuple[str, ...] = ("_lat_50", "_lat_99"), keep_prefix: str | None = None) -> DataFrame:
    """P12."""
    out = frame
    for suffix in drop:
        out = out.where(~F.col("node").endswith(suffix))
    return out.where(F.col("node").startswith(keep_prefix)) if keep_prefix else out


def rename(frame: DataFrame, prefix: str = "") -> DataFrame:
    """A prefix, and _latency-90 as _latency; _latency-50 goes."""
    kept = frame.where(~F.col("node").endswith("latency-50"))
    return kept.withColumn("node", F.concat(F.lit(prefix), F.regexp_replace("node", "_latency-90$", "_latency")))


def preprocess(frame: DataFrame, dataset: str | None, useful: bool = False) -> DataFrame:
    """None and the time-only dataset keep all nodes; others lose constants, memory is scaled, useful selects."""
    if dataset is None or dataset == "causalrca-sock-shop":
        return frame
    out = memory_in_mb(drop_constant(frame))
    return select_useful(drop_near_constant(drop_extra(out))) if useful else out


def sock_shop(frame: DataFrame) -> DataFrame:
    """P6."""
    return suffix_filter(memory_in_mb(drop_near_constant(drop_constant(frame))), ("lat_50", "lat_99"))


def latency_sock_shop(frame: DataFrame, anomalous: Column, percentile: int = 90, useful: bool = False) -> DataFrame:
    """Whole memory in millions, one latency percentile, nodes that vary on both sides; useful selects among them."""
    out = varying_on_both_sides(select_latency(memory_in_mb(drop_time(frame), whole=True), percentile), anomalous)
    return select_useful(out) if useful else out


def infer_types(frame: DataFrame, most: int = 20) -> DataFrame:
    """Kind (cont or disc) and number of values of each node: more than most distinct values are continuous."""
    out = frame.groupBy("case_id", "node", "pos").agg(F.count_distinct("value").alias("n_values"))
    return out.withColumn("kind", F.when(F.col("n_values") > most, "cont").otherwise("disc"))


def encode(frame: DataFrame) -> DataFrame:
    """Codes 0, 1, ... of each node's values in order of first appearance."""
    first = frame.where("value is not null").groupBy("case_id", "node", "value").agg(F.min("t").alias("__t"))
    coded = first.withColumn("code", F.row_number().over(Window.partitionBy("case_id", "node").orderBy("__t", "value")) - 1)
    return frame.join(coded.drop("__t"), ["case_id", "node", "value"])


def one_hot(frame: DataFrame) -> DataFrame:
    """A node per node and value, 1 where the node has it."""
    values = frame.where("value is not null").select("case_id", "node", F.col("value").alias("__v")).distinct()
    rows = frame.join(values, ["case_id", "node"])
    return rows.select("case_id", "t", F.concat_ws("=", "node", F.col("__v").cast("string")).alias("node"), "pos", F.coalesce((F.col("value") == F.col("__v")).cast("double"), F.lit(0.0)).alias("value"))
