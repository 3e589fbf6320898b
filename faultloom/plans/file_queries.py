"""Named queries over files: a test table is written to the shared folder in a source's format and read back by the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import split, stats
from ..session import shared_path
from ..sources import files
from . import tables
from .queries import frame_out, frame_sql, halves, query, r, scored_sql
from .tables import EV, OLD, USER


def one_file(df: DataFrame, path: str, header: bool = True) -> str:
    """Write df as one CSV file, whose rows keep the order of df's first column; returns path."""
    spark, parts = df.sparkSession, f"{path}.parts"
    df.coalesce(1).sortWithinPartitions(df.columns[0]).write.csv(parts, header=header)
    jvm = spark.sparkContext._jvm
    to, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(parts)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(to.getParent())
    found = [x.getPath() for x in store.listStatus(folder) if x.getPath().getName().startswith("part-")]
    store.rename(found[0], to)
    store.delete(folder, True)
    return path


def wide_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ev(spark, sf_dir).groupBy(F.col("t").alias("time")).pivot("node").agg(F.first("value"))


@query(frame_sql("SELECT case_id, t, node, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY case_id, node ORDER BY t), 0) AS value FROM grid"))
def source_metrics_csv(spark, sf):
    return frame_out(files.read_metrics(spark, one_file(wide_ev(spark, sf), f"{shared_path(spark, 'csv')}/data.csv")))


_ROWS = "SELECT case_id, t, dense_rank() OVER (ORDER BY t) - 1 AS k, CAST(pos + 1 AS VARCHAR) AS node, value FROM grid"


@query(frame_sql(f"SELECT case_id, k AS t, node, value FROM ({_ROWS}) UNION ALL SELECT DISTINCT case_id, k AS t, '0' AS node, CAST(t AS DOUBLE) AS value FROM ({_ROWS})"))
def source_headerless_csv(spark, sf):
    path = one_file(wide_ev(spark, sf), f"{shared_path(spark, 'headerless')}/data.csv", header=False)
    return frame_out(files.read_headerless(spark, path))


_PAIR = "dense_rank() OVER (ORDER BY t >= {0}, t) - 1"


@query(frame_sql(f"SELECT case_id, {_PAIR.format(EV)} AS t, node, value FROM grid UNION ALL SELECT DISTINCT case_id, {_PAIR.format(EV)} AS t, 'F' AS node, CASE WHEN t >= {EV} THEN 1.0 ELSE 0.0 END AS value FROM grid"))
def source_paired_csv(spark, sf):
    folder, wide = shared_path(spark, "pair"), wide_ev(spark, sf)
    return frame_out(files.read_pair(spark, one_file(wide.where(F.col("time") < EV), f"{folder}/normal.csv"), one_file(wide.where(F.col("time") >= EV), f"{folder}/anomalous.csv")))


def write_cases(spark: SparkSession, sf_dir: str) -> str:
    """A case folder per entity of ev, shop/<entity>_delay/1, with data.csv and inject_time.txt; returns the root."""
    root, frame = shared_path(spark, "cases"), tables.ev(spark, sf_dir).withColumn("e", F.split("node", "_")[0]).withColumn("m", F.split("node", "_")[1])
    for (entity,) in sorted(frame.select("e").distinct().collect()):  # a few entities, one folder each
        wide = frame.where(F.col("e") == entity).groupBy(F.col("t").alias("time")).pivot("m").agg(F.first("value"))
        one_file(wide, f"{root}/shop/{entity}_delay/1/data.csv")
        one_file(spark.createDataFrame([(str(EV),)], "x string"), f"{root}/shop/{entity}_delay/1/inject_time.txt", header=False)
    return root


@query("SELECT DISTINCT 'shop' AS dataset, split_part(node, '_', 1) AS service, 'delay' AS fault, '1' AS \"case\", 'data.csv' AS file FROM ev")
def source_case_discovery(spark, sf):
    found = files.discover_cases(spark, write_cases(spark, sf))
    return found.select("dataset", "service", "fault", "case", F.element_at(F.split("path", "/"), -1).alias("file"))


@query(frame_sql("SELECT split_part(node, '_', 1) AS case_id, t, split_part(node, '_', 2) AS node, value FROM ev"))
def source_cases(spark, sf):
    rows = files.read_cases(spark, write_cases(spark, sf)).where("value is not null")
    return frame_out(rows.withColumn("case_id", F.regexp_extract("case_id", "/([^/]+)_delay/1$", 1)))


@query(f"SELECT DISTINCT split_part(node, '_', 1) AS service, '{EV}' AS inject_time FROM ev")
def source_sidecars(spark, sf):
    found = files.sidecars(spark, write_cases(spark, sf), ("inject_time",))
    return found.select(F.regexp_extract("folder", "/([^/]+)_delay/1$", 1).alias("service"), "inject_time")


@query(f"SELECT case_id, node, rank FROM ({scored_sql('usr', USER, False)})")
def source_ranks_json(spark, sf):
    path = shared_path(spark, "ranks")
    files.write_ranks(stats.n_sigma(tables.user(spark, sf), split.after(USER)), path)
    return files.read_ranks(spark, path)


@query("SELECT case_id, src, dst FROM g_true")
def source_graph_json(spark, sf):
    true, _, nodes = halves(spark, sf)
    path = shared_path(spark, "graph")
    files.write_graph(true, nodes, path)
    return files.read_graph(spark, path)[0]


@query(f"SELECT case_id, CAST(min(t - {USER}) FILTER (t >= {USER}) AS INTEGER) AS index FROM usr GROUP BY 1")
def source_change_points(spark, sf):
    path = shared_path(spark, "anomalies")
    days = tables.user(spark, sf).groupBy("case_id").agg(F.array_sort(F.collect_set(F.when(F.col("t") >= USER, (F.col("t") - USER).cast("int")))).alias("anomalies"))
    days.write.json(path)
    return files.read_change_points(spark, path)


@query(f"SELECT case_id, node, {r('shift')} AS shift FROM (SELECT case_id, node, abs(median(value) FILTER (t >= {OLD}) - median(value) FILTER (t < {OLD})) AS shift FROM li GROUP BY 1, 2) WHERE shift > 0.001")
def source_report(spark, sf):
    path = shared_path(spark, "report")
    files.write_report(stats.median_shift(tables.li(spark, sf), split.after(OLD), 0.001), path)
    report = files.read_report(spark, path, "case_id string, node string, shift double")
    return report.withColumn("shift", F.round("shift", 6) + F.lit(0.0))

