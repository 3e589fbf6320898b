"""Sources and sinks: metric files, sidecars, graphs, ranks and reports. Paths are those of Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import clean, frames


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header as a clean long frame: the repeated time column and *latency-50 go, *_latency-90 becomes
    *_latency, infinities and gaps take the last reading, then 0."""
    wide = spark.read.csv(path, header=True, inferSchema=True)
    if "time" not in wide.columns:
        wide = numbered(wide)
    wide = wide.drop(*[c for c in wide.columns if c == "time.1"])
    return clean.forward_fill(clean.rename(frames.from_wide(wide)))


def read_headerless(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file without header: nodes are 0, 1, ..., times are row numbers."""
    wide = spark.read.csv(path, header=False, inferSchema=True)
    wide = wide.toDF(*[str(k) for k in range(len(wide.columns))])
    return frames.from_wide(numbered(wide))


def numbered(wide: DataFrame, name: str = "time") -> DataFrame:
    """Row numbers from 0 in file order as a time column (for one file: a case)."""
    rows = wide.withColumn("__o", F.monotonically_increasing_id())
    return rows.withColumn(name, F.row_number().over(Window.orderBy("__o")) - 1).drop("__o")


def path_labels(path: Column) -> dict[str, Column]:
    """dataset, service, fault and case of .../dataset/service_fault/case/file."""
    part = lambda k: F.element_at(F.split(path, "/"), -k)
    return {"dataset": part(4), "service": F.regexp_extract(part(3), "^(.*)_([^_]+)$", 1), "fault": F.regexp_extract(part(3), "^(.*)_([^_]+)$", 2), "case": part(2)}


def discover_cases(spark: SparkSession, root: str) -> DataFrame:
    """Case files below root, simple_data.csv preferred to data.csv: path, folder, dataset, service, fault, case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*data.csv").load(root).select("path")
    named = found.withColumn("folder", F.regexp_replace("path", "/[^/]+$", "")).withColumn("file", F.element_at(F.split("path", "/"), -1)).where(F.col("file").isin("data.csv", "simple_data.csv"))
    best = named.groupBy("folder").agg(F.max(F.struct((F.col("file") == "simple_data.csv").alias("s"), "path")).alias("m")).select("folder", F.col("m.path").alias("path"))
    return best.select("path", "folder", *[c.alias(k) for k, c in path_labels(F.col("path")).items()])


def sidecars(spark: SparkSession, root: str, names: tuple[str, ...] = ("inject_time", "root_cause", "fe_service")) -> DataFrame:
    """One row per folder below root with the text of <name>.txt files as columns."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim(F.regexp_replace("value", "[\\r\\n]+", " ")).alias("value"))
    rows = files.withColumn("folder", F.regexp_replace("path", "/[^/]+$", "")).withColumn("name", F.regexp_extract("path", "([^/]+)\\.txt$", 1))
    return rows.groupBy("folder").pivot("name", list(names)).agg(F.first("value"))


def read_cases(spark: SparkSession, root: str) -> DataFrame:
    """The files of discover_cases() as one frame, case_id being the folder; files are parsed in one distributed pass."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*data.csv").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    wanted = discover_cases(spark, root).select(F.regexp_replace("path", "^file:/+", "/").alias("k"))
    rows = lines.withColumn("k", F.regexp_replace("path", "^file:/+", "/")).join(wanted, "k", "left_semi")
    body = rows.select(F.regexp_replace("k", "/[^/]+$", "").alias("case_id"), F.filter(F.split("value", "\\r?\\n"), lambda x: F.length(x) > 0).alias("l"))
    head = body.select("case_id", F.split(F.col("l")[0], ",").alias("h"), F.posexplode(F.slice("l", 2, F.size("l"))).alias("row", "line"))
    cells = head.select("case_id", "h", "row", F.split("line", ",").alias("v")).select("case_id", "row", "v", "h", F.posexplode("h").alias("pos", "node"))
    place = F.array_position("h", "time")
    time = F.when(place > 0, F.try_element_at("v", place.cast("int")).try_cast("double").cast("long")).otherwise(F.col("row").cast("long"))
    out = cells.where("node <> 'time' and node <> 'time.1'").select("case_id", time.alias("t"), "node", "pos", F.try_element_at("v", F.col("pos") + 1).try_cast("double").alias("value"))
    return out


def read_pair(spark: SparkSession, normal: str, anomalous: str) -> DataFrame:
    """Two CSV files as one frame; the flag node F is 0 on the normal rows and 1 on the anomalous ones, which follow."""
    a, b = numbered(spark.read.csv(normal, header=True, inferSchema=True), "__n"), numbered(spark.read.csv(anomalous, header=True, inferSchema=True), "__n")
    size = a.count()
    shared = [c for c in a.columns if c in b.columns and c not in ("time", "__n")]
    rows = a.select(F.col("__n").alias("time"), *shared, F.lit(0.0).alias("F")).unionByName(b.select((F.col("__n") + size).alias("time"), *shared, F.lit(1.0).alias("F")))
    return frames.from_wide(rows)


GRAPH_JSON = "nodes array<string>, edges array<array<int>>"


class InvalidGraphError(ValueError):
    """A graph file without nodes or edges."""


def write_graph(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    """Graph JSON, one line per case: {"case_id", "nodes": [...], "edges": [[i, j], ...]} with places in nodes."""
    order = nodes.groupBy("case_id").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    found = edges.groupBy("case_id").agg(F.collect_set(F.struct("src", "dst")).alias("e"))
    place = lambda x: F.transform("e", lambda p: F.array((F.array_position("nodes", p["src"]) - 1).cast("int"), (F.array_position("nodes", p["dst"]) - 1).cast("int")))  # noqa: E731, ARG005
    order.join(found, "case_id", "left").select("case_id", "nodes", F.coalesce(F.array_sort(place(0)), F.array().cast("array<array<int>>")).alias("edges")).write.mode("overwrite").json(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of graph JSON; a line without nodes or edges raises InvalidGraphError."""
    rows = spark.read.schema("case_id string, " + GRAPH_JSON).json(path)
    if not rows.where("nodes is null or edges is null").isEmpty():
        raise InvalidGraphError(path)
    rows = rows.withColumn("case_id", F.coalesce("case_id", F.lit("0")))
    name = lambda k: F.element_at("nodes", F.col("e")[k] + 1)
    return rows.select("case_id", "nodes", F.explode("edges").alias("e")).select("case_id", name(0).alias("src"), name(1).alias("dst")), rows.select("case_id", F.explode("nodes").alias("node"))


def write_ranks(ranks: DataFrame, path: str) -> None:
    """Ranks as JSON, one line per case: {"case_id", "ranks": [...]}."""
    ranks.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]).alias("ranks")).write.mode("overwrite").json(path)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("case_id string, ranks array<string>").json(path)
    return rows.select("case_id", F.posexplode("ranks").alias("k", "node")).select("case_id", "node", (F.col("k") + 1).alias("rank"))


def read_change_points(spark: SparkSession, path: str) -> DataFrame:
    """Precomputed anomaly feeds: the first listed index of each case (JSON lines {"case_id", "anomalies": [...]})."""
    rows = spark.read.schema("case_id string, anomalies array<int>").json(path)
    return rows.select("case_id", F.get("anomalies", F.lit(0)).alias("index"))


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A report of write_report(); without a schema the columns' types are inferred."""
    return spark.read.schema(schema).csv(path, header=True) if schema else spark.read.csv(path, header=True, inferSchema=True)


#: The public data sets this kind of file comes from, by their short names. Nothing is downloaded.
DATASETS = ("online-boutique", "sock-shop-1", "sock-shop-2", "train-ticket", "circa10", "circa50", "rcd10", "rcd50", "causil10", "causil50")
