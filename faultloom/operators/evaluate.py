"""Evaluation of ranks and graphs (E): joins and aggregates, no state.

ranks: case_id, node, rank; answers: case_id, node (metric answer), service, fault; edges: case_id, src, dst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import skeleton

K = 5


def service(node: Column | str = "node") -> Column:
    """The entity of a node, "-db" cut off."""
    return F.regexp_replace(F.split(F.col(node) if isinstance(node, str) else node, "_").getItem(0), "-db$", "")


def service_ranks(ranks: DataFrame) -> DataFrame:
    """Ranks of services by their best node; services whose nodes share a rank (repeated rows) follow their names."""
    best = ranks.groupBy("case_id", service().alias("node")).agg(F.min("rank").alias("__r"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("__r", "node"))).select("case_id", "node", "rank")


def metric_of_fault(fault: Column | str = "fault") -> Column:
    """E4."""
    f = F.col(fault) if isinstance(fault, str) else fault
    return F.when(f.isin("delay", "loss", "disk"), "latency").otherwise(f)


def hits(ranks: DataFrame, answers: DataFrame) -> DataFrame:
    """Best rank of each case's answers (null if none is ranked); cases without ranks are left out."""
    cases = ranks.select("case_id").distinct()
    found = answers.join(ranks, ["case_id", "node"], "left").groupBy("case_id").agg(F.min("rank").alias("rank"))
    return found.join(cases, "case_id", "left_semi")


def accuracy(hit: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ac1 .. ac5, avg5 and the number of cases, by groups."""
    at = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)) for k in range(1, K + 1)]
    mean = sum(at[1:], at[0]) / K
    return hit.groupBy(*(by or [])).agg(*[a.alias(f"ac{k}") for k, a in enumerate(at, 1)], mean.alias("avg5"), F.count("*").alias("cases"))


def report(hit: DataFrame, cases: DataFrame) -> DataFrame:
    """E5: avg5 by service and fault, by fault, and overall, in one rollup; cases: case_id, service, fault."""
    rows = hit.join(cases, "case_id")
    at = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)) for k in range(1, K + 1)]
    return rows.rollup("fault", "service").agg(at[0].alias("top1"), at[2].alias("top3"), at[4].alias("top5"), (sum(at[1:], at[0]) / K).alias("avg5"), F.count("*").alias("cases"))


def _direct(edges: DataFrame) -> DataFrame:
    """(case_id, a, b, ab, ba), a < b: which directions a pair has."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    return edges.where("src <> dst").groupBy("case_id", a.alias("a"), b.alias("b")).agg(F.max((F.col("src") < F.col("dst")).cast("int")).alias("ab"), F.max((F.col("src") > F.col("dst")).cast("int")).alias("ba"))


def pair_table(true: DataFrame, estimated: DataFrame) -> DataFrame:
    """Directions of each pair of either graph in both."""
    x, y = _direct(true), _direct(estimated).toDF("case_id", "a", "b", "eab", "eba")
    return x.join(y, ["case_id", "a", "b"], "full").fillna(0, ["ab", "ba", "eab", "eba"])


def structural_distance(true: DataFrame, estimated: DataFrame) -> DataFrame:
    """Pairs that are missing, extra, undirected against directed, or reversed count 1 each."""
    p = pair_table(true, estimated)
    both = lambda x, y: (F.col(x) == 1) & (F.col(y) == 1)
    one, two = F.col("ab") + F.col("ba"), F.col("eab") + F.col("eba")
    wrong = ((one == 0) | (two == 0)) | (both("ab", "ba") & (two == 1)) | ((one == 1) & ((F.col("ab") < F.col("eab")) | (F.col("ba") < F.col("eba"))))
    return p.groupBy("case_id").agg(F.sum(wrong.cast("int")).alias("shd"))


def f1(true: DataFrame, estimated: DataFrame) -> DataFrame:
    """Precision, recall and F1 of edge sets; 0 without a common edge."""
    t, e = true.select("case_id", "src", "dst").distinct().withColumn("t", F.lit(1)), estimated.select("case_id", "src", "dst").distinct().withColumn("e", F.lit(1))
    sums = t.join(e, ["case_id", "src", "dst"], "full").groupBy("case_id").agg(F.count("t").alias("nt"), F.count("e").alias("ne"), F.sum(F.when(F.col("t").isNotNull() & F.col("e").isNotNull(), 1).otherwise(0)).alias("tp"))
    p, r = F.when(F.col("tp") > 0, F.col("tp") / F.col("ne")).otherwise(0.0), F.when(F.col("tp") > 0, F.col("tp") / F.col("nt")).otherwise(0.0)
    return sums.select("case_id", p.alias("precision"), r.alias("recall"), F.when(F.col("tp") > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def f1_skeleton(true: DataFrame, estimated: DataFrame) -> DataFrame:
    """E9."""
    return f1(skeleton(true), skeleton(estimated))


def precision_recall(true: DataFrame, estimated: DataFrame) -> DataFrame:
    """Precision and recall of adjacencies, of arrows, and their means, to three decimals; null without a base."""
    p = pair_table(true, estimated)
    t, e = (F.col("ab") + F.col("ba")) > 0, (F.col("eab") + F.col("eba")) > 0
    arrows = lambda x, y: F.when(F.col(x) + F.col(y) == 1, 1).otherwise(0)
    same = ((F.col("ab") == F.col("eab")) & (F.col("ba") == F.col("eba")) & (F.col("ab") + F.col("ba") == 1)).cast("int")
    s = p.groupBy("case_id").agg(F.sum(t.cast("int")).alias("t"), F.sum(e.cast("int")).alias("e"), F.sum((t & e).cast("int")).alias("te"), F.sum(arrows("ab", "ba")).alias("at"), F.sum(arrows("eab", "eba")).alias("ae"), F.sum(same).alias("ate"))
    share = lambda x, y: F.round(F.col(x) / F.nullif(F.col(y), F.lit(0)), 3)
    return s.select("case_id", share("te", "e").alias("adj_precision"), share("te", "t").alias("adj_recall"), share("ate", "ae").alias("arrow_precision"), share("ate", "at").alias("arrow_recall"))


def false_discovery(true: DataFrame, estimated: DataFrame) -> DataFrame:
    """Wrong or reversed edges among all discovered, three decimals, null if there are none."""
    t = true.select("case_id", "src", "dst").distinct().withColumn("t", F.lit(1))
    e = estimated.select("case_id", "src", "dst").distinct()
    return e.join(t, ["case_id", "src", "dst"], "left").groupBy("case_id").agg(F.round(F.avg(F.when(F.col("t").isNull(), 1.0).otherwise(0.0)), 3).alias("fdr"))


def discovery_report(true: DataFrame, estimated: DataFrame) -> DataFrame:
    """Means over cases of F1, skeleton F1, and the distance rounded down."""
    rows = f1(true, estimated).select("case_id", "f1").join(f1_skeleton(true, estimated).select("case_id", F.col("f1").alias("f1s")), "case_id").join(structural_distance(true, estimated), "case_id")
    return rows.agg(F.avg("f1").alias("f1"), F.avg("f1s").alias("f1_skeleton"), F.floor(F.avg("shd")).alias("shd"), F.count("*").alias("cases"))


def best_setting(scored: DataFrame, setting: str = "setting", loss: str = "loss") -> DataFrame:
    """The setting of least loss of each case (ties: the first setting)."""
    return scored.groupBy("case_id").agg(F.min(F.struct(loss, setting)).alias("m")).select("case_id", F.col(f"m.{setting}").alias(setting), F.col(f"m.{loss}").alias(loss))
