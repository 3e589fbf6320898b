"""Named queries over the test tables, one per operator, with the SQL that must give the same rows where SQL can.

Results are rounded to six places on both sides; ties of ranks follow the column order, so ranks are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, evaluate, frames, graph, split, stats
from ..streaming import spot
from . import methods, tables
from .tables import EV, OLD, SQL, USER

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = with_frames(sql)
        return f

    return add


def with_frames(sql: str) -> str:
    """sql with the frames and graphs that it names as common table expressions."""
    import re

    known = {k: v for k, v in SQL.items()} | GRAPH_SQL
    wanted, order = [k for k in known if re.search(rf"\b{k}\b", sql)], []

    def need(k: str) -> None:
        for other in known:
            if other != k and re.search(rf"\b{other}\b", known[k]):
                need(other)
        if k not in order:
            order.append(k)

    for k in wanted:
        need(k)
    if not order:
        return sql
    head = ", ".join(f"{k} AS MATERIALIZED ({known[k]})" for k in order)
    body = sql.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    if body.upper().startswith("WITH"):
        return f"WITH {recursive}{head}, {body.split(None, 2 if recursive else 1)[-1]}"
    return f"WITH {head} {body}"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})




def r(x: str) -> str:
    return f"(round({x}, 6) + CAST(0 AS DOUBLE))"


def frame_out(df: DataFrame) -> DataFrame:
    return rounded(df.select("case_id", "t", "node", F.col("value")), "value")


# Graphs: two halves of the frame li, correlated at a threshold: "true" and "estimated".

GRAPH_SQL: dict[str, str] = {}


def _half_sql(which: str) -> str:
    return f"SELECT x.case_id, x.node AS src, y.node AS dst FROM li x JOIN li y ON x.t = y.t AND x.node < y.node WHERE x.t {which} {OLD - 900} GROUP BY ALL HAVING abs(coalesce(corr(x.value, y.value), 0)) >= 0.05"


GRAPH_SQL["g_true"] = _half_sql("<")
GRAPH_SQL["g_est"] = _half_sql(">=")
GRAPH_SQL["g_nodes"] = "SELECT DISTINCT case_id, node FROM li"
GRAPH_SQL["m_true"] = "SELECT case_id, src AS a, dst AS b, CASE WHEN length(src) % 2 = 0 THEN 1 ELSE -1 END AS mark FROM g_true UNION ALL SELECT case_id, dst, src, CASE WHEN ascii(dst) % 2 = 0 THEN -1 ELSE 2 END FROM g_true"


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    frame = tables.li(spark, sf_dir)
    of = lambda part: graph.threshold_graph(stats.correlations(part), 0.05)
    return of(frame.where(F.col("t") < OLD - 900)), of(frame.where(F.col("t") >= OLD - 900)), frame.select("case_id", "node").distinct()


def marked(edges: DataFrame) -> DataFrame:
    one = edges.select("case_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.when(F.length("src") % 2 == 0, 1).otherwise(-1).alias("mark"))
    two = edges.select("case_id", F.col("dst").alias("a"), F.col("src").alias("b"), F.when(F.ascii("dst") % 2 == 0, -1).otherwise(2).alias("mark"))
    return one.unionByName(two)


# Scores and ranks (the flagship)


def steady(x: str) -> str:
    """What ranks go by: ten significant digits."""
    return f"CAST(format('{{:.9e}}', {x}) AS DOUBLE)"


steady_score = steady("score")

_SCORED = """
SELECT case_id, node, {score} AS score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY CAST(format('{{:.9e}}', raw) AS DOUBLE) DESC, pos) AS INTEGER) AS rank FROM (
  SELECT case_id, node, pos, (max(value) FILTER (a) - {centre}) / CASE WHEN {spread} > 0 THEN {spread} ELSE 1 END AS raw
  FROM (SELECT *, t >= {inject} AS a FROM {frame}) GROUP BY case_id, node, pos
  HAVING min(value) FILTER (NOT a) <> max(value) FILTER (NOT a) AND min(value) FILTER (a) <> max(value) FILTER (a))
"""


def scored_sql(frame: str, inject: int, robust: bool, exact: bool = False) -> str:
    n = "FILTER (NOT a)"
    centre = f"median(value) {n}" if robust else f"avg(value) {n}"
    spread = f"(quantile_cont(value, 0.75) {n} - quantile_cont(value, 0.25) {n})" if robust else f"stddev_pop(value) {n}"
    return _SCORED.format(score="raw" if exact else r("raw"), centre=centre, spread=spread, inject=inject, frame=frame)


@query(scored_sql("ev", EV, True))
def baro_ev(spark, sf):
    return rounded(stats.baro(tables.ev(spark, sf), split.after(EV)), "score")


@query(scored_sql("usr", USER, True))
def baro_users(spark, sf):
    """All users' cases in one job."""
    return rounded(stats.baro(tables.user(spark, sf), split.after(USER)), "score")


@query(scored_sql("ord", OLD, False))
def nsigma_orders(spark, sf):
    return rounded(stats.n_sigma(tables.ord_(spark, sf), split.after(OLD)), "score")


@query(scored_sql("usr", USER, False))
def nsigma_users(spark, sf):
    return rounded(stats.n_sigma(tables.user(spark, sf), split.after(USER)), "score")


@query(f"SELECT case_id, node, {r('abs(median(value) FILTER (t >= {0}) - median(value) FILTER (t < {0}))'.format(OLD))} AS shift FROM li GROUP BY 1, 2 HAVING abs(median(value) FILTER (t >= {OLD}) - median(value) FILTER (t < {OLD})) > 0.001")
def median_shift(spark, sf):
    return rounded(stats.median_shift(tables.li(spark, sf), split.after(OLD), 0.001), "shift")


@query(f"SELECT service AS node, case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY rk, service) AS INTEGER) AS rank FROM (SELECT case_id, split_part(node, '_', 1) AS service, min(rank) AS rk FROM ({scored_sql('usr', USER, False)}) GROUP BY 1, 2)")
def service_ranks_users(spark, sf):
    return evaluate.service_ranks(stats.n_sigma(tables.user(spark, sf), split.after(USER)))


@query(f"SELECT * FROM ({scored_sql('usr', USER, False)}) WHERE rank <= 3")
def top_k_users(spark, sf):
    return rounded(split.top(stats.n_sigma(tables.user(spark, sf), split.after(USER)), 3), "score")


# Splits

_OUT = "SELECT case_id, t, node, {v} AS value FROM ({q})"


def frame_sql(q: str) -> str:
    return _OUT.format(v=r("value"), q=q)


@query(frame_sql(f"SELECT * FROM ev WHERE t >= {EV}"))
def f1_time_split(spark, sf):
    return frame_out(tables.ev(spark, sf).where(split.after(EV)))


@query("SELECT case_id, t, node, dense_rank() OVER (PARTITION BY case_id ORDER BY t) > 400 AS anomalous FROM ev")
def f2_index_split(spark, sf):
    return split.by_index(tables.ev(spark, sf), 400).select("case_id", "t", "node", "anomalous")


@query(frame_sql(f"SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY t >= {EV} ORDER BY abs(t - {EV}), t) AS n FROM ev) WHERE n <= 100"))
def f3_symmetric(spark, sf):
    return frame_out(split.symmetric(tables.ev(spark, sf), EV, 100))


@query(frame_sql(f"SELECT f.* FROM usr f JOIN (SELECT case_id, t, row_number() OVER (PARTITION BY case_id, a ORDER BY abs(t - {USER}), t) AS n, least(count(*) FILTER (a) OVER (PARTITION BY case_id), count(*) FILTER (NOT a) OVER (PARTITION BY case_id)) AS m FROM (SELECT DISTINCT case_id, t, t >= {USER} AS a FROM usr)) s USING (case_id, t) WHERE n <= m"))
def f4_equal_lengths(spark, sf):
    return frame_out(split.equal_lengths(tables.user(spark, sf), USER))


@query(frame_sql("SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY case_id ORDER BY t) AS n FROM usr) WHERE n <= 7"))
def f5_prefix(spark, sf):
    return frame_out(split.prefix(tables.user(spark, sf), 7))


@query("SELECT case_id, t, node, n <= floor(0.7 * m) AS train FROM (SELECT case_id, t, node, dense_rank() OVER (PARTITION BY case_id ORDER BY t) AS n FROM usr) JOIN (SELECT case_id, count(DISTINCT t) AS m FROM usr GROUP BY 1) USING (case_id)")
def f6_train_flag(spark, sf):
    return split.train_flag(tables.user(spark, sf)).select("case_id", "t", "node", "train")


@query(frame_sql(f"SELECT * FROM li WHERE t BETWEEN {OLD - 100} AND {OLD + 100}"))
def f7_between(spark, sf):
    return frame_out(split.between(tables.li(spark, sf), OLD - 100, OLD + 100))


@query(frame_sql(f"SELECT * FROM ev WHERE t >= {EV} + 12"))
def f8_delay(spark, sf):
    return frame_out(tables.ev(spark, sf).where(split.after(split.delayed(EV, 12))))


@query("SELECT case_id, CASE WHEN bool_or(node = 'view_latency') THEN 'view_latency' WHEN bool_or(node = 'view_lat_90') THEN 'view_lat_90' ELSE 'view_cnt' END AS sli FROM usr GROUP BY 1")
def f9_indicator(spark, sf):
    return split.choose_indicator(tables.user(spark, sf), "view", "view_cnt")


# Gaps and normalisation, on the full grid (which has gaps)

GRAPH_SQL["grid"] = "SELECT t.case_id, t.t, n.node, n.pos, e.value FROM (SELECT DISTINCT case_id, t FROM ev) t JOIN (SELECT DISTINCT case_id, node, pos FROM ev) n USING (case_id) LEFT JOIN ev e USING (case_id, t, node, pos)"


def grid(spark, sf):
    return frames.full_grid(tables.ev(spark, sf))


_W = "OVER (PARTITION BY case_id, node ORDER BY t ROWS BETWEEN {} AND {})"
_BACK, _AHEAD = _W.format("UNBOUNDED PRECEDING", "CURRENT ROW"), _W.format("CURRENT ROW", "UNBOUNDED FOLLOWING")


@query(frame_sql(f"SELECT case_id, t, node, coalesce(last_value(value IGNORE NULLS) {_BACK}, 0) AS value FROM grid"))
def n1_forward_fill(spark, sf):
    return frame_out(clean.forward_fill(grid(spark, sf)))


@query(frame_sql(f"SELECT case_id, t, node, coalesce(first_value(value IGNORE NULLS) {_AHEAD}, last_value(value IGNORE NULLS) {_BACK}, 0) AS value FROM grid"))
def n2_fill_both(spark, sf):
    return frame_out(clean.fill_both(grid(spark, sf)))


@query(frame_sql(f"SELECT case_id, t, node, last_value(value IGNORE NULLS) {_BACK} AS value FROM grid"))
def n3_fill_only(spark, sf):
    return frame_out(clean.forward_fill(grid(spark, sf), zero=False))


@query(frame_sql("SELECT case_id, t, node, abs(value - 50) AS value FROM ev"))
def n4_absolute(spark, sf):
    return frame_out(clean.absolute(tables.ev(spark, sf).withColumn("value", F.col("value") - 50)))


_S, _E = EV - 240, EV + 240


@query(
    frame_sql(f"""SELECT case_id, t, node, coalesce(CASE WHEN bt = nt THEN bv ELSE bv + (av - bv) / (nt - bt) * (t - bt) END, bv, av) AS value FROM (
  SELECT case_id, t, node, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) {_BACK} AS bt, last_value(value IGNORE NULLS) {_BACK} AS bv,
         first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) {_AHEAD} AS nt, first_value(value IGNORE NULLS) {_AHEAD} AS av
  FROM (SELECT n.case_id, n.node, g.t, m.value FROM (SELECT DISTINCT case_id, node FROM ev) n CROSS JOIN (SELECT unnest(range({_S}, {_E} + 1, 6)) AS t) g
    LEFT JOIN (SELECT case_id, node, {_S} + CAST(floor((t - {_S}) / 6) AS BIGINT) * 6 AS t, avg(value) AS value FROM ev WHERE t BETWEEN {_S} AND {_E} GROUP BY 1, 2, 3) m ON m.case_id = n.case_id AND m.node = n.node AND m.t = g.t))""")
)
def n5_resample(spark, sf):
    return frame_out(clean.resample(tables.ev(spark, sf), _S, _E, 6))


@query(frame_sql("SELECT case_id, t, node, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS value FROM li WINDOW w AS (PARTITION BY case_id, node)"))
def n7_normalise(spark, sf):
    return frame_out(clean.normalise(tables.li(spark, sf)))


@query(frame_sql("SELECT case_id, t, node, value - avg(value) OVER (PARTITION BY case_id, node) AS value FROM ev"))
def n8_centre(spark, sf):
    return frame_out(clean.centre(tables.ev(spark, sf)))


@query(
    f"""SELECT case_id, t, node, {r("trend")} AS trend, {r("value - trend")} AS residual FROM (SELECT case_id, t, node, value,
  (sum(value) OVER (PARTITION BY case_id, node ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) + first_value(value) OVER o * greatest(13 - n, 0) + last_value(value) OVER o * greatest(n + 12 - s, 0)) / 25 AS trend
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id, node ORDER BY t) AS n, count(*) OVER (PARTITION BY case_id, node) AS s FROM li)
  WINDOW o AS (PARTITION BY case_id, node ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
)
def n9_moving_average(spark, sf):
    return rounded(clean.moving_average(tables.li(spark, sf)).select("case_id", "t", "node", "trend", "residual"), "trend", "residual")


@query(frame_sql("SELECT * FROM (SELECT case_id, t, node, avg(value) OVER (PARTITION BY case_id, node ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS value, row_number() OVER (PARTITION BY case_id, node ORDER BY t) AS n FROM ev) WHERE n >= 10"))
def n10_trailing_mean(spark, sf):
    return frame_out(clean.trailing_mean(tables.ev(spark, sf), 10))


@query(frame_sql(f"SELECT case_id, t, node, (value - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS value FROM ord JOIN (SELECT case_id, node, avg(value) AS m, stddev_pop(value) AS s FROM ord WHERE t < {OLD} GROUP BY 1, 2) USING (case_id, node)"))
def n11_standardise(spark, sf):
    return frame_out(clean.standardise(tables.ord_(spark, sf), F.col("t") < OLD))


# Column rules


def nodes_sql(having: str, frame: str = "usr") -> str:
    return f"SELECT case_id, node FROM {frame} GROUP BY 1, 2 HAVING {having}"


def nodes_out(df: DataFrame) -> DataFrame:
    return df.select("case_id", "node").distinct()


@query(nodes_sql("min(value) <> max(value)"))
def p1_drop_constant(spark, sf):
    return nodes_out(clean.drop_constant(tables.user(spark, sf)))


@query(nodes_sql("count(DISTINCT value) <> 1"))
def p1b_drop_single_valued(spark, sf):
    return nodes_out(clean.drop_single_valued(tables.user(spark, sf)))


@query("SELECT case_id, node FROM usr JOIN (SELECT case_id, node, arg_min(value, t) AS f FROM usr GROUP BY 1, 2) USING (case_id, node) GROUP BY 1, 2 HAVING avg(CASE WHEN value = f THEN 0 ELSE 1 END) > 0.5")
def p2_near_constant(spark, sf):
    return nodes_out(clean.drop_near_constant(tables.user(spark, sf), 0.5))


@query("SELECT DISTINCT case_id, node FROM (SELECT case_id, replace(replace(node, 'click', 'redis'), 'error', 'queue') AS node FROM usr) WHERE NOT starts_with(node, 'redis_') AND NOT starts_with(node, 'queue')")
def p4_drop_extra(spark, sf):
    return nodes_out(clean.drop_extra(tables.user(spark, sf).withColumn("node", F.replace(F.replace("node", F.lit("click"), F.lit("redis")), F.lit("error"), F.lit("queue")))))


@query("SELECT case_id, t, replace(node, 'total', 'mem') AS node, round(CASE WHEN node LIKE '%total' THEN value / 1000000 ELSE value END, 10) AS value FROM ord")
def p5_memory(spark, sf):
    out = clean.memory_in_mb(tables.ord_(spark, sf).withColumn("node", F.replace("node", F.lit("total"), F.lit("mem"))))
    return out.select("case_id", "t", "node", F.round("value", 10).alias("value"))


@query("SELECT case_id, t, replace(node, 'total', 'mem') AS node, CASE WHEN node LIKE '%total' THEN CAST(trunc(value / 1000000) AS DOUBLE) ELSE value END AS value FROM ord")
def p5b_memory_whole(spark, sf):
    frame = tables.ord_(spark, sf).withColumn("node", F.replace("node", F.lit("total"), F.lit("mem")))
    return clean.memory_in_mb(frame, whole=True).select("case_id", "t", "node", "value")


@query("SELECT case_id, t, node, value FROM ord WHERE NOT ends_with(node, '_cnt')")
def p3_drop_time(spark, sf):
    """The counts under the names of time columns."""
    named = F.when(F.col("node").startswith("1"), "time.1").otherwise("Time")
    frame = tables.ord_(spark, sf).withColumn("node", F.when(F.col("node").endswith("_cnt"), named).otherwise(F.col("node")))
    return frames.drop_time(frame).select("case_id", "t", "node", "value")


@query("SELECT case_id, node, CAST(dense_rank() OVER (PARTITION BY case_id ORDER BY node) - 1 AS INTEGER) AS number FROM (SELECT DISTINCT case_id, node FROM usr)")
def p15_column_numbers(spark, sf):
    return frames.column_numbers(tables.user(spark, sf))


_BOTH = f"min(value) FILTER (t >= {USER}) <> max(value) FILTER (t >= {USER}) AND min(value) FILTER (t < {USER}) <> max(value) FILTER (t < {USER})"


@query(nodes_sql(_BOTH, "(SELECT case_id, t, replace(node, '_sum', '_lat_90') AS node, value FROM usr WHERE NOT (node LIKE 'v%_cnt'))"))
def p7_latency_sock_shop(spark, sf):
    """Sums as the latency percentile that stays, counts of v... as one that goes."""
    name = F.when(F.col("node").rlike("^v.*_cnt$"), F.replace("node", F.lit("_cnt"), F.lit("_lat_50"))).otherwise(F.replace("node", F.lit("_sum"), F.lit("_lat_90")))
    return nodes_out(clean.latency_sock_shop(tables.user(spark, sf).withColumn("node", name), split.after(USER)))


@query(f"SELECT service AS method, count(*) AS cases, {r('avg(n)')} AS mean_seconds FROM (SELECT split_part(node, '_', 1) AS service, case_id, CAST(count(*) AS DOUBLE) AS n FROM usr GROUP BY 1, 2) GROUP BY 1")
def running_time(spark, sf):
    """Readings stand for seconds, entities for methods."""
    times = tables.user(spark, sf).groupBy(frames.entity().alias("method"), "case_id").agg(F.count("*").cast("double").alias("seconds"))
    return rounded(frames.running_time(times), "mean_seconds")


@query("SELECT DISTINCT case_id, node FROM (SELECT case_id, replace(replace(node, '_sum', '_lat_90'), '_cnt', '_lat_50') AS node FROM usr) WHERE node LIKE '%lat\\_90' ESCAPE '\\'")
def p8_latency(spark, sf):
    return nodes_out(clean.select_latency(tables.user(spark, sf).withColumn("node", F.replace(F.replace("node", F.lit("_sum"), F.lit("_lat_90")), F.lit("_cnt"), F.lit("_lat_50"))), 90))


@query(nodes_sql("stddev_samp(value) > 1"))
def p9b_varying(spark, sf):
    return nodes_out(clean.select_varying(tables.user(spark, sf)))


@query(nodes_sql(f"bool_or(t >= {USER}) AND bool_or(t < {USER})"))
def p10_both_sides(spark, sf):
    return nodes_out(clean.on_both_sides(tables.user(spark, sf), split.after(USER)))


@query(nodes_sql(f"min(value) FILTER (t >= {USER}) <> max(value) FILTER (t >= {USER}) AND min(value) FILTER (t < {USER}) <> max(value) FILTER (t < {USER})"))
def p1_p10_varying_both_sides(spark, sf):
    return nodes_out(clean.varying_on_both_sides(tables.user(spark, sf), split.after(USER)))


@query("SELECT DISTINCT case_id, 'SIM_' || regexp_replace(node, '_latency-90$', '_latency') AS node FROM (SELECT case_id, replace(replace(node, '_sum', '_latency-90'), '_cnt', '_latency-50') AS node FROM usr) WHERE NOT ends_with(node, 'latency-50')")
def p13_rename(spark, sf):
    return nodes_out(clean.rename(tables.user(spark, sf).withColumn("node", F.replace(F.replace("node", F.lit("_sum"), F.lit("_latency-90")), F.lit("_cnt"), F.lit("_latency-50"))), "SIM_"))


@query("SELECT case_id, node, count(DISTINCT value) AS n_values, CASE WHEN count(DISTINCT value) > 20 THEN 'cont' ELSE 'disc' END AS kind FROM ev GROUP BY 1, 2")
def p16_types(spark, sf):
    return clean.infer_types(tables.ev(spark, sf)).select("case_id", "node", "n_values", "kind")


@query("SELECT case_id, t, node, code FROM (SELECT case_id, t, node, value FROM ev WHERE node LIKE '%cnt') JOIN (SELECT case_id, node, value, CAST(row_number() OVER (PARTITION BY case_id, node ORDER BY min(t), value) - 1 AS INTEGER) AS code FROM ev GROUP BY 1, 2, 3) USING (case_id, node, value)")
def p16_codes(spark, sf):
    return clean.encode(tables.ev(spark, sf).where("node like '%cnt'")).select("case_id", "t", "node", "code")


@query("SELECT node, CAST(sum(CASE WHEN value = v THEN 1 ELSE 0 END) AS BIGINT) AS ones, count(*) AS n FROM (SELECT e.node || '=' || v AS node, value, v FROM ev e JOIN (SELECT DISTINCT case_id, node, value AS v FROM ev WHERE node LIKE '%cnt') u ON e.case_id = u.case_id AND e.node = u.node) GROUP BY 1")
def p17_one_hot(spark, sf):
    hot = clean.one_hot(tables.ev(spark, sf).where("node like '%cnt'"))
    return hot.groupBy("node").agg(F.sum("value").cast("long").alias("ones"), F.count("*").alias("n"))


@query("SELECT DISTINCT case_id, node FROM (SELECT case_id, replace(node, '_sum', '_lat_50') AS node FROM usr) WHERE NOT ends_with(node, '_lat_50') AND starts_with(node, 'p')")
def p12_keep_prefix(spark, sf):
    frame = tables.user(spark, sf).withColumn("node", F.replace("node", F.lit("_sum"), F.lit("_lat_50")))
    return clean.suffix_filter(frame, keep_prefix="p").select("case_id", "node").distinct()


@query("SELECT DISTINCT case_id, node FROM (SELECT case_id, replace(node, '_sum', '_lat_50') AS node FROM usr) WHERE NOT ends_with(node, '_lat_50')")
def p12_suffixes(spark, sf):
    return nodes_out(clean.suffix_filter(tables.user(spark, sf).withColumn("node", F.replace("node", F.lit("_sum"), F.lit("_lat_50")))))


@query("SELECT case_id, node FROM (SELECT case_id, replace(replace(node, '_sum', '_mem'), '_cnt', '_lat50') AS node, value FROM usr) GROUP BY 1, 2 HAVING (node LIKE '%\\_mem' ESCAPE '\\' AND stddev_samp(value) > 1) OR (node LIKE '%lat50' AND stddev_samp(value) * 1000 > 10)")
def p9_useful(spark, sf):
    return nodes_out(clean.select_useful(tables.user(spark, sf).withColumn("node", F.replace(F.replace("node", F.lit("_sum"), F.lit("_mem")), F.lit("_cnt"), F.lit("_lat50")))))


@query("SELECT case_id, t, node, round(CASE WHEN node LIKE '%mem' THEN value / 1000000 ELSE value END, 10) AS value FROM (SELECT case_id, t, replace(node, '_sum', '_mem') AS node, value, min(value) OVER (PARTITION BY case_id, node) AS lo, max(value) OVER (PARTITION BY case_id, node) AS hi FROM usr) WHERE lo <> hi")
def p11_preprocess(spark, sf):
    out = clean.preprocess(tables.user(spark, sf).withColumn("node", F.replace("node", F.lit("_sum"), F.lit("_mem"))), "sock-shop-2")
    return out.select("case_id", "t", "node", F.round("value", 10).alias("value"))


@query("SELECT case_id, node FROM (SELECT case_id, node, value, arg_min(value, t) OVER (PARTITION BY case_id, node) AS f FROM (SELECT case_id, replace(node, '_sum', '_lat_99') AS node, t, value FROM usr)) WHERE NOT ends_with(node, 'lat_99') GROUP BY 1, 2 HAVING min(value) <> max(value) AND avg(CASE WHEN value = f THEN 0 ELSE 1 END) > 0.1")
def p6_sock_shop(spark, sf):
    return nodes_out(clean.sock_shop(tables.user(spark, sf).withColumn("node", F.replace("node", F.lit("_sum"), F.lit("_lat_99")))))


@query(f"SELECT DISTINCT case_id, node FROM ord WHERE t BETWEEN {OLD - 120} AND {OLD + 300} GROUP BY 1, 2 HAVING count(DISTINCT value) > 1")
def n6_look_back(spark, sf):
    return nodes_out(clean.look_back(tables.ord_(spark, sf), OLD, 120, OLD + 300))


# Statistics

CORR = "SELECT x.case_id, x.node AS a, y.node AS b, coalesce(CASE WHEN isnan(corr(x.value, y.value)) THEN 0 ELSE corr(x.value, y.value) END, 0) AS r, count(*) AS n FROM {f} x JOIN {f} y ON x.case_id = y.case_id AND x.t = y.t AND x.node < y.node GROUP BY 1, 2, 3"
GRAPH_SQL["corr_ev"] = CORR.format(f="ev")


@query(f"SELECT case_id, a, b, n, {r('r')} AS r FROM corr_ev")
def correlations(spark, sf):
    return rounded(stats.correlations(tables.ev(spark, sf)), "r")


@query(f"SELECT case_id, a, b, n, {r('sqrt(greatest(n - 3, 0)) * atanh(r)')} AS z FROM corr_ev")
def t1_fisher_z(spark, sf):
    return rounded(stats.fisher_z(stats.correlations(tables.ev(spark, sf))), "z").select("case_id", "a", "b", "n", "z")


GRAPH_SQL["both_ev"] = "SELECT case_id, a, b, r FROM corr_ev UNION ALL SELECT case_id, b, a, r FROM corr_ev"
GRAPH_SQL["part_ev"] = "SELECT p.case_id, p.a, p.b, q.b AS c, p.n, (p.r - q.r * s.r) / nullif(sqrt((1 - q.r * q.r) * (1 - s.r * s.r)), 0) AS r FROM corr_ev p JOIN both_ev q ON q.case_id = p.case_id AND q.a = p.a AND q.b <> p.b JOIN both_ev s ON s.case_id = p.case_id AND s.a = p.b AND s.b = q.b"


@query(f"SELECT case_id, a, b, c, n, {r('coalesce(r, 0)')} AS r FROM part_ev")
def partial_correlations(spark, sf):
    return rounded(stats.partial_correlations(stats.correlations(tables.ev(spark, sf))), "r")


@query("SELECT c.case_id, c.a, c.b FROM corr_ev c LEFT JOIN (SELECT case_id, a, b, min(abs(sqrt(greatest(n - 4, 0)) * atanh(coalesce(r, 0)))) AS w FROM part_ev GROUP BY 1, 2, 3) p USING (case_id, a, b) WHERE abs(sqrt(greatest(c.n - 3, 0)) * atanh(c.r)) > 1.959964 AND (w IS NULL OR w > 1.959964)")
def c24_neighbour_superset(spark, sf):
    return stats.depends_given_one(stats.correlations(tables.ev(spark, sf)), 1.959964)


@query(f"SELECT x.case_id, x.node AS a, y.node AS b, count(*) AS n, {r('sum(x.value)')} AS sx, {r('sum(x.value * y.value)')} AS sxy FROM ev x JOIN ev y ON x.t = y.t AND x.node <= y.node GROUP BY 1, 2, 3")
def gram(spark, sf):
    return rounded(stats.gram(tables.ev(spark, sf)).select("case_id", "a", "b", "n", "sx", "sxy"), "sx", "sxy")


@query(
    f"""SELECT l_shipyear, {r("sum(o * o / e) - sum(o)")} AS chi2, {r("sum(2 * o * ln(o / e))")} AS g2, (count(DISTINCT l_returnflag) - 1) * (count(DISTINCT l_linestatus) - 1) AS dof FROM (
  SELECT *, sum(o) OVER (PARTITION BY l_shipyear, l_returnflag) * sum(o) OVER (PARTITION BY l_shipyear, l_linestatus) / sum(o) OVER (PARTITION BY l_shipyear) AS e
  FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS l_shipyear, l_returnflag, l_linestatus, CAST(count(*) AS DOUBLE) AS o FROM lineitem GROUP BY 1, 2, 3)) GROUP BY 1"""
)
def t2_t3_chi_square(spark, sf):
    rows = tables.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("l_shipyear"), "l_returnflag", "l_linestatus")
    return rounded(stats.chi_square(rows, "l_returnflag", "l_linestatus", ["l_shipyear"]), "chi2", "g2")


@query(f"SELECT x.case_id, x.node AS a, y.node AS b, count(*) AS n, {r('regr_slope(y.value, x.value)')} AS slope, {r('regr_intercept(y.value, x.value)')} AS intercept FROM ev x JOIN ev y ON x.t = y.t AND x.node < y.node GROUP BY 1, 2, 3")
def t11_regressions(spark, sf):
    return rounded(stats.regressions(tables.ev(spark, sf)).select("case_id", "a", "b", "n", "slope", "intercept"), "slope", "intercept")


_BIC = "2 * (-n / 2.0 * (ln(2 * pi()) + ln(greatest({} / n, 1e-12)) + 1)) - 2 * ({} + 2) * ln(n)"


@query(f"SELECT case_id, a, b, round({_BIC.format('syy', 0)}, 4) AS bic0, round({_BIC.format('(syy * (1 - coalesce(r2, 0)))', 1)}, 4) AS bic1 FROM (SELECT x.case_id, x.node AS a, y.node AS b, count(*) AS n, regr_syy(y.value, x.value) AS syy, regr_r2(y.value, x.value) AS r2 FROM ev x JOIN ev y ON x.t = y.t AND x.node < y.node GROUP BY 1, 2, 3)")
def sc1_gaussian_bic(spark, sf):
    return stats.gaussian_bic(stats.regressions(tables.ev(spark, sf))).select("case_id", "a", "b", F.round("bic0", 4).alias("bic0"), F.round("bic1", 4).alias("bic1"))


@query(
    """WITH l AS (SELECT *, lag(value) OVER (PARTITION BY case_id, node ORDER BY t) AS own FROM ev),
m AS (SELECT x.case_id, x.node AS a, y.node AS b, count(*) AS n, var_pop(y.value) AS yy, var_pop(y.own) AS zz, var_pop(x.own) AS xx, covar_pop(y.value, y.own) AS yz, covar_pop(y.value, x.own) AS yx, covar_pop(y.own, x.own) AS zx
  FROM l x JOIN l y ON x.t = y.t AND x.node <> y.node WHERE x.own IS NOT NULL AND y.own IS NOT NULL GROUP BY 1, 2, 3),
q AS (SELECT *, pow(yx - yz * zx / zz, 2) / (xx - zx * zx / zz) AS gain FROM m WHERE zz > 1e-12 AND xx - zx * zx / zz > 1e-12)
SELECT case_id, a, b, n, round(gain / ((yy - yz * yz / zz - gain) / (n - 3)), 5) AS f FROM q"""
)
def t8_granger_lag1(spark, sf):
    return stats.granger_lag1(tables.ev(spark, sf)).withColumn("f", F.round("f", 5))


@query(f"SELECT case_id, t, node, CAST(CASE WHEN lo = hi THEN 0 ELSE least(floor((value - lo) / (hi - lo) * 5), 4) END AS INTEGER) AS code FROM (SELECT *, min(value) OVER (PARTITION BY case_id, node) AS lo, max(value) OVER (PARTITION BY case_id, node) AS hi FROM ev)")
def c29_uniform_bins(spark, sf):
    return stats.discretise(tables.ev(spark, sf), 5, "uniform").select("case_id", "t", "node", "code")


@query("SELECT case_id, t, node, CAST((value > q1) AS INTEGER) + CAST((value > q2) AS INTEGER) + CAST((value > q3) AS INTEGER) AS code FROM li JOIN (SELECT case_id, node, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM li GROUP BY 1, 2) USING (case_id, node)")
def c29_quantile_bins(spark, sf):
    return stats.discretise(tables.li(spark, sf), 4, "quantile").select("case_id", "t", "node", "code")


@query(f"SELECT case_id, node, {r('value')} AS quantile FROM (SELECT *, row_number() OVER (PARTITION BY case_id, node ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY case_id, node) AS n FROM li) WHERE k = floor(0.98 * n)")
def index_quantile(spark, sf):
    return rounded(stats.index_quantile(tables.li(spark, sf), 0.98), "quantile")


@query(f"WITH s AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {steady('score')} DESC, node) AS k, {steady(f'score - lead(score) OVER (PARTITION BY case_id ORDER BY {steady_score} DESC, node)')} AS gap FROM (SELECT case_id, node, avg(value) AS score FROM usr GROUP BY 1, 2)) SELECT case_id, node, {r('score')} AS score FROM s JOIN (SELECT case_id, arg_min(k, (-gap, k)) AS cut FROM s WHERE gap IS NOT NULL GROUP BY 1) USING (case_id) WHERE k <= cut")
def attention_gap(spark, sf):
    return rounded(stats.attention_gap(tables.user(spark, sf).groupBy("case_id", "node").agg(F.avg("value").alias("score"))), "score")


_TEST = f"t >= {OLD}"


@query(
    f"""WITH d AS (SELECT y.case_id, g.src, g.dst, x.value AS x, y.value AS y, y.t >= {OLD} AS test FROM li y JOIN g_true g ON g.case_id = y.case_id AND g.dst = y.node JOIN li x ON x.case_id = g.case_id AND x.node = g.src AND x.t = y.t),
s AS (SELECT case_id, src, dst, coalesce(covar_pop(x, y) FILTER (NOT test) / nullif(var_pop(x) FILTER (NOT test), 0), 0) AS b FROM d GROUP BY 1, 2, 3),
q AS (SELECT case_id, src, dst, test, y - b * x AS e FROM d JOIN s USING (case_id, src, dst)),
m AS (SELECT case_id, src, dst, avg(e) FILTER (NOT test) AS m, stddev_pop(e) FILTER (NOT test) AS sd FROM q GROUP BY 1, 2, 3)
SELECT case_id, src, dst, round(max(abs((e - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END)), 5) AS score FROM q JOIN m USING (case_id, src, dst) WHERE test GROUP BY 1, 2, 3"""
)
def t11_residual_z(spark, sf):
    true, _, _ = halves(spark, sf)
    return stats.decide_parent_z(tables.li(spark, sf), true, F.col("t") >= OLD).withColumn("score", F.round("score", 5))


# Graph operators

_ENDS = "(SELECT p.case_id, p.a, p.b, p.mark AS at_b, q.mark AS at_a FROM m_true p JOIN m_true q ON p.case_id = q.case_id AND p.a = q.b AND p.b = q.a)"


@query(f"SELECT case_id, a AS src, b AS dst FROM {_ENDS} WHERE at_b = 1 OR at_a <> 1")
def g1_finalize(spark, sf):
    return graph.finalize_directed(marked(halves(spark, sf)[0]))


@query(f"SELECT case_id, b AS src, a AS dst FROM {_ENDS} WHERE at_b = 1 OR at_a <> 1")
def g3_effects_to_causes(spark, sf):
    return graph.reverse(graph.finalize_directed(marked(halves(spark, sf)[0])))


@query(
    f"""SELECT * FROM (SELECT case_id, a, b, CASE WHEN 2 IN (at_a, at_b) THEN 'circle' WHEN at_a = -1 AND at_b = -1 THEN 'undirected' WHEN at_a = 1 AND at_b = 1 THEN 'bidirected' ELSE 'directed' END AS kind,
  CASE WHEN 2 IN (at_a, at_b) THEN 'k' WHEN at_a = -1 AND at_b = -1 THEN 'g' WHEN at_a = 1 AND at_b = 1 THEN 'r' ELSE 'b' END AS colour FROM {_ENDS} e WHERE CASE WHEN 2 NOT IN (at_a, at_b) AND at_a <> at_b THEN at_b = 1 ELSE a < b END)"""
)
def g20_kinds(spark, sf):
    return graph.edge_kinds(marked(halves(spark, sf)[0]))


_RANK = """WITH w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM g_true), n AS (SELECT node, {j} AS j, NOT EXISTS (SELECT 1 FROM g_true WHERE src = node) AS loose FROM g_nodes)
{steps} SELECT '0' AS case_id, node, {out} AS score FROM r{last}"""


def rank_sql(steps: int, j: str) -> str:
    parts = [", r0 AS (SELECT node, j AS s FROM n)"]
    for k in range(1, steps + 1):
        p = k - 1
        parts.append(f", r{k} AS MATERIALIZED (SELECT n.node, 0.85 * (coalesce(i.s, 0) + (SELECT coalesce(sum(s), 0) FROM r{p} JOIN n USING (node) WHERE loose) * n.j) + 0.15 * n.j AS s FROM n LEFT JOIN (SELECT dst, sum(s * w) AS s FROM r{p} JOIN w ON src = node GROUP BY 1) i ON i.dst = n.node)")
    return _RANK.format(j=j, steps="".join(parts), last=steps, out=r("s"))


@query(rank_sql(10, "CAST(1 AS DOUBLE) / (SELECT count(*) FROM g_nodes)"))
def g4_page_rank(spark, sf):
    true, _, nodes = halves(spark, sf)
    return rounded(graph.page_rank(true, nodes), "score")


_TELEPORT = "(CASE WHEN EXISTS (SELECT 1 FROM g_true WHERE src = {n}) THEN 0.5 ELSE 1.0 END)"


@query(rank_sql(5, f"CAST({_TELEPORT.format(n='node')} AS DOUBLE) / (SELECT sum({_TELEPORT.format(n='k.node')}) FROM g_nodes k)"))
def g5_personalised(spark, sf):
    true, _, nodes = halves(spark, sf)
    return rounded(graph.page_rank(true, graph.random_teleport(true, nodes), steps=5, weight="weight"), "score")


_S9 = "SELECT case_id, node, avg(value) AS s FROM li GROUP BY 1, 2"
_T9 = f"""WITH s AS ({_S9}), m AS (SELECT src, dst, max(f * abs(s.s)) AS w FROM (SELECT src, dst, 0.5 AS f FROM g_true UNION ALL SELECT dst, src, 1.0 FROM g_true) e JOIN s ON s.node = e.dst GROUP BY 1, 2),
x AS (SELECT src, dst, w FROM m UNION ALL SELECT s.node, s.node, greatest(abs(s.s) - coalesce((SELECT max(w) FROM m WHERE src = s.node), 0), 0) FROM s),
p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p, w FROM x)"""


@query(f"{_T9} SELECT '0' AS case_id, src, dst, {r('p')} AS p FROM p WHERE w > 0")
def g9_transitions(spark, sf):
    true, _, _ = halves(spark, sf)
    return rounded(graph.transitions(true, tables.li(spark, sf).groupBy("case_id", "node").agg(F.avg("value").alias("score"))), "p")


@query(f"{_T9}, q AS (SELECT a.src AS k, a.dst AS i, b.dst AS j, 0.5 * a.p + 0.5 * b.p AS w FROM p a JOIN p b ON a.dst = b.src WHERE a.w > 0 AND b.w > 0) SELECT '0' AS case_id, k, i, j, {r('w / sum(w) OVER (PARTITION BY k, i)')} AS p FROM q")
def g11_second_order(spark, sf):
    true, _, _ = halves(spark, sf)
    p = graph.transitions(true, tables.li(spark, sf).groupBy("case_id", "node").agg(F.avg("value").alias("score")))
    return rounded(graph.second_order(p), "p")


@query("SELECT case_id, dst AS node, array_to_string(list_sort(list(DISTINCT src)), ',') AS parents FROM g_true GROUP BY 1, 2")
def g15_parents(spark, sf):
    return graph.parents(halves(spark, sf)[0]).withColumn("parents", F.array_join("parents", ","))


@query("SELECT DISTINCT case_id, split_part(src, '_', 1) AS src, split_part(dst, '_', 1) AS dst FROM g_true WHERE split_part(src, '_', 1) <> split_part(dst, '_', 1)")
def g17_services(spark, sf):
    return graph.collapse_services(halves(spark, sf)[0])


_NEAR = "near AS (SELECT src, dst FROM g_true UNION SELECT dst, src FROM g_true)"


@query(f"WITH {_NEAR} SELECT '0' AS case_id, x.src AS a, x.dst AS k, y.src AS b FROM near x JOIN near y ON x.dst = y.dst AND x.src < y.src WHERE NOT EXISTS (SELECT 1 FROM near z WHERE z.src = x.src AND z.dst = y.src)")
def g19_unshielded(spark, sf):
    return graph.unshielded_triples(halves(spark, sf)[0])


@query("SELECT '0' AS case_id, x.src AS a, x.dst AS b, y.dst AS c FROM g_true x JOIN g_true y ON x.dst = y.src JOIN g_true z ON z.src = x.src AND z.dst = y.dst")
def g19_triangles(spark, sf):
    return graph.triangles(halves(spark, sf)[0])


@query(f"WITH {_NEAR}, c AS (SELECT x.src AS a, y.src AS b, x.dst AS c FROM near x JOIN near y ON x.dst = y.dst AND x.src < y.src JOIN near z ON z.src = x.src AND z.dst = y.src) SELECT '0' AS case_id, p.a, p.b, p.c, q.c AS d FROM c p JOIN c q ON p.a = q.a AND p.b = q.b AND p.c < q.c WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.src = p.c AND n.dst = q.c)")
def g19_kites(spark, sf):
    return graph.kites(halves(spark, sf)[0])


@query(f"WITH {_NEAR} SELECT '0' AS case_id, x.src AS a, x.dst AS k, y.src AS b FROM g_true x JOIN g_true y ON x.dst = y.dst AND x.src < y.src WHERE NOT EXISTS (SELECT 1 FROM near z WHERE z.src = x.src AND z.dst = y.src)")
def g21_v_structures(spark, sf):
    return graph.v_structures(halves(spark, sf)[0])


_LAYERS = "WITH RECURSIVE path AS (SELECT node, 0 AS k FROM g_nodes UNION SELECT dst, k + 1 FROM path JOIN g_true ON src = node) SELECT '0' AS case_id, node, CAST(max(k) AS INTEGER) AS layer FROM path GROUP BY 2"


@query(_LAYERS)
def g14_layers(spark, sf):
    true, _, nodes = halves(spark, sf)
    return graph.layers(true, nodes)


@query("WITH RECURSIVE path AS (SELECT min(node) AS node, 0 AS k FROM g_nodes UNION SELECT dst, k + 1 FROM path JOIN g_true ON src = node WHERE k < 12) SELECT '0' AS case_id, node, CAST(min(k) AS INTEGER) AS hops FROM path GROUP BY 2")
def g25_hops(spark, sf):
    true, _, nodes = halves(spark, sf)
    return graph.hops(true, nodes.groupBy("case_id").agg(F.min("node").alias("node")), 12)


@query("SELECT case_id, src, dst FROM g_true WHERE NOT (regexp_matches(src, 'disc$') AND regexp_matches(dst, '^N')) AND NOT regexp_matches(dst, '^RF_q')")
def d11_forbidden(spark, sf):
    rules = spark.createDataFrame([("disc$", "^N"), (".*", "^RF_q")], "src_pattern string, dst_pattern string")
    return graph.forbid(halves(spark, sf)[0], rules)


_VISITS = ", ".join(["v0 AS (SELECT (SELECT min(node) FROM g_nodes) AS node, CAST(1 AS DOUBLE) AS m)"] + [f"v{k} AS MATERIALIZED (SELECT p.dst AS node, sum(m * p.p) AS m FROM v{k - 1} JOIN p ON p.src = node WHERE p.w > 0 GROUP BY 1)" for k in range(1, 7)])


@query(f"{_T9}, {_VISITS} SELECT '0' AS case_id, node, {r('sum(m) / 6')} AS score FROM ({' UNION ALL '.join(f'SELECT * FROM v{k}' for k in range(1, 7))}) GROUP BY 2")
def g10_expected_visits(spark, sf):
    true, _, nodes = halves(spark, sf)
    p = graph.transitions(true, tables.li(spark, sf).groupBy("case_id", "node").agg(F.avg("value").alias("score")))
    return rounded(graph.expected_visits(p, nodes.groupBy("case_id").agg(F.min("node").alias("node")), 6), "score")


def g18_sample(spark, sf):
    return graph.sample_nodes(tables.user(spark, sf).select("case_id", "node").distinct(), 3, seed=1)


QUERIES["g18_sample"] = g18_sample


# Evaluation

GRAPH_SQL["rank_usr"] = scored_sql("usr", USER, False)
GRAPH_SQL["answers_usr"] = "SELECT case_id, node, split_part(node, '_', 1) AS service, CASE WHEN node LIKE '%cnt' THEN 'cpu' ELSE 'delay' END AS fault FROM (SELECT case_id, arg_max(node, (value, node)) AS node FROM usr GROUP BY 1)"
GRAPH_SQL["hit_usr"] = "SELECT a.case_id, min(r.rank) AS rank FROM answers_usr a LEFT JOIN rank_usr r USING (case_id, node) WHERE a.case_id IN (SELECT case_id FROM rank_usr) GROUP BY 1"


def answers(spark, sf) -> DataFrame:
    best = tables.user(spark, sf).groupBy("case_id").agg(F.max(F.struct("value", "node")).alias("m")).select("case_id", F.col("m.node").alias("node"))
    return best.select("case_id", "node", frames.entity("node").alias("service"), F.when(F.col("node").endswith("cnt"), "cpu").otherwise("delay").alias("fault"))


def user_hits(spark, sf) -> DataFrame:
    return evaluate.hits(stats.n_sigma(tables.user(spark, sf), split.after(USER)), answers(spark, sf))


_AT = [f"avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END)" for k in range(1, 6)]


@query(f"SELECT {', '.join(f'{r(a)} AS ac{k}' for k, a in enumerate(_AT, 1))}, {r('(' + ' + '.join(_AT) + ') / 5')} AS avg5, count(*) AS cases FROM hit_usr")
def e1_e2_accuracy(spark, sf):
    return rounded(evaluate.accuracy(user_hits(spark, sf)), *(f"ac{k}" for k in range(1, 6)), "avg5")


@query(f"SELECT fault, service, {r(_AT[0])} AS top1, {r(_AT[2])} AS top3, {r(_AT[4])} AS top5, {r('(' + ' + '.join(_AT) + ') / 5')} AS avg5, count(*) AS cases FROM hit_usr JOIN answers_usr USING (case_id) GROUP BY ROLLUP (fault, service)")
def e5_report(spark, sf):
    return rounded(evaluate.report(user_hits(spark, sf), answers(spark, sf)), "top1", "top3", "top5", "avg5")


@query("SELECT case_id, fault, CASE WHEN fault IN ('delay', 'loss', 'disk') THEN 'latency' ELSE fault END AS metric FROM answers_usr")
def e4_metric_of_fault(spark, sf):
    return answers(spark, sf).select("case_id", "fault", evaluate.metric_of_fault().alias("metric"))


_PAIRS = """(SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, coalesce(x.ab, 0) AS ab, coalesce(x.ba, 0) AS ba, coalesce(y.ab, 0) AS eab, coalesce(y.ba, 0) AS eba
  FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(CAST(src < dst AS INTEGER)) AS ab, max(CAST(src > dst AS INTEGER)) AS ba FROM t GROUP BY 1, 2) x FULL JOIN
       (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(CAST(src < dst AS INTEGER)) AS ab, max(CAST(src > dst AS INTEGER)) AS ba FROM e GROUP BY 1, 2) y ON x.a = y.a AND x.b = y.b)"""
#: The estimated graph is g_est with the edges of even length reversed, or both ways.
_TE = "WITH t AS (SELECT src, dst FROM g_true), e AS (SELECT src, dst FROM g_est WHERE length(src) % 2 = 0 UNION SELECT dst, src FROM g_est WHERE ascii(dst) % 2 = 1)"


def turned(edges: DataFrame) -> DataFrame:
    return edges.where(F.length("src") % 2 == 0).unionByName(graph.reverse(edges.where(F.ascii("dst") % 2 == 1))).distinct()


@query(f"{_TE} SELECT '0' AS case_id, CAST(sum(CASE WHEN ab + ba = 0 OR eab + eba = 0 THEN 1 WHEN ab + ba = 2 AND eab + eba = 1 THEN 1 WHEN ab + ba = 1 AND (ab < eab OR ba < eba) THEN 1 ELSE 0 END) AS BIGINT) AS shd FROM {_PAIRS} p")
def e7_structural_distance(spark, sf):
    true, estimated, _ = halves(spark, sf)
    return evaluate.structural_distance(true, turned(estimated))


def f1_sql(t: str, e: str) -> str:
    return f"SELECT '0' AS case_id, {r('CASE WHEN tp > 0 THEN tp / ne ELSE 0 END')} AS precision, {r('CASE WHEN tp > 0 THEN tp / nt ELSE 0 END')} AS recall, {r('CASE WHEN tp > 0 THEN 2 * (tp / ne) * (tp / nt) / (tp / ne + tp / nt) ELSE 0 END')} AS f1 FROM (SELECT CAST((SELECT count(*) FROM {t}) AS DOUBLE) AS nt, CAST((SELECT count(*) FROM {e}) AS DOUBLE) AS ne, CAST((SELECT count(*) FROM {t} JOIN {e} USING (src, dst)) AS DOUBLE) AS tp)"


@query(f"{_TE} {f1_sql('t', 'e')}")
def e8_f1(spark, sf):
    true, estimated, _ = halves(spark, sf)
    return rounded(evaluate.f1(true, turned(estimated)), "precision", "recall", "f1")


@query(f"{_TE}, st AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t), se AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) {f1_sql('st', 'se')}")
def e9_f1_skeleton(spark, sf):
    true, estimated, _ = halves(spark, sf)
    return rounded(evaluate.f1_skeleton(true, turned(estimated)), "precision", "recall", "f1")


@query(
    f"""{_TE} SELECT '0' AS case_id, round(te / nullif(e, 0), 3) AS adj_precision, round(te / nullif(t, 0), 3) AS adj_recall, round(ate / nullif(ae, 0), 3) AS arrow_precision, round(ate / nullif(nat, 0), 3) AS arrow_recall FROM (
  SELECT CAST(count(*) FILTER (ab + ba > 0) AS DOUBLE) AS t, CAST(count(*) FILTER (eab + eba > 0) AS DOUBLE) AS e, CAST(count(*) FILTER (ab + ba > 0 AND eab + eba > 0) AS DOUBLE) AS te, CAST(count(*) FILTER (ab + ba = 1) AS DOUBLE) AS nat,
         CAST(count(*) FILTER (eab + eba = 1) AS DOUBLE) AS ae, CAST(count(*) FILTER (ab = eab AND ba = eba AND ab + ba = 1) AS DOUBLE) AS ate FROM {_PAIRS} p)"""
)
def e11_precision_recall(spark, sf):
    true, estimated, _ = halves(spark, sf)
    return evaluate.precision_recall(true, turned(estimated))


@query(f"{_TE} SELECT '0' AS case_id, round(avg(CASE WHEN t.src IS NULL THEN 1.0 ELSE 0.0 END), 3) AS fdr FROM e LEFT JOIN t ON e.src = t.src AND e.dst = t.dst")
def e12_false_discovery(spark, sf):
    true, estimated, _ = halves(spark, sf)
    return evaluate.false_discovery(true, turned(estimated))


@query(
    f"{_TE}, st AS (SELECT src, dst FROM t UNION SELECT dst, src FROM t), se AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT (SELECT f1 FROM ({f1_sql('t', 'e')})) AS f1, (SELECT f1 FROM ({f1_sql('st', 'se')})) AS f1_skeleton, "
    f"(SELECT CAST(sum(CASE WHEN ab + ba = 0 OR eab + eba = 0 THEN 1 WHEN ab + ba = 2 AND eab + eba = 1 THEN 1 WHEN ab + ba = 1 AND (ab < eab OR ba < eba) THEN 1 ELSE 0 END) AS BIGINT) FROM {_PAIRS} p) AS shd, CAST(1 AS BIGINT) AS cases"
)
def e14_report(spark, sf):
    true, estimated, _ = halves(spark, sf)
    return rounded(evaluate.discovery_report(true, turned(estimated)), "f1", "f1_skeleton")


@query(f"SELECT case_id, setting, {r('loss')} AS loss FROM (SELECT case_id, arg_min(setting, (loss, setting)) AS setting, min(loss) AS loss FROM (SELECT case_id, CAST(s AS INTEGER) AS setting, avg(abs(value - s)) AS loss FROM usr CROSS JOIN (SELECT unnest([1, 20, 50]) AS s) GROUP BY 1, 2) GROUP BY 1)")
def e15_best_setting(spark, sf):
    grid_ = tables.user(spark, sf).withColumn("setting", F.explode(F.array(F.lit(1), F.lit(20), F.lit(50))))
    return rounded(evaluate.best_setting(grid_.groupBy("case_id", "setting").agg(F.avg(F.abs(F.col("value") - F.col("setting"))).alias("loss"))), "loss")


# Kernels: one group a case; compared with fixtures in the tests


def _cases(frame: DataFrame, inject: int, sli: str) -> DataFrame:
    return frame.select("case_id").distinct().select("case_id", F.lit(inject).cast("long").alias("inject"), F.lit(sli).alias("sli"))


def _method(name: str) -> Query:
    def f(spark, sf):
        frame = tables.ev(spark, sf)
        return methods.run(frame, _cases(frame, EV, "view_lat"), name)

    return f


for _name in methods.METHODS:
    QUERIES[f"rca_{_name}"] = _method(_name)

#: Kernels of one case see its full grid, gaps filled forward.
GRAPH_SQL["filled"] = "SELECT case_id, t, node, pos, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY case_id, node ORDER BY t), 0) AS value FROM grid"

GRAPH_SQL["usr_filled"] = "SELECT case_id, t, node, pos, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY case_id, node ORDER BY t), 0) AS value FROM (SELECT t.case_id, t.t, n.node, n.pos, e.value FROM (SELECT DISTINCT case_id, t FROM usr) t JOIN (SELECT DISTINCT case_id, node, pos FROM usr) n USING (case_id) LEFT JOIN usr e USING (case_id, t, node, pos))"

#: A case in which no node varies on both sides has all nodes in column order, and says so.
_EMPTY = """
UNION ALL SELECT case_id, node, -CAST(row_number() OVER (PARTITION BY case_id ORDER BY pos) - 1 AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY pos) AS INTEGER) AS rank, 'empty' AS status
FROM (SELECT DISTINCT case_id, node, pos FROM {0}) WHERE case_id NOT IN (SELECT case_id FROM s)
"""

for _name, _frame, _inject, _robust in (("nsigma", "filled", EV, False), ("baro", "filled", EV, True), ("nsigma_users", "usr_filled", USER, False), ("baro_users", "usr_filled", USER, True)):
    ORACLES[f"rca_{_name}"] = with_frames(f"WITH s AS ({scored_sql(_frame, _inject, _robust, exact=True)}) SELECT *, 'ok' AS status FROM s {_EMPTY.format(_frame)}")


def _graph(name: str) -> Query:
    return lambda spark, sf: methods.discover_graphs(tables.ord_(spark, sf), name)


for _name in methods.GRAPHS:
    QUERIES[f"graph_{_name}"] = _graph(_name)


def _users(name: str) -> Query:
    """A method over all users' cases in one job."""

    def f(spark, sf):
        frame = tables.user(spark, sf)
        return methods.run(frame, _cases(frame, USER, "view_cnt"), name)

    return f


for _name in ("nsigma", "baro", "rcd", "circa", "pc_pagerank"):
    QUERIES[f"rca_{_name}_users"] = _users(_name)


@query()
def graph_pc_users(spark, sf):
    """A graph for each user, in one job."""
    return methods.discover_graphs(tables.user(spark, sf), "pc")


def _detector(name: str) -> Query:
    return lambda spark, sf: spot.detect(tables.ord_(spark, sf), name)


for _name in spot.DETECTORS:
    QUERIES[f"detect_{_name}"] = _detector(_name)


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return baro_ev(spark, sf_dir)
