import inspect
import math
import random

import pytest
from pyspark.sql import functions as F

from faultloom.operators import clean, evaluate, frames, graph, split, stats
from faultloom.plans import methods, queries
from faultloom.sources import files
from faultloom.streaming import spot

FRAME = "case_id string, t long, node string, pos int, value double"


@pytest.fixture(scope="module")
def tiny(spark):
    """One case, ten times, inject at 6: a constant, a near constant, a spike, gaps and infinities, an all-gap node."""
    nan, inf = float("nan"), float("inf")
    columns = {"a_cpu": [1.0] * 10, "b_mem": [1e6] * 8 + [3e6, 2e6], "c_lat": [1, 2, 1, 2, 1, 2, 9, 8, 1, 2.0], "d_cpu": [None, 1, inf, 3, nan, -inf, 7, None, 2, 5], "e_cpu": [None] * 10}
    rows = [("x", t, n, p, None if v[t] is None else float(v[t])) for p, (n, v) in enumerate(columns.items()) for t in range(10)]
    return spark.createDataFrame(rows, FRAME)


def values(df, node):
    return [r.value for r in df.where(F.col("node") == node).orderBy("t").collect()]


def test_fill(tiny):
    assert values(clean.forward_fill(tiny), "d_cpu") == [0, 1, 1, 3, 3, 3, 7, 7, 2, 5]
    assert values(clean.forward_fill(tiny, zero=False), "d_cpu")[0] is None
    assert values(clean.fill_both(tiny), "d_cpu") == [1, 1, 3, 3, 7, 7, 7, 2, 2, 5]
    assert values(clean.fill_both(tiny), "e_cpu") == [0] * 10


def test_column_rules(tiny):
    nodes = lambda df: {r.node for r in df.select("node").distinct().collect()}
    assert nodes(clean.drop_constant(tiny)) == {"b_mem", "c_lat", "d_cpu", "e_cpu"}
    assert nodes(clean.drop_single_valued(tiny)) == {"b_mem", "c_lat", "d_cpu", "e_cpu"}
    assert nodes(clean.drop_near_constant(tiny, 0.25)) == {"c_lat", "d_cpu", "e_cpu"}
    assert nodes(clean.select_useful(clean.forward_fill(tiny))) == {"b_mem", "d_cpu"}
    assert nodes(clean.varying_on_both_sides(clean.forward_fill(tiny), split.after(6))) == {"c_lat", "d_cpu"}
    assert values(clean.memory_in_mb(tiny), "b_mem")[-2:] == [3, 2] and values(clean.preprocess(tiny, None), "b_mem")[0] == 1e6


def test_scores_by_hand(tiny):
    got = {r.node: (r.score, r["rank"]) for r in stats.n_sigma(clean.forward_fill(tiny), split.after(6)).collect()}
    assert got["c_lat"] == (pytest.approx((9 - 1.5) / 0.5), 1) and set(got) == {"c_lat", "d_cpu"}
    got = {r.node: r.score for r in stats.baro(clean.forward_fill(tiny), split.after(6)).collect()}
    assert got["c_lat"] == pytest.approx((9 - 1.5) / 1)


def test_scores_ignore_row_order_and_scale(tiny):
    f = clean.forward_fill(tiny)
    one = {r.node: (round(r.score, 9), r["rank"]) for r in stats.n_sigma(f, split.after(6)).collect()}
    two = {r.node: (round(r.score, 9), r["rank"]) for r in stats.n_sigma(f.repartition(5).withColumn("value", 3 * F.col("value") + 7), split.after(6)).collect()}
    assert one == two


def test_ties_keep_column_order(spark):
    rows = [("x", t, n, p, float(t % 2 + (5 if t == 7 else 0))) for p, n in enumerate(["z_m", "a_m"]) for t in range(10)]
    got = stats.n_sigma(spark.createDataFrame(rows, FRAME), split.after(6)).orderBy("rank").collect()
    assert [r.node for r in got] == ["z_m", "a_m"]


def test_wide_round_trip(spark):
    wide = spark.createDataFrame([(1, 2.0, None), (2, 3.0, 4.0)], "time long, s_a double, s_b double")
    long = frames.from_wide(wide)
    assert long.count() == 4 and [tuple(r) for r in frames.to_wide(long, ["s_a", "s_b"]).select("t", "s_a", "s_b").collect()] == [(1, 2.0, None), (2, 3.0, 4.0)]


def test_empty_and_one_sided_frames(spark, tiny):
    none = tiny.limit(0)
    assert stats.n_sigma(none, split.after(6)).count() == 0 and clean.resample(none, 0, 10, 2).count() == 0
    assert stats.baro(tiny.where("t < 6"), split.after(6)).count() == 0
    cases = spark.createDataFrame([("x", 6)], "case_id string, inject long")
    assert methods.run(none, cases, "nsigma").count() == 0
    got = methods.run(tiny.where("t < 6"), cases, "nsigma").collect()
    assert {r.status for r in got} == {"empty"} and [r.node for r in got] == ["a_cpu", "b_mem", "c_lat", "d_cpu", "e_cpu"]


def test_kernel_agrees_with_the_frame_operator(spark, tiny):
    cases = spark.createDataFrame([("x", 6)], "case_id string, inject long")
    for name, f in (("nsigma", stats.n_sigma), ("baro", stats.baro)):
        got = {(r.node, round(r.score, 9), r["rank"]) for r in methods.run(tiny, cases, name).collect()}
        assert got == {(r.node, round(r.score, 9), r["rank"]) for r in f(clean.forward_fill(tiny), split.after(6)).collect()}


def test_errors_are_reported_not_hidden(spark, tiny):
    cases = spark.createDataFrame([("x", 6)], "case_id string, inject long")

    def broken(case):
        raise ValueError("no")

    assert {r.status for r in methods.run(tiny, cases, broken).collect()} == {"ValueError: no"}


def edges(spark, *pairs):
    return spark.createDataFrame([("g", a, b) for a, b in pairs], "case_id string, src string, dst string")


def test_graph_measures(spark):
    g, none = edges(spark, ("a", "b"), ("b", "c"), ("c", "a")), edges(spark, ("a", "b")).limit(0)
    assert evaluate.structural_distance(g, g).first().shd == 0 and evaluate.f1(g, g).first().f1 == 1.0
    assert evaluate.structural_distance(g, graph.reverse(g)).first().shd == 3 and evaluate.f1_skeleton(g, graph.reverse(g)).first().f1 == 1.0
    assert evaluate.f1(g, none).first().f1 == 0.0 and evaluate.structural_distance(g, none).first().shd == 3
    both = g.unionByName(graph.reverse(edges(spark, ("a", "b"))))
    assert evaluate.structural_distance(both, g).first().shd == 1 and evaluate.structural_distance(g, both).first().shd == 1
    assert evaluate.discovery_report(g, g).first().f1 == 1.0


def test_invalid_marks_raise(spark):
    bad = spark.createDataFrame([("g", "a", "b", 1)], "case_id string, a string, b string, mark int")
    with pytest.raises(Exception, match="no edge has the marks"):
        graph.finalize_directed(bad).collect()


def test_page_rank_sums_to_one_and_transitions_too(spark):
    g = edges(spark, ("a", "b"), ("b", "c"), ("a", "c"))
    nodes = spark.createDataFrame([("g", x) for x in "abcd"], "case_id string, node string")
    rank = graph.page_rank(g, nodes, steps=4)
    assert rank.agg(F.sum("score")).first()[0] == pytest.approx(1) and rank.count() == 4
    p = graph.transitions(g, nodes.withColumn("score", F.lit(1.0)))
    assert all(r.s == pytest.approx(1) for r in p.groupBy("src").agg(F.sum("p").alias("s")).collect())
    flat = graph.transitions(g, nodes.withColumn("score", F.lit(0.0)))
    assert {round(r.p, 9) for r in flat.collect()} == {0.25} and flat.count() == 16
    visits = graph.expected_visits(p, nodes.where("node = 'a'"), 4)
    assert visits.agg(F.sum("score")).first()[0] == pytest.approx(1)


def test_accuracy_by_hand(spark):
    ranks = spark.createDataFrame([("1", "s_a", 1), ("1", "s_b", 2), ("2", "s_a", 1), ("2", "t-db_b", 2), ("3", "s_a", 1)], "case_id string, node string, rank int")
    answers = spark.createDataFrame([("1", "s_a"), ("2", "t-db_b"), ("3", "s_z"), ("4", "s_a")], "case_id string, node string")
    got = evaluate.accuracy(evaluate.hits(ranks, answers)).first()
    assert (got.cases, got.ac1, got.ac2, got.avg5) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3), pytest.approx((1 / 3 + 4 * 2 / 3) / 5))
    assert got.ac1 <= got.avg5 <= got.ac5
    assert {(r.case_id, r.node, r["rank"]) for r in evaluate.service_ranks(ranks).collect()} == {("1", "s", 1), ("2", "s", 1), ("2", "t", 2), ("3", "s", 1)}


def test_files(spark, tmp_path):
    for folder, names in (("shop/cart_cpu/1", ["data.csv", "simple_data.csv"]), ("shop/cart_mem/2", ["data.csv"])):
        (tmp_path / folder).mkdir(parents=True)
        for name in names:
            (tmp_path / folder / name).write_text("time,a_cpu,a_latency-50,a_latency-90\n1,1.5,1,2\n2,,1,inf\n3,4,1,5\n")
        (tmp_path / folder / "inject_time.txt").write_text("2\n")
    got = files.discover_cases(spark, str(tmp_path)).orderBy("case").collect()
    assert [(r.service, r.fault, r.case, r.path.endswith("simple_data.csv")) for r in got] == [("cart", "cpu", "1", True), ("cart", "mem", "2", False)]
    assert {r.inject_time for r in files.sidecars(spark, str(tmp_path)).collect()} == {"2"}
    frame = files.read_metrics(spark, str(tmp_path / "shop/cart_mem/2/data.csv"))
    assert values(frame, "a_cpu") == [1.5, 1.5, 4] and values(frame, "a_latency") == [2, 2, 5] and frame.select("node").distinct().count() == 2
    many = files.read_cases(spark, str(tmp_path))
    assert many.select("case_id").distinct().count() == 2 and many.count() == 18
    (tmp_path / "plain.csv").write_text("1,2\n3,4\n")
    assert values(files.read_headerless(spark, str(tmp_path / "plain.csv")), "1") == [2, 4]
    pair = files.read_pair(spark, str(tmp_path / "shop/cart_cpu/1/data.csv"), str(tmp_path / "shop/cart_mem/2/data.csv"))
    assert values(pair, "F") == [0, 0, 0, 1, 1, 1]


def test_graph_and_rank_files(spark, tmp_path):
    g = edges(spark, ("a", "b"), ("b", "c"))
    nodes = spark.createDataFrame([("g", x) for x in "abcd"], "case_id string, node string")
    files.write_graph(g, nodes, str(tmp_path / "g"))
    back, named = files.read_graph(spark, str(tmp_path / "g"))
    assert {tuple(r) for r in back.collect()} == {("g", "a", "b"), ("g", "b", "c")} and named.count() == 4
    (tmp_path / "bad.json").write_text('{"nodes": ["a"]}\n')
    with pytest.raises(files.InvalidGraphError):
        files.read_graph(spark, str(tmp_path / "bad.json"))
    ranks = spark.createDataFrame([("1", "x", 1), ("1", "y", 2)], "case_id string, node string, rank int")
    files.write_ranks(ranks, str(tmp_path / "r"))
    assert {tuple(r) for r in files.read_ranks(spark, str(tmp_path / "r")).collect()} == {("1", "x", 1), ("1", "y", 2)}


def test_stream_gives_the_batch_alarms(spark, tmp_path):
    import numpy as np

    x = np.random.default_rng(7).normal(size=160)
    x[140] = 15
    rows = spark.createDataFrame([("c", int(t), n, 0, float(v)) for n in ("p", "q") for t, v in enumerate(x)], FRAME)
    for k, (low, high) in enumerate(((0, 60), (60, 110), (110, 160))):
        rows.where(f"t >= {low} and t < {high}").coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = spot.detect_stream(stream, "spot", start_after=50).writeStream.format("memory").queryName("alarms").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.node, r.t) for r in spark.sql("select * from alarms where alarm").collect()}
    batch = {(r.node, r.t) for r in spot.detect(rows, "spot", init=50 / 160).where("alarm").collect()}
    assert got == batch and ("p", 140) in got
    assert spark.sql("select count(*) from alarms").first()[0] == 220


def test_moving_average_pads_the_ends(spark):
    f = spark.createDataFrame([("x", t, "n", 0, float(t)) for t in range(5)], FRAME)
    got = [r.trend for r in clean.moving_average(f, 3).orderBy("t").collect()]
    assert got == [pytest.approx(v) for v in (1 / 3, 1, 2, 3, 11 / 3)]


def test_resample_interpolates(spark):
    f = spark.createDataFrame([("x", 0, "n", 0, 1.0), ("x", 1, "n", 0, 3.0), ("x", 8, "n", 0, 8.0)], FRAME)
    got = [r.value for r in clean.resample(f, 0, 10, 2).orderBy("t").collect()]
    assert got == [pytest.approx(v) for v in (2, 3.5, 5, 6.5, 8, 8)]
    assert not any(math.isnan(v) for v in got)


def test_repeated_readings_and_times_as_nodes(spark):
    rows = [("a", 1, "x_cnt", 0, 1.0), ("a", 1, "x_cnt", 0, 3.0), ("a", 2, "x_cnt", 0, None), ("a", 1, "Time", 1, 9.0), (None, 1, "x_cnt", 0, 2.0)]
    frame = spark.createDataFrame(rows, "case_id string, t long, node string, pos int, value double")
    assert sorted(map(str, frames.once(frames.drop_time(frame)).collect())) == sorted(map(str, spark.createDataFrame([("a", 1, "x_cnt", 0, 3.0), ("a", 2, "x_cnt", 0, None), (None, 1, "x_cnt", 0, 2.0)], frame.schema).collect()))
    assert {(r.node, r.number) for r in frames.column_numbers(frame.where("case_id = 'a'")).collect()} == {("x_cnt", 0), ("Time", 1)}
    assert frames.once(frame.limit(0)).count() == 0


def test_paths_have_all_their_hops(spark):
    edges = spark.createDataFrame([("a", f"n{k}", f"n{k + 1}") for k in range(6)], "case_id string, src string, dst string")
    start = spark.createDataFrame([("a", "n0")], "case_id string, node string")
    assert inspect.signature(graph.hops).parameters["most"].default is None
    found = {r.node: r.hops for r in graph.hops(edges, start).collect()}
    assert found == {f"n{k}": k for k in range(7)}


def test_more_rules_than_allowed_are_an_error(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "x", "y"), ("a", "y", "x")], "case_id string, src string, dst string")
    rules = spark.createDataFrame([("^x$", ".*"), ("^q", ".*"), (None, "z")], "src_pattern string, dst_pattern string")
    assert [(r.src, r.dst) for r in graph.forbid(edges, rules).collect()] == [("y", "x")]
    monkeypatch.setattr(graph, "RULES", 2)
    with pytest.raises(ValueError, match="rules"):
        graph.forbid(edges, rules)


def test_quantile_codes_of_neighbouring_doubles(spark):
    """Cuts between doubles that differ in the last bits, and gaps, count as in SQL."""
    import duckdb

    rng, rows = random.Random(1), []
    for k in range(120):
        base = rng.choice([0.05, 0.1, 7.3, 1e9 / 3, 1e-5, -0.07])
        rows += [("0", t, f"n{k}", k, base + rng.randrange(4) * math.ulp(base)) for t in range(rng.randint(1, 14))]
    rows += [("0", t, "gap", 120, None if t % 3 else float(t)) for t in range(9)] + [("0", 0, "none", 121, None)]
    got = stats.discretise(spark.createDataFrame(rows, "case_id string, t long, node string, pos int, value double"), 4, "quantile")
    duck = duckdb.connect()
    duck.execute("CREATE TABLE li (case_id VARCHAR, t BIGINT, node VARCHAR, pos INTEGER, value DOUBLE)")
    duck.executemany("INSERT INTO li VALUES (?, ?, ?, ?, ?)", rows)
    sql = queries.ORACLES["c29_quantile_bins"]
    want = duck.execute(sql[sql.rindex("SELECT case_id, t, node, CAST(") :]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select("case_id", "t", "node", "code").collect())
