"""Graphs as relations: edges (case_id, src, dst) with src the cause, nodes (case_id, node), marks (case_id, a, b, mark).

mark is the endpoint at b of the edge between a and b: -1 tail, 1 arrow, 2 circle; both rows of an edge are there.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rules of background knowledge that forbid() tries on every edge.
RULES = 10_000


def _both_ends(marks: DataFrame) -> DataFrame:
    """(case_id, a, b, at_a, at_b) of each edge, in both directions."""
    back = marks.select("case_id", F.col("b").alias("a"), F.col("a").alias("b"), F.col("mark").alias("at_a"))
    return marks.select("case_id", "a", "b", F.col("mark").alias("at_b")).join(back, ["case_id", "a", "b"], "full").fillna(0, ["at_a", "at_b"])


def finalize_directed(marks: DataFrame) -> DataFrame:
    """G1: edges src -> dst of endpoint marks. Tail-arrow and circle-arrow are one-way, all else goes both ways.

    Pairs of marks that no edge has (a missing end, an unknown code) raise an error.
    """
    ends = _both_ends(marks)
    known = F.col("at_a").isin(-1, 1, 2) & F.col("at_b").isin(-1, 1, 2)
    arrow = (F.col("at_b") == 1) | (F.col("at_a") != 1)
    keep = F.when(~known, F.raise_error(F.concat_ws(" ", F.lit("no edge has the marks"), "at_a", "at_b")).cast("boolean")).otherwise(arrow)
    return ends.where(keep).select("case_id", F.col("a").alias("src"), F.col("b").alias("dst"))


def reverse(edges: DataFrame) -> DataFrame:
    """Effect -> cause."""
    return edges.select("case_id", F.col("dst").alias("src"), F.col("src").alias("dst"))


def edge_kinds(marks: DataFrame) -> DataFrame:
    """Each edge once, with its kind (directed edges point from a to b) and colour."""
    ends = _both_ends(marks)
    x, y = F.col("at_a"), F.col("at_b")
    kind = F.when((x == 2) | (y == 2), "circle").when((x == -1) & (y == -1), "undirected").when((x == 1) & (y == 1), "bidirected").otherwise("directed")
    once = ends.withColumn("kind", kind).where((F.col("kind") == "directed") & (y == 1) | (F.col("kind") != "directed") & (F.col("a") < F.col("b")))
    return once.withColumn("colour", F.when(F.col("kind") == "undirected", "g").when(F.col("kind") == "directed", "b").when(F.col("kind") == "bidirected", "r").otherwise("k")).select("case_id", "a", "b", "kind", "colour")


def _shares(edges: DataFrame) -> DataFrame:
    return edges.withColumn("__w", 1 / F.count("*").over(Window.partitionBy("case_id", "src")))


def page_rank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, steps: int = 10, weight: str | None = None) -> DataFrame:
    """Steps rounds of power iteration along src -> dst for all cases at once.

    Nodes without an edge out give their mass to all nodes by the teleport shares: even, or by the column weight of nodes.
    """
    mass = F.sum(weight) if weight else F.count("*")
    totals = nodes.groupBy("case_id").agg(mass.alias("__t"))
    jump = F.col(weight) / F.col("__t") if weight else 1 / F.col("__t")
    rank = nodes.join(totals, "case_id").select("case_id", "node", jump.alias("__j")).withColumn("score", F.col("__j"))
    shares = _cut(_shares(edges).select(F.col("case_id").alias("__k"), F.col("src").alias("__src"), F.col("dst").alias("__dst"), "__w"))
    sources = shares.select(F.col("__k").alias("case_id"), F.col("__src").alias("node")).distinct().withColumn("__out", F.lit(True))
    rank = _cut(rank.join(sources, ["case_id", "node"], "left"))
    for k in range(steps):
        sent = rank.join(shares, (F.col("case_id") == F.col("__k")) & (F.col("node") == F.col("__src"))).groupBy(F.col("__k").alias("case_id"), F.col("__dst").alias("node")).agg(F.sum(F.col("score") * F.col("__w")).alias("__in"))
        loose = rank.where("__out is null").groupBy("case_id").agg(F.sum("score").alias("__l"))
        new = damping * (F.coalesce("__in", F.lit(0.0)) + F.coalesce("__l", F.lit(0.0)) * F.col("__j")) + (1 - damping) * F.col("__j")
        rank = rank.join(loose, "case_id", "left").join(sent, ["case_id", "node"], "left").withColumn("score", new).drop("__in", "__l")
        if k % 2 and k + 1 < steps:
            rank = _cut(rank)
    return rank.select("case_id", "node", "score")


def _cut(df: DataFrame) -> DataFrame:
    """End a plan that has grown with the rounds of a loop."""
    from ..session import materialize

    return materialize(df, "rounds")


def random_teleport(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with weight 1 where no edge goes out, else 0.5."""
    out = edges.select("case_id", F.col("src").alias("node")).distinct()
    return nodes.join(out.withColumn("__o", F.lit(True)), ["case_id", "node"], "left").select("case_id", "node", F.when(F.col("__o"), 0.5).otherwise(1.0).alias("weight"))


def transitions(edges: DataFrame, scores: DataFrame, rho: float = 0.5, leave_out: Column | None = None) -> DataFrame:
    """(case_id, src, dst, p): to a child rho |s|, to a parent |s|, stay max(|s| - the largest of those, 0).

    A node without any weight goes anywhere with equal chance.
    """
    s = scores.select("case_id", F.col("node").alias("dst"), F.abs("score").alias("__s"))
    ways = edges.select("case_id", "src", "dst", F.lit(rho).alias("__f")).unionByName(reverse(edges).withColumn("__f", F.lit(1.0)))
    moves = ways.join(s, ["case_id", "dst"]).groupBy("case_id", "src", "dst").agg(F.max(F.col("__f") * F.col("__s")).alias("w"))
    if leave_out is not None:
        moves = moves.withColumn("w", F.when(leave_out, 0.0).otherwise(F.col("w")))
    top = moves.groupBy("case_id", "src").agg(F.max("w").alias("__top"))
    stay = s.withColumnRenamed("dst", "src").join(top, ["case_id", "src"], "left").select("case_id", "src", F.col("src").alias("dst"), F.greatest(F.col("__s") - F.coalesce("__top", F.lit(0.0)), F.lit(0.0)).alias("w"))
    every = moves.where("src <> dst").unionByName(stay)
    total = F.sum("w").over(Window.partitionBy("case_id", "src"))
    weighed = every.withColumn("__t", total)
    lost = weighed.where("__t = 0").select("case_id", "src").distinct()
    nodes = scores.select("case_id", F.col("node").alias("dst"), F.count("*").over(Window.partitionBy("case_id")).alias("__n"))
    even = lost.join(nodes, "case_id").select("case_id", "src", "dst", (1 / F.col("__n")).alias("p"))
    return weighed.where("__t > 0 and w > 0").select("case_id", "src", "dst", (F.col("w") / F.col("__t")).alias("p")).unionByName(even)


def second_order(p: DataFrame, beta: float = 0.5) -> DataFrame:
    """(case_id, k, i, j, p): (1 - beta) p[k, i] + beta p[i, j], normalised over j."""
    first = p.select("case_id", F.col("src").alias("k"), F.col("dst").alias("i"), F.col("p").alias("__a"))
    rows = first.join(p.select("case_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.col("p").alias("__b")), ["case_id", "i"])
    w = rows.withColumn("__w", (1 - beta) * F.col("__a") + beta * F.col("__b"))
    return w.select("case_id", "k", "i", "j", (F.col("__w") / F.sum("__w").over(Window.partitionBy("case_id", "k", "i"))).alias("p"))


def expected_visits(p: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """Expected share of a walk's steps on each node, from start (case_id, node)."""
    p, total = _cut(p), None
    now = start.select("case_id", F.col("node").alias("src"), F.lit(1.0).alias("__m"))
    for k in range(steps):
        now = now.join(p, ["case_id", "src"]).groupBy("case_id", F.col("dst").alias("src")).agg(F.sum(F.col("__m") * F.col("p")).alias("__m"))
        total = now if total is None else total.unionByName(now)
        if k % 2 and k + 1 < steps:
            now = _cut(now)
    return total.groupBy("case_id", F.col("src").alias("node")).agg((F.sum("__m") / steps).alias("score"))


def parents(edges: DataFrame) -> DataFrame:
    """Sorted parents of each node that has any."""
    return edges.groupBy("case_id", F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("parents"))


def children(edges: DataFrame) -> DataFrame:
    return edges.groupBy("case_id", F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("children"))


def collapse_services(edges: DataFrame) -> DataFrame:
    """Edges between services, without loops."""
    of = lambda c: F.split(c, "_").getItem(0)
    return edges.select("case_id", of("src").alias("src"), of("dst").alias("dst")).where("src <> dst").distinct()


def sample_nodes(nodes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """K nodes of each case, drawn by a seeded hash without replacement."""
    order = Window.partitionBy("case_id").orderBy(F.xxhash64("node", F.lit(seed)), "node")
    return nodes.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).drop("__k")


def skeleton(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once."""
    return edges.select("case_id", "src", "dst").unionByName(reverse(edges)).distinct()


def unshielded_triples(edges: DataFrame) -> DataFrame:
    """(a, k, b), a < b, both adjacent to k and not to each other."""
    near = skeleton(edges)
    left = near.select("case_id", F.col("src").alias("a"), F.col("dst").alias("k"))
    paths = left.join(left.withColumnRenamed("a", "b"), ["case_id", "k"]).where("a < b")
    return paths.join(near.select("case_id", F.col("src").alias("a"), F.col("dst").alias("b")), ["case_id", "a", "b"], "left_anti").select("case_id", "a", "k", "b")


def triangles(edges: DataFrame) -> DataFrame:
    """A < b < c, all adjacent."""
    near = skeleton(edges).where("src < dst")
    ab, bc, ac = (near.select("case_id", F.col("src").alias(x), F.col("dst").alias(y)) for x, y in (("a", "b"), ("b", "c"), ("a", "c")))
    return ab.join(bc, ["case_id", "b"]).join(ac, ["case_id", "a", "c"]).select("case_id", "a", "b", "c")


def kites(edges: DataFrame) -> DataFrame:
    """Adjacent a < b with common neighbours c < d that aren't adjacent."""
    near = skeleton(edges)
    common = near.select("case_id", F.col("src").alias("a"), F.col("dst").alias("c")).join(near.select("case_id", F.col("src").alias("b"), F.col("dst").alias("c")), ["case_id", "c"]).where("a < b")
    common = common.join(near.select("case_id", F.col("src").alias("a"), F.col("dst").alias("b")), ["case_id", "a", "b"], "left_semi")
    two = common.join(common.withColumnRenamed("c", "d"), ["case_id", "a", "b"]).where("c < d")
    return two.join(near.select("case_id", F.col("src").alias("c"), F.col("dst").alias("d")), ["case_id", "c", "d"], "left_anti").select("case_id", "a", "b", "c", "d")


def v_structures(edges: DataFrame) -> DataFrame:
    """a -> k <- b with a < b not adjacent."""
    into = edges.select("case_id", F.col("src").alias("a"), F.col("dst").alias("k"))
    both = into.join(into.withColumnRenamed("a", "b"), ["case_id", "k"]).where("a < b")
    return both.join(skeleton(edges).select("case_id", F.col("src").alias("a"), F.col("dst").alias("b")), ["case_id", "a", "b"], "left_anti").select("case_id", "a", "k", "b")


def hops(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """Least number of edges from start (case_id, node) to each node that can be reached, or can in most steps.

    Repeated edges and starts count once; a null node is reached by nothing. Without starts there are no rows.
    """
    found = start.where("node is not null").select("case_id", "node", F.lit(0).alias("hops")).distinct()
    for k in itertools.count(1) if most is None else range(1, most + 1):
        front = found.where(F.col("hops") == k - 1).withColumnRenamed("node", "src").join(edges, ["case_id", "src"]).select("case_id", F.col("dst").alias("node")).distinct()
        front = front.join(found.select("case_id", "node"), ["case_id", "node"], "left_anti")
        found = _cut(found.unionByName(front.withColumn("hops", F.lit(k))))
        if found.where(F.col("hops") == k).isEmpty():
            break
    return found


def layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Longest path from a source (0 for sources) of each node of acyclic graphs; nodes on or behind cycles are left out."""
    left, out, layer = nodes.select("case_id", "node"), None, 0
    edges = edges.select("case_id", "src", "dst")
    while True:
        blocked = edges.join(left.withColumnRenamed("node", "src"), ["case_id", "src"], "left_semi").select("case_id", F.col("dst").alias("node")).distinct()
        free = _cut(left.join(blocked, ["case_id", "node"], "left_anti").withColumn("layer", F.lit(layer)))
        if free.isEmpty():
            break
        out = free if out is None else out.unionByName(free)
        left = _cut(left.join(free, ["case_id", "node"], "left_anti"))
        layer += 1
    return out if out is not None else left.withColumn("layer", F.lit(0)).where("false")


def forbid(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges without those that a rule (src_pattern, dst_pattern) forbids.

    Every rule is tried on every edge, so rules must be few: more than RULES are an error. Rules with a null forbid
    nothing, repeated edges stay repeated, and without rules all edges stay.
    """
    if rules.limit(RULES + 1).count() > RULES:
        raise ValueError(f"more than {RULES} rules: join edges with them by name instead")
    hit = F.rlike("src", F.col("src_pattern")) & F.rlike("dst", F.col("dst_pattern"))
    return edges.join(F.broadcast(rules), hit, "left_anti")


def threshold_graph(corr: DataFrame, least: float) -> DataFrame:
    """Edges a -> b (a < b) of correlations of least or more in size."""
    return corr.where(F.abs("r") >= least).select("case_id", F.col("a").alias("src"), F.col("b").alias("dst"))
