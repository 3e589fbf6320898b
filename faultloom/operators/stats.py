"""Statistics of frames: scores, correlations and least squares as aggregates over one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import series, steady


def ranked(scores: DataFrame) -> DataFrame:
    """Rank by score, larger first; scores that agree in ten significant digits are ties and keep the column order.

    Null scores come last; an empty table has no ranks. The window holds one row a node.
    """
    order = Window.partitionBy("case_id").orderBy(steady("score").desc_nulls_last(), "pos", "node")
    return scores.withColumn("rank", F.row_number().over(order)).select("case_id", "node", "score", "rank")


def _scored(frame: DataFrame, anomalous: Column, centre: Column, spread: Column, two_sided: bool) -> DataFrame:
    side = frame.withColumn("__a", anomalous)
    normal, value = F.when(~F.col("__a"), F.col("value")), F.when(F.col("__a"), F.col("value"))
    stats = side.groupBy("case_id", "node", "pos").agg(
        centre(normal).alias("__c"), spread(normal).alias("__s"), F.max(value).alias("__hi"), F.min(value).alias("__lo"), F.min(normal).alias("__n0"), F.max(normal).alias("__n1")
    )
    scale = F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)
    up, down = (F.col("__hi") - F.col("__c")) / scale, (F.col("__c") - F.col("__lo")) / scale
    kept = stats.where("__n0 <> __n1 and __lo <> __hi")
    return ranked(kept.withColumn("score", F.greatest(up, down) if two_sided else up))


def n_sigma(frame: DataFrame, anomalous: Column, two_sided: bool = False) -> DataFrame:
    """Largest z-score of the anomalous side by the normal side's mean and population deviation (zero counts as 1).

    Nodes that are constant on either side take no part. One shuffle: all aggregates are taken side by side.
    """
    return _scored(frame, anomalous, F.avg, F.stddev_pop, two_sided)


def robust(frame: DataFrame, anomalous: Column, two_sided: bool = False) -> DataFrame:
    """Largest (x - median) / interquartile range; otherwise as n_sigma()."""
    spread = lambda v: F.percentile(v, F.lit(0.75)) - F.percentile(v, F.lit(0.25))
    return _scored(frame, anomalous, F.median, spread, two_sided)


baro = robust


def median_shift(frame: DataFrame, anomalous: Column, alpha: float) -> DataFrame:
    """Nodes whose medians on both sides differ by more than alpha."""
    out = frame.withColumn("__a", anomalous).groupBy("case_id", "node").agg(F.median(F.when(F.col("__a"), F.col("value"))).alias("__x"), F.median(F.when(~F.col("__a"), F.col("value"))).alias("__y"))
    return out.withColumn("shift", F.abs(F.col("__x") - F.col("__y"))).where(F.col("shift") > alpha).select("case_id", "node", "shift")


def pairs(frame: DataFrame, lag: int = 0) -> DataFrame:
    """(case_id, t, a, b, x, y): readings of every two nodes a < b at one time; with lag, x is a's reading lag rows before
    and all ordered pairs are made."""
    left = frame.select("case_id", "t", F.col("node").alias("a"), F.col("value").alias("x"))
    if lag:
        left = frame.withColumn("x", F.lag("value", lag).over(series())).select("case_id", "t", F.col("node").alias("a"), "x").where("x is not null")
    right = frame.select("case_id", "t", F.col("node").alias("b"), F.col("value").alias("y"))
    return left.join(right, ["case_id", "t"]).where("a <> b" if lag else "a < b")


def correlations(frame: DataFrame) -> DataFrame:
    """Pearson r and number of common times of each pair a < b; 0 where it isn't defined."""
    r = F.coalesce(F.nanvl(F.corr("x", "y"), F.lit(0.0)), F.lit(0.0))
    return pairs(frame).groupBy("case_id", "a", "b").agg(r.alias("r"), F.count("*").alias("n"))


def gram(frame: DataFrame) -> DataFrame:
    """Sums n, sx, sy, sxx, syy, sxy of each pair a <= b: the sufficient statistics of all linear methods."""
    left = frame.select("case_id", "t", F.col("node").alias("a"), F.col("value").alias("x"))
    right = frame.select("case_id", "t", F.col("node").alias("b"), F.col("value").alias("y"))
    x, y = F.col("x"), F.col("y")
    sums = [F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")]
    return left.join(right, ["case_id", "t"]).where("a <= b").groupBy("case_id", "a", "b").agg(*sums)


def fisher_z(corr: DataFrame, given: int = 0) -> DataFrame:
    """z = sqrt(n - given - 3) atanh(r) of each pair."""
    r = F.greatest(F.least(F.col("r"), F.lit(1 - 1e-12)), F.lit(-1 + 1e-12))
    return corr.withColumn("z", F.sqrt(F.greatest(F.col("n") - given - 3, F.lit(0))) * F.atanh(r))


def partial_correlations(corr: DataFrame) -> DataFrame:
    """Partial r of each pair a < b given each one other node c."""
    both = corr.select("case_id", "a", "b", "r", "n").unionByName(corr.select("case_id", F.col("b").alias("a"), F.col("a").alias("b"), "r", "n"))
    ab = corr.select("case_id", "a", "b", F.col("r").alias("rab"), "n")
    ac = both.select("case_id", "a", F.col("b").alias("c"), F.col("r").alias("rac"))
    bc = both.select("case_id", F.col("a").alias("b"), F.col("b").alias("c"), F.col("r").alias("rbc"))
    rows = ab.join(ac, ["case_id", "a"]).where("c <> b").join(bc, ["case_id", "b", "c"])
    scale = F.sqrt((1 - F.col("rac") ** 2) * (1 - F.col("rbc") ** 2))
    return rows.select("case_id", "a", "b", "c", "n", F.coalesce((F.col("rab") - F.col("rac") * F.col("rbc")) / F.nullif(scale, F.lit(0.0)), F.lit(0.0)).alias("r"))


def depends_given_one(corr: DataFrame, critical: float) -> DataFrame:
    """Pairs that stay dependent (|z| > critical) alone and given any one other node: the superset of neighbours."""
    alone = fisher_z(corr).where(F.abs("z") > critical).select("case_id", "a", "b")
    given = fisher_z(partial_correlations(corr), 1).groupBy("case_id", "a", "b").agg(F.min(F.abs("z")).alias("w"))
    return alone.join(given, ["case_id", "a", "b"], "left").where(F.col("w").isNull() | (F.col("w") > critical)).select("case_id", "a", "b")


def contingency(left: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Observed and expected counts of the cells of two columns, within by."""
    by = by or []
    cells = left.groupBy(*by, a, b).agg(F.count("*").alias("observed"))
    row, column, all_ = (F.sum("observed").over(Window.partitionBy(*by, *extra)) for extra in ([a], [b], []))
    return cells.withColumn("expected", row * column / all_)


def chi_square(left: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """chi2, g2 and degrees of freedom of two columns, within by. Cells without counts add their expectation to chi2."""
    by = by or []
    cells = contingency(left, a, b, by)
    o, e = F.col("observed"), F.col("expected")
    sums = cells.groupBy(*by).agg(F.sum(o * o / e).alias("s"), F.sum(o).alias("n"), F.sum(2 * o * F.log(o / e)).alias("g2"), F.count_distinct(a).alias("ra"), F.count_distinct(b).alias("rb"))
    return sums.select(*by, (F.col("s") - F.col("n")).alias("chi2"), "g2", ((F.col("ra") - 1) * (F.col("rb") - 1)).alias("dof"))


def regressions(frame: DataFrame, lag: int = 0) -> DataFrame:
    """y on x of each pair: slope, intercept, residual sum of squares, n."""
    out = pairs(frame, lag).groupBy("case_id", "a", "b").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_syy("y", "x").alias("syy"), F.regr_r2("y", "x").alias("r2"), F.count("*").alias("n"))
    return out.withColumn("rss", F.col("syy") * (1 - F.coalesce("r2", F.lit(0.0))))


def gaussian_bic(pair_stats: DataFrame, penalty: float = 2.0) -> DataFrame:
    """Local scores of b: alone (bic0) and with parent a (bic1), from regressions()."""
    n = F.col("n")
    of = lambda rss, k: 2 * (-n / 2 * (F.log(F.lit(2 * 3.141592653589793)) + F.log(F.greatest(rss / n, F.lit(1e-12))) + 1)) - penalty * (k + 2) * F.log(n)
    return pair_stats.withColumn("bic0", of(F.col("syy"), 0)).withColumn("bic1", of(F.col("rss"), 1))


def granger_lag1(frame: DataFrame) -> DataFrame:
    """F statistic (lag 1) that a's last reading adds to b's own last one in predicting b, from moments of three columns."""
    lagged = frame.withColumn("own", F.lag("value").over(series())).where("own is not null")
    left = lagged.select("case_id", "t", F.col("node").alias("a"), F.col("own").alias("x"))
    right = lagged.select("case_id", "t", F.col("node").alias("b"), F.col("value").alias("y"), F.col("own").alias("z"))
    rows = left.join(right, ["case_id", "t"]).where("a <> b")
    cov = lambda p, q: F.covar_pop(p, q)
    m = rows.groupBy("case_id", "a", "b").agg(F.count("*").alias("n"), F.var_pop("y").alias("yy"), F.var_pop("z").alias("zz"), F.var_pop("x").alias("xx"), cov("y", "z").alias("yz"), cov("y", "x").alias("yx"), cov("z", "x").alias("zx"))
    small = F.col("yy") - F.col("yz") ** 2 / F.col("zz")
    free = F.col("xx") - F.col("zx") ** 2 / F.col("zz")
    gain = (F.col("yx") - F.col("yz") * F.col("zx") / F.col("zz")) ** 2 / free
    return m.where("zz > 1e-12").where(free > 1e-12).withColumn("f", gain / ((small - gain) / (F.col("n") - 3))).select("case_id", "a", "b", "n", "f")


def decide_parent_z(frame: DataFrame, edges: DataFrame, test: Column) -> DataFrame:
    """Largest |z| of each child's test residuals on its one parent (edges: case_id, src, dst), by the training residuals."""
    x = frame.select("case_id", "t", F.col("node").alias("src"), F.col("value").alias("x"))
    y = frame.select("case_id", "t", F.col("node").alias("dst"), F.col("value").alias("y"))
    rows = y.join(edges, ["case_id", "dst"]).join(x, ["case_id", "t", "src"]).withColumn("__test", test)
    tx, ty = F.when(~F.col("__test"), F.col("x")), F.when(~F.col("__test"), F.col("y"))
    own = Window.partitionBy("case_id", "src", "dst")
    slope = F.coalesce(F.covar_pop(tx, ty).over(own) / F.nullif(F.var_pop(tx).over(own), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("__r", F.col("y") - slope * F.col("x"))
    train = F.when(~F.col("__test"), F.col("__r"))
    spread = F.stddev_pop(train).over(own)
    z = (F.col("__r") - F.avg(train).over(own)) / F.when(spread > 0, spread).otherwise(1.0)
    return rows.withColumn("__z", F.abs(z)).where("__test").groupBy("case_id", "src", "dst").agg(F.max("__z").alias("score"))


def discretise(frame: DataFrame, bins: int = 5, how: str = "quantile") -> DataFrame:
    """Codes by equal widths or by exact quantiles (uniform, quantile).

    Cuts are of the very readings that are coded: a second evaluation of the frame may add up its sums in another order.
    They are interpolated with one rounding less (fma), as DuckDB does, which decides between neighbouring doubles. With
    quantiles, a gap's code is null, and rows without case or node have none.
    """
    own = Window.partitionBy("case_id", "node")
    if how == "uniform":
        low, high = F.min("value").over(own), F.max("value").over(own)
        code = F.when(low == high, 0).otherwise(F.least(F.floor((F.col("value") - low) / (high - low) * bins), F.lit(bins - 1)))
        return frame.withColumn("code", code.cast("int"))
    kept = frame.columns
    rows = frame.where("case_id is not null and node is not null")
    rows = rows.withColumn("__k", F.row_number().over(own.orderBy(F.col("value").asc_nulls_last())) - 1).withColumn("__n", F.count("value").over(own))
    code = F.when(F.col("value").isNotNull(), 0)
    for j in range(1, bins):
        place = (F.col("__n") - 1) * F.lit(j / bins)
        low, high = (F.max(F.when(F.col("__k") == f(place), F.col("value"))).over(own) for f in (F.floor, F.ceil))
        rows = rows.withColumns({f"__low{j}": low, f"__high{j}": high, f"__part{j}": place - F.floor(place)})
        low, high, part = (F.col(f"__{x}{j}") for x in ("low", "high", "part"))
        between = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - part, high * part).cast("double")
        code += (F.col("value") > F.when(low < high, between).otherwise(low)).cast("int")
    return rows.withColumn("code", code).select(*kept, "code")


def index_quantile(frame: DataFrame, q: float) -> DataFrame:
    """Value at place floor(q n) (from 0) of each node's sorted readings."""
    own = Window.partitionBy("case_id", "node")
    rows = frame.withColumn("__k", F.row_number().over(own.orderBy("value")) - 1).withColumn("__n", F.count("*").over(own))
    return rows.where(F.col("__k") == F.floor(F.lit(q) * F.col("__n"))).select("case_id", "node", F.col("value").alias("quantile"))


def attention_gap(scores: DataFrame) -> DataFrame:
    """Nodes above the largest gap between neighbours of the sorted scores; scores and gaps count to ten digits.

    Of equal gaps the first counts, of equal scores the lesser node comes first; a case of one node keeps it out of any gap.
    """
    order = Window.partitionBy("case_id").orderBy(steady("score").desc(), "node")
    rows = scores.withColumn("k", F.row_number().over(order)).withColumn("gap", steady(F.col("score") - F.lead("score").over(order)))
    cut = rows.groupBy("case_id").agg(F.max(F.struct("gap", -F.col("k"))).alias("m")).select("case_id", (-F.col("m.col2")).alias("cut"))
    return rows.join(cut, "case_id").where(F.col("k") <= F.col("cut")).select("case_id", "node", "score")
