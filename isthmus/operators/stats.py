"""Graph statistics, histograms, bins and scaling-law fits; all are aggregates with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import Graph


def counts(g: Graph) -> DataFrame:
    """One row: nodes, edges (undirected ones once), avg_degree (null without nodes), meshedness."""
    n = g.vertices.agg(F.count(F.lit(1)).alias("nodes"))
    m = g.edges.agg(F.count(F.lit(1)).alias("ends"))
    m_of = F.col("ends") if g.directed else F.floor(F.col("ends") / 2)
    return n.crossJoin(m).select("nodes", m_of.cast("long").alias("edges"), (F.col("ends") / F.col("nodes")).alias("avg_degree"), meshedness(F.col("nodes"), m_of).alias("meshedness"))


def meshedness(n: Column, m: Column) -> Column:
    """(m - n + 1) / (2 n - 5)."""
    return (m - n + 1) / (2 * n - 5)


def degree_distribution(g: Graph) -> DataFrame:
    """(degree, cnt, frac) for every degree from 0 to the largest, also those that no vertex has."""
    found = g.degrees().groupBy("degree").agg(F.count(F.lit(1)).alias("cnt"))
    top = found.agg(F.max("degree").alias("top"), F.sum("cnt").alias("n"))
    every = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("degree"), "n")
    return every.join(found, "degree", "left").select("degree", F.coalesce("cnt", F.lit(0)).alias("cnt"), (F.coalesce("cnt", F.lit(0)) / F.col("n")).alias("frac"))


def degree_cdf(g: Graph) -> DataFrame:
    """degree_distribution with the running sum of fractions (one row for each degree, so one window is small)."""
    d = degree_distribution(g)
    upto = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("cnt").over(Window.partitionBy())
    return d.select("degree", "cnt", "frac", (F.sum("cnt").over(upto) / total).alias("cdf"))


def bin_edges(k: int, top: float) -> list[float]:
    """k + 1 edges of equal bins from 0 to a little above the top."""
    width = (top + 1e-6) / k
    return [i * width for i in range(k + 1)]


def histogram(values: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(bin, lo, hi, cnt) for right-closed bins (lo, hi]; values up to the first edge or beyond the last fall outside."""
    v = F.col(column)
    which = F.aggregate(F.array(*(F.lit(float(e)) for e in edges)), F.lit(-1), lambda acc, e: acc + F.when(v > e, 1).otherwise(0))
    found = values.where((v > edges[0]) & (v <= edges[-1])).groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    bins = values.sparkSession.createDataFrame([(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, lo double, hi double")
    return bins.join(found, "bin", "left").select("bin", "lo", "hi", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def add_histograms(*parts: DataFrame) -> DataFrame:
    """Sum of histograms over the same bins."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("bin", "lo", "hi").agg(F.sum("cnt").alias("cnt"))


def density(hist: DataFrame) -> DataFrame:
    """(bin, lo, hi, density, cdf) of a histogram: density integrates to 1."""
    total = F.sum("cnt").over(Window.partitionBy())
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return hist.select("bin", "lo", "hi", (F.col("cnt") / total / (F.col("hi") - F.col("lo"))).alias("density"), (F.sum("cnt").over(upto) / total).alias("cdf"))


def binned_means(rows: DataFrame, x: str, y: str, k: int, log: bool = False) -> DataFrame:
    """(bin, cnt, mean_x, mean_y) over k bins of x (log2 of both if log): bin = floor(k x / max x)."""
    r = rows.select((F.log2(x) if log else F.col(x).cast("double")).alias("x"), (F.log2(y) if log else F.col(y).cast("double")).alias("y"))
    top = r.agg(F.max("x").alias("top"))
    return r.crossJoin(F.broadcast(top)).groupBy(F.floor(k * F.col("x") / F.col("top")).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))


def box_bins(rows: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """(bin, cnt, q1, median, q3) of y by bins of x of the given width."""
    q = F.percentile(y, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(F.floor(F.col(x) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"), q.alias("q")).select("bin", "cnt", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"))


def hist2d(points: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """(bx, by, cnt) over n by n cells between the extremes; the largest values fall into the last cell."""
    ends = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    cell = lambda c, lo, hi: F.least(F.floor(n * (F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo))), F.lit(n - 1)).cast("long")
    return points.crossJoin(F.broadcast(ends)).groupBy(cell(x, "x0", "x1").alias("bx"), cell(y, "y0", "y1").alias("by")).agg(F.count(F.lit(1)).alias("cnt"))


def hist2d_log(points: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """hist2d of the binary logarithms of two positive columns."""
    return hist2d(points.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.log2(x).alias("x"), F.log2(y).alias("y")), "x", "y", n)


def binned_statistic(rows: DataFrame, x: str, y: str, k: int, log: bool = False) -> DataFrame:
    """(bin, centre, mean) between k edges from 0 (from 1 if log) to the largest x; bins hold their lower edge, the last one both.

    Edges are equally spaced, and centres midway; if log, equally spaced in the logarithm, and centres geometric. Bins
    without rows have none.
    """
    r = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    top = r.agg(F.max("x").alias("top"))
    at = F.ln("x") / F.ln("top") if log else F.col("x") / F.col("top")
    which = F.least(F.floor(at * (k - 1)), F.lit(k - 2)).cast("long")
    edge = lambda i: F.exp(F.ln("top") * i / (k - 1)) if log else F.col("top") * i / (k - 1)
    lo, hi = edge(F.col("bin")), edge(F.col("bin") + 1)
    centre = F.sqrt(lo * hi) if log else (lo + hi) / 2
    binned = r.where("x >= 1" if log else "x >= 0").crossJoin(F.broadcast(top)).withColumn("bin", which)
    return binned.groupBy("bin", "top").agg(F.avg("y").alias("mean")).select("bin", centre.alias("centre"), "mean")


def without_outliers(rows: DataFrame, x: str, below: float = 10_000_000) -> DataFrame:
    """Rows with x below a limit."""
    return rows.where(F.col(x) < below)


def to_power(rows: DataFrame, y: str, power: int) -> DataFrame:
    """Rows with y to a power: 3 makes a cube-root law a line, 2 a square-root law."""
    return rows.withColumn(y, F.pow(F.col(y), F.lit(float(power))))


def adjacency_lines(g: Graph) -> DataFrame:
    """(id, line): each vertex with its neighbours as text, for print-outs."""
    near = F.array_join(F.transform("neighbours", lambda v: v.cast("string")), " ")
    return g.adjacency().select("id", F.concat(F.col("id").cast("string"), F.lit(": "), near).alias("line"))


def line_fit(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row: slope, intercept, r, r2 of a least-squares line."""
    r = rows.select(x.alias("x"), y.alias("y"))
    return r.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.corr("y", "x").alias("r"), F.regr_r2("y", "x").alias("r2"))


def loglog_fit(rows: DataFrame, n: str = "n", s: str = "s", above: float = 256) -> DataFrame:
    """Line through log2 s over log2 n, for n above a limit."""
    return line_fit(rows.where(F.col(n) > above), F.log2(n), F.log2(s))


def cbrt_fit(rows: DataFrame, n: str = "n", s: str = "s") -> DataFrame:
    """s = a cbrt(n) + b."""
    return line_fit(rows, F.cbrt(n), F.col(s).cast("double"))


def through_origin(rows: DataFrame, f: Column, y: Column) -> DataFrame:
    """One row: a of y = a f, by least squares."""
    return rows.select(f.alias("f"), y.alias("y")).agg((F.sum(F.col("y") * F.col("f")) / F.sum(F.col("f") * F.col("f"))).alias("a"))


def power_fit(rows: DataFrame, n: str = "n", s: str = "s", lo: float = 0.0, hi: float = 1.0, steps: int = 100) -> DataFrame:
    """(a, b, c, sse) of s = a n^b + c with the least error: for each exponent of a grid a and c are linear, all in one pass."""
    grid = rows.select(F.col(n).cast("double").alias("x"), F.col(s).cast("double").alias("y"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("k"))
    f = grid.withColumn("b", lo + (hi - lo) * F.col("k") / steps).withColumn("f", F.pow("x", "b"))
    fits = f.groupBy("b").agg(F.regr_slope("y", "f").alias("a"), F.regr_intercept("y", "f").alias("c"), F.regr_syy("y", "f").alias("syy"), F.regr_sxy("y", "f").alias("sxy"), F.regr_sxx("y", "f").alias("sxx"))
    best = fits.withColumn("sse", F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"))
    return best.where("sxx > 0").orderBy("sse", "b").limit(1).select("a", "b", "c", "sse")


def power_fit_on_medians(boxes: DataFrame, x: Column) -> DataFrame:
    """(m, a) of median = a x^m: m from the log-log line, a by least squares."""
    r = boxes.where("median > 0").select(x.alias("x"), F.col("median").alias("y")).where("x > 0")
    m = r.agg(F.regr_slope(F.log2("y"), F.log2("x")).alias("m"))
    return r.crossJoin(F.broadcast(m)).groupBy("m").agg((F.sum(F.col("y") * F.pow("x", "m")) / F.sum(F.pow("x", 2 * F.col("m")))).alias("a"))


def sample_statistics(runs: DataFrame, mu: float = 2.2132652385, least_edges: int = 10_000) -> DataFrame:
    """From (run_id, n, m): runs with more than least_edges edges and their excess (m - mu n) / sqrt(n)."""
    return runs.where(F.col("m") > least_edges).select("run_id", "n", "m", ((F.col("m") - mu * F.col("n")) / F.sqrt("n")).alias("excess"))
