"""Tables behind landscapes, densities, violins and timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.stats import percentile
from orrery.operators.windows import label_blocks

#: Fixed value: Boltzmann constant in kcal/(mol K).
BOLTZMANN = 0.001987204


def bin_of(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin from 0; the last is closed on the right."""
    k = F.floor((x - lo) / ((hi - lo) / bins)).cast("int")
    return F.when(x == hi, bins - 1).otherwise(F.least(k, F.lit(bins - 1)))


def histogram(points: DataFrame, bins: int, x: str = "x", y: str = "y") -> DataFrame:
    """bx, by, p: share of the points in each cell that has any; edges evenly from least to largest."""
    edges = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count(F.lit(1)).alias("total"))
    placed = points.crossJoin(F.broadcast(edges)).select(bin_of(F.col(x), F.col("x0"), F.col("x1"), bins).alias("bx"), bin_of(F.col(y), F.col("y0"), F.col("y1"), bins).alias("by"), "total")
    return placed.groupBy("bx", "by").agg((F.count(F.lit(1)) / F.first("total")).alias("p"))


def energy(cells: DataFrame, temperature: float = 300.0, p: str = "p") -> DataFrame:
    """Free energy of each cell over the lowest, in kcal/mol; empty cells have no row."""
    top = cells.agg(F.max(p).alias("_top"))
    return cells.crossJoin(F.broadcast(top)).withColumn("energy", -BOLTZMANN * temperature * F.log(F.col(p) / F.col("_top"))).drop("_top")


def energy_range(cells: DataFrame) -> DataFrame:
    return cells.agg(F.lit(0.0).alias("low"), percentile(F.col("energy"), 0.99).alias("high"))


def below(cells: DataFrame, threshold: float) -> DataFrame:
    """Energies above the threshold or not a number become null."""
    return cells.withColumn("energy", F.when(~F.isnan("energy") & (F.col("energy") <= threshold), F.col("energy")))


def density(values: DataFrame, points: int = 300, by: Sequence[str] = (), value: str = "value", margin: float = 0.2) -> DataFrame:
    """Gaussian density on an even grid over the range widened on both sides; bandwidth n^(-1/5) standard deviations.

    Values are counted first, so the grid meets each distinct value once.
    """
    by = list(by)
    stats = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    stats = stats.withColumn("h", F.col("s") * F.pow(F.col("n"), F.lit(-0.2))).withColumn("w", F.col("hi") - F.col("lo"))
    step = (F.col("w") * (1 + 2 * margin)) / (points - 1)
    grid = stats.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") - margin * F.col("w") + F.col("k") * step)
    held = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    met = held.join(grid, by) if by else held.crossJoin(grid)
    z = (F.col("x") - F.col(value)) / F.col("h")
    each = F.col("c") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("h") * F.sqrt(F.lit(2 * 3.141592653589793)))
    return met.groupBy(*by, "k").agg(F.first("x").alias("x"), F.sum(each).alias("density"))


def density_2d(points: DataFrame, bins: int = 50, x: str = "x", y: str = "y") -> DataFrame:
    """Gaussian density on an even grid, Scott's factor with the points' covariance; points are counted by cell of a fine grid first."""
    s = points.agg(F.count(F.lit(1)).alias("n"), F.var_samp(x).alias("xx"), F.var_samp(y).alias("yy"), F.covar_samp(x, y).alias("xy"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    axis = F.sequence(F.lit(0), F.lit(bins - 1))
    grid = s.withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis))
    grid = grid.withColumn("gx", F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("i") / (bins - 1)).withColumn("gy", F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("j") / (bins - 1))
    grid = grid.withColumn("f", F.pow("n", F.lit(-1 / 3))).withColumn("det", F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"))
    dx, dy = F.col(x) - F.col("gx"), F.col(y) - F.col("gy")
    q = (F.col("yy") * dx * dx - 2 * F.col("xy") * dx * dy + F.col("xx") * dy * dy) / F.col("det") / F.col("f")
    each = F.exp(-0.5 * q) / (F.col("n") * 2 * 3.141592653589793 * F.sqrt("det") * F.col("f"))
    return points.select(x, y).crossJoin(F.broadcast(grid)).groupBy("i", "j").agg(F.sum(each).alias("density"))


def violins(values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Least, quartiles, median and largest value of each group."""
    v = F.col(value)
    return values.groupBy(*by).agg(F.min(v).alias("low"), percentile(v, 0.25).alias("q25"), percentile(v, 0.5).alias("median"), percentile(v, 0.75).alias("q75"), F.max(v).alias("high"), F.count(F.lit(1)).alias("n"))


def membership(labels: DataFrame, column: str = "label") -> DataFrame:
    """Runs of cluster labels along each trajectory."""
    return label_blocks(labels, ["traj_id"], column)


def nearest_label(grid: DataFrame, points: DataFrame) -> DataFrame:
    """Label of the nearest point for each grid cell (gx, gy); ties by the smaller label."""
    d2 = (F.col("x") - F.col("gx")) * (F.col("x") - F.col("gx")) + (F.col("y") - F.col("gy")) * (F.col("y") - F.col("gy"))
    return points.crossJoin(F.broadcast(grid)).groupBy("gx", "gy").agg(F.min(F.struct(d2.alias("d"), "label")).alias("b")).select("gx", "gy", F.col("b.label").alias("label"))


def cluster_levels(points: DataFrame, at: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Percentiles of each cluster's density values; clusters of fewer than three points have none."""
    return points.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[percentile(F.col("density"), p).alias(f"p{round(100 * p)}") for p in at]).where("n >= 3").drop("n")


def tag_map(dim: DataFrame, tags: Sequence[str], several: bool = False) -> DataFrame:
    """Tags for colouring of each trajectory; more than one only if allowed."""
    found = dim.select("traj_id", F.array_intersect("tags", F.array(*[F.lit(t) for t in tags])).alias("tags"))
    return found if several else found.withColumn("tags", F.when(F.size("tags") > 1, F.raise_error(F.concat(F.lit("several tags on trajectory "), F.col("traj_id").cast("string")))).otherwise(F.col("tags")))


def dimension_pairs(dimensions: Sequence[int]) -> list[tuple[int, int]]:
    return list(zip(dimensions, dimensions[1:], strict=False))


def top_feature_values(long: DataFrame, selectors: DataFrame, top: DataFrame) -> DataFrame:
    """Values of ranked features in each selector's frames."""
    return long.join(F.broadcast(top.select("feature_idx", "rank")), "feature_idx").join(selectors, ["traj_id", "frame_idx"]).select("selector", "feature_idx", "rank", "value")
