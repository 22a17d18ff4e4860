"""Aggregates along frames (for each feature), along features (for each frame) and by residue.

Standard deviation and variance are of the population; percentiles are exact with
linear interpolation. Frames and features go to hash aggregates with partial sums;
per-frame statistics are higher-order functions within a row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import circular

TINY = 1e-10
#: Rows of a group beyond which equal values are counted before its percentiles are taken.
LARGE = 1 << 20
#: Percentiles that a metric needs.
AT = {"median": (0.5,), "q25": (0.25,), "q75": (0.75,), "iqr": (0.25, 0.75)}


def percentile(x: Column, p: float) -> Column:
    return F.percentile(x, F.lit(p))


#: name -> aggregate of a value column
LINEAR = {
    "mean": F.avg,
    "std": F.stddev_pop,
    "variance": F.var_pop,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "median": lambda x: percentile(x, 0.5),
    "q25": lambda x: percentile(x, 0.25),
    "q75": lambda x: percentile(x, 0.75),
    "iqr": lambda x: percentile(x, 0.75) - percentile(x, 0.25),
    "range": lambda x: F.max(x) - F.min(x),
    "cv": lambda x: F.stddev_pop(x) / (F.avg(x) + TINY),
    "cv_abs": lambda x: F.stddev_pop(x) / (F.abs(F.avg(x)) + TINY),
    "frequency": F.avg,
}
CIRCULAR = {"mean": circular.mean, "std": circular.std, "variance": circular.variance, "cv": circular.cv, "range": circular.spread, "min": F.min, "max": F.max}


def aggregate(long: DataFrame, by: Iterable[str], metrics: Iterable[str], value: str = "value", periodic: bool = False) -> DataFrame:
    """One row for each group of ``by`` with a column for each metric; ``mad`` takes a second pass.

    For percentiles of tables with a group of more than ``LARGE`` rows equal values are counted first, and all percentiles of a group taken at once.
    """
    by, metrics = list(by), list(metrics)
    table = CIRCULAR if periodic else LINEAR
    plain = [m for m in metrics if m != "mad"]
    ranks = [] if periodic else [m for m in plain if m in AT]
    if ranks and by and not long.groupBy(*by).count().where(F.col("count") > LARGE).isEmpty():
        points = sorted({p for m in ranks for p in AT[m]})
        others = [table[m](F.col(value)).alias(m) for m in plain if m not in ranks]
        sums = long.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *others)
        counts = long.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
        at = counts.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(p) for p in points]), F.col("_n")).alias("_at"))
        place = {p: F.get("_at", F.lit(k)) for k, p in enumerate(points)}
        picked = at.select(*by, *[(place[AT[m][-1]] - place[AT[m][0]] if m == "iqr" else place[AT[m][0]]).alias(m) for m in ranks])
        same = [sums[k].eqNullSafe(picked[k]) for k in by]
        found = sums.join(picked, same, "left").select(*[sums[k] for k in by], *[picked[m] if m in ranks else sums[m] for m in plain])
    else:
        found = long.groupBy(*by).agg(*[table[m](F.col(value)).alias(m) for m in plain]) if plain else None
    if "mad" in metrics:
        found_mad = mad(long, by, value)
        if found is None:
            return found_mad
        condition = None
        for k in by:
            same = found[k].eqNullSafe(found_mad[k])
            condition = same if condition is None else condition & same
        found = found.join(found_mad, condition).select(*[found[k] for k in by], *[found[m] for m in plain], found_mad["mad"]) if by else found.crossJoin(found_mad)
    return found


def mad(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Median absolute deviation from each group's own median."""
    if not by:
        centre = long.agg(percentile(F.col(value), 0.5).alias("_centre"))
        return long.crossJoin(F.broadcast(centre)).agg(percentile(F.abs(F.col(value) - F.col("_centre")), 0.5).alias("mad"))
    centre = long.groupBy(*by).agg(percentile(F.col(value), 0.5).alias("_centre"))
    return long.join(centre, by).groupBy(*by).agg(percentile(F.abs(F.col(value) - F.col("_centre")), 0.5).alias("mad"))


def quantiles(long: DataFrame, by: Iterable[str], at: Iterable[float], value: str = "value", bins: int = 1024) -> DataFrame:
    """by, p, quantile: exact percentiles of groups of any size, by selection.

    Where ``percentile`` holds a group's distinct values in one task, this counts values by
    bin, finds the bins in which the ranks lie, and orders the distinct values of those
    bins only: about the share 1 / bins of a group.
    """
    by, at = list(by), list(at)
    rows = long.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).alias("_x"))
    span = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    place = (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins
    bin_ = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(place), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    binned = rows.join(span, by).withColumn("_bin", bin_)
    order = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = binned.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", F.sum("_c").over(order)).withColumn("_before", F.col("_upto") - F.col("_c"))
    ranks = span.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in at]))).withColumn("_pos", (F.col("_n") - 1) * F.col("p"))
    ranks = ranks.select(*by, "p", "_pos", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))).alias("_rank"))
    wanted = counts.join(ranks, by).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_upto"))).select(*by, "_bin", "_before", "p", "_pos", "_rank")
    held = binned.join(wanted.select(*by, "_bin").distinct(), [*by, "_bin"], "left_semi").groupBy(*by, "_bin", "_x").agg(F.count(F.lit(1)).alias("_c"))
    inside = Window.partitionBy(*by, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_end", F.sum("_c").over(inside))
    rank = F.col("_rank") - F.col("_before")
    found = wanted.join(held, [*by, "_bin"]).where((rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_c")))
    low = F.max(F.when(F.col("_rank") == F.floor("_pos"), F.col("_x")))
    high = F.max(F.when(F.col("_rank") == F.ceil("_pos"), F.col("_x")))
    return found.groupBy(*by, "p").agg((low + (high - low) * (F.first("_pos") - F.floor(F.first("_pos")))).alias("quantile"))


def aggregate_with(long: DataFrame, by: Iterable[str], func, value: str = "value", to: str = "result") -> DataFrame:
    """Any function of a pandas Series as aggregate (Arrow-batched)."""
    import pandas as pd
    from pyspark.sql.pandas.functions import pandas_udf

    def run(v):
        return float(func(v))

    run.__annotations__ = {"v": pd.Series, "return": float}
    return long.groupBy(*by).agg(pandas_udf(run, "double")(F.col(value)).alias(to))


# Within a row


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y.cast("double"))


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, array_sum(a) / F.size(a))


def array_variance(a: Column) -> Column:
    """By running mean and squares (Welford): one pass, whatever the length."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def add(t: Column, y: Column) -> Column:
        y, n = y.cast("double"), t["n"] + 1.0
        m = t["m"] + (y - t["m"]) / n
        return F.struct(n.alias("n"), m.alias("m"), (t["s"] + (y - t["m"]) * (y - m)).alias("s"))

    return F.aggregate(a, start, add, lambda t: F.when(t["n"] > 0, t["s"] / t["n"]))


def bound(value: Column, then) -> Column:
    """``then`` of a value that is evaluated once: an element of a one-element array."""
    return F.transform(F.array(value), then)[0]


def array_quantile(a: Column, p: float) -> Column:
    """Linear interpolation in the sorted array, which is sorted once."""

    def of(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(p)
        lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
        return F.when(F.size(s) > 0, F.get(s, lo) + (F.get(s, hi) - F.get(s, lo)) * (at - lo))

    return bound(F.array_sort(a), of)


def array_mad(a: Column) -> Column:
    return bound(array_quantile(a, 0.5), lambda m: array_quantile(F.transform(a, lambda x: F.abs(x - m)), 0.5))


ROW = {
    "mean": array_mean,
    "std": lambda a: F.sqrt(array_variance(a)),
    "variance": array_variance,
    "min": F.array_min,
    "max": F.array_max,
    "sum": array_sum,
    "median": lambda a: array_quantile(a, 0.5),
    "mad": array_mad,
    "range": lambda a: F.array_max(a) - F.array_min(a),
}


def per_frame(frames: DataFrame, metrics: Iterable[str], features: str = "features") -> DataFrame:
    """traj_id, frame_idx and a column for each metric."""
    return frames.select("traj_id", "frame_idx", *[ROW[m](F.col(features)).alias(m) for m in metrics])


def per_frame_with(frames: DataFrame, func, features: str = "features", to: str = "result") -> DataFrame:
    """Any function of a frame's values (a numpy vector) as statistic of the frame; Arrow batches."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.pandas.functions import pandas_udf

    def run(v):
        return v.map(lambda x: float(func(np.asarray(x, float))))

    run.__annotations__ = {"v": pd.Series, "return": pd.Series}
    return frames.select("traj_id", "frame_idx", pandas_udf(run, "double")(F.col(features)).alias(to))


def per_frame_circular(frames: DataFrame, features: str = "features") -> DataFrame:
    a = F.col(features)
    s = F.aggregate(a, F.lit(0.0), lambda x, y: x + F.sin(F.radians(y))) / F.size(a)
    c = F.aggregate(a, F.lit(0.0), lambda x, y: x + F.cos(F.radians(y))) / F.size(a)
    r = F.sqrt(s * s + c * c)
    spread = F.array_max(a) - F.array_min(a)
    return frames.select("traj_id", "frame_idx", F.degrees(F.atan2(s, c)).alias("mean"), F.degrees(F.sqrt(-2 * F.log(F.greatest(r, F.lit(1e-300))))).alias("std"), (1 - r).alias("variance"), F.array_min(a).alias("min"), F.array_max(a).alias("max"), array_mad(a).alias("mad"), F.when(spread > 180, 360 - spread).otherwise(spread).alias("range"))


def contacts_per_frame(frames: DataFrame, features: str = "features") -> DataFrame:
    n = F.size(F.filter(features, lambda x: x.cast("double") > 0)).cast("long")
    return frames.select("traj_id", "frame_idx", n.alias("n_contacts"), (100.0 * n / F.size(features)).alias("percentage"))


def per_residue(long: DataFrame, pairs: DataFrame, metrics: Iterable[str], diagonal: bool = True) -> DataFrame:
    """Pair values rolled up to both residues of each pair. pairs: feature_idx, i, j.

    ``diagonal`` adds each residue's own value of 0 in every frame, as a squared
    form of the pair list has it.
    """
    sides = pairs.select("feature_idx", F.explode(F.array("i", "j")).alias("residue"))
    values = long.select("traj_id", "frame_idx", "feature_idx", "value").join(sides, "feature_idx").select("residue", "traj_id", "frame_idx", "value")
    if diagonal:
        own = values.select("residue", "traj_id", "frame_idx").distinct().withColumn("value", F.lit(0.0))
        values = values.unionByName(own)
    return aggregate(values, ["residue"], metrics)


def differences(a: DataFrame, b: DataFrame, by: Iterable[str] = ("feature_idx",), metric: str = "mean", periodic: bool = False, before=None) -> DataFrame:
    """metric(a) - metric(b) for each group; on the circle for angles. ``before`` is done to both tables first."""
    by = list(by)
    a, b = (a, b) if before is None else (before(a), before(b))
    left = aggregate(a, by, [metric], periodic=periodic).withColumnRenamed(metric, "a")
    right = aggregate(b, by, [metric], periodic=periodic).withColumnRenamed(metric, "b")
    d = F.col("a") - F.col("b")
    if periodic:
        d = F.pmod(d + 180, F.lit(360.0)) - 180
    return left.join(right, by).select(*by, d.alias("difference"))


def frame_differences(long: DataFrame, frame_1: int, frame_2: int, periodic: bool = False) -> DataFrame:
    """Value in one frame less that in another, for each trajectory and feature."""
    keys = ["traj_id", "feature_idx"]
    one = long.where(F.col("frame_idx") == frame_1).select(*keys, F.col("value").alias("a"))
    two = long.where(F.col("frame_idx") == frame_2).select(*keys, F.col("value").alias("b"))
    d = F.col("a") - F.col("b")
    return one.join(two, keys).select(*keys, (F.pmod(d + 180, F.lit(360.0)) - 180 if periodic else d).alias("difference"))


def class_differences(a: DataFrame, b: DataFrame, by: Iterable[str] = ("feature_idx",), column: str = "class") -> DataFrame:
    """Share of each class in ``a`` less that in ``b``, for each group; a class that one of them lacks has share 0 there."""
    by = list(by)
    left = class_frequencies(a, by, column).select(*by, column, F.col("frequency").alias("a"))
    right = class_frequencies(b, by, column).select(*by, column, F.col("frequency").alias("b"))
    both = left.join(right, [*by, column], "full")
    return both.select(*by, column, (F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("difference"))


def class_frequencies(classes: DataFrame, by: Iterable[str] = ("traj_id",), column: str = "class") -> DataFrame:
    """Share of each class in each group: the count by class first, so hot groups are summed before they meet."""
    by = list(by)
    counts = classes.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return counts.join(totals, by).select(*by, column, "n", (F.col("n") / F.col("total")).alias("frequency"))


def dominant_class(classes: DataFrame, by: Iterable[str] = ("traj_id",), column: str = "class") -> DataFrame:
    """Most frequent class; ties go to the first in order."""
    by = list(by)
    counts = classes.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(column).alias("value"))).alias("best"))
    return best.select(*by, F.col("best.value").alias("dominant"), (-F.col("best.less")).alias("n"))


def fraction(long: DataFrame, threshold: float, by: Iterable[str] = ("feature_idx",), above: bool = False, value: str = "value") -> DataFrame:
    """Share of values below (burial) or above (exposure) a threshold."""
    hit = F.col(value) > threshold if above else F.col(value) < threshold
    return long.groupBy(*by).agg(F.avg(hit.cast("double")).alias("fraction"))


def rmsf_of_triples(long: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Fluctuation of each atom from features that are x, y, z by turns."""
    atom = F.floor(F.col("feature_idx") / 3).cast("int")
    parts = long.withColumn("atom", atom).groupBy(*by, "atom", "feature_idx").agg(F.var_pop("value").alias("v"))
    return parts.groupBy(*by, "atom").agg(F.sqrt(F.sum("v")).alias("rmsf"))


def condensed_index(i: Column, j: Column, n: Column) -> Column:
    """Place of pair (i, j), i < j, in a condensed upper triangle."""
    return (n * i - F.floor(i * (i + 1) / 2) + j - i - 1).cast("long")


def to_square(pairs: DataFrame) -> DataFrame:
    """Condensed pairs (i, j, value) to all cells of the square form, with a diagonal of 0."""
    swapped = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")
    own = pairs.select(F.explode(F.array("i", "j")).alias("i")).distinct().select("i", F.col("i").alias("j"), F.lit(0.0).alias("value"))
    return pairs.select("i", "j", "value").unionByName(swapped).unionByName(own)


def to_condensed(square: DataFrame, k: int = 1) -> DataFrame:
    return square.where(F.col("j") - F.col("i") >= k)


def gamma_scale(long: DataFrame) -> DataFrame:
    """1 / (features * variance of all values)."""
    return long.agg((1.0 / (F.countDistinct("feature_idx") * F.var_pop("value"))).alias("gamma"))


def gamma_auto(long: DataFrame) -> DataFrame:
    return long.agg((1.0 / F.countDistinct("feature_idx")).alias("gamma"))
