"""Ordered analytics within trajectories: transitions, deviation, blocks, smoothing.

A window orders each trajectory in one task. Where single trajectories are too long for
that, ``block`` cuts them into blocks of frames that borrow the rows around them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import circular


def _order(by: Iterable[str]):
    return Window.partitionBy(*by).orderBy("frame_idx")


def in_blocks(rows: DataFrame, by: list[str], block: int | None, before: int = 0, after: int = 0) -> tuple[DataFrame, list[str]]:
    """Cuts long trajectories into blocks of ``block`` frames with the frames around that a window needs.

    Returns the rows with ``_own`` (false for rows that a block only borrows) and the keys to
    order within. Frames must be numbered from 0 without gaps; without ``block`` a trajectory stays whole.
    """
    if block is None:
        return rows.withColumn("_own", F.lit(True)), by
    f = F.col("frame_idx")
    first, last = F.greatest(F.lit(0), F.floor((f - after) / block)), F.floor((f + before) / block)
    cut = rows.withColumn("_block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return cut.withColumn("_own", F.col("_block") == F.floor(f / block)), [*by, "_block"]


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.where("_own").groupBy(*by).agg(F.sum("_m").alias("transitions"), F.count(F.lit(1)).alias("n_frames"))


def transitions_lag(long: DataFrame, lag: int = 1, threshold: float = 1.0, by: Iterable[str] = ("traj_id",), value: str = "value", periodic: bool = False, block: int | None = None) -> DataFrame:
    """Number of steps of ``lag`` frames that change by the threshold or more (by more than it, for angles)."""
    by = list(by)
    rows, keys = in_blocks(long, by, block, before=lag)
    d = F.col(value) - F.lag(value, lag).over(_order(keys))
    moved = circular.distance(d) > threshold if periodic else F.abs(d) >= threshold
    return _counted(rows.withColumn("_m", F.coalesce(moved, F.lit(False)).cast("long")), by)


def transitions_window(long: DataFrame, size: int = 10, threshold: float = 1.0, by: Iterable[str] = ("traj_id",), value: str = "value", periodic: bool = False, block: int | None = None) -> DataFrame:
    """Number of full windows whose range reaches the threshold; for angles, with any step above it."""
    by = list(by)
    rows, keys = in_blocks(long, by, block, before=size - 1)
    order = _order(keys)
    full = F.row_number().over(order) >= size
    if periodic:
        step = F.coalesce((circular.distance(F.col(value) - F.lag(value).over(order)) > threshold).cast("int"), F.lit(0))
        rows = rows.withColumn("_s", step)
        hit = F.sum("_s").over(order.rowsBetween(-(size - 2), 0)) > 0 if size > 1 else F.lit(False)
    else:
        span = order.rowsBetween(-(size - 1), 0)
        hit = F.max(value).over(span) - F.min(value).over(span) >= threshold
    return _counted(rows.withColumn("_m", (full & hit).cast("long")), by)


def stability(counts: DataFrame, width: int, mode: str = "lagtime", periodic: bool = False) -> DataFrame:
    """1 - transitions / possible ones; null where none is possible. ``counts`` as the functions above give."""
    most = F.col("n_frames") - (1 if periodic and mode == "lagtime" else width if mode == "lagtime" else width - 1)
    raw = F.when(most > 0, 1 - F.col("transitions") / most)
    return counts.withColumn("stability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) if periodic else raw)


def class_transitions(classes: DataFrame, by: Iterable[str] = ("traj_id",), column: str = "class", lag: int = 1, block: int | None = None) -> DataFrame:
    """Number and rate of changes of class between frames ``lag`` apart."""
    by = list(by)
    rows, keys = in_blocks(classes, by, block, before=lag)
    changed = F.col(column) != F.lag(column, lag).over(_order(keys))
    out = _counted(rows.withColumn("_m", F.coalesce(changed, F.lit(False)).cast("long")), by)
    return out.withColumn("rate", F.when(F.col("n_frames") > lag, F.col("transitions") / (F.col("n_frames") - lag)))


def class_transitions_window(classes: DataFrame, size: int, by: Iterable[str] = ("traj_id",), column: str = "class") -> DataFrame:
    """Number of full windows in which the class changes."""
    by = list(by)
    step = F.coalesce((F.col(column) != F.lag(column).over(_order(by))).cast("int"), F.lit(0))
    hit = F.sum("_s").over(_order(by).rowsBetween(-(size - 2), 0)) > 0 if size > 1 else F.lit(False)
    full = F.row_number().over(_order(by)) >= size
    return classes.withColumn("_s", step).withColumn("_m", (full & hit).cast("long")).groupBy(*by).agg(F.sum("_m").alias("transitions"))


def class_transition_matrix(classes: DataFrame, by: Iterable[str] = ("traj_id",), column: str = "class", lag: int = 1) -> DataFrame:
    """Counts of (from, to) classes ``lag`` frames apart."""
    pairs = classes.select(F.lag(column, lag).over(_order(by)).alias("from_class"), F.col(column).alias("to_class"))
    return pairs.where("from_class IS NOT NULL").groupBy("from_class", "to_class").agg(F.count(F.lit(1)).alias("n"))


# Deviation (no superposition: see features.superpose)


def squared_parts(a: Column, b: Column, atom: int = 3) -> Column:
    """Squared displacement of each atom between two coordinate arrays."""
    from orrery.operators.stats import bound

    def one(x: Column, y: Column, k: Column) -> Column:
        parts = [F.get(x, k * atom + c).cast("double") - F.get(y, k * atom + c) for c in range(atom)]
        total = parts[0] * parts[0]
        for p in parts[1:]:
            total = total + p * p
        return total

    # By place in the two arrays: no array is made for an atom, and both are evaluated once.
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda t: F.transform(F.sequence(F.lit(0), (F.size(t["a"]) / atom).cast("int") - 1), lambda k: one(t["a"], t["b"], k)))


def reduced(squares: Column, metric: str) -> Column:
    """Root of the mean or of the median, or the median absolute deviation of the distances."""
    from orrery.operators.stats import array_mad, array_mean, array_quantile

    if metric == "mean":
        return F.sqrt(array_mean(squares))
    if metric == "median":
        return F.sqrt(array_quantile(squares, 0.5))
    if metric == "mad":
        return array_mad(F.transform(squares, lambda x: F.sqrt(x)))
    raise ValueError(f"unknown metric {metric}")


def rmsd_to_reference(frames: DataFrame, traj: int = 0, frame: int = 0, metric: str = "mean", xyz: str = "features", atom: int = 3) -> DataFrame:
    """Deviation of every frame from one; the reference is a single row."""
    reference = F.broadcast(frames.where((F.col("traj_id") == traj) & (F.col("frame_idx") == frame)).limit(1).select(F.col(xyz).alias("_ref")))
    return frames.crossJoin(reference).select("traj_id", "frame_idx", reduced(squared_parts(F.col(xyz), F.col("_ref"), atom), metric).alias("rmsd"))


def frame_to_frame(frames: DataFrame, lag: int = 1, metric: str = "mean", xyz: str = "features", atom: int = 3) -> DataFrame:
    """Deviation of each frame from the one ``lag`` later; n - lag rows for each trajectory."""
    later = F.lead(xyz, lag).over(_order(["traj_id"]))
    return frames.withColumn("_later", later).where("_later IS NOT NULL").select("traj_id", "frame_idx", reduced(squared_parts(F.col(xyz), F.col("_later"), atom), metric).alias("rmsd"))


def window_rmsd(frames: DataFrame, size: int, stride: int | None = None, lag: int | None = None, metric: str = "mean", xyz: str = "features", atom: int = 3) -> DataFrame:
    """Deviation within windows that start every ``stride`` frames (``size`` unless given).

    Without ``lag`` from a window's first frame, else between frames ``lag`` apart in it;
    each window's values are reduced by the same metric. Windows must be full.
    """
    from orrery.operators.stats import percentile

    stride = stride or size
    # Only counts of the keys are ordered in one task; the frames themselves stay dealt out.
    key = ["traj_id", "frame_idx"]
    starts = frames.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).withColumn("_total", F.sum("_c").over(Window.partitionBy("traj_id")))
    starts = starts.withColumn("_start", F.sum("_c").over(_order(["traj_id"]).rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.select(*[F.col(k).alias(f"_{k}") for k in key], F.coalesce("_start", F.lit(0)).alias("_start"), "_total")
    same = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))) - 1
    rows = frames.withColumn("_same", same).join(starts, F.col("traj_id").eqNullSafe(F.col("_traj_id")) & F.col("frame_idx").eqNullSafe(F.col("_frame_idx")))
    rows = rows.withColumn("_n", (F.col("_start") + F.col("_same")).cast("long")).drop("_same", "_start", "_traj_id", "_frame_idx")
    first = F.greatest(F.lit(0), F.ceil((F.col("_n") - (size - 1)) / stride)).cast("long")
    last = F.floor(F.least(F.col("_n"), F.col("_total") - size) / stride).cast("long")
    rows = rows.where(last >= first).withColumn("window", F.explode(F.sequence(first, last)))
    at = F.col("_n") - F.col("window") * stride
    if lag is None:
        heads = rows.where(at == 0).select("traj_id", "window", F.col(xyz).alias("_other"))
        pairs = rows.where(at > 0) if size > 1 else rows
        pairs = pairs.join(heads, ["traj_id", "window"])
    else:
        inside = Window.partitionBy("traj_id", "window").orderBy("_n")
        pairs = rows.withColumn("_other", F.lead(xyz, lag).over(inside)).where("_other IS NOT NULL")
    pairs = pairs.select("traj_id", "window", reduced(squared_parts(F.col(xyz), F.col("_other"), atom), metric).alias("d"))
    if metric == "mean":
        return pairs.groupBy("traj_id", "window").agg(F.avg("d").alias("rmsd"))
    if metric == "median":
        return pairs.groupBy("traj_id", "window").agg(percentile(F.col("d"), 0.5).alias("rmsd"))
    from orrery.operators.stats import mad

    return mad(pairs, ["traj_id", "window"], "d").withColumnRenamed("mad", "rmsd")


# Blocks and smoothing


def label_blocks(labels: DataFrame, by: Iterable[str] = ("traj_id",), column: str = "class") -> DataFrame:
    """Runs of equal labels: first and last frame (inclusive) and label."""
    by = list(by)
    order = _order(by)
    changed = F.coalesce((~F.col(column).eqNullSafe(F.lag(column).over(order))).cast("int"), F.lit(1))
    changed = F.when(F.row_number().over(order) == 1, 1).otherwise(changed)
    runs = labels.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "_run").agg(F.min("frame_idx").alias("start"), F.max("frame_idx").alias("end"), F.first(column).alias("label")).drop("_run")


def moving_average(long: DataFrame, size: int, by: Iterable[str] = ("traj_id",), value: str = "value", block: int | None = None) -> DataFrame:
    """Centred mean over ``size`` frames; frames beyond the edges count as 0."""
    left = size // 2
    rows, keys = in_blocks(long, list(by), block, before=left, after=size - 1 - left)
    span = _order(keys).rowsBetween(-left, size - 1 - left)
    return rows.select(*by, "frame_idx", "_own", (F.sum(value).over(span) / size).alias("smoothed")).where("_own").drop("_own")


def smoothing_width(n_frames: int, size: int) -> int:
    """Width that fits n frames: below n and odd."""
    size = min(size, n_frames - 1) if size >= n_frames else size
    return max(1, size if size % 2 else size - 1)


def savitzky_golay(long: DataFrame, size: int, order: int = 3, by: Iterable[str] = ("traj_id",), value: str = "value") -> DataFrame:
    """Least-squares polynomial in centred windows; edges from the outermost window's polynomial.

    Weights of a centred window are fixed, so inner frames are one weighted sum over
    the window frame; the edge frames weight the outermost window.
    """
    import numpy as np

    half = size // 2
    x = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(x, order + 1, increasing=True))
    weights = lambda at: (np.vander([at], order + 1, increasing=True) @ fit)[0]
    by = list(by)
    o = _order(by)
    whole = Window.partitionBy(*by)
    rows = long.withColumn("_n", F.row_number().over(o) - 1).withColumn("_total", F.count(F.lit(1)).over(whole))
    value_at = lambda k: F.lag(value, -k).over(o) if k else F.col(value)
    inner = sum((F.lit(float(w)) * value_at(k) for k, w in zip(x.tolist(), weights(0), strict=True)), F.lit(0.0))
    out = F.when((F.col("_n") >= half) & (F.col("_n") < F.col("_total") - half), inner)
    for e in range(half):
        first = sum((F.lit(float(w)) * value_at(k - e) for k, w in enumerate(weights(e - half))), F.lit(0.0))
        last = sum((F.lit(float(w)) * value_at(e - k) for k, w in enumerate(weights(half - e)[::-1])), F.lit(0.0))
        out = out.when(F.col("_n") == e, first).when(F.col("_n") == F.col("_total") - 1 - e, last)
    return rows.select(*by, "frame_idx", out.alias("smoothed"))


def smooth_frames(frames: DataFrame, size: int, order: int | None = None, features: str = "features") -> DataFrame:
    """Frames with every value smoothed along its trajectory: a moving average, or a polynomial of ``order``."""
    from orrery.model import to_array, to_long

    long, by = to_long(frames.select("traj_id", "frame_idx", features), features), ["traj_id", "feature_idx"]
    smoothed = moving_average(long, size, by) if order is None else savitzky_golay(long, size, order, by)
    return to_array(smoothed.withColumnRenamed("smoothed", "value")).withColumnRenamed("features", features)


def x_values(frames: DataFrame, use_time: bool = False) -> DataFrame:
    """Frame number, or time in nanoseconds from picoseconds."""
    return frames.withColumn("x", F.col("time_ps") / 1000.0 if use_time else F.col("frame_idx").cast("double"))


def stride_gap(frames: DataFrame, stride: int, by: Iterable[str] = ("traj_id",)) -> DataFrame:
    """Frames kept greedily at least ``stride`` apart."""
    by = list(by)
    keep = F.aggregate(
        F.array_sort(F.collect_set("frame_idx")),
        F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("kept")),
        lambda s, f: F.when(s["last"].isNull() | (f - s["last"] >= stride), F.struct(f.cast("long").alias("last"), F.concat(s["kept"], F.array(f.cast("long"))).alias("kept"))).otherwise(s),
        lambda s: s["kept"],
    )
    return frames.groupBy(*by).agg(keep.alias("kept")).select(*by, F.explode("kept").alias("frame_idx"))


def slice_frames(frames: DataFrame, first: int | None = None, stride: int = 1, cut: int | None = None) -> DataFrame:
    """First n frames, then every k-th, then the first n of those, for each trajectory."""
    order = _order(["traj_id"])
    rows = frames.withColumn("_n", F.row_number().over(order) - 1)
    rows = rows.where(F.col("_n") < first) if first is not None else rows
    rows = rows.where(F.col("_n") % stride == 0)
    rows = rows.where(F.col("_n") / stride < cut) if cut is not None else rows
    return rows.drop("_n")
