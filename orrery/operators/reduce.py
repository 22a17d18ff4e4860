"""Keeping the features whose metric lies within bounds, for each trajectory or for all of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import stats, windows
from orrery.operators.select import common_features

#: Metrics of each feature type, by name.
METRICS = {
    "distances": ("cv", "std", "variance", "range", "transitions", "min", "mad", "mean", "max"),
    "contacts": ("frequency", "stability", "transitions"),
    "coordinates": ("std", "rmsf", "cv", "variance", "range", "mad", "mean", "min", "max", "transitions"),
    "torsions": ("transitions", "std", "mad", "mean", "range", "min", "max", "cv", "variance"),
    "dssp": ("transitions", "transition_frequency", "stability", "class_frequencies"),
    "sasa": ("cv", "range", "std", "variance", "mad", "mean", "min", "max", "burial_fraction", "exposure_fraction", "transitions"),
}
#: Thresholds of transitions, by type (for contacts 1, as a change of a 0 or 1 can't reach 2).
TRANSITIONS = {"distances": 2.0, "contacts": 1.0, "coordinates": 1.0, "torsions": 30.0, "dssp": 1.0, "sasa": 0.5}


def metric_of(
    long: DataFrame,
    feature_type: str,
    metric: str | Callable[[Column], Column],
    by: Sequence[str] = ("traj_id", "feature_idx"),
    cutoff: float = 0.2,
    threshold: float | None = None,
    mode: str = "window",
    window: int = 10,
    lag: int = 1,
    classes: Sequence[str] | None = None,
) -> DataFrame:
    """by and ``metric_value`` of each feature. long: traj_id, frame_idx, feature_idx, value (a class for dssp).

    ``metric`` is a name or an aggregate of one's own (a Column to a Column). Transitions count
    windows of ``window`` frames (mode ``window``) or steps of ``lag`` frames (mode ``lagtime``) that
    reach the threshold.
    """
    by = list(by)
    if callable(metric):
        return long.groupBy(*by).agg(metric(F.col("value")).cast("double").alias("metric_value"))
    if metric not in METRICS[feature_type]:
        raise ValueError(f"{feature_type} has no metric {metric!r}")
    if mode not in ("window", "lagtime"):
        raise ValueError(f"mode must be window or lagtime, not {mode!r}")
    periodic = feature_type == "torsions"
    limit = TRANSITIONS[feature_type] if threshold is None else threshold
    if feature_type == "dssp":
        if metric == "class_frequencies":
            held = stats.class_frequencies(long, by, "value")
            held = held.where(F.col("value").isin(list(classes))) if classes else held
            return held.groupBy(*by).agg((F.sum("frequency") if classes else F.max("frequency")).alias("metric_value"))
        if metric == "transitions" and mode == "window":
            return windows.class_transitions_window(long, window, by, "value").select(*by, F.col("transitions").cast("double").alias("metric_value"))
        found = windows.class_transitions(long, by, "value", lag)
        value = {"transitions": F.col("transitions").cast("double"), "transition_frequency": F.col("rate"), "stability": 1 - F.col("rate")}[metric]
        return found.select(*by, value.alias("metric_value"))
    if metric in ("transitions", "stability"):
        if metric == "transitions" and mode == "window":
            found = windows.transitions_window(long, window, limit, by, periodic=periodic)
        else:
            found = windows.transitions_lag(long, lag, limit, by, periodic=periodic)
        if metric == "stability":
            return windows.stability(found, lag, periodic=periodic).select(*by, F.col("stability").alias("metric_value"))
        return found.select(*by, F.col("transitions").cast("double").alias("metric_value"))
    if metric in ("burial_fraction", "exposure_fraction"):
        return stats.fraction(long, cutoff, by, above=metric == "exposure_fraction").withColumnRenamed("fraction", "metric_value")
    if metric == "rmsf":
        rest = [k for k in by if k != "feature_idx"]
        atoms = stats.rmsf_of_triples(long, rest)
        return atoms.select(*rest, F.explode(F.sequence(F.col("atom") * 3, F.col("atom") * 3 + 2)).alias("feature_idx"), F.col("rmsf").alias("metric_value"))
    name = "cv_abs" if metric == "cv" and feature_type in ("coordinates",) else metric
    linear = periodic and metric in ("min", "max", "mad")
    return stats.aggregate(long, by, [name], periodic=periodic and not linear).withColumnRenamed(name, "metric_value")


def within(values: DataFrame, least: float | None = None, most: float | None = None) -> DataFrame:
    """Inclusive bounds on metric_value."""
    out = values
    out = out.where(F.col("metric_value") >= least) if least is not None else out
    return out.where(F.col("metric_value") <= most) if most is not None else out


def reduce_features(long: DataFrame, feature_type: str, metric: str | Callable[[Column], Column], least: float | None = None, most: float | None = None, cross_trajectory: bool = False, **options) -> DataFrame:
    """traj_id, feature_idx, metric_value of what stays; with ``cross_trajectory`` only what stays in every trajectory of ``long``."""
    kept = within(metric_of(long, feature_type, metric, **options), least, most)
    if not cross_trajectory:
        return kept
    return kept.join(common_features(kept.select("traj_id", "feature_idx"), long.select("traj_id")), "feature_idx", "left_semi")


def reduced(long: DataFrame, kept: DataFrame) -> DataFrame:
    return long.join(kept.select("traj_id", "feature_idx"), ["traj_id", "feature_idx"], "left_semi")


def summary(long: DataFrame, kept: DataFrame) -> DataFrame:
    """Features before and after, and the share that stays, for each trajectory."""
    before = long.select("traj_id", "feature_idx").distinct().groupBy("traj_id").agg(F.count(F.lit(1)).alias("n_before"))
    after = kept.select("traj_id", "feature_idx").distinct().groupBy("traj_id").agg(F.count(F.lit(1)).alias("n_after"))
    joined = before.join(after, "traj_id", "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)).cast("long"))
    return joined.withColumn("retention", F.col("n_after") / F.col("n_before"))


def select_then_reduce(meta: DataFrame, long: DataFrame, selection: str, feature_type: str, metric: str | Callable[[Column], Column], least: float | None = None, most: float | None = None, cross_trajectory: bool = True, **options) -> DataFrame:
    """A selection string first, then bounds on a metric."""
    from orrery.operators.language import select_features

    chosen = select_features(meta, selection).select("traj_id", "feature_idx")
    return reduce_features(long.join(chosen, ["traj_id", "feature_idx"], "left_semi"), feature_type, metric, least, most, cross_trajectory, **options)
