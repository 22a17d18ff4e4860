"""Method names for what the operators do by argument: reductions, centres, statistics, deviation and fluctuation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery import model
from orrery.operators import cluster, reduce, stats, structure, windows
from orrery.plans.pipeline import Pipeline


class Reduce:
    """``Reduce(pipeline, "distances").cv(least=0.1)``: a method for each metric of the feature type."""

    def __init__(self, pipeline: Pipeline, name: str, feature_type: str | None = None):
        self.pipeline, self.name, self.type = pipeline, name, feature_type or name

    def __getattr__(self, metric: str) -> Callable[..., DataFrame]:
        if metric not in reduce.METRICS.get(self.__dict__.get("type"), ()):
            raise AttributeError(metric)
        return lambda least=None, most=None, **options: self.pipeline.reduce(self.name, self.type, metric, least, most, **options)


class Select:
    """``Select(pipeline, "s", "distances")("res ALA")`` or ``.with_cv_reduction("res ALA", least=0.1)``."""

    def __init__(self, pipeline: Pipeline, selector: str, feature: str, feature_type: str | None = None):
        self.pipeline, self.selector, self.feature, self.type = pipeline, selector, feature, feature_type or feature

    def __call__(self, selection: str = "all", **options) -> None:
        self.pipeline.add_selection(self.selector, self.feature, selection, **options)

    def __getattr__(self, name: str) -> Callable[..., DataFrame]:
        metric = name.removeprefix("with_").removesuffix("_reduction")
        if name != f"with_{metric}_reduction" or metric not in reduce.METRICS.get(self.__dict__.get("type"), ()):
            raise AttributeError(name)

        def add(selection: str = "all", least: float | None = None, most: float | None = None, cross_trajectory: bool = True, **options) -> DataFrame:
            p = self.pipeline
            kept = reduce.select_then_reduce(p.meta[self.feature], p.long(self.feature), selection, self.type, metric, least, most, cross_trajectory, **options)
            # The selector's own: other selectors and the feature's reduction stay as they are.
            p.add_selection(self.selector, self.feature, selection, kept=kept)
            return kept

        return add


class Cluster:
    """``Cluster(pipeline, "dbscan").with_mean_centers("c", matrix, eps=0.5)``: labels are kept, centres given."""

    CENTRES = ("centroid", "mean", "median", "density_peak", "median_centroid", "rmsd_centroid")

    def __init__(self, pipeline: Pipeline, method: str):
        self.pipeline, self.method = pipeline, method

    def __call__(self, name: str, frames: DataFrame, **options) -> DataFrame:
        return self.with_centers("centroid", name, frames, **options)

    def with_centers(self, centres: str, name: str, frames: DataFrame, **options) -> DataFrame:
        labels = self.pipeline.cluster(name, frames, self.method, **options)
        return cluster.centres(frames.join(labels, ["traj_id", "frame_idx"]), centres)

    def __getattr__(self, name: str) -> Callable[..., DataFrame]:
        centres = name.removeprefix("with_").removesuffix("_centers")
        if name != f"with_{centres}_centers" or centres not in self.CENTRES:
            raise AttributeError(name)
        return lambda *args, **options: self.with_centers(centres, *args, **options)


class Analysis:
    """Statistics of a feature table by name: ``compute_mean()``, ``per_frame_mean()``, ``per_residue_mean(pairs)`` and the ordered ones."""

    def __init__(self, frames: DataFrame, periodic: bool = False, by_trajectory: bool = False):
        self.frames, self.periodic = frames, periodic
        self.by = (["traj_id"] if by_trajectory else []) + ["feature_idx"]

    @property
    def long(self) -> DataFrame:
        return model.to_long(self.frames)

    def __getattr__(self, name: str) -> Callable[..., DataFrame]:
        if name.startswith("compute_") and (m := name.removeprefix("compute_")) in {*stats.LINEAR, *stats.CIRCULAR, "mad"}:
            circular = self.periodic and m in stats.CIRCULAR and m not in ("min", "max")
            return lambda: stats.aggregate(self.long, self.by, [m], periodic=circular)
        if name.startswith("per_frame_") and (m := name.removeprefix("per_frame_")) in stats.ROW:
            return (lambda: stats.per_frame_circular(self.frames).select("traj_id", "frame_idx", m)) if self.periodic else (lambda: stats.per_frame(self.frames, [m]))
        if name.startswith("per_residue_") and (m := name.removeprefix("per_residue_")) in stats.LINEAR:
            return lambda pairs, diagonal=True: stats.per_residue(self.long, pairs, [m], diagonal)
        raise AttributeError(name)

    def transitions_lagtime(self, lag: int = 10, threshold: float = 2.0) -> DataFrame:
        return windows.transitions_lag(self.long, lag, threshold, ["traj_id", "feature_idx"], periodic=self.periodic)

    def transitions_window(self, size: int = 10, threshold: float = 2.0) -> DataFrame:
        return windows.transitions_window(self.long, size, threshold, ["traj_id", "feature_idx"], periodic=self.periodic)

    def stability(self, width: int = 10, threshold: float = 2.0, mode: str = "lagtime") -> DataFrame:
        counts = self.transitions_lagtime(width, threshold) if mode == "lagtime" else self.transitions_window(width, threshold)
        return windows.stability(counts, width, mode, self.periodic)

    def differences(self, other: DataFrame, metric: str = "mean") -> DataFrame:
        return stats.differences(self.long, model.to_long(other), metric=metric, periodic=self.periodic)

    def burial_fraction(self, threshold: float) -> DataFrame:
        return stats.fraction(self.long, threshold, self.by)

    def exposure_fraction(self, threshold: float) -> DataFrame:
        return stats.fraction(self.long, threshold, self.by, above=True)


class Rmsd:
    """``Rmsd(frames).mean.to_reference()``: mean, median and mad, four ways each."""

    def __init__(self, frames: DataFrame, metric: str = "mean", xyz: str = "features"):
        self.frames, self.metric, self.xyz = frames, metric, xyz

    def __getattr__(self, name: str) -> Rmsd:
        if name not in ("mean", "median", "mad"):
            raise AttributeError(name)
        return Rmsd(self.frames, name, self.xyz)

    def to_reference(self, traj: int = 0, frame: int = 0) -> DataFrame:
        return windows.rmsd_to_reference(self.frames, traj, frame, self.metric, self.xyz)

    def frame_to_frame(self, lag: int = 1) -> DataFrame:
        return windows.frame_to_frame(self.frames, lag, self.metric, self.xyz)

    def window_frame_to_start(self, size: int, stride: int | None = None) -> DataFrame:
        return windows.window_rmsd(self.frames, size, stride, None, self.metric, self.xyz)

    def window_frame_to_frame(self, size: int, stride: int | None = None, lag: int = 1) -> DataFrame:
        return windows.window_rmsd(self.frames, size, stride, lag, self.metric, self.xyz)


class Rmsf:
    """``Rmsf(frames).median.to_mean_reference()``; ``.per_residue(residue_of, "rms").to_median_reference()``."""

    def __init__(self, frames: DataFrame, metric: str = "mean", residue_of: DataFrame | None = None, how: str = "mean", xyz: str = "features"):
        self.frames, self.metric, self.residue_of, self.how, self.xyz = frames, metric, residue_of, how, xyz

    def __getattr__(self, name: str) -> Rmsf:
        if name not in ("mean", "median", "mad"):
            raise AttributeError(name)
        return Rmsf(self.frames, name, self.residue_of, self.how, self.xyz)

    def per_residue(self, residue_of: DataFrame, how: str = "mean") -> Rmsf:
        """Atoms rolled up by mean, median, rms or rms_median."""
        return Rmsf(self.frames, self.metric, residue_of, how, self.xyz)

    def _of(self, reference: str, cross_trajectory: bool) -> DataFrame:
        found = structure.rmsf(self.frames, reference, self.metric, cross_trajectory, self.xyz)
        return found if self.residue_of is None else structure.by_residue(found, self.residue_of, self.how)

    def to_mean_reference(self, cross_trajectory: bool = False) -> DataFrame:
        return self._of("mean", cross_trajectory)

    def to_median_reference(self, cross_trajectory: bool = False) -> DataFrame:
        return self._of("median", cross_trajectory)


def time_series(frames: DataFrame, features: list[int], smooth: int | None = None, order: int | None = None, use_time: bool = False) -> DataFrame:
    """traj_id, feature_idx, x, value (smoothed if asked for) of chosen features."""
    long = model.to_long(frames).where(F.col("feature_idx").isin(features))
    by = ["traj_id", "feature_idx"]
    if smooth:
        how = windows.moving_average(long, smooth, by) if order is None else windows.savitzky_golay(long, smooth, order, by)
        long = long.drop("value").join(how.withColumnRenamed("smoothed", "value"), [*by, "frame_idx"])
    return windows.x_values(long, use_time).select(*by, "x", "value")
