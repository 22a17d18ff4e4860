"""The pipeline: named entities over DataFrames, built lazily."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import model
from orrery.operators import cluster, compare, decompose, language, plotdata, reduce, select, structure
from orrery.sources import store


class Pipeline:
    """Registries of trajectories, features, selectors, decompositions, clusterings and comparisons.

    Entities are DataFrames under names; nothing runs until a result is asked for.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.clear()

    def clear(self) -> None:
        self.trajectories: DataFrame | None = None
        self.features: dict[str, DataFrame] = {}
        self.meta: dict[str, DataFrame] = {}
        self.reductions: dict[str, DataFrame] = {}
        self.feature_selectors: dict[str, list[dict]] = {}
        self.data_selectors: dict[str, DataFrame] = {}
        self.decompositions: dict[str, DataFrame] = {}
        self.clusterings: dict[str, DataFrame] = {}
        self.comparisons: dict[str, dict] = {}
        self.importances: dict[str, compare.Trees] = {}
        self.plugins: dict[str, Callable[..., DataFrame]] = {}

    @staticmethod
    def _new(registry: dict, name: str, value, force: bool = False) -> None:
        if name in registry and not force:
            raise ValueError(f"{name!r} exists")
        registry[name] = value

    # Trajectories and features

    def add_trajectories(self, dim: DataFrame) -> None:
        """traj_id, name, n_frames, tags."""
        self.trajectories = dim if self.trajectories is None else self.trajectories.unionByName(dim)

    def tag(self, selector, tags: Sequence[str], replace: bool = False) -> None:
        self.trajectories = select.add_tags(self.trajectories, selector, tags, replace)

    def rename(self, names: dict[int, str]) -> None:
        out = F.col("name")
        for k, v in names.items():
            out = F.when(F.col("traj_id") == k, v).otherwise(out)
        self.trajectories = self.trajectories.withColumn("name", out)

    def remove_trajectories(self, selector) -> None:
        self.trajectories = self.trajectories.where(~F.coalesce(select.trajectory_condition(selector), F.lit(False)))

    def add_feature(self, name: str, frames: DataFrame, meta: DataFrame | None = None, needs: Sequence[str] = (), force: bool = False) -> None:
        missing = [n for n in needs if n not in self.features]
        if missing:
            raise ValueError(f"{name} needs {missing}")
        self._new(self.features, name, frames, force)
        if meta is not None:
            self.meta[name] = meta

    def register(self, name: str, compute: Callable[..., DataFrame]) -> None:
        """A feature type, clustering or decomposition of one's own: DataFrame to DataFrame."""
        self._new(self.plugins, name, compute)

    def compute(self, plugin: str, source: str, to: str, **options) -> None:
        self.add_feature(to, self.plugins[plugin](self.features[source], **options))

    def reset_feature(self, name: str) -> None:
        self.features.pop(name, None)
        self.reductions.pop(name, None)

    def long(self, name: str) -> DataFrame:
        return model.to_long(self.features[name])

    def reduce(self, name: str, feature_type: str, metric: str, least: float | None = None, most: float | None = None, cross_trajectory: bool = False, **options) -> DataFrame:
        self.reductions[name] = reduce.reduce_features(self.long(name), feature_type, metric, least, most, cross_trajectory, **options)
        return self.reductions[name]

    def reset_reduction(self, name: str) -> None:
        self.reductions.pop(name, None)

    def reduction_summary(self, name: str) -> DataFrame:
        return reduce.summary(self.long(name), self.reductions[name])

    # Selectors

    def create_feature_selector(self, name: str) -> None:
        self._new(self.feature_selectors, name, [])

    def add_selection(self, name: str, feature: str, selection: str = "all", use_reduced: bool = False, require_all: bool = False, common: bool = True, kept: DataFrame | None = None) -> None:
        """A part of a selector. ``use_reduced``: only what the feature's reduction keeps; ``kept``: only what this part's own reduction (traj_id, feature_idx) keeps."""
        parts = self.feature_selectors[name]
        own = f"{name}~{len(parts)}" if kept is not None else None
        if own:
            self.reductions[own] = kept
        parts.append({"feature": feature, "selection": selection, "use_reduced": use_reduced, "require_all": require_all, "common": common, "kept": own})

    def selected_features(self, name: str) -> DataFrame:
        """feature_type, traj_id, feature_idx: the union of the selector's parts."""
        out = None
        for part in self.feature_selectors[name]:
            meta = language.select_features(self.meta[part["feature"]], part["selection"], part["require_all"])
            meta = select.common_identities(meta) if part["common"] else meta
            found = meta.select(F.lit(part["feature"]).alias("feature_type"), "traj_id", "feature_idx")
            for reduction in ([part["feature"]] if part["use_reduced"] else []) + ([part["kept"]] if part.get("kept") else []):
                found = found.join(self.reductions[reduction].select("traj_id", "feature_idx"), ["traj_id", "feature_idx"], "left_semi")
            out = found if out is None else out.unionByName(found)
        return out.distinct()

    def uneven(self, name: str) -> DataFrame:
        """Trajectories whose number of selected columns differs from the first one's."""
        n = self.selected_features(name).groupBy("traj_id").agg(F.count(F.lit(1)).alias("n"))
        first = n.agg(F.min_by("n", "traj_id").alias("n0"))
        return n.crossJoin(F.broadcast(first)).where("n <> n0").drop("n0")

    def create_data_selector(self, name: str, selection: DataFrame | None = None) -> None:
        self._new(self.data_selectors, name, selection if selection is not None else self.spark.createDataFrame([], "traj_id int, frame_idx long"))

    def update_data_selector(self, name: str, selection: DataFrame, mode: str = "add") -> None:
        self.data_selectors[name] = select.update(self.data_selectors[name], selection, mode)

    def remove(self, registry: str, name: str) -> None:
        del getattr(self, registry)[name]

    def matrix(self, feature_selector: str, data_selector: str | None = None) -> DataFrame:
        """traj_id, frame_idx, features: selected columns side by side, in order of type and column."""
        chosen = self.selected_features(feature_selector)
        out = None
        for k, name in enumerate(dict.fromkeys(p["feature"] for p in self.feature_selectors[feature_selector])):
            long = self.long(name).join(chosen.where(F.col("feature_type") == name).select("traj_id", "feature_idx"), ["traj_id", "feature_idx"], "left_semi")
            if data_selector:
                long = select.apply(long, self.data_selectors[data_selector])
            part = model.to_array(long).withColumnRenamed("features", f"_f{k}")
            out = part if out is None else out.join(part, ["traj_id", "frame_idx"])
        return out.select("traj_id", "frame_idx", F.concat(*[c for c in out.columns if c.startswith("_f")]).alias("features"))

    # Decomposition, clustering, comparison

    def decompose(self, name: str, frames: DataFrame, kind: str = "pca", force: bool = False, **options) -> DataFrame:
        run = {"pca": lambda f, **o: decompose.Pca(f, **o).transform(f), "kernel_pca": decompose.kernel_pca, "contact_kernel_pca": decompose.contact_kernel_pca, "diffusion_maps": decompose.diffusion_maps}
        self._new(self.decompositions, name, (run | self.plugins)[kind](frames, **options), force)
        return self.decompositions[name]

    def cluster(self, name: str, frames: DataFrame, method: str = "dbscan", force: bool = False, **options) -> DataFrame:
        found = self.plugins[method](frames, **options) if method in self.plugins else cluster.cluster(frames, method, **options)
        self._new(self.clusterings, name, found, force)
        return found

    def centres(self, clustering: str, frames: DataFrame, method: str = "centroid") -> DataFrame:
        return cluster.centres(frames.join(self.clusterings[clustering], ["traj_id", "frame_idx"]), method)

    def compare(self, name: str, selectors: Sequence[str], mode: str = "one_vs_rest") -> DataFrame:
        parts = None
        for s in selectors:
            part = self.data_selectors[s].select(F.lit(s).alias("selector"), "traj_id", "frame_idx")
            parts = part if parts is None else parts.unionByName(part)
        self._new(self.comparisons, name, {"mode": mode, "selectors": list(selectors), "rows": compare.comparison_rows(parts, selectors, mode)})
        return self.comparisons[name]["rows"]

    def importance(self, name: str, comparison: str, frames: DataFrame, **options) -> DataFrame:
        data = compare.comparison_data(frames, self.comparisons[comparison]["rows"])
        self._new(self.importances, name, compare.tree_importance(data, **options))
        return self.importances[name][0]

    def top_features(self, name: str, n: int = 10, averaged: bool = False) -> DataFrame:
        scores = self.importances[name][0]
        return compare.top_averaged(scores, n) if averaged else compare.top_features(scores, n)

    # Tables for drawing

    def landscape(self, decomposition: str, dims: tuple[int, int] = (0, 1), bins: int = 50, temperature: float = 300.0) -> DataFrame:
        c = self.decompositions[decomposition].select(F.get("comps", F.lit(dims[0])).alias("x"), F.get("comps", F.lit(dims[1])).alias("y"))
        return plotdata.energy(plotdata.histogram(c, bins), temperature)

    def membership(self, clustering: str) -> DataFrame:
        return plotdata.membership(self.clusterings[clustering])

    def residue_importance(self, name: str, feature: str) -> DataFrame:
        return structure.residue_importance(compare.average_importance(self.importances[name][0]), self.meta[feature].where(F.col("traj_id") == 0))

    # Saving

    def _tables(self) -> dict[str, DataFrame]:
        groups = {"features": self.features, "meta": self.meta, "reductions": self.reductions, "data_selectors": self.data_selectors, "decompositions": self.decompositions, "clusterings": self.clusterings}
        groups["comparisons"] = {n: c["rows"] for n, c in self.comparisons.items()}
        groups["importances"] = {f"{n}.{part}": df for n, trees in self.importances.items() for part, df in trees._asdict().items()}
        out = {f"{g}.{n}": df for g, tables in groups.items() for n, df in tables.items()}
        return out | ({"trajectories": self.trajectories} if self.trajectories is not None else {})

    def save(self, path: str) -> None:
        """All tables and notes; functions of one's own are named in the notes and have to be registered again."""
        comparisons = {n: {"mode": c["mode"], "selectors": c["selectors"]} for n, c in self.comparisons.items()}
        store.save(self._tables(), path, {"feature_selectors": self.feature_selectors, "comparisons": comparisons, "plugins": sorted(self.plugins)})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Pipeline:
        p = cls(spark)
        tables, notes = store.load(spark, path)
        for name, df in tables.items():
            if name == "trajectories":
                p.trajectories = df
            else:
                group, _, entity = name.partition(".")
                if group == "comparisons":
                    p.comparisons[entity] = {**notes["comparisons"][entity], "rows": df}
                elif group == "importances":
                    entity, _, part = entity.rpartition(".")
                    held = p.importances.get(entity, compare.Trees(None, None, None))
                    p.importances[entity] = held._replace(**{part: df})
                else:
                    getattr(p, group)[entity] = df
        p.feature_selectors = notes["feature_selectors"]
        return p

    def summary(self) -> dict[str, list[str]]:
        return {k: sorted(v) for k, v in vars(self).items() if isinstance(v, dict)}
