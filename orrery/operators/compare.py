"""Comparison sets, decision trees and ranked features."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import circular

KEYS = ["traj_id", "frame_idx"]


def sub_comparisons(names: Sequence[str], mode: str) -> list[tuple[str, list[tuple[list[str], int]]]]:
    """(name, [(selectors, label)]) for binary, pairwise, one_vs_rest or multiclass comparison."""
    names = list(names)
    if mode == "binary":
        if len(names) != 2:
            raise ValueError("a binary comparison takes two selectors")
        return [(f"{names[0]}_vs_{names[1]}", [([names[0]], 0), ([names[1]], 1)])]
    if mode == "pairwise":
        return [(f"{a}_vs_{b}", [([a], 0), ([b], 1)]) for i, a in enumerate(names) for b in names[i + 1 :]]
    if mode == "one_vs_rest":
        return [(f"{a}_vs_rest", [([a], 0), ([b for b in names if b != a], 1)]) for a in names]
    if mode == "multiclass":
        return [("multiclass_all", [([a], k) for k, a in enumerate(names)])]
    raise ValueError(f"unknown mode {mode!r}")


def comparison_rows(selectors: DataFrame, names: Sequence[str], mode: str) -> DataFrame:
    """sub_comparison, y, traj_id, frame_idx of all sub-comparisons in one table.

    Within a side frames are distinct; a frame on both sides stands on both. The list of
    selectors and sides is a small table, so all sub-comparisons take one join.
    """
    spark = selectors.sparkSession
    table = [(sub, s, y) for sub, sides in sub_comparisons(names, mode) for group, y in sides for s in group]
    sides = spark.createDataFrame(table, "sub_comparison string, selector string, y int")
    return selectors.join(F.broadcast(sides), "selector").select("sub_comparison", "y", *KEYS).distinct()


def comparison_data(frames: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(frames, KEYS)


def stratified(rows: DataFrame, most: int, by: Sequence[str] = ("sub_comparison", "y"), seed: int = 42) -> DataFrame:
    """At most about ``most`` rows of each sub-comparison, each class by its share (one at least); by seeded hash."""
    by = list(by)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.groupBy(*by[:-1]).agg(F.sum("_n").alias("_total"))
    quota = sizes.join(total, by[:-1]).withColumn("_quota", F.when(F.col("_total") <= most, F.col("_n")).otherwise(F.greatest(F.lit(1), F.floor(F.lit(most) * F.col("_n") / F.col("_total"))))).select(*by, "_quota")
    order = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *KEYS), *KEYS)
    return rows.join(quota, by).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.col("_quota")).drop("_k", "_quota")


def sample_size(n: int, fraction: float = 0.1, least: int = 50_000, most: int = 100_000) -> int:
    return n if n <= least else int(min(most, max(least, fraction * n)))


def best_split(rows: DataFrame, by: Sequence[str] = ("feature_idx",)) -> DataFrame:
    """The cut of each feature with the largest gain in Gini impurity, exact. rows: by, value, y in {0, 1}.

    Counts for each distinct value first; the running sums then go over distinct values.
    """
    by = list(by)
    held = rows.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("p"))
    order = Window.partitionBy(*by).orderBy("value")
    whole = Window.partitionBy(*by)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    held = held.select(*by, "value", F.sum("n").over(upto).alias("nl"), F.sum("p").over(upto).alias("pl"), F.sum("n").over(whole).alias("n"), F.sum("p").over(whole).alias("p"), F.lead("value").over(order).alias("after")).where("after IS NOT NULL")
    gini = lambda p, n: 2 * (p / n) * (1 - p / n)
    nr, pr = F.col("n") - F.col("nl"), F.col("p") - F.col("pl")
    gain = gini(F.col("p"), F.col("n")) - F.col("nl") / F.col("n") * gini(F.col("pl"), F.col("nl")) - nr / F.col("n") * gini(pr, nr)
    best = held.select(*by, gain.alias("gain"), ((F.col("value") + F.col("after")) / 2).alias("threshold"))
    # Gains that differ by rounding only count as ties: the lowest threshold wins.
    top = best.groupBy(*by).agg(F.min(F.struct((-F.round("gain", 9)).alias("less"), F.col("threshold"))).alias("b"))
    return top.select(*by, (-F.col("b.less")).alias("gain"), F.col("b.threshold").alias("threshold"))


class Tree:
    """CART classifier in numpy, by Gini impurity or entropy."""

    def __init__(self, max_depth: int | None = 5, min_samples_split: int = 2, min_samples_leaf: int = 1, criterion: str = "gini"):
        self.max_depth, self.split, self.leaf, self.criterion = max_depth, min_samples_split, min_samples_leaf, criterion
        self.nodes: list[dict] = []

    def impurity(self, counts: np.ndarray) -> np.ndarray:
        p = counts / np.maximum(counts.sum(-1, keepdims=True), 1)
        return 1 - (p**2).sum(-1) if self.criterion == "gini" else -(np.where(p > 0, p * np.log2(np.maximum(p, 1e-300)), 0)).sum(-1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        if np.isnan(x).any():
            raise ValueError("NaN in the features")
        self.classes, y = np.unique(y, return_inverse=True)
        self.importance = np.zeros(x.shape[1])
        self.total = len(y)
        self._grow(x, y, np.arange(len(y)), 0)
        if self.importance.sum() > 0:
            self.importance = self.importance / self.importance.sum()
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int) -> int:
        counts = np.bincount(y[rows], minlength=len(self.classes)).astype(float)
        me = len(self.nodes)
        self.nodes.append({"id": me, "depth": depth, "n": len(rows), "impurity": float(self.impurity(counts)), "counts": counts.tolist(), "feature": -1, "threshold": None, "left": None, "right": None})
        if (self.max_depth is not None and depth >= self.max_depth) or len(rows) < self.split or (counts > 0).sum() < 2:
            return me
        best = None
        hot = np.eye(len(self.classes))[y[rows]]
        for f in range(x.shape[1]):
            order = np.argsort(x[rows, f], kind="stable")
            v = x[rows, f][order]
            left = hot[order].cumsum(0)[:-1]
            right = counts - left
            n = np.arange(1, len(rows))
            ok = (v[1:] > v[:-1]) & (n >= self.leaf) & (len(rows) - n >= self.leaf)
            if not ok.any():
                continue
            cost = np.where(ok, (n * self.impurity(left) + (len(rows) - n) * self.impurity(right)) / len(rows), np.inf)
            k = int(cost.argmin())
            if best is None or cost[k] < best[0] - 1e-12:
                best = (cost[k], f, (v[k] + v[k + 1]) / 2)
        if best is None or self.nodes[me]["impurity"] - best[0] <= 1e-12:
            return me
        _, f, cut = best
        self.importance[f] += len(rows) / self.total * (self.nodes[me]["impurity"] - best[0])
        side = x[rows, f] <= cut
        self.nodes[me] |= {"feature": f, "threshold": float(cut)}
        self.nodes[me]["left"] = self._grow(x, y, rows[side], depth + 1)
        self.nodes[me]["right"] = self._grow(x, y, rows[~side], depth + 1)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array([n[k] if n["feature"] >= 0 else 0 for n in self.nodes]) for k in ("feature", "threshold", "left", "right"))
        inner, best = np.array([n["feature"] >= 0 for n in self.nodes]), np.array([int(np.argmax(n["counts"])) for n in self.nodes])
        # All rows go down the tree together, a level at a time.
        at = np.zeros(len(x), int)
        while len(rows := np.flatnonzero(inner[at])):
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= cut[node], left[node], right[node])
        return self.classes[best[at]]

    def report(self, x: np.ndarray, y: np.ndarray) -> dict:
        got = self.predict(x)
        each = {}
        for c in self.classes.tolist():
            hit, said, held = ((got == c) & (y == c)).sum(), (got == c).sum(), (y == c).sum()
            p, r = hit / max(1, said), hit / max(1, held)
            each[c] = {"precision": float(p), "recall": float(r), "f1": float(2 * p * r / max(p + r, 1e-12)), "support": int(held)}
        return {"accuracy": float((got == y).mean()), "classes": each, "depth": max(n["depth"] for n in self.nodes), "leaves": sum(n["feature"] < 0 for n in self.nodes)}


class Trees(NamedTuple):
    """Tables of the trees of a comparison: scores of features, nodes (with children and counts of classes), reports of the fit."""

    scores: DataFrame
    nodes: DataFrame
    reports: DataFrame


def tree_importance(data: DataFrame, features: str = "features", max_samples: int = 50_000, max_depth: int | None = 5, **options) -> Trees:
    """A tree for each sub-comparison; each is fitted once, in a task of its own, on at most ``max_samples`` rows.

    The bound is one on labelled rows of a classifier's fit: the larger sub-comparison is
    sampled by class (``stratified``).
    """
    import pandas as pd

    held = stratified(data, max_samples).select("sub_comparison", "y", *KEYS, features)

    def fitted(batch: pd.DataFrame) -> Tree:
        batch = batch.sort_values(["y", *KEYS])
        return Tree(max_depth, **options).fit(np.stack(batch[features].to_numpy()).astype(float), batch["y"].to_numpy())

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        tree = fitted(batch)
        x, y = np.stack(batch[features].to_numpy()).astype(float), batch["y"].to_numpy()
        report = tree.report(x, y)
        classes = [{"class": int(c), **v} for c, v in report.pop("classes").items()]
        nodes = [{**{k: n[k] for k in ("id", "depth", "n", "impurity", "feature", "threshold", "left", "right")}, "counts": n["counts"]} for n in tree.nodes]
        return pd.DataFrame([{"sub_comparison": batch["sub_comparison"].iloc[0], "importance": tree.importance.tolist(), "nodes": nodes, "report": {**report, "rows": len(y), "classes": classes}}])

    node = "array<struct<id:int,depth:int,n:int,impurity:double,feature:int,threshold:double,left:int,right:int,counts:array<double>>>"
    report = "struct<accuracy:double,depth:int,leaves:int,rows:int,classes:array<struct<class:int,precision:double,recall:double,f1:double,support:int>>>"
    fits = held.groupBy("sub_comparison").applyInPandas(run, f"sub_comparison string, importance array<double>, nodes {node}, report {report}").persist()
    scores = fits.select("sub_comparison", F.posexplode("importance").alias("feature_idx", "score"))
    return Trees(scores, fits.select("sub_comparison", F.explode("nodes").alias("x")).select("sub_comparison", "x.*"), fits.select("sub_comparison", "report.*"))


def top_features(scores: DataFrame, n: int = 10, by: Sequence[str] = ("sub_comparison",)) -> DataFrame:
    """Ranks 1 to n of each group; ties go to the smaller feature_idx. A rank limit, so tasks keep n rows at most."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "feature_idx")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def average_importance(scores: DataFrame) -> DataFrame:
    return scores.groupBy("feature_idx").agg(F.avg("score").alias("score"))


def top_averaged(scores: DataFrame, n: int = 10) -> DataFrame:
    top = average_importance(scores).orderBy(F.desc("score"), "feature_idx").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "feature_idx")))


def tree_rules(nodes: DataFrame) -> DataFrame:
    """Mean threshold of each feature, weighted by the impurity of its nodes."""
    used = nodes.where("feature >= 0")
    w = F.sum("impurity")
    return used.groupBy("sub_comparison", F.col("feature").alias("feature_idx")).agg(F.when(w > 0, F.sum(F.col("threshold") * F.col("impurity")) / w).otherwise(F.avg("threshold")).alias("threshold"))


def representative_frames(long: DataFrame, rules: DataFrame, periodic: bool = False) -> DataFrame:
    """The frame with the largest sum of score / (1 + distance to the threshold); the first of equals.

    rules: feature_idx, score, threshold (few rows).
    """
    d = F.col("value") - F.col("threshold")
    d = circular.distance(d) if periodic else F.abs(d)
    scored = long.join(F.broadcast(rules.select("feature_idx", "score", "threshold")), "feature_idx").groupBy(*KEYS).agg(F.sum(F.col("score") / (1 + d)).alias("score"))
    best = scored.agg(F.min(F.struct((-F.round("score", 9)).alias("less"), *KEYS)).alias("b"))
    return best.select("b.traj_id", "b.frame_idx", (-F.col("b.less")).alias("score"))


def centroid_frame(frames: DataFrame, features: str = "features") -> DataFrame:
    """The frame nearest to the mean of all frames; the first of equals."""
    from orrery.operators.decompose import moments

    _, mean, _ = moments(frames, features)
    m = F.array(*[F.lit(float(x)) for x in mean])
    d2 = F.aggregate(F.zip_with(features, m, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    best = frames.select(*KEYS, F.sqrt(d2).alias("d")).agg(F.min(F.struct(F.round("d", 9).alias("d"), *KEYS)).alias("b"))
    return best.select("b.traj_id", "b.frame_idx", F.col("b.d").alias("distance"))


def representatives(long: DataFrame, trees: Trees, sub_comparison: str, n: int = 10, periodic: bool = False) -> DataFrame:
    """The frame that stands best for a sub-comparison: its n highest scores and their mean thresholds, put together."""
    best = top_features(trees.scores.where(F.col("sub_comparison") == sub_comparison), n)
    rules = best.join(tree_rules(trees.nodes), ["sub_comparison", "feature_idx"])
    return representative_frames(long, rules, periodic)


def contacts_as_distances(selection: list[dict]) -> list[dict]:
    """A selection of contacts as the same selection of distances."""
    return [{**s, "feature_type": "distances"} if s.get("feature_type") == "contacts" else dict(s) for s in selection]


def rules_frame(spark: SparkSession, rules: Sequence[tuple[int, float, float]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "feature_idx int, score double, threshold double")
