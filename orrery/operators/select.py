"""Selecting trajectories and frames, and sets of frames.

Selectors are DataFrames of keys; applying one is a semi-join, so that a filter
on keys reaches the scan of the frames.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.windows import stride_gap

KEYS = ["traj_id", "frame_idx"]


def numbers(spec: str) -> list[tuple[int, int]]:
    """Inclusive ranges of a string such as 1,3,7-9."""
    found = []
    for part in spec.split(","):
        part = part.strip()
        if m := re.fullmatch(r"(\d+)-(\d+)", part):
            found.append((int(m[1]), int(m[2])))
        elif part.isdigit():
            found.append((int(part), int(part)))
        else:
            raise ValueError(f"not a number or range: {part!r}")
    return found


def in_ranges(column: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | ((column == a) if a == b else column.between(a, b))
    return out


def trajectory_condition(selector: int | str | Sequence) -> Column:
    """On traj_id, name and tags: all, a number, range, list, name pattern, ``regex …`` or ``tag:…``."""
    if isinstance(selector, int):
        return F.col("traj_id") == selector
    if not isinstance(selector, str):
        out = F.lit(False)
        for s in selector:
            out = out | trajectory_condition(s)
        return out
    text = selector.strip()
    if text == "all":
        return F.lit(True)
    if re.fullmatch(r"[\d,\s-]+", text):
        return in_ranges(F.col("traj_id"), numbers(text))
    if text.startswith("tag:"):
        return F.array_contains("tags", text[4:].strip())
    if text.startswith("regex "):
        return F.col("name").rlike(text[6:])
    return F.col("name").rlike("^" + fnmatch.translate(text).removesuffix("\\Z").removesuffix("\\z") + "$")


def trajectories(dim: DataFrame, selector: int | str | Sequence) -> DataFrame:
    return dim.where(trajectory_condition(selector))


def by_tags(frames: DataFrame, dim: DataFrame, tags: Sequence[str], match_all: bool = True, stride: int = 1) -> DataFrame:
    """Frames of trajectories that have all, or any, of the tags."""
    wanted = F.array(*[F.lit(t) for t in tags])
    hit = F.size(F.array_intersect("tags", wanted)) == len(set(tags)) if match_all else F.arrays_overlap("tags", wanted)
    found = frames.join(dim.where(hit).select("traj_id"), "traj_id", "left_semi").select(*KEYS)
    return stride_gap(found, stride) if stride > 1 else found


def by_cluster(labels: DataFrame, ids: Sequence[int], stride: int = 1) -> DataFrame:
    """Frames with one of the labels; noise (-1) can't be asked for."""
    if any(i < 0 for i in ids):
        raise ValueError("noise is no cluster")
    found = labels.where(F.col("label").isin(list(ids))).select(*KEYS)
    return stride_gap(found, stride) if stride > 1 else found


def by_indices(frames: DataFrame, dim: DataFrame, wanted: dict, stride: int = 1) -> DataFrame:
    """{trajectory selector: frames}: all, a number, list or string of ranges, or {frames:…, stride:…}."""
    out = None
    for selector, spec in wanted.items():
        step = stride
        if isinstance(spec, dict):
            spec, step = spec["frames"], spec.get("stride", stride)
        if isinstance(spec, str) and spec == "all":
            hit = F.lit(True)
        else:
            text = spec if isinstance(spec, str) else ",".join(map(str, [spec] if isinstance(spec, int) else spec))
            hit = in_ranges(F.col("frame_idx"), numbers(text))
        ids = trajectories(dim, selector).select("traj_id")
        part = frames.where(hit).join(ids, "traj_id", "left_semi").select(*KEYS)
        part = stride_gap(part, step) if step > 1 else part
        out = part if out is None else out.unionByName(part)
    return out.distinct() if out is not None else frames.select(*KEYS).limit(0)


def clusters_as_selectors(labels: DataFrame, group: str, ids: Sequence[int] | None = None, noise: int = -1) -> DataFrame:
    """A selector for each cluster in one table: selector, traj_id, frame_idx."""
    found = labels.where(F.col("label") != noise)
    found = found.where(F.col("label").isin(list(ids))) if ids is not None else found
    return found.select(F.concat(F.lit(f"{group}_"), F.col("label").cast("string")).alias("selector"), *KEYS)


def tags_as_selectors(frames: DataFrame, dim: DataFrame, group: str, tags: Sequence[str] | None = None) -> DataFrame:
    each = dim.select("traj_id", F.explode("tags").alias("tag")).distinct()
    each = each.where(F.col("tag").isin(list(tags))) if tags is not None else each
    return frames.join(each, "traj_id").select(F.concat(F.lit(f"{group}_"), F.col("tag")).alias("selector"), *KEYS)


def update(old: DataFrame, new: DataFrame, mode: str = "add") -> DataFrame:
    """Union, difference or intersection of two selections."""
    old, new = old.select(*KEYS), new.select(*KEYS)
    if mode == "add":
        return old.unionByName(new).distinct()
    if mode == "subtract":
        return old.distinct().join(new, KEYS, "left_anti")
    if mode == "intersect":
        return old.distinct().join(new, KEYS, "left_semi")
    raise ValueError(f"mode must be add, subtract or intersect, not {mode!r}")


def apply(frames: DataFrame, selection: DataFrame) -> DataFrame:
    return frames.join(selection, KEYS, "left_semi")


def out_of_range(selection: DataFrame, dim: DataFrame) -> DataFrame:
    """Selected frames that their trajectory doesn't have."""
    return selection.join(dim.select("traj_id", "n_frames"), "traj_id", "left").where(F.col("n_frames").isNull() | (F.col("frame_idx") < 0) | (F.col("frame_idx") >= F.col("n_frames"))).select(*KEYS)


def add_tags(dim: DataFrame, selector, tags: Sequence[str], replace: bool = False) -> DataFrame:
    new = F.array(*[F.lit(t) for t in tags])
    merged = new if replace else F.array_union(F.coalesce("tags", F.array().cast("array<string>")), new)
    return dim.withColumn("tags", F.when(trajectory_condition(selector), merged).otherwise(F.col("tags")))


def selected_matrix(parts: dict[str, tuple[DataFrame, Sequence[int]]], selection: DataFrame | None = None) -> DataFrame:
    """Chosen columns of several feature tables side by side, for frames in all of them.

    Only the chosen places of each array are kept, before rows are joined.
    """
    out, names = None, []
    for name, (frames, places) in parts.items():
        column = F.transform(F.array(*[F.lit(int(p)) for p in places]), lambda i: F.get(F.col("features"), i))
        part = frames.select(*KEYS, column.alias(f"_{name}"))
        part = apply(part, selection) if selection is not None else part
        out = part if out is None else out.join(part, KEYS)
        names.append(f"_{name}")
    return out.select(*KEYS, F.concat(*names).alias("features"))


def common_identities(meta: DataFrame) -> DataFrame:
    """Features whose partners' identity (name, number, consensus) all trajectories have."""
    identity = F.transform("partners", lambda p: F.struct(p["residue"]["aaa_code"].alias("aaa"), p["residue"]["seqid"].alias("seqid"), p["residue"]["consensus"].alias("consensus")))
    keyed = meta.withColumn("identity", F.to_json(F.struct(identity.alias("i"))))
    n = meta.select("traj_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    held = keyed.groupBy("identity").agg(F.countDistinct("traj_id").alias("in_trajs")).crossJoin(F.broadcast(n)).where("in_trajs = n").select("identity")
    return keyed.join(held, "identity", "left_semi").drop("identity")


def common_features(kept: DataFrame, trajectories: DataFrame) -> DataFrame:
    """feature_idx that ``kept`` (traj_id, feature_idx) has for every one of ``trajectories`` (traj_id): none, if one of them keeps nothing."""
    n = trajectories.agg(F.countDistinct("traj_id").alias("n"))
    return kept.groupBy("feature_idx").agg(F.countDistinct("traj_id").alias("in_trajs")).crossJoin(F.broadcast(n)).where("in_trajs = n").select("feature_idx")


def join_trajectories(target: DataFrame, source: DataFrame) -> DataFrame:
    """Frames of ``source`` after those of ``target`` (one trajectory each)."""
    shift = target.agg((F.coalesce(F.max("frame_idx"), F.lit(-1)) + 1).alias("_shift"), F.first("traj_id").alias("_traj"))
    moved = source.crossJoin(F.broadcast(shift)).withColumn("frame_idx", F.col("frame_idx") + F.col("_shift")).withColumn("traj_id", F.col("_traj")).drop("_shift", "_traj")
    return target.unionByName(moved.select(*target.columns))


def stack_trajectories(target: DataFrame, source: DataFrame, xyz: str = "xyz") -> DataFrame:
    """Atoms of ``source`` after those of ``target`` in each frame."""
    return target.join(source.select("frame_idx", F.col(xyz).alias("_more")), "frame_idx").withColumn(xyz, F.concat(xyz, "_more")).select(*target.columns)


def without_solvent(atoms: DataFrame, names: Sequence[str] = ("HOH", "WAT", "SOL", "TIP3", "NA", "CL", "K"), keep: Sequence[str] = ()) -> DataFrame:
    return atoms.where(~F.col("aaa_code").isin([n for n in names if n not in keep]))
