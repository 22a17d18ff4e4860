"""Fluctuation and mean structures of atoms and residues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.stats import mad, percentile


def atoms_long(frames: DataFrame, xyz: str = "features") -> DataFrame:
    """traj_id, frame_idx, atom, x, y, z."""
    one = lambda k: F.struct(F.get(F.col(xyz), k * 3).alias("x"), F.get(F.col(xyz), k * 3 + 1).alias("y"), F.get(F.col(xyz), k * 3 + 2).alias("z"))
    n = (F.size(xyz) / 3).cast("int")
    return frames.select("traj_id", "frame_idx", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), one)).alias("atom", "p")).select("traj_id", "frame_idx", "atom", "p.x", "p.y", "p.z")


def reference_structure(atoms: DataFrame, mode: str = "mean", cross_trajectory: bool = False) -> DataFrame:
    """Mean or median position of each atom, for each trajectory or over all."""
    by = ["atom"] if cross_trajectory else ["traj_id", "atom"]
    f = F.avg if mode == "mean" else lambda c: percentile(F.col(c), 0.5)
    return atoms.groupBy(*by).agg(*[f(c).alias(f"{c}0") for c in "xyz"])


def rmsf(frames: DataFrame, reference: str = "mean", metric: str = "mean", cross_trajectory: bool = False, xyz: str = "features") -> DataFrame:
    """Root of the mean or median squared distance of each atom from its reference position, or the median absolute deviation of the distances."""
    atoms = atoms_long(frames, xyz)
    by = ["atom"] if cross_trajectory else ["traj_id", "atom"]
    d2 = sum(((F.col(c) - F.col(f"{c}0")) * (F.col(c) - F.col(f"{c}0")) for c in "xyz"), F.lit(0.0))
    rows = atoms.join(reference_structure(atoms, reference, cross_trajectory), by).select(*by, d2.alias("d2"))
    if metric == "mean":
        return rows.groupBy(*by).agg(F.sqrt(F.avg("d2")).alias("rmsf"))
    if metric == "median":
        return rows.groupBy(*by).agg(F.sqrt(percentile(F.col("d2"), 0.5)).alias("rmsf"))
    return mad(rows.withColumn("d", F.sqrt("d2")), by, "d").withColumnRenamed("mad", "rmsf")


def by_residue(values: DataFrame, residue_of: DataFrame, how: str = "mean", value: str = "rmsf") -> DataFrame:
    """Atoms' values by residue: mean, median, rms or rms_median. residue_of: atom, residue."""
    by = [c for c in ("traj_id",) if c in values.columns] + ["residue"]
    x = F.col(value)
    agg = {"mean": F.avg(x), "median": percentile(x, 0.5), "rms": F.sqrt(F.avg(x * x)), "rms_median": F.sqrt(percentile(x * x, 0.5))}[how]
    return values.join(residue_of, "atom").groupBy(*by).agg(agg.alias(value))


def residue_importance(scores: DataFrame, meta: DataFrame) -> DataFrame:
    """Sum of features' scores for each of their residues. scores: feature_idx, score; meta: feature_idx, partners."""
    each = meta.select("feature_idx", F.explode(F.array_distinct(F.transform("partners", lambda p: p["residue"]["index"]))).alias("residue"))
    return scores.join(each, "feature_idx").groupBy("residue").agg(F.sum("score").alias("importance"))


def beta_factors(importance: DataFrame, atoms: DataFrame) -> DataFrame:
    """Importance over its largest value for each atom of a residue, 0 for others. atoms: atom_idx, residue_index."""
    top = importance.agg(F.max("importance").alias("top"))
    share = importance.crossJoin(F.broadcast(top)).select(F.col("residue").alias("residue_index"), F.when(F.col("top") > 0, F.col("importance") / F.col("top")).otherwise(0.0).alias("beta"))
    return atoms.join(share, "residue_index", "left").select("atom_idx", "residue_index", F.coalesce("beta", F.lit(0.0)).alias("beta"))


def residue_features(top: DataFrame, meta: DataFrame) -> DataFrame:
    """Top features of each residue, and whether several share it."""
    each = meta.select("feature_idx", F.explode(F.array_distinct(F.transform("partners", lambda p: p["residue"]["index"]))).alias("residue"))
    held = top.select("feature_idx").join(each, "feature_idx").groupBy("residue").agg(F.sort_array(F.collect_set("feature_idx")).alias("features"))
    return held.withColumn("shared", F.size("features") > 1)


def pymol_script(pdb: str, residues: Sequence[tuple[int, str]], title: str = "structure") -> str:
    """Text of a script that shows a structure by beta factor with named residues in colours."""
    lines = [f"load {pdb}, {title}", "hide everything", f"show cartoon, {title}", f"spectrum b, blue_white_red, {title}"]
    for seqid, color in residues:
        lines += [f"show sticks, {title} and resi {seqid}", f"color 0x{color.lstrip('#')}, {title} and resi {seqid}"]
    return "\n".join(lines) + "\n"
