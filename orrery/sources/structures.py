"""Text formats of structures and trajectories, as tables, and their writers.

Files are read with Spark's binary reader: one row for each file, so files are the unit
of parallel work; frames of a file are cut in the task that reads it. Compressed
trajectory formats need native codecs and are not read.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.names import code_of

ATOMS = "path string, atom_idx int, name string, element string, residue_index int, aaa_code string, a_code string, seqid int, chain string"
FRAMES = "path string, frame_idx long, time_ps float, xyz array<float>, box array<float>"


def _files(spark: SparkSession, path: str | Sequence[str], pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path if isinstance(path, str) else list(path)).select("path", "content")


def _text(path: str, content: bytes) -> list[str]:
    return (gzip.decompress(content) if path.endswith(".gz") else content).decode("utf-8", "replace").splitlines()


def parse_pdb(lines: list[str]) -> tuple[list[tuple], list[list[float]], list[float] | None]:
    """Atoms of the first model, coordinates (nm) of every model, box (nm)."""
    atoms, models, current, box, last, residue = [], [], [], None, None, -1
    first = True
    for line in lines:
        kind = line[:6].strip()
        if kind == "CRYST1":
            box = [float(line[a : a + 9]) / 10 for a in (6, 15, 24)]
        elif kind in ("ATOM", "HETATM"):
            current += [float(line[a : a + 8]) / 10 for a in (30, 38, 46)]
            if first:
                name, aaa, chain, seqid = line[12:16].strip(), line[17:21].strip(), line[21:22].strip(), int(line[22:26])
                if (chain, seqid, aaa) != last:
                    last, residue = (chain, seqid, aaa), residue + 1
                element = line[76:78].strip() or name.lstrip("0123456789")[:1]
                atoms.append((len(atoms), name, element, residue, aaa, code_of(aaa), seqid, chain))
        elif kind in ("ENDMDL", "END") and current:
            models.append(current)
            current, first = [], False
    if current:
        models.append(current)
    return atoms, models, box


def parse_xyz(lines: list[str]) -> tuple[list[str], list[list[float]]]:
    """Elements of the first frame and coordinates (Angstrom to nm) of every frame."""
    names, frames, at = [], [], 0
    while at < len(lines) and lines[at].strip():
        n = int(lines[at])
        rows = [x.split() for x in lines[at + 2 : at + 2 + n]]
        names = names or [r[0] for r in rows]
        frames.append([float(v) / 10 for r in rows for v in r[1:4]])
        at += n + 2
    return names, frames


def _mapped(files: DataFrame, make, schema: str) -> DataFrame:
    import pandas as pd

    columns = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = make(path, _text(path, content))
                for lo in range(0, len(rows), 1000):
                    yield pd.DataFrame(rows[lo : lo + 1000], columns=columns)

    return files.mapInPandas(run, schema)


def read_pdb_atoms(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return _mapped(_files(spark, path, "*.pdb*"), lambda p, lines: [(p, *a) for a in parse_pdb(lines)[0]], ATOMS)


def read_pdb_frames(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    def make(p: str, lines: list[str]) -> list[tuple]:
        _, models, box = parse_pdb(lines)
        return [(p, k, float(k), m, box) for k, m in enumerate(models)]

    return _mapped(_files(spark, path, "*.pdb*"), make, FRAMES)


def read_xyz_frames(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return _mapped(_files(spark, path, "*.xyz"), lambda p, lines: [(p, k, float(k), f, None) for k, f in enumerate(parse_xyz(lines)[1])], FRAMES)


def with_traj_ids(frames: DataFrame, stride: int = 1, atoms: Sequence[int] | None = None) -> DataFrame:
    """Numbers trajectories by path; keeps every k-th frame and chosen atoms at the source."""
    ids = frames.select("path").distinct().withColumn("traj_id", F.row_number().over(Window.orderBy("path")) - 1)
    rows = frames.where(F.col("frame_idx") % stride == 0).withColumn("frame_idx", (F.col("frame_idx") / stride).cast("long"))
    if atoms is not None:
        rows = rows.withColumn("xyz", F.flatten(F.transform(F.array(*[F.lit(int(a)) for a in atoms]), lambda a: F.slice(F.col("xyz"), a * 3 + 1, F.lit(3)))))
    return rows.join(ids, "path")


def concatenated(frames: DataFrame) -> DataFrame:
    """All trajectories as one, in order of their numbers."""
    lengths = frames.groupBy("traj_id").agg((F.max("frame_idx") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("traj_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = frames.join(lengths.select("traj_id", before.alias("shift")), "traj_id")
    return shifted.withColumn("frame_idx", F.col("frame_idx") + F.col("shift")).withColumn("traj_id", F.lit(0)).drop("shift")


def pdb_text(atoms: Sequence[tuple], xyz: Sequence[float], beta: Sequence[float] | None = None) -> str:
    """PDB text of a frame; atoms: (atom_idx, name, element, residue_index, aaa_code, a_code, seqid, chain)."""
    out = []
    for k, a in enumerate(atoms):
        x, y, z = (10 * v for v in xyz[3 * k : 3 * k + 3])
        name = a[1] if len(a[1]) > 3 else f" {a[1]:<3}"
        out.append(f"ATOM  {k + 1:5d} {name:<4} {a[4]:>3} {(a[7] or 'A')[:1]}{a[6]:4d}    {x:8.3f}{y:8.3f}{z:8.3f}{1.0:6.2f}{(beta[k] if beta else 0.0):6.2f}          {a[2]:>2}")
    return "\n".join([*out, "END"]) + "\n"


def feature_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_partitioned(df: DataFrame, path: str, by: str = "traj_id") -> None:
    """A columnar copy partitioned by trajectory, so later filters on it skip files."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def schema_of(atoms: DataFrame) -> pa.Schema:
    return atoms.toArrow().schema
