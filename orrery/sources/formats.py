"""Trajectory and topology formats beside PDB and XYZ, as tables of frames and atoms.

Binary trajectories of fixed frame size (DCD, NetCDF-3) are cut into ranges of frames:
the driver reads file headers only, and every task reads its own ranges through
pyarrow's file systems, so one large file is many tasks. Text formats (mdcrd,
lammpstrj, prmtop, PSF, mol2) are read a file at a time. Lengths are in nm, times in ps.

Formats with a codec of their own (XTC) or of HDF5 are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.sources.structures import ATOMS, FRAMES, _files, _mapped, read_pdb_atoms, read_pdb_frames, read_xyz_frames

RANGE = 1000

#: Chemical symbols by atomic number, from 1.
SYMBOLS = "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn".split()


def opened(path: str):
    """A seekable file of any file system that pyarrow knows."""
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return files.open_input_file(at)


@dataclass
class Layout:
    """Where frames lie in a file of equal frames."""

    n_frames: int
    n_atoms: int
    first: int
    size: int
    step_ps: float = 1.0
    start_ps: float = 0.0
    details: tuple = ()


# DCD: Fortran records with the length before and after; x, y and z in records of their own, in Angstrom


def dcd_layout(file) -> Layout:
    head = file.read(92)
    if len(head) < 92 or head[4:8] != b"CORD":
        raise ValueError("not a DCD file")
    end = "<" if struct.unpack("<i", head[:4])[0] == 84 else ">"
    control = struct.unpack(f"{end}20i", head[8:88])
    n_frames, start, every, fixed, cell, charmm = control[0], control[1], control[2], control[8], control[10], control[19]
    delta = struct.unpack(f"{end}f", head[44:48])[0] if charmm else struct.unpack(f"{end}d", head[44:52])[0]
    if fixed:
        raise ValueError("DCD files with fixed atoms are not read")
    title = struct.unpack(f"{end}i", file.read(4))[0]
    file.seek(file.tell() + title + 4)
    n_atoms = struct.unpack(f"{end}3i", file.read(12))[1]
    at, record = file.tell(), 4 * n_atoms + 8
    size = 3 * record + (56 if cell and charmm else 0)
    # The header's count may be that of a run that ended early.
    file.seek(0, 2)
    n_frames = (file.tell() - at) // size if size else n_frames
    unit = 0.0488882129
    return Layout(n_frames, n_atoms, at, size, delta * unit * max(every, 1), delta * unit * start, (end, bool(cell and charmm)))


def dcd_frames(raw: bytes, layout: Layout) -> Iterator[tuple[np.ndarray, list[float] | None]]:
    end, cell = layout.details
    record = 4 * layout.n_atoms + 8
    for at in range(0, len(raw) - layout.size + 1, layout.size):
        box = None
        if cell:
            a = np.frombuffer(raw, f"{end}f8", 6, at + 4)
            box = [a[0] / 10, a[2] / 10, a[5] / 10]
            at += 56
        axes = [np.frombuffer(raw, f"{end}f4", layout.n_atoms, at + k * record + 4) for k in range(3)]
        yield np.stack(axes, axis=1).ravel() / np.float32(10), box


# NetCDF-3 (classic and 64-bit offset): coordinates (frame, atom, 3), cell_lengths, time as record variables


def netcdf_layout(file) -> Layout:
    magic = file.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2):
        raise ValueError("not a NetCDF-3 file")
    number = lambda: struct.unpack(">i", file.read(4))[0]

    def name() -> str:
        n = number()
        return file.read(n + -n % 4)[:n].decode()

    def attributes() -> None:
        tag, n = number(), number()
        for _ in range(n if tag else 0):
            name()
            kind, k = number(), number()
            size = k * {1: 1, 2: 1, 3: 2, 4: 4, 5: 4, 6: 8}[kind]
            file.seek(file.tell() + size + -size % 4)

    records = number()
    tag, n = number(), number()
    dims = [(name(), number()) for _ in range(n if tag else 0)]
    attributes()
    tag, n = number(), number()
    variables = {}
    for _ in range(n if tag else 0):
        key, shape = name(), [number() for _ in range(number())]
        attributes()
        kind, size = number(), number()
        begin = number() if magic[3] == 1 else struct.unpack(">q", file.read(8))[0]
        variables[key] = (shape, kind, size, begin)
    held = {k: v for k, v in variables.items() if v[0] and dims[v[0][0]][1] == 0}
    if "coordinates" not in held:
        raise ValueError("no coordinates by frame")
    size = sum(v[2] for v in held.values())
    first = min(v[3] for v in held.values())
    if records < 0:
        file.seek(0, 2)
        records = (file.tell() - first) // size
    places = {k: (v[3] - first, ">f4" if v[1] == 5 else ">f8") for k, v in held.items()}
    return Layout(records, dims[held["coordinates"][0][1]][1], first, size, details=tuple(sorted(places.items())))


def netcdf_frames(raw: bytes, layout: Layout) -> Iterator[tuple[np.ndarray, list[float] | None, float | None]]:
    places = dict(layout.details)
    for at in range(0, len(raw) - layout.size + 1, layout.size):
        get = lambda k, n: np.frombuffer(raw, places[k][1], n, at + places[k][0]) if k in places else None  # noqa: B023, E731
        box, when = get("cell_lengths", 3), get("time", 1)
        yield get("coordinates", 3 * layout.n_atoms).astype(np.float32) / np.float32(10), None if box is None else [float(x) / 10 for x in box], None if when is None else float(when[0])


KINDS = {"dcd": (dcd_layout, dcd_frames), "nc": (netcdf_layout, netcdf_frames), "ncdf": (netcdf_layout, netcdf_frames)}


def suffix(path: str) -> str:
    return path.removesuffix(".gz").rpartition(".")[2].lower()


def read_ranges(spark: SparkSession, paths: Sequence[str], stride: int = 1, per_range: int = RANGE) -> DataFrame:
    """Frames (see ``FRAMES``) of files of equal frames, in ranges of ``per_range`` frames; every k-th frame is kept where it is read."""
    import pandas as pd

    rows = []
    for path in paths:
        with opened(path) as file:
            n = KINDS[suffix(path)][0](file).n_frames
        rows += [(path, lo, min(n, lo + per_range)) for lo in range(0, n, per_range)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, lo, hi in batch.itertuples(index=False):
                layout_of, frames_of = KINDS[suffix(path)]
                with opened(path) as file:
                    layout = layout_of(file)
                    step, out = max(1, (8 << 20) // max(1, layout.size)), []
                    for a in range(lo, hi, step):
                        file.seek(layout.first + a * layout.size)
                        raw = file.read((min(hi, a + step) - a) * layout.size)
                        for k, (xyz, box, *when) in enumerate(frames_of(raw, layout), a):
                            if k % stride == 0:
                                time = when[0] if when and when[0] is not None else layout.start_ps + k * layout.step_ps
                                out.append((path, k // stride, time, xyz, box))
                        if out:
                            yield pd.DataFrame(out, columns=["path", "frame_idx", "time_ps", "xyz", "box"])
                            out = []

    held = spark.createDataFrame(rows, "path string, lo long, hi long") if rows else spark.createDataFrame([], "path string, lo long, hi long")
    return held.repartition(max(1, len(rows)), "path", "lo").mapInPandas(run, FRAMES)


# Text trajectories


def parse_mdcrd(lines: list[str], n_atoms: int, box: bool = False) -> list[tuple[list[float], list[float] | None]]:
    """Ten numbers of eight characters a line after a title; a frame begins a line."""
    out, at, need = [], 1, -(-3 * n_atoms // 10)
    while at + need <= len(lines):
        text = lines[at : at + need]
        values = [float(x[k : k + 8]) / 10 for x in text for k in range(0, len(x.rstrip()), 8)][: 3 * n_atoms]
        at += need
        size = None
        if box and at < len(lines):
            size, at = [float(lines[at][k : k + 8]) / 10 for k in (0, 8, 16)], at + 1
        out.append((values, size))
    return out


def parse_lammps(lines: list[str]) -> list[tuple[int, list[float], list[float]]]:
    """(time step, coordinates in order of the atoms' numbers, box lengths) of each frame; scaled coordinates are stretched."""
    out, at = [], 0
    while at < len(lines):
        if not lines[at].startswith("ITEM: TIMESTEP"):
            at += 1
            continue
        step, n = int(lines[at + 1]), int(lines[at + 3])
        bounds = [[float(v) for v in x.split()[:2]] for x in lines[at + 5 : at + 8]]
        names = lines[at + 8].split()[2:]
        rows = sorted((x.split() for x in lines[at + 9 : at + 9 + n]), key=lambda r: int(r[names.index("id")])) if "id" in names else [x.split() for x in lines[at + 9 : at + 9 + n]]
        xyz = []
        columns = [next((c for c in (a, f"{a}u", f"{a}s", f"{a}su") if c in names), None) for a in "xyz"]
        if None in columns:
            raise ValueError("no coordinates in the dump")
        for r in rows:
            for c, (lo, hi) in zip(columns, bounds, strict=True):
                v = float(r[names.index(c)])
                xyz.append((lo + v * (hi - lo) if "s" in c else v) / 10)
        out.append((step, xyz, [(hi - lo) / 10 for lo, hi in bounds]))
        at += 9 + n
    return out


# Topologies


def element_of(name: str) -> str:
    return name.lstrip("0123456789")[:1].upper()


def atom_rows(atoms: list[tuple[str, str, str, int, str]]) -> list[tuple]:
    """Rows of ``ATOMS`` without the path from (name, element, residue name, residue number, chain)."""
    from orrery.functions.names import code_of

    out, last, residue = [], None, -1
    for name, element, aaa, seqid, chain in atoms:
        if (chain, seqid, aaa) != last:
            last, residue = (chain, seqid, aaa), residue + 1
        out.append((len(out), name, element, residue, aaa, code_of(aaa), seqid, chain))
    return out


def parse_prmtop(lines: list[str]) -> list[tuple]:
    """Sections begin with %FLAG and carry the width of their fields in %FORMAT."""
    sections: dict[str, list[str]] = {}
    flag, width = "", 0
    for line in lines:
        if line.startswith("%FLAG"):
            flag = line.split()[1]
            sections[flag] = []
        elif line.startswith("%FORMAT"):
            width = int(re.search(r"[aIEF](\d+)", line, re.IGNORECASE)[1])
        elif not line.startswith("%") and flag:
            text = line.rstrip("\n")
            sections[flag] += [text[k : k + width].strip() for k in range(0, len(text.rstrip()), width)]
    names, labels = sections["ATOM_NAME"], sections["RESIDUE_LABEL"]
    starts = [int(x) - 1 for x in sections["RESIDUE_POINTER"]] + [len(names)]
    numbers = [int(x) for x in sections.get("ATOMIC_NUMBER", [])]
    symbol = lambda k: SYMBOLS[numbers[k] - 1] if k < len(numbers) and 0 < numbers[k] <= len(SYMBOLS) else element_of(names[k])
    return atom_rows([(names[k], symbol(k), label, r + 1, "") for r, label in enumerate(labels) for k in range(starts[r], starts[r + 1])])


def parse_psf(lines: list[str]) -> list[tuple]:
    at = next(k for k, x in enumerate(lines) if "!NATOM" in x)
    n, atoms = int(lines[at].split()[0]), []
    for line in lines[at + 1 : at + 1 + n]:
        _, segment, number, aaa, name, *_ = line.split()
        atoms.append((name, element_of(name), aaa, int(re.match(r"-?\d+", number)[0]), segment))
    return atom_rows(atoms)


def parse_mol2(lines: list[str]) -> tuple[list[tuple], list[float]]:
    """Atoms and coordinates (nm) of the first molecule."""
    at = next(k for k, x in enumerate(lines) if x.startswith("@<TRIPOS>ATOM")) + 1
    atoms, xyz = [], []
    while at < len(lines) and lines[at].strip() and not lines[at].startswith("@"):
        f = lines[at].split()
        xyz += [float(v) / 10 for v in f[2:5]]
        label = f[7] if len(f) > 7 else "UNL"
        atoms.append((f[1], f[5].split(".")[0], re.sub(r"-?\d+$", "", label) or label, int(f[6]) if len(f) > 6 else 1, ""))
        at += 1
    return atom_rows(atoms), xyz


TOPOLOGIES = {"prmtop": parse_prmtop, "parm7": parse_prmtop, "prm7": parse_prmtop, "psf": parse_psf, "mol2": lambda lines: parse_mol2(lines)[0]}


def read_topologies(spark: SparkSession, path: str | Sequence[str], kind: str) -> DataFrame:
    """Atoms (see ``ATOMS``) of topology files of one kind; ``pdb`` too."""
    if kind == "pdb":
        return read_pdb_atoms(spark, path)
    return _mapped(_files(spark, path, f"*.{kind}"), lambda p, lines: [(p, *a) for a in TOPOLOGIES[kind](lines)], ATOMS)


def read_lammps_frames(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return _mapped(_files(spark, path, "*.lammpstrj"), lambda p, lines: [(p, k, float(step), xyz, box) for k, (step, xyz, box) in enumerate(parse_lammps(lines))], FRAMES)


def read_mdcrd_frames(spark: SparkSession, path: str | Sequence[str], n_atoms: int, box: bool = False) -> DataFrame:
    return _mapped(_files(spark, path, "*.{mdcrd,crd}"), lambda p, lines: [(p, k, float(k), xyz, size) for k, (xyz, size) in enumerate(parse_mdcrd(lines, n_atoms, box))], FRAMES)


# Folders: a topology and the trajectories beside it


def paired(paths: Sequence[str]) -> list[tuple[str, list[str]]]:
    """(topology, its trajectories) of each folder: one topology a folder; a PDB alone is both."""
    folders: dict[str, tuple[list[str], list[str]]] = {}
    for path in sorted(paths):
        tops, trajs = folders.setdefault(path.rpartition("/")[0], ([], []))
        if suffix(path) in (*KINDS, "lammpstrj", "mdcrd", "crd", "xyz"):
            trajs.append(path)
        elif suffix(path) in (*TOPOLOGIES, "pdb"):
            tops.append(path)
    out = []
    for folder, (tops, trajs) in folders.items():
        if trajs and len(tops) != 1:
            raise ValueError(f"{folder}: {len(tops)} topologies for {len(trajs)} trajectories")
        out += [(tops[0], trajs)] if trajs else [(t, [t]) for t in tops]
    return out


def load(spark: SparkSession, folder: str, stride: int = 1, selection: str | None = None, concat: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All systems below a folder: (trajectories, atoms, frames).

    trajectories: traj_id, name (folder and file), n_frames, tags; atoms: traj_id and ``ATOMS``; frames:
    traj_id, frame_idx, time_ps, xyz, box. A selection of atoms (see ``operators.atoms``) holds for atoms
    and coordinates alike; ``concat`` joins a folder's trajectories into one.
    """
    from orrery.operators.atoms import sliced

    names = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path").collect()]
    pairs = paired(names)
    ids, frames, atoms = [], None, None
    for top, trajs in pairs:
        topology = read_topologies(spark, top, suffix(top)).drop("path")
        n_atoms = topology.count() if any(suffix(t) in ("mdcrd", "crd") for t in trajs) else 0
        first = len(ids)
        for k, path in enumerate(trajs):
            kind = suffix(path)
            if kind in KINDS:
                part = read_ranges(spark, [path], stride)
            else:
                part = {"lammpstrj": read_lammps_frames, "xyz": read_xyz_frames, "pdb": read_pdb_frames}.get(kind, lambda s, p: read_mdcrd_frames(s, p, n_atoms))(spark, path)  # noqa: B023
                part = part.where(F.col("frame_idx") % stride == 0).withColumn("frame_idx", F.floor(F.col("frame_idx") / stride))
            traj = first if concat else first + k
            part = part.select(F.lit(traj).alias("traj_id"), F.lit(k).alias("part"), "frame_idx", "time_ps", "xyz", "box")
            frames = part if frames is None else frames.unionByName(part)
            if not concat or k == 0:
                ids.append((traj, "/".join(path.removesuffix(".gz").rpartition(".")[0].split("/")[-2:])))
                held = topology.withColumn("traj_id", F.lit(traj))
                atoms = held if atoms is None else atoms.unionByName(held)
    if frames is None:
        raise ValueError(f"no trajectories below {folder}")
    if concat:
        order = Window.partitionBy("traj_id").orderBy("part", "frame_idx")
        frames = frames.withColumn("frame_idx", (F.row_number().over(order) - 1).cast("long"))
    frames = frames.drop("part")
    if selection is not None:
        atoms, frames = sliced(atoms, frames, selection)
    counts = frames.groupBy("traj_id").agg(F.count(F.lit(1)).cast("int").alias("n_frames"))
    dim = spark.createDataFrame(ids, "traj_id int, name string").join(counts, "traj_id").withColumn("tags", F.array().cast("array<string>"))
    return dim, atoms, frames
