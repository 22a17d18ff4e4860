import struct

import numpy as np
import pytest
from orrery.operators import atoms as chosen
from orrery.sources import formats


def frames_of(n, k, seed=1):
    return np.random.default_rng(seed).uniform(-50, 50, (n, k, 3)).astype(np.float32)


def write_dcd(path, xyz, box=None, end="<"):
    n, k = xyz.shape[:2]
    rec = lambda b: struct.pack(f"{end}i", len(b)) + b + struct.pack(f"{end}i", len(b))
    control = [n, 0, 1, n, 0, 0, 0, 0, 0]
    head = b"CORD" + struct.pack(f"{end}9i", *control) + struct.pack(f"{end}f", 2.0) + struct.pack(f"{end}i", int(box is not None)) + struct.pack(f"{end}8i", *[0] * 8) + struct.pack(f"{end}i", 24)
    out = rec(head) + rec(struct.pack(f"{end}i", 1) + b"made by a test".ljust(80)) + rec(struct.pack(f"{end}i", k))
    for x in xyz:
        if box is not None:
            out += rec(struct.pack(f"{end}6d", box[0], 90, box[1], 90, 90, box[2]))
        out += b"".join(rec(x[:, c].astype(f"{end}f4").tobytes()) for c in range(3))
    path.write_bytes(out)


def write_netcdf(path, xyz, box, times, version=1):
    n, k = xyz.shape[:2]
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    dims = [("frame", 0), ("atom", k), ("spatial", 3), ("cell_spatial", 3)]
    variables = [("time", [0], 5, 4), ("coordinates", [0, 1, 2], 5, 12 * k), ("cell_lengths", [0, 3], 6, 24), ("label", [2], 2, 4)]
    attribute = struct.pack(">2i", 12, 1) + name("units") + struct.pack(">2i", 2, 5) + b"angst\0\0\0"

    def head(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">i", n) + struct.pack(">2i", 10, len(dims)) + b"".join(name(d) + struct.pack(">i", s) for d, s in dims) + struct.pack(">2i", 0, 0) + struct.pack(">2i", 11, len(variables))
        for (v, shape, kind, size), begin in zip(variables, begins, strict=True):
            out += name(v) + struct.pack(f">{len(shape) + 1}i", len(shape), *shape) + attribute + struct.pack(">2i", kind, size) + struct.pack(">i" if version == 1 else ">q", begin)
        return out

    start = len(head([0] * 4))
    at = start + 4
    begins = [at, at + 4, at + 4 + 12 * k, start]
    out = head(begins) + b"xyz\0"
    for x, t in zip(xyz, times, strict=True):
        out += struct.pack(">f", t) + x.astype(">f4").tobytes() + struct.pack(">3d", *box)
    path.write_bytes(out)


def check(rows, xyz, box):
    assert [r["frame_idx"] for r in rows] == list(range(len(xyz)))
    for r, x in zip(rows, xyz, strict=True):
        assert np.allclose(r["xyz"], x.ravel() / 10, atol=1e-4)
        assert r["box"] is None if box is None else np.allclose(r["box"], np.array(box) / 10, atol=1e-4)


@pytest.mark.parametrize(("end", "box"), [("<", None), ("<", [30.0, 40.0, 50.0]), (">", [30.0, 40.0, 50.0])])
def test_dcd_in_ranges(spark, tmp_path, end, box):
    xyz = frames_of(23, 7)
    write_dcd(tmp_path / "a.dcd", xyz, box, end)
    frames = formats.read_ranges(spark, [f"{tmp_path}/a.dcd"], per_range=5)
    assert frames.rdd.getNumPartitions() == 5
    check(frames.orderBy("frame_idx").collect(), xyz, box)
    check(formats.read_ranges(spark, [f"{tmp_path}/a.dcd"], stride=4, per_range=5).orderBy("frame_idx").collect(), xyz[::4], box)


@pytest.mark.parametrize("version", [1, 2])
def test_netcdf_in_ranges(spark, tmp_path, version):
    xyz = frames_of(12, 5, 2)
    write_netcdf(tmp_path / "a.nc", xyz, [20.0, 21.0, 22.0], [2.5 * k for k in range(12)], version)
    rows = formats.read_ranges(spark, [f"{tmp_path}/a.nc"], per_range=4).orderBy("frame_idx").collect()
    check(rows, xyz, [20.0, 21.0, 22.0])
    assert [r["time_ps"] for r in rows] == [2.5 * k for k in range(12)]
    (tmp_path / "b.nc").write_bytes(b"no such thing")
    with pytest.raises(ValueError, match="NetCDF"):
        formats.read_ranges(spark, [f"{tmp_path}/b.nc"])


def test_text_trajectories(spark, tmp_path):
    xyz = frames_of(3, 4, 3)
    lines = ["title"]
    for x in xyz:
        v = [f"{q:8.3f}" for q in x.ravel()]
        lines += ["".join(v[:10]), "".join(v[10:]), f"{30.0:8.3f}{31.0:8.3f}{32.0:8.3f}"]
    (tmp_path / "a.mdcrd").write_text("\n".join(lines) + "\n")
    got = formats.read_mdcrd_frames(spark, str(tmp_path), 4, box=True).orderBy("frame_idx").collect()
    assert len(got) == 3 and all(np.allclose(r["xyz"], x.ravel() / 10, atol=1e-3) and np.allclose(r["box"], [3.0, 3.1, 3.2]) for r, x in zip(got, xyz, strict=True))
    dump = ""
    for k, x in enumerate(xyz):
        rows = "".join(f"{i + 1} 1 {(x[i, 0] + 50) / 100} {(x[i, 1] + 50) / 100} {(x[i, 2] + 50) / 100}\n" for i in (2, 0, 3, 1))
        dump += f"ITEM: TIMESTEP\n{100 * k}\nITEM: NUMBER OF ATOMS\n4\nITEM: BOX BOUNDS pp pp pp\n-50 50\n-50 50\n-50 50\nITEM: ATOMS id type xs ys zs\n{rows}"
    (tmp_path / "a.lammpstrj").write_text(dump)
    got = formats.read_lammps_frames(spark, str(tmp_path)).orderBy("frame_idx").collect()
    assert [r["time_ps"] for r in got] == [0, 100, 200] and all(np.allclose(r["xyz"], x.ravel() / 10, atol=1e-3) for r, x in zip(got, xyz, strict=True))


PRMTOP = """%VERSION  VERSION_STAMP = V0001.000
%FLAG ATOM_NAME
%FORMAT(20a4)
N   CA  C   O   O   H1  H2
%FLAG ATOMIC_NUMBER
%FORMAT(10I8)
       7       6       6       8       8       1       1
%FLAG RESIDUE_LABEL
%FORMAT(20a4)
ALA WAT
%FLAG RESIDUE_POINTER
%FORMAT(10I8)
       1       5
"""
PSF = """PSF

       1 !NTITLE
 REMARKS made by a test

       3 !NATOM
       1 PROA 10   SEP  N    NH3  -0.3  14.007  0
       2 PROA 10   SEP  CA   CT1   0.2  12.011  0
       3 PROA 11   GLY  N    NH1  -0.4  14.007  0
"""
MOL2 = "@<TRIPOS>MOLECULE\nx\n2 0\n@<TRIPOS>ATOM\n1 CA 1.0 2.0 3.0 C.3 5 GLY5 0.0\n2 N 4.0 5.0 6.0 N.am 6 ALA6 0.0\n@<TRIPOS>BOND\n"


def test_topologies(spark, tmp_path):
    for name, text in (("a.prmtop", PRMTOP), ("b.psf", PSF), ("c.mol2", MOL2)):
        (tmp_path / name).write_text(text)
    get = lambda kind: [tuple(r)[1:] for r in formats.read_topologies(spark, str(tmp_path), kind).orderBy("atom_idx").collect()]
    top = get("prmtop")
    assert [(a[1], a[2], a[3], a[4]) for a in top] == [("N", "N", 0, "ALA"), ("CA", "C", 0, "ALA"), ("C", "C", 0, "ALA"), ("O", "O", 0, "ALA"), ("O", "O", 1, "WAT"), ("H1", "H", 1, "WAT"), ("H2", "H", 1, "WAT")]
    assert [(a[1], a[4], a[5], a[6], a[7]) for a in get("psf")] == [("N", "SEP", "S", 10, "PROA"), ("CA", "SEP", "S", 10, "PROA"), ("N", "GLY", "G", 11, "PROA")]
    assert [(a[1], a[2], a[4], a[6]) for a in get("mol2")] == [("CA", "C", "GLY", 5), ("N", "N", "ALA", 6)]


def test_folders_of_systems(spark, tmp_path):
    for system in ("one", "two"):
        (tmp_path / system).mkdir()
        (tmp_path / system / "top.prmtop").write_text(PRMTOP)
    x, y, z = frames_of(6, 7, 4), frames_of(4, 7, 5), frames_of(5, 7, 6)
    write_dcd(tmp_path / "one" / "a.dcd", x)
    write_dcd(tmp_path / "one" / "b.dcd", y)
    write_netcdf(tmp_path / "two" / "c.nc", z, [20.0] * 3, range(5))
    dim, atoms, frames = formats.load(spark, str(tmp_path))
    assert [(r["traj_id"], r["name"], r["n_frames"]) for r in dim.orderBy("traj_id").collect()] == [(0, "one/a", 6), (1, "one/b", 4), (2, "two/c", 5)]
    assert atoms.count() == 21 and frames.count() == 15
    dim, atoms, frames = formats.load(spark, str(tmp_path), stride=2, selection="protein and name CA", concat=True)
    assert [(r["traj_id"], r["n_frames"]) for r in dim.orderBy("traj_id").collect()] == [(0, 5), (1, 3)]
    assert [(r["traj_id"], r["atom_idx"], r["name"]) for r in atoms.orderBy("traj_id").collect()] == [(0, 0, "CA"), (1, 0, "CA")]
    got = [r["xyz"] for r in frames.where("traj_id = 0").orderBy("frame_idx").collect()]
    assert np.allclose(got, np.concatenate([x[::2, 1], y[::2, 1]]) / 10, atol=1e-4)
    (tmp_path / "one" / "other.psf").write_text(PSF)
    with pytest.raises(ValueError, match="2 topologies"):
        formats.load(spark, str(tmp_path))


def test_atom_language(spark):
    rows = [(0, k, n, e, r, a, s, c) for k, (n, e, r, a, s, c) in enumerate([("N", "N", 0, "ALA", 5, "A"), ("CA", "C", 0, "ALA", 5, "A"), ("CB", "C", 0, "ALA", 5, "A"), ("HA", "H", 0, "ALA", 5, "A"), ("CA", "C", 1, "GLY", 6, "B"), ("O", "O", 2, "HOH", 7, "W"), ("NA", "NA", 3, "NA", 8, "W")])]
    atoms = spark.createDataFrame(rows, "traj_id int, atom_idx int, name string, element string, residue_index int, aaa_code string, seqid int, chain string")
    get = lambda s: [r["atom_idx"] for r in chosen.select(atoms, s).orderBy("atom_idx").collect()]
    assert get("all") == list(range(7)) and get("none") == [] and get("protein") == [0, 1, 2, 3, 4] and get("water") == [5]
    assert get("backbone") == [0, 1, 4] and get("sidechain") == [2] and get("hydrogen") == [3]
    assert get("name CA CB and resname ALA") == [1, 2] and get("name CA and not (chain B or chain W)") == [1]
    assert get("resSeq 6 to 7") == [4, 5] and get("index 0 2 to 3 6") == [0, 2, 3, 6] and get("index < 2 or resid >= 3") == [0, 1, 6]
    assert get("name == CA") == [1, 4] and get("element != C") == [0, 3, 5, 6] and get("protein or water and name O") == [0, 1, 2, 3, 4, 5]
    for bad in ("", "name", "nothing here", "(protein", "protein)", "and name CA"):
        with pytest.raises(ValueError, match=r"\w"):
            get(bad)
    frames = spark.createDataFrame([(0, 0, [float(k) for k in range(21)])], "traj_id int, frame_idx int, xyz array<double>")
    a, f = chosen.without_solvent(atoms, frames)
    assert [r["name"] for r in a.orderBy("atom_idx").collect()] == ["N", "CA", "CB", "HA", "CA"] and f.first()["xyz"] == [float(k) for k in range(15)]
    a, f = chosen.sliced(atoms, frames, "name CA")
    assert [r["atom_idx"] for r in a.orderBy("atom_idx").collect()] == [0, 1] and f.first()["xyz"] == [3.0, 4.0, 5.0, 12.0, 13.0, 14.0]
