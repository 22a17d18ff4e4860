import numpy as np
import pytest
from orrery import model
from orrery.functions import colors, encode, names
from orrery.operators import cluster, compare, decompose, features, language, plotdata, reduce, select, stats, structure, windows
from pyspark.sql import functions as F


def floats(*x):
    return [float(v) for v in x]


def long_of(spark, series):
    return spark.createDataFrame([(t, k, 0, float(v)) for t, vs in series.items() for k, v in enumerate(vs)], "traj_id int, frame_idx long, feature_idx int, value double")


def test_long_and_array(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [3.0, 4.0])], "traj_id int, frame_idx int, features array<double>")
    assert sorted(map(tuple, model.to_array(model.to_long(df)).collect())) == sorted(map(tuple, df.collect()))


def test_population_statistics_and_percentiles(spark):
    x = [1.0, 2.0, 4.0, 9.0]
    r = stats.aggregate(long_of(spark, {0: x}), ["feature_idx"], ["std", "variance", "q25", "median", "mad", "cv", "iqr"]).first()
    assert r["std"] == pytest.approx(np.std(x)) and r["variance"] == pytest.approx(np.var(x))
    assert r["q25"] == np.percentile(x, 25) and r["median"] == 3.0 and r["mad"] == np.median(np.abs(np.array(x) - 3))
    assert r["cv"] == pytest.approx(np.std(x) / (np.mean(x) + 1e-10))
    assert stats.aggregate_with(long_of(spark, {0: x}), ["feature_idx"], np.ptp).first()["result"] == 8.0


def test_quantiles_by_selection(spark):
    r = np.random.default_rng(0)
    series = {0: r.normal(size=500), 1: np.repeat([1.0, 2.0, 2.0, 5.0], 50), 2: [7.0], 3: r.exponential(size=301) ** 4}
    got = {(x["traj_id"], x["p"]): x["quantile"] for x in stats.quantiles(long_of(spark, series), ["traj_id"], [0, 0.25, 0.5, 0.99, 1], bins=16).collect()}
    assert got == {(t, p): pytest.approx(np.quantile(v, p)) for t, v in series.items() for p in (0, 0.25, 0.5, 0.99, 1)}


def test_transition_thresholds(spark):
    x = long_of(spark, {0: [0, 2, 2, 0, 30, 60.5], 1: [5]})
    got = {r["traj_id"]: (r["transitions"], r["n_frames"]) for r in windows.transitions_lag(x, 1, 2.0).collect()}
    assert got == {0: (4, 6), 1: (0, 1)}
    strict = {r["traj_id"]: r["transitions"] for r in windows.transitions_lag(x, 1, 30.0, periodic=True).collect()}
    assert strict == {0: 1, 1: 0}
    assert {r["traj_id"]: r["stability"] for r in windows.stability(windows.transitions_lag(x, 1, 2.0), 1).collect()} == {0: pytest.approx(0.2), 1: None}


def test_angles_wrap(spark):
    x = long_of(spark, {0: [179, -179, 179]})
    assert windows.transitions_lag(x, 1, 5.0, periodic=True).first()["transitions"] == 0
    r = stats.aggregate(x, ["feature_idx"], ["mean", "range"], periodic=True).first()
    assert abs(abs(r["mean"]) - 179.67) < 0.01 and r["range"] == pytest.approx(2.0)


def test_window_transitions_range_and_steps(spark):
    x = long_of(spark, {0: [0, 1, 2, 3, 4]})
    assert windows.transitions_window(x, 3, 2.0).first()["transitions"] == 3
    assert windows.transitions_window(x, 3, 1.5, periodic=True).first()["transitions"] == 0


@pytest.mark.parametrize("block", [3, 7, 100])
def test_blocks_of_frames_change_nothing(spark, block):
    r = np.random.default_rng(2)
    x = long_of(spark, {t: r.integers(0, 6, n) * 40.0 for t, n in enumerate([1, 2, 23, 40])})
    c = x.withColumn("class", F.col("value").cast("string"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    for lag in (1, 4):
        assert rows(windows.transitions_lag(x, lag, 80.0)) == rows(windows.transitions_lag(x, lag, 80.0, block=block))
        assert rows(windows.class_transitions(c, lag=lag)) == rows(windows.class_transitions(c, lag=lag, block=block))
    for size in (2, 5):
        for periodic in (False, True):
            assert rows(windows.transitions_window(x, size, 80.0, periodic=periodic)) == rows(windows.transitions_window(x, size, 80.0, periodic=periodic, block=block))
        assert rows(windows.moving_average(x, size)) == rows(windows.moving_average(x, size, block=block))


def test_moving_average_pads_with_zero(spark):
    x = long_of(spark, {0: [3, 3, 3, 3]})
    got = [r["smoothed"] for r in windows.moving_average(x, 3).orderBy("frame_idx").collect()]
    assert got == [2.0, 3.0, 3.0, 2.0] == list(np.convolve([3, 3, 3, 3], np.ones(3) / 3, mode="same").round(9))


def test_savitzky_golay_keeps_cubics(spark):
    y = [0.1 * k**3 - k for k in range(12)]
    got = [r["smoothed"] for r in windows.savitzky_golay(long_of(spark, {0: y}), 7, 3).orderBy("frame_idx").collect()]
    assert np.allclose(got, y)
    assert windows.smoothing_width(5, 9) == 3 and windows.smoothing_width(20, 8) == 7


def test_blocks(spark):
    rows = spark.createDataFrame([(0, k, c) for k, c in enumerate("aabbba")], "traj_id int, frame_idx long, class string")
    got = sorted((r["start"], r["end"], r["label"]) for r in windows.label_blocks(rows).collect())
    assert got == [(0, 1, "a"), (2, 4, "b"), (5, 5, "a")]


def test_rmsd_shift(spark):
    frames = spark.createDataFrame([(0, i, [float(i)] * 6) for i in range(6)], "traj_id int, frame_idx int, features array<double>")
    got = [r["rmsd"] for r in windows.rmsd_to_reference(frames, 0, 0).orderBy("frame_idx").collect()]
    assert np.allclose(got, [i * 3**0.5 for i in range(6)])
    assert windows.frame_to_frame(frames, 2).count() == 4
    by_window = [r["rmsd"] for r in windows.window_rmsd(frames, 3).orderBy("window").collect()]
    assert np.allclose(by_window, [1.5 * 3**0.5] * 2)
    assert windows.window_rmsd(frames, 4, 1, 1).count() == 3
    assert np.allclose([r["rmsd"] for r in windows.window_rmsd(frames, 4, 1, 1, "mad").collect()], 0)


def test_stride_is_a_gap(spark):
    rows = spark.createDataFrame([(0, k) for k in (0, 1, 4, 5, 9, 10)], "traj_id int, frame_idx long")
    assert sorted(r["frame_idx"] for r in windows.stride_gap(rows, 4).collect()) == [0, 4, 9]
    assert [r["frame_idx"] for r in windows.slice_frames(rows, 5, 2, 2).orderBy("frame_idx").collect()] == [0, 4]


def dim(spark):
    return spark.createDataFrame([(0, "wild-type_1", 5, ["folded", "a"]), (1, "mutant_2", 5, ["unfolded"]), (2, "mutant_10", 3, ["folded", "b"])], "traj_id int, name string, n_frames int, tags array<string>")


@pytest.mark.parametrize(("selector", "want"), [("all", {0, 1, 2}), (1, {1}), ("0-1", {0, 1}), ("0,2", {0, 2}), ("mutant_*", {1, 2}), ("regex _1", {0, 2}), ("tag:folded", {0, 2}), (["tag:b", 0], {0, 2}), ("wild-type*", {0})])
def test_trajectory_selectors(spark, selector, want):
    assert {r["traj_id"] for r in select.trajectories(dim(spark), selector).collect()} == want


def test_frame_sets(spark):
    frames = spark.createDataFrame([(t, k) for t in range(3) for k in range(5)], "traj_id int, frame_idx long")
    a = select.by_tags(frames, dim(spark), ["folded", "b"])
    assert {r["traj_id"] for r in a.collect()} == {2}
    assert {r["traj_id"] for r in select.by_tags(frames, dim(spark), ["a", "b"], match_all=False).collect()} == {0, 2}
    b = select.by_indices(frames, dim(spark), {"all": "0-1", 2: {"frames": "all", "stride": 2}})
    assert b.count() == 2 * 2 + 4
    assert select.update(b, a, "subtract").count() == 4 and select.update(b, a, "intersect").count() == 4
    with pytest.raises(ValueError, match="mode"):
        select.update(a, b, "xor")
    with pytest.raises(ValueError, match="noise"):
        select.by_cluster(frames, [-1])
    assert select.out_of_range(frames, dim(spark)).count() == 2
    assert select.join_trajectories(frames.where("traj_id = 0"), frames.where("traj_id = 1")).agg(F.max("frame_idx")).first()[0] == 9


RESIDUES = [("ALA", "A", 0, 1, "1.50"), ("GLY", "G", 1, 2, "2.50"), ("VAL", "V", 2, 3, "3.50"), ("ALA", "A", 3, 4, "3.51"), ("LEU", "L", 4, 5, None)]


def meta(spark, traj=0, skip=()):
    one = lambda r: ((r[0], r[1], r[2], r[3], r[4], f"{r[0]}{r[3]}" + (f"x{r[4]}" if r[4] else "")), None, f"{r[0]}{r[3]}")
    rows = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    return spark.createDataFrame([("distances", traj, k, [one(RESIDUES[i]), one(RESIDUES[j])]) for k, (i, j) in enumerate(rows) if k not in skip], model.SCHEMAS["feature_meta"])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("all", set(range(10))), ("res ALA", {0, 1, 2, 3, 5, 7, 9}), ("res A", {0, 1, 2, 3, 5, 7, 9}), ("res ALA4", {2, 5, 7, 9}), ("seqid 1-2", {0, 1, 2, 3, 4, 5, 6}), ("resid 0", {0, 1, 2, 3}),
        ("res GLY and res LEU", {0, 3, 4, 5, 6, 8, 9}), ("res ALA and not res GLY", {1, 2, 3, 7, 9}), ("not res ALA", {4, 6, 8}), ("consensus 3.5", {1, 2, 4, 5, 7, 8, 9}), ("consensus all 3.5", {7}), ("leu", {3, 6, 8, 9}), ("5", {3, 6, 8, 9}),
    ],
)
def test_language(spark, text, want):
    assert {r["feature_idx"] for r in language.select_features(meta(spark), text).collect()} == want


def test_language_errors_and_identities(spark):
    with pytest.raises(ValueError):
        language.condition("seqid")
    assert {r["feature_idx"] for r in language.select_features(meta(spark), "res ALA", require_all=True).collect()} == {2}
    both = meta(spark).unionByName(meta(spark, 1, skip={0, 4}))
    assert {r["feature_idx"] for r in select.common_identities(both).collect()} == set(range(10)) - {0, 4}
    assert language.names_of(meta(spark)).orderBy("feature_idx").first()["feature_name"] == "ALA1-GLY2"


def test_reduce(spark):
    x = spark.createDataFrame([(t, k, f, float(v)) for t in (0, 1) for f, vs in enumerate([[1, 1, 1], [1, 5, 9], [2, 2, 8 * t + 2]]) for k, v in enumerate(vs)], "traj_id int, frame_idx long, feature_idx int, value double")
    kept = reduce.reduce_features(x, "distances", "range", 4.0)
    assert sorted((r["traj_id"], r["feature_idx"]) for r in kept.collect()) == [(0, 1), (1, 1), (1, 2)]
    assert sorted((r["traj_id"], r["feature_idx"]) for r in reduce.reduce_features(x, "distances", "range", 4.0, cross_trajectory=True).collect()) == [(0, 1), (1, 1)]
    assert [r["retention"] for r in reduce.summary(x, kept).orderBy("traj_id").collect()] == [pytest.approx(1 / 3), pytest.approx(2 / 3)]
    for kind, metrics in reduce.METRICS.items():
        source = x.withColumn("value", F.col("value").cast("string")) if kind == "dssp" else x
        for m in metrics:
            assert reduce.metric_of(source, kind, m).columns == ["traj_id", "feature_idx", "metric_value"]
            assert reduce.metric_of(source, kind, m).count() == 6
    with pytest.raises(ValueError, match="no metric"):
        reduce.metric_of(x, "contacts", "cv")


def test_distances_and_contacts(spark):
    frames = spark.createDataFrame([(0, 0, floats(0, 0, 0, 0.3, 0, 0, 0.3, 0.4, 0), None), (0, 1, floats(0, 0, 0, 0.9, 0, 0, 0, 0, 0), [1.0, 1.0, 1.0])], "traj_id int, frame_idx int, xyz array<double>, box array<double>")
    d = features.distances(frames, [([0], [1]), ([0], [2]), ([0], [1, 2])])
    assert np.allclose(d.orderBy("frame_idx").first()["features"], [3, 5, 3])
    assert features.contacts(d, 3.0).orderBy("frame_idx").first()["features"] == [True, False, True]
    assert features.distances(frames.where("frame_idx = 1"), [([0], [1])], periodic=True).first()["features"][0] == pytest.approx(1.0)


def test_pairs_skip_neighbours_in_the_chain(spark):
    residues = spark.createDataFrame([(0, k, s) for k, s in enumerate([1, 2, 3, 10, 11])], "traj_id int, index int, seqid int")
    assert features.residue_pairs(residues).count() == 10
    got = {(r["i"], r["j"]) for r in features.residue_pairs(residues, 1).collect()}
    assert got == {(0, 2), (0, 3), (0, 4), (1, 3), (1, 4), (2, 3), (2, 4)}


def test_superpose_centre_and_torsion(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((8, 3))
    turn, _ = np.linalg.qr(r.standard_normal((3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    frames = spark.createDataFrame([(0, 0, x.ravel().tolist()), (0, 1, (x @ turn + 5).ravel().tolist())], "traj_id int, frame_idx int, xyz array<double>")
    got = np.array(features.superpose(frames, x.ravel()).where("frame_idx = 1").first()["xyz"]).reshape(-1, 3)
    assert np.allclose(got, x)
    assert np.allclose(np.array(features.centre(frames).where("frame_idx = 1").first()["xyz"]).reshape(-1, 3).mean(0), 0, atol=1e-6)
    quad = spark.createDataFrame([(0, 0, floats(1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1, 1))], "traj_id int, frame_idx int, xyz array<double>")
    assert abs(features.torsions(quad, [(0, 1, 2, 3)]).first()["features"][0]) == pytest.approx(90)
    atoms = [(k, n, k // 4) for k, n in enumerate(["N", "CA", "C", "O"] * 3)]
    assert [n for n, _, _ in features.torsion_quads(atoms)] == ["phi", "phi", "psi", "psi", "omega", "omega"]


def test_surface(spark):
    frames = spark.createDataFrame([(0, 0, floats(0, 0, 0)), (0, 1, floats(0, 0, 0))], "traj_id int, frame_idx int, xyz array<double>")
    assert features.sasa(frames, ["C"]).first()["features"][0] == pytest.approx(4 * np.pi * 0.31**2)
    two = spark.createDataFrame([(0, 0, floats(0, 0, 0, 0.2, 0, 0))], "traj_id int, frame_idx int, xyz array<double>")
    assert sum(features.sasa(two, ["C", "C"], [0, 0]).first()["features"]) < 2 * 4 * np.pi * 0.31**2


def test_helix_is_found():
    def place(a, b, c, length, angle, torsion):
        angle, torsion = np.radians(angle), np.radians(torsion)
        bc = (c - b) / np.linalg.norm(c - b)
        n = np.cross(b - a, bc)
        n /= np.linalg.norm(n)
        return c + length * (-np.cos(angle) * bc + np.sin(angle) * np.cos(torsion) * np.cross(n, bc) + np.sin(angle) * np.sin(torsion) * n)

    at = [np.array([0.0, 0, 0]), np.array([0.146, 0, 0]), np.array([0.2, 0.14, 0])]
    for _ in range(13):
        at.append(place(*at[-3:], 0.133, 116, -47))
        at.append(place(*at[-3:], 0.146, 122, 180))
        at.append(place(*at[-3:], 0.153, 111, -57))
    n, ca, c = (np.array(at[k::3]) for k in range(3))
    o = np.array([place(at[3 * i], at[3 * i + 1], at[3 * i + 2], 0.123, 120.5, -47 + 180) for i in range(len(c))])
    found = features.secondary_structure(n, ca, c, o)
    assert found.count("H") >= 6


def test_encodings(spark):
    df = spark.createDataFrame([("H",), ("E",), ("?",), (None,)], "c string")
    got = [(r[0], r[1], r[2]) for r in df.select(encode.integer(F.col("c"), encode.SIMPLE), encode.onehot(F.col("c"), encode.SIMPLE), encode.simplified(F.col("c"))).collect()]
    assert [g[0] for g in got] == [0, 1, 0, 0] and got[1][1] == [0.0, 1.0, 0.0, 0.0] and [g[2] for g in got] == ["H", "E", "C", "NA"]
    hot = spark.createDataFrame([(floats(1, 0, 0, 0, 0, 0, 1, 0),)], "v array<double>")
    assert hot.select(encode.from_onehot(F.col("v"), 4)).first()[0] == [0, 2] and hot.select(encode.is_onehot(F.col("v"), 4)).first()[0]
    assert colors.mixed(["#ff0000", "#0000ff"]) == "#800080" and len(set(colors.distinct(5))) == 5 and names.cluster_number("cluster_12") == 12


def test_pca_and_kernels(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((200, 3)) @ np.diag([5.0, 1.0, 0.1])
    frames = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "traj_id int, frame_idx long, features array<double>")
    p = decompose.Pca(frames, 2)
    assert np.allclose(p.values, np.linalg.eigvalsh(np.cov(x.T))[::-1])
    comps = np.array([r["comps"] for r in p.transform(frames).collect()])
    assert np.allclose(comps.std(0, ddof=1), 1) and abs(comps.mean()) < 1e-9
    k = decompose.centred(decompose.kernel(x, x, 0.1))
    scores = np.array([r["comps"] for r in decompose.kernel_pca(frames, 2, 0.1).orderBy("frame_idx").collect()])
    assert np.allclose((scores**2).sum(0), np.linalg.eigvalsh(k)[::-1][:2])
    assert decompose.kernel_pca(frames, 2, landmarks=50).count() == 200
    with pytest.raises(ValueError, match="0 and 1"):
        decompose.contact_kernel_pca(frames, 2)
    assert decompose.elbow([10, 5, 2, 1, 0.9, 0.8, 0.7, 0.6]) in (2, 3, 4)
    assert decompose.diffusion_maps(frames, 2).count() == 200 and decompose.diffusion_maps(frames, 2, landmarks=60).count() == 200


def test_kernels_of_many_frames_as_of_few(spark, monkeypatch):
    from orrery.operators import blocks

    r = np.random.default_rng(4)
    x = r.standard_normal((300, 6)) @ np.diag([3.0, 2.0, 1.4, 1.0, 0.5, 0.2])
    frames = spark.createDataFrame([(i % 2, i // 2, v.tolist()) for i, v in enumerate(x)], "traj_id int, frame_idx long, features array<double>")
    few = {}
    for exact in (4000, 100):
        monkeypatch.setattr(decompose, "EXACT", exact)
        monkeypatch.setattr(blocks, "ROWS", 128)
        for name, run in (("kernel", decompose.kernel_pca), ("diffusion", decompose.diffusion_maps)):
            got = np.array([r["comps"] for r in run(frames, 3).orderBy("traj_id", "frame_idx").collect()])
            assert np.allclose(few.setdefault(name, got), got, atol=1e-6 * np.abs(got).max())


def blobs(n=40):
    r = np.random.default_rng(1)
    return np.concatenate([r.normal(c, 0.1, (n, 2)) for c in ([0, 0], [3, 3], [0, 4])] + [[[10.0, -10.0]]])


@pytest.mark.parametrize(("method", "options"), [("dbscan", {"eps": 0.4, "min_samples": 4}), ("hdbscan", {"min_cluster_size": 8}), ("dpa", {"z": 2.0})])
def test_clusters(spark, method, options):
    x = blobs()
    labels = cluster.METHODS[method](x, **options)
    groups = [set(labels[40 * k : 40 * k + 40].tolist()) for k in range(3)]
    assert all(len(g - {-1}) == 1 for g in groups) and len(set.union(*groups) - {-1}) == 3
    if method != "dpa":
        assert labels[-1] == -1
    frames = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "traj_id int, frame_idx long, features array<double>")
    assert cluster.cluster(frames, method, sample=90, **options).count() == len(x)


def test_dbscan_over_all_rows(spark, monkeypatch):
    from orrery.operators import blocks

    monkeypatch.setattr(blocks, "ROWS", 64)
    r = np.random.default_rng(2)
    x = np.concatenate([np.stack([np.linspace(0, 6, 150), np.zeros(150)], 1), r.normal(3, 0.4, (150, 2)), r.uniform(-5, 9, (100, 2)), np.full((20, 2), 20.0)])
    x = x[r.permutation(len(x))]
    rows = [(i % 2, i // 2, v.tolist()) for i, v in enumerate(x)]
    frames = spark.createDataFrame(rows, "traj_id int, frame_idx long, features array<double>")
    got = {(r[0], r[1]): r[2] for r in cluster.cluster(frames, "dbscan", eps=0.3, min_samples=5).collect()}
    rows.sort()
    want = cluster.dbscan(np.array([v for _, _, v in rows]), 0.3, 5)
    assert [got[t, f] for t, f, _ in rows] == want.tolist() and (want == -1).sum() > 20 and want.max() > 1


@pytest.mark.parametrize(("method", "options"), [("dbscan", {"eps": 0.4, "min_samples": 4}), ("hdbscan", {"min_cluster_size": 8})])
def test_noise_of_more_than_5000_rows(spark, method, options):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 0.5, (5300, 2)), r.normal(8, 0.1, (12, 2)), [[30.0 + 5 * k, -30.0] for k in range(6)]])
    frames = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "traj_id int, frame_idx long, features array<double>")
    labels = np.array([r["label"] for r in cluster.cluster(frames, method, **options).orderBy("frame_idx").collect()])
    assert len(set(labels[5300:5312])) == 1 and labels[5300] >= 0 and labels[5300] not in labels[:5300] and (labels[5312:] == -1).all()


def test_centres(spark):
    x = blobs()
    frames = spark.createDataFrame([(0, i, v.tolist(), min(i // 40, 2) if i < 120 else -1) for i, v in enumerate(x)], "traj_id int, frame_idx long, features array<double>, label int")
    means = {r["label"]: r["centre"] for r in cluster.centres(frames, "mean").collect()}
    assert set(means) == {0, 1, 2} and np.allclose(means[1], x[40:80].mean(0))
    for m in ("centroid", "median_centroid", "rmsd_centroid", "density_peak"):
        assert cluster.centres(frames, m).count() == 3
    at = cluster.centres(frames, "centroid").where("label = 0").first()["frame_idx"]
    assert at == ((x[:40] - x[:40].mean(0)) ** 2).sum(1).argmin()
    assert cluster.counts(frames).first().asDict() == {"n_clusters": 3, "n_noise": 1, "n_frames": 121}
    assert cluster.silhouette(frames).first()[0] > 0.8
    assert cluster.silhouette(frames.where("label = 0")).first()[0] is None


def test_density_peaks_correction_and_neighbours():
    import inspect

    assert inspect.signature(cluster.density_peaks).parameters["k_max"].default == 1000
    # Shells that grow (density falls outwards): the density at the point is above k over the volume.
    shells = np.concatenate([[0.0], np.cumsum(np.exp(0.02 * np.arange(1, 101)))])
    got = cluster.corrected(shells[None] / shells[-1], np.array([100]), 1.0)[0]
    assert got == pytest.approx(np.log(shells[-1]), abs=0.05) and got > np.log(100) + 0.5
    even = cluster.corrected(np.linspace(0, 1, 101)[None], np.array([100]), 1.0)[0]
    assert even == pytest.approx(np.log(100))


def test_density_peak_centre_of_all_members(spark):
    r = np.random.default_rng(3)
    x, label = r.standard_normal((2600, 3)), np.repeat([0, 1, 2], [2500, 95, 5])
    frames = spark.createDataFrame([(0, i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "traj_id int, frame_idx long, features array<double>, label int")
    got = {r["label"]: r["frame_idx"] for r in cluster.density_peak_centres(frames).collect()}
    for c in (0, 1):
        at = np.flatnonzero(label == c)
        d = cluster.pair_distances(x[at], x[at])
        assert got[c] == at[(d <= np.median(np.sort(d, axis=1)[:, 7]) * (1 + 1e-12)).sum(1).argmax()]
    assert got[2] == 2595 + ((x[2595:] - x[2595:].mean(0)) ** 2).sum(1).argmin()


def test_tree():
    r = np.random.default_rng(0)
    x = r.standard_normal((300, 4))
    y = ((x[:, 1] > 0.3) & (x[:, 2] < 0.5)).astype(int)
    tree = compare.Tree(max_depth=3).fit(x, y)
    assert tree.importance.sum() == pytest.approx(1) and tree.importance[[1, 2]].sum() > 0.95
    report = tree.report(x, y)
    assert report["accuracy"] == 1.0 and report["leaves"] == 3
    with pytest.raises(ValueError, match="NaN"):
        compare.Tree().fit(np.array([[np.nan]]), np.array([0]))


def test_comparisons():
    assert [n for n, _ in compare.sub_comparisons("abc", "pairwise")] == ["a_vs_b", "a_vs_c", "b_vs_c"]
    with pytest.raises(ValueError, match="two selectors"):
        compare.sub_comparisons("abc", "binary")
    assert compare.sample_size(10) == 10 and compare.sample_size(10**6) == 100_000
    assert compare.contacts_as_distances([{"feature_type": "contacts", "selection": "all"}]) == [{"feature_type": "distances", "selection": "all"}]


def test_overlapping_groups_stand_on_both_sides(spark):
    s = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("b", 0, 2), ("b", 0, 2)], "selector string, traj_id int, frame_idx int")
    assert compare.comparison_rows(s, ["a", "b"], "binary").count() == 3


def test_drawing_tables(spark):
    pts = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (1.0, 1.0), (0.4, 0.9)], "x double, y double")
    cells = {(r["bx"], r["by"]): r["p"] for r in plotdata.histogram(pts, 2).collect()}
    assert cells == {(0, 0): 0.25, (1, 1): 0.5, (0, 1): 0.25}
    energy = plotdata.energy(plotdata.histogram(pts, 2))
    assert energy.agg(F.min("energy")).first()[0] == 0
    assert plotdata.energy_range(energy).first()["high"] > 0
    total = plotdata.density(long_of(spark, {0: np.random.default_rng(0).normal(size=200)}), 200).agg(F.sum("density"), F.min("x"), F.max("x")).first()
    assert total[0] * (total[2] - total[1]) / 199 == pytest.approx(1, abs=0.05)
    assert plotdata.dimension_pairs([0, 1, 2]) == [(0, 1), (1, 2)]
    assert plotdata.tag_map(dim(spark), ["folded"]).count() == 3


def test_residue_importance_and_beta(spark):
    scores = spark.createDataFrame([(0, 0.5), (9, 0.25)], "feature_idx int, score double")
    got = {r["residue"]: r["importance"] for r in structure.residue_importance(scores, meta(spark)).collect()}
    assert got == {0: 0.5, 1: 0.5, 3: 0.25, 4: 0.25}
    atoms = spark.createDataFrame([(k, k // 2) for k in range(10)], "atom_idx int, residue_index int")
    beta = {r["atom_idx"]: r["beta"] for r in structure.beta_factors(structure.residue_importance(scores, meta(spark)), atoms).collect()}
    assert beta[0] == 1.0 and beta[4] == 0.0 and beta[8] == 0.5
    assert structure.residue_features(scores, meta(spark)).where("shared").count() == 0
    assert "spectrum b" in structure.pymol_script("a.pdb", [(3, "#ff0000")])


def test_long_frames_take_linear_time(spark):
    """3081 values a frame, as 1027 atoms have: statistics and deviations within a row are one pass."""
    import time

    r = np.random.default_rng(3)
    x = r.standard_normal((40, 3081))
    df = spark.createDataFrame([(0, k, v.tolist()) for k, v in enumerate(x)], "traj_id int, frame_idx int, features array<double>").cache()
    df.count()
    began = time.perf_counter()
    got = {q["frame_idx"]: q for q in stats.per_frame(df, ["std", "variance", "mad", "median"]).collect()}
    rmsd = {m: {q["frame_idx"]: q["rmsd"] for q in windows.rmsd_to_reference(df, 0, 0, m).collect()} for m in ("mean", "median", "mad")}
    assert time.perf_counter() - began < 20
    d = np.sqrt(((x - x[0]).reshape(40, -1, 3) ** 2).sum(2))
    for k in (1, 17, 39):
        assert np.isclose(got[k]["std"], x[k].std()) and np.isclose(got[k]["variance"], x[k].var())
        assert np.isclose(got[k]["median"], np.median(x[k])) and np.isclose(got[k]["mad"], np.median(abs(x[k] - np.median(x[k]))))
        assert np.isclose(rmsd["mean"][k], np.sqrt((d[k] ** 2).mean())) and np.isclose(rmsd["median"][k], np.sqrt(np.median(d[k] ** 2)))
        assert np.isclose(rmsd["mad"][k], np.median(abs(d[k] - np.median(d[k]))))


def test_distances_of_many_pairs(spark):
    r = np.random.default_rng(5)
    x = r.random((6, 90, 3)) * 3
    groups = [list(range(3 * k, 3 * k + 3)) for k in range(30)]
    pairs = [(groups[i], groups[j]) for i in range(30) for j in range(i + 1, 30)]
    df = spark.createDataFrame([(0, k, v.ravel().tolist(), [3.0, 3.0, 3.0]) for k, v in enumerate(x)], "traj_id int, frame_idx int, xyz array<double>, box array<double>")
    for periodic in (False, True):
        for q in features.distances(df, pairs, periodic).collect():
            d = x[q["frame_idx"]][:, None] - x[q["frame_idx"]][None]
            d -= 3.0 * np.round(d / 3.0) if periodic else 0
            d = np.sqrt((d**2).sum(2))
            want = [10 * min(d[a, b] for a in i for b in j) for i, j in pairs]
            assert np.allclose(q["features"], want, atol=1e-4)


def test_a_trajectory_that_keeps_nothing(spark):
    rows = [(t, f, i, float(f * (i == 0) * (t + 1))) for t in (0, 1) for f in range(6) for i in (0, 1)]
    x = spark.createDataFrame([(t, f, i, 0.0 if t == 1 else v) for t, f, i, v in rows], "traj_id int, frame_idx int, feature_idx int, value double")
    assert [q["feature_idx"] for q in reduce.reduce_features(x, "distances", "range", 1.0).collect()] == [0]
    assert reduce.reduce_features(x, "distances", "range", 1.0, cross_trajectory=True).count() == 0


def test_reduction_modes_and_own_metrics(spark):
    from pyspark.sql import functions as F

    v = [0, 0, 0, 5, 5, 5, 0, 0, 9, 9, 9, 9]
    x = spark.createDataFrame([(0, k, 0, float(y)) for k, y in enumerate(v)], "traj_id int, frame_idx int, feature_idx int, value double")
    count = lambda **o: reduce.metric_of(x, "distances", "transitions", **o).first()["metric_value"]
    assert count() == sum(max(v[k : k + 10]) - min(v[k : k + 10]) >= 2 for k in range(3))
    assert count(window=3) == sum(max(v[k : k + 3]) - min(v[k : k + 3]) >= 2 for k in range(10))
    assert count(mode="lagtime") == 3 and count(mode="lagtime", lag=2) == sum(abs(a - b) >= 2 for a, b in zip(v, v[2:], strict=False))
    assert reduce.metric_of(x, "distances", lambda c: F.max(c) - F.avg(c)).first()["metric_value"] == 9 - sum(v) / 12
    with pytest.raises(ValueError, match="mode"):
        count(mode="other")


def test_statistics_of_ones_own(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0, 4.0]), (0, 1, [3.0, 3.0, 3.0])], "traj_id int, frame_idx int, features array<double>")
    assert [q["result"] for q in stats.per_frame_with(df, np.ptp).orderBy("frame_idx").collect()] == [3.0, 0.0]
    a = spark.createDataFrame([(0, "H"), (0, "H"), (0, "E"), (1, "C")], "feature_idx int, class string")
    b = spark.createDataFrame([(0, "H"), (0, "C")], "feature_idx int, class string")
    got = {(q["feature_idx"], q["class"]): q["difference"] for q in stats.class_differences(a, b).collect()}
    assert np.isclose(got[0, "H"], 2 / 3 - 1 / 2) and np.isclose(got[0, "E"], 1 / 3) and got[0, "C"] == -0.5 and got[1, "C"] == 1.0
    x = spark.createDataFrame([(0, 4.0), (0, 6.0)], "feature_idx int, value double")
    assert stats.differences(x, x.withColumn("value", x["value"] * 2), before=lambda t: t.withColumn("value", t["value"] + 1)).first()["difference"] == -5.0


def test_trees_reports_and_representatives(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((90, 4))
    y = (x[:, 2] > 0.3).astype(int)
    rows = [("a_vs_b", int(c), 0, k, v.tolist()) for k, (c, v) in enumerate(zip(y, x, strict=True))]
    data = spark.createDataFrame(rows, "sub_comparison string, y int, traj_id int, frame_idx int, features array<double>")
    trees = compare.tree_importance(data, max_depth=3)
    report = trees.reports.first()
    assert report["accuracy"] == 1.0 and report["rows"] == 90 and report["leaves"] == 2 and report["depth"] == 1
    assert [(c["class"], c["support"], c["f1"]) for c in report["classes"]] == [(0, int((y == 0).sum()), 1.0), (1, int((y == 1).sum()), 1.0)]
    root, low, high = sorted(trees.nodes.collect(), key=lambda n: n["id"])
    assert (root["feature"], root["left"], root["right"]) == (2, low["id"], high["id"]) and root["counts"] == [float((y == 0).sum()), float((y == 1).sum())]
    assert low["feature"] == -1 and low["left"] is None and trees.scores.where("score > 0").first()["feature_idx"] == 2
    best = compare.representatives(model.to_long(data.select("traj_id", "frame_idx", "features")), trees, "a_vs_b", 1).first()
    assert best["frame_idx"] == int(np.argmin(np.abs(x[:, 2] - root["threshold"])))
    big = compare.Tree(6).fit(x, r.integers(0, 3, 90))
    slow = []
    for row in x:
        node = big.nodes[0]
        while node["feature"] >= 0:
            node = big.nodes[node["left"] if row[node["feature"]] <= node["threshold"] else node["right"]]
        slow.append(int(np.argmax(node["counts"])))
    assert big.predict(x).tolist() == slow


def test_pipeline_keeps_comparisons(spark, tmp_path):
    from orrery.plans.pipeline import Pipeline

    p = Pipeline(spark)
    frames = spark.createDataFrame([(0, k, [float(k % 3), float(k)]) for k in range(40)], "traj_id int, frame_idx long, features array<double>")
    p.add_feature("x", frames)
    for name, low in (("a", True), ("b", False)):
        p.create_data_selector(name, frames.where("frame_idx < 20" if low else "frame_idx >= 20").select("traj_id", "frame_idx"))
    p.compare("c", ["a", "b"], "binary")
    p.importance("i", "c", frames)
    p.save(f"file://{tmp_path}/p")
    q = Pipeline.load(spark, f"file://{tmp_path}/p")
    assert q.comparisons["c"]["mode"] == "binary" and q.comparisons["c"]["rows"].count() == 40
    assert q.top_features("i", 1).first()["feature_idx"] == 1 and q.importances["i"].nodes.count() == 3
    assert q.importances["i"].reports.first()["accuracy"] == 1.0


def test_consensus_ranges_by_trajectory(spark):
    part = lambda seqid, label: {"residue": {"seqid": seqid, "consensus": label, "aaa_code": "ALA", "a_code": "A", "index": seqid}}
    rows = [(t, k, [part(10 * t + k, label)]) for t in (0, 1) for k, label in enumerate(["1.50", None, "2.50", "3.50" if t == 0 else None, None, "4.50"])]
    meta = spark.createDataFrame(rows, "traj_id int, feature_idx int, partners array<struct<residue:struct<seqid:int,consensus:string,aaa_code:string,a_code:string,index:int>>>")
    get = lambda s: [(r["traj_id"], r["feature_idx"]) for r in language.select_features(meta, s).orderBy("traj_id", "feature_idx").collect()]
    assert get("consensus 1.50-3.50") == [(0, 0), (0, 2), (0, 3), (1, 0), (1, 2)]
    assert get("consensus all 2.50-3.50") == [(0, 2), (0, 3), (1, 2), (1, 3), (1, 4), (1, 5)]
    assert get("consensus 9.50-8.50") == []


def test_kernels_of_pairs_meet_in_blocks(spark, monkeypatch):
    from orrery.operators import blocks

    monkeypatch.setattr(blocks, "ROWS", 16)
    monkeypatch.setattr(blocks, "TILE", 8)
    x = np.random.default_rng(3).standard_normal((50, 4))
    frames = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "traj_id int, frame_idx long, features array<double>")
    k = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2))
    for form, want in (("plain", k), ("centred", decompose.centred(k)), ("transition", k / k.sum(1, keepdims=True))):
        table = decompose.kernel_long(frames, 0.5, form=form)
        assert "FlatMapGroupsInPandas" in table._jdf.queryExecution().toString() and "CartesianProduct" not in table._jdf.queryExecution().toString()
        got = {(r["a"], r["b"]): r["k"] for r in table.collect()}
        assert len(got) == 2500 and np.allclose([[got[i, j] for j in range(50)] for i in range(50)], want, atol=1e-12)


def test_residue_pairs_are_numbered_without_a_sort(spark, monkeypatch):
    monkeypatch.setattr(features, "CHAIN", 4)
    r = np.random.default_rng(5)
    seqids = np.cumsum(r.choice([-1, 1, 1, 1, 4], 23)).tolist()
    seqids[6] = None
    rows = [(t, 10 * k, s) for t in (0, 1) for k, s in enumerate(seqids[: 23 - 6 * t])]
    found = features.residue_pairs(spark.createDataFrame(rows, "traj_id int, index int, seqid int"), 2)
    assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()
    for t in (0, 1):
        own, segment, want = [s for u, _, s in rows if u == t], [], []
        for k, s in enumerate(own):
            step = None if not k or s is None or own[k - 1] is None else abs(s - own[k - 1])
            segment.append((segment[-1] if k else 0) + (step not in (None, 1)))
        for i in range(len(own)):
            for j in range(i + 1, len(own)):
                near = segment[i] == segment[j] and (own[i] is None or own[j] is None or abs(own[i] - own[j]) <= 2)
                want += [] if near else [(len(want), 10 * i, 10 * j)]
        assert sorted((x["feature_idx"], x["i"], x["j"]) for x in found.collect() if x["traj_id"] == t) == want


def test_percentiles_of_large_groups_from_counts(spark, monkeypatch):
    x = np.random.default_rng(6).standard_normal(900).round(2)
    long = spark.createDataFrame([(k % 3 if k % 3 else None, float(v)) for k, v in enumerate(x)], "g int, value double")
    metrics = ["mean", "median", "iqr", "q75", "range"]
    few = {r["g"]: r for r in stats.aggregate(long, ["g"], metrics).collect()}
    monkeypatch.setattr(stats, "LARGE", 100)
    many = stats.aggregate(long, ["g"], metrics)
    assert many._jdf.queryExecution().optimizedPlan().toString().count("percentile(") == 1
    rows = {r["g"]: r for r in many.collect()}
    assert many.columns == ["g", *metrics] and set(rows) == {None, 1, 2}
    assert all(rows[g][m] == pytest.approx(few[g][m], abs=1e-12) for g in rows for m in metrics)


def test_windows_order_keys_and_not_frames(spark):
    x = np.random.default_rng(7).standard_normal((40, 6))
    frames = spark.createDataFrame([(i % 2, i // 2, v.tolist()) for i, v in enumerate(x)], "traj_id int, frame_idx long, features array<double>")
    found = windows.window_rmsd(frames, 5, 5, 1, "mad")
    assert "sum(_c" in found._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        own = x[r["traj_id"] :: 2][5 * r["window"] : 5 * r["window"] + 5].reshape(5, 2, 3)
        d = np.sqrt(((own[1:] - own[:-1]) ** 2).sum(2))
        d = np.median(np.abs(d - np.median(d, axis=1, keepdims=True)), axis=1)
        assert r["rmsd"] == pytest.approx(np.median(np.abs(d - np.median(d))))
