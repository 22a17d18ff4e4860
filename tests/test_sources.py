import pytest
from orrery.operators import select
from orrery.plans.pipeline import Pipeline
from orrery.sources import store, structures
from orrery.streaming import transitions
from pyspark.sql import functions as F

ATOMS = [(0, "N", "N", 0, "ALA", "A", 1, "A"), (1, "CA", "C", 0, "ALA", "A", 1, "A"), (2, "N", "N", 1, "GLY", "G", 2, "A")]


def test_pdb_round_trip(spark, tmp_path):
    text = structures.pdb_text(ATOMS, [0.1 * k for k in range(9)], [0.0, 0.5, 1.0])
    (tmp_path / "a.pdb").write_text("MODEL 1\n" + text.replace("END\n", "ENDMDL\n") + "MODEL 2\n" + text)
    atoms = structures.read_pdb_atoms(spark, str(tmp_path)).orderBy("atom_idx").collect()
    assert [(r["name"], r["aaa_code"], r["seqid"], r["residue_index"]) for r in atoms] == [("N", "ALA", 1, 0), ("CA", "ALA", 1, 0), ("N", "GLY", 2, 1)]
    frames = structures.read_pdb_frames(spark, str(tmp_path))
    assert frames.count() == 2 and frames.first()["xyz"] == pytest.approx([0.1 * k for k in range(9)])
    numbered = structures.with_traj_ids(frames, 2, [2])
    assert numbered.count() == 1 and len(numbered.first()["xyz"]) == 3


def test_xyz(spark, tmp_path):
    (tmp_path / "t.xyz").write_text("2\nc\nC 1 2 3\nO 4 5 6\n2\nc\nC 1 2 3\nO 4 5 7\n")
    (tmp_path / "u.xyz").write_text("1\nc\nC 0 0 0\n")
    frames = structures.with_traj_ids(structures.read_xyz_frames(spark, str(tmp_path)))
    assert frames.count() == 3 and frames.where("traj_id = 0 and frame_idx = 1").first()["xyz"][5] == pytest.approx(0.7)
    assert sorted(r["frame_idx"] for r in structures.concatenated(frames).collect()) == [0, 1, 2]


def test_store_and_archive(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    store.save({"t": df}, f"file://{tmp_path}/s", {"k": [1]})
    tables, notes = store.load(spark, f"file://{tmp_path}/s")
    assert tables["t"].collect() == df.collect() and notes == {"k": [1]}
    (tmp_path / "s/plot.png").write_bytes(b"x")
    store.archive(f"{tmp_path}/s", f"{tmp_path}/s.tar.xz")
    store.extract(f"{tmp_path}/s.tar.xz", f"{tmp_path}/back")
    assert store.load(spark, f"file://{tmp_path}/back")[0]["t"].count() == 1 and not (tmp_path / "back/plot.png").exists()
    with pytest.raises(ValueError, match="compression"):
        store.archive(f"{tmp_path}/s", "x", "zip")


def test_pipeline(spark, tmp_path):
    from test_operators import dim, meta

    p = Pipeline(spark)
    p.add_trajectories(dim(spark))
    p.tag("all", ["x"])
    frames = spark.createDataFrame([(0, k, [float(k * f % 7) for f in range(10)]) for k in range(60)], "traj_id int, frame_idx long, features array<double>")
    p.add_feature("distances", frames, meta(spark))
    with pytest.raises(ValueError, match="exists"):
        p.add_feature("distances", frames)
    with pytest.raises(ValueError, match="needs"):
        p.add_feature("contacts", frames, needs=["other"])
    p.reduce("distances", "distances", "range", 1.0)
    assert p.reduction_summary("distances").first()["n_after"] == 8
    p.create_feature_selector("s")
    p.add_selection("s", "distances", "res ALA and not res GLY", use_reduced=True)
    matrix = p.matrix("s")
    assert matrix.count() == 60 and len(matrix.first()["features"]) == 4
    assert p.uneven("s").count() == 0
    for name, low in (("low", True), ("high", False)):
        p.create_data_selector(name)
        rows = frames.where((F.col("frame_idx") < 30) == low).select("traj_id", "frame_idx")
        p.update_data_selector(name, rows)
    assert p.matrix("s", "low").count() == 30
    p.decompose("d", matrix, "pca", components=2)
    p.cluster("c", matrix, "dbscan", eps=0.1, min_samples=2)
    assert p.membership("c").count() > 0 and p.landscape("d", bins=5).count() > 0 and p.centres("c", matrix).count() > 0
    p.compare("cmp", ["low", "high"], "binary")
    p.importance("imp", "cmp", matrix)
    assert p.top_features("imp", 2).count() == 2 and p.top_features("imp", 2, averaged=True).count() == 2
    p.register("halved", lambda df: df.withColumn("features", F.transform("features", lambda x: x / 2)))
    p.compute("halved", "distances", "half")
    p.save(f"file://{tmp_path}/p")
    again = Pipeline.load(spark, f"file://{tmp_path}/p")
    assert again.matrix("s").count() == 60 and set(again.features) == {"distances", "half"}
    p.remove_trajectories("tag:b")
    assert p.trajectories.count() == 2 and p.summary()["clusterings"] == ["c"]
    assert select.apply(frames, p.data_selectors["low"]).count() == 30


def test_streams(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:0{k}:00", float(v), "a" if k < 3 else "b") for k, v in enumerate([0, 5, 5, 0, 9])]
    spark.createDataFrame(rows, "traj_id long, ts string, value double, class string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("traj_id long, ts timestamp, value double, class string").parquet(f"{tmp_path}/in")

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    assert run(transitions.running_transitions(stream, 3.0), "update", "moves").first()["transitions"] == 3
    got = run(transitions.windowed_stats(stream, "2 minutes"), "complete", "stats")
    assert got.count() == 3 and got.agg(F.sum("n")).first()[0] == 5
    assert run(transitions.session_blocks(stream, "90 seconds"), "complete", "blocks").count() == 2


def test_late_rows_make_no_steps(spark, tmp_path):
    """A second batch with rows before the last one seen, and with nulls."""
    schema = "traj_id long, ts timestamp, value double"
    row = lambda m, v: (1, None if m is None else f"2024-01-01 00:{m:02d}:00", v)
    for k, rows in enumerate(([row(5, 1.0), row(0, 0.0), row(9, 9.0)], [row(7, 100.0), row(10, 9.5), row(12, 1.0), row(13, None), row(None, 5.0)])):
        df = spark.createDataFrame(rows, "traj_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        q = transitions.running_transitions(stream, 3.0).writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").start()
        q.processAllAvailable()
        q.stop()
        last = spark.read.parquet(f"{tmp_path}/out").orderBy(F.desc("n_frames")).first()
        assert (last["transitions"], last["n_frames"], last["late"]) == ((1, 3, 0), (2, 5, 1))[k]
