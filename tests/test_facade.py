import pytest
from orrery.operators import reduce, stats
from orrery.plans.facade import Analysis, Cluster, Reduce, Rmsd, Rmsf, Select, time_series
from orrery.plans.pipeline import Pipeline
from test_operators import meta


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(t, k, [float((k * f + t) % 7) for f in range(10)]) for t in (0, 1) for k in range(30)], "traj_id int, frame_idx long, features array<double>").cache()


def pipeline(spark, frames):
    p = Pipeline(spark)
    p.add_feature("distances", frames, meta(spark).unionByName(meta(spark, 1)))
    p.create_feature_selector("s")
    return p


def test_reductions_by_name(spark, frames):
    p = pipeline(spark, frames)
    for m in reduce.METRICS["distances"]:
        assert getattr(Reduce(p, "distances"), m)().count() == 20
    with pytest.raises(AttributeError):
        Reduce(p, "distances").frequency()
    kept = Select(p, "s", "distances").with_range_reduction("res ALA", least=1.0)
    assert {r["feature_idx"] for r in kept.collect()} == {1, 2, 3, 5, 9}
    assert p.matrix("s").count() == 60 and len(p.matrix("s").first()["features"]) == 5
    with pytest.raises(AttributeError):
        Select(p, "s", "distances").with_other_reduction()


def test_centres_by_name(spark, frames):
    p = pipeline(spark, frames)
    for k, c in enumerate(Cluster.CENTRES):
        assert getattr(Cluster(p, "dbscan"), f"with_{c}_centers")(f"c{k}", frames, eps=0.5, min_samples=2).count() > 0


def test_statistics_by_name(frames):
    a = Analysis(frames)
    for m in [*stats.LINEAR, "mad"]:
        assert getattr(a, f"compute_{m}")().count() == 10
    for m in stats.ROW:
        assert getattr(a, f"per_frame_{m}")().count() == 60
    assert Analysis(frames, periodic=True).compute_std().count() == 10 and Analysis(frames, periodic=True).per_frame_mean().count() == 60
    assert a.transitions_lagtime(1, 1.0).count() == 20 and a.transitions_window(3, 1.0).count() == 20
    assert a.stability(2, 1.0).count() == 20 and a.stability(3, 1.0, "window").count() == 20
    assert {r["difference"] for r in a.differences(frames).collect()} == {0.0}
    both = a.burial_fraction(3.0).join(a.exposure_fraction(2.9).withColumnRenamed("fraction", "above"), "feature_idx")
    assert all(r["fraction"] + r["above"] == pytest.approx(1) for r in both.collect())


def test_deviation_by_name(spark, frames):
    of = spark.createDataFrame([(k, k // 2) for k in range(3)], "atom int, residue int")
    for m in ("mean", "median", "mad"):
        one = getattr(Rmsd(frames), m)
        assert one.to_reference().count() == 60 and one.frame_to_frame(2).count() == 56
        assert one.window_frame_to_start(10).count() == 6 and one.window_frame_to_frame(10, 5, 2).count() == 10
        flu = getattr(Rmsf(frames), m)
        assert flu.to_mean_reference().count() == 6 and flu.to_median_reference(cross_trajectory=True).count() == 3
        for how in ("mean", "median", "rms", "rms_median"):
            assert flu.per_residue(of, how).to_mean_reference().count() == 4


def test_time_series(frames):
    assert time_series(frames, [1, 2]).count() == 120
    assert time_series(frames, [1], smooth=5).count() == 60 and time_series(frames, [1], smooth=5, order=3).count() == 60
