"""More queries: what the pipeline and its methods by name give, and variants of the operators in ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery import model
from orrery.functions import encode
from orrery.operators import compare, features, language, plotdata, reduce, stats, structure, windows
from orrery.plans.catalog import _ANGLE, _ATOMS, _META, _PAIRS, _PT, _SEL, _VM, EL, EV, VF, XF, _angles, _meta, _pairs, _points, _scalar, _selectors, _sq, _vector_meta, el, ev, query, r, rounded, vf, xyz
from orrery.plans.facade import Analysis, Reduce, Rmsd, Rmsf, Select
from orrery.plans.pipeline import Pipeline

# Selectors with a reduction of their own, for each metric of each type; clusters of ``embeddings`` stand for trajectories

#: What stands for a type's values, in Spark and in SQL.
_VALUES = {
    "distances": (lambda x: x * 20 + 30, "value * 20 + 30"),
    "coordinates": (lambda x: x * 20 + 5, "value * 20 + 5"),
    "sasa": (lambda x: x * 2 + 0.3, "value * 2 + 0.3"),
    "torsions": (lambda x: x * 400, "value * 400"),
    "contacts": (lambda x: (x > 0).cast("double"), "(value > 0)::INT::DOUBLE"),
    "dssp": (lambda x: F.when(x > 0.06, "H").when(x < -0.06, "E").otherwise("C"), "CASE WHEN value > 0.06 THEN 'H' WHEN value < -0.06 THEN 'E' ELSE 'C' END"),
}
_PLAIN = {
    "std": "stddev_pop(x)", "variance": "var_pop(x)", "range": "max(x) - min(x)", "min": "min(x)", "max": "max(x)", "mean": "avg(x)", "mad": "mad(x)", "cv": "stddev_pop(x) / (avg(x) + 1e-10)",
    "frequency": "avg(x)", "burial_fraction": "avg((x < 0.2)::INT)", "exposure_fraction": "avg((x > 0.2)::INT)",
}
_ROUND = {
    "mean": "degrees(atan2(s, c))", "variance": "1 - sqrt(s * s + c * c)", "std": "degrees(sqrt(-2 * ln(sqrt(s * s + c * c))))", "cv": "degrees(sqrt(-2 * ln(sqrt(s * s + c * c)))) / (abs(degrees(atan2(s, c))) + 1e-10)",
    "range": "CASE WHEN w > 180 THEN 360 - w ELSE w END",
}
#: type -> metric -> (least value, options)
_BOUNDS: dict[str, dict[str, tuple[float, dict]]] = {
    "distances": {"cv": (0.071, {}), "std": (2.139, {}), "variance": (4.576, {}), "range": (9.115, {}), "transitions": (8, {"threshold": 8.0}), "min": (22.929, {}), "mad": (1.335, {}), "mean": (29.527, {}), "max": (34.272, {})},
    "contacts": {"frequency": (0.407, {}), "stability": (0.4, {}), "transitions": (33, {})},
    "coordinates": {"std": (2.139, {}), "rmsf": (3.0, {}), "cv": (0.419, {}), "variance": (4.576, {}), "range": (9.115, {}), "mad": (1.335, {}), "mean": (4.527, {}), "min": (-2.071, {}), "max": (9.272, {}), "transitions": (8, {"threshold": 8.0})},
    "torsions": {"transitions": (10, {"threshold": 120.0}), "std": (42.785, {}), "mad": (26.709, {}), "mean": (-12.0, {}), "range": (95.0, {}), "min": (-141.427, {}), "max": (85.437, {}), "cv": (3.0, {}), "variance": (0.25, {})},
    "dssp": {"transitions": (33, {}), "transition_frequency": (0.6, {}), "stability": (0.25, {}), "class_frequencies": (0.38, {})},
    "sasa": {"cv": (0.68, {}), "range": (0.912, {}), "std": (0.214, {}), "variance": (0.046, {}), "mad": (0.134, {}), "mean": (0.253, {}), "min": (-0.407, {}), "max": (0.727, {}), "burial_fraction": (0.261, {}), "exposure_fraction": (0.56, {}), "transitions": (8, {"threshold": 0.8})},
}


def _metric_sql(kind: str, metric: str, options: dict) -> str:
    """m (t, i, m): the metric of feature i in trajectory t, from y (t, f, i, x)."""
    w = "(PARTITION BY t, i ORDER BY f"
    if metric == "transitions":
        if kind in ("torsions", "dssp"):
            hit = "x <> x0" if kind == "dssp" else f"abs((((x - x0 + 180) % 360) + 360) % 360 - 180) > {options.get('threshold', 30.0)}"
            return f"a AS (SELECT *, lag(x) OVER {w}) AS x0, row_number() OVER {w}) AS n FROM y), b AS (SELECT t, i, n, max(coalesce({hit}, FALSE)::INT) OVER (PARTITION BY t, i ORDER BY f ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS h FROM a), m AS (SELECT t, i, count(*) FILTER (n >= 10 AND h > 0) AS m FROM b GROUP BY t, i)"
        return f"a AS (SELECT t, i, row_number() OVER {w}) AS n, max(x) OVER v - min(x) OVER v AS g FROM y WINDOW v AS {w} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)), m AS (SELECT t, i, count(*) FILTER (n >= 10 AND g >= {options.get('threshold', 1.0)}) AS m FROM a GROUP BY t, i)"
    if metric in ("stability", "transition_frequency"):
        rate = "count(*) FILTER (h) / (count(*) - 1)"
        return f"a AS (SELECT t, i, x <> lag(x) OVER {w}) AS h FROM y), m AS (SELECT t, i, {'1 - ' if metric == 'stability' else ''}{rate} AS m FROM a GROUP BY t, i HAVING count(*) > 1)"
    if metric == "class_frequencies":
        return "a AS (SELECT t, i, x, count(*) AS n FROM y GROUP BY t, i, x), m AS (SELECT t, i, max(n) / sum(n) AS m FROM a GROUP BY t, i)"
    if metric == "rmsf":
        return "a AS (SELECT t, i, var_pop(x) AS v FROM y GROUP BY t, i), m AS (SELECT t, i, sqrt(sum(v) OVER (PARTITION BY t, i // 3)) AS m FROM a)"
    if kind == "torsions" and metric in _ROUND:
        return f"a AS (SELECT t, i, avg(sin(radians(x))) AS s, avg(cos(radians(x))) AS c, max(x) - min(x) AS w FROM y GROUP BY t, i), m AS (SELECT t, i, {_ROUND[metric]} AS m FROM a)"
    plain = "stddev_pop(x) / (abs(avg(x)) + 1e-10)" if (kind, metric) == ("coordinates", "cv") else _PLAIN[metric]
    return f"m AS (SELECT t, i, {plain} AS m FROM y GROUP BY t, i)"


def _clusters(s, d, kind: str) -> Pipeline:
    p = Pipeline(s)
    frames = vf(s, d).select(F.col("label").alias("traj_id"), "frame_idx", F.transform("features", _VALUES[kind][0]).alias("features"))
    p.add_feature("x", frames, _vector_meta(s, d).crossJoin(frames.select("traj_id").distinct()))
    return p


for _kind, _metrics in _BOUNDS.items():
    for _metric, (_least, _options) in _metrics.items():

        def _selected(s, d, kind=_kind, metric=_metric, least=_least, options=_options):
            p = _clusters(s, d, kind)
            for name in ("a", "b"):
                p.create_feature_selector(name)
            getattr(Select(p, "a", "x", kind), f"with_{metric}_reduction")("not res GLY", least=least, cross_trajectory=False, **options)
            # Another reduction of the same feature leaves the first selector as it is.
            getattr(Select(p, "b", "x", kind), f"with_{metric}_reduction")("res ALA", most=least, **options)
            return p.selected_features("a").select("traj_id", F.col("feature_idx").cast("long").alias("feature_idx"))

        def _reduced(s, d, kind=_kind, metric=_metric, least=_least, options=_options):
            return getattr(Reduce(_clusters(s, d, kind), "x", kind), metric)(least, cross_trajectory=True, **options).select("traj_id", F.col("feature_idx").cast("long").alias("feature_idx"))

        _y = f"y AS (SELECT label AS t, frame_idx AS f, feature_idx AS i, {_VALUES[_kind][1]} AS x FROM el JOIN vm USING (feature_idx) WHERE {{}})"
        _m_sql = _metric_sql(_kind, _metric, _options)
        query(f"WITH {EL}, {_VM}, {_y.format('''aaa <> 'GLY' ''')}, {_m_sql} SELECT t AS traj_id, i::BIGINT AS feature_idx FROM m WHERE m >= {_least}", f"select_with_{_kind}_{_metric}")(_selected)
        if _metric in ("transitions", "mad", "min", "max", "cv", "rmsf", "stability", "class_frequencies", "burial_fraction"):
            query(f"WITH {EL}, {_VM}, {_y.format('TRUE')}, {_m_sql}, k AS (SELECT t, i FROM m WHERE m >= {_least}) SELECT t AS traj_id, i::BIGINT AS feature_idx FROM k WHERE i IN (SELECT i FROM k GROUP BY i HAVING count(*) = (SELECT count(DISTINCT label) FROM embeddings))", f"reduce_named_{_kind}_{_metric}")(_reduced)


@query(f"WITH {EL}, k AS (SELECT label, feature_idx FROM el GROUP BY 1, 2 HAVING max(value) >= 0.46 OR label > 0) SELECT count(*) AS n FROM (SELECT feature_idx FROM k GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT label) FROM embeddings))")
def cross_trajectory_none_left(s, d):
    """A bound that leaves one trajectory nothing leaves nothing in common."""
    x = el(s, d).drop("traj_id").withColumnRenamed("label", "traj_id")
    x = x.withColumn("value", F.when(F.col("traj_id") > 0, 1.0).otherwise(F.col("value")))
    return reduce.reduce_features(x, "distances", "max", 0.46, cross_trajectory=True).agg(F.countDistinct("feature_idx").alias("n"))


@query(f"WITH {EL}, {_VM}, a AS (SELECT frame_idx, label, feature_idx, value FROM el JOIN vm USING (feature_idx) WHERE (aaa = 'ALA' OR seqid BETWEEN 1 AND 6) AND frame_idx % 3 = 0 AND label < 5) SELECT label AS traj_id, frame_idx, count(*) AS n, round(sum(value * (k + 1)), 6) AS checksum FROM (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY feature_idx) - 1 AS k FROM a) GROUP BY 1, 2")
def pipeline_matrix(s, d):
    """Chosen columns of chosen frames side by side, in order of the column."""
    p = Pipeline(s)
    frames = vf(s, d).select(F.col("label").alias("traj_id"), "frame_idx", "features")
    p.add_feature("x", frames, _vector_meta(s, d).crossJoin(frames.select("traj_id").distinct()))
    p.create_feature_selector("f")
    p.add_selection("f", "x", "res ALA and seqid 1-6")
    p.create_data_selector("g", frames.where("traj_id < 5").select("traj_id", "frame_idx"))
    p.update_data_selector("g", frames.where("frame_idx % 3 = 0").select("traj_id", "frame_idx"), "intersect")
    weighted = F.aggregate(F.transform("features", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return p.matrix("f", "g").select("traj_id", "frame_idx", F.size("features").cast("long").alias("n"), r(weighted).alias("checksum"))


for _name, _text, _where in (
    ("labelled", "consensus *2.4*-*4.4*", "seqid BETWEEN (SELECT min(seqid) FROM vm WHERE cons LIKE '%2.4%') AND (SELECT max(seqid) FROM vm WHERE cons LIKE '%4.4%') AND cons IS NOT NULL"),
    ("all", "consensus all 2.42-4.44", "seqid BETWEEN (SELECT seqid FROM vm WHERE cons = '2.42') AND (SELECT seqid FROM vm WHERE cons = '4.44')"),
    ("no_start", "consensus all 0.99-4.44", "seqid BETWEEN (SELECT max(seqid) FROM vm WHERE cons IS NOT NULL AND seqid < (SELECT seqid FROM vm WHERE cons = '4.44')) AND (SELECT seqid FROM vm WHERE cons = '4.44')"),
    ("no_end", "consensus all 4.44-9.99 and not res GLY", "seqid BETWEEN (SELECT seqid FROM vm WHERE cons = '4.44') AND (SELECT min(seqid) FROM vm WHERE cons IS NOT NULL AND seqid > (SELECT seqid FROM vm WHERE cons = '4.44')) AND aaa <> 'GLY'"),
):

    def _range(s, d, text=_text):
        return language.select_features(_vector_meta(s, d), text).select(F.col("feature_idx").cast("long").alias("feature_idx"))

    query(f"WITH {_VM} SELECT feature_idx::BIGINT AS feature_idx FROM vm WHERE {_where}", f"consensus_range_{_name}")(_range)


# Statistics


@query(f"""WITH {EL}, {_PAIRS}, s AS (SELECT i AS residue, feature_idx FROM p UNION ALL SELECT j, feature_idx FROM p),
v AS (SELECT residue, frame_idx, value FROM el JOIN s USING (feature_idx)), a AS (SELECT * FROM v UNION ALL SELECT DISTINCT residue, frame_idx, 0.0 FROM v)
SELECT residue, round(var_pop(value), 6) AS variance, round(max(value) - min(value), 6) AS range FROM a GROUP BY residue""")
def per_residue_spread(s, d):
    named = Analysis(vf(s, d).drop("label"))
    a, b = named.per_residue_variance(_pairs(s)), named.per_residue_range(_pairs(s))
    return rounded(a.join(b, "residue"), "variance", "range")


@query(f"""WITH {VF}, a AS (SELECT frame_idx, list_transform(v, lambda x: x * 400) AS x FROM vf),
m AS (SELECT frame_idx, x, list_avg(list_transform(x, lambda y: sin(radians(y)))) AS s, list_avg(list_transform(x, lambda y: cos(radians(y)))) AS c, list_max(x) - list_min(x) AS w FROM a)
SELECT frame_idx, round(degrees(sqrt(-2 * ln(sqrt(s * s + c * c)))), 5) AS std, round(list_min(x), 6) AS min, round(list_max(x), 6) AS max, round(list_median(list_transform(x, lambda y: abs(y - list_median(x)))), 6) AS mad, round(CASE WHEN w > 180 THEN 360 - w ELSE w END, 6) AS range FROM m""")
def circular_per_frame_spread(s, d):
    out = stats.per_frame_circular(vf(s, d).withColumn("features", F.transform("features", lambda x: x * 400)))
    return rounded(out.select("frame_idx", r("std", 5).alias("std"), "min", "max", "mad", "range"), "min", "max", "mad", "range")


@query(f"""WITH {EV}, m AS (SELECT traj_id, avg(sin(radians({_ANGLE}))) AS s, avg(cos(radians({_ANGLE}))) AS c FROM ev GROUP BY traj_id) SELECT traj_id, round({_ROUND['cv']}, 4) AS cv FROM m WHERE abs(degrees(atan2(s, c))) > 1""")
def circular_cv(s, d):
    out = stats.aggregate(_angles(s, d), ["traj_id"], ["cv", "mean"], periodic=True).where("abs(mean) > 1")
    return out.select("traj_id", r("cv", 4).alias("cv"))


@query(f"""WITH {EV}, a AS (SELECT traj_id, {_ANGLE} AS x, frame_idx FROM ev), b AS (SELECT traj_id, x - lag(x) OVER (PARTITION BY traj_id ORDER BY frame_idx) AS g FROM a),
c AS (SELECT traj_id, count(*) FILTER (abs((((g + 180) % 360) + 360) % 360 - 180) > 60) AS t, count(*) AS n FROM b GROUP BY traj_id) SELECT traj_id, round(CASE WHEN n > 1 THEN greatest(0, least(1, 1 - t / (n - 1))) ELSE 0 END, 6) AS stability FROM c WHERE n > 1""")
def circular_stability(s, d):
    counts = windows.transitions_lag(_angles(s, d), 1, 60.0, periodic=True).where("n_frames > 1")
    return windows.stability(counts, 1, periodic=True).select("traj_id", r("stability").alias("stability"))


@query(f"""WITH {EL}, m AS (SELECT feature_idx, label < 5 AS low, degrees(atan2(avg(sin(radians(value * 900))), avg(cos(radians(value * 900))))) AS m FROM el GROUP BY 1, 2)
SELECT a.feature_idx::BIGINT AS feature_idx, round((((a.m - b.m + 180) % 360) + 360) % 360 - 180, 5) AS difference FROM m a JOIN m b ON a.feature_idx = b.feature_idx AND a.low AND NOT b.low""")
def circular_differences(s, d):
    f = vf(s, d).withColumn("features", F.transform("features", lambda x: x * 900))
    out = Analysis(f.where("label < 5").drop("label"), periodic=True).differences(f.where("label >= 5").drop("label"))
    return out.select(F.col("feature_idx").cast("long").alias("feature_idx"), r("difference", 5).alias("difference"))


@query(f"WITH {EL} SELECT a.feature_idx::BIGINT AS feature_idx, round(((((a.value - b.value) * 900 + 180) % 360) + 360) % 360 - 180, 5) AS difference FROM el a JOIN el b USING (feature_idx) WHERE a.frame_idx = 3 AND b.frame_idx = 11")
def circular_frame_differences(s, d):
    x = el(s, d).withColumn("value", F.col("value") * 900)
    return stats.frame_differences(x, 3, 11, periodic=True).select(F.col("feature_idx").cast("long").alias("feature_idx"), r("difference", 5).alias("difference"))


@query(f"WITH {EV}, a AS (SELECT class, count(*) FILTER (traj_id % 2 = 0) / (SELECT count(*) FROM ev WHERE traj_id % 2 = 0) - count(*) FILTER (traj_id % 2 = 1) / (SELECT count(*) FROM ev WHERE traj_id % 2 = 1) AS x FROM ev GROUP BY class) SELECT class, round(x, 6) AS difference FROM a")
def class_differences(s, d):
    e = ev(s, d).withColumn("feature_idx", F.lit(0))
    return stats.class_differences(e.where("traj_id % 2 = 0"), e.where("traj_id % 2 = 1")).select("class", r("difference").alias("difference"))


@query(f"WITH {VF} SELECT frame_idx, round(list_max(v) - list_avg(v), 6) AS result FROM vf")
def frame_user_function(s, d):
    return rounded(stats.per_frame_with(vf(s, d), lambda x: x.max() - x.mean()).select("frame_idx", "result"), "result")


@query(f"WITH {EL} SELECT round(1.0 / count(DISTINCT feature_idx), 6) AS gamma FROM el")
def gamma_auto(s, d):
    return rounded(stats.gamma_auto(el(s, d)), "gamma")


# Deviation and fluctuation by name


def _window(s: str, lag: int | None, metric: str) -> str:
    """Windows of 8 frames every 4; each pair's value, then the window's, by the same metric."""
    value = {"mean": "sqrt(list_avg(s))", "median": "sqrt(list_median(s))", "mad": "list_median(list_transform(list_transform(s, lambda y: sqrt(y)), lambda x: abs(x - list_median(list_transform(s, lambda y: sqrt(y))))))"}[metric]
    join = "b.n = a.n + 1" if lag else "b.n = 4 * b.g AND a.n > b.n"
    return f"""WITH {XF}, n AS (SELECT v, row_number() OVER (ORDER BY frame_idx) - 1 AS n, count(*) OVER () AS t FROM vf), k AS (SELECT n.*, g FROM n, (SELECT unnest(range(0, (SELECT max(t) FROM n))) AS g) WHERE n >= 4 * g AND n < 4 * g + 8 AND 4 * g + 8 <= t),
q AS (SELECT a.g, {_sq('a.v', 'b.v')} AS s FROM k a JOIN k b ON a.g = b.g AND {join}), z AS (SELECT g, {value} AS d FROM q) SELECT g::BIGINT AS "window", round({ {'mean': 'avg(d)', 'median': 'quantile_cont(d, 0.5)', 'mad': 'mad(d)'}[metric]}, 6) AS rmsd FROM z GROUP BY g"""


for _metric in ("mean", "median", "mad"):
    for _lag in (None, 1):

        def _windowed(s, d, metric=_metric, lag=_lag):
            named = getattr(Rmsd(xyz(s, d)), metric)
            out = named.window_frame_to_start(8, 4) if lag is None else named.window_frame_to_frame(8, 4, lag)
            return out.select(F.col("window").cast("long").alias("window"), r("rmsd").alias("rmsd"))

        query(_window("", _lag, _metric), f"rmsd_{_metric}_window_frame_to_{'start' if _lag is None else 'frame'}")(_windowed)

    def _f2f(s, d, metric=_metric):
        return getattr(Rmsd(xyz(s, d)), metric).frame_to_frame(3).select("frame_idx", r("rmsd").alias("rmsd"))

    _value = {"mean": "sqrt(list_avg(s))", "median": "sqrt(list_median(s))", "mad": "list_median(list_transform(list_transform(s, lambda y: sqrt(y)), lambda x: abs(x - list_median(list_transform(s, lambda y: sqrt(y))))))"}[_metric]
    query(f"WITH {XF}, a AS (SELECT frame_idx, v, lead(v, 3) OVER (ORDER BY frame_idx) AS w FROM vf), q AS (SELECT frame_idx, {_sq('v', 'w')} AS s FROM a WHERE w IS NOT NULL) SELECT frame_idx, round({_value}, 6) AS rmsd FROM q", f"rmsd_{_metric}_frame_to_frame")(_f2f)

    _of = {"mean": "sqrt(avg(d))", "median": "sqrt(quantile_cont(d, 0.5))", "mad": "mad(sqrt(d))"}[_metric]
    for _reference in ("mean", "median"):

        def _per_residue(s, d, metric=_metric, reference=_reference):
            of = s.range(22).select(F.col("id").cast("int").alias("atom"), F.floor(F.col("id") / 3).alias("residue"))
            out = None
            for how in ("mean", "median", "rms", "rms_median"):
                named = getattr(Rmsf(xyz(s, d)), metric).per_residue(of, how)
                one = (named.to_mean_reference() if reference == "mean" else named.to_median_reference()).select(F.col("residue").cast("long").alias("residue"), r("rmsf").alias(how))
                out = one if out is None else out.join(one, "residue")
            return out

        _centre = "avg" if _reference == "mean" else "median"
        query(
            f"WITH {_ATOMS}, m AS (SELECT atom, {_centre}(x) AS x0, {_centre}(y) AS y0, {_centre}(z) AS z0 FROM ats GROUP BY atom), q AS (SELECT atom, (x-x0)**2 + (y-y0)**2 + (z-z0)**2 AS d FROM ats JOIN m USING (atom)), f AS (SELECT atom, {_of} AS f FROM q GROUP BY atom) SELECT (atom // 3)::BIGINT AS residue, round(avg(f), 6) AS mean, round(quantile_cont(f, 0.5), 6) AS median, round(sqrt(avg(f * f)), 6) AS rms, round(sqrt(quantile_cont(f * f, 0.5)), 6) AS rms_median FROM f GROUP BY 1",
            f"rmsf_{_metric}_per_residue_{_reference}_reference",
        )(_per_residue)


# Features


@query(f"WITH {_ATOMS}, m AS (SELECT a.frame_idx, a.atom // 3 AS i, b.atom // 3 AS j, min((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d FROM ats a JOIN ats b ON a.frame_idx = b.frame_idx AND a.atom // 3 < b.atom // 3 WHERE a.atom < 21 AND b.atom < 21 GROUP BY 1, 2, 3) SELECT frame_idx, (row_number() OVER (PARTITION BY frame_idx ORDER BY i, j) - 1)::BIGINT AS pair, round((sqrt(d) * 10)::FLOAT::DOUBLE, 3) AS distance FROM m")
def distances_of_groups(s, d):
    groups = [[3 * k, 3 * k + 1, 3 * k + 2] for k in range(7)]
    pairs = [(groups[i], groups[j]) for i in range(7) for j in range(i + 1, 7)]
    out = features.distances(xyz(s, d).withColumnRenamed("features", "xyz"), pairs)
    return out.select("frame_idx", F.posexplode("features").alias("pair", "distance")).select("frame_idx", F.col("pair").cast("long").alias("pair"), r("distance", 3).alias("distance"))


@query(f"WITH {_ATOMS}, m AS (SELECT frame_idx, avg(x) AS x0, avg(y) AS y0, avg(z) AS z0 FROM ats GROUP BY 1) SELECT frame_idx, atom::BIGINT AS atom, round((x - x0)::FLOAT::DOUBLE, 4) AS x, round((y - y0)::FLOAT::DOUBLE, 4) AS y, round((z - z0)::FLOAT::DOUBLE, 4) AS z FROM ats JOIN m USING (frame_idx)")
def centred_coordinates(s, d):
    out = features.centre(xyz(s, d).withColumnRenamed("features", "xyz")).withColumn("traj_id", F.lit(0))
    return structure.atoms_long(out, "xyz").select("frame_idx", F.col("atom").cast("long").alias("atom"), *[r(c, 4).alias(c) for c in "xyz"])


@query(f"WITH {_ATOMS} SELECT frame_idx, atom::BIGINT AS atom, round((x - 0.25 * floor(x / 0.25))::FLOAT::DOUBLE, 4) AS x, round((y - 0.5 * floor(y / 0.5))::FLOAT::DOUBLE, 4) AS y, round(z::FLOAT::DOUBLE, 4) AS z FROM ats")
def wrapped_coordinates(s, d):
    out = features.wrap(xyz(s, d).withColumnRenamed("features", "xyz").withColumn("box", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.0))))
    return structure.atoms_long(out, "xyz").select("frame_idx", F.col("atom").cast("long").alias("atom"), *[r(c, 4).alias(c) for c in "xyz"])


@query(f"WITH {EL} SELECT frame_idx, feature_idx::BIGINT AS feature_idx, round(sum(value) OVER (PARTITION BY feature_idx ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS value FROM el")
def smoothed_trajectory(s, d):
    out = model.to_long(windows.smooth_frames(vf(s, d), 5))
    return out.select("frame_idx", F.col("feature_idx").cast("long").alias("feature_idx"), r("value").alias("value"))


_CODES = "['H', 'B', 'E', 'G', 'I', 'T', 'S', 'C', 'NA']"


@query(f"SELECT vec_id AS frame_idx, CASE WHEN c IN ('H', 'G', 'I') THEN 'H' WHEN c IN ('E', 'B') THEN 'E' WHEN c = 'NA' THEN 'NA' ELSE 'C' END AS class, label % 9 AS code, TRUE AS is_onehot FROM (SELECT *, {_CODES}[label % 9 + 1] AS c FROM embeddings)")
def class_encodings(s, d):
    """Classes simplified, as numbers, and found again from one-hot form."""
    c = F.element_at(F.array(*[F.lit(x) for x in encode.FULL]), (F.col("label") % 9 + 1).cast("int"))
    x = vf(s, d).select("frame_idx", "label", c.alias("c")).withColumn("h", encode.onehot(F.col("c"), encode.FULL))
    return x.select("frame_idx", encode.simplified(F.col("c")).alias("class"), encode.from_onehot(F.col("h"), 9)[0].cast("long").alias("code"), encode.is_onehot(F.col("h"), 9).alias("is_onehot"))


@query(f"WITH {EV} SELECT traj_id, frame_idx, round(frame_idx * 2.5 / 1000, 9) AS x FROM ev")
def time_axis(s, d):
    return windows.x_values(ev(s, d).withColumn("time_ps", F.col("frame_idx") * 2.5), use_time=True).select("traj_id", "frame_idx", r("x", 9).alias("x"))


# Comparison data, names of ranked features, energies


@query(f"WITH {_SEL}, p(sub_comparison, selector, y) AS (VALUES ('c0_vs_c1','c0',0),('c0_vs_c1','c1',1),('c0_vs_c2','c0',0),('c0_vs_c2','c2',1),('c1_vs_c2','c1',0),('c1_vs_c2','c2',1)) SELECT sub_comparison, y, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 5) AS total FROM sel JOIN p USING (selector) JOIN embeddings e ON e.vec_id = sel.frame_idx GROUP BY 1, 2")
def comparison_matrices(s, d):
    rows = compare.comparison_rows(_selectors(s, d), ["c0", "c1", "c2"], "pairwise")
    x = compare.comparison_data(vf(s, d).drop("label"), rows)
    return x.groupBy("sub_comparison", "y").agg(F.count(F.lit(1)).alias("n"), r(F.sum(stats.array_sum(F.col("features"))), 5).alias("total"))


@query(f"WITH {_META} SELECT feature_idx, aaa1 || s1 || coalesce('x' || c1, '') || '-' || aaa2 || s2 || coalesce('x' || c2, '') AS feature_name, row_number() OVER (ORDER BY feature_idx % 7 DESC, feature_idx) AS rank FROM meta QUALIFY rank <= 12")
def top_feature_names(s, d):
    meta = _meta(s, d)
    scores = meta.select(F.lit("all").alias("sub_comparison"), "feature_idx", (F.col("feature_idx") % 7).cast("double").alias("score"))
    top = compare.top_features(scores, 12)
    return top.join(language.names_of(meta), "feature_idx").select("feature_idx", "feature_name", F.col("rank").cast("long").alias("rank"))


_KDE = f"""WITH {_PT}, s AS (SELECT count(*) AS n, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt),
g AS (SELECT s.*, i, j, x0 + (x1 - x0) * i / 9 AS gx, y0 + (y1 - y0) * j / 9 AS gy, n ** (-1.0 / 3) AS f, xx * yy - xy * xy AS det FROM s, range(10) a(i), range(10) b(j)),
k AS (SELECT i::INT AS i, j::INT AS j, sum(exp(-0.5 * (yy * (x - gx) ** 2 - 2 * xy * (x - gx) * (y - gy) + xx * (y - gy) ** 2) / det / f) / (n * 2 * pi() * sqrt(det) * f)) AS p FROM pt, g GROUP BY 1, 2),
e AS (SELECT i, j, -0.001987204 * 300 * ln(p / (SELECT max(p) FROM k)) + 0.0 AS energy FROM k)"""


@query(f"{_KDE} SELECT i, j, round(energy, 5) AS energy, round(CASE WHEN energy <= 2 THEN energy END, 5) AS low FROM e")
def kde_energy_landscape(s, d):
    """Energies of a smooth landscape, and the same with what lies above a bound left out."""
    cells = plotdata.energy(plotdata.density_2d(_points(s, d), 10), p="density").withColumn("energy", F.col("energy") + 0.0)
    low = plotdata.below(cells, 2.0).select("i", "j", F.col("energy").alias("low"))
    return rounded(cells.join(low, ["i", "j"]).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "energy", "low"), "energy", "low", n=5)


def _ts(s, d) -> DataFrame:
    return _scalar(s, d).select("traj_id", "frame_idx", F.array(F.col("value").cast("double")).alias("features"))


@query(f"WITH {EV} SELECT traj_id, frame_idx::DOUBLE AS x, round(sum(value) OVER (PARTITION BY traj_id ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3, 6) AS value FROM ev")
def time_series_smoothed(s, d):
    from orrery.plans.facade import time_series

    return rounded(time_series(_ts(s, d), [0], smooth=3).select("traj_id", "x", "value"), "value")
