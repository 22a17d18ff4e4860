"""Clustering of frames, cluster centres and quality.

Density methods need neighbours of all points. DBSCAN runs in tables, over pairs of
blocks of rows; the other two run on the driver over all rows, whose memory grows with
the rows (times neighbours) and whose time grows with their square. Only if a sample is
asked for do rows beyond it take the majority label of their nearest sampled neighbours,
in Arrow batches. Centres and counts are aggregates over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.blocks import block_pairs, blocks_of, components, kept, linked, matrix, merged_names, squares, tiles, within
from orrery.operators.decompose import rows_of
from orrery.operators.stats import percentile

NOISE = -1
#: Rows of a slice of distances to all rows.
STEP = 256
NO_LABEL = 2**31 - 1


def pair_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0))


def dbscan(x: np.ndarray, eps: float = 0.5, min_samples: int = 5) -> np.ndarray:
    """Clusters of connected cores, numbered by their first core; borders join the lowest-numbered one."""
    near = pair_distances(x, x) <= eps
    core = near.sum(1) >= min_samples
    labels = np.full(len(x), NOISE)
    k = 0
    for i in np.flatnonzero(core):
        if labels[i] != NOISE:
            continue
        front = [i]
        labels[i] = k
        while front:
            j = front.pop()
            for m in np.flatnonzero(near[j]):
                if labels[m] == NOISE:
                    labels[m] = k
                    if core[m]:
                        front.append(m)
        k += 1
    return labels


def hdbscan(x: np.ndarray, min_cluster_size: int = 5, min_samples: int | None = None, method: str = "eom") -> np.ndarray:
    """Hierarchical density clusters: spanning tree of mutual reachability, condensed, by excess of mass or leaves."""
    n = len(x)
    if n < 2:
        return np.full(n, NOISE)
    place, core = min(n - 1, (min_samples or min_cluster_size) - 1), np.empty(n)
    for k in range(0, n, STEP):
        core[k : k + STEP] = np.partition(pair_distances(x[k : k + STEP], x), place, axis=1)[:, place]
    # Rows not in the tree yet stay packed at the front, so a step reads them only.
    left, y, square, edges = np.arange(1, n), x[1:].copy(), (x[1:] ** 2).sum(1), []
    near, best, source, at = core[1:].copy(), np.full(n - 1, np.inf), np.zeros(n - 1, int), 0
    for m in range(n - 1, 0, -1):
        d = np.sqrt(np.maximum(square[:m] + (x[at] ** 2).sum() - 2 * (y[:m] @ x[at]), 0))
        reach = np.maximum(np.maximum(near[:m], core[at]), d)
        closer = reach < best[:m]
        best[:m][closer], source[:m][closer] = reach[closer], at
        least = np.flatnonzero(best[:m] == best[:m].min())
        k = least[left[least].argmin()]
        at = int(left[k])
        edges.append((best[k], source[k], at))
        for part in (left, y, square, near, best, source):
            part[k] = part[m - 1]
    edges.sort(key=lambda e: e[0])
    parent, size, children, height = list(range(2 * n - 1)), [1] * n, {}, {}

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for k, (w, a, b) in enumerate(edges):
        a, b, new = find(int(a)), find(int(b)), n + k
        parent[a] = parent[b] = new
        children[new], height[new] = (a, b), w
        size.append(size[a] + size[b])

    def members(node: int) -> list[int]:
        found, todo = [], [node]
        while todo:
            c = todo.pop()
            if c < n:
                found.append(c)
            else:
                todo += children[c]
        return found

    # Condense: a split counts if both sides are large enough.
    rate = lambda w: 1 / max(w, 1e-12)
    tree: dict[int, dict] = {}
    stack, numbers = [(2 * n - 2, 0, 0.0)], 1
    tree[0] = {"born": 0.0, "mass": 0.0, "kids": [], "node": 2 * n - 2}
    while stack:
        node, label, _ = stack.pop()
        while node >= n:
            a, b = children[node]
            lam, big = rate(height[node]), [c for c in (a, b) if size[c] >= min_cluster_size]
            if len(big) == 2:
                tree[label]["mass"] += size[node] * (lam - tree[label]["born"])
                for c in big:
                    tree[numbers] = {"born": lam, "mass": 0.0, "kids": [], "node": c}
                    tree[label]["kids"].append(numbers)
                    stack.append((c, numbers, lam))
                    numbers += 1
                break
            lost = [c for c in (a, b) if c not in big]
            tree[label]["mass"] += sum(size[c] for c in lost) * (lam - tree[label]["born"])
            if not big:
                break
            node = big[0]
        tree[label]["end"] = rate(height[node]) if node >= n else 0.0
    chosen: set[int] = set()
    score: dict[int, float] = {}
    for label in sorted(tree, reverse=True):
        below = sum(score[c] for c in tree[label]["kids"])
        if label == 0 and tree[0]["kids"]:
            continue
        if not tree[label]["kids"]:
            chosen.add(label)
            score[label] = tree[label]["mass"]
        elif method == "eom" and tree[label]["mass"] >= below:
            stack2 = list(tree[label]["kids"])
            while stack2:
                c = stack2.pop()
                chosen.discard(c)
                stack2 += tree[c]["kids"]
            chosen.add(label)
            score[label] = tree[label]["mass"]
        else:
            score[label] = below
    chosen.discard(0)
    labels = np.full(n, NOISE)
    for k, rows in enumerate(sorted((members(tree[c]["node"]) for c in chosen), key=min)):
        labels[rows] = k
    return labels


def nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and distances of each row itself and its k nearest others, ties by number."""
    n = len(x)
    order, near = np.empty((n, k + 1), np.int32), np.empty((n, k + 1))
    for at in range(0, n, STEP):
        d = pair_distances(x[at : at + STEP], x)
        own = np.arange(len(d))
        d[own, at + own] = -1
        found = np.sort(np.argpartition(d, k, axis=1)[:, : k + 1], axis=1) if k + 1 < n else np.tile(np.arange(n), (len(d), 1))
        held = np.take_along_axis(d, found, 1)
        by = np.argsort(held, axis=1, kind="stable")
        order[at : at + STEP] = np.take_along_axis(found, by, 1)
        near[at : at + STEP] = np.maximum(np.take_along_axis(held, by, 1), 0)
    return order, near


def intrinsic_dimension(x: np.ndarray, share: float = 0.9) -> float:
    """From the ratio of the distances to the two nearest neighbours."""
    d = nearest(x, 2)[1][:, 1:]
    mu = np.sort(d[:, 1] / np.maximum(d[:, 0], 1e-12))
    k = max(1, int(share * len(mu)))
    f = np.arange(1, len(mu) + 1) / len(mu)
    a, b = np.log(np.maximum(mu[:k], 1 + 1e-12)), -np.log(1 - np.minimum(f[:k], 1 - 1e-12))
    return float((a @ b) / max(a @ a, 1e-12))


def corrected(near: np.ndarray, size: np.ndarray, dim: float) -> np.ndarray:
    """Log density of each point times the volume of its size[i] neighbours.

    Maximises the likelihood of the shells' volumes v_l, sum of F + a l - exp(F + a l) v_l,
    by Newton steps from F = log k, a = 0; where that fails, log k stays.
    """
    out = np.log(size)
    for i, k in enumerate(size):
        reach = near[i, k]
        if k < 2 or reach <= 0:
            continue
        # Volumes as parts of the whole one, places as parts of k.
        v, u = np.diff((near[i, : k + 1] / reach) ** dim), np.arange(1, k + 1) / k
        f, a = out[i], 0.0
        value = k * f + a * u.sum() - (np.exp(f + a * u) * v).sum()
        for _ in range(100):
            w = np.exp(f + a * u) * v
            s0, s1, s2 = w.sum(), w @ u, w @ u**2
            g0, g1, det = k - s0, u.sum() - s1, s0 * s2 - s1 * s1
            if not det > 1e-12 * s0 * s2:
                break
            df, da = (s2 * g0 - s1 * g1) / det, (s0 * g1 - s1 * g0) / det
            if max(abs(df), abs(da)) < 1e-9:
                out[i] = f
                break
            step = 1.0
            while step > 1e-6:
                with np.errstate(over="ignore"):
                    new = k * (f + step * df) + (a + step * da) * u.sum() - (np.exp(f + step * df + (a + step * da) * u) * v).sum()
                if new >= value - 1e-9 * abs(value):
                    break
                step /= 2
            f, a, value = f + step * df, a + step * da, new
    return out


def density_peaks(x: np.ndarray, z: float = 1.0, k_max: int = 1000, halos: bool = False) -> np.ndarray:
    """Density-peak clusters: point-adaptive densities with errors, peaks merged unless a saddle is deep enough."""
    from math import lgamma, log, pi

    n = len(x)
    if n < 5:
        return np.zeros(n, int)
    dim = max(1.0, intrinsic_dimension(x))
    k_max = min(k_max, n - 2)
    order, near = nearest(x, k_max + 1)
    log_unit = dim / 2 * log(pi) - lgamma(dim / 2 + 1)
    log_volume = lambda i, k: np.maximum(log_unit + dim * np.log(np.maximum(near[i, k], 1e-300)), log(1e-300))
    # All points grow together; a point stops at its first shell that differs.
    size, growing = np.full(n, min(3, k_max)), np.arange(n) if k_max > 3 else np.zeros(0, int)
    for k in range(3, k_max):
        vi, vj = log_volume(growing, k), log_volume(order[growing, k + 1], k)
        growing = growing[-2 * k * (vi + vj - 2 * np.logaddexp(vi, vj) + log(4)) <= 23.928]
        size[growing] = k + 1
    rho = corrected(near, size, dim) - log_volume(np.arange(n), size) - log(n)
    err = np.sqrt((4 * size + 2) / ((size - 1) * size))
    g = rho - err
    ranked = np.argsort(-g, kind="stable")
    place = np.empty(n, int)
    place[ranked] = np.arange(n)
    # Whether a point has a higher neighbour, and whether it is in a higher point's neighbourhood.
    has_higher, under, up = np.zeros(n, bool), np.zeros(n, bool), np.full(n, -1)
    for i in range(n):
        around = order[i, 1 : size[i] + 1]
        under[around[place[around] > place[i]]] = True
        higher = place[order[i]] < place[i]
        has_higher[i] = higher[1 : size[i] + 1].any()
        if higher.any():
            up[i] = order[i, higher.argmax()]
    # Points higher than all they hold of neighbours look among all higher ones.
    for i in ranked[1:]:
        if up[i] < 0:
            better = ranked[: place[i]]
            up[i] = better[pair_distances(x[i : i + 1], x[better])[0].argmin()]
    labels, peaks = np.full(n, -1), []
    for i in ranked:
        if not has_higher[i] and not under[i]:
            labels[i] = len(peaks)
            peaks.append(i)
        else:
            labels[i] = labels[up[i]]
    m = len(peaks)
    saddle, saddle_err = np.full((m, m), -np.inf), np.zeros((m, m))
    for i in range(n):
        around = order[i, 1 : size[i] + 1]
        for j in around[labels[around] != labels[i]]:
            a, b = labels[i], labels[j]
            if a != b:
                low = i if g[i] < g[j] else j
                if g[low] > saddle[a, b]:
                    saddle[a, b] = saddle[b, a] = g[low]
                    saddle_err[a, b] = saddle_err[b, a] = err[low]
    alive = list(range(m))
    merged = True
    while merged and len(alive) > 1:
        merged, best = False, None
        for a in alive:
            for b in alive:
                if a < b and np.isfinite(saddle[a, b]):
                    depth = min((rho[peaks[c]] - (saddle[a, b] + saddle_err[a, b])) / np.hypot(err[peaks[c]], saddle_err[a, b]) for c in (a, b))
                    if depth < z and (best is None or saddle[a, b] > best[0]):
                        best = (saddle[a, b], a, b)
        if best:
            _, a, b = best
            keep, gone = (a, b) if rho[peaks[a]] >= rho[peaks[b]] else (b, a)
            labels[labels == gone] = keep
            for c in alive:
                if c not in (keep, gone) and saddle[gone, c] > saddle[keep, c]:
                    saddle[keep, c] = saddle[c, keep] = saddle[gone, c]
                    saddle_err[keep, c] = saddle_err[c, keep] = saddle_err[gone, c]
            alive.remove(gone)
            merged = True
    out = np.array([alive.index(c) for c in labels])
    if halos:
        for k, c in enumerate(alive):
            top = max((saddle[c, o] for o in alive if o != c), default=-np.inf)
            out[(out == k) & (g < top)] = NOISE
    return out


METHODS = {"dbscan": dbscan, "hdbscan": hdbscan, "dpa": density_peaks}


def dbscan_tables(frames: DataFrame, eps: float = 0.5, min_samples: int = 5, features: str = "features") -> DataFrame:
    """As ``dbscan`` over all rows: neighbours counted, cores linked and borders joined over pairs of blocks."""
    import pandas as pd

    key = ["traj_id", "frame_idx"]
    frames = frames.select(F.col("traj_id").cast("int").alias("traj_id"), F.col("frame_idx").cast("long").alias("frame_idx"), features)
    blocks = blocks_of(frames, features)
    if not blocks:
        return frames.select(*key, F.lit(NOISE).alias("label"))

    n = neighbours_within(frames, eps, features).withColumnRenamed("n_neighbours", "n")
    rows = kept(frames.join(n, key), "counted")

    def stars(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Each row of both blocks to the first that it is linked with by pairs between them."""
        both = (a[key] if a is b else pd.concat([a[key], b[key]])).reset_index(drop=True)
        order = both.sort_values(key).index.to_numpy()
        place = np.empty(len(both), np.int64)
        place[order] = np.arange(len(both))
        left, right = place[: len(a)], place[: len(a)] if a is b else place[len(a) :]
        x = matrix(a, features)
        y, names = x if a is b else matrix(b, features), np.arange(len(both))
        for i, j, _ in tiles(len(x), len(y), a is b):
            near = within(x[i], y[j], eps)
            rows, cols = linked(near, np.ascontiguousarray(near.T))
            at, group = np.concatenate([left[i], right[j]]), np.concatenate([rows, cols])
            names = merged_names(names, at[group >= 0], group[group >= 0])
        both = both.iloc[order].reset_index(drop=True)
        first = both.iloc[names].reset_index(drop=True).set_axis(["to_traj", "to_frame"], axis=1)
        both = pd.concat([both, first], axis=1)
        return both[(both["traj_id"] != both["to_traj"]) | (both["frame_idx"] != both["to_frame"])]

    cores = rows.where(F.col("n") >= min_samples)
    found = block_pairs(cores, blocks, stars, "traj_id int, frame_idx long, to_traj int, to_frame long")
    own = F.struct("traj_id", "frame_idx")
    edges = found.select(own.alias("u"), F.struct(F.col("to_traj").alias("traj_id"), F.col("to_frame").alias("frame_idx")).alias("v")).distinct()
    root = components(kept(edges, "stars")).select("u.traj_id", "u.frame_idx", F.col("v").alias("root"))
    rooted = kept(cores.select(*key).join(root, key, "left").select(*key, F.coalesce("root", own).alias("root")), "rooted")
    numbers = rooted.select("root").distinct().orderBy("root").rdd.zipWithIndex().map(lambda r: (r[0][0][0], r[0][0][1], r[1]))
    numbers = frames.sparkSession.createDataFrame(numbers, "traj_id int, frame_idx long, label int").select(own.alias("root"), "label")
    labelled = kept(rooted.join(numbers, "root").select(*key, "label"), "cores")

    def joined(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x, y in [(a, b)] if a is b else [(a, b), (b, a)]:
            x, y = x[x["label"] < 0], y[y["label"] >= 0]
            if len(x) and len(y):
                u, v, labels, least = matrix(x, features), matrix(y, features), y["label"].to_numpy(), np.full(len(x), NO_LABEL)
                for i, j, _ in tiles(len(u), len(v), False):
                    least[i] = np.minimum(least[i], np.where(within(u[i], v[j], eps), labels[j][None], NO_LABEL).min(1))
                out.append(x[key].assign(label=least)[least < NO_LABEL])
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in [*key, "label"]})

    rest = rows.where((F.col("n") < min_samples) & (F.col("n") > 1)).withColumn("label", F.lit(NOISE))
    met = cores.join(labelled, key).unionByName(rest)
    border = block_pairs(met.select(*key, features, "label"), blocks, joined, "traj_id int, frame_idx long, label int").groupBy(*key).agg(F.min("label").alias("label"))
    return frames.select(*key).join(labelled.unionByName(border), key, "left").select(*key, F.coalesce("label", F.lit(NOISE)).alias("label"))


def cluster(frames: DataFrame, method: str = "dbscan", sample: int | None = None, neighbors: int = 5, features: str = "features", **options) -> DataFrame:
    """traj_id, frame_idx, label of every frame, from all frames; with a sample, frames beyond it by majority of their neighbours in it."""
    import pandas as pd

    if sample is None and method == "dbscan":
        return dbscan_tables(frames, features=features, **options)
    keys, x = rows_of(frames, features, sample)
    labels = METHODS[method](x, **options) if len(x) else np.zeros(0, int)
    if sample is None:
        return frames.sparkSession.createDataFrame([(t, f, v) for (t, f), v in zip(keys, labels.tolist(), strict=True)], "traj_id int, frame_idx long, label int")
    known = {k: int(v) for k, v in zip(keys, labels.tolist(), strict=True)}
    used = labels != NOISE
    land, land_labels = x[used], labels[used]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t, f, v in zip(batch["traj_id"], batch["frame_idx"], batch[features], strict=True):
                if (t, f) in known:
                    out.append(known[(t, f)])
                elif not len(land):
                    out.append(NOISE)
                else:
                    d = ((land - np.asarray(v, float)) ** 2).sum(1)
                    votes = land_labels[np.argsort(d, kind="stable")[:neighbors]]
                    out.append(int(np.bincount(votes).argmax()))
            yield pd.DataFrame({"traj_id": batch["traj_id"], "frame_idx": batch["frame_idx"], "label": out})

    return frames.select("traj_id", "frame_idx", features).mapInPandas(run, "traj_id int, frame_idx long, label int")


def neighbours_within(frames: DataFrame, eps: float, features: str = "features") -> DataFrame:
    """traj_id, frame_idx, n_neighbours: number of rows within eps of each row (itself included); rows meet in blocks, as matrices."""
    import pandas as pd

    key = ["traj_id", "frame_idx"]
    frames = frames.select(F.col("traj_id").cast("int").alias("traj_id"), F.col("frame_idx").cast("long").alias("frame_idx"), features)

    def counted(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, n = matrix(a, features), np.zeros(len(a), np.int64)
        y, m = (x, n) if a is b else (matrix(b, features), np.zeros(len(b), np.int64))
        for i, j, own in tiles(len(x), len(y), a is b):
            near = within(x[i], y[j], eps)
            n[i] += near.sum(1)
            if not own:
                m[j] += near.sum(0)
        return pd.concat([a[key].assign(n=n)] + ([] if a is b else [b[key].assign(n=m)]))

    counts = block_pairs(frames, max(1, blocks_of(frames, features)), counted, "traj_id int, frame_idx long, n long")
    return counts.groupBy(*key).agg(F.sum("n").alias("n_neighbours"))


# Centres


def centre_means(frames: DataFrame, features: str = "features", how: str = "mean") -> DataFrame:
    """label, feature_idx, value: mean or median of each feature over a cluster's frames (noise left out)."""
    long = frames.where("label >= 0").select("label", F.posexplode(features).alias("feature_idx", "value"))
    return long.groupBy("label", "feature_idx").agg((F.avg("value") if how == "mean" else percentile(F.col("value"), 0.5)).alias("value"))


def as_vectors(centres: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("feature_idx", "value")))
    return centres.groupBy("label").agg(F.transform(pairs, lambda p: p["value"]).alias("centre"))


def nearest_to_centre(frames: DataFrame, features: str = "features", how: str = "mean", rms: bool = False) -> DataFrame:
    """The member nearest to its cluster's mean (centroid) or median; ties go to the first frame."""
    joined = frames.where("label >= 0").join(as_vectors(centre_means(frames, features, how)), "label")
    d2 = F.aggregate(F.zip_with(features, "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    d = F.sqrt(d2 / F.size(features)) if rms else F.sqrt(d2)
    best = joined.groupBy("label").agg(F.min(F.struct(d.alias("d"), "traj_id", "frame_idx")).alias("b"))
    return best.select("label", "b.traj_id", "b.frame_idx", F.col("b.d").alias("distance"))


def density_peak_centres(frames: DataFrame, features: str = "features", k: int = 8) -> DataFrame:
    """The member with the most others within the median distance to the k-th neighbour; small clusters take the centroid.

    All members of a cluster meet, in pairs of blocks; ties go to the first frame.
    """
    import pandas as pd

    key = ["traj_id", "frame_idx"]
    rows = frames.where("label >= 0").select("label", F.col("traj_id").cast("int").alias("traj_id"), F.col("frame_idx").cast("long").alias("frame_idx"), F.col(features).alias("features"))
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    sized = rows.join(sizes, "label")
    small = nearest_to_centre(sized.where(F.col("size") < k)).select("label", *key)
    large = kept(sized.where(F.col("size") >= k).drop("size"), "members")
    blocks = blocks_of(large, "features")
    if not blocks:
        return small

    def sides(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
        """Members of one cluster in both blocks."""
        for label in sorted(set(a["label"]) & set(b["label"])):
            x, y = a[a["label"] == label], b[b["label"] == label]
            yield from [(x, y)] if a is b else [(x, y), (y, x)]

    def nearby(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: [] for c in ["label", *key, "d"]})]
        for left, right in sides(a, b):
            x, y = matrix(left, "features"), matrix(right, "features")
            d = np.full((len(x), min(k, len(y))), np.inf)
            for i, j, _ in tiles(len(x), len(y), False):
                u, v = x[i], y[j]
                m = min(k, len(v))
                for at in range(0, len(u), STEP):
                    found = np.argpartition(squares(u[at : at + STEP], v), m - 1, axis=1)[:, :m]
                    own = slice(i.start + at, i.start + min(at + STEP, len(u)))
                    both = np.hstack([d[own], np.sqrt(((u[at : at + STEP, None] - v[found]) ** 2).sum(2))])
                    d[own] = np.partition(both, d.shape[1] - 1, axis=1)[:, : d.shape[1]]
            out.append(left[["label", *key]].assign(d=list(d)))
        return pd.concat(out[1:] or out)

    found = block_pairs(large, blocks, nearby, "label int, traj_id int, frame_idx long, d array<double>")
    reach = found.groupBy("label", *key).agg(F.sort_array(F.flatten(F.collect_list("d")))[k - 1].alias("reach"))
    # Wider by a rounding, so that a member whose own reach is the median counts its k-th neighbour.
    radii = kept(reach.groupBy("label").agg((percentile(F.col("reach"), 0.5) * (1 + 1e-12)).alias("radius")), "radii")

    def counted(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: [] for c in ["label", *key, "n"]})]
        for left, right in sides(a, b):
            x, y, n = matrix(left, "features"), matrix(right, "features"), np.zeros(len(left), np.int64)
            for i, j, _ in tiles(len(x), len(y), False):
                n[i] += within(x[i], y[j], float(left["radius"].iloc[0])).sum(1)
            out.append(left[["label", *key]].assign(n=n))
        return pd.concat(out[1:] or out)

    n = block_pairs(large.join(radii, "label"), blocks, counted, "label int, traj_id int, frame_idx long, n long").groupBy("label", *key).agg(F.sum("n").alias("n"))
    best = n.groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("m"), *key)).alias("b"))
    return best.select("label", "b.traj_id", "b.frame_idx").unionByName(small)


def centres(frames: DataFrame, method: str = "centroid", features: str = "features") -> DataFrame:
    if method in ("mean", "median"):
        return as_vectors(centre_means(frames, features, method))
    if method == "density_peak":
        return density_peak_centres(frames, features)
    return nearest_to_centre(frames, features, "median" if method == "median_centroid" else "mean", rms=method == "rmsd_centroid")


def counts(labels: DataFrame) -> DataFrame:
    """Clusters, frames in them and noise."""
    noise = F.sum((F.col("label") < 0).cast("long"))
    return labels.agg(F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_clusters"), F.coalesce(noise, F.lit(0)).cast("long").alias("n_noise"), F.count(F.lit(1)).alias("n_frames"))


def silhouette(frames: DataFrame, features: str = "features", sample: int | None = None) -> DataFrame:
    """Mean of (b - a) / max(a, b) without noise; null with fewer than two clusters. All pairs of a (sampled) set, in blocks that give sums by cluster."""
    import pandas as pd

    key = ["traj_id", "frame_idx"]
    rows = frames.where("label >= 0")
    rows = rows.orderBy(F.xxhash64(*key), *key).limit(sample) if sample else rows
    rows = rows.select(F.col("traj_id").cast("int").alias("traj_id"), F.col("frame_idx").cast("long").alias("frame_idx"), F.col("label").cast("int").alias("label"), features)

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, out = matrix(a, features), []
        y = x if a is b else matrix(b, features)
        names_a, at_a = np.unique(a["label"].to_numpy(), return_inverse=True)
        names_b, at_b = (names_a, at_a) if a is b else np.unique(b["label"].to_numpy(), return_inverse=True)
        to_b = np.zeros((len(x), len(names_b)))
        to_a = to_b if a is b else np.zeros((len(y), len(names_a)))
        for i, j, own in tiles(len(x), len(y), a is b):
            d = np.sqrt(squares(x[i], y[j]))
            if own:
                np.fill_diagonal(d, 0.0)
            to_b[i] += d @ np.eye(len(names_b))[at_b[j]]
            if not own:
                to_a[j] += d.T @ np.eye(len(names_a))[at_a[i]]
        for side, total, names, at in [(a, to_b, names_b, at_b)] if a is b else [(a, to_b, names_b, at_b), (b, to_a, names_a, at_a)]:
            n = np.tile(np.bincount(at), (len(side), 1))
            if a is b:
                n[np.arange(len(side)), at] -= 1
            for k, label2 in enumerate(names.tolist()):
                out.append(side[[*key, "label"]].assign(label2=label2, d=total[:, k], n=n[:, k]))
        return pd.concat(out)

    each = block_pairs(rows, max(1, blocks_of(rows, features)), sums, "traj_id int, frame_idx long, label int, label2 int, d double, n long")
    to = each.groupBy(*key, "label", "label2").agg((F.sum("d") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    ab = to.groupBy(*key).agg(F.max(F.when(F.col("label") == F.col("label2"), F.col("m"))).alias("a"), F.min(F.when(F.col("label") != F.col("label2"), F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return ab.agg(F.when(F.count("b") > 0, F.avg(s)).alias("silhouette"))


def knn_labels(asked: DataFrame, labelled: DataFrame, k: int = 5, features: str = "features") -> DataFrame:
    """id (frame_idx) and majority label of the k nearest labelled rows; ties by the smaller label. Rows meet in blocks that give each row's k nearest."""
    import pandas as pd

    side = lambda df, label: df.select(F.lit(0).alias("traj_id"), F.col("frame_idx").cast("long").alias("frame_idx"), label.cast("int").alias("label"), features)
    rows = side(asked, F.lit(None)).unionByName(side(labelled.where("label >= 0"), F.col("label")))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x, y in [(a, b)] if a is b else [(a, b), (b, a)]:
            x, y = x[x["label"].isna()], y[y["label"].notna()].sort_values("frame_idx")
            if not len(x) or not len(y):
                continue
            u, v, parts = matrix(x, features), matrix(y, features), {}
            for i, j, _ in tiles(len(u), len(v), False):
                n = min(j.stop - j.start, k + 8)
                at = np.sort(np.argpartition(squares(u[i], v[j]), n - 1, axis=1)[:, :n], axis=1) + j.start
                d2 = ((u[i][:, None] - v[at]) ** 2).sum(2)
                if i.start in parts:  # earlier rows come first, so that they win ties
                    at, d2 = np.hstack([parts[i.start][0], at]), np.hstack([parts[i.start][1], d2])
                order = np.argsort(d2, axis=1, kind="stable")[:, :k]
                parts[i.start] = np.take_along_axis(at, order, 1), np.take_along_axis(d2, order, 1)
            at, d2 = (np.concatenate([parts[i][c] for i in sorted(parts)]) for c in (0, 1))
            out.append(pd.DataFrame({"id": np.repeat(x["frame_idx"].to_numpy(), at.shape[1]), "id2": y["frame_idx"].to_numpy()[at].ravel(), "label": y["label"].to_numpy()[at].ravel().astype(int), "d2": d2.ravel()}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("id", "id2", "label", "d2")})

    near = block_pairs(rows, max(1, blocks_of(rows, features)), nearest, "id long, id2 long, label int, d2 double")
    place = F.row_number().over(Window.partitionBy("id").orderBy("d2", "id2"))
    votes = near.withColumn("_n", place).where(F.col("_n") <= k).groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b")).select("id", F.col("b.label").alias("label"))
