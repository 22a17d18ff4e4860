"""Dimensionality reduction: PCA, kernel PCA, diffusion maps.

Statistics over frames (means, cross products) are aggregates in Spark; only matrices of
features by features, of landmarks by landmarks, or of frames by a few vectors reach the
driver. Up to ``EXACT`` frames a kernel matrix is decomposed there; beyond, the same
eigenvectors come from products of the kernel with blocks of vectors, over pairs of blocks
of frames. Landmarks take the frames' place only if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.blocks import block_pairs, blocks_of, kept, matrix, squares, tiles

EXACT, SEED = 4000, 42
#: Vectors of a product, products at most, and the residual (relative to the largest value) at which they end.
WIDE, PRODUCTS, RESIDUAL = 16, 40, 1e-8


def moments(frames: DataFrame, features: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, mean and cross products about it; each task sums its rows (features x features)."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, c = 0, None, None
        for batch in batches:
            if len(batch):
                x = np.stack(batch[features].to_numpy()).astype(float)
                n, s, c = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if c is None else c)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "c": [c.ravel().tolist()]})

    parts = frames.select(features).mapInPandas(run, "n long, s array<double>, c array<double>")
    # Sums of the tasks' parts stay arrays in Spark, so the driver gets one row.
    flat = parts.select("n", F.posexplode(F.concat("s", "c")).alias("k", "v")).groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    if not flat:
        return 0, np.zeros(0), np.zeros((0, 0))
    n, v = flat[0]["n"], np.array([r["v"] for r in sorted(flat, key=lambda r: r["k"])])
    d = int((np.sqrt(1 + 4 * len(v)) - 1) / 2)
    mean = v[:d] / n
    return n, mean, v[d:].reshape(d, d) - n * np.outer(mean, mean)


def signed(vectors: np.ndarray) -> np.ndarray:
    """Each column with its largest entry positive."""
    at = np.abs(vectors).argmax(0)
    return vectors * np.sign(vectors[at, np.arange(vectors.shape[1])])


def auto_components(n_features: int) -> int:
    return max(5, min(100, int(0.05 * n_features)))


def elbow(values, sensitivity: float = 1.0, most: int | None = None, offset: float = 0) -> int:
    """Place of the bend of a falling curve (difference from the chord, first drop by the sensitivity)."""
    y = np.asarray(values, float)[: most or None]
    n = len(y)
    if n < 3 or y.max() == y.min():
        return max(1, min(100, max(1, n // 10)))
    x = np.arange(n) / (n - 1)
    rise = 1 - (y - y.min()) / (y.max() - y.min())
    d = rise - x
    found = None
    for i in range(1, n - 1):
        if d[i] >= d[i - 1] and d[i] >= d[i + 1]:
            limit = d[i] - sensitivity / (n - 1)
            for j in range(i + 1, n):
                if j < n - 1 and d[j] >= d[j - 1] and d[j] >= d[j + 1] and d[j] > d[i]:
                    break
                if d[j] < limit:
                    found = i
                    break
        if found is not None:
            break
    k = (found if found is not None else min(100, max(1, n // 10))) + 1
    return int(max(1, min(n, k + (offset if isinstance(offset, int) else round(offset * k)))))


class Pca:
    """Whitened principal components; ``transform`` is one expression within the row."""

    def __init__(self, frames: DataFrame, components: int | str = "auto", features: str = "features"):
        n, self.mean, cross = moments(frames, features)
        values, vectors = np.linalg.eigh(cross / max(1, n - 1))
        order = np.argsort(values)[::-1]
        self.values, self.features = np.maximum(values[order], 0), features
        k = auto_components(len(values)) if components == "auto" else int(components)
        self.k = max(1, min(k, len(values)))
        self.vectors = signed(vectors[:, order])[:, : self.k]
        self.ratio = self.values / max(self.values.sum(), 1e-300)

    def transform(self, frames: DataFrame, whiten: bool = True) -> DataFrame:
        import pandas as pd

        load = self.vectors / (np.sqrt(np.maximum(self.values[: self.k], 1e-300)) if whiten else 1.0)
        mean, features = self.mean, self.features

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = np.stack(batch[features].to_numpy()).astype(float) if len(batch) else np.zeros((0, len(mean)))
                yield pd.DataFrame({"traj_id": batch["traj_id"], "frame_idx": batch["frame_idx"], "comps": list(((x - mean) @ load))})

        return frames.select("traj_id", "frame_idx", features).mapInPandas(run, "traj_id int, frame_idx long, comps array<double>")


def rows_of(frames: DataFrame, features: str, limit: int | None = None) -> tuple[list, np.ndarray]:
    """Keys and matrix of a bounded number of frames."""
    held = frames.select("traj_id", "frame_idx", features)
    held = held.orderBy(F.xxhash64("traj_id", "frame_idx"), "traj_id", "frame_idx").limit(limit) if limit else held
    got = sorted(held.collect(), key=lambda r: (r[0], r[1]))
    return [(r[0], r[1]) for r in got], np.array([r[2] for r in got], float)


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d2 = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d2, 0))


def centred(k: np.ndarray) -> np.ndarray:
    return k - k.mean(0)[None] - k.mean(1)[:, None] + k.mean()


def gamma_of(frames: DataFrame, gamma: float | str, features: str) -> float:
    if not isinstance(gamma, str):
        return float(gamma)
    n, mean, cross = moments(frames, features)
    d = len(mean)
    variance = (np.trace(cross) / n + ((mean - mean.mean()) ** 2).sum()) / d if n else 1.0
    return 1.0 / (d * variance) if gamma == "scale" else 1.0 / d


def projected(frames: DataFrame, features: str, land: np.ndarray, load: np.ndarray, gamma: float, shift: np.ndarray) -> DataFrame:
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch[features].to_numpy()).astype(float)
                yield pd.DataFrame({"traj_id": batch["traj_id"], "frame_idx": batch["frame_idx"], "comps": list(kernel(x, land, gamma) @ load - shift)})

    return frames.select("traj_id", "frame_idx", features).mapInPandas(run, "traj_id int, frame_idx long, comps array<double>")


def leading(product, n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and vectors of a symmetric matrix given by its products (block Lanczos, all vectors kept orthogonal)."""
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n, min(WIDE, n))))[0]
    basis, images = q, product(q)
    for _ in range(PRODUCTS):
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:components]
        values, turn = values[order], turn[:, order]
        left = images @ turn - basis @ turn * values
        if np.linalg.norm(left, axis=0).max() <= RESIDUAL * np.abs(values).max() or basis.shape[1] >= n:
            return values, basis @ turn
        q = images[:, -q.shape[1] :]
        for _ in range(2):
            q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
        q = q[:, : n - basis.shape[1]]
        basis, images = np.hstack([basis, q]), np.hstack([images, product(q)])
    raise RuntimeError(f"eigenvectors not settled after {PRODUCTS} products")


class KernelProducts:
    """Products of a kernel between all frames with vectors; ``of(a, b)`` gives the kernel of two blocks."""

    def __init__(self, frames: DataFrame, features: str, of):
        self.keys = sorted((r[0], r[1]) for r in frames.select("traj_id", "frame_idx").collect())
        self.of, self.spark = of, frames.sparkSession
        at = self.spark.createDataFrame([(t, f, k) for k, (t, f) in enumerate(self.keys)], "traj_id int, frame_idx long, at long")
        self.rows = kept(frames.select("traj_id", "frame_idx", F.col(features).alias("v")).join(at, ["traj_id", "frame_idx"]), "kernel")
        self.blocks = blocks_of(self.rows, "v")

    def __call__(self, q: np.ndarray) -> np.ndarray:
        import pandas as pd

        of, sent = self.of, self.spark.sparkContext.broadcast(q)

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            k, i, j = of(matrix(a, "v"), matrix(b, "v")), a["at"].to_numpy(), b["at"].to_numpy()
            parts = [pd.DataFrame({"at": i, "p": list(k @ sent.value[j])})]
            return pd.concat(parts if a is b else [*parts, pd.DataFrame({"at": j, "p": list(k.T @ sent.value[i])})])

        out = np.zeros_like(q)
        parts = block_pairs(self.rows, self.blocks, run, "at long, p array<double>")
        summed = parts.groupBy("at").agg(*[F.sum(F.col("p")[c]).alias(f"p{c}") for c in range(q.shape[1])]).toPandas()
        out[summed["at"].to_numpy()] = summed[[f"p{c}" for c in range(q.shape[1])]].to_numpy()
        sent.destroy()
        return out

    def frame(self, values: np.ndarray) -> DataFrame:
        return self.spark.createDataFrame([(t, f, s) for (t, f), s in zip(self.keys, values.tolist(), strict=True)], "traj_id int, frame_idx long, comps array<double>")


def kernel_pca(frames: DataFrame, components: int = 5, gamma: float | str = "scale", landmarks: int | None = None, features: str = "features") -> DataFrame:
    """RBF kernel PCA over all frames; by landmarks (whitened afterwards) only if asked for."""
    g = gamma_of(frames, gamma, features)
    n = 0 if landmarks else frames.count()
    if landmarks is None and n > EXACT:
        products = KernelProducts(frames, features, lambda a, b: kernel(a, b, g))
        middle = lambda q: q - q.mean(0)
        values, vectors = leading(lambda q: middle(products(middle(q))), n, components)
        used = values > 1e-10
        return products.frame(signed(vectors[:, used]) * np.sqrt(values[used]))
    if landmarks is None:
        keys, x = rows_of(frames, features)
        values, vectors = np.linalg.eigh(centred(kernel(x, x, g)))
        order = np.argsort(values)[::-1][:components]
        order = order[values[order] > 1e-10]
        scores = signed(vectors[:, order]) * np.sqrt(values[order])
        return frames.sparkSession.createDataFrame([(t, f, s) for (t, f), s in zip(keys, scores.tolist(), strict=True)], "traj_id int, frame_idx long, comps array<double>")
    _, land = rows_of(frames, features, landmarks)
    values, vectors = np.linalg.eigh(kernel(land, land, g))
    keep = values > 1e-8
    root = vectors[:, keep] / np.sqrt(values[keep])
    mapped = projected(frames, features, land, root, g, np.zeros(root.shape[1])).withColumnRenamed("comps", "features")
    return Pca(mapped, min(components, root.shape[1])).transform(mapped)


def contact_kernel_pca(frames: DataFrame, components: int = 5, features: str = "features", **options) -> DataFrame:
    """Kernel PCA of rows that hold 0 and 1 only."""
    odd = frames.where(F.exists(F.transform(features, lambda x: x.cast("double")), lambda x: ~x.isin(0.0, 1.0))).limit(1)
    if not odd.isEmpty():
        raise ValueError("values other than 0 and 1")
    return kernel_pca(frames.withColumn(features, F.transform(features, lambda x: x.cast("double"))), components, features=features, **options)


def rmsd_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Deviation of centred frames (not turned), mean over all components."""
    mid = lambda x: (x.reshape(len(x), -1, 3) - x.reshape(len(x), -1, 3).mean(1, keepdims=True)).reshape(len(x), -1)
    a, b = mid(a), mid(b)
    d2 = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(d2, 0) / a.shape[1])


def epsilon_of(x: np.ndarray) -> float:
    """Squared median of the deviation to the k-th neighbour."""
    k = min(len(x) - 1, max(20, len(x) // 100))
    d = np.sort(rmsd_matrix(x, x), axis=1)[:, k]
    return max(float(np.median(d)) ** 2, 1e-5)


def epsilon_of_all(frames: DataFrame, features: str, n: int) -> float:
    """``epsilon_of`` over pairs of blocks; a row's k nearest of each block meet again."""
    import pandas as pd

    k = min(n - 1, max(20, n // 100)) + 1
    rows = kept(frames.select("traj_id", "frame_idx", F.col(features).alias("v")), "frames")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        d, out = rmsd_matrix(matrix(a, "v"), matrix(b, "v")), []
        for side, x in [(a, d)] if a is b else [(a, d), (b, d.T)]:
            m = min(k, x.shape[1])
            out.append(side[["traj_id", "frame_idx"]].assign(d=list(np.partition(x, m - 1, axis=1)[:, :m])))
        return pd.concat(out)

    found = block_pairs(rows, blocks_of(rows, "v"), run, "traj_id int, frame_idx long, d array<double>")
    reach = found.groupBy("traj_id", "frame_idx").agg(F.sort_array(F.flatten(F.collect_list("d")))[k - 1].alias("d"))
    return max(float(np.median(reach.select("d").toPandas()["d"])) ** 2, 1e-5)


def diffusion_maps(frames: DataFrame, components: int, epsilon: float | None = None, landmarks: int | None = None, features: str = "features") -> DataFrame:
    """Leading eigenvectors of the diffusion operator, the trivial one left out; with landmarks, other frames by their weights."""
    small, n = landmarks is None, 0 if landmarks else frames.count()
    if small and n > EXACT:
        eps = epsilon_of_all(frames, features, n) if epsilon is None else epsilon
        products = KernelProducts(frames, features, lambda a, b: np.exp(-(rmsd_matrix(a, b) ** 2) / eps))
        root = 1 / np.sqrt(products(np.ones((n, 1))))
        _, vectors = leading(lambda q: root * products(root * q), n, components + 1)
        return products.frame(signed(vectors[:, 1:] * root))
    keys, x = rows_of(frames, features, landmarks)
    eps = epsilon_of(x) if epsilon is None else epsilon
    k = np.exp(-(rmsd_matrix(x, x) ** 2) / eps)
    root = 1 / np.sqrt(k.sum(1))
    values, vectors = np.linalg.eigh(k * root[:, None] * root[None])
    order = np.argsort(values)[::-1][1 : components + 1]
    maps = signed(vectors[:, order] * root[:, None])
    schema = "traj_id int, frame_idx long, comps array<double>"
    if small:
        return frames.sparkSession.createDataFrame([(t, f, s) for (t, f), s in zip(keys, maps.tolist(), strict=True)], schema)
    import pandas as pd

    top = values[order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                w = np.exp(-(rmsd_matrix(np.stack(batch[features].to_numpy()).astype(float), x) ** 2) / eps)
                yield pd.DataFrame({"traj_id": batch["traj_id"], "frame_idx": batch["frame_idx"], "comps": list((w / w.sum(1, keepdims=True)) @ maps / top)})

    return frames.select("traj_id", "frame_idx", features).mapInPandas(run, schema)


def kernel_long(frames: DataFrame, gamma: float, features: str = "features", form: str = "plain") -> DataFrame:
    """a, b, k = exp(-gamma d2) for all pairs of rows; "centred": less row and column means, plus the grand mean; "transition": rows sum to 1.

    Rows meet in blocks, as matrices: once for the sums of the rows, once for the values, which leave tile by tile.
    """
    import pandas as pd

    rows = frames.select(F.lit(0).alias("traj_id"), F.col("frame_idx").cast("long").alias("frame_idx"), F.col(features).cast("array<double>").alias("v"))
    blocks = max(1, blocks_of(rows, "v"))

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x = matrix(a, "v")
        y = x if a is b else matrix(b, "v")
        s, n = np.zeros(len(x)), np.zeros(len(x), np.int64)
        t, m = (s, n) if a is b else (np.zeros(len(y)), np.zeros(len(y), np.int64))
        for i, j, own in tiles(len(x), len(y), a is b):
            k = np.exp(-gamma * squares(x[i], y[j]))
            held = ~np.isnan(k)
            k[~held] = 0
            s[i], n[i] = s[i] + k.sum(1), n[i] + held.sum(1)
            if not own:
                t[j], m[j] = t[j] + k.sum(0), m[j] + held.sum(0)
        sides = [(a, s, n)] if a is b else [(a, s, n), (b, t, m)]
        return pd.concat([pd.DataFrame({"frame_idx": side["frame_idx"], "s": u, "n": c}) for side, u, c in sides])

    if form != "plain":
        total = block_pairs(rows, blocks, sums, "frame_idx long, s double, n long").groupBy("frame_idx").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        total = kept(total.withColumn("m", F.col("s") / F.nullif("n", F.lit(0))), "sums")
        grand = total.agg(F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).first()[0] or 0.0
        rows = rows.join(total.select("frame_idx", "s", "m"), "frame_idx")

    def values(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x, p = matrix(a, "v"), a["frame_idx"].to_numpy()
        y, q = (x, p) if a is b else (matrix(b, "v"), b["frame_idx"].to_numpy())
        if form == "centred":
            u, v = a["m"].to_numpy(), b["m"].to_numpy()
        elif form == "transition":
            u, v = a["s"].to_numpy(), b["s"].to_numpy()
        for i, j, own in tiles(len(x), len(y), a is b):
            k = np.exp(-gamma * squares(x[i], y[j]))
            if form == "centred":
                k += grand - u[i][:, None] - v[j][None]
            rows_k = k / u[i][:, None] if form == "transition" else k
            yield pd.DataFrame({"a": np.repeat(p[i], k.shape[1]), "b": np.tile(q[j], k.shape[0]), "k": rows_k.ravel()})
            if not own:
                back = (k / v[j][None] if form == "transition" else k).T
                yield pd.DataFrame({"a": np.repeat(q[j], k.shape[0]), "b": np.tile(p[i], k.shape[1]), "k": back.ravel()})

    return block_pairs(rows, blocks, values, "a long, b long, k double")
