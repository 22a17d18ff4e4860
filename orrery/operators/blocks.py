"""All pairs of rows, dealt out in blocks of bounded size, and components of linked rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block at least while there are fewer than GRID blocks, and values of a block at most (on average; rows are dealt by hash).
ROWS, VALUES, GRID = 1024, 1 << 22, 12
#: Rows of a tile: within a pair of blocks matrices of TILE by TILE are made, one at a time.
TILE = 2048


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table under ``spark.checkpoint.dir``."""
    s = df.sparkSession
    base = s.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="orrery-")
    path = f"{base.rstrip('/')}/orrery-{name}-{uuid.uuid4().hex}"
    at = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return s.read.schema(df.schema).parquet(path)


def blocks_of(frames: DataFrame, features: str) -> int:
    """Number of blocks: GRID for all tables that leave a block at most VALUES values, so each row is dealt GRID times."""
    size, n = frames.agg(F.max(F.size(features)), F.count(F.lit(1))).first()
    return max(-(-n // max(64, VALUES // max(1, size))), min(GRID, -(-n // ROWS))) if n else 0


def block_pairs(rows: DataFrame, blocks: int, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame | Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``run`` of each pair of blocks of rows, once; a block meets itself as (a, a), the same object twice."""
    block = F.pmod(F.xxhash64("traj_id", "frame_idx"), F.lit(blocks))
    dealt = rows.withColumn("_b", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("_pair", F.least("_b", "_o") * blocks + F.greatest("_b", "_o")).drop("_o")

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(batches), ignore_index=True)
        i, j = divmod(int(batch["_pair"].iloc[0]), blocks)
        a = batch[batch["_b"] == i].reset_index(drop=True)
        b = a if i == j else batch[batch["_b"] == j].reset_index(drop=True)
        del batch
        if len(a) and len(b):
            found = run(a, b)
            yield from [found] if isinstance(found, pd.DataFrame) else found

    # More partitions than pairs, so that few pairs share one.
    return dealt.repartition(min(2048, 2 * blocks * (blocks + 1)), "_pair").groupBy("_pair").applyInPandas(one, schema)


def tiles(n: int, m: int, same: bool) -> Iterator[tuple[slice, slice, bool]]:
    """Pairs of slices of n and m rows, each once; if both sides are the same rows, without mirror images, and whether a slice meets itself."""
    for i in range(0, n, TILE):
        for j in range(i if same else 0, m, TILE):
            yield slice(i, min(n, i + TILE)), slice(j, min(m, j + TILE)), same and i == j


def matrix(batch: pd.DataFrame, features: str) -> np.ndarray:
    values = batch[features].to_numpy()
    missing = pd.isna(batch[features]).to_numpy()
    if missing.any():  # null rows are at no distance from others
        width = next((len(v) for v in values[~missing]), 1)
        values = [np.full(width, np.nan) if gone else v for v, gone in zip(values, missing, strict=True)]
    return np.stack(values).astype(float)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances as one product of matrices; rounding can make them negative."""
    one = lambda z: np.ones((len(z), 1))
    return np.hstack([-2 * x, (x**2).sum(1)[:, None], one(x)]) @ np.hstack([y, one(y), (y**2).sum(1)[:, None]]).T


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d2 = products(x, y)
    return np.maximum(d2, 0, out=d2)


def within(x: np.ndarray, y: np.ndarray, eps: float, root: bool = False) -> np.ndarray:
    """Whether rows are at most eps apart (by squares, or by their roots); pairs that rounding could decide are summed anew."""
    out, limit, step = np.empty((len(x), len(y)), bool), eps * eps, 256
    slack = 1e-12 * (limit + np.nanmax((x**2).sum(1), initial=0) + np.nanmax((y**2).sum(1), initial=0))
    for k in range(0, len(x), step):
        d2 = products(x[k : k + step], y)
        near = d2 <= limit + slack
        r, c = np.nonzero(near != (d2 < limit - slack))
        out[k : k + step] = near
        for m in range(0, len(r), 4096):
            i, j = r[m : m + 4096] + k, c[m : m + 4096]
            d2 = ((x[i] - y[j]) ** 2).sum(1)
            out[i, j] = np.sqrt(d2) <= eps if root else d2 <= limit
    return out


def linked(near: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component of each row and each column of a two-sided graph; -1 without a link."""
    rows, cols = np.full(near.shape[0], -1), np.full(near.shape[1], -1)
    for s in np.flatnonzero(near.any(1)):
        if rows[s] < 0:
            rows[s], front = s, np.array([s])
            while len(front):
                new = np.flatnonzero(near[front].any(0) & (cols < 0))
                cols[new] = s
                front = np.flatnonzero(back[new].any(0) & (rows < 0))
                rows[front] = s
    return rows, cols


def merged_names(names: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Names of rows (the least of those linked so far) after rows ``at`` of one ``group`` are linked too."""
    group = np.unique(group, return_inverse=True)[1]
    while True:
        held = names[at]
        least = np.full(group.max(initial=-1) + 1, len(names))
        np.minimum.at(least, group, held)
        if (held == least[group]).all():
            return names
        to = np.arange(len(names))
        np.minimum.at(to, held, least[group])
        while (to[to] != to).any():
            to = to[to]
        names = to[names]


def components(edges: DataFrame) -> DataFrame:
    """u and v of linked rows (v < u) to u and v, the least of u's component: large and small stars in turn."""
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = kept(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(moved.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return edges
        last = state
