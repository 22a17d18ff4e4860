"""Approximate nearest neighbours by inner product: adaptive dimension scan in probed lists.

Vectors get one more component that brings all to the largest length found, so
that the nearest by distance is the one with the largest inner product, and
are turned by a random rotation. Centroids of ``lists`` clusters come from a
sample of ``SAMPLE`` distinct vectors; every vector is put in the list of its
nearest centroid. The number of lists to probe is the least that finds
``TARGET`` of the true neighbours within the sample.

A query meets the vectors of its probed lists in blocks of at most about
``BLOCK`` vectors and ``QUERIES`` queries. A block is scanned in slices of ``SLICE`` vectors and
columns of ``COLUMNS`` rotated components: after each column a candidate is abandoned if its
partial distance, scaled to all dimensions, lies above the query's bound by more than chance
allows (``EPSILON`` standard errors). The bound is the k-th nearest found so far and tightens from
slice to slice. What is left is scored exactly, in double precision on the vectors as given.

Equal vectors are searched and scanned once: of each distinct vector only the
k + 1 smallest identifiers can be among anyone's k nearest. So copies make no
hot list, and large lists are cut into blocks.

Edge cases: vectors that are null, zero or hold null or non-finite components
take no part, nor do rows with a null identifier; vectors of different lengths are an error;
ties go to the smaller identifier; repeated rows count once; with fewer candidates
than k all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.shared import table, written

SAMPLE, TARGET, BLOCK, QUERIES, SLICE, COLUMNS, EPSILON, SEED = 8192, 0.97, 2048, 2048, 256, 16, 2.1, 7
K = 20


class Index:
    """Rotation, centroids and the number of lists to probe, from a sample of vectors."""

    def __init__(self, sample: np.ndarray, longest: float, n: int, target: float = TARGET, k: int = K, seed: int = SEED):
        r = np.random.default_rng(seed)
        d = sample.shape[1]
        self.longest = float(longest)
        self.rotation = np.linalg.qr(r.standard_normal((d + 1, d + 1)))[0]
        x = self.turned(sample)
        lists = int(max(1, min(len(x) // 8, np.sqrt(n) / 2)))
        self.centroids = x[r.choice(len(x), lists, replace=False)].copy()
        for _ in range(10):
            at = self.nearest(x, 1)[:, 0]
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, at, x)
            size = np.bincount(at, minlength=lists)
            self.centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], self.centroids)
        self.probes = self.calibrated(sample, x, target, k)

    def turned(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0))
        return np.concatenate([x, more[:, None]], axis=1) @ self.rotation

    def nearest(self, x: np.ndarray, p: int) -> np.ndarray:
        """The p nearest lists of rotated vectors, nearest first."""
        away = (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        return np.argsort(away, axis=1, kind="stable")[:, :p]

    def calibrated(self, sample: np.ndarray, x: np.ndarray, target: float, k: int) -> int:
        at = self.nearest(x, 1)[:, 0]
        q = np.arange(0, len(x), max(1, len(x) // 256))
        scores = sample[q] @ sample.T
        scores[np.arange(len(q)), q] = -np.inf
        k = min(k, len(x) - 1)
        if k < 1:
            return len(self.centroids)
        top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        order = self.nearest(self.turned(sample[q], query=True), len(self.centroids))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        found = np.sort(place[np.arange(len(q))[:, None], at[top]].ravel())
        return int(found[min(len(found) - 1, int(np.ceil(target * len(found))) - 1)]) + 1


def slice_pairs(a: np.ndarray, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, vector) of rotated vectors that no test abandons, with their distances."""
    d, pairs = x.shape[1], None
    partial, alive = np.zeros((len(a), len(x))), np.ones((len(a), len(x)), bool)
    for c in range(0, d, COLUMNS):
        ac, xc, seen = a[:, c : c + COLUMNS], x[:, c : c + COLUMNS], min(c + COLUMNS, d)
        limit = bound * (seen / d) * (1.0 if seen == d else (1 + EPSILON / np.sqrt(seen)) ** 2)
        if pairs is None:
            partial += (ac**2).sum(1)[:, None] + (xc**2).sum(1)[None, :] - 2 * ac @ xc.T
            alive &= partial <= limit[:, None] + 1e-9
            if alive.mean() < 0.15:
                pairs = np.nonzero(alive)
                rest = partial[pairs]
        else:
            i, j = pairs
            rest = rest + ((ac[i] - xc[j]) ** 2).sum(1)
            stay = rest <= limit[i] + 1e-9
            pairs, rest = (i[stay], j[stay]), rest[stay]
    i, j = np.nonzero(alive) if pairs is None else pairs
    return i, j, partial[i, j] if pairs is None else rest


def scan_block(q: np.ndarray, x: np.ndarray, index: Index, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that no test abandoned. q, x: vectors as given."""
    turned_q, turned_x = index.turned(q, query=True), index.turned(x)
    seeds = turned_x[np.linspace(0, len(x) - 1, min(len(x), 4 * k), dtype=int)]
    found = [(np.zeros(0, int), np.zeros(0, int))]
    for lo in range(0, len(q), 128):
        held = []
        a = turned_q[lo : lo + 128]
        # A few vectors give the first bound; those scanned tighten it.
        away = (a**2).sum(1)[:, None] + (seeds**2).sum(1)[None, :] - 2 * a @ seeds.T
        bound = np.partition(away, k - 1, axis=1)[:, k - 1] if len(seeds) >= k else np.full(len(a), np.inf)
        best = np.full((len(a), k), np.inf)
        for at in range(0, len(x), SLICE):
            part = turned_x[at : at + SLICE]
            i, j, away = slice_pairs(a, part, bound)
            held.append((i, j + at, away))
            near = np.full((len(a), k + len(part)), np.inf)
            near[:, :k], near[i, k + j] = best, away
            best = np.partition(near, k - 1, axis=1)[:, :k]
            bound = np.minimum(bound, best.max(1))
        i, j, away = (np.concatenate([h[p] for h in held]) for p in range(3))
        stay = away <= bound[i] * (1 + 1e-9) + 1e-9
        found.append((i[stay] + lo, j[stay]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def scanner(index: Index, k: int):
    """Both sides of a block to each query's best (score, identifiers) within it."""
    schema = pa.schema([("q", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return schema.empty_table()
        q, x = matrix(queries.column("v")), matrix(vectors.column("v"))
        uid = vectors.column("uid").to_numpy()
        i, j = scan_block(q, x, index, k)
        score = np.concatenate([np.einsum("nd,nd->n", q[i[lo : lo + 65536]], x[j[lo : lo + 65536]]) for lo in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
        order = np.lexsort((uid[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i, side="left")
        top = np.arange(len(i)) - first < k
        names = queries.column("uid").to_numpy()
        return pa.table([pa.array(names[i[top]]), pa.array(score[top]), vectors.column("ids").combine_chunks().take(pa.array(j[top]))], schema=schema)

    return run


def placed(index: Index, p: int, query: bool):
    """Adds the numbers of the nearest p lists to rows (uid, v, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = index.nearest(index.turned(matrix(batch.column("v")), query), p)
                lists = pa.ListArray.from_arrays(np.arange(0, at.size + 1, at.shape[1], dtype=np.int32), pa.array(at.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "lists"])

    return run


def parts(counts: dict[int, int], size: int) -> Column:
    """Number of blocks of each list (bounded by the number of lists)."""
    n = F.create_map(*[x for k, c in counts.items() for x in (F.lit(k), F.lit(max(1, -(-c // size))))]) if counts else F.create_map(F.lit(-1), F.lit(1))
    return F.coalesce(n[F.col("list")], F.lit(1))


def search(df: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which ``is_query`` (on ``vec_id``) holds."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where("forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity')) AND exists(v, c -> c <> 0)")
    widths = [x["d"] for x in rows.select(F.size("v").alias("d")).distinct().orderBy("d").limit(2).collect()]
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not widths:
        return empty
    if len(widths) > 1:
        raise ValueError(f"vectors of {widths[0]} and of {widths[1]} components have no inner product")
    # The k + 1 smallest identifiers of each distinct vector; the limit holds before rows are dealt out.
    ranked = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    distinct = written(ranked.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("uid"), "v", "ids"), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    n, longest = distinct.agg(F.count(F.lit(1)), F.max(norm)).first()
    sample = distinct.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("v").collect()
    index = Index(np.array([r["v"] for r in sample]), longest, n, target, k)
    columns = "uid long, v array<double>, ids array<long>, lists array<int>"
    held = written(distinct.mapInArrow(placed(index, 1, False), columns).withColumn("list", F.col("lists")[0]).drop("lists"), "lists")
    asked = rows.where(is_query).select("vec_id", "v").distinct()
    # A query's vector is searched once for all queries that have it.
    asked = written(asked.join(distinct.select("v", "uid"), "v").select("vec_id", "uid"), "queries")
    seekers = distinct.join(asked.select("uid").distinct(), "uid", "left_semi").select("uid", "v", F.array().cast("array<long>").alias("ids"))
    probes = written(seekers.mapInArrow(placed(index, index.probes, True), columns).select("uid", "v", F.explode("lists").alias("list")), "probes")
    sizes = {r["list"]: r["n"] for r in held.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    asks = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    own, other = (F.pmod(F.xxhash64(F.lit(s), F.col("uid")), n).cast("int") for s, n in ((1, parts(sizes, BLOCK)), (2, parts(asks, QUERIES))))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = probes.withColumn("part", other).withColumn("block", every(parts(sizes, BLOCK))).select("list", "block", "part", "uid", "v")
    right = held.withColumn("block", own).withColumn("part", every(parts(asks, QUERIES))).select("list", "block", "part", "uid", "v", "ids")
    by = ["list", "block", "part"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(scanner(index, k + 1), "q long, score double, ids array<long>")
    found = found.select("q", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")
    each = asked.withColumnRenamed("vec_id", "query_id").join(found, F.col("uid") == F.col("q")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
