"""Centroid clustering of vectors, exact in integers, screened by block norms.

Vectors of exactly ``SIZE`` components, none null or non-finite, become integers
floor(1024 * x).  The centroids start as the ``CENTROIDS`` vectors with the smallest
SHA-256 of ``3:<vec_id>``; each of ``ROUNDS`` rounds assigns all vectors to the nearest
centroid (ties: the smaller number) and moves each centroid that has any to the floor
of their mean; then all are assigned once more.

Screening: a vector's segments of ``SEGMENT`` components are compressed to their norms,
once.  By Cauchy-Schwarz |x - c|^2 >= sum over segments of (|x_s| - |c_s|)^2, so the
norms alone bound each distance from below.  The centroid with the least bound is
measured first; only those whose bound does not exceed that distance (less a margin for
rounding) are measured too, in exact integers.

Each round is one pass over the written vectors: tasks add up their clusters, Spark
adds the tasks' sums, and the driver gathers one number for each centroid and component
(and for each further 60 bits of it, where components are huge).

Defined results: other vectors give no row; with fewer vectors than centroids each is a
start; repeated vec_ids are told apart by their components, and null ones come last
among the starts; equal starts leave all but the first empty.  Components beyond 2**27
are computed with Python's integers, and a distance or inertia that no long can hold
is null.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.llm.common import Tables, dealt_table, stored

SIZE, SEGMENT, CENTROIDS, ROUNDS, SCALE = 64, 8, 8, 10, 1024
#: With components up to here, distances and a task's sums are exact in 64 bits.
SAFE = 1 << 27
LIMB = 60
_VECTORS = "vec_id long, v array<long>, large array<string>, norms array<double>"


def usable(embedding: Column) -> Column:
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & (F.size(embedding) == SIZE) & whole


def _whole(x: float) -> int:
    """floor(1024 * x), also where 1024 * x is beyond a double."""
    return int(x) * SCALE if abs(x) > 2.0**53 else int(np.floor(x * SCALE))


def segment_norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(np.float64) ** 2).reshape(len(v), -1, SEGMENT).sum(2))


def vectors_of(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (integers), large (where they are beyond ``SAFE``), norms."""
    doubles = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x")).where(usable(F.col("x")))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            x = b.column(1).flatten().to_numpy().reshape(-1, SIZE)
            fits = (np.abs(x) < SAFE / SCALE).all(1)
            v = np.floor(np.where(fits[:, None], x, 0) * SCALE).astype(np.int64)
            norms = segment_norms(v)
            large = [None if ok else [str(_whole(c)) for c in row] for ok, row in zip(fits.tolist(), x.tolist(), strict=True)] if not fits.all() else [None] * len(x)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(v, fits), pa.array(large, pa.list_(pa.string())), _lists(norms, fits)], names=["vec_id", "v", "large", "norms"])

    return doubles.mapInArrow(batches, _VECTORS)


def _lists(x: np.ndarray, present: np.ndarray) -> pa.Array:
    """Rows as lists, null where not present."""
    ends = np.concatenate([[0], np.cumsum(np.where(present, x.shape[1], 0))]).astype(np.int32)
    mask = None if present.all() else pa.array(~present)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x[present].ravel()), mask=mask)


def _read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray | None]:
    """Components and norms of a batch; with a large one among them, Python's integers
    and no norms."""
    v, large = b.column(1), b.column(2)
    if large.null_count == len(large):
        return v.flatten().to_numpy().reshape(-1, SIZE), b.column(3).flatten().to_numpy().reshape(len(b), -1)
    rows = [[int(c) for c in (a or z)] for a, z in zip(v.to_pylist(), large.to_pylist(), strict=True)]
    return np.array(rows, object), None


def assigned(v: np.ndarray, norms: np.ndarray | None, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector."""
    fits = norms is not None and all(abs(c) <= SAFE for row in centroids for c in row)
    c = np.array(centroids, np.int64 if fits else object)
    if not fits:
        d = np.array([((v - row) * (v - row)).sum(1) for row in c], object).T
        best = np.array([min(range(len(c)), key=lambda k, r=r: r[k]) for r in d], np.int64)
        return best, d[np.arange(len(v)), best]
    of = segment_norms(c)
    least = ((norms[:, None, :] - of[None]) ** 2).sum(2)
    margin = 1 + 1e-12 * ((norms**2).sum(1)[:, None] + (of**2).sum(1)[None])
    first = least.argmin(1)
    d = np.full(least.shape, np.iinfo(np.int64).max)
    d[np.arange(len(v)), first] = ((v - c[first]) ** 2).sum(1)
    row, k = np.nonzero(least - margin <= d[np.arange(len(v)), first][:, None])
    d[row, k] = ((v[row] - c[k]) ** 2).sum(1)
    best = d.argmin(1)  # the first of equal ones
    return best, d[np.arange(len(v)), best]


def _sums(vectors: DataFrame, centroids: list[list[int]]) -> dict[tuple[int, int], int]:
    """Sum of each cluster and component, and each cluster's count as component -1."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(centroids), SIZE), object), np.zeros(len(centroids), np.int64)
        for b in rows:
            if not b.num_rows:
                continue
            v, norms = _read(b)
            best, _ = assigned(v, norms, centroids)
            n += np.bincount(best, minlength=len(n))
            for k in np.unique(best):
                total[k] += v[best == k].sum(0)
        out = []
        for k in np.flatnonzero(n).tolist():
            for dim, x in enumerate([*total[k].tolist(), int(n[k])]):
                x, limb = int(x), 0
                while True:  # 60 bits each, the last one with the sign
                    last = -(1 << LIMB) <= x < 1 << LIMB
                    out.append((k, dim if dim < SIZE else -1, limb, x if last else x & (1 << LIMB) - 1))
                    if last:
                        break
                    x, limb = x >> LIMB, limb + 1
        columns = [list(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["cluster", "dim", "limb", "x"])

    parts = vectors.mapInArrow(batches, "cluster int, dim int, limb int, x long")
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "dim", "limb").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        key = (r["cluster"], r["dim"])
        out[key] = out.get(key, 0) + (int(r["x"]) << LIMB * r["limb"])
    return out


def starts(vectors: DataFrame) -> list[list[int]]:
    by_hash = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(by_hash.asc_nulls_last(), "v", "large").limit(CENTROIDS).select("v", "large").collect()
    return [[int(c) for c in (r["v"] or r["large"])] for r in rows]


def clusters(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = embeddings.sparkSession
    with Tables(spark, "clusters") as tables:
        vectors = tables.put(vectors_of(embeddings), "vectors")
        centroids = starts(vectors)
        for _ in range(ROUNDS):
            sums = _sums(vectors, centroids)
            centroids = [[sums[k, i] // sums[k, -1] for i in range(SIZE)] if (k, -1) in sums else c for k, c in enumerate(centroids)]

        def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows:
                best, d = assigned(*_read(b), centroids) if b.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                d = [int(x) if x < 1 << 63 else None for x in d.tolist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

        found = stored(vectors.mapInArrow(batches, "vec_id long, cluster int, distance long"), "clusters")
    # a row for each centroid
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    of = found.groupBy("cluster").agg(whole.alias("in_cluster"))
    everything = Window.partitionBy()
    all_ = F.when(F.count("in_cluster").over(everything) == F.count("*").over(everything), F.sum("in_cluster").over(everything))
    of = of.select("cluster", F.col("in_cluster").try_cast("long").alias("cluster_inertia"), all_.try_cast("long").alias("inertia"))
    names = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    of = of.join(F.broadcast(spark.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_block_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(dealt_table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds written out, one after the other."""
    distance = "list_sum(list_transform(list_zip(v.e, s.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    nearest = "SELECT v.vec_id, v.e, s.c, {d} AS d FROM v, s{i} s QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY {d}, s.c) = 1"
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(i=i, d=distance)})")
        if i < ROUNDS:
            mean = f"SELECT c, k, sum(x) AS x, count(*) AS n FROM (SELECT c, unnest(e) AS x, unnest(range(1, {SIZE + 1})) AS k FROM a{i}) GROUP BY c, k"
            moved = f"SELECT c, list(((x - ((x % n) + n) % n) // n)::BIGINT ORDER BY k) AS e FROM ({mean}) GROUP BY c"
            steps.append(f"s{i + 1} AS MATERIALIZED (SELECT s.c, coalesce(m.e, s.e) AS e FROM s{i} s LEFT JOIN ({moved}) m ON m.c = s.c)")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}
), s0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, e FROM v ORDER BY c LIMIT {CENTROIDS}
), {", ".join(steps)}
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(s.e, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN s{ROUNDS} s ON s.c = a.c"""


QUERIES = {"op13_block_norms": op13_block_norms}
ORACLES = {"op13_block_norms": _sql()}
