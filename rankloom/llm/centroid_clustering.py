"""Centroid clustering of integer vectors with an incremental distance matrix.

Every vector keeps its exact integer dot products with all centroids, in a stored table.  When
a centroid moves, only its components that changed enter: ``dot += v[changed] . change``.  The
squared distance is ``|v|^2 - 2 dot + |c|^2``, so a round is one narrow pass that updates the
products, takes the argmin again and writes the table of the next round; nothing but sums per
cluster is shuffled.

The driver holds the centroids alone (k times the dimension).  All arithmetic is on integers:
a component beyond ``LARGEST`` could push a distance out of 64 bits and stops the job with a
message instead of giving a wrong distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.staging import discarded, stored

DIMENSION = 64
CLUSTERS = 40
ROUNDS = 5
#: Largest component of a vector, and so of a centroid: 64 * (2 * 2**27)**2 is below 2**63.
LARGEST = 1 << 27
BATCH_ROWS = 4096

_STATE = "vec_id long, v array<int>, norm long, dots array<long>, cluster int, distance long"


def integer_vectors(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = DIMENSION) -> DataFrame:
    """``vec_id``, ``v`` (array of int, floor(256 * x)) of the rows whose vector has ``dimension`` finite components.

    Null vectors, other lengths and null or non-finite components leave the row out; repeated
    rows and null ids stay.
    """

    def finite(e: Column) -> Column:
        return F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))

    def component(e: Column) -> Column:
        return F.when(F.abs(e) * 256 <= LARGEST, F.floor(e * 256).cast("int")).otherwise(F.raise_error(F.lit(f"a component of a vector is beyond {LARGEST} / 256")).cast("int"))

    rows = frame.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.where(F.coalesce(F.size("x") == dimension, F.lit(False)) & F.forall("x", finite)).select("vec_id", F.transform("x", component).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str, dimension: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed`` and the id (null: no digits), ties by component."""
    name = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64).reshape(len(rows), dimension)


def _matrix(column: pa.Array, rows: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(rows, -1)


def assigned(state: DataFrame, centroids: np.ndarray, change: np.ndarray) -> DataFrame:
    """``state`` with its dot products moved by ``change`` (k x dimension) and the argmin taken again.

    Ties go to the smaller number.
    """
    norms = (centroids * centroids).sum(axis=1)
    moved = [(k, np.flatnonzero(row)) for k, row in enumerate(change) if row.any()]
    n_centroids = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                n = batch.num_rows
                v = _matrix(batch.column("v"), n, np.int64)
                dots = _matrix(batch.column("dots"), n, np.int64).copy()
                for k, parts in moved:
                    dots[:, k] += v[:, parts] @ change[k, parts]
                norm = batch.column("norm").to_numpy()
                distances = norm[:, None] - 2 * dots + norms[None, :]
                cluster = distances.argmin(axis=1)
                offsets = pa.array(np.arange(0, (n + 1) * n_centroids, n_centroids), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), batch.column("norm"), pa.ListArray.from_arrays(offsets, pa.array(dots.ravel())), pa.array(cluster.astype(np.int32)), pa.array(distances[np.arange(n), cluster])],
                    names=["vec_id", "v", "norm", "dots", "cluster", "distance"],
                )

    return state.mapInArrow(run, _STATE)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the exact means of each cluster; a cluster without vectors stays where it is."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])])
    out = centroids.copy()
    for row in sums.collect():
        out[row.cluster] = [row[f"s{i}"] // row.n for i in range(centroids.shape[1])]
    return out


def clustered(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = DIMENSION, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "2:") -> DataFrame:
    """``vec_id``, ``cluster`` int, ``distance`` long, ``cluster_inertia``, ``inertia`` long, ``centroid_sha256``
    of every kept vector (see ``integer_vectors``).

    With fewer than ``k`` vectors there are as many centroids as vectors; an empty table gives no
    row.  Equal vectors fall into the same cluster.  Only the two named columns are read.
    """
    vectors = integer_vectors(frame, id_col, vector_col, dimension)
    centroids = first_centroids(vectors, k, seed, dimension)
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e.cast("long") * e.cast("long"))
    state = vectors.select("vec_id", "v", square.alias("norm"), F.array_repeat(F.lit(0).cast("long"), len(centroids)).alias("dots"))
    state = stored(assigned(state, centroids, centroids), "clusters")
    for _ in range(rounds):
        after = means(state, centroids)
        change, centroids = after - centroids, after
        if not change.any():
            break
        before, state = state, stored(assigned(state, centroids, change), "clusters")
        discarded(before)
    inertia = {r.cluster: r.d for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = [(c, d, sum(inertia.values()), names[c]) for c, d in inertia.items()]
    clusters = frame.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per cluster, at most k.
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int, rounds: int, seed: str) -> str:
    """The same rounds for DuckDB, distances from the components."""
    nearest = """a{r} AS MATERIALIZED (
SELECT row, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
  SELECT v.row, c.k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM parts v JOIN c{r} c ON v.dim = c.dim GROUP BY v.row, c.k) GROUP BY row)"""
    moved = """c{n} AS MATERIALIZED (
SELECT c.k, c.dim, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
  SELECT k, dim, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (
    SELECT a.k, v.dim, sum(v.x) AS s, count(*) AS n FROM a{r} a JOIN parts v USING (row) GROUP BY a.k, v.dim)) m ON m.k = c.k AND m.dim = c.dim)"""
    steps = []
    for r in range(rounds):
        steps += [nearest.format(r=r), moved.format(r=r, n=r + 1)]
    steps.append(nearest.format(r=rounds))
    return f"""WITH vectors AS MATERIALIZED (
SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIMENSION}),
parts AS MATERIALIZED (
SELECT row, generate_subscripts(embedding, 1) AS dim, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM vectors),
firsts AS (
SELECT row, row_number() OVER (ORDER BY sha256('{seed}' || coalesce(vec_id::VARCHAR, '')), list_transform(embedding, lambda e: floor(256 * e::DOUBLE))) - 1 AS k FROM vectors),
c0 AS MATERIALIZED (SELECT k, dim, x FROM firsts JOIN parts USING (row) WHERE k < {k}),
{", ".join(steps)},
names AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS name FROM c{rounds} GROUP BY k)
SELECT v.vec_id, a.k::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, n.name AS centroid_sha256
FROM a{rounds} a JOIN vectors v USING (row) JOIN names n ON n.k = a.k"""


SQL = _sql(CLUSTERS, ROUNDS, "2:")
