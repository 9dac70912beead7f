"""Centroid clustering of integer vectors by bit planes and weighted popcounts.

A component is an integer of P bits in two's complement.  Bit p of 64 components is one uint64, the
bit plane p of a vector; the top plane weighs -2^(P-1), plane p below it 2^p.  The inner product of
a vector v and a centroid c is then the sum over pairs of planes of

    weight(p) * weight(q) * popcount(v_p AND c_q)

in exact integers, and their squared distance is v.v - 2 v.c + c.c, each term by the same count.
P follows the data: embeddings of a few hundred distinct values have eight planes, 64 bytes a vector.

Planes are packed once and landed.  A round sends the centroids (k vectors) out, and every task adds
up its batches into one row for each centroid and dimension, so that a round shuffles a few rows a task
whatever the number of vectors, and one vector that a third of all rows repeat is no hot key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlens.llm.common import landed

#: Centroids, rounds and components of a vector; what components are multiplied with before their floor.
K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64.0
#: Components count as this at most, so that a squared distance of 2^10 components fits 64 bits.
LARGEST = 1 << 26
#: Vectors whose planes are compared at a time.
BATCH = 1 << 13


def weights(planes: int) -> np.ndarray:
    """What a bit of each plane stands for, in two's complement."""
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def to_planes(vectors: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes of integer vectors (one row each): uint64 of shape (rows, planes, words), 64 components a word."""
    n, dims = vectors.shape
    words = -(-dims // 64)
    bits = np.zeros((n, planes, words * 64), dtype=np.uint8)
    for p in range(planes):
        bits[:, p, :dims] = (vectors >> p) & 1
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")


def from_planes(planes: np.ndarray, dims: int) -> np.ndarray:
    """The integer vectors again."""
    bits = np.unpackbits(planes.view(np.uint8), axis=2, bitorder="little")[:, :, :dims].astype(np.int64)
    return np.tensordot(weights(planes.shape[1]), bits, axes=(0, 1))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all vectors of ``left`` with all of ``right``, from their planes: int64 of shape (left, right)."""
    wl, wr = weights(left.shape[1]), weights(right.shape[1])
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for p in range(left.shape[1]):
        for q in range(right.shape[1]):
            shared = np.zeros(out.shape, dtype=np.int64)
            for w in range(left.shape[2]):
                shared += np.bitwise_count(left[:, p, w, None] & right[None, :, q, w])
            out += wl[p] * wr[q] * shared
    return out


def squares(planes: np.ndarray) -> np.ndarray:
    """Inner product of each vector with itself."""
    w, out = weights(planes.shape[1]), np.zeros(len(planes), dtype=np.int64)
    for p in range(planes.shape[1]):
        for q in range(p, planes.shape[1]):
            shared = np.bitwise_count(planes[:, p] & planes[:, q]).sum(axis=1, dtype=np.int64)
            out += w[p] * w[q] * shared * (1 if p == q else 2)
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector (ties: the smaller one) and its squared distance."""
    far = squares(planes)[:, None] - 2 * products(planes, centroids) + squares(centroids)[None, :]
    best = far.argmin(axis=1)
    return best, far[np.arange(len(best)), best]


def whole(vector: Column, scale: float) -> Column:
    """Components as integers: floor(scale * x), within +-LARGEST."""
    scaled = lambda x: F.least(F.greatest(x.cast("double") * F.lit(scale), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
    return F.transform(vector, lambda x: F.floor(scaled(x)).cast("int"))


def cluster(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, id_column: str = "vec_id", vector: str = "embedding",
    dims: int = DIMS, scale: float = SCALE, seed: int = 1,
) -> DataFrame:
    """Clusters of the vectors with exactly ``dims`` components, none null or non-finite: one row each.

    Returns id, cluster, distance (squared, long), cluster_inertia, inertia (distance summed over the cluster and over all) and centroid
    (array of the final centroid's components).  Components become floor(scale * x), those beyond +-2^26 count as +-2^26.  Centroids 0, 1, ...
    start as the k vectors with the smallest SHA-256 of ``seed:id``; each round assigns every vector to the nearest centroid (ties: smaller number) and
    replaces every non-empty one by the floor of its vectors' mean.  Rows that repeat an id take part each; equal hashes are ordered by
    vector; null ids come last as starting vectors and take part like any other.  Fewer than k vectors start as many centroids as there
    are; vectors of other lengths give no row; no vectors give no rows; other columns are not read.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_column].dataType.simpleString()
    sound = ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) == dims) & F.coalesce(sound, F.lit(False)))
    rows = kept.select(F.col(id_column).alias("id"), whole(F.col(vector), scale).alias("v"))
    extremes = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    lowest, highest = (x or 0 for x in extremes)
    planes = max(int(highest).bit_length(), int(-lowest - 1).bit_length() if lowest < 0 else 0) + 1
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(mark.asc_nulls_last(), "v").limit(k).select("v").collect()  # k vectors
    centroids = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), dims)
    words = -(-dims // 64)

    def pack(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, dims)
            packed = [to_planes(flat[i : i + BATCH], planes) for i in range(0, batch.num_rows, BATCH)]
            raw = [row.tobytes() for part in packed for row in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "planes"])

    ready = landed(rows.mapInArrow(pack, f"id {kind}, planes binary"), "planes")

    def of(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(len(column), planes, words)

    def sums_with(centres: np.ndarray):
        def add(batches):
            coded = to_planes(centres, planes)
            total, count = np.zeros((len(centres), dims), dtype=np.int64), np.zeros(len(centres), dtype=np.int64)
            for batch in batches:
                every = of(batch.column(0))
                for i in range(0, len(every), BATCH):
                    part = every[i : i + BATCH]
                    best, _ = nearest(part, coded)
                    count += np.bincount(best, minlength=len(centres))
                    np.add.at(total, best, from_planes(part, dims))
            used = np.flatnonzero(count)
            cols = [np.repeat(used, dims), np.tile(np.arange(dims), len(used)), total[used].ravel(), np.repeat(count[used], dims)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["cluster", "dim", "total", "n"])

        return add

    for _ in range(rounds if len(centroids) else 0):
        parts = ready.select("planes").mapInArrow(sums_with(centroids), "cluster long, dim long, total long, n long")
        moved = parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # k * dims rows
        centroids = centroids.copy()
        for r in moved:
            centroids[r["cluster"], r["dim"]] = r["total"] // r["n"]

    def assign(batches):
        coded = to_planes(centroids, planes)
        for batch in batches:
            every = of(batch.column(1))
            found = [nearest(every[i : i + BATCH], coded) for i in range(0, len(every), BATCH)]
            best, far = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (list(zip(*found, strict=True)) or [(), ()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), pa.array(far)], names=["id", "cluster", "distance"])

    assigned = landed(ready.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "assigned")
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    of_cluster = {r["cluster"]: r["cluster_inertia"] for r in inertia}
    names = [F.lit(of_cluster.get(c, 0)).cast("long") for c in range(len(centroids))] or [F.lit(0).cast("long")]
    centres = [F.array(*(F.lit(int(x)) for x in row)).cast("array<int>") for row in centroids] or [F.array().cast("array<int>")]
    return assigned.select(
        F.col("id").alias(id_column), "cluster", "distance", F.element_at(F.array(*names), F.col("cluster") + 1).alias("cluster_inertia"),
        F.lit(sum(of_cluster.values())).cast("long").alias("inertia"), F.element_at(F.array(*centres), F.col("cluster") + 1).alias("centroid"),
    )


def digest(vector: list[int]) -> str:
    """SHA-256 of components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, vector)).encode()).hexdigest()
