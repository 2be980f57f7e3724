"""Operator 12: k-means on integer vectors with Hamerly's bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import discard, durable, scratch

COMPONENTS, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
#: Integers are held within this, so that every squared distance of 64 components fits a long.
BOUND = 1 << 27
#: Up to this size of integers, products of matrices are exact in double precision.
EXACT = 1 << 20
#: Relative slack of bounds: far above the rounding of a square root or a sum, far below what a bound gains.
SLACK = 1e-12
LONGEST = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Not null, and no entry null or non-finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))), F.lit(False))


def scaled(vector: Column, scale: int, bound: int) -> Column:
    """floor(scale * component) of every component as a double, then a long, held within the bound."""
    held = lambda e: F.least(F.greatest(e.cast("double") * scale, F.lit(float(-bound))), F.lit(float(bound)))
    return F.transform(vector, lambda e: F.floor(held(e)).cast("long"))


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(finite(F.col("v")) & (F.size("v") == COMPONENTS)).select("vec_id", scaled(F.col("v"), SCALE, BOUND).alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of least sha256 of seed and vec_id; rows without vec_id come last, equal hashes by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(order.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()  # k rows
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), COMPONENTS)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every row of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def to_own(x: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - c[cluster]) ** 2).sum(1)


def assigned(x: np.ndarray, c: np.ndarray, drift: np.ndarray, half_gap: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower, scanned) after one round.

    `upper` is no less than the distance to the own centroid, `lower` no more than that to any other one. The own centroid's
    drift loosens the one, the largest drift of the others the other. A vector whose upper bound stays below the lower one, or below half
    the way from its centroid to the next one, keeps its centroid without a tie; else the upper bound is made exact, and what
    is ambiguous still has its distances to all centroids taken as integers, equal ones going to the smaller number.
    """
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    known = cluster >= 0
    own = np.where(known, cluster, 0)
    if len(c) > 1:
        top = np.argsort(drift)[::-1]
        others = np.where(own == top[0], drift[top[1]], drift[top[0]])
    else:
        others = np.zeros(len(x))
    upper = (upper + drift[own]) * (1 + SLACK)
    lower = np.maximum(0.0, lower - others) * (1 - SLACK)
    limit = np.maximum(lower, half_gap[own])
    doubt = np.flatnonzero(~known | (upper >= limit))
    tight = doubt[known[doubt]]
    upper[tight] = np.sqrt(to_own(x[tight], c, own[tight]).astype(np.float64)) * (1 + SLACK)
    doubt = doubt[~known[doubt] | (upper[doubt] >= limit[doubt])]
    if len(doubt):
        d = squared(x[doubt], c)
        best = d.argmin(1)  # the first of equal ones
        near = np.take_along_axis(d, best[:, None], 1)[:, 0]
        np.put_along_axis(d, best[:, None], LONGEST, 1)
        cluster[doubt] = best
        upper[doubt] = np.sqrt(near.astype(np.float64)) * (1 + SLACK)
        lower[doubt] = np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK) if len(c) > 1 else np.inf
    scanned = np.zeros(len(x), bool)
    scanned[doubt] = True
    return cluster, upper, lower, scanned


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


STATE = "vec_id long, x array<long>, cluster int, was int, upper double, lower double, scanned boolean"


def one_round(state: DataFrame, c: np.ndarray, moved: np.ndarray) -> DataFrame:
    """Every vector's cluster among `c`; `moved` is how far each centroid went since the bounds were written."""
    gaps = np.sqrt(squared(c, c).astype(np.float64))
    np.fill_diagonal(gaps, np.inf)
    half_gap = gaps.min(1) / 2 * (1 - SLACK)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cluster, upper, lower = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 4, 5))
                new = assigned(matrix(b.column(1)), c, moved, half_gap, cluster, upper, lower)
                cols = [b.column(0), b.column(1), pa.array(new[0].astype(np.int32)), b.column(2), *map(pa.array, new[1:])]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "x", "cluster", "was", "upper", "lower", "scanned"])

    return state.mapInArrow(assign, STATE)


def changes(state: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed their cluster add to the sums and counts of clusters: exact, k rows of 64 on the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, COMPONENTS), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x = matrix(b.column(0)) if b.num_rows else np.zeros((0, COMPONENTS), np.int64)
            for column, sign in ((1, 1), (2, -1)):
                of = b.column(column).to_numpy()
                for cluster in np.unique(of[of >= 0]):
                    sums[cluster] += sign * x[of == cluster].sum(0)
                    counts[cluster] += sign * int((of == cluster).sum())
        flat = np.concatenate([sums, counts[:, None]], 1).ravel()
        hit = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(flat[hit])], ["at", "n"])

    parts = state.where("cluster <> was").select("x", "cluster", "was").mapInArrow(add, "at int, n long")
    out = np.zeros(k * (COMPONENTS + 1), object)
    for r in parts.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():  # k * 65 rows at most
        out[r["at"]] = int(r["n"])
    out = out.reshape(k, COMPONENTS + 1)
    return out[:, :COMPONENTS], out[:, COMPONENTS]


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of 64 finite components.

    Components become floor(256 * component), held to +-2^27; distances are squared and exact. Other vectors are left out. Repeated rows, and rows that
    share a vec_id, are vectors of their own; a null vec_id is one like any other but comes last among first centroids. With fewer than k vectors all
    are centroids. Sums over 2^63 - 1 are given as that. An empty table gives none; other columns are ignored.

    Bounds lie with the vectors in a table that each round writes anew; sums change by the vectors that changed their cluster.
    """
    with scratch() as keep:
        vectors = kept_vectors(embeddings.select("vec_id", "embedding"))
        c = first_centroids(vectors, k, seed)
        if not len(c):
            return keep(finished(vectors.withColumn("cluster", F.lit(0)), c))
        k = len(c)
        state = vectors.select("vec_id", "x", *(F.lit(v).cast(t).alias(n) for n, v, t in (("cluster", -1, "int"), ("was", -1, "int"), ("upper", 0, "double"), ("lower", 0, "double"), ("scanned", False, "boolean"))))
        sums, counts, moved = np.zeros((k, COMPONENTS), object), np.zeros(k, object), np.zeros(k)
        for turn in range(rounds + 1):
            old, state = state, durable(one_round(state, c, moved))
            if turn:
                discard(old)
            if turn == rounds:
                break
            more = changes(state, k)
            sums, counts = sums + more[0], counts + more[1]
            new = np.array([[s // n for s in row] if n else list(at) for row, n, at in zip(sums, counts, c)], np.int64)
            moved = np.sqrt(((new - c) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
            c = new
        return keep(finished(state, c))


def finished(state: DataFrame, c: np.ndarray) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = b.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(to_own(matrix(b.column(1)), c, own))], ["vec_id", "cluster", "distance"])

    rows = durable(state.select("vec_id", "x", "cluster").mapInArrow(measure, "vec_id long, cluster int, distance long"))
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    named = [(i, min(sums.get(i, 0), LONGEST), min(sum(sums.values()), LONGEST), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(c.tolist())]
    of = state.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
