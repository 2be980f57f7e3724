"""Operator 13: whitening of vectors by a two-pass covariance and a symmetric eigendecomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.centroids import finite, scaled
from wakeline.llm.common import durable, scratch

SCALE, COMPONENTS = 256, 4
#: Integers are held within this, so that sums over four million rows of a task fit a long.
BOUND = 1 << 40
#: A variance under this share of the largest one is none: the projection on such a component is zero.
NO_SPREAD = 1e-12
LONGEST = (1 << 63) - 1


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of longs; what a shorter vector lacks is zero."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == d).all():
        return flat.reshape(len(column), d)
    out = np.zeros((len(column), d), np.int64)
    out[np.arange(d)[None, :] < lengths[:, None]] = flat
    return out


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows, and the sum of every dimension, as integers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 1, np.int64)
        for b in batches:
            total[:d] += matrix(b.column(0), d).sum(0)
            total[d] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1, dtype=np.int32)), pa.array(total)], ["at", "n"])

    sums = {r["at"]: int(r["n"]) for r in fit.select("x").mapInArrow(add, "at int, n long").groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()}  # d + 1 rows
    return sums[d], [sums[i] for i in range(d)]


def outer_sums(fit: DataFrame, d: int, centred) -> np.ndarray:
    """The sum of the outer products of `centred` rows: one matrix a task, merged by a tree of tasks."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            y = centred(matrix(b.column(0), d))
            total = total + y.T @ y
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = fit.select("x").mapInArrow(products, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"]))
    flat = parts.treeAggregate(None, lambda a, b: b if a is None else a + b, lambda a, b: b if a is None else a if b is None else a + b)
    size = int(np.sqrt(len(flat)))
    return flat.reshape(size, size)


def centring(n: int, sums: list[int]):
    """x - S/n of integer rows: the whole part of the mean is taken off as integers, the rest, under one, in double precision."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return lambda x: (x - whole).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """sum((n * x - S)^2) of every row, exact; over 2^63 - 1 it is given as that."""
    largest = max([int(np.abs(x).max(initial=0)) * n + abs(s) for s in sums], default=0)
    if len(sums) * largest * largest <= LONGEST:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    return [min(sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)), LONGEST) for row in x]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every finite vector and leading component.

    Entries become floor(256 * entry), held to +-2^40. The mean and covariance are over distinct vectors, each once; equal rows, and rows
    that share a vec_id, have rows of their own in the result. Vectors that are null or hold null or non-finite entries are left out.
    A vector shorter than the longest one counts as zero beyond its end; with d < 4 dimensions there are d components. Without spread
    along a component `whitened` is 0 there, `explained` 0 where there is none at all, and identity_error is over components with spread.
    An empty table gives none; a null vec_id is one like any other; other columns are ignored.
    """
    with scratch() as keep:
        rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
        rows = rows.where(finite(F.col("v"))).select("vec_id", scaled(F.col("v"), SCALE, BOUND).alias("x"))
        d = rows.agg(F.max(F.size("x"))).first()[0] or 0
        kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        if not d:
            return keep(rows.sparkSession.createDataFrame([], kinds))
        padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))
        fit = durable(rows.select(padded.alias("x")).distinct())
        n, sums = exact_sums(fit, d)
        centred = centring(n, sums)
        values, vectors = np.linalg.eigh(outer_sums(fit, d, centred) / n)
        e, w = values[::-1][:components], vectors[:, ::-1][:, :components]
        spread = e > NO_SPREAD * max(float(e[0]), 0.0)
        whole = float(values.sum())
        explained = np.where(whole > 0, e / (whole or 1.0), 0.0)
        w = np.where(spread, w / np.sqrt(np.where(spread, e, 1.0)), 0.0)
        back = outer_sums(fit, d, lambda x: centred(x) @ w) / n
        off = np.abs(back - np.eye(len(e)))[np.ix_(spread, spread)]
        error = float(off.max(initial=0.0))
        count = len(e)

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column(1), d)
                    y = centred(x) @ w
                    at = pa.array(np.repeat(np.arange(len(x)), count))
                    size = len(at)
                    cols = [b.column(0).take(at), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(size, n)), pa.array(deviations(x, n, sums), pa.int64()).take(at)]
                    cols += [pa.array(y.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(size, error))]
                    yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return keep(rows.mapInArrow(project, kinds))
