"""Helpers shared by the operators: durable tables, distributed ranks, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a lookup table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000

#: Bytes of an Arrow batch that a Python worker is handed; a single longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as `spark.checkpoint.dir` names it. Only a local session may do without: it
    has one machine, and gets a temporary folder."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wakeline"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


#: Paths that durable() wrote within the innermost scratch().
_written: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("written", default=None)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands Python at most BATCH_BYTES at once.

    An executor holds a batch several times over for every task, on both sides of the socket and outside its heap, and
    what Spark hands out by default (64 MB) adds up to hundreds of MB. A lower setting of the session's own stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, None) or "0")
    if not 0 < own <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def durable(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends, a lost executor loses nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/wakeline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wakeline_path = path
    if (own := _written.get()) is not None:
        own.append((spark, path))
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a durable table nothing will read again."""
    delete(df.sparkSession, df._wakeline_path)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Durable tables written inside are deleted at the end, but for those made by the `keep` this yields.

    A table that a result still reads, as it is not computed before its action, stays in the shared folder until
    the scratch() around it ends; corpus_pipeline.run has one for every stage.
    """
    outer, kept = _written.get(), []
    token = _written.set([])

    def keep(df: DataFrame) -> DataFrame:
        out = durable(df)
        kept.append(out._wakeline_path)
        return out

    try:
        yield keep
    finally:
        own = _written.get()
        _written.reset(token)
        for spark, path in own:
            if path not in kept:
                delete(spark, path)
            elif outer is not None:
                outer.append((spark, path))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or not name.startswith("_"):
        name = f"_{name}"
    return name


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose row count was measured and is small; else leave the join to a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def dense_rank_rows(df: DataFrame, group: list[str], bucket: Column, order: list, out: str, buckets: int) -> DataFrame:
    """Gapless positions from 0 within each group, in bucket order and then by `order`.

    No task sees a whole group: rows are counted by (group, bucket), the small table of counts is
    summed up, and each bucket is numbered on its own. `buckets` bounds the table of counts per group.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    if buckets <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        df.join(offsets, [*group, "_bucket"])
        .withColumn(out, (F.row_number().over(inside) - 1 + F.col("_offset")).cast("long"))
        .drop("_bucket", "_offset")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) edges by randomised contraction: (node, component = least node).

    Each round every node joins the neighbour (or itself) with the least hash, and edges are
    redrawn between the chosen nodes, so the graph shrinks by a constant factor a round. Nodes
    without an edge do not appear. Nothing is collected; every round ends in a written table.
    """
    with scratch() as keep:
        edges = durable(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
        maps, turn = [], 0
        while edges.head(1):
            turn += 1
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            ranked = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), c.alias("n"))
            near = both.groupBy("u").agg(F.min(ranked(F.col("v"))).alias("m"))
            step = durable(near.select("u", F.least(F.col("m"), ranked(F.col("u")))["n"].alias("r")))
            jump = step.join(step.select(F.col("u").alias("r"), F.col("r").alias("r2")), "r")
            step = durable(jump.select("u", F.col("r2").alias("r")))
            maps.append(step)
            left = step.select("u", F.col("r").alias("ru"))
            right = step.select(F.col("u").alias("v"), F.col("r").alias("rv"))
            redrawn = edges.join(left, "u").join(right, "v").where("ru <> rv")
            drawn = durable(redrawn.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
            discard(edges)
            edges = drawn
        if not maps:
            return keep(edges.select(F.col("u").alias("node"), F.col("v").alias("component")))
        roots = maps[0].select(F.col("u").alias("node"), "r")
        for step in maps[1:]:
            roots = roots.join(step.select(F.col("u").alias("r"), F.col("r").alias("r2")), "r", "left")
            roots = roots.select("node", F.coalesce("r2", "r").alias("r"))
        roots = durable(roots)
        least = roots.groupBy("r").agg(F.min("node").alias("component"))
        return keep(roots.join(least, "r").select("node", "component"))
