"""Operator 2: near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import components, durable, scratch

COSINE = 0.95
#: Reference points, drawn from a sample of vectors; nearest ones that describe a vector; shared ones that make a candidate.
PIVOTS, NEAREST, SHARED = 192, 6, 3
SAMPLE = 4096
#: Largest cosine between two pivots.
APART = 0.7
#: Members of an inverted list compared in one task; longer lists are compared block against block.
BLOCK = 2048
#: Runs of up to so many rows are compared all at once.
SHORT = 16


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Reference points from the `sample` vectors of least hash: each next one is the farthest from those chosen."""
    rows = vectors.orderBy("class", "v").limit(sample).select("v").collect()
    if not rows:
        return np.zeros((0, 1))
    length = max(len(r.v) for r in rows)
    x = unit(np.array([[*r.v, *[0.0] * (length - len(r.v))] for r in rows]))
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(pivots, len(x)):
        at = int(near.argmin())
        if near[at] > APART:  # pivots close together would order a cluster's members at random
            break
        chosen.append(at)
        near = np.maximum(near, x @ x[at])
    return x[chosen]


def permutation(x: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """Indices of the nearest pivots of each row, nearest first. Other lengths are cut or filled with zeros here only."""
    width = min(x.shape[1], pivots.shape[1])
    near = x[:, :width] @ pivots[:, :width].T
    nearest = min(nearest, len(pivots))
    top = np.argpartition(-near, nearest - 1, axis=1)[:, :nearest]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


def list_keys(top: np.ndarray, length: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every set of SHARED pivots of a row: rows that meet share that many pivots at least."""
    ordered = np.sort(top, 1)
    shared = min(SHARED, top.shape[1])
    keys = []
    for pick in combinations(range(top.shape[1]), shared):
        k = np.full(len(top), length, np.int64)
        for p in pick:
            k = k * (pivots + 1) + ordered[:, p] + 1
        keys.append(k)
    return np.tile(np.arange(len(top)), len(keys)), np.concatenate(keys)


def first_common(top_a: np.ndarray, top_b: np.ndarray, own: np.ndarray, pivots: int) -> np.ndarray:
    """Which pairs have `own` (SHARED pivots, in order) as their least common ones: a pair counts in that list only."""
    other = np.setdiff1d(np.arange(int(own.max())), own)
    if not len(other):
        return np.ones((len(top_a), len(top_b)), bool)
    one_hot = np.zeros((2, max(len(top_a), len(top_b)), pivots), np.float32)
    for at, top in enumerate((top_a, top_b)):
        np.put_along_axis(one_hot[at, : len(top)], top, 1, 1)
    return one_hot[0, : len(top_a)][:, other] @ one_hot[1, : len(top_b)][:, other].T == 0


def own_pivots(key: np.ndarray, shared: int, pivots: int) -> np.ndarray:
    """The pivots that a list's key names, in order."""
    return np.stack([key // (pivots + 1) ** k % (pivots + 1) - 1 for k in reversed(range(shared))], 1)


def short_runs(mark: np.ndarray, cid: np.ndarray, mult: np.ndarray, top: np.ndarray, v: np.ndarray, least: float, pivots: int) -> tuple:
    """(cid, links, a, b) of all links within runs of equal marks, the rows of all runs compared at once by offsets."""
    x = unit(v)
    shared = min(SHARED, top.shape[1])
    a, b = [], []
    for step in range(1, len(mark)):
        at = np.flatnonzero(mark[:-step] == mark[step:])
        if not len(at):
            break
        at = at[np.einsum("ij,ij->i", x[at], x[at + step]) >= least]
        common = (top[at][:, :, None] == top[at + step][:, None, :]).any(2)
        first = np.sort(np.where(common, top[at], np.iinfo(np.int32).max), 1)[:, :shared]
        # A pair counts in the list of its least common pivots only.
        at = at[(first == own_pivots(mark[at], shared, pivots)).all(1)]
        a.append(at)
        b.append(at + step)
    a, b = (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))
    return np.concatenate([cid[a], cid[b]]), np.concatenate([mult[b], mult[a]]), cid[a], cid[b]


def clean(x: DataFrame) -> DataFrame:
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    ok &= F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists("embedding", lambda e: e != 0)
    return x.withColumn("ok", F.coalesce(ok, F.lit(False)) & F.col("vec_id").isNotNull())


def near_vectors(embeddings: DataFrame, least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null vec_id, link
    with nothing: n_links 0, component_id their vec_id, kept. Vectors of different lengths do not link.
    Equal vectors form one class with a count, so copies are not paired; repeated rows, and rows that share a vec_id,
    count as vectors of their own. An empty table gives none; other columns are ignored.
    """
    with scratch() as keep:
        return keep(searched(embeddings, least))


def searched(embeddings: DataFrame, least: float) -> DataFrame:
    """near_vectors, reading tables that end with it."""
    exact = embeddings.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>")
    rows = clean(embeddings.select("vec_id", (F.col("embedding") if exact else F.col("embedding").cast("array<double>")).alias("embedding")))
    part = rows.schema["embedding"].dataType.elementType.simpleString()
    same = F.transform("embedding", lambda e: (e + F.lit(0.0)).cast(part))  # -0.0 is 0.0
    members = durable(rows.where("ok").select("vec_id", same.alias("v")).withColumn("class", F.xxhash64("v")))
    classes = members.groupBy("class", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"))
    # A class has a number of its own: two vectors may share a vec_id. The number holds once it is written.
    classes = durable(classes.select(F.monotonically_increasing_id().alias("cid"), "least", "mult", "class", "v"))
    pivots = choose_pivots(classes)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, lists = batch.column(0), batch.column(1)
            length = np.array([len(v) for v in lists])
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                x = unit(lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n))
                top = permutation(x, pivots)
                row, key = list_keys(top, int(n), len(pivots))
                flat = pa.array(top[row].astype(np.int32).ravel())
                tops = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * top.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([cid.take(pa.array(at[row])), pa.array(key), tops], ["cid", "key", "top"])

    lists = durable(classes.select("cid", "v").mapInArrow(index, "cid bigint, key bigint, top array<int>"))
    sizes = durable(lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = lists.join(sizes, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cid", "top")
    met = met.join(classes.select("cid", "mult", "v"), "cid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within each (key, lo, hi); rows come sorted, a group is at most two blocks."""
        room: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cut = np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1, [len(marks)]])
            small: list[np.ndarray] = []
            for i, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])):
                if lo == hi:
                    continue
                goes_on = last is not None and tuple(marks[lo]) == last
                if room and not goes_on:
                    yield from links_of(room)
                    room = []
                last = tuple(marks[lo])
                if room or i == len(cut) - 2 or hi - lo > SHORT or marks[lo, 2]:  # block against block is never short
                    room.append(batch.slice(lo, hi - lo))
                else:
                    small.append(np.arange(lo, hi))
            if small:
                yield from runs_of(batch.take(pa.array(np.concatenate(small))))
        if room:
            yield from links_of(room)

    def runs_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, cid, mult = (batch.column(i).to_numpy() for i in (0, 4, 6))
        size = batch.column(7).value_lengths().to_numpy()
        for n in np.unique(size):  # a run's vectors have one length
            at = np.flatnonzero(size == n)
            own = batch.take(pa.array(at))
            top, v = (own.column(i).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1) for i in (5, 7))
            yield from packed(*short_runs(key[at], cid[at], mult[at], top, v, least, len(pivots)))

    def packed(cid: np.ndarray, links: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = max(len(cid), len(a))
        if n:
            pad = lambda z: pa.array(np.resize(z, n) if len(z) else np.zeros(n, np.int64), pa.int64(), mask=np.arange(n) >= len(z))
            yield pa.RecordBatch.from_arrays([pad(cid), pad(links), pad(a), pad(b)], ["cid", "links", "a", "b"])

    def links_of(room: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(room)
        if t.num_rows < 2:
            return
        key, lo, hi = (t.column(i)[0].as_py() for i in range(3))
        own = t.column(3).to_numpy()
        cid, mult = t.column(4).to_numpy(), t.column(6).to_numpy()
        top = np.stack(t.column(5).to_numpy())
        x = unit(np.stack(t.column(7).to_numpy()))
        picks = own_pivots(np.array([key]), min(SHARED, top.shape[1]), len(pivots))[0]
        links, a, b = np.zeros(len(cid), np.int64), [], []
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            near = (x[rows] @ x[right].T >= least) & first_common(top[rows], top[right], picks, len(pivots))
            if lo == hi:
                near &= rows[:, None] != right[None, :]
            links[rows] += near @ mult[right]
            if lo != hi:
                links[right] += near.T @ mult[rows]
            u, v = spanning(near, cid[rows], cid[right])
            a.append(u)
            b.append(v)
        if not a:
            return
        hit = np.flatnonzero(links)
        yield from packed(cid[hit], links[hit], np.concatenate(a), np.concatenate(b))

    spots = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    found = durable(spots.select("key", "lo", "hi", "own", "cid", "top", "mult", "v").mapInArrow(compare, "cid bigint, links bigint, a bigint, b bigint"))
    links = found.where("cid is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    comp = components(found.where("a is not null").select("a", "b"))
    named = classes.join(links, "cid", "left").join(comp, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("component", "cid"))
    named = durable(named.select("class", "v", "least", "root", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(roots, "root").drop("root", "least")
    linked = members.join(named, ["class", "v"]).select("vec_id", F.col("n_links").cast("long"), "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a bipartite 0/1 matrix, by breadth-first search."""
    todo_l, todo_r = near.any(1), near.any(0)
    a, b = [], []
    while todo_l.any():
        start = int(np.flatnonzero(todo_l)[0])
        todo_l[start] = False
        front = np.array([start])
        while len(front):
            new_r: list[int] = []
            for i in front:
                r = np.flatnonzero(near[i] & todo_r)
                todo_r[r] = False
                a.append(np.full(len(r), left[i]))
                b.append(right[r])
                new_r += r.tolist()
            nxt: list[int] = []
            for j in new_r:
                l = np.flatnonzero(near[:, j] & todo_l)
                todo_l[l] = False
                a.append(left[l])
                b.append(np.full(len(l), right[j]))
                nxt += l.tolist()
            front = np.array(nxt, int)
    return (np.concatenate(a), np.concatenate(b)) if a else (left[:0], right[:0])
