"""Operator 5 over documents: candidates by wide SimHash fingerprints and Golay keys, verified on word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import components, durable, free_name, maybe_broadcast, scratch
from wakeline.llm.simhash import _with_end, golay, shingle_hashes

#: Similar documents share this part of their distinct shingles of five words.
SIMILARITY, VERIFY_WIDTH = 0.8, 5
#: The wide fingerprint: eight segments of 23 bits over shingles of three words.
LANES, SEGMENT, FEATURE_WIDTH = 8, 23, 3
#: Bits by which 64 bits, and all 192, of similar documents may differ: similarity 0.8 has means of 8 and 20, deviations of 2.3 and 4.
NEAR_BITS, WIDE_BITS = 16, 44
#: Bins of the sketch that screens candidates, and the standard errors by which an estimate may fall short of 0.8.
BINS, ERRORS = 256, 5.0
TABLES = range(3 * LANES)
#: Members of a bucket compared by offsets, rows compared at once, and rows of a bucket that one task compares.
SHORT, SMALL, BLOCK = 6, 1024, 4096


def mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """Another 64 bits from each hash."""
    h = (h + np.uint64((0x9E3779B97F4A7C15 * (turn + 1)) & (2**64 - 1))).astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def wide_fingerprint(h: np.ndarray) -> bytes:
    """192 bits by majority over the distinct hashes, as similarity is of sets."""
    h = np.unique(h)
    if not len(h):
        return bytes(24)
    count = np.zeros(192, np.int64)
    for lo in range(0, len(h), 1 << 14):
        part = h[lo : lo + (1 << 14)]
        wide = np.stack([part, mixed(part, 0), mixed(part, 1)], 1)
        bits = np.unpackbits(wide.astype(">u8").view(np.uint8).reshape(len(part), 24), axis=1)
        for at in range(0, len(bits), 255):
            count += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(h)).tobytes()


def sketch(h: np.ndarray) -> bytes:
    """One-permutation MinHash of distinct hashes: a byte of the least hash in each bin, 0 for an empty bin."""
    h = np.sort(mixed(h, 2))
    bin_of = (h >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bin_of[1:] != bin_of[:-1]])) if len(h) else np.zeros(0, int)
    out = np.zeros(BINS, np.uint8)
    out[bin_of[first]] = (h[first] >> np.uint64(8)).astype(np.uint8) | 1
    return out.tobytes()


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x (hash of the text), t (hash of its words) and the wide fingerprint of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, wide = [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                t.append(xxhash.xxh64_intdigest(b" ".join(text.encode("utf-8", "replace").lower().split()), 7))
                wide.append(wide_fingerprint(shingle_hashes(text, FEATURE_WIDTH)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(t, np.uint64).view(np.int64)), pa.array(wide, pa.binary())], ["doc_id", "x", "t", "wide"])

    return docs.select("doc_id", F.xxhash64("text").alias("x"), "text").mapInArrow(scan, f"doc_id {kind}, x bigint, t bigint, wide binary")


def lanes(wide: np.ndarray) -> np.ndarray:
    """The eight 23-bit segments of fingerprints given as rows of 24 bytes."""
    bits = np.unpackbits(wide, axis=1)[:, : LANES * SEGMENT].reshape(len(wide), LANES, SEGMENT)
    return (bits.astype(np.int64) << np.arange(SEGMENT - 1, -1, -1)).sum(2)


#: How far ahead of a table's fuzzy segment its exact one lies, and which ten bits of it count.
EXACT = ((1, 13), (1, 0), (3, 6))


def keys(wide: np.ndarray, tables: range = TABLES) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): codewords near a segment together with ten exact bits of another one.

    Three tables a segment, 24 in all, with keys of 22 bits; 0.2 % of pairs at similarities from 0.8 share no
    bucket. Table n takes segment n % 8, so that any run of tables spreads over the segments.
    """
    part = lanes(wide)
    near = {lane: golay().keys(part[:, lane].astype(np.uint32)) for lane in {n % LANES for n in tables}}
    rows, out = [], []
    for n in tables:
        lane, (ahead, shift) = n % LANES, EXACT[n // LANES]
        row, code = near[lane]
        exact = part[row, (lane + ahead) % LANES] >> shift & 0x3FF
        rows.append(row)
        out.append(n << 22 | exact << 12 | code.astype(np.int64))
    return np.concatenate(rows), np.concatenate(out)


def _apart(n: int) -> int:
    """Which 64 of the 192 bits have least in common with the segments of table n: rows of its bucket agree on these anyway."""
    used = {23 * lane + i for lane in (n % LANES, (n % LANES + EXACT[n // LANES][0]) % LANES) for i in range(SEGMENT)}
    return min(range(3), key=lambda k: len(used & set(range(64 * k, 64 * k + 64))))


#: By table, the bits by which rows of its buckets are told to be near.
APART = np.array([_apart(n) for n in TABLES])


def words(wide: np.ndarray) -> np.ndarray:
    """Fingerprints given as rows of 24 bytes as rows of three words."""
    return np.ascontiguousarray(wide).view(">u8").astype(np.uint64)


class Codes:
    """The keys of rows of fingerprints by table, to tell which bucket two rows meet in first."""

    def __init__(self, wide: np.ndarray):
        part = lanes(wide)
        self.exact = np.stack([part[:, (n % LANES + EXACT[n // LANES][0]) % LANES] >> EXACT[n // LANES][1] & 0x3FF for n in TABLES], 1)
        self.code = np.full((len(wide), LANES, 6), -1, np.int16)
        for lane in range(LANES):
            row, code = golay().keys(part[:, lane].astype(np.uint32))
            order = np.argsort(row, kind="stable")
            row, code = row[order], code[order]
            at = np.arange(len(row)) - np.searchsorted(row, row)
            self.code[row, lane, at] = code

    def first(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The least key that rows i and j have in common."""
        out = np.full(len(i), -1, np.int64)
        for lo in range(0, len(i), 1 << 14):
            p, q = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
            a = self.code[p]
            same = (a[:, :, :, None] == self.code[q][:, :, None, :]).any(3) & (a >= 0)
            code = np.where(same, a, 1 << 12).min(2)
            shared = (self.exact[p] == self.exact[q]) & (code < 1 << 12)[:, np.array(TABLES) % LANES]
            n = shared.argmax(1)
            at = np.arange(len(p))
            key = n << 22 | self.exact[p, n] << 12 | code[at, n % LANES].astype(np.int64)
            out[lo : lo + (1 << 14)] = np.where(shared.any(1), key, -1)
        return out


def middle(f: np.ndarray) -> int:
    """The member nearest to the majority of the members' bits; copies of one original lie around it."""
    count = np.zeros(64, np.int64)
    for lo in range(0, len(f), 1 << 14):
        count += np.unpackbits(f[lo : lo + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    major = np.packbits(2 * count > len(f)).view(">u8")[0].astype(np.uint64)
    return int(np.bitwise_count(f ^ major).argmin())


def has_neighbour(f: np.ndarray) -> np.ndarray:
    """Which members of a bucket have another one within NEAR_BITS. The middle settles most; the rest are compared with all."""
    out = np.bitwise_count(f ^ f[middle(f)]) <= NEAR_BITS
    out &= out.sum() > 1
    rest = np.flatnonzero(~out)
    for lo in range(0, len(rest), SMALL):
        some = rest[lo : lo + SMALL]
        n = np.zeros(len(some), np.int64)
        for at in range(0, len(f), SMALL):
            n += (np.bitwise_count(f[some, None] ^ f[None, at : at + SMALL]) <= NEAR_BITS).sum(1)
        out[some] = n > 1
    return out


class Members:
    """Rows of a bucket, side by side: class, fingerprint of three words, group, shingles, shingles that others may share, sketch."""

    def __init__(self, t: np.ndarray, f: np.ndarray, c: np.ndarray, n: np.ndarray, v: np.ndarray, bins: np.ndarray):
        self.t, self.f, self.c, self.n, self.v, self.bins = t, f, c, n, v, bins

    def __getitem__(self, at) -> Members:
        return Members(*(x[at] for x in (self.t, self.f, self.c, self.n, self.v, self.bins)))

    def __len__(self) -> int:
        return len(self.t)


def possible(a: Members, b: Members) -> np.ndarray:
    """Which pairs are in different groups, within WIDE_BITS, and can reach the similarity by what they may share: an
    intersection is no larger than either side's shared shingles, and that bound loses nothing."""
    share = np.minimum(a.v, b.v)
    return (a.c != b.c) & (np.bitwise_count(a.f ^ b.f).sum(-1, dtype=np.uint8) <= WIDE_BITS) & (share >= SIMILARITY * (a.n + b.n - share) - 1e-9)


def guesses(x: Members, y: Members) -> tuple[np.ndarray, np.ndarray]:
    """(estimated similarity, whether it leaves room for the one asked for) of rows side by side.

    Each filled bin shows one shingle of the union, none twice, so the error at the similarity asked for is that of
    drawing `some` of the union's shingles without putting any back. A match of bytes by chance only adds to it.
    """
    some = np.maximum(((x.bins | y.bins) > 0).sum(1), 1)
    share = ((x.bins == y.bins) & (x.bins > 0)).sum(1) / some
    union = (x.n + y.n) / (1 + SIMILARITY)
    error = np.sqrt(SIMILARITY * (1 - SIMILARITY) / some * np.maximum(1 - (some - 1) / np.maximum(union, 1), 0))
    return share, share >= SIMILARITY - ERRORS * error - 1 / some - 1e-9


def block_pairs(x: Members, y: Members | None = None, small: int = SMALL) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, guess) of every pair of a bucket's rows, or of rows of two of its blocks, that may be a link."""
    if y is None and not (x.c != x.c[:1]).any():
        return
    other = x if y is None else y
    for lo in range(0, len(x), small):
        a = x[lo : lo + small]
        for hi in range(lo if y is None else 0, len(other), small):
            b = other[hi : hi + small]
            near = possible(a[:, None], b[None])
            i, j = np.nonzero(np.triu(near, 1) if y is None and lo == hi else near)
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                share, keep = guesses(a[p], b[q])
                if keep.any():
                    yield lo + p[keep], hi + q[keep], share[keep]


def kept(t: np.ndarray, i: np.ndarray, j: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (i, j) of rows those that are the best guess of either end; t breaks ties."""
    end, other, guess = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([share, share])
    order = np.lexsort((t[other], -guess, end))
    first = order[np.concatenate([[True], end[order][1:] != end[order][:-1]])] if len(order) else order
    at = np.unique(first % max(len(i), 1))
    return i[at], j[at], share[at]


def runs(batches: Iterator[pa.RecordBatch], marks: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(columns, starts, sizes) of whole runs of equal first `marks` columns; rows come sorted by them, and a run
    that goes on in the next batch is kept until it ends."""
    rest: list[np.ndarray] | None = None
    for batch in _with_end(batches):
        if batch is None:
            own = rest
        else:
            if not batch.num_rows:
                continue
            own = [np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1) if pa.types.is_binary(col.type) else col.to_numpy(zero_copy_only=False) for col in batch.columns]
            own = own if rest is None else [np.concatenate([r, x]) for r, x in zip(rest, own)]
            last = np.flatnonzero(np.any([x[1:] != x[:-1] for x in own[:marks]], axis=0)) if len(own[0]) > 1 else []
            at = int(last[-1]) + 1 if len(last) else 0
            rest, own = [x[at:] for x in own], [x[:at] for x in own]
        if own is not None and len(own[0]):
            start = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in own[:marks]], axis=0)]))
            yield own, start, np.diff(np.append(start, len(own[0])))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def members(classes: DataFrame) -> DataFrame:
    """The distinct classes `t` that share a bucket with another one within NEAR_BITS of the bits that its table leaves out:
    all ends of candidate pairs."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False)
            wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 24)
            f = words(wide).view(np.int64)
            for lo in range(0, len(t), 4096):
                row, key = keys(wide[lo : lo + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(t[lo + row]), pa.array(f[lo + row, APART[key >> 22]])], ["key", "t", "f"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, t, f), start, size in runs(batches, 1):
            f = f.view(np.uint64)
            hit = np.zeros(len(t), bool)
            short = np.flatnonzero(np.repeat((size > 1) & (size <= SHORT), size))
            k, g = key[short], f[short]
            for step in range(1, SHORT):
                near = np.flatnonzero((k[:-step] == k[step:]) & (np.bitwise_count(g[:-step] ^ g[step:]) <= NEAR_BITS)) if len(k) > step else []
                hit[short[near]] = hit[short[near] + step] = True
            for lo, n in zip(start[size > SHORT], size[size > SHORT]):
                hit[lo : lo + n] = has_neighbour(f[lo : lo + n])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(t[hit]))], ["t"])

    rows = classes.select("t", "wide").mapInArrow(index, "key bigint, t bigint, f bigint")
    return rows.repartition(partitions(rows), "key").sortWithinPartitions("key").mapInArrow(mark, "t bigint").distinct()


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(t, s): distinct shingle hashes of the wanted classes (t, x), in order; x is the text hash of one of its rows."""
    wanted = wanted.select(F.col("x").alias("_x"), "t")
    rows = docs.select(F.xxhash64("text").alias("_x"), "text").join(maybe_broadcast(wanted, wanted.count()), "_x").select("t", "text")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                own = [np.unique(shingle_hashes(v.as_py(), VERIFY_WIDTH)).view(np.int64) for v in batch.column(1).slice(lo, 256)]
                ends = pa.array(np.cumsum([0, *map(len, own)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 256), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own), pa.int64()))], ["t", "s"])

    # Equal texts have equal sets: one of each goes on, before any set is shuffled where copies lie together.
    return rows.mapInArrow(shingles, "t bigint, s array<bigint>").groupBy("t").agg(F.first("s").alias("s"))


def shared_counts(sets: DataFrame) -> DataFrame:
    """(t, n, v): shingles of every class, and how many of them some other class has too."""
    ends = sets.select("t", F.explode("s").alias("h"))
    alone = ends.groupBy("h").agg(F.count("*").alias("k"), F.first("t").alias("t")).where("k = 1").groupBy("t").agg(F.count("*").alias("u"))
    sized = sets.select("t", F.size("s").cast("long").alias("n"))
    return sized.join(alone, "t", "left").select("t", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("v"))


def sketches(sized: DataFrame) -> DataFrame:
    """(t, n, v, bins) of classes (t, n, v, s)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [sketch(s.values.to_numpy(zero_copy_only=False).view(np.uint64)) for s in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bins, pa.binary())], ["t", "n", "v", "bins"])

    return sized.select("t", "n", "v", "s").mapInArrow(scan, "t bigint, n bigint, v bigint, bins binary")


def spots(alive: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, t, parts): the buckets that a class (t, wide) shares with another one, and in how many parts each is compared."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 24)
            for lo in range(0, len(wide), 4096):
                row, key = keys(wide[lo : lo + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(lo + row))], ["key", "t"])

    rows = durable(alive.select("t", "wide").mapInArrow(index, "key bigint, t bigint"))
    shared = durable(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    return rows.join(maybe_broadcast(shared, shared.count()), "key")


def candidates(alive: DataFrame, where: DataFrame, throughout: bool = True) -> DataFrame:
    """Distinct candidate pairs (a, b) of classes (t, wide, bins, n, v, c) that share a bucket of `where` and are in different
    groups c: all that may be links, or only the likeliest partner of each class among the rows of a bucket's part.

    A crowded bucket is compared block against block in as many tasks. A pair comes from one bucket only.
    """

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def offered(x: Members, marks: list[np.ndarray], start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, guess) of rows that may be links, bucket by bucket."""
        key, lo_block, hi_block, own = marks
        short = np.flatnonzero(np.repeat((size > 1) & (size <= SHORT), size) & (lo_block == hi_block))
        some, k = x[short], key[short]
        for step in range(1, min(SHORT, len(short))):
            p = np.flatnonzero((k[:-step] == k[step:]) & possible(some[:-step], some[step:]))
            share, keep = guesses(some[p], some[p + step])
            yield short[p[keep]], short[p[keep] + step], share[keep]
        for lo, n in zip(start, size):
            if lo_block[lo] != hi_block[lo]:
                left, right = (lo + np.flatnonzero(own[lo : lo + n] == z) for z in (lo_block[lo], hi_block[lo]))
                yield from ((left[i], right[j], g) for i, j, g in block_pairs(x[left], x[right]))
            elif n > SHORT:
                yield from ((lo + i, lo + j, g) for i, j, g in block_pairs(x[lo : lo + n]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (*marks, t, wide, c, n, v, bins), start, size in runs(batches, 3):
            x = Members(t, words(wide), c, n, v, bins)
            codes = Codes(wide)
            room = [(z := np.zeros(0, np.int64), z, np.zeros(0))]
            for i, j, g in offered(x, marks, start, size):
                once = codes.first(i, j) == marks[0][i]  # a pair counts in the first bucket it shares
                room.append((i[once], j[once], g[once]))
                if sum(len(z[0]) for z in room) >= SMALL * SMALL:
                    i, j, g = (np.concatenate(z) for z in zip(*room))
                    if throughout:
                        yield out(t[i], t[j])
                    room = room[:1] if throughout else [kept(t, i, j, g)]
            i, j, g = (np.concatenate(z) for z in zip(*room))
            i, j, _ = (i, j, g) if throughout else kept(t, i, j, g)
            yield out(t[i], t[j])

    own = F.pmod(F.xxhash64("t"), "parts").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)) if throughout else F.col("own")
    rows = where.withColumn("own", own).withColumn("other", other).select("key", "t", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")
    rows = rows.join(alive.select("t", "wide", "c", "n", "v", "bins"), "t").select("key", "lo", "hi", "own", "t", "wide", "c", "n", "v", "bins")
    return rows.repartition(partitions(rows), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(meet, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that share the part of shingles asked for."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3)):
                x, y = (z.values.to_numpy(zero_copy_only=False) for z in (p, q))
                n = len(x) + len(y)
                both = n - len(np.unique(np.concatenate([x, y])))
                keep.append(both >= SIMILARITY * (n - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    a = sets.select(F.col("t").alias("a"), F.col("s").alias("s_a"))
    b = sets.select(F.col("t").alias("b"), F.col("s").alias("s_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "s_a", "s_b").mapInArrow(compare, "a bigint, b bigint")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, x, rows, component) of every distinct row: equal components are near-duplicates.

    Exact copies up to case and white space form one class. Classes that meet another one in a bucket are kept, and of
    these the ones that share enough shingles with others at all: more than a fifth of shingles of its own
    rules a class out. The likeliest partners come first and join most of each group; then every pair of
    every bucket is compared that is in different groups, since a link inside a group changes nothing.
    """
    with scratch() as keep:
        rows = durable(features(docs))
        classes = durable(rows.groupBy("t").agg(F.min("wide").alias("wide"), F.min("x").alias("x")))
        near = durable(members(classes))
        sets = durable(shingle_sets(docs, durable(classes.select("t", "x").join(near, "t"))))
        room = shared_counts(sets).where((F.col("n") > 0) & (F.col("v") >= SIMILARITY * F.col("n") - 1e-9))
        alive = durable(sketches(sets.join(room, "t")).join(classes.drop("x"), "t"))
        where = durable(spots(alive))
        links, tried, found = None, None, alive.withColumn("c", F.col("t"))
        for throughout in (False, True):
            pairs = candidates(found, where, throughout)
            pairs = durable(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
            tried = pairs if tried is None else tried.unionByName(pairs)
            new = durable(verified(pairs, sets))
            links = new if links is None else links.unionByName(new)
            comp = components(links)
            found = durable(alive.join(comp, F.col("t") == F.col("node"), "left").withColumn("c", F.coalesce("component", "t")).drop("node", "component"))
        grouped = rows.groupBy("doc_id", "x", "t").agg(F.count("*").alias("rows")).join(found.select("t", "c"), "t", "left")
        return keep(grouped.select("doc_id", "x", "rows", F.coalesce("c", "t").alias("component")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, the one of least doc_id, with its columns.

    Null and empty texts are one group; repeated rows are one document; a null id stays only where
    no other is in the group; an empty table gives none; columns of any other name pass through.
    """
    own = groups(docs)
    d, x = free_name(docs, "d"), free_name(docs, "x")
    rank = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "x")
    first = durable(own.groupBy("component").agg(F.min(rank).alias("m")).select(F.col("m.doc_id").alias(d), F.col("m.x").alias(x)))
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.col("x") == F.col(x))
    gone = durable(own.select("doc_id", "x").join(first, same, "left_anti").select(F.col("doc_id").alias(d), F.col("x").alias(x)))
    n_first, n_gone = first.count(), gone.count()
    match = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(x))
    if n_gone <= n_first:  # the shorter list
        left = docs.join(maybe_broadcast(gone, n_gone), match, "left_anti")
    else:
        left = docs.join(maybe_broadcast(first, n_first), match, "left_semi")
    twice = durable(own.where("rows > 1").select(F.col("doc_id").alias(d), F.col("x").alias(x)))
    if not (n := twice.count()):
        return left
    often = maybe_broadcast(twice, n)
    return left.join(often, match, "left_anti").unionByName(left.join(often, match, "left_semi").dropDuplicates(["doc_id", "text"]))
