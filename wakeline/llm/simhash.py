"""Operator 5: SimHash near-duplicates found by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import components, durable, scratch

WIDTH = 3
MAX_DIFF = 2
#: Bits of the fingerprint's three segments, from the top.
SEGMENTS = (22, 21, 21)
#: (exact segment, fuzzy segment): for any placing of two errors, one pair has none in the first and at most one in the second.
PAIRS = ((0, 1), (1, 2), (2, 0))
#: Members of a bucket compared with each other; larger buckets look up neighbours instead.
PAIRWISE = 4096


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of a whole text, repeats included; A-Z lower-cased, words cut at ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, seed)] if words else [], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    stops = (ends - 1).tolist()
    view = memoryview(joined)
    return np.fromiter((h(view[a:b], seed) for a, b in zip(starts, stops[width - 1 :])), np.uint64, len(words) - width + 1)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; none: 0."""
    if not len(h):
        return 0
    count = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for at in range(0, len(bits), 255):
            count += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


class Golay:
    """The perfect binary Golay code [23, 12, 7], built from its generator polynomial."""

    def __init__(self, generator: int = 0xC75):
        word = np.zeros(4096, np.uint32)
        for bit in range(12):
            word ^= np.where(np.arange(4096) >> bit & 1, generator << bit, 0).astype(np.uint32)
        self.words = word
        one = 1 << np.arange(23)
        errors = [0, *one]
        errors += [one[i] | one[j] for i in range(23) for j in range(i)]
        errors += [one[i] | one[j] | one[k] for i in range(23) for j in range(i) for k in range(j)]
        errors = np.array(errors, np.uint32)
        self.index = np.zeros(1 << 23, np.uint16)
        self.distance = np.zeros(1 << 23, np.uint8)
        weight = np.bitwise_count(errors)
        for i, w in enumerate(word):
            self.index[w ^ errors] = i
            self.distance[w ^ errors] = weight
        # Codewords of weight 7 that contain an error of weight 3 are at distance 4 from that error.
        seven = word[np.bitwise_count(word) == 7]
        seven_index = np.flatnonzero(np.bitwise_count(word) == 7)
        heavy = errors[weight == 3]
        self.rows = np.array([seven_index[(seven & e) == e] for e in heavy], np.uint16)
        self.slot = np.zeros(1 << 23, np.uint16)
        self.slot[heavy] = np.arange(len(heavy))

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, codeword index) of all codewords within distance 4: one, or six at distance 3 from the nearest.

        Two words one bit apart share a key: the nearest codeword of either is within 4 of the other.
        The code is linear and the index of a sum is the exclusive or of the indices.
        """
        own = self.index[x]
        far = np.flatnonzero(self.distance[x] == 3)
        error = x[far] ^ self.words[own[far]]
        extra = own[far, None] ^ self.rows[self.slot[error]]
        return np.concatenate([np.arange(len(x)), np.repeat(far, 5)]), np.concatenate([own, extra.ravel()])


@lru_cache(1)
def golay() -> Golay:
    return Golay()


def fuzzy_keys(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows: an exact segment with a codeword near the next one."""
    cut = np.cumsum((0, *SEGMENTS))
    part = [((f >> np.uint64(64 - cut[i + 1])) & np.uint64((1 << SEGMENTS[i]) - 1)).astype(np.int64) for i in range(3)]
    keys, rows = [], []
    for kind, (exact, fuzzy) in enumerate(PAIRS):
        row, code = golay().keys(part[fuzzy].astype(np.uint32))
        keys.append(kind << 40 | part[exact][row] << 12 | code.astype(np.int64))
        rows.append(row)
    return np.concatenate(keys), f[np.concatenate(rows)]


@lru_cache(4)
def masks(most: int) -> np.ndarray:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    out = [one]
    if most > 1:
        i, j = np.triu_indices(64, 1)
        out.append(one[i] | one[j])
    return np.concatenate(out)


def forest(x: np.ndarray, most: int = MAX_DIFF, pairwise: int = PAIRWISE) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all members within `most` bits of each other, directly or through others: a spanning
    forest. Small sets are searched pair against pair, large ones by looking up all neighbours of each."""
    if len(x) <= pairwise:
        left, a, b = x.copy(), [], []
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = np.bitwise_count(left ^ at) <= most
                if near.any():
                    new = left[near]
                    a.append(np.full(len(new), at))
                    b.append(new)
                    queue += list(new)
                    left = left[~near]
        return (np.concatenate(a), np.concatenate(b)) if a else (x[:0], x[:0])
    x = np.sort(x)
    label = np.arange(len(x))
    changed = True
    while changed:
        old = label.copy()
        for mask in masks(most):
            other = np.minimum(np.searchsorted(x, x ^ mask), len(x) - 1)
            hit = np.flatnonzero(x[other] == x ^ mask)
            np.minimum.at(label, label[hit], label[other[hit]])
            label[hit] = np.minimum(label[hit], label[other[hit]])
        while (label != label[label]).any():
            label = label[label]
        changed = (old != label).any()
    other = np.flatnonzero(label != np.arange(len(x)))
    return x[label[other]], x[other]


def link_runs(key: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges within each run of equal keys; short runs all at once by offsets."""
    change = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(change, len(key)))
    short = np.repeat(size <= 12, size)
    a, b = [], []
    k, g = key[short], f[short]
    for step in range(1, 12):
        if len(k) <= step:
            break
        hit = (k[:-step] == k[step:]) & (np.bitwise_count(g[:-step] ^ g[step:]) <= MAX_DIFF)
        a.append(g[:-step][hit])
        b.append(g[step:][hit])
    for lo, n in zip(change[size > 12], size[size > 12]):
        u, v = forest(np.unique(f[lo : lo + n]))
        a.append(u)
        b.append(v)
    return (np.concatenate(a), np.concatenate(b)) if a else (f[:0], f[:0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fingerprint (a signed long) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(shingle_hashes(t.as_py(), width)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "f"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, f bigint")


def linked(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) of a graph of distinct fingerprints `f` with the components of the graph of all links."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(f), 1 << 14):
                k, g = fuzzy_keys(f[lo : lo + (1 << 14)])
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(g.view(np.int64))], ["key", "f"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in _with_end(batches):
            if batch is not None:
                key = np.concatenate([rest[0], batch.column(0).to_numpy(zero_copy_only=False)])
                f = np.concatenate([rest[1], batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
                at = np.searchsorted(key, key[-1]) if len(key) else 0  # the last run may go on in the next batch
                rest, key, f = [key[at:], f[at:]], key[:at], f[:at]
            else:
                key, f = rest
            a, b = link_runs(key, f)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    keys = distinct.select("f").mapInArrow(index, "key bigint, f bigint")
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(verify, "a bigint, b bigint")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row.

    Fingerprints within two bits are linked, component_id is the least doc_id reachable. Null and empty
    texts have fingerprint zero and link as any other. Repeated rows come out as often as they come in;
    a null id is never a component_id unless its component has no other; an empty table gives none;
    other columns are ignored. All links between fingerprints are found: two errors leave one of three
    pairs of segments without an error in the first and with at most one in the second.
    """
    with scratch() as keep:
        rows = durable(fingerprints(docs, width))
        classes = durable(rows.groupBy("f").agg(F.min("doc_id").alias("least")))
        comp = components(linked(classes).distinct())
        classes = classes.join(comp, classes["f"] == comp["node"], "left").select("f", "least", F.coalesce("component", "f").alias("root"))
        roots = classes.groupBy("root").agg(F.min("least").alias("component_id"))
        named = durable(classes.join(roots, "root").select("f", "component_id"))
        return keep(rows.join(named, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"))
