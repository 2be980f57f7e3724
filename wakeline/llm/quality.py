"""Operator 9: byte-level convolutional quality classifier in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.llm.common import free_name, small_batches

#: Bytes embedded at a time, bytes between window starts, bytes of a chunk, bytes between chunks.
EMBED, STRIDE, CHUNK, HOP = 8, 4, 256, 128
FILTERS, HIDDEN = 32, 16
#: The training sample: documents at most, and the bytes of a text up to which a labelled row may be in it.
TRAIN_DOCS, TRAIN_BYTES = 4000, 1 << 15
#: Steps of training at least, however few labels there are.
LEAST_STEPS = 300
THRESHOLD = 0.7
#: Bytes of texts scored at a time; a longer text is scored alone.
SCORED = 1 << 17
#: How much dearer it is to reject a good document than to keep a bad one.
FAVOUR = 3.0
NAMES = ("emb", "conv", "cb", "w1", "b1", "w2", "b2")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def init(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *n, s: rng.normal(0, s, n).astype(np.float32)
    return {
        "emb": draw(256, EMBED, s=0.5),
        "conv": draw(2 * STRIDE * EMBED, FILTERS, s=0.2),
        "cb": np.zeros(FILTERS, np.float32),
        "w1": draw(FILTERS, HIDDEN, s=0.25),
        "b1": np.zeros(HIDDEN, np.float32),
        "w2": draw(HIDDEN, s=0.25),
        "b2": np.zeros(1, np.float32),
    }


def padded(data: bytes) -> np.ndarray:
    """Bytes up to a whole number of hops, one chunk at least."""
    size = max(CHUNK, -(-len(data) // HOP) * HOP)
    out = np.zeros(size, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out


def chunks_of(data: bytes) -> np.ndarray:
    """All chunks of a whole text, as a view."""
    return np.lib.stride_tricks.sliding_window_view(padded(data), CHUNK)[::HOP]


def with_short(chunks: np.ndarray, doc: np.ndarray, label: np.ndarray, rng: np.random.Generator) -> tuple:
    """Also a short piece of every document, so that length alone says nothing."""
    first = np.searchsorted(doc, np.arange(len(label) + 1))
    at = [int(rng.integers(min(lo + 1, hi - 1), hi)) for lo, hi in zip(first[:-1], first[1:])]
    short = chunks[at].copy()
    for row, size in zip(short, rng.integers(20, 200, len(short))):
        row[size:] = 0
    return np.concatenate([chunks, short]), np.concatenate([doc, len(label) + np.arange(len(label))]), np.concatenate([label, label])


def gradients(p: dict[str, np.ndarray], raw: np.ndarray, seg: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted log loss of documents, given their chunks and the document of each."""
    half, positions, n = STRIDE * EMBED, CHUNK // STRIDE, len(raw)
    e = p["emb"][raw].reshape(n, positions, half)
    wide = np.concatenate([e[:, :-1], e[:, 1:]], axis=2)
    act = (wide.reshape(-1, 2 * half) @ p["conv"]).reshape(n, positions - 1, FILTERS)
    top = act.argmax(1)
    z = np.take_along_axis(act, top[:, None], 1)[:, 0] + p["cb"]
    zr = np.maximum(z, 0)
    h = zr @ p["w1"] + p["b1"]
    hr = np.maximum(h, 0)
    share = (1 / np.bincount(seg)).astype(np.float32)
    pooled = np.stack([np.bincount(seg, hr[:, j]) for j in range(HIDDEN)], 1).astype(np.float32) * share[:, None]
    score = 1 / (1 + np.exp(-np.clip(pooled @ p["w2"] + p["b2"], -30, 30)))
    gs = ((score - label) * weight).astype(np.float32)
    g = {"w2": pooled.T @ gs, "b2": gs.sum(keepdims=True)}
    gh = (gs[seg] * share[seg])[:, None] * p["w2"] * (h > 0)
    g["w1"], g["b1"] = zr.T @ gh, gh.sum(0)
    gz = (gh @ p["w1"].T) * (z > 0)
    g["cb"] = gz.sum(0)
    best = np.take_along_axis(wide, top[:, :, None], 1)  # n, filters, 2 * half
    g["conv"] = np.einsum("nf,nfk->kf", gz, best, optimize=True)
    back = gz[:, :, None] * p["conv"].T[None]  # n, filters, 2 * half
    start = (top * STRIDE)[:, :, None] + np.arange(2 * STRIDE)
    hit = raw[np.arange(n)[:, None, None], start].ravel()
    flat = back.reshape(-1, EMBED)
    g["emb"] = np.stack([np.bincount(hit, flat[:, j], 256) for j in range(EMBED)], 1).astype(np.float32)
    return g


def train(chunks: np.ndarray, doc: np.ndarray, label: np.ndarray, epochs: int = 9, batch: int = 128, rate: float = 4e-3, seed: int = 11, room: int = 1024) -> dict[str, np.ndarray]:
    """Adam on the log loss of whole documents; chunks are sorted by doc, 0 to len(label) - 1.

    A batch's gradients are summed over parts of about `room` chunks, so memory does not follow the length of its texts.
    """
    p, rng = init(), np.random.default_rng(seed)
    chunks, doc, label = with_short(chunks, doc, label, rng)
    first = np.searchsorted(doc, np.arange(len(label) + 1))
    size = np.diff(first)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    weight = np.where(label == 1, FAVOUR * 0.5 / max(label.mean(), 1e-3), 0.5 / max(1 - label.mean(), 1e-3)).astype(np.float32)
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(label)))
    step, steps = 0, max(1, epochs * -(-len(label) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for lo in range(0, len(label), batch):
            docs = order[lo : lo + batch]
            g = {k: np.zeros_like(v) for k, v in p.items()}
            part = np.cumsum(size[docs]) // room
            for own in np.split(docs, np.flatnonzero(np.diff(part)) + 1):
                at = np.concatenate([np.arange(first[d], first[d + 1]) for d in own])
                for k, v in gradients(p, chunks[at], np.repeat(np.arange(len(own)), size[own]), label[own], weight[own] / len(docs)).items():
                    g[k] += v
            step += 1
            speed = rate * (1 - 0.9 * step / steps)
            for k in p:
                m, v = moment[k]
                m += 0.1 * (g[k] - m)
                v += 0.01 * (g[k] ** 2 - v)
                p[k] = (p[k] - speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


class Scorer:
    """Scores whole documents: every filter over every window, each chunk's maxima, then the mean of the chunks."""

    def __init__(self, p: dict[str, np.ndarray], block: int = 1 << 19):
        self.p, self.block = p, block
        pair = np.arange(65536)
        self.pairs = np.concatenate([p["emb"][pair & 255], p["emb"][pair >> 8]], 1)  # little-endian pairs of bytes
        half = STRIDE * EMBED
        self.both = np.ascontiguousarray(np.concatenate([p["conv"][:half], p["conv"][half:]], 1))

    def hops(self, data: np.ndarray) -> np.ndarray:
        """Maxima of each hop's windows; the last window of the data has no right half. Blocks share a window."""
        per, rows = HOP // STRIDE, []
        for lo in range(0, len(data), self.block):
            part = data[lo : lo + self.block + STRIDE]
            part = part[: len(part) // STRIDE * STRIDE]
            e = self.pairs[part.view("<u2")].reshape(-1, STRIDE * EMBED)
            out = e @ self.both
            act = np.full((min(self.block, len(data) - lo) // STRIDE, FILTERS), -np.inf, np.float32)
            width = min(len(act), len(out) - 1)
            np.add(out[:width, :FILTERS], out[1 : width + 1, FILTERS:], out=act[:width])
            rows.append(act.reshape(-1, per, FILTERS))
        return np.concatenate([self.inner(r) for r in rows])

    @staticmethod
    def inner(act: np.ndarray) -> np.ndarray:
        """(maxima without each hop's last window, that window): a chunk leaves out the window that crosses its end."""
        return np.stack([act[:, :-1].max(1), act[:, -1]], 1)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        parts = [padded(t) for t in texts]
        if not parts:
            return np.zeros(0)
        size = np.array([len(x) // HOP for x in parts])
        own = self.hops(np.concatenate(parts))
        last = np.cumsum(size) - 1
        chunk = np.maximum(np.maximum(own[:-1, 0], own[:-1, 1]), own[1:, 0])
        keep = np.ones(len(own) - 1, bool)
        keep[last[:-1]] = False
        doc = np.repeat(np.arange(len(parts)), size)[:-1][keep]
        z = np.maximum(chunk[keep] + self.p["cb"], 0)
        h = np.maximum(z @ self.p["w1"] + self.p["b1"], 0)
        start = np.searchsorted(doc, np.arange(len(parts)))
        pooled = np.add.reduceat(h.astype(np.float64), start, 0) / (size - 1)[:, None]
        return 1 / (1 + np.exp(-np.clip(pooled @ self.p["w2"].astype(np.float64) + float(self.p["b2"][0]), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> dict[str, np.ndarray]:
    """Train on all chunks of a bounded sample of labelled rows that are not held out.

    Rows whose text has over `most_bytes` bytes are not in the sample. Half of its room is for either label, each filled
    in the order of a hash of doc_id, so the sample is the same at every run. Documents with contradicting
    labels teach nothing, and of rows that share a doc_id one does. The driver gets `most_docs * most_bytes` bytes at most.
    """
    known = (
        labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_y")).where("y = _y").drop("_y")
    )
    mixed = F.xxhash64("doc_id", F.lit(1))
    sized = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= most_bytes)
    small = known.join(sized.select("doc_id"), "doc_id", "left_semi")
    half = lambda y: small.where(F.col("y") == y).orderBy(mixed, "doc_id").limit(most_docs // 2)
    picked = half(0).unionByName(half(1))
    joined = sized.join(F.broadcast(picked), "doc_id")  # at most `most_docs` rows
    rows = joined.groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (str(r.doc_id), r.text))
    if len({r.y for r in rows}) < 2:
        p = init()
        p["w2"][:] = 0
        p["b2"][:] = np.float32(8 if not rows or rows[0].y == 1 else -8)  # nothing to tell apart
        return p
    chunks = [chunks_of(r.text.encode("utf-8", "replace")) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(c) for c in chunks])
    return train(np.concatenate(chunks), doc, np.array([r.y for r in rows], np.float32))


def score(docs: DataFrame, model: dict[str, np.ndarray], name: str = "score") -> DataFrame:
    """All columns plus a score (double) of a `name` they don't have. Scores depend on the text alone; a null text scores as an empty one."""
    at = docs.columns.index("text")
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            out, room, held = [], [], 0
            for value in batch.column(at):
                room.append((value.as_py() or "").encode("utf-8", "replace"))
                held += len(room[-1]) + CHUNK
                if held > SCORED:
                    out.append(scorer(room))
                    room, held = [], 0
            out.append(scorer(room))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], [*batch.schema.names, name])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts are scored like a chunk of padding; repeated rows get the same score; without
    two kinds of labels every document gets the one label there is (1 if there is none); an empty
    table gives none; other columns are ignored.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their columns, whatever these are named."""
    name = free_name(docs, "score")
    return score(docs, fit(docs, labels), name).where(F.col(name) >= THRESHOLD).drop(name)
