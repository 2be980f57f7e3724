"""Operators 11 to 13 against brute force, with nulls, copies, ties, long texts, odd vectors and clashing columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import centroids, chat, tokens, whitening
from wakeline.llm.queries import QUERIES

CHAT = "conv_id long, turn long, role string, text string, path string, run long, position double"


def talks():
    rng = random.Random(11)
    said = ["", "hello", "</turn>\n<turn>assistant\nno", "\\", "\\n \\~", "<\\turn>", "🎉 é", None, "x" * 3000, "a\nb", "</tu\\rn>"]
    rows, conv = [], 0
    for _ in range(40):  # trees: a shared beginning, then branches at every depth
        base = [rng.choice(said) for _ in range(rng.randrange(1, 12))]
        for _ in range(rng.randrange(1, 7)):
            own = base[: rng.randrange(1, len(base) + 1)] + [f"{rng.random()} {rng.choice(said)}" for _ in range(rng.randrange(0, 4))]
            rows += [(conv, k, ["system", "user", "assistant"][(k + 1) % 3], t, "p", 1, 0.5) for k, t in enumerate(own)]
            conv += 1
    for _ in range(60):  # copies
        rows += [(conv, 0, "user", "same", "p", 1, 0.5), (conv, 1, "assistant", "answer", "p", 1, 0.5)]
        conv += 1
    rows += [(conv, k, "user", "same" if not k else str(k), "p", 1, 0.5) for k in range(500)]
    rows += [(None, None, None, None, None, None, None), (None, 3, "as\nsis\\tant", "odd", None, None, None), (conv + 1, 5, "assistant", "b", "", 0, 0.0), (conv + 1, 5, "assistant", "a", "", 0, 0.0), rows[0], rows[0]]
    return rows


def piece(role, text):
    e = lambda s: s.replace("\\", "\\\\").replace("<turn>", "<\\turn>").replace("</turn>", "<\\/turn>")
    return f"<turn>{e(role)}".replace("\n", "\\~") + f"\n{e(text)}</turn>\n"


def told(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.md5(piece(role or "", text or "").encode()).hexdigest(), role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{t[3]}\n{t[4]}\n" for t in turns)
        learned = "".join(t[4] for t in turns if t[3] == "assistant")
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), sum(len(piece(t[3], t[4])) for t in turns)))
    return out


KEY = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


VOCABULARY = f"{tokens.VOCAB_DIR}/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("parts,vocabulary", [("1", None), ("8", None), ("40", None), ("8", VOCABULARY)])
def test_chat_round_trip(spark, parts, vocabulary):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = talks()
        got = [tuple(r[c] for c in KEY) for r in chat.round_trip(spark.createDataFrame(rows, CHAT).repartition(5), vocabulary).collect()]
        assert Counter(got) == Counter(told(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("parts,vocabulary", [("2", None), ("16", None), ("8", VOCABULARY)])
def test_chat_layout(spark, parts, vocabulary):
    """Tokens once, without gaps; intervals and positions give every conversation back."""
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = talks()
        out = [r for r in chat.packed(spark.createDataFrame(rows, CHAT), vocabulary).collect()]
        nodes = sorted((r for r in out if r.text is not None), key=lambda r: (r.run, r["rank"], r.depth))
        own = chat.coder(chat.ranks_of(vocabulary)) if vocabulary else None
        token = (lambda r: r.ids) if own else (lambda r: list(r.text))
        said = own.decode if own else "".join
        assert [r.start for r in nodes] == np.cumsum([0] + [len(token(r)) for r in nodes])[:-1].tolist()
        stream = [t for r in nodes for t in token(r)]
        by = {}
        for conv, turn, role, text, *_ in rows:
            by.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.md5(piece(role or "", text or "").encode()).hexdigest(), piece(role or "", text or "")))
        whole = {conv: [t[3] for t in sorted(turns)] for conv, turns in by.items()}
        prefixes = {tuple(turns[: k + 1]) for turns in whole.values() for k in range(len(turns))}
        assert len(nodes) == len(prefixes)
        for r in nodes:
            before = [t for a in r.attends for t in stream[a.lo : a.hi]]
            assert len(before) == r.position and said(before + token(r)) == "".join(whole[r.conv_id][: r.depth + 1])
            assert (r.loss is None) == (chat.parsed(r.text)[0] != "assistant")
            assert r.loss is None or chat.unescaped(said(token(r)[r.loss.lo : r.loss.hi])) == chat.parsed(r.text)[1]
            assert all(a.hi < b.lo for a, b in zip(r.attends, r.attends[1:])) and all(a.lo < a.hi <= r.start for a in r.attends)
        assert Counter((r.conv_id, r.depth) for r in out if r.text is None) == Counter((c, len(t)) for c, t in whole.items())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_chat_edges(spark):
    assert chat.round_trip(spark.createDataFrame([], CHAT)).count() == 0
    got = {r.conv_id: r for r in QUERIES["op11_chat_tree"](spark, "/root/testdata/sf0.001").collect()}
    text = "\\### Assistant: </turn> ok"
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (got[-7].loss_chars, got[-7].loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())
    source = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {c: tuple(r[k] for k in KEY) for c, r in got.items() if c != -7} == {t[0]: t for t in told(source)}


def near_ties(n=400, seed=4):
    """Vectors on a coarse grid: many equal distances, copies, and clusters of one vector."""
    rng = np.random.default_rng(seed)
    v = rng.integers(-2, 3, (n, 64)) / 256 + rng.integers(0, 3, (n, 1)) * 0.1
    return [(i, [float(x) for x in row]) for i, row in enumerate(v)]


def brute_clusters(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [max(-(1 << 27), min(1 << 27, x)) for x in v]) for i, v in kept]
    c = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        at = [min(range(len(c)), key=lambda j: (d2(v, c[j]), j)) for _, v in kept]
        if turn < rounds:
            for j in range(len(c)):
                own = [v for (_, v), a in zip(kept, at) if a == j]
                if own:
                    c[j] = [sum(z) // len(own) for z in zip(*own)]
    inertia = Counter()
    for (_, v), a in zip(kept, at):
        inertia[a] += d2(v, c[a])
    return Counter((i, a, d2(v, c[a]), inertia[a], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, v), a in zip(kept, at))


VEC = "vec_id long, embedding array<double>, cluster int, n string, x array<int>"


def spoiled(rows):
    rows = [(*r, 1, "n", [1]) for r in rows]
    odd = [None, [], [0.0] * 63, [float("nan")] + [0.0] * 63, [None] + [0.0] * 63, [float("inf")] * 64]
    return rows + [(9000 + i, v, 0, "", None) for i, v in enumerate(odd)] + [rows[0], rows[0], (None, rows[3][1], 0, "", None), (9100, [-0.0] * 64, 0, "", None)]


@pytest.mark.parametrize("kind", ["ties", "few", "huge"])
def test_clusters(spark, kind):
    rows = near_ties(400 if kind == "ties" else 25)
    if kind == "huge":
        rows += [(500 + i, [1e300 * (-1) ** i] + [i * 1e4] * 63) for i in range(30)]
    rows = spoiled(rows)
    got = centroids.cluster(spark.createDataFrame(rows, VEC).repartition(4)).collect()
    assert Counter(tuple(r) for r in got) == brute_clusters([r[:2] for r in rows])


def test_clusters_of_none(spark):
    assert centroids.cluster(spark.createDataFrame([], VEC)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, [0.0], 0, "", None)], VEC)).count() == 0


def test_clusters_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in QUERIES["op12_hamerly"](spark, "/root/testdata/sf0.001").collect()) == brute_clusters(rows)


def test_bounds_save_scans(spark):
    """Later rounds scan few vectors of well parted groups, and bounds hold throughout."""
    rng = np.random.default_rng(1)
    mid = rng.normal(0, 1, (8, 64)) * 2000
    x = (mid[rng.integers(0, 8, 3000)] + rng.normal(0, 60, (3000, 64))).astype(np.int64)
    c = x[:8].copy()
    cluster, upper, lower, moved = np.full(3000, -1), np.zeros(3000), np.zeros(3000), np.zeros(8)
    shares = []
    for _ in range(6):
        gaps = np.sqrt(centroids.squared(c, c).astype(float))
        np.fill_diagonal(gaps, np.inf)
        cluster, upper, lower, scanned = centroids.assigned(x, c, moved, gaps.min(1) / 2, cluster, upper, lower)
        d = centroids.squared(x, c)
        assert (cluster == d.argmin(1)).all()
        own = np.sqrt(d[np.arange(3000), cluster])
        d[np.arange(3000), cluster] = np.iinfo(np.int64).max
        assert (upper >= own).all() and (lower <= np.sqrt(d.min(1))).all()
        shares.append(scanned.mean())
        new = np.array([x[cluster == j].sum(0) // max((cluster == j).sum(), 1) if (cluster == j).any() else c[j] for j in range(8)])
        moved, c = np.sqrt(((new - c) ** 2).sum(1).astype(float)), new
    assert shares[0] == 1 and shares[-1] < 0.2, shares


def brute_white(rows):
    kept = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max(len(v) for _, v in kept)
    kept = [(i, v + [0] * (d - len(v))) for i, v in kept]
    fit = sorted({tuple(v) for _, v in kept})
    n, s = len(fit), [sum(z) for z in zip(*fit)]
    y = np.array(fit, float) - np.array(s) / n
    e, w = np.linalg.eigh(y.T @ y / n)
    e, w = e[::-1], w[:, ::-1]
    dev = [sum((n * a - b) ** 2 for a, b in zip(v, s)) for _, v in kept]
    z = (np.array([v for _, v in kept], float) - np.array(s) / n) @ w[:, :4] / np.sqrt(e[:4])
    return kept, n, dev, z, e[:4] / e.sum()


@pytest.mark.parametrize("source", ["planted", "sf0.001"])
def test_whitening(spark, source):
    if source == "planted":
        rng = np.random.default_rng(2)
        v = rng.normal(0, 1, (300, 64)) @ np.diag(1 + 1 / (1 + np.arange(64.0)))
        rows = spoiled([(i, [float(x) for x in r]) for i, r in enumerate(v)])
        got = whitening.whiten(spark.createDataFrame(rows, VEC).repartition(3)).collect()
    else:
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
        got = QUERIES["op13_whitening"](spark, "/root/testdata/sf0.001").collect()
    kept, n, dev, z, explained = brute_white([r[:2] for r in rows])
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n}
    error = {r.identity_error for r in got}
    assert len(error) == 1 and max(error) < 1e-9
    assert Counter((r.vec_id, r.component, r.deviation) for r in got) == Counter((i, c, x) for (i, _), x in zip(kept, dev) for c in range(1, 5))
    of = {(r.vec_id, r.component): r.whitened for r in got}
    for c in range(1, 5):
        a, b = np.array([of[i, c] for i, _ in kept if i is not None and i != 0]), np.array([q[c - 1] for (i, _), q in zip(kept, z) if i is not None and i != 0])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert abs(next(r.explained for r in got if r.component == c) - explained[c - 1]) < 1e-9


def test_whitening_without_spread(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25], 0, "", None), (2, [0.5, 0.25], 0, "", None)], VEC)
    got = whitening.whiten(one).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == [(i, c, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    line = spark.createDataFrame([(i, [i / 4, 0.0, i / 2], 0, "", None) for i in range(9)] + [(20, [1e300] * 3, 0, "", None)], VEC).where(F.col("vec_id") < 20)
    by = {(r.vec_id, r.component): r for r in whitening.whiten(line).collect()}
    assert by[0, 1].explained == pytest.approx(1) and by[0, 2].whitened == 0 and by[0, 1].identity_error < 1e-9
    assert whitening.whiten(spark.createDataFrame([], VEC)).count() == 0 == whitening.whiten(spark.createDataFrame([(1, [], 0, "", None)], VEC)).count()
    far = whitening.whiten(spark.createDataFrame([(1, [1e300], 0, "", None), (2, [-1e300], 0, "", None)], VEC)).collect()
    assert {abs(round(r.whitened, 9)) for r in far} == {1.0} and all(r.deviation == (1 << 63) - 1 for r in far)
