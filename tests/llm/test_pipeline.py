"""corpus_pipeline.run against a brute-force chain of its five stages."""

import struct
import zlib
from collections import Counter

import pytest
import xxhash
from test_operators import DOC, brute_leaks, corpus, text_of, union_find

import corpus_pipeline
from wakeline.llm import mixing, quality, sharding


def h(*values):
    """Spark's xxhash64 of several columns: each hash seeds the next, a null leaves it as it is."""
    seed = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<q" if isinstance(v, Long) else "<i", v)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


class Long(int):
    pass


def tables(spark, folder):
    import random

    rng = random.Random(17)
    rows = corpus()
    rows += [(1000 + i, " ".join(rng.choice("zz qq ## %% 11 ..".split()) for _ in range(60)), "en", "a", 0, 1.0, i, "") for i in range(40)]
    rows += [(2000 + i, text_of(rng, 40), "en", ["hot", "a", "b"][i % 3], 0, 1.0, i, "") for i in range(150)]
    bench = [(1, " ".join(corpus()[9][1].split()[:20])), (2, text_of(rng, 30)), (3, None)]
    labels = [(r[0], int(r[0] < 1000 or r[0] >= 2000), 0) for r in rows if r[0] is not None]
    spark.createDataFrame(rows, DOC).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, bench


def one_of_each(rows):
    """The document of least id of each group of similarity 0.8."""
    tok = lambda t: (t or "").lower().split()
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := tok(r[1])) else frozenset() for r in rows]
    similar = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    comp = union_find([(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])], range(len(rows)))
    best = {}
    for i, c in comp.items():
        r = rows[i]
        key = (r[0] is None, r[0] or 0, h(r[1]))
        if c not in best or key < best[c][0]:
            best[c] = (key, r)
    return [r for _, r in best.values()]


def copies_of(rows, exponent, blocks=mixing.LEAST_BLOCKS, seed=mixing.SEED):
    """Epochs of every row: blocks in a hashed order, then documents of the block that the budget cuts."""
    n = [len([w for w in (r[1] or "").replace("\x0b", " ").split(" ") for w in w.split()]) for r in rows]
    source = [r[3] or "" for r in rows]
    total = Counter()
    for s, k in zip(source, n):
        total[s] += k
    top = max(total.values())
    block = [h(None if r[0] is None else Long(r[0]), seed) % blocks for r in rows]
    out = [1] * len(rows)
    for s in total:
        if not total[s]:
            continue
        epochs = (total[s] / sum(total.values()) / (top / sum(total.values()))) ** (exponent - 1)
        whole = int(epochs)
        budget = round((epochs - whole) * total[s])
        own = [i for i in range(len(rows)) if source[i] == s]
        upto = 0
        for b in sorted({block[i] for i in own}, key=lambda b: (h(s, b, seed), b)):
            inside = [i for i in own if block[i] == b]
            tokens, left = sum(n[i] for i in inside), budget - upto
            upto += tokens
            taken = 0
            for i in sorted(inside, key=lambda i: (h(None if rows[i][0] is None else Long(rows[i][0]), seed + 1), rows[i][0] is not None, rows[i][0] or 0, h(rows[i][1]))):
                taken += n[i]
                out[i] = whole + (upto <= budget or left > 0 and taken <= left)
    return out


def test_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(5, "é text", None)], "a long, b string, c string").select(F.xxhash64("b"), F.xxhash64("a", F.lit(17)), F.xxhash64("b", F.lit(3), F.lit(17)), F.xxhash64("c", "a")).first()
    assert tuple(r) == (h("é text"), h(Long(5), 17), h("é text", 3, 17), h(None, Long(5)))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    return folder, *tables(spark, folder)


def test_run(spark, made):
    folder, rows, bench = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scorer = quality.Scorer(quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    good = [r for r in rows if scorer([(r[1] or "").encode()])[0] >= quality.THRESHOLD]
    assert 100 < len(good) < len(rows) and sum(1000 <= (r[0] or 0) < 2000 for r in good) < 10
    unique = one_of_each(good)
    assert len(unique) < len(good) - 40
    bad = {(d, r[1]) for r in unique for d, *_ in brute_leaks([r], bench)}
    clean = [r for r in unique if (r[0], r[1]) not in bad]
    assert len(clean) < len(unique)
    df = spark.createDataFrame(clean, DOC)
    exponent = mixing.plan(df)[2]
    want = Counter()
    for r, k in zip(clean, copies_of(clean, exponent)):
        want[r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())] += k
    assert any(k > 1 for k in want.values())
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    count = Counter(r.shard for r in out)
    assert set(count) <= set(range(sharding.SHARDS)) and max(count.values()) - min(count.values()) <= 1
    for s, n in count.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))


def test_stages_keep_the_columns_and_take_empty_tables(spark, made):
    folder = made[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0, name
