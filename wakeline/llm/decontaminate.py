"""Operator 4: benchmark items inside documents by size-partitioned MinHash containment. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import durable, free_name, maybe_broadcast, scratch

WIDTH = 5
CONTAINMENT = 0.8
#: Least sketch of an item; a size class takes more where the bound below asks for it.
LEAST_SKETCH = 8
#: Sketch or shingle rows of the benchmark (16 bytes each, kept as longs) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashes(words: Column, width: int) -> Column:
    """64-bit hashes of all shingles; `words` must be a plain column. Fewer words than `width`: none."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, width)]))


def strings(words: Column, width: int) -> Column:
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.concat_ws(" ", F.slice(words, i + 1, F.lit(width))))


def sketches(items: DataFrame, least: float) -> DataFrame:
    """MinHash sketch of every item: its k least shingle hashes, k fixed by the item's size class.

    An item of n shingles may miss m = n - ceil(least * n) of them in a document that contains it. A
    sketch of more than m hashes then has a hit in every such document, so the search loses none;
    `need` is the number of hits that containment implies. Sizes are partitioned by powers of two
    and each class takes the k of its largest size.
    """
    miss = lambda n: F.floor(n - F.ceil(F.lit(least) * n - 1e-9))
    sized = items.withColumn("size_class", F.floor(F.log2("n_shingles")))
    k = F.greatest(F.lit(LEAST_SKETCH), miss(F.pow(F.lit(2.0), F.col("size_class") + 1) - 1) + 1)
    sized = sized.withColumn("k", F.least(k, F.col("n_shingles")).cast("int"))
    order = Window.partitionBy("item_id", "_item").orderBy("h")
    picked = sized.withColumn("_rank", F.row_number().over(order)).where("_rank <= k")
    return picked.select("item_id", "_item", "n_shingles", "width", "h", F.greatest(F.lit(1), F.col("k") - miss(F.col("n_shingles"))).cast("int").alias("need"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = CONTAINMENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every pair of containment `least` or more.

    Containment is the share of an item's distinct five-word shingles that the document has. Items of
    one to four words are one shingle of their own length; items without words match nothing, nor
    do null and empty texts. Repeated rows give their pairs once; texts that share a doc_id are searched one by
    one and the pair of highest containment is returned; null ids are ids like others, empty tables give none, other
    columns are ignored.
    """
    pairs = leaks_by_row(docs, benchmark, least, width)
    return pairs.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("containment", "n_shingles", "n_shared")).alias("m")
    ).select("doc_id", "item_id", F.col("m.n_shingles"), F.col("m.n_shared"), F.col("m.containment"))


def leaks_by_row(docs: DataFrame, benchmark: DataFrame, least: float, width: int) -> DataFrame:
    """The pairs by text; _text holds two hashes of the text, which with doc_id name a row."""
    with scratch() as keep:
        return keep(pairs_of(docs, benchmark, least, width))


def text_key(text: str = "text") -> Column:
    """Two independent hashes of a text, of 64 and 32 bits."""
    return F.struct(F.xxhash64(text).alias("h"), F.crc32(F.coalesce(text, F.lit(""))).alias("c"))


def every_width(words: Column, widths: list[int], of: Callable[[Column, int], Column]) -> Column:
    """(width, v) of the shingles of all widths in one array, so that a text is cut into words once."""

    def sized(k: int) -> Column:
        return F.transform(of(words, k), lambda v: F.struct(F.lit(k).alias("width"), v.alias("v")))

    return F.explode(F.concat(*map(sized, widths))).alias("x")


def pairs_of(docs: DataFrame, benchmark: DataFrame, least: float, width: int) -> DataFrame:
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w"), F.xxhash64("text").alias("_item"))
    items = items.distinct().withColumn("width", F.least(F.size("w"), F.lit(width))).where("width > 0")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # `width` values at most
    per = [
        items.where(F.col("width") == k).select("item_id", "_item", "width", F.explode(F.arrays_zip(hashes(F.col("w"), k).alias("h"), strings(F.col("w"), k).alias("s"))).alias("x"))
        for k in widths
    ]
    if not per:
        empty = docs.select("doc_id", text_key().alias("_text")).limit(0)
        return empty.select("doc_id", "_text", *[F.lit(None).cast(t).alias(n) for n, t in (("item_id", benchmark.schema["item_id"].dataType), ("n_shingles", "long"), ("n_shared", "long"), ("containment", "double"))])
    all_items = per[0]
    for more in per[1:]:
        all_items = all_items.unionByName(more)
    all_items = all_items.select("item_id", "_item", "width", F.col("x.h").alias("h"), F.col("x.s").alias("s")).distinct()
    size = Window.partitionBy("item_id", "_item")
    all_items = durable(all_items.withColumn("n_shingles", F.count("*").over(size)))
    sketch = durable(sketches(all_items.drop("s"), least))

    texts = docs.select("doc_id", text_key().alias("_text"), words_of(F.col("text")).alias("w"))
    small = maybe_broadcast(sketch, sketch.count(), BROADCAST_ROWS)
    hits = texts.select("doc_id", "_text", every_width(F.col("w"), widths, hashes)).select("doc_id", "_text", F.col("x.width").alias("width"), F.col("x.v").alias("h"))
    hits = hits.join(small, ["width", "h"])
    found = (
        hits.groupBy("doc_id", "_text", "item_id", "_item", "need", "h").agg(F.lit(1).alias("one"))
        .groupBy("doc_id", "_text", "item_id", "_item", "need").agg(F.count("*").alias("hits")).where("hits >= need")
    )
    found = durable(found.select("doc_id", "_text", "item_id", "_item"))
    # Exact shingles, of the candidate documents only.
    rows = found.select("doc_id", "_text").distinct()
    n_rows = rows.count()
    rows = rows.select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"))
    near = texts.join(maybe_broadcast(rows, n_rows), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")), "left_semi")
    exact = maybe_broadcast(all_items.select("item_id", "_item", "width", "s", "n_shingles"), all_items.count(), BROADCAST_ROWS // 10)
    shared = near.select("doc_id", "_text", every_width(F.col("w"), widths, lambda w, k: F.array_distinct(strings(w, k)))).select("doc_id", "_text", F.col("x.width").alias("width"), F.col("x.v").alias("s"))
    shared = shared.join(exact, ["width", "s"])
    # Repeated rows of one text show the same shingles, so shingles are counted once for each text.
    shared = shared.groupBy("doc_id", "_text", "item_id", "_item", "n_shingles", "s").agg(F.lit(1).alias("one"))
    counted = shared.groupBy("doc_id", "_text", "item_id", "_item", "n_shingles").agg(F.count("*").alias("n_shared"))
    counted = counted.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    return counted.where(F.col("containment") >= least - 1e-12).select("doc_id", "_text", "item_id", "n_shingles", "n_shared", "containment")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = CONTAINMENT, width: int = WIDTH) -> DataFrame:
    """The documents that contain no benchmark item, with their columns, whatever these are named."""
    d, t = free_name(docs, "d"), free_name(docs, "t")
    rows = durable(leaks_by_row(docs.select("doc_id", "text"), benchmark, least, width).select(F.col("doc_id").alias(d), F.col("_text").alias(t)).distinct())
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(f"{t}.h")) & (F.crc32(F.coalesce("text", F.lit(""))) == F.col(f"{t}.c"))
    return docs.join(maybe_broadcast(rows, rows.count()), same, "left_anti")


ORACLE = r"""
WITH w AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(len(ws), 5) AS width,
         unnest(list_transform(range(1, len(ws) - least(len(ws), 5) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 5) - 1], ' '))) AS s
       FROM b WHERE len(ws) > 0),
bn AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_shingles FROM bs),
ds AS (SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(ws) - width + 2), lambda i: array_to_string(ws[i:i + width - 1], ' '))) AS s
       FROM w, (SELECT DISTINCT width FROM bs))
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*)::DOUBLE / n_shingles AS containment
FROM ds JOIN bn USING (width, s) GROUP BY doc_id, item_id, n_shingles HAVING count(*)::DOUBLE / n_shingles >= 0.8 - 1e-12
"""
