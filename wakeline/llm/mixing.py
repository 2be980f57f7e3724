"""Operator 7: temperature mixing of sources to target weights, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import durable, free_name, maybe_broadcast

#: Most epochs of the most repeated source; the least repeated one runs once.
MAX_REPEATS = 2.0
#: Rows of a block, which one task sorts, and blocks of a source at least.
BLOCK_ROWS, LEAST_BLOCKS = 20_000, 256
SEED = 17


def blocks_for(docs: DataFrame) -> int:
    """Blocks of a source, as many as keep a block small should all rows be of one source."""
    return max(LEAST_BLOCKS, -(-docs.count() // BLOCK_ROWS))


def token_count(text):
    """Runs of characters other than ASCII white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).cast("long")


def find_exponent(totals: DataFrame, max_repeats: float, entropy: float | None, passes: int = 6, fan: int = 32) -> float:
    """The exponent a in [0, 1] of weights proportional to share ** a, by bisection.

    With `entropy` (a share of the uniform entropy): the largest exponent that reaches it. Else the
    least exponent at which no source repeats more than `max_repeats` times as often as another.
    Each pass evaluates `fan` exponents in one aggregate over the sources, so a pass is five
    halvings and only `fan` numbers reach the driver, however many sources there are.
    """
    lo, hi = 0.0, 1.0
    for _ in range(passes):
        grid = [lo + (hi - lo) * i / fan for i in range(fan + 1)]
        z = [F.sum(F.pow("share", F.lit(a))).alias(f"z{i}") for i, a in enumerate(grid)]
        e = [F.sum(F.pow("share", F.lit(a)) * F.lit(a) * F.log("share")).alias(f"e{i}") for i, a in enumerate(grid)]
        row = totals.agg(*z, *e, F.min("share").alias("low"), F.max("share").alias("high"), F.count("*").alias("n")).first()
        if row.n < 2:
            return 1.0
        if entropy is not None:
            values = [math.log(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"] for i in range(fan + 1)]
            good = [i for i, v in enumerate(values) if v >= entropy * math.log(row.n) - 1e-12]
            at = max(good, default=0)
            lo, hi = grid[at], grid[min(at + 1, fan)]
        else:
            good = [i for i, a in enumerate(grid) if (row.high / row.low) ** (1 - a) <= max_repeats * (1 + 1e-12)]
            at = min(good, default=fan)
            lo, hi = grid[max(at - 1, 0)], grid[at]
        if lo == hi:
            break
    return lo if entropy is not None else hi


def plan(docs: DataFrame, max_repeats: float = MAX_REPEATS, entropy: float | None = None, blocks: int = LEAST_BLOCKS, seed: int = SEED) -> tuple[DataFrame, DataFrame, float]:
    """(blocks, boundary, exponent): epochs of every block of every source, and the documents of the
    blocks that the last epoch's budget cuts, if they are in it."""
    rows = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"), F.crc32(F.coalesce("text", F.lit(""))).alias("_crc"), block_of(blocks, seed).alias("_block"), token_count(F.col("text")).alias("n")
    )
    rows = durable(rows.groupBy("_source", "_block", "_doc", "_text", "_crc").agg(F.sum("n").alias("n")))
    cells = rows.groupBy("_source", "_block").agg(F.sum("n").alias("tokens"))
    cells = durable(cells)
    totals = cells.groupBy("_source").agg(F.sum("tokens").alias("total"))
    grand = totals.agg(F.sum("total")).first()[0] or 0
    totals = totals.withColumn("share", F.col("total") / F.lit(float(max(grand, 1)))).where("total > 0")
    a = find_exponent(totals, max_repeats, entropy)
    ends = totals.agg(F.min("share"), F.max("share")).first()
    top = ends[1] or 1.0
    # Weight over share is share ** (a - 1) up to a factor; the largest source runs exactly once.
    epochs = totals.withColumn("epochs", F.pow(F.col("share") / F.lit(top), F.lit(a - 1)))
    weight = F.pow("share", F.lit(a))
    norm = totals.agg(F.sum(weight)).first()[0] or 1.0
    epochs = epochs.select("_source", F.floor("epochs").cast("int").alias("whole"), F.round((F.col("epochs") - F.floor("epochs")) * F.col("total")).cast("long").alias("budget"), (weight / norm).alias("weight"))
    order = Window.partitionBy("_source").orderBy(F.xxhash64("_source", "_block", F.lit(seed)), "_block")
    dealt = cells.join(epochs, "_source", "left").withColumn("block_order", (F.row_number().over(order) - 1).cast("int"))
    dealt = dealt.withColumn("_upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = dealt.select(
        "_source", "_block", "block_order", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("whole", F.lit(1)).alias("whole"), (F.col("budget") - F.col("_upto") + F.col("tokens")).alias("left"),
        F.coalesce(F.col("_upto") <= F.col("budget"), F.lit(False)).alias("full"),
    )
    dealt = durable(dealt)
    cut = dealt.where("not full and left > 0")
    inside = Window.partitionBy("_source", "_block").orderBy(F.xxhash64("_doc", F.lit(seed + 1)), "_doc", "_text", "_crc").rowsBetween(Window.unboundedPreceding, 0)
    boundary = rows.join(maybe_broadcast(cut, cut.count()), ["_source", "_block"]).withColumn("_sum", F.sum("n").over(inside)).where(F.col("_sum") <= F.col("left"))
    return dealt, durable(boundary.select("_source", "_doc", "_text", "_crc")), a


def block_of(blocks: int, seed: int):
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks)).cast("int")


def mix(docs: DataFrame, max_repeats: float = MAX_REPEATS, entropy: float | None = None, blocks: int | None = None, seed: int = SEED) -> DataFrame:
    """All columns, and _copies (epochs the document is in), _weight and _order (of its block in its source),
    which take the place of columns of these three names; `mixed_rows` keeps those as well.

    A source's documents fall into blocks by a hash of doc_id, an epoch runs through the blocks in a
    hashed order, and the last, partial epoch takes whole blocks and then documents of the block
    that its token budget cuts. Weights are shares of tokens to the power found, the largest source
    runs once, so no document is lost. Null sources form one source named by the empty string; null and
    empty texts have no tokens and run with their block; repeated rows stay together; sources
    without tokens run once; an empty table gives none.
    """
    blocks = blocks or blocks_for(docs)
    dealt, boundary, _ = plan(docs, max_repeats, entropy, blocks, seed)
    source, same_source, block, more, d, x, c = (free_name(docs, f"mix_{n}") for n in ("source", "same", "block", "more", "d", "x", "c"))
    cell = {n: free_name(docs, f"mix_{n}") for n in ("whole", "full", "weight", "block_order")}
    keyed = docs.withColumns({source: F.coalesce(F.col("source").cast("string"), F.lit("")), block: block_of(blocks, seed)})
    cells = dealt.select(F.col("_source").alias(source), F.col("_block").alias(block), *[F.col(n).alias(cell[n]) for n in cell])
    out = keyed.join(maybe_broadcast(cells, dealt.count()), [source, block], "left")
    last = boundary.select(F.col("_source").alias(same_source), F.col("_doc").alias(d), F.col("_text").alias(x), F.col("_crc").alias(c), F.lit(True).alias(more))
    same = (F.col(source) == F.col(same_source)) & F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(x)) & (F.crc32(F.coalesce("text", F.lit(""))) == F.col(c))
    out = out.join(maybe_broadcast(last, boundary.count()), same, "left")
    copies = F.col(cell["whole"]) + F.when(F.col(cell["full"]) | F.coalesce(more, F.lit(False)), 1).otherwise(0)
    own = [n for n in docs.columns if n not in ("_copies", "_weight", "_order")]
    return out.select(*own, copies.cast("int").alias("_copies"), F.col(cell["weight"]).alias("_weight"), F.col(cell["block_order"]).alias("_order"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The columns of the documents, whatever these are named, a row for every copy."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    out = mix(docs.withColumnsRenamed(names), **options)
    out = out.withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
