"""Operator 1: shards by balanced label propagation. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import dense_rank_rows, discard, durable, maybe_broadcast, scratch

SHARDS = 8
#: Rounds end when two on end admit no more than one row in this many, or as many as fewest do before STALL on end.
FEW, STALL = 1000, 4
#: Labels that are broadcast in a round; more are joined by a shuffle.
FEW_LABELS = 50_000
#: Rows of a key that one task joins with the key's label; a more common key is split.
SPLIT = 2048
#: Buckets by hash in which rows are numbered side by side.
BUCKETS = 4096


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the hashes of all lines of every row; the text goes no further."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = F.transform(F.filter(F.split(text, "\n"), lambda l: F.trim(l) != ""), lambda l: F.xxhash64(F.trim(l)))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.array_sort(F.array_distinct(hashed)).alias("keys")
    )


def start(rows: DataFrame, shards: int, buckets: int) -> DataFrame:
    """Number all rows without gaps, rows of the same first key mostly near each other, and cut the
    numbers into equal ranges: counts differ by one at most. `pos` names the row from here on."""
    salts = 64  # of 4096 buckets: a first key that all rows share still fills 64 of them
    first = F.coalesce(F.get("keys", F.lit(0)), F.xxhash64("doc_id"))
    mixed = F.xxhash64("doc_id", "text_crc32")
    bucket = F.pmod(F.shiftright(first, 32), F.lit(buckets // salts)) * salts + F.pmod(mixed, F.lit(salts))
    out = dense_rank_rows(rows, [], bucket, [first, mixed, "doc_id", "text_crc32", "size"], "pos", buckets)
    total = rows.count()
    shard = F.floor(F.col("pos") * shards / F.lit(max(total, 1)))
    return out.withColumn("shard", shard.cast("int"))


def linked(rows: DataFrame, split: int = SPLIT) -> tuple[DataFrame, int]:
    """The rows with only those keys that another row has too, each with the row's part of it, and how many parts there are."""
    ends = rows.select("pos", F.explode("keys").alias("key"))
    shared = durable(ends.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", parts(F.col("n"), split).alias("parts")))
    n = shared.agg(F.count("*"), F.coalesce(F.sum("parts"), F.lit(0))).first()
    part = F.pmod(F.xxhash64("pos"), "parts").cast("int").alias("part")
    links = ends.join(maybe_broadcast(shared, n[0]), "key").select("pos", F.struct("key", part).alias("k")).groupBy("pos").agg(F.collect_list("k").alias("links"))
    none = F.array().cast("array<struct<key:bigint,part:int>>")
    out = durable(rows.drop("keys").join(links, "pos", "left").withColumn("keys", F.coalesce("links", none)).drop("links"))
    discard(shared)
    return out, int(n[1])


def parts(n: Column, split: int) -> Column:
    return F.ceil(n / split).cast("int")


def propose(state: DataFrame, turn: int, keys: int, split: int = SPLIT) -> DataFrame:
    """(pos, shard, target, gain) of rows that a move would bring nearer to their neighbours.

    A key's label is its commonest shard, its strength the share of the key's rows there. A row
    weighs the labels of its keys. Rows take turns, so that two of a pair do not change places. Votes are counted
    before they are shuffled, and a common key's label goes to all of its parts.
    """
    ends = state.select("pos", "shard", F.explode("keys").alias("k")).select("pos", "shard", "k.key", "k.part")
    votes = ends.groupBy("key", "shard").agg(F.count("*").alias("n"))
    label = votes.groupBy("key").agg(F.max(F.struct("n", (-F.col("shard")).alias("s"))).alias("top"), F.sum("n").alias("all")).where("all > 1")
    label = label.select("key", F.explode(F.sequence(F.lit(0), parts(F.col("all"), split) - 1)).alias("part"), (-F.col("top.s")).alias("target"), (F.col("top.n") / F.col("all")).alias("w"))
    label = F.broadcast(label) if keys <= FEW_LABELS else label.repartition("key", "part")  # else the join would deal by key alone
    # One exchange by row serves both sums.
    weighed = ends.join(label, ["key", "part"]).select("pos", "shard", "target", "w").repartition("pos").groupBy("pos", "shard", "target").agg(F.sum("w").alias("w"))
    own = F.sum(F.when(F.col("target") == F.col("shard"), F.col("w")).otherwise(0.0)).alias("own")
    best = weighed.groupBy("pos", "shard").agg(F.max(F.struct("w", (-F.col("target")).alias("t"))).alias("top"), own)
    best = best.select("pos", "shard", (-F.col("top.t")).alias("target"), (F.col("top.w") - F.col("own")).alias("gain"))
    return best.where((F.col("target") != F.col("shard")) & (F.col("gain") > 1e-9) & (F.pmod(F.xxhash64("pos", F.lit(turn)), F.lit(2)) == 0))


def admit(moves: DataFrame, turn: int, levels: int = 16, salts: int = 64) -> DataFrame:
    """(pos, target) of the moves that quotas allow: as many from a to b as from b to a, best gains first.

    Sizes therefore stay as they were. Moves are ranked within a pair of shards by gain without a
    task seeing all of a pair.
    """
    level = F.lit(levels - 1) - F.least(F.lit(levels - 1), F.floor(F.col("gain") * 4)).cast("int")
    ranked = dense_rank_rows(moves, ["shard", "target"], level * salts + F.pmod(F.xxhash64("pos", F.lit(-turn)), F.lit(salts)), [F.desc("gain"), "pos"], "rank", levels * salts)
    counts = moves.groupBy("shard", "target").agg(F.count("*").alias("there"))
    back = counts.select(F.col("shard").alias("target"), F.col("target").alias("shard"), F.col("there").alias("quota"))
    quotas = F.broadcast(back)  # a row for each ordered pair of shards at most
    return ranked.join(quotas, ["shard", "target"]).where("rank < quota").select("pos", "target")


def place(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and start_shard of every row.

    Documents are linked that share a line (equal texts share all). Shards start as equal ranges of
    rows, counts at most one apart, and every round of label propagation swaps equal numbers between
    each two shards, so law `rows` holds throughout. Rounds go on until few moves are left, or `rounds`.
    A null text counts as empty; repeated rows and null ids are rows like any others; texts
    without lines have no links and stay; an empty table gives none; other columns are ignored.
    """
    with scratch() as keep:
        rows = durable(nodes(docs))
        state, keys = linked(durable(start(rows, shards, buckets).withColumn("start_shard", F.col("shard"))))
        total = state.count()
        few, least, quiet, stalled, turn = total // FEW, float("inf"), 0, 0, 0
        while quiet < 2 and stalled < STALL and turn != rounds:
            with scratch() as keep_state:
                moved = durable(admit(durable(propose(state, turn, keys)), turn))
                n = moved.count()
                quiet = quiet + 1 if n <= few else 0
                stalled = 0 if n < least else stalled + 1
                least, turn = min(least, n), turn + 1
                if n:
                    old, state = state, keep_state(state.join(moved, "pos", "left").withColumn("shard", F.coalesce("target", "shard")).drop("target"))
                    discard(old)
        ranges = F.floor(F.col("pos") * (buckets // shards) / F.lit(max(total, 1))).cast("int")
        out = dense_rank_rows(state, ["shard"], ranges, ["pos"], "slot", buckets // shards)
        return keep(out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "start_shard"))
