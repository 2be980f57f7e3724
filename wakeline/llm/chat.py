"""Operator 11: conversations as a prefix tree, laid out depth first so that shared turns are emitted once."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import durable, scratch

#: A turn is OPEN, its role, a line end, its text, CLOSE and a line end.
OPEN, CLOSE = "<turn>", "</turn>"
#: The role whose texts are learned.
LEARNED = "assistant"
#: Bytes of a turn's digest.
DIGEST = 16
#: Fixed value: how the public byte-level vocabularies cut a text before they merge bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SPAN = "struct<lo:bigint,hi:bigint>"


def escaped(text: Column) -> Column:
    """Backslashes are doubled, then one goes into every mark of the template: the marks cannot occur in the result."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<\\turn>")), F.lit(CLOSE), F.lit("<\\/turn>"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def formatted(role: Column, text: Column) -> Column:
    """One turn under the template; a line end within a role is written as a backslash and a tilde."""
    head = F.replace(escaped(role), F.lit("\n"), F.lit("\\~"))
    return F.concat(F.lit(OPEN), head, F.lit("\n"), escaped(text), F.lit(f"{CLOSE}\n"))


def parsed(piece: str) -> tuple[str, str]:
    """The role and text of one formatted turn."""
    head, _, text = piece[len(OPEN) : -len(CLOSE) - 1].partition("\n")
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "~" else m[1], head), unescaped(text)


def ranks_of(vocabulary: str) -> dict[bytes, int]:
    """Ranks of a byte-level vocabulary file; it is read on the driver only and goes to the tasks with their code."""
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def coder(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def turn_rows(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """conv_id, depth (0, 1, ... in a conversation), digest, n (tokens), position (tokens before it), text and loss of every turn,
    and with a vocabulary its ids. Marks, role and text are encoded apart, so that `loss`, an interval of the turn's tokens, is exact."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    head, body, whole = F.concat(F.lit(OPEN), F.replace(escaped(role), F.lit("\n"), F.lit("\\~")), F.lit("\n")), escaped(text), formatted(role, text)
    first = F.char_length(head).cast("long")
    learned = F.when(role == LEARNED, F.struct(first.alias("lo"), (first + F.char_length(body)).alias("hi")))
    key = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.md5(whole).alias("digest")]
    if vocabulary is None:
        rows = conversations.select(*key, F.char_length(whole).cast("long").alias("n"), whole.alias("text"), learned.alias("loss"))
    else:
        ranks = ranks_of(vocabulary)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = coder(ranks)
            for b in batches:
                parts = [[own.encode_ordinary(t) for t in b.column(i).to_pylist()] for i in (3, 4)]
                tail = own.encode_ordinary(f"{CLOSE}\n")
                ids = [x + y + tail for x, y in zip(*parts)]
                loss = [{"lo": len(x), "hi": len(x) + len(y)} if own_role else None for x, y, own_role in zip(*parts, b.column(6).to_pylist())]
                cols = [*b.columns[:3], pa.array(map(len, ids), pa.int64()), b.column(5), pa.array(loss, pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.array(ids, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["conv_id", "turn", "digest", "n", "text", "loss", "ids"])

        cut = conversations.select(*key, head.alias("head"), body.alias("body"), whole.alias("text"), (role == LEARNED).alias("own"))
        rows = durable(cut.mapInArrow(encode, f"conv_id long, turn long, digest string, n long, text string, loss {SPAN}, ids array<int>"))
    order = Window.partitionBy("conv_id").orderBy("turn", "digest")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"depth": F.row_number().over(order) - 1, "position": before})


def in_order(turns: DataFrame) -> DataFrame:
    """One row a conversation: run, rank in it, path (the digests of its turns, end to end) and ends (tokens up to the end of each turn).

    Sorted by path, conversations come in the order in which a walk of the prefix tree, depth first, ends them: what one
    shares with any before it, it shares with the last one. Runs are ranges of that order; a hot first turn, or copies of
    one conversation, spread over as many runs as their number asks for.
    """
    one = F.array_sort(F.collect_list(F.struct("depth", "digest", (F.col("position") + F.col("n")).alias("end"))))
    paths = turns.groupBy("conv_id").agg(one.alias("t"))
    paths = paths.select("conv_id", F.unhex(F.array_join(F.col("t.digest"), "")).alias("path"), F.col("t.end").alias("ends"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = paths.repartitionByRange(n, "path", "conv_id").withColumn("run", F.spark_partition_id())
    return durable(runs)


def shared_turns(a: bytes, b: bytes) -> int:
    """How many first turns two paths have in common, by bisection on equal prefixes."""
    lo, hi = 0, min(len(a), len(b)) // DIGEST
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * DIGEST : mid * DIGEST] == b[lo * DIGEST : mid * DIGEST]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def sorted_runs(ordered: DataFrame) -> DataFrame:
    return ordered.select("run", "conv_id", "path", "ends").repartition("run").sortWithinPartitions("run", "path", "conv_id")


def walked(rows: Iterator[tuple], entry: dict | None = None) -> Iterator[tuple]:
    """(row, new, shared, start, stack, rank) of (run, conv_id, path, ends) rows in order.

    `stack` holds (first turn, start) of the stretches of the layout that make up the path. `entry` has for each run
    its first start, the turns that its first conversation shares with the run before, and the stack it begins with.
    """
    run, stack, last, offset, rank = None, [], b"", 0, 0
    for row in rows:
        new = row[0] != run
        if new:
            run, rank = row[0], 0
            offset, shared, stack = (0, 0, []) if entry is None else (entry[run][0], entry[run][1], list(entry[run][2]))
        else:
            shared = shared_turns(last, row[2])
        while stack and stack[-1][0] >= shared:
            stack.pop()
        start, n = offset, len(row[2]) // DIGEST
        if shared < n:
            stack.append((shared, start))
            offset += row[3][-1] - (row[3][shared - 1] if shared else 0)
        yield row, new, shared, start, stack, rank
        last, rank = row[2], rank + 1


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


STACK = pa.list_(pa.struct([("turn", pa.int64()), ("start", pa.int64())]))


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a run, walked as if nothing came before it: what the run leaves for the next one."""
    own: dict | None = None

    def packed() -> pa.RecordBatch:
        own["stack"] = [{"turn": t, "start": s} for t, s in own["stack"]]
        return pa.RecordBatch.from_pylist([own], pa.schema([("run", pa.int32()), ("first", pa.binary()), ("ends", pa.list_(pa.int64())), ("last", pa.binary()), ("low", pa.int64()), ("total", pa.int64()), ("stack", STACK)]))

    for row, new, shared, start, stack, _ in walked(rows_of(batches)):
        if new:
            if own:
                yield packed()
            own = {"run": row[0], "first": row[2], "ends": row[3], "low": 1 << 62}
        else:
            own["low"] = min(own["low"], shared)
        n = len(row[2]) // DIGEST
        grown = row[3][-1] - (row[3][shared - 1] if shared else 0) if shared < n else 0
        own |= {"last": row[2], "total": start + grown, "stack": list(stack)}
    if own:
        yield packed()


def entries(runs: list) -> tuple[dict, list[tuple]]:
    """What `walked` needs at the start of each run, and (run, depth, start) of the turns its first conversation shares
    with earlier runs. `runs` has a row a run, so its size follows the number of partitions, not the rows."""
    out, carried, stack, last, offset = {}, [], [], b"", 0
    for s in runs:
        first, low = len(s.first) // DIGEST, s.low
        shared = shared_turns(last, s.first)
        stack = [x for x in stack if x[0] < shared]
        cut = s.ends[shared - 1] if shared else 0
        out[s.run] = (offset, shared, stack)
        for (turn, start), upto in zip(stack, [*(x[0] for x in stack[1:]), shared]):
            base = s.ends[turn - 1] if turn else 0
            carried += [(s.run, t, start + (s.ends[t - 1] if t else 0) - base) for t in range(turn, upto)]
        own = [(x.turn, x.start) for x in s.stack]
        if own[0] == (0, 0):  # the first conversation's stretch, part of which the runs before hold
            kept = [x for x in stack if x[0] < low] + ([(shared, offset)] if shared < min(low, first) else [])
            own = own[1:]
        else:
            kept = []
        stack = kept + [(t, offset + at - cut) for t, at in own]
        last, offset = s.last, offset + s.total - cut
    return out, carried


def layout(conversations: DataFrame, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes of the prefix tree in depth-first order, and (run, depth, start) of nodes that a run needs from earlier ones.

    A node is a turn that follows the same turns: conversations that begin alike share the nodes of their common turns.
    Sorted by (run, rank, depth) the texts of all nodes, end to end, are the token stream, a token being one character; with a
    `vocabulary`, a file of byte-level ranks, it is that of their `ids`. `start` is a node's place in the stream, `position` that of its
    first token in the conversation, `attends` the intervals of the stream that hold its ancestors: a token sees those and what
    precedes it in its own node. `loss` is the interval of the node's tokens that are learned: the text between an assistant's
    marks. A row without text ends conversation `conv_id` after `depth` turns.

    Turns are ordered by `turn` (nulls first), those of one number by their digest; repeated rows are turns of their own. A null
    role or text is empty; rows without conv_id are one conversation; an empty table gives none; other columns are ignored.
    A conversation's digests, 16 bytes a turn, are one row; its texts are not.
    """
    turns = turn_rows(conversations.select("conv_id", "turn", "role", "text"), vocabulary)
    ordered = in_order(turns)
    found = sorted_runs(ordered).mapInArrow(summaries, "run int, first binary, ends array<long>, last binary, low long, total long, stack array<struct<turn:bigint,start:bigint>>")
    entry, carried = entries(sorted(found.collect(), key=lambda s: s.run))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for (run, conv, path, ends), _, shared, start, stack, rank in walked(rows_of(batches), entry):
            before = stack[:-1] if shared < len(path) // DIGEST else stack
            seen: list[dict] = []
            for (turn, lo), upto in zip(before, [*(x[0] for x in before[1:]), shared]):
                hi = lo + (ends[upto - 1] if upto else 0) - (ends[turn - 1] if turn else 0)
                if seen and seen[-1]["hi"] == lo:
                    seen[-1]["hi"] = hi
                else:
                    seen.append({"lo": lo, "hi": hi})
            out.append({"conv": conv, "run": run, "rank": rank, "n_turns": len(path) // DIGEST, "shared": shared, "first": start, "since": ends[shared - 1] if shared else 0, "seen": seen})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, plan)
                out = []
        yield pa.RecordBatch.from_pylist(out, plan)

    span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    plan = pa.schema([("conv", pa.int64()), ("run", pa.int32()), ("rank", pa.int64()), ("n_turns", pa.int32()), ("shared", pa.int32()), ("first", pa.int64()), ("since", pa.int64()), ("seen", span)])
    kinds = "conv long, run int, rank long, n_turns int, shared int, first long, since long, seen array<struct<lo:bigint,hi:bigint>>"
    placed = durable(sorted_runs(ordered).mapInArrow(place, kinds))
    met = turns.join(placed, F.col("conv_id").eqNullSafe(F.col("conv"))).where("depth >= shared")
    start = F.col("first") + F.col("position") - F.col("since")
    last = F.get("seen", F.size("seen") - 1)
    joined = F.when(F.col("depth") == F.col("shared"), F.col("seen")).when(
        (F.size("seen") > 0) & (last["hi"] == F.col("first")), F.concat(F.slice("seen", 1, F.greatest(F.size("seen") - 1, F.lit(0))), F.array(F.struct(last["lo"].alias("lo"), start.alias("hi"))))
    )
    attends = joined.otherwise(F.concat("seen", F.array(F.struct(F.col("first").alias("lo"), start.alias("hi")))))
    nodes = met.select("run", "rank", "depth", "conv_id", "text", "loss", start.alias("start"), "position", attends.alias("attends"), *["ids"] * (vocabulary is not None))
    none = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns[4:]]
    ends = placed.select("run", "rank", F.col("n_turns").alias("depth"), F.col("conv").alias("conv_id"), *none)
    stream = nodes.unionByName(ends).repartition("run").sortWithinPartitions("run", "rank", "depth")
    return stream, conversations.sparkSession.createDataFrame(carried, "run int, depth int, start long")


def read_back(stream: DataFrame, carried: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of every conversation, from the layout alone.

    Every run is read once, in order, with the current path of the tree as a stack of texts.
    """
    tokens, ranks = ("text", None) if vocabulary is None else ("ids", ranks_of(vocabulary))
    # `carried` has at most the turns of one conversation for each run.
    before = stream.join(F.broadcast(carried.select(F.col("run").alias("to"), F.col("depth").alias("at"), "start")), "start")
    before = before.select(F.col("to").alias("run"), F.lit(-1).cast("long").alias("rank"), F.col("at").alias("depth"), "conv_id", "loss", tokens)
    rows = stream.select("run", "rank", "depth", "conv_id", "loss", tokens).unionByName(before).repartition("run").sortWithinPartitions("run", "rank", "depth")
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks) if ranks else None
        said = lambda t: own.decode(t) if own else t
        path: list[tuple] = []
        out: list[dict] = []
        for _, _, depth, conv, loss, node in rows_of(batches):
            if node is not None:
                del path[depth:]
                piece, learned = said(node), unescaped(said(node[loss["lo"] : loss["hi"]])) if loss else ""
                path.append(("{}\n{}\n".format(*parsed(piece)).encode(), learned.encode(), len(learned), len(piece)))
                continue
            told, learned = hashlib.sha256(), hashlib.sha256()
            for whole, text, _, _ in path[:depth]:
                told.update(whole)
                learned.update(text)
            out.append({"conv_id": conv, "n_turns": depth, "turns_sha256": told.hexdigest(), "loss_chars": sum(p[2] for p in path[:depth]), "loss_sha256": learned.hexdigest(), "formatted_chars": sum(p[3] for p in path[:depth])})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        yield pa.RecordBatch.from_pylist(out, kinds)

    return rows.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def packed(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The layout as a table of its own, with what `layout` says of it; intermediate tables are deleted."""
    with scratch() as keep:
        return keep(layout(conversations, vocabulary)[0])


def round_trip(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the layout, then read every conversation back from it."""
    with scratch() as keep:
        stream, carried = layout(conversations, vocabulary)
        return keep(read_back(durable(stream), carried, vocabulary))
