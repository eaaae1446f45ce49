"""Best-fit packing of tokenised documents into sequences of a fixed length.

The number of different lengths is bounded by the capacity, so packing is decided on a
histogram of lengths: Martello and Toth's dominance reduction fixes small sets that
provably dominate every alternative, best-fit decreasing packs what is left, and both
work on counts, many equal sequences at a time. The plan is a small table whose size
depends on the capacity only. Rows find their place in it by their rank among rows of
equal length; ranks are taken inside salted groups, so no length gathers in one task.

Defined results: a null or empty text is one piece of one token (the end token); equal
or repeated rows are packed once each; an empty table gives no rows; other columns,
whatever their names, are ignored; a null id is carried through.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithgraph.llm import shared
from kithgraph.llm.tokens import Encoder

CAPACITY = 1024
END_ID = 2


@dataclass
class Run:
    """`times` equal sequences, each with these (length, copies)."""

    times: int
    parts: list[tuple[int, int]]


def _smallest(count: np.ndarray, want: int) -> list[int]:
    """The lengths of the `want` shortest items that are left, shortest first."""
    out: list[int] = []
    for w in np.flatnonzero(count):
        out += [int(w)] * min(int(count[w]), want - len(out))
        if len(out) == want:
            break
    return out


def _dominating(j: int, count: np.ndarray, capacity: int) -> tuple[int, ...] | None:
    """Partners with which an item of length j forms a set that dominates all others.

    count is without the item itself. None: no set of up to three items is known to.
    """
    room = capacity - j
    low = _smallest(count, 3)
    sums = np.cumsum(low)
    most = int((sums <= room).sum())
    if not most:
        return ()
    fits = np.flatnonzero(count[: room + 1])
    best = int(fits[-1])
    if most == 1 or best == room:
        return (best,)
    if most > 2:
        return None
    total, pair = 0, None  # the pair that fills most; on equal sums the one with the longest item
    for a in fits[::-1]:
        if 2 * a < total:
            break
        under = fits[fits <= min(a, room - a)]
        if len(under) and under[-1] == a and count[a] < 2:
            under = under[:-1]
        if len(under) and a + under[-1] > total:
            total, pair = int(a + under[-1]), (int(a), int(under[-1]))
    if pair is None or best >= total:
        return (best,)
    between = count[pair[1] + 1 : pair[0]]
    if pair[0] == best and (int(between.sum()) <= 1 or j + sum(pair[1] + 1 + w for w in _smallest(between, 2)) > capacity):
        return pair
    return None


def reduce_by_dominance(count: np.ndarray, capacity: int) -> list[Run]:
    """Fix dominating sets, longest items first, and take them out of count.

    A set is repeated while enough items of each of its lengths stay, since what
    makes it dominating depends on lengths and on at most a handful of counts.
    """
    fixed: list[Run] = []
    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while count[j]:
                count[j] -= 1
                partners = _dominating(j, count, capacity)
                count[j] += 1
                if partners is None:
                    break
                used: dict[int, int] = {}
                for w in (j, *partners):
                    used[w] = used.get(w, 0) + 1
                times = int(count[j]) if not partners else max(1, min((int(count[w]) - 6) // k for w, k in used.items()))
                for w, k in used.items():
                    count[w] -= times * k
                fixed.append(Run(times, sorted(used.items(), reverse=True)))
                changed = True
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[Run]:
    """Best-fit decreasing on counts: each length goes to the open sequences with the least room for it."""
    open_: dict[int, list[Run]] = {capacity: []}  # by room left
    for w in range(capacity, 0, -1):
        n = int(count[w])
        while n:
            room = min((r for r, group in open_.items() if r >= w and group), default=capacity)
            per = room // w
            if room == capacity and not open_[capacity]:
                group = [Run((n + per - 1) // per, [])]
            else:
                group = open_[room]
            run = group.pop()
            full = min(run.times, n // per)
            if full:
                open_.setdefault(room - per * w, []).append(Run(full, [*run.parts, (w, per)]))
            rest = run.times - full
            n -= full * per
            if rest and n and n < per:
                open_.setdefault(room - n * w, []).append(Run(1, [*run.parts, (w, n)]))
                rest, n = rest - 1, 0
            if rest and (run.parts or room < capacity):
                group.append(Run(rest, run.parts))
    return [run for group in open_.values() for run in group if run.parts]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[Run]:
    """Sequences for histogram[length] items of each length."""
    left = histogram.astype(np.int64).copy()
    runs = reduce_by_dominance(left, capacity)
    return runs + best_fit(left, capacity)


def places(runs: list[Run]) -> dict[str, np.ndarray]:
    """The plan by length and rank: from `rank` on, `per` copies a sequence, from `sequence` on, at `offset`."""
    out: dict[str, list[int]] = {k: [] for k in ("length", "rank", "sequence", "per", "offset")}
    used: dict[int, int] = {}
    base = 0
    for run in runs:
        offset = 0
        for w, k in run.parts:
            for name, v in zip(out, (w, used.get(w, 0), base, k, offset), strict=True):
                out[name].append(v)
            used[w] = used.get(w, 0) + run.times * k
            offset += w * k
        base += run.times
    table = {k: np.array(v, np.int64) for k, v in out.items()}
    order = np.lexsort((table["rank"], table["length"]))
    return {k: v[order] for k, v in table.items()}


_RANK_BITS = 48


def _placer(table: dict[str, np.ndarray], offsets: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    keys = (table["length"] << _RANK_BITS) | table["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_nth").to_numpy(zero_copy_only=False) + offsets[length, batch.column("_salt").to_numpy(zero_copy_only=False)]
            at = np.searchsorted(keys, (length << _RANK_BITS) | rank, "right") - 1
            k = rank - table["rank"][at]
            sequence = table["sequence"][at] + k // table["per"][at]
            offset = table["offset"][at] + (k % table["per"][at]) * length
            kept = [c for c in batch.schema.names if c not in ("_salt", "_nth", "_row")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept,
                "sequence_id", "offset"])

    return place


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every row of items (length: 1 to capacity) a sequence_id and an offset in it.

    Sequences are filled without gaps from 0. Full-length rows are sequences of their
    own, with negative numbers. items should be cheap to read again, such as a staged table.
    """
    spark = items.sparkSession
    n = shared.salts(spark)
    rows = shared.staged(items.withColumn("length", F.col("length").cast("long")).withColumn("_row", F.monotonically_increasing_id()), "packing")
    short = rows.where(F.col("length") < capacity).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(n)))
    # One row for each length and salt: bounded by capacity x salts whatever the input.
    tallies = short.groupBy("length", "_salt").count().toPandas()
    grid = np.zeros((capacity + 1, n), np.int64)
    grid[tallies["length"], tallies["_salt"]] = tallies["count"]
    before = np.cumsum(grid, axis=1) - grid
    ranked = shared.salted(short, ["length"], ["_row"], F.col("_salt"))
    names = [c for c in items.columns]
    schema = items.withColumn("length", F.col("length").cast("long")).withColumns({"sequence_id": F.lit(0)
        .cast("long"), "offset": F.lit(0).cast("long")}).schema
    packed = ranked.select(*names, "_salt", "_nth").mapInArrow(_placer(places(plan(grid.sum(axis=1), capacity)), before), schema)
    full = rows.where(F.col("length") >= capacity).select(*names, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its text's ids and end_id. Longer ones than capacity are cut so that
    all pieces but the first are full.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(tokenizer)
        for batch, data, offsets in shared.pieces(batches, "text"):
            ids, bounds = encode(data, offsets, end_id)
            sizes = np.diff(bounds)
            each = (sizes + capacity - 1) // capacity
            row = np.repeat(np.arange(len(sizes)), each)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            first = (sizes - 1) % capacity + 1
            start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[row])
            at = bounds[row] + start
            body = memoryview(ids.astype("<u4", copy=False).tobytes())
            crc = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(
                length.astype(np.int64)), pa.array(crc, pa.int64())]
            if with_ids:  # pieces follow one another, so the ids' own order is theirs
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, bounds[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise docs (doc_id, text) and pack the pieces; see tokenised() and pack()."""
    return pack(tokenised(docs, tokenizer, capacity, end_id, with_ids), capacity)
